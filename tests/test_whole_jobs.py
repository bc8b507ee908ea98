import random

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cratewise.operators import reach as B
from cratewise.plans import queries as Q
from cratewise.plans import standins as D
from cratewise.sources import documents as O


def test_cycle_edges_have_all_partners_of_a_part(spark):
    found = {(r.src, r.dst) for r in Q.cycle_edges(spark, entry.SMOKE_DIR).collect()}
    edges = [(r.src, r.dst) for r in D.part_edges(spark, entry.SMOKE_DIR).collect()]
    out = {}
    for s, t in edges:
        out.setdefault(s, set()).add(t)

    def reached(start):
        seen, stack = {start}, [start]
        while stack:
            for n in out.get(stack.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    stack.append(n)
        return seen

    reach = {n: reached(n) for n in {t for _, t in edges}}
    assert found == {(s, t) for s, t in edges if s in reach[t]}
    assert len(found) > len(out)  # more than one partner a part


def test_edges_of_a_component_are_not_rows_of_every_batch(spark):
    """A large component went as a row per edge and batch."""
    pairs = [(f"{i:03d}", f"{j:03d}") for i in range(200) for j in range(i + 1, 200)]
    edges = spark.createDataFrame(pairs, "src string, dst string").repartition(4)
    parted = B.part_graph(edges, edges.select(edges.src.alias("node_id")))
    rows = B._dealt(parted, 64, False).groupBy("kind").count().collect()
    batches = 4  # of 64 nodes
    assert sum(r["count"] for r in rows if r.kind != B._LINK) == batches * 200
    assert sum(r["count"] for r in rows if r.kind == B._LINK) < len(pairs) / 10


def test_roots_tell_strong_components():
    rng = random.Random(3)
    for nodes, links in [(40, 45), (40, 90), (5, 0), (60, 70)]:
        pairs = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(links)]
        reach = {n: {n} for n in range(nodes)}
        for _ in range(nodes):
            for s, t in pairs:
                reach[s] |= reach[t]
        root = B.strong_roots(np.array([s for s, _ in pairs], np.int64), np.array([t for _, t in pairs], np.int64), nodes)
        assert all((root[i] == root[j]) == (j in reach[i] and i in reach[j]) for i in range(nodes) for j in range(nodes))


def test_pages_are_not_worked_out_for_their_counts(spark, tmp_path):
    """they were worked out once more for the counts; the bounds of the ranges and the ranges are left."""
    made = spark.sparkContext.accumulator(0)

    def pages(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    schema = "node_id string, relation string, page bigint, items array<string>"
    rows = [(f"{i:03d}", "all_dependents", p, ["x", "y"]) for i in range(50) for p in range(2)]
    nodes = spark.createDataFrame([(f"{i:03d}", "N") for i in range(60)], "node_id string, name string")
    O.write_paged_nodes(nodes, spark.createDataFrame(rows, schema).mapInArrow(pages, schema), str(tmp_path / "nodes"))
    assert made.value <= 2 * len(rows)
    assert spark.read.parquet(str(tmp_path / "nodes" / "pages")).count() == len(rows)
    assert spark.read.parquet(str(tmp_path / "nodes" / "documents")).count() == 60


def test_order_lines_are_dealt_to_all_cores(spark):
    """By their bytes they were put together into about one task a core, or fewer."""
    placed = D.variant_facts(spark, entry.SMOKE_DIR).select(F.spark_partition_id().alias("at")).distinct()
    assert placed.count() >= 2 * spark.sparkContext.defaultParallelism
