import json
import random
import re

import pytest

from cratewise.functions import present as P
from cratewise.operators import components as K
from cratewise.operators import quota as U
from cratewise.plans import standins as D
from cratewise.sources import changes as H
from cratewise.sources import documents as O


def sequential(tokens, max_requests, max_tokens):
    out, slot, n, used = [], 0, 0, 0
    for i, t in enumerate(tokens):
        if i and (n + 1 > max_requests or used + t > max_tokens):
            slot, n, used = slot + 1, 0, 0
        n, used = n + 1, used + t
        out.append(slot)
    return out


@pytest.mark.parametrize(("count", "requests", "budget"), [(0, 3, 50), (1, 3, 50), (700, 3, 50), (700, 40, 90), (60, 600, 10**9), (300, 1, 7)])
def test_slots_break_where_a_sequential_reader_would(spark, count, requests, budget):
    rng = random.Random(count + requests)
    tokens = [rng.choice([0, 1, 3, 20, 33, 200]) for _ in range(count)]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "id bigint, t bigint").repartition(5)
    found = sorted((r.id, r.slot) for r in U.exact_slots(texts, ["id"], texts.t, requests, budget).collect())
    assert [s for _, s in found] == sequential(tokens, requests, budget)


def test_a_shortest_cycle_through_every_edge(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "a")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "abcdef"], "node_id string")
    found = sorted((r.component, r.cycle) for r in K.edge_cycles(edges, K.scc(edges, nodes)).collect())
    assert found == [("a", ["a", "b", "a"]), ("a", ["a", "b", "c", "a"]), ("d", ["d", "e", "d"])]


def test_answers_have_all_fields_and_omit_unknown_ones(spark):
    kinds = {"broken": "boolean", "unfree": "boolean", "available": "boolean", "relevance_score": "double", "maintainers": "array<struct<name:string>>", "platforms": "array<string>", "outputs_to_install": "array<string>"}
    fields = [*P.RESULT_FIELDS, *P.OPTIONAL_FIELDS]
    schema = "request_id int, rank int, total_count bigint, " + ", ".join(f"{f} {kinds.get(f, 'string')}" for f in fields)
    full = {f: "x}" for f in fields} | {"broken": True, "unfree": False, "available": True, "relevance_score": 0.5, "maintainers": [{"name": "m"}], "platforms": [], "outputs_to_install": ["out"]}
    rows = [(1, 2, 9, *[None] * 19), (1, 1, 9, *[full[f] for f in fields])]
    requests = spark.createDataFrame([(1, 'a "q"', 2.5), (2, None, None)], "request_id int, query string, query_time_ms double")
    bodies = {r.request_id: json.loads(r.body) for r in P.search_answers(requests, spark.createDataFrame(rows, schema)).collect()}
    assert bodies[2] == {"message": "Search completed", "query": None, "total_count": 0, "query_time_ms": None, "search_type": "fts", "packages": []}
    first, second = bodies[1]["packages"]
    assert set(first) == {*P.RESULT_FIELDS.values(), *P.OPTIONAL_FIELDS.values()} and first["mainProgram"] == "x}"
    assert set(second) == set(P.RESULT_FIELDS.values()) and second["license"] is None
    assert bodies[1]["total_count"] == 9 and bodies[1]["query"] == 'a "q"'


def test_node_lookup_by_list_and_by_table(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "node_id string, name string")
    pages = spark.createDataFrame([("a", "direct_dependencies", 0, ["b"]), ("a", "direct_dependencies", 1, ["x", "y"])], "node_id string, relation string, page bigint, items array<string>")
    O.write_paged_nodes(nodes, pages, str(tmp_path / "nodes"))
    for asked in (["a", "c", "none"], spark.createDataFrame([("a",), ("c",), ("none",), ("a",)], "node_id string")):
        docs, found = O.read_paged_nodes(spark, str(tmp_path / "nodes"), asked)
        told = {r.node_id: json.loads(r.doc) for r in docs.collect()}
        assert told["a"]["relations"] == {"direct_dependencies": {"count": 3, "pages": 2}} and told["c"]["relations"] == {}
        assert sorted((r.page, r["items"]) for r in found.collect()) == [(0, ["b"]), (1, ["x", "y"])]


def test_digests_tell_changed_packages(spark):
    rows = [("p", "1", 1), ("p", "2", 1), ("q", "1", 1)]
    schema = "package_id string, ord string, last_updated int"

    def of(some):
        return {r.package_id: (r.n, r.mark, r.total) for r in H.digests(spark.createDataFrame(some, schema)).collect()}

    assert of(rows) == of([(p, o, 9) for p, o, _ in reversed(rows)])
    other = of([("p", "1", 1), ("p", "3", 1), ("q", "1", 1), ("q", "1", 1)])
    assert other["p"] != of(rows)["p"] and other["q"] != of(rows)["q"]


def test_record_lines_are_compiled(spark, capsys):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan is final at once
    try:
        D.record_lines(D.variant_facts(spark, "/root/testdata/sf0.001")).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000  # the JVM interprets longer methods
