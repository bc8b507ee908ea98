"""The nightly refresh: one snapshot in, all published tables and documents out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratewise.operators.components import cycles, graph_summary, scc
from cratewise.operators.graph import (
    LEADERBOARD,
    build_graph,
    degrees,
    dependency_facts,
    leaderboard,
    relation_pages,
)
from cratewise.operators.normalize import normalize
from cratewise.operators.reach import reach_pairs
from cratewise.operators.search import STORE_COLUMNS, build_index, write_index
from cratewise.operators.sequence import PAGE_SIZE
from cratewise.operators.star import build_catalog
from cratewise.session import materialize
from cratewise.sources.catalog import catalog_documents, read_catalog, write_catalog
from cratewise.sources.documents import (
    node_documents,
    stats_document,
    store_documents,
    write_document_store,
    write_index as write_node_index,
    write_node_documents,
    write_stats,
)
from cratewise.sources.snapshot import read_snapshot

# Names of the modes.
MODES = {"metadata": "metadata", "minified": "minified", "both": "both", "all": "both", "full": "both"}


@dataclass
class Refresh:
    """What a run wrote, by folder name, and how many packages it read."""

    folders: dict[str, str]
    packages: int


def refresh(
    spark: SparkSession, snapshot_path: str, out: str, run_ts: str, mode: str = "both", nodes: bool = True
) -> Refresh:
    """Read a snapshot and publish it.

    ``metadata`` writes the star schema (and with ``nodes`` the graph outputs), ``minified``
    the document store and its index, ``both`` everything. An empty snapshot is an error.
    """
    mode = MODES[mode.lower()]
    snapshot = read_snapshot(spark, snapshot_path)
    first = snapshot.header.first()
    header = first.asDict() if first else {}
    packages = materialize(normalize(snapshot.records, run_ts), "packages")
    if packages.rows == 0:
        raise ValueError(f"no packages in {snapshot_path}")
    folders = {"catalog": f"{out}/catalog"}
    write_catalog(build_catalog(packages.df), folders["catalog"])
    if mode in ("metadata", "both") and nodes:
        folders |= publish_graph(snapshot.records, packages.df, header, out)
    if mode in ("minified", "both"):
        folders |= publish_store(spark, folders["catalog"], out)
    packages.drop()
    return Refresh(folders, packages.rows)


def publish_store(spark: SparkSession, catalog_path: str, out: str) -> dict[str, str]:
    """The compact store and the index over id, name and description, from the written catalog."""
    documents = catalog_documents(read_catalog(spark, catalog_path))
    write_document_store(store_documents(documents), f"{out}/store")
    slim = documents.select(
        F.col("package_id").alias("id"), F.col("package_name").alias("name"), "description", "broken", "unfree", "category"
    )
    write_index(build_index(slim, "id", STORE_COLUMNS, keep=["broken", "unfree", "category"]), f"{out}/index")
    return {"store": f"{out}/store", "index": f"{out}/index"}


def publish_graph(
    records: DataFrame, packages: DataFrame, header: dict[str, object], out: str, page_size: int = PAGE_SIZE
) -> dict[str, str]:
    """Node documents, pages of long lists, the node index and the statistics."""
    vertices, edges = build_graph(records)
    vertices, edges = materialize(vertices, "vertices").df, materialize(edges, "edges").df
    reach = materialize(reach_pairs(edges, vertices), "reach").df
    facts = dependency_facts(edges, vertices, reach)
    at, branch = header.get("extraction_timestamp"), header.get("nixpkgs_branch")
    write_node_documents(node_documents(packages, facts, at, branch), f"{out}/nodes")
    long_lists = relation_pages(edges, reach, page_size).where(F.col("pages") > 1)
    long_lists.write.mode("overwrite").parquet(f"{out}/node_pages")
    summary = graph_report(edges, vertices)
    write_node_index(packages, summary, f"{out}/node_index", at, branch)
    write_stats(stats_document(summary, header), f"{out}/stats")
    return {n: f"{out}/{n}" for n in ["nodes", "node_pages", "node_index", "stats"]}


def graph_report(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The statistics row with both leaderboards and the first cycles nested in it."""
    degree_table = degrees(edges, vertices)

    def board(column: str) -> DataFrame:
        top = leaderboard(degree_table, column, LEADERBOARD)
        row = F.struct((-F.col(column)).alias("rank"), F.col("node_id").alias("package"), F.col(column).alias("count"))
        return top.agg(F.sort_array(F.collect_list(row)).alias("rows")).select(
            F.transform("rows", lambda r: F.struct(r["package"].alias("package"), r["count"].alias("count"))).alias("top")
        )

    components = materialize(scc(edges, vertices), "scc").df
    found = cycles(edges, components).agg(F.sort_array(F.collect_list("cycle")).alias("c"))
    return graph_summary(edges, vertices, components).withColumns(
        {
            "top_100_most_dependencies": board("out_degree").scalar(),
            "top_100_most_dependents": board("in_degree").scalar(),
            "circular_dependencies": found.scalar(),
        }
    )
