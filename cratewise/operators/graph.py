"""Dependency graph: ``src -> dst`` means that src depends on dst."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratewise.functions import text as T
from cratewise.functions import variant as V
from cratewise.operators.sequence import PAGE_SIZE, list_pages, single_lists, whole_lists
from cratewise.operators.skew import hot_keys, join_lookup
from cratewise.session import Stored, materialize, read_stored
from cratewise.sources.snapshot import record_ordinal

LEADERBOARD = 100
# A node counts as a hub from this many edges and one thousandth of all edges on,
# so there are never more than a thousand hubs.
HUB_EDGES = 200_000
HUB_SHARE = 1000


def build_graph(records: DataFrame, multigraph: bool = False) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges from ``records(line, record)``.

    A vertex is a distinct ``name-version``; its metadata come from its last record. Inputs
    are resolved by derivation path (the last record of a repeated path wins); unresolved
    inputs and self-edges are dropped. With ``multigraph`` edges keep how often they occur.
    """
    opened = records.select(
        "line",
        V.as_text(F.col("record.name")).alias("name"),
        F.array_join(V.only_texts(F.col("record.attrPath")), ".").alias("attr_path"),
        V.as_text(F.col("record.drvPath")).alias("drv_path"),
        F.map_keys(F.try_variant_get("record.inputDrvs", "$", "map<string,variant>")).alias("inputs"),
    )
    rows = (
        opened.select(
            T.package_name(F.col("name")).alias("package_name"),
            T.package_version(F.col("name")).alias("version"),
            F.coalesce("attr_path", F.lit("")).alias("attr_path"),
            F.coalesce("drv_path", F.lit("")).alias("drv_path"),
            "inputs",
            "line",
        )
        .where(~F.col("package_name").isin("", T.UNKNOWN))
        .select(
            T.node_id(F.col("package_name"), F.col("version")).alias("node_id"),
            record_ordinal(F.col("attr_path"), F.col("drv_path"), F.col("line")).alias("ord"),
            "package_name",
            "version",
            "inputs",
        )
    )
    # read by both sides of the join and by the vertices: the records are parsed once
    stored = materialize(rows, "graph-rows")
    last = stored.df.groupBy("node_id").agg(F.max(F.struct("ord", "package_name", "version")).alias("v"))
    vertices = last.select("node_id", "v.package_name", "v.version", "v.ord.attr_path", "v.ord.drv_path")
    owners = (
        stored.df.where(F.col("ord.drv_path") != "")
        .groupBy(F.col("ord.drv_path").alias("input"))
        .agg(F.max(F.struct("ord.attr_path", "ord.tie", "node_id")).alias("last"))
        .select("input", F.col("last.node_id").alias("dst"))
    )
    named = stored.df.select(F.col("node_id").alias("src"), F.explode("inputs").alias("input"))
    hot = hot_keys(Stored(named, named.count(), stored.path), "input")
    edges = (
        join_lookup(named, owners, "input", hot)
        .where(F.col("src") != F.col("dst"))
        .select("src", "dst")
    )
    if multigraph:
        return vertices, edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    return vertices, edges.distinct()


def flip(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """Edges to follow: ``out`` towards dependencies, ``in`` towards dependents."""
    if direction not in ("out", "in"):
        raise ValueError(f"direction must be 'out' or 'in', not {direction!r}")
    pairs = edges.where(F.col("src") != F.col("dst"))
    return pairs.select("src", "dst") if direction == "out" else flip(pairs)


def neighbors(edges: DataFrame, direction: str = "out", page_size: int = PAGE_SIZE) -> DataFrame:
    """``(node_id, page, pages, items)``: direct dependencies or dependents, sorted, in pages."""
    pairs = oriented(edges, direction).distinct().select(F.col("src").alias("node_id"), "dst")
    return list_pages(pairs, "node_id", "dst", page_size)


def hubs(edges: DataFrame, min_edges: int = HUB_EDGES) -> DataFrame:
    """``(src, fan)`` of the nodes with very many out-edges, at most a thousand of them."""
    total = edges.agg(F.count(F.lit(1)).alias("n"))
    counts = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    bound = F.greatest(F.lit(min_edges), (total.scalar() / HUB_SHARE))
    return counts.where(F.col("n") > bound).select("src", F.ceil(F.col("n") / min_edges).cast("int").alias("fan"))


class FollowEdges:
    """Joins a frontier to the edges, with the edges of hubs salted.

    ``edges`` is stored once and read every round. A hub's edges are spread over ``fan``
    salts by the hash of their far end, and only the frontier rows standing on a hub are
    copied ``fan`` times. Without hubs this is a plain equi-join.
    """

    def __init__(self, edges: DataFrame, min_hub_edges: int = HUB_EDGES) -> None:
        self.stored = materialize(edges, "edges")
        self.hubs: DataFrame | None = None
        pairs = self.stored.df
        if self.stored.rows > min_hub_edges:
            found = materialize(hubs(pairs, min_hub_edges), "hubs")
            if found.rows:
                self.hubs = F.broadcast(found.df)
        if self.hubs is not None:
            fan = F.coalesce("fan", F.lit(1))
            pairs = pairs.join(self.hubs, "src", "left").select(
                "src", "dst", F.pmod(F.xxhash64("dst"), fan).cast("int").alias("salt")
            )
        self.pairs = pairs.withColumnsRenamed({"src": "at", "dst": "next"})

    def step(self, frontier: DataFrame) -> DataFrame:
        """Frontier columns (its position is ``at``) with ``next``, one row per followed edge."""
        if self.hubs is None:
            return frontier.join(self.pairs, "at")
        salts = F.explode(F.sequence(F.lit(0), F.coalesce("fan", F.lit(1)) - 1)).alias("salt")
        spread = frontier.join(self.hubs.withColumnRenamed("src", "at"), "at", "left").select(*frontier.columns, salts)
        return spread.join(self.pairs, ["at", "salt"]).drop("salt")


def closure(
    edges: DataFrame,
    seeds: DataFrame | None = None,
    direction: str = "out",
    max_hops: int | None = None,
    min_hub_edges: int = HUB_EDGES,
) -> DataFrame:
    """``(src, dst, hops)``: everything reachable from ``src`` (or from ``seeds(node_id)``) by 1..n edges.

    From all nodes and without a limit the distance doubles each round (``_doubled``). Else semi-naive: each round follows the edges only from the pairs found in the round before
    and drops the pairs known already. A node reaches itself only on a cycle. Every round is
    stored, so lineage stays one scan deep and the loop survives lost executors.
    """
    if seeds is None and max_hops is None:
        return _doubled(oriented(edges, direction).distinct(), min_hub_edges)
    follow = FollowEdges(oriented(edges, direction).distinct(), min_hub_edges)
    first = follow.stored.df.select("src", "dst", F.lit(1).alias("hops"))
    if seeds is not None:
        first = first.join(seeds.select(F.col("node_id").alias("src")).distinct(), "src", "left_semi")
    rounds = [materialize(first, "closure")]
    while rounds[-1].rows and (max_hops is None or len(rounds) < max_hops):
        frontier = rounds[-1].df.select("src", F.col("dst").alias("at"))
        reached = follow.step(frontier).select("src", F.col("next").alias("dst")).distinct()
        known = read_stored(rounds).select("src", "dst")
        fresh = reached.join(known, ["src", "dst"], "left_anti")
        rounds.append(materialize(fresh.withColumn("hops", F.lit(len(rounds) + 1)), "closure"))
    return read_stored(rounds)


def _doubled(pairs: DataFrame, min_hub_edges: int) -> DataFrame:
    """The closure of distinct ``pairs(src, dst)`` from all nodes, in as many rounds as the longest distance has binary digits.

    When all pairs up to a distance are known, a farther one up to twice that has a node on its shortest path exactly so far from
    its start. So only the pairs of just that distance are joined with the known ones, and a chain's pair is found once.
    """
    rounds = [materialize(pairs.select("src", "dst", F.lit(1).alias("hops")), "closure")]
    known = 1
    while rounds[-1].rows:
        frontier = rounds[-1].df.where(F.col("hops") == known).select("src", F.col("dst").alias("at"))
        everything = read_stored(rounds)
        total, hubs_found = sum(r.rows for r in rounds), None
        if total > min_hub_edges:
            hubs_found = materialize(hubs(everything, min_hub_edges), "hubs")
        ahead = everything.select(F.col("src").alias("at"), F.col("dst").alias("next"), F.col("hops").alias("more"))
        keys = ["at"]
        if hubs_found is not None and hubs_found.rows:
            fans = F.broadcast(hubs_found.df.withColumnRenamed("src", "at"))
            fan = F.coalesce("fan", F.lit(1))
            ahead = ahead.join(fans, "at", "left").withColumn("salt", F.pmod(F.xxhash64("next"), fan).cast("int")).drop("fan")
            frontier = frontier.join(fans, "at", "left").select("src", "at", F.explode(F.sequence(F.lit(0), fan - 1)).alias("salt"))
            keys = ["at", "salt"]
        met = frontier.join(ahead, keys).groupBy("src", F.col("next").alias("dst")).agg(F.min("more").alias("more"))
        fresh = met.join(everything.select("src", "dst"), ["src", "dst"], "left_anti")
        rounds.append(materialize(fresh.select("src", "dst", (F.col("more") + known).cast("int").alias("hops")), "closure"))
        known *= 2
    return read_stored(rounds)


def dependency_facts(
    edges: DataFrame, vertices: DataFrame, reach: DataFrame | None = None, page_size: int | None = None
) -> DataFrame:
    """Per vertex: direct and transitive dependencies and dependents, lists and counts.

    Counts and lists are whole for every node. With a ``page_size``, a longer list is null here
    and whole in ``relation_pages``.
    """
    pairs = oriented(edges, "out").distinct()
    reach = (closure(pairs) if reach is None else reach).select("src", "dst")
    result = vertices.select("node_id").distinct()
    for name, total, source in [("dependency", "dependencies", "out"), ("dependent", "dependents", "in")]:
        for prefix, count, table in [
            ("direct", f"{name}_count", pairs),
            ("all", f"total_{name}_count", reach),
        ]:
            turned = (table if source == "out" else flip(table)).select(F.col("src").alias("node_id"), "dst")
            counts = turned.groupBy("node_id").agg(F.count(F.lit(1)).alias(count))
            pages = list_pages(turned, "node_id", "dst", page_size or PAGE_SIZE)
            lists = (single_lists if page_size else whole_lists)(pages, "node_id", f"{prefix}_{total}")
            result = result.join(counts, "node_id", "left").join(lists, "node_id", "left")
    counts = ["dependency_count", "dependent_count", "total_dependency_count", "total_dependent_count"]
    lists = ["direct_dependencies", "direct_dependents", "all_dependencies", "all_dependents"]
    return result.select("node_id", *lists, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def fact_counts(edges: DataFrame, vertices: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """The four counts alone, in one aggregation over tagged pairs."""
    pairs = oriented(edges, "out").distinct()
    reach = (closure(pairs) if reach is None else reach).select("src", "dst")
    tagged = (
        pairs.select(F.col("src").alias("node_id"), F.lit(0).alias("tag"))
        .unionByName(pairs.select(F.col("dst").alias("node_id"), F.lit(1).alias("tag")))
        .unionByName(reach.select(F.col("src").alias("node_id"), F.lit(2).alias("tag")))
        .unionByName(reach.select(F.col("dst").alias("node_id"), F.lit(3).alias("tag")))
    )
    names = ["dependency_count", "dependent_count", "total_dependency_count", "total_dependent_count"]
    counts = tagged.groupBy("node_id").agg(*[F.count_if(F.col("tag") == i).alias(n) for i, n in enumerate(names)])
    return (
        vertices.select("node_id")
        .distinct()
        .join(counts, "node_id", "left")
        .select("node_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    )


def relation_pages(edges: DataFrame, reach: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """``(node_id, relation, page, pages, items)``: all four lists of every node, in pages."""
    pairs, reach = oriented(edges, "out").distinct(), reach.select("src", "dst")
    parts = []
    for relation, table in [
        ("direct_dependencies", pairs),
        ("direct_dependents", flip(pairs)),
        ("all_dependencies", reach),
        ("all_dependents", flip(reach)),
    ]:
        pages = list_pages(table.select(F.col("src").alias("node_id"), "dst"), "node_id", "dst", page_size)
        parts.append(pages.withColumn("relation", F.lit(relation)))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def with_flags(facts: DataFrame) -> DataFrame:
    return facts.withColumns(
        {"has_dependencies": F.col("dependency_count") > 0, "has_dependents": F.col("dependent_count") > 0}
    )


def degrees(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(node_id, out_degree, in_degree)``; parallel edges count by ``weight`` where there is one."""
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    both = F.array(
        F.struct(F.col("src").alias("node_id"), weight.alias("o"), zero.alias("i")),
        F.struct(F.col("dst").alias("node_id"), zero.alias("o"), weight.alias("i")),
    )
    ends = edges.where(F.col("src") != F.col("dst")).select(F.explode(both).alias("e")).select("e.*")
    sums = ends.groupBy("node_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return (
        vertices.select("node_id")
        .distinct()
        .join(sums, "node_id", "left")
        .select("node_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ["out_degree", "in_degree"]])
    )


def leaderboard(degree_table: DataFrame, column: str, n: int = LEADERBOARD) -> DataFrame:
    return degree_table.orderBy(F.desc(column), "node_id").limit(n)


def degree_summary(degree_table: DataFrame) -> DataFrame:
    """One row: nodes, edges, averages, maxima and the nodes without any."""
    nodes, links = F.count(F.lit(1)), F.coalesce(F.sum("out_degree"), F.lit(0))
    average = F.when(nodes > 0, links / nodes).otherwise(F.lit(0.0))
    return degree_table.agg(
        nodes.alias("total_packages"),
        links.alias("total_dependencies"),
        average.alias("average_dependencies_per_package"),
        average.alias("average_dependents_per_package"),
        F.coalesce(F.max("out_degree"), F.lit(0)).alias("max_dependencies"),
        F.coalesce(F.max("in_degree"), F.lit(0)).alias("max_dependents"),
        F.count_if(F.col("out_degree") == 0).alias("packages_with_no_dependencies"),
        F.count_if(F.col("in_degree") == 0).alias("packages_with_no_dependents"),
    )


def shortest_path(edges: DataFrame, vertices: DataFrame, source: str, target: str) -> DataFrame:
    """``(position, node_id)`` of the shortest path, the smallest by node ids among equals.

    The same node is its own path; an unknown or unreachable node gives no row.
    """
    spark = edges.sparkSession
    asked = vertices.where(F.col("node_id").isin([source, target])).select("node_id").distinct()
    known = {r["node_id"] for r in asked.collect()}  # two rows at most
    empty = spark.createDataFrame([], "position int, node_id string")
    if not {source, target} <= known:
        return empty
    if source == target:
        return asked.select(F.lit(0).alias("position"), "node_id")
    start = asked.where(F.col("node_id") == source).select(
        F.lit(0).alias("walk"), F.col("node_id").alias("at"), F.array("node_id").alias("path")
    )
    goal = asked.where(F.col("node_id") == target).select(F.lit(0).alias("walk"), F.col("node_id").alias("goal"))
    found = walks(edges, start, goal)
    return found.select(F.posexplode("path").alias("position", "node_id"))


def walks(edges: DataFrame, starts: DataFrame, goals: DataFrame) -> DataFrame:
    """``(walk, path)``: for every ``starts(walk, at, path)`` the shortest path to ``goals(walk, goal)``.

    All walks advance together, one edge per round. Per walk and node only the smallest path
    is kept (a minimum with map-side combine), and a walk stops when it has its goal.
    A start node is not marked as visited, so a goal equal to the start finds a cycle.
    """
    follow = FollowEdges(oriented(edges, "out").distinct())
    rounds: list[Stored] = []
    frontier, hits = starts, []
    while True:
        step = follow.step(frontier.withColumnRenamed("path", "so_far"))
        extended = step.select(
            "walk", F.col("next").alias("at"), F.concat("so_far", F.array("next")).alias("path")
        )
        best = extended.groupBy("walk", "at").agg(F.min("path").alias("path"))
        if rounds:
            best = best.join(read_stored(rounds).select("walk", "at"), ["walk", "at"], "left_anti")
        rounds.append(materialize(best, "walks"))
        arrived = rounds[-1].df.join(goals.withColumnRenamed("goal", "at"), ["walk", "at"]).select("walk", "path")
        hits.append(materialize(arrived, "arrived"))
        if not rounds[-1].rows:
            return read_stored(hits)
        frontier = rounds[-1].df
        if hits[-1].rows:
            frontier = frontier.join(read_stored(hits).select("walk"), "walk", "left_anti")


def node_metadata(vertices: DataFrame, ids: DataFrame) -> DataFrame:
    """The metadata of the asked ``ids(node_id)``; unknown ids give no row."""
    return vertices.join(ids.select("node_id").distinct(), "node_id", "left_semi")


def ego_graph(edges: DataFrame, vertices: DataFrame, node: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and typed links around one node: itself, its dependencies, its dependents."""
    main = vertices.where(F.col("node_id") == node).select("node_id", F.lit("main").alias("role"))
    links = ego_links(edges, node)
    others = links.select(
        F.when(F.col("type") == "dependency", F.col("target")).otherwise(F.col("source")).alias("node_id"),
        F.col("type").alias("role"),
    )
    return first_role(main.unionByName(others)).withColumn("expanded", F.lit(False)), links


def ego_links(edges: DataFrame, node: str) -> DataFrame:
    pairs = edges.where(F.col("src") != F.col("dst"))
    out = pairs.where(F.col("src") == node).select(
        F.col("src").alias("source"), F.col("dst").alias("target"), F.lit("dependency").alias("type")
    )
    into = pairs.where(F.col("dst") == node).select(
        F.col("src").alias("source"), F.col("dst").alias("target"), F.lit("dependent").alias("type")
    )
    return out.unionByName(into).distinct()


def first_role(nodes: DataFrame) -> DataFrame:
    """One row per node: main before dependency before dependent."""
    rank = F.when(F.col("role") == "main", 0).when(F.col("role") == "dependency", 1).otherwise(2)
    return nodes.groupBy("node_id").agg(F.min_by("role", rank).alias("role"))


def expand(
    nodes: DataFrame, links: DataFrame, edges: DataFrame, vertices: DataFrame, node: str
) -> tuple[DataFrame, DataFrame]:
    """An ego graph with one of its nodes opened; what it holds already keeps its role and type.

    An unknown node leaves the graph as it is.
    """
    more_nodes, more_links = ego_graph(edges, vertices, node)
    known = vertices.where(F.col("node_id") == node).select("node_id")
    fresh_nodes = more_nodes.where(F.col("role") != "main").join(nodes.select("node_id"), "node_id", "left_anti")
    fresh_links = more_links.join(links.select("source", "target"), ["source", "target"], "left_anti")
    opened = nodes.join(known.withColumn("opened", F.lit(True)), "node_id", "left").select(
        "node_id", "role", (F.col("expanded") | F.coalesce("opened", F.lit(False))).alias("expanded")
    )
    return opened.unionByName(fresh_nodes), links.unionByName(fresh_links.select(*links.columns))
