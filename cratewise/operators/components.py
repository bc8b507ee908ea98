"""Connected components and cycles of the dependency graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratewise.operators.graph import closure, degree_summary, degrees, flip, oriented, walks
from cratewise.operators.skew import HOT_ROWS, hot_keys, join_lookup
from cratewise.session import Stored, materialize, read_stored

# Peeling steps per stored round: fewer writes, and a plan that stays small.
PEEL_STEPS = 3


def wcc(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(node_id, component)``: weakly connected components, named by their smallest node.

    Alternates large-star and small-star (Kiveris et al., 2014) until the star edges stop
    changing. Minima are aggregated before the shuffle and joined back by key, so a hub's
    neighbours are never gathered.
    """
    pairs = oriented(edges, "out").select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")
    )
    state = materialize(pairs.distinct(), "wcc")
    while True:
        large = materialize(_large_star(state), "wcc")
        small = materialize(_small_star(large), "wcc")
        large.drop()
        before, state = state, small
        same = (before.rows, before.checksum) == (small.rows, small.checksum)
        before.drop()
        if same:
            break
    stars = state.df.select(F.col("src").alias("node_id"), F.col("dst").alias("component"))
    return (
        vertices.select("node_id")
        .distinct()
        .join(stars, "node_id", "left")
        .select("node_id", F.coalesce("component", "node_id").alias("component"))
    )


def _large_star(edges: Stored) -> DataFrame:
    """Every neighbour above a node is linked to the node's smallest neighbour (or itself)."""
    both = edges.df.unionByName(flip(edges.df))
    hot = None
    if 2 * edges.rows > HOT_ROWS:
        stored = materialize(both, "star")
        both, hot = stored.df, hot_keys(stored, "src")
    lowest = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
    joined = join_lookup(both, lowest, "src", hot)
    linked = joined.where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return linked.where(F.col("src") != F.col("dst")).distinct()


def _small_star(edges: Stored) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest of them."""
    lowest = edges.df.groupBy("src").agg(F.min("dst").alias("low"))
    joined = join_lookup(edges.df, lowest, "src", hot_keys(edges, "src"))
    linked = joined.select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionByName(
        lowest.select("src", F.col("low").alias("dst"))
    )
    return linked.where(F.col("src") != F.col("dst")).distinct()


def scc(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(node_id, component)``: strongly connected components, named by their smallest node.

    Peels nodes that cannot lie on a cycle, then colours the rest with many pivots at once: every node
    takes the pivot of least rank that reaches it, and among the nodes of its colour the one of least rank
    that it reaches. Where both are the same node, it and the pivot form a component. Two nodes of a
    component have the same pair of colours, so edges between different pairs are cut. Ranks are drawn anew
    each round, so a chain of components falls apart into pieces and takes logarithmically many rounds.
    """
    core = _peel(materialize(oriented(edges, "out").distinct(), "core"))
    parts: list[Stored] = []
    turn = 0
    while core.rows:
        members, rest = _split_by_colours(core, turn)
        parts.append(members)
        core.drop()
        core = _peel(rest)
        turn += 1
    nodes = vertices.select("node_id").distinct()
    if not parts:
        return nodes.withColumn("component", F.col("node_id"))
    settled = read_stored(parts)
    # a pivot is any node of its component; the component is named by its smallest one
    names = settled.groupBy("pivot").agg(F.min("node_id").alias("component"))
    named = settled.join(names, "pivot").select("node_id", "component")
    return nodes.join(named, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def _peel(edges: Stored) -> Stored:
    """Drop edges whose start has no way in or whose end has no way out, until none is left."""
    while edges.rows:
        kept = edges.df
        for _ in range(PEEL_STEPS):
            has_in = kept.select(F.col("dst").alias("src")).distinct()
            has_out = kept.select(F.col("src").alias("dst")).distinct()
            kept = kept.join(has_in, "src", "left_semi").join(has_out, "dst", "left_semi").select("src", "dst")
        peeled = materialize(kept, "core")
        same = peeled.rows == edges.rows
        edges.drop()
        edges = peeled
        if same:
            break
    return edges


def _colour(edges: Stored, turn: int) -> Stored:
    """``(node_id, colour)``: the node of least rank that reaches each node of the core, as ``(rank, id)``."""
    nodes = edges.df.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    rank = F.xxhash64(F.lit(turn), F.col("node_id"))
    state = materialize(nodes.withColumn("colour", F.struct(rank.alias("rank"), F.col("node_id").alias("id"))), "colour")
    hot_src = hot_keys(edges, "src")
    while True:
        colours = state.df
        offered = join_lookup(edges.df, colours.withColumnRenamed("node_id", "src"), "src", hot_src)
        lowest = offered.groupBy(F.col("dst").alias("node_id")).agg(F.min("colour").alias("offer"))
        taken = colours.join(lowest, "node_id", "left").select(
            "node_id", F.least("colour", F.coalesce("offer", "colour")).alias("colour")
        )
        # The node a colour names is itself reached by its own colour: jump there at once.
        named = colours.select(F.col("node_id").alias("id"), F.col("colour").alias("further"))
        asked, hot = taken.select("node_id", "colour", F.col("colour.id").alias("id")), None
        if state.rows > HOT_ROWS:  # a colour may have most of the nodes
            stored = materialize(asked, "taken")
            asked, hot = stored.df, hot_keys(stored, "id")
        met = join_lookup(asked, named, "id", hot)
        fresh = materialize(met.select("node_id", F.least("colour", "further").alias("colour")), "colour")
        same = fresh.checksum == state.checksum
        state.drop()
        state = fresh
        if same:
            return state


def _within(edges: Stored, colours: DataFrame) -> Stored:
    """The edges whose two ends have the same colour."""
    of_src = colours.select(F.col("node_id").alias("src"), F.col("colour.id").alias("src_colour"))
    of_dst = colours.select(F.col("node_id").alias("dst"), F.col("colour.id").alias("dst_colour"))
    tinted = join_lookup(edges.df, of_src, "src", hot_keys(edges, "src"))
    both = join_lookup(tinted, of_dst, "dst", hot_keys(edges, "dst"))
    return materialize(both.where(F.col("src_colour") == F.col("dst_colour")).select("src", "dst"), "inner")


def _split_by_colours(edges: Stored, turn: int) -> tuple[Stored, Stored]:
    """``(node_id, pivot)`` of the components settled by one round, and the edges that may lie on a cycle outside them."""
    forward = _colour(edges, turn)
    inner = _within(edges, forward.df)
    # Inside a colour its pivot has the least rank, so a node reaches it exactly when the least that it can reach is that one:
    # the same colouring against the edges.
    backward = _colour(materialize(flip(inner.df), "inner"), turn)
    both = forward.df.join(backward.df.withColumnRenamed("colour", "reached"), "node_id", "left").select(
        "node_id", F.col("colour.id").alias("pivot"), F.coalesce("reached", F.struct(F.lit(0).cast("bigint").alias("rank"), F.col("node_id").alias("id"))).alias("colour")
    )
    pairs = materialize(both, "pairs")
    members = materialize(pairs.df.where(F.col("colour.id") == F.col("pivot")).select("node_id", "pivot"), "members")
    open_ends = materialize(pairs.df.where(F.col("colour.id") != F.col("pivot")), "open").df
    # an edge inside one pair of colours has both ends settled or none
    rest = _within(inner, open_ends)
    for stored in (forward, backward, inner, pairs):
        stored.drop()
    return members, rest


def cycle_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """``(src, dst, component)`` of the edges inside one strongly connected component."""
    of_src = components.select(F.col("node_id").alias("src"), "component")
    of_dst = components.select(F.col("node_id").alias("dst"), F.col("component").alias("other"))
    return (
        oriented(edges, "out")
        .distinct()
        .join(of_src, "src")
        .join(of_dst, "dst")
        .where(F.col("component") == F.col("other"))
        .select("src", "dst", "component")
    )


def component_reach(edges: DataFrame, components: DataFrame) -> DataFrame:
    """``(component, reached)``: the strong components that the nodes of each component reach.

    The closure runs on the graph of components; a component of several nodes reaches itself.
    Together with ``components`` this is the whole closure, without a row per pair of nodes.
    """
    of_src = components.select(F.col("node_id").alias("src"), F.col("component").alias("from"))
    of_dst = components.select(F.col("node_id").alias("dst"), F.col("component").alias("to"))
    between = oriented(edges, "out").join(of_src, "src").join(of_dst, "dst").where(F.col("from") != F.col("to"))
    far = closure(between.select(F.col("from").alias("src"), F.col("to").alias("dst")).distinct())
    several = components.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return far.select(F.col("src").alias("component"), F.col("dst").alias("reached")).unionByName(
        several.select("component", F.col("component").alias("reached"))
    )


def condensed_counts(edges: DataFrame, vertices: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """The four counts of every node, as in ``graph.fact_counts``; the totals are sums of component sizes."""
    components = scc(edges, vertices) if components is None else components
    components = materialize(components, "scc").df
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    reach = materialize(component_reach(edges, components), "reach").df

    def total(own: str, other: str, name: str) -> DataFrame:
        sized = reach.join(sizes.withColumnRenamed("component", other), other)
        return sized.groupBy(F.col(own).alias("component")).agg(F.sum("size").alias(name))

    direct = degrees(oriented(edges, "out").distinct(), vertices).select(
        "node_id", F.col("out_degree").alias("dependency_count"), F.col("in_degree").alias("dependent_count")
    )
    names = ["dependency_count", "dependent_count", "total_dependency_count", "total_dependent_count"]
    return (
        direct.join(components, "node_id")
        .join(total("component", "reached", names[2]), "component", "left")
        .join(total("reached", "component", names[3]), "component", "left")
        .select("node_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    )


def cycles(edges: DataFrame, components: DataFrame, limit: int | None = None) -> DataFrame:
    """``(component, cycle)``: one shortest cycle through the smallest node of each component.

    The list is closed, first node repeated at its end. The first ``limit`` components are
    reported, all of them without a limit.
    """
    inner = materialize(cycle_edges(edges, components), "inner").df
    names = inner.select("component").distinct()
    if limit is not None:
        names = names.orderBy("component").limit(limit)
    names = materialize(names, "cycles").df
    starts = names.select(
        F.col("component").alias("walk"), F.col("component").alias("at"), F.array("component").alias("path")
    )
    goals = names.select(F.col("component").alias("walk"), F.col("component").alias("goal"))
    inside = inner.join(names, "component", "left_semi").select("src", "dst")
    return walks(inside, starts, goals).select(F.col("walk").alias("component"), F.col("path").alias("cycle"))


def edge_cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """``(component, cycle)``: a shortest cycle through every edge that lies on one, each cycle once.

    For each edge inside a component the shortest way back from its end to its start, the smallest by ids among
    equals; all edges walk together. A cycle is written closed, from its smallest node.
    """
    inner = materialize(cycle_edges(edges, components).withColumn("walk", F.concat_ws("\x01", "src", "dst")), "inner").df
    starts = inner.select("walk", F.col("dst").alias("at"), F.array("dst").alias("path"))
    goals = inner.select("walk", F.col("src").alias("goal"))
    back = walks(inner.select("src", "dst"), starts, goals)
    # the way back ends at the edge's start; from the smallest node on, and closed
    least = F.array_position("path", F.array_min("path")).cast("int")
    turned = F.concat(F.slice("path", least, F.size("path")), F.slice("path", F.lit(1), least))
    found = back.join(inner.select("walk", "component"), "walk").select("component", turned.alias("cycle"))
    return found.distinct()


def graph_summary(edges: DataFrame, vertices: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """The statistics row: degrees, and how many components of either kind there are.

    ``components`` are the strongly connected ones, if known already.
    """
    components = scc(edges, vertices) if components is None else components
    strong = components.where(F.col("node_id") == F.col("component")).count()
    weak = wcc(edges, vertices).where(F.col("node_id") == F.col("component")).count()
    return degree_summary(degrees(edges, vertices)).withColumns(
        {
            "strongly_connected_components": F.lit(strong).cast("bigint"),
            "weakly_connected_components": F.lit(weak).cast("bigint"),
        }
    )
