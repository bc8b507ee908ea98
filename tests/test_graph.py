import random
from itertools import product

import pytest

from cratewise.operators import components as K
from cratewise.operators import graph as G
from cratewise.operators.sequence import list_pages, number_rows, running_totals
from cratewise.sources.documents import write_edge_list
from pyspark.sql import functions as F


def edges_of(spark, text):
    """``"ab bc"``: one edge per word."""
    return spark.createDataFrame([tuple(w) for w in text.split()], "src string, dst string")


def nodes_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node_id string")


def reachable(pairs):
    """Brute force: distance by (start, end)."""
    out, best = {}, {}
    for s, d in pairs:
        if s != d:
            out.setdefault(s, set()).add(d)
    for start in out:
        level, hops = out[start], 1
        while level:
            for n in level:
                best[start, n] = hops
            level = {m for n in level for m in out.get(n, ()) if (start, m) not in best}
            hops += 1
    return best


def rows(df):
    return {tuple(r) for r in df.collect()}


GRAPHS = {
    "chain": "ab bc",
    "diamond": "ab ac bd cd",
    "two": "ab ba",
    "three with a tail": "ab bc ca cd xa",
    "parallel and self": "ab ab aa bc",
}


@pytest.mark.parametrize("name", GRAPHS)
def test_closure(spark, name):
    edges = edges_of(spark, GRAPHS[name])
    want = {(s, d, h) for (s, d), h in reachable([tuple(w) for w in GRAPHS[name].split()]).items()}
    assert rows(G.closure(edges)) == want


@pytest.fixture(scope="module")
def random_graph(spark):
    rng = random.Random(5)
    names = [f"n{i:02d}" for i in range(40)]
    pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(55)} | {("n00", n) for n in names[1:30]})
    return spark.createDataFrame(pairs, "src string, dst string").cache(), nodes_of(spark, names).cache(), pairs, names


def test_closure_with_hubs_seeds_and_limits(spark, random_graph):
    edges, _, pairs, _ = random_graph
    best = reachable(pairs)
    assert rows(G.closure(edges, min_hub_edges=3)) == {(s, d, h) for (s, d), h in best.items()}
    seeds = nodes_of(spark, ["n00", "n07", "gone"])
    want = {(s, d, h) for (s, d), h in best.items() if s in ("n00", "n07") and h <= 2}
    assert rows(G.closure(edges, seeds, max_hops=2)) == want
    back = {(d, s) for (s, d) in best}
    assert {(r["src"], r["dst"]) for r in G.closure(edges, direction="in").collect()} == back


def test_closure_of_closure_is_closure(spark, random_graph):
    edges, _, _, _ = random_graph
    once = G.closure(edges).select("src", "dst").where("src <> dst")
    twice = G.closure(once).select("src", "dst").where("src <> dst")
    assert rows(once) == rows(twice)


def test_components_against_brute_force(spark, random_graph):
    edges, nodes, pairs, names = random_graph
    best = reachable(pairs)
    strong = {n: min([n, *(m for m in names if (n, m) in best and (m, n) in best)]) for n in names}
    assert dict(rows(K.scc(edges, nodes))) == strong
    both = reachable(pairs + [(d, s) for s, d in pairs])
    weak = {n: min([n, *(m for m in names if (n, m) in both)]) for n in names}
    assert dict(rows(K.wcc(edges, nodes))) == weak
    inner = {(s, d, strong[s]) for s, d in pairs if s != d and strong[s] == strong[d]}
    found = K.scc(edges, nodes)
    assert rows(K.cycle_edges(edges, found)) == inner
    for row in K.cycles(edges, found).collect():
        cycle = row["cycle"]
        assert cycle[0] == cycle[-1] == row["component"] == min(cycle)
        assert all((a, b) in set(pairs) for a, b in zip(cycle, cycle[1:]))
        assert len(cycle) == best[cycle[0], cycle[0]] + 1
    assert len(K.cycles(edges, found).collect()) == len({c for *_, c in inner})


def test_a_chain_of_components_falls_apart(spark, monkeypatch):
    """Rounds grow with the logarithm of a chain's length, whichever way its names run."""
    n, rounds, split = 40, [], K._split_by_colours
    monkeypatch.setattr(K, "_split_by_colours", lambda edges, turn: rounds.append(turn) or split(edges, turn))
    pairs = [p for i in range(n) for p in ((f"{i:04}a", f"{i:04}b"), (f"{i:04}b", f"{i:04}a"), (f"{i:04}b", f"{i + 1:04}a"))]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    nodes = spark.createDataFrame([(f"{i:04}{c}",) for i in range(n + 1) for c in "ab"], "node_id string")
    found = dict(rows(K.scc(edges, nodes)))
    assert found == {f"{i:04}{c}": f"{i:04}{'a' if i < n else c}" for i in range(n + 1) for c in "ab"}
    assert len(rounds) <= 6


def test_hot_keys_take_the_broadcast_way(spark, random_graph, monkeypatch):
    edges, nodes, pairs, names = random_graph
    want = rows(K.wcc(edges, nodes)), rows(K.scc(edges, nodes))
    original = K.hot_keys
    monkeypatch.setattr(K, "HOT_ROWS", 1)
    monkeypatch.setattr(K, "hot_keys", lambda stored, key: original(stored, key, min_rows=2))
    assert (rows(K.wcc(edges, nodes)), rows(K.scc(edges, nodes))) == want


def test_shortest_path(spark):
    edges, nodes = edges_of(spark, "ab ac bd cd de ea"), nodes_of(spark, "abcdez")

    def path(s, t):
        return [r["node_id"] for r in G.shortest_path(edges, nodes, s, t).orderBy("position").collect()]

    assert path("a", "e") == list("abde")
    assert path("a", "a") == ["a"]
    assert path("a", "z") == [] and path("a", "nobody") == []


def test_facts_and_pages(spark, random_graph):
    edges, nodes, pairs, names = random_graph
    best = reachable(pairs)
    facts = {r["node_id"]: r for r in G.dependency_facts(edges, nodes, page_size=5).collect()}
    counts = {r["node_id"]: r for r in G.fact_counts(edges, nodes).collect()}
    pages = {}
    for r in G.relation_pages(edges, G.closure(edges), page_size=5).collect():
        pages.setdefault((r["node_id"], r["relation"]), []).extend(r["items"])
    for n in names:
        every = sorted(d for s, d in best if s == n)
        assert facts[n]["total_dependency_count"] == counts[n]["total_dependency_count"] == len(every)
        assert facts[n]["all_dependencies"] == (every if 0 < len(every) <= 5 else None)
        assert sorted(pages.get((n, "all_dependencies"), [])) == every
        assert counts[n]["dependent_count"] == sum(1 for s, d in pairs if d == n and s != d)


def test_facts_hold_long_lists(spark, monkeypatch):
    monkeypatch.setattr(G, "PAGE_SIZE", 3)
    many = spark.createDataFrame([(f"n{i:02d}", "hub") for i in range(20)], "src string, dst string")
    nodes = nodes_of(spark, ["hub", *[f"n{i:02d}" for i in range(20)]])
    hub = G.dependency_facts(many, nodes).where("node_id = 'hub'").first()
    assert hub["direct_dependents"] == hub["all_dependents"] == [f"n{i:02d}" for i in range(20)]
    assert hub["dependent_count"] == hub["total_dependent_count"] == 20 and hub["direct_dependencies"] is None


def test_condensed_counts(spark, random_graph):
    """Counts from component sizes are those of the closure of pairs."""
    edges, nodes, _, _ = random_graph
    names = ["node_id", "dependency_count", "dependent_count", "total_dependency_count", "total_dependent_count"]
    assert rows(K.condensed_counts(edges, nodes).select(names)) == rows(G.fact_counts(edges, nodes).select(names))
    small = edges_of(spark, "ab bc cb cd xd")
    got = rows(K.component_reach(small, K.scc(small, nodes_of(spark, "abcdxz"))))
    assert got == {("a", "b"), ("a", "d"), ("b", "b"), ("b", "d"), ("x", "d")}


def test_ego_graph_and_expansion(spark):
    edges, nodes = edges_of(spark, "ab ba ac cd ec"), nodes_of(spark, "abcde")
    ego, links = G.ego_graph(edges, nodes, "a")
    assert {(r["node_id"], r["role"]) for r in ego.collect()} == {("a", "main"), ("b", "dependency"), ("c", "dependency")}
    assert rows(links) == {("a", "b", "dependency"), ("b", "a", "dependent"), ("a", "c", "dependency")}
    more, more_links = G.expand(ego, links, edges, nodes, "c")
    assert rows(more) == {
        ("a", "main", False), ("b", "dependency", False), ("c", "dependency", True), ("d", "dependency", False), ("e", "dependent", False)
    }
    assert rows(more_links) == rows(links) | {("c", "d", "dependency"), ("e", "c", "dependent")}
    same, _ = G.expand(ego, links, edges, nodes, "nobody")
    assert rows(same) == rows(ego)


def test_degrees_and_boards(spark):
    edges = spark.createDataFrame([("a", "b", 2), ("a", "c", 1)], "src string, dst string, weight long")
    table = G.degrees(edges, nodes_of(spark, "abcd"))
    assert rows(table) == {("a", 3, 0), ("b", 0, 2), ("c", 0, 1), ("d", 0, 0)}
    assert [r["node_id"] for r in G.leaderboard(table, "in_degree", 3).collect()] == ["b", "c", "a"]
    assert G.degree_summary(table).first()["max_dependencies"] == 3
    assert G.degree_summary(table.limit(0)).first()["average_dependencies_per_package"] == 0


def test_edge_list(spark, tmp_path):
    write_edge_list(edges_of(spark, "ab bc"), str(tmp_path / "list"))
    assert rows(spark.read.text(str(tmp_path / "list"))) == {("# source target",), ("a b",), ("b c",)}


def test_numbers_totals_and_pages(spark):
    numbers = spark.range(1000).withColumn("k", F.format_string("%04d", F.col("id"))).repartition(7)
    assert {(int(r["k"]) + 1, r["n"]) for r in number_rows(numbers, ["k"], "n").collect()} == {(i, i) for i in range(1, 1001)}
    sums = running_totals(numbers, ["k"], {"s": F.col("id")}).collect()
    assert all(r["s"] == r["id"] * (r["id"] + 1) // 2 for r in sums)
    pairs = spark.createDataFrame([("hub", f"i{n}") for n in range(100)] + [("one", "i0")], "k string, v string")
    pages = list_pages(pairs, "k", "v", page_size=10).collect()
    assert sorted(i for r in pages if r["k"] == "hub" for i in r["items"]) == sorted(f"i{n}" for n in range(100))
    assert len([r for r in pages if r["k"] == "hub"]) > 5 and [r["items"] for r in pages if r["k"] == "one"] == [["i0"]]


def test_closure_of_a_chain_takes_few_rounds(spark, monkeypatch):
    """the distance doubles each round, so a chain of 150 edges takes nine."""
    seen, plain = [], G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, label="step": seen.append(label) or plain(df, label))
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(150)], "src string, dst string")
    found = G.closure(edges).groupBy("src").agg(F.max("hops").alias("far"), F.count("*").alias("n"))
    assert {(r["src"], r["far"], r["n"]) for r in found.collect()} == {(f"{i:03d}", 150 - i, 150 - i) for i in range(150)}
    assert seen.count("closure") <= 10
