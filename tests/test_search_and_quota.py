import math
import random
import re

import pytest
from pyspark.sql import functions as F

from cratewise.operators import quota as U
from cratewise.operators import search as S
from cratewise.operators import sequence

rng = random.Random(3)
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
DOCS = [
    (f"d{i:02d}", rng.choice(WORDS), " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 12))), i % 5 == 0, i % 7 == 0, "x" if i % 2 else "y")
    for i in range(60)
]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(DOCS, "id string, name string, description string, broken boolean, unfree boolean, category string")
    return S.build_index(docs, "id", S.STORE_COLUMNS, keep=["broken", "unfree", "category"])


def brute(units, keep=lambda d: True):
    """All hits of the units (tuples of words), best first."""
    columns = {d[0]: [re.findall(r"\w+", c) for c in d[:3]] for d in DOCS}
    length = {i: sum(map(len, cs)) for i, cs in columns.items()}
    average = sum(length.values()) / len(DOCS)

    def count(i, unit):
        return sum(tuple(c[p : p + len(unit)]) == unit for c in columns[i] for p in range(len(c)))

    score = dict.fromkeys(columns, 0.0)
    match = set(columns)
    for unit in units:
        f = {i: count(i, unit) for i in columns}
        n = sum(v > 0 for v in f.values())
        weight = math.log((len(DOCS) - n + 0.5) / (n + 0.5))
        weight = weight if weight > 0 else 1e-6
        for i in columns:
            score[i] += weight * f[i] * 2.2 / (f[i] + 1.2 * (0.25 + 0.75 * length[i] / average))
        match &= {i for i in columns if f[i]}
    hits = [d[0] for d in DOCS if d[0] in match and keep(d)]
    return sorted(((i, score[i]) for i in hits), key=lambda h: (-round(h[1], 9), h[0]))


def ranked(df):
    return [(r["doc_id"], r["score"]) for r in df.collect()]


def same(got, want):
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want])


FREE = {"include_broken": True, "include_unfree": True}


def test_ranking_and_phrases(index):
    same(ranked(S.search(index, "Alpha beta", limit=100, **FREE)), brute([("alpha",), ("beta",)]))
    same(ranked(S.search(index, '"alpha beta" gamma', limit=100, **FREE)), brute([("alpha", "beta"), ("gamma",)]))
    same(ranked(S.search(index, '"zeta zeta"', limit=100, **FREE)), brute([("zeta", "zeta")]))


def test_pages_join_up_to_the_ranking(index):
    whole = ranked(S.search(index, "eps", limit=-1, **FREE))
    pages = [h for o in range(0, 60, 7) for h in ranked(S.search(index, "eps", limit=7, offset=o, **FREE))]
    assert pages == whole and len(whole) > 14


def test_filters_keep_corpus_statistics(spark, index):
    want = brute([("gamma",)], lambda d: not d[3] and not d[4] and d[5] == "x")
    got = S.search(index, "gamma", limit=100, category="x")
    same(ranked(got), want)
    assert {r["total_count"] for r in got.collect()} == {len(want)}
    licenses = spark.createDataFrame([(d[0], "MIT") for d in DOCS[:20]], "doc_id string, short_name string")
    ours = S.search(index, "gamma", limit=100, license="mit", doc_licenses=licenses, **FREE)
    same(ranked(ours), brute([("gamma",)], lambda d: d in DOCS[:20]))
    with pytest.raises(ValueError):
        S.search(index, "gamma", license="mit")


def test_term_options(spark, index):
    query = S.make_query(spark, "alpha", any_of="beta zeta", none_of="delta")
    got = {i for i, _ in ranked(S.matches(index, query))}
    texts = {d[0]: {d[1], *d[2].split()} for d in DOCS}
    assert got == {i for i, t in texts.items() if "alpha" in t and t & {"beta", "zeta"} and "delta" not in t}
    by_prefix = {i for i, _ in ranked(S.matches(index, S.make_query(spark, prefix="ga")))}
    assert by_prefix == {i for i, t in texts.items() if "gamma" in t}
    by_name = {i for i, _ in ranked(S.matches(index, S.make_query(spark, in_columns={"name": "gamma"})))}
    assert by_name == {d[0] for d in DOCS if d[1] == "gamma"}
    by_id = {i for i, _ in ranked(S.matches(index, S.make_query(spark, "d03")))}
    assert by_id == {"d03"}


@pytest.mark.parametrize("q", ["", "   ", '""', "?!", "'; DROP TABLE x --"])
def test_odd_queries_do_not_fail(index, q):
    assert ranked(S.search(index, q)) == []


def test_written_index(spark, index, tmp_path):
    S.write_index(index, str(tmp_path / "index"))
    stored = S.read_index(spark, str(tmp_path / "index"))
    same(ranked(S.search(stored, '"alpha beta"', limit=9, **FREE)), ranked(S.search(index, '"alpha beta"', limit=9, **FREE)))
    plan = stored.postings.where(F.col("term").isin("alpha"))._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,alpha)]" in plan


REQUESTS = [
    (1, "alpha beta", 5, 0, None, None, True, True),
    (2, "alpha beta", 5, 3, None, None, True, True),
    (3, '"alpha beta" gamma', 50, 0, None, "x", False, True),
    (4, "", 5, 0, None, None, True, True),
    (5, "gamma", -1, -4, None, None, True, True),
    (6, "gamma", 0, 0, None, None, True, True),
    (7, "gamma", 50, 0, "mit", None, True, True),
]
SCHEMA = "request_id int, q string, limit int, offset int, license string, category string, include_broken boolean, include_unfree boolean"


@pytest.mark.parametrize("deep", [100_000, 4])
def test_batch_gives_what_single_searches_give(spark, index, monkeypatch, deep):
    monkeypatch.setattr(S, "DEEP", deep)
    licenses = spark.createDataFrame([(d[0], "MIT") for d in DOCS[:20]], "doc_id string, short_name string")
    got = {}
    for r in S.batch_search(index, spark.createDataFrame(REQUESTS, SCHEMA), licenses).orderBy("request_id", "rank").collect():
        got.setdefault(r["request_id"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] >= 1
    for number, q, limit, offset, lic, category, broken, unfree in REQUESTS:
        want = ranked(
            S.search(index, q, limit, offset, license=lic, category=category, include_broken=broken, include_unfree=unfree, doc_licenses=licenses)
        )
        same(got.get(number, []), want)


def test_rolling_usage_across_slices(spark):
    times = [0, 1, 59, 60, 61, 599, 600, 601, 659, 660, 1300]
    rows = [(i, "u", t, 10) for i, t in enumerate(times)] + [(99, "v", 60, 5)]
    table = spark.createDataFrame(rows, "id int, user string, t long, tokens int").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["id"]: r for r in U.rolling_usage(table, "user", "ts", F.col("tokens"), max_requests=2, max_tokens=30).collect()}
    for i, t in enumerate(times):
        n = sum(t - 60 < s <= t for s in times)
        assert (got[i]["requests_in_minute"], got[i]["tokens_in_minute"], got[i]["over_budget"]) == (n, 10 * n, n > 2)
    assert got[99]["requests_in_minute"] == 1


def test_banded_usage_equals_counting(spark, monkeypatch):
    """Ties, requests exactly a minute apart, users and times that are null; one user's requests lie in several ranges."""
    rng = random.Random(5)
    users = [None, "", "a", "b"]
    data = [(i, rng.choices(users, [1, 1, 20, 3])[0], rng.choice([None, *range(400)]), rng.choice([None, 0, 1, 7])) for i in range(1500)]
    data += [(2000, "c", 0, 5), (2001, "c", 60, 6), (2002, "c", 119, 7), (2003, "c", 119, 8)]
    table = spark.createDataFrame(data, "id bigint, user string, s bigint, t bigint").withColumn("ts", F.timestamp_seconds("s"))
    ranged, keep = [], sequence.materialize
    monkeypatch.setattr(sequence, "materialize", lambda df, label: ranged.append(keep(df, label)) or ranged[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["id"]: (r["requests_in_minute"], r["tokens_in_minute"], r["over_budget"]) for r in U.banded_usage(table, "user", "ts", F.col("t"), 30, 80).collect()}
        spread = ranged[0].df.where("user = 'a'").groupBy("_part").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for i, user, at, _ in data:
        if at is not None:
            last = [t or 0 for _, u, s, t in data if u == user and s is not None and at - 60 < s <= at]
            want[i] = (len(last), sum(last), len(last) > 30 or sum(last) > 80)
    assert got == want and len(spread) > 2
    empty = table.where("false")
    assert U.banded_usage(empty, "user", "ts", F.col("t")).count() == 0


def test_batch_slots_hold_the_budgets(spark):
    texts = spark.range(500).withColumn("tokens", (F.col("id") * 37) % 400)
    rows = U.batch_slots(texts, ["id"], F.col("tokens"), max_requests=20, max_tokens=3000).collect()
    slots = {}
    for r in sorted(rows, key=lambda r: r["id"]):
        slots.setdefault(r["slot"], []).append(r["tokens"])
    assert list(slots) == sorted(slots)
    for used in slots.values():
        assert len(used[1:]) / 20 + sum(used[1:]) / 3000 < 1


def test_pages_of_any_depth_equal_the_sorted_list(spark):
    import random

    rng = random.Random(4)
    rows = [(f"d{i:05d}", rng.choice([1.5, 2.25, 2.25, rng.random() * 9])) for i in range(3000)]
    hits = spark.createDataFrame(rows, "doc_id string, score double")
    ranked = sorted(rows, key=lambda r: (-r[1], r[0]))
    for limit, offset in [(10, 0), (-1, 0), (-1, 2990), (40, 700), (5000, 1500), (-1, 1400), (3, 3000), (0, 5), (7, -3)]:
        found = [tuple(r) for r in S.page(hits, limit, offset, top_list=30).collect()]
        begin = max(offset, 0)
        assert found == (ranked[begin:] if limit < 0 else ranked[begin : begin + limit]), (limit, offset)


def test_blocks_below_the_page_are_left_out(spark, tmp_path, monkeypatch):
    import random

    monkeypatch.setattr(S, "BLOCK_DOCS", 16)
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["red", "blue", "green", *[f"w{k}" for k in range(30)]], k=rng.choice([3, 9, 60, 300]))) for _ in range(600)]
    docs = spark.createDataFrame([(f"d{i}", "n", t, i % 9 == 0, False, "c") for i, t in enumerate(texts)], "id string, name string, description string, broken boolean, unfree boolean, category string")
    plain = S.build_index(docs, "id", S.STORE_COLUMNS, keep=["broken", "unfree", "category"])
    S.write_index(plain, str(tmp_path / "blocks"))
    index = S.read_index(spark, str(tmp_path / "blocks"))
    kept = index.blocks.agg({"n": "max"}).first()[0]
    assert kept <= 16
    for words, options in [("red", {}), ("red blue", {}), ("red", {"any_of": "blue green"}), ("red", {"none_of": "w3"}), ("nowhere red", {})]:
        for broken in (True, False):
            query = S.make_query(spark, words, **options)
            flags = {"include_broken": broken, "include_unfree": True, "query": query, "limit": 6, "offset": 2}
            skipped = [(r.doc_id, round(r.score, 9), r.total_count) for r in S.search(index, skip_from=0, **flags).collect()]
            whole = [(r.doc_id, round(r.score, 9), r.total_count) for r in S.search(plain, **flags).collect()]
            assert skipped == whole
    query = S.make_query(spark, "red")
    some = S.promising_blocks(index, query, None, S.dictionary(index, query), 8)
    assert 0 < some.count() < index.blocks.where("term = 'red'").count() / 2
    assert {r.term: (r.df, r.cf) for r in S.term_stats(index).collect()} == {r.term: (r.df, r.cf) for r in S.term_stats(plain).collect()}


def test_postings_are_made_in_the_row_of_their_text(index, monkeypatch):
    import pyarrow as pa

    plan = index.postings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    texts = [["b", "a", "b"], [], ["a"], ["c"] * 9, ["b", "c"]]
    ids = ["1", "2", None, "3", "1"]
    batch = pa.record_batch({"doc_id": pa.array(ids, pa.string()), "col": pa.array(list("xxxxy")), "tokens": pa.array(texts, pa.list_(pa.string()))})
    expected = [(t, i, c, [p for p, u in enumerate(text) if u == t]) for i, c, text in zip(ids, "xxxxy", texts, strict=True) for t in set(text)]
    for at_once in (1, 4, 1 << 18):
        monkeypatch.setattr(S, "TOKENS_AT_ONCE", at_once)
        found = [r for part in S._inverted([batch.slice(0, 0), batch.slice(0, 2), batch.slice(2)]) for r in part.to_pylist()]
        assert all(r["tf"] == len(r["positions"]) for r in found)
        assert sorted(((r["term"], r["doc_id"], r["col"], r["positions"]) for r in found), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("shallow", [500, 2])
def test_batch_scores_a_text_once_for_all_filters(spark, index, monkeypatch, shallow):
    monkeypatch.setattr(S, "SHALLOW", shallow)
    rows, keep = {}, S.materialize

    def counted(df, label):
        stored = keep(df, label)
        rows[label] = stored.rows
        return stored

    monkeypatch.setattr(S, "materialize", counted)
    filters = [(c, b, u) for c in (None, "x", "y") for b in (True, False) for u in (True, False)]
    requests = [(i, "alpha", 4, i % 3, None, c, b, u) for i, (c, b, u) in enumerate(filters)]
    got = {}
    for r in S.batch_search(index, spark.createDataFrame(requests, SCHEMA)).orderBy("request_id", "rank").collect():
        got.setdefault(r["request_id"], []).append((r["doc_id"], r["score"]))
    for number, q, limit, offset, _, category, broken, unfree in requests:
        same(got.get(number, []), ranked(S.search(index, q, limit, offset, category=category, include_broken=broken, include_unfree=unfree)))
    assert rows["scored"] == S.matches(index, S.make_query(spark, "alpha")).count()
