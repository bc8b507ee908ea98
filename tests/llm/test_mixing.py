import random
import re
from collections import Counter, defaultdict

import pytest

from cratewise.llm.mixing import mix, mix_sizes


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        for s in over or open_:
            target[s] = 2.0 * sizes[s] if over else left * weight[s] / total
        if not over:
            break
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


def rows():
    rng = random.Random(3)
    out = []
    for i in range(900):
        source = rng.choice(["a", "a", "a", "a", "b", "Z", "é", None, "tiny", "\U0001f642", "ﬀ"])
        if source == "tiny" and i > 60:
            source = "a"
        out.append((i, rng.choice(["w \t x y\n", "one "]) * rng.choice([0, 1, 5, 40, 200]), "en", source))
    return [*out, (5000, None, "en", "a"), (5001, "", "en", "empty"), (3, "again and again", "en", "b"), (3, "again and again", "en", "b"), (None, "no id", "en", "b")]


def test_targets_and_shares(documents):
    data = rows()
    got = [r.asDict() for r in mix_sizes(documents(data).repartition(4)).collect()]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d[0], size(d[1])) for d in data)
    sizes = defaultdict(int)
    for d in data:
        sizes[d[3]] += size(d[1])
    want = brute_targets(sizes)
    source = {(d[0], size(d[1])): d[3] for d in data}
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= max(200, 0.02 * want[s]) for s in sizes)
    again = [r.asDict() for r in mix_sizes(documents(data).repartition(7)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_rows_are_emitted_as_often_as_taken(documents):
    data = rows()
    docs = documents(data)
    out = mix(docs)
    assert out.columns == docs.columns
    want = Counter()
    for r in mix_sizes(docs).collect():
        want[r["doc_id"], r["size"]] += r["copies"]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], size(r["text"])) for r in out.collect()) == +want


def test_empty_tables(documents):
    assert mix_sizes(documents([])).collect() == []
    assert sorted(tuple(r)[:5] for r in mix_sizes(documents([(1, None), (2, " ")])).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
