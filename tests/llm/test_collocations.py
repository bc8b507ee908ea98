import random
import re
from collections import Counter

import numpy as np
import pytest

from cratewise.llm.collocations import Chunk, Filter, collocations, phrase_counts


def brute(rows, least, top):
    totals, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for m in range(1, 6):
                f.update((lang or "und", tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    frequent = {k: v for k, v in f.items() if v >= least}
    dropped = set()
    for (lang, p), a in frequent.items():
        for b in range(len(p)):
            for e in range(b + 2, len(p) + 1):
                if e - b < len(p) and a >= f[lang, p[b:e]]:
                    dropped.add((lang, p[b:e]))
    out = []
    for (lang, p), a in frequent.items():
        if len(p) > 1 and (lang, p) not in dropped:
            cuts = [(1000 * a * totals[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], totals[lang], score))
    ranked = []
    for lang in sorted({r[0] for r in out}):
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(own)]
    return ranked


def corpus(n=160):
    rng = random.Random(11)
    vocabulary = ["the", "The", "of", "new york", "é", "a b", "x", "x x x", "state.", "in,", "two\nlines", "tab\tbed", "日本", "!", "\x0b", "\x01"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60)))
        text += " we the people of the united states do" * rng.randrange(0, 3)
        rows.append((i, text, rng.choice(["en", "en", "fr", None])))
    return [*rows, rows[0], rows[0], (998, None, "en"), (999, "", None), (1000, "long words " * 20_000, "de")]


@pytest.mark.parametrize(("budget", "bits"), [(400_000, 1 << 28), (200, 1 << 28), (40, 1 << 10)])
def test_equals_counting_every_phrase(spark, documents, budget, bits):
    rows = corpus()
    found = collocations(documents(rows).repartition(7), least=20, top=50, budget=budget, bits=bits)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, 20, 50)


def test_no_frequent_phrase_and_empty_table(spark, documents):
    assert collocations(documents([(1, "a b c"), (2, None)])).count() == 0
    assert collocations(documents([])).count() == 0


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, n, part = 3 * 10**12, 9 * 10**13, 4 * 10**12
    big = "CAST({} AS DECIMAL(19, 0))"
    score = f"(1000 * ({big.format(a)} * {big.format(n)})) div ({big.format(part)} * {big.format(part - 1)})"
    assert spark.range(1).select(F.expr(score).alias("s")).first().s == 1000 * a * n // (part * (part - 1))


def test_symbols_of_languages_differ_and_filters_lose_none(spark, documents):
    chunk = Chunk.of([b"Same same", b"same. same"], ["en", "fr"], 0)
    assert len(set(chunk.symbols.tolist())) == 2
    assert chunk.follows.tolist() == [True, False, False, False]
    some = np.arange(1, 500, dtype=np.int64) * 7919**3
    cells = np.zeros(16, np.uint64)
    for at in (some.view(np.uint64) & np.uint64(1023), (some.view(np.uint64) >> np.uint64(36)) & np.uint64(1023)):
        np.bitwise_or.at(cells, (at >> np.uint64(6)).astype(int), np.uint64(1) << (at & np.uint64(63)))
    assert Filter(cells.view(np.int64)).passes(some).all()
    words, phrases = phrase_counts(documents([(1, "a b a b a b")]), least=2)
    assert sorted((r.word, r.f, r.n) for r in words.collect()) == [("a", 3, 6), ("b", 3, 6)]
    assert sorted((len(r.p), r.a) for r in phrases.collect()) == [(2, 2), (2, 3), (3, 2), (3, 2), (4, 2)]
