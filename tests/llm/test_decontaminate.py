import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cratewise.llm.decontaminate import decontaminate, uncontaminated
from cratewise.llm.decontaminate import words as tokens


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items):
    windows = []
    for item_id, text in items:
        ws = words(text)
        w = min(10, len(ws))
        windows += [(item_id, tuple(ws[i : i + w])) for i in range(len(ws) - w + 1) if w]
    out = []
    for doc_id, text in rows:
        ws, hit, found = words(text), set(), set()
        for item_id, win in windows:
            for i in range(len(ws) - len(win) + 1):
                if tuple(ws[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found.add(item_id)
        named = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(ws), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def tables():
    rng = random.Random(4)
    vocabulary = ["the", "The", "of", "Éan", "éan", "x1"] + [f"w{i}" for i in range(60)]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 25, 40]))) for i in range(30)] + [(30, None), (31, ""), (32, "..."), (3, text(20)), (None, text(14)), (10, "the the the the the the the the the the the")]
    rows = []
    for i in range(120):
        parts = [text(rng.randrange(0, 30))]
        for _ in range(rng.choice([0, 0, 1, 2, 30])):
            ws = words(rng.choice(items)[1])
            a = rng.randrange(0, max(1, len(ws) - 8))
            parts += [" ".join(ws[a : a + rng.choice([4, 9, 10, 15, 40])]).upper(), text(rng.randrange(0, 6))]
        rows.append((i, " ".join(parts)))
    rows += [(500, None), (501, ""), (502, "!?"), (7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (503, "the " * 40_000)]
    return rows, items


@pytest.mark.parametrize("bits,broadcast_rows", [(1 << 20, 100_000), (64, 0)])
def test_against_brute_force(spark, documents, bits, broadcast_rows):
    rows, items = tables()
    frame = spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, text string, n_words int")
    got = decontaminate(documents(rows).repartition(3), frame, bits, broadcast_rows).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, items)
    kept = sorted(map(repr, (r["doc_id"] for r in uncontaminated(documents(rows), frame).collect())))
    assert kept == sorted(repr(r[0]) for r in brute(rows, items) if not r[5])


def test_empty_tables(spark, documents):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate(documents([]), items).collect() == []
    assert [tuple(r)[:4] for r in decontaminate(documents([(1, "a b")]), items).collect()] == [(1, 2, 0, 0)]


def test_texts_are_read_once(spark, documents, tmp_path):
    rows, items = tables()
    documents(rows).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    found = decontaminate(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    assert not set(found.inputFiles()) & set(docs.inputFiles())


def test_words_are_split_not_matched(spark):
    texts = [None, "", " ", "a", " a", "a ", "..A-b\x00c\n", "É1 x\U0001f600y\u00a0z", "a\u2028b"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select("text", tokens(F.col("text")).alias("words"))
    assert [r["words"] for r in frame.collect()] == [words(t) for t in texts]
    assert "regexp_extract_all" not in frame._jdf.queryExecution().analyzed().toString()
