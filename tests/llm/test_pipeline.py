import random
from collections import Counter

import corpus_pipeline
from cratewise.llm.jaccard import one_of_each


def test_one_row_of_each_group_stays(documents):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(20)]
    rows = [(i * 10 + k, t + (" end" if k == 2 else "")) for i, t in enumerate(base) for k in range(3)]
    rows += [(5, base[0]), (0, base[0]), (0, base[0]), (None, base[1]), (700, None), (700, None), (701, ""), (702, "")]
    docs = documents(rows)
    out = one_of_each(docs)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == Counter([(i * 10, t) for i, t in enumerate(base)] + [(700, None), (700, None), (701, ""), (702, "")])


def test_stages_over_the_smallest_tables(spark, shared):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "token_ids"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns
        path = f"{shared}/stage-{name}"
        kept.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        rows = docs.collect()
        assert rows and all(before[r["doc_id"]] == r["text"] for r in rows)
        assert name == "mixing" or len({r["doc_id"] for r in rows}) == len(rows)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder).orderBy("start").collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in rows)
    assert [r["start"] for r in out] == [sum(x["n_tokens"] for x in out[:i]) for i in range(len(out))]
