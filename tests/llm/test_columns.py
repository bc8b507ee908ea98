import pytest
from pyspark.sql import functions as F

from cratewise.llm.columns import spare
from cratewise.llm.decontaminate import uncontaminated
from cratewise.llm.jaccard import one_of_each
from cratewise.llm.mil import accepted
from cratewise.llm.mixing import mix
from cratewise.llm.pii import sanitised

CLASHES = ["_uid", "_UID_", "_one", "_nth", "_copy", "_all", "_rows", "_score", "_spans", "uid", "spans", "score", "quality", "size", "copies", "component"]


def test_spare_names(spark):
    df = spark.createDataFrame([], "_uid int, _UID_ int, x int")
    assert spare(df, "_uid", "_uid", "y") == ["_uid__", "_uid___", "y"]


@pytest.mark.parametrize("stage", ["quality", "near", "decontaminate", "mix", "pii"])
def test_columns_with_the_operators_own_names_come_back_as_they_were(spark, documents, stage):
    words = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, words), (2, words), (3, "mail me at jo@example.org please"), (4, None), (None, "no id " * 9), (5, "")]
    plain = documents(rows)
    names = [c for c in CLASHES if c.lower() not in {x.lower() for x in plain.columns}]
    names = [c for c in names if c != "_UID_"]
    clashing = plain.withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in names})
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 6)], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([(1, words)], "item_id bigint, text string")
    run = {
        "quality": lambda d: accepted(d, labels),
        "near": one_of_each,
        "decontaminate": lambda d: uncontaminated(d, items),
        "mix": mix,
        "pii": sanitised,
    }[stage]
    found, without = run(clashing), run(plain)
    assert found.columns == clashing.columns
    got = found.collect()
    assert all(r[c] == f"{c}-{'none' if r.doc_id is None else r.doc_id}" for r in got for c in names)
    key = lambda r: (str(r.doc_id), str(r.text))
    assert sorted(map(key, got)) == sorted(map(key, without.collect()))
