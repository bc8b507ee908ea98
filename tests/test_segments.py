import random

from cratewise.operators import search as S
from cratewise.operators import segments as X


def test_changes_and_merges_equal_a_fresh_index(spark, tmp_path):
    rng = random.Random(2)
    words = ["red", "blue", "green", "grey", "pink"]
    state: dict[str, str] = {}
    path = str(tmp_path / "segments")
    schema = "id string, name string, description string"

    def built(rows):
        table = spark.createDataFrame([(i, "n", t) for i, t in rows.items()], schema)
        return S.build_index(table, "id", S.STORE_COLUMNS)

    state = {f"d{i}": " ".join(rng.choices(words, k=6)) for i in range(40)}
    X.create(built(state), path)
    sizes = []
    for step in range(4):
        added = {f"d{rng.randrange(60)}": " ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(6)}
        lost = [i for i in rng.sample(sorted(state), 5) if i not in added]
        X.change(built(added), path, spark.createDataFrame([(i,) for i in lost], "doc_id string"))
        state = {i: t for i, t in state.items() if i not in lost} | added
        if step == 2:
            sizes.append(X.merge(spark, path, factor=2))
    assert sizes[0] < 4 and len(X.segments(spark, path)) == sizes[0] + 1
    found, fresh = X.read(spark, path), built(state)
    for of in (lambda ix: S.term_stats(ix), lambda ix: ix.corpus, lambda ix: ix.docs, lambda ix: S.search(ix, "red blue", limit=100)):
        assert sorted(map(tuple, of(found).collect())) == sorted(map(tuple, of(fresh).collect()))
    X.change(built({}), path, spark.createDataFrame([(i,) for i in state], "doc_id string"))
    assert X.read(spark, path).docs.count() == 0
