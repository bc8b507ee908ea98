"""The classifiers and rules: held-out accuracy, brute-force counts, and odd rows."""

import random
import re

import numpy as np
import pytest

from cratewise.llm import language, mil, rules

WORDS = {
    "aa": ["lorem", "dol", "amet", "con", "tetur"],
    "bb": ["schön", "über", "weiß", "grün", "straß"],
    "cc": ["ñandú", "ción", "mañana", "está", "país"],
}


def made_texts(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", ".", ","]) for _ in range(rng.randrange(5, 120))), lang))
    return out


ODD = [(9000, None, None), (9001, "", "aa"), (9002, " 12 !? \n", "bb"), (9003, "long words here " * 20_000, None), (5, "twice", "aa"), (5, "twice", "aa"), (None, "no id at all", "cc")]


def test_language(documents):
    data = made_texts(400, 1)
    got = language.identify_languages(documents([*data, *ODD]).repartition(3)).collect()
    assert len(got) == len(data) + len(ODD)
    by_id = {r["doc_id"]: r for r in got}
    held = [d for d in data if by_id[d[0]]["held_out"]]
    assert 60 < len(held) < 140 and np.mean([by_id[d[0]]["lang_pred"] == d[2] for d in held]) > 0.98
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (9000, 9001, 9002))
    assert by_id[9003]["lang_pred"] in WORDS and all(0 <= r["score"] <= 1 for r in got)


def test_language_without_examples(documents):
    assert [r["lang_pred"] for r in language.identify_languages(documents([(1, "text", None)])).collect()] == ["und"]
    assert language.identify_languages(documents([])).collect() == []


def test_kernel_is_the_share_of_common_grams():
    def grams(t):
        t = f" {t} "
        return {t[i : i + n] for n in (1, 2, 3, 4) for i in range(len(t) - n + 1)}

    texts = ["the plain text", "plain texts there", "über alle", "THE, plain -- text!"]
    bits, lettered = language.presences([t.encode() for t in texts])
    assert lettered.all() and (bits[0] == bits[3]).all()
    for i in range(3):
        for j in range(3):
            assert abs(bits[i] @ bits[j] - len(grams(texts[i]) & grams(texts[j]))) <= 1


def test_rule_counts(documents):
    rng = random.Random(8)
    data = [(i, "".join(rng.choice(["ab ", "cd\n", "é# ", " ", "\t", "\n", "ab cd\n", "$<> ", "　", "one two three four five six seven eight nine\n"]) for _ in range(rng.randrange(40))), "aa") for i in range(300)]
    data += [(r[0], r[1], r[2]) for r in ODD]
    got = sorted((tuple(r)[:7] for r in rules.apply_rules(documents(data).repartition(3)).collect()), key=repr)
    want = []
    for doc_id, text, _ in data:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        places = {}
        for i in range(len(w) - 7):
            places.setdefault(tuple(w[i : i + 8]), []).append(i)
        repeated = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
        failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
        want.append((doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed))
    assert got == sorted(want, key=repr)


def test_divergence(documents):
    data = made_texts(300, 2)
    junk = [(1000 + i, " ".join(f"{w}###" for w in t.upper().split()), lang) for i, (_, t, lang) in enumerate(data[:20])]
    got = {r["doc_id"]: r for r in rules.apply_rules(documents([*data, *junk])).collect()}
    judged = [got[d[0]] for d in data if not got[d[0]]["base_failed"]]
    assert np.mean([r["kept"] for r in judged]) > 0.98
    assert not any(got[j[0]]["kept"] for j in junk if got[j[0]]["n_words"] >= rules.GUARD_WORDS)
    assert rules.apply_rules(documents([])).collect() == []


def test_short_texts_are_compared_by_characters(documents):
    data = made_texts(300, 2)
    words = [f"{c}{d}###" for c in "ABCDEF" for d in "GHIJK"]
    junk = [(2000 + i, " ".join(words[i:] + words[:i]), data[0][2]) for i in range(5)]
    got = {r["doc_id"]: r for r in rules.apply_rules(documents([*data, *junk])).collect()}
    assert all(got[j[0]]["n_words"] == 30 and not got[j[0]]["base_failed"] and not got[j[0]]["kept"] for j in junk)
    short = [got[d[0]] for d in data if got[d[0]]["n_words"] < rules.GUARD_WORDS and not got[d[0]]["base_failed"]]
    assert all(r["kept"] for r in short)


def test_js_distance():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.0, 0.5, 0.5])
    assert rules.js_distance(p, p) == 0 and rules.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1)
    assert rules.js_distance(p, q) == pytest.approx(np.sqrt(0.5))


def test_gradients_are_exact():
    rng = np.random.default_rng(0)
    bags, n = np.array([2, 1, 4]), 7
    shape = {"E": (5, 4), "e": (4,), "V": (4, 3), "U": (4, 3), "a": (3,), "c": (4,), "b": (1,)}
    w = {k: rng.normal(size=s) for k, s in shape.items()}
    x, y = rng.normal(size=(n, 5)), np.array([1.0, 0, 1])
    loss = lambda: np.mean(np.logaddexp(0, (1 - 2 * y) * mil.forward(w, x, bags)[0]))
    grad = mil._gradients(w, x, bags, y)
    for k in w:
        at = tuple(0 for _ in shape[k])
        old = w[k][at]
        w[k][at] = old + 1e-6
        up = loss()
        w[k][at] = old - 1e-6
        down = loss()
        w[k][at] = old
        assert grad[k][at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_quality(spark, documents):
    rng = random.Random(4)
    good = made_texts(400, 3)
    data = [(i, t if i % 3 else t.upper() + " ###", lang) for i, t, lang in good]
    # one bad passage among many good ones makes a bad document
    data += [(1000 + i, " ".join(t for _, t, _ in rng.sample(good, 5)) + (" $$$ ###" * 64 if i % 2 else ""), "aa") for i in range(200)]
    labels = spark.createDataFrame([(d[0], int(d[0] % 3 > 0 if d[0] < 1000 else d[0] % 2 == 0), 0) for d in data] + [(None, 1, 0), (7, None, 0)], "doc_id bigint, quality int, toxic int")
    got = mil.classify(documents([*data, *ODD]).repartition(3), labels).collect()
    assert len(got) == len(data) + len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None and r["doc_id"] is not None}
    held = [r["predicted"] == truth[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 80 and np.mean(held) > 0.95
    kept = mil.accepted(documents([*data, *ODD]), labels)
    assert kept.columns == documents([]).columns and kept.count() == sum(r["predicted"] for r in got)


def test_quality_without_labels(spark, documents):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r["score"] for r in mil.classify(documents([(1, "text"), (2, None)]), labels).collect()] == [0.5, 0.5]
    assert mil.classify(documents([]), labels).collect() == []


def test_passages_do_not_depend_on_neighbours():
    texts = [b"", b"one two\nthree", b" ", ("word " * 200).encode(), "é#".encode()]
    whole, bags = mil.passages(texts)
    assert bags.tolist() == [1, 1, 1, 4, 1]
    alone = np.concatenate([mil.passages([t])[0] for t in texts])
    assert np.allclose(whole, alone)
