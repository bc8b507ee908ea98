import random
import re

import numpy as np
import pytest

from cratewise.llm.jaccard import divide_skip, jaccard_components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    linked = [[j for j, b in enumerate(sets) if j != i and a and b and 100 * len(a & b) >= 80 * len(a | b)] for i, a in enumerate(sets)]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids else None, len(linked[i])))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}É" if i % 7 == 0 else f"W{i}" for i in range(300)]
    rows, doc_id = [], 0
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    for _ in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 40, 120, 400]))]
        for _ in range(rng.choice([1, 1, 2, 6, 12])):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            text = rng.choice([" ", "\n", "\t "]).join(own)
            rows.append((doc_id, (passage + " " if rng.random() < 0.4 else "") + text))
            doc_id += 1
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "One two"), (904, "one TWO"), (904, "one two"), (None, "one two"), (None, "alone in the world"), (905, " "), (906, " ")]
    rows += [(907, "long " * 30_000), (908, "long " * 100), (909, "x" * 200_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_keys", [1 << 20, 700])
def test_components_and_links(documents, block_keys):
    rows = corpus()
    got = jaccard_components(documents(rows).repartition(3), block_keys=block_keys).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_empty_table(documents):
    assert jaccard_components(documents([])).collect() == []


def test_divide_skip_finds_every_pair():
    rng = np.random.default_rng(3)
    base = [rng.choice(400, 60, replace=False) for _ in range(12)]
    sets = []
    for b in base:
        for _ in range(8):
            keep = np.unique(np.concatenate((rng.choice(b, rng.integers(50, 61), replace=False), rng.choice(400, 3))))
            sets.append(keep.astype(np.uint64))
    sizes = np.array([len(s) for s in sets])
    _, links = divide_skip(sizes, sets, np.ones(len(sets), np.int64))
    plain = [sum(9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b)) for b in sets) - 1 for a in sets]
    assert links.tolist() == plain and max(plain) > 1
