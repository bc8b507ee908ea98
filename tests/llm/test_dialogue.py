import functools
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from cratewise.llm.dialogue import AFTER, ASSISTANT, DUE, GONE, START, USER, Tables, audits, damage, repair, repair_digest
from cratewise.llm.oracle import ORACLE

SCHEMA = "conv_id bigint, turn bigint, role string, text string, copies string, n int, kind int"


def cheapest(symbols):
    """Least (cost, letters) by trying every edit of every row."""

    @functools.cache
    def best(i, state, inserts):
        ways = [(0, "")] if i == len(symbols) and state in (START, ASSISTANT) else []
        if inserts:
            cost, letters = best(i, DUE[state], inserts - 1)
            ways.append((cost + 3, "I" + letters))
        if i < len(symbols):
            symbol = symbols[i]
            cost, letters = best(i + 1, state, 3)
            ways.append((cost + 4, "D" + letters))
            if symbol != GONE:
                extra = 3 if symbol >= 4 else 0
                cost, letters = best(i + 1, DUE[state], 3)
                ways.append((cost + 3 + extra, "R" + letters))
                if (state, symbol % 4) in AFTER:
                    cost, letters = best(i + 1, AFTER[state, symbol % 4], 3)
                    ways.append((cost + extra, "K" + letters))
        return min(ways, default=(10**9, ""))

    return best(0, START, 3)


@pytest.mark.parametrize("block", [1, 3, 4])
def test_blocks_give_the_cheapest_edits(block):
    tables, rng = Tables(block), random.Random(7)
    assert len(tables.vectors) < 60
    for _ in range(1500):
        symbols = [rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 1, 2]) for _ in range(rng.randrange(0, 14))]
        assert tables.audit(np.array(symbols, np.int64)) == cheapest(tuple(symbols)), symbols
    assert USER in DUE


def by_sql(rows):
    conversations = pd.DataFrame(rows, columns=SCHEMA.replace(" bigint", "").replace(" string", "").replace(" int", "").split(", "))[["conv_id", "turn", "role", "text"]]
    conversations = conversations.astype({"conv_id": "Int64", "turn": "Int64", "role": object, "text": object})
    db = duckdb.connect()
    db.register("given", conversations)
    db.execute("CREATE VIEW conversations AS SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, CAST(role AS VARCHAR) AS role, CAST(text AS VARCHAR) AS text FROM given")
    names = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return sorted(db.execute(f"SELECT {', '.join(names)} FROM ({ORACLE['op11_conversation_repair']})").fetchall(), key=repr)


def test_damaged_conversations_equal_sql(spark):
    rng = random.Random(3)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "cut", " \t\n", "", None, "a\nb?  ", "é.", f"x{turn}"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text, "clash", 1, 2))
    rows += [(99, 5, "user", "long " * 50_000, "c", 0, 0), (98, t := 0, "user", "again.", "c", 0, 0), (98, t, "user", "again.", "c", 0, 0)]
    rows += [(97, turn, ("user", "assistant")[turn % 2], "same.", "c", 0, 0) for turn in range(700)]
    given = spark.createDataFrame(rows, SCHEMA)
    found = repair_digest(damage(given), given, copies="copies")
    assert sorted(map(tuple, found.repartition(1).collect()), key=repr) == by_sql(rows)


def test_dropped_conversation_and_empty_table(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    given = spark.createDataFrame([(dropped, 0, "user", "Hi.", "", 0, 0)], SCHEMA)
    assert [tuple(r) for r in repair_digest(damage(given), given, "copies").collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert repair_digest(damage(given.limit(0)), given.limit(0), "copies").count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello."), (1, 3, "user", "Hello."), (1, 4, "assistant", "Hi."), (1, 5, "assistant", "Bye."), (2, 0, "user", "Only.")]
    given = spark.createDataFrame([(*r, "", 0, 0) for r in rows], SCHEMA)
    found = sorted(map(tuple, repair(given).collect()))
    first = [(1, 1, "system", "Be kind."), (1, 2, "user", "Hello."), (1, 3, "assistant", "Hi.")]
    assert found == [*first, (1, 4, "user", ""), (1, 5, "assistant", "Bye."), (2, 1, "user", "Only."), (2, 2, "assistant", "")]
    facts = {r.conv_id: r for r in audits(given.withColumn("copies", given.n + 1), given).collect()}
    assert (facts[1].audit, facts[1].cost, facts[1].gaps, facts[1].duplicate, facts[1].illegal) == ("KKDKIK", 7, 1, 1, 2)
