import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cratewise.llm import tokens as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 31])
def test_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 1 << bits, n)
        packed = T.pack(ids, bits)
        assert len(packed) == -(-n * bits // 8)
        assert (T.unpack(packed, bits, 0, n) == ids).all()
        for a, b in ((n // 3, n), (n // 2, n // 2 + n // 4), (n, n)):
            assert (T.unpack(packed, bits, a, b) == ids[a:b]).all()


def test_words_encode_as_in_the_text():
    rng = random.Random(1)
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    pieces = ["the", "Éan", "don't", "'s", " ", "  ", "\n", "\n\n", " \n", "\t", " ", "　", "日本", "x1", "12", "!!", "é́", "🙂", "\x1c", "\x85", "<|endoftext|>", "\r\n", "Ġ", ",", ".", "²", "x.", "é,", "a;", "?", " "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(3000)]
    texts += ["a b c\nd e", "a b\n", "\na", " a", "a  b", "", "plain words only here", "x" * 50_000]
    tool = T.Encoder(PATH)
    raw = [t.encode() for t in texts]
    got = tool.encode(raw) + tool.encode(raw[:100])
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [g.tolist() for g in got] == want + want[:100]


def test_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 40)
    monkeypatch.setattr(T, "REMEMBERED_RUNS", 5)
    texts = [f"word{i} other{i % 7} more{chr(10)}lines{i}{"  odd" * (i % 3 == 0)}".encode() for i in range(200)]
    small, large = T.Encoder(PATH), T.Encoder(PATH)
    for at in range(0, 200, 20):
        assert [x.tolist() for x in small.encode(texts[at : at + 20])] == [x.tolist() for x in large.encode(texts[at : at + 20])]


def test_files(spark, documents, tmp_path, monkeypatch):
    rows = [(i, f"Some text number {i}\nline") for i in range(50)] + [(7, "again"), (7, "again"), (51, None), (52, ""), (None, "no id"), (53, "long words " * 40_000)]
    random.Random(2).shuffle(rows)
    docs = documents(rows).repartition(4)
    T.write_tokens(docs, PATH, str(tmp_path / "t"))
    got = T.documents(T.read_blocks(spark, str(tmp_path / "t"))).orderBy("start").collect()
    library = Tokenizer.from_file(PATH)
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda x: -1 if x is None else x) and len(order) == len(rows)
    stream, texts = [], {}
    for doc_id, text in rows:
        texts.setdefault(doc_id, []).append(library.encode(text or "", add_special_tokens=False).ids + [2])
    for r in got:
        own = next(x for x in texts[r["doc_id"]] if zlib.crc32(np.array(x, "<u4").tobytes()) == r["ids_crc32"])
        texts[r["doc_id"]].remove(own)
        assert (r["start"], r["n_tokens"]) == (len(stream), len(own))
        stream += own
    for a, b in ((0, 10), (100, 400), (len(stream) - 5, len(stream)), (50_000, 90_000)):
        assert T.read_range(spark, str(tmp_path / "t"), a, b).tolist() == stream[a:b]


def test_added_tokens_are_those_of_the_library(documents):
    """Token files have the ids of the library as it is, also for texts that hold an added token's string."""
    texts = ["end <|endoftext|> next", "<|endoftext|>", "a\tb<|endoftext|>  c", "plain words", "<|ENDOFTEXT|> x", "<|endoftext| >"]
    library = Tokenizer.from_file(PATH)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [437, 220, 50256, 1306]
    assert [x.tolist() for x in T.encoder(PATH).encode([t.encode() for t in texts])] == want
    got = T.tokenize(documents(list(enumerate(texts))), PATH).orderBy("doc_id").collect()
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(np.array(x + [2], "<u4").tobytes()) for x in want]


def test_empty_table(documents):
    assert T.tokenize(documents([]), PATH).collect() == []
