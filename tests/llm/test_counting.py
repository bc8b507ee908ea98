import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from cratewise.llm.counting import PieceCounter, count_tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  two  spaces ", "<s>x</s><unk>", "▁a▁ ▁", "a\nb\r\n\tc\x00d", "ﬁ ① 字幕 \U0001f600", "x" * 300, "<0x0A>"]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def finely():
    return PieceCounter(MODEL, split_bytes=8)


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(alphabet="ab e\n▁é.tho", max_size=80), st.text(max_size=60), st.sampled_from(ODD)))
def test_parts_have_the_tokens_of_the_whole(library, finely, text):
    assert finely.count([text.encode()]) == [len(library.encode(text))]


def test_whole_texts_equal_the_library(spark, documents, library):
    words = "the quick brown fox, déjà vu 字\n\n  "
    texts = [*ODD, None, words * 9000, "字幕" * 30_000, "a" * 100_000, "dup", "dup"]
    found = {r.doc_id: r for r in count_tokens(documents(list(enumerate(texts))), MODEL).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        n = len(library.encode(text or ""))
        assert (found[i].n_bytes, found[i].n_tokens, found[i].over_limit) == (len((text or "").encode()), n, n > 4096)


def test_null_id_empty_table_and_json(spark, documents):
    assert count_tokens(documents([]), MODEL).count() == 0
    assert [(r.doc_id, r.n_tokens) for r in count_tokens(documents([(None, "a b")]), MODEL).collect()] == [(None, 2)]
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "end <|endoftext|> next"
    n = len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)
    assert count_tokens(documents([(1, text)]), path).first().n_tokens == n
