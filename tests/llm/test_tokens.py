import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import queries as Q
from tidemark.llm.bpe import BpeCodec, decode_ids, encode_documents
from tidemark.llm.token_counts import PrefixCounter, count_tokens

TEXTS = ["", " ", "a\x1cb", "ΑΣ ΟΔΟΣ İstanbul ǅ ﬀ é ½ ² Ⅷ", "<|endoftext|>x<|startoftext|> <|endoftext", "it's I'LL 'S don't", "日本語 12345  　x​z", "😀𝐀 ͅ", "nul\x00x\x7f\x80\x85y", "word " * 3000, "a" * 3000, "▁▁ x▁y", "  two  blanks\n\n", "end.\nNext, word", " \n x"]


@pytest.fixture(scope="module")
def word():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    return t, BpeCodec(Q.tokenizer("word_bpe_49k.json"), cache_words=50)


@pytest.fixture(scope="module")
def piece():
    import sentencepiece

    path = Q.tokenizer("piece_bpe_32k.model")
    return sentencepiece.SentencePieceProcessor(model_file=path), PrefixCounter(path, cache_chunks=50)


def same_bpe(word, text):
    library, own = word
    expected = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == expected
    assert own.decode(expected) == library.decode(expected, skip_special_tokens=False)


@pytest.mark.parametrize("text", TEXTS)
def test_bpe_equals_the_library(word, text):
    same_bpe(word, text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F, blacklist_categories=["Cs", "Cn"]), max_size=60))
def test_bpe_equals_the_library_on_latin(word, text):
    same_bpe(word, text)


@pytest.mark.parametrize("text", TEXTS)
def test_counts_at_every_prefix(piece, text):
    library, own = piece
    text = text[:200]
    table = own.prefix_table(text)
    for i in range(len(text) + 1):
        assert own.count_at(text, i, table) == len(library.encode(text[:i]))
    assert own.count(text) == len(library.encode(text))


@settings(max_examples=150, deadline=None)
@given(st.text("ab onthe.,isrd\n'9é", max_size=60))
def test_counts_on_random_words(piece, text):
    library, own = piece
    assert own.count(text) == len(library.encode(text))


def test_longest_prefix_within_a_budget(piece):
    library, own = piece
    rnd = random.Random(5)
    for _ in range(30):
        text = " ".join(rnd.choice(["onthe", "widget", "é", "x1"]) for _ in range(40))
        end = own.longest_within(text, 30)
        assert len(library.encode(text[:end])) <= 30
        assert all(len(library.encode(text[:j])) > 30 for j in range(end + 1, min(end + 3, len(text))) if text[j - 1] == " ")


def test_operators_on_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "hello hello", "z"), (3, "hello hello", "z")], "doc_id bigint, text string, n_tokens string")
    got = count_tokens(df, Q.tokenizer("piece_bpe_32k.model"), limit=1).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_tokens"], r["over_limit"]) for r in got] == [(1, 0, False), (2, 0, False), (3, 4, True), (3, 4, True)]
    enc = encode_documents(df, Q.tokenizer("word_bpe_49k.json"))
    rows = enc.orderBy("doc_id").collect()
    assert rows[0]["ids_sha256"] == hashlib.sha256(b"").hexdigest() and rows[0]["token_ids"] == []
    assert decode_ids(enc.filter("doc_id = 3"), Q.tokenizer("word_bpe_49k.json")).first()["decoded"] == "hello</w> hello</w>"
    assert encode_documents(df.limit(0), Q.tokenizer("word_bpe_49k.json")).count() == 0
