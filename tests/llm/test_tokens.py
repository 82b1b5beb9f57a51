import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from timberline.llm import tokens

REF = Tokenizer.from_file(tokens.VOCABULARY_DIR + "/byte_bpe_50k.json")
REF.encode_special_tokens = True
ENC = tokens.encoder(tokens.vocabulary())


def want(text):
    return REF.encode(text, add_special_tokens=False).ids


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_same_ids_for_any_text(text):
    assert ENC.encode(text) == want(text)


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 900 + "!?" * 400, "x" * 191, "x" * 192, "x" * 193, "абвгд" * 120, "<|endoftext|>", "  \n\n\t x  ", "it's we'll I'd", "🙂🙂👩‍🦰", "12:30 3.1415926", "​﻿"])
def test_long_words_and_odd_texts(text):
    assert ENC.encode(text) == want(text)


def test_frame(spark):
    rows = [(1, "hello world", 0), (2, None, 0), (3, "", 0), (1, "hello world", 0), (4, "long " * 50_000, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = tokens.encode(df)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    out = [(r["doc_id"], r["ids"]) for r in got.collect()]
    assert sorted(out) == sorted((i, want(t) if t else []) for i, t, _ in rows)
    n = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df, "text", ("doc_id",)).collect()}
    assert n == {i: len(want(t)) if t else 0 for i, t, _ in rows}
    assert tokens.encode(df.where("false")).count() == 0


def test_whole_corpus(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(docs).collect()}
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    assert len(got) == len(texts)
    for (i, _), e in zip(texts, REF.encode_batch([t for _, t in texts], add_special_tokens=False)):
        assert got[i] == e.ids
