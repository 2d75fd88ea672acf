import re
import os

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sluice.llm.common import fresh_path
from sluice.llm.token_counts import token_counts
from sluice.llm.tokenizing import Encoder

WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["", " ", "<|endoftext|>x <|startoftext|>", "It's we'll DON'T 'S", "naïve ÉCOLE é ́b", "a\xa0b\x1cc\x85d　e", "İI ΟΔΟΣ Σ ß ẞ", "１２ ½ x²", "a\x00b \x01", "ªº µ ÿŸ", "漢字カナ 🙂👍🏽", "x" * 5000, "A<B>C", "﻿hi ​z", "un\nd\r\n\te"]


def library(path):
    if path == PIECE:
        return sentencepiece.SentencePieceProcessor(model_file=path).encode
    tokenizer = Tokenizer.from_file(path)
    return lambda t: tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE, PIECE])
@pytest.mark.parametrize("kept", [200_000, 3])
def test_ids_are_the_librarys(path, kept):
    encoder, ids = Encoder(path, kept), library(path)
    texts = [*ODD, " ".join(ODD), None]
    assert [list(memoryview(b).cast("I")) for b in encoder.blobs(texts)] == [list(ids(t or "")) for t in texts]


def test_chunks_only_where_they_are_independent():
    assert Encoder(WORD).by_chunk and not Encoder(BYTE).by_chunk and not Encoder(PIECE).by_chunk


def test_rows_and_cache(spark, make_docs, odd_rows):
    path = fresh_path(spark, "cache")
    rows = [*odd_rows, *enumerate(ODD, 50)]
    want = sorted((str(i), len((t or "").encode()), len(library(WORD)(t or ""))) for i, t in rows)
    for _ in range(2):
        out = token_counts(make_docs(rows), WORD, path, limit=5).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in out) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 5) for r in out)
    assert spark.read.parquet(path).count() == len({re.sub("[ \t\n\r\x0b\x0c]+", " ", t or "").strip(" ") for _, t in rows})


def test_only_misses_are_encoded_and_appended(spark, make_docs, monkeypatch):
    path = fresh_path(spark, "cache")
    token_counts(make_docs([(1, "a b"), (2, "a b")]), WORD, path).collect()
    token_counts(make_docs([(3, "a b"), (4, "c d e")]), WORD, path).collect()
    assert spark.read.parquet(path).count() == 2
    token_counts(make_docs([(3, "a b")]), BYTE, path).collect()
    assert spark.read.parquet(path).count() == 3
    assert spark.read.parquet(path).select("tokenizer_digest").distinct().count() == 2


def test_a_poisoned_cache_shows_that_it_is_used(spark, make_docs):
    path = fresh_path(spark, "cache")
    token_counts(make_docs([(1, "a b")]), WORD, path).collect()
    false = spark.read.parquet(path).selectExpr("content_digest", "tokenizer_digest", "n_tokens + 70 AS n_tokens").collect()
    other = fresh_path(spark, "cache")
    spark.createDataFrame(false, "content_digest binary, tokenizer_digest string, n_tokens long").write.parquet(other)
    assert token_counts(make_docs([(1, "a b")]), WORD, other).first()["n_tokens"] == 72


def test_empty_table(make_docs):
    assert token_counts(make_docs([]), WORD).count() == 0
    assert os.path.exists(WORD)
