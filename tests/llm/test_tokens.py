"""Problem 8 against a reference tokenizer with the same vocabulary."""

import base64
import os
import random

import pytest
import tiktoken

from cuegrid.llm import tokens

PATH = os.path.join(tokens.VOCABULARIES, f"{tokens.NAME}.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


@pytest.fixture(scope="module")
def ref():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=tokens.PIECES, mergeable_ranks=ranks, special_tokens={})


def test_tree():
    t = tokens.SegmentTree([5, 3, 3, 9, 1])
    assert t.minimum() == (1, 4)
    t.update(4, 10)
    assert t.minimum() == (3, 1)
    t.update(1, 7)
    assert t.minimum() == (3, 2)


def test_equal_to_reference(ref):
    bpe = tokens.tokenizer(PATH)
    rng = random.Random(0)
    texts = ["", " ", "\n\n  x", "Hello world's 123 <|endoftext|>", "a" * 3000, "ab" * 2000, "漢字テスト นักแปล 🏳️‍🌈", "\u0000﻿�"]
    texts += ["".join(rng.choice("abcdefghij ABC 0123'\n漢é🎧") for _ in range(rng.randint(1, 400))) for _ in range(200)]
    for t in texts:
        assert bpe.encode(t) == ref.encode_ordinary(t), t


def test_round_trip_and_spark(spark, ref):
    rows = [(1, "The host needs it.", "s"), (2, None, "s"), (3, "", None), (4, "x" * 20000, "s"), (1, "The host needs it.", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: list(r.ids) for r in tokens.encode(df).collect()}
    assert got[2] == got[3] == [] and ref.decode(got[4]) == "x" * 20000 and ref.decode(got[1]) == "The host needs it."
    assert tokens.encode(df.limit(0)).collect() == []
    assert {r.source: r.docs for r in tokens.lengths(df).collect()} == {"s": 3, None: 1}
