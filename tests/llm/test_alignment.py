"""Cross-tokenizer alignment against a plain version."""

from __future__ import annotations

import random

import pytest

from aerolake.llm import token_alignment
from aerolake.llm.queries import QUERIES, tokenizer_path
from tests.llm import brute

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "é", "日本", "▁", "\xa0", "'s", "123", "<s>", "</s>", "<|endoftext|>", "\x1c", "\x85", "😀", "　", "word", "Longer words ", "ı", "ǅ", "́", "\r\n", ".", " \n", "\x00", "ﬁ", "᠎", "​"]


@pytest.fixture(scope="module")
def sides():
    return token_alignment.ByteLevel(tokenizer_path("byte_bpe_50k.json")), token_alignment.SentencePieces(tokenizer_path("piece_bpe_32k.model"))


def plain(texts, sides):
    a, b = sides
    of_a = lambda text: [(i, a.bytes[i]) for i in a.tokenizer.encode(f" {text}", add_special_tokens=False).ids]
    of_b = lambda text: [(i, b.bytes[i]) for i in b.model.encode(text)]
    return brute.alignment(texts, of_a, of_b)


def texts():
    rng = random.Random(3)
    own = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(25))) for _ in range(400)]
    return [None, "", " ", "\n", "one two  three", "one two  three", "x" * 5000, "日" * 3000, " ".join(f"word{k % 700}" for k in range(9000)), *own]


@pytest.mark.parametrize("block", [4_000_000, 300])
def test_alignment_is_exact(spark, sides, block):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, 1, "x", [2]) for i, t in rows], "doc_id long, text string, row int, pair string, times array<int>").repartition(3)
    found = token_alignment.align_tokens(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), block)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in found.collect()}
    assert got == dict(zip([i for i, _ in rows], plain([t for _, t in rows], sides), strict=True))
    assert token_alignment.align_tokens(docs.where("false"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), block).count() == 0


def test_rows_under_one_id_or_none(spark, sides):
    rows = [(1, "same text"), (1, "same text"), (1, "other"), (None, "same text"), (None, None)]
    found = token_alignment.align_tokens(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    want = sorted(((i, *x) for (i, _), x in zip(rows, plain([t for _, t in rows], sides), strict=True)), key=repr)
    assert sorted((tuple(r[c] for c in ("doc_id", *COLUMNS)) for r in found.collect()), key=repr) == want


def test_a_cache_that_overflows_changes_nothing(sides):
    small, large = token_alignment.Aligner(*sides, most=20), token_alignment.Aligner(*sides)
    for text in texts()[7:200]:
        pieces = token_alignment.CUT.split(f" {text}")
        assert small.hashed(small.numbers(pieces).tolist()) == large.hashed(large.numbers(pieces).tolist())


def test_query_on_documents(spark, data_dir, sides):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()]
    want = dict(zip([i for i, _ in docs], plain([t for _, t in docs], sides), strict=True))
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_token_alignment"](spark, data_dir).collect()} == want
