"""Operator 12: alignment of two tokenizers' tokens (A: byte-level BPE, B: sentence pieces) over the bytes of the same text.

1. A text, with a space in front, is cut where a space that is not the last sign follows something else than white space. A's word pattern always ends
   a match there, and B has no piece with a space behind another character (``divisible`` checks its vocabulary; else texts stay whole), so both
   encodings of the text are those of its pieces, one after the other. Each distinct piece is encoded and aligned once by a worker.
2. ``align`` takes the pieces of a batch as documents of their own: with ``pandas.merge_asof``, keyed by piece, every token's start finds the other
   side's covering token, both ways. The union of both are the overlaps; those with equal ends end a group.
3. One scan writes a short row for every document: its counts, the hash of its groups, and its distinct linked id pairs with the number of their links.
   A linked pair is one number, A's id times the size of B's vocabulary plus B's id.
4. Spark counts in how many documents each pair occurs, and marks the most frequent ones of each A id.
5. Blocks of at most ``block_pairs`` counted pairs, almost always a single one, are broadcast to a scan of the short rows, which sums up what
   a document's links count. Sums of several blocks meet by row number.

Within a group all A tokens are linked to all B tokens; links are made of the distinct ids of both sides and multiplied by their numbers, and only
once for each distinct piece. Null and empty texts, and texts whose tokens of either side do not give back their bytes, have no tokens: zeros
and an empty groups_sha256. Repeated rows are documents of their own. Extra columns are dropped. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolake.llm.common import materialize, release
from aerolake.llm.token_counts import load_tokenizer

#: Pieces that a worker keeps; when there are more it begins anew.
CACHE_PIECES = 150_000
#: Counted pairs in one broadcast: 13 bytes each.
BLOCK_PAIRS = 4_000_000
CUT = re.compile(r"(?<=\S)(?= .)", re.DOTALL)
ROWS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def byte_alphabet() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on in their order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """Tokens of a byte-level tokenizer; strings of special tokens are plain text."""

    def __init__(self, path: str):
        self.tokenizer, signs = load_tokenizer(path), byte_alphabet()
        self.tokenizer.encode_special_tokens = True
        self.bytes = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return [ids for at in range(0, len(pieces), 2000) for ids in (e.ids for e in self.tokenizer.encode_batch_fast(pieces[at : at + 2000], add_special_tokens=False))]


class SentencePieces:
    """Tokens of a sentence-piece model, which puts a space in front of each text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        single = lambda i, x: bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode()
        self.bytes = [single(i, x) for i, x in enumerate(names)]
        #: No piece has a space behind another character, so a text can be cut in front of its spaces.
        self.divisible = all("▁" not in x.lstrip("▁") for x in names)

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return self.model.encode([x[1:] for x in pieces], num_threads=1)


def tokens_of(ids: list[list[int]], vocabulary: list[bytes], lengths: np.ndarray, texts: list[bytes]) -> tuple[pd.DataFrame, np.ndarray]:
    """A row for each token (piece, id, start, end; places in bytes, pieces one behind the other), and whether each piece's tokens give its text."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter((i for own in ids for i in own), np.int64, int(sizes.sum()))
    piece = np.repeat(np.arange(len(ids)), sizes)
    own = np.bincount(piece, lengths[flat], len(ids)).astype(np.int64)
    good = own == np.fromiter(map(len, texts), np.int64, len(texts))
    if good.all() and b"".join(map(vocabulary.__getitem__, flat.tolist())) != b"".join(texts) or not good.all():
        good = np.array([b"".join(map(vocabulary.__getitem__, i)) == x for i, x in zip(ids, texts, strict=True)], bool)
    end = np.cumsum(lengths[flat])
    return pd.DataFrame({"piece": piece, "id": flat, "start": end - lengths[flat], "end": end}), good


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Pairs of overlapping tokens of one piece (rows a and b, ends end_a and end_b), each found from the token that starts later."""
    left = a.rename(columns={"end": "end_a"})[["piece", "start", "end_a"]].assign(a=np.arange(len(a)))
    right = b.rename(columns={"end": "end_b"})[["piece", "start", "end_b"]].assign(b=np.arange(len(b)))
    one = pd.merge_asof(left, right, on="start", by="piece")
    # Tokens that start together were found from A's side already.
    two = pd.merge_asof(right, left, on="start", by="piece", allow_exact_matches=False).dropna()
    return pd.concat([one.loc[one.b.notna()], two.loc[two.end_a > two.start]], ignore_index=True).astype("int64")


def distinct_ids(group: np.ndarray, ids: np.ndarray, vocabulary: int, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of every group: where each group's begin (one more at the end), the ids, how often they occur."""
    found, times = np.unique(group * vocabulary + ids, return_counts=True)
    return np.searchsorted(found, np.arange(groups + 1) * vocabulary), found % vocabulary, times


def joined(values: pa.Array, offsets: np.ndarray, by: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), by)


class Aligner:
    """What pieces hold: for each known piece a number; by these numbers counts, group texts and linked pairs."""

    def __init__(self, a: ByteLevel, b: SentencePieces, most: int = CACHE_PIECES):
        self.a, self.b, self.most = a, b, most
        self.lengths = [np.fromiter(map(len, x.bytes), np.int64, len(x.bytes)) for x in (a, b)]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sums = np.zeros((0, 4), np.int64)
        self.good, self.texts = np.zeros(0, bool), []
        self.at, self.pairs, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """The number of each piece; those not known yet are encoded and aligned."""
        if len(self.known) > self.most:
            self.forget()
        known = self.known
        if new := [x for x in dict.fromkeys(pieces) if x not in known]:
            sums, good, texts, counts, pairs, times = self.align(new)
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.sums, self.good = np.concatenate([self.sums, sums]), np.concatenate([self.good, good])
            self.texts += texts
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(counts)])
            self.pairs, self.times = np.concatenate([self.pairs, pairs]), np.concatenate([self.times, times])
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def hashed(self, codes: list[int]) -> str:
        """Hash of the groups of these pieces, one after the other."""
        if not codes:
            return ""
        out, texts = hashlib.sha256(), self.texts
        for at in range(0, len(codes), 100_000):
            out.update((";" * (at > 0) + ";".join([texts[c] for c in codes[at : at + 100_000]])).encode())
        return out.hexdigest()

    def align(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each piece n_a, n_b, n_groups, n_links; whether it has tokens; its groups as text; how many linked pairs it has; all these pairs and their links."""
        texts = [x.encode() for x in pieces]
        (a, good_a), (b, good_b) = (tokens_of(s.encode(pieces), s.bytes, n, texts) for s, n in ((self.a, self.lengths[0]), (self.b, self.lengths[1])))
        good = good_a & good_b
        if not good.all():
            # Pieces that either side does not give back are left out, and the others' places counted anew.
            kept = [x for x, g in zip(pieces, good, strict=True) if g]
            sums, counts, strings = np.zeros((len(pieces), 4), np.int64), np.zeros(len(pieces), np.int64), np.full(len(pieces), "", object)
            pairs = times = np.zeros(0, np.int64)
            if kept:
                sums[good], _, own, counts[good], pairs, times = self.align(kept)
                strings[good] = own
            return sums, good, strings.tolist(), counts, pairs, times
        found = overlaps(a, b)
        cuts = np.unique(found.end_a.to_numpy()[(found.end_a == found.end_b).to_numpy()])
        group_a, group_b = (np.searchsorted(cuts, x.start.to_numpy(), "right") for x in (a, b))
        n, size = len(cuts), len(self.b.bytes)
        piece_of = np.zeros(n, np.int64)
        piece_of[group_a] = a.piece.to_numpy()
        n_a, n_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        words = [joined(pc.cast(pa.array(x.id), pa.string()), np.concatenate([[0], np.cumsum(k)]), ",") for x, k in ((a, n_a), (b, n_b))]
        per_piece = np.bincount(piece_of, minlength=len(pieces))
        strings = joined(pc.binary_join_element_wise(*words, "|"), np.concatenate([[0], np.cumsum(per_piece)]), ";")
        tally = lambda values: np.bincount(piece_of, values, len(pieces)).astype(np.int64)
        sums = np.stack([tally(n_a), tally(n_b), per_piece, tally(n_a * n_b)], axis=1)
        (at_a, ids_a, times_a), (at_b, ids_b, times_b) = (distinct_ids(g, x.id.to_numpy(), v, n) for g, x, v in ((group_a, a, len(self.a.bytes)), (group_b, b, size)))
        wide_a, wide_b = np.diff(at_a), np.diff(at_b)
        each = np.repeat(np.arange(n), wide_a * wide_b)
        place = np.arange(len(each)) - np.repeat(np.cumsum(wide_a * wide_b) - wide_a * wide_b, wide_a * wide_b)
        left, right = at_a[each] + place // wide_b[each], at_b[each] + place % wide_b[each]
        keys, weights, row = ids_a[left] * size + ids_b[right], times_a[left] * times_b[right], piece_of[each]
        rows, keys, weights = summed(row, keys, weights)
        return sums, good, strings.to_pylist(), np.bincount(rows, minlength=len(pieces)), keys, weights


def summed(rows: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, key), in that order, with the sums of their weights."""
    if not len(rows):
        return rows, keys, weights
    order = np.lexsort((keys, rows)) if rows.max() >= 1 << 20 else np.argsort(rows << 42 | keys, kind="stable")
    rows, keys = rows[order], keys[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])]))
    return rows[first], keys[first], np.add.reduceat(weights[order], first)


def aligned_rows(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``ROWS`` of each document: the counts, the hash of the groups, the distinct linked pairs in order with the number of their links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(ByteLevel(a_path), SentencePieces(b_path))
        cut = CUT.split if aligner.b.divisible else lambda x: [x]
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                own = [cut(f" {x}") if x else [] for x in part["text"].to_pylist()]
                sizes = np.fromiter(map(len, own), np.int64, len(own))
                codes = aligner.numbers([x for pieces in own for x in pieces])
                doc = np.repeat(np.arange(len(own)), sizes)
                good = np.bincount(doc, ~aligner.good[codes], len(own)) == 0
                codes, doc = codes[good[doc]], doc[good[doc]]
                sizes = np.where(good, sizes, 0)
                sums = [np.bincount(doc, aligner.sums[codes, k], len(own)).astype(np.int64) for k in range(4)]
                ends = np.cumsum(sizes).tolist()
                hashes = [aligner.hashed(codes[a:b].tolist()) for a, b in zip([0, *ends], ends, strict=False)]
                rows, code, often = summed(doc, codes, np.ones(len(codes), np.int64))
                wide = aligner.at[code + 1] - aligner.at[code]
                at = np.repeat(aligner.at[code] - np.cumsum(wide) + wide, wide) + np.arange(wide.sum())
                rows, pairs, times = summed(np.repeat(rows, wide), aligner.pairs[at], aligner.times[at] * np.repeat(often, wide))
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(own)))])
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((pairs, pa.int64()), (times, pa.int32()))]
                columns = [pa.array(number + np.arange(len(own))), part["doc_id"], *map(pa.array, sums), pa.array(hashes, pa.string()), *lists]
                number += len(own)
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ROWS.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(run, ROWS)


def pair_counts(rows: DataFrame, vocabulary: int) -> DataFrame:
    """pair, n (documents that hold it), best (no pair of its A id is in more), summed up before the shuffle. A window holds at most B's vocabulary."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    of_a = Window.partitionBy(F.expr(f"pair div {vocabulary}"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(of_a))


def counted(rows: DataFrame, counts: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``rows`` with n_best and count_sum over the pairs of ``counts``, which is broadcast and must be bounded."""
    table = counts.select("pair", "n", "best").toArrow().sort_by("pair")
    spark = rows.sparkSession
    known = spark.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = known.value
        for batch in batches:
            lists, times = batch["pairs"], batch["times"].flatten().to_numpy()
            pairs = lists.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            there = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            row, at, times = row[there], at[there], times[there].astype(np.int64)
            both = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(both[0], row, np.where(best[at], times, 0))
            np.add.at(both[1], row, n[at] * times)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), *map(pa.array, both)], [*columns, "n_best", "count_sum"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.select(*columns, "pairs", "times").mapInArrow(run, f"{schema}, n_best long, count_sum long")


def align_tokens(documents: DataFrame, a_path: str, b_path: str, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    rows = materialize(aligned_rows(documents, a_path, b_path))
    counts = materialize(pair_counts(rows, len(SentencePieces(b_path).bytes)))
    blocks = -(-counts.count() // block_pairs) or 1
    short = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    if blocks == 1:
        found = counted(rows, counts, short)
    else:
        parts = [materialize(counted(rows, counts.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == k), ["row"])) for k in range(blocks)]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        sums = whole.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        found = rows.select("row", *short).join(sums, "row").drop("row")
    release(counts) if blocks == 1 else None
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
