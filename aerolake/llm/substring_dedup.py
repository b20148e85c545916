"""Operator 10: removal of passages that a document with a smaller id holds, by difference-cover anchors.

A window is ``WINDOW`` consecutive words. Positions p with p mod ``PERIOD`` in ``COVER`` are the cover: for any two
positions i and j some d < PERIOD puts both i + d and j + d on it. An anchor is ``ANCHOR`` = WINDOW - PERIOD + 1 words from a
position on the cover, so two equal windows always share an aligned anchor that lies inside both.

0. Exact copies are settled by a hash of their texts: the copy with the smallest id stands for all; others lose every word
   if they hold a window at all. Only the ones that stand for others go on.
1. A scan hashes the anchors; grouping keeps hashes that two documents hold. If a filter of bounded size takes them all, they fill
   it and it goes to every task. If there are more, anchors join them by hash, and every document its own hits.
2. A scan extends every shared anchor to all windows around it, and hands out (128-bit window hash, doc_id).
   Grouping finds the windows of two documents or more with the smallest of them; these fill a second filter, if one takes them.
3. A scan hands out the windows that the filters hold, with their positions, and a join with the grouped windows leaves those
   that a smaller document holds: exact, and without pairs of documents.
4. Windows merge into word ranges, and a scan removes them; ranges join by doc_id and text, broadcast if their count allows it.

Null and empty texts have no words; a text under WINDOW words is left as it is but for white space. Rows that repeat a
doc_id with the same text are each treated as that document; other texts under the same doc_id are documents of their own, told apart by a
64-bit hash. Windows of rows with the same id never remove each other.
Rows without a doc_id are left alone and remove nothing. Extra columns are dropped in the digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.llm import bloom
from aerolake.llm.common import join_small, materialize, texts_as_bytes

WINDOW = 50
PERIOD = 31
#: A perfect difference cover: every residue mod 31 is a difference of two of its six members.
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
#: Word ranges, with a few for each document that has any, up to which the final join is broadcast (some tens of MB).
BROADCAST_RANGES = 1_000_000
#: Shared anchors, and repeated windows, up to which a filter of 32 MB holds them at eight bits a key.
FILTER_KEYS = bloom.MOST_BITS // bloom.BITS_A_KEY


class Words:
    """The words of a text, joined by one space, and the byte range of each."""

    def __init__(self, text: bytes | None):
        self.words = text.split() if text else []
        self.n = len(self.words)
        if self.n >= WINDOW:
            self.joined = b" ".join(self.words)
            self.ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, self.n) + 1) - 1
            self.starts = np.concatenate([[0], self.ends[:-1] + 1])

    def hashes(self, digest, positions: np.ndarray, words: int) -> list[bytes]:
        joined = self.joined
        return [digest(joined[a:b]) for a, b in zip(self.starts[positions].tolist(), self.ends[positions + words - 1].tolist(), strict=True)]

    def anchors(self, on_cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and 64-bit hashes."""
        at = on_cover[: np.searchsorted(on_cover, self.n - ANCHOR + 1)] if len(on_cover) and on_cover[-1] > self.n else cover_positions(self.n)
        return at, np.frombuffer(b"".join(self.hashes(xxhash.xxh3_64_digest, at, ANCHOR)), "<u8")

    def windows_around(self, anchors: np.ndarray) -> np.ndarray:
        """First positions of all windows that hold an anchor."""
        edge = np.zeros(self.n + 1, np.int64)
        np.add.at(edge, np.maximum(anchors + ANCHOR - WINDOW, 0), 1)
        np.add.at(edge, anchors + 1, -1)
        return np.flatnonzero(np.cumsum(edge)[: self.n - WINDOW + 1])


def cover_positions(n: int) -> np.ndarray:
    at = (np.arange(n // PERIOD + 1)[:, None] * PERIOD + np.array(COVER)).ravel()
    return at[at <= n - ANCHOR]


#: Enough for most texts; longer ones compute their own.
FIRST_POSITIONS = (np.arange(1000)[:, None] * PERIOD + np.array(COVER)).ravel()


#: Rows that a task of Python holds before it hands them on.
LOT = 50_000


def exact_copies(documents: DataFrame) -> DataFrame:
    """doc_id, text_key of documents whose whole text a smaller id has too."""
    texts = materialize(documents.where("doc_id is not null and text is not null").select("doc_id", "text_key", F.md5(F.col("text").cast("binary")).alias("text_hash")))
    first = materialize(texts.groupBy("text_hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"))
    return join_small(texts, first, "text_hash", "inner").where("doc_id > first").select("doc_id", "text_key").distinct()


def in_lots(batch: pa.RecordBatch, rows_of) -> Iterator[pa.RecordBatch]:
    """Record batches of columns (name: array) that ``rows_of`` (words, hits) gives for each document with a window, with its ids, some ``LOT`` rows at a time."""
    kept: list[dict] = []
    size = 0
    names = [c for c in batch.schema.names if c not in ("text", "hits")]
    hits_of = batch["hits"].to_pylist() if "hits" in batch.schema.names else [None] * batch.num_rows
    for ids, text, hits in zip(zip(*(batch[c].to_pylist() for c in names), strict=True), batch["text"].cast(pa.binary()), hits_of, strict=True):
        words = Words(text.as_py())
        if words.n >= WINDOW and (rows := rows_of(words, hits)) is not None:
            n = len(next(iter(rows.values())))
            kept.append(rows | {c: np.full(n, i, np.int64) for c, i in zip(names, ids, strict=True)})
            size += n
        if size >= LOT:
            yield pa.RecordBatch.from_pydict({c: np.concatenate([k[c] for k in kept]) for c in kept[0]})
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_pydict({c: np.concatenate([k[c] for k in kept]) for c in kept[0]})


def anchors_of(documents: DataFrame) -> DataFrame:
    """anchor, doc_id of every document, once for each."""

    def hand_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from in_lots(batch, lambda words, _: {"anchor": np.unique(words.anchors(FIRST_POSITIONS)[1]).view(np.int64)})

    return documents.select("doc_id", "text").mapInArrow(hand_out, "anchor long, doc_id long")


def with_hits(documents: DataFrame, shared: DataFrame) -> DataFrame:
    """doc_id, text_key, text, hits (positions of shared anchors) of the documents that have any, by joins alone."""

    def placed_anchors(words: Words, _) -> dict:
        positions, hashes = words.anchors(FIRST_POSITIONS)
        return {"position": positions.astype(np.int64), "anchor": hashes.view(np.int64)}

    def hand_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from in_lots(batch, placed_anchors)

    placed = documents.select("doc_id", "text_key", "text").mapInArrow(hand_out, "position long, anchor long, doc_id long, text_key long")
    hits = placed.join(shared, "anchor", "left_semi").groupBy("doc_id", "text_key").agg(F.collect_set("position").alias("hits"))
    return documents.select("doc_id", "text_key", "text").join(materialize(hits), ["doc_id", "text_key"])


def candidate_windows(documents: DataFrame, anchors=None, windows=None) -> DataFrame:
    """h1, h2, position, doc_id, text_key of windows around shared anchors: those in the filter ``anchors``, else the column hits; with the
    filter ``windows`` only of those that it holds by h1. Both are broadcast variables.
    """

    def rows_of(words: Words, hits: list[int] | None) -> dict | None:
        if anchors is None:
            hit = np.array(sorted(hits), np.int64)
        else:
            positions, hashes = words.anchors(FIRST_POSITIONS)
            hit = positions[bloom.contains(anchors.value, hashes)]
        if not len(hit):
            return None
        at = words.windows_around(hit)
        halves = np.frombuffer(b"".join(words.hashes(xxhash.xxh3_128_digest, at, WINDOW)), "<i8").reshape(-1, 2)
        if windows is not None:
            held = bloom.contains(windows.value, np.ascontiguousarray(halves[:, 0]).view(np.uint64))
            at, halves = at[held], halves[held]
        return {"h1": halves[:, 0], "h2": halves[:, 1], "position": at.astype(np.int32)}

    def hand_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from in_lots(batch, rows_of)

    columns = ["doc_id", "text_key", "text"] + ["hits"] * (anchors is None)
    return documents.select(*columns).mapInArrow(hand_out, "h1 long, h2 long, position int, doc_id long, text_key long")


def repeated_windows(documents: DataFrame, most_keys: int = FILTER_KEYS) -> DataFrame:
    """doc_id, text_key, position of each window that a document with a smaller id holds too; ``documents`` are no exact copies."""
    context = documents.sparkSession.sparkContext

    def filter_of(keys: DataFrame, column: str, n: int):
        if n > most_keys:
            return None
        return context.broadcast(bloom.build(keys.select(column), lambda batch: batch[column].to_numpy().view(np.uint64), bloom.bits_for(n), twice=False))

    shared = materialize(anchors_of(documents).groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("anchor"))
    anchors = filter_of(shared, "anchor", shared.count())
    if anchors is None:
        documents = with_hits(documents, shared)
    first = candidate_windows(documents, anchors).groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = materialize(first.where("first < last").drop("last"))
    windows = filter_of(first, "h1", first.count())
    return candidate_windows(documents, anchors, windows).join(first, ["h1", "h2"]).where("doc_id > first").select("doc_id", "text_key", "position")


def ranges_of(windows: DataFrame) -> DataFrame:
    """doc_id, text_key, ranges (first word, past the last, first word, ...) that the windows of each document cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for positions in batch["positions"]:
                at = np.unique(positions.values.to_numpy())
                breaks = np.flatnonzero(np.diff(at) > WINDOW)
                first, last = at[np.concatenate([[0], breaks + 1])], at[np.concatenate([breaks, [len(at) - 1]])]
                out.append(np.stack([first, last + WINDOW], axis=1).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_key"], pa.array(out, pa.list_(pa.int32()))], ["doc_id", "text_key", "ranges"])

    return windows.groupBy("doc_id", "text_key").agg(F.collect_set("position").alias("positions")).mapInArrow(run, "doc_id long, text_key long, ranges array<int>")


def outside(words: list[bytes], ranges: list[int]) -> list[bytes]:
    kept, done = [], 0
    for first, past in zip(ranges[::2], ranges[1::2], strict=True):
        kept += words[done:first]
        done = past
    return kept + words[done:]


def remove_repeats(documents: DataFrame, digest: bool = True, broadcast_ranges: int = BROADCAST_RANGES, filter_keys: int = FILTER_KEYS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256, or with ``digest`` off kept_text, of every row."""
    documents = documents.select("doc_id", "text", F.xxhash64(F.col("text").cast("binary")).alias("text_key"))
    key = ["doc_id", "text_key"]
    copies = materialize(exact_copies(documents))
    n_copies = copies.count()
    originals = join_small(documents.where("doc_id is not null"), copies, key, "left_anti", rows=n_copies)
    whole = copies.select(*key, F.lit(None).cast("array<int>").alias("ranges"))
    marks = materialize(ranges_of(repeated_windows(originals, filter_keys)).unionByName(whole).withColumn("marked", F.lit(True)))
    size = marks.agg(F.sum(3 + F.coalesce(F.size("ranges"), F.lit(0)))).first()[0] or 0
    joined = join_small(documents, marks, key, "left", rows=size, limit=broadcast_ranges)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, marked, ranges in zip(batch["doc_id"].to_pylist(), texts_as_bytes(batch["text"]), batch["marked"].to_pylist(), batch["ranges"].to_pylist(), strict=True):
                words = text.split() if text else []
                kept = words
                if marked and len(words) >= WINDOW:
                    kept = [] if ranges is None else outside(words, ranges)
                text_kept = b" ".join(kept)
                rows.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(text_kept).hexdigest() if digest else text_kept.decode()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", last])

    last = "kept_sha256" if digest else "kept_text"
    return joined.mapInArrow(rewrite, f"doc_id long, n_words long, n_removed long, {last} string")
