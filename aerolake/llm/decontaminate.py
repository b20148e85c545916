"""Operator 2: benchmark decontamination by a broadcast set of normalised test n-grams.

Benchmark items become windows of ``n`` words (a shorter item is one window) in a Spark job that writes them to the shared folder.
They are counted in bytes, as their set takes them in memory, and cut by hash into as many blocks as keep each under
``block_bytes``; only one block is on the driver and on the executors at a time. One scan for each block turns document
words into small numbers (0: in no window of the block); only runs of known words long enough to hold a window are
looked up in the set, and a hit is verified against the window's words themselves. With several blocks the hits
of a row meet by doc_id and text hash, so the number of blocks never changes a result.

A word inside any occurrence is hit. Null and empty texts have no words. Items with no words or without an id never occur
in ``items`` (words of an item without an id still hit). Every row is judged by its own text, also where rows repeat a doc_id or
have none. An empty benchmark hits nothing. Extra columns are dropped by ``decontaminate`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.llm.common import by_row, materialize, release, row_keys, text_key, texts_as_bytes

WORDS = 13
#: Memory that the set of one block may take.
BLOCK_BYTES = 64 << 20
#: What a window takes in a set besides its text, about.
WINDOW_BYTES = 600
#: ASCII digits and letters and all bytes of other characters are parts of words; the rest separates.
SEPARATE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
SPANS = "doc_id long, text_key string, n_words long, spans array<struct<first:int,past:int>>, items array<long>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().translate(SEPARATE).split() if text else []


class WindowSet:
    """The set for one block of (item id, window) pairs."""

    def __init__(self, pairs: list[tuple[int | None, tuple]]):
        self.number: dict[bytes, int] = {}
        self.items: dict[tuple, set] = {}
        for item, window in pairs:
            key = tuple(self.number.setdefault(w, len(self.number) + 1) for w in window)
            self.items.setdefault(key, set()).add(item)
        self.lengths = sorted({len(k) for k in self.items})

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged word ranges that windows cover, and the ids of their items."""
        known = np.fromiter(map(self.number.get, words, [0] * len(words)), np.int32, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], known > 0, [0]]).astype(np.int8)))
        hits, found = [], set()
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if not self.lengths or end - begin < self.lengths[0]:
                continue
            run = known[begin:end].tolist()
            for length in self.lengths:
                for i in range(end - begin - length + 1):
                    if (items := self.items.get(tuple(run[i : i + length]))) is not None:
                        hits.append((begin + i, begin + i + length))
                        found |= items
        return merge(hits), found - {None}


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, past in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(past, out[-1][1]))
        else:
            out.append((first, past))
    return out


def blocks_of(benchmark: DataFrame, n: int = WORDS, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, Broadcast]]:
    """(blocks to come, a broadcast ``WindowSet``) for each block of windows, one at a time."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch["item_id"].to_pylist(), texts_as_bytes(batch["text"]), strict=True):
                words = words_of(text)
                starts = range(max(1, len(words) - n + 1) if words else 0)
                for at in range(0, len(starts), 10_000):
                    some = [b" ".join(words[i : i + n]) for i in starts[at : at + 10_000]]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(some), pa.int64()), pa.array(some, pa.binary())], ["item_id", "window"])

    windows = materialize(benchmark.select("item_id", "text").mapInArrow(cut, "item_id long, window binary").distinct())
    size = windows.agg(F.sum(F.octet_length("window") + WINDOW_BYTES)).first()[0] or 0
    count = max(1, math.ceil(size / block_bytes))
    for k in range(count):
        rows = windows.where(F.pmod(F.xxhash64("item_id", "window"), F.lit(count)) == k).collect()
        block = windows.sparkSession.sparkContext.broadcast(WindowSet([(r[0], tuple(bytes(r[1]).split(b" "))) for r in rows]))
        if k == count - 1:
            release(windows)
        yield count - k - 1, block
        if count > 1:
            block.unpersist()


def scan_block(documents: DataFrame, block: Broadcast) -> DataFrame:
    """doc_id, text_key, n_words, spans, items of every row, for the windows of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = block.value
        for batch in batches:
            rows = []
            for doc_id, key, text in zip(batch["doc_id"].to_pylist(), batch["text_key"].to_pylist(), texts_as_bytes(batch["text"]), strict=True):
                words = words_of(text)
                spans, items = windows.find(words)
                rows.append({"doc_id": doc_id, "text_key": key, "n_words": len(words), "spans": [{"first": a, "past": b} for a, b in spans], "items": sorted(items)})
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW_SPANS)

    return documents.mapInArrow(run, SPANS)


def find_spans(documents: DataFrame, benchmark: DataFrame, n: int = WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (hit word ranges, past the end exclusive), items, text_key of every row."""
    keyed = documents.select("doc_id", text_key().alias("text_key"), "text")
    rows, hits = None, []
    for left, block in blocks_of(benchmark, n, block_bytes):
        found = scan_block(keyed, block)
        if rows is None and not left:
            return found
        found = materialize(found if rows is None else found.where(F.size("spans") > 0))
        rows = found if rows is None else rows
        # Rows with one id and text have the same hits: one of them stands for all.
        hits.append(found.where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_key"]))
    together = reduce(DataFrame.unionAll, hits).groupBy("doc_id", "text_key").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = materialize(together.select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), merged_spans(F.col("spans")).alias("spans"), "items"))
    joined = rows.select("doc_id", "text_key", "n_words").join(merged, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left")
    none = lambda c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c)
    return joined.select("doc_id", "text_key", "n_words", none("spans"), none("items"))


ARROW_SPANS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.string()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))), ("items", pa.list_(pa.int64()))])


def merged_spans(spans: F.Column) -> F.Column:
    """Sorted ranges with those that touch or overlap made one."""
    joined = lambda out, s: F.when((F.size(out) > 0) & (s["first"] <= F.element_at(out, -1)["past"]), F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(F.element_at(out, -1)["first"].alias("first"), F.greatest(s["past"], F.element_at(out, -1)["past"]).alias("past"))))).otherwise(F.concat(out, F.array(s)))
    return F.aggregate(spans, F.expr("cast(array() as array<struct<first:int,past:int>>)"), joined)


def judge(spans: DataFrame) -> DataFrame:
    """The digest of ``find_spans``: n_hit, n_items, items_sha256, contaminated (a twentieth of the words or more hit)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["past"] - s["first"]))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    rows = spans.select(*(c for c in ("doc_id", "text_key") if c in spans.columns), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"))
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the characters from the first to the last word of each range, for removal of spans instead of documents."""
    raw = text.encode()
    plain = raw.lower().translate(SEPARATE)
    starts, ends, at = [], [], 0
    for word in plain.split():
        at = plain.index(word, at)
        starts.append(at)
        at += len(word)
        ends.append(at)
    kept, done = [], 0
    for first, past in spans:
        kept.append(raw[done : starts[first]])
        done = ends[past - 1]
    return b"".join([*kept, raw[done:]]).decode()


def decontaminate(documents: DataFrame, benchmark: DataFrame, n: int = WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    return judge(find_spans(documents, benchmark, n, block_bytes)).drop("text_key")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, n: int = WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``documents`` whose own text is not contaminated, unchanged."""
    judged = judge(find_spans(documents, benchmark, n, block_bytes)).where("contaminated").select("doc_id", "text_key").distinct()
    return by_row(documents, row_keys(judged, "text_key"), "left_anti")
