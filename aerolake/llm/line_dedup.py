"""Operator 8: line dedup with two Bloom filters, so that only suspected repeats are shuffled.

1. A scan hashes every long line once and writes (128-bit key, doc_id) in order of the hash, 24 bytes a line and no shuffle.
2. Keys are counted, and their hashes cut into as many ranges as filters of a bounded size are needed (one, up to
   some thirty million lines). For each range its keys fill a once-seen and a twice-seen filter (``bloom``), and those
   that the twice-seen filter holds go on; the order of the files lets a range read its own pages only.
3. Grouping confirms keys found in at least ``min_docs`` documents and picks the document that keeps them.
4. A scan rewrites the documents. Confirmed keys, far fewer than the lines that have them, go to every task as sorted arrays of
   24 bytes a key if a count finds at most ``broadcast_keys``, and no text is shuffled. If there are more, the keys to drop join
   their documents by doc_id instead.

A line's key is the line without white space at its ends, A-Z in lower case; keys under ``min_chars`` code points are never
dropped. Null and empty texts are one empty line; a rewritten null text becomes an empty one. Rows that repeat a
doc_id count as one document. Rows without a doc_id are neither counted nor changed. Other columns are kept, but for
columns named n_lines and n_dropped, which the counts replace.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.llm import bloom
from aerolake.llm.common import join_small, materialize, release, texts_as_bytes

MIN_CHARS = 40
MIN_DOCS = 5
#: Ranges of hashes whose jobs run at the same time: so many filters are on the driver, and in tasks, at once.
AT_ONCE = 4
#: Confirmed keys up to which they are broadcast (24 MB).
BROADCAST_KEYS = 1_000_000


def key_of(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit hash of the line's key, None if the key is short."""
    key = line.strip().lower()  # both treat ASCII alone
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode(errors="replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def keys_in(text: bytes | None, min_chars: int) -> set[bytes]:
    return {k for line in text.split(b"\n") if (k := key_of(line, min_chars))} if text else set()


def long_lines(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """low (first half of the key, signed), key, doc_id of every long line, once for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), texts_as_bytes(batch["text"]), strict=True):
                found = keys_in(text, min_chars)
                keys += found
                ids += [doc_id] * len(found)
            low = np.frombuffer(b"".join(keys), "<i8")[::2]
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["low", "key", "doc_id"])

    return documents.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, "low long, key binary, doc_id long").sortWithinPartitions("low")


def suspects(lines: DataFrame, most_bits: int = bloom.MOST_BITS, at_once: int = AT_ONCE) -> list[DataFrame]:
    """(key, doc_id) of the lines whose key a twice-seen filter holds, a written table for each range of hashes; ``at_once`` ranges are worked on side by side."""
    context = lines.sparkSession.sparkContext
    n = lines.count()
    parts = bloom.ranges(n, most_bits)

    def of_range(bounds: tuple[int, int]) -> DataFrame:
        first, last = bounds
        own = lines.where(F.col("low").between(first, last)) if len(parts) > 1 else lines
        hashes_of = lambda batch: batch["low"].to_numpy().view(np.uint64)
        twice = context.broadcast(bloom.build(own.select("low"), hashes_of, bloom.bits_for(n / len(parts), most_bits), twice=True))

        def run(batches: Iterator[pa.RecordBatch], twice=twice) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(bloom.contains(twice.value, hashes_of(batch)))).select(["key", "doc_id"])

        written = materialize(own.mapInArrow(run, "key binary, doc_id long"))
        twice.unpersist()
        return written

    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(of_range, parts))


def find_common(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, most_bits: int = bloom.MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """(key, doc_id) of suspected lines; (key, keeper) of confirmed ones."""
    lines = materialize(long_lines(documents, min_chars))
    suspected = reduce(DataFrame.unionAll, suspects(lines, most_bits))
    release(lines)
    confirmed = suspected.groupBy("key").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    return suspected, materialize(confirmed.select("key", "keeper"))


class Keepers:
    """Sorted arrays of confirmed keys, in halves, and the document that keeps each."""

    def __init__(self, confirmed: DataFrame):
        table = confirmed.select("key", F.col("keeper").cast("long").alias("keeper")).toArrow()
        halves = np.frombuffer(b"".join(table["key"].to_pylist()), "<u8").reshape(-1, 2)
        order = np.argsort(halves[:, 0])
        self.low, self.high, self.keeper = halves[order, 0], halves[order, 1], table["keeper"].to_numpy()[order]
        self.certain = len(np.unique(self.low)) == len(self.low)

    def gone(self, digests: list[bytes], doc_ids: np.ndarray) -> np.ndarray:
        """Whether the line with that key goes from that document."""
        if not len(self.low) or not digests:
            return np.zeros(len(digests), bool)
        halves = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        at = np.minimum(np.searchsorted(self.low, halves[:, 0]), len(self.low) - 1)
        return (self.low[at] == halves[:, 0]) & (self.high[at] == halves[:, 1]) & (self.keeper[at] != doc_ids)


def without_common(texts: list[bytes | None], doc_ids: list[int | None], keepers: Keepers, min_chars: int) -> list[tuple[int, int, bytes]]:
    """Lines, dropped lines and the text that stays, of each text of a batch."""
    digests, ids, places, counts = [], [], [], []
    for k, (text, doc_id) in enumerate(zip(texts, doc_ids, strict=True)):
        lines = (text or b"").split(b"\n")
        counts.append(len(lines))
        if doc_id is not None:
            for i, line in enumerate(lines):
                if key := key_of(line, min_chars):
                    digests.append(key)
                    ids.append(doc_id)
                    places.append((k, i))
    drop: dict[int, set[int]] = {}
    for at in np.flatnonzero(keepers.gone(digests, np.array(ids, np.int64))).tolist():
        drop.setdefault(places[at][0], set()).add(places[at][1])
    kept = [text or b"" for text in texts]
    for k, lines_gone in drop.items():
        kept[k] = b"\n".join(line for i, line in enumerate(kept[k].split(b"\n")) if i not in lines_gone)
    return [(n, len(drop.get(k, ())), kept[k]) for k, n in enumerate(counts)]


def without(text: bytes, keys: set[bytes], min_chars: int) -> tuple[int, int, bytes]:
    """Lines, dropped lines, and the text that stays."""
    lines = text.split(b"\n")
    kept = [line for line in lines if key_of(line, min_chars) not in keys] if keys else lines
    return len(lines), len(lines) - len(kept), b"\n".join(kept) if keys else text


def dedupe_lines(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, digest: bool = False, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``documents`` with their text rewritten, and n_lines, n_dropped. With ``digest``: doc_id, n_lines, n_dropped, kept_sha256 alone."""
    suspected, confirmed = find_common(documents, min_chars, min_docs)
    n_keys = confirmed.count()
    keepers = Keepers(confirmed) if n_keys <= broadcast_keys else None
    source = documents.select("doc_id", "text") if digest else documents
    names = [c for c in source.columns if c not in ("n_lines", "n_dropped")]
    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    counts = ["n_lines long", "n_dropped long"]
    schema = ", ".join(["doc_id long", *counts, "kept_sha256 string"] if digest else [*(f"`{c}` {kinds[c]}" for c in names), *counts])
    if keepers is not None and keepers.certain:
        shared = documents.sparkSession.sparkContext.broadcast(keepers)
        joined = source.withColumnRenamed("keys", "_own_keys")
        rewritten = lambda batch: without_common(texts_as_bytes(batch["text"]), batch["doc_id"].to_pylist(), shared.value, min_chars)
    else:
        drops = join_small(suspected, confirmed, "key", "inner", rows=n_keys).where("doc_id <> keeper").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
        renamed = source.withColumnRenamed("keys", "_own_keys")
        # Rows without an id drop nothing, and are not sent to one place to find that out.
        joined = renamed.where("doc_id is not null").join(materialize(drops), "doc_id", "left")
        joined = joined.unionByName(renamed.where("doc_id is null").withColumn("keys", F.lit(None).cast("array<binary>")))
        rewritten = lambda batch: [without(text or b"", set(keys or ()), min_chars) for text, keys in zip(texts_as_bytes(batch["text"]), batch["keys"].to_pylist(), strict=True)]

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = rewritten(batch)
            added = [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64())]
            if digest:
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *added, pa.array([hashlib.sha256(d[2]).hexdigest() for d in done], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])
                continue
            text = pa.array([d[2] for d in done], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(text if c == "text" else batch["_own_keys" if c == "keys" else c] for c in names), *added], [*names, "n_lines", "n_dropped"])

    return joined.mapInArrow(rewrite, schema)
