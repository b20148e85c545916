"""Operator 1: best-fit packing of tokenized documents by length-histogram planning.

1. One scan tokenizes every document (its ids, then the end id), cuts only those longer than a sequence, and keeps a
   short row for each piece: no ids, only their CRC-32. The rows are written once to the shared folder.
2. The histogram of lengths, at most ``max_len`` rows whatever the corpus, goes to the driver. Best-fit decreasing runs over
   its counts: a step places a whole run of pieces of one length into a whole group of equally filled sequences. The plan is
   a list of runs (length, ranks from, to, first sequence, pieces a sequence, offset of the first), whose number follows the
   number of lengths, not of documents.
3. Every piece finds its rank within its length and joins the run that holds that rank, which names its sequence and offset.
   The pieces of a length are dealt over one salt for every ``SALT_ROWS`` counted pieces; a window ranks them within their
   salt, and the counts of the salts before (a row for each salt) are added, so no task ranks more, however many pieces are full.

Null and empty texts become one piece that holds only the end id. Rows that repeat a doc_id are packed as documents of
their own. Extra columns are dropped. Ties of length are ranked by doc_id and piece. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolake.llm.common import join_small, materialize
from aerolake.llm.token_counts import load_tokenizer

MAX_LEN = 2048
#: Pieces of one length that a task ranks, about.
SALT_ROWS = 500_000
#: Letters, digits, punctuation and white space that every Unicode version treats alike, so that both libraries split them alike.
PLAIN = re.compile("[^\\t\\n\\r\\x20-\\x7eÀ-ÖØ-öø-ſΑ-ΡΣ-Ωα-ωА-я]")
#: White space that long takes the rank-file library a time that grows with its square, and at last all its stack.
LONG_SPACE = re.compile(r"\s{500}")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"


class Encoder:
    """Token ids of a text as the JSON tokenizer gives them; texts of plain characters, without special strings or long white space, take the faster rank-file library."""

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None):
        self.exact = load_tokenizer(json_path)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and not PLAIN.search(text) and not any(s in text for s in self.special) and not LONG_SPACE.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def cut(n: int, max_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; of several pieces only the first may be shorter than ``max_len``."""
    first = n % max_len or max_len
    return [(0, min(n, first)), *((at, max_len) for at in range(first, n, max_len))]


def tokenize_pieces(documents: DataFrame, json_path: str, ranks_path: str | None, pattern: str | None, end_id: int = 0, max_len: int = MAX_LEN) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, deal (a number by which rows, also equal ones, are spread)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = Encoder(json_path, ranks_path, pattern), np.array([end_id], "<u4")
        deal = count(TaskContext.get().partitionId())
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = np.concatenate([encode(text.as_py() or ""), tail]).astype("<u4", copy=False)
                for k, (start, length) in enumerate(cut(len(ids), max_len)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), next(deal)))
            if rows:
                columns = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(run, PIECES)


def plan_best_fit(counts: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram: runs (length, rank_from, rank_to, first_sequence, per_sequence, offset).

    ``open_groups[free]`` lists (first sequence, number of sequences) with ``free`` places left. A document goes to the
    fullest sequence that still takes it; once it is in, that sequence is the fullest for the next of its length too,
    so each sequence of a group gets as many of them as fit.
    """
    open_groups: dict[int, list[tuple[int, int]]] = {}
    runs, sequences = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        for free in sorted(f for f in open_groups if f >= length):
            groups = open_groups[free]
            while groups and left:
                first, n = groups.pop()
                fit = free // length
                full = min(n, left // fit)
                rest = left - full * fit if full < n else 0
                if full:
                    runs.append((length, rank, rank + full * fit, first, fit, max_len - free))
                    open_groups.setdefault(free - fit * length, []).append((first, full))
                    rank, left = rank + full * fit, left - full * fit
                if rest:
                    runs.append((length, rank, rank + rest, first + full, rest, max_len - free))
                    open_groups.setdefault(free - rest * length, []).append((first + full, 1))
                    rank, left = rank + rest, 0
                if n > full + bool(rest):
                    groups.append((first + full + bool(rest), n - full - bool(rest)))
            if not left:
                break
        if left:
            fit = max_len // length
            full, rest = divmod(left, fit)
            if full:
                runs.append((length, rank, rank + full * fit, sequences, fit, 0))
                open_groups.setdefault(max_len - fit * length, []).append((sequences, full))
            if rest:
                runs.append((length, rank + full * fit, rank + left, sequences + full, rest, 0))
                open_groups.setdefault(max_len - rest * length, []).append((sequences + full, 1))
            sequences += full + bool(rest)
        open_groups = {f: g for f, g in open_groups.items() if g and f}
    return runs


def place(pieces: DataFrame, max_len: int = MAX_LEN, salt_rows: int = SALT_ROWS) -> DataFrame:
    """``pieces`` (kept, with their length) with the sequence_id and offset that the plan gives them."""
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    salts = spark.createDataFrame([(length, -(-n // salt_rows)) for length, n in counts.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.col("deal") % F.col("salts"))
    # One row for each salt: at most max_len and one for every salt_rows pieces.
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("size"))
    starts = materialize(sizes.withColumn("before", F.sum("size").over(Window.partitionBy("length").orderBy("salt")) - F.col("size")).drop("size"))
    runs = spark.createDataFrame(plan_best_fit(counts, max_len), "run_length long, rank_from long, rank_to long, first long, each long, base long")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = join_small(salted.withColumn("n", F.row_number().over(within)), starts, ["length", "salt"], "inner").withColumn("rank", F.col("n") + F.col("before") - 1)
    inside = (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    place_in_run = F.col("rank") - F.col("rank_from")
    return ranked.join(F.broadcast(runs), inside).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(place_in_run / F.col("each"))).alias("sequence_id"),
        (F.col("base") + place_in_run % F.col("each") * F.col("length")).alias("offset"),
    )


def pack(documents: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, end_id: int = 0, max_len: int = MAX_LEN) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return place(materialize(tokenize_pieces(documents, json_path, ranks_path, pattern, end_id, max_len)), max_len)
