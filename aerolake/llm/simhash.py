"""Operator 5: SimHash near-dedup with a Gray-order hierarchical index.

1. A scan computes the 64-bit fingerprint of every text: words of the ASCII-lower-cased text, shingles of ``SHINGLE`` words,
   XXH64 with seed 42; a bit is set if over half of the shingles set it. A text without words has fingerprint zero.
2. Equal fingerprints become one node, named by the fingerprint, so groups of copies shrink before any search.
3. Candidates meet by key. Two fingerprints with at most two differing bits agree on at least two of four 16-bit quarters,
   so each goes to six keys of 32 fixed bits. A key with more than ``LEAF_GROUP`` nodes is split: the bits it leaves
   free are cut into three, of which the pair again agrees on one. After three splits at most ten bits are free,
   so no group can be larger than 1024, whatever the corpus, and no link is lost.
4. In every group an index is built in Gray order: neighbours in rank share most bits. A node of the index holds, as
   (mask, pattern), the bits that all below it share and its parent does not. A search adds up the differences from
   the root down and drops a node with all below it once they pass the limit. A group returns a star for each
   connected part of it, so its output is linear in its size.
5. Stars of all groups meet in ``components``; a component is named by its smallest doc_id.

Null texts count as texts without words. Rows that repeat a doc_id with other texts link what both texts link. Rows without a
doc_id get their fingerprint and link others; their component_id is that of the other members (null if none has an id).
Extra columns are dropped by ``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.llm.common import by_row, materialize, row_keys, text_key, texts_as_bytes
from aerolake.llm.components import stars

SHINGLE = 3
MAX_BITS = 2
LEAF_GROUP = 1024
FANOUT = 8
BLOCK = 1 << 15


def shingle_hashes(text: bytes, k: int = SHINGLE) -> np.ndarray:
    words = text.lower().split()  # both treat ASCII alone
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-k] + 1])
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)]), ">u8")


def fingerprint(hashes: np.ndarray) -> int:
    """The signed 64-bit number whose bits most of the hashes set."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        some = hashes[at : at + BLOCK].astype("<u8")
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, fp (long) and the other columns but the text of every row."""
    others = [c for c in documents.columns if c not in ("doc_id", "text")]
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_hashes(text or b"")) for text in texts_as_bytes(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.int64()), *(batch[c] for c in others)], ["doc_id", "fp", *others])

    return documents.select("doc_id", "text", *others).mapInArrow(run, ", ".join(["doc_id long", "fp long", *(f"{c} {kinds[c]}" for c in others)]))


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the Gray sequence."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchy over distinct fingerprints in Gray order; ``levels`` go from the root's children to the leaves."""

    def __init__(self, fps: np.ndarray, fanout: int = FANOUT):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fanout = fanout
        shared, value = np.full(len(fps), ~np.uint64(0)), fps[self.order]
        levels = [(shared, value)]
        while len(shared) > fanout:
            cut = np.arange(0, len(shared), fanout)
            ones, zeros = np.bitwise_and.reduceat(shared & value, cut), np.bitwise_and.reduceat(shared & ~value, cut)
            shared, value = ones | zeros, ones
            levels.append((shared, value))
        self.levels, above = [], None
        for shared, value in reversed(levels):
            parents = above[np.arange(len(shared)) // fanout] if above is not None else np.uint64(0)
            self.levels.append((shared & ~parents, value))
            above = shared

    def search(self, queries: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query number, place in the given fingerprints) within ``most`` differing bits."""
        n = len(self.levels[0][0])
        q, node = np.repeat(np.arange(len(queries)), n), np.tile(np.arange(n), len(queries))
        gone = np.zeros(len(q), np.uint8)
        for k, (mask, value) in enumerate(self.levels):
            if k:
                first = node * self.fanout
                spread = np.minimum(self.fanout, len(mask) - first)
                q, gone, first = np.repeat(q, spread), np.repeat(gone, spread), np.repeat(first, spread)
                node = first + np.arange(len(first)) - np.repeat(np.cumsum(spread) - spread, spread)
            gone = gone + np.bitwise_count((queries[q] ^ value[node]) & mask[node])
            near = gone <= most
            q, node, gone = q[near], node[near], gone[near]
        return q, self.order[node]


def link_group(fps: np.ndarray, names: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) for each member that is linked to a smaller name in the group: a star for every connected part."""
    index = GrayIndex(fps)
    pairs = [(q + at, other) for at in range(0, len(fps), 256) for q, other in [index.search(fps[at : at + 256], most)]]
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    a, b = a[a < b], b[a < b]
    root = names.copy()
    while len(a):
        low = np.minimum(root[a], root[b])
        if (root[a] == low).all() and (root[b] == low).all():
            break
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
    linked = root != names
    return names[linked], root[linked]


def first_masks() -> list[int]:
    quarters = [0xFFFF << (16 * k) for k in range(4)]
    return [a | b for a, b in combinations(quarters, 2)]


def finer_masks(mask: int) -> list[int]:
    """Masks that fix a third of what ``mask`` leaves free, one for each third."""
    free = [1 << k for k in range(64) if not mask >> k & 1]
    return [mask | sum(free[k::3]) for k in range(3)]


def as_long(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def under_masks(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """A row for each node and mask: mask, key (the fixed bits), fp, name."""
    return nodes.withColumn("mask", F.explode(F.array(*(F.lit(as_long(m)) for m in masks)))).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "name")


def split_masks(rows: DataFrame) -> DataFrame:
    """Rows of groups that are too large, under the three finer masks of theirs."""
    finer = F.lit(None)
    known = {as_long(m): [as_long(x) for x in finer_masks(m)] for m in all_masks()}
    for mask, below in known.items():
        finer = F.when(F.col("mask") == mask, F.array(*map(F.lit, below))).otherwise(finer)
    return rows.withColumn("mask", F.explode(finer)).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def all_masks(splits: int = 2) -> list[int]:
    masks = level = first_masks()
    for _ in range(splits):
        level = [x for m in level for x in finer_masks(m)]
        masks = masks + level
    return masks


def links(nodes: DataFrame, most: int = MAX_BITS, leaf_group: int = LEAF_GROUP) -> DataFrame:
    """(u, v) names of linked nodes, enough for their connected components; ``nodes``: distinct fp, name."""
    if most > 2:
        raise ValueError("the candidate keys hold for at most two differing bits")
    rows, edges = under_masks(nodes, first_masks()), None
    for split in range(4):
        sizes = materialize(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"))
        large = sizes.where(F.col("n") > leaf_group).drop("n") if split < 3 else None
        small = sizes.where(F.col("n") <= leaf_group).drop("n") if split < 3 else sizes.drop("n")
        groups = rows.join(small, ["mask", "key"]).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"), F.collect_list("name").alias("names"))
        found = groups.select("fps", "names").mapInArrow(link_groups(most), "u long, v long")
        edges = found if edges is None else edges.unionByName(found)
        if large is None or large.isEmpty():
            break
        rows = materialize(split_masks(rows.join(large, ["mask", "key"])))
    return edges


def link_groups(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [link_group(fps.values.to_numpy().view(np.uint64), names.values.to_numpy(), most) for fps, names in zip(batch["fps"], batch["names"], strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["u", "v"])

    return run


def roots_of(prints: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """fp, root of every fingerprint: one root for all that are linked, also by a doc_id that two of them share."""
    nodes = materialize(prints.select("fp", F.col("fp").alias("name")).distinct())
    several = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("v"), F.max("fp").alias("high")).where("v <> high")
    repeated = prints.join(several, "doc_id").where("fp <> v").select(F.col("fp").alias("u"), "v")
    roots = stars(links(nodes, most).unionByName(repeated))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(documents: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    prints = materialize(fingerprints(documents.select("doc_id", "text")))
    rooted = materialize(roots_of(prints, most))
    lowest = prints.groupBy("fp").agg(F.min("doc_id").alias("low")).join(rooted, "fp").groupBy("root").agg(F.min("low").alias("component_id"))
    label = materialize(rooted.join(lowest, "root").select("fp", "component_id"))
    return prints.join(label, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """One row of ``documents`` for each component: that with the smallest doc_id (one with an id before those without), then with the
    smallest hash of its text; of rows that agree in both any one.
    """
    keyed = fingerprints(documents.select("doc_id", "text", text_key().alias("hash")))
    prints = materialize(keyed.groupBy("doc_id", "hash", "fp").agg(F.count("*").alias("rows")))
    rooted = materialize(roots_of(prints, most))
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash")
    members = prints.join(rooted, "fp").withColumn("key", key)
    several = members.groupBy("root").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("root", "first")
    gone = members.join(several, "root").where("not (key <=> first)")
    kept = by_row(documents, row_keys(gone, "hash"), "left_anti")
    repeated = row_keys(prints.where("rows > 1"), "hash")
    if repeated.isEmpty():
        return kept
    same = "_same_text"
    while same in documents.columns:
        same += "_"
    own = by_row(kept, repeated, "left_semi").withColumn(same, text_key())
    return by_row(kept, repeated, "left_anti").unionByName(own.dropDuplicates(["doc_id", same]).drop(same))
