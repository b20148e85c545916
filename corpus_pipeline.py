"""The corpus pipeline: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads again for the next one.
All but the last return the columns of ``docs``, whatever others it has and whatever they are called; the last returns the placed pieces. Texts of any length are
read whole, in batches that memory bounds. SQL can express
neither the quality discriminant nor the tokenizer, so there is no ORACLE_SQL. An empty table passes every stage as one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.llm import decontaminate, line_dedup, packing, quality, simhash
from aerolake.llm.common import materialize, release, small_batches, table, written_tables


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects.

    Every row is judged by its own text, also where ids are null or repeat; null and empty texts are scored like others.
    """
    small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With repeated long lines in one document each, and n_chars of the text that stays.

    The largest id keeps a line, in all rows that repeat this id. Rows without an id stay as they are; null texts become empty ones.
    """
    small_batches(spark)
    clashing = {c: f"_own_{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}
    rewritten = line_dedup.dedupe_lines(docs.withColumnsRenamed(clashing)).drop("n_lines", "n_dropped")
    rewritten = rewritten.withColumnsRenamed({own: c for c, own in clashing.items()})
    return rewritten.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With one row of each group of near copies: of the smallest doc_id, rows without an id last, then of the smallest text hash.

    Repeated rows and copies without an id are members like others. Texts without words, null ones too, are copies of each other.
    """
    small_batches(spark)
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that benchmark passages contaminate.

    Every row is judged by its own text, also where ids are null or repeat; null and empty texts stay.
    """
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document that is left, with its place in the packed sequences.

    Null and empty texts are one piece of the end id; rows with null or repeated ids are packed as documents of their own.
    """
    small_batches(spark)
    path = public_tokenizers.path
    return packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on its way, and the table that it read, are deleted once its own is there."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with written_tables() as own:
            done = materialize(stage(spark, docs, sf_dir))
        release(*(t for t in own if t is not done), docs)
        docs = done
    return docs
