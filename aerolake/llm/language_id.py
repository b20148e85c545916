"""Operator 4: word-first language identification with backoff to ever shorter character n-grams.

Learning: of the documents with a lang and a text outside the held-out fifth, a sample of about ``SAMPLE_BYTES`` of text, shared evenly
by the languages and taken by a hash of doc_id; a language always keeps its lowest hash. Spark counts words by language
(tasks count their own first), and from those counts the n-grams of one to five letters, word edges marked. All words and
n-grams of the sample, whose bytes bound them, go to the executors with the logarithm of their smoothed frequency in
each language.

Scoring, one scan: a known word adds its log frequencies. An unseen word backs off: of its five-grams those that are known
are averaged; if none is, its four-grams are tried, and so on. The language with the largest sum wins; the score is its share
after a softmax. Words are runs of letters in lower case. lang, source and doc_id are never inputs of a prediction.

Null texts and texts without a letter get ``und`` with score 0, as does every text if nothing could be learnt (an
empty table). Ties go to the first language in order. Repeated rows are scored alike. Extra columns are dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.llm.common import held_out, materialize, release

#: The bound on what the classifier learns from: bytes of text, of all languages together.
SAMPLE_BYTES = 8 << 20
LONGEST = 5
#: Unseen words whose backed-off scores a worker keeps at a time.
CACHE_WORDS = 100_000
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    words = LETTERS.findall(text.lower()) if text else []
    return words if text and text.isascii() else [w for w in words if any(map(str.isalpha, w))]


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    table: np.ndarray  # log frequencies: first of words, then of n-grams


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        """Row 0 stands for a word of which no letter is known; rows of unseen words follow those of known ones."""
        self.known = {w: i + 1 for w, i in self.model.words.items()}
        self.rows = np.zeros((len(self.known) + CACHE_WORDS + 1, len(self.model.langs)))
        self.rows[1 : len(self.known) + 1] = self.model.table[: len(self.known)]

    def longest_grams(self, word: str) -> list[int]:
        """Table rows of the longest n-grams of a word of which any is known."""
        get, marked = self.model.grams.get, f"<{word}>"
        for n in range(LONGEST, 1, -1):
            if found := [g for i in range(len(marked) - n + 1) if (g := get(marked[i : i + n])) is not None]:
                return found
        return [g for letter in word if (g := get(letter)) is not None]

    def rows_of(self, words: list[str]) -> np.ndarray | None:
        """A row for each word, none if there is no room for those not met before: unseen ones get the mean of their n-grams' rows."""
        known = self.known
        if unseen := {w for w in words if w not in known}:
            first = len(known) + 1
            if first + len(unseen) > len(self.rows):
                return None
            backed = {w: g for w in unseen if (g := self.longest_grams(w))}
            if backed:
                sizes = np.fromiter(map(len, backed.values()), np.int64, len(backed))
                flat = np.fromiter(chain.from_iterable(backed.values()), np.int64, sizes.sum())
                self.rows[first : first + len(backed)] = np.add.reduceat(self.model.table[flat], np.cumsum(sizes) - sizes) / sizes[:, None]
            known.update(zip(backed, range(first, first + len(backed)), strict=True))
            known.update(dict.fromkeys(unseen - backed.keys(), 0))
            self.rows[first + len(backed) : len(known) + 1] = 0
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def sums(self, words: list[str]) -> np.ndarray:
        """Summed log frequencies of words, a bounded number at a time."""
        total = np.zeros(len(self.model.langs))
        for at in range(0, len(words), CACHE_WORDS // 2):
            some = words[at : at + CACHE_WORDS // 2]
            if (rows := self.rows_of(some)) is None:
                self.forget()
                rows = self.rows_of(some)
            total += self.rows[rows].sum(axis=0)
        return total

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.model.langs:
            return "und", 0.0
        total = self.sums(words)
        best = int(total.argmax())
        return self.model.langs[best], float(1 / np.exp(np.maximum(total - total[best], -700)).sum())


def count_words(learn: DataFrame) -> DataFrame:
    """word, lang, n of (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                for word, n in Counter(words_of(text)).items():
                    counts[word, lang] += n
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in counts]), pa.array([x for _, x in counts]), pa.array(list(counts.values()), pa.int64())], ["word", "lang", "n"])

    return learn.select("text", "lang").mapInArrow(run, "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))


def by_language(counts: DataFrame, langs: list[str]) -> DataFrame:
    """word, n0, n1, ... (its counts in each language)."""
    of = lambda lang: F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0))
    return counts.groupBy("word").agg(*(of(lang).alias(f"n{k}") for k, lang in enumerate(langs)))


def count_grams(words: DataFrame) -> DataFrame:
    """gram, n0, n1, ... of all n-grams of up to ``LONGEST`` letters, edges marked but in single letters."""

    def cut(word: Column, n: int) -> Column:
        last = F.length(word) - (n - 1)
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    marked = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
    grams = F.flatten(F.array(cut(F.col("word"), 1), *(cut(marked, n) for n in range(2, LONGEST + 1))))
    counts = [c for c in words.columns if c != "word"]
    return words.select(F.explode(grams).alias("gram"), *counts).groupBy("gram").agg(*(F.sum(c).alias(c) for c in counts))


def collected(counts: DataFrame, key: str) -> tuple[list[str], np.ndarray]:
    """All keys, in order, and their counts in each language."""
    found = counts.orderBy(key).toArrow()
    return found[key].to_pylist(), np.array([found[c].to_numpy() for c in found.column_names if c != key], float).T


def sample(learn: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """text, lang of about ``sample_bytes`` of text, as much of every language, and of each at least the row with the lowest hash."""
    hashed = learn.select("text", "lang", F.xxhash64("doc_id").alias("h"))
    sizes = hashed.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size"), F.min("h").alias("low")).collect()
    span, start = 1 << 64, -(1 << 63)
    most = [(r["lang"], max(r["low"], start + min(span - 1, span * sample_bytes // (len(sizes) * max(1, r["size"]))))) for r in sizes]
    limits = learn.sparkSession.createDataFrame(most, "lang string, most long")
    return hashed.join(F.broadcast(limits), "lang").where("h <= most").select("text", "lang")


def fit(documents: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> Model:
    learn = documents.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counted = materialize(count_words(sample(learn, sample_bytes)))
    totals = {r[0]: r[1] for r in counted.groupBy("lang").agg(F.sum("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return Model([], {}, {}, np.zeros((0, 0)))
    words = materialize(by_language(counted, langs))
    known, word_counts = collected(words, "word")
    grams, gram_counts = collected(count_grams(words), "gram")
    release(counted, words)
    sizes = np.array([len(g) for g in grams], int)
    by_size = np.ones((LONGEST + 1, len(langs)))
    np.add.at(by_size, sizes, gram_counts)
    table = np.concatenate([np.log((word_counts + 0.5) / (np.array([totals[x] for x in langs]) + 0.5 * len(known))), np.log((gram_counts + 0.5) / by_size[sizes])])
    return Model(langs, {w: i for i, w in enumerate(known)}, {g: len(known) + i for i, g in enumerate(grams)}, table)


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch in batches:
            found = [score(text.as_py()) for text in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    found = documents.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
