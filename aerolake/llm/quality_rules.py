"""Operator 7: quality rules as weak supervision, with DataFrame functions alone.

1. One pass of native expressions counts, for every text, what the rules need; the counts are written to the shared folder.
2. Every rule votes good (1), bad (0) or abstains (null). The distinct vote patterns, at most 3 to the number of rules, are counted.
3. Expectation-maximisation over those patterns estimates the shares of three classes, good texts and two kinds of bad ones (full of
   marks; repeating and shouting), and how often each rule votes good in each. Rules that fail together thereby speak for one
   kind, not against the text once each. Any rule may turn out worthless or wrong: rates are bounded by ``EDGE`` alone.
4. The posterior probability of good is again an expression over the votes; a text is kept if it reaches ``KEEP`` and its base
   limits hold. No single failed rule rejects a text.

Null texts have no words, and like other texts under ``MIN_WORDS`` words they fail the base limits. Where all rules abstain the
posterior is the share of good texts. Repeated rows count as often as they occur. Extra columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.llm.common import SPACE, materialize

WINDOW = 8
MIN_WORDS = 20
KEEP = 0.5
#: name: (good if, bad if) over the counts; neither: the rule abstains. First match wins.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words >= 50", "n_words < 20"),
    "word_length": ("word_chars between 3 * n_words and 10 * n_words", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    "symbols": ("50 * n_symbols <= n_words", "5 * n_symbols > n_words"),
    "letters": ("10 * n_letters >= 9 * word_chars", "5 * n_letters < 4 * word_chars"),
    "repeats": ("20 * n_repeat_words <= n_words", "5 * n_repeat_words > n_words"),
    "lines": ("n_lines >= 4 and 10 * n_dup_lines <= n_lines", "n_lines >= 4 and 3 * n_dup_lines > n_lines"),
    "capitals": ("4 * n_capitals <= word_chars", "2 * n_capitals > word_chars"),
    "shouts": ("20 * n_shouts <= n_words", "4 * n_shouts > n_words"),
}
#: Rules that the estimates at first take to fail in each kind of bad texts; then P(vote good | class) for rules that hold, of bad texts, that fail.
KINDS = (("symbols", "letters"), ("repeats", "lines", "capitals", "shouts"))
START_GOOD, START_BAD, START_FAILS, START_SHARE = 0.95, 0.6, 0.2, 0.8
#: How far shares and rates stay from 0 and 1, and the votes that the starting values count for.
EDGE, PRIOR = 0.001, 10


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def without(text: Column, chars: str) -> Column:
    """Bytes of ``chars`` (ASCII) in ``text``."""
    return sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words inside ``WINDOW``-word windows that occur twice or more in the array."""
    at = F.sequence(F.lit(1), F.size(words) - WINDOW + 1)
    windows = F.transform(at, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def positions(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda a, b: a["h"].eqNullSafe(b["h"])
        return let(placed, lambda p: F.array_sort(F.transform(F.filter(F.transform(p, lambda x, k: F.struct(x["i"].alias("i"), (same(x, F.get(p, k + 1)) | same(x, F.get(p, k - 1))).alias("twice"))), lambda x: x["twice"]), lambda x: x["i"])))

    def covered(found: Column) -> Column:
        steps = F.transform(found, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(found, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, s: total + s)

    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(positions(h), covered)))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(counted)


def counts(documents: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules use."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.length(F.btrim(line, F.lit(SPACE))) > 0)
    rows = rows.select(
        "doc_id", "text",
        let(F.filter(F.split("text", "[\\x20\\x09-\\x0D]+", -1), lambda w: w != ""), lambda words: F.struct(F.size(words).cast("long").alias("n"), F.length(F.array_join(words, "")).cast("long").alias("chars"), repeated_words(words).alias("repeated"))).alias("words"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("distinct"))).alias("lines"),
    )
    return rows.select(
        "doc_id",
        F.col("words.n").alias("n_words"),
        F.col("words.chars").alias("word_chars"),
        without(F.col("text"), "#*$%&|<>").cast("long").alias("n_symbols"),
        (F.col("lines.n") - F.col("lines.distinct")).alias("n_dup_lines"),
        F.col("words.repeated").alias("n_repeat_words"),
        F.col("lines.n").alias("n_lines"),
        F.octet_length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.length(F.regexp_replace("text", "[^\\p{L}]+", "")).cast("long").alias("n_letters"),
        without(F.col("text"), "!").cast("long").alias("n_shouts"),
    )


def votes() -> dict[str, Column]:
    return {f"vote_{name}": F.when(F.expr(bad), 0).when(F.expr(good), 1) for name, (good, bad) in RULES.items()}


def estimate(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = 300) -> tuple[list[float], list[list[float]]]:
    """EM over (votes, texts): the share of each class, good texts first; for each class P(vote good | class) of every rule."""
    start = [[START_GOOD] * len(RULES), *([START_FAILS if name in kind else START_BAD for name in RULES] for kind in KINDS)]
    shares = [START_SHARE, *[(1 - START_SHARE) / len(KINDS)] * len(KINDS)]
    rates, total = start, sum(n for _, n in patterns)
    inside = lambda x: min(1 - EDGE, max(EDGE, x))
    for _ in range(rounds if total else 0):
        found, logs = [0.0] * len(shares), weights(shares, rates)
        sums = [[[0.0, 0.0] for _ in RULES] for _ in shares]
        for pattern, n in patterns:
            for k, p in enumerate(posteriors(pattern, logs)):
                found[k] += n * p
                for s, vote in zip(sums[k], pattern, strict=True):
                    if vote is not None:
                        s[0] += n * p * vote
                        s[1] += n * p
        before = shares
        shares = [inside((x + 1) / (total + len(shares))) for x in found]
        rates = [[inside((a + PRIOR * x) / (b + PRIOR)) for (a, b), x in zip(own, first, strict=True)] for own, first in zip(sums, start, strict=True)]
        if max(abs(a - b) for a, b in zip(before, shares, strict=True)) < 1e-9:
            break
    return shares, rates


def weights(shares: list[float], rates: list[list[float]]) -> list[tuple[float, list[tuple[float, float]]]]:
    """For each class its log share, and what a good and a bad vote of each rule add."""
    return [(math.log(share), [(math.log(r), math.log(1 - r)) for r in own]) for share, own in zip(shares, rates, strict=True)]


def posteriors(pattern: tuple[int | None, ...], logs: list[tuple[float, list[tuple[float, float]]]]) -> list[float]:
    sums = [first + sum(add[1 - vote] for vote, add in zip(pattern, adds, strict=True) if vote is not None) for first, adds in logs]
    parts = [math.exp(x - max(sums)) for x in sums]
    return [x / sum(parts) for x in parts]


def apply_rules(documents: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the posterior ``quality`` of every row."""
    rows = materialize(counts(documents)).withColumns(votes())
    names = list(votes())
    patterns = [(tuple(r[:-1]), r[-1]) for r in rows.groupBy(*names).count().collect()]
    logs = [sum((F.when(F.col(c) == 1, good).when(F.col(c) == 0, bad).otherwise(0.0) for c, (good, bad) in zip(names, adds, strict=True)), F.lit(share)) for share, adds in weights(*estimate(patterns))]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    quality = 1 / sum((F.exp(x - logs[0]) for x in logs[1:]), F.lit(1.0))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (quality >= keep)).alias("kept"), quality.alias("quality"))
