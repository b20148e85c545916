"""What must not change with size, blocks, skew and missing ids: filters, salts, blocks of windows, tokenizers, models against plain versions."""

from __future__ import annotations

import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from aerolake.llm import bloom, decontaminate, language_id, line_dedup, packing, quality, quality_rules, simhash, substring_dedup, token_counts
from aerolake.llm.common import held_out
from aerolake.llm.queries import tokenizer_path
from tests.llm import brute
from tests.llm.test_cases import by_id, benchmark, empty, labels, odd, texts, with_ids  # noqa: F401


@pytest.fixture(scope="module")
def tables(spark, data_dir):
    return {n: spark.read.parquet(f"{data_dir}/{n}.parquet") for n in ("documents", "labels", "benchmark")}


def rows_of(tables):
    return [(r["doc_id"], r["text"]) for r in tables["documents"].select("doc_id", "text").collect()]


# Bloom filters


@pytest.mark.parametrize("n", [20_000, 200_000, 2_000_000])
def test_share_of_keys_let_through_stays_the_same(n):
    """At 10 and 100 times the keys, with filters of one size: no repeated key is missed, and as few others pass."""
    rng = np.random.default_rng(n)
    most_bits = 1 << 20
    keys = rng.integers(-(1 << 63), 1 << 63, n)
    repeated, passed = keys[: n // 50], 0
    for first, last in bloom.ranges(n, most_bits):
        own = keys[(keys >= first) & (keys <= last)].view(np.uint64)
        again = repeated[(repeated >= first) & (repeated <= last)].view(np.uint64)
        bits = bloom.bits_for(n / len(bloom.ranges(n, most_bits)), most_bits)
        assert bits <= most_bits
        once, twice = np.zeros(bits // 64, np.uint64), np.zeros(bits // 64, np.uint64)
        for part in np.array_split(np.concatenate([own, again]), 40):  # forty tasks
            a, b = np.zeros(bits // 64, np.uint64), np.zeros(bits // 64, np.uint64)
            bloom.add_seen(a, b, part)
            twice |= b | bloom.in_both(once, a)
            once |= a
        assert bloom.contains(twice, again).all()
        passed += int(bloom.contains(twice, own).sum())
    assert passed - len(repeated) <= 0.04 * n


def test_ranges_cover_all_hashes():
    for n in (0, 1, 10**6, 10**9):
        parts = bloom.ranges(n, 1 << 24)
        assert parts[0][0] == -(1 << 63) and parts[-1][1] == (1 << 63) - 1 and all(a[1] + 1 == b[0] for a, b in zip(parts, parts[1:], strict=False))


def test_lines_in_many_ranges(spark, tables):
    rng = random.Random(3)
    shared = [f"a line that several documents share, number {k} of them all" for k in range(300)]
    docs = [(i, "\n".join([rng.choice(shared) for _ in range(20)] + [f"own line {i} {j} which nobody else has, long enough" for j in range(400)])) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    lines = line_dedup.long_lines(df)
    assert len(bloom.ranges(lines.count(), 1 << 16)) > 3
    suspected = [t for t in line_dedup.suspects(lines, 1 << 20)]
    want = brute.lines(docs)
    suspects, confirmed = line_dedup.find_common(df, most_bits=1 << 20)
    assert abs(suspects.count() - sum(t.count() for t in suspected)) < 100  # what gets in by chance hangs on the order of tasks
    assert confirmed.count() == sum(1 for x in shared if sum(x in t.split("\n") for _, t in docs) >= 5)
    assert by_id(line_dedup.dedupe_lines(df), "n_lines", "n_dropped", "text") == want


def test_passages_beyond_the_filter(odd):  # noqa: F811
    want = brute.passages(with_ids())
    assert by_id(substring_dedup.remove_repeats(odd, digest=False, filter_keys=0), "n_words", "n_removed", "kept_text") == want


# Decontamination


@pytest.mark.parametrize("block_bytes", [1 << 26, 1500])
def test_rows_with_one_id_are_judged_apart(spark, block_bytes):
    docs = [(7, "alpha beta gamma tail"), (7, "plain words only here"), (None, "alpha beta gamma"), (None, "nothing"), (None, "delta eps zeta eta"), (None, None), (8, ""), (7, "alpha beta gamma tail")]
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta eps zeta")], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontaminate.decontaminate(df, items, block_bytes=block_bytes).collect()
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in found)
    assert got == sorted([(7, 4, 3, 1, True), (7, 4, 0, 0, False), (-1, 3, 3, 1, True), (-1, 1, 0, 0, False), (-1, 4, 3, 1, True), (-1, 0, 0, 0, False), (8, 0, 0, 0, False), (7, 4, 3, 1, True)])
    kept = sorted((r["doc_id"] or -1, r["text"] or "") for r in decontaminate.drop_contaminated(df, items, block_bytes=block_bytes).collect())
    assert kept == sorted([(7, "plain words only here"), (-1, "nothing"), (-1, ""), (8, "")])


def test_many_blocks_and_an_empty_benchmark(spark, tables):
    whole = by_id(decontaminate.decontaminate(tables["documents"], tables["benchmark"]), "n_hit", "n_items", "items_sha256")
    assert by_id(decontaminate.decontaminate(tables["documents"], tables["benchmark"], block_bytes=200_000), "n_hit", "n_items", "items_sha256") == whole
    none = decontaminate.decontaminate(tables["documents"], tables["benchmark"].where("false"))
    assert none.where("n_hit > 0 or contaminated").isEmpty() and none.count() == tables["documents"].count()


# Packing and tokenizers


def test_both_libraries_agree_on_plain_texts():
    rng = random.Random(11)
    plain = [chr(c) for c in range(0x20, 0x500) if not packing.PLAIN.search(chr(c))] + ["\n", "\t", " ", "'s", "'ll", "  ", "12", "The ", " a"]
    encode = packing.Encoder(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for _ in range(3000):
        text = "".join(rng.choice(plain) for _ in range(rng.randrange(60)))
        assert encode.fast.encode_ordinary(text) == encode.exact.encode(text, add_special_tokens=False).ids


def test_long_white_space_is_encoded():
    encode = packing.Encoder(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for text in (" " * 1_000_000, "a" + "\n \t" * 300_000 + "b"):
        assert encode(text).tolist() == encode.exact.encode(text, add_special_tokens=False).ids


def test_salts_follow_the_counts(spark):
    """A length that holds most pieces, equal rows among them, is ranked in parts, and every piece has its place."""
    rows = [(i % 7, 0, 0, 2048 if i % 3 else 5 + i % 11, 9, i) for i in range(3000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, deal long")
    placed = packing.place(pieces, salt_rows=100).collect()
    assert len(placed) == 3000
    held: dict = {}
    for r in placed:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r[3] for r in rows)
    assert len(held) <= -(-total // 2048) + 1


@pytest.mark.parametrize("text", ["日本語テキスト" * 40_000, "日本語のテキスト。これは文です、" * 12_000, "no-spaces/here?x=1&y=2" * 12_000])
def test_huge_texts_without_spaces(text):
    tokenizer = token_counts.load_tokenizer(tokenizer_path("word_bpe_49k.json"))
    start = time.perf_counter()
    want = len(tokenizer.encode(text, add_special_tokens=False).ids)
    once = time.perf_counter() - start
    start = time.perf_counter()
    assert token_counts.count_huge(tokenizer, text) == want
    assert time.perf_counter() - start <= 1.5 * once + 0.3


def test_chunks_of_mixed_text_are_spliced_exactly():
    tokenizer = token_counts.load_tokenizer(tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(2)
    signs = [*"ab Z9'’.,!<|>\n日本가が゙éÉе́ä-st  １٣ﬁͅ", "<|endoftext|>", "<|startoftext|>", "'s", "'ll", "'re", " "]
    for _ in range(400):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(30, 400)))
        want = len(tokenizer.encode(text, add_special_tokens=False).ids)
        for chunk, overlap in ((16, 3), (40, 9)):
            assert token_counts.count_huge(tokenizer, text, chunk, overlap) == want, text


# Models


def test_quality_scores_are_those_of_plain_numpy(tables):
    docs, marks = rows_of(tables), {r["doc_id"]: r["quality"] for r in tables["labels"].collect()}
    held = {r["doc_id"] for r in tables["documents"].where(held_out()).collect()}
    x = {i: quality.statistics((t or "").encode()) for i, t in docs}
    classes = [np.array([x[i] for i, _ in docs if i not in held and marks.get(i) == c]) for c in (0, 1)]
    pooled = sum((c - c.mean(axis=0)).T @ (c - c.mean(axis=0)) for c in classes) / sum(map(len, classes))
    density = []
    for c in classes:
        own = (1 - quality.POOLED) * np.cov(c.T, bias=True) + quality.POOLED * pooled
        own = (1 - quality.DIAGONAL) * own + quality.DIAGONAL * np.diag(np.diag(own)) + quality.RIDGE * np.eye(len(own))
        density.append(lambda v, m=c.mean(axis=0), s=own: -0.5 * ((v - m) @ np.linalg.solve(s, v - m) + np.linalg.slogdet(s)[1]))
    odds = np.log((len(classes[1]) + 0.5) / (len(classes[0]) + 0.5))
    want = {i: 1 / (1 + np.exp(-np.clip(quality.TEMPER * (density[1](v) - density[0](v)) + odds, -30, 30))) for i, v in x.items()}
    got = by_id(quality.score_quality(tables["documents"], tables["labels"]), "score", "predicted", "held_out")
    assert all(abs(got[i][0] - w) < 1e-6 and got[i][1] == int(got[i][0] >= 0.3) and got[i][2] == (i in held) for i, w in want.items())


def test_quality_of_odd_rows(odd, empty, labels):  # noqa: F811
    scores = by_id(quality.score_quality(odd, labels), "score")
    assert all(0 <= s <= 1 for (s,) in scores.values()) and scores[0] == scores[1]
    alone = quality.score_quality(odd, labels.where("false"))
    assert {r["score"] for r in alone.collect()} == {0.5} and quality.keep_good(empty, labels).count() == 0


def test_languages_are_those_of_a_plain_scorer(tables):
    docs = tables["documents"]
    learnt = [(r["text"], r["lang"]) for r in docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).collect()]
    want = brute.language(rows_of(tables), learnt)
    got = {i: v[0] for i, v in by_id(language_id.identify(docs, language_id.fit(docs)), "lang_pred").items()}
    assert got == want


def test_samples_keep_rare_languages_and_all_words(spark):
    rows = [(i, f"the quick fox number{i} runs", "en") for i in range(3000)] + [(5000 + i, "der schnelle fuchs rennt", "de") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few = language_id.sample(docs.where(~held_out()), sample_bytes=4000)
    assert {r["lang"] for r in few.select("lang").distinct().collect()} == {"en", "de"} and few.count() < 400
    huge = language_id.sample(docs.where(~held_out()), sample_bytes=1)  # as if the table were a thousand million times as large
    assert {r["lang"]: r["n"] for r in huge.groupBy("lang").agg(F.count("*").alias("n")).collect()} == {"en": 1, "de": 1}
    model = language_id.fit(docs)
    assert {"fuchs", "rennt", "runs", "number"} <= set(model.words)
    assert {r["lang_pred"] for r in language_id.identify(docs.where("lang = 'de'"), model).collect()} == {"de"}


def test_odd_rows_have_their_language(odd, empty):  # noqa: F811
    found = by_id(language_id.identify(odd, language_id.fit(odd)), "lang_pred", "score")
    assert {found[i] for i in (0, 1, 2, 9)} == {("und", 0.0)} and all(0 < found[i][1] <= 1 for i in (3, 4, 8, 11))
    assert {r["lang_pred"] for r in language_id.identify(odd, language_id.fit(empty)).collect()} == {"und"}


def test_kept_by_rules_is_that_of_plain_em(tables, odd):  # noqa: F811
    for docs, rows in ((tables["documents"], rows_of(tables)), (odd.where("doc_id is not null"), with_ids())):
        want = dict(zip([i for i, _ in rows], brute.kept_by_rules(rows), strict=True))
        assert by_id(quality_rules.apply_rules(docs), "base_failed", "kept") == want


def test_rules_may_be_found_wrong():
    """A rule that votes against the others ends with its true rates, which no bound hides."""
    rng = random.Random(1)
    patterns: dict = {}
    for _ in range(4000):
        good = rng.random() < 0.7
        votes = [int((rng.random() < 0.95) == good) for _ in quality_rules.RULES]
        votes[0] = int((rng.random() < 0.8) != good)
        patterns[tuple(votes)] = patterns.get(tuple(votes), 0) + 1
    shares, rates = quality_rules.estimate(list(patterns.items()))
    assert abs(shares[0] - 0.7) < 0.05 and rates[0][0] < 0.3 and rates[0][1] > 0.9


# Pipeline


def copies(spark):
    text = "one and the same text in several rows of the table, long enough to be told apart"
    rows = [(8, text, "a"), (8, text, "b"), (9, text, "c"), (None, text, "d"), (None, "another text without an id", "e"), (None, "another text without an id", "f"), (10, "alone", "g"), (None, None, "h"), (11, "", "i")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long"), "hash": F.lit(1), "_row_key": F.lit("x")})


def test_one_row_of_each_group_stays(spark):
    kept = simhash.keep_one(copies(spark)).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept) == sorted([(8, copies(spark).first()["text"]), (-1, "another text without an id"), (10, "alone"), (11, "")])
    assert simhash.keep_one(copies(spark).where("false")).count() == 0


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, odd, empty, data_dir, stage):  # noqa: F811
    run = dict(corpus_pipeline.STAGES)[stage]
    for docs in (odd, copies(spark)):
        docs = docs.drop("n_lines")
        found = run(spark, docs, data_dir)
        if stage == "packing":
            assert found.where("piece = 0").count() == docs.count()
            continue
        assert found.columns == docs.columns and found.count() <= docs.count()
        if stage == "line_dedup":
            assert found.count() == docs.count() and found.where("n_chars <> length(text)").isEmpty()
    assert run(spark, empty.drop("n_lines"), data_dir).count() == 0


def test_run_on_odd_rows(spark, odd, data_dir, tmp_path):  # noqa: F811
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{data_dir}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    placed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 0 < len({r["doc_id"] for r in placed}) <= len(texts())
