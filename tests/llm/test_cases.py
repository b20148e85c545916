"""Odd inputs: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from aerolake.llm import decontaminate, language_id, license_scan, line_dedup, packing, quality, quality_rules, simhash, substring_dedup, token_counts
from aerolake.llm.queries import tokenizer_path
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keys string, n int, fp long, x array<double>, position int, score double, mask long, marked boolean, words string, n_lines long"
PASSAGE = " ".join(f"w{i}x{i * i % 97}" for i in range(70))
LINE = "This very line stands in many a document, as notices do."
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def texts():
    long = " ".join(f"Long{i % 5000} wordé{i % 17}," + ("\n" if i % 40 == 0 else "") for i in range(30_000))
    rows = [
        (0, None), (1, ""), (2, " \n \n\t"), (3, long), (4, f"{PASSAGE}\n{LINE}\nend"), (5, f"start here {PASSAGE} and more"), (6, f"start here {PASSAGE} and more"),
        (7, f"a b {ITEM}, c d"), (8, "Short one"), (9, "###!!! ||| 123"), (10, "日本語 テキスト Ünïcode straße ǅ ﬁ"), (None, f"{LINE}\nwithout an id"), (11, "x" * 70_000), (12, "<|endoftext|> and <|startoftext|> are words"),
        *((20 + i, f"{LINE}\nNumber {i} of the documents that share it.\n  {LINE.upper()}  ") for i in range(6)),
        *((40 + i, f"{PASSAGE} tail {'same' if i < 3 else 'other'} words follow here") for i in range(4)),
        (8, "Short one"), (41, f"{PASSAGE} tail same words follow here"),
    ]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    extra = ("k", 1, 2, [1.0], 3, 0.5, 4, True, "w", 9)
    return spark.createDataFrame([(i, t, [None, "en", "de"][k % 3], None, None, *extra) for k, (i, t) in enumerate(texts())], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, q, 0) for i, q in [(1, 1), (4, 1), (5, 1), (7, 1), (20, 1), (21, 0), (9, 0), (11, 0), (3, None), (None, 1), (5, 1)]], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, ITEM), (2, "short ONE"), (3, None), (4, ""), (None, "Number"), (5, ITEM)], "item_id long, text string")


def pack(docs):
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def operators(labels, benchmark):
    return {
        "packing": pack,
        "decontamination": lambda d: decontaminate.decontaminate(d, benchmark),
        "quality": lambda d: quality.score_quality(d, labels),
        "language": lambda d: language_id.identify(d, language_id.fit(d)),
        "simhash": simhash.near_duplicates,
        "tokens": lambda d: token_counts.count_tokens(d, tokenizer_path("word_bpe_49k.json")),
        "rules": quality_rules.apply_rules,
        "lines": lambda d: line_dedup.dedupe_lines(d, digest=True),
        "licenses": license_scan.scan_licenses,
        "passages": substring_dedup.remove_repeats,
    }


NAMES = list(operators(None, None))


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_all_come_back(odd, empty, labels, benchmark, name):
    run = operators(labels, benchmark)[name]
    rows = run(odd).collect()
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows if name != "packing" or r["piece"] == 0)
    assert ids == sorted((i is None, i or 0) for i, _ in texts())
    assert run(empty).count() == 0


def with_ids():
    return [(i, t) for i, t in texts() if i is not None]


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect() if r["doc_id"] is not None}


def test_decontamination_is_exact(odd, benchmark):
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = brute.contamination(with_ids(), items)
    assert by_id(decontaminate.decontaminate(odd, benchmark), *columns) == want
    blocks = decontaminate.decontaminate(odd, benchmark, block_bytes=1500)
    assert by_id(blocks, *columns) == want
    assert blocks.count() == len(texts())


def test_removed_spans():
    assert decontaminate.remove_spans("One, two three; four", [(1, 3)]) == "One, ; four"


@pytest.mark.parametrize("limit", [10**6, 0])
def test_lines_are_exact(odd, limit):
    want = brute.lines(with_ids())
    found = line_dedup.dedupe_lines(odd, broadcast_keys=limit)
    assert by_id(found, "n_lines", "n_dropped", "text") == want
    assert {c for c in odd.columns if c != "n_lines"} < set(found.columns)
    assert by_id(line_dedup.dedupe_lines(odd, digest=True, broadcast_keys=limit), "kept_sha256") == {i: (brute.sha(v[2]),) for i, v in want.items()}


@pytest.mark.parametrize("limit", [10**6, 0])
def test_passages_are_exact(odd, limit):
    want = brute.passages(with_ids())
    assert any(v[1] for v in want.values())
    assert by_id(substring_dedup.remove_repeats(odd, digest=False, broadcast_ranges=limit), "n_words", "n_removed", "kept_text") == want


@pytest.mark.parametrize("limit", [10**6, 0])
def test_texts_under_one_id_are_documents_of_their_own(spark, limit):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (3, a), (3, b), (3, f"tail {a}"), (3, f"{c} {a[3:]}"), (9, b), (9, c), (9, f"one {c}")]
    found = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), digest=False, broadcast_ranges=limit)
    got = sorted((r["doc_id"], r["n_removed"], r["kept_text"]) for r in found.collect())
    assert got == sorted([(1, 0, a), (3, 60, ""), (3, 0, b), (3, 60, "tail"), (3, 59, c), (9, 60, ""), (9, 60, ""), (9, 60, "one")])


def test_cover_shares_an_anchor_at_every_offset():
    cover = set(substring_dedup.COVER)
    for i in range(substring_dedup.PERIOD):
        assert any(d % substring_dedup.PERIOD in cover and (d + i) % substring_dedup.PERIOD in cover for d in range(substring_dedup.PERIOD))


def test_simhash_is_exact(odd):
    prints = [(i, brute.simhash(t)) for i, t in with_ids()]
    want = brute.components(prints)
    assert by_id(simhash.near_duplicates(odd), "fingerprint", "component_id") == {i: (f"{f:016x}", want[i]) for i, f in prints}


@pytest.mark.parametrize("leaf_group", [1024, 4])
def test_simhash_links_near_fingerprints(spark, leaf_group):
    import random

    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    fps = {s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ ((1 << rng.randrange(64)) if rng.random() < 0.5 else 0) for s in seeds for _ in range(6)} | set(seeds)
    prints = list(enumerate(sorted(fps)))
    nodes = spark.createDataFrame([(simhash.as_long(f), i) for i, f in prints], "fp long, name long")
    roots = {r["node"]: r["root"] for r in simhash.stars(simhash.links(nodes, leaf_group=leaf_group)).collect()}
    assert {i: roots.get(i, i) for i, _ in prints} == brute.components(prints)


def test_chains_become_one_component(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "u long, v long")
    roots = {r["node"]: r["root"] for r in simhash.stars(edges).collect()}
    assert roots == {i: 0 for i in range(1, n + 1)} | {101: 100}


def test_token_counts_are_the_tokenizers(odd):
    tokenizer = token_counts.load_tokenizer(tokenizer_path("word_bpe_49k.json"))
    want = {i: (len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in with_ids()}
    found = token_counts.count_tokens(odd, tokenizer_path("word_bpe_49k.json"), huge_chars=1000, chunk_chars=600, overlap_chars=20)
    assert by_id(found, "n_bytes", "n_tokens") == want


@pytest.mark.parametrize("text", ["no spaces" * 400, "a" * 5000, "é́" * 900, "word " * 900, "x<|endoftext|>" * 300, " \n" * 700 + "end", "it's we'll " * 300])
def test_chunks_splice_to_the_whole(text):
    tokenizer = token_counts.load_tokenizer(tokenizer_path("word_bpe_49k.json"))
    want = len(tokenizer.encode(text, add_special_tokens=False).ids)
    for chunk, overlap in ((64, 8), (301, 17), (1000, 200)):
        assert token_counts.count_huge(tokenizer, text, chunk, overlap) == want


def test_pieces_pack_without_gaps(odd):
    import zlib

    import numpy as np

    rows = pack(odd).collect()
    tokenizer = token_counts.load_tokenizer(tokenizer_path("byte_bpe_50k.json"))
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in with_ids()}
    places = {}
    for r in rows:
        if r["doc_id"] is not None:
            part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and len(part) == r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.MAX_LEN
    assert len(places) <= -(-sum(r["length"] for r in rows) // packing.MAX_LEN) + 1


def test_plan_is_best_fit_and_complete():
    import random

    rng = random.Random(3)
    counts = {rng.randrange(1, 101): rng.randrange(1, 200) for _ in range(60)}
    seen: dict = {}
    used: dict = {}
    for length, low, high, first, each, base in packing.plan_best_fit(counts, 100):
        for rank in range(low, high):
            sequence, offset = first + (rank - low) // each, base + (rank - low) % each * length
            assert (length, rank) not in seen
            seen[length, rank] = sequence
            used.setdefault(sequence, []).append((offset, length))
    assert len(seen) == sum(counts.values())
    for own in used.values():
        assert [o for o, _ in sorted(own)] == [sum(x for _, x in sorted(own)[:k]) for k in range(len(own))]
        assert sum(x for _, x in own) <= 100
    free: list[int] = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fits = [i for i, f in enumerate(free) if f >= length]
        if fits:
            free[min(fits, key=free.__getitem__)] -= length
        else:
            free.append(100 - length)
    assert len(used) == len(free)


def test_rule_counts_are_exact(odd):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert by_id(quality_rules.apply_rules(odd), *columns) == {i: brute.rules_base(t) for i, t in with_ids()}


def test_models_hold_out(spark, data_dir):
    docs, labels = (spark.read.parquet(f"{data_dir}/{n}.parquet") for n in ("documents", "labels"))
    scored = quality.score_quality(docs, labels).join(labels, "doc_id")
    assert scored.where("predicted = quality").count() >= 0.97 * scored.count()
    found = language_id.identify(docs, language_id.fit(docs)).where("held_out").join(docs, "doc_id")
    assert found.where("lang = lang_pred").count() >= 0.95 * found.count()
    assert found.where("score < 0 or score > 1").isEmpty()
    kept = quality_rules.apply_rules(docs).drop("quality").join(labels, "doc_id")
    assert kept.where("quality = 1 and not base_failed and not kept").isEmpty()


def test_held_out_labels_change_nothing(spark, data_dir):
    docs, labels = (spark.read.parquet(f"{data_dir}/{n}.parquet") for n in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert by_id(quality.score_quality(docs, labels), "score") == by_id(quality.score_quality(docs, turned), "score")


def test_licenses_are_found_and_confirmed(spark):
    texts = {
        1: "Some words.\nLicensed under the Apache License, Version 2.0.", 2: "Released under the MIT License.\nLicensed under CC BY-NC 4.0.", 3: "The licence of the bar was granted under the law of the land.",
        4: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", 5: None, 6: "licensed under",
    }
    found = license_scan.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r["doc_id"]: (r["licenses"], r["n_paragraphs"]) for r in found.collect()} == {1: (["apache-2.0"], 2), 2: (["cc-by-nc", "mit"], 2), 3: ([], 1), 4: (["agpl-3.0"], 1), 5: ([], 0), 6: ([], 1)}


def test_wrapped_and_joined_licenses_are_found(spark):
    fsf = "This {} is free software; you can redistribute it and/or\nmodify it under the terms of the GNU{} General Public\nLicense as published by the Free Software Foundation; either\nversion 3 of the License, or (at your option) any later version."
    texts = {
        1: "/*\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:\n *\n * 1. Keep this.\n */",
        2: "# Permission to use, copy, modify, and/or distribute this software for any\n# purpose with or without fee is hereby granted, provided that the above\n# copyright notice appears.",
        3: fsf.format("library", " Lesser"), 4: fsf.format("program", ""), 5: fsf.format("program", " Affero"),
        6: "Licensed under the MIT License or the Apache License, Version 2.0, at your option", 7: "Released under the BSD License. Parts: Licensed under the Apache License, Version 2.0. " + "More words. " * 500 + "Licensed under CC BY 4.0",
        8: "Released under the\n\nMIT License", 9: "Released under the ISC License.\nReleased under the ISC License.",
    }
    found = license_scan.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r["doc_id"]: (r["licenses"], r["paragraphs"]) for r in found.collect()} == {
        1: (["bsd"], [1]), 2: (["isc"], [0]), 3: (["lgpl"], [0]), 4: (["gpl"], [0]), 5: (["agpl-3.0"], [0]), 6: (["apache-2.0", "mit"], [0]), 7: (["apache-2.0", "bsd", "cc-by"], [0]), 8: ([], []), 9: (["isc"], [0, 1]),
    }


def test_pipeline_by_hand(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, data_dir)
    assert good.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in good.collect()}
    rejected = {r["doc_id"] for r in quality.score_quality(docs, spark.read.parquet(f"{data_dir}/labels.parquet")).where("predicted = 0").collect()}
    assert rows.keys() == {r["doc_id"] for r in docs.collect()} - rejected
    rows = {i: v[2] for i, v in brute.lines(list(rows.items())).items()}
    roots = brute.components([(i, brute.simhash(t)) for i, t in rows.items()])
    rows = {i: t for i, t in rows.items() if roots[i] == i}
    judged = brute.contamination(list(rows.items()), items)
    rows = {i: t for i, t in rows.items() if not judged[i][4]}
    tokenizer = token_counts.load_tokenizer(tokenizer_path("byte_bpe_50k.json"))
    want = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows.items()}
    packed = corpus_pipeline.run(spark, data_dir).groupBy("doc_id").agg(F.sum("length").alias("n"))
    assert {r["doc_id"]: r["n"] for r in packed.collect()} == want


@pytest.mark.parametrize("ranges", [1, 64])
def test_ranges_of_hashes_side_by_side_change_nothing(odd, monkeypatch, ranges):
    step = (1 << 64) // ranges
    monkeypatch.setattr(line_dedup.bloom, "ranges", lambda *_: [(k * step - (1 << 63), (k + 1) * step - 1 - (1 << 63)) for k in range(ranges)])
    want = brute.lines(with_ids())
    assert by_id(line_dedup.dedupe_lines(odd), "n_lines", "n_dropped", "text") == want


def test_both_encoders_agree_at_the_borders_of_their_alphabet():
    import random

    rng = random.Random(11)
    encode = packing.Encoder(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    borders = "ÀÖØöøſΑΡΣΩαωАяаё ~!09AZaz\t\n\r"
    texts = [f"a{c * n}b" for n in (498, 499, 500, 501) for c in (" ", "\n", "\t ", " \n")]
    texts += ["".join(rng.choice(borders) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    fast = 0
    for text in texts:
        want = encode.exact.encode(text, add_special_tokens=False).ids
        assert encode(text).tolist() == want, text
        fast += packing.PLAIN.search(text) is None
    assert fast > 1000


@pytest.mark.parametrize(("good", "bad", "fails", "share"), [(0.9, 0.5, 0.3, 0.7), (0.97, 0.7, 0.1, 0.9)])
def test_the_verdicts_survive_another_start(spark, data_dir, monkeypatch, good, bad, fails, share):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    before = by_id(quality_rules.apply_rules(docs), "kept")
    for name, value in (("GOOD", good), ("BAD", bad), ("FAILS", fails), ("SHARE", share)):
        monkeypatch.setattr(quality_rules, f"START_{name}", value)
    after = by_id(quality_rules.apply_rules(docs), "kept")
    # The start counts for ten votes a rule, which a corpus of 200 texts still feels.
    assert sum(before[i] != after[i] for i in before) <= 0.02 * len(before)


def test_a_pipeline_leaves_its_last_table_alone(spark, data_dir):
    import os

    docs = spark.read.parquet(f"{data_dir}/documents.parquet").limit(40)
    from aerolake.llm.common import materialize, release, shared_folder, written_tables

    where = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(where))
    with written_tables() as own:
        last = materialize(simhash.keep_one(docs))
    assert len(own) > 2 and len(set(os.listdir(where)) - before) >= 2
    release(*(t for t in own if t is not last))
    assert len(set(os.listdir(where)) - before) == 1 and last.count() > 0


def test_stages_keep_columns_whose_names_clash(spark, odd, data_dir):
    extra = {"n_lines": 7, "n_dropped": 8, "_same_text": 9, "_row_id": 10, "_row_key": 11, "keys": 12, "marked": 13, "hash": 14, "score": 15}
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").withColumns({c: F.lit(v) for c, v in extra.items()})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, data_dir)
        assert kept.columns == docs.columns, name
        assert [tuple(r) for r in kept.select(*extra).distinct().collect()] in ([tuple(extra.values())], []), name
