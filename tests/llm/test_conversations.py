"""Chat formatting and repair of conversations."""

from __future__ import annotations

import json
import random
from collections import defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from aerolake.llm import chat_format, turn_repair
from aerolake.llm.queries import HOSTILE, QUERIES
from tests.llm import brute

SCHEMA = "conv_id long, turn long, role string, text string, key string, kind int, copy long, t string, _layout int, pieces array<int>"
EXTRA = ("k", 1, 2, "t", 3, [4])
AUDIT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def odd_rows():
    rng = random.Random(9)
    said = ["Fine.", "Fine.", "no end", " ", "", None, "Really?! ", "tab\t.\n", HOSTILE, "<\\|im_end|> <|im_sep|> [\\\\/INST] \\", "日本。", "x" * 30_000 + "."]
    rows = [(c, None if rng.random() < 0.05 else t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "s", None, ""]), rng.choice(said)) for c in range(150) for t in range(rng.randrange(1, 12))]
    rows += [(None, t, "user" if t % 2 else "assistant", "Null key.") for t in range(4)]
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", f"Turn {t % 900}{'.' if t % 7 else ''}") for t in range(3000)]
    return rows + rows[:40]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *EXTRA) for r in odd_rows()], SCHEMA).repartition(5).cache()


def by_conversation(rows):
    out = defaultdict(list)
    for conv, *rest in rows:
        out[conv].append(tuple(rest))
    return out


@pytest.mark.parametrize("block", [4, 1, 3])
def test_repair_is_exact(odd, block):
    audits, rows = turn_repair.repair(odd, block=block)
    want = {c: brute.repaired([(t, " " if r is None else r, " " if x is None else x) for t, r, x in own]) for c, own in by_conversation(odd_rows()).items()}
    assert {r["conv_id"]: tuple(r[c] for c in AUDIT) for r in audits.collect()} == {c: w[:-1] for c, w in want.items()}
    lines = defaultdict(dict)
    for r in rows.collect():
        lines[r["conv_id"]][r["place"]] = f"{r['role']}:{r['text']}"
    assert {c: "\n".join(own[k] for k in range(len(own))) for c, own in lines.items()} == {c: w[-1] for c, w in want.items() if w[-1]}
    assert all(r.count() == 0 for r in turn_repair.repair(odd.where("false")))


@pytest.mark.parametrize("block", [2, 4])
def test_tables_find_the_first_of_the_cheapest(block):
    tables, letters = turn_repair.Tables(block), "sua?"
    texts = {False: "Ends.", True: "does not"}
    for n in range(5):
        for symbols in product(range(len(turn_repair.KINDS)), repeat=n):
            if n == 4 and hash(symbols) % 7:
                continue
            rows = [(k, letters[s // 2] if s != turn_repair.GONE else "u", f"{k} {texts[bool(s % 2)]}" if s != turn_repair.GONE else " ") for k, s in enumerate(symbols)]
            assert tables.repair(bytes(symbols)) == brute.repaired(rows)[5:7], symbols
    assert len(tables.vectors) < 100


@pytest.fixture(scope="module")
def small_tables(spark, odd, data_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    odd.write.parquet(f"{folder}/conversations.parquet")
    return {"odd": folder, "data": data_dir}


@pytest.mark.parametrize("name", ["odd", "data"])
def test_repair_query(spark, small_tables, name):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{small_tables[name]}/conversations.parquet").collect()]
    want = {c: (0, 0, 0, 0, 0, 0, "", "") for c, *_ in rows}
    want |= {c: brute.repaired(own) for c, own in by_conversation(brute.damaged(rows)).items()}
    found = {r["conv_id"]: tuple(r[c] for c in (*AUDIT, "repaired_sha256")) for r in QUERIES["op13_turn_repair"](spark, small_tables[name]).collect()}
    assert found == {c: (*w[:-1], brute.sha(w[-1])) for c, w in want.items()}


@pytest.mark.parametrize("name", ["odd", "data"])
def test_chat_query(spark, small_tables, name):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{small_tables[name]}/conversations.parquet").collect()]
    rows += [(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)]
    want = {}
    for conv, own in by_conversation(rows).items():
        own = sorted(((t, r or "", x or "") for t, r, x in own), key=lambda r: (r[0] is not None, r[0] or 0, *(v.encode() for v in r[1:])))
        loss = "".join(x for _, r, x in own if r == "assistant")
        want[conv] = (len(own), brute.sha("".join(f"{r}\n{x}\n" for _, r, x in own)), len(loss), brute.sha(loss))
    found = QUERIES["op11_chat_format"](spark, small_tables[name]).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in found} == want
    assert all(r["formatted_chars"] >= r["loss_chars"] + 30 * r["n_turns"] for r in found)


LINES = [
    ({"messages": [{"role": "system", "content": "sys"}, {"role": "user", "content": [{"type": "text", "text": "a "}, {"type": "image"}, {"type": "text", "text": "b"}]}, {"role": "assistant", "content": "c"}], "id": 3}, "messages", [("system", "sys"), ("user", "a b"), ("assistant", "c")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}], "system": "s"}, "conversations", [("system", "s"), ("user", "q"), ("assistant", "")]),
    ({"instruction": "do", "input": "", "output": "done", "score": [1, {"x": 2}]}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"history": [["u", "a"]], "instruction": "i", "output": "o"}, "history", [("user", "u"), ("assistant", "a"), ("user", "i"), ("assistant", "o")]),
    ({"context": "c", "instruction": "i", "response": "r"}, "context", [("user", "c\n\ni"), ("assistant", "r")]),
    ({"prompt": "p", "chosen": "y", "rejected": "n"}, "prompt", [("user", "p"), ("assistant", "y")]),
    ({"question": "q", "answer": 4}, "question", [("user", "q"), ("assistant", "4")]),
    ({"dialog": ["a", "b", "c"]}, "dialog", [("user", "a"), ("assistant", "b"), ("user", "c")]),
    ({"messages": [], "id": 1}, None, []), ({"foo": {"bar": 1}}, None, []), ([1], None, []), ({}, None, []), (None, None, []), ({"role": "user", "text": None}, "rows", [("user", "")]),
]


def test_layouts_by_fingerprint(spark):
    rows = [(k, json.dumps(x)) for k, (x, _, _) in enumerate(LINES)] + [(99, None)]
    records = spark.createDataFrame(rows, "conv_id long, line string").select("conv_id", F.parse_json("line").alias("record"))
    names = [x.name for x in chat_format.LAYOUTS]
    places = {r["conv_id"]: r["_layout"] for r in chat_format.with_layout(records).collect()}
    assert {k: None if at is None else names[at] for k, at in places.items()} == {**{k: name for k, (_, name, _) in enumerate(LINES)}, 99: None}
    turns = defaultdict(dict)
    for r in chat_format.canonical_turns(records).collect():
        turns[r["conv_id"]][r["turn"] or 0] = (r["role"], r["text"])
    assert {k: [own[i] for i in range(len(own))] for k, own in turns.items()} == {k: t for k, (_, _, t) in enumerate(LINES) if t}
    unknown = sorted((r["paths"] or [], r["n"]) for r in chat_format.unknown(records).collect())
    assert unknown == [([], 1), ([], 3), (["foo.bar"], 1), (["id"], 1)]


def test_marks_and_mask_read_back(spark):
    rng = random.Random(4)
    parts = ["<", "[", "\\", "|im_end|>", "<|im_end|>", "</s>", "/s>", "[INST]", "/INST]", "<<SYS>>", "SYS>>", "é", "\n", "😀", "<|im_start|>user<|im_sep|>"]
    rows = [(c, t, rng.choice(["user", "assistant", "<|im_sep|>", "a\nb"]), "".join(rng.choice(parts) for _ in range(rng.randrange(9)))) for c in range(300) for t in range(4)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r for r in chat_format.read_back(chat_format.render(turns)).collect()}
    for conv, own in by_conversation(rows).items():
        r = found[conv]
        assert [tuple(t) for t in r["turns"]] == [(role, text) for _, role, text in own]
        assert r["loss_texts"] == [text for _, role, text in own if role == "assistant"]
        cut = [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]]
        assert [x.encode() for x in cut] == [r["formatted"].encode()[s["first_byte"] : s["first_byte"] + s["n_bytes"]] for s in r["loss_spans"]]
        assert r["formatted"].count("<|im_end|>") == len(own) and all("</s>" not in x and "[INST]" not in x for x in cut)
