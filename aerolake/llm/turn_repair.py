"""Operator 13: repair of damaged conversations at least cost, by block tables.

A row is kept (0; 3 more if its text is truncated), given the role user or assistant (3, and 3 more if truncated), or deleted (4; the only way for blank
and duplicate rows); an empty row of user or assistant may be put in anywhere (3). What is left must have role initials
``(s?(ua)+)?``. Of the cheapest ways the one whose letters (K, R, D, I in order) sort first is taken.

1. A row is one of nine symbols: its initial (s, u, a, other) and whether it is truncated, or that it must go. Four states say what came
   before: nothing, s, u, a. A cost vector says what the rest costs from each state; less its least number it is one of a few normalised vectors.
2. ``Tables``, the method of the four Russians: from the transitions of single symbols, found by walking from the final vector until no
   new vector appears, the transitions of every block of ``BLOCK`` symbols are composed: (vector behind it, block) to (vector before it, added cost).
3. A conversation goes through the table from its end to its start, a lookup for each block; the vector behind each block stays.
4. Then blocks are expanded from front to back: within a block the vectors at each of its rows, again from its end; at every state the first
   letter among D, I, K, R that keeps the cost. No tie is lost, because the vectors say what is still to come; equal letters lead to equal states. Expanded
   blocks are remembered by (vector, block, state).

Spark does the rest: one shuffle of short rows (no text) marks duplicates, one by conversation streams them in order and holds a
byte for each row of a conversation; the decisions come back as one letter string, put in front of the conversation's texts in a third shuffle, and
these are hashed or written row by row. So the texts of a conversation never meet in memory.

Rows of a conversation are ordered by turn (nulls first), then role and text hash. Null roles and texts are one space. Repeated rows are
duplicates. Rows without a key are one conversation. Extra columns are dropped. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolake.llm.common import SPACE, materialize

BLOCK = 4
#: Costs of the edits; fixed values.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: State after emitting each initial from each state (nothing, s, u, a); states where a conversation may end.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
EMIT = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
FINAL = (START, AFTER_A)
#: Symbols: initial and truncation of rows that may stay; the last one must go.
KINDS = [*product("sua?", (False, True)), None]
GONE = len(KINDS) - 1
NEVER = 1 << 20
NAMES = {"u": "user", "a": "assistant"}


def expected(state: int) -> str:
    """The initial that a new or renamed row gets in a state."""
    return "a" if state == AFTER_U else "u"


def with_inserts(costs: list[int]) -> tuple[int, ...]:
    """``costs`` of the states, where empty rows may be put in first."""
    best = list(costs)
    for _ in range(3):
        best = [min(own, INSERT + best[EMIT[expected(q)][q]]) for q, own in enumerate(best)]
    return tuple(best)


def choices(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done with a row."""
    yield "D", DELETE, state
    if symbol != GONE:
        initial, truncated = KINDS[symbol]
        if state in EMIT.get(initial, ()):
            yield "K", TRUNCATED * truncated, EMIT[initial][state]
        yield "R", REROLE + TRUNCATED * truncated, EMIT[expected(state)][state]


def before(symbol: int, behind: tuple[int, ...]) -> tuple[int, ...]:
    """Costs of the states before a row, from those behind it."""
    return with_inserts([min(cost + behind[then] for _, cost, then in choices(symbol, q)) for q in range(4)])


class Tables:
    """Normalised cost vectors, their transitions by single symbols and by whole blocks."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.vectors, self.number = [], {}
        end = with_inserts([0 if q in FINAL else NEVER for q in range(4)])
        self.last, _ = self.known(end)
        one: list[list[tuple[int, int]]] = []
        while len(one) < len(self.vectors):
            one.append([self.known(before(s, self.vectors[len(one)])) for s in range(len(KINDS))])
        self.one = np.array(one, np.int64)
        to, cost = np.arange(len(self.vectors))[:, None], np.zeros((len(self.vectors), 1), np.int64)
        for _ in range(block):
            # A block's first symbol is its highest digit; it is read last, for costs come from behind.
            then, added = self.one[:, :, 0][to], self.one[:, :, 1][to] + cost[:, :, None]
            to, cost = (x.transpose(0, 2, 1).reshape(len(self.vectors), -1) for x in (then, added))
        self.to, self.cost = to, cost
        self.expanded = lru_cache(1 << 18)(self.expand)

    def known(self, costs: tuple[int, ...]) -> tuple[int, int]:
        """The number of a vector's normalised form, and what was taken from it."""
        low = min(costs)
        form = tuple(c - low for c in costs)
        if form not in self.number:
            self.number[form] = len(self.vectors)
            self.vectors.append(form)
        return self.number[form], low

    def expand(self, behind: int, symbols: bytes, state: int) -> tuple[str, int]:
        """Letters for these rows from ``state`` on, and the state after them."""
        vectors = [self.vectors[behind]]
        for s in reversed(symbols):
            vectors.append(before(s, vectors[-1]))
        vectors.reverse()
        letters = []
        for k, s in enumerate(symbols):
            while True:
                rest = vectors[k][state]
                found = [(letter, then, True) for letter, cost, then in choices(s, state) if cost + vectors[k + 1][then] == rest]
                then = EMIT[expected(state)][state]
                if INSERT + vectors[k][then] == rest:
                    found.append(("I", then, False))
                letter, state, taken = min(found)
                letters.append(letter)
                if taken:
                    break
        return "".join(letters), state

    def repair(self, symbols: bytes) -> tuple[int, str]:
        """Least cost and the first of the cheapest letter strings of a conversation."""
        head = len(symbols) % self.block
        codes = np.frombuffer(symbols, np.uint8)[head:].reshape(-1, self.block) @ len(KINDS) ** np.arange(self.block - 1, -1, -1)
        at, total, behind = self.last, 0, []
        for code in reversed(codes.tolist()):
            behind.append(at)
            at, total = int(self.to[at, code]), total + int(self.cost[at, code])
        behind.append(at)
        first = self.vectors[at]
        for s in reversed(symbols[:head]):
            first = before(s, first)
        total += first[START]
        state, letters = START, []
        for k, vector in enumerate(reversed(behind)):
            part = symbols[:head] if k == 0 else symbols[head + (k - 1) * self.block : head + k * self.block]
            if part:
                own, state = self.expanded(vector, part, state)
                letters.append(own)
        while state not in FINAL:
            letters.append("I")
            state = EMIT[expected(state)][state]
        return total, "".join(letters)


ORDER = ("turn", "role", "hash", "copy")
AUDITS = "key long, rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def judged(rows: DataFrame) -> DataFrame:
    """key, turn, role, hash, copy and fault (blank, duplicate, truncated or null) of each row (key, turn, role, text), without the text."""
    bare = F.btrim("text", F.lit(SPACE))
    short = rows.select("key", "turn", "role", F.md5(F.col("text").cast("binary")).alias("hash"), F.when(bare == "", "blank").when(~bare.rlike(r"[.!?]\z"), "truncated").alias("fault"))
    copies = short.withColumn("copy", F.row_number().over(Window.partitionBy("key", "role", "hash").orderBy("turn")))
    return copies.withColumn("fault", F.when(F.col("fault") == "blank", "blank").when(F.col("copy") > 1, "duplicate").otherwise(F.col("fault")))


def runs(table: pa.RecordBatch, column: str = "key") -> Iterator[tuple[int | None, int, int]]:
    """(key, from, to) of neighbouring rows with one key."""
    keys = table[column]
    values, gone = np.asarray(keys.fill_null(0)), np.asarray(keys.is_null())
    cuts = np.flatnonzero((values[1:] != values[:-1]) | (gone[1:] != gone[:-1])) + 1
    ends = [*cuts.tolist(), len(values)] if len(values) else []
    for a, b in zip([0, *ends], ends, strict=False):
        yield (None if gone[a] else int(values[a])), a, b


class Conversation:
    """What is held of a conversation while its short rows stream by."""

    def __init__(self, key: int | None):
        self.key, self.symbols, self.initials, self.faults = key, bytearray(), "", [0, 0, 0]
        self.low = self.high = self.last = None
        self.distinct, self.illegal = 0, 0

    def add(self, turns: list[int | None], roles: list[str], faults: list[str | None]) -> None:
        for turn, role, fault in zip(turns, roles, faults, strict=True):
            initial = role[:1]
            if self.symbols and self.initials + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.initials = initial
            if fault is not None:
                self.faults[("blank", "duplicate", "truncated").index(fault)] += 1
            self.symbols.append(GONE if fault in ("blank", "duplicate") else 2 * ("sua".index(initial) if initial in ("s", "u", "a") else 3) + (fault == "truncated"))
            if turn is not None:
                self.distinct += turn != self.last
                self.low = turn if self.low is None else self.low
                self.high = self.last = turn

    def result(self, tables: Tables) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return self.key, len(self.symbols), gaps, *self.faults, self.illegal, *tables.repair(bytes(self.symbols))


def audits(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``AUDITS`` of each conversation of the ``judged`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, own = Tables(block), None
        names = [c.split()[0] for c in AUDITS.split(", ")]
        kinds = [pa.int64()] * 8 + [pa.string()]
        for batch in batches:
            done = []
            turns, roles, faults = (batch[c].to_pylist() for c in ("turn", "role", "fault"))
            for key, a, b in runs(batch):
                if own is None or own.key != key:
                    done += [own.result(tables)] if own else []
                    own = Conversation(key)
                own.add(turns[a:b], roles[a:b], faults[a:b])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(own.result(tables), kinds, strict=True)], names)

    ordered = rows.repartition("key").sortWithinPartitions("key", *ORDER)
    return ordered.select("key", "turn", "role", "fault").mapInArrow(run, AUDITS)


def edits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Texts (key, kind, role, text) behind their conversation's letters (kind 0, in text), in order within each partition."""
    order = F.md5(F.col("text").cast("binary"))
    letters = found.select("key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit("").alias("hash"))
    texts = rows.select("key", F.lit(1).alias("kind"), "turn", "role", "text", order.alias("hash"))
    return letters.unionByName(texts).repartition("key").sortWithinPartitions("key", "kind", "turn", "role", "hash").select("key", "kind", "role", "text")


class Writer:
    """Applies a conversation's letters to its rows as they come."""

    def __init__(self, letters: str):
        self.letters, self.at, self.state = letters, 0, START

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.letters[self.at : self.at + 1] == "I":
            self.at += 1
            yield self.emit(expected(self.state)), ""

    def emit(self, initial: str) -> str:
        self.state = EMIT[initial][self.state]
        return NAMES[initial]

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """The rows up to and with this one."""
        yield from self.inserts()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "K":
            self.state = EMIT[role[:1]][self.state]
            yield role, text
        elif letter == "R":
            yield self.emit(expected(self.state)), text


def repaired_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, bool, str, str]]]:
    """By batch, (key, whether a conversation begins, role, text): a beginning, without role or text, and then the repaired rows."""
    writer, key = None, None
    for batch in batches:
        out = []
        for own, kind, role, text in zip(*(batch[c].to_pylist() for c in ("key", "kind", "role", "text")), strict=True):
            if kind == 0:
                if writer:
                    out += [(key, False, *r) for r in writer.inserts()]
                writer, key = Writer(text), own
                out.append((key, True, "", ""))
            else:
                out += [(key, False, *r) for r in writer.row(role, text)]
        yield out
    if writer:
        yield [(key, False, *r) for r in writer.inserts()]


def prepared(conversations: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return conversations.select(F.col(key).cast("long").alias("key"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"))


def repair(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The audit of each conversation (its key; ``AUDITS`` otherwise), and the repaired conversations: key, place (from 0), role, text."""
    rows = prepared(conversations, key, turn, role, text)
    found = materialize(audits(judged(rows), block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for out in repaired_rows(batches):
            numbered = []
            for own, begins, name, said in out:
                place = 0 if begins else place + 1
                if not begins:
                    numbered.append((own, place - 1, name, said))
            if numbered:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*numbered, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["key", "place", "role", "text"])

    whole = edits(rows, found).mapInArrow(run, "key long, place long, role string, text string")
    return found.withColumnRenamed("key", key), whole.withColumnRenamed("key", key)


def repaired_hashes(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The audits as ``repair`` gives them, and key, repaired_sha256 of ``role:text`` lines, hashed as the rows stream by."""
    rows = prepared(conversations, key, turn, role, text)
    found = materialize(audits(judged(rows), block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = []  # key, hash and lines so far of the conversation that streams by
        batch_of = lambda done: pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.int64()), pa.array([h for _, h in done])], ["key", "repaired_sha256"])
        for out in repaired_rows(batches):
            done = []
            for own, begins, name, said in out:
                if begins:
                    done += [(last[0], last[1].hexdigest())] if last else []
                    last = [own, hashlib.sha256(), 0]
                else:
                    last[1].update((f"\n{name}:{said}" if last[2] else f"{name}:{said}").encode())
                    last[2] += 1
            if done:
                yield batch_of(done)
        if last:
            yield batch_of([(last[0], last[1].hexdigest())])

    hashes = edits(rows, found).mapInArrow(run, "key long, repaired_sha256 string")
    return found.withColumnRenamed("key", key), hashes.withColumnRenamed("key", key)


def crc_damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text; null roles and texts as one space) damaged by rule: a row whose crc32 of ``conv_id:turn``, modulo 20, is 0
    is dropped, 1 loses its text, 2 its sentence ends, 3 stands twice, 4 gets the role user.
    """
    blank = F.lit(" ")
    at = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    rows = conversations.select(
        "conv_id", "turn", F.when(at == 4, "user").otherwise(role).alias("role"), F.when(at == 1, "").when(at == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(at == 0, 0).when(at == 3, 2).otherwise(1).alias("_times"),
    )
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("_times"))).alias("_copy")).drop("_copy")
