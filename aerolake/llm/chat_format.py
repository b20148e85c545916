r"""Operator 11: chat formatting, with DataFrame functions alone.

1. A record is a VARIANT: ``parse_json`` of a line, ``to_variant_object`` of a row. Its nested field paths (``messages[].role``), those
   that any layout names, are sorted and hashed: the record's fingerprint.
2. A ``Layout`` declares which paths it needs, which others may stand beside them, and where the turns are. The fingerprints of all
   layouts are known when a query is planned, so a lookup in a literal map selects the layout; no row is compared with layout after layout.
3. The layout's expression makes turns (turn, role, text), one row each; roles get their usual names where the layout says so.
4. ``render`` marks the turns by a ``Template`` and escapes control strings inside texts and roles: a backslash goes behind the first
   sign of ``<`` or ``[`` ``\``... rest, however many are there already; ``unescape`` takes one away. Neither can meet a mark across its border, for
   a mark has its only ``<`` in front. Spans of the loss mask are counted while the turns are put together.

Turns of one conversation are ordered by turn, nulls first, then role and text, nulls as empty ones. Repeated rows are turns of
their own. Null texts and roles are empty; a record that is no object, or whose fingerprint no layout has, gives no turns (``unknown``
counts those by fingerprint). Extra fields beside those that layouts name change nothing. Rows without a key are one conversation. A
conversation is one value of the result, so its turns meet in one row; everything before that works turn by turn. A record may hold
128 MB, as much as a VARIANT does; a longer one ends the job with Spark's error.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURNS = "array<struct<turn:bigint,role:string,text:string>>"
#: Usual names of roles; fixed values.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Field:
    """One turn: the texts at ``paths`` (of the record itself) that are not empty, joined; no turn if the record has none of them."""

    role: str
    paths: tuple[str, ...]
    join: str = "\n\n"


@dataclass(frozen=True)
class Items:
    """A turn for each element of the array at ``path``, with its role and text fields."""

    path: str
    role: str
    text: str
    roles: dict[str, str] = field(default_factory=lambda: ROLES, hash=False)


@dataclass(frozen=True)
class Pairs:
    """Two turns for each element of the array at ``path``: arrays of what the user and the assistant said."""

    path: str


@dataclass(frozen=True)
class Strings:
    """A turn for each string of the array at ``path``, of user and assistant in turn."""

    path: str


@dataclass(frozen=True)
class Row:
    """The record is itself one turn, placed by the number at ``turn``; roles stay as they are."""

    turn: str
    role: str
    text: str


@dataclass(frozen=True)
class Layout:
    """``needs`` and ``may``: field paths that select it; ``parts`` in the order of their turns."""

    name: str
    parts: tuple[Field | Items | Pairs | Strings | Row, ...]
    needs: tuple[str, ...]
    may: tuple[str, ...] = ()


SYSTEM = Field("system", ("system", "system_prompt"))
#: Layouts in the order of their precedence; field names are fixed values.
LAYOUTS = (
    Layout("rows", (Row("turn", "role", "text"),), ("role", "text"), ("turn",)),
    Layout("messages", (SYSTEM, Items("messages", "role", "content")), ("messages[].content", "messages[].role"), ("system", "system_prompt", "prompt", "prompt_id")),
    Layout("conversations", (SYSTEM, Items("conversations", "from", "value")), ("conversations[].from", "conversations[].value"), ("system", "system_prompt")),
    Layout("conversation", (SYSTEM, Items("conversation", "role", "content")), ("conversation[].content", "conversation[].role"), ("system", "system_prompt")),
    Layout("history", (SYSTEM, Pairs("history"), Field("user", ("instruction", "input")), Field("assistant", ("output",))), ("history[][]", "instruction", "output"), ("input", "system", "system_prompt")),
    Layout("instruction", (SYSTEM, Field("user", ("instruction", "input")), Field("assistant", ("output", "response"))), ("instruction",), ("input", "output", "response", "system", "system_prompt", "history")),
    Layout("context", (SYSTEM, Field("user", ("context", "instruction")), Field("assistant", ("response",))), ("context", "instruction", "response"), ("system",)),
    Layout("prompt", (SYSTEM, Field("user", ("prompt",)), Field("assistant", ("completion", "response", "chosen"))), ("prompt",), ("completion", "response", "chosen", "rejected", "prompt_id", "system", "system_prompt")),
    Layout("question", (SYSTEM, Field("user", ("context", "question")), Field("assistant", ("answer", "response"))), ("question",), ("answer", "response", "context", "system", "system_prompt")),
    Layout("dialog", (Strings("dialog"),), ("dialog[]",)),
)


@dataclass(frozen=True)
class Template:
    """Marks before a role, between role and text, and after a text; each has ``<`` or ``[`` as its first sign and nowhere else."""

    start: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    trained: tuple[str, ...] = ("assistant",)


CHAT = Template()
#: Control strings of this template and of others, with any backslashes behind their first sign; fixed values.
ESCAPE = r"([<\[])(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|/?SYS>>|/?INST\])"
UNESCAPE = r"([<\[])\\(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|/?SYS>>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def as_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def as_array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def as_text(value: Column) -> Column:
    """A string or number; of an array of parts, the text of each, one after the other."""
    part = lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.when(as_object(p).isNull(), F.try_variant_get(p, "$", "string")), F.lit(""))
    parts = as_array(value)
    return F.when(parts.isNotNull(), F.array_join(F.transform(parts, part), "")).otherwise(F.try_variant_get(value, "$", "string"))


def paths(record: Column) -> Column:
    """Sorted distinct field paths of a record, two levels deep: ``a``, ``a.b``, ``a[].b``, ``a[]``, ``a[][]``; null if it is no object."""

    def below(entry: Column) -> Column:
        key, own, each = entry["key"], as_object(entry["value"]), as_array(entry["value"])
        inside = lambda x: F.coalesce(F.transform(F.map_keys(as_object(x)), lambda k: F.concat(key, F.lit("[]."), k)), F.array(F.concat(key, F.when(as_array(x).isNull(), "[]").otherwise("[][]"))))
        return F.coalesce(F.transform(F.map_keys(own), lambda k: F.concat(key, F.lit("."), k)), F.flatten(F.transform(each, inside)), F.array(key))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.map_entries(as_object(record)), below))))


def vocabulary(layouts: Sequence[Layout]) -> list[str]:
    return sorted({p for x in layouts for p in (*x.needs, *x.may)})


def fingerprint(found: Column, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """Hash of those of the sorted ``paths`` that any layout names."""
    known = F.array(*map(F.lit, vocabulary(layouts)))
    return F.xxhash64(F.array_join(F.filter(found, lambda p: F.array_contains(known, p)), "\n"))


def fingerprints(layouts: Sequence[Layout] = LAYOUTS) -> dict[int, int]:
    """The place of the layout that each fingerprint selects: what it needs, with any choice of what may stand beside it; the first layout wins."""
    out: dict[int, int] = {}
    for at, x in enumerate(layouts):
        for n in range(len(x.may) + 1):
            for extra in combinations(x.may, n):
                h = xxhash.xxh64_intdigest("\n".join(sorted({*x.needs, *extra})).encode(), 42)
                out.setdefault(h - (h >> 63 << 64), at)
    return out


def turns_of(part: Field | Items | Pairs | Strings | Row, record: Column) -> Column:
    """Array of (turn, role, text) that a part finds in a record."""
    at = lambda path, kind="variant": F.try_variant_get(record, f"$.{path}", kind)
    turn = lambda role, text, k=None: F.struct((F.lit(0) if k is None else k).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    if isinstance(part, Row):
        return F.array(turn(as_text(at(part.role)), as_text(at(part.text)), at(part.turn, "long"))).cast(TURNS)
    if isinstance(part, Field):
        texts = F.filter(F.array(*(as_text(at(p)) for p in part.paths)), lambda x: x.isNotNull() & (x != ""))
        there = F.greatest(*(at(p).isNotNull() for p in part.paths)) if len(part.paths) > 1 else at(part.paths[0]).isNotNull()
        return F.when(there, F.array(turn(F.lit(part.role), F.array_join(texts, part.join)))).otherwise(F.array()).cast(TURNS)
    elements = F.coalesce(as_array(at(part.path)), F.array().cast("array<variant>"))
    if isinstance(part, Items):
        names = F.create_map(*(F.lit(x) for pair in part.roles.items() for x in pair))
        role = lambda x: as_text(F.try_variant_get(x, f"$.{part.role}", "variant"))
        return F.transform(elements, lambda x: turn(F.coalesce(F.try_element_at(names, F.lower(role(x))), role(x)), as_text(F.try_variant_get(x, f"$.{part.text}", "variant")))).cast(TURNS)
    if isinstance(part, Strings):
        return F.transform(elements, lambda x, k: turn(F.when(k % 2 == 0, "user").otherwise("assistant"), as_text(x))).cast(TURNS)
    said = lambda x, k: as_text(F.try_variant_get(x, f"$[{k}]", "variant"))
    return F.flatten(F.transform(elements, lambda x: F.array(turn(F.lit("user"), said(x, 0)), turn(F.lit("assistant"), said(x, 1))))).cast(TURNS)


def with_layout(records: DataFrame, record: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """``records`` with _paths, _fingerprint and _layout, its place among ``layouts`` (null: none fits)."""
    places = F.create_map(*(F.lit(x) for pair in fingerprints(layouts).items() for x in pair))
    out = records.withColumn("_paths", paths(F.col(record)))
    out = out.withColumn("_fingerprint", F.when(F.col("_paths").isNotNull(), fingerprint(F.col("_paths"), layouts)))
    return out.withColumn("_layout", F.try_element_at(places, F.col("_fingerprint")))


def canonical_turns(records: DataFrame, key: str = "conv_id", record: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """key, turn, role, text: a row for each turn of every record whose layout is known."""
    known = with_layout(records.select(key, record), record, layouts)
    found = F.lit(None).cast(TURNS)
    for at, x in enumerate(layouts):
        parts = [turns_of(p, F.col(record)) for p in x.parts]
        own = parts[0] if len(parts) == 1 else F.concat(*parts)
        if not any(isinstance(p, Row) for p in x.parts):
            own = F.transform(own, lambda t, k: t.withField("turn", k.cast("long")))
        found = F.when(F.col("_layout") == at, own).otherwise(found)
    return known.select(F.col(key), F.explode(found).alias("t")).select(key, "t.turn", *(F.coalesce(f"t.{c}", F.lit("")).alias(c) for c in ("role", "text")))


def unknown(records: DataFrame, record: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """fingerprint (of all its field paths), paths, n: the records that no layout fits, so that layouts for them can be declared."""
    rest = with_layout(records.select(record), record, layouts).where("_layout is null").withColumn("fingerprint", F.xxhash64(F.array_join("_paths", "\n")))
    return rest.groupBy("fingerprint").agg(F.min("_paths").alias("paths"), F.count("*").alias("n"))


def render(turns: DataFrame, key: str = "conv_id", template: Template = CHAT) -> DataFrame:
    """key, n_turns, formatted, loss_spans (start, end in code points, first_byte, n_bytes in UTF-8) of every conversation of ``canonical_turns``."""
    marks = lambda role: F.concat(F.lit(template.start), escape(role), F.lit(template.middle))
    parts = turns.select(key, "turn", "role", "text", marks(F.col("role")).alias("head"), escape(F.col("text")).alias("body"))
    order = Window.partitionBy(key).orderBy("turn", "role", "text")
    before = lambda size: F.coalesce(F.sum(size(F.col("head")) + size(F.col("body")) + len(template.end)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = parts.withColumns({"k": F.row_number().over(order), "chars": before(F.length), "bytes": before(F.octet_length)})
    start, first = F.col("chars") + F.length("head"), F.col("bytes") + F.octet_length("head")
    span = F.struct(start.alias("start"), (start + F.length("body")).alias("end"), first.alias("first_byte"), F.octet_length("body").cast("long").alias("n_bytes"))
    piece = F.struct("k", F.concat("head", "body", F.lit(template.end)).alias("text"), F.when(F.col("role").isin(*template.trained), span).alias("span"))
    whole = rows.select(key, piece.alias("piece")).groupBy(key).agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    spans = F.filter("pieces.span", lambda s: s.isNotNull())
    return whole.select(key, F.size("pieces").cast("long").alias("n_turns"), F.array_join("pieces.text", "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """``formatted`` (of ``render``) with turns (role, text), read from the formatted text alone, and loss_texts, what its loss mask covers."""
    literal = lambda mark: r"\Q" + mark + r"\E"
    rough = F.split("formatted", literal(template.end), -1)
    part = lambda x: F.split(F.substr(x, F.lit(len(template.start) + 1)), literal(template.middle), 2)
    turn = lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text"))
    turns = F.transform(F.transform(F.slice(rough, F.lit(1), F.size(rough) - 1), part), turn)
    data = F.col("formatted").cast("binary")
    cut = lambda s: unescape(F.substr(data, (s["first_byte"] + 1).cast("int"), s["n_bytes"].cast("int")).cast("string"))
    return formatted.withColumns({"turns": turns, "loss_texts": F.transform("loss_spans", cut)})
