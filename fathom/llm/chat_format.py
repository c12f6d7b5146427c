"""Chat formatting: records of many layouts become canonical turns and one marked string.

A record is JSON or a typed struct.  The field paths that a layout may use are collected
with their nesting, leaf types left out, and hashed; the hash selects a declarative mapping
from ``LAYOUTS``.  The paths of a struct are those of its type, so its texts meet no parser
and no limit of one.  JSON that cannot be read, whatever its size, keeps its row without turns
and is told apart by the column ``unread``.
Fields that no layout knows do not count, so extra metadata does not change a fingerprint.
Everything here is DataFrame expressions.

The template writes each turn as ``<|role|>``, a line feed, the text, ``<|end|>`` and a
line feed.  A control string inside a text gets one backslash after its first character
(after any that are there already), which takes no other text away, so that reading back
is exact.  Roles are percent-encoded.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


class Layout(NamedTuple):
    """``shapes``: nested field paths that select it.  Either a list of messages under
    ``turns`` with fields ``role`` and ``text``, or ``fixed`` turns of a role and the fields
    whose non-empty texts are joined by line feeds (a turn without any is left out)."""

    name: str
    shapes: tuple[str, ...]
    turns: str = ""
    role: str = ""
    text: str = ""
    renamed: tuple[tuple[str, str], ...] = ()
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()


_SHARE = (("human", "user"), ("gpt", "assistant"), ("chatgpt", "assistant"), ("bing", "assistant"), ("bard", "assistant"))
LAYOUTS = (
    Layout("messages", ("messages:[{content,role}]", "messages:[]"), "messages", "role", "content"),
    Layout("share", ("conversations:[{from,value}]", "conversations:[]"), "conversations", "from", "value", _SHARE),
    Layout("system_share", ("conversations:[{from,value}];system", "conversations:[];system"), "conversations", "from", "value", _SHARE, (("system", ("system",)),)),
    Layout("instruction", ("instruction;output", "input;instruction;output"), fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("system_instruction", ("instruction;output;system", "input;instruction;output;system"), fixed=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("prompt", ("completion;prompt",), fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("response", ("prompt;response",), fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question", ("answer;question", "answer;context;question"), fixed=(("user", ("context", "question")), ("assistant", ("answer",)))),
)
_KNOWN = sorted({part.split(":")[0] for layout in LAYOUTS for shape in layout.shapes for part in shape.split(";")})
_SPARE = ("id", "weight", "name", "timestamp", "loss")

#: First characters and rests of the strings that mark something in common templates (fixed values).
_STARTS = r"([<\[])"
_RESTS = r"(\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)"
END = "<|end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _STARTS + r"(\\*)" + _RESTS, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _STARTS + r"\\(\\*)" + _RESTS, "$1$2$3")

#: The parser refuses strings above 20 M characters unless told otherwise.
_PARSED_CHARS = 20_000_000


def _shape(value: Column) -> Column:
    """Nesting of a variant without leaf types: ``[{content,role}]``; empty for a scalar."""
    found = F.schema_of_variant(value)
    found = F.regexp_replace(found, r"\b(?!OBJECT<|ARRAY<)[A-Z][A-Z_]*(\(\d+, ?\d+\))?(?=[>,]|$)", "")
    found = F.regexp_replace(found, "|".join(rf"\b{x}: (?=[,>])(, )?" for x in _SPARE), "")
    for _ in range(3):  # nesting deeper than any layout's keeps its angle brackets
        found = F.regexp_replace(found, r"OBJECT<([^<>]*)>", r"{$1}")
        found = F.regexp_replace(found, r"ARRAY<([^<>]*)>", r"[$1]")
    return F.regexp_replace(F.regexp_replace(found, r": ?(?=[,}])", ""), r", ?(?=[,}])|(?<=,) ", "")


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a variant that layouts know."""
    fields = record.cast("map<string,variant>")
    known = F.filter(F.array_sort(F.map_keys(fields)), lambda k: k.isin(_KNOWN))
    return F.xxhash64(F.array_join(F.transform(known, lambda k: F.rtrim(F.concat(k, F.lit(":"), _shape(fields[k])), F.lit(":"))), ";"))


def _typed_shape(kind: DataType) -> str:
    """What ``_shape`` gives for a value of this type."""
    if isinstance(kind, ArrayType):
        return f"[{_typed_shape(kind.elementType)}]"
    if not isinstance(kind, StructType):
        return ""
    return "{" + ",".join(f"{f.name}:{_typed_shape(f.dataType)}".rstrip(":") for f in sorted(kind, key=lambda f: f.name) if f.name not in _SPARE) + "}"


def _parsed(record: Column) -> Column:
    """Variant of JSON text, null if there is none that can be read."""
    wide = F.from_json(record, "variant", {"maxStringLen": str((1 << 31) - 1)})
    return F.coalesce(F.try_parse_json(record), F.when(F.char_length(record) >= _PARSED_CHARS, wide))


def _text(value: Column, path: str, typed: bool) -> Column:
    return F.coalesce(value[path].cast("string") if typed else F.try_variant_get(value, f"$.{path}", "string"), F.lit(""))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def _mapped(layout: Layout, record: Column, typed: bool = False) -> Column:
    out = []
    for role, paths in layout.fixed:
        said = F.filter(F.array(*(_text(record, p, typed) for p in paths)), lambda x: x != "")
        out.append(F.when(F.size(said) > 0, F.array(_turn(F.lit(role), F.array_join(said, "\n")))).otherwise(F.array().cast("array<struct<role:string,text:string>>")))
    if layout.turns:
        names = F.create_map(*(F.lit(x) for pair in layout.renamed for x in pair)) if layout.renamed else None

        def turn(m: Column) -> Column:
            role = _text(m, layout.role, typed)
            return _turn(role if names is None else F.coalesce(F.try_element_at(names, role), role), _text(m, layout.text, typed))

        listed = record[layout.turns] if typed else F.try_variant_get(record, f"$.{layout.turns}", "array<variant>")
        out.append(F.coalesce(F.transform(listed, turn), F.array().cast("array<struct<role:string,text:string>>")))
    return F.concat(*out)


def canonical_turns(records: DataFrame, column: str = "record") -> DataFrame:
    """``records`` with layout (name of the mapping, null if none fits), turns and unread added.

    A record that is null, not JSON, not an object or of no known layout keeps its row with
    no turns.  ``unread``: the record is text that is not JSON, or more JSON than a value can
    hold (128 MiB).  Null roles and texts are empty.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    kind = records.schema[column].dataType
    if isinstance(kind, StructType):
        paths = ";".join(f"{f.name}:{_typed_shape(f.dataType)}".rstrip(":") for f in sorted(kind, key=lambda f: f.name) if f.name in _KNOWN)
        fit = next((x for x in LAYOUTS if paths in x.shapes), None)
        there = F.col(column).isNotNull()
        name = F.when(there, fit.name if fit else None).cast("string")
        return records.withColumns({"layout": name, "turns": F.when(there, _mapped(fit, F.col(column), True)).otherwise(none) if fit else none, "unread": F.lit(False)})
    parsed = records.withColumn("_variant", _parsed(F.col(column).cast("string")))
    is_object = F.schema_of_variant("_variant").startswith("OBJECT")
    parsed = parsed.withColumn("_print", F.when(is_object, fingerprint(F.col("_variant"))))
    name, turns = F.lit(None).cast("string"), none
    for layout in LAYOUTS:
        fits = F.col("_print").isin([F.xxhash64(F.lit(shape)) for shape in layout.shapes])
        name = F.when(fits, layout.name).otherwise(name)
        turns = F.when(fits, _mapped(layout, F.col("_variant"))).otherwise(turns)
    unread = F.col(column).isNotNull() & F.col("_variant").isNull()
    return parsed.withColumns({"layout": name, "turns": turns, "unread": unread}).drop("_variant", "_print")


def format_chats(chats: DataFrame, key: str) -> DataFrame:
    """key, layout, n_turns, formatted and loss_spans of every row; ``key`` must be unique.

    ``loss_spans`` holds (start, end) in code points of ``formatted``, one for each assistant
    text.  Offsets come from a running sum over the turns of one record.
    """
    each = chats.select(key, "layout", F.posexplode_outer("turns").alias("pos", "turn"))
    head = F.concat(F.lit("<|"), F.url_encode(F.col("turn.role")), F.lit("|>\n"))
    each = each.withColumns({"head": head, "body": escape(F.col("turn.text"))})
    each = each.withColumn("n", F.char_length("head") + F.char_length("body") + len(END))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)) + F.char_length("head"))
    piece = F.struct(
        "pos",
        F.concat("head", "body", F.lit(END)).alias("text"),
        F.when(F.col("turn.role") == "assistant", F.struct(F.col("start").alias("start"), (F.col("start") + F.char_length("body")).alias("end"))).alias("loss"),
    )
    made = each.groupBy(key).agg(F.first("layout").alias("layout"), F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), piece))).alias("pieces"))
    return made.select(
        key,
        "layout",
        F.size("pieces").cast("long").alias("n_turns"),
        F.array_join(F.col("pieces.text"), "").alias("formatted"),
        F.array_compact(F.col("pieces.loss")).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns that a formatted string was made of."""
    parts = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: _turn(
            F.url_decode(F.substring_index(p.substr(F.lit(3), F.length(p)), "|>\n", 1)),
            unescape(p.substr(F.instr(p, "|>\n") + 3, F.length(p))),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr(s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")


def turn_rows_as_records(rows: DataFrame) -> DataFrame:
    """conv_id and a typed record of the messages layout from a table of conv_id, turn, role, text."""
    said = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", said.alias("m")))).alias("all"))
    return grouped.select("conv_id", F.struct(F.col("all.m").alias("messages")).alias("record"))
