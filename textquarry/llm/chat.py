"""Chat formatting with DataFrame functions only.

1. A record's layout is known by its schema fingerprint: a hash of its nested field paths. For a table the paths
   come from its columns; for JSON records each row's own paths are hashed (scalar types don't count). Where no layout has
   just these paths, the one counts that has the most of them and none else: other fields of a record don't matter. The fingerprint
   selects a declarative mapping of `LAYOUTS`, which turns prompts, instructions or messages into canonical turns.
2. Turns are rendered between markers, `TURN` role, line feed, text, `END`. In roles and texts the characters that
   markers and common control strings begin with (< [ |) are written as a backslash and a digit, and so is the backslash:
   no control string is left in them, and reading back gives the same text.
3. The loss mask is the list of ranges of assistant texts in the output, in code points and in UTF-8 bytes.

Null texts and roles read as empty. Turns of one number keep the order of their roles, then of their texts; null numbers
come last, and null conversation ids are one conversation. Records whose fingerprint is not known (an
empty list of messages has no paths of its own), or that aren't JSON, come back with layout `unknown` and no turns. A conversation without turns has the empty output.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from .common import table

TURN, END = "<|turn|>", "<|end|>\n"
#: Written for a character, in this order; read back in the reverse order.
ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"), ("|", "\\3"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "\\4"))


@dataclass(frozen=True)
class Layout:
    """paths: nested field paths, [] for list elements. turns: (role, or path of the role; path of the text), under `each` if that is given."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...]
    each: str | None = None
    #: The column that numbers the turns, where each record is one.
    numbered: str | None = None


#: Roles of other layouts by their canonical names.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
LAYOUTS = (
    Layout("rows", ("conv_id", "turn", "role", "text"), (("$.role", "$.text"),), numbered="turn"),
    Layout("prompt_completion", ("prompt", "completion"), (("user", "$.prompt"), ("assistant", "$.completion"))),
    Layout("prompt_response", ("prompt", "response"), (("user", "$.prompt"), ("assistant", "$.response"))),
    Layout("system_prompt_response", ("system", "prompt", "response"), (("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response"))),
    Layout("question_answer", ("question", "answer"), (("user", "$.question"), ("assistant", "$.answer"))),
    Layout("instruction", ("instruction", "output"), (("user", "$.instruction"), ("assistant", "$.output"))),
    Layout("instruction_input", ("instruction", "input", "output"), (("user", "$.instruction|$.input"), ("assistant", "$.output"))),
    Layout("messages", ("messages[].role", "messages[].content"), (("$.role", "$.content"),), "$.messages"),
    Layout("from_value", ("conversations[].from", "conversations[].value"), (("$.from", "$.value"),), "$.conversations"),
    Layout("pairs", ("turns[].user", "turns[].assistant"), (("user", "$.user"), ("assistant", "$.assistant")), "$.turns"),
)


def fingerprint_of_paths(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def schema_paths(kind: t.DataType, at: str = "") -> list[str]:
    """Nested field paths of a Spark type."""
    if isinstance(kind, t.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, t.ArrayType):
        return schema_paths(kind.elementType, at + "[]")
    return [at]


def table_layout(df: DataFrame) -> Layout | None:
    """The layout of a table by the fingerprint of its columns, or of those of them that make up the largest layout."""
    paths = schema_paths(df.schema)
    return next((x for x in sorted(LAYOUTS, key=lambda x: -len(x.paths)) if fingerprint_of_paths(set(paths) & set(x.paths)) == fingerprint_of_paths(x.paths)), None)


def _type_of_paths(paths) -> str:
    """Paths as the nested type that schema_of_variant writes, all scalars X."""
    top: dict = {}
    for path in paths:
        at = top
        for name in path.replace("[]", ".[]").split("."):
            at = at.setdefault(name, {})

    def written(node: dict) -> str:
        if not node:
            return "X"
        if set(node) == {"[]"}:
            return f"ARRAY<{written(node['[]'])}>"
        return "OBJECT<" + ", ".join(f"{k}: {written(v)}" for k, v in sorted(node.items())) + ">"

    return written(top)


def json_fingerprint(variant: Column) -> Column:
    """The hash of a variant's nested field paths, from its inferred type without its scalar types."""
    kind = F.regexp_replace(F.schema_of_variant(variant), r"(?<=: |<)(?:STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|BINARY|DATE|TIMESTAMP|TIMESTAMP_NTZ|DECIMAL\([0-9, ]+\))(?=,|>)", "X")
    return F.sha2(kind, 256)


def _variant_at(record: Column, path: str) -> Column:
    return F.try_variant_get(record, path, "string")


def _field_at(record: Column, path: str) -> Column:
    """A path within a typed record."""
    for name in path.removeprefix("$.").split("."):
        record = record[name]
    return record.cast("string")


def _text_at(record: Column, path: str, at=_variant_at) -> Column:
    """Text at a path; parts that | joins are put together by a line feed, those that are empty left out."""
    parts = [F.coalesce(at(record, p), F.lit("")) for p in path.split("|")]
    return parts[0] if len(parts) == 1 else F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n")


def _mapped(layout: Layout, at=_variant_at):
    """The layout's mapping, from a record (or an element under `each`) to an array of its turns; at: how a path is read."""
    names = F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv])

    def turns(record: Column) -> Column:
        out = []
        for role, text in layout.turns:
            named = F.coalesce(at(record, role), F.lit("")) if role.startswith("$") else F.lit(role)
            # rows are turns already: their roles stay as they are
            out.append(F.struct((named if layout.numbered else F.coalesce(names[named], named)).alias("role"), _text_at(record, text, at).alias("text")))
        return F.array(*out)

    return turns


def _holds(layout: Layout, v: Column) -> Column:
    """Whether a record has all paths of a layout; it may have others."""
    kind = lambda x: F.schema_of_variant(x)
    nested = lambda x: kind(x).startswith("OBJECT<") | kind(x).startswith("ARRAY<")

    def scalar(record: Column, name: str) -> Column:
        x = F.try_variant_get(record, f"$.{name}", "variant")
        return x.isNotNull() & ~nested(x)

    names = [p.split("[].")[-1] for p in layout.paths]
    if layout.each is None:
        return functools.reduce(Column.__and__, (scalar(v, n) for n in names))
    said = F.try_variant_get(v, layout.each, "array<variant>")
    absent = lambda x, n: F.try_variant_get(x, f"$.{n}", "variant").isNull()
    every = F.forall(said, lambda x: kind(x).startswith("OBJECT<") & functools.reduce(Column.__and__, (absent(x, n) | scalar(x, n) for n in names)))
    some = lambda n: F.exists(said, lambda x: scalar(x, n))
    return functools.reduce(Column.__and__, map(some, names), every)


def json_turns(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(conv_id, turn, role, text, layout) of JSON records of any layout of LAYOUTS; one row for each turn, and one with null turn for a record of none."""
    v = F.try_parse_json(F.col(json_col))
    rows = df.select(F.col(id_col).alias("conv_id"), v.alias("v")).withColumn("fingerprint", json_fingerprint(F.col("v")))
    turns, layout = F.lit(None).cast("array<struct<role: string, text: string>>"), F.lit("unknown")
    exact = lambda x: F.col("fingerprint") == hashlib.sha256(_type_of_paths(x.paths).encode()).hexdigest()
    smallest_first = sorted(LAYOUTS[1:], key=lambda x: len(x.paths))
    for x, is_this in (*((x, _holds(x, F.col("v"))) for x in smallest_first), *((x, exact(x)) for x in LAYOUTS[1:])):
        made = _mapped(x)(F.col("v")) if x.each is None else F.flatten(F.transform(F.try_variant_get("v", x.each, "array<variant>"), _mapped(x)))
        turns, layout = F.when(is_this, made).otherwise(turns), F.when(is_this, x.name).otherwise(layout)
    rows = rows.select("conv_id", layout.alias("layout"), F.posexplode_outer(turns).alias("turn", "said"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "said.role", "said.text", "layout")


def table_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of a table, through the mapping of the layout that the fingerprint of its columns selects; other columns don't matter."""
    layout = table_layout(df)
    if layout is None:
        raise ValueError(f"no layout has the columns {', '.join(df.columns)}")
    record = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != id_col or layout.numbered])
    if layout.each is None:
        said = _mapped(layout, _field_at)(record)
    else:
        said = F.flatten(F.transform(_elements(df, layout.each), _mapped(layout, _field_at)))
    rows = df.select(F.col(f"`{id_col}`").alias("conv_id"), (F.col(layout.numbered) if layout.numbered else F.lit(0)).alias("at"), F.posexplode(said).alias("nth", "said"))
    return rows.select("conv_id", (F.col("at") if layout.numbered else F.col("nth")).cast("long").alias("turn"), "said.role", "said.text")


def _elements(df: DataFrame, path: str) -> Column:
    return F.coalesce(F.col(f"`{path.removeprefix('$.')}`"), F.array().cast(df.schema[path.removeprefix("$.")].dataType))


def escaped(text: Column, escapes=ESCAPES) -> Column:
    for plain, code in escapes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, escapes=ESCAPES) -> Column:
    for plain, code in reversed(escapes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def formatted_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans of turn rows (conv_id, turn, role, text); loss_spans: start, past, byte_start, byte_past of each assistant text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(TURN), escaped(role, ROLE_ESCAPES), F.lit("\n"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), head.alias("head"), escaped(text).alias("body"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sizes = {"chars": F.length("head") + F.length("body") + len(END), "bytes": F.octet_length("head") + F.octet_length("body") + len(END)}
    rows = rows.withColumns({k: v.cast("long") for k, v in sizes.items()})
    at = {f"{k}_at": F.coalesce(F.sum(k).over(before), F.lit(0)) for k in sizes}
    rows = rows.select("conv_id", F.row_number().over(order).alias("nth"), *[c.alias(k) for k, c in at.items()], "role", "head", "body")
    start, byte_start = F.col("chars_at") + F.length("head"), F.col("bytes_at") + F.octet_length("head")
    span = F.struct(start.alias("start"), (start + F.length("body")).alias("past"), byte_start.alias("byte_start"), (byte_start + F.octet_length("body")).alias("byte_past"))
    rendered = F.struct("nth", F.concat("head", "body", F.lit(END)).alias("rendered"), F.when(F.col("role") == "assistant", span).alias("span"))
    grouped = rows.select("conv_id", rendered.alias("turn")).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return grouped.select("conv_id", F.array_join("turns.rendered", "").alias("formatted"), F.filter("turns.span", lambda x: x.isNotNull()).alias("loss_spans"))


def turns_of(formatted: Column) -> Column:
    """Reads an output back: an array of (role, text)."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda x: x != "")
    said = lambda x: F.substring(x, len(TURN) + 1, F.length(x))
    role = lambda x: F.substring_index(said(x), "\n", 1)
    return F.transform(pieces, lambda x: F.struct(unescaped(role(x), ROLE_ESCAPES).alias("role"), unescaped(F.substring(said(x), F.length(role(x)) + 2, F.length(x))).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, spans one after the other."""
    data = formatted.cast("binary")
    return F.array_join(F.transform(spans, lambda x: unescaped(F.substring(data, (x["byte_start"] + 1).cast("int"), (x["byte_past"] - x["byte_start"]).cast("int")).cast("string"))), "")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of all conversations and of conversation -7."""
    rows = table_turns(table(spark, sf_dir, "conversations"))
    control = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '{control}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS v(turn, role)")
    chats = formatted_chats(rows.unionByName(more))
    read = chats.select("conv_id", turns_of(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


OP2_SQL = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
counted AS (SELECT *, length(role) + len(regexp_extract_all(role, '[\\<\[|\n]')) + length(text) + len(regexp_extract_all(text, '[\\<\[|]')) + 17 AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM counted GROUP BY conv_id
"""
