"""Column functions that render and decode: citations, answer layouts, human sizes, JSON, log lines, letters of two scripts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from .. import resources as R
from . import text as T


def citation(source, page, section, act) -> Column:
    """Source | Page p | Section s | Act, parts that are missing left out."""
    c = lambda x: F.nullif(T.text_of(F.col(x).cast("string")), F.lit(""))
    return F.concat_ws(" | ", c(source), F.concat(F.lit("Page "), c(page)), F.concat(F.lit("Section "), c(section)), c(act))


def citations_of(results: DataFrame) -> DataFrame:
    """(query_id, citations): structs of source, page, section, act by rank."""
    one = F.struct("rank", F.coalesce("source", F.lit("Unknown")).alias("source"), "page", F.coalesce("section_number", F.lit("")).alias("section"), F.coalesce("act_name", F.lit("")).alias("act"))
    return results.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("citations"))


def rendered(results: DataFrame, layout: str) -> DataFrame:
    """(query_id, text): `summary` (three results, 300 characters each), `detailed` (five, whole) or `citations` (all, one a line)."""
    limit, cut = {"summary": (3, 300), "detailed": (5, None), "citations": (None, 0)}[layout]
    rows = results if limit is None else results.where(F.col("rank") <= limit)
    label = F.concat(F.col("rank").cast("string"), F.lit(". "), citation("source", "page", "section_number", "act_name"))
    body = label if cut == 0 else F.concat(label, F.lit("\n"), F.substring("document", 1, cut) if cut else F.col("document"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", body.alias("t")))), lambda x: x["t"]), "\n" if cut == 0 else "\n\n").alias("text"))


def first_of(m, *keys: str) -> Column:
    """The first value of a map under the keys that isn't empty."""
    c = F.col(m) if isinstance(m, str) else m
    return F.coalesce(*[F.nullif(F.try_element_at(c, F.lit(k)), F.lit("")) for k in keys])


def plain_markdown(c) -> Column:
    """Text without headings, emphasis, code marks, links and bullets of markdown."""
    out = T.text_of(c)
    for pattern, to in ((r"(?m)^#{1,6}\s*", ""), (r"\*\*(.+?)\*\*", "$1"), (r"\*(.+?)\*", "$1"), (r"`([^`]*)`", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^\s*[-*]\s+", "- ")):
        out = F.regexp_replace(out, pattern, to)
    return out


def latin_letters(c) -> Column:
    """Typographic characters as plain ones; others outside Latin-1 as ?."""
    plain = F.translate(T.text_of(c), "‘’“”–—•§…", "''\"\"--*S.")
    return F.regexp_replace(plain, "[^\\u0000-\\u00FF]", "?")


def duration(seconds: Column) -> Column:
    s = F.greatest(F.floor(seconds), F.lit(0))
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), F.floor(s % 3600 / 60).cast("string"), F.lit("m")))


def size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, F.concat(F.round(n / 1024, 1).cast("string"), F.lit(" KB"))).otherwise(F.concat(F.round(n / 1024**2, 1).cast("string"), F.lit(" MB")))


def request_key(prefix: str, fields: list[str]) -> Column:
    """A cache key of a request: its fields in name order as JSON."""
    return F.concat(F.lit(prefix + ":"), F.to_json(F.struct(*sorted(fields))))


def log_line(level, event, fields: list[str]) -> Column:
    """A structured log line: JSON with level, event and the given fields that aren't null."""
    return F.to_json(F.struct(F.lit(level).alias("level"), F.lit(event).alias("event"), *fields))


def file_name(c) -> Column:
    """A book's file name: spaces and signs as _, one at a time, extension in lower case."""
    stem = F.regexp_replace(T.text_of(c), r"\.[^.]*$", "")
    return F.concat(F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9]+", "_"), r"^_|_$", ""), F.lower(F.regexp_extract(T.text_of(c), r"(\.[^.]*)$", 1)))


# --- functions that need offsets or a left-to-right scan: Arrow batches

_ELEMENTS = {
    "section": (re.compile(r"(?:^|\n)\s*(?:Section|Sec\.?|s\.)\s*(\d{1,4}[A-Z]?)|(?:^|\n)\s*(\d{1,4}[A-Z]?)\.\s+[A-Z]", re.I | re.M), 0),
    "chapter": (re.compile(r"(?:^|\n)CHAPTER\s+([IVXLCDM\d]+)", re.I | re.M), 0),
    "proviso": (re.compile(r"(?:^|\n)\s*Provided\s+(?:that|also|further|nevertheless)", re.I | re.M), 100),
    "illustration": (re.compile(r"(?:^|\n)\s*Illustration(?:\s*\(?[a-zA-Z0-9]+\)?)?\s*:", re.I | re.M), 150),
    "exception": (re.compile(r"(?:^|\n)\s*Exception\s*:?\s*", re.I | re.M), 100),
}


@F.pandas_udf(t.ArrayType(t.StructType([t.StructField("kind", t.StringType()), t.StructField("value", t.StringType()), t.StructField("position", t.IntegerType())])))
def elements(texts: pd.Series) -> pd.Series:
    """All structural elements of a page with their positions; provisos, illustrations and exceptions with the text behind them."""

    def of(text):
        out = []
        for kind, (pattern, behind) in _ELEMENTS.items():
            for m in pattern.finditer(text or ""):
                value = text[m.end() : m.end() + 300].strip()[:behind] if behind else next((g for g in m.groups() if g), "")
                if value:
                    out.append({"kind": kind, "value": value, "position": m.start()})
        return out

    return texts.map(of)


_FROM_ROMAN = {v: k for k, v in R.ROMAN_LETTERS.items() if v} | {
    # Letter groups beside the single letters.
    "aa": "ा", "ee": "ी", "oo": "ू", "ai": "ै", "au": "ौ", "kh": "ख", "gh": "घ", "chh": "छ", "jh": "झ", "th": "थ", "dh": "ध", "ph": "फ", "bh": "भ", "sh": "श", "Sh": "ष",
}
_GROUPS = re.compile("|".join(sorted((re.escape(k) for k in _FROM_ROMAN if len(k) in (2, 3)), key=len, reverse=True)))


@F.pandas_udf(t.StringType())
def devanagari(texts: pd.Series) -> pd.Series:
    """Roman letters to Devanagari: groups of three, then of two letters; single letters stay."""
    return texts.map(lambda x: None if x is None else _GROUPS.sub(lambda m: _FROM_ROMAN[m[0]], x))


@F.pandas_udf(t.ArrayType(t.StructType([t.StructField("number", t.StringType()), t.StructField("context", t.StringType())])))
def hindi_sections(texts: pd.Series) -> pd.Series:
    """Section numbers before and after धारा or Section, each with 20 characters around it."""
    patterns = [re.compile(p, re.I) for p in (r"(\d+)\s*धारा", r"धारा\s*(\d+)", r"(\d+)\s*Section", r"Section\s*(\d+)")]
    return texts.map(lambda x: [{"number": m[1], "context": x[max(0, m.start() - 20) : m.end() + 20]} for p in patterns for m in p.finditer(x or "")])
