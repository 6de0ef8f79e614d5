"""Helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LOWER_TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
BLANKS = "[ \\t\\n\\x0B\\f\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_tokens(c: str) -> str:
    return LOWER_TOKENS.format(c)


def sql_words(c: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({c}, ''), '{BLANKS}'), lambda x: x <> '')"


def sql_collapse(c: str) -> str:
    return f"array_to_string({sql_words(c)}, ' ')"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_contains_any(c: str, values) -> str:
    """Whether a text contains any of the values, without regular expressions."""
    return f"(len(list_filter({sql_list(values)}, lambda k: contains({c}, k))) > 0)"


def sql_map(table: dict) -> str:
    quoted = lambda v: "'" + str(v).replace("'", "''") + "'"
    return "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in table.items()) + "}"
