"""Claims of answers held against their sources, and findings of made-up citations and outdated law."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import resources as R
from ..functions import text as T


def claims(answers: DataFrame, id_col: str = "response_id", text_col: str = "response") -> DataFrame:
    """(response_id, ord, type, value): section references, punishments, terms of imprisonment, fines, definitions, kind by kind."""
    low = F.lower(T.text_of(text_col))
    every = lambda p, g=0: F.regexp_extract_all(low, F.lit(p), F.lit(g))
    typed = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))
    section = r"section\s+(\d+[a-z]?)\s+(ipc|bns|crpc|bnss|bsa)"
    sections = F.zip_with(every(section, 1), every(section, 2), lambda n, a: F.concat(F.lit("Section "), n, F.lit(" "), F.upper(a)))
    found = F.concat(
        typed("section_reference", sections),
        typed("punishment", every(r"punishment\s+(?:is|shall be|may be)\s+[^.]+")),
        typed("imprisonment_duration", F.transform(every(r"imprisonment\s+(?:for\s+)?(?:up to\s+)?(\d+)\s+years?", 1), lambda n: F.concat(n, F.lit(" years")))),
        typed("fine_amount", every(r"fine\s+(?:of\s+|up to\s+)?([\d,]+(?:\s+rupees)?)", 1)),
        typed("offence_definition", every(r"whoever\s+[^.]+?\s+shall\s+be\s+punished")),
    )
    return answers.select(id_col, F.posexplode(found).alias("ord", "c")).select(id_col, "ord", "c.type", "c.value")


def verified(claimed: DataFrame, sources: DataFrame, strict: bool = False) -> DataFrame:
    """claims with verified and the first source by rank that supports them (null: none).

    A section must be named; a term's number, a fine without its commas, or one of a punishment's first three words must occur.
    strict: all three words, and the term as words. Definitions are never supported.
    """
    doc, v = F.lower(T.text_of("document")), F.col("value")
    first = F.slice(F.split(v, r"\s+"), 1, 3)
    has = lambda x: F.contains(doc, x)
    punished = F.forall(first, has) if strict else F.exists(first, has)
    term = has(v) if strict else has(F.split_part(v, F.lit(" "), F.lit(1)))
    supports = (
        F.when(F.col("type") == "section_reference", has(F.lower(v))).when(F.col("type") == "imprisonment_duration", term).when(F.col("type") == "punishment", punished)
        .when(F.col("type") == "fine_amount", F.contains(F.replace(doc, F.lit(","), F.lit("")), F.replace(v, F.lit(","), F.lit("")))).otherwise(False)
    )
    pairs = claimed.join(sources.select("response_id", "rank", F.col("id").alias("source_id"), "document"), "response_id", "left").withColumn("ok", F.coalesce(supports, F.lit(False)))
    out = pairs.groupBy("response_id", "ord", "type", "value").agg(F.max("ok").alias("verified"), F.min_by(F.when(F.col("ok"), F.col("source_id")), F.when(F.col("ok"), F.col("rank"))).alias("supported_by"))
    return out


def coverage(answers: DataFrame, checked: DataFrame) -> DataFrame:
    """(response_id, total_claims, claims_verified, citation_coverage, needs_correction) of every answer; 1.0 without claims."""
    counts = checked.groupBy("response_id").agg(F.count("*").alias("total_claims"), F.count_if("verified").alias("claims_verified"))
    out = answers.select("response_id").join(counts, "response_id", "left").select("response_id", F.coalesce("total_claims", F.lit(0)).alias("total_claims"), F.coalesce("claims_verified", F.lit(0)).alias("claims_verified"))
    share = F.when(F.col("total_claims") > 0, F.col("claims_verified") / F.col("total_claims")).otherwise(1.0)
    return out.select("*", F.round(share, 3).alias("citation_coverage"), (F.col("claims_verified") < F.col("total_claims")).alias("needs_correction"))


def note(c):
    """What is said under an answer whose coverage is below 0.8."""
    return F.when(F.col(c) < 0.8, F.concat(F.lit("Verification: "), F.format_number(F.col(c) * 100, 0), F.lit("% of the claims are supported by the sources.")))


def _numbered(pattern: int):
    return lambda v, i: F.struct(F.lit(pattern).alias("p"), i.alias("i"), v.alias("value"))


def fabricated(answers: DataFrame, year: int = 2026, id_col: str = "response_id", text_col: str = "response") -> DataFrame:
    """(response_id, type, value): section numbers over 600; citations that repeat, lie in the future, name no known court, or have a round number."""
    text = T.text_of(text_col)
    numbers = F.filter(F.regexp_extract_all(text, F.lit(r"(?i)Section\s+(\d{3,4})"), F.lit(1)), lambda n: n.cast("int") > 600)
    invalid = answers.select(id_col, F.explode(numbers).alias("value")).select(id_col, F.lit("invalid_section_number").alias("type"), "value")
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(0)), _numbered(k)) for k, p in enumerate(R.CITATION_PATTERNS)]))
    cited = answers.select(id_col, F.explode(found).alias("c")).select(id_col, "c.p", "c.i", F.trim("c.value").alias("value"))
    cited = cited.withColumn("nth", F.row_number().over(Window.partitionBy(id_col, F.lower("value")).orderBy("p", "i")))
    part = lambda g: F.regexp_extract("value", r"(?i)^(?:AIR|SCC)\s+(\d{4})\s+(\w+)\s+(\d+)", g)
    y, court, number = F.nullif(part(1), F.lit("")).cast("int"), F.nullif(part(2), F.lit("")), F.nullif(part(3), F.lit("")).cast("int")
    kind = (
        F.when(F.col("nth") > 1, "duplicate_citation").when(y > year, "future_year").when(court.isNotNull() & ~court.isin(*R.VALID_COURT_CODES), "invalid_court")
        .when(F.lower("value").startswith("air") & (number > 0) & (number % 100 == 0), "suspicious_round_number")
    )
    return invalid.unionByName(cited.select(id_col, kind.alias("type"), "value").where("type IS NOT NULL"))


def outdated(answers: DataFrame, id_col: str = "response_id", text_col: str = "response") -> DataFrame:
    """(response_id, type, value): old law treated as current beside the new, and section numbers that a code doesn't have."""
    low = F.lower(T.text_of(text_col))
    current = low.rlike(r"ipc\s+(?:provides|states|specifies|says|defines)") | low.rlike(r"under\s+ipc\s+section") | low.rlike(r"as\s+per\s+ipc")
    both = low.rlike(r"\bipc\b") & low.rlike(r"\bbns\b") & current
    over = lambda code, most, kind: F.transform(F.filter(F.regexp_extract_all(low, F.lit(rf"section\s+(\d+)\s+{code}"), F.lit(1)), lambda n: n.cast("long") > most), lambda n: F.struct(F.lit(kind).alias("type"), n.alias("value")))
    found = F.concat(F.when(both, F.array(F.struct(F.lit("ipc_treated_as_current").alias("type"), F.lit("ipc").alias("value")))).otherwise(F.expr("cast(array() as array<struct<type: string, value: string>>)")), over("ipc", 511, "invalid_ipc_section"), over("bns", 395, "invalid_bns_section"))
    return answers.select(id_col, F.explode(found).alias("f")).select(id_col, "f.type", "f.value")


def risk(covered: DataFrame, findings: DataFrame) -> DataFrame:
    """(response_id, status, findings): LOW_RISK from 0.9 without findings, MEDIUM_RISK from 0.7, else HIGH_RISK."""
    counts = findings.groupBy("response_id").agg(F.count("*").alias("findings"))
    out = covered.join(counts, "response_id", "left").withColumn("findings", F.coalesce("findings", F.lit(0)))
    status = F.when((F.col("citation_coverage") >= 0.9) & (F.col("findings") == 0), "LOW_RISK").when(F.col("citation_coverage") >= 0.7, "MEDIUM_RISK").otherwise("HIGH_RISK")
    return out.select("response_id", status.alias("status"), "findings", "citation_coverage")
