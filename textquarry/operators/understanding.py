"""Queries rewritten: crosswalk between old and new sections, synonyms, entities, languages, speech, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import resources as R
from ..functions import legal as L
from ..functions import text as T
from . import dictionary

THEFT = {
    "terms": "theft",
    "phrases": ("punishment for theft", "theft punishment"),
    "expansion": "Theft Section 378 IPC Section 303 BNS Punishment for theft Section 379 IPC Section 304 BNS",
    "mapping": "IPC Sections 378-379 correspond to BNS Sections 303-304 (theft and punishment for theft)",
}
MOST_WORDS = 50


def crosswalk_map(pairs: dict[str, str]) -> Column:
    return L.mapping(pairs) if pairs else F.expr("cast(map() as map<string, string>)")


def counterparts(crosswalk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """old to new, and new to old: where several old sections became one, the last in file order. Sections in capitals."""
    forward = crosswalk.select(F.upper("old_section").alias("old_section"), "new_section", "name", "note")
    back = crosswalk.groupBy(F.upper("new_section").alias("new_section")).agg(F.max_by("old_section", "ord").alias("old_section"))
    return forward, back


def normalized(queries: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """(query_id, query, normalized, mappings): old sections that a query names get their new ones appended, in file order.

    Sections are taken from the text first and then joined by equality, so no rule is tried on every query.
    """
    up = F.upper(T.text_of("query"))
    named = F.array_distinct(F.concat(F.regexp_extract_all(up, F.lit(r"\bIPC\s+([0-9A-Z]+)\b"), F.lit(1)), F.regexp_extract_all(up, F.lit(r"\bSECTION\s+([0-9A-Z]+)\b"), F.lit(1))))
    hits = queries.select("query_id", F.explode(named).alias("old_section")).join(crosswalk.withColumn("old_section", F.upper("old_section")), "old_section")
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ord", c.alias("t")))), lambda x: x["t"])
    added = hits.groupBy("query_id").agg(
        in_order(F.concat(F.lit(" "), "name", F.lit(" Section "), "new_section", F.lit(" BNS"))).alias("more"), in_order(F.concat(F.lit("BNS Section "), "new_section", F.lit(" ("), "name", F.lit(")"))).alias("mappings")
    )
    none = F.expr("cast(array() as array<string>)")
    text = F.concat(T.text_of("query"), F.array_join(F.coalesce("more", none), ""))
    theft = T.contains_any(F.lower("text"), THEFT["phrases"]) | F.lower("text").rlike(r"\btheft\b")
    out = queries.join(added, "query_id", "left").withColumn("text", text).withColumn("theft", theft)
    more = F.col("theft") & ~F.contains(F.lower("text"), F.lit(THEFT["expansion"].lower()))
    return out.select(
        "query_id", "query", F.when(more, F.concat("text", F.lit(" " + THEFT["expansion"]))).otherwise(F.col("text")).alias("normalized"),
        F.concat(F.coalesce("mappings", none), F.when(F.col("theft"), F.array(F.lit(THEFT["mapping"]))).otherwise(none)).alias("mappings"),
    )


def expanded(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(query_id, query, expanded): phrases of the dictionary terms that a query has, up to 50 words, none that it has itself.

    Terms of three letters or fewer must stand alone. Without a term, terms whose phrases the query has are taken.
    """
    forward = dictionary.hits(queries, synonyms, "query_id", "query", alone_upto=3).select("query_id", "term")
    listed = synonyms.select("ord", "n", "term", "phrase")
    fwd = listed.withColumn("term_low", F.lower("term")).select("ord", "term", "term_low").distinct().join(forward.withColumnRenamed("term", "term_low"), "term_low").select("query_id", "ord", "term")
    held = dictionary.hits(queries, synonyms, "query_id", "query", term_col="phrase").select("query_id", F.col("term").alias("phrase_low"))
    rev = listed.withColumn("phrase_low", F.lower("phrase")).join(held, "phrase_low").select("query_id", "ord", "n", "term")
    by_term = fwd.unionByName(rev.select("query_id", "ord", "term").join(fwd.select("query_id").distinct(), "query_id", "left_anti")).distinct()
    chosen = by_term.join(listed.select("ord", "n", "phrase"), "ord").join(rev.select("query_id", "ord", "n"), ["query_id", "ord", "n"], "left_anti")
    terms = by_term.groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    phrases = chosen.drop("term").join(terms, "query_id").where(~F.array_contains("terms", F.lower("phrase")))
    first = phrases.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", F.lower("phrase")).orderBy("ord", "n"))).where("_n = 1")
    listed = first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "n", "phrase"))), lambda x: x["phrase"]).alias("phrases"))
    words = F.slice(F.split(F.array_join("phrases", " "), r"\s+"), 1, MOST_WORDS)
    return queries.join(listed, "query_id", "left").select("query_id", "query", F.when(F.col("phrases").isNotNull(), F.concat(T.text_of("query"), F.lit(" "), F.array_join(words, " "))).otherwise(T.text_of("query")).alias("expanded"))


def with_entities(text: Column, e: str = "entities") -> Column:
    """A text with the names and sections of its entities that it lacks; whether it lacks them is judged once, before any is added."""
    low = F.lower(text)
    acts = F.filter(F.col(f"{e}.acts"), lambda a: ~F.contains(low, F.lower(a)))
    phrases = lambda c, tail: F.filter(F.transform(F.col(f"{e}.{c}"), lambda s: F.concat(F.lit("section "), s, F.lit(tail))), lambda p: ~F.contains(low, p))
    return F.concat_ws(" ", F.concat(F.array(text), acts, phrases("sections", ""), phrases("ipc_sections", " ipc"), phrases("bns_sections", " bns")))


def merged_entities(e: str = "entities", a: str = "analysis", forward: Column | None = None) -> Column:
    """Entities with the new numbers of their old sections, and the sections and acts of the query analysis."""
    mapped = F.filter(F.transform(F.col(f"{e}.ipc_sections"), lambda s: F.try_element_at(forward, F.upper(s))), lambda x: x.isNotNull()) if forward is not None else F.expr("cast(array() as array<string>)")
    return F.struct(
        F.array_union(F.col(f"{e}.sections"), F.col(f"{a}.section_filter")).alias("sections"), F.col(f"{e}.ipc_sections").alias("ipc_sections"), F.array_union(F.col(f"{e}.bns_sections"), mapped).alias("bns_sections"),
        F.col(f"{e}.articles").alias("articles"), F.array_union(F.col(f"{e}.acts"), F.col(f"{a}.act_filter")).alias("acts"), F.col(f"{e}.topics").alias("topics"),
    )


def compare_queries(asked: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """(query_id, side, text) of asked(query_id, act, section): the section and its counterpart in the other code, if there is one."""
    forward, back = counterparts(crosswalk)
    first = crosswalk.groupBy(F.upper("new_section").alias("_new")).agg(F.min_by("old_section", "ord").alias("_old"))
    found = asked.join(forward.select(F.col("old_section").alias("_s"), F.col("new_section").alias("_to")), F.upper("section") == F.col("_s"), "left").join(first, F.upper("section") == F.col("_new"), "left")
    other = F.when(F.col("act") == "IPC", F.col("_to")).otherwise(F.col("_old"))
    code = F.when(F.col("act") == "IPC", "BNS").otherwise("IPC")
    label = lambda s, a: F.concat(F.lit("Section "), s, F.lit(" "), a)
    both = F.filter(F.array(F.struct(F.lit("requested").alias("side"), label(F.col("section"), F.col("act")).alias("text")), F.struct(F.lit("counterpart").alias("side"), label(other, code).alias("text"))), lambda x: x["text"].isNotNull())
    return found.select("query_id", F.inline(both))


# --- languages


def to_hindi(c) -> Column:
    """Word by word: the term's Hindi, or that of the first term the word contains, or the word."""
    exact = L.mapping(R.HINDI_TERMS)
    part = lambda w: L.ordered_case([(F.contains(w, F.lit(e)), h) for e, h in R.HINDI_TERMS.items()])
    return F.array_join(F.transform(T.words(F.lower(T.text_of(c))), lambda w: F.coalesce(F.try_element_at(exact, w), part(w), w)), " ")


def to_english(c) -> Column:
    back: dict[str, str] = {}
    for english, hindi in R.HINDI_TERMS.items():
        back.setdefault(hindi, english)
    table = L.mapping(back)
    return F.array_join(F.transform(T.words(c), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def romanized(c) -> Column:
    letters = L.mapping(R.ROMAN_LETTERS)
    return F.array_join(F.transform(F.split(T.text_of(c), ""), lambda x: F.coalesce(F.try_element_at(letters, x), x)), "")


def bilingual(queries: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, language, english, hindi, transliteration): mixed texts stay as they are."""
    language = T.script_language(text_col)
    english = F.when(language == "hindi", to_english(text_col)).otherwise(T.text_of(text_col))
    hindi = F.when(language == "english", to_hindi(text_col)).when(language == "hindi", T.text_of(text_col))
    return queries.select(id_col, language.alias("language"), english.alias("english"), hindi.alias("hindi"), romanized(hindi).alias("transliteration")).withColumn("transliteration", F.when(F.col("hindi").isNotNull(), F.col("transliteration")))


def merged_results(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Results of two searches, those of the first before those of the second, each id once."""
    both = first.withColumn("_s", F.lit(0)).unionByName(second.withColumn("_s", F.lit(1)), allowMissingColumns=True)
    once = both.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("_s", "rank"))).where("_n = 1")
    return once.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("_s", "rank"))).where(F.col("position") <= k).drop("_n", "_s")


def normalized_term(c) -> Column:
    """A term's English key: itself, of its Hindi, of a Hindi number, else the term in lower case."""
    low = F.lower(T.text_of(c))
    back: dict[str, str] = {}
    for english, hindi in R.HINDI_TERMS.items():
        back.setdefault(hindi, english)
    known = {e: e for e in R.HINDI_TERMS}
    return F.coalesce(F.try_element_at(L.mapping(known), low), F.try_element_at(L.mapping(back), low), F.try_element_at(L.mapping(R.HINDI_NUMBERS), low), low)


def hindi_document_type(c) -> Column:
    low = F.lower(T.text_of(c))
    return L.ordered_case([(F.contains(low, F.lit(k.lower())), kind) for kind, keys in R.HINDI_DOCUMENTS.items() for k in keys])


# --- speech


def spoken_terms(c) -> Column:
    """Corrections word by word, then expansions, each in order on what the one before left."""
    out = F.trim(F.lower(T.text_of(c)))
    for wrong, right in R.VOICE_CORRECTIONS.items():
        out = F.regexp_replace(out, rf"(?i)\b{wrong}\b", right)
    for term, longer in R.VOICE_EXPANSIONS.items():
        out = F.replace(out, F.lit(term), F.lit(longer))
    return out


def spoken_command(c) -> Column:
    """struct(command, confidence): the first command in order with a key word in the text; 0.7, and up to 0.3 for an early one."""
    low = F.lower(T.text_of(c))
    found = L.ordered_case([(F.instr(low, F.lit(k)) > 0, F.struct(F.lit(name).alias("command"), F.round(F.lit(0.7) + F.lit(0.3) * (1 - (F.instr(low, F.lit(k)) - 1) / F.greatest(F.length(low), F.lit(1))), 6).alias("confidence"))) for name, keys in R.VOICE_COMMANDS.items() for k in keys])
    return F.coalesce(found, F.struct(F.lit(None).cast("string").alias("command"), F.lit(0.3).alias("confidence")))


KEY_TERMS = ("bail", "arrest", "cognizable", "non-cognizable", "compoundable", "warrant", "summons", "charge", "evidence", "witness", "judgment", "appeal", "offence", "punishment")


def key_terms(c) -> Column:
    """Sections, acts and key words of a spoken query, distinct and sorted."""
    low = F.lower(T.text_of(c))
    sections = F.transform(F.regexp_extract_all(low, F.lit(r"section\s*(\d+)"), F.lit(1)), lambda n: F.concat(F.lit("Section "), n))
    pattern = r"(ipc|bns|crpc|bnss|bsa)\s*section?\s*(\d+)"
    acts = F.zip_with(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)), F.regexp_extract_all(low, F.lit(pattern), F.lit(2)), lambda a, n: F.concat(F.upper(a), F.lit(" Section "), n))
    named = F.filter(F.array(*[F.when(F.contains(low, F.lit(a.lower())), F.lit(a)) for a in ("BNS", "BNSS", "BSA", "IPC", "CRPC", "CPC", "IEA")], *[F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in KEY_TERMS]), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(F.concat(sections, acts, named)))


def mapping_context(acts: DataFrame, crosswalk: DataFrame, most_acts: int = 20, most_rows: int = 32) -> DataFrame:
    """One row, the context of a model: the commonest acts (name, n), and the first rows of the crosswalk."""
    names = acts.orderBy(F.desc("n"), "name").limit(most_acts).agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("n", "name")))), lambda x: x["name"]), "; ").alias("acts"))
    rows = crosswalk.orderBy("ord").limit(most_rows)
    line = F.concat(F.lit("IPC "), "old_section", F.lit(" -> BNS "), "new_section", F.coalesce(F.concat(F.lit(" ("), "name", F.lit(")")), F.lit("")))
    lines = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("t")))), lambda x: x["t"]), "\n").alias("mappings"))
    return names.crossJoin(F.broadcast(lines))  # one row each
