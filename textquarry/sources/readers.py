"""Sources: corpora, binary files, logs, reference data, evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import legal as L
from ..functions import text as T


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of an index, columns pruned and filters pushed down by the scan."""
    return spark.read.parquet(path)


def from_records(spark: SparkSession, records: list[dict], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r.get(c.split()[0]) for c in schema.split(", ")) for r in records], schema)


def with_derived(chunks: DataFrame) -> DataFrame:
    """chunks with tokens, section and act, made once when an index is built and not for each query."""
    return chunks.withColumns({"tokens": T.tokens("document"), "section": L.citation_section("document"), "act": L.act_code("act_name", "source", "document")})


def matching_ids(chunks: DataFrame, where: Column, limit: int = 20) -> DataFrame:
    """The first ids, by id, that pass a filter: the filter reaches the scan, and only the limit is gathered."""
    return chunks.where(where).orderBy("id").limit(limit)


def text_books(spark: SparkSession, path: str) -> DataFrame:
    """(source, page, text): each text file is one page; bytes that aren't UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("source"), F.lit(1).alias("page"), F.decode("content", "UTF-8").alias("text"))


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime, content) of PDF files, and text files without a PDF of the same name."""
    files = spark.read.format("binaryFile").load(path).withColumn("stem", F.regexp_replace("path", r"\.[^./]*$", ""))
    pdf, txt = files.where(F.lower("path").endswith(".pdf")), files.where(F.lower("path").endswith(".txt"))
    return pdf.unionByName(txt.join(pdf.select("stem"), "stem", "left_anti").select(pdf.columns)).drop("stem")


def pdf_problem(length: Column, head: Column) -> Column:
    """Why a file is no usable PDF, by what needs no parser: null if nothing is wrong."""
    return F.when(length < 100, "too small").when(~F.startswith(head, F.lit("%PDF")), "no PDF header")


def page_text(layer: Column, ocr: Column, remote: Column, least: int = 20) -> Column:
    """The first of text layer, OCR and remote OCR that has enough characters; null: skip the page."""
    return F.coalesce(*[F.when(F.length(F.trim(x)) >= least, x) for x in (layer, ocr, remote)])


def text_quality(c, marker: str = "section") -> Column:
    n = F.length(F.trim(T.text_of(c)))
    return F.when((n > 200) & F.contains(F.lower(T.text_of(c)), F.lit(marker)), "GOOD").when(n > 50, "PARTIAL").otherwise("BAD")


def audit_events(spark: SparkSession, path: str, schema: str, limit: int | None = 100, **equal) -> DataFrame:
    """Audit events of JSON lines, newest first, malformed lines left out; equal: column values to ask for."""
    events = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    for column, value in equal.items():
        events = events if value is None else events.where(F.col(column) == value)
    events = events.orderBy(F.desc("timestamp"), "event_id")
    return events if limit is None else events.limit(limit)


def crosswalk(spark: SparkSession, path: str) -> DataFrame:
    """(ord, old_section, new_section, name, note) of a JSON file {"IPC_TO_BNS": {old: {new, name, note}}}."""
    raw = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "IPC_TO_BNS map<string, struct<new: string, name: string, note: string>>").alias("j"))
    return raw.select(F.posexplode(F.map_entries("j.IPC_TO_BNS")).alias("ord", "e")).select("ord", F.col("e.key").alias("old_section"), F.col("e.value.new").alias("new_section"), F.col("e.value.name").alias("name"), F.col("e.value.note").alias("note"))


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(ord, term, n, phrase) of a JSON file {term: [phrase, ...]}."""
    raw = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "map<string, array<string>>").alias("j"))
    terms = raw.select(F.posexplode(F.map_entries("j")).alias("ord", "e"))
    return terms.select("ord", F.col("e.key").alias("term"), F.posexplode("e.value").alias("n", "phrase"))


def with_synonyms(known: DataFrame, added: DataFrame) -> DataFrame:
    """known(ord, term, n, phrase) extended by added(term, phrase): phrases go behind those a term has, new terms behind all."""
    most = known.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("most"))
    last = known.groupBy("term", "ord").agg(F.max("n").alias("last"))
    placed = added.join(last, "term", "left").crossJoin(F.broadcast(most))  # most: one row
    return known.unionByName(placed.select(F.coalesce("ord", F.col("most") + 1).cast("int").alias("ord"), "term", (F.coalesce("last", F.lit(0)) + 1).cast("int").alias("n"), "phrase"))


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """A JSON evaluation set; raises if a row lacks query or ground_truth."""
    rows = spark.read.option("multiLine", True).json(path)
    missing = [c for c in ("query", "ground_truth") if c not in rows.columns]
    if missing or rows.where("query IS NULL OR ground_truth IS NULL").take(1):
        raise ValueError(f"evaluation rows need query and ground_truth{': no ' + ', '.join(missing) if missing else ''}")
    return rows


def query_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query string").json(path).where(F.col("query").isNotNull())


def batch_lines(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(query): lines of texts without quotes at their ends, blank lines and # comments."""
    lines = texts.select(F.explode(F.split(text_col, "\r?\n")).alias("line")).select(F.trim(F.regexp_replace(F.trim("line"), "^[\"']|[\"']$", "")).alias("query"))
    return lines.where((F.col("query") != "") & ~F.startswith(F.col("query"), F.lit("#")))


def bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The rows and the manifest of an offline bundle."""
    return spark.read.parquet(f"{path}/rows"), spark.read.json(f"{path}/manifest")
