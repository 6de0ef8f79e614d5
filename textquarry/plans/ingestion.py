"""Pages to an index: parse, chunk by sections, gate, hash, drop what is stored, enrich, count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import store
from ..functions import extensions
from ..functions import legal as L
from ..functions import text as T
from ..operators import chunking
from ..sources import writers

LEAST_CHUNK, LEAST_PAGE = 50, 20


def chunks_of(pages: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """pages(source, page, text) as chunks of the index, those whose content is stored already left out.

    The id is a hash of source, page and position, so a page that is read again gives the same ids.
    """
    store.bounded_batches(pages.sparkSession)
    page = L.structure("text", "source")
    read = pages.where(F.length(F.trim(T.text_of("text"))) >= LEAST_PAGE).select(
        "source", "page", "text", T.page_hash(F.col("source"), F.col("page")).alias("page_hash"), L.act_of_title("text", "source").alias("real_act_name"), page["act"].alias("act"), page["chapter"].alias("chapter"),
        page["section_number"].alias("page_section"), page["structure_type"].alias("structure_type"),
    )
    # what is read of a page goes with its chunks: a page is read once, and nothing of it is joined again
    cut = chunking.section_chunks(read, "page_hash", "text", "act", "chapter", carried=["source", "page", "real_act_name", "act", "chapter", "page_section", "structure_type"])
    cut = cut.where(F.length(F.trim("content")) >= LEAST_CHUNK).withColumn("content_hash", T.content_hash("content"))
    out = (store.saved(cut) if stored is None else cut).dropDuplicates(["content_hash"]).withColumn("structure", F.struct("act"))
    if stored is not None:  # after the copies are gone: many of one content don't meet in a task
        out = out.join(stored.select("content_hash").distinct(), "content_hash", "left_anti")
    return out.select(
        F.sha2(F.concat_ws("|", "source", F.col("page").cast("string"), F.col("pos").cast("string")), 256).substr(1, 32).alias("id"), F.col("content").alias("document"), "source", "page", "page_hash", "content_hash",
        F.col("pos").alias("chunk_index"), F.length("content").alias("chunk_chars"), F.coalesce("real_act_name", "act").alias("act_name"), "real_act_name", "chapter", F.coalesce(F.nullif("section_number", F.lit("")), F.col("page_section")).alias("section_number"),
        F.nullif("section_title", F.lit("")).alias("section_title"), "structure_type", L.source_type("source", "structure_type", "content").alias("source_type"),
        F.col("has_proviso").alias("has_provided_that"), "has_exception", "has_illustration", *L.enriched(),
    )


def indexed(chunks: DataFrame, model=None) -> DataFrame:
    """chunks with what a search needs: tokens, cited section, act code and a vector."""
    from ..sources import readers

    return extensions.embedded(readers.with_derived(chunks), None, "id", "document", model)


def stored(chunks: DataFrame, path: str) -> None:
    writers.append(chunks.withColumn("act", F.coalesce(F.col("act_name"), F.lit("unknown"))), path, "act")


def statistics(chunks: DataFrame) -> DataFrame:
    """(structure_type, chunks, pages, acts, with_section) by type."""
    return chunks.groupBy("structure_type").agg(F.count("*").alias("chunks"), F.countDistinct("page_hash").alias("pages"), F.countDistinct("act_name").alias("acts"), F.round(F.avg(F.col("section_number").isNotNull().cast("int")), 6).alias("with_section"))


def backfilled(chunks: DataFrame) -> DataFrame:
    """chunks whose missing sections and chapters are read from their text, and whose source type is judged again."""
    empty = lambda c: F.nullif(T.text_of(c), F.lit(""))
    return chunks.withColumns({"section_number": F.coalesce(empty("section_number"), F.nullif(L.section_of_chunk("document"), F.lit(""))), "chapter": F.coalesce(empty("chapter"), F.nullif(L.chapter_of_chunk("document"), F.lit(""))), "source_type": L.source_type("source", "structure_type", "document")})


def indexed_books(chunks: DataFrame) -> DataFrame:
    return chunks.select("source").distinct()


def jobs_due(jobs: DataFrame, as_of: str) -> DataFrame:
    """Jobs(kind, last_run, every_days) with due and next_due."""
    now = F.lit(as_of).cast("date")
    return jobs.select("*", writers.reindex_due(F.col("last_run"), now, F.col("every_days")).alias("due"), F.coalesce(F.date_add("last_run", F.col("every_days")), now).alias("next_due"))
