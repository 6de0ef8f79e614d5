"""Inverted index tables: postings, document frequencies, corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf, dl) of each distinct term of each document.

    Counting is by (doc_id, term) with partial sums in the reading task, where all of a document's tokens are, so the
    shuffle has one row for each distinct term of a document.
    """
    tokened = docs.select(F.col(id_col).alias("doc_id"), T.tokens(text_col).alias("tokens"))
    terms = tokened.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return terms.groupBy("doc_id", "term").agg(F.count("*").cast("int").alias("tf"), F.max("dl").alias("dl"))


def term_df(posted: DataFrame) -> DataFrame:
    """(term, df): in how many documents a term occurs."""
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: n documents, avgdl tokens on average."""
    return docs.select(F.size(T.tokens(text_col)).alias("dl")).agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
