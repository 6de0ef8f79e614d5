"""Slots for external models: embeddings, rerankers, OCR, language models. Everything runs without them.

A slot takes a plain Python function of a list of inputs; it runs in Arrow batches on the executors, with retries.
"""

from __future__ import annotations

import re
import time
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from . import text as T


_TOKEN = re.compile("[a-z0-9]+")


def hashed_vector(c, size: int = 64) -> Column:
    """A vector without a model: counts of tokens by hash, scaled to length 1 (empty texts: all 0), in Arrow batches."""

    @F.pandas_udf(t.ArrayType(t.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        def of(text):
            counts = np.bincount([zlib.crc32(w.encode()) % size for w in _TOKEN.findall((text or "").lower())] or [0], minlength=size).astype(np.float64)
            if not (text and _TOKEN.search(text.lower())):
                counts[:] = 0
            return (counts / max(np.linalg.norm(counts), 1e-12)).astype(np.float32)

        return texts.map(of)

    return run(F.col(c) if isinstance(c, str) else c)


def retried(call, attempts: int = 3, base: float = 0.5, factor: float = 2.0, most: float = 10.0, sleep=time.sleep):
    """call with waits of 0.5, 1, 2 ... at most 10 seconds between attempts; the last error is raised."""

    def run(*args):
        for i in range(attempts):
            try:
                return call(*args)
            except Exception:
                if i == attempts - 1:
                    raise
                sleep(min(base * factor**i, most))

    return run


def batched(call, kind: str, size: int = 20):
    """A column function of one text column: call(list of texts) -> list of results, `size` at a time, retried."""
    safe = retried(call)

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(texts), size):
            out += list(safe(list(texts[at : at + size])))
        return pd.Series(out, index=texts.index)

    return run


def embedded(rows: DataFrame, stored: DataFrame | None, key: str, text_col: str, model=None) -> DataFrame:
    """rows with an embedding: those whose key is stored keep theirs, the rest are embedded; so an interrupted job goes on."""
    vector = model(F.col(text_col)) if model is not None else hashed_vector(text_col)
    if stored is None:
        return rows.withColumn("embedding", vector)
    known = rows.join(stored.select(key, "embedding"), key)
    return known.unionByName(rows.join(stored.select(key), key, "left_anti").withColumn("embedding", vector))


def pair_scores(call, size: int = 32):
    """A reranker as a column function of (query, document): call(list of pairs) -> list of logits; documents are cut at 512 characters."""
    safe = retried(call)

    @F.pandas_udf(t.DoubleType())
    def run(queries: pd.Series, documents: pd.Series) -> pd.Series:
        pairs = [(q, (d or "")[:512]) for q, d in zip(queries, documents, strict=True)]
        out = []
        for at in range(0, len(pairs), size):
            out += [float(x) for x in safe(pairs[at : at + size])]
        return pd.Series(out, index=queries.index)

    return run


def merged_analysis(rules: Column, model: Column) -> Column:
    """A model's analysis where it is at least as sure as the rules, fields it lacks taken from them; without a model, the rules."""
    fields = ("intent", "source_act", "source_section", "target_act", "target_section", "search_strategy")
    sure = model.isNotNull() & (model["confidence"] >= rules["confidence"])
    return F.struct(*[F.when(sure, F.coalesce(model[f], rules[f])).otherwise(rules[f]).alias(f) for f in fields], F.when(sure, model["confidence"]).otherwise(rules["confidence"]).alias("confidence"))
