"""All terms of a dictionary in all texts, by an Aho-Corasick automaton: one walk over a text finds every term, however many there are.

The dictionary is dealt to blocks of `MOST_TERMS` terms by a hash, an automaton for each, so what is sent to a task is bounded; texts are read once for
each block. No text meets a term by a join.
"""

from __future__ import annotations

import functools
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MOST_TERMS = 200_000
#: Hits after which a task sends on what it holds.
HELD_HITS = 100_000


@functools.lru_cache(4)
def _automaton(terms: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        out.add_word(term, (number, len(term)))
    out.make_automaton()
    return out


def _word(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c == "_")


def found_in(text: str, automaton, alone: frozenset[int]) -> dict[int, list[int]]:
    """For each term that a text holds: how often (overlapping ones too) and where first. Terms of `alone` count only between other characters than word characters."""
    out: dict[int, list[int]] = {}
    for last, (number, size) in automaton.iter(text):
        at = last + 1 - size
        if number in alone and (at > 0 and _word(text[at - 1]) or last + 1 < len(text) and _word(text[last + 1])):
            continue
        if (seen := out.get(number)) is None:
            out[number] = [1, at]
        else:
            seen[0] += 1
            seen[1] = min(seen[1], at)
    return out


def _walked(sent, alone: frozenset[int]):
    """Batches (id, text) to hits of the terms in sent.value; a batch of texts goes on in batches of HELD_HITS, or of one text's hits if it has more."""

    def run(batches):
        for batch in batches:
            terms, held = sent.value, ([], [], [], [])

            def rows(held=held, batch=batch):
                row, which, n, first = held
                return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row, pa.int64())), pa.array(which, pa.string()), pa.array(n, pa.int64()), pa.array(first, pa.int64())], names=["id", "term", "n", "first"])

            for at, text in enumerate(batch.column("text")):
                for number, (n, first) in found_in(text.as_py(), _automaton(terms), alone).items():
                    for column, x in zip(held, (at, terms[number], n, first + 1), strict=True):
                        column.append(x)
                if len(held[0]) >= HELD_HITS:
                    yield rows()
                    for column in held:
                        column.clear()
            if held[0]:
                yield rows()

    return run


def hits(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str, term_col: str = "term", alone_upto: int = 0) -> DataFrame:
    """(id, term, n, first) of each term of terms(term) in each text: n occurrences, the first at that character, counted from 1. Case is ignored.

    Terms of alone_upto characters or fewer must stand alone. Null and empty terms are nowhere; null texts hold none; terms that
    differ in case only are one, in lower case. Each row of texts is looked at on its own.
    """
    kind = texts.schema[id_col].dataType.simpleString()
    lower = texts.select(F.col(id_col).alias("id"), F.lower(T.text_of(text_col)).alias("text"))
    distinct = terms.select(F.lower(F.col(term_col)).alias("term")).where("term <> ''").distinct()
    blocks = max(1, -(-distinct.count() // MOST_TERMS))

    def of_block(block: int) -> DataFrame:
        mine = distinct if blocks == 1 else distinct.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == block)
        words = tuple(sorted(r["term"] for r in mine.collect()))  # MOST_TERMS, about
        alone = frozenset(i for i, w in enumerate(words) if len(w) <= alone_upto)
        sent = texts.sparkSession.sparkContext.broadcast(words)

        out = f"id {kind}, term string, n long, first long"
        return lower.mapInArrow(_walked(sent, alone), out) if words else texts.sparkSession.createDataFrame([], out)

    return reduce(DataFrame.unionByName, [of_block(i) for i in range(blocks)]).withColumnRenamed("id", id_col)
