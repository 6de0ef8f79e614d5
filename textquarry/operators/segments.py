"""A stored inverted index in segments: append, delete, merge; ranked search that reads only blocks that can reach the top.

Layout. A segment holds the documents of one append: `documents` (doc_id, dl, the fields kept) and `blocks`, each file sorted by term. A block holds
some postings of a term as parallel arrays (doc_ids, tfs, dls, positions). Postings of a term are parted twice:

* by impact, into tiers of what they can add to a score, the highest first (impact order: what can't matter is never read);
* by a hash of the document into zones, in number a power of 2 that grows with the term's frequency, so that a block has about
  `BLOCK` postings of a zone at most, a frequent term is spread over many rows, and the block of a given document is known.

Each block states its size, highest tf and lowest dl, which bound its impact under any statistics of the corpus.

Upkeep. An append writes a segment, a deletion writes tombstones (documents, and term counts to be taken off) into the segments
that hold the documents, a merge writes one segment of what lives. Postings, term frequencies, the number of documents and their average
length are sums over segments less tombstones: those of one build of the same documents. The state (a line of JSON that names what counts) is
written last, so a writer lost midway leaves no trace. One writer at a time; readers keep the state they began with.

Search (`top`) is exact: MaxScore over blocks, in three readings for all queries at once. What passes from one to the next is written, so that
Spark knows its size and broadcasts it only below its threshold.

1. Of the first blocks of each term, the k documents with most of one term are scored in full: k documents surely reach the least of these scores.
2. A query's terms are ordered by the most that they can add. A block is read if its bound and the most of the later terms reach that score:
   any document of the top has its first term, in this order, in such a block. Sums of what was read raise the score to be reached.
3. Documents that can still reach it are looked up in all terms: the blocks of their zones only.

doc_id is an integer and unique among living documents; documents without an id are left out, null texts have no terms.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import store
from ..functions import text as T
from .retrieval import B, K1, broadcast_if_few

#: Postings of a term that share a zone, about.
BLOCK = 256
TIERS = 8
#: Sums of the same numbers in another order differ by less.
SLACK = 1e-6

_KEY = ["segment", "term", "tier", "zone"]


def impact(tf: Column, dl: Column, average: float, k1: float = K1, b: float = B) -> Column:
    """A posting's part of a BM25 score, less than k1 + 1."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / max(average, 1.0)))


def _zone(doc_id: Column, zones: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), zones).cast("int")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


_POSTINGS = "doc_id long, term string, tf int, dl int"
_BLOCKS = "term string, tier int, zone int, zones int, n long, max_tf int, min_dl int, doc_ids array<long>, tfs array<int>, dls array<int>"
#: Tokens worked on at once.
_TOKENS = 1 << 20


def _lists(bounds: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)


def _pieces(batches):
    """Rows (doc_id, tokens) in pieces of some _TOKENS tokens: the piece, its documents' sizes, its distinct terms, and of each token (document, term) as one number."""
    for whole in batches:
        sizes = pc.list_value_length(whole.column("tokens")).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // _TOKENS
        for lo, hi in zip(cuts := np.flatnonzero(np.concatenate([[True], np.diff(part) > 0])), [*cuts[1:], len(sizes)], strict=True):
            batch, dl = whole.slice(lo, hi - lo), sizes[lo:hi]
            terms = batch.column("tokens").flatten().dictionary_encode()
            yield batch, dl, terms, np.repeat(np.arange(len(dl)), dl) * max(1, len(terms.dictionary)) + terms.indices.to_numpy()


def _counts_of(batches):
    """(term, n): in how many documents of a piece a term is."""
    for _, _, terms, key in _pieces(batches):
        n = np.bincount(np.unique(key) % max(1, len(terms.dictionary)), minlength=len(terms.dictionary))
        yield pa.RecordBatch.from_arrays([terms.dictionary, pa.array(n)], names=["term", "n"])


def _postings_of(positions: bool):
    """A row for each distinct term of each document, with the positions it has there if asked; a document's tokens are all in its row, so nothing is shuffled."""

    def run(batches):
        for batch, dl, terms, key in _pieces(batches):
            doc = np.repeat(np.arange(len(dl)), dl)
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0])) if len(order) else np.zeros(0, np.int64)
            at, bounds = order[first], np.append(first, len(order))
            columns = [batch.column("doc_id").take(pa.array(doc[at])), terms.dictionary.take(terms.indices.take(pa.array(at))), pa.array(np.diff(bounds).astype(np.int32)), pa.array(dl[doc[at]].astype(np.int32))]
            if positions:
                position = (np.arange(len(doc)) - np.repeat(np.cumsum(dl) - dl, dl)).astype(np.int32)
                columns.append(_lists(bounds, pa.array(position[order])))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "term", "tf", "dl", "positions"][: len(columns)])

    return run


def _blocks_of(batches):
    """Postings sorted by h, a hash of (term, tier, zone), as a row for each of these; with positions if they have them."""

    def rows(table: pa.Table) -> pa.RecordBatch:
        column = {c: table.column(c).combine_chunks() for c in table.column_names}
        term, tier, zone = column["term"].dictionary_encode().indices.to_numpy(), column["tier"].to_numpy(), column["zone"].to_numpy()
        order = np.lexsort((column["doc_id"].to_numpy(), zone, tier, term, column["h"].to_numpy()))  # keys of one hash, if ever there are two, apart
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(term[order]) != 0) | (np.diff(tier[order]) != 0) | (np.diff(zone[order]) != 0)
        first = np.flatnonzero(new)
        column = {c: v.take(pa.array(order)) for c, v in column.items()}
        at, bounds = pa.array(first), np.append(first, len(order))
        reduced = lambda f, c: pa.array(f.reduceat(column[c].to_numpy(), first).astype(np.int32))
        lists = [_lists(bounds, column[c]) for c in ("doc_id", "tf", "dl", "positions") if c in column]
        return pa.RecordBatch.from_arrays(
            [*(column[c].take(at) for c in ("term", "tier", "zone", "zones")), pa.array(np.diff(bounds)), reduced(np.maximum, "tf"), reduced(np.minimum, "dl"), *lists],
            names=["term", "tier", "zone", "zones", "n", "max_tf", "min_dl", "doc_ids", "tfs", "dls", "positions"][: 7 + len(lists)],
        )

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if table.num_rows:
            h = table.column("h").to_numpy()
            last = int(np.searchsorted(h, h[-1]))  # its block may go on in the next batch
            if last:
                yield rows(table.slice(0, last))
            held = table.slice(last)
    if held is not None and held.num_rows:
        yield rows(held)


class Index:
    """The index in a folder; made by its first append."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.state = store.read_state(spark, f"{folder}/state") or {"segments": []}

    # --- upkeep

    def _wrote(self, segments: list[dict]) -> None:
        self.state = {"segments": segments}
        store.write_state(self.spark, f"{self.folder}/state", self.state)

    def _add(self, documents: DataFrame, postings: DataFrame, counts: DataFrame) -> dict:
        """Writes a segment of documents(doc_id, dl, fields), postings(doc_id, term, tf, dl, and positions if it is to have them) and counts(term, df)."""
        name = uuid.uuid4().hex
        documents.write.parquet(f"{self.folder}/{name}/documents")
        stats = self.spark.read.parquet(f"{self.folder}/{name}/documents").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
        average = stats["tokens"] / stats["n"] if stats["n"] else 0.0
        zones = F.coalesce(F.pow(F.lit(2.0), F.ceil(F.log2(F.col("df") / BLOCK))).cast("int"), F.lit(1))
        tier = F.when(F.col("df").isNull(), 0).otherwise(F.least(F.lit(TIERS - 1), F.floor((1 - impact(F.col("tf"), F.col("dl"), average) / (K1 + 1)) * TIERS))).cast("int")
        frequent = store.saved(counts.where(F.col("df") > BLOCK))
        # a list that is null makes Spark fill the whole Arrow batch again for each row: what has no positions doesn't send any
        held = "positions" in postings.columns
        placed = postings.join(broadcast_if_few(frequent), "term", "left").select("term", tier.alias("tier"), zones.alias("zones"), "doc_id", "tf", "dl", *(["positions"] if held else []))
        placed = placed.withColumn("zone", _zone(F.col("doc_id"), F.col("zones")))
        # one shuffle; rows are sorted by one number, the far fewer blocks of each file then by term
        ordered = placed.repartition("term", "tier", "zone").withColumn("h", F.xxhash64("term", "tier", "zone")).sortWithinPartitions("h")
        blocks = ordered.mapInArrow(_blocks_of, _BLOCKS + (", positions array<array<int>>" if held else ""))
        blocks = blocks if held else blocks.withColumn("positions", F.lit(None).cast("array<array<int>>"))
        blocks.sortWithinPartitions("term", "tier", "zone").write.parquet(f"{self.folder}/{name}/blocks")
        store.release(frequent)
        return {"name": name, "n": stats["n"], "tokens": stats["tokens"], "deletions": [], "positions": held}

    def append(self, docs: DataFrame, fields: tuple[str, ...] = (), text_col: str = "text", positions: bool = True) -> Index:
        """A segment of docs(doc_id, text, fields): texts are read here and never by a search. Without positions it serves ranked search only: a phrase finds nothing in it."""
        tokened = store.saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), T.tokens(text_col).alias("tokens"), *fields).where("doc_id IS NOT NULL"))
        documents = tokened.select("doc_id", F.size("tokens").alias("dl"), *fields)
        worded = tokened.where(F.size("tokens") > 0).select("doc_id", "tokens")
        postings = worded.mapInArrow(_postings_of(positions), _POSTINGS + (", positions array<int>" if positions else ""))
        counts = worded.mapInArrow(_counts_of, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))
        self._wrote([*self.state["segments"], self._add(documents, postings, counts)])
        store.release(tokened)
        return self

    def delete(self, ids: DataFrame) -> Index:
        """Tombstones for the living documents among ids(doc_id), in the segments that hold any."""
        found = store.saved(self.documents("doc_id", "dl").join(ids.select("doc_id").distinct(), "doc_id", "left_semi"))
        touched = {r["segment"]: r for r in found.groupBy("segment").agg(F.count("*").alias("n"), F.sum("dl").alias("tokens")).collect()}  # a row for each segment
        segments = []
        for s in self.state["segments"]:
            if row := touched.get(s["name"]):
                name = uuid.uuid4().hex
                gone = found.where(F.col("segment") == s["name"]).select("doc_id")
                gone.write.parquet(f"{self.folder}/{s['name']}/deletions/{name}/documents")
                gone = self.spark.read.parquet(f"{self.folder}/{s['name']}/deletions/{name}/documents")
                self._exploded(self._blocks([s])).join(broadcast_if_few(gone), "doc_id", "left_semi").groupBy("term").agg(F.count("*").alias("n")).write.parquet(f"{self.folder}/{s['name']}/deletions/{name}/terms")
                s = {**s, "n": s["n"] - row["n"], "tokens": s["tokens"] - row["tokens"], "deletions": [*s["deletions"], name]}
            segments.append(s)
        if touched:
            self._wrote(segments)
        return self

    def merge(self) -> Index:
        """One segment of all that lives; texts aren't read."""
        fields = [c for c in self.documents().columns if c not in ("segment", "doc_id", "dl")]
        held = any(s.get("positions", True) for s in self.state["segments"])
        postings = self.postings(positions=held)
        if held:  # a segment without any may be among them
            postings = postings.withColumn("positions", F.coalesce("positions", F.array().cast("array<int>")))
        self._wrote([self._add(self.documents("doc_id", "dl", *fields), postings, self.frequencies())])
        return self

    # --- what is stored

    def _blocks(self, segments: list[dict] | None = None) -> DataFrame:
        segments = self.state["segments"] if segments is None else segments
        return _union([self.spark.read.parquet(f"{self.folder}/{s['name']}/blocks").withColumn("segment", F.lit(s["name"])) for s in segments])

    @staticmethod
    def _exploded(blocks: DataFrame, *more: str, positions: bool = False) -> DataFrame:
        """A row for each posting of blocks, with the columns named."""
        arrays = {"doc_ids": "doc_id", "tfs": "tf", "dls": "dl"} | ({"positions": "positions"} if positions else {})
        if positions:  # blocks without any are zipped with nulls
            blocks = blocks.withColumn("positions", F.coalesce("positions", F.array().cast("array<array<int>>")))
        rows = blocks.select("segment", "term", *more, F.explode(F.arrays_zip(*arrays)).alias("p"))
        return rows.select("segment", "term", *more, *[F.col(f"p.{a}").alias(c) for a, c in arrays.items()])

    def _tombstones(self) -> DataFrame | None:
        parts = [self.spark.read.parquet(f"{self.folder}/{s['name']}/deletions/{d}/documents").withColumn("segment", F.lit(s["name"])) for s in self.state["segments"] for d in s["deletions"]]
        return _union(parts) if parts else None

    def _living(self, rows: DataFrame) -> DataFrame:
        gone = self._tombstones()
        return rows if gone is None else rows.join(gone, ["segment", "doc_id"], "left_anti")

    def documents(self, *columns: str) -> DataFrame:
        """segment, doc_id, dl and fields of living documents, or the columns named (segment always)."""
        parts = [self.spark.read.parquet(f"{self.folder}/{s['name']}/documents").withColumn("segment", F.lit(s["name"])) for s in self.state["segments"]]
        out = self._living(_union(parts))
        return out.select("segment", *columns) if columns else out

    def postings(self, positions: bool = False) -> DataFrame:
        """(doc_id, term, tf, dl) of living documents, with positions if asked."""
        return self._living(self._exploded(self._blocks(), positions=positions)).drop("segment")

    def postings_where(self, asked: Column, positions: bool = False) -> DataFrame:
        """(segment, doc_id, term, tf, dl) of living documents in the blocks whose terms are asked for; the condition reaches the scan of the sorted terms."""
        return self._living(self._exploded(self._blocks().where(asked), positions=positions))

    @property
    def n(self) -> int:
        return sum(s["n"] for s in self.state["segments"])

    @property
    def average(self) -> float:
        return sum(s["tokens"] for s in self.state["segments"]) / self.n if self.n else 0.0

    def frequencies(self, wanted: DataFrame | None = None) -> DataFrame:
        """(term, df) of living documents from the blocks' sizes and the tombstones' counts; wanted(term): only those."""
        parts = [self._blocks().select("term", F.col("n").cast("long").alias("df"))]
        parts += [self.spark.read.parquet(f"{self.folder}/{s['name']}/deletions/{d}/terms").select("term", (-F.col("n")).alias("df")) for s in self.state["segments"] for d in s["deletions"]]
        rows = _union(parts)
        rows = rows if wanted is None else rows.join(broadcast_if_few(wanted), "term", "left_semi")
        return rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    # --- search

    def top(self, terms: DataFrame, k: int) -> DataFrame:
        """(query_id, doc_id, score, rank): the k best documents of each query of terms(query_id, term, qtf) by BM25."""
        return self.search(terms, k)[0]

    def search(self, terms: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """What `top` gives, and one row (postings, postings_read): how many postings the queries' terms have, and how many of them were read."""
        if not self.state["segments"]:
            spark = self.spark
            return spark.createDataFrame([], "query_id int, doc_id long, score double, rank int"), spark.createDataFrame([(0, 0)], "postings long, postings_read long")
        heads = store.saved(self._blocks().select(*_KEY, "zones", "n", impact(F.col("max_tf"), F.col("min_dl"), self.average).alias("most")).join(broadcast_if_few(terms.select("term").distinct()), "term", "left_semi"))
        idf = F.log(1 + (F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighted = terms.join(self.frequencies(terms.select("term").distinct()), "term").select("query_id", "term", (idf * F.col("qtf")).alias("w"))
        weighted = weighted.join(heads.groupBy("term").agg(F.max("most").alias("top_most")), "term").withColumn("most_of_term", F.col("w") * F.col("top_most"))
        order = Window.partitionBy("query_id").orderBy(F.desc("most_of_term"), "term")
        # the terms of one query: few rows
        weights = store.saved(weighted.withColumn("later", F.coalesce(F.sum("most_of_term").over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))).withColumn("all_terms", F.sum("most_of_term").over(Window.partitionBy("query_id"))))
        least = F.coalesce("reached", F.lit(0.0)) - SLACK
        kth = lambda sums: sums.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sum")))).where(F.col("nth") <= k)

        # 1. k documents with much of one term, scored in full, reach this much at least
        first = store.saved(self._first_blocks(heads, k))
        begun = self._read(first).join(weights, "term").select("query_id", "segment", "doc_id", self._part())
        best = kth(begun.groupBy("query_id", "segment", "doc_id").agg(F.max("part").alias("sum")))
        begun = self._looked_up(store.saved(best.select("query_id", "segment", "doc_id")), weights, heads)
        first = first.unionByName(begun[1])
        floor = store.saved(kth(begun[0].groupBy("query_id", "segment", "doc_id").agg(F.sum("part").alias("sum"))).where(F.col("nth") == k).select("query_id", F.col("sum").alias("reached")))

        # 2. the blocks that a document of the top may have its first term in
        needed = store.saved(heads.join(weights, "term").join(floor, "query_id", "left").where(F.col("w") * F.col("most") + F.col("later") >= least).select("query_id", *_KEY, "w", "most_of_term", "all_terms"))
        read = store.saved(needed.select(*_KEY).distinct())
        parts = store.saved(self._read(read, "tier", "zone").join(needed, _KEY).select("query_id", "term", "segment", "doc_id", self._part(), "most_of_term", "all_terms"))
        sums = parts.groupBy("query_id", "segment", "doc_id").agg(F.sum("part").alias("sum"), (F.first("all_terms") - F.sum("most_of_term")).alias("unseen"))
        raised = kth(sums).where(F.col("nth") == k).select("query_id", F.col("sum").alias("reached")).unionByName(floor).groupBy("query_id").agg(F.max("reached").alias("reached"))
        able = sums.join(store.saved(raised), "query_id", "left").where(F.col("sum") + F.col("unseen") >= least)

        # 3. those that can still be of the top, in full
        scored, looked = self._looked_up(store.saved(able.select("query_id", "segment", "doc_id")), weights, heads)
        total = scored.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id"))
        out = total.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= k)
        used = _union([first, read, looked]).distinct().join(heads, _KEY).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("postings_read"))
        return out, heads.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("postings")).crossJoin(used)  # one row each

    def _looked_up(self, wanted: DataFrame, weights: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(query_id, segment, doc_id, part) of documents wanted(query_id, segment, doc_id) in all their query's terms, and the keys of the blocks read: those of the documents' zones."""
        placed = wanted.join(weights, "query_id").join(heads.select("segment", "term", "zones").distinct(), ["segment", "term"])
        placed = store.saved(placed.select("query_id", "segment", "doc_id", "term", "w", _zone(F.col("doc_id"), F.col("zones")).alias("zone")))
        keys = store.saved(heads.select(*_KEY).join(placed.select("segment", "term", "zone").distinct(), ["segment", "term", "zone"], "left_semi"))
        return self._read(keys).join(placed, ["segment", "term", "doc_id"]).select("query_id", "segment", "doc_id", self._part()), keys

    @staticmethod
    def _first_blocks(heads: DataFrame, k: int) -> DataFrame:
        """One block of each tier of a term, from the highest tier down to the one where k postings are together."""
        one = heads.groupBy("segment", "term", "tier").agg(F.min("zone").alias("zone"), F.min_by("n", "zone").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("term").orderBy("tier", "segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each tier
        return one.withColumn("before", before).where(F.col("before") < k).select(*_KEY)

    def _read(self, keys: DataFrame, *more: str) -> DataFrame:
        """The living postings of the blocks of distinct keys."""
        return self._living(self._exploded(self._blocks().join(keys, _KEY, "left_semi"), *more))

    def _part(self) -> Column:
        return (F.col("w") * impact(F.col("tf"), F.col("dl"), self.average)).alias("part")
