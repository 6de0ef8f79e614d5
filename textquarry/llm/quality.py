"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Statistics of whole texts (`STATISTICS`) are computed in Arrow batches; they know nothing of ids, languages or sources.
2. Boosted shallow trees are fitted to a sample of at most `SAMPLE_ROWS` labelled documents, the smallest by a hash of
   the id, so the sample is the same at every run. Each path from a root to a node is a rule: a conjunction of
   comparisons of statistics.
3. Logistic regression with an L1 penalty gives each rule a weight, mostly 0. Its strength is chosen on a part of the sample.
4. The rules that are left are compiled into one Spark column expression, which scores all documents.

Only the fit is bounded; every document's whole text is scored. Null and empty texts have all statistics 0 and get a
score as others do. With no labels, or labels of one kind, the score is the labels' mean (0.5 without any).
Null ids are not held out and learn nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .common import packed, table, unpacked

#: Most labelled rows the fit uses. It bounds what the driver gathers and what is broadcast to find their texts.
SAMPLE_ROWS = 8000
TREES, DEPTH, BINS, SHRINK, LEAST_ROWS = 40, 3, 32, 0.3, 10
PENALTIES = (0.03, 0.01, 0.003, 0.001)
THRESHOLD = 0.7

STATISTICS = (
    "n_chars", "n_words", "word_chars", "letters", "digits", "upper", "punctuation", "symbols", "wide", "spaces",
    "distinct_words", "top_word", "distinct_pairs", "short_words", "long_words", "symbol_words", "capital_words",
    "lines", "line_words", "distinct_lines", "ended_lines", "stops_per_word", "commas_per_word", "longest_word", "same_next",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode())] = True
    return out


_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTERS = _UPPER | _class("abcdefghijklmnopqrstuvwxyz")
_DIGITS = _class("0123456789")
_PUNCTUATION = _class(".,;:!?'\"()-")
_STOPS, _COMMAS, _NEWLINE = _class(".!?"), _class(","), _class("\n")
_SYMBOLS = ~(_LETTERS | _DIGITS | _PUNCTUATION | T.SPACE)
_SYMBOLS[0x80:] = False
_LEADS = np.zeros(256, dtype=bool)
_LEADS[0xC0:] = True
_HEADS = np.ones(256, dtype=bool)
_HEADS[0x80:0xC0] = False


def statistics(column) -> np.ndarray:
    """One row of STATISTICS for each text of an Arrow string column."""
    raw, offsets = T.utf8(column)
    n = len(offsets) - 1
    starts, ends, first = T.words(raw, offsets, T.SPACE)
    words = np.diff(first)

    def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
        return total[bounds[1:]] - total[bounds[:-1]]

    chars = per_text(_HEADS[raw], offsets)
    share = lambda table: per_text(table[raw], offsets) / np.maximum(chars, 1)
    w = np.maximum(words, 1)
    heads = np.concatenate(([0], np.cumsum(_HEADS[raw])))
    size = heads[ends] - heads[starts]
    of_words = lambda flags: per_text(flags, first) / w
    text_of = np.repeat(np.arange(n), words)
    h = T.hashes(raw, starts, ends)

    def distinct(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values and the count of the most frequent one, by owner."""
        # a slice has under 2^20 texts: owner and 44 bits of the hash fit one number
        v = np.sort((owner.astype(np.uint64) << np.uint64(44)) | (values >> np.uint64(20)))
        o = (v >> np.uint64(44)).astype(np.int64)
        new = np.ones(len(v), dtype=bool)
        new[1:] = v[1:] != v[:-1]
        at = np.flatnonzero(new)
        runs = np.diff(np.concatenate((at, [len(v)])))
        top = np.zeros(n)
        if len(at):
            full = np.flatnonzero(np.diff(o[at], prepend=-1))
            top[o[at][full]] = np.maximum.reduceat(runs, full)
        return np.bincount(o[at], minlength=n).astype(np.float64), top

    n_distinct, top = distinct(h, text_of)
    inner = text_of[1:] == text_of[:-1] if len(h) else np.zeros(0, bool)
    pair_of = text_of[1:][inner]
    pairs, _ = distinct((h[:-1] * np.uint64(31) + h[1:])[inner], pair_of)
    pair_counts = np.bincount(pair_of, minlength=n)
    same = np.bincount(pair_of[(h[1:] == h[:-1])[inner]], minlength=n)
    line_starts, line_ends, line_first = T.words(raw, offsets, _NEWLINE)
    lines = np.diff(line_first)
    line_of = np.repeat(np.arange(n), lines)
    distinct_lines, _ = distinct(T.hashes(raw, line_starts, line_ends), line_of)
    ended = per_text(_STOPS[raw[line_ends - 1]] if len(line_ends) else np.zeros(0), line_first)
    longest = np.zeros(n)
    if len(size):
        longest[words > 0] = np.maximum.reduceat(size, first[:-1][words > 0])
    symbol_bytes = np.concatenate(([0], np.cumsum(_SYMBOLS[raw])))
    has_symbol = symbol_bytes[ends] > symbol_bytes[starts]
    capital = _UPPER[raw[starts]] | (raw[starts] == 0xC3) if len(starts) else np.zeros(0)
    columns = [
        chars, words, per_text(size, first) / w, share(_LETTERS | _LEADS), share(_DIGITS), share(_UPPER), share(_PUNCTUATION), share(_SYMBOLS), share(_LEADS), share(T.SPACE),
        n_distinct / w, top / w, pairs / np.maximum(pair_counts, 1), of_words(size <= 3), of_words(size >= 12), of_words(has_symbol), of_words(capital),
        lines, words / np.maximum(lines, 1), distinct_lines / np.maximum(lines, 1), ended / np.maximum(lines, 1),
        per_text(_STOPS[raw], offsets) / w, per_text(_COMMAS[raw], offsets) / w, longest, same / np.maximum(pair_counts, 1),
    ]
    return np.column_stack([np.asarray(c, dtype=np.float64) for c in columns]) if n else np.zeros((0, len(STATISTICS)))


def with_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns and a struct column `stats` of each text's STATISTICS."""
    fields = [f for f in docs.schema.fields if f.name in keep]
    # the text goes through once, kept or not
    names = ["text" if f.name == text_col else f"k{i}" for i, f in enumerate(fields)]
    source = docs.select(*[F.col(f"`{f.name}`").alias(n) for n, f in zip(names, fields, strict=True)], *([] if "text" in names else [F.col(f"`{text_col}`").alias("text")]))

    def run(batches):
        for batch in (part for whole in batches for part in T.slices(whole, "text")):
            stats = statistics(batch.column("text"))
            struct = pa.StructArray.from_arrays([pa.array(stats[:, i]) for i in range(len(STATISTICS))], names=list(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), struct], names=[*names, "stats"])

    kinds = ", ".join([*(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, fields, strict=True)), "stats struct<" + ",".join(f"{s}: double" for s in STATISTICS) + ">"])
    return source.mapInArrow(run, kinds).select(*[F.col(n).alias(f.name) for n, f in zip(names, fields, strict=True)], "stats")


# --- the fit, on the driver's bounded sample


def _grow(binned: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, path: tuple, depth: int, rules: set, out: np.ndarray) -> None:
    """Grows a tree for boosting below a node; adds the path of each node to rules and the leaf values to out."""
    g, h = gradient[rows].sum(), hessian[rows].sum()
    out[rows] = -g / (h + 1.0)
    if path:
        rules.add(tuple(sorted(path)))
    if depth == 0 or len(rows) < 2 * LEAST_ROWS:
        return
    best, choice = 1e-6, None
    for f in range(binned.shape[1]):
        b = binned[rows, f]
        n = np.bincount(b, minlength=BINS).cumsum()[:-1]
        gl = np.bincount(b, gradient[rows], BINS).cumsum()[:-1]
        hl = np.bincount(b, hessian[rows], BINS).cumsum()[:-1]
        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
        gain[(n < LEAST_ROWS) | (len(rows) - n < LEAST_ROWS)] = 0
        if gain.max() > best:
            best, choice = gain.max(), (f, int(gain.argmax()))
    if choice:
        f, cut = choice
        left = binned[rows, f] <= cut
        _grow(binned, gradient, hessian, rows[left], (*path, (f, cut, True)), depth - 1, rules, out)
        _grow(binned, gradient, hessian, rows[~left], (*path, (f, cut, False)), depth - 1, rules, out)


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """Rules as tuples of (statistic, cut, at most): the paths of boosted trees. Cuts lie between values of the sample."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    score = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: set = set()
    random = np.random.RandomState(7)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        step = np.zeros(len(y))
        part = np.sort(random.permutation(len(y))[: max(2 * LEAST_ROWS, len(y) * 2 // 3)])
        grown: set = set()
        _grow(binned, p - y, p * (1 - p), part, (), DEPTH, grown, step)
        rules |= grown
        score[part] += SHRINK * step[part]
    return sorted({tuple(sorted({(f, float(cuts[f][c]), low) for f, c, low in rule})) for rule in rules if all(c < len(cuts[f]) for f, c, _ in rule)})


def fires(x: np.ndarray, rules: list[tuple]) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for f, cut, low in rule:
            out[:, j] *= (x[:, f] <= cut) == low
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient descent; the intercept isn't penalised."""
    centre = r.mean(axis=0)
    scale = np.maximum(r.std(axis=0), 0.05)
    z = (r - centre) / scale
    n, m = z.shape
    v = np.ones(m) / np.sqrt(max(m, 1))
    for _ in range(30):  # the largest eigenvalue bounds the gradient's slope
        v = z.T @ (z @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    step = 1 / (0.25 * (np.linalg.norm(z @ v) ** 2 / n + 1) + 1e-9)
    w = np.zeros(m + 1)
    w[0] = np.log(y.mean() / (1 - y.mean()))
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(ahead[0] + z @ ahead[1:])))
        new = ahead - step * np.concatenate(([(p - y).mean()], z.T @ (p - y) / n))
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (old - 1) / t * (new - w)
        w = new
    weights = w[1:] / scale
    return float(w[0] - centre @ weights), weights


class RuleEnsemble:
    """Weighted rules and an intercept; `score` is the column expression of the probability of label 1."""

    def __init__(self, intercept: float, rules: list[tuple], weights: list[float]):
        self.intercept, self.rules, self.weights = intercept, rules, weights

    @classmethod
    def fitted(cls, x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
        mean = float(y.mean()) if len(y) else 0.5
        if min(y.sum(), len(y) - y.sum()) < 2 * LEAST_ROWS:
            mean = min(max(mean, 1e-3), 1 - 1e-3)
            return cls(float(np.log(mean / (1 - mean))), [], [])
        rules = tree_rules(x, y)
        if not rules:
            return cls(float(np.log(mean / (1 - mean))), [], [])
        r = fires(x, rules)
        check = np.arange(len(y)) % 4 == 3

        def loss(penalty: float) -> float:
            b, w = lasso_logistic(r[~check], y[~check], penalty)
            p = np.clip(1 / (1 + np.exp(-(b + r[check] @ w))), 1e-6, 1 - 1e-6)
            return float(-(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)).mean())

        b, w = lasso_logistic(r, y, min(PENALTIES, key=loss))
        kept = np.flatnonzero(w)
        return cls(b, [rules[i] for i in kept], [float(w[i]) for i in kept])

    def score(self, stats: str = "stats") -> Column:
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for f, cut, low in rule:
                value = F.col(f"{stats}.{STATISTICS[f]}")
                holds = holds & ((value <= cut) if low else (value > cut))
            total = total + F.when(holds, weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """Learns from labels(doc_id, quality) of the documents that aren't held out."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).select(F.col("doc_id").alias("label_id"), "quality")
    sample = usable.orderBy(F.xxhash64("label_id"), "label_id", "quality").limit(sample_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))  # sample_rows bounds it
    rows = with_statistics(texts, ["doc_id", "quality"]).toArrow()
    x = np.column_stack([rows["stats"].combine_chunks().field(s).to_numpy(zero_copy_only=False) for s in STATISTICS]) if rows.num_rows else np.zeros((0, len(STATISTICS)))
    y = (rows["quality"].to_numpy() > 0).astype(np.float64)
    order = np.lexsort((*x.T, y, rows["doc_id"].to_numpy())) if len(y) else np.zeros(0, int)
    return RuleEnsemble.fitted(x[order], y[order])


def classified(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns of all docs, with score and predicted."""
    model = fit(docs, labels)
    return with_statistics(docs, keep).withColumn("score", model.score()).drop("stats").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs(doc_id, text, ...), same columns, that are predicted to be of quality 1."""
    return unpacked(classified(packed(docs), labels, ["doc_id", "text", "rest"]).where("predicted = 1"), docs.columns)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = classified(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
