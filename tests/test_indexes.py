"""Stored indexes, dictionary hits, global order: against brute force and the operators that read everything."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry import store
from textquarry.operators import analytics, boolean_search, dictionary, order, segments, understanding, vector_index
from textquarry.operators import retrieval as S
from textquarry.operators.segments import Index
from textquarry.operators.vector_index import VectorIndex

WORDS = [f"w{i}" for i in range(60)]


def corpus(n, seed=1, first=0):
    """Frequent and rare words, by Zipf's law."""
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    return [(first + i, " ".join(rng.choices(WORDS, weights, k=rng.randint(0, 60))) if i % 17 else None, rng.choice(["en", "fr"])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def terms_of(spark, *queries):
    return S.query_terms(spark.createDataFrame(list(enumerate(queries)), "query_id int, query string"))


def same_top(index, docs, terms, k):
    got = {(r["query_id"], r["rank"]): (r["doc_id"], round(r["score"], 9)) for r in index.top(terms, k).collect()}
    truth = {(r["query_id"], r["rank"]): (r["doc_id"], round(r["score"], 9)) for r in S.ranked(S.bm25(terms, docs), k).collect()}
    return got == truth and got


# --- segments


def stored(index):
    return sorted(map(tuple, index.postings(positions=True).select("term", "doc_id", "tf", "dl", "positions").collect())), sorted(map(tuple, index.frequencies().collect())), index.n, round(index.average, 12)


def test_appends_and_deletions_are_one_build(spark, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 8)
    rows = corpus(240)
    docs = frame(spark, rows)
    gone = {i for i in range(240) if i % 7 == 3}
    index = Index(spark, store.folder(spark))
    for low in (0, 80, 160):
        index.append(docs.where(f"doc_id >= {low} AND doc_id < {low + 80}"), ("lang",))
    index.delete(docs.where("doc_id % 7 = 3")).delete(docs.where("doc_id = 3"))
    left = [r for r in rows if r[0] not in gone]
    once = Index(spark, store.folder(spark)).append(frame(spark, left), ("lang",))
    assert stored(index) == stored(once) and index.n == len(left)
    assert sorted(map(tuple, index.documents("doc_id", "lang").drop("segment").collect())) == sorted((i, lang) for i, _, lang in left)
    asked = terms_of(spark, "w1 w7 w40", "w0 w2 w2", "w59", "nothing")
    assert same_top(index, frame(spark, left), asked, 10)
    index.merge()
    assert len(index.state["segments"]) == 1 and stored(index) == stored(once)
    assert same_top(Index(spark, index.folder), frame(spark, left), asked, 10)  # as another reader opens it


def test_a_deletion_touches_only_segments_that_hold_documents(spark):
    index = Index(spark, store.folder(spark)).append(frame(spark, corpus(20))).append(frame(spark, corpus(20, 2, first=20)))
    before = index.state["segments"]
    index.delete(spark.createDataFrame([(25,), (26,), (999,)], "doc_id long"))
    assert index.state["segments"][0] == before[0] and index.state["segments"][1]["n"] == 18
    count = len(store._numbers(spark, f"{index.folder}/state"))
    index.delete(spark.createDataFrame([(25,)], "doc_id long"))
    assert len(store._numbers(spark, f"{index.folder}/state")) == count  # gone already: nothing is written


def test_a_document_comes_back_in_another_segment(spark):
    index = Index(spark, store.folder(spark)).append(frame(spark, [(1, "old words here", "en"), (2, "stays", "en")]))
    index.delete(spark.createDataFrame([(1,)], "doc_id long")).append(frame(spark, [(1, "new words", "en")]))
    assert sorted((r["doc_id"], r["term"]) for r in index.postings().collect()) == [(1, "new"), (1, "words"), (2, "stays")]
    assert {r["term"]: r["df"] for r in index.frequencies().collect()} == {"new": 1, "words": 1, "stays": 1}


def test_a_writer_lost_midway_leaves_no_trace(spark, monkeypatch):
    index = Index(spark, store.folder(spark)).append(frame(spark, corpus(30)))
    before = stored(index)

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(store, "write_state", lost)
    with pytest.raises(RuntimeError):
        Index(spark, index.folder).append(frame(spark, corpus(30, 5, first=100)))
    assert stored(Index(spark, index.folder)) == before


def test_empty_indexes(spark):
    index = Index(spark, store.folder(spark))
    found, report = index.search(terms_of(spark, "w1"), 5)
    assert found.collect() == [] and tuple(report.first()) == (0, 0)
    index.append(frame(spark, corpus(5)).limit(0)).append(frame(spark, [(1, None, "en"), (2, "", "fr"), (None, "w1", "en")]))
    assert index.n == 2 and index.top(terms_of(spark, "w1"), 5).collect() == []


@pytest.mark.parametrize(("block", "k"), [(4, 5), (10_000, 40)])
def test_top_as_by_reading_everything(spark, monkeypatch, block, k):
    monkeypatch.setattr(segments, "BLOCK", block)
    docs = frame(spark, corpus(300, seed=block))
    index = Index(spark, store.folder(spark)).append(docs)
    assert same_top(index, docs, terms_of(spark, "w0", "w1 w50 w3", "w0 w1 w2 w3 w4 w5", "w30 w31 w31 unseen", ""), k)


def test_blocks_that_cannot_matter_stay_unread(spark, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 32)
    rows = [(i, "common " * (1 + i % 5) + ("rare " * 3 if i % 500 == 0 else "") + "filler " * (i % 40), "en") for i in range(4_000)]
    docs = frame(spark, rows)
    index = Index(spark, store.folder(spark)).append(docs)
    asked = terms_of(spark, "rare common")
    found, report = index.search(asked, 5)
    report = report.first()
    assert report["postings"] == 4_008 and report["postings_read"] < 0.25 * report["postings"]
    assert same_top(index, docs, asked, 5)


# --- boolean search


@pytest.mark.parametrize(
    ("expression", "tree"),
    [
        ("", ("and", [])), ("a b", ("and", [("word", "a"), ("word", "b")])), ("a | b c", ("and", [("or", [("word", "a"), ("word", "b")]), ("word", "c")])), ("a OR b | c", ("and", [("or", [("word", "a"), ("word", "b"), ("word", "c")])])),
        ("murder -theft", ("and", [("word", "murder"), ("not", ("word", "theft"))])), ("a AND NOT b", ("and", [("word", "a"), ("not", ("word", "b"))])), ('"Two  Words"', ("and", [("phrase", "two words")])), ("mur*", ("and", [("prefix", "mur")])),
        ("[IPC] x", ("and", [("bracket", "ipc"), ("word", "x")])), ("section:302", ("and", [("field", "section", "302")])), ("(2023) x", ("and", [("years", "2023"), ("word", "x")])), ("(2020-2023)", ("and", [("years", "2020-2023")])),
        ("(a | b) c", ("and", [("and", [("or", [("word", "a"), ("word", "b")])]), ("word", "c")])), ("a | -(b c)", ("and", [("or", [("word", "a"), ("not", ("and", [("word", "b"), ("word", "c")]))])])),
        ("(a", ("and", [("and", [("word", "a")])])), ("a |", ("and", [("word", "a")])), ("well-known", ("and", [("word", "well-known")])), ("NOT", ("and", [])),
    ],
)
def test_expressions(expression, tree):
    assert boolean_search.parsed(expression) == tree


EXPRESSIONS = ["w1", "w1 w2", "w10 | w20", "w0 -w1", "-w0", "w1* -w12", '"w0 w1"', '"w0 w1" | "w1 w0 w2"', "lang:en (w5 | w6)", "[fr] -(w0 w1)", "", "w3 | lang:fr", "w1-w2", "(w40 | (w41 -w42)) -lang:en", "NOT (w0 | w1 | w2)"]


def brute_match(expression, text, lang):
    tokens = re.findall("[a-z0-9]+", (text or "").lower())

    def test(tree):
        kind = tree[0]
        if kind in ("and", "or"):
            return (all if kind == "and" else any)(map(test, tree[1]))
        if kind == "not":
            return not test(tree[1])
        if kind == "prefix":
            return any(t.startswith(tree[1]) for t in tokens)
        if kind in ("field", "bracket"):
            return lang == tree[-1]
        wanted = re.findall("[a-z0-9]+", tree[1])
        return any(tokens[i : i + len(wanted)] == wanted for i in range(len(tokens)))

    return test(boolean_search.parsed(expression))


def test_boolean_search_from_the_index(spark, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 8)
    rows = corpus(150, 4)
    index = Index(spark, store.folder(spark)).append(frame(spark, rows[:70]), ("lang",)).append(frame(spark, rows[70:]), ("lang",))
    index.delete(spark.createDataFrame([(5,), (100,)], "doc_id long"))
    got = {tuple(r) for r in boolean_search.matches(index, dict(enumerate(EXPRESSIONS)), {"bracket": "lang"}).collect()}
    assert got == {(q, i) for q, x in enumerate(EXPRESSIONS) for i, text, lang in rows if i not in (5, 100) and brute_match(x, text, lang)}


def test_boolean_search_of_texts_knows_the_documented_signs(spark):
    docs = spark.createDataFrame([(1, "murder case", "ipc", 2021), (2, "theft and murder", "ipc", 2019), (3, "theft", None, None)], "id int, text string, act string, year int")
    ids = lambda q: sorted(r["id"] for r in boolean_search.search(docs, q).collect())
    assert ids("murder | theft") == [1, 2, 3] and ids("murder -theft") == [1] and ids("[IPC] theft") == [2] and ids("(2020-2023) murder") == [1] and ids("(2019)") == [2] and ids("-(murder | theft)") == []


def test_terms_are_found_by_ranges_in_the_scan(spark):
    index = Index(spark, store.folder(spark)).append(frame(spark, corpus(50)))
    plan = boolean_search.matches(index, {1: "w1 pre*"})._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*(In|EqualTo)\(term[^\]]*GreaterThanOrEqual\(term,pre", plan)


# --- vectors by cell


def vectors_of(spark, x, labels=None):
    return spark.createDataFrame([(i, v, int(labels[i]) if labels is not None else 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int").repartition(4)


def nearest(x, asked, k, allowed=None):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(unit[asked] @ unit.T, 9)
    if allowed is not None:
        s[:, ~allowed] = -9
    return np.lexsort((np.broadcast_to(np.arange(len(x)), s.shape), -s))[:, :k]


def probes(df):
    return df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], {})[r["rank"]] = r["doc_id"]
    return {q: [v[i] for i in sorted(v)] for q, v in out.items()}


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_and_share_of_the_vector_index(spark, clustered):
    rng = np.random.RandomState(3)
    x = rng.randn(6_000, 16).astype(np.float32)
    if clustered:
        x = (rng.randn(100, 16)[rng.randint(100, size=6_000)] * 3 + 0.5 * x).astype(np.float32)
    df = vectors_of(spark, x)
    index = VectorIndex.build(df, store.folder(spark))
    out, report = index.search(probes(df), 20)
    got, truth = found(out), nearest(x.astype(np.float64), np.arange(0, 6_000, 20), 20)
    recall = np.mean([len(set(got[20 * i]) & set(t.tolist())) / 20 for i, t in enumerate(truth)])
    report = report.first()
    assert recall >= 0.9 and report["compared"] < (0.05 if clustered else 0.25) * report["pairs"] and report["pairs"] == 300 * 6_000


def test_exact_search_and_filters(spark):
    rng = np.random.RandomState(5)
    x = (rng.randn(20, 8)[rng.randint(20, size=1_500)] * 2 + rng.randn(1_500, 8)).astype(np.float32)
    x[300:700] = x[299]  # one cell holds much
    labels = rng.randint(0, 6, 1_500)
    df = vectors_of(spark, x, labels)
    index = VectorIndex.build(df, store.folder(spark), filters=("label",))
    for where, allowed in ((None, None), (F.col("label") == 2, labels == 2), (F.col("label") == 77, labels == 77)):
        out, _ = index.search(probes(df), 10, where, exact=True)
        truth = nearest(x.astype(np.float64), np.arange(0, 1_500, 20), 10, allowed)
        assert found(out) == ({20 * i: t.tolist() for i, t in enumerate(truth)} if allowed is None or allowed.any() else {})
    plan = index.rows.where("label = 2").select("doc_id", "cell")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,2)" in plan and "vector" not in re.search("ReadSchema.*", plan)[0]


def test_hot_cells_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 50)
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", 7)
    x = np.ones((600, 4), np.float32)
    x[:100] += np.random.RandomState(1).rand(100, 4)
    df = vectors_of(spark, x)
    index = VectorIndex.build(df, store.folder(spark))
    assert found(index.search(probes(df), 5, exact=True)[0]) == {20 * i: t.tolist() for i, t in enumerate(nearest(x.astype(np.float64), np.arange(0, 600, 20), 5))}


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 1.0]), (40, None), (60, [0.0, 0.0]), (80, [float("nan"), 1.0]), (100, [1.0, None]), (120, [1.0, 2.0, 3.0]), (140, [float("inf"), 1.0]), (160, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    index = VectorIndex.build(df, store.folder(spark))
    assert found(index.search(probes(df), 5)[0]) == {0: [0, 20], 20: [20, 0]}
    none = VectorIndex.build(df.limit(0), store.folder(spark))
    assert none.search(probes(df), 5)[0].collect() == []


# --- dictionary


@pytest.mark.parametrize("most", [200_000, 7])
def test_dictionary_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(dictionary, "MOST_TERMS", most)
    rng = random.Random(2)
    terms = [None, "", "aa", "AB", "ab", "aba", "é", "b a", *("".join(rng.choice("ab ") for _ in range(rng.randint(1, 5))) for _ in range(20))]
    texts = [None, "", "ABABA", "aaaa", *("".join(rng.choice("abAé ") for _ in range(rng.randint(1, 60))) for _ in range(40))]
    got = {(r["id"], r["term"]): (r["n"], r["first"]) for r in dictionary.hits(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), spark.createDataFrame([(t,) for t in terms], "term string"), "id", "text").collect()}
    truth = {}
    for i, text in enumerate(texts):
        for t in {t.lower() for t in terms if t}:
            at = [m.start() for m in re.finditer(f"(?={re.escape(t)})", (text or "").lower())]
            if at:
                truth[i, t] = (len(at), at[0] + 1)
    assert got == truth


def test_short_terms_stand_alone(spark):
    texts = spark.createDataFrame([(1, "the fir was filed"), (2, "firm ground"), (3, "a FIR-tree, confirmed"), (4, "_fir")], "id int, text string")
    got = dictionary.hits(texts, spark.createDataFrame([("fir",), ("firm",)], "term string"), "id", "text", alone_upto=3).collect()
    assert sorted((r["id"], r["term"], r["n"]) for r in got) == [(1, "fir", 1), (2, "firm", 1), (3, "fir", 1), (3, "firm", 1)]


def test_expansion_makes_no_cross_join(spark):
    queries = spark.createDataFrame([(1, "murder trial"), (2, "larceny at night"), (3, None)], "query_id int, query string")
    synonyms = spark.createDataFrame([(1, "murder", 1, "culpable homicide"), (2, "theft", 1, "larceny"), (2, "theft", 2, "stealing")], "ord int, term string, n int, phrase string")
    out = understanding.expanded(queries, synonyms)
    assert {r["query_id"]: r["expanded"] for r in out.collect()} == {1: "murder trial culpable homicide", 2: "larceny at night stealing", 3: ""}
    assert "CartesianProduct" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


# --- order


def test_ranks_over_range_partitions(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["hot"] * 8 + ["b", None]), rng.choice([None, *range(5)])) for i in range(1_000)]
    df = spark.createDataFrame(rows, "id int, g string, v int").repartition(7)
    got = {r["id"]: r["rank"] for r in order.numbered(df, [F.desc_nulls_last("v"), "id"], ["g"]).collect()}
    for g in ("hot", "b", None):
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        assert [got[r[0]] for r in mine] == list(range(1, len(mine) + 1))
    assert sorted(r["rank"] for r in order.numbered(df, ["id"]).collect()) == list(range(1, 1_001))
    assert order.numbered(df.limit(0), ["id"]).collect() == []


def test_quantiles_of_a_hot_group_over_many_tasks(spark):
    rng = random.Random(7)
    values = {"hot": [rng.choice([1.5, rng.random() * 100]) for _ in range(3_000)], "one": [4.0], "two": [2.0, 1.0]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("hot", None), (None, 3.0)], "g string, v double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = store.saved(df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange("g", "v", "_tie").withColumn("p", F.spark_partition_id())).where("g = 'hot'").select("p").distinct().count()
        got = {r["g"]: r for r in analytics.floor_percentiles(df, "v", ["g"], {"p50": 0.5, "p95": 0.95, "p99": 0.99}).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks >= 3
    for g, vs in {**values, None: [3.0]}.items():
        ordered = sorted(vs)
        assert [got[g][p] for p in ("p50", "p95", "p99")] == [ordered[min(int(len(vs) * q), len(vs) - 1)] for q in (0.5, 0.95, 0.99)]
        assert got[g]["count"] == len(vs) and got[g]["max"] == max(vs)


def test_pages(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, 1.0, 2.0, 3.0])) for i in range(95)]
    truth = [i for i, _ in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    df = spark.createDataFrame(rows, "id int, score double").repartition(5)
    token, seen = None, []
    while True:
        shown = order.page_after(df, token, 10, "score", "id")
        ids = [r["id"] for r in shown.collect()]
        number = -(-len(seen) // 10) + 1
        by_rank = order.page(df, number, 10, [F.desc_nulls_last("score"), "id"]).orderBy("rank").collect()
        assert [r["id"] for r in by_rank] == ids and all(r["total_pages"] == 10 for r in by_rank)
        if not ids:
            break
        seen += ids
        token = order.token_of(shown, "score", "id")
    assert seen == truth


def test_sketches_merge_within_their_error(spark):
    rng = random.Random(9)
    values = [rng.gauss(0, 1) for _ in range(20_000)]
    df = spark.createDataFrame([(i % 50, v) for i, v in enumerate(values)] + [(0, None)], "h int, v double")
    fine = order.sketched(df, "v", ["h"])
    whole = order.estimated(order.merged_sketches(fine, []), {"p50": 0.5, "p99": 0.99}).first()
    ordered = np.sort(values)
    assert whole["n"] == 20_000
    for name, q in (("p50", 0.5), ("p99", 0.99)):
        assert abs(np.searchsorted(ordered, whole[name]) / 20_000 - q) < 0.0266  # twice the bound of one try in a hundred


def test_an_index_without_positions_sends_none(spark, monkeypatch):
    def without(batches, blocks=segments._blocks_of):
        batches = list(batches)
        assert all("positions" not in b.schema.names for b in batches)
        yield from blocks(batches)

    docs = spark.createDataFrame([(i, f"red fox {i % 7}", "en") for i in range(600)], "doc_id long, text string, lang string")
    blocks_of = segments._blocks_of
    monkeypatch.setattr(segments, "_blocks_of", without)
    plain = Index(spark, store.folder(spark)).append(docs, positions=False).merge()
    assert plain.postings().count() == 1800 and {r["term"]: r["df"] for r in plain.frequencies().collect()}["fox"] == 600
    monkeypatch.setattr(segments, "_blocks_of", blocks_of)
    mixed = Index(spark, store.folder(spark)).append(docs.where("doc_id < 300")).append(docs.where("doc_id >= 300"), positions=False).merge()
    assert boolean_search.matches(mixed, {1: '"red fox"', 2: "fox"}).groupBy("query_id").count().orderBy("query_id").collect() == [(1, 300), (2, 600)]
