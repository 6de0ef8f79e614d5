"""Values worked out by hand for operators that have no SQL, and plans that matter at scale."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from textquarry import fixtures
from textquarry.functions import legal as L
from textquarry.functions import text as T
from textquarry.operators import analytics, answers, boolean_search, chunking, evaluation, graph, redaction, retrieval, scoring, understanding, verification
from textquarry.sources import html, readers, writers
from textquarry.streaming import limiters, pipelines


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first()["x"]


# --- dense search


def test_dense_by_blocks_is_the_search_pair_by_pair(spark):
    """Every query meets every row by products of matrices, odd vectors pair by pair: no row for each pair, and the ranks of a cross join."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 8)).astype(np.float32).tolist()
    x[50:80] = [x[50]] * 30  # copies tie: the smallest ids stay
    rows = [(i, v) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None, *[0.5] * 6]), (902, [float("inf"), *[0.0] * 7])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = vectors.where("vec_id % 50 = 0 AND vec_id < 700").select(F.col("vec_id").cast("int").alias("query_id"), F.col("embedding").alias("vector"))
    for epsilon in (0.0, 1e-3):
        found = retrieval.dense(queries, vectors, 20, epsilon)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan.split("Union")[0] and "MapInArrow" in plan
        pairs = vectors.crossJoin(queries).select("query_id", F.col("vec_id").alias("doc_id"), T.cosine(F.col("embedding"), F.col("vector"), epsilon).alias("similarity"))
        wanted = retrieval.ranked(pairs, 20, "similarity")
        order = lambda df: sorted(map(tuple, df.select("query_id", "rank", "doc_id", "similarity").collect()), key=lambda r: r[:2])
        assert repr(order(found)) == repr(order(wanted))


# --- texts are read once


def test_searches_read_texts_once(spark):
    """Scores come from written tokens, chunks' columns are derived for what is found only, and no query is multiplied with chunks by partitions."""
    from textquarry.plans import search

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    asked, chunks = fixtures.frame(spark, "asked"), fixtures.frame(spark, "chunks")
    terms = retrieval.query_terms(asked)
    assert "regexp_extract_all" not in plan(retrieval.bm25(terms.localCheckpoint(), chunks, "id", "document"))
    assert "LeftSemi" in plan(search.scored_chunks(asked, chunks, "2024-07-01")) and "LeftSemi" in plan(search.statutes(asked, chunks, "2024-07-01"))
    found = search.entity_reranked(asked, chunks)
    assert "CartesianProduct" not in plan(found) and "BroadcastNestedLoopJoin" in plan(found)
    assert {r["query_id"] for r in found.collect()} & {1, 2, 3} == {1, 2, 3}


def test_pages_are_read_once(spark):
    """The pages' patterns are tried before anything is joined; a title's pattern only where its end is found."""
    from textquarry.plans import ingestion

    pages = fixtures.frame(spark, "statute_pages").select(F.col("filename").alias("source"), F.col("page_id").alias("page"), "text")
    plan = ingestion.chunks_of(pages)._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "LocalTableScan" not in plan
    assert one(spark, L.act_of_title("t", F.lit("x.pdf")), t="Notes on THE  ARMS ACT,  1959 and " + "the rule " * 300) == "ARMS Act, 1959"
    assert one(spark, L.act_of_title("t", F.lit("x.pdf")), t="on the Forest Act 1927 and the " * 3) == "Forest Act, 1927"
    assert one(spark, L.act_of_title("t", F.lit("My_Book_1999.pdf")), t="the act of the rule " * 100) == "My Book, 1999"


def test_dictionary_hits_go_on_in_parts(monkeypatch):
    """A task never holds the hits of a whole batch of texts."""
    from types import SimpleNamespace

    import pyarrow as pa

    from textquarry.operators import dictionary

    monkeypatch.setattr(dictionary, "HELD_HITS", 5)
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(["one two three"] * 19 + [""])], names=["id", "text"])
    out = list(dictionary._walked(SimpleNamespace(value=("one", "three", "two")), frozenset())(iter([batch])))
    assert [b.num_rows for b in out] == [6] * 9 + [3]
    assert sorted((r["id"], r["term"], r["first"]) for b in out for r in b.to_pylist()) == sorted((i, t, f) for i in range(19) for t, f in (("one", 1), ("two", 5), ("three", 9)))


# --- text


def test_tokens_and_words(spark):
    assert one(spark, T.tokens("t"), t="Section 302, IPC-2 é") == ["section", "302", "ipc", "2"]
    assert one(spark, T.words("t"), t="  a\t b\n") == ["a", "b"]
    assert one(spark, T.concept_terms("t"), t="What is the punishment for murder and theft of murder") == ["murder", "theft"]


def test_null_texts(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(T.tokens("t").alias("x")).first()["x"] == []
    assert df.select(T.snippet("t").alias("x")).first()["x"] == ""
    assert df.select(T.script_language("t").alias("x")).first()["x"] == "english"


def test_snippet_is_cut_at_280(spark):
    long = one(spark, T.snippet("t"), t="word " * 100)
    assert len(long) <= 280 and long.endswith("...")
    assert one(spark, T.snippet("t"), t="a  b") == "a b"


@pytest.mark.parametrize(("text", "day"), [("2024-06-01", "2024-06-01"), ("01-02-2020", "2020-02-01"), ("2024/03/05", "2024-03-05"), ("05/03/2019", "2019-03-05"), ("soon", None), ("2024-13-01", None)])
def test_dates(spark, text, day):
    got = one(spark, T.parse_date("t"), t=text)
    assert (got.isoformat() if got else None) == day


# --- retrieval


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "murder murder theft"), (2, "theft bail"), (3, "nothing")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "murder theft theft")], "query_id int, query string")
    got = {r["doc_id"]: r["score"] for r in retrieval.bm25(retrieval.query_terms(queries), docs).collect()}
    weight = lambda tf, df, dl: math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 2))
    assert got == {1: pytest.approx(weight(2, 1, 3) + 2 * weight(1, 2, 3)), 2: pytest.approx(2 * weight(1, 2, 2))}


def test_fusion_of_ranks_one_and_two(spark):
    s = spark.createDataFrame([(1, 7, 1)], "query_id int, doc_id long, rank int")
    b = spark.createDataFrame([(1, 7, 2), (1, 8, 1)], "query_id int, doc_id long, rank int")
    got = {r["doc_id"]: r["rrf_score"] for r in retrieval.fused(s, b).collect()}
    assert got == {7: pytest.approx(1 / 61 + 1 / 62), 8: pytest.approx(1 / 61)}


def test_min_max_of_equal_scores_is_one(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0), (2, 1, 1.0), (2, 2, 3.0)], "query_id int, doc_id int, score double")
    assert [r["normalized_score"] for r in retrieval.min_max(df).orderBy("query_id", "doc_id").collect()] == [1.0, 1.0, 0.0, 1.0]


def test_empty_inputs(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "x")], "query_id int, query string")
    assert retrieval.bm25(retrieval.query_terms(queries), docs).collect() == []
    assert chunking.fixed_windows(docs, "doc_id", "text").collect() == []


def test_tokens_are_filtered_before_they_are_counted(spark):
    """The semi join with the query's terms stands below every aggregation of postings."""
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a")], "query_id int, query string")
    plan = retrieval.bm25(retrieval.query_terms(queries), docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "en", "a", "t")], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/d")
    plan = readers.matching_ids(readers.corpus(spark, f"{tmp_path}/d").withColumnRenamed("doc_id", "id").select("id", "lang"), F.col("lang") == "en")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "source" not in plan.split("ReadSchema")[1]


# --- scoring


def test_full_legal_boost(spark):
    df = spark.createDataFrame([("302", "IPC", "Section 302 IPC", ["302"], ["IPC"])], "section string, act string, document string, s array<string>, a array<string>")
    boost, reasons = scoring.legal_boost(F.col("section"), F.col("act"), "document", F.col("s"), F.col("a"))
    row = df.select(boost.alias("b"), reasons.alias("r")).first()
    assert row["b"] == pytest.approx(0.58) and len(row["r"]) == 4


def test_recency_ends_after_110_days(spark):
    boost = lambda day: one(spark, scoring.jurisdiction_boost(F.lit("Supreme Court"), F.to_date("d"), "2024-07-01"), d=day)
    assert boost("2024-07-01") == pytest.approx(0.06)
    assert boost("2024-06-01") == pytest.approx(0.06 - 30 / 3650)
    assert boost("2024-01-01") == pytest.approx(0.03)


def test_heuristic_score_is_clamped(spark):
    assert one(spark, scoring.heuristic_score(F.col("r"), F.lit(1.0), F.lit(1.0), F.lit(1.0)), r=0.03) == 1.0
    assert one(spark, scoring.heuristic_score(F.col("r"), F.lit(0.0), F.lit(0.0), F.lit(-5.0)), r=0.03) == 0.0


def test_precedent_strength(spark):
    df = spark.createDataFrame([(5, "supreme_court"), (1, "delhi_high_court")], "b int, c string").select(scoring.precedent_strength("b", "c").alias("x"))
    assert [r["x"] for r in df.collect()] == [pytest.approx(1.0), pytest.approx(0.46)]


def test_answer_confidence(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.5)], "response_id int, rank int, similarity double")
    assert answers.confidence(df).first()["confidence"] == 83


# --- understanding


@pytest.mark.parametrize(
    ("query", "route", "confidence"),
    [("Section 302 IPC", "LEGAL_RESEARCH", 0.97), ("file a civil suit", "LEGAL_RESEARCH", 0.93), ("grant of bail", "LEGAL_RESEARCH", 0.88), ("is a confession any good", "LEGAL_RESEARCH", 0.85), ("scan the pdf", "DOCUMENT_ANALYSIS", 0.94), ("my next move now then", "STRATEGIC_ADVICE", 0.91), ("hello", "GENERAL", 0.4), ("tell me of the blue sky at noon", "GENERAL", 0.7), ("  ", "GENERAL", 0.1)],
)
def test_rule_route(spark, query, route, confidence):
    assert tuple(one(spark, L.rule_route("q"), q=query)) == (route, confidence)


def test_parse_confidence(spark):
    assert one(spark, L.entities("q"), q="theft")["confidence"] == 0.6
    assert one(spark, L.entities("q"), q="theft and murder")["confidence"] == 0.8
    e = one(spark, L.entities("q"), q="Sections 302 and 376 IPC, article 21 applies")
    assert (e["ipc_sections"], e["articles"]) == (["302", "376"], ["21"])


def test_model_route_needs_confidence(spark):
    rules = F.struct(F.lit("GENERAL").alias("route"), F.lit(0.4).alias("confidence"))
    model = lambda c: F.struct(F.lit("legal_research").alias("route"), F.lit(c).alias("confidence"))
    assert one(spark, L.resolved_route(rules, model(0.6)), q=1)["route"] == "LEGAL_RESEARCH"
    assert one(spark, L.resolved_route(rules, model(0.5)), q=1)["route"] == "GENERAL"


def test_analysis_of_a_comparison(spark):
    a = one(spark, L.analysis("q", understanding.crosswalk_map({"302": "101"}), understanding.crosswalk_map({"101": "302"})), q="What is the BNS equivalent of IPC Section 302?")
    assert (a["intent"], a["confidence"], a["target_section"], a["search_strategy"]) == ("cross_act_mapping", 0.95, "101", "filtered_dual_act")


def test_expansion_is_capped_at_50_words(spark):
    many = [(1, "theft", i, f"phrase{i} with four words") for i in range(30)]
    out = understanding.expanded(spark.createDataFrame([(1, "theft")], "query_id int, query string"), spark.createDataFrame(many, "ord int, term string, n int, phrase string")).first()["expanded"]
    assert len(out.split()) == 51


# --- chunks


def chunks(text, act="", chapter=""):
    return chunking.section_chunks_of(text, act, chapter)


def test_section_chunks():
    got = chunks("Section 1. Title one\nBody of it, long enough.\nProvided that x.\nSection 2. Other\nBody of the second.\nIllustration: y", "Act A", "Chapter I")
    assert [c["section_number"] for c in got] == ["1", "2"]
    assert got[0]["content"].startswith("[Act A | Chapter I | Section 1: Title one]\n") and got[0]["has_proviso"] and not got[0]["has_illustration"]
    assert got[1]["has_illustration"]


def test_text_without_sections_is_one_chunk():
    assert [c["content"] for c in chunks("  plain text ")] == ["plain text"]
    assert chunks("  ") == [] and chunks(None) == []


def test_short_sections_join_the_next():
    got = chunks("Section 5.\nSection 6. Scope of the law\nThe body of section six.")
    assert [c["section_number"] for c in got] == ["6"] and "Section 5." in got[0]["content"]


def test_long_sections_are_cut_at_marks():
    text = "Section 9. Long\nHead text here.\n" + "".join(f"({x}) " + "word " * 500 for x in "abc")
    assert len(chunks(text)) == 3
    assert len(chunking.section_chunks_of(text, "", "", keep_head=True)) == 4


def test_windows(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(1700))), (2, ""), (3, None)], "doc_id long, text string")
    got = chunking.fixed_windows(docs, "doc_id", "text").collect()
    assert [len(r["chunk"].split()) for r in sorted(got, key=lambda r: r["pos"])] == [800, 800, 400]
    got = chunking.boundary_windows(docs, "doc_id", "text").collect()
    assert [len(r["chunk"].split()) for r in sorted(got, key=lambda r: r["pos"])] == [800, 800, 100]


def test_boundary_windows_snap(spark):
    text = " ".join(["w"] * 700) + "\nSection 5. " + " ".join(["v"] * 300)
    got = chunking.boundary_windows(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text").orderBy("pos").collect()
    assert [len(r["chunk"].split()) for r in got] == [700, 302]


def test_paragraph_packs(spark):
    text = "\n\n".join(["a" * 200] * 5)
    got = chunking.paragraph_packs(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text").orderBy("pos").collect()
    assert [len(r["chunk"]) for r in got] == [402, 402, 200]


# --- verification


def test_no_claims_is_full_coverage(spark):
    a = spark.createDataFrame([(1, "nothing said")], "response_id int, response string")
    checked = verification.verified(verification.claims(a), fixtures.frame(spark, "evidence"))
    assert tuple(verification.coverage(a, checked).first()) == (1, 0, 0, 1.0, False)


def test_strict_verification_is_stricter(spark):
    a = spark.createDataFrame([(1, "Punishment is exile or worse.")], "response_id int, response string")
    e = spark.createDataFrame([(1, 1, "s", "this is a text")], "response_id int, rank int, id string, document string")
    assert verification.verified(verification.claims(a), e).first()["verified"]
    assert not verification.verified(verification.claims(a), e, strict=True).first()["verified"]


# --- analytics and state


def test_overview(spark):
    log = spark.createDataFrame([("q", "R", 90.0, 1, 100.0, True, 10), ("q", "R", 10.0, 1, 200.0, False, 20), ("z", None, None, 0, None, False, 30)], "query string, route string, confidence double, result_count int, response_ms double, cache_hit boolean, created_at long")
    assert tuple(analytics.overview(log).first()) == (3, 150.0, 33.3)
    assert tuple(analytics.overview(log.limit(0)).first()) == (0, 0.0, 0.0)
    assert {r["query"]: r["avg_ms"] for r in analytics.patterns(log, poison=True).collect()} == {"q": 150.0, "z": None}


def test_floor_percentile_of_a_hundred(spark):
    df = spark.range(1, 101).selectExpr("cast(id as double) as v", "1 as g")
    assert analytics.floor_percentiles(df, "v", ["g"], {"p95": 0.95}).first()["p95"] == 96.0


def test_cache(spark):
    schema = "cache_key string, query_text string, response string, created_at long, expires_at long, hit_count long"
    cache = spark.createDataFrame([("a", "A", "ra", 1, 100, 5), ("b", "B", "rb", 2, 10, 0), ("c", "C", "rc", 3, 100, 0)], schema)
    entries = spark.createDataFrame([("b", "B", "rb2", 9, 100, 0)], schema)
    assert sorted((r["cache_key"], r["response"]) for r in analytics.cache_put(cache, entries, 2).collect()) == [("a", "ra"), ("b", "rb2")]
    hits, misses = analytics.cache_get(cache, spark.createDataFrame([("a",), ("b",), ("x",)], "cache_key string"), 50)
    assert ([r["cache_key"] for r in hits.collect()], sorted(r["cache_key"] for r in misses.collect())) == (["a"], ["b", "x"])


def replayed(spark, rule, times):
    events = spark.createDataFrame([(i, "k", float(t)) for i, t in enumerate(times)], "id long, k string, t double")
    return [(r["allowed"], r["retry_after"]) for r in limiters.replay(events, "k", "t", "id", rule).orderBy("id").collect()]


def test_token_bucket(spark):
    assert replayed(spark, limiters.TokenBucket(2, 1.0), [0, 0, 0, 0.5, 1.5]) == [(True, 0), (True, 0), (False, 2), (False, 1), (True, 0)]


def test_sliding_window_counts_accepted_requests_only(spark):
    assert replayed(spark, limiters.SlidingWindow(2, 10), [0, 1, 2, 10.5, 11.5]) == [(True, 0), (True, 0), (False, 9), (True, 0), (True, 0)]


def test_scopes_charge_those_before_the_one_that_refuses(spark):
    rule = limiters.Scopes((limiters.SlidingWindow(2, 1), limiters.SlidingWindow(2, 100)))
    assert [a for a, _ in replayed(spark, rule, [0, 5, 10, 10.5, 10.6])] == [True, True, False, False, False]


def test_blocking(spark):
    rule = limiters.Blocking(limiters.SlidingWindow(1, 10), 300)
    assert [a for a, _ in replayed(spark, rule, [0, 1, 200, 302])] == [True, False, False, True]


def test_ttl_entry_isnt_renewed_by_hits(spark):
    assert [a for a, _ in replayed(spark, limiters.TtlEntry(10), [0, 6, 12, 13])] == [False, True, False, True]


# --- graph, evaluation, inputs


def test_bfs_skips_unknown_cases(spark):
    got = graph.within(fixtures.frame(spark, "cites"), spark.createDataFrame([("e",)], "start string"), 2).collect()
    assert {(r["node"], r["distance"]) for r in got} == {("d", 1), ("zz", 1), ("f", 1), ("c", 2)}


def test_ratio(spark):
    assert one(spark, graph.ratio_decidendi("t"), t="So holding that the accused\nmust be heard. More.") == "the accused\nmust be heard"


def test_markdown_and_comparison(spark):
    got = evaluation.compared(fixtures.frame(spark, "runs"), "base", "new").orderBy("metric").collect()
    assert [(r["metric"], r["verdict"]) for r in got] == [("latency_ms", "regressed"), ("recall", "improved")]


def test_redaction(spark):
    rows = {r["line_id"]: r["redacted"] for r in fixtures.frame(spark, "log_lines").select("line_id", redaction.redacted("message").alias("redacted")).collect()}
    assert rows[1] == "api_key=[REDACTED] sent" and rows[3] == "Authorization: Bearer [REDACTED_JWT]" and rows[6] == "key gsk_ABCD[REDACTED] end" and rows[8] == "nothing to hide" and rows[9] is None
    masked = one(spark, redaction.masked_values(F.create_map(F.lit("API-Key"), F.lit("123456789"), F.lit("token"), F.lit("x"), F.lit("note"), F.lit("password=abc"))), q=1)
    assert masked == {"API-Key": "1234[REDACTED]", "token": "[REDACTED]", "note": "password=[REDACTED]"}


@pytest.mark.parametrize(("kind", "raw", "ok"), [("email", " A@B.org ", True), ("email", "nope", False), ("filename", "a/../b.pdf", True), ("filename", "x.EXE", False), ("username", "a b", False), ("api_key", "k" * 32, True), ("query", "x;y", False), ("query", None, False)])
def test_checked(spark, kind, raw, ok):
    df = spark.createDataFrame([(raw,)], "v string").select(redaction.checked("v", kind).alias("c"))
    assert (df.first()["c"]["error"] is None) == ok


def test_boolean_search(spark):
    docs = spark.createDataFrame([(1, "Bail granted in theft case", "en"), (2, "no bail, murder", "en"), (3, "thefts by night", "fr")], "id int, text string, lang string")
    ids = lambda q: sorted(r["id"] for r in boolean_search.search(docs, q).collect())
    assert ids("bail") == [1, 2] and ids("bail NOT murder") == [1] and ids("murder OR theft") == [1, 2] and ids("theft*") == [1, 3] and ids('"granted in"') == [1] and ids("lang:fr") == [3] and ids("") == [1, 2, 3]


def test_search_results_page(spark):
    page = '<div class="result"> <div class="result_title"><a x href="/doc/12/">A <b>v</b> B</a></div><p></p><div class="result_excerpt">text <i>here</i></div></div>'
    assert [tuple(r) for r in html.search_hits(spark.createDataFrame([(1, page)], "id int, h string"), "id", "h").collect()] == [(1, "12", "A v B", "text here")]


# --- sources and sinks


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF" + b"x" * 200)
    (tmp_path / "a.txt").write_text("twin")
    (tmp_path / "b.txt").write_text("Section 1. text")
    assert sorted(r["path"].rsplit("/", 1)[1] for r in readers.pdf_files(spark, str(tmp_path)).collect()) == ["a.pdf", "b.txt"]
    assert {r["source"]: r["text"] for r in readers.text_books(spark, str(tmp_path)).collect()} == {"a.txt": "twin", "b.txt": "Section 1. text"}


def test_versions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, t string")
    writers.save_version(df, str(tmp_path), "v1", "2024-01-01")
    writers.save_version(df.union(df), str(tmp_path), "v2", "2024-02-01")
    assert [(r["version"], r["n_rows"]) for r in writers.versions(spark, str(tmp_path)).collect()] == [("v2", 2), ("v1", 1)]
    assert (writers.at_version(spark, str(tmp_path)).count(), writers.at_version(spark, str(tmp_path), "v1").count()) == (2, 1)


def test_bundle(spark, tmp_path):
    df = spark.createDataFrame([("IPC", "x"), ("BNS", "yy")], "act string, text string")
    writers.write_bundle(df, f"{tmp_path}/b", "act", "text")
    rows, manifest = readers.bundle(spark, f"{tmp_path}/b")
    assert rows.count() == 2 and (manifest.first()["rows"], manifest.first()["bytes"], manifest.first()["acts"]) == (2, 3, ["BNS", "IPC"])


def test_reference_files(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"IPC_TO_BNS": {"302": {"new": "101", "name": "Murder"}, "34": {"new": "3", "name": "Intent", "note": "n"}}}')
    (tmp_path / "s.json").write_text('{"murder": ["homicide", "killing"]}')
    assert [(r["old_section"], r["new_section"], r["note"]) for r in readers.crosswalk(spark, f"{tmp_path}/m.json").orderBy("ord").collect()] == [("302", "101", None), ("34", "3", "n")]
    assert [(r["term"], r["phrase"]) for r in readers.synonyms(spark, f"{tmp_path}/s.json").orderBy("n").collect()] == [("murder", "homicide"), ("murder", "killing")]
    (tmp_path / "e.json").write_text('[{"query": "q", "ground_truth": "g"}]')
    assert readers.evaluation_set(spark, f"{tmp_path}/e.json").count() == 1
    (tmp_path / "e.json").write_text('[{"query": "q"}]')
    with pytest.raises(ValueError):
        readers.evaluation_set(spark, f"{tmp_path}/e.json")


def test_audit_log(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"event_id": "1", "timestamp": 5.0, "event_type": "login", "user_id": "u"}\nbroken\n{"event_id": "2", "timestamp": 9.0, "event_type": "login", "user_id": "v"}\n')
    schema = "event_id string, timestamp double, event_type string, user_id string"
    assert [r["event_id"] for r in readers.audit_events(spark, str(tmp_path), schema, event_type="login", user_id=None).collect()] == ["2", "1"]


# --- streams


def test_streams_equal_batches(spark, tmp_path):
    events = spark.createDataFrame([(i, f"u{i % 3}", float(i)) for i in range(30)], "id long, k string, t double").withColumn("ts", F.timestamp_seconds("t"))
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = pipelines.event_stream(spark, f"{tmp_path}/in", "id long, k string, t double, ts timestamp")

    def drained(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    got = drained(pipelines.tumbling(stream, "ts", "10 seconds", "1 second"), "tumbled", "complete")
    assert sorted(r["count"] for r in got) == [10, 10, 10]
    rule = limiters.SlidingWindow(2, 9)
    got = {(r["k"], r["t"]): r["allowed"] for r in drained(limiters.streamed(stream, "k", "t", rule), "limited", "append")}
    batch = {(r["k"], r["id"]): r["allowed"] for r in limiters.replay(events, "k", "t", "id", rule).collect()}
    assert got == {(k, float(i)): a for (k, i), a in batch.items()}


def test_new_files_are_read_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x")

    def run():
        q = pipelines.new_files(spark, f"{tmp_path}/in").select("path").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.read.parquet(f"{tmp_path}/out").count()

    assert run() == 1
    (tmp_path / "in" / "b.txt").write_text("y")
    assert run() == 2


def test_audit_sink(spark, tmp_path):
    spark.createDataFrame([("1", 86400.0 * 3), ("2", 86400.0 * 4)], "event_id string, timestamp double").write.parquet(f"{tmp_path}/in")
    stream = pipelines.event_stream(spark, f"{tmp_path}/in", "event_id string, timestamp double")
    pipelines.audit_sink(stream, f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(str(r["day"]) for r in spark.read.json(f"{tmp_path}/out").collect()) == ["1970-01-04", "1970-01-05"]


def test_item_cache_drops_what_expires_first(spark):
    rule, state, seen = limiters.ItemCache(10, 2), {}, []
    for t, item in [(0, "a"), (1, "b"), (2, "a"), (3, "c"), (4, "a"), (20, "c")]:
        state, hit, size, _ = rule.step(state, t, item)
        seen.append((hit, size))
    assert seen == [(False, 1), (False, 2), (True, 2), (False, 2), (False, 2), (False, 1)]


# --- slots and plans


def test_models_are_called_in_batches_and_retried(spark):
    calls: list = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise OSError("once")
        return [float(len(x)) for x in texts]

    from textquarry.functions import extensions

    assert extensions.retried(flaky, sleep=lambda s: None)(["ab", "c"]) == [2.0, 1.0] and calls == [2, 2]
    model = extensions.batched(lambda texts: [[float(len(x or ""))] for x in texts], "array<float>")
    df = spark.createDataFrame([(i, "x" * i) for i in range(50)], "id int, text string")
    assert sorted(r["e"][0] for r in df.select(model("text").alias("e")).collect()) == [float(i) for i in range(50)]


def test_reranker_slot(spark):
    from textquarry.functions import extensions

    df = spark.createDataFrame([(1, "q", "short", 0.1, 0.1, 0.1, 0.1)], "query_id int, query string, document string, rrf_score double, bm25_score double, semantic_score double, boost_score double")
    model = extensions.pair_scores(lambda pairs: [0.0 for _ in pairs])
    assert scoring.reranked(df, model("query", "document")).first()["reranker_score"] == 0.5


def test_model_analysis_wins_only_if_surer(spark):
    from textquarry.functions import extensions

    kind = "struct<intent: string, source_act: string, source_section: string, target_act: string, target_section: string, search_strategy: string, confidence: double>"
    df = spark.createDataFrame([(("a", "x", "1", None, None, "s", 0.7), ("b", None, "2", None, None, "t", 0.9)), (("a", "x", "1", None, None, "s", 0.7), ("b", None, "2", None, None, "t", 0.1)), (("a", "x", "1", None, None, "s", 0.7), None)], f"rules {kind}, model {kind}")
    got = [r["m"] for r in df.select(extensions.merged_analysis(F.col("rules"), F.col("model")).alias("m")).collect()]
    assert [(m["intent"], m["source_act"], m["source_section"]) for m in got] == [("b", "x", "2"), ("a", "x", "1"), ("a", "x", "1")]


def test_ingestion_is_repeatable(spark, tmp_path):
    from textquarry.plans import ingestion

    pages = fixtures.frame(spark, "statute_pages").select(F.col("filename").alias("source"), F.col("page_id").alias("page"), "text")
    first = ingestion.chunks_of(pages)
    assert sorted(r["id"] for r in first.collect()) == sorted(r["id"] for r in ingestion.chunks_of(pages).collect())
    ingestion.stored(first, f"{tmp_path}/index")
    stored = spark.read.parquet(f"{tmp_path}/index")
    assert stored.count() == first.count() and ingestion.chunks_of(pages, stored).count() == 0
    assert ingestion.indexed(first).where(F.size("embedding") == 64).count() == first.count()


def test_pages_given_twice_give_their_chunks_once(spark):
    """What is read of a page goes with its chunks: nothing of it is joined again, once by once or with a store."""
    from textquarry.plans import ingestion

    pages = fixtures.frame(spark, "statute_pages").select(F.col("filename").alias("source"), F.col("page_id").alias("page"), "text")
    once = ingestion.chunks_of(pages)
    twice = ingestion.chunks_of(pages.unionByName(pages))
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect())) and once.count() == 4
    fresh = ingestion.chunks_of(pages, once.where("source <> 'bns_notes.pdf'"))
    assert [r["source"] for r in fresh.collect()] == ["bns_notes.pdf"]
    plan = fresh._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("MapInArrow") == 1


def test_ingestion_bounds_its_batches(spark, tmp_path):
    """Pages go between the JVM and Python in batches of some 4 MB, whatever the session's setting."""
    import pyarrow as pa

    from textquarry.plans import ingestion

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "64m")
        spark.range(300).selectExpr("'x.pdf' AS source", "CAST(id AS INT) AS page", "repeat(concat(id, ' words '), 8000) AS text").coalesce(1).write.parquet(f"{tmp_path}/pages")
        pages = spark.read.parquet(f"{tmp_path}/pages")
        assert ingestion.chunks_of(pages).count() == 300
        sizes = pages.mapInArrow(lambda batches: (pa.record_batch({"n": [b.nbytes] * b.num_rows}, pa.schema([("n", pa.int64())])) for b in batches), "n long").distinct().collect()
        assert max(r["n"] for r in sizes) < 8 << 20
    finally:
        spark.conf.set(name, before)


def test_marks_are_tried_at_lines_only():
    text = "Section 5.\nSection 6. Scope\n  Section 7. x\n\n8. Above\n9. low\nsec. 10B \n\nProvided\nthat x\nof s. 5 Exception:\n"
    for cut in range(len(text)):
        for t in (text[cut:], text[:cut]):
            for pattern in (chunking._SECTION, *chunking._FLAGS.values()):
                assert [m.span() for m in chunking._at_lines(pattern, t)] == [m.span() for m in pattern.finditer(t)]
            slow, fast = chunking._TITLE.search(t), chunking._ASCII_TITLE.search(t)
            assert (slow and slow[1]) == (fast and fast[1])


def test_texts_made_plain_in_arrow(spark, tmp_path):
    texts = ["a-b  c", " x ", "...", "", None, "é漢a\u00a0😀9", "plain", "\x00\x1ctab\tnew\n", "-a", "a-"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, expected = (sorted(fixtures.over(spark, str(tmp_path), "statute_pages", fast).collect()) for fast in (True, False))
    assert got == expected and len(got) == len(texts)


def test_rows_of_a_batch_without_results_stay(spark):
    from textquarry.plans import answering

    queries = spark.createDataFrame([(1, "q"), (2, " ")], "query_id int, query string")
    results = spark.createDataFrame([(1, "x")], "query_id int, id string")
    assert sorted(tuple(r) for r in answering.batch(queries, results).collect()) == [(1, "q", 1, None), (2, " ", 0, "empty query")]


def test_filtered_search_keeps_the_one_chunk_that_fits(spark):
    """Many chunks of another act repeat the query's words; the one of the section and act asked for comes back, by words and by vectors."""
    from textquarry import fixtures
    from textquarry.plans import search

    columns = fixtures.TABLES["chunks"][0]
    rows = [(f"x{i}", "Section 302 IPC punishment for murder, punishment for murder.", f"b{i}.pdf", i, f"p{i}", "CrPC", "12", None, "commentary", None, None, "commentary") for i in range(60)]
    rows += [("fit", "Whoever commits murder shall be punished.", "code.pdf", 9, "p900", "IPC", "302", None, "bare_act", None, None, "bare_act")]
    chunks = spark.createDataFrame(rows, columns)
    queries = spark.createDataFrame([(1, "Section 302 IPC punishment for murder")], "query_id int, query string")
    assert [r["id"] for r in search.statutes(queries, chunks, "2024-07-01", filtered=True).collect()] == ["fit"]
    assert "fit" not in [r["id"] for r in search.statutes(queries, chunks, "2024-07-01").collect()]
    vectors = spark.createDataFrame([(r[0], [0.0, 1.0] if r[0] == "fit" else [1.0, 0.01 * i]) for i, r in enumerate(rows)], "vec_id string, embedding array<double>")
    probes = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    both = search.statutes(queries, chunks, "2024-07-01", filtered=True, probes=probes, vectors=vectors).collect()
    assert [(r["id"], r["tier"]) for r in both] == [("fit", 1)] and both[0]["rrf_score"] == pytest.approx(2 / 61)
    whole = search.statutes(queries, chunks, "2024-07-01", probes=probes, vectors=vectors).collect()
    assert len(whole) == 5 and all(r["semantic_score"] > 0 or r["bm25_score"] > 0 for r in whole) and any(r["boost_score"] > 0 for r in whole)


def test_packs_and_windows_of_odd_texts(spark):
    texts = ["", None, "   \n\n  ", "one", "a\n\nb\n\n" + "c" * 600 + "\n\nd", " ".join(f"w{i}." if i % 37 == 0 else f"w{i}" for i in range(700)), "x" * 60, "Section 1. A\n" + "w " * 700 + "\nSection 2. B\n" + "v " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    packs = {}
    for r in chunking.paragraph_packs(docs, "doc_id", "text").collect():
        packs.setdefault(r["doc_id"], {})[r["pos"]] = r["chunk"]
    assert [packs[4][i] for i in range(len(packs[4]))] == ["a\n\nb", "c" * 600, "d"] and packs[3] == {0: "one"} and not {0, 1, 2} & set(packs)
    windows = {}
    for r in chunking.sentence_windows(docs, "doc_id", "text").orderBy("pos").collect():
        windows.setdefault(r["doc_id"], []).append(r["chunk"].split(" "))
    assert set(windows) == {4, 5, 6, 7} and windows[6] == [["x" * 60]]
    assert windows[5][0][-1] == "w148." and windows[5][1][0] == "w119" and windows[5][-1][-1] == "w699"
    cut = [r["chunk"] for r in chunking.boundary_windows(docs, "doc_id", "text").where("doc_id = 7").orderBy("pos").collect()]
    assert cut[1].startswith("Section 2. B") and " ".join(cut).split() == texts[7].split()


def test_windows_of_a_long_text_are_cut_in_one_pass(spark):
    words = [f"w{i}" + ("." if i % 53 == 0 else "?" if i % 41 == 0 else "") for i in range(60_000)]
    docs = spark.createDataFrame([(1, "\u00a0 " + "\n".join(words) + " \u2003"), (2, "\u2003" + "y" * 49 + "\u00a0")], "doc_id long, text string")
    chunks = chunking.sentence_windows(docs, "doc_id", "text")
    assert "aggregate" not in chunks._jdf.queryExecution().analyzed().toString()  # which copies all windows found for each word
    rows = chunks.orderBy("pos").collect()
    assert {r["doc_id"] for r in rows} == {1} and [r["pos"] for r in rows] == list(range(len(rows))) and any(r["chunk"].split()[-1:] == ["w59999"] or "w59999 " in r["chunk"] for r in rows)


def test_hops_read_only_edges_at_the_frontier(spark):
    edges = spark.range(20_000).selectExpr("id AS src", "-1 - id % 50 AS dst")
    start = spark.createDataFrame([(1,)], "start long")
    got = {(r["node"], r["distance"]) for r in graph.within(edges, start, 2).collect()}
    assert got == {(-2, 1)} | {(i, 2) for i in range(20_000) if i % 50 == 1 and i != 1}
    assert "Aggregate" not in graph.within(edges, start, 2)._jdf.queryExecution().optimizedPlan().toString()  # all edges are told apart nowhere
    both = graph.within(edges, spark.createDataFrame([(1,), (-2,)], "start long"), 1).groupBy("start").count().orderBy("start").collect()
    assert both == [(-2, 400), (1, 1)]
