"""Queries of whole plans, formatting and extension slots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures as X
from .. import resources as R
from ..functions import extensions, formatting
from ..functions import legal as L
from ..functions import text as T
from ..operators import evaluation
from ..plans import answering, ingestion
from .common import sql_tokens, table

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


def _pages(spark, d):
    return X.over(spark, d, "statute_pages", in_arrow=True).select(F.col("filename").alias("source"), F.col("page_id").alias("page"), "text")


@query("ingested_chunks")
def _(spark, d):
    return ingestion.chunks_of(_pages(spark, d)).select("id", "source", "page", "chunk_index", "chunk_chars", "act_name", "section_number", "section_title", "source_type", "is_bns", "is_ipc", "has_provided_that")


@query("ingestion_stats")
def _(spark, d):
    return ingestion.statistics(ingestion.chunks_of(_pages(spark, d)))


@query("ingested_twice", "SELECT 0::BIGINT AS fresh")
def _(spark, d):
    chunks = ingestion.chunks_of(_pages(spark, d))
    return ingestion.chunks_of(_pages(spark, d), chunks).agg(F.count("*").alias("fresh"))


@query("jobs_due", f"""WITH {X.over_sql('jobs')} SELECT kind, last_run IS NULL OR date_diff('day', CAST(last_run AS DATE), DATE '1998-04-15') >= every_days AS due, coalesce(CAST(last_run AS DATE) + every_days, DATE '1998-04-15') AS next_due FROM jobs""")
def _(spark, d):
    jobs = X.over(spark, d, "jobs").withColumn("last_run", F.to_date("last_run"))
    return ingestion.jobs_due(jobs, "1998-04-15").select("kind", "due", "next_due")


@query("orchestrated_answers")
def _(spark, d):
    return answering.orchestrated(X.frame(spark, "asked"), X.over(spark, d, "chunks"), X.frame(spark, "crosswalk"), X.frame(spark, "synonyms"), "2024-07-01").select("query_id", "rank", "id", "score", "entity_boost")


@query("api_page")
def _(spark, d):
    return answering.api(X.frame(spark, "asked"), X.over(spark, d, "chunks"), "2024-07-01", 1, 3)


@query("verified_answers")
def _(spark, d):
    return answering.verified_answers(X.over(spark, d, "answers"), X.over(spark, d, "evidence"))


@query("batch_results", f"WITH {X.over_sql('asked')}, {X.over_sql('evidence')} SELECT query_id, query, (SELECT count(*) FROM evidence WHERE response_id = query_id) AS n_results, CASE WHEN trim(query) = '' THEN 'empty query' END AS error FROM asked")
def _(spark, d):
    return answering.batch(X.over(spark, d, "asked"), X.over(spark, d, "evidence").withColumnRenamed("response_id", "query_id"))


@query("rendered_summary", f"""WITH {X.over_sql('evidence')} SELECT response_id AS query_id, string_agg(rank || '. ' || concat_ws(' | ', source, 'Page ' || page, 'Section ' || section, act) || chr(10) || substring(document, 1, 300), chr(10) || chr(10) ORDER BY rank) AS text FROM evidence WHERE rank <= 3 GROUP BY 1""")
def _(spark, d):
    rows = X.over(spark, d, "evidence").withColumnsRenamed({"response_id": "query_id", "section": "section_number", "act": "act_name"})
    return formatting.rendered(rows, "summary")


@query("rendered_citations", f"""WITH {X.over_sql('evidence')} SELECT response_id AS query_id, string_agg(rank || '. ' || concat_ws(' | ', source, 'Page ' || page, 'Section ' || section, act), chr(10) ORDER BY rank) AS text FROM evidence GROUP BY 1""")
def _(spark, d):
    rows = X.over(spark, d, "evidence").withColumnsRenamed({"response_id": "query_id", "section": "section_number", "act": "act_name"})
    return formatting.rendered(rows, "citations")


@query("page_elements")
def _(spark, d):
    return X.over(spark, d, "statute_pages").select("page_id", F.explode(formatting.elements("text")).alias("e")).select("page_id", "e.kind", "e.value", "e.position")


@query("hindi_sections")
def _(spark, d):
    return X.over(spark, d, "bilingual").select("id", F.explode_outer(formatting.hindi_sections("text")).alias("s")).select("id", "s.number", "s.context")


@query("devanagari", f"WITH {X.over_sql('roman')} SELECT id, replace(replace(t, 'kh', 'ख'), 'aa', 'ा') AS t FROM roman")
def _(spark, d):
    return X.over(spark, d, "roman").select("id", formatting.devanagari("t").alias("t"))


@query("human_sizes", "SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN round(n / 1024, 1) || ' KB' ELSE round(n / 1048576, 1) || ' MB' END AS size FROM (SELECT doc_id, n_chars AS n FROM documents)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", formatting.size(F.col("n_chars")).alias("size"))


@query("hashed_vectors", f"SELECT doc_id, len({sql_tokens('text')}) > 0 AS any, 1.0::DOUBLE AS length FROM documents WHERE len({sql_tokens('text')}) > 0")
def _(spark, d):
    v = table(spark, d, "documents").select("doc_id", T.tokens("text").alias("w"), extensions.hashed_vector("text").alias("v")).where(F.size("w") > 0)
    return v.select("doc_id", (F.size("w") > 0).alias("any"), F.round(F.sqrt(T.dot(F.col("v"), F.col("v"))), 5).alias("length"))


@query("embedding_resume", "SELECT doc_id, lang = 'en' AS kept FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    stored = docs.where("lang = 'en'").select("doc_id", F.array(F.lit(9.0).cast("float")).alias("embedding"))
    out = extensions.embedded(docs, stored, "doc_id", "text")
    return out.select("doc_id", (F.size("embedding") == 1).alias("kept"))


@query("intent_histogram")
def _(spark, d):
    none = F.expr("cast(map() as map<string, string>)")
    a = X.over(spark, d, "asked").select(L.analysis("query", none, none).alias("a"))
    return a.groupBy(F.col("a.intent").alias("intent"), F.startswith("a.search_strategy", F.lit("filtered")).alias("filtered")).agg(F.count("*").alias("n"))


@query("run_trend", "SELECT event_type, d, n, n - lag(n) OVER (PARTITION BY event_type ORDER BY d) AS delta FROM (SELECT event_type, date_trunc('day', ts)::DATE AS d, count(*) AS n FROM events GROUP BY ALL)")
def _(spark, d):
    by_day = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    return by_day.select("event_type", "d", "n", (F.col("n") - F.lag("n").over(Window.partitionBy("event_type").orderBy("d"))).alias("delta"))


@query("citation_recall", "SELECT a.source, len(list_intersect(a.l, b.l)) / 4.0 AS recall FROM (SELECT source, list(DISTINCT lang) AS l FROM documents GROUP BY source) a, (SELECT ['en', 'fr', 'de', 'es'] AS l) b")
def _(spark, d):
    found = table(spark, d, "documents").groupBy("source").agg(F.collect_set("lang").alias("l"))
    return found.select("source", evaluation.recall_of(F.array(*map(F.lit, ("en", "fr", "de", "es"))), F.col("l")).alias("recall"))


@query("act_names_short", f"WITH {X.over_sql('act_names')} SELECT id, name, short FROM act_names")
def _(spark, d):
    return X.over(spark, d, "act_names").select("id", "name", L.short_act(F.col("name")).alias("short"))


@query("search_hits")
def _(spark, d):
    from ..operators import answers
    from ..plans import search

    found = answers.hits(search.statutes(X.frame(spark, "asked"), X.over(spark, d, "chunks"), "2024-07-01"))
    return found.select("query_id", "rank", "id", "score", "reranker_score" if "reranker_score" in found.columns else "bm25_score", "citation.section", "snippet")


@query("related_provisions", f"WITH {X.over_sql('evidence')}, t AS (SELECT response_id, act, section FROM evidence WHERE rank = 1), r AS (SELECT DISTINCT e.response_id, 'Section ' || e.section || ' ' || e.act AS p FROM evidence e JOIN t USING (response_id) WHERE e.act = t.act AND e.section IS NOT NULL AND e.section IS DISTINCT FROM t.section) SELECT response_id AS query_id, string_agg(p, '; ' ORDER BY p) AS related FROM r GROUP BY 1")
def _(spark, d):
    from ..operators import answers

    results = X.over(spark, d, "evidence").withColumnRenamed("response_id", "query_id").withColumn("chapter", F.lit(None).cast("string"))
    return answers.related(results).withColumn("related", F.array_join("related", "; "))


@query("refusals", f"WITH {X.over_sql('asked')} SELECT query_id, true AS named, 4 AS templates FROM asked WHERE query <> ''")
def _(spark, d):
    from ..operators import answers

    asked = X.over(spark, d, "asked").where("query <> ''")
    return asked.select("query_id", F.contains(answers.refusal(F.col("query"), R.REFUSALS), F.col("query")).alias("named"), F.lit(len(R.REFUSALS)).alias("templates"))


@query("mapping_context", f"WITH {X.sql('crosswalk')}, a AS (SELECT source AS name, count(*) AS n FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) SELECT (SELECT string_agg(name, '; ' ORDER BY n DESC, name DESC) FROM a) AS acts, (SELECT string_agg('IPC ' || old_section || ' -> BNS ' || new_section || ' (' || name || ')', chr(10) ORDER BY ord) FROM crosswalk) AS mappings")
def _(spark, d):
    from ..operators import understanding

    acts = table(spark, d, "documents").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n"))
    return understanding.mapping_context(acts, X.frame(spark, "crosswalk"))


@query("audit_rows", "SELECT event_type, user_id, 'info' AS severity, event_type AS action, '{\"value\":\"' || event_id || '\"}' AS details FROM events")
def _(spark, d):
    from ..operators import analytics

    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return e.select(*analytics.audit_event(F.col("event_type"), value="event_id")).select("event_type", "user_id", "severity", "action", "details")


@query("item_cache_replay", """WITH RECURSIVE e AS MATERIALIZED (SELECT event_type, event_id, user_id % 40 AS item, epoch(ts::TIMESTAMP) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
    r(event_type, i, event_id, allowed, remaining, held) AS (SELECT DISTINCT event_type, 0::BIGINT, NULL::BIGINT, false, 0::BIGINT, []::STRUCT(until DOUBLE, name VARCHAR)[] FROM e UNION ALL
        SELECT event_type, i, event_id, hit, CASE WHEN hit THEN len(held) ELSE len(kept) + 1 END, CASE WHEN hit THEN held ELSE list_append(kept, {'until': t + 7200, 'name': item::VARCHAR}) END
        FROM (SELECT *, CASE WHEN len(live) >= 12 THEN list_sort(live)[2:] ELSE live END AS kept
            FROM (SELECT e.*, held, len(list_filter(held, lambda h: h.name = item::VARCHAR AND h.until >= t)) > 0 AS hit, list_filter(held, lambda h: h.name <> item::VARCHAR AND h.until >= t) AS live
                FROM r JOIN e ON e.event_type = r.event_type AND e.i = r.i + 1)))
    SELECT event_id, event_type, allowed, remaining FROM r WHERE i > 0""")
def _(spark, d):
    from ..streaming import limiters

    e = table(spark, d, "events").select("event_type", "event_id", (F.col("user_id") % 40).alias("item"), F.col("ts").cast("timestamp").cast("double").alias("t"))
    return limiters.replay(e, "event_type", "t", "event_id", limiters.ItemCache(7200, 12), "item").select("event_id", "event_type", "allowed", "remaining")


@query("irrelevant_composite", "SELECT doc_id, round(0.5 * (quality = 0)::INT + 0.3 * (toxic = 0)::INT + 0.2 * (doc_id % 2)::INT, 6)::DOUBLE AS score FROM labels")
def _(spark, d):
    score = evaluation.irrelevant_composite(F.col("quality") == 0, F.col("toxic") == 0, F.col("doc_id") % 2 == 1)
    return table(spark, d, "labels").select("doc_id", F.round(score, 6).alias("score"))


@query("markdown_report", "SELECT source AS key, '| ' || source || ' | ' || count(*) || ' |' AS line FROM documents GROUP BY source")
def _(spark, d):
    counts = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return evaluation.markdown(counts, "source")


@query("file_names", f"WITH {X.over_sql('files')} SELECT raw, regexp_replace(regexp_replace(regexp_replace(raw, '\\.[^.]*$', ''), '[^A-Za-z0-9]+', '_', 'g'), '^_|_$', '', 'g') || lower(regexp_extract(raw, '\\.[^.]*$')) AS name FROM files")
def _(spark, d):
    return X.over(spark, d, "files").select("raw", formatting.file_name("raw").alias("name"))


@query("plain_texts", f"WITH {X.over_sql('marked')} SELECT id, plain AS text FROM marked")
def _(spark, d):
    return X.over(spark, d, "marked").select("id", formatting.latin_letters(formatting.plain_markdown("raw")).alias("text"))
