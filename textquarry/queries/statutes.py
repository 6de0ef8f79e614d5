"""Queries of understanding, structure, verification, answers, graph, evaluation, tenancy and maintenance, over small inline tables and the synthetic ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from .. import resources as R
from ..functions import legal as L
from ..functions import text as T
from ..operators import answers, chunking, evaluation, graph, redaction, tenancy, understanding, verification
from ..plans import search
from ..sources import html, readers, writers
from .common import sql_contains_any, sql_list, sql_map, sql_words, table

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


# --- understanding


def _route_sql(low: str, text: str) -> str:
    acts = ("act", "code", "statute", "constitution", "regulation")
    tests = [
        (f"{text} = ''", "GENERAL", 0.1), (f"regexp_matches({low}, '\\b(ipc|bns|crpc|bnss)\\b') OR regexp_matches({low}, '\\bsection\\s+\\d+\\b')", "LEGAL_RESEARCH", 0.97), (sql_contains_any(low, R.ROUTE_CIVIL_WORDS), "LEGAL_RESEARCH", 0.93),
        (sql_contains_any(low, R.ROUTE_LEGAL_WORDS), "LEGAL_RESEARCH", 0.88), (sql_contains_any(low, R.ROUTE_TOPIC_WORDS), "LEGAL_RESEARCH", 0.85), (f"{sql_contains_any(low, R.ROUTE_DOCUMENT_WORDS)} AND NOT {sql_contains_any(low, acts)}", "DOCUMENT_ANALYSIS", 0.94),
        (sql_contains_any(low, R.ROUTE_STRATEGY_WORDS), "STRATEGIC_ADVICE", 0.91), (f"len({sql_words(text)}) <= 4", "GENERAL", 0.4),
    ]
    cases = lambda i: " ".join(f"WHEN {t[0]} THEN {repr(t[i])}" for t in tests)
    return f"CASE {cases(1)} ELSE 'GENERAL' END AS route, CAST(CASE {cases(2)} ELSE 0.7 END AS DOUBLE) AS confidence"


@query("rule_router_conversations", f"SELECT conv_id, turn, {_route_sql('low', 'q')} FROM (SELECT conv_id, turn, trim(coalesce(text, '')) AS q, lower(trim(coalesce(text, ''))) AS low FROM conversations WHERE role = 'user')")
def _(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", L.rule_route("text").alias("r")).select("conv_id", "turn", "r.route", "r.confidence")


@query("rule_router", f"WITH {X.over_sql('asked')} SELECT query_id, {_route_sql('low', 'q')} FROM (SELECT query_id, trim(query) AS q, lower(trim(query)) AS low FROM asked)")
def _(spark, d):
    return X.over(spark, d, "asked").select("query_id", L.rule_route("query").alias("r")).select("query_id", "r.route", "r.confidence")


@query("civil_router", f"""WITH {X.over_sql('asked')}, l AS (SELECT query_id, lower(query) AS q FROM asked) SELECT query_id, CASE WHEN {sql_contains_any('q', R.PROCEDURE_WORDS)} THEN 'CIVIL_PROCEDURE' ELSE 'CIVIL_RESEARCH' END AS route,
    CASE WHEN {sql_contains_any('q', R.PROCEDURE_WORDS)} THEN 'CPC' {' '.join("WHEN contains(q, '" + a.lower().replace("'", "''") + "') THEN '" + a.replace("'", "''") + "'" for a in R.CIVIL_ACTS)} ELSE 'GENERAL_CIVIL' END AS sub_route FROM l""")
def _(spark, d):
    return X.over(spark, d, "asked").select("query_id", L.civil_route("query").alias("r")).select("query_id", "r.route", "r.sub_route")


@query("entity_parse")
def _(spark, d):
    e = X.over(spark, d, "asked").select("query_id", L.entities("query").alias("e"))
    return e.select("query_id", *[F.array_join(f"e.{c}", ", ").alias(c) for c in ("sections", "ipc_sections", "bns_sections", "articles", "acts", "topics", "courts")], "e.confidence")


def _parsed_sql(c: str, names: dict) -> str:
    longest = "|".join(sorted(names, key=len, reverse=True))
    found = f"list_transform(regexp_extract_all(lower(coalesce({c}, '')), '({longest})', 1), lambda x: element_at({sql_map(names)}, x)[1])"
    return f"(SELECT array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ', ') FROM (SELECT {found} AS l))"


@query("entity_names", f"SELECT conv_id, turn, role, {_parsed_sql('text', R.KNOWN_TOPICS)} AS topics, {_parsed_sql('text', R.KNOWN_ACTS)} AS acts, {_parsed_sql('text', R.KNOWN_COURTS)} AS courts FROM conversations")
def _(spark, d):
    e = table(spark, d, "conversations").select("conv_id", "turn", "role", L.entities("text").alias("e"))
    return e.select("conv_id", "turn", "role", *[F.array_join(f"e.{c}", ", ").alias(c) for c in ("topics", "acts", "courts")])


@query("query_analysis")
def _(spark, d):
    forward = {"302": "101", "376": "178", "378": "303", "379": "303"}
    back = {"101": "302", "178": "376", "303": "379"}
    a = search.routed(X.over(spark, d, "asked"), understanding.crosswalk_map(forward), understanding.crosswalk_map(back))
    return a.select(
        "query_id", "analysis.intent", F.col("analysis.confidence").alias("confidence"), "analysis.source_act", "analysis.source_section", "analysis.target_section", F.array_join("analysis.act_filter", "; ").alias("acts"),
        F.array_join("analysis.rewritten_queries", "; ").alias("rewritten"), "analysis.search_strategy", "route.route",
    )


@query("crosswalk_compare", f"""WITH {X.sql('crosswalk')}, {X.over_sql('compared')}, a AS (SELECT * FROM compared)
    SELECT query_id, 'requested' AS side, 'Section ' || section || ' ' || act AS text FROM a UNION ALL SELECT query_id, 'counterpart', 'Section ' || new_section || ' BNS' FROM a JOIN crosswalk ON act = 'IPC' AND upper(old_section) = upper(section)
    UNION ALL SELECT query_id, 'counterpart', 'Section ' || min_by(old_section, ord) || ' IPC' FROM a JOIN crosswalk ON act = 'BNS' AND upper(new_section) = upper(section) GROUP BY query_id""")
def _(spark, d):
    return understanding.compare_queries(X.over(spark, d, "compared"), X.frame(spark, "crosswalk"))


@query("crosswalk_reverse", f"WITH {X.over_sql('crosswalk')} SELECT upper(new_section) AS new_section, max_by(old_section, ord) AS old_section FROM crosswalk GROUP BY 1")
def _(spark, d):
    return understanding.counterparts(X.over(spark, d, "crosswalk"))[1]


@query("normalized_queries")
def _(spark, d):
    return understanding.normalized(X.over(spark, d, "asked"), X.frame(spark, "crosswalk")).withColumn("mappings", F.array_join("mappings", "; "))


@query("crosswalk_mentions", f"""WITH {X.over_sql('asked')}, {X.sql('crosswalk')} SELECT query_id, string_agg('BNS Section ' || new_section || ' (' || name || ')', '; ' ORDER BY ord) AS mappings FROM asked JOIN crosswalk ON regexp_matches(upper(query), '\\bIPC\\s+' || old_section || '\\b') OR regexp_matches(upper(query), '\\bSECTION\\s+' || old_section || '\\b') GROUP BY query_id""")
def _(spark, d):
    asked = X.over(spark, d, "asked").where("query NOT LIKE '%theft%'")
    out = understanding.normalized(asked, X.frame(spark, "crosswalk")).where(F.size("mappings") > 0)
    return out.select("query_id", F.array_join("mappings", "; ").alias("mappings"))


@query("synonym_expansion")
def _(spark, d):
    return understanding.expanded(X.over(spark, d, "asked"), X.frame(spark, "synonyms"))


@query("synonym_terms", f"""WITH {X.over_sql('asked')}, {X.sql('synonyms')}, m AS (SELECT query_id, term, bool_or(CASE WHEN length(term) <= 3 THEN regexp_matches(lower(query), '\\b' || term || '\\b') ELSE contains(lower(query), term) END) AS fwd FROM asked CROSS JOIN synonyms GROUP BY ALL)
    SELECT query_id, count(*) AS terms FROM m WHERE fwd GROUP BY query_id""")
def _(spark, d):
    pairs = X.over(spark, d, "asked").crossJoin(X.frame(spark, "synonyms").select("term").distinct())
    alone = F.when(F.length("term") <= 3, F.rlike(F.lower("query"), F.concat(F.lit(r"\b"), "term", F.lit(r"\b")))).otherwise(F.contains(F.lower("query"), F.col("term")))
    return pairs.where(alone).groupBy("query_id").agg(F.count("*").alias("terms"))


@query("synonyms_extended", f"WITH {X.over_sql('synonyms')}, {X.over_sql('added')} SELECT term, count(*) AS phrases FROM (SELECT term FROM synonyms UNION ALL SELECT term FROM added) GROUP BY term")
def _(spark, d):
    return readers.with_synonyms(X.over(spark, d, "synonyms"), X.over(spark, d, "added")).groupBy("term").agg(F.count("*").alias("phrases"))


@query("entity_expansion")
def _(spark, d):
    q = X.over(spark, d, "asked").select("query_id", "query", L.entities("query").alias("entities"))
    return q.select("query_id", understanding.with_entities(T.text_of("query")).alias("expanded"))


@query("bilingual_queries")
def _(spark, d):
    return understanding.bilingual(X.over(spark, d, "bilingual"))


@query("script_language", f"""WITH {X.over_sql('bilingual')}, c AS (SELECT id, length(regexp_replace(coalesce(text, ''), '[^\\x{{0900}}-\\x{{097F}}]', '', 'g')) AS h, length(regexp_replace(regexp_replace(coalesce(text, ''), '[\\x{{0900}}-\\x{{097F}}]', '', 'g'), '[^\\p{{L}}]', '', 'g')) AS o FROM bilingual)
    SELECT id, CASE WHEN h > 0.5 * (h + o) THEN 'hindi' WHEN h > 0.1 * (h + o) THEN 'mixed' ELSE 'english' END AS language FROM c""")
def _(spark, d):
    return X.over(spark, d, "bilingual").select("id", T.script_language("text").alias("language"))


@query("normalized_terms")
def _(spark, d):
    return X.over(spark, d, "bilingual").select("id", understanding.normalized_term("text").alias("term"), understanding.hindi_document_type("text").alias("document_type"))


_SPOKEN = "".join(f", n{i + 1} AS (SELECT id, regexp_replace(t, '\\b{w}\\b', '{r}', 'gi') AS t FROM n{i})" for i, (w, r) in enumerate(R.VOICE_CORRECTIONS.items())) + "".join(
    f", n{i + 1} AS (SELECT id, replace(t, '{w}', '{r}') AS t FROM n{i})" for i, (w, r) in enumerate(R.VOICE_EXPANSIONS.items(), len(R.VOICE_CORRECTIONS))
)


@query("spoken_queries", f"""WITH {X.over_sql('spoken')}, n0 AS (SELECT id, trim(lower(text)) AS t FROM spoken) {_SPOKEN} SELECT id, t AS normalized FROM n{len(R.VOICE_CORRECTIONS) + len(R.VOICE_EXPANSIONS)}""")
def _(spark, d):
    s = X.over(spark, d, "spoken").withColumn("normalized", understanding.spoken_terms("text")).withColumn("c", understanding.spoken_command("normalized"))
    return s.select("id", "normalized")


@query("spoken_commands")
def _(spark, d):
    s = X.over(spark, d, "spoken").withColumn("normalized", understanding.spoken_terms("text")).withColumn("c", understanding.spoken_command("normalized"))
    return s.select("id", "c.command", "c.confidence", F.array_join(understanding.key_terms("normalized"), "; ").alias("terms"))


@query("batch_lines", f"""WITH {X.over_sql('batches')}, l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM batches)
    SELECT trim(regexp_replace(trim(line), '^["'']|["'']$', '', 'g')) AS query FROM l WHERE trim(regexp_replace(trim(line), '^["'']|["'']$', '', 'g')) <> '' AND NOT starts_with(trim(line), '#')""")
def _(spark, d):
    return readers.batch_lines(X.over(spark, d, "batches"))


# --- structure and chunks of statutes


@query("section_chunks")
def _(spark, d):
    return chunking.section_chunks(_parsed_pages(spark, d), "page_id", "text", "act", "chapter")


def _parsed_pages(spark, d):
    p = X.over(spark, d, "statute_pages").withColumn("structure", L.structure("text", "filename"))
    return p.select("page_id", "filename", "text", "structure", "structure.act", "structure.chapter")


@query("page_structure")
def _(spark, d):
    return _parsed_pages(spark, d).select("page_id", "structure.*", *L.enriched())


@query("act_titles")
def _(spark, d):
    return X.over(spark, d, "statute_pages").select("page_id", L.act_of_title("text", "filename").alias("title"))


@query("chunk_backfill", f"""WITH {X.over_sql('chunks')} SELECT id, coalesce(nullif(regexp_extract(document, '(?i)Section\\s+(\\d{{1,4}}[A-Z]?)\\s*[:\\-–]', 1), ''), nullif(regexp_extract(document, '(?i)Section\\s+(\\d{{1,4}}[A-Z]?)\\.?\\s', 1), ''), nullif(regexp_extract(document, '(?:^|\\n)\\s*(\\d{{1,4}}[A-Z]?)\\.\\s+[^a-z\\d]', 1), ''), '') AS section,
    CASE WHEN structure_type IN ('bare_act', 'bare_act_text') THEN 'bare_act' WHEN structure_type IN ('commentary', 'textbook', 'legal_commentary') THEN 'commentary' WHEN {sql_contains_any('lower(source)', [w.lower() for w in R.COMMENTARY_WORDS])} THEN 'commentary'
    WHEN {sql_contains_any('upper(substring(document, 1, 200))', ['AN ACT TO', 'BE IT ENACTED', 'SHORT TITLE', 'CHAPTER I', 'PART I', 'PRELIMINARY'])} OR regexp_matches(document, '(?:^|\\n)\\s*\\d+\\.\\s+[A-Z]') THEN 'bare_act' ELSE 'commentary' END AS kind FROM chunks""")
def _(spark, d):
    return X.over(spark, d, "chunks").select("id", L.section_of_chunk("document").alias("section"), L.source_type("source", "structure_type", "document").alias("kind"))


@query("source_type_distribution", f"WITH {X.over_sql('chunks')} SELECT coalesce(source_type, 'none') AS kind, count(*) AS n, round(avg(CASE WHEN section_number IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS with_section FROM chunks GROUP BY 1")
def _(spark, d):
    return X.over(spark, d, "chunks").groupBy(F.coalesce("source_type", F.lit("none")).alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("section_number").isNotNull().cast("int")), 6).alias("with_section"))


@query("decision_dates", f"WITH {X.over_sql('chunks')} SELECT id, coalesce(try_strptime(decision_date, '%Y-%m-%d'), try_strptime(decision_date, '%d-%m-%Y'), try_strptime(decision_date, '%Y/%m/%d'), try_strptime(decision_date, '%d/%m/%Y'))::DATE AS decided FROM chunks")
def _(spark, d):
    return X.over(spark, d, "chunks").select("id", T.parse_date("decision_date").alias("decided"))


@query("court_inference", """SELECT page_id, CASE WHEN contains(lower(url), 'supreme court') THEN 'supreme_court' ELSE 'unknown' END AS court FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", L.court_of_text("url", "url").alias("court"))


@query("civil_acts", f"WITH {X.over_sql('civil')} SELECT * FROM civil")
def _(spark, d):
    return X.over(spark, d, "civil")


# --- verification and answers

_CLAIMS_SQL = f"""{X.over_sql('answers')}, lo AS (SELECT response_id, lower(response) AS r FROM answers), cl AS (
    SELECT response_id, 'section_reference' AS type, 'Section ' || x.s || ' ' || upper(x.a) AS value FROM (SELECT response_id, unnest(list_zip(regexp_extract_all(r, 'section\\s+(\\d+[a-z]?)\\s+(ipc|bns|crpc|bnss|bsa)', 1), regexp_extract_all(r, 'section\\s+(\\d+[a-z]?)\\s+(ipc|bns|crpc|bnss|bsa)', 2))) AS z FROM lo), LATERAL (SELECT z[1] AS s, z[2] AS a) x
    UNION ALL SELECT response_id, 'punishment', unnest(regexp_extract_all(r, 'punishment\\s+(?:is|shall be|may be)\\s+[^.]+')) FROM lo
    UNION ALL SELECT response_id, 'imprisonment_duration', unnest(regexp_extract_all(r, 'imprisonment\\s+(?:for\\s+)?(?:up to\\s+)?(\\d+)\\s+years?', 1)) || ' years' FROM lo
    UNION ALL SELECT response_id, 'fine_amount', unnest(regexp_extract_all(r, 'fine\\s+(?:of\\s+|up to\\s+)?([\\d,]+(?:\\s+rupees)?)', 1)) FROM lo
    UNION ALL SELECT response_id, 'offence_definition', unnest(regexp_extract_all(r, 'whoever\\s+[^.]+?\\s+shall\\s+be\\s+punished')) FROM lo)"""
_VERIFIED_SQL = f"""{_CLAIMS_SQL}, {X.over_sql('evidence')}, vf AS (SELECT c.response_id, c.type, c.value, coalesce(bool_or(CASE c.type WHEN 'section_reference' THEN contains(lower(document), lower(value)) WHEN 'imprisonment_duration' THEN contains(lower(document), split_part(value, ' ', 1))
    WHEN 'punishment' THEN len(list_filter(list_slice(regexp_split_to_array(value, '\\s+'), 1, 3), lambda w: contains(lower(document), w))) > 0 WHEN 'fine_amount' THEN contains(replace(lower(document), ',', ''), replace(value, ',', '')) ELSE false END), false) AS verified FROM cl c LEFT JOIN evidence e USING (response_id) GROUP BY ALL)"""


@query("claims_extract", f"WITH {_CLAIMS_SQL} SELECT response_id, type, value FROM cl")
def _(spark, d):
    return verification.claims(X.over(spark, d, "answers")).drop("ord")


@query("claims_verified", f"WITH {_VERIFIED_SQL} SELECT * FROM vf")
def _(spark, d):
    return _verified(spark, d).select("response_id", "type", "value", "verified")


def _verified(spark, d):
    return verification.verified(verification.claims(X.over(spark, d, "answers")), X.over(spark, d, "evidence"))


@query("claim_coverage", f"WITH {_VERIFIED_SQL} SELECT a.response_id, count(v.type) AS total_claims, count(*) FILTER (v.verified) AS claims_verified, round(CASE WHEN count(v.type) > 0 THEN count(*) FILTER (v.verified) / count(v.type) ELSE 1 END, 3) AS citation_coverage, count(*) FILTER (v.verified) < count(v.type) AS needs_correction FROM answers a LEFT JOIN vf v USING (response_id) GROUP BY 1")
def _(spark, d):
    return verification.coverage(X.over(spark, d, "answers"), _verified(spark, d))


@query("fabricated_findings")
def _(spark, d):
    return verification.fabricated(X.over(spark, d, "answers"))


@query("outdated_law", f"""WITH {X.over_sql('answers')}, l AS (SELECT response_id, lower(response) AS r FROM answers)
    SELECT response_id, 'ipc_treated_as_current' AS type, 'ipc' AS value FROM l WHERE regexp_matches(r, '\\bipc\\b') AND regexp_matches(r, '\\bbns\\b') AND regexp_matches(r, 'ipc\\s+(?:provides|states|specifies|says|defines)|under\\s+ipc\\s+section|as\\s+per\\s+ipc')
    UNION ALL SELECT response_id, 'invalid_ipc_section', v FROM (SELECT response_id, unnest(regexp_extract_all(r, 'section\\s+(\\d+)\\s+ipc', 1)) AS v FROM l) WHERE v::INT > 511
    UNION ALL SELECT response_id, 'invalid_bns_section', v FROM (SELECT response_id, unnest(regexp_extract_all(r, 'section\\s+(\\d+)\\s+bns', 1)) AS v FROM l) WHERE v::INT > 395""")
def _(spark, d):
    return verification.outdated(X.over(spark, d, "answers"))


@query("hallucination_report")
def _(spark, d):
    a = X.over(spark, d, "answers")
    return verification.risk(verification.coverage(a, _verified(spark, d)), verification.fabricated(a).unionByName(verification.outdated(a)))


@query("evidence_payload")
def _(spark, d):
    return answers.payload(X.over(spark, d, "evidence")).drop("document")


@query("evidence_table")
def _(spark, d):
    return answers.comparison(answers.payload(X.over(spark, d, "evidence")))


@query("cited_acts_filter", f"""WITH {X.over_sql('evidence')} SELECT id, act FROM evidence WHERE upper(act) IN (SELECT upper(act) FROM evidence WHERE similarity >= 0.7)""")
def _(spark, d):
    e = X.over(spark, d, "evidence")
    return writers.cited_acts(e.select("id", "act"), e)


@query("source_context", f"""WITH {X.over_sql('evidence')} SELECT response_id, string_agg('[Source ' || rank || ': ' || concat_ws(', ', act, 'Section ' || section, 'Page ' || page) || ']' || chr(10) || substring(document, 1, 1500), chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM evidence GROUP BY response_id""")
def _(spark, d):
    return answers.context(X.over(spark, d, "evidence"))


@query("text_report")
def _(spark, d):
    return answers.report(answers.payload(X.over(spark, d, "evidence")), X.over(spark, d, "answers").select("response_id", F.col("response").alias("query")))


@query("formatted_results")
def _(spark, d):
    return answers.formatted(search.statutes(X.frame(spark, "asked"), X.over(spark, d, "chunks"), "2024-07-01"))


@query("search_events", f"""WITH {X.over_sql('evidence')}, e AS (SELECT response_id AS query_id, list(id ORDER BY rank) AS ids FROM evidence GROUP BY 1), s AS (SELECT query_id, list_concat(list_concat(['LEGAL_RESEARCH', len(ids) || ' results'], ids), ['']) AS p FROM e)
    SELECT query_id, (generate_subscripts(p, 1) - 1)::INT AS seq, unnest(p) AS payload FROM s""")
def _(spark, d):
    from ..streaming import pipelines

    hits = X.over(spark, d, "evidence").select(F.col("response_id").alias("query_id"), F.lit("LEGAL_RESEARCH").alias("route"), "rank", "id")
    return pipelines.emitted(hits).select("query_id", "seq", "payload")


# --- graph

_EDGES = "e AS (SELECT DISTINCT l_partkey AS p, -l_suppkey AS s FROM lineitem), b AS (SELECT p AS a, s AS b FROM e UNION SELECT s, p FROM e)"


def _edges(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey")).alias("dst"))


@query("bfs_2hop", f"WITH {_EDGES}, h1 AS (SELECT a AS start, b AS node FROM b WHERE a IN (1, 2, 3)), h2 AS (SELECT DISTINCT h1.start, b.b AS node FROM h1 JOIN b ON b.a = h1.node WHERE b.b <> h1.start) SELECT start, node, min(distance) AS distance FROM (SELECT start, node, 1 AS distance FROM h1 UNION ALL SELECT start, node, 2 FROM h2) GROUP BY ALL")
def _(spark, d):
    return graph.within(_edges(spark, d), spark.createDataFrame([(1,), (2,), (3,)], "start long"), 2)


@query("degree_stats", f"WITH {_EDGES} SELECT node, count(*) FILTER (o) AS out_degree, count(*) FILTER (NOT o) AS in_degree FROM (SELECT p AS node, true AS o FROM e UNION ALL SELECT s, false FROM e) GROUP BY node")
def _(spark, d):
    return graph.degrees(_edges(spark, d))


_RULED = f"""{X.over_sql('cases')}, {X.over_sql('cites')}, {X.over_sql('rulings')}, ru AS (SELECT c.*, coalesce(bool_or(r.kind = 'overruled'), false) AS gone, count(DISTINCT CASE WHEN r.kind = 'followed' THEN r.ruled_by END) AS followed FROM cases c LEFT JOIN rulings r USING (case_id) GROUP BY ALL),
    st AS (SELECT case_id, CASE WHEN gone THEN 'overruled' ELSE status END AS status, round(CASE WHEN gone THEN 0.1 ELSE least(least(bench_size / 5.0::DOUBLE, 1) * 0.3::DOUBLE + CASE WHEN court = 'supreme_court' THEN 0.5 ELSE 0.2 END::DOUBLE + 0.2::DOUBLE, 1) END, 6)::DOUBLE AS strength, followed FROM ru)"""


def _ruled(spark, d):
    return graph.ruled(X.over(spark, d, "cases"), X.over(spark, d, "rulings"))


@query("precedent_status", f"WITH {_RULED} SELECT * FROM st")
def _(spark, d):
    return _ruled(spark, d).select("case_id", "status", "strength", F.size("followed_in").cast("long").alias("followed"))


@query("precedent_statistics", f"WITH {_RULED} SELECT count(*) AS total_cases, count(*) FILTER (status = 'overruled') AS overruled_cases, count(*) FILTER (followed > 0) AS followed_cases, round(avg(strength), 2) AS average_strength, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM cites) WHERE src IN (SELECT case_id FROM cases)) AS total_citations FROM st")
def _(spark, d):
    return graph.statistics(_ruled(spark, d), X.over(spark, d, "cites"))


@query("precedent_chain", f"WITH {X.over_sql('cites')}, {X.over_sql('cases')} SELECT dst AS neighbour, 'cites' AS relation FROM (SELECT DISTINCT src, dst FROM cites) WHERE src = 'c-1' AND dst IN (SELECT case_id FROM cases) UNION ALL SELECT src, 'cited_by' FROM (SELECT DISTINCT src, dst FROM cites) WHERE dst = 'c-1' AND src IN (SELECT case_id FROM cases)")
def _(spark, d):
    return graph.chain(X.over(spark, d, "cases"), X.over(spark, d, "cites"), "c-1").select("neighbour", "relation")


@query("related_precedents", f"""WITH RECURSIVE {X.over_sql('cites')}, b AS (SELECT src AS a, dst AS b FROM cites UNION SELECT dst, src FROM cites), w AS (SELECT 'c-1' AS node, 0 AS d UNION SELECT b.b, w.d + 1 FROM w JOIN b ON b.a = w.node WHERE w.d < 2) SELECT node, min(d) AS distance FROM w GROUP BY node HAVING min(d) > 0""")
def _(spark, d):
    return graph.within(X.over(spark, d, "cites"), spark.createDataFrame([("c-1",)], "start string"), 2).select("node", "distance")


@query("citation_search", f"WITH {X.over_sql('cases')} SELECT case_id FROM cases WHERE contains(lower(citation), 'air') ORDER BY case_id LIMIT 1")
def _(spark, d):
    return graph.by_citation(X.over(spark, d, "cases"), "air").select("case_id")


@query("keyword_precedents", f"WITH {_RULED} SELECT case_id, strength FROM st JOIN cases USING (case_id) WHERE contains(lower(case_name), 'fair') OR contains(lower(coalesce(ratio, '')), 'fair')")
def _(spark, d):
    return graph.by_keyword(_ruled(spark, d), "fair").select("case_id", "strength")


@query("citation_labels", f"""WITH {_RULED} SELECT case_id, concat_ws(' ', CASE st.status WHEN 'active' THEN '✓' WHEN 'overruled' THEN '✗' ELSE '?' END, citation, CASE WHEN followed > 0 THEN '(followed in ' || followed || ' cases)' END, CASE WHEN st.status = 'overruled' THEN '(overruled)' END) AS label FROM st JOIN cases USING (case_id)""")
def _(spark, d):
    return graph.with_status_mark(_ruled(spark, d))


@query("parsed_citations", f"WITH {X.over_sql('cases')} SELECT case_id, nullif(regexp_extract(citation, '^(AIR|SCC)\\s+(\\d{{4}})', 1), '') AS kind, try_cast(nullif(regexp_extract(citation, '^(AIR|SCC)\\s+(\\d{{4}})', 2), '') AS INT) AS year FROM cases")
def _(spark, d):
    return X.over(spark, d, "cases").select("case_id", L.reported_citation("citation").alias("c")).select("case_id", F.col("c.type").alias("kind"), "c.year")


# --- evaluation

_STOP = sql_list(R.KEYWORD_STOP_WORDS)


@query("retrieval_scores", f"""WITH {X.over_sql('scored')}, t AS (SELECT *, lower(array_to_string(chunks, ' ')) AS txt FROM scored), m AS (SELECT *, coalesce(list_sum(list_transform(kw, lambda k: CASE WHEN contains(txt, lower(k)) THEN 1.0 WHEN len(list_filter(string_split(lower(k), ' '), lambda w: NOT contains(txt, w))) = 0 THEN 0.5 ELSE 0 END)), 0) AS found,
    len(list_filter(chunks, lambda c: contains(lower(c), 'section') OR contains(lower(c), 'act') OR contains(lower(c), 'court') OR contains(lower(c), 'punishment'))) AS legal FROM t)
    SELECT id, category, CASE WHEN category = 'irrelevant' THEN CASE WHEN legal = 0 THEN 100 WHEN legal <= 2 THEN 70 ELSE 30 END ELSE least(100, floor(found / greatest(len(kw), 1) * 100))::INT END AS score FROM m""")
def _(spark, d):
    return X.over(spark, d, "scored").select("id", "category", evaluation.retrieval_score(F.col("chunks"), F.col("kw"), F.col("category")).alias("score"))


@query("rollup_eval", "SELECT CASE WHEN grouping(source) = 1 THEN 'overall' ELSE source END AS category, round(avg(quality), 6) AS mean, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (source)")
def _(spark, d):
    labelled = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return evaluation.by_category(labelled, "source", "quality")


@query("run_comparison", f"""WITH {X.over_sql('runs')} SELECT a.metric, a.value AS base, b.value AS new, round(b.value - a.value, 6) AS delta, round((b.value - a.value) / a.value * 100, 2) AS percent, CASE WHEN (b.value > a.value) = a.higher_is_better THEN 'improved' ELSE 'regressed' END AS verdict
    FROM runs a JOIN runs b ON a.metric = b.metric AND a.run = 'base' AND b.run = 'new'""")
def _(spark, d):
    return evaluation.compared(X.over(spark, d, "runs"), "base", "new")


@query("context_metrics", f"""WITH u AS (SELECT conv_id, list_sort(list(text)) AS c FROM conversations WHERE role = 'user' GROUP BY 1), a AS (SELECT conv_id, min(text) AS answer, max(text) AS truth FROM conversations WHERE role = 'assistant' GROUP BY 1),
    p AS (SELECT conv_id, list_transform(c, lambda x: lower(x)) AS c, lower(array_to_string(c, ' ')) AS whole, list_transform(list_filter(list_transform(regexp_split_to_array(regexp_replace(truth, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 5), lambda x: lower(x)) AS s,
        list_distinct(list_filter(regexp_extract_all(lower(truth), '[a-zA-Z]+'), lambda x: length(x) > 2 AND NOT list_contains({_STOP}, x))) AS wanted, list_distinct(list_filter(regexp_extract_all(lower(answer), '[a-zA-Z]+'), lambda x: length(x) > 2 AND NOT list_contains({_STOP}, x))) AS said FROM u JOIN a USING (conv_id)),
    q AS (SELECT *, list_filter(s, lambda x: length(x) > 10) AS long FROM p)
    SELECT conv_id, round(len(list_filter(c, lambda x: len(list_filter(long, lambda y: contains(x, y))) > 0)) / len(c), 6) AS context_precision, round(coalesce(len(list_filter(long, lambda y: contains(whole, y))) / nullif(len(s), 0), 0), 6) AS context_recall,
        round(coalesce(len(list_intersect(wanted, said)) / nullif(len(wanted), 0), 0), 6) AS answer_relevance, round(coalesce(len(list_filter(said, lambda w: contains(whole, w))) / nullif(len(said), 0), 0), 6) AS faithfulness FROM q""")
def _(spark, d):
    c = table(spark, d, "conversations")
    users = c.where("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list("text")).alias("contexts"))
    said = c.where("role = 'assistant'").groupBy("conv_id").agg(F.min("text").alias("answer"), F.max("text").alias("ground_truth"))
    out = evaluation.context_metrics(users.join(said, "conv_id"))
    return out.select("conv_id", *[F.round(m, 6).alias(m) for m in ("context_precision", "context_recall", "answer_relevance", "faithfulness")])


@query("keyword_overlap", f"""WITH k AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-zA-Z]+'), lambda x: length(x) > 2 AND NOT list_contains([{', '.join("'" + w + "'" for w in R.KEYWORD_STOP_WORDS)}], x))) AS w FROM benchmark)
    SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.w, b.w))::INT AS shared, round(len(list_intersect(a.w, b.w)) / len(a.w), 6) AS share FROM k a JOIN k b ON b.item_id = a.item_id + 1""")
def _(spark, d):
    k = table(spark, d, "benchmark").select("item_id", F.array_distinct(T.keywords("text")).alias("w"))
    pairs = k.select(F.col("item_id").alias("a"), F.col("w").alias("wa")).join(k.select((F.col("item_id") - 1).alias("a"), F.col("item_id").alias("b"), F.col("w").alias("wb")), "a")
    shared = F.size(F.array_intersect("wa", "wb"))
    return pairs.select("a", "b", shared.alias("shared"), F.round(shared / F.size("wa"), 6).alias("share"))


@query("label_quality_by_source", "SELECT source, count(*) AS n, round(avg(quality), 6) AS quality, sum(toxic)::BIGINT AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY source")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.sum("toxic").alias("toxic"))


@query("best_setting", "SELECT label, count(*) AS n FROM embeddings GROUP BY label ORDER BY n DESC, label LIMIT 1")
def _(spark, d):
    return evaluation.best_setting(table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n")), "n")


# --- redaction and tenancy


@query("redacted_lines", "WITH " + X.over_sql("log_lines") + ", r0 AS (SELECT line_id, message AS m FROM log_lines) " + "".join(f", r{i + 1} AS (SELECT line_id, regexp_replace(m, '{p}', '{to.replace('$1', chr(92) + '1')}', 'gi') AS m FROM r{i})" for i, (p, to) in enumerate(R.REDACTIONS)) + f" SELECT line_id, m AS redacted FROM r{len(R.REDACTIONS)}")
def _(spark, d):
    return X.over(spark, d, "log_lines").select("line_id", redaction.redacted("message").alias("redacted"))


@query("masked_users", f"WITH {X.over_sql('users')} SELECT user_id, CASE WHEN contains(email, '@') THEN substring(split_part(email, '@', 1), 1, 2) || '***@' || split_part(email, '@', 2) ELSE email END AS email, regexp_matches(trim(username), '^[a-zA-Z0-9_]+$') AS name_ok FROM users")
def _(spark, d):
    return X.over(spark, d, "users").select("user_id", redaction.masked_email(F.col("email")).alias("email"), redaction.checked("username", "username")["error"].isNull().alias("name_ok"))


@query("checked_inputs")
def _(spark, d):
    u = X.over(spark, d, "users").withColumn("e", redaction.checked("email", "email")).withColumn("f", redaction.checked(F.concat("username", F.lit("/../x.sh")), "filename"))
    return u.select("user_id", F.col("e.value").alias("email"), F.col("e.error").alias("email_error"), F.col("f.error").alias("file_error"), redaction.sanitized(F.concat(F.lit("javascript:<b>"), "username")).alias("safe"))


@query("permissions", f"""WITH {X.over_sql('users')}, {X.sql('permissions')}, r AS (SELECT row_number() OVER (ORDER BY u.user_id, p) AS request_id, u.user_id, p AS permission, u.user_id = 'u3' AS by_key FROM (SELECT user_id FROM users UNION SELECT 'u9') u, (VALUES ('search'), ('ingest')) v(p))
    SELECT r.user_id, r.permission, CASE WHEN by_key THEN r.permission = 'search' ELSE coalesce(u.active, false) AND EXISTS (SELECT 1 FROM permissions q WHERE q.role = u.role AND q.permission = r.permission) END AS allowed FROM r LEFT JOIN users u ON u.user_id = r.user_id""")
def _(spark, d):
    users = X.over(spark, d, "users")
    ids = users.select("user_id").unionByName(spark.createDataFrame([("u9",)], "user_id string")).distinct()
    requests = ids.crossJoin(spark.createDataFrame([("search",), ("ingest",)], "permission string")).withColumns({"request_id": F.lit(0), "by_key": F.col("user_id") == "u3"})
    return tenancy.permitted(requests, users, X.frame(spark, "permissions")).select("user_id", "permission", "allowed")


@query("workspace_membership", f"WITH {X.over_sql('members')} SELECT DISTINCT workspace_id FROM members WHERE user_id = 'u2' AND active")
def _(spark, d):
    return tenancy.workspaces_of(X.over(spark, d, "members"), "u2")


@query("workspace_counters", "SELECT user_id % 5 AS workspace_id, count(*) FILTER (event_type = 'view') AS searches, count(*) FILTER (event_type = 'purchase') AS documents, count(*) FILTER (event_type = 'click') AS exports, max(event_id) AS last_activity FROM events GROUP BY 1")
def _(spark, d):
    names = L.mapping({"view": "search", "purchase": "document", "click": "export"})
    actions = table(spark, d, "events").select((F.col("user_id") % 5).alias("workspace_id"), F.try_element_at(names, F.col("event_type")).alias("action"), F.col("event_id").alias("ts"))
    return tenancy.workspace_counters(actions)


# --- amendments and maintenance


@query("gazette_entries", """SELECT p.page_id::INT AS page_id, v.* EXCLUDE (n) FROM pages p JOIN (VALUES (0, 'Arms Act, 1959', 'Notice 1', DATE '2024-03-05', 'New rules more', 'https://gazette.example/n/1'), (1, 'Forest Act, 1927', 'Notice 2', DATE '2024-04-09', 'Second rule', 'https://gazette.example')) v(n, act_name, title, notified, description, url) ON p.page_id % 2 = n""")
def _(spark, d):
    return html.gazette_entries(X.over(spark, d, "gazette"), "https://gazette.example", "2020-01-01")


@query("amendment_alerts", f"WITH {X.sql('rules')} SELECT act_name, alert_type FROM rules JOIN pages ON act_name = CASE page_id % 2 WHEN 0 THEN 'Arms Act, 1959' ELSE 'Forest Act, 1927' END")
def _(spark, d):
    from ..streaming import pipelines

    found = html.gazette_entries(X.over(spark, d, "gazette"), "https://gazette.example", "2020-01-01")
    return pipelines.alerts(found, X.frame(spark, "rules")).select("act_name", "alert_type")


@query("file_checks", f"WITH {X.over_sql('sources')} SELECT file, CASE WHEN length < 100 THEN 'too small' WHEN head <> '%PDF' THEN 'no PDF header' END AS problem FROM sources")
def _(spark, d):
    return X.over(spark, d, "sources").select("file", readers.pdf_problem(F.col("length"), F.col("head")).alias("problem"))


@query("upsert_by_key", "WITH n AS (SELECT doc_id, source || '+' AS source, n_chars + 1 AS age FROM documents WHERE lang <> 'en' UNION ALL SELECT doc_id + 1000000, source, n_chars FROM documents WHERE lang = 'de'), b AS (SELECT doc_id, source, n_chars AS age FROM documents UNION ALL SELECT * FROM n) SELECT doc_id, source, age FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY age DESC) = 1")
def _(spark, d):
    read = table(spark, d, "documents").select("doc_id", "lang", "source", F.col("n_chars").alias("age"))
    docs = read.drop("lang")
    changed = read.where("lang <> 'en'").select("doc_id", F.concat("source", F.lit("+")).alias("source"), (F.col("age") + 1).alias("age"))
    return writers.upserted(docs, changed.unionByName(read.where("lang = 'de'").drop("lang").withColumn("doc_id", F.col("doc_id") + 1000000)), "doc_id", "age")


@query("delete_by_predicate", "SELECT doc_id, source FROM documents WHERE source <> 'src1'")
def _(spark, d):
    return writers.deleted(table(spark, d, "documents").select("doc_id", "source"), F.col("source") == "src1")


@query("semi_anti_new_docs", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def _(spark, d):
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    building = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return orders.join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").join(building, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("new_chunks", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY substring(sha256(trim(text)), 1, 16) ORDER BY doc_id) AS n, substring(sha256(trim(text)), 1, 16) AS h FROM documents WHERE source >= 'src5') WHERE n = 1 AND h NOT IN (SELECT substring(sha256(trim(text)), 1, 16) FROM documents WHERE source < 'src5')")
def _(spark, d):
    hashed = table(spark, d, "documents").select("doc_id", "source", T.content_hash("text").alias("content_hash"))
    fresh = writers.new_rows(hashed.where("source >= 'src5'"), hashed.where("source < 'src5'"), "content_hash")
    first = hashed.where("source >= 'src5'").groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
    return fresh.select("content_hash").join(first, "content_hash").select("doc_id")


@query("percent_of_total", "SELECT n_name, round(sum(o_totalprice), 2) AS total, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER () * 100, 4) AS percent FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def _(spark, d):
    by_nation = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum("o_totalprice").alias("t"))
    whole = by_nation.agg(F.sum("t").alias("w"))
    return by_nation.crossJoin(F.broadcast(whole)).select("n_name", F.round("t", 2).alias("total"), F.round(F.col("t") / F.col("w") * 100, 4).alias("percent"))


@query("act_priority_order", f"""WITH {X.over_sql('evidence')} SELECT response_id AS query_id, id, row_number() OVER (PARTITION BY response_id ORDER BY CASE act WHEN 'BNS' THEN 1 WHEN 'IPC' THEN 2 ELSE 3 END, rank)::INT AS position FROM evidence""")
def _(spark, d):
    hits = X.over(spark, d, "evidence").withColumnRenamed("response_id", "query_id")
    return answers.top_of_act(hits, {"BNS": 1, "IPC": 2}).select("query_id", "id", "position")


@query("merged_results", f"""WITH {X.over_sql('evidence')}, u AS (SELECT response_id AS query_id, id, rank, 0 AS s FROM evidence WHERE rank <= 2 UNION ALL SELECT response_id, id, rank, 1 FROM evidence), o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY s, rank) = 1)
    SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s, rank)::INT AS position FROM o QUALIFY position <= 3""")
def _(spark, d):
    hits = X.over(spark, d, "evidence").select(F.col("response_id").alias("query_id"), "id", "rank")
    return understanding.merged_results(hits.where("rank <= 2"), hits, 3).select("query_id", "id", "position")
