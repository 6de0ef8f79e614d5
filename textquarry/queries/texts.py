"""Queries of text functions over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import resources as R
from ..functions import text as T
from ..operators import index
from .common import BLANKS, sql_collapse, sql_contains_any, sql_list, sql_tokens, sql_words, table

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


@query("tokenize_stats", f"""SELECT doc_id, len({sql_tokens('text')})::INT AS n_tokens, len(list_distinct({sql_tokens('text')}))::INT AS n_terms, len({sql_words('text')})::INT AS n_words FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.tokens("text")).alias("n_tokens"), F.size(F.array_distinct(T.tokens("text"))).alias("n_terms"), F.size(T.words("text")).alias("n_words"))


@query("corpus_stats", f"SELECT count(*) AS n, round(avg(len({sql_tokens('text')})), 6) AS avgdl FROM documents")
def _(spark, d):
    return index.corpus_stats(table(spark, d, "documents")).select("n", F.round("avgdl", 6).alias("avgdl"))


@query("postings", f"WITH t AS MATERIALIZED (SELECT doc_id, {sql_tokens('text')} AS w FROM documents), x AS (SELECT doc_id, len(w)::INT AS dl, unnest(w) AS term FROM t) SELECT doc_id, term, count(*)::INT AS tf, max(dl) AS dl FROM x GROUP BY doc_id, term")
def _(spark, d):
    return index.postings(table(spark, d, "documents"))


@query("term_df", f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS term FROM documents) GROUP BY term")
def _(spark, d):
    return index.term_df(index.postings(table(spark, d, "documents")))


@query("concept_terms", f"""SELECT conv_id, turn, role, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ' ') AS terms
    FROM (SELECT conv_id, turn, role, list_filter({sql_tokens('text')}, lambda x: length(x) >= 4 AND NOT list_contains({sql_list(R.CONCEPT_STOP_WORDS)}, x)) AS t FROM conversations)""")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.array_join(T.concept_terms("text"), " ").alias("terms"))


@query("snippet_280", f"""SELECT doc_id, CASE WHEN length(c) <= 280 THEN c ELSE rtrim(substring(c, 1, 277)) || '...' END AS snippet FROM (SELECT doc_id, {sql_collapse('text')} AS c FROM documents)""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.snippet("text").alias("snippet"))


@query("text_hashes", f"""SELECT doc_id, substring(sha256(trim(coalesce(text, ''))), 1, 16) AS content_hash, substring(sha256(lower(trim(coalesce(text, '')))), 1, 32) AS cache_key, md5(source || '_' || doc_id) AS page_hash,
    md5(substring(lower({sql_collapse('text')}), 1, 300)) AS prefix_hash FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", T.content_hash("text").alias("content_hash"), T.cache_key("text").alias("cache_key"), T.page_hash(F.col("source"), F.col("doc_id")).alias("page_hash"), F.md5(T.normalized_prefix("text")).alias("prefix_hash")
    )


@query("keyword_counts", f"""SELECT doc_id, len(k)::INT AS n_keywords, len(list_distinct(k))::INT AS n_distinct FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z]+'), lambda x: length(x) > 2 AND NOT list_contains({sql_list(R.KEYWORD_STOP_WORDS)}, x)) AS k FROM documents)""")
def _(spark, d):
    k = T.keywords("text")
    return table(spark, d, "documents").select("doc_id", F.size(k).alias("n_keywords"), F.size(F.array_distinct(k)).alias("n_distinct"))


@query("sentence_counts", f"""SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?]){BLANKS}', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 5))::INT AS n_sentences FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.sentences("text")).alias("n_sentences"))


@query("script_share", r"""SELECT doc_id, round(length(regexp_replace(text, '[^\x{00C0}-\x{024F}]', '', 'g')) / greatest(length(text), 1), 6) AS accented,
    CASE WHEN length(regexp_replace(text, '[^\x{0900}-\x{097F}]', '', 'g')) > 0 THEN 'hindi' ELSE 'english' END AS script FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(F.length(F.regexp_replace("text", "[^\\u00C0-\\u024F]", "")) / F.greatest(F.length("text"), F.lit(1)), 6).alias("accented"), T.script_language("text").alias("script"))


@query("content_hash_dedup", "SELECT min(doc_id) AS doc_id, substring(sha256(trim(coalesce(text, ''))), 1, 16) AS content_hash, count(*) AS copies FROM documents GROUP BY 2")
def _(spark, d):
    return table(spark, d, "documents").groupBy(T.content_hash("text").alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("quality_gate", "SELECT doc_id, length(trim(coalesce(text, '')))::INT AS chars FROM documents WHERE length(trim(coalesce(text, ''))) >= 50")
def _(spark, d):
    chars = F.length(F.trim(T.text_of("text")))
    return table(spark, d, "documents").where(chars >= 50).select("doc_id", chars.alias("chars"))


@query("text_quality_class", "SELECT doc_id, CASE WHEN length(trim(text)) > 200 AND contains(lower(text), 'tion') THEN 'GOOD' WHEN length(trim(text)) > 50 THEN 'PARTIAL' ELSE 'BAD' END AS quality FROM documents")
def _(spark, d):
    from ..sources import readers

    return table(spark, d, "documents").select("doc_id", readers.text_quality("text", "tion").alias("quality"))


@query("keyword_any_filter", f"SELECT conv_id, turn FROM conversations WHERE {sql_contains_any('lower(text)', ['the ', 'che', 'que '])}")
def _(spark, d):
    return table(spark, d, "conversations").where(T.contains_any(F.lower("text"), ["the ", "che", "que "])).select("conv_id", "turn")


@query("metadata_coercion", "SELECT doc_id, concat_ws(', ', lang, source) AS joined, CASE WHEN n_chars > 1000 THEN NULL ELSE n_chars::VARCHAR END AS kept FROM documents")
def _(spark, d):
    from ..sources import writers

    docs = table(spark, d, "documents").select("doc_id", F.map_from_arrays(F.array(F.lit("kept")), F.array(F.when(F.col("n_chars") <= 1000, F.col("n_chars").cast("string")))).alias("m"), F.array("lang", "source").alias("l"))
    return docs.select("doc_id", writers.scalar_list("l").alias("joined"), F.try_element_at(writers.without_nulls("m"), F.lit("kept")).alias("kept"))


# --- pages


@query("html_strip", f"SELECT page_id, md5({sql_collapse(chr(40) + 'regexp_replace(html, ' + chr(39) + '<[^>]+>' + chr(39) + ', ' + chr(39) + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')' + chr(41))}) AS text_md5 FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.collapse(T.strip_tags("html"))).alias("text_md5"))


@query("html_links", """SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]+href="([^"]*)"', 1)) AS href FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a[^>]+href="([^"]*)"'), F.lit(1))).alias("href"))


@query("html_title", "SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages")
def _(spark, d):
    from ..sources import html

    return table(spark, d, "pages").select("page_id", html.title("html").alias("title"), html.host("url").alias("host"))


@query("html_list_rows", """SELECT page_id, i::INT AS pos, trim(regexp_replace(x, '<[^>]+>', '', 'g')) AS item FROM (SELECT page_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS l FROM pages))""")
def _(spark, d):
    from ..sources import html

    return html.rows(table(spark, d, "pages"), "page_id", "html", "<li>(.*?)</li>").select("page_id", "pos", "item")


# --- chunking


@query("fixed_window_chunks", f"""SELECT doc_id, (i // 650)::INT AS pos, array_to_string(list_slice(w, i + 1, i + 800), ' ') AS chunk FROM (SELECT doc_id, {sql_words('text')} AS w FROM documents), unnest(range(0, len(w), 650)) t(i)""")
def _(spark, d):
    from ..operators import chunking

    return chunking.fixed_windows(table(spark, d, "documents"), "doc_id", "text")


@query("chunk_quality_gate", f"""SELECT doc_id, count(*) AS chunks, count(*) FILTER (length(c) >= 50) AS kept FROM (SELECT doc_id, array_to_string(list_slice(w, i + 1, i + 100), ' ') AS c FROM (SELECT doc_id, {sql_words('text')} AS w FROM documents), unnest(range(0, len(w), 80)) t(i)) GROUP BY doc_id""")
def _(spark, d):
    from ..operators import chunking

    chunks = chunking.fixed_windows(table(spark, d, "documents"), "doc_id", "text", 100, 20)
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(F.length("chunk") >= 50).alias("kept"))


_STRIPPED = "regexp_replace({0}, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g')"


@query("paragraph_packs", f"""WITH RECURSIVE p AS MATERIALIZED (SELECT doc_id, string_split(coalesce(text, ''), chr(10) || chr(10)) AS l FROM documents),
    r AS (SELECT doc_id, 1 AS i, 0 AS pos, length(l[1]) + 2 AS chars FROM p UNION ALL
        SELECT doc_id, i + 1, CASE WHEN chars + length(l[i + 1]) > 500 THEN pos + 1 ELSE pos END, CASE WHEN chars + length(l[i + 1]) > 500 THEN 0 ELSE chars END + length(l[i + 1]) + 2 FROM r JOIN p USING (doc_id) WHERE i < len(l)),
    packs AS (SELECT doc_id, pos, string_agg(l[i], chr(10) || chr(10) ORDER BY i) AS pack FROM r JOIN p USING (doc_id) GROUP BY doc_id, pos)
    SELECT doc_id, pos, {_STRIPPED.format('pack')} AS chunk FROM packs QUALIFY {_STRIPPED.format('pack')} <> '' OR pos < max(pos) OVER (PARTITION BY doc_id)""")
def _(spark, d):
    from ..operators import chunking

    return chunking.paragraph_packs(table(spark, d, "documents"), "doc_id", "text")


def _sentence_end_sql(mark: str) -> str:
    """A window up to its last mark followed by a space, if that is past the middle."""
    at = f"(length(w) - strpos(reverse(w), ' {mark}') - 1)"
    return f"CASE WHEN contains(w, '{mark} ') AND 2 * {at} > length(w) THEN left(w, {at} + 1) END"


_TO_SENTENCE_END = f"coalesce({', '.join(_sentence_end_sql(mark) for mark in '.?!')}, w)"


@query("sentence_windows", f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_STRIPPED.format("coalesce(text, '')")} AS whole, {sql_words('text')} AS l FROM documents),
    r AS (SELECT doc_id, -1 AS pos, 0 AS start, 0 AS next, '' AS chunk FROM d WHERE length(whole) >= 50 AND len(l) > 160 UNION ALL
        SELECT doc_id, pos + 1, next, next + greatest(len(string_split(c, ' ')) - 30, 1), c FROM
            (SELECT doc_id, pos, next, CASE WHEN next + 160 < len(l) THEN {_TO_SENTENCE_END} ELSE w END AS c FROM (SELECT doc_id, pos, next, l, array_to_string(list_slice(l, next + 1, next + 160), ' ') AS w FROM r JOIN d USING (doc_id) WHERE next < len(l))))
    SELECT doc_id, pos::INT AS pos, chunk FROM r WHERE pos >= 0 UNION ALL SELECT doc_id, 0, whole FROM d WHERE length(whole) >= 50 AND len(l) <= 160""")
def _(spark, d):
    from ..operators import chunking

    return chunking.sentence_windows(table(spark, d, "documents"), "doc_id", "text")


@query("boundary_windows", f"""WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, {sql_words('text')} AS l, string_split(regexp_replace(coalesce(text, ''), '({R.SECTION_STARTS})', chr(1) || '\\1', 'g'), chr(1)) AS pieces FROM documents),
    lengths AS (SELECT doc_id, unnest(list_transform(pieces, lambda x: len({sql_words('x').replace('lambda x: x', 'lambda y: y')}))) AS n, generate_subscripts(pieces, 1) AS i FROM t),
    starts AS MATERIALIZED (SELECT doc_id, list(DISTINCT s) AS starts FROM (SELECT doc_id, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM lengths) WHERE s > 0 GROUP BY doc_id),
    d AS MATERIALIZED (SELECT doc_id, l, starts FROM t JOIN starts USING (doc_id)),
    r AS (SELECT doc_id, -1 AS pos, 0::BIGINT AS since, 0::BIGINT AS upto FROM d UNION ALL
        SELECT doc_id, pos + 1, upto, CASE WHEN upto + 800 < len(l) THEN coalesce(list_min(list_filter(starts, lambda n: n >= upto + 640 AND n <= upto + 800))::BIGINT, upto + 800) ELSE len(l) END FROM r JOIN d USING (doc_id) WHERE upto < len(l))
    SELECT doc_id, pos::INT AS pos, array_to_string(list_slice(l, since + 1, upto), ' ') AS chunk FROM r JOIN d USING (doc_id) WHERE pos >= 0""")
def _(spark, d):
    from ..operators import chunking

    return chunking.boundary_windows(table(spark, d, "documents"), "doc_id", "text")


# --- redaction


def _redacted_sql(c: str) -> str:
    for pattern, to in R.REDACTIONS:
        replacement = to.replace("$1", "\\1").replace("'", "''")
        c = f"regexp_replace({c}, '{pattern}', '{replacement}', 'gi')"
    return c


@query("log_redaction", f"SELECT doc_id, md5({_redacted_sql('text')}) AS redacted_md5 FROM documents")
def _(spark, d):
    from ..operators import redaction

    return table(spark, d, "documents").select("doc_id", F.md5(redaction.redacted("text")).alias("redacted_md5"))


@query("email_mask", r"""SELECT doc_id, regexp_extract(text, '([A-Za-z0-9._%+-]+)@[A-Za-z0-9.-]+', 0) AS found, CASE WHEN contains(e, '@') THEN substring(split_part(e, '@', 1), 1, 2) || '***@' || split_part(e, '@', 2) ELSE e END AS masked
    FROM (SELECT doc_id, text, regexp_extract(text, '([A-Za-z0-9._%+-]+)@[A-Za-z0-9.-]+', 0) AS e FROM documents)""")
def _(spark, d):
    from ..operators import redaction

    found = F.regexp_extract("text", r"([A-Za-z0-9._%+-]+)@[A-Za-z0-9.-]+", 0)
    return table(spark, d, "documents").select("doc_id", found.alias("found")).withColumn("masked", redaction.masked_email(F.col("found")))


@query("field_search", f"""SELECT doc_id FROM documents WHERE list_contains({sql_tokens('text')}, 'the') AND NOT list_contains({sql_tokens('text')}, 'idiot') AND contains(lower({sql_collapse('text')}), 'of the') AND lang = 'en'""")
def _(spark, d):
    from ..operators import boolean_search

    return boolean_search.search(table(spark, d, "documents"), 'the NOT idiot "of the" lang:en', "text").select("doc_id")


@query("first_occurrence_dedup", f"""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source, substring(lower({sql_collapse('text')}), 1, 300) ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.md5(T.normalized_prefix("text")).alias("k"))
    return docs.withColumn("n", F.row_number().over(Window.partitionBy("source", "k").orderBy("doc_id"))).where("n = 1").select("doc_id", "source")
