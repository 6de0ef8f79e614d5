"""Small tables, ours, for operators whose inputs the synthetic tables don't have: statutes, queries about them, cases, logs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from . import resources as R
from . import store

#: name: (columns and Spark types, rows)
TABLES = {
    "chunks": (
        "id string, document string, source string, page int, page_hash string, act_name string, section_number string, section_title string, source_type string, jurisdiction string, decision_date string, structure_type string",
        [
            ("c1", "Section 302 IPC. Whoever commits murder shall be punished with death or imprisonment for life, and fine.", "penal_code.pdf", 12, "h1", "IPC", "302", "Punishment for murder", "bare_act", None, None, "bare_act"),
            ("c2", "Section 101 BNS. Punishment for murder is death or imprisonment for life.", "sanhita.pdf", 30, "h2", "BNS", "101", "Murder", "bare_act", "Supreme Court of India", "2024-06-01", "bare_act"),
            ("c3", "[s 378] Theft. Whoever takes movable property dishonestly commits theft. The offence is cognizable.", "penal_code.pdf", 40, "h3", None, "378", "Theft", "commentary", "Delhi High Court", "01-02-2020", "commentary"),
            ("c4", "Section 303 BNS. Theft: a subsequent conviction brings rigorous imprisonment of one year.", "sanhita.pdf", 55, "h4", "BNS", "303", "Theft", "bare_act", None, "2024/03/05", "bare_act"),
            ("c5", "Same page as the first chunk: murder and culpable homicide are told apart.", "penal_code.pdf", 12, "h1", "IPC", None, None, "commentary", None, None, "commentary"),
            ("c6", "144. Power to issue order in urgent cases of nuisance under the code of criminal procedure.", "procedure.pdf", 7, None, None, "144", None, None, "high court", "05/03/2019", None),
            ("c7", "The bharatiya law of evidence: a confession to a police officer is not proved.", "evidence.pdf", 3, None, None, "25", "Confession", "bare_act", None, "not a date", None),
            ("c8", "The bharatiya law of EVIDENCE:  a confession to a police officer is not proved.", "evidence.pdf", 3, None, None, "25", "Confession", "bare_act", None, None, None),
        ],
    ),
    "asked": (
        "query_id int, query string",
        [
            (1, "Section 302 IPC punishment for murder"),
            (2, "Compare IPC 302 with BNS section 101"),
            (3, "What is the punishment for theft under BNS?"),
            (4, "Section 144 CrPC now Section 163 BNSS"),
            (5, "Is a confession to the police admissible?"),
            (6, "my employer did not pay wages"),
            (7, "Sections 302 and 376 IPC before the Supreme Court and Article 21 of the Constitution"),
            (8, "recipe of the day please tell me"),
            (9, "hello"),
            (10, ""),
            (11, "anticipatory bail application in the high court under sec. 438 crpc"),
            (12, "what is the best move to negotiate"),
            (13, "upload this pdf scan"),
            (14, "BNS section 101 equivalent"),
            (15, "theft punishment"),
            (16, "Section 498A IPC domestic violence"),
        ],
    ),
    "crosswalk": (
        "ord int, old_section string, new_section string, name string, note string",
        [(1, "302", "101", "Murder", "renumbered"), (2, "376", "178", "Rape", None), (3, "378", "303", "Theft", "merged"), (4, "379", "303", "Punishment for theft", None), (5, "304B", "105", "Dowry death", None), (6, "498A", "80", "Cruelty", "split")],
    ),
    "synonyms": (
        "ord int, term string, n int, phrase string",
        [
            (1, "murder", 1, "culpable homicide"), (1, "murder", 2, "section 302"), (2, "theft", 1, "larceny"), (2, "theft", 2, "stealing"), (3, "bail", 1, "anticipatory bail"), (3, "bail", 2, "release"),
            (4, "fir", 1, "first information report"), (5, "limitation", 1, "time limit"), (6, "wages", 1, "salary"), (6, "wages", 2, "unpaid wages"),
        ],
    ),
    "answers": (
        "response_id int, response string",
        [
            (1, "Section 302 IPC applies. Punishment is death or life. AIR 2023 SC 123 and AIR 2023 SC 123."),
            (2, "Under IPC section 999 IPC says imprisonment for up to 7 years, fine of 5,000 rupees. BNS too. Section 400 BNS. SCC 2031 SC 5."),
            (3, "Whoever takes property shall be punished. AIR 2020 XX 12, AIR 2019 SC 500."),
            (4, "No claims here."),
        ],
    ),
    "evidence": (
        "response_id int, rank int, id string, document string, source string, page int, act string, section string, similarity double, title string, chunk_index int, structure_type string",
        [
            (1, 1, "c1", "Section 302 IPC. Whoever commits murder shall be punished with death.", "penal_code.pdf", 12, "IPC", "302", 0.95, "Indian Penal Code, 1860", 0, "bare_act"),
            (1, 2, "c2", "Section 101 BNS. Punishment is death or imprisonment for life. A second offence is aggravated.", "sanhita.pdf", 30, "BNS", "101", 0.9, "Bharatiya Nyaya Sanhita, 2023", 4, "bare_act"),
            (1, 3, "c3", "The offence is cognizable and non-bailable.", "ratanlal.pdf", 9, "IPC", "300", 0.75, "Textbook", 2, "commentary"),
            (1, 4, "c4", "Not close.", "other.pdf", 1, "IPC", "1", 0.5, "Other", 0, None),
            (2, 1, "c5", "Imprisonment for 7 years and fine of 5000 rupees.", "penal_code.pdf", 80, "IPC", "420", 0.8, "Indian Penal Code, 1860", 1, "bare_act"),
            (3, 1, "c6", "Nothing that helps.", "x.pdf", 2, "LEGAL", None, 0.4, "X", 0, None),
        ],
    ),
    "cases": (
        "case_id string, case_name string, citation string, court string, bench_size int, decided date, status string, ratio string",
        [
            ("a", "Alpha v State", "AIR 1990 SC 10", "supreme_court", 5, None, "active", "the rule of fair hearing"), ("b", "Beta v Union", "AIR 1995 Del 7", "delhi_high_court", 2, None, "active", None),
            ("c", "Gamma v Delta", "AIR 2001 SC 3", "supreme_court", 3, None, "active", "a confession needs support"), ("d", "Epsilon", "ILR 2005 Bom 9", "bombay_high_court", 1, None, "active", None),
            ("e", "Zeta v Eta", "SCC 2010 SC 4", "supreme_court", 7, None, "active", "fair trial"), ("f", "Theta", "AIR 2015 Mad 2", "madras_high_court", 1, None, "active", None),
        ],
    ),
    "cites": ("src string, dst string", [("b", "a"), ("c", "a"), ("c", "b"), ("c", "b"), ("d", "c"), ("e", "d"), ("e", "zz"), ("f", "e")]),
    "rulings": ("case_id string, ruled_by string, kind string", [("a", "e", "overruled"), ("b", "c", "followed"), ("a", "c", "followed"), ("zz", "e", "followed")]),
    "log_lines": (
        "line_id int, message string",
        [
            (1, "api_key=ABCDEFGHIJKLMNOPQRSTUVWX sent"), (2, "X-API-Key: abcdefghij-klmnop_qrstuv ok"), (3, "Authorization: Bearer aaa.bbb.ccc"), (4, "password=hunter2 next"), (5, "jwt_secret: s3cr3t!"),
            (6, "key gsk_ABCDEFGHIJKLMNOPQRSTUVWXYZ012345 end"), (7, "postgresql://user:pw@host/db redis://:pw@host"), (8, "nothing to hide"), (9, None), (10, "access_token=x.y.z POSTGRES_PASSWORD: abc"),
        ],
    ),
    "users": (
        "user_id string, username string, email string, role string, active boolean",
        [("u1", "ann_1", "annabel@example.org", "admin", True), ("u2", "bo", "b@example.org", "lawyer", True), ("u3", "cy x", "not-an-email", "viewer", False), ("u4", "dee", None, "unknown", True)],
    ),
    "permissions": ("role string, permission string", [("admin", "search"), ("admin", "ingest"), ("admin", "manage_users"), ("lawyer", "search"), ("lawyer", "export"), ("viewer", "search")]),
    "members": ("workspace_id string, user_id string, active boolean", [("w1", "u1", True), ("w1", "u2", True), ("w2", "u2", False), ("w3", "u9", True)]),
    "gazette": (
        "page_id int, act_name string, html string",
        [
            (1, "Arms Act, 1959", '<table><tr><th>x</th></tr><tr><td><b>Notice  1</b></td><td>05-03-2024</td><td>New  rules <a href="/n/1">more</a></td></tr><tr><td>Old</td><td>01/01/2001</td><td>gone</td></tr><tr><td>No date</td><td>soon</td><td>x</td></tr><tr><td>Two</td><td>5</td></tr></table>'),
            (2, "Forest Act, 1927", '<TABLE><TR class="r"><TD>Notice 2</TD><TD>on 9/4/2024</TD><TD>Second <i>rule</i></TD></TR></TABLE>'),
        ],
    ),
    "rules": ("act_name string, alert_type string, recipients string", [("Arms Act, 1959", "email", "a@example.org"), ("Arms Act, 1959", "web", "hook"), ("Copyright Act, 1957", "email", "c@example.org")]),
    "statute_pages": (
        "page_id int, filename string, text string",
        [
            (1, "Indian_Penal_Code_1860.pdf", "THE INDIAN PENAL CODE ACT, 1860\nCHAPTER XVI - Offences\nSection 299. Culpable homicide\nWhoever causes death commits culpable homicide.\nProvided that grave provocation counts.\nSection 300. Murder\nExcept in the cases below, culpable homicide is murder.\nException: sudden fight.\nIllustration: A shoots Z."),
            (2, "ratanlal_commentary.pdf", "Commentary on the law.\n1. Theft is of movable property.\n2. Extortion needs consent by fear."),
            (3, "Forest_Act_1927.pdf", "Short title and preamble. This Act extends to the whole of India and says nothing by sections."),
            (4, "scan.pdf", "   "),
            (5, "bns_notes.pdf", "Section 5.\nSection 6. Scope of the sanhita\nBharatiya Nyaya Sanhita applies here."),
        ],
    ),
    "spoken": ("id int, text string", [(1, "search section 302 ipc for murder"), (2, "please help me with bail"), (3, "exit now"), (4, "what about f i r and evidence"), (5, "hmm")]),
    "bilingual": ("id int, text string", [(1, "murder"), (2, "हत्या के लिए सजा"), (3, "section 302 हत्या law text"), (4, "1234"), (5, None), (6, "bail and theft")]),
    "runs": ("run string, metric string, value double, higher_is_better boolean", [("base", "recall", 0.6, True), ("new", "recall", 0.75, True), ("base", "latency_ms", 120.0, False), ("new", "latency_ms", 150.0, False), ("base", "only_base", 1.0, True)]),
    "scored": ("id int, category string, chunks array<string>, kw array<string>", [
        (1, "exact", ["Section 302 murder", "death penalty"], ["302", "murder", "life sentence"]), (2, "similar", ["wages unpaid for months"], ["unpaid wages", "labour"]), (3, "irrelevant", ["a cake"], []), (4, "irrelevant", ["section of the act", "court"], []),
        (5, "irrelevant", ["Section", "act", "BNS", "court"], []), (6, "exact", [], ["x"]),
    ]),
    "sources": ("file string, length int, head string, modified timestamp", [("a.pdf", 5000, "%PDF", None), ("b.pdf", 50, "%PDF", None), ("c.pdf", 900, "HTML", None), ("d.txt", 10, "text", None)]),
    "compared": ("query_id int, act string, section string", [(1, "IPC", "302"), (2, "IPC", "304b"), (3, "BNS", "303"), (4, "BNS", "999"), (5, "IPC", "378")]),
    "added": ("term string, phrase string", [("murder", "slaying"), ("bail", "bond"), ("arson", "fire raising")]),
    "batches": ("text string", [("\"first query\"\n# comment\n\nsecond, query  \n'third'",)]),
    "civil": ("key string, name string, short_name string, year int, effective_date string, sections int", [(k, *v) for k, v in R.CIVIL_CATALOGUE.items()]),
    "act_names": (
        "id int, name string, short string",
        [(i, n, R.SHORT_ACT_NAMES.get(next(a for a, f in R.QUERY_ACT_NAMES.items() if f == n), n)) for i, n in enumerate(dict.fromkeys(R.QUERY_ACT_NAMES.values()), 1)] + [(0, "Forest Act, 1927", "Forest Act, 1927")],
    ),
    "jobs": ("kind string, last_run string, every_days int", [("full", "2024-03-01", 90), ("partial", "2024-03-01", 30), ("never", None, 7)]),
    "roman": ("id int, t string", [(1, "khaa"), (2, "xyz"), (3, None)]),
    "files": ("raw string", [("My Book (2nd ed.).PDF",), ("a_b.txt",)]),
    "marked": ("id int, raw string, plain string", [(1, "# Title\n**bold** and `code` [link](http://x)", "Title\nbold and code link"), (2, "“quoted” – ok…", '"quoted" - ok.')]),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    ddl, rows = TABLES[name]
    return spark.createDataFrame(rows, ddl)


_SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "array<string>": "VARCHAR[]"}


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, int | float):
        return repr(x)
    if isinstance(x, list):
        return "[" + ", ".join(map(_literal, x)) + "]"
    return "'" + str(x).replace("'", "''") + "'"


def sql(name: str) -> str:
    """The same table as a CTE: `name AS (...)`."""
    ddl, rows = TABLES[name]
    columns = [c.rsplit(" ", 1) if "<" not in c else c.split(" ", 1) for c in ddl.split(", ")]
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    casts = ", ".join(f"CAST({n} AS {_SQL_TYPES[t]}) AS {n}" for n, t in columns)
    return f"{name} AS (SELECT {casts} FROM (VALUES {values}) v({', '.join(n for n, _ in columns)}))"


# --- the same tables over the given ones: every row of a given table takes one row (or each) of a table above as its pattern, and adds its own text and keys

#: name: (given table, filter, pattern column and key that chooses the row, columns that differ from the pattern's).
#: The expressions are SQL of both engines: b is the given table, t the pattern, {text} the given text's letters and digits.
_TURN = "b.conv_id * 100 + b.turn"
_BEFORE = "b.conv_id * 100 + b.turn - 1"  # of an answer: the turn asked
_SUPPLIER = "'-' || CAST(b.s_suppkey AS STRING)"
OVER = {
    "asked": ("conversations", "b.role = 'user'", ("_n", _TURN), {"query_id": f"CAST({_TURN} AS INT)", "query": "t.query || ' ' || {text}"}),
    "chunks": ("documents", "TRUE", ("_n", "b.doc_id"), {"id": "'d' || CAST(b.doc_id AS STRING)", "document": "t.document || ' ' || {text}", "page": "CAST(t.page + b.doc_id AS INT)", "page_hash": "t.page_hash || CAST(b.doc_id AS STRING)"}),
    "answers": ("conversations", "b.role = 'assistant'", ("response_id", _BEFORE), {"response_id": f"CAST({_BEFORE} AS INT)", "response": "t.response || ' ' || {text}"}),
    "evidence": ("conversations", "b.role = 'assistant'", ("response_id", _BEFORE), {"response_id": f"CAST({_BEFORE} AS INT)", "id": f"t.id || '-' || CAST({_BEFORE} AS STRING)", "document": "t.document || ' ' || {text}"}),
    "statute_pages": ("documents", "TRUE", ("_n", "b.doc_id"), {"page_id": "CAST(b.doc_id AS INT)", "text": "t.text || chr(10) || {text}"}),
    "spoken": ("conversations", "b.role = 'user'", ("_n", _TURN), {"id": f"CAST({_TURN} AS INT)", "text": "t.text || ' ' || {text}"}),
    "bilingual": ("conversations", "b.role = 'user'", ("_n", _TURN), {"id": f"CAST({_TURN} AS INT)", "text": "t.text || ' ' || {text}"}),
    "log_lines": ("conversations", "b.role = 'assistant'", ("_n", _TURN), {"line_id": f"CAST({_TURN} AS INT)", "message": "t.message || ' ' || {text}"}),
    "scored": ("conversations", "b.role = 'user'", ("_n", _TURN), {"id": f"CAST({_TURN} AS INT)", "chunks": "array_append(t.chunks, {text})"}),
    "users": ("customer", "TRUE", ("_n", "b.c_custkey"), {"user_id": "'u' || CAST(b.c_custkey AS STRING)", "username": "t.username || CAST(b.c_custkey AS STRING)"}),
    "members": ("orders", "TRUE", ("_n", "b.o_orderkey"), {"workspace_id": "'w' || CAST(b.o_orderkey % 50 AS STRING)", "user_id": "'u' || CAST(b.o_custkey AS STRING)"}),
    "cases": ("supplier", "TRUE", None, {"case_id": f"t.case_id || {_SUPPLIER}", "case_name": "t.case_name || ' ' || b.s_name"}),
    "cites": ("supplier", "TRUE", None, {"src": f"t.src || {_SUPPLIER}", "dst": f"t.dst || {_SUPPLIER}"}),
    "rulings": ("supplier", "TRUE", None, {"case_id": f"t.case_id || {_SUPPLIER}", "ruled_by": f"t.ruled_by || {_SUPPLIER}"}),
    "gazette": ("pages", "TRUE", ("_n", "b.page_id"), {"page_id": "CAST(b.page_id AS INT)", "html": "t.html || '<p>' || b.url || '</p>'"}),
    "runs": ("nation", "TRUE", None, {"metric": "t.metric || ' of ' || b.n_name", "value": "t.value + b.n_nationkey"}),
    "sources": ("documents", "TRUE", ("_n", "b.doc_id"), {"file": "CAST(b.doc_id AS STRING) || t.file", "length": "CAST(b.n_chars AS INT)"}),
    "compared": ("documents", "TRUE", ("_n", "b.doc_id"), {"query_id": "CAST(b.doc_id AS INT)"}),
    "crosswalk": ("documents", "TRUE", ("_n", "b.doc_id"), {"ord": "CAST(b.doc_id AS INT)", "old_section": "t.old_section || '-' || CAST(b.doc_id % 1000 AS STRING)", "new_section": "t.new_section || '-' || CAST(b.doc_id % 997 AS STRING)"}),
    "synonyms": ("documents", "TRUE", None, {"ord": "CAST(b.doc_id * 10 + t.ord AS INT)", "term": "t.term || ' ' || CAST(b.doc_id AS STRING)"}),
    "added": ("documents", "TRUE", None, {"term": "t.term || ' ' || CAST(b.doc_id AS STRING)"}),
    "batches": ("conversations", "b.role = 'user'", ("_n", _TURN), {"text": "t.text || chr(10) || {text}"}),
    "civil": ("documents", "TRUE", ("_n", "b.doc_id"), {"key": "t.key || '-' || CAST(b.doc_id AS STRING)"}),
    "act_names": ("documents", "TRUE", ("_n", "b.doc_id"), {"id": "CAST(b.doc_id AS INT)"}),
    "jobs": ("orders", "TRUE", ("_n", "b.o_orderkey"), {"kind": "t.kind || ' ' || CAST(b.o_orderkey AS STRING)", "last_run": "CASE WHEN t.last_run IS NOT NULL THEN CAST(CAST(b.o_orderdate AS DATE) AS STRING) END"}),
    "roman": ("documents", "TRUE", ("_n", "b.doc_id"), {"id": "CAST(b.doc_id AS INT)", "t": "t.t || ' ' || CAST(b.doc_id AS STRING)"}),
    "files": ("documents", "TRUE", ("_n", "b.doc_id"), {"raw": "CAST(b.doc_id AS STRING) || ' ' || t.raw"}),
    "marked": ("conversations", "TRUE", ("_n", _TURN), {"id": f"CAST({_TURN} AS INT)", "raw": "t.raw || ' ' || {text}", "plain": "t.plain || ' ' || {text}"}),
}
_TEXT = "regexp_replace(coalesce(b.text, ''), '[^A-Za-z0-9]+', ' '{0})"


def _columns(name: str) -> list[str]:
    return [c.rsplit(" ", 1)[0] if "<" not in c else c.split(" ", 1)[0] for c in TABLES[name][0].split(", ")]


def _of(name: str, text: str) -> tuple[str, str, list[str]]:
    """The given table, the condition of the join with the patterns, and the columns."""
    given, where, chosen, changed = OVER[name]
    rows = TABLES[name][1]
    if chosen:
        column, key = chosen
        n = len(rows) if column == "_n" else len({r[_columns(name).index(column)] for r in rows})
        where += f" AND t.{column} = ({key}) % {n} + 1"
    return given, where, [f"{changed.get(c, f't.{c}').replace('{text}', text)} AS {c}" for c in _columns(name)]


_SPACED = bytes(b if chr(b).isascii() and chr(b).isalnum() else 32 for b in range(256))


def _letters_and_digits(text: bytes | None) -> bytes:
    """_TEXT of a text in UTF-8, all of whose bytes of other characters than ASCII's are above 127."""
    spaced = (text or b"").translate(_SPACED)
    words = b" ".join(spaced.split())
    return (b" " if spaced[:1] == b" " else b"") + words + (b" " if words and spaced[-1:] == b" " else b"")


def _cleaned(rows: DataFrame) -> DataFrame:
    """rows whose text is its letters and digits, made in Arrow batches: some ten times as fast as by a regular expression of Spark."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = pa.array(map(_letters_and_digits, batch.column(at).cast(pa.binary()).to_pylist()), pa.binary())
            yield batch.set_column(at, "text", texts.cast(pa.string()))

    store.bounded_batches(rows.sparkSession)
    return rows.mapInArrow(run, rows.schema)


def over(spark: SparkSession, sf_dir: str, name: str, in_arrow: bool = False) -> DataFrame:
    """The table over the given one of sf_dir. The patterns are a few rows of this module. in_arrow: given texts are made plain in Arrow batches, with the same result."""
    from pyspark.sql import functions as F

    ddl, rows = TABLES[name]
    patterns = spark.createDataFrame([(*r, i) for i, r in enumerate(rows, 1)], f"{ddl}, _n int")
    given, where, columns = _of(name, "b.text" if in_arrow else _TEXT.format(""))
    rows = spark.read.parquet(f"{sf_dir}/{given}.parquet")
    if in_arrow:
        rows = _cleaned(rows.select(*sorted(set(re.findall(r"\bb\.(\w+)", " ".join([where, *columns]))))))
    return rows.alias("b").join(F.broadcast(patterns).alias("t"), F.expr(where)).selectExpr(*columns)


def over_sql(name: str) -> str:
    """The same as a CTE: `name AS (...)`."""
    ddl, rows = TABLES[name]
    kinds = [c.rsplit(" ", 1) if "<" not in c else c.split(" ", 1) for c in ddl.split(", ")]
    values = ", ".join("(" + ", ".join(map(_literal, (*r, i))) + ")" for i, r in enumerate(rows, 1))
    casts = ", ".join(f"CAST({n} AS {_SQL_TYPES[t]}) AS {n}" for n, t in kinds)
    given, where, columns = _of(name, _TEXT.format(", 'g'"))
    return f"{name} AS (SELECT {', '.join(columns)} FROM {given} b JOIN (SELECT {casts}, _n FROM (VALUES {values}) v({', '.join(n for n, _ in kinds)}, _n)) t ON {where})"
