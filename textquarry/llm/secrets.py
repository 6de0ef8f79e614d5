"""Secret scans with DataFrame functions only.

Base patterns, leftmost non-overlapping per kind: `assign` (a key word, : or =, a value of 8 characters or more),
`access` (AKIA and capitals or digits, 16 or more), `hex` (32 or more). A span is the whole match, in code points,
end exclusive. Positions come from the pieces between matches: a text split at a pattern, and the matches themselves.

The method adds `entropy` spans. Candidates are runs of `CANDIDATE_CHARS` characters or more of base-64 and URL letters, but for
those that an `ALLOWED` pattern matches as a whole (UUIDs, digits or letters only, words of letters that end in a short number).
Windows of `WINDOW` characters slide over a candidate, one character at a time. How often each character is in the window is kept
up to date as one enters and one leaves, and with it the sum of c log2 c and how many characters are outside each class: a step costs the
same whatever came before. A window that holds letters and digits is judged by the narrowest
character class that holds all of it (hexadecimal, alphanumeric, base-64), so a name or path in front of a secret doesn't hide it; a candidate
with a window whose Shannon entropy reaches its class's limit is a span. Windows that touch a placeholder word (`MASKED`) don't count.
Added spans that overlap a base span are left out.

All work on a text grows in proportion to it, but for running positions, which are summed in blocks of `BLOCK` matches.

Null and empty texts have no spans. Very long texts are scanned whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Kind, pattern, a pattern that a text must have for any match to pass, least characters, group that they count in.
BASE = (
    ("assign", ASSIGN, r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", 8, 2),
    ("access", ACCESS, r"AKIA[A-Z0-9]{12}", 16, 0),
    ("hex", r"[0-9a-f]{32,}", r"[0-9a-f]{32}", 32, 0),
)
CANDIDATE_CHARS, WINDOW = 20, 20
CANDIDATE = rf"[A-Za-z0-9+/=_-]{{{CANDIDATE_CHARS},}}"
#: Only texts with such a run are scanned for candidates: letters and digits mixed closely.
CANDIDATE_HINT = rf"(?=[A-Za-z+/=_-]{{0,{CANDIDATE_CHARS}}}[0-9])[A-Za-z0-9+/=_-]{{{CANDIDATE_CHARS}}}"
#: The characters of candidates, each class's after those of the narrower ones.
ALPHABET = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/=_-"
#: Class, how many characters of the alphabet it has, the least entropy in bits of a window of 20 (at most log2 20 = 4.32; 4 for hexadecimal).
CLASSES = (("hex", 22, 3.0), ("alphanumeric", 62, 3.7), ("base64", 67, 3.9))
#: Candidates that are no secrets. No pattern may take a step of recursion for each repeat: repeated groups are possessive.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9/_=+-]+$",
    r"^[A-Za-z/_=+-]+$",
    r"^(?:[A-Za-z]+[/_-])*+[A-Za-z]*[0-9]{1,4}$",
)
MASKED = r"(?i)example|sample|placeholder|xxxx|0123456789|abcdefgh"
#: Bits of a packed counter.
BITS = 6
BLOCK = 128
#: c log2 c of counts 0 to WINDOW as whole numbers, so that sums never drift; and the greatest such sum that reaches a class's limit.
_SCALE = 1 << 40
_PARTS = tuple(round(c * math.log2(c) * _SCALE) if c else 0 for c in range(WINDOW + 1))
_MOST = tuple(math.floor((math.log2(WINDOW) - least) * WINDOW * _SCALE) for _, _, least in CLASSES)

_SPANS = "array<struct<start: long, rank: int, past: long, kind: string>>"


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _located(text: Column, pattern: str, keep, kind: str, rank: int) -> Column:
    """Spans of the matches that keep(match) passes, positions counted over all matches: within blocks, then over blocks."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(F.split(text, pattern, -1), F.concat(matches, F.array(F.lit(None).cast("string"))), lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
    size = lambda piece: (F.length(piece["gap"]) + F.coalesce(F.length(piece["m"]), F.lit(0))).cast("long")

    def step(state, piece):
        past = state["at"] + size(piece)
        span = F.array(F.struct((past - F.length(piece["m"])).alias("start"), F.lit(rank).alias("rank"), past.alias("past"), F.lit(kind).alias("kind")))
        passed = piece["m"].isNotNull() & keep(piece["m"])
        return F.struct(past.alias("at"), F.when(passed, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    def blocks(pieces):
        start = F.expr(f"named_struct('at', 0L, 'spans', cast(array() as {_SPANS}))")
        parts = F.transform(F.sequence(F.lit(1), F.size(pieces), F.lit(BLOCK)), lambda at: F.slice(pieces, at, F.lit(BLOCK)))
        return F.transform(parts, lambda part: F.aggregate(part, start, step))

    def shifted(blocks):
        before = F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda sums, block: F.concat(sums, F.array(F.element_at(sums, -1) + block["at"])))
        moved = lambda x, by: F.struct((x["start"] + by).alias("start"), x["rank"].alias("rank"), (x["past"] + by).alias("past"), x["kind"].alias("kind"))
        return F.flatten(F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), lambda block, by: F.transform(block["spans"], lambda x: moved(x, by))))

    return _let(pieces, lambda p: _let(blocks(p), shifted))


def _none() -> Column:
    return F.expr(f"cast(array() as {_SPANS})")


def base_spans(text: Column) -> list[Column]:
    """For each base kind, its spans in order."""
    out = []
    for rank, (kind, pattern, hint, least, group) in enumerate(BASE):
        size = (lambda m, p=pattern: F.length(F.regexp_extract(m, p, 2))) if group else F.length
        out.append(F.when(text.rlike(hint), _located(text, pattern, lambda m, f=size, n=least: f(m) >= n, kind, rank)).otherwise(_none()))
    return out


def has_random_window(word: Column) -> Column:
    """True if a window of letters and digits reaches the entropy of the narrowest class that holds it, by incremental counts.

    The state is of fixed size: a string with one character for each of the alphabet that says how often it is in the window,
    the sum of c log2 c, and small counters packed into one number: characters outside each class, digits, letters.
    """
    alphabet = ALPHABET + " "  # the last stands for masked characters, which are in no class
    after = [[F.lit(_PARTS[max(0, min(n + by, WINDOW))] - _PARTS[n]) for n in range(WINDOW + 1)] for by in (1, -1)]
    came, gone = (F.array(*x) for x in after)
    counters = [lambda k, size=size: k >= size for _, size, _ in CLASSES] + [lambda k: k < 10, lambda k: 10 <= k < 62]
    units = F.array(*[F.lit(sum(1 << BITS * j for j, holds in enumerate(counters) if holds(k))).cast("long") for k in range(len(alphabet))])
    mask = [F.lit(((1 << BITS) - 1) << BITS * j).cast("long") for j in range(len(counters))]
    empty = F.struct(F.lit(0).alias("i"), F.repeat(F.lit("A"), len(alphabet)).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("marks"), F.lit(False).alias("found"))

    def changed(s, code, by: int, parts):
        def counted(n):
            counts = F.overlay(s["counts"], F.char(n + (65 + by)), code + 1, 1)
            marks = F.get(units, code)
            return F.struct(s["i"].alias("i"), counts.alias("counts"), (s["sum"] + F.get(parts, n)).alias("sum"), (s["marks"] + marks if by > 0 else s["marks"] - marks).alias("marks"), s["found"].alias("found"))

        return _let(F.ascii(F.substr(s["counts"], code + 1, F.lit(1))) - 65, counted)

    def judged(s):
        entropic = F.lit(False)
        for j, most in reversed(list(enumerate(_MOST))):
            entropic = F.when(s["marks"].bitwiseAND(mask[j]) == 0, s["sum"] <= most).otherwise(entropic)
        hit = (s["i"] + 1 >= WINDOW) & (s["marks"].bitwiseAND(mask[-2]) > 0) & (s["marks"].bitwiseAND(mask[-1]) > 0) & entropic
        return F.struct((s["i"] + 1).alias("i"), s["counts"].alias("counts"), s["sum"].alias("sum"), s["marks"].alias("marks"), hit.alias("found"))

    def scanned(codes):
        def step(s, code):
            left = F.when(s["i"] >= WINDOW, changed(s, F.get(codes, s["i"] - WINDOW), -1, gone)).otherwise(s)
            return F.when(s["found"], s).otherwise(_let(left, lambda s: _let(changed(s, code, 1, came), judged)))

        return F.aggregate(codes, empty, step, lambda s: s["found"])

    letters = F.filter(F.split(F.regexp_replace(word, MASKED, " "), ""), lambda x: x != "")
    return _let(F.transform(letters, lambda x: (F.instr(F.lit(alphabet), x) - 1).cast("int")), scanned)


def entropy_spans(text: Column) -> Column:
    suppressed = lambda m: F.lit(False)
    for pattern in ALLOWED:
        suppressed = lambda m, p=pattern, f=suppressed: f(m) | m.rlike(p)
    keep = lambda m: F.when(suppressed(m), F.lit(False)).otherwise(has_random_window(m))
    return F.when(text.rlike(CANDIDATE_HINT), _located(text, CANDIDATE, keep, "entropy", len(BASE))).otherwise(_none())


def _fewer(ordered: Column, x: Column) -> Column:
    """How many values of a sorted array are below x, by halving."""
    steps = F.filter(F.array(*[F.lit(1 << b) for b in range(30, -1, -1)]), lambda b: b <= F.size(ordered))
    return F.aggregate(steps, F.lit(0), lambda n, b: F.when((n + b <= F.size(ordered)) & (F.get(ordered, n + b - 1) < x), n + b).otherwise(n))


def _apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of others: as many of others begin before a span's end as end before it begins."""
    both = F.struct(F.array_sort(F.transform(others, lambda x: x["start"])).alias("starts"), F.array_sort(F.transform(others, lambda x: x["past"])).alias("ends"))
    return F.when(F.size(spans) == 0, spans).otherwise(
        _let(both, lambda o: F.filter(spans, lambda x: _fewer(o["starts"], x["past"]) == _fewer(o["ends"], x["start"] + 1)))
    )


def secret_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with assign_spans, access_spans, hex_spans, base_spans (by start, then kind) and all_spans (with entropy spans): arrays of
    (start, rank, past, kind), in code points.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kinds = [f"{kind}_spans" for kind, *_ in BASE]
    found = docs.withColumns(dict(zip(kinds, base_spans(text), strict=True)) | {"_random": entropy_spans(text)})
    found = found.withColumn("base_spans", F.array_sort(F.concat(*kinds)))
    return found.withColumn("all_spans", F.array_sort(F.concat("base_spans", _apart(F.col("_random"), F.col("base_spans"))))).drop("_random")


def named(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["past"].cast("string"))), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    found = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(f"{kind}_spans").cast("long").alias(f"n_{kind}") for kind, *_ in BASE]
    return found.select("doc_id", *counts, F.sha2(named("base_spans").cast("binary"), 256).alias("base_sha256"), named("all_spans").alias("spans"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _spans_sql(kind: str, rank: int, pattern: str, keep: str) -> str:
    """Matches of one pattern with their positions: lengths of the pieces between matches and of the matches before, as `_located` has it."""
    p = _sql_text(pattern)
    at = "list_transform(range(1, len(ms) + 1), lambda i: {'m': ms[i], 's': list_sum(gl[1:i]) + coalesce(list_sum(ml[1:i - 1]), 0)})"
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, x.s::BIGINT AS s, (x.s + length(x.m))::BIGINT AS e FROM (SELECT doc_id, unnest({at}) AS x FROM (SELECT doc_id, ms, list_transform(regexp_split_to_array(t, {p}), lambda z: length(z)) AS gl,
        list_transform(ms, lambda z: length(z)) AS ml FROM (SELECT doc_id, t, regexp_extract_all(t, {p}) AS ms FROM d))) WHERE {keep}"""


def _entropy_sql(m: str) -> str:
    w = f"substring(regexp_replace({m}, {_sql_text(MASKED)}, ' ', 'g'), i, {WINDOW})"
    one = f"list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: -(({WINDOW} - length(replace(w, c, ''))) / {WINDOW}.0) * log2(({WINDOW} - length(replace(w, c, ''))) / {WINDOW}.0)))"
    limit = " ".join(f"WHEN length(translate(w, {_sql_text(ALPHABET[:size])}, '')) = 0 THEN {least}" for _, size, least in CLASSES)
    windows = f"list_transform(range(1, greatest(length({m}) - {WINDOW} + 2, 1)), lambda i: {w})"
    found = f"list_filter({windows}, lambda w: length(w) = {WINDOW} AND regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Za-z]') AND round({one}, 9) >= CASE {limit} ELSE 99 END)"
    allowed = " OR ".join(f"regexp_matches({m}, {_sql_text(p.replace('*+', '*'))})" for p in ALLOWED)
    return f"NOT ({allowed}) AND len({found}) > 0"


OP7_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({' UNION ALL '.join(_spans_sql(kind, rank, pattern, f"length(regexp_extract(x.m, {_sql_text(pattern)}, {group})) >= {least}") for rank, (kind, pattern, _, least, group) in enumerate(BASE))}),
more AS ({_spans_sql('entropy', len(BASE), CANDIDATE, _entropy_sql('x.m'))}),
every AS (SELECT * FROM base UNION ALL SELECT * FROM more WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = more.doc_id AND more.s < b.e AND b.s < more.e)),
bs AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM base GROUP BY doc_id),
es AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS spans FROM every GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(bs.spans, '')) AS base_sha256, coalesce(es.spans, '') AS spans
FROM d LEFT JOIN bs ON bs.doc_id = d.doc_id LEFT JOIN es ON es.doc_id = d.doc_id"""
