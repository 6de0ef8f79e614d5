"""Secrets and personal data taken out of texts, maps and rows; input checks that mark rows instead of failing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import resources as R


def redacted(c) -> Column:
    """A log message with keys, tokens, passwords and connection strings replaced."""
    out = F.col(c) if isinstance(c, str) else c
    for pattern, to in R.REDACTIONS:
        out = F.regexp_replace(out, "(?i)" + pattern, to)
    return out


def masked_values(m) -> Column:
    """A map whose values under secret keys keep four characters if they have more than eight, else none; other values are redacted."""
    secret = lambda k: F.regexp_replace(F.lower(k), "[- ]", "_").isin(*R.SECRET_KEYS)
    return F.transform_values(m, lambda k, v: F.when(secret(k), F.when(F.length(v) > 8, F.concat(F.substring(v, 1, 4), F.lit("[REDACTED]"))).otherwise("[REDACTED]")).otherwise(redacted(v)))


def masked_email(c: Column) -> Column:
    """ab***@domain; texts without @ stay."""
    return F.when(F.contains(c, F.lit("@")), F.concat(F.substring(F.substring_index(c, "@", 1), 1, 2), F.lit("***@"), F.split_part(c, F.lit("@"), F.lit(2)))).otherwise(c)


def scrubbed_error(c) -> Column:
    """An error message without internal paths; one with traces of internals is replaced, others are cut at 500."""
    message = F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"[A-Za-z]:\\[^\s]+", "[PATH]")
    inner = F.contains(message, F.lit("Traceback")) | F.contains(message, F.lit('File "')) | F.contains(message, F.lit("line ")) | F.contains(message, F.lit("ModuleNotFound"))
    return F.when(inner, "An internal error occurred. Please contact support.").otherwise(F.substring(message, 1, 500))


def sanitized(c, limit: int = 10000) -> Column:
    """Cut, without null characters and script protocols, HTML-escaped, trimmed."""
    out = F.replace(F.substring(F.col(c) if isinstance(c, str) else c, 1, limit), F.lit("\u0000"), F.lit(""))
    for protocol in ("javascript:", "vbscript:", "data:"):
        out = F.regexp_replace(out, "(?i)^" + protocol, "")
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return F.trim(out)


def checked(c, kind: str) -> Column:
    """struct(value, error): the cleaned value, or why it isn't one. kind: query, filename, email, username, api_key."""
    raw = F.col(c) if isinstance(c, str) else c
    missing = raw.isNull() | (raw == "")
    rules = {
        "query": (F.regexp_replace(F.trim(F.substring(raw, 1, 1000)), r"\s+", " "), r"^[a-zA-Z0-9\s\-.,()'\"!?]+$", "invalid characters"),
        "filename": (F.substring(F.replace(F.replace(F.replace(raw, F.lit("/"), F.lit("")), F.lit("\\"), F.lit("")), F.lit(".."), F.lit("")), 1, 255), r"^(?!(?i).*\.(?:exe|bat|cmd|sh|ps1|js|vbs)$)[a-zA-Z0-9._\-]+$", "not an allowed file name"),
        "email": (F.substring(F.lower(F.trim(raw)), 1, 254), r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", "invalid email format"),
        "username": (F.substring(F.trim(raw), 1, 50), r"^[a-zA-Z0-9_]+$", "letters, numbers and underscores only"),
        "api_key": (raw, r"^[a-zA-Z0-9+/=_-]{32,256}$", "not a key of 32-256 characters"),
    }
    value, pattern, why = rules[kind]
    ok = ~missing & value.rlike(pattern)
    return F.struct(F.when(ok, value).alias("value"), F.when(missing, "required").when(~ok, why).alias("error"))


def search_request_errors(query: Column, page: Column, page_size: Column) -> Column:
    """The list of what is wrong with a search request; empty if nothing is."""
    return F.filter(
        F.array(F.when(F.coalesce(F.length(F.trim(query)), F.lit(0)) == 0, "query is empty"), F.when(F.length(query) > 1000, "query is too long"), F.when(page < 1, "page is under 1"), F.when(~page_size.between(1, 50), "page_size is not in 1-50")), lambda x: x.isNotNull()
    )


def rate_limit_errors(per_minute: Column, burst: Column) -> Column:
    return F.filter(F.array(F.when(~per_minute.between(1, 1000), "requests_per_minute is not in 1-1000"), F.when(burst < 1, "burst is under 1"), F.when(burst > per_minute * 2, "burst is over twice the rate")), lambda x: x.isNotNull())
