"""Column functions on text: tokens, hashes, snippets, keywords, sentences, tags, scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import resources as R

# White space of collapse() and strip(): one class for both engines.
BLANKS = r"[ \t\n\x0B\f\r]+"


def text_of(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def tokens(c) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text; null gives none."""
    return F.regexp_extract_all(F.lower(text_of(c)), F.lit("[a-z0-9]+"), F.lit(0))


def words(c) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text_of(c), BLANKS), lambda x: x != "")


def collapse(c) -> Column:
    """White space runs as one space, none at the ends."""
    return F.array_join(words(c), " ")


def concept_terms(c) -> Column:
    """Distinct tokens of four letters or more that aren't stop words, in order."""
    stop = F.array(*[F.lit(x) for x in R.CONCEPT_STOP_WORDS])
    return F.array_distinct(F.filter(tokens(c), lambda x: (F.length(x) >= 4) & ~F.array_contains(stop, x)))


def snippet(c, limit: int = 280) -> Column:
    clean = collapse(c)
    return F.when(F.length(clean) <= limit, clean).otherwise(F.concat(F.rtrim(F.substring(clean, 1, limit - 3)), F.lit("...")))


def normalized_prefix(c, limit: int = 300) -> Column:
    """The text that duplicates share: white space collapsed, lower case, cut."""
    return F.substring(F.lower(collapse(c)), 1, limit)


def page_hash(file, page) -> Column:
    return F.md5(F.concat_ws("_", file, page))


def content_hash(c) -> Column:
    return F.substring(F.sha2(F.trim(text_of(c)), 256), 1, 16)


def cache_key(c) -> Column:
    return F.substring(F.sha2(F.lower(F.trim(text_of(c))), 256), 1, 32)


def keywords(c) -> Column:
    """Words of letters, three or more, lower case, without stop words; repeats stay."""
    stop = F.array(*[F.lit(x) for x in R.KEYWORD_STOP_WORDS])
    return F.filter(F.regexp_extract_all(F.lower(text_of(c)), F.lit("[a-zA-Z]+"), F.lit(0)), lambda x: (F.length(x) > 2) & ~F.array_contains(stop, x))


def sentences(c, over: int = 5) -> Column:
    """Pieces after . ! ? and white space, trimmed, longer than `over` characters."""
    return F.filter(F.transform(F.split(text_of(c), r"(?<=[.!?])[ \t\n\x0B\f\r]+"), F.trim), lambda x: F.length(x) > over)


def strip_tags(c) -> Column:
    return F.regexp_replace(text_of(c), "<[^>]+>", "")


def contains_any(c, terms) -> Column:
    """Whether a text contains any of the literal terms."""
    alternatives = "|".join(_quoted(t) for t in terms)
    return text_of(c).rlike(alternatives)


def _quoted(term: str) -> str:
    return "".join("\\" + x if x in r"\.[]{}()*+?^$|" else x for x in term)


def script_language(c) -> Column:
    """hindi if more than half of the letters are Devanagari, mixed if more than a tenth, else english."""
    hindi = F.length(F.regexp_replace(text_of(c), "[^\\u0900-\\u097F]", "")).cast("double")
    other = F.length(F.regexp_replace(F.regexp_replace(text_of(c), "[\\u0900-\\u097F]", ""), "[^\\p{L}]", ""))
    share = hindi / F.nullif(hindi + other, F.lit(0.0))
    return F.when(share > 0.5, "hindi").when(share > 0.1, "mixed").otherwise("english")


def parse_date(c) -> Column:
    """The first of four date formats that fits the whole text."""
    value = F.col(c) if isinstance(c, str) else c
    shapes = (("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "y-M-d"), ("^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "d-M-y"), ("^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "y/M/d"), ("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/y"))
    return F.coalesce(*[F.when(value.rlike(shape), F.to_date(F.try_to_timestamp(value, F.lit(form)))) for shape, form in shapes])


def clamp(c, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def sigmoid(c) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def display_score(c) -> Column:
    """At or below 0: 0; to 1: itself; above: a percentage, at most 1."""
    return F.when(c <= 0, 0.0).when(c <= 1, c).otherwise(F.least(c / 100.0, F.lit(1.0)))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a, b, epsilon: float = 0.0) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(epsilon))


def capped_words(c, limit: int) -> Column:
    """The first words of a text, with ... if there were more."""
    w = words(c)
    return F.when(F.size(w) > limit, F.concat(F.regexp_replace(F.array_join(F.slice(w, 1, limit), " "), "[,;:]+$", ""), F.lit("..."))).otherwise(c)
