"""Boolean search over documents, by their texts or by a stored index.

Words, "phrases", prefix*, field:value, [value] and (2023) or (2020-2023) as filters; AND is implied, OR is also |, NOT is also a
leading -, brackets group. NOT binds closest, then OR, then AND: `section 302 | 303` asks for section and one of the numbers.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .segments import Index

_PART = re.compile(r'"(?P<phrase>[^"]*)"|\[(?P<bracket>[^\]]*)\]|\((?P<years>\d{4}(?:-\d{4})?)\)|(?P<sign>[()|])|(?P<minus>-)(?=[^\s-])|(?P<word>[^\s()|"\[\]]+)')

#: The fields that [value] and (year) filter by, by default.
FIELDS = {"bracket": "act", "years": "year"}


def parsed(expression: str) -> tuple:
    """The expression as a tree of ("and" | "or", trees), ("not", tree), ("word" | "prefix" | "phrase" | "bracket" | "years", text), ("field", name, value).

    What is missing is left out: an operator without operand, a bracket that doesn't close or open. An empty expression is ("and", []).
    """
    parts = [(m.lastgroup, m[m.lastgroup]) for m in _PART.finditer(expression)]
    at = 0

    def operand() -> tuple | None:
        nonlocal at
        while at < len(parts):
            kind, text = parts[at]
            if (kind, text) == ("sign", ")"):
                return None
            at += 1
            if kind == "minus" or (kind, text) == ("word", "NOT"):
                inner = operand()
                return inner and ("not", inner)
            if (kind, text) == ("sign", "("):
                inner = conjunction()
                at += at < len(parts)  # its closing bracket
                return inner
            if (kind, text) in (("sign", "|"), ("word", "OR"), ("word", "AND")):
                continue
            if kind == "word" and (m := re.fullmatch(r"([A-Za-z_]\w*):(\S+)", text)):
                return ("field", m[1], m[2].lower())
            if kind == "word" and len(text) > 1 and text.endswith("*"):
                return ("prefix", text.rstrip("*").lower())
            return (kind, " ".join(text.lower().split()))
        return None

    def conjunction() -> tuple:
        nonlocal at
        found: list[list[tuple]] = []
        while at < len(parts) and parts[at] != ("sign", ")"):
            either = False
            while at < len(parts) and parts[at] in (("sign", "|"), ("word", "OR"), ("word", "AND")):
                either |= parts[at][1] != "AND"
                at += 1
            if (one := operand()) is not None:
                if either and found:
                    found[-1].append(one)
                else:
                    found.append([one])
        return ("and", [x[0] if len(x) == 1 else ("or", x) for x in found])

    trees = []
    while at < len(parts):
        trees.append(conjunction())
        at += at < len(parts)  # a bracket that nothing opened
    return trees[0] if len(trees) == 1 else ("and", trees)


def leaves(tree: tuple) -> list[tuple]:
    if tree[0] in ("and", "or"):
        return [leaf for x in tree[1] for leaf in leaves(x)]
    return leaves(tree[1]) if tree[0] == "not" else [tree]


def _tested(tree: tuple, test: Callable[[tuple], Column]) -> Column:
    """The condition of a tree from those of its leaves; null counts as false."""
    if tree[0] == "and":
        return reduce(lambda a, b: a & b, [_tested(x, test) for x in tree[1]], F.lit(True))
    if tree[0] == "or":
        return reduce(lambda a, b: a | b, [_tested(x, test) for x in tree[1]])
    return ~_tested(tree[1], test) if tree[0] == "not" else F.coalesce(test(tree), F.lit(False))


def _filter(leaf: tuple, fields: dict[str, str]) -> Column:
    """The condition of a leaf on a field."""
    if leaf[0] == "years":
        low, high = leaf[1].split("-") if "-" in leaf[1] else (leaf[1], leaf[1])
        return F.col(fields["years"]).between(int(low), int(high))
    name, value = (fields["bracket"], leaf[1]) if leaf[0] == "bracket" else leaf[1:]
    return F.lower(F.col(name).cast("string")) == value


def condition(expression: str, text_col: str, fields: dict[str, str] | None = None) -> Column:
    """The filter of an expression on a text column; a phrase is any stretch of the text, white space collapsed."""

    def test(leaf: tuple) -> Column:
        kind, value = leaf[0], leaf[-1]
        if kind == "phrase":
            return F.contains(F.lower(T.collapse(text_col)), F.lit(value))
        if kind == "prefix":
            return F.exists(T.tokens(text_col), lambda t: F.startswith(t, F.lit(value)))
        return F.array_contains(T.tokens(text_col), value) if kind == "word" else _filter(leaf, FIELDS | (fields or {}))

    return _tested(parsed(expression), test)


def search(docs: DataFrame, expression: str, text_col: str = "text", fields: dict[str, str] | None = None) -> DataFrame:
    return docs.where(condition(expression, text_col, fields))


def _tokens(value: str) -> tuple[str, ...]:
    return tuple(re.findall("[a-z0-9]+", value))


def _after(prefix: str) -> str:
    """The first text past all that begin with it."""
    return prefix[:-1] + chr(ord(prefix[-1]) + 1)


def _moved(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda x: x - by)


def matches(index: Index, expressions: dict[int, str], fields: dict[str, str] | None = None) -> DataFrame:
    """(query_id, doc_id) of the living documents of an index that each expression asks for; texts aren't read.

    A phrase, or a word of several tokens, is those tokens at successive positions. All expressions share one reading of the blocks of their
    terms (a filter on the sorted terms, ranges for prefixes), and one aggregation by document, which holds a flag for each word or
    prefix and the positions of each phrase's words. Expressions come from the caller: they are few and small.
    """
    trees = {q: parsed(x) for q, x in expressions.items()}
    found = [leaf for tree in trees.values() for leaf in leaves(tree)]
    prefixes = sorted({_tokens(leaf[1])[-1] for leaf in found if leaf[0] == "prefix" and _tokens(leaf[1])})
    phrases = sorted({_tokens(leaf[1]) for leaf in found if leaf[0] in ("word", "phrase") and _tokens(leaf[1])})
    words = sorted({w for p in phrases for w in p})
    single = {p[0] for p in phrases if len(p) == 1}
    placed = sorted({w for p in phrases if len(p) > 1 for w in p})

    asked = reduce(lambda a, b: a | b, [F.col("term").isin(words), *[(F.col("term") >= p) & (F.col("term") < _after(p)) for p in prefixes]])
    postings = index.postings_where(asked, positions=bool(placed))
    flags = [F.bool_or(F.col("term") == w).alias(f"word_{w}") for w in sorted(single)] + [F.bool_or(F.startswith("term", F.lit(p))).alias(f"prefix_{p}") for p in prefixes]
    held = [F.first(F.when(F.col("term") == w, F.col("positions")), ignorenulls=True).alias(f"at_{w}") for w in placed]
    by_doc = postings.groupBy("segment", "doc_id").agg(F.count("*").alias("_n"), *flags, *held)
    docs = index.documents().join(by_doc, ["segment", "doc_id"], "left")

    def test(leaf: tuple) -> Column:
        if leaf[0] not in ("word", "phrase", "prefix"):
            return _filter(leaf, FIELDS | (fields or {}))
        tokens = _tokens(leaf[-1])
        if not tokens:
            return F.lit(False)
        if leaf[0] == "prefix":
            return F.col(f"prefix_{tokens[-1]}")
        if len(tokens) == 1:
            return F.col(f"word_{tokens[0]}")
        begins = [_moved(F.col(f"at_{w}"), i) for i, w in enumerate(tokens)]
        return F.size(reduce(F.array_intersect, begins)) > 0

    hit = [F.when(_tested(tree, test), F.lit(q)) for q, tree in trees.items()]
    return docs.select("doc_id", F.explode(F.array_compact(F.array(*hit))).alias("query_id")).select("query_id", "doc_id")
