"""HTML extraction with a site style tree.

1. Pages are parsed to elements. A branch is the chain of block elements (tag, classes and id without digits) from the body.
2. The pages of a host are merged branch by branch: how many pages have it, how often each style (the set of its
   children's signatures) and each content (a block's text) occurs. These are counts by key, pre-aggregated before
   they are shuffled, so a host with very many pages is no single task's work.
3. Entropy gives each branch an importance. Presentation: the entropy of its styles over its m pages, log base m. Content:
   1 less the mean of log_m of the pages that share a block's text: 0 if all pages say the same, 1 if none do. Pages that agree in
   all their texts are copies of one, and a text that only they have counts as shared by none. The composite weighs content `GAMMA`, presentation the rest.
4. From each page go the branches that name themselves as no content (tags such as nav, footer, aside, form; class or id
   words such as menu, sidebar, advert, cookie, comment; never by ids of headings and inline elements, and in article or main
   not by ids of sections and paragraphs, nor by ids that say other words too), and those whose importance is low for the host: under `LOW`, and
   under half of the host's best, on at least `LEAST_PAGES` pages, in article and main as elsewhere. The branch that holds most
   of the host's text never goes for low importance, and an article or main of which nothing else is left keeps its text.
   If a page has article or main elements, only text in them counts.
5. Character references are decoded, white space within a block becomes one space, and blocks are joined by one space.

Null and empty html give an empty text. Null urls are one host. Rows that repeat count as pages of their own.
Unclosed tags close where HTML closes them for paragraphs, list items and table cells, else with their parent.
"""

from __future__ import annotations

import functools
import hashlib
import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .common import saved, table

LOW, LEAST_PAGES, GAMMA = 0.3, 4, 0.9
#: Most branches and characters of hosts, together, that are broadcast; tasks that a host's pages are dealt to beyond.
BROADCAST_SIZE, SALTS = 1_000_000, 64

#: What begins markup, and the rest of a tag whose quotes are closed. A tag is looked for in TAG_CHARS characters; quotes that stay open end at the first >.
_OPEN = re.compile(r"<!--|<[!?]|<(/?)([A-Za-z][^\s/>]*)")
_REST = re.compile(r"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>""")
TAG_CHARS = 1 << 14
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][-A-Za-z0-9_:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
_SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("table",), "th": ("table",), "tr": ("table",), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
#: Tags, roles, and words of classes and ids of branches that aren't content.
_NOISE_TAGS = frozenset("head nav footer aside form script style noscript template iframe svg math button select textarea input dialog menu object embed audio video canvas title".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
_NOISE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertisements advertising adsense adslot banner banners sponsor sponsored sponsors promo promos promoted promotion
    sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs topbar toolbar masthead header footer footnav copyright colophon
    cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall
    share sharing social related recommended recommendations widget widgets comment comments disqus respond reply replies discussion
    search searchbox form pagination pager skip""".split()
)
#: Elements whose ids are names of places in a text.
_SLUGGED = _INLINE | frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTENT_TAGS = frozenset(("article", "main"))
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: str = "url") -> Column:
    """The host of a URL column, in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), _HOST, 1))


@functools.lru_cache(maxsize=65536)
def _element(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """An element's signature, whether it names itself as no content (header is judged where it stands), whether by more than its class or id, and the first as judged inside article or main."""
    names: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        names.setdefault(name.lower(), entities.unescape(a or b or c))
    marks = f"{names.get('class', '')} {names.get('id', '')}"
    sure = tag in _NOISE_TAGS or names.get("role", "").lower() in _NOISE_ROLES or "hidden" in names or names.get("aria-hidden", "").lower() == "true" or "display:none" in names.get("style", "").replace(" ", "").lower()
    noise = within = sure
    if tag not in ("html", "body", "article", "main"):
        classed, words = (any(w.lower() in _NOISE_WORDS for w in _WORD.findall(names.get(k, ""))) for k in ("class", "id"))
        noise = noise or classed or (words and tag not in _SLUGGED)
        # an id inside an article may be the slug of its heading: it must say nothing else, and not be on what holds a heading's text
        alone = words and all(w.lower() in _NOISE_WORDS for w in _WORD.findall(names.get("id", "")))
        within = within or classed or (alone and tag not in _SLUGGED and tag not in ("section", "p"))
    elif tag == "article":
        noise = noise or any(w.lower() in ("comment", "comments", "reply", "related", "ad", "sponsored") for w in _WORD.findall(marks))
        within = noise
    content = tag in _CONTENT_TAGS or names.get("role", "").lower() == "main"
    kept = ".".join(sorted({re.sub(r"[0-9]+", "", c) for c in marks.split()} - {""}))
    return f"{tag}{'.' if kept else ''}{kept}{'!' if content else ''}", noise, sure, within


def tokens(page: str):
    """Yields (start, end, closing, tag, attributes) of comments, declarations (tag empty) and tags, in time in proportion to the page. What no > ends is text."""
    at = 0
    while (found := _OPEN.search(page, at)) is not None:
        start, tag = found.start(), found[2]
        if found[0] == "<!--":
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, "", "", ""
            continue
        rest = _REST.match(page, found.end(), found.end() + TAG_CHARS) if tag else None
        at = rest.end() if rest else page.find(">", found.end()) + 1
        if not at:
            return
        yield start, at, found[1] or "", (tag or "").lower(), page[found.end() : at - 1]


@functools.lru_cache(maxsize=65536)
def branch_hash(branch: str) -> int:
    return int.from_bytes(hashlib.blake2b(branch.encode(), digest_size=8).digest(), "big", signed=True)


class _Node:
    """noise: it or what holds it names itself as no content; sure: by more than a class or id; inner: as noise, but from its outermost article or main inwards."""

    __slots__ = ("branch", "children", "content", "inner", "noise", "sure", "tag")

    def __init__(self, tag: str, branch: int, noise: bool, content: bool, sure: bool = False, inner: bool = False):
        self.tag, self.branch, self.noise, self.content, self.sure, self.inner, self.children = tag, branch, noise, content, sure, inner, set()


def blocks(page: str | None):
    """Yields (text, node) for each block of a page in order, and last (None, all block nodes)."""
    page = page or ""
    root = _Node("", 0, False, False)
    stack, inline = [root], []
    nodes, buffer = [root], []
    opened: Counter = Counter()
    at = 0

    def text() -> str:
        whole = " ".join(entities.unescape("".join(buffer)).split())
        buffer.clear()
        return whole

    def close(tags: tuple, scope: tuple = ()) -> None:
        """Closes the nearest open element of these tags, unless one of scope is nearer."""
        if not any(opened[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                opened.subtract(n.tag for n in stack[i:])
                del stack[i:]
                return
            if stack[i].tag in scope:
                return

    for start, end, closing, tag, attributes in tokens(page):
        if start < at:  # inside a script or the like
            continue
        buffer.append(page[at:start])
        at = end
        if not tag or (tag in _INLINE and not (attributes and _element(tag, attributes)[3 if stack[-1].content else 1])):
            if tag and closing and inline and inline[-1] == tag and stack[-1].tag == tag:
                if said := text():
                    yield said, stack[-1]
                inline.pop()
                opened[stack.pop().tag] -= 1
            continue
        if said := text():
            yield said, stack[-1]
        if closing:
            close((tag,))
            if tag in inline:
                inline.remove(tag)
            continue
        if tag in _RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in _VOID:
            continue
        if tag in _ENDS_P:
            close(("p",), ("article", "main", "section", "div", "td", "th", "li", "blockquote", "button", "object", "table"))
        if tag in _SIBLINGS:
            for sibling in reversed(_SIBLINGS[tag]):
                close((sibling,), _SCOPES[tag])
        signature, noise, sure, within = _element(tag, attributes)
        parent = stack[-1]
        noise = within if parent.content else noise
        content = parent.content or signature.endswith("!")
        if tag == "header" and not parent.content:
            noise = sure = True
        parent.children.add(signature)
        node = _Node(tag, branch_hash(f"{parent.branch}/{signature}"), parent.noise or noise, content, parent.sure or sure, content and (parent.inner if parent.content else False) or (content and noise))
        if not attributes.endswith("/"):
            stack.append(node)
            opened[tag] += 1
            if tag in _INLINE:
                inline.append(tag)
        nodes.append(node)
    buffer.append(page[at:])
    if said := text():
        yield said, stack[-1]
    yield None, nodes


def _features(batches):
    """For each page, one row for each branch that has text: its style, how much text it holds, and a row for each of its texts."""
    schema = pa.schema([("host", pa.string()), ("branch", pa.int64()), ("kind", pa.int8()), ("hash", pa.int64()), ("chars", pa.int64()), ("page", pa.int64())])
    for batch in (part for whole in batches for part in T.slices(whole, "html")):
        rows = []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            styles: dict[int, set] = {}
            texts: dict[int, set] = {}
            chars: dict[int, int] = {}
            for text, node in blocks(page):
                if text is None:
                    for n in node:
                        styles.setdefault(n.branch, set()).update(n.children)
                elif not node.noise:
                    texts.setdefault(node.branch, set()).add(text)
                    chars[node.branch] = chars.get(node.branch, 0) + len(text)
            whole = branch_hash("\n".join(sorted({x for said in texts.values() for x in said})))
            for key, said in texts.items():
                rows.append((host, key, 0, branch_hash(" ".join(sorted(styles[key]))), chars[key], whole))
                rows += [(host, key, 1, int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big", signed=True), 0, whole) for x in said]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, branch, pages, importance, chars) of each branch of each host that holds text and doesn't name itself as no content."""
    rows = pages.select(host_of().alias("host"), "html").mapInArrow(_features, "host string, branch long, kind byte, hash long, chars long, page long")
    counts = rows.groupBy("host", "branch", "kind", "hash").agg(F.count("*").alias("c"), F.sum("chars").alias("chars"), F.min("page").alias("page"), F.max("page").alias("last"))
    c = F.col("c").cast("double")
    style, said = F.when(F.col("kind") == 0, c), F.when(F.col("kind") == 1, F.when(F.col("page") == F.col("last"), 1.0).otherwise(c))
    nodes = counts.groupBy("host", "branch").agg(
        F.sum(style).alias("m"), F.sum(style * F.log(c)).alias("styles"), F.sum(said).alias("texts"), F.sum(said * F.log(said)).alias("shared"), F.sum("chars").alias("chars")
    )
    presentation = (F.log("m") - F.col("styles") / F.col("m")) / F.log("m")
    content = 1 - F.col("shared") / F.col("texts") / F.log("m")
    importance = F.when(F.col("m") > 1, (1 - GAMMA) * presentation + GAMMA * content).otherwise(1.0)
    return nodes.select("host", "branch", F.col("m").cast("long").alias("pages"), importance.alias("importance"), "chars")


def low_branches(pages: DataFrame) -> DataFrame:
    """(host, low): for hosts that have any, the hashes of their branches of low importance."""
    tree = style_tree(pages)
    hosts = tree.groupBy("host").agg(F.max("importance").alias("best"), F.max("chars").alias("most"))
    low = tree.join(hosts, "host").where((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LOW) & (F.col("importance") < F.col("best") / 2) & (F.col("chars") < F.col("most")))
    return low.groupBy("host").agg(F.sort_array(F.collect_set("branch")).alias("low"))


def main_text(page: str | None, low: set) -> str:
    """The text of the blocks that are content. If a class or id on what holds an article rules all of it out, only its own inner branches count."""
    found = [(text, node) for text, node in blocks(page) if text is not None and not node.sure]
    kept = [x for x in found if not x[1].noise] or [x for x in found if x[1].content and not x[1].inner]
    if any(node.content for _, node in kept):
        kept = [x for x in kept if x[1].content]
    high = [x for x in kept if x[1].branch not in low]
    if not high and kept and kept[0][1].content:
        high = kept
    return " ".join(text for text, _ in high)


def extracted(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) as (page_id, url, text)."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in (part for whole in batches for part in T.slices(whole, "html")):
            texts = [main_text(page, set(low or ())) for page, low in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    low = saved(low_branches(pages))
    rows = pages.select("page_id", "url", "html", host_of().alias("host"))
    size = low.agg(F.coalesce(F.sum(F.size("low") + F.length("host")), F.lit(0))).first()[0]
    if size <= BROADCAST_SIZE:  # pages stay where they are
        joined = rows.join(F.broadcast(low), "host", "left")
    else:  # hosts dealt to several tasks each
        low = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(low, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "low").mapInArrow(run, f"page_id {kind}, url string, text string")


def op4_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
