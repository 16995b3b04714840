"""Main text of web pages, with templates of their sites removed.

A page is read as a tree in one pass over its tags. Every block-level element gets a hash of its tag, class, id, text
and children; Spark counts with how many different main texts of a host each hash occurs, and subtrees that recur with
many of them are deleted there, unless they hold main content. So copies of a page count once. What stays is the
content of `article` elements (else of `main`, else of the body) without navigation, headers, footers, asides, forms, scripts, styles, adverts, notices and comments,
which tags, roles, classes and ids tell. Inside the main content recurring subtrees are deleted too, but for headings
and single items and rows, and only where at least half of the page's main text stays: edited copies of one article
share most of their text, which is no template.

Null and empty pages give an empty text; pages of any length are read whole. Pages without a host have no template. Rows stay one for one.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import begin, in_arrow, materialise, slices, table

#: A subtree is a template where it is with so many different main texts of a host, and with such a share of them.
LEAST_PAGES, LEAST_SHARE = 10, 0.3
#: Template hashes (8 bytes each) up to which they are broadcast; beyond, pages and templates meet by host, salted.
BROADCAST_HASHES, SALTS = 500_000, 32

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
DROPPED = frozenset("head nav aside footer form button select dialog menu option fieldset audio video map".split()) | RAW
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
_JUNK = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner\w*|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|nav|navbar|navigation|menus?|sidebars?|footers?|breadcrumbs?|comments?|commentlist|disqus|respond|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|promos?|promoted|sponsor\w*|pagination|pager|skip|toolbar|masthead)(?:$|[\s_-]|\d)",
    re.I,
)
#: Elements of the main content that aren't deleted by themselves: whole articles, headings, items of lists and tables.
_KEPT = frozenset("article main h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption figcaption".split())
_HEADER = re.compile(r"(?:^|[\s_-])(?:header|topbar)(?:$|[\s_-]|\d)", re.I)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class _Element:
    __slots__ = ("tag", "name", "drop", "main", "start", "parts")

    def __init__(self, tag, name, drop, main, start):
        self.tag, self.name, self.drop, self.main, self.start, self.parts = tag, name, drop, main, start, []


def parse(page: str | None, templates: frozenset[int] = frozenset()) -> tuple[list[str], set[int]]:
    """The blocks of the main text, and the hashes of the block-level subtrees that can be templates."""
    page = page or ""
    # (block, rank of the content that holds it: 2 article, 1 main, 0 other)
    blocks: list[tuple[str, int]] = []
    hashes: set[int] = set()
    # places in blocks of templates inside the main content
    inside: set[int] = set()
    stack = [_Element("", "", False, 0, 0)]
    text: list[str] = []

    def flush():
        if text:
            block = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if block:
                top = stack[-1]
                stack[_block(stack)].parts.append(block)
                if not top.drop:
                    blocks.append((block, top.main))

    def close(k: int):
        """Closes the element at k and all above it."""
        flush()
        while len(stack) > k:
            e = stack.pop()
            if e.tag in INLINE or not e.parts:
                continue
            h = xxhash.xxh3_64_intdigest("\x1f".join([e.tag, e.name, *e.parts]).encode("utf-8", "surrogatepass")) >> 1
            stack[_block(stack)].parts.append(f"{h:x}")
            if e.main:
                if e.tag not in _KEPT and stack[-1].main == e.main and not e.drop:
                    hashes.add(h)
                    if h in templates:
                        inside.update(range(e.start, len(blocks)))
            elif e.tag not in ("html", "body", "head") and not any(rank for _, rank in blocks[e.start :]):
                hashes.add(h)
                if h in templates:
                    del blocks[e.start :]

    at = 0
    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if k:
                if tag in INLINE:  # its text runs on
                    if k == len(stack) - 1 and not stack[k].drop:
                        stack.pop()
                    elif all(e.tag in INLINE for e in stack[k:]):
                        close(k) if any(e.drop for e in stack[k:]) else stack.__delitem__(slice(k, None))
                else:
                    close(k)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        attributes = m[3] if m[2] else m[6]
        name, role, hidden = "", "", False
        if attributes and not attributes.isspace():
            a = {x.lower(): p or q or r for x, p, q, r in _ATTRIBUTE.findall(attributes)}
            name = f"{a.get('class', '')} {a.get('id', '')}".strip()
            role, hidden = a.get("role", "").lower(), "hidden" in a
        if tag in RAW:
            flush()
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        top = stack[-1]
        if tag not in INLINE:
            flush()
            k = len(stack) - 1
            shut = _CLOSES.get(tag, ())
            while k > 0 and stack[k].tag in INLINE:
                k -= 1
            if k > 0 and stack[k].tag == "p":
                close(k)
            elif shut:
                while k > 0 and (stack[k].tag in INLINE or stack[k].tag in ("p",)):
                    k -= 1
                if k > 0 and stack[k].tag in shut:
                    close(k)
            elif k > 0 and stack[k].tag == "head" and tag != "head":
                close(k)
            top = stack[-1]
        main = top.main
        if tag == "article" or role == "article":
            main = 2
        elif tag == "main" or role == "main":
            main = max(main, 1)
        drop = top.drop or tag in DROPPED or role in _ROLES or hidden or (tag == "header" and not top.main)
        if not drop and name and tag not in ("html", "body", "main"):
            drop = bool(_JUNK.search(name) if tag != "article" else re.search(r"(?:^|[\s_-])comments?(?:$|[\s_-])", name, re.I)) or (not top.main and tag != "article" and bool(_HEADER.search(name)))
        if drop and not top.drop and tag in INLINE:
            flush()
        stack.append(_Element(tag, name, drop, main, len(blocks)))
    close(1)
    most = max((rank for _, rank in blocks), default=0)
    found = [(len(b), k in inside, b) for k, (b, rank) in enumerate(blocks) if rank >= most]
    if 2 * sum(n for n, gone, _ in found if gone) > sum(n for n, _, _ in found):
        return [b for _, _, b in found], hashes
    return [b for _, gone, b in found if not gone], hashes


def _block(stack: list[_Element]) -> int:
    k = len(stack) - 1
    while k > 0 and stack[k].tag in INLINE:
        k -= 1
    return k


def host(url: Column) -> Column:
    """The host of a URL in lower case; null where there is none."""
    h = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(h != "", h)


def templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host and hashes: the subtrees that recur with many different main texts of the host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("pages")
        for whole in batches:
            for batch in slices(whole, 1):
                contents, each = [], []
                for x in batch.column(1):
                    blocks, hashes = parse(x.as_py())
                    contents.append(xxhash.xxh3_64_intdigest("\n".join(blocks).encode("utf-8", "surrogatepass")) >> 1)
                    each.append(sorted(hashes))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.int64()), pa.array(each, pa.list_(pa.int64()))], names=["host", "content", "hashes"])

    rows = pages.select(host(pages[url_col]).alias("host"), pages[html_col]).where("host is not null").transform(in_arrow, run, "host string, content bigint, hashes array<bigint>")
    # hash 0 stands for the page itself
    counts = rows.select("host", "content", F.explode(F.concat(F.array(F.lit(0).cast("bigint")), "hashes")).alias("hash")).groupBy("host", "hash").agg(F.count_distinct("content").alias("n")).where(F.col("n") >= LEAST_PAGES)
    total = counts.where("hash = 0").select("host", F.col("n").alias("pages"))
    return counts.where("hash <> 0").join(total, "host").where(F.col("n") >= LEAST_SHARE * F.col("pages")).groupBy("host").agg(F.collect_set("hash").alias("hashes"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    known = materialise(templates(pages, id_col, url_col, html_col))
    size = known.agg(F.sum(F.size("hashes") + 1)).first()[0] or 0
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"), F.coalesce(host(pages[url_col]), F.lit("")).alias("host"))
    if size <= BROADCAST_HASHES:
        rows = rows.join(F.broadcast(known), "host", "left")
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
        rows = rows.join(known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("pages")
        for batch in (part for whole in batches for part in slices(whole, 2)):
            texts = ["\n".join(parse(page.as_py(), frozenset(found.as_py() or ()))[0]) for page, found in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)[id_col]
    return in_arrow(rows.select("page_id", "url", "html", "hashes"), run, f"page_id {kind}, url string, text string, n_chars bigint")


def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))
