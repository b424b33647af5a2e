"""Main text of web pages: site template removal and page structure.

Each page is parsed once.  Every block container's subtree is hashed from its tag, its
texts and its children; per host, Spark counts in how many different pages each hash
occurs, and subtrees that recur are deleted: from ``PAGES`` pages on outside the article,
from ``ARTICLE_PAGES`` within it, and paragraphs and headings outside an article from
``TEXT_PAGES``.  These are numbers of pages, whatever the size of the host.  Pages with
the same text count as one, so copies of an article do not make it a template;
paragraphs and headings of an article are never deleted for recurring.  What page
structure itself names as a menu, header, footer, sidebar, notice, advert, form, script,
style or reader comment is left out by its element, role, class or id.  A class or id
says so by its last word (as in ``site-sidebar`` or ``share-buttons``, not ``nav-open`` or
``has-sidebar``), and never on the page, its article or a paragraph or heading.

Text is taken from the article (or main) elements, or from the body if there is none.
A block ends where a block element starts or ends; white space in it becomes one
space; blocks are joined by an empty line in page order.

Tags are read as browsers do: a quote opens a value only after ``=``.  Where a value or
tag is open at the end of the page, the next ``>`` ends it, and without one the ``<`` is
text.  Reading is linear in the page, also for broken and deeply nested ones.

Defined results.  Null or empty html gives an empty text.  A null url is a host of
its own.  Very long pages are read whole.  Rows are independent: repeated pages and ids,
and null ids, are harmless (pages alike do not make each other templates); extra columns
are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simlake.llm.common import slices, table
from simlake.plans.staging import BROADCAST_ROWS, small, staged

#: Pages of a host in which a subtree recurs that is a template: outside an article, within one, and for paragraphs outside.
PAGES, ARTICLE_PAGES, TEXT_PAGES = 5, 20, 50

_TAG = regex.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+|(?=>)))?+)*+)>""")
_NAME = regex.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = regex.compile(r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?+""")
_RAW = {t: regex.compile(rf"</{t}\s*+>|\Z", regex.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "noembed", "xmp")}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_PAGE = set("html body article main".split())
_TEXTUAL = set("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
_OUT = set("nav footer aside form script style noscript iframe template head title svg canvas button select textarea input dialog object embed audio video menu math noembed xmp".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_PLAIN = set("html body main article p h1 h2 h3 h4 h5 h6 pre blockquote".split())
_OUT_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored banner promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar sidebars aside cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments disqus respond replies share sharing social related recommended footer masthead pagination pager toolbar skip widget widgets".split()
)
#: Words for a part or its place, which may follow the word that says what it is; words that turn its sense.
_SHELL_WORDS = set("area bar block box button buttons container content holder icon icons inner item items left link links list message panel posts right row section thread top unit wrap wrapper zone".split())
_TURN_WORDS = set("has with without no not is".split())
_OUT_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_WORDS = regex.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def _says_out(name: str, header: bool) -> bool:
    """Whether one class or id names something that is not content by its last word."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if _TURN_WORDS.intersection(words):
        return False
    while words and words[-1] in _SHELL_WORDS:
        words.pop()
    return bool(words) and (words[-1] in _OUT_WORDS or (header and words[-1] == "header"))


def _named_out(tag: str, raw: str, in_article: bool) -> bool:
    """Whether the element itself says that it is not content."""
    if tag in _OUT or (tag == "header" and not in_article):
        return True
    if not raw.strip() or tag in ("html", "body"):
        return False
    names = {}
    for m in _ATTRIBUTE.finditer(raw):
        names.setdefault(m[1].lower(), unescape((m[2] or "").strip("\"'")))
    if "hidden" in names or names.get("aria-hidden") == "true" or regex.search(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", names.get("style", "")):
        return True
    if tag in _PLAIN:
        return False
    if names.get("role", "").lower() in _OUT_ROLES:
        return True
    return any(_says_out(name, not in_article) for name in f"{names.get('class', '')} {names.get('id', '')}".split())


def tags(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """``start, end, slash, name, attributes`` of comments (name "") and tags, in order; send a position to go on from there."""
    at, last, broken = 0, html.rfind(">"), False
    while 0 <= (start := html.find("<", at)):
        at = start + 1
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            found = (start, end + 3 if end >= 0 else len(html), "", "", "")
        elif start > last:
            return
        elif html[at : at + 1] in ("!", "?"):
            found = (start, html.find(">", start) + 1, "", "", "")
        else:
            name = _NAME.match(html, at)
            if not name:
                continue
            m = None if broken else _TAG.match(html, start)
            # a value or tag that is open at the end of the page: from here on the next > ends a tag
            broken = broken or not m
            end = m.end() if m else html.find(">", start) + 1
            found = (start, end, name[1], name[2].lower(), m[3] if m else html[name.end() : end - 1])
        at = (yield found) or found[1]


class _Node:
    __slots__ = ("article", "counted", "first", "hash", "out", "tag")

    def __init__(self, tag: str, first: int, counted: bool, out: bool, article: bool) -> None:
        self.tag, self.first, self.counted, self.out, self.article = tag, first, counted, out, article
        self.hash = xxhash.xxh64(tag)


def parse(html: str) -> tuple[list[tuple[str, bool]], list[tuple[int, str, int, int]]]:
    """Blocks (text, whether in an article), and the subtrees that hold some: hash, kind, first block, block after the last."""
    stack = [_Node("", 0, False, False, False)]
    open_tags: Counter = Counter()
    subtrees: list[tuple[int, str, int, int]] = []
    blocks: list[tuple[str, bool]] = []
    pieces: list[str] = []
    at = 0

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            blocks.append((text, stack[-1].article))

    def close(upto: int) -> None:
        while len(stack) > upto:
            node = stack[-1]
            if node.tag in _BLOCK:
                flush()
            stack.pop()
            open_tags[node.tag] -= 1
            digest = node.hash.intdigest()
            stack[-1].hash.update(digest.to_bytes(8, "little"))
            if node.counted and node.first < len(blocks):
                kind = "inside" if stack[-1].article else "text" if node.tag in _TEXTUAL else "outside"
                if kind != "inside" or node.tag not in _TEXTUAL:
                    subtrees.append((digest - (1 << 64) if digest >> 63 else digest, kind, node.first, len(blocks)))

    def text(raw: str) -> None:
        if raw:
            top = stack[-1]
            said = unescape(raw)
            top.hash.update(" ".join(said.split()).encode("utf-8", "surrogatepass"))
            if not top.out:
                pieces.append(said)

    found = tags(html)
    go_on = None
    while True:
        try:
            start, end, slash, tag, raw = found.send(go_on)
        except StopIteration:
            break
        go_on = None
        text(html[at:start])
        at = end
        if not tag:
            continue
        if slash:
            if open_tags[tag]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            elif tag in _BLOCK:
                flush()
            continue
        if tag in _BLOCK:
            # a block ends an open paragraph; items end items of their kind in the same list or table
            closes = {"p"} | _CLOSED_BY.get(tag, set())
            if any(open_tags[c] for c in closes):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in closes:
                        close(i)
                        break
                    if stack[i].tag in _BLOCK:
                        break
            flush()
        top = stack[-1]
        if tag == "br" and not top.out:
            pieces.append(" ")
        if tag in _VOID:
            continue
        out = top.out or _named_out(tag, raw, top.article)
        article = top.article or (tag in ("article", "main") and not out)
        stack.append(_Node(tag, len(blocks), tag in _BLOCK and tag not in _PAGE and not out, out, article))
        open_tags[tag] += 1
        if tag in _RAW:
            m = _RAW[tag].search(html, at)
            if tag in ("textarea", "title"):
                text(html[at : m.start()])
            at = go_on = m.end()
            close(len(stack) - 1)
    text(html[at:])
    flush()
    close(1)
    return blocks, subtrees


_PARSED = "key string, page_id {id}, url string, host string, digest bigint, nodes array<struct<hash: bigint, kind: string, first: int, last: int>>, blocks array<string>"


def _host(url: str | None) -> str:
    m = regex.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, n = TaskContext.get().partitionId(), 0
    node = pa.list_(pa.struct([("hash", pa.int64()), ("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))
    for batch in slices(batches):
        urls, keys, digests, nodes, blocks = batch.column(1).to_pylist(), [], [], [], []
        for html in batch.column(2).to_pylist():
            found, subtrees = parse(html or "")
            keep = [inside for _, inside in found]
            if any(keep):
                # what lies outside the article is left out; the rest is numbered anew
                number = [0, *accumulate(map(int, keep))]
                subtrees = [(h, kind, number[a], number[b]) for h, kind, a, b in subtrees if number[a] < number[b]]
                found = [b for b in found if b[1]]
            keys.append(f"{task}-{n}")
            n += 1
            digests.append(xxhash.xxh64_intdigest("\n".join(t for t, _ in found).encode("utf-8", "surrogatepass")) >> 1)
            nodes.append([{"hash": h, "kind": k, "first": a, "last": b} for h, k, a, b in subtrees])
            blocks.append([t for t, _ in found])
        columns = [pa.array(keys, pa.string()), batch.column(0), pa.array(urls, pa.string()), pa.array(map(_host, urls), pa.string()), pa.array(digests, pa.int64()), pa.array(nodes, node), pa.array(blocks, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "page_id", "url", "host", "digest", "nodes", "blocks"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` from ``page_id, url, html``: one row for each page."""
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    parsed = staged(rows.mapInArrow(_parsed, _PARSED.format(id=dict(pages.dtypes)["page_id"])), "pages")
    seen = parsed.select("key", "host", "digest", F.explode("nodes").alias("n")).select("key", "host", "digest", "n.*")
    least = F.when(F.col("kind") == "inside", ARTICLE_PAGES).when(F.col("kind") == "text", TEXT_PAGES).otherwise(PAGES)
    counts = seen.groupBy("host", "hash", "kind", "digest").count().groupBy("host", "hash", "kind").agg(F.count("*").alias("c")).where(F.col("c") >= least)
    templates = staged(counts.select("host", "hash", "kind"), "templates")
    drops = staged(seen.join(small(templates), ["host", "hash", "kind"]).select("key", "first", "last"), "drops")
    cuts = drops.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("drop"))
    # a broadcast holds at most the rows that ``small`` allows, in arrays
    fits = drops.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    kept = parsed.select("key", "page_id", "url", "blocks").join(F.broadcast(cuts) if fits else cuts, "key", "left")
    cut = lambda i: F.exists("drop", lambda d: (d["first"] <= i) & (i < d["last"]))
    blocks = F.when(F.col("drop").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda b, i: ~cut(i)))
    return kept.select("page_id", "url", F.array_join(blocks, "\n\n").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages: ``page_id, url, text, n_chars``."""
    return extract(table(spark, sf_dir, "pages"))
