"""Main text of web pages, with the template of each site removed.

1. A page is read as a tree, tolerantly, in time linear in its length.
2. Every block element's subtree is hashed, menus and footers as well.  Hashes
   are counted per host in Spark, over pages of different content, and subtrees
   that stand on many of a host's pages are the site's, not the page's: they are
   deleted.  In an article, one block of text alone is never deleted for that; nor
   is a text that would be gone as a whole.
3. Of what remains, parts that say by tag, role, class or id that they are no
   article (menus, adverts, comments ...) are left out, as hosts of few pages,
   and parts that differ from page to page, give counts no hold.
4. Blocks of what then remains are the text.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import materialise

#: A subtree is a site's template if it stands on so many of a host's pages, and on such a share of them.
MANY, SHARE = 10, 0.05
#: Templates up to which their keys (8 bytes each) go to every executor; beyond it, pages are joined with them.
BROADCAST = 1_000_000

# Elements of HTML by what they do to text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li listing main menu nav ol p plaintext pre search section summary table caption tbody td tfoot th thead title tr ul option select optgroup".split())
_NEVER = frozenset("aside audio button canvas datalist dialog embed footer form frame frameset head iframe input label map math menu nav noembed noframes noscript object optgroup option script search select style svg template textarea title video".split())
_WHOLE = frozenset("html body main article".split())
#: An opening element closes an open one of these, unless one of the second set stands between.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, set()),
}
_P_SCOPE = frozenset("table td th caption button object html template".split())
#: Parts of class names and ids, and roles, of what isn't the article.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs byline captcha comment comments cookie cookies consent copyright disclaimer disqus footer footers gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup privacy promo promotion promoted recommended related reply replies respond share sharing sidebar sidebars sidenav signin signup skip skyscraper social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search searchbox tablist toolbar tooltip".split())
#: With these parts, "header" is the head of the article.
_OWN = frozenset("article content entry main post story title".split())

_TOKEN = re.compile(r"<!--.*?(?:--!?>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HOST = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)")


def host_of(url: str | None) -> str:
    """The host of a URL, in lower case; empty if there is none."""
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _unwanted(tag: str, attributes: str, inside: bool) -> bool:
    if tag in _NEVER:
        return True
    if tag == "header":
        return not inside
    if not attributes or tag in ("html", "body"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.strip().lower() in _ROLES:
            return True
        if name in ("class", "id") and tag not in ("article", "main"):
            for word in value.split():
                parts = {x.lower() for x in _PARTS.findall(word)}
                found = parts & _NAMES
                if found and not (found <= {"header", "byline"} and parts & _OWN):
                    return True
        if name in ("class", "id") and tag == "article" and {x.lower() for x in _PARTS.findall(value)} & {"comment", "comments", "reply", "related", "promo", "teaser", "ad", "sponsored"}:
            return True
    return False


class Page:
    """The elements of a page, with the hash of each one's subtree, and its blocks of text.

    A block is (pieces, tag, place, element); a piece is (element, whether in a link, text)."""

    def __init__(self, source: str):
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.unwanted: list[bool] = []
        self.places: list[int] = []  # 1: in an article, 2: in main
        self.hashes: list[int] = []
        self.blocks: list[tuple[list[tuple[int, bool, str]], str, int, int]] = []
        # open elements, what is hashed of each, and where in the stack elements of each tag, blocks, and paragraphs or their walls are
        self.stack: list[int] = []
        self.parts: list[list[str]] = []
        self.at: dict[str, list[int]] = {}
        self.block_at: list[int] = []
        self.scope_at: list[int] = []
        self.buffer: list[tuple[int, bool, str]] = []
        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() < at:
                continue  # inside a raw element
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                self._close(tag)
                continue
            self._open(tag, m[3])
            if tag in _RAW:
                raw = re.compile(rf"</{tag}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(source, at)
                at = raw.end() if raw else len(source)
                self._close(tag)
        if at < len(source):
            self._text(source[at:])
        self._pop(0)
        self._flush("")
        held = [0] * len(self.tags)
        for _, _, _, e in self.blocks:
            if e >= 0:
                held[e] += 1
        for e in range(len(held) - 1, -1, -1):
            if self.parents[e] >= 0:
                held[self.parents[e]] += held[e]
        #: Elements that templates may be: blocks with text, but in an article those that hold one block alone.
        self.parted = [e for e, h in enumerate(self.hashes) if h and self.tags[e] in _BLOCK and self.tags[e] not in _WHOLE and (held[e] > 1 or not self.places[e])]

    def _text(self, text: str) -> None:
        if "&" in text:
            text = html.unescape(text)
        self.buffer.append((self.stack[-1] if self.stack else -1, bool(self.at.get("a")), text))
        if self.stack and not text.isspace():
            self.parts[-1].append(" ".join(text.split()))

    def _place(self) -> int:
        return bool(self.at.get("article")) | bool(self.at.get("main")) << 1

    def _flush(self, tag: str) -> None:
        if self.buffer:
            if any(not t.isspace() for _, _, t in self.buffer):
                inner = self.tags[self.stack[self.block_at[-1]]] if self.block_at else tag
                self.blocks.append((self.buffer, inner, self._place(), self.stack[-1] if self.stack else -1))
            self.buffer = []

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.buffer.append((self.stack[-1] if self.stack else -1, False, " "))
            return
        if tag in _BLOCK:
            self._flush(tag)
            # a block closes the paragraph around it
            if self.scope_at and self.tags[self.stack[self.scope_at[-1]]] == "p":
                self._pop(self.scope_at[-1])
        if tag in _CLOSES:
            wanted, walls = _CLOSES[tag]
            while True:
                i = max((self.at[t][-1] for t in wanted if self.at.get(t)), default=-1)
                if i < 0 or i < max((self.at[t][-1] for t in walls if self.at.get(t)), default=-1):
                    break
                self._pop(i)
                if tag != "tr":
                    break
        if tag in _VOID:
            return
        place, i = self._place(), len(self.stack)
        self.parents.append(self.stack[-1] if self.stack else -1)
        self.stack.append(len(self.tags))
        self.parts.append([])
        self.tags.append(tag)
        self.places.append(place)
        self.unwanted.append(_unwanted(tag, attributes, place > 0))
        self.hashes.append(0)
        self.at.setdefault(tag, []).append(i)
        if tag in _BLOCK:
            self.block_at.append(i)
        if tag == "p" or tag in _P_SCOPE:
            self.scope_at.append(i)

    def _close(self, tag: str) -> None:
        if not self.at.get(tag):
            return
        i = self.at[tag][-1]
        if tag not in _BLOCK and self.block_at and self.block_at[-1] > i:
            return  # an inline end tag doesn't close blocks
        self._pop(i)

    def _pop(self, size: int) -> None:
        """Close the innermost elements until `size` are open."""
        while len(self.stack) > size:
            tag = self.tags[self.stack[-1]]
            if tag in _BLOCK:
                self._flush(tag)
            e, parts, i = self.stack.pop(), self.parts.pop(), len(self.stack)
            self.at[tag].pop()
            for places in (self.block_at, self.scope_at):
                if places and places[-1] == i:
                    places.pop()
            if parts:
                key = self.hashes[e] = xxhash.xxh3_64_intdigest("\x1f".join([tag, *parts]))
                if self.stack:
                    self.parts[-1].append(f"\x1e{key:x}")

    def digest(self) -> int:
        """A hash of all that the page holds."""
        return xxhash.xxh3_64_intdigest("\x1f".join(f"{h:x}" for e, h in enumerate(self.hashes) if self.parents[e] < 0)) >> 1

    def main(self, templates=()) -> list[str]:
        """The blocks of the article, without elements of which `templates` has the hashes: inside article elements,
        if there are any, else inside main, else all that aren't menus."""
        gone, ours = list(self.unwanted), [False] * len(self.tags)
        for e in self.parted:
            ours[e] = self.hashes[e] in templates
        for e, parent in enumerate(self.parents):
            if parent >= 0:
                gone[e] |= gone[parent]
                ours[e] |= ours[parent]
        blocks = []
        for pieces, tag, place, _ in self.blocks:
            kept = [p for p in pieces if p[0] < 0 or not gone[p[0]]]
            text = " ".join("".join(t for _, _, t in kept).split())
            if text:
                linked, total = (sum(len(t.strip()) for _, a, t in kept if a or every) for every in (False, True))
                left = text if not any(ours[p[0]] for p in kept if p[0] >= 0) else " ".join("".join(p[2] for p in kept if p[0] < 0 or not ours[p[0]]).split())
                blocks.append((text, tag, place, linked >= 0.8 * total, left))
        got = [b for b in blocks if b[2] & 1]
        if got and not any(b[1] == "h1" for b in got):
            got = [b for b in blocks if b[2] & 1 or (b[2] & 2 and b[1] == "h1")]
        got = got or [b for b in blocks if b[2] & 2] or [b for b in blocks if not (b[3] and b[1] in ("li", "ul", "ol", "td", "div", "span"))]
        return [b[4] for b in got if b[4]] or [b[0] for b in got]


def _key(host: str, subtree: int) -> int:
    """A host and a subtree as one signed 64-bit number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(host, seed=subtree)).view(np.int64))


def _subtrees(pages: DataFrame) -> DataFrame:
    """(host, key, page) of each page's distinct subtrees; key 0 for the page itself; host and page are hashes."""

    def run(batches):
        for batch in batches:
            hosts, keys, digests = [], [], []
            for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host, page = host_of(url), Page(source or "")
                mine = {0} | {_key(host, page.hashes[e]) for e in page.parted}
                hosts += [_key(host, 0)] * len(mine)
                keys += mine
                digests += [page.digest()] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (hosts, keys, digests)], names=["host", "key", "page"])

    return pages.mapInArrow(run, "host bigint, key bigint, page bigint")


def templates(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", scratch: list[str] | None = None) -> DataFrame:
    """(host, key) of the subtrees that stand on at least MANY of a host's pages, and on SHARE of them.

    Pages of the same content count as one page, whatever their URLs."""
    rows = pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    counts = _subtrees(rows).distinct().groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= MANY)
    counts = materialise(counts, keep=scratch)
    totals = counts.where("key = 0").select("host", F.col("n").alias("pages"))
    return counts.where("key <> 0").join(totals, "host").where(F.col("n") >= SHARE * F.col("pages")).select("host", "key")


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", scratch: list[str] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page, and its code points.

    Blocks stand in the page's order, joined by line feeds; character references
    are decoded; white space inside a block is one space.  A page without main
    text, or a null or empty one, has the empty text.  Pages without a host share
    the empty host.  Repeated rows are pages of their own; other columns are ignored.
    """
    spark = pages.sparkSession
    scratch = [] if scratch is None else scratch
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    found = materialise(templates(pages, url_col=url_col, html_col=html_col, scratch=scratch), keep=scratch)
    id_type = pages.schema[id_col].dataType.simpleString()
    if found.limit(BROADCAST + 1).count() <= BROADCAST:
        known = spark.sparkContext.broadcast(np.unique(np.array([r.key for r in found.select("key").toLocalIterator()], np.int64)))
        work = rows
    else:
        known = None
        per_host = found.groupBy("host").agg(F.collect_set("key").alias("keys"))
        work = _with_host(rows).join(per_host, "host", "left").select("id", "url", "html", "keys")

    def run(batches):
        everywhere = set(known.value.tolist()) if known else set()
        for batch in batches:
            texts = []
            own = batch.column(3).to_pylist() if known is None else [None] * batch.num_rows
            for url, source, keys in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), own, strict=True):
                host, page = host_of(url), Page(source or "")
                template = everywhere if keys is None else set(keys)
                there = {page.hashes[e] for e in page.parted if _key(host, page.hashes[e]) in template} if template else ()
                texts.append("\n".join(page.main(there)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    out = work.mapInArrow(run, f"id {id_type}, url string, text string, n_chars bigint")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def _with_host(rows: DataFrame) -> DataFrame:
    """`rows` (id, url, html) with `host`, the hash that _subtrees() gives to the URL's host."""

    def run(batches):
        for batch in batches:
            hosts = [_key(host_of(u), 0) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hosts, pa.int64())], names=[*batch.schema.names, "host"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, schema + ", host bigint")
