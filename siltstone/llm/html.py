"""Main text of web pages: site templates, subtrees that recur on a host, are removed before the main element is read.

Pages are parsed twice, each time narrowly. First, the subtrees of all containers of a whole page are hashed together with
the page's host, and Spark counts in how many different main texts of the host each occurs: one that recurs in at least
`least` of them and `share` of the host's, or in `enough` of them however large the host is, is a template. Only hashes are
shuffled. Then pages are parsed again and every template goes, wherever it stands. Paragraphs and headings are never
counted, so a passage that many articles quote stays, and neither is a container that holds the whole main text, as it
occurs with one main text only. The templates are broadcast where they are at most `most`; beyond that they are joined to
the pages that hold them.

What is seen on too few pages to be counted falls to markup: elements that are no prose by their tag (menus, footers, asides,
forms, scripts), and block containers whose class, id or role is made of boilerplate words only (`cookie-banner`, but not
`related-work`); paragraphs and inline elements never go by name. The main element is the largest <article> left, else
<main>, else the body, where a container made of links mostly goes too.

Texts are blocks joined by a newline; white space inside a block is one space, character references are decoded, <br> is
white space. A null or empty page has the empty text, an empty table gives none; a null url is a host of its own, and so is
one without a host. Pages may be of any length and depth: parsing takes linear time and doesn't recurse. Repeated pages
count once as a main text, so a page copied a thousand times makes no template of itself. Rows keep all their columns,
whatever their names.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from . import rows, store

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
#: Elements whose subtrees are counted.
CONTAINERS = frozenset("div section ul ol dl table figure details fieldset center span nav aside header footer form menu".split())
#: Elements that class, id or role can name boilerplate.
NAMEABLE = frozenset("div section ul ol dl table figure details fieldset center nav aside header footer form menu article".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option".split())
#: A start tag of these ends an open paragraph.
ENDS_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot caption option legend summary".split())
SCOPES = frozenset("article aside body button center details div fieldset figure footer form header html li main nav section table td th blockquote ul ol dd dt".split())
BOILERPLATE = frozenset("nav footer aside form script style noscript template iframe button select option menu dialog textarea svg canvas object video audio head input datalist title".split())
#: Words of names that say boilerplate, and words that may stand beside them.
SAYS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsors sponsored promo promos promotion banner banners cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login sidebar menu nav navbar navigation topnav subnav breadcrumb breadcrumbs header footer masthead comment comments commentlist reply replies disqus share sharing social related recommended recommendations widget widgets search searchform pagination pager toolbar skip complementary contentinfo toc".split())
BESIDE = frozenset("site page global top bottom left right main primary secondary sub box block wrap wrapper container inner outer holder list item items area zone slot unit bar row col column link links button buttons icon icons form field input text label title posts post articles stories news media widget section panel group left right center fixed sticky mobile desktop bottom small large user reader readers thread a the js no to us up id".split())
SPLIT = re.compile(r"[^a-z]+")
TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: What an end tag is implied by: a start tag of the first ends an open one of the second.
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Letters in links, as a share of a container's, from which it is a list of links.
LINKS = 0.6
#: Templates that are broadcast at most, 8 bytes each.
MOST = 1 << 22
_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E687 % ((1 << 61) - 1)


def says_boilerplate(attributes: str) -> bool:
    """Whether some name in class, id or role is made of boilerplate words, and of words that may stand beside them."""
    for a, b, c in NAMED.findall(attributes):
        for name in (a or b or c).split():
            parts = [p for p in SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if p]
            if any(p in SAYS for p in parts) and all(p in SAYS or p in BESIDE for p in parts):
                return True
    return False


class Page:
    """Elements of a page: tag, parent, whether markup alone names it boilerplate, and its part of the token list."""

    def __init__(self, source: str):
        self.tags, self.parents, self.dropped, self.linked, self.begin, self.end = ["#root"], [-1], [False], [False], [0], [0]
        self.tokens: list[tuple[int, str | None]] = []  # (element, text), or (element, None) where a block begins or ends
        self.open: dict[str, int] = {}
        self.articles = [0]  # open <article>s at each element
        stack = [0]
        at = 0
        while True:
            m = TAG.search(source, at)
            text = source[at : m.start() if m else len(source)]
            if text:
                self.tokens.append((stack[-1], unescape(text) if "&" in text else text))
            if not m:
                break
            at = m.end()
            close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if close:
                if tag == "br" or tag == "p" and not self.open.get("p"):
                    self.tokens.append((stack[-1], " "))
                if self.open.get(tag):
                    self.close(stack, next(k for k in range(len(stack) - 1, 0, -1) if self.tags[stack[k]] == tag))
                continue
            if tag == "br":
                self.tokens.append((stack[-1], " "))
                continue
            if tag in ENDS_P:
                self.close_scoped(stack, ("p",))
            if tag in IMPLIED:
                self.close_scoped(stack, IMPLIED[tag], inner=True)
            if tag in VOID:
                if tag in BLOCKS:
                    self.tokens.append((stack[-1], None))
                continue
            parent = stack[-1]
            drop = self.dropped[parent] or tag in BOILERPLATE or tag == "header" and not self.articles[parent] or tag in NAMEABLE and "=" in attributes and says_boilerplate(attributes)
            self.tags.append(tag)
            self.parents.append(parent)
            self.dropped.append(drop)
            self.linked.append(self.linked[parent] or tag == "a")
            self.articles.append(self.articles[parent] + (tag == "article"))
            self.begin.append(len(self.tokens))
            self.end.append(-1)
            if tag in BLOCKS:
                self.tokens.append((parent, None))
            if tag in RAW:
                stop = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at)
                at = stop.start() if stop else len(source)
            if attributes.endswith("/") and tag in ("svg", "path"):
                self.end[-1] = len(self.tokens)
                continue
            stack.append(len(self.tags) - 1)
            self.open[tag] = self.open.get(tag, 0) + 1
        self.close(stack, 0)

    def close(self, stack: list[int], k: int) -> None:
        block = False
        for e in stack[k:]:
            self.end[e] = len(self.tokens)
            tag = self.tags[e]
            block |= tag in BLOCKS
            if e:
                self.open[tag] -= 1
        if block:
            self.tokens.append((stack[max(k - 1, 0)], None))
        del stack[k:]

    def close_scoped(self, stack: list[int], tags: tuple[str, ...], inner: bool = False) -> None:
        if not any(self.open.get(t) for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[k]]
            if tag in tags:
                self.close(stack, k)
                return
            if tag in SCOPES and not (inner and tag in ("div", "section", "td", "th")):
                return

    def letters(self, count) -> list[int]:
        """Letters of the tokens that count(element) takes, before each token."""
        out, n = [0], 0
        for e, t in self.tokens:
            if t and count(e):
                n += len(t) - t.count(" ") - t.count("\n")
            out.append(n)
        return out

    def subtrees(self, seed: bytes) -> dict[int, int]:
        """Signed 64-bit hashes of all containers with text, by element."""
        salt = xxhash.xxh64_intdigest(seed)
        pre, powers = [0], [1]
        for e, t in self.tokens:
            pre.append((pre[-1] * _BASE + xxhash.xxh64_intdigest(f"{self.tags[e]}\0{t or ''}", salt)) % _PRIME)
            powers.append(powers[-1] * _BASE % _PRIME)
        have, out = self.letters(lambda e: True), {}
        for e, tag in enumerate(self.tags):
            a, b = self.begin[e], self.end[e]
            if tag in CONTAINERS and have[b] > have[a]:
                whole = (pre[b] - pre[a] * powers[b - a]) % _PRIME
                out[e] = xxhash.xxh64_intdigest(f"{tag}\0{b - a}\0{whole}", salt) - (1 << 63)
        return out

    def text(self, gone=()) -> str:
        """The main text, without the elements `gone` and what is boilerplate by markup."""
        dropped = self.dropped.copy()
        if gone:
            for e in range(1, len(dropped)):
                dropped[e] = dropped[e] or dropped[self.parents[e]] or e in gone
        kept = self.letters(lambda e: not dropped[e])
        top = 0
        for tag in ("article", "main", "body"):
            sizes = [(kept[self.end[e]] - kept[self.begin[e]], -e) for e, t in enumerate(self.tags) if t == tag and not dropped[e]]
            if sizes and max(sizes)[0]:
                top = -max(sizes)[1]
                break
        if self.tags[top] != "article":
            links = self.letters(lambda e: not dropped[e] and self.linked[e])
            for e in range(1, len(dropped)):
                a, b = self.begin[e], self.end[e]
                dropped[e] = dropped[e] or dropped[self.parents[e]] or self.tags[e] in CONTAINERS and links[b] - links[a] > LINKS * (kept[b] - kept[a])
        blocks, now = [], []
        for e, t in [*self.tokens[self.begin[top] : self.end[top]], (0, None)]:
            if t is None:
                block = " ".join("".join(now).split())
                if block:
                    blocks.append(block)
                now.clear()
            else:
                now.append(" " if dropped[e] else t)
        return "\n".join(blocks)


SUBTREES = T.StructType([T.StructField("main", T.LongType()), T.StructField("subtrees", T.ArrayType(T.LongType()))])
TEXT = T.StructType([T.StructField("text", T.StringType())])


def host(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url}`").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def pages_of(batch: pa.RecordBatch):
    """(host, page) of each row of a batch of Carried.source with a column host."""
    for page, name in zip(batch.column("text"), batch.column("host"), strict=True):
        yield name.as_py().encode(), Page(page.as_py() or "")


def counted(source: DataFrame) -> DataFrame:
    """Rows (host, main, subtrees): the subtrees that each different main text of a host stands with."""

    def run(batches):
        for batch in batches:
            main, found = [], []
            for name, page in pages_of(batch):
                main.append(xxhash.xxh64_intdigest(page.text()) - (1 << 63))
                found.append(sorted(set(page.subtrees(name).values())))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(main, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["host", "main", "subtrees"])

    return source.select("text", "host").mapInArrow(run, "host string, main long, subtrees array<long>")


def templates(seen: DataFrame, least: int, share: float, enough: int) -> DataFrame:
    """Column subtree: those that recur in the main texts of their host."""
    used = seen.select("host", "main", F.explode("subtrees").alias("subtree")).distinct()
    counts = used.groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    mains = seen.select("host", "main").distinct().groupBy("host").agg(F.count("*").alias("of"))
    return counts.join(mains, "host").where((F.col("n") >= F.col("of") * share) | (F.col("n") >= enough)).select("subtree")


def extract(pages: DataFrame, html: str = "html", url: str = "url", least: int = 3, share: float = 0.1, enough: int = 30, most: int = MOST, carry: list[str] | None = None) -> DataFrame:
    """Columns row (all of pages, or those of carry) and text."""
    held = rows.Carried(pages, html, carry=carry, host=host(url))
    back, source = held.back, held.source
    seen = store.written(counted(source), "subtrees")
    found = store.written(templates(seen, least, share, enough), "templates")
    if found.count() <= most:
        known = np.sort(found.toArrow().column("subtree").to_numpy())
        shared = pages.sparkSession.sparkContext.broadcast(known)
    else:  # too many to broadcast: each page gets its own
        shared = None
        key = F.xxhash64("host", "text").alias("page")
        held_by = source.select("text", "host", key).dropDuplicates(["page"])
        own = paged(held_by).select("page", F.explode("subtrees").alias("subtree")).join(found, "subtree", "left_semi").groupBy("page").agg(F.collect_set("subtree").alias("gone"))
        source = source.withColumn("page", key).join(own, "page", "left").select(*source.columns, "gone")

    def run(batches):
        for batch in batches:
            texts = []
            for k, (name, page) in enumerate(pages_of(batch)):
                found = page.subtrees(name)
                if shared is None:
                    gone = set(batch.column("gone")[k].as_py() or ())
                    texts.append(page.text({e for e, h in found.items() if h in gone}))
                else:
                    h, e = np.fromiter(found.values(), np.int64, len(found)), list(found)
                    at = np.minimum(np.searchsorted(shared.value, h), max(len(shared.value) - 1, 0))
                    texts.append(page.text({e[i] for i in np.flatnonzero(shared.value[at] == h).tolist()} if len(shared.value) else ()))
            yield rows.again(batch, back, 0, len(batch), text_=pa.array(texts, pa.string()))

    shape = T.StructType([*held.shape, T.StructField("text_", T.StringType())])
    return source.mapInArrow(run, shape).select(held.row(), F.col("text_").alias("text"))


def paged(source: DataFrame) -> DataFrame:
    """Rows (page, subtrees) of source (text, host, page)."""

    def run(batches):
        for batch in batches:
            found = [sorted(set(page.subtrees(name).values())) for name, page in pages_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array(found, pa.list_(pa.int64()))], names=["page", "subtrees"])

    return source.mapInArrow(run, "page long, subtrees array<long>")
