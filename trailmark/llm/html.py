"""Main text of web pages with a site style tree (operator 5).

The pages of a host are merged into one tree of element nodes (path of tags with
their presentation attributes).  For each node the tree holds how its pages
present it (sequence of its child elements) and what they write in it.  The
entropies of the two say how much the node tells a page from others: a branch
that looks and reads the same on most pages of the host is furniture and is
removed from each page.  Every element with readable text enters the tree,
whatever its name.

Names are evidence only, weighed after the tree, on any host, also with a single
page: of what is left, an element that names itself as furniture (menus, footers,
adverts, forms, comments ...) goes, unless it holds the page's article or more
than half of the text left.  The page's article is the longest <article> or <main>,
if it is longer than the text outside it that no name tells as furniture.  Where
articles hold half of the rest or more, what is outside them goes too.

Statistics are ordinary grouped sums, so a host with a third of all pages is
counted in parts; the nodes found unimportant are joined back to the nodes of the
pages over salted keys.  Each node is judged on the pages that hold it, however
many others its host has.

Defined results: null or empty html gives the empty text; a null url is a host of
its own; repeated rows are each extracted; broken markup is read as browsers do as
far as blocks are concerned; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.common import written

#: a node is judged on this many different pages of its host or more
LEAST_PAGES = 4
#: nodes of lower importance (0: all pages alike, 1: all differ) are furniture
LEAST_IMPORTANCE = 0.3
SALTS = 32

# --- fixed values: element kinds -------------------------------------------------------------
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt
    ruby s samp small span strike strong sub sup time tt u var wbr""".split())
#: what is in these is no text of the page
DROPPED = set("""head script style noscript template button select option textarea iframe object svg canvas audio
    video input datalist map""".split())
#: elements that name themselves as furniture by their tag, or by a token of class, id or role
FURNITURE = set("nav footer aside form dialog menu fieldset".split())
NAMES = set("""ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion
    nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer header masthead banner
    comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices notification
    popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended
    recommendations pager pagination toolbar widget widgets skip complementary contentinfo search""".split())
CLOSES = {  # a start tag ends these open elements
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
}
SCOPES = {"ul", "ol", "table", "article", "main", "section", "div", "body", "html", "blockquote", "dl"}
# ----------------------------------------------------------------------------------------------


def node_name(tag: str, attrs: list) -> tuple[str, bool]:
    """(tag with its presentation attributes, whether it names itself as furniture)."""
    names, hidden, mark = set(), False, []
    for k, v in attrs:
        v = (v or "").strip()
        if k in ("class", "id", "role"):
            low = v.lower()
            names.update(re.split(r"[^a-z]+", low))
            names.update(re.split(r"[\s]+", low))
            mark.append(f"{k}={re.sub(r'[0-9]+', '0', ' '.join(low.split()))}")
        elif k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and re.search(
                r"display\s*:\s*none|visibility\s*:\s*hidden", v.lower()):
            hidden = True
    return (f"{tag}[{';'.join(sorted(mark))}]" if mark else tag), hidden or bool(names & NAMES)


class Page(HTMLParser):
    """Blocks of a page in order: (path, text, the open elements that are furniture by name or an article).

    Such an element is its number, negative for furniture; outer ones come first.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.stack: list[list] = []  # [tag, path, dropped, marks, child names]
        self.blocks: list[tuple[str, str, tuple[int, ...]]] = []
        self.styles: list[tuple[str, str]] = []
        self.text: list[str] = []
        self.n_marks = 0
        self.feed(html)
        self.close()
        self.end_block()
        while self.stack:
            self.pop()

    def top(self):
        return self.stack[-1] if self.stack else ["", "", False, (), []]

    def end_block(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        _, path, dropped, marks, _ = self.top()
        if text and not dropped:
            self.blocks.append((path, text, marks))

    def pop(self):
        _, path, dropped, _, children = self.stack.pop()
        if not dropped:
            self.styles.append((path, ",".join(sorted(set(children)))))

    def close_to(self, tags: set[str]):
        """Ends the innermost open element of these (and what is in it), unless a scope lies between."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                self.end_block()
                del_to = i
                while len(self.stack) > del_to:
                    self.pop()
                return
            if self.stack[i][0] in SCOPES:
                return

    def handle_starttag(self, tag, attrs):
        if tag in INLINE and tag not in DROPPED:
            if tag == "br":
                self.text.append(" ")
                return
            name, furniture = node_name(tag, attrs)
            if not furniture:
                return
        self.end_block()
        if tag not in INLINE:
            self.close_to({"p"})
        if tag in CLOSES:
            self.close_to(CLOSES[tag])
        if tag in VOID:
            return
        name, furniture = node_name(tag, attrs)
        _, path, dropped, marks, children = self.top()
        article = tag in ("article", "main")
        if article:
            furniture &= bool(set(re.split(r"[^a-z]+", " ".join(v or "" for k, v in attrs if k in ("class", "id"))
                                           .lower())) & {"comment", "comments", "reply", "ad", "ads", "advert", "related",
                                                         "sponsored", "promo"})
        elif tag in ("html", "body"):
            furniture = False
        # an article's own header may hold its title; any other header is the site's
        elif tag in FURNITURE or tag == "header" and all(x < 0 for x in marks):
            furniture = True
        if furniture or article:
            self.n_marks += 1
            marks += (-self.n_marks if furniture else self.n_marks,)
        children.append(name)
        self.stack.append([tag, f"{path}/{name}", dropped or tag in DROPPED, marks, []])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in INLINE:  # <div/> opens the element, as in browsers
            return

    def handle_endtag(self, tag):
        if tag == "br":
            self.text.append(" ")
            return
        if tag == "p" and not any(x[0] == "p" for x in self.stack):
            self.end_block()
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.end_block()
                while len(self.stack) > i:
                    self.pop()
                return
            if tag in INLINE and self.stack[i][0] not in INLINE:
                return

    def handle_data(self, data):
        if not self.top()[2]:
            self.text.append(data)

    def main(self, gone: frozenset[int] | set[int] = frozenset()) -> list[tuple[str, str]]:
        """The blocks of the main text, given the digests of paths that the tree found to be furniture."""
        blocks = [x for x in self.blocks if not gone or digest(x[0]) not in gone]
        size, own = {}, {}  # text in an element; in an article, without what is furniture by name in it
        total = plain = 0
        for _, text, marks in blocks:
            n, inner = len(text), True
            total += n
            plain += n * all(x > 0 for x in marks)
            for x in reversed(marks):
                size[x] = size.get(x, 0) + n
                inner &= x > 0
                if x > 0 and inner:
                    own[x] = own.get(x, 0) + n
        article = max(own, key=lambda x: (own[x], -x), default=0)
        # text that no name tells as furniture, outside the article
        beside = plain - sum(len(t) for _, t, marks in blocks if article in marks and all(x > 0 for x in marks))
        held = set()
        if article and own[article] > beside:
            held = {x for _, _, marks in blocks if article in marks for x in marks[:marks.index(article)]}
        kept = [(p, t, any(x > 0 for x in marks)) for p, t, marks in blocks
                if all(x > 0 or x in held or 2 * size[x] > total for x in marks)]
        inside = sum(len(t) for _, t, in_article in kept if in_article)
        only = inside > 0 and 2 * inside >= sum(len(t) for _, t, _ in kept)
        return [(p, t) for p, t, in_article in kept if in_article or not only]


def parsed(html: str | None) -> Page | None:
    return Page(html) if html else None


def digest(*parts: str) -> int:
    h = hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8)
    return int.from_bytes(h.digest(), "little", signed=True)


def host_of(url: str):
    """Host of a url: lower case, without user and port; the empty text if there is none."""
    host = F.regexp_extract(F.lower(F.coalesce(F.col(url), F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#\\]*)", 1)
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


NODE = pa.struct([("path", pa.int64()), ("kind", pa.int32()), ("value", pa.int64())])


def page_nodes(pages: DataFrame) -> DataFrame:
    """(host, salt, raw, page, nodes) of each page, written; ``pages`` has host, salt, raw and html.

    ``nodes`` are the page's (path, kind, value), the path as a digest.  Kind 0:
    how the node's children look; kind 1: what is written in it.  ``page`` is a
    digest of the page's main text as its names tell it: equal pages count once.
    """

    def read(batches):
        for batch in batches:
            keep, wholes, nodes = [], [], []
            for i, html in enumerate(batch.column(3).to_pylist()):
                page = parsed(html)
                if page is None:
                    continue
                looks: dict[str, list[str]] = {}
                reads: dict[str, list[str]] = {}
                for path, style in page.styles:
                    looks.setdefault(path, []).append(style)
                for path, text, _ in page.blocks:
                    reads.setdefault(path, []).append(text)
                keep.append(i)
                wholes.append(digest(*[f"{p}\1{t}" for p, t in page.main()]))
                # only nodes that hold text are judged
                nodes.append([{"path": digest(p), "kind": k, "value": digest(*of[p])}
                              for p in reads for k, of in ((0, looks), (1, reads)) if p in of])
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).take(at) for i in range(3)], pa.array(wholes, pa.int64()),
                 pa.array(nodes, pa.list_(NODE))], names=["host", "salt", "raw", "page", "nodes"])

    out = pages.select("host", "salt", "raw", "html").mapInArrow(
        read, "host string, salt int, raw long, page long, nodes array<struct<path:long,kind:int,value:long>>")
    return written(out, "page-nodes")


def style_tree(nodes: DataFrame) -> DataFrame:
    """(host, path, n_pages, importance) of each node that holds text, from ``page_nodes()``.

    With m pages, a value seen on c of them adds -(c/m) log_m(c/m); 0 when all m
    are alike, 1 when all differ.  Importance: the content's entropy, mixed with
    that of the node's presentation.
    """
    seen = nodes.select("host", "page", F.explode("nodes").alias("x")).select("host", "page", "x.*").distinct()
    by_value = seen.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("c"))
    m, s = F.sum("c"), F.sum(F.col("c") * F.log("c"))
    node = by_value.groupBy("host", "path", "kind").agg(m.alias("m"), s.alias("s")).withColumn(
        "entropy", F.when(F.col("m") < 2, 1.0).otherwise(1 - F.col("s") / F.col("m") / F.log("m")))
    return node.groupBy("host", "path").agg(
        F.max(F.when(F.col("kind") == 1, F.col("m"))).alias("n_pages"),
        F.max(F.when(F.col("kind") == 0, F.col("entropy"))).alias("presentation"),
        F.max(F.when(F.col("kind") == 1, F.col("entropy"))).alias("content")).select(
        "host", "path", "n_pages",
        (0.9 * F.col("content") + 0.1 * F.coalesce("presentation", F.lit(0.0))).alias("importance"))


def furniture(nodes: DataFrame, tree: DataFrame, least_pages: int = LEAST_PAGES,
              least_importance: float = LEAST_IMPORTANCE) -> DataFrame:
    """(host, salt, raw, paths) of the pages with nodes to remove: each has those of its own nodes only."""
    low = tree.filter((F.col("n_pages") >= least_pages) & (F.col("importance") < least_importance))
    low = low.select("host", "path", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = nodes.select("host", "salt", "raw", F.explode(F.array_distinct("nodes.path")).alias("path"))
    return own.join(low, ["host", "path", "salt"]).groupBy("host", "salt", "raw").agg(
        F.collect_set("path").alias("paths"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, ``text`` (blocks joined by an empty line) and ``n_chars`` of every row."""
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    base = base.withColumn("host", host_of("url")).withColumn("raw", F.xxhash64("html")).withColumn(
        "salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    nodes = page_nodes(base)
    low = furniture(nodes, style_tree(nodes))
    both = base.join(low, ["host", "salt", "raw"], "left").select("page_id", "url", "html", "paths")
    schema = T.StructType([both.schema["page_id"], both.schema["url"], T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])

    def write(batches):
        for batch in batches:
            out = []
            for html, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                page, gone = parsed(html), set(paths or ())
                out.append("\n\n".join(t for _, t in page.main(gone)) if page else "")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()),
                 pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return both.mapInArrow(write, schema)
