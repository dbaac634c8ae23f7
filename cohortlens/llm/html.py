"""Main text of web pages: markup rules, and removal of subtrees that recur over a host's pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import chunks_of, frugal, ship, stage

# Element names and class words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("script style noscript template head title nav footer aside button select textarea iframe svg canvas object dialog menu map audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul title".split()
)
CONTAINERS = frozenset("div section ul ol dl table figure details nav header footer aside form fieldset menu dialog".split())
ENDS_P = BLOCK - frozenset("body html head option td th tr tbody thead tfoot".split())
SIBLINGS = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "option": ("option", ("select",)), "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "body": ("head", ()),
}
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner cookie cookies consent gdpr notice notices popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus share sharing social related promo sponsored newsletter subscribe footer login signup".split()
)


#: Of elements: text counts, is left out unless an article or main lies in it or the page has nothing else, or never counts.
KEPT, ASIDE, OUT = 0, 1, 2


class _Open:
    __slots__ = ("tag", "skip", "first", "content", "main", "candidate")

    def __init__(self, tag, skip, first, main, candidate):
        self.tag, self.skip, self.first, self.main, self.candidate, self.content = tag, skip, first, main, candidate, []


class Page(HTMLParser):
    """One pass over a page: ``pieces`` of text with the subtrees they lie in, and the hashes of subtrees."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        #: [text, rank of the region it lies in: 2 article, 1 main, 0 elsewhere; hashes of the containers around it; whether it is left out]
        self.pieces: list[list] = []
        self.subtrees: set[int] = set()
        self.stack = [_Open("", KEPT, 0, 0, False)]
        #: Of the block being read: what counts, and what is left out.
        self.text: tuple[list[str], list[str]] = ([], [])
        self.marked = False
        self.feed(html)
        self.close()
        while len(self.stack) > 1:
            self._pop()
        self._flush()

    def _flush(self):
        for aside, part in enumerate(self.text):
            t = " ".join("".join(part).split())
            part.clear()
            if t:
                top = self.stack[-1]
                top.content.append(t)
                self.pieces.append([t, top.main, [], bool(aside)])

    def _pop(self):
        top = self.stack[-1]
        if top.tag in BLOCK:
            self._flush()
        self.stack.pop()
        if top.content or top.candidate:
            h = xxhash.xxh64_intdigest(f"{top.tag}\x00" + "\x01".join(top.content)) - (1 << 63)
            self.stack[-1].content.append(f"\x02{h}")
            if top.candidate and top.content:
                self.subtrees.add(h)
                for p in self.pieces[top.first :]:
                    p[2].append(h)

    def _close(self, tags: tuple, stops: tuple = ()):
        """Close the nearest open element of these tags, and what is open in it."""
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].tag in tags:
                while len(self.stack) > at:
                    self._pop()
                return
            if self.stack[at].tag in stops:
                return

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text[self.stack[-1].skip == ASIDE].append(" ")
            return
        if tag in ENDS_P:
            self._close(("p",), ("article", "main", "div", "section", "td", "th", "li", "blockquote", "body", "button", "figure", "aside", "footer", "header", "nav"))
        if tag in SIBLINGS:
            names, stops = SIBLINGS[tag]
            self._close(tuple(names.split()), stops)
        if tag in BLOCK:
            self._flush()
        if tag in VOID:
            return
        up = self.stack[-1]
        skip = OUT if tag in NEVER else up.skip
        main = 2 if tag == "article" else 1 if tag == "main" else 0
        if skip != OUT and (tag in BLOCK or attrs):
            named = {w for k, v in attrs if v and k in ("class", "id", "role") for w in v.lower().split()}
            if tag in CONTAINERS and any(k == "role" and v and "main" in v.lower().split() for k, v in attrs):
                main = max(main, 1)
            if main:
                skip = KEPT
                self.marked = True
            elif tag == "form" or tag == "header" and up.main < 2 or not up.main and tag not in ("body", "html") and not WORDS.isdisjoint(named):
                skip = ASIDE
        if any(k == "hidden" for k, _ in attrs):
            skip = OUT
        self.stack.append(_Open(tag, skip, len(self.pieces), max(main, up.main), tag in CONTAINERS))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:  # in HTML the slash of other elements says nothing
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "br":
            self.text[self.stack[-1].skip == ASIDE].append(" ")
            return
        if tag in BLOCK:
            self._flush()
        self._close((tag,), () if tag in ("body", "html") else ("article", "body") if tag not in ("article", "main", "div", "section") else ("body",))

    def handle_data(self, data):
        top = self.stack[-1]
        if top.skip == OUT:  # counts for the subtree's hash, and leaves the block around it whole
            if t := " ".join(data.split()):
                top.content.append(t)
        else:
            self.text[top.skip == ASIDE].append(data)

    def unknown_decl(self, data):
        pass

    def main_pieces(self) -> list[list]:
        """The pieces of the highest region that has any; a page without article and main that has only left-out text keeps it."""
        pieces = [p for p in self.pieces if not p[3]]
        if not pieces and not self.marked:
            pieces = self.pieces
        top = max((p[1] for p in pieces), default=0)
        return [p for p in pieces if p[1] == top]


def _parsed(pages: DataFrame, with_text: bool) -> DataFrame:
    """html first, host second; adds uid, and the subtrees and a hash of the content, or the pieces."""
    ship(pages.sparkSession)
    piece = pa.list_(pa.struct([("text", pa.string()), ("inside", pa.list_(pa.int64()))]))
    keep = pages.columns[2:] if with_text else ["host"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name in keep)

    def run(batches):
        for b in batches:
            html, host = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in chunks_of(html):
                done = [Page(h or "") for h in html[i:j]]
                uid = pa.array([xxhash.xxh64_intdigest(f"{x}\x00{h}") - (1 << 63) for x, h in zip(host[i:j], html[i:j], strict=True)], pa.int64())
                part = b.slice(i, j - i)
                if with_text:
                    made = [pa.array([[{"text": t, "inside": sorted(set(x))} for t, _, x, _ in d.main_pieces()] for d in done], piece)]
                    names = ["pieces"]
                else:
                    content = [xxhash.xxh64_intdigest("\n".join(t for t, *_ in d.main_pieces())) - (1 << 63) for d in done]
                    made = [
                        pa.array(content, pa.int64()),
                        pa.array([sorted(d.subtrees) for d in done], pa.list_(pa.int64())),
                        pa.array([sorted({h for _, _, x, _ in d.main_pieces() for h in x}) for d in done], pa.list_(pa.int64())),
                    ]
                    names = ["content", "subtrees", "open"]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [uid, *made], names=[*keep, "uid", *names])

    extra = "pieces array<struct<text:string,inside:array<bigint>>>" if with_text else "content long, subtrees array<long>, open array<long>"
    return pages.mapInArrow(frugal(run), f"{kinds}, uid long, {extra}")


def main_text(pages: DataFrame, html_col: str = "html", url_col: str = "url", text_col: str = "text", min_pages: int = 10, few_pages: int = 4, share: float = 0.5) -> DataFrame:
    """``pages`` with ``text_col``, the main text of each whole page, in place of the html.

    Text lies in the article elements, without any in main, without any anywhere; menus, headers,
    footers, sidebars, notices, adverts, forms, scripts, styles and comments are left out by element name
    or whole class name; by class, only outside article and main, never with an article or main in it,
    and never all text of a page without these. Then site templates go: each container's subtree is hashed, and one that
    stands on ``min_pages`` pages of a host with different main texts (copies of a page count once), or on ``few_pages`` and a
    ``share`` of them on a smaller host, is deleted wherever it stands on that host. Paragraphs and headings are no containers, so a text that recurs stays. Blocks are
    joined by a line feed, white space in a block is one space, character references are decoded.

    A null or empty html gives an empty text; a null url is a host of its own name, ''. Equal pages are
    treated alike. A column named like the output is replaced. Counts are distinct rows of hashes,
    aggregated on the map side; only pages whose main text lies in some container look their
    subtrees up, and the staged result is broadcast only if Spark finds it small.
    """
    host = F.lower(F.coalesce(F.try_parse_url(F.col(url_col), F.lit("HOST")), F.lit("")))
    keep = [c for c in pages.columns if c not in (html_col, text_col)]
    inner = [F.col(c).alias(f"__{i}") for i, c in enumerate(keep)]
    given = pages.select(F.col(html_col).alias("html"), host.alias("host"), *inner)
    seen = stage(_parsed(given.select("html", "host"), False), "subtrees")
    stands = seen.select("host", "content", F.explode("subtrees").alias("h")).distinct()
    counts = stage(stands.groupBy("host", "h").count().where(F.col("count") >= min(few_pages, min_pages)), "template_counts")
    small = seen.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") < min_pages)
    some = counts.where(F.col("count") < min_pages).join(small, "host").where(F.col("count") >= F.greatest(F.lit(few_pages), F.ceil(F.col("n") * share)))
    template = stage(counts.where(F.col("count") >= min_pages).select("host", "h").unionByName(some.select("host", "h")), "templates")
    hits = seen.where(F.size("open") > 0).select("uid", "host", F.explode("open").alias("h")).distinct().join(template, ["host", "h"])
    gone = stage(hits.groupBy("uid").agg(F.collect_list("h").alias("gone")), "template_hits")
    out = _parsed(given, True).join(gone, "uid", "left")
    left = F.when(F.col("gone").isNull(), F.col("pieces")).otherwise(F.filter("pieces", lambda p: ~F.arrays_overlap(p["inside"], F.col("gone"))))
    text = F.array_join(F.transform(left, lambda p: p["text"]), "\n")
    return out.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(keep)], text.alias(text_col))
