"""Main text of web pages by template deduction over pages of one host (operator 6).

Tokens of a page are its elements, told apart by their path, and its texts, told
apart by path and words. Over all pages of a host every token has an occurrence
vector: how often it occurs in each page. Tokens of equal vector form an
equivalence class; a class of several tokens (an element has two, its begin and end)
on several pages is part of the template of the pages it is on, so each type of page
of a host has classes of its own. Texts of a class that are wherever their element
is are fixed furniture. Elements of a class that hold most of the text of their
pages may be the slot of the article. Those nest by their paths: the innermost one
of a page is its slot, unless an article or main element among them breaks the tie.
Article and main elements decide alone on hosts of few pages, and on pages of which
the classes know no more than html and body; such elements that are on several
pages and hold less than half of their text are teasers and never decide.
Menus, headers, footers, sidebars, notices, adverts, forms and comments are told by
their elements and names and dropped everywhere.

Vectors are summed digests, so a host of any size is a sum that every task begins
on its own.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.tables import narrow, slices, stage
from rollcall.llm.urls import host_of

#: Pages from which a class counts, tokens of a class, share of an element's pages or of text.
MIN_PAGES, MIN_CLASS, MIN_SHARE = 8, 3, 0.9
#: Words up to which a text inside the article can be template furniture.
FURNITURE = 12
#: Bytes of templates up to which they are sent to every task; beyond, pages are joined by host.
SENT = 32 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
#: Elements whose text is never the article's.
DROPPED = frozenset("head nav footer aside form button select script style noscript template iframe svg dialog menu "
                    "object canvas audio video math".split())
#: Words in classes, ids and roles with the same meaning.
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice alert nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside "
    "complementary contentinfo comment comments commentlist discussion disqus reply replies respond related recommended "
    "share sharing social footer masthead header newsletter subscribe subscription signup login search widget widgets "
    "popup modal overlay toolbar pagination pager skip tags meta byline form".split()
)
#: What an element is to the choice of the slot.
TEASER, FRAME, PLAIN, MAIN, ARTICLE = range(-1, 4)
MAIN_NAMES = frozenset("main article articlebody post entry content story".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S
)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    """A run of text between block elements; ``path`` is a digest of the elements around it."""

    text: str
    path: int
    around: tuple[int, ...]
    rank: int  # 2 inside an article, 1 inside a main element, 0 elsewhere
    token: int = 0


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    elements: dict[int, int] = field(default_factory=dict)  # path -> times
    marks: dict[int, int] = field(default_factory=dict)  # path -> FRAME to ARTICLE


def _names(attributes: str) -> tuple[str, set[str]]:
    found = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _NAMES.finditer(attributes)] if "=" in attributes else []
    words = {w for _, v in found for w in _WORD.findall(_CAMEL.sub(" ", v).lower())}
    return " ".join(v for k, v in found if k == "class"), words


def parse(html: str) -> Page:
    """The blocks outside furniture, in page order, and the elements of a page."""
    page = Page()
    # (name, path, dropped, rank)
    stack: list[tuple[str, int, bool, int]] = [("", 0, False, 0)]
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                _, path, dropped, rank = stack[-1]
                if not dropped:
                    block = Block(text, path, tuple(dict.fromkeys(s[1] for s in stack)), rank)
                    block.token = xxhash.xxh3_64_intdigest(text, path) >> 1
                    page.blocks.append(block)

    def close(names: set[str] | frozenset[str], stop: frozenset[str] = frozenset()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                if not all(s[0] in INLINE for s in stack[i:]):
                    flush()
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        text = html[at : m.start() if m else n]
        if text:
            held.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in ("br", "p") and not any(s[0] == name for s in stack):
                flush()
            close({name})
            continue
        if name not in INLINE and name != "br":
            flush()
        if name in VOID:
            if name == "br":
                held.append(" ")
            continue
        if name in CLOSES_P:
            close({"p"}, frozenset({"button", "td", "th"}))
        if name in SAME:
            close(SAME[name], frozenset({"ul", "ol", "dl", "table", "select"}))
        styles, words = _names(m[3])
        _, path, dropped, rank = stack[-1]
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(html, at)
            at = end.start() if end else n
            if name in ("textarea", "title"):
                stack.append((name, path, True, rank))
                continue
            after = html.find(">", at)
            at = n if after < 0 else after + 1
            continue
        own_rank = rank
        if name == "article" and "comment" not in words:
            own_rank = 2
        elif name == "main" or "articlebody" in words or (words & MAIN_NAMES and "main" in words) or "main" == name:
            own_rank = max(rank, 1)
        gone = name in DROPPED or (name == "header" and rank < 2)
        if not gone and name not in ("html", "body", "article", "main"):
            gone = bool(words & FURNITURE_NAMES)
        if name not in INLINE and name != "p":
            path = xxhash.xxh3_64_intdigest(f"{name}.{styles}", path) >> 1
            page.elements[path] = page.elements.get(path, 0) + 1
            mark = FRAME if name in ("html", "body") else PLAIN if own_rank <= rank else (MAIN, ARTICLE)[own_rank - 1]
            page.marks[path] = max(page.marks.get(path, FRAME), mark)
        if gone and not dropped and name not in INLINE:
            flush()
        elif gone and not dropped:
            flush()
        stack.append((name, path, dropped or gone, own_rank))
    flush()
    return page


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by host and token: pages, digest of the occurrence vector, characters inside
    and on its pages; the mark of an element, the path of a text."""
    for whole in batches:
        for b in slices(whole, "html"):
            sums: dict[tuple[str, int, int], list[int]] = {}

            def add(host: str, kind: int, token: int, n: int, key: int, chars: int, total: int, about: int) -> None:
                s = sums.setdefault((host, kind, token), [0, 0, 0, 0, 0, about])  # noqa: B023
                v = xxhash.xxh3_64_intdigest(n.to_bytes(8, "little"), key)
                s[0] += 1
                s[1] += v & 0x3FFFFFFF
                s[2] += (v >> 30) & 0x3FFFFFFF
                s[3] += chars
                s[4] += total
                s[5] = max(s[5], about)

            for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                if not host:
                    continue
                page, key = parse(html or ""), xxhash.xxh3_64_intdigest(html or "")
                inside: dict[int, int] = {}
                texts: dict[int, int] = {}
                paths: dict[int, int] = {}
                for block in page.blocks:
                    texts[block.token] = texts.get(block.token, 0) + 1
                    paths[block.token] = block.path
                    for path in block.around:
                        inside[path] = inside.get(path, 0) + len(block.text)
                total = inside.get(0, 0)
                add(host, 0, 0, 1, key, total, total, 0)
                for path, n in page.elements.items():
                    add(host, 1, path, n, key, inside.get(path, 0), total, page.marks[path])
                for token, n in texts.items():
                    add(host, 2, token, n, key, 0, 0, paths[token])
            keys = list(sums)
            yield pa.record_batch(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                 pa.array([k[2] for k in keys], pa.int64()),
                 *(pa.array([sums[k][i] for k in keys], pa.int64()) for i in range(6))],
                ["host", "kind", "token", "pages", "v", "w", "chars", "total", "about"],
            )


def templates(pages: DataFrame) -> DataFrame:
    """``host, slots, texts``: the template of each host with at least ``MIN_PAGES`` pages.

    ``pages`` has ``host`` and ``html``. ``slots`` are ``(token, mark, share)`` of the
    elements of classes that hold more than half of the text of the pages they are
    on, and of teasers; ``texts`` are fixed texts. Tokens are digests. Each is on
    ``MIN_PAGES`` pages or more.
    """
    sums = pages.select("host", "html").mapInArrow(
        _tokens, "host string, kind int, token long, pages long, v long, w long, chars long, total long, about long"
    ).groupBy("host", "kind", "token").agg(
        *(F.sum(c).alias(c) for c in ("pages", "v", "w", "chars", "total")), F.max("about").alias("about")
    )
    sums = stage(sums.filter(F.col("pages") >= MIN_PAGES), "page_tokens")
    alike = Window.partitionBy("host", "pages", "v", "w")
    known = sums.filter("kind > 0").withColumn("size", F.sum(F.when(F.col("kind") == 1, 2).otherwise(1)).over(alike))
    valid = F.col("size") >= MIN_CLASS
    most = F.col("chars") * 2 > F.col("total")
    elements = known.filter("kind = 1")
    slot = F.when(most & valid, F.col("about")).when(~most & (F.col("about") >= MAIN), TEASER)
    slots = elements.withColumn("mark", slot.cast("int")).filter("mark is not null").select(
        "host", F.struct("token", "mark", (F.col("chars") / F.greatest("total", F.lit(1))).alias("share")).alias("slot"),
        F.lit(None).cast("long").alias("text"),
    )
    # A text outside all elements has path 0, which is on every page.
    around = sums.filter("kind < 2").select("host", F.col("token").alias("about"), F.col("pages").alias("all"))
    texts = known.filter((F.col("kind") == 2) & valid).join(around, ["host", "about"]).filter(
        F.col("pages") >= MIN_SHARE * F.col("all")
    ).select("host", F.lit(None).cast(slots.schema["slot"].dataType).alias("slot"), F.col("token").alias("text"))
    return slots.unionByName(texts).groupBy("host").agg(
        F.collect_list("slot").alias("slots"), F.collect_set("text").alias("texts")
    )


def _slot(blocks: list[Block], slots: dict[int, tuple[int, float]]) -> int | None:
    """The path of the article's slot on a page, by the classes of its host."""
    inside: dict[int, int] = {}
    above: dict[int, tuple[int, ...]] = {}
    for b in blocks:
        for i, path in enumerate(b.around):
            if slots.get(path, (TEASER,))[0] >= FRAME:
                inside[path] = inside.get(path, 0) + len(b.text)
                above[path] = b.around[:i]
    best = {m: max((p for p in inside if slots[p][0] == m), key=lambda p: (inside[p], p), default=None) for m in (MAIN, ARTICLE)}
    main, article = best[MAIN], best[ARTICLE]
    if main and article:
        # An article that leaves text of the main element out is only a part of it.
        return article if slots[article][1] >= MIN_SHARE * slots[main][1] else main
    at = article or main
    if at is None:
        inner = list(inside)
        while inner:  # down the branch with most text
            at = max(inner, key=lambda p: (inside[p], -len(above[p]), p))
            inner = [p for p in inner if at in above[p]]  # noqa: B023
    return at


def main_text(html: str, slots: dict[int, tuple[int, float]] | None = None, texts: frozenset[int] = frozenset()) -> str:
    """The article's text of one page, given the template of its host: slots as path to ``(mark, share)``."""
    blocks, slots = parse(html).blocks, slots or {}
    at = _slot(blocks, slots)
    mark = FRAME if at is None else slots[at][0]
    if at is not None:
        blocks = [b for b in blocks if at in b.around]
    if mark <= PLAIN:
        # Article and main elements that the classes don't know: of rare types of pages or hosts of few.
        teasers = {p for p, (m, _) in slots.items() if m == TEASER}
        own = [b for b in blocks if teasers.isdisjoint(b.around)] if teasers else blocks
        top = max((b.rank for b in own), default=0)
        tagged = [b for b in own if b.rank == top] if top else []
        if tagged and (mark == FRAME or 2 * sum(len(b.text) for b in tagged) > sum(len(b.text) for b in blocks)):
            blocks = tagged
    return " ".join(b.text for b in blocks if b.token not in texts or len(b.text.split()) > FURNITURE)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of every page, one row per input row.

    Null and empty pages have an empty text, as have pages that are all furniture.
    Character references are decoded, white space inside a block is one space,
    blocks are joined in page order by one space. Pages without a host, and hosts
    of few pages, are read by their elements alone; null and repeated ids pass
    through; extra columns are dropped; an empty table gives an empty result.
    """
    src = narrow(pages, page_id=id_col, url=url_col, html=html_col).withColumn("host", host_of(F.col("url")))
    found = stage(templates(src), "page_templates")
    size = found.agg(F.sum(F.length("host") + 8 * F.size("texts") + 20 * F.size("slots"))).first()[0] or 0
    found = found.select(F.col("host").alias("_host"), "slots", "texts")
    held = src.join(F.broadcast(found) if size <= SENT else found, F.col("host") == F.col("_host"), "left")
    kind = dict(src.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "html"):
                rows = zip(*(b.column(c).to_pylist() for c in ("html", "slots", "texts")), strict=True)
                out = [main_text(h or "", {x["token"]: (x["mark"], x["share"]) for x in s or ()}, frozenset(t or ()))
                       for h, s, t in rows]
                yield pa.record_batch(
                    [b.column("page_id"), b.column("url"), pa.array(out, pa.string()),
                     pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"],
                )

    return held.select("page_id", "url", "html", "slots", "texts").mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long"
    )
