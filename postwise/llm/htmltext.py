"""Operator 8: main text of web pages.

Markup is read once per page and cut into blocks. Blocks inside menus, headers,
footers, sidebars, notices, adverts, forms of the article and reader comments, as
far as the page names them so, are dropped. All other blocks of all pages go through
a suffix array per host, which decides what the markup leaves in doubt.

Blocks inside an article (or main) element: the array is one of blocks. A suffix
begins at each block, and its beginning is the fewest whole blocks that have
``min_run`` words; a doubted block is one by itself, however short. Beginnings that a
good share of the host's articles hold are repeated. Copies and near copies of an
article are no evidence: an article of which more than half the words stand in
beginnings that another of the host's articles holds too is not counted. Repeated
blocks go if the markup doubts them: if a class or id around them has a word for
furniture beside others, or one that may name a part of an article. Repeated blocks
without any such name (shared headings, openings, licences) are the article's own.

Blocks of pages without such an element are open, and the array is one of their
words: token runs that a good share of the host's open pages hold are boilerplate,
what is left of a block is kept. Pages that are near copies of each other (SimHash
classes) count once.

The suffix array is distributed. A suffix is a row (host, beginning as a hash, page,
position); suffixes with equal beginnings stand together in the array, and a
beginning that enough classes hold marks the tokens it covers. The beginnings are
the first ``min_run`` tokens, and at the first word of a block the block with its
end, however short it is: block ends are tokens of the stream. Unions of covered
stretches are the repeated substrings of ``min_run`` tokens or more and the repeated
blocks of any length. Beginnings are counted per class first, then per host, both
combined map-side, so neither a host with a third of all pages nor a menu on each of
them meets in one task.

A page is read in time linear in its length, however broken its markup is, and once:
the blocks of all pages are written to the shared folder.

Defined results: a null or empty html gives an empty text; pages without
a host in their url are kept whole; copies and near copies of a page do not make
its text repeated; repeated rows are extracted each; empty tables give empty results. Only the named columns are
read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from itertools import accumulate

import xxhash
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import Column, DataFrame, F, pa, text_bytes, written
from .simhash import near_duplicates

# attributes as HTML reads them: a quote opens a value only after "="; one that never closes is part of its value
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^ \t\n\f\r>]*+)"""
_NAMED = r"[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+"
_IS = r"[ \t\n\f\r]*+=[ \t\n\f\r]*+"
_START = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^ \t\n\f\r/>]*+)"
                  rf"((?:[ \t\n\f\r/]++|{_NAMED}(?:{_IS}{_VALUE})?+)*+)>", re.S)
# for the rest of a page in which a tag never ends: the next ">" ends it
_PLAIN_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^ \t\n\f\r/>]*+)([^>]*+)>", re.S)
_ATTR = re.compile(rf"({_NAMED})(?:{_IS}({_VALUE}))?+")
_TOKEN = re.compile(r"[a-z0-9]+")

# Element names of HTML and the words sites use for page furniture
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
SWALLOWS = frozenset("script style textarea title".split())  # without an end they hold the rest of the page
UNSEEN = frozenset("noscript template".split())
BREAKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody tfoot thead tr "
    "ul".split())
BARRIER = BREAKS | {"td", "th"}  # a closing tag of text markup reaches no further
CLOSES_P = BREAKS - {"body", "html", "li", "dd", "dt", "tr", "tbody", "thead", "tfoot", "summary"}
SPACES = frozenset("br td th hr option".split())
FURNITURE = frozenset("nav footer aside form menu dialog button select head header".split())
HINTED = frozenset("div section ul ol dl table p span aside details figure header".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar "
    "navigation breadcrumb breadcrumbs sidebar widget widgets footer masthead notice notices cookie cookies consent "
    "gdpr popup modal overlay newsletter subscribe subscription signup social share sharing related recommended "
    "comment comments replies reply disqus respond search login pagination pager toolbar copyright disclaimer".split())
# hints that inside an article, alone, also name parts of it: as a class, and as an id (a place to link to)
DOUBTFUL = {"class": frozenset("search related recommended login copyright disclaimer".split()),
            "id": frozenset("menu search related recommended notice notices banner reply replies login copyright "
                            "disclaimer header subscription".split())}
NEIGHBOUR = frozenset("with without has no".split())
# words beside a hint that say which part or place is meant; any other word makes the name speak of something else
PARTS = frozenset(
    "site page main primary secondary global local top bottom left right upper lower inner outer head header foot area "
    "container wrapper box block bar list item items link links icon icons button buttons btn btns post posts article "
    "articles story stories slot unit zone section panel module component region body form field title heading label "
    "group row col column mobile desktop sticky fixed floating js user reader google this us text image".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

# doubted: inside the article, by a name that may mean furniture;
# held: an article inside a wrapper that looks like furniture; form: a form inside the article;
# wrapped: furniture by its name, which an article inside may prove wrong; dropped: furniture whatever it holds
_HELD_DOUBTED, _MAIN_DOUBTED, _FORM, _HELD, _MAIN, _OPEN, _WRAPPED, _DROP = 7, 6, 5, 4, 3, 2, 1, 0
_SKIPPED = (_WRAPPED, _DROP)
_DOUBTED = {_MAIN: _MAIN_DOUBTED, _HELD: _HELD_DOUBTED}
_INSIDE = (_MAIN, _HELD, _FORM, _MAIN_DOUBTED, _HELD_DOUBTED)


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        value = m[2] or ""
        if len(value) > 1 and value[0] in "\"'" and value[-1] == value[0]:
            value = value[1:-1]
        found.setdefault(m[1].lower(), html_lib.unescape(value))  # the first of a name counts
    return found


def _role_of(tag: str, attrs: str, state: int) -> int:
    """State of what an element holds, given the state around it."""
    if state == _DROP:
        return _DROP
    if tag == "form":  # a form may span the page: around the article it says nothing of its content
        return _FORM if state in _INSIDE else state
    if tag in UNSEEN or tag in FURNITURE and not (tag == "header" and state in _INSIDE):
        return _DROP
    found = _attributes(attrs) if attrs.strip() else {}
    if tag == "main":
        return _MAIN
    if tag == "article":
        if _hinted(found, leading=True):
            return _DROP
        return _HELD if state in (_WRAPPED, _HELD) else _MAIN if state == _OPEN else state
    if not found:
        return state
    role = found.get("role", "").lower()
    if role in ROLES or "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return _DROP
    if role == "main":
        return _MAIN
    if role == "article":
        return _HELD if state in (_WRAPPED, _HELD) else _MAIN if state == _OPEN else state
    if tag in HINTED and _hinted(found, inside=state in _INSIDE):
        return _WRAPPED
    return _DOUBTED[state] if state in _DOUBTED and tag in BREAKS and _doubted(found) else state


def _hinted(found: dict[str, str], leading: bool = False, inside: bool = False) -> bool:
    """Whether a class or id names page furniture: hints, and beside them only
    words for parts and places (``left-sidebar``, not ``related-work`` or
    ``content-sidebar-wrap``). Names such as ``has-sidebar`` speak of a
    neighbour, not of the element; with ``leading`` only a name's first word
    counts (an article may be ``post-comments-open``, a ``comment-body`` is none).
    ``inside`` an article a doubtful word that is the whole name doesn't count."""
    for kind in ("class", "id"):
        for name in found.get(kind, "").lower().split():
            words = _TOKEN.findall(name)
            if not NEIGHBOUR.isdisjoint(words):
                continue
            if leading:
                if words and words[0] in HINTS:
                    return True
            elif inside and len(words) == 1 and words[0] in DOUBTFUL[kind]:
                continue
            elif not HINTS.isdisjoint(words) and all(w in HINTS or w in PARTS or w.isdigit() for w in words):
                return True
    return False


def _doubted(found: dict[str, str]) -> bool:
    """Whether a class or id has a hint at all, unless it speaks of a neighbour."""
    names = (_TOKEN.findall(name) for kind in ("class", "id") for name in found.get(kind, "").lower().split())
    return any(NEIGHBOUR.isdisjoint(words) and not HINTS.isdisjoint(words) for words in names)


class _Open:
    """The open elements of a page: a stack with the state outside of each, the places of
    its barriers, and counts of names, so that no tag looks through elements it does not
    close."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = []
        self.barriers: list[int] = []
        self.counts: list[dict[str, int]] = [{}]  # text markup since each barrier
        self.blocks: dict[str, int] = {}

    def push(self, tag: str, state: int) -> None:
        if tag in BARRIER:
            self.barriers.append(len(self.stack))
            self.counts.append({})
            self.blocks[tag] = self.blocks.get(tag, 0) + 1
        else:
            self.counts[-1][tag] = self.counts[-1].get(tag, 0) + 1
        self.stack.append((tag, state))

    def pop(self, tag: str) -> int:
        """Close all elements up to the last one of this name; the state outside of it."""
        while True:
            name, state = self.stack.pop()
            if name in BARRIER:
                self.barriers.pop()
                self.counts.pop()
                self.blocks[name] -= 1
            else:
                self.counts[-1][name] -= 1
            if name == tag:
                return state

    def holds(self, tag: str) -> bool:
        """Whether a closing tag of this name closes anything: text markup only within its block."""
        return bool((self.blocks if tag in BARRIER else self.counts[-1]).get(tag))

    def in_p(self) -> bool:
        return bool(self.barriers) and self.stack[self.barriers[-1]][0] == "p"


def blocks(page: str) -> tuple[list[str], list[str]]:
    """(blocks of the article, open blocks) in page order; open blocks are given
    only for a page without an article."""
    return cut(page)[:2]


def cut(page: str) -> tuple[list[str], list[str], list[bool]]:
    """The ``blocks`` of a page, and for each block of the article whether the markup doubts it."""
    found: list[tuple[int, str]] = []  # state, text
    held: list[str] = []
    elements = _Open()
    state, at, size = _OPEN, 0, len(page)
    tag_at, ended = _TAG, page.rfind(">")
    unended: set[str] = set()  # raw elements that have no end from here on

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                found.append((state, text))

    while at < size:
        start = _START.search(page, at)
        m = start and tag_at.match(page, start.start())
        if start and not m and tag_at is _TAG:
            tag_at = _PLAIN_TAG  # it ran to the end of the page: no other tag may do so again
            m = tag_at.match(page, start.start()) if start.start() < ended else None
        # a tag that never ends is text
        end = m.start() if m else size
        if end > at and state not in _SKIPPED:
            held.append(html_lib.unescape(page[at:end]))
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag, closing = tag.lower(), bool(m[1])
        if tag in RAW and not closing:
            done = None if tag in unended else re.compile(rf"</{tag}\s*+[^>]*+(?:>|\Z)", re.I).search(page, at)
            if not done:
                unended.add(tag)
            at = done.end() if done else size if tag in SWALLOWS else at
            continue
        if tag in VOID or tag in SPACES:
            if state not in _SKIPPED:
                held.append(" ")
            if tag in VOID:
                continue
        if tag in BREAKS:
            flush()
        if closing:
            if elements.holds(tag):
                new = elements.pop(tag)
                if new != state:
                    flush()
                state = new
            continue
        if tag in CLOSES_P and elements.in_p():
            state = elements.pop("p")
        new = _role_of(tag, m[3], state)
        if new != state:
            flush()
        if tag in ("svg", "math") and m[3].rstrip().endswith("/"):
            continue
        elements.push(tag, state)
        state = new
    flush()
    for kind, doubted in _DOUBTED.items():
        main = [(text, k == doubted) for k, text in found if k in (kind, doubted)]
        if main:
            return [text for text, _ in main], [], [d for _, d in main]
    return [], [text for _, text in found], []


def _text(raw: bytes | None) -> str:
    return str(raw or b"", "utf-8", "replace")


_BLOCKS = T.StructType([T.StructField("main", T.ArrayType(T.StringType())),
                        T.StructField("open", T.ArrayType(T.StringType())),
                        T.StructField("doubted", T.ArrayType(T.BooleanType()))])


@arrow_udf(_BLOCKS)
def _page_blocks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.string())
    for pages in batches:
        main, loose, doubted = zip(*(cut(_text(p)) for p in pages.to_pylist())) if len(pages) else ((), (), ())
        yield pa.StructArray.from_arrays([pa.array(main, kind), pa.array(loose, kind), pa.array(doubted, pa.list_(pa.bool_()))],
                                         names=["main", "open", "doubted"])


def page_blocks(html: Column | str) -> Column:
    return _page_blocks(text_bytes(html))


@arrow_udf(T.ArrayType(T.StringType()))
def _unique_runs(open_blocks: pa.Array, covered: pa.Array) -> pa.Array:
    """What is left of each block without the runs (first token, tokens) in ``covered``."""
    out = []
    for bl, runs in zip(open_blocks.to_pylist(), covered.to_pylist()):
        tokens = [b.split(" ") for b in bl or []]
        hit = bytearray(sum(map(len, tokens)))
        for r in runs or ():
            s, n = r["pos"], r["n"]
            hit[s:s + n] = b"\1" * min(n, len(hit) - s)
        at, left = 0, []
        for words in tokens:
            kept = " ".join(w for i, w in enumerate(words, at) if not hit[i])
            at += len(words)
            if kept:
                left.append(kept)
        out.append(left)
    return pa.array(out, pa.list_(pa.string()))


@arrow_udf(T.ArrayType(T.IntegerType()))
def _block_starts(open_blocks: pa.Array) -> pa.Array:
    """The place of each block's first token in its page's stream."""
    sizes = ([b.count(" ") + 1 for b in bl or []] for bl in open_blocks.to_pylist())
    return pa.array([[0, *accumulate(n)][:-1] for n in sizes], pa.list_(pa.int32()))


_END = "\x1e"  # the token of a block's end


def _block_suffixes(blocks: Column | str, doubted: Column | str, min_run: int) -> Column:
    """Per block the beginning of its suffix, the fewest whole blocks with ``min_run`` words (none
    where the page has no more so many), and a doubted block by itself if it is shorter: place of the
    first word, words, hash, whether the page has it for the first time, whether a block in it is
    doubted, and the words of the page."""
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("n", pa.int32()), ("begin", pa.int64()), ("first", pa.bool_()),
                               ("doubted", pa.bool_()), ("size", pa.int32())]))

    def beginnings(bl: list[str], doubt: list[bool]) -> list[tuple]:
        ends = [0, *accumulate(b.count(" ") + 1 for b in bl)]
        out, met, j = [], set(), 0
        for i in range(len(bl)):
            while j < len(bl) and ends[j] - ends[i] < min_run:
                j += 1
            spans = [(i, j)] if ends[j] - ends[i] >= min_run else []
            if doubt[i] and spans != [(i, i + 1)]:
                spans.append((i, i + 1))
            for a, b in spans:
                h = xxhash.xxh64_intdigest(_END.join(bl[a:b]).encode("utf-8", "replace"))
                h -= (h >> 63) << 64  # signed
                out.append((ends[a], ends[b] - ends[a], h, h not in met, any(doubt[a:b]), ends[-1]))
                met.add(h)
        return out

    @arrow_udf("array<struct<pos int, n int, begin bigint, first boolean, doubted boolean, size int>>")
    def suffixes(texts: pa.Array, doubts: pa.Array) -> pa.Array:
        return pa.array([beginnings(*page) for page in zip(texts.to_pylist(), doubts.to_pylist())], kind)

    return suffixes(blocks, doubted)


@arrow_udf(T.ArrayType(T.StringType()))
def _undoubted(main: pa.Array, doubted: pa.Array, covered: pa.Array) -> pa.Array:
    """The blocks without the doubted ones in the runs of whole blocks (first word, words)."""
    out = []
    for bl, doubt, runs in zip(main.to_pylist(), doubted.to_pylist(), covered.to_pylist()):
        sizes = [b.count(" ") + 1 for b in bl]
        gone, starts = set(), {at: i for i, at in enumerate([0, *accumulate(sizes)])}
        for r in runs or ():
            gone.update(range(starts[r["pos"]], starts[r["pos"] + r["n"]]))
        out.append([b for i, b in enumerate(bl) if not (doubt[i] and i in gone)])
    return pa.array(out, pa.list_(pa.string()))


@arrow_udf(T.LongType())
def _covered_words(covered: pa.Array) -> pa.Array:
    """Words in the union of the runs (first word, words)."""
    out = []
    for runs in covered.to_pylist():
        total = end = 0
        for s, e in sorted((r["pos"], r["pos"] + r["n"]) for r in runs or ()):
            total += max(0, e - max(s, end))
            end = max(end, e)
        out.append(total)
    return pa.array(out, pa.int64())


def article_boilerplate(articles: DataFrame, min_run: int = 8, share: float = 0.3, min_pages: int = 3) -> DataFrame:
    """``articles`` (row, host, main, doubted) to (row, covered): the runs (``pos``, ``n``) of whole
    blocks, some doubted, that a ``share`` of the host's articles hold, and ``min_pages`` of them at
    least. Articles that mostly consist of what others hold as well are copies: they do not count,
    but hold such a run too. Articles without a host are kept whole."""
    known = articles.filter(F.col("host").isNotNull())
    suffixes = written(known.select("row", "host", F.inline(_block_suffixes("main", "doubted", min_run))), "article-suffixes")
    runs = F.collect_list(F.struct("pos", "n")).alias("covered")  # at most one entry per block of a page
    key = ["host", "begin"]
    # combined map-side: a notice on every page of a host is one row per map task
    again = suffixes.filter("first").groupBy(key).agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    held = written(suffixes.join(again.select(key), key, "left_semi"), "article-repeats")
    copies = held.groupBy("row", "host", "size").agg(runs).filter(2 * _covered_words("covered") > F.col("size"))
    copies = written(copies.select("row", "host"), "article-copies")
    sizes = known.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).join(
        copies.groupBy("host").agg(F.count(F.lit(1)).alias("copies")), "host", "left")
    sizes = sizes.select("host", (F.col("pages") - F.coalesce("copies", F.lit(0))).alias("pages"))
    counts = (held.filter("first").join(copies.select("row"), "row", "left_anti").groupBy(key)
              .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages))
    shared = counts.join(sizes, "host").filter(F.col("n") >= F.lit(share) * F.col("pages")).select(key)
    return written(held.filter("doubted").join(shared, key, "left_semi").groupBy("row").agg(runs), "article-boilerplate")


def suffix_beginnings(pages: DataFrame, min_run: int) -> DataFrame:
    """(row, host, class, pos, n, begin, edge): the beginnings of all suffixes of the
    pages' token streams: the first ``min_run`` tokens of each, and at the first word of a
    block the whole block. ``edge``: whether the run lies in the first or last fifth."""
    stream = F.split(F.array_join("open", " "), " ")
    streams = pages.withColumn("t", stream).withColumn("size", F.size("t"))
    starts = F.sequence(F.lit(0), F.col("size") - F.lit(min_run))
    runs = streams.filter(F.col("size") >= min_run).select("row", "host", "class", "size", "t",
                                                           F.explode(starts).alias("pos"))
    runs = runs.select("row", "host", "class", "size", "pos", F.lit(min_run).alias("n"), F.xxhash64(
        F.array_join(F.slice("t", F.col("pos") + 1, F.lit(min_run)), " ")).alias("begin"))
    whole = streams.select("row", "host", "class", "size", _block_starts("open").alias("at"),
                           F.posexplode("open").alias("i", "block"))
    whole = whole.select("row", "host", "class", "size", F.col("at")[F.col("i")].alias("pos"),
                         F.size(F.split("block", " ")).alias("n"),
                         F.xxhash64(F.lit(_END), F.col("block"), F.lit(_END)).alias("begin"))
    middle = 2 * F.col("pos") + F.col("n")  # of the run, doubled
    edge = (middle < F.col("size") * 0.4) | (middle > F.col("size") * 1.6)
    return runs.unionByName(whole).withColumn("edge", edge.cast("double")).drop("size")


def unique_blocks(open_pages: DataFrame, min_run: int = 8, share: float = 0.3, edge_share: float = 0.1,
                  min_classes: int = 3) -> DataFrame:
    """``open_pages`` (row, host, open) to (row, blocks): without the token runs
    of ``min_run`` or more, and the blocks, that a ``share`` of the host's near-copy
    classes hold, and ``min_classes`` of them at least. Runs that mostly stand in the
    first or last fifth of their pages need ``edge_share`` only. Pages without a host
    are kept whole."""
    known = open_pages.filter(F.col("host").isNotNull())
    classes = near_duplicates(known.select("row", F.array_join("open", " ").alias("text")), "row", "text").select(
        F.col("doc_id").alias("row"), F.col("root").alias("class"))
    pages = written(known.join(classes, "row").select("row", "host", "class", "open"), "open-classes")
    sizes = pages.select("host", "class").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("size"))
    suffixes = suffix_beginnings(pages, min_run)
    # per class first: a menu on every page of a host is spread over the classes
    held = (suffixes.groupBy("host", "begin", "class").agg(F.avg("edge").alias("edge"))
            .groupBy("host", "begin").agg(F.count(F.lit(1)).alias("n"), F.avg("edge").alias("edge"))
            .filter(F.col("n") >= min_classes))
    needed = F.when(F.col("edge") > 0.5, F.lit(edge_share)).otherwise(F.lit(share))
    shared = held.join(sizes, "host").filter(F.col("n") >= needed * F.col("size")).select("host", "begin")
    covered = (suffixes.join(shared, ["host", "begin"], "left_semi").groupBy("row")
               .agg(F.collect_list(F.struct("pos", "n")).alias("covered")))  # at most two entries per token of a page
    joined = open_pages.join(covered, "row", "left")
    return joined.select("row", _unique_runs("open", "covered").alias("blocks"))


def host_of(url: Column) -> Column:
    """Lower-cased host, without user and port; also of ``//host/...`` and
    ``host.name/...``. Null if there is none."""
    text = F.trim(url.cast("string"))
    stated = F.regexp_extract(text, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*?)(?::[0-9]*)?(?:[/?#]|$)", 1)
    bare = F.regexp_extract(text, r"^([^\s/?#@:.]+(?:\.[^\s/?#@:.]+)+)\.?(?::[0-9]+)?(?:[/?#]|$)", 1)
    host = F.lower(F.when(stated != "", stated).otherwise(bare))
    return F.when(host != "", host)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              min_run: int = 8) -> DataFrame:
    """(page_id, url, text, n_chars) of every page. The blocks of all pages are written
    once, each row with a number of its own."""
    url = F.col(f"`{url_col}`")
    parsed = written(pages.select(F.col(f"`{id_col}`").alias("page_id"), url.alias("url"),
                                  F.monotonically_increasing_id().alias("row"),
                                  page_blocks(F.col(f"`{html_col}`")).alias("b")).select(
        "page_id", "url", "row", host_of(F.col("url")).alias("host"), F.col("b.main").alias("main"),
        F.col("b.doubted").alias("doubted"), F.col("b.open").alias("open")), "page-blocks")
    stated = parsed.filter(F.size("open") == 0).select("page_id", "url", "row", "main", "doubted")
    covered = article_boilerplate(parsed.filter(F.size("main") > 0).select("row", "host", "main", "doubted"), min_run)
    if covered.isEmpty():
        left = stated.withColumn("blocks", F.col("main"))
    else:
        left = stated.join(covered, "row", "left").withColumn(
            "blocks", F.when(F.col("covered").isNull(), F.col("main")).otherwise(_undoubted("main", "doubted", "covered")))
    both = left.select("page_id", "url", F.array_join("blocks", "\n\n").alias("text"))
    loose = parsed.filter(F.size("open") > 0).select("page_id", "url", "row", "host", "open")
    if not loose.isEmpty():
        left = unique_blocks(loose.select("row", "host", "open"), min_run)
        both = both.unionByName(loose.select("row", "page_id", "url").join(left, "row").select(
            "page_id", "url", F.array_join("blocks", "\n\n").alias("text")))
    return both.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
