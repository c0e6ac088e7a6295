"""Main text of web pages by site style trees.

Pages of one host are merged: an element node is the chain of block tags, classes and ids from the root, down to DEPTH of them; deeper
elements count as part of the last.  Text directly inside a node is a leaf below it.

* Presentation importance of a node is the entropy of its child sequences over the pages that have it, to the base of their number.
* Content importance of a leaf is one minus the mean entropy of its blocks: a block that stands on c of m pages has log c / log m.
* Composite importance is made level by level from the leaves up: a node with l different child sequences has 1 - GAMMA ** l parts of its
  presentation importance and GAMMA ** l of the mean of its children, each sequence counting as often as it occurs.

Menus and notices repeat and come near 0; articles differ and come near 1.  A branch on MIN_PAGES or more pages is removed when its node
and all nodes below it are under THRESHOLD times the importance of the host's pages as a whole.  All branches take part in the tree.

What the tree cannot tell is decided by what an element says that it is: menus and adverts whose words differ from page to page look
like articles to it, and hosts of a few pages have nothing to compare.  Elements named ``nav``, ``footer``, class ``ad`` and so on go
too.  Where a page has an ``article`` or ``main``, the tree says which: those that it removes whole are left out, and the others are
the main text with all their parts, as a heading that each article has is one.  Where it would remove them all (copies of one page), it
has no say on them.

Merging is aggregation: a task counts its pages' (host, node, feature) rows, Spark adds them up, and only nodes to remove come back to
the pages.

Defined results: null or empty html has empty text; a null url is the host of all pages without one; tags cut off at the end of a page
are dropped; unclosed and crossing elements are closed as browsers do in the common cases; elements of unknown names are inline; pages of
any length are read whole; repeated rows are pages of their own; an empty table gives an empty one.  Columns of any name pass through.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import append, free_name, rows_of, tidy
from fathom.plans.staging import Workspace

GAMMA = 0.9
THRESHOLD = 0.3
MIN_PAGES = 3
DEPTH = 32
#: Nodes to remove are broadcast up to this many (some 16 bytes each); beyond, they are joined by host.
BROADCAST_NODES = 200_000
#: Shares of children are whole numbers of this part, so that their sums are the same in any order.
PART = 1 << 20

# An attribute's value is quoted only right after the equals sign.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>|<[!?][^>]*+>""", re.S)
_NAMES = re.compile(r"""(?<![-\w])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CUT = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template xmp noembed noframes".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
BLOCK = CLOSES_P | frozenset("html head body li dt dd tr td th thead tbody tfoot caption option optgroup legend button select summary".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody")}
HOLDS = frozenset("ul ol dl table select menu".split())
# What elements of these names are for is never the article.
OFF_TAGS = frozenset("nav footer aside form head button select dialog menu".split())
OFF_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer share sharing social related recommended recommendation comment comments disqus respond replies pagination pager toolbar widget widgets masthead copyright skip search contentinfo complementary".split())
# An id names a place, often that of a heading in the article: it counts on these tags only, and only if it has no other words.
ID_TAGS = frozenset("div section ul ol dl table header".split())
ID_NEUTRAL = frozenset("area bar block bottom box container content end header inner left link links list main n page right section site the top wrap wrapper".split())
MAIN_TAGS = frozenset(("article", "main"))


@dataclass
class Element:
    tag: str
    node: int
    depth: int
    off: bool
    main: int
    low: bool
    kids: list[int] = field(default_factory=list)


@dataclass
class Page:
    """Blocks of text as (leaf, off, main, low, text), and (node, depth, children with text) of all elements that have some.  ``main`` is
    the number from 1 of the innermost ``article`` or ``main``, or 0; ``around`` has the number of the one around each."""

    blocks: list[tuple[int, bool, int, bool, str]] = field(default_factory=list)
    around: list[int] = field(default_factory=lambda: [0])
    shapes: list[tuple[int, int, tuple[int, ...]]] = field(default_factory=list)


def is_off(tag: str, values: dict[str, str], inside: bool) -> bool:
    """Whether an element is not of the article, by tag, class and role, or id; ``inside``: inside an article already."""
    if tag in OFF_TAGS or (tag == "header" and not inside):
        return True
    if not values or tag in MAIN_TAGS or tag in ("html", "body"):
        return False
    if any(w in OFF_NAMES for k in ("class", "role") for w in _WORDS.findall(values.get(k, ""))):
        return True
    words = _WORDS.findall(values.get("id", "")) if tag in ID_TAGS else []
    return any(w in OFF_NAMES for w in words) and all(w in OFF_NAMES or w in ID_NEUTRAL for w in words)


def parse(source: str | None, removed: frozenset[int] = frozenset()) -> Page:
    """Blocks and elements of a page; ``low`` blocks are below a node of ``removed``."""
    import xxhash

    page = Page()
    if not source:
        return page
    stack = [Element("", 0, 0, False, 0, False)]
    pending: list[str] = []

    def flush() -> None:
        if pending:
            text = " ".join(entities.unescape("".join(pending)).split())
            pending.clear()
            if text:
                e = stack[-1]
                leaf = xxhash.xxh3_64_intdigest(f"{e.node}#") >> 1
                e.kids.append(leaf)
                page.blocks.append((leaf, e.off, e.main, e.low, text))

    def close(depth: int) -> None:
        if any(e.tag in BLOCK for e in stack[depth:]):
            flush()
        while len(stack) > depth:
            e, up = stack.pop(), stack[-1]
            if not e.kids:
                continue
            if e.node == up.node:  # inline, or too deep for a node of its own
                up.kids.extend(e.kids)
            else:
                page.shapes.append((e.node, e.depth, tuple(e.kids)))
                up.kids.append(e.node)

    at, end, last = 0, len(source), source.rfind(">")
    while at < end:
        m = _TAG.search(source, at) if at <= last else None
        text = source[at : m.start()] if m else _CUT.sub("", source[at:])
        if text:
            pending.append(text)
        if not m:
            break
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        block = name in BLOCK
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name:
                    close(i)
                    break
                if not block and stack[i].tag in BLOCK:
                    break
            if block:
                flush()
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(source, at)
            at = stop.end() if stop else end
            continue
        if name in VOID:
            if name == "br" or name == "hr":
                flush()
            continue
        if name in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        if name in SAME:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SAME[name]:
                    close(i)
                    break
                if stack[i].tag in HOLDS:
                    break
        up = stack[-1]
        if not block:
            if not m.group(3).endswith("/"):
                stack.append(Element(name, up.node, up.depth, up.off, up.main, up.low))
            continue
        flush()
        values = {k.lower(): _DIGITS.sub("N", a or b or c).lower() for k, a, b, c in reversed(_NAMES.findall(m.group(3)))} if m.group(3) else {}
        off = up.off or is_off(name, values, up.main)
        main = up.main
        if name in MAIN_TAGS or not main and name == "div" and any("main" in _WORDS.findall(v) for v in values.values()):
            main = len(page.around)
            page.around.append(up.main)
        node, depth = up.node, up.depth
        if depth < DEPTH:
            named = " ".join(v for _, v in sorted(values.items()))
            node, depth = xxhash.xxh3_64_intdigest(f"{up.node}/{name}.{named}") >> 1, depth + 1
        stack.append(Element(name, node, depth, off, main, up.low or node in removed))
    flush()
    close(1)
    if stack[0].kids:
        page.shapes.append((0, 0, tuple(stack[0].kids)))
    return page


def main_text(page: Page) -> str:
    """Blocks that belong to the article: of what names and importance leave, all of each ``article`` or ``main`` that is there, or else
    everything."""
    found = {main for _, off, main, low, _ in page.blocks if main and not off and not low} or {main for _, off, main, _, _ in page.blocks if main and not off}
    for main in list(found):
        while (main := page.around[main]) and main not in found:
            found.add(main)
    return " ".join(t for _, off, main, low, t in page.blocks if not off and (main in found if found else not low))


def host_of(url: Column) -> Column:
    """Host of an address, empty where it has none."""
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


# Kinds of rows: pages that have a node; pages by its child sequence; parts that children have in it; pages by a leaf's block.
PRESENT, SHAPE, CHILD, CONTENT = 0, 1, 2, 3


def features(page: Page) -> dict[tuple[int, int, int, int], int]:
    """{(node, depth, kind, feature): count} of one page."""
    import xxhash

    out: dict[tuple[int, int, int, int], int] = {}
    depths = {}
    for node, depth, kids in page.shapes:
        out[node, depth, PRESENT, 0] = 1
        out[node, depth, SHAPE, hash(kids) & 0x7FFFFFFFFFFFFFFF] = 1
        for k in kids:
            key = (node, depth, CHILD, k)
            out[key] = out.get(key, 0) + PART // len(kids)
            depths[k] = depth + 1
    for leaf, _, _, _, text in page.blocks:
        out[leaf, depths[leaf], PRESENT, 0] = 1
        out[leaf, depths[leaf], CONTENT, xxhash.xxh3_64_intdigest(text) >> 1] = 1
    return out


def node_counts(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(host, node, depth, kind, feature, count) of a task's pages, added up inside the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def table() -> pa.RecordBatch:
            rows = list(counts.items())
            counts.clear()
            cols = list(zip(*[k for k, _ in rows], strict=True)) or [[], [], [], [], []]
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], pa.array([n for _, n in rows], pa.int64())], names=["host", "node", "depth", "kind", "feature", "count"])

        for batch in batches:
            for part in rows_of(batch, 1):
                for h, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for key, n in features(parse(source)).items():
                        counts[(h, *key)] += n
                    if len(counts) > 300_000:
                        yield table()
        yield table()

    return pages.select(host, html).mapInArrow(tidy(run), "host string, node long, depth int, kind int, feature long, count long")


def own_importance(each: DataFrame) -> DataFrame:
    """(host, node, depth, m, l, own): pages, child sequences (0 for a leaf), and presentation or content importance."""
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0.0))
    c = F.col("count").cast("double")
    sums = each.where(F.col("kind") != CHILD).groupBy("host", "node", "depth").agg(
        of(PRESENT, c).alias("m"), of(SHAPE, F.lit(1.0)).alias("l"), of(SHAPE, c).alias("s"), of(SHAPE, c * F.log(c)).alias("slog"), of(CONTENT, F.lit(1.0)).alias("n"), of(CONTENT, F.log(c)).alias("clog")
    )
    whole = F.log(F.when(F.col("m") > 1, F.col("m")))
    shape = F.coalesce(F.least((F.log("s") - F.col("slog") / F.col("s")) / whole, F.lit(1.0)), F.lit(1.0))
    content = F.coalesce(F.greatest(1 - F.col("clog") / F.col("n") / whole, F.lit(0.0)), F.lit(1.0))
    return sums.select("host", "node", "depth", F.col("m").cast("long").alias("m"), "l", F.when(F.col("l") > 0, shape).otherwise(content).alias("own"))


def importance(counts: DataFrame, space: Workspace) -> DataFrame:
    """(host, node, depth, m, importance, most): composite importance, and the largest one at or below the node.  Node 0 is the whole page."""
    each = space.put("each", counts.groupBy("host", "node", "depth", "kind", "feature").agg(F.sum("count").alias("count")))
    own = space.put("own", own_importance(each))
    links = each.where(F.col("kind") == CHILD).select("host", "node", "depth", F.col("feature").alias("child"), F.col("count").alias("share"))
    deepest = own.agg(F.max("depth")).first()[0]
    levels = []
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        here = own.where(F.col("depth") == depth)
        if levels:
            below = levels[-1].select("host", F.col("node").alias("child"), "importance", "most")
            means = links.where(F.col("depth") == depth).join(below, ["host", "child"]).groupBy("host", "node").agg((F.sum(F.col("share") * F.col("importance")) / F.sum("share")).alias("mean"), F.max("most").alias("inside"))
            here = here.join(means, ["host", "node"], "left")
        else:
            here = here.withColumns({"mean": F.lit(None).cast("double"), "inside": F.lit(None).cast("double")})
        kept = F.pow(F.lit(GAMMA), "l")
        here = here.withColumn("importance", F.coalesce((1 - kept) * F.col("own") + kept * F.col("mean"), "own"))
        levels.append(space.put(f"level{depth}", here.select("host", "node", "depth", "m", "importance", F.greatest("importance", "inside").alias("most"))))
    if not levels:
        return own.select("host", "node", "depth", "m", F.col("own").alias("importance"), F.col("own").alias("most"))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def unimportant(scores: DataFrame, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, node) to remove."""
    site = scores.where("node = 0").select("host", F.col("importance").alias("site"))
    return scores.where((F.col("node") != 0) & (F.col("m") >= min_pages)).join(site, "host").where(F.col("most") < threshold * F.col("site")).select("host", "node")


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> tuple[DataFrame, str]:
    """``pages`` with a column of main text; also its name."""
    space = Workspace(pages.sparkSession)
    key, host = free_name(pages.columns, "page_host"), free_name(pages.columns, "low_host")
    keyed = pages.withColumn(key, host_of(F.col(url)))
    low = space.put("low", unimportant(importance(node_counts(keyed, key, html), space)))
    n = low.count()
    nodes = free_name(pages.columns, "low_nodes")
    lists = low.groupBy("host").agg(F.array_sort(F.collect_list("node")).alias(nodes)).withColumnRenamed("host", host)
    if n:
        joined = keyed.join(F.broadcast(lists) if n <= BROADCAST_NODES else lists, keyed[key] == lists[host], "left").select(*[keyed[c] for c in pages.columns], nodes)
    else:
        joined = pages.withColumn(nodes, F.lit(None).cast("array<long>"))

    def make():
        known: dict[tuple, frozenset] = {}

        def step(sources: pa.Array, lows: pa.Array) -> list:
            out = []
            for s, x in zip(sources.to_pylist(), lows.to_pylist(), strict=True):
                key = tuple(x or ())
                if key not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[key] = frozenset(key)
                out.append(main_text(parse(s, known[key])))
            return [pa.array(out, pa.string())]

        return step

    out, (name,) = append(joined, [html, nodes], make, [("main_text", "string")])
    return out.select(*pages.columns, name), name
