"""Main text of web pages by nearest-URL page differencing.

Pages are paired with their NEAR neighbours on either side in the order of URL paths within a host; the text
lines (blocks) of a pair are aligned by their longest common subsequence. A line that at least half of the
different neighbours share (two of them, where there are two) is template, not text, and goes. Neighbours with
the same lines throughout are copies and don't count, so a page among its copies keeps its text; and if nearly
all open lines would go (COPY), the page is taken for a near copy of its neighbours and keeps them. Markup is a hint either way: containers that name themselves as
menus, headers, footers, sidebars, notices, adverts, forms or comments go whatever the neighbours hold, and
where an element names the article (article, main) its lines are the text, even if shared.

The order by host and path is made by range partitions of narrow rows (hashes of lines); neighbours inside a
partition come from a window over the partition, those across a border from the borders' rows alone, so one
host with most pages is no hot key and the result doesn't depend on where borders fall.

A null or empty page gives an empty text. A null URL has the empty host and path. Repeated rows are one page
among neighbours and get the same result each. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxcohort.llm.grouped import slices
from voxcohort.plans.storage import small_or_not, stored

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
RAW = frozenset("script style noscript template iframe object textarea svg math title select xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
SPACE = frozenset("br td th".split())
AWAY = frozenset("nav header footer aside form menu dialog search button".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising)?|sponsor(?:ed)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notices?|alert|newsletter|subscri(?:be|ption)|signup|popup|modal|overlay|side-?bar|menu|nav(?:bar|igation)?|breadcrumbs?|header|footer|masthead|comments?|disqus|respond|replies|share|sharing|social|related|recommend(?:ed|ations?)?|widgets?|toolbar|paginat(?:ion|or)|pager|login|search|skip|legal|copyright)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Pages on either side, in the order of URLs, that a page is compared with.
NEAR = 3
#: Share of a page's open lines beyond which shared lines are copied text, not template.
COPY = 0.8


@dataclass
class Line:
    text: str
    away: bool  # in a container that names itself as something else than the article
    main: bool  # in an element that names the article


def _named_away(tag: str, rest: str) -> bool:
    if not rest:
        return False
    for m in ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if name in ("class", "id"):
            if NAMES.search(value):
                return True
        elif name == "role":
            if value.strip().lower() in ROLES:
                return True
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        elif name == "hidden" or value.lower() == "true":
            return True
    return False


def lines(page: str | None) -> list[Line]:
    """The page's blocks in order, white space made one space; empty ones are left out."""
    page = page or ""
    out: list[Line] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, away, main
    away = main = False
    at = 0

    def close() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append(Line(text, away, main))

    while m := TOKEN.search(page, at):
        held.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in RAW and not m[1]:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            held.append(" " if tag not in ("svg", "math") else "")
            continue
        if tag in SPACE:
            held.append(" ")
        if tag not in BLOCK and tag not in ("span", "button", "a"):
            continue
        if tag in BLOCK:
            close()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        elif tag not in VOID and not m[3].endswith("/"):
            if tag in BLOCK and stack and stack[-1][0] == "p":
                stack.pop()
            if tag in ("article", "main"):
                while stack and stack[-1][1] and any(s[0] in ("nav", "header", "menu") for s in stack) and not main:
                    stack.pop()  # a menu or header that was never closed
            inside = bool(stack) and stack[-1][2]
            gone = bool(stack) and stack[-1][1]
            if tag in ("article", "main"):
                named = bool(stack) and not gone and inside and _named_away("div", m[3])
            elif tag in ("html", "body", "head"):
                named = False
            else:
                named = (tag in AWAY and not (tag == "header" and inside)) or _named_away(tag, m[3])
            stack.append((tag, gone or named, inside or tag in ("article", "main")))
        now = (bool(stack) and stack[-1][1], bool(stack) and stack[-1][2])
        if now[0] != away and tag not in BLOCK:
            close()  # an inline container that goes is a line of its own
        away, main = now
    held.append(page[at:])
    close()
    return out


def line_hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode())
    return h - (1 << 64) if h >> 63 else h


def common(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence with b: the longest rising run over b's places."""
    places = defaultdict(list)
    for j, x in enumerate(b):
        places[x].append(j)
    tails: list[int] = []
    nodes: list[tuple[int, int]] = []  # place in a, node before
    at: list[int] = []
    for i, x in enumerate(a):
        for j in reversed(places.get(x, ())):
            k = bisect_left(tails, j)
            nodes.append((i, at[k - 1] if k else -1))
            if k == len(tails):
                tails.append(j)
                at.append(len(nodes) - 1)
            else:
                tails[k], at[k] = j, len(nodes) - 1
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(nodes[n][0])
        n = nodes[n][1]
    return out[::-1]


def shared(own: list[int], flags: list[int], neighbours: list[list[int]]) -> list[int]:
    """Places of the lines to delete as shared. flags: 0 open, 1 in a container that goes, 2 in the article."""
    others = [list(o) for o in {tuple(o) for o in neighbours if o and o != own}]
    votes = [0] * len(own)
    for other in others:
        for i in common(own, other):
            votes[i] += 1
    need = max(min(2, len(others)), -(-len(others) // 2))
    gone = [i for i, v in enumerate(votes) if others and v >= need and flags[i] != 2]
    open_ = flags.count(0)
    if sum(flags[i] == 0 for i in gone) > COPY * open_:
        gone = [i for i in gone if flags[i] == 1]
    return gone


def _host_and_path(url: str) -> list:
    u = F.coalesce(F.col(url), F.lit(""))
    return [F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("host"), F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path")]


def _outlines(pages: DataFrame) -> DataFrame:
    """row, host, path, own (line hashes), flags of the pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "html"):
                parsed = [lines(h.as_py()) for h in b.column("html")]
                own = pa.array([[line_hash(x.text) for x in p] for p in parsed], pa.list_(pa.int64()))
                flags = pa.array([[1 if x.away else 2 * x.main for x in p] for p in parsed], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "host", "path")), own, flags], ["row", "host", "path", "own", "flags"])

    return pages.mapInArrow(run, "row long, host string, path string, own array<long>, flags array<int>")


def template_lines(pages: DataFrame) -> DataFrame:
    """row, gone (places of lines shared with a neighbour), of the rows that have any; pages: row, host, path, html."""
    order = ("host", "path", "row")
    narrow = _outlines(pages).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    narrow = stored(narrow, "page-lines")
    within = Window.partitionBy("part").orderBy(*order)
    # Equal rows have equal keys, so they are in one part, one after another.
    narrow = narrow.withColumn("_before", F.lag("row").over(within)).filter(~F.col("row").eqNullSafe(F.col("_before"))).drop("_before")
    me = F.struct("host", "own")
    near = narrow.select("*", F.array(*(F.lag(me, i).over(within) for i in range(NEAR, 0, -1))).alias("up"), F.array(*(F.lead(me, i).over(within) for i in range(1, NEAR + 1))).alias("down"))
    # The first and last rows of every part, for its neighbours: a few rows a part, met in one task.
    back = Window.partitionBy("part").orderBy(*(F.col(c).desc() for c in order))
    edge = narrow.select("part", *order, "own", F.row_number().over(within).alias("_i"), F.row_number().over(back).alias("_j")).filter((F.col("_i") <= NEAR) | (F.col("_j") <= NEAR))
    edge = stored(edge, "page-edges")
    along = Window.orderBy("part", *order)
    last = lambda rows, w: F.collect_list(F.when(rows, me)).over(w)
    edge = edge.select("part", last(F.col("_j") <= NEAR, along.rowsBetween(-2 * NEAR * NEAR, -1)).alias("_u"), last(F.col("_i") <= NEAR, along.rowsBetween(1, 2 * NEAR * NEAR)).alias("_d"), "_i", "_j")
    up = edge.filter("_i = 1").select("part", F.expr(f"slice(_u, greatest(1, size(_u) - {NEAR - 1}), {NEAR})").alias("_up"))
    down = edge.filter("_j = 1").select("part", F.expr(f"slice(_d, 1, {NEAR})").alias("_down"))
    near = near.join(F.broadcast(up), "part").join(F.broadcast(down), "part")
    # A row short of neighbours in its part takes those of the parts beside it that are nearest.
    have = lambda c: F.filter(c, lambda x: x.isNotNull())
    near = near.withColumn("_u", F.concat("_up", have(F.col("up")))).withColumn("_d", F.concat(have(F.col("down")), F.col("_down")))
    both = F.concat(F.expr(f"slice(_u, greatest(1, size(_u) - {NEAR - 1}), {NEAR})"), F.expr(f"slice(_d, 1, {NEAR})"))
    near = near.select("row", "own", "flags", F.transform(F.filter(both, lambda x: x["host"] == F.col("host")), lambda x: x["own"]).alias("others"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = b.to_pydict()
            gone = [shared(*x) for x in zip(r["own"], r["flags"], r["others"], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(gone, pa.list_(pa.int32()))], ["row", "gone"])

    return near.mapInArrow(run, "row long, gone array<int>").filter(F.size("gone") > 0)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text (blocks joined by a blank line) and n_template (lines deleted as shared) of every page."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.xxhash64(id_col, url_col, html_col).alias("row"))
    gone = stored(template_lines(rows.select("row", *_host_and_path("url"), "html")), "page-template")
    met = rows.join(small_or_not(gone.withColumnRenamed("row", "_row"), 100_000), F.col("row") == F.col("_row"), "left").select("page_id", "url", "html", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "html"):
                texts, drops = [], []
                for page, gone in zip(b.column("html").to_pylist(), b.column("gone").to_pylist(), strict=True):
                    drop, parsed = set(gone or ()), lines(page)
                    named = any(x.main and not x.away for x in parsed)
                    texts.append("\n\n".join(x.text for i, x in enumerate(parsed) if not x.away and i not in drop and (x.main or not named)))
                    drops.append(len(drop))
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(drops, pa.int64())], ["page_id", "url", "text", "n_template"])

    return met.mapInArrow(run, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_template long")
