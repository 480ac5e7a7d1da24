"""Main-text extraction with a tree-structured model over the blocks of a page."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govgraph.llm.common import checked_broadcast, stored

# Bound of the labelled sample: pages with an article or main element, by the hash of their id.
SAMPLE_PAGES = 2_000

# Elements by their role in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe svg math title textarea select option button object canvas".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark output q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr img picture meter progress".split()
)
CONTENT_TAGS = {"article", "main"}
SIDE_TAGS = set("nav header footer aside form dialog menu fieldset figcaption".split()) - {"figcaption"}
PARAGRAPH_ENDERS = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
SIDE_NAMES = set(
    "ad ads advert adverts advertisement sponsored sponsor promo banner cookie cookies consent notice alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside rail widget footer header masthead topbar toolbar "
    "comment comments reply replies disqus discussion respond share sharing social related recommended newsletter subscribe "
    "subscription signup login search form pagination pager tags toc skip copyright legal".split()
)
PROSE = set("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
LISTS = set("li dd dt td th caption figcaption".split())
MAIN_NAMES = set("article content main post story entry body text".split())

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<(?P<raw>script|style)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>(?:.*?</(?P=raw)\s*[^>]*>|.*)"
    r"|</(?P<end>[a-z][^\s/>]*)[^>]*+>"
    r"|<(?P<tag>[a-z][^\s/>]*)(?P<more>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<[!?/][^>]*+>",
    re.IGNORECASE | re.DOTALL,
)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
PART = re.compile(r"[a-z]+")

OTHER, CONTENT = 0, 1


class Block:
    """An element that is a node of the model; ``text`` holds its own inline text by position in the page."""

    __slots__ = ("tag", "parent", "names", "letters", "linked")

    def __init__(self, tag: str, parent: int, names: str):
        self.tag, self.parent, self.names = tag, parent, names
        self.letters = self.linked = 0


def parse(page: str) -> tuple[list[Block], list[tuple[int, str]]]:
    """The blocks of a page, parents first, and its text runs as ``(block, text)``.

    A run ``(block, " ")`` marks the edge of a block or a line break. Text that no reader sees
    (script, style, title, form controls) is left out; missing end tags are implied.
    """
    blocks = [Block("#page", -1, "none")]
    runs: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("#page", 0)]
    links = hidden = at = 0

    def close(position: int) -> None:
        nonlocal links, hidden
        for tag, _ in stack[position:]:
            links -= tag == "a"
            hidden -= tag in RAW
        del stack[position:]

    def last(tags: set[str], stop: set[str]) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in stop:
                break
        return 0

    def put(text: str) -> None:
        if text and not hidden:
            block = stack[-1][1]
            text = html.unescape(text)
            runs.append((block, text))
            n = len(text) - text.count(" ")
            blocks[block].letters += n
            if links:
                blocks[block].linked += n

    for m in TOKEN.finditer(page):
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        if tag := m["tag"]:
            tag = tag.lower()
            if hidden and tag not in RAW:
                continue
            if tag in PARAGRAPH_ENDERS and (p := last({"p"}, {"table", "button", "#page"})):
                close(p)
            elif tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
                same = {"dd", "dt"} if tag in ("dd", "dt") else {"td", "th"} if tag in ("td", "th") else {tag}
                if p := last(same, {"ul", "ol", "dl", "table"} if tag != "tr" else {"table"}):
                    close(p)
            if tag == "br":
                runs.append((stack[-1][1], " "))
            if tag in VOID or m["more"].rstrip().endswith("/") and tag in ("svg", "math"):
                continue
            block = stack[-1][1]
            if tag not in INLINE:
                blocks.append(Block(tag, block, _name_group(m["more"])))
                block = len(blocks) - 1
                runs.append((block, " "))
            stack.append((tag, block))
            links += tag == "a"
            hidden += tag in RAW
        elif end := m["end"]:
            end = end.lower()
            if hidden and end not in RAW:
                continue
            if p := last({end}, {"table"} if end in INLINE or end == "p" else set()):
                close(p)
                if end not in INLINE:
                    runs.append((stack[-1][1], " "))
    put(page[at:])
    return blocks, runs


def _name_group(more: str) -> str:
    if "=" not in more:
        return "none"
    parts: set[str] = set()
    for found in NAMES.findall(more):
        parts.update(PART.findall("".join(found).lower()))
    if parts & SIDE_NAMES:
        return "side"
    return "main" if parts & MAIN_NAMES else "other" if parts else "none"


def features(block: Block) -> tuple[tuple[str, str], ...]:
    """What the model sees of a block: element, names, length of its own text, part of it that is linked."""
    tag = block.tag
    group = "side" if tag in SIDE_TAGS else "content" if tag in CONTENT_TAGS else "raw" if tag in RAW else "plain"
    out = [("group", group), ("names", block.names)]
    if block.letters:
        out.append(("length", str(min(7, int(math.log2(block.letters + 1) / 1.5)))))
        out.append(("linked", str(min(2, 3 * block.linked // block.letters))))
        if tag not in LISTS:
            out.append(("tag", tag if tag in PROSE else "other"))
    return tuple(out)


def kind(block: Block) -> str:
    """What a block is to its children: the edge of a side part, of the content, or neither."""
    if block.tag in SIDE_TAGS or block.tag in RAW or block.names == "side":
        return "side"
    return "content" if block.tag in CONTENT_TAGS else "plain"


def labels(blocks: list[Block]) -> list[int] | None:
    """Labels that a page's own markup states; None where it has no article or main element."""
    if not any(b.tag in CONTENT_TAGS for b in blocks):
        return None
    out: list[int] = []
    for b in blocks:
        above = out[b.parent] if b.parent >= 0 else OTHER
        out.append({"side": OTHER, "content": CONTENT, "plain": above}[kind(b)])
    return out


# What is believed before any page is seen, as counts of (feature, value, label) and, for the
# potentials of parent and child, of (kind of the parent, label of the parent, label of the child).
PRIOR = {
    ("group", "side", OTHER): 50.0, ("group", "content", CONTENT): 50.0, ("group", "raw", OTHER): 50.0,
    ("group", "plain", OTHER): 50.0, ("group", "plain", CONTENT): 50.0,
    ("names", "side", OTHER): 50.0, ("names", "main", CONTENT): 20.0, ("names", "main", OTHER): 2.0,
    ("names", "none", OTHER): 50.0, ("names", "none", CONTENT): 50.0,
    ("names", "other", OTHER): 20.0, ("names", "other", CONTENT): 20.0,
    ("above side 0", "", OTHER): 50.0, ("above side 1", "", OTHER): 50.0,
    ("above plain 0", "", OTHER): 50.0, ("above plain 0", "", CONTENT): 5.0,
    ("above content 0", "", OTHER): 50.0,
    ("above plain 1", "", CONTENT): 50.0, ("above content 1", "", CONTENT): 50.0,
}
# The share that values never seen with a label keep, by feature; and a child that differs from its parent.
UNSEEN = {"group": 1e-6, "names": 1e-4}
UNSEEN_ELSE, LEAST_TURN, LEAST_SIDE_TURN = 0.03, 0.05, 1e-6


def count_labelled(pages: list[str | None]) -> Counter:
    """Counts for the potentials from the pages that state their labels."""
    out: Counter = Counter()
    for page in pages:
        blocks, _ = parse(page or "")
        known = labels(blocks)
        if known is None:
            continue
        for b, y in zip(blocks, known, strict=True):
            if b.parent >= 0:
                out[(f"above {kind(blocks[b.parent])} {known[b.parent]}", "", y)] += 1
            for name, value in features(b):
                out[(name, value, y)] += 1
    return out


def potentials(counts: dict) -> dict:
    """Log-potentials for every feature value, and a probability for every kind and label of a parent."""
    total: dict = Counter()
    for key, n in [*PRIOR.items(), *counts.items()]:
        total[key] += n
    sums: Counter = Counter()
    for (name, _, y), n in total.items():
        sums[(name, y)] += n
    unary = {}
    for name, value in {(n, v) for n, v, _ in total if not n.startswith("above")}:
        least = UNSEEN.get(name, UNSEEN_ELSE)
        unary[(name, value)] = tuple(
            math.log(max(total[(name, value, y)] / max(sums[(name, y)], 1.0), least)) for y in (OTHER, CONTENT)
        )
    pair = {}
    for about in ("side", "plain", "content"):
        for above in (OTHER, CONTENT):
            name = f"above {about} {above}"
            other, content = total[(name, "", OTHER)], total[(name, "", CONTENT)]
            least = LEAST_SIDE_TURN if about == "side" else LEAST_TURN
            share = min(max(content / max(other + content, 1.0), least), 1.0 - least)
            pair[(about, above)] = (1.0 - share, share)
    return {"unary": unary, "pair": pair}


def marginals(blocks: list[Block], model: dict) -> list[float]:
    """P(content) of every block: messages from the leaves to the root and back (sum-product)."""
    unary, pair = model["unary"], model["pair"]
    n = len(blocks)
    up: list[list[float]] = []
    for b in blocks:
        a = c = 0.0
        for f in features(b):
            x = unary.get(f)
            if x:
                a += x[0]
                c += x[1]
        top = max(a, c)
        up.append([math.exp(a - top), math.exp(c - top)])
    ways = [(pair[(k, OTHER)], pair[(k, CONTENT)]) for k in map(kind, blocks)]
    sent: list[tuple[float, float]] = [(1.0, 1.0)] * n
    for i in range(n - 1, 0, -1):
        a, c = up[i]
        parent = blocks[i].parent
        (oo, oc), (co, cc) = ways[parent]
        to_other, to_content = a * oo + c * oc, a * co + c * cc
        scale = to_other + to_content
        sent[i] = (to_other / scale, to_content / scale)
        above = up[parent]
        above[0] *= sent[i][0]
        above[1] *= sent[i][1]
        scale = above[0] + above[1] or 1.0
        above[0] = max(above[0] / scale, 1e-200)
        above[1] = max(above[1] / scale, 1e-200)
    belief: list[tuple[float, float]] = [(1.0, 0.0)] * n  # the page itself is no content
    out = [0.0] * n
    for i in range(1, n):
        parent = blocks[i].parent
        (oo, oc), (co, cc) = ways[parent]
        a, c = belief[parent]
        a, c = a / max(sent[i][0], 1e-200), c / max(sent[i][1], 1e-200)
        x = up[i][0] * (a * oo + c * co)
        y = up[i][1] * (a * oc + c * cc)
        scale = x + y or 1.0
        belief[i] = (x / scale, y / scale)
        out[i] = y / scale
    return out


def main_text(page: str | None, model: dict) -> str:
    """The text of all blocks that are more likely content than not, in page order."""
    if not page:
        return ""
    blocks, runs = parse(page)
    chosen = [p > 0.5 for p in marginals(blocks, model)]
    return " ".join("".join(t if chosen[b] else " " for b, t in runs).split())


def train(pages: DataFrame, sample: int = SAMPLE_PAGES) -> dict:
    """Potentials from at most ``sample`` pages that have an article or main element.

    Counts are summed in Spark; their number is bounded by the fixed feature values.
    """
    rows = pages.where(F.lower("html").rlike("<(article|main)\\b"))
    mark = F.xxhash64("page_id")
    ids = stored(
        rows.groupBy(F.pmod(mark, F.lit(sample)).alias("slot"))
        .agg(F.min_by("page_id", F.struct(F.xxhash64("page_id", F.lit(1)), "page_id")).alias("page_id"))
        .select("page_id"),
        "page-sample",
    )

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = count_labelled(list(part["html"]))
            yield pd.DataFrame(
                [(n, v, y, float(c)) for (n, v, y), c in found.items()], columns=["name", "value", "y", "c"]
            )

    counts = (
        rows.join(checked_broadcast(ids), "page_id", "left_semi").select("html")
        .mapInPandas(count, "name string, value string, y int, c double")
        .groupBy("name", "value", "y").agg(F.sum("c").alias("c")).collect()
    )
    return potentials({(r["name"], r["value"], r["y"]): r["c"] for r in counts})


def extracted(pages: DataFrame, model: dict) -> Column:
    """A column with the main text of the ``html`` column of ``pages``."""
    known = pages.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([main_text(p, known.value) for p in part], dtype=object)

    return run(F.col("html"))


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per page, on whole pages.

    Null and empty html give an empty text; repeated rows get the same text; an empty table gives no rows;
    a page without any block that looks like content gives an empty text.
    """
    model = train(pages)
    out = pages.select("page_id", "url", extracted(pages, model).alias("text"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
