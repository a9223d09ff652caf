"""HTML extraction by tag-path ratios (operator 8).

A page is cut into blocks of text, each with its root-to-leaf path of block tags; nested boilerplate elements (menus, adverts,
forms, comments, ..., by tag or by a whole class, id or role token) are left out, unless one holds the text of the page. The container with the most text of high ratio holds the article. Per tag path in it,
characters and punctuation a block are fused by product and smoothed along the tree, by sharing them with the box (div,
section, ...) that the path hangs from; blocks that are all links count nothing. Paths above the threshold, a share of the best
path's score, are content; the others (unnamed adverts, link lists) are not, unless they are sentences inside an article or main: there
nothing that reads as text is dropped for being short or a link. On pages without article or main,
boxes around the best container join it if their paths' scores compare with its best one.

Pages are independent rows: Spark deals them out, nothing is shuffled, and a task holds one Arrow batch.

Defined results: null or empty html, and pages without text, give an empty text; very long pages are treated whole; broken
markup never fails: unclosed elements end with their parent (an unclosed svg, select, template or other unseen element holds
nothing), stray end tags are dropped, a quote outside an attribute's value is a character, and only a script or style without
an end takes the rest of the page with it; repeated rows give repeated results; null page ids and urls are kept; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The start of a comment, a declaration, or a tag. A quote opens a value only after =.
TOKEN = re.compile(r"<!--|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>")
#: Elements whose content is not markup. Without an end tag a script or style runs to the end of the page; of the others only the tag goes.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.I) for t in "script style textarea title iframe noembed noframes xmp".split()}
#: Elements that a block's opening tag ends, as in browsers' foreign content.
LEFT_BY_BLOCKS = set("svg math select".split())
NAMED = re.compile(r"(?<!\S)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that an opening tag ends, unless one of the bounds comes first.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOUNDS = set("ul ol dl table article section div main body td th blockquote nav aside footer header form".split())
#: Not believed of an element that holds the text of the page, nor is a name; the other tags always are.
DOUBTFUL_TAGS = set("header aside form".split())
BOILERPLATE_TAGS = DOUBTFUL_TAGS | set("nav footer button input select noscript menu dialog template head svg math object canvas audio video datalist".split())
BOILERPLATE_NAMES = re.compile(
    r"(?<!\S)(?:ads?|advert\w*|banner|breadcrumbs?|comments?|comment-?list|cookies?|disqus|footer|header|masthead|menu|modal|nav\w*|newsletter|notices?"
    r"|pagination|popup|promo\w*|related|replies|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?!\S)", re.I,
)
#: Boilerplate elements with content that is never shown as text, or not as the page's.
UNSEEN = set("svg math select template noscript object button canvas audio video datalist dialog menu".split())
BREAKOUT = set("p div h1 h2 h3 h4 h5 h6 ul ol dl li table section article main blockquote pre nav aside header footer form".split())
CONTAINERS = set("article main section div td body blockquote".split())
#: Elements that hold something of their own; lists, tables, quotations and figures belong to what they stand in.
BOXES = set("article main section div body".split())
#: Measure of a container that may be the text of a page against its name: that of a line of 200 characters without punctuation.
MUCH = 200.0 * 200
#: The end of a sentence; an exclamation alone is none, since adverts shout.
SENTENCE = re.compile(r"[.?…:;。？][\"'”’»)\]]*\s*$")
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
PUNCTUATION = re.compile(r"[.,;:!?…。、，]")
WHITE = re.compile(r"\s+")


def text_nodes(page: str) -> list[tuple[tuple, int, str]]:
    """(path of (tag, serial, boilerplate) from the root, block number, raw text), in page order. boilerplate: 2 certain, 1 doubtful, 0 no."""
    out, stack, serial, block, at = [], [], 0, 0, 0

    def text(s: str) -> None:
        if s:
            out.append((tuple(stack), block, s))

    last: dict[str, int] = {}

    def closed(mark: str) -> bool:
        """Whether the mark (an end tag's start) occurs from here on; each mark is looked for once a page."""
        if mark not in last:
            last[mark] = max((x.start() for x in re.finditer(re.escape(mark), page, re.I)), default=-1)
        return last[mark] >= at

    while m := TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m[0] == "<!--":  # to the next -->, or to the next > where none comes
            end = page.find("-->", at) + 3 if closed("-->") else page.find(">", at) + 1
            at = max(at, end)
            continue
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            block += 1
        elif tag in ("br", "img"):
            out.append((tuple(stack), block, " "))
        if m[1]:
            if any(t == tag for t, _, _ in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag in RAW:
            end = RAW[tag].search(page, at) if closed("</" + tag) else None
            at = end.end() if end else len(page) if tag in ("script", "style") else at
            continue
        if tag in VOID:
            continue
        gone = ENDS.get(tag, ("p",) if tag not in INLINE else ())
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in gone:
                del stack[k:]
                break
            if stack[k][0] in BOUNDS:
                break
        if tag in BREAKOUT and (left := next((k for k, e in enumerate(stack) if e[0] in LEFT_BY_BLOCKS), None)) is not None:
            del stack[left:]
        if m[3].rstrip().endswith("/") and tag not in ("p", "div"):
            continue
        if tag in UNSEEN and not closed("</" + tag):
            continue  # never closed: it must not take what follows with it
        serial += 1
        names = " ".join(x or y or z for x, y, z in NAMED.findall(m[3])) if "=" in m[3] else ""
        inside = any(t in ("article", "main") for t, _, _ in stack)
        bad = 0
        if tag in BOILERPLATE_TAGS and not (tag == "header" and inside):
            bad = 1 if tag in DOUBTFUL_TAGS else 2
        elif names and tag not in ("body", "html", "article", "main") and BOILERPLATE_NAMES.search(names):
            bad = 1
        stack.append((tag, serial, bad))
    text(page[at:])
    return out


def ratio(chars: float, marks: float, blocks: float) -> float:
    """Characters a block times punctuation a block; both are bounded, so that one long listing does not dwarf the paragraphs."""
    return min(chars / blocks, 200) * (1 + min(marks / blocks, 4))


def best_container(blocks: list) -> tuple[tuple, float]:
    """The container (or doubtful element) with the most text of high ratio, and that measure."""
    held: dict[tuple, float] = {}
    for path, _, c, q, link in blocks:
        box = path[: next((k + 1 for k in range(len(path) - 1, -1, -1) if path[k][2] or path[k][0] in CONTAINERS), 0)]
        held[box] = held.get(box, 0.0) + (0 if link else c * ratio(c, q, 1))
    best = max(held, key=lambda b: (held[b], -len(b)), default=())
    return best, held.get(best, -1.0)


def extract(page: str | None, threshold: float = 0.2, smoothing: float = 0.5, grow: float = 0.3, doubt: float = 4.0) -> str:
    nodes = [x for x in text_nodes(page or "") if not any(bad == 2 for _, _, bad in x[0])]
    # Blocks: path of block elements, text, characters, punctuation, and whether all of it is links (a heading may be one).
    found = []
    for (_, doubts), run in groupby(nodes, key=lambda x: (x[1], tuple(n for _, n, bad in x[0] if bad))):
        run = [(path, html.unescape(s)) for path, _, s in run]
        chars = sum(len(s.strip()) for _, s in run)
        if chars:
            path = tuple(e for e in next(p for p, s in run if s.strip()) if e[0] not in INLINE)
            linked = sum(len(s.strip()) for p, s in run if any(e[0] == "a" for e in p))
            said = "".join(s for _, s in run)
            link = linked >= 0.8 * chars and not any(e[0] in HEADINGS for e in path) and not (path and path[-1][0] == "p" and SENTENCE.search(said))
            found.append((doubts, (path, said, chars, sum(len(PUNCTUATION.findall(s)) for _, s in run), link)))
    # Doubtful elements are boilerplate, unless one holds an article or much text, and far more than any container elsewhere.
    blocks = [b for doubts, b in found if not doubts]
    best, most = best_container(blocks)
    most_of_all, value = best_container([b for _, b in found])
    right = {n for _, n, bad in most_of_all if bad}
    article = lambda box: any(t in ("article", "main") for t, _, _ in box)
    if right and value > doubt * most and (article(most_of_all) or value >= MUCH and not article(best)):
        blocks = [b for doubts, b in found if right.issuperset(doubts)]
        best, _ = best_container(blocks)
    if not blocks:
        return ""
    # The article is the outermost article or main element above the best container; without one, the best container and what it grows to.
    root = next((best[: k + 1] for k, (t, _, _) in enumerate(best) if t in ("article", "main")), best)
    alone = not article(root)
    within = [b[0][: len(root)] == root for b in blocks]
    if not alone:
        blocks = [b for b, i in zip(blocks, within, strict=True) if i]
        within = [True] * len(blocks)
    # Totals per tag path; blocks of links are a path of their own, and worth nothing.
    keys = [(tuple(t for t, _, _ in path), link) for path, _, _, _, link in blocks]
    paths: dict[tuple, list[float]] = {}
    for key, (_, _, c, q, _) in zip(keys, blocks, strict=True):
        p = paths.setdefault(key, [0.0, 0.0, 0.0])
        p[0], p[1], p[2] = p[0] + c, p[1] + q, p[2] + 1
    own = {k: 0.0 if k[1] else ratio(*p) for k, p in paths.items()}
    # The ratio of a box, one element: the mean over the text in it, by characters. What surrounds the root counts by its own text only.
    boxes: dict[tuple, list[float]] = {}
    nearest = []
    for key, (path, _, c, _, _), i in zip(keys, blocks, within, strict=True):
        ends = [d for d in range(len(path), -1, -1) if (d >= len(root) if i else True) and (d == (len(root) if i else 0) or path[d - 1][0] in (BOXES if i else CONTAINERS))]
        nearest.append((i, path[: ends[0]]))
        for d in ends:
            if i or d == ends[0] or path[:d] != root[:d]:
                b = boxes.setdefault((i, path[:d]), [0.0, 0.0])
                b[0], b[1] = b[0] + c * own[key], b[1] + c
    mean = {b: value / chars for b, (value, chars) in boxes.items()}
    smooth = [0.0 if key[1] else (1 - smoothing) * own[key] + smoothing * mean[b] for key, b in zip(keys, nearest, strict=True)]
    top = max(v for v, i in zip(smooth, within, strict=True) if i)
    # The root grows over boxes whose paths compare with its best one, and that have some ratio themselves.
    # In an article or main a sentence stays, however short its path's text is: the threshold decides about what is none.
    whole = [not alone and not key[1] and bool(SENTENCE.search(said)) for key, (_, said, *_) in zip(keys, blocks, strict=True)]
    kept = [w or v >= threshold * top if i else not key[1] and v >= grow * top and mean[b] >= grow / 2 * top for v, key, b, i, w in zip(smooth, keys, nearest, within, whole, strict=True)]
    if alone:
        # Around the root a heading goes with what it heads, and the last h1 before the root is its headline.
        heads = [k for k, (tags, _) in enumerate(keys) if not within[k] and any(t in HEADINGS for t in tags)]
        for k in reversed(heads):
            kept[k] = kept[k] or k + 1 < len(kept) and kept[k + 1]
        for k in [k for k in heads if k < within.index(True) and "h1" in keys[k][0]][-1:]:
            kept[k] = True
    lines = (WHITE.sub(" ", text).strip() for k, (_, text, *_) in zip(kept, blocks, strict=True) if k)
    return "\n".join(x for x in lines if x)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""

    def run(batches):
        for b in batches:
            out = [extract(x) for x in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": out, "n_chars": [len(x) for x in out]})

    src = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    return src.mapInPandas(run, "page_id bigint, url string, text string, n_chars bigint")
