"""HTML extraction from flat text blocks (shallow text features, Kohlschuetter et al., 2010).

A page is a row of text blocks.  Each has a word count, the share of its words in links, the same of its two neighbours,
and what encloses it; a decision tree, trained here on a small labelled table, tells which blocks are main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vecloom.llm.base import slices, small_batches

# Elements of HTML.  Text of HIDDEN ones is never shown; BLOCKS end a block of text.
HIDDEN = frozenset("script style noscript template head title iframe object svg canvas textarea select option button".split())
RAW = frozenset("script style textarea title".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CHROME = frozenset("nav footer header aside form menu dialog fieldset search".split())
MAIN = frozenset(("article", "main"))
# Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CHROME_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advert(?:isement)?|banner|breadcrumbs?|comments?|cookies?|consent|disclaimer|footer|header|login|menu|nav(?:bar|igation)?|"
    r"newsletter|notice|pagination|popup|promo|related|share|sidebar|social|sponsor(?:ed)?|subscribe|tags?|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
_ATTRIBUTE = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDING = re.compile(r"""\shidden(?:[\s=>/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
_SPACE = re.compile(r"\s+")

# The labelled table: words and share of link words of the block, of the one before and of the one after, whether the block
# is enclosed by main text elements, by elements of the page's frame (or so named), and whether it is main text.
LABELLED = np.array(
    [
        # inside an article, whatever the size of block and neighbours
        *[(w, 0.0, p, 0.0, n, 0.0, 1, 0, 1) for w in (1, 4, 12, 40, 200) for p in (0, 8, 50, 200) for n in (0, 5, 40, 200)],
        # link lists inside an article
        (6, 1.0, 3, 1.0, 4, 1.0, 1, 0, 0), (2, 1.0, 40, 0, 2, 1.0, 1, 0, 0), (9, 1.0, 9, 1.0, 0, 0, 1, 0, 0),
        # paragraphs with some links
        (40, 0.2, 30, 0, 20, 0, 1, 0, 1), (15, 0.3, 30, 0.1, 25, 0, 1, 0, 1), (60, 0.3, 12, 0, 9, 0, 0, 0, 1),
        # the frame of a page, also inside an article
        *[(w, d, p, 0.0, n, 0.0, m, 1, 0) for w, d in ((1, 1.0), (9, 0.0), (30, 0.2), (120, 0.0)) for p in (2, 60, 200) for n, m in ((2, 0), (40, 1), (200, 0))],
        # no telling elements: long text, headings before it, short ends after it
        (60, 0.0, 50, 0.0, 40, 0.0, 0, 0, 1), (25, 0.0, 6, 0.0, 70, 0.0, 0, 0, 1), (120, 0.05, 8, 0.0, 3, 1.0, 0, 0, 1), (30, 0.0, 0, 0, 45, 0.0, 0, 0, 1),
        (7, 0.0, 1, 1.0, 60, 0.0, 0, 0, 1), (12, 0.0, 40, 0.0, 50, 0.0, 0, 0, 1), (4, 0.0, 80, 0.0, 60, 0.0, 0, 0, 1), (6, 0.0, 2, 0.5, 35, 0.0, 0, 0, 1),
        (18, 0.0, 25, 0.0, 20, 0.0, 0, 0, 1), (10, 0.0, 30, 0.0, 22, 0.0, 0, 0, 1),
        # no telling elements: link lists, small print, single words
        (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0), (3, 1.0, 2, 1.0, 4, 1.0, 0, 0, 0), (5, 0.8, 40, 0.0, 3, 1.0, 0, 0, 0), (4, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0),
        (8, 0.0, 3, 1.0, 0, 0, 0, 0, 0), (20, 0.9, 30, 0.0, 30, 0.0, 0, 0, 0), (2, 0.0, 3, 0.0, 1, 0.0, 0, 0, 0), (6, 0.5, 0, 0, 5, 0.6, 0, 0, 0),
        (5, 0.0, 4, 0.0, 6, 0.0, 0, 0, 0), (3, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0), (9, 0.6, 50, 0.0, 7, 0.7, 0, 0, 0),
    ],
    float,
)


def _grow(x: np.ndarray, y: np.ndarray, depth: int):
    """A tree of (column, limit, left, right) by Gini impurity; a leaf is the majority, main text if even."""
    if depth == 0 or len(set(y.tolist())) == 1:
        return bool(y.mean() >= 0.5)
    best = None
    for column in range(x.shape[1]):
        values = np.unique(x[:, column])
        for limit in (values[:-1] + values[1:]) / 2:
            left = x[:, column] <= limit
            cost = sum(side.sum() * y[side].mean() * (1 - y[side].mean()) for side in (left, ~left))
            if best is None or cost < best[0] - 1e-12:
                best = cost, column, limit
    if best is None:
        return bool(y.mean() >= 0.5)
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], _grow(x[left], y[left], depth - 1), _grow(x[~left], y[~left], depth - 1)


@cache
def trained_tree(depth: int = 8):
    return _grow(LABELLED[:, :-1], LABELLED[:, -1], depth)


def _main(tree, block: tuple) -> bool:
    while not isinstance(tree, bool):
        tree = tree[2] if block[tree[0]] <= tree[1] else tree[3]
    return tree


def text_blocks(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """The blocks of a page in order: text, words, words in links, inside main text elements, inside the page's frame."""
    found: list[tuple[str, int, int, bool, bool]] = []
    stack: list[tuple[str, bool, bool, bool, bool]] = []
    parts: list[str] = []
    linked: list[str] = []
    hidden = frame = main = link = False
    at, end = 0, len(page)

    def close() -> None:
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            found.append((text, len(text.split()), len(" ".join(linked).split()), main, frame))
        parts.clear()
        linked.clear()

    while at < end:
        tag = _TAG.search(page, at)
        start = tag.start() if tag else end
        if start > at and not hidden:
            text = html.unescape(page[at:start])
            parts.append(text)
            if link:
                linked.append(text)
        if tag is None:
            break
        at = tag.end()
        if tag[2] is None:
            continue
        name, closing = tag[2].lower(), bool(tag[1])
        if name == "br":
            parts.append(" ")
        elif name in VOID:
            if name in BLOCKS:
                close()
        elif closing:
            if name in BLOCKS:
                close()
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None:
                _, hidden, frame, main, link = stack[depth]
                del stack[depth:]
        else:
            if name in BLOCKS:
                close()
            # A paragraph or item that was left open ends where the next one begins.
            if name in ("p", "li", "td", "tr", "dt", "dd", "option") and stack and stack[-1][0] == name:
                _, hidden, frame, main, link = stack.pop()
            if tag[3].rstrip().endswith("/") and name not in BLOCKS:
                continue
            stack.append((name, hidden, frame, main, link))
            marks = tag[3]
            link = link or name == "a"
            hidden = hidden or name in HIDDEN or bool(marks and _HIDING.search(marks))
            named = marks and any(_CHROME_WORDS.search("".join(m)) for m in _ATTRIBUTE.findall(marks))
            # The header of an article belongs to it.
            frame = frame or (name in CHROME and not (name == "header" and main)) or bool(named and name not in ("body", "html"))
            main = main or name in MAIN
            if name in RAW:
                close_at = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                at = close_at.start() if close_at else end
    close()
    return found


def main_text(page: str) -> str:
    """The blocks that the tree takes for main text, joined by an empty line."""
    blocks = text_blocks(page)
    tree = trained_tree()
    shares = [(b[1], b[2] / b[1]) for b in blocks]
    around = [(0, 0.0), *shares, (0, 0.0)]
    kept = [b[0] for k, b in enumerate(blocks) if _main(tree, (*shares[k], *around[k], *around[k + 2], b[3], b[4]))]
    return "\n\n".join(kept)


def extract_text(pages: DataFrame) -> DataFrame:
    """``pages`` (html, ...) with ``text`` instead of ``html``; a null or empty page has an empty text.

    Every row is extracted, repeated ones and those without an id too; ``pages`` must have no column ``text``; other columns
    stay as they are.
    """
    small_batches(pages.sparkSession)
    names = [c for c in pages.columns if c != "html"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != "html")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "html"):
                texts = [main_text(p or "") for p in piece.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in names), pa.array(texts, pa.string())], [*names, "text"])

    return pages.mapInArrow(extracted, f"{fields}{', ' if fields else ''}text string")
