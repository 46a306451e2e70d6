"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block in page order. A line's length is its text's outside links; blocks of
menus, headers, footers, sidebars, notices, adverts, forms and comments keep their place as lines of length zero. Over
windows of `window` lines the lengths are summed: text surges where the sum leaves zero and dives where it falls to zero
again. Between a surge and its dive the text is kept if the sum reaches `surge` there, or a share of the page's largest
sum where that is less, so that a lone short line far from the body is left out. Nothing else tells the main text:
elements like article and main are blocks like others.

Defined cases: null and empty html, and pages without text, give an empty text; tags that are never closed, attributes
with >, comments cut off and character references without a semicolon do no harm; a page of any length is taken whole;
repeated rows and null keys are rows like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.llm.common import bound_batches

WINDOW, SURGE, SHARE = 3, 120, 0.3

#: No part may be read twice from different starts, so that odd markup takes no more time than other text.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|svg|textarea|iframe|title|select|object|math|canvas)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*+(?:>|\Z)|</?[a-zA-Z][^<>]*+(?:>|(?=<)|\Z)",
    re.S | re.I,
)
BLOCKS = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = set("nav header footer aside form menu dialog button fieldset head search".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAMES = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription sidebar aside widget widgets menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer comment comments discussion respond replies disqus share sharing social related recommended pagination pager login signup form".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: A class like has-sidebar or no-header says what stands beside an element, not what the element is.
BESIDE = set("has have with without no not is when hide show".split())


def _outside(tag: str, attributes: str) -> bool:
    if tag in OUTSIDE:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in re.findall(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", attributes, re.I):
        value = (a or b or c).lower()
        if name.lower() == "role":
            if value.strip() in ROLES:
                return True
        else:
            for own in (set(re.split("[_-]+", x)) for x in value.split()):
                if own & NAMES and not own & BESIDE:
                    return True
    return bool(re.search(r"\b(hidden\b(?!\s*=\s*[\"']?until)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none)", attributes, re.I)) if tag != "input" else False


def lines(page: str) -> tuple[list[str], list[int]]:
    """Text of each block, and its length outside links: -1 for blocks of boilerplate."""
    texts: list[str] = []
    lengths: list[int] = []
    stack: list[tuple[str, bool]] = []  # open elements that matter, and whether each is boilerplate
    skipping = links = headings = linked = 0
    piece: list[str] = []

    def end() -> None:
        nonlocal linked
        if piece:
            text = " ".join(entities.unescape("".join(piece)).split())
            piece.clear()
            if text:
                texts.append(text)
                lengths.append(-1 if skipping else max(0, len(text) - linked))
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        piece.append(text)
        if links and not headings:
            linked += len(" ".join(entities.unescape(text).split()))

    at = 0
    for m in MARKUP.finditer(page):
        put(page[at : m.start()])
        at = m.end()
        if not m.group(3):
            continue
        closing, tag, attributes = m.group(2), m.group(3).lower(), m.group(4) or ""
        if tag == "a":  # a link ends at the next one at the latest
            links = 0 if closing else 1
            continue
        if tag in BLOCKS:
            end()
        if tag in HEADINGS:
            headings = 0 if closing else 1
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    end()
                    skipping -= sum(out for _, out in stack[k:])
                    links = 0
                    del stack[k:]
                    break
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in ("article", "main") and skipping:  # what stood open before an article was never closed
            stack.clear()
            skipping = links = 0
        out = _outside(tag, attributes)
        if out or (tag in BLOCKS and tag not in ("p", "li", "tr", "td", "th", "dd", "dt", "option")) or (skipping and tag not in ("p", "li", "tr", "td", "th", "dd", "dt")):
            if out:
                end()
            stack.append((tag, out))
            skipping += out
    put(page[at:])
    end()
    return texts, lengths


def spans(lengths: np.ndarray, window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """First and last line of each stretch of text between a surge and its dive that is high enough."""
    at = np.flatnonzero(lengths > 0)
    if not len(at):
        return []
    sums = np.convolve(lengths, np.ones(window, np.int64))[window - 1 :]  # of the window that begins in each line
    least = max(1, min(surge, int(SHARE * sums.max())))
    # A window's sum is zero between two lines just where `window` lines without length lie between them.
    cuts = np.flatnonzero(np.diff(at) > window) + 1
    return [(int(own[0]), int(own[-1])) for own in np.split(at, cuts) if sums[own].max() >= least]


def extract(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    if not page:
        return ""
    texts, lengths = lines(page)
    sizes = np.array(lengths, np.int64)
    kept = [k for first, last in spans(np.maximum(sizes, 0), window, surge) for k in range(first, last + 1) if sizes[k] >= 0]
    return "\n".join(texts[k] for k in kept)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""

    bound_batches(pages.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(rows, "page_id long, url string, text string, n_chars long")
