"""Main text of web pages by the best contiguous run of words.

A page is a row of words and tags. Words score positive and tags negative;
the run with the largest sum is the main text, found in one linear scan. What
a word gains and each tag costs is learned from labelled pages, those that
mark their own article: a tag that occurs around articles more than in them
costs more, though tags that articles use as well, such as those of lists and
tables, never cost more than a few words. Where a page marks its own article,
the run covers it whole.

Every row of pages has a result of its own: repeated rows have it repeated, and
columns that happen to be named like those of the result do not matter. Null
and empty pages have an empty text; texts of any length are read whole.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices, text_or_empty, texts, widened

#: Labelled pages that weights are learned from at most, the smallest by hash.
MAX_LABELLED = 2_000
WORD_GAIN_LEAST, WORD_GAIN_MOST = 0.1, 1.0
TAG_COST_LEAST, TAG_COST_MOST = 0.02, 6.0
#: Cost of a tag that no labelled page has and that ends a block.
UNKNOWN_TAG_COST = 1.0
#: Share of a page's words above which an element is never left out.
MOST_WORDS = 0.75
#: Words that each tag of an element costs if a part of its class, id or role is a mark.
PART_MARK_WORDS = 5
#: Words that a tag of articles and menus alike costs at most; both of an
#: element's tags are as dear as the words that a menu's entry holds.
CONTENT_TAG_WORDS = 1.5

# Element names of the public HTML standard.
LABEL_ELEMENTS = ["article", "main"]
RAW_ELEMENTS = ["script", "style", "textarea"]
#: Without text of the page as well, but only if they end.
EMBEDDED_ELEMENTS = ["noscript", "template", "svg", "iframe", "object", "canvas"]
LEFT_OUT_ELEMENTS = ["nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "title"]
INLINE_ELEMENTS = [
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
    "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike",
    "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
    "math", "annotation", "annotation-xml", "maction", "menclose", "merror", "mfrac", "mi", "mmultiscripts", "mn",
    "mo", "mover", "mpadded", "mphantom", "mprescripts", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub",
    "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "semantics",
]
CONTENT_ELEMENTS = [
    "a", "blockquote", "caption", "dd", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6",
    "li", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
]
VOID_ELEMENTS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
HEADING_ELEMENTS = ["h1", "h2", "h3", "h4", "h5", "h6"]
# Whole words of class, id and role that mark what is not the article.
LEFT_OUT_MARKS = [
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "gdpr", "menu",
    "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "related",
    "respond", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "widget",
]
LEFT_OUT_WHOLE_MARKS = [
    "footer", "header", "page-footer", "page-header", "site-footer", "site-header", "ad-banner", "ad-box",
    "ad-container", "ad-slot", "ad-unit", "ad-wrapper", "banner-ad", "comment-form", "comment-list", "comments-area",
    "comments-list", "comments-section", "cookie-banner", "cookie-bar", "cookie-consent", "cookie-notice",
    "disqus-thread", "left-sidebar", "main-menu", "main-nav", "main-navigation", "nav-bar", "nav-menu",
    "newsletter-form", "newsletter-signup", "post-navigation", "primary-nav", "related-articles", "related-links",
    "related-posts", "related-stories", "right-sidebar", "share-bar", "share-buttons", "share-links", "sidebar-left",
    "sidebar-right", "site-menu", "site-nav", "site-navigation", "social-icons", "social-links", "social-media",
    "social-share", "subscribe-form", "top-nav", "widget-area",
]

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW_ELEMENTS)})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_EMBEDDED = re.compile(
    rf"<(?P<close>/?)(?P<name>{'|'.join(EMBEDDED_ELEMENTS)})(?=[\s/>])(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.I
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NOT_SHOWN = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.I)
_LEFT_OUT, _MARKS = set(LEFT_OUT_ELEMENTS), set(LEFT_OUT_MARKS)
_WHOLE = _MARKS | set(LEFT_OUT_WHOLE_MARKS)
_INLINE, _VOID = set(INLINE_ELEMENTS), set(VOID_ELEMENTS)
_CONTENT = set(CONTENT_ELEMENTS)
_UNMARKED = {"html", "body", *LABEL_ELEMENTS, *HEADING_ELEMENTS, *INLINE_ELEMENTS}


def _judged(name: str, rest: str) -> tuple[bool, bool]:
    """Whether an element is left out, and whether only a part of a mark speaks for that.

    Headings and inline elements have no marks, but can be hidden.
    """
    if name in _LEFT_OUT:
        return True, False
    part = False
    if rest and name not in ("html", "body", *LABEL_ELEMENTS):
        for attribute, *values in _ATTRIBUTE.findall(rest):
            attribute, value = attribute.lower(), "".join(values)
            if attribute == "hidden" or attribute == "style" and _NOT_SHOWN.search(value):
                return True, False
            if attribute in ("class", "id", "role") and name not in _UNMARKED:
                for mark in value.lower().replace("_", "-").split():
                    if mark in _WHOLE:
                        return True, False
                    part = part or not _MARKS.isdisjoint(mark.split("-"))
    return False, part


def embedded_ends(page: str) -> dict[int, int]:
    """Where the embedded elements that end begin, and the place after their end."""
    ends: dict[int, int] = {}
    waiting: dict[str, list[int]] = {}
    for m in _EMBEDDED.finditer(page):
        name = m["name"].lower()
        if not m["close"]:
            if name != "svg" or not m["rest"].endswith("/"):
                waiting.setdefault(name, []).append(m.start())
        elif waiting.get(name):
            ends[waiting[name].pop()] = m.end()
    return ends


def _centres(found: list[tuple[str, str, str]], ends: dict[int, int], up_to: list[int]) -> list[int]:
    """Places of the main element and the article with the most words; an
    article that holds less than half of all articles' words is not the page's."""
    centres = []
    for label in LABEL_ELEMENTS:
        held = [(up_to[ends.get(i, -1)] - up_to[i], -i) for i, (tag, _, _) in enumerate(found) if tag == label]
        if held and max(held)[0] > 0 and (label == "main" or 2 * max(held)[0] >= sum(n for n, _ in held)):
            centres.append(-max(held)[1])
    return centres


def page_tokens(page: str, leave_out: bool = True) -> list[tuple[str, str, int]]:
    """(tag, text, n) of every tag and text that may belong to the article, in order.

    A tag is ``name`` or ``/name`` and has no text; a text has the tag ``""``
    and ``n`` words. With ``leave_out``, elements that never belong to it go
    with all they hold, if they end, unless they hold the page's article or
    most of its words, or are the article's own header with its title; their
    own tags stay and count. ``n`` of a tag is 1 if a part of a mark speaks
    against its element, 2 if the element is the page's article, else 0.
    """
    found: list[tuple[str, str, str]] = []
    embedded, skipped_to = embedded_ends(page), 0
    for m in _TOKEN.finditer(page):
        if m.start() < skipped_to:
            continue
        if m["text"] is not None:
            if found and not found[-1][0]:
                found[-1] = ("", found[-1][1] + m["text"], "")
            else:
                found.append(("", m["text"], ""))
        elif m["name"]:
            name = m["name"].lower()
            skipped_to = embedded.get(m.start(), 0)
            found.append((f"/{name}" if m["close"] or skipped_to else name, "", m["rest"] or ""))
        elif m["raw"]:
            found.append((f"/{m['raw'].lower()}", "", ""))
    ends: dict[int, int] = {}
    open_by_name: dict[str, list[int]] = {}
    for i, (tag, _, rest) in enumerate(found):
        if tag.startswith("/"):
            waiting = open_by_name.get(tag[1:])
            if waiting:
                ends[waiting.pop()] = i
        elif tag and tag not in _VOID and not rest.endswith("/"):
            open_by_name.setdefault(tag, []).append(i)
    words = [0 if tag else len(text.split()) for tag, text, _ in found]
    if not leave_out:
        return [(tag, text, n) for (tag, text, _), n in zip(found, words)]
    up_to = [0, *itertools.accumulate(words)]
    centres = _centres(found, ends, up_to)
    if centres:
        words[centres[0]] = words[ends[centres[0]]] = 2
    titles = [0, *itertools.accumulate(tag in HEADING_ELEMENTS for tag, _, _ in found)]
    out, i = [], 0
    while i < len(found):
        tag, text, rest = found[i]
        skip = False
        if tag and i in ends:
            skip, part = _judged(tag, rest)
            if part:
                words[i] = words[ends[i]] = 1
            if skip:
                most = up_to[ends[i]] - up_to[i] > MOST_WORDS * up_to[-1]
                titled = tag == "header" and titles[ends[i]] > titles[i] and any(c < i < ends[c] for c in centres)
                skip = not (most or titled or any(i < c < ends[i] for c in centres))
        out.append((tag, text, words[i]))
        i = ends[i] if skip else i + 1
    return out


def label_counts(page: str) -> Counter[tuple[str, bool]]:
    """How often each tag, and a word (tag ``""``), is inside and outside the marked article.

    Nothing is counted unless the page marks exactly one article.
    """
    tokens = page_tokens(page, leave_out=False)
    for label in LABEL_ELEMENTS:
        starts = [i for i, (tag, _, _) in enumerate(tokens) if tag == label]
        stops = [i for i, (tag, _, _) in enumerate(tokens) if tag == f"/{label}"]
        if len(starts) == len(stops) == 1 and starts[0] < stops[0]:
            break
    else:
        return Counter()
    counts: Counter[tuple[str, bool]] = Counter()
    for i, (tag, _, n) in enumerate(tokens):
        inside = starts[0] < i < stops[0]
        if not tag:
            counts["", inside] += n
        elif i not in (starts[0], stops[0]):
            counts[tag.lstrip("/"), inside] += 1
    return counts


def weights_of(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """What a word (``""``) gains and every tag costs; without labels, 1 and 1."""
    inside = sum(n for (_, where), n in counts.items() if where)
    outside = sum(n for (_, where), n in counts.items() if not where)
    if not inside or not outside:
        return {"": 1.0}
    kinds = {tag for tag, _ in counts}
    odds = {
        tag: float(
            np.log((counts.get((tag, True), 0) + 1) / (inside + len(kinds)))
            - np.log((counts.get((tag, False), 0) + 1) / (outside + len(kinds)))
        )
        for tag in kinds
    }
    weights = {tag: -min(max(-x, TAG_COST_LEAST), TAG_COST_MOST) for tag, x in odds.items() if tag}
    return weights | {"": min(max(odds.get("", 0.0), WORD_GAIN_LEAST), WORD_GAIN_MOST)}


def learn_weights(
    pages: DataFrame, html_col: str = "html", max_labelled: int = MAX_LABELLED
) -> dict[str, float]:
    """Weights from at most ``max_labelled`` pages that mark their article."""
    source = F.col(f"`{html_col}`")
    marked = pages.where(F.lower(source).rlike(rf"<({'|'.join(LABEL_ELEMENTS)})[\s>]"))
    n = marked.count()
    share = min(1.0, 1.5 * max_labelled / max(n, 1))
    place = F.pmod(F.xxhash64(source), F.lit(1 << 30))
    sample = marked.where(place < int(share * (1 << 30)))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[tuple[str, bool]] = Counter()
        for batch in batches:
            for page in batch.column("page"):
                total.update(label_counts(page.as_py()))
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()),
                pa.array([k[1] for k in keys], pa.bool_()),
                pa.array([total[k] for k in keys], pa.int64()),
            ],
            names=["tag", "inside", "n"],
        )

    counts = (
        sample.select(source.alias("page"))
        .mapInArrow(kernel, "tag string, inside boolean, n long")
        .groupBy("tag", "inside")
        .agg(F.sum("n").alias("n"))
        .collect()  # tags of a bounded sample
    )
    return weights_of({(r.tag, r.inside): r.n for r in counts})


def best_run(scores: np.ndarray) -> tuple[int, int]:
    """Start and end of the run with the largest sum, the first and shortest of equals."""
    if not len(scores) or scores.max() <= 0:
        return 0, 0
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    lowest = np.minimum.accumulate(sums[:-1])
    end = int(np.argmax(sums[1:] - lowest)) + 1
    start = end - 1 - int(np.argmin(sums[:end][::-1]))
    return start, end


def _within_block(tag: str) -> bool:
    name = tag.lstrip("/")
    return name in _INLINE or name in ("", "br")


def main_text(page: str, weights: dict[str, float]) -> str:
    """The main text of ``page``: its blocks, joined by empty lines."""
    tokens = page_tokens(page)
    gain = weights.get("", 1.0)

    def score(tag: str, n: int) -> float:
        if not tag:
            return gain * n
        cost = weights.get(tag, -TAG_COST_LEAST if tag in _INLINE else -UNKNOWN_TAG_COST)
        if tag in _CONTENT:
            cost = max(cost, -gain * CONTENT_TAG_WORDS)
        return cost - gain * PART_MARK_WORDS * n

    scores = np.array([score(tag.lstrip("/"), n) for tag, _, n in tokens])
    own = []
    for i, (tag, _, n) in enumerate(tokens):
        if tag.lstrip("/") in LABEL_ELEMENTS:
            scores[i] = 0.0  # the label itself says nothing of pages without it
            if n == 2:
                own.append(i)
    if len(own) == 2:
        # Both tags gain what outweighs all between them and the rest of the page.
        scores[own] = np.abs(scores).sum()
    start, end = best_run(scores)
    while 0 < start < end and _within_block(tokens[start - 1][0]):  # blocks are taken whole
        start -= 1
    while start < end < len(tokens) and _within_block(tokens[end][0]):
        end += 1
    blocks, block = [], []
    for tag, text, _ in [*tokens[start:end], ("p", "", 0)]:
        if not tag:
            block.append(html.unescape(text))
        elif tag.lstrip("/") == "br":
            block.append(" ")
        elif not _within_block(tag):
            joined = " ".join("".join(block).split())
            if joined:
                blocks.append(joined)
            block = []
    return "\n\n".join(blocks)


def extracted(
    pages: DataFrame,
    weights: dict[str, float],
    keep: list[str],
    html_col: str = "html",
) -> DataFrame:
    """The ``keep`` columns and ``text`` of every page; null html is empty."""
    source = pages.select(*keep, text_or_empty(html_col).alias("_page"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_page"):
                found = [main_text(x, weights) for x in texts(part, "_page")]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(found, pa.string())],
                    names=[*keep, "text"],
                )

    return source.mapInArrow(kernel, widened(source.select(*keep), "text string"))


def page_texts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    weights = learn_weights(pages, html_col)
    return extracted(pages, weights, ["page_id", "url"], html_col).withColumn(
        "n_chars", F.length("text").cast("long")
    )
