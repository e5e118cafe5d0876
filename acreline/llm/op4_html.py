"""Operator 4: main text of a page by tag-path ratios.

A page is read as blocks (runs of text between block-level tags), each with its root-to-leaf
path of block-level tags. Per path, text length (without links) and punctuation are summed
and divided by the path's blocks; both ratios are smoothed over neighbouring blocks, fused
by product and averaged over the path again. A path is content if its value reaches CONTENT
of the page's best. Tags and names of what isn't an article (menus, headers, footers,
sidebars, notices, adverts, forms, comments, hidden parts) are a prior: each one on the way to
a block multiplies its path's value by PART, so they decide against what stands outside of
them, but not where all text lies in such an element.

The article is the lowest common ancestor of all content blocks. Its blocks from the first
content to the last are the text, also short ones, lists and links between them, but for parts that open inside
the article; headings right before belong to it, and where the ancestor is an element of its
own (not the body) also what stands before and after, unless it is mostly links.

Null, empty and textless pages, and pages of links only, give "". Unclosed and stray tags are
closed where HTML's rules or the next closing tag of an ancestor close them; reading takes time
in proportion to the page, however deep it nests. Rows pass through one by one: repeated rows
give repeated rows, an empty table none, and other columns play no part.
"""

from __future__ import annotations

import bisect
import heapq
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreline.llm.common import arrow_slices, plain

# HTML's element kinds and the usual names of page parts.
RAW = "script style noscript template iframe object svg math canvas audio video textarea select title".split()
#: Of these, the ones whose content is text to the end of the page if nothing ends it; of others only the tag goes then.
ENDLESS = {"script", "style", "textarea", "title"}
RAW_SET = set(RAW)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PARTS = set("head nav aside footer form menu dialog fieldset button".split())
SINGLE = {"p", "li", "pre", "td", "th", "dd", "dt", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"}
HEADINGS = {f"h{i}" for i in range(1, 7)}
CLOSES_P = BLOCK - {"html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}
ENDS_P = {"td", "th", "div", "section", "article", "li", "body"}
# What an opening tag closes: the innermost open element of these, unless one of those stands between.
FAMILIES = {"p": ({"p"}, ENDS_P), "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"})}
CLOSES = {"li": ("li",), "dt": ("dt",), "dd": ("dt",), "tr": ("tr", "td"), "td": ("td",), "th": ("td",)}
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|sponsor\w*|promo\w*|banner\w*|popup|modal|overlay|cookies?|consent|gdpr|notices?|alerts?|newsletter|subscri\w*|signup|login|"
    r"nav|navbar|navigation|menu\w*|breadcrumbs?|pagination|pager|toc|header|masthead|footer|foot|copyright|legal|sidebars?|side|aside|widgets?|rail|related|recommend\w*|"
    r"share|sharing|social|comments?|commentlist|disqus|replies|respond|reactions?|tags|search|toolbar|skip|hidden|sr-only)(?:$|[\s_-])",
    re.I,
)
#: Share of the best fused ratio that makes a block content.
CONTENT = 0.08
#: What a part's tag or name multiplies a path's value by.
PART = 1e-4
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|$|[\"'][^>]*(?:>|$))",
    re.S | re.I,
)
_RAW_END = re.compile(r"</(" + "|".join(RAW) + r")\s*>", re.I)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_CLASS = re.compile(r"""\bclass\s*=\s*["']?([\w-]+)""")
_MARKS = re.compile(r"[.,;:!?、。，！？]")


class Page:
    """A page's block-level elements and, in order, its blocks with text."""

    def __init__(self) -> None:
        # elements, 0 being the root: parent, tag, parts on the way to it, path
        self.parent, self.tag, self.parts, self.path = [0], ["#"], [0], [0]
        self.paths: dict[tuple[int, str], int] = {}
        # blocks: element, text, characters in links, punctuation
        self.element: list[int] = []
        self.text: list[str] = []
        self.links: list[int] = []
        self.marks: list[int] = []

    def open(self, tag: str, parent: int, part: bool, label: str) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.parts.append(self.parts[parent] + part)
        self.path.append(self.paths.setdefault((self.path[parent], label), len(self.paths) + 1))
        return len(self.tag) - 1


def is_part(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element opens a part that isn't the article's text."""
    if tag in PARTS:
        return True
    if tag == "header":
        return not in_article
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id") and NAMES.search(value):
            return True
        if name == "role" and value in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"):
            return True
    return False


def read(html_: str) -> Page:
    page = Page()
    stack = [0]
    # per open element and family: place in the stack of the innermost open member in scope, or -1
    nearest: list[dict[str, int]] = [dict.fromkeys(FAMILIES, -1)]
    opened: Counter = Counter()
    links = 0
    buffer: list[str] = []
    linked = 0
    #: An inline part that is open (button, span.ad): its tag and how deep it nests.
    skipped, depth = "", 0

    def close_block() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                page.element.append(stack[-1])
                page.text.append(text)
                page.links.append(min(len(text), linked))
                page.marks.append(len(_MARKS.findall(text)))
            buffer.clear()
        linked = 0

    def pop_to(i: int) -> None:
        close_block()
        for n in stack[i:]:
            opened[page.tag[n]] -= 1
        del stack[i:], nearest[i:]

    def raw_end(tag: str, attributes: str, at: int) -> int:
        """Where a raw element that was opened just before `at` ends."""
        if attributes.rstrip().endswith("/") and tag not in ENDLESS:
            return at
        ends = raw_ends.get(tag, [])
        i = bisect.bisect_left(ends, (at, 0))
        return ends[i][1] if i < len(ends) else len(html_) if tag in ENDLESS else at

    #: Where the end tags of raw elements stand, in order.
    raw_ends: dict[str, list[tuple[int, int]]] = {}
    for m in _RAW_END.finditer(html_):
        raw_ends.setdefault(m[1].lower(), []).append(m.span())
    at = 0
    while m := _TOKEN.search(html_, at):
        if m.start() > at and not skipped:
            buffer.append(html_[at : m.start()])
            linked += (m.start() - at) * (links > 0)
        at = m.end()
        tag = m.group(2)
        if not tag:
            continue
        tag, attributes = tag.lower(), m.group(3)
        if tag in RAW_SET and not m.group(1):
            at = raw_end(tag, attributes, at)
            if not skipped:
                buffer.append(" ")
            continue
        if m.group(1):
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCK:
                if opened[tag]:
                    i = len(stack) - 1
                    while page.tag[stack[i]] != tag:
                        i -= 1
                    pop_to(i)
                    links, skipped = 0, ""
            elif tag == skipped:
                depth -= 1
                if not depth:
                    skipped = ""
            continue
        if tag == "br" or tag == "wbr":
            buffer.append(" " * (tag == "br"))
            continue
        in_article = opened["article"] + opened["main"] > 0
        if tag not in BLOCK:
            links += tag == "a"
            if tag in VOID or attributes.rstrip().endswith("/"):
                continue
            if skipped:
                depth += tag == skipped
            elif tag == "button" or attributes and tag != "a" and is_part(tag, attributes, in_article):
                skipped, depth = tag, 1
            continue
        close_block()
        if tag == "hr":
            continue
        skipped = ""
        for family in (*(("p",) if tag in CLOSES_P else ()), *CLOSES.get(tag, ())):
            if (i := nearest[-1][family]) >= 0:
                pop_to(i)
        if tag == "body" and opened["head"]:
            while opened["head"]:
                pop_to(len(stack) - 1)
        name = _CLASS.search(attributes) if attributes else None
        stack.append(page.open(tag, stack[-1], is_part(tag, attributes, in_article), f"{tag}.{name[1]}" if name else tag))
        opened[tag] += 1
        nearest.append({f: len(stack) - 1 if tag in own else -1 if tag in ends else nearest[-1][f] for f, (own, ends) in FAMILIES.items()})
        links = 0
    if at < len(html_) and not skipped:
        buffer.append(html_[at:])
    close_block()
    return page


def smoothed(values: list[float]) -> list[float]:
    """Weighted mean with the two neighbours."""
    n = len(values)
    return [(2 * values[i] + (values[i - 1] if i else values[i]) + (values[i + 1] if i + 1 < n else values[i])) / 4 for i in range(n)]


def path_values(page: Page) -> dict[int, float]:
    """Path -> its fused ratio, lowered by the parts on the way."""
    paths = [page.path[e] for e in page.element]
    count: Counter = Counter(paths)
    length, marks = Counter(), Counter()
    for p, text, linked, m in zip(paths, page.text, page.links, page.marks, strict=True):
        length[p] += len(text) - linked
        marks[p] += m
    lengths, punctuation = (smoothed([s[p] / count[p] for p in paths]) for s in (length, marks))
    total: Counter = Counter()
    for p, n, m in zip(paths, lengths, punctuation, strict=True):
        total[p] += n * (1 + m) * (length[p] > 0)
    parts = {page.path[e]: page.parts[e] for e in page.element}
    return {p: v / count[p] * PART ** parts[p] for p, v in total.items()}


def common_ancestor(page: Page, elements: set[int]) -> int:
    """Elements are numbered as they open, so the largest number is never an ancestor of the others."""
    rest = sorted(elements)
    held = set(rest)
    heap = [-e for e in rest]
    heapq.heapify(heap)
    while len(heap) > 1:
        e = -heapq.heappop(heap)
        up = page.parent[e]
        if up not in held:
            held.add(up)
            heapq.heappush(heap, -up)
    return -heap[0]


def main_text(html_: str | None) -> str:
    page = read(html_ or "")
    values = path_values(page) if page.text else {}
    best = max(values.values(), default=0)
    if best <= 0:
        return ""
    is_content = [values[page.path[e]] >= CONTENT * best for e in page.element]
    content = [i for i, c in enumerate(is_content) if c]
    article = common_ancestor(page, {page.element[i] for i in content})
    if page.tag[article] in SINGLE:
        # one paragraph is all the content: what holds it is the article
        article = page.parent[article]
    # an element is inside the article if its parent is; parents come first
    inside = [False] * len(page.tag)
    inside[article] = True
    for e in range(article + 1, len(page.tag)):
        inside[e] = inside[page.parent[e]]
    first, last = content[0], content[-1]
    apart = page.parts[article]
    usable = [c or inside[e] and page.parts[e] <= apart for c, e in zip(is_content, page.element, strict=True)]
    start = first
    while start and usable[start - 1] and page.tag[page.element[start - 1]] in HEADINGS:
        start -= 1
    own = page.tag[article] not in ("#", "html", "body")
    kept = [t for i, t in enumerate(page.text) if usable[i] and (start <= i <= last or own and 2 * page.links[i] <= len(t))]
    return "\n".join(kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_slices(batches, "html"):
            out = [main_text(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = plain(pages, ["page_id", "url", "html"]).select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    kind = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string, n_chars long"
    return rows.mapInArrow(work, kind)
