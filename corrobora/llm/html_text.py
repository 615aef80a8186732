"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element, and lines go that lie in a menu,
header, footer, sidebar, notice, advert, form, comment section or other furniture; on
a page that marks its article, lines outside go as well.  A line's length is its
number of code points; outside a marked article without those of its links, and 0 where
most of it is link text.
Lengths are summed over a window of ``window`` lines that slides down the page.
Text surges at the first line whose window holds more than ``surge`` code points, on
pages of little text more than half of their fullest window, and dives where a window
falls to 0.  Everything from the first surge to the last dive of a stretch that surged is
kept, extended back over up to ``window`` short lines or to a heading, and to both sides over
stretches that never surge but hold a heading or a full sentence: a title above
the menu, a short lead or closing section.  In a marked article the stretch is kept from
its start, so that its lists of links, captions and notes stay.

Furniture is told by element names, by whole names in class, id and role, and by
compounds of a fixed list.  An element so named that holds the page's article, or on a
page without one most of the text, is no furniture.

Defined results: null and empty pages, and pages without text, give an empty
text; a markup that never closes ends with the page; a tag whose quotes do not pair ends
at its first ``>``; time grows with the page, whatever its nesting; equal rows give equal
results; columns beside page_id, url and html are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

# Element names of HTML by their role.
SILENT = frozenset("head title script style noscript template textarea select option button svg annotation annotation-xml object embed iframe canvas audio video map datalist".split())
FURNITURE = frozenset("nav footer aside form menu dialog".split())
ARTICLE = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
CLOSES_P = BLOCKS - {"li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
# Names in class, id and role attributes of furniture, as whole names.
FURNITURE_WORDS = frozenset("""ad ads advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs byline-links comment comments comentarios
commentaires kommentare disqus cookie cookies consent copyright footer gdpr header hidden login masthead menu menubar modal nav navbar navigation
newsletter notice notification pagination pager popup promo promoted promotion recommended related search share sharing sidebar signup skip
social sponsor sponsored sponsor-box subscribe teaser toolbar topbar widget alert alertdialog complementary contentinfo dialog
reader-comments replies reply respond outbrain taboola""".split())
# Compounds of two such parts, the first of one list and the second of the other.
_COMPOUNDS = (
    ("ad ads advert banner sponsor promo google", "ad ads bar banner block box container label slot space unit wrapper"),
    ("cookie cookies consent gdpr privacy", "alert bar banner box consent dialog info message modal notice notification popup"),
    ("share sharing social", "bar box buttons icons links list media menu share sharing tools widget"),
    ("site page main global top bottom left right primary secondary mobile sub", "ad ads banner bar footer header menu nav navbar navigation sidebar"),
    ("nav navbar navigation menu breadcrumb breadcrumbs header footer sidebar", "bar container inner items left links list main menu nav primary right top widget wrapper"),
    ("comment comments reply replies", "area box container form list section thread wrapper"),
    ("related recommended promoted sponsored popular more", "articles content items links news posts products reading stories"),
    ("newsletter login search signup subscribe subscription", "bar box form modal popup signup widget"),
    ("popup modal alert notification toast", "banner bar box container content dialog overlay"),
    ("skip", "link links nav"), ("copyright", "notice text"), ("widget", "area container"),
)
FURNITURE_NAMES = FURNITURE_WORDS | {f"{x}-{y}" for first, second in _COMPOUNDS for x in first.split() for y in second.split()}

# Of these, the names that parts of an article carry as well.
OWN = frozenset("header teaser search social widget hidden skip respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|([^>]*)(?:>|\Z))", re.S)
_RAW = re.compile(r"(?i)</(script|style|textarea|title|noscript|iframe|template)\s*>")
_ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role|aria-hidden|hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_GAP = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?\u2026\u3002\uff01\uff1f\u061f\u06d4\u0964][\"'\u201d\u2019\u00bb)\]]*$")


@dataclass(frozen=True)
class ExtractSpec:
    window: int = 3
    surge: int = 86
    most_links: float = 0.5
    most_text: float = 0.5


@dataclass
class _Line:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    furniture: bool = False
    inside: int = 0                     # number of the innermost element around it that is named as furniture, 0: none
    article: bool = False
    heading: bool = False


def _is_hidden(attributes: str) -> bool:
    """Whether an element says itself that it is not shown."""
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return True
    return False


def _is_named(attributes: str, in_article: bool) -> bool:
    """Whether class, id or role name an element as furniture."""
    # An article's own header holds its title.
    names = FURNITURE_NAMES - OWN if in_article else FURNITURE_NAMES
    return any(m[1].lower() in ("class", "id", "role") and any(re.sub(r"[-_:]+", "-", word).strip("-") in names
                                                               for word in (m[2] or "").strip("\"'").lower().split())
               for m in _ATTRIBUTE.finditer(attributes))


def _settle(found: list[_Line], parents: list[int], firm: list[bool], most: float) -> None:
    """Set ``furniture`` of each line; named elements around the article or most of the text do not count.

    ``parents`` leads from a named element to the next one around it, which has a
    smaller number.  Elements that are furniture by their element name (``firm``)
    give way to an article only.
    """
    size = [0 if x.furniture else len("".join(x.parts)) for x in found]
    whole = sum(n for n, x in zip(size, found) if x.article)
    clear = sum(n for n, x in zip(size, found) if not x.inside)
    free_article = any(n and x.article and not x.inside for n, x in zip(size, found))
    held, marked = [0] * len(parents), [0] * len(parents)
    for n, x in zip(size, found):
        held[x.inside] += n
        marked[x.inside] += n * x.article
    for k in range(len(parents) - 1, 0, -1):
        if parents[k]:
            held[parents[k]] += held[k]
            marked[parents[k]] += marked[k]
    counts = [False] * len(parents)
    for k in range(1, len(parents)):
        void = (whole and marked[k] == whole >= clear) or (not firm[k] and not free_article and held[k] > most * sum(size))
        counts[k] = not void or counts[parents[k]]
    for x in found:
        x.furniture |= counts[x.inside]


def lines(page: str, most_text: float = 0.5) -> list[_Line]:
    """The page as lines of text, one per block element, each with its place."""
    out, line = [], _Line()
    stack: list[tuple[str, bool, bool]] = []     # open elements: (name, hidden from here, named as furniture)
    opened: Counter[str] = Counter()             # how many are open by name
    blocks: list[int] = []                       # places of open block elements in the stack
    parents, firm, inside = [0], [False], 0
    hidden = article = silent = headings = 0
    at = 0

    def flush() -> None:
        nonlocal line
        if line.parts:
            out.append(line)
        line = _Line()

    def add(text: str) -> None:
        if text and not silent:
            if not line.parts:
                line.furniture, line.inside, line.article, line.heading = hidden > 0, inside, article > 0, headings > 0
            line.parts.append(text)
            if opened["a"]:
                line.linked += len(_GAP.sub("", html.unescape(text)))

    def leave() -> None:
        nonlocal hidden, article, silent, headings, inside
        name, was_hidden, was_named = stack.pop()
        opened[name] -= 1
        if name in BLOCKS:
            blocks.pop()
        if was_named:
            inside = parents[inside]
        hidden -= was_hidden
        article -= name in ARTICLE
        silent -= name in SILENT
        headings -= name in HEADINGS

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        name, closing, attributes = m[2].lower(), bool(m[1]), m[3] if m[3] is not None else m[4]
        if name in BLOCKS:
            flush()
        elif name == "br":
            add(" ")
        if closing:
            if opened[name]:
                while stack[-1][0] != name:
                    leave()
                leave()
        elif name not in VOID and not attributes.endswith("/"):
            if name in CLOSES_P and blocks and stack[blocks[-1]][0] == "p":
                for _ in range(len(stack) - blocks[-1]):
                    leave()
            elif name in ("li", "dd", "dt", "option") and stack and stack[-1][0] == name:
                leave()
            own = attributes and name not in ("body", "html") and name not in ARTICLE
            hides = bool(own) and _is_hidden(attributes)
            by_name = name in FURNITURE - {"form"} or (name == "header" and not article)
            starts = by_name or name == "form" or (bool(own) and _is_named(attributes, article > 0))
            if name in BLOCKS:
                blocks.append(len(stack))
            stack.append((name, hides, starts))
            opened[name] += 1
            if starts:
                parents.append(inside)
                firm.append(by_name)
                inside = len(parents) - 1
            hidden += hides
            article += name in ARTICLE
            silent += name in SILENT
            headings += name in HEADINGS
            if name in ("script", "style", "textarea", "title", "iframe", "noscript", "template"):
                end = next((e for e in _RAW.finditer(page, at) if e[1].lower() == name), None)
                at = end.end() if end else len(page)
                leave()
    flush()
    _settle(out, parents, firm, most_text)
    return out


def main_text(page: str | None, spec: ExtractSpec = ExtractSpec()) -> str:
    """Kept lines of a page, one per line."""
    found = [(_GAP.sub(" ", html.unescape("".join(x.parts))).strip(), x) for x in lines(page or "", spec.most_text)]
    found = [(t, x) for t, x in found if t]
    if not found:
        return ""
    marked = any(x.article and not x.furniture for _, x in found)
    found = [(t, x) for t, x in found if not x.furniture and (x.article or not marked)]
    if not found:
        return ""
    return "\n".join(found[i][0] for i in _surge_to_dive(found, marked, spec))


def _surge_to_dive(found: list[tuple[str, _Line]], marked: bool, spec: ExtractSpec) -> list[int]:
    """Numbers of the lines from the first surge to the last dive, extended to both sides."""
    solid = np.array([len(_GAP.sub("", t)) for t, _ in found])
    linked = np.array([0 if marked else x.linked for _, x in found])
    length = np.where(linked > spec.most_links * solid, 0, [max(0, len(t) - n) for (t, _), n in zip(found, linked.tolist())])
    ahead = np.convolve(length, np.ones(spec.window, int))[spec.window - 1:]       # lines i to i + window - 1
    surge = min(spec.surge, int(ahead.max()) // 2)
    stretches: list[tuple[int, int]] = []       # from a line with text to the dive
    start = None
    for i in range(len(length) + 1):
        if start is not None and (i == len(length) or ahead[i] == 0):
            stretches.append((start, i))
            start = None
        if start is None and i < len(length) and length[i] > 0:
            start = i
    surges = [next((i for i in range(a, b) if length[i] > 0 and ahead[i] > surge), None) for a, b in stretches]
    risen = [k for k, at in enumerate(surges) if at is not None]
    if not risen:
        return []

    def speaks(k: int) -> bool:
        return any(length[i] > 0 and (found[i][1].heading or _SENTENCE.search(found[i][0])) for i in range(*stretches[k]))

    low, high = risen[0], risen[-1]
    a, at = stretches[low][0], surges[low]
    headings = [i for i in range(a, at) if found[i][1].heading and length[i] > 0]
    first = a if marked else min([max(a, at - spec.window), *headings])
    kept = [*range(first, stretches[high][1])]
    while low and speaks(low - 1):
        low -= 1
        kept = [*range(*stretches[low]), *kept]
    while high + 1 < len(stretches) and speaks(high + 1):
        high += 1
        kept += range(*stretches[high])
    return kept


def extract(pages: DataFrame, spec: ExtractSpec = ExtractSpec()) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages(page_id, url, html)``."""

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda page: main_text(page, spec))

    reader = F.pandas_udf(texts, StringType())
    rows = pages.select("page_id", "url", reader(F.coalesce("html", F.lit(""))).alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))
