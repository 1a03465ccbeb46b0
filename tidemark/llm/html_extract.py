"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element, and every line gets a weight: the length of its
text outside links. What stands in an article or main element weighs MARKED times as much, its links
once; page furniture (menus, headers, footers, sidebars, notices, adverts, forms, reader comments) weighs
nothing. Weights are summed over sliding windows of WINDOW lines, on every page alike: text surges where
a window reaches SURGE, and dives where windows fall to zero. What lies between the first surge and the
last dive, furniture left out, is kept; without a surge the heaviest run of lines is.

Furniture is told by element and role, and by class and id names. A name counts only when all its words
do: `site-footer` and `cookie-notice` are furniture, `notice-of-meeting` and `social-history` are not. Names that
prose carries too (WEAK_WORDS) make furniture of lists and boxes, never of a paragraph, quotation or heading.

Edges: null or empty html gives an empty text. Character references are decoded; white space inside a
block, line breaks included, becomes one space. Unclosed, stray and mis-nested tags are read as
browsers do in the main: a closing tag closes up to its last open match, and is passed over without
one. Script, style and comment contents are never text, `</p>` inside them neither. A `<` after which no
`>` follows is text. After a tag whose quotes never close, tags end at their first `>`. Pages of any length
are read whole, a page at a time, in time linear in their length. Rows come back one for one, repeated
rows and null ids too.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.session import ship

WINDOW = 3
SURGE = 86
MARKED = 4

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: What follows a tag's name up to its `>`, with quoted values, and without.
QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
PLAIN = re.compile(r"[^>]*>")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>"']|$)""", re.I)
RAW = {"script", "style", "title", "textarea", "xmp", "noembed", "noframes", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("""address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav noscript ol option p pre
section select summary svg table tbody td template tfoot th thead tr ul video audio object""".split())
FURNITURE_TAGS = set("nav header footer aside form button select dialog menu noscript template svg head object video audio canvas math map".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
FURNITURE_WORDS = set("""ad ads adv advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments
commentlist consent cookie cookies disqus footer gdpr header hidden masthead menu menus modal nav navbar navigation newsletter notice
notices overlay pager pagination popup promo promoted reply replies respond sidebar sidebars signup skip sponsor sponsored subscribe
toolbar widget widgets login search""".split())
#: Words of furniture that prose may carry as well.
WEAK_WORDS = set("alert promotion recommended related share sharing social".split())
#: Words that say where or what a box is and nothing of what it holds.
BOX_WORDS = set("""aside area article articles bar block body bottom box button buttons cell center col column container content entry group grid
head holder icon icons inner item items left link links list main middle module outer page panel post posts primary right row secondary
section site slot small sticky sub text top unit view wide wrap wrapper""".split())
#: Furniture whose headings still belong to an article that they stand in.
HEADER_WORDS = {"header", "masthead"}
#: Elements whose class words do not make all of the page furniture.
WHOLE = {"html", "body", "main"}
#: Elements that end at the next of their kind; elements inside a line.
ITEMS = {"li", "td", "th", "tr", "dt", "dd", "option"}
#: Elements of prose.
PROSE = {"p", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}
INLINE = {"span", "b", "i", "em", "strong", "u", "small", "font", "label", "sup", "sub", "code", "ins", "del", "mark", "abbr", "cite", "q"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


NO, HEADER, YES = 0, 1, 2
HIDDEN_STYLE = re.compile(r"display\s*:\s*none", re.I)


def _judged(tag: str, rest: str) -> tuple[int, bool]:
    """(NO, HEADER or YES for page furniture, whether it marks the page's main part)."""
    level = HEADER if tag == "header" else YES if tag in FURNITURE_TAGS else NO
    main = tag == "main"
    if tag in WHOLE or "=" not in rest and "hidden" not in rest:
        return level, main
    for name, a, b, c in ATTRIBUTE.findall(rest):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN_STYLE.search(value):
            level = YES
        elif name == "role" and value.lower() in FURNITURE_ROLES:
            level = max(level, HEADER if value.lower() == "banner" else YES)
        elif name == "role" and value.lower() == "main" or name == "itemprop" and value == "articleBody":
            main = True
        elif name in ("class", "id"):
            for own in value.split():
                words = set(WORD.findall(CAMEL.sub(" ", own).lower()))
                strong, weak = words & FURNITURE_WORDS, words & WEAK_WORDS
                if words <= FURNITURE_WORDS | WEAK_WORDS | BOX_WORDS and (strong or weak and tag not in PROSE):
                    level = max(level, HEADER if strong <= HEADER_WORDS and not weak else YES)
    return level, main


def markup(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before it, name in lower case, closing, what follows the name) of each tag; the name is empty for what is no element, and at the end.

    The contents of RAW elements, their closing tags and comments are passed over. Each character is looked at a bounded number of times.
    """
    at = start = 0
    last, quotes = page.rfind(">"), True
    while True:
        at = page.find("<", at)
        if at < 0 or at > last:
            yield page[start:].partition("<!--")[0], "", False, ""
            return
        if page.startswith("<!--", at):
            close = COMMENT_END.search(page, at + 4)
            yield page[start:at], "", False, ""
            at = start = close.end() if close else len(page)
            continue
        closing = page.startswith("/", at + 1)
        name = NAME.match(page, at + 1 + closing)
        if not name:
            if at + 1 < len(page) and page[at + 1] in "!?/":
                yield page[start:at], "", False, ""
                at = start = page.index(">", at) + 1
            else:
                at += 1
            continue
        rest = QUOTED.match(page, name.end()) if quotes else None
        if not rest:
            quotes, rest = False, PLAIN.match(page, name.end())
        tag = name[0].lower()
        yield page[start:at], tag, closing, rest[0]
        at = start = rest.end()
        if tag in RAW and not closing:
            at = start = _raw_end(page, tag, at)


def _raw_end(page: str, tag: str, at: int) -> int:
    """Where the contents of a RAW element that starts at `at`, and its closing tag, end."""
    close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
    stop = page.find(">", close.end()) if close else -1
    return stop + 1 if stop >= 0 else len(page)


def lines_of(page: str) -> list[tuple[str, int, bool, int]]:
    """(text, weight outside links, furniture, number of its article or main or 0) of each line with text."""
    out: list[tuple[str, int, bool, int]] = []
    # Of each open element that matters its tag, its level of furniture and its region, both with what it stands in, and whether its text is left out.
    stack: list[tuple[str, int, int, bool]] = []
    stands: Counter[str] = Counter()
    text: list[str] = []
    linked, link, regions, heading = 0, False, 0, False

    def flush() -> None:
        nonlocal linked
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                level, region = stack[-1][1:3] if stack else (NO, 0)
                out.append((line, max(0, len(line) - linked), level == YES or level == HEADER and not (heading and region), region))
            text.clear()
        linked = 0

    for piece, tag, closing, rest in markup(page):
        if piece and not (stack and stack[-1][3]):
            text.append(piece)
            if link:
                linked += len(piece.strip())
        if not tag:
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCK or tag in RAW:
            flush()
        if closing:
            if tag == "a":
                link = False
            elif tag in HEADINGS:
                heading = False
            while stands[tag]:
                name = stack.pop()[0]
                stands[name] -= 1
                if name == tag:
                    break
            continue
        if tag in RAW:
            continue
        if tag in VOID or rest.endswith("/>") and tag not in BLOCK:
            continue
        if tag == "a":
            link = True
            continue
        if tag in HEADINGS:
            heading = True
            continue
        # A block ends an open paragraph, and an item one of its own kind.
        while stack and (stack[-1][0] == "p" and tag in BLOCK or stack[-1][0] == tag and tag in ITEMS):
            stands[stack.pop()[0]] -= 1
        _, level, region, muted = stack[-1] if stack else ("", NO, 0, False)
        mine, main = _judged(tag, rest)
        if tag in INLINE or tag in ITEMS or tag == "p":
            if mine == NO and not (muted and tag in INLINE):
                continue
            muted = muted or tag in INLINE and mine != NO
        elif tag not in BLOCK:
            continue
        level = max(level, mine)
        if level == NO and (tag == "article" and region <= 0 or main and not region):
            regions += 1
            region = regions if tag == "article" else -regions
        stack.append((tag, level, region, muted))
        stands[tag] += 1
    flush()
    return out


def main_text(page: str | None) -> str:
    """The kept blocks of `page`, joined by line feeds."""
    if not page:
        return ""
    lines = lines_of(page)
    weights = [0 if f else len(t) + (MARKED - 1) * w if r else w for t, w, f, r in lines]
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    runs = _runs(weights, sums)
    surged = [r for r in runs if max(sums[r[0] : r[1]]) >= SURGE]
    if not surged:
        if not runs:
            return ""
        top = max(runs, key=lambda r: (sum(weights[r[0] : r[1]]), -r[0]))
        surged = [top]
    first, last = surged[0][0], surged[-1][1]
    return "\n".join(lines[i][0] for i in range(first, last) if not lines[i][2])


def _runs(weights: list[int], sums: list[int]) -> list[tuple[int, int]]:
    """[start, end) of the runs of lines between a surge from zero and the dive to it."""
    out, start = [], None
    for i, total in enumerate(sums):
        if start is None and weights[i] > 0:
            start = i
        if start is not None and total == 0:
            out.append((start, i))
            start = None
    if start is not None:
        out.append((start, len(weights)))
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p.as_py()) for p in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars. Narrow: no shuffle."""
    ship(pages.sparkSession)
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = own.schema["page_id"].dataType.simpleString()
    return own.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
