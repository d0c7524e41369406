"""Main text of web pages by line-block distribution.

Markup is stripped to lines: block elements begin a new line, inline ones don't. What the markup itself marks as something else
(navigation, headers and footers, asides, forms, scripts, elements with the attribute hidden or the style display:none, and those that
have menu, advert, notice, comments and the like as a value of class, id or role, whole or joined to words for parts of a page alone) leaves empty lines in its place.
Not so what holds a body or main element, nor, for its attributes, what holds an article, but for comments and related parts after one; nor a form with more than half of the
page's text, nor the header of an article that has a heading. Elements end where
HTML ends them: a p, li or td without an end tag at its next sibling or with its parent. Text inside links doesn't count towards a
line's length.

On every page the lengths are then summed over sliding windows of `WINDOW` lines. Between two dives (windows that hold nothing) lies a stretch of
lines; where its windows surge to the threshold it is main text, and all of it is kept, its short lines too, from
the first to the last line that counts. If no window reaches the threshold, the stretch with the highest window is kept. An element that
holds so much of the main text keeps its other lines too: what is set aside inside it, or a list of links, doesn't cut them off.

Marks refine this. Where the page marks its article (`article`, `main`), stretches inside have a threshold of their own, which the highest of their windows always meets. Marked
elements in which a stretch surges are the main text, with all their other lines, links too; those in which none does are teasers of other articles, and stretches outside are
dropped.

A page is handled in its task; nothing is shuffled. Defined results: null and empty html give an empty text, as does a page of
markup alone; a tag or comment that never ends takes the rest of the page; repeated rows each give their row; an empty table
gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 3
THRESHOLD = 80  #: characters in WINDOW lines

# Elements of HTML by how they are laid out.
BLOCKS = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
ASIDE = set("aside button dialog footer form head header iframe menu nav noscript object select svg template textarea".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Whole values of class, id and role that mark a part as not of the article.
MARKS = set("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments contentinfo cookie cookies copyright disqus footer header menu masthead nav navbar navigation newsletter notice pagination popup promo related respond search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())

_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Marks of what follows an article, which may have article elements of its own.
AFTER = set("comment comments disqus related respond".split())
#: Words for parts of a page that a mark may be joined to: comments-list, site-footer. With any other word a value isn't a mark: notice-board.
PARTS = set("area bar block box container content form inner item items left link links list main outer page panel post right section site top bottom text thread wrap wrapper".split())
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")

# End tags that HTML allows to be left out: what a start tag ends, if it is open inside the nearest of the elements named last.
_CELL = set("button caption object table td template th".split())
_ENDS: dict[str, list[tuple[set[str], set[str]]]] = {x: [({"p"}, _CELL)] for x in "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()}
_ENDS["li"] = [({"li"}, {"ol", "ul", "menu", "dir", *_CELL}), *_ENDS["li"]]
_ENDS["dd"] = _ENDS["dt"] = [({"dd", "dt"}, {"dl", *_CELL}), *_ENDS["dd"]]
_ENDS["td"] = _ENDS["th"] = [({"td", "th"}, {"table", "tr"})]
_ENDS["tr"] = [({"tr", "td", "th", "caption"}, {"table"})]
_ENDS["tbody"] = _ENDS["thead"] = _ENDS["tfoot"] = [({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"})]
_ENDS["option"] = [({"option"}, {"select", "datalist"})]
_ENDS["optgroup"] = [({"option", "optgroup"}, {"select"})]
_ENDS["a"] = [({"a"}, BLOCKS)]
#: End tags that end what is open in them, cells as well.
_ENDS_ALL = set("article body form html main object table tbody td template tfoot th thead tr".split())
#: Blocks that hold others; lines are told apart by the innermost one around them.
_HOLDERS = set("article aside center details dialog div fieldset footer form header main nav table td th".split())
_IN_HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _marks(values: dict[str, str]) -> set[str]:
    """The marks among the values of class, id and role."""
    out = set()
    for value in (w for k in ("class", "id", "role") for w in values.get(k, "").split()):
        parts = {w.lower() for w in _WORD.findall(value)} | ({value.lower()} & MARKS)
        if parts & MARKS and (value.lower() in MARKS or parts <= MARKS | PARTS):
            out |= parts & MARKS
    return out


def _aside(name: str, attributes: str, holds: set[str], after: bool, inside: bool, most: bool) -> bool:
    """Whether an element is set aside; holds: which of body, main, article and headings it has in it, after: an article came before, inside: one is around it, most: it has more than half of the text."""
    framed = holds & {"body", "main", "article"}
    if name in ("html", "body", "article", "main") or "body" in holds or "main" in holds:
        return False
    if name in ASIDE and not (name == "form" and (framed or most)) and not (name == "header" and inside and "heading" in holds):
        return True
    values = _attributes(attributes)
    marks = _marks(values)
    if framed:
        return after and bool(marks & AFTER)
    return bool(marks) or values.get("hidden", "false").lower() != "false" or bool(re.search(r"(?i)display\s*:\s*none", values.get("style", "")))


def _nesting(page: str, pieces: list[re.Match]) -> tuple[list[int], list[int], dict[int, set[str]], list[int], set[int]]:
    """How many elements are open at the text before each piece, and at the piece itself once what it ends has ended; and what of body, main,
    article and headings the elements that begin at a piece hold; and the holder around each text (-1: the page); and the forms that have more than half of the text. End tags that are left out are
    filled in: an element ends with its parent, too."""
    stack: list[tuple[str, int, int]] = []
    count: dict[str, int] = {}
    before, left, holds, holder = [], [], {}, []
    written = 0
    forms: dict[int, int] = {}  # characters written when a form began, and then in it

    def cut(size: int) -> None:
        while len(stack) > size:
            name, i, _ = stack.pop()
            count[name] -= 1
            if name == "form":
                forms[i] = written - forms[i]

    def end(names: set[str], within: set[str], outermost: bool) -> None:
        found = -1
        if any(count.get(x) for x in names):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in names:
                    found = i
                    if not outermost:
                        break
                elif stack[i][0] in within:
                    break
        if found >= 0:
            cut(found)

    at = 0
    for i, m in enumerate(pieces):
        if stack and stack[-1][0] == "head" and page[at : m.start()].strip():
            cut(len(stack) - 1)
        before.append(len(stack))
        holder.append(stack[-1][2] if stack else -1)
        written += len(page[at : m.start()].strip())
        at = m.end()
        name = (m[3] or "").lower()
        if name and m[2] == "/":
            # As in HTML, an end tag doesn't reach out of a table cell, nor one of an inline element out of a block.
            end({name}, set() if name in _ENDS_ALL else _CELL if name in BLOCKS or name in ASIDE else BLOCKS, False)
        elif name:
            if count.get("head") and stack[-1][0] == "head" and name not in _IN_HEAD or name == "body":
                end({"head"}, set(), True)
            for names, within in _ENDS.get(name, ()):
                end(names, within, True)
        left.append(len(stack))
        if name and m[2] != "/" and name not in VOID and not m[4].endswith("/"):
            mark = name if name in ("body", "main", "article") else "heading" if re.fullmatch("h[1-6]", name) else None
            if mark:
                for _, k, _ in reversed(stack):
                    own = holds.setdefault(k, set())
                    if mark in own:
                        break
                    own.add(mark)
            if name == "form":
                forms[i] = written
            stack.append((name, i, i if name in _HOLDERS else stack[-1][2] if stack else -1))
            count[name] = count.get(name, 0) + 1
    last = stack[-1][2] if stack else -1
    written += len(page[at:].strip())
    cut(0)
    return before, left, holds, [*holder, last], {i for i, n in forms.items() if 2 * n > written}


def lines(page: str) -> list[tuple[str, int, int, int]]:
    """(text, characters that count, number of the outermost article or main element around or 0, holder) of every line with text; WINDOW empty lines for what is set aside and where a marked element begins or ends."""
    out: list[tuple[str, int, int, int]] = []
    text: list[str] = []
    aside = -1  # how many elements are open around the one that is set aside
    link = -1  # the same for the link that the text is in
    counted = at = articles = region = 0
    after, around = False, -1

    def end_line() -> None:
        nonlocal counted
        if whole := " ".join(html.unescape("".join(text)).split()):
            out.append((whole, min(counted, len(whole)), region if articles else 0, around))
        text.clear()
        counted = 0

    pieces = list(_PIECE.finditer(page))
    before, left, holds, holder, most = _nesting(page, pieces)
    for i, m in enumerate([*pieces, None]):
        if m and before[i] <= aside:
            aside = -1
        piece = page[at : m.start() if m else len(page)]
        if piece and aside < 0:
            if piece.strip():
                around = holder[i]
            text.append(piece)
            counted += 0 if link >= 0 else len(piece.strip())
        if m is None:
            break
        at = m.end()
        name, closing = (m[3] or "").lower(), m[2] == "/"
        if not name:  # comments, scripts, declarations
            continue
        if left[i] <= aside:
            aside = -1
        if left[i] <= link:
            link = -1
        if aside >= 0:
            continue
        if not closing and name not in VOID and _aside(name, m[4], holds.get(i, set()), after, articles > 0, i in most):
            end_line()
            out.extend([("", 0, region if articles else 0, -1)] * WINDOW)
            if not m[4].endswith("/"):
                aside = left[i]
        else:
            if name in BLOCKS:
                end_line()
            if name in ("article", "main"):
                region += not closing and not articles
                outside, articles = articles == 0, max(0, articles + (-1 if closing else 1))
                if outside != (articles == 0):  # the border of what is marked is a dive
                    out.extend([("", 0, 0, -1)] * WINDOW)
                after = after or name == "article"
            elif name == "a" and not closing and not m[4].endswith("/") and "href" in _attributes(m[4]):
                link = left[i]
    end_line()
    return out


def stretches(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(highest window, first and last line that counts) of every stretch of lines between two dives."""
    windows = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    out: list[tuple[int, int, int]] = []
    first = last = peak = -1
    for i, total in enumerate([*windows, 0]):
        if total:
            if lengths[i]:
                first, last = (i if first < 0 else first), i
            peak = max(peak, total)
        elif first >= 0:
            out.append((peak, first, last))
            first = peak = -1
    return out


def main_text(page: str | None) -> list[str]:
    """The blocks of a page's main text, in order."""
    found = lines(page or "")
    lengths = [x[1] for x in found]
    every = stretches(lengths)
    some = [s for s in every if any(found[i][2] and lengths[i] for i in range(s[1], s[2] + 1))] or every
    least = min(THRESHOLD, max((s[0] for s in some), default=0))
    kept = {i for peak, first, last in some if peak >= least for i in range(first, last + 1)}
    if regions := {found[i][2] for i in kept if lengths[i]} - {0}:
        return [text for text, _, region, _ in found if region in regions and text]
    held: dict[int, int] = {}
    for i in kept:
        held[found[i][3]] = held.get(found[i][3], 0) + lengths[i]
    # The other lines of what holds main text, from its first to its last one that counts.
    counting: dict[int, list[int]] = {}
    for i, (text, counted, _, around) in enumerate(found):
        if text and counted and held.get(around, 0) >= least:
            counting.setdefault(around, []).append(i)
    kept |= {i for i, x in enumerate(found) if (own := counting.get(x[3])) and own[0] <= i <= own[-1]}
    return [found[i][0] for i in sorted(kept) if found[i][0]]


def extract(pages: DataFrame, page: str = "html") -> DataFrame:
    """The rows of pages as `row`, with the main text: blocks joined by an empty line."""

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        return column.map(lambda x: "\n\n".join(main_text(x)))

    return common.nested(pages, html=F.col(f"`{page}`")).select("row", text("html").alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    found = extract(common.read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("bigint").alias("n_chars"))
