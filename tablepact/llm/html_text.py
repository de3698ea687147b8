"""Main text of web pages by line-block distribution (operator 10).

Markup is stripped into lines, one for each block element. A line's length is
its text's, or none where links make up most of it or it begins with a copyright sign,
outside a marked article. A menu, header, footer, sidebar, notice,
advert, form, comment or other matter is set apart by the page's own markup. Lengths are summed over a
sliding window of ``WINDOW`` lines. Where the sums leave zero is a surge and
where they return to it a dive. What is set apart isn't a line at all, so that an
advert inside an article doesn't end it. A class or id sets apart by its whole name ("site-footer"),
not by a part of it ("has-sidebar"). Where a page marks its articles (``article``; siblings go together)
or its main part (``main``), all lines inside are kept of the one with more text; the main part counts without
the articles in it. So are articles that hold less text than the rest of the page, if it isn't less
than a quarter of that; else only what lies within the page's own content. There, the span between a surge and a dive
that has the most text tells the content's container: the smallest one around it, or a larger
one, unless that adds more links than text and less than a quarter of the text. All spans in the container are kept, whole; so are lines of
links, or of a copyright, that lie in the same container as the text beside them (at an
end, if they are fewer than ``WINDOW``). Lists of links directly in the page are a menu's.

Cases. A null or empty page, and one with no text, gives an empty text. Tags that
are never closed, or closed twice, do no harm. An unclosed comment or script runs
to the end of the page, as in a browser. Repeated rows each give a row. Other
columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WINDOW = 3

RAW = frozenset("script style noscript template textarea iframe svg math object canvas select".split())
_NAME = re.compile(r"[a-z][^\s/>]*", re.I)
_WORD = re.compile(r"[a-z0-9_]+", re.I)
_STOP = re.compile(r"[>\"']")
_OPEN = re.compile(r"<[/!?a-zA-Z]")
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_ATTR = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_NONE = re.compile(r"\s*display\s*:\s*none|.*;\s*display\s*:\s*none|.*visibility\s*:\s*hidden", re.I | re.S)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that an open paragraph or item doesn't outlive.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = frozenset("article aside body div dl footer form header html main nav ol section table ul fieldset details blockquote".split())
APART = frozenset("nav footer aside form button dialog menu head fieldset datalist".split())
#: Elements whose lines can be the page's content.
BOXES = frozenset("article center div main section td".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promoted promotion promotions "
    "nav navbar navigation menu menus breadcrumb breadcrumbs masthead header topbar footer bottombar sidebar sidebars aside rail "
    "comment comments commentlist disqus reply replies respond discussion cookie cookies consent gdpr notice notices alert alerts popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets toolbar pagination pager "
    "search searchbox form copyright disclaimer skip banner".split()
)
#: Words that leave the meaning of a name as it is ("site-footer", "sidebar-left"); any other ("has-", "no-", "elementor-") changes it.
NEUTRAL = frozenset(
    "site page main primary secondary tertiary top bottom left right inner outer upper lower global mobile desktop sticky fixed floating small large big "
    "box bar block blocks list item items container wrapper wrap area section slot unit zone group row col column link links button buttons btn icon icons "
    "count thread title heading body text image card cards panel region google dfp gpt posts articles stories news".split()
)
#: Of these, what a name says of an article's own parts isn't set apart ("entry-header").
OWNERS, PARTS = frozenset("post article entry story".split()), frozenset("header masthead banner widget".split())


def _named(value: str) -> bool:
    """Whether a class or id, as a whole, names what isn't part of an article."""
    for token in value.split():
        pieces = {t.lower() for t in _TOKEN.findall(token)}
        names = pieces & NAMES
        if pieces & OWNERS:
            names -= PARTS
        if names and all(t in names or t in NEUTRAL or t in OWNERS or len(t) == 1 or t.isdigit() for t in pieces):
            return True
    return False


def _apart(tag: str, rest: str, inside: bool) -> bool:
    """Whether an element is no part of an article."""
    if tag in APART or tag == "header" and not inside:
        return True
    if "=" not in rest and "hidden" not in rest.lower():
        return False
    for name, *values in _ATTR.findall(rest):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _NONE.match(value):
            return True
        if name == "role" and value.strip().lower() in ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body", "main") and _named(value):
            return True
    return False


def _tag_ends(page: str) -> tuple[list[int], list[int]]:
    """The places of ``>`` and of quotes, and for each where a tag that goes on there, outside quotes, ends (-1: nowhere).

    Found from the page's end, so a quote that is never closed costs no more than any other character.
    """
    stops = [m.start() for m in _STOP.finditer(page)]
    ends = [-1] * (len(stops) + 1)
    near = {'"': len(stops), "'": len(stops)}
    for k in range(len(stops) - 1, -1, -1):
        c = page[stops[k]]
        if c == ">":
            ends[k] = stops[k] + 1
        else:
            if near[c] < len(stops):
                ends[k] = ends[near[c] + 1]
            near[c] = k
    return stops, ends


def parts(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """The page's markup: start, end, and of a tag its name (lower case), whether it closes, and its attributes; comments and raw elements have no name."""
    stops, ends = _tag_ends(page)
    at = page.find("<")
    while at >= 0:
        end, name, closes, rest = -1, None, False, ""
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4) + 3
            end = end if end > 2 else len(page)
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at + 1) + 1 or len(page)
        else:
            closes = page.startswith("/", at + 1)
            m = _NAME.match(page, at + 1 + closes)
            if m:
                end = ends[bisect_left(stops, m.end())]
                raw = "" if closes else _WORD.match(page, at + 1)[0].lower()
                if end >= 0 and raw in RAW:
                    m = _ENDS[raw].search(page, end)
                    end = m.end() if m else len(page)
                elif end >= 0:
                    name, rest = m[0].lower(), page[m.end() : end - 1]
        if end >= 0:
            yield at, end, name, closes, rest
        at = page.find("<", max(end, at + 1))


class Box:
    """A container and the lines from ``lo`` to ``hi`` (excluded) in it; the page itself has no parent."""

    __slots__ = ("tag", "parent", "lo", "hi")

    def __init__(self, tag: str, parent: Box | None, lo: int) -> None:
        self.tag, self.parent, self.lo, self.hi = tag, parent, lo, -1


def lines(page: str) -> list[tuple[str, int, int, bool, Box]]:
    """The page's blocks: text, its length in links, the article (from 1) or main (-1) that holds it, whether it is set apart, its container."""
    out: list[tuple[str, int, int, bool, Box]] = []
    box = root = Box("", None, 0)
    stack: list[tuple[str, bool, int, Box]] = []  # tag, set apart, article, container
    held: list[str] = []
    opened: Counter[str] = Counter()  # tags in the stack
    linked = at = articles = 0
    apart, article = False, 0

    def close() -> None:
        nonlocal held, linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((text, linked, article, apart, box))
            held, linked = [], 0

    def cut(depth: int) -> None:
        nonlocal apart, article, box
        for x in stack[depth:]:
            opened[x[0]] -= 1
        del stack[depth:]
        apart, article, within = stack[-1][1:] if stack else (False, 0, root)
        while box is not within:
            box.hi, box = len(out), box.parent

    for start, end, tag, closes, rest in parts(page):
        if start > at:
            held.append(page[at:start])
            if opened["a"]:
                linked += start - at
        at = end
        if tag is None:
            continue
        inline = tag in INLINE
        if not inline:
            close()
        if closes:
            for depth in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[depth][0] == tag:
                    if inline and stack[depth][1] and held:
                        close()
                    cut(depth)
                    break
                if stack[depth][0] in HOLDS and tag not in HOLDS:
                    break
            continue
        if tag in VOID or rest.endswith("/") and inline:
            continue
        if not inline:
            ends = ("p", *CLOSES.get(tag, ()))
            for depth in range(len(stack) - 1, -1, -1) if any(opened[t] for t in ends) else ():
                if stack[depth][0] in ends:
                    cut(depth)
                    if "p" not in ends or tag not in CLOSES:
                        break
                elif stack[depth][0] in HOLDS:
                    break
        out_of = apart or _apart(tag, rest, article > 0)
        if inline and out_of != apart:
            close()
        apart = out_of
        if tag == "article" and not apart and article <= 0:
            articles += 1
            article = articles
        elif tag == "main" and not article:
            article = -1
        if tag in BOXES:
            box = Box(tag, box, len(out))
        stack.append((tag, apart, article, box))
        opened[tag] += 1
    if at < len(page):
        rest = page[at:]
        # A tag cut off by the end of the page isn't text.
        cut_off = _OPEN.search(rest, rest.rfind(">") + 1)
        held.append(rest[: cut_off.start()] if cut_off else rest)
    close()
    cut(0)
    root.hi = len(out)
    return out


def main_text(page: str | None, window: int = WINDOW) -> str:
    """The text of the page's articles, its main part or the container of its longest run of text, whichever has the most."""
    found = lines(page or "")
    return " ".join(found[i][0] for i in content(found, window))


def content(found: list[tuple[str, int, int, bool, Box]], window: int) -> list[int]:
    """The lines of the page's content."""
    seen = [i for i, x in enumerate(found) if not x[3]]
    mass = lambda places: sum(max(0, len(found[i][0]) - found[i][1]) for i in places)
    count = [0]
    for x in found:
        count.append(count[-1] + (not x[3]))
    homes: dict[int, tuple[Box, bool]] = {}
    groups: dict[Box, list[int]] = {}
    main = []
    for i in seen:
        article = found[i][2]
        if article > 0:
            if article not in homes:
                homes[article] = _home(found[i][4], count)
            groups.setdefault(homes[article][0], []).append(i)
        if article < 0 or article > 0 and homes[article][1]:
            main.append(i)
    marked = max(groups.values(), key=lambda g: (mass(g), sum(len(found[i][0]) for i in g), -g[0]), default=main)
    if main and mass(main) - (mass(marked) if homes.get(found[marked[0]][2], (None, False))[1] else 0) > mass(marked):
        marked = main
    if not marked:
        return unmarked(found, seen, window)[1]
    box, free = unmarked(found, [i for i in seen if not found[i][2]], window)
    if mass(free) <= mass(marked):
        return marked
    # The page outweighs what it marks; where it does so clearly, what is marked stays only within it.
    lo, hi = (box.lo, box.hi) if box.parent else (free[0], free[-1])
    more = [i for i in seen if found[i][2] and lo <= i < hi]
    return sorted({*free, *more, *(marked if 4 * mass(marked) >= mass(free) else ())})


def _home(box: Box, count: list[int]) -> tuple[Box, bool]:
    """The container of an article, given one in it, that its siblings share, and whether that is in the main part."""
    article, up = box, box
    while up:
        if up.tag == "article":
            article = up
        up = up.parent
    home = article.parent
    while home.tag == "div" and count[home.hi] - count[home.lo] == count[article.hi] - count[article.lo]:
        home = home.parent
    up = home
    while up and up.tag != "main":
        up = up.parent
    return home, up is not None


def unmarked(found: list[tuple[str, int, int, bool, Box]], seen: list[int], window: int) -> tuple[Box | None, list[int]]:
    """The container of the longest run of text in some lines, and its lines."""
    full = [i for i in seen if 2 * found[i][1] <= len(found[i][0]) and found[i][0][0] != "©"]
    if not full:
        return None, []
    # Runs of lines from a surge to the dive after it, as places in ``seen``.
    at = {i: k for k, i in enumerate(seen)}
    spans: list[list[int]] = []
    for i in full:
        if spans and at[i] - spans[-1][1] <= window:
            spans[-1][1] = at[i]
        else:
            spans.append([at[i], at[i]])
    texts, links = [0], [0]
    for i, (text, linked, *_) in enumerate(found):
        linked = min(linked, len(text))
        texts.append(texts[-1] + (len(text) - linked if i in at else 0))
        links.append(links[-1] + (linked if i in at else 0))
    first, last = max(spans, key=lambda s: texts[seen[s[1]] + 1] - texts[seen[s[0]]])
    box = found[seen[first]][4]
    while box.hi <= seen[last]:
        box = box.parent
    # A container around it takes its place unless it adds mostly links, and little text.
    outer = box.parent
    while outer:
        held, more, linked = texts[box.hi] - texts[box.lo], texts[outer.hi] - texts[outer.lo], links[outer.hi] - links[outer.lo] - links[box.hi] + links[box.lo]
        more -= held
        if more > linked or 4 * more > held:
            box = outer
        elif linked:
            break
        outer = outer.parent
    spans = [s for s in spans if box.lo <= seen[s[0]] and seen[s[1]] < box.hi]
    # Lines between two spans, or up to a few at the ends, belong to the content if they are in the very container of the lines beside them.
    own = lambda k: found[seen[k]][4]
    out: list[int] = []
    before = max(-1, spans[0][0] - window - 1)
    lead = [k for k in range(before + 1, spans[0][0]) if own(k) is own(spans[0][0]) and own(k).parent]
    out += lead if len(lead) < window else []
    for n, (a, b) in enumerate(spans):
        out += range(a, b + 1)
        end = spans[n + 1][0] if n + 1 < len(spans) else min(len(seen), b + window + 1)
        rest = [k for k in range(b + 1, end) if own(k) is own(b) and own(k).parent]
        if n + 1 < len(spans) and own(b) is own(end) or n + 1 == len(spans) and len(rest) < window:
            out += rest
    return box, [seen[k] for k in out]


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """One row a page: page_id, url, text, n_chars (code points)."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(markup).cast("string").alias("html"))
    return rows.mapInArrow(texts, "page_id long, url string, text string, n_chars long")
