"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags.  First pass: a block inside a
menu, header, footer, sidebar, notice, advert, form or comment area is bad; so
is one made of links; long blocks with many stop words are good, long ones
without are bad; the rest is ambiguous.  Second pass: an ambiguous block takes
the label of the nearest decided blocks, first of those judged by their text in
its own container, else of those in its section; good wins between equally
near ones.  An article that a page marks is preferred if it holds most of the
good text: then blocks outside it stay only if they are long and good by text
themselves, and blocks in it that have few stop words count as ambiguous.

Defined results: a null or empty page, or one without good blocks, gives the
empty string.  Unclosed tags are closed by the next block or by their parent; a
head also by ``<body>``, text or a tag that cannot stand in it, and a drawing
(svg, math) by any tag of the page's text.
Repeated pages are extracted each.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.store import small_batches

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be been but by can could do for from had has have he her his how i if in into is it its more my no not of on or
    our out she so some than that the their them then there these they this to up was we were what when which who will with would you your
    aber als am auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist ja kann
    man mit nach nicht noch nur oder sehr sein sich sie sind so über um und uns von vor war was wenn wer wie wir wird zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais même ne nous on ou par pas plus pour que
    qui sa se ses si son sont sur très tu un une vous
    al algo con como cuando del desde el ella ellos en entre era es esta este fue ha hay la las le lo los más me mi muy no nos o para pero
    por que se ser si sin sobre su sus también te un una y ya""".split()
)
LONG, SHORT, MANY_STOP, FEW_STOP, LINKED = 120, 60, 0.25, 0.10, 0.5

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: For pages where a quote in a tag has no end.
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style")}
#: Elements whose content is no text of the page.
_SILENT = frozenset("head template noscript svg iframe object math canvas".split())
_SILENT_END = re.compile(r"</(template|noscript|svg|iframe|object|math|canvas)\b", re.I)
#: What may stand in a head, and what ends an open svg or math element.
_IN_HEAD = frozenset("html head title base basefont bgsound link meta noframes noscript script style template".split())
_ENDS_DRAWING = frozenset(
    """b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li listing menu meta nobr ol p pre ruby s small
    span strong strike sub sup table tt u ul var article section main header footer nav aside form figure""".split()
)
_HTML_IN_DRAWING = frozenset("foreignobject desc title annotation-xml".split())
_BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td textarea
    tfoot th thead title tr ul""".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A tag of the first kind ends an open one of the second.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BOXES = frozenset("div section article main td body center blockquote".split())
_INLINE = frozenset("a b i em strong span u s small big font code tt sub sup mark abbr cite q label".split())
_BAD_TAGS = frozenset("nav footer aside form menu select textarea button dialog fieldset input option title search".split())
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
_BAD_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising advertorial adsense banner sponsor sponsored sponsors promo promoted promotion promotions
    nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager paging toc
    header masthead topbar footer foot colophon sidebar sidebars aside rail widget widgets
    cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay disclaimer paywall
    comment comments commentlist reply replies respond discussion disqus reviews
    form login signin signup subscribe subscription newsletter search share sharing social
    related recommended recommendations teaser teasers outbrain taboola copyright legal skip hidden""".split()
)
_ATTR = re.compile(r"""(class|id|role|aria-hidden|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|\Z)""", re.I)
_SPLIT_NAME = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    bad: bool
    section: int
    box: int = 0
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    heading: bool = False
    text: str = ""
    label: bool | None = None


def _is_bad(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in _BAD_TAGS or tag == "header" and not in_article:
        return True
    if not attrs:
        return False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id") and tag not in ("html", "body"):
            for part in value.split():
                words = [w.lower() for w in _SPLIT_NAME.split(part) if w]
                if any(w in _BAD_WORDS and not (in_article and w in ("header", "banner", "hidden")) for w in words):
                    return True
        elif name == "role" and value.lower() in _BAD_ROLES or name == "hidden" and value.lower() != "until-found":
            return True
        elif name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return True
    return False


def tokens(page: str) -> Iterator[tuple[str, str, bool, str, int]]:
    """(text before, tag, whether it ends, attributes, place after it) of every tag, and last the text at the end.

    A character is looked at a fixed number of times, whatever the markup: what
    has no end is searched for once.
    """
    last, tag_pattern, at, end = page.rfind(">"), _TAG, 0, 0
    parts: list[str] = []
    while 0 <= (lt := page.find("<", at)) < last:
        mark = page[lt + 1]
        if mark in "!?":
            if page.startswith("<!--", lt):
                stop = page.find("-->", lt + 4)
                stop = len(page) if stop < 0 else stop + 3
            elif page.startswith("<![CDATA[", lt):
                stop = page.find("]]>", lt + 9)
                inner, stop = (page[lt + 9 :], len(page)) if stop < 0 else (page[lt + 9 : stop], stop + 3)
                parts += [page[end:lt], html.escape(inner)]
                at = end = stop
                continue
            else:
                stop = page.find(">", lt + 2) + 1
            parts.append(page[end:lt])
            at = end = stop
            continue
        m = tag_pattern.match(page, lt) if mark == "/" or mark.isalpha() else None
        if m is None:
            if tag_pattern is _TAG and (mark.isalpha() or mark == "/" and page[lt + 2 : lt + 3].isalpha()):
                tag_pattern = _PLAIN_TAG  # the rest is read without quotes
            else:
                at = lt + 1
            continue
        parts.append(page[end:lt])
        tag, at = m[2].lower(), m.end()
        if tag in _RAW_END and not m[1]:
            raw = _RAW_END[tag].search(page, at)
            at = end = raw.end() if raw else len(page)
            continue
        end = at
        yield "".join(parts), tag, bool(m[1]), m[3], at
        parts = []
    yield "".join([*parts, page[end:]]), "", False, "", len(page)


def blocks_of(page: str) -> list[Block]:
    """Non-empty blocks in page order; section counts articles, 0 outside them."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, int]] = []  # tag, bad, section, box
    places: dict[str, list[tuple[int, int]]] = {}  # of open tags: place in the stack, block elements below
    bad, section, box, boxes, articles, links, silent, deep = False, 0, 0, 0, 0, 0, 0, 0
    outer, before = 0, 0  # the outermost silent element, and tags of _HTML_IN_DRAWING that were open then
    lasts: dict[str, int] | None = None
    block = Block(False, 0)

    def close() -> None:
        nonlocal block
        raw = "".join(block.parts)
        block.text = " ".join(html.unescape(raw).split())
        if block.text:
            out.append(block)
        block = Block(bad, section, box)

    def push(tag: str, *state) -> None:
        nonlocal links, silent, deep, outer, before
        if tag in _SILENT:
            if not silent:
                outer, before = len(stack), drawn()
            silent += 1
        places.setdefault(tag, []).append((len(stack), deep))
        stack.append((tag, *state))
        links += tag == "a"
        deep += tag in _BLOCK

    def pop() -> str:
        nonlocal bad, section, box, links, silent, deep
        tag = stack.pop()[0]
        places[tag].pop()
        bad, section, box = stack[-1][1:] if stack else (False, 0, 0)
        links -= tag == "a"
        silent -= tag in _SILENT
        deep -= tag in _BLOCK
        return tag

    def is_open(tag: str) -> bool:
        return bool(places.get(tag))

    def drawn() -> int:
        return sum(len(places.get(t, ())) for t in _HTML_IN_DRAWING)

    def never_ends(tag: str, at: int) -> bool:
        nonlocal lasts
        if lasts is None:
            lasts = {m[1].lower(): m.start() for m in _SILENT_END.finditer(page)}
        return lasts.get(tag, -1) < at

    def leave(tag: str, at: int) -> None:
        """Ends the outermost silent element if the start of ``tag`` cannot stand in it."""
        kind = stack[outer][0]
        if kind == "head":
            held = any(is_open(t) and not never_ends(t, at) for t in ("noscript", "template"))
            ends = tag == "body" or tag not in _IN_HEAD and not held
        elif kind in ("svg", "math"):
            ends = tag in _ENDS_DRAWING and (never_ends(kind, at) or drawn() == before)
        else:
            ends = tag in _BLOCK and never_ends(kind, at)
        while ends and len(stack) > outer:
            pop()

    def add(text: str) -> None:
        if silent:
            if not (stack[-1][0] == "head" and text.strip()):
                return
            pop()  # text cannot stand in a head
        if text:
            block.parts.append(text)
            if links:
                block.link_chars += len(text.strip())

    for text, tag, ending, attrs, end in tokens(page):
        add(text)
        if not tag:
            continue
        if silent and not ending:
            leave(tag, end)
        if silent:
            if not ending:
                if tag not in _VOID and not attrs.rstrip().endswith("/") and tag not in ("html", "head"):
                    push(tag, bad, section, box)
                continue
            if is_open(tag) and places[tag][-1][0] > outer:
                while pop() != tag:
                    pass
                continue
            if not is_open(tag):
                continue
        if ending:
            if tag in _BLOCK:
                close()
            if is_open(tag):
                if tag in _INLINE and places[tag][-1][1] < deep:
                    continue  # it was opened outside an open block
                while pop() != tag:
                    pass
                if not block.parts:
                    block.bad, block.section, block.box = bad, section, box
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in _BLOCK:
            close()
            while stack and stack[-1][0] in _INLINE:
                pop()  # an unclosed inline tag ends with its block
            if stack and stack[-1][0] == "p":
                pop()
                while stack and stack[-1][0] in _INLINE:
                    pop()
            while stack and stack[-1][0] in _ENDS.get(tag, ()):
                pop()
        if tag in _VOID or attrs.rstrip().endswith("/") and tag not in _BLOCK and (tag not in _SILENT or tag in ("svg", "math") or never_ends(tag, end)):
            continue
        if tag in _SILENT:
            if tag == "head":
                if len(stack) > len(places.get("html", ())):
                    continue  # a head inside the body is no head
                close()
            push(tag, bad, section, box)
            continue
        wrong = bad or _is_bad(tag, attrs, section > 0)
        inside = section
        if tag in ("article", "main") or 'role="main"' in attrs:
            if not section and not wrong:
                articles += 1
                inside = articles
        own = box
        if tag in _BOXES:
            boxes += 1
            own = boxes
        push(tag, wrong, inside, own)
        if tag in _BLOCK or wrong != bad:
            if tag not in _BLOCK and wrong:
                close()
            bad, section, box = wrong, inside, own
            block.bad, block.section, block.box, block.heading = bad, section, box, tag in ("h1", "h2", "h3", "h4", "h5", "h6")
    close()
    return out


def _ruled_out(b: Block) -> bool:
    return b.bad or b.link_chars > LINKED * len(b.text)


def _decide(b: Block) -> bool | None:
    if _ruled_out(b):
        return False
    n = len(b.text)
    if b.heading or n < SHORT:
        return None
    words = _WORD.findall(b.text.lower())
    density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if density >= MANY_STOP or n >= LONG and density >= FEW_STOP:
        return True
    return False if n >= LONG else None


def _article_preferred(blocks: list[Block]) -> bool:
    """Whether the marked article holds most of the good text of labelled ``blocks``.

    One without good text, as in a language whose stop words are not known, is
    weighed by its long blocks.
    """
    inside = sum(len(b.text) for b in blocks if b.section and b.label)
    outside = sum(len(b.text) for b in blocks if not b.section and b.label)
    inside = inside or sum(len(b.text) for b in blocks if b.section and len(b.text) >= LONG and not _ruled_out(b))
    return inside > outside or not outside and any(b.section and not b.bad for b in blocks)


def _best_box(blocks: list[Block]) -> None:
    """Where no text is good for sure, that of the container with the most of it counts as good."""
    size: dict[int, int] = {}
    for b in blocks:
        if not _ruled_out(b):
            size[b.box] = size.get(b.box, 0) + len(b.text)
    best = max(size, key=lambda k: (size[k], -k), default=None)
    for b in blocks:
        if b.box == best and not _ruled_out(b):
            b.label = True


def _nearest(labels: list[bool | None], groups: list[int]) -> list[bool | None]:
    """For each place the label of the nearest decided place of its group, true among equally near ones."""
    n = len(labels)
    best: list[tuple[int, bool] | None] = [None] * n
    for order in (range(n), range(n - 1, -1, -1)):
        last: dict[int, int] = {}
        for i in order:
            if labels[i] is not None:
                last[groups[i]] = i
            elif (j := last.get(groups[i])) is not None:
                here = (abs(i - j), not labels[j])
                best[i] = min(best[i] or here, here)
    return [labels[i] if labels[i] is not None else (not best[i][1] if best[i] else None) for i in range(n)]


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    for b in blocks:
        b.label = _decide(b)
    preferred = _article_preferred(blocks)
    if preferred:
        for b in blocks:
            if not b.section:
                b.label = b.label is True and len(b.text) >= LONG
                b.bad = not b.label
            elif not b.label and not _ruled_out(b):
                b.label = None
    if not any(b.label for b in blocks):
        _best_box(blocks)
    # long text of few stop words is bad unless what is judged by text beside it, in its own container, is good
    weak = [b.label is False and not _ruled_out(b) for b in blocks]
    beside = _nearest([None if b.bad or w else b.label for b, w in zip(blocks, weak)], [b.box for b in blocks])
    by_text = [None if b.bad else b.label for b in blocks]
    in_box = _nearest([beside[i] if weak[i] and beside[i] else x for i, x in enumerate(by_text)], [b.box for b in blocks])
    # inside an article, what its containers rule out says nothing about the text beside it
    in_section = _nearest([by_text[i] if b.section else b.label for i, b in enumerate(blocks)], [b.section for b in blocks])
    for i, b in enumerate(blocks):
        if weak[i]:
            b.label = bool(beside[i])
        elif b.label is None:
            b.label = in_box[i] if in_box[i] is not None else in_section[i]
            if b.label is None:  # an article of short blocks only is still an article
                b.label = preferred and b.section > 0
    return "\n".join(b.text for b in blocks if b.label)


def extracted(page: Column) -> Column:
    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            yield pa.array([main_text(x.as_py()) if x.is_valid else "" for x in col], pa.string())

    return extract(page)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    small_batches(pages.sparkSession)
    out = pages.select("page_id", "url", extracted(F.col("html")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
