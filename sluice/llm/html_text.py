"""The main text of web pages by two passes of block rules.

A page is cut into blocks at its block-level tags. The first pass labels a block by the container that it stands in, its
link density, its length and the density of stop words: good, bad or, when it is short or between the limits, ambiguous. The
second pass gives ambiguous blocks the label of the nearest decided neighbour (of two as near the one before; a heading that of
the one after). Good blocks are the main text.

A container that says what it is (menus, forms, side columns, comments, adverts by tag, role or class) makes its blocks
bad; blocks outside an article are bad where a page has an article; neighbours are looked for within one zone.

Defined cases: a null or empty page has an empty text; tags and comments that a page's end cuts off are left out, text up
to there counts; scripts and styles that never end reach to the page's end; an attribute's quote that never ends is read as
a plain tag; unknown and broken references stay as they are; repeated rows are treated one by one; other columns aren't read,
whatever their names; an empty table gives no rows. Pages are treated whole and row by row: nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, batch

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]{0,65536}"|'[^']{0,65536}')*+)(?:>|\Z)"""
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_RAW = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in ("script", "style", "title", "textarea", "iframe", "noscript", "noframes", "noembed", "xmp", "template", "svg")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header"
    " hgroup hr html legend li listing main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Opening one of these closes an open element of the second set, unless an element of the third stands between.
_CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    **dict.fromkeys(("dt", "dd"), (frozenset(["dt", "dd"]), frozenset(["dl"]))),
    **dict.fromkeys(("td", "th"), (frozenset(["td", "th"]), frozenset(["tr", "table"]))),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_P, _P_SCOPE = frozenset(["p"]), frozenset("table td th caption button object html".split())
_SIDE_TAGS = frozenset("nav footer aside select button dialog menu search head".split())
_TELLING = _SIDE_TAGS | frozenset("article main form fieldset header".split())
_SIDE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar dialog alert alertdialog status tooltip form".split())
_SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs"
    " sidebar sidenav masthead footer topbar toolbar cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription"
    " signup login share sharing social related recommended recommendations pagination pager widget widgets skip copyright paywall alert".split()
)
_TALK_WORDS = frozenset("comment comments commentlist disqus replies respond discussion".split())
_LAYOUT_WORDS = frozenset("with has no without hide show".split())
_ARTICLE_NAMES = frozenset("article article-body articlebody article-content article-text post-content post-body entry-content story story-body hentry".split())
_TALK_HEADING = re.compile(r"(\d+ )?(reader |readers.? )?(comments?|kommentare?|commentaires?|comentarios?|related articles|related posts|you may also like|mehr zum thema)( \(?\d+\)?)?[:.]?", re.I)
_NOTICE = re.compile(r"©|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|\bcookies?\b.*\b(accept|agree|consent|use|akzept|einverstanden|accepte|acepta)|\b(newsletter|subscribe)\b", re.I | re.S)
_AD_LABEL = re.compile(r"(advertisement|advertising|sponsored|werbung|anzeige|publicité|publicidad|anuncio)[:.]?", re.I)
_WORD = re.compile(r"[^\W\d_]+")

STOP_WORDS = {
    "en": frozenset("a about after all also an and are as at be been but by can for from had has have he her his i if in into is it its more not of on or our she so that the their there they this to was we were what when which who will with would you your".split()),
    "de": frozenset("aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für haben hat ich ihr im in ist man mit nach nicht noch nur oder sein sich sie sind so über um und uns unter vom von vor war was wenn wie wird wir zu zum zur".split()),
    "fr": frozenset("à au aux avec ce ces cette comme dans de des du elle en est et été il ils je la le les leur lui mais même ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur un une vous y".split()),
    "es": frozenset("a al como con de del desde dos el ella en entre era es esta este fue ha hasta la las lo los más me no nos o para pero por que se según ser si sin sobre son su sus también un una uno y ya".split()),
}


@dataclass
class Rules:
    """Limits of the first pass, in code points and shares. `sparse`: a page whose best language has fewer stop words has none to judge by."""

    short: int = 70
    long: int = 200
    low: float = 0.20
    high: float = 0.30
    links: float = 0.33
    article_links: float = 0.60
    sparse: float = 0.02
    stop_words: dict[str, frozenset[str]] = field(default_factory=lambda: STOP_WORDS)


@dataclass(slots=True)
class _Element:
    name: str
    side: int  # 2: never main text; 1: unless an article stands in it; 0: no
    zone: int  # 2: in an article; 1: in a main element; 0: no
    link: bool
    header: bool


@dataclass(slots=True)
class Block:
    text: str
    linked: int  # characters inside links
    side: bool
    zone: int
    heading: bool
    label: str = ""


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): unescape(v.strip("\"'")) for k, v in reversed(_ATTRIBUTE.findall(text))} if "=" in text or "hidden" in text else {}


def _element(name: str, written: str, above: _Element) -> _Element:
    """What an opening tag makes of the place that it opens, below `above`."""
    side, zone, header = above.side, above.zone, above.header
    if not written and name not in _TELLING:
        return _Element(name, side, zone, above.link or name == "a", header)
    at = _attributes(written) if written else {}
    role = at.get("role", "").lower()
    names = f"{at.get('class', '')} {at.get('id', '')}".lower().split()
    talk = article = False
    for n in names:
        words = set(_WORD.findall(n))
        talk |= bool(words & _TALK_WORDS) and not words & _LAYOUT_WORDS
        article |= n in _ARTICLE_NAMES
    if name in ("article", "main") or role in ("main", "article") or article or "articlebody" in at.get("itemprop", "").lower():
        if name == "article" and (talk or any(n in _SIDE_WORDS or n in ("teaser", "card") for n in names)):
            side = 2
        elif side < 2:
            side, zone = 0, max(zone, 1 if name == "main" or role == "main" else 2)
            header = False
    elif name not in ("html", "body"):
        if name in _SIDE_TAGS or role in _SIDE_ROLES or talk or "hidden" in at or re.search(r"display\s*:\s*none", at.get("style", "")):
            side = 2
        elif name in ("form", "fieldset") or any(not (w := set(_WORD.findall(n))) & _LAYOUT_WORDS and (w & _SIDE_WORDS or "header" in w and not zone) for n in names):
            side = max(side, 1)
        if name == "header":
            side, header = (side, True) if zone == 2 else (max(side, 1), header)
    return _Element(name, side, zone, above.link or name == "a", header)


def blocks_of(html: str) -> list[Block]:
    """A page's blocks with text, in order."""
    found: list[Block] = []
    stack = [_Element("", 0, 0, False, False)]
    open_now: dict[str, int] = {}
    parts: list[str] = []
    linked = at = 0
    heading = False

    def close(k: int) -> None:
        for e in stack[k:]:
            open_now[e.name] -= 1
        del stack[k:]

    def end_block() -> None:
        nonlocal linked, heading
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                top = stack[-1]
                found.append(Block(text, linked, top.side > 0 or top.header and not heading, top.zone, heading))
        linked = 0

    def implied(name: str) -> None:
        goals, scope = _CLOSES.get(name, (None, None))
        for own, stop in ((goals, scope), (_P, _P_SCOPE)):
            if own and any(open_now.get(g) for g in own):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in own:
                        close(k)
                        break
                    if stack[k].name in stop:
                        break

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if stack[-1].link:
                linked += len(piece.strip())

    while m := _TAG.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        closing, name, written = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if name is None:
            continue
        name = name.lower()
        if not closing and name in _RAW and not (name == "svg" and written.endswith("/")):
            rest = _RAW[name].search(html, at)
            at = rest.start() if rest else len(html)
            continue
        block = name in _BLOCK
        if name == "br":
            parts.append(" ")
            continue
        if block:
            end_block()
        if closing:
            if open_now.get(name):
                k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name)
                if block or not any(e.name in _BLOCK for e in stack[k + 1 :]):
                    close(k)
                else:  # an inline end tag doesn't close the blocks inside
                    open_now[name] -= 1
                    del stack[k]
                    if name == "a":
                        for e in stack[k:]:
                            e.link = any(x.name == "a" for x in stack[:k])
            if len(name) == 2 and name[0] == "h" and name[1].isdigit():
                heading = False
                if name != "h1" and found and found[-1].heading and _TALK_HEADING.fullmatch(found[-1].text):
                    found[-1].side = True
                    stack[-1].side = 2
        elif name not in _VOID:
            if block:
                implied(name)
                heading = name[0] == "h" and name[1:].isdigit() or heading and name not in ("p", "div", "li", "section", "article")
            elif name == "a" and open_now.get("a"):
                k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == "a")
                if not any(e.name in _BLOCK for e in stack[k + 1 :]):
                    close(k)
            stack.append(_element(name, written, stack[-1]))
            open_now[name] = open_now.get(name, 0) + 1
    text(html[at:])
    end_block()
    return found


def _stop_share(words: list[str], stop: frozenset[str]) -> float:
    return sum(map(stop.__contains__, words)) / len(words) if words else 0.0


def labelled(found: list[Block], rules: Rules) -> list[Block]:
    """The blocks with their labels, good or bad."""
    if not found:
        return found
    words = [_WORD.findall(b.text.lower()) for b in found]
    counts = Counter(chain.from_iterable(words))
    hits = lambda s: sum(counts[w] for w in s if w in counts)
    stop = max(rules.stop_words.values(), key=hits, default=frozenset())
    blind = hits(stop) < rules.sparse * max(1, counts.total())
    article = any(b.zone == 2 and not b.side for b in found)
    for b, own in zip(found, words, strict=True):
        n, links = len(b.text), b.linked / len(b.text)
        dense = _stop_share(own, stop)
        in_main = b.zone == 2 or not article and b.zone == 1
        if b.side or _AD_LABEL.fullmatch(b.text):
            b.label = "bad"
        elif article and b.zone < 2:
            b.label = "short" if b.heading and b.zone == 1 else "bad"
        elif in_main:
            b.label = "good" if links <= rules.article_links and (n >= rules.short or dense >= rules.low) else "bad" if links > rules.article_links and n >= rules.short else "short"
        elif links > rules.links or n < 2 * rules.long and _NOTICE.search(b.text):
            b.label = "bad"
        elif n < rules.short:
            b.label = "bad" if b.linked else "short"
        elif blind or dense >= rules.high:
            b.label = "good" if n > rules.long else "near"
        else:
            b.label = "near" if dense >= rules.low else "bad"
    return _inherit(found)


def _inherit(found: list[Block]) -> list[Block]:
    """Labels of ambiguous blocks from the nearest decided block on either side, within one zone and outside side containers."""
    open_blocks = [b for b in found if not b.side]
    if not open_blocks:
        return found
    zones = [b.zone for b in open_blocks]

    def nearest(ks: range, decided: tuple[str, ...]) -> list[tuple[int, str] | None]:
        out: list[tuple[int, str] | None] = [None] * len(open_blocks)
        last: dict[int, tuple[int, str]] = {}
        for k in ks:
            out[k] = last.get(zones[k])
            if open_blocks[k].label in decided:
                last[zones[k]] = (k, open_blocks[k].label)
        return out

    n = len(open_blocks)
    for own, decided in (("near", ("good", "bad")), ("short", ("good", "bad"))):
        before, after = nearest(range(n), decided), nearest(range(n - 1, -1, -1), decided)
        new = {}
        for k, b in enumerate(open_blocks):
            if b.label != own:
                continue
            sides = [x for x in (before[k], after[k]) if x]
            if not sides:
                new[k] = "good"  # nothing speaks against it
            elif own == "near":
                new[k] = "good" if any(x[1] == "good" for x in sides) or not b.linked else "bad"
            elif b.heading and after[k]:
                new[k] = after[k][1]
            else:
                new[k] = min(sides, key=lambda x: (abs(x[0] - k), x[0]))[1]
        for k, label in new.items():
            open_blocks[k].label = label
    return found


def main_text(html: str | None, rules: Rules | None = None) -> str:
    """The good blocks of a page, joined by an empty line."""
    return "\n\n".join(b.text for b in labelled(blocks_of(html), rules or Rules()) if b.label == "good") if html else ""


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), rules: Rules | None = None) -> DataFrame:
    """keep, text and n_chars of every page."""
    rules = rules or Rules()
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, rules) for h in b.column(len(keep)).to_pylist()]
            yield batch([*keep, "text", "n_chars"], *[b.column(k) for k in range(len(keep))], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()))

    return arrow_map(pages, [*keep, html], run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", text string, n_chars bigint")
