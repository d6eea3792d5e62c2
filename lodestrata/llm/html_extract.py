"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags.  Pass one decides by structure (menus, adverts, forms, comments and the
like are out), link density, length and stop-word density; what is too short to tell stays open.  In pass two open
blocks take the decision of the nearest decided block of their region, the better one if two are equally near.  A
region is an article (or main) element, or the page outside them; if articles hold most of a page's good text, only they
count.  Where no block has the stop words of a known language, length and links decide alone.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestrata.llm.common import map_text, take_memory

LENGTH_LOW, LENGTH_HIGH = 70, 200
STOPS_LOW, STOPS_HIGH = 0.15, 0.30
#: A page whose longer blocks have fewer stop words than this is in a language that the list doesn't know.
STOPS_NONE = 0.05
LINKS_MOST = 0.4

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """the of and to in a is that it for was on are as with his they at be this from or had by not but what some we can out were all
    der die und das von zu den mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
    de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son mais
    el los las y del se por con una su para al lo como o pero sus este ya entre cuando muy sin sobre ser""".split()
)
# HTML elements by their part in a page.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td
    tfoot th thead tr ul""".split()
)
SILENT_TAGS = frozenset("script style noscript template textarea title iframe svg math object canvas audio video head xmp noembed noframes".split())
OUT_TAGS = frozenset("nav footer aside form menu select button dialog fieldset".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
OUT_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored sponsors promo promotion promoted cookie
    cookies consent gdpr notice notices newsletter subscribe subscription popup modal overlay comment comments reply replies
    respond disqus sidebar related recommended recommendations share sharing social menu nav navbar navigation breadcrumb
    breadcrumbs footer header masthead copyright pagination pager widget toolbar login signup disclaimer paywall""".split()
)
#: Words that say nothing of a class's subject; in an article a class is out only if its other words are all out.
PLAIN_NAMES = frozenset(
    """area aside bar block bottom box button buttons col column container content count desktop element elements form grid group
    holder icon icons inline inner item items large left link links list lists main message messages middle mobile module
    outer page pane panel post posts right row section sections site slot small strip text title top unit wrap wrapper""".split()
)

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"[^\s/>][^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORD = re.compile(r"[^\W\d_]+")


class Block:
    __slots__ = ("text", "links", "out", "region", "good", "near", "stops")

    def __init__(self, text: str, links: int, out: bool, region: int):
        self.text, self.links, self.out, self.region = text, links, out, region
        self.good: bool | None = None
        self.near = False
        self.stops = 0.0


class _Reader:
    """Cuts a page into text, tags and comments; every character is passed once, whatever is missing at the end."""

    def __init__(self, page: str):
        self.page, self.lower = page, None
        self.gone: set[str] = set()  # what was searched for and is not in the rest of the page

    def find(self, what: str, at: int, lower: bool = False) -> int:
        if what in self.gone:
            return -1
        if lower and self.lower is None:
            low = self.page.lower()  # a few characters change their length, which would shift all places
            self.lower = low if len(low) == len(self.page) else re.sub("[A-Z]+", lambda m: m.group(0).lower(), self.page)
        k = (self.lower if lower else self.page).find(what, at)
        if k < 0:
            self.gone.add(what)
        return k

    def attributes(self, at: int) -> tuple[dict[str, str] | None, bool, int]:
        """Attributes from here to the tag's end, whether it ends in />, and the place behind it; None without an end.
        Quotes open a value only behind an equals sign; one that is never closed is a bare value."""
        page, got = self.page, {}
        while True:
            gap = _GAP.match(page, at)
            at = gap.end()
            if at >= len(page):
                return None, False, at
            if page[at] == ">":
                return got, gap.group(0).endswith("/"), at + 1
            name = _ATTRIBUTE.match(page, at)
            at, value = name.end(), ""
            equals = _EQUALS.match(page, at)
            if equals:
                at = equals.end()
                quote = page[at : at + 1]
                end = self.find(quote, at + 1) if quote in ('"', "'") else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    bare = _BARE.match(page, at)
                    value, at = bare.group(0), bare.end()
            got.setdefault(name.group(0).lower(), value)

    def __iter__(self) -> Iterator[tuple[str, str, dict[str, str]]]:
        """(kind, name or text, attributes) with kind text, open or close.  What script and its like hold is left out."""
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            k = self.find("<", at)
            if k < 0:
                yield "text", page[at:], {}
                return
            if k > at:
                yield "text", page[at:k], {}
            at = k + 1
            if page.startswith("!--", at):
                end = self.find("-->", at + 3)
                at = n if end < 0 else end + 3
                continue
            if page[at : at + 1] in ("!", "?"):
                end = self.find(">", at)
                at = n if end < 0 else end + 1
                continue
            closing = page.startswith("/", at)
            name = _NAME.match(page, at + closing)
            if name is None:
                yield "text", "<", {}
                continue
            tag = name.group(0).lower()
            found, empty, at = self.attributes(name.end())
            if found is None:
                return
            yield ("close" if closing else "open"), tag, found
            if tag in SILENT_TAGS and not closing and not empty:
                end = self.find(f"</{tag}", at, lower=True)
                if end >= 0:
                    end = self.find(">", end)
                    at = n if end < 0 else end + 1
                elif tag in ("script", "style", "textarea", "title", "xmp"):
                    at = n


def _is_out(tag: str, a: dict[str, str], in_article: bool) -> bool:
    """Whether an element is no part of a main text.  In an article its names must say so whole (related, share-links):
    a class like related-work may hold prose."""
    if tag in OUT_TAGS or tag == "header" and not in_article:
        return True
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in OUT_ROLES:
        return True
    if "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    if tag in ("article", "main", "body", "html"):
        return False
    for name in f"{a.get('class', '')} {a.get('id', '')}".split():
        parts = {p.lower() for p in _PARTS.findall(name)}
        if parts & OUT_NAMES and (not in_article or parts <= OUT_NAMES | PLAIN_NAMES):
            return True
    return False


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order.  Region 0 is the page outside articles; each article has a number of its own."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # tag, whether left out, region
    opened: Counter[str] = Counter()  # of the tags on the stack
    text: list[str] = []
    links = regions = 0
    linked = -1  # how deep the stack was where a link began; a link ends with the element that holds it

    def flush() -> None:
        nonlocal links
        s = " ".join(html.unescape("".join(text)).split())
        if s:
            _, o, r = stack[-1] if stack else ("", False, 0)
            out.append(Block(s, links, o, r))
        text.clear()
        links = 0

    def push(tag: str, left_out: bool, region: int) -> None:
        stack.append((tag, left_out, region))
        opened[tag] += 1

    def pop() -> None:
        nonlocal linked
        opened[stack.pop()[0]] -= 1
        if len(stack) < linked:
            linked = -1

    for kind, tag, a in _Reader(page):
        if kind == "text":
            text.append(tag)
            if linked >= 0:
                links += len(" ".join(tag.split()))
            continue
        closing = kind == "close"
        if tag == "a":
            linked = -1 if closing else len(stack)
        if tag == "br":
            text.append(" ")
            continue
        if tag in SILENT_TAGS and tag != "head":
            if tag in ("title", "textarea"):
                flush()
            continue
        if tag not in BLOCK_TAGS:
            if closing:
                if opened[tag]:
                    flush()
                    while stack[-1][0] != tag:
                        pop()
                    pop()
            elif tag not in VOID_TAGS:
                _, o, r = stack[-1] if stack else ("", False, 0)
                if o:  # what is nested counts, or its end would end what is left out
                    push(tag, True, r)
                elif _is_out(tag, a, r > 0):
                    flush()
                    push(tag, True, r)
            continue
        flush()
        if closing:
            if opened[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID_TAGS:
            continue
        if stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            pop()
        elif tag in ("li", "dt", "dd", "option", "tr", "td", "th") and stack and stack[-1][0] == tag:
            pop()
        _, o, r = stack[-1] if stack else ("", False, 0)
        if tag in ("article", "main") and not r and not o:
            regions += 1
            push(tag, _is_out(tag, a, True), regions)
        else:
            push(tag, o or _is_out(tag, a, r > 0), r)
    flush()
    return out


def stop_density(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _first_pass(b: Block, known: bool) -> None:
    """known: whether the page is in a language of the stop words."""
    n = len(b.text)
    if b.out or b.links > LINKS_MOST * n or not b.region and b.text.startswith(("©", "(c) ")):
        b.good = False
    elif n < LENGTH_LOW:
        b.good = None
    elif b.region:
        b.good = True if n >= LENGTH_HIGH or b.stops >= STOPS_LOW or not known else None
    elif b.stops >= STOPS_HIGH or not known:
        b.good = True if n >= LENGTH_HIGH else None
        b.near = True
    elif b.stops >= STOPS_LOW:
        b.near = True
    else:
        b.good = False


def _nearest(marks: list[bool]) -> list[int]:
    """How far each place is from the nearest marked one; beyond all places if none is marked."""
    far = 2 * len(marks) + 2
    out, k = [], -far
    for i, m in enumerate(marks):
        k = i if m else k
        out.append(min(far, i - k))
    k = 2 * far
    for i in range(len(marks) - 1, -1, -1):
        k = i if marks[i] else k
        out[i] = min(out[i], k - i)
    return out


def main_text(page: str | None) -> str:
    """Blocks of the main text joined by line feeds; empty for null and for pages without any."""
    blocks = blocks_of(page or "")
    tellers = [b for b in blocks if not b.out and len(b.text) >= LENGTH_LOW and b.links <= LINKS_MOST * len(b.text)]
    for b in tellers:
        b.stops = stop_density(b.text)
    size = sum(len(b.text) for b in tellers)
    known = not size or sum(b.stops * len(b.text) for b in tellers) >= STOPS_NONE * size
    for b in blocks:
        _first_pass(b, known)
    inside = sum(len(b.text) for b in blocks if b.region and not b.out and b.good is not False)
    outside = sum(len(b.text) for b in blocks if not b.region and b.good)
    if inside and inside >= outside:
        blocks = [b for b in blocks if b.region]
    kept: list[Block] = []
    for region, own in groupby((b for b in blocks if not b.out), key=lambda b: b.region):
        own = list(own)
        decided = any(b.good is not None for b in own)
        good, bad = _nearest([b.good is True for b in own]), _nearest([b.good is False for b in own])
        for i, b in enumerate(own):
            if b.good or b.good is None and (good[i] <= bad[i] if decided else bool(region) or b.near):
                kept.append(b)
    return "\n".join(b.text for b in kept)


TEXT_FIELDS = T.StructType([T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars for every row.  Null and empty pages have an empty text; rows that repeat and null ids or
    urls stay as they are; an empty table gives no rows.  Other columns are ignored, whatever their names."""

    def make():
        take_memory("html")

        def step(rows: list) -> dict:
            texts = [main_text(h) for h in rows]
            return {"text": texts, "n_chars": list(map(len, texts))}

        return step

    return map_text(pages, [id_col, url_col], html_col, make, TEXT_FIELDS)
