"""Main text of web pages by two passes of block rules.

Markup is cut into blocks of text.  First pass, each block by itself, from length, link density,
stop-word density and marks.  Blocks of more links than text are bad.  Long blocks are good in any
language; shorter ones are good too if many of their words are stop words, or as a paragraph or
heading of an article; other short ones stay open.  Density is evidence for a block, never against
it: where no list fits the language it says nothing.  Marks (elements and class, id or role names
of menus, headers, footers, sidebars, notices, adverts, forms, reader comments) come in three strengths.
*Firm* ones (adverts, comments, cookie notices, elements such as nav) make a block bad.  *Named* ones
(an ordinary word alone, as in ``sidebar``) do, unless all long text of the page lies inside them.  *Weak* ones
(an ordinary word in a longer name, as in ``menu-review``) do only outside articles, and only if less
than half of the page's long text lies inside.

Second pass: an open block takes the label of its nearest decided neighbours in the same region (the
article, or the page outside it); in an article it falls only between two bad ones, and without any
decided neighbour it is kept.  Regions compete: articles silence the page around them if they hold at
least as much long text; otherwise the page stays, and articles without long text (teasers) go.

Defined cases: a null or empty page has empty text; unclosed and stray tags are tolerated;
a head ends at its first text or element of the body; a self-closed svg or math is empty; a page
cut off inside a tag, comment or script ends there; a marked inline advert ends with its block at the
latest; good neighbours win ties; repeated rows stay; further columns are ignored.
Nothing is capped: every page is read whole.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caremart.llm.common import slices

SHORT, LINKS = 70, 0.5
DENSE_SHORT, DENSE = 35, 0.3  # a block of this length is good if this share of its words are stop words

RAW = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "canvas", "title", "math")
HIDDEN = frozenset("nav footer aside form dialog menu select button option datalist fieldset label head".split())
# Elements of a page's head; any other one, or text, ends it without a closing tag.
IN_HEAD = frozenset("base link meta basefont bgsound noframes".split())
REGIONS = frozenset(("article", "main"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span "
                   "strike strong sub sup time tt u var wbr img br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that an opening block element ends without a closing tag.
LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot h1 h2 h3 h4 h5 h6".split())
# Names in class, id and role that mark what isn't the article.  Firm ones hardly ever name an
# article's parts; ordinary ones do so in longer names, unless the rest of the name says nothing.
ADVERTS = frozenset("ad ads advert advertisement advertising adbox adsense banner sponsor sponsored promo promotion".split())
FIRM = ADVERTS | frozenset("navbar breadcrumb breadcrumbs masthead topbar cookie cookies consent gdpr popup modal newsletter "
                           "comment comments replies respond disqus pagination pager complementary contentinfo".split())
ORDINARY = frozenset("nav navigation menu sidebar side aside footer header notice notices alert overlay subscribe subscription "
                     "signup login share sharing social related recommended recommendations reply toolbar search widget "
                     "copyright form dialog hidden".split())
PLAIN = frozenset("site page global top bottom left right main primary secondary mobile desktop list item items box bar block slot "
                  "area section container wrapper wrap inner outer row col column links link posts post buttons button icons text".split())
NOT_MARKS = frozenset("has with no without is show".split())
# Stop words of the corpus' languages (fixed values): English, French, German, Spanish.
STOP_WORDS = [frozenset(words.split()) for words in (
    "the of and to in a is that it was for on are as with his they be at one have this from or had by not but what all were "
    "when we there can an your which their said if do will each about how up out them then she he has him who been its no",
    "le la les de des du un une et est en que qui dans pour pas sur par au aux avec ce cette ces il elle ils se sa son ses plus "
    "ou mais nous vous leur ne sont ont je on comme tout fait",
    "der die das und ist in den von zu mit sich des auf für dem nicht ein eine als auch es an werden aus er hat dass sie nach wird "
    "bei einer um am sind noch wie einem über einen so zum war haben nur oder aber",
    "el la los las de del y en que un una por con no para su al lo como más pero sus le ya o este sí porque esta entre cuando muy "
    "sin sobre también me hasta hay se es son fue")]

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:svg|math)(?![a-z0-9:_-])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?<=/)>"  # empty, without a closing tag
    r"|<(?P<raw>" + "|".join(RAW) + r")(?![a-z0-9:_-])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:_-]*)(?P<attrs>[^>\"']*+(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*+)*+)>"
    r"|<[/!?][^>]*(?:>|\Z)|<[a-z][^<>]*(?:>|\Z|(?=<))", re.I | re.S)
_MARKED = re.compile(r"\b(class|id|role|aria-hidden|hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[-_]+")
# Signs that stand for a syllable or a word.
_SIGN = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3\uf900-\ufaff]")
SIGN = 3  # letters that such a sign counts as


NONE, WEAK, NAMED, SURE = range(4)


def mark(attrs: str) -> int:
    """How strongly an element's attributes mark it as no part of an article."""
    found = NONE
    for name, value in _MARKED.findall(attrs) if attrs else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" and not value or name == "aria-hidden" and value.lower() == "true":
            return SURE
        for token in value.split() if name in ("class", "id", "role") else ():
            parts = [p.lower() for p in _CAMEL.split(token) if p]
            if not parts or parts[0] in NOT_MARKS:
                continue
            if parts[0] in FIRM or parts[-1] in FIRM:
                return SURE
            if parts[0] in ORDINARY or parts[-1] in ORDINARY:
                found = max(found, NAMED if all(p in ORDINARY or p in PLAIN for p in parts) else WEAK)
    return found


def _is_advert(attrs: str) -> bool:
    return any(p.lower() in ADVERTS for name, value in _MARKED.findall(attrs) if name.lower() in ("class", "id")
               for token in value.strip("\"'").split() for p in _CAMEL.split(token)[:1])


@dataclass
class Block:
    text: str
    links: float  # share of characters in links
    name: str  # innermost block element
    bad: bool  # in a surely marked part
    region: int  # 0 is the page outside articles
    doubts: tuple[int, ...]  # numbers of the weakly marked or named elements around it


def blocks(page: str) -> tuple[list[Block], list[tuple[int, int]]]:
    """Blocks in page order, and (strength, region) of every doubtful element."""
    out: list[Block] = []
    doubtful: list[tuple[int, int]] = []
    outside = ("", False, 0, ())
    stack: list[tuple[str, bool, int, tuple[int, ...]]] = []  # open block elements: name, bad, region, doubts
    text: list[str] = []
    linked: list[str] = []
    advert: list[str] = []  # open inline elements from a marked advert on
    link = 0
    regions = at = 0
    _, bad, region, doubts = outside

    def flush() -> None:
        advert.clear()
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                n = len(" ".join(html.unescape("".join(linked)).split()))
                out.append(Block(whole, min(1.0, n / len(whole)), stack[-1][0] if stack else "", bad, region, doubts))
            text.clear()
            linked.clear()

    def leave_head() -> None:
        nonlocal bad, region, doubts
        if stack and stack[-1][0] == "head":
            flush()
            stack.pop()
            _, bad, region, doubts = stack[-1] if stack else outside

    def add(piece: str) -> None:
        if piece and not advert:
            if bad and not piece.isspace():
                leave_head()
            text.append(piece)
            if link:
                linked.append(piece)

    for m in _TOKEN.finditer(page):
        add(page[at:m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if bad and not m["close"] and name not in IN_HEAD:
            leave_head()
        if name == "a":
            link = 0 if m["close"] else 1
        if name in INLINE:
            if name == "br":
                add(" ")
            elif name not in VOID:
                if m["close"]:
                    if name in advert:
                        while advert.pop() != name:
                            pass
                elif advert or _is_advert(m["attrs"]):
                    advert.append(name)
        elif m["close"]:
            flush()
            link = 0
            if any(s[0] == name for s in stack):
                while stack.pop()[0] != name:
                    pass
                _, bad, region, doubts = stack[-1] if stack else outside
        else:
            flush()
            if name in LOOSE:
                while stack and stack[-1][0] in LOOSE and (stack[-1][0] == name or stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6")):
                    stack.pop()
                _, bad, region, doubts = stack[-1] if stack else outside
            if name in VOID or m["attrs"].endswith("/"):
                continue
            strength = NONE if name in ("html", "body", "main") else mark(m["attrs"])
            hides = name in HIDDEN or name == "header" and not region or strength == SURE
            if name in REGIONS and not (bad or hides) and not region:
                regions += 1
                region = regions
            bad = bad or hides
            if strength in (WEAK, NAMED):
                doubts = (*doubts, len(doubtful))
                doubtful.append((strength, region))
            stack.append((name, bad, region, doubts))
    add(page[at:])
    flush()
    return out, doubtful


def _size(text: str) -> int:
    """Length of a text in letters, alike in every script."""
    return len(text) if text.isascii() else len(text) + (SIGN - 1) * len(_SIGN.findall(text))


def density(text: str) -> float:
    """Share of a text's words that are stop words of the language that fits best."""
    words = [w.strip(".,;:!?\"'()").lower() for w in text.split()]
    return max(sum(w in stop for w in words) for stop in STOP_WORDS) / len(words)


def _weights(found: list[Block]) -> list[float]:
    """What each block says for being an article's text: its length if it is long and not all links, more
    with stop words in it.  On a page without long text short blocks speak."""
    sizes = [0 if b.bad or b.links > LINKS else _size(b.text) for b in found]
    least = SHORT if max(sizes, default=0) >= SHORT else 1
    return [n * (1 + density(b.text)) if n >= least else 0.0 for b, n in zip(found, sizes, strict=True)]


def _settle_marks(found: list[Block], doubtful: list[tuple[int, int]], weight: list[float]) -> None:
    """Make the blocks bad whose doubtful marks hold."""
    inside: dict[int, float] = defaultdict(float)
    for b, w in zip(found, weight, strict=True):
        for d in b.doubts if w and not b.bad else ():
            inside[d] += w
    total = sum(w for b, w in zip(found, weight, strict=True) if not b.bad)
    for b in found:
        for d in b.doubts:
            strength, region = doubtful[d]
            if strength == NAMED and not (total and inside[d] >= total - 1e-6):
                b.bad = True
            if strength == WEAK and not (region or b.region) and not (total and 2 * inside[d] >= total):
                b.bad = True


def _label(b: Block) -> bool | None:
    """First pass: what a block is by itself."""
    if b.bad or b.links > LINKS:
        return False
    size = _size(b.text)
    if size >= SHORT or size >= DENSE_SHORT and density(b.text) >= DENSE:
        return True
    if b.region and not b.links and b.name in ("p", "blockquote", "h1", "h2", "h3", "h4"):
        return True
    return None


def extract(page: str | None) -> str:
    """The page's main text: its good blocks, one a line."""
    found, doubtful = blocks(page or "")
    weight = _weights(found)
    if doubtful:
        _settle_marks(found, doubtful, weight)
    label = [_label(b) for b in found]
    held: dict[int, float] = defaultdict(float)
    for b, w in zip(found, weight, strict=True):
        held[b.region] += 0 if b.bad else w
    in_regions = sum(w for r, w in held.items() if r)
    page_stays = held[0] > in_regions or not any(b.region for b in found)
    out = []
    for region in dict.fromkeys(b.region for b in found):
        if page_stays and region and not held[region] or not page_stays and not region:
            continue
        own = [i for i, b in enumerate(found) if b.region == region and not b.bad]
        decided = [i for i in own if label[i] is not None]
        k = 0
        for i in own:
            if label[i] is not None:
                k += 1
                keep = label[i]
            else:
                near = [decided[x] for x in (k - 1, k) if 0 <= x < len(decided)]
                good = [j for j in near if label[j]]
                if region:
                    keep = bool(good) or len(near) < 2
                elif len(near) == 2 and len(good) == 1:  # the nearer one; good wins a tie
                    keep = abs(i - good[0]) * 2 <= near[1] - near[0]
                else:
                    keep = len(good) == len(near)
            if keep:
                out.append(i)
    return "\n".join(found[i].text for i in sorted(out))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [extract(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), b.column(1).cast(pa.string()), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
            .mapInArrow(run, "page_id long, url string, text string, n_chars long"))
