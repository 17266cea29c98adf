"""Main text of raw web pages by two-pass block rules.

A page is read as a stream of tags and character data, and cut into blocks at block-level tags.
Elements that are never article text by their kind (scripts, styles, forms, navigation, footers,
sidebars, and page headers outside an article) are left out with all they hold. Every other block
is judged.

Pass 1 adds up points for each block by itself: its length in words, its share of text in links, and
its density of stop words, which counts only where they can tell: for text in Latin letters on a page
that has some of them, because they are those of four languages. Scripts without spaces count
two letters as a word. The page's own marks are evidence beside these: blocks of an ``article`` or
``main`` element gain; where such elements hold at least half of the text that is good by content,
blocks outside lose (else they are teaser cards, say); blocks under an element whose class, id or role names nothing but
adverts, menus, notices, comments and the like lose most, those under names that merely have such a
word in them (``related-work``, ``login-flow``) a little. An article or main element clears the names around it, and a
name around the page's only top heading and all of its good text is a layout's. By its points a block is good, bad, or
ambiguous; blocks of few words are ambiguous unless bad.

Pass 2 gives ambiguous blocks the label of their nearest decided neighbours (inside articles, of those
inside, and never of blocks that are named as something else): alike on both sides,
that; else good if the nearer one is (ties: good), and headings look only forward. Where nothing is
decided on either side, they are good.

Character references are decoded, runs of white space inside a block become one space,
blocks are trimmed and joined by an empty line.

Defined results: null, empty and text-free pages give the empty text. Unclosed tags,
comments and character references end with the page; quotes open a value only after ``=``, and one that
never closes is a character like any other. Columns other than page_id, url and
html are ignored; repeated rows give repeated rows; empty tables give empty tables.
"""

from __future__ import annotations

import html as charrefs
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
DROPPED = frozenset("head nav footer aside form button select option menu dialog canvas svg object audio video applet fieldset".split()) | RAW
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
# what a start tag closes, if it is open in the same list or table
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
LISTS = frozenset("ul ol dl table article main section div".split())

# Words of class, id and role attributes that mark what is not the article, and words that say nothing beside them.
MARKS = frozenset("ad ads adsbygoogle advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager sidebar sidebars aside rail widget widgets footer header masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations comment comments respond reply replies disqus complementary contentinfo disclaimer copyright legal skip".split())
NEUTRAL = frozenset("article articles content main body post posts entry story text page site web top bottom left right center upper lower inner outer wrap wrapper container box block bar area section list item items row col column panel slot unit links link form button buttons icons group global primary secondary user users reader readers visitor visitors the and is has js no".split())
OWN_HEADER = frozenset("article content main body post entry story text".split())

# Frequent function words of the languages that the rules know.
STOP_WORDS = frozenset("""
a about after all also an and any are as at be because been but by can for from had has have he her his how i if in into is it its
more my no not of on one or other our out she so some than that the their them then there they this to up was we were what when which who will with would you
au aux avec ce cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous ont ou par pas plus pour qu que qui sa se ses son sont sur un une vous
aber als am auch auf aus bei das dass dem den der die ein eine einem einen einer es für hat ich im ist mit nach nicht noch nur oder sich sie sind so um und von war wenn wie wird zu zum zur
al como con del el era los lo las muy para pero por se sin su sus también y ya no es
""".split())

# Words of a block from which on it is no longer short, and long, and very long.
SHORT_WORDS, LONG_WORDS, VERY_LONG = 10, 30, 60
STOP_LOW, STOP_HIGH, STOP_KNOWN = 0.12, 0.22, 0.08
LINK_SOME, LINK_MOST = 0.33, 0.6
# Points of a block that is good, and of one that is bad; those between are ambiguous.
GOOD_FROM, BAD_TO = 2, -2
INSIDE, OUTSIDE, NAMED, HINTED = 3, -6, -10, -1

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_UNSPACED = re.compile(r"[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿]")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")


class Block(NamedTuple):
    text: str
    linked: int  # characters in links
    heading: int  # its level, or 0
    inside: bool  # of an article or main element
    outer: int  # the outermost element around it that is named as something else, since the last article or main element, or 0
    names: int  # how many such elements are around it
    hints: int  # of those whose names only hold such a word
    wrapped: bool  # of an article or main element that stands in an element so named


def _names(attrs: str) -> int:
    """What an element's attributes say: NAMED as something other than the article, HINTED at it, or 0."""
    said = 0
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return NAMED
        if name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return NAMED
        if name in ("class", "id", "role"):
            for word in value.split():
                parts = {p.lower() for p in _PART.findall(word)}
                marks = parts & MARKS
                if not marks or marks == {"header"} and parts & OWN_HEADER:
                    continue
                if parts <= MARKS | NEUTRAL:
                    return NAMED
                said = HINTED
    return said


class _Open(NamedTuple):
    tag: str
    dropped: bool
    said: int
    article: bool
    before: tuple[int, int, int, int, bool]  # outer, names, hints, articles and wrapped outside it


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order."""
    out: list[Block] = []
    text: list[str] = []
    linked = heading = dropping = count = articles = outer = names = hints = 0
    wrapped = False
    stack: list[_Open] = []
    depth: Counter[str] = Counter()

    def close() -> None:
        nonlocal linked
        if text:
            joined = _SPACE.sub(" ", charrefs.unescape("".join(text))).strip()
            text.clear()
            if joined:
                out.append(Block(joined, linked, heading, articles > 0, outer, names, hints, wrapped))
        linked = 0

    def pop(tag: str) -> None:
        """Ends the innermost open element of that name, and what is open in it."""
        nonlocal outer, names, hints, articles, wrapped, dropping
        while True:
            last = stack.pop()
            depth[last.tag] -= 1
            if last.said or last.article or last.dropped:
                close()  # what the element held is a block of its own
                outer, names, hints, articles, wrapped = last.before
                dropping -= last.dropped
            if last.tag == tag:
                return

    at, end = 0, len(page)
    raw: str | None = None
    while at < end:
        if raw:  # nothing but its end tag ends a raw element
            m = re.compile(rf"</{raw}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE).search(page, at)
            at, raw = (m.end() if m else end), None
            continue
        m = _TOKEN.search(page, at)
        data = page[at : m.start()] if m else page[at:]
        if data and not dropping:
            text.append(data)
            if depth["a"]:
                linked += len(data.strip())
        if not m:
            break
        at = m.end()
        if not m["tag"]:
            continue
        tag, closing, attrs = m["tag"].lower(), bool(m["end"]), m["attrs"]
        if not dropping:
            if tag in BLOCK or tag == "br" and re.match(r"\s*<br\b", page[at : at + 40], re.IGNORECASE):
                close()
            elif tag == "br":
                text.append(" ")
        if closing:
            if depth[tag]:
                pop(tag)
            if tag in HEADINGS:
                heading = 0
            continue
        if tag in RAW:
            raw = tag
            continue
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK or tag in ("body", "html"):
            continue
        above = "p" if tag in BLOCK else "a" if tag == "a" else ""  # what it closes if only inline elements are open in that
        if depth[above]:
            k = len(stack) - 1
            while stack[k].tag != above and stack[k].tag in INLINE:
                k -= 1
            if stack[k].tag == above:
                pop(above)
        for other in CLOSED_BY.get(tag, ()):
            if depth[other]:
                k = len(stack) - 1
                while k >= 0 and stack[k].tag not in LISTS and stack[k].tag != other:
                    k -= 1
                if k >= 0 and stack[k].tag == other:
                    pop(other)
        dropped = tag in DROPPED or tag == "header" and not articles
        article = tag in ("article", "main")
        said = _names(attrs) if attrs and not dropping else 0
        depth[tag] += 1
        stack.append(_Open(tag, dropped, said, article, (outer, names, hints, articles, wrapped)))
        if dropped or said or article:
            close()
            dropping += dropped
            if article and said != NAMED:
                outer, names, hints, articles, wrapped = 0, 0, 0, articles + 1, wrapped or names > 0
            elif said == NAMED:
                count += 1
                outer, names = outer or count, names + 1
            hints += said == HINTED
        if tag in HEADINGS:
            heading = int(tag[1])
    close()
    return out


GOOD, BAD, UNSURE = 1, 0, -1


class Content(NamedTuple):
    """What a block's text says."""

    words: int
    density: float  # of stop words
    latin: bool


def content(text: str) -> Content:
    words = _WORD.findall(text.lower())
    unspaced = len(_UNSPACED.findall(text))
    n = max(len(words), unspaced // 2)
    latin = 2 * len(_LATIN.findall(text)) > sum(map(len, words))
    return Content(n, sum(w in STOP_WORDS for w in words) / n if n else 0.0, latin)


def points(block: Block, what: Content, known: bool, evidence: int = 0) -> int:
    """Pass 1's points by length, links and stop words, and from what the page's marks say."""
    n = what.words
    score = evidence + (n >= SHORT_WORDS) + (n >= LONG_WORDS) + (n >= VERY_LONG)
    share = block.linked / len(block.text)
    score -= 4 if share > LINK_MOST else 3 if share > LINK_SOME else 0
    if known and what.latin and n >= SHORT_WORDS:
        score += 1 if what.density >= STOP_HIGH else 0 if what.density >= STOP_LOW else -3
    return score


def label(score: int, words: int) -> int:
    """Good, bad or ambiguous; few words are never good by themselves."""
    return BAD if score <= BAD_TO else GOOD if score >= GOOD_FROM and words >= SHORT_WORDS else UNSURE


def judged(found: list[Block]) -> tuple[list[int], list[bool]]:
    """Pass 1: the label of each block by itself, and whether it is named as something else."""
    said = [content(b.text) for b in found]
    long = [w for w in said if w.latin and w.words >= SHORT_WORDS]
    known = sum(w.density * w.words for w in long) >= STOP_KNOWN * sum(w.words for w in long)
    by_content = [label(points(b, w, known), w.words) for b, w in zip(found, said)]
    good = [b for b, g in zip(found, by_content) if g == GOOD]
    tops = [b for b in found if b.heading == 1]
    layout = 0  # a name around the only top heading and all good text
    if len(tops) == 1 and good and all(b.outer == tops[0].outer for b in good):
        layout = tops[0].outer
    named = [b.names > (b.outer == layout) for b in found]
    free = [(b, len(b.text)) for b, g, n in zip(found, by_content, named) if g == GOOD and not n]
    # an article or main element that holds most of what is good is the article
    inside = sum(n for b, n in free if b.inside)
    dominant = any(b.inside and not n for b, n in zip(found, named)) and 2 * inside >= sum(n for b, n in free if b.inside or not b.wrapped)
    out = []
    for b, w, n in zip(found, said, named):
        evidence = NAMED * n + max(HINTED * b.hints, 2 * HINTED)
        if dominant:
            evidence += INSIDE if b.inside else OUTSIDE
        elif b.wrapped:
            evidence += NAMED  # a card among what is named as something else
        out.append(label(points(b, w, known, evidence), w.words))
    return out, named


def settled(found: list[Block], first: list[int], named: list[bool]) -> list[int]:
    """Pass 2: ambiguous blocks by their nearest decided neighbours, in or out of an article as they are, that are not named as something else."""
    n = len(found)
    before, after = [-1] * n, [n] * n
    for order, nearest in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[bool, int] = {}
        for k in order:
            nearest[k] = last.get(found[k].inside, nearest[k])
            if first[k] != UNSURE and not named[k]:
                last[found[k].inside] = k
    out = list(first)
    for k, b in enumerate(found):
        if first[k] == UNSURE:
            i, j = before[k], after[k]
            left = first[i] if i >= 0 else UNSURE
            right = first[j] if j < n else UNSURE
            if b.heading and right != UNSURE:
                out[k] = right
            elif left == UNSURE and right == UNSURE:
                out[k] = GOOD
            elif UNSURE in (left, right):
                out[k] = max(left, right)
            elif left == right:
                out[k] = left
            else:
                out[k] = left if k - i < j - k else right if j - k < k - i else GOOD
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for b, good in zip(found, settled(found, *judged(found))) if good == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(read, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars bigint")
