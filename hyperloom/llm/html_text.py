"""Main text of web pages by two-pass block rules.

Markup is read tag by tag into blocks of text. First pass: a block inside an element that is no article text by its tag or
by a name in its class, id or role is bad, as is one that is mostly links; of the others, stop-word density and length tell
good blocks, and what is short or unclear is left open. Second pass: an open block takes the label of the nearest decided
block of its section (the article, or the page outside of it); in a tie the good one decides. Where a page marks an
article that holds a good block, blocks outside of it are bad, but for a first heading right before it.

Names and forms only make an element suspect. They aren't held against what has most of the page's good text (a form around
the page, a layout named after a sidebar that it has), unless the page has a marked article outside of suspect elements; for
names of comments and the like there must be no good text elsewhere. Names of states (has-, no-, -open, -fixed ...) say nothing.

Character references are decoded, white space inside a block becomes one blank, blocks are joined in page order by one
blank. What a browser shows only in place of something else (in noscript, iframe, template, object, audio, video, canvas)
is no text; captions, formulas and drawings are. An anchor is a link if it has an address, up to its end or, without one, up
to the end of its block. Defined results: null and empty pages have the empty text; unclosed elements end with the element around them,
comments, scripts and styles that don't end reach to the end of the page; pages may be of any length; repeated rows are
read alike; extra columns stay, clashing ones are replaced; an empty table gives no rows. A quote opens a value only after an
equals sign, and one that isn't closed is a character like others; a tag without an end is text. Every character is read
a bounded number of times.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hyperloom.llm.common import without

# Frequent words of the languages of the pages.
STOP_WORDS = frozenset(
    """the of and to in a is that it was for on with as his he be at by i this had not are but from or have an they which one you were her all she there would their
    le la les de des du un une et est que qui dans en pour pas sur au avec son il elle ce ne se plus par je mais nous vous ou
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei
    el los las del y que en un una por con para su no es al lo como más pero sus le ya o este si porque cuando muy sin sobre ser""".split()
)
# Elements that hold no article text, elements that don't break a line of text, elements without an end.
BAD = frozenset("nav footer aside button select option label fieldset head menu dialog object applet audio video canvas textarea".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words in a class, id or role that mark what isn't the article.
HINTS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice
    notices alert newsletter subscribe subscription signup popup modal overlay share sharing social related recommended comment comments respond disqus replies reply login search widget pagination pager
    contentinfo complementary masthead header toolbar skip copyright disclaimer paywall""".split()
)
# Of these, those that are never the name of an article, whatever it holds besides other good text.
STRONG = frozenset("comment comments respond disqus replies reply related recommended sidebar cookie cookies consent gdpr newsletter breadcrumb breadcrumbs pagination pager".split())
# Of these, words that may belong to an article's own head, and words that say so.
HEADS, OF_ARTICLE = frozenset("header masthead banner".split()), frozenset("article entry post story content".split())
# At the end of a name, words that say what it is above all.
LAST = frozenset("article entry post story".split())
# How names of states begin and end, and names that tell an article that isn't the page's.
STATE = re.compile(r"(?:.*[-_])?(?:has|no|is|with|without|not|js|can)[-_]|.*[-_](?:open|opened|closed|enabled|disabled|fixed|sticky|active|inactive|visible|hidden|on|off|true|false|left|right|count|ready|allowed)$")
OTHER_ARTICLE = frozenset("comment comments reply replies related recommended teaser promo".split())

NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?)*+")
RAW = {name: re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.I) for name in ("script", "style", "noscript", "template", "title", "iframe")}
ADDRESS = re.compile(r"\bhref\b", re.I)
MARKED = re.compile(r"(?<![\w-])(?:class|id|role)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++)", re.I)
#: Words from which a block is long, and from which stop words decide; density of stop words; share of text in links.
LONG, ENOUGH, DENSE, LINKED = 25, 10, 0.12, 0.5


@dataclass
class Block:
    article: bool
    bad: bool
    suspect: int  # the innermost suspect element, -1 without one
    first_heading: bool = False
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    @property
    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


@dataclass
class Suspect:
    """An element whose name speaks against it, inside another one or none (-1)."""

    around: int
    strong: bool


def names(rest: str) -> Iterator[list[str]]:
    """The words of each name in class, id and role that isn't of a state."""
    for m in MARKED.finditer(rest):
        for token in m[1].strip("\"'").lower().split():
            if not STATE.match(token):
                yield [w for w in re.split(r"[^a-z]+", token) if w]


def hinted(rest: str, article: bool) -> tuple[bool, bool]:
    """Whether names speak against an element, and whether they do so strongly."""
    tokens, found, strong = list(names(rest)), False, False
    own = article or any(OF_ARTICLE & {*words} for words in tokens)
    for words in tokens:
        against = HINTS & {*words} - (HEADS if own else set())
        found |= bool(against)
        strong |= bool(against & STRONG) and words[-1] not in LAST
    return found, strong


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, stop, "" or "/", name, the rest of the tag) of every tag; comments, declarations and what isn't text between two
    tags come without a name."""
    at, last = 0, page.rfind(">")
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            stop = stop + 3 if stop >= 0 else len(page)
            yield start, stop, "", "", ""
        elif page.startswith(("<!", "<?"), start):
            stop = page.find(">", start)
            stop = stop + 1 if stop >= 0 else len(page)
            yield start, stop, "", "", ""
        elif (m := NAME.match(page, start + 1)) and start < last:
            rest = REST.match(page, m.end())
            stop = rest.end() if rest.end() < len(page) else page.find(">", start)
            name = m[2].lower()
            end = RAW[name].search(page, stop + 1) if name in RAW and not m[1] else None
            if name in RAW and not m[1]:
                stop = end.end() if end else len(page)
                yield start, stop, "", "", ""
            else:
                stop += 1
                yield start, stop, m[1], name, page[m.end() : stop - 1]
        elif m and m[2].lower() in RAW and not m[1]:
            yield start, len(page), "", "", ""
            return
        else:
            stop = start + 1
        at = stop


def blocks(page: str) -> tuple[list[Block], list[Suspect]]:
    """The blocks of text of a page in order, with what the elements around them say, and its suspect elements."""
    stack: list[tuple[str, bool, bool, int]] = []  # name, in an article, bad, innermost suspect
    open_names: Counter[str] = Counter()  # of the stack
    out, link, to_block_end, suspects, heading = [Block(False, False, -1)], False, False, [], False
    ends = anchor_ends(page)

    def around() -> tuple[bool, bool, int]:
        return stack[-1][1:] if stack else (False, False, -1)

    def anew() -> None:
        nonlocal link
        link = link and not to_block_end
        out.append(Block(*around(), heading))

    def put(text: str) -> None:
        if text:
            out[-1].parts.append(text)
            if link:
                out[-1].linked += len(text.strip())

    at = 0
    for start, stop, end, name, rest in tags(page):
        put(page[at:start])
        at = stop
        if not name:
            continue
        if name in ("br", "hr"):
            put(" ")
        if name == "a":
            link = not end and ADDRESS.search(rest) is not None
            to_block_end = link and not ends.get(start, False)
        if name == "h1":
            heading = not end
        if end:
            if open_names[name]:
                while closed := stack.pop()[0]:
                    open_names[closed] -= 1
                    if closed == name:
                        break
                anew()
            elif name not in INLINE:
                anew()
        elif name not in VOID:
            article, bad, suspect = around()
            found, strong = name == "form", False
            if rest and name in ("article", "main"):
                found = strong = any(OTHER_ARTICLE & {*words} for words in names(rest))
            elif rest and name not in ("html", "body"):
                against, strong = hinted(rest, article)
                found |= against
            if name in INLINE and not found:
                continue
            if stack and stack[-1][0] == "p" and name not in INLINE or stack and stack[-1][0] == name == "li":
                open_names[stack.pop()[0]] -= 1
                article, bad, suspect = around()
            if found and not bad:
                suspects.append(Suspect(suspect, strong))
                suspect = len(suspects) - 1
            open_names[name] += 1
            stack.append((name, article or name in ("article", "main") and not bad, bad or name in BAD or name == "header" and not article, suspect))
            anew()
    put(page[at:])
    return [b for b in out if b.parts], suspects


def anchor_ends(page: str) -> dict[int, bool]:
    """For the start of each opening anchor, whether the next anchor tag closes it."""
    found, before = {}, None
    for m in re.finditer(r"<(/?)a\b", page, re.I):
        if before is not None:
            found[before] = bool(m[1])
        before = None if m[1] else m.start()
    return found


def cleared(found: list[tuple[Block, str]], labels: list[bool | None], suspects: list[Suspect]) -> list[bool]:
    """Whether each suspect element, and all around it, are not held against what they hold.

    Only elements around the suspect one with the most good text of its own come into question (a strong one only if no other
    place of the page has good text), and only if they hold more than what lies in no suspect element. A marked article outside
    of all of them rules it out.
    """
    own, clean = [0] * len(suspects), 0
    for (b, t), label in zip(found, labels, strict=True):
        if label and b.suspect >= 0:
            own[b.suspect] += len(t)
        elif label:
            clean += len(t)
            if b.article:
                return [False] * len(suspects)
    strong: list[bool] = []
    for s in suspects:  # outer ones come first
        strong.append(s.strong or s.around >= 0 and strong[s.around])
    asked = [i for i, n in enumerate(own) if n and not strong[i]] or [i for i, n in enumerate(own) if n and not clean]
    out = [False] * len(suspects)
    if not asked:
        return out
    sums = [n if strong[i] == strong[asked[0]] else 0 for i, n in enumerate(own)]
    for i in range(len(suspects) - 1, -1, -1):
        if suspects[i].around >= 0:
            sums[suspects[i].around] += sums[i]
    at, chain = max(asked, key=lambda i: (own[i], -i)), []
    while at >= 0:
        chain.append(at)
        at = suspects[at].around
    for i in reversed(chain):
        out[i] = sums[i] > clean and (suspects[i].around < 0 or out[suspects[i].around])
    return out


def first_pass(block: Block, text: str) -> bool | None:
    """True for a good block, False for a bad one, None where it stays open."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    if block.bad or block.linked > LINKED * len(text):
        return False
    if re.search(r"©|\ball rights reserved\b", text, re.I) and len(words) < 2 * LONG and not block.article:
        return False
    density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if len(words) >= ENOUGH and density >= DENSE or len(words) >= LONG and (block.article or density >= DENSE / 3):
        return True
    return None


def main_text(page: str | None) -> str:
    own, suspects = blocks(page or "")
    found = [(b, t) for b in own if (t := b.text)]
    labels = [first_pass(b, t) for b, t in found]
    clear = cleared(found, labels, suspects)
    for i, (b, _) in enumerate(found):
        if b.suspect >= 0 and not clear[b.suspect]:
            labels[i], b.bad = False, True
    decided = {a: [i for i, (b, _) in enumerate(found) if b.article == a and labels[i] is not None and not b.bad] for a in (True, False)}
    final = list(labels)
    for i, (b, _) in enumerate(found):
        if labels[i] is None:
            around = decided[b.article]
            k = bisect_left(around, i)
            near = min(around[max(0, k - 1) : k + 1], key=lambda j: (abs(j - i), not labels[j]), default=None)
            final[i] = True if near is None else labels[near]
    inside = [i for i, (b, _) in enumerate(found) if final[i] and b.article]
    if inside:
        heads = [i for i in range(inside[0]) if found[i][0].first_heading and not found[i][0].bad and final[i]]
        keep = set(inside)
        if heads and not any(found[i][0].first_heading for i in inside):
            keep.add(heads[-1])
        final = [i in keep for i in range(len(found))]
    return " ".join(t for x, (_, t) in zip(final, found, strict=True) if x)


def extract(df: DataFrame, *, page: str = "html") -> DataFrame:
    """The rows without the page, with text and n_chars (its code points)."""
    df = without(df, "text", "n_chars")
    kept = [f for f in df.schema.fields if f.name != page]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(page)]
            out = batch.drop_columns([page]).append_column("text", pa.array(texts, pa.string()))
            yield out.append_column("n_chars", pa.array([len(x) for x in texts], pa.int64()))

    return df.mapInArrow(run, T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
