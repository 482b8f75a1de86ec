"""Main text of web pages by two passes of block rules.

The page is cut into blocks at block-level tags. The first pass labels every
block, wherever it stands, by length, share of stop words and share of
characters within links: good, bad, or undecided where these don't say (short
ones, and longer ones without the marks of prose). A short block with a
copyright sign is bad. The second pass gives the undecided ones the label of
their nearest decided neighbours of the same region (an article, or what is
outside all of them); one that stands before the first heading takes the
nearest's, so that a notice between menu and heading goes with the menu.

Places are a further sign. What stands in elements that are never part of an
article (menu, footer, form ...) goes, prose too. Words of class, id and role
(advert, sidebar, comments ...) count likewise, unless they mark all of the
page's text: then they name the whole of it, and contents decide.

What nothing speaks against stays: a page without tags, with two short
sentences or in a language of other stop words keeps its text. All steps take
time in proportion to the page, unclosed tags and deep nesting included.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters below which a block is short, and from which stop words alone make it good.
SHORT, LONG = 70, 140
#: Share of link characters from which a block is bad, and shares of stop words.
LINKS, STOP_LOW, STOP_HIGH = 0.5, 0.1, 0.25

STOP_WORDS = frozenset(
    (
        # en
        "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you "
        # fr
        "au aux avec ce cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour qu que qui sa se ses son sont sur un une vous "
        # de
        "als am auch auf aus bei das dass dem den der die du ein eine einem einen einer er es für hat ich im ist mit nach nicht noch sich sie sind so über und von vor war wie wird zu zum zur "
        # es
        "al como con del el ella en entre era es esta este fue ha hay las lo los más me mi muy no para pero por porque se si sin sobre su sus también un una y ya"
    ).split()
)

#: Elements whose content is never text of the page: up to their end tag, or to the page's end without one.
RAW = frozenset("script style textarea title".split())
#: The same, but an element that is never closed hides nothing.
EMBEDDED = frozenset("noscript template svg iframe object math canvas".split())
#: Elements that are never part of an article.
OUTSIDE = frozenset("nav footer aside form button select dialog menu head".split())
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that hold others; the rest end where the next one begins.
HOLDERS = frozenset("address article aside blockquote body button center details dialog dir div dl fieldset figure footer form head header html main menu nav ol section select table ul".split())
#: Words of class, id and role that mark what surrounds an article.
MARKS = frozenset(
    "ad ads adsense adslot adbox sponsor sponsored promo promotion promoted sidebar respond reply replies disqus cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay menu navbar nav navigation breadcrumb breadcrumbs footer masthead share sharing social related recommended recommendations widget toolbar pagination pager login search copyright contentinfo complementary banner dialog hidden teaser teasers outbrain taboola paywall disclaimer".split()
)
MARK_STEMS = ("advert", "comment", "discussion")
HEADER_MARKS = frozenset("header topbar head".split())

_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_IN_TAG = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE_END = (".", "!", "?", "…", ":", ".\"", "!\"", "?\"", "”", "»", "“", ".)")


@dataclass(slots=True)
class Block:
    text: str
    link_chars: int
    within: bool  # an article
    marked: bool  # by an element that is never part of one
    named: bool  # the same by words of class, id or role
    heading: bool
    first: str = ""  # label of the first pass: good, bad, foot (bad, but no neighbour to inherit from), or undecided: prose, odd
    label: str = ""


class _Tags:
    """The tags of a page in order: (start, after, name, closing, attributes)."""

    def __init__(self, page: str):
        self.page = page
        self.absent: set[str] = set()  # end marks that don't stand in the rest of the page
        self.quotes = True  # whether a > within quotes is part of a tag

    def _find(self, mark: str, at: int) -> int:
        found = -1 if mark in self.absent else self.page.find(mark, at)
        if found < 0:
            self.absent.add(mark)
        return found

    def _close(self, at: int) -> int:
        """Where the tag that is open at this place ends, or -1."""
        start = at
        while self.quotes:
            m = _IN_TAG.search(self.page, at)
            if m and m[0] == ">":
                return m.start()
            at = self._find(m[0], m.end()) + 1 if m else 0
            if not at:  # a quote without an end: from here on quotes mean nothing, so that no part is read twice
                self.quotes = False
        return self._find(">", start)

    def _end_of(self, name: str, at: int) -> int:
        """After the end tag of a raw element; -1 without one."""
        if name in self.absent:
            return -1
        m = re.compile(rf"</{name}\s*+>", re.I).search(self.page, at)
        if not m:
            self.absent.add(name)
            return -1
        return m.end()

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        at = self.page.find("<")
        while at >= 0:
            after = at + 1
            if self.page.startswith("<!--", at):
                end = self._find("-->", at + 4)
                after = len(self.page) if end < 0 else end + 3
                yield at, after, "", False, ""
            elif m := _NAME.match(self.page, at + 1):
                end = self._close(m.end())
                if end < 0:
                    return  # no tag is closed from here on: the rest is text
                name, attributes, after = m[1].lower(), self.page[m.end() : end], end + 1
                closing = self.page[at + 1] == "/"
                if not closing and name in RAW | EMBEDDED and not attributes.endswith("/"):
                    end = self._end_of(name, after)
                    after = end if end >= 0 else len(self.page) if name in RAW else after
                yield at, after, name, closing, attributes
            elif self.page[at + 1 : at + 2] in ("!", "?") and (end := self._find(">", at)) >= 0:
                after = end + 1
                yield at, after, "", False, ""
            at = self.page.find("<", after)


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in reversed(_ATTRIBUTE.findall(raw))} if raw else {}


def _marked(name: str, attributes: dict[str, str], within: bool) -> bool:
    if name in OUTSIDE or (name == "header" and not within) or "hidden" in attributes:
        return True
    return attributes.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I))


def _named(attributes: dict[str, str], within: bool) -> bool:
    for key in ("class", "id", "role"):
        for part in map(str.lower, _PART.findall(attributes.get(key, ""))):
            if part in MARKS or part.startswith(MARK_STEMS) or (part in HEADER_MARKS and not within):
                return True
    return False


@functools.lru_cache(maxsize=4096)
def _short_place(name: str, raw: str, within: bool) -> tuple[bool, bool, bool]:
    attributes = _attributes(raw)
    return name in ("article", "main") or attributes.get("role", "").lower() == "main", _marked(name, attributes, within), _named(attributes, within)


def _place(name: str, raw: str, within: bool) -> tuple[bool, bool, bool]:
    """Whether an element begins an article, and whether it is marked or named as none of one. The same few tags come again and again."""
    return _short_place(name, raw, within) if len(raw) < 256 else _short_place.__wrapped__(name, raw, within)


def blocks(page: str) -> list[Block]:
    """The blocks of a page that have text, in page order."""
    found: list[Block] = []
    parts: list[str] = []
    link_chars, links, heading, own_mark, own_name = 0, 0, False, False, False
    stack: list[tuple[str, bool, bool, bool]] = []  # name, within an article, marked, named
    is_open: Counter[str] = Counter()

    def close() -> None:
        nonlocal link_chars
        if text := " ".join("".join(parts).split()):
            _, within, marked, named = stack[-1] if stack else ("", False, False, False)
            found.append(Block(text, link_chars, within, marked or own_mark, named or own_name, heading))
        parts.clear()
        link_chars = 0

    def add(raw: str) -> None:
        nonlocal link_chars
        if raw:
            parts.append(text := html.unescape(raw))
            if links:
                link_chars += len(text)

    at = 0
    for start, after, name, closing, raw in _Tags(page):
        add(page[at:start])
        at = after
        if name == "a":
            links = max(0, links - 1) if closing else 1
        elif name == "br":
            parts.append(" ")
        elif name in BLOCKS:
            close()
            own_mark = own_name = False
            links = 0 if name in HOLDERS else links
            if closing:
                heading = False
                if name in HOLDERS and is_open[name]:
                    while True:
                        last = stack.pop()[0]
                        is_open[last] -= 1
                        if last == name:
                            break
            else:
                heading = len(name) == 2 and name[0] == "h" and name[1].isdigit()
                within, marked, named = stack[-1][1:] if stack else (False, False, False)
                inside, mark, word = _place(name, raw, within)
                if name not in HOLDERS:
                    own_mark, own_name = mark, word
                elif not raw.endswith("/"):
                    stack.append((name, within or inside, marked or mark, named or word))
                    is_open[name] += 1
    add(page[at:])
    close()
    return found


def stop_share(text: str) -> float:
    """Stop words among the words of a text."""
    words = _WORD.findall(text.lower())
    return sum(map(STOP_WORDS.__contains__, words)) / max(1, len(words))


def first_pass(found: list[Block]) -> None:
    """Labels from link density, length and stop-word density, whatever the place."""
    for b in found:
        n = len(b.text)
        stop = stop_share(b.text) if n >= SHORT else 0.0  # too few words to tell otherwise
        if b.link_chars > LINKS * n:
            b.first = "bad" if n < LONG or stop < STOP_LOW else "odd"
        elif n < LONG and "©" in b.text:
            b.first = "foot"
        elif n >= LONG and stop >= STOP_HIGH:
            b.first = "good"
        elif stop >= STOP_LOW or (not b.link_chars and b.text.endswith(_SENTENCE_END) and any(map(str.isalpha, b.text))):
            b.first = "prose"
        else:
            b.first = "odd"


def _nearest(own: list[Block]) -> list[tuple[str, int]]:
    """For each block the label of the last decided block before it, and how many blocks away it is."""
    out, label, away = [], "", 0
    for b in own:
        away += 1
        out.append((label, away))
        if b.label in ("good", "bad") and b.first != "foot":
            label, away = b.label, 0
    return out


def second_pass(found: list[Block]) -> None:
    """Undecided blocks inherit from their nearest decided neighbours, within an article or outside of all; places outrank contents."""
    text = ("good", "prose")
    named = any(b.first in text and not b.marked and not b.named for b in found)  # else the words of class and id mark all there is
    out = [b.marked or (named and b.named) for b in found]
    for b, gone in zip(found, out, strict=True):
        b.label = "bad" if gone or b.first == "foot" else b.first
    inside = [b for b, gone in zip(found, out, strict=True) if not gone]
    articles = any(b.within for b in inside)
    for within in (True, False):
        own = [b for b in inside if b.within == within]
        if (within or not articles) and not any(b.first == "good" for b in own):
            for b in own:  # nothing stands out: what reads like prose is the text there is
                b.label = "good" if b.first == "prose" else b.label
        before, after = _nearest(own), _nearest(own[::-1])[::-1]
        ahead = any(b.heading for b in own)
        for b, (left, l_away), (right, r_away) in zip(own, before, after, strict=True):
            ahead = ahead and not b.heading
            if b.label in ("good", "bad"):
                continue
            if articles and not within:  # beside an article, prose has to stand among prose
                b.label = "good" if left == right == "good" else "bad"
            elif b.heading and right:
                b.label = right
            elif b.first == "prose":
                b.label = "bad" if left == "bad" and (right == "bad" or (ahead and l_away <= r_away)) else "good"
            elif left and right:
                b.label = left if left == right else (left if l_away < r_away else right if r_away < l_away else "good")
            else:
                b.label = left or right or "good"


def main_text(page: str | None) -> str:
    """The good blocks, joined by blank lines; empty for null, empty and text-free pages."""
    found = blocks(page or "")
    first_pass(found)
    second_pass(found)
    return "\n\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame, column: str = "html", into: str = "text") -> DataFrame:
    """pages without the html column, with text and n_chars (code points).

    Each row is worked on by itself, whole and in time in proportion to its
    length: repeated rows give equal results, an empty table an empty one, null
    and empty pages an empty text. Columns of pages named text or n_chars
    are replaced.
    """
    keep = [c for c in pages.columns if c.lower() not in {column.lower(), into.lower(), "n_chars"}]
    # Whole pages may be large: the other columns stay in the frame and few rows go at once.
    given = pages.select(*[f"`{c}`" for c in keep], pages[column].alias("__html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.drop("__html").schema) + (", " if keep else "") + f"`{into}` string, n_chars long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(x) for x in part.column("__html").to_pylist()]
                columns = [part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*keep, into, "n_chars"])

    return given.mapInArrow(work, schema)
