"""From HTML to the leaf blocks of a page: their texts, element paths and features.

Reading takes time in proportion to the page, however broken it is: every scan moves on past what it has read, the ends
of quoted attributes are remembered, and open elements are found by their tag's last place in the stack.
"""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass

import numpy as np

PATH_DIMS, WORD_DIMS, SHAPE_DIMS = 192, 48, 14
DIMS = PATH_DIMS + WORD_DIMS + SHAPE_DIMS

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_MARK = re.compile(r"[>\"']")
_DIGIT = re.compile(r"\d")
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|(?=\s|/|$))", re.I)
_PART = re.compile(r"[a-z]+")
#: Elements whose content is not markup.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements at whose edges a block ends.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre section select summary table tbody td template tfoot th thead tr ul".split()
)
#: Open elements that a start tag ends.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}}
#: Elements that such a search does not leave.
_SCOPE = frozenset("ul ol dl table select menu html body".split())


def _hash(s: str, dims: int) -> int:
    return zlib.crc32(s.encode("utf-8", "replace")) % dims


class Element:
    """An open element: its tag, its label (tag and name parts) and what it stands in."""

    __slots__ = ("tag", "label", "up", "depth", "vector")

    def __init__(self, tag: str, label: str, up: Element | None) -> None:
        self.tag, self.label, self.up, self.depth = tag, label, up, up.depth + 1 if up else 1
        self.vector: np.ndarray | None = None  # the hashed labels up to here, made when a block needs it


@dataclass(slots=True)
class Block:
    text: str
    within: Element | None
    link_chars: int

    @property
    def path(self) -> tuple[str, ...]:
        out, at = [], self.within
        while at:
            out.append(at.label)
            at = at.up
        return tuple(reversed(out))


class _Reader:
    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.stack: list[Element] = []
        self.places: dict[str, list[int]] = {}  # of each tag in the stack
        self.block_places: list[int] = []  # of all tags in BLOCK
        self.texts: list[str] = []
        self.linked = self.links = 0

    def flush(self) -> None:
        if self.texts:
            text = " ".join(html.unescape("".join(self.texts)).split())
            if text:
                self.blocks.append(Block(text, self.stack[-1] if self.stack else None, min(self.linked, len(text))))
            self.texts, self.linked = [], 0

    def last(self, tag: str) -> int:
        """The last place of a tag in the stack, or -1."""
        at = self.places.get(tag)
        return at[-1] if at else -1

    def close(self, at: int) -> None:
        if self.block_places and self.block_places[-1] >= at:
            self.flush()
        while len(self.stack) > at:
            e = self.stack.pop()
            self.places[e.tag].pop()
            if e.tag in BLOCK:
                self.block_places.pop()
            self.links -= e.tag == "a"

    def start(self, tag: str, attrs: str) -> None:
        if tag in BLOCK:
            self.flush()
            if self.block_places and self.stack[self.block_places[-1]].tag == "p":  # a block ends an open paragraph
                self.close(self.block_places[-1])
            if ends := _ENDS.get(tag):
                while (at := max(map(self.last, ends))) > max(map(self.last, _SCOPE)):
                    self.close(at)
                    if tag not in ("tr", "tbody"):
                        break
        elif tag == "br":
            self.texts.append(" ")
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            return
        parts = []
        for m in _NAMED.finditer(attrs) if attrs else ():
            name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if name in ("hidden", "style"):
                if name == "hidden" or re.search(r"display\s*:\s*none", value):
                    parts.append("hidden")
            else:
                parts += _PART.findall(value)
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.block_places.append(len(self.stack))
        self.stack.append(Element(tag, " ".join([tag, *parts]), self.stack[-1] if self.stack else None))
        self.links += tag == "a"

    def end(self, tag: str) -> None:
        at = self.last(tag)
        if at >= 0 and (tag in BLOCK or not self.block_places or at > self.block_places[-1]):  # else a stray end tag
            self.close(at)

    def add(self, text: str) -> None:
        self.texts.append(text)
        if self.links > 0:
            self.linked += len(text.strip())


class _Ends:
    """Where the tags of a page end: at the first ``>`` outside quotes, or at the first of all if quotes never close."""

    def __init__(self, page: str) -> None:
        self.page, self.known = page, {}  # mark -> end of a tag in which it stands outside quotes, -1 if there is none
        self.last = {c: page.rfind(c) for c in ">\"'"}

    def of(self, at: int) -> int:
        """The place of the ``>``; there must be one."""
        begin, passed, found = at, [], -1
        while m := _MARK.search(self.page, at):
            at = m.start()
            if at in self.known:
                found = self.known[at]
                break
            passed.append(at)
            if (c := m[0]) == ">":
                found = at
                break
            if at >= self.last[c]:
                break
            at = self.page.index(c, at + 1) + 1
        for x in passed:
            self.known[x] = found
        return found if found >= 0 else self.page.index(">", begin)


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order: text between block edges, references decoded, white space made one space."""
    page, reader, at = page or "", _Reader(), 0
    ends = _Ends(page)
    while at < len(page):
        sign = page.find("<", at)
        if sign < 0:
            sign = len(page)
        if sign > at:
            reader.add(page[at:sign])
        if sign == len(page):
            break
        if page.startswith("<!--", sign) or page.startswith("<![CDATA[", sign):
            close = "-->" if page[sign + 2] == "-" else "]]>"
            found = page.find(close, sign + 4)
            at = found + 3 if found >= 0 else len(page)
        elif sign > ends.last[">"]:
            reader.add("<")  # no tag ends any more
            at = sign + 1
        elif page.startswith(("<!", "<?"), sign):
            at = page.index(">", sign) + 1
        elif m := _NAME.match(page, sign + 1 + page.startswith("</", sign)):
            tag, close = m[0].lower(), ends.of(m.end())
            at = close + 1
            if page[sign + 1] == "/":
                reader.end(tag)
            elif tag in RAW:
                found = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = found.end() if found else len(page)
            else:
                reader.start(tag, page[m.end() : close].rstrip())
        else:
            reader.add("<")
            at = sign + 1
    reader.flush()
    return reader.blocks


class BlockFeatures:
    """Features of blocks: hashed tag path, hashed words and shape; paths and words keep their places in bounded tables."""

    def __init__(self) -> None:
        self.labels: dict[str, tuple[list[int], int]] = {}
        self.words: dict[str, int] = {}

    def _label(self, label: str) -> tuple[list[int], int]:
        if (found := self.labels.get(label)) is None:
            tag, *parts = label.split()
            found = [_hash(f"tag {tag}", PATH_DIMS), *(_hash(f"part {p}", PATH_DIMS) for p in parts)], _hash(f"last {tag}", PATH_DIMS)
            if len(self.labels) > 20_000:
                self.labels.clear()
            self.labels[label] = found
        return found

    def _path(self, e: Element | None) -> np.ndarray:
        """The hashed labels of an element and all that it stands in."""
        missing = []
        while e and e.vector is None:
            missing.append(e)
            e = e.up
        v = e.vector if e else np.zeros(PATH_DIMS, bool)
        for e in reversed(missing):
            v = v.copy()
            v[self._label(e.label)[0]] = True
            e.vector = v
        return v

    def _word(self, word: str) -> int:
        if len(self.words) > 200_000:
            self.words.clear()
        k = self.words[word] = _hash(word.lower(), WORD_DIMS)
        return k

    def page(self, found: list[Block], first: int = 0, stop: int | None = None) -> np.ndarray:
        """The features of the blocks ``first`` to ``stop`` of a page."""
        some = found[first:stop]
        x = np.zeros((len(some), DIMS), np.float32)
        known, missed = self.words.get, self._word
        for i, b in enumerate(some):
            if b.within:
                x[i, :PATH_DIMS] = self._path(b.within)
                x[i, self._label(b.within.label)[1]] = 1
            words = b.text.split(" ")
            counts = np.bincount([k if (k := known(w)) is not None else missed(w) for w in words], minlength=WORD_DIMS)
            x[i, PATH_DIMS : PATH_DIMS + WORD_DIMS] = counts / np.sqrt(float(counts @ counts))
            n, text, at = len(b.text), b.text, first + i
            marks = text.count(".") + text.count(",") + text.count("!") + text.count("?") + text.count(";")
            x[i, PATH_DIMS + WORD_DIMS :] = (
                np.log1p(n) / 5, np.log1p(len(words)) / 4, b.link_chars / n, min(1.0, 10 * marks / n), text[-1] in ".!?:\"'", text[0].isupper(), min(3.0, n / len(words) / 6),
                (b.within.depth if b.within else 0) / 10, n < 25, n > 120, "©" in text, len(_DIGIT.findall(text)) / n, at / len(found), 1 - (at + 1) / len(found),
            )
        return x
