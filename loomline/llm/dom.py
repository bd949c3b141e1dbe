"""A tolerant reading of HTML into a flat tree, and the features of its nodes."""

from __future__ import annotations

import html
import math
import re
import zlib

import numpy as np

SPECIAL = re.compile("[>\"']")
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))",
                       re.I)
PART = re.compile(r"[a-z]+|[0-9]+")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg"}
HIDDEN = RAW | {"head", "select", "button", "option", "datalist", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
        "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "dd", "details", "div", "dl", "dt",
         "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
         "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary",
         "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "#page"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ASIDE = set("nav menu navbar foot footer header head masthead side sidebar aside widget cookie consent "
            "notice notification alert banner ad ads advert advertisement sponsor sponsored promo form "
            "login signup search comment comments reply replies discussion respond share social "
            "related subscribe newsletter breadcrumb breadcrumbs popup modal legal copyright "
            "pagination tags toolbar contentinfo navigation complementary".split())
MAIN = set("article content main post entry story body text articlebody prose".split())
GROUPS = ["nav", "header", "footer", "aside", "form", "list", "li", "a", "p", "heading", "div",
          "section", "main", "table", "inline", "other"]
GROUP_OF = {"nav": 0, "header": 1, "footer": 2, "aside": 3, "form": 4, "fieldset": 4, "ul": 5,
            "ol": 5, "dl": 5, "li": 6, "dt": 6, "dd": 6, "a": 7, "p": 8, "blockquote": 8, "pre": 8,
            "div": 10, "section": 11, "article": 12, "main": 12, "table": 13, "tbody": 13,
            "tr": 13, "td": 13, "th": 13, "thead": 13}
GROUP_OF |= {f"h{size}": 9 for size in range(1, 7)}
GROUP_OF |= {name: 14 for name in "b i em strong span u small sub sup code mark font".split()}
BUCKETS = 16
NUMBERS = 24
WIDTH = NUMBERS + len(GROUPS) + BUCKETS


class Tree:
    """Nodes in page order: tag, parent, attribute tokens; texts with the node they stand in."""

    __slots__ = ("tags", "parents", "tokens", "pieces")

    def __init__(self) -> None:
        self.tags, self.parents, self.tokens = ["#page"], [-1], [()]
        self.pieces: list[tuple[int, str | None, bool]] = []  # node, text, breaks a block


def attribute_tokens(tag: str) -> tuple[str, ...]:
    out: list[str] = []
    for found in ATTRIBUTE.finditer(tag):
        out += PART.findall((found[2] or found[3] or found[4] or "").lower())
    return tuple(out)


class Tokens:
    """Comments, declarations, tags and texts of a page, each character looked at a few times."""

    def __init__(self, text: str):
        self.text = text
        self.last = {mark: text.rfind(mark) for mark in ">\"'"}
        self.ends: dict[int, int] = {}  # a mark outside quotes -> the end of the tag, -1: none
        self.mark = (0, -1)  # a place, and the first mark from there on

    def _mark_from(self, at: int) -> int:
        begin, mark = self.mark
        if not begin <= at <= mark:
            found = SPECIAL.search(self.text, at)
            mark = found.start() if found else len(self.text)
            self.mark = (at, mark)
        return mark

    def _tag_end(self, at: int) -> int:
        """The end of the tag that begins before `at`; -1 if quotes or the page end first."""
        passed, end = [], -1
        while at <= self.last[">"]:
            mark = self._mark_from(at)
            if mark in self.ends:
                end = self.ends[mark]
                break
            passed.append(mark)
            quote = self.text[mark]
            if quote == ">":
                end = mark + 1
                break
            if mark == self.last[quote]:
                break
            at = self.text.find(quote, mark + 1) + 1
        for mark in passed:
            self.ends[mark] = end
        return end

    def read(self, at: int) -> tuple[int, str]:
        """The end of the token at `at`, and whether it is a text, a tag or void."""
        text = self.text

        def until(mark: str, begin: int) -> int:
            found = text.find(mark, begin)
            return found if found >= 0 else len(text)

        if text[at] != "<":
            return until("<", at), "text"
        if text.startswith("<!--", at):
            return min(until("-->", at + 4) + 3, len(text)), "void"
        if at > self.last[">"]:  # nothing closes any more
            return until("<!--", at), "text"
        if text[at + 1] in "!?":
            return text.find(">", at) + 1, "void"
        end = self._tag_end(at + 1) if NAME.match(text, at) else -1
        return (end, "tag") if end > 0 else (at + 1, "text")

    def after(self, tag: str, at: int) -> int:
        """What follows the closing tag of an element whose content is not read."""
        found = re.compile(rf"</{tag}\b", re.I).search(self.text, at)
        end = self.text.find(">", found.end()) if found else -1
        return end + 1 if end >= 0 else len(self.text)


class Open:
    """The open elements, with where those of a name lie on the stack."""

    def __init__(self) -> None:
        self.nodes, self.names = [0], ["#page"]
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]

    def last(self, *names: str) -> int:
        """The place of the innermost open element of these names, 0 if there is none."""
        return max(self.places[name][-1] if self.places.get(name) else 0 for name in names)

    def push(self, node: int, name: str) -> None:
        self.places.setdefault(name, []).append(len(self.nodes))
        if name in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)
        self.names.append(name)

    def cut(self, place: int) -> None:
        """Close all from `place` on."""
        for name in self.names[place:]:
            self.places[name].pop()
            if name in BLOCK:
                self.blocks.pop()
        del self.nodes[place:], self.names[place:]


def parse(text: str | None) -> Tree:
    """One pass; unclosed and stray tags are repaired as browsers do in the common cases."""
    tree, stack, at = Tree(), Open(), 0
    text = text or ""
    tokens = Tokens(text)
    while at < len(text):
        end, kind = tokens.read(at)
        token, at = text[at:end], end
        if kind == "text":
            tree.pieces.append((stack.nodes[-1], html.unescape(token), False))
        if kind != "tag":
            continue
        named = NAME.match(token)
        tag = named[1].lower()
        if token[1] == "/":
            place = stack.last(tag)
            if place and (tag in BLOCK or place > stack.blocks[-1]):
                stack.cut(place)
                if tag in BLOCK:
                    tree.pieces.append((stack.nodes[-1], None, True))
            continue
        if tag in BLOCK:
            tree.pieces.append((stack.nodes[-1], None, True))
            if stack.names[stack.blocks[-1]] == "p":
                stack.cut(stack.blocks[-1])
        if tag in CLOSES:
            place = stack.last(*CLOSES[tag])
            if place > stack.last("ul", "ol", "dl", "table", "select"):
                stack.cut(place)
        if tag == "br":
            tree.pieces.append((stack.nodes[-1], " ", False))
        if tag in VOID:
            continue
        tree.tags.append(tag)
        tree.parents.append(stack.nodes[-1])
        tree.tokens.append(attribute_tokens(token))
        if token.endswith("/>"):
            continue
        if tag in RAW:
            at = tokens.after(tag, at)
            continue
        stack.push(len(tree.tags) - 1, tag)
    return tree


def hidden(tree: Tree) -> list[bool]:
    out = [False] * len(tree.tags)
    for node in range(1, len(out)):
        out[node] = tree.tags[node] in HIDDEN or out[tree.parents[node]]
    return out


def features(tree: Tree) -> np.ndarray:
    """A row per node: subtree density, attribute tokens, depth, sibling statistics."""
    n = len(tree.tags)
    parents = tree.parents
    own, marks = np.zeros(n), np.zeros(n)
    before, total = np.zeros(n), 0.0
    out_of_sight = hidden(tree)
    first_seen = [False] * n
    for node, text, _ in tree.pieces:
        if text is None or out_of_sight[node]:
            continue
        size = len(text.strip())
        if size and not first_seen[node]:
            first_seen[node] = True
            before[node] = total
        own[node] += size
        marks[node] += sum(map(text.count, ".,;:!?"))
        total += size
    length, points = own.copy(), marks.copy()
    links, below, paragraphs = np.zeros(n), np.zeros(n), np.zeros(n)
    kids, longest = np.zeros(n), np.zeros(n)
    for node in range(n - 1, 0, -1):  # children come after parents
        parent = parents[node]
        if tree.tags[node] == "a":
            links[node] = length[node]
        if tree.tags[node] == "p":
            paragraphs[node] += 1
        length[parent] += length[node]
        points[parent] += points[node]
        links[parent] += links[node]
        below[parent] += below[node] + 1
        paragraphs[parent] += paragraphs[node]
        kids[parent] += 1
        longest[parent] = max(longest[parent], length[node])
        if first_seen[node]:
            before[parent] = before[node] if not first_seen[parent] else min(before[parent], before[node])
            first_seen[parent] = True
    depth, index = np.zeros(n), np.zeros(n)
    seen_kids = np.zeros(n)
    minus, plus = np.zeros(n), np.zeros(n)
    up_minus, up_plus = np.zeros(n), np.zeros(n)
    after_main = np.zeros(n)
    order_main = 0.0
    matrix = np.zeros((n, WIDTH), dtype=np.float32)
    for node in range(n):
        parent = parents[node]
        if node:
            depth[node] = depth[parent] + 1
            index[node] = seen_kids[parent]
            seen_kids[parent] += 1
        tag = tree.tags[node]
        names = tree.tokens[node]
        minus[node] = any(name in ASIDE for name in names)
        plus[node] = any(name in MAIN for name in names)
        group = GROUP_OF.get(tag, 15)
        bad, good = minus[node] or group <= 4, plus[node] or group == 12
        if node:
            up_minus[node] = max(up_minus[parent], float(bad))
            up_plus[node] = max(up_plus[parent], float(good))
        after_main[node] = order_main
        if group == 9 and tag == "h1":
            order_main = 1.0
        matrix[node, NUMBERS + group] = 1
        for name in names:
            matrix[node, NUMBERS + len(GROUPS) + zlib.crc32(name.encode()) % BUCKETS] = 1
    whole = max(total, 1.0)
    up = np.maximum(np.array(parents), 0)
    brothers = np.maximum(kids[up], 1)
    safe = np.maximum(length, 1)
    log = np.log1p
    numbers = [
        depth, log(kids), log(below), log(length), log(own), links / safe, length / (below + 1),
        100 * points / safe, log(paragraphs), length / whole, before / whole, log(brothers),
        index / brothers, longest / safe, length / np.maximum(length[up], 1),
        links[up] / np.maximum(length[up], 1), length[up] / whole, log(paragraphs[up]),
        minus, plus, up_minus, up_plus, after_main, own / safe,
    ]
    for at, values in enumerate(numbers):
        matrix[:, at] = values
    return matrix


def decode(tree: Tree, scores: np.ndarray) -> list[bool]:
    """Which nodes are main text: the best choice in which a kept node's ancestors are kept.

    A subtree is kept if its node's log-odds and what its children add are positive, so
    no descendant of a rejected node survives and no ancestor of a kept one is rejected.
    """
    n = len(tree.tags)
    out_of_sight = hidden(tree)
    best = np.where(np.array(out_of_sight), -math.inf, scores).astype(float)
    best[0] = max(best[0], 0.0)
    gain = best.copy()
    for node in range(n - 1, 0, -1):
        if gain[node] > 0:
            gain[tree.parents[node]] += gain[node]
    kept = [True] + [False] * (n - 1)
    for node in range(1, n):
        kept[node] = kept[tree.parents[node]] and bool(gain[node] > 0)
    return kept


def text_of(tree: Tree, kept: list[bool]) -> str:
    """Blocks of kept text in page order, one line each."""
    blocks: list[str] = []
    parts: list[str] = []
    for node, text, breaks in tree.pieces:
        if breaks:
            if line := " ".join("".join(parts).split()):
                blocks.append(line)
            parts = []
        elif kept[node] and text is not None:
            parts.append(text)
    if line := " ".join("".join(parts).split()):
        blocks.append(line)
    return "\n".join(blocks)
