"""The main content of a page whose markup does not name it: where its paragraphs are, told by text and links.

A page is read once, tag by tag. Every paragraph has a weight by its length and its commas; its parent has all of it,
what is above a share that shrinks level by level. Text in links counts against an element, and what is marked as navigation
or other matter beside the content is left out. The element that weighs most is the content, with those beside it that weigh
a good part of that.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser

from larkspur.functions.html import DROPPED, VOID

#: Elements that are paragraphs, those that end an open paragraph, and those that stand beside the content; names in class or id that say so.
PARAGRAPHS = {"p", "pre", "td", "blockquote", "dd"}
BLOCKS = PARAGRAPHS | {"div", "section", "article", "main", "ul", "ol", "table", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "footer", "nav", "aside"}
BESIDE = {"nav", "aside", "footer", "header", "form", "menu", "button", "select", "dialog"}
BESIDE_NAMES = re.compile(r"(?:^|[\s_-])(?:nav|navigation|navbar|menu|sidebar|footer|header|masthead|comments?|ads?|advert|banner|share|sharing|social|related|cookies?|breadcrumbs?|popup|modal|promo|sponsor(?:ed)?|newsletter|pagination)(?:$|[\s_-])", re.I)
#: A paragraph of less has no weight; how far up a weight goes; the share of the best that one beside it must weigh.
SHORT, LEVELS, GOOD_PART = 25, 4, 0.2


@dataclass(slots=True)
class Node:
    tag: str
    start: int
    parent: int
    beside: bool
    end: int = 0
    chars: int = 0
    linked: int = 0
    commas: int = 0
    weight: float = 0.0

    def worth(self) -> float:
        return self.weight * (1 - self.linked / self.chars) if self.chars else 0.0


class _Tree(HTMLParser):
    def __init__(self, page: str):
        super().__init__(convert_charrefs=False)
        self.lines = [0, *(m.end() for m in re.finditer("\n", page))]
        self.nodes = [Node("", 0, -1, False)]
        self.open, self.dropped = [0], ""
        self.count: Counter[str] = Counter()  # of open elements by tag: a page may be as deep as it is long
        self.feed(page)
        self.close()
        while len(self.open) > 1:
            self._end(len(page))
        self.nodes[0].end = len(page)

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        if self.dropped or tag in VOID:
            return
        if tag in DROPPED:
            self.dropped = tag
            return
        at = self._at()
        if tag in BLOCKS and self.count["p"]:
            while self.nodes[self.open[-1]].tag != "p":  # a block ends an open paragraph, and with it what is open in that
                self._end(at)
            self._end(at)
        named = dict(attrs)
        above = self.open[-1]
        beside = self.nodes[above].beside or tag in BESIDE or bool(BESIDE_NAMES.search(f"{named.get('class') or ''} {named.get('id') or ''}"))
        self.open.append(len(self.nodes))
        self.count[tag] += 1
        self.nodes.append(Node(tag, at, above, beside))

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if self.dropped:
            self.dropped = "" if tag == self.dropped else self.dropped
        elif self.count[tag]:
            at = self._at() + len(tag) + 3
            while self.nodes[self.open[-1]].tag != tag:
                self._end(at - len(tag) - 3)
            self._end(at)

    def _end(self, at: int) -> None:
        node = self.nodes[self.open.pop()]
        self.count[node.tag] -= 1
        node.end = at
        if node.beside:
            return
        above = self.nodes[node.parent]
        above.chars, above.commas = above.chars + node.chars, above.commas + node.commas
        above.linked += node.chars if node.tag == "a" else node.linked
        if node.tag in PARAGRAPHS and node.chars >= SHORT:
            own, k = 1 + node.commas + min(node.chars // 100, 3), node.parent
            for level in range(LEVELS):
                if k < 0:
                    break
                self.nodes[k].weight += own / (1 if level == 0 else 2 if level == 1 else 3 * level)
                k = self.nodes[k].parent

    def handle_data(self, data):
        if self.dropped:
            return
        text = " ".join(data.split())
        node = self.nodes[self.open[-1]]
        if not node.beside:
            node.chars, node.commas = node.chars + len(text), node.commas + text.count(",") + text.count("、") + text.count("，")

    def handle_entityref(self, name):
        self.handle_data("x")

    def handle_charref(self, name):
        self.handle_data("x")


def main_parts(page: str) -> list[tuple[int, int]]:
    """Where the main content of a page lies, as starts and ends; nothing where no paragraph has a weight."""
    nodes = _Tree(page).nodes
    best = max(range(len(nodes)), key=lambda k: (nodes[k].worth(), -k))
    worth = nodes[best].worth()
    if worth <= 0:
        return []
    if nodes[best].parent < 0:
        return [(0, len(page))]
    beside = [x for x in nodes if x.parent == nodes[best].parent and (x is nodes[best] or x.worth() >= GOOD_PART * worth or _is_text(x))]
    return [(x.start, x.end) for x in beside]


def _is_text(node: Node) -> bool:
    """A paragraph beside the content, with few links."""
    return node.tag == "p" and not node.beside and node.chars >= 80 and node.linked < 0.25 * node.chars
