"""A tolerant HTML tokenizer that builds the tree of a page, in one pass of a regular expression."""

from __future__ import annotations

import html
import re
from bisect import bisect_right

#: Fixed values of HTML: elements without content; raw-text elements; what an element's start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEAD = frozenset("base link meta title style script noscript template".split())
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
}
#: Elements that make a line of their own in a page; text of the others runs on.
STRUCTURAL = BLOCKS | frozenset("html body head li dt dd tr td th thead tbody tfoot caption br option select button label legend textarea iframe object video audio canvas svg noscript template title".split())

# Without backtracking: a tag that has a > somewhere behind it is always read in one go.
TOKEN = re.compile(r"<!--(?:.*?-->|.*+)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|<[!?][^>]*+>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}
SPACE = re.compile(r"\s+")


class Node:
    """An element. parts: its texts and elements in page order."""

    __slots__ = ("tag", "attributes", "parent", "parts")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent, self.parts = tag, attributes, parent, []

    def attribute(self, name: str) -> str:
        for m in ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return html.unescape(m[2] or m[3] or m[4] or "")
        return ""


#: Elements that a paragraph may hold open, and the paragraph itself.
RUNNING = frozenset("b i em strong a span u small font p".split())


class Open:
    """The open elements, outermost first, and at which places those of each tag are; so that no walk is needed to find one."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.others = [root], {}, [0]

    def add(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag not in RUNNING:
            self.others.append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tag: str) -> int:
        found = self.places.get(tag)
        return found[-1] if found else -1

    def close(self, place: int) -> None:
        """End the element at a place and all inside it."""
        while len(self.nodes) > place:
            gone = self.nodes.pop()
            self.places[gone.tag].pop()
            if self.others[-1] == len(self.nodes):
                self.others.pop()

    def end_tag(self, tag: str) -> None:
        at = self.last(tag)
        # a table's cells end nothing outside their own table
        if at > 0 and not (tag in BLOCKS and self.last("table") > at):
            self.close(at)

    def make_way(self, tag: str) -> None:
        """End what the start of a tag ends."""
        if tag in BLOCKS:
            if self.last("p") > self.others[-1]:
                self.close(self.last("p"))
        elif tag in CLOSES:
            closed, within = CLOSES[tag]
            border = max(map(self.last, within))
            inside = [p[i] for t in closed if (p := self.places.get(t)) and (i := bisect_right(p, border)) < len(p)]
            if inside:
                self.close(min(inside))
        if self.nodes[-1].tag == "head" and (tag in BLOCKS or tag not in HEAD and tag not in CLOSES):
            self.close(len(self.nodes) - 1)


def parse(page: str) -> Node:
    """The tree of a page, in time linear in its length however deep it is. Never fails: stray end tags are passed over, open elements end where HTML lets them."""
    root = Node("#root", "", None)
    at, n, path = 0, len(page), Open(root)
    closing, comment = page.rfind(">"), page.find("<!--")
    while at < n:
        # with no > ahead there is no tag ahead
        m = TOKEN.search(page, at) if at <= closing or comment >= 0 and page.find("<!--", at) >= 0 else None
        node = path.nodes[-1]
        if m is None:
            node.parts.append(page[at:])
            break
        if m.start() > at:
            node.parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            path.end_tag(tag)
            continue
        path.make_way(tag)
        node = path.nodes[-1]
        made = Node(tag, m[3], node)
        node.parts.append(made)
        if tag in VOID or m[3].endswith("/") and tag not in STRUCTURAL:
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            made.parts.append(page[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        path.add(made)
    return root


def clean(text: str) -> str:
    """White space as one space, trimmed."""
    return SPACE.sub(" ", text).strip()
