"""Pages as trees: selectors, pruning, text, links and images. One parse gives every field of a page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuskit.functions.urls import IMAGE_KINDS, NO_PAGE, canonical

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


@dataclass(frozen=True)
class PageOptions:
    """What to take from a page. The defaults take its text; see extract()."""

    content_selector: str | None = None
    exclude_selectors: tuple[str, ...] = ("script", "style", "nav", "footer", "header")
    keep_selectors: tuple[str, ...] = ()
    extract_links_from_content_only: bool = False
    link_selectors: tuple[str, ...] = ()
    allowed_url_patterns: tuple[str, ...] = ()
    content_types: tuple[str, ...] = ("text",)
    img_allow: tuple[str, ...] = IMAGE_KINDS


@dataclass(eq=False)
class Element:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Element | None = None
    children: list = field(default_factory=list)

    def below(self) -> Iterator[Element]:
        """The elements inside, in document order."""
        stack = [x for x in reversed(self.children) if isinstance(x, Element)]
        while stack:
            found = stack.pop()
            yield found
            stack.extend(x for x in reversed(found.children) if isinstance(x, Element))

    def strings(self) -> Iterator[str]:
        stack = list(reversed(self.children))
        while stack:
            found = stack.pop()
            if isinstance(found, str):
                yield found
            else:
                stack.extend(reversed(found.children))

    def same(self, other: Element) -> bool:
        """Equal in structure: tag, attributes and content."""
        todo = [(self, other)]
        while todo:
            a, b = todo.pop()
            if isinstance(a, str) or isinstance(b, str):
                if a != b:
                    return False
                continue
            if a is b:
                continue
            if a.tag != b.tag or a.attrs != b.attrs or len(a.children) != len(b.children):
                return False
            todo += zip(a.children, b.children, strict=True)
        return True


class Builder(HTMLParser):
    """A tolerant tree: an end tag closes the nearest open element of its name, else it is passed over."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("#document")
        self.open: dict[str, int] = {}  # so that a stray end tag needs no walk

    def handle_starttag(self, tag, attrs):
        made = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(made)
        if tag not in VOID:
            self.at = made
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Element(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        if self.open.get(tag):
            ended = ""
            while ended != tag:
                ended, self.at = self.at.tag, self.at.parent
                self.open[ended] -= 1

    def handle_data(self, data):
        self.at.children.append(data)


def tree(page: str) -> Element:
    build = Builder()
    build.feed(page)
    build.close()
    return build.root


SIMPLE = re.compile(r"(?P<tag>\*|[A-Za-z][\w-]*)?(?P<rest>(?:[.#][\w-]+|\[[^\]]+\])*)$")


def _simple(selector: str):
    m = SIMPLE.match(selector)
    if not m or not selector:
        raise ValueError(f"unsupported selector: {selector!r}")
    tests = re.findall(r"([.#])([\w-]+)|\[([\w-]+)(?:=[\"']?([^\"'\]]*)[\"']?)?\]", m["rest"])

    def matches(e: Element) -> bool:
        if m["tag"] not in (None, "*") and e.tag != m["tag"].lower():
            return False
        for kind, name, attr, value in tests:
            if kind == "." and name not in e.attrs.get("class", "").split():
                return False
            if kind == "#" and e.attrs.get("id") != name:
                return False
            if attr and (attr not in e.attrs or value and e.attrs[attr] != value):
                return False
        return True

    return matches


def select(root: Element, selector: str) -> list[Element]:
    """Elements below root that match: tag, .class, #id, [attribute=value] and their combinations; descendants by spaces, alternatives by commas."""
    ways = [[_simple(s) for s in way.split()] for way in selector.split(",")]
    out = []
    for e in root.below():
        for *above, last in ways:
            if not last(e):
                continue
            up, left = e.parent, list(above)
            while up is not None and left:
                if left[-1](up):
                    left.pop()
                up = up.parent
            if not left:
                out.append(e)
                break
    return out


def text_of(e: Element) -> str:
    return " ".join(s for x in e.strings() if (s := x.strip()))


def links_in(zones: list[Element], url: str, patterns: tuple[str, ...]) -> list[str]:
    found = set()
    for zone in zones:
        for e in ([zone] if zone.tag == "a" else []) + [x for x in zone.below() if x.tag == "a"]:
            href = e.attrs.get("href")
            if href is not None and not (href := href.strip()).startswith(NO_PAGE):
                link = canonical(url, href)
                if link and (not patterns or any(re.search(p, link) for p in patterns)):
                    found.add(link)
    return sorted(found)


def images_in(zone: Element, url: str, kinds: tuple[str, ...]) -> list[str]:
    from urllib.parse import urljoin, urlparse

    found = set()
    for e in zone.below():
        if e.tag == "img" and (src := e.attrs.get("src", "").strip()):
            if src.startswith("data:image/"):
                found.add(src)
                continue
            whole = urljoin(url, src)
            if urlparse(whole).path.rsplit(".", 1)[-1].lower() in kinds:
                found.add(whole)
    return sorted(found)


def extract(page: str, url: str, options: PageOptions = PageOptions()) -> dict:
    """title, text, images and links of a page.

    The zone of the content is the first match of the content selector, else the page. Where text is
    asked for, the excluded elements of the zone are cut out first, unless they equal an element that
    is to be kept; so their links and images are gone as well. A kept element inside one that is cut
    goes with it. Links come from the page or only the zone, and from the link selectors' matches.
    """
    root = tree(page)
    titles = [e for e in root.below() if e.tag == "title"]
    title = "".join(titles[0].strings()).strip() if titles else None
    zone = root
    if options.content_selector:
        zone = next(iter(select(root, options.content_selector)), root)
    text = ""
    if {"text", "text+images"} & set(options.content_types):
        kept = [e for s in options.keep_selectors for e in select(zone, s)]
        for s in options.exclude_selectors:
            for e in select(zone, s):
                if not any(e.same(k) for k in kept):
                    e.parent.children = [c for c in e.parent.children if c is not e]
        text = text_of(zone)
    zones = [zone if options.extract_links_from_content_only else root]
    zones += [e for s in options.link_selectors for e in select(root, s)]
    images = images_in(zone, url, options.img_allow) if {"images", "text+images"} & set(options.content_types) else []
    return {"title": title, "text": text, "images": images, "links": links_in(zones, url, options.allowed_url_patterns)}


def page_fields(page: Column, url: Column, options: PageOptions = PageOptions()) -> Column:
    """extract() as a struct column; null pages give null fields."""

    @F.arrow_udf("title string, text string, images array<string>, links array<string>")
    def run(pages: pa.Array, urls: pa.Array) -> pa.Array:
        none = {"title": None, "text": None, "images": None, "links": None}
        rows = [none if p is None else extract(p, u or "", options) for p, u in zip(pages.to_pylist(), urls.to_pylist(), strict=True)]
        return pa.array(rows, pa.struct([("title", pa.string()), ("text", pa.string()), ("images", pa.list_(pa.string())), ("links", pa.list_(pa.string()))]))

    return run(page, url)


#: The white space that SQL's trim() takes off: space separators (Zs).
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def written_title(page: Column) -> Column:
    """The first title as the source of a page has it, trimmed of spaces; empty where there is none, null for a null page.

    Unlike extract(), which reads references as browsers do, it decodes only &lt; &gt; &quot; and &amp;
    with their semicolons, once. Only the first start tag counts, so one pass over a page is enough.
    """
    title = F.trim(F.regexp_extract(page, r"(?is)\A(?>.*?<title[^>]*>)(.*?)</title>", 1), F.lit(SPACES))
    for reference, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        title = F.replace(title, F.lit(reference), F.lit(char))
    return title


def to_markdown(page: str, strip: tuple[str, ...] = ("img",)) -> str:
    """Markdown of a page: headings, paragraphs, emphasis, links, lists, quotes, code, rules and tables; tags in strip leave their text only."""
    out: list[str] = []

    def whole(e: Element, inner: str) -> str:
        """An inline element around what is made of its content."""
        if e.tag in strip:
            return inner
        if e.tag in ("b", "strong") and inner.strip():
            return f"**{inner.strip()}**"
        if e.tag in ("i", "em") and inner.strip():
            return f"*{inner.strip()}*"
        if e.tag == "code":
            return f"`{inner}`"
        if e.tag == "a" and e.attrs.get("href"):
            return f"[{inner.strip()}]({e.attrs['href']})"
        if e.tag == "img":
            return f"![{e.attrs.get('alt', '')}]({e.attrs.get('src', '')})"
        return "  \n" if e.tag == "br" else inner

    def inline(top: Element | str) -> str:
        # frames of (element, rest of its content, what is made so far): pages may be deep
        frames: list[tuple[Element, Iterator, list[str]]] = [(Element("#inline"), iter([top]), [])]
        while True:
            e, rest, made = frames[-1]
            for c in rest:
                if isinstance(c, str):
                    made.append(re.sub(r"\s+", " ", c))
                elif c.tag not in ("script", "style", "head", "title"):
                    frames.append((c, iter(c.children), []))
                    break
            else:
                frames.pop()
                if not frames:
                    return "".join(made)
                frames[-1][2].append(whole(e, "".join(made)))

    def block(top: Element) -> None:
        run: list[str] = []

        def flush() -> None:
            if text := "".join(run).strip():
                out.append(text)
            run.clear()

        open_boxes = [iter(top.children)]
        while open_boxes:
            for c in open_boxes[-1]:
                if isinstance(c, str) or c.tag in ("a", "b", "strong", "i", "em", "code", "img", "span", "br", "u", "small", "sub", "sup"):
                    run.append(inline(c))
                    continue
                flush()
                if c.tag in ("script", "style", "head", "title"):
                    continue
                if re.fullmatch("h[1-6]", c.tag):
                    out.append("#" * int(c.tag[1]) + " " + inline(c).strip())
                elif c.tag in ("ul", "ol"):
                    items = [x for x in c.children if isinstance(x, Element) and x.tag == "li"]
                    out.append("\n".join(f"{'*' if c.tag == 'ul' else f'{n}.'} {inline(item).strip()}" for n, item in enumerate(items, 1)))
                elif c.tag == "blockquote":
                    out.append("\n".join(f"> {line}" for line in inline(c).strip().split("\n")))
                elif c.tag == "pre":
                    out.append("```\n" + "".join(c.strings()).strip("\n") + "\n```")
                elif c.tag == "hr":
                    out.append("---")
                elif c.tag == "table":
                    rows = [[inline(x).strip() for x in r.children if isinstance(x, Element) and x.tag in ("td", "th")] for r in c.below() if r.tag == "tr"]
                    if rows:
                        out.append("\n".join("| " + " | ".join(r) + " |" for r in [rows[0], ["---"] * len(rows[0]), *rows[1:]]))
                else:
                    open_boxes.append(iter(c.children))
                    break
            else:
                flush()
                open_boxes.pop()

    block(tree(page))
    return "\n\n".join(x for x in out if x.strip())


def markdown(page: Column, strip: tuple[str, ...] = ("img",)) -> Column:
    @F.arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([None if p is None else to_markdown(p, strip) for p in pages.to_pylist()], pa.string())

    return run(page)
