"""Labelled pages to train the extraction model: invented layouts with known main text.

Elements carry data-main="yes" or "no"; what has no mark of its own takes its parent's. The layouts
cover semantic elements, named boxes, pages without a single name, and tables as frames, with articles
from one word on, notices, adverts and lists of links between their paragraphs.
"""

from __future__ import annotations

import random

#: Names that page authors give to the parts of a page.
MAIN = "article content main post entry story body text page article-body post-content entry-content main-content story-text article__text blog-post single hentry prose markdown richtext".split()
WRAPPERS = "wrapper container page site layout grid row col inner outer app root shell box section block panel".split()
NAMES = {
    "menu": "nav menu navbar main-menu navigation breadcrumb breadcrumbs topnav site-nav nav-links tabs toolbar pagination pager toc skip-links sitemap langs".split(),
    "header": "header site-header masthead top topbar banner logo branding hero-bar page-header head".split(),
    "footer": "footer site-footer bottom colophon copyright legal footnotes-bar foot contact credits imprint".split(),
    "sidebar": "sidebar side aside widget widgets rail right-col left-col secondary related recommended more-stories trending popular tags tag-cloud archive recent also-like read-next teaser teasers".split(),
    "notice": "cookie cookies cookie-banner consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall warning message announcement toast disclaimer privacy dialog".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsbox banner-ad ad-slot dfp commercial partner-offer outbrain taboola".split(),
    "form": "form search search-box login contact-form register poll survey feedback".split(),
    "share": "share social share-buttons social-links follow like tweet tools actions print byline meta".split(),
    "comments": "comments comment comment-list responses discussion replies reply disqus reader-comments respond thread reactions".split(),
}
TAGS = {"menu": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"], "notice": ["div", "aside", "section", "dialog"], "advert": ["div", "aside", "ins", "section"], "form": ["form", "div"], "share": ["div", "ul", "p"], "comments": ["section", "div", "ol", "aside"]}
ROLES = {"menu": "navigation", "header": "banner", "footer": "contentinfo", "sidebar": "complementary", "notice": "alert", "form": "search"}

#: Parts that nothing but a name tells from an article.
UNCLEAR = {"sidebar", "notice", "advert", "comments"}


class Maker:
    def __init__(self, seed: int):
        r = self.rnd = random.Random(seed)
        #: How often elements of this page have names; pages without any tell their parts apart by tags and texts.
        self.named = r.choice([0.9, 0.9, 0.5, 0.0, 0.0])
        #: Whether the article is a single short paragraph.
        self.brief = r.random() < 0.12

    def words(self, low: int, high: int) -> str:
        r = self.rnd
        out = ["".join(r.choice("aeioulnrstdm") for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(low, high + 1))]
        return " ".join(w + (r.choice([",", "."]) if r.random() < 0.12 else "") for w in out).capitalize()

    def sentence(self, low: int, high: int, ends: float = 0.85) -> str:
        return self.words(low, high).rstrip(".,") + "." * (self.rnd.random() < ends)

    def attributes(self, names: list[str], kind: str = "") -> str:
        r, out = self.rnd, ""
        if names and r.random() < self.named:
            picked = r.choice(names) + (f" {r.choice(WRAPPERS)}" if r.random() < 0.2 else "")
            out += f' {r.choice(["class", "class", "id"])}="{picked}"'
        if kind in ROLES and r.random() < 0.15:
            out += f' role="{ROLES[kind]}"'
        return out

    def links(self, tag: str, low: int, high: int) -> str:
        one = [f"<{tag}><a href='/x'>{self.words(1, 3)}</a></{tag}>" for _ in range(self.rnd.randrange(low, high))]
        return "".join(one)

    def row(self) -> str:
        """Links beside each other."""
        return self.rnd.choice(["", " ", " | ", "<br>"]).join(f"<a href='/x'>{self.words(1, 3)}</a>" for _ in range(self.rnd.randrange(1, 7)))

    def part(self, kind: str) -> str:
        """A piece of a page that is not its main text."""
        r, tag = self.rnd, self.rnd.choice(TAGS[kind])
        bare = tag in ("div", "section", "p", "ul", "ol", "aside")
        names = self.attributes(NAMES[kind], kind)
        if bare and not names and (self.named or kind in UNCLEAR):
            names = f' class="{r.choice(NAMES[kind])}"'
        if not bare and r.random() < 0.5:
            names = ""
        p = lambda a, b: f"<p>{self.sentence(a, b, 0.6)}</p>"
        if kind == "menu":
            inner = f"<ul>{self.links('li', 1, 9)}</ul>" if tag != "ul" else self.links("li", 1, 9)
            if tag != "ul" and r.random() < 0.4:
                inner = self.row()
        elif kind == "header":
            inner = r.choice([f"<a href='/'>{self.words(1, 3)}</a>", f"<h1>{self.words(1, 4)}</h1><p>{self.words(2, 8)}</p>", self.words(1, 6) + f"<ul>{self.links('li', 2, 6)}</ul>", f"<h2>{self.words(1, 3)}</h2>", f"<p>{self.words(3, 10)}</p>"])
        elif kind == "footer":
            inner = r.choice([f"&copy; {self.words(2, 12)}", p(3, 20) + self.links("span", 1, 5), f"<ul>{self.links('li', 2, 6)}</ul>" + p(4, 14), p(10, 40)])
        elif kind == "sidebar":
            inner = f"<h3>{self.words(1, 4)}</h3>" * (r.random() < 0.6) + r.choice([f"<ul>{self.links('li', 2, 8)}</ul>", p(5, 30), p(8, 50) + p(5, 25), self.words(4, 30), f"<div>{self.words(3, 20)}</div>"])
        elif kind in ("notice", "advert"):
            inner = r.choice([self.words(3, 30), p(5, 40), f"<h4>{self.words(1, 4)}</h4>" + p(5, 25), self.words(4, 14) + f"<a href='/x'>{self.words(1, 4)}</a>", p(5, 20) + f"<button>{self.words(1, 2)}</button>"])
        elif kind == "form":
            inner = f"<label>{self.words(1, 4)}</label><input name=q>" + p(2, 12) * (r.random() < 0.4) + f"<select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select>" * (r.random() < 0.3) + f"<button>{self.words(1, 2)}</button>"
            inner = inner if tag == "form" else f"<form>{inner}</form>"
        elif kind == "share":
            inner = self.links("li" if tag == "ul" else "span", 2, 6) if r.random() < 0.7 else self.words(2, 8)
        else:
            each = "li" if tag == "ol" else r.choice(["div", "article", "section"])
            inner = f"<h3>{self.words(1, 3)}</h3>" * (r.random() < 0.7 and tag != "ol")
            inner += "".join(f"<{each}{self.attributes(['comment', 'reply', 'comment-body', 'response'])}>" + r.choice([p(4, 60), p(3, 15), f"<b>{self.words(1, 2)}</b>{self.words(4, 40)}", f"<span>{self.words(1, 2)}</span>" + p(4, 70) + p(3, 20)]) + f"</{each}>" for _ in range(r.randrange(1, 6)))
        return f'<{tag}{names} data-main="no">{inner}</{tag}>'

    def paragraph(self) -> str:
        r, text = self.rnd, self.sentence(1, r_high := self.rnd.choice([4, 15, 15, 30, 60, 120, 200]))
        if r.random() < 0.25:
            text += r.choice([f" <a href='/x'>{self.words(1, 4)}</a> ", f" <b>{self.words(1, 5)}</b> ", f" <i>{self.words(1, 5)}</i>", f"<br>{self.words(1, 20)}", f"<code>{self.words(1, 3)}</code>"]) + self.words(0, r_high)
        return r.choice(["<p>{}</p>"] * 12 + ["<p>{}", f"<p><{r.choice(['b', 'i', 'em', 'strong', 'u'])}>{{}}" + r.choice(["", "<br>"]), "<div>{}</div>", "{}", "<blockquote><p>{}</p></blockquote>", "<p><span>{}</span></p>"] + ["<div>{}</div>"] * (6 if self.named < 0.3 else 0)).format(text)

    def main(self, odd: list[str]) -> str:
        r = self.rnd
        inner = f"<h1>{self.words(2, 12)}</h1>" if r.random() < (0.2 if self.brief else 0.65) else ""
        if self.brief:
            tag, text = r.choice(["article", "article", "main"]), self.sentence(1, r.choice([1, 3, 8]), 0.5)
            return f'<{tag}{self.attributes(MAIN)} data-main="yes">{inner}{r.choice(["<p>{}</p>", "{}"]).format(text)}</{tag}>'
        for _ in range(r.choice([1, 2, 2, 3, 4, 5, 8, 14])):
            inner += self.paragraph()
            x = r.random()
            if x < 0.08:
                inner += f"<h2>{self.words(1, 8)}</h2>"
            elif x < 0.13:
                inner += "<ul>" + "".join(f"<li>{self.words(2, 20)}</li>" for _ in range(r.randrange(2, 6))) + "</ul>"
            elif x < 0.15:
                inner += "<table><tr><th>" + self.words(1, 2) + "</th></tr><tr><td>" + self.words(1, 4) + "</td></tr></table>"
            elif x < 0.18:
                inner += f"<figure><img src=x><figcaption>{self.words(2, 12)}</figcaption></figure>"
            elif x < 0.22:
                inner += f"<ul>{self.links('li', 2, 6)}</ul>"
            elif x < 0.42 and odd:
                inner += self.part(r.choice(odd))
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section"] + ["div"] * (0 if self.named else 3))
        names = self.attributes(MAIN)
        if tag in ("div", "section") and not names and self.named:
            names = f' class="{r.choice(MAIN)}"'
        if r.random() < 0.15:
            inner = f"<div{self.attributes(MAIN)}>{inner}</div>"
        return f'<{tag}{names} data-main="yes">{inner}</{tag}>'

    def page(self) -> str:
        r = self.rnd
        some = lambda kinds, share: [self.part(k) for k in kinds if r.random() < share]
        before = some(["notice", "header", "menu", "form", "advert"], 0.55)
        after = some(["comments", "sidebar", "share", "advert", "notice", "form", "menu", "footer"], 0.45)
        odd = r.sample(["advert", "share", "sidebar", "notice", "form"], r.randrange(0, 4))
        r.shuffle(before)
        before, after = before * (r.random() < 0.8), after * (r.random() < 0.8)
        middle = self.main(odd)
        if r.random() < 0.4:
            inside = some(["menu", "advert", "share"], 0.3) + [middle] + some(["comments", "sidebar", "advert"], 0.3)
            wrap = r.choice(["div", "main", "section"])
            middle = f"<{wrap}{self.attributes(WRAPPERS)}>{''.join(inside)}</{wrap}>"
        if not self.named and r.random() < 0.35:
            left, right = (f"<td data-main='no'>{self.row() if r.random() < 0.7 else self.part('menu')}</td>" for _ in "ab")
            middle = "<table><tr>" + left + f"<td>{middle}</td>" + right * (r.random() < 0.4) + "</tr></table>"
        elif r.random() < 0.15 + 0.35 * (not self.named):
            box = lambda x: f"<div>{x}</div>"
            before, after = list(map(box, before)), list(map(box, after))
            middle = box(middle)
        body = "".join([*before, middle, *after])
        if r.random() < 0.35:
            body = f"<div{self.attributes(WRAPPERS)}>{body}</div>"
        head = f"<head data-main='no'><meta charset=utf-8><title>{self.words(1, 9)}</title><style>body{{color:#{r.randrange(1000):03}}}</style><script>if(1<2)go('<div>');</script></head>"
        if r.random() < 0.15:  # a fragment
            return body
        return f'<!DOCTYPE html><html lang="en">{head}<body data-main="no"><!-- x -->{body}</body></html>'


def labelled_pages(n: int = 1500, seed: int = 11) -> list[str]:
    return [Maker(seed * 1_000_003 + i).page() for i in range(n)]
