"""Writes web pages with known main text, in many layouts, to train the block labeller."""

from __future__ import annotations

import html
import random

#: Names that sites give to parts of a page.
NAMES = {
    "menu": "nav menu navbar topnav navigation breadcrumb breadcrumbs links toc tabs pager pagination",
    "head": "header masthead top site-header branding logo banner hero toolbar",
    "foot": "footer site-footer bottom copyright legal colophon foot",
    "side": "sidebar side aside rail widget related recommended trending popular more-stories tags author-box share social",
    "ad": "ad ads advert advertisement sponsored promo sponsor ad-slot commercial banner-ad",
    "notice": "cookie notice alert consent gdpr popup modal newsletter subscribe banner warning message privacy paywall",
    "talk": "comments comment comment-list replies reply discussion disqus responses reader-comments feedback",
    "form": "form search login signup contact subscribe-form search-form newsletter-form",
    "main": "article post content entry story main body text post-body article-body entry-content main-content story-text page",
}
WRAPPERS = "site page site-content content-area site-main wrap wrapper container row home blog inner outer column layout grid root app main-wrap primary"
ELEMENTS = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form", "main": "article"}
_SYLLABLES = "an ar be ca da de el en er es fa ga he in is ka la le lo ma me mi na ne no on or pa pe qu ra re ri ro sa se si st ta te th ti to tra un ur va ve za é ü ñ ó ä ç".split()


class PageMaker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.main: set[str] = set()
        self.style = ""  # main text may be junk; it is main text all the same

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def phrase(self, least: int, most: int) -> str:
        words = [self.word() for _ in range(self.r.randint(least, most))]
        if self.r.random() < 0.9:
            words[0] = words[0].capitalize()
        return " ".join(words)

    def prose(self, most: int = 6) -> str:
        if self.r.random() < 0.04:  # lines that look like a page's edges, anywhere
            return self.r.choice((f"Copyright (c) {self.r.randint(1990, 2025)} {self.word()}. All rights reserved.", f"Licensed under the {self.phrase(1, 2)} License, Version 2.0.", f"{self.word()}@{self.word()}.example.com +{self.r.randint(10**9, 10**10)}", f"{self.word()}: {self.r.getrandbits(120):x}"))
        return " ".join(self.phrase(1, 22) + self.r.choice((".", ".", ".", "?", "!", ".")) for _ in range(self.r.randint(1, most)))

    def name(self, part: str) -> str:
        return self.r.choice(NAMES[part].split())

    def box(self, part: str, inside: str, semantic: float = 0.5) -> str:
        r = self.r
        tag = ELEMENTS.get(part) if r.random() < semantic else None
        kind = f' {r.choice(("class", "class", "id"))}="{self.name(part)}"'
        if tag and r.random() < 0.7 or not tag and r.random() < 0.04:
            kind = ""
        tag = tag or r.choice(("div", "div", "section" if part in ("main", "talk", "side") else "div"))
        return f"<{tag}{kind}>{inside}</{tag}>"

    def known(self, text: str, is_main: bool) -> str:
        """The text as markup, with some inline elements and references; its plain form is noted if it is main text."""
        plain = " ".join(text.split())
        if is_main and self.style:
            words = plain.split(" ")
            plain = " | ".join(words) if self.style == "|" else " ".join(f"{w} {w} {w} {w}" if self.style == "=" else w.upper() + "!!" if self.style == "!" else w + self.r.choice(("$$$", "###", "***")) for w in words)
        if is_main:
            self.main.add(plain)
        words = [html.escape(w, quote=False) for w in plain.split(" ")]
        if len(words) > 4 and self.r.random() < 0.3:
            i = self.r.randrange(len(words) - 2)
            tag = self.r.choice(("b", "em", "strong", 'a href="/x"', "i", "span", "code"))
            words[i] = f"<{tag}>{words[i]}"
            words[i + 1] += f"</{tag.split(' ')[0]}>"
        return (" " if self.r.random() < 0.9 else "\n  ").join(words)

    def link_list(self, n: int) -> str:
        link = lambda: f'<a href="/{self.word()}">{self.phrase(1, 4)}</a>'
        if self.r.random() < 0.75:
            return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>"
        return self.r.choice((" | ", " ", "")).join(link() for _ in range(n))

    def line(self, tag: str = "p", least: int = 1, most: int = 3) -> str:
        body = self.known(self.prose(most) if least == 1 else self.phrase(1, 5), False)
        return f"<{tag}>{body}</{tag}>" if self.r.random() < 0.8 else body

    def heading(self) -> str:
        t = self.r.choice(("h2", "h3", "h3", "h4", "p", "div"))
        return f"<{t}>{self.phrase(1, 4)}</{t}>"

    def noise(self, part: str) -> str:
        r = self.r
        if part == "menu":
            return self.box(part, self.link_list(r.randint(2, 9)), 0.7)
        if part == "head":
            return self.box(part, f"<{(t := r.choice(('h1', 'div', 'p', 'span')))}>{self.phrase(1, 5)}</{t}>" + (self.link_list(3) if r.random() < 0.4 else "") + (self.line() if r.random() < 0.4 else ""), 0.6)
        if part == "foot":
            return self.box(part, r.choice(("&copy; ", "© 2024 ", "")) + r.choice((f"{self.word()}.example.com &middot; ", "")) + self.prose(3) + (self.link_list(4) if r.random() < 0.4 else ""), 0.7)
        if part == "side":
            return self.box(part, self.heading() + (self.link_list(r.randint(2, 6)) if r.random() < 0.6 else "".join(self.line() for _ in range(r.randint(1, 3)))))
        if part == "ad":
            return (f"<!-- ad {r.randint(0, 99)} -->" if r.random() < 0.4 else "") + self.box(part, self.line(), 0)
        if part == "notice":
            return self.box(part, self.line() + ("<button>Ok</button>" if r.random() < 0.5 else ""), 0)
        if part == "form":
            return f'<form class="{self.name(part)}"><label>{self.phrase(1, 3)}</label><input name="q"><select><option>{self.word()}<option>{self.word()}</select><button>{self.word()}</button>' + (f"<p>{self.phrase(2, 9)}.</p>" if r.random() < 0.4 else "") + "</form>"
        inside = self.heading() if r.random() < 0.6 else ""
        for _ in range(r.randint(1, 5)):
            inside += f'<{(t := r.choice(("div", "li", "article")))} class="{self.name("talk")}"><{(u := r.choice(("b", "span", "h4", "div")))}>{self.phrase(1, 2)}</{u}><p>{self.prose(4)}</p></{t}>'
        return self.box("talk", inside, 0)

    def article(self) -> str:
        r, out = self.r, []
        self.style = r.choice("|!$=") if r.random() < 0.15 else ""
        again = r.choice((0.5, 0.7, 0.9)) if r.random() < 0.2 else 0.0
        broken = 0.09 if r.random() < 0.6 else 0.25  # share of what interrupts the text
        close = "" if r.random() < 0.12 else "</p>"
        if r.random() < 0.92:
            heading = f"<h1>{self.known(self.phrase(2, 14), True)}</h1>"
            kind = r.choice(("", "", ' class="entry-header"', ' class="post-header"', ' class="article-head"'))
            out.append(f"<header{kind}>{heading}</header>" if r.random() < 0.2 else heading)
        for _ in range(r.choice((1, 2, 3, 4, 5, 6, 8, 12, 20))):
            kind = r.random()
            if len(out) > 1 and r.random() < again:
                out.append(out[-1])
                continue
            if r.random() < broken:
                out.append(self.noise(r.choice(("ad", "side", "form", "notice", "ad", "side", "talk"))))
                kind = 0.0  # the text goes on
            if kind < 0.74:
                text = self.known(self.prose(7), True)
                out.append(f"<p><b>{text}<br>" if r.random() < 0.12 else f"<p>{text}{close}")
            elif kind < 0.79:
                out.append(f"<{(t := r.choice(('h2', 'h3')))}>{self.known(self.phrase(1, 7), True)}</{t}>")
            elif kind < 0.84:
                t = r.choice(("ul", "ol"))
                out.append(f"<{t}>" + "".join(f"<li>{self.known(self.phrase(2, 12), True)}</li>" for _ in range(r.randint(2, 5))) + f"</{t}>")
            elif kind < 0.88:
                out.append(f"<blockquote><p>{self.known(self.prose(2), True)}</p></blockquote>")
            elif kind < 0.91:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.known(self.phrase(1, 3), True)}</td>" for _ in range(2)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.93:
                out.append(f"<pre>{self.known(self.phrase(2, 12), True)}</pre>")
            else:
                out.append(f'<figure><img src="a.png"><figcaption>{self.known(self.phrase(2, 10), True)}</figcaption></figure>')
        if r.random() < 0.12:
            out.append(self.noise(r.choice(("talk", "side", "foot"))))
        return self.box("main", "".join(out), 0.6)

    def page(self) -> tuple[str, set[str]]:
        r, self.main = self.r, set()
        some = lambda parts, most: "".join(self.noise(r.choice(parts)) for _ in range(r.randint(0, most)))
        before = (self.noise("head") if r.random() < 0.5 else "") + (self.noise("menu") if r.random() < 0.8 else "") + some(("ad", "notice", "form", "side", "menu"), 2)
        after = some(("side", "ad", "talk", "notice", "form"), 3) + (self.noise("talk") if r.random() < 0.4 else "") + (self.noise("foot") if r.random() < 0.85 else "")
        body = self.article() if r.random() < 0.97 else ""
        if r.random() < 0.4:
            body = f"<{(t := r.choice(('main', 'div', 'section')))}>{body}{self.noise('side') if r.random() < 0.3 else ''}</{t}>"
        if r.random() < 0.35:  # wrappers whose names say nothing, or too much
            wrap = lambda x: f'<{r.choice(("div", "div", "main", "section"))} {r.choice(("class", "id"))}="{r.choice(WRAPPERS.split())}">{x}</div>'
            for _ in range(r.randint(1, 3)):
                if r.random() < 0.5:
                    body = wrap(body)
                else:
                    before, after = wrap(before + body + after).rsplit(body, 1) if body else (before, after)
        page = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{self.phrase(2, 9)}</title><style>p{{margin:0}}</style><script>var t="</p>";go(0);</script></head><body{r.choice(('', '', ' class="home blog"', ' id="top"'))}>{before}{body}{after}'
        return page + ("</body></html>" if r.random() < 0.9 else ""), self.main


def make_pages(count: int, seed: int) -> list[tuple[str, set[str]]]:
    """(page, texts of its main blocks) for ``count`` pages."""
    maker = PageMaker(seed)
    return [maker.page() for _ in range(count)]
