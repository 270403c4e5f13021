"""Labelled pages to train on: layouts drawn by a seeded generator, so that every block's label is known."""

from __future__ import annotations

import html
import random

#: Names that layouts give to what is main text and to what isn't.
MAIN = ("content", "entry content", "post body", "article body", "story", "main text", "post", "entry", "article", "page content", "rich text", "prose")
PARTS = {
    "menu": ("menu", "nav", "navbar", "site nav", "main menu", "breadcrumb", "breadcrumbs", "toc", "pagination", "tabs", "navigation", "topbar"),
    "header": ("header", "site header", "masthead", "branding", "logo", "top"),
    "footer": ("footer", "site footer", "bottom", "copyright", "legal", "colophon"),
    "side": ("sidebar", "aside", "related", "related posts", "widget", "recommended", "trending", "popular", "more", "teaser", "recirc"),
    "notice": ("cookie notice", "cookie banner", "consent", "gdpr", "notice", "alert", "paywall", "newsletter", "subscribe", "popup", "modal", "notification", "banner", "disclaimer"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor", "adbox", "ad slot", "promotion"),
    "comment": ("comments", "comment", "comment list", "comment body", "discussion", "responses", "replies", "reply", "disqus", "reviews", "reader comments"),
    "share": ("share", "social", "share bar", "tags", "meta", "byline", "author", "social links", "tools"),
    "form": ("search", "search form", "login", "signup", "contact form", "form"),
}
_SOUNDS = "an ba ce do el fi gra hu in jo ka li mo na or pe qua ri so ta un ve wi xo ya zu é ü ñ ß".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.main: list[str] = []

    def words(self, low: int, high: int) -> list[str]:
        return ["".join(self.r.choices(_SOUNDS, k=self.r.randint(1, 4))) for _ in range(self.r.randint(low, high))]

    def phrase(self, low: int = 1, high: int = 5) -> str:
        return " ".join(self.words(low, high)).capitalize()

    def prose(self) -> str:
        long = self.r.random() < 0.8
        n = self.r.randint(1, 6) if long else 1
        text = " ".join(self.phrase(*((4, 18) if long else (1, 5))) + self.r.choice(". . . ! ?".split()) for _ in range(n))
        if self.r.random() < 0.25:
            text = " ".join(w + self.r.choice(("###", "***", "&&&", "%%%", " |")) for w in text.split())
        return text

    def named(self, kind: str) -> str:
        name = self.r.choice(PARTS[kind])
        return self.attributes(name)

    def attributes(self, name: str) -> str:
        joint = self.r.choice(("-", "_", " "))
        value = name.replace(" ", joint)
        if self.r.random() < 0.3:
            value += " " + self.r.choice(("wide", "row", "col", "box", "x1", "inner", "light"))
        return f' {self.r.choice(("class", "class", "id", "role") if " " not in value else ("class",))}="{value}"'

    def link(self, text: str) -> str:
        return f'<a href="/{self.r.randint(1, 99)}">{html.escape(text)}</a>'

    def emit(self, tag: str, text: str, attributes: str = "") -> str:
        """A block of main text, with markup inside now and then."""
        self.main.append(" ".join(text.split()))
        words = [html.escape(w) for w in text.split()]
        if len(words) > 3 and self.r.random() < 0.3:
            k = self.r.randrange(len(words) - 1)
            words[k] = self.r.choice(("<b>{}</b>", "<i>{}</i>", '<a href="/x">{}</a>', "<em>{}</em>")).format(words[k])
        lead = self.r.choice(("", "", "", "<b>", "<br>"))
        end = "" if tag in ("p", "li") and self.r.random() < 0.15 else f"</{tag}>"
        return f"<{tag}{attributes}>{lead}{' '.join(words)}{end}"

    def junk(self, kind: str) -> str:
        r = self.r
        if kind in ("menu", "share"):
            items = [self.link(self.phrase(1, 3)) for _ in range(r.randint(2, 8))]
            inner = "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if r.random() < 0.7 else r.choice((" | ", " ", " · ")).join(items)
            if kind == "share" and r.random() < 0.5:
                inner = f"<span>{self.phrase(1, 3)}</span> <time>{r.randint(1, 28)}.{r.randint(1, 12)}.20{r.randint(10, 29)}</time>"
        elif kind == "form":
            inner = f'<label>{self.phrase(1, 3)}</label><input name="q"><p>{self.phrase(2, 8)}.</p><button>{self.phrase(1, 2)}</button>'
        elif kind == "comment":
            inner = f"<h3>{self.phrase(1, 2)}</h3>" + "".join(f"<{t}><b>{self.phrase(1, 2)}</b><p>{html.escape(self.prose())}</p></{t}>" for t in [r.choice(("li", "div", "article", "section"))] * r.randint(1, 4))
        elif kind == "footer":
            inner = r.choice((f"&copy; {self.phrase(1, 3)} &middot; {self.phrase(3, 9)}.", f"<p>&copy; 20{r.randint(10, 29)} {self.phrase(1, 4)}</p><p>{html.escape(self.prose())}</p>", f"<p>{self.phrase(3, 8)}.</p>" + self.link(self.phrase(1, 3))))
        elif kind == "side":
            inner = f"<h3>{self.phrase(1, 3)}</h3>" + "".join(f"<p>{self.link(self.phrase(2, 7)) if r.random() < 0.6 else html.escape(self.prose())}</p>" for _ in range(r.randint(1, 4)))
        elif kind == "header":
            inner = r.choice((f"<h1>{self.phrase(1, 3)}</h1>", f"<h2>{self.phrase(1, 3)}</h2>", "")) + f"<p>{self.phrase(2, 8)}</p>"
        else:
            inner = r.choice((self.phrase(3, 12) + ".", f"<p>{html.escape(self.prose())}</p>", f"<p>{self.phrase(2, 9)}.</p>" + self.link(self.phrase(1, 2))))
        tag = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind)
        if tag and r.random() < 0.6:
            return f"<{tag}{self.named(kind) if r.random() < 0.4 else ''}>{inner}</{tag}>"
        tag = r.choice(("div", "div", "section", "aside" if kind == "ad" else "div"))
        return f"<{tag}{self.named(kind)}>{inner}</{tag}>"

    def article(self) -> str:
        r = self.r
        parts = [self.emit("h1", self.phrase(2, 9))] if r.random() < 0.85 else []
        if parts and r.random() < 0.15:
            parts = [f"<header>{parts[0]}</header>"]
        for _ in range(r.randint(1, 12)):
            kind = r.random()
            if kind < 0.72:
                parts.append(self.emit("p", self.prose()))
            elif kind < 0.8:
                parts.append(self.emit(r.choice(("h2", "h3")), self.phrase(1, 6)))
            elif kind < 0.86:
                parts.append("<ul>" + "".join(self.emit("li", self.phrase(2, 9)) for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                parts.append("<blockquote>" + self.emit("p", self.prose()) + "</blockquote>")
            elif kind < 0.93:
                parts.append("<table><tr>" + "".join(self.emit("td", self.phrase(1, 4)) for _ in range(r.randint(2, 4))) + "</tr></table>")
            else:
                parts.append(self.junk(r.choice(("ad", "share", "side", "notice", "form", "menu"))))
        if r.random() < 0.2:
            parts.append(self.junk("comment"))
        inner = "".join(parts)
        kind = r.random()
        if kind < 0.5:
            return f"<article{self.attributes(r.choice(MAIN)) if r.random() < 0.3 else ''}>{inner}</article>"
        if kind < 0.65:
            return f"<main>{inner}</main>"
        if kind < 0.92:
            return f"<div{self.attributes(r.choice(MAIN))}>{inner}</div>"
        return inner

    def page(self) -> str:
        r = self.r
        before = [self.junk(k) for k in ("notice", "header", "menu", "ad", "form") if r.random() < 0.45]
        after = [self.junk(k) for k in ("share", "ad", "side", "comment", "form", "notice", "footer") if r.random() < 0.45]
        r.shuffle(before)
        body = "".join(before) + self.article() + "".join(after)
        if r.random() < 0.2:
            body = f"<div{self.attributes(r.choice(('page', 'wrapper', 'container', 'site')))}>{body}</div>"
        head = f"<head><title>{self.phrase(2, 8)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head>"
        end = "</body></html>" if r.random() < 0.85 else ""
        return f'<!DOCTYPE html><html lang="en">{head}<body>{body}{end}'


def labelled_pages(count: int = 1200, seed: int = 7) -> list[tuple[str, list[str]]]:
    """(page, texts of its main blocks), alike for a seed; texts that main text shares with the rest are few words."""
    made = []
    for k in range(count):
        maker = _Maker(seed * 100_003 + k)
        made.append((maker.page(), maker.main))
    return made
