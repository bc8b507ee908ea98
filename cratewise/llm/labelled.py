"""Labelled pages that the extraction field is trained on.

Pages are composed from layouts that are common on the web: an article in one of several containers,
with menus, headers, footers, sidebars, notices, adverts, forms and reader comments around and inside
it. The label of every leaf block follows from the piece that it belongs to; words are made up, so
only structure and form can be learned.
"""

from __future__ import annotations

import random

Piece = tuple[str, list[bool]]
SYLLABLES = "an ber ci dor el fa gue hin is jo ka lem mo na ou pe qui ra sol ti un ver wa xi yo zu é ña ö ç".split()
# Names that sites give to their parts: class, id or role words.
MENUS = ["nav", "menu", "navbar", "main-menu", "topnav", "breadcrumb", "breadcrumbs", "pagination", "pager", "tabs", "toc-menu", "site-navigation"]
HEADS = ["header", "site-header", "masthead", "topbar", "banner", "branding", "page-header", "logo"]
FEET = ["footer", "site-footer", "colophon", "copyright", "bottom", "page-footer", "legal"]
SIDES = ["sidebar", "side", "related", "related-posts", "widget", "recommended", "more-stories", "popular", "tags", "tag-list", "archive", "trending", "complementary"]
NOTICES = ["cookie", "cookie-notice", "consent", "gdpr", "notice", "alert", "notification", "popup", "modal", "overlay", "warning", "disclaimer", "announcement", "message"]
ADVERTS = ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "ad-slot", "adbox", "banner-ad", "commercial"]
FORMS = ["form", "search", "search-form", "newsletter", "subscribe", "signup", "login", "contact-form", "register"]
COMMENTS = ["comment", "comments", "comment-list", "responses", "replies", "discussion", "reviews", "disqus", "user-comments", "reader-comments", "respond"]
SHARES = ["share", "social", "share-buttons", "follow", "sharing", "social-links"]
BODIES = ["content", "post", "entry", "article", "main", "entry-content", "post-body", "article-body", "story", "text", "page-content", "main-content"]
#: Words of these names as ``dom`` reads them; other names tell nothing.
TELLING = frozenset(
    w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w
    for names in (MENUS, HEADS, FEET, SIDES, NOTICES, ADVERTS, FORMS, COMMENTS, SHARES, BODIES, ["reply", "response", "wrapper", "dialog"])
    for name in names
    for w in name.split("-")
)


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 3))) for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(2, 18).capitalize() + self.r.choice([".", ".", ".", "!", "?"]) for _ in range(self.r.randint(low, high)))

    def named(self, tag: str, names: list[str], inner: str) -> str:
        name = self.r.choice(names)
        where = self.r.choice(["class", "class", "id"])
        other = f"{self.r.choice(['c', 'x', 'col', 'box'])}-{self.r.randint(1, 9)}"
        return f'<{tag} {where}="{self.r.choice([name, name + " " + other, other + " " + name])}">{inner}</{tag}>'

    def unnamed(self, tag: str, inner: str) -> str:
        """An element without a name, or with one that tells nothing."""
        r = self.r
        name = r.choice(["", "", f"css-{r.randint(1, 99)}", f"sc-{r.choice('abcdk')}{r.randint(1, 99)}", f"{r.choice('qrxyz')}{r.randint(1, 9)}", "root", "wrap", "inner", "row"])
        return f'<{tag} {r.choice(["class", "class", "id"])}="{name}">{inner}</{tag}>' if name else f"<{tag}>{inner}</{tag}>"

    def link(self, text: str) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{text}</a>'

    # --- main text ---

    def paragraph(self) -> Piece:
        text = self.r.choice([self.sentences(1, 6), self.sentences(1, 6), self.words(1, 4) + ".", self.words(3, 60)])
        form = self.r.randint(0, 9)
        if form == 0:
            text = f"<b>{text}<br>"
            return f"<p>{text}", [True]
        if form == 1:
            text = f"{text} {self.link(self.words(1, 3))} {self.words(2, 8)}."
        elif form == 2:
            text = f"<em>{self.words(1, 3)}</em> {text} &amp; {self.words(1, 3)}"
        return f"<p>{text}</p>", [True]

    def body(self) -> Piece:
        kind = self.r.randint(0, 11)
        if kind == 0:
            return f"<h{self.r.choice('23')}>{self.words(1, 8)}</h2>", [True]
        if kind == 1:
            n = self.r.randint(2, 5)
            return f"<ul>{''.join(f'<li>{self.words(1, 14)}</li>' for _ in range(n))}</ul>", [True] * n
        if kind == 2:
            return f"<blockquote><p>{self.sentences(1, 3)}</p></blockquote>", [True]
        if kind == 3:
            n = self.r.randint(2, 4)
            return f"<table>{''.join(f'<tr><td>{self.words(1, 3)}</td><td>{self.r.randint(1, 99)}</td></tr>' for _ in range(n))}</table>", [True] * 2 * n
        if kind == 4:
            return f"<pre>{self.words(3, 30)}</pre>", [True]
        if kind == 5:
            return f"<figure><img src='x.png'><figcaption>{self.words(3, 12)}.</figcaption></figure>", [True]
        return self.paragraph()

    # --- everything else ---

    def menu(self) -> Piece:
        n = self.r.randint(1, 8)
        items = [self.link(self.words(1, 2) + self.r.choice(["", "", ",", "."])) for _ in range(n)]
        inner = f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>"
        return (f"<nav>{inner}</nav>" if self.r.random() < 0.5 else self.named("div", MENUS, inner)), [False] * n

    def head(self) -> Piece:
        inner = f"<h{self.r.choice('123')}>{self.words(1, 4)}</h1><p>{self.words(2, 9)}</p>"
        return (f"<header>{inner}</header>" if self.r.random() < 0.5 else self.named("div", HEADS, inner)), [False] * 2

    def foot(self) -> Piece:
        text = f"&copy; {self.r.choice(['2021', 'www.' + self.words(1, 1) + '.example.com'])} &middot; {self.r.choice([self.sentences(1, 3), self.words(2, 9)])}"
        more = f"<p>{self.link('Privacy')} {self.link('Terms of use')}</p>" if self.r.random() < 0.5 else ""
        plain = self.r.random() < 0.3
        inner = (self.sentences(1, 3) if plain else text) + more
        return (f"<footer>{inner}</footer>" if self.r.random() < 0.6 else self.named("div", FEET, inner)), [False] * (2 if more else 1)

    def side(self) -> Piece:
        n = self.r.randint(1, 4)
        inner = f"<h3>{self.words(1, 3)}</h3>" + "".join(f"<p>{self.r.choice([self.link(self.words(3, 8)), self.sentences(1, 4)])}</p>" for _ in range(n))
        form = self.r.randint(0, 2)
        return (f"<aside>{inner}</aside>" if form == 0 else self.named("aside" if form == 1 else self.r.choice(["div", "section"]), SIDES, inner)), [False] * (n + 1)

    def notice(self) -> Piece:
        text = self.r.choice(["We use cookies. ", "", ""]) + self.sentences(1, 4)
        button = "<button>OK</button>" if self.r.random() < 0.5 else ""
        if self.r.random() < 0.2:
            return f'<div role="{self.r.choice(["alert", "dialog"])}">{text}{button}</div>', [False] * (2 if button else 1)
        return self.named(self.r.choice(["div", "div", "section", "p"]), NOTICES, text + button), [False] * (2 if button else 1)

    def advert(self) -> Piece:
        text = self.r.choice([self.sentences(1, 4), self.words(1, 9), self.link(self.words(2, 9))])
        if self.r.random() < 0.5:
            return self.named(self.r.choice(["div", "div", "aside", "section"]), ADVERTS, text), [False]
        return self.named("div", ADVERTS, f"<p>{text}</p>"), [False]

    def form(self) -> Piece:
        inner = f"<label>{self.words(1, 3)}</label><input name='q'><button>{self.words(1, 2)}</button>"
        if self.r.random() < 0.5:
            return f"<form><p>{self.sentences(1, 2)}</p>{inner}</form>", [False] * 3
        return self.named("div", FORMS, f"<form>{inner}</form>"), [False] * 2

    def share(self) -> Piece:
        n = self.r.randint(1, 3)
        return self.named("div", SHARES, "".join(f"<p>{self.link(self.words(1, 2))}</p>" for _ in range(n))), [False] * n

    def comments(self) -> Piece:
        out, labels = "", []
        if self.r.random() < 0.6:
            out, labels = f"<h{self.r.choice('23')}>{self.r.choice(['Comments', self.words(1, 3)])}</h3>", [False]
        item = self.r.choice(["div", "li", "article"])
        for _ in range(self.r.randint(1, 4)):
            author = f"<span>{self.words(1, 2)}</span>" if self.r.random() < 0.5 else f"<h4>{self.words(1, 2)}</h4>"
            out += self.named(item, ["comment", "reply", "comment-body", "response"], f"{author}<p>{self.sentences(1, 5)}</p>")
            labels += [False, False]
        if item == "li":
            out = f"<ol>{out}</ol>"
        return self.named(self.r.choice(["section", "div"]), COMMENTS, out), labels

    def plain_menu(self) -> Piece:
        """Links in a row or in elements of their own, as themes without telling names have them."""
        n = self.r.randint(1, 6)
        items = [self.link(self.r.choice(["Home", "About", "News", "Contact", self.words(1, 2)])) for _ in range(n)]
        if self.r.random() < 0.5:
            return self.unnamed("div", " ".join(items)), [False]
        return self.unnamed("div", "".join(self.unnamed(self.r.choice(["div", "p"]), x) for x in items)), [False] * n

    def plain_foot(self) -> Piece:
        text = self.r.choice([f"&copy; 2021 {self.words(1, 3)}", f"Copyright {self.words(1, 3)}. All rights reserved.", f"{self.link('Privacy')} {self.link('Terms of use')}"])
        return self.unnamed(self.r.choice(["div", "p"]), text), [False]

    def bare_page(self) -> tuple[str, list[bool]]:
        """A page whose article stands in no telling container; what is around it is told by links and phrases."""
        r = self.r
        if r.random() < 0.25:  # text with line breaks instead of paragraphs
            inner = "<br><br>".join(self.sentences(1, 4) for _ in range(r.randint(2, 6)))
            labels = [True]
            if r.random() < 0.6:
                inner, labels = f"<h1>{self.words(2, 9)}</h1>{inner}", [True, True]
        else:
            text: list[Piece] = [(f"<h1>{self.words(2, 12)}</h1>", [True])] if r.random() < 0.85 else [self.paragraph()]
            text += [self.body() if r.random() < 0.6 else self.paragraph() for _ in range(r.choice([1, 2, 3, 4, 8]))]
            inner, labels = "".join(p for p, _ in text), [x for _, own in text for x in own]
        before = [f() for f in (self.plain_menu, self.menu, self.head, self.plain_menu) if r.random() < 0.45]
        after = [f() for f in (self.plain_menu, self.comments, self.side, self.foot, self.plain_foot) if r.random() < 0.35]
        form = r.randint(0, 5)
        if form == 0 or r.random() < 0.15:  # a layout table
            n = r.randint(1, 4)
            cells = "".join(f"<td>{self.link(r.choice(['Home', 'News', 'About', self.words(1, 2)]))}</td>" for _ in range(n))
            return self._whole([(f"<table><tr>{cells}</tr><tr><td>{inner}</td></tr></table>", [False] * n + labels), *after])
        if form <= 2:
            inner = self.unnamed("div", inner)
        elif form == 3:
            inner = self.unnamed("div", self.unnamed("div", inner))
        pieces = [*before, (inner, labels), *after]
        if r.random() < 0.4:
            return self._whole([(self.unnamed("div", "".join(p for p, _ in pieces)), [x for _, own in pieces for x in own])])
        return self._whole(pieces)

    @staticmethod
    def _whole(pieces: list[Piece]) -> tuple[str, list[bool]]:
        top = "<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>"
        return top + "".join(p for p, _ in pieces) + "</body></html>", [x for _, own in pieces for x in own]

    def page(self) -> tuple[str, list[bool]]:
        r = self.r
        title = f"<h1>{self.words(2, 12)}</h1>"
        text: list[Piece] = [(title, [True])] if r.random() < 0.8 else [self.paragraph()]
        text += [self.body() for _ in range(r.choice([0, 1, 2, 4, 8, 12]))]
        for make in (self.advert, self.share, self.notice, self.comments, self.form, self.side):
            if r.random() < 0.12:
                text.insert(r.randint(1, len(text)), make())
        if r.random() < 0.25:  # what a footer or a notice would say, said by the article
            said = r.choice(["All rights reserved.", "Copyright 2021.", "We use cookies.", "Subscribe to our newsletter.", "Share this.", "Privacy.", "Advertisement.", "Leave a comment."])
            text.insert(r.randint(1, len(text)), (f"<p>{said}</p>", [True]))
        if text[0][0] == title and r.random() < 0.15:
            line = f"<p>{self.words(2, 6)}</p>" if r.random() < 0.5 else ""
            text[0] = (f"<header>{title}{line}</header>", [True] * (2 if line else 1))
        inner, labels = "".join(p for p, _ in text), [x for _, own in text for x in own]
        form = r.randint(0, 5)
        if form <= 2:
            main = f"<article>{inner}</article>"
        elif form == 3:
            main = f"<main>{inner}</main>"
        else:
            main = self.named(r.choice(["div", "section"]), BODIES, inner)
        before = [f() for f in (self.head, self.menu, self.notice, self.advert, self.form, self.menu) if r.random() < 0.4]
        after = [f() for f in (self.share, self.comments, self.side, self.side, self.advert, self.form, self.notice, self.foot) if r.random() < 0.4]
        r.shuffle(before)
        wrap = r.random() < 0.3
        whole = [*before, ("<div class='wrapper'>" if wrap else "", []), (main, labels), *after, ("</div>" if wrap else "", [])]
        html = "".join(p for p, _ in whole)
        top = "<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var t='</p>';</script></head><body><!-- x -->"
        return top + html + "</body></html>", [x for _, own in whole for x in own]


def labelled_pages(n: int = 1000, seed: int = 11) -> list[tuple[str, list[bool]]]:
    """``n`` pages with the label of each of their blocks: main text or not."""
    maker = _Maker(seed)
    return [maker.bare_page() if i % 5 in (1, 3) else maker.page() for i in range(n)]
