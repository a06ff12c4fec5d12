"""Labelled training pages for the block tagger, made from templates with a fixed seed.

A page is a list of (html, blocks) pieces, where blocks are the texts of its leaf blocks in order and
whether each belongs to the article. Words are made up, so the tagger learns from markup and shape.
"""

from __future__ import annotations

import random

SYLLABLES = "an er tion re the of in ou lich keit eau ment ción que os ar é è ü ñ st ble ha".split()
ARTICLE = (("article", ""), ("main", ""), ("div", "content"), ("div", "post-content"), ("div", "entry"), ("div", "article-body"), ("section", "story"), ("div", "main-text"), ("article", "post"), ("div", ""))
MENU = (("nav", ""), ("nav", "menu"), ("div", "navbar"), ("ul", "menu"), ("div", "breadcrumb"), ("div", "nav"))
HEADER = (("header", ""), ("div", "header"), ("div", "site-header"), ("header", "top"))
FOOTER = (("footer", ""), ("div", "footer"), ("footer", "site-footer"), ("div", "bottom copyright"))
SIDE = (("aside", ""), ("div", "sidebar"), ("aside", "sidebar"), ("div", "related"), ("div", "widget"), ("section", "recommended"), ("div", "share social"))
ADVERT = (("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "banner"), ("div", "promo"), ("aside", "sponsored"), ("section", "advertisement"), ("p", "ad"))
NOTICE = (("div", "cookie-notice"), ("div", "notice"), ("div", "cookie banner"), ("div", "alert"), ("div", "consent"), ("div", "newsletter subscribe"), ("div", "popup modal"))
COMMENTS = (("section", "comments"), ("div", "comments"), ("div", "comment-list"), ("ol", "commentlist"), ("div", "discussion comments"))
FORM = ("search", "login", "newsletter", "")


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def text(self, lo: int, hi: int) -> str:
        words = [self.word() for _ in range(self.r.randint(lo, hi))]
        if self.r.random() < 0.08:  # noisy articles are articles too
            words = [w + self.r.choice(("***", "###", "!!", "%%%", " |")) for w in words]
        if self.r.random() < 0.05:
            words = [w.upper() for w in words]
        return " ".join(words).capitalize() + self.r.choice((".", ".", ".", "", "?", ":"))

    def wrap(self, kind: tuple[str, str], inner: str) -> str:
        tag, name = kind
        attr = f' {self.r.choice(("class", "class", "id"))}="{name}"' if name else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    def links(self, n: int) -> tuple[str, list]:
        texts = [self.text(1, 3) for _ in range(n)]
        item = self.r.choice(("<li><a href='/x'>{}</a></li>", "<div><a href='/x'>{}</a></div>", "<p><a href=/x>{}</a></p>"))
        return "".join(item.format(t) for t in texts), [(t, 0) for t in texts]

    def plain(self, lo: int, hi: int, n: int = 1) -> tuple[str, list]:
        texts = [self.text(lo, hi) for _ in range(n)]
        return "".join(self.r.choice(("<p>{}</p>", "<div>{}</div>", "<p>{}</p>")).format(t) for t in texts), [(t, 0) for t in texts]

    def boiler(self, kinds, body: tuple[str, list]) -> tuple[str, list]:
        return self.wrap(self.r.choice(kinds), body[0]), body[1]

    def advert(self) -> tuple[str, list]:
        t = self.text(3, 25)
        return self.wrap(self.r.choice(ADVERT), t), [(t, 0)]

    def article(self) -> tuple[str, list]:
        html, blocks = [], []

        def add(form: str, *texts: str):
            html.append(form.format(*texts))
            blocks.extend((t, 1) for t in texts)

        add("<h1>{}</h1>", self.text(2, 12))
        if self.r.random() < 0.4:
            add("<p><b>{}<br>", self.text(2, 60))
        for _ in range(self.r.randint(0, 9)):
            kind = self.r.random()
            if kind < 0.66:
                add(self.r.choice(("<p>{}</p>", "<p>{}", "<div>{}</div>", "<p>{} </p>")), self.text(1, 90))
            elif kind < 0.72:
                add("<h2>{}</h2>", self.text(1, 8))
            elif kind < 0.78:
                texts = [self.text(1, 15) for _ in range(self.r.randint(1, 4))]
                add("<ul>" + "<li>{}</li>" * len(texts) + "</ul>", *texts)
            elif kind < 0.83:
                add("<blockquote>{}</blockquote>", self.text(5, 40))
            elif kind < 0.88:
                texts = [self.text(1, 5) for _ in range(4)]
                add("<table><tr><td>{}</td><td>{}</td></tr><tr><td>{}</td><td>{}</td></tr></table>", *texts)
            elif kind < 0.92:
                add("<figure><img src=x><figcaption>{}</figcaption></figure>", self.text(2, 15))
            else:
                ad = self.advert() if self.r.random() < 0.6 else self.boiler(SIDE + NOTICE, self.links(2))
                html.append(ad[0])
                blocks.extend(ad[1])
        if self.r.random() < 0.15:
            more = self.comments()
            html.append(more[0])
            blocks.extend(more[1])
        return self.wrap(self.r.choice(ARTICLE), "".join(html)), blocks

    def comments(self) -> tuple[str, list]:
        texts = [self.text(3, 50) for _ in range(self.r.randint(1, 5))]
        one = self.r.choice(("<div class='comment'><p>{}</p></div>", "<li>{}</li>", "<p>{}</p>", "<article class=comment><p>{}</p></article>"))
        return self.wrap(self.r.choice(COMMENTS), "".join(one.format(t) for t in texts)), [(t, 0) for t in texts]

    def form(self) -> tuple[str, list]:
        t, u = self.text(1, 5), self.text(1, 2)
        return f"<form class='{self.r.choice(FORM)}'><p>{t}</p><input name=q><button>{u}</button></form>", [(t, 0), (u, 0)]

    def named(self, stems: str) -> str:
        """A class or id with one of the stems in it, or one that says nothing."""
        r = self.r
        stem = r.choice(stems.split())
        form = r.choice(("{}", "{}", "{}-wrap", "site-{}", "{}Box", "js-{}", "{}_1", "page{}", "{}-container", "c-{}__inner", "the-{}"))
        return f'{r.choice(("class", "class", "id"))}="{form.format(stem)}"' if r.random() < 0.8 else r.choice(("", f'class="x{r.randint(1, 99)}"', f'class="{self.word()}"'))

    def part(self, stems: str, body: tuple[str, list], tags: str = "div") -> tuple[str, list]:
        tag = self.r.choice(tags.split())
        return f"<{tag} {self.named(stems)}>{body[0]}</{tag}>", body[1]

    def row(self) -> tuple[str, list]:
        """Links in a row, in one block."""
        mark = self.r.choice((" ", " | ", " · ", "<br>", " › "))
        texts = [self.text(1, 2).rstrip(".?:") for _ in range(self.r.randint(2, 6))]
        shown = " ".join(mark.replace("<br>", " ").join(texts).split())
        return mark.join(f"<a href=/x>{t}</a>" for t in texts), [(shown, 0)]

    def inset(self) -> tuple[str, list]:
        """What stands between an article's paragraphs and is none."""
        kind = self.r.random()
        if kind < 0.35:
            return self.part("ad advert ad-slot ad-container sponsored promo", self.plain(2, 16))
        if kind < 0.6:
            t, u, v = self.text(2, 14), self.text(1, 2), self.text(1, 2)
            form = self.r.choice((f"<p>{t}</p><form><input name=m><button>{u}</button></form>", f"<form><p>{t}</p><button>{u}</button></form>"))
            return self.part("newsletter newsletter-signup subscribe signup", (form, [(t, 0), (u, 0)]))
        if kind < 0.8:
            return self.part("share share-tools social tools meta", self.row())
        return self.part("related more-on-this recommended read-next", self.links(self.r.randint(1, 3)))

    def prose(self) -> tuple[str, list]:
        """Paragraphs as plain pages have them: long ones, and short ones between and after them."""
        r, html, blocks = self.r, [], []
        if r.random() < 0.8:
            t = self.text(2, 10)
            html.append(f"<h1>{t}</h1>")
            blocks.append((t, 1))
        tag = r.choice(("p", "p", "p", "div"))
        for _ in range(r.randint(2, 8)):
            t = ", ".join(self.text(2, 14).rstrip(".?:") for _ in range(r.randint(1, 6))) + "." if r.random() < 0.75 else self.text(1, 8)
            if r.random() < 0.2:
                t2 = self.text(1, 3)
                html.append(f"<{tag}>{t} <a href=/y>{t2}</a></{tag}>")
                t = f"{t} {t2}"
            else:
                html.append(f"<{tag}>{t}</{tag}>")
            blocks.append((t, 1))
            if r.random() < 0.1:
                more = self.inset()
                html.append(more[0])
                blocks.extend(more[1])
            if r.random() < 0.12:
                h = self.text(1, 6)
                html.append(f"<h2>{h}</h2>")
                blocks.append((h, 1))
        if r.random() < 0.5:
            t = self.text(1, 5)
            html.append(f"<{tag}>{t}</{tag}>")
            blocks.append((t, 1))
        return "".join(html), blocks

    def said(self) -> tuple[str, list]:
        one = self.r.choice(("<p>{}</p>", "<div class=c><p>{}</p></div>", "<li>{}</li>", "<div><b>{}</b></div>"))
        texts = [self.text(2, 45) for _ in range(self.r.randint(1, 4))]
        return "".join(one.format(t) for t in texts), [(t, 0) for t in texts]

    def wild(self) -> tuple[str, list]:
        """A page whose elements say little or other things than page() has them say: bare bodies, tables, columns, overlays, threads."""
        r, before, after = self.r, [], []
        body = self.prose()
        if r.random() < 0.75:
            before.append(self.part("nav menu topbar links tabs header masthead breadcrumbs", self.links(r.randint(2, 9)) if r.random() < 0.6 else self.row(), "div ul td nav"))
        if r.random() < 0.35:
            notice, button = self.plain(6, 60, r.randint(1, 2)), self.text(1, 2)
            if r.random() < 0.5:
                notice = (f"{notice[0]}<button>{button}</button>", [*notice[1], (button, 0)])
            (before if r.random() < 0.5 else after).append(self.part("gdpr cookie cookieConsent consent privacy overlay popup modal cc-window notice", notice))
        if r.random() < 0.3:
            (before if r.random() < 0.4 else after).append(self.part("rail sidebar side-col aside right-col col-right widget related more recommended", self.links(r.randint(2, 7)) if r.random() < 0.6 else self.plain(2, 20, 3), "div aside section"))
        if r.random() < 0.45:
            after.append(self.part("disqus_thread disqus disqus_thread disqus-embed comments comment-list replies responses discussion reader-comments", self.said(), "div section ul ol"))
        if r.random() < 0.25:
            (before if r.random() < 0.5 else after).append(self.part("advert ad-slot sponsor promo banner", self.plain(2, 20)))
        if r.random() < 0.7:
            t = r.choice(("&copy; ", "Copyright ", "")) + self.text(2, 14)
            after.append((f"<{(tag := r.choice(('footer', 'div', 'p', 'td')))} {self.named('footer foot bottom colophon legal')}>{t}</{tag}>", [(t.replace("&copy;", "©"), 0)]))
        r.shuffle(after)
        blocks = [b for p in before for b in p[1]] + body[1] + [b for p in after for b in p[1]]
        if r.random() < 0.25:  # a table holds the columns
            cell = lambda p: f"<td>{p[0]}</td>"
            html = "<table><tr>" + "".join(map(cell, before)) + f"<td valign=top>{body[0]}</td>" + "".join(map(cell, after)) + "</tr></table>"
        else:
            held = r.choice(("{}", "{}", "<main>{}</main>", "<article>{}</article>", "<div>{}</div>", "<div " + self.named("content article post story entry main body text mw-parser") + ">{}</div>"))
            html = "".join(p[0] for p in before) + held.format(body[0]) + "".join(p[0] for p in after)
        return f"<html><head><title>x</title></head><body>{html}</body></html>", blocks

    def page(self) -> tuple[str, list]:
        r, parts = self.r, []
        if r.random() < 0.5:
            parts.append(self.boiler(HEADER, self.plain(1, 6)))
        if r.random() < 0.85:
            parts.append(self.boiler(MENU, self.links(r.randint(2, 8))))
        for chance, make in ((0.5, self.advert), (0.3, lambda: self.boiler(NOTICE, self.plain(3, 25))), (0.2, self.form), (0.2, lambda: self.boiler(SIDE, self.links(3)))):
            if r.random() < chance:
                parts.append(make())
        parts.append(self.article())
        for chance, make in ((0.35, self.comments), (0.4, lambda: self.boiler(SIDE, self.links(r.randint(2, 6)))), (0.25, lambda: self.boiler(SIDE, self.plain(5, 40, 2))), (0.25, self.advert), (0.15, self.form)):
            if r.random() < chance:
                parts.append(make())
        if r.random() < 0.9:
            t = ("&copy; " if r.random() < 0.6 else "") + self.text(2, 20)
            parts.append((self.wrap(r.choice(FOOTER), t), [(t.replace("&copy;", "©"), 0)]))
        html = "<html><head><title>x</title><style>p{}</style></head><body>" + "".join(p[0] for p in parts) + "</body></html>"
        return html, [b for p in parts for b in p[1]]


def labelled_pages(n: int = 500, wild: int = 700, seed: int = 11) -> list[tuple[str, list[tuple[str, int]]]]:
    maker = Maker(seed)
    return [maker.page() for _ in range(n)] + [maker.wild() for _ in range(wild)]
