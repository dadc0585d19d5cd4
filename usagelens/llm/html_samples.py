"""Labelled web pages to train the block labeller on: random layouts, names and texts.

Every part of a page carries its role in ``data-mark``, which nothing but the training reads.
Layouts vary in elements, class names, nesting, order and in what is left open; texts are
invented words in part, so that neither names nor words alone tell the role.
"""

from __future__ import annotations

import random

ROLES = ["article", "menu", "header", "footer", "sidebar", "notice", "advert", "form", "comments"]

# Words that pages of several languages use around their articles.
_PHRASES = {
    "menu": "Home|About us|Contact|News|Products|Blog|Archive|Login|Sign up|Services|FAQ|Start|Über uns|Kontakt|Accueil|"
    "Inicio|Noticias|Impressum|Next page|Previous|1|2|3|»|Sitemap|Shop|Forum|Categories|Skip to content|Menu",
    "header": "Welcome to our site|The daily review|Your source for news|Willkommen|Bienvenue|Since 1998|Logo|Search",
    "footer": "© 2021 All rights reserved.|Copyright 2019 Example Inc.|Privacy policy|Terms of use|Imprint|Powered by Press|"
    "Tous droits réservés|Alle Rechte vorbehalten|Contact us|Follow us on social media|Made with care|Back to top",
    "sidebar": "Related articles|Popular posts|Recent comments|Archives|Tags|About the author|Most read|You may also like|"
    "Newsletter|Follow us|Auch interessant|Articles similaires|Share this|Tweet|Read more|Categories|Top stories",
    "notice": "We use cookies to improve your experience.|Accept all|This site uses cookies. Learn more|Please enable JavaScript.|"
    "Subscribe to continue reading|You have 3 free articles left|Cookie settings|Nous utilisons des cookies|"
    "Diese Website verwendet Cookies|Sign in to read the full story|Your browser is out of date.|Warning: old version",
    "advert": "Advertisement|Sponsored|Buy now|Limited offer: save 50 % today|Anzeige|Publicité|Shop the sale|Free shipping|"
    "Click here|Promoted content|Best prices|Order today|Win a prize",
    "form": "Name|E-mail|Your message|Send|Submit|Search|Password|Remember me|Choose a country|I agree to the terms|Log in|"
    "Germany|France|Spain|Subscribe|Your e-mail address|Absenden|Envoyer|Phone (optional)|Required field",
    "comments": "Reply|3 comments|Leave a comment|Anonymous said:|Posted by guest on May 3|Great post, thanks!|I disagree with this.|"
    "Comments|Kommentare|Report|2 hours ago|Like|Thank you for sharing|First!|Show replies",
}
# Names that pages give to such parts.
_NAMES = {
    "article": "content main article post entry story body text post-body entry-content article-body page main-content "
    "articleText postContent blog-post story-body hentry mainContent",
    "menu": "nav menu navbar navigation main-menu breadcrumb breadcrumbs pagination topnav links toc tabs subnav pager mainMenu",
    "header": "header masthead top site-header banner branding logo page-header title-bar siteHeader hero",
    "footer": "footer bottom site-footer copyright colophon page-footer legal foot credits siteFooter",
    "sidebar": "sidebar side aside related widget widgets rail secondary popular recommended author-bio share social tags sideBar "
    "see-also more-stories",
    "notice": "notice cookie cookie-banner cookies consent gdpr alert warning popup modal overlay paywall message toast "
    "subscribe-wall cookieNotice announcement",
    "advert": "ad ads advert advertisement sponsor sponsored promo banner-ad adsense ad-slot dfp promotion adBox commercial teaser-ad adsbygoogle google-ads",
    "form": "form search search-form login login-form contact signup newsletter subscribe register contactForm input-group",
    "comments": "comments comment comment-list discussion disqus respond replies commentlist reader-comments thread guestbook "
    "commentSection user-comments feedback",
}
_ELEMENTS = {
    "article": "article article article main div div div section td",
    "menu": "nav nav nav div ul menu",
    "header": "header header div div",
    "footer": "footer footer footer div",
    "sidebar": "aside aside div div section td",
    "notice": "div div section p noscript dialog aside",
    "advert": "div div div aside section p ins",
    "form": "form form form div fieldset",
    "comments": "section div div ol ul aside",
}
_LETTERS = ["aeiounrstlhd", "eaisntrulodmé", "enisratdhulüßä", "eaosnridltcuñó", "абвеиклмнорст"]


class Sampler:
    """Makes pages; the same seed gives the same pages."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)

    def word(self) -> str:
        rng = self.rng
        return "".join(rng.choice(self.letters) for _ in range(min(12, 1 + int(rng.expovariate(0.25)))))

    def prose(self, words: int) -> str:
        rng, out = self.rng, []
        while words > 0:
            n = min(words, rng.randint(1, 22))
            words -= n
            sentence = [self.word() for _ in range(n)]
            sentence = [w + ("," if rng.random() < 0.07 else "") + self.noise for w in sentence]
            out.append(" ".join(sentence).capitalize() + rng.choice(["."] * 8 + ["!", "?", ":"]))
        text = " ".join(out)
        if rng.random() < 0.1:
            text = text.replace(" ", " &amp; ", 1)
        return text

    def odd(self) -> str:
        """What articles hold besides sentences: bare words, tables, numbers, addresses, repetition."""
        rng, w = self.rng, self.word
        kind = rng.randrange(9)
        if kind == 0:
            return " ".join(w() for _ in range(rng.randint(1, 3)))
        if kind == 1:
            return "| " + " | ".join(w() for _ in range(rng.randint(1, 4))) + " |"
        if kind == 2:
            return " ".join([w()] * rng.randint(2, 200)).capitalize()
        if kind == 3:
            return " ".join(str(rng.randrange(10 ** rng.randint(1, 9))) for _ in range(rng.randint(1, 9)))
        if kind == 4:
            return f"{self.prose(rng.randint(1, 9))} {w()}@{w()}.example.com {rng.randint(100, 999)}-{rng.randint(1000, 9999)}"
        if kind == 5:
            return f"{w()} = {w()}_{w()}('{w()}');"
        if kind == 6:
            return self.prose(rng.randint(1, 30)).upper()
        if kind == 7:
            return rng.choice(_PHRASES[rng.choice(list(_PHRASES))].split("|")) + " " + self.prose(rng.randint(1, 40))
        return "".join(rng.choice("!?#%*~-=<>") for _ in range(rng.randint(1, 40))).replace("<", "&lt;")

    def length(self) -> int:
        rng = self.rng
        return rng.choice([1, 2, rng.randint(3, 12), rng.randint(10, 60), rng.randint(30, 150)])

    def said(self, role: str) -> str:
        """A short text of this part: a phrase of the web, or words without meaning."""
        rng = self.rng
        if rng.random() < self.plain:
            text = rng.choice(_PHRASES[role].split("|"))
            return text if rng.random() < 0.7 else f"{text} {self.word()}"
        return self.prose(rng.choice([1, 1, 2, 3, rng.randint(4, 25)]))

    def name(self, role: str) -> str:
        """Attributes: a usual name, none, or one that says nothing."""
        rng, kind = self.rng, self.rng.random()
        if kind < 0.62:
            name = rng.choice(_NAMES[role].split())
            if rng.random() < 0.25:
                name += rng.choice([" clearfix", " row", "-1", " col-md-8", "_x7"])
            return f' {rng.choice(["class", "class", "id"])}="{name}"'
        if kind < 0.66:
            return f' class="{self.word()}-{rng.randint(1, 99)}"'
        return ""

    def element(self, role: str) -> str:
        return self.rng.choice(_ELEMENTS[role].split())

    def part(self, role: str, inner: str) -> str:
        """A container of one role. A plain one without any name gets one."""
        name = self.element(role)
        if name == "td" and role != "article" and self.rng.random() < 0.7:
            name = "div"
        if name in ("p", "ins") and any(f"<{x}" in inner for x in ("p", "div", "ul", "h", "button", "article")):
            name = "div"  # a paragraph holds no blocks
        attrs = self.name(role)
        if name in ("div", "td", "section", "p", "ul", "ol", "ins", "dialog", "fieldset") and "=" not in attrs:
            attrs = f' class="{self.rng.choice(_NAMES[role].split())}"'
        if name == "ins":
            attrs = f' class="{self.rng.choice(_NAMES[role].split())}"'
        if role == "notice" and self.rng.random() < 0.15:
            attrs += ' style="display:none"'
        wrap = inner
        if name not in ("p", "ins") and self.rng.random() < 0.3:
            wrap = f"<div{self.rng.choice(['', ' class=inner', ' class=container'])}>{inner}</div>"
        if name == "td":
            return f'<table><tr><td{attrs} data-mark="{role}">{wrap}</td></tr></table>'
        return f'<{name}{attrs} data-mark="{role}">{wrap}</{name}>'

    def link(self, text: str) -> str:
        return f'<a href="/{self.word()}">{text}</a>'

    def linked_list(self, role: str) -> str:
        rng = self.rng
        items = [self.link(self.said(role)) for _ in range(rng.randint(2, 9))]
        kind = rng.random()
        if kind < 0.65:
            return "<ul>" + "".join(f"<li>{x}" + rng.choice(["</li>", "</li>", ""]) for x in items) + "</ul>"
        if kind < 0.8:
            return rng.choice([" | ", " ", " &gt; ", "\n"]).join(items)
        return "".join(f"<div>{x}</div>" for x in items)

    def body(self, role: str) -> str:
        """What such a part holds: a text, paragraphs, headings with prose, links. An advert, a notice
        or a comment may read like an article, only its place and names tell."""
        rng, kind = self.rng, self.rng.random()
        if kind < 0.3:
            return self.said(role)
        if kind < 0.5:
            return f"<p>{self.said(role)}</p>"
        if kind < 0.6:
            return self.linked_list(role)
        inner = ""
        if rng.random() < 0.6:
            h = rng.choice(["h1", "h2", "h2", "h3", "h3", "h4", "p", "div"])
            inner = f"<{h}>{self.said(role)}</{h}>"
        for _ in range(rng.randint(1, 3)):
            text = self.said(role) if rng.random() < 0.3 else self.prose(self.length())
            inner += rng.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<div>{text}</div>", f"<p>{text} {self.link(self.word())}</p>"])
        if rng.random() < 0.2:
            inner += f"<button>{self.said(role)}</button>"
        return inner

    def menu(self) -> str:
        return self.part("menu", self.linked_list("menu"))

    def header(self) -> str:
        rng = self.rng
        inner = f"<h1>{self.said('header')}</h1>" if rng.random() < 0.4 else ""
        inner += self.body("header")
        if rng.random() < 0.3:
            inner += self.menu()
        return self.part("header", inner)

    def footer(self) -> str:
        rng = self.rng
        inner = self.body("footer")
        if rng.random() < 0.5:
            inner = f"&copy; {self.word()}.example.net &middot; {self.said('footer')}" + inner
        if rng.random() < 0.2:
            inner += self.menu()
        return self.part("footer", inner)

    def sidebar(self) -> str:
        rng = self.rng
        if rng.random() < 0.5:
            return self.part("sidebar", self.body("sidebar"))
        h = rng.choice(["h3", "h4", "h2", "p", "strong"])
        return self.part("sidebar", f"<{h}>{self.said('sidebar')}</{h}>{self.linked_list('sidebar')}")

    def notice(self) -> str:
        return self.part("notice", self.body("notice"))

    def advert(self) -> str:
        out = self.part("advert", self.body("advert"))
        return f"<!-- ad {self.rng.randint(0, 999)} -->{out}" if self.rng.random() < 0.3 else out

    def form(self) -> str:
        rng = self.rng
        inner = self.body("form") if rng.random() < 0.3 else ""
        for _ in range(rng.randint(1, 4)):
            inner += rng.choice(
                [
                    f"<label>{self.said('form')} <input type=text></label>",
                    f"<p>{self.said('form')}: <input name=q></p>",
                    f"<textarea>{self.said('form')}</textarea>",
                    f"<select><option>{self.said('form')}<option>{self.said('form')}</select>",
                    f"<h3>{self.said('form')}</h3>",
                ]
            )
        return self.part("form", inner + f"<button type=submit>{self.said('form')}</button>")

    def comments(self) -> str:
        rng = self.rng
        inner = f"<h3>{self.said('comments')}</h3>" if rng.random() < 0.6 else ""
        item = rng.choice(["li", "div", "div", "article", "p"])
        for _ in range(rng.randint(1, 5)):
            text = self.said("comments") if rng.random() < 0.4 else self.prose(rng.randint(2, 60))
            own = f"<b>{self.word()}</b> {text}" if rng.random() < 0.4 else text
            if item != "p":
                own = f"<div>{self.word()} {rng.randint(1, 28)}/{rng.randint(1, 12)}</div><p>{own}</p>" if rng.random() < 0.5 else own
            named = rng.choice(["", "", ' class="comment"', ' class="reply"', ' id="c12"'])
            inner += f"<{item}{named}>{own}</{item}>"
        if rng.random() < 0.3:
            inner += f"<form><textarea>{self.said('form')}</textarea><button>{self.said('form')}</button></form>"
        return self.part("comments", inner)

    def paragraph(self) -> str:
        rng = self.rng
        text = self.odd() if rng.random() < self.oddness else self.prose(self.length())
        if rng.random() < 0.15:
            text = f"<b>{text}" + rng.choice(["</b>", "<br>", ""])
        if rng.random() < 0.15:
            text += " " + self.link(self.prose(rng.randint(1, 4)))
        if rng.random() < 0.08:
            text = f"<em>{text}</em>"
        return f"<p>{text}" + rng.choice(["</p>", "</p>", "</p>", ""])

    def article(self) -> str:
        rng = self.rng
        out = []
        if rng.random() < 0.8:
            head = f"<h1>{self.odd() if rng.random() < 0.2 else self.prose(rng.randint(1, 12))}</h1>"
            out.append(f"<header>{head}</header>" if rng.random() < 0.12 else head)
        many = rng.choice([1, 2, rng.randint(3, 10), rng.randint(5, 25), rng.randint(1, 60)])
        inside = [self.advert, self.sidebar, self.form, self.notice]
        for _ in range(many):
            kind = rng.random()
            if kind < 0.78:
                out.append(self.paragraph())
            elif kind < 0.84:
                out.append(f"<h2>{self.prose(rng.randint(1, 8))}</h2>")
            elif kind < 0.88:
                out.append("<ul>" + "".join(f"<li>{self.prose(self.length())}</li>" for _ in range(rng.randint(1, 6))) + "</ul>")
            elif kind < 0.91:
                out.append(f"<blockquote><p>{self.prose(self.length())}</p></blockquote>")
            elif kind < 0.93:
                cells = "".join(f"<td>{self.prose(rng.randint(1, 3))}</td>" for _ in range(3))
                out.append(f"<table><tr>{cells}</tr><tr>{cells}</tr></table>")
            elif kind < 0.95:
                out.append(f"<figure><img src=x><figcaption>{self.prose(rng.randint(2, 9))}</figcaption></figure>")
            elif kind < 0.96:
                out.append(f"<pre>{self.prose(self.length())}</pre>")
            elif kind < 0.98:
                out.append(f"<div>{self.prose(self.length())}</div>")
            else:
                out.append(rng.choice(inside)())
        if rng.random() < 0.4:
            for _ in range(rng.randint(1, 2)):
                out.insert(rng.randint(1, len(out)), rng.choice(inside)())
        if rng.random() < 0.2:
            out.append(rng.choice([self.comments, self.sidebar, self.form, self.advert])())
        return self.part("article", "".join(out))

    def page(self) -> str:
        rng = self.rng
        self.letters = rng.choice(_LETTERS)
        self.plain = rng.choice([0.0, 0.3, 0.8, 1.0])
        self.oddness = rng.choice([0.0, 0.05, 0.3])
        self.noise = rng.choice([""] * 6 + ["$$$", "%%%"])
        before = [f for f, p in ((self.notice, 0.25), (self.header, 0.5), (self.menu, 0.7), (self.form, 0.15), (self.advert, 0.4)) if rng.random() < p]
        after = [f for f, p in ((self.comments, 0.35), (self.sidebar, 0.4), (self.form, 0.2), (self.advert, 0.2), (self.menu, 0.15)) if rng.random() < p]
        if rng.random() < 0.2:
            rng.shuffle(before)
        if rng.random() < 0.3:
            rng.shuffle(after)
        side = self.sidebar() if rng.random() < 0.15 else ""
        body = "".join(f() for f in before) + side + self.article() + "".join(f() for f in after)
        if rng.random() < 0.3:
            body = f"<div{rng.choice(['', ' id=wrapper', ' class=page', ' class=container'])}>{body}</div>"
        if rng.random() < 0.85:
            body += self.footer()
        if rng.random() < 0.15:
            body += self.notice()
        head = f"<!DOCTYPE html><html><head><title>{self.prose(4)}</title><script>var a='</p>';</script></head>"
        return head + f"<body>{body}" + rng.choice(["</body></html>", ""])


def pages(number: int, seed: int) -> list[str]:
    sampler = Sampler(seed)
    return [sampler.page() for _ in range(number)]
