"""HTML extraction by a linear-chain conditional random field over leaf blocks.

Each page is a chain of blocks, labelled as main text or not.  The field has
weights for features (ancestors, names, text, place) with each label and for
neighbouring labels; it is trained by gradient steps on the likelihood of
labelled pages, and the best labels of a page are found by Viterbi's algorithm.

The labelled pages are made by rule (``labelled_pages``): layouts of articles,
menus, headers, footers, sidebars, notices, adverts, forms and reader comments,
with invented words, so that their labels are known.  Some have no container around
the article, containers with invented names, names in other languages, lines parted
by br, or lists of links that belong to the article.

Defined cases: a null or empty page, or one without visible text, gives an empty
text; malformed markup is read as far as it goes; repeated rows give repeated
results; very long pages are read whole.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts
from .html_blocks import SIZE, blocks, features

PAGES, STEPS = 800, 60  # labelled pages; gradient steps


def labelled_pages(n: int = PAGES, seed: int = 11) -> list[tuple[str, set[str]]]:
    """(html, main blocks) of invented pages."""
    r = random.Random(seed)
    syllables = "ka lo mi ter an de su ri el no va shi pro en ta ge us ir ol ba qu zen".split()

    def word():
        return "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def phrase(a, b):
        return " ".join(word() for _ in range(r.randint(a, b)))

    def sentence(a=5, b=18):
        return phrase(a, b).capitalize() + r.choice("...!?")

    def passage():
        return " ".join(sentence() for _ in range(r.randint(1, 6)))

    def named(*names):
        return r.choice(["", "", f' class="{word()}"', *(f' class="{x}"' for x in names), *(f' id="{x}"' for x in names)])

    def name(*names):
        return r.choice([*names, *names, word()])

    def links(a, b):
        return [f'<a href="/{word()}">{phrase(1, 3)}</a>' for _ in range(r.randint(a, b))]

    def menu():
        items = "".join(f"<li>{x}</li>" for x in links(3, 9))
        return r.choice([f"<nav{named('menu', 'navbar', 'breadcrumb')}><ul>{items}</ul></nav>", f'<div class="{name("nav", "menu", "top-menu", "navigation", "hauptmenue", "navigation-principale", "navegacion")}"><ul>{items}</ul></div>', f"<nav>{' '.join(links(3, 8))}</nav>"])

    def aside():
        inner = r.choice([f"<h3>{phrase(1, 4)}</h3><ul>{''.join(f'<li>{x}</li>' for x in links(2, 6))}</ul>", f"<h4>{r.choice(['Related', 'Popular', 'Tags', phrase(1, 3)])}</h4><p>{passage()}</p>"])
        return r.choice([f"<aside{named('sidebar', 'related')}>{inner}</aside>", f'<div class="{r.choice(["sidebar", "widget", "related", "rail", "promo", "seitenleiste", "barra-lateral", "colonne"])}">{inner}</div>'])

    def advert():
        return f'<{(t := r.choice(["div", "div", "section", "aside"]))} class="{r.choice(["ad", "ads", "advert", "advertisement", "sponsored", "banner", "ad-slot", "promo", "anzeige", "werbung", "publicidad", "publicite"])}">{r.choice([sentence(), passage(), phrase(2, 6)])}</{t}>'

    def notice():
        return f'<div {r.choice(["class", "id"])}="{r.choice(["cookie", "cookie-notice", "consent", "notice", "gdpr", "popup", "modal", "alert", "newsletter", "subscribe"])}">{r.choice(["", "<p>"])}{r.choice(["We use cookies. ", "Accept our policy. ", "Subscribe to the newsletter. ", ""])}{passage()}{r.choice(["", "<button>OK</button>"])}</div>'

    def form():
        return f"<form{named('search', 'login', 'signup')}><label>{phrase(1, 3)}</label><input name=q><p>{sentence()}</p><button>{phrase(1, 2)}</button></form>"

    def comments():
        kind = r.choice(["comments", "comment-list", "responses", "discussion", "replies", "reader-comments", "kommentare", "commentaires", "comentarios"])
        one = lambda: f'<{(t := r.choice(["div", "li", "article"]))} class="{r.choice(["comment", "reply", "response"])}"><b>{phrase(1, 2)}</b><p>{passage()}</p></{t}>'
        return f'<{(t := r.choice(["section", "div", "ol"]))} {r.choice(["class", "id"])}="{kind}"><h3>{r.choice(["Comments", phrase(1, 2)])}</h3>{"".join(one() for _ in range(r.randint(1, 5)))}</{t}>'

    def footer():
        inner = r.choice(["&copy; ", "© ", ""]) + phrase(1, 3) + r.choice([" &middot; ", " | ", " "]) + r.choice([sentence(), passage(), " ".join(links(2, 5))])
        return r.choice([f"<footer{named('footer', 'site-footer')}>{inner}</footer>", f'<div {r.choice(["class", "id"])}="{r.choice(["footer", "copyright", "bottom", "legal", "fusszeile", "pied-de-page", "pie"])}"><p>{inner}</p></div>'])

    def header():
        return r.choice([f"<header{named('site-header', 'masthead')}><div>{phrase(1, 4)}</div><p>{sentence()}</p></header>", f'<div class="{r.choice(["header", "topbar", "masthead", "kopfzeile", "entete", "cabecera"])}"><span>{phrase(1, 4)}</span></div>'])

    out = []
    for _ in range(n):
        main: set[str] = set()

        def keep(html, main=main):
            main.update(b[0] for b in blocks(html))
            return html

        body = []
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            p = passage()
            if r.random() < 0.15:
                p = sentence()
            elif r.random() < 0.08:
                p = p.replace(" ", " | ") + r.choice(["", " |"])
            if kind < 0.7:
                p = r.choice([p, p, f"<b>{p}", f"<em>{phrase(1, 3)}</em> {p}", f"{p} <a href=x>{phrase(1, 3)}</a> {sentence()}", p + "<br>", f"{p}<br>{sentence()}"])
                body.append(keep(f"<p>{p}</p>"))
            elif kind < 0.78:
                body.append(keep(f"<h{(h := r.randint(2, 4))}>{phrase(1, 8)}</h{h}>"))
            elif kind < 0.85:
                body.append(keep(f"<{(t := r.choice(['ul', 'ol']))}>{''.join(f'<li>{r.choice([phrase(1, 8), sentence()])}</li>' for _ in range(r.randint(2, 5)))}</{t}>"))
            elif kind < 0.9:
                body.append(keep(f"<blockquote>{r.choice(['', '<p>'])}{p}</blockquote>"))
            elif kind < 0.93:
                body.append(keep(f"<pre>{p}</pre>"))
            elif kind < 0.95:
                body.append(keep(f"<div>{p}</div>"))
            elif kind < 0.965:
                body.append(keep(f"<{(t := r.choice(['ul', 'ol']))}>{''.join(f'<li>{x}</li>' for x in links(3, 30))}</{t}>"))
            else:
                body.append(r.choice([advert, aside, notice, form])())
        title = keep(f"<h1{named('title', 'headline')}>{r.choice([phrase(2, 12).capitalize(), sentence()])}</h1>")
        middle = r.choice([title, title, f"<header>{title}</header>"]) + "".join(body)
        tag, names = r.choice([("article", ("post", "entry")), ("article", ()), ("article", ("story",)), ("main", ("content",)), ("div", ("content", "article-body", "post-content", "main", "entry-content", "story", "inhalt", "beitrag", "contenu", "contenido", word())), ("", ())])
        attr = named(*names) if names and tag != "div" else f' class="{r.choice(names)}"' if names else ""
        kind = r.random()
        if kind < 0.06:  # paragraphs alone, or lines in the container
            middle = keep("".join(f"<p>{passage()}</p>" for _ in range(r.randint(1, 5))))
        elif kind < 0.14 and tag:
            line = r.choice([sentence, passage, lambda: phrase(1, 5)])
            middle = keep(r.choice(["", f"<h2>{phrase(1, 6)}</h2>"]) + "<br>".join(line() for _ in range(r.randint(2, 6))))
        remarks = comments() if r.random() < 0.1 else ""
        middle = f"<{tag}{attr}>{middle}{remarks}</{tag}>" if tag else middle
        before = [f() for f in (header, menu, notice, advert, form) if r.random() < 0.45]
        after = [f() for f in (advert, aside, comments, menu, notice, form, footer) if r.random() < 0.4]
        if r.random() < 0.3:
            before.append(aside())
        if kind < 0.14 and r.random() < 0.4:  # the article is all
            before, after = [], []
        r.shuffle(before)
        head = f"<head><title>{phrase(2, 6)}</title><style>p{{x:y}}</style><script>var t='</p>';</script></head>"
        out.append((f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{middle}{''.join(after)}{r.choice(['</body></html>', ''])}", main))
    return out


class Field:
    """Weights of the conditional random field: features by label, label pairs, first and last label."""

    def __init__(self):
        self.w, self.pair = np.zeros((SIZE, 2)), np.zeros((2, 2))

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.w[x].sum(0) for x in rows])

    def marginals(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chances of each block's label, and the expected label pairs, by forward and backward sums."""
        n = len(s)
        a, b = np.zeros((n, 2)), np.zeros((n, 2))
        a[0] = s[0]
        for i in range(1, n):
            a[i] = s[i] + np.logaddexp(a[i - 1, 0] + self.pair[0], a[i - 1, 1] + self.pair[1])
        for i in range(n - 2, -1, -1):
            t = self.pair + (s[i + 1] + b[i + 1])
            b[i] = np.logaddexp(t[:, 0], t[:, 1])
        z = np.logaddexp(*a[-1])
        both = a[:-1, :, None] + self.pair + (s[1:] + b[1:])[:, None, :] - z
        return np.exp(a + b - z), np.exp(both).sum(0)

    def best(self, rows: list[np.ndarray]) -> np.ndarray:
        """The most likely labels, by Viterbi's algorithm."""
        s = self.scores(rows)
        n = len(s)
        back = np.zeros((n, 2), np.int64)
        at = s[0]
        for i in range(1, n):
            t = at[:, None] + self.pair
            back[i] = t.argmax(0)
            at = t.max(0) + s[i]
        y = np.zeros(n, np.int64)
        y[-1] = at.argmax()
        for i in range(n - 1, 0, -1):
            y[i - 1] = back[i, y[i]]
        return y


def fit(pages: list[tuple[list[np.ndarray], np.ndarray]], steps: int = STEPS) -> Field:
    """Gradient steps of adapted sizes on the likelihood of the labels, with a small quadratic penalty."""
    field = Field()
    square, pair_square = np.full((SIZE, 2), 1e-8), np.full((2, 2), 1e-8)
    order = np.random.default_rng(5)
    for _ in range(steps // 10):
        for lo in np.array_split(order.permutation(len(pages)), max(1, len(pages) // 20)):
            g, gp = -1e-3 * field.w, -1e-3 * field.pair
            for i in lo:
                rows, y = pages[i]
                p, pairs = field.marginals(field.scores(rows))
                target = np.eye(2)[y]
                for x, d in zip(rows, target - p):
                    g[x] += d
                gp -= pairs
                np.add.at(gp, (y[:-1], y[1:]), 1)
            square += g * g
            pair_square += gp * gp
            field.w += 0.3 * g / np.sqrt(square)
            field.pair += 0.3 * gp / np.sqrt(pair_square)
    return field


@lru_cache(1)
def model() -> Field:
    pages = []
    for html, main in labelled_pages():
        found = blocks(html)
        if found:
            pages.append((features(found), np.array([int(b[0] in main) for b in found])))
    return fit(pages)


def main_text(html: str, field: Field) -> str:
    found = blocks(html)
    if not found:
        return ""
    return "\n\n".join(b[0] for b, y in zip(found, field.best(features(found))) if y)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    held = pages.sparkSession.sparkContext.broadcast(model())

    def run(batches):
        for batch in batches:
            out = [main_text(x.as_py(), held.value) for x in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return plain.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
