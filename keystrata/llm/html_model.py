"""The block classifier of main-text extraction, fitted on made-up pages whose article is known.

No table tells which text of a page is its article, so labelled pages are generated: an article of headings,
paragraphs, lists, quotes and tables in one of several wrappers, with boxes inside it and around it. Elements, class
words and the texts' shapes overlap on purpose (short paragraphs, long adverts, neutral classes), so that the classifier
gives odds and not certainties. Pages come from fixed seeds; the same weights are fitted wherever this runs.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np

#: Pages that the classifier is fitted on, and those on which the strength of smoothing is chosen.
FIT_PAGES, TUNE_PAGES = 500, 200
#: Ridge on the weights, and the most that a block's own evidence can be, in nats.
RIDGE, BOUND = 1.0, 6.0
#: Strengths of smoothing that are tried.
STRENGTHS = (0.0, 0.25, 0.5, 1.0, 1.5, 2.0, 3.0)

WRAPPERS = (
    ("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="story">', "</div>"), ('<div class="entry-body">', "</div>"),
    ("<div>", "</div>"), ('<div class="col-8">', "</div>"), ('<section class="wrap">', "</section>"), ('<main><article class="post">', "</article></main>"),
)
#: Attributes by which a box tells that it isn't the article's.
MARKS = ('role="navigation"', 'role="complementary"', 'role="banner"', "hidden", 'aria-hidden="true"', 'style="display:none"')
NEUTRAL = ("box", "col-4", "wrap", "unit", "b2", "inner", "row")
#: Class words of boxes, by what the box is.
BOXES = {
    "advert": ("ad", "advert", "sponsored", "promo", "banner"), "notice": ("cookie-notice", "consent", "alert", "notice"), "related": ("related", "recommended", "trending", "teaser"),
    "side": ("sidebar", "widget", "rail"), "share": ("share-links", "social", "follow"), "comments": ("comments", "comment-list", "replies", "discussion"), "path": ("breadcrumbs", "pagination", "tags"),
    "letter": ("newsletter", "subscribe", "signup"), "legal": ("copyright", "legal", "disclaimer"),
}


class Page:
    """A page and the texts of its article."""

    def __init__(self, seed: int):
        self.r, self.article, self.n = random.Random(seed), [], 0

    def words(self, low: int, high: int) -> str:
        letters = "abcdefghilmnoprstuv"
        out = ["".join(self.r.choices(letters, k=self.r.randint(1, 9))) + "," * (self.r.random() < 0.07) for _ in range(self.r.randint(low, high))]
        self.n += 1
        return f"{' '.join(out)} x{self.n}".capitalize()

    def sentences(self, low: int, high: int) -> str:
        return " ".join(f"{self.words(3, 18)}{self.r.choice('...!?')}" for _ in range(self.r.randint(low, high)))

    def said(self, text: str) -> str:
        self.article.append(text)
        return text

    def link(self, text: str) -> str:
        return f'<a href="/{self.r.randrange(999)}">{text}</a>'

    def box(self, kind: str) -> str:
        """A box of boilerplate; a third have a neutral class, so that only their text and place tell."""
        r = self.r
        name = r.choice(BOXES[kind]) if r.random() < 0.67 else r.choice(NEUTRAL)
        if r.random() < 0.15:
            name = f"{r.choice(['article', 'post', 'content', 'story'])}-{r.choice(BOXES[kind])}"
        if r.random() < 0.12:
            return f"<div {r.choice(MARKS)}><p>{self.sentences(1, 4)}</p><div>{self.words(2, 9)}</div></div>"
        tag = "aside" if kind in ("side", "related") and r.random() < 0.5 else "section" if kind == "comments" and r.random() < 0.5 else "div"
        if kind in ("share", "path"):
            body = "".join(f"<li>{self.link(self.words(1, 2))}</li>" for _ in range(r.randint(2, 6)))
            body = f"<ul>{body}</ul>"
        elif kind in ("related", "side"):
            body = f"<h3>{self.words(1, 2)}</h3>" + "".join(f"<p>{self.link(self.words(3, 9))}</p>" if r.random() < 0.7 else f"<p>{self.sentences(1, 2)}</p>" for _ in range(r.randint(1, 4)))
        elif kind == "comments":
            body = f"<h2>{self.words(1, 2)}</h2>" + "".join(f"<p>{self.sentences(1, 4)}</p>" for _ in range(r.randint(1, 5)))
        elif kind == "letter":
            return f'<form class="{name}"><label>{self.words(1, 2)}</label><input name=q><p>{self.sentences(1, 1)}</p><button>{self.words(1, 1)}</button></form>'
        else:
            body = self.sentences(1, 2) if r.random() < 0.5 else f"<p>{self.sentences(1, 2)}</p>"
        return f'<{tag} class="{name}">{body}</{tag}>'

    def part(self) -> str:
        """A part of the article."""
        r = self.r
        kind = r.random()
        if kind < 0.6:
            text = self.sentences(1, 6) if r.random() < 0.8 else self.words(1, 4) + r.choice([".", ":", ""])
            if r.random() < 0.2:
                more = self.words(1, 3)
                self.said(f"{text} {more}")
                return f"<p>{text} {self.link(more)}</p>"
            tag = "p" if r.random() < 0.85 else "div"
            return f"<{tag}>{self.said(text)}</{tag}>"
        if kind < 0.72:
            return f"<h{(k := r.randint(2, 4))}>{self.said(self.words(1, 7))}</h{k}>"
        if kind < 0.84:
            tag = r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{self.said(self.words(1, 14))}</li>" for _ in range(r.randint(2, 5))) + f"</{tag}>"
        if kind < 0.92:
            return f"<blockquote>{self.said(self.sentences(1, 2))}</blockquote>"
        rows = "".join(f"<tr><td>{self.said(self.words(1, 3))}</td><td>{self.said(self.words(1, 3))}</td></tr>" for _ in range(r.randint(1, 3)))
        return f"<table>{rows}</table>"

    def title(self) -> str:
        r = self.r
        text, kind = self.said(self.words(2, 9)), r.random()
        if kind < 0.15:
            return f"<header><h1>{text}</h1></header>"
        return f'<h1 class="{r.choice(["entry-header", "post-title", "banner-title"])}">{text}</h1>' if kind < 0.3 else f"<h1>{text}</h1>"

    def bare(self) -> str:
        """A page of the article alone: parts right in the body, or text without any elements."""
        r = self.r
        if r.random() < 0.5:
            return self.said(self.sentences(1, 8))
        return "<html><body>" + "".join(self.part() for _ in range(r.randint(1, 8)))

    def html(self) -> str:
        r = self.r
        if r.random() < 0.12:
            return self.bare()
        menu = "".join(f"<li>{self.link(self.words(1, 2))}</li>" for _ in range(r.randint(3, 7)))
        menu = f"<nav><ul>{menu}</ul></nav>" if r.random() < 0.7 else f'<div class="{r.choice(["menu", "navbar", "topbar", "row"])}"><ul>{menu}</ul></div>'
        top = f"<header><h1>{self.words(1, 3)}</h1>{menu}</header>" if r.random() < 0.5 else menu
        before = [self.box(r.choice(["advert", "notice", "path", "share"])) for _ in range(r.randint(0, 2))]
        opened, closed = r.choice(WRAPPERS)
        parts = [self.title() if r.random() < 0.85 else ""]
        for _ in range(r.randint(1, 12)):
            if r.random() < 0.1:
                parts.append(self.box(r.choice(["advert", "related", "share", "letter"])))
            parts.append(self.part())
        after = [self.box(r.choice(["comments", "related", "side", "advert", "letter", "share"])) for _ in range(r.randint(0, 4))]
        foot = f"{self.words(2, 6)}. {self.sentences(0, 2)}"
        foot = f"<footer>{'<p>' * (p := r.random() < 0.5)}&copy; {foot}{'</p>' * p}</footer>" if r.random() < 0.75 else f'<div class="{r.choice(["footer", "legal", "foot", "row"])}">&copy; {foot}</div>'
        return f"<html><head><title>{self.words(2, 5)}</title></head><body>{top}{''.join(before)}{opened}{''.join(parts)}{closed}{''.join(after)}{foot}</body></html>"


def labelled(seeds: range) -> list[tuple[list, np.ndarray]]:
    """For each page its blocks and which of them are the article's."""
    from keystrata.llm.html import blocks

    out = []
    for seed in seeds:
        page = Page(seed)
        found = blocks(page.html())
        texts = set(page.article)
        out.append((found, np.array([b.text in texts for b in found])))
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights by Newton's method; the last column is the constant and goes without a ridge."""
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@lru_cache(1)
def fitted() -> tuple[np.ndarray, float]:
    """The classifier's weights, and the strength of smoothing with the fewest wrong labels on pages not fitted on."""
    from keystrata.llm import html

    pages = labelled(range(FIT_PAGES))
    x = np.concatenate([html.features(found) for found, _ in pages if found])
    w = logistic(x, np.concatenate([y for found, y in pages if found]).astype(float))
    tune = labelled(range(FIT_PAGES, FIT_PAGES + TUNE_PAGES))
    wrong = [sum(int((np.array(html.labels(found, w, s)) != y).sum()) for found, y in tune) for s in STRENGTHS]
    return w, STRENGTHS[int(np.argmin(wrong))]
