"""Labelled pages for the extraction model, made from a seed.

Pages vary in layout, markup, names and order of their parts; every block of text carries its
label. Labels of inner nodes follow their blocks: a node is content if most of the text below
it is.
"""

from __future__ import annotations

import random

from .html import Node, block_text, parse

_MARK = "⁣"  # an invisible separator: marks content while a training page is parsed


def _words(rng: random.Random, low: int, high: int) -> str:
    parts = ["ka", "lo", "mi", "ren", "tos", "vel", "dar", "in", "po", "sun", "é", "ü", "gra", "fen"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
    return " ".join(made).capitalize()


def _sentences(rng: random.Random, low: int, high: int) -> str:
    return " ".join(_words(rng, 3, 14) + rng.choice([".", ".", ".", "!", "?"]) for _ in range(rng.randint(low, high)))


def _links(rng: random.Random, n: int) -> str:
    item = lambda: f'<li><a href="/{rng.randint(1, 99)}">{_words(rng, 1, 3)}</a></li>'
    return "<ul>" + "".join(item() for _ in range(n)) + "</ul>"


def _boiler(rng: random.Random) -> str:
    """One part of a page that is not content."""
    name = lambda *c: rng.choice(c)
    kind = rng.randrange(12)
    text = _sentences(rng, 1, 4)
    if kind == 0:
        return f"<nav>{_links(rng, rng.randint(2, 9))}</nav>"
    if kind == 1:
        return f'<div class="{name("ad", "ads", "advert", "banner", "promo", "sponsored")}">{text}</div>'
    if kind == 2:
        return f"<footer>&copy; {_words(rng, 1, 3)} &middot; {text}</footer>"
    if kind == 3:
        return f'<aside class="{name("sidebar", "related", "widget")}"><h3>{_words(rng, 1, 3)}</h3><p>{text}</p></aside>'
    if kind == 4:
        return f'<div id="{name("menu", "navigation", "navbar", "breadcrumbs")}">{_links(rng, rng.randint(2, 8))}</div>'
    if kind == 5:
        return f'<div class="{name("cookie-notice", "notice", "cookie-banner", "consent", "newsletter")}"><p>{text}</p><button>{_words(rng, 1, 2)}</button></div>'
    if kind == 6:
        return f'<form action="/s"><label>{_words(rng, 1, 3)}</label><input name="q"><p>{text}</p><button>{_words(rng, 1, 1)}</button></form>'
    if kind == 7:
        said = "".join(f'<{t} class="comment"><b>{_words(rng, 1, 2)}</b><p>{_sentences(rng, 1, 3)}</p></{t}>' for t in rng.choices(["div", "li", "article"], k=rng.randint(1, 5)))
        return f'<{(t := rng.choice(["section", "div"]))} {rng.choice(["class", "id"])}="{name("comments", "comment-list", "replies", "discussion")}"><h3>{_words(rng, 1, 2)}</h3>{said}</{t}>'
    if kind == 8:
        return f"<header><h2>{_words(rng, 1, 4)}</h2><p>{text}</p></header>"
    if kind == 9:
        return f'<div class="{name("footer", "site-footer", "page-footer")}"><p>{text}</p></div>'
    if kind == 10:
        return f'<div class="{name("share", "social", "subscribe", "signup", "login")}"><p>{text}</p></div>'
    return f'<script>var a="{text}";</script><style>p{{margin:0}}</style>'


def _content(rng: random.Random) -> str:
    """One block of content."""
    kind = rng.randrange(12)
    mark = lambda t: _MARK + t
    if kind == 0:
        return f"<h{(h := rng.randint(2, 4))}>{mark(_words(rng, 1, 6))}</h{h}>"
    if kind == 1:
        return "<ul>" + "".join(f"<li>{mark(_words(rng, 2, 14))}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
    if kind == 2:
        return f"<blockquote><p>{mark(_sentences(rng, 1, 3))}</p></blockquote>"
    if kind == 3:
        return f"<p><b>{mark(_words(rng, 1, 6))}.<br><p>{mark(_sentences(rng, 1, 4))}</p>"
    if kind == 4:
        return f"<pre>{mark(_words(rng, 2, 20))}</pre>"
    if kind == 5:
        return f'<p>{mark(_sentences(rng, 1, 2))} <a href="/x">{_words(rng, 1, 3)}</a> {_sentences(rng, 1, 2)}</p>'
    if kind == 6:
        return f"<table><tr><td>{mark(_words(rng, 1, 4))}</td><td>{mark(_words(rng, 1, 4))}</td></tr></table>"
    return f"<p>{mark(_sentences(rng, 1, 8) if rng.random() < 0.85 else _words(rng, 1, 4) + '.')}</p>"


def _page(rng: random.Random) -> str:
    body = "".join(_content(rng) for _ in range(rng.randint(1, 14)))
    if rng.random() < 0.8:
        body = f"<h1>{_MARK}{_words(rng, 2, 8)}</h1>" + body
    for _ in range(rng.choice([0, 0, 0, 1, 2])):  # parts that are not content inside the article
        body += _boiler(rng)
    wrap = rng.randrange(6)
    if wrap < 3:
        body = f"<article>{body}</article>"
    elif wrap == 3:
        body = f"<main>{body}</main>"
    elif wrap == 4:
        body = f'<div class="{rng.choice(["content", "post-body", "entry-content", "article-text", "story"])}">{body}</div>'
    else:
        body = f"<div><div>{body}</div></div>"
    before = "".join(_boiler(rng) for _ in range(rng.randint(0, 4)))
    after = "".join(_boiler(rng) for _ in range(rng.randint(0, 4)))
    page = f"<!DOCTYPE html><html><head><title>{_words(rng, 1, 5)}</title></head><body>{before}{body}{after}"
    return page + rng.choice(["</body></html>", "</body></html>", ""])


def labels_of(nodes: list[Node]) -> list[int]:
    """Content labels from the marks, which are taken out of the blocks."""
    own, weight, marked = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    for i, node in enumerate(nodes):
        if node.tag is None:
            own[i] = int(any(_MARK in p for p in node.parts))
            node.parts = [p.replace(_MARK, "") for p in node.parts]
            weight[i] = len(block_text(node))
            marked[i] = weight[i] * own[i]
    for i in range(len(nodes) - 1, 0, -1):
        weight[nodes[i].parent] += weight[i]
        marked[nodes[i].parent] += marked[i]
    return [own[i] if n.tag is None else int(2 * marked[i] > weight[i]) for i, n in enumerate(nodes)]


def labelled_page(seed: int) -> tuple[str, list[str]]:
    """A page and its blocks of content; seeds from 1,000,000 on are never trained on."""
    page = _page(random.Random(f"page {seed}"))
    blocks = [t for n in parse(page) if n.tag is None and any(_MARK in p for p in n.parts) and (t := block_text(n).replace(_MARK, "").strip())]
    return page.replace(_MARK, ""), blocks


def labelled_pages(n: int) -> list[tuple[list[Node], list[int]]]:
    out = []
    for seed in range(n):
        nodes = parse(_page(random.Random(f"page {seed}")))
        out.append((nodes, labels_of(nodes)))
    return out
