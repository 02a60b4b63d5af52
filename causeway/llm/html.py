"""Main text of web pages with a tree-structured graphical model.

A page becomes a tree of DOM nodes. Every node carries a binary label (content or not), a
unary potential from its own features, and a parent-child potential that depends on the
child's kind. Sum-product messages go up the tree and down again, which gives exact content
marginals; blocks whose marginal exceeds one half are the text. The potentials are trained to
the maximum likelihood of labelled pages (``html_training``): the gradient is what the labels
hold less what the marginals, of nodes and of links, expect. Training is on the driver, from
a fixed and bounded number of pages (``TRAINING_PAGES``).

Defined cases: null or empty html gives the empty text; text outside any tag is a block of
its own; unclosed and misnested tags are closed by their parents; comments, scripts, styles,
templates and form controls never hold text; a marginal of exactly one half is no content;
repeated rows are extracted each; pages of any length are read whole; an empty table gives no
rows; other columns pass through, but for one with the name of the output column.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

TRAINING_PAGES = 240

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title textarea select option button iframe object svg canvas math audio video datalist".split())
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
ENDS_P = BLOCK - frozenset("body html li dd dt td th tr tbody thead tfoot caption".split())
SIBLING_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = frozenset("table td th ul ol dl button object body html".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none", re.I)
_PART = re.compile(r"[a-z]+")

#: Words in class, id and role names that speak for or against content.
GOOD_NAMES = frozenset("article body content entry main post story text page prose copy chapter".split())
BAD_NAMES = frozenset(
    "ad ads advert advertisement adverts banner bar breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie cookies disqus footer form gdpr header login masthead menu meta modal nav navigation navbar newsletter notice pager pagination popup promo promoted related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget widgets".split()
)
COMMENT_NAMES = frozenset("comment comments disqus replies reply respond discussion".split())

GROUPS = {
    "article": "article main",
    "aside": "aside nav footer header menu dialog",
    "form": "form fieldset label legend",
    "heading": "h1 h2 h3 h4 h5 h6",
    "para": "p blockquote pre",
    "list": "ul ol dl li dt dd",
    "table": "table tbody thead tr td th caption",
    "box": "div section center details summary figure figcaption address",
    "root": "html body",
}
GROUP_OF = {tag: g for g, tags in GROUPS.items() for tag in tags.split()}
KINDS = [*GROUPS, "inline", "block_text"]
FEATURES = ["bias", "good_name", "bad_name", "comment_name", "link_share", "short", "long", "stops", "article_above", "aside_above", "aside_tag", "footer_text", *[f"kind_{k}" for k in KINDS]]
F_AT = {name: i for i, name in enumerate(FEATURES)}


class Node:
    """An element, or a block of text (tag None)."""

    __slots__ = ("tag", "parent", "kids", "names", "parts", "linked", "label")

    def __init__(self, tag: str | None, parent: int, names: frozenset[str] = frozenset(), label: int = -1):
        self.tag, self.parent, self.names, self.label = tag, parent, names, label
        self.parts: list[str] = []
        self.linked = 0


def parse(page: str) -> list[Node]:
    """Block-level elements and their blocks of text, parents before children.

    Inline elements only add to the text around them; a block of text ends where a block
    element begins or ends.
    """
    nodes = [Node("html", -1)]
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements; inline ones share their block's node
    current: Node | None = None  # the open block of text
    silent = links = 0
    at, size = 0, len(page)

    def text(piece: str) -> None:
        nonlocal current
        if silent or not piece:
            return
        if current is None:
            if piece.isspace():
                return
            current = Node(None, stack[-1][1])
            nodes.append(current)
        current.parts.append(piece)
        if links:
            current.linked += len(piece)

    def close(depth: int) -> None:
        nonlocal current, silent, links
        while len(stack) > depth:
            tag, _ = stack.pop()
            if tag in BLOCK:
                current = None
            if tag in SILENT:
                silent -= 1
            if tag == "a":
                links -= 1

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
                if tag == "p" and stack[depth][0] in SCOPE:
                    break
            continue
        if tag in ("html", "body") and any(t == tag for t, _ in stack):
            continue
        if tag in VOID:
            if tag in BLOCK:
                current = None
            else:
                text(" ")
            continue
        if tag in ENDS_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    close(depth)
                    break
                if stack[depth][0] in BLOCK:
                    break
        ended = SIBLING_ENDS.get(tag)
        if ended:
            depth, cut = len(stack) - 1, None
            while depth > 0 and (stack[depth][0] not in SCOPE or stack[depth][0] in ended):
                if stack[depth][0] in ended:
                    cut = depth
                depth -= 1
            if cut is not None:
                close(cut)
        attrs = m.group(3)
        if attrs.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag == "body":
            close(1)  # an unclosed head ends here
        node = stack[-1][1]
        if tag in BLOCK:
            current = None
            names = frozenset()
            if attrs:
                found = " ".join("".join(x[1:]) for x in _ATTR.findall(attrs)).lower()
                names = frozenset(_PART.findall(found))
                if _HIDDEN.search(attrs):
                    names |= {"popup"}
            nodes.append(Node(tag, node, names))
            node = len(nodes) - 1
        stack.append((tag, node))
        if tag in SILENT:
            silent += 1
        if tag == "a":
            links += 1
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            close(len(stack) - 1)
    if at < size:
        text(page[at:])
    return nodes


def block_text(node: Node) -> str:
    raw = "".join(node.parts)
    if "&" in raw:
        raw = entities.unescape(raw)
    return " ".join(raw.split())


def features(nodes: list[Node], texts: list[str | None]) -> tuple[np.ndarray, list[int]]:
    """Feature matrix [nodes, features] and the kind of every node."""
    x = np.zeros((len(nodes), len(FEATURES)))
    kinds, above = [], []
    for i, node in enumerate(nodes):
        up_article, up_aside = above[node.parent] if node.parent >= 0 else (0, 0)
        group = GROUP_OF.get(node.tag, "inline") if node.tag else "block_text"
        row = x[i]
        row[0] = 1
        good, bad = bool(node.names & GOOD_NAMES), bool(node.names & BAD_NAMES)
        if good and not bad:
            row[F_AT["good_name"]] = 1
        if bad:
            row[F_AT["bad_name"]] = 1
        if node.names & COMMENT_NAMES:
            row[F_AT["comment_name"]] = 1
        if node.tag is None:
            text = texts[i]
            n = max(1, len(text))
            row[F_AT["link_share"]] = min(1.0, node.linked / max(1, sum(map(len, node.parts))))
            row[F_AT["short"]] = n < 25
            row[F_AT["long"]] = min(1.0, n / 400)
            row[F_AT["stops"]] = text.endswith((".", "!", "?", "…", '"'))
            row[F_AT["footer_text"]] = text.startswith("©")
        row[F_AT["article_above"]] = up_article
        row[F_AT["aside_above"]] = up_aside
        aside = group in ("aside", "form") or bad
        row[F_AT["aside_tag"]] = aside
        row[F_AT["kind_" + group]] = 1
        kinds.append(KINDS.index(group))
        above.append((int(up_article or group == "article"), int(up_aside or aside)))
    return x, kinds


def marginals(unary: list[float], parents: list[int], pair: list[float]) -> list[float]:
    """P(content) of every node by sum-product on the tree.

    ``unary``: log odds of each node alone; ``pair``: coupling of each node to its parent,
    +J if the labels agree and -J if not. Messages are log odds: first from the leaves up,
    then from the root down.
    """
    n = len(unary)
    up, total = [0.0] * n, list(unary)

    def through(log_odds: float, j: float) -> float:
        a, b = j + log_odds, -j
        c, d = -j + log_odds, j
        hi, lo = (a, b) if a > b else (b, a)
        top = hi + math.log1p(math.exp(lo - hi))
        hi, lo = (c, d) if c > d else (d, c)
        return top - hi - math.log1p(math.exp(lo - hi))

    for i in range(n - 1, 0, -1):  # children come after their parents
        up[i] = through(total[i], pair[i])
        total[parents[i]] += up[i]
    for i in range(1, n):
        total[i] += through(total[parents[i]] - up[i], pair[i])
    return [1 / (1 + math.exp(-max(-500.0, min(500.0, t)))) for t in total]


class Model:
    def __init__(self, weights: np.ndarray, couplings: np.ndarray):
        self.weights, self.couplings = weights, couplings

    def contents(self, nodes: list[Node]) -> list[str]:
        """The blocks of text that are content, in page order."""
        texts = [block_text(n) if n.tag is None else None for n in nodes]
        x, kinds = features(nodes, texts)
        unary = (x @ self.weights).tolist()
        pair = self.couplings[kinds].tolist()
        p = marginals(unary, [n.parent for n in nodes], pair)
        return [t for t, q in zip(texts, p, strict=True) if t and q > 0.5]

    def extract(self, page: str | None) -> str:
        return "\n\n".join(self.contents(parse(page))) if page else ""


def _through(log_odds: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.logaddexp(j + log_odds, -j) - np.logaddexp(-j + log_odds, j)


def forest_marginals(unary: np.ndarray, parents: np.ndarray, levels: list[np.ndarray], pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(content) of every node of many trees, and P(same label as the parent); sum-product level by level.

    ``parents`` is -1 for roots; ``levels`` lists the nodes of every depth.
    """
    total, up, down = unary.copy(), np.zeros_like(unary), np.zeros_like(unary)
    for own in reversed(levels[1:]):
        up[own] = _through(total[own], pair[own])
        np.add.at(total, parents[own], up[own])
    for own in levels[1:]:
        down[own] = _through(total[parents[own]] - up[own], pair[own])
        total[own] += down[own]
    linked = parents >= 0
    a, b = total - down, np.where(linked, total[np.maximum(parents, 0)] - up, 0)
    same, other = pair + np.logaddexp(0, a + b), -pair + np.logaddexp(a, b)
    logistic = lambda t: 1 / (1 + np.exp(-np.clip(t, -500, 500)))
    return logistic(total), np.where(linked, logistic(same - other), 0.0)


def train(labelled: list[tuple[list[Node], list[int]]], rounds: int = 400, decay: float = 1e-3) -> Model:
    """Maximum likelihood by gradient ascent; all pages are one forest."""
    xs, ys, ks, ps, ds, base = [], [], [], [], [], 0
    for nodes, labels in labelled:
        x, kinds = features(nodes, [block_text(n) if n.tag is None else None for n in nodes])
        depth: list[int] = []
        for n in nodes:
            depth.append(depth[n.parent] + 1 if n.parent >= 0 else 0)
        xs.append(x)
        ys += labels
        ks += kinds
        ds += depth
        ps += [base + n.parent if n.parent >= 0 else -1 for n in nodes]
        base += len(nodes)
    x, y, kinds, parents, depth = np.concatenate(xs), np.asarray(ys, float), np.asarray(ks), np.asarray(ps), np.asarray(ds)
    levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)]
    linked = parents >= 0
    agree = np.where(linked, y == y[np.maximum(parents, 0)], 0.0)
    weights, couplings = np.zeros(x.shape[1]), np.zeros(len(KINDS))
    fast_w, fast_c = np.zeros_like(weights), np.zeros_like(couplings)
    for _ in range(rounds):
        p, same = forest_marginals(x @ weights, parents, levels, couplings[kinds])
        fast_w = 0.9 * fast_w + x.T @ (y - p) / len(y) - decay * weights
        fast_c = 0.9 * fast_c + np.bincount(kinds, 2 * (agree - same), len(KINDS)) / len(y) - decay * couplings
        weights += 0.5 * fast_w
        couplings = np.maximum(couplings + 0.5 * fast_c, 0)  # links only ever attract
    return Model(weights, couplings)


_MODELS: dict[int, Model] = {}


def default_model(pages: int = TRAINING_PAGES) -> Model:
    """The model trained on the first ``pages`` labelled pages; the same in every run."""
    if pages not in _MODELS:
        from .html_training import labelled_pages

        _MODELS[pages] = train(labelled_pages(pages))
    return _MODELS[pages]


def extract_main_text(pages: DataFrame, html_col: str = "html", out_col: str = "main_text", model: Model | None = None) -> DataFrame:
    """``pages`` without ``html_col`` and with the main text in ``out_col``."""
    trained = pages.sparkSession.sparkContext.broadcast(model or default_model())  # some fifty numbers
    rest = [f for f in pages.schema.fields if f.name not in (html_col, out_col)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[f.name for f in rest]].assign(**{out_col: [trained.value.extract(h) for h in pdf[html_col]]})

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], f"`{out_col}` string"])
    return pages.select(*[f"`{f.name}`" for f in rest], f"`{html_col}`").mapInPandas(run, schema)
