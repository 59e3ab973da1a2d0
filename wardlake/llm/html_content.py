"""Main text of web pages by a tree-structured graphical model over the DOM.

A page is parsed into a tree of elements. Every element has a hidden label, content or not; its own
features (tag, words of its class, id and role, text length, share of link text, depth and place)
give a unary potential, and a pairwise potential ties it to its parent. Sum-product messages go up
from the leaves and down from the root and leave every element's exact marginal. A block of text is
kept if the marginal of the element it belongs to is at least one half.

Unary weights and the pairwise table are fitted by maximum likelihood on labelled pages; the
gradient is observed less expected counts, the latter from the same messages. ``labelled_pages``
makes labelled pages of many layouts by rule; own ones can be given to ``train``.

Pages are independent rows: parsing, inference and output are one map over the table. Some pages at a
time are one forest for the messages; memory is bounded by these.

Defined cases: null or empty html, and pages without content, give the empty text; unclosed and
misnested tags are repaired as browsers do for paragraphs, lists and tables; rows with equal ids
are extracted each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
HIDDEN = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "head", "template",
          "noscript", "select", "option", "button", "svg", "math", "object", "canvas", "datalist"}
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre"
    " search section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "head", "legend",
                    "summary"} | {"hr"}
_INLINE = {"a", "b", "i", "em", "strong", "span", "code"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S
)
# One attribute, name and optional value: values are passed over whole, names are compared whole.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?|=\S*|[\"'/]")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    tag: str
    parent: int
    marks: tuple[str, ...] = ()
    hidden: bool = False
    pieces: list = field(default_factory=list)  # text, or the index of a child


def _implied_end(stack: list[int], nodes: list[Node], tag: str) -> None:
    """Close what the start of ``tag`` ends."""

    def close(ends: set[str], within: set[str]) -> None:
        for at in range(len(stack) - 1, 0, -1):
            name = nodes[stack[at]].tag
            if name in ends:
                del stack[at:]
                return
            if name in within:
                return

    if tag in CLOSES_P:
        close({"p"}, BLOCK - {"p"} | {"button"})
    if tag == "li":
        close({"li"}, {"ul", "ol", "menu", "dir"})
    elif tag in ("dd", "dt"):
        close({"dd", "dt"}, {"dl"})
    elif tag in ("td", "th"):
        close({"td", "th"}, {"tr", "table"})
    elif tag == "tr":
        close({"tr"}, {"table", "tbody", "thead", "tfoot"})
    elif tag in ("tbody", "thead", "tfoot"):
        close({"tbody", "thead", "tfoot"}, {"table"})
    elif tag == "option":
        close({"option"}, {"select", "datalist"})
    elif tag == "body":
        close({"head"}, set())


def parse(html: str) -> list[Node]:
    """The elements of a page in document order; the first is the root."""
    nodes, stack, at = [Node("#root", -1)], [0], 0
    size = len(html)

    def add_text(raw: str) -> None:
        if raw:
            nodes[stack[-1]].pieces.append(unescape(raw))

    while at < size:
        found = _TOKEN.search(html, at)
        if not found:
            break
        add_text(html[at:found.start()])
        at = found.end()
        tag = found[2] and found[2].lower()
        if not tag:
            continue
        if found[1]:
            if tag == "br":
                nodes[stack[-1]].pieces.append(" ")
                continue
            for depth in range(len(stack) - 1, 0, -1):
                name = nodes[stack[depth]].tag
                if name == tag:
                    del stack[depth:]
                    break
                # An inline end tag does not reach beyond its block.
                if tag not in BLOCK and name in BLOCK:
                    break
            continue
        _implied_end(stack, nodes, tag)
        if tag in ("br", "hr", "wbr", "img"):
            nodes[stack[-1]].pieces.append("" if tag in ("wbr", "img") else " ")
        if tag in VOID:
            continue
        marks, hidden = [], tag in HIDDEN
        if found[3]:
            for name, *values in _ATTRIBUTE.findall(found[3]):
                name, value = name.lower(), unescape(values[0] or values[1] or values[2])
                if name in ("class", "id", "role"):
                    marks += [w.lower() for w in _WORDS.findall(value)]
                elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                    hidden = True
                elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    hidden = True
        node = Node(tag, stack[-1], tuple(marks), hidden)
        nodes[stack[-1]].pieces.append(len(nodes))
        nodes.append(node)
        if found[3].endswith("/") and tag in ("svg", "path", "g"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            if tag in ("textarea", "title"):
                node.pieces.append(unescape(html[at:end.start() if end else size]))
            at = end.end() if end else size
            continue
        stack.append(len(nodes) - 1)
    add_text(html[at:])
    return nodes


# Words in class, id and role that tell parts of a page apart.
MARKS = {
    "content": "article content main story text entry body post prose copy paragraph reading".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs toolbar links".split(),
    "frame": "header footer masthead banner top bottom foot head logo copyright legal site".split(),
    "side": "sidebar side aside related recommended recommendations widget promo teaser popular more trending rail".split(),
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay newsletter subscribe signup dialog toast privacy message".split(),
    "advert": "ad ads advert advertisement advertising sponsor sponsored sponsors adsense outbrain taboola dfp commercial".split(),
    "comment": "comment comments reply replies respond discussion disqus feedback reader responses thread".split(),
    "share": "share sharing social follow tags tag meta byline author search form login credit rating print tools".split(),
}
_MARK_GROUP = {word: name for name, words in MARKS.items() for word in words}
TAGS = ("article main p h1 h2 h3 h4 h5 h6 li ul ol a nav header footer aside form div section span table tr td th"
        " blockquote pre code figure figcaption dl dd dt label input button body #root b i em strong").split()
_TAG_AT = {tag: at for at, tag in enumerate(TAGS)}
_MARK_AT = {name: len(TAGS) + 1 + at for at, name in enumerate(MARKS)}
_INSIDE_AT = len(TAGS) + 1 + len(MARKS)
_INSIDE = "article main nav header footer aside form".split() + list(MARKS)
_REST_AT = _INSIDE_AT + len(_INSIDE)
N_FEATURES = _REST_AT + 8


@dataclass
class Forest:
    """Elements of several pages one after the other; roots have parent -1."""

    pages: list[list[Node]]
    parent: np.ndarray
    depth: np.ndarray
    features: np.ndarray


def forest(htmls: list[str]) -> Forest:
    """The pages' elements with their features."""
    pages, parents, depths, ones, rest = [], [], [], [], []
    known: dict[tuple, tuple] = {}  # flags by tag, marks and what an element lies in
    for html in htmls:
        nodes = parse(html)
        begin = len(parents)
        own = [
            0 if node.hidden else sum(len(p.strip()) for p in node.pieces if isinstance(p, str))
            for node in nodes
        ]
        total, linked = own[:], [0] * len(nodes)
        for at in range(len(nodes) - 1, 0, -1):
            node = nodes[at]
            if not node.hidden:
                total[node.parent] += total[at]
                linked[node.parent] += total[at] if node.tag == "a" else linked[at]
        page = max(1, total[0])
        inside: list[frozenset] = []
        depth: list[int] = []
        for at, node in enumerate(nodes):
            around = inside[node.parent] if at else frozenset()
            key = (node.tag, node.marks, around)
            if key not in known:
                groups = {_MARK_GROUP[w] for w in node.marks if w in _MARK_GROUP}
                here = around | groups | ({node.tag} & set(_INSIDE))
                columns = [_TAG_AT.get(node.tag, len(TAGS)), *(_MARK_AT[g] for g in groups)]
                columns += [_INSIDE_AT + k for k, name in enumerate(_INSIDE) if name in here]
                flags = np.zeros(_REST_AT, np.float32)
                flags[columns] = 1
                known[key] = frozenset(here), flags
            here, flags = known[key]
            inside.append(here)
            depth.append(depth[node.parent] + 1 if at else 0)
            parents.append(begin + node.parent if at else -1)
            ones.append(flags)
            size = total[at]
            links = (size if node.tag == "a" else linked[at]) / size if size else 0
            rest.append((1, node.hidden, own[at], size, links, size == 0, size / page, links > 0.5))
        depths += depth
        pages.append(nodes)
    measured = np.array(rest, np.float64).reshape(-1, 8)
    measured[:, 2] = np.log1p(measured[:, 2]) / 6
    measured[:, 3] = np.log1p(measured[:, 3]) / 8
    flags = np.stack(ones) if ones else np.zeros((0, _REST_AT))
    return Forest(pages, np.array(parents, np.int64), np.array(depths, np.int64), np.hstack([flags, measured]))


@dataclass
class Model:
    weights: np.ndarray  # of a node's features, in favour of content
    pair: np.ndarray  # 2 x 2, by label of parent and child

    def marginals(self, parent: np.ndarray, depth: np.ndarray, features: np.ndarray):
        """Probability of content per node, and of each label pair per node and its parent.

        Works on one tree or on many at once (roots have parent -1), level by level.
        """
        n = len(parent)
        unary = np.zeros((n, 2))
        unary[:, 1] = features @ self.weights
        up = unary.copy()  # log belief of the subtree below a node, by its own label
        message = np.zeros((n, 2))  # to the parent, by the parent's label
        levels = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=0)) + 1)]
        for level in reversed(levels[1:]):
            scores = self.pair[None] + up[level][:, None, :]
            message[level] = np.logaddexp(scores[:, :, 0], scores[:, :, 1])
            np.add.at(up, parent[level], message[level])
        belief, pairs = up.copy(), np.zeros((n, 2, 2))
        for level in levels[1:]:
            above = belief[parent[level]] - message[level]  # all but this child's part
            joint = above[:, :, None] + self.pair[None] + up[level][:, None, :]
            belief[level] = np.logaddexp(joint[:, 0], joint[:, 1])
            joint -= joint.max(axis=(1, 2), keepdims=True)
            pairs[level] = np.exp(joint)
            pairs[level] /= pairs[level].sum(axis=(1, 2), keepdims=True)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), pairs


def train(pages: list[tuple[str, str]], steps: int = 150) -> Model:
    """Fit to (html, marker) pages: text of content blocks begins with the marker character."""
    one = forest([html for html, _ in pages])
    parent, depth, x, labels = one.parent, one.depth, one.features, []
    for nodes, (_, marker) in zip(one.pages, pages, strict=True):
        texts = [[p for p in node.pieces if isinstance(p, str) and p.strip()] for node in nodes]
        content = [any(marker in p for p in own) for own in texts]
        mixed = [any(marker not in p for p in own) for own in texts]
        for at in range(len(nodes) - 1, 0, -1):
            # An element around content counts as content unless it also holds other text.
            content[nodes[at].parent] |= content[at]
            mixed[nodes[at].parent] |= mixed[at] and nodes[at].tag not in _INLINE
        labels += [
            c and (not m or node.tag in ("article", "main"))
            for c, m, node in zip(content, mixed, nodes, strict=True)
        ]
    y = np.array(labels, int)
    child = np.flatnonzero(parent >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[parent[child]], y[child]), 1)
    model = Model(np.zeros(x.shape[1]), np.zeros((2, 2)))
    # Adam on the mean log likelihood with a small ridge.
    params = np.zeros(x.shape[1] + 4)
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        model.weights, model.pair = params[:-4], params[-4:].reshape(2, 2)
        p, pairs = model.marginals(parent, depth, x)
        gradient = np.concatenate([x.T @ (y - p), (seen - pairs.sum(axis=0)).ravel()]) / len(y) - 1e-4 * params
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        params = params + 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(params[:-4].copy(), params[-4:].reshape(2, 2).copy())


MARKER = "\ue000"
_SYLLABLES = "an be co de er fi ga ho in ka lo mu ne or pa qui ra su ti un ver wo xe yo zu".split()


def labelled_pages(n: int = 300, seed: int = 7) -> list[tuple[str, str]]:
    """Pages of varied layout whose content text is marked with ``MARKER``.

    Layouts differ in the element that holds the article, in the presence, place, markup and names
    of menus, headers, footers, sidebars, notices, adverts, forms and reader comments, and in links,
    lists, tables and quotes within the article.
    """
    rng = np.random.default_rng(seed)

    def pick(options):
        return options[int(rng.integers(len(options)))]

    def some(p: float) -> bool:
        return rng.random() < p

    def text(low: int, high: int) -> str:
        out = ["".join(pick(_SYLLABLES) for _ in range(rng.integers(1, 5))) for _ in range(rng.integers(low, high))]
        return " ".join(out).capitalize() + "."

    def links(low: int, high: int) -> str:
        return "".join(f'<li><a href="/{k}">{text(1, 3)}</a></li>' for k in range(rng.integers(low, high)))

    def part(tags, names, inner: str) -> str:
        tag = pick(tags)
        how = pick([f' class="{pick(names)}"', f' id="{pick(names)}"', f' class="x-{pick(names)} c{rng.integers(9)}"'])
        if tag not in ("div", "section", "span", "p", "ul") and some(0.6):
            how = ""
        return f"<{tag}{how}>{inner}</{tag}>"

    def body() -> str:
        out = [f"<{h}>{MARKER}{text(2, 8)}</{h}>" for h in ["h1"] if some(0.9)]
        for _ in range(rng.integers(1, 12)):
            kind = rng.random()
            words = text(*pick([(1, 6), (8, 30), (25, 90)]))
            if kind < 0.62:
                link = f' <a href="/l">{MARKER}{text(1, 3)}</a> {MARKER}{text(2, 6)}' if some(0.25) else ""
                bold = f"<b>{MARKER}{text(1, 4)}</b> " if some(0.2) else ""
                out.append(f"<p>{bold}{MARKER}{words}{link}" + ("</p>" if some(0.85) else ""))
            elif kind < 0.72:
                level = pick("2345")
                out.append(f"<h{level}>{MARKER}{text(1, 7)}</h{level}>")
            elif kind < 0.8:
                items = "".join(f"<li>{MARKER}{text(2, 15)}</li>" for _ in range(rng.integers(2, 6)))
                out.append(f"<{t}>{items}</{t}>" if (t := pick(["ul", "ol"])) else "")
            elif kind < 0.86:
                out.append(f"<blockquote><p>{MARKER}{words}</p></blockquote>")
            elif kind < 0.9:
                rows = "".join(f"<tr><td>{MARKER}{text(1, 3)}</td><td>{MARKER}{text(1, 3)}</td></tr>" for _ in range(3))
                out.append(f"<table>{rows}</table>")
            elif kind < 0.94:
                out.append(f"<figure><img src=x><figcaption>{MARKER}{text(3, 12)}</figcaption></figure>")
            elif kind < 0.97:
                out.append(f"<pre>{MARKER}{words}</pre>")
            else:
                out.append(part(["div", "p"], ["ad", "ad-slot", "advert", "sponsored"], text(2, 25)))
        return "".join(out)

    def comment() -> str:
        inner = "".join(f'<{t} class="comment">{w}<p>{text(3, 40)}</p></{t}>'
                        for t, w in [(pick(["div", "li", "article"]), pick(["", "<b>" + text(1, 2) + "</b>"]))
                                     for _ in range(rng.integers(1, 6))])
        return part(["section", "div", "aside"], ["comments", "comment-list", "reader-comments", "discussion"],
                    (f"<h3>{text(1, 3)}</h3>" if some(0.6) else "") + inner)

    pages = []
    for _ in range(n):
        menu = lambda: part(["nav", "div", "ul"], ["nav", "menu", "navbar", "breadcrumbs"], f"<ul>{links(2, 9)}</ul>")
        top = part(["header", "div"], ["header", "site-header", "masthead", "banner", "top"],
                   pick([f"<a href=/>{text(1, 3)}</a>", f"<h1>{text(1, 4)}</h1>", f"<p>{text(2, 12)}</p>"]) + (menu() if some(0.5) else ""))
        bottom = part(["footer", "div"], ["footer", "site-footer", "copyright"], pick(["", "<p>", "<div>"]) + "&copy; " + text(1, 20) + (f"<ul>{links(1, 5)}</ul>" if some(0.4) else ""))
        side = part(["aside", "div", "section"], ["sidebar", "related", "widget", "popular", "promo"],
                    pick([f"<h3>{text(1, 4)}</h3><ul>{links(2, 7)}</ul>", f"<p>{text(5, 50)}</p>", f"<h4>{text(1, 3)}</h4><p>{text(3, 20)}</p>"]))
        notice = part(["div", "section", "dialog", "p"], ["cookie-notice", "cookie-banner", "consent", "notice", "newsletter", "popup", "alert"],
                      pick([f"<p>{text(5, 40)}</p>", text(4, 40)]) + pick(["", f"<button>{text(1, 2)}</button>", f'<a href="/p">{text(1, 3)}</a>']))
        advert = lambda: part(["div", "aside", "section"], ["ad", "ads", "advert", "sponsored", "advertisement", "ad-banner"], pick([text(2, 30), f"<p>{text(3, 30)}</p>", f'<a href="/ad">{text(2, 8)}</a>']))
        form = f"<form>{pick(['', '<p>' + text(2, 12) + '</p>'])}<label>{text(1, 3)}</label><input name=q><button>{text(1, 2)}</button></form>"
        holder = pick(["<article>{}</article>"] * 4 + ["<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>',
                       '<div id="main"><div class="article-body">{}</div></div>', '<div class="post">{}</div>', "<section><article>{}</article></section>"])
        inner = body()
        if some(0.15):
            inner += pick([form, side, advert()])
        if some(0.1):
            inner = part(["header"], ["header"], f"<p>{text(1, 6)}</p>") + inner if some(0.5) else inner + part(["footer"], ["footer"], f"<p>{text(1, 12)}</p>")
        if some(0.1):
            inner += comment()
        blocks = ["<script>var a='<p>';</script>" if some(0.3) else "", top if some(0.6) else "", menu() if some(0.6) else "",
                  notice if some(0.4) else "", advert() if some(0.5) else "", side if some(0.2) else "",
                  holder.format(inner), comment() if some(0.4) else "", side if some(0.4) else "", form if some(0.25) else "",
                  advert() if some(0.3) else "", bottom if some(0.8) else "", notice if some(0.1) else ""]
        page = "".join(blocks)
        if some(0.2):
            page = f'<div class="wrapper">{page}</div>'
        pages.append((f"<html><head><title>{text(2, 6)}</title><style>p{{}}</style></head><body>{page}</body></html>", MARKER))
    return pages


def main_texts(htmls: list[str | None], model: Model) -> list[str]:
    """Of each page the blocks of its content elements in page order, joined by an empty line."""
    found = forest([html or "" for html in htmls])
    content, _ = model.marginals(found.parent, found.depth, found.features)
    kept = (content >= 0.5).tolist()
    texts, begin = [], 0
    for nodes in found.pages:
        texts.append(_kept_text(nodes, kept[begin:begin + len(nodes)]))
        begin += len(nodes)
    return texts


def _kept_text(nodes: list[Node], kept: list[bool]) -> str:
    blocks: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        joined = " ".join("".join(buffer).split())
        if joined:
            blocks.append(joined)
        buffer.clear()

    owner = [0] * len(nodes)  # the element whose marginal decides: inline ones go with their block
    for at in range(1, len(nodes)):
        owner[at] = at if nodes[at].tag in BLOCK else owner[nodes[at].parent]
    # Depth first without recursion: pages may nest very deeply.
    todo: list[tuple[int, int]] = [(0, 0)]
    while todo:
        at, begin = todo.pop()
        node = nodes[at]
        block = node.tag in BLOCK
        if block and begin == 0:
            flush()
        if node.hidden:
            continue
        for k in range(begin, len(node.pieces)):
            piece = node.pieces[k]
            if isinstance(piece, str):
                if kept[owner[at]]:
                    buffer.append(piece)
            else:
                todo += [(at, k + 1), (piece, 0)]
                break
        else:
            if block:
                flush()
    flush()
    return "\n\n".join(blocks)


def main_text(html: str | None, model: Model) -> str:
    """Main text of one page."""
    return main_texts([html], model)[0]


PAGES_AT_ONCE = 64
CHARS_AT_ONCE = 4 << 20


def _groups(htmls: pa.Array) -> Iterator[list[str | None]]:
    group, size = [], 0
    for html in htmls:
        group.append(html.as_py())
        size += len(group[-1] or "")
        if len(group) == PAGES_AT_ONCE or size >= CHARS_AT_ONCE:
            yield group
            group, size = [], 0
    if group:
        yield group


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row: ``page_id``, ``url``, main ``text`` and its number of code points."""
    model = model or train(labelled_pages())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text for group in _groups(batch.column(2)) for text in main_texts(group, model)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
