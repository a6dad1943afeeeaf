"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree: block-level elements, and their text blocks as leaves. Every node is content or not. Node
potentials come from a logistic model of the node's features (tag, class and id words, length, link density,
punctuation); edge potentials tie a child to its parent, by the child's kind. Sum-product messages go up from the leaves
and down from the root, which on a tree gives exact marginals; blocks whose marginal favours content are the text.

The potentials are trained on labelled pages: a bounded sample of pages whose own markup names the article (and what in
it isn't part of it), and pages of known layouts, some labelled by hand, some generated, for pages that don't.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrel.llm.common import doc_batches, read_table

#: At most this many pages, of at most this many characters each, are used as labelled pages.
TRAIN_PAGES, TRAIN_CHARS = 300, 60_000
DIM = 1 << 13
#: Weight of a text block's own features against those of elements.
LEAF = 0.4

#: Elements that end the block of text they stand in; all others, known or not, are part of a line.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noframes ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is not the page's: code, pictures and players, fields of forms.
SILENT = frozenset("script style template svg iframe canvas audio video head select textarea title option datalist".split())
RAW = frozenset("script style textarea title iframe xmp noembed".split())
#: An open element of the value's tags ends where the key starts (up to the nearest of the scope tags).
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPE = frozenset("ul ol dl table article section main div body html td th blockquote aside nav header footer form".split())
BLOCK_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^>"'])*+)(?:>|\Z)|[^<]++|<""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|itemprop|style|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PUNCT = re.compile(r"[.!?,;:。！？，؟]")


@dataclass
class Tree:
    """Nodes in document order, parents before children. Leaves have text; ``links`` is the share of it inside anchors."""

    parent: list = field(default_factory=list)
    tag: list = field(default_factory=list)
    names: list = field(default_factory=list)
    text: list = field(default_factory=list)
    links: list = field(default_factory=list)

    def add(self, parent: int, tag: str, names: tuple, text: str | None = None, links: float = 0.0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(names)
        self.text.append(text)
        self.links.append(links)
        return len(self.parent) - 1


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """A block's tag, the words of its class, id and role, and a mark if it is hidden."""
    words, hidden = [tag], False
    for a in _ATTR.finditer(attributes) if attributes else ():
        key, value = a.group(1).lower(), a.group(2) or a.group(3) or a.group(4) or ""
        if key == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif key == "hidden":
            hidden = True
        else:
            words += _NAME.findall(_CAMEL.sub("-", value).lower())
    return (*words, "*hidden") if hidden else tuple(words)


def parse(page: str | None) -> Tree:
    """The block tree of a page. Unclosed, misnested and unknown tags are taken as browsers would, near enough; nothing raises."""
    page = page or ""
    tree = Tree()
    root = tree.add(-1, "root", ())
    # (tag, node, attributes): inline elements share their block's node and keep their attributes, till a block opens in them.
    stack: list[tuple[str, int, str | None]] = [("root", root, None)]
    parts: list[str] = []
    linked = anchors = silent = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            whole = "".join(parts)
            text = " ".join(html.unescape(whole).split())
            if text:
                node = stack[-1][1]
                tree.add(node, "#" + tree.tag[node], (), text, linked / max(1, len(whole)))
            parts.clear()
        linked = 0

    def close(to: int) -> None:
        nonlocal anchors, silent
        while len(stack) > to:
            tag, _, _ = stack.pop()
            anchors -= tag == "a"
            silent -= tag in SILENT

    def opened() -> None:
        """Inline elements around a block that opens are blocks with names of their own from here on."""
        for k in range(1, len(stack)):
            tag, _, attributes = stack[k]
            if attributes is not None:
                node = tree.add(stack[k - 1][1], tag, _names(tag, attributes)) if attributes.strip() or "-" in tag else stack[k - 1][1]
                stack[k] = (tag, node, None)
            elif stack[k][1] < stack[k - 1][1]:
                stack[k] = (tag, stack[k - 1][1], None)

    at = 0
    while at < len(page):
        # Anew behind each raw element: a token that starts inside it may reach beyond its end.
        for m in _TOKEN.finditer(page, at):
            name = m.group(2)
            if name is None:
                got = m.group()
                if not silent and (got[0] != "<" or got == "<"):
                    parts.append(got)
                    if anchors:
                        linked += len(got)
                continue
            tag = name.lower()
            if m.group(1):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        if stack[k][1] != stack[k - 1][1]:
                            flush()
                        close(k)
                        break
                    if tag not in BLOCK and stack[k][0] in BLOCK:
                        break
                continue
            if tag == "br":
                parts.append(" ")
                continue
            if tag not in BLOCK:
                if tag not in VOID and not (m.group(3).endswith("/") and tag not in RAW):
                    if tag == "a" and anchors:  # anchors don't nest
                        k = max(i for i, x in enumerate(stack) if x[0] == "a")
                        if all(x[0] not in BLOCK for x in stack[k:]):
                            close(k)
                    stack.append((tag, stack[-1][1], m.group(3)))
                    anchors += tag == "a"
                    silent += tag in SILENT
                    if tag in RAW:
                        end = re.compile(rf"</{tag}\b", re.I).search(page, m.end())
                        at = end.start() if end else len(page)
                        if not end:
                            close(len(stack) - 1)
                        break
                continue
            if silent and any(x[0] in SILENT and x[0] not in BLOCK for x in stack):
                stack.append((tag, stack[-1][1], None))  # what a picture or a template holds makes no blocks
                silent += tag in SILENT
                continue
            flush()
            if tag in BLOCK_ENDS_P or tag in ENDS:
                ends = ENDS.get(tag, set()) | ({"p"} if tag in BLOCK_ENDS_P else set())
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ends:
                        close(k)
                        if tag not in ("tr",):
                            break
                    elif stack[k][0] in SCOPE:
                        break
            if tag in VOID:
                continue
            opened()
            node = tree.add(stack[-1][1], tag, _names(tag, m.group(3)))
            stack.append((tag, node, None))
            silent += tag in SILENT
            if tag in RAW:
                end = re.compile(rf"</{tag}\b", re.I).search(page, m.end())
                at = end.start() if end else len(page)
                break
        else:
            break
    flush()
    return tree


#: Parents that a child's edge potential tells apart, and kinds of child.
_KINDS = ("#", "h", "p", "list", "part", "box", "other")
_KIND_OF = {**dict.fromkeys(["h1", "h2", "h3", "h4", "h5", "h6"], 1), **dict.fromkeys(["p", "pre", "blockquote"], 2), **dict.fromkeys(["ul", "ol", "li", "dl", "dd", "dt", "table", "tr", "td"], 3), **dict.fromkeys(["nav", "aside", "footer", "header", "form", "article", "main"], 4), **dict.fromkeys(["div", "section"], 5)}


def kind_of(tag: str) -> int:
    return 0 if tag[0] == "#" else _KIND_OF.get(tag, len(_KINDS) - 1)


def _slot(name: str, kept: dict[str, int] = {}) -> int:  # noqa: B006
    got = kept.get(name)
    if got is None:
        got = zlib.crc32(name.encode()) % (DIM - 1) + 1
        if len(kept) < 200_000:
            kept[name] = got
    return got


def features(tree: Tree) -> list[list[int]]:
    """Slots of the binary features of each node."""
    out = []
    for k, tag in enumerate(tree.tag):
        text = tree.text[k]
        if text is None:
            out.append([_slot(("t:" if i == 0 else "n:") + w) for i, w in enumerate(tree.names[k])])
            continue
        n = len(text)
        size = min(12, n.bit_length())
        dots = min(4, len(_PUNCT.findall(text)) * 40 // max(20, n))
        link = int(tree.links[k] * 4 + 0.5)
        own = [_slot("l:" + tag), _slot(f"s:{size}"), _slot(f"k:{link}"), _slot(f"d:{dots}:{size > 6}"), _slot(f"c:{any(x in text for x in '©|»')}")]
        up = tree.parent[k]
        for _ in range(4):  # the names of the elements around it
            if up <= 0:
                break
            own += [_slot("u:" + w) for w in dict.fromkeys(tree.names[up])]
            up = tree.parent[up]
        out.append(own)
    return out


@dataclass
class Model:
    """``weights`` by feature slot (slot 0 is the bias); ``edges[kind][parent][child]`` as log potentials."""

    weights: list
    edges: list

    def marginals(self, tree: Tree) -> list[float]:
        """Log odds that each node is content: one pass of messages up, one down."""
        n, parent, w = len(tree.parent), tree.parent, self.weights
        # Blocks of one part look alike: each counts for less than an observation of its own.
        own = [(w[0] + sum(w[s] for s in slots)) * (1.0 if t is None else LEAF) for slots, t in zip(features(tree), tree.text, strict=True)]
        edges = [self.edges[kind_of(t)] for t in tree.tag]
        up0, up1 = [0.0] * n, [0.0] * n  # what the children say of each state
        for k in range(n - 1, 0, -1):
            (e00, e01), (e10, e11) = edges[k]
            a, b = up0[k], up1[k] + own[k]
            p = parent[k]
            up0[p] += _either(a + e00, b + e01)
            up1[p] += _either(a + e10, b + e11)
        odds = [0.0] * n
        odds[0] = up1[0] - up0[0] + own[0]
        for k in range(1, n):
            (e00, e01), (e10, e11) = edges[k]
            a, b = up0[k], up1[k] + own[k]
            d = odds[parent[k]] - (_either(a + e10, b + e11) - _either(a + e00, b + e01))  # the parent without this child
            odds[k] = b - a + _either(e01, d + e11) - _either(e00, d + e10)
        return odds


def _either(a: float, b: float) -> float:
    return a + log1p(exp(b - a)) if a > b else b + log1p(exp(a - b))


_GOOD = frozenset(["article", "main", "articlebody"])
_BAD = frozenset("nav aside footer form button header menu sidebar advert ad ads advertisement sponsored promo banner cookie consent notice newsletter subscribe comment comments respond reply related share social breadcrumb breadcrumbs pagination login popup modal disclaimer copyright hidden".split())


def labels(tree: Tree) -> list[bool] | None:
    """Labels by the page's own markup: leaves inside the article but not inside a part named otherwise. None if nothing is named an article."""
    state = [0] * len(tree.parent)  # 0 outside, 1 inside, 2 named otherwise
    found = False
    for k in range(1, len(state)):
        up = state[tree.parent[k]]
        names = set(tree.names[k])
        bad = names & _BAD or "*hidden" in names
        if names & {"header"} and up == 1:
            bad = False
        state[k] = 2 if up == 2 or bad and not names & _GOOD else 1 if up == 1 or names & _GOOD else 0
        found |= state[k] == 1
    if not found:
        return None
    leaf = [s == 1 and t is not None for s, t in zip(state, tree.text, strict=True)]
    return _spread(tree, leaf)


def _spread(tree: Tree, leaf: list[bool]) -> list[bool]:
    """Inner nodes are content if most of their text is."""
    yes, all_ = [0] * len(leaf), [0] * len(leaf)
    for k in range(len(leaf) - 1, -1, -1):
        if tree.text[k] is not None:
            all_[k], yes[k] = len(tree.text[k]), len(tree.text[k]) * leaf[k]
        if k:
            all_[tree.parent[k]] += all_[k]
            yes[tree.parent[k]] += yes[k]
    return [2 * y > a for y, a in zip(yes, all_, strict=True)]


#: Pages labelled by hand: the blocks of the main text are those that start with "Text".
_BODY = "Text of the first paragraph, which goes on for a while, as prose does. It has more than one sentence, and commas."
SEEDS = (
    f"<body><div id=menu><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></div><div class=breadcrumb><a>Home</a> &gt; <a>News</a></div><div class='post content'><h1>Text title</h1><p>{_BODY}<p>{_BODY}<blockquote>{_BODY}</blockquote></div><div class=sidebar><h3>Popular</h3><ul><li><a>One story</a><li><a>Another story</a></ul><p>Follow us for more, every day.</p></div><div class=footer>Copyright 2020. All rights reserved.</div></body>",
    f"<body><header><h2>The Site</h2><nav><a>Home</a> <a>About</a></nav></header><div class='cookie-notice'><p>We use cookies to improve your visit. <button>Accept</button></p></div><section class=entry-content><h2>Text head</h2><p>{_BODY}</p><p>{_BODY}</p><ul><li>Text item, short.</li><li>Text item of a list, with a few words more.</li></ul></section><div class=comments><h3>2 comments</h3><div class=comment><p>I think this is a great article, thanks for it. It helped me.</p></div><div class=comment><p>I don't agree at all, and here is why, at some length.</p></div><form><label>Your name</label><input><button>Send</button></form></div><footer><p>Contact us. Terms. Privacy.</p></footer></body>",
    f"<body><table><tr><td class=nav><a>Start</a><br><a>Archive</a></td><td class=main><h1>Text title</h1><p>{_BODY}</p><div class=ad><p>Buy this now, it is cheap and good. Order today.</p></div><p>{_BODY}</p><aside><p>Read also: something else that we wrote, last week.</p></aside><p>{_BODY}</p></td></tr></table><div class=newsletter><p>Subscribe to our newsletter, it is free.</p><form><input></form></div></body>",
    f"<body><div class=wrapper><div class=top-banner>Sponsored: the best offers of the week.</div><div class=page-body><div class=story-text><p>{_BODY}</p><p>Text, short.</p><h3>Text head</h3><p>{_BODY}</p><pre>Text of code</pre><table><tr><td>Text cell</td><td>Text cell two</td></tr></table></div><div class=related><h4>Related</h4><a>First</a><a>Second</a></div><div class=share><a>Share</a> <a>Tweet</a></div></div></div></body>",
    f"<body><article><header><h1>Text title</h1></header><p>{_BODY}</p><div class='advert'>Advert. Buy our things, they are new.</div><p>{_BODY}</p><section id=comments><p>Nice one. I will come back to read more of it.</p></section></article><aside class=sidebar><p>About the author, who writes here, and has done so for years.</p></aside></body>",
    f"<body><p>{_BODY}</p><p>{_BODY}</p><p>Text, last.</p></body>",
)


#: Names and texts that generated layouts are put together from.
_CONTENT = ("div class=post-content", "div class='article-body'", "section class=entry-content", "div id=content", "div class=story", "main", "article", "td class=main", "div class=text", "div itemprop=articleBody", "div", "section id=main-content")
_AROUND = (
    ("nav", "<ul><li><a>Home</a><li><a>News</a><li><a>About us</a></ul>"), ("div class=menu", "<a>Start</a> <a>Archive</a> <a>Contact</a>"), ("header", "<h2>The Site</h2><p>All that matters, every day.</p>"), ("div id=header", "<h2>Our Paper</h2>"),
    ("footer", "<p>&copy; 2021 The Site. All rights reserved.</p><p>Contact us. Terms. Privacy.</p>"), ("div id=footer", "Copyright 2020 by us. <a>Imprint</a>"), ("aside", "<h3>Popular</h3><ul><li><a>One story that people read</a><li><a>Another story</a></ul>"),
    ("div class=sidebar", "<h4>About the author</h4><p>Writes here, and has done so for many years now.</p>"), ("div class='cookie-notice'", "<p>We use cookies to make your visit better.</p><button>Accept</button>"), ("div class=banner", "<p>Subscribe today, and save half the price. Offer ends soon.</p>"),
    ("div class=ad", "<p>Buy this now, it is cheap and good. Order today.</p>"), ("div class=advertisement", "Sponsored: the best things to buy."), ("section id=comments", "<h3>3 comments</h3><div class=comment><p>I think this is great, thanks for writing it. It helped me a lot.</p></div><div class=comment><p>I don't agree, and here is why, at some length.</p></div>"),
    ("ul class=comment-list", "<li><b>Ann</b> <p>Nice one. I will come back to read more of it, soon.</p><li><b>Bob</b> <p>So true, every word of it.</p>"), ("form", "<label>Your name</label><input><label>Your mail</label><input><button>Send</button>"), ("div class=newsletter", "<p>Get our newsletter, it is free.</p><form><input><button>Go</button></form>"),
    ("div class=related", "<h4>Related</h4><ul><li><a>First thing to read</a><li><a>Second thing to read</a></ul>"), ("div class=share", "<a>Share</a> <a>Tweet</a> <a>Mail</a>"), ("div class=breadcrumb", "<a>Home</a> &gt; <a>News</a>"), ("div class=pagination", "<a>1</a> <a>2</a> <a>Next</a>"),
)


def layouts(n: int = 120, seed: int = 7) -> list[str]:
    """Pages of many layouts with known blocks: those of the main text start with "Text"."""
    r = random.Random(seed)
    words = "the of a small house river had not been seen for many years when they came back in spring and asked about it".split()

    def prose(low: int, high: int) -> str:
        return "Text " + " ".join(r.choice(words) + r.choice(["", "", "", "", ",", "."]) for _ in range(r.randint(low, high))) + "."

    out = []
    for _ in range(n):
        body = []
        for _ in range(r.randint(1, 7)):
            kind = r.random()
            if kind < 0.7:
                body.append(f"<p>{prose(5, 90)}</p>")
            elif kind < 0.8:
                body.append(f"<h2>{prose(1, 5)[:-1]}</h2>")
            elif kind < 0.9:
                body.append("<ul>" + "".join(f"<li>{prose(2, 14)}" for _ in range(3)) + "</ul>")
            else:
                body.append(r.choice([f"<blockquote>{prose(6, 40)}</blockquote>", f"<table><tr><td>{prose(1, 3)}</td><td>{prose(1, 3)}</td></tr></table>", f"<pre>{prose(3, 9)}</pre>"]))
        around = [f"<{tag}>{inner}</{tag.split()[0]}>" for tag, inner in r.sample(_AROUND, r.randint(3, 8))]
        if r.random() < 0.4:
            body.insert(r.randint(0, len(body)), around.pop())
        if r.random() < 0.8:
            body.insert(0, f"<h1>{prose(2, 8)[:-1]}</h1>")
        tag = r.choice(_CONTENT)
        cut = r.randint(1, len(around))
        whole = "".join([*around[:cut], f"<{tag}>", *body, f"</{tag.split()[0]}>", *around[cut:]])
        out.append(f"<body>{'<div class=wrapper>' if r.random() < 0.5 else ''}{whole}</body>")
    return out


def by_hand(page: str) -> tuple[Tree, list[bool]]:
    tree = parse(page)
    return tree, _spread(tree, [bool(x) and x.startswith("Text") for x in tree.text])


def train(pages: list[str], known: tuple[str, ...] = (), rounds: int = 60) -> Model:
    """The model of pages that label themselves and of ``known`` ones (the hand-labelled and generated layouts if there are none).

    Piecewise: node weights by regularised logistic regression, edge tables as smoothed log ratios of joint to independent counts.
    """
    found = [(t, y) for t in map(parse, pages) if (y := labels(t)) is not None]
    found += [by_hand(page) for page in known or (*SEEDS, *layouts())]
    joint = np.ones((len(_KINDS), 2, 2))
    rows, cols, ys = [], [], []
    n = 0
    for tree, y in found:
        for k, slots in enumerate(features(tree)):
            if k:
                joint[kind_of(tree.tag[k]), int(y[tree.parent[k]]), int(y[k])] += 1
            rows += [n] * (len(slots) + 1)
            cols += [0, *slots]
            ys.append(y[k])
            n += 1
    rows, cols, y = np.array(rows), np.array(cols), np.array(ys, float)
    w, step = np.zeros(DIM), np.full(DIM, 1e-8)
    for _ in range(rounds * 4):
        p = 1 / (1 + np.exp(-np.bincount(rows, w[cols], n)))
        g = np.bincount(cols, (p - y)[rows], DIM) / n + 2e-5 * w
        step += g * g
        w -= 0.5 * g / np.sqrt(step)
    table = joint / joint.sum(axis=(1, 2), keepdims=True)
    edges = np.log(table / (table.sum(2, keepdims=True) * table.sum(1, keepdims=True)))
    return Model(w.tolist(), edges.tolist())


def main_text(model: Model, page: str | None) -> list[str]:
    """The content blocks of a page in page order."""
    tree = parse(page)
    if len(tree.parent) == 1:
        return []
    return [t for t, odds in zip(tree.text, model.marginals(tree), strict=True) if t is not None and odds > 0]


def _extract(model: Model, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in doc_batches(batches):
            texts = ["\n\n".join(main_text(model, page)) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def labelled_sample(pages: DataFrame, limit: int = TRAIN_PAGES, chars: int = TRAIN_CHARS) -> list[str]:
    """At most ``limit`` pages of at most ``chars`` characters, by the order of a hash of their id and url: the training pages, and no others, are sampled.

    The choice is made on ids alone, so no more html than that reaches the driver.
    """
    mark = F.xxhash64("page_id", "url")
    fits = pages.where(F.length("html") <= chars)
    few = fits.select("page_id", mark.alias("mark")).distinct().orderBy("mark", "page_id").limit(limit)
    chosen = fits.withColumn("mark", mark).join(F.broadcast(few), ["page_id", "mark"], "left_semi").dropDuplicates(["page_id", "mark"])
    return [r["html"] for r in chosen.orderBy("mark", "page_id").select("html").collect()]


def extract(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", model: Model | None = None) -> DataFrame:
    """Per input row ``page_id, url, text, n_chars``.

    Null and empty html give an empty text; text outside any element counts as blocks of the root. Rows that repeat give
    the same result each; an empty table gives no rows (the model is then trained on the hand-labelled pages alone).
    """
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    model = model or train(labelled_sample(p))
    kind = p.schema["page_id"].dataType.simpleString()
    return p.mapInArrow(_extract(model, kind), f"page_id {kind}, url string, text string, n_chars long")


def op10_html(spark, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
