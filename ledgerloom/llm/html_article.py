"""Main text of web pages: gradient-boosted trees over DOM nodes and hierarchical decoding.

Every element and text run of a page is a node with features: tag, attribute tokens of the node and above it, depth,
length, link and tag density of its subtree, place among its siblings and their likeness. The trees give each node the
probability that its subtree holds main text. Decoding picks the most likely labels of the whole tree under which no node
is kept below a dropped one: from the leaves upwards, a dropped node drops its subtree, a kept one keeps or drops each child.

The table has no labels, so the trees learn from a bounded sample of its pages, labelled by their own markup (an
``article`` or ``main`` element and what is menu, header, footer, advert and so on in it), and from the same pages in other
clothes: containers renamed, clutter of the page's own texts added at other places. Names of containers are thus not
enough to tell, and density and siblings count.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.boosted_trees import Trees, fit_trees
from ledgerloom.llm.common import arrow_map, sampled

# Element names of the HTML standard, and words that page authors use in names of containers.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
TO_THE_END = frozenset("script style textarea title".split())  # without an end tag
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"html", "head", "body"}
# a start tag closes an open node of the second kind, unless one of the first stands between
SCOPES = {
    "li": (("ul", "ol", "menu"), ("li",)), "dd": (("dl",), ("dd", "dt")), "dt": (("dl",), ("dd", "dt")), "tr": (("table", "tbody"), ("tr",)),
    "td": (("table", "tbody"), ("td", "th")), "th": (("table", "tbody"), ("td", "th")), "option": (("table", "tbody"), ("option",)),
}
CONTENT_NAMES = frozenset("article main content post entry story body text page blog news prose copy".split())
CLUTTER_NAMES = frozenset(
    "nav menu navigation navbar breadcrumb header masthead top footer bottom sidebar aside side widget related recommended notice cookie consent "
    "banner alert popup modal ad ads advert advertisement promo sponsor sponsored promotion form login signup subscribe newsletter search comment "
    "comments reply replies discussion respond share social tags meta author copyright legal pager pagination toolbar".split()
)
CLUTTER_TAGS = frozenset("nav header footer aside form menu dialog button select label input".split())
TAG_GROUPS = ["p", "div", "section", "article", "main", "li", "ul", "a", "h1", "h2", "span", "td", "b", "blockquote", "pre", "#text"]
# a tag with no < in it is read in one step; no attempt goes past the next <
TAG = re.compile(r"</?([a-zA-Z][^\s/<>\"']*+)((?:[^<>\"']|\"[^<\"]*+\"|'[^<']*+')*+)>")
NAME_OF_TAG = re.compile(r"</?([a-zA-Z][^\s/<>\"']*+)")
PLAIN = re.compile(r"[^>\"']*+")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME = re.compile(r"[a-z]+")
BLANKS = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    names: frozenset
    text: str = ""
    children: list[int] = field(default_factory=list)


class Tokens:
    """Tags of a page, found in time linear in its length, however malformed it is.

    A tag ends at the first ``>`` outside quotes. Where a search for it fails, all places it came past outside quotes lead
    nowhere either; they are remembered, so no later search walks there again.
    """

    def __init__(self, page: str):
        self.page = page
        self.dead: set[int] = set()  # stops (quotes, the end) from which no tag's end is reached
        self.last = {q: page.rfind(q) for q in ">\"'"}
        self.plain = (0, -1)  # between these two places stands no quote and no >

    def end_of_tag(self, at: int) -> int:
        """The place of the ``>`` that ends a tag read from ``at`` on, or -1."""
        page, passed = self.page, []
        while at <= self.last[">"]:
            if not self.plain[0] <= at <= self.plain[1]:
                self.plain = (at, PLAIN.match(page, at).end())
            stop = self.plain[1]
            if page[stop] == ">":
                return stop
            passed.append(stop)
            if stop in self.dead or stop >= self.last[page[stop]]:
                break
            at = page.index(page[stop], stop + 1) + 1
        self.dead.update(passed)
        return -1

    def next(self, at: int) -> tuple[int, int, str | None, bool, str]:
        """Start and end of the next tag, its name, whether it is an end tag, its attributes; without a name for comments.

        A ``<`` that opens no tag is text. Behind the last tag both places are the page's end.
        """
        page, start = self.page, at
        while (start := page.find("<", start)) >= 0:
            if m := TAG.match(page, start):
                return start, m.end(), m[1].lower(), page[start + 1] == "/", m[2]
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), None, False, ""
            if m := NAME_OF_TAG.match(page, start):
                end = self.end_of_tag(m.end())
                if end >= 0:
                    return start, end + 1, m[1].lower(), page[start + 1] == "/", page[m.end() : end]
            elif page[start + 1 : start + 2] in ("!", "?") and start < self.last[">"]:
                return start, page.index(">", start) + 1, None, False, ""
            start += 1
        return len(page), len(page), None, False, ""


class OpenElements:
    """The stack of open nodes, with the places of each tag and of blocks in it, so that no search walks the stack."""

    def __init__(self):
        self.stack, self.tags, self.places, self.blocks = [0], ["#root"], {}, []

    def push(self, node: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(node)
        self.tags.append(tag)

    def close_from(self, place: int) -> None:
        while len(self.stack) > place:
            self.stack.pop()
            tag = self.tags.pop()
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()

    def innermost(self, *tags: str) -> int:
        """Place of the innermost open node with one of the tags; 0, the root's, if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def innermost_block(self) -> int:
        return self.blocks[-1] if self.blocks else 0


def parse(page: str) -> list[Node]:
    """Nodes of a page in document order; the first is the root. Text runs are nodes ``#text``; raw elements and the head are left out."""
    nodes = [Node("#root", -1, 0, frozenset())]
    opened, tokens = OpenElements(), Tokens(page)
    at, end = 0, len(page)
    unclosed = set()

    def add(tag, names=frozenset(), text=""):
        parent = opened.stack[-1]
        nodes.append(Node(tag, parent, nodes[parent].depth + 1, names, text))
        nodes[parent].children.append(len(nodes) - 1)
        return len(nodes) - 1

    while at < end:
        start, after, tag, closes, attributes = tokens.next(at)
        if start > at:
            run = page[at:start]
            if not run.isspace():
                add("#text", text=run)
            elif nodes[opened.stack[-1]].children:
                add("#text", text=" ")
        at = after
        if tag is None:
            continue
        if closes:
            # an end tag closes what it names; one of a block also what is open inside it
            place = opened.innermost(tag)
            if place and (tag in BLOCKS or place > opened.innermost_block()):
                opened.close_from(place)
            continue
        if tag in RAW:
            if not attributes.endswith("/") and tag not in unclosed:
                done = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(page, at)
                if done:
                    at = done.end()
                elif tag in TO_THE_END:
                    at = end
                else:
                    unclosed.add(tag)
            continue
        if tag == "head":
            done = None if tag in unclosed else re.compile(r"</head\s*+>|<body\b", re.I).search(page, at)
            if done:
                at = done.end() if done[0].startswith("</") else done.start()
            else:
                unclosed.add(tag)
            continue
        if tag in CLOSES_P and opened.innermost("p"):
            inner = opened.innermost_block()
            if opened.tags[inner] == "p":
                opened.close_from(inner)
        if tag in SCOPES:
            scope, alike = SCOPES[tag]
            place = opened.innermost(*alike)
            if place > opened.innermost(*scope):
                opened.close_from(place)
        names = frozenset(NAME.findall(" ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(attributes)).lower())) if "=" in attributes else frozenset()
        k = add(tag, names)
        if tag not in VOID and not attributes.endswith("/"):
            opened.push(k, tag)
    return nodes


GROUP = {t: k for k, t in enumerate(TAG_GROUPS)}
WIDTH = 25


def node_rows(nodes: list[Node]) -> list[tuple]:
    """The numbers of each node, the first its tag group."""
    n = len(nodes)
    chars, linked, tags, stops = [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        node, up = nodes[i], nodes[i].parent
        if node.tag == "#text":
            text = node.text
            chars[i] = 0 if text == " " else len(text)
            stops[i] = text.count(".") + text.count(",")
        else:
            tags[i] += 1
            if node.tag == "a":
                linked[i] = chars[i]
        if up >= 0:
            chars[up] += chars[i]
            linked[up] += linked[i]
            tags[up] += tags[i]
            stops[up] += stops[i]
    total = max(chars[0], 1)
    above = [(False, False, False, False)] * n
    alike: list[dict] = [{}] * n
    out = []
    for i, node in enumerate(nodes):
        up, children = node.parent, node.children
        if len(children) > 1:
            alike[i] = count = {}
            for c in children:
                count[nodes[c].tag] = count.get(nodes[c].tag, 0) + 1
        own_good = own_bad = False
        if node.names:
            own_good, own_bad = not node.names.isdisjoint(CONTENT_NAMES), not node.names.isdisjoint(CLUTTER_NAMES)
        tag_bad = node.tag in CLUTTER_TAGS
        if up >= 0:
            good, bad, bad_tag, good_tag = above[up]
            above[i] = (good or own_good, bad or own_bad, bad_tag or tag_bad, good_tag or node.tag == "article" or node.tag == "main")
            siblings = nodes[up].children
            place = (i - siblings[0]) / max(siblings[-1] - siblings[0], 1)
            same = alike[up].get(node.tag, 1) if len(siblings) > 1 else 1
            parent = (chars[up], chars[up] / total, linked[up] / max(chars[up], 1), chars[i] / max(chars[up], 1), len(siblings), same, same / len(siblings))
        else:
            place, parent = 0, (0, 1, 0, 1, 1, 1, 1)
        size = max(chars[i], 1)
        out.append((
            GROUP.get(node.tag, -1), node.depth, chars[i], chars[i] / total, linked[i] / size, tags[i] / size, stops[i] / size,
            len(children), place, own_good, own_bad, tag_bad, *above[i], *parent, nodes[up].tag == "p", nodes[up].tag == "body",
        ))
    return out


def features(pages: list[list[Node]]) -> np.ndarray:
    """One row of numbers for each node of all pages."""
    rows = np.array([r for nodes in pages for r in node_rows(nodes)], np.float64)
    out = np.zeros((len(rows), WIDTH - 1 + len(TAG_GROUPS)))
    known = np.flatnonzero(rows[:, 0] >= 0)
    out[known, rows[known, 0].astype(int)] = 1
    out[:, len(TAG_GROUPS) :] = rows[:, 1:]
    return out


def decode(nodes: list[Node], probability: np.ndarray) -> np.ndarray:
    """The most likely keep marks under which nothing is kept below a dropped node."""
    p = np.clip(probability, 1e-6, 1 - 1e-6)
    keep, drop = np.log(p), np.log(1 - p)
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i].parent
        drop[up] += drop[i]
        keep[up] += max(keep[i], drop[i])
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and keep[i] > drop[i]
    return kept


def block_text(nodes: list[Node], kept: np.ndarray) -> str:
    """Kept text: a line for each block, character references decoded, white space inside a block as one blank."""
    lines, line = [], []

    def flush():
        if line:
            text = "".join(line)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                lines.append(text)
            line.clear()

    block = [0] * len(nodes)
    last = 0
    for i in range(1, len(nodes)):
        node = nodes[i]
        block[i] = i if node.tag in BLOCKS else block[node.parent]
        if block[i] != last:
            flush()
            last = block[i]
        if node.tag == "#text" and kept[i]:
            line.append(node.text)
        elif node.tag in ("br", "hr", "img"):
            line.append(" ")
    flush()
    return "\n".join(lines)


def own_labels(nodes: list[Node]) -> np.ndarray | None:
    """Main text marks by a page's own markup: text inside article or main and in no container of clutter."""
    inside, out = np.zeros(len(nodes), bool), np.zeros(len(nodes), bool)
    label = np.zeros(len(nodes))
    for i, node in enumerate(nodes[1:], 1):
        up = node.parent
        inside[i] = inside[up] or node.tag in ("article", "main")
        out[i] = out[up] or node.tag in CLUTTER_TAGS or (bool(node.names & CLUTTER_NAMES) and not node.names & CONTENT_NAMES)
        label[i] = inside[i] and not out[i] and node.tag == "#text" and not node.text.isspace()
    if not label.any():
        return None
    for i in range(len(nodes) - 1, 0, -1):
        label[nodes[i].parent] = max(label[nodes[i].parent], label[i])
    return label


def dressed(page: str, random: np.random.Generator) -> str:
    """The page in other clothes: its containers renamed and clutter added, marked as such by attributes that are removed later."""
    words = BLANKS.sub(" ", re.sub(r"<[^>]*>", " ", page[:20000])).split() or ["text"]

    def phrase(most: int) -> str:
        k = int(random.integers(2, most))
        start = int(random.integers(0, max(len(words) - k, 1)))
        return " ".join(words[start : start + k])

    pick = lambda *x: x[int(random.integers(len(x)))]
    links = lambda: "".join(f'<li><a href="#">{phrase(4)}</a></li>' for _ in range(int(random.integers(3, 9))))
    comment = lambda: f'<div class="{pick("comment", "reply", "x")}"><b>{phrase(3)}</b><p>{phrase(30)}</p></div>'
    drop = lambda tag, inner, *names: f'<{tag} data-x="0" class="{pick(*names, *names, "x", "")}">{inner}</{tag}>'
    clutter = [
        lambda: drop(pick("div", "nav", "header"), f"<ul>{links()}</ul>", "menu", "nav", "navbar", "top"),
        lambda: drop(pick("div", "header"), f"<a href='/'>{phrase(4)}</a><span>{phrase(6)}</span>", "header", "masthead"),
        lambda: drop(pick("div", "footer"), f"&copy; {phrase(15)} <a href='#'>{phrase(3)}</a>", "footer", "bottom", "legal"),
        lambda: drop(pick("div", "aside", "section"), f"<h3>{phrase(4)}</h3><ul>{links()}</ul><p>{phrase(12)}</p>", "sidebar", "related", "widget"),
        lambda: drop("div", f"{phrase(20)} <button>ok</button>", "cookie-notice", "notice", "banner", "alert"),
        lambda: drop("div", f"<p>{phrase(15)}</p>", "ad", "advert", "sponsored", "promo"),
        lambda: drop("div", phrase(20), "ad", "ads", "advertisement"),
        lambda: drop("form", f"<label>{phrase(5)}</label><input name=q><p>{phrase(8)}</p>", "search", "newsletter", "subscribe"),
        lambda: drop(pick("section", "div", "ol"), "".join(comment() for _ in range(int(random.integers(1, 6)))), "comments", "discussion", "replies"),
    ]
    some = lambda n: "".join(clutter[int(random.integers(len(clutter)))]() for _ in range(int(random.integers(0, n))))
    found = re.search(r"<(article|main)\b[^>]*>(.*?)</\1\s*>", page, re.S | re.I)
    if not found:
        return page
    tag = pick("article", "main", "div", "div", "section")
    names = pick("post-content", "entry", "article-body", "content", "story", "x", "")
    inner = found[2]
    if random.random() < 0.4:
        cuts = [m.start() for m in re.finditer(r"<p\b", inner)]
        if cuts:
            k = cuts[int(random.integers(len(cuts)))]
            inner = inner[:k] + "</p>" + clutter[int(random.integers(4, 7))]() + inner[k:]
    body = f'<{tag} data-x="1" class="{names}">{inner}</{tag}>'
    if random.random() < 0.5:
        body = f'<div class="{pick("wrapper", "container", "page", "main", "")}">{some(3)}{body}{some(3)}</div>'
    return f"<html><head><title>x</title></head><body>{some(4)}{body}{some(5)}</body></html>"


def training_nodes(pages: list[str], copies: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and weights of the nodes of pages and of their dressed copies. A page weighs the same whatever its size."""
    random = np.random.default_rng(seed)
    x, y, w = [], [], []

    def put(nodes, label):
        x.append(features([nodes]))
        y.append(label)
        w.append(np.full(len(nodes), 40.0 / len(nodes)))

    for page in pages:
        nodes = parse(page)
        label = own_labels(nodes)
        if label is None:
            continue
        put(nodes, label)
        for _ in range(copies):
            other = dressed(page, random)
            spans = {"0": "dropzz", "1": "keepzz"}
            nodes = parse(re.sub(r'data-x="([01])" class="', lambda m: f'class="{spans[m[1]]} ', other))
            keep, label = np.zeros(len(nodes), bool), np.zeros(len(nodes))
            for i, node in enumerate(nodes[1:], 1):
                keep[i] = (keep[node.parent] or "keepzz" in node.names) and "dropzz" not in node.names
                label[i] = keep[i] and node.tag == "#text" and not node.text.isspace()
                node.names = node.names - {"keepzz", "dropzz"}
            for i in range(len(nodes) - 1, 0, -1):
                label[nodes[i].parent] = max(label[nodes[i].parent], label[i])
            put(nodes, label)
    if not x:
        return np.zeros((0, len(TAG_GROUPS) + WIDTH - 1)), np.zeros(0), np.zeros(0)
    return np.concatenate(x), np.concatenate(y), np.concatenate(w)


def train(pages: DataFrame, key: str = "page_id", page: str = "html", max_pages: int = 250, copies: int = 3, seed: int = 3) -> Trees | None:
    """Fit trees on a sample of about ``max_pages`` pages of at most 100,000 characters. None if no page has an article."""
    usable = pages.where(F.length(page).between(1, 100_000)).select(F.col(key).alias("key"), F.col(page).cast("string").alias("page"))
    chosen = sampled(usable, "key", usable.count(), max_pages).limit(2 * max_pages).collect()  # bounded
    x, y, w = training_nodes([r["page"] for r in sorted(chosen, key=lambda r: (r["key"] is None, r["key"]))], copies, seed)
    return fit_trees(x, y, w) if len(x) and 0 < y.sum() < len(y) else None


def extract(pages: DataFrame, model: Trees | None, key: str = "page_id", page: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """(key, carried columns, text, n_chars) of every page: its main text, a line for each block.

    NULL and empty pages, and pages without text, have an empty text. Without a model nothing is known to be clutter
    except by tag, and all text outside such elements is kept.
    """

    def make():
        def step(batch):
            trees = [parse(p or "") for p in batch.column("page").to_pylist()]
            if model is None:
                marks = [np.array([0.0 if n.tag in CLUTTER_TAGS else 1.0 for n in t]) for t in trees]
            else:
                # a few hundred pages at a time, so that the features of a batch stay small
                marks = []
                for k in range(0, len(trees), 256):
                    part = trees[k : k + 256]
                    marks += np.split(model.predict(features(part)), np.cumsum([len(t) for t in part])[:-1])
            texts = [block_text(t, decode(t, p)) for t, p in zip(trees, marks)]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, *carry)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, *carry, "text", "n_chars"])

        return step

    kinds = dict(pages.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in (key, *carry)), "text string", "n_chars bigint"])
    return arrow_map(pages.select(key, *carry, F.col(page).cast("string").alias("page")), make, schema, "page")
