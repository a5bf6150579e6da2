"""Operator 5, HTML extraction: boosted trees over DOM nodes, decoded over the hierarchy.

A page is parsed into a tree; every element, block or inline, and the page itself get features: tag, tokens of class,
id and role, depth, text and tag density of the subtree, link density, punctuation, text of its own, and how it stands
among its siblings and ancestors. Gradient-boosted trees, trained here, give each node the probability that its text
is main text. Decoding is a dynamic program over the tree with three states:

* *drop*: the node and all below are boilerplate, so nothing below can be kept;
* *keep*: the node's own text is main text; each child is kept, passed or dropped (an advert or a share link inside
  a paragraph);
* *pass*: the node merely holds main text somewhere below; its own text is not taken. A node without text of its own passes free.

The cheapest assignment of the whole tree is taken, so an ancestor and a descendant never contradict: what is kept
hangs from nodes that are kept or passed. The trees are fitted on ``TRAIN_PAGES`` generated pages (a bounded, labelled,
seeded sample of varied layouts: with and without classes, semantic elements, wrappers, tables, html and body, bare text and
inline holders, and without main text), once in the driver, and travel with the tasks (under 200 kB).

A name in class or id counts by its first and last word, or as a whole that begins or ends with a telling word (``commentlist``); a name that
only describes a state or a kind (``no-sidebar``, ``has-header``, ``tag-comments``) tells nothing. What a node's name says is handed down to the nodes below,
but not from a node that holds nearly all text of the page. As a last resort, a page whose decoding keeps nothing gives its paragraphs outside of
all elements that are boilerplate by tag or name, or the text of the page itself, so an article is never lost whole.

Blocks: text is divided at block elements; white space (also a line break element) becomes one space,
blocks are trimmed, empty ones dropped, and joined by a line feed. Defined results: null or empty html,
or a page without main text, gives an empty text; repeated rows are extracted each; pages of any length
or depth are parsed whole, without recursion. Extra columns are carried if asked for; one named text or n_chars comes out
with ``_in`` behind it.
"""

from __future__ import annotations

import functools
import random
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import carried
from tidewatch.llm.tokens import blocks, column_texts

#: Production parameters of training: pages generated, trees, depth, shrinkage and bins.
TRAIN_PAGES = 700
TREES, DEPTH, SHRINK, BINS = 60, 5, 0.25, 32
SEED = 20_240_101

# Element names of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
SILENT = frozenset("script style noscript template head title textarea select option button iframe object svg canvas audio video datalist".split())
#: What a start tag closes, and where looking for it ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
ENDS_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
P_SCOPE = frozenset("button td th caption table html body article section div main aside nav footer header form li blockquote".split())
# Attribute tokens that tell of main text or of boilerplate.
GOOD_TOKENS = frozenset("article content main post entry body story text blog page prose".split())
BAD_GROUPS = [
    frozenset("ad ads advert advertisement adverts sponsor sponsored promo promotion banner adsense adbox".split()),
    frozenset("nav navbar navigation menu breadcrumb breadcrumbs topbar tabs pagination pager skip toolbar".split()),
    frozenset("footer foot copyright legal bottom colophon header masthead head top site logo brand".split()),
    frozenset("sidebar side aside widget related recommended trending popular more tags rail share social".split()),
    frozenset("cookie cookies consent gdpr notice alert modal popup overlay newsletter subscribe signup login dialog".split()),
    frozenset("comment comments reply replies respond disqus discussion reader".split()),
]
TAGS = ["article", "main", "section", "div", "p", "h", "li", "list", "table", "nav", "header", "footer", "aside", "form", "inline", "quote", "body"]
TAG_OF = {
    **{t: t for t in ("article", "main", "section", "div", "p", "nav", "header", "footer", "aside", "form", "body", "li")},
    **{f"h{i}": "h" for i in range(1, 7)}, "ul": "list", "ol": "list", "dl": "list", "menu": "list", "dt": "li", "dd": "li",
    **{t: "table" for t in ("table", "tbody", "thead", "tr", "td", "th", "tfoot", "caption")}, "fieldset": "form",
    "blockquote": "quote", "pre": "quote", "figure": "quote", "figcaption": "quote", "html": "body",
}
#: First words of names that describe a state or a kind, not a part of the page.
STATES = frozenset("no not with without has have is tag category cat page single post type format status hentry theme layout col js template logged archive author term".split())
#: A node with this share of the page's text hands nothing down.
NEARLY_ALL = 0.8
TOKEN = re.compile(r"[a-z]+")
PUNCTUATION = re.compile(r"[.,;:!?]")
FEATURES = len(TAGS) + 2 * (1 + len(BAD_GROUPS)) + 28
#: Words long enough to be recognised at either end of a name.
LONG_WORDS = tuple(sorted(w for group in (GOOD_TOKENS, *BAD_GROUPS) for w in group if len(w) >= 6))


@functools.lru_cache(maxsize=20_000)
def name_tokens(said: str) -> frozenset[str]:
    """What the names in an attribute tell: first and last words, and long words at either end of a whole name."""
    out: set[str] = set()
    for name in said.lower().split():
        words = TOKEN.findall(name)
        if not words or (len(words) > 1 and words[0] in STATES):
            continue
        out.update((words[0], words[-1]))
        out.update(w for w in LONG_WORDS if words[0].startswith(w) or words[-1].endswith(w))
    return frozenset(out)


class Tree(HTMLParser):
    """Nodes in document order: tag, parent, attribute tokens; text runs as (node, text)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.tokens = ["#root"], [-1], [frozenset()]
        self.stack = [0]
        self.opened = {"#root": 1}
        self.runs: list[tuple[int, str | None]] = []

    def _pop(self) -> None:
        node = self.stack.pop()
        tag = self.tags[node]
        self.opened[tag] -= 1
        if tag in BLOCK:
            self.runs.append((node, None))

    def _close(self, wanted, scope) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tags[self.stack[depth]]
            if tag in wanted:
                while len(self.stack) > depth:
                    self._pop()
                return
            if tag in scope:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P and self.opened.get("p"):
            self._close({"p"}, P_SCOPE)
        if tag in CLOSES and any(self.opened.get(t) for t in CLOSES[tag][0]):
            self._close(*CLOSES[tag])
        if tag in BLOCK:
            self.runs.append((self.stack[-1], None))
        if tag in VOID:
            self.runs.append((self.stack[-1], " "))
            return
        said = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "itemprop", "aria-label")) if attrs else ""
        self.tags.append(tag)
        self.parents.append(self.stack[-1])
        self.tokens.append(name_tokens(said) if len(said) <= 300 else name_tokens.__wrapped__(said))
        self.stack.append(len(self.tags) - 1)
        self.opened[tag] = self.opened.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.tags[self.stack[-1]] == tag:
            self._pop()

    def handle_endtag(self, tag):
        if self.opened.get(tag):
            self._close({tag}, ())

    def handle_data(self, data):
        self.runs.append((self.stack[-1], data))


def parse(html: str) -> Tree:
    tree = Tree()
    tree.feed(html)
    tree.close()
    while len(tree.stack) > 1:
        tree._pop()
    return tree


def features(tree: Tree) -> np.ndarray:
    """One row of figures for each node, the page itself first."""
    n = len(tree.tags)
    parents = tree.parents
    own, links, stops, first = [0] * n, [0] * n, [0] * n, [-1] * n
    silent, in_link, depth = [False] * n, [False] * n, [0] * n
    holder = [0] * n  # the block that holds an inline element
    for i in range(1, n):
        p, tag = parents[i], tree.tags[i]
        silent[i] = silent[p] or tag in SILENT
        in_link[i] = in_link[p] or tag == "a"
        depth[i] = depth[p] + 1
        holder[i] = i if tag in BLOCK else holder[p]
    total = 0
    held = [0] * n
    for node, text in tree.runs:
        if text and not silent[node]:
            size = len(text.strip())
            if size and first[node] < 0:
                first[node] = total
            own[node] += size
            held[holder[node]] += size
            total += size
            stops[node] += len(PUNCTUATION.findall(text))
            if in_link[node]:
                links[node] += size
    text, link, stop, count, paras, kids, starts = own[:], links[:], stops[:], [1] * n, [0] * n, [0] * n, first[:]
    largest = [0] * n
    for i in range(n - 1, 0, -1):
        p = parents[i]
        text[p] += text[i]
        link[p] += link[i]
        stop[p] += stop[i]
        count[p] += count[i]
        paras[p] += paras[i] + (tree.tags[i] == "p")
        kids[p] += 1
        largest[p] = max(largest[p], text[i])
        if starts[i] >= 0 and (starts[p] < 0 or starts[i] < starts[p]):
            starts[p] = starts[i]
    out = np.zeros((n, FEATURES), dtype=np.float32)
    lists = [GOOD_TOKENS, *BAD_GROUPS]
    place, seen = [0] * n, [0] * n
    above = np.zeros((n, len(lists)), dtype=np.float32)
    base = len(TAGS)
    total = max(total, 1)
    figures = base + 2 * len(lists)
    flags = {k: j for j, k in enumerate(("nav", "header", "footer", "aside", "form", "article", "main"))}
    inside = [0] * n
    # what the page offers: semantic elements, named holders, the longest text held by one block
    semantic = float(any(t in ("article", "main") for t in tree.tags))
    named = float(any(k & GOOD_TOKENS for k in tree.tokens))
    longest = max(max(held), 1)
    out[0, TAGS.index("body")] = 1
    for i in range(n):
        p, tag = parents[i], tree.tags[i]
        if i:
            place[i] = seen[p]
            seen[p] += 1
            out[i, TAGS.index(TAG_OF.get(tag, "inline"))] = 1
            if tree.tokens[i]:
                for j, group in enumerate(lists):
                    if tree.tokens[i] & group:
                        out[i, base + j] = 1
            if tree.tags[p] not in ("html", "body") and text[p] < NEARLY_ALL * total:
                above[i] = np.maximum(above[p], out[p, base : base + len(lists)])
            elif text[p] < NEARLY_ALL * total:
                above[i] = above[p]
            out[i, base + len(lists) : figures] = above[i]
            inside[i] = inside[p] | (1 << flags[tree.tags[p]] if tree.tags[p] in flags else 0)
        t, up = text[i], text[p] if i else text[0]
        h = holder[i]
        out[i, figures:] = (
            min(depth[i], 30), np.log1p(t), np.log1p(own[i]), link[i] / t if t else 0.0, count[i] / (t + 1), stop[i] / (t + 1), np.log1p(paras[i]),
            t / (up or 1), t / total, place[i] / max(kids[p] - 1, 1) if i else 0.0, min(kids[p], 50) if i else 0, max(starts[i], 0) / total, (max(starts[i], 0) + t) / total,
            inside[i] & 1, inside[i] >> 1 & 3, inside[i] >> 3 & 3, inside[i] >> 5 & 3, float(silent[i]),
            np.log1p(held[h]), held[h] / longest, link[h] / text[h] if text[h] else 0.0, float(in_link[i]), t / (largest[p] or 1) if i else 1.0, semantic, named, np.log1p(total), (text[p] - t) / total if i else 0.0,
            float(inside[i] & 4 and inside[i] & 96),
        )
    return out


class BoostedTrees:
    """Logistic boosting with histogram splits; complete trees stored as arrays."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, shrink: float = SHRINK, bins: int = BINS):
        self.n, self.depth, self.shrink, self.bins = trees, depth, shrink, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        rows, cols = x.shape
        self.edges = [np.unique(np.quantile(x[:, c], np.linspace(0, 1, self.bins)[1:-1])) for c in range(cols)]
        coded = np.stack([np.searchsorted(e, x[:, c], side="left") for c, e in enumerate(self.edges)], axis=1)
        nodes = 2**self.depth - 1
        self.feature = np.zeros((self.n, nodes), dtype=np.int32)
        self.cut = np.full((self.n, nodes), np.inf, dtype=np.float32)
        self.leaf = np.zeros((self.n, 2**self.depth))
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(rate / (1 - rate)))
        score = np.full(rows, self.bias)
        flat = coded + np.arange(cols) * self.bins
        for t in range(self.n):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p) + 1e-6
            at = np.zeros(rows, dtype=np.int64)
            for level in range(self.depth):
                for node in range(2**level - 1, 2 ** (level + 1) - 1):
                    mine = np.flatnonzero(at == node)
                    if len(mine) < 20:
                        continue
                    cells = flat[mine].ravel()
                    g = np.bincount(cells, np.repeat(grad[mine], cols), cols * self.bins).reshape(cols, self.bins).cumsum(1)
                    h = np.bincount(cells, np.repeat(hess[mine], cols), cols * self.bins).reshape(cols, self.bins).cumsum(1)
                    gain = g**2 / (h + 1) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1)
                    gain[(h < 0.5) | (h[:, -1:] - h < 0.5)] = -1
                    c, b = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[c, b] <= g[0, -1] ** 2 / (h[0, -1] + 1) + 1e-9 or b >= len(self.edges[c]):
                        continue
                    self.feature[t, node], self.cut[t, node] = c, self.edges[c][b]
                at = 2 * at + 1 + (x[np.arange(rows), self.feature[t, at]] > self.cut[t, at])
            at -= nodes
            g = np.bincount(at, grad, 2**self.depth)
            h = np.bincount(at, hess, 2**self.depth)
            self.leaf[t] = self.shrink * g / (h + 1)
            score += self.leaf[t, at]
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        score = np.full(len(x), self.bias)
        for t in range(self.n):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.cut[t, at])
            score += self.leaf[t, at - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-score))


def decode(tree: Tree, probability: np.ndarray) -> list[bool]:
    """Whether each node's own text is main text: the cheapest consistent assignment of the tree."""
    n = len(tree.tags)
    p = np.clip(probability, 1e-4, 1 - 1e-4)
    yes, no = (-np.log(p)).tolist(), (-np.log(1 - p)).tolist()
    spoken = [False] * n
    for node, text in tree.runs:
        if text and not spoken[node] and text.strip():
            spoken[node] = True
    # what speaks for itself has its say; a node without text of its own passes free
    drop = no[:]
    keep = [y if s else float("inf") for y, s in zip(yes, spoken, strict=True)]
    free = [x if s else 0.0 for x, s in zip(no, spoken, strict=True)]
    for i in range(n - 1, 0, -1):
        q = tree.parents[i]
        if tree.tags[i] in SILENT:
            keep[i] = free[i] = float("inf")
        drop[q] += drop[i]
        best = min(keep[i], free[i], drop[i])
        keep[q] += best
        free[q] += best
    state = [0] * n  # 0 drop, 1 keep, 2 pass
    state[0] = 1 if keep[0] <= free[0] else 2
    for i in range(1, n):
        if state[tree.parents[i]]:
            best = min(keep[i], free[i], drop[i])
            state[i] = 1 if keep[i] == best else 2 if free[i] == best else 0
    return [s == 1 for s in state]


def main_text(tree: Tree, kept: list[bool]) -> str:
    """Kept text by blocks, in page order."""
    out: list[str] = []
    now: list[str] = []
    for node, text in tree.runs:
        if text is None:
            if now:
                out.append(" ".join("".join(now).split()))
                now = []
        elif kept[node]:
            now.append(text)
    if now:
        out.append(" ".join("".join(now).split()))
    return "\n".join(b for b in out if b)


def last_resort(tree: Tree, kept: list[bool]) -> list[bool]:
    """Where nothing is kept: the paragraphs outside of all that is boilerplate by tag or name, or else the text of the page or body itself."""
    if any(kept[node] for node, text in tree.runs if text and text.strip()):
        return kept
    n = len(tree.tags)
    text, link, bad, para = [0] * n, [0] * n, [False] * n, [False] * n
    for node, said in tree.runs:
        text[node] += len(said.strip()) if said else 0
    for i in range(n - 1, 0, -1):
        text[tree.parents[i]] += text[i]
        link[i] += text[i] if tree.tags[i] == "a" else 0
        link[tree.parents[i]] += link[i]
    worst = frozenset().union(*BAD_GROUPS)
    for i in range(1, n):
        p, tag = tree.parents[i], tree.tags[i]
        named = bool(tree.tokens[i] & worst) and tag not in ("html", "body", "article", "main") and text[i] < NEARLY_ALL * max(text[0], 1)
        bad[i] = bad[p] or named or tag in SILENT or tag in ("nav", "footer", "aside", "label", "button")
        bad[i] |= tag in ("form", "header") and text[i] < NEARLY_ALL * max(text[0], 1)
        para[i] = not bad[i] and (para[p] or (tag == "p" and 2 * link[i] < text[i]))
    if not any(para):
        own = {node for node, said in tree.runs if said and said.strip()}
        for i in range(n):
            whole = tree.tags[i] in ("#root", "html", "body") and i in own
            para[i] = whole or (i > 0 and para[tree.parents[i]] and not bad[i] and tree.tags[i] not in BLOCK and tree.tags[i] != "a")
    return para


def _words(rng: random.Random, n: int) -> str:
    syllables = "ta re mi on the shi lor ven qua et des com pli no ra ü ción é"
    parts = syllables.split()
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    for i in range(0, n, 9):
        out[i] = out[i].capitalize()
        out[i - 1] += rng.choice([".", ".", ",", "?"])
    return " ".join(out)


def training_page(rng: random.Random) -> str:
    """A generated page: elements that hold main text carry ``data-y="1"``, elements of boilerplate ``data-y="0"``; a
    holder without text of its own is marked as what it holds. ``data-r`` marks the text outside of all elements."""
    good, bad = ' data-y="1"', ' data-y="0"'
    plain = rng.random() < 0.35  # pages that name nothing

    def named(*names: str) -> str:
        return "" if plain or rng.random() > 0.85 else f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}"'

    def links(n: int) -> str:
        return "".join(f'<li{bad}><a{bad} href="/x">{_words(rng, rng.randint(1, 3))}</a></li>' for _ in range(n))

    def advert() -> str:
        kind = f' class="{rng.choice(["ad", "ads", "advert", "sponsored", "promo", "ad-banner", "advertisement"])}"'
        tag = rng.choice(["div", "div", "div", "section", "p"])
        inner = _words(rng, rng.randint(2, 30)) if rng.random() < 0.7 or tag == "p" else f"<p{bad}>{_words(rng, rng.randint(3, 30))}</p>"
        return f"<{tag}{bad}{kind}>{inner}</{tag}>"

    def notice() -> str:
        kind = f' {rng.choice(["class", "id"])}="{rng.choice(["cookie-notice", "cookie", "consent", "newsletter", "notice", "popup", "alert"])}"'
        return f'<div{bad}{kind}><p{bad}>{_words(rng, rng.randint(5, 25))}</p><button{bad}>{_words(rng, 1)}</button></div>'

    def form() -> str:
        return f'<form{bad}{named("search", "login", "subscribe")}><label{bad}>{_words(rng, 2)}</label><input><button{bad}>{_words(rng, 1)}</button></form>'

    def aside() -> str:
        tag = rng.choice(["aside", "aside", "div"])
        kind = named("sidebar", "related", "widget", "side", "trending") if tag == "aside" else f' class="{rng.choice(["sidebar", "related", "widget", "rail"])}"'
        inner = rng.choice([f'<h3{bad}>{_words(rng, 2)}</h3><ul{bad}>{links(4)}</ul>', f'<p{bad}>{_words(rng, rng.randint(5, 40))}</p>'])
        return f"<{tag}{bad}{kind}>{inner}</{tag}>"

    def comments() -> str:
        each = "".join(f'<div{bad} class="comment"><p{bad}>{_words(rng, rng.randint(5, 60))}</p></div>' for _ in range(rng.randint(1, 5)))
        if rng.random() < 0.3:
            each = "".join(f"<li{bad}>{_words(rng, 2)}<p{bad}>{_words(rng, rng.randint(5, 60))}</p></li>" for _ in range(rng.randint(1, 5)))
            return f'<{(t := rng.choice(["ol", "ul"]))}{bad} class="{rng.choice(["commentlist", "comment-list", "comments"])}">{each}</{t}>'
        return f'<{(t := rng.choice(["section", "div"]))}{bad}{" " + rng.choice(["class", "id"])}="{rng.choice(["comments", "comment-list", "respond", "discussion", "comments-area"])}">{each}</{t}>'

    def share() -> str:
        kind = f' class="{rng.choice(["share", "share-link", "social", "ad", "sponsored", "promo"])}"'
        tag = rng.choice(["a", "span", "a"])
        return f'<{tag}{bad}{kind}>{_words(rng, rng.randint(1, 6))}</{tag}>'

    def inline(text: str) -> str:
        tag = rng.choice(["b", "i", "em", "strong", "span", "code", "font", "u", "mark", "a"])
        return f"<{tag}{good}>{text}</{tag}>"

    def paragraph() -> str:
        kind = rng.random()
        text = _words(rng, int(np.exp(rng.uniform(1, 5.5))))
        if kind < 0.08:
            listed = rng.choice(["ul", "ol"])
            items = "".join(f"<li{good}>{_words(rng, rng.randint(3, 20))}</li>" for _ in range(3))
            return f"<{listed}{good}>{items}</{listed}>"
        if kind < 0.13:
            tag = rng.choice(["h2", "h3", "h4"])
            return f"<{tag}{good}>{_words(rng, rng.randint(2, 6))}</{tag}>"
        if kind < 0.17:
            return f"<blockquote{good}>{text}</blockquote>" if rng.random() < 0.6 else f"<blockquote{good}><p{good}>{text}</p></blockquote>"
        if kind < 0.21:
            return f"<table{good}><tr{good}><td{good}>{_words(rng, 3)}</td><td{good}>{_words(rng, 4)}</td></tr></table>"
        if kind < 0.3:
            return f"<p{good}><b{good}>{text}<br>"
        if kind < 0.42:
            return f'<p{good}>{text} <a{good} href="/y">{_words(rng, 3)}</a> {_words(rng, 5)}</p>'
        if kind < 0.48:
            return f"<p{good}>{text} {inline(_words(rng, rng.randint(1, 8)))} {_words(rng, 4)}</p>"
        if kind < 0.52:
            return f"<p{good}>{text} {share()}</p>"
        if kind < 0.56:
            return f"<div{good}>{text}</div>"
        if kind < 0.59:
            return f"<p{good}><span{good}>{text}</span></p>"
        if kind < 0.61:
            return f"<pre{good}>{text}</pre>"
        if kind < 0.64:
            return f"<figure{good}><figcaption{good}>{_words(rng, rng.randint(3, 14))}</figcaption></figure>"
        return f"<p{good}>{text}</p>"

    def content(bare: bool, headed: bool) -> str:
        """The blocks of the article; ``bare`` ones are text with line breaks, or inline elements, in the holder itself."""
        inner = [f"<{(h := rng.choice(['h1', 'h1', 'h2']))}{good}>{_words(rng, rng.randint(3, 14))}</{h}>"] * (rng.random() < 0.75)
        if inner and headed and rng.random() < 0.3:
            inner = [f"<header{good}{named('entry-header', 'header', 'post-header')}>{inner[0]}</header>"]
        if headed and rng.random() < 0.08:  # an overview: linked titles are what the page is about
            titles = "".join(f'<li{good}><a{good} href="/t">{_words(rng, rng.randint(3, 9))}</a></li>' for _ in range(rng.randint(3, 8)))
            return "".join(inner) + f"<ul{good}>{titles}</ul>"
        for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 9, 12])):
            text = _words(rng, int(np.exp(rng.uniform(2.5, 5.5))))
            inner.append(paragraph() if not bare else rng.choice([text + "<br><br>", text + "<br>", inline(text) + " ", f"{text} {inline(_words(rng, 3))} {text}<br>", f"<p{good}>{text}</p>"]))
            if rng.random() < 0.07:
                inner.append(rng.choice([advert, aside, form, notice, share])())
        return "".join(inner)

    def headed_list(body: str) -> bool:
        return "<ul" in body and "<p" not in body

    def article() -> tuple[str, bool]:
        """The main part, and whether it lies in the body itself."""
        style = rng.random()
        bare = rng.random() < (0.45 if style >= 0.8 else 0.12)
        body = content(bare, style < 0.5)
        if style < 0.5:
            tag, kind = rng.choice([("article", ""), ("article", ""), ("article", named("post", "story", "entry", "post tag-comments category-notice")), ("main", ""), ("div", named("content", "article-body", "post", "entry-content", "main", "story")), ("section", named("content", "article", "main"))])
            if headed_list(body) and tag == "div" and not kind:
                kind = ' class="content"'
            if rng.random() < 0.2:
                body = f"<div{good}{named('text', 'body', 'inner')}>{body}</div>"
            return f"<{tag}{good}{kind}>{body}</{tag}>", False
        if style < 0.72:
            for _ in range(rng.choice([1, 1, 2, 3])):
                tag = rng.choice(["div", "div", "section", "center"])
                body = f"<{tag}{good}>{body}</{tag}>"
            return body, False
        if style < 0.8:
            return f"<table{good}><tr{good}><td{good}>{body}</td></tr></table>", False
        if style < 0.87:
            return f"<span{good}>{body}</span>", True
        return body, True

    head = f"<head><title>{_words(rng, 5)}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head>"
    busy = rng.choice([0.0, 0.4, 0.9, 0.9])  # how much surrounds the article
    before, after = [], []
    shape = rng.random()
    if shape < 0.6:
        nav = f'<nav{bad}><ul{bad}>{links(rng.randint(3, 9))}</ul></nav>'
    elif shape < 0.85:
        nav = f'<div{bad} class="{rng.choice(["menu", "navbar", "navigation", "breadcrumbs"])}"><ul{bad}>{links(rng.randint(3, 9))}</ul></div>'
    elif shape < 0.93:
        nav = f"<ul{bad}>{links(rng.randint(3, 9))}</ul>"
    else:
        nav = f"<div{bad}>" + " | ".join(f'<a{bad} href="/z">{_words(rng, rng.randint(1, 2))}</a>' for _ in range(rng.randint(3, 7))) + "</div>"
    if rng.random() < busy:
        before.append(nav)
    if rng.random() < 0.45 * busy:
        before.insert(0, f'<header{bad}{named("site-header", "top", "masthead")}><a{bad} href="/">{_words(rng, 2)}</a><p{bad}>{_words(rng, 6)}</p></header>')
    for part in (advert, advert, notice, form):
        if rng.random() < 0.45 * busy:
            rng.choice([before, after]).append(part())
    for part in (aside, comments):
        if rng.random() < 0.45 * busy:
            after.append(part())
    if rng.random() < busy:
        tag = rng.choice(["footer", "footer", "div"])
        kind = "" if tag == "footer" else f' class="{rng.choice(["footer", "site-footer", "copyright"])}"'
        said = f"&copy; {_words(rng, rng.randint(3, 30))}"
        after.append(f"<{tag}{bad}{kind}>" + (said if rng.random() < 0.6 else f"<p{bad}>{said if rng.random() < 0.3 else _words(rng, rng.randint(4, 25))}</p>") + f"</{tag}>")
    main, in_body = ("", False) if rng.random() < 0.03 else article()
    if main and not in_body and rng.random() < 0.25:
        main = f'<div data-y="1"{named("wrapper", "container", "page", "row")}>{main}{aside() if rng.random() < 0.5 else ""}</div>'
    whole = f"{''.join(before)}{main}{''.join(after)}"
    mark = good if in_body or main else bad
    if main and rng.random() < 0.04:  # pages whose whole body is one form
        whole = f'<form{good}{named("aspnetForm", "form1", "mainform")}>{whole}</form>'
    frame = rng.random()
    if frame < 0.17:  # a fragment
        return f"<!--r{int(bool(main))}-->{whole}"
    state = "" if rng.random() < 0.6 else f' class="{rng.choice(["single no-sidebar", "page with-sidebar has-header", "home blog", "sidebar-right", "has-ads logged-in", "cookie-accepted"])}"'
    if frame < 0.25:
        return f"<body{mark}{state}>{whole}</body>"
    return f"<!DOCTYPE html><html>{head}<body{mark}{state}>{whole}</body></html>"


class _Labelled(Tree):
    """Also reads the training labels; the page itself is main text where a fragment says so."""

    def __init__(self):
        super().__init__()
        self.labels = [0]

    def handle_comment(self, data):
        if data in ("r0", "r1"):
            self.labels[0] = int(data[1])

    def handle_starttag(self, tag, attrs):
        known = len(self.tags)
        mark = dict(attrs).pop("data-y", None)
        super().handle_starttag(tag, attrs)
        if len(self.tags) > known:
            self.labels.append(0 if mark is None else int(mark))


def training_rows(pages: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of generated pages; unmarked nodes hold no text that is wanted: not main text.

    Only nodes with text in their subtree count, and the page itself only in fragments: a node without any is never asked.
    """
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        html = training_page(rng)
        tree = _Labelled()
        tree.feed(html)
        tree.close()
        while len(tree.stack) > 1:
            tree._pop()
        x, y = features(tree), np.array(tree.labels)
        asked = np.array([k > 0 or html.startswith("<!--r") for k in range(len(y))]) & (x[:, len(TAGS) + 2 * (1 + len(BAD_GROUPS)) + 1] > 0)
        xs.append(x[asked])
        ys.append(y[asked] == 1)
    return np.concatenate(xs), np.concatenate(ys).astype(float)


@functools.lru_cache(maxsize=1)
def model() -> BoostedTrees:
    """The trees, fitted once in the driver on a bounded sample."""
    return BoostedTrees().fit(*training_rows(TRAIN_PAGES))


def extract(pages: list[str], trees: BoostedTrees) -> list[str]:
    """Main texts of some pages; nodes of all are scored together."""
    parsed = [parse(h) for h in pages]
    rows = [features(t) for t in parsed]
    scores = trees.probability(np.concatenate(rows))
    out, at = [], 0
    for tree, mine in zip(parsed, rows, strict=True):
        out.append(main_text(tree, last_resort(tree, decode(tree, scores[at : at + len(mine)]))))
        at += len(mine)
    return out


def extract_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html", trees: BoostedTrees | None = None) -> DataFrame:
    """Columns ``keep`` with the main text of each page and its code points."""
    trees = trees or model()
    source = pages.select(*carried(keep, ["text", "n_chars"]), F.coalesce(F.col(html), F.lit("")).alias("__html"))
    keep = tuple(source.columns[:-1])

    def extracted(batches):
        for batch in batches:
            texts: list[str] = []
            for block in blocks(column_texts(batch, "__html"), 400_000):
                texts += extract(block, trees)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return source.mapInArrow(extracted, T.StructType([source.schema[k] for k in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
