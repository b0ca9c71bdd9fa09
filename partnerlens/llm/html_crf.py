"""Op 8: main text of web pages by a linear-chain conditional random field.

A page is parsed into its leaf blocks (runs of text between block-level tags).
Each block has features of its ancestors (tags, class and id words) and of its
text (length, link share, punctuation); the labels along a page, main text or
not, form a chain whose weights are trained by maximum likelihood and whose
best sequence Viterbi finds.

Training pages are labelled by structure: on pages with an article or main
element, what lies in it (and in no menu, notice, comment and so on inside it)
is main text.  TRAIN_PAGES of them are taken, the least by a hash of the id,
each also re-set in other common page layouts so that the weights do not hang
on one site's markup.  Where no page has such an element, the blocks of other
pages that read like prose are re-set in those layouts, and the fit sees these
alone.  This bounded sample serves the fit alone; every page is parsed and
decoded whole, in time linear in its length however deep its elements nest:
a block holds a link to its element, elements link to their parents, and the
features name the DEPTH innermost ancestors (that any ancestor is main text or
beside it is handed down from parent to child)."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TRAIN_PAGES = 150
FEATURES = 1 << 14
EPOCHS = 6
RATE = 0.3
L2 = 1e-4
DEPTH = 32                    # ancestors whose tags and names are features
PROSE_WORDS = 10              # a block of so many words reads like prose

# fixed values: HTML element names by role
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noframes noscript
ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul""".split())
SILENT = set("script style template noscript iframe svg math object canvas audio video".split())
# what closes an open <p>, <li> and so on without an end tag
CLOSES_P = BLOCK - {"br", "option", "optgroup", "body", "html", "head"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPE = set("article aside body div footer form header html li main nav section table td th ul ol blockquote dl".split())
MAIN = {"article", "main"}
BESIDE = set("nav header footer aside form button select textarea menu dialog figure title head".split())
BESIDE_WORDS = set("""ad ads advert advertisement adverts banner promo promoted sponsor sponsored comment comments reply
replies respond sidebar widget menu nav navbar breadcrumb breadcrumbs footer header masthead cookie cookies consent notice
alert popup modal newsletter subscribe signup share social related recommended login search pagination pager toolbar""".split())
_WORD = re.compile(r"[a-z]+|\d+")


class Node:
    """An open element: its tag, class and id words, and what it hands down."""

    __slots__ = ("tag", "words", "parent", "main", "clean", "beside", "named", "outer", "block", "reset", "memo")

    def __init__(self, tag: str, words: tuple[str, ...], parent: "Node | None", reset: bool = False):
        self.tag, self.words, self.parent, self.memo = tag, words, parent, None
        self.main = tag in MAIN or (parent is not None and parent.main)
        # nothing beside the main text since the innermost main element
        self.clean = tag in MAIN or (parent is not None and parent.clean and tag not in BESIDE)
        self.beside = tag in BESIDE or (parent is not None and parent.beside)
        self.named = any(w in BESIDE_WORDS for w in words) or (parent is not None and parent.named)
        self.outer = tag if tag in SCOPE else parent.outer if parent else ""
        self.block = tag if tag in BLOCK else parent.block if parent else ""
        self.reset = reset or (parent is not None and parent.reset)

    def names(self) -> frozenset[str]:
        """Features of the element and its nearest ancestors, the same for all its blocks."""
        if self.memo is None:
            out, at = set(), self
            for _ in range(DEPTH):
                out.add(f"tag={at.tag}")
                out.update(f"name={w}" for w in at.words)
                at = at.parent
                if at is None:
                    break
            self.memo = frozenset(out | {f"outer={self.outer}", f"own={self.block}", f"own={self.block}/{self.outer}",
                                         f"main={self.main}", f"beside={self.beside}", f"besidename={self.named}"})
        return self.memo


class Leaf:
    """A run of text, the element that holds it (None: no open element) and
    how many of its characters lie in links."""

    __slots__ = ("text", "node", "linked")

    def __init__(self, text: str, node: Node | None, linked: int):
        self.text, self.node, self.linked = text, node, linked


_NOWHERE = Node("", (), None)
_NOWHERE.memo = frozenset({"outer=", "own=", "own=/", "main=False", "beside=False", "besidename=False"})
RESET = "data-reset"  # attribute of main text in re-set pages


class _Parser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[Node] = []
        self.open: Counter[str] = Counter()            # open elements by tag
        self.scopes: list[Counter[str]] = [Counter()]  # the same since each open scope element, itself included
        self.leaves: list[Leaf] = []
        self.buffer: list[str] = []
        self.linked = self.silent = 0

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        if text:
            self.leaves.append(Leaf(text, self.stack[-1] if self.stack else None, self.linked))
        self.buffer, self.linked = [], 0

    def _pop_through(self, names: set[str]) -> None:
        """Closes all elements up to the innermost of these, which is open."""
        i = len(self.stack) - 1
        while self.stack[i].tag not in names:
            i -= 1
        if any(n.tag in BLOCK for n in self.stack[i:]):
            self.flush()
        for _ in range(len(self.stack) - i):
            tag = self.stack.pop().tag
            self.open[tag] -= 1
            self.silent -= tag in SILENT
            self.scopes[-1][tag] -= 1
            if tag in SCOPE:
                self.scopes.pop()

    def _close(self, names: set[str]) -> None:
        if any(self.scopes[-1][t] > 0 for t in names):
            self._pop_through(names)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
        if tag in CLOSES_P:
            self._close({"p"})
        if tag in SELF_CLOSING:
            self._close(SELF_CLOSING[tag])
        if tag in VOID:
            return
        words = [w for k, v in attrs if k in ("class", "id", "role") and v for w in _WORD.findall(v.lower())]
        self.stack.append(Node(tag, tuple(words), self.stack[-1] if self.stack else None, any(k == RESET for k, _ in attrs)))
        if tag in SCOPE:
            self.scopes.append(Counter())
        self.scopes[-1][tag] += 1
        self.open[tag] += 1
        self.silent += tag in SILENT

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math", "path"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.open[tag] > 0:
            self._pop_through({tag})
        elif tag in BLOCK:
            self.flush()

    def handle_data(self, data):
        if not self.silent:
            self.buffer.append(data)
            if self.open["a"] > 0:
                self.linked += len(data)


def leaves(html: str | None) -> list[Leaf]:
    """Leaf blocks of a whole page in page order; scripts, styles and comments
    give none.  Null and empty pages have none."""
    if not html:
        return []
    p = _Parser()
    p.feed(html)
    p.close()
    p.flush()
    return p.leaves


def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % FEATURES


def features(page: list[Leaf]) -> list[np.ndarray]:
    """Feature numbers of every block of a page."""
    out, memo = [], {}
    for leaf in page:
        n = len(leaf.text)
        words = leaf.text.count(" ") + 1
        names = (leaf.node or _NOWHERE).names() | {
            "bias", f"words={min(words.bit_length(), 7)}", f"link={min(4, 5 * leaf.linked // max(n, 1))}",
            f"end={leaf.text[-1] in '.!?…”'}", f"sign={leaf.text[0] in '©®|'}"}
        out.append(np.array(sorted({memo[x] if x in memo else memo.setdefault(x, _slot(x)) for x in names})))
    return out


def label(leaf: Leaf) -> int:
    """Structure's own label: 1 in an article or main element and in nothing
    beside the main text there."""
    node = leaf.node or _NOWHERE
    return int(node.main and node.clean and not node.named)


def prose(leaf: Leaf) -> bool:
    """Whether a block of a page without article and main reads like prose."""
    node = leaf.node or _NOWHERE
    return (not node.beside and not node.named and leaf.text.count(" ") + 1 >= PROSE_WORDS
            and 2 * leaf.linked < len(leaf.text))


def layouts(page: list[Leaf], seed: int, is_main=None) -> str:
    """The page's texts re-set in another common layout; ``is_main`` tells its
    main text blocks.  The element of the main text has the attribute RESET,
    which no feature sees."""
    is_main = is_main or label
    r = np.random.default_rng(seed)
    pick = lambda *x: x[int(r.integers(len(x)))]
    body = [escape(x.text) for x in page if is_main(x)] or ["."]
    side = [escape(x.text) for x in page if not is_main(x)] or ["menu"]
    few = lambda k: [side[int(r.integers(len(side)))] for _ in range(k)]
    paragraphs = "".join(f"<{t}>{x}</{t}>" for x in body for t in [pick("p", "p", "p", "div", "h2", "li", "blockquote", "pre")])
    a, b = pick(("article", ""), ("main", ""), ("div", "content"), ("div", "post body"), ("section", "entry content"), ("div", "story"),
                ("div", "article text"), ("td", "main"))
    links = "".join(f'<li><a href="/{i}">{x}</a></li>' for i, x in enumerate(few(5)))
    notes = lambda tag, name: f'<{tag} class="{name}">' + "".join(f"<p>{x}</p>" for x in few(int(r.integers(1, 4))) + [pick(*body)]) + f"</{tag}>"
    inside = pick("", notes("div", pick("ad", "advert", "promo")), notes("aside", "related"), notes("section", "comments"))
    after = [notes("div", "comments"), notes("section", "reader comment"), notes("div", "sidebar"), notes("aside", "widget"),
             notes("div", "cookie notice"), notes("div", "newsletter signup"), f"<form><label>{few(1)[0]}</label><button>{few(1)[0]}</button></form>",
             notes("div", "ad banner"), notes("footer", "site footer"), notes("div", "related")]
    r.shuffle(after)
    return (f"<html><head><title>{few(1)[0]}</title></head><body>" + pick(f"<nav><ul>{links}</ul></nav>", f'<ul class="menu">{links}</ul>',
            f"<header><h1>{few(1)[0]}</h1><ul>{links}</ul></header>") + notes("div", "notice") * int(r.integers(2))
            + f'<{a} class="{b}" {RESET}>{paragraphs}{inside}</{a}>' + "".join(after[:5]) + "</body></html>")


def labelled(html: str | None, seed: int) -> list[tuple[list[np.ndarray], list[int]]]:
    """Training sequences of a page: as it is, and re-set in two layouts.  Of a
    page without article and main only the latter, if some block reads like
    prose."""
    page = leaves(html)
    marked = any(label(x) for x in page)
    if not marked and not any(prose(x) for x in page):
        return []
    out = [(features(page), [label(x) for x in page])] if marked else []
    for k in range(2):
        other = leaves(layouts(page, 2 * seed + k, label if marked else prose))
        truth = [int(n.reset and not n.named and not n.beside) for x in other for n in [x.node or _NOWHERE]]
        out.append((features(other), truth))
    return out


class Crf:
    """weight (FEATURES x 2), move (2 x 2) and start (2), all as scores."""

    def __init__(self, weight=None, move=None, start=None):
        self.weight = np.zeros((FEATURES, 2)) if weight is None else weight
        self.move = np.zeros((2, 2)) if move is None else move
        self.start = np.zeros(2) if start is None else start

    def scores(self, feats: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weight[f].sum(axis=0) for f in feats])

    def marginals(self, s: np.ndarray):
        """Posterior per block and per pair of neighbours, and log Z."""
        n = len(s)
        a, b = np.empty((n, 2)), np.zeros((n, 2))
        a[0] = self.start + s[0]
        for t in range(1, n):
            a[t] = s[t] + np.logaddexp(*(a[t - 1][:, None] + self.move))
        for t in range(n - 2, -1, -1):
            b[t] = np.logaddexp(*(self.move + s[t + 1] + b[t + 1]).T)
        z = np.logaddexp(*a[-1])
        pair = a[:-1, :, None] + self.move + (s + b)[1:, None, :] - z
        return np.exp(a + b - z), np.exp(pair), z

    def fit(self, data: list[tuple[list[np.ndarray], list[int]]], epochs: int = EPOCHS) -> "Crf":
        """Stochastic gradient ascent of the log-likelihood, adaptive rates."""
        past = [np.full(x.shape, 1e-6) for x in (self.weight, self.move, self.start)]
        rng = np.random.default_rng(1)
        for _ in range(epochs):
            for i in rng.permutation(len(data)):
                feats, truth = data[i]
                if not feats:
                    continue
                node, pair, _ = self.marginals(self.scores(feats))
                y = np.eye(2)[truth]
                gap = y - node
                rows = np.concatenate(feats)
                grad = np.zeros_like(self.weight)
                np.add.at(grad, rows, np.repeat(gap, [len(f) for f in feats], axis=0))
                used = np.unique(rows)
                g = grad[used] - L2 * self.weight[used]
                past[0][used] += g ** 2
                self.weight[used] += RATE * g / np.sqrt(past[0][used])
                seen = np.einsum("ti,tj->ij", y[:-1], y[1:])
                for k, (param, g) in enumerate([(self.move, seen - pair.sum(axis=0)), (self.start, gap[0])], 1):
                    g = g - L2 * param
                    past[k] += g ** 2
                    param += RATE * g / np.sqrt(past[k])
        return self

    def decode(self, feats: list[np.ndarray]) -> list[int]:
        """Most probable label sequence (Viterbi); ties go to label 0."""
        if not feats:
            return []
        s = self.scores(feats)
        best, back = self.start + s[0], []
        for t in range(1, len(s)):
            way = best[:, None] + self.move
            back.append(way.argmax(axis=0))
            best = way.max(axis=0) + s[t]
        out = [int(best.argmax())]
        for p in reversed(back):
            out.append(int(p[out[-1]]))
        return out[::-1]


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    data = [x for b in batches for i, h in zip(*map(pa.Array.to_pylist, b.columns)) for x in labelled(h, zlib.crc32(str(i).encode()))]
    m = Crf().fit(data)
    used = np.flatnonzero(m.weight.any(axis=1))
    flat = [*m.move.ravel().tolist(), *m.start.tolist(), *m.weight[used].ravel().tolist()]
    yield pa.record_batch([pa.array([used.tolist()], pa.list_(pa.int32())), pa.array([flat], pa.list_(pa.float64()))], names=["used", "w"])


def train(pages: DataFrame, key: str = "page_id", html: str = "html") -> Crf:
    """Fits the field to TRAIN_PAGES labelled pages, in one task; to pages
    without article and main where there are no others."""
    marked = F.lower(F.col(html)).rlike("<(article|main)[\\s/>]")

    def fit(some: DataFrame):
        some = (some.select(F.col(key).cast("string").alias("k"), F.col(html).alias("h"))
                .orderBy(F.xxhash64("k"), "k", F.md5("h")).limit(TRAIN_PAGES).coalesce(1))
        return some.mapInArrow(_train, "used array<int>, w array<double>").first()

    got = fit(pages.filter(marked))
    if got is None or not got["used"]:
        got = fit(pages.filter(F.length(html) > 0))
    m = Crf()
    if got is not None:
        m.move, m.start = np.array(got["w"][:4]).reshape(2, 2), np.array(got["w"][4:6])
        m.weight[np.array(got["used"], dtype=np.int64)] = np.array(got["w"][6:]).reshape(-1, 2)
    return m


def _extract(model: Crf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, blocks = [], []
            for h in b.column("html").to_pylist():
                page = leaves(h)
                kept = [x.text for x, y in zip(page, model.decode(features(page))) if y]
                text.append(" ".join(kept))
                blocks.append(len(page))
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(text, pa.string()),
                                   pa.array(list(map(len, text)), pa.int64()), pa.array(blocks, pa.int64())],
                                  names=["page_id", "url", "text", "n_chars", "n_blocks"])
    return run


def main_text(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """page_id, url, text, n_chars and n_blocks of every page.  Null and empty
    pages have the empty text; pages that repeat an id are read one by one;
    very long and deeply nested pages are read whole; columns of other names
    are not looked at; where no page has an article or main element or a block
    of prose nothing counts as main text; an empty table gives no rows."""
    kinds = dict(pages.dtypes)
    field = model or train(pages)
    return pages.select("page_id", "url", "html").mapInArrow(
        _extract(field), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_blocks long")
