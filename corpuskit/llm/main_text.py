"""Main text of web pages by a tree-structured graphical model.

Every element and every run of text of a page is a variable with three states: no part of the main
text, wholly main text, or a box that holds both. Potentials tie a child's state to its parent's
(other ones for boxes, for paragraphs and the like, for inline elements and for texts), and each node's
state to what is seen of it: its tag and the section it is in, the words of its class, id and role, how
much text it holds, alone and as a share of the page's, how many sentences, how much of it is links, and
whether it is the first or last text of the page. Sum-product messages pass up from the leaves and down from the root; they give exact
marginals, as a page is a tree. Runs of text that are more likely main text than not are kept.

The potentials are trained on labelled pages by the gradient of the labels' likelihood, whose
expected counts come from the same messages.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.llm._shared import in_arrow
from corpuskit.llm.labelled_pages import MAIN as MAIN_NAMES
from corpuskit.llm.labelled_pages import NAMES, WRAPPERS, labelled_pages
from corpuskit.llm.page_tree import RAW, STRUCTURAL, Node, clean, parse

OUTSIDE, MAIN, BOTH = 0, 1, 2
ENDS = tuple(".!?…")
#: Elements that set apart a part of a page.
SECTIONS = frozenset("article main section nav aside header footer form dialog table".split())
#: Blocks that hold running text rather than other boxes.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd figure figcaption table thead tbody tr td th".split())
#: Bounds of the shares of a page's text outside links.
SHARES = (0.02, 0.1, 0.3, 0.6, 0.9)
KINDS = 4
NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
def _words(lists: list[list[str]]) -> frozenset[str]:
    return frozenset(w.lower() for names in lists for name in names for w in NAME.findall(name))


#: Words of names of the parts beside main text, and of main text and its wrappers.
WITHIN = _words([MAIN_NAMES, WRAPPERS])
BESIDE = _words(list(NAMES.values())) - WITHIN
#: Log prior of a page's root: nearly every page holds main text and more.
ROOT = np.array([-8.0, -5.0, 0.0])
#: Pages whose trees go through the messages together, by nodes.
NODES = 100_000


def flat(root: Node) -> list[tuple[object, int, int]]:
    """(node or text, place of its parent, depth), parents first, in page order. Without recursion: trees may be deep."""
    out = [(root, -1, 0)]
    stack = [(root, 0, 0, iter(root.parts))]
    while stack:
        node, place, depth, rest = stack[-1]
        for part in rest:
            if isinstance(part, Node):
                out.append((part, place, depth + 1))
                if part.parts:
                    stack.append((part, len(out) - 1, depth + 1, iter(part.parts)))
                    break
            elif part and not part.isspace():
                out.append((part, place, depth + 1))
        else:
            stack.pop()
    return out


def size_bin(n: int) -> int:
    return min(int(n).bit_length(), 12)


class Page:
    """A parsed page: its nodes, their parents, depths and kinds, and what is seen of each."""

    # kind, by which blocks are cut: 0 box, 1 inline element, 2 text; tie, by which potentials are shared: the same, and 3 for paragraphs

    def __init__(self, page: str):
        self.nodes = flat(parse(page))
        n = len(self.nodes)
        self.parent = [p for _, p, _ in self.nodes]
        self.depth = [d for _, _, d in self.nodes]
        length, linked = [0] * n, [0] * n
        self.in_link = [False] * n
        self.section, sentences, ahead = ["none"] * n, [0] * n, [0] * n
        plain = 0
        for i, (node, p, _) in enumerate(self.nodes):
            ahead[i] = plain
            if isinstance(node, str):
                length[i] = len(node)
                linked[i] = len(node) if self.in_link[p] else 0
                self.section[i] = self.section[p]
                if self.nodes[p][0].tag not in RAW:
                    plain += length[i] - linked[i]
                    sentences[i] = node.rstrip()[-1:] in ENDS and not linked[i]
            else:
                self.section[i] = node.tag if node.tag in SECTIONS else self.section[p] if p >= 0 else "none"
                self.in_link[i] = node.tag == "a" or p >= 0 and self.in_link[p]
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            length[p] += length[i]
            linked[p] += linked[i]
            sentences[p] += sentences[i]
        self.length, self.linked, self.sentences, self.ahead, self.plain = length, linked, sentences, ahead, plain
        self.kind = [2 if isinstance(x, str) else 0 if x.tag in STRUCTURAL or x is self.nodes[0][0] else 1 for x, _, _ in self.nodes]
        self.tie = [3 if not k and x.tag in PARAGRAPHS else k for k, (x, _, _) in zip(self.kind, self.nodes, strict=True)]

    def seen(self, i: int) -> tuple:
        node, p, _ = self.nodes[i]
        if isinstance(node, str):
            above = self.nodes[p][0].tag
            return ("text", f"of:{above}", f"size:{size_bin(self.length[i])}:{self.sentences[i]:d}", f"link:{self.in_link[p]:d}", f"text in:{self.section[i]}")
        n = self.length[i]
        share = 0 if not self.linked[i] else 1 + min(3, 4 * self.linked[i] // n)
        names = ()
        if node.attributes:
            text = " ".join(node.attribute(a) for a in ("class", "id", "role"))
            words = {w.lower() for w in NAME.findall(text)}
            names = tuple(sorted(f"name:{w}" for w in words))
            # rare names lean on those of their like
            if words & BESIDE:
                names += ("named:beside", f"named beside in:{self.section[p] if p >= 0 else 'none'}")
            if words & WITHIN:
                names += ("named:within",)
            if re.search(r"\bhidden\b|display:\s*none", node.attributes):
                names += ("name:hidden",)
        own = n - self.linked[i]
        part = bisect_right(SHARES, own / self.plain) if self.plain else -1
        kind = self.tie[i]
        around = f"around:{kind}:{self.ahead[i] == 0:d}{self.ahead[i] + own >= self.plain:d}" if own else "around:no text"
        inside = self.section[p] if p >= 0 else "none"
        return ("box", f"tag:{node.tag}", f"in:{inside}:{node.tag}", f"held:{size_bin(n)}", f"part:{kind}:{part}", f"ended:{kind}:{min(self.sentences[i], 3)}", around, f"links:{share}:{min(size_bin(n), 8) // 3}", *names)


class Trees:
    """Pages whose messages are passed together, level by level."""

    def __init__(self, pages: list[Page]):
        self.base = np.cumsum([0, *(len(p.nodes) for p in pages)])
        self.parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + b) for p, b in zip(pages, self.base[:-1], strict=True)])
        depth, self.kind = (np.concatenate([np.array(getattr(p, a)) for p in pages]) for a in ("depth", "tie"))
        self.levels = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1])

    def messages(self, across: np.ndarray, evidence: np.ndarray, pairs: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        """Log marginals of each node's states, and the log of the sum over all states. pairs, if given, gets the expected counts of (kind, parent's state, child's state)."""
        up, message, kind, parent = evidence.copy(), np.zeros_like(evidence), self.kind, self.parent
        up[self.levels[0]] += ROOT
        for level in reversed(self.levels[1:]):
            m = np.logaddexp.reduce(across[kind[level]] + up[level][:, None, :], axis=2)
            message[level] = m
            np.add.at(up, parent[level], m)
        total = np.logaddexp.reduce(up[self.levels[0]], axis=1).sum()
        belief = up.copy()
        for level in self.levels[1:]:
            rest = belief[parent[level]] - message[level]
            belief[level] += np.logaddexp.reduce(across[kind[level]] + rest[:, :, None], axis=1)
            if pairs is not None:
                joint = rest[:, :, None] + across[kind[level]] + up[level][:, None, :]
                np.add.at(pairs, kind[level], np.exp(joint - np.logaddexp.reduce(joint, axis=(1, 2))[:, None, None]))
        return belief - np.logaddexp.reduce(belief, axis=1)[:, None], total


class Model:
    """Log potentials: across, by kind of child, parent's and child's state; and of what is seen, by state."""

    def __init__(self, across: np.ndarray, features: dict[str, np.ndarray]):
        self.across, self.features = across, features
        self.kept: dict[tuple, np.ndarray] = {}

    def evidence(self, seen: tuple) -> np.ndarray:
        # what no labelled page has says nothing
        seen = tuple(f for f in seen if f in self.features)
        found = self.kept.get(seen)
        if found is None:
            if len(self.kept) > 200_000:
                self.kept.clear()
            found = self.kept[seen] = sum((self.features[f] for f in seen), np.zeros(3))
        return found

    def marginals(self, pages: list[Page]) -> list[np.ndarray]:
        """For each page, the probability of each state of each node."""
        trees = Trees(pages)
        belief, _ = trees.messages(self.across, np.array([self.evidence(p.seen(i)) for p in pages for i in range(len(p.nodes))]))
        return np.split(np.exp(belief), trees.base[1:-1])


def states(page: Page) -> list[int]:
    """The states of a labelled page's nodes: of a box, from the texts inside."""
    n = len(page.nodes)
    label, has = [0] * n, [set() for _ in range(n)]
    for i, (node, p, _) in enumerate(page.nodes):
        label[i] = label[p] if p >= 0 else 0
        if isinstance(node, str):
            has[i].add(label[i])
        elif mark := node.attribute("data-main"):
            label[i] = int(mark == "yes")
    for i in range(n - 1, 0, -1):
        has[page.parent[i]] |= has[i]
    return [BOTH if len(h) == 2 else next(iter(h), label[i]) for i, h in enumerate(has)]


def train(texts: list[str], rounds: int = 80, rate: float = 0.15, prior: float = 0.004) -> Model:
    """Potentials from labelled pages, in which elements carry data-main="yes" or "no", inherited below.

    The likelihood of the labels is climbed by its gradient, the difference between the observed
    counts of each potential and those that the messages expect; a Gaussian prior keeps weights small.
    """
    pages = [Page(t) for t in texts]
    trees = Trees(pages)
    state = np.concatenate([states(p) for p in pages])
    names: dict[str, int] = {}
    rows, columns = [], []
    for base, page in zip(trees.base, pages, strict=False):
        for i in range(len(page.nodes)):
            for f in page.seen(i):
                rows.append(base + i)
                columns.append(names.setdefault(f, len(names)))
    rows, columns = np.array(rows), np.array(columns)
    starts = np.searchsorted(rows, np.arange(len(state)))
    below = np.nonzero(trees.parent >= 0)[0]
    size = len(names) * 3
    observed = np.bincount(columns * 3 + state[rows], minlength=size)
    observed = np.concatenate([observed, np.bincount(trees.kind[below] * 9 + state[trees.parent[below]] * 3 + state[below], minlength=9 * KINDS)])
    weights = np.zeros(size + 9 * KINDS)
    speed, spread = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        evidence = np.add.reduceat(weights[:size].reshape(-1, 3)[columns], starts)
        pairs = np.zeros((KINDS, 3, 3))
        belief, _ = trees.messages(weights[size:].reshape(KINDS, 3, 3), evidence, pairs)
        share = np.exp(belief)[rows]
        expected = np.concatenate([np.stack([np.bincount(columns, share[:, s], len(names)) for s in range(3)], 1).ravel(), pairs.ravel()])
        gradient = (observed - expected) / len(pages) - prior * weights / 10
        # steps scaled by the gradients' running mean and spread
        speed += 0.1 * (gradient - speed)
        spread += 0.01 * (gradient**2 - spread)
        weights += rate * (speed / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-6)
    return Model(weights[size:].reshape(KINDS, 3, 3), {f: weights[3 * c : 3 * c + 3] for f, c in names.items()})


def kept_text(page: Page, marginals: np.ndarray) -> str:
    """Main text: kept runs, joined inside a block, blocks joined by one space."""
    blocks, held = [], []
    last = None
    kinds, block_of = page.kind, list(range(len(page.nodes)))
    for i, p in enumerate(page.parent):
        if kinds[i]:
            block_of[i] = block_of[p]

    for i, (node, p, _) in enumerate(page.nodes):
        if isinstance(node, str):
            if marginals[i, MAIN] > 0.5 and page.nodes[p][0].tag not in RAW:
                block = block_of[p]
                if block != last:
                    blocks.append("".join(held))
                    held, last = [], block
                held.append(html.unescape(node))
        elif not kinds[i]:
            last = None  # a box inside a block splits it
    blocks.append("".join(held))
    return " ".join(b for b in map(clean, blocks) if b)


_models: dict[int, Model] = {}


def default_model() -> Model:
    if 0 not in _models:
        _models[0] = train(labelled_pages(700))
    return _models[0]


def extract(df: DataFrame, html_column: str = "html", model: Model | None = None, output: str = "text") -> DataFrame:
    """df without its html column and with the main text of it and n_chars, its code points.

    A null or empty page has the empty text, as has one without main text; character references
    are decoded, white space inside a block becomes one space. Pages are read whole, repeated pages
    give repeated rows, and columns named as an output are replaced. No shuffle.
    """
    kept = [c for c in df.columns if c not in (html_column, output, "n_chars")]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(output, T.StringType()), T.StructField("n_chars", T.LongType())])
    shared = df.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts, held, size = [], [], 0

            def flush() -> None:
                for page, m in zip(held, own.marginals(held) if held else [], strict=True):
                    texts.append(kept_text(page, m))
                held.clear()

            for page in batch.column(len(kept)):
                held.append(Page(page.as_py() or ""))
                size += len(held[-1].nodes)
                if size > NODES:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return in_arrow(df.select(*kept, html_column), run, schema)
