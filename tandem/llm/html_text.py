"""Main text of web pages with a tree-structured graphical model on the DOM.

Nodes are the block elements and their runs of text; each has a hidden state, content or not.
The joint probability is a product over the tree: a parent-child potential on every edge, by its
kind, and a potential of each node's features (tag, class and id words, role, amount of text, share
of linked text, punctuation), all fitted to labelled pages. Sum-product messages upward and
downward give every node's content marginal; the text runs over one half are the main text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.arrow import pick
from tandem.llm.html_tokens import Tags, decoded
from tandem.llm.html_training import labelled_pages

_ATTR = re.compile(r"""(?<![^\s=/"'])([^\s=/"']++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++))""")
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not page text at all: without markup up to their end tag, and with.
RAW = frozenset("script style title textarea".split())
SKIPPED = frozenset("noscript template head svg iframe object audio video canvas select option button".split())
#: What a head may hold; anything else ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
_SKIP_TAG = re.compile(rf"<(/?)({'|'.join(sorted(SKIPPED))})(?=[\s/>])[^>]*?(/?)>", re.I)
BLOCKS = frozenset("""html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th
    thead tr ul caption""".split())
#: Elements that name a part of a page.
PARTS = frozenset("article aside dialog footer form header main menu nav section".split())
#: Elements that say nothing themselves.
PLAIN = frozenset("html body center div tbody".split())
#: Kinds of edges, each with potentials of its own.
KINDS = ("text", "top", "block")
#: Start tag -> open elements it ends, up to (not into) the stop set.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
         "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
_STOP = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}
#: A block ends an open paragraph that is not outside one of these.
_AROUND_P = ("table", "td", "th", "li", "div", "section", "article", "blockquote")


def _ended(source: str, last: int) -> set[int]:
    """Where the start tags of skipped elements are that have an end tag; ``last`` is the last ``>``."""
    opened: dict[str, list[int]] = {}
    out = set()
    for m in _SKIP_TAG.finditer(source, 0, last + 1):
        at = opened.setdefault(m[2].lower(), [])
        if not m[1]:
            if not m[3]:
                at.append(m.start())
        elif at:
            out.add(at.pop())
    return out


class Page:
    """Blocks and text runs of a page in document order; a node's parent comes before it."""

    def __init__(self, source: str):
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["#root"]
        self.attrs: list[dict] = [{}]
        self.text: list[str | None] = [None]        # of text runs
        self.linked: list[int] = [0]
        self._parse(source)
        self.frames = {0} | {i for i, t in enumerate(self.tag) if t in ("html", "body")} \
            | {self.parent[i] for i, t in enumerate(self.tag) if t in PARTS}
        self.inside = [False]       # an article, main or section is around it
        for p in self.parent[1:]:
            self.inside.append(self.inside[p] or self.tag[p] in ("article", "main", "section"))

    def _add(self, parent: int, tag: str, attrs: dict, text: str | None = None, linked: int = 0) -> int:
        for column, value in ((self.parent, parent), (self.tag, tag), (self.attrs, attrs), (self.text, text), (self.linked, linked)):
            column.append(value)
        return len(self.parent) - 1

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#root", 0)]   # open elements and the block each is in
        places: dict[str, list[int]] = {}               # name -> its places in the stack
        run: list[str] = []
        linked = 0
        skips: list[tuple[int, bool]] = []              # open skipped elements: place in the stack, has an end tag
        ended = None
        tags = Tags(source)

        def last(names) -> int:
            """Place of the innermost open element of these names; 0 if none is open."""
            return max((places[x][-1] for x in names if places.get(x)), default=0)

        def push(name: str, block: int):
            places.setdefault(name, []).append(len(stack))
            stack.append((name, block))

        def flush():
            nonlocal linked
            if run:
                t = _SPACE.sub(" ", "".join(run)).strip()
                if t:
                    self._add(stack[-1][1], "#text", {}, t, min(linked, len(t)))
                run.clear()
            linked = 0

        def close_to(i: int):
            if any(b != stack[i - 1][1] for _, b in stack[i:]):
                flush()
            for t, _ in stack[i:]:
                places[t].pop()
            del stack[i:]
            while skips and skips[-1][0] >= i:
                skips.pop()

        def words(s: str):
            nonlocal linked
            if stack[-1][0] == "head" and s.strip():
                close_to(len(stack) - 1)
            if not skips:
                s = decoded(s)
                run.append(s)
                if places.get("a"):
                    linked += len(s.strip())

        at = 0
        while tag := tags.next():
            if tag.start > at:
                words(source[at:tag.start])
            at = tag.end
            name, attrs = tag.name, tag.attrs
            if not name:
                continue
            if tag.closing:
                if i := last((name,)):
                    close_to(i)
                continue
            if name == "br":
                run.append(" ")
                continue
            if stack[-1][0] == "head" and name not in IN_HEAD:
                close_to(len(stack) - 1)
            if skips and name == "body" and not last(("body",)):
                close_to(skips[0][0])
            if name in RAW or name in SKIPPED:
                if name in ("option", "button") and (i := last((name,))):       # not inside one another
                    close_to(i)
                run.append(" ")
                if name != "head" and attrs.rstrip().endswith("/"):
                    continue
                end = tags.end_of(name) if name in RAW else None
                if end or name in ("script", "style"):
                    at = tags.at = end or len(source)
                    continue
                if ended is None:
                    ended = _ended(source, tags.last)
                skips.append((len(stack), name == "head" or tag.start in ended))
                push(name, stack[-1][1])
                continue
            if skips and name in BLOCKS:
                # a block ends what has no end tag, and an svg outside its parts of HTML
                while skips and (not skips[-1][1] or stack[skips[-1][0]][0] == "svg"
                                 and last(("foreignobject", "desc", "title")) < skips[-1][0]):
                    close_to(skips[-1][0])
                if skips and stack[-1][0] == "head":
                    close_to(len(stack) - 1)
                if skips:
                    if name != "hr":
                        push(name, stack[-1][1])
                    continue
            if name in BLOCKS:
                if (i := last(("p",))) > last(_AROUND_P):
                    close_to(i)
                if name in _ENDS:
                    while (i := last(_ENDS[name])) > last(_STOP.get(name, ("table",))):
                        close_to(i)
                flush()
                if name != "hr":
                    found = {k.lower(): decoded(a or b or c or "") for k, a, b, c in _ATTR.findall(attrs)} if attrs.strip() else {}
                    push(name, self._add(stack[-1][1], name, found))
                continue
            if name in VOID or attrs.rstrip().endswith("/"):
                continue
            push(name, stack[-1][1])
        if at < len(source):
            words(source[at:])
        flush()

    def edge(self, i: int) -> str:
        """Kind of the edge to the parent: to a run of text, from a block that frames page parts, or another."""
        if self.text[i] is not None:
            return "text"
        return "top" if self.parent[i] in self.frames else "block"

    def features(self, i: int) -> list[str]:
        t = self.text[i]
        if t is None:
            a = self.attrs[i]
            words = _WORD.findall(f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}".lower())
            inner = "inner " if self.inside[i] else ""
            tag = [] if self.tag[i] in PLAIN else [f"tag={inner if self.tag[i] in PARTS else ''}{self.tag[i]}"]
            return [*tag, *("word=" + w for w in set(words))]
        n = len(t)
        return [f"chars={min(6, n.bit_length() - 2) if n > 7 else 0}",
                f"links={min(3, int(4 * self.linked[i] / n))}", f"stop={t[-1] in '.!?:;…'}", f"commas={min(2, t.count(','))}"]


class Model:
    """Feature weights and edge potentials (log scale), fitted to labelled pages.

    The conditional likelihood of the labels is climbed by its gradient -- observed minus expected
    feature and edge counts, the expectations from sum-product messages over all pages at once.
    """

    def __init__(self, pages: Sequence[str] | None = None, rounds: int = 400, rate: float = 1.0, ridge: float = 0.005):
        trees = [Page(x) for x in (labelled_pages() if pages is None else pages)]
        names: dict[str, int] = {}
        parent, kind, y, node, feature, depth = [], [], [], [], [], []
        for p in trees:
            base = len(parent)
            for i in range(len(p.parent)):
                up = p.parent[i] + base
                parent.append(up)
                depth.append(depth[up] + 1 if i else 0)
                kind.append(KINDS.index(p.edge(i)) if i else -1)
                y.append(p.attrs[i]["y"] == "1" if "y" in p.attrs[i] else y[up] if i else True)
                for f in p.features(i) if i else ():
                    node.append(base + i)
                    feature.append(names.setdefault(f, len(names)))
        parent, kind, y, node, feature, depth = map(np.array, (parent, kind, y, node, feature, depth))
        child = np.flatnonzero(kind >= 0)
        levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
        w, t = np.zeros(len(names)), np.zeros((len(KINDS), 2, 2))          # t[kind, parent's state, state]
        seen = [np.bincount(feature, y[node], len(names)), np.zeros_like(t)]
        np.add.at(seen[1], (kind[child], y[parent[child]].astype(int), y[child].astype(int)), 1)
        square = [np.full_like(w, 1e-8), np.full_like(t, 1e-8)]
        for _ in range(rounds):
            below = np.bincount(node, w[feature], len(parent))
            up = np.zeros(len(parent))
            for at in reversed(levels):
                q, b = t[kind[at]], below[at]
                up[at] = np.logaddexp(q[:, 1, 1] + b, q[:, 1, 0]) - np.logaddexp(q[:, 0, 1] + b, q[:, 0, 0])
                np.add.at(below, parent[at], up[at])
            belief = below.copy()
            pair = np.zeros((len(parent), 2, 2))
            for at in levels:
                q, rest = t[kind[at]], belief[parent[at]] - up[at]
                belief[at] += np.logaddexp(q[:, 1, 1] + rest, q[:, 0, 1]) - np.logaddexp(q[:, 1, 0] + rest, q[:, 0, 0])
                e = q + rest[:, None, None] * np.array([[0, 0], [1, 1]]) + below[at][:, None, None] * np.array([[0, 1], [0, 1]])
                e = np.exp(e - e.max((1, 2), keepdims=True))
                pair[at] = e / e.sum((1, 2), keepdims=True)
            expected = np.zeros_like(t)
            np.add.at(expected, kind[child], pair[child])
            on = pair[:, :, 1].sum(1)
            for k, (value, grad) in enumerate(((w, seen[0] - np.bincount(feature, on[node], len(names)) - ridge * len(trees) * w),
                                               (t, seen[1] - expected - ridge * len(trees) * t))):
                square[k] += grad * grad
                value += rate * grad / np.sqrt(square[k])
        self.weight = {f: float(w[i]) for f, i in names.items()}
        self.edge = {k: tuple(float(np.exp(t[i, a, c])) for a, c in ((1, 1), (1, 0), (0, 1), (0, 0))) for i, k in enumerate(KINDS)}

    def marginals(self, p: Page) -> list[float]:
        """Log-odds of content of every node, by messages up and down the tree."""
        n = len(p.parent)
        local = [0.0] * n
        for i in range(1, n):
            local[i] = sum(self.weight.get(f, 0.0) for f in p.features(i))
        up, belief = [0.0] * n, local[:]
        for i in range(n - 1, 0, -1):                    # children come after their parent
            p11, p10, p01, p00 = self.edge[p.edge(i)]
            e = math.exp(max(-60.0, min(60.0, belief[i])))
            up[i] = math.log((p11 * e + p10) / (p01 * e + p00))
            belief[p.parent[i]] += up[i]
        for i in range(1, n):
            p11, p10, p01, p00 = self.edge[p.edge(i)]
            rest = math.exp(max(-60.0, min(60.0, belief[p.parent[i]] - up[i])))
            belief[i] += math.log((p11 * rest + p01) / (p10 * rest + p00))
        return belief

    def main_text(self, source: str | None) -> str:
        if not source:
            return ""
        p = Page(source)
        b = self.marginals(p)
        return "\n\n".join(t for t, x in zip(p.text, b, strict=True) if t is not None and x > 0)


@lru_cache(maxsize=1)
def trained() -> Model:
    """The model of the labelled pages, fitted once in a process."""
    return Model()


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row: the main text of the whole page.

    Character references are decoded, white space inside a block is one space, blocks are
    joined by two newlines in page order. A null or empty page, or one without main text, gives an
    empty text. Broken markup is read as browsers do in the common cases (unclosed paragraphs,
    items and cells; stray end tags are ignored; a head ends at the first tag or text that it may not
    hold). Of the skipped elements (:data:`SKIPPED`) one ends with its end tag or with the block around it, one without
    an end tag at the next block, too; a script or style left open takes the rest of the page. Repeated rows give repeated results; an empty
    table none. No shuffle; one page at a time in memory.
    """

    model = trained()       # on the driver; tasks get its few hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                part = b.slice(lo, 128)
                texts = [model.main_text(x.as_py()) for x in part.column(2)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()),
                                       pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    base = pick(pages.withColumn(id, F.col(id).cast("long")), page_id=id, url=url, html=source)
    return base.mapInArrow(run, "page_id long, url string, text string, n_chars long")
