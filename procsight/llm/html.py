"""Main text of web pages by a tree-structured graphical model.

A page is parsed into a tree of elements; each is content or not. The model has
a prior for the root, parent-child potentials by the child's tag (how likely a
child of a content or other parent is content), and emissions of what is seen of
an element: its tag, a hint in its class, id or role, how long its text is, and
how much of it is links. Sum-product messages upward and then downward give
every element's marginal, and the text blocks of likely elements are the page's
text. All potentials are counts over labelled pages with a prior.

Labelled pages are those whose markup names its content: elements within
`article` or `main` are content, but for those that name themselves something
else (`nav`, `aside`, an advert's class ...).
"""

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procsight.llm.tables import bounded

#: Pages that the potentials are counted on at most, about.
TRAIN_ROWS = 5000
SMOOTHING = 0.5

# Fixed values of the HTML standard: elements without content, whose text is not shown, that end a block, that close others.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template title svg canvas iframe object textarea select option button".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
SCOPE = frozenset("ul ol dl table article section div body main aside nav".split())

#: Names of page parts that aren't the article.
OTHER = re.compile(
    r"(?<![a-z])(ad|ads|advert\w*|banner|breadcrumb\w*|comment\w*|cookie\w*|consent|dialog|disqus|footer|form|header|login|masthead|menu\w*|"
    r"modal|nav\w*|newsletter|notice\w*|pager|pagination|popup|promo\w*|related|reply|replies|search\w*|share\w*|sharing|sidebar\w*|"
    r"social|sponsor\w*|subscri\w*|toolbar|widget\w*)(?![a-z])"
)
CONTENT = re.compile(r"(?<![a-z])(article\w*|body-?text|content|entry|main|post|story)(?![a-z])")
OTHER_TAGS = frozenset("nav aside footer header form menu dialog".split())
CONTENT_TAGS = frozenset("article main".split())


@dataclass
class Node:
    tag: str
    parent: int
    hint: str
    text: int = 0
    links: int = 0
    own: list[str] = field(default_factory=list)


class Page(HTMLParser):
    """Elements in page order (parents first), and blocks: (element, text pieces)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#root", -1, "none")]
        self.open = [0]
        self.hidden = 0
        self.blocks: list[tuple[int, list[str]]] = []
        self.fresh = True
        self.feed(html)
        self.close()
        for i in range(len(self.nodes) - 1, 0, -1):
            node = self.nodes[i]
            up = self.nodes[node.parent]
            up.text += node.text
            up.links += node.text if node.tag == "a" else node.links

    def handle_starttag(self, tag, attrs):
        if tag == "body" and any(self.nodes[i].tag == "head" for i in self.open):
            self._end("head")
        if tag in BLOCK:
            self.fresh = True
            if "p" in self._tags():
                self._end("p")
        closes = CLOSES.get(tag)
        if closes:
            for k in range(len(self.open) - 1, 0, -1):
                name = self.nodes[self.open[k]].tag
                if name in closes:
                    self._cut(k)
                    break
                if name in SCOPE and name not in closes:
                    break
        if tag == "br":
            self._text(" ")
        if tag in VOID:
            return
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower()
        other = bool(OTHER.search(names))
        hint = "other" if other else "content" if CONTENT.search(names) else "none"
        self.nodes.append(Node(tag, self.open[-1], hint))
        self.open.append(len(self.nodes) - 1)
        self.hidden += tag in HIDDEN

    def handle_startendtag(self, tag, attrs):
        # A slash at the end means nothing but on elements without content.
        self.handle_starttag(tag, attrs)

    def _tags(self) -> list[str]:
        """Open elements up to the innermost one that confines a paragraph."""
        out = []
        for i in reversed(self.open[1:]):
            tag = self.nodes[i].tag
            out.append(tag)
            if tag in BLOCK and tag != "p":
                break
        return out

    def _cut(self, k: int):
        for i in self.open[k:]:
            self.hidden -= self.nodes[i].tag in HIDDEN
        del self.open[k:]

    def _end(self, tag: str):
        for k in range(len(self.open) - 1, 0, -1):
            if self.nodes[self.open[k]].tag == tag:
                self._cut(k)
                return

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.fresh = True
        if tag == "br":
            self._text(" ")
        self._end(tag)

    def handle_data(self, data):
        if not self.hidden:
            self._text(data)

    def _text(self, data: str):
        if self.hidden:
            return
        node = self.open[-1]
        if data.strip():
            self.nodes[node].text += len(data)
        # A piece belongs to the innermost element that forms a block.
        owner = next((i for i in reversed(self.open) if self.nodes[i].tag in BLOCK), 0)
        if self.fresh or not self.blocks or self.blocks[-1][0] != owner:
            self.blocks.append((owner, []))
            self.fresh = False
        self.blocks[-1][1].append(data)


def features(nodes: list[Node]) -> list[tuple[str, ...]]:
    """What is seen of each element, by kind of feature."""
    out = []
    for n in nodes:
        size = "0" if not n.text else str(int(math.log2(n.text)) // 2)
        share = "0" if not n.links else str(1 + min(3, int(4 * n.links / max(1, n.text))))
        out.append((f"tag:{n.tag}", f"hint:{n.hint}", f"text:{size}", f"links:{share}"))
    return out


def named_states(nodes: list[Node]) -> list[int] | None:
    """1 for content, 0 for the rest, if the markup names its content; else None."""
    if not any(n.tag in CONTENT_TAGS for n in nodes):
        return None
    states = []
    for n in nodes:
        above = states[n.parent] if n.parent >= 0 else 0
        inside = n.tag in CONTENT_TAGS or above
        states.append(int(bool(inside) and n.tag not in OTHER_TAGS | HIDDEN and n.hint != "other"))
    return states


class Model:
    """Log potentials from counts of (kind, state or states) events."""

    def __init__(self, counts: dict[str, float]):
        self.counts = counts
        self.values = Counter(k.split("|")[0] + "|" + k.split("|")[1].split(":")[0] for k in counts if k.startswith("see"))
        self.cache: dict[str, np.ndarray] = {}

    def prior(self) -> np.ndarray:
        n = [self.counts.get(f"root|{s}", 0) + SMOOTHING for s in (0, 1)]
        return np.log(np.array(n) / sum(n))

    def step(self, tag: str) -> np.ndarray:
        """log P(child's state | parent's state, child's tag), rows by parent; rare tags lean on all tags."""
        if (key := f"step:{tag}") not in self.cache:
            out = np.zeros((2, 2))
            for s in (0, 1):
                every = np.array([self.counts.get(f"step|{s}{t}|*", 0) + SMOOTHING for t in (0, 1)])
                own = np.array([self.counts.get(f"step|{s}{t}|{tag}", 0) for t in (0, 1)]) + 2 * every / every.sum()
                out[s] = np.log(own / own.sum())
            self.cache[key] = out
        return self.cache[key]

    def see(self, feature: str) -> np.ndarray:
        """log P(feature | state) for both states."""
        if (key := f"see:{feature}") not in self.cache:
            kind = feature.split(":")[0]
            out = np.zeros(2)
            for s in (0, 1):
                total = self.counts.get(f"all|{s}", 0)
                out[s] = math.log((self.counts.get(f"see|{feature}|{s}", 0) + SMOOTHING) / (total + SMOOTHING * (1 + self.values[f"see|{kind}"])))
            self.cache[key] = out
        return self.cache[key]

    def marginals(self, nodes: list[Node]) -> np.ndarray:
        """P(content) of every element, by sum-product messages from the leaves to the root and back."""
        n = len(nodes)
        local = np.array([sum(self.see(f) for f in seen) for seen in features(nodes)])
        up = local.copy()
        sent = np.zeros((n, 2))
        for i in range(n - 1, 0, -1):
            m = self.step(nodes[i].tag) + up[i]
            top = m.max(axis=1)
            sent[i] = top + np.log(np.exp(m - top[:, None]).sum(axis=1))
            up[nodes[i].parent] += sent[i]
        belief = np.zeros((n, 2))
        belief[0] = self.prior() + up[0]
        for i in range(1, n):
            # What the parent knows without this child, sent down.
            m = (belief[nodes[i].parent] - sent[i])[:, None] + self.step(nodes[i].tag)
            top = m.max(axis=0)
            belief[i] = up[i] + top + np.log(np.exp(m - top[None, :]).sum(axis=0))
            belief[i] -= belief[i].max()
        belief[0] -= belief[0].max()
        p = np.exp(belief)
        return p[:, 1] / p.sum(axis=1)


def text_of(html: str, model: Model) -> str:
    """The page's content blocks, white space as one space, joined by line feeds."""
    page = Page(html)
    p = model.marginals(page.nodes)
    blocks = (" ".join("".join(parts).split()) for owner, parts in page.blocks if p[owner] >= 0.5)
    return "\n".join(b for b in blocks if b)


def learn(pages: DataFrame, rows: int = TRAIN_ROWS, key: str = "page_id") -> Model:
    """Counts over a bounded sample of the pages (by a hash of their key) whose markup names its content."""

    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            for html in batch.column(0).to_pylist():
                nodes = Page(html).nodes
                states = named_states(nodes)
                if states is None:
                    continue
                for node, s, seen in zip(nodes, states, features(nodes), strict=True):
                    found[f"all|{s}"] += 1
                    for f in seen:
                        found[f"see|{f}|{s}"] += 1
                    if node.parent < 0:
                        found[f"root|{s}"] += 1
                    else:
                        found[f"step|{states[node.parent]}{s}|{node.tag}"] += 1
                        found[f"step|{states[node.parent]}{s}|*"] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["event", "n"]
        )

    sample = bounded(pages.where(F.col(key).isNotNull() & F.col("html").isNotNull()), key, rows)
    counts = sample.select("html").mapInArrow(count, "event string, n bigint").groupBy("event").agg(F.sum("n").alias("n"))
    # Events are tags and bins: a few hundred.
    return Model({x.event: x.n for x in counts.collect()})


def extract(pages: DataFrame, model: Model, key: str = "page_id") -> DataFrame:
    """page_id, url, text, n_chars for each row: whole pages.

    Null and empty pages and pages without content have an empty text. Null
    keys and repeated rows keep their rows; an empty table gives no rows; other
    columns are not read.
    """
    counts = model.counts

    def read(batches):
        own = Model(counts)
        for batch in batches:
            for k in range(0, len(batch), 200):
                some = batch.slice(k, 200)
                texts = [text_of(h, own) for h in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(read, f"`{key}` {kind}, url string, text string, n_chars bigint")
