"""Main text of web pages: gradient-boosted trees over DOM nodes.

Every page becomes a tree of block nodes (``dom``). Boosted trees give each
node the probability that its subtree holds main text; a pass over the tree
then picks the most likely set of choices in which nothing below a dropped node
is kept. The kept blocks' texts are joined in page order.

Training. No page carries labels, so the trees learn from the pages that mark
up their main text: nodes in (or around) ``article`` or ``main`` and outside
navigation, forms and blocks named as side matter are positive, the others
negative. So that the trees do not only copy those marks, they see every
training page three times: as it is, without the article marks, and with its
side matter as if it stood inside the article. At most ``max_pages`` such
pages (smallest hash of the page_id) are used, in one task; the model that is
sent to all tasks has a fixed number of trees of a fixed depth. All pages and
whole texts are extracted.

Defined cases. Null and empty html give an empty text. Truncated tags,
comments and elements end with the page. Character references are decoded as
HTML defines them; unknown ones stay as they are. Without a trainable page the
trees know only that paragraphs with few links are text. Repeated page_ids are
separate rows, of which the fit takes the smallest; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import dom
from ledgerlight.llm.common import stored

MAX_PAGES = 1200
TREES, DEPTH, BINS, RATE = 40, 4, 32, 0.3


def weak_labels(nodes: list[dom.Node]) -> np.ndarray | None:
    """1 for nodes whose subtree holds marked main text, or None for a page
    without such marks."""
    inside, label = {}, {}
    for n in nodes:
        up = inside.get(id(n.parent), 0)
        side = n.tag in dom.CHROME or n.side > n.main
        inside[id(n)] = -1 if side or up < 0 else 1 if up > 0 or n.tag in dom.BODY else 0
    for n in reversed(nodes):
        label[id(n)] = int((inside[id(n)] > 0 and n.chars > 0) or any(label[id(c)] for c in n.children))
    y = np.array([label[id(n)] for n in nodes])
    return y if y.any() else None


def training_rows(x: np.ndarray, y: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Copies of a page's nodes that part the marks from what they usually go
    with: as they are; without article marks, at another depth, paragraphs as
    bare text; side matter inside the article; article blocks marked as side
    matter, each mark by itself (then they are none of the main text)."""
    rng = np.random.default_rng(seed)
    bare, moved = x.copy(), x[y == 0].copy()
    bare[:, [dom.IS_BODY, dom.IN_BODY, dom.MAIN_SELF, dom.MAIN_ABOVE]] = 0
    bare[:, dom.LEVEL] += rng.integers(-1, 5) * (x[:, dom.LEVEL] > 1)
    loose = bare[(y == 1) & (x[:, dom.IS_P] == 1)]
    loose[:, dom.IS_P], loose[:, dom.IS_TEXT] = 0, 1
    moved[:, dom.IN_BODY] = 1
    xs, ys = [x, bare, loose, moved], [y, y, np.ones(len(loose)), np.zeros(len(moved))]
    inner = x[(y == 1) & (x[:, dom.IN_BODY] == 1)]
    for mark in (dom.IS_CHROME, dom.IN_CHROME, dom.SIDE_SELF, dom.SIDE_ABOVE):
        marked = inner[rng.random(len(inner)) < 0.5]
        marked[:, mark] = 1
        marked[:, dom.IN_BODY] = rng.random(len(marked)) < 0.5
        xs.append(marked)
        ys.append(np.zeros(len(marked)))
    return np.concatenate(xs), np.concatenate(ys)


class Boosted:
    """Boosted regression trees for a yes/no target (logistic loss), grown on
    histograms. A tree is complete to a fixed depth: three arrays."""

    def __init__(self, start: float, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.start, self.trees = start, trees

    @staticmethod
    def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
        return [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS,
            rate: float = RATE, ridge: float = 1.0) -> "Boosted":
        edges = cls._edges(x, bins)
        # value v falls in bin #edges below v: a split at edge e sends v <= e left
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        start = float(np.log(share / (1 - share)))
        margin, grown = np.full(len(y), start), []
        features = x.shape[1]
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            feat = np.zeros(2 ** depth - 1, np.int64)
            cut = np.full(2 ** depth - 1, np.inf)
            at = np.zeros(len(y), np.int64)          # node of each row within its level
            for level in range(depth):
                width, first = 2 ** level, 2 ** level - 1
                gains = np.full((width, features), -1.0)
                cuts = np.zeros((width, features), np.int64)
                for f in range(features):
                    if not len(edges[f]):
                        continue
                    slot = at * (bins + 1) + binned[:, f]
                    gs = np.bincount(slot, g, width * (bins + 1)).reshape(width, -1).cumsum(1)
                    hs = np.bincount(slot, h, width * (bins + 1)).reshape(width, -1).cumsum(1)
                    gl, hl = gs[:, :len(edges[f])], hs[:, :len(edges[f])]
                    gr, hr = gs[:, -1:] - gl, hs[:, -1:] - hl
                    gain = gl ** 2 / (hl + ridge) + gr ** 2 / (hr + ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + ridge)
                    cuts[:, f] = gain.argmax(1)
                    gains[:, f] = gain.max(1)
                best = gains.argmax(1)
                for k in range(width):
                    if gains[k, best[k]] > 1e-6:
                        feat[first + k], cut[first + k] = best[k], edges[best[k]][cuts[k, best[k]]]
                at = 2 * at + (x[np.arange(len(y)), feat[first + at]] > cut[first + at])
            gs, hs = np.bincount(at, g, 2 ** depth), np.bincount(at, h, 2 ** depth)
            leaf = rate * gs / (hs + ridge)
            margin += leaf[at]
            grown.append((feat, cut, leaf))
        return cls(start, grown)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feat, cut, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                at = 2 * at + 1 + (x[rows, feat[at]] > cut[at])
            out += leaf[at - len(feat)]
        return out

    def pack(self) -> bytes:
        return b"".join([np.array([self.start, len(self.trees), len(self.trees[0][2])]).tobytes(),
                         *[a.astype("<f8").tobytes() for t in self.trees for a in t]])

    @classmethod
    def unpack(cls, raw: bytes) -> "Boosted":
        v = np.frombuffer(raw, "<f8")
        n, width = int(v[1]), int(v[2])
        t = v[3:].reshape(n, 3 * width - 2)
        return cls(float(v[0]), [(r[:width - 1].astype(np.int64), r[width - 1:2 * width - 2], r[2 * width - 2:]) for r in t])


def default_model() -> Boosted:
    """Without any page to learn from: paragraphs with few links are text."""
    feat, cut, leaf = np.array([16, 2, 2]), np.array([0.5, 0.5, 0.5]), np.array([2.0, -2.0, -2.0, -2.0])
    return Boosted(0.0, [(feat, cut, leaf)])


def decode(nodes: list[dom.Node], margin: np.ndarray) -> list[bool]:
    """The most likely choices in which a kept node has only kept ancestors."""
    keep_log = (-np.logaddexp(0, -margin)).tolist()
    drop_log = (-np.logaddexp(0, margin)).tolist()
    best_keep, all_drop = {}, {}
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        all_drop[id(n)] = drop_log[i] + sum(all_drop[id(c)] for c in n.children)
        best_keep[id(n)] = keep_log[i] + sum(max(best_keep[id(c)], all_drop[id(c)]) for c in n.children)
    kept = {}
    for n in nodes:
        kept[id(n)] = (n.parent is None or kept[id(n.parent)]) and best_keep[id(n)] > all_drop[id(n)]
    return [kept[id(n)] for n in nodes]


def main_texts(pages: list[str], model: Boosted) -> list[str]:
    """Main text of each page; the trees run over the nodes of all at once."""
    trees = [dom.nodes_in_order(dom.parse(p)) for p in pages]
    margin = model.margin(np.concatenate([dom.node_features(nodes) for nodes in trees]))
    out, at = [], 0
    for nodes in trees:
        kept = decode(nodes, margin[at:at + len(nodes)])
        at += len(nodes)
        out.append(" ".join([n.text for n, k in zip(nodes, kept) if k and n.text]))
    return out


def _training_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, rows = [], []
        for page_id, page in zip(b.column(0).to_pylist(), b.column(1)):
            nodes = dom.nodes_in_order(dom.parse(page.as_py()))
            x = dom.node_features(nodes)
            y = weak_labels(nodes)
            if y is not None:
                ids.append(page_id)
                rows.append(np.column_stack([x, y]).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], ["page_id", "rows"])


def fit(pdf: pd.DataFrame) -> pd.DataFrame:
    xs, ys = [], []
    for raw in pdf.sort_values(["page_id", "rows"])["rows"]:
        page = np.frombuffer(raw, "<f4").reshape(-1, dom.FEATURES + 1)
        x, y = training_rows(page[:, :-1], page[:, -1], len(xs))
        xs.append(x)
        ys.append(y)
    model = Boosted.fit(np.concatenate(xs).astype(np.float64), np.concatenate(ys).astype(np.float64))
    return pd.DataFrame({"model": [model.pack()]})


def train(pages: DataFrame, max_pages: int = MAX_PAGES) -> Boosted:
    # a cheap test keeps every page with marks; the labels then tell which are usable
    marked = pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")) \
        .where(F.expr(r"html rlike '(?i)<(article|main)[\\s/>]'"))
    # bounded: the smallest hashes, more of them only while too few are usable; ids first, so no html is sorted
    hashed = stored(marked.select("page_id", F.xxhash64("page_id").alias("h")).distinct(), "marked")
    most, taken = hashed.count(), max_pages
    while True:
        ids = hashed.orderBy("h", "page_id").limit(taken).select("page_id")
        sample = marked.join(F.broadcast(ids), marked["page_id"].eqNullSafe(ids["page_id"])) \
            .groupBy(marked["page_id"]).agg(F.min("html").alias("html"))
        rows = stored(sample.mapInArrow(_training_batches, "page_id long, rows binary"), "training")
        if taken >= most or rows.count() >= max_pages:
            break
        taken *= 4
    rows = rows.orderBy(F.xxhash64("page_id"), "page_id").limit(max_pages)
    found = rows.groupBy(F.lit(0).alias("all")).applyInPandas(lambda pdf: fit(pdf), "model binary").collect()
    return Boosted.unpack(found[0]["model"]) if found else default_model()


def _text_batches(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 100):
                part = b.slice(lo, 100)
                texts = main_texts([p.as_py() or "" for p in part.column(2)], model.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"])
    return run


def extract(pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    model = pages.sparkSession.sparkContext.broadcast(train(pages, max_pages))   # TREES x 3 x 2^DEPTH numbers
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")) \
        .mapInArrow(_text_batches(model), "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
