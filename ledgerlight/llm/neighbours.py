"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample in one task and sent to all tasks (its
size is bounded by the sample). Every vector is put in the leaf it descends to;
a leaf's vectors are stored in blocks of bounded size, so a leaf that holds a
third of all rows is many blocks, not one task. A query visits leaves
best-bin-first: a priority queue of tree nodes by the distance of their centre,
expanding the nearest until enough leaves are reached. How many is calibrated:
for a fixed number of queries the true neighbours are found by brute force over
all blocks, and the visits are widened until the wanted recall is reached.
Distances are computed on the original vectors in double precision.

Defined cases. Vectors that are null, zero, hold null or non-finite components
or have another length than most of the sample take no part, nor do rows
without an id. A query's own row is every row with its vec_id; a repeated query
id asks once (its first row). Equal distances go to the smaller vec_id. With
fewer candidates than asked, all are returned. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlight.llm.common import stored

NEAREST = 10
SAMPLE = 16_000
BRANCHES = 12
LEAF_ROWS = 256
LEAF_SAMPLE = 12          # a leaf is fitted on at least about so many vectors
BLOCK_ROWS = 512
QUERY_BLOCK = 256
CALIBRATION = 64
RECALL = 0.96


class Tree:
    """Nodes in one table: centre, first child, number of children (0: leaf)."""

    def __init__(self, centres: np.ndarray, first: np.ndarray, count: np.ndarray):
        self.centres, self.first, self.count = centres, first, count
        self.leaf_of = np.cumsum(count == 0) - 1
        self.leaves = int((count == 0).sum())

    @classmethod
    def fit(cls, x: np.ndarray, leaf: int, branches: int = BRANCHES, rounds: int = 8, seed: int = 3) -> "Tree":
        """``leaf``: sample vectors that need no further split."""
        rng = np.random.default_rng(seed)
        centres, first, count = [x.mean(0)], [0], [0]
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop(0)
            if len(rows) <= leaf:
                continue
            groups, mids = split(x[rows], min(branches, -(-len(rows) // leaf)), rounds, rng)
            if len(groups) < 2:
                continue
            first[node], count[node] = len(centres), len(groups)
            for g, mid in zip(groups, mids):
                todo.append((len(centres), rows[g]))
                centres.append(mid)
                first.append(0)
                count.append(0)
        return cls(np.array(centres), np.array(first), np.array(count))

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of each vector."""
        at = np.zeros(len(x), np.int64)
        live = np.flatnonzero(self.count[at] > 0)
        while len(live):
            for node in np.unique(at[live]):
                rows = live[at[live] == node]
                a, n = self.first[node], self.count[node]
                mids = self.centres[a:a + n]
                d = (mids ** 2).sum(1) - 2 * x[rows] @ mids.T
                at[rows] = a + d.argmin(1)
            live = live[self.count[at[live]] > 0]
        return self.leaf_of[at]

    def visits(self, q: np.ndarray, sizes: np.ndarray, leaves: int, rows: int) -> list[int]:
        """Leaves in best-bin-first order, until ``leaves`` of them are reached
        that hold at least ``rows`` vectors together."""
        queue, order, held = [(0.0, 0)], [], 0
        while queue and (len(order) < leaves or held < rows):
            _, node = heapq.heappop(queue)
            n = self.count[node]
            if n == 0:
                order.append(int(self.leaf_of[node]))
                held += sizes[order[-1]]
                continue
            a = self.first[node]
            d = ((self.centres[a:a + n] - q) ** 2).sum(1)
            for k in range(n):
                heapq.heappush(queue, (float(d[k]), int(a + k)))
        return order


def split(x: np.ndarray, k: int, rounds: int, rng) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """k-means with spread-out starts; groups without members are left out."""
    mids = [x[rng.integers(len(x))]]
    near = ((x - mids[0]) ** 2).sum(1)
    for _ in range(1, k):
        if near.sum() <= 0:
            break
        mids.append(x[rng.choice(len(x), p=near / near.sum())])
        near = np.minimum(near, ((x - mids[-1]) ** 2).sum(1))
    mids = np.array(mids)
    for _ in range(rounds):
        d = (mids ** 2).sum(1) - 2 * x @ mids.T
        to = d.argmin(1)
        sizes = np.bincount(to, minlength=len(mids))
        sums = np.zeros_like(mids)
        np.add.at(sums, to, x)
        mids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], mids)
    to = ((mids ** 2).sum(1) - 2 * x @ mids.T).argmin(1)
    kept = [g for g in range(len(mids)) if (to == g).any()]
    return [np.flatnonzero(to == g) for g in kept], [mids[g] for g in kept]


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(vector, lambda v: v != 0)


def _matrix(raws, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(raws), "<f8").reshape(-1, width)


def _bytes_of_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raws = [np.asarray(v.as_py(), "<f8").tobytes() for v in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raws, pa.binary())], ["vec_id", "place", "vec"])


def _fit_tree(expansion: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "place"])
        lens = pdf["vec"].map(len)
        width = int(lens.mode()[0]) // 8
        x = _matrix(pdf.loc[lens == 8 * width, "vec"], width)
        tree = Tree.fit(x, max(LEAF_SAMPLE, int(LEAF_ROWS / expansion)))
        return pd.DataFrame({"width": [width], "centres": [tree.centres.tobytes()],
                             "first": [tree.first.astype("<i8").tobytes()], "count": [tree.count.astype("<i8").tobytes()]})
    return run


def _assign(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, tree = model.value
        for b in batches:
            leaf = tree.assign(_matrix(b.column(2).to_pylist(), width)) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], ["vec_id", "place", "vec", "leaf"])
    return run


def _pack_block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["vec_id", "place"])
    return pd.DataFrame({"leaf": [pdf["leaf"].iloc[0]], "ids": [pdf["vec_id"].to_numpy("<i8").tobytes()],
                         "vecs": [b"".join(pdf["vec"])]})


def nearest(q: np.ndarray, own: int, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k nearest rows, own id left out."""
    d = np.sqrt(((x - q) ** 2).sum(1))
    keep = np.flatnonzero(ids != own)
    if len(keep) > k:
        edge = np.partition(d[keep], k - 1)[k - 1]
        keep = keep[d[keep] <= edge]
    order = keep[np.lexsort((ids[keep], d[keep]))][:k]
    return ids[order], d[order]


def _brute(queries, k: int):
    """True neighbours of a fixed list of queries among a task's blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        for b in batches:
            for leaf, raw_ids, raw in zip(*(b.column(c).to_pylist() for c in range(3))):
                ids = np.frombuffer(raw_ids, "<i8")
                x = np.frombuffer(raw, "<f8").reshape(len(ids), -1)
                for own, q in queries:
                    rows = [(float(d), int(i), leaf) for i, d in zip(*nearest(q, own, ids, x, k))]
                    best[own] = sorted(best.get(own, []) + rows)[:k]
        rows = [(own, i, d, leaf) for own, found in best.items() for d, i, leaf in found]
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))],
                                         ["query_id", "vec_id", "score", "leaf"])
    return run


def _visit(model, sizes, leaves: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, tree = model.value
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                raws = part.column(1).to_pylist()
                orders = [tree.visits(np.frombuffer(r, "<f8"), sizes, leaves, k + 1) for r in raws]
                at = np.repeat(np.arange(len(raws)), [len(o) for o in orders])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v for o in orders for v in o], pa.int64()), part.column(0).take(pa.array(at)),
                     pa.array([raws[i] for i in at], pa.binary())], ["leaf", "query_id", "vec"])
    return run


def _pack_queries(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"leaf": [pdf["leaf"].iloc[0]], "query_ids": [pdf["query_id"].to_numpy("<i8").tobytes()],
                         "query_vecs": [b"".join(pdf["vec"])]})


def _compare(k: int):
    """The k nearest of every query in every block of a leaf it visits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw_ids, raw, raw_qids, raw_q in zip(*(b.column(c).to_pylist() for c in range(4))):
                ids, qids = np.frombuffer(raw_ids, "<i8"), np.frombuffer(raw_qids, "<i8")
                x, qs = (np.frombuffer(r, "<f8").reshape(n, -1) for r, n in ((raw, len(ids)), (raw_q, len(qids))))
                found = [nearest(q, own, ids, x, k) for own, q in zip(qids, qs)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(qids, [len(f[0]) for f in found])), pa.array(np.concatenate([f[0] for f in found])),
                     pa.array(np.concatenate([f[1] for f in found]))], ["query_id", "vec_id", "score"])
    return run


def visits_for_recall(ranks: list[int], recall: float) -> int:
    """Fewest leaves whose visit finds ``recall`` of the true neighbours;
    ``ranks``: place (from 0) of each true neighbour's leaf in its query's order."""
    ranks = sorted(ranks)
    need = max(0, int(np.ceil(recall * len(ranks))) - 1)
    return ranks[need] + 1


def search(vectors: DataFrame, queries: Column, k: int = NEAREST, recall: float = RECALL) -> DataFrame:
    """The ``k`` nearest found of the rows (vec_id, embedding) that ``queries``
    marks: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")) \
        .where("vec_id is not null").where(usable(F.col("embedding"))) \
        .select("vec_id", F.monotonically_increasing_id().alias("place"), "embedding")
    rows = stored(rows.mapInArrow(_bytes_of_vectors, "vec_id long, place long, vec binary"), "vectors")
    total = rows.count()
    if total == 0:
        return empty
    # bounded: the sample has at most SAMPLE rows
    sample = rows.orderBy(F.xxhash64("vec_id", "place"), "place").limit(SAMPLE)
    expansion = max(1.0, total / SAMPLE)
    fitted = sample.groupBy(F.lit(0).alias("all")).applyInPandas(
        _fit_tree(expansion), "width int, centres binary, first binary, count binary").collect()[0]
    width = fitted["width"]
    tree = Tree(_matrix([fitted["centres"]], width), np.frombuffer(fitted["first"], "<i8"), np.frombuffer(fitted["count"], "<i8"))
    model = spark.sparkContext.broadcast((width, tree))
    placed = stored(rows.where(F.length("vec") == 8 * width).mapInArrow(
        _assign(model), "vec_id long, place long, vec binary, leaf long"), "placed")
    sizes = np.zeros(tree.leaves, np.int64)          # one number per leaf
    for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["leaf"]] = r["n"]
    parts = F.create_map(*[x for leaf, n in enumerate(sizes.tolist()) for x in (F.lit(leaf), F.lit(-(-n // BLOCK_ROWS) or 1))])
    blocks = stored(placed.withColumn("block", F.pmod(F.xxhash64("vec_id", "place"), parts[F.col("leaf")]))
                    .groupBy("leaf", "block").applyInPandas(_pack_block, "leaf long, ids binary, vecs binary"), "blocks")
    asked = placed.where(queries).groupBy("vec_id").agg(F.min_by("vec", "place").alias("vec")) \
        .select(F.col("vec_id").alias("query_id"), "vec")
    asked = stored(asked, "queries")
    n_queries = asked.count()
    if n_queries == 0:
        return empty
    leaves = calibrate(asked, blocks, tree, sizes, k, recall)
    chunks = -(-n_queries // QUERY_BLOCK)
    visits = asked.mapInArrow(_visit(model, sizes, leaves, k), "leaf long, query_id long, vec binary") \
        .withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks))) \
        .groupBy("leaf", "chunk").applyInPandas(_pack_queries, "leaf long, query_ids binary, query_vecs binary")
    found = blocks.join(visits.hint("merge"), "leaf").select("ids", "vecs", "query_ids", "query_vecs") \
        .mapInArrow(_compare(k), "query_id long, vec_id long, score double")
    first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def true_neighbours(asked: DataFrame, blocks: DataFrame, k: int, limit: int) -> tuple[list, list]:
    """At most ``limit`` queries (id, vector), and by brute force over all
    blocks their k nearest rows with the leaf they lie in."""
    few = [(r["query_id"], np.frombuffer(r["vec"], "<f8"))
           for r in asked.orderBy(F.xxhash64("query_id", F.lit(1)), "query_id").limit(limit).collect()]
    nearby = blocks.select("leaf", "ids", "vecs").mapInArrow(_brute(few, k), "query_id long, vec_id long, score double, leaf long")
    first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return few, nearby.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k).collect()


def calibrate(asked: DataFrame, blocks: DataFrame, tree: Tree, sizes: np.ndarray, k: int, recall: float) -> int:
    """Leaves to visit so that the calibration queries reach ``recall``."""
    few, truth = true_neighbours(asked, blocks, k, CALIBRATION)
    order = {own: {leaf: n for n, leaf in enumerate(tree.visits(q, sizes, tree.leaves, 0))} for own, q in few}
    ranks = [order[r["query_id"]][r["leaf"]] for r in truth]
    return visits_for_recall(ranks, recall) if ranks else tree.leaves


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: rows of ``embeddings`` with vec_id divisible by 100, against all rows."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
