"""Document quality by naive Bayes support vectors.

A document's features are indicators of n-grams, hashed into a fixed number of
columns: words and word pairs, and 1- and 2-grams of word shapes (``Xx*`` for
``Word***``; a word repeating the one before is marked) at several levels of
their share in the text. Each indicator is scaled by the log ratio of its
smoothed frequencies in the two classes, rows get unit length, and a linear
hinge-loss model is fitted by dual coordinate descent. A logistic curve over
margins of held-back training rows turns margins into scores.

The fit uses labelled rows outside the held-out fold, at most ``max_rows`` of
them (those with the smallest hash of the doc_id), in one task. Only the model,
two arrays of fixed size, is sent to the scoring tasks. Whole texts are scored.

Defined cases. Null and empty texts have one feature of their own and get a
score. Without labels of both classes every score is 0.5. A null doc_id is not
held out and not used for the fit. Repeated rows are scored each; of a repeated
doc_id the fit takes the smallest text. Other columns
(lang, source, anything else) are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.llm.common import text_or_empty

BITS = 18
MAX_ROWS = 8000
THRESHOLD = 0.3
FOLDS = 5
LEVELS = 7
_MASK = (1 << BITS) - 1
_SEEN: dict[str, int] = {}
_MAX_WORDS = 600_000


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def shape(word: str) -> str:
    """Letters as X or x, digits as 9, other characters as they are; runs once."""
    kinds = ("9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in word)
    return "".join(k for k, _ in groupby(kinds))[:12]


def _code(word: str) -> int:
    """31-bit hash of the word, and above it a 20-bit hash of its shape."""
    return (zlib.crc32(word.encode()) & 0x7FFFFFFF) | (zlib.crc32(shape(word).encode()) & 0xFFFFF) << 32


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """Hashed columns of integer n-gram codes."""
    h = (x.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _levels(codes: np.ndarray, total: int, salt: int) -> list[np.ndarray]:
    """Columns of the codes with a share of at least 1/2, 1/4, ... of ``total``."""
    kinds, counts = np.unique(codes, return_counts=True)
    level = np.floor(-np.log2(counts / total)).astype(np.int64)
    return [_mix(kinds[level <= k], salt + k) for k in range(LEVELS)]


def features(text: str) -> np.ndarray:
    """Sorted distinct columns of one text."""
    words = text.split()
    if not words:
        return np.array([0])
    if len(_SEEN) > _MAX_WORDS:
        _SEEN.clear()
    for w in set(words).difference(_SEEN):
        _SEEN[w] = _code(w)
    code = np.fromiter(map(_SEEN.__getitem__, words), np.int64, len(words))
    word, form = code & 0xFFFFFFFF, code >> 32
    same = np.concatenate(([False], word[1:] == word[:-1]))
    form = form | same.astype(np.int64) << 20
    n = len(words)
    distinct = int(np.floor(-np.log2(len(np.unique(word)) / n)))
    found = [_mix(word, 11), _mix(word[:-1] * 0x5BD1E995 + word[1:], 12),
             _mix(np.arange(min(distinct, LEVELS) + 1), 13),
             *_levels(form, n, 100), *_levels(form[:-1] << 21 | form[1:], n, 200)]
    return np.unique(np.concatenate(found))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [features(t.as_py()).astype("<u4").tobytes() for t in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())],
                                         ["doc_id", "label", "cols"])


def log_ratio(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Log of the classes' smoothed column frequencies, positive over negative."""
    counts = []
    for side in (1, -1):
        cols = [r for r, s in zip(rows, y) if s == side]
        p = alpha + np.bincount(np.concatenate(cols), minlength=_MASK + 1)
        counts.append(p / (len(cols) + 2 * alpha))
    return np.log(counts[0] / counts[1])


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 1.0,
                 epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of a linear hinge-loss model on unit rows of scaled indicators,
    both classes weighing the same in total. Column 0 of every row is a
    constant (the bias)."""
    rng = np.random.default_rng(seed)
    values = [np.append(ratio[r], 1.0) for r in rows]
    values = [v / max(np.sqrt(v @ v), 1e-9) for v in values]
    places = [np.append(r, _MASK + 1) for r in rows]
    share = {s: cost * len(y) / (2 * (y == s).sum()) for s in (1, -1)}
    w, alpha = np.zeros(_MASK + 2), np.zeros(len(y))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            at, v = places[i], values[i]
            gradient = y[i] * (w[at] @ v) - 1
            new = min(max(alpha[i] - gradient, 0.0), share[y[i]])     # rows have unit length
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def margin(cols: np.ndarray, ratio: np.ndarray, w: np.ndarray) -> float:
    v = ratio[cols]
    return float((v @ w[cols] + w[-1]) / max(np.sqrt(v @ v + 1.0), 1e-9))


def logistic_curve(f: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(a, b) of score = 1 / (1 + exp(-(a f + b))), by Newton steps on smoothed
    targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -35, 35)))
        g = np.array([((p - target) * f).sum() + 1e-3 * a, (p - target).sum()])
        s = p * (1 - p)
        h = np.array([[(s * f * f).sum() + 1e-3, (s * f).sum()], [(s * f).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        scale = min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - scale * step[0], b - scale * step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(a), float(b)


def fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """The model, as one row of bytes, from (doc_id, label, cols) rows."""
    pdf = pdf.sort_values(["doc_id", "label"])
    y = np.where(pdf["label"].to_numpy() > 0, 1, -1)
    rows = [np.frombuffer(c, "<u4").astype(np.int64) for c in pdf["cols"]]
    parts = np.arange(len(y)) % 4
    tune = parts == 0
    if min((y == 1).sum(), (y == -1).sum()) == 0:
        return pd.DataFrame({"ratio": [b""], "weights": [b""], "a": [0.0], "b": [0.0]})
    if all((y[tune] == s).any() and (y[~tune] == s).any() for s in (1, -1)):
        kept = [r for r, t in zip(rows, tune) if not t]
        ratio = log_ratio(kept, y[~tune])
        w = dual_descent(kept, y[~tune], ratio)
        f = np.array([margin(r, ratio, w) for r, t in zip(rows, tune) if t])
        a, b = logistic_curve(f, y[tune])
    else:
        a, b = 2.0, 0.0
    ratio = log_ratio(rows, y)
    w = dual_descent(rows, y, ratio)
    return pd.DataFrame({"ratio": [ratio.astype("<f4").tobytes()], "weights": [w.astype("<f4").tobytes()],
                         "a": [a], "b": [b]})


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple | None:
    """(ratio, weights, a, b), or None without labels of both classes."""
    usable = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))) \
        .select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label"))
    # bounded: at most max_rows pairs of numbers
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")) \
        .join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    cols = rows.mapInArrow(_feature_batches, "doc_id long, label int, cols binary")
    found = cols.groupBy(F.lit(0).alias("all")).applyInPandas(
        lambda pdf: fit(pdf), "ratio binary, weights binary, a double, b double").collect()
    if not found or not found[0]["ratio"]:
        return None
    r = found[0]
    return np.frombuffer(r["ratio"], "<f4"), np.frombuffer(r["weights"], "<f4"), r["a"], r["b"]


def _score_batches(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model:
            ratio, w, a, b = (x.astype(np.float64) if isinstance(x, np.ndarray) else x for x in model.value)
        for batch in batches:
            if model:
                f = np.array([margin(features(t.as_py() or ""), ratio, w) for t in batch.column(0).field("text")])
                score = 1 / (1 + np.exp(-np.clip(a * f + b, -500, 500)))
            else:
                score = np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["row", "score"])
    return run


def score(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(row, score), one per input row: the row as a struct of all its columns,
    and its score (0 to 1, higher: quality 1 likelier)."""
    spark = docs.sparkSession
    model = train(docs, labels, max_rows)
    model = spark.sparkContext.broadcast(model) if model else None    # 2 x 2^BITS floats
    rows = docs.select(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`")
                                  for c in docs.columns]).alias("row"))
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_score_batches(model), schema)


def predicted(score_column: str = "score") -> Column:
    return (F.col(score_column) >= THRESHOLD).cast("int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: a quality score for every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("row.doc_id", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         predicted().alias("predicted"))
