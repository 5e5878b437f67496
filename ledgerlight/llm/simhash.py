"""SimHash near-duplicates found by a generalised pigeonhole search.

A fingerprint has 64 bits; a bit is 1 where more than half of the text's word
shingles have it set in their hash. Two fingerprints link at ``distance`` or
fewer differing bits, and linked fingerprints are joined into components.

Search. The bits are put into groups of correlated bits, and each group i gets
a threshold t_i with sum(t_i) = distance - groups + 1 (a threshold of -1 leaves
a group out): two fingerprints within ``distance`` are then within t_i in some
group i. Thresholds and the number of groups come from a dynamic programme
over candidate counts estimated from all fingerprints. Each fingerprint probes
the values within t_i of its own in group i; what it meets is verified on all
64 bits inside the join.

Dense clusters. Before the search, fingerprints at two or fewer bits are linked
without forming pairs (both meet at a value one bit or less from either), and
the search passes over pairs already known to be connected. So a group of
copies costs rows in proportion to its size.

Defined cases. Null text counts as empty; texts without words have fingerprint
zero and link like any other. Repeated doc_ids are separate rows of one text
each. A null doc_id gets the smallest other doc_id of its component. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import components, stored, text_or_empty

BITS = 64
SHINGLE = 4
DISTANCE = 4
SEED = 42
GROUPINGS = (2, 3, 4, 5)
# cost of sending one probe row through a shuffle, in candidate comparisons
PROBE_COST = 40.0


def fingerprint(text: bytes, shingle: int = SHINGLE, step: int = 65536) -> int:
    """Unsigned fingerprint of one UTF-8 text."""
    from xxhash import xxh64_intdigest as xxh
    words = text.lower().split()     # bytes: only A-Z, only \x20 and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1:] - 1
    counts = np.zeros(BITS, np.int64)
    for lo in range(0, n, step):
        spans = zip(starts[lo:min(n, lo + step)].tolist(), last[lo:lo + step].tolist())
        h = np.fromiter((xxh(joined[a:b], SEED) for a, b in spans), "<u8")
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(x.as_py(), shingle) for x in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array(found, "<u8").view("<i8")), b.column(2)], ["doc_id", "fp", "text_hash"])
    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, text_hash): the fingerprint as a signed long, one row per
    input row."""
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("h")) \
        .mapInArrow(_fingerprints(shingle), "doc_id long, fp long, text_hash long")


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS))
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).astype("<i8")
        x = np.unpackbits(fp.view(np.uint8), bitorder="little").reshape(-1, BITS).astype(np.float32)
        total += x.T @ x
    i, j = np.divmod(np.arange(BITS * BITS), BITS)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "n"])


def bit_groups(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """``m`` groups of near equal width, each grown from the bit most
    correlated with the rest by adding the bit most correlated with the group."""
    p = np.diag(both) / n
    cov = both / n - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    r = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(r, 0.0)
    free, groups = set(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        rest = sorted(free)
        group = [max(rest, key=lambda b: (r[b, rest].sum(), -b))]
        while len(group) < width:
            left = sorted(free.difference(group))
            group.append(max(left, key=lambda b: (r[b, group].sum(), -b)))
        free.difference_update(group)
        groups.append(sorted(group))
    return groups


def _mask(bits) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def expected(pairs: float, p: np.ndarray, group: list[int], most: int) -> list[float]:
    """Estimated candidates at thresholds 0..most: the counted pairs with equal
    values, widened by the distance distribution of independent bits."""
    dist = np.array([1.0])
    for b in group:
        q = 2 * p[b] * (1 - p[b])
        dist = np.convolve(dist, [1 - q, q])
    cum = np.cumsum(dist)
    return [pairs * cum[min(t, len(cum) - 1)] / max(cum[0], 1e-12) for t in range(most + 1)]


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = distance + 1 and least total
    cost; ``costs[i][t]`` is the cost of group i at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, min(len(row), distance + 1 - used)):
                total = cost + (row[t] if t >= 0 else 0.0)
                if used + t + 1 not in step or total < step[used + t + 1][0]:
                    step[used + t + 1] = (total, chosen + [t])
        best = step
    return best[distance + 1]


def plan_search(fps: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each group that is searched, from counts over all
    distinct fingerprints. What reaches the driver is 64 x 64 counts and one
    number per group."""
    counted = fps.select("fp").mapInArrow(_bit_counts, "i long, j long, n double") \
        .groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((BITS, BITS))
    for row in counted:
        both[row["i"], row["j"]] = row["n"]
    n = fps.count()
    if n < 2:
        return []
    plans = {m: bit_groups(both, n, m) for m in GROUPINGS if m <= distance + 1}
    keys = [F.struct(F.lit(m * 100 + i).alias("g"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("v"))
            for m, groups in plans.items() for i, g in enumerate(groups)]
    same = {r["g"]: r["s"] for r in fps.select(F.explode(F.array(*keys)).alias("k")).select("k.g", "k.v")
            .groupBy("g", "v").count().groupBy("g")
            .agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("s")).collect()}
    p = np.diag(both) / n
    choices = []
    for m, groups in plans.items():
        costs = []
        for i, g in enumerate(groups):
            est = expected(same[m * 100 + i], p, g, distance)
            balls = np.cumsum([comb(len(g), t) for t in range(distance + 1)])
            costs.append([est[t] + PROBE_COST * n * float(balls[t]) for t in range(distance + 1)])
        cost, ts = allocate(costs, distance)
        choices.append((cost, m, [(g, t) for g, t in zip(groups, ts) if t >= 0]))
    return min(choices)[2]


def close_links(fps: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) that connect all fingerprints at two or fewer bits (all of
    them at most ``distance`` apart): both ends meet at a value at most one
    bit from either, where each links to the smallest."""
    reach = 1 if distance >= 2 else 0
    flips = [0] + [_mask([b]) for b in range(BITS)] * reach
    near = fps.select("fp", F.explode(F.array(*[F.lit(x) for x in flips])).alias("x")) \
        .select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("meet"))
    low = near.groupBy("meet").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")) \
        .where("n > 1").select("meet", "low")
    # the planner does not see how many rows the explode makes: never broadcast
    return near.join(low.hint("merge"), "meet").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))


def search_links(fps: DataFrame, plan: list[tuple[list[int], int]], distance: int) -> DataFrame:
    """Verified links between fingerprints (fp, part) of different parts."""
    probes, index = [], []
    for i, (bits, t) in enumerate(plan):
        value = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        index.append(F.struct(F.lit(i).alias("g"), value.alias("v")))
        for k in range(t + 1):
            for c in combinations(bits, k):
                probes.append((i, _mask(bits), _mask(c)))
    flat = F.array(*[F.struct(F.lit(i).alias("g"), F.lit(mask).alias("m"), F.lit(flip).alias("x"))
                     for i, mask, flip in probes])
    left = fps.select(F.col("fp").alias("a"), F.col("part").alias("part_a"), F.explode(flat).alias("k")) \
        .select("a", "part_a", F.col("k.g").alias("g"),
                F.col("a").bitwiseAND(F.col("k.m")).bitwiseXOR(F.col("k.x")).alias("v"))
    right = fps.select(F.col("fp").alias("b"), F.col("part").alias("part_b"), F.explode(F.array(*index)).alias("k")) \
        .select("b", "part_b", "k.g", "k.v")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return left.join(right.hint("merge"), (left.g == right.g) & (left.v == right.v) & (F.col("part_a") < F.col("part_b")) & near) \
        .select("part_a", "part_b").distinct()


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per input row: doc_id, fp (signed long), component_id, text_hash."""
    marked = stored(fingerprints(docs, shingle), "fingerprints")
    fps = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fp")
    near = components(close_links(fps, distance)).withColumnsRenamed({"node": "fp", "component": "part"})
    parts = fps.join(near, "fp", "left").select("fp", F.coalesce("part", "fp").alias("part"), "first")
    parts = stored(parts, "parts")
    plan = plan_search(parts, distance)
    if plan:
        links = search_links(parts, plan, distance)
        more = components(links.select(F.col("part_a").alias("a"), F.col("part_b").alias("b")))
        whole = more.withColumnsRenamed({"node": "part", "component": "whole"})
        parts = parts.join(whole, "part", "left").select("fp", F.coalesce("whole", "part").alias("part"), "first")
        parts = stored(parts, "parts")
    ids = parts.groupBy("part").agg(F.min("first").alias("component_id"))
    labels = stored(parts.join(ids, "part").select("fp", "part", "component_id"), "labels")
    return marked.join(labels, "fp").select("doc_id", "fp", "component_id", "text_hash", "part")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the document with the
    smallest doc_id (then text hash; a null doc_id comes last). Rows repeated
    as they are stay once. All columns are kept."""
    last = (1 << 63) - 1
    groups = simhash_groups(docs, shingle, distance)
    # the smallest (doc_id, text hash) of a group in two steps of plain minima
    ids = stored(groups.select("part", F.coalesce("doc_id", F.lit(last)).alias("_d"), "text_hash"), "groups")
    low = ids.groupBy("part", "_d").agg(F.min("text_hash").alias("_t"))
    first = low.groupBy("part").agg(F.min("_d").alias("_d"), F.min_by("_t", "_d").alias("_t"))
    first = stored(first.select("_d", "_t"), "first")
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("_d"),
                       F.xxhash64(text_or_empty()).alias("_t"))
    return rows.join(first.hint("merge"), ["_d", "_t"], "left_semi").dropDuplicates(["_d", "_t"]).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: fingerprints and components of all ``documents``."""
    found = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
