"""Alignment of two tokenizations of the same text by byte offsets.

A text is tokenized by vocabulary A (byte-level BPE) and B (SentencePiece BPE).
Where a token of A and one of B end at the same byte, the text is cut; between
two cuts lie groups of tokens that cover the same bytes, and all tokens of A in
a group are linked with all of B.

The common ends come from a galloping intersection: of each text the shorter
list of ends drives, and each of its ends looks for its place in the longer one
by doubling steps from a place known to lie before it, then by halving the last
step. Every 64th end gallops from the start of the text, the others from where
the one before them was found; all ends of a step of texts move together in
flat arrays. The common indices slice both lists into groups, and differences of
ranks are the range of B tokens each A token is linked with.

Counts of linked id pairs cover all documents. A task reduces about 8 million
characters (a chunk) to the distinct pairs, with the number of documents that
hold each; only these are shuffled by pair, so a pair that every document holds
is one row per chunk. The counts go back to the chunks (not to the documents),
and are looked up there by number. What is broadcast is one row per id of A.

Defined cases. Null and empty texts have no tokens, as have texts that a
vocabulary changes (its tokens' bytes differ from a space and the text): all
numbers are 0 and ``groups_sha256`` is empty. Rows with one doc_id are separate
documents. An empty table gives no rows. Other columns are ignored, whatever
their names. A very long text is a chunk of its own; a worker then holds its
tokens and its distinct pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import stored, text_or_empty
from ledgerlight.llm.sentencepiece_bpe import SPACE, PieceBpe, model_path
from ledgerlight.llm.tokens import BYTE, Encoder, joined_ids

STEP_CHARS = 1 << 21
CHUNK_CHARS = 1 << 23
ANCHOR = 64
BLOCK = 1 << 20
_LONG = 64
CHUNK_ROWS = ("chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
              "pairs binary, times binary, keys binary, docs binary")
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups_sha256 string")
_LOADED: dict[tuple, "Aligner"] = {}


def gallop(values: np.ndarray, start: np.ndarray, stop: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For every value the first index k >= ``start`` with ends[k] >= value; one
    must lie before ``stop``. ``ends`` rises within every range start to stop."""
    lo, hi = start.copy(), stop - 1
    moving, step = np.arange(len(values)), 1
    while len(moving):
        at = np.minimum(start[moving] + (step - 1), hi[moving])
        behind = ends[at] < values[moving]
        lo[moving[behind]] = at[behind] + 1
        hi[moving[~behind]] = at[~behind]
        moving, step = moving[behind], 2 * step
    moving = np.flatnonzero(lo < hi)
    while len(moving):
        mid = (lo[moving] + hi[moving]) >> 1
        behind = ends[mid] < values[moving]
        lo[moving[behind]] = mid[behind] + 1
        hi[moving[~behind]] = mid[~behind]
        moving = moving[lo[moving] < hi[moving]]
    return lo


def places(short: np.ndarray, bounds: np.ndarray, which: np.ndarray, ends: np.ndarray,
           long_bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the ends in ``short`` of the texts ``which``, and where each
    is found in ``ends``. Text t has the ends bounds[t] to bounds[t + 1]."""
    sizes = bounds[which + 1] - bounds[which]
    text = np.repeat(which, sizes)
    rank = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    index = bounds[text] + rank
    first, last, values = long_bounds[text], long_bounds[text + 1], short[index]
    anchor = np.flatnonzero(rank % ANCHOR == 0)
    at = np.empty(len(index), np.int64)
    at[anchor] = gallop(values[anchor], first[anchor], last[anchor], ends)
    rest = np.flatnonzero(rank % ANCHOR)
    at[rest] = gallop(values[rest], at[rest - rank[rest] % ANCHOR], last[rest], ends)
    return index, at


def common_ends(a_ends: np.ndarray, a_bounds: np.ndarray, b_ends: np.ndarray, b_bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices into ``a_ends`` and ``b_ends`` of the ends both have, text by
    text (ends count from the start of the text)."""
    a_drives = np.diff(a_bounds) <= np.diff(b_bounds)
    in_a, in_b = np.zeros(len(a_ends), bool), np.zeros(len(b_ends), bool)
    index, at = places(a_ends, a_bounds, np.flatnonzero(a_drives), b_ends, b_bounds)
    met = a_ends[index] == b_ends[at]
    in_a[index[met]] = in_b[at[met]] = True
    index, at = places(b_ends, b_bounds, np.flatnonzero(~a_drives), a_ends, a_bounds)
    met = b_ends[index] == a_ends[at]
    in_b[index[met]] = in_a[at[met]] = True
    return np.flatnonzero(in_a), np.flatnonzero(in_b)


def _expand(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + sizes[0] - 1, first[1] .., ..."""
    return np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def linked(a_ids: np.ndarray, a_cuts: np.ndarray, b_ids: np.ndarray, b_cuts: np.ndarray, owner: np.ndarray,
           n_b_ids: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (text, pair key, times) of all links; a pair may come several
    times. Group g has the tokens cuts[g] to cuts[g + 1] and lies in text
    owner[g]; the key is A's id * n_b_ids + B's id."""
    na, nb = np.diff(a_cuts), np.diff(b_cuts)
    cost = na * nb
    plain = np.flatnonzero(cost <= BLOCK)
    part = np.cumsum(cost[plain]) // BLOCK
    for groups in np.split(plain, np.flatnonzero(np.diff(part)) + 1):
        a = _expand(a_cuts[groups], na[groups])
        width = np.repeat(nb[groups], na[groups])
        b = _expand(np.repeat(b_cuts[groups], na[groups]), width)
        yield (np.repeat(np.repeat(owner[groups], na[groups]), width),
               np.repeat(a_ids[a], width) * n_b_ids + b_ids[b], np.ones(len(b), np.int64))
    for g in np.flatnonzero(cost > BLOCK).tolist():
        # a very large group by its distinct ids
        a, ca = np.unique(a_ids[a_cuts[g]:a_cuts[g + 1]], return_counts=True)
        b, cb = np.unique(b_ids[b_cuts[g]:b_cuts[g + 1]], return_counts=True)
        rows = max(1, BLOCK // len(b))
        for lo in range(0, len(a), rows):
            yield (np.full(len(a[lo:lo + rows]) * len(b), owner[g]), (a[lo:lo + rows, None] * n_b_ids + b).ravel(),
                   (ca[lo:lo + rows, None] * cb).ravel())


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of the times of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[heads], np.add.reduceat(times[order], heads)


class _SpacedEncoder(Encoder):
    """Byte-level ids of texts that start with a space put before them."""

    def _cut_bytes(self, text: str) -> list[str]:
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[-1] in " \n":
            return super()._cut_bytes(text)
        return text.replace("\n", " \n").split(" ")   # the first is empty


class Aligner:
    """Both vocabularies of a worker."""

    def __init__(self, a_path: str | None = None, b_path: str | None = None, max_words: int = 500_000):
        self.a = _SpacedEncoder(BYTE, a_path)
        self.a.tokenizer.encode_special_tokens = True
        self.b = PieceBpe(b_path or model_path())
        self.max_words, self.seen = max_words, {}
        self.a_widths = self.a.widths
        self.b_widths = np.array([len(x) for x in self.b.bytes_of])
        self.n_a_ids, self.n_b_ids = len(self.a_widths), len(self.b_widths)
        # a token as it is written inside a list, then as the last of its list
        self.written = [f"{i}{end}".encode() for n, ends in ((self.n_a_ids, ",|"), (self.n_b_ids, ",;"))
                        for end in ends for i in range(n)]

    def b_ids(self, normalized: list[str]) -> list[bytes]:
        """B's ids of each normalized text as little-endian unsigned 32-bit bytes."""
        if len(self.seen) > self.max_words:
            self.seen.clear()

        def ids_of(keys: list[str]) -> list[bytes]:
            found = list(map(self.seen.get, keys))
            unseen = [k for k, raw in enumerate(found) if raw is None]
            if unseen:
                for k, ids in zip(unseen, self.b.merge([self.b.word(keys[k]) for k in unseen])):
                    found[k] = ids.astype("<u4").tobytes()
                    if len(keys[k]) <= _LONG:
                        self.seen[keys[k]] = found[k]
            return found

        return joined_ids([self.b.cut_normalized(t) for t in normalized], ids_of)

    def unchanged(self, text: str) -> str | None:
        """The text as B normalizes it, if B's pieces spell a space and the text."""
        if text and SPACE not in text:
            normalized = self.b.sp.normalize(text)
            if normalized.replace(SPACE, " ") == " " + text:
                return normalized
        return None

    def group_codes(self, a: np.ndarray, a_cuts: np.ndarray, b: np.ndarray, b_cuts: np.ndarray) -> np.ndarray:
        """The groups written as ``a1,a2|b1;a3|b2,b3;``, as places in ``written``."""
        codes = np.empty(len(a) + len(b), np.int32)
        at = np.repeat(b_cuts[:-1], np.diff(a_cuts))
        at += np.arange(len(a))
        codes[at] = a
        codes[at[a_cuts[1:] - 1]] += self.n_a_ids
        at = np.repeat(a_cuts[1:], np.diff(b_cuts))
        at += np.arange(len(b))
        codes[at] = b + 2 * self.n_a_ids
        codes[at[b_cuts[1:] - 1]] += self.n_b_ids
        return codes

    def groups_sha256(self, codes: np.ndarray) -> str:
        """SHA-256 of the groups of one text, without the last separator."""
        digest, left = hashlib.sha256(), b""
        for lo in range(0, len(codes), BLOCK):
            digest.update(left)
            left = b"".join(map(self.written.__getitem__, codes[lo:lo + BLOCK].tolist()))
        digest.update(left[:-1])
        return digest.hexdigest()

    def align(self, texts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links, groups_sha256) of every text, and the
        distinct (text, pair key) with the times each is linked, by text."""
        normalized = list(map(self.unchanged, texts))
        good = [k for k, t in enumerate(normalized) if t is not None]
        some = [texts[k] for k in good]
        a_raw, b_raw = self.a.encode([" " + t for t in some]), self.b_ids([normalized[k] for k in good])
        a, b = (np.frombuffer(b"".join(raw), "<u4").astype(np.int64) for raw in (a_raw, b_raw))
        a_bounds, b_bounds = (np.concatenate(([0], np.cumsum([len(r) // 4 for r in raw], dtype=np.int64))) for raw in (a_raw, b_raw))
        sizes = np.array([len(t.encode()) + 1 for t in some], np.int64)
        base = np.cumsum(sizes) - sizes
        # ends from the start of the step: they rise over all its texts
        a_ends, b_ends = np.cumsum(self.a_widths[a]), np.cumsum(self.b_widths[b])
        for bounds, ends in ((a_bounds, a_ends), (b_bounds, b_ends)):
            if not np.array_equal(ends[bounds[1:] - 1], base + sizes):
                raise ValueError("tokens do not spell the text")
        in_a, in_b = common_ends(a_ends, a_bounds, b_ends, b_bounds)
        a_cuts, b_cuts = np.concatenate(([0], in_a + 1)), np.concatenate(([0], in_b + 1))
        group_bounds = np.concatenate(([0], np.searchsorted(in_a, a_bounds[1:] - 1) + 1)) if some else np.zeros(1, np.int64)
        links = np.concatenate(([0], np.cumsum(np.diff(a_cuts) * np.diff(b_cuts))))
        codes = self.group_codes(a, a_cuts, b, b_cuts)
        found = [(0, 0, 0, 0, "")] * len(texts)
        for k, i in enumerate(good):
            lo, hi = int(group_bounds[k]), int(group_bounds[k + 1])
            found[i] = (int(a_bounds[k + 1] - a_bounds[k]), int(b_bounds[k + 1] - b_bounds[k]), hi - lo,
                        int(links[hi] - links[lo]),
                        self.groups_sha256(codes[a_bounds[k] + b_bounds[k]:a_bounds[k + 1] + b_bounds[k + 1]]))
        owner = np.repeat(np.array(good, np.int64), np.diff(group_bounds))
        width = self.n_a_ids * self.n_b_ids
        keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for text, key, n in linked(a, a_cuts, b, b_cuts, owner, self.n_b_ids):
            if len(key):
                parts.append(summed(text * width + key, n))
        if parts:
            keys, times = parts[0] if len(parts) == 1 else summed(*map(np.concatenate, zip(*parts)))
        return found, keys // width, keys % width, times


def aligner(a_path: str | None, b_path: str | None) -> Aligner:
    """The worker's vocabularies."""
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = Aligner(a_path, b_path)
    return _LOADED[a_path, b_path]


def _chunk(chunk: int, ids: list, found: list[tuple], bounds: list[int], keys: list[np.ndarray],
           times: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The rows of a chunk: one per document, then one with its distinct pairs."""
    names = [c.split()[0] for c in CHUNK_ROWS.split(", ")]
    types = [pa.int64()] * 6 + [pa.string()] + [pa.binary()] * 4
    every = np.concatenate([*keys, np.zeros(0, np.int64)])
    distinct, number, held = np.unique(every, return_inverse=True, return_counts=True)
    raw_pairs, raw_times = number.astype("<u4").tobytes(), np.concatenate([*times, np.zeros(0, np.int64)]).astype("<u4").tobytes()
    for lo in range(0, len(ids), 2000):
        hi = min(lo + 2000, len(ids))
        cut = [slice(4 * bounds[k], 4 * bounds[k + 1]) for k in range(lo, hi)]
        columns = [[chunk] * (hi - lo), ids[lo:hi], *zip(*found[lo:hi]),
                   [raw_pairs[c] for c in cut], [raw_times[c] for c in cut], [None] * (hi - lo), [None] * (hi - lo)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
    last = [chunk, *[None] * 8, distinct.astype("<i8").tobytes(), held.astype("<u4").tobytes()]
    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(last, types)], names)


def _align_batches(a_path: str | None, b_path: str | None, step_chars: int, chunk_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, chunk = aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        ids, found, bounds, keys, times, chars = [], [], [0], [], [], 0
        for batch in batches:
            doc_ids, texts, lo = batch.column(0).to_pylist(), batch.column(1), 0
            while lo < len(doc_ids):
                hi, room, part = lo, step_chars, []
                while hi < len(doc_ids) and (room > 0 or hi == lo):
                    part.append(texts[hi].as_py())
                    room -= len(part[-1])
                    hi += 1
                rows, text, key, n = both.align(part)
                ids += doc_ids[lo:hi]
                found += rows
                bounds += (bounds[-1] + np.cumsum(np.bincount(text, minlength=len(part)))).tolist()
                keys.append(key)
                times.append(n)
                chars, lo = chars + step_chars - room, hi
                if chars >= chunk_chars:
                    yield from _chunk(chunk, ids, found, bounds, keys, times)
                    chunk += 1
                    ids, found, bounds, keys, times, chars = [], [], [0], [], [], 0
        if ids:
            yield from _chunk(chunk, ids, found, bounds, keys, times)
    return run


def _pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, keys, docs in zip(*(batch.column(k) for k in range(3))):
            keys, docs = np.frombuffer(keys.as_py(), "<i8"), np.frombuffer(docs.as_py(), "<u4")
            for lo in range(0, len(keys), 100_000):
                key = keys[lo:lo + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), chunk.as_py())), pa.array(np.arange(lo, lo + len(key))), pa.array(key),
                     pa.array(docs[lo:lo + 100_000].astype(np.int64))], ["chunk", "at", "key", "docs"])


def _score(rows: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """n_best and count_sum of the documents of one chunk."""
    counts = counts.sort_values("at")
    total, best = counts["total"].to_numpy(np.int64), counts["is_best"].to_numpy(bool)
    sums = []
    for pairs, times in zip(rows["pairs"], rows["times"]):
        pairs, times = np.frombuffer(pairs, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
        sums.append((int(times[best[pairs]].sum()), int((times * total[pairs]).sum())))
    out = rows.drop(columns=["chunk", "pairs", "times"])
    out["n_best"], out["count_sum"] = zip(*sums) if sums else ([], [])
    return out[[c.split()[0] for c in RESULT.split(", ")]]


def pair_counts(chunks: DataFrame, n_b_ids: int) -> tuple[DataFrame, DataFrame]:
    """(chunk, at, key) of the pairs of all chunks, and (key, a, b, total, is_best)
    of all pairs: total is the number of documents that hold the pair linked."""
    pairs = chunks.where("keys is not null").select("chunk", "keys", "docs").mapInArrow(
        _pair_batches, "chunk long, at long, key long, docs long")
    totals = stored(pairs.groupBy("key").agg(F.sum("docs").alias("total"))
                    .withColumn("a", F.expr(f"key div {n_b_ids}")).withColumn("b", F.expr(f"key % {n_b_ids}")), "pair-totals")
    best = totals.groupBy("a").agg(F.max("total").alias("best"))      # at most one row per id of A
    return pairs.select("chunk", "at", "key"), totals.join(F.broadcast(best), "a").select(
        "key", "a", "b", "total", (F.col("total") == F.col("best")).alias("is_best"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, step_chars: int = STEP_CHARS,
          chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per document with the columns of RESULT. The aligned chunks are
    a table on shared storage: texts are tokenized once."""
    import sentencepiece
    n_b_ids = sentencepiece.SentencePieceProcessor(model_file=b_path or model_path()).get_piece_size()
    chunks = stored(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(
        _align_batches(a_path, b_path, step_chars, chunk_chars), CHUNK_ROWS), "aligned")
    pairs, totals = pair_counts(chunks, n_b_ids)
    counts = pairs.join(totals, "key").select("chunk", "at", "total", "is_best")
    rows = chunks.where("keys is null").drop("keys", "docs")
    return rows.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInPandas(_score, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: every whole text of ``documents`` in both vocabularies."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
