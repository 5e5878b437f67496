"""Token-id shards compressed by Re-Pair grammars.

Documents are dealt out by ranges of doc_id, tokenized, and written as shards
of about a million ids in ascending doc_id order. In a shard, frequent pairs
of neighbouring symbols are replaced by new symbols, round after round, until
none is seen MIN_COUNT times or the 65,536 symbols are used up; the rules, the number of ids each rule expands to, and every document's place are
stored, so one document (or a span of it) is decoded without the rest.

File format (little-endian), one binary value per shard: magic ``LLRP``,
uint32 version, uint64 counts of rounds, rules, symbols and documents; uint32
first new symbol of every round; uint16 pair of every rule; uint32 expansion
length of every rule; uint64 ids and uint64 symbols of every document; uint16
symbols. No pair crosses a document's end.

Defined cases. Null text counts as empty and has only the end id. Rows with
one doc_id stand next to each other (by text hash, then input place); null ids
come first. An empty table gives an empty file set and no rows. Other columns
are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import scratch_path, text_or_empty
from ledgerlight.llm.tokens import BYTE, crc, encoded_documents

MAGIC, VERSION = b"LLRP", 1
SHARD_IDS = 1 << 20
RULES_PER_ROUND = 3000
MIN_COUNT = 24
SYMBOLS = 1 << 16


def frequent_pairs(sym: np.ndarray, last: np.ndarray, most: int, least: int) -> np.ndarray:
    """Keys (left << 16 | right) of the most frequent pairs, best first."""
    key = (sym[:-1].astype(np.uint32) << 16 | sym[1:])[~last[:-1]]
    key.sort()
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.append(heads, len(key)))
    enough = counts >= least
    keys, counts = key[heads][enough], counts[enough]
    return keys[np.lexsort((keys, -counts))][:most]


def replace_pairs(sym: np.ndarray, last: np.ndarray, keys: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Replace occurrences of pair ``keys[k]`` by symbol base + k. Where
    occurrences overlap, the more frequent pair goes first, then the left one."""
    # rank of a pair by a table over the symbols that start and end one
    none = np.int16(len(keys))
    lefts, rights = np.unique(keys >> 16), np.unique(keys & 0xFFFF)
    row, col = np.zeros(SYMBOLS, np.int32), np.zeros(SYMBOLS, np.int32)
    row[lefts], col[rights] = np.arange(1, len(lefts) + 1) * (len(rights) + 1), np.arange(1, len(rights) + 1)
    table = np.full((len(lefts) + 1) * (len(rights) + 1), none)
    table[row[keys >> 16] + col[keys & 0xFFFF]] = np.arange(len(keys))
    rank = table[row[sym[:-1]] + col[sym[1:]]]
    rank[last[:-1]] = none
    at = np.flatnonzero(rank != none).astype(np.int32)
    rank = rank[at]
    won_at, won_rank = [], []
    while len(at):
        # an occurrence is taken when no overlapping one goes before it; what
        # overlaps a taken one is out, and the rest is looked at again
        near = np.diff(at) == 1
        left = np.concatenate(([True], ~near | (rank[1:] < rank[:-1])))
        right = np.concatenate((~near | (rank[:-1] <= rank[1:]), [True]))
        taken = left & right
        won_at.append(at[taken])
        won_rank.append(rank[taken])
        rest = ~taken
        rest[1:] &= ~(taken[:-1] & near)
        rest[:-1] &= ~(taken[1:] & near)
        at, rank = at[rest], rank[rest]
    where = np.concatenate([*won_at, np.zeros(0, np.int32)])
    rank = np.concatenate([*won_rank, np.zeros(0, np.int16)]).astype(np.int32)
    sym, last = sym.copy(), last.copy()
    sym[where] = base + rank
    last[where] = last[where + 1]
    stay = np.ones(len(sym), bool)
    stay[where + 1] = False
    return sym[stay], last[stay]


def compress(ids: np.ndarray, sizes: np.ndarray, rounds: int | None = None, per_round: int = RULES_PER_ROUND,
             least: int = MIN_COUNT) -> bytes:
    """The binary shard of documents with ``sizes`` ids (all at least 1) each."""
    top = int(ids.max(initial=0)) + 1
    if top > SYMBOLS:
        raise ValueError("ids of 65,536 and more do not fit this format")
    sym = ids.astype(np.uint16)
    last = np.zeros(len(sym), bool)
    last[np.cumsum(sizes) - 1] = True
    rules, lengths, bases = np.zeros((0, 2), np.uint16), np.zeros(0, np.int64), []
    first = top
    while rounds is None or len(bases) < rounds:
        keys = frequent_pairs(sym, last, min(per_round, SYMBOLS - top), least) if len(sym) > 1 else np.zeros(0, np.uint32)
        if not len(keys):
            break
        bases.append(top)
        pair = np.stack([keys >> 16, keys & 0xFFFF], axis=1).astype(np.uint16)
        known = np.concatenate([np.ones(first, np.int64), lengths])
        lengths = np.concatenate([lengths, known[pair[:, 0]] + known[pair[:, 1]]])
        rules = np.concatenate([rules, pair])
        sym, last = replace_pairs(sym, last, keys, top)
        top += len(keys)
    held = np.diff(np.concatenate(([0], np.flatnonzero(last) + 1)))
    head = MAGIC + struct.pack("<I5Q", VERSION, len(bases), len(rules), len(sym), len(sizes), first)
    return b"".join([head, np.array(bases, "<u4").tobytes(), rules.astype("<u2").tobytes(),
                     lengths.astype("<u4").tobytes(), sizes.astype("<u8").tobytes(),
                     held.astype("<u8").tobytes(), sym.astype("<u2").tobytes()])


class Shard:
    """One compressed shard, opened for reading."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a shard")
        version, n_rounds, n_rules, n_sym, n_docs, self.first = struct.unpack_from("<I5Q", raw, 4)
        if version != VERSION:
            raise ValueError(f"unknown version {version}")
        at = 4 + struct.calcsize("<I5Q")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(raw, kind, n, at)
            at += found.nbytes
            return found

        self.bases = take("<u4", n_rounds)
        self.rules = take("<u2", 2 * n_rules).reshape(-1, 2)
        self.lengths = take("<u4", n_rules)
        self.sizes, self.held = take("<u8", n_docs), take("<u8", n_docs)
        self.symbols = take("<u2", n_sym)
        self.at = np.concatenate(([0], np.cumsum(self.held.astype(np.int64))))

    def expand(self, sym: np.ndarray) -> np.ndarray:
        """ids of a run of symbols: the rounds undone, last first."""
        sym = sym.astype("<u4")
        for base in self.bases[::-1].tolist():
            made = sym >= base
            place = np.arange(len(sym)) + np.cumsum(made) - made
            out = np.empty(len(sym) + int(made.sum()), "<u4")
            rule = self.rules[sym[made] - self.first]
            out[place[~made]] = sym[~made]
            out[place[made]], out[place[made] + 1] = rule[:, 0], rule[:, 1]
            sym = out
        return sym

    def ids(self) -> np.ndarray:
        """ids of all documents: every rule is expanded once, and symbols take
        their ids from that table. It is no longer than the shard's rounds / 12
        times its ids, as a pair is only replaced where it is frequent."""
        table = self.expand(np.arange(self.first, self.first + len(self.lengths)))
        single = np.arange(self.first, dtype="<u4")
        width = np.concatenate([np.ones(self.first, np.int64), self.lengths.astype(np.int64)])
        first, width = (np.cumsum(width) - width)[self.symbols], width[self.symbols]
        place = np.repeat(first - (np.cumsum(width) - width), width)
        place += np.arange(len(place))
        return np.concatenate([single, table])[place]

    def document(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """ids ``start`` to ``stop`` of document ``i``, expanding only the
        symbols that cover them."""
        sym = self.symbols[self.at[i]:self.at[i + 1]]
        stop = int(self.sizes[i]) if stop is None else stop
        width = np.ones(len(sym), np.int64)
        made = sym >= self.first
        width[made] = self.lengths[sym[made].astype(np.int64) - self.first]
        ends = np.cumsum(width)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skipped = int(ends[a - 1]) if a else 0
        return self.expand(sym[a:b])[start - skipped:stop - skipped]


def _write(shard_ids: int, name: str, path: str | None, rounds: int | None, per_round: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        raws: list[bytes] = []
        held = 0

        def emit() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(raws), "<u4")
            sizes = np.array([len(r) // 4 for r in raws])
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([number]), pa.array([before]), pa.array([len(ids)]),
                 pa.array([docs], pa.list_(pa.int64())),
                 pa.array([compress(ids, sizes, rounds, per_round)], pa.binary())],
                ["part", "number", "before", "n_ids", "doc_ids", "shard"])

        for doc, raw in encoded_documents(batches, name, path):
            docs.append(doc)
            raws.append(raw)
            held += len(raw) // 4
            if held >= shard_ids:
                yield emit()
                number, before, held = number + 1, before + held, 0
                docs, raws = [], []
        if docs:
            yield emit()
    return run


def write_shards(docs: DataFrame, path: str, shard_ids: int = SHARD_IDS, name: str = BYTE,
                 vocabulary: str | None = None, rounds: int | None = None, per_round: int = RULES_PER_ROUND) -> None:
    """Write all documents as shards below ``path`` in ascending doc_id order.

    Rows are dealt out by (doc_id, text hash, input place), so rows of one id
    can be split over tasks too."""
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    keyed = rows.withColumn("h", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    keyed.repartitionByRange("doc_id", "h", "place").sortWithinPartitions("doc_id", "h", "place") \
        .select("doc_id", "text") \
        .mapInArrow(_write(shard_ids, name, vocabulary, rounds, per_round),
                    "part long, number long, before long, n_ids long, doc_ids array<long>, shard binary") \
        .write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            doc_ids, raw, start = (batch.column(k)[row].as_py() for k in range(3))
            shard = Shard(raw)
            ids = shard.ids().tobytes()
            ends = np.cumsum(shard.sizes.astype(np.int64))
            begins = ends - shard.sizes.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(start + begins), pa.array(ends - begins),
                 pa.array([crc(ids[4 * a:4 * b]) for a, b in zip(begins.tolist(), ends.tolist())], pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents
    before it), n_tokens and the CRC-32 of its ids.

    What reaches the driver is one number per range of doc_id (as many as the
    write had tasks), and the same small table is broadcast."""
    files = spark.read.schema("part long, number long, before long, n_ids long, doc_ids array<long>, shard binary") \
        .parquet(path)
    base, bases = 0, []
    for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        bases.append((r["part"], base))
        base += r["n"]
    offsets = spark.createDataFrame(bases, "part long, base long")
    return files.join(F.broadcast(offsets), "part") \
        .select("doc_ids", "shard", (F.col("base") + F.col("before")).alias("start")) \
        .mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all ``documents`` written as shards and read back."""
    path = scratch_path(spark, "token-shards")
    write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_shards(spark, path)
