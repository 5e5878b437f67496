"""Bounded-space online packing of tokenized documents into fixed windows.

Every partition keeps a fixed number of open windows. A piece goes to the open
window it fills best; when it fits none, the fullest window takes as much of
its head as it has room for (documents may be cut) and is emitted. Leftover
open windows are merged the same way, in rounds of a fixed fan-in, until one
task holds the last of them: no task ever holds more than ``fan_in`` x
``open_windows`` windows.

Defined cases. Null and empty texts are one piece holding only the end id.
Rows with the same doc_id are packed separately; ``copy`` is a number of the
row (its partition above 40 bits, its place below), so the pieces of a repeated
id can be told apart wherever its rows lie. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import stored, text_or_empty
from ledgerlight.llm.tokens import WORD, crc, encoded_documents

WINDOW = 4096
OPEN_WINDOWS = 64
FAN_IN = 32
PIECE = "doc_id long, copy long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, open boolean"


class Packer:
    """Open windows of one task. ``add`` and ``finish`` return the windows
    that are done, each a list of pieces in order."""

    def __init__(self, size: int = WINDOW, keep: int = OPEN_WINDOWS):
        self.size, self.keep = size, keep
        self.open: list[tuple[int, list]] = []   # (used, pieces)

    def _best(self, n: int) -> int:
        best, room = -1, self.size + 1
        for i, (used, _) in enumerate(self.open):
            if n <= self.size - used < room:
                best, room = i, self.size - used
        return best

    def add(self, n: int, cut) -> list[list]:
        """Place ``n`` ids; ``cut(a, b)`` makes the piece for ids a to b."""
        done, at = [], 0
        while n - at >= self.size:
            done.append([cut(at, at + self.size)])
            at += self.size
        if at == n:
            return done
        i = self._best(n - at)
        if i < 0 and len(self.open) >= self.keep:
            j = max(range(len(self.open)), key=lambda k: self.open[k][0])
            used, pieces = self.open.pop(j)
            room = self.size - used
            if room:
                pieces.append(cut(at, at + room))
                at += room
            done.append(pieces)
            i = self._best(n - at)
        if i < 0:
            self.open.append((n - at, [cut(at, n)]))
        else:
            used, pieces = self.open[i]
            pieces.append(cut(at, n))
            if used + n - at == self.size:
                done.append(self.open.pop(i)[1])
            else:
                self.open[i] = (used + n - at, pieces)
        return done


def _rows(windows: list[list], number: int, still_open: bool) -> list[tuple]:
    out = []
    for w, pieces in enumerate(windows, number):
        offset = 0
        for p in pieces:
            out.append((*p, w, offset, still_open))
            offset += p[3]
    return out


_SCHEMA = pa.schema([(c, pa.bool_() if c == "open" else pa.int64()) for c in
                     ("doc_id", "copy", "start", "length", "ids_crc32", "doc_tokens", "window", "offset", "open")])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)


def pack_partition(size: int, keep: int, name: str, path: str | None):
    """mapInArrow function: tokenize and pack the documents of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base, made = Packer(size, keep), TaskContext.get().partitionId() << 40, 0
        rows: list[tuple] = []
        for copy, (doc, raw) in enumerate(encoded_documents(batches, name, path)):
            n = len(raw) // 4
            done = packer.add(n, lambda a, b: (doc, base | copy, a, b - a, crc(raw[4 * a:4 * b]), n))
            rows += _rows(done, base + made, False)
            made += len(done)
            if len(rows) > 20_000:
                yield _batch(rows)
                rows = []
        rows += _rows([p for _, p in packer.open], base + made, True)
        if rows:
            yield _batch(rows)

    return run


def merge_leftovers(size: int, keep: int, last: bool):
    """applyInPandas function: pack the open windows of one group again,
    whole windows best-fit, none cut. The group's result is full windows and at
    most ``keep`` open ones (closed too in the last round)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="g").sort_values(["window", "offset"], kind="stable")
        used = pdf.groupby("window", sort=True)["length"].sum()
        order = used.sort_values(ascending=False, kind="stable")
        room: list[list] = []          # [free, target window, used]
        moved, closed = {}, set()
        for window, n in order.items():
            fits = [r for r in room if r[0] >= n]
            if fits:
                r = min(fits, key=lambda x: x[0])
                moved[window] = (r[1], size - r[0])
                r[0] -= n
            else:
                if len(room) >= keep:
                    full = min(room, key=lambda x: x[0])
                    closed.add(full[1])
                    room.remove(full)
                room.append([size - n, window])
                moved[window] = (window, 0)
        still = {r[1] for r in room if r[0] > 0} if not last else set()
        target = pdf["window"].map(lambda w: moved[w][0])
        pdf["offset"] = pdf["offset"] + pdf["window"].map(lambda w: moved[w][1])
        pdf["window"] = target
        pdf["open"] = target.isin(still)
        return pdf

    return run


def pack(docs: DataFrame, size: int = WINDOW, open_windows: int = OPEN_WINDOWS, fan_in: int = FAN_IN,
         name: str = WORD, path: str | None = None) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, copy. Each round's result is a table on shared
    storage, so a lost executor repeats one round at most."""
    spark = docs.sparkSession
    made = stored(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(
        pack_partition(size, open_windows, name, path), PIECE), "packed")
    done = made.where("not open")
    left = made.where("open")
    groups = (made.agg(F.max(F.expr("shiftright(window, 40)"))).first()[0] or 0) + 1
    width = 1
    while True:
        # windows keep the partition they were opened in; a round joins fan_in of them
        width *= fan_in
        last = width >= groups
        key = F.expr(f"floor(shiftright(window, 40) / {width})")
        merged = left.withColumn("g", key).groupBy("g").applyInPandas(
            merge_leftovers(size, open_windows, last), PIECE)
        merged = stored(merged, "leftovers")
        done = done.unionByName(merged.where("not open"))
        if last:
            break
        left = merged.where("open")
    return done.select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                       F.col("window").alias("sequence_id"), "offset", "copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all ``documents`` packed into sequences of at most 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
