"""Periodic runs of words by maximal pairs.

A run of period q is a stretch [i, i + L) of words in which words q apart are
identical, which no neighbouring word extends. Then i and i + q start equal
sequences of L - q words that are preceded by different words and followed by
different words: a maximal pair at distance q. The other way round, a maximal
pair at distance d with a common length of at least (e - 1) d is such a stretch
of period d and exponent e or more, with nothing left to extend; where d is a
multiple of the smallest period, the smaller distance gives the same stretch.

Maximal pairs come from the suffix array of the text's words. Neighbouring
suffixes and their common prefix lengths (LCP) form a tree of intervals, which
a stack walks from the bottom up. Every interval holds its places by the word to
their left (class lists). Where two intervals meet in one of LCP l, places of
the smaller look for places of the larger at a distance of at most l / (e - 1)
and of another class. All places in that reach start the same l words, so they
lie in one stretch of one period, and only its first place can have a class of
its own: to the right of a place the reach holds one class, to the left only
the farthest place can differ. So no list is searched for nothing, and a
passage repeated n times costs n log n.

Texts without a repeated window of as many words as the shortest common length
have no runs and get no suffix array.

Defined cases. Null text has no words. Words are separated by the white space
of ASCII alone and compared as they are. Very long texts are one task's work but
never one group's: documents do not meet. Rows with one doc_id are separate
rows. An empty table gives no rows. Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import text_or_empty

MIN_LENGTH = 6
MIN_EXPONENT = 4
_START = -1   # the class of a place with no word to its left


def suffix_order(words: np.ndarray) -> np.ndarray:
    """Places in the order of the suffixes of ``words`` (ids from 0), by prefix
    doubling. Only places that still share a prefix are sorted again."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    heads = np.concatenate(([True], words[order][1:] != words[order][:-1]))
    rank = np.full(n + 1, -1, np.int64)       # the end of the text comes first
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    step = 1
    while not heads.all():
        # slots of groups that hold more than one place
        open_slots = np.flatnonzero(~(heads & np.append(heads[1:], True)))
        places = order[open_slots]
        first, second = rank[places], rank[np.minimum(places + step, n)]
        again = np.lexsort((second, first))
        places, first, second = places[again], first[again], second[again]
        order[open_slots] = places
        new = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        heads[open_slots] = new
        rank[places] = np.maximum.accumulate(np.where(new, open_slots, 0))
        step *= 2
    return order


def common_prefixes(words: list[int], order: list[int]) -> list[int]:
    """For every slot of the suffix order, the number of words its suffix shares
    with the one before it (0 for the first), in linear time."""
    n = len(words)
    slot = [0] * n
    for k, place in enumerate(order):
        slot[place] = k
    lcp, same = [0] * n, 0
    for place in range(n):
        k = slot[place]
        if not k:
            same = 0
            continue
        other = order[k - 1]
        most = n - max(place, other)
        while same < most and words[place + same] == words[other + same]:
            same += 1
        lcp[k] = same
        if same:
            same -= 1
    return lcp


class Interval:
    """The places of one LCP interval: all in order, and in order by class."""

    __slots__ = ("places", "classes")

    def __init__(self, place: int, left: int):
        self.places = [place]
        self.classes = {left: [place]}

    def absorb(self, other: Interval) -> None:
        for mine, more in [(self.places, other.places), *[
                (self.classes.setdefault(c, []), found) for c, found in other.classes.items()]]:
            if len(more) < 8:
                for place in more:
                    insort(mine, place)
            else:
                mine.extend(more)
                mine.sort()


def close_pairs(small: Interval, large: Interval, reach: int, left: list[int]) -> Iterator[tuple[int, int]]:
    """(place, farther place) of another class, one from each interval, at a
    distance of at most ``reach`` (less than half the common length)."""
    for place in small.places:
        own, places = left[place], large.places
        k = bisect_right(places, place)
        if k < len(places) and places[k] <= place + reach and left[places[k]] != own:
            found = large.classes[left[places[k]]]
            for j in range(bisect_right(found, place), bisect_right(found, place + reach)):
                yield place, found[j]
        j = bisect_left(places, place - reach)
        if j < k and left[places[j]] != own:
            yield places[j], place


def runs(words: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs of at least ``min_length``
    words and ``exponent`` (3 or more) periods, by start and period."""
    # the shortest common length a wanted pair can have
    least = min(max(min_length - d, (exponent - 1) * d) for d in range(1, min_length + 1))
    if len(words) < min_length or not repeats(words, least):
        return []
    order = suffix_order(words).tolist()
    text = words.tolist()
    lcp, left = common_prefixes(text, order), [_START, *text[:-1]]
    period: dict[tuple[int, int], int] = {}

    def meet(a: Interval, b: Interval, shared: int) -> Interval:
        small, large = (a, b) if len(a.places) < len(b.places) else (b, a)
        for i, j in close_pairs(small, large, shared // (exponent - 1), left):
            stretch = (i, j - i + shared)
            if stretch[1] >= min_length and period.get(stretch, j - i) >= j - i:
                period[stretch] = j - i
        large.absorb(small)
        return large

    waiting: list[tuple[int, Interval]] = []   # LCP with what comes next, and the places
    shared_next = [*lcp[1:], 0]
    for place, shared in zip(order, shared_next):
        if shared < least and not waiting:
            continue
        done = Interval(place, left[place])
        while waiting and waiting[-1][0] >= shared:
            depth, before = waiting.pop()
            done = meet(before, done, depth)
        if shared >= least:
            waiting.append((shared, done))
        else:
            waiting.clear()
    return sorted(((i, n, q) for (i, n), q in period.items()), key=lambda r: (r[0], r[2]))


def repeats(words: np.ndarray, width: int) -> bool:
    """Whether some window of ``width`` words occurs twice (by 64-bit hash, so
    a wrong yes is possible, a wrong no is not)."""
    if len(words) <= width:
        return False
    mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    total = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        total = total * np.uint64(0xBF58476D1CE4E5B9) + mixed[k:k + len(total)]
    total.sort()
    return bool((total[1:] == total[:-1]).any())


def numbered(words: list) -> np.ndarray:
    ids: dict = {}
    return np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))


def collapse(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words that stay when every run is cut to its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in found:
        edge[start + q] += 1
        edge[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def collapsed_text(text: str | None) -> str:
    """A text with every run of words cut to its first period (words joined by
    one space); other white space is lost."""
    words = (text or "").encode().split()
    return b" ".join(collapse(words, runs(numbered(words)))).decode()


def planted(words: list, doc_id: int | None) -> list:
    """The words of the contract: a tenth of the documents, chosen by the hash
    of their id, get a periodic tail. A null id gets none."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = planted(text.as_py().encode().split(), doc_id)
            found = runs(numbered(words))
            longest = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
            listed = "".join(f"{i},{n},{q}\n" for i, n, q in found)
            rows.append((doc_id, len(found), *longest, 1000 * longest[1] // longest[2] if found else None,
                         hashlib.sha256(listed.encode()).hexdigest(),
                         hashlib.sha256(b" ".join(collapse(words, found))).hexdigest()))
        columns = list(zip(*rows)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.string() if n.endswith("256") else pa.int64()) for n, c in zip(names, columns)], names)


def run_digests(docs: DataFrame) -> DataFrame:
    """One row per document: the contract's columns."""
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(
        _digest_batches, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
                         "runs_sha256 string, collapsed_sha256 string")


def _run_batches(min_length: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc_id, *r) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1))
                    for r in runs(numbered(text.as_py().encode().split()), min_length, exponent)]
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                             ["doc_id", "start", "length", "period"])
    return run


def run_rows(docs: DataFrame, min_length: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> DataFrame:
    """One row per run of the texts as they are: doc_id, start, length, period."""
    if exponent < 3:
        raise ValueError("runs of fewer than three periods are not found by this reach")
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(
        _run_batches(min_length, exponent), "doc_id long, start long, length long, period long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the runs of every whole text of ``documents``."""
    return run_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
