"""Quality rules under weak supervision.

Ten rules look at the measures of a text. Each votes good (1), bad (-1) or
abstains (0). No labels are used: expectation-maximisation over a model of two
hidden classes estimates the share of good texts and, for every rule, how often
it is right on good and on bad texts when it votes. The posterior probability
that a text is good, given all its votes, replaces a demand that every rule
passes: one unlucky vote of a rule that often errs does not reject a text, two
votes of exact ones do.

Measuring is one pass over the texts. The model sees every document, but only
through the number of documents with each pattern of votes: at most 3^10 =
59,049 rows whatever the size of the table, which are what the driver reads.
The posterior is a column expression over the votes.

Defined cases. Null text counts as empty. Words are separated by the white
space of ASCII alone. A text without words has all measures zero and only the
rule on length votes. Rows with one doc_id are separate rows; equal texts have
equal results. An empty table gives no rows. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import stored, text_or_empty

SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
# a document is kept from this posterior probability on
PROBABILITY = 0.5

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_letter_words", "n_capital_words", "n_marked_words", "n_bare_words", "n_twice"]

# fixed values: (rule, votes good where, votes bad where); it abstains elsewhere
RULES = [
    ("length", f"n_words >= {2 * MIN_WORDS}", f"n_words < {MIN_WORDS}"),
    ("word_length", "word_chars between 3 * n_words and 10 * n_words",
     "word_chars < 2.5 * n_words or word_chars > 12 * n_words"),
    ("symbols", "n_symbols <= 0.05 * n_words", "n_symbols > 0.1 * n_words"),
    # a share of fewer than ten lines says little against a text
    ("dup_lines", "n_dup_lines <= 0.1 * n_lines", "n_lines >= 10 and n_dup_lines > 0.3 * n_lines"),
    ("repeats", "n_repeat_words <= 0.1 * n_words", "n_repeat_words > 0.3 * n_words"),
    ("letters", "n_letter_words >= 0.8 * n_words", "n_letter_words < 0.7 * n_words"),
    ("capitals", "n_capital_words <= 0.1 * n_words", "n_capital_words > 0.3 * n_words"),
    ("marks", "n_marked_words <= 0.05 * n_words", "n_marked_words > 0.2 * n_words"),
    ("bare_marks", "n_bare_words <= 0.05 * n_words", "n_bare_words > 0.15 * n_words"),
    ("stutter", "n_twice <= 0.05 * n_words", "n_twice > 0.2 * n_words"),
]

_LETTER = re.compile(r"[^\W\d_]")
_MARKS_AT_END = re.compile(r"[^\w\s]{2}$")


class _Kinds(dict):
    """Properties of a word as bits: 1 holds a letter, 2 two or more capitals
    and no small letter, 4 two marks at the end, 8 neither letter nor digit."""

    def __missing__(self, raw: bytes) -> int:
        word = raw.decode()
        letter = bool(_LETTER.search(word))
        kind = letter + 2 * (word.isupper() and len(_LETTER.findall(word)) > 1) \
            + 4 * bool(_MARKS_AT_END.search(word)) + 8 * (not letter and not any(map(str.isdigit, word)))
        if len(raw) <= 64:
            if len(self) > 500_000:
                self.clear()
            self[raw] = kind
        return kind


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    number: dict[tuple, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in windows), np.int64, len(windows))
    often = np.bincount(ids)[ids] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k:len(words) - 2 + k] |= often
    return int(inside.sum())


def measure(text: str, kinds: dict[bytes, int]) -> tuple[int, ...]:
    """The MEASURES of one whole text."""
    words = text.encode("utf-8").split()
    lines = [line for line in text.split("\n") if line.strip(BLANK)]
    kind = np.bincount(np.frombuffer(bytes(map(kinds.__getitem__, words)), np.uint8), minlength=16)
    having = [int(kind[[k for k in range(16) if k & bit]].sum()) for bit in (1, 2, 4, 8)]
    return (len(words), len(text) - sum(map(text.count, BLANK)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words), len(lines), *having,
            sum(map(operator.eq, words, words[1:])))


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = _Kinds()
    for batch in batches:
        found = [measure(text.as_py(), kinds) for text in batch.column(1)]
        columns = zip(*found) if found else [()] * len(MEASURES)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", *MEASURES])


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the MEASURES of every whole text."""
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(
        _measure_batches, ", ".join(["doc_id long", *[f"{m} long" for m in MEASURES]]))


def votes() -> list[Column]:
    """A column vote_<rule> (1, -1 or 0) for each rule."""
    return [F.when((F.col("n_words") > 0) | F.lit(rule == "length"),
                   F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0)).otherwise(0).alias(f"vote_{rule}")
            for rule, good, bad in RULES]


class LabelModel:
    """Two hidden classes. ``right_good[j]`` and ``right_bad[j]`` are the
    probabilities that rule j, where it votes, votes for the class of a good
    and of a bad text; ``good`` is the share of good texts."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, strength: float = 10.0, rounds: int = 1000):
        """EM over the distinct ``patterns`` (rows of 1, -1, 0) and the number
        of documents of each. ``strength`` documents stand for the prior: good
        texts fail a rule one time in twenty, bad ones two times in five, and
        four texts in five are good. A rule never counts as worse than chance,
        so the two classes cannot change places."""
        n_rules = patterns.shape[1] if patterns.size else len(RULES)
        self.good, self.right_good, self.right_bad = 0.8, np.full(n_rules, 0.95), np.full(n_rules, 0.4)
        if not len(counts):
            return
        up, down = (patterns == 1).astype(float), (patterns == -1).astype(float)
        before = -math.inf
        for _ in range(rounds):
            odds = self.log_odds(patterns)
            p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
            is_good, is_bad = p * counts, (1 - p) * counts
            self.good = (is_good.sum() + 0.8 * strength) / (counts.sum() + strength)
            self.right_good = np.clip((is_good @ up + 0.95 * strength) / (is_good @ (up + down) + strength), 0.5, 0.9999)
            self.right_bad = np.clip((is_bad @ down + 0.4 * strength) / (is_bad @ (up + down) + strength), 0.01, 0.9999)
            self.right_bad = np.maximum(self.right_bad, 1.01 - self.right_good)
            state = float(p @ counts)
            if abs(state - before) < 1e-9 * max(1.0, float(counts.sum())):
                break
            before = state

    def weights(self) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-odds for good: at the start, for a good and for a bad vote."""
        return (math.log(self.good / (1 - self.good)), np.log(self.right_good / (1 - self.right_bad)),
                np.log((1 - self.right_good) / self.right_bad))

    def log_odds(self, patterns: np.ndarray) -> np.ndarray:
        start, up, down = self.weights()
        return start + (patterns == 1) @ up + (patterns == -1) @ down

    def probability(self) -> Column:
        """Posterior probability of good, from the vote columns."""
        start, up, down = self.weights()
        odds = F.lit(start)
        for (rule, _, _), u, d in zip(RULES, up.tolist(), down.tolist()):
            odds = odds + F.when(F.col(f"vote_{rule}") == 1, u).when(F.col(f"vote_{rule}") == -1, d).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit(voted: DataFrame) -> LabelModel:
    """The model of all rows of ``voted`` (with the vote columns)."""
    names = [f"vote_{rule}" for rule, _, _ in RULES]
    rows = voted.groupBy(*names).count().collect()
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, len(names) + 1)
    return LabelModel(table[:, :-1], table[:, -1].astype(float))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, model: LabelModel | None = None) -> DataFrame:
    """One row per document: doc_id, MEASURES, votes, probability (of good),
    base_failed and kept. Without a ``model`` one is fitted to all of ``docs``;
    the measures are a table on shared storage, so texts are read once."""
    voted = measures(docs).select("*", *votes())
    if model is None:
        voted = stored(voted, "votes")
        model = fit(voted)
    return voted.select("*", model.probability().alias("probability"), base_failed().alias("base_failed")) \
        .withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= PROBABILITY))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every whole text of ``documents`` judged by its rules' votes."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "probability")
