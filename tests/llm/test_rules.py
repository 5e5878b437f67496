"""Quality rules: measures by brute force, votes and expectation-maximisation."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlight.llm import quality_rules as rules

DIR = "/root/testdata/sf0.01"
TEXT = st.lists(st.sampled_from(["a", "b", " ", "\n", " b a", "c\n", "#|", "\t", "\xa0", "é", "!!", "A B", "\r", "\x1c", "|"]),
                max_size=40).map("".join)
PROSE = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)} of" for i in range(80)) + "."
SHOUT = " ".join(f"WORD{chr(65 + i % 26)}{chr(65 + i // 26)}!!" for i in range(160))


def slow(text):
    """The contract's measures, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = text.split("\n")
    again = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_measures_by_brute_force(text):
    assert rules.measure(text, rules._Kinds())[:5] == slow(text)


def posterior_by_hand(model, pattern):
    good, bad = model.good, 1 - model.good
    for vote, g, b in zip(pattern, model.right_good, model.right_bad):
        if vote:
            good, bad = good * (g if vote > 0 else 1 - g), bad * (1 - b if vote > 0 else b)
    return good / (good + bad)


def test_model_recovers_accuracies():
    rng = np.random.default_rng(5)
    n, good_right, bad_right = 40_000, np.array([0.99, 0.95, 0.9, 0.99]), np.array([0.7, 0.6, 0.8, 0.5])
    good = rng.random(n) < 0.75
    right = rng.random((n, 4)) < np.where(good[:, None], good_right, bad_right)
    votes = np.where(right == good[:, None], 1, -1) * (rng.random((n, 4)) < 0.9)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = rules.LabelModel(patterns, counts.astype(float))
    assert abs(model.good - 0.75) < 0.03
    assert np.abs(model.right_good - good_right).max() < 0.03 and np.abs(model.right_bad - bad_right).max() < 0.06
    # EM once more from its end, by hand: the estimates are a fixed point
    p = np.array([posterior_by_hand(model, x) for x in patterns])
    assert np.allclose(1 / (1 + np.exp(-model.log_odds(patterns))), p)
    assert abs(((p * counts).sum() + 8) / (n + 10) - model.good) < 1e-4


def test_all_good_and_empty_patterns():
    model = rules.LabelModel(np.ones((1, len(rules.RULES)), int), np.array([5000.0]))
    assert posterior_by_hand(model, [1] * len(rules.RULES)) > 0.99
    assert rules.LabelModel(np.zeros((0, len(rules.RULES)), int), np.zeros(0)).good == 0.8


def test_one_bad_vote_does_not_reject(spark):
    # a third of all rows are copies of one text; one clean text has many capitals
    capitals = PROSE + " " + " ".join(["NATO DATA"] * 1 + [f"CODE{chr(65 + i % 26)}{i}X" for i in range(90)])
    rows = [(i, PROSE + f" end{i}") for i in range(200)] + [(1000 + i, SHOUT) for i in range(150)] + [
        (2000 + i, SHOUT + f" ODD{i}!!") for i in range(30)] + [(3000, capitals), (3001, None), (3002, ""), (None, PROSE), (3000, "x " * 60)]
    docs = spark.createDataFrame([(*r, 0, 1.0) for r in rows], "doc_id long, text string, n_words int, kept double").repartition(5)
    got = rules.judge(docs)
    kept = {(r["doc_id"], r["n_words"]): r["kept"] for r in got.collect()}
    assert got.count() == len(rows)
    assert all(kept[k] == (k[0] is None or k[0] < 1000) for k in kept if k[0] != 3000)
    assert kept[3000, 60] is False and kept[3001, 0] is False
    again = {(r["doc_id"], r["n_words"]): r["kept"] for r in rules.judge(docs.repartition(1)).collect()}
    assert again == kept


def test_posterior_column_is_the_model(spark):
    voted = rules.measures(spark.read.parquet(f"{DIR}/documents.parquet")).select("*", *rules.votes())
    model = rules.fit(voted)
    names = [f"vote_{r[0]}" for r in rules.RULES]
    for row in voted.select(*names, model.probability().alias("p")).distinct().collect():
        assert abs(row["p"] - posterior_by_hand(model, [row[n] for n in names])) < 1e-9


def test_query_against_labels_and_brute_force(spark):
    got = {r["doc_id"]: r for r in rules.query(spark, DIR).collect()}
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        r, want = got[doc_id], slow(text or "") if len(text or "") < 4000 else None
        if want:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    labels = spark.read.parquet(f"{DIR}/labels.parquet").collect()
    clean = [got[r["doc_id"]]["kept"] for r in labels if r["quality"] == 1 and not got[r["doc_id"]]["base_failed"]]
    junk = [got[r["doc_id"]]["kept"] for r in labels if r["quality"] == 0]
    assert sum(clean) == len(clean) and sum(junk) <= 0.02 * len(junk)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, probability string")
    assert rules.judge(empty).collect() == []
