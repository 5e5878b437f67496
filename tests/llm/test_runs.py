"""Periodic runs against a search of every period."""

import hashlib
import random
import time
import zlib

import numpy as np

from ledgerlight.llm import periodic_runs

DIR = "/root/testdata/sf0.01"


def slow(w, least=6, exponent=4):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((i, n, q) for (i, n), q in found.items()), key=lambda r: (r[0], r[2]))


def some_words(rng, size, kinds):
    words = []
    while len(words) < size:
        words += [rng.randrange(kinds) for _ in range(rng.randint(1, 5))] * rng.choice([1, 1, 2, 4, 5, 9])
    return words


def test_runs_by_brute_force():
    rng, seen = random.Random(1), 0
    for _ in range(4000):
        words = some_words(rng, rng.randint(0, 60), rng.choice([1, 2, 2, 3, 4, 9]))
        least, exponent = rng.choice([(6, 4), (6, 4), (6, 3), (3, 3), (10, 5)])
        want = slow(words, least, exponent)
        assert periodic_runs.runs(np.array(words, np.int64), least, exponent) == want
        seen += len(want)
    assert seen > 1000


def test_hostile_texts_take_little_time():
    n = 100_000
    passage = [w for i in range(n // 7) for w in (i + 10, 1, 2, 3, 4, 5, 6)]     # one passage, ever other words before it
    fibonacci = [0]
    before = [1]
    while len(fibonacci) < n:
        fibonacci, before = fibonacci + before, fibonacci
    for words in (np.zeros(n), np.arange(n) % 1000, np.array(passage), np.array(fibonacci)):
        started = time.process_time()
        found = periodic_runs.runs(words.astype(np.int64))
        assert time.process_time() - started < 30
        if len(set(words.tolist())) in (1, 1000):
            assert found == [(0, n, len(set(words.tolist())))]


def slow_row(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = slow(words)
    gone = {k for i, size, q in found for k in range(i + q, i + size)}
    longest = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[:1] or [(None, None, None)]
    return (doc_id, len(found), *longest[0], 1000 * longest[0][1] // longest[0][2] if found else None,
            hashlib.sha256("".join(f"{i},{size},{q}\n" for i, size, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest())


def test_query_by_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in periodic_runs.query(spark, DIR).collect()}
    assert len(got) == len(docs)
    some = [(i, t) for i, t in docs if len(t or "") < 3000]
    assert sum(got[i][1] > 0 for i, _ in some) > 20
    for doc_id, text in some:
        assert got[doc_id] == slow_row(doc_id, text)


def test_defined_cases(spark):
    same = "x " * 40
    rows = [(None, same), (1, None), (1, ""), (2, same), (2, same), (3, "a b\xa0c\n" * 30), (4, "\t\n "), (17, "a b c d e f g " * 9)]
    docs = spark.createDataFrame([(*r, "s", 7) for r in rows], "doc_id long, text string, start string, period int").repartition(3)
    got = sorted(map(tuple, periodic_runs.run_digests(docs).collect()), key=str)
    want = [slow_row(*r) for r in rows if r[0] is not None]
    nothing = hashlib.sha256(b"").hexdigest()
    assert (None, 1, 0, 40, 1, 40000) == next(r for r in got if r[0] is None)[:6]
    assert sorted([r for r in got if r[0] is not None], key=str) == sorted(want, key=str)
    assert (1, 0, None, None, None, None, nothing, nothing) in got
    assert periodic_runs.run_digests(docs.limit(0)).collect() == []
    spans = periodic_runs.run_rows(docs)
    assert {tuple(r) for r in spans.where("doc_id = 17").collect()} == {(17, 0, 63, 7)}
    assert periodic_runs.collapsed_text("go a b a b a b a b on") == "go a b on"
