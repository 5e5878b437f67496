"""Exact, line and SimHash deduplication against brute force, with nulls,
empty and long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import os
from collections import defaultdict

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlight.llm import exact_dedup, line_dedup, simhash
from ledgerlight.llm.common import components

WORDS = "the river and stone under a pale moon where seven birds cross slowly over old wooden bridges near town".split()


def prose(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + (str(rng.integers(50)) if rng.random() < 0.5 else "") for i in rng.integers(0, len(WORDS), n))


A, B, LONG = prose(60, 1), prose(60, 2), prose(5000, 3)
SCHEMA = "doc_id long, text string, fp string, id string, line string, key string, n_kept string, part string, _d int"
ROWS = [(i, t, "x", "y", "z", "k", "n", "p", 0) for i, t in [
    (1, A), (2, A.upper()), (3, A + "\n" + B), (4, B + " again"), (5, None), (6, ""), (6, ""), (None, A), (7, "  \n\n"),
    (8, LONG), (9, LONG + " end"), (10, "Älter ÄLTER"), (11, "älter älter"), (12, "one"), (12, "two"), (13, A.replace("river", "rivers", 1))]]


def docs(spark, rows=ROWS, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def union_find(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def test_components_chain_star_and_nulls(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def exact_reference(rows):
    groups = defaultdict(list)
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    for r in rows:
        groups[low(r[1])].append(r[0])
    out = []
    for r in rows:
        g = groups[low(r[1])]
        keep = max((x for x in g if x is not None), default=None)
        out.append((r[0], keep, len(g), r[0] == keep, hashlib.sha256(low(r[1]).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_dedup(spark):
    got = exact_dedup.exact_dedup(docs(spark)).collect()
    assert sorted([tuple(r) for r in got], key=repr) == exact_reference(ROWS)
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_index_keeps_what_it_knew(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = docs(spark, ROWS[:2])
    assert {r["keep_id"] for r in exact_dedup.exact_dedup(first, index).collect()} == {2}
    again = exact_dedup.exact_dedup(docs(spark, [(50, A, *ROWS[0][2:]), (51, "new", *ROWS[0][2:])]), index).collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in again} == {(50, 2, False), (51, 51, True)}
    assert index.rows().count() == 2


def test_index_counts_every_batch(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    rest = ROWS[0][2:]
    batches = [[(1, A), (2, A.upper()), (None, "x")], [(3, A), (4, "new"), (5, "x")], [(6, A), (7, A), (8, "new"), (9, "new")]]
    got = [{(r["doc_id"], r["keep_id"], r["group_size"]) for r in
            exact_dedup.exact_dedup(docs(spark, [(*r, *rest) for r in b]), index).collect()} for b in batches]
    assert got == [{(1, 2, 2), (2, 2, 2), (None, None, 1)}, {(3, 2, 3), (4, 4, 1), (5, None, 2)},
                   {(6, 2, 5), (7, 2, 5), (8, 4, 3), (9, 4, 3)}]
    assert index.rows().count() == 3


def line_reference(rows):
    def entry(x):
        return x.strip(" \t\r").lower()

    def shingles(x):
        return frozenset(x[i:i + 5] for i in range(max(1, len(x) - 4)))

    def key(r):
        t = xxhash.xxh64_intdigest((r[1] or "").encode(), 42)
        return (2 ** 63 - 1 if r[0] is None else r[0], t - 2 ** 64 if t >= 2 ** 63 else t)
    first = {}
    for r in sorted(rows, key=key):
        for p, x in enumerate((r[1] or "").split("\n")):
            if entry(x):
                first.setdefault(entry(x), (*key(r), p))
    lines = list(first)
    sets = [shingles(x) for x in lines]
    links = [(i, j) for i in range(len(lines)) for j in range(i)
             if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    part = union_find(len(lines), links)
    best = {}
    for x, c in zip(lines, part):
        best[c] = min(best.get(c, first[x]), first[x])
    of = dict(zip(lines, part))
    out = []
    for r in rows:
        parts = (r[1] or "").split("\n")
        kept = [x for p, x in enumerate(parts) if not entry(x) or best[of[entry(x)]] == (*key(r), p)]
        out.append((r[0], "\n".join(kept), len(parts), len(kept)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    noisy = [(20 + i, "\n".join([A + f" tail {i}", prose(30, 40 + i), B, "short", f"{i}", A[:-3] + "xyz", "  " + B + " "]), *ROWS[0][2:])
             for i in range(8)]
    rows = ROWS + noisy
    got = line_dedup.line_dedup(docs(spark, rows))
    assert set(SCHEMA_NAMES) <= set(got.columns)
    assert sorted([(r["doc_id"], r["text"], r["n_lines"], r["n_kept"]) for r in got.collect()], key=repr) == line_reference(rows)
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def test_line_dedup_many_copies_of_a_line(spark):
    """Thousands of near copies of one line are one component, found without
    forming all their pairs."""
    base = prose(120, 9)
    rows = [(i, base + f" {i}\n" + prose(12, 1000 + i), *ROWS[0][2:]) for i in range(400)]
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs(spark, rows, 6)).collect()}
    assert got[0]["n_kept"] == 2
    assert all(got[i]["text"] == prose(12, 1000 + i) for i in range(1, 400))


def test_unlike_lines_of_one_bucket_form_no_pairs(spark, monkeypatch):
    """Lines with one long beginning share buckets and look alike by sketch, but
    are not similar: their pairs are not formed, and no link is lost."""
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    start = "".join(rng.choice(letters, 79))
    lines = [start + "".join(rng.choice(letters, 21)) for _ in range(120)]      # 75 shingles of 117
    lines += [x[:-4] + "".join(rng.choice(letters, 4)) for x in lines[::10]]    # 92 of 100
    rows = [(i, x, *ROWS[0][2:]) for i, x in enumerate(lines)]
    formed = []
    keep = line_dedup.stored

    def counted(df, name):
        out = keep(df, name)
        if name == "pairs":
            formed.append((out.count(), out.distinct().count()))
        return out
    monkeypatch.setattr(line_dedup, "stored", counted)
    got = line_dedup.line_dedup(docs(spark, rows)).collect()
    assert sorted([(r["doc_id"], r["text"], r["n_lines"], r["n_kept"]) for r in got], key=repr) == line_reference(rows)
    # about 8,500 of all 8,646 pairs before
    assert formed and formed[0][0] == formed[0][1] < 100


def test_lines_that_meet_by_common_shingles_alone_go_no_further(spark, monkeypatch):
    """Lines with a short beginning in common share buckets by the hundred but are
    not alike by sketch: only pairs that are reach the tables behind the
    buckets, their texts are read once, and big tables are gone at the end."""
    rng = np.random.default_rng(8)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    start = "".join(rng.choice(letters, 34))
    lines = [start + "".join(rng.choice(letters, 66)) for _ in range(150)]      # 30 shingles of 162
    near = [x[:-4] + "".join(rng.choice(letters, 4)) for x in lines[:10]]       # 92 of 100
    rows = [(i, x, *ROWS[0][2:]) for i, x in enumerate(lines + near)]
    kept, read = defaultdict(list), []
    keep, texts = line_dedup.stored, line_dedup.line_texts

    def counted(df, name):
        out = keep(df, name)
        kept[name].append((out.count(), out.inputFiles()))
        return out

    def noted(*args):
        read.append(1)
        return texts(*args)
    monkeypatch.setattr(line_dedup, "stored", counted)
    monkeypatch.setattr(line_dedup, "line_texts", noted)
    got = line_dedup.line_dedup(docs(spark, rows)).collect()
    assert sorted([(r["doc_id"], r["text"], r["n_lines"], r["n_kept"]) for r in got], key=repr) == line_reference(rows)
    assert sum(r["n_kept"] for r in got) == 150
    # 20 entries in at most 12 buckets each
    assert max(n for n, _ in kept["members"]) <= 240 and len(read) == 1
    for name in ("lines", "buckets", "members", "marked", "held"):
        assert not any(os.path.exists(f.removeprefix("file:")) for _, files in kept[name] for f in files), name


def test_lines_are_walked_only_where_they_have_blanks_around(spark):
    """A line is trimmed where blanks stand around it, and its plain form is what is looked at."""
    raw = ["a line", " a line", "a line\t", "\r \ta line \r", "a  line", "", " ", "\t\r ", "\u00a0a line", "ä ö "]
    rows = line_dedup.line_rows(docs(spark, [(1, "\n".join(raw), *ROWS[0][2:])]))
    got = {r["pos"]: r["line"] for r in rows.select("pos", "line").collect()}
    assert got == {p: x.strip(" \t\r") for p, x in enumerate(raw) if x.strip(" \t\r")}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("trim(") == plan.count("THEN trim(") > 0      # 2 and 0 before: every line, twice


def test_shingle_sets_are_counted_outside_of_lambdas(spark, monkeypatch):
    """Exact similarity of pairs of lines, the sets counted once each and in generated code."""
    plans, keep = [], line_dedup.stored

    def noted(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df, name)
    monkeypatch.setattr(line_dedup, "stored", noted)
    texts = ["abcdefghijklmnop", "abcdefghijklmnopq", "abcdefgh", "abc", "abc", "abd", "aaaaaaaaaa", "aaaaa", "x\U0001f600yzuvw"]
    lines = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    pairs = spark.createDataFrame([(i, j) for i in range(len(texts)) for j in range(i)], "a long, b long")
    sets = [{x[i:i + 5] for i in range(max(1, len(x) - 4))} for x in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    got = line_dedup.verified(lines, pairs)
    assert {(r["a"], r["b"]) for r in got.collect()} == want == {(1, 0), (4, 3), (7, 6)}
    plan = plans[0]
    assert plan.count("array_intersect(") == 1 and plan.count("array_distinct(") == 2 and "exists(" not in plan


def test_lines_in_other_case_are_copies(spark):
    text = "Terms And Conditions Apply\nÜber Uns"
    rows = [(1, text, *ROWS[0][2:]), (2, text.upper() + "\nx", *ROWS[0][2:]), (3, text.lower(), *ROWS[0][2:])]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs(spark, rows)).collect()}
    assert got == {1: text, 2: "x", 3: ""}


def test_lines_at_the_threshold_meet(spark):
    """Pairs of lines with a similarity just above 0.8 share a band and pass the sketch."""
    rng = np.random.default_rng(11)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    pairs = []
    for _ in range(1200):
        x = "".join(rng.choice(letters, 85))
        pairs.append((x, x[:76] + "".join(rng.choice(letters, 9))))     # 72 shingles of 90
    rows = [(2 * i + k, x, *ROWS[0][2:]) for i, p in enumerate(pairs) for k, x in enumerate(p)]
    found = line_dedup.entries(docs(spark, rows))
    other = found.withColumnsRenamed({c: "o_" + c for c in found.columns})
    both = found.join(other, F.expr("first % 2 = 0 and o_first = first + 1"))
    share = F.expr(" or ".join(f"b{c} = o_b{c}" for c in range(sum(c[0] == "b" for c in found.columns))))
    assert both.count() == 1200
    # a miss of one pair in 1,000 leaves out about one of these, six bands of four about 50
    assert both.where(share).count() >= 1194
    kept = sum(r["n_kept"] for r in line_dedup.line_dedup(docs(spark, rows)).select("n_kept").collect())
    assert kept <= 1206


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", "the", "THE", "\x0b", "\n", " ", "x" * 70]), max_size=40))
def test_fingerprint(parts):
    text = " ".join(parts)
    assert simhash.fingerprint(text.encode(), step=7) == plain_fingerprint(text)


def test_simhash_groups(spark):
    got = simhash.simhash_groups(docs(spark)).collect()
    fps = [plain_fingerprint(r[1]) for r in ROWS]
    part = union_find(len(ROWS), [(i, j) for i in range(len(ROWS)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {c: min((ROWS[i][0] for i in range(len(ROWS)) if part[i] == c and ROWS[i][0] is not None), default=None) for c in part}
    want = sorted([(r[0], fp, least[c]) for r, fp, c in zip(ROWS, fps, part)], key=repr)
    assert sorted([(r["doc_id"], r["fp"] % 2 ** 64, r["component_id"]) for r in got], key=repr) == want
    assert simhash.simhash_groups(docs(spark, [])).count() == 0


def test_search_finds_every_link(spark):
    """Fingerprints at chosen distances, clustered so that some bits correlate."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2 ** 64, 12, dtype=np.uint64)
    fps = {int(c) for c in centres}
    for c in centres.tolist():
        for d in (1, 2, 3, 4, 4, 5, 6, 8):
            fps.add(c ^ sum(1 << int(b) for b in rng.choice(64, d, replace=False)))
    fps = sorted(fps)
    signed = [(f - 2 ** 64 if f >= 2 ** 63 else f,) for f in fps]
    frame = spark.createDataFrame(signed, "fp long").withColumn("part", F.col("fp"))
    plan = simhash.plan_search(frame, 4)
    assert sum(t for _, t in plan) >= 4 - 5 + 1 and sum(t + 1 for _, t in plan) == 5
    found = simhash.search_links(frame, plan, 4).collect()
    got = {tuple(sorted((r[0] % 2 ** 64, r[1] % 2 ** 64))) for r in found}
    assert got == {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4}


def test_keep_one(spark):
    kept = simhash.keep_one(docs(spark))
    assert kept.columns == SCHEMA_NAMES
    groups = {r["part"]: r["component_id"] for r in simhash.simhash_groups(docs(spark)).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(groups.values())
