"""Cross-tokenizer alignment against the two libraries and plain loops."""

import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerlight.llm import alignment
from ledgerlight.llm.sentencepiece_bpe import model_path
from ledgerlight.llm.tokens import BYTE, tokenizer_path

ODD = [None, "", " ", "  ", "\n", "a▁b", "<|endoftext|> x <s> </s>", "日本語のテキスト、漢字", "😀😀 emoji‍", "ﬁ ligature ½",
       "tab\there\r\nx", "a" * 5000, "é" * 100, " nbsp", "\x00nul", "x" * 300 + " " + "1234567890" * 50, "aaa", "aaa",
       "  lead", "trail  ", "Ａ", "é"]
PARTS = ["a", "b", " ", "  ", "\n", "é", "the", "ing", " the", "漢", "😀", "1", ".", "...", "\t", "<|endoftext|>", "　", "\r", '"', "'s", "Ab", "$$$"]


def byte_of_char():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def slow(texts):
    tok, sp = Tokenizer.from_file(tokenizer_path(BYTE)), sentencepiece.SentencePieceProcessor(model_file=model_path())
    tok.encode_special_tokens = True
    byte, docs = byte_of_char(), []
    for text in texts:
        docs.append(None)
        if not text:
            continue
        e = tok.encode(" " + text, add_special_tokens=False)
        a, b = e.ids, sp.encode(text)
        a_bytes = [bytes(byte[c] for c in t) for t in e.tokens]
        b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(sp.id_to_piece, b))]
        if {b"".join(a_bytes), b"".join(b_bytes)} != {(" " + text).encode()}:
            continue
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            i2, j2 = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
            groups.append((a[i:i2], b[j:j2]))
            i, j = i2, j2
        docs[-1] = (a, b, groups)
    count = collections.Counter()
    for d in filter(None, docs):
        count.update({(p, q) for ga, gb in d[2] for p in ga for q in gb})
    best = collections.defaultdict(int)
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(p, q) for ga, gb in d[2] for p in ga for q in gb]
        written = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in d[2])
        out.append((len(d[0]), len(d[1]), len(d[2]), len(links), sum(count[x] == best[x[0]] for x in links),
                    sum(count[x] for x in links), hashlib.sha256(written.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("step,chunk", [(1 << 21, 1 << 24), (2000, 9000)])
def test_against_brute_force(spark, step, chunk):
    random.seed(3)
    texts = ODD + ["".join(random.choices(PARTS, k=random.randint(0, 40))) for _ in range(300)]
    texts += [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(120).collect()]
    docs = spark.createDataFrame([(k, t, "c", 2) for k, t in enumerate(texts)], "doc_id long, text string, chunk string, n_a int")
    got = alignment.align(docs.repartition(3), step_chars=step, chunk_chars=chunk).collect()
    assert [tuple(r)[1:] for r in sorted(got)] == slow(texts)


def test_very_large_group_by_distinct_ids(monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 50)
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 60), rng.integers(0, 7, 80)
    a_cuts, b_cuts, owner = np.array([0, 3, 40, 60]), np.array([0, 2, 70, 80]), np.array([4, 4, 5])
    got = collections.Counter()
    for text, key, times in alignment.linked(a, a_cuts, b, b_cuts, owner, 7):
        for t, k, n in zip(text.tolist(), key.tolist(), times.tolist()):
            got[t, k] += n
    want = collections.Counter((int(owner[g]), int(x * 7 + y)) for g in range(3)
                               for x in a[a_cuts[g]:a_cuts[g + 1]] for y in b[b_cuts[g]:b_cuts[g + 1]])
    assert got == want


def test_gallop_is_a_lower_bound():
    rng = np.random.default_rng(2)
    for _ in range(200):
        texts = rng.integers(1, 6)
        a_ends, b_ends, a_bounds, b_bounds, base = [], [], [0], [0], 0
        for _ in range(texts):
            size = int(rng.integers(1, 400))
            for ends, bounds in ((a_ends, a_bounds), (b_ends, b_bounds)):
                inside = np.flatnonzero(rng.random(size - 1) < rng.random()) + 1
                ends += [*(base + inside).tolist(), base + size]
                bounds.append(len(ends))
            base += size
        a, b = np.array(a_ends), np.array(b_ends)
        in_a, in_b = alignment.common_ends(a, np.array(a_bounds), b, np.array(b_bounds))
        want = np.intersect1d(a, b)
        assert np.array_equal(a[in_a], want) and np.array_equal(b[in_b], want)


def test_copies_repeated_ids_and_empty_table(spark):
    text = "The same text, many times over."
    rows = [(1, text)] * 30 + [(None, text), (2, None), (2, "")]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), chunk_chars=40).collect()
    full = [r for r in got if r["n_a"]]
    assert len(got) == 33 and len({tuple(r)[1:] for r in full}) == 1 and len(full) == 31
    # every pair is held by all 31 copies, so every link is its id's best
    assert full[0]["n_best"] == full[0]["n_links"] and full[0]["count_sum"] == 31 * full[0]["n_links"]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty).collect() == []


def test_each_text_is_normalized_once_and_only_unknown_words_become_bytes():
    both = alignment.Aligner()
    calls = {"normalize": 0, "bytes": 0}
    sp, to_bytes = both.b.sp, both.b._bytes_for_unknown

    class Counted:
        def normalize(self, text):
            calls["normalize"] += 1
            return sp.normalize(text)

    def counted(ids):
        calls["bytes"] += 1
        return to_bytes(ids)
    both.b.sp, both.b._bytes_for_unknown = Counted(), counted
    texts = ["some plain words", "more plain words \U000F0000 here", "and more"]
    rows = both.align(texts)[0]
    assert calls == {"normalize": 3, "bytes": 1}
    assert [r[1] for r in rows] == [len(sp.encode(t)) for t in texts]
