"""Tokenizing, packing, shards and SentencePiece against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlight.llm import packing, sentencepiece_bpe, token_shards, tokens

TEXT = st.lists(st.sampled_from(["a", "b", " ", "  ", "\n", "\n\n", "'s", "don't", "1", "23", "!", "?!", "é", "漢", "\t", "\xa0", "\r", "\x1c",
                                 "😀", "Ab", "<|endoftext|>", "\x01", "ΟΔΟΣ", "é", "x" * 80, "▁", "\x00", "hello", "in"]),
                max_size=25).map("".join)
ROWS = [(1, "Some plain text, and more."), (2, None), (3, ""), (3, ""), (None, "no id here"), (5, "word " * 9000),
        (4, "two\nlines  and \t tabs"), (7, "x" * 20000)]
SCHEMA = "doc_id long, text string, start string, window string, copy string, h int"


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "s", "w", "c", 1) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("name", [tokens.WORD, tokens.BYTE])
def test_encoder_is_the_library(name):
    whole = Tokenizer.from_file(tokens.tokenizer_path(name))
    enc = tokens.Encoder(name, max_pieces=40)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(TEXT, min_size=1, max_size=5))
    def check(texts):
        want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert enc.encode(texts) == want
    check()


def ids_of(name, text):
    whole = Tokenizer.from_file(tokens.tokenizer_path(name))
    return np.array(whole.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def check_pieces(pieces, rows):
    """Every id of every document in one piece, sequences gapless and not too long."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault((p["doc_id"], p["copy"], p["doc_tokens"]), []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    texts = {}
    for doc, text in rows:
        texts.setdefault(doc, []).append(ids_of(tokens.WORD, text))
    for (doc, _, n), found in by_doc.items():
        whole = next(t for t in texts[doc] if len(t) == n)
        at = 0
        for p in sorted(found, key=lambda p: p["start"]):
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(whole[at:at + p["length"]].tobytes())
            at += p["length"]
        assert at == n
    for found in by_seq.values():
        at = 0
        for p in sorted(found, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096
    assert sum(p["length"] for p in pieces) == sum(len(t) for ts in texts.values() for t in ts)


def test_packing(spark):
    check_pieces(packing.pack(docs(spark)).collect(), ROWS)
    assert packing.pack(docs(spark, [])).count() == 0


def test_packing_merges_leftovers_in_rounds(spark):
    random.seed(4)
    rows = [(i, "word " * random.randrange(700)) for i in range(300)]
    frame = spark.createDataFrame([(*r, "s", "w", "c", 1) for r in rows], SCHEMA).repartition(9)
    got = packing.pack(frame, open_windows=4, fan_in=2).collect()
    check_pieces(got, rows)
    used = sum(p["length"] for p in got)
    assert used > 0.9 * 4096 * len({p["sequence_id"] for p in got})


def test_packer_cuts_only_to_fill():
    packer, done = packing.Packer(10, 2), []
    for n in (4, 7, 5, 25, 3):
        done += packer.add(n, lambda a, b, n=n: (n, a, b))
    lens = [sum(b - a for _, a, b in w) for w in done]
    assert lens and all(x == 10 for x in lens)


def test_shards(spark):
    path = token_shards.scratch_path(spark, "test-shards")
    token_shards.write_shards(docs(spark), path, shard_ids=3000)
    got = token_shards.read_shards(spark, path).orderBy("start").collect()
    want, at = [], 0
    key = lambda r: (r[0] is not None, r[0] or 0)
    for doc, text in sorted(ROWS, key=key):
        ids = ids_of(tokens.BYTE, text)
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    path = token_shards.scratch_path(spark, "test-empty")
    token_shards.write_shards(docs(spark, []), path)
    assert token_shards.read_shards(spark, path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), min_size=1, max_size=60), min_size=1, max_size=12), st.integers(0, 4))
def test_grammar_round_trip(documents, rounds):
    ids = np.array([i for d in documents for i in d], "<u4")
    sizes = np.array([len(d) for d in documents])
    shard = token_shards.Shard(token_shards.compress(ids, sizes, rounds, 5, 2))
    assert (shard.expand(shard.symbols) == ids).all()
    for i, d in enumerate(documents):
        assert shard.document(i).tolist() == d
        assert shard.document(i, len(d) // 3, len(d) // 2 + 1).tolist() == d[len(d) // 3:len(d) // 2 + 1]
    known = np.concatenate([np.ones(shard.first, np.int64), shard.lengths])
    assert all(known[shard.first + k] == known[a] + known[b] for k, (a, b) in enumerate(shard.rules.tolist()))


def test_grammar_compresses():
    ids = np.tile(np.arange(50), 400).astype("<u4")
    assert len(token_shards.compress(ids, np.array([len(ids)]))) < len(ids)
    with pytest.raises(ValueError):
        token_shards.compress(np.array([70000], "<u4"), np.array([1]))


def test_grammar_goes_on_until_no_pair_is_frequent():
    """A document copied often shrinks to one symbol, whatever its length."""
    ids = np.tile(np.random.default_rng(4).permutation(300), 500).astype("<u4")
    shard = token_shards.Shard(token_shards.compress(ids, np.full(500, 300)))
    assert len(shard.symbols) == 500
    assert (shard.expand(shard.symbols) == ids).all()
    assert (shard.document(7, 20, 290) == ids[20:290]).all()


def test_piece_merges_are_the_library():
    bpe = sentencepiece_bpe.PieceBpe(sentencepiece_bpe.model_path(), max_words=50)
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.model_path())

    @settings(max_examples=300, deadline=None)
    @given(TEXT)
    def check(text):
        ids = sp.encode(text)
        assert bpe.encode(text) == ids and bpe.decode(ids) == sp.decode(ids)
        n, csv, raw = bpe.digests([text])[0]
        assert n == len(ids) and csv == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert raw == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    check()
    for text in ("a" * 3000, "hello" * 800, " " * 100, "     a      b" * 5):
        assert bpe.encode(text) == sp.encode(text)


def test_sentencepiece_query_shape(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.model_path())
    got = sentencepiece_bpe.sentencepiece_digests(docs(spark)).collect()
    want = [(d, len(sp.encode(t or "")), hashlib.sha256(",".join(map(str, sp.encode(t or ""))).encode()).hexdigest(),
             hashlib.sha256(sp.decode(sp.encode(t or "")).encode()).hexdigest()) for d, t in ROWS]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sentencepiece_bpe.sentencepiece_digests(docs(spark, [])).count() == 0


def test_copies_of_an_id_in_several_partitions_are_told_apart(spark):
    rows = spark.createDataFrame([(1, f"text {i} " * i) for i in range(12)], "doc_id long, text string").repartition(4)
    pieces = packing.pack(rows, size=64).collect()
    for copy in {p["copy"] for p in pieces}:
        mine = sorted((p["start"], p["length"], p["doc_tokens"]) for p in pieces if p["copy"] == copy)
        assert len({n for _, _, n in mine}) == 1
        at = 0
        for start, length, _ in mine:
            assert start == at
            at += length
        assert at == mine[0][2]
    assert len({p["copy"] for p in pieces}) == 12


def test_distinct_words_are_looked_up_once():
    asked = []

    def ids_of(keys):
        asked.extend(keys)
        return [np.arange(len(k), dtype="<u4").tobytes() for k in keys]
    got = tokens.joined_ids([["ab", "c", "ab"], [], ["c", "", "é漢x"]], ids_of)
    assert sorted(asked) == ["", "ab", "c", "é漢x"]
    assert [np.frombuffer(r, "<u4").tolist() for r in got] == [[0, 1, 0, 0, 1], [], [0, 0, 1, 2]]
    assert tokens.joined_ids([[], []], ids_of) == [b"", b""] and tokens.joined_ids([], ids_of) == []


def test_words_of_letters_and_marks_after_words():
    texts = [" Zürich façade*** naïve### Ǆ ÿ× ª word$$$ a%%% b&& x.*** ŉ ß", "Éa éA\nÀb %%%", "wordword " * 3 + "x" * 70 + "***"]
    for name in (tokens.WORD, tokens.BYTE):
        whole, enc = Tokenizer.from_file(tokens.tokenizer_path(name)), tokens.Encoder(name)
        assert enc.encode(texts) == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        # marks after letters are not part of the words remembered from the library
        assert {enc.seen["naïve###"], enc.seen["naïve"] + enc.tail_ids["###"]} == {enc.seen["naïve###"]}


@pytest.mark.parametrize("rounds", [None, 0, 1])
def test_shard_ids_by_table_are_the_expanded_symbols(rounds):
    random.seed(6)
    part = [random.randrange(300) for _ in range(40)]
    docs_ids = [part * random.randrange(1, 30) + [2] for _ in range(50)] + [[2]]
    ids = np.array([i for d in docs_ids for i in d], "<u4")
    shard = token_shards.Shard(token_shards.compress(ids, np.array([len(d) for d in docs_ids]), rounds))
    assert np.array_equal(shard.ids(), ids) and np.array_equal(shard.expand(shard.symbols), ids)
