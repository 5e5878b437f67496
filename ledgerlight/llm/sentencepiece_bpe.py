"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The library normalises a text; the text is then cut into words at every place
no piece of the vocabulary spans, and each distinct unseen word of a batch is
encoded in one set of flat numpy arrays: a symbol per character, the rank of
every adjacent pair, the minimum rank of each word, and all leftmost merges of
a round at once. Words without a pair left leave the arrays.

The order of merges is the library's: best score first, leftmost among equal
scores. Several occurrences of a word's best pair are merged in one round only
where no pair with the new piece could come before them.

Defined cases. Null text counts as empty: no ids, empty decoded text. Words of
any length are encoded whole; only short ones are remembered, in a table that
is emptied when full. Repeated doc_ids are separate rows. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import text_or_empty
from ledgerlight.llm.tokens import Both

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
_NONE = np.int64(1) << 60
_LONG = 64
_WORDS = re.compile(f"\n[^{SPACE}\n]*|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
_LOADED: dict[str, "PieceBpe"] = {}


def model_path(name: str = MODEL) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class PieceBpe:
    def __init__(self, path: str, max_words: int = 500_000):
        import sentencepiece
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.max_words, self.seen = max_words, {}
        n = sp.get_piece_size()
        pieces = {sp.id_to_piece(i): i for i in range(n)
                  if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        self.size = n
        self.bytes_of = [sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        self.byte_id = np.zeros(256, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
            elif sp.is_control(i):
                self.bytes_of[i] = b""
        self.char_id = np.full(0x110000, -1, np.int64)
        for p, i in pieces.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        # a piece can only grow from characters that are pieces themselves
        if any(self.char_id[ord(c)] < 0 for p in pieces for c in p):
            raise ValueError("a piece holds a character that is no piece")
        self._pairs(pieces)
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces) or sp.normalize("a") != SPACE + "a":
            raise ValueError("the words of this model cannot be told apart")

    def _pairs(self, pieces: dict[str, int]) -> None:
        """The sorted table of joinable pairs: key, rank (by score, equal
        scores equal ranks) and piece; and which ranks allow all occurrences
        of a pair to be merged at once."""
        score = {p: self.sp.get_score(i) for p, i in pieces.items()}
        rank_of = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        left, right, made, rank = [], [], [], []
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = pieces.get(p[:k]), pieces.get(p[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(i)
                    rank.append(rank_of[score[p]])
        left, right, made, rank = (np.array(x, np.int64) for x in (left, right, made, rank))
        key = left * self.size + right
        order = np.argsort(key)
        self.keys, self.ranks, self.made = key[order], rank[order], made[order]
        # best rank any pair with a given piece has
        soonest = np.full(self.size, _NONE)
        np.minimum.at(soonest, left, rank)
        np.minimum.at(soonest, right, rank)
        self.all_at_once = np.ones(len(rank_of), bool)
        self.all_at_once[rank[soonest[made] <= rank]] = False
        pieces_per_rank = np.zeros(len(rank_of), np.int64)
        owners = np.unique(np.stack([rank, made]), axis=1)
        np.add.at(pieces_per_rank, owners[0], 1)
        self.all_at_once[pieces_per_rank > 1] = False

    def _rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of the pairs (a, b); rank _NONE where they don't join."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(ok, self.ranks[at], _NONE), np.where(ok, self.made[at], -1)

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """ids of each word (non-empty strings)."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        lens = np.array([len(w) for w in words])
        # unknown characters are kept as -1 - code point: they join nothing
        sym = self.char_id[chars]
        sym = np.where(sym < 0, -1 - chars, sym)
        word = np.repeat(np.arange(len(words)), lens)
        rank, made = np.full(len(sym), _NONE), np.full(len(sym), -1)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside], made[inside] = self._rank(sym[inside], sym[inside + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.append(starts, len(sym)))
            ended = np.repeat(least == _NONE, counts)
            if ended.any():
                done.append((word[ended], sym[ended]))
                live = ~ended
                sym, word, rank, made = sym[live], word[live], rank[live], made[live]
                if not len(sym):
                    break
                keep = least != _NONE
                least, counts = least[keep], counts[keep]
                starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
            best = rank == np.repeat(least, counts)
            hits = np.flatnonzero(best)
            # overlapping hits: every second one of a run, from the left
            first = np.concatenate(([True], np.diff(hits) != 1))
            run = np.maximum.accumulate(np.where(first, np.arange(len(hits)), 0))
            chosen = (np.arange(len(hits)) - run) % 2 == 0
            # where a new piece might come first, only the word's leftmost hit
            leftmost = np.concatenate(([True], word[hits][1:] != word[hits][:-1]))
            chosen &= self.all_at_once[rank[hits]] | leftmost
            hits = hits[chosen]
            sym[hits] = made[hits]
            stay = np.ones(len(sym), bool)
            stay[hits + 1] = False
            sym, word, rank, made = sym[stay], word[stay], rank[stay], made[stay]
            at = hits - np.arange(len(hits))       # places of the new symbols
            near = np.concatenate((at - 1, at))    # a place that comes twice is looked up twice
            near = near[near >= 0]
            rank[near], made[near] = _NONE, -1
            near = near[near < len(sym) - 1]
            near = near[word[near] == word[near + 1]]
            rank[near], made[near] = self._rank(sym[near], sym[near + 1])
        word = np.concatenate([w for w, _ in done])
        sym = np.concatenate([s for _, s in done])
        sym = sym[np.argsort(word, kind="stable")]
        cuts = np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(words)))))
        found = [sym[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        for k in np.unique(np.searchsorted(cuts, np.flatnonzero(sym < 0), "right") - 1).tolist():
            found[k] = self._bytes_for_unknown(found[k])
        return found

    def _bytes_for_unknown(self, ids: np.ndarray) -> np.ndarray:
        out: list[int] = []
        for i in ids.tolist():
            out.extend([i] if i >= 0 else self.byte_id[list(chr(-1 - i).encode())].tolist())
        return np.array(out, np.int64)

    def cut(self, text: str) -> list[str]:
        """Keys of a text's words: the word without its one leading ``SPACE``;
        words that start with a newline or several ``SPACE`` as they are."""
        return self.cut_normalized(self.sp.normalize(text))

    @staticmethod
    def cut_normalized(text: str) -> list[str]:
        keys = text.replace("\n", SPACE + "\n").split(SPACE)[1:]
        if "" in keys or f"{SPACE}\n" in text:
            keys = [w if w[0] == "\n" or w[1:2] in ("", SPACE) else w[1:] for w in _WORDS.findall(text)]
        return keys

    @staticmethod
    def word(key: str) -> str:
        return key if key[0] == "\n" or SPACE in key else SPACE + key

    def encode(self, text: str) -> list[int]:
        words = [self.word(k) for k in self.cut(text)]
        return np.concatenate(self.merge(words)).tolist() if words else []

    def decode_bytes(self, ids) -> bytes:
        """Bytes of the pieces, ``SPACE`` as a space, the first one included."""
        return b"".join([self.bytes_of[i] for i in ids])

    def decode(self, ids) -> str:
        raw = self.decode_bytes(ids)
        return raw.removeprefix(b" ").decode("utf-8", "replace")

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, SHA-256 of the ids joined by commas, SHA-256 of the
        text decoded from them) of each text."""
        cut = [self.cut(t) for t in texts]
        if len(self.seen) > self.max_words:
            self.seen.clear()
        unseen = list(set().union(*cut).difference(self.seen))
        known = self.seen
        if unseen:
            new = {k: (",".join(map(str, ids)).encode(), len(ids), self.decode_bytes(ids))
                   for k, ids in zip(unseen, (x.tolist() for x in self.merge([self.word(k) for k in unseen])))}
            longer = {k: v for k, v in new.items() if len(k) > _LONG}
            self.seen.update((k, v) for k, v in new.items() if len(k) <= _LONG)
            if longer:
                known = Both(self.seen, longer)
        out = []
        for keys in cut:
            if not keys:
                out.append((0, _SHA_EMPTY, _SHA_EMPTY))
                continue
            csv, n, raw = zip(*[known[k] for k in keys])
            out.append((sum(n), hashlib.sha256(b",".join(csv)).hexdigest(),
                        hashlib.sha256(b"".join(raw).removeprefix(b" ")).hexdigest()))
        return out


_SHA_EMPTY = hashlib.sha256(b"").hexdigest()


def processor(path: str) -> PieceBpe:
    """The worker's encoder for one model file."""
    if path not in _LOADED:
        _LOADED[path] = PieceBpe(path)
    return _LOADED[path]


def _digest_batches(path: str | None, step_chars: int = 1 << 21):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = processor(path or model_path())
        for b in batches:
            ids, texts, lo = b.column(0), b.column(1), 0
            while lo < len(ids):
                hi, room, part = lo, step_chars, []
                while hi < len(ids) and (room > 0 or hi == lo):
                    part.append(texts[hi].as_py())
                    room -= len(part[-1])
                    hi += 1
                n, enc, dec = zip(*bpe.digests(part))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(enc), pa.array(dec)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                lo = hi
    return run


def sentencepiece_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(
        _digest_batches(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every whole text of ``documents`` encoded and decoded again."""
    return sentencepiece_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
