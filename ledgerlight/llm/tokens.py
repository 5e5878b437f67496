"""Exact tokenizing of whole texts with a public tokenizer, a batch at a time.

Words repeat, and the two tokenizers here never let a token cross from
non-space to a following space or newline. So a text is cut there, each
distinct piece of a batch is encoded once (all unseen pieces together in one
call of the library), and the ids of a text are its pieces' ids in order. The
memory of a worker stays bounded: the piece table is emptied when full, and
long pieces are encoded without being remembered.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

END_ID = 2
WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
# byte level: a piece is a run of spaces and newlines with what follows it
_RUNS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
# white space other than space and newline: such texts are encoded whole
_OTHER_SPACE = [chr(c) for c in range(0x110000) if chr(c).isspace() and chr(c) not in " \n"]
_MARK = "\x01"
_TAIL = ".,;:!?#*$%&"
# letters in every version of Unicode: such a word is one piece of the byte-level vocabulary
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")
_LONG = 64
_LOADED: dict[str, "Encoder"] = {}


class Encoder:
    """ids of whole texts as little-endian unsigned 32-bit bytes.

    Pieces are known by a key: for the word vocabulary the word itself; for
    the byte-level one the word without its single leading space, or the piece
    as it is where it starts with other white space, or "\\r" and the word at
    the start of a text."""

    def __init__(self, name: str, path: str | None = None, max_pieces: int = 1_200_000):
        from tokenizers import Tokenizer
        self.name, self.max_pieces = name, max_pieces
        self.tokenizer = Tokenizer.from_file(path or tokenizer_path(name))
        self.cut = {WORD: self._cut_words, BYTE: self._cut_bytes}[name]
        self.seen: dict[str, bytes] = {}
        self.tail_ids: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.widths = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        if name == BYTE:
            from tokenizers.pre_tokenizers import ByteLevel
            # in this vocabulary every character of a token stands for one byte
            self.byte_level = {ord(c): ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0]
                               for c in (" ", *map(chr, range(65, 91)), *map(chr, range(97, 123)), *map(chr, range(0xc0, 0x250)))}
            for token, i in vocab.items():
                self.widths[i] = len(token)
        else:
            self.mark = self._whole(_MARK)[0]

    def _cut_words(self, text: str) -> list[str]:
        # the vocabulary lower-cases; doing so first makes fewer distinct words
        return (text.lower() if text.isascii() else text).replace("\n", " ").split(" ")

    def _cut_bytes(self, text: str) -> list[str]:
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[-1:] in ("", " ", "\n") or text[0] in " \n":
            runs = _RUNS.findall(text)
            keys = [r[1:] if r[0] == " " and r[1:2].strip(" \n") else r for r in runs]
            if runs and runs[0][0] not in " \n":
                keys[0] = "\r" + runs[0]
            return keys
        keys = text.replace("\n", " \n").split(" ")
        keys[0] = "\r" + keys[0]
        return keys

    def _piece(self, key: str) -> str:
        if self.name == WORD or key[0] in " \n":
            return key
        return key[1:] if key[0] == "\r" else " " + key

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _bytes(self, text: str) -> bytes:
        return np.asarray(self._whole(text), dtype="<u4").tobytes()

    def _many(self, pieces: list[str]) -> list[bytes]:
        """ids of each piece, from one call over all of them."""
        joiner = "" if self.name == BYTE else f" {_MARK} "
        ids = np.asarray(self.tokenizer.encode_batch_fast(
            [joiner.join(pieces)], add_special_tokens=False)[0].ids, dtype="<u4")
        if self.name == BYTE:
            ends = np.cumsum(np.fromiter(map(len, map(str.encode, pieces)), np.int64, len(pieces)))
            cuts = np.searchsorted(np.cumsum(self.widths[ids]), ends, side="left") + 1
            starts = np.concatenate(([0], cuts[:-1]))
        else:
            marks = np.flatnonzero(ids == self.mark)
            starts = np.concatenate(([0], marks + 1))
            cuts = np.concatenate((marks, [len(ids)]))
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip((4 * starts).tolist(), (4 * cuts).tolist())]

    def _words(self, pieces: list[str]) -> list[bytes]:
        """ids of each piece, a space and letters, from the model itself."""
        tokenize, table = self.tokenizer.model.tokenize, self.byte_level
        found = [[t.id for t in tokenize(p.translate(table))] for p in pieces]
        raw = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
        ends = np.cumsum([4 * len(f) for f in found])
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _learn(self, unseen: set[str]) -> dict[str, bytes]:
        """Remember the unseen pieces; returns the long ones, which are not kept."""
        seen = self.seen
        # letters and the punctuation after them are always separate tokens
        tails = {k: k.rstrip(_TAIL) for k in unseen if k[-1] in _TAIL}
        tails = {k: base for k, base in tails.items() if base[-1:].isalpha()}
        wanted = unseen.difference(tails).union(tails.values()).difference(seen)
        for mark in {k[len(base):] for k, base in tails.items()}.difference(self.tail_ids):
            self.tail_ids[mark] = self._bytes(mark)
        pieces = {k: self._piece(k) for k in wanted}
        # joined byte-level pieces must each start with white space and end with none
        plain = [k for k, p in pieces.items() if len(p) <= _LONG and (
            self.name == WORD or (p[0] in " \n" and p[-1] not in " \n"))]
        if self.name == BYTE:
            # a word of letters is one word of the model, which needs no cutting
            letters = [k for k in plain if pieces[k][0] == " " and _LETTERS.fullmatch(k)]
            seen.update(zip(letters, self._words([pieces[k] for k in letters])))
            plain = set(plain).difference(letters)
            wanted.difference_update(letters)
        if plain:
            seen.update(zip(plain, self._many([pieces[k] for k in plain])))
        longer = {}
        for k in wanted.difference(plain):
            (longer if len(pieces[k]) > _LONG else seen)[k] = self._bytes(pieces[k])
        for k, base in tails.items():
            (longer if base in longer else seen)[k] = (longer.get(base) or seen[base]) + self.tail_ids[k[len(base):]]
        return longer

    def encode(self, texts: list[str]) -> list[bytes]:
        """One bytes object per text, without special or end ids."""
        if len(self.seen) > self.max_pieces:
            self.seen.clear()
        everything = "\n".join(texts)
        odd = [c for c in (*_OTHER_SPACE, _MARK, "<|") if c in everything]
        cut = [None if odd and any(c in t for c in odd) else self.cut(t) for t in texts]
        self.seen[""] = b""

        def ids_of(keys: list[str]) -> list[bytes]:
            found = list(map(self.seen.get, keys))
            unseen = [k for k, raw in enumerate(found) if raw is None]
            longer = self._learn({keys[k] for k in unseen})
            for k in unseen:
                found[k] = longer[keys[k]] if keys[k] in longer else self.seen[keys[k]]
            return found

        raw = joined_ids([keys or [] for keys in cut], ids_of)
        return [self._bytes(t) if keys is None else r for t, keys, r in zip(texts, cut, raw)]


def joined_ids(cut: list[list[str]], ids_of: Callable[[list[str]], list[bytes]]) -> list[bytes]:
    """id bytes of each list of keys. ``ids_of`` is asked once for the distinct
    keys of all lists; their ids are then put together in flat arrays."""
    words = pa.array(list(chain.from_iterable(cut)), pa.string()).dictionary_encode()
    codes, found = words.indices.to_numpy(), ids_of(words.dictionary.to_numpy(zero_copy_only=False).tolist())
    sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
    first, width = (np.cumsum(sizes) - sizes)[codes], sizes[codes]
    ends = np.cumsum(width)
    place = np.repeat(first - (ends - width), width)
    place += np.arange(len(place))
    raw = np.frombuffer(b"".join(found), "<u4")[place].tobytes()
    bounds = 4 * np.concatenate(([0], ends))[np.cumsum([0, *map(len, cut)])]
    return [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


class Both(dict):
    """The remembered pieces, with the long pieces of one batch beside them."""

    def __init__(self, seen: dict, longer: dict):
        super().__init__(longer)
        self.seen = seen

    def __missing__(self, key: str):
        return self.seen[key]


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary file lies (on every executor)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def encoder(name: str, path: str | None = None) -> Encoder:
    """The worker's encoder for one vocabulary file."""
    key = path or name
    if key not in _LOADED:
        _LOADED[key] = Encoder(name, path)
    return _LOADED[key]


def encoded_documents(batches: Iterator[pa.RecordBatch], name: str, path: str | None = None,
                      step_chars: int = 1 << 21) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, id bytes with the end id) for batches of (doc_id, text).

    Texts are taken in steps of about ``step_chars`` characters, so memory
    does not follow the batch size."""
    enc, end = encoder(name, path), np.asarray([END_ID], dtype="<u4").tobytes()
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        lo = 0
        while lo < len(ids):
            hi, room, part = lo, step_chars, []
            while hi < len(ids) and (room > 0 or hi == lo):
                part.append(texts[hi].as_py() or "")
                room -= len(part[-1])
                hi += 1
            for doc, raw in zip(ids[lo:hi], enc.encode(part)):
                yield doc, raw + end
            lo = hi


def crc(raw: bytes) -> int:
    return zlib.crc32(raw)
