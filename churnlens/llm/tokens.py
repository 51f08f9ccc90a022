"""Batch encoding with the tokenizers library, one call per distinct word.

A text is cut where the tokenizer's own rules can never join two characters: before a
non-space that follows ASCII white space, and between an ASCII letter and ASCII
punctuation.  The ids of a text are then the ids of its pieces in order, so each
distinct piece is encoded once per worker and looked up afterwards.  A text that holds
``<|`` (it may spell a special token) is encoded whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from churnlens.llm.common import IS_SPACE, WORKER_CACHES, byte_view, expand

END_ID = 1
#: Distinct pieces that a worker remembers before it starts anew.
REMEMBERED = 600_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PUNCT = {*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)}
#: A piece begins at a byte whose second flags share a bit with the first flags of the byte before it.
_BEFORE = bytes(1 if IS_SPACE[b] else 2 if 97 <= b <= 122 else 0 for b in range(256))
_AT = bytes((0 if IS_SPACE[b] else 1) | (2 if b in _PUNCT else 0) for b in range(256))
_ASCII_LOWER = bytes(range(97, 123))
#: Words that normalising leaves as they are and that pre-tokenising keeps whole.
_PLAIN = re.compile("[a-zà-öø-ÿ]+")


class WordEncoder:
    """Encodes batches of texts; ids equal those of ``Tokenizer.encode`` without special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), byte_level])
        from tokenizers import normalizers

        self.plain.normalizer = normalizers.Sequence([])
        vocab = self.whole.get_vocab()
        self.dtype = np.uint16 if max(vocab.values()) < 1 << 16 else np.uint32
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        # piece 0 is the end id that closes each document
        self.known: dict[bytes, int] = {}
        self.flat = np.full(1 << 16, END_ID, self.dtype)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int32)
        self.length[0] = 1
        self.used, self.count = 1, 1

    def _add(self, pieces: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, total = len(pieces), len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + n > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.flat[self.used : self.used + total] = ids
        self.start[self.count : self.count + n] = self.used + np.cumsum(lengths) - lengths
        self.length[self.count : self.count + n] = lengths
        self.known.update(zip(pieces, range(self.count, self.count + n)))
        self.used += total
        self.count += n

    def _learn(self, pieces: list[bytes]) -> None:
        plain: list[bytes] = []
        odd: list[bytes] = []
        for p in pieces:
            (plain if not p.translate(None, _ASCII_LOWER) and p or _PLAIN.fullmatch(p.decode("utf-8", "replace")) else odd).append(p)
        groups = [plain[i : i + 250] for i in range(0, len(plain), 250)]
        for at in range(0, len(groups), 80):
            some = groups[at : at + 80]
            found = self.plain.encode_batch_fast([b" ".join(g).decode("utf-8") for g in some], add_special_tokens=False)
            for g, e in zip(some, found):
                ids = np.array(e.ids, dtype=self.dtype)
                last = np.flatnonzero(self.ends[ids])
                if len(last) == len(g) and last[-1] == len(ids) - 1:
                    self._add(g, ids, np.diff(last, prepend=-1))
                else:
                    odd.extend(g)
        for at in range(0, len(odd), 5_000):
            some = odd[at : at + 5_000]
            found = [e.ids for e in self.whole.encode_batch_fast([p.decode("utf-8", "replace") for p in some], add_special_tokens=False)]
            ids = np.array([i for x in found for i in x], dtype=self.dtype)
            self._add(some, ids, np.array([len(x) for x in found]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): document i has ids[offsets[i]:offsets[i + 1]], the end id last; null is empty text."""
        data, offs = byte_view(texts)
        n = len(offs) - 1
        if not n:
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        raw = data.tobytes()
        special = [i for i in range(n) if b"<|" in raw[offs[i] : offs[i + 1]]] if b"<|" in raw else []
        low = raw.translate(_LOWER)
        codes_of_docs = np.zeros(0, np.int64)
        begins = np.zeros(len(low), np.uint8)
        if low:
            np.bitwise_and(np.frombuffer(low.translate(_BEFORE), np.uint8)[:-1], np.frombuffer(low.translate(_AT), np.uint8)[1:], out=begins[1:])
            begins[offs[:-1][offs[:-1] < len(low)]] = 1
        at = np.flatnonzero(begins)
        if len(at):
            bounds = np.append(at, len(low)).astype(np.int32)
            pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(low)])
            coded = pieces.dictionary_encode()
            distinct = [p.rstrip(b" \t\n\v\f\r") for p in coded.dictionary.to_numpy(zero_copy_only=False)]
            if self.count + len(distinct) > REMEMBERED:
                self.forget()
            self._learn(list(set(distinct).difference(self.known)))
            lookup = np.fromiter(map(self.known.__getitem__, distinct), np.int32, len(distinct))
            codes_of_docs = lookup[coded.indices.to_numpy(zero_copy_only=False)]
            del pieces, coded, distinct, begins
        ends = np.searchsorted(at, offs[1:], side="left")
        codes = np.insert(codes_of_docs, ends, 0)
        ends = ends + np.arange(1, n + 1)
        lengths = self.length[codes]
        some = 1 << 19
        ids = np.concatenate([self.flat[expand(self.start[codes[i : i + some]], lengths[i : i + some])] for i in range(0, len(codes), some)])
        offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)[ends - 1]])
        if special:
            parts = [ids[offsets[i] : offsets[i + 1]] for i in range(n)]
            for i in special:
                whole = self.whole.encode(raw[offs[i] : offs[i + 1]].decode("utf-8", "replace"), add_special_tokens=False).ids
                parts[i] = np.array([*whole, END_ID], dtype=self.dtype)
            ids, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, offsets


_ENCODERS: dict[str, WordEncoder] = {}
WORKER_CACHES.append(_ENCODERS)


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for this vocabulary file, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
