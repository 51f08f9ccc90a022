"""Batch encoding with a byte-level vocabulary of the tokenizers library, one call per distinct piece.

The vocabulary's pattern splits a text into runs of letters, of digits, of other signs and of white
space.  Such a run always ends before white space that follows something else, and before ASCII
punctuation that follows an ASCII letter, so a text may be cut there: the ids of a text are those of
its pieces in order.  Each distinct piece is encoded once per worker and looked up afterwards.  A
text that holds ``<|`` (it may spell a special token) is encoded whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from churnlens.llm.common import IS_SPACE, WORKER_CACHES, byte_view, expand

#: Distinct pieces that a worker remembers before it starts anew.
REMEMBERED = 600_000
#: Bytes of text looked at together; longer texts are taken in slices.
SLICE_BYTES = 4 << 20

_PUNCT = {*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)}
_LETTER = {*range(0x41, 0x5B), *range(0x61, 0x7B)}
#: A piece begins at a byte whose flag in _AT is also set in _BEFORE for the byte before it.
_BEFORE = np.array([(0 if IS_SPACE[b] else 1) | (2 if b in _LETTER else 0) for b in range(256)], np.uint8)
_AT = np.array([(1 if IS_SPACE[b] else 0) | (2 if b in _PUNCT else 0) for b in range(256)], np.uint8)
#: White space beyond ASCII: its last byte, and the byte before that one.
_WIDE_LAST = np.zeros(256, bool)
_WIDE_LAST[[0x85, *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_WIDE_BEFORE = np.zeros(256, bool)
_WIDE_BEFORE[[0xC2, 0x80, 0x81, 0x9A]] = True
#: Pieces that may be encoded many at once: a space, then letters.
_PLAIN = re.compile(" [A-Za-zÀ-ÖØ-öø-ÿ]+")


def cuts(data: np.ndarray) -> np.ndarray:
    """The places (but the first) where these bytes may be cut into pieces."""
    at = np.flatnonzero(_BEFORE[data[:-1]] & _AT[data[1:]]) + 1
    last = data[at - 1]
    wide = _WIDE_LAST[last] & IS_SPACE[data[at]]
    if wide.any():
        wide &= _WIDE_BEFORE[data[np.maximum(at - 2, 0)]]
        at = at[~wide]
    return at


class PieceEncoder:
    """Encodes batches of texts; ids equal those of ``Tokenizer.encode`` without special tokens."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.end_id = end_id
        vocab = self.whole.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for token, i in vocab.items() if token.startswith("Ġ")]] = True  # how the vocabulary spells a space
        self.forget()

    def forget(self) -> None:
        # piece 0 is the end id that closes each document
        self.known: dict[bytes, int] = {}
        self.flat = np.full(1 << 16, self.end_id, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.length[0] = 1
        self.used, self.count = 1, 1

    def _add(self, pieces: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(pieces) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[self.count : self.count + len(pieces)] = self.used + np.cumsum(lengths) - lengths
        self.length[self.count : self.count + len(pieces)] = lengths
        self.known.update(zip(pieces, range(self.count, self.count + len(pieces))))
        self.used += len(ids)
        self.count += len(pieces)

    def _learn(self, pieces: list[bytes]) -> None:
        texts = [p.decode("utf-8", "replace") for p in pieces]
        plain = [i for i, t in enumerate(texts) if _PLAIN.fullmatch(t)]
        odd = np.ones(len(texts), bool)
        odd[plain] = False
        rest = np.flatnonzero(odd).tolist()
        for at in range(0, len(plain), 20_000):
            groups = [plain[i : i + 250] for i in range(at, min(at + 20_000, len(plain)), 250)]
            for g, e in zip(groups, self.whole.encode_batch_fast(["".join([texts[i] for i in g]) for g in groups], add_special_tokens=False)):
                ids = np.array(e.ids, np.uint32)
                first = np.flatnonzero(self.opens[ids])  # a token that begins with the space opens a piece
                if len(first) == len(g):
                    self._add([pieces[i] for i in g], ids, np.diff(first, append=len(ids)))
                else:
                    rest.extend(g)
        for at in range(0, len(rest), 5_000):
            some = rest[at : at + 5_000]
            found = [e.ids for e in self.whole.encode_batch_fast([texts[i] for i in some], add_special_tokens=False)]
            lengths = np.array([len(x) for x in found])
            self._add([pieces[i] for i in some], np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum())), lengths)

    def _codes(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The number of each piece that begins at ``begins`` (the first at 0)."""
        bounds = np.append(begins, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(data.tobytes())]).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.count + len(distinct) > REMEMBERED:
            self.forget()
        self._learn(list(set(distinct).difference(self.known)))
        numbers = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        return numbers[coded.indices.to_numpy(zero_copy_only=False)]

    def _ids(self, codes: np.ndarray) -> np.ndarray:
        some = 1 << 18
        parts = [self.flat[expand(self.start[codes[i : i + some]], self.length[codes[i : i + some]])] for i in range(0, len(codes), some)]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def _long(self, data: np.ndarray) -> np.ndarray:
        """Ids of one text, slice by slice."""
        found = []
        while len(data) > SLICE_BYTES:
            reach = SLICE_BYTES
            while not len(at := cuts(data[:reach])) and reach < len(data):
                reach *= 2
            stop = int(at[-1]) if len(at) else len(data)
            part, data = data[:stop], data[stop:]
            found.append(self._ids(self._codes(part, np.concatenate([[0], cuts(part)]))))
        if len(data):
            found.append(self._ids(self._codes(data, np.concatenate([[0], cuts(data)]))))
        return np.concatenate([*found, [self.end_id]]).astype(np.uint32)

    def _short(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each text) of texts laid end to end."""
        n = len(offs) - 1
        codes, ends = np.zeros(0, np.int64), np.zeros(n, np.int64)
        if len(data):
            opens = np.zeros(len(data), bool)
            opens[cuts(data)] = True
            opens[offs[:-1][offs[:-1] < len(data)]] = True
            begins = np.flatnonzero(opens)
            codes = self._codes(data, begins)
            ends = np.searchsorted(begins, offs[1:], side="left")
        codes = np.insert(codes, ends, 0)
        upto = np.cumsum(self.length[codes])[ends + np.arange(n)]
        return self._ids(codes), np.diff(upto, prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): document i has ids[offsets[i]:offsets[i + 1]], the end id last; null is empty text."""
        data, offs = byte_view(texts)
        n = len(offs) - 1
        found: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        at = 0
        while at < n:
            own = data[offs[at] : offs[at + 1]]
            if len(own) > SLICE_BYTES or _special(own):
                ids = np.array([*self.whole.encode(own.tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids, self.end_id], np.uint32) if _special(own) else self._long(own)
                found.append(ids), counts.append(np.array([len(ids)]))
                at += 1
                continue
            to = at + 1
            while to < n and offs[to + 1] - offs[at] <= SLICE_BYTES and not _special(data[offs[to] : offs[to + 1]]):
                to += 1
            ids, lengths = self._short(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
            found.append(ids), counts.append(lengths)
            at = to
        ids = np.concatenate(found) if found else np.zeros(0, np.uint32)
        return ids, np.concatenate([[0], *[np.cumsum(np.concatenate(counts))]] if counts else [[0]]).astype(np.int64)


def _special(text: np.ndarray) -> bool:
    return b"<|" in text.tobytes()


_ENCODERS: dict[tuple[str, int], PieceEncoder] = {}
WORKER_CACHES.append(_ENCODERS)


def piece_encoder(path: str, end_id: int) -> PieceEncoder:
    """The worker's encoder for this vocabulary file, kept between tasks."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = PieceEncoder(path, end_id)
    return _ENCODERS[path, end_id]
