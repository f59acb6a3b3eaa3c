"""Encoding of whole texts through pieces that are encoded once.

A text is cut where the common split pattern of byte-level tokenizers (letters, digits, marks, white space) starts a new match
whatever surrounds the place, so the encodings of the pieces, joined, are the encoding of the text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from vecengine.llm.hashing import hashed

#: Entries of one generation of a memo.
MEMO_ENTRIES = 250_000
#: Characters of a piece that the table keeps, and of all its pieces.
LONG_PIECE, POOL_CHARS = 256, 1 << 25
#: Letters and then only such marks are two matches of the split pattern.
MARKS = ".,;:!?%$&*#)]}\""


class Memo(dict):
    """A dict of at most about two generations of so many entries: what the older one still gives moves to the younger."""

    def __init__(self, entries: int | None = None):
        super().__init__()
        self.older: dict = {}
        self.entries = entries or MEMO_ENTRIES

    def missing(self, wanted: set) -> list:
        """Those of wanted that neither generation has; the others are here afterwards."""
        if len(self) > self.entries:
            self.older = dict(self)
            self.clear()
        absent = wanted.difference(self)
        found = absent.intersection(self.older)
        self.update((x, self.older[x]) for x in found)
        return list(absent - found if found else absent)


class Pool:
    """A growing flat array."""

    def __init__(self, dtype: np.dtype):
        self.data, self.size = np.zeros(1 << 12, dtype), 0

    def add(self, more: np.ndarray) -> None:
        end = self.size + len(more)
        if end > len(self.data):
            self.data = np.concatenate((self.data[: self.size], np.zeros(max(end, 2 * len(self.data)) - self.size, self.data.dtype)))
        self.data[self.size : end] = more
        self.size = end


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices start .. start + len of each stretch, one after another."""
    done = np.cumsum(lens)
    return np.repeat(starts - (done - lens), lens) + np.arange(int(done[-1]) if len(done) else 0)


class PieceTable:
    """encode_many takes a list of strings and returns for each the bytes of its encoding; encode does so for whole texts.

    Texts are cut before a single space between other characters, between letters and MARKS, before white space, and after a
    single line break or the like: no match of the pattern spans those places. Pieces of up to LONG_PIECE characters are looked up by a
    64-bit hash in a sorted table whose characters and tokens lie in flat arrays, and a hit counts only if the characters agree; pieces whose
    hash belongs to another piece, and longer ones, are encoded as they come. The table starts anew beyond so many entries or POOL_CHARS.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], dtype: str, entries: int):
        self.encode_many, self.dtype, self.entries = encode_many, np.dtype(dtype), entries
        self.kinds = np.zeros(0x110000, np.uint8)  # 1: letter, 2: mark, 4: white space, 8: other, 16: separators that not all call white space
        for c in range(0x110000):
            ch = chr(c)
            self.kinds[c] = 1 if ch.isalpha() else 2 if ch in MARKS else 16 if "\x1c" <= ch <= "\x1f" else 4 if ch.isspace() else 8
        self._renew()

    def _renew(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.lens, self.char_at, self.char_lens = (np.zeros(0, np.int64) for _ in range(4))
        self.pool, self.chars = Pool(self.dtype), Pool(np.dtype(np.uint32))

    def _starts(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where pieces begin."""
        kind = self.kinds[codes]
        before, after = np.concatenate((np.zeros(1, np.uint8), kind[:-1])), np.concatenate((kind[1:], np.zeros(1, np.uint8)))
        space = codes == 32
        cut = space & ((before | after) & 20 == 0) & (after != 0)  # a single space belongs to what follows
        cut |= ((kind == 1) & (before == 2)) | ((kind == 2) & (before == 1))
        cut |= (kind == 4) & ~space & (before & 20 == 0)
        single = (kind == 4) & ~space & (before & 20 == 0)
        cut |= (kind & 20 == 0) & np.concatenate((np.zeros(1, bool), single[:-1]))  # a longer run is split by what follows it
        first = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
        cut[first[first < len(codes)]] = True
        # Before a document's end nothing follows: a space there is no single space between characters.
        last = ends[ends > 0] - 1
        keep = np.zeros(len(codes), bool)
        keep[first[first < len(codes)]] = True
        cut[last] &= ~space[last] | keep[last]
        return np.flatnonzero(cut)

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all pieces and the number of each piece's."""
        found = self.encode_many(pieces)
        return np.frombuffer(b"".join(found), self.dtype), np.array([len(x) for x in found], np.int64) // self.dtype.itemsize

    def encode(self, texts: list[str]) -> list[bytes]:
        ends = np.cumsum(np.array([len(t) for t in texts], np.int64))
        joined = "".join(texts)
        if not joined:
            return [b""] * len(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = self._starts(codes, ends)
        sizes = np.diff(np.append(starts, len(codes)))
        if len(self.keys) > self.entries or self.chars.size > POOL_CHARS:
            self._renew()
        piece = lambda i: joined[starts[i] : starts[i] + sizes[i]]
        short = np.flatnonzero(sizes <= LONG_PIECE) if int(sizes.max()) > LONG_PIECE else np.arange(len(sizes))
        distinct, one, inverse = np.unique(hashed(codes, starts[short], sizes[short]), return_index=True, return_inverse=True)
        new, place = np.zeros(0, np.int64), np.searchsorted(self.keys, distinct)
        if len(distinct):
            known = self.keys[np.minimum(place, len(self.keys) - 1)] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
            new = np.flatnonzero(~known)
        if len(new):
            own = short[one[new]]
            tokens, lens = self._encoded([piece(i) for i in own.tolist()])
            at, char_at = self.pool.size + np.cumsum(lens) - lens, self.chars.size + np.cumsum(sizes[own]) - sizes[own]
            self.pool.add(tokens)
            self.chars.add(codes[ranges(starts[own], sizes[own])])
            keys = np.concatenate((self.keys, distinct[new]))
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.at, self.lens, self.char_at, self.char_lens = (np.concatenate(x)[order] for x in ((self.at, at), (self.lens, lens), (self.char_at, char_at), (self.char_lens, sizes[own])))
            place = np.searchsorted(self.keys, distinct)
        where = place[inverse]
        at, lens = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        at[short], lens[short] = self.at[where], self.lens[where]
        # A hit is the piece itself only if all its characters are.
        same = self.char_lens[where] == sizes[short]
        alike = np.flatnonzero(same)
        if len(alike):
            n = sizes[short[alike]]
            apart = self.chars.data[ranges(self.char_at[where[alike]], n)] != (codes if len(alike) == len(starts) else codes[ranges(starts[short[alike]], n)])
            if apart.any():
                same[alike[np.unique(np.searchsorted(np.cumsum(n), np.flatnonzero(apart), "right"))]] = False
        own = np.ones(len(starts), bool)
        own[short[same]] = False
        own, pool = np.flatnonzero(own), self.pool.data
        if len(own):
            strings = [piece(i) for i in own.tolist()]
            names = list(dict.fromkeys(strings))
            number = {x: i for i, x in enumerate(names)}
            tokens, n = self._encoded(names)
            of = np.array([number[x] for x in strings])
            at[own], lens[own] = (self.pool.size + np.cumsum(n) - n)[of], n[of]
            pool = np.concatenate((pool[: self.pool.size], tokens))
        tokens = pool[ranges(at, lens)]
        token_ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(lens)))[np.searchsorted(starts, ends)].tolist()
        data, size = tokens.tobytes(), self.dtype.itemsize
        return [data[a * size : b * size] for a, b in zip([0, *token_ends[:-1]], token_ends, strict=True)]
