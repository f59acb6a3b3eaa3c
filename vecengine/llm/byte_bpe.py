"""Byte-level BPE as a monoid (op 5).

A byte string's encoding is computed as a tree: halves are encoded on their own, and two neighbours are joined by encoding
a window over their boundary anew. The window grows by whole tokens until both of its ends are stable. That is
provable: a token sequence is the encoding of its bytes if and only if each adjacent pair of tokens is the encoding of
that pair's bytes, because merges are chosen by rank alone; so tokens left and right of a window can stay as soon as
the pairs across its ends encode to themselves. Decoding concatenates up the tree.

Texts are concatenations of the split pattern's matches, each encoded separately, so the tree goes on above the matches
as plain concatenation. Distinct pieces of texts are encoded once per worker (see ``pieces``).

Defined results: null text is empty (no ids); repeated rows give repeated rows; null doc_id stays null; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vecengine.llm import common
from vecengine.llm.pieces import PieceTable

#: Byte strings up to this length are leaves of the tree.
LEAF_BYTES = 2
#: Subtrees up to this length are kept in a bounded memo: words share halves.
KEEP_BYTES, MEMO_ENTRIES = 8, 100_000
#: Windows up to this length are encoded merge by merge; longer ones are trees themselves.
WINDOW_BYTES = 128
#: Longer byte strings are merged from a heap.
LONG_BYTES = 64
#: Entries of a worker's table of pieces, beyond which it starts anew.
PIECES = 1_000_000
#: Ids that a leaf of the decoding tree joins.
LEAF_IDS = 8192
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_coders: dict[tuple[str, str], ByteBpe] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.tokens = ranks, {v: k for k, v in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.short = lru_cache(1 << 16)(self.leaf)
        self.agrees = lru_cache(1 << 16)(self._agrees)
        self.halves: dict[bytes, list[bytes]] = {}
        self.pieces = PieceTable(lambda pieces: [common.packed(self.text_ids(p), "<u4") for p in pieces], "<u4", PIECES)

    def leaf(self, data: bytes) -> list[bytes]:
        """Merge the pair of least rank, the leftmost among equals, until none is in the vocabulary."""
        if len(data) > LONG_BYTES:
            return self._long_leaf(data)
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _long_leaf(self, data: bytes) -> list[bytes]:
        """The same merges from a heap of pairs over a linked list: n log n steps."""
        ranks, n = self.ranks, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at a position; end 0: merged away
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, start, stop = heappop(heap)
            middle = end[start]
            if not middle or middle >= n or middle == stop or end[middle] != stop:
                continue  # one of the two is not what it was
            end[start], end[middle] = stop, 0
            if stop < n:
                before[stop] = start
                if (rank := ranks.get(data[start : end[stop]])) is not None:
                    heappush(heap, (rank, start, end[stop]))
            left = before[start]
            if left >= 0 and (rank := ranks.get(data[left:stop])) is not None:
                heappush(heap, (rank, left, stop))
        out, at = [], 0
        while at < n:
            out.append(data[at : end[at]])
            at = end[at]
        return out

    def _agrees(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens' bytes encode to just them."""
        return left + right not in self.ranks and self.leaf(left + right) == [left, right]

    def join(self, x: list[bytes], y: list[bytes]) -> list[bytes]:
        """The encoding of the bytes of x and y from theirs."""
        if not x or not y:
            return [*x, *y]
        if self.agrees(x[-1], y[0]):
            return [*x, *y]
        i = j = 1
        while True:
            i, j = min(i, len(x)), min(j, len(y))
            window = b"".join(x[len(x) - i :] + y[:j])
            # A window beyond a leaf's size is itself a tree, except that one which cannot grow must not recurse into itself.
            middle = self.short(window) if len(window) <= 16 else self.leaf(window) if len(window) <= WINDOW_BYTES or (i == len(x) and j == len(y)) else self.tree(window)
            left = i == len(x) or self.agrees(x[len(x) - i - 1], middle[0])
            right = j == len(y) or self.agrees(middle[-1], y[j])
            if left and right:
                return x[: len(x) - i] + middle + y[j:]
            i, j = i if left else 2 * i, j if right else 2 * j

    def tree(self, data: bytes) -> list[bytes]:
        if len(data) <= LEAF_BYTES:
            return self.leaf(data)
        known = self.halves.get(data)
        if known is None:
            half = len(data) // 2
            known = self.join(self.tree(data[:half]), self.tree(data[half:]))
            if len(data) <= KEEP_BYTES:
                if len(self.halves) > MEMO_ENTRIES:
                    self.halves.clear()
                self.halves[data] = known
        return known

    def text_ids(self, text: str) -> list[int]:
        """The ids of all matches of the split pattern."""
        ids: list[int] = []
        for match in (text,) if text[:1] == " " and text[1:].isalpha() else self.find(text):
            data = match.encode()
            rank = self.ranks.get(data)
            ids.extend([rank] if rank is not None else [self.ranks[t] for t in self.tree(data)])
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        return self.pieces.encode(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.tokens.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def coder(ranks_path: str, pattern: str) -> ByteBpe:
    """This worker's coder."""
    common.claim("byte_bpe", _coders.clear)
    if (ranks_path, pattern) not in _coders:
        _coders[ranks_path, pattern] = ByteBpe(read_ranks(ranks_path), pattern)
    return _coders[ranks_path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Per document: number of ids, digests of ids and decoded bytes, and with keep_ids the ids themselves (binary, 32 bits each)."""
    ddl = RESULT + (", ids binary" if keep_ids else "")

    def run(batch: pa.RecordBatch) -> dict:
        bpe = coder(ranks_path, pattern)
        encoded = bpe.encode(common.texts_of(batch))
        out = {
            "doc_id": batch.column("doc_id"),
            "n_tokens": [len(x) // 4 for x in encoded],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in encoded],
            "decoded_sha256": [hashlib.sha256(bpe.decode(np.frombuffer(x, "<u4"))).hexdigest() for x in encoded],
        }
        return out | ({"ids": encoded} if keep_ids else {})

    return common.map_batches(docs.select("doc_id", "text"), run, ddl)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
