"""Token counts under a unigram model by dynamic programming over a trie (op 10).

The distinct pre-tokens of a batch go into a trie that the worker keeps. Each new node, one prefix, gets its forward
score once: the best sum of piece scores over all segmentations of the prefix, found from the scores of its ancestors,
and the least number of tokens that reaches it. Every pre-token that shares the prefix uses them. A terminal node's count is the
pre-token's; a document's is the sum over its pre-tokens.

The public vocabulary has pieces but no unigram probabilities: its own scores are ranks of merges. So ``fit_scores`` first counts
how often the vocabulary's own library uses each piece over all documents (sums of integers, so that partitions don't
matter), and a piece's score is the logarithm of its share, with one added to each count, in whole millionths, so that sums and ties are exact.
The scores, one number for each piece, are fixed from then on. The pieces stay as they are.

A text is written as the vocabulary writes it, with a mark for each space and one before its start; a pre-token is a run of
marks and the run of other characters after it. No piece has a mark after another character, so segmentations of the
pre-tokens are those of the whole text. A character without a piece costs the least score less 10 (in logarithms), and counts as its
UTF-8 bytes.

Defined results: null and empty texts have no pre-tokens and no tokens; null doc_id stays null; repeated rows count as often as they occur and
give repeated rows; other columns are ignored; an empty table gives no rows, and all its pieces are alike.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecengine.llm import common
from vecengine.llm.pieces import Memo

MARK = "▁"
PRETOKEN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Nodes of a worker's trie, beyond which it starts anew.
TRIE_NODES = 500_000
KEEP_CHARS = 64
#: Distinct pre-tokens whose counts a task holds before it looks at their pieces.
HELD_PRETOKENS = 200_000
#: Scores are whole numbers of this part of 1.
UNIT = 1_000_000
RESULT = "doc_id long, n_pretokens long, n_tokens long"
_counters: dict[str, TrieCounter] = {}


class TrieCounter:
    def __init__(self, scores: dict[str, int]):
        self.scores = scores
        self.back: dict[tuple[int, str], int] = {}
        self.ends: list[int | None] = [None]
        for piece, score in scores.items():
            state = 0
            for char in reversed(piece):
                state = self.back.setdefault((state, char), len(self.ends))
                if state == len(self.ends):
                    self.ends.append(None)
            self.ends[state] = score
        self.unknown = min(scores.values(), default=0) - 10 * UNIT
        self.memo = Memo()
        self._renew()

    def _renew(self) -> None:
        self.children: dict[tuple[int, str], int] = {}
        self.best, self.count = [0], [0]  # the root is the empty prefix

    def _insert(self, word: str) -> int:
        """The number of tokens of word; its prefixes become nodes."""
        if len(self.best) > TRIE_NODES:
            self._renew()
        children, best, count, back, ends = self.children, self.best, self.count, self.back, self.ends
        path, node = [0], 0
        for end, char in enumerate(word, 1):
            nxt = children.get((node, char))
            if nxt is None:
                top, least = best[node] + self.unknown, count[node] + len(char.encode())
                # Pieces that end here, by a walk back through the trie of reversed pieces.
                state = 0
                for start in range(end - 1, -1, -1):
                    state = back.get((state, word[start]))
                    if state is None:
                        break
                    score = ends[state]
                    if score is not None:
                        at = path[start]
                        total = best[at] + score
                        if total > top or (total == top and count[at] + 1 < least):
                            top, least = total, count[at] + 1
                nxt = len(best)
                children[node, char] = nxt
                best.append(top)
                count.append(least)
            path.append(nxt)
            node = nxt
        return count[node]

    def count_all(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Pre-tokens and tokens of each text."""
        cut = [pretokens(t) for t in texts]
        memo, wanted = self.memo, set().union(*cut)
        for x in sorted(memo.missing(wanted)):
            memo[x] = self._insert(x if x[:1] == MARK else MARK + x)
        totals = [sum(map(memo.__getitem__, pieces)) for pieces in cut]
        for x in [x for x in wanted if len(x) > KEEP_CHARS]:
            del memo[x]
        return [len(p) for p in cut], totals


def pretokens(text: str) -> list[str]:
    """The pre-tokens of text, without the mark where it is their only one and first."""
    pieces = text.split(" ") if text else []
    if "" in pieces or MARK in text:
        pieces = [x[1:] if x[0] == MARK and MARK not in x[1:] and len(x) > 1 else x for x in PRETOKEN.findall(MARK + text.replace(" ", MARK))]
    return pieces


def _library(model_path: str):
    """The vocabulary's library, and the numbers of the pieces that can be scored: no control pieces, bytes or unknown piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return model, [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


def piece_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """(piece, n): how often the library's segmentation of all texts of docs uses each piece; those that occur."""
    common.ship(docs.sparkSession)

    def run(batches):
        model, _ = _library(model_path)
        totals, mark = np.zeros(model.get_piece_size(), np.int64), model.piece_to_id(MARK)
        held: Counter = Counter()

        def flush() -> None:
            nonlocal totals
            names = list(held)
            for i in range(0, len(names), 10_000):
                some = names[i : i + 10_000]
                ids = model.encode([(x[1:] if x[:1] == MARK else x).replace(MARK, " ") for x in some], num_threads=1)
                ids = [[mark] if x == MARK else y for x, y in zip(some, ids, strict=True)]
                sizes = [len(x) for x in ids]
                weights = np.repeat(np.array([held[x] for x in some], np.int64), sizes)
                totals += np.rint(np.bincount(np.fromiter(chain.from_iterable(ids), np.int64, sum(sizes)), weights, len(totals))).astype(np.int64)
            held.clear()

        for batch in common.slices(batches):
            for text in common.texts_of(batch):
                held.update(pretokens(text))
            if len(held) > HELD_PRETOKENS:
                flush()
        flush()
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_pydict({"piece": used.astype(np.int32), "n": totals[used]}, schema=common.schema_of("piece int, n long"))

    return docs.select("text").mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def fit_scores(docs: DataFrame, model_path: str) -> dict[str, int]:
    """A score for each piece of the vocabulary, from piece_counts; the driver gets one number for each piece."""
    model, ids = _library(model_path)
    counts = {r["piece"]: r["n"] for r in piece_counts(docs, model_path).collect()}  # at most one row for each piece
    total = sum(counts.get(i, 0) + 1 for i in ids)
    return {model.id_to_piece(i): round(UNIT * math.log((counts.get(i, 0) + 1) / total)) for i in ids}


def count_tokens(docs: DataFrame, scores: dict[str, int]) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of each of docs (doc_id, text) under scores."""
    sent, key = docs.sparkSession.sparkContext.broadcast(scores), uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> dict:
        common.claim("token_counts", _counters.clear)
        if key not in _counters:
            _counters.clear()
            _counters[key] = TrieCounter(sent.value)
        n_pretokens, n_tokens = _counters[key].count_all(common.texts_of(batch))
        return {"doc_id": batch.column("doc_id"), "n_pretokens": n_pretokens, "n_tokens": n_tokens}

    return common.map_batches(docs.select("doc_id", "text"), run, RESULT)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    return count_tokens(docs, fit_scores(docs, public_tokenizers.path("piece_bpe_32k.model")))
