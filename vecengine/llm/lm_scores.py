"""Stupid-backoff language-model scores, relationally (op 8).

S(w2 | w1) is c(w1 w2) / c(w1) where the counts have the bigram, else 0.4 c(w2) / N; a document's score is the sum of
log S over its words, the first by c(w) / N alone.

``score_against`` scores documents by the counts of another table: count tables partitioned by the n-gram's hash, joined to the
exploded n-grams of the documents to score, summed per document.

``score_corpus`` scores each document by the counts of all others (leave one out), so that n-grams that only the document itself has back
off. It is the same plan on blocks of some 2 million words, so that a row is an array of n-grams instead of one:
1. blocks: the words of each block as numbers of its distinct words, written once;
2. explode: a block sends each bucket of hashes its distinct n-grams and how often it has them, however frequent they are;
3. count and join: a bucket, which is one partition, adds up the counts of all blocks, that is its part of the count tables, and
   joins them to the n-grams of each block;
4. sum: a block takes each document's own occurrences from the totals, backs off where nothing is left, and sums per document.
A bucket gets an n-gram at most once from each block, so frequent ones weigh little; buckets have a fixed size, and their number grows
with the input. At least one n-gram is in each row, so rows never outnumber the n-grams that the plain form would move.

Defined results: words are maximal runs of letters, digits and underscores of the lower-cased text; null and wordless texts have
n_words 0 and score 0.0; a word that the counts lack counts as if seen once, and N is at least 1; null doc_id stays null; repeated
rows count and are scored as often as they occur, each by the others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecengine.llm import common
from vecengine.llm.fingerprints import word_hashes
from vecengine.llm.hashing import MULTIPLIER, mixed

BACKOFF = 0.4
#: Words and documents of a block; input bytes per bucket.
BLOCK_WORDS, BLOCK_DOCS, BUCKET_BYTES = 2_000_000, 60_000, 8 << 20
BLOCKS = "block long, n_words long, ids array<long>, sizes array<long>, vocabulary binary, words binary"
SENT = "bucket int, block long, kind int, hashes binary, counts binary"
ANSWERS = "block long, kind int, bucket int, totals binary"
RESULT = "doc_id long, n_words long, n_backed_off long, log_score double"
ONE, TWO = 1, 2


def _block_row(block: int, ids: list, sizes: list[int], words: np.ndarray) -> pa.RecordBatch:
    """The block's distinct words, the most frequent first, and its words as numbers of those: their three bytes apart, as the higher ones are mostly 0."""
    vocabulary, where, counts = np.unique(words, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    number = np.empty(len(order), np.uint32)
    number[order] = np.arange(len(order), dtype=np.uint32)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    planes = np.ascontiguousarray(number[where].astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    row = {"block": [block], "n_words": [len(words)], "ids": [ids], "sizes": [sizes], "vocabulary": [vocabulary[order].tobytes()], "words": [squeeze(planes)]}
    return pa.RecordBatch.from_pydict(row, schema=common.schema_of(BLOCKS))


class Block:
    """A block's words and their documents; its distinct n-grams are made when they are asked for, one kind at a time."""

    def __init__(self, row: dict, buckets: int):
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["words"]), np.uint8)
        words = np.ascontiguousarray(planes.reshape(4, len(planes) // 4).T).view("<u4").ravel()
        self.buckets, self.sizes = buckets, np.array(row["sizes"], np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.hashes = np.frombuffer(row["vocabulary"], np.uint64)[words]
        #: Words that have one before them in their document.
        self.later = np.flatnonzero(self.doc[1:] == self.doc[:-1]).astype(np.int32) + 1

    def grams(self, kind: int) -> tuple:
        """Distinct hashes by bucket, how often each occurs, the bounds of the buckets that have any, and each occurrence's place."""
        hashes = self.hashes if kind == ONE else mixed(self.hashes[self.later - 1] * MULTIPLIER + self.hashes[self.later])
        distinct, where, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        to = (distinct >> np.uint64(33)).astype(np.int64) % self.buckets
        order = np.argsort(to, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        some, first = np.unique(to[order], return_index=True)
        ends = np.append(first[1:], len(order))[: len(first)]
        return distinct[order], counts[order], list(zip(some.tolist(), first.tolist(), ends.tolist(), strict=True)), place[where]

    def elsewhere(self, kind: int, answers: dict[int, bytes]) -> np.ndarray:
        """For each occurrence how often other documents have its n-gram."""
        distinct, _, bounds, where = self.grams(kind)
        totals = np.concatenate([np.frombuffer(answers[b], np.int64) for b, _, _ in bounds]) if bounds else np.zeros(0, np.int64)
        doc, n = self.doc if kind == ONE else self.doc[self.later], len(distinct) + 1
        del distinct
        _, which, own = np.unique(doc.astype(np.int64) * n + where, return_inverse=True, return_counts=True)
        return totals[where] - own[which]


def _blocks(batches, block_words: int) -> Iterator[pa.RecordBatch]:
    task, number = TaskContext.get().partitionId(), 0
    ids, sizes, words, n = [], [], [], 0
    for batch in common.slices(batches):
        hashes, lengths = word_hashes(common.texts_of(batch))
        ids += batch.column("doc_id").to_pylist()
        sizes += lengths
        words.append(hashes)
        n += len(hashes)
        if n >= block_words or len(ids) >= BLOCK_DOCS:
            yield _block_row((task << 20) + number, ids, sizes, np.concatenate(words))
            ids, sizes, words, n, number = [], [], [], 0, number + 1
    if ids:
        yield _block_row((task << 20) + number, ids, sizes, np.concatenate(words))


def _sent(batches, buckets: int) -> Iterator[pa.RecordBatch]:
    """What each block sends the buckets."""
    for batch in batches:
        for row in batch.to_pylist():
            block = Block(row, buckets)
            for kind in (ONE, TWO):
                distinct, counts, bounds, _ = block.grams(kind)
                for i in range(0, len(bounds), 256):
                    some = bounds[i : i + 256]
                    yield pa.RecordBatch.from_pydict({
                        "bucket": [b for b, _, _ in some], "block": [row["block"]] * len(some), "kind": [kind] * len(some),
                        "hashes": [distinct[x:y].tobytes() for _, x, y in some], "counts": [counts[x:y].astype("<u4").tobytes() for _, x, y in some],
                    }, schema=common.schema_of(SENT))


def _counted(batches) -> Iterator[pa.RecordBatch]:
    """One bucket: its part of the count tables, joined to the n-grams of each block."""
    rows: list[dict] = []
    for batch in batches:
        rows += batch.to_pylist()
    while rows:
        bucket, kind = rows[0]["bucket"], rows[0]["kind"]
        mine = [r for r in rows if (r["bucket"], r["kind"]) == (bucket, kind)]
        rows = [r for r in rows if (r["bucket"], r["kind"]) != (bucket, kind)]
        hashes = np.frombuffer(b"".join(r["hashes"] for r in mine), np.uint64)
        _, where = np.unique(hashes, return_inverse=True)
        counts = np.frombuffer(b"".join(r["counts"] for r in mine), "<u4")
        totals = np.rint(np.bincount(where, counts)).astype(np.int64)[where]
        ends = np.cumsum([len(r["hashes"]) // 8 for r in mine]).tolist()
        for i in range(0, len(mine), 256):
            some = range(i, min(i + 256, len(mine)))
            yield pa.RecordBatch.from_pydict({
                "block": [mine[j]["block"] for j in some], "kind": [kind] * len(some), "bucket": [bucket] * len(some),
                "totals": [totals[ends[j] - len(mine[j]["hashes"]) // 8 : ends[j]].tobytes() for j in some],
            }, schema=common.schema_of(ANSWERS))


def _summed(row: dict, answers: dict[int, dict[int, bytes]], total: int, buckets: int) -> pa.RecordBatch:
    """The scores of a block's documents."""
    block = Block(row, buckets)
    one, two = block.elsewhere(ONE, answers[ONE]), block.elsewhere(TWO, answers[TWO])
    rest = np.log(np.maximum(total - block.sizes, 1))
    score = np.log(np.maximum(one, 1)) - rest[block.doc]
    known = two > 0
    score[block.later[~known]] += math.log(BACKOFF)
    score[block.later[known]] = np.log(two[known]) - np.log(one[block.later[known] - 1])
    n = len(block.sizes)
    sums, back = np.bincount(block.doc, score, n), np.bincount(block.doc[block.later[~known]], minlength=n)
    return pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(block.sizes), pa.array(back, pa.int64()), pa.array(sums)], schema=common.schema_of(RESULT))


def score_corpus(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_backed_off (words whose bigram no other document has) and log_score of each of docs (doc_id, text) under the counts of all others."""
    common.ship(docs.sparkSession)
    docs, words = docs.select("doc_id", "text"), BLOCK_WORDS
    buckets = common.parts_for(docs, BUCKET_BYTES)
    blocks = common.written(docs.mapInArrow(lambda batches: _blocks(batches, words), BLOCKS), "blocks")
    total, tasks = (x or 0 for x in blocks.agg(F.sum("n_words"), F.max(F.shiftright("block", 20)) + 1).first())
    sent = blocks.select("block", "sizes", "vocabulary", "words").mapInArrow(lambda batches: _sent(batches, buckets), SENT)
    answers = sent.repartitionById(buckets, F.col("bucket")).mapInArrow(_counted, ANSWERS)

    def summed(batches):
        row, got = None, {ONE: {}, TWO: {}}
        for batch in batches:
            for r in batch.to_pylist():  # sorted: a block's own row comes before its answers
                if r["kind"] == 0:
                    if row is not None:
                        yield _summed(row, got, total, buckets)
                    row, got = r, {ONE: {}, TWO: {}}
                else:
                    got[r["kind"]][r["bucket"]] = r["totals"]
        if row is not None:
            yield _summed(row, got, total, buckets)

    own = blocks.drop("n_words").select("block", F.lit(0).alias("kind"), F.lit(0).alias("bucket"), F.lit(None).cast("binary").alias("totals"), "ids", "sizes", "vocabulary", "words")
    both = own.unionByName(answers, allowMissingColumns=True)
    # Blocks are dealt out one after another: the first of each task that made them, then the second.
    number = F.col("block").bitwiseAND(F.lit((1 << 20) - 1)) * tasks + F.shiftright("block", 20)
    return both.repartitionById(buckets, F.pmod(number, F.lit(buckets)).cast("int")).sortWithinPartitions("block", "kind").mapInArrow(summed, RESULT)


def _words(docs: DataFrame) -> DataFrame:
    cut = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), 0).alias("w"))
    return cut


def score_against(docs: DataFrame, train: DataFrame) -> DataFrame:
    """doc_id, n_words and log_score of each of docs under the counts of train (text): explode, join, sum."""
    known = train.select(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), 0).alias("w"))
    ones = known.select(F.explode("w").alias("w2")).groupBy("w2").agg(F.count("*").alias("c"))
    bigrams = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("w1"), b.alias("w2")))
    twos = known.select(F.explode(bigrams).alias("x")).select("x.*").groupBy("w1", "w2").agg(F.count("*").alias("c12"))
    total = ones.agg(F.sum("c")).first()[0] or 1
    cut = common.written(_words(docs), "words")
    each = cut.select("row", F.posexplode("w").alias("at", "w2"), "w").select("row", "w2", F.when(F.col("at") > 0, F.get("w", F.col("at") - 1)).alias("w1"))
    each = each.groupBy("row", "w1", "w2").agg(F.count("*").alias("tf"))
    joined = each.join(twos, ["w1", "w2"], "left").join(ones.select("w2", F.col("c").alias("c2")), "w2", "left").join(ones.select(F.col("w2").alias("w1"), F.col("c").alias("c1")), "w1", "left")
    alone = F.log(F.coalesce("c2", F.lit(1)) / F.lit(float(total)))
    score = F.when(F.col("c12").isNotNull(), F.log(F.col("c12") / F.col("c1"))).when(F.col("w1").isNull(), alone).otherwise(F.lit(math.log(BACKOFF)) + alone)
    sums = joined.groupBy("row").agg(F.sum(F.col("tf") * score).alias("s"))
    return cut.join(sums, "row", "left").select("doc_id", F.size("w").cast("long").alias("n_words"), F.coalesce("s", F.lit(0.0)).alias("log_score"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score_corpus(common.table(spark, sf_dir, "documents"))
    each = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(0.0)
    return scores.select("doc_id", "n_words", "n_backed_off", F.round(each, 6).alias("score_per_word"), F.round("log_score", 4).alias("log_score"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
n AS (SELECT sum(len(w)) AS n FROM d),
ones AS (SELECT doc_id, x, count(*) AS k FROM (SELECT doc_id, unnest(w) AS x FROM d) GROUP BY ALL),
one AS (SELECT doc_id, x, sum(k) OVER (PARTITION BY x) - k AS c FROM ones),
pairs AS (SELECT doc_id, w[i] AS a, w[i + 1] AS b FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)),
twos AS (SELECT doc_id, a, b, count(*) AS k FROM pairs GROUP BY ALL),
two AS (SELECT doc_id, a, b, k, sum(k) OVER (PARTITION BY a, b) - k AS c FROM twos),
s AS (SELECT two.doc_id, sum(k * CASE WHEN two.c > 0 THEN ln(two.c / p.c) ELSE ln(0.4) + ln(greatest(q.c, 1) / greatest(n - len(w), 1)) END) AS s, coalesce(sum(k) FILTER (two.c = 0), 0) AS n_back
      FROM two JOIN one p ON p.doc_id = two.doc_id AND p.x = a JOIN one q ON q.doc_id = two.doc_id AND q.x = b JOIN d ON d.doc_id = two.doc_id, n GROUP BY two.doc_id),
f AS (SELECT d.doc_id, len(w) AS m, coalesce(n_back, 0) AS n_back, CASE WHEN len(w) = 0 THEN 0.0 ELSE coalesce(s, 0) + ln(greatest(o.c, 1) / greatest(n - len(w), 1)) END AS s
      FROM d LEFT JOIN s USING (doc_id) LEFT JOIN one o ON o.doc_id = d.doc_id AND o.x = w[1], n)
SELECT doc_id, CAST(m AS BIGINT) AS n_words, CAST(n_back AS BIGINT) AS n_backed_off, round(CASE WHEN m > 0 THEN s / m ELSE 0.0 END, 6) AS score_per_word, round(s, 4) AS log_score FROM f
"""
