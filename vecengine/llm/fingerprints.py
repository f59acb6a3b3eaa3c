"""Bottom-k fingerprints of documents (op 7).

A fingerprint is the k least 64-bit hashes of the distinct five-word shingles of a text (a text of one to four
words is one shingle). Fingerprints merge: the k least of the union are the fingerprint of the union. With k hashes or
fewer they are exact; else the k-th least estimates the number of distinct shingles, and the share of the union's k least that both
have estimates resemblance; containment follows from the two.

For the query, texts move once to ranges of doc_id whose bounds are ids that occur, and the first document of each range
goes to the end of the range before it too, so that each document meets its successor without a window over all rows.

Defined results: words are maximal runs of letters, digits and underscores of the lower-cased text; a text without words has the empty
fingerprint, which is like itself (1.0) and unlike others (0.0); null text is empty; null doc_id comes first; rows of one doc_id
are in the order of their texts; an empty table gives no rows; the only document of a table is its own next.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecengine.llm import common
from vecengine.llm.hashing import MULTIPLIER, hashed, mixed

K, SHINGLE_WORDS = 128, 5
WORD = re.compile(r"\w+")
NO_WORD = re.compile(r"\W")
#: Input bytes of one range of documents.
PART_BYTES = 32 << 20
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles long"
#: Characters hashed at once; longer texts are cut between words.
SPAN_CHARS = 1 << 18
_cache: dict[str, np.ndarray] = {}


def word_marks() -> np.ndarray:
    """Which code points are letters, digits or underscores."""
    if "word" not in _cache:
        _cache["word"] = np.array([chr(c).isalnum() or c == 95 for c in range(0x110000)])
    return _cache["word"]


def _segments(text: str) -> Iterator[str]:
    """text, lower-cased, in stretches of about SPAN_CHARS that end between words."""
    text, at = text.lower(), 0
    while len(text) - at > SPAN_CHARS:
        cut = NO_WORD.search(text, at + SPAN_CHARS)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def word_hashes(texts: list[str]) -> tuple[np.ndarray, list[int]]:
    """64-bit hashes of the words of all texts, in order, and the number of words of each text. No word becomes an object."""
    hashes, sizes, held, owners, chars = [], np.zeros(len(texts), np.int64), [], [], 0

    def flush() -> None:
        nonlocal held, owners, chars
        if held:
            h, n = _span_hashes(held)
            hashes.append(h)
            np.add.at(sizes, owners, n)
        held, owners, chars = [], [], 0

    for i, text in enumerate(texts):
        for segment in _segments(text):
            if chars + len(segment) > SPAN_CHARS:
                flush()
            held.append(segment)
            owners.append(i)
            chars += len(segment)
    flush()
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), sizes.tolist()


def _span_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.flatnonzero(np.diff(word_marks()[codes], prepend=False))  # where words start and where they end, in turn
    starts, ends = edges[::2], edges[1::2]
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return hashed(codes, starts, ends - starts), np.diff(np.searchsorted(starts, bounds), prepend=0)


def shingle_hashes(texts: list[str], n: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """For each text the hashes of its runs of n words, in order; of all its words if they are fewer."""
    words, sizes = word_hashes(texts)
    count = max(0, len(words) - n + 1)
    runs = np.zeros(count, np.uint64)
    for i in range(n):
        runs = runs * MULTIPLIER + words[i : count + i]
    runs, out, at = mixed(runs), [], 0
    for size in sizes:
        if size >= n:
            out.append(runs[at : at + size - n + 1])
        else:
            few = 0
            for w in words[at : at + size].tolist():
                few = (few * int(MULTIPLIER) + w + 1) % (1 << 64)
            out.append(mixed(np.array([few] if size else [], np.uint64)))
        at += size
    return out


def bottom_k(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k least distinct hashes, ascending. Few distinct ones among many hashes don't hide others."""
    if len(hashes) > 4 * k:
        least = np.unique(np.partition(hashes, 2 * k)[: 2 * k])
        if len(least) >= k:
            return least[:k]
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    union = merge(a, b, k)
    if len(union) == 0:
        return 1.0
    both = np.sort(np.concatenate((a, b)))
    both = both[1:][both[1:] == both[:-1]]
    return float(np.searchsorted(both, union[-1], "right") / len(union))


def distinct_count(a: np.ndarray, k: int = K) -> int:
    """Exact below k hashes, else (k - 1) over the k-th least as a share of the range."""
    return len(a) if len(a) < k else int(round((k - 1) / (float(a[-1]) / 2.0**64)))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated share of a's shingles that b has."""
    if len(a) == 0:
        return 1.0
    union = distinct_count(merge(a, b, k), k)
    return float(min(1.0, resemblance(a, b, k) * union / distinct_count(a, k)))


def as_text(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u8").astype(np.uint64)


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    return [bottom_k(h) for h in shingle_hashes(texts)]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and estimated distinct shingles of each document: map only."""

    def run(batch: pa.RecordBatch) -> dict:
        prints = fingerprints(common.texts_of(batch))
        return {"doc_id": batch.column("doc_id"), "fingerprint": [as_text(p) for p in prints], "n_shingles": [distinct_count(p) for p in prints]}

    return common.map_batches(docs.select("doc_id", "text"), run, "doc_id long, fingerprint string, n_shingles long")


def with_successors(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """docs (doc_id, text) in ranges of doc_id, sorted; each range ends with a row (guest true) of the document after it."""
    docs = docs.select("doc_id", "text")
    bounds = common.id_bounds(docs, "doc_id", common.parts_for(docs, part_bytes))
    first = docs.agg(F.min("doc_id"), F.max(F.col("doc_id").isNull())).first()
    n = len(bounds) + 1
    key = F.col("doc_id")
    at = common.bucket_of(key, bounds)
    # The first document of range i > 0 has the i-th bound as its id; the first of all has no id or the least one.
    start = key.isNull() if first[1] else key == F.lit(first[0])
    begins = (key == F.element_at(F.lit(bounds), F.greatest(at, F.lit(1)))) & (at > 0) if bounds else F.lit(False)
    before = F.when(start, F.lit(n - 1)).when(begins & (at > 0), at - 1)
    both = F.filter(F.array(F.struct(at.alias("part"), F.lit(False).alias("guest")), F.struct(before.cast("int").alias("part"), F.lit(True).alias("guest"))), lambda x: x["part"].isNotNull())
    return docs.select("doc_id", "text", F.explode(both).alias("x")).select("x.part", "x.guest", "doc_id", "text").repartitionById(n, F.col("part")).sortWithinPartitions("part", "guest", "doc_id", "text")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document."""
    common.ship(docs.sparkSession)

    def edited(text: str, after: str) -> str:
        cut = len(text) // 4
        return text[: len(text) - cut] + after[:cut] if cut else text

    def run(batches):
        schema = common.schema_of(RESULT)
        held: list[tuple] = []  # the last row so far, whose successor is still to come
        guest_seen = False
        for batch in common.slices(batches):
            if guest_seen:
                break
            ids, texts, guests = batch.column("doc_id").to_pylist(), common.texts_of(batch), batch.column("guest").to_pylist()
            if True in guests:
                guest_seen = True
                end = guests.index(True) + 1
                ids, texts = ids[:end], texts[:end]
            rows = held + list(zip(ids, texts, fingerprints(texts), strict=True))
            held = rows[-1:]
            pairs = list(zip(rows, rows[1:], strict=False))
            new = [edited(a[1], b[1]) for a, b in pairs]
            out = []
            for (a, b), text, print_ in zip(pairs, new, fingerprints(new), strict=True):
                out.append((a[0], len(a[1]), hashlib.sha256(text.encode()).hexdigest(), as_text(a[2]), as_text(print_), resemblance(a[2], print_), resemblance(a[2], b[2]), distinct_count(a[2])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return with_successors(docs).mapInArrow(run, RESULT)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(common.table(spark, sf_dir, "documents"))
