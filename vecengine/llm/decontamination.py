"""Benchmark decontamination by containment search (op 4).

Which documents contain at least a share t of a short test item's five-word shingles, however long they are? Items are
partitioned by size (powers of two of their distinct shingles). The items of a partition whose largest size is u have as their
MinHash signature the u - ceil(t u) + 1 least shingle hashes. A document that contains a share t of an item lacks fewer of its
shingles than the signature has, so it has one of the signature: the search loses nothing, and its chance hits depend on
the item's size only. A document meets the partitions whose items it is large enough to contain; each item that it
hits is verified by exact containment of the shingles' words.

MinHash of whole documents can't do this: a document of 20,000 words that contains an item of 30 shingles resembles it to
0.0015. So the signatures are the items' alone, and all shingles of a document are looked up.

Documents never move. Items go to the workers in blocks of bounded size, one pass over the documents for each.

Defined results: one row per document row and item found; words are maximal runs of letters, digits and underscores of the
lower-cased text; an item of one to four words is one shingle; null, empty and wordless texts and items contain nothing and are
in nothing; repeated rows give repeated results; null ids stay null; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecengine.llm import common
from vecengine.llm.fingerprints import SHINGLE_WORDS, WORD, shingle_hashes

THRESHOLD = 0.8
#: Text bytes of the items of one block: the bound on what is broadcast.
BLOCK_BYTES, MARK_BITS = 32 << 20, 22
RESULT = "doc_id long, item_id long, n_shingles long, n_found long, containment double"
_indexes: dict[str, ItemIndex] = {}


class ItemIndex:
    """The signatures of items [(item_id, text)], by the number of words of a shingle."""

    def __init__(self, items: list[tuple], threshold: float):
        self.threshold = threshold
        self.items, by_width = [], {}
        for item_id, text in items:
            words = WORD.findall((text or "").lower())
            width = min(SHINGLE_WORDS, len(words))
            if not width:
                continue
            shingles = sorted({" ".join(words[i : i + width]) for i in range(len(words) - width + 1)})
            hashes = np.sort(np.concatenate(shingle_hashes(shingles, width)))
            largest = 2 ** len(shingles).bit_length() - 1  # of the item's partition
            signature = hashes[: largest - math.ceil(threshold * largest) + 1]
            by_width.setdefault(width, []).append((signature, len(self.items)))
            self.items.append((item_id, shingles, math.ceil(threshold * len(shingles) - 1e-9)))
        self.lookup = {}
        for width, signatures in by_width.items():
            keys = np.concatenate([s for s, _ in signatures])
            owners = np.concatenate([np.full(len(s), i) for s, i in signatures])
            order = np.argsort(keys, kind="stable")
            marks = np.zeros(1 << MARK_BITS, bool)  # most shingles are no item's: their hashes' first bits tell
            marks[keys >> np.uint64(64 - MARK_BITS)] = True
            self.lookup[width] = (keys[order], owners[order], marks)

    def search(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text's number, item's number, shingles found) of all that reach the threshold."""
        out = []
        for width, (keys, owners, marks) in self.lookup.items():
            found = shingle_hashes(texts, width)
            flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
            may = np.flatnonzero(marks[flat >> np.uint64(64 - MARK_BITS)])
            low, high = np.searchsorted(keys, flat[may], "left"), np.searchsorted(keys, flat[may], "right")
            text_of = np.searchsorted(np.cumsum([len(x) for x in found]), may, "right")
            candidates = {(int(text_of[h]), int(o)) for h in np.flatnonzero(high > low) for o in owners[low[h] : high[h]]}
            whole: dict[int, str] = {}
            for text, owner in sorted(candidates):
                _, shingles, least = self.items[owner]
                if len(found[text]) < least:  # a partition of items too large for this document
                    continue
                if text not in whole:
                    whole[text] = f" {' '.join(WORD.findall(texts[text].lower()))} "
                n = sum(f" {s} " in whole[text] for s in shingles)
                if n >= least:
                    out.append((text, owner, n))
        return out


def indexes(spark: SparkSession, items: DataFrame, threshold: float, block_bytes: int) -> list[Callable[[], ItemIndex]]:
    """For each block of items (item_id, text) a function that gives its index on a worker."""
    items = items.select("item_id", "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = []
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        sent, key = spark.sparkContext.broadcast([tuple(r) for r in block.collect()]), uuid.uuid4().hex  # about block_bytes

        def index(sent=sent, key=key) -> ItemIndex:
            if key not in _indexes:
                _indexes.clear()
                _indexes[key] = ItemIndex(sent.value, threshold)
            return _indexes[key]

        out.append(index)
    return out


def find_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The items (item_id, text) that each of docs (doc_id, text) contains to the threshold or more."""
    docs, found = docs.select("doc_id", "text"), None
    for at_hand in indexes(docs.sparkSession, items, threshold, block_bytes):

        def run(batch: pa.RecordBatch, at_hand=at_hand) -> dict:
            index, ids = at_hand(), batch.column("doc_id").to_pylist()
            hits = index.search(common.texts_of(batch))
            sizes = [len(index.items[o][1]) for _, o, _ in hits]
            return {"doc_id": [ids[t] for t, _, _ in hits], "item_id": [index.items[o][0] for _, o, _ in hits], "n_shingles": sizes, "n_found": [n for _, _, n in hits], "containment": [n / s for (_, _, n), s in zip(hits, sizes, strict=True)]}

        part = common.map_batches(docs, run, RESULT)
        found = part if found is None else found.unionByName(part)
    return found


def without_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, that contain none of items to the threshold."""
    common.ship(docs.sparkSession)
    for at_hand in indexes(docs.sparkSession, items, threshold, block_bytes):

        def run(batches, at_hand=at_hand):
            for batch in common.slices(batches):
                hit = {t for t, _, _ in at_hand().search(common.texts_of(batch))}
                yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH items AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item_id, w, least(5, len(w)) AS n FROM items WHERE len(w) > 0),
item_shingles AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS s FROM sized),
docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
doc_shingles AS (SELECT DISTINCT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS s
                 FROM docs, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM item_shingles GROUP BY item_id),
found AS (SELECT doc_id, item_id, count(*) AS n_found FROM item_shingles JOIN doc_shingles USING (n, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment FROM found JOIN sizes USING (item_id) WHERE n_found >= 0.8 * n_shingles
"""
