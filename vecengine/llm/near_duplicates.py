"""Near-duplicate documents by Order MinHash (op 6).

A text's k-mers are its pairs of neighbouring words, each labelled with its number among equal ones. For each of SEEDS random orders
the sketch takes the DEPTH least labelled k-mers and keeps them in the order of the text; two texts that share such a tuple are candidates.
Unlike MinHash this sees repeats and order, and so edit similarity. Candidates are verified by banded alignment:
the edit distance of their words within the band that the threshold allows, 1 - distance / (words of the longer) >= 0.8.

Lengths decide what a text is found by, in bands that overlap so that each pair whose lengths allow the threshold shares a band:
- up to SHORT words: all that is left of the text without as many words as the threshold lets go, so that every similar pair is found;
- up to MEDIUM words: tuples of DEPTH - 1, as few k-mers survive an edit; beyond: tuples of DEPTH.
Edits that are spread as evenly as can be leave 3 of 5 pairs of words at the threshold, J = 0.43, the least that a long text can have with
replaced words; it is found with 1 - (1 - J^3)^64 = 0.995.

Steps, each cut by a table in the shared folder:
1. Equal texts become one class by their SHA-256; only classes go on, so copies never meet each other again.
2. Each tuple's bucket has a hub, its least text. Every text is aligned with the least of its hubs; verified pairs
   are links, and links become components. A large family of near copies is one component after this, by one alignment a text.
3. A round that only saves work: in each bucket the least text of each component stands for it. Up to HOT of them meet
   pairwise, up to CROWDED meet the bucket's hub. Links are added to the components.
4. The exact rest: in each bucket that still has several components all texts of different components meet, as a head that is unlike
   says nothing of its component's other texts. The texts of buckets of more than CROWDED texts, which a common passage fills, meet over rare words instead:
   texts that are similar to the threshold have so many words in common that they share one of the rarest of each, as many as the
   threshold lets go and one. That loses no pair (and doesn't depend on the bucket), and a passage's words are the last to be among the rarest.
   Two texts meet over the last of the words that they share: each row names words after its own, and texts that have one of these in common leave the pair to that word's group.
   Before that those go that are similar to none of them: a text similar to another has at least 1 - 2 (1 - threshold) of its
   pairs of words in common with it, and so in common with texts of other components, which a passage alone doesn't reach in a longer text.
   Should more than BLOCK texts share a rare word, they are dealt into blocks, and each pair of blocks is a task's group of its own.
   Of each two components the pair with the closest bags is aligned first, and all other pairs only if that leaves the two apart.
5. Components of all links are the classes; a class's id is its least doc_id.

Texts that meet are aligned unless their bags of words, as counts of BAG hashed words, are already too far apart: a bound that
loses no pair. Buckets are aggregated before they are joined, what they are joined to is a table by then, so that Spark splits skewed partitions, and no group is
ever gathered in one place. Components come from alternating large and small stars.

Defined results: null text is empty; texts without words equal each other only if they are the same; null doc_id gets
the class of its text (class_id null if no member has an id); repeated rows are members of one class; an empty table gives no rows; other
columns are ignored; a document alike to none has its own id as class_id.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from itertools import chain, combinations
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecengine.llm import common
from vecengine.llm.fingerprints import WORD, word_hashes
from vecengine.llm.hashing import MULTIPLIER, mixed

THRESHOLD, SEEDS, DEPTH = 0.8, 64, 3
#: Words up to which texts are found by what is left of them without some words, and up to which by tuples of DEPTH - 1.
SHORT, MEDIUM = 14, 49
#: Components in a bucket beyond which they meet its hub before they meet each other; texts of a bucket beyond which it is crowded; texts of a block; counts of a bag.
HOT, CROWDED, BLOCK, BAG = 8, 64, 1024, 512
#: Words by which a text's meetings over its rarer words are told to be repeated ones, at most: they go with each of these.
LATER = 128
#: Pairs that a task aligns.
PAIRS = 512
#: Words that are ordered by how many texts have them, at most: they are the most frequent ones, and all workers hold them.
FREQUENT_WORDS = 100_000
#: Places that pairs of words are hashed to, so that the driver and workers hold SLOTS / 8 bytes at any size; places of a range; rounds of the test.
SLOTS, RANGE, ROUNDS = 1 << 25, 1 << 19, 2
_rng = np.random.default_rng(11)
XORS, FACTORS = (_rng.integers(0, 1 << 63, (2, SEEDS, 1), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1))
TOP = np.uint64((1 << 64) - 1)


def labelled(kmers: np.ndarray) -> np.ndarray:
    """The k-mers' hashes, those of second and later occurrences changed by their number."""
    ordered = np.sort(kmers)
    if len(kmers) < 2 or (ordered[1:] != ordered[:-1]).all():
        return kmers
    order = np.argsort(kmers, kind="stable")
    ordered = kmers[order]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    at = np.arange(len(kmers))
    number = np.empty(len(kmers), np.uint64)
    number[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return np.where(number > 0, mixed(kmers + number * MULTIPLIER), kmers)


def order_min_hash(kmers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per seed the keys of the tuples of DEPTH and of DEPTH - 1 least labelled k-mers, in text order."""
    own, n = labelled(kmers), len(kmers)
    step, depth = max(1, min(SEEDS, (1 << 17) // n)), min(DEPTH, n)
    least = np.empty((SEEDS, depth), np.int64)
    for i in range(0, SEEDS, step):
        ranks = own * FACTORS[i : i + step] + XORS[i : i + step]  # k-mers' hashes are random already: a product orders them anew
        for k in range(depth):
            if k:
                ranks[at, found] = TOP
            at, found = np.arange(len(ranks)), ranks.argmin(axis=1)
            least[i : i + step, k] = found
    keys = []
    for some in (least, least[:, : DEPTH - 1]):
        key = XORS[:, 0].copy()
        for column in np.sort(some, axis=1).T:  # the order of the text
            key = mixed(key * MULTIPLIER + own[column])
        keys.append(key.view(np.int64))
    return keys[0], keys[1]


@lru_cache(None)
def _kept(n: int, left: int) -> np.ndarray:
    return np.array(list(combinations(range(n), left)), np.int64).T


def shortened(words: np.ndarray, drop: int) -> np.ndarray:
    """Keys of all that is left of words without up to drop of them. Two texts within drop edits share one."""
    keys = []
    for left in range(len(words), len(words) - drop - 1, -1):
        kept = _kept(len(words), left)
        key = np.full(kept.shape[1], MULTIPLIER)
        for at in kept:
            key = mixed(key * MULTIPLIER + words[at])
        keys.append(key.view(np.int64))
    return np.concatenate(keys)


def keys_of(words: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """The keys of a text's words (hashes): texts that share one are candidates."""
    n, keys = len(words), []
    if 0 < n <= SHORT:
        keys.append(shortened(words, int((1 - threshold) * n + 1e-9)))
    if n > 1 and n >= threshold * (SHORT + 1) - 1e-9:
        deep, flat = order_min_hash(mixed(words[:-1] * MULTIPLIER + words[1:]))
        if n <= MEDIUM:
            keys.append(flat)
        if n >= threshold * (MEDIUM + 1) - 1e-9:
            keys.append(deep)
    return np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)


def bag_of(words: np.ndarray) -> bytes:
    """How many of the words (hashes) fall into each of BAG classes, up to 255."""
    return np.minimum(np.bincount((words % np.uint64(BAG)).astype(np.int64), minlength=BAG), 255).astype(np.uint8).tobytes()


def banded_distance(a: list, b: list, limit: int) -> int | None:
    """The edit distance of a and b if it is at most limit, by bits of the differences between neighbouring cells of the band.

    Column j holds the cells of rows j - limit to j + limit, one bit each, so that a column takes a few operations on integers of
    2 limit + 1 bits. The lower edge of the band is followed until it meets the last row, and that row to its end.
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > limit:
        return None
    start = 0
    while start < m and a[start] == b[start]:
        start += 1
    while m > start and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[start:n], b[start:m]
    n, m = len(a), len(b)
    if not m:
        return n
    k = min(limit, n)
    rows: dict = {}
    for i, x in enumerate(a):
        rows.setdefault(x, []).append(i)
    at = {x: sum(1 << i for i in rows[x]) if len(rows[x]) < 64 else int.from_bytes(np.packbits(np.isin(np.arange(n), rows[x]), bitorder="little").tobytes(), "little") for x in set(b) if x in rows}
    whole = (1 << (2 * k + 1)) - 1
    up, down, distance = whole ^ ((1 << k) - 1), 0, k  # cells one more, one less than the cell above; the band's lower edge
    most = limit + m - (n - k)
    for j, x in enumerate(b):
        equal = at.get(x, 0)
        if equal:
            equal = (equal >> (j - k) if j >= k else equal << (k - j)) & whole
        diagonal = ((((equal & up) + up) ^ up) | equal | down) & whole  # cells equal to the one before them in both
        more, less = down | (whole ^ (diagonal | up)), diagonal & up  # one more, one less than the cell to the left
        if j < n - k:
            distance += not diagonal >> (2 * k)
        else:
            row = n - 1 - j + k
            distance += (more >> row & 1) - (less >> row & 1)
        if distance > most:
            return None
        diagonal >>= 1
        up, down = less | (whole ^ (diagonal | more)), diagonal & more
    return distance if distance <= limit else None


def similar(a: list, b: list, threshold: float = THRESHOLD) -> bool:
    longer = max(len(a), len(b))
    limit = int((1 - threshold) * longer + 1e-9)
    if abs(len(a) - len(b)) > limit:
        return False
    if longer - sum((Counter(a) & Counter(b)).values()) > limit:  # no alignment can have more matches
        return False
    return banded_distance(a, b, limit) is not None


def text_key(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def sketches(docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, h (of the text), number of words, the keys and the bag of each document."""
    ddl = "doc_id long, h binary, n_words int, keys array<long>, bag binary"

    def run(batch: pa.RecordBatch) -> dict:
        texts = common.texts_of(batch)
        words, sizes = word_hashes(texts)
        own = np.split(words, np.cumsum(sizes)[:-1])
        return {"doc_id": batch.column("doc_id"), "h": batch.column("h"), "n_words": sizes, "keys": [keys_of(w, threshold) for w in own], "bag": [bag_of(w) for w in own]}

    return common.map_batches(docs.select("doc_id", "text", text_key(F.col("text")).alias("h")), run, ddl)


def components(links: DataFrame) -> DataFrame:
    """u and v (the least of its component) for each node of links (a, b) but the least ones themselves."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges = common.written(edges, "links")
    while True:
        # Done when all edges lead to nodes that have no lesser neighbour, one from each node: then a component is a star.
        nodes = edges.select(F.col("u").alias("node"), F.lit(1).alias("n"), F.lit(0).alias("of")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("n"), F.lit(1).alias("of")))
        if not nodes.groupBy("node").agg(F.sum("n").alias("n"), F.max("of").alias("of")).where("n > 1 OR (n > 0 AND of > 0)").count():
            return edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A table, so that the rows of a node with very many neighbours can be split over tasks.
        least = common.written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = common.written(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "stars")


def merged(stars: DataFrame, links: DataFrame) -> DataFrame:
    """stars (u, v as of ``components``) with links (a, b) besides: components of the components, which are few."""
    ends = links.join(stars.select(F.col("u").alias("a"), F.col("v").alias("va")), "a", "left").join(stars.select(F.col("u").alias("b"), F.col("v").alias("vb")), "b", "left")
    more = components(ends.select(F.coalesce("va", "a").alias("a"), F.coalesce("vb", "b").alias("b")).where("a != b"))
    above = more.select(F.col("u").alias("w"), F.col("v").alias("x"))
    moved = stars.join(above, stars["v"] == above["w"], "left").select("u", F.coalesce("x", "v").alias("v"))
    return common.written(moved.unionByName(more.select("u", "v")), "merged")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """pairs (a, b) with ok: whether their texts (h, z) are similar to the threshold or more."""

    def run(batch: pa.RecordBatch) -> dict:
        unpack = zstandard.ZstdDecompressor().decompress
        words = [[WORD.findall(unpack(z).decode().lower()) for z in batch.column(c).to_pylist()] for c in ("za", "zb")]
        return {"a": batch.column("a"), "b": batch.column("b"), "ok": [similar(x, y, threshold) for x, y in zip(*words, strict=True)]}

    with_a = pairs.join(texts.select(F.col("h").alias("a"), F.col("z").alias("za")), "a")
    both = with_a.join(texts.select(F.col("h").alias("b"), F.col("z").alias("zb")), "b")
    return common.map_batches(both.select("a", "b", "za", "zb"), run, "a binary, b binary, ok boolean", rows=64)


def packed_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """The first columns of rows, as many as schema has."""
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=False)], schema=schema)


def lengths_allow(a: str, b: str, threshold: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * threshold - 1e-9


def meetings(rows: DataFrame, threshold: float, closest: bool = False) -> DataFrame:
    """Distinct pairs (a < b) of texts of one group (key, lo, hi) that have unlike labels and may be similar by their lengths and bags; with closest, of each two labels the pair alone whose bags are closest.

    rows have key, lo, hi, side, h, label, n_words and bag; with a column many, texts without it don't meet each other. Where lo = hi all texts of the group meet, else those of side lo meet those of side hi.
    With a column others (some keys of other groups of the text, in an order that all texts share), two texts that have one of these in common don't meet here, as they do there.
    """
    common.ship(rows.sparkSession)
    ddl = "a binary, b binary, la binary, lb binary, apart long" if closest else "a binary, b binary"

    def pairs_of(group: list[np.ndarray]):
        """Numbers of the pairs of a group, and how far apart their bags are."""
        side, labels, n, bags, many, others = group
        keys = lru_cache(None)(lambda i: frozenset(np.frombuffer(others[i], np.int32).tolist()))
        across = side[0] != side[-1]  # sorted by side
        cut = int(np.searchsorted(side, side[-1])) if across else 0
        for i in range(cut if across else len(n) - 1):
            rest = slice(cut if across else i + 1, None)
            longer = np.maximum(n[rest], n[i])
            limit = np.floor((1 - threshold) * longer + 1e-9)
            open_ = np.flatnonzero((many[rest] | many[i]) & (labels[rest] != labels[i]).any(axis=1) & (np.abs(n[rest] - n[i]) <= limit))
            if len(open_):
                # An edit changes the counts by 2 at most where it replaces a word, and by 1 where the lengths differ.
                apart = np.abs(bags[rest][open_] - bags[i]).sum(axis=1, dtype=np.int64)
                near = apart + np.abs(n[rest][open_] - n[i]) <= 2 * limit[open_]
                if others[i]:
                    near[near] = [keys(i).isdisjoint(keys(y)) for y in (open_[near] + rest.start).tolist()]
                yield i, open_[near] + rest.start, apart[near]

    def closest_of(group: list[np.ndarray]):
        """Of the pairs of a group the closest of each two labels."""
        found = [(np.full(len(near), x), near, apart) for x, near, apart in pairs_of(group) if len(near)]
        if found:
            x, y, apart = (np.concatenate(c) for c in zip(*found, strict=True))
            codes = np.unique(group[1], axis=0, return_inverse=True)[1].reshape(-1)
            two = np.minimum(codes[x], codes[y]) * len(codes) + np.maximum(codes[x], codes[y])
            order = np.lexsort((apart, two))
            for k in order[np.flatnonzero(np.concatenate(([True], two[order][1:] != two[order][:-1])))].tolist():
                yield int(x[k]), y[k : k + 1], apart[k : k + 1]

    def run(batches):
        schema, held, told = common.schema_of(ddl), None, set()
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                table = pa.Table.from_batches([batch])
                held = table if held is None else pa.concat_tables([held, table])
            if held is None or (batch is not None and not batch.num_rows):
                continue
            group = np.stack([held[c].to_numpy().astype(np.int64) for c in ("key", "lo", "hi")])
            edges = np.concatenate(([0], np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1, [held.num_rows]))
            if batch is not None:
                edges = edges[:-1]  # the last group may go on
            whole = held.slice(0, int(edges[-1]))
            held = held.slice(int(edges[-1]))
            if whole.num_rows:
                hs = whole["h"].to_pylist()
                many = whole["many"].to_numpy()
                side, n = whole["side"].to_numpy(), whole["n_words"].to_numpy().astype(np.int64)
                labels = np.frombuffer(b"".join(whole["label"].to_pylist()), np.uint64).reshape(-1, 2)
                bags = np.frombuffer(b"".join(whole["bag"].to_pylist()), np.uint8).reshape(-1, BAG).astype(np.int16)
                others = whole["others"].to_pylist()
                own, out = whole["label"].to_pylist(), {}
                for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    if j - i > 1:
                        for x, near, apart in (closest_of if closest else pairs_of)([side[i:j], labels[i:j], n[i:j], bags[i:j], many[i:j], others[i:j]]):
                            for y, d in zip(near.tolist(), apart.tolist(), strict=True):
                                u, v = sorted(((hs[i + x], own[i + x]), (hs[i + y], own[i + y])), key=itemgetter(1 if closest else 0))
                                two = (u[1], v[1]) if closest else (u[0], v[0])
                                if two not in told and (two not in out or d < out[two][4]):
                                    out[two] = (u[0], v[0], u[1], v[1], d)
                    if len(out) > 50_000:
                        yield packed_rows([*out.values()], schema)
                        told, out = (set() if closest else set(out)), {}
                yield packed_rows([*out.values()], schema)

    rows = rows.select("key", "lo", "hi", "side", "h", "label", "n_words", "bag", "many" if "many" in rows.columns else F.lit(True).alias("many"), "others" if "others" in rows.columns else F.lit(b"").alias("others"))
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "side").mapInArrow(run, ddl)
    if closest:
        rows = rows.groupBy("la", "lb").agg(F.min(F.struct("apart", "a", "b")).alias("x")).select(F.least("x.a", "x.b").alias("a"), F.greatest("x.a", "x.b").alias("b"))
    return rows.distinct()


def in_blocks(rows: DataFrame) -> DataFrame:
    """rows (with n, the size of their bucket) with lo, hi and side, so that all texts of a bucket meet each other: in one group up to BLOCK, else once for each pair of blocks."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    whole = rows.where(F.col("n") <= BLOCK).select("*", *[F.lit(0).alias(c) for c in ("lo", "hi", "side")])
    dealt = rows.where(F.col("n") > BLOCK).withColumn("side", F.pmod(F.xxhash64("h"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return whole.unionByName(dealt.withColumn("lo", F.least("side", "other")).withColumn("hi", F.greatest("side", "other")).drop("other"))


def split_words(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The words (hashes) of the packed texts z."""
    unpack = zstandard.ZstdDecompressor().decompress
    words, sizes = word_hashes([unpack(z).decode() for z in batch.column("z").to_pylist()])
    return np.split(words, np.cumsum(sizes)[:-1])


def slots_of(words: np.ndarray) -> np.ndarray:
    """The places of a text's labelled pairs of neighbouring words."""
    return (labelled(mixed(words[:-1] * MULTIPLIER + words[1:])) % np.uint64(SLOTS)).astype(np.int64)


def without_lone(crowd: DataFrame, threshold: float) -> DataFrame:
    """crowd (h, n_words, label, z) without texts that can be similar to none of another label.

    Of two similar texts each has at most 2 (1 - threshold) of its words' number in pairs of neighbouring words that the other lacks: a word that
    is replaced or left out takes two, and one that is added takes one, but makes the other text longer. So a text goes if more of
    its pairs occur under its own label alone. Pairs that share a place count as one pair, which can only keep a text.
    """

    def places(batch: pa.RecordBatch) -> dict:
        """For each range the places in it and the labels there, as one row."""
        slots = [np.unique(slots_of(w)) for w in split_words(batch)]
        labels = np.frombuffer(b"".join(batch.column("label").to_pylist()), np.uint64).reshape(-1, 2)
        labels, slots = np.repeat(labels, [len(x) for x in slots], axis=0), np.concatenate(slots)
        order = np.argsort(slots, kind="stable")
        cuts = np.searchsorted(slots[order], np.arange(0, SLOTS + 1, RANGE))
        parts = [order[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return {"range": np.arange(len(parts)), "slots": [slots[x].tobytes() for x in parts], "labels": [labels[x].tobytes() for x in parts]}

    def several(batches):
        """The bits of the places of each range that have more than one label: two arrays a range, however many rows it has."""
        schema, at, found, label = common.schema_of("range long, bits binary"), None, None, None
        for batch in chain(batches, [None]):
            rows = zip(*(batch.column(c).to_pylist() for c in ("range", "slots", "labels")), strict=True) if batch is not None else [(None, b"", b"")]
            for number, slots, labels in rows:
                if number != at:
                    if at is not None:
                        yield pa.RecordBatch.from_pydict({"range": [at], "bits": [np.packbits(found > 1, bitorder="little").tobytes()]}, schema=schema)
                    at, found, label = number, np.zeros(RANGE, np.int8), np.zeros((RANGE, 2), np.uint64)
                if number is None:
                    continue
                place, own = np.frombuffer(slots, np.int64) % RANGE, np.frombuffer(labels, np.uint64).reshape(-1, 2)
                new = found[place] == 0
                label[place[new]] = own[new]
                found[place[new]] = 1
                found[place[(label[place] != own).any(axis=1)]] = 2

    rows = common.map_batches(crowd.select("label", "z"), places, "range long, slots binary, labels binary")
    held = np.zeros((SLOTS // RANGE, RANGE // 8), np.uint8)
    for row in rows.repartition("range").sortWithinPartitions("range").mapInArrow(several, "range long, bits binary").collect():
        held[row["range"]] = np.frombuffer(row["bits"], np.uint8)
    sent = crowd.sparkSession.sparkContext.broadcast(held.reshape(-1))

    def kept(batch: pa.RecordBatch) -> dict:
        bits, keep = sent.value, []
        for words in split_words(batch):
            slots = slots_of(words)
            alone = len(slots) - int((bits[slots >> 3] >> (slots & 7) & 1).sum())
            keep.append(alone <= 2 * (1 - threshold) * len(words) + 1e-6)
        some = batch.filter(pa.array(keep, pa.bool_()))
        return {c: some.column(c) for c in ("h", "n_words", "label", "z")}

    return common.map_batches(crowd.select("h", "n_words", "label", "z"), kept, "h binary, n_words int, label binary, z binary")


def rarest_words(crowd: DataFrame, threshold: float) -> DataFrame:
    """crowd (h, n_words, label, z) with words instead of z: the rarest words of each text in order (32 bits of their hashes), as many as may be missing from a similar text and one.

    Words are labelled by their number among equal ones. Any order that is the same for all texts loses no pair: here words that many
    of crowd have come last, the most frequent at the end, and others are in the order of their hashes. Those many are at most FREQUENT_WORDS, as each
    has more than that share of all labelled words.
    """

    def each(batch: pa.RecordBatch) -> dict:
        w, c = np.unique(np.concatenate([labelled(w) for w in split_words(batch)]).view(np.int64), return_counts=True)
        return {"w": w, "c": c}

    counts = common.map_batches(crowd.select("z"), each, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))
    counts = common.written(counts.where("c > 1"), "words")
    total = counts.agg(F.sum("c")).first()[0] or 0
    often = counts.where(F.col("c") > total / FREQUENT_WORDS).toArrow()
    order = np.argsort(often.column("w").to_numpy())
    sent = crowd.sparkSession.sparkContext.broadcast((often.column("w").to_numpy()[order], often.column("c").to_numpy()[order]))

    def rarest(batch: pa.RecordBatch) -> dict:
        names, numbers = sent.value
        keys = []
        for words in split_words(batch):
            w = labelled(words).view(np.int64)
            at = np.minimum(np.searchsorted(names, w), max(0, len(names) - 1))
            rank = np.where(names[at] == w, numbers[at], 0) if len(names) else np.zeros(len(w), np.int64)
            least = w[np.lexsort((w, rank))[: len(w) - int(np.ceil(threshold * len(w) - 1e-9)) + 1]]
            keys.append((least >> 32).astype(np.int32).tobytes())  # words that are equal in these share a group, which loses no pair
        return {c: batch.column(c) for c in ("h", "n_words", "label")} | {"words": keys}

    return common.map_batches(crowd, rarest, "h binary, n_words int, label binary, words binary")


def words_apart(rare: DataFrame) -> DataFrame:
    """(h, key, n_words, label, later) for each word of each row of rare; later is the number of words after it."""

    def each(batch: pa.RecordBatch) -> dict:
        words = [np.frombuffer(w, np.int32) for w in batch.column("words").to_pylist()]
        at = pa.array(np.repeat(np.arange(batch.num_rows), [len(w) for w in words]))
        own = {c: batch.column(c).take(at) for c in ("h", "n_words", "label")}
        return own | {"key": np.concatenate(words).astype(np.int64), "later": np.concatenate([np.arange(len(w))[::-1] for w in words])}

    return common.map_batches(rare, each, "h binary, key long, n_words int, label binary, later int")


def profiles_of(bags: DataFrame, rare: DataFrame) -> DataFrame:
    """bags (h, bag) with tail: the last LATER of the words of rare, where the text is in it."""
    return bags.join(rare.select("h", F.substring("words", -4 * LATER, 4 * LATER).alias("tail")), "h", "left")


def with_others(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """rows (with h and later, null where the key is no word) with bag and others: those words of the text's tail that come after the row's own, so that two texts meet over the most frequent word that they share, and seldom over more."""
    start = F.octet_length("tail") - 4 * F.least("later", F.lit(LATER)) + 1
    others = F.when(F.col("later") > 0, F.substring("tail", start, F.lit(4 * LATER))).otherwise(F.lit(b""))
    return rows.join(profiles, "h", "left").withColumn("others", others).drop("tail")


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), h (the text's digest) and root (the class's, the least of its texts') of each row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    found = common.written(sketches(docs, threshold), "sketches")
    texts = found.groupBy("h").agg(F.min("doc_id").alias("rep_id"), F.first("n_words").alias("n_words"), F.first("keys").alias("keys"), F.first("bag").alias("bag"))
    texts = common.written(texts, "texts")

    rows = texts.select("h", "n_words", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("h").alias("hub")).where("n > 1").select("key", "hub")
    shared = common.written(rows.join(common.written(shared, "keys"), "key"), "buckets")
    # Of buckets with the same texts (by their number, the least and two sums of hashes) one stands for all.
    of = shared.groupBy("key").agg(F.count("*").alias("n"), F.min("hub").alias("hub"), F.bit_xor(F.xxhash64("h")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "h")).alias("y"))
    shared = common.written(shared.join(common.written(of.groupBy("n", "hub", "x", "y").agg(F.min("key").alias("key")).select("key"), "keys"), "key"), "buckets")

    # The least hub of each text whose length allows it, and the packed texts of all that share a bucket.
    sizes = texts.select(F.col("h").alias("hub"), F.col("n_words").alias("hub_words"))
    hubs = shared.where("h != hub").select("h", "n_words", "hub").distinct().join(sizes, "hub").where(lengths_allow("n_words", "hub_words", threshold))
    first = common.written(hubs.groupBy(F.col("h").alias("b")).agg(F.min("hub").alias("a")), "hubs")
    needed = shared.select("h").distinct().join(texts.select("h", "rep_id"), "h")
    bags = common.written(shared.select("h").distinct().join(texts.select("h", "bag"), "h"), "bags")

    def pack(batch: pa.RecordBatch) -> dict:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        return {"h": batch.column("h"), "rid": batch.column("rid"), "z": [squeeze(t.encode()) for t in common.texts_of(batch)]}

    # A text is taken from the row with its class's least id, so copies of one text don't meet in one task.
    no_id = F.lit(-(1 << 63))
    packed = common.map_batches(docs.select(text_key(F.col("text")).alias("h"), F.coalesce("doc_id", no_id).alias("rid"), "text"), pack, "h binary, rid long, z binary")
    # A merge join at every size, so that small tables show what large ones need.
    bodies = packed.join(needed.select("h", F.coalesce("rep_id", no_id).alias("rid")).hint("merge"), ["h", "rid"]).select("h", "z").dropDuplicates(["h"])
    bodies = common.written(bodies, "bodies")

    checked = common.written(verified(first, bodies, threshold), "checked")
    links = checked.where("ok").select("a", "b")
    stars = components(links)

    def labelled_by(stars: DataFrame, rows: DataFrame) -> DataFrame:
        return rows.join(stars, rows["h"] == stars["u"], "left").withColumn("label", F.coalesce("v", "h")).drop("u", "v")

    def opened(members: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
        """The members (key, h, n_words, label) of buckets with more than one component and up to most rows, with the size n of the bucket and its hub; and the
        texts of larger buckets."""
        keys = members.groupBy("key").agg(F.count("*").alias("n"), F.min_by("h", F.xxhash64("key", "h")).alias("hub"), F.min("label").alias("l"), F.max("label").alias("m"), F.max("many").alias("many") if "many" in members.columns else F.lit(True).alias("many"))
        keys = common.written(keys.where("l < m AND many").drop("l", "m", "many"), "open")
        few = keys if most is None else keys.where(F.col("n") <= most)
        crowd = None if most is None else members.join(keys.where(F.col("n") > most).select("key"), "key").select("h", "n_words").distinct()
        return common.written(members.join(few, "key"), "members"), crowd

    def checked_with(rows: DataFrame, checked: DataFrame, closest: bool = False) -> tuple[DataFrame, bool]:
        """The pairs checked so far and those of rows that meet; and whether there are new links."""
        if not rows.count():
            return checked, False
        # What is compared joins the rows last, as it is much more than they are.
        wide = with_others(rows, profiles) if "later" in rows.columns else rows.join(bags, "h")
        pairs = common.written(meetings(wide, threshold, closest).join(checked, ["a", "b"], "left_anti"), "pairs")
        parts = max(1, min(common.MOST_PARTS, -(-pairs.count() // PAIRS)))  # pairs are few bytes and much work
        new = common.written(verified(pairs.repartition(parts, "a", "b"), bodies, threshold), "checked")
        return checked.unionByName(new), new.where("ok").count() > 0

    checked = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "ok")
    bucketed = shared.select("key", "h", "n_words")
    heads = labelled_by(stars, bucketed).groupBy("key", "label").agg(F.min(F.struct("h", "n_words")).alias("x")).select("key", "label", "x.*")
    side = F.when((F.col("n") > HOT) & (F.col("h") != F.col("hub")), 1).otherwise(0)
    heads, _ = opened(heads, CROWDED)
    labels = stars
    checked, found_some = checked_with(heads.select("*", F.lit(0).alias("lo"), F.when(F.col("n") > HOT, 1).otherwise(0).alias("hi"), side.alias("side")), checked)
    if found_some:
        labels = merged(stars, checked.where("ok").select("a", "b"))

    members, crowd = opened(labelled_by(labels, bucketed), CROWDED)
    crowd = common.written(labelled_by(labels, crowd).join(bodies, "h"), "crowd")
    if crowd.count():
        for _ in range(ROUNDS):
            crowd = common.written(without_lone(crowd, threshold), "crowd")
        rare = common.written(rarest_words(crowd, threshold), "rare")
        profiles = common.written(profiles_of(bags, rare), "profiles")
        members = members.withColumn("later", F.lit(None).cast("int")).unionByName(opened(common.written(words_apart(rare), "words"))[0])
    # First the closest pair of each two components: what it links has no need of the others, which are quadratic in the sizes of both.
    checked, more = checked_with(in_blocks(members), checked, closest=True)
    if more:
        labels = merged(labels, checked.where("ok").select("a", "b"))
    # Two texts that are components of their own have been checked then.
    linked = labels.unionByName(labels.select(F.col("v").alias("u"), "v").distinct()).withColumn("many", F.lit(True))
    members, _ = opened(labelled_by(linked, members.drop("label", "n", "hub")).withColumn("many", F.coalesce("many", F.lit(False))))
    checked, more = checked_with(in_blocks(members), checked)
    stars = merged(labels, checked.where("ok").select("a", "b")) if more else labels

    ids = texts.select("h", "rep_id")
    nodes = stars.select(F.col("u").alias("h"), "v").unionByName(stars.select(F.col("v").alias("h"), "v").distinct()).join(ids, "h")
    least = nodes.groupBy("v").agg(F.min("rep_id").alias("class_id"))
    classes = nodes.join(least, "v").select("h", "class_id", "v")
    classes = ids.join(classes, "h", "left").select("h", F.when(F.col("v").isNotNull(), F.col("class_id")).otherwise(F.col("rep_id")).alias("class_id"), F.coalesce("v", "h").alias("root"))
    # A table again: then the copies of one text, which may be a third of all rows, can be split over tasks.
    return found.select("doc_id", "h").join(common.written(classes, "classes"), "h", "left").select("doc_id", "class_id", "h", "root")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class of docs, all columns: that with the least doc_id (of its texts the one with the least digest)."""
    classes = common.written(near_duplicate_classes(docs, threshold), "classes")
    no_id = F.lit(-(1 << 63))
    kept = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", no_id).alias("key"), "h")).alias("x")).select("x.*")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("doc_id", no_id).alias("key"), text_key(F.col("text")).alias("h"))
    return rows.join(kept, ["key", "h"]).dropDuplicates(["key", "h"]).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(common.table(spark, sf_dir, "documents")).select("doc_id", "class_id")
