"""Language identification with hyperdimensional profiles (op 9).

Each letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its letters' vectors, each permuted
(rotated) by its distance from the end. A text's profile bundles (adds) the vectors of its trigrams, a language's prototype bundles those
of its documents, and a text gets the language whose prototype has the largest cosine with its profile. Runs of anything but
letters count as one space.

Prototypes are sums of integers, so they don't depend on the order of rows or on repeated tasks. Every labelled document
counts, by its trigrams' counts. Each task sends one vector per language; the driver gets one per language.

Defined results: ``und`` with score 0.0 if text is null or has no letter, or if there is nothing to learn from; ties
go to the language that is first by name; score is the cosine, at least 0; a null doc_id counts as the text ``null`` in the
hold-out rule; repeated rows count as often as they occur; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecengine.llm import common

DIMENSIONS, SEED = 1024, 7
#: Letters below this code point have vectors of their own; others share the vectors of as many classes again.
OWN_LETTERS = 1 << 11
#: Rows of a batch; distinct trigrams of it whose vectors are kept at hand together (4 KB each).
ROWS, SHARED_TRIGRAMS = 128, 20_000
UNDETERMINED = "und"
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"
_tables: dict[str, np.ndarray] = {}


def letter_classes() -> np.ndarray:
    """For each code point the class of its lower-case letter; 0 for all that isn't a letter."""
    if "classes" not in _tables:
        classes = np.zeros(0x110000, np.int32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ord(ch.lower()[0])
                classes[c] = low if low < OWN_LETTERS else OWN_LETTERS + low % OWN_LETTERS
        _tables["classes"] = classes
    return _tables["classes"]


def letter_vectors() -> np.ndarray:
    if "vectors" not in _tables:
        _tables["vectors"] = (np.random.default_rng(SEED).integers(0, 2, (2 * OWN_LETTERS, DIMENSIONS), np.int8) * 2 - 1).astype(np.int8)
    return _tables["vectors"]


def trigrams(text: str) -> np.ndarray:
    """The trigrams of text's letters and single spaces, as 36-bit keys; none without letters."""
    codes = letter_classes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    codes = np.concatenate(([0], codes, [0]))
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))].astype(np.int64)
    return (codes[:-2] << 24) | (codes[1:-1] << 12) | codes[2:] if len(codes) > 2 else codes[:0]


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def bound_vectors(keys: np.ndarray) -> np.ndarray:
    """One row of +1 and -1 for each trigram."""
    if "rotated" not in _tables:
        _tables["rotated"] = np.stack([np.roll(letter_vectors(), r, axis=1) for r in (2, 1, 0)])
    two, one, none = _tables["rotated"]
    return two[keys >> 24] * one[(keys >> 12) & 0xFFF] * none[keys & 0xFFF]


def bundle(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of the trigrams' vectors, as integers; in blocks that bound memory."""
    total = np.zeros(DIMENSIONS, np.int64)
    for i in range(0, len(keys), 4096):
        total += np.rint(counts[i : i + 4096].astype(np.float64) @ bound_vectors(keys[i : i + 4096]).astype(np.float64)).astype(np.int64)
    return total


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 4 == 2


def _ready() -> None:
    common.claim("language", _tables.clear)


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """A prototype of length 1 for each language of docs (text, lang)."""
    common.ship(docs.sparkSession)
    ddl = "lang string, vector array<long>"

    def partial(batches):
        _ready()
        sums: dict[str, np.ndarray] = {}
        for batch in common.slices(batches):
            by: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(common.texts_of(batch), batch.column("lang").to_pylist(), strict=True):
                by.setdefault(lang, []).append(trigrams(text))
            for lang, keys in by.items():
                sums[lang] = sums.get(lang, 0) + bundle(*counted(np.concatenate(keys)))
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "vector": [v.tolist() for v in sums.values()]}, schema=common.schema_of(ddl))

    parts = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang").mapInArrow(partial, ddl)
    summed = parts.select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    whole = summed.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("vector"))
    found = {r["lang"]: np.array(r["vector"], np.float64) for r in whole.collect()}  # one row per language
    return {k: found[k] / np.linalg.norm(found[k]) for k in sorted(found) if np.any(found[k])}


def predict(texts: list[str], names: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    """Languages and scores of texts under the prototypes that are the rows of matrix."""
    _ready()
    found = [counted(trigrams(t)) for t in texts]
    distinct, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    vectors = bound_vectors(distinct).astype(np.float32) if len(distinct) <= SHARED_TRIGRAMS else None
    langs, scores, at = [], [], 0
    for keys, counts in found:
        lang, score = UNDETERMINED, 0.0
        if len(keys) and names:
            if vectors is not None:
                profile = counts.astype(np.float32) @ vectors[where[at : at + len(keys)]]
            else:
                profile = bundle(keys, counts).astype(np.float32)
            cosines = matrix @ profile / max(float(np.linalg.norm(profile)), 1e-9)
            best = int(np.argmax(cosines))
            lang, score = names[best], min(1.0, max(0.0, float(cosines[best])))
        langs.append(lang)
        scores.append(score)
        at += len(keys)
    return langs, scores


def as_matrix(prototypes: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    names = list(prototypes)
    return names, np.array([prototypes[k] for k in names], np.float32).reshape(len(names), DIMENSIONS)


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each of docs (doc_id, text)."""
    names, matrix = as_matrix(prototypes)

    def run(batch: pa.RecordBatch) -> dict:
        langs, scores = predict(common.texts_of(batch), names, matrix)
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": langs, "score": scores}

    return common.map_batches(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), run, RESULT, ROWS)


def with_language(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """The rows of docs whose language can be told, all columns; a null lang becomes the one found. Without prototypes all texts that have a letter stay, as they are."""
    common.ship(docs.sparkSession)
    names, matrix = as_matrix(prototypes)
    at = docs.columns.index("lang")

    def run(batches):
        for batch in common.slices(batches, ROWS):
            if not names:
                yield batch.filter(pa.array([len(trigrams(t)) > 0 for t in common.texts_of(batch)]))
                continue
            langs, _ = predict(common.texts_of(batch), names, matrix)
            lang = pa.array([own if own is not None else new for own, new in zip(batch.column("lang").to_pylist(), langs, strict=True)], batch.schema.field(at).type)
            kept = pa.array([x != UNDETERMINED for x in langs])
            yield pa.RecordBatch.from_arrays([lang if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema).filter(kept)

    return docs.mapInArrow(run, docs.schema)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return identify(docs, learn(docs.where(~held_out(F.col("doc_id")))))
