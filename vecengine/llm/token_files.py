"""Token ids in flat files (op 2).

Layout of a folder: ``part-NNNNN.tokens`` holds the ids of consecutive documents as flat little-endian unsigned
integers (16 bits where the vocabulary allows, else 32), ``part-NNNNN.index`` holds n + 1 64-bit offsets into it and then n
64-bit document ids, and the table ``manifest`` has one row per part with its first document and first token (prefix sums
of the parts' counts) and how many of its documents, the first ones, have no id. A reader maps both files into memory and adds the part's base to an offset.

Texts move once, to ranges of doc_id. Each attempt of a task writes under a name of its own and moves the whole
file into place, so lost executors and repeated tasks do no harm.

Defined results: null text is empty (the end id alone); null doc_id comes first, counted in the manifest and null again in the result; rows of one doc_id are in the order of their texts; an empty table makes an
empty manifest; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecengine.llm import common
from vecengine.llm.pieces import PieceTable

#: Input bytes that one token file is made from.
PART_BYTES = 64 << 20
#: Pieces that are encoded in one call.
JOINED_PIECES = 2000
#: Entries of a worker's table of pieces, beyond which it starts anew.
MEMO_ENTRIES = 2_000_000
#: How the vocabulary writes a space.
SPACE = "\u0120"
COUNTS = "part int, n_docs long, n_null long, n_tokens long"
MANIFEST = f"{COUNTS}, first_doc long, first_token long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
_encoders: dict[tuple[str, str], PieceTable] = {}


def dtype_for(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def load_tokenizer(tokenizer_path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(tokenizer_path)
    tokenizer.encode_special_tokens = True  # a special token's string in a text is ordinary text
    return tokenizer


def _encoder(tokenizer_path: str, dtype: str) -> PieceTable:
    """This worker's encoder."""
    common.claim("token_files", _encoders.clear)
    if (tokenizer_path, dtype) not in _encoders:
        tokenizer = load_tokenizer(tokenizer_path)

        starts = np.zeros(tokenizer.get_vocab_size(), bool)  # the tokens that begin with a space
        starts[[i for token, i in tokenizer.get_vocab().items() if token.startswith(SPACE)]] = True
        size = np.dtype(dtype).itemsize

        def encode_many(pieces: list[str]) -> list[bytes]:
            """Pieces of a space and letters are one match each: many are encoded as one text and told apart by the tokens that begin with a space."""
            out: list[bytes] = [b""] * len(pieces)
            words, others = [], []
            for i, x in enumerate(pieces):
                (words if x[:1] == " " and x[1:].isalpha() else others).append(i)
            for at in range(0, len(words), JOINED_PIECES):
                some = words[at : at + JOINED_PIECES]
                ids = np.array(tokenizer.encode_batch_fast(["".join([pieces[i] for i in some])], add_special_tokens=False)[0].ids, dtype)
                begins = np.flatnonzero(starts[ids]) * size
                data, begins = ids.tobytes(), [*begins.tolist(), len(ids) * size]
                for i, a, b in zip(some, begins[:-1], begins[1:], strict=True):
                    out[i] = data[a:b]
            for i, e in zip(others, tokenizer.encode_batch_fast([pieces[i] for i in others], add_special_tokens=False), strict=True):
                out[i] = common.packed(e.ids, dtype)
            return out

        _encoders[tokenizer_path, dtype] = PieceTable(encode_many, dtype, MEMO_ENTRIES)
    return _encoders[tokenizer_path, dtype]


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the ids of docs (doc_id, text) to folder in ascending doc_id order; return the manifest."""
    spark = docs.sparkSession
    common.ship(spark)
    dtype = dtype_for(load_tokenizer(tokenizer_path).get_vocab_size())
    docs = docs.select("doc_id", "text")
    n = common.parts_for(docs, PART_BYTES)
    bounds = common.id_bounds(docs, "doc_id", n)
    dealt = docs.withColumn("part", common.bucket_of(F.col("doc_id"), bounds)).repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "text")

    def write(batches):
        encoder, end = _encoder(tokenizer_path, dtype), common.packed([end_id], dtype)
        fs, root = common.filesystem(folder)
        fs.create_dir(root, recursive=True)
        part, ids, offsets, nulls = None, [], [0], 0

        def flow(out):
            nonlocal part, nulls
            for batch in common.slices(batches):
                part = batch.column("part")[0].as_py()
                ids.extend(x or 0 for x in batch.column("doc_id").to_pylist())
                nulls += batch.column("doc_id").null_count  # they come first
                for packed in encoder.encode(common.texts_of(batch)):
                    out.write(packed + end)
                    offsets.append(offsets[-1] + len(packed) // len(end) + 1)

        tmp = f"{root}/{os.getpid()}-{os.urandom(8).hex()}.tmp"
        with fs.open_output_stream(tmp, compression=None, buffer_size=1 << 20) as out:
            flow(out)
        if part is None:
            fs.delete_file(tmp)
            return
        common.write_atomically(fs, f"{root}/part-{part:05d}.index", lambda out: out.write(common.packed(offsets, "<i8") + common.packed(ids, "<i8")))
        fs.move(tmp, f"{root}/part-{part:05d}.tokens")
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [len(ids)], "n_null": [nulls], "n_tokens": [offsets[-1]]}, schema=common.schema_of(COUNTS))

    counts = sorted(dealt.mapInArrow(write, COUNTS).collect())  # one row per file
    rows, doc, token = [], 0, 0
    for part, n_docs, n_null, n_tokens in counts:
        rows.append((part, n_docs, n_null, n_tokens, doc, token))
        doc, token = doc + n_docs, token + n_tokens
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")


def mapped(fs: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """The file as an array: mapped into memory where the file system is local, else read whole (a part is bounded)."""
    if not fs.get_file_info(path).size:
        return np.zeros(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def read_token_files(spark: SparkSession, folder: str, tokenizer_path: str) -> DataFrame:
    """One row per document: its first token's place, its number of tokens and the CRC-32 of its ids as 32-bit integers."""
    common.ship(spark)
    dtype = dtype_for(load_tokenizer(tokenizer_path).get_vocab_size())
    manifest = read_manifest(spark, folder)
    n = max(1, manifest.count())

    def read(batches):
        fs, root = common.filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                index = mapped(fs, f"{root}/part-{row['part']:05d}.index", "<i8")
                offsets, ids = index[: row["n_docs"] + 1], index[row["n_docs"] + 1 :]
                tokens = mapped(fs, f"{root}/part-{row['part']:05d}.tokens", dtype)
                crc = [zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids.copy(), mask=np.arange(len(ids)) < row["n_null"]), pa.array(offsets[:-1] + row["first_token"]), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], schema=common.schema_of(READ))

    return manifest.repartitionByRange(n, "part").mapInArrow(read, READ)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, folder = public_tokenizers.path("byte_bpe_50k.json"), common.shared_path(spark, "token-files")
    write_token_files(common.table(spark, sf_dir, "documents"), folder, path, end_id=2)
    return read_token_files(spark, folder, path)
