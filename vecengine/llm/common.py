"""What the text operators share: tables, the shared folder, order-preserving partitions and batch mapping.

Nothing here keeps rows on the driver beyond one row per partition, and every file goes to the folder
that the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one step of a batch function sees at once, and bytes where there is more than one row.
SLICE_ROWS, SLICE_BYTES = 512, 16 << 20
#: Partitions and files of one step at most: beyond it they get larger, so that no plan, task list or driver grows with the corpus.
MOST_PARTS = 1 << 15
#: Estimates from here on mean that the optimizer doesn't know.
UNKNOWN_BYTES = 1 << 52
_shipped: set[str] = set()
_tenant: list = [None, None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors that don't have it on their path."""
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    at_hand = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if app in _shipped or any(x and Path(x).resolve() == root for x in at_hand):
        return
    archive = Path(tempfile.mkdtemp()) / "vecengine_src.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((root / "vecengine").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def claim(name: str, forget: Callable[[], None]) -> None:
    """Say that this worker's large memo is now name's: the one before is dropped, so that a worker holds one at a time."""
    if _tenant[0] != name:
        if _tenant[1] is not None:
            _tenant[1]()
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):  # not every C library can give memory back
                ctypes.CDLL(None).malloc_trim(0)
        _tenant[:] = [name, forget]


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where all run in one process it may be unset, and is set to one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/vecengine-shared"
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base if "://" in base or base.startswith("file:") else f"file://{os.path.abspath(base)}"


def application_folder(spark: SparkSession) -> str:
    """The part of the shared folder that holds what this application writes there."""
    return f"{shared_base(spark).rstrip('/')}/vecengine-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Remove all that this application has in the shared folder. Results that weren't saved elsewhere can't be computed after this."""
    fs, path = filesystem(application_folder(spark))
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a shared-folder URI, on the driver or an executor."""
    fs, path = pafs.FileSystem.from_uri(uri if not uri.startswith("file:/") or uri.startswith("file://") else uri.replace("file:", "file://", 1))
    return fs, path


def write_atomically(fs: pafs.FileSystem, path: str, write: Callable) -> None:
    """Write beside the place and move there: a lost or repeated attempt leaves a whole file or none."""
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(tmp, compression=None) as out:
        write(out)
    fs.move(tmp, path)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size (from file sizes; no job)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(df: DataFrame, bytes_each: int) -> int:
    """Partitions so that each holds about bytes_each of df, at least the session's shuffle partitions."""
    least, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), plan_bytes(df)
    if size >= UNKNOWN_BYTES:  # rows that don't come from files: measure them
        lengths = [F.coalesce(F.octet_length(k), F.lit(0)) for k, kind in df.dtypes if kind in ("string", "binary")]
        size = df.agg(F.sum(sum(lengths, F.lit(16)).cast("long"))).first()[0] or 0
    return max(least, min(MOST_PARTS, -(-size // bytes_each)))


def id_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n-1 ascending values of key that cut it into n ranges of like row counts; each is a value that occurs."""
    if n < 2:
        return []
    cuts = df.select(F.percentile_approx(key, [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("c")).first()["c"]
    return sorted(set(cuts or []))


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at or below key (null: 0), by a two-level search."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    at = F.size(F.filter(F.lit([b[0] for b in blocks]), lambda b: b <= key))
    inner = F.size(F.filter(F.element_at(F.lit(blocks), F.greatest(at, F.lit(1))), lambda b: b <= key))
    return F.when(key.isNull() | (at == 0), F.lit(0)).otherwise((at - 1) * step + inner).cast("int")


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in stretches of at most so many rows, and of SLICE_BYTES where they have more than one."""

    def halved(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if part.num_rows > 1 and part.nbytes > SLICE_BYTES:
            half = part.num_rows // 2
            yield from halved(part.slice(0, half))
            yield from halved(part.slice(half))
        else:
            yield part

    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield from halved(batch.slice(i, rows))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def schema_of(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([pa.field(k, kinds[v]) for k, v in (x.strip().split(" ", 1) for x in ddl.split(","))])


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], ddl: str, rows: int = SLICE_ROWS) -> DataFrame:
    """df with fn applied to slices of its Arrow batches; fn returns a dict of columns."""
    ship(df.sparkSession)

    def run(batches):
        schema = schema_of(ddl)
        for part in slices(batches, rows):
            yield pa.RecordBatch.from_pydict(fn(part), schema=schema)

    return df.mapInArrow(run, ddl)


def packed(ids: list[int], dtype: str) -> bytes:
    return np.array(ids, dtype=dtype).tobytes()
