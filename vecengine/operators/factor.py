"""Distributed reductions of a vector table: moments, products and block maps. The driver sees d x d or d x k numbers only."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import PythonException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecengine.functions import blocks


def _merge_moments(a: tuple, b: tuple) -> tuple:
    """Pairwise update of (n, mean, centred product): no cancellation, any order."""
    n, delta = a[0] + b[0], b[1] - a[1]
    if not n:
        return a
    return n, a[1] + delta * (b[0] / n), a[2] + b[2] + np.outer(delta, delta) * (a[0] * b[0] / n)


def _alike(merge: Callable) -> Callable:
    """merge, for states of one shape only: arrays of unlike lengths could be stretched to each other."""

    def merged(a: tuple, b: tuple) -> tuple:
        if [np.shape(x) for x in a] != [np.shape(x) for x in b]:
            raise ValueError("vectors must all have one length")
        return merge(a, b)

    return merged


#: Partitions' states that the driver merges itself; states of one task of each level beyond that.
FEW, TASKS = 64, (256, 8)
#: Input bytes that surely make no more than FEW partitions.
SMALL_BYTES = 1 << 30


def _merged(states: Iterable[tuple], merge: Callable):
    state = None
    for new in states:
        state = new if state is None else merge(state, new)
    return state


def _reduced(df: DataFrame, columns: list[str], first: Callable, merge: Callable, alike: bool = True):
    """Reduce per-partition arrays: once per partition, then over two levels of partition numbers on executors, a state at a time, then on the driver.

    alike: states of unlike shapes raise. A table that is small by the optimizer's estimate has few partitions, whose states go to the driver at once.
    """

    def partial(batches):
        state = None
        for batch in batches:
            if batch.num_rows:
                new = first(*[batch.column(i) for i in range(len(columns))])
                state = new if state is None else merge(state, new)
        if state is not None:
            yield _packed(TaskContext.get().partitionId(), state)

    def again(batches):
        number, state = None, None
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                number, new = i if number is None else number, _unpacked(data.as_py())
                state = new if state is None else merge(state, new)
        if state is not None:
            yield _packed(number, state)

    spark, merge = df.sparkSession, _alike(merge) if alike else merge
    parts = df.select(*columns).mapInArrow(partial, "part int, state binary")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SMALL_BYTES or int(spark.conf.get("spark.sql.shuffle.partitions")) > FEW:
        for n in TASKS:
            parts = parts.repartitionById(n, F.pmod("part", F.lit(n))).sortWithinPartitions("part").mapInArrow(again, "part int, state binary")
    try:
        rows = parts.collect()
    except PythonException as e:
        if said := re.search(r"^ValueError: (.*)", str(e), re.M):
            raise ValueError(said[1]) from e
        raise
    return _merged((_unpacked(bytes(r["state"])) for r in sorted(rows, key=lambda r: r["part"])), merge)


def _packed(part: int, state: tuple) -> pa.RecordBatch:
    import pickle

    return pa.RecordBatch.from_pydict({"part": [part], "state": [pickle.dumps(tuple(np.asarray(x) for x in state), 5)]}, schema=pa.schema([("part", pa.int32()), ("state", pa.binary())]))


def _unpacked(data: bytes) -> tuple:
    import pickle

    return pickle.loads(data)


def moments(df: DataFrame, features_col: str, centred: bool = True) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, sum of centred outer products) in one pass; with centred=False mean is 0 and the products are plain."""

    def first(column) -> tuple:
        x = blocks.vectors(column)
        mean = x.mean(axis=0) if centred else np.zeros(x.shape[1])
        y = x - mean
        return len(x), mean, y.T @ y

    merge = _merge_moments if centred else (lambda a, b: (a[0] + b[0], a[1], a[2] + b[2]))
    state = _reduced(df, [features_col], first, merge)
    if state is None:
        raise ValueError("there are no rows")
    return int(state[0]), state[1], state[2]


def moments_by(df: DataFrame, by: str, features_col: str, finish: Callable, ddl: str, centred: bool = True) -> DataFrame:
    """(by, columns of ddl): finish(n, mean, products), a dict, for each group: groups are summed up in each partition, so no task holds a group's rows."""

    def partial(batches):
        states: dict = {}
        for batch in batches:
            keys = batch.column(0).dictionary_encode()
            codes, x = keys.indices.to_numpy(zero_copy_only=False), blocks.vectors(batch.column(1))
            for i, key in enumerate(keys.dictionary.to_pylist()):
                y = x[codes == i]
                mean = y.mean(axis=0) if centred else np.zeros(y.shape[1])
                new = len(y), mean, (y - mean).T @ (y - mean)
                states[key] = merge(states[key], new) if key in states else new
        if states:
            yield pa.RecordBatch.from_arrays([pa.array(list(states), batch.schema.field(0).type), pa.array([_packed(0, s).column(1)[0].as_py() for s in states.values()], pa.binary())], names=[by, "state"])

    def whole(table: pa.Table) -> pa.Table:
        n, mean, products = _merged(map(_unpacked, sorted(table.column("state").to_pylist())), merge)
        return pa.table({by: table.column(by)[:1], **finish(int(n), mean, products)})

    merge = _alike(_merge_moments if centred else (lambda a, b: (a[0] + b[0], a[1], a[2] + b[2])))
    kind = df.schema[by].dataType.simpleString()
    parts = df.where(F.col(by).isNotNull()).select(by, features_col).mapInArrow(partial, f"{by} {kind}, state binary")
    return parts.groupBy(by).applyInArrow(lambda t: whole(t), f"{by} {kind}, {ddl}")


def summed(df: DataFrame, columns: list[str], first: Callable) -> tuple:
    """Sums of the arrays that first makes of each block."""
    return _reduced(df, columns, first, lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True)))


def mapped(df: DataFrame, features_col: str, output_col: str, fn: Callable[[np.ndarray], np.ndarray], scores: int = 0) -> DataFrame:
    """df with output_col: fn of the block of vectors, (rows, k). scores: columns of fn's largest intermediate, which bounds the block."""
    from vecengine.plans import strategy

    step = strategy.batch_rows(scores) if scores else 1 << 14

    def run(column: pa.Array) -> pa.Array:
        parts = [blocks.as_vectors(fn(blocks.vectors(column.slice(i, step)))) for i in range(0, len(column), step)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))

    return df.withColumn(output_col, F.arrow_udf(run, "array<double>")(F.col(features_col)))


def signed(rows: np.ndarray) -> np.ndarray:
    """+1 or -1 for each row, so that its element of largest size is positive."""
    at = np.argmax(np.abs(rows), axis=1)
    return np.where(rows[np.arange(len(rows)), at] < 0, -1.0, 1.0)
