"""Two tables of vectors against each other in blocks: one side whole on every worker where it fits, else streamed past groups of the other on the executors."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecengine.functions import blocks
from vecengine.plans import strategy

#: Rows of x and of y that meet in one block; bytes of x whose rows see y stream by in one task.
TILE, OTHERS, GROUP_BYTES = 512, 1024, 64 << 20


def gathered(df: DataFrame, id_col: str, features_col: str, limit: int = strategy.BROADCAST_BYTES) -> tuple[list, np.ndarray]:
    """Ids and vectors of a side that is small by a check of its size, in id order."""
    n, d = strategy.shape(df, features_col)
    if not strategy.fits(n, d, limit):
        raise ValueError(f"{n} vectors of {d} elements don't fit {limit} bytes")
    table = df.select(F.col(id_col).alias("id"), F.col(features_col).alias("x")).toArrow().sort_by("id")
    return table.column("id").to_pylist(), blocks.vectors(table.column("x"), d) if n else np.zeros((0, d))


def _tiles(ids: pa.Array, column: pa.Array, d: int, rows: int) -> list[tuple[pa.Array, np.ndarray]]:
    return [(ids.slice(i, rows), blocks.vectors(column.slice(i, rows), d)) for i in range(0, len(ids), rows)]


def _streamed(x: DataFrame, y: DataFrame, fn: Callable, ddl: str, id_col: str, features_col: str, limit: int) -> DataFrame:
    """fn(tiles of x, iterator over blocks of y), both (ids, vectors): each row of x is in one call, which sees all of y, a block at a time.

    y within limit goes whole to the workers. Beyond it groups of rows of x are partitions to which y is sent as plain rows: it is shuffled
    once for each group, and a task holds its group alone. The driver sees neither side.
    """
    n, d = strategy.shape(y, features_col)
    context = x.sparkSession.sparkContext
    if strategy.fits(n, d, limit):
        ids, vectors = gathered(y, id_col, features_col, limit)
        sent = context.broadcast((pa.array(ids, _kind(y, id_col)), vectors))

        def run(batches):
            for batch in batches:
                ids, vectors = sent.value
                others = ((ids.slice(i, OTHERS), vectors[i : i + OTHERS]) for i in range(0, len(ids), OTHERS))
                yield from fn(_tiles(batch.column(0), batch.column(1), d, TILE), others)

        x = x.select(id_col, features_col)
        return (x.repartition(4 * context.defaultParallelism) if n > OTHERS else x).mapInArrow(run, ddl)

    rows = n if x is y else x.count()
    groups = max(context.defaultParallelism, -(-8 * rows * d // GROUP_BYTES))
    i_kind, j_kind = (t.schema[id_col].dataType.simpleString() for t in (x, y))
    vector = F.col(features_col).cast("array<double>").alias("v")
    own = x.repartition(groups).select(F.spark_partition_id().alias("g"), F.lit(0).alias("side"), F.col(id_col).alias("i"), F.lit(None).cast(j_kind).alias("j"), vector)
    all_y = y.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("side"), F.lit(None).cast(i_kind).alias("i"), F.col(id_col).alias("j"), vector)
    both = own.unionByName(all_y).repartitionById(groups, F.col("g")).sortWithinPartitions("g", "side")

    def run_groups(batches):
        tiles, batches = [], iter(batches)

        def others():
            for batch in batches:
                at = int((batch.column(1).to_numpy() == 0).sum())  # rows of x come first
                tiles.extend(_tiles(batch.column(2).slice(0, at), batch.column(4).slice(0, at), d, TILE))
                yield from _tiles(batch.column(3).slice(at), batch.column(4).slice(at), d, OTHERS)

        found = others()
        first = next(found, None)  # by now all of x is in tiles
        if first is not None and tiles:
            yield from fn(tiles, itertools.chain([first], found))

    return both.mapInArrow(run_groups, ddl)


def _kind(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def met(x: DataFrame, y: DataFrame, fn: Callable[[pa.Array, np.ndarray, pa.Array, np.ndarray], pa.RecordBatch], ddl: str, id_col: str, features_col: str, limit: int = strategy.BROADCAST_BYTES) -> DataFrame:
    """fn(ids of x, vectors of x, ids of y, vectors of y) for blocks that together meet all of x with all of y."""

    def run(tiles, others):
        for ids, vectors in others:
            for own, xs in tiles:
                yield fn(own, xs, ids, vectors)

    return _streamed(x, y, run, ddl, id_col, features_col, limit)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero, without a negative zero."""
    scaled = x * 10.0**digits
    whole = np.trunc(scaled)
    whole += np.where(np.abs(scaled - whole) >= 0.5, np.sign(scaled), 0.0)
    whole /= 10.0**digits
    whole += 0.0
    return whole


def entries(own: pa.Array, ids: pa.Array, block: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """A row (id of x, id of y, value) for each element of a block."""
    n, m = block.shape
    i, j = own.take(pa.array(np.repeat(np.arange(n), m))), pa.concat_arrays([ids] * n) if n else ids.slice(0, 0)
    return pa.RecordBatch.from_arrays([i, j, pa.array(block.reshape(-1))], names=names)


def swept(x: DataFrame, y: DataFrame, start: Callable, step: Callable, finish: Callable, ddl: str, id_col: str, features_col: str, limit: int = strategy.BROADCAST_BYTES) -> DataFrame:
    """One result for each block of x, from all of y: state = start(ids, vectors), step(state, ids, vectors, ids of y, vectors of y), then finish(state, ids, vectors)."""

    def run(tiles, others):
        states = [start(*tile) for tile in tiles]
        for block in others:
            for state, tile in zip(states, tiles, strict=True):
                step(state, *tile, *block)
        for state, tile in zip(states, tiles, strict=True):
            yield finish(state, *tile)

    return _streamed(x, y, run, ddl, id_col, features_col, limit)
