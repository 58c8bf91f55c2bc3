"""Helpers that the corpus operators share: settling frames, Arrow maps and table readers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.small_world import pack, unpack  # noqa: F401
from ..session import ready, settle  # noqa: F401

#: Rows that Python code takes from an Arrow batch at once, so that its lists stay small.
SLICE_ROWS = 256
#: Bytes of an Arrow batch between Spark and a Python worker: both sides hold one or two at a time.
BATCH_BYTES = "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """Maps slices of rows, as dicts of Python lists, with the function that make() builds once in each task.

    Sets the session's bound on the bytes of an Arrow batch, so that memory follows neither the rows nor their lengths."""
    ready(df.sparkSession).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    out = to_arrow(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                cols = work(batch.slice(at, SLICE_ROWS).to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def to_arrow(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl), prefers_large_types=False)


def key_crc(col: str) -> F.Column:
    return F.crc32(F.col(col).cast("string"))


def usable(vec: F.Column) -> F.Column:
    """Whether an array<double> has only finite components, and one that isn't zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vec, finite) & F.exists(vec, lambda x: x != 0), F.lit(False))


def dense(column: pa.ChunkedArray):
    """Equally long lists of numbers as a matrix."""
    import numpy as np

    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def unit(x):
    """Rows scaled to length one in double precision, without overflow."""
    import numpy as np

    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sharded(rows: DataFrame, keys: list[str], id_col: str, size: int) -> DataFrame:
    """rows with shards (how many their keys have, of about size rows each) and shard (from 0, by a hash of the id)."""
    counts = settle(rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias("shards")))
    return rows.join(counts, keys).withColumn("shard", F.pmod(F.xxhash64(id_col), F.col("shards")).cast("int"))
