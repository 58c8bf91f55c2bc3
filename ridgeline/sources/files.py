"""Readers of vector files and attribute files.

Vectors and lines are read by Spark's own file access, so that any store works, and decoded in Arrow blocks. Pools and
codes have records that no reader of Spark's splits at; tasks open them at their ranges through pyarrow's file systems.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce

#: Texts or codes whose offsets a task reads at once, and bytes of texts that it holds at once, but for one longer text.
RANGE_ROWS, RANGE_BYTES = 1 << 16, 8 << 20


class FormatError(ValueError):
    """A file that isn't what its format says."""


def _head(spark: SparkSession, path: str, n: int) -> tuple[bytes, int]:
    """First bytes and size of a file, without reading the rest of it."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    size = fs.getFileStatus(at).getLen()
    stream = fs.open(at)
    try:
        return bytes(stream.readNBytes(min(n, size))), size
    finally:
        stream.close()


def _placed(df: DataFrame) -> DataFrame:
    """df with id: a row's place in the file, from 0. Partitions hold parts of the file in order; their rows are counted first."""
    df = df.withColumn("at", F.monotonically_increasing_id())
    part, row = F.shiftright("at", 33).cast("int"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    if df.rdd.getNumPartitions() <= 1:
        return df.withColumn("id", row).drop("at")
    counts = sorted(df.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = dict(zip([r["part"] for r in counts], np.cumsum([0, *[r["n"] for r in counts]])[:-1].tolist(), strict=True))
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), part) if before else F.lit(0)
    return df.withColumn("id", row + offset).drop("at")


def _records(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(raw, id): records of a fixed size, cut by the JVM."""
    jvm = spark.sparkContext._jvm
    rows = spark.sparkContext._jsc.binaryRecords(path, size).rdd()
    return _placed(DataFrame(spark._jsparkSession.createDataset(rows, jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark).toDF("raw"))


def _vecs(spark: SparkSession, path: str, max_rows: int, code: str, kind: str) -> DataFrame:
    head, size = _head(spark, path, 4)
    dim = struct.unpack("<i", head)[0] if len(head) == 4 else 0
    if dim <= 0:
        raise FormatError(f"{path}: bad dimension {dim}")
    record = 4 + 4 * dim
    if size % record:
        raise FormatError(f"{path}: size {size} is no multiple of a record's {record} bytes")
    rows = _records(spark, path, record).select("id", "raw")
    if max_rows:
        rows = rows.filter(F.col("id") < max_rows)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4").reshape(-1, dim + 1)
            if (words[:, 0] != dim).any():
                raise FormatError(f"{path}: record {batch.column(0)[int(np.argmax(words[:, 0] != dim))]} has another dimension")
            values = pa.array(np.ascontiguousarray(words[:, 1:]).view(code).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * dim), values)], names=["id", "v"])

    return rows.mapInArrow(parse, f"id bigint, v array<{kind}>")


def read_fvecs(spark: SparkSession, path: str, max_rows: int = 0) -> DataFrame:
    """(id, v array<float>) of a file of records int32 dimension, float32 values, little endian; id is the record's place."""
    return _vecs(spark, path, max_rows, "<f4", "float")


def read_ivecs(spark: SparkSession, path: str, max_rows: int = 0) -> DataFrame:
    return _vecs(spark, path, max_rows, "<i4", "int")


def _lines(spark: SparkSession, path: str, skip: int, max_rows: int) -> DataFrame:
    """(id, line); lines end at line feeds only, and blank ones count."""
    rows = _placed(spark.read.option("lineSep", "\n").text(path).toDF("line"))
    rows = rows.filter(F.col("id") >= skip) if skip else rows
    rows = rows.filter(F.col("id") < skip + max_rows) if max_rows else rows
    return rows.select((F.col("id") - skip).alias("id"), "line")


def load_jsonl_columns(spark: SparkSession, path: str, columns: Sequence[tuple[str, str]], max_rows: int = 0) -> DataFrame:
    """id and the declared (field, "numeric" or "categorical") columns of a file of one JSON object a line.

    Categorical fields give the text in their column and the dictionary's code in <field>_code. Missing fields count as null.
    """
    rows = _lines(spark, path, 0, max_rows)
    value = {f: coerce.json_field(F.col("line"), f) for f, _ in columns}
    out = rows.select("id", *[(coerce.as_number(value[f]) if kind == "numeric" else coerce.as_category(value[f])).alias(f) for f, kind in columns])
    return _coded(out, columns)


def load_csv_columns(spark: SparkSession, path: str, columns: Sequence[tuple[str, str]], max_rows: int = 0) -> DataFrame:
    """The same of a CSV file: columns by the header's names, cut at every comma, no quoting; only the header loses a CR."""
    names = header(spark, path)
    rows = _lines(spark, path, 1, max_rows).withColumn("cells", F.split("line", ",", -1))
    cell = lambda f: F.coalesce(F.get("cells", F.lit(names.index(f))), F.lit("")) if f in names else F.lit("")
    out = rows.select("id", *[(coerce.csv_number(cell(f)) if kind == "numeric" else coerce.csv_category(cell(f))).alias(f) for f, kind in columns])
    return _coded(out, columns)


def header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.option("lineSep", "\n").text(path).first()
    return first[0].rstrip("\r").split(",") if first else []


def auto_columns(spark: SparkSession, path: str, kind: str = "numeric") -> list[tuple[str, str]]:
    """Every column of a CSV header, with one kind."""
    return [(name, kind) for name in header(spark, path)]


def _coded(df: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    for f, kind in columns:
        if kind != "numeric":
            df = coerce.dict_encode(df, f, f"{f}_code")
    return df


def _opener(path: str) -> Callable[[], pa.NativeFile]:
    """Opens the file in a task, by URI or local path."""

    def open_file():
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        return system.open_input_file(at)

    return open_file


def _ranges(spark: SparkSession, rows: int) -> DataFrame:
    """(first, last): ranges of rows, each for one task at a time."""
    return spark.range(0, max(1, -(-rows // RANGE_ROWS)), 1, max(1, min(1024, -(-rows // RANGE_ROWS)))).select((F.col("id") * RANGE_ROWS).alias("first"), F.least((F.col("id") + 1) * RANGE_ROWS, F.lit(rows)).alias("last"))


def read_text_pool(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """(id, text) of a pool: uint64 n, uint64 offsets[n + 1], bytes. The driver reads n and the last offset; every task opens
    the file, reads the offsets of its rows and their texts, a bounded number of bytes at a time."""
    open_file = _opener(path)
    with open_file() as f:
        size = f.size()
        n = struct.unpack("<Q", f.read(8))[0] if size >= 8 else 0
        if n < rows:
            raise FormatError(f"{path}: {n} texts, {rows} rows")
        start = 8 + 8 * (n + 1)
        if size < start:
            raise FormatError(f"{path}: truncated")
        f.seek(8 + 8 * n)
        if start + struct.unpack("<Q", f.read(8))[0] > size:
            raise FormatError(f"{path}: truncated")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open_file() as f:
            for first, last in (r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns], strict=True)):
                f.seek(8 + 8 * first)
                offsets = np.frombuffer(f.read(8 * (last - first + 1)), "<u8").astype(np.int64)
                if (np.diff(offsets) < 0).any() or (len(offsets) and start + int(offsets[-1]) > size):
                    raise FormatError(f"{path}: offsets are out of order")
                at = 0
                while at < last - first:
                    upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + RANGE_BYTES, "right")) - 1)
                    upto = min(upto, last - first)
                    f.seek(start + int(offsets[at]))
                    body, of = f.read(int(offsets[upto] - offsets[at])), (offsets[at : upto + 1] - offsets[at]).tolist()
                    texts = [body[x:y].decode("utf-8", "replace") for x, y in zip(of[:-1], of[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + at, first + upto)), pa.array(texts, pa.string())], names=["id", "text"])
                    at = upto

    return _ranges(spark, rows).mapInArrow(cut, "id bigint, text string")


def read_codes(spark: SparkSession, path: str, rows: int = 0) -> DataFrame:
    """(id, code double) of a file of little-endian uint16 codes, of which every task reads its range."""
    open_file = _opener(path)
    with open_file() as f:
        size = f.size()
    if size % 2 or (rows and size < 2 * rows):
        raise FormatError(f"{path}: {size} bytes for {rows} codes")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open_file() as f:
            for first, last in (r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns], strict=True)):
                f.seek(2 * first)
                codes = np.frombuffer(f.read(2 * (last - first)), "<u2")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, last)), pa.array(codes.astype(np.float64))], names=["id", "code"])

    return _ranges(spark, rows or size // 2).mapInArrow(cut, "id bigint, code double")


def record(vector: Sequence[float]) -> bytes:
    """One fvecs record."""
    return struct.pack(f"<i{len(vector)}f", len(vector), *vector)


def sample_queries(base: DataFrame, n: int = 200, seed: int = 42) -> DataFrame:
    """(qid, qvec): n rows of base(id, v) chosen by a seeded hash of the id, numbered in order of id."""
    chosen = base.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n)
    return chosen.select(F.col("id").alias("qid"), F.col("v").alias("qvec"))
