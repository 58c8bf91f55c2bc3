"""Sessions: a local one for tests and benchmarks, and what any session needs before Python functions run in it."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ready(spark: SparkSession) -> SparkSession:
    """Lets this session's Python workers import the package from where the driver has it, and take one core each.

    Workers run as many at a time as there are cores, so threads of a matrix product would only wait for each other."""
    env = spark.sparkContext.environment
    env["OPENBLAS_NUM_THREADS"] = "1"
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g", name: str = "ridgeline") -> SparkSession:
    return ready(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local one only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or "/tmp/checkpoints/ridgeline").rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The part of the shared folder that this application writes to."""
    return f"{shared_dir(spark)}/ridgeline-{spark.sparkContext.applicationId}"


#: What is made once for an application and used by several queries, by key.
_KEPT: dict[tuple, object] = {}


def once(spark: SparkSession, key: tuple, make):
    """What make() gives, made once for the application and key: an index is built once and searched often."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def stamp(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files under a path: another table has another stamp."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in (fs.listStatus(at) if fs.exists(at) else ()))


def sweep(spark: SparkSession) -> None:
    """Removes all settled tables of this application. Results that weren't read or written yet are lost with them."""
    _KEPT.clear()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def settle(df: DataFrame) -> DataFrame:
    """Writes df into the shared folder and reads it back: short lineage that survives a lost executor."""
    path = f"{own_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
