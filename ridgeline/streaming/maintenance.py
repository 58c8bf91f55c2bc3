"""Maintenance of statistics from streams of changes, one micro-batch after the other."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.maintain import State
from ..operators.stats import Schema, Stats

_TABLES = [f.name for f in fields(Stats) if f.name not in ("schema", "degraded")]


def save_state(state: State, folder: str, number: int) -> None:
    """Writes a state under its batch's number. The file that says what is there comes last, so a half-written state is none."""
    spark = state.trees.sparkSession
    tables = {name: df for name in _TABLES if (df := getattr(state.stats, name)) is not None} | {"trees": state.trees}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/batch={number}/{name}")
    told = {"number": number, "tables": sorted(tables), "edges": state.stats.schema.edges, "categorical": state.stats.schema.categorical, "degraded": sorted(state.stats.degraded)}
    spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/done/{number}")


def load_state(spark: SparkSession, folder: str) -> tuple[State, int] | None:
    """The last state that was written whole, and its batch's number; None if there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/done")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath() for f in fs.listStatus(at)] if fs.exists(at) else []
    whole = [int(f.getName()) for f in found if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
    if not whole:
        return None
    number = max(whole)
    told = json.loads(spark.read.text(f"{folder}/done/{number}").first()[0])
    held = {name: spark.read.parquet(f"{folder}/batch={number}/{name}") if name in told["tables"] else None for name in (*_TABLES, "trees")}
    trees = held.pop("trees")
    return State(Stats(Schema(told["edges"], tuple(told["categorical"])), **held, degraded=frozenset(told["degraded"])), trees), number


class Maintainer:
    """Holds the state between micro-batches. apply takes (state, batch) and gives the next state.

    A batch that is delivered again after a failure is recognised by its number and applied once. With a folder, which should
    live as long as the stream's checkpoint, the state after each batch is written there with the batch's number and found
    again by the next run; without one a restarted stream must start from a state that holds all that its checkpoint skips."""

    def __init__(self, state: State, apply: Callable[[State, DataFrame], State], folder: str | None = None):
        self.state, self.apply, self.done, self.folder = state, apply, -1, folder and folder.rstrip("/")
        if self.folder and (held := load_state(state.trees.sparkSession, self.folder)):
            self.state, self.done = held

    def __call__(self, batch: DataFrame, number: int) -> None:
        if number > self.done:
            if not batch.isEmpty():
                self.state = self.apply(self.state, batch)
                if self.folder:
                    save_state(self.state, self.folder, number)
                    self.state, _ = load_state(batch.sparkSession, self.folder)
            self.done = number


def maintain_from(stream: DataFrame, maintainer: Maintainer, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(maintainer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
