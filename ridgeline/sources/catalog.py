"""Datasets by name: their files and columns in a TOML file, loaded as one base table and one query table."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files


@dataclass(frozen=True)
class Dataset:
    """base: id, v and a column for each attribute; queries: qid, qvec; categorical: names of the columns of codes."""

    base: DataFrame
    queries: DataFrame
    categorical: tuple[str, ...]
    texts: tuple[str, ...]


def root(start: str, marker: str = "configs/datasets.toml") -> str:
    """The nearest folder from start upwards that holds the marker."""
    at = Path(start).resolve()
    for folder in (at, *at.parents):
        if (folder / marker).exists():
            return str(folder)
    raise FileNotFoundError(f"no {marker} above {start}")


def entries(toml_text: str) -> dict[str, dict]:
    return {d["id"]: d for d in tomllib.loads(toml_text).get("dataset", [])}


def load(spark: SparkSession, entry: dict, folder: str, *, max_base: int = 0, max_queries: int = 0, text_pool: tuple[str, str] | None = None, code_file: tuple[str, str] | None = None) -> Dataset:
    """Loads a catalogue entry. Keys: base, query; attributes with columns [{field, type}] or auto_columns; text_pool and
    text_name; code_file and code_name. The two arguments of those names override the entry's. Vectors of base and queries
    must be equally long; attributes are joined to vectors by row number.
    """
    at = lambda name: name if "://" in name or name.startswith("/") else f"{folder}/{name}"
    base = files.read_fvecs(spark, at(entry["base"]), max_base)
    queries = files.read_fvecs(spark, at(entry["query"]), max_queries)
    dims = [df.select(F.size("v")).first() for df in (base, queries)]
    if all(dims) and dims[0] != dims[1]:
        raise files.FormatError(f"base has dimension {dims[0][0]}, queries {dims[1][0]}")
    rows, categorical, texts = base.count(), [], []
    if path := entry.get("attributes"):
        csv = path.endswith(".csv")
        columns = [(c["field"], c.get("type", "numeric")) for c in entry.get("columns", [])]
        if not columns and entry.get("auto_columns"):
            columns = files.auto_columns(spark, at(path), entry.get("auto_type", "numeric"))
        read = files.load_csv_columns if csv else files.load_jsonl_columns
        base = base.join(read(spark, at(path), columns, rows), "id", "left")
        categorical += [f"{f}_code" for f, kind in columns if kind != "numeric"]
    pool = text_pool or ((entry["text_pool"], entry.get("text_name", "text")) if "text_pool" in entry else None)
    if pool:
        base = base.join(files.read_text_pool(spark, at(pool[0]), rows).withColumnRenamed("text", pool[1]), "id", "left")
        texts.append(pool[1])
    codes = code_file or ((entry["code_file"], entry.get("code_name", "code")) if "code_file" in entry else None)
    if codes:
        base = base.join(files.read_codes(spark, at(codes[0]), rows).withColumnRenamed("code", codes[1]), "id", "left")
        categorical.append(codes[1])
    return Dataset(base, queries.select(F.col("id").alias("qid"), F.col("v").alias("qvec")), tuple(categorical), tuple(texts))
