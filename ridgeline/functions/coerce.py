"""Coercions of loaded attributes: JSON and CSV values to numbers and categories, and dictionary codes."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle

NULL_CATEGORY, OTHER_CATEGORY = "<null>", "<other>"


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _is_number(kind: Column) -> Column:
    return kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")


def json_field(json: Column, field: str) -> Column:
    """The value of a field of that very name: dots and brackets in it are no path."""
    quote = "'" if "'" not in field else '"'
    if quote in field:
        raise ValueError("a field's name holds both kinds of quotes")
    return F.variant_get(F.try_parse_json(json), f"$[{quote}{field}{quote}]", "variant")


def as_number(v: Column) -> Column:
    """A variant as number: numbers as they are, booleans 1 or 0, anything else 0 (numeric strings too)."""
    kind = _kind(v)
    number = F.try_variant_get(v, "$", "double")
    return F.coalesce(F.when(_is_number(kind), number).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")), F.lit(0.0))


def as_category(v: Column) -> Column:
    """A variant as category: null or missing <null>, strings and booleans as text, numbers cut to whole ones, arrays by
    their first element, which may be an array again, however deep, else (objects, empty arrays) <other>."""
    # An array's text starts with as many brackets as first elements are arrays.
    path = F.concat(F.lit("$"), F.repeat(F.lit("[0]"), F.length(F.regexp_extract(F.to_json(v), r"^\[+", 0))))
    inner = F.try_variant_get(v, path, "variant")
    return F.when(_kind(v).startswith("ARRAY"), F.when(inner.isNull(), F.lit(OTHER_CATEGORY)).otherwise(_scalar_category(inner))).otherwise(_scalar_category(v))


def _scalar_category(v: Column) -> Column:
    kind = _kind(v)
    whole = F.try_variant_get(v, "$", "double")
    return (
        F.when(v.isNull() | (kind == "VOID"), F.lit(NULL_CATEGORY))
        .when(kind == "STRING", F.try_variant_get(v, "$", "string"))
        .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("string"))
        .when(_is_number(kind), F.coalesce(F.try_variant_get(v, "$", "bigint"), whole.cast("bigint")).cast("string"))
        .otherwise(F.lit(OTHER_CATEGORY))
    )


def csv_number(text: Column) -> Column:
    """The longest numeric prefix, as C's strtod reads it (nan and inf too); none: 0."""
    bare = F.ltrim(text)
    number = F.regexp_extract(bare, r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    special = F.lower(F.regexp_extract(bare, r"^([+-]?(?:[nN][aA][nN]|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?))", 1))
    named = F.when(special.endswith("nan"), F.lit(float("nan"))).when(special.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(special != "", named).otherwise(F.coalesce(number.try_cast("double"), F.lit(0.0)))


def csv_category(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(NULL_CATEGORY)).otherwise(text)


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, code) with codes 0.. in byte order of the distinct values of a category column.

    Values are ranked within ranges, to which the counts of the ranges before are added, so no task holds all of them."""
    values = df.select(F.coalesce(F.col(column), F.lit(NULL_CATEGORY)).alias("value")).distinct()
    ranged = settle(values.repartitionByRange("value").sortWithinPartitions("value").withColumn("at", F.monotonically_increasing_id()))
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect(), key=lambda r: r["part"])
    before = list(accumulate((r["n"] for r in counts), initial=0))
    offset = F.element_at(F.create_map(*[F.lit(x) for r, n in zip(counts, before, strict=False) for x in (r["part"], n)]), part) if counts else F.lit(0)
    return ranged.select("value", (row + offset).cast("double").alias("code"))


def dict_encode(df: DataFrame, column: str, into: str) -> DataFrame:
    """df with the code of its category; the dictionary is as long as the column has values."""
    codes = dictionary(df, column).select(F.col("value").alias("__value"), F.col("code").alias(into))
    return df.join(codes, F.coalesce(F.col(column), F.lit(NULL_CATEGORY)) == F.col("__value")).drop("__value")


def quad_words(cluster: Column) -> Column:
    """Four words for a cluster id: its base-6 digits, from the lowest, each in a range of its own."""
    return F.array(*[(F.pmod(F.floor(cluster / F.lit(6**k)), F.lit(6)) + 6 * k).cast("int") for k in range(4)])


def fingerprint(df: DataFrame, *columns: str) -> int:
    """A number that depends on the values of all rows but not on their order."""
    row = df.agg(F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(20,0)")), F.lit(0)), F.count("*")).first()
    return (int(row[0]) * 1_000_003 + int(row[1])) % (1 << 63)
