"""String collections: (idx BIGINT, s STRING), the position being a string's identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Keys in a block of the two-step running sums.
KEY_BLOCK = 1 << 16


def _files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.option("wholetext", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(F.col("_metadata.file_name").alias("file"), "value")


def is_string_array(value: str) -> Column:
    """Whether a column of texts holds a JSON array of nothing but strings: a plain cast would turn numbers, nulls and objects into text."""
    kinds = F.transform(F.expr(f"try_variant_get(try_parse_json({value}), '$', 'array<variant>')"), F.schema_of_variant)
    good = F.startswith(F.schema_of_variant(F.try_parse_json(value)), F.lit("ARRAY")) & F.forall(kinds, lambda k: k == "STRING")
    return F.coalesce(good, F.lit(False))


def parse_arrays(texts: DataFrame) -> DataFrame:
    """(file, idx, s) of JSON arrays of strings (file, value).

    Fails the job on a text that isn't an array and on an element that isn't a
    string.
    """
    message = F.concat(F.lit("not an array of strings: "), "file")
    checked = F.when(is_string_array("value"), F.from_json("value", "array<string>")).otherwise(F.raise_error(message).cast("array<string>"))
    return texts.select("file", F.posexplode(checked).alias("idx", "s")).select("file", F.col("idx").cast("long").alias("idx"), "s")


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array of strings: (idx, s). Elements that aren't strings, nulls among them, raise when the rows are read."""
    return parse_arrays(_files(spark, path)).select("idx", "s")


def load_json_directory(spark: SparkSession, path: str) -> DataFrame:
    """Every *.json file of a directory, not recursively: (dataset_name, idx, s)."""
    return parse_arrays(_files(spark, path, "*.json")).select(F.regexp_replace("file", r"\.json$", "").alias("dataset_name"), "idx", "s")


def strings_of(df: DataFrame, text: str, *key: str) -> DataFrame:
    """A string column as a collection: idx counts the rows from 0 in order of the key, the first of whose columns is an integer.

    Nulls are left out. The count runs in two steps - over blocks of keys, then
    within each - so that no task sees all the rows.
    """
    rows = df.where(F.col(text).isNotNull()).select(*key, F.col(text).alias("s")).withColumn("_block", F.floor(F.col(key[0]) / KEY_BLOCK))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_block").agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(*key)) - 1
    return rows.join(starts, "_block").select((F.col("_before") + inside).alias("idx"), "s", *key)
