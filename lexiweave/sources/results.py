"""Measurements of codecs: read, append, reset, export."""

from __future__ import annotations

import json
import sys

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("dataset_name", T.StringType()),
    T.StructField("compressor_name", T.StringType()),
    T.StructField("compression_rate", T.DoubleType()),
    T.StructField("compression_speed", T.DoubleType()),
    T.StructField("decompression_speed", T.DoubleType()),
    T.StructField("average_random_access_time", T.LongType()),
])


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The rows at path (JSON lines, or files with one array each); none if there is nothing, or, with a warning, if something there can't be parsed."""
    none = spark.createDataFrame([], SCHEMA)
    reader = spark.read.schema(SCHEMA).option("mode", "FAILFAST").option("multiLine", path.endswith(".json"))
    try:
        rows = reader.json(path)
        rows.write.format("noop").mode("overwrite").save()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return none
    except (PySparkException, Py4JJavaError) as error:
        if "MALFORMED_RECORD_IN_PARSING" not in str(error):
            raise
        print(f"results at {path} can't be parsed; starting without any", file=sys.stderr)
        return none
    return rows


def append_results(results: DataFrame, path: str) -> None:
    """Adds rows to a directory of JSON lines; what is there already isn't rewritten."""
    results.select(*SCHEMA.names).write.mode("append").json(path)


def reset_results(spark: SparkSession, path: str) -> None:
    """Leaves an empty directory of results at path."""
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").json(path)


def export_results(results: DataFrame, path: str) -> None:
    """One pretty JSON array in a local file. Measurements are a few rows for each dataset and codec."""
    with open(path, "w") as out:
        json.dump([r.asDict() for r in results.select(*SCHEMA.names).toLocalIterator()], out, indent=2)
