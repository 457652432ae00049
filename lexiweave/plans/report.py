"""Reports over measurements: means by data set, and means of those by codec."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIB = 1024.0 * 1024.0
_RATES = ("compression_rate", "compression_speed", "decompression_speed")
_TIME = "average_random_access_time"


def _means(results: DataFrame, *by: str) -> DataFrame:
    """Means of the rates; the time's mean is cut to an integer."""
    return results.groupBy(*by).agg(*[F.avg(c).alias(c) for c in _RATES], F.expr(f"sum({_TIME}) DIV count({_TIME})").alias(_TIME))


def by_dataset(results: DataFrame) -> DataFrame:
    return _means(results, "compressor_name", "dataset_name")


def overall(results: DataFrame) -> DataFrame:
    """Means of the data sets' means, so that each data set counts once."""
    return _means(by_dataset(results), "compressor_name")


def report(results: DataFrame) -> DataFrame:
    """The data sets' rows by codec and name, and after them a row AVERAGE."""
    rows = by_dataset(results).withColumn("_last", F.lit(0)).unionByName(overall(results).withColumn("dataset_name", F.lit("AVERAGE")).withColumn("_last", F.lit(1)))
    return rows.orderBy("compressor_name", "_last", "dataset_name").drop("_last")


def print_report(results: DataFrame) -> str:
    """The report as text, one table for each codec; also printed."""
    lines, codec = [], None
    for r in report(results).toLocalIterator():
        if r["compressor_name"] != codec:
            codec = r["compressor_name"]
            lines += ["", codec, f"{'data set':<30} {'ratio':>8} {'encode MiB/s':>13} {'decode MiB/s':>13} {'lookup ns':>10}"]
        lines.append(f"{r['dataset_name']:<30} {r['compression_rate']:>8.3f} {r['compression_speed']:>13.2f} {r['decompression_speed']:>13.2f} {r[_TIME]:>10d}")
    text = "\n".join(lines[1:])
    print(text)
    return text


def rates(runs: DataFrame) -> DataFrame:
    """Results of timed runs (dataset_name, compressor_name, data_bytes, space_bytes, encode_s, decode_s, lookup_s, lookups): MiB a second, and whole ns an access; null where there is nothing to divide."""
    over = lambda a, b: F.when(F.col(b) > 0, a / F.col(b))
    size = F.col("data_bytes") / F.lit(MIB)
    return runs.select(
        "dataset_name", "compressor_name", F.when(F.col("data_bytes") > 0, over(F.col("data_bytes").cast("double"), "space_bytes")).alias("compression_rate"),
        over(size, "encode_s").alias("compression_speed"), over(size, "decode_s").alias("decompression_speed"),
        F.when(F.col("lookups") > 0, F.floor(F.floor(F.col("lookup_s") * 1e9) / F.col("lookups"))).cast("long").alias(_TIME))


def ratio(strings: DataFrame, space: DataFrame) -> DataFrame:
    """One row: data_bytes, space_bytes, ratio (null without data)."""
    n = strings.agg(F.coalesce(F.sum(F.octet_length("s")), F.lit(0)).cast("long").alias("data_bytes"))
    return n.withColumn("space_bytes", space.select("space_bytes").scalar()).withColumn("ratio", F.when(F.col("data_bytes") > 0, F.col("data_bytes") / F.col("space_bytes")))
