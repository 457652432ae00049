"""Measuring codecs over data sets.

    python -m lexiweave.plans.bench one DATASET.json CODEC RESULTS [CORE]
    python -m lexiweave.plans.bench suite DIRECTORY RESULTS [--runs N] [--codecs a,b]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.plans.codecs import CODECS, codec, data_bytes
from lexiweave.plans.report import MIB, print_report, rates
from lexiweave.sources.results import append_results, read_results, reset_results
from lexiweave.sources.results import SCHEMA as RESULTS
from lexiweave.sources.strings import load_json

QUERIES = 1_000_000
RUNS = 15
#: One timed run.
RUN = "dataset_name string, compressor_name string, data_bytes long, space_bytes long, encode_s double, decode_s double, lookup_s double, lookups long"


def random_queries(spark: SparkSession, n: int, count: int = QUERIES, seed: int = 42) -> DataFrame:
    """(qid, idx): `count` uniform positions of 0 to n - 1, with replacement; none if n is 0."""
    return spark.range(count if n else 0).select(F.col("id").alias("qid"), F.floor(F.rand(seed) * n).cast("long").alias("idx"))


def mismatches(strings: DataFrame, decoded: DataFrame) -> int:
    """Rows that one side lacks or that differ."""
    a, b = strings.select("idx", "s"), decoded.select("idx", F.col("s").alias("s2"))
    return a.join(b, "idx", "full_outer").where(~F.col("s").eqNullSafe(F.col("s2"))).count()


def _seconds(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def _run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def measure(strings: DataFrame, name: str, dataset: str, queries: int = QUERIES, seed: int = 42) -> dict:
    """One run of a codec over a data set: a row of results (`report.rates`). Raises if a string doesn't come back as it was.

    The time of an access is that of the whole batch of lookups over their
    number, not the latency of one.
    """
    spark = strings.sparkSession
    strings = strings.persist()
    n, size = strings.count(), data_bytes(strings)
    held = {}

    def compress() -> None:
        held["model"] = codec(name).fit(strings)
        held["encoded"] = held["model"].encode(strings).persist()
        _run(held["encoded"])

    compressing = _seconds(compress)
    model, encoded = held["model"], held["encoded"]
    decompressing = _seconds(lambda: _run(model.decode(encoded)))
    if bad := mismatches(strings, model.decode(encoded)):
        raise AssertionError(f"{bad} strings of {dataset} differ after {name}")
    asked = random_queries(spark, n, queries, seed).persist()
    asked.count()
    found = model.lookup(encoded, asked)
    looking = _seconds(lambda: _run(found))
    wrong = asked.join(strings, "idx").join(found.select("qid", F.col("s").alias("s2")), "qid", "left").where(~F.col("s").eqNullSafe(F.col("s2"))).count()
    if wrong:
        raise AssertionError(f"{wrong} lookups of {dataset} differ after {name}")
    space = model.space_used(encoded).first()["space_bytes"]
    for df in (strings, encoded, asked):
        df.unpersist()
    run = (dataset, CODECS[name].label, size, space, compressing, decompressing, looking, queries if n else 0)
    return rates(spark.createDataFrame([run], RUN)).first().asDict()


def suite(spark: SparkSession, directory: str, results: str, codecs=tuple(CODECS), runs: int = RUNS, queries: int = QUERIES) -> DataFrame:
    """Every codec over every *.json of a directory, `runs` times; a failing cell is told and left out. Starts with empty results."""
    reset_results(spark, results)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(directory)
    listed = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    files = sorted(f.getPath().toString() for f in listed if f.isFile() and f.getPath().getName().endswith(".json"))
    for path in files:
        for name in codecs:
            for _ in range(runs):
                try:
                    row = measure(load_json(spark, path), name, path.rpartition("/")[2].removesuffix(".json"), queries)
                    append_results(spark.createDataFrame([row], RESULTS), results)
                except Exception as error:  # one cell's failure leaves the others
                    print(f"{name} on {path}: {error}", file=sys.stderr)
    return read_results(spark, results)


def pin(core: int) -> None:
    """Holds this process, and the JVM that it starts, on one core; only warns if that can't be done."""
    try:
        os.sched_setaffinity(0, {core})
    except (AttributeError, OSError, ValueError) as error:
        print(f"not pinned to core {core}: {error}", file=sys.stderr)


def complaint(given: argparse.Namespace) -> str | None:
    """What is wrong with the arguments, if anything; looked at before Spark starts. Paths with a scheme are Spark's to judge."""
    path, one = (given.dataset, True) if given.which == "one" else (given.directory, False)
    if "://" not in path:
        if not os.path.exists(path):
            return f"{path} doesn't exist"
        if one and not os.path.isfile(path):
            return f"{path} isn't a file"
        if not one and not os.path.isdir(path):
            return f"{path} isn't a directory"
    if given.core is not None and given.core < 0:
        return f"core {given.core} isn't a core's number"
    if not one and (unknown := [c for c in given.codecs.split(",") if c not in CODECS]):
        return f"unknown codec {unknown[0]!r}; there are {', '.join(CODECS)}"
    return None


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="lexiweave.plans.bench")
    which = parser.add_subparsers(dest="which", required=True)
    one = which.add_parser("one")
    one.add_argument("dataset")
    one.add_argument("codec", choices=list(CODECS))
    one.add_argument("results")
    one.add_argument("core", nargs="?", type=int)
    every = which.add_parser("suite")
    every.add_argument("directory")
    every.add_argument("results")
    every.add_argument("core", nargs="?", type=int)
    every.add_argument("--runs", type=int, default=RUNS)
    every.add_argument("--codecs", default=",".join(CODECS))
    for p in (one, every):
        p.add_argument("--queries", type=int, default=QUERIES)
    given = parser.parse_args(args)
    if wrong := complaint(given):
        print(f"error: {wrong}", file=sys.stderr)
        return 1
    if given.core is not None:
        pin(given.core)
    spark = SparkSession.builder.master("local[1]" if given.core is not None else "local[*]").config("spark.ui.enabled", "false").getOrCreate()
    if given.which == "one":
        name = os.path.basename(given.dataset).removesuffix(".json")
        append_results(spark.createDataFrame([measure(load_json(spark, given.dataset), given.codec, name, given.queries)], RESULTS), given.results)
    else:
        print_report(suite(spark, given.directory, given.results, given.codecs.split(","), given.runs, given.queries))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
