"""Shared storage, local contraction of links, and connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.llm._text import pieces_of

_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local master gets a temporary folder and any other
    master a folder in the warehouse, if that isn't a machine's own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/") + "/lexiweave"
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            path = tempfile.mkdtemp(prefix="lexiweave-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
            _FOLDERS[app] = "file://" + path
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
            if "://" not in base or base.startswith("file:"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            _FOLDERS[app] = base + "/_lexiweave"
    return _FOLDERS[app]


#: Bytes of an Arrow batch to a Python worker.
BATCH = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """From here on this session makes Arrow batches of about BATCH bytes, unless it has a limit of its own.

    Plans are run after the operators return, so the limit stays.
    """
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, str(BATCH))


def _files(spark: SparkSession, path: str):
    """The path and its file system, as Hadoop's objects."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def setting(spark: SparkSession, name: str, value):
    """Within it, the session has this setting; for actions that end within it."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


#: The shuffle files of an action go as soon as it ends: each plans its own, so nothing else reads them.
_CLEAN_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: this cuts the lineage. What isn't dropped before goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    with setting(spark, _CLEAN_CONF, "true"):
        df.write.option("compression", "zstd").parquet(path)
    p, files = _files(spark, path)
    files.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexiweave_path = path
    return out


def drop_stored(*dfs: DataFrame) -> None:
    """Deletes what stored() wrote; nothing that reads them may be used afterwards."""
    for df in dfs:
        path = getattr(df, "_lexiweave_path", None)
        if path:
            p, files = _files(df.sparkSession, path)
            files.delete(p, True)


def numbered(batches, column: int, size: int):
    """Pieces of a task's batches, each with the number of its block: pieces of about `size` bytes together make one, in no other task."""
    block, held = TaskContext.get().partitionId() << 32, 0
    for batch in pieces_of(batches, column):
        if held > size:
            block, held = block + 1, 0
        held += batch.column(column).nbytes
        yield block, batch


def by_place(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns named by place, so that no added column clashes, and those names by column."""
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per component of the links a-b: each node that isn't its component's least, and that least."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:  # hook every root to the least root that it is linked to, then jump to the top
        p, q = root[x], root[y]
        open_ = p != q
        if not open_.any():
            break
        x, y, p, q = x[open_], y[open_], p[open_], q[open_]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    low = root != np.arange(len(nodes))
    return nodes[low], nodes[root[low]]


LINKS = "a long, b long"


def _contract(batches):
    """Replaces the links that a task has seen by stars; holds at most one link for each of its nodes."""
    a = b = np.empty(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)])
        b = np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)])
        a, b = forest(a, b)
    for i in range(0, len(a), 1 << 16):
        yield pa.record_batch([pa.array(a[i : i + (1 << 16)]), pa.array(b[i : i + (1 << 16)])], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a long, b long), as (node long, root long).

    Alternates large-star and small-star steps until every component is a star
    around its least node; each step works on stars that the tasks have
    contracted. Links between a node and itself, or with a null, are ignored.
    Nodes without links aren't in the result.
    """
    def ordered(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()

    now = stored(ordered(links.select("a", "b").where("a is not null and b is not null and a <> b").mapInArrow(_contract, LINKS)))
    while now.join(now.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        then = stored(ordered(small.where("a <> b").mapInArrow(_contract, LINKS)))
        drop_stored(now)
        now = then
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
