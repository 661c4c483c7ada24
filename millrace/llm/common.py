"""What the operators share: reading tables, cutting lineage, and connected components of a link table."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Links left at which the contraction ends in one task: a fixed bound, whatever the input.
LAST_LINKS = 10_000

#: Rows of a batch for Python workers, in place of Spark's own number.
BATCH_ROWS = 1000
SPARK_BATCH_ROWS = "10000"
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the session names none, as in local tests."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(found)
        return found
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and read back from the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: as cut(), but by columns, so that later steps read only what they need."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def modest_batches(spark: SparkSession) -> None:
    """Fewer rows in the batches for Python workers, unless the session sets a number: texts are long, and both sides hold whole batches."""
    if spark.conf.get(_BATCH_SETTING) == SPARK_BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, BATCH_ROWS)


def release_memory() -> None:
    """Gives what a worker has freed back to the system, which the worker keeps otherwise while it waits for its next task."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def checked_broadcast(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df computed once, and marked for broadcast only if it has at most so many rows; they must be of a bounded width."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df


def word_array(text: F.Column) -> F.Column:
    """The words of a text: runs of anything but ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _finish(batches):
    """Union-find over the last links, at most LAST_LINKS of them."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "root"])


def components(links: DataFrame, last_links: int = LAST_LINKS) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches. links: (a, b) long, in either direction, repeats allowed.

    Randomised contraction: in each round every node joins the neighbour (or itself) whose hash under the round's
    seed is smallest, and links move to the nodes joined, so that a constant share of the nodes goes whatever the
    shape; hubs are reduced by partial aggregation before any shuffle. Each round is checkpointed.
    """
    spark = links.sparkSession
    edges = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps = []
    seed = 0
    while (n := edges.count()) > last_links:
        seed += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b", F.lit(seed)).alias("h"), F.col("b").alias("to"))).alias("m"))
        own = F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), F.col("node").alias("to"))
        joined = cut(near.select("node", F.least(own, F.col("m"))["to"].alias("root")))
        steps.append(joined)
        left, right = joined.select(F.col("node").alias("a"), F.col("root").alias("x")), joined.select(F.col("node").alias("b"), F.col("root").alias("y"))
        edges = cut(edges.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if n:
        steps.append(cut(edges.coalesce(1).mapInArrow(_finish, "node long, root long")))
    if not steps:
        return spark.createDataFrame([], "node long, component long")
    roots = steps[-1]
    for step in reversed(steps[:-1]):
        # A node's root may have been joined in a later round.
        later = roots.select(F.col("node").alias("root"), F.col("root").alias("last"))
        moved = step.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
        roots = cut(moved.unionByName(roots.join(step.select("node"), "node", "left_anti")))
    least = roots.groupBy("root").agg(F.min(F.least("node", "root")).alias("component"))
    return roots.join(least, "root").select("node", "component").unionByName(
        least.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), "component")
    )
