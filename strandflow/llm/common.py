"""Shared helpers: reading tables, cutting lineage in the shared folder, connected components."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows of a small table that one task takes.
PER_TASK = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it.

    Where none is named, a local one serves a session in one process only; a cluster without one is refused, as each executor would
    write to its own disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return _local_dir()


@functools.cache
def _local_dir() -> str:
    path = tempfile.mkdtemp(prefix="strandflow-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def unused(name: str, columns: list[str]) -> str:
    """name, with underscores behind it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextlib.contextmanager
def configured(spark: SparkSession, values: dict[str, str]):
    """Within it, the session has these settings."""
    before = {name: spark.conf.get(name) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again.

    This cuts the lineage once, without the second computation that checkpoint() makes, and the table outlives
    any executor.  The shuffles that made it go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandflow/{name}-{uuid.uuid4().hex}"
    with configured(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def discard(table: DataFrame) -> None:
    """Delete a table that materialize() made and that nothing will read again."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.table_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Within it, Arrow functions that run get so many rows at once: for rows with long lists, of which the default makes large batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def hash128(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes; together a key on which collisions need not be considered."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols)]


def words_of(text: Column) -> Column:
    """White-space separated words; an empty or null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Components of the undirected edges (a, b), as rows (node, component); component is its least node.

    Min-label hooking with pointer jumping: rounds grow with the logarithm of a component's diameter.  All state
    stays in tables; a hub's edges are pre-aggregated before they are shuffled by their target.
    Nulls on either side are ignored, self-links give a component of one node.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null")
    both = materialize(
        edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges"
    )
    # Rounds over few edges need few tasks; the number grows with the edges.
    tasks = 1 + both.count() // PER_TASK
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).coalesce(tasks)
                         .select("node", F.least("node", "m").alias("label")), "cc-labels")
    for _ in range(max_rounds):
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").coalesce(tasks)
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m")).coalesce(tasks))
        offer = labels.join(near, "node").coalesce(tasks).select("node", "label", F.least("label", "m").alias("m"))
        hooked = (offer.select("node", "m").unionByName(offer.select(F.col("label").alias("node"), "m"))
                  .groupBy("node").agg(F.min("m").alias("label")))
        hooked = materialize(hooked.coalesce(tasks), "cc-hooked")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = hooked.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label"))
        jumped = materialize(jumped.coalesce(tasks), "cc-labels")
        settled = jumped.join(labels.withColumnRenamed("label", "old"), "node").coalesce(tasks).where("label <> old").isEmpty()
        discard(hooked)
        discard(labels)
        labels = jumped
        if settled:
            discard(both)
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
