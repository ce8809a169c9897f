"""Shared pieces: tables in the cluster's shared folder, row slices, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut, lost executors cost nothing.

    The table goes when the driver's JVM ends, or sooner by ``discard``."""
    return placed(df, tag)[0]


def placed(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """As ``stored``, and the table's path."""
    spark = df.sparkSession
    path = temporary(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def temporary(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    at, files = _file_system(spark, path)
    files.deleteOnExit(at)
    return path


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes stored tables that nothing reads any more."""
    for path in paths:
        at, files = _file_system(spark, path)
        files.delete(at, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches cut small, so that few whole texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def connected_components(edges: DataFrame, tag: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b: of one orderable type); root is the least node reachable.

    Each round takes the least label among neighbours, then lets every node take its
    label's label; the reach of a label doubles or better in a round, so rounds grow with the logarithm of a
    component's diameter. Labels that have not settled after ``max_rounds`` are an error, never a result.
    State stays in tables; only whether anything changed reaches the driver. Labels are stored before they meet
    their labels' labels: both sides of that join, as of the join with the edges, then come straight from a shuffle
    that adaptive execution splits where many nodes have one root. Least labels combine before the shuffle.
    """
    spark = edges.sparkSession
    both, edges_path = placed(edges.select("a", "b").where("a <> b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), f"{tag}-edges")
    labels, path = placed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), f"{tag}-labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        better, between = placed(labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "m").alias("root")), f"{tag}-near")
        jump = better.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after, new = placed(better.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("next", "root")).alias("root")), f"{tag}-labels")
        discard(spark, path, between)
        labels, path = after.select("node", "root"), new
        if after.where("was <> root").isEmpty():
            discard(spark, edges_path)
            return labels
    raise RuntimeError("components did not settle")


def merge_labels(label, a, b):
    """In place: joins the classes of index arrays a and b; each class's label is its least index."""
    import numpy as np

    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        np.minimum.at(label, np.maximum(la, lb)[differ], np.minimum(la, lb)[differ])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
