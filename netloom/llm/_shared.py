"""Tables in the cluster's shared folder, and connected components over them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where it is unset, as in tests, a folder of this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="netloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
"""Spark's own switch: shuffle files of a query are deleted when it ends, not when the driver collects its garbage."""


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    What was shuffled for it is of no more use then, so its files go at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before) if before is not None else spark.conf.unset(CLEAN_UP)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete what keep() wrote for a table that nothing reads any more."""
    path = getattr(df, "_kept_at", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in links (a, b): label is the least node that it reaches.

    Large-star and small-star steps alternate (Kiveris et al., 2014); each round shrinks paths, so rounds grow with
    the logarithm of a component's size.  Each round's links are written to the shared folder.
    """
    edges = keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        up = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(up, "a").select(F.col("b").alias("x"), "m", "a")
        step = small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        step = keep(step, "links")
        now = step.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(edges)
        edges = step
        if now == before:
            break
        before = now
    # every edge now leads to its component's least node
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
