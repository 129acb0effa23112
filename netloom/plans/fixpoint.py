"""Tables written between the rounds of a driver loop.  Lineage ends at each of them, and lost executors cost no more than a task."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; in local mode, where it has none, a folder of this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="netloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """df, written to the shared folder and read back, and aggregates of its rows that are taken while they are written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"
    seen = Observation()
    watched = df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *[c.alias(k) for k, c in measures.items()])
    watched.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out, seen.get


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """df, written to the shared folder by values of columns, so that a filter on them reads no other files.

    Rows of one value go to one task, or to several where they are many.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/parts-{uuid.uuid4().hex}"
    df.hint("rebalance", *[F.col(c) for c in columns]).write.partitionBy(*columns).parquet(path)
    out = spark.read.schema(df.schema).parquet(path).select(df.columns)
    out._stored_at = path
    return out


def ranged(df: DataFrame, column: str) -> DataFrame:
    """df, written to the shared folder in order of column, so that a filter on it reads few files and row groups.

    Rows of one value may fill several tasks, as a hash of the row is the second key.
    """
    return stored(df.repartitionByRange(F.col(column), F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))])).sortWithinPartitions(column))[0]


def settled(df: DataFrame) -> DataFrame:
    """df cut from its lineage."""
    return stored(df)[0]


def discard(*tables: DataFrame | None) -> None:
    """Delete what stored() wrote for tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
