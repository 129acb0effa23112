"""Graphs in shards for training: each holds a range of nodes, their out-edges by local number, and copies of the nodes these lead to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import settled, shared_folder
from .interop import edge_index, node_matrix


class GraphShards:
    """The tables nodes (shard, local, position, ghost, x) and edges (shard, src, dst[, weight]) under path, a folder for each shard."""

    def __init__(self, spark: SparkSession, path: str, weighted: bool):
        self.path = path
        ends = "src long, dst long" + ", weight double" * weighted
        self.nodes = spark.read.schema("local long, position long, ghost boolean, x array<double>, shard int").parquet(f"{path}/nodes")
        self.edges = spark.read.schema(f"{ends}, shard int").parquet(f"{path}/edges")

    def load(self, shard: int) -> dict:
        """One shard as arrays: x (by local number), position, ghost, edge_index of local numbers, and weight or None.

        Only this shard's files are read; a shard without edges has an empty edge_index.
        """
        import numpy as np

        nodes = self.nodes.where(F.col("shard") == shard).drop("shard").toPandas().sort_values("local")
        edges = self.edges.where(F.col("shard") == shard).drop("shard").toPandas()
        return {
            "x": np.array(nodes["x"].tolist(), dtype=np.float64).reshape(len(nodes), -1),
            "position": nodes["position"].to_numpy(),
            "ghost": nodes["ghost"].to_numpy(),
            "edge_index": edges[["src", "dst"]].to_numpy().T,
            "weight": edges["weight"].to_numpy() if "weight" in edges else None,
        }


def write_shards(graph, rows: int, path: str | None = None, weight_col: str | None = None) -> GraphShards:
    """Write shards of rows nodes each, in node order; path is a folder that all machines share.

    A shard's own nodes have the local numbers 0, 1, ... in node order; its ghosts, the ends of its edges that other shards
    own, have the next ones.  Each edge lies in the shard of its source.  Features are numbers or booleans, missing ones 0,
    as in to_node_matrix().  A shard must fit the process that trains on it, and a hub is a ghost once for each shard.
    """
    if rows < 1:
        raise ValueError("rows must be 1 or more")
    path = path or f"{shared_folder(graph.nodes.sparkSession)}/shards-{uuid.uuid4().hex}"
    shard = lambda c: F.floor(F.col(c) / rows).cast("int")
    features = node_matrix(graph).withColumnRenamed("_pos", "position")
    own = features.select(shard("position").alias("shard"), (F.col("position") % rows).alias("local"), "position", F.lit(False).alias("ghost"), "x")
    index = edge_index(graph, True, weight_col)
    weight = [F.col("weight").cast("double")] if weight_col else []
    edges = settled(index.select(shard("src_pos").alias("shard"), (F.col("src_pos") % rows).alias("src"), F.col("dst_pos").alias("position"), *weight))

    apart = edges.where(F.col("shard") != shard("position")).select("shard", "position").distinct()
    size = own.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    numbered = apart.withColumn("k", F.row_number().over(Window.partitionBy("shard").orderBy("position"))).join(size, "shard")
    ghosts = settled(numbered.select("shard", (F.col("n") + F.col("k") - 1).alias("local"), "position"))
    nodes = own.unionByName(ghosts.join(features, "position").select("shard", "local", "position", F.lit(True).alias("ghost"), "x"))
    here = F.col("shard") == shard("position")
    inner = edges.where(here).withColumn("dst", F.col("position") % rows)
    outer = edges.where(~here).join(ghosts.select("shard", "position", F.col("local").alias("dst")), ["shard", "position"])
    links = inner.unionByName(outer.select(*inner.columns)).select("shard", "src", "dst", *(["weight"] if weight_col else []))

    for name, table in (("nodes", nodes), ("edges", links)):
        _by_shard(table).write.partitionBy("shard").parquet(f"{path}/{name}")
    return GraphShards(graph.nodes.sparkSession, path, bool(weight_col))


def _by_shard(table: DataFrame) -> DataFrame:
    """Rows of one shard in one task, or in several where they are many."""
    return table.hint("rebalance", F.col("shard"))
