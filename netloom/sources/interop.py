"""Graphs from and to other forms.  Whatever collects to the driver has a row limit."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 5_000_000


def local(df: DataFrame, limit: int):
    out = df.limit(limit + 1).toPandas()
    if len(out) > limit:
        raise ValueError(f"more than {limit} rows: write the tables instead, or raise limit")
    return out


def to_dict(graph, orient: str = "dict", limit: int = LIMIT) -> dict:
    nodes = local(graph.nodes, limit).set_index(graph.id_col)
    edges = local(graph.edges, limit)
    if orient == "records":
        return {"nodes": nodes.reset_index().to_dict("records"), "edges": edges.to_dict("records"), "directed": graph.directed}
    return {"nodes": nodes.to_dict(orient), "edges": edges.to_dict(orient), "directed": graph.directed}


def to_json(graph, orient: str = "dict", limit: int = LIMIT) -> str:
    return json.dumps(to_dict(graph, orient, limit), default=lambda x: x.item() if hasattr(x, "item") else str(x))


def from_dict(spark: SparkSession, data: dict, orient: str = "columns", index_dtype=None, id_col: str = "id"):
    """The inverse of to_dict(); orient "columns" reads what "dict" wrote, "index" and "records" likewise."""
    import pandas as pd

    from ..frame import GraphTable

    if orient == "records":
        nodes, edges = pd.DataFrame(data["nodes"]), pd.DataFrame(data["edges"])
        id_col = id_col if id_col in nodes.columns else nodes.columns[0]
    else:
        orient = "columns" if orient == "dict" else orient
        make = pd.DataFrame.from_dict if orient in ("columns", "index", "tight") else None
        if make is None:
            raise ValueError(f"orient {orient!r} can't be read")
        nodes, edges = make(data["nodes"], orient=orient), make(data["edges"], orient=orient)
        nodes = nodes.rename_axis(id_col).reset_index()
    if index_dtype is not None:
        nodes[id_col] = nodes[id_col].astype(index_dtype)
        for side in ("source", "target"):
            edges[side] = edges[side].astype(index_dtype)
    elif len(edges) and nodes[id_col].dtype == object and edges["source"].dtype != object:
        nodes[id_col] = nodes[id_col].astype(edges["source"].dtype)  # JSON keys are strings
    return GraphTable(spark.createDataFrame(nodes), spark.createDataFrame(edges), id_col=id_col, directed=data.get("directed", True))


def to_networkx(graph, create_using=None, limit: int = LIMIT):
    import networkx as nx

    out = create_using if create_using is not None else (nx.MultiDiGraph() if graph.directed else nx.MultiGraph())
    nodes, edges = local(graph.nodes, limit), local(graph.edges, limit)
    for row in nodes.to_dict("records"):
        out.add_node(row.pop(graph.id_col), **row)
    for row in edges.to_dict("records"):
        out.add_edge(row.pop("source"), row.pop("target"), **row)
    return out


def edge_index(graph, directed: bool = True, weight_col: str | None = None) -> DataFrame:
    """(src_pos, dst_pos[, weight]): edges by node position; each also reversed where directed is false."""
    placed = graph.positions()
    src = placed.select(F.col(graph.id_col).alias("source"), F.col("_pos").alias("src_pos"))
    dst = placed.select(F.col(graph.id_col).alias("target"), F.col("_pos").alias("dst_pos"))
    more = [F.col(weight_col).alias("weight")] if weight_col else []
    out = graph.edges.join(src, "source").join(dst, "target").select("src_pos", "dst_pos", *more)
    if not directed:
        out = out.unionByName(out.select(F.col("dst_pos").alias("src_pos"), F.col("src_pos").alias("dst_pos"), *(["weight"] if weight_col else [])))
    return out


def node_matrix(graph) -> DataFrame:
    """(_pos, x): node attributes as an array of doubles, nulls and NaN as 0."""
    columns = [f.name for f in graph.nodes.schema if f.name != graph.id_col]
    for f in graph.nodes.schema:
        if f.name != graph.id_col and not isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            raise TypeError(f"column {f.name!r} is not numeric")
    number = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    return graph.positions().select("_pos", F.array(*map(number, columns)).alias("x"))


def to_torch_geometric(graph, directed: bool = True, weight_col: str | None = None, limit: int = LIMIT):
    import torch
    from torch_geometric.data import Data

    index = local(edge_index(graph, directed, weight_col), limit)
    x = local(node_matrix(graph).orderBy("_pos"), limit)
    weights = torch.tensor(index["weight"].to_numpy(), dtype=torch.float) if weight_col else None
    return Data(x=torch.tensor(x["x"].tolist(), dtype=torch.float), edge_index=torch.tensor(index[["src_pos", "dst_pos"]].to_numpy().T.copy(), dtype=torch.long), edge_attr=weights)
