"""Selections.  A selection of nodes keeps an edge if both its ends survive; a selection of edges keeps all nodes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in the one-column table ids."""
    one = ids.columns[0]
    return edges.join(ids.select(F.col(one).alias("source")), "source", "left_semi").join(ids.select(F.col(one).alias("target")), "target", "left_semi").select(edges.columns)


def id_table(graph, ids) -> DataFrame:
    """ids (a table, a scalar, a slice of node positions, or values) as a one-column table of distinct ids with _order."""
    if isinstance(ids, DataFrame):
        column = graph.id_col if graph.id_col in ids.columns else ids.columns[0]
        return ids.select(F.col(column).alias("_id")).distinct()
    if isinstance(ids, slice):
        size = len(graph)
        start, stop, step = ids.indices(size)
        chosen = range(start, stop, step)
        if not chosen:
            return graph.nodes.select(F.col(graph.id_col).alias("_id")).limit(0)
        low, high, step = min(chosen[0], chosen[-1]), max(chosen[0], chosen[-1]), abs(step)
        pos = F.col("_pos")
        return graph.positions().where((pos >= low) & (pos <= high) & ((pos - low) % step == 0)).select(F.col(graph.id_col).alias("_id"))
    values = [ids] if isinstance(ids, (str, bytes)) or not isinstance(ids, Iterable) else list(dict.fromkeys(ids))
    values = [v.item() if hasattr(v, "item") else v for v in values]
    kind = graph.nodes.schema[graph.id_col].dataType.simpleString()
    return graph.nodes.sparkSession.createDataFrame([(v,) for v in values], f"_id {kind}")


def require(graph, ids: DataFrame) -> None:
    """KeyError for the first of ids that is no node."""
    missing = ids.join(graph.nodes.select(F.col(graph.id_col).alias("_id")), "_id", "left_anti").limit(1).collect()
    if missing:
        raise KeyError(missing[0][0])


def within(edges: DataFrame, rows: DataFrame | None, cols: DataFrame | None) -> DataFrame:
    out = edges
    for side, ids in (("source", rows), ("target", cols)):
        if ids is not None:
            out = out.join(ids.select(F.col("_id").alias(side)), side, "left_semi")
    return out.select(edges.columns)


def touched(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("_id")).union(edges.select("target")).distinct()


def chosen(graph, table: DataFrame, expr, local_dict, global_dict, is_nodes: bool, sql: str | None = None) -> DataFrame:
    """Rows of table on which expr (a query string or a Column) and sql (a Spark SQL condition) hold; a null is not true."""
    from ..functions.expr import where

    if expr is None and sql is None:
        raise ValueError("a query needs an expression or a SQL condition")
    if isinstance(expr, Column):
        table = table.where(F.coalesce(expr, F.lit(False)))
    elif expr is not None:
        table = where(table, expr, graph.id_col if is_nodes else None, local_dict, global_dict)
    return table if sql is None else table.where(sql)


class Loc:
    """graph.loc[rows, cols]: edges from rows to cols and the nodes of both; `:` stands for all nodes."""

    def __init__(self, graph):
        self.graph = graph

    def __getitem__(self, at):
        g = self.graph
        if not isinstance(at, tuple):
            raise NotImplementedError("loc takes rows and columns")
        if len(at) != 2:
            raise ValueError("loc takes rows and columns")
        whole = [isinstance(x, slice) and x == slice(None) for x in at]
        rows, cols = (None if w else id_table(g, x) for x, w in zip(at, whole, strict=True))
        for x, ids in zip(at, (rows, cols), strict=True):
            if ids is not None and not isinstance(x, slice):
                require(g, ids)
        same = all(whole) or (not any(whole) and not isinstance(at[0], DataFrame) and not isinstance(at[1], DataFrame) and type(at[0]) is type(at[1]) and (at[0] == at[1] if isinstance(at[0], (slice, str)) or not hasattr(at[0], "__iter__") else list(at[0]) == list(at[1])))
        edges = within(g.edges, rows, cols)
        if any(whole):
            nodes = g.nodes
        else:
            both = rows if same else rows.union(cols).distinct()
            nodes = g.nodes.join(both.withColumnRenamed("_id", g.id_col), g.id_col, "left_semi")
        out = g._replace(nodes=nodes, edges=edges)
        if not any(whole) and hasattr(at[0], "__iter__") and not isinstance(at[0], (str, DataFrame)):
            order = list(dict.fromkeys([*at[0], *([] if same or not hasattr(at[1], "__iter__") or isinstance(at[1], (str, DataFrame)) else at[1])]))
            out = out._replace(order=order)
        if not same:
            rename = lambda t: None if t is None else t.withColumnRenamed("_id", g.id_col)
            out._sources, out._targets, out._places = rename(rows), rename(cols), {}
        return out
