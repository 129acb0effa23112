"""Groups of nodes by node columns, and aggregates of edges between groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.fixpoint import dealt

_NAMED: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "any": lambda c: F.bool_or(F.coalesce(c.cast("double") != 0, F.lit(False))),
    "median": F.median, "std": F.stddev_samp, "var": F.var_samp, "count": F.count, "nunique": F.countDistinct, "first": lambda c: F.first(c, ignorenulls=True), "last": lambda c: F.last(c, ignorenulls=True),
    "size": lambda c: F.count(F.lit(1)), "prod": F.product, "sem": lambda c: F.stddev_samp(c) / F.sqrt(F.count(c)), "all": lambda c: F.bool_and(F.coalesce(c.cast("double") != 0, F.lit(True))),
}


def named_aggregate(name: str, column: Column) -> Column:
    if name not in _NAMED:
        raise ValueError(f"unknown aggregate {name!r}")
    return _NAMED[name](column)


def without_nan(column: str, kind: T.DataType) -> Column:
    """A column whose NaN are null, so that aggregates pass over them as pandas' do."""
    c = F.col(f"`{column}`")
    return F.when(~F.isnan(c), c) if isinstance(kind, (T.FloatType, T.DoubleType)) else c


def numeric(df: DataFrame, but=()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in but]


class NodeGroups:
    """Source nodes, target nodes or both, grouped by columns; nothing runs until a result is asked for."""

    def __init__(self, graph, by, axis="both", induced: bool = False, sort: bool = True, dropna: bool = True):
        axes = {"both": "both", "source": "source", 0: "source", "target": "target", 1: "target"}
        if axis not in axes:
            raise ValueError("axis must be 'source', 'target', 'both', 0 or 1")
        self.graph, self.axis, self.induced, self.sort, self.dropna = graph, axes[axis], induced, sort, dropna
        self.by = [by] if isinstance(by, str) else list(by)
        self._single = isinstance(by, str)
        for c in self.by:
            if c not in graph.nodes.columns:
                raise KeyError(c)

    @property
    def has_source_groups(self) -> bool:
        return self.axis in ("both", "source")

    @property
    def has_target_groups(self) -> bool:
        return self.axis in ("both", "target")

    def _side(self, side: str) -> DataFrame:
        nodes = self.graph.source_nodes if side == "source" else self.graph.target_nodes
        return nodes.dropna(subset=self.by) if self.dropna else nodes

    def _need(self, side: str) -> None:
        if not (self.has_source_groups if side == "source" else self.has_target_groups):
            raise ValueError(f"there are no {side} groups")

    def groups(self, side: str) -> DataFrame:
        """The group columns and the list of ids of each group."""
        self._need(side)
        return self._side(side).groupBy(*self.by).agg(F.array_sort(F.collect_list(self.graph.id_col)).alias("ids"))

    def members(self, side: str) -> DataFrame:
        """Group columns and id, one row per node: the form of groups() that stays distributed."""
        self._need(side)
        return self._side(side).select(*self.by, self.graph.id_col)

    def _keys(self, side: str) -> list:
        keys = self._side(side).select(*self.by).distinct()
        rows = (keys.orderBy(*self.by) if self.sort else keys).collect()
        return [r[0] if self._single else tuple(r) for r in rows]

    def _dict(self, side: str) -> dict:
        return {(r[0] if self._single else tuple(r)[: len(self.by)]): r["ids"] for r in self.groups(side).orderBy(*self.by).collect()}

    source_groups = property(lambda self: self._dict("source"))
    target_groups = property(lambda self: self._dict("target"))

    @property
    def source_group_names(self) -> list:
        self._need("source")
        return self._keys("source")

    @property
    def target_group_names(self) -> list:
        self._need("target")
        return self._keys("target")

    def __len__(self) -> int:
        count = lambda side: self._side(side).select(*self.by).distinct().count()
        if self.axis != "both":
            return count(self.axis)
        n = count("source")
        return n if self.induced else n * count("target")

    def _numbered(self, side: str, keys: list) -> DataFrame:
        """(_id, _n): the nodes of one side with the number of their group among keys."""
        nodes = self._side(side)
        kinds = T.StructType([T.StructField("_n", T.LongType()), *[T.StructField(f"_k{j}", nodes.schema[c].dataType) for j, c in enumerate(self.by)]])
        table = nodes.sparkSession.createDataFrame([(n, *((k,) if self._single else k)) for n, k in enumerate(keys)], kinds)
        same = F.lit(True)
        for j, c in enumerate(self.by):
            same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"_k{j}"))
        return nodes.join(table, same).select(F.col(self.graph.id_col).alias("_id"), "_n")

    def __iter__(self) -> Iterator:
        """Lazy sub-graphs by group: ((source group, target group), graph) for both axes, else (group, graph).

        All edges are read once, and written by the numbers of their groups; a sub-graph's edges are one part of that
        table, and its nodes parts of another.
        """
        g = self.graph
        sides = ["source", "target"] if self.axis == "both" else [self.axis]
        keys = {s: self._keys(s) for s in sides}
        members = {s: dealt(self._numbered(s, keys[s]), "_n") for s in sides}
        marked = g.edges
        for s in sides:
            marked = marked.join(members[s].select(F.col("_id").alias(s), F.col("_n").alias(f"_{s}")), s)
        marked = dealt(marked.select(*g.edges.columns, *[f"_{s}" for s in sides]), *[f"_{s}" for s in sides])

        def part(at: dict[str, int]):
            edges = marked
            for s, n in at.items():
                edges = edges.where(F.col(f"_{s}") == n)
            edges = edges.select(g.edges.columns)
            if len(at) == 1:
                return g._replace(edges=edges)
            rows, cols = (members[s].where(F.col("_n") == n).select(F.col("_id").alias(g.id_col)) for s, n in at.items())
            out = g._replace(nodes=g.nodes.join(rows.union(cols).distinct(), g.id_col, "left_semi"), edges=edges)
            out._sources, out._targets, out._places = rows, cols, {}
            return out

        if len(sides) == 1:
            for n, key in enumerate(keys[self.axis]):
                yield key, part({self.axis: n})
        else:
            for i, s in enumerate(keys["source"]):
                for j, t in enumerate(keys["target"]):
                    if not self.induced or s == t:
                        yield (s, t), part({"source": i, "target": j})

    def apply_edges(self, func="size", columns=None) -> DataFrame:
        """func over the edges of each observed pair of groups, keyed by source_<by> and target_<by>.

        func is "size", a named aggregate, or a callable: it gets the group's pandas Series of a column given by name,
        else its pandas DataFrame, and runs in one task per pair of groups.  Without columns, named aggregates cover
        the numeric edge attributes.
        """
        if self.axis != "both":
            raise ValueError("apply_edges needs groups on both axes")
        keys = [f"source_{c}" for c in self.by] + [f"target_{c}" for c in self.by]
        joined = self.graph.apply_node_features(self.by).edges
        joined = joined.dropna(subset=keys)
        ends = joined
        for side, ids in (("source", self.graph._sources), ("target", self.graph._targets)):
            if ids is not None:
                ends = ends.join(ids.select(F.col(self.graph.id_col).alias(side)), side, "left_semi")
        if func == "size" or (isinstance(func, str) and func == "size"):
            return ends.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
        chosen = [columns] if isinstance(columns, str) else list(columns) if columns is not None else numeric(self.graph.edges, ("source", "target"))
        if isinstance(func, str):
            if not chosen:
                raise ValueError("no numeric edge column to aggregate")
            return ends.groupBy(*keys).agg(*[named_aggregate(func, without_nan(c, ends.schema[c].dataType)).alias(c) for c in chosen])
        if not callable(func):
            raise ValueError("func must be a name or a callable")
        types = {f.name: f.dataType.simpleString() for f in ends.schema}
        single = isinstance(columns, str)
        out = ", ".join([f"`{k}` {types[k]}" for k in keys] + [f"`{columns if single else 'value'}` double"])

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            value = func(pdf[columns] if single else pdf[chosen] if columns is not None else pdf)
            return pd.DataFrame([[*pdf[keys].iloc[0], float(value)]], columns=[*keys, columns if single else "value"])

        return ends.groupBy(*keys).applyInPandas(run, out)

    def size_edges(self) -> DataFrame:
        return self.apply_edges("size")


def condense(graph, by, func="size", weight_name="weight", columns=None):
    """The quotient graph: a node for each value of by, an edge for each pair of values with edges between them."""
    keys = [by] if isinstance(by, str) else list(by)
    table = NodeGroups(graph, by).apply_edges(func, columns)
    values = [c for c in table.columns if c not in {f"{s}_{k}" for s in ("source", "target") for k in keys}]
    code = (lambda side: F.col(f"{side}_{keys[0]}")) if len(keys) == 1 else (lambda side: F.struct(*[F.col(f"{side}_{k}").alias(k) for k in keys]))
    names = [weight_name] if len(values) == 1 and not isinstance(columns, (list, tuple)) else values
    edges = table.select(code("source").alias("source"), code("target").alias("target"), *[F.col(v).alias(n) for v, n in zip(values, names, strict=True)])
    ids = graph.nodes.dropna(subset=keys).select((F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)).alias("id")).distinct()
    return type(graph)(ids, edges, id_col="id", directed=graph.directed, validate=False)
