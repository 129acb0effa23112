"""k-hop neighbourhoods and aggregates over them, by blocks of bits in place of pairs."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.fixpoint import settled, stored
from .grouping import named_aggregate, numeric, without_nan
from .matrix import positions_of

WORDS = [f"w{j}" for j in range(4)]
"""The columns of a row's bits, 64 each."""

SPAN = 64 * len(WORDS)

SPLIT = 1 << 20
"""Rows that one node may make in the join of a round; a node that would make more is dealt into parts."""


def _numbers(graph) -> tuple[DataFrame, int | None, int]:
    """(id, at) with a number for each node, the least id or None, and the count of blocks of numbers.

    Whole numbers in a narrow range are their own numbers, less the least one; other ids are numbered in their order.
    """
    column = F.col(graph.id_col)
    whole = isinstance(graph.nodes.schema[graph.id_col].dataType, T.IntegralType)
    ends = {"least": F.min(column), "most": F.max(column)} if whole else {}
    ids, seen = stored(graph.nodes.select(column.alias("id")), **ends)
    n = seen["n_rows"]
    if whole and n and seen["most"] - seen["least"] < 4 * n + SPAN:
        return ids.select("id", (F.col("id").cast("long") - seen["least"]).alias("at")), seen["least"], (seen["most"] - seen["least"]) // SPAN + 1
    return positions_of(ids, "id", []).select("id", F.col("_pos").alias("at")), None, n // SPAN + 1


def _packed(pairs: DataFrame, by: str, bit: str) -> DataFrame:
    """(by, block, words): the bit's number as one bit of a block's words."""
    at = F.col(bit)
    one = F.expr(f"shiftleft(1L, cast({bit} % 64 as int))")
    words = [F.when(F.floor(at % SPAN / 64) == j, one).otherwise(F.lit(0).cast("long")).alias(w) for j, w in enumerate(WORDS)]
    return pairs.select(F.col(by), F.floor(at / SPAN).alias("block"), *words)


def _merged(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.bit_or(w).alias(w) for w in WORDS])


def _unpacked(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, b): a row for each bit that is set, by plain generators."""
    words = rows.select(*keys, "block", F.posexplode(F.array(*WORDS)).alias("j", "w")).where("w <> 0")
    bits = words.select(*keys, "block", "j", "w", F.explode(F.lit(list(range(64)))).alias("i")).where(F.expr("shiftright(w, i) & 1L") == 1)
    return bits.select(*keys, (F.col("block") * SPAN + F.col("j") * 64 + F.col("i")).alias("b"))


def _spread(step: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """step (a, s) joined with rows (s, block, words).

    most bounds the rows that any s can make.  Where it is above SPLIT, nodes that make more are found, and their side of
    step is dealt into parts, each with a copy of the node's few rows, so that no task has a hub whole.
    """
    if most > SPLIT:
        product = F.col("n") * F.col("m")
        counts = step.groupBy("s").agg(F.count(F.lit(1)).alias("n")).join(rows.groupBy("s").agg(F.count(F.lit(1)).alias("m")), "s")
        heavy, seen = stored(counts.where(product > SPLIT).select("s", (F.floor(product / SPLIT) + 1).cast("int").alias("parts")))
        if seen["n_rows"]:
            parts = F.coalesce("parts", F.lit(1))
            step = step.join(heavy, "s", "left").withColumn("part", F.pmod(F.xxhash64("a"), parts).cast("int")).drop("parts")
            rows = rows.join(heavy, "s", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
            return step.join(rows, ["s", "part"]).drop("part")
    return step.join(rows, "s")


class Reach:
    """Who is within k hops of whom: rows (a, block, words, hop), a bit for each node b first met from a at that hop.

    Nodes go by number.  A row stands for up to 256 pairs, so a hub's neighbours, who all meet each other at two hops, take
    a row per block each and not one per pair.  Edges with an end that is no node are not followed.
    """

    def __init__(self, graph, k: int, directed: bool):
        if k < 0:
            raise ValueError("k must be 0 or more")
        self.graph, self.kind = graph, graph.nodes.schema[graph.id_col].dataType
        self.names, self.least, self.blocks = _numbers(graph)
        layers = [_packed(self.names.select(F.col("at").alias("a"), "at"), "a", "at")]
        if k:
            step = self.links().select(F.col("source").alias("a"), F.col("target").alias("s"))
            if not directed:
                step = step.union(step.select("s", "a"))
            n_steps = 0
            if k > 1:
                step, seen = stored(step.distinct())
                n_steps = seen["n_rows"]
        for hop in range(1, k + 1):
            found = _packed(step, "a", "s") if hop == 1 else _spread(step, layers[-1].withColumnRenamed("a", "s"), n_steps * self.blocks).drop("s")
            # bits met before are known, bits of this hop are met: one exchange takes the first from the second
            none = [F.lit(0).cast("long")] * len(WORDS)
            met = found.select("a", "block", *WORDS, *[x.alias(f"o{w}") for x, w in zip(none, WORDS, strict=True)])
            known = reduce(DataFrame.union, layers).select("a", "block", *[x.alias(w) for x, w in zip(none, WORDS, strict=True)], *[F.col(w).alias(f"o{w}") for w in WORDS])
            both = met.union(known).groupBy("a", "block").agg(*[F.bit_or(w).bitwiseAND(F.bitwise_not(F.bit_or(f"o{w}"))).alias(w) for w in WORDS])
            new = both.where(" or ".join(f"{w} <> 0" for w in WORDS))
            layers.append(settled(new) if hop < k else new)
        self.rows = reduce(DataFrame.union, [layer.withColumn("hop", F.lit(hop)) for hop, layer in enumerate(layers)])

    def links(self) -> DataFrame:
        """(source, target) of the edges, by number."""
        e = self.graph.edges.select("source", "target")
        for end in ("source", "target"):
            e = e.join(self.names.select(F.col("id").alias(end), F.col("at").alias(f"_{end}")), end)
        return e.select(F.col("_source").alias("source"), F.col("_target").alias("target"))

    def named(self, rows: DataFrame, number: str, name: str) -> DataFrame:
        """rows with the id of number as name, in its place."""
        others = [c for c in rows.columns if c != number]
        if self.least is not None:
            return rows.select(*others, (F.col(number) + self.least).cast(self.kind).alias(name))
        return rows.join(self.names.select(F.col("at").alias(number), F.col("id").alias(name)), number).select(*others, name)

    def pairs(self) -> DataFrame:
        """(id, neighbor, hop)."""
        return self.named(self.named(_unpacked(self.rows, "a", "hop"), "a", "id"), "b", "neighbor").select("id", "neighbor", "hop")


def pairs(graph, k: int, directed: bool = False) -> DataFrame:
    """(id, neighbor, hop) of all pairs of nodes at most k hops apart, each node with itself at 0.

    Pairs are found as blocks of bits, and made rows at the end alone.
    """
    return Reach(graph, k, directed).pairs()


class Neighborhoods:
    """A lazy mapping from node id to its k-hop sub-graph, with the long tables of all of them."""

    def __init__(self, graph, k: int, directed: bool):
        self.graph, self.k, self.directed = graph, k, directed
        self.reach = Reach(graph, k, directed)
        self.reach.rows = settled(self.reach.rows)

    @property
    def pairs(self) -> DataFrame:
        """(center, neighbor, hop)."""
        return self.reach.pairs().withColumnRenamed("id", "center")

    @property
    def nodes(self) -> DataFrame:
        """center, hop and the columns of the nodes around it."""
        g = self.graph
        return self.pairs.withColumnRenamed("neighbor", g.id_col).join(g.nodes, g.id_col).select("center", "hop", *g.nodes.columns)

    @property
    def edges(self) -> DataFrame:
        """center and the columns of the edges with both ends around it.

        A block of a source's targets is cut with the centre's block before targets become rows.
        """
        e, reach = self.graph.edges, self.reach
        links, n = stored(reach.links().distinct())
        inside = settled(_merged(reach.rows, "a", "block"))
        out = _merged(_packed(links, "source", "target"), "source", "block").withColumnRenamed("source", "s")
        met = _spread(_unpacked(inside, "a").withColumnRenamed("b", "s"), out, len(self) * min(reach.blocks, n["n_rows"]))
        around = inside.select("a", "block", *[F.col(w).alias(f"o{w}") for w in WORDS])
        cut = met.join(around, ["a", "block"]).select("a", "s", "block", *[F.col(w).bitwiseAND(F.col(f"o{w}")).alias(w) for w in WORDS])
        ends = reach.named(reach.named(reach.named(_unpacked(cut, "a", "s"), "a", "center"), "s", "source"), "b", "target")
        return e.join(ends, ["source", "target"]).select("center", *e.columns)

    def __getitem__(self, node):
        g, reach = self.graph, self.reach
        own = reach.names.where(F.col("id") == F.lit(node)).first()
        if own is None:
            raise KeyError(node)
        ids = reach.named(_unpacked(reach.rows.where(F.col("a") == own["at"])), "b", g.id_col)
        return g._induced(g.nodes.join(ids, g.id_col, "left_semi"))

    def __len__(self) -> int:
        return len(self.graph)

    def __iter__(self):
        return (r[0] for r in self.graph.nodes.select(self.graph.id_col).toLocalIterator())

    def items(self):
        return ((k, self[k]) for k in self)


def _clean(column: str, kind: T.DataType) -> Column:
    c = without_nan(column, kind)
    return c.cast("double") if isinstance(kind, T.DecimalType) else c


class _Asked:
    """What is asked of neighbourhoods: aggregates, engine and feature columns, in that engine's order."""

    def __init__(self, nodes: DataFrame, id_col: str, aggregations, drop_non_numeric: bool, engine: str):
        asked = [aggregations] if isinstance(aggregations, str) or callable(aggregations) else list(aggregations)
        if engine not in ("auto", "scipy", "pandas"):
            raise ValueError("engine must be 'auto', 'scipy' or 'pandas'")
        plain = all(isinstance(a, str) and a in ("mean", "sum", "std") for a in asked)
        if engine == "auto":
            engine = "scipy" if plain else "pandas"
        if engine == "scipy" and not plain:
            raise ValueError("this engine takes mean, sum and std only")
        self.engine, self.id_col = engine, id_col
        self.columns = numeric(nodes, (id_col,)) if drop_non_numeric else [c for c in nodes.columns if c != id_col]
        kinds = {f.name: f.dataType for f in nodes.schema}
        self.features = [_clean(c, kinds[c]).alias(f"f{i}") for i, c in enumerate(self.columns)]
        self.parts = [(i, a) for a in ("mean", "sum", "std") if a in asked for i in range(len(self.columns))] if engine == "scipy" else [(i, a) for i in range(len(self.columns)) for a in asked]

    def title(self, i: int, a) -> str:
        return f"{self.columns[i]}_neighbor_{a if isinstance(a, str) else a.__name__}"

    def over(self, near: DataFrame, ids: DataFrame) -> DataFrame:
        """Aggregates of near (key, f0, ...) for each of ids (key, id).  An own aggregate has a node's values in one task."""
        named = [(i, a) for i, a in self.parts if isinstance(a, str)]
        own = [(i, a) for i, a in self.parts if not isinstance(a, str)]
        out = ids
        if named:
            out = out.join(near.groupBy("key").agg(*[named_aggregate(a, F.col(f"f{i}")).alias(self.title(i, a)) for i, a in named]), "key", "left")
        if own:
            columns, titles = self.columns, [self.title(i, a) for i, a in own]

            def run(pdf: pd.DataFrame) -> pd.DataFrame:
                return pd.DataFrame([[pdf["key"].iloc[0], *[float(a(pdf[f"f{i}"].rename(columns[i]))) for i, a in own]]], columns=["key", *titles])

            kind = near.schema["key"].dataType.simpleString()
            out = out.join(near.groupBy("key").applyInPandas(run, ", ".join([f"key {kind}", *[f"`{t}` double" for t in titles]])), "key", "left")
        zero = {self.title(i, a) for i, a in self.parts if self.engine == "scipy" or a == "sum"}
        last = [self.title(i, a) for i, a in self.parts]
        return out.select(F.col("id").alias(self.id_col), *[(F.coalesce(F.col(f"`{t}`"), F.lit(0)).cast(out.schema[t].dataType) if t in zero else F.col(f"`{t}`")).alias(t) for t in last])


def aggregate_over_reach(graph, k: int, aggregations="mean", directed: bool = False, drop_self_in_neighborhood: bool = True, drop_non_numeric: bool = True, engine: str = "auto") -> DataFrame:
    """aggregate_over_pairs() of the pairs within k hops, which are never shuffled as pairs.

    A block of bits meets the features of its 256 nodes, and sums are begun in the task where pairs are made of the two.
    """
    reach = Reach(graph, k, directed)
    asked = _Asked(graph.nodes, graph.id_col, aggregations, drop_non_numeric, engine)
    numbered = graph.nodes.select(F.col(graph.id_col).alias("_id"), F.struct(F.lit(0).alias("none"), *asked.features).alias("x")).join(reach.names.withColumnRenamed("id", "_id"), "_id")
    cells = numbered.groupBy(F.floor(F.col("at") / SPAN).alias("block")).agg(F.collect_list(F.struct("at", "x")).alias("cells"))
    word = F.coalesce(*[F.when(F.floor(F.col("c.at") % SPAN / 64) == j, F.col(w)) for j, w in enumerate(WORDS)])
    met = reach.rows.join(cells, "block").select("a", *WORDS, F.explode("cells").alias("c")).withColumn("w", word)
    met = met.where(F.expr("shiftright(w, cast(c.at % 64 as int)) & 1L") == 1)
    if drop_self_in_neighborhood:
        met = met.where("a <> c.at")
    near = met.select(F.col("a").alias("key"), *[F.col(f"c.x.f{i}").alias(f"f{i}") for i in range(len(asked.columns))])
    return asked.over(near, reach.names.select(F.col("at").alias("key"), "id"))


def aggregate_over_pairs(near: DataFrame, nodes: DataFrame, aggregations="mean", drop_self_in_neighborhood: bool = True, drop_non_numeric: bool = True, id_col: str = "id", engine: str = "auto", verbose: bool = False) -> DataFrame:
    """Aggregates of node columns over pairs (id, neighbor), one row per node, as <column>_neighbor_<aggregate>.

    engine "scipy" takes mean, sum and std only; an empty neighbourhood, and the spread of a single value, give 0.
    engine "pandas" takes any named aggregate or callable, and leaves those null.  "auto" is the first where it can be.
    """
    asked = _Asked(nodes, id_col, aggregations, drop_non_numeric, engine)
    near = near.select(F.col("id").alias("key"), "neighbor").distinct()
    if drop_self_in_neighborhood:
        near = near.where("key <> neighbor")
    joined = near.join(nodes.select(F.col(id_col).alias("neighbor"), *asked.features), "neighbor").drop("neighbor")
    return asked.over(joined, nodes.select(F.col(id_col).alias("key"), F.col(id_col).alias("id")))
