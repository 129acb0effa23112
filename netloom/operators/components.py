"""Connected components, and what a node reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .strong import strong_roots
from ..plans.fixpoint import discard, settled, stored

NEAR = 8
"""Hops that a search makes one by one; what lies farther is found by labels."""


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("s"), F.col("target").alias("t")).where("s is not null and t is not null")


def stars(pairs: DataFrame) -> DataFrame:
    """(id, root), root < id: the least id of the weak component of each node in pairs (s, t) that is not itself the least.

    Large-star and small-star steps alternate and halve the depth of the trees they build (Kiveris et al., 2014), so
    rounds grow with the logarithm of a component's size and not with a path's length.
    """
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    edges, now = stored(pairs.where("s <> t").select(F.greatest("s", "t").alias("u"), F.least("s", "t").alias("v")).distinct(), total=total)
    while now["n_rows"]:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        up = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(up, "u").select(F.col("v").alias("x"), "m", "u")
        step = small.select(F.col("x").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new, after = stored(step, total=total)
        discard(edges)
        edges, before, now = new, now, after
        if now == before:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))


def roots(graph, directed: bool = True, connection: str = "weak") -> DataFrame:
    """(id, root) with the component's least id as its name."""
    if connection not in ("weak", "strong"):
        raise ValueError("connection must be 'weak' or 'strong'")
    ids = graph.nodes.select(F.col(graph.id_col).alias("id"))
    if directed and connection == "strong":
        return strong_roots(ids, _pairs(graph.edges), stars)
    return ids.join(stars(_pairs(graph.edges)), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def labels(graph, directed: bool = True, connection: str = "weak") -> DataFrame:
    """(id, component): components are numbered from 0 by their first node."""
    from .matrix import positions_of

    found = settled(roots(graph, directed, connection))
    placed = found.join(graph.positions().select(F.col(graph.id_col).alias("id"), "_pos"), "id")
    first = placed.groupBy("root").agg(F.min("_pos").alias("_key"))
    numbered = positions_of(first, "root", ["_key"])
    return found.join(numbered.select("root", F.col("_pos").alias("component")), "root").select(F.col("id").alias(graph.id_col), "component")


def _start(graph, start) -> DataFrame:
    own = graph.nodes.where(F.col(graph.id_col) == F.lit(start)).select(F.col(graph.id_col).alias("id"))
    if own.isEmpty():
        raise KeyError(start)
    return own


def _search(seen: DataFrame, pairs: DataFrame, hops: int) -> tuple[DataFrame, bool]:
    """(id, hop) of what seen (id) reaches in hops steps, and whether the last of them found anything."""
    seen = seen.select("id", F.lit(0).alias("hop"))
    front = seen
    for turn in range(1, hops + 1):
        new = pairs.join(front.select(F.col("id").alias("s")), "s", "left_semi").select(F.col("t").alias("id")).distinct().join(seen, "id", "left_anti").select("id", F.lit(turn).alias("hop"))
        front, now = stored(new)
        if not now["n_rows"]:
            return seen, False
        seen = seen.union(front)
    return seen, True


def within_hops(graph, start, directed: bool, hops: int) -> DataFrame:
    """(id, hop) of the nodes that start reaches in hops steps or fewer: one join for each step."""
    pairs = _pairs(graph.edges).distinct()
    if not directed:
        pairs = pairs.union(pairs.select(F.col("t").alias("s"), F.col("s").alias("t"))).distinct()
    return _search(_start(graph, start), settled(pairs) if hops > 1 else pairs, hops)[0]


def reached(graph, start, directed: bool = True) -> DataFrame:
    """(id) of the nodes that start reaches.

    Without directions that is start's weak component.  With them, a search by hops comes first.  Where it isn't done
    after NEAR of them, all it has found becomes one node with the least name, and each other node looks for the least
    name that reaches it: that of a node before it, or that which the node of its own name has found, so that stretches
    double along long paths.  What gets the start's name is reached.
    """
    own = _start(graph, start)
    if not directed:
        found = settled(roots(graph, directed=False))
        return found.join(found.join(own, "id", "left_semi").select("root"), "root", "left_semi").select("id")
    pairs = settled(_pairs(graph.edges).distinct())
    seen, more = _search(own, pairs, NEAR)
    near = seen.select("id")
    if not more:
        return near
    from .strong import LEAST, mixed, number

    near = settled(near)
    ids, numbered = number(graph.nodes.select(F.col(graph.id_col).alias("id")).join(near, "id", "left_anti"))
    ends = numbered(pairs.join(near.select(F.col("id").alias("t")), "t", "left_anti"), near)
    edges = settled(ends.select(F.coalesce(mixed("s", 0), F.lit(LEAST)).alias("s"), mixed("t", 0).alias("t")).distinct())
    nodes, _ = stored(ids.select(F.col("v").alias("n"), mixed("v", 0).alias("v")))
    source = ids.sparkSession.createDataFrame([(LEAST, LEAST)], "v long, l long")
    state, done = nodes.select("v", F.col("v").alias("l")).union(source), 1
    while True:
        ask = edges.select(F.col("t").alias("v"), F.col("s").alias("w")).union(state.select("v", F.col("l")))
        told = ask.join(state.select(F.col("v").alias("w"), "l"), "w").groupBy("v").agg(F.min("l").alias("l"))
        new, now = stored(told, done=F.count_if(F.col("l") == LEAST))
        discard(state)
        state = new
        if now["done"] == done:  # an edge from what is reached to what is not would have added its end
            break
        done = now["done"]
    state = state.join(nodes, "v")
    far = state.where(F.col("l") == LEAST).select(F.col("n").alias("v"))
    return near.union(ids.join(far, "v", "left_semi").select("id"))
