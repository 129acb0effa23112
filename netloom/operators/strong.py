"""Strong components by contraction and by least names of ancestors and descendants, in rounds that don't follow paths.

Edges in both directions make one node of their weak components.  A node with one edge in can be left only through, or
lies on no cycle without, the node before it, so whole trees of such nodes are drawn into their first node, by doubling
of pointers; likewise trees of nodes with one edge out.  After the rest is done, a drawn node joins its first node's
component if it has, or one of its tree below it has, an edge to that component.

In the rest, each node gets a random name, and looks for the least name that reaches it and the least that it reaches,
both at once: names pass along edges, and from the node of the name found so far.  Where both are equal, they name the
node's component.  Other nodes go on in classes of equal pairs, since no component lies in two of them: each class loses
the component of its least name at least, and splits by many pivots.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.fixpoint import discard, stored

LEAST, MOST = -(1 << 63), (1 << 63) - 1
WORTH = 2
"""A contraction is made if it draws in one node for so many edges, or more; that changes the time taken, not the result."""


def mixed(column: str | Column, seed: int) -> Column:
    """A bijection of longs, by shifts and exclusive ors: names that no two nodes share, another order for each seed."""
    x = (F.col(column) if isinstance(column, str) else column).bitwiseXOR(F.lit((seed + 1) * 0x1F123BB5159A55E5 % MOST))
    for _ in range(2):
        x = x.bitwiseXOR(F.shiftleft(x, 13))
        x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
        x = x.bitwiseXOR(F.shiftleft(x, 17))
    return x


def number(ids: DataFrame) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """(id, v) with a long v for each id, and a function that gives pairs (s, t) of ids as pairs of v; ends that are no ids go.

    Ends in a second table that the function may get become a null s.
    """
    if isinstance(ids.schema["id"].dataType, T.IntegralType):
        table = ids.select("id", F.col("id").cast("long").alias("v"))
    else:
        table = ids.select("id", F.monotonically_increasing_id().alias("v"))
    table, _ = stored(table)

    def convert(pairs: DataFrame, other: DataFrame | None = None) -> DataFrame:
        starts = table.select(F.col("id").alias("s"), F.col("v").alias("a"))
        if other is not None:
            starts = starts.unionByName(other.select(F.col(other.columns[0]).alias("s"), F.lit(None).cast("long").alias("a")))
        return pairs.join(starts, "s").join(table.select(F.col("id").alias("t"), F.col("v").alias("b")), "t").select(F.col("a").alias("s"), F.col("b").alias("t"))

    return table, convert


def _renamed(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges with ends in new (v, root) by their root, each once, and without loops."""
    out = edges.join(new.select(F.col("v").alias("s"), F.col("root").alias("a")), "s", "left").join(new.select(F.col("v").alias("t"), F.col("root").alias("b")), "t", "left")
    return out.select(F.coalesce("a", "s").alias("s"), F.coalesce("b", "t").alias("t")).where("s <> t").distinct()


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("t").alias("s"), F.col("s").alias("t"))


def _doubled(tree: DataFrame, size: int, step: Callable[[DataFrame, int], None] | None = None) -> tuple[DataFrame, bool]:
    """(v, a, m): the node a that v's pointers in tree (v, p) lead to, and the least node on the way, v first; and whether some are still on their way.

    Each round doubles all ways; they end outside the tree, or go on round a cycle, and stop once they are as long as
    the tree is large.  step gets the pointers of each round before they are doubled, and the round's number.
    """
    now, _ = stored(tree.select("v", F.col("p").alias("a"), F.col("v").alias("m")))
    turn = 0
    while True:
        if step:
            step(now, turn)
        if 1 << turn >= size:
            return now, True
        far = now.select(F.col("v").alias("a"), F.col("a").alias("b"), F.col("m").alias("k"))
        joined = now.join(far, "a", "left")
        new, seen = stored(joined.select("v", F.coalesce("b", "a").alias("a"), F.least("m", "k").alias("m"), F.col("b").isNotNull().alias("moved")), moved=F.count_if(F.col("moved")))
        if not seen["moved"]:
            discard(new)
            return now, False
        discard(now)
        now, turn = new.select("v", "a", "m"), turn + 1
        now._stored_at = new._stored_at


class _Trees:
    """Nodes of one edge in, drawn into the first nodes of their trees (or the least of their cycles)."""

    def __init__(self, edges: DataFrame, tree: DataFrame, size: int):
        self.edges, self.tree, self.size = edges, tree, size
        found, open_ = _doubled(tree, size)
        if open_:
            round_it = found.select(F.col("v").alias("a"), F.col("m").alias("k"))
            found = found.join(round_it, "a", "left").select("v", F.coalesce("k", "a").alias("root"))
        else:
            found = found.select("v", F.col("a").alias("root"))
        self.new, _ = stored(found.where("v <> root"))

    def undo(self, components: DataFrame) -> DataFrame:
        """components (v, c) of the contracted graph, with those of the nodes drawn in."""
        named = lambda v, c: components.select(F.col("v").alias(v), F.col("c").alias(c))
        out = self.edges.join(self.new.select(F.col("v").alias("s"), "root"), "s").join(self.new.select(F.col("v").alias("t")), "t", "left_anti")
        out = out.join(named("root", "x"), "root", "left").join(named("t", "y"), "t", "left").where(F.coalesce("x", "root") == F.coalesce("y", "t"))
        good, seen = stored(out.select(F.col("s").alias("v")).distinct())
        if not seen["n_rows"]:
            return components
        state = {"good": good}

        def up(pointers: DataFrame, _turn: int) -> None:
            above = pointers.join(state["good"], "v", "left_semi").select(F.col("a").alias("v"))
            more, _ = stored(state["good"].union(above).distinct())
            discard(state["good"])
            state["good"] = more

        _doubled(self.tree, self.size, up)
        own = self.new.join(state["good"], "v", "left_semi").join(named("root", "x"), "root", "left").select("v", F.coalesce("x", "root").alias("c"))
        return stored(components.union(own))[0]


def _counts(edges: DataFrame) -> tuple[int, int, int]:
    """Pairs with edges both ways, and nodes with one edge in, and with one out."""
    one = F.lit(1)
    both = edges.groupBy(F.least("s", "t").alias("x"), F.greatest("s", "t").alias("y")).agg(F.count(one).alias("n")).select(F.lit("both").alias("what"), (F.col("n") > 1).alias("yes"))
    ends = [edges.groupBy(c).agg(F.count(one).alias("n")).select(F.lit(c).alias("what"), (F.col("n") == 1).alias("yes")) for c in ("t", "s")]
    found = {r["what"]: r["n"] for r in both.union(ends[0]).union(ends[1]).groupBy("what").agg(F.count_if("yes").alias("n")).collect()}
    return found.get("both", 0), found.get("t", 0), found.get("s", 0)


def _contracted(edges: DataFrame, count: int, stars) -> tuple[DataFrame, int, list]:
    """edges after contractions, their number, and what undoes each of them."""
    undo: list = []
    while count:
        before = count
        back, once_in, once_out = _counts(edges)
        if back * WORTH >= count:
            mutual = edges.join(_turned(edges), ["s", "t"], "left_semi").where("s < t")
            new, _ = stored(stars(mutual).select(F.col("id").alias("v"), "root"))
            edges, now = stored(_renamed(edges, new))
            count = now["n_rows"]
            undo.append(lambda c, new=new: stored(c.union(new.join(c.select(F.col("v").alias("root"), "c"), "root", "left").select("v", F.coalesce("c", "root").alias("c"))))[0])
        for turned in (False, True):
            own = _turned(edges) if turned else edges
            if (once_out if turned else once_in) * WORTH < count:
                continue
            single = own.groupBy(F.col("t").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.first("s").alias("p")).where("n = 1").select("v", "p")
            tree, seen = stored(single)
            if count and seen["n_rows"] * WORTH >= count:
                level = _Trees(own, tree, seen["n_rows"])
                edges, now = stored(_renamed(edges, level.new))
                count = now["n_rows"]
                undo.append(level.undo)
        if count * 10 > before * 9:
            break
    return edges, count, undo


def _trimmed(edges: DataFrame, count: int) -> tuple[DataFrame, int]:
    """edges without those of nodes that nothing enters or leaves, as long as that takes away a tenth of them."""
    while count:
        ends = edges.join(edges.select(F.col("t").alias("s")).distinct(), "s", "left_semi").join(edges.select(F.col("s").alias("t")).distinct(), "t", "left_semi").select("s", "t")
        new, seen = stored(ends)
        before, count, edges = count, seen["n_rows"], new
        if count * 10 > before * 9:
            break
    return edges, count


def _core(edges: DataFrame, count: int, spark) -> DataFrame:
    """(v, c) of the nodes of edges whose component has more than one."""
    done = spark.createDataFrame([], "v long, c long")
    turn = 0
    while True:
        edges, count = _trimmed(edges, count)
        if not count:
            return done
        turn += 1
        asked, _ = stored(edges.select(mixed("t", turn).alias("v"), mixed("s", turn).alias("w"), F.lit(True).alias("down")).union(edges.select(mixed("s", turn), mixed("t", turn), F.lit(False))))
        nodes, _ = stored(edges.select(F.col("s").alias("n")).union(edges.select("t")).distinct().select("n", mixed("n", turn).alias("v")))
        state, before = nodes.select("v", F.col("v").alias("l"), F.col("v").alias("r")), None
        while True:
            # each node asks those before it, and that of its own least name, for theirs; likewise those after it
            ask = asked.union(state.select("v", F.col("l"), F.lit(True))).union(state.select("v", F.col("r"), F.lit(False)))
            told = ask.join(state.select(F.col("v").alias("w"), "l", "r"), "w")
            step = told.groupBy("v").agg(F.min(F.when(F.col("down"), F.col("l"))).alias("l"), F.min(F.when(~F.col("down"), F.col("r"))).alias("r"))
            new, seen = stored(step, total=F.sum(F.col("l").cast("decimal(38,0)") + F.col("r")))
            discard(state)
            state = new
            if seen["total"] == before:  # names only fall
                break
            before = seen["total"]
        discard(asked)
        state = state.join(nodes, "v")
        heads = state.select(F.col("v").alias("l"), F.col("n").alias("c"))
        found = state.where("l = r").join(heads, "l").select(F.col("n").alias("v"), "c")
        done, _ = stored(done.union(found))
        left = state.where("l <> r")
        a = left.select(F.col("n").alias("s"), F.col("l").alias("l1"), F.col("r").alias("r1"))
        b = left.select(F.col("n").alias("t"), F.col("l").alias("l2"), F.col("r").alias("r2"))
        edges, seen = stored(edges.join(a, "s").join(b, "t").where("l1 = l2 and r1 = r2").select("s", "t"))
        count = seen["n_rows"]


def strong_roots(ids: DataFrame, pairs: DataFrame, stars) -> DataFrame:
    """(id, root): the least id of each node's strong component."""
    table, numbered = number(ids)
    edges, seen = stored(numbered(pairs.where("s <> t").distinct()))
    edges, count, undo = _contracted(edges, seen["n_rows"], stars)
    found = _core(edges, count, ids.sparkSession)
    for step in reversed(undo):
        found = step(found)
    named = table.join(found, "v", "left").select("id", F.coalesce("c", "v").alias("c"))
    return named.join(named.groupBy("c").agg(F.min("id").alias("root")), "c").select("id", "root")
