"""Positions of nodes, adjacency as coordinates, and spectral order by Lanczos steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import discard, settled, stored
from .grouping import named_aggregate, without_nan

DENSE_IDS = 10_000
"""Columns of a dense adjacency at most, Spark's own limit for a pivot."""


def positions_of(table: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """table with _pos, 0 and up in the order of keys and then id_col.

    Rows are dealt by range and numbered within their partition; the driver sums one count per partition.
    """
    ordered = settled(table.orderBy(*[F.asc_nulls_last(k) for k in keys], id_col).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    before, total = {}, 0
    for r in ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect():
        before[r["_part"]] = total
        total += r["n"]
    if not before:
        return ordered.withColumn("_pos", F.lit(0).cast("long")).drop("_part", "_row")
    start = F.create_map(*[F.lit(x) for k, v in before.items() for x in (k, v)])
    return ordered.withColumn("_pos", (F.col("_row") + start[F.col("_part")]).cast("long")).drop("_part", "_row")


def weighted(graph, weight_col: str | None, aggfunc="sum") -> DataFrame:
    """(source, target, value): parallel edges as one; their number where there is no weight."""
    edges = graph.edges.where("source is not null and target is not null")
    if weight_col is None:
        return edges.groupBy("source", "target").agg(F.count(F.lit(1)).alias("value"))
    if weight_col not in graph.edges.columns:
        raise KeyError(weight_col)
    if callable(aggfunc):
        kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
        import pandas as pd

        def run(pdf):
            return pd.DataFrame([[pdf["source"].iloc[0], pdf["target"].iloc[0], float(aggfunc(pdf[weight_col]))]], columns=["source", "target", "value"])

        return edges.groupBy("source", "target").applyInPandas(run, f"source {kinds['source']}, target {kinds['target']}, value double")
    return edges.groupBy("source", "target").agg(named_aggregate(aggfunc, without_nan(weight_col, edges.schema[weight_col].dataType)).alias("value"))


def dense(graph, weight_col: str = "weight", aggfunc="sum") -> DataFrame:
    """A row per source and a column per target, 0 where there is no edge, both in node order."""
    targets = [r[0] for r in graph._placed("target").orderBy("_pos").select(graph.id_col).limit(DENSE_IDS + 1).collect()]
    if len(targets) > DENSE_IDS:
        raise ValueError(f"more than {DENSE_IDS} targets: use to_adjacency_blocks()")
    long = weighted(graph, weight_col, aggfunc)
    wide = long.groupBy("source").pivot("target", targets).agg(F.first("value")) if targets else long.select("source").distinct()
    rows = graph._placed("source").select(F.col(graph.id_col).alias("source"), "_pos").join(wide, "source", "left")
    return rows.select("source", *[F.coalesce(F.col(f"`{t}`"), F.lit(0)).alias(str(t)) for t in targets], "_pos").orderBy("_pos").drop("_pos")


def blocks(graph, weight_col: str = "weight", aggfunc="sum", width: int = 1024) -> DataFrame:
    """(source, row, block, cells): dense rows of any number of targets, cut into arrays of width cells, 0 where there is no edge.

    Neither the targets nor a row is held as a whole anywhere: cells meet by row and block.
    """
    if width < 1:
        raise ValueError("width must be 1 or more")
    targets = graph._placed("target").count()
    coo = coordinates(graph, weight_col, aggfunc).withColumn("block", F.floor(F.col("col") / width).cast("long"))
    zero = F.lit(0).cast(coo.schema["value"].dataType)
    held = coo.groupBy("row", "block").agg(F.array_sort(F.collect_list(F.struct((F.col("col") % width).cast("int").alias("k"), F.coalesce("value", zero).alias("v")))).alias("x"))
    gap = lambda n: F.array_repeat(zero, n)
    cells = F.flatten(F.transform("x", lambda c, i: F.concat(gap(c["k"] - F.coalesce(F.get("x", i - 1)["k"], F.lit(-1)) - 1), F.array(c["v"]))))
    held = held.select("row", "block", cells.alias("cells"))
    size = F.least(F.lit(width), F.lit(targets) - F.col("block") * width).cast("int")
    rows = graph._placed("source").select(F.col(graph.id_col).alias("source"), F.col("_pos").alias("row"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, (targets - 1) // width)).cast("long")))) if targets else rows.withColumn("block", F.lit(0).cast("long")).limit(0)
    have = F.coalesce(F.size("cells"), F.lit(0))
    return rows.join(held, ["row", "block"], "left").select("source", "row", "block", F.concat(F.coalesce("cells", gap(F.lit(0))), gap(size - have)).alias("cells"))


def coordinates(graph, weight_col: str | None = None, aggfunc="sum", verify_integrity: bool = True) -> DataFrame:
    """(row, col, value): positions among sources and targets."""
    if verify_integrity:
        for side in ("source", "target"):
            strays = graph.edges.select(F.col(side).alias("_id")).where("_id is not null").join(graph._placed(side).select(F.col(graph.id_col).alias("_id")), "_id", "left_anti")
            if not strays.isEmpty():
                raise ValueError(f"an edge's {side} is not among the {side}s")
    rows = graph._placed("source").select(F.col(graph.id_col).alias("source"), F.col("_pos").alias("row"))
    cols = graph._placed("target").select(F.col(graph.id_col).alias("target"), F.col("_pos").alias("col"))
    return weighted(graph, weight_col, aggfunc).join(rows, "source").join(cols, "target").select("row", "col", "value")


class Csr:
    """Compressed sparse rows as NumPy arrays, and as a SciPy matrix where SciPy is there."""

    def __init__(self, indptr, indices, data, shape):
        self.indptr, self.indices, self.data, self.shape = indptr, indices, data, shape

    def toarray(self) -> np.ndarray:
        out = np.zeros(self.shape, dtype=self.data.dtype)
        out[np.repeat(np.arange(self.shape[0]), np.diff(self.indptr)), self.indices] = self.data
        return out

    def to_scipy(self, format: str = "csr"):
        from scipy import sparse

        out = sparse.csr_array((self.data, self.indices, self.indptr), shape=self.shape)
        return out.tolil() if format == "lil" else out


PART = 1 << 16
"""Rows of a matrix whose starts are summed in one group."""


class CsrTable:
    """Compressed sparse rows as two tables: indptr (row, start), with one row more than the matrix, and cells (at, col, value).

    The cells of row r are those with at from start of r up to start of r + 1.  Cells are numbered by a sort over all of
    them, dealt by range, so that a long row fills several tasks; starts are running sums of counts by row.
    """

    def __init__(self, graph, coo: DataFrame):
        self.shape = (graph._placed("source").count(), graph._placed("target").count())
        self._coo = coo
        self.cells = positions_of(coo, "col", ["row"]).select(F.col("_pos").alias("at"), "col", "value")
        counts = coo.groupBy("row").agg(F.count(F.lit(1)).alias("n"))
        rows = coo.sparkSession.range(self.shape[0] + 1).withColumnRenamed("id", "row").join(counts, "row", "left").select("row", F.coalesce("n", F.lit(0)).alias("n"), F.floor(F.col("row") / PART).alias("part"))
        before = Window.rowsBetween(Window.unboundedPreceding, -1)
        sums = rows.groupBy("part").agg(F.sum("n").alias("n"))
        base = sums.select("part", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("base"))
        within = F.coalesce(F.sum("n").over(before.partitionBy("part").orderBy("row")), F.lit(0))
        self.indptr = rows.join(base, "part").select("row", (F.col("base") + within).cast("long").alias("start"))

    def collect(self, limit: int) -> Csr:
        cells = self.cells.orderBy("at").limit(limit + 1).toPandas()
        if len(cells) > limit:
            raise ValueError(f"more than {limit} cells: keep the tables, or raise limit")
        indptr = self.indptr.orderBy("row").toPandas()["start"].to_numpy(dtype=np.int64)
        return Csr(indptr, cells["col"].to_numpy(dtype=np.int64), cells["value"].to_numpy(), self.shape)


STEPS = 30
"""Lanczos vectors that a node holds; after so many, the iteration starts again from the best combination of them."""


def _leading(diagonal: list[float], beside: list[float]) -> tuple[float, np.ndarray]:
    """The eigenvalue of largest size of a small tridiagonal matrix, the positive one of two as large, and its vector."""
    small = np.diag(diagonal) + np.diag(beside[: len(diagonal) - 1], 1) + np.diag(beside[: len(diagonal) - 1], -1)
    values, vectors = np.linalg.eigh(small)
    k = len(values) - 1 if abs(values[0]) <= abs(values[-1]) * (1 + 1e-9) else 0
    return float(values[k]), vectors[:, k]


def spectral_keys(graph, weight_col: str = "weight", rounds: int = 10, tolerance: float = 1e-10) -> DataFrame:
    """(id, _key): components of the eigenvector of A + A^T whose eigenvalue is largest in size, its largest component positive.

    Of eigenvalues as large with either sign, as bipartite graphs have them, the positive one counts.  Lanczos steps:
    each node holds its place in all vectors so far; a step sends the last one along the edges (a join and a sum by row),
    takes off the parts along all of them, twice (sums of one row), and puts the rest beside them.  The driver solves
    the tridiagonal matrix of STEPS rows at most.  Raises RuntimeError where the residual is still above tolerance, in
    parts of the eigenvalue, after rounds of STEPS steps; more rounds may be given.
    """
    a = weighted(graph, weight_col).select("source", "target", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("w"))
    ids = graph.nodes.select(F.col(graph.id_col).alias("id"))
    both = a.union(a.select(F.col("target"), F.col("source"), "w")).groupBy(F.col("source").alias("id"), F.col("target").alias("other")).agg(F.sum("w").alias("w"))
    both, _ = stored(both)
    begin = F.lit(1.0) + F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 10_000_030
    state, seen = stored(ids.select("id", F.array(begin).alias("q")), norm=F.sum(F.col("q")[0] * F.col("q")[0]))
    scale, value = float(np.sqrt(seen["norm"] or 1.0)), 0.0
    basis = F.array(F.col("q")[0] / scale)  # of a row of state
    for _ in range(rounds):
        diagonal, beside = [], []
        combined = None
        for k in range(STEPS):
            held = state.select("id", basis.alias("q"))
            sent = both.join(held.select(F.col("id").alias("other"), F.col("q")[k].alias("x")), "other").groupBy("id").agg(F.sum(F.col("w") * F.col("x")).alias("y"))
            joined = held.join(sent, "id", "left").select("id", "q", F.coalesce("y", F.lit(0.0)).alias("y"))
            q = [F.col("q")[i] for i in range(k + 1)]
            new, seen = stored(joined, size=F.sum(F.col("y") * F.col("y")), **{f"h{i}": F.sum(q[i] * F.col("y")) for i in range(k + 1)})
            discard(state)
            state = new
            first = [seen[f"h{i}"] or 0.0 for i in range(k + 1)]
            rest = F.col("y") - sum((F.lit(h) * c for h, c in zip(first, q, strict=True)), F.lit(0.0))
            again = state.agg(F.sum(rest * rest).alias("size"), *[F.sum(q[i] * rest).alias(f"h{i}") for i in range(k + 1)]).first()
            second = [again[f"h{i}"] or 0.0 for i in range(k + 1)]
            diagonal.append(first[k] + second[k])
            left = float(np.sqrt(max((again["size"] or 0.0) - sum(h * h for h in second), 0.0)))
            value, part = _leading(diagonal, beside)
            beside.append(left)
            combined = sum((F.lit(float(p)) * c for p, c in zip(part, q, strict=True)), F.lit(0.0))
            if left * abs(part[-1]) <= tolerance * max(abs(value), 1e-300) or left <= 1e-13 * max(abs(value), 1e-300):
                break
            rest = rest - sum((F.lit(h) * c for h, c in zip(second, q, strict=True)), F.lit(0.0))
            basis = F.array(*q, rest / left)
        else:
            state, seen = stored(state.select("id", combined.alias("x")), norm=F.sum(F.col("x") * F.col("x")))
            basis = F.array(F.col("x") / float(np.sqrt(seen["norm"])))
            continue
        break
    else:
        raise RuntimeError(f"the leading eigenvector has not settled in {rounds} rounds: give more, or a larger tolerance")
    found, seen = stored(state.select("id", combined.alias("x")), top=F.max_by("x", F.struct(F.round(F.abs("x"), 9), "x")))
    discard(state, both)
    if not value:  # no edge of any weight
        return found.select(F.col("id").alias(graph.id_col), F.lit(0.0).alias("_key"))
    return found.select(F.col("id").alias(graph.id_col), F.round(F.col("x") * F.lit(1.0 if (seen["top"] or 1.0) > 0 else -1.0), 12).alias("_key"))
