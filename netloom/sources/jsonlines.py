"""Graphs as lines of JSON, in each of pandas' layouts, written and read without the driver.

Each line is what to_dict() would give for some hundred rows of one of the two tables, and can be read alone.  Values
are read as VARIANT; the types of columns are those that hold all values, or given as a schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.fixpoint import settled

ORIENTS = ("dict", "index", "records", "split", "tight")
ROWS = 256
"""Rows of a line."""


def _value(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    return F.when(~F.isnan(c), c) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else c


def _layout(orient: str, fields: list[T.StructField]) -> Column:
    """The rows of a group, from columns key and r (the values in fields)."""
    names = [f.name for f in fields]
    row = lambda name: F.col("r")[name]
    if orient == "records":
        return F.collect_list("r")
    if orient == "index":
        return F.map_from_entries(F.collect_list(F.struct(F.col("key").cast("string"), "r")))
    if orient == "dict":
        return F.struct(*[F.map_from_entries(F.collect_list(F.struct(F.col("key").cast("string"), row(c)))).alias(c) for c in names])
    # one list of pairs keeps keys beside their values
    both = F.collect_list(F.struct("key", F.array(*[row(c).cast("variant") for c in names]).alias("values")))
    parts = [both["key"].alias("index"), F.array(*map(F.lit, names)).alias("columns"), both["values"].alias("data")]
    if orient == "tight":
        parts += [F.array(F.lit(None).cast("string")).alias("index_names"), F.array(F.lit(None).cast("string")).alias("column_names")]
    return F.struct(*parts)


def _lines(df: DataFrame, part: str, orient: str, directed: bool, id_col: str | None) -> DataFrame:
    fields = [f for f in df.schema if f.name != id_col or orient == "records"]
    if not fields and orient == "dict":
        raise ValueError("nodes without columns have no place in this layout: take another orient")
    number = F.monotonically_increasing_id()
    rows = df.select(number.alias("key") if id_col is None else F.col(f"`{id_col}`").alias("key"), F.floor(number / ROWS).alias("line"), F.struct(*[_value(f).alias(f.name) for f in fields]).alias("r") if fields else F.expr("named_struct()").alias("r"))
    told = rows.groupBy("line").agg(_layout(orient, fields).alias(part))
    return told.select(F.to_json(F.struct(F.lit(directed).alias("directed"), part), {"ignoreNullFields": "false"}).alias("line"))


def write_lines(graph, orient: str = "records") -> DataFrame:
    """(line) for both tables, to be written as text.

    Missing numbers are null.  Edges have numbers as their index, unique but with gaps.  Equal edges stay apart.  A table
    without rows has no line.
    """
    if orient not in ORIENTS:
        raise ValueError(f"orient must be one of {ORIENTS}")
    # numbers given to rows of a written table don't change when a task runs again
    return _lines(settled(graph.nodes), "nodes", orient, graph.directed, graph.id_col).unionByName(_lines(settled(graph.edges), "edges", orient, graph.directed, None))


def _rows(lines: DataFrame, part: str, orient: str) -> DataFrame:
    """(key, m): a row's index, null for records, and its values by column."""
    took = lambda kind, at="": F.expr(f"variant_get(v, '$.{part}{at}', '{kind}')")
    some = lines.select(F.parse_json("line").alias("v")).where(took("variant").isNotNull())
    if orient == "records":
        return some.select(F.lit(None).cast("variant").alias("key"), F.explode(took("array<map<string,variant>>")).alias("m"))
    if orient == "index":
        return some.select(F.explode(took("map<string,map<string,variant>>")).alias("key", "m")).withColumn("key", F.col("key").cast("variant"))
    if orient == "dict":
        whole = some.select(took("map<string,map<string,variant>>").alias("x"))
        keys = F.array_distinct(F.flatten(F.transform(F.map_values("x"), F.map_keys)))
        pick = lambda key: F.struct(key.alias("key"), F.transform_values("x", lambda _, column: column[key]).alias("m"))
        return whole.select(F.inline(F.transform(keys, pick))).withColumn("key", F.col("key").cast("variant"))
    whole = some.select(took("array<string>", ".columns").alias("columns"), F.arrays_zip(took("array<variant>", ".index").alias("index"), took("array<array<variant>>", ".data").alias("data")).alias("xs"))
    return whole.select("columns", F.explode("xs").alias("x")).select(F.col("x.index").alias("key"), F.map_from_arrays("columns", "x.data").alias("m"))


def _kind(found: str | None) -> str:
    """A column type for what schema_of_variant_agg() says: fractions are doubles, and what is not plain stays as it is."""
    if found is None or found.startswith("DECIMAL"):
        return "double" if found else "string"
    if found == "VOID":
        return "string"
    return "variant" if found.startswith(("OBJECT", "ARRAY")) else found.lower()


def _kinds(rows: DataFrame, schema: str | T.StructType | None) -> dict[str, T.DataType | str]:
    """Types by column, ascending: given, or found in one pass over all rows."""
    if schema is not None:
        given = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return {f.name: f.dataType for f in given}
    found = rows.select(F.explode("m").alias("c", "v")).groupBy("c").agg(F.schema_of_variant_agg("v").alias("kind"))
    return {r["c"]: _kind(r["kind"]) for r in found.orderBy("c").collect()}


def read_lines(lines: DataFrame, orient: str = "records", id_col: str = "id", directed: bool | None = None, nodes_schema=None, edges_schema=None, **options):
    """The graph of lines (a column line), as write_lines() or to_json() gives them.

    Where the layout has ids as names or index, they get the type of edges' source, if there is an edge.  A schema gives
    columns and types, and spares a pass over the lines.  directed is that of the lines unless given.
    """
    from ..frame import GraphTable

    orient = "dict" if orient == "columns" else orient
    if orient not in ORIENTS:
        raise ValueError(f"orient must be one of {ORIENTS}")
    if directed is None:
        first = lines.select(F.expr("try_variant_get(parse_json(line), '$.directed', 'boolean')").alias("directed")).first()
        directed = first is None or first["directed"] is not False
    near, far = _rows(lines, "nodes", orient), _rows(lines, "edges", orient)
    ends = _kinds(far, edges_schema)
    ends = {c: ends.get(c, "string") for c in ("source", "target")} | ends
    kinds = _kinds(near, nodes_schema)
    own = kinds.pop(id_col, ends["source"])
    ids = F.col("m")[id_col] if orient == "records" else F.col("key")
    pick = lambda c, kind: F.col("m")[c].cast(kind).alias(c)
    nodes = near.select(ids.cast(own).alias(id_col), *[pick(c, kind) for c, kind in kinds.items()])
    edges = far.select(*[pick(c, kind) for c, kind in ends.items()])
    return GraphTable(nodes, edges, directed=directed, id_col=id_col, **options)
