"""Queries over the test tables for each graph operator, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import GraphTable
from .operators.khop import aggregate_over_pairs
from .plans.fixpoint import settled
from .sources.jsonlines import ORIENTS


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def trade(spark: SparkSession, d: str) -> GraphTable:
    """Nations; an edge from the supplier's to the customer's nation for each line item."""
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("source"))
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("target"))
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    edges = _t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_quantity").alias("weight")).join(s, "l_suppkey").join(o, "l_orderkey").join(c, "o_custkey").select("source", "target", "weight")
    return GraphTable(_t(spark, d, "nation").withColumnRenamed("n_nationkey", "id"), edges, validate=False)


def supply(spark: SparkSession, d: str, whole: bool = False) -> GraphTable:
    """Suppliers and parts; an edge for each pair that a line item joins: any one if whole, else a discounted full-quantity one."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    items = _t(spark, d, "lineitem")
    edges = (items if whole else items.where("l_quantity = 50 and l_discount = 0.1")).select(name("S", "l_suppkey").alias("source"), name("P", "l_partkey").alias("target")).distinct()
    nodes = _t(spark, d, "supplier").select(name("S", "s_suppkey").alias("id")).union(_t(spark, d, "part").select(name("P", "p_partkey")))
    return GraphTable(nodes, edges, validate=False)


def transitions(spark: SparkSession, d: str, strong: bool = False) -> GraphTable:
    """Users; an edge where one user's purchase is followed by another one's error."""
    e = _t(spark, d, "events")
    a = e.where("event_type = 'purchase'" + (" and value > 20" if strong else "")).select((F.col("event_id") + 1).alias("event_id"), F.col("user_id").alias("source"), F.col("value").alias("weight"))
    b = e.where("event_type = 'error'").select("event_id", F.col("user_id").alias("target"))
    users = e.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("event_type").alias("n_types"))
    return GraphTable(users, a.join(b, "event_id").select("source", "target", "weight"), validate=False)


G1 = """nodes as (select n_nationkey as id, n_name, n_regionkey from nation),
edges as (select s_nationkey as source, c_nationkey as target, l_quantity as weight from lineitem join supplier on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey)"""


def _g2(some: str = " where l_quantity = 50 and l_discount = 0.1") -> str:
    return f"""nodes as (select 'S' || s_suppkey as id from supplier union all select 'P' || p_partkey from part),
edges as (select distinct 'S' || l_suppkey as source, 'P' || l_partkey as target from lineitem{some})"""


G2, G2W = _g2(), _g2("")


def _g3(more: str = "") -> str:
    return f"""nodes as (select user_id as id, count(*)::bigint as n_events, count(distinct event_type)::bigint as n_types from events group by user_id),
edges as (select e1.user_id as source, e2.user_id as target, e1.value as weight from events e1 join events e2 on e2.event_id = e1.event_id + 1 where e1.event_type = 'purchase' and e2.event_type = 'error'{more})"""


G3, G3S = _g3(), _g3(" and e1.value > 20")
BOTH = "step as (select source as s, target as t from edges union select target, source from edges)"
ONE = "step as (select distinct source as s, target as t from edges)"
REACH = "reach as (select id as a, id as b from nodes union select reach.a, step.t from reach join step on step.s = reach.b)"
ROOTS = "roots as (select a as id, min(b) as root from reach group by a)"
START = 7


def _hops(k: int) -> str:
    return f"walk as (select id as a, id as b, 0 as h from nodes union select walk.a, step.t, h + 1 from walk join step on step.s = walk.b where h < {k}), near as (select a as id, b as neighbor, min(h) as hop from walk group by a, b)"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


ENTRIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        ENTRIES[f.__name__] = (f, sql)
        return f

    return add


def _condensed(how: str, agg: str, name: str):
    def run(spark, d):
        g = trade(spark, d)
        return (g.condense("n_regionkey") if how == "size" else g.condense("n_regionkey", how, columns="weight")).edges

    run.__name__ = f"condense_{name}"
    query(f"with {G1} select a.n_regionkey as source, b.n_regionkey as target, {agg} as weight from edges join nodes a on a.id = source join nodes b on b.id = target group by 1, 2")(run)


for _how, _agg in (("sum", "sum(weight)"), ("size", "count(*)"), ("mean", "round(avg(weight), 4)"), ("max", "max(weight)"), ("min", "min(weight)"), ("any", "bool_or(weight <> 0)")):
    _condensed(_how, _agg, _how)
_mean = ENTRIES["condense_mean"][0]
ENTRIES["condense_mean"] = (lambda spark, d: _rounded(_mean(spark, d)), ENTRIES["condense_mean"][1])


@query(f"with {G1} select distinct n_regionkey as id from nodes")
def condense_nodes(spark, d):
    return trade(spark, d).condense("n_regionkey").nodes


@query(f"with {G1} select a.n_regionkey as source_n_regionkey, b.n_regionkey as target_n_regionkey, count(*) as size from edges join nodes a on a.id = source join nodes b on b.id = target group by 1, 2")
def size_edges(spark, d):
    return trade(spark, d).groupby_nodes("n_regionkey").size_edges()


@query(f"with {G1} select a.n_regionkey as source_n_regionkey, b.n_regionkey as target_n_regionkey, sum(weight) as weight from edges join nodes a on a.id = source join nodes b on b.id = target group by 1, 2")
def apply_edges_sum(spark, d):
    return trade(spark, d).groupby_nodes("n_regionkey").apply_edges("sum", "weight")


@query(f"with {G1} select a.n_regionkey as source_n_regionkey, b.n_regionkey as target_n_regionkey, max(weight) - min(weight) as weight from edges join nodes a on a.id = source join nodes b on b.id = target group by 1, 2")
def apply_edges_callable(spark, d):
    return trade(spark, d).groupby_nodes("n_regionkey").apply_edges(lambda s: s.max() - s.min(), "weight")


@query(f"with {G1} select count(distinct n_regionkey) * count(distinct n_regionkey) as n from nodes")
def groupby_len(spark, d):
    g = trade(spark, d)
    return spark.createDataFrame([(len(g.groupby_nodes("n_regionkey")),)], "n long")


@query(f"with {G1} select n_regionkey, id from nodes")
def groups(spark, d):
    return trade(spark, d).groupby_nodes("n_regionkey", axis="source").members("source")


@query(f"with {G1} select a.k as source_key, b.k as target_key, count(e.source) as n_edges from (select distinct n_regionkey as k from nodes) a cross join (select distinct n_regionkey as k from nodes) b left join (select x.n_regionkey as s, y.n_regionkey as t, source from edges join nodes x on x.id = source join nodes y on y.id = target) e on e.s = a.k and e.t = b.k group by 1, 2")
def groupby_iter_pairs(spark, d):
    out = None
    for (s, t), part in trade(spark, d).groupby_nodes("n_regionkey"):
        one = part.edges.agg(F.count(F.lit(1)).alias("n_edges")).select(F.lit(s).alias("source_key"), F.lit(t).alias("target_key"), "n_edges")
        out = one if out is None else out.union(one)
    return out


@query(f"with {G1} select n_regionkey, count(*) as n_edges from edges join nodes on id = source group by 1")
def groupby_iter_source(spark, d):
    out = None
    for key, part in trade(spark, d).groupby_nodes("n_regionkey", axis="source"):
        one = part.edges.agg(F.count(F.lit(1)).alias("n_edges")).select(F.lit(key).alias("n_regionkey"), "n_edges")
        out = one if out is None else out.union(one)
    return out


RED = "n_regionkey in (1, 2) and n_name <> 'NATION_7'"


@query(f"with {G1} select * from nodes where {RED}")
def query_nodes(spark, d):
    return trade(spark, d).query_nodes("n_regionkey in [1, 2] and n_name != 'NATION_7'").nodes


@query(f"with {G1}, k as (select id from nodes where {RED}) select * from edges where source in (from k) and target in (from k)")
def query_nodes_edges(spark, d):
    return trade(spark, d).query_nodes("n_regionkey in [1, 2] & ~(n_name == @name)", local_dict={"name": "NATION_7"}).edges


@query(f"with {G1} select * from edges where weight > 10 and weight < 30 and source % 3 = 1 or target = 4")
def query_edges(spark, d):
    return trade(spark, d).query_edges("10 < weight < 30 & source % 3 == 1 | target == 4").edges


@query(f"with {G3}, busy as (select user_id from events where event_type = 'error' group by 1 having count(*) > 16) select * from nodes where id in (from busy) or n_types < 3")
def query_nodes_in_table(spark, d):
    g = transitions(spark, d)
    busy = _t(spark, d, "events").where("event_type = 'error'").groupBy("user_id").count().where("count > 16").select("user_id")
    return g.query_nodes("index in @busy or n_types < 3", local_dict={"busy": busy}).nodes


@query(f"with {G1} select * from edges where weight between 10 and 20 and (source + target) % 2 = 0")
def query_edges_sql(spark, d):
    return trade(spark, d).query_edges("weight >= 10", sql="weight <= 20 and (source + target) % 2 = 0").edges


@query(f"with {G1} select * from edges where source not in (1, 2, 3) and target not in (1, 2, 3)")
def remove_nodes(spark, d):
    return trade(spark, d).remove_nodes([1, 2, 3]).edges


@query(f"with {G3} select * from edges e where not exists (select 1 from edges f where f.weight > 50 and f.source = e.source and f.target = e.target)")
def remove_edges(spark, d):
    g = transitions(spark, d)
    return g.remove_edges(g.edges.where("weight > 50")).edges


@query(f"with {G1} select id, n_name, n_regionkey, null::int as r_regionkey from nodes union all select 100 + r_regionkey, null, null, r_regionkey from region")
def add_nodes(spark, d):
    return trade(spark, d).add_nodes(_t(spark, d, "region").select((F.col("r_regionkey") + 100).alias("id"), "r_regionkey")).nodes


@query(f"with {G1} select source, target, weight from edges union all select n_nationkey, n_regionkey, null from nation")
def add_edges(spark, d):
    return trade(spark, d).add_edges(_t(spark, d, "nation").select(F.col("n_nationkey").alias("source"), F.col("n_regionkey").alias("target"))).edges


@query(f"with {G1}, i as (select unnest([3, 1, 99]) as id) select i.id, n_name, n_regionkey from i left join nodes on nodes.id = i.id")
def reindex_nodes(spark, d):
    return trade(spark, d).reindex_nodes([3, 1, 99]).nodes


@query(f"with {G2} select id from nodes where id in (select source from edges union select target from edges)")
def remove_unused_nodes(spark, d):
    return supply(spark, d).remove_unused_nodes().nodes


@query(f"with {G1} select * from edges where source in (1, 2, 3) and target in (3, 4)")
def loc_edges(spark, d):
    return trade(spark, d).loc[[1, 2, 3], [3, 4]].edges


@query(f"with {G1} select * from nodes where id in (1, 2, 3, 4)")
def loc_nodes(spark, d):
    return trade(spark, d).loc[[1, 2, 3], [3, 4]].nodes


@query(f"with {G1}, p as (select *, row_number() over (order by id) - 1 as k from nodes) select edges.* from edges where source in (select id from p where k between 2 and 7) and target in (select id from p where k between 2 and 7)")
def loc_slice(spark, d):
    return trade(spark, d).loc[2:8, 2:8].edges


def _features(axis: str):
    names = {"source": ["source"], "target": ["target"], "both": ["source", "target"]}[axis]

    def run(spark, d):
        return trade(spark, d).apply_node_features(["n_regionkey", "n_name"], axis=axis).edges

    run.__name__ = f"apply_node_features_{axis}"
    more = ", ".join(f"{s}_n.{c} as {s}_{c}" for s in names for c in ("n_regionkey", "n_name"))
    query(f"with {G1} select edges.*, {more} from edges " + " ".join(f"left join nodes {s}_n on {s}_n.id = {s}" for s in names))(run)


for _axis in ("source", "target", "both"):
    _features(_axis)


@query(f"with {G2} select avg(case when id in (select source from edges union select target from edges) then 1.0 else 0.0 end)::double as agreement from nodes")
def node_agreement(spark, d):
    g = supply(spark, d)
    return g.node_agreement_table(g.remove_unused_nodes())


@query(f"with {G1} select source, target, sum(weight) as value from edges group by 1, 2")
def to_adjacency_long(spark, d):
    return trade(spark, d).to_adjacency_long()


@query(f"with {G1} select id as source, " + ", ".join(f'coalesce((select sum(weight) from edges where source = id and target = {k}), 0)::double as "{k}"' for k in range(25)) + " from nodes")
def to_adjacency_wide(spark, d):
    return trade(spark, d).to_adjacency()


@query(f"with {G3}, p as (select id, row_number() over (order by id) - 1 as k from nodes) select a.k as row, b.k as col, count(*) as value from edges join p a on a.id = source join p b on b.id = target group by 1, 2")
def to_sparse_coo(spark, d):
    return transitions(spark, d).to_coordinates()


@query(f"with {G3}, p as (select id, row_number() over (order by id) - 1 as k from nodes), d as (select source, count(distinct target) as n from edges where target in (select id from nodes) group by 1) select k as row, coalesce(sum(coalesce(n, 0)) over (order by k rows between unbounded preceding and 1 preceding), 0)::bigint as start from p left join d on source = id union all select (select count(*) from p), (select sum(n) from d)::bigint")
def csr_indptr(spark, d):
    return transitions(spark, d).to_csr().indptr


@query(f"with {G3}, p as (select id, row_number() over (order by id) - 1 as k from nodes), c as (select a.k as row, b.k as col, count(*) as value from edges join p a on a.id = source join p b on b.id = target group by 1, 2) select row_number() over (order by row, col) - 1 as at, col, value from c")
def csr_cells(spark, d):
    return transitions(spark, d).to_csr().cells


@query(f"with {G1}, p as (select id, row_number() over (order by id) - 1 as k from nodes), c as (select source, target, sum(weight) as w from edges group by 1, 2) select a.id as source, b.k // 10 as block, b.k % 10 as place, coalesce(w, 0)::double as value from p a cross join p b left join c on c.source = a.id and c.target = b.id")
def adjacency_blocks(spark, d):
    return trade(spark, d).to_adjacency_blocks(width=10).select("source", "block", F.posexplode("cells").alias("place", "value"))


_INDEX = f"with {G3}, p as (select id, row_number() over (order by id) - 1 as k from nodes), x as (select a.k as src_pos, b.k as dst_pos, weight from edges join p a on a.id = source join p b on b.id = target) select * from x"


@query(_INDEX)
def torch_edge_index(spark, d):
    return transitions(spark, d).to_edge_index(True, "weight")


@query(_INDEX + " union all select dst_pos, src_pos, weight from x")
def torch_edge_index_undirected(spark, d):
    return transitions(spark, d).to_edge_index(False, "weight")


@query(f"with {G3}, p as (select *, row_number() over (order by id) - 1 as _pos from nodes) select _pos, n_events::double as x0, n_types::double as x1 from p")
def torch_node_matrix(spark, d):
    return transitions(spark, d).to_node_matrix().select("_pos", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"))


@query(None)
def edges_json(spark, d):
    return supply(spark, d, whole=True).edges_json()


# Over all line items and all transitions; the closure in SQL is too slow there.
@query(f"with {G2W} select id from nodes where id in (select source from edges union select target from edges)")
def remove_unused_nodes_whole(spark, d):
    return supply(spark, d, whole=True).remove_unused_nodes().nodes


@query(f"with {G2W} select avg(case when id in (select source from edges union select target from edges) then 1.0 else 0.0 end)::double as agreement from nodes")
def node_agreement_whole(spark, d):
    g = supply(spark, d, whole=True)
    return g.node_agreement_table(g.remove_unused_nodes())


@query(None)
def wcc_labels_whole(spark, d):
    return supply(spark, d, whole=True).label_nodes_by_component().nodes


@query(None)
def scc_labels_whole(spark, d):
    return transitions(spark, d).component_labels(connection="strong")


@query(None)
def sort_spectral(spark, d):
    return trade(spark, d).sort_spectral().positions().select("id", "_pos")


@query(f"with recursive {G2}, {BOTH}, {REACH}, {ROOTS} select id, (dense_rank() over (order by root) - 1)::bigint as component from roots")
def wcc_labels(spark, d):
    return supply(spark, d).label_nodes_by_component().nodes


@query(f"with recursive {G3}, {BOTH}, {REACH}, {ROOTS} select count(distinct root) as n from roots")
def n_wcc(spark, d):
    return spark.createDataFrame([(transitions(spark, d).n_connected_components(),)], "n long")


@query(f"with recursive {G3}, {BOTH}, {REACH}, {ROOTS} select count(distinct root) = 1 as connected from roots")
def is_fully_connected(spark, d):
    return spark.createDataFrame([(transitions(spark, d).is_fully_connected(),)], "connected boolean")


@query(f"with recursive {G3}, {BOTH}, {REACH}, {ROOTS}, top as (select root from roots group by root order by count(*) desc, root limit 1) select nodes.* from nodes join roots using (id) join top using (root)")
def lcc_nodes(spark, d):
    return transitions(spark, d).largest_connected_component().nodes


@query(f"with recursive {G3}, {BOTH}, {REACH}, {ROOTS} select (dense_rank() over (order by root) - 1)::bigint as component, count(*) as n from roots group by root")
def connected_components(spark, d):
    return transitions(spark, d).component_labels().groupBy("component").agg(F.count(F.lit(1)).alias("n"))


@query(f"with recursive {G3}, {BOTH}, {REACH}, {ROOTS} select (dense_rank() over (order by root) - 1)::bigint as component, count(distinct roots.id) as n_nodes, count(edges.source) as n_edges from roots left join edges on source = roots.id group by root")
def connected_components_each(spark, d):
    """Nodes and edges of each sub-graph that the component iterator gives."""
    out = None
    for k, part in enumerate(transitions(spark, d).connected_components()):
        rows = part.nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e")).union(part.edges.select(F.lit(0), F.lit(1)))
        one = rows.agg(F.sum("n").alias("n_nodes"), F.sum("e").alias("n_edges")).select(F.lit(k).cast("long").alias("component"), "n_nodes", "n_edges")
        out = one if out is None else out.union(one)
    return out


@query(f"with recursive {G3S}, {ONE}, {REACH}, roots as (select x.a as id, min(x.b) as root from reach x join reach y on y.a = x.b and y.b = x.a group by x.a) select id, (dense_rank() over (order by root) - 1)::bigint as component from roots")
def scc_labels(spark, d):
    return transitions(spark, d, strong=True).component_labels(connection="strong")


def _start(one: str) -> str:
    return f"with recursive {G3}, {one}, r as (select {START}::bigint as id union select step.t from r join step on step.s = r.id) select nodes.* from nodes join r using (id)"


@query(_start(ONE))
def reachable_from(spark, d):
    return transitions(spark, d).select_component_from_node(START).nodes


@query(_start(BOTH))
def reachable_from_undirected(spark, d):
    return transitions(spark, d).select_component_from_node(START, directed=False).nodes


@query(f"with recursive {G3}, {BOTH}, {_hops(2)}, k as (select neighbor from near where id = {START}) select * from edges where source in (from k) and target in (from k)")
def k_hop_neighborhood(spark, d):
    return transitions(spark, d).k_hop_neighborhood(START, 2).edges


@query(f"with recursive {G3}, {BOTH}, {_hops(2)} select * from near")
def k_hop_pairs(spark, d):
    return transitions(spark, d).k_hop_mask(2)


@query(f"with recursive {G3}, {ONE}, {_hops(2)} select * from near")
def k_hop_pairs_directed(spark, d):
    return transitions(spark, d).k_hop_mask(2, directed=True)


@query(f"with recursive {G3}, {BOTH}, {_hops(1)} select x.id as center, edges.* from edges join near x on x.neighbor = source join near y on y.neighbor = target and y.id = x.id")
def k_hop_decomposition(spark, d):
    return transitions(spark, d).k_hop_decomposition(1).edges


def _aggregated(one: str, k: int, zero: bool = True) -> str:
    wrap = (lambda x: f"coalesce({x}, 0)") if zero else (lambda x: x)
    cols = ", ".join(f"round({wrap(f'avg({c})')}, 4) as {c}_neighbor_mean, coalesce(sum({c}), 0)::bigint as {c}_neighbor_sum, round({wrap(f'stddev_samp({c})')}, 4) as {c}_neighbor_std" for c in ("n_events", "n_types"))
    return f"with recursive {G3}, {one}, {_hops(k)}, far as (select near.id as a, n_events, n_types from near join nodes on nodes.id = neighbor where near.id <> neighbor) select nodes.id, {cols} from nodes left join (select a, n_events, n_types from far) f on f.a = nodes.id group by nodes.id".replace("avg(n_", "avg(f.n_").replace("sum(n_", "sum(f.n_").replace("samp(n_", "samp(f.n_")


STATS = ["mean", "sum", "std"]


@query(_aggregated(BOTH, 2))
def k_hop_aggregation(spark, d):
    return _rounded(transitions(spark, d).k_hop_aggregation(2, STATS))


@query(_aggregated(ONE, 1))
def k_hop_aggregation_directed(spark, d):
    return _rounded(transitions(spark, d).k_hop_aggregation(1, STATS, directed=True))


@query(_aggregated(ONE, 1, zero=False))
def k_hop_aggregation_pandas(spark, d):
    return _rounded(transitions(spark, d).k_hop_aggregation(1, STATS, directed=True, engine="pandas"))


@query(_aggregated(BOTH, 1))
def aggregate_over_graph(spark, d):
    g = transitions(spark, d)
    return _rounded(aggregate_over_pairs(g.k_hop_mask(1), g.nodes, STATS))


@query("select true as equal")
def equality(spark, d):
    g = trade(spark, d)
    other = GraphTable(g.nodes.orderBy(F.desc("id")), g.edges.repartition(7), validate=False)
    return spark.createDataFrame([(g == other and g != g.query_nodes("id > 3"),)], "equal boolean")


LAYOUTS = ", ".join(f"('{x}')" for x in ORIENTS)


def _again(spark, d):
    """(layout, trade network read again from its lines in this layout)."""
    g = trade(spark, d)
    return [(x, GraphTable.from_json_lines(settled(g.to_json_lines(x)), x, validate=False)) for x in ORIENTS]


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


@query(f"with {G1} select layout, source::bigint as source, target::bigint as target, weight from edges, (values {LAYOUTS}) v(layout)")
def json_lines_edges(spark, d):
    return _all([g.edges.select(F.lit(x).alias("layout"), "source", "target", "weight") for x, g in _again(spark, d)])


@query(f"with {G1} select layout, id::bigint as id, n_name, n_regionkey::bigint as n_regionkey from nodes, (values {LAYOUTS}) v(layout)")
def json_lines_nodes(spark, d):
    return _all([g.nodes.select(F.lit(x).alias("layout"), "id", "n_name", "n_regionkey") for x, g in _again(spark, d)])


SHARD = 100
"""Nodes of a shard."""
PLACED = f"placed as (select *, row_number() over (order by id) - 1 as pos from nodes), ends as (select (s.pos // {SHARD})::int as shard, s.pos as src, t.pos as dst, weight from edges join placed s on s.id = source join placed t on t.id = target)"


@query(f"with {G3}, {PLACED} select * from ends")
def shard_edges(spark, d):
    """Edges of shards, with both ends' local numbers turned back into positions."""
    parts = transitions(spark, d).to_shards(SHARD, weight_col="weight")
    place = lambda end: parts.nodes.select("shard", F.col("local").alias(f"{end}_"), F.col("position").alias(end))
    return parts.edges.withColumnsRenamed({"src": "src_", "dst": "dst_"}).join(place("src"), ["shard", "src_"]).join(place("dst"), ["shard", "dst_"]).select("shard", "src", "dst", "weight")


@query(
    f"with {G3}, {PLACED}, held as (select (pos // {SHARD})::int as shard, pos, false as ghost from placed union select shard, dst, true from ends where dst // {SHARD} <> shard)"
    " select shard, row_number() over (partition by shard order by ghost, pos) - 1 as local, pos as position, ghost, n_events::double as n_events, n_types::double as n_types from held join placed using (pos)"
)
def shard_nodes(spark, d):
    nodes = transitions(spark, d).to_shards(SHARD).nodes
    return nodes.select("shard", "local", "position", "ghost", F.col("x")[0].alias("n_events"), F.col("x")[1].alias("n_types"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in ENTRIES.items() if s}
