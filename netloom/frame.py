"""GraphTable: a table of nodes and a table of edges, and what can be asked of them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import components, khop, matrix, subgraph
from .operators.grouping import NodeGroups, condense
from .plans.fixpoint import ranged, settled
from .sources import interop, jsonlines, shards


class GraphTable:
    """A graph: nodes (an id column and attributes) and edges (source, target and attributes).

    Tables are lazy and immutable.  A method with inplace=True rebinds this object's tables and returns None.  directed
    is kept for exports; algorithms have a parameter of that name.  sources and targets, if given, bound the rows and
    columns of matrices and groups.  Nodes are in ascending order of id unless an operation gave them another order.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, directed: bool = True, sources=None, targets=None, validate: bool = True, induced: bool = True, id_col: str = "id"):
        for table, column in ((nodes, id_col), (edges, "source"), (edges, "target")):
            if column not in table.columns:
                raise ValueError(f"there is no column {column!r}")
        self.nodes, self.edges, self.directed, self.id_col = nodes, edges, directed, id_col
        self._order: DataFrame | None = None
        self._sources = self._targets = None
        self._places: dict[str, DataFrame] = {}  # by side, once asked for
        if sources is not None:
            self._sources = subgraph.id_table(self, sources).withColumnRenamed("_id", id_col)
        if targets is not None:
            self._targets = subgraph.id_table(self, targets).withColumnRenamed("_id", id_col)
        if validate:
            self._validate()

    @classmethod
    def from_parquet(cls, spark: SparkSession, nodes: str, edges: str, **options) -> GraphTable:
        return cls(spark.read.parquet(nodes), spark.read.parquet(edges), **options)

    @classmethod
    def from_tables(cls, spark: SparkSession, nodes: str, edges: str, **options) -> GraphTable:
        return cls(spark.table(nodes), spark.table(edges), **options)

    @classmethod
    def from_dict(cls, data: dict, orient: str = "columns", index_dtype=None, spark: SparkSession | None = None, id_col: str = "id") -> GraphTable:
        return interop.from_dict(spark or SparkSession.active(), data, orient, index_dtype, id_col)

    def _validate(self) -> None:
        if not self.nodes.groupBy(self.id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).isEmpty():
            raise ValueError("Node IDs must be unique.")
        ids = self.nodes.select(F.col(self.id_col).alias("_id"))
        kinds = [kind.typeName() for kind in (ids.schema["_id"].dataType, self.edges.schema["source"].dataType, self.edges.schema["target"].dataType)]
        whole = {"byte", "short", "integer", "long"}  # ids of these may meet each other
        if len({"whole" if k in whole else k for k in kinds}) > 1:
            raise ValueError("edge ends and node ids are of different types")
        if not subgraph.touched(self.edges).join(ids, "_id", "left_anti").limit(1).isEmpty():
            raise ValueError("an edge's source or target is no node")

    def _replace(self, nodes: DataFrame | None = None, edges: DataFrame | None = None, order: list | DataFrame | None = None) -> GraphTable:
        out = object.__new__(type(self))
        out.__dict__.update(self.__dict__)
        out.nodes = self.nodes if nodes is None else nodes
        out.edges = self.edges if edges is None else edges
        if isinstance(order, list):
            kind = self.nodes.schema[self.id_col].dataType.simpleString()
            order = self.nodes.sparkSession.createDataFrame([(v, k) for k, v in enumerate(order)], f"`{self.id_col}` {kind}, _key long")
        out._order = self._order if order is None else order
        out._places = self._places if nodes is None and order is None else {}
        return out

    def _give(self, inplace: bool, out: GraphTable) -> GraphTable | None:
        if not inplace:
            return out
        self.__dict__.update(out.__dict__)
        return None

    def _induced(self, nodes: DataFrame) -> GraphTable:
        return self._replace(nodes=nodes, edges=subgraph.induced(self.edges, nodes.select(self.id_col)))

    # identity

    @property
    def induced(self) -> bool:
        return self._sources is None and self._targets is None

    def _some(self, ids: DataFrame | None) -> DataFrame:
        return self.nodes if ids is None else self.nodes.join(ids, self.id_col, "left_semi")

    source_nodes = property(lambda self: self._some(self._sources))
    target_nodes = property(lambda self: self._some(self._targets))
    sources = property(lambda self: self.source_nodes.select(self.id_col))
    targets = property(lambda self: self.target_nodes.select(self.id_col))

    def positions(self) -> DataFrame:
        """nodes with _pos, their place in the node order; sorted and written once for these nodes."""
        if "all" not in self._places:
            if self._order is None:
                self._places["all"] = matrix.positions_of(self.nodes, self.id_col, [])
            else:
                self._places["all"] = matrix.positions_of(self.nodes.join(self._order, self.id_col, "left"), self.id_col, ["_key"]).drop("_key")
        return self._places["all"]

    def _placed(self, side: str) -> DataFrame:
        ids = self._sources if side == "source" else self._targets
        if ids is None:
            return self.positions()
        if side not in self._places:
            whole = self.positions().join(ids, self.id_col, "left_semi").withColumnRenamed("_pos", "_key")
            self._places[side] = matrix.positions_of(whole, self.id_col, ["_key"]).drop("_key")
        return self._places[side]

    def shape(self) -> dict[str, tuple[int, int]]:
        return {"nodes": (self.nodes.count(), len(self.nodes.columns) - 1), "edges": (self.edges.count(), len(self.edges.columns))}

    def __repr__(self) -> str:
        s = self.shape()
        return f"{type(self).__name__}(nodes={s['nodes']}, edges={s['edges']})"

    def __len__(self) -> int:
        return self.nodes.count()

    def deepcopy(self) -> GraphTable:
        return self._replace()

    def get_public_attributes(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __eq__(self, other) -> bool:
        """Equal columns and equal multisets of rows; the order of rows and directed do not count."""
        if not isinstance(other, GraphTable) or self.id_col != other.id_col:
            return False
        for a, b in ((self.nodes, other.nodes), (self.edges, other.edges)):
            if [(f.name, f.dataType) for f in a.schema] != [(f.name, f.dataType) for f in b.schema]:
                return False
            if not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()):
                return False
        return True

    def __ne__(self, other) -> bool:
        return not self == other

    __hash__ = None

    # selections

    loc = property(subgraph.Loc)

    def query_nodes(self, expr=None, inplace: bool = False, local_dict=None, global_dict=None, engine=None, parser=None, sql: str | None = None) -> GraphTable | None:
        """Nodes on which a query string (or a Column) holds, and the edges among them; engine and parser change nothing.

        sql is a condition in Spark SQL, beside expr or alone.  A name in @name may be a list of any length, or a table,
        whose first column is the list; both are joined.
        """
        return self._give(inplace, self._induced(subgraph.chosen(self, self.nodes, expr, local_dict, global_dict, True, sql)))

    def query_edges(self, expr=None, inplace: bool = False, local_dict=None, global_dict=None, engine=None, parser=None, sql: str | None = None) -> GraphTable | None:
        """Edges on which expr and sql hold, and all nodes."""
        return self._give(inplace, self._replace(edges=subgraph.chosen(self, self.edges, expr, local_dict, global_dict, False, sql)))

    def remove_nodes(self, nodes, inplace: bool = False, errors: str = "raise") -> GraphTable | None:
        ids = subgraph.id_table(self, nodes)
        if errors == "raise":
            subgraph.require(self, ids)
        kept = self.nodes.join(ids.withColumnRenamed("_id", self.id_col), self.id_col, "left_anti")
        edges = self.edges.join(ids.withColumnRenamed("_id", "source"), "source", "left_anti").join(ids.withColumnRenamed("_id", "target"), "target", "left_anti")
        return self._give(inplace, self._replace(nodes=kept, edges=edges.select(self.edges.columns)))

    def remove_edges(self, edges: DataFrame, inplace: bool = False) -> GraphTable | None:
        """All parallel edges of each (source, target) in edges go."""
        out = self.edges.join(edges.select("source", "target").distinct(), ["source", "target"], "left_anti").select(self.edges.columns)
        return self._give(inplace, self._replace(edges=out))

    def add_nodes(self, nodes: DataFrame, inplace: bool = False) -> GraphTable | None:
        return self._give(inplace, self._replace(nodes=self.nodes.unionByName(nodes, allowMissingColumns=True)))

    def add_edges(self, edges: DataFrame, inplace: bool = False) -> GraphTable | None:
        return self._give(inplace, self._replace(edges=self.edges.unionByName(edges, allowMissingColumns=True)))

    def reindex_nodes(self, index, inplace: bool = False) -> GraphTable | None:
        """Nodes become index, in its order; ids that were none get null attributes."""
        ids = subgraph.id_table(self, index).withColumnRenamed("_id", self.id_col)
        nodes = ids.join(self.nodes, self.id_col, "left").select(self.nodes.columns)
        out = self._replace(nodes=nodes, edges=subgraph.induced(self.edges, ids), order=None if isinstance(index, (DataFrame, slice)) else list(dict.fromkeys(index)))
        return self._give(inplace, out)

    def remove_unused_nodes(self, inplace: bool = False) -> GraphTable | None:
        used = subgraph.touched(self.edges).withColumnRenamed("_id", self.id_col)
        return self._give(inplace, self._replace(nodes=self.nodes.join(used, self.id_col, "left_semi")))

    def node_agreement(self, other: GraphTable) -> float | None:
        return self.node_agreement_table(other).first()[0]

    def node_agreement_table(self, other: GraphTable) -> DataFrame:
        """The share of this graph's ids that other has; null if there are none."""
        theirs = other.nodes.select(F.col(other.id_col).alias(self.id_col)).distinct().withColumn("_there", F.lit(1))
        return self.nodes.select(self.id_col).join(theirs, self.id_col, "left").agg(F.avg(F.col("_there").isNotNull().cast("double")).alias("agreement"))

    # features, groups

    def apply_node_features(self, columns, axis: str = "both", inplace: bool = False) -> GraphTable | None:
        """Node columns as edge columns source_<column> and target_<column>; existing ones are overwritten."""
        columns = [columns] if isinstance(columns, str) else list(columns)
        if axis not in ("source", "target", "both"):
            raise ValueError("axis must be 'source', 'target' or 'both'")
        sides = ["source", "target"] if axis == "both" else [axis]
        new = [f"{s}_{c}" for s in sides for c in columns]
        edges = self.edges.drop(*new)
        for s in sides:
            edges = edges.join(self.nodes.select(F.col(self.id_col).alias(s), *[F.col(c).alias(f"{s}_{c}") for c in columns]), s, "left")
        order = [*self.edges.columns, *[c for c in new if c not in self.edges.columns]]
        return self._give(inplace, self._replace(edges=edges.select(order)))

    def groupby_nodes(self, by, axis="both", induced: bool = False, sort: bool = True, dropna: bool = True) -> NodeGroups:
        return NodeGroups(self, by, axis, induced, sort, dropna)

    def condense(self, by, func="size", weight_name: str = "weight", columns=None) -> GraphTable:
        return condense(self, by, func, weight_name, columns)

    # components and neighbourhoods

    def component_labels(self, directed: bool = True, connection: str = "weak") -> DataFrame:
        return components.labels(self, directed, connection)

    def label_nodes_by_component(self, name: str = "component", inplace: bool = False, directed: bool = True, connection: str = "weak") -> GraphTable | None:
        found = self.component_labels(directed, connection).withColumnRenamed("component", "_component")
        nodes = self.nodes.join(found, self.id_col).withColumn(name, F.col("_component").cast("long")).drop("_component")
        return self._give(inplace, self._replace(nodes=nodes))

    def n_connected_components(self, directed: bool = True, connection: str = "weak") -> int:
        return components.roots(self, directed, connection).select("root").distinct().count()

    def is_fully_connected(self, directed: bool = True, connection: str = "weak") -> bool:
        return self.n_connected_components(directed, connection) == 1

    def largest_connected_component(self, directed: bool = True, connection: str = "weak", inplace: bool = False, verbose: bool = False) -> GraphTable | None:
        """The component with the most nodes; of several, the one of the least id."""
        found = settled(components.roots(self, directed, connection))
        top = found.groupBy("root").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "root").first()
        if top is None:
            raise ValueError("an empty graph has no component")
        ids = found.where(F.col("root") == F.lit(top["root"])).select(F.col("id").alias(self.id_col))
        out = self._induced(self.nodes.join(ids, self.id_col, "left_semi"))
        if verbose:
            print(f"{len(self) - top['n']} nodes removed")
        return self._give(inplace, out)

    def connected_components(self, directed: bool = True, connection: str = "weak") -> Iterator[GraphTable]:
        """A lazy sub-graph for each component, in label order.

        Nodes and edges are joined with their labels once, and written in order of label; a sub-graph is a stretch of both.
        """
        found = settled(self.component_labels(directed, connection).select(F.col(self.id_col).alias("_id"), F.col("component").alias("_label")))
        nodes = ranged(self.nodes.join(found.withColumnRenamed("_id", self.id_col), self.id_col).select(*self.nodes.columns, "_label"), "_label")
        ends = self.edges.join(found.select(F.col("_id").alias("source"), "_label"), "source").join(found.select(F.col("_id").alias("target"), F.col("_label").alias("_other")), "target").where("_label = _other")
        edges = ranged(ends.select(*self.edges.columns, "_label"), "_label")
        for r in found.select("_label").distinct().orderBy("_label").toLocalIterator():
            own = F.col("_label") == r[0]
            yield self._replace(nodes=nodes.where(own).select(self.nodes.columns), edges=edges.where(own).select(self.edges.columns))

    def select_component_from_node(self, node_id, directed: bool = True, inplace: bool = False) -> GraphTable | None:
        """All that node_id reaches: along edges where directed, else its weak component."""
        ids = components.reached(self, node_id, directed).select(F.col("id").alias(self.id_col))
        return self._give(inplace, self._induced(self.nodes.join(ids, self.id_col, "left_semi")))

    def k_hop_neighborhood(self, node_id, k: int, directed: bool = False) -> GraphTable:
        if k < 0:
            raise ValueError("k must be 0 or more")
        ids = components.within_hops(self, node_id, directed, k).select(F.col("id").alias(self.id_col))
        return self._induced(self.nodes.join(ids, self.id_col, "left_semi"))

    def k_hop_mask(self, k: int, directed: bool = False) -> DataFrame:
        """The true cells of the mask: (id, neighbor, hop)."""
        return khop.pairs(self, k, directed)

    def k_hop_decomposition(self, k: int, directed: bool = False) -> khop.Neighborhoods:
        return khop.Neighborhoods(self, k, directed)

    def k_hop_aggregation(self, k: int, aggregations="mean", directed: bool = False, drop_self_in_neighborhood: bool = True, drop_non_numeric: bool = True, verbose: bool = False, engine: str = "auto") -> DataFrame:
        return khop.aggregate_over_reach(self, k, aggregations, directed, drop_self_in_neighborhood, drop_non_numeric, engine)

    # matrices and exports

    def to_adjacency(self, weight_col: str = "weight", aggfunc="sum") -> DataFrame:
        return matrix.dense(self, weight_col, aggfunc)

    def to_adjacency_long(self, weight_col: str | None = "weight", aggfunc="sum") -> DataFrame:
        return matrix.weighted(self, weight_col, aggfunc)

    def to_coordinates(self, weight_col: str | None = None, aggfunc="sum", verify_integrity: bool = True) -> DataFrame:
        return matrix.coordinates(self, weight_col, aggfunc, verify_integrity)

    def to_adjacency_blocks(self, weight_col: str = "weight", aggfunc="sum", width: int = 1024) -> DataFrame:
        """to_adjacency() for any number of targets: (source, row, block, cells)."""
        return matrix.blocks(self, weight_col, aggfunc, width)

    def to_csr(self, weight_col: str | None = None, aggfunc="sum", verify_integrity: bool = True) -> matrix.CsrTable:
        """Compressed sparse rows as distributed tables; to_sparse_adjacency() reads them."""
        return matrix.CsrTable(self, settled(self.to_coordinates(weight_col, aggfunc, verify_integrity)))

    def to_sparse_adjacency(self, weight_col: str | None = None, aggfunc="sum", verify_integrity: bool = True, format: str = "csr", limit: int = interop.LIMIT):
        """A SciPy matrix where SciPy is installed, else the same arrays in a Csr."""
        out = self.to_csr(weight_col, aggfunc, verify_integrity).collect(limit)
        try:
            return out.to_scipy(format)
        except ImportError:
            return out

    def sort_spectral(self, weight_col: str = "weight", inplace: bool = False) -> GraphTable | None:
        return self._give(inplace, self._replace(order=matrix.spectral_keys(self, weight_col)))

    def to_networkx(self, create_using=None, limit: int = interop.LIMIT):
        return interop.to_networkx(self, create_using, limit)

    def to_edge_index(self, directed: bool = True, weight_col: str | None = None) -> DataFrame:
        return interop.edge_index(self, directed, weight_col)

    def to_node_matrix(self) -> DataFrame:
        return interop.node_matrix(self)

    def to_torch_geometric(self, directed: bool = True, weight_col: str | None = None, limit: int = interop.LIMIT):
        return interop.to_torch_geometric(self, directed, weight_col, limit)

    def to_dict(self, orient: str = "dict", limit: int = interop.LIMIT) -> dict:
        return interop.to_dict(self, orient, limit)

    def to_json(self, orient: str = "dict", limit: int = interop.LIMIT) -> str:
        return interop.to_json(self, orient, limit)

    def edges_json(self) -> DataFrame:
        """Each edge as a JSON string: the form of to_json() that stays distributed."""
        return self.edges.select(F.to_json(F.struct("*")).alias("edge"))

    def to_json_lines(self, orient: str = "records") -> DataFrame:
        """Both tables as lines of JSON, some hundred rows each, in the layouts of to_json(); GraphTable.from_json_lines() reads them."""
        return jsonlines.write_lines(self, orient)

    @classmethod
    def from_json_lines(cls, lines: DataFrame, orient: str = "records", **options) -> GraphTable:
        return jsonlines.read_lines(lines, orient, **options)

    def to_shards(self, rows: int, path: str | None = None, weight_col: str | None = None) -> shards.GraphShards:
        """Tables for training, a folder for each range of rows nodes, with local numbers and ghost nodes."""
        return shards.write_shards(self, rows, path, weight_col)

    def write_parquet(self, nodes: str, edges: str, mode: str = "errorifexists") -> None:
        self.nodes.write.mode(mode).parquet(nodes)
        self.edges.write.mode(mode).parquet(edges)
