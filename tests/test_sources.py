import json

import pytest

from netloom import GraphTable
from netloom.sources.jsonlines import ORIENTS


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def mixed(spark):
    nodes = spark.createDataFrame([(k, f"n{k}" if k % 3 else None, k / 2 if k % 5 else float("nan"), bool(k % 2)) for k in range(600)], "id long, name string, `a b` double, odd boolean")
    edges = spark.createDataFrame([(k, k * 7 % 600, 1.5 * (k % 4)) for k in range(600)] + [(1, 2, 0.5)] * 2, "source long, target long, weight double")
    return GraphTable(nodes, edges, directed=False)


@pytest.mark.parametrize("orient", ORIENTS)
def test_json_lines_come_back(mixed, orient):
    lines = mixed.to_json_lines(orient)
    again = GraphTable.from_json_lines(lines, orient)
    assert not again.directed
    assert rows(again.edges.select(mixed.edges.columns)) == rows(mixed.edges)
    missing = [(a, b, None if c != c else c, d) for a, b, c, d in rows(mixed.nodes)]
    assert rows(again.nodes.select("id", "name", "`a b`", "odd")) == sorted(missing, key=repr)
    typed = GraphTable.from_json_lines(lines, orient, nodes_schema="id int, `a b` float", edges_schema="source int, target int")
    assert [t for _, t in typed.nodes.dtypes + typed.edges.dtypes] == ["int", "float", "int", "int"]
    assert typed.nodes.count() == 600


@pytest.mark.parametrize("orient", ["dict", "index", "records", "split", "tight"])
def test_json_lines_read_what_the_local_form_wrote(spark, mixed, orient):
    small = mixed.query_nodes("id < 10 and id % 5 != 0")
    lines = spark.createDataFrame([(small.to_json(orient),)], "line string")
    again = GraphTable.from_json_lines(lines, orient)
    assert rows(again.nodes.select(small.nodes.columns)) == rows(small.nodes)
    assert rows(again.edges.select(small.edges.columns)) == rows(small.edges)
    line = small.to_json_lines(orient).where("line like '%nodes%'").first()["line"]
    ids = small.nodes.count()
    told = json.loads(line)["nodes"]
    assert len({"split": lambda: told["data"], "tight": lambda: told["data"], "dict": lambda: told["odd"]}.get(orient, lambda: told)()) <= ids


def test_json_lines_of_odd_tables(spark):
    empty = GraphTable(spark.createDataFrame([], "id string"), spark.createDataFrame([], "source string, target string"))
    again = GraphTable.from_json_lines(empty.to_json_lines())
    assert (again.nodes.count(), again.edges.count(), again.directed) == (0, 0, True)
    bare = GraphTable(spark.createDataFrame([("x",), ("y",)], "id string"), spark.createDataFrame([("x", "y")], "source string, target string"))
    for orient in ("index", "records", "split", "tight"):
        assert rows(GraphTable.from_json_lines(bare.to_json_lines(orient), orient).nodes) == [("x",), ("y",)]
    with pytest.raises(ValueError, match="orient"):
        bare.to_json_lines("dict")
    with pytest.raises(ValueError):
        bare.to_json_lines("list")
    mix = spark.createDataFrame([('{"nodes": [{"id": "x", "v": 1}, {"id": "y", "v": "z"}, {"id": "w", "more": {"k": [1]}}]}',)], "line string")
    got = GraphTable.from_json_lines(mix).nodes
    assert dict(got.dtypes) == {"id": "string", "more": "variant", "v": "variant"}
    assert rows(got.selectExpr("id", "v::string")) == [("w", None), ("x", "1"), ("y", "z")]


def test_shards(spark):
    nodes = spark.createDataFrame([(f"v{k:03d}", float(k), None if k == 7 else k) for k in range(25)], "id string, a double, b long")
    pairs = [(k, k * k % 25) for k in range(25)] + [(k, 24) for k in range(25)] + [(3, 9)] * 2
    edges = spark.createDataFrame([(f"v{a:03d}", f"v{b:03d}", float(a + b)) for a, b in pairs], "source string, target string, weight double")
    parts = GraphTable(nodes, edges).to_shards(10, weight_col="weight")
    seen = []
    for k in range(3):
        s = parts.load(k)
        own = ~s["ghost"]
        assert s["position"][own].tolist() == list(range(10 * k, min(25, 10 * k + 10)))
        assert set(s["position"][~own] // 10).isdisjoint({k})
        assert s["position"][~own].tolist() == sorted(set(s["position"][~own]))
        assert s["x"].tolist() == [[float(p), 0.0 if p == 7 else float(p)] for p in s["position"]]
        src, dst = s["edge_index"]
        assert own[src].all()
        seen += list(zip(s["position"][src].tolist(), s["position"][dst].tolist(), s["weight"].tolist()))
    assert sorted(seen) == sorted((a, b, float(a + b)) for a, b in pairs)
    alone = GraphTable(nodes, edges.limit(0)).to_shards(100)
    assert alone.load(0)["edge_index"].shape == (2, 0)
    assert alone.load(0)["weight"] is None
    with pytest.raises(ValueError):
        GraphTable(nodes, edges).to_shards(0)
