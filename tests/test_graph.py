import json
import math
import random

import pytest

from netloom import GraphTable


@pytest.fixture(scope="module")
def toy(spark):
    nodes = spark.createDataFrame([("A", "red", 1), ("B", "blue", 2), ("C", "blue", 3), ("D", "red", 4)], "name string, color string, size long")
    edges = spark.createDataFrame([("A", "B", 1), ("A", "C", 2), ("B", "C", 3), ("C", "D", 4)], "source string, target string, weight long")
    return GraphTable(nodes, edges, id_col="name")


@pytest.fixture(scope="module")
def numbered(spark):
    nodes = spark.createDataFrame([(0, "A", "red"), (1, "B", "blue"), (2, "C", "blue"), (3, "D", "red"), (4, "E", "blue")], "id long, name string, color string")
    edges = spark.createDataFrame([(0, 1, 1), (1, 2, 2), (2, 3, 3), (2, 1, 4), (3, 0, 5)], "source long, target long, weight long")
    return GraphTable(nodes, edges)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_validation(spark, toy):
    with pytest.raises(ValueError):
        GraphTable(spark.createDataFrame([(k,) for k in range(4)], "name long"), toy.edges, id_col="name")
    with pytest.raises(ValueError, match="unique"):
        GraphTable(toy.nodes.union(toy.nodes.limit(1)), toy.edges, id_col="name")
    assert len(toy) == 4


def test_queries(toy, numbered):
    red = toy.query_nodes("color == 'red'")
    assert (len(red), red.edges.count()) == (2, 0)
    assert toy.query_edges("weight > 2").edges.count() == 2
    assert toy.query_nodes("index in @keep", local_dict={"keep": ["A", "B"]}).edges.count() == 1
    assert rows(numbered.query_edges("weight > 2").edges) == [(2, 1, 4), (2, 3, 3), (3, 0, 5)]
    assert "nodes=(5, 2), edges=(5, 3)" in repr(numbered)
    with pytest.raises(ValueError):
        toy.query_nodes("nothing > 1")


def test_loc_keeps_the_order_of_any_number_of_ids(spark):
    nodes = spark.range(1200)
    g = GraphTable(nodes, nodes.selectExpr("id as source", "(id + 1) % 1200 as target"))
    for n in (1000, 1001, 1200):
        ids = list(range(n))[::-1]
        found = g.loc[ids, ids]
        assert [r["id"] for r in found.positions().orderBy("_pos").select("id").collect()] == ids
        split = g.loc[ids[:600], ids[600:]]
        assert [r["id"] for r in split.positions().orderBy("_pos").select("id").collect()] == ids


def test_null_logic(spark):
    nodes = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "id long, x double")
    g = GraphTable(nodes, spark.createDataFrame([], "source long, target long"))
    ids = lambda q: [r[0] for r in rows(g.query_nodes(q).nodes.select("id"))]
    assert ids("x != 1") == [2, 3]
    assert ids("not (x > 2)") == [1, 2]
    assert ids("x not in [1]") == [2, 3]
    assert ids("0 < x < 3 | x == 3") == [1, 3]
    assert ids("x.isna()") == [2]
    assert ids("-x % 2 == 1") == [1, 3]
    assert len(g.query_nodes("x > 100").nodes.collect()) == 0


def test_k_hop(toy):
    assert [len(toy.k_hop_neighborhood("A", k)) for k in (0, 1, 2)] == [1, 3, 4]
    with pytest.raises(ValueError):
        toy.k_hop_neighborhood("A", -1)
    with pytest.raises(KeyError):
        toy.k_hop_neighborhood("Z", 1)
    out = {r[0]: [round(x, 6) for x in r[1:]] for r in toy.k_hop_aggregation(1, ["mean", "sum", "std"]).collect()}
    assert out == {"A": [2.5, 5, 0.707107], "B": [2, 4, 1.414214], "C": [2.333333, 7, 1.527525], "D": [3, 3, 0]}
    out = {r[0]: r[1:] for r in toy.k_hop_aggregation(1, ["mean", "std"], directed=True, engine="pandas").collect()}
    assert out["D"] == (None, None) and out["B"] == (3.0, None)
    assert {r[0]: r[1] for r in toy.k_hop_aggregation(1, [max]).collect()} == {"A": 3.0, "B": 3.0, "C": 4.0, "D": 3.0}


def test_components(toy):
    assert toy.n_connected_components() == 1
    assert toy.n_connected_components(connection="strong") == 4
    assert rows(toy.select_component_from_node("B").nodes.select("name")) == [("B",), ("C",), ("D",)]
    assert len(toy.select_component_from_node("B", directed=False)) == 4


def test_random_components(spark):
    rng = random.Random(3)
    n = 30
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(34)]
    g = GraphTable(spark.createDataFrame([(k,) for k in range(n)], "id long"), spark.createDataFrame(pairs, "source long, target long"))
    reach = [{k} for k in range(n)]
    for _ in range(n):
        for a, b in pairs:
            for r in reach:
                if a in r:
                    r.add(b)
    strong = {k: min(j for j in reach[k] if k in reach[j]) for k in range(n)}
    found = dict(map(tuple, g.component_labels(connection="strong").collect()))
    assert {frozenset(k for k in found if found[k] == c) for c in found.values()} == {frozenset(k for k in strong if strong[k] == c) for c in strong.values()}
    weak = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            weak[a] = weak[b] = min(weak[a], weak[b])
    order = sorted(set(weak))
    assert dict(map(tuple, g.component_labels().collect())) == {k: order.index(weak[k]) for k in range(n)}


def test_condense(toy):
    assert rows(toy.condense("color").edges) == [("blue", "blue", 1), ("blue", "red", 1), ("red", "blue", 2)]
    assert rows(toy.condense("color", "sum", columns="weight").edges) == [("blue", "blue", 3), ("blue", "red", 4), ("red", "blue", 3)]


def test_groups(numbered):
    parts = {k: rows(g.edges) for k, g in numbered.groupby_nodes("color")}
    assert parts == {("blue", "blue"): [(1, 2, 2), (2, 1, 4)], ("blue", "red"): [(2, 3, 3)], ("red", "blue"): [(0, 1, 1)], ("red", "red"): [(3, 0, 5)]}
    assert len(numbered.groupby_nodes("color")) == 4 and len(numbered.groupby_nodes("color", induced=True)) == 2
    assert numbered.groupby_nodes("color", axis="source").source_groups == {"blue": [1, 2, 4], "red": [0, 3]}
    with pytest.raises(ValueError):
        numbered.groupby_nodes("color", axis="source").target_groups  # noqa: B018


def test_selection(numbered, spark):
    assert len(numbered.remove_unused_nodes()) == 4
    part = numbered.loc[[1, 2], [2, 3]]
    assert rows(part.edges) == [(1, 2, 2), (2, 3, 3)] and len(part) == 3
    assert [list(r)[1:] for r in part.to_adjacency().collect()] == [[2, 0], [0, 3]]
    with pytest.raises(KeyError):
        numbered.loc[[9], [1]]
    with pytest.raises(NotImplementedError):
        numbered.loc[[1]]
    with pytest.raises(KeyError):
        numbered.remove_nodes([9])
    assert numbered.remove_edges(numbered.edges).edges.count() == 0
    assert [r[0] for r in numbered.reindex_nodes([3, 0, 7]).positions().orderBy("_pos").collect()] == [3, 0, 7]
    features = numbered.apply_node_features("color").edges
    assert features.columns == ["source", "target", "weight", "source_color", "target_color"]
    copy = numbered.deepcopy()
    assert copy == numbered and copy.query_nodes("id > 0", inplace=True) is None and copy != numbered


def test_matrices(toy, numbered):
    csr = numbered.to_sparse_adjacency()
    dense = csr.toarray()
    assert dense.sum() == 5 and dense[2][1] == 1 and dense.shape == (5, 5)
    order = [r["name"] for r in toy.sort_spectral().positions().orderBy("_pos").collect()]
    assert order in (["A", "B", "D", "C"], ["C", "D", "B", "A"])
    again = GraphTable.from_dict(numbered.to_dict(), spark=numbered.nodes.sparkSession)
    assert again.nodes.count() == 5 and rows(again.edges) == rows(numbered.edges)
    assert math.isclose(numbered.node_agreement(numbered.remove_nodes([4])), 0.8)
    assert numbered.to_edge_index(directed=False).count() == 10


def test_whole_graph_queries(spark, tmp_path):
    """All line items and all transitions count, whatever their values; against closures in plain Python."""
    from netloom import queries

    rng, d = random.Random(15), str(tmp_path)
    items = [(rng.randrange(40), rng.randrange(40), float(rng.choice([1, 50])), rng.choice([0.0, 0.1])) for _ in range(30)]
    events = [(k, rng.randrange(25), rng.choice(["purchase", "error", "view"]), float(rng.choice([5, 30]))) for k in range(160)]
    for name, data, schema in (
        ("lineitem", items, "l_suppkey long, l_partkey long, l_quantity double, l_discount double"),
        ("supplier", [(k,) for k in range(40)], "s_suppkey long"),
        ("part", [(k,) for k in range(40)], "p_partkey long"),
        ("events", events, "event_id long, user_id long, event_type string, value double"),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{d}/{name}.parquet")

    def reached(edges, nodes):
        out = {}
        for n in nodes:
            seen, todo = {n}, [n]
            while todo:
                x = todo.pop()
                new = {b for a, b in edges if a == x} - seen
                seen |= new
                todo += new
            out[n] = seen
        return out

    def numbered_by(root):
        numbers = {r: k for k, r in enumerate(sorted(set(root.values())))}
        return {n: numbers[r] for n, r in root.items()}

    nodes = [f"S{k}" for k in range(40)] + [f"P{k}" for k in range(40)]
    edges = {(f"S{s}", f"P{p}") for s, p, _, _ in items}
    used = {x for e in edges for x in e}
    weak = reached(edges | {(b, a) for a, b in edges}, nodes)
    got = lambda name: queries.ENTRIES[name][0](spark, d)
    assert {r["id"] for r in got("remove_unused_nodes_whole").collect()} == used
    assert got("node_agreement_whole").first()[0] == pytest.approx(len(used) / len(nodes))
    labels = {r["id"]: r["component"] for r in got("wcc_labels_whole").collect()}
    assert labels == numbered_by({n: min(weak[n]) for n in nodes})
    pairs = [json.loads(r["edge"]) for r in got("edges_json").collect()]
    assert sorted((p["source"], p["target"]) for p in pairs) == sorted(edges)
    users = {u for _, u, _, _ in events}
    steps = {(a[1], b[1]) for a, b in zip(events, events[1:]) if a[2] == "purchase" and b[2] == "error"}
    far = reached(steps, users)
    strong = {r[0]: r[1] for r in got("scc_labels_whole").select("id", "component").collect()}
    assert strong == numbered_by({n: min(m for m in far[n] if n in far[m]) for n in users})


@pytest.fixture
def gaps(spark):
    """Nodes and edges with NaN and null among their numbers."""
    nan = float("nan")
    nodes = spark.createDataFrame([(1, 1.0, "a", "x"), (2, nan, "b", "y"), (3, None, "a", None), (4, 4.0, "b", "x")], "id long, v double, kind string, more string")
    edges = spark.createDataFrame([(1, 2, 2.0), (1, 4, nan), (3, 4, None), (3, 2, 3.0), (1, 2, 5.0)], "source long, target long, weight double")
    return GraphTable(nodes, edges, id_col="id")


def test_nan_is_missing_in_queries(gaps):
    import pandas as pd

    frame = pd.DataFrame({"v": [1.0, float("nan"), None, 4.0], "kind": ["a", "b", "a", "b"]}, index=[1, 2, 3, 4])
    for query in ("v > 2", "not (v <= 2)", "v != v", "v == v", "v != 1", "v in [1, 4]", "v not in [1]", "v.isna()", "v.notna()", "v.between(0, 5)", "not v.between(0, 2)", "v + 1 > 2", "v / 0 > 1", "sqrt(v - 2) >= 0", "(v - 1) / (v - 1) != 1", "v % 2 == 0"):
        want = frame.query(query, engine="python").index.tolist()
        assert sorted(r["id"] for r in gaps.query_nodes(query, engine="python").nodes.collect()) == want, query
    assert sorted(r["id"] for r in gaps.query_nodes("kind + more == 'ax'").nodes.collect()) == [1]


def test_nan_is_passed_over_in_aggregates(gaps):
    got = {(r["source"], r["target"]): r["weight"] for r in gaps.condense("kind", "sum", columns="weight").edges.collect()}
    assert got == {("a", "b"): 10.0}
    cells = {(r["source"], r["target"]): r["value"] for r in __import__("netloom.operators.matrix", fromlist=["x"]).weighted(gaps, "weight", "max").collect()}
    assert cells == {(1, 2): 5.0, (1, 4): None, (3, 4): None, (3, 2): 3.0}
    for name, value in (("prod", 30.0), ("mean", 10 / 3)):
        assert math.isclose(gaps.groupby_nodes("kind").apply_edges(name, "weight").first()["weight"], value)


def spectral(spark, n, pairs, **options):
    from netloom.operators import matrix

    g = GraphTable(spark.createDataFrame([(k,) for k in range(n)], "id long"), spark.createDataFrame(pairs, "source long, target long, weight double"), id_col="id", validate=False)
    return {r["id"]: r["_key"] for r in matrix.spectral_keys(g, **options).collect()}


def leading(n, pairs):
    """By a dense solver: the vector of the eigenvalue of largest size, of two as large the positive one."""
    import numpy as np

    a = np.zeros((n, n))
    for i, j, w in pairs:
        a[i, j] += w
    values, vectors = np.linalg.eigh(a + a.T)
    k = n - 1 if abs(values[0]) <= abs(values[-1]) * (1 + 1e-9) else 0
    own = vectors[:, k]
    return own * (1 if own[np.lexsort((own, np.round(np.abs(own), 9)))[-1]] > 0 else -1)


@pytest.mark.parametrize("n, degree, bipartite, sign", [(8, 2, False, 1), (500, 6, True, 1), (2000, 8, False, -1)])
def test_spectral_order_against_dense_solver(spark, n, degree, bipartite, sign):
    rng = random.Random(n)
    pairs = [(rng.randrange(n), rng.randrange(n), float(sign * rng.randrange(1, 4))) for _ in range(n * degree)]
    if bipartite:
        pairs = [(a // 2 * 2, b // 2 * 2 + 1, w) for a, b, w in pairs]
    got, want = spectral(spark, n, pairs), leading(n, pairs)
    assert all(abs(got[k] - want[k]) < 1e-7 for k in range(n))


def test_spectral_order_of_small_and_slow_graphs(spark, monkeypatch):
    from netloom.operators import matrix

    assert set(spectral(spark, 3, []).values()) == {0.0}
    monkeypatch.setattr(matrix, "STEPS", 5)
    path = [(k, k + 1, 1.0) for k in range(9)]
    got, want = spectral(spark, 10, path), leading(10, path)  # more steps than one round has
    assert all(abs(got[k] - want[k]) < 1e-6 for k in range(10))
    with pytest.raises(RuntimeError):
        spectral(spark, 10, path, rounds=1)


def test_ends_of_other_types_are_refused(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    for kind, value in (("double", 1.0), ("string", "1")):
        with pytest.raises(ValueError):
            GraphTable(nodes, spark.createDataFrame([(value, value)], f"source {kind}, target {kind}"), id_col="id")
    assert GraphTable(nodes, spark.createDataFrame([(1, 2)], "source int, target short"), id_col="id").edges.count() == 1


def test_group_names_flags_and_null_keys(spark):
    nodes = spark.createDataFrame([(1, "a", 1.5), (2, None, 2.5), (3, "b", None), (4, "a", 1.5)], "id long, kind string, x double")
    g = GraphTable(nodes, spark.createDataFrame([(1, 3), (1, 4), (2, 3), (3, 1), (3, 2)], "source long, target long"), validate=False)
    by = g.groupby_nodes("kind")
    assert by.source_group_names == by.target_group_names == ["a", "b"] and by.has_source_groups and by.has_target_groups
    assert {k: rows(p.edges) for k, p in by} == {("a", "a"): [(1, 4)], ("a", "b"): [(1, 3)], ("b", "a"): [(3, 1)], ("b", "b"): []}
    parts = {k: (rows(p.nodes.select("id")), p.edges.count()) for k, p in g.groupby_nodes("kind", dropna=False, induced=True)}
    assert parts == {("a", "a"): ([(1,), (4,)], 1), ("b", "b"): ([(3,)], 0), (None, None): ([(2,)], 0)}
    source = g.groupby_nodes(["kind", "x"], axis=0, dropna=False)
    assert source.has_source_groups and not source.has_target_groups
    assert {k: (len(p), p.edges.count()) for k, p in source} == {("a", 1.5): (4, 2), (None, 2.5): (4, 1), ("b", None): (4, 2)}
    with pytest.raises(ValueError):
        source.target_group_names
    assert set(g.get_public_attributes()) >= {"nodes", "edges", "directed", "id_col"}


def test_component_iterator(spark):
    nodes = spark.createDataFrame([(k, f"n{k}") for k in range(7)], "id long, name string")
    g = GraphTable(nodes, spark.createDataFrame([(0, 3, 1), (3, 0, 2), (1, 2, 3), (4, 0, 4), (2, 2, 5)], "source long, target long, w long"))
    weak = [(rows(p.nodes.select("id")), rows(p.edges)) for p in g.connected_components()]
    assert weak == [([(0,), (3,), (4,)], [(0, 3, 1), (3, 0, 2), (4, 0, 4)]), ([(1,), (2,)], [(1, 2, 3), (2, 2, 5)]), ([(5,)], []), ([(6,)], [])]
    strong = [(len(p), p.edges.count()) for p in g.connected_components(connection="strong")]
    assert strong == [(2, 2), (1, 0), (1, 1), (1, 0), (1, 0), (1, 0)]
    assert "EqualTo(_label,0)" in next(g.connected_components()).edges._jdf.queryExecution().toString()


def test_blocks_of_many_targets_and_csr_tables(spark, monkeypatch):
    from netloom.operators import matrix

    monkeypatch.setattr(matrix, "PART", 7)
    rng = random.Random(5)
    n = 30
    pairs = {(rng.randrange(n), rng.randrange(n)): float(rng.randrange(1, 9)) for _ in range(80)}
    g = GraphTable(spark.range(n), spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()] + [(0, 5, 1.0), (0, 5, 2.0)], "source long, target long, weight double"), validate=False)
    pairs[0, 5] = pairs.get((0, 5), 0.0) + 3.0
    held = g.to_csr("weight")
    starts = [r["start"] for r in held.indptr.orderBy("row").collect()]
    cells = [(r["col"], r["value"]) for r in held.cells.orderBy("at").collect()]
    assert len(starts) == n + 1 and starts[-1] == len(cells) == len(pairs)
    assert {(r, c): v for r in range(n) for c, v in cells[starts[r] : starts[r + 1]]} == pairs
    assert (matrix.CsrTable.collect(held, 1000).toarray() == [[pairs.get((a, b), 0.0) for b in range(n)] for a in range(n)]).all()
    rows_ = {}
    for r in g.to_adjacency_blocks(width=8).orderBy("row", "block").collect():
        rows_.setdefault(r["source"], []).extend(r["cells"])
    assert rows_ == {a: [pairs.get((a, b), 0.0) for b in range(n)] for a in range(n)}
    wide = GraphTable(spark.range(20000), spark.createDataFrame([(3, 19999, 2.0)], "source long, target long, weight double"), sources=[3], validate=False)
    parts = wide.to_adjacency_blocks(width=4096).orderBy("block").collect()
    assert [len(r["cells"]) for r in parts] == [4096] * 4 + [20000 - 4 * 4096] and sum(sum(r["cells"]) for r in parts) == 2.0 and parts[-1]["cells"][-1] == 2.0


def test_long_lists_tables_and_sql_in_queries(spark, toy):
    nodes = spark.range(3000).selectExpr("id", "case when id % 7 > 0 then id % 100 end as x", "concat('n', id) as name")
    g = GraphTable(nodes, spark.createDataFrame([(1, 2)], "source long, target long"), validate=False)
    long = list(range(0, 100_000, 2))
    found = g.query_nodes("id in @keep and name not in @names", local_dict={"keep": long, "names": [f"n{k}" for k in range(2000)]})
    assert [r[0] for r in found.nodes.select("id").orderBy("id").collect()] == list(range(2000, 3000, 2))
    assert found.nodes.columns == ["id", "x", "name"]
    assert len(g.query_nodes("x in @keep | x.isin(@keep)", local_dict={"keep": [None, *long]})) == sum(k % 7 == 0 or k % 100 % 2 == 0 for k in range(3000))
    assert len(g.query_nodes("not (x in @keep)", local_dict={"keep": long})) == sum(not (k % 7 > 0 and k % 100 % 2 == 0) for k in range(3000))
    table = spark.createDataFrame([(1,), (1,), (None,), (5,)], "some long")
    assert len(g.query_nodes("index in @table", local_dict={"table": table})) == 2
    assert len(g.query_nodes("id < 100", sql="x % 10 = 3")) == sum(k % 7 > 0 and k % 10 == 3 for k in range(100))
    assert toy.query_edges(sql="weight > 2").edges.count() == 2
    with pytest.raises(ValueError):
        toy.query_nodes()
