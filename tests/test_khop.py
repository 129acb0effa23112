"""k-hop pairs, sub-graphs and aggregates against plain searches, and hubs by blocks of bits."""

import random
import statistics

import pytest

from netloom import GraphTable
from netloom.operators import khop


def near_of(n, links, k, directed):
    """{a: {b: hop}} by breadth-first search."""
    after = [set() for _ in range(n)]
    for a, b in links:
        after[a].add(b)
        if not directed:
            after[b].add(a)
    out = {}
    for a in range(n):
        out[a], front = {a: 0}, {a}
        for hop in range(1, k + 1):
            front = {c for b in front for c in after[b]} - set(out[a])
            out[a] |= dict.fromkeys(front, hop)
    return out


def made(spark, n, links, name, kind):
    nodes = spark.createDataFrame([(name(i), float(i % 7), i) for i in range(n)], f"id {kind}, x double, y long")
    return GraphTable(nodes, spark.createDataFrame([(name(a), name(b), i) for i, (a, b) in enumerate(links)], f"source {kind}, target {kind}, n long"))


NAMES = {"near": (lambda i: i - 3, "int"), "far": (lambda i: i * 10**15 - 5, "long"), "text": ("n{:04d}".format, "string")}


@pytest.mark.parametrize("names, k, directed, split", [("text", 0, False, 1 << 20), ("far", 1, True, 1), ("near", 2, False, 1), ("text", 2, False, 1 << 20), ("near", 3, True, 1 << 20)])
def test_pairs_subgraphs_and_aggregates(spark, monkeypatch, names, k, directed, split):
    """Loops, edges twice, nodes without edges; numbers over three blocks; with (split 1) every node dealt into parts."""
    monkeypatch.setattr(khop, "SPLIT", split)
    name, kind = NAMES[names]
    rng, n = random.Random(k), 600
    links = [(rng.randrange(n), rng.randrange(590)) for _ in range(500)] + [(5, rng.randrange(n)) for _ in range(60)]
    links += [(1, 1), links[0], (9, 300)]
    g, want = made(spark, n, links, name, kind), near_of(n, links, k, directed)
    got = g.k_hop_mask(k, directed).collect()
    assert sorted(map(tuple, got)) == sorted((name(a), name(b), h) for a, own in want.items() for b, h in own.items())
    around = g.k_hop_decomposition(k, directed)
    assert sorted((r["center"], r["n"]) for r in around.edges.collect()) == sorted((name(c), i) for c, own in want.items() for i, (a, b) in enumerate(links) if a in own and b in own)
    assert {r["id"] for r in around[name(5)].nodes.collect()} == {name(b) for b in want[5]}
    for r in g.k_hop_aggregation(k, ["mean", "sum", "std"], directed).select("id", "x_neighbor_mean", "y_neighbor_sum", "x_neighbor_std").collect():
        a = next(i for i in range(n) if name(i) == r["id"]) if names == "text" else (r["id"] + 3 if names == "near" else (r["id"] + 5) // 10**15)
        own = sorted(set(want[a]) - {a})
        x = [float(b % 7) for b in own]
        assert r["y_neighbor_sum"] == sum(own)
        assert r["x_neighbor_mean"] == pytest.approx(statistics.mean(x) if x else 0)
        assert r["x_neighbor_std"] == pytest.approx(statistics.stdev(x) if len(x) > 1 else 0)


def test_own_aggregates_by_blocks_and_by_pairs(spark):
    g = made(spark, 400, [(0, i) for i in range(400)] + [(i, i // 2) for i in range(100)], *NAMES["text"])
    by_blocks = g.k_hop_aggregation(2, ["max", "count", min], drop_self_in_neighborhood=False).collect()
    by_pairs = khop.aggregate_over_pairs(g.k_hop_mask(2), g.nodes, ["max", "count", min], drop_self_in_neighborhood=False).collect()
    assert sorted(by_blocks) == sorted(by_pairs) and by_blocks[0]["y_neighbor_max"] == 399


def test_empty_graph_and_edges_to_no_node(spark):
    none = GraphTable(spark.createDataFrame([], "id long, x double"), spark.createDataFrame([], "source long, target long"))
    assert none.k_hop_mask(2).count() == 0 and none.k_hop_aggregation(2).count() == 0 and none.k_hop_decomposition(1).edges.count() == 0
    g = GraphTable(spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, 2), (1, 9), (None, 2)], "source long, target long"), validate=False)
    assert sorted(map(tuple, g.k_hop_mask(2).collect())) == [(1, 1, 0), (1, 2, 1), (2, 1, 1), (2, 2, 0)]


def test_hub_takes_a_row_a_block(spark):
    """A star of 20,000 leaves: 4e8 pairs at two hops, held as 1.6e6 rows, and aggregates of them right."""
    n = 20_000
    ids = spark.range(n).selectExpr("id", "id as y")
    star = GraphTable(ids, spark.range(1, n).selectExpr("0L as source", "id as target"), validate=False)
    reach = khop.Reach(star, 2, False)
    rows = reach.rows.selectExpr("count(*)", "sum(bit_count(w0) + bit_count(w1) + bit_count(w2) + bit_count(w3))").first()
    assert rows[1] == n * n and rows[0] < 1.1 * n * n / khop.SPAN + 4 * n
