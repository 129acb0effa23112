"""Strong components and reachability against plain closures, and the number of rounds on long paths."""

import random

import pytest

from netloom import GraphTable
from netloom.operators import components, strong
from netloom.plans import fixpoint


def graph(spark, n, pairs, name=lambda k: k):
    kind = "string" if isinstance(name(0), str) else "long"
    return GraphTable(spark.createDataFrame([(name(k),) for k in range(n)], f"id {kind}"), spark.createDataFrame([(name(a), name(b)) for a, b in pairs], f"source {kind}, target {kind}"))


def strong_of(n, pairs):
    """The least node of each node's component, by reach both ways."""
    after, before = [[] for _ in range(n)], [[] for _ in range(n)]
    for a, b in pairs:
        after[a].append(b)
        before[b].append(a)

    def reach(k, next_):
        seen, stack = {k}, [k]
        while stack:
            for x in next_[stack.pop()]:
                if x not in seen:
                    seen.add(x)
                    stack.append(x)
        return seen

    out = {}
    for k in range(n):
        if k not in out:
            out.update(dict.fromkeys(reach(k, after) & reach(k, before), k))
    return out


def found_strong(g):
    return {r["id"]: r["root"] for r in components.roots(g, connection="strong").collect()}


@pytest.fixture
def writes(monkeypatch):
    """Counts the tables written between rounds."""
    count = [0]
    plain = fixpoint.stored

    def counted(df, **measures):
        count[0] += 1
        return plain(df, **measures)

    for module in (fixpoint, components, strong):
        monkeypatch.setattr(module, "stored", counted)
    return count


def mazes():
    rng = random.Random(4)
    for n, m in ((30, 34), (40, 70), (60, 66)):
        yield n, [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    tree = [(rng.randrange(k), k) for k in range(1, 50)]
    yield 50, [*tree, (49, 0), (30, 12), (31, 31)]  # a tree out of its root, with ways back
    yield 50, [(b, a) for a, b in [*tree, (49, 0), (30, 12)]]
    yield 40, [*[(k, (k + 1) % 20) for k in range(20)], *[(rng.randrange(k), k) for k in range(20, 40)], (39, 5)]  # a ring with trees on it
    yield 30, [(a, b) for k in range(29) for a, b in ((k, k + 1), (k + 1, k))]  # both ways
    yield 36, [(6 * i + j, x) for i in range(6) for j in range(6) for x in ((6 * i + j + 1) % 36, (6 * i + j + 6) % 36)]
    yield 5, []


def union_of_mazes(some=slice(None)):
    n, pairs = 0, []
    for m, own in list(mazes())[some]:
        pairs += [(a + n, b + n) for a, b in own]
        n += m
    return n, pairs


@pytest.mark.parametrize("worth, name, some", [(2, int, slice(None)), (10**9, "n{:04d}".format, slice(3, 7)), (0, int, slice(0, 3))])
def test_strong_components(spark, monkeypatch, worth, name, some):
    """With contractions that pay, with all of them, and (worth 0) with none."""
    monkeypatch.setattr(strong, "WORTH", worth)
    n, pairs = union_of_mazes(some)
    assert found_strong(graph(spark, n, pairs, name)) == {name(k): name(c) for k, c in strong_of(n, pairs).items()}


def test_long_ring_and_chain_in_tens_of_rounds(spark, writes):
    n = 5000
    ids = spark.range(n)
    ring = GraphTable(ids, ids.selectExpr("id as source", f"(id + 1) % {n} as target"), validate=False)
    assert ring.n_connected_components(connection="strong") == 1
    assert writes[0] < 60
    writes[0] = 0
    chain = GraphTable(ids, ids.selectExpr("id as source", "id + 1 as target").where(f"target < {n}"), validate=False)
    assert chain.n_connected_components(connection="strong") == n
    assert writes[0] < 60


def test_what_a_node_reaches(spark, writes):
    n = 2000
    ids = spark.range(n)
    chain = GraphTable(ids, ids.selectExpr("id as source", "id + 1 as target").where(f"target < {n}"), validate=False)
    assert len(chain.select_component_from_node(100)) == n - 100
    assert writes[0] < 80
    assert len(chain.select_component_from_node(100, directed=False)) == n
    names = GraphTable(ids.selectExpr("concat('n', id) as id"), chain.edges.selectExpr("concat('n', source) as source", "concat('n', target) as target").where("source <> 'n35'"), validate=False)
    assert len(names.select_component_from_node("n20")) == 16
    rng = random.Random(8)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(80)]
    g, want, more = graph(spark, 60, pairs), {7}, True
    while more:
        more = {b for a, b in pairs if a in want} - want
        want |= more
    assert {r["id"] for r in g.select_component_from_node(7).nodes.collect()} == want
    with pytest.raises(KeyError):
        g.select_component_from_node(1000)
