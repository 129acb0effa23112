"""Ranked search against scores of all documents, one by one."""

import math
import random
import re

import pytest

pytest.importorskip("netloom.llm")

from netloom.llm import lexical  # noqa: E402

RNG = random.Random(12)
WORDS = ["the", "of", "in", *[f"w{k}" for k in range(400)], "Été", "x_y", "ÀB", "7up"]
WEIGHTS = [200, 100, 80, *[400 / (k + 1) for k in range(400)], 5, 5, 5, 5]


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def plain_search(docs, items, k=10):
    split = [(i, plain_terms(t)) for i, t in docs]
    split = [(i, ws) for i, ws in split if ws]
    n, total, df = len(split), sum(len(ws) for _, ws in split), {}
    for _, ws in split:
        for t in set(ws):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(plain_terms(t))
    out = set()
    for item, terms in asked.items():
        scored = []
        for i, ws in split:
            m = 100 - 90 + (90 * len(ws) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * ws.count(t)) // (1000 * ws.count(t) + 8 * m)) for t in terms if t in df)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out.update((item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:k]))
    return out


def some(n):
    return " ".join(RNG.choices(WORDS, WEIGHTS, k=n))


DOCS = [(k, some(RNG.choice([1, 3, 20, 60, 400]))) for k in range(700)] + [(1000, None), (1001, ""), (1002, "..!"), (None, some(30)), (3, some(9)), (1003, "the " * 300 + "w399"), *[(1100 + k, "same words w390 w391") for k in range(30)], (1100, "same words w390 w391")]
ITEMS = [(k, some(RNG.choice([2, 10, 40]))) for k in range(30)] + [(50, None), (51, ""), (52, "unseen"), (53, "w390 W391 w390"), (54, "the"), (None, "w5 w6"), (55, "w7"), (55, "w8"), (56, "same words")]


@pytest.mark.parametrize("block, segment, piece", [(128, 8 << 20, 4 << 20), (4, 3000, 50), (16, 20000, 4 << 20)])
def test_against_all_scores(spark, monkeypatch, block, segment, piece):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "SEGMENT_BYTES", segment)
    monkeypatch.setattr(lexical, "PIECE_BYTES", piece)
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in DOCS], "doc_id long, text string, rank string, score int").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = lexical.index(docs).search(items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) or (1100 in {r[2] for r in rows})
    assert set(rows) == plain_search(DOCS, ITEMS)


def test_batches_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_BYTES", 1000)
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {tuple(r) for r in lexical.index(docs).search(items).collect()} == plain_search(DOCS, ITEMS)


def test_a_long_text_and_empty_tables(spark):
    data = [(1, "a b " * 1_500_000 + "needle"), (2, "needle c"), (3, "z" * 5_000_000)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    items = spark.createDataFrame([(1, "needle"), (2, "b z"), (3, "z" * 5_000_000)], "item_id long, text string")
    assert {tuple(r) for r in lexical.index(docs).search(items).collect()} == plain_search(data, [(1, "needle"), (2, "b z"), (3, "z" * 5_000_000)])
    assert lexical.index(docs.limit(0)).search(items).count() == 0
    assert lexical.index(docs).search(items.limit(0)).count() == 0


def test_blocks_below_the_threshold_stay_shut():
    builder = lexical._Builder(2000, 20000)
    for k in range(2000):
        builder.add(k, b"rare the the" if k in (1500, 1501) else b"the of in on at")
    row = builder.segment().to_pylist()[0]
    segment = lexical.Segment(row, 2000, 20000)
    at = lexical.np.array([segment.terms[b"rare"], segment.terms[b"the"]])
    weights = lexical.np.array([7000, 10])
    first, scores = segment.search(at, weights, 1)
    assert len(first) == 2000
    segment.opened.clear()
    again, _ = segment.search(at, weights, int(sorted(scores)[-2]))
    assert again.tolist() == [1500, 1501]
    assert len(segment.opened) == 2  # the rare term's block, and of the other ones only that with its documents
