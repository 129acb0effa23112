"""Packing: every id once, in gapless sequences without padding; patterns near the bound of the linear program."""

import random
import zlib

import numpy as np
import pytest

pytest.importorskip("netloom.llm")

import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from netloom.llm import packing  # noqa: E402

RNG = random.Random(13)
PATH = public_tokenizers.path("word_bpe_49k.json")
RAW = open(PATH, "rb").read()
PLAIN = Tokenizer.from_file(PATH)
ODD = ["", None, "  \n", "a", "It's we'll 'tis 3rd a1b2", "É́é ́x  y z\x1cq\x85r", "<|endoftext|>x <|startoftext|>", "<| endoftext|>", "ΟΔΟΣ ΣΑΣ İ", "日本語 テスト。", "🙂🙂 !!??..", "x" * 5000, "a\0b \x1f c", "Ärger's ÉTÉ'LL ñandú×2÷3 ĲŉſŦ İı ªº µ", "'S'T'RE'VE'M'LL'D ''s 's's", "ab<|endoftext|>cd"]


def ids_of(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 2]


def check(texts, rows, size):
    """Rows hold each document's ids once, and lie gapless in sequences; returns their padding."""
    want, by_doc, by_sequence = {k: ids_of(t) for k, t in texts}, {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(want)
    for k, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(want[k])
            assert r["ids_crc32"] == zlib.crc32(np.array(want[k][at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(want[k])
    padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def words(n):
    return " ".join(RNG.choice(["the", "of", "paper", "engines", "Quorvex", "7"]) for _ in range(n))


@pytest.mark.parametrize("group", [1 << 16, 7])
def test_packing(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP", group)
    texts = list(enumerate([*ODD, *[words(int(RNG.expovariate(1 / 60)) + 1) for _ in range(200)], words(4000), words(253), *["same text here"] * 80]))
    table = spark.createDataFrame([(k, t, 1, 2) for k, t in texts], "doc_id long, text string, n int, start int").repartition(4)
    rows = packing.pack(table, RAW, size=256).collect()
    assert check(texts, rows, 256) == 0
    assert len(rows) < len(texts) + 3 * len({r["sequence_id"] for r in rows})


def test_small_and_empty_tables(spark):
    for texts in ([(1, "one")], [(1, None), (2, "")], [(1, words(255))], [(1, words(300)), (2, words(211))]):
        assert check(texts, packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), RAW, size=256).collect(), 256) == 0
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), RAW).count() == 0


def test_repeated_rows_and_ids(spark):
    data = [(1, "a b c"), (1, "a b c"), (None, "d")]
    rows = packing.pack(spark.createDataFrame(data, "doc_id long, text string"), RAW, size=128, with_ids=True).collect()
    assert sorted(i for r in rows for i in r["ids"]) == sorted(i for _, t in data for i in ids_of(t))


def test_a_long_text(spark):
    text = words(600_000) + "y" * 1000
    texts = [(1, text), (2, words(9))]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), RAW).collect()
    assert check([(1, text), (2, texts[1][1])], rows, 4096) == 0


def test_encoder_equals_the_library(monkeypatch):
    encoder = packing.Encoder(RAW)
    assert encoder.apart
    texts = [t or "" for t in ODD] + [words(50) for _ in range(30)] + ["".join(RNG.choices("ab'SsdLl1 .!éÉÿĀ×Σ́\n\t　<|>", k=60)) for _ in range(500)]
    for slice_bytes, memo in ((1 << 20, 48 << 20), (20, 1000)):
        monkeypatch.setattr(packing, "SLICE_BYTES", slice_bytes)
        monkeypatch.setattr(packing, "MEMO_BYTES", memo)
        for t in texts:
            assert np.frombuffer(encoder.encode(t.encode()), dtype=encoder.kind).tolist() == PLAIN.encode(t, add_special_tokens=False).ids
    assert not packing.independent(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read())


def test_patterns_are_near_the_bound():
    for seed in range(2):
        rng = np.random.default_rng(seed)
        demand = {int(k): int(n) for k, n in zip(range(1, 129), rng.integers(0, 5000, 128), strict=True)} if seed else {3: 1, 128: 2}
        chosen = packing.patterns(demand)
        held: dict[int, int] = {}
        for pattern, times in chosen:
            assert sum(c * n for c, n in pattern.items()) <= 128 and times > 0
            for c, n in pattern.items():
                held[c] = held.get(c, 0) + n * times
        assert held == {c: n for c, n in demand.items() if n}
        sizes = np.array([c for c, n in demand.items() if n])
        _, used = packing.linear_program(sizes, np.array([float(demand[c]) for c in sizes.tolist()]), 128)
        assert sum(t for _, t in chosen) <= used.sum() + len(sizes)


def test_priciest_by_all_patterns():
    sizes, prices = np.array([3, 4, 7]), np.array([0.3, 0.45, 0.8])
    best = max(0.3 * a + 0.45 * b + 0.8 * c for a in range(5) for b in range(5) for c in range(3) if 3 * a + 4 * b + 7 * c <= 15)
    worth, pattern = packing.priciest(prices, sizes, 15)
    assert abs(worth - best) < 1e-9 and abs(pattern @ prices - best) < 1e-9
