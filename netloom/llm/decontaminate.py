"""Benchmark decontamination by Wu-Manber search for many patterns, over words.

A pattern is a window of ten words of a benchmark item, or a whole item of fewer words.  Patterns of one length m form
a table.  Blocks are two consecutive words (one where m is 1): a block's shift is the distance from its last place in
any pattern to the pattern's end, and m - B + 1 for a block of no pattern, so most places of a text are skipped
unseen.  Where the shift is 0, the hash of the block's words selects a bucket of patterns, and the bytes of all their
words are compared.  Many segments of the texts are searched side by side: each numpy step moves every segment's own
place by its own shift.

Null or empty texts have no words; items without words have no window.  Rows of benchmark with one item_id are one
item; a null item_id takes part in hits, but has no name in items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._shared import drop, keep

TABLE_BYTES = 4 << 20
"""Most bytes of benchmark text in one set of tables, some 15 times as much in memory; beyond it the items are dealt into several sets."""
SEGMENT = 64
"""Words of a segment: segments are searched side by side."""


class Patterns:
    """Shift tables and suffix buckets for patterns of m words."""

    def __init__(self, m: int, words: dict[tuple[bytes, ...], set]):
        self.m, self.block = m, min(2, m)
        self.vocabulary = sorted({x for w in words for x in w})
        place = {x: k for k, x in enumerate(self.vocabulary)}
        spelled = np.fromiter((place[x] for w in words for x in w), dtype=np.int32, count=m * len(words)).reshape(-1, m)
        shared: dict[frozenset, frozenset] = {}
        items = [shared.setdefault(f, f) for f in map(frozenset, words.values())]
        codes = _codes(self.vocabulary)[spelled]
        keys = [self._keys(codes[:, end - self.block + 1 : end + 1]) for end in range(self.block - 1, m)]
        self.bits = max(12, int(np.ceil(np.log2(len(np.unique(np.concatenate(keys))) + 1))) + 5)
        self.shift = np.full(1 << self.bits, m - self.block + 1, dtype=np.int32)
        for k, key in enumerate(keys):  # from the first block to the last
            self.shift[(key >> np.uint64(64 - self.bits)).astype(np.int64)] = m - self.block - k
        # buckets: patterns in order of their last block
        order = np.argsort(keys[-1], kind="stable")
        self.suffixes, self.spelled, self.items = keys[-1][order], spelled[order], [items[k] for k in order.tolist()]

    @staticmethod
    def _keys(blocks: np.ndarray) -> np.ndarray:
        out = blocks[:, 0] * W._PLACES[0]
        for k in range(1, blocks.shape[1]):
            out = out + blocks[:, k] * W._PLACES[k]
        return W.mix(out)

    def search(self, words: W.Words) -> list[tuple[int, int]]:
        """(first word, pattern) of each occurrence; one may reach over a row's end, which the caller tests."""
        n = len(words.codes)
        if n < self.m:
            return []
        place = np.arange(self.m - 1, n, SEGMENT, dtype=np.int64)
        stop = np.minimum(place + SEGMENT, n)
        found = []
        codes = words.codes
        while len(place):
            key = codes[place - self.block + 1] * W._PLACES[0]
            if self.block == 2:
                key = key + codes[place] * W._PLACES[1]
            key = W.mix(key)
            shift = self.shift[(key >> np.uint64(64 - self.bits)).astype(np.int64)]
            if (hit := np.flatnonzero(shift == 0)).size:
                sought = key[hit]
                low, high = np.searchsorted(self.suffixes, sought, side="left"), np.searchsorted(self.suffixes, sought, side="right")
                same = low < high
                for at, a, b in zip(place[hit[same]].tolist(), low[same].tolist(), high[same].tolist(), strict=True):
                    first = at - self.m + 1
                    text = [words.text(j) for j in range(first, at + 1)]
                    found += [(first, p) for p in range(a, b) if [self.vocabulary[k] for k in self.spelled[p].tolist()] == text]
            place = place + np.maximum(shift, 1)
            going = place < stop
            place, stop = place[going], stop[going]
        return found


def _codes(words: list[bytes]) -> np.ndarray:
    """The codes of words, as of words in a text."""
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    return W.Words(data, np.array([0, len(data)]), W.LETTERS_DIGITS, False).codes


def windows(rows, size: int) -> dict[int, dict[tuple[bytes, ...], set]]:
    """By length, the items of each window of rows (item_id, text)."""
    out: dict[int, dict[tuple[bytes, ...], set]] = {}
    data, at = W.utf8(pa.array([text for _, text in rows], type=pa.string()))
    for a, b in W.chunks(at):
        words = W.Words(data, at[a : b + 1], W.LETTERS_DIGITS, True)
        for k in range(b - a):
            own = [words.text(j) for j in range(words.first[k], words.first[k + 1])]
            m = min(size, len(own))
            for j in range(len(own) - m + 1 if m else 0):
                out.setdefault(m, {}).setdefault(tuple(own[j : j + m]), set()).add(rows[a + k][0])
    return out


def unite(spans: list[tuple[int, int]]) -> list[int]:
    """Ends of the union of spans: start, end, start, end ..."""
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


_FIELDS = {"doc_id": "long", "text": "string", "n_words": "long", "hits": "array<long>", "items": "array<long>"}
_TYPES = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


def _scan(tables, last: bool):
    """Adds what one set of tables finds to hits and items; the last pass drops the text."""
    schema = pa.schema([(k, _TYPES[t]) for k, t in _FIELDS.items() if not (last and k == "text")])

    def run(batches):
        for batch in batches:
            data, at = W.utf8(batch.column("text"))
            counts, hits, items = [], batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            for a, b in W.chunks(at):
                words = W.Words(data, at[a : b + 1], W.LETTERS_DIGITS, True)
                counts += np.diff(words.first).tolist()
                rows: dict[int, list] = {}
                for table in tables.value:
                    for first, p in table.search(words):
                        row = int(np.searchsorted(words.first, first, side="right")) - 1
                        if first + table.m <= words.first[row + 1]:
                            rows.setdefault(row, []).append((first - int(words.first[row]), table.m, table.items[p]))
                for k, own in rows.items():
                    old = hits[a + k]
                    hits[a + k] = unite([*zip(old[::2], old[1::2], strict=True), *((first, first + m) for first, m, _ in own)])
                    items[a + k] = sorted({*items[a + k]}.union(*(x for _, _, x in own)) - {None})
            out = {"doc_id": batch.column("doc_id"), "text": batch.column("text"), "n_words": counts, "hits": hits, "items": items}
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) if isinstance(out[f.name], list) else out[f.name].cast(f.type) for f in schema], schema=schema)

    return run


def _table_sets(benchmark: DataFrame, size: int, table_bytes: int):
    """Broadcast sets of tables, one after the other; the benchmark's size is summed first.

    Up to table_bytes there is one set; a larger benchmark is dealt into sets of about that size.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-total // table_bytes))
    for k in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        rows = [(r["item_id"], r["text"]) for r in part.toLocalIterator()]
        tables = [Patterns(m, w) for m, w in sorted(windows(rows, size).items())]
        yield k == passes - 1, benchmark.sparkSession.sparkContext.broadcast(tables)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, size: int = 10, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """doc_id, n_words, hits (ends of the spans of hit words: start, end, start ...) and items (sorted item_ids).

    Each set of tables is searched in a pass of its own that adds to the last one's hits, so that no task or driver
    holds more than one set.
    """
    empty = F.array().cast("array<long>")
    held = None
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), empty.alias("hits"), empty.alias("items"))
    for last, tables in _table_sets(benchmark, size, table_bytes):
        found = found.mapInArrow(_scan(tables, last), ", ".join(f"{c} {t}" for c, t in _FIELDS.items() if not (last and c == "text")))
        if not last:
            before, held = held, keep(found, "hits")
            found = held
            drop(before)
    return found


def _clean(tables):
    def run(batches):
        for batch in batches:
            data, at = W.utf8(batch.column("text"))
            clean = np.ones(len(batch), dtype=bool)
            for a, b in W.chunks(at):
                words = W.Words(data, at[a : b + 1], W.LETTERS_DIGITS, True)
                for table in tables.value:
                    for first, _ in table.search(words):
                        row = int(np.searchsorted(words.first, first, side="right")) - 1
                        if first + table.m <= words.first[row + 1]:
                            clean[a + row] = False
            yield batch.filter(pa.array(clean))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of the benchmark occurs."""
    held = None
    for last, tables in _table_sets(benchmark, size, table_bytes):
        docs = docs.mapInArrow(_clean(tables), docs.schema)
        if not last:
            before, held = held, keep(docs, "clean")
            docs = held
            drop(before)
    return docs


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of benchmark_hits()."""
    ends = F.transform("hits", lambda x, k: F.when(k % 2 == 1, x).otherwise(-x))
    n_hit = F.aggregate(ends, F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))
