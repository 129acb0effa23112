"""N-gram Jaccard join by filters under several global token orders.

Two sets of Jaccard similarity J >= t share a token within the first p(n) = n - ceil(t n) + 1 tokens of each, under
any one order of all tokens.  The join uses three orders.  The first puts rare tokens first: its keys are a counted
sketch over all documents, then the token's code.  The other two are plain hash orders.  A candidate pair must pass
all three, and the bound on sizes, before its sets are compared.

Documents with equal sets are one class throughout.  Classes with one first-order token in their prefixes are a bucket;
no pair of a bucket's members is made a row.  A bucket's members are compared with one of them first, so that a group of
close copies costs as many comparisons as it has members, and what that leaves open is compared by blocks.
Only links that join components are given out.

Rows: null or empty text has an empty set, linked with nothing.  Equal or null doc_ids are kept as separate rows; a
component's id is its least non-null doc_id.  Classes are told apart by a 128-bit digest of their whole sets, folded to
63 bits.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._shared import components, drop, keep

BLOCK_BITS = 20
"""Cells in a block of the sketch, as a power of two."""
SLICE_BITS = 28
"""Cells in a slice of the sketch, which is broadcast by itself, as a power of two (32 MB)."""
SKETCH_BITS = 30
"""Cells of the sketch at most, as a power of two: four slices, 128 MB."""
FINER_BITS = 4
"""Where there are more words than cells: for each word so many cells to count in, as a power of two."""
COUNT_TOKENS = 1 << 22
"""Tokens that a task counts at a time, of 4 bytes each."""
HEAVY_BITS = 20
"""Counters for frequent tokens, as a power of two."""
SMALL = 32
"""Members of a bucket that is compared at once."""
BLOCK = 256
"""Members of a block of a larger bucket, about."""
BLOCK_TOKENS = 1 << 22
"""Tokens of a block, about, of 8 bytes each: a bucket of long texts has more blocks, of fewer members."""
RANGE_TOKENS = 1 << 19
"""Tokens that are matched at a time where two blocks are compared."""
FEW = 500_000
"""Ids that are broadcast at most, 8 bytes each."""


def prefix_length(n: int, percent: int) -> int:
    """Tokens of a set of n of which two sets with 100 J >= percent share one at least."""
    return n - -(-percent * n // 100) + 1 if n else 0


def overlap_needed(a: int, b: int, percent: int) -> int:
    """Least intersection i of sets of a and b tokens with 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def _set(codes: np.ndarray, size: int) -> np.ndarray:
    return W.distinct(W.shingles(codes, size))


def _sets(batch: pa.RecordBatch, size: int):
    data, at = W.utf8(batch.column("text"))
    for row, codes in W.row_words(data, at, W.SPACE_SEPARATED, True):
        yield row, _set(codes, size)


_BLOCKS = pa.schema([("block", pa.int64()), ("ones", pa.binary()), ("more", pa.binary())])


def _pack_cells(cells: np.ndarray) -> bytes:
    """Sorted distinct cells of a block, as steps whose bytes are laid out by place, since the upper ones are mostly 0."""
    return zlib.compress(np.diff(cells, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack_cells(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def _count(size: int, cell_bits: int, finer: int = 0, only: Callable[[pa.RecordBatch], np.ndarray] | None = None):
    """Sketch rows of a task: for each block, its cells and a bit for those that are seen again, and counts.

    No array of all cells is made, so that a task's memory does not grow with them.  finer: bits by which each cell is
    told apart into others while they are counted.  only: which rows of a batch are counted.
    """
    inside = BLOCK_BITS + finer

    def run(batches):
        heavy = np.zeros(1 << HEAVY_BITS, dtype=np.uint32)
        held: list[np.ndarray] = []

        def blocks():
            cells = np.concatenate(held)
            held.clear()
            cells.sort()
            new = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
            again = np.diff(np.append(new, len(cells))) > 1
            cells = cells[new]
            number = cells >> cells.dtype.type(inside)
            first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
            cells = (cells & cells.dtype.type((1 << inside) - 1)).astype(np.uint32)
            out = [(int(number[i]), _pack_cells(cells[i:j]), np.packbits(again[i:j]).tobytes()) for i, j in zip(first, np.append(first[1:], len(cells)), strict=True)]
            return pa.RecordBatch.from_pydict({f.name: [r[k] for r in out] for k, f in enumerate(_BLOCKS)}, schema=_BLOCKS)

        n = 0
        for batch in batches:
            some, m = [], 0
            for _, tokens in _sets(batch if only is None else batch.filter(pa.array(only(batch))), size):
                some.append(tokens)
                m += len(tokens)
                if m > 1 << 18:
                    n += _counted(some, heavy, held, cell_bits, finer)
                    some, m = [], 0
                if n > COUNT_TOKENS:
                    yield blocks()
                    n = 0
            if some:
                n += _counted(some, heavy, held, cell_bits, finer)
        if n:
            yield blocks()
        yield pa.RecordBatch.from_pydict({"block": [-1], "ones": [zlib.compress(heavy.tobytes(), 1)], "more": [b""]}, schema=_BLOCKS)

    return run


def _counted(some: list[np.ndarray], heavy: np.ndarray, held: list[np.ndarray], cell_bits: int, finer: int) -> int:
    """Add tokens to the counters and their cells to held; how many they are."""
    tokens = np.concatenate(some)
    heavy += np.bincount((tokens >> np.uint64(64 - HEAVY_BITS)).astype(np.int64), minlength=len(heavy)).astype(np.uint32)
    cells = tokens & np.uint64((1 << cell_bits) - 1)
    if finer:  # block, then the finer bits, then the cell in its block
        low = np.uint64((1 << BLOCK_BITS) - 1)
        above = (tokens >> np.uint64(cell_bits)) & np.uint64((1 << finer) - 1)
        held.append(((cells & ~low) << np.uint64(finer)) | (above << np.uint64(BLOCK_BITS)) | (cells & low))
    else:
        held.append(cells.astype(np.uint32))
    return len(tokens)


def _merge_blocks(finer: int):
    def merge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One block's rows, one at a time: what two tasks have seen once each is seen again."""
        block, ones, more = None, None, None
        held = []  # finer cells, of 4 bytes each, with a bit for those that are seen again
        for batch in rows:
            for k, a, b in zip(batch.column("block").to_pylist(), batch.column("ones"), batch.column("more"), strict=True):
                block = k
                if k < 0:
                    part = np.frombuffer(zlib.decompress(a.as_py()), dtype=np.uint32).astype(np.uint64)
                    ones = part if ones is None else ones + part
                    continue
                cells = _unpack_cells(a.as_py())
                again = np.unpackbits(np.frombuffer(b.as_py(), dtype=np.uint8), count=len(cells)).astype(bool)
                if finer:
                    held.append((cells << 1 | again).astype(np.uint32))
                    continue
                if ones is None:
                    ones, more = np.zeros((2, 1 << BLOCK_BITS), dtype=bool)
                more[cells[again | ones[cells]]] = True
                ones[cells] = True
        if held:
            cells = np.concatenate(held)
            held.clear()
            cells.sort()
            again = (cells & np.uint32(1)).astype(bool)
            cells >>= np.uint32(1)
            again[1:] |= cells[1:] == cells[:-1]
            more = np.zeros(1 << BLOCK_BITS, dtype=bool)
            more[cells[again] & np.uint32((1 << BLOCK_BITS) - 1)] = True
        if block is not None:
            bits = (np.log2(ones.astype(np.float64) + 1) * 2).astype(np.uint8) if block < 0 else np.packbits(more, bitorder="little")
            yield pa.RecordBatch.from_pydict({"block": [block], "bits": [zlib.compress(bits.tobytes(), 1)]}, schema=pa.schema([("block", pa.int64()), ("bits", pa.binary())]))

    return merge


class Sketch:
    """Which tokens another document may hold: broadcast slices of bits, of which the driver holds one at a time, and counters."""

    def __init__(self, texts: DataFrame, size: int, cell_bits: int, finer: int = 0, only: Callable[[pa.RecordBatch], np.ndarray] | None = None):
        context = texts.sparkSession.sparkContext
        counted = (texts if only else texts.select("text")).mapInArrow(_count(size, cell_bits, finer, only), "block long, ones binary, more binary")
        merged = keep(counted.groupBy("block").applyInArrow(_merge_blocks(finer), "block long, bits binary"), "sketch")
        self.cell_bits, self.slices = cell_bits, []
        blocks, step = 1 << (min(cell_bits, SLICE_BITS) - BLOCK_BITS), 1 << (BLOCK_BITS - 3)
        for k in range(1 << max(0, cell_bits - SLICE_BITS)):
            bits = np.zeros(blocks * step, dtype=np.uint8)
            for r in merged.where(f"block >= {k * blocks} and block < {(k + 1) * blocks}").toLocalIterator():
                at = (r["block"] - k * blocks) * step
                bits[at : at + step] = np.frombuffer(zlib.decompress(r["bits"]), dtype=np.uint8)
            self.slices.append(context.broadcast(bits))
        heavy = merged.where("block < 0").first()
        self.heavy = context.broadcast(np.frombuffer(zlib.decompress(heavy["bits"]), dtype=np.uint8) if heavy else np.zeros(1 << HEAVY_BITS, dtype=np.uint8))
        drop(merged)

    def again(self, tokens: np.ndarray) -> np.ndarray:
        """Which of tokens may be seen again."""
        cells = (tokens & np.uint64((1 << self.cell_bits) - 1)).astype(np.int64)
        if len(self.slices) == 1:
            return (self.slices[0].value[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 > 0
        out, number = np.zeros(len(tokens), dtype=bool), cells >> SLICE_BITS
        for k, bits in enumerate(self.slices):
            at = np.flatnonzero(number == k)
            some = cells[at] & ((1 << SLICE_BITS) - 1)
            out[at] = (bits.value[some >> 3] >> (some & 7).astype(np.uint8)) & 1 > 0
        return out

    def drop(self) -> None:
        """Free the executors' memory."""
        for bits in (*self.slices, self.heavy):
            bits.unpersist()


def _order_codes(tokens: np.ndarray, k: int) -> np.ndarray:
    return W.mix(tokens ^ np.uint64((0xA0761D6478BD642F * k) & (1 << 64) - 1))


def _prefixes(tokens: np.ndarray, percent: int, sketch: Sketch):
    """First-order prefix tokens that another set may hold."""
    p = prefix_length(len(tokens), percent)
    again = sketch.again(tokens)
    alone = len(tokens) - int(again.sum())
    if alone >= p:  # a token of one set only makes no candidate
        return None
    rest = tokens[again]
    return rest[np.lexsort((rest, sketch.heavy.value[(rest >> np.uint64(64 - HEAVY_BITS)).astype(np.int64)]))[: p - alone]]


def _hash_prefix(tokens: np.ndarray, k: int, percent: int) -> np.ndarray:
    """The prefix under the k-th hash order; it is made from the set where it is needed, so that it is never shuffled."""
    p, codes = prefix_length(len(tokens), percent), _order_codes(tokens, k)
    return np.sort(np.partition(codes, p - 1)[:p] if p < len(codes) else codes)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("class", pa.int64()), ("n", pa.int64()), ("first", pa.list_(pa.int64())), ("tokens", pa.binary())])


def _sign(size: int, percent: int, sketch: Sketch):
    def run(batches):
        written = set()  # of a task's copies only the first carries prefixes and tokens
        for batch in batches:
            cols: list[list] = [[] for _ in _SIGNED]
            ids = batch.column("doc_id").to_pylist()
            for row, tokens in _sets(batch, size):
                first, held = None, None
                digest = int.from_bytes(blake2b(tokens.tobytes(), digest_size=16).digest()[:8], "little") >> 1
                if len(tokens) and digest not in written and (found := _prefixes(tokens, percent, sketch)) is not None:
                    written.add(digest)
                    first, held = found.view(np.int64), tokens.tobytes()
                for col, v in zip(cols, (ids[row], digest, len(tokens), first, held), strict=True):
                    col.append(v)
                if len(cols[0]) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, _SIGNED, strict=True)], schema=_SIGNED)
                    cols = [[] for _ in _SIGNED]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, _SIGNED, strict=True)], schema=_SIGNED)

    return run


def _passes(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Do two sets pass the size bound, the filters of both hash orders and the comparison?"""
    small, large = sorted((len(x), len(y)))
    if 100 * small < percent * large:
        return False
    if not all(len(np.intersect1d(_hash_prefix(x, k, percent), _hash_prefix(y, k, percent), assume_unique=True)) for k in (1, 2)):
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= overlap_needed(len(x), len(y), percent)


def _unpacked(tokens) -> np.ndarray:
    return np.frombuffer(tokens.as_buffer(), dtype=np.uint64)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verify(percent: int):
    """The pairs (a, b) that are linked."""

    def run(batches):
        for batch in batches:
            kept = [_passes(_unpacked(x), _unpacked(y), percent) for x, y in zip(batch.column("ta"), batch.column("tb"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(kept, pa.bool_())) for c in ("a", "b")], schema=_LINKS)

    return run


def _ranges(sets: list[np.ndarray], tokens: int) -> Iterator[list[np.ndarray]]:
    """The parts of sorted sets in equal ranges of codes, which hold about so many tokens each, as codes are hashes."""
    n = max(1, -(-sum(map(len, sets)) // tokens))
    at = [0] * len(sets)
    for k in range(1, n + 1):
        to = [len(t) if k == n else int(np.searchsorted(t, np.uint64((k << 64) // n))) for t in sets]
        yield [t[i:j] for t, i, j in zip(sets, at, to, strict=True)]
        at = to


def _shared(x: list[np.ndarray], y: list[np.ndarray], width: int = 4096, tokens: int = RANGE_TOKENS) -> np.ndarray:
    """The intersection sizes of all of x with all of y, sorted sets, by products of indicator matrices, width tokens at a time."""
    out = np.zeros((len(x), len(y)), dtype=np.int64)
    for parts in _ranges([*x, *y], tokens):
        sizes = [len(t) for t in parts]
        values, column = np.unique(np.concatenate(parts), return_inverse=True)
        row = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for start in range(0, len(values), width):
            lo, hi = np.searchsorted(column, [start, start + width])
            part = np.zeros((len(sizes), width), dtype=np.float32)
            part[row[lo:hi], column[lo:hi] - start] = 1
            out += (part[: len(x)] @ part[len(x) :].T).astype(np.int64)
    return out


def _compare_blocks(percent: int):
    """Links that join the components of two blocks of one bucket: the sets are compared in numpy, no pair is a row."""

    def run(table: pa.Table) -> pa.Table:
        classes, labels, own = (table.column(c).to_numpy() for c in ("class", "label", "own"))
        sets = [_unpacked(x) for chunk in table.column("tokens").chunks for x in chunk]
        bi, bj = table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
        left, right = np.flatnonzero(own == bi), np.flatnonzero(own == bj)
        n = np.array([len(t) for t in sets])
        small, large = np.minimum.outer(n[left], n[right]), np.maximum.outer(n[left], n[right])
        open_pairs = (100 * small >= percent * large) & (labels[left][:, None] != labels[right][None, :])
        if bi == bj:
            open_pairs &= left[:, None] < right[None, :]
        if len(left) * len(right) > 64:
            for k in (1, 2):
                if open_pairs.any():
                    open_pairs &= _shared([_hash_prefix(sets[i], k, percent) for i in left], [_hash_prefix(sets[j], k, percent) for j in right]) > 0
            if open_pairs.any():
                total = n[left][:, None] + n[right][None, :]
                open_pairs &= _shared([sets[i] for i in left], [sets[j] for j in right]) >= -(-percent * total // (100 + percent))
            found = np.argwhere(open_pairs)
        else:
            found = [(i, j) for i, j in np.argwhere(open_pairs) if _passes(sets[left[i]], sets[right[j]], percent)]
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            while parent.get(v, v) != v:
                v = parent[v]
            return v

        out_a, out_b = [], []
        for i, j in found:
            a, b = root(int(labels[left[i]])), root(int(labels[right[j]]))
            if a != b:  # a link within what is joined already adds nothing
                parent[max(a, b)] = min(a, b)
                out_a.append(int(classes[left[i]]))
                out_b.append(int(classes[right[j]]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())}, schema=_LINKS)

    return run


def sketch_bits(n_chars: int) -> int:
    """Cells for the sketch, as a power of two: one or two cells for each word, between 2^20 and 2^SKETCH_BITS.

    The bound holds at any input.  Where cells are fewer than words more tokens look repeated, so more prefix tokens are
    written out; results stay the same.
    """
    return min(SKETCH_BITS, max(20, int(np.ceil(np.log2(max(1, n_chars) / 6)))))


def finer_bits(n_chars: int) -> int:
    """Bits by which cells are told apart while they are counted, where there are more words than cells, else 0.

    Then only what is seen again fills cells, and not what shares a cell with something else; at most 11, so that a cell
    in its block has 32 bits.
    """
    bits = int(np.ceil(np.log2(max(1, n_chars) / 6)))
    return min(11, bits - SKETCH_BITS + FINER_BITS) if bits > SKETCH_BITS else 0


def signed_sets(docs: DataFrame, size: int, percent: int, text_bytes: int | None = None) -> DataFrame:
    """One row per document: its class, set size and, where another document may be like it, first-order prefix and set."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if text_bytes is None:
        text_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sketch = Sketch(texts, size, sketch_bits(text_bytes))
    sets = keep(texts.mapInArrow(_sign(size, percent, sketch), "doc_id long, class long, n long, first array<long>, tokens binary"), "sets")
    sketch.drop()
    return sets


def _blocks(members: Column, tokens: Column) -> Column:
    """Blocks of a bucket: of about BLOCK members and BLOCK_TOKENS tokens each."""
    return F.greatest(F.ceil(members / BLOCK), F.ceil(tokens / BLOCK_TOKENS)).cast("int")


def _only(content: DataFrame, classes: DataFrame) -> DataFrame:
    """One row of each of classes, a table that keep() wrote; its ids are broadcast where they are FEW at most."""
    return content.join(F.broadcast(classes) if classes.count() <= FEW else classes, "class", "left_semi").dropDuplicates(["class"])


def class_components(sets: DataFrame, percent: int) -> DataFrame | None:
    """(node, label) of the classes that are linked with another one; None where none is.

    Buckets of up to SMALL members are often equal, as near copies share many tokens: each set of members counts once.
    In every bucket all members are first compared with the one of least class, so that a pair which many buckets hold
    is compared once.  Where that leaves more than one component among three members or more, they are dealt into blocks
    of about BLOCK members and BLOCK_TOKENS tokens, and pairs of blocks are compared, each in a task of its own, passing over pairs of one component.
    Buckets of one pivot are pooled for that where it sends no more rows to blocks.
    """
    content = sets.where("tokens is not null").select("class", "tokens")
    members = keep(sets.where("first is not null").select("class", "n", "first").dropDuplicates(["class"]).select("class", "n", F.explode("first").alias("token")), "members")
    counted = members.join(members.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "token")
    # sets of sizes that can be linked lie in one class of sizes or in two neighbouring ones: a large bucket is parted by them
    step = F.floor(F.log("n") / F.lit(1.0001 * math.log(100 / percent) if percent < 100 else 1e-9))
    parted = counted.where(F.col("m") > SMALL).withColumn("c", F.explode(F.array(step, step - 1))).select("class", "n", F.xxhash64("token", "c").alias("token"))
    parted = keep(parted, "parted")
    parted_m = parted.join(parted.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "token")
    counted = keep(counted.where(F.col("m") <= SMALL).unionByName(parted_m), "counted")
    equal = counted.where(F.col("m") <= SMALL).groupBy("token").agg(F.array_sort(F.collect_list(F.struct("n", "class"))).alias("xs"))
    # a member stays if the next smaller or the next larger one passes the bound on sizes with it
    near = F.filter("xs", lambda x, i: ((i > 0) & (100 * F.get("xs", i - 1)["n"] >= percent * x["n"])) | F.coalesce(100 * x["n"] >= percent * F.get("xs", i + 1)["n"], F.lit(False)))
    equal = keep(equal.select(near.alias("xs")).where("size(xs) > 1").distinct(), "equal")
    large = counted.where(F.col("m") > SMALL)
    pivots = large.groupBy("token").agg(F.min(F.struct("class", "n")).alias("pivot"))
    near_pivot = 100 * F.least("n", "pivot.n") >= percent * F.greatest("n", "pivot.n")
    starred = equal.select(F.array_min(F.transform("xs", lambda x: F.struct(x["class"].alias("class"), x["n"].alias("n")))).alias("pivot"), F.inline("xs"))
    starred = starred.unionByName(large.join(pivots, "token").select("pivot", "n", "class"))
    comp = None
    star = keep(starred.where("class <> pivot.class").where(near_pivot).select(F.col("class").alias("a"), F.col("pivot.class").alias("b")).distinct(), "star")
    # the comparison with the pivot is all that a bucket of two needs
    small = equal.where("size(xs) > 2").select(F.xxhash64("xs").alias("token"), F.inline("xs"), _blocks(F.size("xs"), F.aggregate("xs", F.lit(0).cast("long"), lambda total, x: total + x["n"])).alias("nb"))
    if not star.isEmpty():
        ids = keep(star.select(F.col("a").alias("class")).union(star.select("b")).distinct(), "ids")
        some = keep(_only(content, ids), "content")
        left = some.select(F.col("class").alias("a"), F.col("tokens").alias("ta"))
        right = some.select(F.col("class").alias("b"), F.col("tokens").alias("tb"))
        found = keep(star.join(left, "a").join(right, "b").select("ta", "tb", "a", "b").mapInArrow(_verify(percent), "a long, b long"), "found")
        if not found.isEmpty():
            comp = keep(components(found), "comp")
        drop(found)
        drop(some)
        drop(ids)
    drop(star)
    large = large.join(large.groupBy("token").agg(_blocks(F.count(F.lit(1)), F.sum("n")).alias("nb")), "token")
    named = lambda rows: rows.withColumn("label", F.col("class")) if comp is None else rows.join(comp.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    rows = keep(named(small.unionByName(large.select("token", "class", "n", "nb"))), "rows")
    still = rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("class").alias("p")).where("lo <> hi").select("token", "p")
    held, rows = rows, keep(rows.join(still, "token"), "still")
    # open buckets of one pivot overlap: they are one bucket where that sends no more rows to blocks
    pooled = rows.select("p", "class", "n", "label").distinct()
    pools = pooled.groupBy("p").agg(F.count(F.lit(1)).alias("m"), _blocks(F.count(F.lit(1)), F.sum("n")).alias("pool"))
    pools = keep(pools.join(rows.groupBy("p").agg(F.sum("nb").alias("sent")), "p").where(F.col("m") * F.col("pool") <= F.col("sent")).select("p", "pool"), "pools")
    apart = rows.join(pools, "p", "left_anti").select("token", "class", "label", "nb")
    pooled = pooled.join(pools, "p").select(F.xxhash64("p", F.lit("pool")).alias("token"), "class", "label", F.col("pool").alias("nb"))
    still, rows = rows, pooled.unionByName(apart).withColumn("own", F.pmod(F.xxhash64("class", F.lit(7)), F.col("nb")).cast("int"))
    rows = keep(rows, "open")
    open_ids = keep(rows.select("class").distinct(), "ids")
    dealt = rows.join(_only(content, open_ids), "class").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.select("token", "class", "label", "own", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "tokens")
    joined = keep(dealt.groupBy("token", "bi", "bj").applyInArrow(_compare_blocks(percent), "a long, b long"), "found")
    for kept in (members, parted, counted, equal, held, still, pools, rows, open_ids):
        drop(kept)
    if not joined.isEmpty():
        before = comp
        grown = joined if comp is None else joined.unionByName(comp.select(F.col("node").alias("a"), F.col("label").alias("b")))
        comp = keep(components(grown), "comp")
        drop(before)
    drop(joined)
    return comp


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, text_bytes: int | None = None) -> DataFrame:
    """doc_id, n_shingles, class, component_id of each row of docs.

    Links join rows whose sets of size-word shingles have 100 |intersection| >= percent |union|.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must lie in 1..100")
    sets = signed_sets(docs, size, percent, text_bytes)
    comp = class_components(sets, percent)
    rows = sets.select("doc_id", "class", F.col("n").alias("n_shingles"))
    filled = rows.where("n_shingles > 0")
    by_class = filled.groupBy("class").agg(F.min("doc_id").alias("least"))
    if comp is not None:
        labelled = by_class.join(comp.withColumnRenamed("node", "class"), "class", "left").select("class", "least", F.coalesce("label", "class").alias("label"))
        joined = labelled.where("label <> class").groupBy("label").agg(F.min("least").alias("m"))
        by_class = labelled.join(joined, "label", "left").join(by_class.select(F.col("class").alias("label"), F.col("least").alias("root")), "label", "left").select("class", F.least("least", "m", "root").alias("least"))
    named = filled.join(by_class, "class", "left").select("doc_id", "n_shingles", "class", F.col("least").alias("component_id"))
    return named.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", "class", F.col("doc_id").alias("component_id")))
