"""Near-duplicate passages by compact windows (Deng et al., "Near-Duplicate Sequence Search at Scale", 2023).

A text is a sequence of five-word shingles, and a passage is a window of `words` words, so of w = words - size + 1
shingles.  Two passages of different texts are repeats if the multisets of their shingles have a Jaccard similarity of
percent or more; two passages of one text that share no word are repeats if they are equal.  Texts of the same words, in
lower case, are one text; a text that several documents hold is repeated from end to end.

1. A counted sketch (as op4's) tells which shingles other documents may hold.  A passage that has a partner shares
   least_shared() shingles with it, so only passages with that many such shingles live on.  Equal passages of one text
   are found where it is read.
2. For each hash function the Cartesian tree over the hashes of a stretch of living passages gives its compact windows
   (l, c, r): all sequences within [l, r] that hold c have their least hash at c.  Nodes whose windows are shorter than w
   are left out.
3. The compact windows of a band's AGREE functions are joined as intervals: each piece [a, b] of starts has their least
   hashes in common, and these are its signature.  Two passages of Jaccard similarity J share a band's signature with
   probability J^AGREE, and one of BANDS with 1 - (1 - J^AGREE)^BANDS: 0.998 at 0.8 for four bands of one function, which
   is more than five bands of two give (0.994) at half the pieces; what agrees by chance is sorted out by comparison.
4. Pieces of one signature and one content are a class; a class that stands in two places is a repeat.  Different classes
   of one signature are compared exactly.  A large group is dealt into blocks with its commonest class in each: classes
   are compared within their block and with that one.  Windows that this leaves open ask the whole group, in parts by
   their rarest shingles, of which two windows that are alike share one.

So a found passage is always a true one, and one without equal is missed with the probability above at most, in practice
less, as a repeat has many passages.  Windows that repeat shingles inside may have fewer signatures in common.

Null and short texts have no passage.  Rows that are equal in doc_id and text are one row; a null doc_id is a value of
its own.  Columns of docs beside doc_id and text are left out.  An empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._shared import drop, keep
from .jaccard import _BLOCKS, BLOCK_BITS, COUNT_TOKENS, HEAVY_BITS, SLICE_BITS, Sketch, _merge_blocks, _pack_cells, finer_bits, sketch_bits

BANDS = 4
"""Signatures of a passage."""
AGREE = 1
"""Hash functions of a signature."""
SPLIT = 1024
"""Classes of a group from which it is dealt into blocks, and what these leave open is split by rarest shingles."""
BLOCK = 512
"""Classes of a block, about, and those that a task compares classes with open windows with at a time."""
FEW_COPIES = 1 << 23
"""Copies of other texts that are broadcast at most, 8 bytes each, to pass over them; of further ones each task passes over its own."""
OPEN = 2 * BLOCK
"""Classes with open windows that meet all others of a part in one task, about."""
PART_BITS = 9
"""Cells of the sketch of parts for each class of a large group, as a power of two."""
FEW = 4
"""Classes of a group in which pairs are compared one by one."""
ROWS = 512
"""Windows of a larger group that are compared with others at a time."""


def least_shared(width: int, percent: int) -> int:
    """Shingles that two windows of width shingles share at least at this similarity: i / (2 width - i) >= percent / 100."""
    return -(-2 * percent * width // (100 + percent))


def _seed(k: int) -> np.uint64:
    return np.uint64((0x9E3779B97F4A7C15 * (2 * k + 3)) & ((1 << 64) - 1))


def _tops(hashes: np.ndarray, ok: np.ndarray, width: int) -> np.ndarray:
    """Places of the least hash, the first at ties, of the windows that start at ok (sorted)."""
    least, have = hashes, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    values = least[ok]
    new = np.flatnonzero(np.concatenate(([True], (values[1:] != values[:-1]) | (ok[1:] != ok[:-1] + 1))))
    out = []
    for value, start, stop in zip(values[new], ok[new].tolist(), ok[np.append(new[1:], len(ok)) - 1].tolist(), strict=True):
        while start <= stop:  # a value that comes again takes over where its first place falls out
            out.append(start + int((hashes[start : start + width] == value).argmax()))
            start = out[-1] + 1
    return np.unique(np.array(out, dtype=np.int64))


def compact_windows(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray, ok: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the nodes of width places or more in the Cartesian trees over hashes[lo[i] : hi[i]], by c.

    ok: the starts of windows of width places in these stretches, sorted.  The parent of such a node is one too, so the
    upper part of each tree is built by itself, with a stack.
    """
    tops = _tops(hashes, ok, width)
    owner = np.searchsorted(lo, tops, side="right") - 1
    left, right = lo[owner].tolist(), (hi[owner] - 1).tolist()
    values, places, owners = hashes[tops].tolist(), tops.tolist(), owner.tolist()
    stack: list[int] = []
    for k in range(len(places)):
        if stack and owners[stack[-1]] != owners[k]:
            stack.clear()
        while stack and values[stack[-1]] > values[k]:
            right[stack.pop()] = places[k] - 1
        if stack:
            left[k] = places[stack[-1]] + 1
        stack.append(k)
    return np.array(left, dtype=np.int64), tops, np.array(right, dtype=np.int64)


def pieces(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int, bands: int = BANDS, agree: int = AGREE):
    """(band, signature, first start, last start, place of the first function's least hash) over stretches of codes."""
    # stretches may overlap, so each is laid out by itself
    size = hi - lo
    base = np.cumsum(size) - size
    codes = codes[np.repeat(lo - base, size) + np.arange(int(size.sum()))]
    n = size - width + 1  # windows of each stretch
    ok = np.repeat(base - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    out = []
    for band in range(bands):
        start = last = sig = place = None
        for k in range(band * agree, (band + 1) * agree):
            hashes = W.mix(codes ^ _seed(k))
            left, c, right = compact_windows(hashes, base, base + size, ok, width)
            first, until = np.maximum(left, c - width + 1), np.minimum(c, right - width + 1)  # the starts of its windows of width places
            if start is None:
                start, last, sig, place = first, until, W.mix(hashes[c] + np.uint64(band)), c
                continue
            joined = np.union1d(start, first)
            i, j = np.searchsorted(start, joined, side="right") - 1, np.searchsorted(first, joined, side="right") - 1
            start, last, sig, place = joined, np.minimum(last[i], until[j]), W.mix(sig[i] * np.uint64(3) + hashes[c[j]]), place[i]
        back = (lo - base)[np.searchsorted(base, start, side="right") - 1]
        out.append((np.full(len(start), band), sig, start + back, last + back, place + back))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_RUNS = pa.schema([("doc_id", pa.int64()), ("row", pa.binary()), ("n_words", pa.int32()), ("at", pa.list_(pa.int32())), ("codes", pa.binary()), ("sig", pa.list_(pa.int64())), ("ctx", pa.list_(pa.int64())), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("off", pa.list_(pa.int16())), ("own", pa.list_(pa.int32()))])
_RUNS_DDL = "doc_id long, row binary, n_words int, at array<int>, codes binary, sig array<long>, ctx array<long>, a array<int>, b array<int>, off array<short>, own array<int>"


def _alive(s: np.ndarray, begin: np.ndarray, end: np.ndarray, again: np.ndarray, width: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """[lo, hi) of the stretches of s, within its texts [begin, end), whose windows all have need shingles that come again."""
    sums = np.concatenate(([0], np.cumsum(again)))
    ok = np.zeros(len(s) + 1, dtype=bool)
    ok[: len(s) - width + 1] = sums[width:] - sums[:-width] >= need
    inside = np.zeros(len(s) + 2, dtype=np.int32)  # a window lies in one text
    long = end - begin >= width
    np.add.at(inside, begin[long], 1)
    np.add.at(inside, end[long] - width + 1, -1)
    ok &= np.cumsum(inside)[: len(ok)] > 0
    edge = np.diff(np.concatenate(([0], ok.astype(np.int8), [0])))
    return np.flatnonzero(edge > 0), np.flatnonzero(edge < 0) + width - 1


def _own_repeats(s: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted starts of the windows that come again, word for word and words away or more, in their own text; their texts."""
    text = np.repeat(np.arange(len(begin)), end - begin)
    order = np.argsort(s, kind="stable")
    same = (s[order[1:]] == s[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    twice = np.zeros(len(s) + 1, dtype=np.int64)
    twice[order[1:][same]] = twice[order[:-1][same]] = 1
    sums = np.concatenate(([0], np.cumsum(twice[:-1])))
    start = np.flatnonzero(sums[width:] - sums[:-width] == width)
    start = start[start + width <= end[text[start]]]
    if not len(start):
        return start, start
    up, down = W._power_tables(len(s) + 1)
    total = np.zeros(len(s) + 1, dtype=np.uint64)
    np.cumsum(s * up[: len(s)], out=total[1:])
    code = W.mix((total[start + width] - total[start]) * down[start] + text[start].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, kind = np.unique(code, return_inverse=True)
    first, last = np.full(kind.max() + 1, len(s)), np.full(kind.max() + 1, -1)
    np.minimum.at(first, kind, start)
    np.maximum.at(last, kind, start)
    start = start[(start - first[kind] >= words) | (last[kind] - start >= words)]
    return start, text[start]


class Copies:
    """Rows whose text a row of lesser doc_id holds, by 64 bits of both, in a broadcast array."""

    def __init__(self, marks: DataFrame):
        some = marks if marks.count() <= FEW_COPIES else marks.limit(FEW_COPIES)
        self.marks = marks.sparkSession.sparkContext.broadcast(np.sort(some.toArrow().column("mark").to_numpy()))

    def first(self, batch: pa.RecordBatch) -> np.ndarray:
        """Which rows aren't such ones."""
        marks, mark = self.marks.value, batch.column("mark")
        if not len(marks):
            return np.ones(len(batch), dtype=bool)
        known = mark.is_valid().to_numpy(zero_copy_only=False)
        mark = mark.fill_null(0).to_numpy()
        return ~known | (marks[np.minimum(np.searchsorted(marks, mark), len(marks) - 1)] != mark)

    def drop(self) -> None:
        """Free the executors' memory."""
        self.marks.unpersist()


def _emit(size: int, width: int, percent: int, sketch: Sketch, copies: Copies):
    need = least_shared(width, percent)

    def run(batches):
        written = set()  # of a task's copies only the first carries pieces
        for batch in batches:
            data, at = W.utf8(batch.column("text"))
            ids, first_of = batch.column("doc_id").to_pylist(), copies.first(batch).tolist()
            for first_row, last_row in W.chunks(at):
                words = W.Words(data, at[first_row : last_row + 1], W.SPACE_SEPARATED, True)
                cols: list[list] = [[] for _ in _RUNS]
                n = np.diff(words.first)
                held, begin, end, total = [], [], [], 0
                for k in np.flatnonzero(n >= width + size - 1).tolist():
                    codes = words.codes[words.first[k] : words.first[k + 1]]
                    row = blake2b(codes.tobytes(), digest_size=16).digest()
                    for col, v in zip(cols[:3], (ids[first_row + k], row, int(n[k])), strict=True):
                        col.append(v)
                    begin.append(total)
                    if first_of[first_row + k] and row not in written:
                        written.add(row)
                        held.append(W.shingles(codes, size))
                        total += len(held[-1])
                    end.append(total)
                lists = [(pa.array(np.zeros(len(begin) + 1, dtype=np.int32)), []) for _ in cols[3:]]
                if held:
                    s = np.concatenate(held)
                    begin, end = np.array(begin), np.array(end)
                    again = sketch.again(s)
                    full = end > begin
                    lo, hi = _alive(s, begin[full], end[full], again, width, need)
                    if len(lo):
                        lists[:-1] = _arrays(s, begin, end, lo, hi, width)
                    start, text = _own_repeats(s, begin, end, width, width + size - 1)
                    new = np.flatnonzero(np.concatenate(([True], (start[1:] != start[:-1] + 1) | (text[1:] != text[:-1])))) if len(start) else start
                    spans = np.stack((start[new], start[np.append(new[1:], len(start)) - 1] + width + size - 1), axis=1) - begin[text[new]][:, None] if len(start) else np.zeros((0, 2))
                    lists[-1] = (pa.array(np.concatenate(([0], 2 * np.cumsum(np.bincount(text[new], minlength=len(begin))))).astype(np.int32)), spans.ravel().astype(np.int32))
                arrays = [pa.array(c, type=f.type) for c, f in zip(cols[:3], _RUNS, strict=False)]
                for (offsets, values), f in zip(lists, list(_RUNS)[3:], strict=True):
                    if f.name == "codes":
                        arrays.append(pa.array(values if len(values) else [None] * len(cols[0]), type=f.type))
                    else:
                        arrays.append(pa.ListArray.from_arrays(offsets, pa.array(values, type=f.type.value_type)))
                if len(cols[0]):
                    yield pa.RecordBatch.from_arrays(arrays, schema=_RUNS)

    return run


def _arrays(s, begin, end, lo, hi, width):
    """The columns at, codes, sig, ctx, a, b and off, by text: offsets and values."""
    _, sig, a, b, c = pieces(s, lo, hi, width)
    up, down = W._power_tables(len(s) + 1)
    sums = np.zeros(len(s) + 1, dtype=np.uint64)
    np.cumsum(s * up[: len(s)], out=sums[1:])
    stop = b + width
    ctx = W.mix((sums[stop] - sums[a]) * down[a] + (stop - a).astype(np.uint64))  # a piece's content
    order = np.argsort(a, kind="stable")
    sig, ctx, a, b, c = sig[order], ctx[order], a[order], b[order], c[order]

    # texts without a shingle of their own (copies) begin and end at one place: they get no piece
    full = np.flatnonzero(end > begin)

    def offsets(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = np.zeros(len(begin), dtype=np.int64)
        owner = full[np.searchsorted(begin[full], places, side="right") - 1]
        np.add.at(count, owner, 1)
        return np.concatenate(([0], np.cumsum(count))), owner

    piece_at, owner = offsets(a)
    stretch_at, text = offsets(lo)
    at = np.stack((lo - begin[text], hi - begin[text]), axis=1).ravel()
    short = (s >> np.uint64(32)).astype(np.uint32)
    codes: list = [None] * len(begin)
    for k in np.unique(text).tolist():
        codes[k] = b"".join(short[x:y].tobytes() for x, y in zip(lo[stretch_at[k] : stretch_at[k + 1]].tolist(), hi[stretch_at[k] : stretch_at[k + 1]].tolist(), strict=True))
    small = lambda x: pa.array(x.astype(np.int32))
    own = small(piece_at)
    return [(small(2 * stretch_at), at.astype(np.int32)), (None, codes), (own, sig.view(np.int64)), (own, ctx.view(np.int64)), (own, (a - begin[owner]).astype(np.int32)), (own, (b - begin[owner]).astype(np.int32)), (own, (c - a).astype(np.int16))]


_MEMBERS = pa.schema([("sig", pa.int64()), ("block", pa.int32()), ("ctx", pa.int64()), ("a", pa.int32()), ("off", pa.int16()), ("row", pa.binary()), ("row2", pa.binary()), ("kind", pa.int8()), ("codes", pa.binary())])
_MEMBERS_DDL = "sig long, block int, ctx long, a int, off short, row binary, row2 binary, kind byte, codes binary"
# kinds: what a class is to its group; LARGE: its group has several blocks
SINGLE, SEVERAL, REPEATED, PIVOT, LARGE = 1, 2, 4, 8, 16


def _contents(batch: pa.RecordBatch, width: int):
    """Each text's digest, and the classes asked for with their codes."""
    for row, at, codes, asked in zip(*(batch.column(c) for c in ("row", "at", "codes", "asked")), strict=True):
        at = np.array(at.as_py(), dtype=np.int64).reshape(-1, 2)
        begin = (np.cumsum(at[:, 1] - at[:, 0]) - at[:, 1]).tolist()  # less a stretch's first place
        first = at[:, 0].tolist()
        held = np.frombuffer(codes.as_py(), dtype=np.uint32)
        out = []
        for x in asked.as_py():
            p = begin[bisect_right(first, x["a"]) - 1] + x["a"]
            out.append((x, held[p : p + x["b"] - x["a"] + width]))
        yield row.as_py(), out


def rare_tokens(codes: np.ndarray, counts: np.ndarray, width: int, need: int) -> np.ndarray:
    """Of each window the first width - need + 1 tokens in an order of all tokens, rare shingles first: windows x tokens.

    A token is a shingle and how often it stood in the window before.  Two windows that share need of width tokens share
    one of these at least.  counts: how frequent shingles are, by the upper bits of their codes.
    """
    first = width - need + 1
    keys = (counts[codes >> np.uint32(32 - HEAVY_BITS)].astype(np.int64) << 32) | codes
    windows = np.lib.stride_tricks.sliding_window_view
    kinds = np.sort(keys)
    if (kinds[1:] != kinds[:-1]).all():
        return (np.partition(windows(keys, width), first - 1, axis=1)[:, :first] & 0xFFFFFFFF) * width
    kinds = W.distinct(keys)
    rows = np.sort(windows(np.searchsorted(kinds, keys), width), axis=1)
    place = np.arange(width)
    again = np.zeros(rows.shape, dtype=bool)
    again[:, 1:] = rows[:, 1:] == rows[:, :-1]
    level = place - np.maximum.accumulate(np.where(again, 0, place), axis=1)
    # of one shingle the later ones first, which fewer windows hold
    tokens = np.sort(rows * width + (width - 1 - level), axis=1)[:, :first]
    return (kinds[tokens // width] & 0xFFFFFFFF) * width + (width - 1 - tokens % width)


def rarest(codes: np.ndarray, counts: np.ndarray, width: int, need: int) -> np.ndarray:
    """The rare tokens of all windows as one sorted array."""
    return W.distinct(rare_tokens(codes, counts, width, need).ravel())


def _members(width: int):
    """Each class that is asked for with its codes, in its block; the group's commonest class in all blocks."""

    def run(batches):
        for batch in batches:
            for row, asked in _contents(batch, width):
                out: list[list] = [[] for _ in _MEMBERS]
                for x, content in asked:
                    for block in range(x["nb"]) if x["kind"] & PIVOT else (x["ctx"] % x["nb"],):
                        for col, v in zip(out, (x["sig"], block, x["ctx"], x["a"], x["off"], row, x["row2"], x["kind"], content.tobytes()), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _MEMBERS, strict=True)], schema=_MEMBERS)

    return run


def _settled(n: int, kind: int, spans: list[dict] | None) -> np.ndarray:
    """Which of a class's n windows have a partner by these runs."""
    done = np.full(n, bool(kind & REPEATED))
    for x in spans or ():
        done[x["s"] : x["e"] + 1] = True
    return done


_PARTS = pa.schema([("sig", pa.int64()), ("part", pa.int64()), ("ctx", pa.int64()), ("row", pa.binary()), ("row2", pa.binary()), ("asks", pa.bool_())])
_PARTS_DDL = "sig long, part long, ctx long, row binary, row2 binary, asks boolean"


_TOKENS = pa.schema([("sig", pa.int64()), ("ctx", pa.int64()), ("row", pa.binary()), ("row2", pa.binary()), ("tokens", pa.list_(pa.int64())), ("own", pa.list_(pa.int64()))])
_TOKENS_DDL = "sig long, ctx long, row binary, row2 binary, tokens array<long>, own array<long>"


def _tokens(width: int, need: int, heavy):
    """Of each class of a large group the parts that its windows fall into, and those that open ones do."""

    def run(batches):
        for batch in batches:
            tokens: list[np.ndarray] = []
            own: list[np.ndarray] = []
            for kind, codes, spans in zip(*(batch.column(c).to_pylist() for c in ("kind", "codes", "spans")), strict=True):
                found = rare_tokens(np.frombuffer(codes, dtype=np.uint32), heavy.value, width, need)
                still = ~_settled(len(found), kind, spans)
                tokens.append(W.distinct(found.ravel()))
                own.append(tokens[-1] if still.all() else W.distinct(found[still].ravel()))
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *x]))) for x in (tokens, own)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("sig", "ctx", "row", "row2")), *lists], schema=_TOKENS)

    return run


def _lists(batch: pa.RecordBatch, name: str, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values of a column of lists, the rows that they are of, and their cells of 2^bits."""
    lists = batch.column(name)
    owner = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))
    values = lists.flatten().to_numpy()
    sig = W.mix(batch.column("sig").to_numpy().view(np.uint64))
    return values, owner, (W.mix(sig[owner] + values.view(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _held(bits: int):
    """Blocks of two sketches, as those of shingles: parts that a second class may hold, and, 2^bits cells on, parts of open windows."""

    def blocks(held: list[np.ndarray]) -> pa.RecordBatch:
        cells, times = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        number = cells >> BLOCK_BITS
        new = np.flatnonzero(np.diff(number, prepend=-1))
        cells = (cells & ((1 << BLOCK_BITS) - 1)).astype(np.uint32)
        ends = np.append(new[1:], len(cells))
        return pa.RecordBatch.from_pydict({"block": number[new], "ones": [_pack_cells(cells[i:j]) for i, j in zip(new, ends, strict=True)], "more": [np.packbits(times[i:j] > 1).tobytes() for i, j in zip(new, ends, strict=True)]}, schema=_BLOCKS)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            cells, asks = _lists(batch, "tokens", bits)[2], _lists(batch, "own", bits)[2] + (1 << bits)
            held += [cells, asks, asks]  # one class is enough to ask
            n += len(cells) + 2 * len(asks)
            if n > COUNT_TOKENS:
                yield blocks(held)
                n = 0
        if n:
            yield blocks(held)

    return run


def _parts(bits: int, asked):
    """The parts that each class of a large group takes part in, and whether it asks there.

    asked: a bit for the cells of those that an open window and a second class may hold.
    """

    def run(batches):
        for batch in batches:
            parts, owner, cells = _lists(batch, "tokens", bits)
            own, asker, _ = _lists(batch, "own", bits)
            some = np.flatnonzero((asked.value[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1)
            parts, owner, asks = parts[some], owner[some], np.zeros(len(some), dtype=bool)
            pairs = np.concatenate((np.stack((asker, own), axis=1), np.stack((owner, parts), axis=1)))
            order = np.lexsort((np.arange(len(pairs)), pairs[:, 1], pairs[:, 0]))
            same = np.flatnonzero((pairs[order[1:]] == pairs[order[:-1]]).all(axis=1)) + 1  # what is asked stands before
            asks[order[same] - len(own)] = True
            yield pa.RecordBatch.from_arrays([batch.column("sig").take(pa.array(owner)), pa.array(parts), *(batch.column(c).take(pa.array(owner)) for c in ("ctx", "row", "row2")), pa.array(asks)], schema=_PARTS)

    return run


class Member:
    """A class of pieces of one signature, and which of its windows have a partner so far."""

    __slots__ = ("_kinds", "at", "codes", "ctx", "done", "kind", "off", "texts")

    def __init__(self, codes: np.ndarray, off: int, texts: tuple[bytes, bytes], kind: int, ctx: int, width: int):
        self.codes, self.off, self.texts, self.kind, self.ctx = codes, off, texts, kind, ctx
        self.done = np.full(len(codes) - width + 1, bool(kind & REPEATED))
        self._kinds: set[int] | None = None

    @property
    def kinds(self) -> set[int]:
        if self._kinds is None:
            self._kinds = set(self.codes.tolist())
        return self._kinds

    @property
    def distinct(self) -> bool:
        return len(self.kinds) == len(self.codes)


def _counts(codes: np.ndarray, kinds: np.ndarray, width: int) -> np.ndarray:
    """How often each of kinds (sorted) stands in each window of codes."""
    hit = np.zeros((len(codes) + 1, len(kinds)), dtype=np.int16)
    at = np.minimum(np.searchsorted(kinds, codes), len(kinds) - 1)
    known = np.flatnonzero(kinds[at] == codes)
    hit[known + 1, at[known]] = 1
    sums = np.cumsum(hit, axis=0, dtype=np.int16)
    return sums[width:] - sums[:-width]


def compare(x: Member, y: Member, need: int, width: int) -> None:
    """Mark the windows of x and y that are alike, if another text than x's holds y."""
    plain = x.distinct and y.distinct
    if plain and len(x.kinds & y.kinds) < need or x.texts == y.texts and x.texts[0] == x.texts[1] or x.done.all() and y.done.all():
        return
    if plain:
        _side_by_side(x, y, need, width)
        if x.done.all() and y.done.all():
            return
        n, m = len(x.done), len(y.done)
        sums = np.zeros((len(x.codes) + 1, len(y.codes)), dtype=np.int16)
        np.cumsum(x.codes[:, None] == y.codes[None, :], axis=0, dtype=np.int16, out=sums[1:])
        held = np.zeros((n, len(y.codes) + 1), dtype=np.int16)  # of each window of x, by places of y
        np.cumsum(sums[width:] - sums[:n], axis=1, dtype=np.int16, out=held[:, 1:])
        good = held[:, width:] - held[:, :m] >= need
    else:
        kinds = np.intersect1d(x.codes, y.codes)
        if not len(kinds):
            return
        cx, cy = _counts(x.codes, kinds, width), _counts(y.codes, kinds, width)
        # the sum of least counts: a column for each time that both hold a code
        times = np.minimum(cx.max(axis=0), cy.max(axis=0)).astype(np.int64)
        column = np.repeat(np.arange(len(kinds)), times)
        level = np.arange(len(column)) - np.repeat(np.cumsum(times) - times, times) + 1
        good = (cx[:, column] >= level).astype(np.float32) @ (cy[:, column] >= level).astype(np.float32).T >= need
    x.done |= good.any(axis=1)
    y.done |= good.any(axis=0)


def _side_by_side(x: Member, y: Member, need: int, width: int) -> None:
    """Mark windows of x and y that share enough shingles in the same places, counted from the signature's shingle."""
    shift = x.off - y.off
    i, j = max(0, shift), max(0, -shift)
    both = min(len(x.codes) - i, len(y.codes) - j)
    if both >= width:
        run = np.concatenate(([0], np.cumsum(x.codes[i : i + both] == y.codes[j : j + both])))
        good = run[width:] - run[:-width] >= need
        x.done[i : i + len(good)] |= good
        y.done[j : j + len(good)] |= good


class Windows:
    """The windows of a group's members as sets of tokens, and which of them have a partner so far.

    A token is a shingle and how often it stood in the window before, so two windows share as many shingles, counted as
    often as both hold them, as they share tokens.
    """

    def __init__(self, members: list[Member], width: int):
        size = np.array([len(m.codes) for m in members])
        n = size - width + 1
        self.n, self.first = n, np.cumsum(n) - n
        self.owner = np.repeat(np.arange(len(members)), n)
        start = np.arange(int(n.sum())) + (width - 1) * self.owner  # a member has width - 1 places more than windows
        _, ids = np.unique(np.concatenate([m.codes for m in members]), return_inverse=True)
        rows = np.sort(np.lib.stride_tricks.sliding_window_view(ids.astype(np.int32), width)[start], axis=1)
        place = np.arange(width, dtype=np.int32)
        again = np.zeros(rows.shape, dtype=bool)
        again[:, 1:] = rows[:, 1:] == rows[:, :-1]
        rows *= width
        if again.any():
            rows += place - np.maximum.accumulate(np.where(again, 0, place), axis=1)
        values, ids = np.unique(rows, return_inverse=True)
        self.tokens = ids.reshape(rows.shape).astype(np.int32)
        self.holds = np.zeros((len(values), len(members)), dtype=bool)
        self.holds[self.tokens.ravel(), np.repeat(self.owner, width)] = True
        self.shared = self.holds.sum(axis=1) > 1
        self.done = np.concatenate([m.done for m in members])
        # a class in one text only isn't compared with another one of that text, nor any with itself
        names: dict[bytes, int] = {}
        self.text = np.array([names.setdefault(m.texts[0], len(names)) if m.texts[0] == m.texts[1] else -1 - k for k, m in enumerate(members)])

    def _bits(self, rows: np.ndarray, column: np.ndarray, n: int) -> np.ndarray:
        """For each of these windows the columns of its tokens; the column beyond the last stands for all others."""
        out = np.zeros((len(rows), n + 1), dtype=np.float32)
        out[np.repeat(np.arange(len(rows)), self.tokens.shape[1]), column[self.tokens[rows]].ravel()] = 1
        return out[:, :n]

    def ask(self, rows: np.ndarray, may: np.ndarray, need: int) -> None:
        """Mark all that is alike between these windows and those of members that they may be compared with (members x members)."""
        asked = np.unique(self.tokens[rows])
        asked = asked[self.shared[asked]]
        column = np.full(len(self.shared), len(asked), dtype=np.int32)
        column[asked] = np.arange(len(asked))
        bits = self._bits(rows, column, len(asked))
        owner = self.owner[rows]
        # windows of members that hold enough of a window's tokens, in whichever of their windows
        can = (bits @ self.holds[asked].astype(np.float32) >= need) & may[owner]
        others = np.flatnonzero(can.any(axis=0)[self.owner])
        for k in range(0, len(others), ROWS):
            some = others[k : k + ROWS]
            good = (self._bits(some, column, len(asked)) @ bits.T >= need) & may[self.owner[some]][:, owner]
            self.done[some] |= good.any(axis=1)
            self.done[rows] |= good.any(axis=0)


def compare_group(left: list[Member], right: list[Member] | None, pivot: Member | None, need: int, width: int) -> None:
    """Compare left with right, or within left where right is None; pivot: a member that the others are compared with first."""
    both = left if right is None else left + right
    if len(both) <= FEW:
        for i, x in enumerate(left):
            for y in left[i + 1 :] if right is None else right:
                compare(x, y, need, width)
        return
    members = both if pivot is None or any(m is pivot for m in both) else [*both, pivot]
    windows = Windows(members, width)
    may = windows.text[:, None] != windows.text[None, :]
    if pivot is not None:
        k = next(k for k, m in enumerate(members) if m is pivot)
        windows.ask(np.arange(windows.first[k], windows.first[k] + windows.n[k]), may, need)
    if right is not None:
        side = np.arange(len(members)) < len(left)
        may &= side[:, None] != side[None, :]
    may[len(both) :] = may[:, len(both) :] = False  # the pivot of another block has been compared
    rows = np.flatnonzero(windows.shared[windows.tokens].sum(axis=1) >= need)  # others have no partner
    while len(rows := rows[~windows.done[rows]]):
        windows.ask(rows[:ROWS], may, need)
        rows = rows[ROWS:]
    for m, at, n in zip(members, windows.first.tolist(), windows.n.tolist(), strict=True):
        m.done[:] = windows.done[at : at + n]


_ROWS_OUT = 4096
_FOUND = pa.schema([("sig", pa.int64()), ("ctx", pa.int64()), ("row", pa.binary()), ("kind", pa.int8()), ("at", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])


def runs(done: np.ndarray) -> list[tuple[int, int]]:
    """The first and last place of each run of true ones."""
    flags = done.tobytes()
    if b"\0" not in flags:
        return [(0, len(done) - 1)]
    if b"\1" not in flags:
        return []
    edge = np.diff(np.concatenate(([0], done.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(edge > 0).tolist(), (np.flatnonzero(edge < 0) - 1).tolist(), strict=True))


def _stretches(batches, keys: tuple[str, ...], most: int | None = None):
    """(key, columns) of the rows of each key, which stand together; a key's rows in stretches of most."""
    last, held = None, {}
    for batch in batches:
        columns = {f.name: batch.column(f.name).to_pylist() for f in batch.schema}
        new = np.zeros(len(batch), dtype=bool)
        new[:1] = True  # a batch's first row may go on with the last key
        for c in keys:
            values = batch.column(c).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(new).tolist()
        for start, stop in zip(starts, [*starts[1:], len(batch)], strict=True):
            key = tuple(columns[c][start] for c in keys)
            while start < stop:
                if key != last or most is not None and len(held[keys[0]]) >= most:
                    if last is not None:
                        yield last, held
                    last, held = key, {name: [] for name in columns}
                until = stop if most is None else min(stop, start + most - len(held[keys[0]]))
                for name, values in held.items():
                    values += columns[name][start:until]
                start = until
    if last is not None:
        yield last, held


def _found(out: list[list]) -> pa.RecordBatch:
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _FOUND, strict=True)], schema=_FOUND)
    for c in out:
        c.clear()
    return batch


def _compared(width: int, percent: int):
    """Rows sorted by sig and block: the runs of windows with a partner in the block or in the group's commonest class."""
    need = least_shared(width, percent)

    def run(batches):
        out: list[list] = [[] for _ in _FOUND]
        for (sig, _), columns in _stretches(batches, ("sig", "block")):
            members, pivot = {}, None
            for ctx, a, off, row, row2, kind, codes in zip(*(columns[c] for c in ("ctx", "a", "off", "row", "row2", "kind", "codes")), strict=True):
                m = members[ctx] = Member(np.frombuffer(codes, dtype=np.uint32), off, (row, row2), kind, ctx, width)
                m.at = a
                if kind & PIVOT:
                    pivot = m
            compare_group(list(members.values()), None, pivot, need, width)
            for m in members.values():
                if not m.kind & REPEATED:  # else known
                    for s, e in runs(m.done):
                        for col, v in zip(out, (sig, m.ctx, m.texts[0], m.kind & (SEVERAL | LARGE), m.at, s, e), strict=True):
                            col.append(v)
            if len(out[0]) >= _ROWS_OUT:
                yield _found(out)
        yield _found(out)

    return run


def _answered(width: int, percent: int):
    """Rows sorted by sig, part, block and first those that ask: the further runs of their windows with a partner.

    Each class that asks is given out once for a part, whatever it is like; those that answer pass by, BLOCK at a time.
    """
    need = least_shared(width, percent)

    def run(batches):
        out: list[list] = [[] for _ in _FOUND]
        asking: dict[int, tuple[Member, np.ndarray]] = {}
        last = None

        def finish():
            for m, before in asking.values():
                for s, e in runs(m.done & ~before):
                    for col, v in zip(out, (last[0], m.ctx, m.texts[0], m.kind & (SEVERAL | LARGE), m.at, s, e), strict=True):
                        col.append(v)
            asking.clear()

        for key, columns in _stretches(batches, ("sig", "part", "block"), BLOCK):
            if key != last:
                finish()
                last = key
                if len(out[0]) >= _ROWS_OUT:
                    yield _found(out)
            others = []
            for asks, ctx, a, off, row, row2, kind, codes, spans in zip(*(columns[c] for c in ("asks", "ctx", "a", "off", "row", "row2", "kind", "codes", "spans")), strict=True):
                # what answers is not asked for its own windows
                m = Member(np.frombuffer(codes, dtype=np.uint32), off, (row, row2), kind if asks else kind | REPEATED, ctx, width)
                if asks:
                    m.at, m.done = a, _settled(len(m.done), kind, spans)
                    asking[ctx] = m, m.done.copy()
                else:
                    others.append(m)
            left = [m for m, _ in asking.values() if not m.done.all()]
            if left and others:
                compare_group(left, others, None, need, width)
        finish()
        yield _found(out)

    return run


def _far(large: DataFrame, near: DataFrame, heavy, width: int, percent: int, found: str) -> DataFrame | None:
    """Further runs in groups of several blocks: windows that are still open against those of the whole group."""
    need = least_shared(width, percent)
    spans = near.where(F.col("kind") >= LARGE).groupBy("sig", "ctx").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    once = (F.col("kind").bitwiseAND(PIVOT) == 0) | (F.col("block") == 0)  # the commonest class stands in each block
    rest = keep(large.where(once).join(spans, ["sig", "ctx"], "left"), "rest")
    bits = min(SLICE_BITS, max(BLOCK_BITS, rest.count().bit_length() + PART_BITS))
    tokens = keep(rest.mapInArrow(_tokens(width, need, heavy), _TOKENS_DDL), "tokens")
    held = keep(tokens.mapInArrow(_held(bits), "block long, ones binary, more binary").groupBy("block").applyInArrow(_merge_blocks(0), "block long, bits binary"), "asked")
    sketches, step = np.zeros(1 << (bits - 2), dtype=np.uint8), 1 << (BLOCK_BITS - 3)
    for r in held.toLocalIterator():
        sketches[r["block"] * step : (r["block"] + 1) * step] = np.frombuffer(zlib.decompress(r["bits"]), dtype=np.uint8)
    drop(held)
    second, open_ones = sketches.reshape(2, -1)
    if not (second & open_ones).any():
        drop(rest)
        drop(tokens)
        return None
    asked = rest.sparkSession.sparkContext.broadcast(second & open_ones)
    parts = keep(tokens.mapInArrow(_parts(bits, asked), _PARTS_DDL), "parts")
    asked.unpersist()
    groups = parts.groupBy("sig", "part").agg(F.count(F.lit(1)).alias("m"), F.count_if("asks").alias("n"), F.min("row").alias("row"), F.max("row2").alias("row2")).where((F.col("n") > 0) & (F.col("row") != F.col("row2")))
    dealt = parts.select("sig", "part", "ctx", "asks").join(groups.select("sig", "part", F.ceil(F.col("n") / OPEN).cast("int").alias("nb")), ["sig", "part"])
    # what asks does so in one block, and answers in all
    dealt = dealt.select("sig", "part", "ctx", F.explode(F.concat(F.when(F.col("asks"), F.array(F.struct(F.pmod("ctx", "nb").cast("int").alias("block"), F.lit(True).alias("asks")))).otherwise(F.array()), F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda k: F.struct(k.alias("block"), F.lit(False).alias("asks"))))).alias("x")).select("sig", "part", "ctx", "x.*")
    members = dealt.join(rest.drop("block"), ["sig", "ctx"])
    far = keep(members.repartition("sig", "part", "block").sortWithinPartitions("sig", "part", "block", F.desc("asks")).mapInArrow(_answered(width, percent), found), "far")
    for kept in (rest, tokens, parts):
        drop(kept)
    return far


def repeated_passages(docs: DataFrame, words: int = 50, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_spans, n_repeat_words and spans (start:end in words, end exclusive, comma-joined) of texts with repeats."""
    width = words - size + 1
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # of equal texts only the one of least doc_id need be counted and cut into pieces
    digests = texts.where("doc_id is not null").select("doc_id", F.unhex(F.md5("text")).alias("digest"))
    least = digests.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    marks = keep(digests.join(least, "digest").where("doc_id > least").select(F.xxhash64("doc_id", "digest").alias("mark")).distinct(), "copies")
    copies = Copies(marks)
    texts = texts.withColumn("mark", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.unhex(F.md5("text")))))
    sketch = Sketch(texts, size, sketch_bits(text_bytes), finer_bits(text_bytes), copies.first)
    found_runs = keep(texts.mapInArrow(_emit(size, width, percent, sketch, copies), _RUNS_DDL), "runs")
    for held in (sketch, copies):
        held.drop()
    flat = found_runs.where("size(sig) > 0").select("row", F.inline(F.arrays_zip("sig", "ctx", "a", "b", "off")))
    classes = flat.groupBy("sig", "ctx").agg(F.min(F.struct("row", "a", "b", "off")).alias("x"), F.max("row").alias("row2"), F.max("a").alias("a2"), F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("row2") != F.col("x.row"), REPEATED).when(F.col("a2") > F.col("x.a"), SEVERAL).otherwise(SINGLE)
    classes = keep(classes.select("sig", "ctx", "x.*", "row2", "n", kind.alias("kind")), "classes")
    store = found_runs.where("codes is not null").select("row", "at", "codes").dropDuplicates(["row"])

    def asked(of: DataFrame, *fields: str) -> DataFrame:
        """Texts and those of their own classes that are asked for."""
        return store.join(of.groupBy("row").agg(F.collect_list(F.struct(*fields)).alias("asked")), "row")

    # groups of several classes and texts, of which one class at least is open
    groups = classes.groupBy("sig").agg(F.count(F.lit(1)).alias("m"), F.max(F.struct("n", "ctx")).alias("pivot"), F.min("kind").alias("least"), F.min("row").alias("row"), F.max("row2").alias("row2")).where((F.col("m") > 1) & (F.col("least") < REPEATED) & (F.col("row") != F.col("row2")))
    whole = classes.join(groups.select("sig", "m", F.col("pivot.ctx").alias("pivot")), "sig").withColumn("nb", F.when(F.col("m") > SPLIT, F.ceil(F.col("m") / min(SPLIT, BLOCK))).otherwise(1).cast("int"))
    whole = whole.withColumn("kind", (F.col("kind") + F.when(F.col("ctx") == F.col("pivot"), PIVOT).otherwise(0) + F.when(F.col("nb") > 1, LARGE).otherwise(0)).cast("byte"))
    members = lambda of: asked(of, "sig", "nb", "ctx", "a", "b", "off", "row2", "kind").mapInArrow(_members(width), _MEMBERS_DDL)
    found = "sig long, ctx long, row binary, kind byte, at int, s int, e int"
    # the classes of larger groups are written, as they are read again
    large = keep(members(whole.where("nb > 1")), "large")
    near = members(whole.where("nb = 1")).unionByName(large)
    near = keep(near.repartition("sig", "block").sortWithinPartitions("sig", "block").mapInArrow(_compared(width, percent), found), "near")
    far = _far(large, near, sketch.heavy, width, percent, found)
    alike = near if far is None else near.unionByName(far)
    # a class in one place is that place; others are looked up
    several = F.col("kind").bitwiseAND(SEVERAL) > 0
    spans = alike.where(~several).select("row", (F.col("at") + F.col("s")).alias("s"), (F.col("at") + F.col("e") + words).alias("e"))
    repeated = classes.where(F.col("kind") == REPEATED).select("sig", "ctx", F.lit(0).alias("s"), (F.col("b") - F.col("a")).alias("e"))
    repeated = repeated.unionByName(alike.where(several).select("sig", "ctx", "s", "e"))
    spans = spans.unionByName(flat.select("row", "sig", "ctx", "a").join(repeated, ["sig", "ctx"]).select("row", (F.col("a") + F.col("s")).alias("s"), (F.col("a") + F.col("e") + words).alias("e")))
    own = found_runs.where("size(own) > 0").select("row", F.posexplode("own").alias("k", "x")).groupBy("row", F.floor(F.col("k") / 2).alias("k"))
    spans = spans.unionByName(own.agg(F.min("x").alias("s"), F.max("x").alias("e")).select("row", "s", "e"))
    ids = found_runs.select("doc_id", "row", "n_words").distinct()
    copied = ids.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.first("n_words").alias("n_words")).where("n > 1")
    spans = spans.unionByName(copied.select("row", F.lit(0).alias("s"), F.col("n_words").alias("e")))
    ends = keep(spans.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("ends")), "ends")  # no more than a text has pieces
    for kept in (classes, large, near, far, marks):
        drop(kept)

    def unite(batches):
        for batch in batches:
            out = []
            for ends in batch.column("ends").to_pylist():
                merged: list[list[int]] = []
                for x in ends:
                    if merged and x["s"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["e"])
                    else:
                        merged.append([x["s"], x["e"]])
                out.append(merged)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(m) for m in out], pa.int64()), pa.array([sum(b - a for a, b in m) for m in out], pa.int64()), pa.array([",".join(f"{a}:{b}" for a, b in m) for m in out], pa.string())], names=["doc_id", "n_spans", "n_repeat_words", "spans"])

    return ids.join(ends, "row").select("doc_id", "ends").mapInArrow(unite, "doc_id long, n_spans long, n_repeat_words long, spans string")
