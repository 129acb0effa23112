"""Packing token sequences by cutting-stock column generation.

Documents are tokenized and end with one id.  Whole sequences are cut off a long document; its rest is an item.  Items
are counted by length, in classes of size / 128 tokens, rounded up: a histogram of 128 counts at most, whatever the
corpus, which is all that the driver sees of them.  A linear program asks how often to use each pattern (how many items
of each class a sequence takes) so that the fewest sequences hold all items.  Its columns are generated: the duals of
the patterns in use price the classes, a knapsack dynamic program finds the pattern that is worth most at these prices,
and it enters while it is worth more than a sequence.  The solution is rounded down, and the few items left over are
put into patterns of the largest first.

Items of a class are ranked, over salted parts of it so that no class is one group; a rank gives pattern, sequence and
slot by arithmetic.  What patterns leave free, for classes are rounded up, is then filled by cutting: the last, least
filled sequences are dissolved, just so many that their tokens fill the gaps of all others, and both lie on one line by
running sums, so that gap and filler meet where their stretches overlap.  What is over, less than a sequence, becomes
sequences of powers of two.  So there is no padding, and a document is cut only at a sequence's end, at a gap's end or
at a power of two of the tail.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _words as W
from ._shared import keep

CLASSES = 128
"""Length classes of the histogram; the basis of the linear program has as many rows at most."""
GROUP = 1 << 16
"""Sequences, and items of a class, that one group of a window holds, about."""
MEMO_BYTES = 160 << 20
"""What is remembered of ids of strings between white space, in about so many bytes."""
LONG = 256
"""Bytes of a string that is not remembered."""
SLICE_BYTES = 1 << 20
"""Text that is tokenized at a time."""

_PLAIN = re.compile("[\n\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*").fullmatch
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SHOWN = {b: 0x100 + k for k, b in enumerate(b for b in range(0x100) if b not in _VISIBLE)}
"""Bytes that byte-level vocabularies write as characters from U+0100 on, in order."""


# tokens


class Vocabulary:
    """A vocabulary file, and the encoder that a worker makes of it and keeps from task to task."""

    def __init__(self, raw: bytes):
        self.raw, self.encoder = raw, None


class Encoder:
    """Packed ids as the tokenizers library gives them, remembered for strings between ASCII white space.

    The vocabulary's pre-tokenizer must drop white space and match nothing across it, so that strings between white
    space are encoded apart; independent() tests this on the file.  A new string of plain characters (printable ASCII
    and Latin letters, whose classes and lower case no version of Unicode disputes) is lowered and split here, and only
    its words that are new go to the library's merges; other strings go to the library whole.
    """

    def __init__(self, raw: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.apart = independent(raw)
        spec = json.loads(raw)
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall if self.apart else None
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.model = self.tokenizer.model
        self.packed = [k.to_bytes(2 if self.kind == "<u2" else 4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.memo: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.held = 0

    def _packed(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(x.ids, dtype=self.kind).tobytes() for x in found]

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_SHOWN)
        found = self.pieces[piece] = b"".join([self.packed[t.id] for t in self.model.tokenize(shown)])
        self.held += 150 + len(piece) + len(found)
        return found

    def _new(self, words: list[bytes]) -> dict[bytes, bytes]:
        whole = b"\n".join(words).decode("utf-8", "replace")
        if not _PLAIN(whole) or any(t in whole for t in self.special):
            if len(words) > 1:  # find those that are not plain
                plain = [w for w in words if _PLAIN(t := w.decode("utf-8", "replace")) and not any(x in t for x in self.special)]
                out = self._new(plain) if plain else {}
                other = [w for w in words if w not in out]
                out.update(zip(other, self._packed(other), strict=True))
                return out
            return {words[0]: self._packed(words)[0]}
        out, known, learn, split = {}, self.pieces.get, self._piece, self.split
        for w, text in zip(words, whole.lower().split("\n"), strict=True):
            found = known(text)
            if found is None:
                found = learn(text) if text.isalpha() else b"".join([known(p) or learn(p) for p in split(text)])
            out[w] = found
        return out

    def _words(self, words: list[bytes]) -> bytes:
        memo = self.memo
        new = {w for w in words if w not in memo}
        if not new:
            return b"".join(map(memo.__getitem__, words))
        if self.held > MEMO_BYTES:
            memo.clear()
            self.pieces.clear()
            self.held = 0
            new = set(words)
        made = self._new(list(new))
        short = {w: x for w, x in made.items() if len(w) <= LONG}
        memo.update(short)
        self.held += sum(150 + len(w) + len(x) for w, x in short.items())
        if len(short) == len(made):
            return b"".join(map(memo.__getitem__, words))
        return b"".join([made[w] if w in made else memo[w] for w in words])

    def encode(self, text: bytes) -> bytes:
        if not self.apart:
            return self._packed([text])[0]
        if len(text) <= SLICE_BYTES:
            return self._words(text.split())
        out, at = [], 0
        while at < len(text):
            end = len(text)
            if end - at > SLICE_BYTES:
                end = text.rfind(b" ", at, at + SLICE_BYTES) + 1 or text.find(b" ", at + SLICE_BYTES) + 1 or len(text)
            out.append(self._words(text[at:end].split()))
            at = end
        return b"".join(out)


def independent(raw: bytes) -> bool:
    """Whether a vocabulary file is for byte-level merges after its text is composed, its white space made spaces and its letters lowered, with words taken by a pattern that matches no white space."""
    import regex

    spec = json.loads(raw)
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if [x.get("type") for x in steps] != ["NFC", "Replace", "Lowercase"] or steps[1]["pattern"] != {"Regex": r"\s+"} or [x.get("type") for x in splits] != ["Split", "ByteLevel"]:
        return False
    first, second = splits
    if first.get("behavior") != "Removed" or not first.get("invert") or second.get("add_prefix_space") or second.get("use_regex") or spec["model"].get("type") != "BPE":
        return False
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", [])):
        return False
    return not any(any(c.isspace() for c in m) for m in regex.findall(first["pattern"]["Regex"], " \t\n\x0b\x0c\ra's 1 b\n?! \r\n ...  'd\t"))


def _encode(sent, end_id: int):
    def run(batches):
        file = sent.value
        encoder = file.encoder = file.encoder or Encoder(file.raw)
        end = np.array([end_id], dtype=encoder.kind).tobytes()
        width = len(end)
        for batch in batches:
            data, at = W.utf8(batch.column("text"))
            for a, b in W.chunks(at, 8 << 20):
                packed = [encoder.encode(data[at[k] : at[k + 1]].tobytes()) + end for k in range(a, b)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([len(x) // width for x in packed], pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "n", "ids"])

    return run


# patterns


def priciest(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most that one sequence can hold at these prices, by dynamic programming over its capacity, and how many of each item."""
    worth, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        worth[c], taken[c] = worth[c - 1], -1
        fit = np.flatnonzero(sizes <= c)
        if len(fit):
            value = prices[fit] + worth[c - sizes[fit]]
            k = int(value.argmax())
            if value[k] > worth[c] + 1e-12:
                worth[c], taken[c] = value[k], fit[k]
    pattern, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            pattern[taken[c]] += 1
            c -= sizes[taken[c]]
    return float(worth[capacity]), pattern


def linear_program(sizes: np.ndarray, demand: np.ndarray, capacity: int, tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (as columns) and how often each is used, so that the fewest sequences hold demand exactly, in fractions.

    Column generation on a revised simplex: it starts from sequences of one class each.  It ends where no pattern is
    worth more than a sequence, or else, as each step keeps a solution, after 50 steps for each class.
    """
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    used = demand / np.diag(basis)
    for _ in range(50 * m):
        prices = np.linalg.solve(basis.T, np.ones(m))
        worth, pattern = priciest(np.maximum(prices, 0), sizes, capacity)
        if worth <= 1 + tolerance:
            break
        way = np.linalg.solve(basis, pattern.astype(float))
        able = way > 1e-9
        if not able.any():
            break
        ratio = np.where(able, used / np.where(able, way, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        used = np.maximum(used - step * way, 0)
        used[out] = step
        basis[:, out] = pattern
    return np.rint(basis).astype(np.int64), used


def patterns(demand: dict[int, int], capacity: int = CLASSES) -> list[tuple[dict[int, int], int]]:
    """(number of items of each size, times used) of whole patterns that hold demand (items of each size) exactly, the fullest first."""
    sizes = np.array(sorted(k for k, n in demand.items() if n), dtype=np.int64)
    if not len(sizes):
        return []
    left = np.array([demand[k] for k in sizes.tolist()], dtype=np.int64)
    columns, used = linear_program(sizes, left.astype(float), capacity)
    out: list[tuple[np.ndarray, int]] = []

    def take(pattern: np.ndarray, times: int) -> None:
        nonlocal left
        some = pattern > 0
        times = min(times, int((left[some] // pattern[some]).min())) if some.any() else 0
        if times > 0:
            left = left - times * pattern
            out.append((pattern, times))

    for j in range(columns.shape[1]):
        take(columns[:, j], int(used[j] + 1e-6))
    while left.any():  # what rounding left: the largest items first
        room, pattern = capacity, np.zeros(len(sizes), dtype=np.int64)
        for k in range(len(sizes) - 1, -1, -1):
            pattern[k] = min(left[k], room // sizes[k])
            room -= int(pattern[k] * sizes[k])
        take(pattern, 1 << 62)
    out.sort(key=lambda x: -int(x[0] @ sizes))
    return [({int(s): int(n) for s, n in zip(sizes, p, strict=True) if n}, t) for p, t in out]


class Slots:
    """The sequence and slot of each rank of a class."""

    def __init__(self, chosen: list[tuple[dict[int, int], int]]):
        self.sequences = sum(t for _, t in chosen)
        by_class: dict[int, list] = {}
        base = 0
        for pattern, times in chosen:
            for c, n in pattern.items():
                by_class.setdefault(c, []).append((n * times, n, base))
            base += times
        self.by_class = {c: (np.cumsum([0] + [x[0] for x in rows])[:-1], np.array([x[1] for x in rows]), np.array([x[2] for x in rows])) for c, rows in by_class.items()}

    def place(self, kind: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, slot = np.zeros(len(kind), dtype=np.int64), np.zeros(len(kind), dtype=np.int64)
        for c in np.unique(kind).tolist():
            own = np.flatnonzero(kind == c)
            start, each, base = self.by_class[c]
            at = np.searchsorted(start, rank[own], side="right") - 1
            within = rank[own] - start[at]
            sequence[own], slot[own] = base[at] + within // each[at], within % each[at]
        return sequence, slot


def _placed(slots: Slots):
    def run(batches):
        for batch in batches:
            kind, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("kind", "rank"))
            sequence, slot = slots.place(kind, rank)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n"), pa.array(sequence), pa.array(-kind), pa.array(slot)], names=["row", "n", "sequence", "kind", "slot"])

    return run


# pieces


def _running(rows: DataFrame, keys: list[str], value: str, order: str, name: str) -> DataFrame:
    """rows with the sum of value before each row, within keys, in order of part (bounded groups) and then order."""
    sums = rows.groupBy(*keys, "part").agg(F.sum(value).alias("_own"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("_base", F.coalesce(F.sum("_own").over(before), F.lit(0))).drop("_own")
    within = Window.partitionBy(*keys, "part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(base, [*keys, "part"]).withColumn(name, (F.col("_base") + F.coalesce(F.sum(value).over(within), F.lit(0))).cast("long")).drop("_base")


def _cells(rows: DataFrame, a: str, b: str, size: int) -> DataFrame:
    """rows once for each cell of the line that [a, b) touches: two at most, as no stretch is longer than a cell."""
    return rows.withColumn("cell", F.explode(F.sequence(F.floor(F.col(a) / size), F.floor((F.col(b) - 1) / size))))


def dissolve(groups: list[tuple[int, int, int]], size: int, ask) -> tuple[int, int, int]:
    """(M, gaps, fillers): the most sequences that stay so that the gaps of sequences below M hold no more than the tokens of the others.

    groups has (first, number, tokens) of runs of sequences, and ask(first, number) gives the tokens of each of a run's.
    """
    total = sum(t for _, _, t in groups)
    before, last = 0, None
    for first, number, tokens in sorted(groups):
        # all of the run stay if gaps are no more than what is left
        if size * (first + number) - (before + tokens) <= total - (before + tokens):
            before += tokens
            continue
        last = (first, number)
        break
    if last is None:
        return (sum(n for _, n, _ in groups), *[0] * 2)
    at = last[0]
    for tokens in ask(*last):
        if size * (at + 1) - (before + tokens) > total - (before + tokens):
            break
        before += tokens
        at += 1
    return at, size * at - before, total - before


def _pieces(kind: str, with_ids: bool):
    def run(batches):
        for batch in batches:
            out = []
            for doc_id, n, raw, parts in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "n", "ids", "parts")], strict=True):
                ids = np.frombuffer(raw, dtype=kind)
                for p in parts:
                    own = ids[p["start"] : p["start"] + p["length"]].astype("<u4")
                    out.append((doc_id, p["start"], p["length"], zlib.crc32(own.tobytes()), n, p["sequence"], p["offset"], own if with_ids else None))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            arrays = [pa.array([x[k] for x in out], pa.int64()) for k in range(7)]
            if with_ids:
                names, arrays = [*names, "ids"], [*arrays, pa.array([x[7].astype(np.int64) for x in out], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def pack(docs: DataFrame, raw: bytes, size: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if with_ids) of each piece.

    raw is the vocabulary file; size a power of two, 128 or more.  Each row of docs is a document of its own, repeated
    ones and those of null doc_id too.  A null or empty text has the end id alone.  Texts of any length are encoded
    whole.  Other columns of docs are left out, so no name can clash.  An empty table gives no pieces.  Documents of
    one length share sequences in order of their rows.  No sequence needs padding: each is full, or one of the last
    few, whose lengths are powers of two.
    """
    if size < CLASSES or size & (size - 1):
        raise ValueError(f"size must be a power of two, {CLASSES} or more")
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(Vocabulary(raw))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = texts.mapInArrow(_encode(sent, end_id), "doc_id long, n long, ids binary")
    tokens = keep(made.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n", "ids"), "tokens")

    grain = size // CLASSES
    rest, whole = F.col("n") % size, F.floor(F.col("n") / size).cast("long")
    lengths = tokens.select("row", "n")
    items = lengths.where(rest > 0).withColumn("kind", F.ceil(rest / grain).cast("int"))
    counted = {r["kind"]: r["count"] for r in items.groupBy("kind").count().collect()}
    slots = Slots(patterns(counted))
    parts = max(1, sum(counted.values()) // GROUP)
    dealt = items.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts))).withColumn("one", F.lit(1))
    ranked = _running(dealt, ["kind"], "one", "row", "rank")
    seated = ranked.select("row", "n", "kind", "rank").mapInArrow(_placed(slots), "row long, n long, sequence long, kind long, slot long")
    seat = Window.partitionBy("sequence").orderBy("kind", "slot").rowsBetween(Window.unboundedPreceding, -1)
    seated = keep(seated.withColumn("rest", rest).withColumn("offset", F.coalesce(F.sum("rest").over(seat), F.lit(0)).cast("long")).select("row", "n", "rest", "sequence", "offset"), "seats")

    part = F.floor(F.col("sequence") / GROUP).cast("long").alias("part")
    filled = keep(seated.groupBy("sequence").agg(F.sum("rest").alias("tokens")).select("sequence", "tokens", part), "filled")
    groups = [(r["part"] * GROUP, r["n"], r["tokens"]) for r in filled.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens")).collect()]
    ask = lambda first, _: [r["tokens"] for r in filled.where(F.col("part") == first // GROUP).orderBy("sequence").select("tokens").collect()]
    stay, gaps, fillers = dissolve(groups, size, ask)
    extra = fillers - gaps
    tail = [1 << k for k in range(extra.bit_length() - 1, -1, -1) if extra >> k & 1]

    line = _running(filled, [], "tokens", "sequence", "before")  # tokens of earlier sequences
    start = line.where(F.col("sequence") == stay).select("before").first()
    passed = start["before"] if start else 0
    gap = line.where((F.col("sequence") < stay) & (F.col("tokens") < size)).select("sequence", "tokens", (size * F.col("sequence") - F.col("before")).alias("a")).withColumn("b", F.col("a") + size - F.col("tokens"))
    ends, at = [], gaps
    for k, length in enumerate(tail):
        ends.append((stay + k, 0, at, at + length))
        at += length
    gap = gap.unionByName(spark.createDataFrame(ends, "sequence long, tokens long, a long, b long"))
    filler = seated.where(F.col("sequence") >= stay).join(line.select("sequence", "before"), "sequence").select("row", "n", "rest", (F.col("before") - passed + F.col("offset")).alias("c")).withColumn("d", F.col("c") + F.col("rest"))
    low, high = F.greatest("a", "c"), F.least("b", "d")
    met = _cells(gap, "a", "b", size).join(_cells(filler, "c", "d", size), "cell").where((low < high) & (F.col("cell") == F.floor(low / size)))
    cut = met.select("row", (F.col("n") - F.col("rest") + low - F.col("c")).alias("start"), (high - low).alias("length"), "sequence", (F.col("tokens") + low - F.col("a")).alias("offset"))
    kept = seated.where(F.col("sequence") < stay).select("row", (F.col("n") - F.col("rest")).alias("start"), F.col("rest").alias("length"), "sequence", "offset")

    long = lengths.where(F.col("n") >= size).withColumn("whole", whole).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    number = _running(long, [], "whole", "row", "first").select("row", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("k"))
    full = number.select("row", (F.col("k") * size).alias("start"), F.lit(size).cast("long").alias("length"), (F.col("first") + F.col("k") + stay + len(tail)).alias("sequence"), F.lit(0).cast("long").alias("offset"))

    pieces = full.unionByName(kept).unionByName(cut).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "length", "sequence", "offset"))).alias("parts"))
    together = tokens.join(pieces, "row").select("doc_id", "n", "ids", "parts")
    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    return together.mapInArrow(_pieces(Encoder(raw).kind, with_ids), columns)
