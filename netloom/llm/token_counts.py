"""Token counts for a SentencePiece BPE model, with a whole-token shortcut.

A text's spaces become the mark U+2581 and one stands before it; merges then join characters by score.  Two proofs are
made once, on the driver, from the vocabulary alone.  No piece holds the mark after another character, so no merge
crosses such a place, and a text may be cut before each run of marks; likewise between any two characters that stand
side by side in no piece.  And each piece is merged by itself: those that come out as one token are whole.  A cut that is a
whole piece counts 1 at once; only the rest is merged.

A null text is an empty one, with no tokens.  Control pieces' strings inside texts are ordinary text.
"""

from __future__ import annotations

import heapq
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_NONE = float("-inf")
MEMO_CUTS = 700_000
"""Cuts whose counts a worker remembers; beyond it new ones are merged each time."""
# Fixed values of the model file's format: the numbers of piece types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, raw[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, raw[at : at + n]
            at += n


class Pieces:
    """A model's vocabulary and what is proved of it."""

    def __init__(self, scores: dict[str, float], byte_fallback: bool = True):
        self.scores = scores
        self.byte_fallback = byte_fallback
        if any(MARK in p.lstrip(MARK) for p in scores):
            raise ValueError("a piece holds a space after another character: texts can't be cut at spaces")
        self.pairs = {pair for p in scores for pair in zip(p, p[1:], strict=False)}
        self.whole = {p for p in scores if self.merge(p) == 1}
        self._empty()

    def _empty(self) -> None:
        self.memo = _Memo(lambda cut: 1 if cut in self.whole else self.merge(cut))
        self.spaced = _Memo(lambda part: self.count(MARK + part))  # by the text after a cut's one mark

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("memo", "spaced")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._empty()

    def merge(self, text: str) -> int:
        """Tokens of a text whose spaces are marks, by merging from its characters."""
        parts = list(text) if len(text) > 200 else None
        parts = self._merge_long(parts) if parts else self._merge_short(text)
        if not self.byte_fallback:
            return len(parts)
        scores = self.scores
        return sum([1 if p in scores else len(p.encode()) for p in parts])

    def _merge_short(self, text: str) -> list[str]:
        get = self.scores.get
        parts = list(text)
        pairs = [get(a + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := max(pairs)) > _NONE:
            i = pairs.index(best)  # the leftmost
            p = parts[i] + parts[i + 1]
            parts[i : i + 2] = (p,)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(p + parts[i + 1], _NONE)
            if i:
                pairs[i - 1] = get(parts[i - 1] + p, _NONE)
        return parts

    def _merge_long(self, parts: list) -> list[str]:
        scores, n = self.scores, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-scores[p], i, p) for i in range(n - 1) if (p := parts[i] + parts[i + 1]) in scores]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] + parts[j] != p:
                continue
            parts[i], parts[j] = p, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (q := p + parts[k]) in scores:
                    heapq.heappush(heap, (-scores[q], i, q))
            if (h := before[i]) >= 0 and (q := parts[h] + p) in scores:
                heapq.heappush(heap, (-scores[q], h, q))
        return [p for p in parts if p is not None]

    def count(self, text: str) -> int:
        """Tokens of one cut: its spaces are marks.  It is cut again wherever no piece holds two neighbours."""
        if text in self.whole:
            return 1
        pairs, memo, out, start = self.pairs, self.memo, 0, 0
        for i, pair in enumerate(zip(text, text[1:], strict=False), 1):
            if pair not in pairs:
                out += memo[text[start:i]]
                start = i
        return out + memo[text[start:]]


class _Memo(dict):
    """Counts by text, made when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> int:
        n = self.make(key)
        if len(self) < MEMO_CUTS and len(key) <= 64:
            self[key] = n
        return n


def count_text(pieces: Pieces, text: str) -> int:
    """Tokens of a whole text."""
    if not text:
        return 0
    text = text.replace(MARK, " ") if MARK in text else text
    if "  " not in text and text[0] != " ":
        return sum(map(pieces.spaced.__getitem__, text.split(" ")))
    # runs of spaces: a cut is a run and the text up to the next one
    out, run = 0, 1
    for part in text.split(" "):
        if part:
            out += pieces.spaced[part] if run == 1 else pieces.count(MARK * run + part)
            run = 1
        else:
            run += 1
    return out + (pieces.count(MARK * (run - 1)) if run > 1 else 0)


def load(raw: bytes) -> Pieces:
    """The pieces of a SentencePiece BPE model file that leaves texts as they are but for the marks."""
    scores: dict[str, float] = {}
    byte_fallback, model_type, options = False, 1, {3: 1, 4: 1, 5: 1}
    charsmap = b""
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    piece = v.decode()
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            if kind == NORMAL:
                scores[piece] = score
            elif kind in (USER_DEFINED, UNUSED):
                raise ValueError(f"pieces of type {kind} aren't supported: {piece!r}")
        elif number == 2:
            for k, v in _fields(value):
                if k == 3:
                    model_type = v
                elif k == 35:
                    byte_fallback = bool(v)
        elif number == 3:
            for k, v in _fields(value):
                if k in options:
                    options[k] = v
                elif k == 2:
                    charsmap = v
    if model_type != 2:
        raise ValueError("not a BPE model")
    if charsmap or options != {3: 1, 4: 0, 5: 1}:
        raise ValueError(f"its normalizer changes texts: {options}, {len(charsmap)} bytes of rules")
    return Pieces(scores, byte_fallback)


def _run(pieces, limit: int):
    def run(batches):
        model = pieces.value
        for batch in batches:
            n_bytes, n_tokens = [], []
            for v in batch.column("text"):
                text = v.as_py() or ""
                n_bytes.append(len(text.encode()))
                n_tokens.append(count_text(model, text))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, raw: bytes, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more tokens than limit) of each row of docs; raw is the model file."""
    pieces = docs.sparkSession.sparkContext.broadcast(load(raw))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_run(pieces, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
