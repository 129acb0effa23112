"""Ranked lexical search: Block-Max WAND over an inverted index in segments.

index() cuts the documents into segments of a bounded size.  A segment holds its documents' ids and lengths and, for each
term, its postings in blocks of 128: document numbers as offsets from the block's first one and counts, each in the
least number of bytes that the block needs, and beside them, uncompressed, the block's first and last document and the
largest impact of any of its postings.  Segments are rows of a table in the cluster's shared folder.

search() sends a bounded batch of queries to all segments.  For a query, the pointers of all its lists move over the
block heads alone (shallow moves, one numpy step for all of a segment), which bounds the score of every document by the
sum of the largest impacts of the blocks that it lies in; documents below the threshold, that of the k-th best so far,
are skipped with the blocks that hold no other.  Lists are then opened in descending order of their largest
contribution.  Once what is left of them can't reach the threshold alone, no new document can (the pivot of WAND): only
documents seen already stay, while they may still reach it, and only blocks in which one of them lies are decompressed.
A task keeps its best k of each query over all its segments; these are merged.

Scores are whole numbers: a term's weight times its impact, (10**9 * tf) div (1000 * tf + 8 * m), where m grows with
the document's length against the mean.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _words as W
from ._shared import keep

BLOCK = 128
"""Postings of a block."""
SEGMENT_BYTES = 8 << 20
"""Text of a segment; a longer text is a segment of its own."""
PIECE_BYTES = 4 << 20
"""Text that is split into terms at a time."""
QUERY_BYTES = 16 << 20
"""Text of the queries that are sent to all segments at once, about; more are searched for in several passes over the index."""
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_SPLIT = np.full(256, 0x20, dtype=np.uint8)
_SPLIT[W.LETTERS_DIGITS] = np.flatnonzero(W.LETTERS_DIGITS)
_SPLIT[0x41:0x5B] = np.arange(0x61, 0x7B)
_SPLIT = _SPLIT.tobytes()

SEGMENT = "doc_ids array<long>, lengths binary, terms binary, df binary, heads binary, places binary, counts binary"
_HEAD = np.dtype([("first", "<u4"), ("last", "<u4"), ("best", "<u4"), ("place_bytes", "u1"), ("count_bytes", "u1")])


def terms_of(raw: bytes):
    """Lists of the terms of a text in UTF-8, some MB of it at a time: runs of ASCII letters, digits and other characters, A-Z in lower case."""
    raw = raw.translate(_SPLIT)
    at = 0
    while at < len(raw):
        end = len(raw)
        if end - at > PIECE_BYTES:
            end = raw.rfind(b" ", at, at + PIECE_BYTES) + 1
            end = end or raw.find(b" ", at + PIECE_BYTES) + 1 or len(raw)
        yield raw[at:end].split()
        at = end


def length_term(n, documents: int, tokens: int):
    """m of a document (or an array of them) of n terms."""
    return 10 + (90 * n * documents) // max(tokens, 1)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class _Vocabulary(dict):
    def __missing__(self, term):
        self[term] = k = len(self)
        return k


def _bytes_needed(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4)).astype(np.uint8)


def _squeezed(values: np.ndarray, size: np.ndarray) -> bytes:
    """The low bytes of each value, as many as size says."""
    raw = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return raw[np.arange(4) < size[:, None]].tobytes()


class _Builder:
    def __init__(self, documents: int, tokens: int):
        self.documents, self.tokens = documents, tokens
        self.clear()

    def clear(self) -> None:
        self.vocabulary, self.ids, self.lengths, self.codes, self.tfs, self.size = _Vocabulary(), [], [], [], [], 0

    def add(self, doc_id, raw: bytes) -> None:
        found = []
        n = 0
        for words in terms_of(raw):
            n += len(words)
            found.append(np.unique(np.fromiter(map(self.vocabulary.__getitem__, words), dtype=np.int64, count=len(words)), return_counts=True))
        if len(found) > 1:
            codes, back = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
            tfs = np.zeros(len(codes), dtype=np.int64)
            np.add.at(tfs, back, np.concatenate([t for _, t in found]))
            found = [(codes, tfs)]
        if not n:
            return
        self.ids.append(doc_id)
        self.lengths.append(n)
        self.codes.append(found[0][0])
        self.tfs.append(found[0][1])
        self.size += len(raw)

    def segment(self) -> pa.RecordBatch:
        docs = np.repeat(np.arange(len(self.codes)), [len(c) for c in self.codes])
        codes, tfs, lengths = np.concatenate(self.codes), np.concatenate(self.tfs), np.array(self.lengths, dtype=np.int64)
        order = np.argsort(codes, kind="stable")
        codes, tfs, docs = codes[order], tfs[order], docs[order]
        df = np.bincount(codes, minlength=len(self.vocabulary))
        within = np.arange(len(codes)) - np.repeat(np.cumsum(df) - df, df)
        opens = np.flatnonzero(within % BLOCK == 0)
        size = np.diff(np.append(opens, len(codes)))
        head = np.zeros(len(opens), dtype=_HEAD)
        head["first"], head["last"] = docs[opens], docs[opens + size - 1]
        head["best"] = np.maximum.reduceat(impact(tfs, length_term(lengths, self.documents, self.tokens)[docs]), opens)
        head["place_bytes"] = _bytes_needed(head["last"] - head["first"])
        head["count_bytes"] = _bytes_needed(np.maximum.reduceat(tfs, opens))
        places = _squeezed(docs - np.repeat(head["first"].astype(np.int64), size), np.repeat(head["place_bytes"], size))
        counts = _squeezed(tfs, np.repeat(head["count_bytes"], size))
        row = [pa.array([self.ids], pa.list_(pa.int64()))] + [pa.array([x], pa.binary()) for x in (lengths.astype("<u8").tobytes(), b" ".join(self.vocabulary), df.astype("<u4").tobytes(), head.tobytes(), places, counts)]
        self.clear()
        return pa.RecordBatch.from_arrays(row, names=["doc_ids", "lengths", "terms", "df", "heads", "places", "counts"])


def _build(documents: int, tokens: int):
    def run(batches):
        builder = _Builder(documents, tokens)
        for batch in batches:
            data, at = W.utf8(batch.column("text"))
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                size = int(at[k + 1] - at[k])
                if builder.ids and builder.size + size > SEGMENT_BYTES:
                    yield builder.segment()
                builder.add(doc_id, data[at[k] : at[k + 1]].tobytes())
        if builder.ids:
            yield builder.segment()

    return run


class Segment:
    """A segment's heads, and its blocks as they are opened."""

    def __init__(self, row: dict, documents: int, tokens: int):
        self.ids = row["doc_ids"]
        self.terms = {t: k for k, t in enumerate(row["terms"].split(b" "))}
        self.df = np.frombuffer(row["df"], dtype="<u4").astype(np.int64)
        self.head = np.frombuffer(row["heads"], dtype=_HEAD)
        self.first, self.last, self.best = (self.head[c].astype(np.int64) for c in ("first", "last", "best"))
        blocks = -(-self.df // BLOCK)
        self.start = np.concatenate(([0], np.cumsum(blocks)))
        self.size = np.full(len(self.head), BLOCK, dtype=np.int64)
        self.size[self.start[1:] - 1] = self.df - BLOCK * (blocks - 1)
        self.place_at = np.concatenate(([0], np.cumsum(self.size * self.head["place_bytes"])))
        self.count_at = np.concatenate(([0], np.cumsum(self.size * self.head["count_bytes"])))
        self.places, self.counts = row["places"], row["counts"]
        self.m = length_term(np.frombuffer(row["lengths"], dtype="<u8").astype(np.int64), documents, tokens)
        self.top = np.maximum.reduceat(self.best, self.start[:-1])
        self.opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def open(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents of a block and the impacts there."""
        found = self.opened.get(block)
        if found is None:
            n = int(self.size[block])
            docs = self.first[block] + np.frombuffer(self.places, dtype=f"<u{self.head['place_bytes'][block]}", count=n, offset=int(self.place_at[block])).astype(np.int64)
            tf = np.frombuffer(self.counts, dtype=f"<u{self.head['count_bytes'][block]}", count=n, offset=int(self.count_at[block])).astype(np.int64)
            found = self.opened[block] = (docs, impact(tf, self.m[docs]))
        return found

    def search(self, terms: np.ndarray, weights: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents whose score is threshold (over 0) or more, and their scores; threshold must not be over that of the k-th best."""
        nothing = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        most = weights * self.top[terms]
        order = np.argsort(-most, kind="stable")
        terms, weights, most = terms[order], weights[order], most[order]
        rest = np.append(np.cumsum(most[::-1])[::-1], 0)
        if rest[0] < threshold:
            return nothing
        n = len(self.ids)
        # shallow moves: heads only
        count = self.start[terms + 1] - self.start[terms]
        blocks = np.arange(count.sum()) + np.repeat(self.start[terms] - (np.cumsum(count) - count), count)
        gain = np.repeat(weights, count) * self.best[blocks]
        bound = np.zeros(n + 1, dtype=np.int64)
        np.add.at(bound, self.first[blocks], gain)
        np.add.at(bound, self.last[blocks] + 1, -gain)
        alive = np.cumsum(bound)[:n] >= threshold
        scores = np.zeros(n, dtype=np.int64)
        for k, (t, w) in enumerate(zip(terms.tolist(), weights.tolist(), strict=True)):
            if rest[k] < threshold:  # documents not seen yet can't reach it
                alive &= scores + rest[k] >= threshold
            before = np.concatenate(([0], np.cumsum(alive)))
            if not before[-1]:
                return nothing
            own = np.arange(self.start[t], self.start[t + 1])
            own = own[before[self.last[own] + 1] > before[self.first[own]]]
            for b in own.tolist():
                docs, parts = self.open(b)
                scores[docs] += w * parts
        found = np.flatnonzero(alive & (scores >= threshold))
        return found, scores[found]


def _best(ids: list, scores: np.ndarray, k: int) -> tuple[list, np.ndarray]:
    """The k highest; of equal scores the least ids, nulls last."""
    order = sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j] is None, ids[j] or 0))[:k]
    return [ids[j] for j in order], scores[order]


def _rows_of(batches):
    for batch in batches:
        yield from batch.to_pylist()


class Index:
    """Segments of an inverted index, with N (documents that hold a term) and L (their terms)."""

    def __init__(self, segments: DataFrame, documents: int, tokens: int):
        self.segments, self.documents, self.tokens = segments, documents, tokens

    def _frequencies(self, vocabulary: list[bytes]) -> dict[bytes, int]:
        """The number of documents that hold each term: a sum over segments."""
        asked = self.segments.sparkSession.sparkContext.broadcast(vocabulary)

        def run(batches):
            total = np.zeros(len(asked.value), dtype=np.int64)
            for row in _rows_of(batches):
                place = {t: k for k, t in enumerate(row["terms"].split(b" "))}
                df = np.frombuffer(row["df"], dtype="<u4").astype(np.int64)
                at = np.fromiter((place.get(t, -1) for t in asked.value), dtype=np.int64, count=len(asked.value))
                total[at >= 0] += df[at[at >= 0]]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

        found = self.segments.select("terms", "df").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
        return {vocabulary[r["term"]]: r["df"] for r in found.collect()}

    def _batch(self, queries: list[list[bytes]], k: int) -> DataFrame:
        """(query, doc_id, score): each task's best k of each query, by its number."""
        vocabulary = sorted(set().union(*queries))
        frequency = self._frequencies(vocabulary)
        weight = {t: math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1))) for t, df in frequency.items()}
        place = {t: j for j, t in enumerate(t for t in vocabulary if t in weight)}
        asked = [np.array([place[t] for t in q if t in place], dtype=np.int64) for q in queries]
        sent = self.segments.sparkSession.sparkContext.broadcast((list(place), np.array([weight[t] for t in place], dtype=np.int64), asked))
        documents, tokens = self.documents, self.tokens

        def run(batches):
            vocabulary, weights, asked = sent.value
            best = {}
            for row in _rows_of(batches):
                segment = Segment(row, documents, tokens)
                at = np.fromiter((segment.terms.get(t, -1) for t in vocabulary), dtype=np.int64, count=len(vocabulary))
                for q, terms in enumerate(asked):
                    here = terms[at[terms] >= 0] if len(terms) else terms
                    if not len(here):
                        continue
                    ids, scores = best.get(q, ([], np.zeros(0, dtype=np.int64)))
                    docs, new = segment.search(at[here], weights[here], max(1, int(scores[-1])) if len(ids) == k else 1)
                    if len(docs):
                        best[q] = _best(ids + [segment.ids[d] for d in docs.tolist()], np.concatenate([scores, new]), k)
            rows = [(q, i, s) for q, (ids, scores) in best.items() for i, s in zip(ids, scores.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], names=["query", "doc_id", "score"])

        return self.segments.mapInArrow(run, "query long, doc_id long, score long")

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """item_id, rank, doc_id and score of each query's k best documents of a score above 0.

        queries has item_id and text; rows of one item_id are one query with the terms of all of them, a null item_id
        being one too.  A null text has no terms, and a query without terms no result.  Equal scores are ranked by
        ascending doc_id, nulls last.
        """
        spark = self.segments.sparkSession
        texts = queries.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
        size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        parts = -(-size // QUERY_BYTES)
        kind = queries.schema["item_id"].dataType.simpleString()
        out = None
        for part in range(parts):
            rows = texts.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).groupBy("item_id").agg(F.collect_set("text").alias("texts")).collect()
            asked = [(r["item_id"], sorted({t for text in r["texts"] for words in terms_of(text.encode()) for t in words})) for r in rows]
            asked = [a for a in asked if a[1]]
            if not asked:
                continue
            names = spark.createDataFrame([(j, a[0]) for j, a in enumerate(asked)], f"query long, item_id {kind}")
            found = self._batch([a[1] for a in asked], k)
            order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            ranked = ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
            out = ranked if out is None else out.unionByName(ranked)
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if out is None else out


def index(docs: DataFrame) -> Index:
    """An inverted index of the whole texts of docs (doc_id, text; other columns are left out, so no name can clash).

    A null or empty text has no terms and is in no result, nor counted in N.  Each row is a document of its own, repeated
    ones and those of null doc_id too.  A text of any length is indexed whole.  An empty table gives an index that finds nothing.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    n = F.regexp_count("text", F.lit(TERM))
    size = texts.select(n.alias("n")).agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    segments = keep(texts.mapInArrow(_build(size["documents"], size["tokens"]), SEGMENT), "segments")
    return Index(segments, size["documents"], size["tokens"])
