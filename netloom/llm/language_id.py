"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A text's letters in lower case, with every run of other characters as one space, give its 1- to 3-grams; its profile is
the most frequent of them, by falling count and, at equal counts, rising code.  The distance of a text to a language is
the sum, over its profile, of how far each n-gram's rank lies from its rank in the language's profile; an n-gram that
is missing there counts as the profile's length.  The nearest language wins; at equal distances the first by name.

Language profiles are fitted on a bounded sample: of each language about sample_docs different texts of non-null lang,
those whose hash lies below a bound set from the number of different texts; equal texts count once, so a group of copies
adds no more than one.  The number of languages is bounded by max_languages.

Null texts and texts without a letter are "und" with score 0.  Where no training text has a letter, all are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 400
"""N-grams in a profile."""
SAMPLE_DOCS = 2000
"""Different training texts of a language, about."""
MAX_LANGUAGES = 500

_LETTER = np.zeros(0x110000, dtype=bool)


def _letters() -> np.ndarray:
    if not _LETTER[65]:
        _LETTER[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return _LETTER


def ngrams(text: str) -> np.ndarray | None:
    """The codes of all 1- to 3-grams of a text but the lone space; None without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    is_letter = _letters()[codes]
    if not is_letter.any():
        return None
    codes = np.where(is_letter, codes, 0).astype(np.uint64)
    padded = np.zeros(len(codes) + 2, dtype=np.uint64)
    padded[1:-1] = codes
    kept = np.ones(len(padded), dtype=bool)
    kept[1:] = (padded[1:] > 0) | (padded[:-1] > 0)
    c = padded[kept]
    two = c[:-1] << np.uint64(21) | c[1:] | np.uint64(1 << 42)
    three = two[:-1] << np.uint64(21) | c[2:]
    return np.concatenate((c[c > 0], two, three))


def counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams = np.sort(grams)
    starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    return grams[starts], np.diff(np.append(starts, len(grams)))


def profile(values: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The size most frequent n-grams, the most frequent first."""
    if len(values) > 2 * size:  # only what reaches the last place's count is sorted
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        chosen = counts >= least
        values, counts = values[chosen], counts[chosen]
    return values[np.lexsort((values, -counts))[:size]]


class Model:
    """Language names and, for all n-grams of all profiles, their ranks by language."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.names = sorted(profiles)
        self.size = size
        self.grams = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *profiles.values()]))
        self.ranks = np.full((len(self.names), len(self.grams) + 1), -1, dtype=np.int64)
        for k, name in enumerate(self.names):
            own = profiles[name]
            self.ranks[k, np.searchsorted(self.grams, own)] = np.arange(len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = ngrams(text) if text and self.names else None
        if grams is None:
            return "und", 0.0
        own = profile(*counted(grams), self.size)
        at = np.searchsorted(self.grams, own)
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != own] = len(self.grams)
        ranks = self.ranks[:, at]
        distance = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own)))).sum(axis=1)
        best = int(distance.argmin())
        return self.names[best], 1.0 - float(distance[best]) / (self.size * len(own))


def _count(size: int):
    """Of each language of a task's documents, its n-grams and their counts."""

    def run(batches):
        held: dict[str, list[np.ndarray]] = {}
        n: dict[str, int] = {}

        def merged(parts):
            values = np.concatenate([v for v, _ in parts])
            counts = np.concatenate([c for _, c in parts])
            order = np.argsort(values, kind="stable")
            values, counts = values[order], counts[order]
            starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
            return values[starts], np.add.reduceat(counts, starts)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                grams = ngrams(text.as_py() or "")
                if grams is not None:
                    held.setdefault(lang, []).append(counted(grams))
                    n[lang] = n.get(lang, 0) + len(held[lang][-1][0])
                    if n[lang] > 1 << 20:
                        held[lang] = [merged(held[lang])]
                        n[lang] = 0
        for lang, parts in held.items():
            values, counts = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

    return run


def fit(training: DataFrame, size: int = PROFILE, sample_docs: int = SAMPLE_DOCS, max_languages: int = MAX_LANGUAGES) -> Model:
    """Profiles from training (doc_id, text, lang)."""
    rows = training.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("text").bitwiseAND(F.lit((1 << 63) - 1)).alias("h"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages: raise max_languages")
    if not sizes:
        return Model({}, size)
    below = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min((1 << 63) - 1, int((1 << 63) * (sample_docs / max(1, r["n"])))))])
    sample = rows.where(F.col("h") <= below[F.col("lang")]).dropDuplicates(["lang", "h"]).select("lang", "text")
    grams = sample.mapInArrow(_count(size), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = grams.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("k") <= size)
    found: dict[str, list] = {}
    for r in ranked.orderBy("lang", "k").collect():  # size rows of each language
        found.setdefault(r["lang"], []).append(r["gram"])
    return Model({k: np.array(v, dtype=np.int64).view(np.uint64) for k, v in found.items()}, size)


def _predict(model):
    def run(batches):
        for batch in batches:
            found = [model.value.predict(v.as_py()) for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, held_out=None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of docs; held_out is a boolean column, false if not given."""
    flag = F.lit(False) if held_out is None else held_out
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), flag.alias("held_out"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, held_out boolean, lang_pred string, score double")


def fold(doc_id: str = "doc_id"):
    """crc32 of the id's decimal text, modulo 4; null for a null id."""
    return F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")), F.lit(4))
