"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule rejects a document by one expression over its text.  On a bounded sample each rule's rejections are counted
and its evaluation is timed, with the measures that it needs; the rules are then ordered by rejections per second, and a document meets them in that
order until one rejects it: nested CASE branches, of which Spark evaluates no more than it needs.  The order changes
what a scan costs, never its result.

A null text has no words.  Words are runs of other characters than space, tab, line feed, vertical tab, form feed and
carriage return.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 400
"""Documents of the sample on which rules are timed."""
SAMPLE_SHARE = 4
"""One document of so many, by the hash of its text, may be in the sample."""
SPACE = "[ \\t\\n\\u000B\\f\\r]"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """name, and the condition on which it rejects a row that has the columns of measured()."""

    name: str
    rejects: Callable[[], Column]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+", -1), lambda w: w != "")


def measured(docs: DataFrame) -> DataFrame:
    """docs with words (an array), n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n = F.size("words")
    first = docs.withColumn("_text", text).withColumn("words", _words(F.col("_text")))
    codes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.struct(F.xxhash64(*[F.get("words", i + (k - 1)) for k in range(WINDOW)]).alias("h"), i.alias("i"))))
    lines = F.filter(F.split("_text", "\n", -1), lambda s: s.rlike(f"[^ \\t\\n\\u000B\\f\\r]"))
    second = (
        first.withColumn("n_words", n.cast("long"))
        .withColumn("word_chars", F.length(F.regexp_replace("_text", f"{SPACE}+", "")).cast("long"))
        .withColumn("n_symbols", (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long"))
        .withColumn("_lines", lines)
        .withColumn("_codes", codes)
    )
    # windows found twice or more: neighbours in order of code; then the words that their places cover
    some = F.size(F.array_distinct(F.transform("_codes", lambda x: x["h"]))) < F.size("_codes")
    third = second.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).withColumn("_sorted", F.when(some, F.sort_array("_codes")))
    pairs = F.zip_with(F.slice("_sorted", F.lit(1), F.size("_sorted") - 1), F.slice("_sorted", F.lit(2), F.size("_sorted") - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    fourth = third.withColumn("_at", F.when(F.col("_sorted").isNotNull(), F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))))
    covered = F.aggregate(F.zip_with(F.slice("_at", F.lit(1), F.size("_at") - 1), F.slice("_at", F.lit(2), F.size("_at") - 1), lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(WINDOW), lambda s, x: s + x)
    return fourth.withColumn("n_repeat_words", F.when(F.size("_at") > 0, covered).otherwise(0).cast("long")).drop("_text", "_lines", "_codes", "_sorted", "_at")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def _share(part: Column, percent: int, whole: str = "n_words") -> Column:
    return F.lit(100) * part > F.lit(percent) * F.col(whole)


def rules() -> list[Rule]:
    """The rules beside the base: symbol runs, shouting, repeated lines, one word over and over, odd word lengths."""
    return [
        Rule("symbols", lambda: _share(F.col("n_symbols"), 30)),
        Rule("repeated_lines", lambda: (F.col("n_dup_lines") > 3) & _share(F.col("n_dup_lines") * 10, 60)),
        Rule("word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
        Rule("capitals", lambda: _share(F.length(F.regexp_replace("text", "[^A-Z]", "")), 50, "word_chars")),
        Rule("one_word", lambda: _share(F.size("words") - F.size(F.array_distinct("words")), 90) & (F.size(F.array_distinct("words")) < 12)),
    ]


def ordered(docs: DataFrame, chosen: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """chosen by falling rejections per second on a sample of docs; rules that can't be told apart by name.

    The sample is taken from as few partitions as hold it.  A rule's time is the least of two runs, less what a run takes
    that only reads the sample's texts.
    """
    text = F.col("text").cast("string")
    rows = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_SHARE)) == 0).take(sample_rows)
    if not rows:
        return sorted(chosen, key=lambda r: r.name)
    sample = docs.sparkSession.createDataFrame(rows, "text string").coalesce(1).persist()

    def timed(measure: Column) -> tuple[float, int]:
        best, total = float("inf"), 0
        for _ in range(2):
            began = time.perf_counter()
            total = measured(sample).agg(F.sum(measure)).first()[0] or 0
            best = min(best, time.perf_counter() - began)
        return best, total

    try:
        nothing, _ = timed(F.length("text"))
        gain = {}
        for rule in chosen:
            took, rejected = timed(F.coalesce(rule.rejects(), F.lit(False)).cast("int"))
            gain[rule.name] = (rejected + 0.5) / max(took - nothing, 1e-3)
    finally:
        sample.unpersist()
    return sorted(chosen, key=lambda r: (-gain[r.name], r.name))


def cascade(chosen: list[Rule]) -> Column:
    """The name of the first rule, in this order, that rejects a row; null for a row that all rules pass."""
    out = F.lit(None).cast("string")
    for rule in reversed(chosen):
        out = F.when(F.coalesce(rule.rejects(), F.lit(False)), F.lit(rule.name)).otherwise(out)
    return out


def judged(docs: DataFrame, chosen: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with measured()'s columns but words, base_failed and kept.

    kept is false where the base fails, else where a rule rejects.  Columns of docs with one of the added names go.
    """
    chosen = rules() if chosen is None else chosen
    order = ordered(docs, chosen, sample_rows)
    base = Rule("base", base_failed)
    return measured(docs).withColumn("base_failed", base_failed()).withColumn("kept", cascade([base, *order]).isNull()).drop("words")


def kept_rows(docs: DataFrame, chosen: list[Rule] | None = None) -> DataFrame:
    """The rows of docs that judged() keeps, with all their columns as they were."""
    rows = judged(docs.select(F.struct("*").alias("_row"), F.col("text").cast("string").alias("text")), chosen)
    # a filter on a deterministic projection would be pushed below it, with every expression written out in full
    return rows.withColumn("_place", F.monotonically_increasing_id()).where("kept and _place >= 0").select("_row.*")
