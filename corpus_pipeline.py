"""A training-data pipeline over the documents table: five stages, each over all that its predecessor kept.

A null text has no words, so the first stage drops it; nulls in other columns, extra columns and an empty table pass
through all stages.  Rows that are equal in all columns are one document from the second stage on; rows that differ in any
column, as by where a null stands, are told apart, and of rows of one doc_id each is a document of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import bpe_automaton, decontaminate, jaccard, quality, registry, secrets
from netloom.llm._shared import drop, keep


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the cascade keep."""
    return quality.kept_rows(docs)


def _unused(docs: DataFrame, name: str) -> str:
    """name, or a longer one that is no column of docs."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are linked at 0.8: that of the least doc_id.

    Rows equal in all columns are one document.  A null doc_id comes last.
    """
    # names and nulls are part of a row's JSON; two unlike rows of one 64-bit key would both stay or both go
    key, group = _unused(docs, "key"), _unused(docs, "group")
    keyed = docs.withColumn(key, F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))))
    found = jaccard.jaccard_components(keyed.select(F.col(key).alias("doc_id"), "text"), size=5, percent=80)
    groups = found.select(F.col("doc_id").alias(key), F.col("component_id").alias(group)).distinct()
    first = keyed.select(key, "doc_id").join(groups, key).groupBy(group).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(key).alias("key"))).alias("x"))
    once = [c for c, kind in keyed.dtypes if "map<" not in kind]  # maps can't be compared, but are in the key
    return keyed.join(first.select(F.col("x.key").alias(key)), key, "left_semi").dropDuplicates(once).select([f"`{c}`" for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of the benchmark, and no shorter item of it, occurs."""
    return decontaminate.drop_contaminated(docs, registry.table(spark, sf_dir, "benchmark"), size=10)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in text replaced by its kind, and n_chars to match."""
    out = secrets.mask_secrets(docs, ranks=registry.word_ranks(spark))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the decoded text."""
    raw = bpe_automaton.read_file(spark, registry.tokenizer_path("byte_bpe_50k.json"))
    return bpe_automaton.encode_documents(docs, raw)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("BPE encoding and decoding", bpe_encoding),
]

ORACLE_SQL = None  # BPE encoding can't be put in SQL; tests hold run() against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again as the next one's."""
    docs = registry.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, keep(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
