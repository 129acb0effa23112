"""The queries of the operators over the test tables, with their production parameters, and SQL for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_automaton, chat, decontaminate, jaccard, language_id, lexical, licenses, packing, passages, quality, repair, secrets, token_counts

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_ranks(spark: SparkSession) -> dict[str, int]:
    return secrets.ranked_words(bpe_automaton.read_file(spark, tokenizer_path("byte_bpe_50k.json")))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"), ranks=word_ranks(spark))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = bpe_automaton.read_file(spark, tokenizer_path("piece_bpe_32k.model"))
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), raw, limit=4096)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", "source", "doc_id").alias("path"))
    return licenses.scan(docs)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = bpe_automaton.read_file(spark, tokenizer_path("byte_bpe_50k.json"))
    return bpe_automaton.encode_documents(table(spark, sf_dir, "documents"), raw, with_ids=False)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    return decontaminate.digests(found)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(language_id.fold() == 2, F.lit(False))
    return language_id.identify(docs, language_id.fit(docs.where(~held_out)), held_out)


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = repair.damaged(table(spark, sf_dir, "conversations"))
    return repair.repair(turns, F.col("copies")).summary()


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.index(table(spark, sf_dir, "documents"))
    return found.search(table(spark, sf_dir, "benchmark"), k=10)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = bpe_automaton.read_file(spark, tokenizer_path("word_bpe_49k.json"))
    return packing.pack(table(spark, sf_dir, "documents"), raw, size=4096, end_id=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f) and k[2:].split("_")[0].isdigit()}


_WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op4_ngram_jaccard_join": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] for i in range(1, len(ws) - 2)]) end as sh from w),
n as (select doc_id, len(sh) as n, md5(array_to_string(list_sort(sh), chr(10))) as h from s),
rep as (select h, min(doc_id) as r from n where n > 0 group by h),
one as (select s.doc_id, unnest(sh) as t from s join rep on s.doc_id = rep.r),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as i from one a join one b on a.t = b.t and a.doc_id < b.doc_id group by all),
near as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
link as (select a, b from near union all select b, a from near),
reach as (select r as v, r as root from rep union select link.b, reach.root from reach join link on link.a = reach.v),
comp as (select v, min(root) as c from reach group by v)
select n.doc_id, n.n::bigint as n_shingles, coalesce(c, n.doc_id)::bigint as component_id
from n left join rep on n.n > 0 and n.h = rep.h left join comp on comp.v = rep.r""",
    "op9_decontaminate": r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
p as (select distinct item_id, least(10, len(ws)) as m, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') as t
  from (select *, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) as i from b where len(ws) > 0)),
lens as (select distinct m from p),
f as (select doc_id, m, i, array_to_string(ws[i : i + m - 1], ' ') as t from (select d.*, m, unnest(range(1, len(ws) - m + 2)) as i from d, lens where len(ws) >= m)),
o as (select doc_id, item_id, i, m from f join p using (m, t)),
hit as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + m)) as k from o) group by doc_id),
its as (select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id::varchar)), ',') as s from o group by doc_id)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join its using (doc_id)""",
    "op12_lexical_search": r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents),
c as (select r, doc_id, len(ws) as n, 100 - 90 + ((90 * len(ws) * (select count(*) from d where len(ws) > 0)) // (select sum(len(ws))::bigint from d)) as m from d where len(ws) > 0),
size as (select count(*) as n from c),
tf as (select r, t, count(*) as tf from (select r, unnest(ws) as t from d) group by all),
df as (select t, floor(1000 * ln((2 * (select n from size) + 2) / (2 * count(*) + 1)))::bigint as w from tf group by t),
q as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
s as (select item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from q join df using (t) join tf using (t) join c using (r) group by all)
select item_id, k::int as rank, doc_id, score
from (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as k from s join c using (r) where score > 0)
where k <= 10""",
    "op7_chat_format": r"""
with t as (
  select conv_id, list(struct_pack(r := role, x := text) order by turn nulls last, role nulls last, text nulls last) as ts from conversations group by conv_id),
u as (select min(conv_id) as conv_id, ts from t group by ts),
g as (select unnest([ts[1:k] for k in range(1, len(ts))]) as ts from u)
select conv_id, len(ts)::bigint as n_turns,
  array_to_string([('<|im_start|>' || coalesce(x.r, 'unknown') || chr(10) || coalesce(x.x, '') || '<|im_end|>' || chr(10)) for x in ts], '') as rendered
from u where not exists (select 1 from g where g.ts = u.ts)""",
}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in queries()}
