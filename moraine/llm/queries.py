"""The queries of the training-data operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm import blocks, common, kdtree, language, near_dedup, packing, pieces, secrets, sharding, substring_dedup, tiles, token_count


def op1_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048)


def op2_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5, kdtree.TopProducts())


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(common.table(spark, sf_dir, "documents"), k=3, percent=85)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language.fit_language_model(docs, ~held_out)
    return language.predict_languages(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is the folder in moraine.tokenCache, or a new one where that is not set."""
    cache = spark.conf.get("moraine.tokenCache", None) or common.fresh_path(spark, "token-cache")
    return token_count.count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(common.table(spark, sf_dir, "documents"))


def op8_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    stored = sharding.shard_documents(docs, common.fresh_path(spark, "shards")).read()
    return (docs.limit(0) if stored is None else stored).select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op9_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20, tiles.Products(), nonzero=True)


def op10_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated_spans(common.table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return found.select("doc_id", "n_spans", "n_chars", spans.alias("spans"), "first_docs")


QUERIES = {f.__name__: f for f in (op1_pattern_packing, op2_kdtree_topk, op3_sentencepiece, op4_minmax_dedup, op5_language_id, op6_token_counts, op7_secret_scan, op8_tiered_shards, op9_block_join, op10_gear_chunks)}

_RANDOM_MIX = "regexp_matches(v, '[A-Z]') and regexp_matches(v, '[a-z]') and regexp_matches(v, '[0-9]')"


def _spans_sql(kind: int, pattern: str, value: str, keep: str) -> str:
    """doc, start, kind, stop, value of all matches of one kind."""
    p = pattern.replace("'", "''")
    return f"""select doc_id, source, s as start, {kind} as kind, s + length(m) as stop, {value} as v from (
      select doc_id, source, unnest(ms) as m, unnest(list_transform(range(1, len(ms) + 1), lambda i: coalesce(list_sum(list_transform(ss[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0)))::bigint as s
      from (select doc_id, source, regexp_extract_all(text, '{p}') as ms, string_split_regex(text, '{p}') as ss from documents)) where {keep}"""


_ASSIGNED = f"regexp_extract(m, '{secrets.ASSIGN.replace(chr(39), chr(39) * 2)}', 2)"
_NAMES = "['assign', 'access', 'hex', 'random'][kind + 1]"


def _nearest_sql(vector: str, every: int, k: int, usable: str) -> str:
    return f"""
with v as (select row_number() over () as r, vec_id, {vector} as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 {usable}),
p as (select q.vec_id as query_id, q.r, c.vec_id, {{score}} as score from v q join v c on q.r <> c.r and len(q.e) = len(c.e) where q.vec_id % {every} = 0)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id, r order by score desc, vec_id) as rank from p) where rank <= {k}"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = {
    "op4_minmax_dedup": f"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as sh from words),
n as (select doc_id, count(*) as n from s group by doc_id),
links as (select a.doc_id as x, b.doc_id as y from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id
  having 100 * count(*) >= 85 * ((select n from n where doc_id = a.doc_id) + (select n from n where doc_id = b.doc_id) - count(*))),
reach as (select doc_id, doc_id as r from documents union select reach.doc_id, y from reach join links on x = r)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d left join n on n.doc_id = d.doc_id join (select doc_id, min(r) as component_id from reach group by doc_id) c on c.doc_id = d.doc_id""",
    "op2_kdtree_topk": _nearest_sql("list_transform(embedding, lambda x: floor(256 * x::double))", 50, 5, "").format(score="list_inner_product(q.e, c.e)::bigint"),
    "op9_block_join": _nearest_sql("embedding::double[]", 20, 20, "and len(list_filter(embedding, lambda x: x <> 0)) > 0").format(score="list_inner_product(q.e, c.e)"),
    "op7_secret_scan": f"""
with base as (
  {_spans_sql(0, secrets.ASSIGN, _ASSIGNED, f"length({_ASSIGNED}) >= 12")}
  union all {_spans_sql(1, secrets.ACCESS, "m", "true")}
  union all {_spans_sql(2, secrets.HEX, "m", "true")}),
more as ({_spans_sql(3, secrets.RANDOM, "m", "regexp_matches(m, '[A-Z]') and regexp_matches(m, '[a-z]') and regexp_matches(m, '[0-9]')")}),
spans as (select * from base union all select * from more where not exists (select 1 from base b where b.doc_id = more.doc_id and b.start < more.stop and more.start < b.stop)),
held as (select v as hv, count(distinct source) >= 3 or count(distinct doc_id) >= 100 as example from spans group by v),
classed as (select s.*, example, not example and regexp_matches(v, '[A-Za-z]') and regexp_matches(v, '[0-9]') as live from spans s join held on v = hv),
kept as (select * from classed where kind < 3 or live)
select d.doc_id, count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access, count(*) filter (where kind = 2) as n_hex,
  sha256(coalesce(string_agg(case when kind < 3 then concat({_NAMES}, ':', start, ':', stop) end, ',' order by start, kind, stop), '')) as base_sha256,
  coalesce(string_agg(concat({_NAMES}, ':', start, ':', stop), ',' order by start, kind, stop) filter (where kind is not null), '') as spans,
  count(*) filter (where live) as n_live, count(*) filter (where example) as n_example
from documents d left join kept k on d.doc_id = k.doc_id group by d.doc_id""",
    "op8_tiered_shards": "select doc_id, lang, source, n_chars, sha256(text) as text_sha256 from documents",
}
