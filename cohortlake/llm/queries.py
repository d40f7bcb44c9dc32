"""The registered queries of the text operators, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm import exact_dedup, hard_negatives, language_id, license_scan, media_columns, mixing, ngram_model, piece_codec, secret_scan, simhash, token_files, toxicity
from cohortlake.llm.common import documents


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_of(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages_of(documents(spark, sf_dir))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.media_digests(documents(spark, sf_dir))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encoding_digests(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digests(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_model.score_texts(documents(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_license_scan, op2_toxicity, op3_language_id, op4_media_columns, op5_mix_sources, op6_exact_dedup, op7_piece_codec, op8_token_files, op9_secret_scan, op10_simhash, op11_lm_scoring, op12_hard_negatives, pipeline)
    return {f.__name__: f for f in own}


MIX_SQL = r"""
with d as (
  select doc_id, source, coalesce(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')), 0)::bigint as size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 12))::bigint as key
  from documents),
t as (select source, sum(size)::double as source_size from d group by source),
w as (select *, list_extract([5.0, 2.0, 1.0], ((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1)::int)::double as weight,
    source_size * 2.0 as most, sum(source_size) over () * 1.5 as budget from t),
f as (select *, greatest(budget - coalesce(sum(most) over p, 0.0), 0.0) as rest, sum(weight) over () - coalesce(sum(weight) over p, 0.0) as open
  from w window p as (order by most / weight, source is null, encode(source) rows between unbounded preceding and 1 preceding)),
u as (select *, most <= rest / open * weight as cut from f),
v as (select source, source_size, case when cut then most else weight * (select min_by(rest / open, most / weight) from u where not cut) end as target from u),
r as (select d.doc_id, d.size, v.source_size, v.target, floor(v.target)::bigint as budget, sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows unbounded preceding)::bigint - d.size as before
  from d join v on d.source is not distinct from v.source),
e as (select *, case when source_size > 0 then floor(budget / source_size)::bigint else 0 end as epochs from r)
select doc_id, size, source_size::bigint as source_size, target, epochs * size + greatest(0, least(size, budget - epochs * source_size::bigint - before))::bigint as taken from e
"""

DEDUP_SQL = """
with n as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id is not distinct from max(doc_id) over g as kept, text_sha256 from n window g as (partition by text_sha256)
"""

HARD_NEGATIVES_SQL = """
with v as (select row_number() over () as row_id, vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.row_id, a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, cast(list_inner_product(a.q, b.q) as bigint) as score
  from v a join v b on a.row_id <> b.row_id where a.vec_id % 50 = 0),
p as (select row_id, anchor_id, other_id as positive_id, score as positive_score, row_number() over (partition by row_id order by score desc, other_id nulls last) as place from s where same
  qualify place <= 5),
n as (select p.*, s.other_id as negative_id, s.score as negative_score, row_number() over (partition by p.row_id, p.place order by s.score desc, s.other_id nulls last) as rank
  from p join s on p.row_id = s.row_id and not s.same and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_mix_sources": MIX_SQL, "op6_exact_dedup": DEDUP_SQL, "op12_hard_negatives": HARD_NEGATIVES_SQL}
