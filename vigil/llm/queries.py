"""Queries of the corpus operators: one ``opN_<name>`` each, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, byte_bpe, decontaminate, embeddings, html_extract, jaccard_join, language, quality, resampling, secrets, substring_dedup, token_files, warc
from .common import table


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.pages_report(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), "page_id", "url", "html").withColumnRenamed("key", "page_id")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (
    op1_jaccard_join, op2_token_files, op3_language_id, op4_html_extract, op5_secret_scan, op6_substring_dedup, op7_quality, op8_decontaminate, op9_byte_bpe, op10_embedding_dedup,
    op11_resampling, op12_warc, op13_alignment, language_id_pages,
)}

#: DuckDB SQL for the queries that SQL can express on whole tables.
ORACLE: dict[str, str] = {
    "op11_resampling": """
with table_of as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
), texts as (
  select 'documents' as side, row_number() over () as row, doc_id, text from documents
  union all select 'benchmark', row_number() over (), null, text from benchmark
), words as (
  select side, row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as word from texts
), bytes as (
  select word, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 1 + 2 * i, 2))::bigint) as b from (select distinct word from words)
), hashed as (
  select word, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 as bucket from bytes, table_of
), counts as (
  select bucket, count_if(side = 'documents') as s, count_if(side = 'benchmark') as t from words join hashed using (word) group by bucket
), sums as (
  select sum(s)::double as s, sum(t)::double as t from counts
), gains as (
  select bucket, floor(1000 * ln((counts.t + 1) * (sums.s + 10000) / ((counts.s + 1) * (sums.t + 10000))))::bigint as gain from counts, sums
), weights as (
  select row, count(*) as n, sum(gain)::bigint as weight from words join hashed using (word) join gains using (bucket) where side = 'documents' group by row
), scored as (
  select doc_id, coalesce(n, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from texts left join weights using (row) where side = 'documents'
), placed as (
  select *, case when n_features >= 20 then row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls last) end as place,
    10 * count_if(n_features >= 20) over () // 100 as draw
  from scored
)
select doc_id, n_features, weight, score, case when place <= draw then place end as rank from placed""",
    "op12_warc": f"""
with hashed as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h, min(page_id) over (partition by coalesce(html, '')) as first from pages
)
select page_id, octet_length(encode(html)) as payload_bytes,
  translate({" || ".join(f"to_base(('0x' || substr(h, {1 + 5 * i}, 5))::bigint, 32, 4)" for i in range(8))}, '{warc.DIGITS}', '{warc.BASE32}') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from hashed""",
}
