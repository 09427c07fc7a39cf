"""The queries of the training-data operators, and the SQL that DuckDB can run for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, extract, language, linededup, media, pieces, reputation, sharding, simhash, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    outcomes = reputation.outcomes_by_text(pages, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return reputation.judge(pages, outcomes)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.align_vectors(_table(spark, sf_dir, "embeddings"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(token_counts.flatten(_table(spark, sf_dir, "documents")))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_texts(_table(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_sentencepiece, op3_decontaminate, op4_media, op5_simhash, op6_language, op7_sharding, op8_token_counts, op9_main_text, op10_line_dedup)}


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = rf"""
with doc as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
item as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
win as (
  select item_id, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') g, n
  from (select item_id, w, least(10, len(w)) n, unnest(range(1, len(w) - least(10, len(w)) + 2)) i from item where len(w) > 0)
),
sizes as (select distinct n from win),
spot as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from doc, sizes where len(w) >= n),
hit as (
  select doc_id, i, spot.n, item_id
  from spot join win on win.n = spot.n and win.g = list_aggregate(spot.w[i : i + spot.n - 1], 'string_agg', ' ')
),
covered as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hit) group by 1),
named as (
  select doc_id, count(*) n_items, string_agg(id, ',' order by id) ids
  from (select distinct doc_id, cast(item_id as varchar) id from hit) group by 1
)
select doc.doc_id, cast(coalesce(len(w), 0) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit,
  cast(coalesce(n_items, 0) as bigint) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from doc left join covered using (doc_id) left join named using (doc_id)
"""

OP10_SQL = r"""
with raw as (select doc_id, string_split(text, chr(10)) ls from documents),
line as (
  select doc_id, i - 1 line_no, list_sort(list_distinct(list_filter(string_split(ls[i], ' '), lambda w: w <> ''))) w
  from (select doc_id, ls, unnest(range(1, len(ls) + 1)) i from raw)
),
word as (select row_number() over (order by doc_id, line_no) pos, doc_id, line_no, w, len(w) n from line where len(w) > 0),
class as (select min(pos) pos, w, any_value(n) n from word group by w),
later as (
  select distinct b.pos from class a join class b
  on a.pos < b.pos and 10 * a.n >= 8 * b.n and 10 * b.n >= 8 * a.n and 18 * len(list_intersect(a.w, b.w)) >= 8 * (a.n + b.n)
),
kept as (select doc_id, line_no from word where pos in (select pos from class) and pos not in (select pos from later))
select d.doc_id, cast(coalesce(n_lines, 0) as bigint) n_lines, cast(coalesce(n_kept, 0) as bigint) n_kept, coalesce(kept_lines, '') kept_lines
from documents d
left join (select doc_id, count(*) n_lines from word group by 1) using (doc_id)
left join (select doc_id, count(*) n_kept, string_agg(cast(line_no as varchar), ',' order by line_no) kept_lines from kept group by 1) using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": OP3_SQL, "op10_line_dedup": OP10_SQL}
