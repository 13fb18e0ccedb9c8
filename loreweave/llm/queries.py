"""Queries of the operators over whole tables, and their SQL twins, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import round_trip
from .collocations import collocations
from .decontaminate import contamination
from .exact_dedup import exact_duplicates
from .language import identify
from .near_dup import near_duplicates
from .packing import pack
from .quality import score_quality
from .secret_scan import find_secrets
from .sharding import FANOUT, SMALL_BYTES, TARGET_BYTES, WAVES, shard_table
from .spelling import spelling_variants
from ..sources.staging import Stage
from .tokens import count_tokens
from .toxicity import score_toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, _read(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_read(spark, sf_dir, "documents"))


def op3_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_size_tiered_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_table(spark, _read(spark, sf_dir, "documents"), Stage(spark, "shards").folder)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark, _read(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_read(spark, sf_dir, "documents"), keep="largest")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).drop("saving")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark, _read(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark, _read(spark, sf_dir, "documents"))


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_minhash_near_dedup,
        op2_token_counts,
        op3_retrieval_packing,
        op4_decontamination,
        op5_quality_classifier,
        op6_size_tiered_sharding,
        op7_language_id,
        op8_exact_dedup,
        op9_secret_scan,
        op10_toxicity,
        op11_spelling_variants,
        op12_collocations,
        op13_bpe_round_trip,
    )
    return {f.__name__: f for f in found}


ORACLE = {
    "op6_size_tiered_sharding": f"""
        with d as (select doc_id, octet_length(encode(coalesce(text, '')))::bigint as n_bytes, md5(coalesce(text, '')) as text_md5,
                          ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint as h,
                          ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 2))::bigint % {WAVES} as wave from documents),
             s as (select greatest(1, ceil(sum(n_bytes) / {TARGET_BYTES}.0))::bigint as shards from d),
             p as (select doc_id, n_bytes, text_md5, (h % shards)::int as shard_no from d, s)
        select doc_id, n_bytes, text_md5, (select case when sum(n_bytes) <= {SMALL_BYTES} then 0 else 1 + floor(log2(sum(n_bytes) / {SMALL_BYTES}.0) / log2({FANOUT}))::int end from d)::int as shard_tier, shard_no, count(*) over (partition by shard_no) as shard_rows,
               (sum(n_bytes) over (partition by shard_no))::bigint as shard_bytes from p""",
    "op8_exact_dedup": """
        with d as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents)
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, text_sha256
        from d window w as (partition by text_sha256)""",
    "op12_collocations": r"""
        with p as (select coalesce(lang, 'und') as lang,
                          unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
             w as (select lang, regexp_extract_all(piece, '[^ \t]+') as ws from p),
             g as (select lang, ws[i:i + k - 1] as g from w, (select unnest([1, 2, 3, 4]) as k), unnest(range(1, len(ws) - k + 2)) t(i)),
             f as (select lang, g, count(*) as f from g group by all having count(*) >= 30),
             n as (select lang, sum(len(ws))::bigint as n from w group by lang),
             c as (select lang, g, f as a from f where len(g) > 1),
             s as (select lang, g[i:i + m - 1] as g, max(f) as longer from f, (select unnest([2, 3]) as m), unnest(range(1, len(g) - m + 2)) t(i) where m < len(g) group by all),
             k as (select c.lang, c.g, c.a, cut, x.f as l, y.f as r, (2000000::hugeint * c.a // (x.f + y.f))::bigint as score
                   from c, unnest(range(1, len(c.g))) t(cut) join f x on x.lang = c.lang and x.g = c.g[1:cut] join f y on y.lang = c.lang and y.g = c.g[cut + 1:]),
             b as (select lang, array_to_string(g, ' ') as phrase, a, l, r, score from k where not exists (select 1 from s where s.lang = k.lang and s.g = k.g and 100 * s.longer >= 80 * k.a)
                   qualify row_number() over (partition by lang, g order by score, cut) = 1)
        select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from b join n using (lang)
        qualify rank <= 2000""",
}
assert FANOUT <= WAVES  # waves are of similar size and merge into one run, as the SQL of op6 has it


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
