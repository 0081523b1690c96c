"""Contract queries over the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapwright.llm.chat import rotate_perspectives
from mapwright.llm.decontaminate import find_contamination
from mapwright.llm.exact_dedup import exact_dedup
from mapwright.llm.jaccard import jaccard_components
from mapwright.llm.line_dedup import drop_recurring_lines
from mapwright.llm.mixing import mix_sources
from mapwright.llm.pii import find_pii, joined
from mapwright.llm.quality import classify_quality
from mapwright.llm.substring import remove_repeats
from mapwright.llm.token_output import tokens_round_trip


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    scored = classify_quality(documents(spark, sf_dir).select("doc_id", "text"), labels)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), keep="largest")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def op4_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return seen.select("conv_id", "perspective", "part", "part_start", "n_turns", "n_trained", F.sha2("rendered", 256).alias("rendered_sha256"), "mask")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).drop("source")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir))
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    counts = [of(i).alias(f"n_{k}") for i, k in enumerate(("email", "ip", "card", "phone"))]
    return found.select("doc_id", *counts, F.size("terms").cast("long").alias("n_term"), F.sha2(joined(F.col("spans")), 256).alias("base_sha256"), joined(F.concat("spans", "terms")).alias("spans"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_chat_perspectives": op4_chat_perspectives,
        "op5_line_dedup": op5_line_dedup,
        "op6_mix_sources": op6_mix_sources,
        "op7_pii": op7_pii,
        "op8_token_output": op8_token_output,
        "op9_decontamination": op9_decontamination,
        "op10_substring_dedup": op10_substring_dedup,
    }


OP2_SQL = """
select doc_id,
       max(doc_id) over (partition by norm) as keep_id,
       count(*) over (partition by norm) as group_size,
       doc_id = max(doc_id) over (partition by norm) as kept,
       sha256(norm) as text_sha256
from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents)
"""


OP4_SQL = r"""
with m as (select conv_id as c, turn as t, coalesce(role, 'unknown') as r, replace(coalesce(text, ''), '<|', '<\|') as x, floor(turn / 256)::bigint as part from conversations),
p as (select distinct c, r as perspective from m where r <> 'system'),
e as (select m.*, p.perspective, case when m.r = p.perspective then '<|assistant|>' when m.r = 'system' then '<|system|>' else '<|user name=' || replace(replace(replace(m.r, '<|', '<\|'), '|>', '\|>'), chr(10), ' ') || '|>' end || chr(10) as h from m join p on m.c is not distinct from p.c),
o as (select *, (sum(length(h) + length(x) + 8) over (partition by c, perspective, part order by t is null, t, r, x rows unbounded preceding) - length(x) - 8)::bigint as at_text from e),
g as (select c, perspective, part, count(*) as n_turns, sum(case when r = perspective then length(x) else 0 end)::bigint as n_trained, string_agg(h || x || '<|end|>' || chr(10), '' order by at_text) as rendered,
       coalesce(string_agg(at_text || ':' || (at_text + length(x)), ',' order by at_text) filter (r = perspective and length(x) > 0), '') as mask from o group by c, perspective, part)
select c as conv_id, perspective, part, coalesce(sum(length(rendered)) over (partition by c, perspective order by part nulls last rows between unbounded preceding and 1 preceding), 0)::bigint as part_start, n_turns, n_trained, sha256(rendered) as rendered_sha256, mask from g
"""

OP5_SQL = r"""
with d as (select doc_id, md5(text) as body, string_split(text, chr(10)) as lines from documents),
l as (select doc_id, body, unnest(range(len(lines))) as pos, unnest(lines) as line from d),
t as (select doc_id, body, pos, line, [case when regexp_matches(w, '[0-9]') then '<*>' else w end for w in regexp_extract_all(line, '[^\x20\x09-\x0D]+')] as w from l),
k as (select *, array_to_string(w, ' ') as masked, len(w) || '|' || array_to_string(w[1:3], ' ') as leaf from t where len(w) > 0),
open_ as (select leaf from k group by leaf having count(distinct doc_id) >= 5 or (max(len(w)) > 50 and count(distinct body) > 1)),
c as (select distinct doc_id, body, leaf, masked, w from k where leaf in (select leaf from open_)),
f as (select leaf, masked, w, count(*) as n, count(distinct body) > 1 and len(w) > 50 as passage from c group by leaf, masked, w),
total as (select leaf, sum(n) as total from f group by leaf),
places as (select leaf, n, unnest(range(len(w))) as i, unnest(w) as token from f),
const as (select leaf, i, token from places join total using (leaf) where token <> '<*>' group by leaf, i, token, total having sum(n) >= 0.25 * total),
named as (select p.leaf, p.masked, string_agg(case when const.token is null then '<*>' else p.token end, ' ' order by p.i) as template, 2 * count(const.token) >= count(*) as firm, any_value(p.n) as n, any_value(p.passage) as passage
          from (select leaf, masked, n, passage, unnest(range(len(w))) as i, unnest(w) as token from f) p left join const on const.leaf = p.leaf and const.i = p.i and const.token = p.token group by p.leaf, p.masked),
spread as (select leaf, template from c join named using (leaf, masked) where firm group by all having count(distinct doc_id) >= 5),
gone as (select leaf, masked from named where n >= 5 or passage union select leaf, masked from named join spread using (leaf, template) where firm),
kept as (select t.doc_id, t.pos, t.line, g.masked is not null as lost from t left join k on k.doc_id = t.doc_id and k.pos = t.pos left join gone g on g.leaf = k.leaf and g.masked = k.masked)
select doc_id, count(*) as n_lines, count_if(lost) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not lost), '')) as kept_sha256 from kept group by doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op4_chat_perspectives": OP4_SQL, "op5_line_dedup": OP5_SQL}
