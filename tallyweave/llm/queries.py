"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, classifier, decontam, lm, packing, quality, rollup, secrets, shard, simhash
from .common import checkpoint, documents, scratch_path


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.pseudo_likelihood(documents(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


#: A conversation whose texts hold the template's control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(os.path.join(sf_dir, "conversations.parquet")).select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return chat.digest_rendered(chat.format_conversations(chat.events_of_turns(turns.unionByName(own)), together=True))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality_rules(documents(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir))


def op7_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_key")
    )  # texts stay where they are: only keys are counted and exchanged
    placed = shard.shard_documents(rows, shards=24, size="size", group="text_key", tie="doc_id")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates are inserted, revised by exact counts (that batch is sent twice), toxic documents deleted."""
    docs = documents(spark, sf_dir)
    counted = checkpoint(rollup.token_counts(docs, keep=["doc_id", "source", "lang"])).withColumn("tokenizer", F.lit("byte_bpe_50k"))
    estimate = F.ceil(F.col("n_bytes") / 4).cast("long")
    ledger = rollup.TokenRollup(spark, scratch_path(spark, "token-rollup"))
    ledger.apply("load", counted.select(F.lit("insert").alias("op"), *rollup.KEY, estimate.alias("n_tokens"), "n_bytes", F.lit(0).alias("old_tokens"), F.lit(0).alias("old_bytes")))
    exact = counted.select(F.lit("revise").alias("op"), *rollup.KEY, "n_tokens", "n_bytes", estimate.alias("old_tokens"), F.col("n_bytes").alias("old_bytes"))
    ledger.apply("exact", exact)
    ledger.apply("exact", exact)
    toxic = spark.read.parquet(os.path.join(sf_dir, "labels.parquet")).where("toxic = 1").select("doc_id").distinct()
    gone = counted.join(toxic, "doc_id", "left_semi")
    ledger.apply("toxic", gone.select(F.lit("delete").alias("op"), *rollup.KEY, "n_tokens", "n_bytes", F.lit(0).alias("old_tokens"), F.lit(0).alias("old_bytes")))
    return ledger.totals()


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(os.path.join(sf_dir, "labels.parquet"))
    return classifier.classify(documents(spark, sf_dir), labels)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(documents(spark, sf_dir), spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_scoring,
        op2_secret_scan,
        op3_best_fit_packing,
        op4_chat_formatting,
        op5_quality_rules,
        op6_simhash_near_dedup,
        op7_histogram_sharding,
        op8_token_rollup,
        op9_quality_classifier,
        op10_decontamination,
        pipeline,
    )
}

_OP4 = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
made as (
  select *, replace(replace(replace(text, '\', '\\'), '<', '<\'), '[', '[\') as body,
         replace(replace(replace(role, '\', '\\'), '<', '<\'), '[', '[\') as head from turns)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text)) as loss_sha256,
  cast(sum(case role when 'user' then length('<s>[INST][/INST]') + length(body) when 'assistant' then length('<s></s>') + length(body)
           else length('<s>[ROLE][TEXT][/TEXT]') + length(head) + length(body) end) as bigint) as formatted_chars
from made group by conv_id
"""



def _js_sql(counts: str, reference: str) -> str:
    """Jensen-Shannon distance of two lists of counts."""
    p, q = f"({counts}[i] / cast(list_sum({counts}) as double))", f"({reference}[i] / cast(list_sum({reference}) as double))"
    part = lambda x: f"(case when {x} > 0 then {x} * log2({x} / (({p} + {q}) / 2)) else 0.0 end)"
    terms = f"list_sum(list_transform(range(1, len({counts}) + 1), lambda i: {part(p)} + {part(q)}))"
    return f"(case when list_sum({counts}) > 0 and list_sum({reference}) > 0 then sqrt(greatest(0.0, {terms} / 2)) else 1.0 end)"


def _op5_sql() -> str:
    words = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    lists = " ".join(f"when '{code}' then {words(ws)}" for code, ws in quality.COMMON_WORDS.items())
    stripped = lambda chars: f"length(regexp_replace(t, '[^{chars}]', '', 'g'))"
    bare = "[0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1]"
    return rf"""
with d as (select row_number() over () as rid, doc_id, lang, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
places as (select rid, i, array_to_string(ws[i:i + 7], ' ') as k from (select rid, ws, unnest(range(1, len(ws) - 6)) as i from w)),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, k) as c from places) where c > 1),
cover as (select rid, count(distinct i + j) as n from (select rid, i, unnest(range(8)) as j from twice) group by rid),
counted as (select rid, doc_id, lang, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, {stripped('#*$%&|<>')} as n_symbols,
  len(lines) - len(list_distinct(lines)) as n_dup_lines, length(t) as n_chars, {stripped('a-z')} as lower, {stripped('A-Z')} as upper, {stripped('0-9')} as digits, {stripped(chr(92) + 'p{L}')} as letters,
  list_transform(case lang {lists} else {words(quality.OTHER_WORDS)} end, lambda x: len(list_filter(list_transform(ws, lambda y: lower(y)), lambda y: y = x))) as common from w),
rated as (select *, n_chars - word_chars as spaces, coalesce(n, 0) as n_repeat_words, n_words < 20 or 100 * coalesce(n, 0) > 30 * n_words as base_failed,
  [lower, n_chars - word_chars, upper, digits, letters - lower - upper, n_symbols, n_chars - lower - (n_chars - word_chars) - upper - digits - (letters - lower - upper) - n_symbols] as classes,
  list_append(common, n_words - cast(list_sum(common) as bigint)) as words from counted left join cover using (rid)),
slots as (select lang, 'c' as kind, unnest(classes) as c, unnest(range(len(classes))) as i from rated where not base_failed
  union all select lang, 'w', unnest(words), unnest(range(len(words))) from rated where not base_failed),
sums as (select lang, kind, list(s order by i) as s from (select lang, kind, i, cast(sum(c) as bigint) as s from slots group by lang, kind, i) group by lang, kind),
reference as (select a.lang, a.s as class_ref, b.s as word_ref, {_js_sql(bare, 'b.s')} as bare, 1 - b.s[13] / nullif(cast(list_sum(b.s) as double), 0) as usual
  from sums a join sums b on a.lang is not distinct from b.lang where a.kind = 'c' and b.kind = 'w'),
judged as (select r.*, usual, bare, case when class_ref is null then 0.0 else {_js_sql('classes', 'class_ref')} end as class_distance,
  case when word_ref is null then 0.0 else {_js_sql('words', 'word_ref')} end as word_distance from rated r left join reference f on r.lang is not distinct from f.lang)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (word_chars >= 200 and class_distance > 0.30) and not (n_words >= 100 and (word_distance > 0.40 or
    coalesce(n_words * usual >= 20 and 1 - words[13] / nullif(cast(n_words as double), 0) < usual and word_distance > bare * 0.80, false))) as kept,
  round(class_distance, 6) as class_distance, round(word_distance, 6) as word_distance
from judged"""


ORACLE_SQL = {"op4_chat_formatting": _OP4, "op5_quality_rules": _op5_sql()}
