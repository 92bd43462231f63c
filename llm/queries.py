"""The registered queries of this package, each over its whole table, with comparison SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from llm import (
    alignment,
    contamination,
    exact_dedup,
    hard_negatives,
    jaccard,
    kneser_ney,
    language,
    line_dedup,
    packing,
    perspectives,
    quality,
    records,
    toxicity,
)
from llm.tokens import vocabulary

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = kneser_ney.train_and_score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def fold(folds: int) -> Column:
    """crc32 of the document id as text, modulo the number of folds."""
    return kneser_ney.held_out_fold(F.col("doc_id"), folds)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"), fold(5) == 0)


def op6_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.perspectives(table(spark, sf_dir, "conversations"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality.quality_report(table(spark, sf_dir, "documents"))
    return report.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = line_dedup.line_report(table(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.train_and_score(documents, labels, fold(3) == 1)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.prepared(table(spark, sf_dir, "embeddings").withColumn("label", moved))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP9_SQL = f"""
with lines as (
  select doc_id, i as position, l as line from (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as l,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents)),
keyed as (
  select *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
shared as (
  select k, max(doc_id) as keeper from keyed where length(k) >= 20 and doc_id is not null
  group by k having count(distinct doc_id) >= 3),
marked as (
  select keyed.*, (shared.k is not null and doc_id <> keeper) as lost from keyed left join shared on keyed.k = shared.k)
select doc_id, count(*) as n_lines, (count(*) filter (lost))::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by position) filter (not coalesce(lost, false)), '')) as kept_sha256
from marked group by doc_id
"""

_COUNTS_SQL = f"""
tokens as (select doc_id, lang, source, coalesce(text, '') as t, {_WORDS} as w from documents),
windows as (
  select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from (select doc_id, w, unnest(generate_series(1, len(w) - 2)) as i from tokens where len(w) >= 3)),
repeated as (select doc_id, g from windows group by doc_id, g having count(*) > 1),
covered as (
  select doc_id, count(distinct j) as n from (
    select doc_id, unnest([i, i + 1, i + 2]) as j from windows join repeated using (doc_id, g)) group by doc_id),
full_lines as (
  select doc_id, l from (select doc_id, unnest(string_split(t, chr(10))) as l from tokens) where trim(l, {_BLANKS}) <> ''),
line_counts as (select doc_id, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines from full_lines group by doc_id),
counted as (
  select doc_id, lang, source, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, length(regexp_replace(t, '[^!]', '', 'g'))::bigint as n_marks,
         coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words
  from tokens left join covered using (doc_id) left join line_counts using (doc_id)),
based as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counted),
measured as (
  select *, n_symbols * 1000 // greatest(n_words, 1) as symbols, n_marks * 1000 // greatest(n_words, 1) as marks,
         n_dup_lines * 1000 // greatest(n_lines, 1) as dup_lines, n_repeat_words * 1000 // greatest(n_words, 1) as repeats,
         word_chars * 1000 // greatest(n_words, 1) as word_length from based),
long as (unpivot (select lang, source, symbols, marks, dup_lines, repeats, word_length from measured where not base_failed)
         on symbols, marks, dup_lines, repeats, word_length into name measure value v),
sketch as (
  select lang, source, measure, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) as value, count(*) as n
  from long group by all),
ranked as (
  select *, sum(n) over (partition by lang, source, measure order by value) as upto,
         sum(n) over (partition by lang, source, measure) as total from sketch),
percentiles as (
  select lang, source, measure, min(value) filter (100 * upto >= total) as q1, min(value) filter (100 * upto >= 10 * total) as q10,
         min(value) filter (100 * upto >= 25 * total) as q25, min(value) filter (100 * upto >= 50 * total) as q50,
         min(value) filter (100 * upto >= 75 * total) as q75, min(value) filter (100 * upto >= 90 * total) as q90,
         min(value) filter (100 * upto >= 99 * total) as q99 from ranked group by all),
middle as (
  select *, case when q75 <= q50 + least_ then q75 + greatest(5 * (q75 - q50), least_) else q50 + least_ end as h75,
         case when q25 >= q50 - least_ then q25 - greatest(5 * (q50 - q25), least_) else q50 - least_ end as l25
  from percentiles join (values ('symbols', 50), ('marks', 50), ('dup_lines', 250), ('repeats', 100), ('word_length', 1500)) l(measure, least_) using (measure)),
outer_ as (
  select *, case when q90 <= h75 then q90 + greatest(5 * (q90 - q50), least_) else h75 end as h90,
         case when q10 >= l25 then q10 - greatest(5 * (q50 - q10), least_) else l25 end as l10 from middle),
fences as (
  select lang, source, measure, case when q99 <= h90 then greatest(h90, q99 + least_ // 2) else h90 end as high,
         case when q1 >= l10 then least(l10, q1 - least_ // 2) else l10 end as low from outer_),
bounds as (
  select lang as b_lang, source as b_source, max(high) filter (measure = 'symbols') as m1, max(high) filter (measure = 'marks') as m2,
         max(high) filter (measure = 'dup_lines') as m3, max(high) filter (measure = 'repeats') as m4,
         max(high) filter (measure = 'word_length') as m5, max(low) filter (measure = 'word_length') as m6 from fences group by all),
verdict as (
  select measured.*, not base_failed and coalesce(symbols <= m1 and marks <= m2 and dup_lines <= m3 and repeats <= m4
         and word_length <= m5 and word_length >= m6, true) as kept
  from measured left join bounds on lang is not distinct from b_lang and source is not distinct from b_source)
"""
OP7_SQL = f"""with {_COUNTS_SQL}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept from verdict"""

OP3_SQL = f"""
with items as (select item_id, {_WORDS} as w from benchmark),
item_grams as (
  select distinct item_id, least(len(w), 5) as width, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') as g
  from (select item_id, w, unnest(generate_series(1, len(w) - least(len(w), 5) + 1)) as i from items where len(w) > 0)),
sizes as (select item_id, count(*) as n_item from item_grams group by item_id),
docs as (select doc_id, {_WORDS} as w from documents),
doc_grams as (
  select distinct doc_id, width, array_to_string(w[i : i + width - 1], ' ') as g
  from (select doc_id, w, width, unnest(generate_series(1, len(w) - width + 1)) as i
        from docs, (select distinct width from item_grams) where len(w) >= width)),
shared as (select doc_id, item_id, count(*) as n_shared from doc_grams join item_grams using (width, g) group by doc_id, item_id)
select doc_id, item_id, n_shared, n_item, n_shared / n_item as containment
from shared join sizes using (item_id) where n_shared / n_item >= 0.8
"""

OP6_SQL = """
with said as (
  select conv_id, turn, role as speaker, coalesce(text, '') as text from conversations),
views as (select distinct conv_id as of_conv, speaker as perspective from said where speaker is distinct from 'system'),
seen as (
  select conv_id, perspective, turn, speaker, text, case when speaker is not distinct from perspective then 'assistant'
         when speaker = 'system' then 'system' else 'user' end as role
  from said join views on conv_id is not distinct from of_conv),
headed as (select *, '<|' || role || '|>' || (case when role = 'user' then coalesce(speaker, 'unknown') else '' end) || chr(10) as head from seen),
laid as (
  select *, case when role = 'user' then coalesce(speaker, 'unknown') end as name, head || text || chr(10) as segment,
         sum(length(head || text || chr(10))) over (partition by conv_id, perspective order by turn nulls first, speaker nulls first, head || text || chr(10)
           rows unbounded preceding)::bigint as seg_end from headed)
select conv_id, perspective, turn, role, name, segment, seg_end - length(segment) as seg_start, seg_end,
       case when role = 'assistant' then seg_end - length(segment) + length(head) else seg_end - length(segment) end as loss_start,
       case when role = 'assistant' then seg_end else seg_end - length(segment) end as loss_end
from laid
"""

OP11_SQL = """
with held as (select doc_id, coalesce(text, '') as t from documents),
numbered as (
  select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
         row_number() over (partition by t order by doc_id desc nulls last) as place, sha256(t) as text_sha256 from held)
select doc_id, keep_id, group_size, place = 1 as kept, text_sha256 from numbered
"""

OP12_SQL = """
with sound as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x) and abs(x) < 16384)) = len(embedding)),
scored as (
  select a.vec_id as anchor_id, c.vec_id as id, a.label = c.label as own, list_dot_product(a.v, c.v)::bigint as score
  from sound a join sound c on a.vec_id <> c.vec_id and len(a.v) = len(c.v) where a.vec_id % 100 = 0),
positives as (
  select anchor_id, id as positive_id, score as positive_score from scored where own
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
windows as (
  select anchor_id, positive_id, positive_score, id as negative_id, score as negative_score,
         row_number() over (partition by anchor_id, positive_id order by score desc, id) as rank
  from positives join scored using (anchor_id)
  where not own and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score from windows where rank <= 10
"""

QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_packing": (op1_packing, None),
    "op2_jaccard_join": (op2_jaccard_join, None),
    "op3_decontaminate": (op3_decontaminate, OP3_SQL),
    "op4_kneser_ney": (op4_kneser_ney, None),
    "op5_language": (op5_language, None),
    "op6_perspectives": (op6_perspectives, OP6_SQL),
    "op7_quality": (op7_quality, OP7_SQL),
    "op8_records": (op8_records, None),
    "op9_line_dedup": (op9_line_dedup, OP9_SQL),
    "op10_toxicity": (op10_toxicity, None),
    "op11_exact_dedup": (op11_exact_dedup, OP11_SQL),
    "op12_hard_negatives": (op12_hard_negatives, OP12_SQL),
    "op13_alignment": (op13_alignment, None),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
