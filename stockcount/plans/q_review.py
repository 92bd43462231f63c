"""Queries on the review loop and the absorption of reviewed crops."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stockcount.functions.numbers import decimals
from stockcount.operators import absorb, knn, review
from stockcount.plans.registry import query
from stockcount.scale import shared_dir
from stockcount.sources import stores, views
from stockcount.sources.tables import table


def _records(spark, sf):
    """Review records in their nested form, with the gaps the flattening has to fill."""
    top = (
        "named_struct('ean', {ean}, 'similitud', {sim}, 'descripcion', '')"
    )
    a = top.format(ean="concat('E', cast(idx % 40 as string))", sim="0.3D")
    b = top.format(ean="concat('E', cast(idx % 41 as string))", sim="0.2D")
    none = "cast(null as struct<ean: string, similitud: double, descripcion: string>)"
    return views.review(spark, sf).selectExpr(
        "idx",
        "run_id",
        "if(idx % 7 = 0, null, crop_id) as crop_id",
        "if(idx % 14 = 0, concat('id_', cast(idx as string)), null) as id",
        "concat('run-', cast(run_id as string)) as execution_id",
        f"named_struct('top_matches', if(idx % 3 = 0, array({a}), null), 'top1', if(idx % 5 = 0, {none}, {a}), "
        f"'top2', if(idx % 2 = 0, {b}, {none}), 'top3', {none}) as sku_identification",
        "if(idx % 11 = 0, null, decision) as decision",
        "if(idx % 10 = 0, 'PRED', null) as predicted_ean",
        "if(idx % 6 = 0, concat('otros/', cast(idx as string), '.jpg'), null) as crop_path",
        "named_struct('crop', if(idx % 4 = 0, concat('learning/x/', crop_id, '.jpg'), null)) as paths",
        "named_struct('status', if(status = 'pending', null, status), "
        "'assigned_ean', cast(assigned_ean as string)) as review",
    )


@query(
    """SELECT idx, CASE WHEN idx % 7 <> 0 THEN crop_id WHEN idx % 14 = 0 THEN 'id_' || idx::VARCHAR ELSE 'item_' || idx::VARCHAR END AS crop_id,
       CASE WHEN status IN ('labeled', 'skipped') THEN status WHEN idx % 11 = 0 THEN 'unknown' ELSE decision END AS status,
       CASE WHEN idx % 5 <> 0 THEN 'E' || (idx % 40)::VARCHAR WHEN idx % 10 = 0 THEN 'PRED' ELSE 'UNKNOWN' END AS predicted_ean,
       CASE WHEN idx % 3 = 0 THEN 1 ELSE (idx % 5 <> 0)::INTEGER + (idx % 2 = 0)::INTEGER END AS n_matches,
       CASE WHEN idx % 4 = 0 THEN 'learning/x/' || crop_id || '.jpg' WHEN idx % 6 = 0 THEN 'otros/' || idx::VARCHAR || '.jpg'
            ELSE 'learning/' || CASE WHEN idx % 11 = 0 THEN 'unknown' ELSE decision END || '/'
                 || CASE WHEN idx % 7 <> 0 THEN crop_id WHEN idx % 14 = 0 THEN 'id_' || idx::VARCHAR ELSE 'item_' || idx::VARCHAR END || '.jpg'
            END AS crop_path
FROM fx_review"""
)
def review_items(spark, sf):
    flat = review.review_items(_records(spark, sf))
    return flat.withColumn("n_matches", F.size("top_matches")).drop("top_matches")


@query(
    """SELECT CASE WHEN idx % 7 <> 0 THEN crop_id END AS crop_id, 'run-' || run_id::VARCHAR AS execution_id,
       CASE WHEN idx % 11 <> 0 THEN decision END AS decision, nullif(status, 'pending') AS status, assigned_ean::VARCHAR AS assigned_ean
FROM fx_review WHERE idx % 17 <> 0 AND idx % 19 <> 0"""
)
def review_parse(spark, sf):
    json = F.to_json(F.struct("crop_id", "execution_id", "sku_identification", "decision", "paths", "review"))
    lines = (
        _records(spark, sf)
        .withColumn("json", json)
        .select(
            F.when(F.col("idx") % 17 == 0, F.expr("left(json, length(json) - 3)"))
            .when(F.col("idx") % 19 == 0, F.lit("  "))
            .otherwise(F.col("json"))
            .alias("value")
        )
    )
    parsed = stores.parse_review_lines(lines).select("record.*")
    return parsed.select(
        "crop_id",
        "execution_id",
        "decision",
        F.col("review.status").alias("status"),
        F.col("review.assigned_ean").alias("assigned_ean"),
    )


@query("SELECT idx, run_id, crop_id FROM fx_review WHERE status = 'pending' AND decision = 'unknown'")
def review_pending(spark, sf):
    return review.pending(views.review(spark, sf), "unknown").select("idx", "run_id", "crop_id")


@query(
    """SELECT run_id, count(*)::BIGINT AS total, count_if(status = 'labeled')::BIGINT AS labeled,
       count_if(status = 'skipped')::BIGINT AS skipped, count_if(status NOT IN ('labeled', 'skipped'))::BIGINT AS pending
FROM fx_review GROUP BY 1"""
)
def review_progress(spark, sf):
    return review.progress(views.review(spark, sf))


@query(
    """SELECT run_id, count(*)::BIGINT AS total_crops_saved, count_if(decision = 'unknown')::BIGINT AS unknown_count,
       count_if(decision = 'ambiguous')::BIGINT AS ambiguous_count FROM fx_review GROUP BY 1"""
)
def review_run_summary(spark, sf):
    return review.run_summary(views.review(spark, sf))


@query(
    """WITH pos AS (SELECT run_id, max(idx) // 2 AS actual FROM fx_review GROUP BY 1),
o AS (SELECT r.run_id, r.idx, r.idx <= pos.actual AS w FROM fx_review r JOIN pos USING (run_id) WHERE status NOT IN ('labeled', 'skipped')),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY w, idx) AS rn FROM o)
SELECT run_id, idx AS siguiente, w AS desde_inicio FROM n WHERE rn = 1"""
)
def review_next(spark, sf):
    records = views.review(spark, sf)
    positions = records.groupBy("run_id").agg(F.expr("max(idx) div 2").alias("actual"))
    return review.next_pending(records, positions)


def _queue(spark, sf):
    return views.review(spark, sf).select(
        F.col("idx").alias("id"), "run_id", (F.col("status") != "pending").alias("revisado"),
        (F.col("idx") % 97).alias("fecha_creacion"),
    )


@query(
    """SELECT idx AS id, run_id, false AS revisado, idx % 97 AS fecha_creacion FROM fx_review WHERE status = 'pending'
ORDER BY idx % 97 DESC, idx DESC LIMIT 50"""
)
def review_latest(spark, sf):
    return review.latest_pending(_queue(spark, sf))


@query("SELECT idx AS id, run_id, status <> 'pending' OR idx IN (SELECT doc_id FROM labels) AS revisado FROM fx_review")
def review_mark(spark, sf):
    done = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return review.mark_reviewed(_queue(spark, sf), done).select("id", "run_id", "revisado")


def _actions(spark, sf):
    """Edits for every third item, two for every ninth: the later one must win."""
    base = views.review(spark, sf).filter("idx % 3 = 0")
    first = base.selectExpr("crop_id", "1 as at", "if(idx % 2 = 0, 'set_ean', 'skip') as action", "cast(idx % 50 as string) as ean")
    second = base.filter("idx % 9 = 0").selectExpr(
        "crop_id", "2 as at", "if(idx % 4 = 0, 'discard', 'set_ean') as action", "'999' as ean"
    )
    return first.unionByName(second)


@query(
    """WITH a AS (
  SELECT *, CASE WHEN idx % 9 = 0 THEN CASE WHEN idx % 4 = 0 THEN 'discard' ELSE 'set_ean' END
                 WHEN idx % 3 = 0 THEN CASE WHEN idx % 2 = 0 THEN 'set_ean' ELSE 'skip' END END AS action FROM fx_review)
SELECT crop_id, decision, CASE action WHEN 'set_ean' THEN 'labeled' WHEN 'skip' THEN 'skipped' WHEN 'discard' THEN 'discarded' ELSE status END AS status,
       CASE WHEN action = 'discard' THEN 'DESCARTED' WHEN action = 'set_ean' AND idx % 9 = 0 THEN '999'
            WHEN action = 'set_ean' THEN (idx % 50)::VARCHAR ELSE assigned_ean::VARCHAR END AS assigned_ean,
       CASE WHEN idx % 9 = 0 THEN 2 WHEN idx % 3 = 0 THEN 1 END AS reviewed_at
FROM a"""
)
def review_apply(spark, sf):
    records = views.review(spark, sf).select(
        "crop_id", "decision", "status", F.col("assigned_ean").cast("string").alias("assigned_ean")
    )
    return review.apply_actions(records, _actions(spark, sf))


@query("SELECT idx, run_id, crop_id, assigned_ean FROM fx_review WHERE status = 'labeled' AND assigned_ean IS NOT NULL")
def absorb_candidates(spark, sf):
    return absorb.candidates(views.review(spark, sf)).select("idx", "run_id", "crop_id", "assigned_ean")


@query("SELECT crop_id, assigned_ean AS ean FROM fx_review WHERE status = 'labeled' AND assigned_ean IN (SELECT ean FROM fx_products WHERE activo)")
def absorb_valid_ean(spark, sf):
    crops = absorb.candidates(views.review(spark, sf)).select("crop_id", F.col("assigned_ean").alias("ean"))
    valid = views.products(spark, sf).filter("activo").select("ean")
    return absorb.known_codes(crops, valid)


_CROPS_SQL = """WITH crops AS (
  SELECT crop_id, 'EAN' || lpad((label % 8)::VARCHAR, 3, '0') AS ean, q.embedding FROM fx_query q JOIN embeddings e ON vec_id = crop_id
  UNION ALL SELECT ref_id + 1000000, ean, embedding FROM fx_catalog_ref)
"""


def _crops(spark, sf):
    """Crops to absorb: the query crops under their label and copies of the references."""
    own = table(spark, sf, "embeddings").selectExpr(
        "vec_id as crop_id", "concat('EAN', lpad(cast(label % 8 as string), 3, '0')) as ean", f"{views.OCCLUDED} as embedding"
    )
    copies = views.catalog_refs(spark, sf).selectExpr(
        "ref_id + 1000000 as crop_id", "ean", "embedding"
    )
    return own.unionByName(copies)


@query(
    _CROPS_SQL
    + """, s AS (
  SELECT c.crop_id, max(list_cosine_similarity(c.embedding::DOUBLE[], r.embedding::DOUBLE[])) AS m
  FROM crops c JOIN fx_catalog_ref r ON r.ean = c.ean GROUP BY 1)
SELECT c.crop_id, c.ean, round(coalesce(s.m, -1.0::DOUBLE), 6) AS max_sim, coalesce(s.m, -1.0) >= 0.95 AS duplicado
FROM crops c LEFT JOIN s USING (crop_id)"""
)
def absorb_dedup_existing(spark, sf):
    verdicts = absorb.near_existing(_crops(spark, sf), views.catalog_refs(spark, sf))
    return verdicts.select("crop_id", "ean", decimals("max_sim", 6).alias("max_sim"), "duplicado")


def _greedy_sql(source: str) -> str:
    """CTEs ending in won(crop_id): of ``source`` (crop_id, ean, seq, v, max_sim) what is kept, one after the other."""
    return f"""f AS (SELECT *, row_number() OVER (PARTITION BY ean ORDER BY seq) AS r FROM {source} WHERE coalesce(max_sim, -1) < 0.95),
g AS (
  SELECT DISTINCT ean, 0::BIGINT AS r, []::STRUCT(id BIGINT, v DOUBLE[])[] AS kept FROM f
  UNION ALL
  SELECT g.ean, f.r, CASE WHEN len(list_filter(g.kept, lambda k: list_cosine_similarity(k.v, f.v) >= 0.95)) = 0
    THEN list_append(g.kept, {{'id': f.crop_id, 'v': f.v}}) ELSE g.kept END
  FROM g JOIN f ON f.ean = g.ean AND f.r = g.r + 1),
won AS (
  SELECT unnest(list_transform(kept, lambda k: k.id)) AS crop_id FROM (
    SELECT kept FROM g QUALIFY row_number() OVER (PARTITION BY ean ORDER BY r DESC) = 1))"""


@query(
    _CROPS_SQL.replace("WITH ", "WITH RECURSIVE ")
    + """, offered AS (
  SELECT crop_id, ean, embedding::DOUBLE[] AS v FROM crops UNION ALL SELECT crop_id + 5000000, ean, embedding::DOUBLE[] FROM crops),
near AS (SELECT o.crop_id, max(list_cosine_similarity(v, r.embedding::DOUBLE[])) AS m FROM offered o JOIN fx_catalog_ref r USING (ean) GROUP BY 1),
measured AS (SELECT o.crop_id, o.ean, o.crop_id AS seq, o.v, m AS max_sim FROM offered o LEFT JOIN near USING (crop_id)), """
    + _greedy_sql("measured")
    + " SELECT crop_id FROM won"
)
def absorb_dedup_greedy(spark, sf):
    crops = _crops(spark, sf)
    twice = crops.unionByName(crops.withColumn("crop_id", F.col("crop_id") + 5_000_000))
    return absorb.dedup_greedy(twice.withColumn("seq", F.col("crop_id")), views.catalog_refs(spark, sf))


def _labelled_crops(spark, sf):
    """Labelled review crops with a vector: that of the document's number, counted round the embeddings."""
    vectors = table(spark, sf, "embeddings").selectExpr("vec_id as k", "embedding")
    n = max(1, vectors.count())
    crops = absorb.candidates(views.review(spark, sf)).selectExpr(
        "idx as crop_id", "cast(assigned_ean as string) as ean", "idx as seq", "idx % 13 <> 0 as existe", f"idx % {n} as k"
    )
    return crops.join(vectors, "k").drop("k").withColumn(
        "embedding", F.when(F.col("crop_id") % 29 != 0, F.col("embedding"))
    )


def _numeric_refs(spark, sf):
    return (
        table(spark, sf, "embeddings")
        .selectExpr("vec_id as ref_id", "cast(label as string) as ean", "embedding", "'sin' as categoria")
    )


def _valid(spark, sf):
    return views.products(spark, sf).filter("activo").selectExpr("cast(ean as string) as ean")


_OUTCOMES_SQL = (
    """WITH RECURSIVE c AS (
  SELECT idx AS crop_id, assigned_ean::VARCHAR AS ean, idx AS seq, idx % 13 <> 0 AS existe,
         CASE WHEN idx % 29 <> 0 THEN embedding::DOUBLE[] END AS v, assigned_ean IN (SELECT ean FROM fx_products WHERE activo) AS valido
  FROM fx_review JOIN embeddings ON vec_id = idx % (SELECT count(*) FROM embeddings)
  WHERE status = 'labeled' AND assigned_ean IS NOT NULL),
near AS (
  SELECT crop_id, max(list_cosine_similarity(v, e.embedding::DOUBLE[])) AS m FROM c JOIN embeddings e ON e.label::VARCHAR = c.ean
  WHERE v IS NOT NULL GROUP BY 1),
measured AS (SELECT crop_id, ean, seq, v, m AS max_sim FROM c LEFT JOIN near USING (crop_id) WHERE valido AND existe AND v IS NOT NULL), """
    + _greedy_sql("measured")
    + f""", outcome AS (
  SELECT crop_id, ean, seq, v, CASE WHEN NOT valido THEN '{absorb.INVALID}' WHEN NOT existe THEN '{absorb.MISSING}'
         WHEN v IS NULL OR crop_id IN (SELECT crop_id FROM won) THEN '{absorb.COPIED}' ELSE '{absorb.DUPLICATE}' END AS resultado FROM c)
"""
)


@query(_OUTCOMES_SQL + "SELECT crop_id, ean, seq, resultado FROM outcome")
def absorb_outcomes(spark, sf):
    return absorb.outcomes(_labelled_crops(spark, sf), _numeric_refs(spark, sf), _valid(spark, sf))


@query(
    _OUTCOMES_SQL
    + f"""SELECT count_if(resultado = '{absorb.COPIED}')::BIGINT AS copiados,
       count_if(resultado IN ('{absorb.INVALID}', '{absorb.MISSING}'))::BIGINT AS errores,
       count_if(resultado = '{absorb.DUPLICATE}')::BIGINT AS dedup_skipped, count_if(resultado = '{absorb.INVALID}')::BIGINT AS invalid_ean FROM outcome"""
)
def absorb_summary(spark, sf):
    return absorb.summary(absorb_outcomes(spark, sf))


@query(
    """WITH c AS (
  SELECT idx, run_id, assigned_ean AS ean, 'frame_' || (idx % 30)::VARCHAR AS base FROM fx_review WHERE status = 'labeled' AND assigned_ean IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY ean, base ORDER BY idx) AS n FROM c)
SELECT idx AS seq, ean, base AS crop_id, replace(base, '_', '-')
       || list_aggregate(list_transform(range(1, n), lambda j: '_abs' || j::VARCHAR) || [''], 'string_agg', '') || '.jpg' AS destino
FROM n"""
)
def absorb_target_names(spark, sf):
    crops = absorb.candidates(views.review(spark, sf)).selectExpr(
        "idx as seq", "assigned_ean as ean", "concat('frame_', cast(idx % 30 as string)) as crop_id"
    )
    return absorb.target_names(crops)


@query(
    _OUTCOMES_SQL
    + f""", info AS (SELECT ean::VARCHAR AS ean, packaging_type_id AS categoria, descripcion FROM fx_products),
copied AS (SELECT * FROM outcome WHERE resultado = '{absorb.COPIED}')
SELECT label::VARCHAR AS ean, vec_id::VARCHAR AS ref_id, coalesce(i.categoria, 'sin') AS categoria, i.descripcion
FROM embeddings LEFT JOIN (SELECT * FROM info WHERE ean IN (SELECT ean FROM copied)) i ON i.ean = label::VARCHAR
UNION ALL SELECT c.ean, 'crop-' || crop_id::VARCHAR, i.categoria, i.descripcion FROM copied c LEFT JOIN info i ON i.ean = c.ean WHERE v IS NOT NULL"""
)
def absorb_apply(spark, sf):
    info = views.products(spark, sf).selectExpr(
        "cast(ean as string) as ean", "packaging_type_id as categoria", "descripcion"
    )
    refs, _ = absorb.apply(_labelled_crops(spark, sf), _numeric_refs(spark, sf), info, _valid(spark, sf))
    return knn.usable(refs, 64).select("ean", "ref_id", "categoria", "descripcion")


@query(
    """SELECT CASE WHEN idx % 7 <> 0 THEN crop_id END AS crop_id, 'run-' || run_id::VARCHAR AS execution_id,
       CASE WHEN idx % 11 <> 0 THEN decision END AS decision, nullif(status, 'pending') AS status, assigned_ean::VARCHAR AS assigned_ean
FROM fx_review"""
)
def review_log_roundtrip(spark, sf):
    """Records appended to the log in two deliveries, a folder for each run, and read back."""
    records = _records(spark, sf).select("crop_id", "execution_id", "sku_identification", "decision", "paths", "review", "idx")
    place = f"{shared_dir(spark)}/review-{uuid.uuid4().hex}"
    for half in (0, 1):
        stores.append_review_log(records.filter(F.col("idx") % 2 == half).drop("idx"), place)
    return stores.read_review_log(spark, place).select(
        "crop_id", "execution_id", "decision", F.col("review.status").alias("status"), F.col("review.assigned_ean").alias("assigned_ean")
    )
