"""Queries on runs, their items and video metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stockcount.functions.numbers import decimals
from stockcount.operators import inventory, running, runs, video
from stockcount.plans.registry import query
from stockcount.scale import shared_dir
from stockcount.sources import snapshots, stores, views


@query(
    """SELECT id, video_nombre || ['.mp4', '.MOV', '.txt', '.avi', ''][id % 5 + 1] AS video_file, fecha
FROM fx_runs WHERE id % 5 NOT IN (2, 4)"""
)
def run_list(spark, sf):
    files = views.runs(spark, sf).selectExpr(
        "id",
        "concat(video_nombre, element_at(array('.mp4','.MOV','.txt','.avi',''), cast(id % 5 as int) + 1)) as video_file",
        "fecha",
    )
    return runs.list_videos(files).orderBy(F.desc("fecha"), F.desc("id"))


@query("SELECT id, video_nombre, fecha, frames_procesados FROM fx_runs ORDER BY fecha DESC, id DESC LIMIT 20")
def runs_latest(spark, sf):
    return runs.latest(views.runs(spark, sf))


@query(
    """SELECT video_nombre, id, fecha FROM (
  SELECT *, row_number() OVER (PARTITION BY video_nombre ORDER BY fecha DESC, id DESC) AS rn FROM fx_runs) WHERE rn = 1"""
)
def run_latest_per_video(spark, sf):
    return runs.latest_per_video(views.runs(spark, sf))


@query(
    """SELECT r.id, r.video_nombre, r.fecha, r.frames_procesados, count(i.ean)::BIGINT AS productos_distintos,
       sum(i.cantidad_dedup)::BIGINT AS total_unidades_dedup
FROM fx_runs r LEFT JOIN fx_run_items i ON i.ejecucion_id = r.id GROUP BY 1, 2, 3, 4"""
)
def run_history(spark, sf):
    return runs.history(views.runs(spark, sf), views.run_items(spark, sf))


_STATS_SQL = """WITH e AS (SELECT p_partkey AS ean FROM part UNION ALL SELECT max(p_partkey) + 1 FROM part)
SELECT e.ean, count(i.ean)::BIGINT AS veces_detectado, printf('%.1f', avg(i.cantidad_dedup))::DOUBLE AS promedio_unidades,
       max(i.cantidad_dedup) AS max_unidades, min(i.cantidad_dedup) AS min_unidades,
       printf('%.4f', sum(i.confianza_promedio::DECIMAL(18, 6))::DOUBLE / count(i.ean))::DOUBLE AS confianza_media
FROM e LEFT JOIN fx_run_items i ON i.ean = e.ean GROUP BY 1"""


def _asked(spark, sf):
    """All products and one that was never detected."""
    known = views.products(spark, sf).select("ean")
    return known.unionByName(known.agg((F.max("ean") + 1).alias("ean")))


@query(_STATS_SQL)
def sku_stats(spark, sf):
    return runs.sku_stats(_asked(spark, sf), views.run_items(spark, sf))


@query(_STATS_SQL)
def sku_stats_incremental(spark, sf):
    """The same after three deliveries, the last of them with wrong items that are withdrawn again, kept as snapshots."""
    items = views.run_items(spark, sf)
    wrong = items.filter(F.col("ejecucion_id") % 5 == 0).withColumns({"cantidad_dedup": F.col("cantidad_dedup") * 3 - 60, "confianza_promedio": F.lit(0.5).cast("double")})
    stored = snapshots.SnapshotTable(spark, f"{shared_dir(spark)}/stats-{uuid.uuid4().hex}")
    for n in range(3):
        delivery = items.filter(F.col("ejecucion_id") % 3 == n)
        state = running.partials(delivery.unionByName(wrong) if n == 2 else delivery)
        before = stored.read()
        stored.overwrite(state if before is None else running.merged(before, state))
    stored.overwrite(running.retracted(stored.read(), wrong, items))
    return running.stats_of(stored.read(), _asked(spark, sf))


@query(
    """SELECT i.ejecucion_id, i.ean, p.descripcion, p.packaging_type_id AS packaging_type, i.cantidad_dedup, i.cantidad_raw,
       i.confianza_promedio, i.tracking_id
FROM fx_run_items i JOIN fx_products p ON p.ean = i.ean"""
)
def run_detail(spark, sf):
    return runs.detail(views.run_items(spark, sf), views.products(spark, sf))


@query(
    """WITH r AS (SELECT max(ejecucion_id) AS id FROM fx_run_items)
SELECT id, video_nombre, (row_number() OVER (ORDER BY cantidad_dedup DESC, i.ean) - 1)::INTEGER AS pos, i.ean, p.descripcion, i.cantidad_dedup, i.cantidad_raw
FROM fx_run_items i JOIN r ON ejecucion_id = id JOIN fx_runs USING (id) JOIN fx_products p ON p.ean = i.ean"""
)
def run_detail_nested(spark, sf):
    """The items nested in the latest run that has any, in their order."""
    items = views.run_items(spark, sf)
    last = items.agg(F.max("ejecucion_id").alias("id")).first()["id"]
    nested = runs.run_detail(last, views.runs(spark, sf), items, views.products(spark, sf))
    flat = nested.select("id", "video_nombre", F.posexplode("detecciones").alias("pos", "d"))
    return flat.select("id", "video_nombre", "pos", "d.ean", "d.descripcion", "d.cantidad_dedup", "d.cantidad_raw")


@query(
    """WITH u AS (SELECT ean, sum(cantidad_dedup)::BIGINT AS cantidad FROM fx_run_items GROUP BY 1)
SELECT u.ean, u.cantidad, coalesce(p.descripcion, '') AS nombre
FROM u LEFT JOIN (SELECT * FROM fx_products WHERE activo) p ON p.ean = u.ean"""
)
def inventory_named(spark, sf):
    units = views.run_items(spark, sf).groupBy("ean").agg(F.sum("cantidad_dedup").alias("cantidad"))
    return inventory.name_products(units, views.products(spark, sf).filter("activo"))


@query(
    """WITH d AS (SELECT video_id, frame_idx, sku_pred AS ean, conf FROM fx_detections WHERE sku_pred <> 'UNKNOWN'),
last AS (SELECT max(id) AS m FROM fx_runs),
v AS (SELECT video_id, row_number() OVER (ORDER BY video_id) + (SELECT m FROM last) AS id FROM (SELECT DISTINCT video_id FROM fx_frames)),
f AS (SELECT video_id, ean, max(n) AS n FROM (SELECT video_id, ean, frame_idx, count(*)::BIGINT AS n FROM d GROUP BY 1, 2, 3) GROUP BY 1, 2),
t AS (SELECT video_id, ean, count(*)::BIGINT AS raw, sum(conf::DECIMAL(18, 6))::DOUBLE / count(*) AS m FROM d GROUP BY 1, 2)
SELECT v.id AS ejecucion_id, f.ean, f.n AS cantidad_dedup, t.raw AS cantidad_raw, printf('%.4f', t.m)::DOUBLE AS confianza_promedio
FROM f JOIN t USING (video_id, ean) JOIN v USING (video_id)"""
)
def run_register(spark, sf):
    boxes = views.detections(spark, sf).withColumnRenamed("sku_pred", "ean")
    _, items = runs.register_runs(boxes, views.frames(spark, sf), views.runs(spark, sf), F.lit("2024-02-01"))
    return items


@query(
    """WITH d AS (SELECT *, sku_pred AS ean FROM fx_detections)
SELECT (SELECT max(id) FROM fx_runs) + row_number() OVER (ORDER BY f.video_id) AS id, f.video_id, '2024-02-01' AS fecha,
       f.n AS frames_procesados, coalesce(x.fp, 0) AS frames_con_producto, coalesce(x.n, 0) AS total_detecciones,
       coalesce(x.s, 0) AS skus_identificados
FROM (SELECT video_id, count(*)::BIGINT AS n FROM fx_frames GROUP BY 1) f
LEFT JOIN (SELECT video_id, count(DISTINCT frame_idx)::BIGINT AS fp, count(*)::BIGINT AS n,
                  count(DISTINCT nullif(ean, 'UNKNOWN'))::BIGINT AS s FROM d GROUP BY 1) x USING (video_id)"""
)
def run_register_rows(spark, sf):
    boxes = views.detections(spark, sf).withColumnRenamed("sku_pred", "ean")
    rows, _ = runs.register_runs(boxes, views.frames(spark, sf), views.runs(spark, sf), F.lit("2024-02-01"))
    return rows


METRICS_SQL = """WITH m AS (
  SELECT run_id, run_id % 5 AS serie, printf('%.4f', 100.0::DOUBLE * count_if(decision = 'unknown') / count(*))::DOUBLE AS unknown_pct,
         printf('%.4f', 100.0::DOUBLE * count_if(decision = 'ambiguous') / count(*))::DOUBLE AS ambiguous_pct FROM fx_review GROUP BY 1)
SELECT run_id, serie, unknown_pct, ambiguous_pct,
       printf('%.4f', unknown_pct - lag(unknown_pct) OVER (PARTITION BY serie ORDER BY run_id))::DOUBLE AS delta_unknown_pct,
       printf('%.4f', ambiguous_pct - lag(ambiguous_pct) OVER (PARTITION BY serie ORDER BY run_id))::DOUBLE AS delta_ambiguous_pct
FROM m"""


@query(METRICS_SQL)
def metrics_trend(spark, sf):
    total = F.count(F.lit(1))
    share = lambda cond: decimals(100.0 * F.count_if(cond) / total, 4)
    metrics = views.review(spark, sf).groupBy("run_id").agg(
        share(F.col("decision") == "unknown").alias("unknown_pct"), share(F.col("decision") == "ambiguous").alias("ambiguous_pct")
    )
    series = metrics.withColumn("serie", F.col("run_id") % 5)
    return runs.metrics_trend(series, "serie", "run_id", ["unknown_pct", "ambiguous_pct"])


@query(
    """WITH n AS (SELECT video_id, max(idx) + 1 AS n FROM fx_frame_metrics GROUP BY 1),
p AS (SELECT video_id, unnest([0, n // 4, n // 2, 3 * n // 4, n - 1]) AS idx FROM n),
m AS (
  SELECT video_id, avg(brightness)::DOUBLE AS b, avg(contrast)::DOUBLE AS c, avg(sharpness)::DOUBLE AS s, max(width) AS w, max(height) AS h
  FROM p JOIN fx_frame_metrics USING (video_id, idx) GROUP BY 1)
SELECT video_id, round(b, 6) AS brillo, round(c, 6) AS contraste, round(s, 6) AS nitidez,
       CASE WHEN b < 100 THEN 'bajo' WHEN b > 200 THEN 'alto' ELSE 'adecuado' END AS luz, c < 30 AS contraste_bajo,
       s < 100 AS borroso, CASE WHEN h > w THEN 'vertical' ELSE 'horizontal' END AS orientacion
FROM m"""
)
def video_quality(spark, sf):
    out = video.video_quality(views.frame_metrics(spark, sf))
    return out.withColumns({c: decimals(c, 6) for c in ("brillo", "contraste", "nitidez")})


@query(
    """WITH v AS (SELECT *, CASE WHEN video_id % 3 = 0 THEN 0.0 WHEN video_id % 3 = 1 THEN 2.5 ELSE 25.0 END::DOUBLE AS r FROM fx_frames),
s AS (SELECT *, CASE WHEN r = 0 THEN 30 WHEN r = 2.5 THEN 2 ELSE 25 END AS step, CASE WHEN r = 0 THEN 30.0 ELSE r END::DOUBLE AS f FROM v)
SELECT video_id, frame_idx, (frame_idx // step) AS out_idx, round(frame_idx / f, 6) AS t_sec FROM s WHERE frame_idx % step = 0"""
)
def frame_sample(spark, sf):
    frames = views.frames(spark, sf).withColumn(
        "fps", F.expr("case video_id % 3 when 0 then 0.0D when 1 then 2.5D else 25.0D end")
    )
    out = video.sample_frames(frames, 1.0)
    return out.select("video_id", "frame_idx", "out_idx", decimals("t_sec", 6).alias("t_sec"))


@query(
    """WITH k AS (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY idx) - 1 AS n FROM fx_frame_metrics
  WHERE idx % 2 = 0 AND sharpness >= 100)
SELECT video_id, idx, printf('frame_%04d_t%.2fs.jpg', n, idx / 2.5::DOUBLE) AS archivo FROM k"""
)
def frame_export_list(spark, sf):
    frames = views.frame_metrics(spark, sf).withColumn("fps", F.lit(2.5))
    return video.export_list(frames, 1.0).select("video_id", "idx", "archivo")


@query(
    METRICS_SQL.split("SELECT run_id, serie, unknown_pct")[0]
    + "SELECT 'run-' || run_id::VARCHAR AS execution_id, 'video-' || serie::VARCHAR AS video_name, unknown_pct, ambiguous_pct FROM m"
)
def metrics_history(spark, sf):
    """Metrics appended to the history in two deliveries and read back."""
    trend = metrics_trend(spark, sf)
    rows = trend.selectExpr(
        "'2024-01-01T00:00:00' as timestamp", "concat('run-', cast(run_id as string)) as execution_id", "concat('video-', cast(serie as string)) as video_name",
        "map('unknown_pct', unknown_pct, 'ambiguous_pct', ambiguous_pct) as metrics", "run_id",
    )
    place = f"{shared_dir(spark)}/metrics-{uuid.uuid4().hex}"
    for half in (0, 1):
        stores.append_metrics(rows.filter(F.col("run_id") % 2 == half).drop("run_id"), f"{place}/history", f"{place}/runs")
    read = stores.read_metrics(spark, f"{place}/history")
    return read.select("execution_id", "video_name", F.col("metrics")["unknown_pct"].alias("unknown_pct"), F.col("metrics")["ambiguous_pct"].alias("ambiguous_pct"))
