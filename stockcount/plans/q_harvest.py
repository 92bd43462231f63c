"""Queries on harvested reference images."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stockcount.operators import harvest
from stockcount.plans.registry import query
from stockcount.sources import views
from stockcount.sources.tables import table

# The test pages hold no image links; list links come first and all links are the fallback.
_LIST_LINK = '<li><a href="([^"]*)"'
_ANY_LINK = 'href="([^"]*)"'


@query(
    """WITH f AS (
  SELECT page_id, list_filter(regexp_extract_all(html, '<li><a href="([^"]*)"', 1), lambda u: starts_with(u, '/')) AS a,
         list_filter(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda u: starts_with(u, '/')) AS b FROM pages),
u AS (SELECT page_id, len(a) >= 80 AS whole, CASE WHEN len(a) >= 80 THEN a[1:80] ELSE list_concat(a, b)[1:80] END AS urls FROM f),
x AS (SELECT page_id, whole, unnest(urls) AS url, generate_subscripts(urls, 1) AS i FROM u),
d AS (SELECT page_id, url, min(i) AS i FROM x WHERE NOT whole GROUP BY 1, 2 UNION ALL SELECT page_id, url, i FROM x WHERE whole)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INTEGER AS pos, url FROM d"""
)
def page_candidate_urls(spark, sf):
    return harvest.candidate_urls(table(spark, sf, "pages"), _LIST_LINK, _ANY_LINK, scheme="/")


_CHECK_SQL = """WITH checked AS (
  SELECT *, CASE WHEN NOT contains(content_type, 'image/') THEN 'content_type_not_image' WHEN bytes < 50000 THEN 'too_small_bytes'
                 WHEN width IS NULL THEN 'ok_no_dims' WHEN width < 300 OR height < 300 THEN 'too_small_resolution' ELSE 'ok' END AS motivo
  FROM fx_images)
"""


@query(_CHECK_SQL + "SELECT seq, ean, motivo, motivo LIKE 'ok%' AS valida FROM checked")
def image_validate(spark, sf):
    return harvest.validated(views.images(spark, sf)).select("seq", "ean", "motivo", "valida")


@query(
    """SELECT sha256, ean, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY ean, seq) AS rn FROM fx_images) WHERE rn = 1"""
)
def image_hash_dedup(spark, sf):
    return harvest.unique_content(views.images(spark, sf)).select("sha256", "ean", "seq")


def _rounds_sql(rounds: int, cap: int) -> str:
    """Claims and refusals written out; rounds after the last refusal change nothing."""
    out = ["c0 AS (SELECT ean, sha256, min(seq) AS seq FROM checked WHERE motivo LIKE 'ok%' GROUP BY 1, 2)"]
    for i in range(rounds):
        out.append(
            f"w{i} AS (SELECT *, row_number() OVER (PARTITION BY ean ORDER BY seq) AS n FROM c{i} QUALIFY n <= {cap}), "
            f"o{i} AS (SELECT sha256, min(ean) AS owner FROM w{i} GROUP BY 1), "
            f"c{i + 1} AS (SELECT c.* FROM c{i} c ANTI JOIN (SELECT w.ean, w.sha256 FROM w{i} w JOIN o{i} o USING (sha256) "
            "WHERE w.ean <> o.owner) r ON r.ean = c.ean AND r.sha256 = c.sha256)"
        )
    out.append(f"chosen AS (SELECT *, row_number() OVER (PARTITION BY ean ORDER BY seq) AS n FROM c{rounds} QUALIFY n <= {cap})")
    return ", " + ",\n".join(out)


_HARVEST_SQL = (
    _CHECK_SQL
    + _rounds_sql(6, 10)
    + """, ends AS (SELECT ean, count(*)::BIGINT AS g, max(seq) AS last FROM chosen GROUP BY 1),
tried AS (SELECT c.*, e.g, coalesce(e.g, 0) < 10 OR c.seq <= e.last AS intentada FROM checked c LEFT JOIN ends e USING (ean))
"""
)


@query(
    _HARVEST_SQL
    + """SELECT c.ean, c.seq, c.sha256, printf('%s__%03d.', c.ean::VARCHAR, h.n) || CASE split_part(content_type, ';', 1)
       WHEN 'image/png' THEN 'png' WHEN 'image/webp' THEN 'webp' ELSE 'jpg' END AS archivo
FROM checked c JOIN chosen h USING (ean, seq)"""
)
def image_harvest(spark, sf):
    saved, _, _ = harvest.harvest(views.images(spark, sf))
    return saved.select("ean", "seq", "sha256", "archivo")


@query(
    _HARVEST_SQL
    + """SELECT ean, coalesce(max(g), 0) AS guardadas, count_if(intentada)::BIGINT AS intentadas, count(*)::BIGINT AS candidatas
FROM tried GROUP BY 1"""
)
def image_harvest_stats(spark, sf):
    _, _, counters = harvest.harvest(views.images(spark, sf))
    return counters


@query(
    _HARVEST_SQL
    + "SELECT 'validate' AS etapa, motivo, count(*)::BIGINT AS n FROM tried WHERE intentada AND motivo NOT LIKE 'ok%' GROUP BY 2"
)
def image_rejects(spark, sf):
    _, rejected, _ = harvest.harvest(views.images(spark, sf))
    return rejected.groupBy("etapa", "motivo").agg(F.count(F.lit(1)).alias("n"))


# Every thirteenth image could not be downloaded, every ninth of the others not be written.
_STAGES_SQL = (
    """WITH given AS (
  SELECT *, seq % 13 = 0 AS lost, CASE WHEN seq % 9 = 0 THEN 'disk full' END AS save_error FROM fx_images),
looked AS (
  SELECT *, CASE WHEN lost THEN 'download_failed' WHEN NOT contains(content_type, 'image/') THEN 'content_type_not_image'
                 WHEN bytes < 50000 THEN 'too_small_bytes' WHEN width IS NULL THEN 'ok_no_dims'
                 WHEN width < 300 OR height < 300 THEN 'too_small_resolution' ELSE 'ok' END AS verdict FROM given),
checked AS (SELECT *, CASE WHEN save_error IS NULL THEN verdict ELSE 'unsaved' END AS motivo FROM looked)
"""
    + _rounds_sql(6, 10)
    + """, ends AS (SELECT ean, count(*)::BIGINT AS g, max(seq) AS last FROM chosen GROUP BY 1),
tried AS (SELECT c.*, coalesce(e.g, 0) < 10 OR c.seq <= e.last AS intentada FROM checked c LEFT JOIN ends e USING (ean)),
kept AS (SELECT sha256, ean AS by_ean, seq AS by_seq FROM chosen),
rejected AS (
  SELECT CASE WHEN lost THEN 'download' ELSE 'validate' END AS etapa, verdict AS motivo FROM tried WHERE intentada AND verdict NOT LIKE 'ok%'
  UNION ALL SELECT 'save', save_error FROM tried LEFT JOIN kept USING (sha256)
  WHERE intentada AND verdict LIKE 'ok%' AND save_error IS NOT NULL AND (by_ean IS NULL OR (ean, seq) < (by_ean, by_seq)))
SELECT etapa, motivo, count(*)::BIGINT AS n FROM rejected GROUP BY 1, 2"""
)


@query(_STAGES_SQL)
def image_rejects_by_stage(spark, sf):
    images = views.images(spark, sf)
    lost = F.col("seq") % 13 == 0
    given = images.withColumn("sha256", F.when(~lost, F.col("sha256"))).withColumn("save_error", F.when(F.col("seq") % 9 == 0, F.lit("disk full")))
    _, rejected, _ = harvest.harvest(given)
    return rejected.groupBy("etapa", "motivo").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT ean, seq, row_number() OVER (PARTITION BY ean ORDER BY sha256(url || '|7'), seq)::INTEGER AS lugar FROM fx_images"""
)
def image_shuffled_order(spark, sf):
    """The order in which shuffled candidates of a product are tried."""
    order = Window.partitionBy("ean").orderBy(harvest.shuffled_order(7), "seq")
    return views.images(spark, sf).select("ean", "seq", F.row_number().over(order).alias("lugar"))
