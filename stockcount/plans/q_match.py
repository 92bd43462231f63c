"""Queries on embeddings: search, classification, identification and the split policy."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stockcount.functions import vectors as vec
from stockcount.functions.numbers import decimals
from stockcount.operators import identify as ident
from stockcount.operators import knn, pivots
from stockcount.plans.registry import query
from stockcount.scale import shared_dir
from stockcount.sources import snapshots, stores, views
from stockcount.sources.tables import table


def _unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x / greatest(sqrt(list_dot_product({v}, {v})), 1e-10))"


def _mean_sql(name: str, source: str, key: str) -> str:
    """CTEs <name>: per key the mean (m) and the renormalised mean (c) of normalised vectors."""
    return f"""{name}_u AS (SELECT {key} AS k, {_unit('embedding::DOUBLE[]')} AS v FROM {source}),
{name}_p AS (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {name}_u),
{name}_m AS (SELECT k, list(x ORDER BY i) AS m FROM (SELECT k, i, avg(x) AS x FROM {name}_p GROUP BY 1, 2) GROUP BY 1),
{name} AS (SELECT k, m, {_unit('m')} AS c FROM {name}_m)"""


_REFS = f"refs AS (SELECT ref_id, ean, lower(categoria) AS cat, {_unit('embedding::DOUBLE[]')} AS v FROM fx_catalog_ref)"


def _identify_sql(prefix: str, source: str, forced: str = "NULL", k: int = 5) -> str:
    """CTEs ending in <prefix>_res for a relation with columns key, vec; needs refs and pc."""
    p = prefix
    return f"""{p}_q AS (SELECT key, {_unit('vec::DOUBLE[]')} AS v, {forced} AS forced FROM {source}),
{p}_cls AS (
  SELECT key, forced, v, CASE WHEN sim < 0.15 THEN 'otro' ELSE cat END AS det FROM (
    SELECT q.key, q.forced, q.v, pc.k AS cat, list_dot_product(q.v, pc.c) AS sim,
           row_number() OVER (PARTITION BY q.key ORDER BY list_dot_product(q.v, pc.c) DESC, pc.k) AS rn
    FROM {p}_q q, pc) WHERE rn = 1),
{p}_sc AS (
  SELECT key, v, coalesce(forced, det) AS det, CASE WHEN lower(coalesce(forced, det)) IN (SELECT cat FROM refs)
         THEN lower(coalesce(forced, det)) ELSE '*' END AS scope FROM {p}_cls),
{p}_sim AS (
  SELECT s.key, r.ean, max(list_dot_product(s.v, r.v)) AS sim
  FROM {p}_sc s JOIN refs r ON s.scope = '*' OR s.scope = r.cat GROUP BY 1, 2),
{p}_top AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY sim DESC, ean) AS rank FROM {p}_sim
  QUALIFY rank <= {k}),
{p}_best AS (
  SELECT s.key, s.det, a.ean AS top_ean, a.sim AS s1, b.sim AS s2, coalesce(n.n, 0) AS n
  FROM {p}_sc s LEFT JOIN {p}_top a ON a.key = s.key AND a.rank = 1 LEFT JOIN {p}_top b ON b.key = s.key AND b.rank = 2
  LEFT JOIN (SELECT key, count(*)::BIGINT AS n FROM {p}_top GROUP BY 1) n ON n.key = s.key),
{p}_res AS (
  SELECT *, CASE WHEN status = 'matched' THEN top_ean ELSE 'UNKNOWN' END AS ean,
         coalesce(printf('%.4f', s1)::DOUBLE, 0.0::DOUBLE) AS conf FROM (
    SELECT *, CASE WHEN s1 IS NULL OR s1 < 0.20 THEN 'unknown' WHEN s1 < 0.28 THEN 'ambiguous'
                   WHEN s1 - s2 < 0.02 THEN 'ambiguous' ELSE 'matched' END AS status FROM {p}_best))"""


_PC = _mean_sql("pc", "fx_prompts", "categoria")
_QUERIES = "qs AS (SELECT crop_id AS key, embedding AS vec FROM fx_query)"
_FULL = f"WITH {_REFS}, {_PC}, {_QUERIES}, {_identify_sql('f', 'qs')}"


@query(
    f"""SELECT vec_id, round(list_sum(u), 6) AS total, round(u[1], 6) AS primero, round(u[64], 6) AS ultimo,
       len(u)::INTEGER AS d
FROM (SELECT vec_id, {_unit('embedding::DOUBLE[]')} AS u FROM embeddings)"""
)
def vec_normalize(spark, sf):
    unit = table(spark, sf, "embeddings").select("vec_id", vec.normalize(F.col("embedding")).alias("u"))
    total = F.aggregate("u", F.lit(0.0), lambda a, x: a + x)
    return unit.select(
        "vec_id",
        decimals(total, 6).alias("total"),
        decimals(F.element_at("u", 1), 6).alias("primero"),
        decimals(F.element_at("u", 64), 6).alias("ultimo"),
        F.size("u").alias("d"),
    )


@query(
    f"WITH {_mean_sql('c', 'fx_catalog_ref', 'ean')} "
    "SELECT k AS ean, i::INTEGER AS pos, round(x, 6) AS valor "
    "FROM (SELECT k, unnest(c) AS x, generate_subscripts(c, 1) - 1 AS i FROM c)"
)
def sku_centroids(spark, sf):
    flat = knn.centroids(views.catalog_refs(spark, sf)).select("ean", F.posexplode("centroid").alias("pos", "valor"))
    return flat.withColumn("valor", decimals("valor", 6))


@query(
    f"""WITH {_REFS}, q AS (SELECT crop_id, {_unit('embedding::DOUBLE[]')} AS v FROM fx_query),
s AS (SELECT q.crop_id, r.ean, max(list_dot_product(q.v, r.v)) AS sim FROM q, refs r GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY sim DESC, ean) AS rank FROM s)
SELECT crop_id, rank::INTEGER AS rank, ean, round(sim, 6) AS similitud FROM t WHERE rank <= 3"""
)
def knn_max_topk(spark, sf):
    hits = knn.search(views.query_crops(spark, sf), views.catalog_refs(spark, sf), k=3, dimension=64)
    return hits.withColumn("similitud", decimals("similitud", 6))


@query(
    f"""WITH {_REFS}, q AS (SELECT crop_id, {_unit('embedding::DOUBLE[]')} AS v FROM fx_query),
s AS (SELECT q.crop_id, r.ean, max(list_dot_product(q.v, r.v)) AS sim FROM q, refs r GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY sim DESC, ean) AS rank FROM s)
SELECT crop_id, rank::INTEGER AS rank, ean, round(sim, 6) AS similitud, TRUE AS cuadra FROM t WHERE rank <= 3"""
)
def knn_pruned(spark, sf):
    """The same rows through the pivot index; ``cuadra``: no block was met twice and none skipped that was not met."""
    hits, counts = _pruned(spark, sf)
    fine = counts.select(((F.col("met") <= F.col("pairs")) & (F.col("skipped") <= F.col("met"))).alias("cuadra"))
    return hits.withColumn("similitud", decimals("similitud", 6)).crossJoin(F.broadcast(fine))


@query()
def knn_pruned_blocks(spark, sf):
    """Pairs of crop chunks and reference blocks, those met in tasks, and those skipped there."""
    return _pruned(spark, sf)[1]


def _pruned(spark, sf):
    return pivots.search_pruned(views.query_crops(spark, sf), pivots.build_index(views.catalog_refs(spark, sf), 64), k=3)


_CATEGORY_OF = "['Botella','lata','bolsa','frasco',''][crop_id // 10 % 5 + 1]"


@query(
    f"""WITH {_REFS},
q AS (SELECT crop_id, {_unit('embedding::DOUBLE[]')} AS v, {_CATEGORY_OF} AS categoria FROM fx_query),
sc AS (SELECT *, CASE WHEN lower(categoria) IN (SELECT cat FROM refs) THEN lower(categoria) ELSE '*' END AS scope FROM q),
s AS (SELECT crop_id, ean, max(list_dot_product(sc.v, r.v)) AS sim
      FROM sc JOIN refs r ON scope = '*' OR scope = r.cat GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY sim DESC, ean) AS rank FROM s)
SELECT crop_id, rank::INTEGER AS rank, ean, round(sim, 6) AS similitud FROM t WHERE rank <= 3"""
)
def knn_category_fallback(spark, sf):
    crops = views.query_crops(spark, sf).withColumn(
        "categoria",
        F.expr("element_at(array('Botella','lata','bolsa','frasco',''), cast(crop_id div 10 % 5 as int) + 1)"),
    )
    hits = knn.search_in_category(crops, views.catalog_refs(spark, sf), k=3)
    return hits.withColumn("similitud", decimals("similitud", 6))


@query(
    f"""WITH {_REFS}, {_mean_sql('c', 'fx_catalog_ref', 'ean')},
q AS (SELECT crop_id, {_unit('embedding::DOUBLE[]')} AS v FROM fx_query),
s AS (SELECT q.crop_id, r.ean, max(list_dot_product(q.v, r.v)) AS mx, avg(list_dot_product(q.v, r.v)) AS mn
      FROM q, refs r GROUP BY 1, 2),
t AS (SELECT q.crop_id, c.k AS ean, list_dot_product(q.v, c.c) AS ce,
             row_number() OVER (PARTITION BY q.crop_id ORDER BY list_dot_product(q.v, c.c) DESC, c.k) AS rank FROM q, c)
SELECT crop_id, rank::INTEGER AS rank, ean, round(ce, 6) AS similitud_centroide, round(mx, 6) AS similitud_max,
       round(mn, 6) AS similitud_mean
FROM t JOIN s USING (crop_id, ean) WHERE rank <= 3"""
)
def knn_detailed(spark, sf):
    hits = knn.search_detailed(views.query_crops(spark, sf), views.catalog_refs(spark, sf), k=3)
    sims = ["similitud_centroide", "similitud_max", "similitud_mean"]
    return hits.withColumns({c: decimals(c, 6) for c in sims})


@query(
    f"""WITH {_PC}, q AS (SELECT crop_id, {_unit('embedding::DOUBLE[]')} AS v FROM fx_query),
t AS (SELECT crop_id, pc.k AS categoria, list_dot_product(q.v, pc.c) AS sim,
             row_number() OVER (PARTITION BY crop_id ORDER BY list_dot_product(q.v, pc.c) DESC, pc.k) AS rn FROM q, pc)
SELECT crop_id, categoria, round(sim, 6) AS similitud, CASE WHEN sim < 0.15 THEN 'otro' ELSE categoria END AS detectada
FROM t WHERE rn = 1"""
)
def packaging_classify(spark, sf):
    found = knn.classify_packaging(views.query_crops(spark, sf), views.prompts(spark, sf))
    return found.drop("rank").withColumn("similitud", decimals("similitud", 6))


@query(
    """WITH t AS (SELECT ean, CASE WHEN ref_id % 20 = 1 THEN embedding[1:32] ELSE embedding END AS e FROM fx_catalog_ref)
SELECT ean, len(e)::BIGINT AS dimension, count(*)::BIGINT AS n FROM t WHERE len(e) <> 64 GROUP BY 1, 2"""
)
def vec_dim_check(spark, sf):
    cut = F.when(F.col("ref_id") % 20 == 1, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    return knn.wrong_dimension(views.catalog_refs(spark, sf).withColumn("embedding", cut), 64)


@query(
    """WITH fresh AS (
  SELECT vec_id + 1000000 AS ref_id, 'EAN' || lpad(label::VARCHAR, 3, '0') AS ean FROM embeddings WHERE label < 4)
SELECT ref_id, ean FROM fx_catalog_ref WHERE ean NOT IN (SELECT ean FROM fresh) UNION ALL SELECT ref_id, ean FROM fresh"""
)
def catalog_replace_refs(spark, sf):
    fresh = (
        table(spark, sf, "embeddings")
        .filter("label < 4")
        .selectExpr(
            "vec_id + 1000000 as ref_id", "concat('EAN', lpad(cast(label as string), 3, '0')) as ean", "'botella' as categoria", "embedding"
        )
    )
    return knn.replace_refs(views.catalog_refs(spark, sf), fresh).select("ref_id", "ean")


_STORED_SQL = """WITH fresh AS (
  SELECT vec_id + 1000000 AS ref_id, 'EAN' || lpad(label::VARCHAR, 3, '0') AS ean, 'botella' AS categoria FROM embeddings WHERE label < 4),
s AS (SELECT ref_id, ean, categoria FROM fx_catalog_ref WHERE ean NOT IN (SELECT ean FROM fresh) UNION ALL SELECT * FROM fresh)
SELECT ean, categoria, count(*)::BIGINT AS n, sum(ref_id)::BIGINT AS suma FROM s WHERE categoria IN ('botella', 'bolsa') GROUP BY 1, 2"""


@query(_STORED_SQL)
def catalog_snapshots(spark, sf):
    """The catalogue as snapshots: stored in two deliveries, some products replaced, compacted; two categories are read back."""
    refs = views.catalog_refs(spark, sf)
    stored = snapshots.SnapshotTable(spark, f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}", tag="categoria")
    for half in (0, 1):
        stored.append(refs.filter(F.col("ref_id") % 2 == half))
    moved = refs.filter("substring(ean, 4) < '004'").withColumns({"ref_id": F.col("ref_id") + 1_000_000, "categoria": F.lit("botella")})
    stored.replace(moved, "ean")
    stored.compact()
    kept = stored.read(tags=["botella", "bolsa"])
    return kept.groupBy("ean", "categoria").agg(F.count(F.lit(1)).alias("n"), F.sum("ref_id").alias("suma"))


@query(_STORED_SQL)
def catalog_store_update(spark, sf):
    """The stored catalogue after some products were replaced; two categories are read back."""
    path = f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}"
    refs = views.catalog_refs(spark, sf)
    stores.write_refs(refs, path)
    moved = refs.filter("substring(ean, 4) < '004'").withColumns({"ref_id": F.col("ref_id") + 1_000_000, "categoria": F.lit("botella")})
    stores.update_refs(moved, path)
    kept = stores.read_refs(spark, path, ["botella", "bolsa"])
    return kept.groupBy("ean", "categoria").agg(F.count(F.lit(1)).alias("n"), F.sum("ref_id").alias("suma"))


@query("SELECT ref_id, ean, categoria FROM fx_catalog_ref WHERE ean NOT IN (SELECT 'EAN' || lpad(label::VARCHAR, 3, '0') FROM embeddings WHERE label < 5)")
def catalog_remove_refs(spark, sf):
    gone = (
        table(spark, sf, "embeddings")
        .filter("label < 5")
        .selectExpr("concat('EAN', lpad(cast(label as string), 3, '0')) as ean")
    )
    return knn.remove_refs(views.catalog_refs(spark, sf), gone).select("ref_id", "ean", "categoria")


def _identified(spark, sf):
    return ident.identify(views.query_crops(spark, sf), views.catalog_refs(spark, sf), views.prompts(spark, sf))


@query(
    f"""WITH {_REFS}, q AS (SELECT crop_id, {_unit('embedding::DOUBLE[]')} AS v FROM fx_query),
s AS (SELECT q.crop_id, r.ean, max(list_dot_product(q.v, r.v)) AS sim FROM q, refs r GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY sim DESC, ean) AS rank FROM s),
b AS (SELECT a.crop_id, a.ean AS top_ean, a.sim AS s1, b.sim AS s2 FROM t a LEFT JOIN t b ON a.crop_id = b.crop_id AND b.rank = 2
      WHERE a.rank = 1),
d AS (SELECT *, CASE WHEN s1 < 0.20 THEN 'unknown' WHEN s1 < 0.28 THEN 'ambiguous' WHEN s1 - s2 < 0.02 THEN 'ambiguous'
                ELSE 'matched' END AS status FROM b)
SELECT crop_id, status, CASE WHEN status = 'matched' THEN top_ean ELSE 'UNKNOWN' END AS ean,
       printf('%.4f', s1)::DOUBLE AS confianza FROM d"""
)
def identify_status(spark, sf):
    crops = views.query_crops(spark, sf)
    hits = knn.search(crops, views.catalog_refs(spark, sf), k=3)
    return ident.decide(hits, crops=crops.select("crop_id")).select("crop_id", "status", "ean", "confianza")


@query(
    _FULL
    + """SELECT key AS crop_id, det AS detectada, status, f_res.ean, conf AS confianza, n AS n_candidatos,
       CASE WHEN status = 'matched' THEN coalesce(p.descripcion, '') ELSE '' END AS descripcion
FROM f_res LEFT JOIN (SELECT 'EAN' || lpad(ean::VARCHAR, greatest(3, length(ean::VARCHAR))::INTEGER, '0') AS ean, descripcion FROM fx_products) p
  ON p.ean = top_ean"""
)
def identify_full(spark, sf):
    names = views.products(spark, sf).selectExpr(
        "concat('EAN', lpad(cast(ean as string), greatest(3, length(cast(ean as string))), '0')) as ean", "descripcion"
    )
    out = ident.identify(
        views.query_crops(spark, sf), views.catalog_refs(spark, sf), views.prompts(spark, sf), products=names
    )
    return out.select("crop_id", "detectada", "status", "ean", "confianza", "n_candidatos", "descripcion")


@query(
    f"WITH {_REFS}, {_PC}, "
    + f"qs AS (SELECT crop_id AS key, embedding AS vec, {_CATEGORY_OF} AS given FROM fx_query), "
    + _identify_sql("f", "qs", forced="nullif(CASE WHEN given = 'frasco' THEN 'otro' ELSE lower(given) END, '')")
    + " SELECT key AS crop_id, det AS categoria, status, ean, conf AS confianza FROM f_res"
)
def identify_by_category(spark, sf):
    given = F.expr("element_at(array('botella','lata','bolsa','otro',''), cast(crop_id div 10 % 5 as int) + 1)")
    crops = views.query_crops(spark, sf).withColumn("forzada", given)
    out = ident.identify(crops, views.catalog_refs(spark, sf), views.prompts(spark, sf))
    return out.select("crop_id", F.col("detectada").alias("categoria"), "status", "ean", "confianza")


@query(
    _FULL
    + """, g AS (
  SELECT 'status' AS grupo, status AS valor, count(*)::BIGINT AS n FROM f_res GROUP BY 2
  UNION ALL SELECT 'categoria', det, count(*)::BIGINT FROM f_res GROUP BY 2)
SELECT grupo, valor, n, printf('%.4f', n * 100.0::DOUBLE / (SELECT count(*) FROM f_res))::DOUBLE AS pct FROM g"""
)
def identify_stats(spark, sf):
    return ident.session_stats(_identified(spark, sf))


@query(
    _FULL
    + """SELECT key AS crop_id, CASE WHEN key % 20 = 1 THEN 'unknown' ELSE status END AS status,
       CASE WHEN key % 20 = 1 THEN 'UNKNOWN' ELSE ean END AS ean, CASE WHEN key % 20 = 1 THEN 0.0::DOUBLE ELSE conf END AS confianza FROM f_res"""
)
def identify_wrong_size(spark, sf):
    """Vectors of another size among the crops find nothing; the others are not affected."""
    crops = views.query_crops(spark, sf).withColumn(
        "embedding", F.when(F.col("crop_id") % 20 == 1, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    )
    out = ident.identify(crops, views.catalog_refs(spark, sf), views.prompts(spark, sf))
    return out.select("crop_id", "status", "ean", "confianza")


def _profile_sql(name: str, unknown: float, match: float, margin: float) -> str:
    return (
        f"SELECT '{name}' AS perfil, CASE WHEN s1 IS NULL OR s1 < {unknown}::DOUBLE THEN 'unknown' "
        f"WHEN s1 < {match}::DOUBLE THEN 'ambiguous' WHEN s1 - s2 < {margin}::DOUBLE THEN 'ambiguous' "
        "ELSE 'matched' END AS status FROM f_res"
    )


@query(
    _FULL
    + f""", p AS ({_profile_sql('catalog_only', 0.22, 0.30, 0.015)} UNION ALL {_profile_sql('shelf_video', 0.20, 0.28, 0.02)}
  UNION ALL {_profile_sql('low_light', 0.18, 0.25, 0.025)})
SELECT perfil, status, count(*)::BIGINT AS n FROM p GROUP BY 1, 2"""
)
def identify_profiles(spark, sf):
    return ident.compare_profiles(_identified(spark, sf))


_SPLIT_SQL = (
    f"WITH {_REFS}, {_PC}, fs AS (SELECT crop_id AS key, full_vec AS vec FROM fx_split), "
    + _identify_sql("f", "fs")
    + """, judged AS (
  SELECT r.*, least(1.0::DOUBLE, greatest(0.0::DOUBLE,
      0.4::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((x2 - x1) / (y2 - y1) - 1) / 0.5::DOUBLE))
      + 0.2::DOUBLE * least(1.0::DOUBLE, ((x2 - x1) * (y2 - y1)) / (frame_w * frame_h) / 0.15::DOUBLE)
      + 0.3::DOUBLE * (1 - least(1.0::DOUBLE, greatest(0.0::DOUBLE, s.conf))))) AS calidad
  FROM f_res r JOIN fx_split s ON s.crop_id = r.key),
cand AS (
  SELECT *, NOT (status = 'matched' AND conf >= 0.28::DOUBLE) AND conf >= 0.25::DOUBLE AND conf <= 0.45::DOUBLE
            AND calidad >= 0.6::DOUBLE AS dividir FROM judged)
"""
)


@query(_SPLIT_SQL + "SELECT key AS crop_id, status, conf AS confianza, round(calidad, 9) AS calidad, dividir FROM cand")
def split_candidates(spark, sf):
    boxes = views.split_crops(spark, sf)
    full = ident.identify(
        boxes.select("crop_id", F.col("full_vec").alias("embedding")), views.catalog_refs(spark, sf), views.prompts(spark, sf)
    )
    judged = ident.split_candidates(full.join(boxes.drop("full_vec", "left_vec", "right_vec"), "crop_id"))
    return judged.select("crop_id", "status", "confianza", F.round("calidad", 9).alias("calidad"), "dividir")


@query(
    _SPLIT_SQL
    + ", ls AS (SELECT crop_id AS key, left_vec AS vec, det AS forced FROM fx_split JOIN cand ON key = crop_id WHERE dividir), "
    + _identify_sql("l", "ls", forced="forced")
    + ", rs AS (SELECT crop_id AS key, right_vec AS vec, det AS forced FROM fx_split JOIN cand ON key = crop_id WHERE dividir), "
    + _identify_sql("r", "rs", forced="forced")
    + """, j AS (
  SELECT c.key, c.status, c.ean, c.conf, l.status AS ls, l.ean AS le, l.conf AS lc, r.status AS rs, r.ean AS re, r.conf AS rc,
         CASE WHEN l.status = 'matched' AND r.status <> 'matched' THEN true
              WHEN r.status = 'matched' AND l.status <> 'matched' THEN false ELSE l.conf >= r.conf END AS left_best
  FROM cand c LEFT JOIN l_res l ON l.key = c.key LEFT JOIN r_res r ON r.key = c.key),
b AS (
  SELECT *, CASE WHEN left_best THEN ls ELSE rs END AS bs, CASE WHEN left_best THEN le ELSE re END AS be,
         CASE WHEN left_best THEN lc ELSE rc END AS bc FROM j),
o AS (
  SELECT *, CASE WHEN ls IS NOT NULL AND NOT (status = 'matched' AND conf >= 0.28::DOUBLE)
                  AND ((bs = 'matched' AND status <> 'matched') OR bc >= conf + 0.05::DOUBLE)
            THEN CASE WHEN left_best THEN 'left' ELSE 'right' END ELSE 'full' END AS origen FROM b)
SELECT key AS crop_id, origen, CASE WHEN origen = 'full' THEN status ELSE bs END AS status,
       CASE WHEN origen = 'full' THEN ean ELSE be END AS ean, CASE WHEN origen = 'full' THEN conf ELSE bc END AS confianza
FROM o"""
)
def split_decision(spark, sf):
    out = ident.identify_boxes(views.split_crops(spark, sf), views.catalog_refs(spark, sf), views.prompts(spark, sf))
    return out.select("crop_id", "origen", "status", "ean", "confianza")


@query(
    _FULL
    + """SELECT key::VARCHAR AS crop_id, status AS decision, det AS packaging, conf AS confianza,
       'learning/' || status || '/' || key::VARCHAR || '.jpg' AS crop, 'pending' AS review_status, n AS n_matches
FROM f_res WHERE status IN ('unknown', 'ambiguous')"""
)
def review_enqueue(spark, sf):
    records = ident.review_records(_identified(spark, sf), F.lit("run-1"), F.lit("2024-01-01T00:00:00"))
    return records.select(
        "crop_id",
        "decision",
        F.col("packaging.predicted").alias("packaging"),
        F.col("sku_identification.confianza").alias("confianza"),
        F.col("paths.crop").alias("crop"),
        F.col("review.status").alias("review_status"),
        F.size("sku_identification.top_matches").cast("long").alias("n_matches"),
    )
