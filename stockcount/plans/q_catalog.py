"""Queries on the product catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockcount.operators import catalog
from stockcount.plans.registry import query
from stockcount.sources import catalog_text as text
from stockcount.sources import views
from stockcount.sources.tables import table

_ROW = r"concat_ws('\t', cast(ean as string), descripcion, packaging_type_id"


def _lines(spark, sf):
    """Catalogue lines written from the products, with the irregular forms mixed in."""
    return views.products(spark, sf).selectExpr(
        "ean as line",
        "case ean % 20 when 0 then concat('# ', descripcion) when 1 then '   ' "
        r"when 2 then concat(cast(ean as string), '\t', descripcion) "
        "when 3 then concat(cast(ean as string), '  ', descripcion, '   ', packaging_type_id) "
        rf"when 4 then concat('  ', {_ROW}, brand, '', '  '), '  ') "
        r"when 5 then concat('7', '\t', descripcion, '\tREPETIDO') "
        rf"else {_ROW}, brand, coalesce(size, '')) end as value",
    )


# What each kind of line contains, written directly from the products.
_LINES_SQL = """WITH l AS (
  SELECT ean AS line, ean % 20 AS k, ean::VARCHAR AS e, descripcion AS d, packaging_type_id AS p, brand AS b, size AS s
  FROM fx_products)
"""


@query(
    _LINES_SQL
    + """SELECT CASE WHEN k = 5 THEN '7' ELSE e END AS ean, d AS descripcion,
       CASE WHEN k = 2 THEN NULL WHEN k = 5 THEN 'REPETIDO' ELSE p END AS categoria
FROM l WHERE k NOT IN (0, 1, 3)"""
)
def catalog_parse(spark, sf):
    return text.parse_catalog(_lines(spark, sf)).select("ean", "descripcion", "categoria")


@query(
    _LINES_SQL
    + """, r AS (
  SELECT line, CASE WHEN k = 5 THEN '7' ELSE e END AS ean, d AS descripcion,
         CASE WHEN k = 2 THEN '' WHEN k = 5 THEN 'REPETIDO' ELSE p END AS categoria
  FROM l WHERE k NOT IN (0, 1)),
n AS (SELECT *, row_number() OVER (PARTITION BY ean ORDER BY line DESC) AS rn FROM r)
SELECT ean, descripcion, categoria FROM n WHERE rn = 1"""
)
def catalog_parse_lenient(spark, sf):
    return text.parse_catalog_lenient(_lines(spark, sf))


@query(
    _LINES_SQL
    + """SELECT line, k NOT IN (2, 3) AS valida,
       CASE WHEN k = 3 THEN e || '  ' || d || '   ' || p WHEN k = 5 THEN '7' ELSE e END AS ean,
       CASE WHEN k = 3 THEN NULL ELSE d END AS descripcion,
       CASE WHEN k IN (2, 3) THEN NULL WHEN k = 5 THEN 'REPETIDO' ELSE p END AS packaging_type_id,
       CASE WHEN k IN (2, 3, 5) THEN NULL ELSE b END AS brand, CASE WHEN k IN (2, 3, 4, 5) THEN NULL ELSE s END AS size
FROM l WHERE k NOT IN (0, 1)"""
)
def catalog_parse_full(spark, sf):
    return text.parse_catalog_full(_lines(spark, sf)).drop("variant")


@query(
    """SELECT p.ean, p.descripcion, p.packaging_type_id, k.nombre AS packaging_type_nombre, p.brand, p.size,
       p.n_imagenes, p.embeddings_calculados
FROM fx_products p JOIN fx_packaging k ON k.id = p.packaging_type_id WHERE p.activo"""
)
def product_list(spark, sf):
    return catalog.list_products(views.products(spark, sf), views.packaging(spark, sf)).drop("activo")


@query(
    """WITH t AS (SELECT upper(split_part(p_type, ' ', 1)) AS busqueda FROM part UNION SELECT lower(p_brand) FROM part
  UNION SELECT (p_size)::VARCHAR FROM part UNION SELECT ''),
h AS (
  SELECT t.busqueda, p.ean, p.descripcion,
         row_number() OVER (PARTITION BY t.busqueda ORDER BY p.packaging_type_id, p.descripcion, p.ean) AS rank
  FROM t JOIN fx_products p ON contains(lower(p.ean::VARCHAR), lower(t.busqueda)) OR contains(lower(p.descripcion), lower(t.busqueda))
  WHERE p.activo)
SELECT busqueda, rank::INTEGER AS rank, ean, descripcion FROM h WHERE rank <= 20"""
)
def product_search(spark, sf):
    listed = catalog.list_products(views.products(spark, sf), views.packaging(spark, sf))
    part = table(spark, sf, "part")
    terms = part.select(F.explode(F.expr("array(upper(split_part(p_type, ' ', 1)), lower(p_brand), cast(p_size as string), '')")).alias("busqueda"))
    return catalog.search_products(listed, terms)


@query(
    """WITH f AS (
  SELECT ean, 'imagenes/' || ean::VARCHAR || '/' || lpad(seq::VARCHAR, 6, '0')
         || ['.jpg', '.JPEG', '.png', '.webp', '.avif', '.txt', ''][seq % 7 + 1] AS path, seq % 7 AS k FROM fx_images)
SELECT ean, count(*)::BIGINT AS n_imagenes, min(path) AS primera FROM f WHERE k < 5 GROUP BY 1"""
)
def image_manifest(spark, sf):
    kinds = "array('.jpg','.JPEG','.png','.webp','.avif','.txt','')"
    paths = views.images(spark, sf).selectExpr(
        "ean",
        f"concat('imagenes/', cast(ean as string), '/', lpad(cast(seq as string), 6, '0'), "
        f"element_at({kinds}, cast(seq % 7 as int) + 1)) as path",
    )
    return catalog.image_manifest(paths)


@query(
    """WITH fresh AS (
  SELECT DISTINCT p_brand AS id FROM part UNION SELECT p_type FROM part
  UNION SELECT unnest(['botella', 'lata', 'bolsa', 'caja', 'paquete', 'tubo', 'frasco']))
SELECT id, false AS insertado FROM fx_packaging
UNION ALL SELECT id, true FROM fresh WHERE id NOT IN (SELECT id FROM fx_packaging)"""
)
def packaging_merge(spark, sf):
    part = table(spark, sf, "part")
    fresh = (
        part.selectExpr("p_brand as id")
        .unionByName(part.selectExpr("p_type as id"))
        .unionByName(catalog.packaging_seed(spark).select("id"))
        .selectExpr("id", "id as nombre", "true as activo")
    )
    return catalog.insert_missing(views.packaging(spark, sf), fresh, ["id"]).select("id", "insertado")


_SYNC_SQL = """WITH s AS (
  SELECT i.ean, CASE WHEN k.id IS NULL THEN 'error' WHEN p.ean IS NULL THEN 'agregado'
         WHEN i.descripcion IS DISTINCT FROM p.descripcion OR i.packaging_type_id IS DISTINCT FROM p.packaging_type_id
              OR i.brand IS DISTINCT FROM p.brand OR i.size IS DISTINCT FROM p.size THEN 'actualizado'
         ELSE 'igual' END AS accion,
         concat_ws(',', CASE WHEN i.descripcion IS DISTINCT FROM p.descripcion THEN 'descripcion' END,
                   CASE WHEN i.packaging_type_id IS DISTINCT FROM p.packaging_type_id THEN 'packaging_type_id' END,
                   CASE WHEN i.brand IS DISTINCT FROM p.brand THEN 'brand' END,
                   CASE WHEN i.size IS DISTINCT FROM p.size THEN 'size' END) AS campos
  FROM fx_incoming i LEFT JOIN fx_packaging k ON k.id = i.packaging_type_id LEFT JOIN fx_products p ON p.ean = i.ean)
"""


def _sync(spark, sf):
    return catalog.sync_log(views.products(spark, sf), views.incoming(spark, sf), views.packaging(spark, sf))


@query(_SYNC_SQL + "SELECT ean, accion, CASE WHEN accion = 'actualizado' THEN campos ELSE '' END AS cambios FROM s")
def catalog_sync(spark, sf):
    return _sync(spark, sf).select("ean", "accion", "cambios")


@query(
    _SYNC_SQL
    + """SELECT count_if(accion = 'agregado')::BIGINT AS agregados, count_if(accion = 'actualizado')::BIGINT AS actualizados,
       count_if(accion = 'error')::BIGINT AS errores FROM s"""
)
def catalog_sync_counts(spark, sf):
    return catalog.sync_counts(_sync(spark, sf))


@query(
    """WITH ok AS (SELECT * FROM fx_incoming WHERE packaging_type_id IN (SELECT id FROM fx_packaging))
SELECT coalesce(p.ean, k.ean) AS ean, CASE WHEN k.ean IS NULL THEN p.descripcion ELSE k.descripcion END AS descripcion,
       CASE WHEN k.ean IS NULL THEN p.packaging_type_id ELSE k.packaging_type_id END AS packaging_type_id,
       CASE WHEN k.ean IS NULL THEN p.brand ELSE k.brand END AS brand, CASE WHEN k.ean IS NULL THEN p.size ELSE k.size END AS size,
       CASE WHEN p.ean IS NULL THEN 0 ELSE n_imagenes END AS n_imagenes,
       CASE WHEN p.ean IS NULL THEN false ELSE embeddings_calculados END AS embeddings_calculados,
       CASE WHEN p.ean IS NULL THEN true ELSE activo END AS activo
FROM fx_products p FULL JOIN ok k ON k.ean = p.ean"""
)
def catalog_synced(spark, sf):
    return catalog.sync_catalog(views.products(spark, sf), views.incoming(spark, sf), views.packaging(spark, sf))


@query(
    """SELECT p.ean, CASE WHEN i.ean IS NOT NULL THEN i.descripcion ELSE p.descripcion END AS descripcion,
       CASE WHEN i.ean % 2 = 0 THEN i.size ELSE p.size END AS size,
       CASE WHEN i.ean % 4 = 0 THEN 0 ELSE p.n_imagenes END AS n_imagenes
FROM fx_products p LEFT JOIN fx_incoming i ON i.ean = p.ean"""
)
def product_update(spark, sf):
    updates = views.incoming(spark, sf).selectExpr(
        "ean",
        "descripcion",
        "if(ean % 2 = 0, size, 'sin uso') as size",
        "cast(null as int) as n_imagenes",
        "case when ean % 4 = 0 then array('descripcion', 'size', 'n_imagenes') "
        "when ean % 2 = 0 then array('descripcion', 'size') else array('descripcion') end as campos",
    )
    changed = catalog.update_products(views.products(spark, sf), updates)
    return changed.select("ean", "descripcion", "size", "n_imagenes")


@query(
    """WITH c AS (SELECT label AS ean, count(*)::INTEGER AS n FROM embeddings GROUP BY 1)
SELECT p.ean, c.ean IS NOT NULL OR p.embeddings_calculados AS embeddings_calculados, coalesce(c.n, p.n_imagenes) AS n_imagenes,
       CASE WHEN c.ean IS NOT NULL THEN 'catalogo/' || p.ean::VARCHAR END AS embeddings_path,
       CASE WHEN c.ean IS NOT NULL THEN '2024-02-01T00:00:00' END AS fecha_embeddings
FROM fx_products p LEFT JOIN c ON c.ean = p.ean"""
)
def mark_embeddings(spark, sf):
    refs = table(spark, sf, "embeddings").selectExpr("cast(label as bigint) as ean")
    path = F.concat(F.lit("catalogo/"), F.col("ean").cast("string"))
    marked = catalog.mark_embeddings(views.products(spark, sf), refs, path, F.lit("2024-02-01T00:00:00"))
    return marked.select("ean", "embeddings_calculados", "n_imagenes", "embeddings_path", "fecha_embeddings")


def _discontinued(spark, sf):
    return table(spark, sf, "part").filter("p_size > 40").selectExpr("p_partkey as ean")


@query(
    "SELECT ean, activo AND ean NOT IN (SELECT p_partkey FROM part WHERE p_size > 40) AS activo FROM fx_products"
)
def product_soft_delete(spark, sf):
    return catalog.soft_delete(views.products(spark, sf), _discontinued(spark, sf)).select("ean", "activo")


@query(
    """WITH gone AS (SELECT p_partkey AS ean FROM part WHERE p_size > 40)
SELECT 'producto' AS tabla, ean, NULL::BIGINT AS ejecucion_id FROM fx_products WHERE ean NOT IN (SELECT ean FROM gone)
UNION ALL SELECT 'item', ean, ejecucion_id FROM fx_run_items WHERE ean NOT IN (SELECT ean FROM gone)"""
)
def product_hard_delete(spark, sf):
    products, items = catalog.hard_delete(
        views.products(spark, sf), views.run_items(spark, sf), _discontinued(spark, sf)
    )
    return products.selectExpr("'producto' as tabla", "ean", "cast(null as bigint) as ejecucion_id").unionByName(
        items.selectExpr("'item' as tabla", "ean", "ejecucion_id")
    )


@query(
    "SELECT packaging_type_id, count(*)::BIGINT AS total FROM fx_products WHERE activo GROUP BY ROLLUP (packaging_type_id)"
)
def product_counts(spark, sf):
    return catalog.count_products(views.products(spark, sf))


@query(
    """WITH c AS (
  SELECT k.id, k.nombre, count(p.ean)::BIGINT AS total_productos, coalesce(sum(p.n_imagenes), 0)::BIGINT AS total_imagenes,
         count(CASE WHEN p.embeddings_calculados THEN 1 END)::BIGINT AS con_embeddings,
         count(CASE WHEN NOT p.embeddings_calculados THEN 1 END)::BIGINT AS sin_embeddings
  FROM fx_packaging k LEFT JOIN fx_products p ON p.packaging_type_id = k.id AND p.activo WHERE k.activo GROUP BY 1, 2)
SELECT id AS packaging_type, nombre, total_productos, total_imagenes, con_embeddings, sin_embeddings FROM c
UNION ALL SELECT NULL, NULL, sum(total_productos)::BIGINT, sum(total_imagenes)::BIGINT, sum(con_embeddings)::BIGINT,
  sum(sin_embeddings)::BIGINT FROM c"""
)
def catalog_summary(spark, sf):
    return catalog.catalog_summary(views.packaging(spark, sf), views.products(spark, sf))


@query("SELECT ean, descripcion, packaging_type_id, n_imagenes FROM fx_products WHERE activo AND NOT embeddings_calculados")
def products_without_refs(spark, sf):
    return catalog.products_without_refs(views.products(spark, sf)).select(
        "ean", "descripcion", "packaging_type_id", "n_imagenes"
    )


_REFS_SQL = """WITH r AS (
  SELECT CASE WHEN ref_id % 7 = 0 THEN 'sin_categoria' ELSE categoria END AS categoria, ean FROM fx_catalog_ref)
"""


@query(
    _REFS_SQL
    + "SELECT categoria, count(DISTINCT ean)::BIGINT AS n_skus, count(*)::BIGINT AS n_embeddings FROM r GROUP BY 1"
)
def catalog_refs_summary(spark, sf):
    refs = views.catalog_refs(spark, sf).withColumn("categoria", F.expr("if(ref_id % 7 = 0, null, categoria)"))
    return catalog.refs_summary(refs)


@query("SELECT ean, categoria, count(*)::BIGINT AS n_embeddings FROM fx_catalog_ref GROUP BY 1, 2")
def catalog_refs_listing(spark, sf):
    from stockcount.sources.stores import refs_index

    return refs_index(views.catalog_refs(spark, sf))


@query(
    """WITH s AS (
  SELECT packaging_type_id AS categoria,
         CASE WHEN ean IN (SELECT label FROM embeddings) THEN 'ok'
              WHEN ean IN (SELECT ean FROM fx_images) THEN 'sin_embeddings' ELSE 'sin_imagenes' END AS estado
  FROM fx_products)
SELECT categoria, count_if(estado = 'ok')::BIGINT AS ok, count_if(estado = 'sin_embeddings')::BIGINT AS sin_embeddings,
       count_if(estado = 'sin_imagenes')::BIGINT AS sin_imagenes FROM s GROUP BY 1"""
)
def catalog_readiness(spark, sf):
    products = views.products(spark, sf).withColumnRenamed("packaging_type_id", "categoria")
    refs = table(spark, sf, "embeddings").selectExpr("cast(label as bigint) as ean")
    return catalog.readiness(products, refs, views.images(spark, sf))


@query(
    """WITH bridge(categoria, class_id) AS (VALUES ('botella', 39), ('botella', 40), ('botella', 41), ('lata', 39), ('bolsa', 44),
  ('bolsa', 27), ('caja', 39), ('paquete', 44), ('paquete', 27), ('tubo', 39), ('frasco', 39), ('frasco', 40))
SELECT video_id, categoria, upper(categoria[1]) || categoria[2:] AS nombre, count(*)::BIGINT AS cajas
FROM fx_raw_boxes JOIN bridge ON class_id = [39, 40, 41, 44, 27, 0][frame_idx % 6 + 1] GROUP BY 1, 2, 3"""
)
def packaging_class_bridge(spark, sf):
    boxes = views.raw_boxes(spark, sf).withColumn(
        "class_id", F.expr("element_at(array(39, 40, 41, 44, 27, 0), cast(frame_idx % 6 as int) + 1)")
    )
    return catalog.class_candidates(boxes, catalog.class_bridge(spark), catalog.packaging_seed(spark))
