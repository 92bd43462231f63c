"""Domain tables derived from the given parquet tables: detections, votes, catalogue, runs, reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockcount.scale import numbered
from stockcount.sources.tables import table

# Whole seconds since the epoch, rounded half to even, from a timestamp without zone.
_SECONDS = "cast(bround(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts) / 1e6) as bigint)"
_HOUR = f"({_SECONDS} - 1704067200) div 3600"
_SKU = "case when event_type = 'error' then 'UNKNOWN' else event_type end"


def detections(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a box; further events of a user's hour are what further cameras see of the same object."""
    events = table(spark, sf, "events").selectExpr(
        f"{_HOUR} as frame_idx", "user_id as obj_id", "event_id", "least(value / 100.0D, 1.0D) as conf", f"{_SKU} as sku_pred"
    )
    hour = Window.partitionBy("obj_id", "frame_idx").orderBy("event_id")
    boxes = events.withColumn("camera", F.row_number().over(hour) - 1).selectExpr(
        "obj_id % 10 + 10 * camera as video_id",
        "frame_idx",
        "obj_id",
        "event_id",
        "conf",
        "(obj_id div 10 % 20) * 100 + frame_idx % 8 as x1",
        "(obj_id div 200) * 120 as y1",
        "(obj_id div 10 % 20) * 100 + frame_idx % 8 + 60 as x2",
        "(obj_id div 200) * 120 + 90 as y2",
        "2100 as frame_w",
        "1080 as frame_h",
        "sku_pred",
    )
    # A frame may be crowded: number inside ranges of objects, then shift by the counts before.
    order = [F.col("obj_id")]
    ranked = numbered(boxes, ["video_id", "frame_idx"], F.floor(F.col("obj_id") / F.lit(10_000)), order, "n")
    return ranked.withColumn("det_idx", (F.col("n") - 1).cast("long")).drop("n")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly frames for every video, from the first hour to the last one with an event."""
    seen = detections(spark, sf)
    last = table(spark, sf, "events").selectExpr(f"max({_HOUR}) as h").first()["h"] or 0
    return seen.select("video_id").distinct().selectExpr(
        "video_id", f"explode(sequence(cast(0 as bigint), cast({last} as bigint))) as frame_idx", "30.0D as fps"
    )


def raw_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey",
        "l_linenumber",
        "l_orderkey % 20 as video_id",
        "l_partkey % 200 as frame_idx",
        "(l_partkey * 37) % 1900 as x1",
        "(l_suppkey * 53) % 1000 as y1",
        "least(1920, (l_partkey * 37) % 1900 + 1 + (l_orderkey * 7) % 1200) as x2",
        "least(1080, (l_suppkey * 53) % 1000 + 1 + (l_suppkey * 13 + l_linenumber * 101) % 700) as y2",
        "(l_orderkey % 100) / 100.0D as conf",
        "1920 as frame_w",
        "1080 as frame_h",
    )


_MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)"


def votes(spark: SparkSession, sf: str) -> DataFrame:
    """Votes whose ``frame_idx`` is only an order (time, then event): no window over a track is needed."""
    return table(spark, sf, "events").selectExpr(
        "user_id * 100 + dayofmonth(ts) as track_id",
        "user_id % 10 as video_id",
        f"{_SKU} as sku",
        "least(value / 100.0D, 1.0D) as sim",
        f"cast({_MICROS} as decimal(18,0)) * cast(1e19 as decimal(20,0)) + event_id as frame_idx",
    )


def numbered_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Votes with frames numbered from 1 inside each track."""
    events = table(spark, sf, "events").selectExpr(
        "user_id * 100 + dayofmonth(ts) as track_id",
        "user_id % 10 as video_id",
        f"{_SKU} as sku",
        "least(value / 100.0D, 1.0D) as sim",
        "ts",
        "event_id",
    )
    hour = F.date_trunc("hour", "ts")
    ranked = numbered(events, ["track_id"], hour, [F.col("ts"), F.col("event_id")], "frame_idx")
    return ranked.drop("ts", "event_id")


OCCLUDED = "transform(embedding, (e, i) -> if(i % (1 + vec_id % 8) = 0, e, 0f))"


def _category(table_sql: str, index: str) -> str:
    return f"element_at({table_sql}, cast({index} as int) + 1)"


def catalog_refs(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "embeddings")
        .selectExpr(
            "vec_id as ref_id",
            "concat('EAN', lpad(cast(label as string), 3, '0')) as ean",
            _category("array('botella','lata','bolsa')", "label % 3") + " as categoria",
            "embedding",
        )
    )


def query_crops(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector as a crop of which the catalogue's product shows only each (1 + vec_id % 8)-th dimension."""
    return table(spark, sf, "embeddings").selectExpr("vec_id as crop_id", f"{OCCLUDED} as embedding")


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "embeddings")
        .selectExpr(
            "vec_id as prompt_id",
            _category("array('botella','lata','bolsa','frasco')", "label % 4") + " as categoria",
            "embedding",
        )
    )


def split_crops(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "embeddings")
        .selectExpr(
            "vec_id as crop_id",
            f"{OCCLUDED} as full_vec",
            f"transform({OCCLUDED}, (e, i) -> if(i < 32, e, 0f)) as left_vec",
            f"transform({OCCLUDED}, (e, i) -> if(i >= 32, e, 0f)) as right_vec",
            "0 as x1",
            "0 as y1",
            "60 + vec_id * 7 % 90 as x2",
            "60 as y2",
            "400 as frame_w",
            "400 as frame_h",
            "(vec_id * 13 % 100) / 100.0D as conf",
        )
    )


def packaging(spark: SparkSession, sf: str) -> DataFrame:
    types = table(spark, sf, "part").selectExpr("p_type as id", "p_type as nombre", "true as activo").distinct()
    extra = spark.sql("select * from values ('VACIO','VACIO',true), ('RETIRADO','RETIRADO',false) as t(id, nombre, activo)")
    return types.unionByName(extra)


_SIZE = "case when p_size % 5 = 0 then null else cast(p_size as string) end as size"


def products(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_partkey as ean",
        "concat(p_name, ' ', p_brand) as descripcion",
        "p_type as packaging_type_id",
        "p_brand as brand",
        _SIZE,
        "p_size as n_imagenes",
        "p_partkey % 3 <> 0 as embeddings_calculados",
        "p_partkey % 10 <> 9 as activo",
    )


def incoming(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    known = part.filter("p_partkey % 3 = 0").selectExpr(
        "p_partkey as ean",
        "case when p_partkey % 6 = 0 then concat(p_name, ' NUEVO') else concat(p_name, ' ', p_brand) end as descripcion",
        "case when p_partkey % 97 = 6 then 'NO_EXISTE' else p_type end as packaging_type_id",
        "p_brand as brand",
        _SIZE,
    )
    fresh = part.filter("p_partkey % 50 = 1").selectExpr(
        "p_partkey + 1000000 as ean",
        "p_name as descripcion",
        "p_type as packaging_type_id",
        "p_brand as brand",
        "cast(null as string) as size",
    )
    return known.unionByName(fresh)


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey as id",
        "concat('V', cast(o_custkey % 50 as string)) as video_nombre",
        "o_orderdate as fecha",
        "o_custkey % 90 + 10 as frames_procesados",
    )


def run_items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey as ejecucion_id",
        "l_partkey as ean",
        "l_linenumber as tracking_id",
        "cast(l_quantity as int) as cantidad_dedup",
        "cast(l_quantity as int) + l_linenumber as cantidad_raw",
        "round(l_discount * 10, 2) as confianza_promedio",
    )


def review(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id")
    labels = table(spark, sf, "labels").withColumn("has_label", F.lit(True))
    return docs.join(labels, "doc_id", "left").selectExpr(
        "doc_id as idx",
        "doc_id % 25 as run_id",
        "concat('crop_', cast(doc_id as string)) as crop_id",
        "case when doc_id % 2 = 0 then 'unknown' else 'ambiguous' end as decision",
        "case when has_label is null then 'pending' when toxic = 1 then 'discarded' "
        "when quality = 1 then 'labeled' else 'skipped' end as status",
        "case when quality = 1 and coalesce(toxic, 0) = 0 then doc_id % 40 end as assigned_ean",
    )


def images(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(
        "doc_id as seq",
        "doc_id % 40 as ean",
        "concat('http://', source, '/', cast(doc_id as string)) as url",
        "sha2(text, 256) as sha256",
        "n_chars * 40 as bytes",
        "case doc_id % 7 when 0 then 'text/html' when 1 then 'image/png' when 2 then 'image/webp; q=1' "
        "else 'image/jpeg' end as content_type",
        "case when doc_id % 11 = 0 then null else 200 + n_chars % 400 end as width",
        "case when doc_id % 11 = 0 then null else 250 + n_chars % 300 end as height",
    )


def frame_metrics(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_trunc("day", "ts")
    events = table(spark, sf, "events")
    return numbered(events, ["user_id"], day, [F.col("ts"), F.col("event_id")], "n").selectExpr(
        "user_id as video_id",
        "n - 1 as idx",
        "least(255.0D, value * 2.2D) as brightness",
        "least(90.0D, value) as contrast",
        "value * 3 as sharpness",
        "case when user_id % 2 = 0 then 1920 else 1080 end as width",
        "case when user_id % 2 = 0 then 1080 else 1920 end as height",
    )
