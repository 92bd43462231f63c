"""Building blocks that keep plans bounded when one key holds a large share of the rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables: the cluster's own, a temporary one only locally."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="stockcount-checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """Materialise and cut the lineage with a reliable checkpoint, so a lost executor costs one stage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Materialised like by ``cut``, in columns and compressed: for long tables, of which later steps read some columns."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; stops reading once the answer is known."""
    return df.select(F.lit(1)).limit(max_rows + 1).count() <= max_rows


def compact(df: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """Marks ``df`` for broadcasting when its checked size allows, so that the other side stays in place.

    Meant for narrow tables of keys; a larger one is joined by shuffling as usual.
    """
    return F.broadcast(df) if fits(df, max_rows) else df


#: Bits of the map that ``among`` tests keys against.
MAP_BITS = 1 << 27


def among(df: DataFrame, keys: DataFrame, key: str, max_rows: int = 500_000) -> DataFrame:
    """Rows of ``df`` whose key may be one of ``keys``: all that are, of the others a few in a hundred.

    For wide rows that are to meet a share of their keys, so that the others are not moved. Few keys are left to ``compact``;
    those of a larger table set bits in a map of 16 MB at most, which is broadcast.
    """
    if fits(keys, max_rows):
        return df
    bit = F.pmod(F.xxhash64(key), F.lit(MAP_BITS))
    place = F.bitmap_bit_position(bit)
    maps = keys.groupBy(F.bitmap_bucket_number(bit).alias("_bucket")).agg(F.bitmap_construct_agg(place).alias("_map"))
    byte = F.conv(F.hex(F.substring("_map", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    placed = df.withColumn("_bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(maps), "_bucket")
    shifted = F.call_function("shiftright", byte, F.pmod(place, F.lit(8)).cast("int"))
    return placed.filter(F.pmod(shifted, F.lit(2)) == 1).drop("_bucket", "_map")


def numbered(df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[Column], name: str) -> DataFrame:
    """``row_number`` per group without sorting a whole group in one task.

    ``bucket`` must not decrease along ``order``. Rows are ranked inside (group, bucket) and shifted
    by the number of rows in earlier buckets, which is a window over bucket totals only.
    """
    keys = [*group, "_bucket"]
    split = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        split.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    ranked = split.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.join(offsets, keys).withColumn(name, F.col("_offset") + F.col("_rank")).drop(
        "_bucket", "_offset", "_rank"
    )


def running_sum(df: DataFrame, group: Sequence[str], bucket: Column, order: Column, value: str, name: str) -> DataFrame:
    """Cumulative sum per group in two levels, inside buckets and over bucket totals."""
    keys = [*group, "_bucket"]
    split = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        split.groupBy(*keys)
        .agg(F.sum(value).alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = split.withColumn("_inside", F.sum(value).over(inside))
    return summed.join(offsets, keys).withColumn(name, F.col("_offset") + F.col("_inside")).drop(
        "_bucket", "_offset", "_inside"
    )
