"""Catalogue text files: one product per line, columns separated by tabs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BLANKS = " \t\n\r\x0b\x0c"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) where ``line`` sorts in file order, also when the file is read in several splits."""
    return spark.read.text(path).select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("n"),
        ).alias("line"),
        "value",
    )


def _content(lines: DataFrame) -> DataFrame:
    """Trimmed lines without blanks and comments."""
    text = F.btrim("value", F.lit(_BLANKS))
    return lines.withColumn("value", text).filter((F.col("value") != "") & ~F.col("value").startswith("#"))


def _field(parts: Column, i: int) -> Column:
    return F.btrim(F.get(parts, F.lit(i)), F.lit(_BLANKS))


def parse_catalog(lines: DataFrame) -> DataFrame:
    """ean, descripcion, categoria from lines with at least two tab-separated columns."""
    parts = F.split("value", "\t")
    return (
        _content(lines)
        .filter(F.size(parts) >= 2)
        .select("line", _field(parts, 0).alias("ean"), _field(parts, 1).alias("descripcion"), _field(parts, 2).alias("categoria"))
    )


def parse_catalog_lenient(lines: DataFrame) -> DataFrame:
    """Lines without tabs are split at runs of two or more blanks; a code's last line wins."""
    parts = F.when(F.col("value").contains("\t"), F.split("value", "\t")).otherwise(F.split("value", r"\s{2,}"))
    rows = (
        _content(lines)
        .filter(F.size(parts) >= 2)
        .select(
            "line",
            _field(parts, 0).alias("ean"),
            _field(parts, 1).alias("descripcion"),
            F.coalesce(_field(parts, 2), F.lit("")).alias("categoria"),
        )
    )
    last = F.max_by(F.struct("descripcion", "categoria"), "line").alias("r")
    return rows.groupBy("ean").agg(last).select("ean", "r.descripcion", "r.categoria")


def parse_catalog_full(lines: DataFrame) -> DataFrame:
    """Six-column form. ``valida`` is false for lines with fewer than three columns; blanks become null."""
    parts = F.split("value", "\t")
    blank = F.lit("")
    return _content(lines).select(
        "line",
        (F.size(parts) >= 3).alias("valida"),
        _field(parts, 0).alias("ean"),
        _field(parts, 1).alias("descripcion"),
        _field(parts, 2).alias("packaging_type_id"),
        F.nullif(_field(parts, 3), blank).alias("brand"),
        F.nullif(_field(parts, 4), blank).alias("size"),
        F.nullif(_field(parts, 5), blank).alias("variant"),
    )


def valid_codes(lines: DataFrame) -> DataFrame:
    """Distinct product codes; an empty result means that codes are not validated."""
    code = F.btrim(F.get(F.split("value", "\t"), F.lit(0)), F.lit(_BLANKS)).alias("ean")
    return _content(lines).select(code).filter("ean <> ''").distinct()


def validation_list(lines: DataFrame | None) -> DataFrame | None:
    """The valid codes, or None (no validation) without a file or without any code in it."""
    if lines is None:
        return None
    codes = valid_codes(lines)
    return None if codes.isEmpty() else codes
