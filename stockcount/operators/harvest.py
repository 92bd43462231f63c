"""From stored search pages and downloaded images to the reference images of each product."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockcount.functions.labels import media_extension
from stockcount.scale import cut

# Where image addresses sit in a result page, and the default limits.
PRIMARY_PATTERN = r'''<a\b(?=[^>]*\bclass=["'][^"'>]*\biusc\b)[^>]*"murl"\s*:\s*"([^"]*)"'''
# An image's src, or its data-src if it has no src or an empty one; both quote styles, any letter case.
FALLBACK_PATTERN = (
    r"""(?i)<img\b(?=[^>]*?\ssrc\s*=\s*(?:"[^"]|'[^']))[^>]*?\ssrc\s*=\s*["']([^"'>]*)"""
    r"""|<img\b(?![^>]*?\ssrc\s*=\s*(?:"[^"]|'[^']))[^>]*?\sdata-src\s*=\s*["']([^"'>]*)"""
)
MAX_CANDIDATES = 80
PER_EAN = 10
MIN_BYTES = 50_000
MIN_WIDTH = 300
MIN_HEIGHT = 300


def _address(url: Column) -> Column:
    """Address without the escapes of JSON and HTML."""
    for escaped, plain in (("\\/", "/"), ("\\u0026", "&"), ("&amp;", "&")):
        url = F.replace(url, F.lit(escaped), F.lit(plain))
    return url


def candidate_urls(
    pages: DataFrame,
    primary: str = PRIMARY_PATTERN,
    fallback: str | None = FALLBACK_PATTERN,
    limit: int = MAX_CANDIDATES,
    scheme: str = "http",
) -> DataFrame:
    """Addresses per page in order of appearance: page_id, pos, url.

    The limit counts matches before repetitions are removed; when the primary pattern alone reaches
    it, its matches are taken as they are. Everything is computed inside the row of the page.
    """

    def web(text: Column, pattern: str) -> Column:
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        # One of the pattern's groups holds the address.
        parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)) for i in range(re.compile(pattern).groups)]
        found = parts[0] if len(parts) == 1 else F.transform(whole, lambda _, i: F.concat(*[F.get(p, i) for p in parts]))
        return F.filter(F.transform(found, _address), lambda u: u.startswith(scheme))

    # The primary address sits in JSON inside an attribute, where quotes are written as entities.
    first = web(F.replace(F.col("html"), F.lit("&quot;"), F.lit('"')), primary)
    rest = web(F.col("html"), fallback) if fallback is not None else F.array().cast("array<string>")
    full = F.size("first") >= limit
    urls = F.when(full, F.slice("first", 1, limit)).otherwise(
        F.array_distinct(F.slice(F.concat("first", "rest"), 1, limit))
    )
    return (
        pages.select("page_id", first.alias("first"), rest.alias("rest"))
        .select("page_id", F.posexplode(urls).alias("pos", "url"))
    )


def validation(min_bytes: int = MIN_BYTES, min_width: int = MIN_WIDTH, min_height: int = MIN_HEIGHT) -> Column:
    """First failing check of a downloaded image, or ok / ok_no_dims."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    small = (F.col("width") < min_width) | (F.col("height") < min_height)
    return (
        F.when(~kind.contains("image/"), "content_type_not_image")
        .when(F.coalesce("bytes", F.lit(0)) < min_bytes, "too_small_bytes")
        .when(F.col("width").isNull() | F.col("height").isNull(), "ok_no_dims")
        .when(small, "too_small_resolution")
        .otherwise("ok")
    )


def validated(images: DataFrame, **limits: int) -> DataFrame:
    return images.withColumn("motivo", validation(**limits)).withColumn("valida", F.col("motivo").startswith("ok"))


def unique_content(images: DataFrame) -> DataFrame:
    """One row per content hash: the first product in file order, then the first image."""
    rest = [c for c in images.columns if c not in ("sha256", "ean", "seq")]
    first = F.min(F.struct("ean", "seq", *rest)).alias("f")
    return images.groupBy("sha256").agg(first).select("sha256", "f.*")


def shuffled_order(seed: int) -> Column:
    """Repeatable order of candidates that does not follow the search result."""
    return F.sha2(F.concat(F.coalesce("url", F.lit("")), F.lit(f"|{seed}")), 256)


def harvest(
    images: DataFrame, per_ean: int = PER_EAN, dedupe: bool = True, seed: int | None = None, **limits: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Saved images, rejected ones and counters per product.

    Products are served in order; each saves its first ``per_ean`` valid images whose content no
    earlier product has saved. Processing stops at the last saved one, so later images are neither
    attempted nor rejected. ``images`` has seq (order inside the product), ean, sha256, url and the
    validated columns; without sha256 or bytes the download failed. A text in an optional column ``save_error`` says that the
    file could not be written: it is not saved, and its content stays free.

    Rejected images have the stage (``download``, ``validate`` or ``save``) and the reason. An image whose content is saved already is
    passed over before anything is written and not rejected.

    Whether content is free depends on what earlier products really saved. That is settled in rounds:
    every product claims its first free contents, each content goes to its earliest claimant, and
    refused claims are dropped until none is refused. With ``seed`` the candidates of a product are
    taken in a repeatable shuffled order.
    """
    if seed is not None:
        images = images.withColumn("seq", F.struct(shuffled_order(seed).alias("h"), "seq"))
    if "save_error" not in images.columns:
        images = images.withColumn("save_error", F.lit(None).cast("string"))
    got = F.col("sha256").isNotNull() & F.col("bytes").isNotNull()
    checked = validated(images, **limits).withColumn("motivo", F.when(got, F.col("motivo")).otherwise(F.lit("download_failed")))
    checked = checked.withColumn("valida", F.col("valida") & got)
    valid = checked.filter("valida and save_error is null")
    if dedupe:
        claims = valid.groupBy("ean", "sha256").agg(F.min("seq").alias("seq"))
        order = Window.partitionBy("ean").orderBy("seq")
        claims = cut(claims)
        while True:
            wanted = claims.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_ean)
            owner = wanted.groupBy("sha256").agg(F.min("ean").alias("owner"))
            refused = wanted.join(owner, "sha256").filter(F.col("ean") != F.col("owner")).select("ean", "sha256")
            refused = cut(refused)
            if refused.isEmpty():
                break
            claims = cut(claims.join(refused, ["ean", "sha256"], "left_anti"))
        chosen = wanted.select("ean", "seq", "n")
    else:
        order = Window.partitionBy("ean").orderBy("seq")
        chosen = valid.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_ean).select("ean", "seq", "n")

    ends = chosen.groupBy("ean").agg(F.count(F.lit(1)).alias("guardadas"), F.max("seq").alias("ultimo"))
    full = F.col("guardadas") >= per_ean
    tried = checked.join(ends, "ean", "left").withColumn(
        "intentada", ~F.coalesce(full, F.lit(False)) | (F.col("seq") <= F.col("ultimo"))
    )
    name = F.format_string("%s__%03d.%s", F.col("ean").cast("string"), F.col("n"), media_extension(F.col("content_type")))
    saved = valid.join(chosen, ["ean", "seq"]).withColumn("archivo", name)
    stage = F.when(F.col("motivo") == "download_failed", F.lit("download")).otherwise(F.lit("validate"))
    rejected = tried.filter("intentada and not valida").select("ean", "seq", "url", stage.alias("etapa"), "motivo")
    unsaved = tried.filter("intentada and valida and save_error is not null")
    if dedupe:
        held = saved.select("sha256", F.struct("ean", "seq").alias("_by"))
        unsaved = unsaved.join(held, "sha256", "left").filter(F.col("_by").isNull() | (F.struct("ean", "seq") < F.col("_by")))
    rejected = rejected.unionByName(unsaved.select("ean", "seq", "url", F.lit("save").alias("etapa"), F.col("save_error").alias("motivo")))
    counters = tried.groupBy("ean").agg(
        F.coalesce(F.max("guardadas"), F.lit(0)).alias("guardadas"),
        F.count_if("intentada").alias("intentadas"),
        F.count(F.lit(1)).alias("candidatas"),
    )
    return saved, rejected, counters
