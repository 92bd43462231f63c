"""Identifiers, display labels and media types as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockcount.functions.numbers import decimals

UNKNOWN = "UNKNOWN"

# Media type to file extension; anything else is saved as jpg.
EXTENSIONS = {
    "image/jpeg": "jpg",
    "image/jpg": "jpg",
    "image/png": "png",
    "image/webp": "webp",
    "image/gif": "gif",
    "image/bmp": "bmp",
    "image/tiff": "tiff",
}
DEFAULT_EXTENSION = "jpg"

# Extensions of reference images and of videos.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".avif")
VIDEO_SUFFIXES = (".mp4", ".mov", ".mkv", ".avi")


def crop_id(frame_idx: Column, det_idx: Column, track_id: Column | None = None) -> Column:
    """``frame_00012_det_003``, with the track in the middle when the box has one."""
    plain = F.format_string("frame_%05d_det_%03d", frame_idx, det_idx)
    if track_id is None:
        return plain
    tracked = F.format_string("frame_%05d_track_%d_det_%03d", frame_idx, track_id, det_idx)
    return F.when(track_id.isNotNull(), tracked).otherwise(plain)


def _named(ean: Column, description: Column, chars: int) -> Column:
    return F.trim(F.concat(ean, F.lit(" "), F.substring(F.coalesce(description, F.lit("")), 1, chars)))


def sku_label(ean: Column, description: Column, confidence: Column) -> Column:
    """Text drawn next to a box: product code and name, or UNKNOWN with the similarity."""
    unknown = F.format_string("UNKNOWN (%.2f)", decimals(F.coalesce(confidence, F.lit(0.0)), 2))
    return F.when(ean != UNKNOWN, _named(ean, description, 30)).otherwise(unknown)


def pair_label(ean_l: Column, desc_l: Column, ean_r: Column, desc_r: Column) -> Column:
    """Label of a box split in two; equal halves collapse to one."""
    left = F.when(ean_l != UNKNOWN, _named(ean_l, desc_l, 18)).otherwise(F.lit(UNKNOWN))
    right = F.when(ean_r != UNKNOWN, _named(ean_r, desc_r, 18)).otherwise(F.lit(UNKNOWN))
    return F.when(left == right, left).otherwise(F.concat(F.lit("L:"), left, F.lit(" | R:"), right))


def media_extension(content_type: Column) -> Column:
    """File extension for a media type, parameters after ``;`` ignored."""
    bare = F.trim(F.split_part(F.lower(F.coalesce(content_type, F.lit(""))), F.lit(";"), F.lit(1)))
    table = F.create_map(*[F.lit(v) for kv in EXTENSIONS.items() for v in kv])
    return F.coalesce(F.try_element_at(table, bare), F.lit(DEFAULT_EXTENSION))


def suffix(path: Column) -> Column:
    """Lower-case file suffix including the dot; empty when there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
