"""Dialogues seen by each of their participants.

For every participant a dialogue is rendered once with that speaker as ``assistant`` and all others as
``user`` with their name; the mask is 1 on the assistant's words only. Messages marked as system belong to no
participant; every perspective shows them unmasked. The result keeps one row per perspective and message, with
the place of the message in the rendered dialogue, because a dialogue may be longer than a task should hold;
``rendered`` joins rows to whole texts for dialogues below a stated length.

Format: ``<|role|>name`` (the name only for users), newline, text, newline. The mask covers the assistant's
text and the newline that ends it.

Places are running sums in two levels: inside runs of ``RUN`` turn numbers, then over the runs, so the
messages of one dialogue spread over many tasks.

Defined cases: null text is empty; messages of a null speaker are those of one participant, shown with the name ``unknown``
and apart from a real speaker of that name (its perspective is null); messages without a dialogue id form one dialogue
of their own, whose id is null; equal turn numbers are ordered by speaker, then text; repeated rows stay;
a dialogue without a participant gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.text import private

RUN = 256
SYSTEM = "system"


def participants(turns: DataFrame) -> DataFrame:
    """conv_id, perspective: the distinct speakers of a dialogue."""
    return turns.where(~F.col("speaker").eqNullSafe(SYSTEM)).select(F.col("conv_id").alias("_seen"), F.col("speaker").alias("perspective")).distinct()


def perspectives(turns: DataFrame, speaker: str = "role") -> DataFrame:
    """conv_id, perspective, turn, role, name, segment, loss_start, loss_end, seg_start, seg_end.

    Places count code points from the start of the rendered dialogue. loss_start = loss_end: nothing to learn.
    """
    said = private(turns, "conv_id", "turn", speaker, "text").select(
        "conv_id",
        "turn",
        F.col(speaker).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    views = participants(said)
    seen = said.join(views, said["conv_id"].eqNullSafe(views["_seen"]))
    own = F.col("speaker").eqNullSafe(F.col("perspective"))
    role = F.when(own, F.lit("assistant")).when(F.col("speaker") == SYSTEM, F.lit(SYSTEM)).otherwise(F.lit("user"))
    name = F.coalesce("speaker", F.lit("unknown"))
    head = F.concat(F.lit("<|"), role, F.lit("|>"), F.when(role == "user", name).otherwise(F.lit("")), F.lit("\n"))
    laid = seen.select(
        "conv_id",
        "perspective",
        "turn",
        role.alias("role"),
        F.when(role == "user", name).alias("name"),
        F.concat(head, "text", F.lit("\n")).alias("segment"),
        F.length(head).cast("long").alias("_head"),
        "speaker",
    ).withColumn("_len", F.length("segment").cast("long")).withColumn("_run", F.expr(f"turn div {RUN}"))
    view = ["conv_id", "perspective"]
    earlier = Window.partitionBy(*view).orderBy(F.col("_run").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    runs = laid.groupBy(*view, "_run").agg(F.sum("_len").alias("_n")).select(
        *view, F.col("_run").alias("_r"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*view, "_run").orderBy(F.col("turn").asc_nulls_first(), "speaker", "segment").rowsBetween(Window.unboundedPreceding, -1)
    placed = laid.withColumn("_in", F.coalesce(F.sum("_len").over(inside), F.lit(0)))
    runs = runs.withColumnsRenamed({"conv_id": "_conv", "perspective": "_view"})
    on = F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("perspective").eqNullSafe(F.col("_view")) & F.col("_run").eqNullSafe(F.col("_r"))
    start = (F.col("_before") + F.col("_in")).cast("long")
    learn = F.col("role") == "assistant"
    return placed.join(runs, on).select(
        *view,
        "turn",
        "role",
        "name",
        "segment",
        start.alias("seg_start"),
        (start + F.col("_len")).alias("seg_end"),
        F.when(learn, start + F.col("_head")).otherwise(start).alias("loss_start"),
        F.when(learn, start + F.col("_len")).otherwise(start).alias("loss_end"),
    )


def rendered(views: DataFrame, most_chars: int) -> DataFrame:
    """conv_id, perspective, text, mask_spans of the dialogues of at most ``most_chars`` code points."""
    view = ["conv_id", "perspective"]
    sizes = views.groupBy(*view).agg(F.max("seg_end").alias("_n")).where(F.col("_n") <= most_chars)
    short = sizes.select(F.col("conv_id").alias("_conv"), F.col("perspective").alias("_view"))
    on = F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("perspective").eqNullSafe(F.col("_view"))
    rows = views.join(short, on, "left_semi").groupBy(*view).agg(F.sort_array(F.collect_list(F.struct("seg_start", "segment", "loss_start", "loss_end"))).alias("_s"))
    spans = F.filter(F.transform("_s", lambda x: F.struct(x["loss_start"].alias("start"), x["loss_end"].alias("end"))), lambda x: x["start"] < x["end"])
    return rows.select(*view, F.array_join(F.col("_s.segment"), "").alias("text"), spans.alias("mask_spans"))
