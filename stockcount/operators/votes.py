"""Votes per track and the product each track stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockcount.functions.decision import VOTE_PROFILES, VoteProfile, track_accepted, vote_profile
from stockcount.functions.labels import UNKNOWN
from stockcount.functions.numbers import decimals

BALANCED = VOTE_PROFILES["WAREHOUSE_BALANCED"]


def scored_vote(min_sim: float) -> Column:
    """A vote counts when it names a product and its 4-decimal similarity reaches the minimum."""
    named = F.col("sku").isNotNull() & ~F.col("sku").isin("", UNKNOWN)
    return named & (F.col("sim4") >= F.lit(min_sim))


def _rounded(votes: DataFrame) -> DataFrame:
    return votes.withColumn("sim4", decimals("sim", 4))


def track_votes(votes: DataFrame, profile: VoteProfile = BALANCED) -> DataFrame:
    """Per track and product: votes, similarity sum and frame of the first vote."""
    return (
        _rounded(votes)
        .filter(scored_vote(profile.min_sim_vote))
        .groupBy("track_id", "sku")
        .agg(
            F.count(F.lit(1)).alias("votes"),
            F.sum("sim4").alias("sim_sum"),
            F.min("frame_idx").alias("first_frame"),
        )
    )


def track_tallies(votes: DataFrame, profile: VoteProfile = BALANCED) -> DataFrame:
    """Per track: frames seen, frames scored, and the leading product.

    Two aggregations with map-side combine: per (track, product), then per track. Ties on votes go
    to the product voted for first, then to the smaller code.
    """
    scored = scored_vote(profile.min_sim_vote)
    per_sku = _rounded(votes).groupBy("track_id", F.when(scored, F.col("sku")).alias("sku")).agg(
        F.count(F.lit(1)).alias("votes"),
        F.sum("sim4").alias("sim_sum"),
        F.min("frame_idx").alias("first_frame"),
    )
    rank = F.struct((-F.col("votes")).alias("v"), F.col("first_frame").alias("f"), F.col("sku").alias("s"))
    lead = F.when(F.col("sku").isNotNull(), F.struct(rank.alias("rank"), "votes", "sim_sum"))
    return (
        per_sku.groupBy("track_id")
        .agg(
            F.sum("votes").alias("frames_seen"),
            F.coalesce(F.sum(F.when(F.col("sku").isNotNull(), F.col("votes"))), F.lit(0)).alias("frames_scored"),
            F.min(lead).alias("lead"),
        )
        .select(
            "track_id",
            "frames_seen",
            "frames_scored",
            F.col("lead.rank.s").alias("top_sku"),
            F.col("lead.votes").alias("top_votes"),
            F.col("lead.sim_sum").alias("top_sim_sum"),
        )
    )


def _final_sku(p: VoteProfile) -> Column:
    ok = track_accepted(
        F.col("frames_scored"),
        F.col("top_votes"),
        F.col("top_sim_sum"),
        F.lit(p.min_frames),
        F.lit(p.min_confidence),
        F.lit(p.min_avg_sim),
        F.lit(p.high_sim),
    )
    return F.when(ok, F.col("top_sku")).otherwise(F.lit(UNKNOWN))


def track_decisions(votes: DataFrame, profile: VoteProfile | str = BALANCED) -> DataFrame:
    """One decision per track; a track without scored frames is UNKNOWN with zero confidence."""
    p = vote_profile(profile) if isinstance(profile, str) else profile
    return decide_tallies(track_tallies(votes, p), p)


def decide_tallies(tallies: DataFrame, p: VoteProfile = BALANCED, *more: str) -> DataFrame:
    """The decision of each row of ``track_tallies`` and ``more`` of its columns; works on a stream as well."""
    return tallies.select(
        "track_id",
        _final_sku(p).alias("final_sku"),
        F.coalesce(decimals(F.col("top_votes") / F.col("frames_scored"), 4), F.lit(0.0)).alias("confidence"),
        F.coalesce(decimals(F.col("top_sim_sum") / F.col("top_votes"), 4), F.lit(0.0)).alias("avg_sim"),
        F.col("frames_seen").alias("frames_validos"),
        "frames_scored",
        *more,
    )


def track_top_matches(votes: DataFrame, profile: VoteProfile = BALANCED, n: int = 5) -> DataFrame:
    """The ``n`` leading products of each track with votes, mean similarity and share."""
    per_sku = track_votes(votes, profile)
    track = Window.partitionBy("track_id")
    order = track.orderBy(F.desc("votes"), F.asc("first_frame"), F.asc("sku"))
    # A track's rows are its distinct products here, so one window pass replaces a second scan.
    top = (
        per_sku.withColumn("frames_scored", F.sum("votes").over(track))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
    )
    return top.select(
        "track_id",
        "rank",
        "sku",
        "votes",
        decimals(F.col("sim_sum") / F.col("votes"), 4).alias("avg_sim"),
        decimals(F.col("votes") / F.col("frames_scored"), 4).alias("confidence"),
    )


def compare_profiles(votes: DataFrame, profiles: dict[str, VoteProfile] = VOTE_PROFILES) -> DataFrame:
    """Decided and undecided tracks under each profile, in one pass over the votes.

    Profiles with the same vote minimum share their tallies; the profiles are expanded on the
    per-track rows, not on the votes.
    """
    by_min: dict[float, list[str]] = {}
    for name, p in profiles.items():
        by_min.setdefault(p.min_sim_vote, []).append(name)
    parts = []
    for names in by_min.values():
        outcomes = F.array(
            *[F.struct(F.lit(n).alias("profile"), _final_sku(profiles[n]).alias("final_sku")) for n in names]
        )
        parts.append(
            track_tallies(votes, profiles[names[0]])
            .select(F.explode(outcomes).alias("o"))
            .groupBy("o.profile")
            .agg(
                F.count(F.lit(1)).alias("total_tracks"),
                F.count_if(F.col("o.final_sku") != UNKNOWN).alias("matched"),
                F.count_if(F.col("o.final_sku") == UNKNOWN).alias("unknown"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def track_summary(decisions: DataFrame) -> DataFrame:
    """Totals over all tracks and the share that was matched."""
    matched = F.count_if(F.col("final_sku") != UNKNOWN)
    total = F.count(F.lit(1))
    return decisions.agg(
        total.alias("total_tracks"),
        matched.alias("matched"),
        F.count_if(F.col("final_sku") == UNKNOWN).alias("unknown"),
        decimals(F.when(total > 0, matched / total).otherwise(F.lit(0.0)), 4).alias("match_rate"),
    )


def track_summary_documents(
    votes: DataFrame, decisions: DataFrame, lifecycle: DataFrame | None = None, profile: VoteProfile = BALANCED
) -> DataFrame:
    """Nested per-track rows for the JSON sink: decision, vote map and at most five alternatives."""
    entries = (
        track_votes(votes, profile)
        .groupBy("track_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("sku", "votes"))).alias("votes"))
    )
    tops = (
        track_top_matches(votes, profile)
        .groupBy("track_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "sku", "votes", "avg_sim", "confidence"))).alias("t"))
        .select("track_id", F.transform("t", lambda m: m.dropFields("rank")).alias("top_matches"))
    )
    out = decisions.join(entries, "track_id", "left").join(tops, "track_id", "left")
    if lifecycle is not None:
        out = out.join(lifecycle.select("track_id", "ended_reason"), "track_id", "left")
    return out
