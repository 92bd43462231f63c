"""Threshold rules: identification status, split policy, track acceptance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class IdentifyProfile:
    """Thresholds of the identification and of the split policy."""

    match: float = 0.28
    unknown: float = 0.20
    margin: float = 0.02
    split_delta: float = 0.05
    split_low: float = 0.25
    split_high: float = 0.45
    split_quality: float = 0.6


# Identification profiles.
IDENTIFY_PROFILES = {
    "catalog_only": IdentifyProfile(match=0.30, unknown=0.22, margin=0.015, split_delta=0.03),
    "shelf_video": IdentifyProfile(),
    "low_light": IdentifyProfile(match=0.25, unknown=0.18, margin=0.025, split_delta=0.06),
}


@dataclass(frozen=True)
class VoteProfile:
    """Thresholds of the per-track decision."""

    min_frames: int
    min_confidence: float
    min_avg_sim: float
    min_sim_vote: float
    high_sim: float


# Track decision profiles; an unknown name means the strict one.
VOTE_PROFILES = {
    "SHELF_STRICT": VoteProfile(3, 0.60, 0.28, 0.30, 0.90),
    "WAREHOUSE_LENIENT": VoteProfile(2, 0.50, 0.25, 0.30, 0.90),
    "WAREHOUSE_BALANCED": VoteProfile(2, 0.55, 0.26, 0.30, 0.88),
}


def vote_profile(name: str) -> VoteProfile:
    return VOTE_PROFILES.get(name.upper(), VOTE_PROFILES["SHELF_STRICT"])


def identify_status(s1: Column, s2: Column, match: Column, unknown: Column, margin: Column) -> Column:
    """matched / ambiguous / unknown from the two best similarities; no candidate is unknown."""
    return (
        F.when(s1.isNull() | (s1 < unknown), F.lit("unknown"))
        .when(s1 < match, F.lit("ambiguous"))
        .when(s2.isNotNull() & (s1 - s2 < margin), F.lit("ambiguous"))
        .otherwise(F.lit("matched"))
    )


def profile_status(s1: Column, s2: Column, p: IdentifyProfile) -> Column:
    return identify_status(s1, s2, F.lit(p.match), F.lit(p.unknown), F.lit(p.margin))


def should_split(status: Column, conf: Column, quality: Column, p: IdentifyProfile) -> Column:
    """A doubtful result, with similarity in the doubtful band, on a box that looks mixed."""
    settled = (status == "matched") & (conf >= F.lit(p.match))
    in_band = (conf >= F.lit(p.split_low)) & (conf <= F.lit(p.split_high))
    return ~settled & in_band & (quality >= F.lit(p.split_quality))


def left_is_best(status_l: Column, conf_l: Column, status_r: Column, conf_r: Column) -> Column:
    """A matched half beats one that is not; otherwise the higher similarity, ties to the left."""
    l_ok, r_ok = status_l == "matched", status_r == "matched"
    return F.when(l_ok & ~r_ok, F.lit(True)).when(r_ok & ~l_ok, F.lit(False)).otherwise(conf_l >= conf_r)


def split_accepted(
    status: Column, conf: Column, best_status: Column, best_conf: Column, p: IdentifyProfile
) -> Column:
    """Newly matched, or better by the required step; a settled full result is never replaced."""
    settled = (status == "matched") & (conf >= F.lit(p.match))
    newly = (best_status == "matched") & (status != "matched")
    return ~settled & (newly | (best_conf >= conf + F.lit(p.split_delta)))


def track_accepted(
    scored: Column, top_votes: Column, sim_sum: Column, frames: Column, confidence: Column, avg_sim: Column, high: Column
) -> Column:
    """Enough agreeing frames, or a very high mean similarity on at least one scored frame."""
    share = top_votes / scored
    mean = sim_sum / top_votes
    by_agreement = (scored >= frames) & (share >= confidence) & (mean >= avg_sim)
    return (scored > 0) & (by_agreement | (mean >= high))
