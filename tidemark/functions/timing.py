"""Rules about time and urgency as Column factories; ``now`` is always a parameter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_between(earlier: Column, later: Column) -> Column:
    """Exact days, as a double."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000.0)


@dataclass(frozen=True)
class Bands:
    """Knobs of urgency: how much of a page of ``cap`` rows may roll before the next visit."""

    cap: int = 30
    fraction: float = 0.5
    hot_fraction: float = 0.3
    hot_rate: float = 1.0
    fast_rate: float = 2.0
    fast_days: float = 1.5
    hot_days: float = 3.0
    starved_days: float = 30.0


def safety_fraction(rate: Column, bands: Bands = Bands()) -> Column:
    return F.when(rate >= bands.hot_rate, bands.hot_fraction).otherwise(bands.fraction)


def due_after_days(rate: Column, near_miss: Column, bands: Bands = Bands()) -> Column:
    """Days until a key is due; null without a positive rate."""
    plan = F.lit(float(bands.cap)) / F.when(rate > 0, rate) * safety_fraction(rate, bands)
    ceiling = F.when(rate >= bands.fast_rate, bands.fast_days).when(rate >= bands.hot_rate, bands.hot_days)
    return F.least(plan, ceiling) / F.when(near_miss, 2.0).otherwise(1.0)


def burn_due(staleness: Column, rate: Column, near_miss: Column, bands: Bands = Bands()) -> Column:
    return F.coalesce(staleness >= due_after_days(rate, near_miss, bands), F.lit(False))


def at_risk(staleness: Column, rate: Column, fraction: float, bands: Bands = Bands()) -> Column:
    """Strictly more of the page burnt than the fraction; blind to quarantine."""
    return F.coalesce((rate > 0) & (staleness * rate > bands.cap * fraction), F.lit(False))


# Bases of the score's tiers.
BURN_TIER, ASKED_TIER, UNVISITED_TIER, CAP_TIER, STARVED_TIER = 3_000_000.0, 2_750_000.0, 2_500_000.0, 2_000_000.0, 1_000_000.0


def priority_score(staleness: Column, rate: Column, at_cap: Column, asked: Column, near_miss: Column, bands: Bands = Bands()) -> Column:
    """The tiered score; null staleness means never visited."""
    rate0 = F.coalesce(rate, F.lit(0.0))
    return (
        F.when(staleness.isNull(), F.when(asked, ASKED_TIER).otherwise(UNVISITED_TIER))
        .when(burn_due(staleness, rate, near_miss, bands), BURN_TIER + staleness * rate0)
        .when(asked, ASKED_TIER + staleness)
        .when(at_cap, CAP_TIER + staleness)
        .when(staleness >= bands.starved_days, STARVED_TIER + staleness)
        .otherwise(staleness * (1 + rate0))
    )


def sentence_days(streak: Column, threshold: int = 3, longest: float = 30.0) -> Column:
    """Days of quarantine for a streak of failures: doubling from one day, null below the threshold."""
    doublings = F.least(F.greatest(streak - threshold, F.lit(0)), F.lit(5))
    return F.when(streak >= threshold, F.least(F.pow(F.lit(2.0), doublings), F.lit(longest)))


def gone_probe_due(gone_at: Column, probed_at: Column, now: Column, first_days: float = 1.0, cap_days: float = 30.0) -> Column:
    """A gone key is probed after a day, then after as long as it had been gone at the last probe, at most the cap."""
    fresh = probed_at.isNull() | (probed_at < gone_at)
    wait = F.least(days_between(gone_at, probed_at), F.lit(cap_days))
    return gone_at.isNotNull() & F.when(fresh, days_between(gone_at, now) >= first_days).otherwise(days_between(probed_at, now) >= wait)


def key_attributable(status: Column) -> Column:
    """Status codes that blame the key, not the site: 3xx and 4xx but 429."""
    return status.between(300, 499) & (status != 429)


def give_up(status: Column) -> Column:
    return status.between(400, 499) & (status != 429)


def rate_limited(status: Column) -> Column:
    return status.isin(429, 503)


def intake_outcome(known: Column, not_a_card: Column, delisted: Column, gone: Column, pending: Column) -> Column:
    return F.when(~known, "unknown").when(not_a_card, "not_a_card").when(delisted, "delisted").when(gone, "gone").when(pending, "already_pending").otherwise("accepted")


def intake_status(outcome: Column) -> Column:
    return F.when(outcome == "unknown", 404).when(outcome.isin("not_a_card", "delisted", "gone"), 410).when(outcome == "already_pending", 200).otherwise(202)
