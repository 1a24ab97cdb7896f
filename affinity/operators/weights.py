"""User-item affinity and item popularity (A2-A13, J4, RW3).

All parts come out of ONE aggregation of the training log by (user, item):
sums of view/play/own weights, the latest rating and the latest scrap state
(``max_by`` over (ts, event_id)), and the signed scrap count for popularity.
The aggregation is partial + final, so a hot user or item is combined
map-side. Popularity is a second aggregation of these pair rows by item.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.config import Params


def event_micros(ts="ts") -> Column:
    """A timestamp as microseconds since 1970, of either timestamp type."""
    t = F.col(ts)
    seconds = F.unix_date(F.to_date(t)).cast("long") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("long")


def event_order(ts="ts", event_id="event_id") -> Column:
    """(ts, event_id) as one DECIMAL(38,0): microseconds x 2^64 + the id shifted to be positive.

    A fixed-width key can be updated in place, so aggregations that keep the
    latest value hash instead of sorting the log.
    """
    wide = lambda c, kind: c.cast(kind)
    return (wide(event_micros(ts), "decimal(18,0)") * F.lit(Decimal(1 << 64)).cast("decimal(20,0)")
            + wide(F.col(event_id), "decimal(20,0)") + F.lit(Decimal(1 << 63)).cast("decimal(20,0)")).cast("decimal(38,0)")


def pair_stats(train_log: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per (user, item) with every per-pair part; input is a valid training log
    (see ``events.training_log`` + ``events.valid_events``)."""
    ev = F.col("event")
    is_scrap = ev.isin("scrap", "cancel_scrap")
    at = F.col("_at")
    return train_log.withColumn("_at", event_order()).groupBy("user_id", "item_id").agg(
        F.sum(F.when(ev == "view", F.lit(params.view_weight))).alias("view_part"),
        F.sum(F.when(ev == "play", F.lit(params.play_weight))).alias("play_part"),
        F.sum(F.when(ev == "own", F.lit(params.own_weight))).alias("own_part"),
        F.max_by(F.col("rating"), F.when(ev == "rate", at)).alias("latest_rating"),
        F.max(F.when(ev == "rate", F.lit(True))).alias("has_rate"),
        F.max(F.when(ev == "rate", at)).alias("rate_at"),
        F.max_by(ev == "scrap", F.when(is_scrap, at)).alias("latest_scrap"),
        F.max(F.when(is_scrap, at)).alias("scrap_at"),
        F.sum(F.when(ev == "view", F.lit(params.pop_view_weight))).alias("pop_view"),
        F.sum(F.when(ev == "play", F.lit(params.pop_play_weight))).alias("pop_play"),
        F.sum(F.when(ev == "scrap", F.lit(params.pop_scrap_weight))
               .when(ev == "cancel_scrap", F.lit(params.pop_cancel_weight))).alias("pop_scrap"),
    )


def merge_pair_stats(a: DataFrame, b: DataFrame) -> DataFrame:
    """Combine two pair-stat tables of disjoint event sets (the stats are a monoid):
    sums add, the latest rating / scrap state is the one with the larger (ts, event_id)."""
    u = a.unionByName(b)
    return u.groupBy("user_id", "item_id").agg(
        F.sum("view_part").alias("view_part"), F.sum("play_part").alias("play_part"),
        F.sum("own_part").alias("own_part"),
        F.max_by("latest_rating", "rate_at").alias("latest_rating"), F.max("has_rate").alias("has_rate"),
        F.max("rate_at").alias("rate_at"),
        F.max_by("latest_scrap", "scrap_at").alias("latest_scrap"), F.max("scrap_at").alias("scrap_at"),
        F.sum("pop_view").alias("pop_view"), F.sum("pop_play").alias("pop_play"),
        F.sum("pop_scrap").alias("pop_scrap"))


def rate_part(params: Params = Params()) -> Column:
    """Latest rating minus the centre; NULL without a rating."""
    return F.when(F.col("has_rate"), F.col("latest_rating") - F.lit(params.rating_center))


def scrap_part(params: Params = Params()) -> Column:
    """A4: the latest scrap event decides: scrap -> 2.0, cancel -> 0.0 (row kept)."""
    return F.when(F.col("latest_scrap").isNull(), F.lit(None).cast("double")).when(
        F.col("latest_scrap"), F.lit(params.scrap_weight)).otherwise(F.lit(params.cancelled_scrap_weight))


def rate_own_part(params: Params = Params()) -> Column:
    """Own x rate where both exist, else whichever exists (full-outer semantics)."""
    own, rate = F.col("own_part"), rate_part(params)
    return (F.when(own.isNotNull() & rate.isNotNull(), own * rate)
            .when(own.isNotNull(), own).otherwise(rate))


def affinity_from_stats(stats: DataFrame, params: Params = Params()) -> DataFrame:
    """Σ of rate×own, view, scrap and play parts per pair (may be 0 or negative)."""
    parts = [rate_own_part(params), F.col("view_part"), scrap_part(params), F.col("play_part")]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    return stats.select("user_id", "item_id", total.alias("rating"))


def popularity_from_stats(stats: DataFrame, params: Params = Params()) -> DataFrame:
    """Σ over users of rate×own, +1 per view, +1 per play, ±2 per scrap event."""
    row = (F.coalesce(rate_own_part(params), F.lit(0.0)) + F.coalesce("pop_view", F.lit(0.0)) +
           F.coalesce("pop_play", F.lit(0.0)) + F.coalesce("pop_scrap", F.lit(0.0)))
    return stats.groupBy("item_id").agg(F.sum(row).alias("popularity"))


def popularity_parts(stats: DataFrame, params: Params = Params()) -> DataFrame:
    """A9..A12 side by side per item (NULL where an item has no such part)."""
    return stats.groupBy("item_id").agg(
        F.sum(rate_own_part(params)).alias("pop_rate_own"),
        F.sum("pop_view").alias("pop_view"),
        F.sum("pop_play").alias("pop_play"),
        F.sum("pop_scrap").alias("pop_scrap"))


def affinity_part(stats: DataFrame, part: str, params: Params = Params()) -> DataFrame:
    """A2-A7 one at a time: rows of pairs that have the part."""
    col = {
        "view": F.col("view_part"), "play": F.col("play_part"), "own": F.col("own_part"),
        "rate": rate_part(params), "scrap": scrap_part(params), "rate_own": rate_own_part(params),
    }[part]
    return stats.select("user_id", "item_id", col.alias("rating")).filter(F.col("rating").isNotNull())
