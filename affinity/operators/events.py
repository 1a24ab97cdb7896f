"""Interaction-log operators: scans, typed splits, validity, latest-k.

S1/S2 scans, P4-P9 typed event views, U2/U3 unions, F1 valid events,
F2 orphan report, F3 non-empty guards, F16 seen items, F17 unavailable
items, W1 latest-1, W2 latest-k per user, A17 training profile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinity.config import CONSTRAINT_ENTITY_TYPE, CONTENT, COSMETIC, UNAVAILABLE_ENTITY_ID, Params

# events read per target kind (S1, S2); the misspelt cancel name is part of the log
CONTENT_EVENTS = ("view", "scrap", "play", "cancle_scrap", "cancel_scrap")
COSMETIC_EVENTS = ("own", "view", "scrap", "cancle_scrap", "cancel_scrap", "rate")


def scan(log: DataFrame, target_type: str, events) -> DataFrame:
    """Events of users on one item kind (filters reach the Parquet scan)."""
    return log.filter((F.col("target_type") == target_type) & F.col("event").isin(*events))


def epoch_millis(ts_col="ts"):
    """Event time as epoch milliseconds (session time zone UTC)."""
    return F.unix_millis(F.col(ts_col).cast("timestamp"))


def typed_events(log: DataFrame, params: Params = Params()) -> dict[str, DataFrame]:
    """P4-P8 + U2/U3: play, own, rate, view, scrap tables from one log."""
    content = scan(log, CONTENT, CONTENT_EVENTS)
    cosmetic = scan(log, COSMETIC, COSMETIC_EVENTS)
    base = ["user_id", "item_id", "ts", "event_id"]
    cancel = list(params.cancel_names)
    scrap_sel = lambda df: (df.filter(F.col("event").isin("scrap", *cancel))
                            .select(*base, (F.col("event") == "scrap").alias("scrap")))
    return {
        "play": content.filter(F.col("event") == "play").select(*base),
        "own": cosmetic.filter(F.col("event") == "own").select(*base),
        "rate": cosmetic.filter(F.col("event") == "rate").select(*base, F.col("rating").cast("double")),
        "view": content.filter(F.col("event") == "view").select(*base)
                .unionByName(cosmetic.filter(F.col("event") == "view").select(*base)),
        "scrap": scrap_sel(content).unionByName(scrap_sel(cosmetic)),
    }


def training_log(log: DataFrame, params: Params = Params()) -> DataFrame:
    """The events training reads, in one frame: (event, user_id, item_id, ts, event_id, rating).

    Equal to the union of P4-P8 (scrap/cancel spellings folded to 'scrap' /
    'cancel_scrap'); one scan instead of five.
    """
    cancel = list(params.cancel_names)
    tt, ev = F.col("target_type"), F.col("event")
    keep = (((tt == CONTENT) & ev.isin("view", "play", "scrap", *cancel)) |
            ((tt == COSMETIC) & ev.isin("view", "own", "rate", "scrap", *cancel)))
    # only spellings that the reference scans at all
    keep = keep & ev.isin(*(set(CONTENT_EVENTS) | set(COSMETIC_EVENTS)))
    return log.filter(keep).select(
        F.when(ev.isin(*cancel), F.lit("cancel_scrap")).otherwise(ev).alias("event"),
        "user_id", "item_id", "ts", "event_id", "rating")


def valid_events(events: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """keep events whose user and item are known entities (two semi joins)."""
    return (events.join(users.select("user_id"), "user_id", "left_semi")
                  .join(items.select("item_id"), "item_id", "left_semi"))


def orphan_events(events: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """one row per event with an unknown user and/or item."""
    u = users.select("user_id", F.lit(True).alias("_u"))
    i = items.select("item_id", F.lit(True).alias("_i"))
    j = events.join(u, "user_id", "left").join(i, "item_id", "left")
    missing = (F.when(F.col("_u").isNull() & F.col("_i").isNull(), "user,item")
               .when(F.col("_u").isNull(), "user").when(F.col("_i").isNull(), "item"))
    return (j.withColumn("missing", missing).filter(F.col("missing").isNotNull())
             .drop("_u", "_i"))


def require_nonempty(df: DataFrame, what: str) -> DataFrame:
    """fail early when a training input is empty."""
    if df.isEmpty():
        raise ValueError(f"{what} cannot be empty")
    return df


def seen_items(log: DataFrame, params: Params = Params()) -> DataFrame:
    """F16: distinct (user, item) pairs with a seen event (never undone by a cancel)."""
    if not params.unseen_only:
        return log.sparkSession.createDataFrame([], "user_id string, item_id string")
    return (log.filter(F.col("event").isin(*params.seen_events) &
                       F.col("target_type").isin(*params.target_types))
               .select("user_id", "item_id").distinct())


def latest_per_entity(prop_log: DataFrame, entity_type: str, entity_id: str | None = None,
                      event: str = "$set") -> DataFrame:
    """The newest event per entity (ties broken by event_id)."""
    df = prop_log.filter((F.col("entity_type") == entity_type) & (F.col("event") == event))
    if entity_id is not None:
        df = df.filter(F.col("entity_id") == entity_id)
    return (df.groupBy("entity_type", "entity_id")
              .agg(F.max_by(F.struct("ts", "event_id", "properties"),
                            F.struct("ts", "event_id")).alias("last"))
              .select("entity_type", "entity_id", "last.ts", "last.event_id", "last.properties"))


def unavailable_items(prop_log: DataFrame) -> DataFrame:
    """the items of the latest $set of constraint/unavailableItems (each replaces the last)."""
    latest = latest_per_entity(prop_log, CONSTRAINT_ENTITY_TYPE, UNAVAILABLE_ENTITY_ID)
    items = F.from_json(F.col("properties")["items"], "array<string>")
    return latest.select(F.explode(F.array_distinct(items)).alias("item_id"))


def recent_items(log: DataFrame, params: Params = Params(), users: DataFrame | None = None) -> DataFrame:
    """Per user, the distinct items of the newest `recent_limit` similar events.

    ``row_number() <= k`` plans a map-side partial limit (WindowGroupLimit)
    before the shuffle, so a heavy user ships at most k rows per partition.
    """
    ev = log.filter(F.col("event").isin(*params.similar_events) &
                    F.col("target_type").isin(*params.target_types))
    if users is not None:
        ev = ev.join(users.select("user_id").distinct(), "user_id", "left_semi")
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    k = int(params.recent_limit)
    return (ev.select("user_id", "item_id", "ts", "event_id")
              .withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
              .select("user_id", "item_id").distinct())


def profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count and two sample keys (smallest and largest) per training table,
    one partially aggregated job over a tagged union."""
    def key(df: DataFrame):
        cols = [c for c in ("user_id", "item_id") if c in df.columns]
        return F.concat_ws("|", *cols)

    parts = [df.select(F.lit(name).alias("table_name"), key(df).alias("k")) for name, df in tables.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_rows"), F.min("k").alias("first_key"),
                                       F.max("k").alias("last_key"))


def sample_rows(tables: dict[str, DataFrame], n: int = 2) -> DataFrame:
    """(table_name, sample) of the first ``n`` rows of each training table by their own key columns.

    Each table is cut by a distributed top-n (no shuffle, no sort of the whole
    table); equal rows are each a sample; an empty table has none.
    """
    out = None
    for name, df in tables.items():
        cols = [c for c in ("user_id", "item_id", "event_id") if c in df.columns]
        few = (df.select(*cols).orderBy(*cols).limit(n)
               .select(F.lit(name).alias("table_name"), F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).alias("sample")))
        out = few if out is None else out.unionByName(few)
    return out
