"""JSON event and request sources/sinks (S7, S8, S10) and model tables.

Raw events are JSON documents with the fields of an event collector:
``eventId, event, entityType, entityId, targetEntityType, targetEntityId,
properties{}, eventTime`` (ISO-8601). ``properties`` is read as
map<string,string>: Spark's JSON reader keeps a nested value (array,
object, number) as its JSON text and a JSON string unquoted, so every
property can be parsed by name with ``from_json`` / ``cast`` later.

``normalize`` splits a raw event frame into the interaction log (user ->
item events) and the property log ($set / $unset / $delete on entities).
Both work on batch and streaming frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity import schema
from affinity.session import stage

PROPERTY_EVENTS = ("$set", "$unset", "$delete")


def read_events_json(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Raw events from JSON lines (batch, or a file stream with ``stream=True``)."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema.RAW_EVENT).json(path)


def event_order_id(raw: DataFrame):
    """A long tie-break id: the numeric eventId itself, else a hash of its text; without one, of the whole document."""
    c = F.col("eventId")
    whole = F.xxhash64(*[F.to_json(x) if t.startswith("map") else F.col(x) for x, t in raw.dtypes])
    return F.coalesce(c.try_cast("long"), F.when(c.isNotNull(), F.xxhash64(c)).otherwise(whole))


def normalize(raw: DataFrame, user_type: str = "user", missing_rating: str = "raise") -> tuple[DataFrame, DataFrame]:
    """Raw events -> (interaction log, property log).

    Only events of entities of ``user_type`` are interactions. A rate event
    without a numeric rating is an error, or is left out with ``missing_rating="drop"``.
    """
    ts = F.to_timestamp(F.col("eventTime")).cast("timestamp_ntz")
    rating = F.col("properties")["rating"].try_cast("double")
    unrated = (F.col("event") == "rate") & rating.isNull()
    base = raw.withColumn("event_id", event_order_id(raw)).withColumn("ts", ts)
    if missing_rating == "drop":
        base = base.filter(~F.coalesce(unrated, F.lit(False)))
    else:
        told = F.concat(F.lit("rate event without a rating: user "), F.coalesce("entityId", F.lit("?")))
        rating = F.when(unrated, F.raise_error(told).cast("double")).otherwise(rating)
    log = (base.filter(~F.col("event").isin(*PROPERTY_EVENTS) & F.col("targetEntityId").isNotNull()
                       & (F.col("entityType") == user_type))
           .select("event_id", "event", F.col("entityId").alias("user_id"),
                   F.col("targetEntityType").alias("target_type"), F.col("targetEntityId").alias("item_id"),
                   rating.alias("rating"), "ts"))
    props = (base.filter(F.col("event").isin(*PROPERTY_EVENTS))
             .select("event_id", "ts", F.col("entityType").alias("entity_type"),
                     F.col("entityId").alias("entity_id"), "event",
                     F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties")))
    return log, props


def log_to_json_events(log: DataFrame, user_type: str = "user") -> DataFrame:
    """Interaction log -> raw event rows (the writer side of S8)."""
    props = F.when(F.col("rating").isNotNull(),
                   F.create_map(F.lit("rating"), F.col("rating").cast("string")))
    return log.select(
        F.col("event_id").cast("string").alias("eventId"), "event", F.lit(user_type).alias("entityType"),
        F.col("user_id").alias("entityId"), F.col("target_type").alias("targetEntityType"),
        F.col("item_id").alias("targetEntityId"), props.alias("properties"),
        F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("eventTime"))


def property_log_to_json_events(prop_log: DataFrame) -> DataFrame:
    return prop_log.select(
        F.col("event_id").cast("string").alias("eventId"), "event", F.col("entity_type").alias("entityType"),
        F.col("entity_id").alias("entityId"), F.lit(None).cast("string").alias("targetEntityType"),
        F.lit(None).cast("string").alias("targetEntityId"), "properties",
        F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("eventTime"))


def write_events_json(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").json(path)


def read_requests_json(spark: SparkSession, path: str) -> DataFrame:
    """Requests as JSON objects with the query API's field names.

    A request without ``request_id`` gets one of its own, by its place in the
    input, so equal requests stay apart; the rows are staged with it, so it is the
    same wherever they are read again.
    """
    raw = spark.read.schema(schema.REQUEST_JSON).json(path)
    raw = stage(raw.withColumn("_place", F.monotonically_increasing_id()), "requests_json")
    rid = F.coalesce(F.col("request_id"), F.concat(F.lit("request at "), F.col("_place").cast("string")))
    return raw.select(
        rid.alias("request_id"), F.col("user").alias("user_id"), "num", "item_type", "search", "result_type",
        "cosmetic", "brand", "categories", F.col("whiteList").alias("white_list"),
        F.col("blackList").alias("black_list"))


def requests_to_json(requests: DataFrame) -> DataFrame:
    return requests.select(
        "request_id", F.col("user_id").alias("user"), "num", "item_type", "search", "result_type", "cosmetic",
        "brand", "categories", F.col("white_list").alias("whiteList"), F.col("black_list").alias("blackList"))
