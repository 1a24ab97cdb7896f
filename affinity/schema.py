"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

STR_ARRAY = T.ArrayType(T.StringType())
VECTOR = T.ArrayType(T.DoubleType())

# raw event as posted to an event collector (JSON); properties keep their JSON text
RAW_EVENT = T.StructType([
    T.StructField("eventId", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("entityType", T.StringType()),
    T.StructField("entityId", T.StringType()),
    T.StructField("targetEntityType", T.StringType()),
    T.StructField("targetEntityId", T.StringType()),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    T.StructField("eventTime", T.StringType()),
])

# user -> item interactions (view, play, own, rate, scrap, cancel_scrap, ...)
LOG = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("event", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("target_type", T.StringType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("ts", T.TimestampType()),
])

# entity property events ($set / $unset / $delete)
PROPERTY_LOG = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("entity_type", T.StringType()),
    T.StructField("entity_id", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
])

USERS = T.StructType([T.StructField("user_id", T.StringType())])

ITEMS = T.StructType([
    T.StructField("item_id", T.StringType()),
    T.StructField("item_type", T.StringType()),
    T.StructField("categories", STR_ARRAY),
    T.StructField("brand", T.StringType()),
    T.StructField("cosmetics", STR_ARRAY),
    T.StructField("upload_date", T.StringType()),
])

REQUEST = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("num", T.IntegerType()),
    T.StructField("item_type", T.StringType()),
    T.StructField("search", T.StringType()),
    T.StructField("result_type", T.StringType()),
    T.StructField("cosmetic", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("categories", STR_ARRAY),
    T.StructField("white_list", STR_ARRAY),
    T.StructField("black_list", STR_ARRAY),
])

# request as JSON, field names of the query API
REQUEST_JSON = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("num", T.IntegerType()),
    T.StructField("item_type", T.StringType()),
    T.StructField("search", T.StringType()),
    T.StructField("result_type", T.StringType()),
    T.StructField("cosmetic", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("categories", STR_ARRAY),
    T.StructField("whiteList", STR_ARRAY),
    T.StructField("blackList", STR_ARRAY),
])

SCORED = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("score", T.DoubleType()),
])
