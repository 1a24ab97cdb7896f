"""Live state between trainings (L1-L4) with Structured Streaming.

The engine reads three things at answer time -- a user's seen items, a
user's recent items and the unavailable-items constraint -- and popularity
can be kept current the same way. Each is a streaming job over the event
source whose final state equals the batch operator on the same rows, whatever
the order of arrival; the registered ``live_*`` queries check exactly that over
several micro-batches.

* L1 seen: ``dropDuplicates(user, item)``; a batch's new pairs are its run, laid
  out by a hash bucket of the user.
* L2 recent: keyed state per user, the newest k events by (time, id), so late
  events find their place. A batch's run holds the lists that changed.
* L3 constraint: a streaming ``max_by`` aggregate per constraint entity
  (complete mode; one row per entity).
* L4 popularity: views, plays and scraps only add, so they are sums of the batch.
  Own x rating does not (the latest rating replaces the one before), so what each
  (user, item) pair owns and its latest rating are a table of runs beside them: a batch
  joins the pairs it touches and adds the difference of their worth after and before.
  A batch's run holds the change per touched item.

Keyed state is in RocksDB, off the heap, with changelog checkpoints in the shared
folder: a batch writes the keys it touches, not the state. What readers see are
runs (``streaming.runs``): per batch the changes, merged by levels. A batch that is
replayed after a failure starts from the state before it and writes its own run
again.
"""

from __future__ import annotations

import heapq
import uuid
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from affinity.config import CONSTRAINT_ENTITY_TYPE, UNAVAILABLE_ENTITY_ID, Params
from affinity.operators import events as ev
from affinity.operators import weights as wt
from affinity.queries import register
from affinity.session import checkpoint_dir
from affinity.sources.fixtures import TABLE_SCHEMAS, events_to_log, load
from affinity.streaming.runs import Runs, list_dir, remove

EVENT_SCHEMA = TABLE_SCHEMAS["events"]
#: Folders of a run of seen pairs; a reader of few users reads only theirs.
SEEN_BUCKETS = 16
#: Popularity changes are added and taken back as decimals, so what is taken back leaves no rest.
CHANGE = "decimal(38,10)"

_KEYED = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _keyed_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's own settings come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in _KEYED}
    for k, v in _KEYED.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def event_stream(spark: SparkSession, folder: str, file_glob: str = "events.parquet",
                 max_files: int | None = None) -> DataFrame:
    """The raw event table read as a stream of Parquet files."""
    r = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", file_glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.parquet(folder)


def _workdir(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/live/{name}-{uuid.uuid4().hex[:12]}"


def _join(*parts: str) -> str:
    return "/".join(p.rstrip("/") for p in parts)


def _run(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def _to_runs(changes: DataFrame, mode: str, runs: Runs, ckpt: str, last=lambda df: df):
    """Start the query that writes each micro-batch (after ``last``) as a run."""
    def step(batch: DataFrame, batch_id: int) -> None:
        runs.add(last(batch.withColumn("_batch", F.lit(batch_id).cast("long"))), batch_id)

    with _keyed_state(changes.sparkSession):
        return (changes.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", ckpt)
                .trigger(availableNow=True).start())


# ---- L1 -------------------------------------------------------------------

_SEEN_SCHEMA = "user_id string, item_id string, bucket int"


def _seen_runs(root: str) -> Runs:
    return Runs(root, fold=lambda df: df, by=("bucket",))


def _user_bucket(user):
    return F.pmod(F.xxhash64(user), F.lit(SEEN_BUCKETS)).cast("int")


def live_seen(log_stream: DataFrame, root: str, ckpt: str, params: Params = Params()):
    seen = (log_stream.filter(F.col("event").isin(*params.seen_events) &
                              F.col("target_type").isin(*params.target_types))
            .select("user_id", "item_id").dropDuplicates(["user_id", "item_id"])
            .withColumn("bucket", _user_bucket("user_id")))
    return _to_runs(seen, "append", _seen_runs(root), ckpt, lambda df: df.drop("_batch"))


def seen_table(spark: SparkSession, root: str, users: list[str] | None = None) -> DataFrame:
    """The distinct (user, item) pairs seen so far; of a short list of ``users`` from their buckets alone."""
    table = _seen_runs(root).read(spark, _SEEN_SCHEMA)
    if users is not None:
        wanted = [F.lit(u) for u in users]
        table = table.filter(F.col("bucket").isin(*(_user_bucket(u) for u in wanted)) & F.col("user_id").isin(*users))
    return table.select("user_id", "item_id")


# ---- L2 -------------------------------------------------------------------

_RECENT_SCHEMA = "user_id string, items array<string>, _batch long"


def _latest_lists(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id").agg(F.max_by("items", "_batch").alias("items"), F.max("_batch").alias("_batch"))


def _newest(k: int):
    """Keyed state of a user: time, id and item of the newest k events, newest first."""
    def update(key, frames, state):
        before = list(zip(*state.get)) if state.exists else []
        held = before
        for frame in frames:
            rows = zip(frame["at"].tolist(), frame["event_id"].tolist(), frame["item_id"].tolist())
            held = heapq.nlargest(k, [*held, *rows], key=lambda r: r[:2])
        if held != before:
            state.update(tuple(list(c) for c in zip(*held)))
            yield pd.DataFrame({"user_id": [key[0]], "items": [[r[2] for r in held]]})
    return update


def live_recent(log_stream: DataFrame, root: str, ckpt: str, params: Params = Params()):
    new = (log_stream.filter(F.col("event").isin(*params.similar_events) & F.col("target_type").isin(*params.target_types))
           .select("user_id", "item_id", wt.event_micros().alias("at"),
                   F.coalesce("event_id", F.lit(-(1 << 63))).alias("event_id")))
    lists = new.groupBy("user_id").applyInPandasWithState(
        _newest(int(params.recent_limit)), "user_id string, items array<string>",
        "at array<long>, event_id array<long>, item_id array<string>", "update", GroupStateTimeout.NoTimeout)
    return _to_runs(lists, "update", Runs(root, _latest_lists), ckpt)


def recent_table(spark: SparkSession, root: str) -> DataFrame:
    """Each user's distinct items among the newest events, as W2 gives them."""
    table = Runs(root, _latest_lists).read(spark, _RECENT_SCHEMA)
    return table.select("user_id", F.explode(F.array_distinct("items")).alias("item_id"))


# ---- L3 -------------------------------------------------------------------

def _versions(root: str):
    return lambda batch_id: f"{root}/v{batch_id:08d}"


def live_constraint(prop_stream: DataFrame, root: str, ckpt: str):
    version = _versions(root)
    latest = (prop_stream.filter((F.col("event") == "$set") & (F.col("entity_type") == CONSTRAINT_ENTITY_TYPE)
                                 & (F.col("entity_id") == UNAVAILABLE_ENTITY_ID))
              .groupBy("entity_type", "entity_id")
              .agg(F.max_by(F.col("properties")["items"], F.struct("ts", "event_id")).alias("items")))

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(version(batch_id))
        if batch_id > 1:  # the last two versions stay
            remove(batch.sparkSession, version(batch_id - 2))

    return (latest.writeStream.outputMode("complete").foreachBatch(step).option("checkpointLocation", ckpt)
            .trigger(availableNow=True).start())


def _latest_version(spark: SparkSession, root: str) -> DataFrame:
    names = sorted(n for n in list_dir(spark, root) if n.startswith("v"))
    if not names:
        raise RuntimeError(f"no state written under {root}")
    return spark.read.parquet(_join(root, names[-1]))


# ---- L4 -------------------------------------------------------------------

_POPULARITY_SCHEMA = f"item_id string, change {CHANGE}"


def _sum_changes(df: DataFrame) -> DataFrame:
    return df.groupBy("item_id").agg(F.sum("change").cast(CHANGE).alias("change"))


_PAIR_SCHEMA = "user_id string, item_id string, own double, last struct<rating:double>, at decimal(38,0)"


def _latest_pairs(df: DataFrame) -> DataFrame:
    """What a pair owns and its latest rating; folds of disjoint batches fold to that of all."""
    return df.groupBy("user_id", "item_id").agg(F.sum("own").alias("own"), F.max_by("last", "at").alias("last"), F.max("at").alias("at"))


def _worth(center: float, side: str) -> Column:
    """Own x (latest rating - centre), whichever there is, else 0."""
    own, rate = F.col(f"{side}.own"), F.col(f"{side}.last.rating") - F.lit(center)
    return F.coalesce(own * rate, own, rate, F.lit(0.0))


def live_popularity(log_stream: DataFrame, users: DataFrame, items: DataFrame, root: str, ckpt: str,
                    params: Params = Params()):
    valid = ev.valid_events(ev.training_log(log_stream, params), users, items)
    adds = {"view": params.pop_view_weight, "play": params.pop_play_weight, "scrap": params.pop_scrap_weight,
            "cancel_scrap": params.pop_cancel_weight}
    weight = F.coalesce(*(F.when(F.col("event") == e, F.lit(float(w))) for e, w in adds.items()))
    held = Runs(_join(root, "pairs"), _latest_pairs)
    changes = Runs(root, _sum_changes)
    keys = ["user_id", "item_id"]
    exact = lambda c: c.cast("decimal(28,10)")

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        linear = batch.filter(F.col("event").isin(*adds)).select("item_id", exact(weight).alias("change"))
        rate = F.col("event") == "rate"
        rating = F.col("rating").cast("double")
        # a rating without a value replaces the one before all the same, so it is held in a struct
        at = F.when(rate, wt.event_order(event_id="_id"))
        pairs = _latest_pairs(
            batch.filter(F.col("event").isin("own", "rate")).withColumn("_id", F.coalesce("event_id", F.lit(-(1 << 63))))
            .select(*keys, F.when(~rate, F.lit(float(params.own_weight))).alias("own"),
                    F.when(rate, F.struct(F.when(~F.isnan(rating), rating).alias("rating"))).alias("last"), at.alias("at")))
        # the pairs' state as it was before this batch, also when the batch is replayed
        old = held.read(spark, _PAIR_SCHEMA, before=batch_id)
        held.add(pairs, batch_id)
        new = held.run(spark, batch_id, _PAIR_SCHEMA)
        touched = (old.join(new.select(*keys), keys, "left_semi").withColumn("_new", F.lit(False))
                   .unionByName(new.withColumn("_new", F.lit(True))))
        state = lambda some: F.struct(F.sum(F.when(some, F.col("own"))).alias("own"),
                                      F.max_by("last", F.when(some, F.col("at"))).alias("last"))
        both = touched.groupBy(*keys).agg(state(F.lit(True)).alias("after"), state(~F.col("_new")).alias("before"),
                                          F.min("_new").alias("first"))
        center = float(params.rating_center)
        after, was = exact(_worth(center, "after")), exact(_worth(center, "before"))
        replaced = both.filter(F.col("first") | (after != was)).select("item_id", (after - was).alias("change"))
        changes.add(_sum_changes(linear.unionByName(replaced)), batch_id)

    return (valid.writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", ckpt)
            .trigger(availableNow=True).start())


def popularity_table(spark: SparkSession, root: str) -> DataFrame:
    """(item_id, popularity) of every item with a training event so far."""
    table = Runs(root, _sum_changes).read(spark, _POPULARITY_SCHEMA)
    return table.select("item_id", F.col("change").cast("double").alias("popularity"))


# ---- registered queries: final streaming state vs. the batch oracle --------

def _arriving(spark, sf_dir, work):
    """The event table as a stream of about four micro-batches, in no order of time."""
    t = load(spark, sf_dir)
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4)
    folder = _join(work, "incoming")
    t.raw("events").repartition(files, F.xxhash64("event_id")).write.parquet(folder)
    return t, events_to_log(event_stream(spark, folder, "*.parquet", -(-files // 4)), t.part_names)


@register("live_seen")
def q_live_seen(spark, sf_dir):
    work = _workdir(spark, "seen")
    _, stream = _arriving(spark, sf_dir, work)
    _run(live_seen(stream, _join(work, "state"), _join(work, "ckpt")))
    return seen_table(spark, _join(work, "state"))


@register("live_recent")
def q_live_recent(spark, sf_dir):
    work = _workdir(spark, "recent")
    _, stream = _arriving(spark, sf_dir, work)
    _run(live_recent(stream, _join(work, "state"), _join(work, "ckpt")))
    return recent_table(spark, _join(work, "state"))


@register("live_constraint")
def q_live_constraint(spark, sf_dir):
    t = load(spark, sf_dir)
    work = _workdir(spark, "constraint")
    incoming = _join(work, "incoming")
    # constraint events among the users' property events, as they arrive
    t.constraint_log.unionByName(t.property_log).write.parquet(incoming)
    stream = spark.readStream.schema(t.constraint_log.schema).parquet(incoming)
    _run(live_constraint(stream, _join(work, "state"), _join(work, "ckpt")))
    state = _latest_version(spark, _join(work, "state"))
    return state.select(F.explode(F.array_distinct(F.from_json("items", "array<string>"))).alias("item_id"))


@register("live_popularity")
def q_live_popularity(spark, sf_dir):
    work = _workdir(spark, "popularity")
    t, stream = _arriving(spark, sf_dir, work)
    _run(live_popularity(stream, t.users, t.items, _join(work, "state"), _join(work, "ckpt")))
    return popularity_table(spark, _join(work, "state"))
