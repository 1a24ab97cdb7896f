"""Live state over several micro-batches equals the batch operators (L1-L4)."""

import os
import tempfile

from pyspark.sql import functions as F

from affinity.operators import events as ev
from affinity.operators import weights as wt
from affinity.plans import model as md
from affinity.sources.fixtures import TABLE_SCHEMAS, events_to_log, load
from affinity.streaming import live
from tests.conftest import SF_SMALL


def _split_events(spark, parts=4):
    """The events table split into several files, so the stream has several batches."""
    folder = tempfile.mkdtemp(prefix="affinity-events-", dir="/tmp")
    e = spark.read.schema(TABLE_SCHEMAS["events"]).parquet(f"{SF_SMALL}/events.parquet")
    for k in range(parts):
        e.filter(F.col("event_id") % parts == k).coalesce(1).write.parquet(os.path.join(folder, f"part{k}"))
        # flatten: the file source reads files of one folder
    flat = tempfile.mkdtemp(prefix="affinity-flat-", dir="/tmp")
    i = 0
    for k in range(parts):
        sub = os.path.join(folder, f"part{k}")
        for name in sorted(os.listdir(sub)):
            if name.endswith(".parquet"):
                os.link(os.path.join(sub, name), os.path.join(flat, f"events-{i}.parquet"))
                i += 1
    return flat


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def _stream(spark, folder, t):
    return events_to_log(live.event_stream(spark, folder, file_glob="events-*.parquet", max_files=1), t.part_names)


def _popularity(t):
    return wt.popularity_from_stats(wt.pair_stats(md.valid_training_log(md.TrainingData(t.users, t.items, t.log))))


def _rounded(df):
    return sorted((r.item_id, round(r.popularity, 6) + 0.0) for r in df.collect())


def test_multi_batch_state_equals_batch(spark):
    """Four files dealt by id, so every batch but the first brings late events; the jobs stop after two and start again."""
    t = load(spark, SF_SMALL)
    flat = _split_events(spark)
    arriving = tempfile.mkdtemp(prefix="affinity-arriving-", dir="/tmp")
    names = sorted(os.listdir(flat))
    work = tempfile.mkdtemp(prefix="affinity-live-", dir="/tmp")
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    for some in (names[:2], names[2:]):
        for n in some:
            os.link(os.path.join(flat, n), os.path.join(arriving, n))
        live._run(live.live_recent(_stream(spark, arriving, t), f"{work}/recent", f"{work}/ck1"))
        live._run(live.live_popularity(_stream(spark, arriving, t), t.users, t.items, f"{work}/pop", f"{work}/ck2"))
        live._run(live.live_seen(_stream(spark, arriving, t), f"{work}/seen", f"{work}/ck3"))
    for state in ("recent", "pop", "seen"):
        assert len(live.Runs(f"{work}/{state}", lambda df: df).cover(spark)) == len(names) == 4
    # keyed state is in RocksDB: changelogs in the checkpoint, and the session keeps its own settings
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == provider
    assert [n for n in os.listdir(f"{work}/ck1/state/0/0") if n.endswith(".changelog")]

    assert _rows(live.recent_table(spark, f"{work}/recent"), ["user_id", "item_id"]) == \
        _rows(ev.recent_items(t.log), ["user_id", "item_id"])
    assert _rounded(live.popularity_table(spark, f"{work}/pop")) == _rounded(_popularity(t))
    seen = _rows(ev.seen_items(t.log), ["user_id", "item_id"])
    assert _rows(live.seen_table(spark, f"{work}/seen"), ["user_id", "item_id"]) == seen
    users = sorted({u for u, _ in seen})[:2]
    assert _rows(live.seen_table(spark, f"{work}/seen", users), ["user_id", "item_id"]) == [p for p in seen if p[0] in users]


LOG = "event string, user_id string, target_type string, item_id string, ts timestamp_ntz, event_id long, rating double"


def _batches(spark, batches):
    """A stream with one micro-batch per list of (event, user, item, second, id, rating)."""
    import datetime as dt
    folder = tempfile.mkdtemp(prefix="affinity-batches-", dir="/tmp")
    for n, rows in enumerate(batches):
        rows = [(e, u, "cosmetic", i, dt.datetime(2024, 1, 1, 0, 0, s), k, r) for e, u, i, s, k, r in rows]
        spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(f"{folder}/{n}")
        for name in os.listdir(f"{folder}/{n}"):
            if name.endswith(".parquet"):
                at = os.path.join(folder, f"f{n}.parquet")
                os.link(f"{folder}/{n}/{name}", at)
                os.utime(at, (1_700_000_000 + n,) * 2)  # the file source takes the oldest first
    return (spark.readStream.schema(LOG).option("pathGlobFilter", "f*.parquet").option("maxFilesPerTrigger", "1").parquet(folder))


def test_popularity_takes_back_what_a_later_rating_replaces(spark):
    users = spark.createDataFrame([("u",), ("v",)], "user_id string")
    items = spark.createDataFrame([("a",), ("b",)], "item_id string")
    batches = [[("rate", "u", "a", 10, 1, 4.75), ("own", "u", "a", 11, 2, None), ("view", "v", "b", 1, 3, None)],
               [("rate", "u", "a", 20, 4, 1.75)],                                   # replaces: 3 x -1
               [("rate", "u", "a", 15, 5, 5.0)],                                    # late: changes nothing
               [("rate", "u", "a", 20, 6, 3.75), ("own", "u", "a", 1, 7, None)],    # the tie goes to the larger id; owned twice
               [("rate", "x", "a", 30, 8, 5.0), ("rate", "v", "b", 30, 9, None)]]   # unknown user; a rating without value
    work = tempfile.mkdtemp(prefix="affinity-live-", dir="/tmp")
    live._run(live.live_popularity(_batches(spark, batches), users, items, f"{work}/pop", f"{work}/ck"))
    assert _rounded(live.popularity_table(spark, f"{work}/pop")) == [("a", 6.0), ("b", 1.0)]
    runs = [spark.read.parquet(p) for p in live.Runs(f"{work}/pop", lambda df: df).cover(spark)]
    assert [sorted((r.item_id, float(r.change)) for r in df.collect()) for df in runs] == \
        [[("a", 6.0), ("b", 1.0)], [("a", -9.0)], [], [("a", 9.0)], [("b", 0.0)]]


def test_recent_lists_only_of_users_that_changed(spark):
    n = 12
    batches = [[("view", "u", f"i{k}", 20 + k, k, None) for k in range(n)] + [("view", "v", "x", 1, 100, None)],
               [("view", "u", "late", 3, 101, None)],       # older than the ten newest
               [("view", "u", "i11", 40, 102, None)]]       # again: the list holds it twice
    work = tempfile.mkdtemp(prefix="affinity-live-", dir="/tmp")
    live._run(live.live_recent(_batches(spark, batches), f"{work}/r", f"{work}/ck"))
    got = _rows(live.recent_table(spark, f"{work}/r"), ["user_id", "item_id"])
    assert got == sorted([("u", f"i{k}") for k in range(3, 12)] + [("v", "x")])
    runs = [spark.read.parquet(p) for p in live.Runs(f"{work}/r", lambda df: df).cover(spark)]
    assert [sorted(r.user_id for r in df.collect()) for df in runs] == [["u", "v"], [], ["u"]]


def test_runs_fold_by_levels_and_a_lost_run_is_an_error(spark):
    import pytest
    from affinity.streaming.runs import Runs, list_dir, remove
    root = tempfile.mkdtemp(prefix="affinity-runs-", dir="/tmp")
    runs = Runs(root, lambda df: df.groupBy("k").agg(F.sum("n").cast("long").alias("n")), fan=2)
    with pytest.raises(RuntimeError):
        runs.read(spark, "k string, n long")
    for b in range(7):
        change = spark.createDataFrame([("all", 1), (f"b{b}", b)], "k string, n long")
        runs.add(change, b)
        if b in (1, 5):
            runs.add(change, b)  # a replay
    assert [p.rsplit("/", 1)[1][:2] for p in runs.cover(spark)] == ["L2", "L1", "L0"]
    assert _rows(runs.read(spark, "k string, n long"), ["k", "n"]) == \
        [("all", 7)] + [(f"b{b}", b) for b in range(7)]
    assert not any(n.startswith("L0-0000000000") for n in list_dir(spark, root))  # folded, and a fold since
    remove(spark, runs.cover(spark)[1])
    for b in (4, 5):
        remove(spark, f"{root}/L0-{b:010d}-{b:010d}")
    with pytest.raises(RuntimeError, match="batch 4"):
        runs.read(spark, "k string, n long")


def test_scoring_from_live_state_equals_log_pass(spark):
    """Serving can read seen / recent items from the live state tables."""
    from affinity.plans import scoring as sc
    t = load(spark, SF_SMALL)
    m = md.materialize(md.train(md.TrainingData(t.users, t.items, t.log), user_factors=t.user_vectors,
                                item_factors=t.item_vectors))
    stream = events_to_log(live.event_stream(spark, SF_SMALL), t.part_names)
    work = tempfile.mkdtemp(prefix="affinity-live-", dir="/tmp")
    live._run(live.live_seen(stream, f"{work}/seen", f"{work}/ck1"))
    live._run(live.live_recent(stream, f"{work}/recent", f"{work}/ck2"))
    seen = live.seen_table(spark, f"{work}/seen")
    recent = live.recent_table(spark, f"{work}/recent")
    a = sc.factor_batch(t.requests, m.user_factors, m.item_model, t.log)
    b = sc.factor_batch(t.requests, m.user_factors, m.item_model, t.log, seen=seen, recent=recent)
    cols = ["request_id", "item_id", "score", "rank"]
    ra = _rows(sc.recommend_batch(a, m.item_model).withColumn("score", F.round("score", 6)), cols)
    rb = _rows(sc.recommend_batch(b, m.item_model).withColumn("score", F.round("score", 6)), cols)
    assert ra == rb and len(ra) > 0


def test_runs_as_they_were_before_a_replayed_batch(spark):
    from affinity.streaming.runs import Runs
    root = tempfile.mkdtemp(prefix="affinity-runs-", dir="/tmp")
    runs = Runs(root, lambda df: df.groupBy("k").agg(F.sum("n").cast("long").alias("n")), fan=2)
    for b in range(4):
        runs.add(spark.createDataFrame([("all", 1 << b)], "k string, n long"), b)
    seen = [_rows(runs.read(spark, "k string, n long", before=b), ["k", "n"]) for b in (0, 2, 3, 4)]
    assert seen == [[], [("all", 3)], [("all", 7)], [("all", 15)]]


def test_popularity_keeps_no_python_state(spark):
    users = spark.createDataFrame([("u",)], "user_id string")
    items = spark.createDataFrame([("a",)], "item_id string")
    work = tempfile.mkdtemp(prefix="affinity-live-", dir="/tmp")
    batches = [[("own", "u", "a", 1, 1, None)], [("rate", "u", "a", 2, 2, 4.75)]]
    live._run(live.live_popularity(_batches(spark, batches), users, items, f"{work}/pop", f"{work}/ck"))
    assert _rounded(live.popularity_table(spark, f"{work}/pop")) == [("a", 6.0)]
    assert not os.path.exists(f"{work}/ck/state")
