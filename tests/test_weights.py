"""Hand-computed affinity / popularity / overlap cases (FIXTURES §4)."""

from pyspark.sql import functions as F

from affinity.config import Params
from affinity.operators import events as ev
from affinity.operators import overlap as ov
from affinity.operators import weights as wt
from affinity.functions.vectors import cosine
from affinity.plans.serve import blend
from tests.helpers import as_dict, items, log, requests, users


def _stats(spark, rows, params=Params()):
    lg = log(spark, rows)
    its = items(spark, [("c1", "cosmetic", None, None, None), ("v1", "content", None, None, ["c1"])])
    valid = ev.valid_events(ev.training_log(lg, params), users(spark, ["u"]), its)
    return wt.pair_stats(valid, params)


def affinity(spark, rows, params=Params()):
    return as_dict(wt.affinity_from_stats(_stats(spark, rows, params), params), ["item_id"], "rating")


def popularity(spark, rows, params=Params()):
    return as_dict(wt.popularity_from_stats(_stats(spark, rows, params), params), ["item_id"], "popularity")


def test_scrap_latest_wins(spark):
    # A4: scrap then cancel -> 0.0 (row kept); cancel then scrap -> 2.0
    assert affinity(spark, [("scrap", "u", "cosmetic", "c1", None, 1),
                            ("cancel_scrap", "u", "cosmetic", "c1", None, 2)]) == {"c1": 0.0}
    assert affinity(spark, [("cancel_scrap", "u", "cosmetic", "c1", None, 1),
                            ("scrap", "u", "cosmetic", "c1", None, 2)]) == {"c1": 2.0}


def test_misspelt_cancel_is_honoured_and_literal_mode_ignores_it(spark):
    rows = [("scrap", "u", "cosmetic", "c1", None, 1), ("cancle_scrap", "u", "cosmetic", "c1", None, 2)]
    assert affinity(spark, rows) == {"c1": 0.0}
    assert affinity(spark, rows, Params(cancel_names=())) == {"c1": 2.0}


def test_rate_times_own(spark):
    # Own x2 + rate 5.0 -> 6 * 2.25
    assert affinity(spark, [("own", "u", "cosmetic", "c1", None, 1), ("own", "u", "cosmetic", "c1", None, 2),
                            ("rate", "u", "cosmetic", "c1", 5.0, 3)]) == {"c1": 13.5}
    assert affinity(spark, [("own", "u", "cosmetic", "c1", None, 1)]) == {"c1": 3.0}
    assert affinity(spark, [("rate", "u", "cosmetic", "c1", 1.0, 1)]) == {"c1": -1.75}
    # latest rating wins
    assert affinity(spark, [("rate", "u", "cosmetic", "c1", 5.0, 1), ("rate", "u", "cosmetic", "c1", 0.5, 2),
                            ("own", "u", "cosmetic", "c1", None, 3)]) == {"c1": -6.75}


def test_total_affinity(spark):
    # 2 views + 1 play + own + rate 2.75 -> 2 + 5 + 3 * 0
    rows = [("view", "u", "content", "v1", None, 1), ("view", "u", "content", "v1", None, 2),
            ("play", "u", "content", "v1", None, 3),
            ("own", "u", "cosmetic", "c1", None, 4), ("rate", "u", "cosmetic", "c1", 2.75, 5)]
    assert affinity(spark, rows) == {"v1": 7.0, "c1": 0.0}


def test_play_weights_differ(spark):
    # A11 vs A3: one play is 1.0 popularity but 5.0 affinity
    rows = [("play", "u", "content", "v1", None, 1)]
    assert popularity(spark, rows) == {"v1": 1.0}
    assert affinity(spark, rows) == {"v1": 5.0}


def test_scrap_popularity_counts_every_event(spark):
    # Scrap, cancel, scrap -> +2 popularity; affinity by the latest -> 2.0
    rows = [("scrap", "u", "cosmetic", "c1", None, 1), ("cancel_scrap", "u", "cosmetic", "c1", None, 2),
            ("scrap", "u", "cosmetic", "c1", None, 3)]
    assert popularity(spark, rows) == {"c1": 2.0}
    assert affinity(spark, rows) == {"c1": 2.0}


def test_unknown_user_or_item_is_dropped(spark):
    rows = [("view", "x", "cosmetic", "c1", None, 1), ("view", "u", "cosmetic", "zz", None, 2)]
    assert affinity(spark, rows) == {}


def test_merge_pair_stats_equals_one_pass(spark):
    rows = [("own", "u", "cosmetic", "c1", None, 1), ("rate", "u", "cosmetic", "c1", 5.0, 2),
            ("scrap", "u", "cosmetic", "c1", None, 3), ("rate", "u", "cosmetic", "c1", 1.0, 4),
            ("cancel_scrap", "u", "cosmetic", "c1", None, 5), ("view", "u", "content", "v1", None, 6)]
    whole = as_dict(wt.affinity_from_stats(_stats(spark, rows)), ["item_id"], "rating")
    a, b = _stats(spark, rows[:3]), _stats(spark, rows[3:])
    merged = as_dict(wt.affinity_from_stats(wt.merge_pair_stats(a, b)), ["item_id"], "rating")
    assert merged == whole


def test_event_order_is_the_order_of_time_and_id(spark):
    rows = [(dt, i) for dt in ("1969-12-31 23:59:59.999999", "2024-01-01 00:00:00", "2024-01-01 00:00:00.000001", "2024-03-31 02:30:00")
            for i in (-2 ** 63, -1, 0, 7, 2 ** 63 - 1)]
    df = spark.createDataFrame(rows[::-1], "t string, event_id long").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = df.select("t", "event_id", wt.event_order().alias("o")).orderBy("o").collect()
    assert [(r.t, r.event_id) for r in got] == rows and len({r.o for r in got}) == len(rows)


def test_overlap_score(spark):
    # Owns {a, b, b}; content mentions {a, b, c} -> 5 * 2
    its = items(spark, [("a", "cosmetic", None, None, None), ("b", "cosmetic", None, None, None),
                        ("c", "cosmetic", None, None, None), ("v", "content", None, None, ["a", "b", "c"])])
    own = log(spark, [("own", "u", "cosmetic", "a", None, 1), ("own", "u", "cosmetic", "b", None, 2),
                      ("own", "u", "cosmetic", "b", None, 3)])
    got = as_dict(ov.overlap_scores(own, its), ["user_id", "content_id"], "score")
    assert got == {("u", "v"): 10.0}


def test_blend(spark):
    # Scorer 1 x 1.5, y 1.0; scorer 2 y 5.0, z 0.0; num 2 -> y 6.0, x 1.5
    s1 = spark.createDataFrame([("r", "x", 1.5), ("r", "y", 1.0)], "request_id string, item_id string, score double")
    s2 = spark.createDataFrame([("r", "y", 5.0), ("r", "z", 0.0)], "request_id string, item_id string, score double")
    reqs = requests(spark, [{"request_id": "r", "user_id": "u", "num": 2, "item_type": "cosmetic"}])
    got = [(r.item_id, r.score, r.rank) for r in blend(reqs, [s1, s2]).orderBy("rank").collect()]
    assert got == [("y", 6.0, 1), ("x", 1.5, 2)]


def test_cosine(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]


def test_recent_items_limit_then_distinct(spark):
    # 12 events, the newest 10 cover 3 items
    rows = [("view", "u", "cosmetic", "old", None, 0), ("view", "u", "cosmetic", "old2", None, 1)]
    rows += [("view", "u", "cosmetic", f"i{k % 3}", None, 10 + k) for k in range(10)]
    got = sorted(r.item_id for r in ev.recent_items(log(spark, rows)).collect())
    assert got == ["i0", "i1", "i2"]
