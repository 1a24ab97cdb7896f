"""Candidates by signature and the whole black list: equal to the plain rules, laid out without hot keys."""

from collections import Counter

from pyspark.sql import functions as F

from affinity.operators import candidates as cd
from tests import helpers as h


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_whole_black_list_has_each_pair_once_and_no_single_key(spark):
    reqs = h.requests(spark, [dict(request_id="r1", user_id="u1", num=1, black_list=["a", "x", None]), dict(request_id="r1", user_id="u1", num=1),
                              dict(request_id=None, user_id="u2", num=1)])
    seen = spark.createDataFrame([("u1", "x"), ("u1", "b"), ("u2", None), ("u2", "c")], "user_id string, item_id string")
    gone = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "item_id string")
    got = cd.full_black_rows(reqs, seen, gone, hot_key_pairs=2)
    assert rows(got) == Counter({("r1", i): 1 for i in ("a", "b", "x", "y", None)}) + Counter({(None, i): 1 for i in ("c", "x", "y", None)})
    p = plan(got)
    assert "_row" in p and "_column" in p, p                      # requests x unavailable items is a grid
    assert "Union" in "".join(p.splitlines()[:5]), p              # and no aggregation of its rows follows


def sample(spark):
    items = h.items(spark, [("red a", "cosmetic", ["c1", "c2"], "b1", None), ("red a", "cosmetic", ["c1"], "b1", None), ("blue b", "cosmetic", ["c2"], "b2", None),
                            ("n", "cosmetic", None, None, None), (None, "cosmetic", ["c1"], "b1", None), ("t1", "content", None, None, ["red a", "blue b"]),
                            ("t2", "content", None, None, ["blue b", "blue b", None]), ("t3", "content", None, None, None), ("o", "other", None, None, None)])
    asked = [dict(), dict(brand="b1"), dict(categories=["c1", "c2"]), dict(categories=[]), dict(search="red"), dict(search="re"), dict(search=""), dict(search="  "),
             dict(white_list=["red a", "t1", "zzz"]), dict(white_list=[]), dict(cosmetic="blue b"), dict(cosmetic="blue b", search="red"),
             dict(brand="b1", black_list=["red a"]), dict(black_list=["red a", "t1"]), dict(black_list=[])]
    reqs = [dict(request_id=f"{kind}{i}", user_id="u", num=3, item_type=kind, **a) for kind in ("cosmetic", "content", "other", None) for i, a in enumerate(asked)]
    return h.requests(spark, reqs + reqs[:3]), items


def test_candidates_by_signature_equal_the_plain_rules(spark):
    requests, items = sample(spark)
    reqs, side = cd.prepare_requests(requests), cd.item_side(items)
    for predicate in (cd.factor_predicate(), cd.overlap_predicate()):
        plain = reqs.crossJoin(side).filter(predicate).select("request_id", "i_item_id")
        assert rows(cd.request_candidates(reqs, side, predicate)) == rows(plain)


def test_unasked_kinds_are_not_read(spark, monkeypatch):
    requests, items = sample(spark)
    reqs = cd.prepare_requests(requests).filter("white_list IS NOT NULL AND item_type = 'cosmetic'")
    kept = {}
    real = cd.stage
    monkeypatch.setattr(cd, "stage", lambda df, name: kept.setdefault(name, real(df, name)))
    assert rows(cd.request_candidates(reqs, cd.item_side(items), cd.factor_predicate())) == Counter({("cosmetic8", "red a"): 2})
    assert {r[0] for r in kept["candidate_items"].select("i_item_type").distinct().collect()} == {"cosmetic"}
    assert "name_index" not in kept                               # no request searches by name


def test_few_signatures_shuffle_no_item(spark):
    requests, items = sample(spark)
    reqs = cd.prepare_requests(requests).withColumn("sig", F.col("request_id"))
    pairs = cd.candidate_pairs(reqs, cd.item_side(items), cd.factor_predicate(), paths={"brand": 3, "category": 4, "type": 9})
    assert "Exchange hashpartitioning" not in plan(pairs), plan(pairs)
