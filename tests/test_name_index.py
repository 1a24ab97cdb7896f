"""Candidates by key (name index, categories, mentions) against the plain predicate over all pairs."""

import random

from pyspark.sql import functions as F

from affinity.config import Params
from affinity.operators import candidates as cd
from affinity.operators import name_index as ni
from tests.helpers import items, requests


def tables(spark, seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé ") for _ in range(r.randrange(1, 8)))
    names = sorted({f"{word()}{i % 7}" for i in range(60)} | {"aaa aaa", "ab", "abab abab", "xy z"})
    rows = [(n, "cosmetic", r.choice([None, [], ["s"], ["s", "t"], ["t", "u", "s", "s"]]), r.choice([None, "b1", "b2"]), None) for n in names]
    for i in range(50):
        mentions = r.choice([None, [], r.sample(names, 3), r.sample(names, 5) + [None], ["aaa aaa", "abab abab", "aaa aaa", "gone 1"]])
        rows.append((f"content {i}", "content", r.choice([None, ["s"], ["t", "v"]]), r.choice([None, "b1"]), mentions))
    searches = [None, "", " ", "a", "ab", "aaa", "aba", "abab", "bab a", "aaa ", " aaa", "aaa  b", "zzz", "zzz aaa", "ab\u00e9", "x", "xyz", "aaa aaa aba"]
    reqs = [dict(search=s, item_type=t) for s in searches for t in ("cosmetic", "content", "other")]
    reqs += [dict(categories=c, item_type=t) for c in ([], ["s"], ["t", "s", "s"], ["u", "t", "s"], ["none"]) for t in ("cosmetic", "content")]
    reqs += [dict(cosmetic=c, item_type="content", search=s) for c in ("aaa aaa", "gone 1", "nothing") for s in (None, "zzz")]
    reqs += [dict(brand="b1", search="aba", item_type="cosmetic"), dict(white_list=names[:9], search="a", item_type="cosmetic"),
             dict(categories=["s", "t"], search="aba", item_type="cosmetic"), dict(black_list=["aaa aaa"], search="aaa", item_type="cosmetic")]
    reqs = [dict(request_id=f"r{i}", user_id="u", num=5, **q) for i, q in enumerate(reqs)]
    return cd.prepare_requests(requests(spark, reqs)).cache(), cd.item_side(items(spark, rows)).cache()


def test_every_path_equals_the_plain_predicate(spark):
    left, right = tables(spark)
    ids = lambda df: sorted((x.request_id, x.i_item_id) for x in df.select("request_id", "i_item_id").collect())
    paths = {x[0] for x in left.select(cd.request_path()).distinct().collect()}
    assert paths == set(cd.PATHS)
    for predicate in (cd.factor_predicate(), cd.overlap_predicate()):
        want = ids(left.crossJoin(right).filter(predicate))
        assert len(want) > 200 and len(want) == len(set(want))
        for q in (2, 3):
            assert ids(cd.candidate_pairs(left, right, predicate, Params(gram_size=q))) == want
        stored = ni.name_index(right, 3).cache()
        assert ids(cd.candidate_pairs(left, right, predicate, left_rows=10, paths=frozenset(paths), index=stored)) == want


def test_searches_do_not_meet_the_whole_item_table(spark):
    left, right = tables(spark)
    searches = left.filter(cd.request_path() == "name")
    plan = cd.candidate_pairs(searches, right, cd.factor_predicate(), left_rows=10, paths=frozenset(["name"]))._jdf.queryExecution().toString()
    joins = [x for x in plan.split("Physical Plan")[-1].splitlines() if "Join" in x]
    assert joins and all("_gram#" in x or "_name#" in x or "request_id#" in x for x in joins)
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_grams(spark):
    row = spark.createDataFrame([("abcabé", "ab", None)], "a string, b string, c string")
    got = row.select(*[F.array_sort(ni.grams(F.col(c), 3)) for c in "abc"]).first()
    assert [list(x) for x in got] == [["abc", "abé", "bca", "cab"], [], []]


def test_named_contents_leave_most_of_their_lists(spark):
    """a row of a content and a name carries the lower names only, none the whole list."""
    _, right = tables(spark)
    rows = [r for r in ni.found_by_name(right).collect() if r._kind == "content"]
    lists = {r.i_item_id: sorted({c for c in r.i_cosmetics or [] if c is not None}) for r in right.collect()}
    assert len(rows) > 50
    assert all(sorted(set(r.i_cosmetics)) == [c for c in lists[r.i_item_id] if c < r._name] for r in rows)
