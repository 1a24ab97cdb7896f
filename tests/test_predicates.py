"""Search terms (X1) and the candidate predicate matrix (F5-F13) of both scorers."""

import pytest
from pyspark.sql import functions as F

from affinity.functions.text import search_terms
from affinity.operators import candidates as cd
from tests.helpers import items, requests

ITEMS = [
    ("red widget 1", "cosmetic", ["ECONOMY", "small size"], "Brand#1", None),
    ("blue bolt 2", "cosmetic", ["SMALL", "large size"], None, None),
    ("red bolt 3", "cosmetic", None, "Brand#2", None),
    ("content 1", "content", None, None, ["red widget 1", "blue bolt 2"]),
    ("content 2", "content", None, None, ["blue bolt 2"]),
    ("content 3", "content", None, None, []),
    ("content 4", "content", None, None, None),
]


def terms(spark, s):
    df = spark.createDataFrame([(s,)], "s string")
    return df.select(search_terms(F.col("s")).alias("t")).first()["t"]


@pytest.mark.parametrize("search,expected", [
    (None, None), ("", [""]), ("red", ["red"]), ("red ", ["red"]), (" red", ["", "red"]),
    ("red  widget", ["red", "", "widget"]), (" ", []), ("   ", []), ("a a", ["a"]),
])
def test_search_terms_follow_java_split(spark, search, expected):
    got = terms(spark, search)
    assert (sorted(got) if got is not None else None) == (sorted(expected) if expected is not None else None)


def passing(spark, req, kind):
    r = cd.prepare_requests(requests(spark, [dict(request_id="r", user_id="u", num=10, **req)]))
    pred = cd.factor_predicate() if kind == "factor" else cd.overlap_predicate()
    pairs = cd.candidate_pairs(r, cd.item_side(items(spark, ITEMS)), pred)
    return sorted(x.i_item_id for x in pairs.collect())


ALL_COS = ["blue bolt 2", "red bolt 3", "red widget 1"]


@pytest.mark.parametrize("req,factor,overlap", [
    # cosmetic, no search: pass in both
    (dict(item_type="cosmetic"), ALL_COS, ALL_COS),
    # cosmetic search: every term inside the id with spaces removed
    (dict(item_type="cosmetic", search="red widget"), ["red widget 1"], ["red widget 1"]),
    (dict(item_type="cosmetic", search="redwid"), ["red widget 1"], ["red widget 1"]),
    # an empty term fails every item
    (dict(item_type="cosmetic", search=""), [], []),
    (dict(item_type="cosmetic", search=" red"), [], []),
    # only spaces = no terms
    (dict(item_type="cosmetic", search=" "), ALL_COS, ALL_COS),
    # content without search: factor needs >=1 cosmetic, overlap passes everything
    (dict(item_type="content"), ["content 1", "content 2"], ["content 1", "content 2", "content 3", "content 4"]),
    # content search: one cosmetic must hold all terms
    (dict(item_type="content", search="red widget"), ["content 1"], ["content 1"]),
    (dict(item_type="content", search="bolt"), ["content 1", "content 2"], ["content 1", "content 2"]),
    (dict(item_type="content", search="red bolt"), [], []),
    # related cosmetic overrides search
    (dict(item_type="content", cosmetic="blue bolt 2", search="zzz"), ["content 1", "content 2"],
     ["content 1", "content 2"]),
    (dict(item_type="content", cosmetic="red widget 1"), ["content 1"], ["content 1"]),
    # related cosmetic is ignored for cosmetic requests
    (dict(item_type="cosmetic", cosmetic="red widget 1"), ALL_COS, ALL_COS),
    # brand: brandless items fail
    (dict(item_type="cosmetic", brand="Brand#1"), ["red widget 1"], ["red widget 1"]),
    # categories: any overlap; none on the item fails; empty set passes nothing
    (dict(item_type="cosmetic", categories=["ECONOMY", "x"]), ["red widget 1"], ["red widget 1"]),
    (dict(item_type="cosmetic", categories=[]), [], []),
    (dict(item_type="content", categories=["ECONOMY"]), [], []),
    # white list: listed only (unknown ids harmless); black list: never
    (dict(item_type="cosmetic", white_list=["red bolt 3", "zzz"]), ["red bolt 3"], ["red bolt 3"]),
    (dict(item_type="cosmetic", white_list=["zzz"]), [], []),
    (dict(item_type="cosmetic", black_list=["red bolt 3"]), ["blue bolt 2", "red widget 1"],
     ["blue bolt 2", "red widget 1"]),
    # another kind: nothing
    (dict(item_type="other"), [], []),
])
def test_predicate_matrix(spark, req, factor, overlap):
    assert passing(spark, req, "factor") == factor
    assert passing(spark, req, "overlap") == overlap
