"""Property fold (A1), views (P1-P3) and the unavailable-items constraint."""

import json

from pyspark.sql import functions as F

from affinity import schema
from affinity.operators import entities as en
from affinity.operators import events as ev
from tests.helpers import ts


def plog(spark, rows):
    """rows: (entity_type, entity_id, event, {props}, sec)."""
    data = [(i, ts(sec), et, eid, e, props) for i, (et, eid, e, props, sec) in enumerate(rows)]
    return spark.createDataFrame(data, schema.PROPERTY_LOG)


def folded(spark, rows, etype="user"):
    return {r.entity_id: dict(r.properties) for r in en.property_fold(plog(spark, rows), etype).collect()}


def test_set_unset_delete(spark):
    rows = [
        ("user", "a", "$set", {"x": "1", "y": "2"}, 1),
        ("user", "a", "$unset", {"x": ""}, 2),
        ("user", "b", "$set", {"x": "1"}, 1),
        ("user", "b", "$delete", {}, 2),
        ("user", "c", "$set", {"x": "1"}, 1),
        ("user", "c", "$delete", {}, 2),
        ("user", "c", "$set", {"y": "5"}, 3),
        ("user", "d", "$unset", {"x": ""}, 1),
        ("user", "e", "$set", {"x": "1"}, 1),
        ("user", "e", "$set", {"x": "2"}, 2),
        ("user", "f", "$set", {"x": "1"}, 1),
        ("user", "f", "$unset", {"x": ""}, 2),
    ]
    got = folded(spark, rows)
    assert got == {"a": {"y": "2"}, "c": {"y": "5"}, "e": {"x": "2"}, "f": {}}


def test_item_views(spark):
    rows = [
        ("content", "v", "$set", {"cosmetics": json.dumps(["a", "b", "a"]), "upload_date": '"2024-01-01"'}, 1),
        ("cosmetic", "a", "$set", {"categories": json.dumps(["x", "y"]), "brand": '"B"'}, 1),
        ("cosmetic", "b", "$set", {}, 1),
    ]
    its = {r.item_id: r for r in en.items_from_properties(plog(spark, rows)).collect()}
    assert sorted(its["v"].cosmetics) == ["a", "b"] and its["v"].upload_date == "2024-01-01"
    assert its["a"].categories == ["x", "y"] and its["a"].brand == "B" and its["a"].item_type == "cosmetic"
    assert its["b"].categories is None and its["b"].brand is None


def test_unavailable_latest_set_replaces(spark):
    rows = [("constraint", "unavailableItems", "$set", {"items": json.dumps(["1", "2", "3"])}, 1),
            ("constraint", "unavailableItems", "$set", {"items": json.dumps(["3", "4", "5"])}, 2)]
    assert sorted(r.item_id for r in ev.unavailable_items(plog(spark, rows)).collect()) == ["3", "4", "5"]
    rows.append(("constraint", "unavailableItems", "$set", {"items": "[]"}, 3))
    assert ev.unavailable_items(plog(spark, rows)).collect() == []


def test_duplicate_item_ids_are_rejected(spark):
    import pytest
    from tests.helpers import items
    its = items(spark, [("x", "content", None, None, None), ("x", "cosmetic", None, None, None)])
    with pytest.raises(ValueError):
        en.require_unique_items(its)


def test_merged_fold_states_equal_a_full_fold(spark):
    """Random $set / $unset / $delete logs, dealt to three states in no order of time."""
    import datetime as dt
    import random
    rng = random.Random(5)
    schema = ("event string, entity_type string, entity_id string, ts timestamp, event_id long, "
              "properties map<string,string>, part int")
    rows = []
    for n in range(400):
        event = rng.choice(["$set", "$set", "$set", "$unset", "$delete", "view"])
        props = {k: f"{k}{n}" for k in rng.sample("abc", rng.randint(0, 2))} if event != "$delete" else None
        rows.append((event, rng.choice(["user", "item"]), f"e{rng.randint(0, 30)}",
                     dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randint(0, 60)), n, props, rng.randint(0, 2)))
    log = spark.createDataFrame(rows, schema)
    full = en.property_fold(log, "user")
    first, second, third = (en.fold_state(log.filter(F.col("part") == k), "user") for k in range(3))
    empty = en.fold_state(log.limit(0), "user")
    for merged in (en.merge_fold_states(en.merge_fold_states(first.staged(), third), second),
                   en.merge_fold_states(empty, en.merge_fold_states(second, en.merge_fold_states(third, first)))):
        got = {r.entity_id: r.properties for r in en.fold_properties(merged).collect()}
        assert got == {r.entity_id: r.properties for r in full.collect()} and len(got) > 5


def test_sample_rows(spark):
    """Two rows of each table by key; equal rows count each, an empty table has none."""
    from affinity.operators import events as ev
    a = spark.createDataFrame([("u3",), ("u1",), ("u1",), ("u2",)], "user_id string")
    b = spark.createDataFrame([("u1", "i2", 9), ("u1", "i1", 7)], "user_id string, item_id string, event_id long").repartition(2)
    got = sorted(tuple(r) for r in ev.sample_rows({"a": a, "b": b, "none": b.limit(0)}).collect())
    assert got == [("a", "u1"), ("a", "u1"), ("b", "u1|i1|7"), ("b", "u1|i2|9")]


def test_model_differences_are_counted_by_row(spark):
    """A lost, an added and a doubled row are each found in the table they belong to."""
    from affinity.plans import model as md
    pairs = lambda rows: spark.createDataFrame(rows, "user_id string, cosmetic_id string")
    vectors = spark.createDataFrame([("u", [1.0, 2.0]), ("v", None)], "user_id string, features array<double>")
    one = md.Model(vectors, vectors, pairs([("a", "x"), ("a", "y")]), pairs([("a", "x"), ("a", "x")]), None)
    two = md.Model(vectors, vectors, pairs([("a", "x"), ("a", "z"), (None, "z")]), pairs([("a", "x")]), None)
    got = {r.table_name: (r.n_rows, r.n_lost, r.n_added) for r in md.differences(one, two).collect()}
    assert got == {"user_factors": (2, 0, 0), "item_model": (2, 0, 0), "owned": (2, 1, 2), "mentions": (2, 1, 0)}


def test_fold_reads_its_log_once(spark, tmp_path):
    """items of both kinds and their properties come out of one pass, and users need no properties at all."""
    rows = [("content", "v", "$set", {"cosmetics": '["a"]', "upload_date": "2024-01-01"}, 1), ("content", "w", "$unset", {"upload_date": ""}, 1),
            ("cosmetic", "a", "$set", {"brand": "B"}, 1), ("cosmetic", "a", "$unset", {"brand": ""}, 2), ("user", "u", "$set", {"x": "1"}, 1),
            ("cosmetic", None, "$set", {"brand": "C"}, 1), ("user", "gone", "$set", {}, 1), ("user", "gone", "$delete", None, 2)]
    plog(spark, rows).write.parquet(f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log")
    its = en.items_from_properties(log)
    assert its._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {r.item_id: (r.item_type, r.categories, r.brand, r.cosmetics, r.upload_date) for r in its.collect()}
    # nothing names the properties of an entity without an id
    assert got == {"v": ("content", None, None, ["a"], "2024-01-01"), "a": ("cosmetic", None, None, None, None),
                   None: ("cosmetic", None, None, None, None)}
    for kind in ("user", "cosmetic", "content"):
        ids = lambda df: sorted(str(r.entity_id) for r in df.collect())
        assert ids(en.surviving_entities(log, kind)) == ids(en.property_fold(log, kind))


def test_entities_of_a_compact_file_are_dealt_to_tasks(spark, monkeypatch):
    """the entity log's parts are spread by their number, whatever the splits of their file."""
    from affinity.sources import fixtures
    monkeypatch.setattr(fixtures, "ENTITIES_PER_TASK", 40)
    t = fixtures.load(spark, "/root/testdata/sf0.001")
    n = t.raw("part").count()
    parts = t.entity_log.filter("entity_type = 'cosmetic'")
    assert n > 80 and parts.count() == n
    assert parts._jdf.queryExecution().optimizedPlan().toString().count(f"], {-(-n // 40)}") == 1
