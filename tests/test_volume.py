"""What steps send through shuffles, read from their plans."""

from pyspark.sql import functions as F

from affinity.config import Params
from affinity.plans import scoring as sc
from affinity.sources import fixtures as fx


def plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines()


def test_order_lines_are_shuffled_as_rows_and_not_as_sets(spark):
    t = fx.Tables(spark, "unused")
    t.__dict__["_raw"] = {
        "orders": spark.createDataFrame([(1, "2024-01-02 00:00:00"), (2, None), (None, None)], "o_orderkey long, o_orderdate string")
        .withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")),
        "lineitem": spark.createDataFrame([(1, 7), (1, 8), (1, 7), (1, None), (3, 7), (None, 8)], "l_orderkey long, l_partkey long"),
        "part": spark.createDataFrame([(7, "red bolt"), (8, "old nut")], "p_partkey long, p_name string")}
    a, b = [i for i, x in enumerate(plan(t.contents)) if "ObjectHashAggregate" in x]
    assert not any("Exchange" in x for x in plan(t.contents)[a:b])
    names = {r[0]: r[1] for r in t.part_names.collect()}
    assert sorted((r.item_id or "", r.cosmetics, r.upload_date) for r in t.contents.collect()) == [
        ("", None, None), ("content 1", sorted([names[7], names[8]]), "2024-01-02"), ("content 2", None, None)]


def test_items_are_not_shuffled_to_leave_out_a_short_list(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        items = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), (None, [3.0]), ("c", None)], "item_id string, features array<double>")
        gone = spark.createDataFrame([("b",), ("b",), (None,), ("x",)], "item_id string")
        few, many = (sc.available_items(items, gone, Params(broadcast_rows=n)) for n in (3, 2))
        joins = lambda df: [x for x in plan(df) if "Join" in x]
        assert "BroadcastHashJoin" in joins(few)[0] and "SortMergeJoin" in joins(many)[0]
        assert [sorted(r.features or [] for r in x.collect()) for x in (few, many)] == [[[], [1.0], [3.0]]] * 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
