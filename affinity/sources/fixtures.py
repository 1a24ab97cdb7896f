"""Adapter from the driver's TPC-H-like tables to the engine's data model.

customer -> users, part -> cosmetics, orders(+lineitem) -> content that
mentions cosmetics, events -> the user/item interaction log, the property
log and given factor vectors. Every frame is lazy; nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.config import CONSTRAINT_ENTITY_TYPE, UNAVAILABLE_ENTITY_ID
from affinity.session import size_files_as_rows


# schemas of the driver's tables: given up front, so no footer-reading job runs per read
TABLE_SCHEMAS = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in TABLE_SCHEMAS:
        reader = reader.schema(TABLE_SCHEMAS[name])
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def user_id(key: Column) -> Column:
    return F.concat(F.lit("u"), key.cast("string"))


def part_item_id(name: Column, key: Column) -> Column:
    """Cosmetic ids double as display names: '<p_name> <p_partkey>'."""
    return F.concat(name, F.lit(" "), key.cast("string"))


# --- fixed request cases (FIXTURES §3); P(k) = item id of part k -----------
# (id, user, num, item_type, search, result_type, cosmetic part, brand,
#  categories, white-list parts, white-list extra ids, black-list parts)
REQUEST_CASES = [
    ("q01", "u1", 10, "cosmetic", None, None, None, None, None, None, None, None),
    ("q02", "u3", 10, "cosmetic", None, None, None, None, None, None, None, None),
    ("q03", "nobody", 10, "cosmetic", None, None, None, None, None, None, None, None),
    ("q04", "u1", 10, "cosmetic", None, "popular", None, None, None, None, None, None),
    ("q05", "u1", 10, "cosmetic", None, None, None, None, ["ECONOMY"], None, None, None),
    ("q06", "u1", 10, "cosmetic", None, None, None, None, [], None, None, None),
    ("q07", "u1", 10, "cosmetic", None, None, None, "Brand#2", None, None, None, None),
    ("q08", "u1", 10, "cosmetic", None, None, None, None, None, list(range(20)), ["zzz"], None),
    ("q09", "u1", 10, "cosmetic", None, None, None, None, None, [], ["zzz"], None),
    ("q10", "u1", 10, "cosmetic", None, None, None, None, None, None, None, [1, 2]),
    ("q11", "u1", 10, "cosmetic", "red widget", None, None, None, None, None, None, None),
    ("q12", "u1", 10, "cosmetic", "", None, None, None, None, None, None, None),
    ("q13a", "u1", 10, "cosmetic", "red ", None, None, None, None, None, None, None),
    ("q13b", "u1", 10, "cosmetic", " red", None, None, None, None, None, None, None),
    ("q13c", "u1", 10, "cosmetic", "red  widget", None, None, None, None, None, None, None),
    ("q13d", "u1", 10, "cosmetic", " ", None, None, None, None, None, None, None),
    ("q14", "u1", 10, "content", None, None, None, None, None, None, None, None),
    ("q15", "u1", 10, "content", "red", None, None, None, None, None, None, None),
    ("q16", "u1", 10, "content", "red widget", None, None, None, None, None, None, None),
    ("q17", "u1", 10, "content", None, None, 5, None, None, None, None, None),
    ("q18", "u1", 10, "content", "red", None, 5, None, None, None, None, None),
    ("q19", "u1", 10, "content", None, "popular", None, None, None, None, None, None),
    ("q20", "u1", 10, "content", "red", "popular", None, None, None, None, None, None),
    ("q21", "u1", 10, "content", None, None, None, None, ["ECONOMY"], None, None, None),
    ("q22", "u1", 10, "other", None, None, None, None, None, None, None, None),
    ("q23", "u1", 0, "cosmetic", None, None, None, None, None, None, None, None),
    ("q24", "u1", 1000000, "cosmetic", None, None, None, None, None, None, None, None),
    ("q08p", "u1", 10, "cosmetic", None, "popular", None, None, None, list(range(20)), ["zzz"], None),
    ("q11p", "u1", 10, "cosmetic", "red widget", "popular", None, None, None, None, None, None),
    ("q16p", "u1", 10, "content", "red widget", "popular", None, None, None, None, None, None),
    ("q17p", "u1", 10, "content", None, "popular", 5, None, None, None, None, None),
    ("q25", "u2", 10, "content", None, None, None, None, None, None, None, None),
    ("q26", "u4", 5, "cosmetic", "bolt", None, None, None, None, None, None, None),
    ("q27", "u6", 10, "content", "red", None, None, None, None, None, None, None),
]

#: Entities that a task deals with where they come from a compact file, which is one split however many rows it holds.
ENTITIES_PER_TASK = 100_000

# requests of the customers: what is asked (by key modulo their number), and how many answers
CUSTOMER_KINDS = ("search cosmetics", "search contents", "brand", "category", "related", "white list")
CUSTOMER_NUM = 5

# constraint log: an older $set with the parts whose key is 1, 2 or 3 modulo 500, a newer one with 3, 4 or 5
CONSTRAINT_CYCLE = 500
CONSTRAINT_SETS = [
    (1, "2023-12-30 00:00:00", [1, 2, 3]),
    (2, "2023-12-31 00:00:00", [3, 4, 5]),
]
# ---------------------------------------------------------------------------


@dataclass
class Tables:
    """The engine's inputs, derived from one scale directory."""

    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        cache = self.__dict__.setdefault("_raw", {})
        if name not in cache:
            cache[name] = read_table(self.spark, self.sf_dir, name)
        return cache[name]

    @cached_property
    def users(self) -> DataFrame:
        return self.raw("customer").select(user_id(F.col("c_custkey")).alias("user_id"))

    @cached_property
    def registered_users(self) -> DataFrame:
        """Users but every tenth customer: makes events of unknown users for F1 and F2."""
        c = self.raw("customer").filter(F.col("c_custkey") % 10 != 9)
        return c.select(user_id(F.col("c_custkey")).alias("user_id"))

    @cached_property
    def registered_items(self) -> DataFrame:
        """Items but every 25th part: makes events on unknown items for F1 and F2."""
        gone = (self.raw("part").filter(F.col("p_partkey") % 25 == 24)
                .select(part_item_id(F.col("p_name"), F.col("p_partkey")).alias("item_id")))
        return self.items.join(gone, "item_id", "left_anti")

    @cached_property
    def part_names(self) -> DataFrame:
        p = self.raw("part")
        return p.select("p_partkey", part_item_id(F.col("p_name"), F.col("p_partkey")).alias("item_id"))

    @cached_property
    def cosmetics(self) -> DataFrame:
        p = self.raw("part")
        size = F.when(F.col("p_size") >= 25, F.lit("large size")).otherwise(F.lit("small size"))
        return p.select(
            part_item_id(F.col("p_name"), F.col("p_partkey")).alias("item_id"),
            F.lit("cosmetic").alias("item_type"),
            F.when(F.col("p_partkey") % 13 == 0, F.lit(None).cast("array<string>"))
             .otherwise(F.array(F.col("p_type"), size)).alias("categories"),
            F.when(F.col("p_partkey") % 11 == 0, F.lit(None).cast("string"))
             .otherwise(F.col("p_brand")).alias("brand"),
            F.lit(None).cast("array<string>").alias("cosmetics"),
            F.lit(None).cast("string").alias("upload_date"),
        )

    @cached_property
    def contents(self) -> DataFrame:
        o = self.raw("orders").select("o_orderkey", "o_orderdate")
        li = self.raw("lineitem").select("l_orderkey", "l_partkey")
        named = li.join(self.part_names, li.l_partkey == self.part_names.p_partkey, "inner") \
                  .select("l_orderkey", "item_id")
        # rows meet before they are sets: a set of one name takes more room than the row
        mentions = named.repartition("l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("item_id")).alias("cosmetics"))
        return (o.join(mentions, o.o_orderkey == mentions.l_orderkey, "left")
                 .select(F.concat(F.lit("content "), F.col("o_orderkey").cast("string")).alias("item_id"),
                         F.lit("content").alias("item_type"),
                         F.lit(None).cast("array<string>").alias("categories"),
                         F.lit(None).cast("string").alias("brand"),
                         F.col("cosmetics"),
                         F.date_format(F.col("o_orderdate"), "yyyy-MM-dd").alias("upload_date")))

    @cached_property
    def items(self) -> DataFrame:
        return self.contents.unionByName(self.cosmetics)

    @cached_property
    def _events(self) -> DataFrame:
        return self.raw("events")

    @cached_property
    def log(self) -> DataFrame:
        """User -> item interactions, unknown users and items included."""
        return events_to_log(self._events, self.part_names)

    @cached_property
    def property_log(self) -> DataFrame:
        """$set / $unset / $delete events on users, from the events table."""
        return events_to_property_log(self._events)

    @cached_property
    def constraint_log(self) -> DataFrame:
        """Two $set events of constraint/unavailableItems naming part items."""
        rows = [(eid, ts, key) for eid, ts, keys in CONSTRAINT_SETS for key in keys]
        spec = F.broadcast(self.spark.createDataFrame(rows, "event_id long, ts string, _rest long"))
        named = self.part_names.withColumn("_rest", F.col("p_partkey") % CONSTRAINT_CYCLE).join(spec, "_rest")
        return (named.groupBy("event_id", "ts")
                .agg(F.to_json(F.array_sort(F.collect_list("item_id"))).alias("items"))
                .select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"),
                        F.lit(CONSTRAINT_ENTITY_TYPE).alias("entity_type"),
                        F.lit(UNAVAILABLE_ENTITY_ID).alias("entity_id"),
                        F.lit("$set").alias("event"),
                        F.create_map(F.lit("items"), F.col("items")).alias("properties")))

    @cached_property
    def _vectors(self) -> DataFrame:
        return self.raw("embeddings").select(
            "vec_id", F.col("embedding").cast("array<double>").alias("features"))

    def _given(self, keys: DataFrame, key: str, out: str) -> DataFrame:
        """A vector for every key: row ``key mod n`` of the embeddings (ids 0 to n - 1), turned by ``key div n``
        places and, after a whole turn, negated, so that no two keys have the same one."""
        n = self.raw("embeddings").count()
        v, k = F.col("features"), F.col(key)
        turn = F.floor(k / n) % F.size(v)
        turned = F.concat(F.slice(v, turn.cast("int") + 1, F.size(v)), F.slice(v, F.lit(1), turn.cast("int")))
        back = F.floor(k / (n * F.size(v))) % 2 == 1
        placed = keys.withColumn("vec_id", k % n).join(self._vectors, "vec_id")
        return placed.select(out, F.when(back, F.transform(turned, lambda x: -x)).otherwise(turned).alias("features"))

    @cached_property
    def item_vectors(self) -> DataFrame:
        """Given item vectors: all parts but each fifth, all contents but each seventh."""
        parts = self.part_names.filter(F.col("p_partkey") % 5 != 0)
        content = (self.raw("orders").filter(F.col("o_orderkey") % 7 != 0)
                   .select("o_orderkey", F.concat(F.lit("content "), F.col("o_orderkey").cast("string")).alias("item_id")))
        return self._given(parts, "p_partkey", "item_id").unionByName(self._given(content, "o_orderkey", "item_id"))

    @cached_property
    def user_vectors(self) -> DataFrame:
        """Given user vectors: all customers but each third (those are answered from recent items)."""
        c = self.raw("customer").filter(F.col("c_custkey") % 3 != 0)
        return self._given(c.select("c_custkey", user_id(F.col("c_custkey")).alias("user_id")), "c_custkey", "user_id")

    @cached_property
    def bulk_log(self) -> DataFrame:
        """lineitem x orders as a large interaction log (benchmark input)."""
        li = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_linenumber",
                                          "l_returnflag", "l_linestatus", "l_shipdate")
        o = self.raw("orders").select("o_orderkey", "o_custkey")
        j = li.join(o, li.l_orderkey == o.o_orderkey).join(
            self.part_names, li.l_partkey == self.part_names.p_partkey)
        rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
        event = (F.when(rf == "N", "own").when(rf == "A", "rate")
                 .when(ls == "O", "scrap").otherwise("cancel_scrap"))
        # ship dates tie: "latest" is ordered by (ts, l_orderkey, l_linenumber, rating,
        # event); the rating follows from l_linenumber and the event name sorts as
        # cancel_scrap < own < rate < scrap, so one integer carries that order
        code = (F.when(F.col("event") == "cancel_scrap", 0).when(F.col("event") == "own", 1)
                .when(F.col("event") == "rate", 2).otherwise(3))
        j = j.withColumn("event", event)
        return j.select(
            ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 4 + code).cast("long").alias("event_id"),
            event.alias("event"),
            F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user_id"),
            F.lit("cosmetic").alias("target_type"),
            F.col("item_id"),
            F.when(rf == "A", F.lit(0.5) * (F.col("l_linenumber") % 10 + 1)).cast("double").alias("rating"),
            F.col("l_shipdate").alias("ts"),
        )

    @cached_property
    def entity_log(self) -> DataFrame:
        """All users and items as $set property events, as an event collector holds them."""
        p = F.map_filter(F.create_map(
            F.lit("categories"), F.to_json("categories"), F.lit("brand"), F.col("brand"),
            F.lit("cosmetics"), F.to_json("cosmetics"), F.lit("upload_date"), F.col("upload_date")), lambda k, v: v.isNotNull())
        empty = F.create_map().cast("map<string,string>")
        parts = -(-self.raw("part").count() // ENTITIES_PER_TASK)
        items = self.contents.unionByName(self.cosmetics.repartition(max(parts, 1), "item_id"))
        rows = (items.select(F.col("item_type").alias("entity_type"), F.col("item_id").alias("entity_id"), p.alias("properties"))
                .unionByName(self.users.select(F.lit("user").alias("entity_type"), F.col("user_id").alias("entity_id"),
                                               empty.alias("properties"))))
        return rows.select(F.lit(0).cast("long").alias("event_id"), F.lit("2020-01-01 00:00:00").cast("timestamp_ntz").alias("ts"),
                           "entity_type", "entity_id", F.lit("$set").alias("event"), "properties")

    @cached_property
    def requests(self) -> DataFrame:
        """The fixed request cases and one request of every customer."""
        return self.request_cases.unionByName(self.customer_requests)

    @cached_property
    def customer_requests(self) -> DataFrame:
        """A request of every customer about the part of its key (modulo the parts), one of six kinds by its key.

        0, 1: a search for the part's last word and key, among cosmetics, among contents; 2: its brand; 3: its
        type as a category; 4: contents that mention it; 5: a white list of it and the next part.
        """
        kind, n = F.col("c_custkey") % len(CUSTOMER_KINDS), self.raw("part").count()
        asked = self.raw("customer").select("c_custkey", kind.alias("kind"), (F.col("c_custkey") % n).alias("p_partkey"))
        part = self.raw("part").select("p_partkey", part_item_id(F.col("p_name"), F.col("p_partkey")).alias("own"), "p_brand", "p_type",
                                       F.concat(F.element_at(F.split("p_name", " "), -1), F.col("p_partkey").cast("string")).alias("words"))
        following = self.part_names.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("item_id").alias("next"))
        row = asked.join(part, "p_partkey").join(following, "p_partkey", "left")
        when = lambda kinds, c: F.when(F.col("kind").isin(*kinds), c)
        no_list = F.lit(None).cast("array<string>")
        return row.select(
            F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("request_id"), user_id(F.col("c_custkey")).alias("user_id"),
            F.lit(CUSTOMER_NUM).alias("num"), F.when(F.col("kind").isin(1, 4), "content").otherwise("cosmetic").alias("item_type"),
            when([0, 1], F.col("words")).alias("search"), F.lit(None).cast("string").alias("result_type"),
            when([4], F.col("own")).alias("cosmetic"), when([2], F.col("p_brand")).alias("brand"),
            when([3], F.array("p_type")).alias("categories"), when([5], F.array_compact(F.array("own", "next"))).alias("white_list"),
            no_list.alias("black_list"))

    @cached_property
    def request_cases(self) -> DataFrame:
        """The fixed request cases with P(k) resolved to item ids by joins."""
        spec = self.spark.createDataFrame(
            REQUEST_CASES,
            "request_id string, user_id string, num int, item_type string, search string, "
            "result_type string, cosmetic_key long, brand string, categories array<string>, "
            "white_keys array<long>, white_extra array<string>, black_keys array<long>")
        return resolve_part_refs(spec, self.part_names)

    def user_requests(self, num: int = 10, item_type: str = "cosmetic") -> DataFrame:
        """One plain request per registered user (benchmark workload)."""
        return self.users.select(
            F.concat(F.lit("r_"), F.col("user_id")).alias("request_id"), "user_id",
            F.lit(num).cast("int").alias("num"), F.lit(item_type).alias("item_type"),
            *[F.lit(None).cast("string").alias(c) for c in ("search", "result_type", "cosmetic", "brand")],
            *[F.lit(None).cast("array<string>").alias(c) for c in ("categories", "white_list", "black_list")])


def events_to_log(events: DataFrame, part_names: DataFrame) -> DataFrame:
    """events -> interaction log (works on batch and streaming frames alike)."""
    e = events.select("event_id", "ts", "user_id", "event_type",
                      F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    et = F.col("event_type")
    event = (F.when(et == "view", "view").when(et == "click", "play")
             .when(et == "purchase", "own").when(et == "signup", "rate")
             .when(F.col("event_id") % 2 == 0, "scrap").otherwise("cancel_scrap"))
    is_click = et == "click"
    joined = e.join(part_names, e.k == part_names.p_partkey, "inner")
    return joined.select(
        F.col("event_id"),
        event.alias("event"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        F.when(is_click, "content").otherwise("cosmetic").alias("target_type"),
        F.when(is_click, F.concat(F.lit("content "), F.col("k").cast("string")))
         .otherwise(F.col("item_id")).alias("item_id"),
        F.when(et == "signup", F.lit(0.5) * (F.col("event_id") % 10 + 1)).cast("double").alias("rating"),
        F.col("ts"),
    )


def events_to_property_log(events: DataFrame) -> DataFrame:
    """events -> user property log: view $set a, click $set b, purchase $set a+b,
    error $unset a, every 20th signup (event_id % 20 = 1) $delete."""
    e = events.select("event_id", "ts", "user_id", "event_type",
                      F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    et = F.col("event_type")
    k = F.col("k").cast("string")
    props = (F.when(et == "view", F.create_map(F.lit("a"), k))
             .when(et == "click", F.create_map(F.lit("b"), k))
             .when(et == "purchase", F.create_map(F.lit("a"), k, F.lit("b"), k))
             .when(et == "error", F.create_map(F.lit("a"), F.lit("")))
             .otherwise(F.create_map().cast("map<string,string>")))
    op = (F.when(et.isin("view", "click", "purchase"), "$set").when(et == "error", "$unset")
          .when((et == "signup") & (F.col("event_id") % 20 == 1), "$delete"))
    return (e.select("event_id", "ts", F.lit("user").alias("entity_type"),
                     F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("entity_id"),
                     op.alias("event"), props.alias("properties"))
             .filter(F.col("event").isNotNull()))


def resolve_part_refs(spec: DataFrame, part_names: DataFrame) -> DataFrame:
    """Turn part keys in a request spec into item ids (cosmetic, white and black lists)."""
    names = part_names.select(F.col("p_partkey").alias("key"), F.col("item_id").alias("name"))

    def keyed_list(col: str) -> DataFrame:
        ex = spec.select("request_id", F.explode(col).alias("key"))
        return (ex.join(names, "key", "inner").groupBy("request_id")
                .agg(F.collect_set("name").alias(col + "_names")))

    out = (spec.join(names.withColumnRenamed("key", "cosmetic_key"), "cosmetic_key", "left")
               .withColumnRenamed("name", "cosmetic")
               .join(keyed_list("white_keys"), "request_id", "left")
               .join(keyed_list("black_keys"), "request_id", "left"))
    empty = F.array().cast("array<string>")
    white = F.when(F.col("white_keys").isNull(), F.lit(None).cast("array<string>")).otherwise(
        F.array_sort(F.array_union(F.coalesce("white_keys_names", empty),
                                   F.coalesce("white_extra", empty))))
    black = F.when(F.col("black_keys").isNull(), F.lit(None).cast("array<string>")).otherwise(
        F.array_sort(F.coalesce("black_keys_names", empty)))
    return out.select("request_id", "user_id", "num", "item_type", "search", "result_type",
                      "cosmetic", "brand", "categories", white.alias("white_list"),
                      black.alias("black_list"))


def load(spark: SparkSession, sf_dir: str) -> Tables:
    size_files_as_rows(spark)
    return Tables(spark, sf_dir)
