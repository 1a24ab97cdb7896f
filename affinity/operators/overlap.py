"""Owned-cosmetic overlap (F19, A14, A15, J5; RW1 + RW2).

score(user, content) = 5 x |content.cosmetics ∩ cosmetics the user owns|.

The users x contents set intersection becomes an equi-join of
owned(user, cosmetic) with mentions(content, cosmetic) on the cosmetic,
then a count per (user, content). Only non-zero scores are stored; the
scorers add the zeros back. A popular cosmetic is one hot join key, by its
owners or by its mentions: keys with many (owner, content) pairs are laid out
as a grid over both sides, every other key joins plainly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.config import CONTENT, Params
from affinity.session import stage

#: Pairs that one task counts; its table of counts holds at most as many rows.
TASK_PAIRS = 1_000_000


def tasks(df: DataFrame) -> int:
    """Tasks of a join whose result is large though its sides may be small."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def content_mentions(items: DataFrame) -> DataFrame:
    """(content_id, cosmetic_id) for content with >=1 cosmetic; unknown refs dropped."""
    mentions = (items.filter((F.col("item_type") == CONTENT) & (F.size("cosmetics") > 0))
                .select(F.col("item_id").alias("content_id"),
                        F.explode(F.array_distinct("cosmetics")).alias("cosmetic_id"))
                .filter(F.col("cosmetic_id").isNotNull()))
    known = items.select(F.col("item_id").alias("cosmetic_id"))
    return mentions.join(known, "cosmetic_id", "left_semi")


def listed_contents(items: DataFrame) -> DataFrame:
    """Content that takes part in the overlap model: a non-empty cosmetics list."""
    return items.filter((F.col("item_type") == CONTENT) & (F.size("cosmetics") > 0))


def owned(own_events: DataFrame) -> DataFrame:
    """Distinct (user, cosmetic) owned; input = valid own events."""
    return own_events.select("user_id", F.col("item_id").alias("cosmetic_id")).distinct()


def split_equi_join(left: DataFrame, right: DataFrame, key: str, left_by: str, right_by: str, pairs: int,
                    parts: int | None = None) -> DataFrame:
    """Equi-join on ``key`` whose result of any one key is made by cells of about ``pairs`` rows.

    A key with more result rows (left rows x right rows) is laid out as a grid:
    its left rows are dealt over the grid's rows by a hash of ``left_by`` and
    copied to all its columns, its right rows the other way round. All other keys
    are a grid of one cell, so they join plainly. Whatever the number of such
    keys, their grid sizes are joined as rows. ``parts`` fixes the number of tasks of the
    join, for small sides with a large result, which would else be merged into one.
    """
    side = F.lit(max(1.0, float(pairs) ** 0.5))
    sizes = (left.groupBy(key).agg(F.count(F.lit(1)).alias("_l")).join(right.groupBy(key).agg(F.count(F.lit(1)).alias("_r")), key)
             .filter(F.col("_l") * F.col("_r") > pairs)
             .select(key, F.ceil(F.col("_l") / side).alias("_rows"), F.ceil(F.col("_r") / side).alias("_columns")))
    one = F.lit(1).cast("long")
    rows, columns = F.coalesce("_rows", one), F.coalesce("_columns", one)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    grid = lambda df: df.join(sizes, key, "left")
    a = (grid(left).withColumn("_row", F.pmod(F.xxhash64(left_by), rows)).withColumn("_column", every(columns))
         .drop("_rows", "_columns"))
    b = (grid(right).withColumn("_column", F.pmod(F.xxhash64(right_by), columns)).withColumn("_row", every(rows))
         .drop("_rows", "_columns"))
    if parts is not None:
        a, b = (x.repartition(parts, key, "_row", "_column") for x in (a, b))
    return a.join(b, [key, "_row", "_column"]).drop("_row", "_column")


def overlap_of(owned_pairs: DataFrame, mentions: DataFrame, params: Params = Params(),
               users: DataFrame | None = None) -> DataFrame:
    """A15 (sparse): (user_id, content_id, score > 0), of the given ``users`` only before any pair is made."""
    if users is not None:
        owned_pairs = owned_pairs.join(users.select("user_id").distinct(), "user_id", "left_semi")
    owned_pairs = stage(owned_pairs, "owned_pairs")    # read for the counts, the grid and the join
    per = lambda df, n: df.groupBy("cosmetic_id").agg(F.count(F.lit(1)).alias(n))
    made = per(owned_pairs, "_l").join(per(mentions, "_r"), "cosmetic_id").agg(F.sum(F.col("_l") * F.col("_r"))).first()[0] or 0
    # tasks in proportion to the pairs: neither the pairs a task makes nor the scores it counts grow with the input
    parts = max(tasks(owned_pairs), -(-made // TASK_PAIRS))
    pairs = split_equi_join(owned_pairs, mentions, "cosmetic_id", "user_id", "content_id", params.hot_key_pairs, parts)
    return (pairs.select("user_id", "content_id").repartition(parts, "user_id", "content_id").groupBy("user_id", "content_id")
            .agg((F.count(F.lit(1)) * F.lit(params.overlap_weight)).alias("score")))


def overlap_scores(own_events: DataFrame, items: DataFrame, params: Params = Params(),
                   users: DataFrame | None = None) -> DataFrame:
    """A15 from valid own events and the item table."""
    return overlap_of(owned(own_events), stage(content_mentions(items), "mentions"), params, users)


def owners(own_events: DataFrame) -> DataFrame:
    """Users who own at least one known cosmetic (they get an overlap list)."""
    return own_events.select("user_id").distinct()
