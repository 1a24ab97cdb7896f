"""Training: logs -> affinity -> implicit ALS -> model tables.

Nothing is collected: the model is four tables,
``user_factors(user_id, features)``, ``item_model(item_id, item_type,
categories, brand, cosmetics, upload_date, features, popularity)``,
``owned(user_id, cosmetic_id)`` and ``mentions(content_id, cosmetic_id)``.
Overlap scores are not stored: they are counted for the users of a request batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinity.config import Params
from affinity.functions.vectors import norm, packed, unpacked
from affinity.operators import entities as en
from affinity.operators import events as ev
from affinity.operators import overlap as ov
from affinity.operators import weights as wt
from affinity.session import stage


@dataclass
class Model:
    user_factors: DataFrame   # user_id, features array<double>
    item_model: DataFrame     # items + features (nullable) + popularity
    owned: DataFrame          # user_id, cosmetic_id: the known cosmetics that users own
    mentions: DataFrame       # content_id, cosmetic_id
    items: DataFrame          # the item table (for overlap zero lists)

    @property
    def owners(self) -> DataFrame:
        return self.owned.select("user_id").distinct()

    def overlap_for(self, users: DataFrame, params: Params = Params()) -> DataFrame:
        """A15 for the given users only: (user_id, content_id, score > 0)."""
        return ov.overlap_of(self.owned, self.mentions, params, users)


TABLES = ("user_factors", "item_model", "owned", "mentions")


@dataclass
class TrainingData:
    users: DataFrame
    items: DataFrame
    log: DataFrame            # raw interaction log (unknown ids included)
    prop_log: DataFrame | None = None   # property events (constraints live here)


def id_dictionary(ids: DataFrame, col: str, idx_col: str, partitions: int | None = None) -> DataFrame:
    """Dense int index for string ids, assigned in id order without one-partition windows.

    Range partitioning sorts ids across tasks; each partition numbers its
    rows locally; partition offsets come from a tiny per-partition count table.
    """
    spark = ids.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (ids.select(col).distinct().repartitionByRange(n, col)
              .withColumn("_pid", F.spark_partition_id()))
    # staged: a second evaluation of the ranges may cut them elsewhere, and numbers and offsets must agree
    local = stage(ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_pid").orderBy(col))), "id_ranges")
    sizes = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)))
    return (local.join(F.broadcast(offsets.select("_pid", "_off")), "_pid")
            .select(col, (F.col("_off") + F.col("_local") - 1).cast("int").alias(idx_col)))


def read_training(log: DataFrame, prop_log: DataFrame) -> TrainingData:
    """Users, content and cosmetics folded from property events, beside the interaction log.

    Item ids must be unique across kinds; the items are staged, as the guard and
    every later step read them.
    """
    items = stage(en.items_from_properties(prop_log), "items")
    en.require_unique_items(items)
    return TrainingData(en.users_view(en.surviving_entities(prop_log, "user")), items, log, prop_log)


def valid_training_log(data: TrainingData, params: Params = Params()) -> DataFrame:
    """Training events (P4-P8 in one frame) of known users on known items (F1)."""
    return ev.valid_events(ev.training_log(data.log, params), data.users, data.items)


def als_factors(affinity: DataFrame, params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """M1: implicit ALS over (user_id, item_id, rating); factors as array<double>."""
    from pyspark.ml.recommendation import ALS

    # the affinity table feeds two dictionaries, their range sampling and the fit:
    # write it once under the checkpoint folder instead of recomputing it from the log
    affinity = stage(affinity.select("user_id", "item_id", "rating"), "affinity")
    uidx = stage(id_dictionary(affinity, "user_id", "uidx"), "user_index")
    iidx = stage(id_dictionary(affinity, "item_id", "iidx"), "item_index")
    ratings = (affinity.join(uidx, "user_id").join(iidx, "item_id")
               .select("uidx", "iidx", F.col("rating").cast("float").alias("rating")))
    # one factor block per task slot of the cluster (Spark's fixed default of 10 starves
    # a large cluster); lineage is cut every 10 iterations into spark.checkpoint.dir
    blocks = params.als_blocks or max(affinity.sparkSession.sparkContext.defaultParallelism, 1)
    als = ALS(rank=params.rank, maxIter=params.iterations, regParam=params.reg, alpha=params.alpha,
              implicitPrefs=True, userCol="uidx", itemCol="iidx", ratingCol="rating",
              numUserBlocks=blocks, numItemBlocks=blocks,
              nonnegative=False, checkpointInterval=10, intermediateStorageLevel="MEMORY_AND_DISK",
              finalStorageLevel="MEMORY_AND_DISK")
    if params.seed is not None:
        als = als.setSeed(int(params.seed))
    m = als.fit(ratings)
    uf = (m.userFactors.join(uidx, m.userFactors.id == uidx.uidx)
          .select("user_id", F.col("features").cast("array<double>").alias("features")))
    itf = (m.itemFactors.join(iidx, m.itemFactors.id == iidx.iidx)
           .select("item_id", F.col("features").cast("array<double>").alias("features")))
    return uf, itf


def als_residuals(affinity: DataFrame, user_factors: DataFrame, item_factors: DataFrame,
                  params: Params = Params()) -> DataFrame:
    """How well each user vector solves its normal equations, given the item vectors: (user_id, residual, scale).

    The last half step of the fit solves, per user, ``(G + sum c y y' + reg n I) x = sum (1 + c) y``: G is the sum of
    ``y y'`` over all items, ``c = alpha |rating|`` over the user's items, and n and the right side count ratings above 0
    only. ``residual`` is the length of the difference of both sides, ``scale`` bounds the size of their terms; their
    ratio is at the rounding of the factors (single precision) where the fit is right. Only G, ``rank x rank`` numbers,
    passes the driver.
    """
    at = range(params.rank)
    y, x = F.col("y"), F.col("x")
    total = lambda parts: sum(parts[1:], parts[0])
    gram = item_factors.agg(F.array(*[F.array(*[F.sum(F.col("features")[i] * F.col("features")[j]) for j in at])
                                      for i in at]).alias("gram")).first()["gram"]
    g = [[F.lit(float(v or 0.0)) for v in row] for row in gram]  # sums over no item are null
    rated = (affinity.select("user_id", "item_id", F.col("rating").cast("float").cast("double").alias("rating"))
             .join(user_factors.select("user_id", F.col("features").alias("x")), "user_id")
             .join(item_factors.select("item_id", F.col("features").alias("y")), "item_id")
             .withColumn("c", F.abs("rating") * F.lit(float(params.alpha)))
             .withColumn("wanted", F.when(F.col("rating") > 0, 1 + F.col("c")).otherwise(F.lit(0.0)))
             .withColumn("dot", total([x[i] * y[i] for i in at]))
             .withColumn("size", total([y[i] * y[i] for i in at])))
    per_user = rated.groupBy("user_id").agg(
        F.first("x").alias("x"), F.count_if(F.col("rating") > 0).alias("n"),
        F.sum(F.col("c") * F.col("size")).alias("weight"), F.sum(F.col("wanted") * F.sqrt("size")).alias("right"),
        F.array(*[F.sum((F.col("c") * F.col("dot") - F.col("wanted")) * y[i]) for i in at]).alias("own"))
    ridge = F.col("n") * F.lit(float(params.reg))
    diff = F.array(*[F.col("own")[i] + ridge * x[i] + total([g[i][j] * x[j] for j in at]) for i in at])
    trace = total([g[i][i] for i in at])
    return per_user.withColumn("diff", diff).select(
        "user_id", norm(F.col("diff")).alias("residual"),
        (F.col("right") + (trace + F.col("weight") + ridge) * norm(x)).alias("scale"))


def build_item_model(items: DataFrame, item_factors: DataFrame, popularity: DataFrame) -> DataFrame:
    """J2 + J3 + P13: items ⟕ factors ⟕ popularity (missing popularity = 0.0)."""
    factors = item_factors.withColumn("features", packed(F.col("features")))
    return (items.join(factors, "item_id", "left").join(popularity, "item_id", "left")
            .withColumn("features", unpacked(F.col("features"))).withColumn("popularity", F.coalesce("popularity", F.lit(0.0))))


def train(data: TrainingData, params: Params = Params(), user_factors: DataFrame | None = None,
          item_factors: DataFrame | None = None, stage_items: bool = True) -> Model:
    """E-A: the whole training run. Given factor tables skip ALS (tests, oracles).

    The item table feeds the validity filter, the content-mention index and
    the item model; it is staged once (``stage_items``) instead of being
    rebuilt for each.
    """
    if stage_items:
        data = TrainingData(data.users, stage(data.items, "items"), data.log, data.prop_log)
    ev.require_nonempty(data.users, "users")
    ev.require_nonempty(data.items, "items")
    valid = valid_training_log(data, params)
    stats = stage(wt.pair_stats(valid, params), "pair_stats")     # feeds affinity, popularity and ownership
    affinity = wt.affinity_from_stats(stats, params)
    popularity = wt.popularity_from_stats(stats, params)
    if user_factors is None or item_factors is None:
        ev.require_nonempty(affinity, "affinity")
        user_factors, item_factors = als_factors(affinity, params)
    owned = stats.filter(F.col("own_part").isNotNull()).select("user_id", F.col("item_id").alias("cosmetic_id"))
    return Model(user_factors=user_factors,
                 item_model=build_item_model(data.items, item_factors, popularity),
                 owned=owned, mentions=ov.content_mentions(data.items), items=data.items)


def save(model: Model, path: str) -> None:
    """Write the model tables as Parquet (cuts lineage for serving jobs)."""
    for name in TABLES:
        getattr(model, name).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Model:
    t = {n: spark.read.parquet(f"{path}/{n}") for n in TABLES}
    items = t["item_model"].select("item_id", "item_type", "categories", "brand", "cosmetics", "upload_date")
    return Model(t["user_factors"], t["item_model"], t["owned"], t["mentions"], items)


def materialize(model: Model, tables=TABLES) -> Model:
    """Cut lineage: the named model tables written under ``spark.checkpoint.dir``
    (what a serving job would read back from storage); the others stay lazy."""
    t = {n: (stage(getattr(model, n), n) if n in tables else getattr(model, n))
         for n in TABLES}
    items = t["item_model"].select("item_id", "item_type", "categories", "brand", "cosmetics", "upload_date")
    return Model(t["user_factors"], t["item_model"], t["owned"], t["mentions"], items)


def _compared_by(df: DataFrame) -> DataFrame:
    """The rows as they are compared: those with lists by a digest of all their values, which is what is shuffled."""
    if not any(kind.startswith("array") for _, kind in df.dtypes):
        return df
    return df.select(F.unhex(F.md5(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))).alias("_digest"))


def differences(saved: Model, loaded: Model) -> DataFrame:
    """Per model table its rows, those that the loaded copy lost and those that it added (as multisets)."""
    out = None
    for name in TABLES:
        # one pass: each distinct row counts +1 where it was saved and -1 where it was loaded
        was = getattr(saved, name)
        both = (_compared_by(was).withColumn("_side", F.lit(1))
                .unionByName(_compared_by(getattr(loaded, name).select(*was.columns)).withColumn("_side", F.lit(-1))))
        cols = [c for c in both.columns if c != "_side"]
        rows = (both.groupBy(*cols).agg(F.sum("_side").alias("_net"), F.count_if(F.col("_side") > 0).alias("_n"))
                .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
                     F.coalesce(F.sum(F.greatest("_net", F.lit(0))), F.lit(0)).alias("n_lost"),
                     F.coalesce(F.sum(F.greatest(-F.col("_net"), F.lit(0))), F.lit(0)).alias("n_added"))
                .select(F.lit(name).alias("table_name"), "n_rows", "n_lost", "n_added"))
        out = rows if out is None else out.unionByName(rows)
    return out
