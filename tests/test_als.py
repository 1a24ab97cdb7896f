"""Invariants of the ALS model (M1) and the id dictionary."""

from pyspark.sql import functions as F

from affinity.config import Params
from affinity.functions.vectors import dot
from affinity.operators import weights as wt
from affinity.plans import model as md
from affinity.sources.fixtures import load
from tests.conftest import SF_SMALL


def test_als_factors(spark):
    t = load(spark, SF_SMALL)
    aff = wt.affinity_from_stats(wt.pair_stats(md.valid_training_log(md.TrainingData(t.users, t.items, t.log))))
    uf, itf = md.als_factors(aff, Params())
    n_users = aff.select("user_id").distinct().count()
    n_items = aff.select("item_id").distinct().count()
    assert uf.count() == n_users and itf.count() == n_items
    assert uf.select(F.min(F.size("features")), F.max(F.size("features"))).first() == (10, 10)
    # held-in pairs with positive affinity score above the average of all pairs
    scored = (aff.join(uf.withColumnRenamed("features", "u"), "user_id")
              .join(itf.withColumnRenamed("features", "i"), "item_id")
              .select("rating", dot(F.col("u"), F.col("i")).alias("s")))
    pos = scored.filter("rating > 0").agg(F.avg("s")).first()[0]
    allp = (uf.withColumnRenamed("features", "u").crossJoin(itf.withColumnRenamed("features", "i"))
            .select(dot(F.col("u"), F.col("i")).alias("s")).agg(F.avg("s")).first()[0])
    assert pos > allp


def test_id_dictionary_is_dense_and_ordered(spark):
    ids = spark.createDataFrame([(f"u{i:03d}",) for i in range(57)] * 2, "user_id string")
    d = md.id_dictionary(ids, "user_id", "uidx", partitions=5).orderBy("user_id").collect()
    assert [r.uidx for r in d] == list(range(57))


def test_als_residuals_tell_a_fit_from_other_factors(spark):
    rows = [(f"u{u}", f"i{i}", float((u * 7 + i * 3) % 9 - 2)) for u in range(20) for i in range(12) if (u + i) % 3]
    aff = spark.createDataFrame(rows, "user_id string, item_id string, rating double")  # negative, zero and positive
    p = Params()
    uf, itf = md.als_factors(aff, p)
    ratio = F.max(F.col("residual") / F.col("scale"))
    worst, n = md.als_residuals(aff, uf, itf, p).agg(ratio, F.count("*")).first()
    assert worst < 1e-5 and n == 20
    moved = uf.withColumn("features", F.transform("features", lambda v: v + 0.05))
    assert md.als_residuals(aff, moved, itf, p).agg(F.min(F.col("residual") / F.col("scale"))).first()[0] > 1e-4
