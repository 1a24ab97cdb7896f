"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

The mean repetition rate of a source is its share of the wanted total over its
own size. A hash of (seed, document) picks a point of the unit interval and the
Poisson distribution is inverted there, which gives every document its number of
copies independently of all other rows, of the partitioning and of retries. The
copies are dealt into a seeded global order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.llm.common import carried
from affinity.session import stage

#: A Poisson of a larger mean is the sum of independent ones of at most this mean, each with a seed of its own.
MEAN_STEP = 16.0
#: Terms of the inverted distribution: P(X > 95) for mean 16 is below 2**-64 ... the hash has 52 bits.
TERMS = 96

#: The table of sources (under 1 KB a row) is broadcast up to this many rows, else joined by shuffle.
BROADCAST_SOURCES = 10_000


def unit_hash(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash of seed and parts (also expressible in other SQL engines)."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_table(mean: Column) -> Column:
    """Cumulative probabilities P(X <= 0), P(X <= 1), ... of a Poisson distribution."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    step = lambda a, i: F.struct((a["p"] * mean / i).alias("p"),
                                 F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * mean / i)).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step, lambda a: a["c"])


def source_rates(docs: DataFrame, weights: dict[str, float], default_weight: float, total: float,
                 source_col: str = "source") -> DataFrame:
    """(source, n, rate): rate = total x weight / (sum of the weights of the sources present) / n."""
    named = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
    counts = docs.groupBy(F.col(source_col).alias("_source")).agg(F.count("*").alias("n"))
    weight = F.coalesce(named[F.col("_source")], F.lit(default_weight)) if named is not None else F.lit(default_weight)
    counts = counts.withColumn("_weight", weight.cast("double"))
    weights_sum, rows = counts.agg(F.sum("_weight"), F.sum("n")).first()  # two numbers, null for an empty table
    scale = total * rows if rows else 0.0
    return counts.select("_source", "n", (F.lit(float(scale)) * F.col("_weight") / F.lit(float(weights_sum or 1)) / F.col("n")).alias("rate"))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, total: float = 1.0,
              seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", copy_col: str = "copy_no",
              place_col: str = "place", partitions: int | None = None, text_col: str | None = None) -> DataFrame:
    """The documents' columns, each row once per drawn copy, with ``copy_no`` (from 0) and ``place``, in order of place.

    ``total`` is the size of the mix in units of the input. A source without a
    weight has ``default_weight``; null is a source of its own. Weight 0 drops a
    source. Copies depend on (seed, id) only, so repeated rows of one id draw
    the same count; a null id draws like the text "null", or with ``text_col``
    by the digest of its text. ``place`` is a seeded
    hash in [0, 1): rows are range-partitioned and sorted by it, so any file is
    a fair sample. An empty table gives an empty result. An input column named
    like ``copy_col`` or ``place_col`` is replaced; any other keeps its name.
    """
    rates = source_rates(docs.select(source_col), weights or {}, default_weight, total, source_col)
    parts = F.greatest(F.ceil(F.col("rate") / MEAN_STEP), F.lit(1)).cast("int")
    tables = stage(rates.withColumn("_parts", parts)
              .select("_source", "_parts", poisson_table(F.col("rate") / F.col("_parts")).alias("_table")), "rates")
    if tables.count() <= BROADCAST_SOURCES:
        tables = F.broadcast(tables)
    columns = [c for c in docs.columns if c not in (copy_col, place_col)]
    own, text = docs[f"`{id_col}`"], docs[f"`{text_col}`"] if text_col else None
    if text_col:
        own = F.coalesce(own.cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    rows = docs.select(carried(docs, columns), own.alias("_own"), docs[f"`{id_col}`"].alias("_id"),
                       docs[f"`{source_col}`"].alias("_from"))
    drawn = rows.join(tables, F.col("_from").eqNullSafe(F.col("_source")))
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("_parts")), F.lit(0).cast("long"),
        lambda n, i: n + F.size(F.filter("_table", lambda c: c <= unit_hash(seed, F.col("_own"), i))))
    copies = drawn.select("_row", "_own", "_id", F.posexplode(F.array_repeat(F.lit(True), count.cast("int"))).alias("_number", "_copy"))
    # places are uniform, so equal slices of [0, 1) are even partitions and no sampling pass has to find their bounds
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = copies.withColumn("_number", F.col("_number").cast("long"))
    placed = copies.withColumn("_place", unit_hash(seed + "/place", F.col("_own"), F.col("_number"))).drop("_own", "_copy")
    return (placed.repartitionById(n, F.floor(F.col("_place") * n).cast("int")).sortWithinPartitions("_place", "_id", "_number")
            .select("_row.*", F.col("_number").alias(copy_col), F.col("_place").alias(place_col)))
