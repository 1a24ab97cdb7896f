"""Exact top-k inner products by MaxScore.

A vector's components are the impacts of its postings: dimension d lists every
candidate with its value. Shifting each list by its least contribution to the
query makes all contributions non-negative without changing the order, so the
usual score bounds hold. Per candidate shard a query's terms are ordered by
bound; terms whose bounds sum to less than the k-th best score cannot lift a
candidate into the answer and are non-essential: essential postings are
traversed, the others are probed only while a candidate stays competitive. The
k best of each shard are merged by a window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinity.operators.overlap import tasks
from affinity.session import stage

#: Shards per task slot, so that slots stay busy to the end.
SHARDS_PER_TASK = 4


def shard_postings(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posting lists (one row per dimension) and their least and greatest values."""
    postings = np.ascontiguousarray(vectors.T)
    return postings, postings.min(axis=1), postings.max(axis=1)


def max_score(postings, low, high, ids, query, own, k: int, step: int = 4096):
    """The k best (score, id) of a shard for one query, by score desc, id asc; ``own`` is left out."""
    weight = np.where(query > 0, high - low, 0) * query + np.where(query < 0, low - high, 0) * query
    order = np.argsort(weight, kind="stable")
    bounds = np.cumsum(weight[order])  # bound of the i+1 weakest terms
    base = np.where(query > 0, low, high)
    offset = int((query * base).sum())
    used = int(np.searchsorted(weight[order], 0, side="right"))  # terms of bound 0 add nothing
    best_s = np.zeros(0, np.int64)
    best_i = np.zeros(0, np.int64)
    for at in range(0, postings.shape[1], step):
        part, names = postings[:, at:at + step], ids[at:at + step]
        alive = np.flatnonzero(names != own)
        floor = best_s[-1] if len(best_s) == k else None
        split = used if floor is None else max(used, int(np.searchsorted(bounds, floor, side="left")))
        essential = order[split:]
        score = (query[essential] @ part[essential] - query[essential] @ base[essential])[alive]
        for j in range(split - 1, used - 1, -1):
            if floor is not None:
                keep = score + bounds[j] >= floor
                if not keep.all():
                    alive, score = alive[keep], score[keep]
            if not len(alive):
                break
            d = order[j]
            score = score + query[d] * (part[d, alive] - base[d])
        best_s = np.concatenate([best_s, score])
        best_i = np.concatenate([best_i, names[alive]])
        rank = np.lexsort((best_i, -best_s))[:k]
        best_s, best_i = best_s[rank], best_i[rank]
    return best_s + offset, best_i


def _narrowest(least: int, most: int) -> str:
    """The smallest integer type for values from ``least`` to ``most``."""
    return next(t for t in ("int16", "int32", "int64") if np.iinfo(t).min <= least and most <= np.iinfo(t).max)


def _pack(df: DataFrame, block: str, dims: int, kind: str) -> DataFrame:
    """One row per block: ids and the vectors (padded with zeros to ``dims``) as packed integers of type ``kind``."""
    def pack(key, table):
        ids = table.column("_id").to_numpy().astype(np.int64)
        order = np.argsort(ids)
        rows = table.column("_v").to_pylist()
        out = np.zeros((len(ids), dims), kind)
        for i, j in enumerate(order):
            out[i, :len(rows[j])] = rows[j]
        return pa.table({block: [key[0].as_py()], "_ids": pa.array([ids[order].tobytes()], pa.binary()),
                         "_vs": pa.array([out.tobytes()], pa.binary())})
    return df.groupBy(block).applyInArrow(pack, f"{block} long, _ids binary, _vs binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 256, shard_rows: int = 4096, query_rows: int = 512, most_rows: int = 65_536) -> DataFrame:
    """(query_id, rank, id, score) of the k best other rows for every query row.

    Components become floor(scale * x) and scores are integer inner products
    (64 bits; components must stay below about 2**28); ties go to the smaller id.
    Rows with a null id, a null vector or a null or non-finite component take no
    part. Each row of an id that occurs more than once is a candidate, and its rows
    ask together: of the pairs of any of them with other ids' rows the k best count.
    Shorter vectors are padded with zeros. Fewer than k candidates give fewer rows.

    A shard meets every block of queries in turn, so candidates are shuffled once and
    queries once a shard. Shards hold ``shard_rows``, more where there would be more of them than
    keep all tasks busy, ``most_rows`` at most.
    """
    x = F.col("_raw")
    sound = F.col("_id").isNotNull() & x.isNotNull() & ~F.exists(
        x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = (vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_raw"), is_query.alias("_q"))
            .filter(F.coalesce(sound, F.lit(False)))
            .select("_id", F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("_v"),
                    F.coalesce("_q", F.lit(False)).alias("_q"), F.monotonically_increasing_id().alias("_row")))
    rows = stage(rows, "vectors")  # the row numbers are fixed from here on
    n, n_queries, dims, least, most = rows.agg(
        F.count("*"), F.count_if("_q"), F.coalesce(F.max(F.size("_v")), F.lit(0)),
        F.coalesce(F.min(F.array_min("_v")), F.lit(0)), F.coalesce(F.max(F.array_max("_v")), F.lit(0))).first()
    kind, slots = _narrowest(least, most), tasks(rows)
    shards = max(1, -(-n // most_rows), min(-(-n // shard_rows), SHARDS_PER_TASK * slots))
    blocks = max(1, -(-n_queries // query_rows))
    block = lambda count: F.pmod(F.xxhash64("_row"), F.lit(count))
    packed = _pack(rows.withColumn("_shard", block(shards)), "_shard", dims, kind)
    queries = _pack(rows.filter("_q").withColumn("_block", block(blocks)), "_block", dims, kind)
    asked = queries.select(F.col("_ids").alias("_qids"), F.col("_vs").alias("_qvs"),
                           F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")).alias("_shard"))
    # a merge join: the planner's estimates miss the copies, and would build all of them in the driver to broadcast them
    cells = packed.repartition(slots, "_shard").join(asked.repartition(slots, "_shard").hint("merge"), "_shard")

    def score(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["_ids"], np.int64)
                postings, low, high = shard_postings(np.frombuffer(row["_vs"], kind).astype(np.int64).reshape(len(ids), dims))
                qids = np.frombuffer(row["_qids"], np.int64)
                got = [(q, *max_score(postings, low, high, ids, v, q, k))
                       for q, v in zip(qids, np.frombuffer(row["_qvs"], kind).astype(np.int64).reshape(len(qids), dims))]
                if got:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(np.array([q for q, _, _ in got]), [len(i) for _, _, i in got])),
                         pa.array(np.concatenate([i for _, _, i in got])), pa.array(np.concatenate([s for _, s, _ in got]))],
                        names=["query_id", id_col, "score"])

    found = cells.select("_ids", "_vs", "_qids", "_qvs").mapInArrow(score, f"query_id long, `{id_col}` long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col))
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), id_col, "score"))
