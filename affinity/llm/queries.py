"""One registered query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.llm import collocations as co
from affinity.llm import decontaminate as dc
from affinity.llm import licenses as lc
from affinity.llm import lm_score as lm
from affinity.llm import near_dup as nd
from affinity.llm import quality as qu
from affinity.llm import replicate as rp
from affinity.llm import secrets as sec
from affinity.llm import spelling as sp
from affinity.llm import substring_dedup as sd
from affinity.llm import token_file as tf
from affinity.llm import topk
from affinity.llm import urls

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Longest fitting rule wins.
URL_RULES: list[urls.Rule] = [("block", "net", "/"), ("allow", "example.net", "/en/"),
                              ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id"):
    """Documents whose labels are never used for fitting."""
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


@register("op1_nbsvm")
def nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = qu.train_quality(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = qu.score_quality(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@register("op2_context_mixing")
def context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tf.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@register("op3_poisson_mix")
def poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source at equal weight, the mix as large as the input."""
    return rp.replicate(table(spark, sf_dir, "documents"))


@register("op4_url_rules")
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@register("op5_recompression")
def recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sd.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@register("op6_stupid_backoff")
def stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


@register("op7_winnowing")
def winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dc.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@register("op8_secrets")
def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sec.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


@register("op9_weighted_minhash")
def weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nd.near_duplicates(table(spark, sf_dir, "documents"))


@register("op10_maxscore")
def maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@register("op12_diagonal_voting")
def diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


@register("op13_sorted_list_edits")
def sorted_list_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.group_variants(table(spark, sf_dir, "documents"))


@register("op11_itemset_counting")
def itemset_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.collocations(table(spark, sf_dir, "documents"))
