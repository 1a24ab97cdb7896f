"""Corpus pipeline: quality filter, near-duplicates, decontamination, mixing, token ids.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that its
predecessor kept; all but the last return the columns of ``documents``. Between
stages the rows are written as Parquet and read again, so a lost executor costs
at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.llm.decontaminate import drop_contaminated
from affinity.llm.near_dup import drop_near_duplicates
from affinity.llm.quality import score_quality, train_quality
from affinity.llm.queries import held_out, table, tokenizer_path
from affinity.llm.replicate import replicate
from affinity.llm.token_file import encode_documents
from affinity.session import stage


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    while name in docs.columns:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good (score 0.5 or more)."""
    model = train_quality(docs, table(spark, sf_dir, "labels"), ~held_out())
    score = _free(docs, "score")
    return score_quality(docs, model, score_col=score).filter(F.col(score) >= 0.5).drop(score)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one of the smallest id."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), by_text=True)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source at equal weight, the mix as large as the input; a row per copy."""
    copy, place = _free(docs, "copy_no"), _free(docs, "place")
    return replicate(docs, text_col="text", copy_col=copy, place_col=place).drop(copy, place)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id shards of all copies in document order, read back: doc_id, start, n_tokens, ids_crc32."""
    return encode_documents(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_dup", near_dup), ("decontamination", decontamination), ("mixing", mixing),
          ("token_ids", token_ids)]

#: SQL cannot express the classifier, the sampling of near-duplicates or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
