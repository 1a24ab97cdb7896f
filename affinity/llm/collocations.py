"""Phrase collocations by dynamic itemset counting.

The texts are cut into pieces and words once and stored in shards. Scans go round
the shards, one shard a step, and phrases of all lengths are counted side by side:
a longer phrase becomes active at the step after both of its parts (all but its
last, all but its first word) have been counted often enough, and is counted for
one full cycle from there. So its count is exact, and a phrase that is frequent
is active at the latest when the cycles of its parts end.

What the tasks of a step must know is at which step a part got frequent. They get
it as a table of a fixed number of slots for each length, one byte a slot: the
least such step of the phrases whose hash falls there. A slot that phrases share
only makes more phrases active (for one full cycle all the same); which phrases
are frequent is decided on exact counts of the phrases themselves.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinity.llm.common import concat_texts, mix, pack, split_words, text_slices, unpack
from affinity.session import checkpoint_dir, stage

#: Longest phrase, least count, shards of a cycle, phrases reported for each language.
LONGEST, LEAST, SHARDS, REPORTED = 4, 30, 2, 2000
#: Bytes of text to a stored block; the most slots of a table (one byte each).
BLOCK_BYTES, MOST_SLOTS = 4 << 20, 1 << 24
_BITMAP = 1 << 15  # bits of one of Spark's bitmaps

_BYTE = np.arange(256, dtype=np.uint8)
_TO_LOWER = np.where((_BYTE >= ord("A")) & (_BYTE <= ord("Z")), _BYTE + 32, _BYTE).astype(np.uint8)
_BREAK = np.isin(_BYTE, np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
_WORD = ~_BREAK & ~np.isin(_BYTE, np.frombuffer(b" \t", np.uint8))
_COUNTS = "lang string, phrase string, size int, slot int, start int, a long"


# ---- the stored corpus -----------------------------------------------------

def _encoded(texts: pa.Array) -> tuple[int, bytes, bytes] | None:
    """Number of words, the distinct words, and all words as their numbers with -1 before each piece."""
    data, offsets = concat_texts(texts)
    data = _TO_LOWER[data]
    starts, ends, doc = split_words(data, offsets, _WORD)
    if len(starts) == 0:
        return None
    breaks = np.cumsum(_BREAK[data], dtype=np.int64)[starts]
    first = np.ones(len(starts), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (breaks[1:] != breaks[:-1])
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[_WORD[data]])])
    coded = words.dictionary_encode()
    codes = np.full(len(starts) + int(first.sum()), -1, np.int32)
    codes[np.arange(len(starts)) + np.cumsum(first)] = coded.indices.to_numpy()
    # a word holds no blank
    return len(starts), zstandard.ZstdCompressor(level=1).compress(b" ".join(coded.dictionary.to_pylist())), pack(codes)


def _blocks(docs: DataFrame, shards: int, lang_col: str, text_col: str) -> DataFrame:
    """(shard, lang, words, vocabulary, codes): blocks of texts of one language, dealt out over the shards."""
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                own = batch.filter(pc.equal(langs.indices, i))
                for part in text_slices([own], own.schema.names[1], BLOCK_BYTES):
                    found = _encoded(part.column(1))
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([number % shards], pa.int32()), pa.array([lang]), pa.array([found[0]], pa.int64()),
                             pa.array([found[1]], pa.binary()), pa.array([found[2]], pa.binary())],
                            names=["shard", "lang", "words", "vocabulary", "codes"])
                        number += 1

    read = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("_text"))
    return read.filter("_text IS NOT NULL").mapInArrow(encode, "shard int, lang string, words long, vocabulary binary, codes binary")


# ---- one step: count the active phrases of a shard ---------------------------

def _phrase_hash(hashes: np.ndarray, following: np.ndarray) -> np.ndarray:
    return mix(hashes * np.uint64(3) + following)


def _distinct(codes: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first place, count) of each distinct run of ``size`` codes among those at ``at``."""
    base, group = int(codes.max()) + 1, codes[at].astype(np.int64)
    for j in range(1, size):
        key = group * base + codes[at + j]
        _, place, group, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    if size == 1:
        _, place, count = np.unique(group, return_index=True, return_counts=True)
    return at[place], count


def active_phrases(codes: np.ndarray, hashes: np.ndarray, reached: list[np.ndarray], step: int, shards: int, longest: int):
    """For each size: (size, places, their hashes, start) of the phrases that are active at ``step``.

    ``codes`` are word numbers with -1 between pieces, ``hashes`` the words'
    hashes, ``reached[n - 1]`` the table of phrases of n words: 0 or one more
    than the step at which they got frequent.
    """
    at = np.flatnonzero(codes >= 0)
    h, begun = np.zeros(len(codes), np.uint64), np.zeros(len(codes), np.uint8)
    h[at] = hashes[codes[at]]
    words = h
    if step < shards:
        yield 1, at, h[at], begun[at]
    for size in range(2, longest + 1):
        table = reached[size - 2]
        since = np.zeros(len(codes), np.uint8)  # the step from which the part is known to be frequent, 0 if it is not
        since[at] = table[h[at] & np.uint64(len(table) - 1)]
        # where a slot is shared, a part can seem frequent before it is active itself: the latest of all counts,
        # so that a phrase is seen from its start on at every step
        since[at] = np.where(since[at] > 0, np.maximum(since[at], begun[at]), 0)
        at = at[at + 1 < len(codes)]
        at = at[(since[at] > 0) & (since[at + 1] > 0)]
        if len(at) == 0:
            return
        begun = np.zeros(len(codes), np.uint8)
        begun[at] = start = np.maximum(since[at], since[at + 1])
        longer = np.zeros(len(codes), np.uint64)
        longer[at] = _phrase_hash(h[at], words[at + size - 1])
        h = longer
        now = (start <= step) & (step < start.astype(np.int64) + shards)
        if now.any():
            yield size, at[now], h[at[now]], start[now]


def _count(blocks: DataFrame, reached, step: int, shards: int, longest: int, slots: int) -> DataFrame:
    """Counts of the active phrases in each block (``_COUNTS``); ``reached`` is a broadcast of packed tables."""
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [unpack(t, np.uint8) for t in reached.value]
        for batch in batches:
            for row in batch.to_pylist():
                lang = row["lang"].encode()
                words = zstandard.ZstdDecompressor().decompressobj().decompress(row["vocabulary"]).split(b" ")
                hashes = np.fromiter((xxhash.xxh3_64_intdigest(lang + b" " + w) for w in words), np.uint64, len(words))
                codes, words = unpack(row["codes"], np.int32), pa.array(words, pa.binary())
                for size, at, h, start in active_phrases(codes, hashes, tables, step, shards, longest):
                    place, count = _distinct(codes, at, size)
                    own = np.searchsorted(at, place)
                    phrase = words.take(pa.array(codes[place]))
                    for j in range(1, size):
                        phrase = pc.binary_join_element_wise(phrase, words.take(pa.array(codes[place + j])), b" ")
                    slot = (h[own] & np.uint64(slots - 1)).astype(np.int32)
                    n = len(place)
                    table = pa.table({"lang": pa.array([row["lang"]]).take(pa.array(np.zeros(n, np.int32))), "phrase": phrase.cast(pa.string()),
                                      "size": np.full(n, size, np.int32), "slot": slot, "start": start[own].astype(np.int32), "a": count.astype(np.int64)})
                    yield from table.to_batches(max_chunksize=50_000)

    return blocks.select("lang", "vocabulary", "codes").mapInArrow(scan, _COUNTS)


def _slots_of(reached: DataFrame, sizes: int, slots: int) -> list[np.ndarray]:
    """For each size: which slots its phrases take, gathered as Spark's bitmaps (their number is bounded by that of the slots)."""
    bits = [np.zeros(slots, bool) for _ in range(sizes)]
    rows = (reached.groupBy("size", F.expr(f"slot div {_BITMAP}").alias("part"))
            .agg(F.bitmap_construct_agg((F.col("slot") % _BITMAP).cast("long")).alias("bits")))
    for row in rows.collect():
        own = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little").astype(bool)
        first = row["part"] * _BITMAP
        bits[row["size"] - 1][first:first + _BITMAP] |= own[:slots - first]
    return bits


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def frequent_phrases(blocks: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS,
                     slots: int | None = None) -> DataFrame | None:
    """(lang, phrase, size, a) of all phrases of at most ``longest`` words that occur ``least`` times; None without any word."""
    if longest * shards > 250:
        raise ValueError("longest x shards must be at most 250: a slot holds a step in one byte")
    spark = blocks.sparkSession
    total = blocks.agg(F.sum("words")).first()[0]
    if not total:
        return None
    # at most total / least phrases of a size can be frequent
    slots = slots or int(min(MOST_SLOTS, max(1 << 16, 1 << int(2 * total / least).bit_length())))
    reached = [np.zeros(slots, np.uint8) for _ in range(longest - 1)]
    root = f"{checkpoint_dir(spark).rstrip('/')}/tables/phrases-{uuid.uuid4().hex[:12]}"
    schema = spark.createDataFrame([], _COUNTS + ", reached int, done boolean").schema
    running, step, last_start = None, 0, 0
    while step < last_start + shards:
        sent = spark.sparkContext.broadcast([pack(t) for t in reached])
        rows = (_count(blocks.filter(F.col("shard") == step % shards), sent, step, shards, longest, slots)
                .withColumn("reached", F.lit(None).cast("int")))
        if running is not None:
            rows = rows.unionByName(running)
        done = F.col("start") + (shards - 1) <= step
        counted = (rows.groupBy("lang", "phrase")
                   .agg(F.max("size").alias("size"), F.max("slot").alias("slot"), F.min("start").alias("start"), F.sum("a").alias("a"),
                        F.min("reached").alias("reached"))
                   .withColumn("reached", F.coalesce("reached", F.when(F.col("a") >= least, F.lit(step))))
                   .withColumn("done", done).filter(~F.col("done") | (F.col("a") >= least)))
        # phrases whose cycle is over stay where they are, the others go on to the next step
        counted.write.partitionBy("done").parquet(f"{root}/step={step}")
        sent.unpersist()
        if step:
            _remove(spark, f"{root}/step={step - 1}/done=false")
        now = spark.read.schema(schema).parquet(f"{root}/step={step}")
        new = now.filter((F.col("reached") == step) & (F.col("size") < longest))
        for table, took in zip(reached, _slots_of(new, longest - 1, slots)):
            if took.any():
                last_start = step + 1
                table[took & (table == 0)] = step + 1
        running = now.filter("NOT done").drop("done")
        step += 1
    return spark.read.schema(schema.add("step", "integer")).parquet(root).filter("done").select("lang", "phrase", "size", "a")


# ---- collocations ------------------------------------------------------------

def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, reported: int | None = REPORTED,
                 absorbed: int = 80, lang_col: str = "lang", text_col: str = "text", slots: int | None = None) -> DataFrame:
    """Each language's best phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score.

    A phrase lies within a piece of a text (pieces end at . , ; : ! ? and line
    breaks); words end at blanks and tabs; A-Z count as a-z. a is its count, l
    and r are those of its two parts at the cut of least score (of equal scores
    the first cut), n the language's words, score floor(2,000,000 a / (l + r)).
    A phrase is left out if a longer one around it has at least ``absorbed``
    per cent of its count. Ranked by score, a (both descending) and phrase (UTF-8
    bytes); ``reported=None`` gives all.

    A null language is `und`; null and empty texts have no words; repeated rows
    count each; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    blocks = _blocks(docs, shards, lang_col, text_col)
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/phrase_blocks-{uuid.uuid4().hex[:12]}"
    blocks.write.partitionBy("shard").parquet(path)
    blocks = spark.read.schema("lang string, words long, vocabulary binary, codes binary, shard int").parquet(path)
    found = frequent_phrases(blocks, least, longest, shards, slots)
    if found is None:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    n = blocks.groupBy("lang").agg(F.sum("words").alias("n"))
    found = stage(found, "frequent_phrases")
    longer = found.filter("size > 1")
    words = F.split("phrase", " ")
    run = lambda w, at, size: F.array_join(F.slice(w, at, size), " ")

    part = lambda name: found.select("lang", F.col("phrase").alias(f"_{name}"), F.col("a").alias(name))
    cuts = (longer.select("lang", "phrase", "a", "size", words.alias("_w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("_k"))
            .select("lang", "phrase", "a", "_k", run(F.col("_w"), 1, F.col("_k")).alias("_l"),
                    run(F.col("_w"), F.col("_k") + 1, F.col("size") - F.col("_k")).alias("_r")))
    exact = F.expr("(cast(2000000 as decimal(10, 0)) * cast(a as decimal(20, 0))) div cast(l + r as decimal(20, 0))")
    scored = (cuts.join(part("l"), ["lang", "_l"]).join(part("r"), ["lang", "_r"])
              .withColumn("score", exact.cast("long"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "_k", "l", "r")).alias("_best")))

    # every run of two or more words within a longer phrase
    inner = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(_w, i, m), ' '))))")
    around = (longer.filter("size > 2").select("lang", "a", "size", words.alias("_w"))
              .select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("_longer")))
    kept = (scored.join(around, ["lang", "phrase"], "left")
            .filter(F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("a") * absorbed)))
    best = kept.select("lang", "phrase", "a", "_best.l", "_best.r", "_best.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    ranked = best.withColumn("rank", F.row_number().over(order))
    if reported is not None:
        ranked = ranked.filter(F.col("rank") <= reported)  # each task first cuts its own rows to these
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
