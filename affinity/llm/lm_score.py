"""Stupid-backoff language-model scores from partitioned count tables.

The corpus is cut into blocks. Every block lists its distinct n-grams (64-bit
hashes, sorted) with their counts and sends each hash range to the partition of
the count table that owns it; an n-gram that fills a third of the corpus is one
entry per block, so no partition is hot. A partition sums the counts and answers
each block with the totals of its n-grams, in the block's own order. The block
joins them to the n-grams of its documents and sums the scores per document.

A document does not vouch for itself: its own counts are taken off the totals
before it is scored (leave one out), so that backing off is the rule for text
that nobody else wrote.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.common import concat_texts, mix, pack, pack_sorted, split_words, text_slices, unpack, unpack_sorted, word_hashes
from affinity.session import stage

ORDER = 3
#: Factor per step back (fixed value of the method).
BACKOFF = 0.4
#: Text bytes of a block, and n-gram entries that one partition of the count table holds.
BLOCK_BYTES = 8 << 20
PART_ENTRIES = 2_000_000
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def ngrams(texts: pa.Array, order: int = ORDER) -> tuple[np.ndarray, list[np.ndarray]]:
    """Document of each word, and per n the hash of the n words that end there (0 where the text has not as many)."""
    data, offsets = concat_texts(texts)
    starts, ends, doc = split_words(data, offsets, IS_WORD)
    words = word_hashes(data, starts, ends) | np.uint64(1)
    grams = [words]
    for n in range(2, order + 1):
        longer = np.zeros(len(words), np.uint64)
        same = doc[n - 1:] == doc[:len(doc) - n + 1]
        longer[n - 1:] = np.where(same, mix(grams[-1][n - 2:len(words) - 1] * np.uint64(3) + words[n - 1:] + np.uint64(n)) | np.uint64(1), 0)
        grams.append(longer)
    return doc, grams


def _blocks(docs: DataFrame, id_type: str) -> DataFrame:
    """One row per block: number, words, and its documents' ids and texts (compressed)."""
    def cut(batches):
        number = TaskContext.get().partitionId() << 32
        for part in text_slices(batches, "_text", BLOCK_BYTES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as writer:
                writer.write_batch(part)
            body = zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())
            data, offsets = concat_texts(part.column(1))
            words = len(split_words(data, offsets, IS_WORD)[0])
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([words], pa.int64()), pa.array([body], pa.large_binary())],
                                             names=["block", "words", "body"])
            number += 1
    return docs.mapInArrow(cut, "block long, words long, body binary")


def _texts(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 31)).read_all().combine_chunks()


def _distinct(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate(grams)
    return np.unique(every[every != 0], return_counts=True)


def _cells(blocks: DataFrame, bits: int, order: int) -> DataFrame:
    """Per block and partition (the leading ``bits`` of the hash): sorted hashes and their counts in the block."""
    def send(batches):
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes, counts = _distinct(ngrams(_texts(body).column("_text"), order)[1])
                cut = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
                low = np.uint64((1 << (64 - bits)) - 1)  # the partition number implies the leading bits
                ends = [(p, a, z) for p, (a, z) in enumerate(zip(cut, cut[1:])) if z > a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _, _ in ends], pa.int32()), pa.array([block] * len(ends), pa.int64()),
                     pa.array([pack_sorted(hashes[a:z] & low) for _, a, z in ends], pa.binary()),
                     pa.array([pack(counts[a:z].astype(np.uint32)) for _, a, z in ends], pa.binary())],
                    names=["part", "block", "hashes", "counts"])
    return blocks.select("block", "body").mapInArrow(send, "part int, block long, hashes binary, counts binary")


def _totals(cells: DataFrame) -> DataFrame:
    """Answers: per block and partition the corpus totals of the block's n-grams, in their order."""
    def add(key, table):
        hashes = [unpack_sorted(h) for h in table.column("hashes").to_pylist()]
        counts = [unpack(c, np.uint32) for c in table.column("counts").to_pylist()]
        size = np.cumsum([0] + [len(h) for h in hashes])
        _, place = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts).astype(np.float64)).astype(np.int64)[place]
        return pa.table({"block": table.column("block"), "part": table.column("part"),
                         "totals": pa.array([pack(total[a:z]) for a, z in zip(size, size[1:])], pa.binary())})
    return cells.groupBy("part").applyInArrow(add, "block long, part int, totals binary")


def backoff_scores(doc, grams, hashes, totals, n_docs: int, corpus_words: int, backoff: float = BACKOFF) -> tuple[np.ndarray, np.ndarray]:
    """(words, sum of log scores) per document; ``totals`` are the corpus counts of the sorted ``hashes``."""
    words = np.bincount(doc, minlength=n_docs)
    rest = np.maximum(corpus_words - words[doc], 1).astype(np.float64)
    left = []
    for g in grams:
        have = np.flatnonzero(g)
        place = np.searchsorted(hashes, g[have])
        pair = doc[have].astype(np.int64) * len(hashes) + place
        _, inverse, own = np.unique(pair, return_inverse=True, return_counts=True)
        others = np.zeros(len(g))
        others[have] = totals[place] - own[inverse]
        left.append(others)
    score = 1.0 / rest  # a word that no other document holds: one more step back, to the uniform share
    score *= backoff
    found = np.zeros(len(doc), bool)
    value = np.log(score * backoff ** (len(grams) - 1)) if len(doc) else score
    for n in range(len(grams) - 1, -1, -1):
        if n == 0:
            below = rest
        else:
            below = np.zeros(len(doc))
            below[1:] = left[n - 1][:-1]
        here = ~found & (left[n] > 0) & (below > 0)
        value[here] = np.log(left[n][here] / below[here] * backoff ** (len(grams) - 1 - n))
        found |= here
    return words, np.bincount(doc, value, n_docs)


def score_documents(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, log_score (sum over its words), mean_log_score.

    S(w | h) = c(hw) / c(h) if another document holds hw, else 0.4 S(w | shorter
    h); counts are those of all other documents, a word unknown to them counts
    0.4 / N. Null and empty texts have no words, log_score 0 and a null mean.
    Repeated rows are documents of their own (and vouch for each other). An
    empty table gives an empty result.
    """
    id_type = dict(docs.dtypes)[id_col]
    read = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    blocks = stage(_blocks(read, id_type), "lm_blocks")
    corpus = blocks.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    bits = max(8, int(np.ceil(np.log2(max(1, order * corpus / PART_ENTRIES)))))
    # written, so that the cells' shuffle files are gone when the answers meet the texts
    totals = stage(_totals(_cells(blocks, bits, order)), "lm_totals")
    answers = (totals.groupBy("block")
               .agg(F.array_sort(F.collect_list(F.struct("part", "totals"))).alias("answers")))
    joined = blocks.join(answers, "block", "left").select("body", "answers")

    def score(batches):
        for batch in batches:
            for row in batch.to_pylist():
                table = _texts(row["body"])
                doc, grams = ngrams(table.column("_text"), order)
                hashes, _ = _distinct(grams)
                totals = np.concatenate([np.zeros(0, np.int64)] + [unpack(a["totals"], np.int64) for a in row["answers"] or []])
                n, total = backoff_scores(doc, grams, hashes, totals, table.num_rows, corpus)
                mean = np.divide(total, n, out=np.full(len(n), np.nan), where=n > 0)
                yield pa.RecordBatch.from_arrays(
                    [table.column("_id").combine_chunks(), pa.array(n, pa.int64()), pa.array(total, pa.float64()),
                     pa.array(mean, pa.float64(), mask=n == 0)], names=[id_col, "n_words", "log_score", "mean_log_score"])

    return joined.mapInArrow(score, f"`{id_col}` {id_type}, n_words long, log_score double, mean_log_score double")
