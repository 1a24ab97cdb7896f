"""Substring dedup by recompression.

Rounds name first the runs of equal words and then, again and again, pairs of
neighbours: a symbol is on the left or the right side by a hash of its name and
the round, and a left symbol followed by a right one becomes one new symbol. A
name is a hash of what it stands for, so all tasks of all documents agree on all
names without an exchange, and equal substrings have equal symbols inside.

A window of words is represented by a symbol that any equal window must hold at
the same place: symbols that could join something outside the window are popped
from its ends in each round, and what remains at the highest round is the same
in every occurrence. The symbol, extended by half of the rest of the window to
the side where the window reaches further, is the window's key (a dozen words,
so chance repeats do not occur). Consecutive windows share a key, and only keys
that occur more than once are followed up:

* occurrences with the same surroundings collapse to the earliest one;
* where the surroundings differ, the windows of the earliest ones are compared
  one by one by hashes of all their words.

A removal is decided on 128 bits, from two independent hashes of each word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.common import concat_texts, mix, seeded, span_hashes, split_words, text_slices, word_hashes
from affinity.session import stage

WINDOW = 20
#: Pair rounds. More rounds give wider symbols, but fewer of them in a window to choose a lasting one from.
ROUNDS = 3
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def _least_symbol(sym, b, e):
    """Index of the symbol of the least hashed name in each [b, e); ties: leftmost.

    The least of many candidates changes seldom from one window to the next.
    """
    rank = seeded(sym, 99)
    best = b.copy()
    for k in range(1, int((e - b).max(initial=0))):
        at = np.flatnonzero(b + k < e)
        better = at[rank[b[at] + k] < rank[best[at]]]
        best[better] = b[better] + k
    return best


def anchors(words: np.ndarray, doc: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS):
    """(s, lo, hi): every window start and the word span of its representative symbol.

    ``words`` are the word hashes of documents behind one another, ``doc`` their document.
    """
    n = len(words)
    s = np.flatnonzero(doc[:n - window + 1] == doc[window - 1:]) if n >= window else np.zeros(0, np.int64)
    out_lo, out_hi = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
    live = np.arange(len(s))
    b, e = s.copy(), s + window
    sym, lo, hi, own = words, np.arange(n), np.arange(1, n + 1), doc

    def settle(who, at, to):
        tile = _least_symbol(sym, at, to)
        out_lo[who], out_hi[who] = lo[tile], hi[tile]

    for step in range(rounds + 1):
        if not len(live):
            break
        starts = np.ones(len(sym), bool)
        if step == 0:  # runs of equal words
            starts[1:] = (sym[1:] != sym[:-1]) | (own[1:] != own[:-1])
            place = np.cumsum(starts) - 1
            nb, ne = place[b] + 1, place[e - 1]  # the outer runs may go on outside
            first = np.flatnonzero(starts)
            count = np.diff(np.append(first, len(sym))).astype(np.uint64)
            names = np.where(count > 1, mix(sym[first] * np.uint64(3) + count), sym[first])
        else:
            left = (seeded(sym, step) >> np.uint64(63)).astype(bool)
            starts[1:] = ~(left[:-1] & ~left[1:] & (own[1:] == own[:-1]))
            place = np.cumsum(starts) - 1
            pb, pe = b + ~left[b], e - left[e - 1]  # a right symbol first or a left one last may join what is outside
            empty = pb >= pe
            nb = place[np.minimum(pb, len(sym) - 1)]
            ne = np.where(empty, nb, place[pe - 1] + 1)
            first = np.flatnonzero(starts)
            pair = np.diff(np.append(first, len(sym))) > 1
            names = sym[first].copy()
            names[pair] = mix(names[pair] * np.uint64(5) + mix(sym[first[pair] + 1]) + np.uint64(step))
        gone = nb >= ne
        settle(live[gone], b[gone], e[gone])
        live, b, e = live[~gone], nb[~gone], ne[~gone]
        last = np.append(first[1:], len(sym)) - 1
        sym, lo, hi, own = names, lo[first], hi[last], own[first]
    settle(live, b, e)
    return s, out_lo, out_hi


def occurrences(texts: pa.Array, window: int = WINDOW, context: bool = True):
    """Runs of windows that share a key: (document, key, context hash, first word in the document, number of windows)."""
    data, offsets = concat_texts(texts)
    starts, ends, doc = split_words(data, offsets, IS_WORD)
    words = word_hashes(data, starts, ends)
    others = word_hashes(data, starts, ends, 1) if context else words
    del data, starts, ends
    s, lo, hi = anchors(words, doc, window)
    if not len(s):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    half = (window - (hi - lo) + 1) // 2
    before = lo - s >= half
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1] + 1) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]) | (before[1:] != before[:-1]) | (doc[s[1:]] != doc[s[:-1]])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(s)))
    a, z = lo[at] - np.where(before[at], half[at], 0), hi[at] + np.where(before[at], 0, half[at])
    key = mix(span_hashes(words, a, z) + (lo[at] - a).astype(np.uint64) * np.uint64(257) + (hi - lo)[at].astype(np.uint64))
    about = span_hashes(others, s[at], s[at] + count - 1 + window) if context else key
    owner = doc[s[at]]
    first_word = np.searchsorted(doc, owner)
    return owner, key.view(np.int64), about.view(np.int64), s[at] - first_word, count


def _keys(docs: DataFrame, window: int) -> DataFrame:
    def scan(batches):
        for part in text_slices(batches, "_text", 1 << 19):
            _, key, _, _, _ = occurrences(part.column(1), window, context=False)
            yield pa.RecordBatch.from_arrays([pa.array(key)], names=["key"])
    return docs.mapInArrow(scan, "key long")


def _occurrences(docs: DataFrame, window: int) -> DataFrame:
    def scan(batches):
        for part in text_slices(batches, "_text", 1 << 19):
            owner, key, about, first, count = occurrences(part.column(1), window)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(about), part.column(0).take(pa.array(owner)),
                 pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))], names=["key", "about", "_id", "at", "n"])
    return docs.mapInArrow(scan, f"key long, about long, _id {dict(docs.dtypes)['_id']}, at int, n int")


def _window_hashes(found: DataFrame, window: int) -> DataFrame:
    """One row per window of the listed runs: found(_id, _text, runs of (key, at, n)) -> (key, whole, _id, at)."""
    def scan(batches):
        for part in text_slices(batches, "_text", 1 << 18):
            data, offsets = concat_texts(part.column(1))
            starts, ends, doc = split_words(data, offsets, IS_WORD)
            words = word_hashes(data, starts, ends, 1)
            runs = part.column(2)
            owner = np.repeat(np.arange(part.num_rows), np.diff(runs.offsets.to_numpy()))
            flat = runs.flatten()
            key, at, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            place = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            begin = np.searchsorted(doc, np.repeat(owner, n)) + place
            whole = span_hashes(words, begin, begin + window)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(key, n)), pa.array(whole.view(np.int64)),
                 part.column(0).take(pa.array(np.repeat(owner, n))), pa.array(place.astype(np.int32))], names=["key", "whole", "_id", "at"])
    return found.mapInArrow(scan, f"key long, whole long, _id {dict(found.dtypes)['_id']}, at int")


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_id, spans): the [from, to) word spans of docs(_id, _text) whose windows start earlier elsewhere too."""
    shared = stage(_keys(docs, window).groupBy("key").count().filter("count > 1").select("key"), "shared_keys")
    runs = stage(_occurrences(docs, window).join(shared, "key", "left_semi"), "runs")
    place = F.struct("_id", "at")
    leads = stage(runs.groupBy("key", "about", "n").agg(F.min(place).alias("lead")), "leads")
    copies = (runs.join(leads, ["key", "about", "n"]).filter(~(F.struct("_id", "at") == F.col("lead")))
              .select("_id", F.col("at").alias("from"), (F.col("at") + F.col("n") + window - 1).alias("to")))
    varied = leads.groupBy("key").count().filter("count > 1").select("key")
    split = (leads.join(varied, "key", "left_semi").select(F.col("lead._id").alias("_id"), F.struct("key", F.col("lead.at").alias("at"), "n").alias("run"))
             .groupBy("_id").agg(F.collect_list("run").alias("runs")))
    texts = docs.alias("d").join(split.alias("s"), F.col("d._id").eqNullSafe(F.col("s._id"))).select("d._id", "d._text", "s.runs")
    windows = stage(_window_hashes(texts, window), "windows")
    first = windows.groupBy("key", "whole").agg(F.min(place).alias("lead"), F.count("*").alias("times")).filter("times > 1")
    single = (windows.join(first, ["key", "whole"]).filter(~(F.struct("_id", "at") == F.col("lead")))
              .select("_id", F.col("at").alias("from"), (F.col("at") + window).alias("to")))
    spans = copies.unionByName(single).groupBy("_id").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    return stage(spans, "removed_spans")


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, ``kept`` (the kept words joined by one space), kept_sha256.

    Words are runs of anything but ASCII white space. A word is removed if a
    window of ``window`` consecutive words that covers it also starts earlier: in
    a document of a smaller id (or of the same id and a smaller text digest), or
    earlier in the same one; windows are judged on the input. Null and empty texts have no words and keep the empty text;
    shorter texts than a window are kept whole. Rows that repeat an id and text
    are one document and give equal rows; a null id counts as the smallest.
    """
    read = docs.select(F.col(id_col).alias("_own"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # null ids, or one id on several texts, are documents of their own: each distinct (id, text) is one key
    read = read.select(F.struct("_own", F.unhex(F.md5("_text")).alias("_name")).alias("_id"), "_text")
    spans = repeated_spans(read, window)
    found = (read.alias("d").join(spans.alias("s"), F.col("d._id").eqNullSafe(F.col("s._id")), "left")
             .select("d._id._own", "d._text", "s.spans"))
    kind = dict(found.dtypes)["_own"]

    def cut(batches):
        for part in text_slices(batches, "_text"):
            rows = []
            texts, spans = part.column(1).to_pylist(), part.column(2)
            bounds, flat = spans.offsets.to_numpy(), spans.values
            start, stop = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            for text, a, z in zip(texts, bounds, bounds[1:]):
                words = text.encode().split()
                total = len(words)
                if z > a:
                    depth = np.zeros(total + 1, np.int64)
                    np.add.at(depth, start[a:z], 1)
                    np.add.at(depth, stop[a:z], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(depth)[:total] == 0)]
                kept = b" ".join(words)
                rows.append((total, total - len(words), kept.decode(), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()),
                 pa.array(columns[3], pa.string())], names=[id_col, "n_words", "n_removed", "kept", "kept_sha256"])

    return found.mapInArrow(cut, f"`{id_col}` {kind}, n_words long, n_removed long, kept string, kept_sha256 string")
