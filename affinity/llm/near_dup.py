"""Near-duplicate classes: consistent weighted sampling over TF-IDF shingles.

1. The document frequency of every word shingle is counted over all documents.
   Blocks of documents send their distinct shingles (48-bit hashes) with counts
   to the partition of the hash, which sums them and answers each block with the
   totals of its shingles; they give the idf weights. A shingle of all documents
   is one entry per block.
2. Equal texts collapse to one text. Each text draws ``bands * rows`` samples
   (improved consistent weighted sampling): two texts draw the same sample with
   a probability that is their weighted Jaccard similarity. The samples of a
   band make one bucket key.
3. The similarity cannot exceed the ratio of two texts' total weights, so a bucket
   is split by total weight into overlapping steps that hold every pair within
   the threshold. First each bucket's first member is compared with its others (a
   star: as many pairs as members); a pair counts when the weighted Jaccard
   similarity of the whole texts reaches the threshold. Buckets whose members are
   then of one class are done. In the others all members are compared: as pairs
   across classes in buckets of a few members, else in cells of two blocks of
   bounded size, which report one link per member and no pairs.
4. Classes are connected components of the verified pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.common import (
    GOLDEN, MIX_A, MIX_B, carried, concat_texts, mix, pack, pack_sorted, release_memory, seeded, split_words, text_slices, unpack, unpack_sorted, word_hashes)
from affinity.llm.components import components
from affinity.session import stage

#: Words of a shingle.
SHINGLE = 5
_HASH_MASK = np.uint64((1 << 48) - 1)
#: Bits of the hash in the bucketed idf tables that ``tf_idf`` takes beside exact ones.
DF_BITS = 18
_DF_MASK = np.uint64((1 << DF_BITS) - 1)
#: Text bytes of a block, and shingles that one partition of the frequency table holds.
BLOCK_BYTES = 4 << 20
PART_ENTRIES = 2_000_000
BANDS, ROWS = 10, 3
#: Buckets of up to this many members are compared as pairs, larger ones in cells of blocks of
#: CELL_ROWS members and about CELL_WEIGHT total weight (some 100,000 shingles).
SMALL, CELL_ROWS, CELL_WEIGHT = 12, 256, 200_000
#: Room for rounding where weights are compared before the exact test.
_SLACK = 1e-6
#: Word separators (ASCII white space).
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index, shingle hash, times) of the distinct shingles, in order of document and hash.

    Words are separated by ASCII white space. A text of one to four words is one
    shingle of all its words; a text without words has none.
    """
    data, offsets = concat_texts(texts)
    starts, ends, doc = split_words(data, offsets, IS_WORD)
    words = word_hashes(data, starts, ends)
    n = len(words)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    size = np.diff(first)
    length = np.minimum(size, SHINGLE)
    begins = np.ones(n, bool)
    last = first[1:][size > 0]
    for back in range(1, SHINGLE):  # no shingle begins in the last words of a text, but for its first word
        at = last - back
        begins[at[at >= first[:-1][size > 0]]] = False
    begins[first[:-1][size > 0]] = True
    at = np.flatnonzero(begins)
    hashes = np.zeros(len(at), np.uint64)
    for j in range(SHINGLE):
        inside = j < length[doc[at]]
        step = words[np.minimum(at + j, max(n - 1, 0))]
        hashes = np.where(inside, mix(hashes * np.uint64(5) + step), hashes)
    # one flat sort by (document, hash); 48 bits of the hash are kept
    flat = doc[at].astype(np.uint64) << np.uint64(48) | hashes & _HASH_MASK
    flat.sort()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    pick = np.flatnonzero(new)
    return (flat[pick] >> np.uint64(48)).astype(np.int64), flat[pick] & _HASH_MASK, np.diff(np.append(pick, len(flat)))


def _blocks(read: DataFrame) -> DataFrame:
    """One row per block of read (_id, _name, _text): number, documents, text bytes, and the rows (compressed)."""
    def cut(batches):
        number = TaskContext.get().partitionId() << 32
        for part in text_slices(batches, "_text", BLOCK_BYTES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as writer:
                writer.write_batch(part)
            body = zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())
            size = len(concat_texts(part.column(2))[0])
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([part.num_rows], pa.int64()), pa.array([size], pa.int64()),
                                              pa.array([body], pa.large_binary())], names=["block", "docs", "bytes", "body"])
            number += 1
    return read.mapInArrow(cut, "block long, docs long, bytes long, body binary")


def _slices(body: bytes):
    """The rows of a block in slices that stay in the processor's cache, each with its shingles."""
    rows = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 31))
    for part in text_slices(rows, "_text", 1 << 18):
        yield part, *shingles(part.column(2))


def _distinct(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of a block and how many of its documents hold each."""
    found = [np.zeros(0, np.uint64)] + [hashes for _, _, hashes, _ in _slices(body)]
    return np.unique(np.concatenate(found), return_counts=True)


def _frequencies(blocks: DataFrame, bits: int) -> DataFrame:
    """(block, answers): the document frequencies of each block's distinct shingles in their order, in parts by hash range."""
    def send(batches):
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes, counts = _distinct(body)
                cut = np.searchsorted(hashes >> np.uint64(48 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
                ends = [(p, a, z) for p, (a, z) in enumerate(zip(cut, cut[1:])) if z > a]
                low = np.uint64((1 << (48 - bits)) - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _, _ in ends], pa.int32()), pa.array([block] * len(ends), pa.int64()),
                     pa.array([pack_sorted(hashes[a:z] & low) for _, a, z in ends], pa.binary()),
                     pa.array([pack(counts[a:z].astype(np.uint32)) for _, a, z in ends], pa.binary())],
                    names=["part", "block", "hashes", "counts"])

    def add(key, table):
        hashes = [unpack_sorted(h) for h in table.column("hashes").to_pylist()]
        counts = [unpack(c, np.uint32) for c in table.column("counts").to_pylist()]
        size = np.cumsum([0] + [len(h) for h in hashes])
        _, place = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts).astype(np.float64)).astype(np.int64)[place]
        return pa.table({"block": table.column("block"), "part": table.column("part"),
                         "totals": pa.array([pack(total[a:z]) for a, z in zip(size, size[1:])], pa.binary())})

    cells = blocks.select("block", "body").mapInArrow(send, "part int, block long, hashes binary, counts binary")
    return (cells.groupBy("part").applyInArrow(add, "block long, part int, totals binary")
            .groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "totals"))).alias("answers")))


def idf(frequencies: np.ndarray, n_docs: int) -> np.ndarray:
    """Normalised inverse document frequency: 1 for a shingle of all documents, 2 for one of a single document.

    The range is bounded so that the few rare shingles of an edit do not outweigh
    the text around it, however large the group of copies and the corpus are.
    """
    return 1.0 + np.log((1.0 + n_docs) / (1.0 + np.minimum(frequencies, n_docs))) / np.log(1.0 + max(n_docs, 1))


def tf_idf(hashes: np.ndarray, times: np.ndarray, table) -> np.ndarray:
    """Weights (1 + ln tf) x idf: a line that is repeated a hundred times does not make a document.

    ``table`` has the idf of each shingle: (sorted hashes, their idf), or an array over the last DF_BITS of the hash.
    """
    if isinstance(table, tuple):
        return (1.0 + np.log(times)) * table[1][np.searchsorted(table[0], hashes)]
    return (1.0 + np.log(times)) * table[(hashes & _DF_MASK).astype(np.int64)]


def _own_frequencies(lists: pa.Array) -> np.ndarray:
    """The document frequencies of the shingles of texts behind one another, from their packed lists."""
    return np.concatenate([np.zeros(0, np.int64)] + [unpack(d, np.int64) for d in lists.to_pylist()])


def _uniform(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in (0, 1) from the halves of 64-bit hashes."""
    scale = np.float32(2.0 ** -24)
    high = (h >> np.uint64(40)).astype(np.float32)
    low = ((h >> np.uint64(8)) & np.uint64(0xFFFFFF)).astype(np.float32)
    return (high + np.float32(0.5)) * scale, (low + np.float32(0.5)) * scale


def weighted_samples(doc: np.ndarray, hashes: np.ndarray, weight: np.ndarray, n_docs: int, n_samples: int) -> np.ndarray:
    """Improved consistent weighted samples, shape (n_samples, n_docs); documents without shingles get 0.

    Per element and sample: r, c ~ Gamma(2, 1), b ~ U(0, 1) from hashes of the
    element; t = floor(ln w / r + b); the element with the least
    ln c - r (t - b + 1) is drawn, together with its t.
    """
    out = np.zeros((n_samples, n_docs), np.uint64)
    if not len(doc):
        return out
    seeds = seeded(np.arange(n_samples, dtype=np.uint64), 41)
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    owners = doc[first]
    log_w = np.log(weight).astype(np.float32)
    for s in range(n_samples):
        one = (hashes ^ seeds[s]) * MIX_A  # the shingle hashes are mixed already; this makes them independent per sample
        one ^= one >> np.uint64(29)
        one *= MIX_B
        one ^= one >> np.uint64(32)
        two = one * np.uint64(GOLDEN)
        two ^= two >> np.uint64(31)
        (u1, u2), (u3, u4) = _uniform(one), _uniform(two)
        r = -np.log(u1 * u2)
        b = (one & np.uint64(0xFF) | (two & np.uint64(0xFF)) << np.uint64(8)).astype(np.float32) * np.float32(2.0 ** -16)
        t = np.floor(log_w / r + b)
        a = np.log(-np.log(u3 * u4)) - r * (t - b + np.float32(1))
        bits = a.view(np.uint32)  # floats in the order of unsigned integers
        ordered = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(0x80000000)).astype(np.uint64)
        tie = (one >> np.uint64(32)) ^ two & np.uint64(0xFFFFFFFF)
        drawn = ordered << np.uint64(32) | (tie + t.astype(np.int64).astype(np.uint64) * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)
        out[s, owners] = np.minimum.reduceat(drawn, first) & np.uint64(0xFFFFFFFF)
    return out


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 63-bit key per document and band, shape (bands, documents)."""
    keys = np.zeros((bands, samples.shape[1]), np.uint64)
    for b in range(bands):
        for s in range(rows):
            keys[b] = mix(keys[b] * np.uint64(3) + samples[b * rows + s] + np.uint64(b + 1))
    return (keys >> np.uint64(1)).astype(np.int64)


def weighted_jaccard(left: tuple, right: tuple, n: int) -> np.ndarray:
    """Sum of the lesser over sum of the greater weights for n pairs of weighted sets (pair index, hash, weight)."""
    pair = np.concatenate([left[0], right[0]])
    order = np.lexsort((np.concatenate([left[1], right[1]]), pair))
    pair, value = pair[order], np.concatenate([left[2], right[2]])[order]
    hashes = np.concatenate([left[1], right[1]])[order]
    both = np.flatnonzero((pair[1:] == pair[:-1]) & (hashes[1:] == hashes[:-1]))
    shared = np.bincount(pair[both], np.minimum(value[both], value[both + 1]), n)
    total = np.bincount(pair, value, n) - shared
    return np.divide(shared, total, out=np.zeros(n), where=total > 0)


def _verified(pairs: DataFrame, threshold: float, n_docs: int) -> DataFrame:
    """The pairs (a, b, _ta, _tb: their texts, _fa, _fb: their frequencies) whose weighted Jaccard similarity reaches the threshold."""
    def verify(batches):
        for batch in batches:
            # both texts count against the slice
            for part in text_slices([batch], "_ta", 1 << 18):
                for few in text_slices([part], "_tb", 1 << 18):
                    sets = []
                    for c in (2, 3):
                        doc, hashes, times = shingles(few.column(c))
                        sets.append((doc, hashes, (1.0 + np.log(times)) * idf(_own_frequencies(few.column(c + 2)), n_docs)))
                    close = weighted_jaccard(*sets, few.num_rows) >= threshold
                    yield few.select(["a", "b"]).filter(pa.array(close))
        release_memory()

    return pairs.select("a", "b", "_ta", "_tb", "_fa", "_fb").mapInArrow(verify, "a binary, b binary")


def sketches(blocks: DataFrame, id_type: str, n_docs: int, bands: int, rows: int) -> DataFrame:
    """(_id, _name, _weight, _keys, _freq) per document of blocks (body, answers): digest, total weight, band keys (null
    without words) and the packed document frequencies of its shingles in order of their hash."""
    def sketch(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a row at a time: a batch can hold many blocks
                row = {"body": batch.column(0)[i].as_py(), "answers": batch.column(1)[i].as_py()}
                every, _ = _distinct(row["body"])
                totals = np.concatenate([np.zeros(0, np.int64)] + [unpack(a["totals"], np.int64) for a in row["answers"] or []])
                for part, doc, hashes, times in _slices(row["body"]):
                    freq = totals[np.searchsorted(every, hashes)]
                    weight = (1.0 + np.log(times)) * idf(freq, n_docs)
                    keys = band_keys(weighted_samples(doc, hashes, weight, part.num_rows, bands * rows), bands, rows)
                    known = np.zeros(part.num_rows, bool)
                    known[doc] = True
                    lists = pa.array([k if w else None for k, w in zip(list(keys.T), known)], pa.list_(pa.int64()))
                    total = np.bincount(doc, weight, part.num_rows).astype(float)
                    cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
                    packed = pa.array([pack(freq[a:z]) for a, z in zip(cut, cut[1:])], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(total), lists, packed],
                                                     names=["_id", "_name", "_weight", "_keys", "_freq"])
        release_memory()

    return blocks.select("body", "answers").mapInArrow(sketch, f"_id {id_type}, _name binary, _weight double, _keys array<long>, _freq binary")


def _buckets(sketched: DataFrame, threshold: float) -> DataFrame:
    """(key, name, w): a row per text, band and weight step. Texts within the threshold are at most one step apart,
    and each text is in its own step and the next, so any such pair of a band meets."""
    step = F.floor(F.log(F.col("_weight")) / F.lit(-math.log(threshold - _SLACK)))
    return (sketched.filter("_keys IS NOT NULL").select("_name", "_weight", F.explode("_keys").alias("_key"))
            .select("_name", "_weight", "_key", F.explode(F.array(step, step + 1)).alias("_step"))
            .select(F.xxhash64("_key", "_step").alias("key"), F.col("_name").alias("name"), F.col("_weight").alias("w")).distinct())


def _able(threshold: float):
    """Whether two weights (m.w, c.w) leave the threshold within reach."""
    return F.least("m.w", "c.w") >= F.greatest("m.w", "c.w") * (threshold - _SLACK)


def _star_pairs(buckets: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a < b) of each bucket's first member with its others."""
    centre = buckets.groupBy("key").agg(F.min(F.struct("name", "w")).alias("c")).select("key", "c.name", "c.w")
    return (buckets.alias("m").join(centre.alias("c"), F.col("m.key") == F.col("c.key"))
            .filter((F.col("m.name") != F.col("c.name")) & _able(threshold))
            .select(F.col("c.name").alias("a"), F.col("m.name").alias("b")).distinct())


def _small_pairs(buckets: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a < b) across classes in buckets of at most SMALL members."""
    return (buckets.alias("m").join(buckets.alias("c"), F.col("m.key") == F.col("c.key"))
            .filter((F.col("m.name") < F.col("c.name")) & (F.col("m.cls") != F.col("c.cls")) & _able(threshold))
            .select(F.col("m.name").alias("a"), F.col("c.name").alias("b")).distinct())


def _cells(buckets: DataFrame) -> DataFrame:
    """Large buckets cut into blocks; a row per member and cell, a cell being a pair of blocks (lo <= hi).

    ``buckets`` has n and w_most of the bucket. A block holds at most CELL_ROWS
    members and about CELL_WEIGHT of text, so a cell is bounded whatever the bucket.
    """
    rows = F.greatest(F.lit(1.0), F.least(F.lit(float(CELL_ROWS)), F.floor(F.lit(float(CELL_WEIGHT)) / F.col("w_most"))))
    blocks = F.ceil(F.col("n") / rows)
    own = F.col("own")
    return (buckets.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("name"), F.col("blocks")))
            .select("key", "name", "cls", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
            .select("key", "name", "cls", "own", F.least(own, "other").alias("lo"), F.greatest(own, "other").alias("hi")))


def close_pairs(texts: pa.Array, table, threshold: float, chunk: int = 1 << 14) -> np.ndarray:
    """Which pairs of two texts have a weighted Jaccard similarity of the threshold or more (symmetric matrix, its
    diagonal without meaning: what only one text holds is left out)."""
    doc, hashes, times = shingles(texts)
    # an element that occurs t times is t elements, whose weights add up to its weight: then lesser means common
    level = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + 1
    owner, name = np.repeat(doc, times), np.repeat(hashes, times)
    weight = tf_idf(name, level, table) - np.where(level > 1, tf_idf(name, np.maximum(level - 1, 1), table), 0.0)
    n = len(texts)
    total = np.bincount(owner, weight, n).astype(float)
    _, code, count = np.unique(mix(name + level.astype(np.uint64) * np.uint64(GOLDEN)), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    owner, weight, code = owner[shared], weight[shared], code[shared]
    code = np.unique(code, return_inverse=True)[1]
    common = np.zeros((n, n))
    order = np.argsort(code, kind="stable")
    owner, weight, code = owner[order], np.sqrt(weight[order]), code[order]
    for first in range(0, int(code.max(initial=-1)) + 1, chunk):
        a, z = np.searchsorted(code, [first, first + chunk])
        part = np.zeros((n, min(chunk, int(code[-1]) + 1 - first)))
        part[owner[a:z], code[a:z] - first] = weight[a:z]
        common += part @ part.T
    whole = total[:, None] + total[None, :] - common
    return (common >= threshold * whole * (1 - 1e-12)) & (total > 0)[:, None] & (total > 0)[None, :]


def _cell_links(cells: DataFrame, threshold: float, n_docs: int) -> DataFrame:
    """Links (a, b) that join each cell's members to the first member of their class there: at most one per member."""
    def compare(key, table):
        lo, hi = key[1].as_py(), key[2].as_py()
        own = table.column("own").to_numpy()
        name = table.column("name").to_pylist()
        _, label = np.unique(np.array(table.column("cls").to_pylist(), object), return_inverse=True)
        texts = table.column("text").combine_chunks()
        every, at = np.unique(shingles(texts)[1], return_index=True)
        close = close_pairs(texts, (every, idf(_own_frequencies(table.column("freq"))[at], n_docs)), threshold)
        if lo != hi:
            close &= own[:, None] != own[None, :]
        close |= label[:, None] == label[None, :]
        lead = np.arange(len(name))
        while True:  # least label of all that are close, until nothing changes
            new = np.where(close, lead[None, :], len(name)).min(axis=1)
            new = new[new]
            if np.array_equal(new, lead):
                break
            lead = new
        joined = np.flatnonzero((lead != np.arange(len(name))) & (label != label[lead]))
        return pa.table({"a": pa.array([name[lead[i]] for i in joined], pa.binary()), "b": pa.array([name[i] for i in joined], pa.binary())})

    return cells.select("key", "lo", "hi", "own", "name", "cls", "text", "freq").groupBy("key", "lo", "hi").applyInArrow(compare, "a binary, b binary")


def _open(buckets: DataFrame) -> DataFrame:
    """The rows of buckets whose members are of more than one class."""
    mixed = buckets.groupBy("key").agg(F.min("cls").alias("_low"), F.max("cls").alias("_high")).filter("_low <> _high")
    return buckets.join(mixed.select("key"), "key", "left_semi")


def _classified(docs: DataFrame, threshold: float, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(_id, _name, _class) per document: id, text digest and the class of the text."""
    read = (docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
            .select("_id", F.unhex(F.md5("_text")).alias("_name"), "_text"))
    blocks = stage(_blocks(read), "shingle_blocks")
    n_docs, size = blocks.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    bits = max(8, math.ceil(math.log2(max(1, size / 6 / PART_ENTRIES))))
    joined = blocks.join(_frequencies(blocks, bits), "block", "left")
    sketched = stage(sketches(joined, dict(read.dtypes)["_id"], n_docs, bands, rows), "sketches")

    state = _buckets(sketched, threshold)
    state = stage(_open(state.withColumn("cls", F.col("name"))), "buckets")
    # one document per text that shares a bucket with another text; ids and digests together are never a hot key
    lead = (sketched.select("_name", "_id", "_freq").join(state.select(F.col("name").alias("_name")).distinct(), "_name", "left_semi")
            .groupBy("_name").agg(F.min("_id").alias("_id"), F.first("_freq").alias("_freq")))
    texts = (read.alias("d").join(lead.alias("l"), F.col("d._id").eqNullSafe(F.col("l._id")) & (F.col("d._name") == F.col("l._name")))
             .select(F.col("d._name").alias("name"), F.col("d._text").alias("text"), F.col("l._freq").alias("freq")))
    texts = stage(texts.dropDuplicates(["name"]), "texts")
    with_texts = lambda pairs: (
        pairs.join(texts.select(F.col("name").alias("a"), F.col("text").alias("_ta"), F.col("freq").alias("_fa")), "a")
        .join(texts.select(F.col("name").alias("b"), F.col("text").alias("_tb"), F.col("freq").alias("_fb")), "b"))
    # first round: stars
    tested = stage(_star_pairs(state, threshold), "pairs")
    links = stage(_verified(with_texts(tested), threshold, n_docs), "links")
    classes = stage(components(links, "a", "b"), "classes")
    # second round: what is still of different classes in a bucket
    state = (state.drop("cls").join(classes.withColumnRenamed("node", "name"), "name", "left")
             .select("key", "name", "w", F.coalesce("component", "name").alias("cls")))
    state = _open(state)
    sizes = state.groupBy("key").agg(F.count("*").alias("n"), F.max("w").alias("w_most"))
    state = stage(state.join(sizes, "key"), "open_buckets")
    pairs = _small_pairs(state.filter(F.col("n") <= SMALL), threshold).join(tested, ["a", "b"], "left_anti")
    more = _verified(with_texts(pairs), threshold, n_docs)
    cells = _cells(state.filter(F.col("n") > SMALL)).join(texts, "name")
    links = stage(links.unionByName(more).unionByName(_cell_links(cells, threshold, n_docs)), "links")
    classes = stage(components(links, "a", "b"), "classes")
    named = sketched.select("_id", "_name")
    return (named.join(classes.withColumnRenamed("node", "_name"), "_name", "left")
            .select("_id", "_name", F.coalesce("component", "_name").alias("_class")))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and ``class_id``, the smallest id of its class.

    Null texts count as empty; texts without words are alike only if they are
    equal. Repeated rows give one row each; null ids are kept, and a class with
    null ids only has a null class id. An empty table gives an empty result.
    """
    named = _classified(docs, threshold, bands, rows, id_col, text_col).select("_id", "_class")
    least = named.groupBy("_class").agg(F.min("_id").alias("class_id"))
    return named.join(least, "_class").select(F.col("_id").alias(id_col), "class_id")


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that lead their class, one row each, columns as given.

    A lead has the smallest id of its class (null only where all are), then the
    least text digest; it is found by id and digest, so null ids and ids on
    several texts lose nothing of other classes.
    """
    place = F.struct(F.col("_id").isNull().alias("none"), "_id", "_name")
    leads = (_classified(docs, threshold, BANDS, ROWS, id_col, text_col).groupBy("_class").agg(F.min(place).alias("_lead"))
             .select(F.col("_lead._id").alias("_lead_id"), F.col("_lead._name").alias("_lead_name")))
    name = F.unhex(F.md5(F.coalesce(docs[f"`{text_col}`"], F.lit(""))))
    own = docs.select(carried(docs), docs[f"`{id_col}`"].alias("_own_id"), name.alias("_own_name"))
    kept = own.join(leads, F.col("_own_id").eqNullSafe(F.col("_lead_id")) & (F.col("_own_name") == F.col("_lead_name")), "left_semi")
    return kept.dropDuplicates(["_own_id", "_own_name"]).select("_row.*")
