"""Token-id shards: tokenise, encode in document order, write, read back.

Documents are range-partitioned by id; each task tokenises its range in order
and closes a shard whenever it holds ``SHARD_IDS`` ids, always between two
documents. A shard is one binary value (coded ids, see ``id_coder``, behind a
table of its documents) and is written as a row of a Parquet table, so any store
that Spark can write works. Reading decodes shards in parallel.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinity.llm import id_coder
from affinity.llm.common import concat_texts, release_memory, small_batches, text_slices
from affinity.session import checkpoint_dir

#: Ids per shard; a shard is longer only by its last document.
SHARD_IDS = 2_000_000
END_ID = 2
#: Cuts of texts whose ids a task remembers, to be forgotten between two slices.
CACHE_WORDS = 200_000
CACHE_BYTES = 32 << 20
#: Cuts of more bytes are forgotten first.
LONG_CUT = 64
#: Text that is cut and looked up at once: the more, the fewer times a word is looked up.
ENCODED_BYTES = 2 << 20
#: New words that the tokenizers library gets at once: it keeps each token as a text of its own.
ENCODED_PIECES = 1 << 13
#: Rows that a task of the writer gets at once: a batch of whole texts is held by Spark and by Python.
BATCH_ROWS = 256


#: Characters that are letters in every version of Unicode that has them.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ\u0400-\u0481\u048a-\u04ff\u05d0-\u05ea\u0621-\u064a\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
#: Texts that the pre-tokeniser of byte-level vocabularies takes as one piece.
_PIECE = re.compile(rf" ?(?:[{_LETTERS}]+|[0-9]+|[\x00-\x08\x0e-\x1b!-&(-/:-@\[-`{{-\x7f]+)|[ \n]+")
_OTHER, _LETTER, _DIGIT, _MARK, _APOSTROPHE, _SPACE, _BREAK = range(7)


def _byte_kinds() -> bytes:
    kinds = []
    for b in range(256):
        c = chr(b)
        kinds.append(_OTHER if b >= 0x80 else _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _SPACE if c == " " else
                     _BREAK if c == "\n" else _APOSTROPHE if c == "'" else _MARK)
    return bytes(kinds)


def _between_kinds() -> bytes:
    """Whether a piece surely ends between two bytes, by 8 * kind of the first + kind of the second."""
    ends = bytearray(256)
    for a in range(7):
        for b in range(7):
            if b in (_SPACE, _BREAK):
                ends[8 * a + b] = a not in (_SPACE, _BREAK)
            elif a == _BREAK:
                ends[8 * a + b] = True
            elif _OTHER not in (a, b) and a != _SPACE:  # an apostrophe may be one piece with the letters behind it
                alike = {a, b} <= {_MARK, _APOSTROPHE} or a == b
                ends[8 * a + b] = not alike and (a, b) != (_APOSTROPHE, _LETTER)
    return bytes(ends)


_KIND, _ENDS = _byte_kinds(), _between_kinds()


class TextEncoder:
    """Ids of whole texts with a tokenizers file; equal pieces of texts are encoded once.

    The pre-tokeniser of byte-level vocabularies splits a text into pieces: a run of letters, digits or marks with at most
    one space before it, a contraction, white space. Where all white space is spaces and line breaks, a text may be cut
    where two ASCII characters show that a piece ends, and before and in white space; the ids of a text are those of its
    cuts. Other texts, those with a special token, and all texts where the file asks for anything else, are encoded whole.
    A cut that is one piece for sure goes to the vocabulary's model without a search for pieces.
    """

    _OTHER_SPACE = [chr(c) for c in range(0x110000) if (chr(c).isspace() or c == 0x85) and chr(c) not in " \n"]

    def __init__(self, tokenizer: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer)
        about = json.loads(self.tokenizer.to_str())
        model, pieces = about["model"], about["pre_tokenizer"] or {}
        letters = _byte_letters()
        self.cuts = (pieces.get("type") == "ByteLevel" and not pieces.get("add_prefix_space") and pieces.get("use_regex", True)
                     and model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix")
                     and not model.get("end_of_word_suffix") and all(c in model["vocab"] for c in letters)
                     and not any(about.get(k) for k in ("normalizer", "truncation", "padding")))
        self.whole_if = [t["content"] for t in about["added_tokens"]] + self._OTHER_SPACE
        if self.cuts:
            about["pre_tokenizer"], about["added_tokens"] = None, []
            self.model = Tokenizer.from_str(json.dumps(about))
            self.letters = np.array([ord(c) for c in letters], "<u4")
            self.n_bytes = np.zeros(max(model["vocab"].values()) + 1, np.int64)
            for token, i in model["vocab"].items():
                self.n_bytes[i] = len(token)
        self.end_id = end_id
        #: the entry of each known cut, in rising order; its ids are size[entry] from first[entry] on in the pool; entry 0 is the end of a text
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.pool, self.first, self.size = np.array([end_id], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.used = np.zeros(1, np.int32)

    def _forget(self) -> None:
        """Keep short cuts that were met in several slices, those met most."""
        length = np.fromiter(map(len, self.known), np.int64, len(self.known))
        often = np.flatnonzero((length <= LONG_CUT) & (self.used[1:] > 1))
        often = np.sort(often[np.argsort(-self.used[often + 1], kind="stable")][:CACHE_WORDS // 2])
        words = list(self.known)
        self.known = {words[i]: entry for entry, i in enumerate(often.tolist(), 1)}
        self.held = int(length[often].sum())
        kept = np.append(0, often + 1)
        self.pool, self.size, self.used = self._ids_of(kept), self.size[kept], np.zeros(len(kept), np.int32)
        self.first = np.cumsum(self.size) - self.size

    def _ids_of(self, entries: np.ndarray) -> np.ndarray:
        size = self.size.take(entries)
        place = np.repeat((self.first.take(entries) - (np.cumsum(size) - size)).astype(np.int32), size)
        place += np.arange(len(place), dtype=np.int32)
        return self.pool.take(place)

    def _one(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, words: list[bytes]) -> None:
        """Append the ids of new cuts, in the order given."""
        self.known.update(zip(words, range(len(self.size), len(self.size) + len(words))))
        self.held += sum(map(len, words))
        texts = [w.decode() for w in words]
        one = [bool(self.cuts and _PIECE.fullmatch(t)) for t in texts]
        pieces = [w for w, o in zip(words, one) if o]
        sizes, ids = np.zeros(len(words), np.int64), []
        if pieces:
            # the byte 255 is in no text
            for a in range(0, len(pieces), ENCODED_PIECES):
                joined = self.letters.take(np.frombuffer(b"\xff".join(pieces[a:a + ENCODED_PIECES]), np.uint8)).tobytes().decode("utf-32-le")
                got = self.model.encode_batch_fast([joined.split("\xff")], is_pretokenized=True, add_special_tokens=False)
                ids.append(np.array(got[0].ids, np.uint32))
            after = np.searchsorted(np.cumsum(self.n_bytes[np.concatenate(ids)]), np.cumsum([len(p) for p in pieces])) + 1
            sizes[np.flatnonzero(one)] = np.diff(after, prepend=0)
        for i in np.flatnonzero(~np.array(one, bool)).tolist():
            ids.append(self._one(texts[i]))
            sizes[i] = len(ids[-1])
        order = np.argsort(~np.array(one, bool), kind="stable")  # as in ids
        first = np.empty(len(words), np.int64)
        first[order] = np.cumsum(sizes[order]) - sizes[order] + len(self.pool)
        self.pool = np.concatenate([self.pool, *ids])
        self.first = np.concatenate([self.first, first])
        self.size = np.concatenate([self.size, sizes])
        self.used = np.concatenate([self.used, np.zeros(len(words), np.int32)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts behind one another, each with the end id; ids of each text with the end id)."""
        if len(self.known) > CACHE_WORDS or self.held > CACHE_BYTES:
            self._forget()
        data, offsets = concat_texts(texts)
        whole = np.array([not self.cuts or any(c in t for c in self.whole_if) if t else False for t in texts.to_pylist()], bool)
        cut = np.zeros(len(data) + 1, bool)
        if self.cuts and len(data):
            kind = np.frombuffer(data.tobytes().translate(_KIND), np.uint8)
            cut[1:-1] = np.frombuffer(((kind[:-1] << 3) | kind[1:]).tobytes().translate(_ENDS), bool)
            space = kind >= _SPACE
            inner = offsets[1:-1]
            last = space[1:-1] & space[:-2] & ~space[2:]  # the last of several, with a piece behind it in the same text
            ends = inner[(inner >= 2) & (inner < len(data))] - 2
            last[ends[ends < len(last)]] = False
            cut[1:-2] |= last
        for i in np.flatnonzero(whole).tolist():
            cut[offsets[i] + 1:offsets[i + 1]] = False
        cut[offsets] = True
        cut[-1] = False
        starts = np.flatnonzero(cut)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)),
                                                                 pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        entries = np.fromiter(map(self.known.get, words, repeat(0)), np.int64, len(words))
        new = np.flatnonzero(entries == 0)
        if len(new):
            entries[new] = np.arange(len(self.size), len(self.size) + len(new))
            self._learn([words[i] for i in new.tolist()])
        self.used[entries] += 1
        # cuts of all texts, with the end behind those of each
        ahead = np.searchsorted(starts, offsets)
        every = np.insert(entries.take(coded.indices.to_numpy()), ahead[1:], 0)
        ends = np.cumsum(self.size.take(every))
        return self._ids_of(every), np.diff(ends[ahead[1:] + np.arange(len(offsets) - 1)], prepend=0)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without the end id."""
        ids, sizes = self.encode(pa.array(texts, pa.string()))
        ends = np.cumsum(sizes)
        return [ids[e - n:e - 1] for e, n in zip(ends.tolist(), sizes.tolist())]


def _byte_letters() -> list[str]:
    """The character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _document_table(ids: pa.Array, sizes: list[int]) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([ids, pa.array(sizes, pa.int64())], names=["id", "n"])
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def write_shard(ids: pa.Array, sizes: list[int], values: np.ndarray) -> bytes:
    """The documents' ids as one shard: length and checksum of the document table, the table, the coded ids."""
    table = _document_table(ids, sizes)
    return struct.pack("<QI", len(table), zlib.crc32(table)) + table + id_coder.encode(values)


def read_shard(data: bytes) -> tuple[pa.Table, np.ndarray]:
    """(document table: id, n; all ids) of a shard; raises DamagedBlock where a checksum does not hold."""
    size, check = struct.unpack_from("<QI", data)
    table = data[12:12 + size]
    if zlib.crc32(table) != check:
        raise id_coder.DamagedBlock("document table")
    return pa.ipc.open_stream(table).read_all().combine_chunks(), id_coder.decode(data[12 + size:])


def _gathered(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of about ENCODED_BYTES of text, of several batches where these are small."""
    held, size = [], 0
    for some in text_slices(batches, column, ENCODED_BYTES):
        held.append(some)
        size += some.column(column).nbytes
        if size >= ENCODED_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def write_ids(docs: DataFrame, tokenizer: str, path: str, partitions: int, id_col: str = "doc_id", text_col: str = "text",
              end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of all documents, in ascending id order, as shards under ``path``.

    Columns: part and shard (their order is the documents' order), n_ids, data.
    Every document ends with ``end_id``. Null and empty texts are the end id
    alone; null ids come first; repeated rows are repeated documents. An empty
    table writes no shard.
    """
    read = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    ordered = read.repartitionByRange(partitions, "_id").sortWithinPartitions("_id", F.xxhash64("_text"), "_text")

    def shards(batches):
        part = TaskContext.get().partitionId()
        encoder = TextEncoder(tokenizer, end_id)
        owners, sizes, held, size, number = [], [], [], 0, 0

        def close():
            values = np.concatenate(held)
            held.clear()
            shard = write_shard(pa.concat_arrays(owners), sizes, values)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([size], pa.int64()), pa.array([shard], pa.binary())],
                names=["part", "shard", "n_ids", "data"])

        for some in _gathered(batches, "_text"):
            ids, counts = encoder.encode(some.column(1))
            first = done = at = 0
            for i, n in enumerate(counts.tolist()):
                at += n
                sizes.append(n)
                size += n
                if size >= shard_ids:
                    owners.append(some.column(0).slice(first, i + 1 - first))
                    held.append(ids[done:at])
                    yield close()
                    first, done, owners, sizes, held, size, number = i + 1, at, [], [], [], 0, number + 1
            owners.append(some.column(0).slice(first))
            held.append(ids[done:])
        if sizes:
            yield close()
        del encoder
        release_memory()

    with small_batches(docs.sparkSession, BATCH_ROWS):
        ordered.mapInArrow(shards, "part int, shard int, n_ids long, data binary").write.parquet(path)


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id", id_type: str = "long") -> DataFrame:
    """One row per document of the shards under ``path``: id, start (ids before it), n_tokens, ids_crc32."""
    shards = spark.read.parquet(path)
    # a few numbers per shard: ids before each part, then before each shard of the part
    counts = shards.groupBy("part", "shard").agg(F.sum("n_ids").alias("n"))
    parts = sorted((r.part, r.n) for r in counts.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one per task that wrote
    before = np.cumsum([0] + [n for _, n in parts]).tolist()
    ahead = spark.createDataFrame([(p, b) for (p, _), b in zip(parts, before)], "part int, ahead long")
    earlier = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    within = counts.select("part", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("inside"))
    offset = within.join(ahead, "part").select("part", "shard", (F.col("ahead") + F.col("inside")).alias("offset"))

    def documents(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                table, ids = read_shard(batch.column(0)[i].as_py())
                n = table.column("n").to_numpy()
                ends = np.cumsum(n)
                raw = ids.astype("<u4", copy=False)
                sums = [zlib.crc32(raw[e - k:e]) for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [table.column("id").combine_chunks(), pa.array(ends - n + batch.column(1)[i].as_py()), pa.array(n), pa.array(sums, pa.int64())],
                    names=[id_col, "start", "n_tokens", "ids_crc32"])
        release_memory()

    placed = shards.join(F.broadcast(offset) if len(parts) <= 10_000 else offset, ["part", "shard"]).select("data", "offset")
    return placed.mapInArrow(documents, f"`{id_col}` {id_type}, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Write the shards under the shared checkpoint folder and return what reading them back gives, per document."""
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/shards/{uuid.uuid4().hex[:12]}"
    write_ids(docs, tokenizer, path, partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), id_col, text_col)
    return read_ids(spark, path, id_col, dict(docs.dtypes)[id_col])
