"""Token-id shards: exact round trips, checksums, and the query's digest against a plain encoding."""

import zlib

import numpy as np
import pytest

from affinity.llm import id_coder, token_file
from affinity.llm.queries import tokenizer_path
from tests.llm.texts import documents


@pytest.mark.parametrize("ids", [[], [7], [5] * 3000, list(range(5000)), [4294967295, 0, 1, 4294967295],
                                 np.random.default_rng(2).integers(0, 50257, 9001).tolist(),
                                 (np.random.default_rng(3).zipf(1.2, 9001) % 50257).tolist()])
@pytest.mark.parametrize("block", [64, 2048])
def test_round_trip(ids, block):
    ids = np.array(ids, np.uint32)
    assert np.array_equal(id_coder.decode(id_coder.encode(ids, block)), ids)


def test_more_ids_than_a_class_holds():
    ids = np.arange(600_000, dtype=np.uint32)
    assert np.array_equal(id_coder.decode(id_coder.encode(ids, 4096)), ids)


def test_blocks_are_independent_and_checked():
    ids = np.array(np.random.default_rng(4).zipf(1.3, 1000) % 500, np.uint32)
    data = id_coder.encode(ids, 100)
    assert np.array_equal(id_coder.decode(data, slice(3, 5)), ids[300:500])
    broken = bytearray(data)
    broken[-40] ^= 1
    with pytest.raises(id_coder.DamagedBlock):
        id_coder.decode(bytes(broken))
    assert np.array_equal(id_coder.decode(bytes(broken), slice(0, 3)), ids[:300])
    with pytest.raises(id_coder.DamagedBlock):
        id_coder.decode(b"x" + data[1:])


def test_repetitive_ids_get_small():
    ids = np.tile(np.random.default_rng(5).integers(0, 50000, 50), 400).astype(np.uint32)
    assert len(id_coder.encode(ids)) < len(ids) * 2 / 8


def plain():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def test_cut_texts_have_the_ids_of_whole_texts():
    texts = [t or "" for _, t in documents()] + ["a\n\n b  c", "x <|endoftext|> y", "a\t\n b", "  lead", "trail  \n", "\n\n\n",
             "it's 12 3!! a  b", "a \x1c b", "café näive", "a\x85 b", "　 a", "don't  we'll", "x<|endoftext|>  y"]
    whole = plain()
    got = token_file.TextEncoder(tokenizer_path()).ids(texts)
    assert [g.tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_contractions_at_the_start_of_texts():
    """The ids of a word must not depend on the words it was first met with."""
    starts = ["'s abc", "'re you", "'ll go", "'t", "'m", "'d x", "'ve", "'S", "''s", "!'s", "\u2019s a", "-x", "_y", "\u0301a", "(a", "1'2", "a's", "\n's", " 's"]
    whole = plain()
    want = [whole.encode(t, add_special_tokens=False).ids for t in starts]
    for order in (starts, starts[::-1]):
        encoder = token_file.TextEncoder(tokenizer_path())
        for texts in (order, order, ["x " + t for t in order]):
            assert [g.tolist() for g in encoder.ids(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    alone = [token_file.TextEncoder(tokenizer_path()).ids([t])[0].tolist() for t in starts]
    assert alone == want


def test_documents_read_back(make):
    rows = documents()
    got = token_file.encode_documents(make(rows, "doc_id long, text string"), tokenizer_path(), partitions=3)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    whole, start, want = plain(), 0, []
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_small_shards_and_null_ids(make, spark, tmp_path):
    rows = [(None, "a b"), (3, "c"), (1, "d e f"), (2, None)]
    token_file.write_ids(make(rows, "doc_id long, text string"), tokenizer_path(), str(tmp_path / "s"), 2, shard_ids=2)
    assert spark.read.parquet(str(tmp_path / "s")).count() > 2
    got = token_file.read_ids(spark, str(tmp_path / "s")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 3]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()


def test_empty_table(make):
    got = token_file.encode_documents(make([], "doc_id long, text string"), tokenizer_path(), partitions=2)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() == 0


def test_random_texts_cut_anywhere():
    """Spaces, breaks, apostrophes, digits, marks, letters of one and more bytes and control characters in any order."""
    rng = np.random.default_rng(7)
    alphabet = np.array([*" \n'asl19.!_\0\x7féß日Ж", "  ", "\n\n", "'s", "'ll", " '", "́", "²", "<|endoftext|>", "\t", "　"])
    share = np.array([1.0] * (len(alphabet) - 3) + [0.02] * 3)
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 30), p=share / share.sum())) for _ in range(3000)]
    whole, encoder = plain(), token_file.TextEncoder(tokenizer_path())
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [g.tolist() for g in encoder.ids(texts)] == want


def test_marks_do_not_make_new_words():
    """A word is encoded once whatever mark is behind it, and forgotten cuts are encoded again."""
    encoder = token_file.TextEncoder(tokenizer_path())
    encoder.ids(["one two. two, two! two? two"])
    assert set(encoder.known) == {b"one", b" two", b".", b",", b"!", b"?"}
    texts = ["a b c", "b c\td", "", "x " * 50]
    want = [g.tolist() for g in encoder.ids(texts)]
    for _ in range(3):
        encoder._forget()
        assert [g.tolist() for g in encoder.ids(texts)] == want
    assert b" b" in encoder.known


def test_slices_of_several_batches():
    import pyarrow as pa
    texts = [f"text {i}" for i in range(40)]
    batches = [pa.record_batch([pa.array(range(i, i + 4)), pa.array(texts[i:i + 4])], names=["_id", "_text"]) for i in range(0, 40, 4)]
    got = list(token_file._gathered(iter(batches), "_text"))
    assert len(got) == 1 and got[0].column(1).to_pylist() == texts


def test_blocks_of_unlike_length_of_unpredicted_ids():
    """One block repeats itself, one never does, the last is short: the streams of unpredicted ids differ in length."""
    rng = np.random.default_rng(8)
    ids = np.concatenate([np.tile([3, 4, 5], 200)[:500], rng.permutation(500), np.full(500, 9), rng.integers(0, 50, 77)]).astype(np.uint32)
    data = id_coder.encode(ids, 500)
    assert np.array_equal(id_coder.decode(data), ids)
    assert np.array_equal(id_coder.decode(data, slice(2, None)), ids[1000:])
    assert len(id_coder.decode(data, slice(2, 2))) == 0
    with pytest.raises(id_coder.DamagedBlock):
        id_coder.decode(data[:-3])
