"""Collocations against plain counts of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from affinity.llm import collocations as co
from tests.llm.texts import documents

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_counts(rows, longest=4):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", (text or "").translate(LOWER)):
            w = re.findall("[^\\x20\\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                f[lang].update(" ".join(w[i:i + size]) for i in range(len(w) - size + 1))
    return f, n


def brute(rows, least=30, reported=2000, absorbed=80):
    out = []
    f, n = plain_counts(rows)
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if a >= least and " " in p}
        around = Counter()
        for p, a in cand.items():
            w = p.split(" ")
            for size in range(2, len(w)):
                for i in range(len(w) - size + 1):
                    q = " ".join(w[i:i + size])
                    around[q] = max(around[q], a)
        rows_ = []
        for p, a in cand.items():
            if 100 * around[p] >= absorbed * a:
                continue
            w = p.split(" ")
            score, _, left, right = min((2000000 * a // (c[" ".join(w[:k])] + c[" ".join(w[k:])]), k, c[" ".join(w[:k])], c[" ".join(w[k:])])
                                        for k in range(1, len(w)))
            rows_.append((-score, -a, p.encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows_)[:reported], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def corpus(seed=4):
    r = random.Random(seed)
    fixed = ["new york city hall", "kick the bucket", "größe über alles", "a b a b a b", "x"]
    rows = []
    for i in range(90):
        w = []
        for _ in range(r.randrange(1, 90)):
            w.append(r.choice(fixed) if r.random() < 0.3 else f"w{min(r.randrange(1, 60), r.randrange(1, 60))}")
            if r.random() < 0.2:
                w[-1] += r.choice([".", ",", "!", ";", ":", "?", "\n", "\r\n", "\x0b", "\t", "  "])
        rows.append((r.choice(["en", "de", None, "en"]), " ".join(w).title() if i % 9 == 0 else " ".join(w)))
    rows += [("en", "late bloom words " * 40), ("fr", "a b c d " * 40), (None, None), ("en", ""), ("und", " new york  city"), ("de", "  . , !\n")]
    return rows + [("en", t) for _, t in documents(20)] + rows[:3]


def run(make, rows, **settings):
    table = make([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string", parts=7)
    got = co.collocations(table, **settings)
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got.collect())


def test_matches_plain_counts(make):
    want = brute(corpus())
    assert run(make, corpus()) == want and len(want) > 20


def test_any_shards_slots_and_limits(make, monkeypatch):
    monkeypatch.setattr(co, "BLOCK_BYTES", 700)
    for shards, slots, least, reported in ((1, None, 12, 5), (4, 16, 30, 2000), (5, 1 << 16, 12, 2000)):
        assert run(make, corpus(), shards=shards, slots=slots, least=least, reported=reported) == brute(corpus(), least, reported)


def test_counts_are_of_one_full_cycle(make, monkeypatch, spark):
    """Phrases that get frequent only late are still counted over all shards, once."""
    monkeypatch.setattr(co, "BLOCK_BYTES", 200)
    rows = [("en", "rare pair here " + f"w{i} " * 20) for i in range(40)]
    blocks = co._blocks(make([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string"), 4, "lang", "text")
    got = {r.phrase: r.a for r in co.frequent_phrases(blocks.cache(), least=30, shards=4).collect()}
    f, _ = plain_counts(rows)
    assert got == {p: a for p, a in f["en"].items() if a >= 30}


def test_blocks_keep_words_and_pieces():
    import pyarrow as pa
    n, vocabulary, codes = co._encoded(pa.array(["A b,c", None, "", "b  \t É..b"]))
    words = co.zstandard.ZstdDecompressor().decompress(vocabulary, max_output_size=99).decode().split(" ")
    assert n == 6 and [words[c] if c >= 0 else None for c in co.unpack(codes, np.int32)] == [None, "a", "b", None, "c", None, "b", "É", None, "b"]
    assert co._encoded(pa.array([None, " . "])) is None


def test_empty_table(make):
    assert run(make, []) == [] and run(make, [("en", None), (None, " , ")]) == []
