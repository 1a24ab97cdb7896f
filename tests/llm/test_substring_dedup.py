"""Substring dedup against brute force over all windows."""

import hashlib
import random
import re

import numpy as np

from affinity.llm import substring_dedup as sd
from affinity.llm.common import mix
from tests.llm.texts import documents, words


def brute(rows, window=20):
    split = {}
    for d, t in rows:
        split[(d, t)] = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    first, order = {}, sorted(split.items(), key=lambda x: (x[0][0] is not None, x[0][0] or 0))
    for (d, _), w in order:
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i:i + window]), (d, i))
    out = []
    for d, t in rows:
        w, gone = split[(d, t)], set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] != (d, i):
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(make, rows, **more):
    got = sd.remove_repeats(make(rows, "doc_id long, text string"), **more)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


def test_matches_brute_force(make):
    assert run(make, documents(30)) == brute(documents(30))


def test_runs_periods_and_boundaries(make):
    a, b = words(25, 1), words(25, 2)
    rows = [(1, "x " * 70), (2, "x " * 19), (3, "x " * 20 + "y"), (4, "a b " * 40), (5, "b a " * 15 + "c"), (6, "a b c " * 20),
            (7, " ".join(a[:20])), (8, " ".join(["q"] + a[:20] + ["q"])), (9, " ".join(a[:19] + b)), (10, " ".join(a + b)), (11, " ".join(b + a)),
            (12, " ".join(["x"] * 12 + ["y"] * 8 + ["z"])), (13, " ".join(["x"] * 15 + ["y"] * 10)), (14, " ".join(a + a)), (15, " ".join(b[5:])),
            (16, "   ".join(a)), (17, "\x0b".join(a)), (None, " ".join(b)), (18, None), (19, "")]
    assert run(make, rows) == brute(rows)


def test_random_texts_of_few_words(make):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randrange(60)))) for i in range(40)]
    rows += [(100 + i, " ".join(r.choice("abcdef") for _ in range(r.randrange(200)))) for i in range(20)]
    assert run(make, rows) == brute(rows)
    assert run(make, rows, window=6) == brute(rows, 6)


def test_equal_windows_have_equal_keys():
    r = np.random.default_rng(5)
    for alphabet in (2, 5, 1000):
        passage = mix(r.integers(0, alphabet, 20).astype(np.uint64))
        seen = set()
        for _ in range(30):
            before, after = (mix(r.integers(0, alphabet, r.integers(0, 30)).astype(np.uint64)) for _ in range(2))
            text = np.concatenate([before, passage, after])
            s, lo, hi = sd.anchors(text, np.zeros(len(text), np.int64))
            at = np.flatnonzero(s == len(before))[0]
            seen.add((int(lo[at] - s[at]), int(hi[at] - s[at])))
        assert len(seen) == 1


def test_empty_table(make):
    assert run(make, []) == []


def test_null_and_repeated_ids_with_different_texts(make):
    """Each (id, text) is a document of its own; of equal ids the least text digest comes first."""
    import hashlib
    plain = lambda name, n: [f"{name}{i}" for i in range(n)]
    passage = plain("p", 30)
    rows = []
    for d in (None, 5):
        own = [passage if d is None else plain("q", 30), plain(f"tail{d}", 12)]
        rows += [(d, plain(f"long{d}_", 200)), (d, plain(f"short{d}_", 3)), (d, own[0] + own[1]), (d, own[0] + plain(f"other{d}", 9))]
    want = []
    for d in (None, 5):
        texts = sorted((w for i, w in rows if i == d), key=lambda w: hashlib.md5(" ".join(w).encode()).digest())
        seen = False
        for w in texts:
            holds = w[0] in ("p0", "q0")
            want.append((d, len(w), 30 if holds and seen else 0, " ".join(w[30:] if holds and seen else w)))
            seen |= holds
    got = sd.remove_repeats(make([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got], key=str) == sorted(want, key=str)


def test_words_that_a_linear_hash_confuses(make):
    """The two Thue-Morse strings have one polynomial hash modulo 2 ** 64."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = one.translate({97: 98, 98: 97})
    around = [f"w{i}" for i in range(20)]
    for word in (one[:1024], one):
        rows = [(1, " ".join(around[:10] + [word] + around[10:])), (2, " ".join(around[:10] + [other[:len(word)]] + around[10:]))]
        got = sd.remove_repeats(make(rows, "doc_id long, text string")).collect()
        assert [r.n_removed for r in got] == [0, 0]
