"""Near-duplicates against brute-force weighted Jaccard similarity and components."""

import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa

from affinity.llm import near_dup as nd
from tests.llm.texts import documents


def brute_classes(rows, threshold=0.8):
    """Classes from all pairs, with the library's hashed idf weights but plain shingles."""
    texts = [t or "" for _, t in rows]
    freq = np.zeros(1 << nd.DF_BITS, np.int64)
    bags = []
    for t in texts:
        w = t.encode().split()
        grams = [tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))] if w else []
        _, h, n = nd.shingles(pa.array([t]))
        bags.append({h: 1 + math.log(n) for h, n in zip(h.tolist(), n.tolist())})
        assert sorted(Counter(grams).values()) == sorted(n.tolist())
        freq[(h & nd._DF_MASK).astype(np.int64)] += 0
        freq += np.bincount((h & nd._DF_MASK).astype(np.int64), minlength=len(freq))
    idf = nd.idf(freq, len(texts))
    weight = lambda h: idf[h & int(nd._DF_MASK)]
    lead = list(range(len(rows)))

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        if texts[a] == texts[b]:
            close = True
        else:
            both, any_ = set(bags[a]) & set(bags[b]), set(bags[a]) | set(bags[b])
            low = sum(min(bags[a][h], bags[b][h]) * weight(h) for h in both)
            high = sum(max(bags[a].get(h, 0), bags[b].get(h, 0)) * weight(h) for h in any_)
            close = high > 0 and low / high >= threshold
        if close:
            lead[find(b)] = find(a)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, least[find(i)]) for i, (doc, _) in enumerate(rows))


def test_classes_match_brute_force(make):
    rows = documents(30)
    got = nd.near_duplicates(make(rows, "doc_id long, text string"))
    assert got.columns == ["doc_id", "class_id"]
    assert sorted(tuple(r) for r in got.collect()) == brute_classes(rows)


def test_every_near_copy_of_a_large_group_is_found(make):
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(150):
        text = list(base)
        text[i * 2] = f"own{i}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(f"c{i}_{j}" for j in range(100))) for i in range(50)]
    got = dict(nd.near_duplicates(make(rows, "doc_id long, text string")).collect())
    assert {got[i] for i in range(150)} == {0}
    assert all(got[1000 + i] == 1000 + i for i in range(50))


def test_cells_hold_every_pair_of_a_large_bucket(make, spark, monkeypatch):
    """A family of which many members are unlike the first one, in blocks of a few rows."""
    monkeypatch.setattr(nd, "CELL_ROWS", 7)
    monkeypatch.setattr(nd, "SMALL", 3)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(90):
        text = [f"b{j}" for j in range(150)]
        for j in rng.integers(0, 150, rng.integers(1, 9)):
            text[j] = f"own{i}_{j}"
        rows.append((i, " ".join(text)))
    got = sorted(map(tuple, nd.near_duplicates(make(rows, "doc_id long, text string")).collect()))
    want = brute_classes(rows)
    assert len({c for _, c in want}) > 1 and got == want


def test_close_pairs_match_the_definition():
    rows = documents(10)
    texts = pa.array([t or "" for _, t in rows])
    table = nd.idf(np.arange(1 << nd.DF_BITS) % 50, 50)
    close = nd.close_pairs(texts, table, 0.5, chunk=64)
    sets = []
    for t in texts:
        _, h, n = nd.shingles(pa.array([t.as_py()]))
        sets.append((h, nd.tf_idf(h, n, table)))
    for i, (h, w) in enumerate(sets):
        for j, (g, v) in enumerate(sets):
            if i == j:  # only pairs of two rows are meant
                continue
            one = nd.weighted_jaccard((np.zeros(len(h), int), h, w), (np.zeros(len(g), int), g, v), 1)[0]
            assert close[i, j] == (one >= 0.5) or abs(one - 0.5) < 1e-9


def test_chain_of_links_is_one_class(make):
    texts = [[f"t{j}" for j in range(200)]]
    for i in range(5):
        texts.append(texts[-1][:])
        for j in range(3):
            texts[-1][i * 40 + j * 3] = f"n{i}_{j}"
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = brute_classes(rows)
    assert sorted(map(tuple, nd.near_duplicates(make(rows, "doc_id long, text string")).collect())) == want


def test_samples_meet_as_often_as_the_similarity_says():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    weight = np.concatenate([rng.uniform(.5, 9, 300), rng.uniform(.5, 9, 300)])
    doc = np.repeat([0, 1], 300)
    out = nd.weighted_samples(doc, np.concatenate([h, h]), weight, 2, 3000)
    low = np.minimum(weight[:300], weight[300:]).sum() / np.maximum(weight[:300], weight[300:]).sum()
    assert abs((out[:, 0] == out[:, 1]).mean() - low) < 0.04


def test_leads_stay(make):
    rows = documents(20)
    docs = make(rows, "doc_id long, text string")
    kept = nd.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in brute_classes(rows)})


def test_empty_table(make):
    assert nd.near_duplicates(make([], "doc_id long, text string")).count() == 0
    assert nd.near_duplicates(make([(1, None), (2, ""), (None, "a b c")], "doc_id long, text string")).count() == 3


def test_frequencies_are_those_of_shingles_in_a_corpus_of_many(make, monkeypatch):
    """1.6 million shingles of single documents; two texts that share a common line and differ in rare ones stay apart."""
    monkeypatch.setattr(nd, "BLOCK_BYTES", 100_000)
    rows = [(100 + i, " ".join(f"f{i}_{j}" for j in range(4000))) for i in range(400)]
    line = [f"b{j}" for j in range(94)]  # 90 shingles, in 100 documents
    for i in range(100):
        rows.append((1000 + i, " ".join(line + [f"o{i}_{j}" for j in range(8 if i < 2 else 60)])))
    classes = dict(nd.near_duplicates(make(rows, "doc_id long, text string")).collect())
    assert classes[1001] == 1001  # 0.79 by the frequencies of the shingles, 0.81 by those of 2^18 buckets
    docs = make(rows, "doc_id long, text string").select(*[nd.F.col("doc_id").alias("_id"), nd.F.unhex(nd.F.md5("text")).alias("_name"), nd.F.col("text").alias("_text")])
    blocks = nd.stage(nd._blocks(docs), "test_blocks")
    assert blocks.count() > 4
    out = nd.sketches(blocks.join(nd._frequencies(blocks, 8), "block", "left"), "bigint", len(rows), 2, 2).collect()
    texts = dict(rows)
    freq = Counter(h for t in texts.values() for h in nd.shingles(pa.array([t]))[1].tolist())
    assert len(out) == len(rows)
    for r in out:
        assert nd.unpack(bytes(r._freq), np.int64).tolist() == [freq[h] for h in nd.shingles(pa.array([texts[r._id]]))[1].tolist()]
