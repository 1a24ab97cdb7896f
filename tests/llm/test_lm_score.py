"""Stupid-backoff scores against plain counting."""

import math
from collections import Counter

import pytest

from affinity.llm import lm_score as lm
from tests.llm.texts import documents


def brute(rows, order):
    def grams(t):
        w = (t or "").encode().split()
        return w, Counter(tuple(w[i:i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))

    total, size, out = Counter(), 0, []
    for _, t in rows:
        w, g = grams(t)
        total += g
        size += len(w)
    for d, t in rows:
        w, own = grams(t)
        rest, score = max(size - len(w), 1), 0.0
        for i in range(len(w)):
            for n in range(order, 0, -1):
                if n > i + 1:
                    continue
                g = tuple(w[i - n + 1:i + 1])
                have, below = total[g] - own[g], rest if n == 1 else total[g[:-1]] - own[g[:-1]]
                if have > 0:
                    score += math.log(have / below * lm.BACKOFF ** (order - n))
                    break
            else:
                score += math.log(lm.BACKOFF ** order / rest)
        out.append((d, len(w), round(score, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_matches_plain_counts(make, monkeypatch, order):
    rows = documents(25) + [(None, "w1 w2 w3"), (900, "w1 w2 w3 w1 w2")]
    monkeypatch.setattr(lm, "BLOCK_BYTES", 3000)
    got = lm.score_documents(make(rows, "doc_id long, text string"), order)
    assert got.columns == ["doc_id", "n_words", "log_score", "mean_log_score"]
    found = got.collect()
    assert sorted([(r.doc_id, r.n_words, round(r.log_score, 6)) for r in found], key=str) == brute(rows, order)
    for r in found:
        assert r.mean_log_score is None if r.n_words == 0 else math.isclose(r.mean_log_score, r.log_score / r.n_words)


def test_many_partitions_agree(make, monkeypatch):
    rows = documents(10)
    monkeypatch.setattr(lm, "PART_ENTRIES", 1 << 6)
    got = lm.score_documents(make(rows, "doc_id long, text string"), 2)
    assert sorted([(r.doc_id, r.n_words, round(r.log_score, 6)) for r in got.collect()], key=str) == brute(rows, 2)


def test_empty_table(make):
    assert lm.score_documents(make([], "doc_id long, text string")).count() == 0


def test_registered_query_counts_trigrams(spark, tmp_path):
    """Word pairs that all occur, in an order that does not: order 2 scores them like fluent text."""
    from affinity.llm.queries import QUERIES
    rows = [(i, "a b c d e f g h") for i in range(4)] + [(10, "x b y"), (11, "z b c w"), (12, "a b y"), (13, "x b c d")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op6_stupid_backoff"](spark, str(tmp_path)).collect()
    assert sorted([(r.doc_id, r.n_words, round(r.log_score, 6)) for r in got], key=str) == brute(rows, 3) != brute(rows, 2)
