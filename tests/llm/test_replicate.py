"""Poisson replication against a plain inversion."""

import hashlib
import math
from collections import Counter

from affinity.llm import replicate as rp
from tests.llm.texts import documents


def unit(seed, *parts):
    text = "|".join([seed, *["null" if p is None else str(p) for p in parts]])
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2 ** 52


def draw(seed, doc, rate):
    parts = max(1, math.ceil(rate / 16))
    n = 0
    for i in range(1, parts + 1):
        mean, u, k = rate / parts, unit(seed, doc, i), 0
        p = c = math.exp(-mean)
        while c <= u and k < 95:
            k += 1
            p *= mean / k
            c += p
        n += k + (c <= u)
    return n


def brute(rows, weights, default, total, seed="mix"):
    count = Counter(s for _, _, s in rows)
    weight = {s: weights.get(s, default) for s in count}
    rate = {s: total * len(rows) * weight[s] / sum(weight.values()) / count[s] for s in count}
    return Counter((d, t, s, i) for d, t, s in rows for i in range(draw(seed, d, rate[s])))


def rows():
    docs = documents(60)
    return [(d, t, None if d % 11 == 0 else "hot" if d % 3 else f"s{d % 5}") for d, t in docs] + [(None, "null id", "s1")]


def run(make, data, **settings):
    table = make(data, "doc_id long, text string, source string")
    got = rp.replicate(table, **settings)
    assert got.columns == [c for c in table.columns if c != "copy_no"] + ["copy_no", "place"]
    return got


def test_copies_match_plain_inversion(make):
    for weights, default, total in (({}, 1.0, 1.0), ({"hot": 3.0, "s1": 0.0}, 0.5, 2.5), ({"s1": 500.0}, 1.0, 30.0)):
        got = run(make, rows(), weights=weights, default_weight=default, total=total).collect()
        assert Counter((r.doc_id, r.text, r.source, r.copy_no) for r in got) == brute(rows(), weights, default, total)


def test_order_is_a_global_seeded_shuffle(make, spark):
    got = run(make, rows(), total=4.0, partitions=3)
    places = [r.place for r in got.collect()]
    assert places == sorted(places) and 0 <= places[0] and places[-1] < 1
    again = run(make, list(reversed(rows())), total=4.0, partitions=7).collect()
    assert sorted(map(str, again)) == sorted(map(str, got.collect()))
    assert [r.place for r in run(make, rows(), total=4.0, seed="other").collect()] != places


def test_mix_meets_its_weights(make):
    data = [(i, "t", "a" if i % 10 else "b") for i in range(4000)]
    got = Counter(r.source for r in run(make, data, weights={"a": 1.0, "b": 3.0}).collect())
    assert abs(got["b"] / 3000 - 1) < 0.15 and abs(got["a"] / 1000 - 1) < 0.15


def test_empty_table_and_no_python(make):
    assert run(make, []).count() == 0
    plan = run(make, rows())._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
