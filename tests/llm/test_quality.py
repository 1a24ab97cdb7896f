"""Quality classifier: held-out accuracy, dual descent on a known problem, odd inputs."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from affinity.llm import quality as qu
from affinity.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op1_nbsvm"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert got.score.between(0, 1).all()
    assert ((got.score >= .5).astype(int) == got.predicted).all()
    order = got.score.rank().to_numpy()
    good = (got.quality == 1).to_numpy()
    auc = (order[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.97


def test_indicators_are_distinct_and_local():
    texts = pa.array(["a b a b", None, "", "xyzw", "a b a b"])
    doc, feature = qu.indicators(texts)
    assert len(set(zip(doc.tolist(), feature.tolist()))) == len(doc)
    assert set(doc.tolist()) == {0, 3, 4}
    assert set(feature[doc == 0].tolist()) == set(feature[doc == 4].tolist())
    alone = qu.indicators(pa.array(["xyzw"]))[1]
    assert set(feature[doc == 3].tolist()) == set(alone.tolist())


def test_dual_descent_separates():
    rng = np.random.default_rng(1)
    label = rng.integers(0, 2, 200)
    rows = [np.unique(np.r_[rng.integers(0, 50, 5), 100 + y]) for y in label]
    doc, feature = np.repeat(np.arange(200), [len(r) for r in rows]), np.concatenate(rows)
    ratio = qu.log_count_ratio(doc, feature, label)
    weights, bias = qu.fit(doc, feature, label, ratio)
    got = qu.margins(doc, feature, 200, ratio, weights, bias)
    assert ((got > 0) == (label == 1)).all()


def test_odd_inputs(make, spark):
    docs = make([(i, f"good clean text number {i}") for i in range(20)] + [(20 + i, "BAD!! " * (i + 1)) for i in range(20)]
                + [(40, None), (41, ""), (42, "x" * 200000), (0, "good clean text number 0"), (None, "a")], "doc_id long, text string")
    labels = make([(i, int(i < 20)) for i in range(40)] + [(3, 1), (5, None), (None, 1), (900, 0)], "doc_id long, quality int")
    model = qu.train_quality(docs, labels, F.lit(True), max_rows=30)
    got = qu.score_quality(docs.withColumn("score", F.lit("old")), model)
    assert got.count() == 45 and dict(got.dtypes)["score"] == "double"
    by = {r.doc_id: r.score for r in got.collect()}
    assert by[40] == by[41] and min(by[i] for i in range(20)) > max(by[20 + i] for i in range(20))
    none = qu.train_quality(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in qu.score_quality(docs, none).collect()} == {0.5}
    assert qu.score_quality(docs.limit(0), model).count() == 0


def test_ratios_and_dual_solution_match_plain_forms():
    """Ratios recounted one indicator at a time; the dual solution against plain projected descent on the whole dual."""
    rng = np.random.default_rng(3)
    label = np.array([1] * 12 + [0] * 8)
    rows = [np.unique(np.r_[rng.integers(0, 12, 4), 20 + (y if rng.random() < 0.8 else 1 - y)]) for y in label]
    doc, feature = np.repeat(np.arange(20), [len(r) for r in rows]), np.concatenate(rows)
    ratio = qu.log_count_ratio(doc, feature, label)
    for f in range(25):
        have = [sum(f in r for r, y in zip(rows, label) if y == c) for c in (0, 1)]
        want = np.log((have[1] + 1) / (12 + 2)) - np.log((have[0] + 1) / (8 + 2))
        assert abs(ratio[f] - want) < 1e-12
    x = np.zeros((20, 26))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.linalg.norm(ratio[r])
    x[:, 25] = 1.0  # the bias
    sign, box = np.where(label == 1, 1.0, -1.0), np.where(label == 1, 1 / 1.2, 1 / 0.8)
    q = (x * sign[:, None]) @ (x * sign[:, None]).T
    dual, step = np.zeros(20), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(50_000):
        dual = np.clip(dual - step * (q @ dual - 1), 0, box)
    weights, bias = qu.fit(doc, feature, label, ratio, rounds=20_000)
    primal = lambda w, b: (w @ w + b * b) / 2 + (box * np.maximum(0, 1 - sign * (x[:, :25] @ w + b))).sum()
    best = (x * sign[:, None]).T @ dual
    assert primal(weights[:25], bias) <= primal(best[:25], best[25]) * 1.01


def test_one_text_per_labelled_id(make, monkeypatch):
    """An id on many rows hands one of them to the driver."""
    docs = make([(i, f"good text {i}") for i in range(10)] + [(10 + i, "BAD " * 3) for i in range(10)]
                + [(0, f"good text {i}") for i in range(300)] + [(None, None)], "doc_id long, text string")
    labels = make([(i, int(i < 10)) for i in range(20)], "doc_id long, quality int")
    sizes = []
    fit = qu.fit
    monkeypatch.setattr(qu, "fit", lambda doc, feature, label, *rest: (sizes.append(len(label)), fit(doc, feature, label, *rest))[1])
    qu.train_quality(docs, labels, F.lit(True))
    assert sizes == [20]


def test_the_fit_holds_little_beside_the_rows():
    import tracemalloc
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 1 << qu.BITS, 20_000)).astype(np.int32) for _ in range(200)]
    label = rng.integers(0, 2, 200)
    doc, feature = np.repeat(np.arange(200), [len(r) for r in rows]), np.concatenate(rows)
    ratio = qu.log_count_ratio(doc, feature, label)
    wanted = qu.fit(doc, feature, label, ratio, rounds=2)
    del doc, feature
    tracemalloc.start()
    try:
        own = qu.rows_log_count_ratio(rows, label)
        got = qu.fit_rows(rows, label, own, rounds=2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.array_equal(own, ratio) and np.array_equal(got[0], wanted[0]) and got[1] == wanted[1]
    assert peak < 1.5 * sum(r.nbytes for r in rows) + 16 * 8 * (1 << qu.BITS)
