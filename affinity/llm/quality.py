"""Quality classifier: naive-Bayes support vectors.

Word and byte n-gram indicators are hashed into a fixed table, scaled by the log
ratio of their class counts, and a linear hinge-loss model is fitted to the
scaled, length-normalised rows by dual coordinate descent. Labels are only read
for fitting; scoring is one pass over the texts with the finished weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from affinity.llm.common import BYTE_CODE, concat_texts, mix, release_memory, span_hashes, split_words, text_slices

#: Hashed n-gram indicators: 2**BITS weights (1 MB of floats, whatever the corpus).
BITS = 18
_MASK = np.uint64((1 << BITS) - 1)
#: Indicators "some word twice in a row" and "three times in a row".
REPEATED = np.uint64(11)
#: Bytes that separate words: ASCII white space.
WORD_BYTES = np.ones(256, bool)
WORD_BYTES[[9, 10, 11, 12, 13, 32]] = False


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document index, feature) of every distinct n-gram: words, word pairs and runs of four bytes."""
    data, offsets = concat_texts(texts)
    codes = BYTE_CODE[data]
    starts, ends, doc = split_words(data, offsets, WORD_BYTES)
    words = span_hashes(codes, starts, ends)
    found = [(doc, words)]
    if len(words) > 1:
        same = doc[1:] == doc[:-1]
        found.append((doc[1:][same], mix(words[:-1] * np.uint64(3) + words[1:])[same]))
        again = same & (words[1:] == words[:-1])  # a pair of equal words is also one n-gram, whichever the word
        twice = again[1:] & again[:-1]
        found.append((doc[1:][again], np.full(int(again.sum()), REPEATED, np.uint64)))
        found.append((doc[2:][twice], np.full(int(twice.sum()), REPEATED + np.uint64(1), np.uint64)))
    if len(data) >= 4:
        wide = data.astype(np.uint64)
        grams = mix((wide[:-3] | wide[1:-2] << np.uint64(8) | wide[2:-1] << np.uint64(16) | wide[3:] << np.uint64(24)) + np.uint64(1 << 40))
        at = np.searchsorted(offsets, np.arange(len(grams)), side="right") - 1
        inside = np.arange(len(grams)) + 4 <= offsets[at + 1]
        found.append((at[inside], grams[inside]))
    key = np.concatenate([d.astype(np.uint64) << np.uint64(BITS) | h & _MASK for d, h in found])
    key = np.unique(key)
    return (key >> np.uint64(BITS)).astype(np.int64), (key & _MASK).astype(np.int64)


def log_count_ratio(doc: np.ndarray, feature: np.ndarray, label: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Per feature: log of its smoothed share among class-1 documents over its share among class-0 documents."""
    counts = [np.bincount(feature[label[doc] == c], minlength=1 << BITS) + smooth for c in (1, 0)]
    size = [max(int((label == c).sum()), 1) + 2 * smooth for c in (1, 0)]
    return np.log(counts[0] / size[0]) - np.log(counts[1] / size[1])


def rows_log_count_ratio(rows: list[np.ndarray], label: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """``log_count_ratio`` of rows of distinct features, without a table of all of them."""
    counts = np.full((2, 1 << BITS), smooth)
    for features, c in zip(rows, label.tolist()):
        if c in (0, 1):
            counts[c][features] += 1
    size = [max(int((label == c).sum()), 1) + 2 * smooth for c in (0, 1)]
    return np.log(counts[1] / size[1]) - np.log(counts[0] / size[0])


def fit(doc, feature, label, ratio, penalty: float = 1.0, balance: float = 1.0,
        rounds: int = 20, seed: int = 7) -> tuple[np.ndarray, float]:
    """``fit_rows`` of (document index, feature) pairs, or of one array of features a document where ``doc`` is None."""
    if doc is None:
        return fit_rows(feature, label, ratio, penalty, balance, rounds, seed)
    bounds = np.searchsorted(doc, np.arange(len(label) + 1))
    return fit_rows([feature[a:b] for a, b in zip(bounds, bounds[1:])], label, ratio, penalty, balance, rounds, seed)


def fit_rows(rows: list[np.ndarray], label, ratio, penalty: float = 1.0, balance: float = 1.0,
             rounds: int = 20, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss; returns weights over indicators and the bias.

    Each class's box is widened by its rarity, so both classes weigh the same. Beside the rows it holds one
    single-precision value per feature of a row.
    """
    n = len(label)
    values = []
    for r in rows:
        v = ratio[r]
        norm = np.sqrt((v * v).sum())
        values.append((v / norm if norm > 0 else v).astype(np.float32))
    sign = np.where(label == 1, 1.0, -1.0)
    share = {c: max((label == c).mean(), 1e-9) for c in (0, 1)}
    box = np.array([penalty / (2 * share[int(c)]) ** balance for c in label])
    square = np.array([(v * v).sum() + 1.0 for v in values])  # 1: the bias as a constant feature
    dual, weights, bias = np.zeros(n), np.zeros(1 << BITS), 0.0
    order = np.arange(n)
    random = np.random.default_rng(seed)
    for _ in range(rounds):
        random.shuffle(order)
        most = 0.0
        for i in order:
            slope = sign[i] * (weights[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(dual[i] - slope / square[i], 0.0), box[i])
            if (step := (new - dual[i]) * sign[i]) != 0.0:
                weights[rows[i]] += step * values[i]
                bias += step
                dual[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return weights, bias


def margins(doc, feature, n: int, ratio, weights, bias) -> np.ndarray:
    v = ratio[feature]
    dot = np.bincount(doc, v * weights[feature], n)
    norm = np.sqrt(np.bincount(doc, v * v, n))
    return np.divide(dot, norm, out=np.zeros(n), where=norm > 0) + bias


class Model:
    """Weights over hashed indicators, as used for scoring."""

    def __init__(self, ratio: np.ndarray, weights: np.ndarray, bias: float):
        self.ratio, self.weights, self.bias = ratio, weights, bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        """0 to 1 per text; 0.5 is the separating plane. Nulls and empty texts get the bias alone."""
        doc, feature = indicators(texts)
        margin = margins(doc, feature, len(texts), self.ratio, self.weights, self.bias)
        return 1.0 / (1.0 + np.exp(-SLOPE * np.clip(margin, -20, 20)))


#: Steepness of the score around the separating plane.
SLOPE = 4.0


def train_quality(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", id_col: str = "doc_id",
                  text_col: str = "text", max_rows: int = 8_000, penalty: float = 3.0) -> Model:
    """Fit on at most ``max_rows`` labelled documents, chosen by a hash of their ids among the labels that are ``usable``.

    A row hands over at most 2**BITS feature numbers, so ``max_rows`` bounds what
    reaches the driver. Of an id on several rows one text is used, the one of least
    digest. Null labels are ignored, of several labels of one id the greatest
    counts. Without rows of both classes the model scores 0.5.
    """
    chosen = (labels.filter(usable & F.col(label_col).isNotNull())
              .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
              .orderBy(F.xxhash64("_id"), "_id").limit(max_rows))
    sample = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
              .join(F.broadcast(chosen), "_id")
              # an id may stand on any number of rows
              .groupBy("_id", "_label").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), F.col("_text"))).alias("_text")))

    def extract(batches):
        for part in text_slices(batches, "_text"):
            doc, feature = indicators(part.column(2))
            cuts = np.searchsorted(doc, np.arange(part.num_rows + 1))
            packed = [feature[a:b].astype(np.int32).tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.binary())],
                                             names=["_id", "_label", "_features"])

    id_type = dict(labels.dtypes)[id_col]
    rows = sample.mapInArrow(extract, f"_id {id_type}, _label int, _features binary").orderBy("_id").toArrow()
    label = rows.column("_label").to_numpy()
    packed = [np.frombuffer(b.as_buffer(), np.int32) for b in rows.column("_features")]  # views: nothing is copied
    if len(set(label.tolist())) < 2:
        zero = np.zeros(1 << BITS)
        return Model(zero, zero, 0.0)
    del rows
    ratio = rows_log_count_ratio(packed, label)
    model = Model(ratio, *fit(None, packed, label, ratio, penalty))
    del packed
    release_memory()   # the driver keeps the weights alone
    return model


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns and rows of ``docs`` with ``score`` (0 to 1, higher: class 1 likelier) added; one pass, no shuffle.

    A column of the name ``score_col`` is replaced. Null and empty texts are
    scored by the bias alone; repeated rows score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.ratio, model.weights, model.bias))
    docs = docs.drop(score_col)

    def score(batches):
        own = Model(*shared.value)
        for part in text_slices(batches, text_col, 1 << 19):
            got = own.scores(part.column(part.schema.get_field_index(text_col)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64())], names=[*part.schema.names, score_col])
        release_memory()

    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))
