"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features are the folded words of a text and their prefixes of a few lengths, present or not; a prefix
stands for a family of inflected words. One weight vector serves all ordered thresholds:
P(grade <= k) = sigmoid(threshold_k - w.x). The expected severity is the sum over k of P(grade > k).

Labels say toxic or not. Toxic training rows are graded 1 or 2 by whether at most, or more than, the median
number of toxic-leaning features are in them; all others are grade 0.

The model is fitted on a bounded sample of labelled rows, ``max_training_rows``, chosen by a hash of the id, and
has at most ``max_features`` features, so it is broadcast whatever the corpus. Scoring reads whole texts in
one pass, without a shuffle.

Cases: null and empty texts have no features and get the base rate; repeated rows are scored each; with no
usable labels, or one class only, severity is 0 and nothing is toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .wordhash import Words, blocks, buffers, mix, words

PREFIXES = (4, 5, 6, 7, 8)


def _features(found: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of words, hashes of a feature each) for whole words, then for prefixes of each length."""
    yield np.arange(len(found.hashes)), found.hashes
    length = found.ends - found.starts
    with np.errstate(over="ignore"):
        for n in PREFIXES:
            which = np.flatnonzero(length > n)
            yield which, mix(found.prefix_hash(which, n) + np.uint64(n))


@dataclass
class OrdinalModel:
    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, of linear scores."""
        return 1 / (1 + np.exp(-(x[:, None] - self.thresholds[None, :])))

    def lookup(self, bits: int = 20) -> np.ndarray:
        seen = np.zeros(1 << bits, bool)
        seen[self.features >> np.uint64(64 - bits)] = True
        return seen

    def present(self, found: Words, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, feature) places of the model's features in texts."""
        text = np.repeat(np.arange(len(found.first) - 1), np.diff(found.first))
        shift = np.uint64(64 - int(len(seen)).bit_length() + 1)
        pairs = []
        for which, h in _features(found):
            maybe = np.flatnonzero(seen[h >> shift])
            at = np.searchsorted(self.features, h[maybe])
            at[at == len(self.features)] = 0
            hit = self.features[at] == h[maybe]
            pairs.append(text[which[maybe[hit]]] * len(self.features) + at[hit])
        both = np.unique(np.concatenate(pairs))
        return both // len(self.features), both % len(self.features)


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, n_features: int, l2: float = 1e-4, rounds: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds, by Adam on the mean negative log likelihood of binary sparse features."""
    levels = int(grades.max())
    w = np.zeros(n_features)
    share = np.array([(grades <= k).mean() for k in range(levels)]).clip(1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    t = np.concatenate(([start[0]], np.log(np.maximum(np.diff(start), 1e-2))))
    params = np.concatenate((w, t))
    m, v = np.zeros_like(params), np.zeros_like(params)
    n = len(grades)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, rounds + 1):
        w, t = params[:n_features], params[n_features:]
        theta = np.concatenate(([t[0]], t[0] + np.cumsum(np.exp(t[1:]))))
        x = np.bincount(rows, w[columns], n)
        padded = np.concatenate(([-np.inf], theta, [np.inf]))
        upper, lower = sigmoid(padded[grades + 1] - x), sigmoid(padded[grades] - x)
        upper[grades == levels], lower[grades == 0] = 1.0, 0.0
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        gx = (du - dl) / n
        gw = np.bincount(columns, gx[rows], n_features) + l2 * w
        gtheta = np.array([(-du[grades == k].sum() + dl[grades == k + 1].sum()) / n for k in range(levels)])
        tail = np.cumsum(gtheta[::-1])[::-1]
        gt = np.concatenate(([tail[0]], tail[1:] * np.exp(t[1:])))
        g = np.concatenate((gw, gt))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    t = params[n_features:]
    return params[:n_features], np.concatenate(([t[0]], t[0] + np.cumsum(np.exp(t[1:]))))


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", max_training_rows: int = 8_000, max_features: int = 2_000, least_rows: int = 4) -> OrdinalModel | None:
    """Fit on a bounded sample of labelled rows; None if they hold one class only."""
    labels = labels.filter(F.col(toxic_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), (F.col(toxic_col) > 0).cast("int").alias("__toxic")).dropDuplicates(["__id"])
    labels = written(labels, "labels")
    n = labels.count()
    if n > max_training_rows:
        labels = labels.filter(F.pmod(F.xxhash64(F.lit("train"), "__id"), F.lit(1 << 20)) < int((1 << 20) * max_training_rows / n))
    rows = documents.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(labels), "__id").select("__id", "__toxic", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            lists = []
            for lo, hi in blocks(offsets):
                found = words(data, offsets, lo, hi)
                text = np.repeat(np.arange(hi - lo), np.diff(found.first))
                parts = [(text[which], h) for which, h in _features(found)]
                who, what = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
                lists += [np.unique(what[who == k]).view(np.int64) for k in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int64()))], names=["id", "toxic", "features"])

    id_type = documents.select(id_col).schema.fields[0].dataType.simpleString()
    sample = written(rows.mapInArrow(extract, f"id {id_type}, toxic int, features array<bigint>"), "training-features")
    total, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic or toxic == total:
        return None
    rate = toxic / total
    counts = sample.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).filter(F.col("n") >= least_rows)
    z = (F.col("t") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    best = counts.withColumn("z", z).filter(F.abs("z") > 3).orderBy(F.desc(F.abs("z")), "f").limit(max_features).collect()
    if not best:
        return None
    features = np.array([r.f for r in best], np.int64).view(np.uint64)
    order = np.argsort(features)
    features, leaning = features[order], np.array([r.z for r in best])[order] > 0
    chosen = [int(f) for f in features.view(np.int64)]
    kept = sample.select("toxic", F.array_intersect("features", F.array(*[F.lit(f) for f in chosen])).alias("features")).collect()
    at = np.concatenate([np.full(len(r.features), k) for k, r in enumerate(kept)]).astype(np.int64)
    columns = np.searchsorted(features, np.array([f for r in kept for f in r.features], np.int64).view(np.uint64))
    is_toxic = np.array([r.toxic for r in kept])
    strength = np.bincount(at, leaning[columns].astype(float), len(kept))
    middle = np.median(strength[is_toxic == 1])
    grades = np.where(is_toxic == 0, 0, np.where(strength > middle, 2, 1))
    if not (grades == 2).any():
        grades = is_toxic
    weights, thresholds = fit_ordinal(at, columns, grades, len(features))
    return OrdinalModel(features, weights, thresholds)


def severities(documents: DataFrame, model: OrdinalModel | None, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """One row per row: doc_id, expected_severity, grade (the likeliest), toxic (grade above 0 is likelier than ``cut``)."""
    id_type = documents.select(id_col).schema.fields[0].dataType.simpleString()
    source = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return source.select("doc_id", F.lit(0.0).alias("expected_severity"), F.lit(0).alias("grade"), F.lit(False).alias("toxic"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        seen = model.lookup()
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            x = np.zeros(batch.num_rows)
            for lo, hi in blocks(offsets):
                text, feature = model.present(words(data, offsets, lo, hi), seen)
                x[lo:hi] = np.bincount(text, model.weights[feature], hi - lo)
            above = model.probabilities(x)
            exact = np.concatenate((1 - above[:, :1], above[:, :-1] - above[:, 1:], above[:, -1:]), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(axis=1)), pa.array(exact.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0] > cut)], names=["doc_id", "expected_severity", "grade", "toxic"])

    return source.mapInArrow(run, f"doc_id {id_type}, expected_severity double, grade int, toxic boolean")
