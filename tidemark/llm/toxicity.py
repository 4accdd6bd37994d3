"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

It is fitted on a bounded sample of labelled rows (``SAMPLE`` documents a class, those with the smallest hashes of
their ids); class shares come from all labels. Fitting: executors count, for each hashed n-gram, the sampled documents
of either class that have it; the ``FEATURES`` n-grams that tell the classes apart best get their log-count ratio as
the value of their presence; logistic regression weighs them. Every document is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import beside, doc_crc_mod, durable, renamed, small_batches
from tidemark.llm.ngrams import hashed_ngrams, normalised

#: Most labelled documents of a class that the classifier is fitted on.
SAMPLE = 8192
#: Lengths in bytes of the n-grams, and bits of their hashes.
SIZES, BITS = range(4, 8), 19
#: N-grams that the linear model weighs.
FEATURES = 4096
STEPS, PENALTY = 200, 1e-3
#: Documents that score this or more count as toxic.
THRESHOLD = 0.3
SCORES = "doc_id long, score double"


@dataclass
class ToxicityModel:
    feature_of: np.ndarray  # hash to feature, -1 for none
    weights: np.ndarray  # log-count ratio times regression weight of each feature
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        owner, feature = present(texts, self.feature_of)
        z = np.bincount(owner, weights=self.weights[feature], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def present(texts: list[str | None], feature_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, feature) pairs among the n-grams of the texts."""
    starts, hashes = hashed_ngrams([normalised(t) for t in texts], SIZES, BITS)
    pairs = [np.zeros(0, np.int64)]
    for h in hashes:
        feature = feature_of[h]
        at = np.flatnonzero(feature >= 0)
        pairs.append(np.unique((np.searchsorted(starts, at, side="right") - 1) * len(feature_of) + feature[at]))
    pairs = np.unique(np.concatenate(pairs))
    return pairs // len(feature_of), pairs % len(feature_of)


def labelled_sample(docs: DataFrame, labels: DataFrame, learn_from) -> tuple[DataFrame, dict[int, int]]:
    """At most ``SAMPLE`` labelled documents of either class, and how many labels each class has in all."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(learn_from(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("doc_id")
    chosen = None
    for label in (0, 1):
        part = known.filter(F.col("toxic") == label).orderBy(order, "doc_id").limit(SAMPLE)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Broadcast: at most 2 * SAMPLE pairs of numbers.
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), totals


def fit(docs: DataFrame, labels: DataFrame, learn_from=lambda doc_id: F.lit(True)) -> ToxicityModel:
    """The model for labels whose doc_id satisfies ``learn_from``; without labels of both classes it scores their share.

    Without any label nothing is known to be toxic, and every score is close to 0. Labels that are null or neither 0 nor
    1 or have no doc_id do not count; of labels that repeat a doc_id the largest counts, and of texts the smallest.
    """
    sample, totals = labelled_sample(docs, labels, learn_from)
    sample = durable(sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), dtype=np.int64)
        docs_of = np.zeros(2, dtype=np.int64)
        for batch in small_batches(batches, "text", 1 << 20):
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            starts, hashes = hashed_ngrams([normalised(t) for t in batch.column(2).to_pylist()], SIZES, BITS)
            hashes = list(hashes)
            for i, label in enumerate(toxic):
                flags = np.zeros(1 << BITS, dtype=bool)
                for h in hashes:
                    flags[h[starts[i] : starts[i + 1]]] = True
                seen[label] += flags
                docs_of[label] += 1
        seen[:, 0] = docs_of  # hash 0 is no n-gram
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[0][at], pa.int64()), pa.array(seen[1][at], pa.int64())], names=["hash", "clean", "toxic"])

    counts = sample.select("doc_id", "toxic", "text").mapInArrow(count, "hash long, clean long, toxic long").groupBy("hash").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sizes = counts.filter("hash = 0").collect()
    n0, n1 = (int(sizes[0]["clean"]), int(sizes[0]["toxic"])) if sizes else (0, 0)
    share = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1) if totals else 1e-6
    feature_of = np.full(1 << BITS, -1, dtype=np.int32)
    if not n0 or not n1:
        return ToxicityModel(feature_of, np.zeros(1), float(np.log(share / (1 - share))))
    p0, p1 = (F.col("clean") + 0.5) / (n0 + 1.0), (F.col("toxic") + 0.5) / (n1 + 1.0)
    pooled = (F.col("clean") + F.col("toxic") + 1.0) / (n0 + n1 + 2.0)
    chosen = (
        counts.filter("hash > 0 AND clean + toxic > 1")  # in more than one document of all
        .select("hash", F.log(p1 / p0).alias("ratio"), (F.pow(p1 - p0, 2.0) / (pooled * (F.lit(1.000001) - pooled))).alias("telling"))
        .orderBy(F.desc("telling"), "hash").limit(FEATURES).orderBy("hash").collect()
    )
    feature_of[[r["hash"] for r in chosen]] = np.arange(len(chosen))
    ratio = np.array([r["ratio"] for r in chosen])
    shared = docs.sparkSession.sparkContext.broadcast(feature_of)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), 200):
                part = batch.iloc[begin : begin + 200]
                owner, feature = present(part["text"].tolist(), shared.value)
                own = np.split(feature.astype(np.int32), np.searchsorted(owner, np.arange(1, len(part))))
                yield pd.DataFrame({"doc_id": part["doc_id"], "toxic": part["toxic"], "features": own})

    rows = sorted(sample.select("doc_id", "toxic", "text").mapInPandas(reduce, "doc_id long, toxic int, features array<int>").toLocalIterator(), key=lambda r: r["doc_id"])
    weights, bias = regress([r["features"] for r in rows], np.array([r["toxic"] for r in rows]), ratio)
    # The sample may hold another share of toxic documents than all labels do.
    bias += np.log(share / (1 - share)) - np.log(n1 / n0)
    return ToxicityModel(feature_of, weights, float(bias))


def regress(features: list[list[int]], y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty on ratio-scaled presence, by accelerated gradient descent."""
    n, m = len(y), len(ratio)
    owner = np.repeat(np.arange(n), [len(f) for f in features])
    feature = np.concatenate([np.asarray(f, dtype=np.int64) for f in features] + [np.zeros(0, np.int64)])
    scale = ratio / 3
    value = scale[feature]
    step = 1 / (np.mean(np.bincount(owner, weights=value**2, minlength=n)) + PENALTY)
    w = v = np.zeros(m)
    b = vb = float(np.log(y.sum() / (n - y.sum())))
    t = 1.0
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-np.clip(np.bincount(owner, weights=value * v[feature], minlength=n) + vb, -40, 40))) - y
        gradient = np.bincount(feature, weights=value * error[owner], minlength=m) / n + PENALTY * v
        next_w, next_b, next_t = v - step * gradient, vb - 2 * error.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = next_w + (t - 1) / next_t * (next_w - w), next_b + (t - 1) / next_t * (next_b - b)
        w, b, t = next_w, next_b, next_t
    return w * scale, b


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and score (0 to 1) for each row, and the columns named in ``keep``.

    Null and empty texts get the score of a text without any known n-gram. Null, equal and repeated doc_ids give a row
    each; an empty table gives none; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried, schema = beside(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            scores = shared.value.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), *batch.columns[2:]], names=["doc_id", "score", *batch.schema.names[2:]])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *carried)
    return renamed(rows.mapInArrow(run, SCORES + schema), keep)


def held_out(doc_id):
    """Documents whose labels are never learned from."""
    return doc_crc_mod(doc_id, 4) == 2


def judge_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``THRESHOLD`` on)."""
    model = fit(docs, labels, lambda doc_id: ~held_out(doc_id))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
