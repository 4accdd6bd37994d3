"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed character n-grams. Every language has several centroids, found by
spherical k-means among its sampled documents; the centroid with the largest cosine names the language. A text of few
distinct n-grams has a small cosine whatever its language, so a cosine is held against the usual one (the median) of
sampled documents with about as many. A text with a share of it far below that of nearly all documents of the language
is marked as rejected. Both are measured on sampled documents outside the half that the centroids come from. The model is fitted on a
bounded sample (``SAMPLE`` documents a language, ``SAMPLE_IN_ALL`` in all, expected numbers, chosen by hash of doc_id);
every document is classified whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import beside, doc_crc_mod, renamed, small_batches
from tidemark.llm.ngrams import hashed_ngrams, normalised

#: Sampled documents of each language, and of all languages together.
SAMPLE, SAMPLE_IN_ALL = 512, 8192
#: The commonest values of lang, which the model learns; rarer ones are taken for errors of the labels.
LANGUAGES = 256
SIZES, BITS = range(1, 5), 12
CENTROIDS, ROUNDS = 4, 12
#: A text is rejected if its share of the usual cosine is below ``REJECT_SHARE`` times the ``LOW`` quantile of its language.
REJECT_SHARE, LOW = 0.75, 0.05
#: Documents that a median or a quantile is taken of, at least; a language with fewer has the quantile of all languages.
ENOUGH = 20
UNKNOWN = "und"
PREDICTIONS = "doc_id long, lang_pred string, score double, rejected boolean"


def has_letter(text: str | None) -> bool:
    return next(filter(str.isalpha, text or ""), None) is not None


def gram_counts(texts: list[str | None]) -> np.ndarray:
    """A row of n-gram counts for each text."""
    starts, hashes = hashed_ngrams([normalised(t) for t in texts], SIZES, BITS)
    out = np.zeros((len(texts), 1 << BITS), dtype=np.float32)
    for h in hashes:
        for i in range(len(texts)):
            own = h[starts[i] : starts[i + 1]]
            out[i] += np.bincount(own, minlength=1 << BITS)
    out[:, 0] = 0
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]  # of each centroid
    sizes: np.ndarray  # log2 of numbers of distinct n-grams, rising
    usual: np.ndarray  # median cosine at each size
    floors: np.ndarray  # least share of the usual cosine, of each centroid


    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, cosine (0 to 1) and whether the text is rejected, for each text."""
        if not self.languages:
            return [(UNKNOWN, 0.0, not has_letter(t)) for t in texts]  # nothing is known to be far from
        counts = gram_counts(texts)
        cosines = unit(np.log1p(counts) * self.idf) @ self.centroids.T
        best = cosines.argmax(axis=1)
        least = self.floors[best] * usual_cosine(np.count_nonzero(counts, axis=1), self.sizes, self.usual)
        return [
            (self.languages[j], float(min(1.0, max(0.0, c[j]))), bool(c[j] < low)) if has_letter(t) else (UNKNOWN, 0.0, True)
            for t, c, j, low in zip(texts, cosines, best, least, strict=True)
        ]


def usual_cosine(grams: np.ndarray, sizes: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """The usual cosine at numbers of distinct n-grams; below the least size it falls with their square root, as that of a random part does."""
    size = np.log2(np.maximum(grams, 1))
    return np.interp(size, sizes, usual) * np.exp2(np.minimum(0.0, size - sizes[0]) / 2)


def usual_cosines(grams: np.ndarray, cosines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median size and cosine of each doubling of the number of distinct n-grams; doublings with few documents join the next."""
    size = np.log2(np.maximum(grams, 1))
    order = np.argsort(size, kind="stable")
    bands: list[np.ndarray] = []
    for band in np.split(order, np.flatnonzero(np.diff(np.floor(size[order]))) + 1):
        if bands and len(bands[-1]) < ENOUGH:
            bands[-1] = np.concatenate([bands[-1], band])
        else:
            bands.append(band)
    if len(bands) > 1 and len(bands[-1]) < ENOUGH:
        bands[-2:] = [np.concatenate(bands[-2:])]
    return np.array([np.median(size[b]) for b in bands]), np.array([np.median(cosines[b]) for b in bands])


def cosines_left_out(vectors: np.ndarray) -> np.ndarray:
    """The cosine of each vector with the nearest of the centroids that the other half of the vectors has."""
    out = np.zeros(len(vectors))
    for half in (0, 1):
        own = np.arange(len(vectors)) % 2 == half
        out[own] = (vectors[own] @ clusters(vectors[~own]).T).max(axis=1)
    return out


def clusters(vectors: np.ndarray) -> np.ndarray:
    """Centroids of the unit vectors by spherical k-means from farthest-first starts."""
    centroids = unit(vectors.mean(axis=0, keepdims=True))
    while len(centroids) < min(CENTROIDS, len(vectors)):
        centroids = np.vstack([centroids, vectors[(vectors @ centroids.T).max(axis=1).argmin()]])
    for _ in range(ROUNDS):
        own = (vectors @ centroids.T).argmax(axis=1)
        centroids = np.vstack([unit(vectors[own == k].mean(axis=0, keepdims=True)) if (own == k).any() else centroids[k : k + 1] for k in range(len(centroids))])
    return centroids


def fit(docs: DataFrame, learn_from=lambda doc_id: F.lit(True)) -> LanguageModel:
    """The model from text and lang of the rows with a language, a letter and a doc_id that satisfies ``learn_from``.

    Of more than ``LANGUAGES`` values of lang the commonest are learned.
    """
    known = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
        .filter("lang IS NOT NULL AND text IS NOT NULL").filter(learn_from(F.col("doc_id")))
    )
    totals = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not totals:
        return LanguageModel(np.ones(1 << BITS), np.zeros((0, 1 << BITS)), [], np.zeros(1), np.zeros(1), np.zeros(0))
    each = max(8, min(SAMPLE, SAMPLE_IN_ALL // len(totals)))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    rate = reduce(lambda c, x: c.when(F.col("lang") == x[0], F.lit(min(1.0, each / x[1]))), totals.items(), F.when(F.lit(False), F.lit(0.0)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            texts = batch.column(1).to_pylist()
            packed = [np.minimum(row, 65535).astype("<u2").tobytes() if has_letter(t) else None for row, t in zip(gram_counts(texts), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), batch.column(2)], names=["lang", "counts", "doc_id"])

    sample = known.filter(place < rate).select("lang", "text", "doc_id").mapInArrow(count, "lang string, counts binary, doc_id long").filter("counts IS NOT NULL")
    rows = sorted((tuple(r) for r in sample.toLocalIterator()), key=lambda r: (r[0], r[2] if r[2] is not None else -1, bytes(r[1])))
    if not rows:
        return LanguageModel(np.ones(1 << BITS), np.zeros((0, 1 << BITS)), [], np.zeros(1), np.zeros(1), np.zeros(0))
    counts = np.frombuffer(b"".join(bytes(r[1]) for r in rows), dtype="<u2").reshape(len(rows), -1)
    idf = (np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    vectors = unit(np.log1p(counts.astype(np.float32)) * idf)
    langs = np.array([r[0] for r in rows])
    parts = {lang: clusters(vectors[langs == lang]) for lang in sorted(totals) if (langs == lang).any()}
    centroids = np.vstack(list(parts.values())).astype(np.float32)
    languages = [lang for lang, c in parts.items() for _ in c]
    # Equal texts are measured once, and never against themselves; a language with one text has nothing to measure.
    once = np.array(sorted({(r[0], bytes(r[1])): i for i, r in reversed(list(enumerate(rows)))}.values()))
    once = np.concatenate([own for lang in parts if len(own := once[langs[once] == lang]) > 1] + [np.zeros(0, np.int64)])
    if not len(once):
        return LanguageModel(idf, centroids, languages, np.zeros(1), np.zeros(1), np.zeros(len(languages)))
    near = np.concatenate([cosines_left_out(vectors[once[langs[once] == lang]]) for lang in parts if (langs[once] == lang).any()])
    grams = np.count_nonzero(counts[once], axis=1)
    sizes, usual = usual_cosines(grams, near)
    share = near / np.maximum(usual_cosine(grams, sizes, usual), 1e-12)
    floors = {lang: REJECT_SHARE * np.quantile(own if len(own := share[langs[once] == lang]) >= ENOUGH else share, LOW) for lang in parts}
    return LanguageModel(idf, centroids, languages, sizes, usual, np.array([floors[lang] for lang in languages]))


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row, and the columns named in ``keep``.

    ``und``, 0 and rejected for a null text or one without a letter. Only the text is looked at; null, equal and
    repeated doc_ids give a row each, an empty table none, and other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried, schema = beside(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            found = list(zip(*shared.value.predict(batch.column(1).to_pylist()), strict=True))
            columns = [pa.array(c, k) for c, k in zip(found, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *batch.columns[2:]], names=["doc_id", "lang_pred", "score", "rejected", *batch.schema.names[2:]])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *carried)
    return renamed(rows.mapInArrow(run, PREDICTIONS + schema), keep)


def held_out(doc_id):
    """Documents whose languages are never learned from."""
    return doc_crc_mod(doc_id, 3) == 1


def judge_language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected."""
    model = fit(docs, lambda doc_id: ~held_out(doc_id))
    return identify(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
