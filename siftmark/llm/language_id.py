"""Language identification by nearest centroid.

A text is a TF-IDF vector of character n-grams (1 to 3 letters, word ends included), hashed into
`dims` places and normalised. Each language has several centroids, clusters of its training vectors by
spherical k-means, and a text gets the language of the centroid with the highest cosine. A text whose
cosine lies below what nearly all training texts of that language reach is marked as rejected.

Document frequencies are counted over all training documents, as partial sums per task. Centroids
are fitted on at most `max_docs` training documents of each language, the first by a hash of the id.

Defined results: null texts and texts without a letter are `und` with score 0; so is every text where no
training row has a language. Equal cosines go to the language that comes first by code point.
Repeated rows get equal results. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_CHUNK = 1 << 20


@dataclass(frozen=True)
class Settings:
    dims: int = 4096
    centroids: int = 4
    max_docs: int = 400
    rounds: int = 12
    reject_below: float = 0.005


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    least: np.ndarray


def counts(text: str | None, dims: int) -> np.ndarray | None:
    """Counts of hashed n-grams of a whole text; None without a letter."""
    letters = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    if not letters:
        return None
    total = np.zeros(dims, np.int64)
    padded = f" {letters} "
    for at in range(0, len(padded), _CHUNK):
        # Chunks overlap by two characters, so that each n-gram is counted in the chunk where it starts.
        codes = np.frombuffer(padded[at:at + _CHUNK + 2].encode("utf-32-le"), np.uint32).astype(np.uint64)
        n = min(_CHUNK, len(codes))
        hashes = codes * np.uint64(0x9E3779B97F4A7C15)
        for size in range(3):
            if size:
                keep = min(n, len(codes) - size)
                hashes = (hashes[:keep] ^ (hashes[:keep] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                hashes = hashes + codes[size:size + keep] * np.uint64(0x94D049BB133111EB + 2 * size)
            place = (hashes[:n] ^ (hashes[:n] >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            total += np.bincount((place >> np.uint64(40)).astype(np.int64) % dims, minlength=dims)
    return total


def vector(text: str | None, idf: np.ndarray) -> np.ndarray | None:
    found = counts(text, len(idf))
    if found is None:
        return None
    weighted = np.log1p(found) * idf
    norm = np.linalg.norm(weighted)
    return (weighted / norm if norm else weighted).astype(np.float32)


def _frequencies(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs = np.zeros(dims, np.int64), 0
        for batch in batches:
            for text in batch["text"].to_pylist():
                found = counts(text, dims)
                if found is not None:
                    seen += found > 0
                    docs += 1
        at = np.append(np.flatnonzero(seen), -1)
        yield pa.RecordBatch.from_pydict({"id": pa.array(at, pa.int64()), "n": pa.array(np.append(seen[at[:-1]], docs), pa.int64())})

    return run


def _cluster(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means; starts from the vectors farthest from those chosen before."""
    chosen = [x.mean(axis=0)]
    near = x @ chosen[0]
    starts = []
    for _ in range(min(k, len(x))):
        pick = int(np.argmin(near))
        starts.append(x[pick])
        near = np.maximum(near, x @ x[pick])
    centres = np.array(starts)
    for _ in range(rounds):
        owner = np.argmax(x @ centres.T, axis=1)
        sums = np.array([x[owner == j].sum(axis=0) if (owner == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centres.astype(np.float32)


def fit(training: DataFrame, settings: Settings = Settings()) -> Model:
    """training has doc_id, text and lang; rows without a language are left out."""
    spark = training.sparkSession
    rows = training.where("lang is not null")
    totals = rows.select("text").mapInArrow(_frequencies(settings.dims), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    seen = {r.id: r.n for r in totals.collect()}  # one row per place
    documents = seen.pop(-1, 0)
    frequency = np.zeros(settings.dims)
    for place, n in seen.items():
        frequency[place] = n
    idf = np.log((1 + documents) / (1 + frequency)) + 1

    # Ids are ranked without their texts; ranks above the limit are dropped before they are shuffled.
    order = F.xxhash64(F.lit("language"), "doc_id")
    ids = rows.select("doc_id", "lang").distinct()
    ids = ids.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(order, "doc_id"))).where(f"r <= {settings.max_docs}")
    ids = ids.select(F.col("doc_id").alias("d"), F.col("lang").alias("l"))
    sample = rows.join(F.broadcast(ids), (F.col("doc_id") == F.col("d")) & (F.col("lang") == F.col("l")))
    sample = sample.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    shared = spark.sparkContext.broadcast(idf)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(lang, vector(text, shared.value)) for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist())]
            found = [(lang, v) for lang, v in found if v is not None]
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([f[0] for f in found], pa.string()), "v": pa.array([f[1].tobytes() for f in found], pa.binary()),
            })

    def centres(key, group):
        x = np.array([np.frombuffer(v, np.float32) for v in group["v"]])
        found = _cluster(x, settings.centroids, settings.rounds)
        least = float(np.quantile((x @ found.T).max(axis=1), settings.reject_below))
        import pandas as pd

        return pd.DataFrame({"lang": key[0], "c": [c.tobytes() for c in found], "least": least})

    fitted = sample.select("lang", "text").mapInArrow(vectors, "lang string, v binary").groupBy("lang")
    got = sorted(fitted.applyInPandas(centres, "lang string, c binary, least double").collect(), key=lambda r: r.lang)
    languages = sorted({r.lang for r in got})
    place = {lang: i for i, lang in enumerate(languages)}
    return Model(
        idf, languages, np.array([place[r.lang] for r in got], int),
        np.array([np.frombuffer(r.c, np.float32) for r in got], np.float32).reshape(len(got), settings.dims),
        np.array([r.least for r in got]),
    )


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """keep, lang_pred, score (the cosine) and rejected for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep, "text")
    fields = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            langs, scores, rejected = [], [], []
            for text in batch["text"].to_pylist():
                v = vector(text, m.idf) if m.languages else None
                if v is None:
                    langs.append(UNKNOWN), scores.append(0.0), rejected.append(True)
                    continue
                cosines = m.centroids @ v
                best = int(np.argmax(cosines))
                langs.append(m.languages[m.owner[best]])
                scores.append(float(min(max(cosines[best], 0.0), 1.0)))
                rejected.append(bool(cosines[best] < m.least[best]))
            columns = [batch[c] for c in keep]
            columns += [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score", "rejected"])

    return kept.mapInArrow(run, f"{fields}, lang_pred string, score double, rejected boolean")
