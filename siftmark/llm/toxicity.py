"""Toxicity by class-conditional Kneser-Ney models.

Two word bigram models, toxic and ordinary, with discounts and shared backoff:

    P_c(w | h) = max(c(h, w) - D, 0) / c(h) + lambda_c(h) P_c(w)
    P_c(w)     = ((c(w) - D) / c + lambda P(w)) / Z_c

c(w) are continuation counts of a class (a word counts once per document and word before it, so a text that
repeats itself gains nothing), P(w) is the Kneser-Ney distribution of the continuation counts of all documents,
gathered by a distributed aggregation over every word of the corpus. lambda_c(h) is what the discounts leave and
Z_c the sum, so all probabilities sum to one. Expressions that a class has not seen go by the shared counts.

Discounts come from the counts of counts, as in modified Kneser-Ney smoothing, but for each frequency in the
corpus: among all words that are as frequent, chance alone gives so many a count like c(w), and so many have it.
The quotient f is the doubt: D = f c(w) of the count goes, and the shared count weighs lambda = f in its place,
though never less than the mass that an absolute discount would leave. What then lies within `spread` (a log
ratio) of the shared rate is the shared rate, as rates of words differ that much between languages and topics.
Rare expressions thus count as far as there are more of them than chance makes. Pairs of words are held against
both classes together and need a doubt of at most `pair_doubt`.

A document's evidence is the difference of its two log-likelihoods per expression, over its expressions and
`prior_length` more; a logistic curve of this one variable, fitted on training rows that no count has seen,
makes it a score.

Class counts come from at most `max_docs` training rows of each class, the first by a hash of the id; shared
counts cover all documents. The model that goes to the tasks holds the expressions whose classes differ.

Defined results: null and empty texts have no evidence and get the curve's value at 0. Without both
classes among the training rows every score is 0. Of several labels of one document the largest
counts; null labels are ignored. Repeated rows get equal scores. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from siftmark.llm.common import carried, drop_table, local_rows, materialise, restored

_WORD = re.compile(r"\w+")
_HELD = 1 << 17  # keys that a task counts before it passes them on
_SCALE = 0.01  # evidence beyond it counts by its logarithm
_EXACT = 64  # corpus counts below stand for themselves, higher ones in eighths of an octave


@dataclass(frozen=True)
class Settings:
    max_docs: tuple[int, int] = (12000, 4000)
    discount: float = 0.75  # of the shared counts
    spread: float = 0.75
    pair_spread: float = 1.0
    pair_doubt: float = 0.02
    prior_length: float = 10.0
    threshold: float = 0.7


@dataclass
class Model:
    """Log ratios toxic : ordinary. words and pairs hold those that differ from `rest` and from their word; contexts
    what a word before adds to all words that are no pair with it."""

    words: dict[str, float] = field(default_factory=dict)
    pairs: dict[tuple[str, str], float] = field(default_factory=dict)
    contexts: dict[str, float] = field(default_factory=dict)
    rest: float = 0.0
    prior_length: float = 10.0
    slope: float = 0.0
    shift: float = -math.inf

    def evidence(self, text: str | None) -> float:
        found = expressions(text)
        pairs, words, contexts, rest = self.pairs, self.words, self.contexts, self.rest
        total = 0.0
        for pair in found:
            value = pairs.get(pair)
            total += words.get(pair[1], rest) + contexts.get(pair[0], 0.0) if value is None else value
        return total / (len(found) + self.prior_length)


def expressions(text: str | None) -> set[tuple[str, str]]:
    """The distinct (word before, word) of a text; the first word follows an empty one."""
    words = _WORD.findall((text or "").lower())
    return set(zip(["", *words], words))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, settings: Settings) -> DataFrame:
    """At most max_docs rows of each class, each in part `fit` or not. docs holds training rows only."""
    truth = labels.where(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).alias("y"))
    # Only ids are joined and ranked; texts follow for the rows chosen.
    order = F.xxhash64(F.lit("toxicity"), "_id")
    labelled = docs.select(F.col("doc_id").alias("_id")).distinct().join(truth, "_id")
    # Each task keeps the first rows of its own, so no task sees all ids of a class.
    first, second = (labelled.where(F.col("y") == y).orderBy(order, "_id").limit(settings.max_docs[y]) for y in (0, 1))
    chosen = first.unionByName(second)
    chosen = chosen.select("_id", F.col("y").cast("int").alias("y"), (F.pmod(order, F.lit(4)) != 0).alias("fit"))
    # max_docs bounds the ids chosen; repeated rows of an id count once.
    rows = docs.select(F.col("doc_id").alias("d"), "text").join(F.broadcast(chosen), F.col("d") == F.col("_id"))
    return rows.groupBy(F.col("_id").alias("doc_id"), "y", "fit").agg(F.min("text").alias("text"))


def _counted(batches: Iterator[pa.RecordBatch], names: list[str], keys_of) -> Iterator[list[tuple[tuple, int]]]:
    """(key, count) of what keys_of finds in the rows, added up until there are `_HELD` keys."""
    counts: Counter = Counter()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for row in zip(*(part[n].to_pylist() for n in names)):
                counts.update(keys_of(*row))
                if len(counts) >= _HELD:
                    yield list(counts.items())
                    counts.clear()
    if counts:
        yield list(counts.items())


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("y", pa.int32()), ("h", pa.string()), ("w", pa.string()), ("n", pa.int64())])
    for found in _counted(batches, ["text", "y"], lambda text, y: [(y, h, w) for h, w in expressions(text)]):
        columns = [*zip(*(k for k, _ in found)), [n for _, n in found]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _corpus_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Continuation counts of all words, added up in each task."""
    for found in _counted(batches, ["text"], lambda text: [w for _, w in expressions(text)]):
        yield pa.RecordBatch.from_pydict({"w": pa.array([w for w, _ in found], pa.string()), "n": pa.array([n for _, n in found], pa.int64())})


def count_class(n: Column) -> Column:
    """Counts below 5 stand for themselves, higher ones in half octaves."""
    return F.when(n < 5, n).otherwise(F.floor(2 * F.log2(n / 4)) + 4).cast("int")


def corpus_class(n: Column) -> Column:
    return F.when(n < _EXACT, n).otherwise(F.floor(8 * F.log2(n / _EXACT)) + _EXACT).cast("int")


def _count_class(n: np.ndarray) -> np.ndarray:
    return np.where(n < 5, n, np.floor(2 * np.log2(np.maximum(n, 1) / 4)) + 4).astype(int)


def expected_cells(classes: list[tuple[int, float, float]], log_chance) -> Counter:
    """(count class, corpus class) -> words expected by chance; classes are (corpus class, expected count, words).

    log_chance(counts, i) gives the log probability of counts for the class at i. Counts are near their expectation
    where that is large, so there one cell takes them all.
    """
    out: Counter = Counter()
    for i, (cell, e, words) in enumerate(classes):
        if e <= 0:
            continue
        if e >= 200:
            out[int(_count_class(np.array([e]))[0]), cell] += words
            continue
        reach = 8 * math.sqrt(e)
        counts = np.arange(max(0, int(e - reach - 8)), int(e + reach + 12) + 1)
        chances = words * np.exp(log_chance(counts, i))
        for k, v in zip(_count_class(counts).tolist(), chances.tolist()):
            out[k, cell] += v
    return out


def _log_factorial(n: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(x + 1) for x in np.atleast_1d(n).tolist()])


def _doubts(expected: Counter, seen: dict[tuple[int, int], int]) -> list[tuple[int, int, float]]:
    """(count class, corpus class, share of such counts that chance makes)."""
    return [(k, b, min(1.0, (expected[k, b] + 0.5) / (n + 0.5))) for (k, b), n in seen.items()]


def _seen_cells(rows: DataFrame, count: str) -> dict[tuple[int, int], int]:
    cells = rows.where(F.col(count) > 0).groupBy(count_class(F.col(count)).alias("k"), "b").agg(F.count("*").alias("n"))
    return {(r.k, r.b): r.n for r in cells.collect()}  # few classes


def _moved(
    rows: DataFrame, count: str, expected: Column, doubts: list[tuple[int, int, float]], spread: float, most_doubt: float, least: float, out: str,
) -> DataFrame:
    """Adds how far a count moves its expectation once it is discounted."""
    known = local_rows(rows.sparkSession, doubts, "_k int, _b int, doubt double")
    joined = rows.join(known, (count_class(F.col(count)) == F.col("_k")) & (F.col("b") == F.col("_b")), "left")
    doubt = F.coalesce("doubt", F.lit(1.0))
    rate = F.greatest((1 - doubt) * F.col(count) + doubt * expected, F.lit(least) * expected)
    holds = (doubt <= most_doubt) & (F.abs(F.log(rate / expected)) > spread)
    return joined.withColumn(out, F.when(holds, rate - expected).otherwise(0.0)).drop("_k", "_b", "doubt")


def fit(docs: DataFrame, training: DataFrame, settings: Settings = Settings()) -> Model:
    """Class counts from the training sample, shared counts from all docs, the curve from the rest of the sample."""
    model = Model(prior_length=settings.prior_length)
    sample = training.where("fit").select("text", "y")
    grams = sample.mapInArrow(_sample_counts, "y int, h string, w string, n long")
    pairs = grams.groupBy("h", "w").agg(*[F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(f"c{y}") for y in (0, 1)])
    pairs = materialise(pairs, "toxicity-pairs")
    both = [F.sum(c).alias(c) for c in ("c0", "c1")]
    words = pairs.groupBy("w").agg(*both)
    sizes = pairs.agg(*both).first()
    if not sizes.c0 or not sizes.c1:
        return model
    sizes = (float(sizes.c0), float(sizes.c1))

    # The shared backoff: continuation counts of every word of the corpus.
    shared = docs.select("text").mapInArrow(_corpus_counts, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    shared = materialise(shared, "toxicity-shared")
    classes = shared.groupBy(corpus_class(F.col("n")).alias("b")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()
    kinds, total = sum(r.words for r in classes), float(sum(r.n for r in classes) or 1)
    d = settings.discount
    rate = lambda n: (F.greatest(n - d, F.lit(0.0)) + d * kinds / (kinds + 1)) / total
    mean_rate = lambda r: (max(r.n / r.words - d, 0) + d * kinds / (kinds + 1)) / total

    rows = words.join(shared.withColumnRenamed("w", "v"), F.col("w") == F.col("v"), "left").drop("v")
    rows = rows.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("b", corpus_class(F.col("n"))).withColumn("rate", rate(F.col("n")))
    rows = materialise(rows, "toxicity-words")
    told = rows
    for y in (0, 1):
        cells = [(r.b, sizes[y] * mean_rate(r), r.words) for r in classes]
        poisson = lambda c, i: c * math.log(cells[i][1]) - cells[i][1] - _log_factorial(c)
        seen = _seen_cells(rows, f"c{y}")
        for r in classes:  # the words of the corpus that the class has not seen
            seen[0, r.b] = r.words - sum(n for (k, b), n in seen.items() if k and b == r.b)
        doubts = _doubts(expected_cells(cells, poisson), seen)
        mass = d * rows.where(f"c{y} > 0").count() / sizes[y]
        told = _moved(told, f"c{y}", sizes[y] * F.col("rate"), doubts, settings.spread, 1.0, min(mass, 1.0), f"x{y}")
    told = materialise(told, "toxicity-told")
    left = told.agg(F.sum("x0").alias("x0"), F.sum("x1").alias("x1")).first()
    whole = (1 + left.x0 / sizes[0], 1 + left.x1 / sizes[1])
    chance = lambda y: (F.col(f"x{y}") / sizes[y] + F.col("rate")) / whole[y]  # P_y(w)
    model.rest = math.log(whole[0] / whole[1])
    apart = told.where("x0 <> 0 OR x1 <> 0").select("w", F.log(chance(1) / chance(0)).alias("ratio"))
    model.words = {r.w: r.ratio for r in apart.toLocalIterator()}  # bounded by the sample

    _fit_pairs(model, pairs, told, chance, settings)
    for used in (shared, rows):
        drop_table(used)
    _fit_curve(model, training.where("not fit").select("text", "y"))
    return model


def _fit_pairs(model: Model, pairs: DataFrame, words: DataFrame, chance, settings: Settings) -> None:
    """Pairs that a class has more often than both together make likely, and what they leave to other pairs."""
    contexts = pairs.groupBy(F.col("h").alias("k")).agg(F.sum("c0").alias("o0"), F.sum("c1").alias("o1"))
    rows = pairs.join(contexts, F.col("h") == F.col("k")).drop("k").withColumn("n", F.col("c0") + F.col("c1"))
    rows = rows.withColumn("b", corpus_class(F.col("n")))
    share = F.round(F.col("o1") / (F.col("o0") + F.col("o1")), 3)
    groups = rows.groupBy("n", "b", share.alias("p")).agg(F.count("*").alias("words")).collect()  # few numbers
    told = rows
    for y in (0, 1):
        at = [(r.b, r.n * (r.p if y else 1 - r.p), r.words) for r in groups]

        def binomial(c, i):
            n, p = groups[i].n, min(max(groups[i].p if y else 1 - groups[i].p, 1e-6), 1 - 1e-6)
            inside = np.minimum(c, n)
            log = math.lgamma(n + 1) - _log_factorial(inside) - _log_factorial(n - inside) + inside * math.log(p) + (n - inside) * math.log(1 - p)
            return np.where(c <= n, log, -np.inf)

        doubts = _doubts(expected_cells(at, binomial), _seen_cells(rows, f"c{y}"))
        expected = F.greatest(F.col(f"o{y}") * F.col("n") / (F.col("o0") + F.col("o1")), F.lit(1e-9))
        told = _moved(told, f"c{y}", expected, doubts, settings.pair_spread, settings.pair_doubt, 1.0, f"x{y}")
    told = told.where("x0 > 0 OR x1 > 0").select("h", "w", *[(F.col(f"x{y}") / F.col(f"o{y}")).alias(f"p{y}") for y in (0, 1)])
    told = materialise(told.fillna(0.0, ["p0", "p1"]), "toxicity-told-pairs")
    base = words.select(F.col("w").alias("v"), *[chance(y).alias(f"u{y}") for y in (0, 1)])
    gone: dict[str, list[float]] = {}
    found = told.join(base, F.col("w") == F.col("v")).collect()  # bounded by the sample
    for r in found:
        sums = gone.setdefault(r.h, [0.0, 0.0])
        sums[0] += r.p0
        sums[1] += r.p1
    left = {h: [max(1 - g, 1e-6) for g in sums] for h, sums in gone.items()}
    model.contexts = {h: math.log(b / a) for h, (a, b) in left.items()}
    model.pairs = {(r.h, r.w): math.log((r.p1 + left[r.h][1] * r.u1) / (r.p0 + left[r.h][0] * r.u0)) for r in found}


def _fit_curve(model: Model, rows: DataFrame) -> None:
    """Logistic regression on the one variable, by Newton steps with a small penalty on the slope."""
    got = _with_evidence(rows.sparkSession.sparkContext.broadcast(model), carried(rows)).select("row.y", "evidence").toPandas()
    x, y = np.arcsinh(got["evidence"].to_numpy(float) / _SCALE), got["y"].to_numpy(float)
    scale = x.std() or 1.0
    z = np.column_stack([x / scale, np.ones(len(x))])
    beta, penalty = np.array([1.0, 0.0]), np.diag([1e-2, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (y - p) - penalty @ beta
        hessian = (z * (p * (1 - p))[:, None]).T @ z + penalty
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.shift = float(max(beta[0], 0) / scale), float(beta[1])


def _with_evidence(model, rows: DataFrame) -> DataFrame:
    """row, text and the evidence of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [model.value.evidence(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["text"], pa.array(values, pa.float64())], names=["row", "text", "evidence"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("evidence", T.DoubleType())]))


def _curve(model: Model) -> Column:
    bent = F.asinh(F.col("evidence") / _SCALE)  # a few very toxic texts do not set the slope
    return 1 / (1 + F.exp(-(F.lit(model.slope) * bent + F.lit(max(model.shift, -700.0)))))


def score(docs: DataFrame, model: Model, keep: list[str], threshold: float = 0.7) -> DataFrame:
    """keep, evidence, score and predicted for every row."""
    keep = [c for c in keep if c not in ("evidence", "score", "predicted")]
    narrow = carried(docs.select(*dict.fromkeys([*keep, "text"])))
    rows = _with_evidence(docs.sparkSession.sparkContext.broadcast(model), narrow)
    value = _curve(model)
    made = rows.withColumn("value", value)
    plain = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in keep]
    return made.select(*plain, "evidence", F.col("value").alias("score"), (F.col("value") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score below the threshold, whatever other columns they have."""
    rows = _with_evidence(docs.sparkSession.sparkContext.broadcast(model), carried(docs))
    return restored(rows.where(_curve(model) < threshold), docs.columns)
