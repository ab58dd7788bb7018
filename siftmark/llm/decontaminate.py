"""Benchmark decontamination by latent semantic retrieval.

Benchmark items become passages of at most `item_words` words, taken in blocks of `block`. For each block a
TF-IDF matrix of its passages and of a sample of corpus passages is factorised by a distributed randomised
SVD: tasks multiply their rows with the range and add up what they find per word; the range is made orthonormal
by the eigenvectors of its small Gram matrix, and this repeats. All documents are then cut into overlapping
windows, whose cosines with the block's passages, both projected on the latent space, choose candidates. As the
rank exceeds the block and its rows weigh most, the space holds nearly all of every query (see the test of
recall against exact cosines). Several blocks are searched in one pass, one after another in each task.
A candidate counts as a leak if the longest common subsequence covers `lcs` of the passage's words, or
`lcs_paraphrase` of them and the answer (column `answer`, else the last sentence) is there too.

Document frequencies are counted once, for all words of all documents. A block's vocabulary are its own words and
the frequent ones, which `common` of all documents hold; so they are at most 1 / `common` times the mean number of
distinct words of a document. Sampled for the fit of the space only: `sample_docs` documents, the first by a hash of
the id, with at most `per_doc` windows each. What goes to tasks is bounded by vocabulary, blocks of a pass and rank.

Defined results: null and empty texts and items have no leaks. Repeated documents give repeated rows, items
that repeat an id count as that item. Empty tables give no rows. Ties in cosine do not matter, as every
candidate is checked.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from siftmark.llm.common import carried, drop_table, materialise, ranked, restored

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?\n]+")
_BETWEEN = bytes(i if chr(i).isalnum() or chr(i) == "_" else 32 for i in range(256))  # what \w is not, as blanks


_GROUPS = 16  # of the passages of a block, for the test before their scores


@dataclass(frozen=True)
class Settings:
    half: int = 12
    item_words: int = 64
    block: int = 256
    blocks_per_pass: int = 4
    common: float = 1 / 500
    task_words: int = 1 << 18
    rank: int = 288
    rounds: int = 2
    sample_docs: int = 2000
    per_doc: int = 4
    weight: float = 10.0
    cosine: float = 0.2
    lcs: float = 0.75
    lcs_paraphrase: float = 0.6
    answer: float = 0.8
    seed: int = 7
    fit_tasks: int = 4


@dataclass
class Index:
    """What a task needs: per word its row of projected queries and its weight, and the passages to check."""

    vocabulary: dict[str, int]
    rows: np.ndarray
    idf: np.ndarray
    passages: list[tuple[int, list[str], list[str]]]

    def __post_init__(self):
        starts = np.linspace(0, self.rows.shape[1], min(_GROUPS, self.rows.shape[1]), endpoint=False).astype(int)
        self.groups = np.maximum(np.maximum.reduceat(self.rows, starts, axis=1), 0)  # what a word can add to a score with a group of passages
        self.squares = np.append(self.idf**2, 0)


def words_of(text: str | None) -> list[str]:
    """The lower-cased runs of word characters."""
    low = (text or "").lower()
    try:  # the same, several times faster
        return low.encode("latin-1").translate(_BETWEEN).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(low)


def passages_of(text: str, answer: str | None, most: int) -> list[tuple[list[str], list[str]]]:
    """(words, answer words) of the passages of an item; long items overlap by half."""
    words = words_of(text)
    last = [s for s in (words_of(s) for s in _SENTENCE.split(text)) if s]
    told = words_of(answer) or (last[-1] if len(last) > 1 else words[-max(1, len(words) // 3):])
    if len(words) <= most:
        return [(words, told)] if words else []
    return [(words[at:at + most], told if at + most >= len(words) else words[at:at + most][-max(1, most // 3):])
            for at in range(0, len(words) - most // 2, most // 2)]


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; the bits of one integer are a row of the table."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        match = places.get(w)
        if match:
            both = row & match
            row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


def _doc_counts(most: int):
    """(w, n): the documents of the task that hold each word, in pieces of about `most` words; "" stands for all documents."""

    def piece(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"w": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in batches:
            counts[""] += batch.num_rows
            for text in batch["text"]:
                counts.update(set(words_of(text.as_py())))
                if len(counts) >= most:
                    yield piece(counts)
                    counts = Counter()
        yield piece(counts)

    return run


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = {w for text in batch["text"].to_pylist() for w in words_of(text)}
        yield pa.RecordBatch.from_pydict({"w": pa.array(list(found), pa.string())})


def word_counts(docs: DataFrame, settings: Settings) -> tuple[DataFrame, int]:
    """(w, n) of all words of all documents, and the number of documents."""
    counts = docs.select("text").mapInArrow(_doc_counts(settings.task_words), "w string, n long")
    counts = materialise(counts.groupBy("w").agg(F.sum("n").alias("n")), "decontaminate-counts")
    documents = counts.where("w = ''").agg(F.sum("n")).first()[0] or 0
    return counts.where("w != ''"), documents


def frequent_words(counts: DataFrame, documents: int, settings: Settings) -> list[str]:
    """Words that a share of `common` of all documents hold, three at least."""
    frequent = counts.where(F.col("n") >= max(3, math.ceil(settings.common * documents)))
    return sorted(r.w for r in frequent.select("w").toLocalIterator())


def frequencies(counts: DataFrame, items: DataFrame, frequent: list[str]) -> DataFrame:
    """(w, n) of the words of all items and of the frequent ones, as far as documents hold them."""
    words = items.select("text").mapInArrow(_item_words, "w string")
    words = words.unionAll(items.sparkSession.createDataFrame([(w,) for w in frequent], "w string")).distinct()
    return materialise(counts.join(words, "w", "left_semi"), "decontaminate-frequencies")


def _row(words: list[str], vocabulary: dict[str, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse TF-IDF row of unit length."""
    ids = np.array([i for i in map(vocabulary.get, words) if i], np.int64)
    ids, tf = np.unique(ids, return_counts=True)
    values = tf * idf[ids]
    norm = np.linalg.norm(values)
    return ids, values / norm if norm else values


def _products(shared, scale_of):
    """For each task: the sum over its rows of row^T (row Q), as one vector per word that occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, idf, q = shared.value
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for words, weight in zip(batch["words"].to_pylist(), batch["weight"].to_pylist()):
                ids, values = _row(words, vocabulary, idf)
                if len(ids):
                    values = (values * weight).astype(np.float32)
                    y = values @ q[ids]
                    if scale_of == "gram":
                        total[0] = total.get(0, 0) + np.outer(y, y)
                    else:
                        for i, v in zip(ids, values):
                            total[i] = total.get(i, 0) + v * y
        keys = list(total)
        yield pa.RecordBatch.from_pydict({
            "id": pa.array(keys, pa.int64()), "v": pa.array([np.asarray(total[k], np.float32).ravel().tobytes() for k in keys], pa.binary()),
        })

    return run


def _summed(parts: DataFrame, out: np.ndarray) -> None:
    """Put the sums of the vectors of each id into the rows of out: added up per partition of the ids, then read one
    by one, so that the driver holds no second copy."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch["id"].to_pylist(), batch["v"].to_pylist()):
                total[i] = total.get(i, 0) + np.frombuffer(v, np.float32)
        keys = list(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(keys, pa.int64()), "v": pa.array([total[k].tobytes() for k in keys], pa.binary())})

    # Written out, so that the shuffle files of a round go with it; bounded by vocabulary and rank.
    rows = materialise(parts.repartition("id").mapInArrow(add, "id long, v binary"), "decontaminate-round")
    for r in rows.toLocalIterator():
        out[r.id] = np.frombuffer(r.v, np.float32)
    drop_table(rows)


def _orthonormal(z: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns of a tall matrix, from the eigenvectors of its Gram matrix."""
    gram = np.zeros((z.shape[1], z.shape[1]))
    for at in range(0, len(z), 4096):
        part = z[at:at + 4096].astype(float)
        gram += part.T @ part
    values, vectors = np.linalg.eigh(gram)
    held = values > 1e-12 * max(values.max(), 1e-30)
    turn = (vectors[:, held] / np.sqrt(values[held])).astype(np.float32)
    return z @ turn


def latent_space(rows: DataFrame, vocabulary: dict[str, int], idf: np.ndarray, settings: Settings) -> np.ndarray:
    """Right singular vectors (words x rank) of the weighted TF-IDF rows: words array, weight double."""
    spark, d = rows.sparkSession, len(idf)
    q = np.random.default_rng(settings.seed).standard_normal((d, min(settings.rank, d)), np.float32)
    for _ in range(settings.rounds + 1):
        shared = spark.sparkContext.broadcast((vocabulary, idf, q))
        z = np.zeros_like(q)
        del q
        _summed(rows.mapInArrow(_products(shared, "range"), "id long, v binary"), z)
        shared.destroy()
        if not z.any():
            return np.zeros((d, 1), np.float32)
        q = _orthonormal(_orthonormal(z))  # the second time mends what rounding left
        del z
    shared = spark.sparkContext.broadcast((vocabulary, idf, q))
    gram = np.zeros((1, q.shape[1] ** 2), np.float32)
    _summed(rows.mapInArrow(_products(shared, "gram"), "id long, v binary"), gram)
    shared.destroy()
    values, vectors = np.linalg.eigh(gram.reshape(q.shape[1], -1).astype(float))
    return q @ vectors[:, values > 1e-9 * max(values.max(), 1e-30)].astype(np.float32)


def _sample(docs: DataFrame, settings: Settings) -> DataFrame:
    """Windows of a bounded sample of documents."""
    order = F.xxhash64(F.lit(settings.seed), "doc_id")
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(order, "doc_id").limit(settings.sample_docs)
    narrow = docs.select("doc_id", "text")
    chosen = narrow.join(F.broadcast(ids.withColumnRenamed("doc_id", "d")), F.col("doc_id") == F.col("d")).select("doc_id", "text")
    chosen = chosen.groupBy("doc_id").agg(F.min("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 2 * settings.half
        for batch in batches:
            found = []
            for text in batch["text"].to_pylist():
                words = words_of(text)
                step = max(size, len(words) // settings.per_doc)
                found += [words[at:at + size] for at in range(0, len(words), step)][:settings.per_doc]
            yield pa.RecordBatch.from_pydict({"words": pa.array(found, pa.list_(pa.string()))})

    return chosen.mapInArrow(cut, "words array<string>")


def build_index(
    sample: DataFrame, passages: list[tuple[int, list[str], list[str]]], frequent: list[str], known: DataFrame, documents: int, settings: Settings,
) -> Index:
    """Latent space of a block of passages and the corpus sample, with the passages projected on it.

    known has the document frequencies (w, n) of all words.
    """
    spark = sample.sparkSession
    own = sorted({w for _, words, _ in passages for w in words})
    vocabulary = {w: i + 1 for i, w in enumerate(dict.fromkeys([*own, *frequent]))}
    df = np.zeros(len(vocabulary) + 1)
    wanted = spark.createDataFrame([(w, i) for w, i in vocabulary.items()], "v string, id long")
    for r in known.join(wanted, F.col("w") == F.col("v")).select("id", "n").toLocalIterator():  # bounded by the vocabulary
        df[r.id] = r.n
    idf = np.log((1 + documents) / (1 + df)) + 1e-3
    idf[0] = np.median(idf[1:])

    weighted = [(words, settings.weight) for _, words, _ in passages]
    rows = spark.createDataFrame(weighted, "words array<string>, weight double")
    # The sample is bounded, and a task sends each word that it has met once, so few tasks do.
    rows = rows.unionByName(sample.select("words", F.lit(1.0).alias("weight"))).coalesce(settings.fit_tasks)
    space = latent_space(rows, vocabulary, idf, settings)
    # Score of a word with a passage: its weight times the passage projected on the space and back.
    coordinates = np.zeros((space.shape[1], len(passages)), np.float32)
    for i, (_, words, _) in enumerate(passages):
        ids, values = _row(words, vocabulary, idf)
        coordinates[:, i] = values.astype(np.float32) @ space[ids]
    projected = space @ coordinates
    projected *= idf[:, None].astype(np.float32)
    projected[0] = 0
    # Words that the queries do not use have rows of rounding errors only.
    used = np.abs(projected).max(axis=1) > 1e-6 * max(np.abs(projected).max(), 1e-30)
    used[0] = False
    keep = np.flatnonzero(used)
    place = np.zeros(len(idf), np.int64)
    place[keep] = np.arange(1, len(keep) + 1)
    extra = {w: int(place[i]) for w, i in vocabulary.items()}
    # Unused words keep their weight for the norm: negative numbers count past the used ones.
    rest = np.flatnonzero(~used)[1:]
    order = {i: len(keep) + 1 + k for k, i in enumerate(rest)}
    extra = {w: order.get(vocabulary[w], p) if p == 0 else p for w, p in extra.items()}
    all_idf = np.concatenate([[idf[0]], idf[keep], idf[rest]])
    matrix = np.vstack([np.zeros((1, len(passages)), np.float32), projected[keep]])
    return Index(extra, matrix, all_idf, passages)


def _windows(blocks: np.ndarray) -> np.ndarray:
    """A window is two blocks, or the only one."""
    return blocks[:-1] + blocks[1:] if len(blocks) > 1 else blocks


def candidates(words: list[str], index: Index, settings: Settings) -> list[tuple[int, int, float]]:
    """(window, passage, cosine) of the windows of a text that come near a passage in the latent space."""
    half, n = settings.half, len(words)
    ids = np.full((-(-n // half), half), len(index.squares) - 1, np.int64)  # the last block is filled up with nothing
    ids.ravel()[:n] = np.fromiter(map(index.vocabulary.get, words, repeat(0)), np.int64, n)
    limit = settings.cosine * np.sqrt(np.maximum(_windows(index.squares[ids].sum(axis=1)), 1e-12))
    used = np.where(ids < len(index.rows), ids, 0)
    # Windows whose words could not reach the limit with any passage of any group need no scores.
    most = np.concatenate([index.groups[used[lo:lo + 4096]].sum(axis=1) for lo in range(0, len(used), 4096)])
    possible = np.flatnonzero(_windows(most).max(axis=1) >= limit * (1 - 1e-4))
    hits = []
    for lo in range(0, len(possible), 1024):  # bounded memory for very long texts
        some = possible[lo:lo + 1024]
        need = np.unique(np.concatenate([some, np.minimum(some + 1, len(ids) - 1)]))
        scores = index.rows[used[need]].sum(axis=1)
        place = np.searchsorted(need, some)
        full = scores[place] + scores[place + 1] if len(ids) > 1 else scores
        windows, found = np.nonzero(full >= limit[some, None])
        cosines = full[windows, found] / limit[some[windows]] * settings.cosine
        hits += zip(some[windows].tolist(), found.tolist(), cosines.tolist())
    return hits


def leaks(text: str | None, indices: list[Index], settings: Settings) -> list[tuple[int, float, float]]:
    """(item, cosine, share of the longest common subsequence) of the items that the text gives away."""
    words = words_of(text)
    best: dict[int, tuple[float, float]] = {}
    half = settings.half
    for index in indices if words else ():
        for window, j, cosine in candidates(words, index, settings):
            item, passage, answer = index.passages[j]
            if item in best:
                continue
            lo, hi = window * half - len(passage), window * half + 2 * half + len(passage)
            region = words[max(0, lo):hi]
            there = set(region)
            # No subsequence is longer than the number of words that are there at all.
            if sum(map(there.__contains__, passage)) < min(settings.lcs, settings.lcs_paraphrase) * len(passage):
                continue
            share = common_subsequence(passage, region) / len(passage)
            told = share >= settings.lcs
            if not told and share >= settings.lcs_paraphrase:
                told = sum(w in there for w in answer) >= settings.answer * len(answer)
            if told:
                best[item] = (cosine, share)
    return [(item, *v) for item, v in sorted(best.items())]


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, text, answer and rank of the items that have a text."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select("item_id", F.col("text").alias("text"), answer.alias("answer")).where("text is not null")
    return ranked(items, "benchmark", F.col("item_id"), F.col("text"))


def _blocks(items: DataFrame, settings: Settings) -> Iterator[list[tuple[int, list[str], list[str]]]]:
    """Passages of the benchmark, a block at a time."""
    # Numbered items are read in portions; one portion at a time is on the driver.
    total, portion = items.count(), settings.block
    for first in range(1, total + 1, portion):
        rows = items.where(F.col("rank").between(first, first + portion - 1)).orderBy("rank").collect()
        passages = [(r.item_id, words, told) for r in rows for words, told in passages_of(r.text, r.answer, settings.item_words)]
        for at in range(0, len(passages), settings.block):
            yield passages[at:at + settings.block]


def _indices(docs: DataFrame, benchmark: DataFrame, settings: Settings) -> Iterator[list[Index]]:
    """The indices of the blocks, as many at a time as one pass over the documents searches."""
    sample = materialise(_sample(docs, settings), "decontaminate-sample")
    items = _items(benchmark)
    counts, documents = word_counts(docs, settings)
    frequent = frequent_words(counts, documents, settings)
    known = frequencies(counts, items, frequent)
    held: list[Index] = []
    for block in _blocks(items, settings):
        held.append(build_index(sample, block, frequent, known, documents, settings))
        if len(held) == settings.blocks_per_pass:
            yield held
            held = []
    if held:
        yield held


_FOUND = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("lcs", T.DoubleType())]))


def _scan(rows: DataFrame, indices: list[Index], settings: Settings) -> DataFrame:
    """row, text and the leaks of each of the rows (row, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(indices)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [{"item_id": i, "cosine": c, "lcs": s} for i, c, s in leaks(text, shared.value, settings)]
                for text in (t.as_py() for t in batch["text"])
            ]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["text"], pa.array(found, kind)], names=["row", "text", "leaks"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("leaks", _FOUND)]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, item_id, cosine and lcs of every leak."""
    found = None
    rows = docs.select(F.struct("doc_id").alias("row"), "text")
    for indices in _indices(docs.select("doc_id", "text"), benchmark, settings):
        pairs = _scan(rows, indices, settings).select("row.doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*")
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, cosine double, lcs double")
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs that give no item away, whatever other columns they have."""
    kept = carried(docs)
    for indices in _indices(docs.select("doc_id", "text"), benchmark, settings):
        kept = _scan(kept, indices, settings).where(F.size("leaks") == 0).select("row", "text")
    return restored(kept, docs.columns)
