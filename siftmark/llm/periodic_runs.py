"""Periodic runs of words, by difference-cover longest common extensions over a harmonic grid.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), at least
`exponent` periods and `shortest` words long, that no neighbouring word extends keeping the period.

1. Words become numbers that differ between documents, so a batch of documents is one array and no
   comparison leaves its document.
2. Suffixes at the places of a difference cover (period 32, about a third of all places) are sorted: by their
   first 32 words, then by doubling on the ranks of the place 32, 64, ... further on, which is in the cover
   too. The common prefixes of neighbours in this order make a sparse table for range minima.
3. The common extension of two places compares fewer than 32 words, up to the distance at which both places
   are in the cover, and then asks the table. The reversed array gives extensions to the left.
4. A run of period q with e periods holds (e - 1) q places whose word q further on is the same one. So for
   each q only the places divisible by (e - 1) q are tried, n/q in all, harmonic over the periods. Pairs of
   equal words are extended to both sides. Of equal stretches the smallest period stays.

A document is worked on as a whole; short ones go together in batches of bounded size. Memory is a few numbers
per word of the batch.

Defined results: null and empty texts have no words and no runs. Repeated rows give equal rows; an empty
table gives none. Only the columns named as keys are carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from siftmark.llm.common import let, words
from siftmark.llm.repeats import difference_cover

_COVER = 32  # period of the difference cover; even, as two words are compared at a time
_IN_COVER, _STEP = difference_cover(_COVER)
_PAIRS = 1 << 20  # pairs of places extended at once
_RUN = ("start", "length", "period")


@dataclass(frozen=True)
class Settings:
    shortest: int = 6
    exponent: int = 4
    batch: int = 1 << 19  # words of the documents worked on together


class Extensions:
    """Longest common extensions to the right between places of one array of numbers."""

    def __init__(self, values: np.ndarray):
        n = self.n = len(values)
        self.values = np.r_[values, np.full(_COVER, -1, np.int64)]
        self.places = np.flatnonzero(_IN_COVER[np.arange(n) % _COVER])
        self.index = np.full(n + 1, -1, np.int64)
        self.index[self.places] = np.arange(len(self.places))
        levels = self._sort()
        self.table = self._sparse(self._neighbours(levels))

    def _ranked(self, order: np.ndarray, changes: np.ndarray) -> np.ndarray:
        """The rank of each sample: the first place in the order of those that equal it so far."""
        starts = np.maximum.accumulate(np.where(changes, np.arange(len(order)), 0))
        rank = np.empty(len(order), np.int64)
        rank[order] = starts
        return rank

    def _refine(self, order: np.ndarray, rank: np.ndarray, key) -> tuple[np.ndarray, np.ndarray, bool]:
        """Order samples of equal rank by key(samples); the last says that ties were left before."""
        r = rank[order]
        same = np.zeros(len(order), bool)
        same[1:] = r[1:] == r[:-1]
        tied = np.flatnonzero(same | np.r_[same[1:], False])
        if not len(tied):
            return order, rank, False
        sub = order[tied]
        k = key(sub)
        by = np.lexsort((k, r[tied]))
        order = order.copy()
        order[tied] = sub[by]
        changes = ~same
        k, rt = k[by], r[tied]
        changes[tied[1:]] |= (k[1:] != k[:-1]) & (rt[1:] == rt[:-1])
        return order, self._ranked(order, changes), True

    def _sort(self) -> list[tuple[int, np.ndarray]]:
        """Sort the samples; (words, ranks by that many words) of each round, fewest first."""
        pair = lambda at: (self.values[at] + 1 << 31) | (self.values[at + 1] + 1)
        key = pair(self.places)
        order = np.argsort(key, kind="stable")
        rank = self._ranked(order, np.r_[True, key[order][1:] != key[order][:-1]][: len(order)])
        more = True
        for t in range(2, _COVER, 2):
            if more:
                order, rank, more = self._refine(order, rank, lambda s: pair(self.places[s] + t))
        levels = [(_COVER, rank)]
        while more:
            length, last = levels[-1]

            def behind(s):
                at = self.places[s] + length
                return np.where(at < self.n, last[self.index[np.minimum(at, self.n)]], -1)

            order, rank, more = self._refine(order, last, behind)
            if more:
                levels.append((2 * length, rank))
        self.order, self.rank = order, np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        return levels

    def _neighbours(self, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Words that each sample shares with the one before it in the order."""
        a, b = self.places[self.order[:-1]], self.places[self.order[1:]]
        shared = np.zeros(len(a), np.int64)
        for length, rank in reversed(levels):
            x, y = a + shared, b + shared
            fits = np.maximum(x, y) < self.n
            on = np.flatnonzero(fits)
            on = on[rank[self.index[x[on]]] == rank[self.index[y[on]]]]
            shared[on] += length
        on = np.arange(len(a))
        for _ in range(_COVER):
            x, y = a[on] + shared[on], b[on] + shared[on]
            on = on[(np.maximum(x, y) < self.n) & (self.values[np.minimum(x, self.n)] == self.values[np.minimum(y, self.n)])]
            if not len(on):
                break
            shared[on] += 1
        return np.r_[0, shared]

    def _sparse(self, shared: np.ndarray) -> list[np.ndarray]:
        table, width = [shared], 1
        while 2 * width <= len(shared):
            table.append(np.minimum(table[-1][: len(table[-1]) - width], table[-1][width:]))
            width *= 2
        return table

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that follow alike from the places a and b on, a < b."""
        far = _STEP[a % _COVER, b % _COVER]
        shared = np.zeros(len(a), np.int64)
        on = np.arange(len(a))
        for t in range(_COVER):
            at = on[far[on] > t]
            equal = self.values[np.minimum(a[at] + t, self.n)] == self.values[np.minimum(b[at] + t, self.n)]
            on = at[equal & (b[at] + t < self.n)]
            if not len(on):
                break
            shared[on] += 1
        at = np.flatnonzero((shared == far) & (b + far < self.n))
        x = self.rank[self.index[a[at] + far[at]]]
        y = self.rank[self.index[b[at] + far[at]]]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        level = np.frexp(high - low + 1)[1] - 1
        for k in np.unique(level).tolist():
            use = level == k
            row = self.table[k]
            shared[at[use]] += np.minimum(row[low[use]], row[high[use] - (1 << k) + 1])
        return shared


def _grid(values: np.ndarray, ends: np.ndarray, sizes: np.ndarray, settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) of grid places whose word is the same a period further on, in bounded blocks.

    Documents lie in the array by falling size, so those long enough for a period are a prefix.
    """
    found, periods, held = [], [], 0
    longest = int(sizes[0]) if len(sizes) else 0
    for q in range(1, longest // settings.exponent + 1):
        fitting = int(np.searchsorted(-sizes, -max(settings.shortest, settings.exponent * q), "right"))
        if not fitting:
            break
        end, step = int(ends[fitting - 1]), (settings.exponent - 1) * q
        at = np.flatnonzero(values[: end - q : step] == values[q:end:step]) * step
        if len(at):
            found.append(at)
            periods.append(np.full(len(at), q))
            held += len(at)
        if held >= _PAIRS:
            yield np.concatenate(found), np.concatenate(periods)
            found, periods, held = [], [], 0
    if held:
        yield np.concatenate(found), np.concatenate(periods)


def runs_of(texts: list[list[int]], settings: Settings = Settings()) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) by start, then period, of the runs of each list of numbers."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    by_size = sorted((i for i, t in enumerate(texts) if len(t) >= settings.shortest), key=lambda i: -len(texts[i]))
    if not by_size:
        return out
    sizes = np.array([len(texts[i]) for i in by_size])
    ends = np.cumsum(sizes)
    # Numbers of a document are below its length, so its place in the array sets them apart.
    values = np.concatenate([np.array(texts[i], np.int64) + (e - s) for i, e, s in zip(by_size, ends.tolist(), sizes.tolist())])
    n, right, left, best = len(values), None, None, {}
    for at, q in _grid(values, ends, sizes, settings):
        if right is None:
            right, left = Extensions(values), Extensions(values[::-1].copy())
        ahead = right.common(at, at + q)
        # Places before both, seen from the end: the later of the two comes first there.
        back = np.zeros(len(at), np.int64)
        has = np.flatnonzero(at > 0)
        back[has] = left.common(n - at[has] - q[has], n - at[has])
        start, length = at - back, back + ahead + q
        good = length >= np.maximum(settings.shortest, settings.exponent * q)
        for s, l, p in zip(start[good].tolist(), length[good].tolist(), q[good].tolist()):
            if best.get((s, l), p) >= p:
                best[s, l] = p
    owners = np.searchsorted(ends, [s for s, _ in best], "right").tolist()
    for (s, l), p, k in zip(best, best.values(), owners):
        out[by_size[k]].append((s - int(ends[k] - sizes[k]), l, p))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those that no run holds behind its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def _numbers(found: list[bytes]) -> list[int]:
    known = {w: i for i, w in enumerate(dict.fromkeys(found))}
    return [known[w] for w in found]


def _batch(rows: list[list[bytes]], settings: Settings) -> tuple[list, list[str]]:
    runs = runs_of([_numbers(r) for r in rows], settings)
    texts = []
    for found, own in zip(rows, runs):
        kept = [found[i] for i in np.flatnonzero(kept_words(len(found), own)).tolist()] if own else found
        texts.append(b" ".join(kept).decode())
    return runs, texts


def find_runs(docs: DataFrame, keys: list[str], text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """keys, n_words, runs (start and length in words, period) and collapsed, the words that stay joined by spaces."""
    rows = docs.select(F.struct(*[F.col(k) for k in keys]).alias("row"), F.col(text).cast("binary").alias("text"))
    kind = pa.list_(pa.struct([(name, pa.int64()) for name in _RUN]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(part, rows):
            runs, texts = _batch(rows, settings)
            found = pa.array([[dict(zip(_RUN, r)) for r in own] for own in runs], kind)
            counts = pa.array([len(r) for r in rows], pa.int64())
            return pa.RecordBatch.from_arrays([part, counts, found, pa.array(texts, pa.string())], names=["row", "n_words", "runs", "collapsed"])

        for batch in batches:
            held, size, first = [], 0, 0
            for i, value in enumerate(batch["text"]):
                held.append((value.as_py() or b"").split())
                size += len(held[-1])
                if size >= settings.batch:
                    yield done(batch["row"].slice(first, len(held)), held)
                    held, size, first = [], 0, i + 1
            if held:
                yield done(batch["row"].slice(first, len(held)), held)

    long = T.LongType()
    run = T.StructType([T.StructField(name, long) for name in _RUN])
    found = [T.StructField("n_words", long), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())]
    schema = T.StructType([rows.schema["row"], *found])
    return rows.mapInArrow(task, schema).select("row.*", "n_words", "runs", "collapsed")


def plant_period(text: Column, at: Column, period) -> Column:
    """The words of a text joined by spaces, where from word `at(n)` on the next `period(n)` words repeat to the end.

    at and period are functions of the number of words; a text without words stays empty.
    """

    def repeat(found: Column) -> Column:
        n = F.size(found).cast("long")

        def place(where: Column) -> Column:
            a, p = where["a"].cast("int"), where["p"].cast("int")
            rest = n.cast("int") - a
            cycle = F.flatten(F.array_repeat(F.slice(found, a + 1, p), F.ceil(rest / p).cast("int")))
            return F.array_join(F.concat(F.slice(found, F.lit(1), a), F.slice(cycle, F.lit(1), rest)), " ")

        return F.when(n > 0, let(F.struct(at(n).alias("a"), period(n, at(n)).alias("p")), place)).otherwise("")

    return let(words(text), repeat)
