"""Jobs whose outcome depends on the events of a key in order.

Result reuse carries a state from one event of a key to the next. To keep a hot key off a
single task, every key is cut into time slices:

1. each (key, slice) is reduced to a short description of what it does to any
   incoming state, in parallel;
2. per key the descriptions are run through in order, which gives the state at the
   start of every slice; this touches a few numbers per slice;
3. each (key, slice) is evaluated from its own start state, in parallel.

All three read sorted rows in Arrow batches and keep at most `_PART` events. Times
are whole numbers, so the outcome does not depend on the cutting.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from siftmark.plans.slices import micros

_PART = 1 << 17
_SUMMARY = "a long, b long, c long, d long, e long, f long, xs array<long>, ys array<long>"
State = tuple[int, int] | None


@dataclass(frozen=True)
class Reuse:
    """A result stored at an event serves the key's events up to and including ttl later."""

    ttl_us: int

    def summarise(self, t: np.ndarray) -> tuple:
        """For every possible first miss: the last store it leads to, as runs of equal outcome."""
        n = len(t)
        nxt = np.searchsorted(t, t + self.ttl_us, side="right")
        jump = np.where(nxt < n, nxt, np.arange(n))
        while True:  # pointer doubling along the chains of misses
            further = jump[jump]
            if np.array_equal(further, jump):
                break
            jump = further
        out = t[jump]
        ends = np.flatnonzero(np.append(out[1:] != out[:-1], True))
        return 0, int(t[0]), int(t[-1]), 0, 0, 0, t[ends], out[ends]

    def matters(self, state: State, first: int) -> bool:
        return first <= state[0] + self.ttl_us

    def advance(self, state: State, s) -> State:
        if state is None:
            return int(s.ys[0]), 0
        run = int(np.searchsorted(s.xs, state[0] + self.ttl_us, side="right"))
        return state if run == len(s.xs) else (int(s.ys[run]), 0)

    def apply(self, t: np.ndarray, state: State) -> tuple[np.ndarray, State]:
        """True where the event is served by an earlier result."""
        hit = np.ones(len(t), dtype=bool)
        i = 0
        while i < len(t):
            if state is not None and t[i] <= state[0] + self.ttl_us:
                i += int(np.searchsorted(t[i:], state[0] + self.ttl_us, side="right"))
                continue
            hit[i] = False
            state = (int(t[i]), 0)
            i += 1
        return hit, state


def _stretches(*cols: np.ndarray):
    """(start, end) of the stretches in which all columns stay equal."""
    n = len(cols[0])
    change = np.zeros(max(n - 1, 0), dtype=bool)
    for c in cols:
        change |= c[1:] != c[:-1]
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), n]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def _describe(spec):
    """(_k, _slice, _t) in order -> one description per slice and part."""
    names = ["_k", "_slice", "_part", "a", "b", "c", "d", "e", "f", "xs", "ys"]

    def run(batches):
        place, part, buffer, size, rows = None, 0, [], 0, []

        def close():
            nonlocal part, buffer, size
            if size:
                rows.append((*place, part, *spec.summarise(np.concatenate(buffer))))
                part, buffer, size = part + 1, [], 0

        for pdf in batches:
            k, sl, t = pdf["_k"].to_numpy(), pdf["_slice"].to_numpy(), pdf["_t"].to_numpy()
            for a, b in _stretches(k, sl):
                if (k[a], sl[a]) != place:
                    close()
                    place, part = (k[a], sl[a]), 0
                buffer.append(t[a:b])
                size += b - a
                if size >= _PART:
                    close()
            if rows:
                yield pd.DataFrame(rows, columns=names)
                rows.clear()
        close()
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return run


def _resolve(spec):
    """Descriptions in order -> the state at the start of each slice, where it matters."""

    def run(batches):
        key, state = None, None
        for pdf in batches:
            rows = []
            for s in pdf.itertuples(index=False, name="S"):
                k, sl, part = s[0], s[1], s[2]
                if k != key:
                    key, state = k, None
                elif part == 0 and state is not None and spec.matters(state, s.b):
                    rows.append((k, sl, state[0], state[1]))
                state = spec.advance(state, s)
            if rows:
                yield pd.DataFrame(rows, columns=["_k", "_slice", "_s0", "_s1"])

    return run


def _evaluate(spec, out: str):
    """Rows in order, start states first in their slice -> the rows with their outcome."""
    import pyarrow as pa

    def run(batches):
        place, state = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            col = lambda name: table.column(name).combine_chunks()
            k = col("_k").to_numpy(zero_copy_only=False)
            sl, t = col("_slice").to_numpy(), col("_t").to_numpy()
            s0, s1 = col("_s0"), col("_s1")
            flags = np.zeros(len(t), dtype=bool)
            entry = ~s0.is_null().to_numpy(zero_copy_only=False)
            for a, b in _stretches(k, sl):
                if (k[a], sl[a]) != place:
                    place, state = (k[a], sl[a]), None
                if entry[a]:
                    state, a = (s0[a].as_py(), s1[a].as_py()), a + 1
                if a < b:
                    flags[a:b], state = spec.apply(t[a:b], state)
            kept = table.append_column(out, pa.array(flags)).filter(pa.array(~entry))
            yield from kept.drop_columns(["_k", "_slice", "_t", "_s0", "_s1"]).to_batches()

    return run


def _sequence(df: DataFrame, spec, keys: list[str], ts: str, tie: str, seconds: int, out: str) -> DataFrame:
    if len(keys) == 1:
        key = F.coalesce(F.concat(F.lit("="), F.col(keys[0]).cast("string")), F.lit("null"))
    else:
        key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    width = seconds * 1_000_000
    placed = df.withColumn("_k", key).withColumn("_t", micros(F.col(ts)))
    placed = placed.withColumn("_slice", F.expr(f"_t div {width}"))
    order = ["_k", "_slice", "_t"]

    described = (
        placed.select(*order).repartition("_k", "_slice").sortWithinPartitions(*order)
        .mapInPandas(_describe(spec), f"_k string, _slice long, _part int, {_SUMMARY}")
    )
    states = (
        described.repartition("_k").sortWithinPartitions("_k", "_slice", "_part")
        .mapInPandas(_resolve(spec), "_k string, _slice long, _s0 long, _s1 long")
    )
    first = states.withColumn("_t", F.lit(-(1 << 63)).cast("long"))
    rows = placed.unionByName(first, allowMissingColumns=True)
    schema = df.withColumn(out, F.lit(True)).schema
    return (
        rows.repartition("_k", "_slice").sortWithinPartitions(*order, F.col(tie).asc_nulls_first())
        .mapInArrow(_evaluate(spec, out), schema)
    )


def reuse_results(
    jobs: DataFrame, keys: list[str], ts: str, tie: str, ttl_seconds: float = 7200, slice_seconds: int | None = None,
) -> DataFrame:
    """Adds `reused`: an earlier result of the same key, not older than the ttl, serves the job.

    A served job does not prolong the period; the next job after it starts a new one.
    """
    spec = Reuse(int(ttl_seconds * 1_000_000))
    return _sequence(jobs, spec, keys, ts, tie, slice_seconds or max(1, int(ttl_seconds * 32)), "reused")


def job_progress(
    events: DataFrame, job: str = "job_id", kind: str = "type", at: str = "at", tie: str = "id",
    terminal: tuple[str, ...] = ("done", "failed"),
) -> DataFrame:
    """Each job's events up to and including its first terminal one.

    The end of every job is one aggregated row joined back, so a job with very many
    events needs no window of its own.
    """
    when = F.struct(F.col(at), F.col(tie))
    ends = events.where(F.col(kind).isin(*terminal)).groupBy(job).agg(F.min(when).alias("_end"))
    joined = events.join(ends, job, "left")
    return joined.where(F.col("_end").isNull() | (when <= F.col("_end"))).drop("_end")


def latest_status(
    events: DataFrame, job: str = "job_id", kind: str = "type", at: str = "at", tie: str = "id",
) -> DataFrame:
    """The last event type of each job and its time."""
    when = F.struct(F.col(at), F.col(tie))
    return events.groupBy(job).agg(F.max_by(kind, when).alias("status"), F.max(at).alias("since"))
