"""Ordered computations per key, as a prefix scan over parts of equal size.

A window over one key sends the whole key to one task. Here rows are dealt by ranges of (keys, time), so parts
hold about equally many rows however the rows of a key lie in time, and each part is scanned in order in its
task. One row per (part, key) carries what the next parts need to know: the sum, or the last value. A key with
a third of all rows, or with all of them in one hour, is spread over many tasks.

The scanned rows are written once to the shared folder while the result is being built; lineage ends there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from siftmark.plans.shared import materialise

PART = "_part"


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def order_key(df: DataFrame, ts: str, tie: list[str]) -> Column:
    """What (ts, *tie) sort by, as a number where that is possible.

    Aggregates like max_by over a struct make Spark sort its input; over a number they
    are hashed.
    """
    if not tie:
        return micros(F.col(ts))
    whole = isinstance(df.schema[tie[0]].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    if len(tie) > 1 or not whole:
        return F.struct(ts, *tie)
    wide = lambda c: c.cast("decimal(20,0)")
    # a tie is in +-2^63, so steps of 10^20 per microsecond keep the order
    return (wide(micros(F.col(ts))) * F.lit(str(10**20)).cast("decimal(21,0)") + wide(F.col(tie[0]))).cast("decimal(38,0)")


def deal_in_order(df: DataFrame, keys: list[str], ts: str, tie: list[str], parts: int | None = None) -> DataFrame:
    """The rows by ranges of (keys, ts, tie), in order inside a part, with the number of the part in `_part`.

    Without `parts` Spark chooses as many as the size of the rows asks for.
    """
    order = [F.col(c).asc_nulls_first() for c in (*keys, ts, *tie)]
    dealt = df.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    return dealt.withColumn(PART, F.spark_partition_id())


def _starts(batch: pa.RecordBatch, keys: list[str], last: tuple | None) -> tuple[np.ndarray, tuple]:
    """Where a row's keys differ from those of the row before, and the keys of the last row."""
    change = np.zeros(batch.num_rows, bool)
    for k in keys:
        codes = batch[k].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    change[0] = last != tuple(batch[k][0].as_py() for k in keys)
    return change, tuple(batch[k][batch.num_rows - 1].as_py() for k in keys)


def _scan(dealt: DataFrame, keys: list[str], column: str, kind: T.DataType, step) -> DataFrame:
    """Adds `_at`, the place of a row among those of its key in the part, and `_in`, what step makes of the column.

    step(values, starts, before) gives the new column and what it hands to the next batch; starts marks the first
    row of each key.
    """
    schema = T.StructType([*dealt.schema.fields, T.StructField("_at", T.LongType()), T.StructField("_in", kind)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before, place = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, last = _starts(batch, keys, last)
            count = np.arange(1, batch.num_rows + 1)
            # rows since the last start; before the first one they go on from the batch before
            at = count - np.maximum.accumulate(np.where(starts, count - 1, 0))
            at = at + np.where(np.cumsum(starts) == 0, place, 0)
            place = int(at[-1])
            values, before = step(batch[column], starts, before)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64()), values], names=[*batch.schema.names, "_at", "_in"])

    return dealt.mapInArrow(task, schema)


def _join_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that also matches null keys."""
    marked = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(marked[f"_r_{k}"]) for k in keys])
    return left.join(marked, same, "left").drop(*[f"_r_{k}" for k in keys])


def running_sum(
    df: DataFrame, keys: list[str], ts: str, tie: list[str], value: Column, out: str, parts: int | None = None,
) -> DataFrame:
    """Adds the sum of `value` over the key's rows up to and including the row.

    Whole numbers are summed as longs, others as doubles; nulls count as 0.
    """
    valued = df.withColumn("_v", value)
    whole = isinstance(valued.schema["_v"].dataType, T.IntegralType)
    kind, zero = (T.LongType(), 0) if whole else (T.DoubleType(), 0.0)
    valued = valued.withColumn("_v", F.coalesce(F.col("_v").cast(kind), F.lit(zero)))
    arrow = pa.int64() if whole else pa.float64()

    def add(values: pa.Array, starts: np.ndarray, before):
        v = values.to_numpy(zero_copy_only=False)
        total = np.cumsum(v)
        first = np.flatnonzero(starts)
        owner = np.cumsum(starts)  # 0: rows that go on from the batch before
        base = np.r_[-(before or zero), total[first] - v[first]]
        summed = total - base[owner]
        return pa.array(summed, arrow), summed[-1]

    scanned = materialise(_scan(deal_in_order(valued, keys, ts, tie, parts), keys, "_v", kind, add), "running-sum")
    place = [*keys, PART]
    totals = scanned.groupBy(*place).agg(F.sum("_v").alias("_t"))
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*place, F.sum("_t").over(earlier).alias("_carry"))
    summed = F.coalesce("_carry", F.lit(zero)) + F.col("_in")
    return _join_on(scanned, carry, place).withColumn(out, summed).drop(PART, "_v", "_at", "_in", "_carry")


def previous_value(
    df: DataFrame, keys: list[str], ts: str, tie: list[str], value: str, out: str, parts: int | None = None,
) -> DataFrame:
    """Adds the value of the key's row just before, null for the first."""

    def shift(values: pa.Array, starts: np.ndarray, before):
        first = pa.nulls(1, values.type) if before is None else before
        moved = pa.concat_arrays([first, values.slice(0, len(values) - 1)])
        kept = moved.take(pa.array(np.arange(len(values)), pa.int64(), mask=starts))
        return kept, values.slice(len(values) - 1)

    kind = df.schema[value].dataType
    scanned = materialise(_scan(deal_in_order(df, keys, ts, tie, parts), keys, value, kind, shift), "previous-value")
    place = [*keys, PART]
    last = scanned.groupBy(*place).agg(F.max_by(value, "_at").alias("_last"))
    carry = last.select(*place, F.lag("_last").over(Window.partitionBy(*keys).orderBy(PART)).alias("_carry"))
    previous = F.when(F.col("_at") == 1, F.col("_carry")).otherwise(F.col("_in"))
    return _join_on(scanned, carry, place).withColumn(out, previous).drop(PART, "_at", "_in", "_carry")
