"""Tables that a stream writes batch by batch: repeatable, and readable by parts.

Every table is a folder under the stream's output. A micro-batch writes the folder of its number; when it runs
again it replaces that folder. The watermark is kept the same way, as a row per batch, so what was late once is
late again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from siftmark.plans.shared import exists
from siftmark.plans.slices import micros

BATCH = "batch_id"


def write_batch(df: DataFrame, out: str, name: str, batch_id: int) -> None:
    """One folder per micro-batch, replaced when the batch is run again."""
    df.write.mode("overwrite").parquet(f"{out}/{name}/{BATCH}={batch_id}")


def read_batch(spark: SparkSession, out: str, name: str, batch_id: int, schema: T.StructType) -> DataFrame:
    """What one batch wrote, without its number; empty if it wrote nothing."""
    path = f"{out}/{name}/{BATCH}={batch_id}"
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_output(spark: SparkSession, out: str, name: str) -> DataFrame:
    """All batches of a table, with `batch_id`."""
    return spark.read.option("basePath", f"{out}/{name}").parquet(f"{out}/{name}/{BATCH}=*")


def mark_before(spark: SparkSession, out: str, batch_id: int) -> int | None:
    """The watermark in microseconds that the batches before this one have reached."""
    if batch_id <= 0:
        return None
    row = read_batch(spark, out, "clock", batch_id - 1, T.StructType([T.StructField("mark", T.LongType())])).first()
    return None if row is None else row["mark"]


def move_mark(spark: SparkSession, out: str, batch_id: int, before: int | None, highest: int | None, delay_seconds: float) -> int | None:
    """The watermark behind this batch: the highest time seen less the delay. It never goes back."""
    reached = None if highest is None else highest - int(delay_seconds * 1_000_000)
    marks = [m for m in (before, reached) if m is not None]
    mark = max(marks) if marks else None
    write_batch(spark.createDataFrame([(mark,)], "mark long"), out, "clock", batch_id)
    return mark


def lateness(ts: Column, mark: int | None) -> Column:
    """Why a row does not go with the others; null for those in time."""
    reason = F.when(ts.isNull(), "no time")
    return reason if mark is None else reason.when(micros(ts) <= mark, "late")
