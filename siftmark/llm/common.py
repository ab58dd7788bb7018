"""Helpers that several operators of this package share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siftmark.plans.shared import drop_table, materialise, numbered  # noqa: F401

# Words are runs of anything but the six ASCII white space characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def fold(key: Column, parts: int) -> Column:
    """The contract's fold of a row: crc32 of the id as text, modulo parts. A null id has fold 0."""
    return F.coalesce(F.crc32(key.cast("string")) % parts, F.lit(0))


def ranked(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Number all rows from 1 in the given order, without bringing them into one task."""
    return numbered(df, name, [], list(order), "rank")


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Few rows that the driver holds, as Arrow data of the plan.

    Spark knows their size, so joins with them need no shuffle of the other side; of plain tuples it would make an RDD
    of unknown size, for which every executor keeps a second set of Python workers.
    """
    fields = T.StructType.fromDDL(schema)
    kinds = to_arrow_schema(fields)
    columns = list(zip(*rows)) or [()] * len(fields)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds), fields)


def carried(docs: DataFrame) -> DataFrame:
    """row, a struct of all columns but the text, and text: names of docs meet no others, and texts travel once."""
    rest = [F.col(c) for c in docs.columns if c != "text"] or [F.lit(True).alias("none")]
    return docs.select(F.struct(*rest).alias("row"), "text")


def restored(rows: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The columns of docs again, from row and a column that holds the text."""
    return rows.select(*[F.col(text).alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in columns])


def runs(batches, *keys: str):
    """(key, rows) of consecutive rows that agree in the key columns, across Arrow batches.

    For partitions sorted by the key whose groups are bounded; a group may span batches.
    """
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = tuple(row[k] for k in keys)
            if rows and now != key:
                yield key, rows
                rows = []
            key = now
            rows.append(row)
    if rows:
        yield key, rows
