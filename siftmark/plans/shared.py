"""Tables between two steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PART = 33  # the bits of monotonically_increasing_id below the partition


@lru_cache(maxsize=1)
def _own_folder() -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="siftmark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset and Spark runs on one machine, one that goes with the process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_folder().name
    return base.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table: lineage ends here and a lost executor loses nothing.

    Shuffle files of the write are removed once it has ended. The table stays until the caller
    empties the folder, as results may still be read from it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """A folder or file is there, in whatever store the path names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def drop_table(df: DataFrame) -> None:
    """Delete a materialised table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, name: str, keys: list[str], order: list[Column], number: str) -> DataFrame:
    """Number the rows of each key from 1 in the given order, however many rows a key has.

    This writes a table, so a job runs while the caller still builds its query. The rows are dealt by ranges of (keys, order) and written once. A row's number follows from its place in
    its part and from the counts of (key, part), a few rows.
    """
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = materialise(dealt.withColumn("_id", F.monotonically_increasing_id()), name).withColumn("_part", F.shiftright("_id", _PART))
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    counts = rows.groupBy(*own, F.col("_part").alias("_p")).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))] or [F.lit(0)]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    place = F.col("_before") + F.col("_id") - F.col("_first") + 1
    return rows.join(counts, same).withColumn(number, place).select(*df.columns, number)
