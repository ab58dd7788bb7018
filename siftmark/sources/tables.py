"""Stored relations: the audit log and metric samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from siftmark import schemas


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The audit log written by `append_audit`; `filter_audit` prunes its day folders."""
    return spark.read.schema(T.StructType([*schemas.AUDIT.fields, T.StructField("batch", T.StringType()), T.StructField("dt", T.DateType())])).parquet(path)


def read_audit_jdbc(spark: SparkSession, url: str, table: str, bounds: tuple[str, str], parts: int, **options) -> DataFrame:
    """The audit log in a database, read in `parts` ranges of created_at."""
    return (
        spark.read.format("jdbc").options(url=url, dbtable=table, **options)
        .option("partitionColumn", "created_at").option("lowerBound", bounds[0])
        .option("upperBound", bounds[1]).option("numPartitions", parts).load()
        .select([f.name for f in schemas.AUDIT])
    )


def append_metric_samples(samples: DataFrame, path: str, batch: str) -> None:
    """Samples into a table by batch and day; a batch that runs again replaces its folder."""
    placed = samples.select(*schemas.SAMPLES.names).withColumn("day", F.to_date("ts"))
    placed.write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={batch}")


def read_metric_samples(spark: SparkSession, path: str, since=None, until=None) -> DataFrame:
    """The stored samples; both time bounds are inclusive and also prune day folders."""
    placed = [T.StructField("batch", T.StringType()), T.StructField("day", T.DateType())]
    out = spark.read.schema(T.StructType([*schemas.SAMPLES.fields, *placed])).parquet(path)
    if since is not None:
        out = out.where((F.col("ts") >= F.lit(since).cast("timestamp")) & (F.col("day") >= F.to_date(F.lit(since))))
    if until is not None:
        out = out.where((F.col("ts") <= F.lit(until).cast("timestamp")) & (F.col("day") <= F.to_date(F.lit(until))))
    return out.select(*schemas.SAMPLES.names)


def parse_exposition(lines: DataFrame) -> DataFrame:
    """Metric exposition text to samples. `lines` has service, ts and text, one scrape line each.

    The service name is cut off the metric names; bucket, sum and count series take
    the kind of their histogram.
    """
    prefix = F.concat(F.col("service"), F.lit("_"))
    shown = F.regexp_extract("text", r"^([A-Za-z_:][\w:]*)", 1)
    cut = lambda c: F.when(c.startswith(prefix), F.substring(c, F.length(prefix) + 1, F.length(c))).otherwise(c)
    declared = r"^# TYPE (\S+) (\S+)"
    kinds = (
        lines.where(F.col("text").rlike(declared))
        .groupBy("service", cut(F.regexp_extract("text", declared, 1)).alias("family"))
        .agg(F.max(F.regexp_extract("text", declared, 2)).alias("declared"))
    )
    le = F.regexp_extract("text", r'le="([^"]*)"', 1)
    samples = lines.where("text <> '' AND NOT startswith(text, '#')").select(
        "service", cut(shown).alias("metric"), F.nullif(le, F.lit("")).alias("le"), "ts",
        F.regexp_extract("text", r"\s(\S+)\s*$", 1).try_cast("double").alias("value"),
    )
    named = samples.withColumn("family", F.regexp_replace("metric", "_(bucket|sum|count)$", ""))
    exact = kinds.select("service", F.col("family").alias("metric"), F.col("declared").alias("exact"))
    return (
        named.join(exact, ["service", "metric"], "left").join(kinds, ["service", "family"], "left")
        .select(
            "service", "metric", F.coalesce("exact", "declared", F.lit("untyped")).alias("kind"), "le", "ts", "value",
        )
    )
