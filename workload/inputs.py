"""The given tables as the relations of the library."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from siftmark.operators.scan import ScanOptions
from siftmark.plans.shared import shared_folder
from siftmark.sources import files as file_source
from siftmark.sources import rules as rule_source

SECRET = "workload-secret"
# The corpus holds tokens of hexadecimal digits only, which stay below 4 bits.
THRESHOLD = 3.0
OPTIONS = ScanOptions(entropy_threshold=THRESHOLD, spread=True)
DONE_AT = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Times in the tables are without a zone and are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


_packs: dict[str, list] = {}


def pack(spark: SparkSession, name: str) -> list[rule_source.Rule]:
    if name not in _packs:
        _packs[name] = rule_source.load_rules(spark, os.path.join(rule_source.PACKS, name))
    return _packs[name]


def as_files(docs: DataFrame) -> DataFrame:
    """Every document is a file, every source a job."""
    path = F.concat_ws("/", "source", F.concat(F.col("doc_id"), F.lit(".txt")))
    return file_source.files_from_table(docs, path, "text", "source", "lang")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_files(table(spark, sf_dir, "documents"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is a file, every host a job."""
    path = F.concat(F.lit("pages/"), F.col("page_id"), F.lit(".html"))
    host = F.regexp_extract("url", r"^\w+://([^/]+)", 1)
    return file_source.files_from_table(table(spark, sf_dir, "pages"), path, "html", host, F.lit("javascript"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation is a job with a file per turn."""
    path = F.concat_ws("/", "role", F.concat(F.col("turn"), F.lit(".txt")))
    job = F.concat(F.lit("c"), F.col("conv_id"))
    return file_source.files_from_table(table(spark, sf_dir, "conversations"), path, "text", job, F.lit("en"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def job_details(summary: DataFrame) -> DataFrame:
    """A summary with the repository and times that reports show."""
    return summary.withColumns({
        "repo_owner": F.lit("corpus"), "repo_name": F.col("job_id"), "commit_sha": F.sha2("job_id", 256),
        "duration_ms": F.lit(1200).cast("long"), "completed_at": F.lit(DONE_AT).cast("timestamp"),
    })


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for stored scans and streams, in the folder that the cluster shares."""
    return f"{shared_folder(spark)}/{name}-{os.urandom(6).hex()}"


def write_tree(files: DataFrame, root: str) -> str:
    """Write files (path, content) below a folder that all machines mount; the folder's path."""
    base = root.removeprefix("file://").removeprefix("file:")
    if "://" in base:
        raise ValueError(f"{root} is not mounted")
    os.makedirs(base, exist_ok=True)

    def write(batches):
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                place = os.path.join(base, path)
                os.makedirs(os.path.dirname(place), exist_ok=True)
                with open(place, "w", encoding="utf-8", newline="") as f:
                    f.write(content or "")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    files.select("path", "content").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return base
