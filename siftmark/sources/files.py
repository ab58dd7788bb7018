"""Where files come from: directory trees, tables, and the changed part of either."""

from __future__ import annotations

import hashlib
import os
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftmark.functions.text import extension, literal_map
from siftmark.plans.shared import materialise

# What a tree scan leaves out, and the language of each extension.
SKIPPED_DIRS = [".git", "node_modules", "vendor", ".cache", "dist", "bin"]
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".pdf", ".zip", ".tar", ".gz", ".exe", ".bin", ".so", ".dll",
    ".wasm", ".class", ".jar",
]
LANGUAGES = {
    "go": [".go"], "typescript": [".ts", ".tsx"], "javascript": [".js", ".jsx", ".mjs", ".cjs"],
    "python": [".py"], "rust": [".rs"], "java": [".java"], "kotlin": [".kt", ".kts"], "csharp": [".cs"],
    "cpp": [".cpp", ".cc", ".cxx", ".hpp"], "c": [".c", ".h"], "ruby": [".rb"], "php": [".php"],
    "swift": [".swift"], "bash": [".sh", ".bash"], "yaml": [".yaml", ".yml"], "json": [".json"],
    "terraform": [".tf"], "hcl": [".hcl"], "sql": [".sql"], "protobuf": [".proto"],
}
_LANGUAGE_OF = {ext: name for name, exts in LANGUAGES.items() for ext in exts}
_FEW_PREFIXES = 50


def language_of(path: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(_LANGUAGE_OF), extension(path)), F.lit("unknown"))


def tag_language(files: DataFrame, path_col: str = "path") -> DataFrame:
    return files.withColumn("language", language_of(F.col(path_col)))


def files_from_table(
    df: DataFrame, path: Column | str, content: Column | str, job: Column | str, language: Column | str | None = None,
) -> DataFrame:
    """Any table of texts as files; without a language column it is told from the path."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    tag = language_of(as_col(path)) if language is None else as_col(language)
    return df.select(
        as_col(job).cast("string").alias("job_id"), as_col(path).alias("path"),
        tag.alias("language"), as_col(content).cast("string").alias("content"),
    )


def _skip_reason(rel: Column, length: Column, max_bytes: int | None) -> Column:
    """Why a tree scan leaves a file out; null for files that it reads."""
    folders = F.split(F.regexp_extract(rel, r"^(.*)/[^/]*$", 1), "/")
    reason = F.when(F.arrays_overlap(folders, F.array(*[F.lit(d) for d in SKIPPED_DIRS])), "skipped folder")
    reason = reason.when(extension(rel).isin(BINARY_EXTENSIONS), "binary")
    return reason if max_bytes is None else reason.when(length > max_bytes, "too large")


def _place(rel: Column, job_id: str | None) -> tuple[Column, Column]:
    """(job, path): the first folder is the job unless one is given."""
    if job_id is None:
        return F.substring_index(rel, "/", 1), F.regexp_replace(rel, r"^[^/]*/", "")
    return F.lit(job_id), rel


def _base(root: str) -> tuple[str, bool]:
    """(root without a slash behind, whether it is a mounted folder)."""
    mounted = "://" not in root
    return (os.path.abspath(root) if mounted else root.rstrip("/")), mounted


def _stored(spark: SparkSession, base: str) -> DataFrame:
    """(path, length, content) of an object store as Spark lists it; a file that is gone or broken when it is read
    fails the job."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    rel = F.substring(F.col("path"), F.instr("path", base) + len(base) + 1, F.length("path"))
    return found.select(rel.alias("path"), "length", "content")


def _check_mounted(spark: SparkSession, base: str) -> None:
    """All machines must see the same entries in the root."""

    def look(batches):
        for batch in batches:
            seen = sorted(os.listdir(base)) if os.path.isdir(base) else ["<no such folder>"]
            digest = hashlib.sha256("\0".join(seen).encode("utf-8", "surrogateescape")).hexdigest()
            yield pa.RecordBatch.from_pydict({"seen": [digest] * batch.num_rows, "there": [os.path.isdir(base)] * batch.num_rows})

    tasks = spark.sparkContext.defaultParallelism * 2
    seen = spark.range(0, tasks, 1, tasks).mapInArrow(look, "seen string, there boolean").distinct().limit(2).collect()
    if len(seen) != 1 or not seen[0].there:
        raise ValueError(f"{base} is not the same folder on all machines")


def list_tree(spark: SparkSession, root: str, prune: bool = True) -> DataFrame:
    """(path, length, task) of all files below a mounted folder, paths relative to it; `task` listed the file.

    Folders are expanded level by level: those of a level are rows, dealt anew over all tasks, so one large
    repository is walked by many of them and the driver lists nothing. Each level is written to a table while this
    runs. Links to folders are not followed. With `prune`, folders that a tree scan leaves out are not entered.
    """
    base, mounted = _base(root)
    if not mounted:
        raise ValueError("only mounted folders are listed")
    _check_mounted(spark, base)
    skip = set(SKIPPED_DIRS) if prune else set()
    schema = "path string, length long, folder boolean, task int"

    def expand(batches):
        for batch in batches:
            rows = []
            for rel, task in zip(batch["path"].to_pylist(), batch["task"].to_pylist()):
                with os.scandir(os.path.join(base, rel)) as entries:
                    for e in entries:
                        place = os.path.join(rel, e.name)
                        if e.is_dir(follow_symlinks=False):
                            if e.name not in skip:
                                rows.append((place, 0, True, task))
                        elif e.is_file():
                            rows.append((place, e.stat().st_size, False, task))
            yield _record(rows, ["path", "length", "folder", "task"], [pa.string(), pa.int64(), pa.bool_(), pa.int32()])

    tasks = spark.sparkContext.defaultParallelism * 2
    frontier, levels = spark.createDataFrame([("",)], "path string"), []
    while frontier is not None:
        dealt = frontier.repartition(tasks, "path").withColumn("task", F.spark_partition_id())
        level = materialise(dealt.mapInArrow(expand, schema), "tree-level")
        levels.append(level.where("NOT folder").select("path", "length", "task"))
        folders = level.where("folder").select("path")
        frontier = None if folders.isEmpty() else folders
    return reduce(DataFrame.unionAll, levels)


def _record(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _read_listed(listed: DataFrame, base: str) -> DataFrame:
    """(path, length, content) of the listed files, read by tasks that get about equally many."""

    def read(batches):
        for batch in batches:
            rows, size = [], 0
            for rel in batch["path"].to_pylist():
                with open(os.path.join(base, rel), "rb") as f:
                    data = f.read()
                rows.append((rel, len(data), data))
                size += len(data)
                if size > 32 << 20:
                    yield _record(rows, *shape)
                    rows, size = [], 0
            yield _record(rows, *shape)

    shape = ["path", "length", "content"], [pa.string(), pa.int64(), pa.binary()]
    total = listed.agg(F.sum("length")).first()[0] or 0
    tasks = max(listed.sparkSession.sparkContext.defaultParallelism, -(-total // (64 << 20)))
    return listed.select("path").repartition(tasks, "path").mapInArrow(read, "path string, length long, content binary")


def _is_hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)[._]")


def skipped_files(spark: SparkSession, root: str, job_id: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """(job_id, path, length, reason) of the listed files that `read_source_tree` leaves out; reads no content."""
    base, mounted = _base(root)
    listed = list_tree(spark, root, prune=False) if mounted else _stored(spark, base).select("path", "length")
    job, path = _place(F.col("path"), job_id)
    rows = listed.withColumn("reason", _skip_reason(F.col("path"), F.col("length"), max_bytes))
    return rows.where("reason IS NOT NULL").select(job.alias("job_id"), path.alias("path"), "length", "reason")


def read_source_tree(
    spark: SparkSession, root: str, job_id: str | None = None,
    max_bytes: int | None = None, include_hidden: bool | None = None, only: DataFrame | None = None,
) -> DataFrame:
    """All text files below `root` as files, paths relative to it; `skipped_files` lists what is left out.

    Files of any size are read unless `max_bytes` is given. Without `job_id` every directory directly below
    the root is one job, which scans any number of checkouts in one run. A root without a scheme is a folder that
    all machines mount; it is listed by `list_tree` when this is called, and its files are read by the tasks. Object
    stores are listed by Spark, whose file sources leave out names that start with `.` or `_`; mounted roots give
    them too unless `include_hidden` is false. `only` (job_id, path) names the files wanted; others are not read.
    """
    base, mounted = _base(root)
    raw = list_tree(spark, root) if mounted else _stored(spark, base)
    raw = raw.where(_skip_reason(F.col("path"), F.col("length"), max_bytes).isNull())
    if max_bytes is not None:  # a filter on length reaches the source, which then reads no such file
        raw = raw.where(F.col("length") <= max_bytes)
    if include_hidden is False:
        raw = raw.where(~_is_hidden(F.col("path")))
    job, path = _place(F.col("path"), job_id)
    if only is not None:
        wanted = only.select(F.col("job_id").alias("_job"), F.col("path").alias("_path")).distinct()
        raw = raw.join(wanted, (job == F.col("_job")) & (path == F.col("_path")), "left_semi")
    if mounted:
        raw = _read_listed(raw, base)
    content = F.col("content").cast("string")
    return raw.select(
        job.alias("job_id"), path.alias("path"), language_of(path).alias("language"),
        content.alias("content"), F.is_valid_utf8(content).alias("valid_utf8"),
    )


def changed_files(files: DataFrame, *changes: DataFrame) -> DataFrame:
    """Files whose path is in one of the change lists; without any list, all files.

    A list with a `job_id` column is matched per job, one without it by path alone.
    """
    if not changes:
        return files
    keys = ["job_id", "path"] if all("job_id" in c.columns for c in changes) else ["path"]
    wanted = None
    for c in changes:
        part = c.select(*keys[:-1], F.trim("path").alias("path")).where("path <> ''")
        wanted = part if wanted is None else wanted.unionByName(part)
    # Names first, without texts. The names that exist are a written table of known size, so Spark broadcasts
    # them to the texts if they are few; texts are shuffled only where they are not.
    found = files.select(*keys).distinct().join(wanted.distinct(), keys, "left_semi")
    return files.join(materialise(found, "changed-files"), keys, "left_semi")


def exclude_prefixes(files: DataFrame, prefixes: list[str], path_col: str = "path") -> DataFrame:
    """Drop files whose path starts with one of the (non-empty) prefixes."""
    prefixes = [p for p in dict.fromkeys(p.strip() for p in prefixes) if p]
    if not prefixes:
        return files
    path = F.col(path_col)
    if len(prefixes) <= _FEW_PREFIXES:
        tests = [path.startswith(p) for p in prefixes]
    else:  # one hash lookup per distinct length instead of one comparison per prefix
        by_length: dict[int, list[str]] = {}
        for p in prefixes:
            by_length.setdefault(len(p), []).append(p)
        tests = [F.substring(path, 1, n).isin(ps) for n, ps in sorted(by_length.items())]
    hit = tests[0]
    for t in tests[1:]:
        hit = hit | t
    return files.where(~hit)
