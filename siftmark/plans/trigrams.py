"""A stored table of trigrams: which files can hold a rule's literals, told before any text is read.

For corpora that are scanned again and again with changing packs. Per version of a corpus every file's distinct
trigrams (of the lower-cased text, printable ASCII only) are stored the other way round: files lie in blocks of
bounded size, and a row says which members of a block hold a trigram. These rows are dealt into folders by trigram
and sorted there; a folder of its own names the members. A rule whose every match contains a known literal needs only the files that have all trigrams of one of
its literals; the others need all files. Scans of the candidates find what scans of all files find, as the
candidates hold every file with a hit.

Required patterns, secrets and dependencies are not tied to literals and are not looked up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from siftmark.operators.scan import ScanOptions, scan_files
from siftmark.plans.shared import exists
from siftmark.sources.rules import Rule

_FOLDERS = 64
_NAMES = -1  # the folder of the members' names
_BLOCK_FILES, _BLOCK_BYTES = 4096, 8 << 20
_FIRST, _SIGNS = 0x20, 95  # printable ASCII
_GRAMS = T.StructType([
    T.StructField("gram", T.StringType()), T.StructField("block", T.LongType()), T.StructField("members", T.ArrayType(T.IntegerType())),
    T.StructField("job_id", T.StringType()), T.StructField("path", T.StringType()),
])
_ARROW = pa.schema([("gram", pa.string()), ("block", pa.int64()), ("members", pa.list_(pa.int32())), ("job_id", pa.string()), ("path", pa.string())])


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(_FOLDERS)).cast("int")


def _postings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigrams as bytes, three each; offsets; members): which of the texts hold each trigram, the trigrams in order.

    A trigram lies inside a run of printable ASCII characters.
    """
    data = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    sign = data.astype(np.int64) - _FIRST
    plain = (sign >= 0) & (sign < _SIGNS)
    at = np.flatnonzero(plain[:-2] & plain[1:-1] & plain[2:])
    code = (sign[at] * _SIGNS + sign[at + 1]) * _SIGNS + sign[at + 2]
    code, member = np.divmod(np.unique(code * len(texts) + owner[at]), len(texts))
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    own = code[starts]
    grams = np.stack([own // _SIGNS**2, own // _SIGNS % _SIGNS, own % _SIGNS], axis=1) + _FIRST
    return grams.astype(np.uint8), np.append(starts, len(code)).astype(np.int32), member.astype(np.int32)


def _block(number: int, names: list[tuple[str, str]], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The rows of a block: the name of each member, and the members of each trigram."""
    nulls = lambda n, kind: pa.nulls(n, kind)
    n = len(names)
    own = pa.ListArray.from_arrays(pa.array(range(n + 1), pa.int32()), pa.array(range(n), pa.int32()))
    yield pa.RecordBatch.from_arrays(
        [nulls(n, pa.string()), pa.array([number] * n, pa.int64()), own, pa.array([j for j, _ in names], pa.string()), pa.array([p for _, p in names], pa.string())],
        schema=_ARROW)
    grams, offsets, members = _postings(texts)
    for lo in range(0, len(grams), 4096):
        n = len(some := grams[lo:lo + 4096])
        held = offsets[lo:lo + n + 1]
        text = pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(0, 3 * n + 1, 3, dtype=np.int32)), pa.py_buffer(some.tobytes()))
        lists = pa.ListArray.from_arrays(pa.array(held - held[0]), pa.array(members[held[0]:held[-1]]))
        yield pa.RecordBatch.from_arrays([text, pa.array([number] * n, pa.int64()), lists, nulls(n, pa.string()), nulls(n, pa.string())], schema=_ARROW)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, names, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
    for batch in batches:
        for job, path, text in zip(batch["job_id"], batch["path"], batch["text"]):
            names.append((job.as_py(), path.as_py()))
            texts.append(text.as_py() or b"")
            size += len(texts[-1])
            if len(texts) >= _BLOCK_FILES or size >= _BLOCK_BYTES:
                yield from _block(number, names, texts)
                number, names, texts, size = number + 1, [], [], 0
    if texts:
        yield from _block(number, names, texts)


def build_trigrams(files: DataFrame, out: str, version: str) -> None:
    """The trigrams of a version of the corpus to `out`; a version that is built again is replaced."""
    lowered = files.select("job_id", "path", F.lower("content").cast("binary").alias("text"))
    # In a fixed order, so that a task that runs again numbers the members as before.
    rows = lowered.sortWithinPartitions("job_id", "path", F.xxhash64("text"), "text").mapInArrow(_blocks, _GRAMS)
    placed = rows.withColumn("folder", F.when(F.col("gram").isNull(), _NAMES).otherwise(_folder(F.col("gram"))))
    placed = placed.repartition("folder", F.pmod(F.col("block"), F.lit(16))).sortWithinPartitions("folder", "gram")
    placed.write.mode("overwrite").partitionBy("folder").parquet(f"{out}/version={version}")


def _read(spark: SparkSession, out: str, version: str, folders: list[int]) -> DataFrame:
    base = f"{out}/version={version}"
    if not exists(spark, base):
        raise ValueError(f"no trigrams of version {version}")
    paths = [p for p in (f"{base}/folder={f}" for f in folders) if exists(spark, p)]
    return spark.read.schema(_GRAMS).parquet(*paths) if paths else spark.createDataFrame([], _GRAMS)


def needed_trigrams(rule: Rule) -> list[list[str]] | None:
    """The trigrams of each of the rule's literals; None if a file without them may hit."""
    if rule.pattern.negate or rule.translated is None or not rule.translated.literals:
        return None
    needs = []
    for literal, _ in rule.translated.literals:
        runs, run = [], ""
        for c in literal:
            if " " <= c <= "~":
                run += c.lower()
            else:
                runs.append(run)
                run = ""
        grams = sorted({r[i:i + 3] for r in (*runs, run) for i in range(len(r) - 2)})
        if not grams:
            return None
        needs.append(grams)
    return needs


def candidates(spark: SparkSession, rules: list[Rule], out: str, version: str) -> tuple[DataFrame, list[Rule]]:
    """(job_id, path, rule_id) of the files that may hold a rule's literal, and the rules that need all files."""
    asked, rest = [], []
    for rule in rules:
        if not rule.active:
            continue
        needs = needed_trigrams(rule)
        if needs is None:
            rest.append(rule)
        else:
            asked += [(rule.rule_id, i, len(grams), g) for i, grams in enumerate(needs) for g in grams]
    wanted = spark.createDataFrame(asked, "rule_id string, nth int, size int, gram string")
    folders = [r[0] for r in wanted.select(_folder(F.col("gram"))).distinct().collect()]
    grams = sorted({a[3] for a in asked})
    # The trigrams of a pack are few: as literals they reach the sorted files of the table.
    found = _read(spark, out, version, folders).where(F.col("gram").isin(grams)).join(wanted, "gram")
    members = found.select("block", F.explode("members").alias("member"), "rule_id", "nth", "size")
    held = members.groupBy("block", "member", "rule_id", "nth", "size").agg(F.count(F.lit(1)).alias("n")).where("n = size")
    names = _read(spark, out, version, [_NAMES]).select("block", F.col("members")[0].alias("member"), "job_id", "path")
    return held.join(names, ["block", "member"]).select("job_id", "path", "rule_id").distinct(), rest


def scan_candidates(
    spark: SparkSession, files: Callable[[DataFrame], DataFrame], rules: list[Rule], out: str, version: str, opts: ScanOptions = ScanOptions(),
) -> DataFrame:
    """Findings of the rules that literals tell the files of; `files(names)` reads the files that (job_id, path) name.

    Rules that need all files are not tried here; `candidates` names them.
    """
    names, rest = candidates(spark, rules, out, version)
    skipped = {r.rule_id for r in rest}
    # Positions in the pack stay, as findings are ordered by them.
    tried = [replace(r, enabled=False) if r.rule_id in skipped or r.pattern.negate else r for r in rules]
    return scan_files(files(names.select("job_id", "path").distinct()), tried, replace(opts, secrets=False, deps=False))
