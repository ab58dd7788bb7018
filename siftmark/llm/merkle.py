"""Merkle manifest of a dataset, and membership proofs by octopus multiproofs.

Every row is a leaf, the SHA-256 of its columns. The leaves of a group (a language, a source) lie in order of
their key; each `fan` consecutive nodes have a parent, the SHA-256 of their digests as hex text, until one node
remains, the subroot. The subroots in order of the groups form a tree of the same kind; its top is the root.

1. Leaves are numbered per group by one range partitioning, whatever a group's size. Interior nodes are made
   in aligned blocks of fan ** span leaves, a block per Python group, `span` levels in one pass.
2. A part is a bounded stretch of places of a group. A part looks at the places of its leaves, walks up level
   by level and names the siblings that it can neither hold nor derive: the minimal union of missing node
   coordinates for all its leaves. The coordinates of all parts are fetched by one join with the stored nodes.
3. With what was fetched a part derives its interior nodes once and expands the proof of each of its leaves
   locally. The way from the subroots to the root is proven the same way, over the groups.

A proof is a list of levels from the leaf upwards, each with the digests left and right of the node in its run
(empty texts where there are none). `fold` recomputes the root from a leaf and its proof.

Defined results: a null column counts as `-`. Null keys come first, equal keys go by leaf; equal rows are leaves
of their own. The null group is the first group. A lone leaf is its subroot, a lone subroot the root. An empty
table has no root and no proofs. Only the columns named as carried are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from siftmark.llm.common import materialise, numbered, runs


@dataclass(frozen=True)
class Settings:
    fan: int = 8
    span: int = 3  # levels that one pass over a block adds
    part: int = 8**4  # places of a group that are proven together


@dataclass(frozen=True)
class Manifest:
    """leaves(tree, n, idx, digest, row), nodes(tree, n, level, idx, digest, top), trees(tree, grp, n, digest); top:
    the tree over the subroots in the same form; root: its digest, None for an empty table."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    top_leaves: DataFrame
    top_nodes: DataFrame
    root: str | None
    settings: Settings


_NODE = T.StructType([
    T.StructField("tree", T.LongType()), T.StructField("n", T.LongType()), T.StructField("level", T.IntegerType()),
    T.StructField("idx", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("top", T.BooleanType()),
])
_STEP = T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())])


def leaf(columns: list[Column]) -> Column:
    """The digest of a row: per column `-` if null, else its length in bytes, a colon and the value as text."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def _sha(texts: list[str]) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def _count(n: int, level: int, fan: int) -> int:
    """Nodes of a level above n leaves."""
    for _ in range(level):
        n = -(-n // fan)
    return n


def _block(digests: list[str], first: int, n: int, level: int, settings: Settings) -> Iterator[tuple[int, int, str, bool]]:
    """(level, idx, digest, top) of the nodes above an aligned block of one level's nodes."""
    count = _count(n, level, settings.fan)
    for _ in range(settings.span):
        if count <= 1:
            return
        level, first, count = level + 1, first // settings.fan, -(-count // settings.fan)
        digests = [_sha(digests[i : i + settings.fan]) for i in range(0, len(digests), settings.fan)]
        for i, digest in enumerate(digests):
            yield level, first + i, digest, count == 1


def interior(leaves: DataFrame, settings: Settings) -> DataFrame:
    """All nodes above leaves(tree, n, idx, digest); n is the number of leaves of the tree."""
    spark = leaves.sparkSession
    most = leaves.agg(F.max("n")).first()[0] or 0
    width, level, tables, current = settings.fan**settings.span, 0, [], leaves
    while _count(most, level, settings.fan) > 1:

        def task(batches: Iterator[pa.RecordBatch], level=level) -> Iterator[pa.RecordBatch]:
            for (tree, _), rows in runs(batches, "tree", "block"):
                n = rows[0]["n"]
                made = list(_block([r["digest"] for r in rows], rows[0]["idx"], n, level, settings))
                if made:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([tree] * len(made), pa.int64()), pa.array([n] * len(made), pa.int64()),
                        pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.int64()),
                        pa.array([m[2] for m in made], pa.string()), pa.array([m[3] for m in made], pa.bool_()),
                    ], names=_NODE.names)

        dealt = current.select("tree", "n", "idx", "digest", F.expr(f"idx div {width}").alias("block"))
        dealt = dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")
        made = materialise(dealt.mapInArrow(task, _NODE), "merkle-nodes")
        tables.append(made)
        level += settings.span
        current = made.where((F.col("level") == level) & ~F.col("top"))
    return reduce(DataFrame.unionAll, tables) if tables else spark.createDataFrame([], _NODE)


def _tops(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, digest) of the node that remains of each tree."""
    return leaves.where("n = 1").select("tree", "digest").unionAll(nodes.where("top").select("tree", "digest"))


def build(rows: DataFrame, group: str, key: str, digest: Column, carry: list[Column], settings: Settings = Settings()) -> Manifest:
    """The manifest of rows, whose leaves are digest, ordered by key in each group."""
    plain = rows.select(
        F.col(group).alias("grp"), F.col(key).alias("key"), digest.alias("digest"), F.struct(*carry).alias("row"),
        F.monotonically_increasing_id().alias("tie"),  # equal rows are alike, so any order of them will do
    )
    # Written first: dealing by ranges reads its input twice, and the texts are to be read once.
    plain = materialise(plain, "merkle-digests")
    order = [F.col("key").asc_nulls_first(), F.col("digest"), F.col("tie")]
    placed = numbered(plain, "merkle-order", ["grp"], order, "place")
    sizes = placed.groupBy("grp").agg(F.count("*").alias("n"))
    trees = numbered(sizes, "merkle-groups", [], [F.col("grp").asc_nulls_first()], "tree").withColumn("tree", F.col("tree") - 1)
    trees = trees.select(F.col("grp").alias("of"), "n", "tree")
    leaves = placed.join(trees, F.col("grp").eqNullSafe(F.col("of")))
    leaves = materialise(leaves.select("tree", "n", (F.col("place") - 1).alias("idx"), "digest", "row"), "merkle-leaves")
    nodes = interior(leaves, settings)
    trees = materialise(trees.join(_tops(leaves, nodes), "tree").select("tree", F.col("of").alias("grp"), "n", "digest"), "merkle-trees")
    top_leaves = trees.select(
        F.lit(0).cast("long").alias("tree"), F.lit(trees.count()).cast("long").alias("n"), F.col("tree").alias("idx"), "digest",
        F.struct(F.col("tree").alias("sub")).alias("row"),
    )
    top_nodes = interior(top_leaves, settings)
    root = _tops(top_leaves, top_nodes).first()
    return Manifest(leaves, nodes, trees, top_leaves, top_nodes, root["digest"] if root else None, settings)


def missing(known: np.ndarray, n: int, fan: int) -> Iterator[tuple[int, np.ndarray]]:
    """(level, places) of the siblings that the leaves at the known places (ascending) cannot derive."""
    level = 0
    while n > 1:
        parents = np.unique(known // fan)
        children = (parents[:, None] * fan + np.arange(fan)).ravel()
        yield level, np.setdiff1d(children[children < n], known, assume_unique=True)
        known, n, level = parents, -(-n // fan), level + 1


def expand(own: dict[int, str], fetched: dict[tuple[int, int], str], n: int, fan: int) -> dict[int, list[tuple[str, str]]]:
    """The proof of each own leaf (place -> digest), from the fetched nodes ((level, place) -> digest)."""
    levels, counts, level = [own], [n], 0
    while n > 1:
        known, above = levels[-1], {}
        for parent in {i // fan for i in known}:
            children = range(parent * fan, min(parent * fan + fan, n))
            above[parent] = _sha([known[i] if i in known else fetched[level, i] for i in children])
        levels.append(above)
        n, level = -(-n // fan), level + 1
        counts.append(n)
    ways: dict[int, list[tuple[str, str]]] = {i: [] for i in levels[-1]}
    for level in range(level - 1, -1, -1):
        known, below = levels[level], {}
        for parent, way in ways.items():
            children = range(parent * fan, min(parent * fan + fan, counts[level]))
            digests = [known[i] if i in known else fetched[level, i] for i in children]
            for k, i in enumerate(children):
                if i in known:
                    below[i] = [("".join(digests[:k]), "".join(digests[k + 1 :])), *way]
        ways = below
    return ways


def _prove(wanted: DataFrame, leaves: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """row, tree, leaf and path of the wanted leaves(tree, n, idx, digest, row)."""
    fan = settings.fan
    wanted = wanted.withColumn("part", F.expr(f"idx div {settings.part}"))

    def name_missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, part), rows in runs(batches, "tree", "part"):
            for level, places in missing(np.unique([r["idx"] for r in rows]), rows[0]["n"], fan):
                k = len(places)
                if k:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([tree] * k, pa.int64()), pa.array([part] * k, pa.int64()), pa.array([level] * k, pa.int32()),
                        pa.array(places, pa.int64()),
                    ], names=["tree", "part", "level", "idx"])

    places = wanted.select("tree", "part", "n", "idx").repartition("tree", "part").sortWithinPartitions("tree", "part")
    asked = materialise(places.mapInArrow(name_missing, "tree bigint, part bigint, level int, idx bigint"), "merkle-missing")
    # Few levels, at most the height of a tree; levels that no part asks for are not read.
    levels = [r[0] for r in asked.select("level").distinct().collect()]
    stored = nodes.where(F.col("level").isin(levels)).select("tree", "level", "idx", "digest")
    if 0 in levels:
        stored = stored.unionAll(leaves.select("tree", F.lit(0).alias("level"), "idx", "digest"))
    fetched = asked.join(stored, ["tree", "level", "idx"])
    empty = F.lit(None).cast(wanted.schema["row"].dataType).alias("row")
    nothing = F.lit(None).cast("long").alias("n")
    both = fetched.select("tree", "part", F.lit(0).alias("kind"), "level", "idx", "digest", nothing, empty).unionAll(
        wanted.select("tree", "part", F.lit(1).alias("kind"), F.lit(0).alias("level"), "idx", "digest", "n", "row")
    )
    dealt = both.repartition("tree", "part").sortWithinPartitions("tree", "part", "kind", "level", "idx")

    def expand_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = {}

        def seen():
            for batch in batches:
                kind["row"] = batch.schema.field("row").type
                yield batch

        for (tree, _), rows in runs(seen(), "tree", "part"):
            near = {(r["level"], r["idx"]): r["digest"] for r in rows if not r["kind"]}
            rows = [r for r in rows if r["kind"]]
            ways = expand({r["idx"]: r["digest"] for r in rows}, near, rows[0]["n"], fan)
            paths = [ways[r["idx"]] for r in rows]
            steps = [s for path in paths for s in path]
            ends = np.cumsum([0, *map(len, paths)])
            sides = [pa.array([s[i] for s in steps], pa.string()) for i in (0, 1)]
            path = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(sides, names=["left", "right"]))
            yield pa.RecordBatch.from_arrays([
                pa.array([r["row"] for r in rows], kind["row"]), pa.array([tree] * len(rows), pa.int64()),
                pa.array([r["digest"] for r in rows], pa.string()), path,
            ], names=["row", "tree", "leaf", "path"])

    schema = T.StructType([
        wanted.schema["row"], T.StructField("tree", T.LongType()), T.StructField("leaf", T.StringType()),
        T.StructField("path", T.ArrayType(_STEP)),
    ])
    return dealt.mapInArrow(expand_part, schema)


def prove(manifest: Manifest, wanted: Column | None = None) -> DataFrame:
    """The carried columns, leaf, subroot, root and path of the leaves for which wanted(row, digest) holds; all if None."""
    chosen = manifest.leaves if wanted is None else manifest.leaves.where(wanted)
    proofs = _prove(chosen, manifest.leaves, manifest.nodes, manifest.settings)
    up = _prove(manifest.top_leaves, manifest.top_leaves, manifest.top_nodes, manifest.settings)
    up = up.select(F.col("row.sub").alias("tree"), F.col("leaf").alias("subroot"), F.col("path").alias("up"))
    up = materialise(up, "merkle-up")
    return proofs.join(up, "tree").select(
        "row.*", "leaf", "subroot", F.lit(manifest.root).alias("root"), F.concat("path", "up").alias("path"),
    )


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(path, digest, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """The SHA-256 of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)
