"""SimHash near-duplicates, found by pigeonring filtering.

A fingerprint has a bit for each of 64 places, set if more than half of the text's shingle hashes have
it. Two fingerprints link at `max_bits` (three) or fewer differing bits. Four segments on a ring share that
budget, so some segment has none, and from some such segment on, every chain of l segments has at
most l * 3 / 4 differences, rounded down. Buckets hold fingerprints that agree in a segment and, within
the remaining ring of 48 bits, in one of its four segments; pairs must pass the chains of both rings before
their bits are counted in full. A bucket above `bucket` fingerprints is split by the next ring of
its remaining bits, again and again; each split loses no link, and as fingerprints are distinct, the last
one leaves 2^9 at most. Equal fingerprints are one node from the start, so copies never meet in pairs.

Components come from alternating large and small stars over the links, written out in every round.

Defined results: null and empty texts have fingerprint 0 and link like any other. A component's id is its
smallest id that is not null, null if it has none. Repeated rows share a fingerprint. Every row of an
input gives one row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from siftmark.llm.common import carried, drop_table, materialise, restored

SEED = 42
_CHUNK = 1 << 14


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit fingerprint. Lower case for A-Z only, words between ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(islice(words, k, None) for k in range(shingle)))), len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    while part := [xxhash.xxh64_intdigest(s, SEED) for s in islice(shingles, _CHUNK)]:
        hashes = np.array(part, np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(hashes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, shingle: int = 3, name: str = "fp") -> DataFrame:
    """All columns of docs and the fingerprint of text."""
    kept = [c for c in docs.columns if c != name]
    rows = docs.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), shingle) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(values, pa.int64())], names=[*kept, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())]))


def _split(rows: DataFrame, matched: int) -> tuple[DataFrame, int]:
    """Four rows each: the remaining bits turned so that one of their four segments comes next."""
    rest = 64 - matched
    size = rest // 4
    low = (1 << rest) - 1 if rest < 64 else -1
    turns = F.explode(F.array(*[F.lit(j) for j in range(4)])).alias("j")
    rows = rows.select("fp", "path", "start", "v", turns)
    turned = F.expr(f"(shiftleft(v & {low}L, j * {size}) | shiftrightunsigned(v & {low}L, {rest} - j * {size})) & {low}L" if rest < 64
                    else f"shiftleft(v, j * {size}) | shiftrightunsigned(v, 64 - j * {size})")
    v = turned if rest == 64 else turned.bitwiseOR(F.expr(f"v & {~low}L"))
    rows = rows.select(
        "fp", (F.col("path") * 4 + F.col("j")).alias("path"), F.when(F.col("start") < 0, F.col("j")).otherwise(F.col("start")).alias("start"),
        v.alias("v"),
    )
    return rows.withColumn("top", F.shiftrightunsigned("v", 64 - matched - size)), matched + size


def _chain(x: str, bits: int, budget: int) -> str:
    """Chains of one, two and three segments from the top of a ring of so many bits stay within their budgets."""
    size = bits // 4
    return " AND ".join(f"bit_count(shiftrightunsigned({x}, {bits - k * size})) <= {k * budget // 4}" for k in (1, 2, 3))


def links(fps: DataFrame, max_bits: int = 3, bucket: int = 512) -> DataFrame:
    """All pairs (a, b), a < b, of the distinct fingerprints in column fp that differ in max_bits or fewer."""
    if not 0 <= max_bits <= 3:
        raise ValueError("four segments need a budget of three bits at most")
    rows = fps.select("fp", F.lit(0).cast("long").alias("path"), F.lit(-1).alias("start"), F.col("fp").alias("v"))
    rows, matched = _split(rows, 0)
    found = None
    while True:
        ring = 64 - matched
        rows, matched = _split(rows, matched)
        counts = rows.groupBy("path", "top").agg(F.count("*").alias("n")).where(f"n > {bucket}")
        hot = materialise(counts.select(F.col("path").alias("hp"), F.col("top").alias("ht")), "simhash-hot")
        more = ring >= 8 and not hot.isEmpty()
        is_hot = (F.col("path") == F.col("hp")) & (F.col("top") == F.col("ht"))
        small = rows.join(hot, is_hot, "left_anti") if more else rows
        a = small.select("path", "top", "start", F.col("fp").alias("a"), F.col("v").alias("va"))
        b = small.select(F.col("path").alias("p2"), F.col("top").alias("t2"), F.col("fp").alias("b"), F.col("v").alias("vb"))
        outer = "(shiftleft(a ^ b, 16 * start) | shiftrightunsigned(a ^ b, 64 - 16 * start))"
        inner = f"((va ^ vb) & {(1 << ring) - 1}L)"
        passes = F.expr(f"{_chain(outer, 64, max_bits)} AND {_chain(inner, ring, max_bits)} AND bit_count(a ^ b) <= {max_bits}")
        pairs = a.join(b, (F.col("path") == F.col("p2")) & (F.col("top") == F.col("t2")) & (F.col("a") < F.col("b")) & passes)
        pairs = pairs.select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        if not more:
            return found.distinct()
        rows = materialise(rows.join(hot, is_hot, "left_semi"), "simhash-split")


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node that can be reached, for the nodes of edges (a, b)."""
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")

    def star(links: DataFrame, large: bool) -> DataFrame:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
        least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        least = least.withColumn("m", F.least("n", "m"))
        joined = both.join(least, F.col("u") == F.col("n"))
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(now)
    while before[0]:
        turned = materialise(star(star(now, True).where("u > v"), False), "stars")
        after = mark(turned)
        drop_table(now)
        now = turned
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def groups(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """fp, root and component_id of every distinct fingerprint; prints has doc_id and fp."""
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    stars = components(links(nodes.select("fp"), max_bits))
    nodes = nodes.join(stars, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = nodes.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id"))
    return nodes.join(ids, F.col("root") == F.col("r")).select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """doc_id, fingerprint and component_id for every row."""
    prints = materialise(with_fingerprint(docs.select("doc_id", "text"), shingle, "fp").select("doc_id", "fp"), "simhash-prints")
    found = groups(prints, max_bits).select(F.col("fp").alias("f"), "component_id")
    joined = prints.join(found, F.col("fp") == F.col("f"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """docs with one row of every component: the smallest id, and one of its rows if the id is repeated.

    Ids that are null come last; of rows alike in id and fingerprint the first read stays.
    """
    rows = carried(docs)
    rows = with_fingerprint(rows, shingle).withColumn("doc_id", F.col("row.doc_id")).withColumn("n", F.monotonically_increasing_id())
    # Written out whole: fingerprints cost more than a second copy, and every row keeps its number.
    rows = materialise(rows, "simhash-rows")
    found = groups(rows.select("doc_id", "fp"), max_bits).select(F.col("fp").alias("f"), "root")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("fp").alias("fp"), F.col("n").alias("n"))
    # One row per fingerprint first: equal ones may be a third of all.
    firsts = rows.groupBy("fp").agg(F.min(order).alias("w"))
    winners = firsts.join(found, F.col("fp") == F.col("f")).groupBy("root").agg(F.min("w").alias("w"))
    winners = materialise(winners.select(F.col("w.n").alias("winner")), "simhash-winners")
    return restored(rows.join(winners, F.col("n") == F.col("winner"), "left_semi"), docs.columns)
