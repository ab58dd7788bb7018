"""Mix sources to target weights by Pareto order sampling.

Every document expects `rate * bias` copies, three at most. The whole part is allocated for certain;
the rest is an inclusion probability p. Documents are ranked by random odds over inclusion odds,
(u / (1 - u)) / (p / (1 - p)), and each source takes them in that order until its words reach the
target. The size that is fixed is thus the number of words, not of documents.

No source meets in one task: shares come from one row per source, rates from at most 64 length levels
per source, and the cut from a histogram of ranks whose one boundary bin is ordered exactly.

Defined results: a null text has size 0 and takes 0; null sources are one source, the last; an empty
table gives no rows. Repeated rows have equal ranks and are taken or left together. The random
numbers are hashes of seed, id, source and size, so reruns agree. Columns named as a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siftmark.llm.common import drop_table, materialise, ranked

RESULTS = ("size", "source_size", "target", "copies", "taken")


@dataclass(frozen=True)
class Mix:
    """weights repeat over the sources by code point; bias is the power of the length that odds grow with."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    most_copies: float = 3.0
    bias: float = 0.25
    seed: int = 20240601
    bins: int = 1 << 16


def _level(size: Column) -> Column:
    """Documents of about the same length share a level: the number of binary digits of the size."""
    return F.when(size > 0, F.floor(F.log2(size.cast("double")))).otherwise(0).cast("int")


def _odds(mix: Mix, p: Column) -> Column:
    """Rank of a row in (0, 1), rising with its odds ratio; null without a chance to be drawn."""
    h = F.xxhash64(F.lit(mix.seed), F.col("_id"), F.col("_source"), F.col("_size"))
    u = (F.shiftrightunsigned(h, 12).cast("double") + 0.5) * (2.0 ** -52)
    up, down = u * (1 - p), (1 - u) * p
    return F.when(p > 0, up / (up + down))


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """_source, source_size and target per source: weights share all words, capped and shared again."""
    found = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    rows = ranked(found, "mix-sources", F.col("_source").asc_nulls_last())
    weight = F.array(*[F.lit(float(w)) for w in mix.weights])
    rows = rows.withColumn("w", F.get(weight, ((F.col("rank") - 1) % len(mix.weights)).cast("int")))
    rows = materialise(rows.withColumn("most", mix.most_copies * F.col("source_size")), "mix-targets")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    capped = F.lit(False)
    left, share = total, rows.agg(F.sum("w")).first()[0] or 1.0
    while True:
        # Sources whose share exceeds their most are fixed there; the others share what is left.
        over = capped | (F.lit(float(left)) * F.col("w") / F.lit(share) > F.col("most"))
        got = rows.agg(
            F.sum(F.when(over, F.col("most"))).alias("fixed"), F.sum(F.when(~over, F.col("w"))).alias("share"),
            F.count(F.when(over & ~capped, 1)).alias("new"),
        ).first()
        if not got.new or not got.share:
            capped = over if got.new else capped
            break
        left, share = total - got.fixed, got.share
        capped = over
    target = F.when(capped, F.col("most")).otherwise(F.lit(float(left)) * F.col("w") / F.lit(share))
    return rows.select("_source", "source_size", target.cast("double").alias("target"))


def _rates(sizes: DataFrame, goal: DataFrame, mix: Mix) -> DataFrame:
    """Expected copies per (source, level), so that each source's expected words are its target.

    Copies are min(most, c * bias). Levels come by falling bias; c is the first that leaves the
    level at hand, and so all below it, within the most.
    """
    levels = sizes.where("_size > 0").groupBy("_source", "_level").agg(F.sum("_size").alias("words"))
    bias = F.pow(F.lit(2.0), mix.bias * F.col("_level"))
    levels = levels.join(goal.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    order = W.partitionBy("_source").orderBy(F.col("_level").desc())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    c = (F.col("target") - mix.most_copies * F.coalesce(F.sum("words").over(before), F.lit(0))) / F.sum(F.col("words") * bias).over(after)
    fits = F.when(c * bias <= mix.most_copies * (1 + 1e-9), c)
    first = F.first("fits", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rate = F.least(F.lit(mix.most_copies), F.greatest(F.lit(0.0), F.col("c") * bias))
    # A probability within rounding of 0 or 1 is one.
    near = F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate)
    return levels.withColumn("fits", fits).withColumn("c", first).select("_source", "_level", "words", near.alias("rate"))


def plan(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per source: target, copies expected by level, and the last rank that is drawn.

    sizes has _id, _source and _size, one row per document.
    """
    rows = materialise(sizes.select("_id", "_source", "_size", _level(F.col("_size")).alias("_level")), "mix-sizes")
    goal = materialise(targets(rows, mix), "mix-goal")
    rates = materialise(_rates(rows, goal, mix), "mix-rates")
    per_source = rates.groupBy("_source").agg(
        F.map_from_entries(F.collect_list(F.struct("_level", "rate"))).alias("rates"),
        F.sum(F.col("words") * F.floor("rate")).alias("sure"),
    )
    per_source = goal.join(per_source.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    per_source = materialise(per_source, "mix-per-source")

    drawn = _with_rank(rows, per_source, mix).where("_rank is not null")
    spot = F.floor(F.col("_rank") * mix.bins)
    bins = drawn.groupBy("_source", spot.alias("bin")).agg(F.sum("_size").alias("words"))
    need = per_source.select(F.col("_source").alias("_s"), (F.col("target") - F.coalesce("sure", F.lit(0))).alias("need"))
    bins = bins.join(need, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    up_to = F.sum("words").over(W.partitionBy("_source").orderBy("bin"))
    cut = bins.withColumn("before", up_to - F.col("words")).where("before < need and before + words >= need")
    cut = materialise(cut.select(F.col("_source").alias("_s"), "bin", "before", "need"), "mix-cut")
    edge = drawn.withColumn("bin_", spot).join(cut, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("bin_") == F.col("bin")))
    so_far = F.col("before") + F.sum("_size").over(W.partitionBy("_source").orderBy("_rank"))
    edge = edge.withColumn("off", F.abs(so_far - F.col("need")))
    # The cut that comes nearest to the target; before the bin's first row counts as well.
    last = edge.groupBy("_source").agg(
        F.min_by("_rank", F.struct("off", "_rank")).alias("rank_in"), F.min("off").alias("off"),
        F.first(F.abs(F.col("before") - F.col("need"))).alias("off_before"), F.first("bin").alias("bin"),
    ).select(
        F.col("_source").alias("_s"),
        F.when(F.col("off") <= F.col("off_before"), F.col("rank_in")).otherwise(F.col("bin") / mix.bins - 2.0 ** -60).alias("last_rank"),
    )
    result = materialise(per_source.join(last, F.col("_source").eqNullSafe(F.col("_s")), "left").select(
        "_source", "source_size", "target", "rates",
        # No boundary: all that may be drawn is wanted, or nothing is.
        F.when(F.col("last_rank").isNotNull(), F.col("last_rank")).when(F.col("target") > F.coalesce("sure", F.lit(0)) + 0.5, 2.0).otherwise(-1.0).alias("last_rank"),
    ), "mix-plan")
    for used in (rows, goal, rates, per_source, cut):
        drop_table(used)
    return result


def _with_rank(rows: DataFrame, per_source: DataFrame, mix: Mix) -> DataFrame:
    known = per_source.withColumnRenamed("_source", "_s")
    rows = rows.join(known, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("_rate", F.coalesce(F.get(F.map_values(F.map_filter("rates", lambda k, _: k == F.col("_level"))), F.lit(0)), F.lit(0.0)))
    return rows.withColumn("_rank", _odds(mix, F.col("_rate") - F.floor("_rate")))


def apply_plan(docs: DataFrame, per_source: DataFrame, size: Column, key: str = "doc_id", source: str = "source", mix: Mix = Mix()) -> DataFrame:
    """docs with size, source_size, target, copies and taken, decided row by row from the plan.

    Columns of docs travel as one struct, so their names meet none of the plan's.
    """
    keep = [F.col(c) for c in docs.columns if c not in RESULTS]
    rows = docs.select(F.struct(*keep).alias("row"), F.col(key).alias("_id"), F.col(source).alias("_source"), size.alias("_size"))
    rows = _with_rank(rows.withColumn("_level", _level(F.col("_size"))), per_source, mix)
    copies = F.floor("_rate") + F.coalesce((F.col("_rank") <= F.col("last_rank")).cast("long"), F.lit(0))
    rows = rows.withColumn("_copies", F.when(F.col("_size") > 0, copies).otherwise(0).cast("long"))
    return rows.select(
        "row.*", F.col("_size").alias("size"), "source_size", "target", F.col("_copies").alias("copies"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


def mix_sources(docs: DataFrame, size: Column, key: str = "doc_id", source: str = "source", mix: Mix = Mix()) -> DataFrame:
    """Plan on the narrow columns, then decide every row of docs."""
    narrow = docs.select(F.col(key).alias("_id"), F.col(source).alias("_source"), size.alias("_size"))
    return apply_plan(docs, plan(narrow, mix), size, key, source, mix)
