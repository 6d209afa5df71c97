"""The review lane: flags, triage, decisions, packs, proposals, accuracy, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..lineage import stage

#: Ordered statuses; the first with a flag wins.
TRIAGE = [("blocked", ["no-source", "no-license"]), ("artifact", ["substring"]), ("mismatch", ["category"]), ("high-risk", ["risky"])]


def flags(checks: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in checks.items()]))


def triage(flag_list: Column) -> Column:
    out = None
    for status, names in TRIAGE:
        hit = F.arrays_overlap(flag_list, F.array(*[F.lit(n) for n in names]))
        out = F.when(hit, status) if out is None else out.when(hit, status)
    return out.otherwise("ready")


def apply_decisions(rows: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Rows with their next status: the decision's where there is one, else their own."""
    return rows.join(decisions.select(key, F.col("decision").alias("_d")), key, "left").withColumn("next_status", F.coalesce("_d", "status")).drop("_d")


def coverage(targets: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """One row: targets without a decision, decisions without a target, and both."""
    both = targets.select(key, F.lit(1).alias("t")).join(decisions.select(key, F.lit(1).alias("d")), key, "full_outer")
    return both.agg(F.count_if(F.col("d").isNull()).alias("undecided"), F.count_if(F.col("t").isNull()).alias("unknown"), F.count_if(F.col("t").isNotNull() & F.col("d").isNotNull()).alias("decided"))


def numbered(rows: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """Rows with their number (from 0) within the keys by `order`, which must tell rows apart.

    Rows are dealt by ranges of (keys, order), numbered within each range, and moved on by what the ranges before hold: few keys do not make few tasks.
    """
    dealt = stage(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    held = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = held.withColumn("_before", F.sum("_n").over(W.partitionBy(*keys).orderBy("_range")) - F.col("_n")).drop("_n")
    within = dealt.withColumn("_at", F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order)))
    return within.join(before, [*keys, "_range"]).withColumn(name, F.col("_before") + F.col("_at") - 1).drop("_range", "_before", "_at")


def packs(rows: DataFrame, keys: list[str], order: list, size: int) -> DataFrame:
    """Rows with pack (from 0): chunks of `size` within the keys."""
    return numbered(rows, keys, order, "_number").withColumn("pack", F.floor(F.col("_number") / size)).drop("_number")


def proposal_score(parts: dict[str, tuple[Column, int]]) -> Column:
    """Points of the parts that hold, 100 at most."""
    return F.least(F.lit(100), sum((F.when(hit, points).otherwise(0) for hit, points in parts.values()), F.lit(0)))


def macro_accuracy(cases: DataFrame, category: str, passed: str) -> DataFrame:
    """One row: micro accuracy, and the mean of the categories' accuracies."""
    per = cases.groupBy(category).agg(F.avg(F.col(passed).cast("double")).alias("a"), F.count("*").alias("n"), F.sum(F.col(passed).cast("long")).alias("p"))
    return per.agg(F.round(F.avg("a"), 6).alias("macro"), F.round(F.sum("p") / F.sum("n"), 6).alias("micro"), F.count("*").alias("categories"))


def nearest_rank(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """The value at index min(floor(n * share), n - 1) of the sorted values, for each share."""
    # equal values are counted before anything is sorted
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = W.partitionBy(*keys)
    ranked = counts.withColumn("_to", F.sum("_c").over(w.orderBy(value))).withColumn("_n", F.sum("_c").over(w))
    at = lambda s: F.least(F.floor(F.col("_n") * s), F.col("_n") - 1)
    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("_to") > at(s), F.col(value))).alias(f"p{int(s * 100)}") for s in shares], F.max(value).alias("longest"), F.sum("_c").alias("n"))


def hash_sample(rows: DataFrame, column: str, size: int) -> DataFrame:
    """The same `size` rows always: the smallest SHA-256 of a column."""
    return rows.orderBy(F.sha2(F.col(column).cast("string"), 256), column).limit(size)


def conflicts(proposals: DataFrame, known: DataFrame, surface: str, owner: str) -> DataFrame:
    """Proposals whose surface is taken, with who has it."""
    return proposals.join(known.groupBy(surface).agg(F.array_sort(F.collect_set(owner)).alias("owners")), surface)


def gold_override(cases: DataFrame, key: str, version: str) -> DataFrame:
    """The last version of each case."""
    return cases.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(version)))).where("_n = 1").drop("_n")


def transitions(rows: DataFrame, before: str, after: str) -> DataFrame:
    return rows.groupBy(before, after).agg(F.count("*").alias("n"))
