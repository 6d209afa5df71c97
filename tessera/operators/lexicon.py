"""The batch dictionary lane: record normalisation, merging, inverted indexes, collisions, audits.

A lexicon record: record_id, lemma, surfaces array<string>, readings array<string>, pos array<string>, domains array<string>, dataset, license, review_status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LISTS = ["surfaces", "readings", "pos", "domains"]


def normalise(records: DataFrame) -> DataFrame:
    """Trimmed lemma, lists without blanks and repeats in their order; the lemma is always a surface."""
    out = records.withColumn("lemma", F.trim(F.regexp_replace("lemma", "[ \t\n\r]+", " ")))
    for name in LISTS:
        out = out.withColumn(name, F.array_distinct(F.filter(F.transform(F.coalesce(name, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))))
    return out.withColumn("surfaces", F.array_distinct(F.concat(F.array("lemma"), "surfaces")))


def violations(records: DataFrame) -> DataFrame:
    """record_id, violation: what a record lacks; a repeated id counts for each of its rows. A column restricted_to, where there is one, must name surfaces of the record."""
    many = F.count("*").over(W.partitionBy("record_id"))
    checks = F.array_compact(F.array(
        F.when(F.coalesce(F.col("record_id"), F.lit("")) == "", "record_id"), F.when(F.coalesce(F.col("lemma"), F.lit("")) == "", "lemma"), F.when(many > 1, "duplicate_id"),
        F.when(~F.coalesce(F.col("review_status"), F.lit("")).isin("approved", "pending", "rejected"), "review_status"), F.when(F.coalesce(F.col("license"), F.lit("")) == "", "license"),
        *([F.when(F.size(F.array_except(F.coalesce("restricted_to", F.array().cast("array<string>")), F.coalesce("surfaces", F.array().cast("array<string>")))) > 0, "restricted_to")] if "restricted_to" in records.columns else []),
    ))
    return records.withColumn("violation", checks).select("record_id", F.explode("violation").alias("violation"))


def merge_duplicates(records: DataFrame) -> DataFrame:
    """One record for each lemma and sorted readings: the smallest id, all lists joined without repeats (sorted), all datasets."""
    keyed = records.withColumn("_readings", F.array_sort(F.array_distinct("readings")))
    merged = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in LISTS if c != "readings"]
    return keyed.groupBy("lemma", F.col("_readings").alias("readings")).agg(F.min("record_id").alias("record_id"), *merged, F.array_sort(F.collect_set("dataset")).alias("datasets"), F.count("*").alias("merged"))


def dedup_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def inverted_index(records: DataFrame, column: str, ident: str = "record_id") -> DataFrame:
    """key, ids (sorted, distinct) of the values of a list column."""
    return records.select(ident, F.explode(column).alias("key")).groupBy("key").agg(F.array_sort(F.collect_set(ident)).alias("ids"))


def homographs(index: DataFrame) -> DataFrame:
    return index.where(F.size("ids") > 1)


def manifest(records: DataFrame) -> DataFrame:
    """One row of exact counts over the list columns."""
    out = records.agg(F.count("*").alias("records"))
    for name in LISTS:
        out = out.crossJoin(F.broadcast(records.select(F.explode(name).alias("v")).agg(F.count_distinct("v").alias(name))))  # one row by one row
    return out


def collisions(records: DataFrame, signature: list[str]) -> DataFrame:
    """Surfaces of two records at least: how many, and whether their analyses agree."""
    each = records.select("record_id", F.explode("surfaces").alias("surface"), F.struct(*signature).alias("sig"))
    found = each.groupBy("surface").agg(F.count_distinct("record_id").alias("records"), F.count_distinct("sig").alias("analyses"))
    return found.where("records > 1").withColumn("kind", F.when(F.col("analyses") > 1, "homograph").otherwise("duplicate"))


def fidelity(built: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Where a built table differs from its source: key, problem (missing, extra or the column)."""
    a = built.select(key, F.struct(*columns).alias("b"))
    s = source.select(key, F.struct(*columns).alias("s"))
    both = a.join(s, key, "full_outer")
    differs = F.array_compact(F.array(*[F.when(F.col("b").isNotNull() & F.col("s").isNotNull() & ~F.col(f"b.{c}").eqNullSafe(F.col(f"s.{c}")), c) for c in columns]))
    problems = F.when(F.col("b").isNull(), F.array(F.lit("missing"))).when(F.col("s").isNull(), F.array(F.lit("extra"))).otherwise(differs)
    return both.select(key, F.explode(problems).alias("problem"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows that either side has alone; a rebuilt asset that is not stale gives 0 and 0."""
    left, right = a.exceptAll(b).agg(F.count("*").alias("only_left")), b.exceptAll(a).agg(F.count("*").alias("only_right"))
    return left.crossJoin(F.broadcast(right))  # one row by one row


def fingerprint(rows: DataFrame, keys: list[str], order: list[str], parts: list[str]) -> DataFrame:
    """SHA-256 over a group's rows in order, each as its parts, nulls as empty."""
    line = F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    ordered = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["_line"]), "\n"), 256).alias("fingerprint"))


def in_chunks(rows: DataFrame, ident: str, value: str, size: int) -> DataFrame:
    """ident, part (from 1), piece, sha256: a long text in pieces of `size` characters, with the digest of the whole."""
    n = F.ceil(F.length(value) / F.lit(size)).cast("int")
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(i.alias("part"), F.substring(F.col(value), ((i - 1) * size + 1).cast("int"), F.lit(size)).alias("piece")))
    return rows.select(ident, F.sha2(value, 256).alias("sha256"), F.explode(pieces).alias("p")).select(ident, "p.part", "p.piece", "sha256")


def from_chunks(pieces: DataFrame, ident: str) -> DataFrame:
    """Texts put together again, with whether the digest holds."""
    whole = pieces.groupBy(ident).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "piece"))), lambda x: x["piece"]), "").alias("text"), F.min("sha256").alias("sha256"))
    return whole.withColumn("intact", F.sha2("text", 256) == F.col("sha256"))
