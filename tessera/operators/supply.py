"""Dictionary supply: candidates and provenance from loose records, proposals, gold cases, validations, overrides, pack choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import stable_id


def first_present(*columns: str) -> Column:
    """The first of several spellings of a field that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns])


def candidates(records: DataFrame, ident: str, lists: list[str]) -> DataFrame:
    """ident, candidate_id, label of the first non-empty list; a record without any gets one unresolved shell."""
    chosen = F.coalesce(*[F.when(F.size(c) > 0, F.col(c)) for c in lists], F.array(F.lit(None).cast("string")))
    each = records.select(ident, F.posexplode(chosen).alias("_i", "label"))
    number = F.concat(F.col(ident).cast("string"), F.lit("-m"), (F.col("_i") + 1).cast("string"))
    return each.select(ident, number.alias("candidate_id"), F.coalesce("label", F.lit("")).alias("label"), F.col("label").isNotNull().alias("resolved"))


def proposals(records: DataFrame, ident: str, lemma: str, aliases: str) -> DataFrame:
    """A record's proposals: itself as lexicon entry, its aliases as synonyms, a rule where the lemma has two words at least; each with a stable id."""
    base = records.select(ident, F.col(lemma).alias("surface"), F.lit("lexicon").alias("kind"))
    synonym = records.select(ident, F.explode(aliases).alias("surface"), F.lit("synonym").alias("kind"), F.col(lemma).alias("_l")).where("surface <> _l").drop("_l")
    rule = records.where(F.contains(F.col(lemma), F.lit(" "))).select(ident, F.col(lemma).alias("surface"), F.lit("rule").alias("kind"))
    return base.unionByName(synonym).unionByName(rule).withColumn("proposal_id", stable_id("prop", F.col("kind"), F.col(ident), F.col("surface")))


def bundle(proposals_: DataFrame) -> DataFrame:
    """Counts by kind with a digest over the sorted ids of each."""
    return proposals_.groupBy("kind").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("proposal_id")), ","), 256).alias("digest"))


def gold_cases(items: DataFrame, ident: str, surface: str) -> DataFrame:
    """Positive, negative and boundary cases of each item by template."""
    cases = F.array(*[F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(before), F.col(surface), F.lit(after)).alias("text")) for kind, before, after in (("positive", "use ", " now"), ("negative", "do not use ", ""), ("boundary", "\"", "\""))])
    return items.select(ident, F.explode(cases).alias("c")).select(ident, "c.kind", "c.text")


def evidence_problems(rows: DataFrame, ident: str, digest: str, url: str, license_: str) -> DataFrame:
    """What is wrong with evidence: digest not 64 hex digits, url not public http, no license."""
    found = F.array_compact(F.array(F.when(~F.coalesce(F.col(digest).rlike("^[0-9a-fA-F]{64}$"), F.lit(False)), "digest"), F.when(~F.coalesce(F.col(url).rlike("^https?://[^/]+"), F.lit(False)), "url"), F.when(F.coalesce(F.trim(F.col(license_)), F.lit("")) == "", "license")))
    return rows.select(ident, F.explode(found).alias("problem"))


def inventory(rows: DataFrame, ident: str, surface: str, category: str, expected: DataFrame) -> DataFrame:
    """check, subject, found, wanted: ids and normalised surfaces that repeat, and categories whose count is not as expected (category, n)."""
    norm = F.regexp_replace(F.lower(surface), r"[^\p{L}\p{N}]+", "")
    repeat = lambda name, key: rows.groupBy(key.cast("string").alias("subject")).agg(F.count("*").alias("found")).where("found > 1").select(F.lit(name).alias("check"), "subject", "found", F.lit(1).cast("long").alias("wanted"))
    counts = rows.groupBy(F.col(category).alias("subject")).agg(F.count("*").alias("found")).join(expected.select(F.col("category").alias("subject"), F.col("n").cast("long").alias("wanted")), "subject", "full_outer")
    off = counts.where(~F.col("found").eqNullSafe(F.col("wanted"))).select(F.lit("category").alias("check"), "subject", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("wanted", F.lit(0)).alias("wanted"))
    return repeat("id", F.col(ident)).unionByName(repeat("surface", norm)).unionByName(off)


def override(cases: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cases with the fields that a change gives, and changes whose case is unknown."""
    c = changes.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    out = cases.join(c, key, "left").select(*[F.coalesce(f"_{x}", x).alias(x) if x in fields else F.col(x) for x in cases.columns])
    return out, changes.join(cases, key, "left_anti")


def pack_select(scored: DataFrame, keys: list[str], ident: str, margin: int = 20) -> DataFrame:
    """The best pack candidate: a single one, or one that is `margin` ahead; negative scores are out."""
    w = W.partitionBy(*keys)
    ranked = scored.where("score >= 0").withColumn("_n", F.row_number().over(w.orderBy(F.desc("score"), ident))).withColumn("_second", F.lead("score").over(w.orderBy(F.desc("score"), ident))).withColumn("_all", F.count("*").over(w))
    gap = F.col("score") - F.coalesce("_second", F.lit(0))
    status = F.when((F.col("_all") == 1) | (gap >= margin), "RESOLVED").otherwise("AMBIGUOUS")
    return ranked.where("_n = 1").select(*keys, ident, "score", status.alias("status"), F.round(F.least(F.lit(0.99), F.lit(0.7) + gap / 100), 4).alias("confidence"))


def compact_packs(rows: DataFrame, key: str, pack: str, expected: int) -> DataFrame:
    """pack, members (sorted ids): and one row with a null pack where the distinct ids are not as many as expected."""
    grouped = rows.groupBy(pack).agg(F.array_sort(F.collect_set(key)).alias("members"))
    wrong = rows.agg(F.count_distinct(key).alias("_n")).where(F.col("_n") != expected).select(F.lit(None).cast(dict(rows.dtypes)[pack]).alias(pack), F.array().cast(f"array<{dict(rows.dtypes)[key]}>").alias("members"))
    return grouped.unionByName(wrong)
