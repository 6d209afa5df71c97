"""Queries of the dictionary lane. Parts play the lexicon: their names' words are surfaces, their types' words domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexicon
from .registry import query, table

_LEX = r"""SELECT 'P' || p_partkey AS record_id, split_part(p_name, ' ', 1) AS lemma, list_distinct(string_split(p_name, ' ')) AS surfaces, [upper(p_brand)] AS readings, list_distinct(string_split(p_type, ' ')) AS pos, [p_brand] AS domains, p_type AS dataset,
  CASE WHEN p_partkey % 50 = 0 THEN '' ELSE 'L' || p_size % 3 END AS license, CASE p_partkey % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'odd' ELSE 'approved' END AS review_status FROM part"""


def _records(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("record_id"), F.split("p_name", " ")[0].alias("lemma"), F.array_distinct(F.split("p_name", " ")).alias("surfaces"), F.array(F.upper("p_brand")).alias("readings"), F.array_distinct(F.split("p_type", " ")).alias("pos"), F.array("p_brand").alias("domains"), F.col("p_type").alias("dataset"),
        F.when(F.col("p_partkey") % 50 == 0, "").otherwise(F.concat(F.lit("L"), (F.col("p_size") % 3).cast("string"))).alias("license"), F.when(F.col("p_partkey") % 7 == 0, "pending").when(F.col("p_partkey") % 7 == 1, "odd").otherwise("approved").alias("review_status"),
    )


_JOIN = "array_to_string(list_sort({}), '|')"


@query("record_normalize", f"SELECT record_id, lemma, {_JOIN.format('list_distinct(list_prepend(lemma, surfaces))')} AS surfaces FROM ({_LEX})")
def record_normalize(spark: SparkSession, sf: str) -> DataFrame:
    messy = _records(spark, sf).withColumn("surfaces", F.concat(F.transform("surfaces", lambda s: F.concat(F.lit(" "), s, F.lit(" "))), F.array(F.lit("")), "surfaces"))
    return lexicon.normalise(messy).select("record_id", "lemma", F.array_join(F.array_sort("surfaces"), "|").alias("surfaces"))


@query("record_validation", f"SELECT violation, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN review_status = 'odd' THEN 'review_status' END, CASE WHEN license = '' THEN 'license' END, CASE WHEN substr(record_id, 2)::INTEGER % 9 = 0 THEN 'restricted_to' END], lambda x: x IS NOT NULL)) AS violation FROM ({_LEX})) GROUP BY violation")
def record_validation(spark: SparkSession, sf: str) -> DataFrame:
    n = F.substring("record_id", 2, 20).cast("int")
    planted = _records(spark, sf).withColumn("restricted_to", F.when(n % 9 == 0, F.array(F.lit("no such surface"))).when(n % 9 == 1, F.slice("surfaces", 1, 1)))
    return lexicon.violations(planted).groupBy("violation").agg(F.count("*").alias("n"))


_FLAT = "list_sort(list_distinct(flatten(list({}))))"


@query("merge_duplicates", f"SELECT lemma, array_to_string(readings, '|') AS readings, min(record_id) AS record_id, array_to_string({_FLAT.format('surfaces')}, '|') AS surfaces, CAST(len(list_distinct(list(dataset))) AS INTEGER) AS datasets, count(*) AS merged FROM ({_LEX}) GROUP BY lemma, readings")
def merge_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.merge_duplicates(_records(spark, sf)).select("lemma", F.array_join("readings", "|").alias("readings"), "record_id", F.array_join("surfaces", "|").alias("surfaces"), F.size("datasets").alias("datasets"), "merged")


@query("dedup_keep_first", "SELECT min(doc_id) AS doc_id, sha256(text) AS digest, count(*) AS copies FROM documents GROUP BY text")
def dedup_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    """Exact copies by digest: the smallest id stays. Pre-aggregated, so that a third of all rows may be one text."""
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("inverted_index", f"SELECT key, CAST(len(ids) AS INTEGER) AS n, sha256(array_to_string(ids, ',')) AS digest FROM (SELECT key, list_sort(list(DISTINCT record_id)) AS ids FROM (SELECT record_id, unnest(surfaces) AS key FROM ({_LEX})) GROUP BY key)")
def inverted_index(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.inverted_index(_records(spark, sf), "surfaces").select("key", F.size("ids").alias("n"), F.sha2(F.array_join("ids", ","), 256).alias("digest"))


@query("homograph_index", f"SELECT key, CAST(n AS INTEGER) AS n FROM (SELECT key, count(DISTINCT record_id) AS n FROM (SELECT record_id, unnest(readings) AS key FROM ({_LEX})) GROUP BY key) WHERE n > 1")
def homograph_index(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.homographs(lexicon.inverted_index(_records(spark, sf), "readings")).select("key", F.size("ids").alias("n"))


@query("homograph_subset", "SELECT CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right")
def homograph_subset(spark: SparkSession, sf: str) -> DataFrame:
    """The homograph index is the surface index, filtered: no row on either side alone."""
    index = lexicon.inverted_index(_records(spark, sf), "readings")
    rebuilt = _records(spark, sf).select("record_id", F.explode("readings").alias("key")).groupBy("key").agg(F.array_sort(F.collect_set("record_id")).alias("ids")).where(F.size("ids") > 1)
    return lexicon.same_rows(lexicon.homographs(index), rebuilt)


@query("index_coverage", "SELECT CAST(0 AS BIGINT) AS unknown_ids")
def index_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of the index that no record has: a left anti join that must be empty."""
    records = _records(spark, sf)
    ids = lexicon.inverted_index(records, "surfaces").select(F.explode("ids").alias("record_id")).distinct()
    return ids.join(records, "record_id", "left_anti").agg(F.count("*").alias("unknown_ids"))


@query("index_manifest", f"SELECT count(*) AS records, {', '.join(f'(SELECT count(DISTINCT v) FROM (SELECT unnest({c}) AS v FROM ({_LEX}))) AS {c}' for c in lexicon.LISTS)} FROM ({_LEX})")
def index_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.manifest(_records(spark, sf))


@query("collision_report", f"SELECT surface, records, analyses, CASE WHEN analyses > 1 THEN 'homograph' ELSE 'duplicate' END AS kind FROM (SELECT surface, count(DISTINCT record_id) AS records, count(DISTINCT dataset) AS analyses FROM (SELECT record_id, unnest(surfaces) AS surface, dataset FROM ({_LEX})) GROUP BY surface) WHERE records > 1")
def collision_report(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.collisions(_records(spark, sf), ["dataset"])


@query("source_counts", f"SELECT dataset, license, review_status, count(*) AS n FROM ({_LEX}) GROUP BY ALL")
def source_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf).groupBy("dataset", "license", "review_status").agg(F.count("*").alias("n"))


@query("source_fidelity", "SELECT problem, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 10 = 0 THEN 'missing' WHEN p_partkey % 3 = 0 THEN 'p_size' END AS problem FROM part) WHERE problem IS NOT NULL GROUP BY problem")
def source_fidelity(spark: SparkSession, sf: str) -> DataFrame:
    """A copy that lacks every tenth part and is wrong in every third is found out."""
    source = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    built = source.where("p_partkey % 10 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return lexicon.fidelity(built, source, "p_partkey", ["p_name", "p_size"]).groupBy("problem").agg(F.count("*").alias("n"))


@query("fingerprint_conversations", "SELECT conv_id, sha256(string_agg(turn || '\x1f' || role || '\x1f' || coalesce(text, ''), chr(10) ORDER BY turn)) AS fingerprint FROM conversations GROUP BY conv_id")
def fingerprint_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.fingerprint(table(spark, sf, "conversations"), ["conv_id"], ["turn"], ["turn", "role", "text"])


@query("context_version", "SELECT conv_id, substr(sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)), 1, 16) AS version FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3 GROUP BY conv_id")
def context_version(spark: SparkSession, sf: str) -> DataFrame:
    """16 hex digits over the last three turns."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    grouped = table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    last = F.slice("t", F.greatest(F.lit(1), F.size("t") - 2), F.lit(3))
    return grouped.select("conv_id", F.substring(F.sha2(F.array_join(F.transform(last, lambda x: x["text"]), "\n"), 256), 1, 16).alias("version"))


@query("asset_chunks", "SELECT item_id, CAST(i AS INTEGER) AS part, substr(text, (i - 1) * 100 + 1, 100) AS piece, sha256(text) AS sha256 FROM (SELECT item_id, text, unnest(range(1, CAST(greatest(ceil(length(text) / 100.0), 1) AS INTEGER) + 1)) AS i FROM benchmark)")
def asset_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.in_chunks(table(spark, sf, "benchmark"), "item_id", "text", 100)


@query("asset_chunks_verified", "SELECT item_id, TRUE AS intact, CAST(length(text) AS INTEGER) AS size FROM benchmark")
def asset_chunks_verified(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.from_chunks(lexicon.in_chunks(table(spark, sf, "benchmark"), "item_id", "text", 100), "item_id").select("item_id", "intact", F.length("text").alias("size"))


@query("union_user_precedence", f"SELECT lemma, coalesce(u, s) AS owner FROM (SELECT lemma, min(record_id) FILTER (review_status = 'approved') AS s, min(record_id) FILTER (review_status = 'pending') AS u FROM ({_LEX}) GROUP BY lemma) WHERE coalesce(u, s) IS NOT NULL")
def union_user_precedence(spark: SparkSession, sf: str) -> DataFrame:
    """Two dictionaries by lemma, the user's entries before the system's: a full outer join."""
    r = _records(spark, sf)
    side = lambda status, name: r.where(F.col("review_status") == status).groupBy("lemma").agg(F.min("record_id").alias(name))
    return side("approved", "system").join(side("pending", "user"), "lemma", "full_outer").select("lemma", F.coalesce("user", "system").alias("owner"))


@query("required_difference", "SELECT DISTINCT p_type AS required FROM part EXCEPT SELECT p_type FROM part WHERE p_size > 5 AND p_type < 'L'")
def required_difference(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.col("p_type").alias("required")).distinct().subtract(p.where("p_size > 5 and p_type < 'L'").select("p_type"))
