"""Queries of the dictionary supply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexicon, review, supply
from . import dims
from .registry import query, table

_REC = [(1, ["a", "b"], ["x"], "S", None, ""), (2, [], ["y"], None, "T", ""), (3, [], [], "", " ", "U"), (4, ["c"], [], None, None, None)]
_REC_SQL = dims.duck(_REC, ["id", "meanings", "glosses", "source", "dataset", "origin"])
_REC_COLUMNS = "id int, meanings array<string>, glosses array<string>, source string, dataset string, origin string"


@query("meaning_candidates", f"SELECT id, id || '-m' || i AS candidate_id, coalesce(l[i], '') AS label, l[i] IS NOT NULL AS resolved FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT id, CASE WHEN len(meanings) > 0 THEN meanings WHEN len(glosses) > 0 THEN glosses ELSE [NULL] END AS l FROM {_REC_SQL}))")
def meaning_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return supply.candidates(dims.values(spark, _REC, _REC_COLUMNS), "id", ["meanings", "glosses"])


@query("provenance_coalesce", f"SELECT id, coalesce(nullif(trim(source), ''), nullif(trim(dataset), ''), nullif(trim(origin), '')) AS dataset FROM {_REC_SQL}")
def provenance_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    return dims.values(spark, _REC, _REC_COLUMNS).select("id", supply.first_present("source", "dataset", "origin").alias("dataset"))


_PROPOSALS = """SELECT p_partkey, surface, kind, 'prop-' || substr(sha256(kind || '␟' || p_partkey || '␟' || surface), 1, 20) AS proposal_id FROM (
  SELECT p_partkey, p_name AS surface, 'lexicon' AS kind FROM part UNION ALL SELECT p_partkey, w, 'synonym' FROM (SELECT p_partkey, p_name, unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w <> p_name UNION ALL SELECT p_partkey, p_name, 'rule' FROM part WHERE contains(p_name, ' '))"""


def _proposals(spark: SparkSession, sf: str) -> DataFrame:
    return supply.proposals(table(spark, sf, "part").withColumn("aliases", F.split("p_name", " ")), "p_partkey", "p_name", "aliases")


@query("proposal_generation", _PROPOSALS)
def proposal_generation(spark: SparkSession, sf: str) -> DataFrame:
    return _proposals(spark, sf)


@query("proposal_bundle", f"SELECT kind, count(*) AS n, sha256(string_agg(proposal_id, ',' ORDER BY proposal_id)) AS digest FROM ({_PROPOSALS}) GROUP BY kind")
def proposal_bundle(spark: SparkSession, sf: str) -> DataFrame:
    return supply.bundle(_proposals(spark, sf))


@query("gold_candidates", "SELECT p_partkey, 'positive' AS kind, 'use ' || p_name || ' now' AS text FROM part UNION ALL SELECT p_partkey, 'negative', 'do not use ' || p_name FROM part UNION ALL SELECT p_partkey, 'boundary', '\"' || p_name || '\"' FROM part")
def gold_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return supply.gold_cases(table(spark, sf, "part"), "p_partkey", "p_name")


_EVIDENCE = "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'short' ELSE sha256(url) END AS digest, CASE WHEN page_id % 7 = 0 THEN 'ftp://x' ELSE url END AS url, CASE WHEN page_id % 11 = 0 THEN ' ' ELSE 'CC' END AS license FROM pages"


@query("evidence_validation", f"SELECT problem, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN NOT regexp_matches(digest, '^[0-9a-fA-F]{{64}}$') THEN 'digest' END, CASE WHEN NOT regexp_matches(url, '^https?://[^/]+') THEN 'url' END, CASE WHEN trim(license) = '' THEN 'license' END], lambda x: x IS NOT NULL)) AS problem FROM ({_EVIDENCE})) GROUP BY problem")
def evidence_validation(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    rows = p.select("page_id", F.when(F.col("page_id") % 5 == 0, "short").otherwise(F.sha2("url", 256)).alias("digest"), F.when(F.col("page_id") % 7 == 0, "ftp://x").otherwise(F.col("url")).alias("url"), F.when(F.col("page_id") % 11 == 0, " ").otherwise("CC").alias("license"))
    return supply.evidence_problems(rows, "page_id", "digest", "url", "license").groupBy("problem").agg(F.count("*").alias("n"))


_EXPECTED = [("en", 500), ("de", 1), ("it", 3)]
_EXPECTED_SQL = dims.duck(_EXPECTED, ["category", "n"])


@query(
    "inventory_validation",
    rf"""SELECT 'id' AS "check", CAST(doc_id AS VARCHAR) AS subject, count(*) AS found, CAST(1 AS BIGINT) AS wanted FROM documents GROUP BY doc_id HAVING count(*) > 1
    UNION ALL SELECT 'surface', regexp_replace(lower(source), '[^\p{{L}}\p{{N}}]+', '', 'g') AS s, count(*), 1 FROM documents GROUP BY s HAVING count(*) > 1
    UNION ALL SELECT 'category', coalesce(lang, category), coalesce(c, 0), coalesce(n, 0) FROM (SELECT lang, count(*) AS c FROM documents GROUP BY lang) FULL JOIN {_EXPECTED_SQL} ON lang = category WHERE c IS DISTINCT FROM n""",
)
def inventory_validation(spark: SparkSession, sf: str) -> DataFrame:
    return supply.inventory(table(spark, sf, "documents"), "doc_id", "source", "lang", dims.values(spark, _EXPECTED, "category string, n int"))


@query("override_apply", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders")
def override_apply(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    changes = orders.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(None).cast("string").alias("o_orderpriority"))
    return supply.override(orders, changes, "o_orderkey", ["o_orderstatus", "o_orderpriority"])[0]


@query("override_unknown", "SELECT CAST(1 AS BIGINT) AS unknown")
def override_unknown(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    changes = orders.where("o_orderkey = 1").unionByName(spark.sql("SELECT -5L AS o_orderkey, 'X' AS o_orderstatus"))
    return supply.override(orders, changes, "o_orderkey", ["o_orderstatus"])[1].agg(F.count("*").alias("unknown"))


_PACK = [(1, "m1", 140), (1, "m2", 125), (2, "m1", 165), (2, "m3", 120), (3, "m4", 100), (4, "m5", -9900), (5, "m6", 100), (5, "m7", -10000)]
_PACK_SQL = dims.duck(_PACK, ["tok", "pack", "score"])


@query("pack_score_select", f"SELECT tok, pack, score, CASE WHEN total = 1 OR score - coalesce(second, 0) >= 20 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status, round(least(0.99, 0.7 + (score - coalesce(second, 0)) / 100.0), 4) AS confidence FROM (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second, count(*) OVER (PARTITION BY tok) AS total FROM {_PACK_SQL} WHERE score >= 0 WINDOW w AS (PARTITION BY tok ORDER BY score DESC, pack)) WHERE n = 1")
def pack_score_select(spark: SparkSession, sf: str) -> DataFrame:
    return supply.pack_select(dims.values(spark, _PACK, "tok int, pack string, score int"), ["tok"], "pack")


@query("pack_compaction", "SELECT pack, sha256(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS digest, CAST(count(*) AS INTEGER) AS n FROM (SELECT doc_id, CAST(floor((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) / 20) AS BIGINT) AS pack FROM documents) GROUP BY pack")
def pack_compaction(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    packed = review.packs(docs, ["lang"], ["doc_id"], 20).select("doc_id", "pack")
    whole = supply.compact_packs(packed, "doc_id", "pack", docs.distinct().count())
    return whole.select("pack", F.sha2(F.array_join(F.transform("members", lambda x: x.cast("string")), ","), 256).alias("digest"), F.size("members").alias("n"))


@query("rebuild_determinism", "SELECT TRUE AS same")
def rebuild_determinism(spark: SparkSession, sf: str) -> DataFrame:
    """Two builds of an index over differently dealt rows have one fingerprint."""

    def build(parts: int) -> DataFrame:
        records = table(spark, sf, "part").repartition(parts).select("p_partkey", F.split("p_name", " ").alias("surfaces"))
        index = lexicon.inverted_index(records, "surfaces", "p_partkey").select(F.lit(1).alias("k"), "key", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
        return lexicon.fingerprint(index, ["k"], ["key"], ["key", "ids"])

    return build(3).join(build(5).withColumnRenamed("fingerprint", "other"), "k").select((F.col("fingerprint") == F.col("other")).alias("same"))


@query("case_evaluation", "SELECT lang AS category, count(*) AS n, CAST(sum(CASE lang WHEN 'en' THEN CAST(contains(text, ' the ') AS BIGINT) WHEN 'de' THEN CAST(contains(text, ' der ') OR contains(text, ' die ') AS BIGINT) WHEN 'fr' THEN CAST(contains(text, ' le ') OR contains(text, ' de ') AS BIGINT) ELSE CAST(contains(text, ' de ') AS BIGINT) END) AS BIGINT) AS passed FROM documents GROUP BY lang")
def case_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Cases checked by their category's own predicate."""
    has = lambda w: F.contains("text", F.lit(f" {w} "))
    ok = F.when(F.col("lang") == "en", has("the")).when(F.col("lang") == "de", has("der") | has("die")).when(F.col("lang") == "fr", has("le") | has("de")).otherwise(has("de"))
    return table(spark, sf, "documents").groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("n"), F.sum(ok.cast("long")).alias("passed"))
