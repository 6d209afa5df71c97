"""Queries of the review lane: documents are the queue, labels the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import review
from .registry import query, table

_FLAGS = "list_filter([CASE WHEN n_chars < 60 THEN 'no-source' END, CASE WHEN contains(lower(text), 'licensed') THEN 'no-license' END, CASE WHEN contains(text, '%%%') THEN 'substring' END, CASE WHEN lang = 'es' AND contains(text, '|') THEN 'category' END, CASE WHEN contains(text, '@') THEN 'risky' END], lambda x: x IS NOT NULL)"
_STATUS = "CASE WHEN list_has_any(f, ['no-source', 'no-license']) THEN 'blocked' WHEN list_has_any(f, ['substring']) THEN 'artifact' WHEN list_has_any(f, ['category']) THEN 'mismatch' WHEN list_has_any(f, ['risky']) THEN 'high-risk' ELSE 'ready' END"
_QUEUE = f"SELECT doc_id, lang, source, n_chars, f, {_STATUS} AS status FROM (SELECT *, {_FLAGS} AS f FROM documents)"


def _queue(spark: SparkSession, sf: str) -> DataFrame:
    has = lambda mark: F.contains("text", F.lit(mark))
    checks = {"no-source": F.col("n_chars") < 60, "no-license": F.contains(F.lower("text"), F.lit("licensed")), "substring": has("%%%"), "category": (F.col("lang") == "es") & has("|"), "risky": has("@")}
    return table(spark, sf, "documents").withColumn("f", review.flags(checks)).withColumn("status", review.triage(F.col("f"))).select("doc_id", "lang", "source", "n_chars", "f", "status")


@query("triage_flags", f"SELECT flag, count(*) AS n FROM (SELECT unnest(f) AS flag FROM ({_QUEUE})) GROUP BY flag")
def triage_flags(spark: SparkSession, sf: str) -> DataFrame:
    return _queue(spark, sf).select(F.explode("f").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query("triage_status", f"SELECT doc_id, status FROM ({_QUEUE})")
def triage_status(spark: SparkSession, sf: str) -> DataFrame:
    return _queue(spark, sf).select("doc_id", "status")


@query("triage_matrix", f"SELECT lang, {', '.join(f'''count(*) FILTER (status = '{s}') AS \"{s}\"''' for s in ('blocked', 'artifact', 'mismatch', 'high-risk', 'ready'))} FROM ({_QUEUE}) GROUP BY lang")
def triage_matrix(spark: SparkSession, sf: str) -> DataFrame:
    wide = _queue(spark, sf).groupBy("lang").pivot("status", ["blocked", "artifact", "mismatch", "high-risk", "ready"]).count()
    return wide.na.fill(0)


@query("triage_cube", f"SELECT coalesce(lang, '*') AS lang, coalesce(status, '*') AS status, count(*) AS n FROM ({_QUEUE}) GROUP BY CUBE (lang, status)")
def triage_cube(spark: SparkSession, sf: str) -> DataFrame:
    return _queue(spark, sf).cube("lang", "status").agg(F.count("*").alias("n")).select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("status", F.lit("*")).alias("status"), "n")


_DECISIONS = "SELECT doc_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' ELSE 'deferred' END AS decision FROM labels"


def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved").otherwise("deferred").alias("decision"))


@query("apply_decisions", f"SELECT doc_id, status, coalesce(decision, status) AS next_status FROM ({_QUEUE}) LEFT JOIN ({_DECISIONS}) USING (doc_id)")
def apply_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return review.apply_decisions(_queue(spark, sf).select("doc_id", "status"), _decisions(spark, sf), "doc_id")


@query("status_transitions", f"SELECT status, coalesce(decision, status) AS next_status, count(*) AS n FROM ({_QUEUE}) LEFT JOIN ({_DECISIONS}) USING (doc_id) GROUP BY ALL")
def status_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return review.transitions(review.apply_decisions(_queue(spark, sf).select("doc_id", "status"), _decisions(spark, sf), "doc_id"), "status", "next_status")


@query("decision_coverage", "SELECT count(*) FILTER (l.doc_id IS NULL) AS undecided, count(*) FILTER (d.doc_id IS NULL) AS unknown, count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS decided FROM (SELECT doc_id FROM documents WHERE lang = 'en') d FULL JOIN (SELECT doc_id FROM labels) l USING (doc_id)")
def decision_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return review.coverage(table(spark, sf, "documents").where("lang = 'en'"), table(spark, sf, "labels"), "doc_id")


@query("review_packs", f"SELECT lang, status, pack, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY lang, status ORDER BY doc_id) - 1) / 20) AS BIGINT) AS pack FROM ({_QUEUE})) GROUP BY ALL")
def review_packs(spark: SparkSession, sf: str) -> DataFrame:
    return review.packs(_queue(spark, sf), ["lang", "status"], ["doc_id"], 20).groupBy("lang", "status", "pack").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


_SCORE = "least(100, CASE WHEN n_chars > 200 THEN 25 ELSE 0 END + CASE WHEN lang = 'en' THEN 25 ELSE 0 END + CASE WHEN source LIKE 'src1%' THEN 10 ELSE 0 END + CASE WHEN len(f) = 0 THEN 50 ELSE 0 END)"


@query("proposal_scores", f"SELECT doc_id, CAST({_SCORE} AS INTEGER) AS score FROM ({_QUEUE})")
def proposal_scores(spark: SparkSession, sf: str) -> DataFrame:
    parts = {"length": (F.col("n_chars") > 200, 25), "language": (F.col("lang") == "en", 25), "source": (F.col("source").startswith("src1"), 10), "clean": (F.size("f") == 0, 50)}
    return _queue(spark, sf).select("doc_id", review.proposal_score(parts).alias("score"))


@query("proposal_conflicts", "SELECT p_partkey, w AS surface, array_to_string(owners, '|') AS owners FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_partkey % 9 = 0) JOIN (SELECT o, list_sort(list_distinct(list(p_brand))) AS owners FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS o FROM part WHERE p_partkey % 9 = 1) GROUP BY o) ON o = w")
def proposal_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "part").select("p_partkey", "p_brand", F.explode(F.split("p_name", " ")).alias("surface"))
    return review.conflicts(words.where("p_partkey % 9 = 0").select("p_partkey", "surface"), words.where("p_partkey % 9 = 1").select("surface", "p_brand"), "surface", "p_brand").select("p_partkey", "surface", F.array_join("owners", "|").alias("owners"))


@query("macro_accuracy", "SELECT round(avg(a), 6) AS macro, round(sum(p) / sum(n), 6) AS micro, count(*) AS categories FROM (SELECT source, avg(CAST(ok AS DOUBLE)) AS a, count(*) AS n, CAST(sum(CAST(ok AS BIGINT)) AS DOUBLE) AS p FROM (SELECT source, (quality = 1) = (n_chars >= 100 AND NOT contains(text, '%%%')) AS ok FROM documents JOIN labels USING (doc_id)) GROUP BY source)")
def macro_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """How well two simple flags foretell the quality label, by source."""
    both = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    guess = (F.col("n_chars") >= 100) & ~F.contains("text", F.lit("%%%"))
    return review.macro_accuracy(both.select("source", ((F.col("quality") == 1) == guess).alias("ok")), "source", "ok")


@query("latency_percentiles", "SELECT event_type, v[CAST(least(floor(n * 0.5), n - 1) AS INTEGER) + 1] AS p50, v[CAST(least(floor(n * 0.95), n - 1) AS INTEGER) + 1] AS p95, v[CAST(least(floor(n * 0.99), n - 1) AS INTEGER) + 1] AS p99, v[-1] AS longest, n FROM (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type)")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return review.nearest_rank(table(spark, sf, "events"), ["event_type"], "value", [0.5, 0.95, 0.99])


@query("hash_sample", "SELECT doc_id FROM documents ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A sampling operator: the limit is what it does."""
    return review.hash_sample(table(spark, sf, "documents").select("doc_id"), "doc_id", 100)


@query("gold_override", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def gold_override(spark: SparkSession, sf: str) -> DataFrame:
    return review.gold_override(table(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


_N = r"[^\p{L}\p{N}]+"


@query("benchmark_contamination", f"SELECT doc_id, item_id, CAST(n AS BIGINT) AS shared FROM (SELECT d.doc_id, b.item_id, count(*) AS n FROM (SELECT DISTINCT doc_id, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT doc_id, regexp_split_to_array(lower(text), '{_N}') AS w FROM documents))) d JOIN (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT item_id, regexp_split_to_array(lower(text), '{_N}') AS w FROM benchmark))) b USING (g) GROUP BY ALL)")
def benchmark_contamination(spark: SparkSession, sf: str) -> DataFrame:
    """Containment audit: runs of eight words that a document shares with a benchmark item."""

    def runs(df: DataFrame, key: str) -> DataFrame:
        words = df.select(key, F.split(F.lower("text"), _N).alias("w")).where(F.size("w") >= 8)
        return words.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.array_join(F.slice("w", i, F.lit(8)), " "))).alias("g"))

    # the benchmark's runs meet the documents' first; only what is shared is made distinct
    shared = runs(table(spark, sf, "documents"), "doc_id").join(runs(table(spark, sf, "benchmark"), "item_id").distinct(), "g").distinct()
    return shared.groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


@query("approved_only_gate", f"SELECT d.lang, count(*) AS n FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1 AND toxic = 0 AND CASE {' '.join(f'''WHEN contains(lower(text), '{m}') THEN '{b}' ''' for b, m in X.LICENSE_BUCKETS)} ELSE 'unknown' END <> 'noncommercial' GROUP BY d.lang")
def approved_only_gate(spark: SparkSession, sf: str) -> DataFrame:
    ok = table(spark, sf, "labels").where("quality = 1 and toxic = 0")
    return table(spark, sf, "documents").join(ok, "doc_id").where(X.license_bucket(F.col("text")) != "noncommercial").groupBy("lang").agg(F.count("*").alias("n"))
