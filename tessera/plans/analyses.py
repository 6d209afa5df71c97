"""The whole analysis as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analyze import analyze
from . import dims
from .matches import _CLAUSES, _captured_sql
from .registry import query, table


def _analysis(spark: SparkSession, sf: str):
    docs = table(spark, sf, "documents").select("doc_id", "text", (F.col("lang") == "en").alias("external"), F.array().cast("array<string>").alias("known"))
    return analyze(docs, dims.rules(spark), dims.phrases(spark), max_chars=None)


@query("analyze_verdicts")
def analyze_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return _analysis(spark, sf).verdicts.withColumn("reasons", F.array_join("reasons", ","))


_ACTIONS = f"""SELECT doc_id, prop_id, target, s FROM (SELECT m.doc_id, m.rule_id || '@' || m.s AS prop_id, m.value AS target, m.s, m.e, lower(c.clause) AS low, regexp_matches(c.clause, '[?]$') AS asked,
      row_number() OVER (PARTITION BY m.doc_id, m.clause_no, m.intent, m.s, m.e, m.surface ORDER BY m.priority DESC, m.rule_id) AS n
    FROM ({_captured_sql()}) m JOIN ({_CLAUSES}) c ON c.doc_id = m.doc_id AND c.clause_no = m.clause_no WHERE m.intent = 'action') a
  WHERE n = 1 AND (NOT asked OR regexp_matches(low, '^(can|could|would|will) you ')) AND NOT regexp_matches(low, '(^| )(not|never|no|ne|pas|nicht|kein) ')
    AND NOT EXISTS (SELECT 1 FROM (SELECT doc_id, pos, s, s + length(surface) AS e FROM (SELECT doc_id, pos, hits[pos] AS surface, CAST(list_sum(list_transform(gaps[1:pos], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:pos - 1], lambda x: length(x))), 0) AS BIGINT) AS s
      FROM (SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '"[^"]*"') AS hits, regexp_split_to_array(text, '"[^"]*"') AS gaps FROM documents)))) q WHERE q.doc_id = a.doc_id AND a.s >= q.s AND a.e <= q.e)"""


@query("analyze_tasks", f'SELECT doc_id, prop_id, target, CAST(row_number() OVER w AS INTEGER) AS task_no, lag(prop_id) OVER w AS "after" FROM ({_ACTIONS}) WINDOW w AS (PARTITION BY doc_id ORDER BY s, prop_id)')
def analyze_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """The executable actions of each document, in order."""
    return _analysis(spark, sf).tasks
