"""Queries of the rank layer: dedup, longest match, scores and margins, references, ellipsis, discourse, modality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rank, segment
from . import dims
from .matches import _CLAUSES, _MATCHES, rule_matches
from .registry import query, table

_REFS = f"SELECT * FROM ({_MATCHES}) WHERE intent = 'reference'"


@query("reference_suppression", f"SELECT rule_id, count(*) AS n FROM (SELECT *, max(e) OVER (PARTITION BY doc_id, clause_no ORDER BY s, e DESC, priority DESC, rule_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({_REFS})) WHERE reach IS NULL OR e > reach GROUP BY rule_id")
def reference_suppression(spark: SparkSession, sf: str) -> DataFrame:
    return rank.suppress_contained(rule_matches(spark, sf).where("intent = 'reference'"), ["doc_id", "clause_no"]).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("reference_shortest", f"SELECT rule_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, clause_no, s ORDER BY e - s, priority DESC, rule_id) AS n1 FROM ({_REFS})) WHERE n1 = 1 GROUP BY rule_id")
def reference_shortest(spark: SparkSession, sf: str) -> DataFrame:
    return rank.shortest_at_start(rule_matches(spark, sf).where("intent = 'reference'"), ["doc_id", "clause_no"]).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("longest_match", f"SELECT rule_id, count(*) AS n FROM (SELECT *, max(e - s) OVER (PARTITION BY doc_id, clause_no, e) AS m FROM ({_MATCHES})) WHERE e - s = m GROUP BY rule_id")
def longest_match(spark: SparkSession, sf: str) -> DataFrame:
    """The longest match at each end."""
    return rank.longest_at_end(rule_matches(spark, sf), ["doc_id", "clause_no"]).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("longest_match_greedy")
def longest_match_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return rank.longest_match(rule_matches(spark, sf), ["doc_id", "clause_no"])


#: lemma, sense, cue, weight: cues in the clause of a lemma speak for a sense.
_SENSES = [("and", "joins", "the", 3), ("and", "joins", "with", 6), ("and", "adds", "of", 3), ("and", "adds", "is", 3), ("for", "purpose", "to", 6), ("for", "reason", "that", 6), ("for", "purpose", "and", 3), ("que", "relative", "la", 3), ("que", "complement", "de", 3)]
_SENSES_SQL = dims.duck(_SENSES, ["lemma", "sense", "cue", "weight"])
_WORDS = rf"SELECT doc_id, clause_no, unnest(list_distinct(regexp_split_to_array(lower(clause), '[^\p{{L}}\p{{N}}]+'))) AS word FROM ({_CLAUSES})"
_SCORED = f"WITH w AS ({_WORDS}) SELECT l.doc_id, l.clause_no, s.lemma, s.sense, CAST(sum(s.weight) AS BIGINT) AS score FROM w l JOIN {_SENSES_SQL} s ON s.lemma = l.word JOIN w c ON c.doc_id = l.doc_id AND c.clause_no = l.clause_no AND c.word = s.cue GROUP BY ALL"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    words = segment.clauses(table(spark, sf, "documents")).select("doc_id", "clause_no", F.array_distinct(F.split(F.lower("clause"), segment.TOKEN_BREAK)).alias("words"))
    senses = dims.values(spark, _SENSES, "lemma string, sense string, cue string, weight int")
    # only lemmas that have senses leave the array
    some = F.array(*[F.lit(x) for x in sorted({r[0] for r in _SENSES})])
    lemmas = words.withColumn("lemma", F.explode(F.array_intersect("words", some))).join(senses, "lemma").where(F.array_contains("words", F.col("cue")))
    return lemmas.groupBy("doc_id", "clause_no", "lemma", "sense").agg(F.sum("weight").alias("score"))


@query(
    "sense_score_margin",
    f"""SELECT lemma, sense, status, count(*) AS n FROM (SELECT lemma, sense, CASE WHEN score < 6 THEN 'INSUFFICIENT' WHEN score - coalesce(second, 0) < 3 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS status FROM (
      SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM ({_SCORED}) WINDOW w AS (PARTITION BY doc_id, clause_no, lemma ORDER BY score DESC, sense)) WHERE n = 1) GROUP BY ALL""",
)
def sense_score_margin(spark: SparkSession, sf: str) -> DataFrame:
    return rank.top_with_margin(_scored(spark, sf), ["doc_id", "clause_no", "lemma"], "sense", 6, 3).groupBy("lemma", "sense", "status").agg(F.count("*").alias("n"))


#: record_id, surface, reading, pos, domain, complete (whether the list was not cut).
_CAND = [(1, "L1", 100, True, True, False, 3), (1, "L2", 75, False, True, True, 3), (2, "L1", 100, True, True, True, 1), (3, "L4", 50, False, False, False, 9), (3, "L5", 50, True, False, False, 9), (4, "L6", 100, True, True, True, 2), (4, "L7", 75, False, False, False, 2)]
_CAND_SQL = dims.duck(_CAND, ["tok", "record_id", "tier", "reading_ok", "pos_ok", "domain_ok", "total"])


@query(
    "lexical_score_select",
    f"""SELECT tok, record_id, CAST(score AS INTEGER) AS score, CASE WHEN total > 8 THEN 'TRUNCATED' WHEN total = 1 THEN 'RESOLVED' WHEN score >= 120 AND score - coalesce(second, 0) >= 25 AND evidence >= 2 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status,
      round(least(0.99, 0.6 + (score - coalesce(second, 0)) / 100.0), 4) AS confidence FROM (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM (
        SELECT *, tier + CASE WHEN reading_ok THEN 30 ELSE 0 END + CASE WHEN pos_ok THEN 20 ELSE 0 END + CASE WHEN domain_ok THEN 25 ELSE 0 END AS score, CAST(reading_ok AS INTEGER) + CAST(pos_ok AS INTEGER) + CAST(domain_ok AS INTEGER) AS evidence FROM {_CAND_SQL})
      WINDOW w AS (PARTITION BY tok ORDER BY score DESC, record_id)) WHERE n = 1""",
)
def lexical_score_select(spark: SparkSession, sf: str) -> DataFrame:
    """A list that was cut is never resolved; a single candidate is; else the score, the margin and two pieces of evidence decide."""
    c = dims.values(spark, _CAND, "tok int, record_id string, tier int, reading_ok boolean, pos_ok boolean, domain_ok boolean, total int")
    flag = lambda name, points: F.when(F.col(name), points).otherwise(0)
    scored = c.withColumn("score", F.col("tier") + flag("reading_ok", 30) + flag("pos_ok", 20) + flag("domain_ok", 25)).withColumn("evidence", F.col("reading_ok").cast("int") + F.col("pos_ok").cast("int") + F.col("domain_ok").cast("int"))
    best = rank.top_with_margin(scored, ["tok"], "record_id", 120, 25).join(scored.select("tok", "record_id", "evidence", "total"), ["tok", "record_id"])
    status = F.when(F.col("total") > 8, "TRUNCATED").when(F.col("total") == 1, "RESOLVED").when((F.col("status") == "RESOLVED") & (F.col("evidence") >= 2), "RESOLVED").otherwise("AMBIGUOUS")
    return best.select("tok", "record_id", "score", status.alias("status"), F.round(rank.confidence(0.6, F.col("margin")), 4).alias("confidence"))


# The driver's conversations: a mention is the first long word of a turn; "this" or "it" refer; a target is the word after "the".
_TURNS = r"SELECT conv_id, turn, nullif(regexp_extract(lower(text), '[a-z]{9,}', 0), '') AS mention, regexp_matches(lower(text), '(^| )(this|it|ce|es) ') AS is_reference, nullif(regexp_extract(lower(text), 'the ([a-z]{4,})', 1), '') AS target FROM conversations"


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.nullif(F.regexp_extract(low, "[a-z]{9,}", 0), F.lit("")).alias("mention"), low.rlike("(^| )(this|it|ce|es) ").alias("is_reference"), F.nullif(F.regexp_extract(low, "the ([a-z]{4,})", 1), F.lit("")).alias("target"))


@query(
    "reference_pool_rank",
    f"""WITH t AS ({_TURNS}) SELECT conv_id, "at", mention, CAST(recency AS INTEGER) AS recency, CAST(CASE WHEN seen = "at" THEN 110 ELSE 100 END - least(30, 4 * recency) AS INTEGER) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY conv_id, "at" ORDER BY seen DESC, mention) - 1 AS recency FROM (
        SELECT a.conv_id, a.turn AS "at", p.mention, max(p.turn) AS seen FROM t a JOIN t p ON a.conv_id = p.conv_id AND p.turn <= a.turn WHERE a.is_reference AND p.mention IS NOT NULL GROUP BY ALL))""",
)
def reference_pool_rank(spark: SparkSession, sf: str) -> DataFrame:
    return rank.reference_pool(_turns(spark, sf)).select("conv_id", "at", "mention", "recency", "score")


@query(
    "reference_select",
    f"""WITH t AS ({_TURNS}), p AS (SELECT a.conv_id, a.turn AS "at", p.mention, max(p.turn) AS seen FROM t a JOIN t p ON a.conv_id = p.conv_id AND p.turn <= a.turn WHERE a.is_reference AND p.mention IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, CASE WHEN seen = "at" THEN 110 ELSE 100 END - least(30, 4 * (row_number() OVER (PARTITION BY conv_id, "at" ORDER BY seen DESC, mention) - 1)) AS score FROM p)
    SELECT conv_id, "at", mention, CASE WHEN score < 100 THEN 'INSUFFICIENT' WHEN score - coalesce(second, 0) < 4 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS status FROM (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM r WINDOW w AS (PARTITION BY conv_id, "at" ORDER BY score DESC, mention)) WHERE n = 1""",
)
def reference_select(spark: SparkSession, sf: str) -> DataFrame:
    pool = rank.reference_pool(_turns(spark, sf))
    return rank.top_with_margin(pool, ["conv_id", "at"], "mention", 100, 4).select("conv_id", "at", "mention", "status")


@query("former_latter", f"SELECT conv_id, turn, latter, former FROM (SELECT conv_id, turn, seen[-1] AS latter, seen[-2] AS former FROM (SELECT conv_id, turn, list(mention) FILTER (mention IS NOT NULL) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ({_TURNS})))")
def former_latter(spark: SparkSession, sf: str) -> DataFrame:
    return rank.former_latter(_turns(spark, sf)).select("conv_id", "turn", "latter", "former")


@query("ellipsis_last_target", f"SELECT conv_id, turn, coalesce(target, last_value(target IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS resolved FROM ({_TURNS})")
def ellipsis_last_target(spark: SparkSession, sf: str) -> DataFrame:
    return rank.last_target(_turns(spark, sf)).select("conv_id", "turn", "resolved")


@query("ellipsis_recurrence")
def ellipsis_recurrence(spark: SparkSession, sf: str) -> DataFrame:
    return rank.ellipsis_recurrence(_turns(spark, sf).select("conv_id", "turn", "target"))


_REL = " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p, _ in rank.DISCOURSE)
_CONF = " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN {c}" for _, p, c in rank.DISCOURSE)


@query("discourse_relations", f"SELECT conv_id, turn, previous, relation, CAST(confidence AS DOUBLE) AS confidence FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, CASE {_REL} END AS relation, CASE {_CONF} END AS confidence FROM conversations) WHERE previous IS NOT NULL AND relation IS NOT NULL")
def discourse_relations(spark: SparkSession, sf: str) -> DataFrame:
    return rank.discourse(table(spark, sf, "conversations"), ["conv_id"], "turn", "text").select("conv_id", "turn", "previous", "relation", "confidence")


@query(
    "mood_speechact_polarity",
    f"""SELECT mood, speech_act, deontic, polarity, count(*) AS n FROM (SELECT
      CASE WHEN regexp_matches(c, '[?]$') THEN 'interrogative' WHEN o THEN 'imperative' ELSE 'declarative' END AS mood,
      CASE WHEN regexp_matches(c, '[?]$') AND regexp_matches(low, '^(can|could|would|will) you ') THEN 'request' WHEN regexp_matches(c, '[?]$') THEN 'question' WHEN o THEN 'command' ELSE 'statement' END AS speech_act,
      CASE WHEN regexp_matches(low, '(^| )(must not|may not|do not|not) ') THEN 'prohibition' WHEN regexp_matches(low, '(^| )(must|should|shall) ') THEN 'obligation' WHEN regexp_matches(low, '(^| )(may|can) ') THEN 'permission' ELSE 'none' END AS deontic,
      CASE WHEN regexp_matches(low, '(^| )(not|never|no|ne|pas|nicht|kein) ') THEN 'negative' ELSE 'positive' END AS polarity
      FROM (SELECT clause AS c, lower(clause) AS low, regexp_matches(lower(clause), '^(please|run|do|make|let|remove|add|keep) ') AS o FROM ({_CLAUSES}))) GROUP BY ALL""",
)
def mood_speechact_polarity(spark: SparkSession, sf: str) -> DataFrame:
    m = rank.modality(F.col("clause"))
    return segment.clauses(table(spark, sf, "documents")).select(*[c.alias(n) for n, c in m.items()]).groupBy(*m).agg(F.count("*").alias("n"))
