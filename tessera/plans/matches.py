"""Queries of the match layer: rules, phrases, synonyms, lookups, interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import stage
from ..operators import match, segment
from . import dims
from .registry import query, table
from .texts import CLAUSE_SQL, _duck_spans

_CLAUSES = f"SELECT doc_id, clause_no, CAST(s0 AS BIGINT) AS s0, clause FROM ({CLAUSE_SQL})"


def _matches_sql(probe: bool) -> str:
    """Rule matches of documents in DuckDB: doc_id, clause_no, rule_id, intent, priority, s, e, surface."""
    cover = r"AND (cover IS NULL OR list_contains(regexp_split_to_array(lower(clause), '[^\p{L}\p{N}]+'), cover))" if probe else ""
    parts = []
    for rule_id, intent, _, pattern, priority, enabled in dims.RULES:
        if enabled:
            source = f"(SELECT c.doc_id, c.clause_no, c.s0, c.clause FROM ({_CLAUSES}) c, {dims.RULES_SQL} r WHERE r.rule_id = '{rule_id}' {cover} AND regexp_matches(clause, '{pattern}'))"
            parts.append(f"SELECT doc_id, clause_no, '{rule_id}' AS rule_id, '{intent}' AS intent, {priority} AS priority, s0 + s AS s, s0 + e AS e, surface FROM ({_duck_spans(source, 'doc_id, clause_no, s0', 'clause', pattern)})")
    return " UNION ALL ".join(parts)


_MATCHES = _matches_sql(True)


def rule_matches(spark: SparkSession, sf: str) -> DataFrame:
    return match.match_rules(segment.clauses(table(spark, sf, "documents")), dims.rules(spark))


@query("rule_match_indexed", f'SELECT doc_id, clause_no, rule_id, intent, CAST(s AS INTEGER) AS "start", CAST(e AS INTEGER) AS "end", surface FROM ({_MATCHES})')
def rule_match_indexed(spark: SparkSession, sf: str) -> DataFrame:
    return rule_matches(spark, sf).select("doc_id", "clause_no", "rule_id", "intent", "start", "end", "surface")


@query("rule_match_joined", f"SELECT rule_id, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({_MATCHES}) GROUP BY rule_id")
def rule_match_joined(spark: SparkSession, sf: str) -> DataFrame:
    """The plan for many rules: 300 decoys that match nowhere stand beside the real ones."""
    decoys = dims.values(spark, [(f"D{i:03d}", "decoy", f"qqqx{i}", f"qqqx{i} ([a-z]+)", 1, True) for i in range(300)], dims.RULE_COLUMNS)
    return match.match_rules(segment.clauses(table(spark, sf, "documents")), dims.rules(spark).unionByName(decoys)).groupBy("rule_id").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("rule_match_exhaustive", f'SELECT rule_id, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({_matches_sql(False)}) GROUP BY rule_id')
def rule_match_exhaustive(spark: SparkSession, sf: str) -> DataFrame:
    return match.match_rules_exhaustively(segment.clauses(table(spark, sf, "documents")), dims.rules(spark)).groupBy("rule_id").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("rule_parity", "SELECT CAST(0 AS BIGINT) AS only_indexed, CAST(0 AS BIGINT) AS only_exhaustive")
def rule_parity(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that the probe or the exhaustive scan has alone: none."""
    clauses = segment.clauses(table(spark, sf, "documents"))
    a, b = match.match_rules(clauses, dims.rules(spark)), match.match_rules_exhaustively(clauses, dims.rules(spark))
    cols = ["doc_id", "clause_no", "rule_id", "start", "end", "surface"]
    both = a.select(*cols, F.lit(1).alias("side")).unionByName(b.select(*cols, F.lit(-1).alias("side"))).groupBy(*cols).agg(F.sum("side").alias("d"))
    return both.agg(F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).alias("only_indexed"), F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("only_exhaustive"))


def _captured_sql() -> str:
    cases = " ".join(f"WHEN '{r[0]}' THEN regexp_extract(surface, '{r[3]}', 1)" for r in dims.RULES)
    return f"SELECT *, CASE rule_id {cases} END AS value FROM ({_MATCHES})"


@query("rule_captures", f"SELECT intent, value, count(*) AS n FROM ({_captured_sql()}) GROUP BY ALL")
def rule_captures(spark: SparkSession, sf: str) -> DataFrame:
    return match.captures(rule_matches(spark, sf), dims.rules(spark)).groupBy("intent", "value").agg(F.count("*").alias("n"))


_DEDUP = f"SELECT doc_id, clause_no, intent, s, e, surface, rule_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, clause_no, intent, s, e, surface ORDER BY priority DESC, rule_id) AS n FROM ({_MATCHES})) WHERE n = 1"


@query("intent_dedup", f"SELECT doc_id, intent, rule_id, count(*) AS n FROM ({_DEDUP}) GROUP BY ALL")
def intent_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return match.dedup_intents(rule_matches(spark, sf)).groupBy("doc_id", "intent", "rule_id").agg(F.count("*").alias("n"))


@query(
    "rule_match_rollup",
    f"""SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS matches, CAST(coalesce(intents, 0) AS BIGINT) AS intents,
      CASE WHEN coalesce(actions, 0) > 0 AND coalesce(prohibitions, 0) > 0 THEN 'PARTIAL' WHEN coalesce(n, 0) > 0 THEN 'COMPLETE' ELSE 'FAILED' END AS status
    FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, count(DISTINCT intent) AS intents, count(*) FILTER (intent = 'action') AS actions, count(*) FILTER (intent = 'prohibition') AS prohibitions FROM ({_DEDUP}) GROUP BY doc_id) m USING (doc_id)""",
)
def rule_match_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: clauses, probe, matches, dedup, and a status for every document."""
    docs = table(spark, sf, "documents")
    found = match.dedup_intents(match.match_rules(segment.clauses(docs), dims.rules(spark))).groupBy("doc_id").agg(F.count("*").alias("matches"), F.count_distinct("intent").alias("intents"), F.bool_or(F.col("intent") == "action").alias("a"), F.bool_or(F.col("intent") == "prohibition").alias("p"))
    status = F.when(F.col("a") & F.col("p"), "PARTIAL").when(F.col("matches") > 0, "COMPLETE").otherwise("FAILED")
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("intents", F.lit(0)).alias("intents"), status.alias("status"))


_PHRASE_SQL = rf"""SELECT doc_id, clause_no, expression, domain, policy, list_filter(cues, lambda c: contains(low, ' ' || c || ' ')) AS hits
  FROM (SELECT doc_id, clause_no, ' ' || regexp_replace(lower(clause), '[^\p{{L}}\p{{N}}]+', ' ', 'g') || ' ' AS low FROM ({_CLAUSES})), {dims.PHRASES_SQL}
  WHERE contains(low, ' ' || surface || ' ')"""
_PHRASE_STATUS = "CASE WHEN policy = 'required_any' THEN CASE WHEN len(hits) > 0 THEN 'RESOLVED' ELSE 'INSUFFICIENT' END WHEN policy = 'forbidden_any' AND len(hits) > 0 THEN 'UNSUPPORTED' ELSE 'RESOLVED' END"


@query("phrase_match", f"SELECT doc_id, clause_no, expression, CAST(len(hits) AS INTEGER) AS cue_hits FROM ({_PHRASE_SQL})")
def phrase_match(spark: SparkSession, sf: str) -> DataFrame:
    return match.phrase_hits(segment.clauses(table(spark, sf, "documents")), dims.phrases(spark)).select("doc_id", "clause_no", "expression", "cue_hits")


@query("phrase_policy_status", f"SELECT expression, domain, {_PHRASE_STATUS} AS status, count(*) AS n FROM ({_PHRASE_SQL}) GROUP BY ALL")
def phrase_policy_status(spark: SparkSession, sf: str) -> DataFrame:
    return match.phrase_hits(segment.clauses(table(spark, sf, "documents")), dims.phrases(spark)).groupBy("expression", "domain", "status").agg(F.count("*").alias("n"))


#: Synonyms over the words of part names and types.
_SYN = [("red", "C-RED"), ("crimson", "C-RED"), ("small part", "S-SMALL"), ("small", "S-LITTLE"), ("standard", "T-STANDARD"), ("standard anodized", "T-ANODIZED"), ("economy brushed", "T-BRUSHED"), ("steel", "M-STEEL"), ("tin", "M-TIN"), ("brass", "M-BRASS"), ("copper", "M-COPPER"), ("nickel", "M-NICKEL")]
_SYN_SQL = dims.duck(_SYN, ["surface", "canonical"])


@query("synonym_exact", f"SELECT p_partkey, canonical FROM (SELECT p_partkey, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM part) JOIN {_SYN_SQL} ON surface = w")
def synonym_exact(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "part").select("p_partkey", F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("w"))
    return match.synonym_exact(words, dims.values(spark, _SYN, "surface string, canonical string"), "w").select("p_partkey", "canonical")


_PART_TOKENS = r"SELECT p_partkey, w[i] AS t1, w[i + 1] AS t2, CAST(i - 1 AS INTEGER) AS pos FROM (SELECT p_partkey, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT p_partkey, list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM part))"


@query("synonym_scan", f"SELECT p_partkey, pos, max_by(canonical, n) AS canonical, CAST(max(n) AS INTEGER) AS size FROM (SELECT p_partkey, pos, canonical, 1 AS n FROM ({_PART_TOKENS}) JOIN {_SYN_SQL} ON surface = t1 UNION ALL SELECT p_partkey, pos, canonical, 2 FROM ({_PART_TOKENS}) JOIN {_SYN_SQL} ON surface = t1 || ' ' || t2) GROUP BY p_partkey, pos")
def synonym_scan(spark: SparkSession, sf: str) -> DataFrame:
    words = segment.tokens(table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text")), "p_partkey")
    return match.synonym_scan(words, dims.values(spark, _SYN, "surface string, canonical string"), 2, ["p_partkey"]).select("p_partkey", "pos", "canonical", "size")


_PAIRS = [(1, "Red paint", "red-paint", [], []), (2, "the report", "report", [], []), (3, "report", "reports", ["A"], ["B"]), (4, "x", "box", [], []), (5, "API", "interface", ["I"], ["I", "J"]), (6, "alpha", "beta", [], ["B"])]
_PAIRS_SQL = dims.duck(_PAIRS, ["id", "a", "b", "ia", "ib"])


@query("related_pairs", rf"SELECT id, CASE WHEN len(ia) > 0 AND len(ib) > 0 THEN list_has_any(ia, ib) ELSE ca = cb OR (least(length(ca), length(cb)) >= 2 AND (contains(ca, cb) OR contains(cb, ca))) END AS related FROM (SELECT id, ia, ib, regexp_replace(lower(a), '[^\p{{L}}\p{{N}}]+', '', 'g') AS ca, regexp_replace(lower(b), '[^\p{{L}}\p{{N}}]+', '', 'g') AS cb FROM {_PAIRS_SQL})")
def related_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return match.related(dims.values(spark, _PAIRS, "id int, a string, b string, ia array<string>, ib array<string>"), "a", "b", "ia", "ib").select("id", "related")


_LEX = [("L1", "橋", "橋", "はし"), ("L2", "箸", "箸", "はし"), ("L3", "端", "端", "はし"), ("L4", "走る", "走る", "はしる"), ("L5", "カメラ", "カメラ", "かめら"), ("L6", "橋", "橋", "きょう")]
_LEX_SQL = dims.duck(_LEX, ["record_id", "surface", "normalized", "reading"])
_TOK = [(1, "橋", "橋", "はし"), (2, "はし", "はし", "はし"), (3, "走った", "走る", "はしった"), (4, "無", "無", "む"), (5, "ｶﾒﾗ", "カメラ", "かめら")]
_TOK_SQL = dims.duck(_TOK, ["tok", "surface", "normalized", "reading"])


@query(
    "lexicon_lookup_cascade",
    f"""WITH h AS (SELECT tok, 0 AS tier, record_id FROM {_TOK_SQL} t JOIN {_LEX_SQL} l USING (surface) UNION SELECT tok, 1, record_id FROM {_TOK_SQL} t JOIN {_LEX_SQL} l ON l.normalized = t.normalized UNION SELECT tok, 2, record_id FROM {_TOK_SQL} t JOIN {_LEX_SQL} l ON l.reading = t.reading),
    b AS (SELECT * FROM (SELECT *, min(tier) OVER (PARTITION BY tok) AS m FROM h) WHERE tier = m)
    SELECT tok, CAST(tier AS INTEGER) AS tier, record_id, count(*) OVER (PARTITION BY tok) AS total, CAST(row_number() OVER (PARTITION BY tok ORDER BY record_id) AS INTEGER) AS rank FROM b QUALIFY row_number() OVER (PARTITION BY tok ORDER BY record_id) <= 2""",
)
def lexicon_lookup_cascade(spark: SparkSession, sf: str) -> DataFrame:
    lex = dims.values(spark, _LEX, "record_id string, surface string, normalized string, reading string")
    return match.cascade(dims.values(spark, _TOK, "tok int, surface string, normalized string, reading string"), [lex.select(c, "record_id") for c in ("surface", "normalized", "reading")], ["surface", "normalized", "reading"], ["tok"], top=2)


_READ = [("はし", "L1", ["橋"], False), ("はし", "L2", [], True), ("かめら", "L5", [], False), ("む", "L7", ["夢"], False)]
_READ_SQL = dims.duck(_READ, ["reading", "record_id", "restricted_to", "no_kanji"])


@query("reading_lookup_restricted", rf"SELECT tok, record_id FROM {_TOK_SQL} t JOIN {_READ_SQL} r USING (reading) WHERE (len(restricted_to) = 0 OR list_contains(restricted_to, surface) OR list_contains(restricted_to, normalized)) AND NOT (no_kanji AND regexp_matches(surface, '\p{{Han}}'))")
def reading_lookup_restricted(spark: SparkSession, sf: str) -> DataFrame:
    readings = dims.values(spark, _READ, "reading string, record_id string, restricted_to array<string>, no_kanji boolean")
    return match.reading_lookup(dims.values(spark, _TOK, "tok int, surface string, normalized string, reading string"), readings).select("tok", "record_id")


_ITEMS = f"SELECT doc_id, rule_id || '@' || s AS item_id, s - 3 AS s, e + 3 AS e FROM ({_MATCHES}) WHERE rule_id IN ('R10', 'R11', 'R01', 'R02', 'R13')"


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Matches, widened by three characters, so that some reach into the next clause."""
    found = rule_matches(spark, sf).where("rule_id in ('R10', 'R11', 'R01', 'R02', 'R13')")
    return found.select("doc_id", F.concat_ws("@", "rule_id", "start").alias("item_id"), (F.col("start") - 3).alias("start"), (F.col("end") + 3).alias("end"))


@query(
    "clause_assign_max_overlap",
    f"""SELECT doc_id, item_id, clause_no, CAST(shared AS INTEGER) AS shared FROM (SELECT doc_id, item_id, clause_no, greatest(0, least(e, s0 + length(clause)) - greatest(s, s0)) AS shared,
      row_number() OVER (PARTITION BY doc_id, item_id ORDER BY greatest(0, least(e, s0 + length(clause)) - greatest(s, s0)) DESC, clause_no) AS n FROM ({_ITEMS}) JOIN ({_CLAUSES}) USING (doc_id)) WHERE n = 1""",
)
def clause_assign_max_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return match.assign_clause(_items(spark, sf), segment.clauses(table(spark, sf, "documents"))).select("doc_id", "item_id", "clause_no", "shared")


@query("clause_assign_containing", f"SELECT doc_id, item_id, clause_no FROM (SELECT doc_id, item_id, clause_no, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY length(clause), clause_no) AS n FROM ({_ITEMS}) JOIN ({_CLAUSES}) USING (doc_id) WHERE s >= s0 AND s < s0 + length(clause)) WHERE n = 1")
def clause_assign_containing(spark: SparkSession, sf: str) -> DataFrame:
    return match.containing_clause(_items(spark, sf), segment.clauses(table(spark, sf, "documents"))).select("doc_id", "item_id", "clause_no")


@query("span_overlap_join", f"SELECT a.doc_id, a.rule_id AS rule_a, b.rule_id AS rule_b, count(*) AS n FROM ({_MATCHES}) a JOIN ({_MATCHES}) b ON a.doc_id = b.doc_id AND a.clause_no = b.clause_no AND a.s < b.e AND b.s < a.e AND a.rule_id < b.rule_id GROUP BY ALL")
def span_overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    found = stage(rule_matches(spark, sf).select("doc_id", "clause_no", "rule_id", "start", "end"), "matches")  # both sides read it
    return match.overlaps(found, found, ["doc_id", "clause_no"]).where("rule_id < r_rule_id").groupBy("doc_id", F.col("rule_id").alias("rule_a"), F.col("r_rule_id").alias("rule_b")).agg(F.count("*").alias("n"))


@query("inside_quotes", f"SELECT rule_id, count(*) AS n FROM ({_MATCHES}) m WHERE EXISTS (SELECT 1 FROM ({_duck_spans('documents', 'doc_id', 'text', segment.QUOTED)}) q WHERE q.doc_id = m.doc_id AND m.s >= q.s AND m.e <= q.e) GROUP BY rule_id")
def inside_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Matches within a quotation: a left semi interval join."""
    return match.inside(rule_matches(spark, sf), segment.quotes(table(spark, sf, "documents")), ["doc_id"]).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("collision_guard", f"SELECT m.rule_id, count(*) AS n FROM ({_MATCHES}) m WHERE NOT EXISTS (SELECT 1 FROM ({_MATCHES}) g WHERE g.rule_id = 'R08' AND m.rule_id = 'R07' AND g.doc_id = m.doc_id AND m.s < g.e AND g.s < m.e) GROUP BY m.rule_id")
def collision_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Matches of R07 are dropped where a match of R08, which names them, overlaps: a left anti interval join."""
    found = stage(rule_matches(spark, sf).withColumnRenamed("rule_id", "entry_id"), "matches")  # both sides read it
    guards = found.where("entry_id = 'R08'").select("doc_id", "start", "end", F.lit("R07").alias("suppresses"))
    return match.guarded(found, guards, ["doc_id"]).groupBy(F.col("entry_id").alias("rule_id")).agg(F.count("*").alias("n"))


@query("rule_prefilter_cost", rf"SELECT count(*) AS clauses, CAST(sum(n) AS BIGINT) AS tried FROM (SELECT len(list_filter(['licensed', 'released', 'that', 'the', 'for', 'in', 'this', 'this', 'les', 'not', 'der', 'the'], lambda c: list_contains(w, c))) + 2 AS n FROM (SELECT regexp_split_to_array(lower(clause), '[^\p{{L}}\p{{N}}]+') AS w FROM ({_CLAUSES})))")
def rule_prefilter_cost(spark: SparkSession, sf: str) -> DataFrame:
    """How many rules the probe leaves to be tried: decoys that match nowhere do not add to it."""
    clauses = segment.clauses(table(spark, sf, "documents"))
    decoys = dims.values(spark, [(f"D{i:03d}", "decoy", f"qqqx{i}", f"qqqx{i} ([a-z]+)", 1, True) for i in range(200)], dims.RULE_COLUMNS)
    tried = match.probe(clauses.select("doc_id", "clause_no", "clause"), dims.rules(spark).unionByName(decoys)).groupBy("doc_id", "clause_no").agg(F.count("*").alias("n"))
    return tried.agg(F.count("*").alias("clauses"), F.sum("n").alias("tried"))
