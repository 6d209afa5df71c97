"""Queries of the graph layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import stage
from ..operators import graph, match
from . import dims
from .matches import _captured_sql, rule_matches
from .registry import query, table

# Tasks of a conversation: a turn comes before the next one, and before the next of the same role.
_EDGES = "SELECT conv_id, turn AS src, nxt AS dst FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL UNION SELECT conv_id, turn, nxt FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id, role ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL"


def _turn_edges(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    turns = table(spark, sf, "conversations")
    edge = lambda *by: turns.select("conv_id", F.col("turn").alias("src"), F.lead("turn").over(W.partitionBy(*by).orderBy("turn")).alias("dst")).where("dst is not null")
    return edge("conv_id").unionByName(edge("conv_id", "role")).distinct()


@query("task_edges", f"SELECT conv_id, count(*) AS edges FROM ({_EDGES}) GROUP BY conv_id")
def task_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _turn_edges(spark, sf).groupBy("conv_id").agg(F.count("*").alias("edges"))


#: A diamond with a tail (1), a cycle with an entry and an exit (2), a lone node (3), a loop (4).
_NODES = [(1, n) for n in "abcde"] + [(2, n) for n in "pqrst"] + [(3, "z")] + [(4, "x"), (4, "y")]
_ARCS = [(1, "a", "b"), (1, "a", "c"), (1, "b", "d"), (1, "c", "d"), (1, "d", "e"), (1, "a", "e"), (2, "p", "q"), (2, "q", "r"), (2, "r", "s"), (2, "s", "q"), (2, "s", "t"), (4, "x", "x"), (4, "x", "y")]
_NODES_SQL, _ARCS_SQL = dims.duck(_NODES, ["g", "node"]), dims.duck(_ARCS, ["g", "src", "dst"])


def _inline(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return dims.values(spark, _NODES, "g int, node string"), dims.values(spark, _ARCS, "g int, src string, dst string")


_CYCLE_SQL = f"""RECURSIVE walk AS (SELECT g, src, dst FROM {_ARCS_SQL} UNION SELECT w.g, w.src, a.dst FROM walk w JOIN {_ARCS_SQL} a ON a.g = w.g AND a.src = w.dst),
  bad AS (SELECT g, src AS node FROM walk WHERE src = dst), behind AS (SELECT g, node FROM bad UNION SELECT w.g, w.dst FROM walk w JOIN bad b ON b.g = w.g AND b.node = w.src),
  steps AS (SELECT g, node, 0 AS level FROM {_NODES_SQL} n WHERE NOT EXISTS (SELECT 1 FROM behind b WHERE b.g = n.g AND b.node = n.node)
    UNION SELECT s.g, a.dst, s.level + 1 FROM steps s JOIN {_ARCS_SQL} a ON a.g = s.g AND a.src = s.node WHERE NOT EXISTS (SELECT 1 FROM behind b WHERE b.g = a.g AND b.node = a.dst))"""


@query("topo_levels", f"WITH {_CYCLE_SQL} SELECT n.g, n.node, CAST(max(level) AS INTEGER) AS level FROM {_NODES_SQL} n LEFT JOIN steps USING (g, node) GROUP BY ALL")
def topo_levels(spark: SparkSession, sf: str) -> DataFrame:
    return graph.levels(*_inline(spark), "g")


@query("cycle_report", f"WITH {_CYCLE_SQL} SELECT g, count(*) AS blocked FROM behind GROUP BY g")
def cycle_report(spark: SparkSession, sf: str) -> DataFrame:
    return graph.levels(*_inline(spark), "g").where("level is null").groupBy("g").agg(F.count("*").alias("blocked"))


@query("conversation_levels", "SELECT conv_id, CAST(turn AS BIGINT) AS node, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS level FROM (SELECT DISTINCT conv_id, turn FROM conversations)")
def conversation_levels(spark: SparkSession, sf: str) -> DataFrame:
    """As each turn comes before the next, the longest way is the turn's number."""
    nodes = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("node"))
    return graph.levels(nodes, _turn_edges(spark, sf), "conv_id")


@query("topo_order", f"WITH {_CYCLE_SQL}, l AS (SELECT n.g, n.node, max(level) AS level FROM {_NODES_SQL} n LEFT JOIN steps USING (g, node) GROUP BY ALL), c AS (SELECT *, bool_or(level IS NULL) OVER (PARTITION BY g) AS cyclic FROM l) SELECT g, node, CAST(row_number() OVER (PARTITION BY g ORDER BY CASE WHEN cyclic THEN 0 ELSE level END, node) AS INTEGER) AS position, cyclic FROM c")
def topo_order(spark: SparkSession, sf: str) -> DataFrame:
    return graph.ordered(*_inline(spark), "g")


# A conversation's graph by shared words: turns with a long word in common are connected.
_SHARED = r"SELECT DISTINCT a.conv_id, a.turn AS src, b.turn AS dst FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]{8,}')) AS w FROM conversations) a JOIN (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]{8,}')) AS w FROM conversations) b ON a.conv_id = b.conv_id AND a.w = b.w AND a.turn < b.turn"


@query("relevance_closure", f"WITH RECURSIVE e AS ({_SHARED}), u AS (SELECT conv_id, src, dst FROM e UNION SELECT conv_id, dst, src FROM e), r AS (SELECT conv_id, min(turn) AS node FROM conversations GROUP BY conv_id UNION SELECT r.conv_id, u.dst FROM r JOIN u ON u.conv_id = r.conv_id AND u.src = r.node) SELECT conv_id, CAST(node AS BIGINT) AS node FROM r")
def relevance_closure(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    words = turns.select("conv_id", "turn", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0))).alias("w")).distinct()
    edges = words.withColumnRenamed("turn", "src").join(words.withColumnRenamed("turn", "dst"), ["conv_id", "w"]).where("src < dst").select("conv_id", "src", "dst")
    return graph.closure(turns.groupBy("conv_id").agg(F.min("turn").alias("node")), edges, "conv_id")


_PROPS = f"SELECT doc_id, rule_id || '@' || s AS prop_id, CASE intent WHEN 'action' THEN 'changes' WHEN 'condition' THEN 'preserves' ELSE 'prohibits' END AS kind, value AS target, clause_no, s FROM ({_captured_sql()}) WHERE intent IN ('action', 'condition', 'scope')"
_KEY = r"regexp_replace(lower(target), '[^\p{L}\p{N}]+', '', 'g')"


def _props(spark: SparkSession, sf: str) -> DataFrame:
    found = match.captures(rule_matches(spark, sf), dims.rules(spark)).where("intent in ('action', 'condition', 'scope')")
    kind = F.when(F.col("intent") == "action", "changes").when(F.col("intent") == "condition", "preserves").otherwise("prohibits")
    return stage(found.select("doc_id", F.concat_ws("@", "rule_id", "start").alias("prop_id"), kind.alias("kind"), F.col("value").alias("target"), "clause_no", "start"), "propositions")  # read from two sides


@query("contradictions", f"WITH p AS (SELECT *, {_KEY} AS k FROM ({_PROPS})) SELECT DISTINCT a.doc_id, a.prop_id AS constraint_id, a.kind AS constraint_kind, b.prop_id AS action_id FROM p a JOIN p b USING (doc_id) WHERE a.kind <> 'changes' AND b.kind = 'changes' AND least(length(a.k), length(b.k)) >= 2 AND (contains(a.k, b.k) OR contains(b.k, a.k))")
def contradictions(spark: SparkSession, sf: str) -> DataFrame:
    return graph.contradictions(_props(spark, sf), "doc_id")


@query(
    "best_action_attach",
    f"""WITH p AS ({_PROPS}) SELECT doc_id, constraint_id, action_id, CAST(score AS INTEGER) AS score FROM (SELECT c.doc_id, c.prop_id AS constraint_id, a.prop_id AS action_id, CASE WHEN contains(c.target, a.target) OR contains(a.target, c.target) THEN 100 ELSE 0 END + CASE WHEN c.clause_no = a.clause_no THEN 40 ELSE 0 END + CASE WHEN a.s > c.s THEN 20 ELSE 0 END AS score, abs(a.s - c.s) AS d
      FROM p c JOIN p a USING (doc_id) WHERE c.kind <> 'changes' AND a.kind = 'changes') QUALIFY row_number() OVER (PARTITION BY doc_id, constraint_id ORDER BY score DESC, d, action_id) = 1""",
)
def best_action_attach(spark: SparkSession, sf: str) -> DataFrame:
    p = _props(spark, sf)
    return graph.attach_best(p.where("kind <> 'changes'"), p.where("kind = 'changes'"), "doc_id")


@query("entity_registry", rf"""SELECT doc_id, entity_key, min_by(value, s) AS name, count(*) AS mentions, CAST(max(priority) AS INTEGER) AS salience, array_to_string(list_sort(list_distinct(list(value))), '|') AS aliases,
    CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(s), entity_key) AS INTEGER) AS entity_no FROM (SELECT *, regexp_replace(lower(value), '[^\p{{L}}\p{{N}}]+', '', 'g') AS entity_key FROM ({_captured_sql()}) WHERE rule_id <> 'R15') WHERE entity_key <> '' GROUP BY doc_id, entity_key""")
def entity_registry(spark: SparkSession, sf: str) -> DataFrame:
    found = match.captures(rule_matches(spark, sf), dims.rules(spark)).where("rule_id <> 'R15'")
    return graph.entities(found.select("doc_id", F.col("value").alias("surface"), F.col("start").alias("seq"), F.col("priority").alias("salience")), "doc_id").select("doc_id", "entity_key", "name", "mentions", "salience", F.array_join("aliases", "|").alias("aliases"), "entity_no")


@query("argument_roles", f"SELECT role, count(*) AS n, count(DISTINCT value) AS distinct_values FROM (SELECT value, CASE intent WHEN 'action' THEN 'object' WHEN 'condition' THEN 'condition' WHEN 'scope' THEN 'scope' WHEN 'reference' THEN 'reference' WHEN 'decision' THEN 'criterion' ELSE 'other' END AS role FROM ({_captured_sql()})) GROUP BY role")
def argument_roles(spark: SparkSession, sf: str) -> DataFrame:
    roles = dims.values(spark, [("action", "object"), ("condition", "condition"), ("scope", "scope"), ("reference", "reference"), ("decision", "criterion")], "intent string, role string")
    found = match.captures(rule_matches(spark, sf), dims.rules(spark)).join(roles, "intent", "left")
    return found.groupBy(F.coalesce("role", F.lit("other")).alias("role")).agg(F.count("*").alias("n"), F.count_distinct("value").alias("distinct_values"))


@query("node_caps", f"WITH m AS (SELECT doc_id, rule_id || '@' || s AS node, row_number() OVER (PARTITION BY doc_id ORDER BY s, rule_id) AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM ({_captured_sql()})) SELECT doc_id, node, FALSE AS limited FROM m WHERE n <= 16 UNION ALL SELECT doc_id, NULL, TRUE FROM m WHERE n = 1 AND total > 16")
def node_caps(spark: SparkSession, sf: str) -> DataFrame:
    nodes = rule_matches(spark, sf).select("doc_id", F.concat_ws("@", "rule_id", "start").alias("node"), "start", "rule_id")
    return graph.capped(nodes, "doc_id", ["start", "rule_id"], 16).select("doc_id", "node", "limited")


#: doc, external, timed_out, unsupported; doc, prop, kind, executable, quoted, mood, polite, sense, status, role; edges; conflicts; cyclic.
_G_DOCS = [(1, True, False, True), (2, True, False, True), (3, True, False, False), (4, False, True, True), (5, True, True, False), (6, True, False, False), (7, True, False, False), (8, True, False, True)]
_G_PROPS = [
    (1, "p1", "changes", True, False, "imperative", False, "RESOLVED", "RESOLVED", "action"),
    (2, "p1", "changes", False, True, "imperative", False, "RESOLVED", "RESOLVED", "action"),
    (3, "p1", "changes", True, False, "interrogative", True, "RESOLVED", "RESOLVED", "action"),
    (3, "p2", "observes", False, False, "declarative", False, "RESOLVED", "AMBIGUOUS", "reference"),
    (5, "p1", "changes", True, False, "imperative", False, "AMBIGUOUS", "RESOLVED", "action"),
    (6, "p1", "changes", True, False, "imperative", False, "RESOLVED", "RESOLVED", "action"),
    (6, "p2", "prohibits", False, False, "declarative", False, "RESOLVED", "RESOLVED", "constraint"),
    (6, "p3", "observes", False, False, "declarative", False, "RESOLVED", "INSUFFICIENT", "scope"),
    (7, "p1", "changes", True, False, "imperative", False, "RESOLVED", "RESOLVED", "action"),
    (7, "p9", "observes", False, False, "declarative", False, "RESOLVED", "INSUFFICIENT", "scope"),
    (8, "p1", "changes", False, False, "interrogative", False, "RESOLVED", "RESOLVED", "action"),
]
_G_EDGES = [(3, "p1", "p2"), (6, "p2", "p1"), (6, "p3", "p2")]
_G_CONFLICTS = [(6, "p2", "p1"), (7, "p9", None)]
_G_CYCLIC = [(7,)]
_P = dims.duck(_G_PROPS, ["g", "prop_id", "kind", "executable", "quoted", "mood", "polite", "sense_status", "status", "role"])
_GUARD_SQL = f"""WITH RECURSIVE d AS {dims.duck(_G_DOCS, ["g", "external", "timed_out", "unsupported"])}, p AS {_P}, e AS {dims.duck(_G_EDGES, ["g", "src", "dst"])}, c AS {dims.duck(_G_CONFLICTS, ["g", "a", "b"])},
  u AS (SELECT g, src, dst FROM e UNION SELECT g, dst, src FROM e), near AS (SELECT g, prop_id FROM p WHERE kind = 'changes' AND executable UNION SELECT n.g, u.dst FROM near n JOIN u ON u.g = n.g AND u.src = n.prop_id),
  rel AS (SELECT p.* FROM p JOIN near USING (g, prop_id)),
  r AS (SELECT g, 1 AS k, 'CONTRADICTORY' AS reason FROM c WHERE a IS NULL AND b IS NULL UNION SELECT c.g, 1, 'CONTRADICTORY' FROM c JOIN near n ON n.g = c.g AND (n.prop_id = c.a OR n.prop_id = c.b)
    UNION SELECT g, 2, 'TIMEOUT' FROM d WHERE timed_out UNION SELECT g, 2.5, 'UNSUPPORTED' FROM d WHERE unsupported AND g NOT IN (SELECT g FROM p WHERE kind = 'changes' AND executable) UNION SELECT g, 3, 'NON_EXECUTABLE_SPEECH_ACT' FROM p WHERE kind = 'changes' AND NOT executable AND NOT quoted AND mood <> 'interrogative'
    UNION SELECT g, 4, 'NO_EXECUTABLE_ACTION' FROM d WHERE g NOT IN (SELECT g FROM p WHERE kind = 'changes' AND executable) UNION SELECT g, 5, 'QUOTED_ACTION' FROM p WHERE kind = 'changes' AND quoted
    UNION SELECT g, 6, 'INTERROGATIVE_ACTION' FROM p WHERE kind = 'changes' AND mood = 'interrogative' AND NOT polite UNION SELECT g, 7, 'AMBIGUOUS_ACTION_SENSE' FROM rel WHERE kind = 'changes' AND sense_status = 'AMBIGUOUS'
    UNION SELECT g, 8, 'UNRESOLVED_SCOPE' FROM rel WHERE role = 'scope' AND status <> 'RESOLVED' UNION SELECT g, 9, 'AMBIGUOUS_OR_INSUFFICIENT_REFERENCE' FROM rel WHERE role = 'reference' AND status <> 'RESOLVED'
    UNION SELECT 7, 10, 'CYCLIC_ACTION_GRAPH'),
  l AS (SELECT d.g, external, string_agg(reason, ',' ORDER BY k) AS s FROM d LEFT JOIN r USING (g) GROUP BY d.g, external)"""


def _guarded(spark: SparkSession) -> DataFrame:
    v = dims.values
    return graph.guard(
        v(spark, _G_DOCS, "g int, external boolean, timed_out boolean, unsupported boolean"),
        v(spark, _G_PROPS, "g int, prop_id string, kind string, executable boolean, quoted boolean, mood string, polite boolean, sense_status string, status string, role string"),
        v(spark, _G_EDGES, "g int, src string, dst string"), v(spark, _G_CONFLICTS, "g int, constraint_id string, action_id string"), v(spark, _G_CYCLIC, "g int"), "g",
    )


@query("guard_reasons", f"{_GUARD_SQL} SELECT g, NOT external OR s IS NULL AS allowed, CASE WHEN external THEN coalesce(s, '') ELSE '' END AS reasons FROM l")
def guard_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _guarded(spark).select("g", "allowed", F.array_join("reasons", ",").alias("reasons"))


@query("overall_status", f"{_GUARD_SQL} SELECT l.g, CASE WHEN n IS NULL THEN 'FAILED' WHEN open > 0 OR (external AND s IS NOT NULL) THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM l LEFT JOIN (SELECT g, count(*) AS n, count(*) FILTER (status <> 'RESOLVED' OR sense_status <> 'RESOLVED') AS open FROM p GROUP BY g) USING (g)")
def overall_status(spark: SparkSession, sf: str) -> DataFrame:
    """FAILED without any proposition, PARTIAL where one is not resolved or the guard blocks, else COMPLETE."""
    p = dims.values(spark, _G_PROPS, "g int, prop_id string, kind string, executable boolean, quoted boolean, mood string, polite boolean, sense_status string, status string, role string")
    state = p.groupBy("g").agg(F.bool_or((F.col("status") != "RESOLVED") | (F.col("sense_status") != "RESOLVED")).alias("open"))
    status = F.when(F.col("open").isNull(), "FAILED").when(F.col("open") | ~F.col("allowed"), "PARTIAL").otherwise("COMPLETE")
    return _guarded(spark).join(state, "g", "left").select("g", status.alias("status"))


@query("decision_latest_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS decisions FROM events GROUP BY user_id")
def decision_latest_state(spark: SparkSession, sf: str) -> DataFrame:
    """A user's decisions, folded to the last one."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("decisions"))
