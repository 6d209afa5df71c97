"""Queries of the meaning layer over all utterances of the conversations; short patterns stand for the rules of a language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import meaning, segment
from . import dims
from .registry import query, table
from .texts import _duck_spans

_PATTERNS = {"action": " the ([a-z]+)", "request": " of the ([a-z]+)", "modify": " to ([a-z]+)", "condition": " in ([a-z]+)", "reference": " (it|this)"}
_U = "(SELECT conv_id * 1000 + turn AS utt, role, text FROM conversations)"
_HITS = " UNION ALL ".join(f"SELECT utt, text, '{i}' AS intent, CAST(s AS INTEGER) AS s, CAST(e AS INTEGER) AS e, regexp_extract(surface, '{p}', 1) AS target FROM ({_duck_spans(_U, 'utt, text', 'text', p)})" for i, p in _PATTERNS.items())
_P = f"""p AS (SELECT utt, text, intent, s, e, target, intent || '@' || s AS prop_id, CAST(length(regexp_replace(substr(text, 1, s), '[^.!?]', '', 'g')) + 1 AS INTEGER) AS clause_no,
  CAST(length(regexp_extract(substr(text, 1, s), '(?s)^.*[.!?]')) AS INTEGER) AS cs, CAST(s + length(regexp_extract(substr(text, s + 1), '(?s)^[^.!?]*')) AS INTEGER) AS ce,
  intent IN ('action', 'request', 'modify') AS executable, CASE WHEN length(target) < 3 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS status FROM ({_HITS}))"""


def utterances(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("utt"), "role", "text")


def props(spark: SparkSession, sf: str) -> DataFrame:
    def of(intent: str, pattern: str):
        return F.transform(X.spans(F.col("text"), pattern), lambda m: F.struct(F.lit(intent).alias("intent"), m["start"].alias("start"), m["end"].alias("end"), F.regexp_extract(m["surface"], pattern, 1).alias("target")))

    found = F.flatten(F.array(*[of(i, p) for i, p in _PATTERNS.items()]))
    rows = utterances(spark, sf).select("utt", "text", F.explode(found).alias("m")).select("utt", "text", "m.*")
    before, after = F.substring("text", F.lit(1), F.col("start")), F.substring(F.col("text"), F.col("start") + 1, F.length("text"))
    return rows.select(
        "utt", "text", "intent", "start", "end", "target", F.concat_ws("@", "intent", "start").alias("prop_id"), (F.length(F.regexp_replace(before, "[^.!?]", "")) + 1).alias("clause_no"),
        F.length(F.regexp_extract(before, "(?s)^.*[.!?]", 0)).alias("clause_start"), (F.col("start") + F.length(F.regexp_extract(after, "(?s)^[^.!?]*", 0))).alias("clause_end"),
        F.col("intent").isin("action", "request", "modify").alias("executable"), F.lit(False).alias("quoted"), F.when(F.length("target") < 3, "AMBIGUOUS").otherwise("RESOLVED").alias("status"),
    )


_RELATION = "CASE intent WHEN 'modify' THEN 'precedes' WHEN 'condition' THEN 'depends_on' WHEN 'reference' THEN 'preserves' ELSE 'excludes' END"
_E = f"e AS (SELECT utt, prop_id AS src, nxt AS dst, {_RELATION} AS relation FROM (SELECT *, lead(prop_id) OVER (PARTITION BY utt ORDER BY s, prop_id) AS nxt FROM p) WHERE nxt IS NOT NULL)"
_TO = "t AS (SELECT p.utt, p.prop_id, coalesce(r.task_id, p.prop_id) AS task_id FROM p LEFT JOIN (SELECT a.utt, a.prop_id, arg_min(b.prop_id, (CASE WHEN a.clause_no <> b.clause_no THEN 1 ELSE 0 END, abs(a.s - b.s), b.s, b.prop_id)) AS task_id FROM p a JOIN p b ON a.utt = b.utt AND a.intent = 'request' AND b.executable AND b.intent <> 'request' AND a.s < b.e AND b.s < a.e GROUP BY ALL) r ON r.utt = p.utt AND r.prop_id = p.prop_id WHERE p.executable)"


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    relation = F.when(F.col("intent") == "modify", "precedes").when(F.col("intent") == "condition", "depends_on").when(F.col("intent") == "reference", "preserves").otherwise("excludes")
    nxt = F.lead("prop_id").over(W.partitionBy("utt").orderBy("start", "prop_id"))
    return props(spark, sf).select("utt", F.col("prop_id").alias("src"), nxt.alias("dst"), relation.alias("relation")).where("dst is not null")


@query("request_redirect", f"WITH {_P}, {_TO} SELECT utt, prop_id, task_id FROM t")
def request_redirect(spark: SparkSession, sf: str) -> DataFrame:
    return meaning.redirect_requests(props(spark, sf), "utt")


@query("action_tasks", f"WITH {_P}, {_TO} SELECT utt, task_id FROM t WHERE prop_id = task_id")
def action_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return meaning.task_graph(props(spark, sf), _edges(spark, sf), "utt", ["preserves", "excludes"])[0]


@query("action_dependencies", f"WITH {_P}, {_E}, {_TO} SELECT utt, src, dst, max(relation) AS relation FROM (SELECT e.utt, CASE relation WHEN 'precedes' THEN a.task_id ELSE b.task_id END AS src, CASE relation WHEN 'precedes' THEN b.task_id ELSE a.task_id END AS dst, relation FROM e JOIN t a ON a.utt = e.utt AND a.prop_id = e.src JOIN t b ON b.utt = e.utt AND b.prop_id = e.dst WHERE relation IN ('precedes', 'depends_on')) WHERE src <> dst GROUP BY utt, src, dst")
def action_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return meaning.task_graph(props(spark, sf), _edges(spark, sf), "utt", ["preserves", "excludes"])[1]


@query("action_constraints", f"WITH {_P}, {_E}, {_TO} SELECT DISTINCT e.utt, t.task_id, relation, src AS source_id FROM e JOIN t ON t.utt = e.utt AND t.prop_id = e.dst WHERE relation IN ('preserves', 'excludes')")
def action_constraints(spark: SparkSession, sf: str) -> DataFrame:
    return meaning.task_graph(props(spark, sf), _edges(spark, sf), "utt", ["preserves", "excludes"])[2]


@query("task_graph_status", f"WITH {_P} SELECT utt, CASE WHEN bool_and(status = 'RESOLVED') THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status FROM p WHERE executable GROUP BY utt")
def task_graph_status(spark: SparkSession, sf: str) -> DataFrame:
    return props(spark, sf).where("executable").groupBy("utt").agg(F.when(F.bool_and(F.col("status") == "RESOLVED"), "RESOLVED").otherwise("AMBIGUOUS").alias("status"))


# Fragments: the target of every condition; tasks: the executable propositions.
_FRAGMENT = f"""WITH {_P}, f AS (SELECT utt, prop_id AS fragment_id, lower(target) AS f, CASE WHEN strpos(substr(text, s + 1, e - s), target) > 0 THEN s + strpos(substr(text, s + 1, e - s), target) - 1 ELSE strpos(text, target) - 1 END AS pl FROM p WHERE intent = 'condition'),
  k AS (SELECT utt, prop_id AS task_id, intent, lower(target) AS t, lower(substr(text, s + 1, e - s)) AS src, s, e FROM p WHERE executable),
  m AS (SELECT utt, fragment_id, arg_min(task_id, (-score, d, s, task_id)) AS task_id, CAST(max(score) AS INTEGER) AS score FROM (SELECT f.utt, fragment_id, task_id, s, abs(s - greatest(pl, 0)) AS d,
    CASE WHEN t = f THEN 100 WHEN t <> '' AND (contains(t, f) OR contains(f, t)) THEN 60 ELSE 0 END + CASE WHEN contains(src, f) THEN 40 ELSE 0 END + CASE WHEN pl >= 0 AND s < pl + length(f) AND pl < e THEN 80 ELSE 0 END - CASE WHEN intent = 'request' THEN 20 ELSE 0 END AS score
    FROM f JOIN k USING (utt)) WHERE score > 0 GROUP BY utt, fragment_id)"""


def _matched(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = props(spark, sf)
    fragments = p.where("intent = 'condition'").select("utt", F.col("prop_id").alias("fragment_id"), F.col("target").alias("fragment"), F.coalesce(meaning.locate(F.col("text"), F.col("target"), F.col("start"), F.col("end"))["start"], F.lit(-1)).alias("at"))
    tasks = p.where("executable").select("utt", F.col("prop_id").alias("task_id"), "intent", "target", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("source"), "start", "end")
    return meaning.match_fragments(fragments, tasks, "utt", ["request"]), tasks


@query("fragment_tasks", f"{_FRAGMENT} SELECT utt, fragment_id, task_id, score FROM m")
def fragment_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf)[0]


_NEXT = "r AS (SELECT utt, fragment_id AS first, lead(fragment_id) OVER (PARTITION BY utt ORDER BY pl, fragment_id) AS second FROM f)"


@query("typed_task_edges", f"{_FRAGMENT}, {_NEXT}, l AS (SELECT utt, max(fragment_id) AS second FROM f GROUP BY utt) SELECT DISTINCT utt, src, dst FROM (SELECT r.utt, a.task_id AS src, b.task_id AS dst FROM r JOIN m a ON a.utt = r.utt AND a.fragment_id = r.first JOIN m b ON b.utt = r.utt AND b.fragment_id = r.second UNION ALL SELECT l.utt, x.task_id, m.task_id FROM l JOIN m ON m.utt = l.utt AND m.fragment_id = l.second JOIN k y ON y.utt = l.utt AND y.task_id = m.task_id JOIN k x ON x.utt = l.utt AND x.s < y.s) WHERE src <> dst")
def typed_task_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Each condition with the next one, and the last one fanning in all tasks before it."""
    from pyspark.sql import Window as W

    matched, tasks = _matched(spark, sf)
    f = props(spark, sf).where("intent = 'condition'").select("utt", "prop_id", F.coalesce(meaning.locate(F.col("text"), F.col("target"), F.col("start"), F.col("end"))["start"], F.lit(-1)).alias("at"))
    pairs = f.select("utt", F.col("prop_id").alias("first"), F.lead("prop_id").over(W.partitionBy("utt").orderBy("at", "prop_id")).alias("second")).where("second is not null")
    last = f.groupBy("utt").agg(F.max("prop_id").alias("second")).select("utt", F.lit(None).cast("string").alias("first"), "second")
    return meaning.fragment_edges(pairs.unionByName(last), matched, tasks, "utt")


@query("fragment_locate", f"WITH {_P} SELECT utt, prop_id, CASE WHEN strpos(substr(text, s + 3, 4), target) > 0 THEN CAST(s + 1 + strpos(substr(text, s + 3, 4), target) AS INTEGER) ELSE CAST(strpos(text, target) - 1 AS INTEGER) END AS at FROM p")
def fragment_locate(spark: SparkSession, sf: str) -> DataFrame:
    """A window of four characters is looked through first, then the whole text."""
    at = meaning.locate(F.col("text"), F.col("target"), F.col("start") + 2, F.col("start") + 6)
    return props(spark, sf).select("utt", "prop_id", at["start"].alias("at"))


_TOKENS = rf"k AS (SELECT utt, CAST(pos AS INTEGER) AS pos, s AS ts, e AS te FROM ({_duck_spans(_U, 'utt', 'text', '[a-z]+ing')}))"


@query("token_propositions", f"WITH {_P}, {_TOKENS}, b AS (SELECT k.utt, pos, prop_id, CASE WHEN ts < e AND s < te THEN 0 WHEN cs <= ts AND te <= ce THEN 1 END AS tier FROM k JOIN p ON p.utt = k.utt AND ts < ce AND cs < te) SELECT utt, pos, prop_id FROM (SELECT *, min(tier) OVER (PARTITION BY utt, pos) AS best FROM b WHERE tier IS NOT NULL) WHERE tier = best")
def token_propositions(spark: SparkSession, sf: str) -> DataFrame:
    tokens = utterances(spark, sf).select("utt", F.posexplode(X.spans(F.col("text"), "[a-z]+ing")).alias("pos", "t")).select("utt", "pos", "t.start", "t.end")
    return meaning.tokens_to_props(tokens, props(spark, sf), "utt")


_KEY = r"regexp_replace(lower(target), '[^\p{L}\p{N}]+', '', 'g')"
_OWN = f"o AS (SELECT utt, {_KEY} AS entity_key, arg_min(prop_id, (s, prop_id)) AS entity_id FROM p GROUP BY ALL)"


def _owners(spark: SparkSession, sf: str) -> DataFrame:
    return meaning.first_owners(props(spark, sf).select("utt", F.col("target").alias("name"), F.col("prop_id").alias("entity_id"), F.col("start").alias("seq")), "utt")


@query("entity_owner_index", f"WITH {_P}, {_OWN} SELECT utt, entity_key, entity_id FROM o WHERE entity_key <> ''")
def entity_owner_index(spark: SparkSession, sf: str) -> DataFrame:
    return _owners(spark, sf)


@query("target_arguments", f"WITH {_P}, {_OWN} SELECT p.utt, p.prop_id, CAST(s + strpos(substr(text, s + 1, e - s), target) - 1 AS INTEGER) AS \"start\", CAST(s + strpos(substr(text, s + 1, e - s), target) - 1 + length(target) AS INTEGER) AS \"end\", entity_id FROM p JOIN o ON o.utt = p.utt AND o.entity_key = {_KEY} WHERE target <> ''")
def target_arguments(spark: SparkSession, sf: str) -> DataFrame:
    return meaning.target_arguments(props(spark, sf), _owners(spark, sf), "utt", "text")


@query("entity_ensure", f"WITH {_P}, k AS (SELECT utt, CAST(row_number() OVER (PARTITION BY utt ORDER BY min(s), target) AS INTEGER) AS entity_no, target AS name FROM p WHERE intent = 'action' GROUP BY utt, target), w AS (SELECT utt, target AS name, min(s) AS s FROM p WHERE intent <> 'action' GROUP BY utt, target), l AS (SELECT utt, max(entity_no) AS last FROM k GROUP BY utt) SELECT * FROM k UNION ALL SELECT w.utt, CAST(coalesce(last, 0) + row_number() OVER (PARTITION BY w.utt ORDER BY s, name) AS INTEGER), name FROM w LEFT JOIN l USING (utt) WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.utt = w.utt AND k.name = w.name)")
def entity_ensure(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    p = props(spark, sf)
    known = p.where("intent = 'action'").groupBy("utt", F.col("target").alias("name")).agg(F.min("start").alias("s")).withColumn("entity_no", F.row_number().over(W.partitionBy("utt").orderBy("s", "name")))
    return meaning.ensure_entities(known, p.where("intent <> 'action'").select("utt", F.col("target").alias("name"), F.col("start").alias("seq")), "utt")


@query("legacy_view", f"WITH {_P} SELECT utt, intent, s AS \"start\", e AS \"end\" FROM p c WHERE intent = 'reference' OR (intent <> 'reference' AND status = 'RESOLVED')")
def legacy_view(spark: SparkSession, sf: str) -> DataFrame:
    p = props(spark, sf)
    return meaning.emit_represented(p.select("utt", "intent", "start", "end"), p.where("status = 'RESOLVED'"), "utt")


@query("insert_apart", f"WITH {_P} SELECT utt, prop_id FROM p WHERE intent = 'request' UNION ALL SELECT utt, prop_id FROM p a WHERE intent <> 'request' AND NOT EXISTS (SELECT 1 FROM p b WHERE b.utt = a.utt AND b.intent = 'request' AND a.s < b.e AND b.s < a.e)")
def insert_apart(spark: SparkSession, sf: str) -> DataFrame:
    """Bare actions and observations: what overlaps none that is there already."""
    p = props(spark, sf)
    return meaning.insert_apart(p.where("intent = 'request'"), p.where("intent <> 'request'"), "utt", None).select("utt", "prop_id")


_ACTS = f"a AS (SELECT utt, CAST(pos AS INTEGER) AS act_id, s, e, 'polite' AS speech_act FROM ({_duck_spans(_U, 'utt', 'text', 'the [a-z]+ing')}))"


@query("pragmatic_upsert", f"""WITH {_P}, {_ACTS}, h AS (SELECT a.utt, act_id, arg_min(prop_id, (CASE WHEN intent IN ('modify') THEN 0 ELSE 1 END, p.s, prop_id)) AS prop_id FROM a JOIN p ON p.utt = a.utt AND p.s < a.e AND a.s < p.e GROUP BY ALL)
  SELECT p.utt, p.prop_id, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.utt = p.utt AND h.prop_id = p.prop_id) THEN 'polite' END AS speech_act, executable FROM p UNION ALL SELECT utt, 'new-' || act_id, 'polite', FALSE FROM a WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.utt = a.utt AND h.act_id = a.act_id)""")
def pragmatic_upsert(spark: SparkSession, sf: str) -> DataFrame:
    p = props(spark, sf).withColumn("speech_act", F.lit(None).cast("string"))
    acts = utterances(spark, sf).select("utt", F.posexplode(X.spans(F.col("text"), "the [a-z]+ing")).alias("act_id", "m")).select("utt", "act_id", "m.start", "m.end", F.lit("polite").alias("speech_act"), F.lit("act").alias("intent"), F.lit(None).cast("string").alias("target"), F.lit(True).alias("executable"))
    return meaning.upsert(p, acts, "utt", ["speech_act"], ["modify"]).select("utt", "prop_id", "speech_act", "executable")


@query("clause_observations", f"WITH {_P}, c AS (SELECT utt, CAST(unnest(range(1, len(regexp_extract_all(text, '[.!?]')) + 2)) AS INTEGER) AS clause_no FROM {_U}) SELECT utt, clause_no, coalesce(arg_min(prop_id, (s, prop_id)), 'obs-' || clause_no) AS prop_id, count(prop_id) = 0 AS inserted FROM c LEFT JOIN p USING (utt, clause_no) GROUP BY utt, clause_no")
def clause_observations(spark: SparkSession, sf: str) -> DataFrame:
    clauses = utterances(spark, sf).select("utt", F.explode(F.sequence(F.lit(1), F.regexp_count("text", F.lit("[.!?]")) + 1)).alias("clause_no"))
    return meaning.clause_observations(clauses, props(spark, sf), "utt")


@query("edge_add", f"WITH {_P}, {_E}, x AS (SELECT DISTINCT utt, src, dst, relation FROM (SELECT * FROM e UNION ALL SELECT utt, src, dst, relation FROM e WHERE relation = 'precedes')), n AS (SELECT *, row_number() OVER (PARTITION BY utt ORDER BY src, dst, relation) AS n, count(*) OVER (PARTITION BY utt) AS total FROM x) SELECT utt, src, dst, relation, FALSE AS limited FROM n WHERE n <= 12 UNION ALL SELECT utt, NULL, NULL, NULL, TRUE FROM n WHERE n = 1 AND total > 12")
def edge_add(spark: SparkSession, sf: str) -> DataFrame:
    e = _edges(spark, sf)
    return meaning.add_edges(e, e.where("relation = 'precedes'"), "utt", 12)


@query("sequence_refinement", f"WITH {_P}, {_E} SELECT utt, arg_min(prop_id, (s, prop_id)) AS src, arg_max(prop_id, (s, prop_id)) AS dst FROM p WHERE executable AND contains(text, ' on ') AND utt NOT IN (SELECT utt FROM e WHERE relation = 'precedes') GROUP BY utt HAVING count(*) >= 2")
def sequence_refinement(spark: SparkSession, sf: str) -> DataFrame:
    return meaning.sequence_edges(props(spark, sf), _edges(spark, sf), utterances(spark, sf).where("contains(text, ' on ')"), "utt")


@query("sequence_completion", f"SELECT utt, a AS first, b AS second FROM (SELECT utt, regexp_extract(text, '([a-z]+) and ([a-z]+)', 1) AS a, regexp_extract(text, '([a-z]+) and ([a-z]+)', 2) AS b FROM {_U}) WHERE a <> '' AND b <> ''")
def sequence_completion(spark: SparkSession, sf: str) -> DataFrame:
    return meaning.split_sequence(utterances(spark, sf), "utt", "text", "([a-z]+) and ([a-z]+)")


@query("purpose_edges", f"WITH {_P} SELECT utt, arg_min(prop_id, (s, prop_id)) AS prop_id, any_value(regexp_extract(text, ' for ([a-z]+)', 1)) AS purpose FROM p WHERE executable AND regexp_matches(text, ' for [a-z]') GROUP BY utt")
def purpose_edges(spark: SparkSession, sf: str) -> DataFrame:
    return meaning.purpose_edges(props(spark, sf), utterances(spark, sf), "utt", "text", " for ([a-z]+)")


@query("reported_demotion", f"WITH {_P} SELECT utt, prop_id, executable AND NOT contains(text, ' that ') AS executable, contains(text, ' that ') AS quoted FROM p")
def reported_demotion(spark: SparkSession, sf: str) -> DataFrame:
    return meaning.demote_reported(props(spark, sf), utterances(spark, sf), "utt", "text", " that ").select("utt", "prop_id", "executable", "quoted")


_CLASSES = [("contrasts_with", "^(but|aber|mais)[ ,]"), ("elaborates", "^(the|der|la|in)[ ,]")]
_C = f"c AS (SELECT utt, CAST(row_number() OVER (PARTITION BY utt ORDER BY pos) AS INTEGER) AS clause_no, surface AS clause FROM ({_duck_spans(_U, 'utt', 'text', segment.CLAUSE)}))"


@query("discourse_edges", f"WITH {_C.replace('surface AS clause', '''regexp_replace(trim(surface, ' '), '[\\n]+$', '') AS clause''')}, b AS (SELECT utt, clause_no AS dst, lag(clause_no) OVER w AS src, lag(clause) OVER w AS before, lower(clause) AS now FROM c WINDOW w AS (PARTITION BY utt ORDER BY clause_no)), r AS (SELECT *, CASE WHEN regexp_matches(now, '^(but|aber|mais)[ ,]') THEN 'contrasts_with' WHEN regexp_matches(now, '^(the|der|la|in)[ ,]') THEN 'elaborates' WHEN regexp_matches(lower(before), ' (or|ou|oder) ') THEN 'alternative_to' END AS relation FROM b WHERE src IS NOT NULL) SELECT utt, src, dst, relation FROM r WHERE relation IS NOT NULL")
def discourse_edges(spark: SparkSession, sf: str) -> DataFrame:
    clauses = segment.clauses(utterances(spark, sf), "utt")
    return meaning.discourse_edges(clauses, "utt", _CLASSES, ("alternative_to", " (or|ou|oder) "))


_EPISTEMIC = [("hypothetical", " (if|si|wenn) "), ("uncertain", " (may|might|peut) "), ("reported", " (that|que|dass) "), ("asserted", " (is|est|ist|es) ")]


@query("epistemic_status", f"SELECT utt, CASE {' '.join(f'''WHEN regexp_matches(text, '{p}') THEN '{n}' ''' for n, p in _EPISTEMIC)} ELSE 'unmarked' END AS status FROM {_U}")
def epistemic_status(spark: SparkSession, sf: str) -> DataFrame:
    return utterances(spark, sf).select("utt", meaning.first_that_fits(F.col("text"), _EPISTEMIC, "unmarked").alias("status"))


_SUFFIX = [("tion", "instrument"), ("ing", "manner"), ("on", "place"), ("er", "agent"), ("e", "theme")]
_ROLE = f"CASE {' '.join(f'''WHEN suffix(target, '{m}') THEN '{r}' ''' for m, r in _SUFFIX)} END"


@query("case_roles", f"WITH {_P} SELECT utt, prop_id, {_ROLE} AS case_role, CASE WHEN intent IN ('action', 'condition') THEN coalesce({_ROLE}, 'object') ELSE 'object' END AS role, intent IN ('request') AS _drop FROM p".replace(", intent IN ('request') AS _drop", ""))
def case_roles(spark: SparkSession, sf: str) -> DataFrame:
    default = F.when(F.col("intent").isin("action", "condition"), "open").otherwise("object")
    role = meaning.argument_role(default, F.col("target"), _SUFFIX, ["open"])
    return props(spark, sf).select("utt", "prop_id", meaning.case_role(F.col("target"), _SUFFIX).alias("case_role"), F.when(role == "open", "object").otherwise(role).alias("role"))


@query("picked_targets", f"WITH {_P} SELECT utt, coalesce(max(target) FILTER (intent = 'modify'), max(target) FILTER (intent = 'action')) AS picked FROM p GROUP BY utt")
def picked_targets(spark: SparkSession, sf: str) -> DataFrame:
    held = props(spark, sf).groupBy("utt", "intent").agg(F.max("target").alias("t")).groupBy("utt").agg(F.map_from_entries(F.collect_list(F.struct("intent", "t"))).alias("captures"))
    return held.select("utt", meaning.picked(F.col("captures"), ["modify", "action"]).alias("picked"))


@query("topic_marking", f"WITH {_P} SELECT utt, prop_id, contains(text, target || ' is') OR contains(text, target || ' was') AS topic FROM p")
def topic_marking(spark: SparkSession, sf: str) -> DataFrame:
    return props(spark, sf).select("utt", "prop_id", meaning.marked(F.col("text"), F.col("target"), [" is", " was"]).alias("topic"))


@query("nearest_arguments", f"WITH {_P}, g AS (SELECT utt, prop_id, trim(list_extract(regexp_split_to_array(substr(text, cs + 1, s - cs), '[,.!?;:]'), -1), ' ') AS seg FROM p) SELECT utt, prop_id, NULLIF(regexp_extract(seg, '^(.{{1,48}}?) (from|on|by)$', 2), '') AS marker FROM g")
def nearest_arguments(spark: SparkSession, sf: str) -> DataFrame:
    return props(spark, sf).select("utt", "prop_id", meaning.nearest_argument(F.col("text"), F.col("clause_start"), F.col("start"), ["from", "on", "by"])["marker"].alias("marker"))


_ACTION = "([a-z]+) (is|was|on) "


@query("action_details", f"SELECT utt, regexp_extract(text, '{_ACTION}', 1) AS target, CASE regexp_extract(text, '{_ACTION}', 2) WHEN 'is' THEN 'state' WHEN 'was' THEN 'past' ELSE 'place' END AS intent FROM {_U} WHERE regexp_matches(text, '{_ACTION}') AND regexp_extract(text, '{_ACTION}', 1) NOT IN ('and', 'but', 'then', 'so', 'only', 'too', 'also')")
def action_details(spark: SparkSession, sf: str) -> DataFrame:
    d = meaning.action_details(F.col("text"), _ACTION, {"is": ("state", "be"), "was": ("past", "be"), "on": ("place", "stand")})
    return utterances(spark, sf).select("utt", d.alias("d")).where("d is not null").select("utt", "d.target", "d.intent").where("target not in ('and', 'but', 'then', 'so', 'only', 'too', 'also')")


@query("reference_merge", f"WITH {_P} SELECT utt, target AS value, s AS \"start\", e AS \"end\", 7 AS priority FROM p WHERE intent = 'reference' AND contains(text, ' is ') UNION ALL SELECT utt, target, s, e, 5 FROM p WHERE intent = 'reference' AND NOT contains(text, ' is ')")
def reference_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Demonstratives are discovered, and merged with what the rules gave for some of them at a greater priority."""
    found = meaning.discover_references(utterances(spark, sf), "utt", "text", " (it|this)", X.spans).withColumn("value", F.trim("value"))
    again = found.join(utterances(spark, sf).where("contains(text, ' is ')").select("utt"), "utt", "left_semi").withColumn("priority", F.lit(7))
    return meaning.merge_references(found.unionByName(again), "utt").select("utt", "value", "start", "end", "priority")


@query("mention_collection", f"WITH {_P}, f AS (SELECT utt, target, min(s) AS s FROM p WHERE intent <> 'reference' GROUP BY utt, target) SELECT utt, string_agg(target, '|' ORDER BY s, target) AS mentions FROM f GROUP BY utt")
def mention_collection(spark: SparkSession, sf: str) -> DataFrame:
    captured = props(spark, sf).select("utt", "intent", "start", F.col("target").alias("value"))
    return meaning.mentions(captured, "utt").select("utt", F.array_join("mentions", "|").alias("mentions"))


_GENERIC = ["it", "this", "the", "a", "of"]
_VALID = f"length(x) >= 2 AND x NOT IN ({', '.join(repr(g) for g in _GENERIC)})"


@query("candidate_objects", f"SELECT utt, array_to_string(list_filter(regexp_extract_all(substr(text, 1, 200), '(?:the|of) ([a-z]+)', 1), lambda x: {_VALID}), '|') AS objects FROM {_U}")
def candidate_objects(spark: SparkSession, sf: str) -> DataFrame:
    return meaning.objects_before(utterances(spark, sf), "utt", "text", F.lit(200), "(?:the|of) ([a-z]+)", _GENERIC).select("utt", F.array_join("objects", "|").alias("objects"))


@query("ellipsis_refinement", f"WITH {_P}, c AS (SELECT utt, list_filter(regexp_extract_all(text, '(?:the|of) ([a-z]+)', 1), lambda x: {_VALID}) AS l FROM {_U}) SELECT utt, prop_id, CASE WHEN length(target) < 2 OR target IN ({', '.join(repr(g) for g in _GENERIC)}) THEN coalesce(l[-1], target) ELSE target END AS target FROM p JOIN c USING (utt)")
def ellipsis_refinement(spark: SparkSession, sf: str) -> DataFrame:
    objects = utterances(spark, sf).select("utt", F.regexp_extract_all("text", F.lit("(?:the|of) ([a-z]+)"), F.lit(1)).alias("cands"))
    held = props(spark, sf).withColumn("inferred", F.lit(True)).join(objects, "utt")
    return meaning.refine_targets(held, _GENERIC, "cands").select("utt", "prop_id", "target")


@query("previous_fallback", f"SELECT utt, CASE WHEN contains(text, ' this ') THEN w[-1] END AS resolved FROM (SELECT utt, text, regexp_extract_all(text, '[a-z]{{4,}}') AS w FROM {_U})")
def previous_fallback(spark: SparkSession, sf: str) -> DataFrame:
    held = utterances(spark, sf).withColumn("context", F.regexp_extract_all("text", F.lit("[a-z]{4,}"), F.lit(0))).withColumn("resolved", F.lit(None).cast("string"))
    return meaning.previous_fallback(held, "context", F.contains(F.col("text"), F.lit(" this "))).select("utt", "resolved")


@query("predicate_only", f"WITH {_P} SELECT utt, prop_id, regexp_replace(target, '(?:ing|ed)$', '') IN ('th', 'er', 'on', 'in', 'nd') AS only_predicate FROM p")
def predicate_only(spark: SparkSession, sf: str) -> DataFrame:
    return props(spark, sf).select("utt", "prop_id", meaning.predicate_only(F.col("target"), F.lit("whole sentence"), ["th", "er", "on", "in", "nd"], ["ing", "ed"]).alias("only_predicate"))


@query("fragment_clean", f"WITH {_P} SELECT utt, prop_id, target AS cleaned FROM p")
def fragment_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Noise that is put around every target goes again."""
    noisy = F.concat(F.lit(" «and, then "), F.col("target"), F.lit(" only, too!? "))
    keep = F.col("target").isin(*meaning.CONNECTIVES, *meaning.LIMITERS)
    return props(spark, sf).select("utt", "prop_id", F.when(keep, F.col("target")).otherwise(meaning.clean_fragment(noisy)).alias("cleaned"))


@query("reference_scores", f"WITH {_P}, q AS (SELECT utt, target, CAST(row_number() OVER (PARTITION BY utt ORDER BY s DESC, prop_id) - 1 AS INTEGER) AS rank FROM p WHERE intent = 'action') SELECT utt, rank, CAST(100 - least(30, rank * 4) + CASE WHEN target = 'an' THEN 130 WHEN contains(target, 'an') THEN 100 WHEN contains('an', target) THEN 60 ELSE -80 END + CASE WHEN contains(target, 'an') THEN 25 ELSE 0 END AS INTEGER) AS score FROM q")
def reference_scores(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    pool = props(spark, sf).where("intent = 'action'").withColumn("rank", F.row_number().over(W.partitionBy("utt").orderBy(F.desc("start"), "prop_id")) - 1)
    return pool.select("utt", "rank", meaning.reference_score(F.lit("current"), F.col("rank"), F.lit("an"), F.col("target"), F.lit(False), F.lit(True)).alias("score"))


@query("lexical_scores", "SELECT p_partkey, CAST(CASE p_size % 3 WHEN 0 THEN 100 WHEN 1 THEN 75 ELSE 50 END + CASE WHEN p_size % 2 = 0 THEN 30 ELSE 0 END + CASE WHEN p_name LIKE '%red%' THEN 20 ELSE 0 END + CASE WHEN p_size > 40 THEN 10 ELSE 0 END + CASE WHEN p_size < 5 THEN 5 ELSE 0 END + CASE WHEN p_size = 7 THEN 5 ELSE 0 END + CASE WHEN p_type LIKE '%BRASS' THEN 25 ELSE 0 END + 1 AS INTEGER) AS score FROM part")
def lexical_scores(spark: SparkSession, sf: str) -> DataFrame:
    n, like = F.col("p_size"), lambda c, p: F.col(c).like(p)
    return table(spark, sf, "part").select("p_partkey", meaning.lexical_score(n % 3, n % 2 == 0, like("p_name", "%red%"), n > 40, n < 5, n == 7, like("p_type", "%BRASS"), F.lit(True)).alias("score"))


@query("pack_scores", f"SELECT utt, CASE WHEN NOT contains(t, 'the') OR NOT contains(t, 'of') THEN NULL WHEN NOT (contains(t, 'in') OR contains(t, 'zz')) THEN NULL WHEN contains(t, 'xx') THEN NULL ELSE CAST(100 + 40 + 25 + CASE WHEN contains(t, 'on') THEN 10 ELSE 0 END + 1 AS INTEGER) END AS score FROM (SELECT utt, lower(text) AS t FROM {_U})")
def pack_scores(spark: SparkSession, sf: str) -> DataFrame:
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    return utterances(spark, sf).select("utt", meaning.pack_score(F.lower("text"), F.lit(False), words("the", "of"), words("in", "zz"), words("xx"), words("on"), F.lit(True)).alias("score"))


@query("pack_parameters", f"WITH {_P} SELECT utt, prop_id, CASE WHEN length(target) > 4 THEN 'long' ELSE 'plain' END AS speech_act, CASE WHEN length(target) > 4 THEN 'old|new' ELSE 'old' END AS labels FROM p")
def pack_parameters(spark: SparkSession, sf: str) -> DataFrame:
    given = F.when(F.length("target") > 4, F.struct(F.lit("long").alias("speech_act"), F.array(F.lit("new"), F.lit("old")).alias("labels")))
    rows = props(spark, sf).withColumn("speech_act", F.lit("plain")).withColumn("labels", F.array(F.lit("old"))).withColumn("parameters", given)
    return meaning.apply_parameters(rows, "parameters", ["speech_act"], ["labels"]).select("utt", "prop_id", "speech_act", F.array_join("labels", "|").alias("labels"))


_CLAUSE_SQL = _C.replace("surface AS clause", "regexp_replace(trim(surface, ' '), '[\\n]+$', '') AS clause")


@query("sense_completion", f"WITH {_CLAUSE_SQL}, m AS (SELECT utt, clause_no, 'on' AS lemma, CASE WHEN contains(lower(clause), 'the') AND contains(lower(clause), 'of') THEN 'place' WHEN contains(lower(clause), 'is') THEN 'state' END AS sense FROM c WHERE contains(lower(clause), 'on')) SELECT utt, clause_no, lemma, sense FROM m WHERE sense IS NOT NULL AND clause_no <> 1")
def sense_completion(spark: SparkSession, sf: str) -> DataFrame:
    """Every first clause counts as resolved."""
    clauses = segment.clauses(utterances(spark, sf), "utt")
    resolved = clauses.where("clause_no = 1").select("utt", "clause_no", F.lit("on").alias("lemma"))
    return meaning.complete_senses(clauses, resolved, "utt", [("on", "place", ["the", "of"]), ("on", "state", ["is"])])


@query("clarification_completion", f"WITH {_P}, u AS (SELECT utt, CAST(unnest(range(1, len(regexp_extract_all(text, '[.!?]')) + 2)) AS INTEGER) AS clause_no, text FROM {_U}), k AS (SELECT utt, clause_no FROM u WHERE regexp_matches(text, ' (is|est) ')) SELECT k.utt, k.clause_no, coalesce(arg_min(prop_id, (s, prop_id)), 'obs-' || k.clause_no) AS prop_id, count(prop_id) = 0 AS inserted FROM k LEFT JOIN p ON p.utt = k.utt AND p.clause_no = k.clause_no GROUP BY k.utt, k.clause_no")
def clarification_completion(spark: SparkSession, sf: str) -> DataFrame:
    clauses = utterances(spark, sf).select("utt", F.explode(F.sequence(F.lit(1), F.regexp_count("text", F.lit("[.!?]")) + 1)).alias("clause_no"), F.col("text").alias("clause"))
    return meaning.clarifications(clauses, props(spark, sf), "utt", " (is|est) ")


@query("pack_lookup", "WITH t AS (SELECT p_partkey, p_brand AS surface, lower(p_brand) AS normalized, p_type AS reading FROM part), k AS (SELECT CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'none' END AS key, p_type AS reading, p_partkey AS record_id FROM part WHERE p_brand < 'Brand#3'), h AS (SELECT DISTINCT t.p_partkey, 0 AS tier, record_id FROM t JOIN k ON k.key IN (t.surface, t.normalized) UNION SELECT t.p_partkey, 1, record_id FROM t JOIN k USING (reading)), b AS (SELECT * FROM (SELECT *, min(tier) OVER (PARTITION BY p_partkey) AS m FROM h) WHERE tier = m) SELECT p_partkey, tier, count(*) AS kept, any_value(total) AS total FROM (SELECT *, count(*) OVER (PARTITION BY p_partkey) AS total, row_number() OVER (PARTITION BY p_partkey ORDER BY record_id) AS n FROM b) WHERE n <= 32 GROUP BY ALL")
def pack_lookup(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import match

    part = table(spark, sf, "part")
    tokens = part.select("p_partkey", F.col("p_brand").alias("surface"), F.lower("p_brand").alias("normalized"), F.col("p_type").alias("reading"))
    packs = part.where("p_brand < 'Brand#3'").select(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("none").alias("key"), F.col("p_type").alias("reading"), F.col("p_partkey").alias("record_id"))
    return match.pack_lookup(tokens, packs, ["p_partkey"]).groupBy("p_partkey", "tier").agg(F.count("*").alias("kept"), F.max("total").alias("total"))


@query("references_resolved", f"WITH h AS (SELECT utt, text, CAST(s AS INTEGER) AS s, trim(surface) AS value FROM ({_duck_spans(_U, 'utt, text', 'text', ' (it|this)')})), r AS (SELECT *, list_filter(regexp_extract_all(substr(text, 1, s), '(?:the|of) ([a-z]+)', 1), lambda x: {_VALID})[-1] AS resolved FROM h) SELECT utt, s AS \"start\", value, resolved, CASE WHEN resolved IS NULL THEN 'INSUFFICIENT' ELSE 'RESOLVED' END AS status FROM r")
def references_resolved(spark: SparkSession, sf: str) -> DataFrame:
    return meaning.resolve_references(utterances(spark, sf), "utt", "text", " (it|this)", "(?:the|of) ([a-z]+)", _GENERIC, X.spans)
