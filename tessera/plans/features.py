"""Queries of literals, covers, normalisation with spans, and language features, over all utterances of the conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normal
from ..functions import text as X
from ..operators import features, literals, segment
from . import dims
from .matches import _matches_sql
from .meanings import _U, utterances
from .registry import query, table
from .texts import _duck_spans

_LITERALS = ["the", "he", "her", "there", "in", "ing", "thing", "on", "ion", "tion", "ation", "de", "der", "und", "é", "ère", "tt"]
_LIT_SQL = dims.duck([(x,) for x in _LITERALS], ["literal"])


def _hits_sql(lits: str) -> str:
    return f"(SELECT utt, text, literal, CAST(p - 1 AS INTEGER) AS s, CAST(p - 1 + length(literal) AS INTEGER) AS e FROM (SELECT utt, text, unnest(range(1, length(text) + 1)) AS p FROM {_U}), {lits} WHERE substr(text, p, length(literal)) = literal)"


@query("literal_overlaps", f'SELECT utt, literal, s AS "start", e AS "end" FROM {_hits_sql(_LIT_SQL)}')
def literal_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return literals.literal_hits(utterances(spark, sf), ["utt"], "text", literals.Automaton(_LITERALS))


@query("literal_gate", f"SELECT utt, contains(text, 'license') OR contains(text, 'zu') AS passes FROM {_U}".replace("'license'", "'lice'"))
def literal_gate(spark: SparkSession, sf: str) -> DataFrame:
    return utterances(spark, sf).select("utt", literals.gate(F.col("text"), ["license", "zu", "zung", "licensed"]).alias("passes"))


@query("automaton_restore", f"SELECT literal, count(*) AS n, count(DISTINCT utt) AS texts FROM {_hits_sql(_LIT_SQL)} GROUP BY literal")
def automaton_restore(spark: SparkSession, sf: str) -> DataFrame:
    """Stored, restored, checked, and used again; 20 times as many decoys change nothing."""
    decoys = [f"qq{i}x" for i in range(20 * len(_LITERALS))]
    again = literals.Automaton.restore(literals.Automaton([*_LITERALS, *decoys]).store())
    return literals.literal_hits(utterances(spark, sf), ["utt"], "text", again).groupBy("literal").agg(F.count("*").alias("n"), F.count_distinct("utt").alias("texts"))


#: pattern, and the cover that can be proven of it (empty: none).
_COVERS = [
    ("(?:^| )[Ll]icensed under", "Licensed under|licensed under"), ("abc|abd", "abc|abd"), ("x?yz+", "z"), ("[a-z]+ing", "ing"), ("(red|green) apple", "green apple|red apple"),
    ("colou?r", "colour|color"), ("(?i)word", ""), ("a*", ""), ("(foo|[a-z])bar", "bar"), ("[0-9]{4}-(jan|feb)", "-feb|-jan"), ("(", ""), ("over(?:.*)there", "there"), ("(?:ab){2}c", "ab"), ("one.two.three", "three"),
]


@query("trigger_covers", f"SELECT pattern, cover FROM {dims.duck(_COVERS, ['pattern', 'cover'])}")
def trigger_covers(spark: SparkSession, sf: str) -> DataFrame:
    return dims.values(spark, [(p, "|".join(literals.triggers(p))) for p, _ in _COVERS], "pattern string, cover string")


@query("rule_match_triggered", f"SELECT rule_id, count(*) AS n FROM ({_matches_sql(False)}) GROUP BY rule_id")
def rule_match_triggered(spark: SparkSession, sf: str) -> DataFrame:
    """Rules probed by covers that are proven from their patterns: the same matches as without a probe."""
    clauses = segment.clauses(table(spark, sf, "documents"))
    # each rule has its own literals of which one must stand in the clause; a rule without any is always tried
    by_cover = {r[0]: (literals.triggers(r[3]), r[3]) for r in dims.RULES if r[5]}

    def hits(cover: tuple[str, ...], pattern: str):
        may = F.lit(True)
        if cover:
            may = F.contains("clause", F.lit(cover[0]))
            for c in cover[1:]:
                may = may | F.contains("clause", F.lit(c))
        return F.when(may, F.regexp_count("clause", F.lit(pattern))).otherwise(0)

    each = F.array(*[F.struct(F.lit(i).alias("rule_id"), hits(c, p).alias("n")) for i, (c, p) in by_cover.items()])
    found = clauses.select(F.explode(F.filter(each, lambda x: x["n"] > 0)).alias("r"))
    return found.groupBy("r.rule_id").agg(F.sum("r.n").alias("n"))


@query("nfkc_projection", f"SELECT utt, CAST(s + 6 AS INTEGER) AS \"start\", CAST(e + 6 AS INTEGER) AS \"end\", surface FROM ({_duck_spans(_U, 'utt', 'text', '[a-z]+ing')})")
def nfkc_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Each text gets six characters in front that become more or fewer when normalised; matches on the normalised text point to the right source characters."""
    noisy = utterances(spark, sf).select("utt", F.concat(F.lit("ﬁ①ｶﾞ㎏ "), "text").alias("text"))
    found = normal.with_map(noisy, ["utt"]).select("utt", "text", "starts", "ends", F.explode(X.spans(F.col("normal"), "[a-z]+ing")).alias("m"))
    at = found.withColumn("p", normal.project(F.col("m.start"), F.col("m.end"), F.col("starts"), F.col("ends")))
    return at.select("utt", "p.start", "p.end", F.substring(F.col("text"), F.col("p.start") + 1, F.col("p.end") - F.col("p.start")).alias("surface"))


@query("nfkc_join_keys", "SELECT c_custkey, lower(replace(c_name, ' ', '')) || 'straße1' AS key, c_name || ' fi 1' AS shown FROM customer".replace("straße1", "strasse1"))
def nfkc_join_keys(spark: SparkSession, sf: str) -> DataFrame:
    messy = table(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(" Stra ße①")).alias("a"), F.concat(F.lit(" "), "c_name", F.lit("  ﬁ ① ")).alias("b"))
    return messy.select("c_custkey", normal.join_key("a").alias("key"), normal.lexicon_text("b").alias("shown"))


_H = f"h AS (SELECT utt, text, literal, s, e FROM {_hits_sql(dims.duck([(x,) for x in ('the', 'tion', 'on', 'ing', 'then')], ['literal']))})"
_TOK = f"k AS (SELECT utt, s, e FROM ({_duck_spans(_U, 'utt', 'text', '[A-Za-z]+')}))"


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    return literals.literal_hits(utterances(spark, sf), ["utt"], "text", literals.Automaton(["the", "tion", "on", "ing", "then"]))


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return _spans(spark, sf).join(utterances(spark, sf).select("utt", "text"), "utt")


def _tokens(spark: SparkSession, sf: str, pattern: str = "[A-Za-z]+") -> DataFrame:
    return utterances(spark, sf).select("utt", F.explode(X.spans(F.col("text"), pattern)).alias("t")).select("utt", "t.start", "t.end", "t.surface")


@query("token_exact", f'WITH {_H}, {_TOK} SELECT h.utt, literal, h.s AS "start" FROM h JOIN k ON k.utt = h.utt AND k.s = h.s AND k.e = h.e')
def token_exact(spark: SparkSession, sf: str) -> DataFrame:
    return features.token_exact(_hits(spark, sf), _tokens(spark, sf), ["utt"]).select("utt", "literal", "start")


_PAIRS = f"k AS (SELECT utt, s, e, surface FROM ({_duck_spans(_U, 'utt', 'text', '[a-z]{2}')}))"


@query("token_runs", f'WITH {_H}, {_PAIRS} SELECT h.utt, literal, h.s AS "start", bool_and(surface <> \'th\') AS unlike FROM h JOIN k ON k.utt = h.utt AND k.s >= h.s AND k.e <= h.e GROUP BY h.utt, literal, h.s, h.e HAVING min(k.s) = h.s AND max(k.e) = h.e AND sum(k.e - k.s) = h.e - h.s')
def token_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Matches that whole two-letter tokens make up, and whether each of these is allowed."""
    hits, tokens = _spans(spark, sf), _tokens(spark, sf, "[a-z]{2}")
    runs = features.run_spans(hits, tokens, ["utt"], F.col("surface") != "th")
    return hits.join(runs.hint("merge"), ["utt", "start", "end"]).select("utt", "literal", "start", F.coalesce("ok", F.lit(False)).alias("unlike"))


_WINDOW = "regexp_extract(substr(text, 1, s), '(?s)([^.!?\\n]*)$', 1) || substr(text, s + 1, e - s) || regexp_extract(substr(text, e + 1), '^[^.!?\\n]*')"


@query("context_windows", f'WITH {_H} SELECT utt, literal, s AS "start", sha256({_WINDOW}) AS digest FROM h')
def context_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf).select("utt", "literal", "start", F.sha2(features.context_window(F.col("text"), F.col("start"), F.col("end")), 256).alias("digest"))


_FINAL = "substr(text, e + 1, 1) IN ('', '.', '!', '?', '…', chr(10))"
_ENTRIES_SQL = dims.duck([("E1", "the", "token_exact"), ("E2", "ing", "substring"), ("E3", "then", "contiguous"), ("E4", "tion", "sentence_final"), ("E5", "on", "sentence_final"), ("E6", "tion", "exact_utterance")], ["entry_id", "surface", "match_mode"])
_MODES = f"""{_H}, {_TOK}, x AS (SELECT h.*, entry_id, match_mode FROM h JOIN {_ENTRIES_SQL} t ON t.surface = h.literal),
  f AS (SELECT *, max(e - s) OVER (PARTITION BY utt, e) AS longest FROM x WHERE match_mode = 'sentence_final' AND {_FINAL}),
  y AS (SELECT utt, text, entry_id, s, e FROM x WHERE match_mode = 'substring' UNION SELECT x.utt, text, entry_id, x.s, x.e FROM x JOIN k ON k.utt = x.utt AND k.s = x.s AND k.e = x.e WHERE match_mode IN ('token_exact', 'contiguous')
    UNION SELECT utt, text, entry_id, s, e FROM f WHERE e - s = longest UNION SELECT utt, text, entry_id, s, e FROM x WHERE match_mode = 'exact_utterance' AND trim(substr(text, 1, s)) = '' AND regexp_replace(substr(text, e + 1), '[.!?… \\t\\r\\n]+', '', 'g') = '')"""
_I = "struct<id:string,label:string,required_all:array<string>,required_any:array<string>,forbidden_any:array<string>,social:map<string,array<string>>,discourse:map<string,string>>"
#: entry, type, surface, mode, fallback, interpretations.
_ENTRIES = [
    ("E1", "modality", "the", "token_exact", "INSUFFICIENT", [("I1", "first", ["of"], ["in", "to"], [], {"role": ["user"]}, {}), ("I2", "second", [], ["and"], ["zz"], {}, {})]),
    ("E2", "action", "ing", "substring", "AMBIGUOUS", [("I3", "third", ["th"], [], ["of"], {}, {}), ("I4", "fourth", ["er"], [], ["of"], {}, {})]),
    ("E3", "social", "then", "contiguous", None, [("I5", "fifth", [], [], [], {"speaker_group_differs_addressee_group": ["true"]}, {"topic": "x"})]),
    ("E4", "modality", "tion", "sentence_final", "INSUFFICIENT", [("I6", "sixth", [], [], [], {}, {})]),
    ("E5", "modality", "on", "sentence_final", "INSUFFICIENT", [("I7", "seventh", ["never here"], [], [], {}, {})]),
    ("E6", "modality", "tion", "exact_utterance", "INSUFFICIENT", [("I8", "eighth", [], [], [], {}, {})]),
]


def _entries(spark: SparkSession) -> DataFrame:
    return dims.values(spark, _ENTRIES, f"entry_id string, feature_type string, surface string, match_mode string, fallback_status string, interpretations array<{_I}>")


def _modal(spark: SparkSession, sf: str) -> DataFrame:
    held = _hits(spark, sf).join(_entries(spark).select("entry_id", F.col("surface").alias("literal"), "match_mode"), "literal")
    return features.match_modes(held, _tokens(spark, sf), ["utt"], "text")


@query("feature_modes", f'WITH {_MODES} SELECT utt, entry_id, s AS "start", e AS "end" FROM y')
def feature_modes(spark: SparkSession, sf: str) -> DataFrame:
    return _modal(spark, sf).select("utt", "entry_id", "start", "end")


_SCORES = f"""z AS (SELECT y.utt, entry_id, s, e, role, {_WINDOW.replace('text', 'y.text')} AS w FROM y JOIN {_U} u ON u.utt = y.utt),
  q AS (SELECT utt, entry_id, s, e, 'I1' AS id, CASE WHEN contains(w, 'of') AND (contains(w, 'in') OR contains(w, 'to')) AND role = 'user' THEN 26 + CASE WHEN contains(w, 'in') THEN 10 ELSE 0 END + CASE WHEN contains(w, 'to') THEN 10 ELSE 0 END END AS score FROM z WHERE entry_id = 'E1'
    UNION ALL SELECT utt, entry_id, s, e, 'I2', CASE WHEN contains(w, 'and') AND NOT contains(w, 'zz') THEN 11 END FROM z WHERE entry_id = 'E1'
    UNION ALL SELECT utt, entry_id, s, e, 'I3', CASE WHEN contains(w, 'th') AND NOT contains(w, 'of') THEN 21 END FROM z WHERE entry_id = 'E2' UNION ALL SELECT utt, entry_id, s, e, 'I4', CASE WHEN contains(w, 'er') AND NOT contains(w, 'of') THEN 21 END FROM z WHERE entry_id = 'E2'
    UNION ALL SELECT utt, entry_id, s, e, 'I5', CASE WHEN role <> 'assistant' THEN 11 END FROM z WHERE entry_id = 'E3' UNION ALL SELECT utt, entry_id, s, e, 'I6', 1 FROM z WHERE entry_id = 'E4' UNION ALL SELECT utt, entry_id, s, e, 'I7', NULL FROM z WHERE entry_id = 'E5' UNION ALL SELECT utt, entry_id, s, e, 'I8', 1 FROM z WHERE entry_id = 'E6'),
  r AS (SELECT utt, entry_id, s, e, count(score) FILTER (score = top) AS best, max(id) FILTER (score = top) AS id FROM (SELECT *, max(score) OVER (PARTITION BY utt, entry_id, s, e) AS top FROM q) GROUP BY utt, entry_id, s, e),
  v AS (SELECT utt, entry_id, s, e, CASE WHEN best = 1 THEN id END AS selected, CASE WHEN best = 1 THEN 'RESOLVED' WHEN best > 1 THEN 'AMBIGUOUS' WHEN entry_id IN ('E2', 'E3') THEN 'AMBIGUOUS' ELSE 'INSUFFICIENT' END AS status FROM r)"""


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    held = _modal(spark, sf).drop("match_mode").join(utterances(spark, sf).select("utt", "role"), "utt")
    social = F.create_map(F.lit("role"), F.array("role"), F.lit("speaker_group"), F.array("role"), F.lit("addressee_group"), F.array(F.lit("assistant")))
    return features.resolve(held, _entries(spark), "text", social, F.create_map(F.lit("topic"), F.lit("x")))


@query("feature_status", f'WITH {_MODES}, {_SCORES} SELECT utt, entry_id, s AS "start", e AS "end", selected, status FROM v')
def feature_status(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf).select("utt", "entry_id", "start", "end", "selected", "status")


@query("feature_post_pass", f"WITH {_MODES}, {_SCORES}, b AS (SELECT utt, CASE WHEN utt % 2 = 0 THEN 'FAILED' ELSE 'COMPLETE' END AS status FROM {_U}), g AS (SELECT utt, bool_or(status = 'RESOLVED') AS lifted, bool_or(status = 'AMBIGUOUS' AND entry_id IN ('E2', 'E3')) AS held FROM v GROUP BY utt) SELECT utt, CASE WHEN status = 'FAILED' AND coalesce(lifted, FALSE) THEN 'PARTIAL' ELSE status END AS status, coalesce(held, FALSE) AS blocked FROM b LEFT JOIN g USING (utt)")
def feature_post_pass(spark: SparkSession, sf: str) -> DataFrame:
    statuses = utterances(spark, sf).select("utt", F.when(F.col("utt") % 2 == 0, "FAILED").otherwise("COMPLETE").alias("status"))
    return features.post_pass(statuses, _resolved(spark, sf), "utt")


@query("feature_apply", f"WITH {_MODES}, {_SCORES}, g AS (SELECT utt, string_agg(DISTINCT selected, '|' ORDER BY selected) AS labels, bool_or(entry_id = 'E1') AS strong FROM v WHERE status = 'RESOLVED' GROUP BY utt) SELECT utt, CASE WHEN utt % 3 = 0 THEN 'command' WHEN strong THEN 'request' ELSE 'question' END AS speech_act, coalesce('own|' || labels, 'own') AS labels FROM (SELECT utt FROM {_U}) LEFT JOIN g USING (utt)")
def feature_apply(spark: SparkSession, sf: str) -> DataFrame:
    props = utterances(spark, sf).select("utt", F.lit(1).alias("clause_no"), F.when(F.col("utt") % 3 == 0, "command").otherwise("question").alias("speech_act"), F.array(F.lit("own")).alias("labels"))
    told = _resolved(spark, sf).select("utt", F.lit(1).alias("clause_no"), F.col("selected").alias("label"), F.when(F.col("entry_id") == "E1", "request").otherwise("statement").alias("speech_act"), "status")
    return features.apply_features(props, told, "utt").select("utt", "speech_act", F.array_join("labels", "|").alias("labels"))


@query("feature_sources", "SELECT 'P' || p_partkey AS entry_id, CASE WHEN p_partkey % 5 = 0 THEN 'approval' ELSE 'digest' END AS problem FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0")
def feature_sources(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_partkey")
    entries = table(spark, sf, "part").select(F.concat(F.lit("P"), n.cast("string")).alias("entry_id"), F.sha2("p_name", 256).alias("digest"), n.alias("n"))
    approvals = entries.select("entry_id", F.when(F.col("n") % 5 == 0, "pending").otherwise("approved").alias("status"), F.when(F.col("n") % 7 == 0, "other").otherwise(F.col("digest")).alias("digest"))
    return features.entry_problems(entries.drop("n"), approvals)


@query("feature_compile", "SELECT p_brand AS surface, CAST(count(*) AS INTEGER) AS targets, sha256(p_brand || '|' || string_agg(t, ',' ORDER BY t)) AS digest FROM (SELECT DISTINCT p_brand, p_name || ':' || CASE WHEN p_size % 2 = 0 THEN 'substring' ELSE 'token_exact' END AS t FROM part) GROUP BY p_brand")
def feature_compile(spark: SparkSession, sf: str) -> DataFrame:
    entries = table(spark, sf, "part").select(F.col("p_brand").alias("surface"), F.col("p_name").alias("entry_id"), F.when(F.col("p_size") % 2 == 0, "substring").otherwise("token_exact").alias("match_mode"))
    return features.compile_entries(entries).select("surface", F.size("targets").alias("targets"), "digest")


@query("social_fit", "SELECT c_custkey, c_nationkey % 3 = 0 AND c_mktsegment <> 'BUILDING' AS fits FROM customer")
def social_fit(spark: SparkSession, sf: str) -> DataFrame:
    social = F.create_map(F.lit("rank"), F.array((F.col("c_nationkey") % 3).cast("string")), F.lit("speaker_group"), F.array("c_mktsegment"), F.lit("addressee_group"), F.array(F.lit("BUILDING")))
    required = F.create_map(F.lit("rank"), F.array(F.lit("0"), F.lit("9")), F.lit("speaker_group_differs_addressee_group"), F.array(F.lit("true")))
    return table(spark, sf, "customer").select("c_custkey", features.social_fits(required, social).alias("fits"))


@query("context_all_any", f"SELECT utt, contains(lower(text), 'the') AND contains(lower(text), 'of') AS has_all, contains(lower(text), 'zu') OR contains(lower(text), 'est') AS has_any FROM {_U}")
def context_all_any(spark: SparkSession, sf: str) -> DataFrame:
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    return utterances(spark, sf).select("utt", features.contains_all(F.col("text"), words("The", "OF")).alias("has_all"), features.contains_any(F.col("text"), words("ZU", "est")).alias("has_any"))


@query("pos_family", "SELECT p_partkey, p_type AS pos FROM part WHERE (p_size % 2 = 0 AND (p_type LIKE '%BRASS%' OR p_type LIKE '%TIN%')) OR (p_size % 2 = 1 AND p_type LIKE '%SMALL%')")
def pos_family(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    tokens = part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, "metal").otherwise("size").alias("family"))
    families = dims.values(spark, [("metal", "brass"), ("metal", "tin"), ("size", "small")], "family string, keyword string")
    return features.pos_family(tokens, part.select("p_partkey", F.col("p_type").alias("pos")), families, ["p_partkey"])
