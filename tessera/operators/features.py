"""Language features: entries with surfaces and interpretations, matched by mode, gated by context, scored, resolved only where one is best.

Entries: entry_id, feature_type, surface, match_mode, emit, suppresses array<string>, interpretations array<struct<id, label, required_all, required_any,
forbidden_any: array<string>, social: map<string, array<string>>, discourse: map<string, string>>>, fallback_status. Matches: key, entry_id, surface, start, end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_BREAK = r"[.!?\n]"


def context_window(text: Column, start: Column, end: Column) -> Column:
    """What stands around a span between the nearest sentence boundaries."""
    left = F.element_at(F.split(F.substring(text, F.lit(1), start), _BREAK, -1), -1)
    right = F.regexp_extract(F.substring(text, end + 1, F.length(text)), r"^[^.!?\n]*", 0)
    return F.concat(left, F.substring(text, start + 1, end - start), right)


def sentence_final(text: Column, end: Column) -> Column:
    return F.substring(text, end + 1, F.lit(1)).isin("", ".", "!", "?", "…", "。", "！", "？", "\n")


def exact_utterance(text: Column, start: Column, end: Column) -> Column:
    """Nothing but white space before and sentence marks after."""
    return (F.trim(F.substring(text, F.lit(1), start)) == "") & (F.regexp_replace(F.substring(text, end + 1, F.length(text)), r"[.!?…。！？ \t\r\n]+", "") == "")


def contains_all(context: Column, words: Column) -> Column:
    return F.forall(words, lambda w: F.contains(F.lower(context), F.lower(w)))


def contains_any(context: Column, words: Column) -> Column:
    return F.exists(words, lambda w: F.contains(F.lower(context), F.lower(w)))


def token_exact(matches: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Matches whose span is that of one token: a left semi join."""
    return matches.join(tokens.select(*keys, "start", "end"), [*keys, "start", "end"], "left_semi")


def run_spans(matches: DataFrame, tokens: DataFrame, keys: list[str], allowed: Column | None = None) -> DataFrame:
    """The distinct spans (keys, start, end) of matches that whole tokens without a gap make up, with `ok`: whether what is allowed holds for each of these.

    Spans meet tokens by the places in them, so that a text's matches never meet all its tokens. Tokens are many more than the planner takes them for: both sides are sorted, neither is broadcast.
    """
    t = tokens.select(*keys, F.col("start").alias("_at"), F.col("end").alias("_te"), (F.lit(True) if allowed is None else allowed).alias("_ok"))
    places = matches.select(*keys, "start", "end").distinct().where("start <= end").withColumn("_at", F.explode(F.sequence("start", "end")))
    inside = places.join(t.hint("merge"), [*keys, "_at"]).where("_te <= end")
    runs = inside.groupBy(*keys, "start", "end").agg(F.min("_at").alias("a"), F.max("_te").alias("b"), F.sum(F.col("_te") - F.col("_at")).alias("n"), F.bool_and("_ok").alias("ok"))
    return runs.where((F.col("a") == F.col("start")) & (F.col("b") == F.col("end")) & (F.col("n") == F.col("end") - F.col("start"))).select(*keys, "start", "end", "ok")


def token_runs(matches: DataFrame, tokens: DataFrame, keys: list[str], allowed: Column | None = None) -> DataFrame:
    """Matches that whole tokens without a gap make up (allowed: what must hold for each of them, on the tokens' columns): particle sequences and other runs."""
    return matches.join(run_spans(matches, tokens, keys, allowed).where("ok").hint("merge").drop("ok"), [*keys, "start", "end"], "left_semi")


def pos_family(tokens: DataFrame, candidates: DataFrame, families: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates (keys, record_id, pos) whose part of speech has a keyword of the token's family (families: family, keyword)."""
    hit = tokens.join(families, "family").join(candidates, keys).where(F.contains(F.lower("pos"), F.lower("keyword")))
    return hit.select(*candidates.columns).distinct()


def social_fits(required: Column, social: Column) -> Column:
    """Whether a social context (map of lists) meets what is required (map of lists): each key shares a value; groups are compared under two derived keys."""
    one = lambda k: F.try_element_at(social, F.lit(k))
    both = (F.size(one("speaker_group")) > 0) & (F.size(one("addressee_group")) > 0)
    same = F.coalesce(both & F.arrays_overlap(one("speaker_group"), one("addressee_group")), F.lit(False))
    differ = F.coalesce(both & ~F.arrays_overlap(one("speaker_group"), one("addressee_group")), F.lit(False))

    def holds(e: Column) -> Column:
        actual = F.when(e["key"] == "speaker_group_equals_addressee_group", F.array(same.cast("string"))).when(e["key"] == "speaker_group_differs_addressee_group", F.array(differ.cast("string"))).otherwise(F.try_element_at(social, e["key"]))
        return F.coalesce(F.arrays_overlap(actual, e["value"]), F.lit(False))

    return F.forall(F.map_entries(required), holds)


def interpretation_score(i: Column, window: Column, social: Column, discourse: Column) -> Column:
    """1, and 20, 10, 5 and 5 for each word that must stand, may stand, social and discourse condition; null where the gate is shut."""
    # Points that callers compare.
    has = lambda words: F.size(F.filter(words, lambda w: F.contains(window, w)))
    open_ = (has(i["required_all"]) == F.size(i["required_all"])) & ((F.size(i["required_any"]) == 0) | (has(i["required_any"]) > 0)) & (has(i["forbidden_any"]) == 0)
    open_ = open_ & social_fits(i["social"], social) & F.forall(F.map_entries(i["discourse"]), lambda e: F.coalesce(F.try_element_at(discourse, e["key"]) == e["value"], F.lit(False)))
    return F.when(open_, 1 + 20 * has(i["required_all"]) + 10 * has(i["required_any"]) + 5 * F.size(i["social"]) + 5 * F.size(i["discourse"]))


def resolve(matches: DataFrame, entries: DataFrame, text: str, social: Column, discourse: Column) -> DataFrame:
    """Matches (with their text) joined to their entries: selected (id), label, status. One best interpretation resolves, ties are ambiguous, none falls back."""
    e = entries.select("entry_id", "feature_type", "interpretations", "fallback_status").dropDuplicates(["entry_id"])
    held = matches.join(e, "entry_id").withColumn("_w", context_window(F.col(text), F.col("start"), F.col("end")))
    scored = F.filter(F.transform("interpretations", lambda i: F.struct(interpretation_score(i, F.col("_w"), social, discourse).alias("score"), i["id"].alias("id"), i["label"].alias("label"))), lambda x: x["score"].isNotNull())
    held = held.withColumn("_s", scored).withColumn("_top", F.filter("_s", lambda x: x["score"] == F.array_max(F.transform("_s", lambda y: y["score"]))))
    alone = F.size("_top") == 1
    status = F.when(alone, "RESOLVED").when(F.size("_top") > 1, "AMBIGUOUS").otherwise(F.coalesce("fallback_status", F.lit("AMBIGUOUS")))
    return held.withColumn("selected", F.when(alone, F.col("_top")[0]["id"])).withColumn("label", F.when(alone, F.col("_top")[0]["label"])).withColumn("status", status).drop("_w", "_s", "_top", "interpretations", "fallback_status")


def match_modes(matches: DataFrame, tokens: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Matches that their mode allows: token_exact, contiguous, sentence_final, exact_utterance, or substring (always). Of sentence-final ones that end together the longest stays; each (entry, span) once."""
    of = lambda mode: matches.where(F.col("match_mode") == mode)
    final = of("sentence_final").where(sentence_final(F.col(text), F.col("end")))
    longest = F.max(F.col("end") - F.col("start")).over(W.partitionBy(*keys, "end"))
    final = final.withColumn("_l", longest).where(F.col("_l") == F.col("end") - F.col("start")).drop("_l")
    parts = [of("substring"), token_exact(of("token_exact"), tokens, keys), token_runs(of("contiguous"), tokens, keys), final, of("exact_utterance").where(exact_utterance(F.col(text), F.col("start"), F.col("end")))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates([*keys, "entry_id", "start", "end"])


#: Strength of speech acts; a feature never makes one weaker.
ACTS = ["statement", "question", "request", "command"]


def apply_features(props: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Propositions with what resolved features of their clause say: labels are joined, and the speech act goes up, never down. features: key, clause_no, label, speech_act, status."""
    rank = lambda c: F.array_position(F.array(*[F.lit(a) for a in ACTS]), F.col(c))
    told = features.where("status = 'RESOLVED'").groupBy(key, "clause_no").agg(F.array_sort(F.collect_set("label")).alias("_labels"), F.max_by("speech_act", rank("speech_act")).alias("_act"))
    both = props.join(told, [key, "clause_no"], "left")
    act = F.when(F.col("_act").isNotNull() & (rank("_act") > rank("speech_act")), F.col("_act")).otherwise(F.col("speech_act"))
    return both.withColumn("speech_act", act).withColumn("labels", F.array_union("labels", F.coalesce("_labels", F.array().cast("array<string>")))).drop("_labels", "_act")


def post_pass(statuses: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """key, status, blocked of documents after their features: FAILED ones with a resolved feature are lifted to PARTIAL, an ambiguous action or social feature blocks."""
    f = features.groupBy(key).agg(F.bool_or(F.col("status") == "RESOLVED").alias("_some"), F.bool_or((F.col("status") == "AMBIGUOUS") & F.col("feature_type").isin("action", "social")).alias("_open"))
    both = statuses.join(f, key, "left")
    lifted = F.when((F.col("status") == "FAILED") & F.coalesce("_some", F.lit(False)), "PARTIAL").otherwise(F.col("status"))
    return both.select(key, lifted.alias("status"), F.coalesce("_open", F.lit(False)).alias("blocked"))


def entry_problems(entries: DataFrame, approvals: DataFrame) -> DataFrame:
    """entry_id, problem: repeated, not approved, or approved with another digest. approvals: entry_id, status, digest; entries: entry_id, digest."""
    many = F.count("*").over(W.partitionBy("entry_id"))
    a = approvals.select("entry_id", F.col("status").alias("_status"), F.col("digest").alias("_digest"))
    found = F.array_compact(F.array(F.when(F.col("_many") > 1, "repeated"), F.when(F.coalesce("_status", F.lit("")) != "approved", "approval"), F.when((F.col("_status") == "approved") & (F.col("_digest") != F.col("digest")), "digest")))
    return entries.withColumn("_many", many).join(a, "entry_id", "left").select("entry_id", F.explode(found).alias("problem")).distinct()


def compile_entries(entries: DataFrame) -> DataFrame:
    """surface, targets (sorted distinct (entry_id, match_mode)), digest of them: what the literal index is built from."""
    target = F.array_sort(F.collect_set(F.struct("entry_id", "match_mode")))
    flat = F.array_join(F.transform("targets", lambda t: F.concat_ws(":", t["entry_id"], t["match_mode"])), ",")
    return entries.groupBy("surface").agg(target.alias("targets")).withColumn("digest", F.sha2(F.concat("surface", F.lit("|"), flat), 256))
