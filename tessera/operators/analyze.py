"""From utterances to verdicts, set at a time: clauses, rules, phrases, references, propositions, conflicts, task order, guard, status.

utterances: doc_id, text, external (whether an allowed action would leave the system), known (array of names that references may mean).
Dictionaries are arguments, so that a language is a matter of data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..lineage import stage
from . import graph, match, rank, segment

#: What an intent's proposition does.
KINDS = {"action": "changes", "modify": "changes", "remove": "changes", "prohibition": "prohibits", "preserve": "preserves", "condition": "conditions", "scope": "limits", "reference": "refers"}


@dataclass
class Analysis:
    """Tables of an analysis; all have doc_id."""

    clauses: DataFrame
    propositions: DataFrame
    phrases: DataFrame
    references: DataFrame
    conflicts: DataFrame
    tasks: DataFrame
    verdicts: DataFrame


def analyze(utterances: DataFrame, rules: DataFrame, phrases: DataFrame, max_chars: int | None = 20_000) -> Analysis:
    """Texts over max_chars are not analysed: their verdict has the reason TIMEOUT, as any size limit that is hit (None: no limit). Null and empty texts have no propositions and fail.

    Without external, all is allowed and no reason given; status is FAILED without propositions, phrases or references, PARTIAL where something is
    open or blocked, else COMPLETE.
    """
    docs = utterances.withColumn("timed_out", F.lit(False) if max_chars is None else F.coalesce(F.length("text") > max_chars, F.lit(False)))
    small = docs.where("not timed_out").select("doc_id", "text", "known")
    clauses = stage(segment.clauses(small), "clauses")
    found = match.captures(match.dedup_intents(match.match_rules(clauses, rules)), rules)
    mood = rank.modality(F.col("clause"))
    typed = found.join(clauses.select("doc_id", "clause_no", "clause"), ["doc_id", "clause_no"]).withColumn("kind", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("intent")), F.lit("observes")))
    typed = typed.select("doc_id", "clause_no", "start", "end", "intent", "kind", F.col("value").alias("target"), F.concat_ws("@", "rule_id", "start").alias("prop_id"), *[c.alias(n) for n, c in mood.items()])
    quoted = match.inside(typed.select("doc_id", "prop_id", "start", "end"), segment.quotes(small), ["doc_id"]).select("doc_id", "prop_id", F.lit(True).alias("quoted"))

    # references: the last other target before them, or a known name
    targets = typed.where("kind = 'changes'").select("doc_id", F.col("start").alias("seen"), F.col("target").alias("candidate"))
    anchors = typed.where("kind = 'refers'").select("doc_id", "prop_id", "start")
    near = anchors.join(targets, "doc_id").where("seen < start").groupBy("doc_id", "prop_id").agg(F.max_by("candidate", F.struct("seen", "candidate")).alias("antecedent"), F.count_distinct("candidate").alias("candidates"))
    named = small.select("doc_id", F.try_element_at(F.coalesce("known", F.array().cast("array<string>")), F.lit(1)).alias("first_known"))
    references = anchors.join(near, ["doc_id", "prop_id"], "left").join(named, "doc_id", "left").select("doc_id", "prop_id", F.coalesce("antecedent", "first_known").alias("resolved"), F.coalesce("candidates", F.lit(0)).alias("candidates"))
    references = references.withColumn("status", F.when(F.col("resolved").isNull(), "INSUFFICIENT").when(F.col("candidates") > 1, "AMBIGUOUS").otherwise("RESOLVED"))

    props = typed.join(quoted, ["doc_id", "prop_id"], "left").withColumn("quoted", F.coalesce("quoted", F.lit(False)))
    props = props.join(references.select("doc_id", "prop_id", "status"), ["doc_id", "prop_id"], "left").withColumn("status", F.coalesce("status", F.lit("RESOLVED")))
    polite = F.col("speech_act") == "request"
    props = props.withColumn("polite", polite).withColumn("executable", (F.col("kind") == "changes") & ~F.col("quoted") & ((F.col("mood") != "interrogative") | polite) & (F.col("polarity") == "positive"))
    role = F.when(F.col("kind") == "refers", "reference").when(F.col("kind") == "limits", "scope").otherwise("action")
    props = stage(props.withColumn("role", role).withColumn("sense_status", F.lit("RESOLVED")), "propositions")

    # within a clause everything is connected; actions follow each other in order of the text
    w = W.partitionBy("doc_id", "clause_no").orderBy("start", "prop_id")
    edges = props.select("doc_id", F.col("prop_id").alias("src"), F.lead("prop_id").over(w).alias("dst")).where("dst is not null")
    order = W.partitionBy("doc_id").orderBy("start", "prop_id")
    actions = props.where("executable")
    tasks = actions.select("doc_id", "prop_id", "target", F.row_number().over(order).alias("task_no"), F.lag("prop_id").over(order).alias("after"))
    conflicts = graph.contradictions(props.where("kind in ('changes', 'prohibits', 'preserves') and (kind <> 'changes' or executable)"), "doc_id")
    none = props.limit(0).select("doc_id")
    hits = match.phrase_hits(clauses, phrases)
    guard = graph.guard(docs.select("doc_id", "external", "timed_out"), props, edges, conflicts, none, "doc_id")
    state = props.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(F.col("status") != "RESOLVED").alias("open"))
    seen = hits.groupBy("doc_id").agg(F.count("*").alias("p"), F.bool_or(F.col("status") != "RESOLVED").alias("p_open"))
    verdicts = guard.join(state, "doc_id", "left").join(seen, "doc_id", "left")
    status = F.when(F.col("n").isNull() & F.col("p").isNull(), "FAILED").when(F.coalesce("open", F.lit(False)) | F.coalesce("p_open", F.lit(False)) | ~F.col("allowed"), "PARTIAL").otherwise("COMPLETE")
    return Analysis(clauses, props, hits, references, conflicts, tasks, verdicts.select("doc_id", status.alias("status"), "allowed", "reasons"))
