"""Task and meaning graphs as (vertices, edges): order, cycles, closure, contradictions, guard, roll-ups.

Graphs are local to a key (a document, a conversation). Iterations are joins over all graphs at once; each round's
frontier is written out, so that plans do not grow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..lineage import stage


def levels(vertices: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """key, node, level: the longest way from a source, by peeling sources off round by round. Nodes on or behind a cycle have a null level: the cycle report.

    vertices: key, node; edges: key, src, dst (src before dst).
    """
    left, open_, done, level = stage(vertices.distinct(), "left"), stage(edges.where("src <> dst").distinct(), "edges"), None, 0
    stuck = edges.where("src = dst").select(key, F.col("src").alias("node"))
    left_out = vertices.join(stuck, [key, "node"], "left_semi")
    left = stage(left.join(stuck, [key, "node"], "left_anti"), "left")
    while True:
        sources = stage(left.join(open_.select(key, F.col("dst").alias("node")).unionByName(left_out.join(open_.select(key, F.col("src").alias("node"), "dst"), [key, "node"]).select(key, F.col("dst").alias("node"))), [key, "node"], "left_anti").withColumn("level", F.lit(level)), "sources")
        if sources.isEmpty():
            break
        done = sources if done is None else done.unionByName(sources)
        left = stage(left.join(sources.select(key, "node"), [key, "node"], "left_anti"), "left")
        open_ = stage(open_.join(sources.select(key, F.col("node").alias("src")), [key, "src"], "left_anti"), "edges")
        level += 1
    rest = left.unionByName(left_out.select(key, "node")).distinct().withColumn("level", F.lit(None).cast("int"))
    return rest if done is None else done.unionByName(rest)


def ordered(vertices: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """key, node, position: by level, then node; a graph with a cycle keeps the order of its nodes and says so (cyclic)."""
    found = levels(vertices, edges, key)
    w = W.partitionBy(key)
    flagged = found.withColumn("cyclic", F.bool_or(F.col("level").isNull()).over(w))
    return flagged.withColumn("position", F.row_number().over(w.orderBy(F.when(F.col("cyclic"), 0).otherwise(F.col("level")), "node"))).select(key, "node", "position", "cyclic")


def closure(seeds: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """key, node: what is reached from the seeds along edges taken either way. Cycles end, as a node enters the frontier once."""
    both = stage(edges.select(key, "src", "dst").unionByName(edges.select(key, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    reached = frontier = stage(seeds.select(key, "node").distinct(), "frontier")
    while True:
        near = frontier.select(key, F.col("node").alias("src")).join(both, [key, "src"]).select(key, F.col("dst").alias("node")).distinct()
        frontier = stage(near.join(reached, [key, "node"], "left_anti"), "frontier")
        if frontier.isEmpty():
            return reached
        reached = stage(reached.unionByName(frontier), "reached")


def contradictions(propositions: DataFrame, key: str) -> DataFrame:
    """Constraints against actions of the same key with related targets (containment of compact forms, two characters at least), once for each pair.

    propositions: key, prop_id, kind (prohibits, preserves or changes), target.
    """
    side = lambda s, kinds: propositions.where(F.col("kind").isin(*kinds)).select(key, F.col("prop_id").alias(f"{s}_id"), F.col("kind").alias(f"{s}_kind"), F.regexp_replace(F.lower("target"), r"[^\p{L}\p{N}]+", "").alias(f"{s}_key"))
    a, b = side("constraint", ["prohibits", "preserves"]), side("action", ["changes"])
    near = (F.least(F.length("constraint_key"), F.length("action_key")) >= 2) & (F.contains("constraint_key", F.col("action_key")) | F.contains("action_key", F.col("constraint_key")))
    return a.join(b, key).where(near).select(key, "constraint_id", "constraint_kind", "action_id").distinct()


# Names of the reasons that callers rely on, in the order of the checks.
REASONS = ["CONTRADICTORY", "TIMEOUT", "UNSUPPORTED", "NON_EXECUTABLE_SPEECH_ACT", "NO_EXECUTABLE_ACTION", "QUOTED_ACTION", "INTERROGATIVE_ACTION", "AMBIGUOUS_ACTION_SENSE", "UNRESOLVED_SCOPE", "AMBIGUOUS_OR_INSUFFICIENT_REFERENCE", "CYCLIC_ACTION_GRAPH"]


def guard(docs: DataFrame, propositions: DataFrame, edges: DataFrame, conflicts: DataFrame, cyclic: DataFrame, key: str) -> DataFrame:
    """key, allowed, reasons: whether a document's actions may run, and what blocks them. Outside external mode all is allowed.

    docs: key, external, timed_out (and unsupported: something that no rule covers was said, which blocks where no action is executable); propositions: key, prop_id, kind, executable, quoted, mood, polite, sense_status, status, role;
    conflicts: key, constraint_id, action_id; cyclic: key. Only what is connected to an executable action can block, but for a
    document without any action, for a timeout, and for a conflict that names nothing.
    """
    action = propositions.where("kind = 'changes'")
    seeds = action.where("executable").select(key, F.col("prop_id").alias("node"))
    near = closure(seeds, edges, key).withColumnRenamed("node", "prop_id")
    relevant = propositions.join(near, [key, "prop_id"], "left_semi")
    told = lambda df, reason: df.select(key, F.lit(reason).alias("reason"))
    found = [
        told(conflicts.where("constraint_id is null and action_id is null"), "CONTRADICTORY"),
        told(conflicts.join(near, (conflicts[key] == near[key]) & near["prop_id"].isin(conflicts["constraint_id"], conflicts["action_id"]), "left_semi"), "CONTRADICTORY"),
        told(docs.where("timed_out"), "TIMEOUT"),
        *([told(docs.where("unsupported").join(seeds, key, "left_anti"), "UNSUPPORTED")] if "unsupported" in docs.columns else []),
        told(action.where("not executable and not quoted and mood <> 'interrogative'"), "NON_EXECUTABLE_SPEECH_ACT"),
        told(docs.join(seeds, key, "left_anti"), "NO_EXECUTABLE_ACTION"),
        told(action.where("quoted"), "QUOTED_ACTION"),
        told(action.where("mood = 'interrogative' and not polite"), "INTERROGATIVE_ACTION"),
        told(relevant.where("kind = 'changes' and sense_status = 'AMBIGUOUS'"), "AMBIGUOUS_ACTION_SENSE"),
        told(relevant.where("role = 'scope' and status <> 'RESOLVED'"), "UNRESOLVED_SCOPE"),
        told(relevant.where("role = 'reference' and status <> 'RESOLVED'"), "AMBIGUOUS_OR_INSUFFICIENT_REFERENCE"),
        told(cyclic, "CYCLIC_ACTION_GRAPH"),
    ]
    reasons = reduce(DataFrame.unionByName, found).distinct()
    place = F.array_position(F.array(*[F.lit(r) for r in REASONS]), F.col("reason"))
    listed = reasons.withColumn("_p", place).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "reason"))), lambda x: x["reason"]).alias("reasons"))
    out = docs.join(listed, key, "left").withColumn("reasons", F.when(F.col("external"), F.coalesce("reasons", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
    return out.select(key, (F.size("reasons") == 0).alias("allowed"), "reasons")


def attach_best(constraints: DataFrame, actions: DataFrame, key: str) -> DataFrame:
    """Each constraint with its action: 100 for a related target, 40 in the same clause, 20 where the action comes after; the nearest among equals.

    Both: key, prop_id, target, clause_no, start.
    """
    c = constraints.select(key, F.col("prop_id").alias("constraint_id"), F.col("target").alias("c_target"), F.col("clause_no").alias("c_clause"), F.col("start").alias("c_start"))
    a = actions.select(key, F.col("prop_id").alias("action_id"), F.col("target").alias("a_target"), F.col("clause_no").alias("a_clause"), F.col("start").alias("a_start"))
    near = F.contains("c_target", F.col("a_target")) | F.contains("a_target", F.col("c_target"))
    score = F.when(near, 100).otherwise(0) + F.when(F.col("c_clause") == F.col("a_clause"), 40).otherwise(0) + F.when(F.col("a_start") > F.col("c_start"), 20).otherwise(0)
    w = W.partitionBy(key, "constraint_id").orderBy(F.desc("score"), F.abs(F.col("a_start") - F.col("c_start")), "action_id")
    return c.join(a, key).withColumn("score", score).withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, "constraint_id", "action_id", "score")


def entities(mentions: DataFrame, key: str) -> DataFrame:
    """One entity for each compact form: its first mention, all surfaces in order, how often, the greatest salience, and a number by first place.

    mentions: key, surface, seq, salience.
    """
    compact = F.regexp_replace(F.lower("surface"), r"[^\p{L}\p{N}]+", "")
    grouped = mentions.withColumn("entity_key", compact).where("entity_key <> ''").groupBy(key, "entity_key").agg(F.min_by("surface", "seq").alias("name"), F.min("seq").alias("first"), F.count("*").alias("mentions"), F.max("salience").alias("salience"), F.array_sort(F.collect_set("surface")).alias("aliases"))
    return grouped.withColumn("entity_no", F.row_number().over(W.partitionBy(key).orderBy("first", "entity_key")))


def capped(nodes: DataFrame, key: str, order: list, cap: int) -> DataFrame:
    """Nodes up to the cap, and one marker row (node null, limited) for a graph that has more: nothing is dropped in silence."""
    w = W.partitionBy(key)
    numbered = nodes.withColumn("_n", F.row_number().over(w.orderBy(*order))).withColumn("_all", F.count("*").over(w))
    kept = numbered.where(F.col("_n") <= cap).select(*nodes.columns, F.lit(False).alias("limited"))
    marks = numbered.where((F.col("_n") == 1) & (F.col("_all") > cap)).select(*[F.col(c) if c == key else F.lit(None).cast(dict(nodes.dtypes)[c]).alias(c) for c in nodes.columns], F.lit(True).alias("limited"))
    return kept.unionByName(marks)
