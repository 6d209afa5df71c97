"""Meaning graphs as relations: building blocks that attach, redirect, insert, update and connect propositions.

Propositions: key, prop_id, intent, start, end, clause_no, target, status, executable (more columns ride along). All joins have
the key (an utterance, a document) as an equi condition; what is left is an interval or containment test within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import compact_punctuation

# -- columns ----------------------------------------------------------------------------------------------------------

#: What a fragment loses at its start (connectives) and at its end (limiters), for Latin scripts; a caller passes its own.
CONNECTIVES, LIMITERS = ("and", "but", "then", "so"), ("only", "too", "also")


def clean_fragment(x: Column, leading: tuple[str, ...] = CONNECTIVES, trailing: tuple[str, ...] = LIMITERS) -> Column:
    """Without punctuation and white space at both ends, leading connectives and trailing limiters."""
    edge = r"[\p{P}\p{S} \t\r\n]+"
    x = F.regexp_replace(x, f"^{edge}|{edge}$", "")
    x = F.regexp_replace(x, rf"(?i)^(?:(?:{'|'.join(leading)})[ ,]+)+", "")
    return F.regexp_replace(F.regexp_replace(x, rf"(?i)(?:[ ,]+(?:{'|'.join(trailing)}))+$", ""), f"^{edge}|{edge}$", "")


def first_that_fits(x: Column, classes: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The name of the first (name, pattern) that is found: epistemic status, and whatever else is an ordered list of patterns."""
    out = F.lit(otherwise)
    for name, pattern in reversed(classes):
        out = F.when(x.rlike(pattern), name).otherwise(out)
    return out


def case_role(value: Column, markers: list[tuple[str, str]]) -> Column:
    """The role of the first (marker, role) that a value ends with; longer markers must come first. Null without one."""
    out = F.lit(None).cast("string")
    for marker, role in reversed(markers):
        out = F.when(value.endswith(marker), role).otherwise(out)
    return out


def argument_role(default: Column, value: Column, markers: list[tuple[str, str]], overridable: list[str]) -> Column:
    """The role that a capture's name gives, but for some roles what the value's case marker says."""
    return F.when(default.isin(*overridable), F.coalesce(case_role(value, markers), default)).otherwise(default)


def picked(captures: Column, names: list[str]) -> Column:
    """The first present of some captures of a map."""
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(captures, F.lit(n))), F.lit("")) for n in names])


def marked(text: Column, value: Column, markers: list[str]) -> Column:
    """Whether the value stands before one of the markers in the text (topic, focus)."""
    return F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(text, F.concat(value, m)))


def nearest_argument(text: Column, clause_start: Column, at: Column, markers: list[str]) -> Column:
    """(value, marker) of what stands right before a predicate: the end of the last segment of its clause, if it ends with a marker (longest first)."""
    prefix = F.substring(text, clause_start + 1, at - clause_start)
    segment = F.trim(F.element_at(F.split(prefix, "[,.!?;:]"), -1))
    pattern = rf"^(.{{1,48}}?) ({'|'.join(markers)})$"
    value = F.regexp_extract(segment, pattern, 1)
    return F.when(value != "", F.struct(clean_fragment(value).alias("value"), F.regexp_extract(segment, pattern, 2).alias("marker")))


def action_details(text: Column, pattern: str, intents: dict[str, tuple[str, str]]) -> Column:
    """(target, intent, predicate) of the first hit of a pattern with groups 1 (target) and 2 (action word)."""
    action = F.regexp_extract(text, pattern, 2)
    intent = predicate = F.lit(None).cast("string")
    for word, (kind, name) in intents.items():
        intent, predicate = F.when(action == word, kind).otherwise(intent), F.when(action == word, name).otherwise(predicate)
    return F.when(action != "", F.struct(F.nullif(clean_fragment(F.regexp_extract(text, pattern, 1)), F.lit("")).alias("target"), intent.alias("intent"), predicate.alias("predicate")))


def valid_antecedent(value: Column, generic: list[str]) -> Column:
    """Two characters at least in compact form, and none of the generic ones."""
    key = compact_punctuation(value)
    return F.coalesce((F.length(key) >= 2) & ~key.isin(*generic), F.lit(False))


def predicate_only(value: Column, source: Column, predicates: list[str], endings: list[str]) -> Column:
    """Whether an argument merely repeats its proposition, or is a verb once its ending is gone."""
    key = compact_punctuation(value)
    return (key == compact_punctuation(source)) | F.regexp_replace(key, f"(?:{'|'.join(endings)})$", "").isin(*predicates)


def locate(text: Column, fragment: Column, start: Column, end: Column) -> Column:
    """(start, end) of a fragment: its first place within [start, end), else its first place at all, else null."""
    inside = F.position(fragment, F.substring(text, start + 1, end - start))
    first = F.when(inside > 0, start + inside - 1).otherwise(F.position(fragment, text) - 1)
    return F.when((F.length(fragment) > 0) & (first >= 0), F.struct(first.cast("int").alias("start"), (first + F.length(fragment)).cast("int").alias("end")))


def reference_score(source: Column, rank: Column, head: Column, candidate: Column, related: Column, same: Column) -> Column:
    """Points of a candidate for a reference: where it is from, less its rank, and how the reference's head meets it.

    source: known, current or context; rank: recency from 0; head: of the reference, blank where it has none; same: whether the reference says `same`.
    """
    # Points that callers compare against thresholds.
    base = F.when(source == "known", 110).when(source == "current", 100).otherwise(70)
    has = F.coalesce(F.trim(head), F.lit("")) != ""
    met = F.when(head == candidate, 130).when(F.contains(candidate, head), 100).when(F.contains(head, candidate), 60).when(related, 45).otherwise(-80)
    return base - F.least(F.lit(30), rank * 4) + F.when(has, met).otherwise(0) + F.when(has & same & F.contains(candidate, head), 25).otherwise(0)


def lexical_score(tier: Column, reading: Column, pos: Column, restricted: Column, no_kanji: Column, kana_usage: Column, domain_cue: Column, provenance: Column) -> Column:
    """Points of a lexical candidate: 100, 75 or 50 by tier (0 surface, 1 normalised, 2 reading), and what else speaks for it (booleans)."""
    # Points that callers compare against thresholds.
    points = ((reading, 30), (pos, 20), (restricted, 10), (no_kanji, 5), (kana_usage, 5), (domain_cue, 25), (provenance, 1))
    return sum((F.when(flag, n).otherwise(0) for flag, n in points), F.when(tier == 0, 100).when(tier == 1, 75).otherwise(50))


def pack_score(context: Column, pos: Column, required_all: Column, required_any: Column, forbidden_any: Column, domains: Column, evidence: Column) -> Column:
    """Points of a semantic pack candidate; null where its context conditions fail. Lists of lower-case words; context in lower case."""
    # Points that callers compare against thresholds.
    has = lambda words: F.filter(words, lambda w: F.contains(context, w))
    fails = ((F.size(required_all) > 0) & (F.size(has(required_all)) < F.size(required_all))) | ((F.size(required_any) > 0) & (F.size(has(required_any)) == 0)) | (F.size(has(forbidden_any)) > 0)
    points = ((pos, 20), (F.size(required_all) > 0, 40), (F.size(required_any) > 0, 25), (F.size(has(domains)) > 0, 10), (evidence, 1))
    return F.when(~fails, sum((F.when(flag, n).otherwise(0) for flag, n in points), F.lit(100)))


def apply_parameters(rows: DataFrame, parameters: str, scalars: list[str], lists: list[str]) -> DataFrame:
    """Columns that are allowed take what a struct of parameters has: scalars replace, lists are joined in order, each value once."""
    p = lambda c: F.col(f"{parameters}.{c}")
    new = {c: F.coalesce(p(c), F.col(c)) for c in scalars}
    new |= {c: F.array_distinct(F.concat(F.coalesce(F.col(c), F.array().cast("array<string>")), F.coalesce(p(c), F.array().cast("array<string>")))) for c in lists}
    return rows.withColumns(new).drop(parameters)


# -- joins ------------------------------------------------------------------------------------------------------------


def redirect_requests(props: DataFrame, key: str, generic: str = "request") -> DataFrame:
    """key, prop_id, task_id: every executable proposition with the one that stands for it: a generic one that a specific one overlaps gives way to it.

    Of several: the same clause first, then the nearest start, the earlier, the smaller id.
    """
    live = props.where("executable").select(key, "prop_id", "intent", "start", "end", "clause_no")
    specific = live.where(F.col("intent") != generic).select(key, F.col("prop_id").alias("task_id"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("clause_no").alias("_c"))
    hit = live.where(F.col("intent") == generic).join(specific, key).where("start < _e and _s < end")
    best = hit.groupBy(key, "prop_id").agg(F.min(F.struct((F.col("_c") != F.col("clause_no")).cast("int"), F.abs(F.col("_s") - F.col("start")), "_s", "task_id")).alias("m")).select(key, "prop_id", "m.task_id")
    return live.select(key, "prop_id").join(best, [key, "prop_id"], "left").withColumn("task_id", F.coalesce("task_id", "prop_id"))


def task_graph(props: DataFrame, edges: DataFrame, key: str, constraints: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tasks: key, task_id; dependencies: key, src, dst, relation; constraints: key, task_id, relation, source_id).

    edges: key, src, dst, relation. Ends are redirected first; `precedes` keeps its direction, `depends_on` is turned round; relations
    of `constraints` hang on their target. Loops go, equal pairs count once.
    """
    to = redirect_requests(props, key)
    tasks = to.where("prop_id = task_id").select(key, "task_id")
    end = lambda side: to.select(key, F.col("prop_id").alias(side), F.col("task_id").alias(f"_{side}"))
    order = edges.where("relation in ('precedes', 'depends_on')").join(end("src"), [key, "src"]).join(end("dst"), [key, "dst"])
    turned = F.col("relation") == "depends_on"
    order = order.select(key, F.when(turned, F.col("_dst")).otherwise(F.col("_src")).alias("src"), F.when(turned, F.col("_src")).otherwise(F.col("_dst")).alias("dst"), "relation").where("src <> dst")
    order = order.groupBy(key, "src", "dst").agg(F.max("relation").alias("relation"))
    held = edges.where(F.col("relation").isin(*constraints)).join(end("dst"), [key, "dst"]).select(key, F.col("_dst").alias("task_id"), "relation", F.col("src").alias("source_id")).distinct()
    return tasks, order, held


def match_fragments(fragments: DataFrame, tasks: DataFrame, key: str, weak: list[str]) -> DataFrame:
    """key, fragment_id, task_id, score: the task that a fragment means: 100 for its target, 60 for containment, 40 within its source, 80 for overlap, 20 less for weak intents.

    fragments: key, fragment_id, fragment, at (its place, -1 unknown); tasks: key, task_id, intent, target, source, start, end. Ties: nearest, then earlier.
    """
    f = fragments.select(key, "fragment_id", F.lower("fragment").alias("_f"), "at").where("_f <> ''")
    t = tasks.select(key, "task_id", "intent", F.lower("target").alias("_t"), F.lower("source").alias("_s"), "start", "end")
    # Points that callers compare against thresholds.
    score = F.when(F.col("_t") == F.col("_f"), 100).when((F.col("_t") != "") & (F.contains("_t", F.col("_f")) | F.contains("_f", F.col("_t"))), 60).otherwise(0)
    score = score + F.when(F.contains("_s", F.col("_f")), 40).otherwise(0)
    score = score + F.when((F.col("at") >= 0) & (F.col("start") < F.col("at") + F.length("_f")) & (F.col("at") < F.col("end")), 80).otherwise(0) - F.when(F.col("intent").isin(*weak), 20).otherwise(0)
    hit = f.join(t, key).withColumn("score", score).where("score > 0")
    best = F.min(F.struct((-F.col("score")).alias("n"), F.abs(F.col("start") - F.greatest("at", F.lit(0))).alias("d"), F.col("start").alias("s"), "task_id"))
    return hit.groupBy(key, "fragment_id").agg(best.alias("m")).select(key, "fragment_id", "m.task_id", (-F.col("m.n")).alias("score"))


def fragment_edges(relations: DataFrame, matched: DataFrame, tasks: DataFrame, key: str) -> DataFrame:
    """key, src, dst: an edge for each relation (key, relation_id, first, second: fragment ids); `last` relations (first null) fan in all tasks that start earlier."""
    m = lambda side: matched.select(key, F.col("fragment_id").alias(side), F.col("task_id").alias(f"_{side}"))
    pairs = relations.where("first is not null").join(m("first"), [key, "first"]).join(m("second"), [key, "second"]).select(key, F.col("_first").alias("src"), F.col("_second").alias("dst"))
    ends = relations.where("first is null").join(m("second"), [key, "second"]).join(tasks.select(key, F.col("task_id").alias("_second"), F.col("start").alias("_at")), [key, "_second"])
    fan = ends.join(tasks.select(key, F.col("task_id").alias("src"), "start"), key).where("start < _at").select(key, "src", F.col("_second").alias("dst"))
    return pairs.unionByName(fan).where("src <> dst").distinct()


def tokens_to_props(tokens: DataFrame, props: DataFrame, key: str) -> DataFrame:
    """key, pos, prop_id: propositions whose span a token overlaps; where there is none, those whose clause it lies in."""
    t, p = tokens.select(key, "pos", F.col("start").alias("_ts"), F.col("end").alias("_te")), props.select(key, "prop_id", "start", "end", "clause_start", "clause_end")
    both = t.join(p, key).where("_ts < clause_end and clause_start < _te")
    direct = F.when((F.col("_ts") < F.col("end")) & (F.col("start") < F.col("_te")), 0).when((F.col("clause_start") <= F.col("_ts")) & (F.col("_te") <= F.col("clause_end")), 1)
    tiered = both.withColumn("_tier", direct).where("_tier is not null")
    best = F.min("_tier").over(W.partitionBy(key, "pos"))
    return tiered.withColumn("_best", best).where("_tier = _best").select(key, "pos", "prop_id")


def first_owners(entities: DataFrame, key: str) -> DataFrame:
    """key, entity_key, entity_id: of entities under one compact form the first."""
    return entities.withColumn("entity_key", compact_punctuation(F.col("name"))).where("entity_key <> ''").groupBy(key, "entity_key").agg(F.min_by("entity_id", F.struct("seq", "entity_id")).alias("entity_id"))


def ensure_entities(known: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Known entities (key, entity_no, name) and new ones for wanted names whose compact form none has, numbered on from the last by first place (seq)."""
    form = compact_punctuation(F.col("name"))
    have = known.select(key, form.alias("_k"))
    new = wanted.withColumn("_k", form).where("_k <> ''").groupBy(key, "_k").agg(F.min_by("name", "seq").alias("name"), F.min("seq").alias("seq")).join(have, [key, "_k"], "left_anti")
    last = known.groupBy(key).agg(F.max("entity_no").alias("_last"))
    numbered = new.join(last, key, "left").withColumn("entity_no", (F.coalesce("_last", F.lit(0)) + F.row_number().over(W.partitionBy(key).orderBy("seq", "_k"))).cast("int"))
    return known.select(key, "entity_no", "name").unionByName(numbered.select(key, "entity_no", "name"))


def emit_represented(candidates: DataFrame, props: DataFrame, key: str, passing: str = "reference") -> DataFrame:
    """Candidates that a proposition represents (equal intent and span), and all of the passing intent: a left semi join and a filter."""
    kept = candidates.where(F.col("intent") != passing).join(props.select(key, "intent", "start", "end"), [key, "intent", "start", "end"], "left_semi")
    return kept.unionByName(candidates.where(F.col("intent") == passing))


def insert_apart(props: DataFrame, new: DataFrame, key: str, same: str | None = "intent") -> DataFrame:
    """Propositions and those new ones that overlap none of them (of the same `same`, or of any): a left anti interval join."""
    o = props.select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"), *([F.col(same).alias("_i")] if same else []))
    on = [F.col(key) == F.col("_k"), F.col("start") < F.col("_e"), F.col("_s") < F.col("end")] + ([F.col(same) == F.col("_i")] if same else [])
    return props.unionByName(new.join(o, on, "left_anti").select(*props.columns))


def upsert(props: DataFrame, acts: DataFrame, key: str, fields: list[str], prefer: list[str], last: bool = False) -> DataFrame:
    """Each act (act_id, fields of its own, target) updates the proposition that it overlaps, of preferred intents first, then the earliest; acts that overlap none are inserted.

    A proposition that several acts choose takes the first act by id (the last where `last`). Inserted rows are executable only with a target.
    """
    a = acts.select(key, "act_id", F.col("start").alias("_s"), F.col("end").alias("_e"), *[F.col(f).alias(f"_{f}") for f in fields])
    hit = props.select(key, "prop_id", "intent", "start", "end").join(a, key).where("start < _e and _s < end")
    rank = F.struct((~F.col("intent").isin(*prefer)).cast("int").alias("r"), "start", "prop_id")
    chosen = hit.groupBy(key, "act_id", *[f"_{f}" for f in fields]).agg(F.min(rank).alias("m")).select(key, F.col("m.prop_id").alias("prop_id"), "act_id", *[f"_{f}" for f in fields])
    pick = F.max_by if last else F.min_by
    one = chosen.groupBy(key, "prop_id").agg(pick(F.struct(*[f"_{f}" for f in fields]), "act_id").alias("_new"))
    updated = props.join(one, [key, "prop_id"], "left").select(*[F.coalesce(F.col(f"_new._{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in props.columns])
    kinds = dict(props.dtypes)
    row = {"prop_id": F.concat(F.lit("new-"), F.col("act_id").cast("string")), "executable": F.coalesce(F.col("executable"), F.lit(False)) & (F.coalesce(F.col("target"), F.lit("")) != "")}
    missed = acts.join(chosen.select(key, "act_id").distinct(), [key, "act_id"], "left_anti")
    return updated.unionByName(missed.select(*[row[c].alias(c) if c in row else F.col(c) if c in missed.columns else F.lit(None).cast(kinds[c]).alias(c) for c in props.columns]))


def clause_observations(clauses: DataFrame, props: DataFrame, key: str) -> DataFrame:
    """key, clause_no, prop_id, inserted: the first proposition of every clause, or a new observation where it has none."""
    first = props.groupBy(key, "clause_no").agg(F.min_by("prop_id", F.struct("start", "prop_id")).alias("prop_id"))
    found = clauses.select(key, "clause_no").join(first, [key, "clause_no"], "left")
    return found.select(key, "clause_no", F.coalesce("prop_id", F.concat(F.lit("obs-"), F.col("clause_no").cast("string"))).alias("prop_id"), F.col("prop_id").isNull().alias("inserted"))


def add_edges(edges: DataFrame, new: DataFrame, key: str, cap: int) -> DataFrame:
    """Edges of both, each (src, dst, relation) once, up to the cap; a graph that has more gets one marker row (src null, limited). In order of src, dst, relation."""
    every = edges.unionByName(new).select(key, "src", "dst", "relation").distinct()
    w = W.partitionBy(key)
    n = every.withColumn("_n", F.row_number().over(w.orderBy("src", "dst", "relation"))).withColumn("_all", F.count("*").over(w))
    none = F.lit(None).cast(dict(every.dtypes)["src"])
    return n.where(F.col("_n") <= cap).select(key, "src", "dst", "relation", F.lit(False).alias("limited")).unionByName(n.where((F.col("_n") == 1) & (F.col("_all") > cap)).select(key, none.alias("src"), none.alias("dst"), F.lit(None).cast("string").alias("relation"), F.lit(True).alias("limited")))


def complete_senses(clauses: DataFrame, resolved: DataFrame, key: str, patterns: list[tuple[str, str, list[str]]]) -> DataFrame:
    """key, clause_no, lemma, sense by fixed co-occurrence (lemma, sense, words that must all stand in the clause), for clauses without a resolved sense of the lemma; the first pattern wins.

    resolved: key, clause_no, lemma.
    """
    has = lambda words: F.forall(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower("clause"), w))
    each = F.array_compact(F.array(*[F.when(has([lemma, *words]), F.struct(F.lit(i).alias("i"), F.lit(lemma).alias("lemma"), F.lit(sense).alias("sense"))) for i, (lemma, sense, words) in enumerate(patterns)]))
    found = clauses.select(key, "clause_no", F.explode(each).alias("m")).groupBy(key, "clause_no", F.col("m.lemma").alias("lemma")).agg(F.min_by("m.sense", "m.i").alias("sense"))
    return found.join(resolved.select(key, "clause_no", "lemma"), [key, "clause_no", "lemma"], "left_anti")


def clarifications(clauses: DataFrame, props: DataFrame, key: str, pattern: str) -> DataFrame:
    """key, clause_no, prop_id of clauses that ask back (pattern): an observation is inserted where the clause has no proposition of its own."""
    asks = clauses.where(F.col("clause").rlike(pattern)).select(key, "clause_no")
    return clause_observations(asks, props.join(asks, [key, "clause_no"], "left_semi"), key)


def sequence_edges(props: DataFrame, edges: DataFrame, marked_keys: DataFrame, key: str) -> DataFrame:
    """key, src, dst: from the first to the last executable action of graphs with a sequence marker, two actions at least and no `precedes` edge."""
    ends = props.where("executable").groupBy(key).agg(F.min_by("prop_id", F.struct("start", "prop_id")).alias("src"), F.max_by("prop_id", F.struct("start", "prop_id")).alias("dst"), F.count("*").alias("_n")).where("_n >= 2")
    return ends.join(marked_keys.select(key).distinct(), key, "left_semi").join(edges.where("relation = 'precedes'").select(key).distinct(), key, "left_anti").select(key, "src", "dst")


def split_sequence(texts: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """key, first, second of texts that a pattern with two groups fits ("A then B"): two observations and the edge between them."""
    one, two = (clean_fragment(F.regexp_extract(text, pattern, i)) for i in (1, 2))
    return texts.select(key, one.alias("first"), two.alias("second")).where("first <> '' and second <> ''")


def purpose_edges(props: DataFrame, texts: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """key, prop_id, purpose: the first executable action of a text that names a purpose (group 1)."""
    found = texts.select(key, clean_fragment(F.regexp_extract(text, pattern, 1)).alias("purpose")).where("purpose <> ''")
    first = props.where("executable").groupBy(key).agg(F.min_by("prop_id", F.struct("start", "prop_id")).alias("prop_id"))
    return first.join(found, key)


def demote_reported(props: DataFrame, texts: DataFrame, key: str, text: str, frame: str) -> DataFrame:
    """Propositions; where the text is a report (pattern) all actions are quoted and none is executable."""
    said = texts.where(F.col(text).rlike(frame)).select(key).distinct().withColumn("_said", F.lit(True))
    both = props.join(said, key, "left").withColumn("_said", F.coalesce("_said", F.lit(False)))
    return both.withColumn("executable", F.col("executable") & ~F.col("_said")).withColumn("quoted", F.col("quoted") | F.col("_said")).drop("_said")


def discourse_edges(clauses: DataFrame, key: str, classes: list[tuple[str, str]], fallback: tuple[str, str] | None = None) -> DataFrame:
    """key, src, dst, relation of adjacent clauses, by the first class whose pattern the later one fits; the fallback (relation, pattern) is tried on the earlier one. Each once."""
    w = W.partitionBy(key).orderBy("clause_no")
    pairs = clauses.select(key, F.col("clause_no").alias("dst"), F.lag("clause_no").over(w).alias("src"), F.lag("clause").over(w).alias("_before"), F.lower("clause").alias("_now")).where("src is not null")
    relation = first_that_fits(F.col("_now"), classes)
    if fallback is not None:
        relation = F.coalesce(relation, F.when(F.lower("_before").rlike(fallback[1]), fallback[0]))
    return pairs.withColumn("relation", relation).where("relation is not null").select(key, "src", "dst", "relation").distinct()


# -- references -------------------------------------------------------------------------------------------------------


def merge_references(references: DataFrame, key: str) -> DataFrame:
    """References with equal type, value and span once, with the greatest priority."""
    return references.groupBy(key, "type", "value", "start", "end").agg(F.max("priority").alias("priority"))


def mentions(captures: DataFrame, key: str, reference: str = "reference") -> DataFrame:
    """key, mentions: captured values of all but references, in order of their first place, each once. captures: key, intent, start, value."""
    listed = F.array_sort(F.collect_list(F.struct("start", "value")))
    return captures.where((F.col("intent") != reference) & (F.trim("value") != "")).groupBy(key).agg(F.array_distinct(F.transform(listed, lambda x: x["value"])).alias("mentions"))


def discover_references(texts: DataFrame, key: str, text: str, pattern: str, spans, priority: int = 5) -> DataFrame:
    """key, type, value, start, end, priority of every hit of a demonstrative pattern. spans: the span function of the text layer."""
    return texts.select(key, F.explode(spans(F.col(text), pattern)).alias("m")).select(key, F.lit("reference").alias("type"), F.col("m.surface").alias("value"), "m.start", "m.end", F.lit(priority).alias("priority"))


def previous_fallback(references: DataFrame, context: str, immediate: Column) -> DataFrame:
    """Unresolved references that say `immediately previous` take the last context item."""
    return references.withColumn("resolved", F.coalesce("resolved", F.when(immediate, F.try_element_at(F.col(context), F.lit(-1)))))


def refine_targets(props: DataFrame, generic: list[str], candidates: str) -> DataFrame:
    """Targets that are missing, or inferred and generic, take the last candidate that is a valid antecedent; explicit ones stay. refined: whether it was so."""
    usable = F.try_element_at(F.filter(F.col(candidates), lambda c: valid_antecedent(c, generic)), F.lit(-1))
    open_ = F.col("target").isNull() | (F.col("inferred") & ~valid_antecedent(F.col("target"), generic))
    return props.withColumn("refined", open_ & usable.isNotNull()).withColumn("target", F.when(open_, F.coalesce(usable, F.col("target"))).otherwise(F.col("target")))


def objects_before(texts: DataFrame, key: str, text: str, at: Column, pattern: str, generic: list[str]) -> DataFrame:
    """key, objects: all hits of a pattern (group 1) before a place, without generic ones, in order."""
    found = F.regexp_extract_all(F.substring(F.col(text), F.lit(1), at), F.lit(pattern), F.lit(1))
    return texts.select(key, F.filter(found, lambda x: valid_antecedent(x, generic)).alias("objects"))


def target_arguments(props: DataFrame, owners: DataFrame, key: str, text: str) -> DataFrame:
    """key, prop_id, start, end, entity_id: where a target stands (in its proposition, else anywhere) and the entity that it names."""
    at = props.withColumn("_at", locate(F.col(text), F.col("target"), F.col("start"), F.col("end"))).withColumn("entity_key", compact_punctuation(F.col("target")))
    return at.where("target is not null and target <> ''").join(owners, [key, "entity_key"], "left").select(key, "prop_id", F.col("_at.start").alias("start"), F.col("_at.end").alias("end"), "entity_id")


def resolve_references(texts: DataFrame, key: str, text: str, demonstrative: str, objects: str, generic: list[str], spans) -> DataFrame:
    """key, start, value, resolved, status of every demonstrative: the last valid object (group 1 of a pattern) that stands before it; INSUFFICIENT without one."""
    found = texts.select(key, text, F.explode(spans(F.col(text), demonstrative)).alias("m"))
    before = F.regexp_extract_all(F.substring(F.col(text), F.lit(1), F.col("m.start")), F.lit(objects), F.lit(1))
    last = F.try_element_at(F.filter(before, lambda x: valid_antecedent(x, generic)), F.lit(-1))
    return found.select(key, "m.start", F.trim("m.surface").alias("value"), last.alias("resolved"), F.when(last.isNull(), "INSUFFICIENT").otherwise("RESOLVED").alias("status"))
