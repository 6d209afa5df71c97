"""Dictionary and rule matching as joins.

Rules: rule_id, intent, cover (a word that every match contains, or null: always tried), pattern (Java regular expression), priority, enabled.
Phrases: expression, surface, cues (words of which one must stand in the same clause), policy, domain.
Synonyms: surface, canonical. Dictionaries are dimensions: they go to the executors where their size is under the broadcast
threshold, by the planner's own decision; clauses are never multiplied by rules whose cover they lack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import spans
from .segment import TOKEN_BREAK


def probe(clauses: DataFrame, rules: DataFrame) -> DataFrame:
    """Clauses with the rules whose cover is one of their words, and with rules that have none."""
    on = rules.where(F.coalesce("enabled", F.lit(True)))
    worded = clauses.withColumn("_word", F.explode(F.array_distinct(F.split(F.lower("clause"), TOKEN_BREAK))))
    covered = worded.join(on.where("cover is not null").withColumn("_word", F.lower("cover")).drop("cover"), "_word").drop("_word")
    always = on.where("cover is null").drop("cover")
    # rules without a cover are few by construction: they ride on the clause as one array
    many = always.agg(F.collect_list(F.struct(*always.columns)).alias("_always"))
    free = clauses.join(F.broadcast(many)).withColumn("_rule", F.explode("_always")).select(*clauses.columns, "_rule.*")
    return covered.unionByName(free)


#: Rules up to which their patterns become part of the plan, where each is compiled once a task.
LITERAL_RULES = 200


def match_rules(clauses: DataFrame, rules: DataFrame, key: str = "doc_id", literal: int = LITERAL_RULES) -> DataFrame:
    """key, clause_no, rule_id, intent, priority, start, end, surface: every match of every rule that may match.

    A few rules are written into the plan: a clause is never multiplied or joined. More rules are joined by their covers.
    """
    some = rules.where(F.coalesce("enabled", F.lit(True))).select("rule_id", "intent", "priority", "pattern", "cover").limit(literal + 1).collect()
    if len(some) > literal:
        return match_rules_joined(clauses, rules, key)
    worded = clauses.select(key, "clause_no", "start", "clause", F.split(F.lower("clause"), TOKEN_BREAK).alias("_words"))

    def of(r) -> Column:
        hit = F.col("clause").rlike(r["pattern"])
        if r["cover"] is not None:
            hit = F.array_contains("_words", r["cover"].lower()) & hit
        found = F.transform(spans(F.col("clause"), r["pattern"], short_only=True), lambda m: F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["intent"]).alias("intent"), F.lit(r["priority"]).alias("priority"), m["start"].alias("from"), m["end"].alias("to"), m["surface"].alias("surface")))
        return F.when(hit, found)

    if not some:
        return match_rules_joined(clauses, rules, key)
    hits = worded.withColumn("m", F.explode(F.flatten(F.array_compact(F.array(*[of(r) for r in some])))))
    return hits.select(key, "clause_no", "m.rule_id", "m.intent", "m.priority", (F.col("start") + F.col("m.from")).alias("start"), (F.col("start") + F.col("m.to")).alias("end"), F.col("m.surface").alias("surface"))


def match_rules_joined(clauses: DataFrame, rules: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same for any number of rules: clauses meet rules by a word of theirs that is a rule's cover."""
    hits = probe(clauses, rules).where(F.regexp_like("clause", F.col("pattern"))).withColumn("m", F.explode(spans(F.col("clause"), F.col("pattern"))))
    return hits.select(key, "clause_no", "rule_id", "intent", "priority", (F.col("start") + F.col("m.start")).alias("start"), (F.col("start") + F.col("m.end")).alias("end"), F.col("m.surface").alias("surface"))


def match_rules_exhaustively(clauses: DataFrame, rules: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same without the probe: every rule on every clause. The twin that the probe is checked against."""
    on = rules.where(F.coalesce("enabled", F.lit(True)))
    all_rules = on.agg(F.collect_list(F.struct("rule_id", "intent", "priority", "pattern")).alias("_rules"))
    hits = clauses.join(F.broadcast(all_rules)).withColumn("_r", F.explode("_rules")).select(*clauses.columns, "_r.*").where(F.regexp_like("clause", F.col("pattern"))).withColumn("m", F.explode(spans(F.col("clause"), F.col("pattern"))))
    return hits.select(key, "clause_no", "rule_id", "intent", "priority", (F.col("start") + F.col("m.start")).alias("start"), (F.col("start") + F.col("m.end")).alias("end"), F.col("m.surface").alias("surface"))


def captures(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """Matches with the first group of their rule as `value`."""
    return matches.join(rules.select("rule_id", "pattern"), "rule_id").withColumn("value", F.expr("regexp_extract(surface, pattern, 1)")).drop("pattern")


def dedup_intents(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of matches with the same intent, place and surface the one of highest priority (ties: smaller rule_id)."""
    w = W.partitionBy(key, "clause_no", "intent", "start", "end", "surface").orderBy(F.desc("priority"), "rule_id")
    return matches.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: First words of phrases up to which they are written into the plan.
FIRST_WORDS = 500


def phrase_hits(clauses: DataFrame, phrases: DataFrame, key: str = "doc_id") -> DataFrame:
    """Literal phrase matches by whole words, with the status of their context policy.

    Policies: required_any (some cue in the clause, else INSUFFICIENT), forbidden_any (any cue makes it UNSUPPORTED), optional (RESOLVED).
    """
    first = phrases.withColumn("_word", F.split(F.lower("surface"), TOKEN_BREAK)[0])
    words = F.array_distinct(F.split(F.trim("_low"), " "))
    # the first words of a small dictionary are kept before the explode; those of a large one meet in the join
    some = [r["_word"] for r in first.select("_word").distinct().limit(FIRST_WORDS + 1).collect()]
    if len(some) <= FIRST_WORDS:
        words = F.array_intersect(words, F.array(*[F.lit(w) for w in some]).cast("array<string>"))
    worded = clauses.withColumn("_low", F.concat(F.lit(" "), F.regexp_replace(F.lower("clause"), TOKEN_BREAK, " "), F.lit(" "))).withColumn("_word", F.explode(words))
    hit = worded.join(first, "_word").where(F.expr("contains(_low, concat(' ', lower(surface), ' '))"))
    cued = F.exists("cues", lambda c: F.contains(F.col("_low"), F.concat(F.lit(" "), F.lower(c), F.lit(" "))))
    status = F.when(F.col("policy") == "required_any", F.when(cued, "RESOLVED").otherwise("INSUFFICIENT")).when((F.col("policy") == "forbidden_any") & cued, "UNSUPPORTED").otherwise("RESOLVED")
    return hit.select(key, "clause_no", "expression", "surface", "domain", F.size(F.filter("cues", lambda c: F.contains(F.col("_low"), F.concat(F.lit(" "), F.lower(c), F.lit(" "))))).alias("cue_hits"), status.alias("status"))


def synonym_exact(names: DataFrame, synonyms: DataFrame, column: str) -> DataFrame:
    """Names whose compact form is a synonym's: an equi join."""
    return names.withColumn("surface", F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", "")).join(synonyms, "surface")


def synonym_scan(tokens: DataFrame, synonyms: DataFrame, longest: int, keys: list[str]) -> DataFrame:
    """The longest synonym at every token, over runs of up to `longest` tokens. tokens: keys, pos, token; synonym surfaces are words with single spaces."""
    w = W.partitionBy(*keys).orderBy("pos")
    ahead = tokens.select(*keys, "pos", F.col("token").alias("_t0"), *[F.lead("token", i).over(w).alias(f"_t{i}") for i in range(1, longest)])
    runs = ahead.select(*keys, "pos", F.explode(F.array(*[F.struct(F.lit(n).alias("size"), F.when(F.col(f"_t{n - 1}").isNotNull(), F.concat_ws(" ", *[f"_t{i}" for i in range(n)])).alias("surface")) for n in range(1, longest + 1)])).alias("r"))
    hit = runs.where("r.surface is not null").select(*keys, "pos", "r.size", "r.surface").join(synonyms, "surface")
    return hit.groupBy(*keys, "pos").agg(F.max_by(F.struct("surface", "canonical", "size"), "size").alias("m")).select(*keys, "pos", "m.*")


def related(pairs: DataFrame, left: str, right: str, left_ids: str, right_ids: str) -> DataFrame:
    """Pairs with `related`: exact ids decide if both sides have some, else equality or containment of compact forms of two characters at least."""
    a, b = F.regexp_replace(F.lower(left), r"[^\p{L}\p{N}]+", ""), F.regexp_replace(F.lower(right), r"[^\p{L}\p{N}]+", "")
    both = (F.size(left_ids) > 0) & (F.size(right_ids) > 0)
    contained = (F.least(F.length(a), F.length(b)) >= 2) & (F.contains(a, b) | F.contains(b, a))
    return pairs.withColumn("related", F.when(both, F.arrays_overlap(left_ids, right_ids)).otherwise((a == b) | contained))


def cascade(tokens: DataFrame, tiers: list[DataFrame], on: list[str], keys: list[str], top: int = 8) -> DataFrame:
    """Lookup by the first tier that has candidates (each tier: its column of `on`, record_id), at most `top` of them by record_id, with the total.

    A list that was cut (total > top) must not be resolved by anyone downstream.
    """
    found = None
    for level, (tier, column) in enumerate(zip(tiers, on, strict=True)):
        hit = tokens.join(tier, column).select(*keys, F.lit(level).alias("tier"), "record_id")
        found = hit if found is None else found.unionByName(hit)
    w = W.partitionBy(*keys)
    best = found.distinct().withColumn("_best", F.min("tier").over(w)).where("tier = _best").drop("_best")
    return best.withColumn("total", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy("record_id"))).where(F.col("rank") <= top)


def pack_lookup(tokens: DataFrame, packs: DataFrame, keys: list[str], cap: int = 32) -> DataFrame:
    """Semantic pack records of tokens (surface, normalized, reading): those under the surface or the normal form; only where there are none, those under the reading. At most `cap` by record_id, with the total.

    packs: key, reading, record_id. Tokens never meet all records of a key: these are counted and their first ones taken once for each key, and once
    for each set of keys under which tokens look. A set's total is that of its largest key and what the others have besides.
    """
    lists = packs.select(F.lit(0).alias("_tier"), F.col("key").alias("_key"), "record_id").unionByName(packs.select(F.lit(1).alias("_tier"), F.col("reading").alias("_key"), "record_id")).where("_key is not null").distinct()
    sizes = lists.groupBy("_tier", "_key").agg(F.count("*").alias("_size"))
    w = W.partitionBy("_tier", "_key").orderBy("record_id")
    firsts = lists.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).groupBy("_tier", "_key").agg(F.collect_list(F.struct("record_id")).alias("_first"))

    places = F.array(*[F.struct(F.lit(tier).alias("_tier"), F.col(c).alias("_key")) for tier, c in ((0, "surface"), (0, "normalized"), (1, "reading"))])
    met = tokens.select(*keys, F.explode(places).alias("_p")).select(*keys, "_p.*").join(sizes, ["_tier", "_key"])
    met = met.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("_tier", (-F.col("_size")).alias("_less"), "_key"))).alias("_met"))
    best = F.filter("_met", lambda x: x["_tier"] == F.col("_met")[0]["_tier"])
    met = met.select(*keys, F.col("_met")[0]["_tier"].alias("tier"), (-F.col("_met")[0]["_less"]).alias("_most"), F.transform(best, lambda x: x["_key"]).alias("_set"))

    sets = met.select("tier", "_set", "_most").distinct()
    firsts = sets.select("tier", "_set", "_most", F.explode("_set").alias("_key")).join(firsts.withColumnRenamed("_tier", "tier"), ["tier", "_key"])
    firsts = firsts.groupBy("tier", "_set", "_most").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_first")))), 1, cap).alias("_first"))
    held = lists.select(F.col("_tier").alias("tier"), "_key", "record_id")
    others = sets.where(F.size("_set") > 1).select("tier", "_set", F.col("_set")[0].alias("_large"), F.explode(F.slice("_set", 2, F.size("_set"))).alias("_key"))
    others = others.join(held, ["tier", "_key"]).select("tier", "_set", "_large", "record_id").distinct()
    large = lists.select(F.col("_tier").alias("_t"), F.col("_key").alias("_k"), F.col("record_id").alias("_r"))
    more = others.join(large, (F.col("tier") == F.col("_t")) & (F.col("_large") == F.col("_k")) & F.col("record_id").eqNullSafe(F.col("_r")), "left_anti").groupBy("tier", "_set").agg(F.count("*").alias("_more"))
    found = firsts.join(more, ["tier", "_set"], "left").select("tier", "_set", "_first", (F.col("_most") + F.coalesce("_more", F.lit(0))).alias("total"))
    return met.select(*keys, "tier", "_set").join(found, ["tier", "_set"]).select(*keys, "tier", F.explode("_first.record_id").alias("record_id"), "total")


def reading_lookup(tokens: DataFrame, readings: DataFrame) -> DataFrame:
    """Readings (reading, record_id, restricted_to, no_kanji) of tokens (surface, normalized, reading): a restriction must name the surface or its normal form; no_kanji blocks surfaces with Han characters. Kana are folded by the caller."""
    hit = tokens.join(readings, "reading")
    free = (F.size("restricted_to") == 0) | F.array_contains("restricted_to", F.col("surface")) | F.array_contains("restricted_to", F.col("normalized"))
    return hit.where(free & ~(F.col("no_kanji") & F.col("surface").rlike(r"\p{IsHan}"))).drop("restricted_to", "no_kanji")


def overlaps(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Interval join within equal keys: rows of a and b (start, end each) that share a character; b's columns get the prefix r_."""
    right = b.select(*[F.col(c) if c in keys else F.col(c).alias(f"r_{c}") for c in b.columns])
    return a.join(right, keys).where((F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")))


def assign_clause(items: DataFrame, clauses: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each item with the clause of greatest overlap, the first among equals; an item that overlaps none still gets the first clause."""
    c = clauses.select(key, "clause_no", F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    shared = F.greatest(F.lit(0), F.least("end", "c_end") - F.greatest("start", "c_start"))
    w = W.partitionBy(key, "item_id").orderBy(F.desc("shared"), "clause_no")
    return items.join(c, key).withColumn("shared", shared).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "c_start", "c_end")


def containing_clause(items: DataFrame, clauses: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each item with the shortest clause that its start lies in."""
    c = clauses.select(key, "clause_no", F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    w = W.partitionBy(key, "item_id").orderBy(F.col("c_end") - F.col("c_start"), "clause_no")
    return items.join(c, key).where("start >= c_start and start < c_end").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "c_start", "c_end")


def inside(items: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Items within some range: a left semi interval join."""
    r = ranges.select(*keys, F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    on = [items[k] == r[k] for k in keys] + [items["start"] >= r["r_start"], items["end"] <= r["r_end"]]
    return items.join(r, on, "left_semi")


def guarded(items: DataFrame, guards: DataFrame, keys: list[str]) -> DataFrame:
    """Items that no guard overlaps which names them (guards: keys, start, end, suppresses): a left anti interval join."""
    g = guards.select(*[F.col(k).alias(f"g_{k}") for k in keys], F.col("start").alias("g_start"), F.col("end").alias("g_end"), "suppresses")
    on = [items[k] == g[f"g_{k}"] for k in keys] + [items["entry_id"] == g["suppresses"], items["start"] < g["g_end"], g["g_start"] < items["end"]]
    return items.join(g, on, "left_anti")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("F", "W", "DataFrame", "spans", "annotations")]
