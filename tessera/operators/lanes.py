"""More of the dictionary and review lanes: gates, projections, set unions with precedence, validations as violation rows.

A violation row says what is wrong with which id; nothing is dropped in silence. Nulls count as blank in required fields.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import HIRAGANA, KATAKANA


def _blank(x: Column) -> Column:
    return F.coalesce(F.trim(x.cast("string")), F.lit("")) == ""


def first_gloss(senses: Column, language: str) -> Column:
    """The first gloss in a language of an array of (lang, gloss); null where there is none."""
    return F.try_element_at(F.filter(senses, lambda s: (s["lang"] == language) & ~_blank(s["gloss"])), F.lit(1))["gloss"]


def sense_candidate(senses: Column, prefer: str = "en") -> Column:
    """(label, glosses) of an entry's senses: the preferred language's first gloss, else the first of all; null where no sense has a gloss."""
    full = F.filter(senses, lambda s: ~_blank(s["gloss"]))
    label = F.coalesce(first_gloss(senses, prefer), F.try_element_at(full, F.lit(1))["gloss"])
    return F.when(F.size(full) > 0, F.struct(label.alias("label"), F.transform(full, lambda s: s["gloss"]).alias("glosses")))


def substrings(rows: DataFrame, keys: list[str], surface: str, longest: int = 12, surface_limit: int = 32) -> DataFrame:
    """keys, start (from 1), piece: every substring of up to `longest` characters of surfaces of up to `surface_limit`."""
    some = rows.where(F.length(surface).between(1, surface_limit))
    starts = some.select(*keys, F.col(surface).alias("_s"), F.explode(F.sequence(F.lit(1), F.length(surface))).alias("start"))
    sized = starts.select(*keys, "_s", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("_s") - F.col("start") + 1))).alias("_n"))
    return sized.select(*keys, "start", F.substring(F.col("_s"), F.col("start"), F.col("_n")).alias("piece"))


def batch_problems(decisions: DataFrame, queue: DataFrame, key: str, path: str, flag: str, size: int) -> DataFrame:
    """key, problem of a batch's decisions against its queue: scope (not queued), path (another than queued), flag (set, must not be), repeated; and one row with a null key for a wrong size."""
    q = queue.select(key, F.col(path).alias("_path"))
    joined = decisions.join(q, key, "left").withColumn("_many", F.count("*").over(W.partitionBy(key)))
    found = F.array_compact(F.array(F.when(F.col("_path").isNull(), "scope"), F.when(F.col("_path") != F.col(path), "path"), F.when(F.coalesce(F.col(flag), F.lit(True)), "flag"), F.when(F.col("_many") > 1, "repeated")))
    rows = joined.select(key, F.explode(found).alias("problem")).distinct()
    wrong = decisions.agg(F.count("*").alias("n")).where(F.col("n") != size).select(F.lit(None).cast(dict(decisions.dtypes)[key]).alias(key), F.lit("size").alias("problem"))
    return rows.unionByName(wrong)


def missing_fields(rows: DataFrame, key: str, kind: str, required: dict[str, list[str]]) -> DataFrame:
    """key, problem: the fields that a row of its kind must have and lacks, or `kind` where the kind is unknown."""
    out = F.array(F.lit("kind"))
    for name, fields in sorted(required.items()):
        empty = lambda f: (F.size(f) <= 0) if dict(rows.dtypes)[f].startswith("array") else _blank(F.col(f))
        out = F.when(F.col(kind) == name, F.array_compact(F.array(*[F.when(F.coalesce(empty(f), F.lit(True)), f) for f in fields]))).otherwise(out)
    return rows.select(key, F.explode(out).alias("problem"))


def expand_proposals(approved: DataFrame, records: DataFrame, key: str, surfaces: str) -> DataFrame:
    """key, surface of approved records: surfaces that more than one record owns are left out (owners are counted over all records)."""
    owned = records.select(key, F.explode(surfaces).alias("surface")).distinct()
    single = owned.groupBy("surface").agg(F.min(key).alias(key), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return single.join(approved.select(key).distinct(), key, "left_semi").select(key, "surface")


def apply_batch(queue: DataFrame, decisions: DataFrame, key: str, batch: Column) -> DataFrame:
    """The queue with the status that a decision of the batch gives; rows outside the batch, or without a decision, keep theirs."""
    d = decisions.select(key, F.col("decision").alias("_decision"))
    status = F.when(batch & F.col("_decision").isNotNull(), F.when(F.col("_decision") == "accept", "approved").when(F.col("_decision") == "reject", "rejected").otherwise("deferred")).otherwise(F.col("status"))
    return queue.join(d, key, "left").withColumn("status", status).drop("_decision")


def overlay(records: DataFrame, entries: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Records with what the source's entries say of them, and records whose entry is missing (must be none)."""
    return records.join(entries, key), records.join(entries, key, "left_anti")


def reading_index(mappings: DataFrame, reading: str, ident: str) -> DataFrame:
    """reading (kana folded), entries: sorted (id, restricted_to, no_kanji), each once."""
    folded = F.translate(F.col(reading), KATAKANA, HIRAGANA)
    entry = F.struct(F.col(ident).alias("id"), F.array_sort("restricted_to").alias("restricted_to"), F.col("no_kanji"))
    return mappings.groupBy(folded.alias("reading")).agg(F.array_sort(F.collect_set(entry)).alias("entries"))


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """kind, n: effective counts, zero for empty tables."""
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n") for name, t in tables.items()])


def append(system: DataFrame, user: DataFrame) -> DataFrame:
    """System rules and user rules, one after the other, with their origin."""
    return system.withColumn("origin", F.lit("system")).unionByName(user.withColumn("origin", F.lit("user")))


def override_by_key(system: DataFrame, user: DataFrame, key: str) -> DataFrame:
    """System rows but those that a user row replaces, and all user rows."""
    return append(system.join(user, key, "left_anti"), user)


def synonym_union(*tables: DataFrame) -> DataFrame:
    """canonical, surfaces in order (of the table, then of the list), each once; exact only where no table says otherwise. Tables: canonical, surfaces, exact_only."""
    rows = reduce(DataFrame.unionByName, [t.withColumn("_t", F.lit(i)) for i, t in enumerate(tables)])
    listed = F.array_sort(F.collect_list(F.struct("_t", "surfaces")))
    return rows.groupBy("canonical").agg(F.array_distinct(F.flatten(F.transform(listed, lambda x: x["surfaces"]))).alias("surfaces"), F.bool_or("exact_only").alias("exact_only"))


def intent_markers(rows: DataFrame, key: str, text: str, markers: dict[str, list[str]]) -> DataFrame:
    """key, intent, marker: of each intent the first of its markers, in their order, that the text has."""
    out = []
    for intent, some in markers.items():
        hit = F.filter(F.array(*[F.lit(m) for m in some]), lambda m: F.contains(F.col(text), m))
        out.append(F.struct(F.lit(intent).alias("intent"), F.try_element_at(hit, F.lit(1)).alias("marker")))
    return rows.select(key, F.explode(F.array(*out)).alias("m")).select(key, "m.*").where("marker is not null")


def examples_to_cases(rows: DataFrame, key: str, positive: str, negative: str, default: Column) -> DataFrame:
    """key, kind, text: a case for each review example; a row without positive ones gets the default."""
    none = F.array().cast("array<string>")
    p, n = F.coalesce(positive, none), F.coalesce(negative, none)
    cases = F.concat(F.transform(F.when(F.size(p) > 0, p).otherwise(F.array(default)), lambda x: F.struct(F.lit("positive").alias("kind"), x.alias("text"))), F.transform(n, lambda x: F.struct(F.lit("negative").alias("kind"), x.alias("text"))))
    return rows.select(key, F.explode(cases).alias("c")).select(key, "c.kind", "c.text")


def lexical_only(records: DataFrame, blanked: list[str]) -> DataFrame:
    """Records without their semantic fields, approved: what may be published whatever the review of meanings says."""
    kinds = dict(records.dtypes)
    return records.select(*[F.lit(None).cast(kinds[c]).alias(c) if c in blanked and not kinds[c].startswith("array") else F.array().cast(kinds[c]).alias(c) if c in blanked else F.lit("approved").alias(c) if c == "review_status" else F.col(c) for c in records.columns])


def normalise_context(records: DataFrame, ident: str, meaning: str) -> DataFrame:
    """Adds origin (placeholder for a blank meaning, else source), evidence_id and promotion (false, always)."""
    origin = F.when(_blank(F.col(meaning)), "placeholder").otherwise("source")
    return records.withColumn("origin", origin).withColumn("evidence_id", F.concat(F.lit("ev-"), F.col(ident).cast("string"), F.lit("-"), origin)).withColumn("promotion", F.lit(False))


def record_hashes(records: DataFrame, ident: str) -> DataFrame:
    """ident, digest: SHA-256 over a record's columns in order of their names, nulls as a sign of their own."""
    line = F.concat_ws("\x1f", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("\x00"))) for c in sorted(records.columns)])
    return records.select(ident, F.sha2(line, 256).alias("digest"))


def repeated_values(records: DataFrame, ident: str, lists: list[str]) -> DataFrame:
    """ident, field, extra: how many values of a list field repeat others."""
    each = F.array(*[F.struct(F.lit(c).alias("field"), (F.size(c) - F.size(F.array_distinct(c))).alias("extra")) for c in lists])
    return records.select(ident, F.explode(each).alias("x")).select(ident, "x.*").where("extra > 0")


def minimal(records: DataFrame, columns: list[str], source: list[str]) -> DataFrame:
    """The columns of a shard, and where the record is from as one struct."""
    return records.select(*columns, F.struct(*source).alias("source"))


def parse_records(lines: DataFrame, column: str, schema: str, versions: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records of JSON lines whose schema_version is known, and the lines that are not: (line, problem)."""
    parsed = lines.select(F.col(column).alias("line"), F.from_json(F.col(column), schema + ", schema_version string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    problem = F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "malformed").when(~F.coalesce(F.col("r.schema_version").isin(*versions), F.lit(False)), "schema_version")
    checked = parsed.withColumn("problem", problem)
    return checked.where("problem is null").select("r.*").drop("_bad"), checked.where("problem is not null").select("line", "problem")


def wiki_readings(title: Column, body: Column) -> Column:
    """Readings of a wiki entry: the values of its reading templates, and the title where it is kana alone; in order, each once."""
    found = F.concat(*[F.regexp_extract_all(body, F.lit(p), F.lit(1)) for p in (r"\{\{ja-pron\|([ぁ-んァ-ヶー]+)", r"\{\{ふりがな\|[^|{}]*\|([ぁ-んァ-ヶー]+)", r"\(([ぁ-んァ-ヶー]+)\)")])
    own = F.when(title.rlike("^[ぁ-んァ-ヶー]+$"), F.array(title)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(own, F.coalesce(found, F.array().cast("array<string>"))))


def claim_target(claim: Column) -> Column:
    """What a JSON claim points to: the id of its value, the value itself where it is plain, else its own id."""
    at = lambda path: F.get_json_object(claim, path)
    plain = F.when(~at("$.value").startswith("{"), at("$.value"))
    return F.coalesce(at("$.value.id"), plain, at("$.id"))


def bundle_problems(rows: DataFrame, key: str, version: str, versions: list[str], status: str, statuses: list[str]) -> DataFrame:
    """key, problem of a proposal bundle: version, repeated id, status outside the closed set."""
    many = F.count("*").over(W.partitionBy(key))
    found = F.array_compact(F.array(F.when(~F.coalesce(F.col(version).isin(*versions), F.lit(False)), "version"), F.when(F.col("_many") > 1, "repeated"), F.when(~F.coalesce(F.col(status).isin(*statuses), F.lit(False)), "status")))
    return rows.withColumn("_many", many).select(key, F.explode(found).alias("problem"))


def surface_sets(**tables: Column | tuple[DataFrame, str]) -> DataFrame:
    """kind, surface: distinct surfaces of each table that already exists."""
    return reduce(DataFrame.unionByName, [t.select(F.lit(kind).alias("kind"), F.col(column).alias("surface")).where("surface is not null").distinct() for kind, (t, column) in tables.items()])


def decision_problems(decisions: DataFrame, key: str, closed: list[str], needs_notes: list[str]) -> DataFrame:
    """key, problem: repeated, status (not of the closed set), notes (missing where the decision needs them)."""
    found = F.array_compact(F.array(F.when(F.col("_many") > 1, "repeated"), F.when(~F.coalesce(F.col("decision").isin(*closed), F.lit(False)), "status"), F.when(F.col("decision").isin(*needs_notes) & _blank(F.col("notes")), "notes")))
    return decisions.withColumn("_many", F.count("*").over(W.partitionBy(key))).select(key, F.explode(found).alias("problem"))


def semantic_target(explicit: Column, kind: Column, allowed: list[str], derived: dict[str, str]) -> Column:
    """(target, problem): the explicit target where it is allowed (else the problem `target`), without one what the kind stands for."""
    from_kind = F.lit("lexical")
    for name, target in derived.items():
        from_kind = F.when(kind == name, target).otherwise(from_kind)
    known = explicit.isin(*allowed)
    return F.struct(F.when(_blank(explicit), from_kind).when(known, explicit).alias("target"), F.when(~_blank(explicit) & ~known, "target").alias("problem"))


def phrase_control_problems(entries: DataFrame, disabled: DataFrame, replaced: DataFrame) -> DataFrame:
    """expression, problem: duplicate (of several files, and no replacement is declared), and disables or replacements of nothing. All: expression; entries: file, too."""
    twice = entries.groupBy("expression").agg(F.count_distinct("file").alias("_n")).where("_n > 1").select("expression").join(replaced, "expression", "left_anti").withColumn("problem", F.lit("duplicate"))
    known = entries.select("expression").distinct()
    nothing = lambda t, name: t.select("expression").distinct().join(known, "expression", "left_anti").withColumn("problem", F.lit(name))
    return twice.unionByName(nothing(disabled, "disable")).unionByName(nothing(replaced, "replacement"))


def targets(records: DataFrame, dataset: str, source_id: str) -> tuple[DataFrame, DataFrame]:
    """Records of one dataset by source id, and source ids that more than one has."""
    some = records.where(F.col("dataset") == dataset)
    return some, some.groupBy(source_id).agg(F.count("*").alias("n")).where("n > 1")


def found_in_source(wanted: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many are wanted, and how many of them the source has (a semi join: the source is read once, whatever its size)."""
    have = wanted.join(source.select(*keys), keys, "left_semi")
    return wanted.agg(F.count("*").alias("wanted")).crossJoin(F.broadcast(have.agg(F.count("*").alias("found"))))  # one row by one row


def contract_cases(profiles: DataFrame, key: str, examples: str) -> DataFrame:
    """case_id, key, text, expected: a check for each example of a profile (examples: array of (text, expected))."""
    each = profiles.select(key, F.posexplode(examples).alias("_i", "e"))
    return each.select(F.concat(F.col(key).cast("string"), F.lit("#"), (F.col("_i") + 1).cast("string")).alias("case_id"), key, "e.text", "e.expected")


def merge_base(records: DataFrame, keys: list[str], lists: list[str], most: int | None = None) -> DataFrame:
    """One record for equal keys (dataset, source id, lemma): lists joined without repeats (sorted), the smallest record_id, how many were merged; the first `most` by record_id where a maximum is asked for."""
    merged = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(c, F.array().cast("array<string>")))))).alias(c) for c in lists]
    out = records.groupBy(*keys).agg(F.min("record_id").alias("record_id"), *merged, F.count("*").alias("merged"))
    return out if most is None else out.orderBy("record_id").limit(most)


def category_flags(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, flags: names of the category rules that hold, in the order of the rules; nulls hold nothing."""
    return rows.select(key, F.array_compact(F.array(*[F.when(F.coalesce(hit, F.lit(False)), name) for name, hit in rules.items()])).alias("flags"))


def provenance(records: DataFrame, ident: str, fields: dict[str, list[str]]) -> DataFrame:
    """ident and each field from the first of its sources that is neither null nor blank."""
    return records.select(ident, *[F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in sources]).alias(name) for name, sources in fields.items()])


def strict_bucket(bucket: Column, private: Column | None = None) -> Column:
    """A license bucket as it is, `blocked` where the row is private; an unknown license is an error, not a bucket."""
    known = F.when(bucket == "unknown", F.raise_error(F.lit("a license that no bucket knows"))).otherwise(bucket)
    return known if private is None else F.when(private, "blocked").otherwise(known)
