"""Queries of the further lane operators: parts are records, documents the queue, labels the decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import lanes, lexicon
from . import dims
from .lexicons import _LEX, _records
from .registry import query, table


def _senses(spark: SparkSession, sf: str) -> DataFrame:
    sense = lambda lang, c: F.struct(F.lit(lang).alias("lang"), c.alias("gloss"))
    odd = F.when(F.col("p_partkey") % 5 == 0, F.lit(" ")).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", F.array(sense("en", odd), sense("de", F.when(F.col("p_partkey") % 10 != 0, F.col("p_type"))), sense("en", F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")))).alias("senses"))


_EN = "CASE WHEN p_partkey % 5 <> 0 THEN p_name WHEN p_partkey % 3 = 0 THEN p_brand END"


@query("first_gloss", f"SELECT p_partkey, {_EN} AS en, CASE WHEN p_partkey % 10 <> 0 THEN p_type END AS de, CAST(NULL AS VARCHAR) AS fr FROM part")
def first_gloss(spark: SparkSession, sf: str) -> DataFrame:
    return _senses(spark, sf).select("p_partkey", *[lanes.first_gloss(F.col("senses"), x).alias(x) for x in ("en", "de", "fr")])


@query("sense_candidates", f"SELECT p_partkey, coalesce({_EN}, CASE WHEN p_partkey % 10 <> 0 THEN p_type END) AS label, CAST((CASE WHEN p_partkey % 5 <> 0 THEN 1 ELSE 0 END) + (CASE WHEN p_partkey % 10 <> 0 THEN 1 ELSE 0 END) + (CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS glosses FROM part WHERE NOT (p_partkey % 10 = 0 AND p_partkey % 3 <> 0)")
def sense_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _senses(spark, sf).select("p_partkey", lanes.sense_candidate(F.col("senses")).alias("c")).where("c is not null").select("p_partkey", "c.label", F.size("c.glosses").alias("glosses"))


@query("substring_cases", "SELECT s_suppkey, count(*) AS pieces, count(DISTINCT piece) AS different FROM (SELECT s_suppkey, substr(s_name, st, n) AS piece FROM (SELECT s_suppkey, s_name, st, unnest(range(1, least(12, length(s_name) - st + 1) + 1)) AS n FROM (SELECT s_suppkey, s_name, unnest(range(1, length(s_name) + 1)) AS st FROM supplier WHERE length(s_name) <= 32))) GROUP BY s_suppkey")
def substring_cases(spark: SparkSession, sf: str) -> DataFrame:
    return lanes.substrings(table(spark, sf, "supplier"), ["s_suppkey"], "s_name").groupBy("s_suppkey").agg(F.count("*").alias("pieces"), F.count_distinct("piece").alias("different"))


_DECIDED = "SELECT l.doc_id, CASE WHEN l.doc_id % 9 = 0 THEN 'elsewhere' ELSE d.source END AS source, l.toxic = 1 AS flag FROM labels l LEFT JOIN documents d USING (doc_id)"


@query("batch_decision_validation", f"WITH q AS (SELECT doc_id, source AS path FROM documents WHERE lang = 'en'), b AS ({_DECIDED}), j AS (SELECT b.*, q.path, q.doc_id IS NULL AS out FROM b LEFT JOIN q USING (doc_id)) SELECT doc_id, 'scope' AS problem FROM j WHERE out UNION ALL SELECT doc_id, 'path' FROM j WHERE path <> source UNION ALL SELECT doc_id, 'flag' FROM j WHERE flag UNION ALL SELECT NULL, 'size' WHERE (SELECT count(*) FROM b) <> 100")
def batch_decision_validation(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    decided = table(spark, sf, "labels").join(docs, "doc_id", "left").select("doc_id", F.when(F.col("doc_id") % 9 == 0, "elsewhere").otherwise(F.col("source")).alias("source"), (F.col("toxic") == 1).alias("flag"))
    return lanes.batch_problems(decided, docs.where("lang = 'en'"), "doc_id", "source", "flag", 100)


@query("approval_validation", "SELECT p_partkey, unnest(CASE p_size % 4 WHEN 0 THEN CASE WHEN p_partkey % 6 = 0 THEN ['name'] ELSE []::VARCHAR[] END WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN ['examples'] ELSE []::VARCHAR[] END WHEN 2 THEN (CASE WHEN p_partkey % 6 = 0 THEN ['name'] ELSE []::VARCHAR[] END) || (CASE WHEN p_partkey % 2 = 0 THEN ['examples'] ELSE []::VARCHAR[] END) ELSE ['kind'] END) AS problem FROM part")
def approval_validation(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("rule"), F.lit("phrase"), F.lit("template"), F.lit("other")), (F.col("p_size") % 4 + 1).cast("int"))
    rows = table(spark, sf, "part").select("p_partkey", kind.alias("kind"), F.when(F.col("p_partkey") % 6 != 0, F.col("p_name")).alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.array().cast("array<string>")).otherwise(F.split("p_name", " ")).alias("examples"))
    return lanes.missing_fields(rows, "p_partkey", "kind", {"rule": ["name"], "phrase": ["examples"], "template": ["name", "examples"]})


@query("proposal_expansion", f"WITH o AS (SELECT DISTINCT record_id, s AS surface FROM (SELECT record_id, unnest(surfaces || [lemma || '/' || dataset || '/' || domains[1]]) AS s FROM ({_LEX}))) SELECT record_id, surface FROM o WHERE surface IN (SELECT surface FROM o GROUP BY surface HAVING count(*) = 1) AND record_id IN (SELECT record_id FROM ({_LEX}) WHERE review_status = 'approved')")
def proposal_expansion(spark: SparkSession, sf: str) -> DataFrame:
    records = _records(spark, sf)
    return lanes.expand_proposals(records.where("review_status = 'approved'"), records.withColumn("all", F.concat("surfaces", F.array(F.concat_ws("/", "lemma", "dataset", F.col("domains")[0])))), "record_id", "all")


@query("category_decisions", "SELECT doc_id, CASE WHEN lang = 'fr' AND quality IS NOT NULL THEN CASE WHEN quality = 1 AND toxic = 0 THEN 'approved' WHEN toxic = 1 THEN 'rejected' ELSE 'deferred' END ELSE 'pending' END AS status FROM documents LEFT JOIN labels USING (doc_id)")
def category_decisions(spark: SparkSession, sf: str) -> DataFrame:
    decided = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "accept").otherwise("later").alias("decision"))
    queue = table(spark, sf, "documents").select("doc_id", "lang", F.lit("pending").alias("status"))
    return lanes.apply_batch(queue, decided, "doc_id", F.col("lang") == "fr").select("doc_id", "status")


@query("sense_overlay", "SELECT (SELECT count(*) FROM labels JOIN documents USING (doc_id)) AS overlaid, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS missing")
def sense_overlay(spark: SparkSession, sf: str) -> DataFrame:
    both, missing = lanes.overlay(table(spark, sf, "labels"), table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return both.agg(F.count("*").alias("overlaid")).crossJoin(F.broadcast(missing.agg(F.count("*").alias("missing"))))  # one row by one row


_MAPPED = "SELECT p_brand AS reading, p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN [p_type, 'ハ'] ELSE []::VARCHAR[] END AS restricted, p_size % 3 = 0 AS no_kanji FROM part"


@query("reading_index", f"SELECT reading, CAST(count(*) AS INTEGER) AS entries, min(id) AS first_id, sha256(string_agg(id || ':' || array_to_string(list_sort(restricted), '+') || ':' || no_kanji, ',' ORDER BY id)) AS digest FROM (SELECT DISTINCT * FROM ({_MAPPED})) GROUP BY reading")
def reading_index(spark: SparkSession, sf: str) -> DataFrame:
    mapped = table(spark, sf, "part").select("p_brand", "p_partkey", F.when(F.col("p_size") % 2 == 0, F.array("p_type", F.lit("ハ"))).otherwise(F.array().cast("array<string>")).alias("restricted_to"), (F.col("p_size") % 3 == 0).alias("no_kanji"))
    listed = F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["id"].cast("string"), F.array_join(e["restricted_to"], "+"), e["no_kanji"].cast("string"))), ",")
    return lanes.reading_index(mapped, "p_brand", "p_partkey").select("reading", F.size("entries").alias("entries"), F.col("entries")[0]["id"].alias("first_id"), F.sha2(listed, 256).alias("digest"))


@query("dictionary_totals", "SELECT 'records' AS kind, count(*) AS n FROM part UNION ALL SELECT 'surfaces', count(DISTINCT s) FROM (SELECT unnest(string_split(p_name, ' ')) AS s FROM part) UNION ALL SELECT 'none', 0")
def dictionary_totals(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return lanes.totals({"records": part, "surfaces": part.select(F.explode(F.split("p_name", " "))).distinct(), "none": part.where("p_partkey is null")})


_USER = [("R01", "decision", "licensed", "(?:^| )licensed for ([a-z]+)", 95, True), ("U01", "action", "please", "(?:^| )please ([a-z]+)", 90, True)]
_USER_SQL = dims.duck(_USER, ["rule_id", "intent", "cover", "pattern", "priority", "enabled"])


@query("union_rules", f"SELECT rule_id, pattern, 'system' AS origin FROM {dims.RULES_SQL} UNION ALL SELECT rule_id, pattern, 'user' FROM {_USER_SQL}")
def union_rules(spark: SparkSession, sf: str) -> DataFrame:
    return lanes.append(dims.rules(spark), dims.values(spark, _USER, dims.RULE_COLUMNS)).select("rule_id", "pattern", "origin")


@query("union_templates", f"SELECT rule_id, pattern, 'system' AS origin FROM {dims.RULES_SQL} WHERE rule_id <> 'R01' UNION ALL SELECT rule_id, pattern, 'user' FROM {_USER_SQL}")
def union_templates(spark: SparkSession, sf: str) -> DataFrame:
    return lanes.override_by_key(dims.rules(spark), dims.values(spark, _USER, dims.RULE_COLUMNS), "rule_id").select("rule_id", "pattern", "origin")


@query("synonym_union", "SELECT p_brand AS canonical, CAST(count(DISTINCT w) AS INTEGER) AS surfaces, bool_or(e) AS exact_only FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS w, p_size = 1 AS e FROM part UNION ALL SELECT p_brand, unnest(string_split(p_type, ' ')), FALSE FROM part) GROUP BY p_brand")
def synonym_union(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_brand").alias("canonical"), F.split("p_name", " ").alias("surfaces"), (F.col("p_size") == 1).alias("exact_only"), "p_type")
    return lanes.synonym_union(part.drop("p_type"), part.select("canonical", F.split("p_type", " ").alias("surfaces"), F.lit(False).alias("exact_only"))).select("canonical", F.size("surfaces").alias("surfaces"), "exact_only")


_MARKERS = {"license": ["Apache", "MIT", "License"], "contact": ["@"], "question": ["?", "why"]}


@query("intent_markers", "SELECT * FROM (SELECT doc_id, unnest(['license', 'contact', 'question']) AS intent, unnest([CASE WHEN contains(text, 'Apache') THEN 'Apache' WHEN contains(text, 'MIT') THEN 'MIT' WHEN contains(text, 'License') THEN 'License' END, CASE WHEN contains(text, '@') THEN '@' END, CASE WHEN contains(text, '?') THEN '?' WHEN contains(text, 'why') THEN 'why' END]) AS marker FROM documents) WHERE marker IS NOT NULL")
def intent_markers(spark: SparkSession, sf: str) -> DataFrame:
    return lanes.intent_markers(table(spark, sf, "documents"), "doc_id", "text", _MARKERS)


@query("gold_from_examples", "SELECT p_partkey, 'positive' AS kind, unnest(CASE WHEN p_size % 2 = 0 THEN string_split(p_name, ' ') ELSE [p_brand || ' please'] END) AS text FROM part UNION ALL SELECT p_partkey, 'negative', p_type FROM part WHERE p_size % 3 = 0")
def gold_from_examples(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").withColumn("yes", F.when(F.col("p_size") % 2 == 0, F.split("p_name", " "))).withColumn("no", F.when(F.col("p_size") % 3 == 0, F.array("p_type")).otherwise(F.array().cast("array<string>")))
    return lanes.examples_to_cases(rows, "p_partkey", "yes", "no", F.concat("p_brand", F.lit(" please")))


@query("lexical_only", f"SELECT record_id, lemma, CAST(len(surfaces) AS INTEGER) AS surfaces, 0 AS pos, 0 AS domains, 'approved' AS review_status FROM ({_LEX})")
def lexical_only(spark: SparkSession, sf: str) -> DataFrame:
    return lanes.lexical_only(_records(spark, sf), ["pos", "domains"]).select("record_id", "lemma", F.size("surfaces").alias("surfaces"), F.size("pos").alias("pos"), F.size("domains").alias("domains"), "review_status")


_CONTEXT = "SELECT doc_id, CASE WHEN n_chars < 60 THEN ' ' ELSE source END AS meaning FROM documents"


@query("context_normalize", f"SELECT doc_id, origin, 'ev-' || doc_id || '-' || origin AS evidence_id, FALSE AS promotion FROM (SELECT doc_id, CASE WHEN trim(meaning) = '' THEN 'placeholder' ELSE 'source' END AS origin FROM ({_CONTEXT}))")
def context_normalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") < 60, " ").otherwise(F.col("source")).alias("meaning"))
    return lanes.normalise_context(rows, "doc_id", "meaning").select("doc_id", "origin", "evidence_id", "promotion")


@query("context_collection", "SELECT doc_id, sha256('doc_id=' || doc_id || chr(31) || 'lang=' || coalesce(lang, chr(0)) || chr(31) || 'source=' || coalesce(source, chr(0))) AS digest FROM documents")
def context_collection(spark: SparkSession, sf: str) -> DataFrame:
    return lanes.record_hashes(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")


@query("repeated_readings", "SELECT doc_id, 'words' AS field, CAST(len(w) - len(list_distinct(w)) AS INTEGER) AS extra FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents) WHERE len(w) > len(list_distinct(w))")
def repeated_readings(spark: SparkSession, sf: str) -> DataFrame:
    return lanes.repeated_values(table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("words")), "doc_id", ["words"])


@query("minimal_projection", f"SELECT record_id, lemma, dataset || '/' || license AS source FROM ({_LEX})")
def minimal_projection(spark: SparkSession, sf: str) -> DataFrame:
    return lanes.minimal(_records(spark, sf), ["record_id", "lemma"], ["dataset", "license"]).select("record_id", "lemma", F.concat_ws("/", "source.dataset", "source.license").alias("source"))


@query("record_parse_gate", "SELECT CASE p_partkey % 4 WHEN 0 THEN 'v1' WHEN 1 THEN 'v2' WHEN 2 THEN 'schema_version' ELSE 'malformed' END AS outcome, count(*) AS n FROM part GROUP BY ALL")
def record_parse_gate(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_partkey")
    line = F.when(n % 4 == 3, F.concat(F.lit('{"id": '), n.cast("string"))).otherwise(F.concat(F.lit('{"id": "'), n.cast("string"), F.lit('", "schema_version": "v'), (n % 4 + 1).cast("string"), F.lit('"}')))
    good, bad = lanes.parse_records(table(spark, sf, "part").select(line.alias("line")), "line", "id string", ["v1", "v2"])
    return good.groupBy(F.col("schema_version").alias("outcome")).agg(F.count("*").alias("n")).unionByName(bad.groupBy(F.col("problem").alias("outcome")).agg(F.count("*").alias("n")))


_WIKI = [("ねこ", "'''猫''' (ねこ) {{ja-pron|ねこ}}"), ("橋", "{{ふりがな|橋|はし}} (きょう)"), ("箱", "no reading"), ("カメラ", "")]


@query("wiki_readings", "SELECT * FROM (VALUES ('ねこ', 'ねこ'), ('橋', 'はし|きょう'), ('箱', ''), ('カメラ', 'カメラ')) t(title, readings)")
def wiki_readings(spark: SparkSession, sf: str) -> DataFrame:
    return dims.values(spark, _WIKI, "title string, body string").select("title", F.array_join(lanes.wiki_readings(F.col("title"), F.col("body")), "|").alias("readings"))


@query("claim_targets", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Q' || c_nationkey WHEN 1 THEN c_name ELSE 'own' || c_custkey END AS target FROM customer")
def claim_targets(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("c_custkey")
    claim = F.when(n % 3 == 0, F.concat(F.lit('{"id": "x", "value": {"id": "Q'), F.col("c_nationkey").cast("string"), F.lit('"}}'))).when(n % 3 == 1, F.concat(F.lit('{"value": "'), "c_name", F.lit('"}'))).otherwise(F.concat(F.lit('{"id": "own'), n.cast("string"), F.lit('"}')))
    return table(spark, sf, "customer").select("c_custkey", lanes.claim_target(claim).alias("target"))


@query("bundle_validation", "SELECT o_custkey, unnest(list_filter([CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'version' END, CASE WHEN n > 1 THEN 'repeated' END, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'status' END], lambda x: x IS NOT NULL)) AS problem FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)")
def bundle_validation(spark: SparkSession, sf: str) -> DataFrame:
    return lanes.bundle_problems(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH"], "o_orderstatus", ["O", "F"])


@query("surface_sets", "SELECT DISTINCT 'brand' AS kind, p_brand AS surface FROM part UNION ALL SELECT DISTINCT 'type', p_type FROM part UNION ALL SELECT DISTINCT 'segment', c_mktsegment FROM customer")
def surface_sets(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return lanes.surface_sets(brand=(part, "p_brand"), type=(part, "p_type"), segment=(table(spark, sf, "customer"), "c_mktsegment"))


@query("decision_load", "SELECT doc_id, unnest(list_filter([CASE WHEN toxic = 1 AND quality = 0 THEN 'status' END, CASE WHEN toxic = 0 AND quality = 0 AND doc_id % 2 = 0 THEN 'notes' END], lambda x: x IS NOT NULL)) AS problem FROM labels")
def decision_load(spark: SparkSession, sf: str) -> DataFrame:
    decision = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "odd").when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "accept").otherwise("defer")
    rows = table(spark, sf, "labels").select("doc_id", decision.alias("decision"), F.when(F.col("doc_id") % 2 == 1, "why").alias("notes"))
    return lanes.decision_problems(rows, "doc_id", ["accept", "reject", "defer"], ["defer"])


@query("semantic_targets", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN CASE WHEN p_size % 10 = 0 THEN NULL ELSE 'sense' END WHEN p_type LIKE '%BRASS' THEN 'domain' ELSE 'lexical' END AS target, CASE WHEN p_size % 10 = 0 THEN 'target' END AS problem FROM part")
def semantic_targets(spark: SparkSession, sf: str) -> DataFrame:
    explicit = F.when(F.col("p_size") % 10 == 0, "unheard").when(F.col("p_size") % 5 == 0, "sense").otherwise("")
    kind = F.when(F.col("p_type").endswith("BRASS"), "metal").otherwise("plain")
    return table(spark, sf, "part").select("p_partkey", lanes.semantic_target(explicit, kind, ["sense", "lexical", "domain"], {"metal": "domain"}).alias("t")).select("p_partkey", "t.*")


@query("phrase_controls", "WITH e AS (SELECT DISTINCT p_name AS expression, p_brand AS file FROM part), d AS (SELECT expression FROM e GROUP BY expression HAVING count(*) > 1) SELECT expression, 'duplicate' AS problem FROM d WHERE expression NOT IN (SELECT p_name FROM part WHERE p_size = 1) UNION ALL SELECT 'nothing', 'disable' UNION ALL SELECT 'never', 'replacement'")
def phrase_controls(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    replaced = part.where("p_size = 1").select(F.col("p_name").alias("expression")).unionByName(dims.values(spark, [("never",)], "expression string"))
    return lanes.phrase_control_problems(part.select(F.col("p_name").alias("expression"), F.col("p_brand").alias("file")), dims.values(spark, [("nothing",)], "expression string"), replaced)


@query("target_load", "SELECT p_type AS source_id, count(*) AS n FROM part WHERE p_brand = 'Brand#11' GROUP BY p_type HAVING count(*) > 1")
def target_load(spark: SparkSession, sf: str) -> DataFrame:
    return lanes.targets(table(spark, sf, "part").select(F.col("p_brand").alias("dataset"), F.col("p_type").alias("source_id")), "Brand#11", "source_id")[1]


@query("source_expectation", "SELECT problem, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN p_partkey % 100 = 1 THEN 'lemma' END, CASE WHEN p_partkey % 100 = 2 THEN 'missing' END], lambda x: x IS NOT NULL)) AS problem FROM part) GROUP BY problem")
def source_expectation(spark: SparkSession, sf: str) -> DataFrame:
    """The records are derived a second time from the raw rows by SQL, and compared: two kinds of planted faults are found, nothing else."""
    raw = table(spark, sf, "part")
    raw.createOrReplaceTempView("_raw_part")
    twin = spark.sql("SELECT concat('P', p_partkey) AS record_id, substring_index(p_name, ' ', 1) AS lemma, p_type AS dataset FROM _raw_part")
    built = _records(spark, sf).join(raw.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("record_id"), (F.col("p_partkey") % 100).alias("m")), "record_id")
    built = built.where("m <> 2").select("record_id", F.when(F.col("m") == 1, "planted").otherwise(F.col("lemma")).alias("lemma"), "dataset")
    return lexicon.fidelity(built, twin, "record_id", ["lemma", "dataset"]).groupBy("problem").agg(F.count("*").alias("n"))


@query("source_match_scan", "SELECT (SELECT count(*) FROM labels) AS wanted, (SELECT count(*) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'de')) AS found")
def source_match_scan(spark: SparkSession, sf: str) -> DataFrame:
    return lanes.found_in_source(table(spark, sf, "labels").select("doc_id"), table(spark, sf, "documents").where("lang <> 'de'"), ["doc_id"])


@query("contract_cases", "SELECT p_partkey || '#' || i AS case_id, p_partkey, w[i] AS text, p_brand AS expected FROM (SELECT p_partkey, p_brand, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT p_partkey, p_brand, string_split(p_name, ' ') AS w FROM part))")
def contract_cases(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("text"), F.col("p_brand").alias("expected"))).alias("examples"))
    return lanes.contract_cases(rows, "p_partkey", "examples")


@query("base_merge", "SELECT p_brand, p_type, min('P' || p_partkey) AS record_id, array_to_string(list_sort(list_distinct(flatten(list(string_split(p_name, ' '))))), '|') AS words, count(*) AS merged FROM part GROUP BY p_brand, p_type")
def base_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_brand", "p_type", F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("record_id"), F.split("p_name", " ").alias("words"))
    return lanes.merge_base(rows, ["p_brand", "p_type"], ["words"]).withColumn("words", F.array_join("words", "|"))


_TEN = {
    "short": "length(text) < 60", "long": "length(text) > 5000", "licensed": "contains(lower(text), 'licensed')", "contact": "contains(text, '@')", "junk": "contains(text, '%%%')", "quoted": "contains(text, '\"')",
    "lines": "contains(text, chr(10))", "question": "contains(text, '?')", "german": "lang = 'de'", "unsourced": "source IS NULL OR trim(source) = ''",
}


@query("category_flags", f"SELECT doc_id, array_to_string(list_filter([{', '.join(f'CASE WHEN {c} THEN {n!r} END' for n, c in _TEN.items())}], lambda x: x IS NOT NULL), ',') AS flags FROM documents")
def category_flags(spark: SparkSession, sf: str) -> DataFrame:
    rules = {n: F.expr(c.replace("\\", "")) for n, c in _TEN.items()}
    return lanes.category_flags(table(spark, sf, "documents"), "doc_id", rules).withColumn("flags", F.array_join("flags", ","))


@query("provenance_fields", "SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN coalesce(nullif(trim(source), ''), lang) ELSE lang END AS dataset, lang AS region, CASE WHEN n_chars % 3 = 0 THEN CAST(n_chars AS VARCHAR) END AS version FROM documents")
def provenance_fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "lang", F.lit(None).cast("string").alias("nothing"), F.when(F.col("n_chars") % 2 == 0, F.col("source")).otherwise(" ").alias("own"), F.when(F.col("n_chars") % 3 == 0, F.col("n_chars")).alias("size"))
    return lanes.provenance(rows, "doc_id", {"dataset": ["nothing", "own", "lang"], "region": ["lang"], "version": ["nothing", "size"]})


@query("promotion_buckets", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'blocked' WHEN p_size % 2 = 0 THEN 'permissive' ELSE 'attribution' END AS bucket FROM part")
def promotion_buckets(spark: SparkSession, sf: str) -> DataFrame:
    license_ = F.when(F.col("p_size") % 2 == 0, "MIT License").otherwise("CC BY 4.0")
    return table(spark, sf, "part").select("p_partkey", lanes.strict_bucket(X.license_bucket(license_), F.col("p_size") % 5 == 0).alias("bucket"))
