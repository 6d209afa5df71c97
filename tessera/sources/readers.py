"""Scans of dictionary sources. Compressed files (.gz, .bz2) are read by suffix; malformed rows are reported, not lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEXICON = "record_id string, lemma string, surfaces array<string>, readings array<string>, pos array<string>, domains array<string>, dataset string, license string, review_status string"
XML_ENTRY = """ent_seq long, k_ele array<struct<keb:string>>, r_ele array<struct<reb:string, re_restr:array<string>, re_nokanji:string>>,
  sense array<struct<pos:array<string>, field:array<string>, misc:array<string>, gloss:array<string>, xref:array<string>, ant:array<string>>>"""


def lexicon(spark: SparkSession, path: str, approved_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """Records of all .jsonl files below a path, and the rows that cannot be used: file, line text, problem."""
    raw = spark.read.schema(LEXICON + ", _bad string").option("recursiveFileLookup", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).withColumn("file", F.col("_metadata.file_path"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    twice = F.count("*").over(W.partitionBy("record_id")) > 1
    problem = F.when(F.col("_bad").isNotNull(), "malformed").when(blank("record_id"), "no id").when(blank("lemma"), "no lemma").when(twice, "repeated id")
    if approved_only:
        problem = problem.when(F.coalesce("review_status", F.lit("")) != "approved", "not approved")
    checked = raw.withColumn("problem", problem)
    return checked.where("problem is null").drop("_bad", "problem", "file"), checked.where("problem is not null").select("file", F.coalesce("_bad", "record_id").alias("row"), "problem")


def phrase_sets(spark: SparkSession, path: str) -> DataFrame:
    """Phrases of all JSON documents in a folder ({version, category, entries: [...], disabled: [...]}): the last file by name wins an expression, disabled ones go."""
    entry = "array<struct<expression:string, interpretation:string, context:array<string>, context_policy:string, domain:string, aliases:array<string>>>"
    docs = spark.read.schema(f"version string, category string, entries {entry}, disabled array<string>").option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))
    rows = docs.select("file", "category", F.explode("entries").alias("e")).select("file", "category", "e.*")
    last = rows.withColumn("_n", F.row_number().over(W.partitionBy("expression").orderBy(F.desc("file")))).where("_n = 1").drop("_n", "file")
    return last.join(docs.select(F.explode("disabled").alias("expression")).distinct(), "expression", "left_anti")


def rule_documents(spark: SparkSession, documents: list[tuple[str, dict]]) -> DataFrame:
    """Rules of parsed rule documents (name, {version, timeout_ms, intents: {intent: [{id, pattern, priority, enabled}]}}), in order of name: (rule_id, intent, pattern, priority, enabled, document). Named groups are spelled as Java has them."""
    rows = [(r["id"], intent, r["pattern"].replace("(?P<", "(?<"), int(r.get("priority", 0)), bool(r.get("enabled", True)), name) for name, d in sorted(documents, key=lambda x: x[0]) for intent, rules in d.get("intents", {}).items() for r in rules]
    return spark.createDataFrame(rows, "rule_id string, intent string, pattern string, priority int, enabled boolean, document string")


def dictionary_xml(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a multilingual dictionary in XML (entry / k_ele / r_ele / sense): lexicon columns, and reading_mappings (reading, restricted_to, no_kanji)."""
    raw = spark.read.format("xml").schema(XML_ENTRY).option("rowTag", "entry").load(path)
    kanji = F.coalesce(F.transform("k_ele", lambda k: k["keb"]), F.array().cast("array<string>"))
    readings = F.transform("r_ele", lambda r: r["reb"])
    mapping = F.transform("r_ele", lambda r: F.struct(r["reb"].alias("reading"), F.coalesce(r["re_restr"], F.array().cast("array<string>")).alias("restricted_to"), r["re_nokanji"].isNotNull().alias("no_kanji")))
    each = lambda name: F.array_distinct(F.flatten(F.transform("sense", lambda s: F.coalesce(s[name], F.array().cast("array<string>")))))
    return raw.select(
        F.concat(F.lit("x-"), F.col("ent_seq").cast("string")).alias("record_id"), F.coalesce(F.try_element_at(kanji, F.lit(1)), readings[0]).alias("lemma"),
        F.when(F.size(kanji) > 0, kanji).otherwise(readings).alias("surfaces"), F.array_distinct(readings).alias("readings"), mapping.alias("reading_mappings"), each("pos").alias("pos"), each("field").alias("domains"), each("gloss").alias("glosses"),
    )


def morphology_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a morphological dictionary without header: left, right, cost, surface, cost2, pos x 6, reading, normalized, ...; rows of fewer than twelve columns are dropped."""
    names = ["left_id", "right_id", "cost", "surface", "form", *[f"pos{i}" for i in range(1, 7)], "reading", "normalized", *[f"rest{i}" for i in range(4)]]
    raw = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(path)
    pos = F.array_except(F.array_compact(F.array(*[f"pos{i}" for i in range(1, 7)])), F.array(F.lit("*"), F.lit("")))
    return raw.where("reading is not null").select("surface", F.coalesce("normalized", "surface").alias("normalized"), "reading", pos.alias("pos"))


def lexemes_json(spark: SparkSession, path: str, language: str, lines: bool = False) -> DataFrame:
    """Lexemes of one language from a JSON array or from JSON lines: id, lemma, forms, glosses."""
    schema = "id string, type string, language string, lexicalCategory string, lemmas map<string, struct<language:string, value:string>>, forms array<struct<id:string, representations:map<string, struct<value:string>>>>, senses array<struct<id:string, glosses:map<string, struct<value:string>>>>"
    raw = spark.read.schema(schema).option("multiLine", not lines).json(path)
    firsts = lambda c, name: F.flatten(F.transform(F.coalesce(c, F.array()), lambda x: F.transform(F.map_values(x[name]), lambda v: v["value"])))
    lemma = F.transform(F.map_values("lemmas"), lambda v: v["value"])[0]
    return raw.where((F.col("type") == "lexeme") & (F.col("language") == language)).select(F.col("id").alias("record_id"), lemma.alias("lemma"), F.array_distinct(firsts(F.col("forms"), "representations")).alias("surfaces"), F.array_distinct(firsts(F.col("senses"), "glosses")).alias("glosses"), F.col("lexicalCategory").alias("category"))


def wiki_pages(spark: SparkSession, path: str, section: str) -> DataFrame:
    """Pages of a wiki dump that have a level-two section of that name: page_id, title, its glosses (lines that begin with #), cleaned of links and templates."""
    raw = spark.read.format("xml").schema("title string, revision struct<id:long, text:string>").option("rowTag", "page").load(path)
    body = F.regexp_extract(F.col("revision.text"), rf"(?s)(?:^|\n)==\s*{section}\s*==[ \t]*\n(.*?)(?:\n==[^=]|\z)", 1)
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\{\{[^{}]*\}\}", ""), r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1"), r"<[^>]*>", ""), "'{2,}", ""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"^#[^#:*]"))
    return raw.where(body != "").select(F.col("revision.id").alias("page_id"), "title", F.transform(lines, lambda x: clean(F.regexp_replace(x, "^#", ""))).alias("glosses"))


def unresolved_log(spark: SparkSession, path: str) -> DataFrame:
    """Texts of a run log whose status is not COMPLETE, once each: what is to be learnt from."""
    return spark.read.schema("text string, status string, at string").json(path).where("status in ('PARTIAL', 'FAILED') and text is not null").dropDuplicates(["text"])


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and SHA-256 of every file below a path that is not empty (the reader passes empty files over)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
