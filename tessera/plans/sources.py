"""Queries that write with the sinks and read back with the scans, in the shared folder; parts, customers and documents are what goes through."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..lineage import fresh_dir
from ..operators import lanes
from ..sources import packs, readers, writers
from . import dims
from .lexicons import _LEX, _records
from .registry import query, table


def _put(spark: SparkSession, files: dict[str, str]) -> str:
    """Small files in a new shared folder, written through Hadoop, so that any path will do."""
    root = fresh_dir(spark, "packs")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name, content in files.items():
        at = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = at.getFileSystem(conf).create(at)
        out.write(bytearray(content.encode()))
        out.close()
    return root


_DOCS = {
    "b.yaml": "version: '2'\ntimeout_ms: 80\nintents:\n  action:\n    - {id: R4, pattern: 'the (?P<x>[a-z]+)', priority: 6}\n    - {id: R5, pattern: 'off', enabled: false}\n",
    "a.yml": "version: '1'\ntimeout_ms: 50\nintents:\n  question:\n    - {id: R1, pattern: 'why'}\n  action:\n    - {id: R2, pattern: 'run', priority: 3}\n",
    "notes.txt": "not a document",
}


@query("scan_rule_documents", "SELECT * FROM (VALUES (0, 'question', 'R1', 'why', 0, TRUE, 'a.yml', '2', 80), (1, 'action', 'R2', 'run', 3, TRUE, 'a.yml', '2', 80), (2, 'action', 'R4', 'the (?<x>[a-z]+)', 6, TRUE, 'b.yaml', '2', 80), (3, 'action', 'R5', 'off', 0, FALSE, 'b.yaml', '2', 80)) t(position, intent, rule_id, pattern, priority, enabled, document, version, timeout_ms)")
def scan_rule_documents(spark: SparkSession, sf: str) -> DataFrame:
    rules, said = packs.rule_set(spark, _put(spark, _DOCS))
    return rules.withColumn("version", F.lit(said["version"])).withColumn("timeout_ms", F.lit(said["timeout_ms"]))


@query("scan_templates", "SELECT * FROM (VALUES ('T1', 'action', 'do', 'seen|done'), ('T2', 'remove', 'drop', ''), ('T3', NULL, 'wait', '')) t(template_id, intent, action, verification)")
def scan_templates(spark: SparkSession, sf: str) -> DataFrame:
    primary = _put(spark, {"t.yaml": "templates:\n  - {id: T1, intent: action, action: do, verification: [seen, done]}\n  - {id: T2, intent: remove, action: drop}\n"})
    extra = _put(spark, {"x/1.yaml": "templates:\n  - {id: T3, action: wait}\n", "x/2.yaml": "other: 1\n"})
    return packs.templates(spark, primary, extra).withColumn("verification", F.array_join("verification", "|"))


@query("scan_synonyms", "SELECT * FROM (VALUES ('red', 'crimson|ruby|scarlet'), ('big', 'large')) t(canonical, surfaces)")
def scan_synonyms(spark: SparkSession, sf: str) -> DataFrame:
    at = _put(spark, {"1.yaml": "synonyms:\n  red: [crimson, ruby]\n", "2.json": json.dumps({"synonyms": {"red": ["ruby", "scarlet"], "big": ["large"]}})})
    return packs.synonyms(spark, at).withColumn("surfaces", F.array_join("surfaces", "|"))


@query("scan_packs", "SELECT * FROM (VALUES ('a.yaml', '1', 'x'), ('b.json', '2', 'y'), ('c.yaml', '3', 'z'), ('c.yaml', '4', NULL), ('d.json', '5', 'w')) t(file, id, surface)")
def scan_packs(spark: SparkSession, sf: str) -> DataFrame:
    at = _put(spark, {"a.yaml": "records:\n  - {id: '1', surface: x}\n", "b.json": json.dumps({"entries": [{"id": "2", "surface": "y"}]}), "c.yaml": "- {id: '3', surface: z}\n- {id: '4'}\n", "d.json": json.dumps({"id": "5", "surface": "w"})})
    return packs.pack_records(spark, at, "id string, surface string")


@query("scan_context_candidates", "SELECT * FROM (VALUES (0, 'slang', '1.yaml', 'e1'), (1, 'idiom', '1.yaml', 'e2'), (1, 'idiom', '2.yaml', 'e3')) t(position, category, file, entry_id)")
def scan_context_candidates(spark: SparkSession, sf: str) -> DataFrame:
    at = _put(spark, {"idiom/1.yaml": "entry_id: e2\n", "idiom/2.yaml": "entry_id: e3\n", "idiom/index.yaml": "n: 2\n", "slang/1.yaml": "entry_id: e1\n", "other/1.yaml": "entry_id: e9\n"})
    return packs.context_candidates(spark, at, ["slang", "idiom"], "entry_id string")


@query("scan_phrase_sets", "SELECT * FROM (VALUES ('give up', 'stop', 'b'), ('run out', 'end', 'a')) t(expression, interpretation, category)")
def scan_phrase_sets(spark: SparkSession, sf: str) -> DataFrame:
    doc = lambda category, entries, disabled=(): json.dumps({"version": "1", "category": category, "entries": entries, "disabled": list(disabled)})
    at = _put(spark, {"1.json": doc("a", [{"expression": "give up", "interpretation": "yield"}, {"expression": "run out", "interpretation": "end"}, {"expression": "old one", "interpretation": "x"}]), "2.json": doc("b", [{"expression": "give up", "interpretation": "stop"}], ["old one"])})
    return readers.phrase_sets(spark, at).select("expression", "interpretation", "category")


@query("json_lines_lineage", "SELECT CAST(line AS INTEGER) AS line, id, problem FROM (VALUES (1, 'a', NULL), (3, NULL, 'malformed'), (4, 'c', NULL)) t(line, id, problem)")
def json_lines_lineage(spark: SparkSession, sf: str) -> DataFrame:
    at = _put(spark, {"x.jsonl": '{"id": "a"}\n\n{"id": \n{"id": "c"}\n'})
    return packs.json_lines(spark, at, "id string").select("line", "id", "problem")


@query("json_lines_roundtrip", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def json_lines_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    at = fresh_dir(spark, "lines")
    writers.json_lines(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), at)
    return spark.read.schema("c_custkey long, c_name string, c_mktsegment string").json(at)


@query("compressed_lines", "SELECT count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents")
def compressed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Written as gzip and as bzip2, told apart by suffix when read."""
    docs, at = table(spark, sf, "documents").select("doc_id"), fresh_dir(spark, "packed")
    docs.where("doc_id % 2 = 0").write.option("compression", "gzip").json(f"{at}/g")
    docs.where("doc_id % 2 <> 0").write.option("compression", "bzip2").json(f"{at}/b")
    return spark.read.schema("doc_id long").option("recursiveFileLookup", True).json(at).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("lexicon_scan", f"SELECT record_id, lemma FROM ({_LEX}) WHERE review_status = 'approved'")
def lexicon_scan(spark: SparkSession, sf: str) -> DataFrame:
    at = fresh_dir(spark, "lexicon")
    writers.json_lines(_records(spark, sf), f"{at}/deep/records")
    return readers.lexicon(spark, at)[0].select("record_id", "lemma")


@query("lexicon_scan_problems", f"SELECT problem, count(*) AS n FROM (SELECT CASE WHEN review_status <> 'approved' THEN 'not approved' END AS problem FROM ({_LEX})) WHERE problem IS NOT NULL GROUP BY problem")
def lexicon_scan_problems(spark: SparkSession, sf: str) -> DataFrame:
    at = fresh_dir(spark, "lexicon")
    writers.json_lines(_records(spark, sf), at)
    return readers.lexicon(spark, at)[1].groupBy("problem").agg(F.count("*").alias("n"))


@query("license_shards", "SELECT CASE WHEN p_size % 3 = 0 THEN 'permissive' WHEN p_size % 3 = 1 THEN 'attribution' ELSE 'unknown' END AS license_bucket, count(*) AS n FROM part GROUP BY ALL")
def license_shards(spark: SparkSession, sf: str) -> DataFrame:
    at = fresh_dir(spark, "shards")
    licensed = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, "The MIT License").when(F.col("p_size") % 3 == 1, "CC BY 4.0").otherwise("secret").alias("license"))
    writers.shards(licensed, at, 100)
    return spark.read.parquet(at).groupBy("license_bucket").agg(F.count("*").alias("n"))


@query("content_digests", "SELECT TRUE AS same, count(*) > 0 AS some FROM documents")
def content_digests(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of a content is the same however the rows lie, and another one for other rows."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    a, b = (writers.content_digest(x, "doc_id").select(F.col("digest").alias(n)) for x, n in ((docs, "a"), (docs.repartition(7, "lang"), "b")))
    c = writers.content_digest(docs.where("doc_id <> 0"), "doc_id").select(F.col("digest").alias("c"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c)).select((F.col("a") == F.col("b")).alias("same"), (F.col("a") != F.col("c")).alias("some"))  # one row each


@query("masked_log", "SELECT count(*) AS n, CAST(sum(CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+') THEN 1 ELSE 0 END) AS BIGINT) AS masked, CAST(0 AS BIGINT) AS open FROM documents")
def masked_log(spark: SparkSession, sf: str) -> DataFrame:
    at = fresh_dir(spark, "log")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    for part in (docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 <> 0")):  # a log is appended to
        writers.masked_log(part, at)
    log = spark.read.schema("doc_id long, text string").json(at)
    return log.agg(F.count("*").alias("n"), F.count_if(F.contains("text", F.lit("[EMAIL]"))).alias("masked"), F.count_if(F.col("text").rlike(X.MASKS[0][0])).alias("open"))


@query("unresolved_log", "SELECT DISTINCT text FROM conversations WHERE turn % 3 <> 0")
def unresolved_log(spark: SparkSession, sf: str) -> DataFrame:
    at = fresh_dir(spark, "runs")
    status = F.element_at(F.array(F.lit("COMPLETE"), F.lit("PARTIAL"), F.lit("FAILED")), (F.col("turn") % 3 + 1).cast("int"))
    table(spark, sf, "conversations").select("text", status.alias("status"), F.lit("now").alias("at")).write.json(at)
    return readers.unresolved_log(spark, at).select("text")


@query("promotion_swap", "SELECT count(*) AS n, min(p_partkey) AS first FROM part WHERE p_size % 2 = 1")
def promotion_swap(spark: SparkSession, sf: str) -> DataFrame:
    """A first set is replaced by a second one; a dry run leaves it alone."""
    root, part = fresh_dir(spark, "promoted"), table(spark, sf, "part").select("p_partkey", "p_size")
    writers.promote(part.where("p_size % 2 = 0"), f"{root}/staging", f"{root}/live", dry_run=False)
    writers.promote(part, f"{root}/staging", f"{root}/live")
    writers.promote(part.where("p_size % 2 = 1"), f"{root}/staging", f"{root}/live", dry_run=False)
    return spark.read.parquet(f"{root}/live").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query("file_manifest", "SELECT 'a.txt' AS name, CAST(5 AS BIGINT) AS bytes, sha256('hello') AS sha256 UNION ALL SELECT 'b.txt', 3, sha256('bye')")
def file_manifest(spark: SparkSession, sf: str) -> DataFrame:
    found = readers.file_manifest(spark, _put(spark, {"a.txt": "hello", "deep/b.txt": "bye"}))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "bytes", "sha256")


@query("directory_digest", "SELECT sha256(sha256('hello') || sha256('bye')) AS digest")
def directory_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of the files in order of their paths, as one."""
    found = readers.file_manifest(spark, _put(spark, {"a.txt": "hello", "deep/b.txt": "bye"}))
    return found.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: x["sha256"]), ""), 256).alias("digest"))


@query("review_assets", "SELECT 'brands' AS name, count(DISTINCT p_brand) AS rows FROM part UNION ALL SELECT 'parts', count(*) FROM part")
def review_assets(spark: SparkSession, sf: str) -> DataFrame:
    at, part = fresh_dir(spark, "assets"), table(spark, sf, "part")
    writers.review_assets({"parts": part.select("p_partkey", "p_name"), "brands": part.select("p_brand").distinct()}, at)
    return spark.read.schema("name string, rows long").json(f"{at}/manifest")


@query("approved_index", f"SELECT key, CAST(count(DISTINCT record_id) AS INTEGER) AS n FROM (SELECT record_id, unnest(surfaces) AS key FROM ({_LEX}) WHERE review_status = 'approved') GROUP BY key")
def approved_index(spark: SparkSession, sf: str) -> DataFrame:
    at = fresh_dir(spark, "index")
    writers.approved_index(_records(spark, sf).where("review_status = 'approved'"), at)
    return spark.read.parquet(f"{at}/surfaces").select("key", F.size("ids").alias("n"))


@query("compiled_index", f"SELECT count(*) AS records, count(DISTINCT record_id) AS located, TRUE AS all_shards FROM ({_LEX}) WHERE review_status = 'approved'")
def compiled_index(spark: SparkSession, sf: str) -> DataFrame:
    """Published, loaded with its flags and count checked, read shard by shard; every id is in the locator."""
    at = fresh_dir(spark, "index")
    writers.approved_index(_records(spark, sf).where("review_status = 'approved'"), at, shards=4)
    records, locator = packs.compiled_index(spark, at), spark.read.parquet(f"{at}/locator")
    whole = packs.shard(records, [0, 1]).unionByName(packs.shard(records, [2, 3]))
    located = whole.join(locator, ["record_id", "shard"], "left_semi").agg(F.count_distinct("record_id").alias("located"))
    return records.agg(F.count("*").alias("records")).crossJoin(F.broadcast(located)).crossJoin(F.broadcast(whole.agg(F.count("*").alias("m")))).select("records", "located", (F.col("records") == F.col("m")).alias("all_shards"))  # one row each


@query("lexicon_summary", f"SELECT count(*) AS records, TRUE AS approved_only, FALSE AS executable FROM ({_LEX}) WHERE review_status = 'approved'")
def lexicon_summary(spark: SparkSession, sf: str) -> DataFrame:
    at = fresh_dir(spark, "index")
    writers.approved_index(_records(spark, sf).where("review_status = 'approved'"), at)
    return spark.read.parquet(f"{at}/manifest").select("records", "approved_only", "executable")


@query("promotion_set", "SELECT kind, CASE WHEN p_size % 2 = 0 THEN 'permissive' ELSE 'unknown' END AS license_bucket, p_brand AS dataset, count(*) AS n FROM (SELECT *, 'phrase' AS kind FROM part WHERE p_size <= 25 UNION ALL SELECT *, 'rule' FROM part WHERE p_size > 25) GROUP BY ALL")
def promotion_set(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", "p_size", F.when(F.col("p_size") % 2 == 0, "MIT License").otherwise("none").alias("license"), F.col("p_brand").alias("dataset"))
    return writers.promotion_set({"phrase": rows.where("p_size <= 25"), "rule": rows.where("p_size > 25")}, fresh_dir(spark, "set"))


_PAGE = "intro\n===Noun===\n# cat\n# tom\n====Reading====\nneko\n===Verb===\n"


@query("wiki_headings", "SELECT * FROM (VALUES ('', 'intro'), ('Noun', '# cat' || chr(10) || '# tom'), ('Reading', 'neko'), ('Verb', '')) t(heading, block)")
def wiki_headings(spark: SparkSession, sf: str) -> DataFrame:
    return dims.values(spark, [(_PAGE,)], "body string").select(F.explode(packs.headings(F.col("body"))).alias("h")).select("h.heading", "h.block")


_XML = '<d><entry><ent_seq>1</ent_seq><k_ele><keb>猫</keb></k_ele><r_ele><reb>ねこ</reb></r_ele><r_ele><reb>ネコ</reb><re_nokanji/></r_ele><sense><pos>n</pos><gloss>cat</gloss></sense></entry><entry><ent_seq>2</ent_seq><r_ele><reb>はし</reb><re_restr>橋</re_restr></r_ele><sense><gloss>bridge</gloss></sense></entry></d>'


@query("dictionary_entries", "SELECT * FROM (VALUES ('x-1', '猫', 'ねこ:|ネコ:', 'cat'), ('x-2', 'はし', 'はし:橋', 'bridge')) t(record_id, lemma, readings, glosses)")
def dictionary_entries(spark: SparkSession, sf: str) -> DataFrame:
    found = packs.first_entries(readers.dictionary_xml(spark, _put(spark, {"d.xml": _XML})), 10)
    reads = F.array_join(F.transform("reading_mappings", lambda m: F.concat(m["reading"], F.lit(":"), F.array_join(m["restricted_to"], "+"))), "|")
    return found.select("record_id", "lemma", reads.alias("readings"), F.array_join("glosses", "|").alias("glosses"))


@query("morphology_rows", "SELECT 'p' || p_partkey AS surface, upper(p_brand) AS reading, 'noun' AS pos FROM part WHERE p_size % 2 = 0")
def morphology_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of twelve columns and more are kept, shorter ones are not."""
    at = fresh_dir(spark, "csv")
    full = F.concat_ws(",", F.lit("1,1,5"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")), F.lit("f,noun,*,*,,*,*"), F.upper("p_brand"), F.lit("n"))
    table(spark, sf, "part").select(F.when(F.col("p_size") % 2 == 0, full).otherwise("1,1,5,short")).write.text(at)
    return readers.morphology_csv(spark, at).select("surface", "reading", F.array_join("pos", "|").alias("pos"))


@query("lexeme_rows", "SELECT 'L' || c_custkey AS record_id, c_name AS lemma FROM customer WHERE c_custkey % 2 = 0")
def lexeme_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Lexemes of one language, from JSON lines and from an array."""
    word = F.struct(F.concat(F.lit("L"), F.col("c_custkey").cast("string")).alias("id"), F.lit("lexeme").alias("type"), F.when(F.col("c_custkey") % 2 == 0, "Q1").otherwise("Q2").alias("language"), F.create_map(F.lit("x"), F.struct(F.lit("x").alias("language"), F.col("c_name").alias("value"))).alias("lemmas"))
    customers, at = table(spark, sf, "customer"), fresh_dir(spark, "lexemes")
    customers.where("c_custkey % 4 <> 0").select(F.to_json(word)).write.text(f"{at}/lines")
    customers.where("c_custkey % 4 = 0").agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(word)), ","), F.lit("]"))).write.text(f"{at}/array")
    both = readers.lexemes_json(spark, f"{at}/lines", "Q1", lines=True).unionByName(readers.lexemes_json(spark, f"{at}/array", "Q1"))
    return both.select("record_id", "lemma")


@query("wiki_entries", "SELECT * FROM (VALUES (7, 'neko', 'cat|tom')) t(page_id, title, glosses)")
def wiki_entries(spark: SparkSession, sf: str) -> DataFrame:
    page = lambda i, title, text: f"<page><title>{title}</title><revision><id>{i}</id><text>{text}</text></revision></page>"
    at = _put(spark, {"w.xml": "<mediawiki>" + page(7, "neko", "==Japanese==\n# [[cat]]\n# {{x}} tom\n#: not this\n==Other==\n# no") + page(8, "no", "==Other==\n# x") + "</mediawiki>"})
    return readers.wiki_pages(spark, at, "Japanese").select(F.col("page_id").cast("int").alias("page_id"), "title", F.array_join("glosses", "|").alias("glosses"))


@query("decoy_phrases", "SELECT c_custkey, CAST(1 AS BIGINT) AS hits FROM customer WHERE c_mktsegment = 'BUILDING'")
def decoy_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """One phrase that hits and many decoys that never do: the join by surface is not moved by them."""
    decoys = spark.range(5000).select(F.concat(F.lit("decoy-"), F.col("id").cast("string")).alias("surface")).unionByName(dims.values(spark, [("BUILDING",)], "surface string"))
    found = table(spark, sf, "customer").join(decoys, F.col("c_mktsegment") == F.col("surface"))
    return found.groupBy("c_custkey").agg(F.count("*").alias("hits"))


@query("candidate_projection", f"SELECT record_id, dataset, review_status = 'approved' AS usable FROM ({_LEX})")
def candidate_projection(spark: SparkSession, sf: str) -> DataFrame:
    return lanes.minimal(_records(spark, sf), ["record_id", "review_status"], ["dataset"]).select("record_id", "source.dataset", (F.col("review_status") == "approved").alias("usable"))
