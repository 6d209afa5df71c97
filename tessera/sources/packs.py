"""Scans of dictionary packs: YAML and JSON documents of many shapes, JSON lines with lineage, wiki sections, compiled indexes with their flags.

Documents are small dictionaries: they are read through Spark, so that any path that it knows will do, and parsed on the driver. What grows with a
corpus (JSON lines, shards) stays a DataFrame.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, path: str) -> list[tuple[str, Any]]:
    """(file name, parsed document) of the .yaml, .yml and .json files of a folder, in order of their names."""
    import yaml  # only these scans need it

    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{yaml,yml,json}").text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file")).collect()  # dictionaries, not corpora
    return [(r["file"], json.loads(r["value"]) if r["file"].endswith(".json") else yaml.safe_load(r["value"])) for r in sorted(files, key=lambda r: r["file"])]


def rule_set(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, Any]]:
    """Rules of all documents ({version, timeout_ms, intents: {intent: [...]}}) in order, those of one intent one after the other; the last document says version and timeout."""
    rows, said = [], {}
    for name, d in documents(spark, path):
        said |= {k: d[k] for k in ("version", "timeout_ms") if k in d}
        for intent, some in (d.get("intents") or {}).items():
            rows += [(intent, str(r["id"]), r["pattern"].replace("(?P<", "(?<"), int(r.get("priority", 0)), bool(r.get("enabled", True)), name) for r in some]
    numbered = [(i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(numbered, "position int, intent string, rule_id string, pattern string, priority int, enabled boolean, document string"), said


def fragments(spark: SparkSession, path: str | None, key: str) -> list[Any]:
    """The items that the documents of an optional folder have under a key; none where the folder is not given."""
    return [item for _, d in documents(spark, path) for item in (d.get(key) or [])] if path else []


def templates(spark: SparkSession, primary: str, extra: str | None = None) -> DataFrame:
    """Templates of the primary documents and then of the fragments: template_id, intent, action, verification."""
    items = fragments(spark, primary, "templates") + fragments(spark, extra, "templates")
    return spark.createDataFrame([(str(t["id"]), t.get("intent"), t.get("action"), list(t.get("verification") or [])) for t in items], "template_id string, intent string, action string, verification array<string>")


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """canonical, surfaces: of all documents, in order, each surface once."""
    merged: dict[str, dict[str, None]] = {}
    for _, d in documents(spark, path):
        for canonical, some in (d.get("synonyms") or {}).items():
            merged.setdefault(canonical, {}).update(dict.fromkeys(some))
    return spark.createDataFrame([(c, list(s)) for c, s in merged.items()], "canonical string, surfaces array<string>")


def pack_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of documents that are {records: [...]}, {entries: [...]}, a list, or one record, with the file they are from. schema: DDL of a record."""
    lines = []
    for name, d in documents(spark, path):
        items = d if isinstance(d, list) else d.get("records") if isinstance(d.get("records"), list) else d.get("entries") if isinstance(d.get("entries"), list) else [d]
        lines += [(name, json.dumps(x, ensure_ascii=False, default=str)) for x in items]
    return spark.createDataFrame(lines, "file string, line string").select("file", F.from_json("line", schema).alias("r")).select("file", "r.*")


def context_candidates(spark: SparkSession, path: str, order: list[str], schema: str) -> DataFrame:
    """Records of a folder of category folders, in a fixed order of categories; index files are left out."""
    rows = []
    for place, category in enumerate(order):
        for name, d in documents(spark, f"{path}/{category}"):
            if not name.startswith("index"):
                rows.append((place, category, name, json.dumps(d, ensure_ascii=False, default=str)))
    return spark.createDataFrame(rows, "position int, category string, file string, line string").select("position", "category", "file", F.from_json("line", schema).alias("r")).select("position", "category", "file", "r.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines with where they are from: file and line (from 1), and `problem` where a line is malformed. Files are read whole, as their lines are counted."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("_i", "_l"))
    parsed = files.where(F.trim("_l") != "").select("file", (F.col("_i") + 1).alias("line"), F.from_json("_l", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.select("file", "line", F.when(F.col("r._bad").isNotNull(), "malformed").alias("problem"), "r.*").drop("_bad")


#: Flags that a compiled index must carry, all of them with these values.
FLAGS = {"approved_only": True, "external_action": False, "network": False, "private": False, "executable": False}


def compiled_index(spark: SparkSession, path: str) -> DataFrame:
    """A published index (records/, manifest/): its flags and its count are checked before anything is read from it."""
    said = spark.read.parquet(f"{path}/manifest").first().asDict()
    wrong = [k for k, v in FLAGS.items() if said.get(k) is not v]
    if wrong:
        raise ValueError(f"flags of the index are not as they must be: {wrong}")
    records = spark.read.parquet(f"{path}/records")
    if records.count() != said["records"]:
        raise ValueError("the index has not as many records as its manifest says")
    return records


def shard(records: DataFrame, numbers: list[int]) -> DataFrame:
    """Some shards of an index that is partitioned by `shard`: other partitions are not read."""
    return records.where(F.col("shard").isin(*numbers))


def headings(body: Column) -> Column:
    """Array of (heading, block) of a wiki section: blocks between headings of level three and deeper, the first without a heading."""
    parts = F.split(body, r"(?m)^(?==={2,})")
    heading = lambda p: F.trim(F.regexp_extract(p, r"^={3,}\s*(.*?)\s*={3,}", 1))
    block = lambda p: F.regexp_replace(F.regexp_replace(p, r"^={3,}.*?={3,}[ \t]*\n?", ""), r"^\s+|\s+$", "")
    return F.transform(parts, lambda p: F.struct(heading(p).alias("heading"), block(p).alias("block")))


def first_entries(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """The driver loop of an importer: all entries, or as many as are asked for."""
    return entries if limit is None else entries.limit(limit)
