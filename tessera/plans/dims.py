"""Small dictionaries for the driver's tables: each as one VALUES list that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def values(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def duck(rows: list[tuple], names: list[str]) -> str:
    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, int | float):
            return str(v)
        if isinstance(v, list):
            return "[" + ", ".join(map(lit, v)) + "]" + ("" if v else "::VARCHAR[]")
        return "'" + v.replace("'", "''") + "'"

    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") t({', '.join(names)}))"


#: rule_id, intent, cover, pattern, priority, enabled. Patterns are free of lookaround, so that all engines agree, and take their cover as a whole word only, so that the probe by words loses nothing.
RULES = [
    ("R01", "decision", "licensed", "(?:^| )[Ll]icensed under (the [A-Za-z ]+|[A-Z]+[A-Z -]+)", 90, True),
    ("R02", "decision", "released", "(?:^| )[Rr]eleased under ([A-Za-z ]+)", 80, True),
    ("R03", "preserve", "that", "(?:^| )that ([a-z]+) the", 50, True),
    ("R04", "action", "the", "(?:^| )the ([a-z]+ing)", 60, True),
    ("R05", "condition", "for", "(?:^| )for ([a-z]+) and", 40, True),
    ("R06", "scope", "in", "(?:^| )in ([a-z]+), ", 30, True),
    ("R07", "reference", "this", "(?:^| )this ([a-z]+)", 20, True),
    ("R08", "reference", "this", "(?:^| )this ([a-z]+) [a-z]+", 25, True),
    ("R09", "sequence", "les", "(?:^| )les ([a-z]+) de", 45, True),
    ("R10", "question", None, "([A-Za-z]+) is[?]", 70, True),
    ("R11", "contact", None, "([A-Za-z0-9._]+)@[A-Za-z0-9-]+[.][a-z]+", 75, True),
    ("R12", "action", "the", "(?:^| )the ([a-z]+)ing", 10, False),
    ("R13", "prohibition", "not", "(?:^| )not ([a-z]+)", 85, True),
    ("R14", "action", "der", "(?:^| )der ([a-z]+en)", 55, True),
    ("R15", "action", "the", "(?:^| )the ([a-z]+ing)", 35, True),
]
RULE_COLUMNS = "rule_id string, intent string, cover string, pattern string, priority int, enabled boolean"
RULES_SQL = duck(RULES, ["rule_id", "intent", "cover", "pattern", "priority", "enabled"])

#: expression, surface, cues, policy, domain.
PHRASES = [
    ("license-grant", "licensed under", ["license", "version"], "required_any", "legal"),
    ("of-the", "of the", ["that", "this"], "required_any", "grammar"),
    ("in-the", "in the", ["not", "was"], "forbidden_any", "grammar"),
    ("to-be", "to be", [], "optional", "grammar"),
    ("de-la", "de la", ["que", "les"], "required_any", "grammar"),
    ("mit", "mit license", ["released"], "optional", "legal"),
]
PHRASE_COLUMNS = "expression string, surface string, cues array<string>, policy string, domain string"
PHRASES_SQL = duck(PHRASES, ["expression", "surface", "cues", "policy", "domain"])


def rules(spark: SparkSession) -> DataFrame:
    return values(spark, RULES, RULE_COLUMNS)


def phrases(spark: SparkSession) -> DataFrame:
    return values(spark, PHRASES, PHRASE_COLUMNS)
