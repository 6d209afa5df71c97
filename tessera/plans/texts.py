"""Queries on text: scans, normalisation, masking, spans, segmentation, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import segment
from .registry import query, table

_WS = r"[ \t\n\x0B\f\r]+"


@query("scan_documents", "SELECT doc_id, lang, source, n_chars FROM documents WHERE n_chars >= 100 AND lang IN ('en', 'de')")
def scan_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("n_chars >= 100 and lang in ('en', 'de')").select("doc_id", "lang", "source", "n_chars")


@query(
    "scan_multi_source_union",
    """SELECT 'document' AS source_kind, CAST(doc_id AS VARCHAR) AS key, CAST(length(text) AS INTEGER) AS size FROM documents
    UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR), CAST(length(text) AS INTEGER) FROM benchmark
    UNION ALL SELECT 'conversation', conv_id || '/' || turn, CAST(length(text) AS INTEGER) FROM conversations""",
)
def scan_multi_source_union(spark: SparkSession, sf: str) -> DataFrame:
    def part(name: str, kind: str, key) -> DataFrame:
        return table(spark, sf, name).select(F.lit(kind).alias("source_kind"), key.alias("key"), F.length("text").alias("size"))

    docs = part("documents", "document", F.col("doc_id").cast("string"))
    return docs.unionByName(part("benchmark", "benchmark", F.col("item_id").cast("string"))).unionByName(part("conversations", "conversation", F.concat_ws("/", "conv_id", "turn")))


@query("normalize_whitespace", rf"SELECT doc_id, sha256(trim(regexp_replace(text, '{_WS}', ' ', 'g'))) AS digest FROM documents")
def normalize_whitespace(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(X.collapse(F.col("text")), 256).alias("digest"))


@query("compact_whitespace", rf"SELECT doc_id, sha256(regexp_replace(text, '{_WS}', '', 'g')) AS digest FROM documents")
def compact_whitespace(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(X.compact(F.col("text")), 256).alias("digest"))


@query("compact_key", r"SELECT c_custkey, regexp_replace(lower(c_name), '[^\p{L}\p{N}]+', '', 'g') AS key FROM customer")
def compact_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", X.compact_punctuation(F.col("c_name")).alias("key"))


@query("stable_record_id", "SELECT doc_id, 'doc-' || substr(sha256(coalesce(source, '') || '␟' || coalesce(lang, '') || '␟' || coalesce(text, '')), 1, 20) AS record_id FROM documents")
def stable_record_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.stable_id("doc", F.col("source"), F.col("lang"), F.col("text")).alias("record_id"))


@query("nfkc_normalize")
def nfkc_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(X.nfkc("text"), 256).alias("digest"))


_M = [(p, "\\1=[SECRET]" if "$1" in r else r) for p, r in X.MASKS]


@query("mask_sensitive", "SELECT doc_id, sha256({}) AS digest, CAST({} AS INTEGER) AS emails FROM documents".format(__import__("functools").reduce(lambda x, m: f"regexp_replace({x}, '{m[0]}', '{m[1]}', 'g')", _M, "text"), f"len(regexp_extract_all(text, '{X.MASKS[0][0]}'))"))
def mask_sensitive(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(X.mask_sensitive(F.col("text")), 256).alias("digest"), F.regexp_count("text", F.lit(X.MASKS[0][0])).alias("emails"))


_PROTECTED = r"`[^`]*`|https?://[^ \t\n\r)>]+"


def _duck_spans(relation: str, key: str, text: str, pattern: str) -> str:
    """DuckDB: key, pos (from 0), s, e, surface of every match."""
    return f"""SELECT {key}, pos - 1 AS pos, CAST(s AS BIGINT) AS s, CAST(s + length(surface) AS BIGINT) AS e, surface FROM (
      SELECT {key}, pos, hits[pos] AS surface, list_sum(list_transform(gaps[1:pos], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:pos - 1], lambda x: length(x))), 0) AS s
      FROM (SELECT {key}, hits, gaps, unnest(range(1, len(hits) + 1)) AS pos FROM (
        SELECT {key}, regexp_extract_all({text}, '{pattern}') AS hits, regexp_split_to_array({text}, '{pattern}') AS gaps FROM {relation})))"""


_CITED = "(SELECT page_id, 'See ' || url || ' or `page ' || page_id || '` (' || url || ')' AS text FROM pages)"


@query("protected_ranges", f"SELECT page_id, CAST(s AS INTEGER) AS \"start\", CAST(e AS INTEGER) AS \"end\", surface FROM ({_duck_spans(_CITED, 'page_id', 'text', _PROTECTED)})")
def protected_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """URLs and code, which normalisation leaves alone."""
    cited = table(spark, sf, "pages").select("page_id", F.concat(F.lit("See "), "url", F.lit(" or `page "), F.col("page_id").cast("string"), F.lit("` ("), "url", F.lit(")")).alias("text"))
    return cited.select("page_id", F.explode(X.spans(F.col("text"), _PROTECTED)).alias("p")).select("page_id", "p.start", "p.end", "p.surface")


@query(
    "strip_markup",
    rf"""SELECT page_id, sha256(t) AS digest, CAST(length(t) AS INTEGER) AS size FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>', ' ', 'g'), '(?s)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
      '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '{_WS}', ' ', 'g')) AS t FROM pages)""",
)
def strip_markup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.strip_markup(F.col("html")).alias("t")).select("page_id", F.sha2("t", 256).alias("digest"), F.length("t").alias("size"))


@query("entity_typing", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(w, '^https?://') THEN 'url' WHEN regexp_matches(w, '^[A-Za-z0-9._%+-]+@') THEN 'email' WHEN regexp_matches(w, '^[0-9]') THEN 'number' WHEN regexp_matches(w, '^[A-Z]') THEN 'name' ELSE 'unknown' END AS kind FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents)) GROUP BY kind")
def entity_typing(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("w")).groupBy(X.entity_type(F.col("w")).alias("kind")).agg(F.count("*").alias("n"))


_BUCKETS = " ".join(f"WHEN contains(lower(text), '{m}') THEN '{b}'" for b, m in X.LICENSE_BUCKETS)


@query("license_buckets", f"SELECT source, CASE {_BUCKETS} ELSE 'unknown' END AS bucket, count(*) AS n FROM documents GROUP BY ALL")
def license_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source", X.license_bucket(F.col("text")).alias("bucket")).agg(F.count("*").alias("n"))


@query("public_source", r"SELECT page_id, h <> '' AND NOT regexp_matches(h, '(^|\.)(localhost|internal|local|intranet|private)(\.|$)') AS public FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS h FROM pages)")
def public_source(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.is_public_url(F.col("url")).alias("public"))


@query("marker_containment", "SELECT doc_id, contains(lower(text), 'licensed') OR contains(lower(text), 'password') OR contains(lower(text), '@') AS marked FROM documents")
def marker_containment(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.any_marker(F.col("text"), ["Licensed", "PASSWORD", "@"]).alias("marked"))


@query("word_boundary", r"""SELECT doc_id, count(*) AS found, CAST(coalesce(sum(CASE WHEN regexp_matches(b, '[A-Za-z0-9]') OR regexp_matches(a, '[A-Za-z0-9]') THEN 0 ELSE 1 END), 0) AS BIGINT) AS bounded
    FROM (SELECT doc_id, CASE WHEN s = 0 THEN '' ELSE substr(text, s, 1) END AS b, substr(text, e + 1, 1) AS a FROM (""" + _duck_spans("documents", "doc_id, text", "text", "ing") + r""")) GROUP BY doc_id""")
def word_boundary(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "documents").select("doc_id", "text", F.explode(X.spans(F.col("text"), "ing")).alias("h"))
    ok = X.word_bounded(F.col("text"), F.col("h.start").cast("int"), F.col("h.end").cast("int"), F.col("h.surface"))
    return hits.groupBy("doc_id").agg(F.count("*").alias("found"), F.sum(ok.cast("long")).alias("bounded"))


_KANA = "(VALUES (1, 'カタカナ'), (2, 'ヴァイオリン'), (3, 'ひらがな'), (4, 'ｱmix漢字ヶ'), (5, ''))"


@query("fold_kana", f"SELECT id, translate(s, '{X.KATAKANA}', '{X.HIRAGANA}') AS folded FROM {_KANA} t(id, s)")
def fold_kana(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {_KANA} AS t(id, s)").select("id", X.fold_kana(F.col("s")).alias("folded"))


@query("semver_bump", "SELECT v, split_part(v, '.', 1) || '.' || split_part(v, '.', 2) || '.' || (CAST(split_part(v, '.', 3) AS INTEGER) + 1) AS bumped FROM (VALUES ('1.0.0'), ('2.13.9'), ('0.0.99')) t(v)")
def semver_bump(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('1.0.0'), ('2.13.9'), ('0.0.99') AS t(v)").select("v", X.semver_bump(F.col("v")).alias("bumped"))


CLAUSE_SQL = f"""SELECT doc_id, CAST(pos + 1 AS INTEGER) AS clause_no, s + length(surface) - length(ltrim(surface, ' ')) AS s0, regexp_replace(trim(surface, ' '), '[\\n]+$', '') AS clause
  FROM ({_duck_spans('documents', 'doc_id', 'text', segment.CLAUSE)})"""


@query("clause_offsets", f"SELECT doc_id, clause_no, CAST(s0 AS INTEGER) AS \"start\", CAST(s0 + length(clause) AS INTEGER) AS \"end\", sha256(clause) AS digest FROM ({CLAUSE_SQL})")
def clause_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return segment.clauses(table(spark, sf, "documents")).select("doc_id", "clause_no", "start", "end", F.sha2("clause", 256).alias("digest"))


@query("segment_clauses", f"SELECT doc_id, count(*) AS clauses, CAST(max(length(clause)) AS INTEGER) AS longest FROM ({CLAUSE_SQL}) GROUP BY doc_id")
def segment_clauses(spark: SparkSession, sf: str) -> DataFrame:
    return segment.clauses(table(spark, sf, "documents")).groupBy("doc_id").agg(F.count("*").alias("clauses"), F.max(F.length("clause")).alias("longest"))


_TOKENS = r"SELECT doc_id, t AS token FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS t FROM documents) WHERE t <> ''"


@query("tokenize_fallback", f"SELECT doc_id, count(*) AS tokens, count(DISTINCT token) AS distinct_tokens FROM ({_TOKENS}) GROUP BY doc_id")
def tokenize_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return segment.tokens(table(spark, sf, "documents")).groupBy("doc_id").agg(F.count("*").alias("tokens"), F.count_distinct("token").alias("distinct_tokens"))


@query("token_freq", f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({_TOKENS}) GROUP BY token")
def token_freq(spark: SparkSession, sf: str) -> DataFrame:
    # two levels: a token's documents are counted after the counts within each
    per = segment.tokens(table(spark, sf, "documents")).groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query("quote_ranges_flat", f"SELECT doc_id, CAST(s AS INTEGER) AS \"start\", CAST(e AS INTEGER) AS \"end\", sha256(surface) AS digest FROM ({_duck_spans('documents', 'doc_id', 'text', segment.QUOTED)})")
def quote_ranges_flat(spark: SparkSession, sf: str) -> DataFrame:
    return segment.quotes(table(spark, sf, "documents")).select("doc_id", "start", "end", F.sha2("surface", 256).alias("digest"))


@query("quote_ranges_nested")
def quote_ranges_nested(spark: SparkSession, sf: str) -> DataFrame:
    return segment.nested_quotes(table(spark, sf, "documents"))


_UTTERANCES = "(VALUES (1, 'Run it.'), (2, 'Run it now'), (3, 'Please run! Then stop.'), (4, 'run'), (5, 'overrun it'))"


@query(
    "sentence_position",
    f"""SELECT id, substr(s, p + 3, 1) IN ('', '.', '!', '?', chr(10)) AS final, trim(regexp_replace(lower(s), '[.!?]+$', '')) = 'run' AS whole FROM (SELECT id, s, CAST(instr(lower(s), 'run') AS INTEGER) AS p FROM {_UTTERANCES} t(id, s))""",
)
def sentence_position(spark: SparkSession, sf: str) -> DataFrame:
    """Sentence-final and whole-utterance tests of a match."""
    df = spark.sql(f"SELECT id, s, locate('run', lower(s)) AS p FROM {_UTTERANCES} AS t(id, s)")
    return df.select("id", segment.sentence_final(F.col("s"), F.col("p") + 2).alias("final"), (F.trim(F.regexp_replace(F.lower("s"), "[.!?]+$", "")) == "run").alias("whole"))
