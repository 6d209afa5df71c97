"""Operators on small relations whose results are known by hand."""

import gzip
import json
import threading

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import features, graph, lexicon, match, rank, review, segment
from tessera.sources import readers, writers


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_text_functions(spark):
    assert one(spark, " a \t b\n", X.collapse) == "a b"
    assert one(spark, "A-b c!", X.compact_punctuation) == "abc"
    assert one(spark, "mail me@x.org password: hunter2 4111 1111 1111 1111", X.mask_sensitive) == "mail [EMAIL] password=[SECRET] [NUMBER]"
    assert one(spark, "カキクケコ", X.fold_kana) == "かきくけこ"
    assert one(spark, "ﬁ①", X.nfkc) == "fi1"
    assert one(spark, "1.2.9", X.semver_bump) == "1.2.10"
    assert one(spark, "http://intranet.x/", X.is_public_url) is False
    assert one(spark, None, X.collapse) is None
    assert [tuple(s) for s in one(spark, "ab ab", lambda x: X.spans(x, "b"))] == [(1, 2, "b"), (4, 5, "b")]
    assert one(spark, "", lambda x: X.spans(x, "b")) == []


def test_clauses_have_offsets(spark):
    text = "One. Two two!\n\n Three"
    rows = segment.clauses(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")).orderBy("clause_no").collect()
    assert [r.clause for r in rows] == ["One.", "Two two!", "Three"]
    assert all(text[r.start : r.end] == r.clause for r in rows)


def test_nested_quotes(spark):
    rows = segment.nested_quotes(spark.createDataFrame([(1, "「a『b』」)"), (2, None)], "doc_id int, text string")).collect()
    assert [(r.start, r.end, r.depth) for r in rows] == [(0, 6, 0), (2, 5, 1)]


def test_japanese_rules(spark):
    rules = spark.createDataFrame([("J1", "prohibition", None, "(.+)しないでください", 10, True), ("J2", "action", None, "(.+)して", 5, False)], "rule_id string, intent string, cover string, pattern string, priority int, enabled boolean")
    clauses = segment.clauses(spark.createDataFrame([(1, "削除しないでください。保存して。")], "doc_id int, text string").withColumn("text", F.translate("text", "。", ".")))
    found = match.captures(match.match_rules(clauses, rules), rules).collect()
    assert [(r.rule_id, r.value) for r in found] == [("J1", "削除")]


def test_phrase_policy(spark):
    phrases = spark.createDataFrame([("e", "bank", ["river"], "required_any", "d"), ("f", "bank", ["money"], "forbidden_any", "d")], "expression string, surface string, cues array<string>, policy string, domain string")
    clauses = segment.clauses(spark.createDataFrame([(1, "The bank of the river"), (2, "Money in the bank")], "doc_id int, text string"))
    got = {(r.doc_id, r.expression): r.status for r in match.phrase_hits(clauses, phrases).collect()}
    assert got == {(1, "e"): "RESOLVED", (1, "f"): "RESOLVED", (2, "e"): "INSUFFICIENT", (2, "f"): "UNSUPPORTED"}


def test_margin_keeps_ties_open(spark):
    scored = spark.createDataFrame([(1, "a", 9), (1, "b", 9), (2, "a", 9), (2, "b", 1), (3, "a", 2)], "k int, id string, score int")
    got = {r.k: r.status for r in rank.top_with_margin(scored, ["k"], "id", 6, 3).collect()}
    assert got == {1: "AMBIGUOUS", 2: "RESOLVED", 3: "INSUFFICIENT"}


def test_greedy_longest(spark):
    items = spark.createDataFrame([(1, 0, 3), (1, 2, 8), (1, 7, 9), (1, 8, 10)], "k int, start int, end int")
    assert sorted((r.start, r.end) for r in rank.longest_match(items, ["k"]).collect()) == [(2, 8), (8, 10)]


def test_ellipsis_feeds_itself(spark):
    turns = spark.createDataFrame([(1, 0, "disk"), (1, 1, None), (1, 2, None), (2, 0, None)], "conv_id int, turn int, target string")
    got = {(r.conv_id, r.turn): (r.resolved, r.status) for r in rank.ellipsis_recurrence(turns).collect()}
    assert got[(1, 2)] == ("disk", "INFERRED") and got[(2, 0)] == (None, "INSUFFICIENT")


def test_levels_of_empty_graph(spark):
    none = spark.createDataFrame([], "g int, node string")
    assert graph.levels(none, spark.createDataFrame([], "g int, src string, dst string"), "g").count() == 0


def test_merge_and_index(spark):
    rows = [("2", "a", ["x"], ["r"], [], [], "d1", "l", "approved"), ("1", "a", ["y", "x"], ["r"], ["n"], [], "d2", "l", "approved")]
    records = spark.createDataFrame(rows, readers.LEXICON)
    m = lexicon.merge_duplicates(records).first()
    assert (m.record_id, m.surfaces, m.datasets, m.merged) == ("1", ["x", "y"], ["d1", "d2"], 2)
    assert {r.key: r.ids for r in lexicon.inverted_index(records, "surfaces").collect()} == {"x": ["1", "2"], "y": ["1"]}


def test_coverage(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert tuple(review.coverage(a, b, "k").first()) == (1, 1, 1)


def test_lexicon_scan(spark, tmp_path):
    (tmp_path / "a").mkdir()
    good = {"record_id": "1", "lemma": "a", "review_status": "approved"}
    with gzip.open(tmp_path / "a" / "x.json.gz", "wt") as f:
        f.write("\n".join([json.dumps(good), json.dumps(good | {"record_id": "2", "lemma": " "}), "{broken", json.dumps(good | {"record_id": "3", "review_status": "pending"})]))
    records, bad = readers.lexicon(spark, str(tmp_path))
    assert [r.record_id for r in records.collect()] == ["1"]
    assert sorted(r.problem for r in bad.collect()) == ["malformed", "no lemma", "not approved"]


def test_xml_readings(spark, tmp_path):
    (tmp_path / "d.xml").write_text("<D><entry><ent_seq>7</ent_seq><k_ele><keb>橋</keb></k_ele><r_ele><reb>はし</reb><re_restr>橋</re_restr></r_ele><r_ele><reb>きょう</reb><re_nokanji/></r_ele><sense><pos>n</pos><gloss>bridge</gloss></sense></entry></D>")
    r = readers.dictionary_xml(spark, str(tmp_path / "d.xml")).first()
    assert (r.lemma, r.surfaces, r.pos, r.glosses) == ("橋", ["橋"], ["n"], ["bridge"])
    assert [(m.reading, m.restricted_to, m.no_kanji) for m in r.reading_mappings][0] == ("はし", ["橋"], False)


def test_csv_drops_short_rows(spark, tmp_path):
    (tmp_path / "m.csv").write_text("1,1,5,走る,走る,動詞,一般,*,*,*,*,ハシル,走る\n1,1,5,x\n")
    rows = readers.morphology_csv(spark, str(tmp_path / "m.csv")).collect()
    assert [(r.surface, r.pos, r.reading) for r in rows] == [("走る", ["動詞", "一般"], "ハシル")]


def test_wiki_section(spark, tmp_path):
    (tmp_path / "w.xml").write_text("<M><page><title>t</title><revision><id>3</id><text>==Japanese==\n# a [[link|word]] {{x}}\n#: no\n==Other==\n# z</text></revision></page><page><title>u</title><revision><id>4</id><text>==Other==\n# z</text></revision></page></M>")
    rows = readers.wiki_pages(spark, str(tmp_path / "w.xml"), "Japanese").collect()
    assert [(r.title, r.glosses) for r in rows] == [("t", ["a word"])]


def test_phrase_overrides(spark, tmp_path):
    for name, doc in {"01.json": {"entries": [{"expression": "a", "interpretation": "old"}, {"expression": "b", "interpretation": "b"}]}, "99.json": {"entries": [{"expression": "a", "interpretation": "new"}], "disabled": ["b"]}}.items():
        (tmp_path / name).write_text(json.dumps(doc))
    assert [(r.expression, r.interpretation) for r in readers.phrase_sets(spark, str(tmp_path)).collect()] == [("a", "new")]


def test_promote_swaps(spark, tmp_path):
    a, b = spark.range(3), spark.range(5)
    target, staging = f"file://{tmp_path}/t", f"file://{tmp_path}/s"
    assert writers.promote(a, staging, target) == 3 and not (tmp_path / "t").exists()
    writers.promote(a, staging, target, dry_run=False)
    writers.promote(b, staging, target, dry_run=False)
    assert spark.read.parquet(target).count() == 5 and not (tmp_path / "t.old").exists()


def test_log_is_masked(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    writers.masked_log(spark.createDataFrame([("to a@b.org", "FAILED")], "text string, status string"), path)
    assert [r.text for r in readers.unresolved_log(spark, path).collect()] == ["to [EMAIL]"]


def test_content_digest_ignores_files(spark):
    df = spark.range(1000).withColumn("v", F.col("id") * 2)
    assert writers.content_digest(df, "id").first() == writers.content_digest(df.repartition(7), "id").first()
    with pytest.raises(AssertionError):
        assert writers.content_digest(df, "id").first() == writers.content_digest(df.where("id > 0"), "id").first()


def pack_rows(tokens, packs, cap):
    """(keys, tier, record_id, total) by hand."""
    rows = []
    for k in {t[0] for t in tokens}:
        own = [t for t in tokens if t[0] == k]
        tiers = [{p[2] for t in own for p in packs if p[0] is not None and p[0] in t[1:3]}, {p[2] for t in own for p in packs if p[1] is not None and p[1] == t[3]}]
        tier = 0 if tiers[0] else 1
        rows += [(k, tier, r, len(tiers[tier])) for r in sorted(tiers[tier], key=lambda r: (r is not None, r))[:cap]]
    return sorted(rows, key=repr)


def test_pack_lookup_unites_the_lists_of_a_token(spark):
    tokens = [(1, "A", "a", "x"), (2, "A", "A", "x"), (3, "q", None, "x"), (4, "q", "r", "z"), (5, "a", "b", None), (6, "a", "q", "x"), (6, "b", "q", "y")]
    packs = [("A", "x", 5), ("A", "x", 5), ("a", "y", 5), ("a", None, 1), ("a", "x", None), ("b", "x", 1), ("b", "x", 9), (None, "y", 7), ("A", "y", 2)]
    t, p = spark.createDataFrame(tokens, "id int, surface string, normalized string, reading string"), spark.createDataFrame(packs, "key string, reading string, record_id int")
    for cap in (1, 2, 32):
        assert sorted(map(tuple, match.pack_lookup(t, p, ["id"], cap).collect()), key=repr) == pack_rows(tokens, packs, cap)


def test_pack_lookup_does_not_pair_tokens_with_all_records_of_a_key(spark):
    n = 20_000
    t = spark.range(n).select("id", F.lit("A").alias("surface"), F.lit("a").alias("normalized"), F.lit("x").alias("reading"))
    p = spark.range(n).select(F.when(F.col("id") % 2 == 0, "A").otherwise("a").alias("key"), F.lit("x").alias("reading"), F.col("id").alias("record_id"))
    spark.sparkContext.setJobGroup("pack_lookup", "pairs", interruptOnCancel=True)
    late = threading.Timer(90, lambda: spark.sparkContext.cancelJobGroup("pack_lookup"))
    late.start()
    try:
        got = match.pack_lookup(t, p, ["id"]).agg(F.count("*").alias("rows"), F.min("total").alias("least"), F.max("total").alias("most"), F.max("record_id").alias("last"), F.max("tier").alias("tier")).first()
    finally:
        late.cancel()
        spark.sparkContext._jsc.sc().clearJobGroup()
    assert tuple(got) == (32 * n, n, n, 31, 0)


def test_token_runs_by_hand(spark):
    tokens = [(1, 0, 2, True), (1, 2, 4, False), (1, 4, 6, True), (1, 7, 9, True), (2, 0, 2, True), (2, 1, 3, True), (2, 3, 3, False)]
    matches = [(1, 0, 2), (1, 0, 4), (1, 0, 4), (1, 1, 4), (1, 4, 6), (1, 4, 9), (1, 7, 8), (1, 9, 7), (2, 0, 2), (2, 0, 3), (3, 0, 2), (None, 0, 2)]
    t, m = spark.createDataFrame(tokens, "k int, start int, end int, good boolean"), spark.createDataFrame(matches, "k int, start int, end int")
    assert sorted(map(tuple, features.token_runs(m, t, ["k"]).collect())) == [(1, 0, 2), (1, 0, 4), (1, 0, 4), (1, 4, 6), (2, 0, 2)]
    assert sorted(map(tuple, features.token_runs(m, t, ["k"], F.col("good")).collect())) == [(1, 0, 2), (1, 4, 6), (2, 0, 2)]


def test_token_runs_broadcasts_no_tokens(spark, tmp_path):
    spark.createDataFrame([(1, "the then"), (2, "on")], "k int, text string").write.parquet(f"{tmp_path}/texts")
    texts = spark.read.parquet(f"{tmp_path}/texts")
    words = lambda pattern: texts.select("k", F.explode(X.spans(F.col("text"), pattern)).alias("t")).select("k", "t.start", "t.end")
    got = features.token_runs(words("then|on"), words("[a-z]{2}"), ["k"])
    assert sorted(map(tuple, got.collect())) == [(1, 4, 8), (2, 0, 2)]
    assert "Broadcast" not in got._jdf.queryExecution().toString()
