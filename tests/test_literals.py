"""Automaton, covers and span maps against brute force; packs whose files or flags are wrong."""

import random
import re
import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from tessera.functions import normal
from tessera.functions import text as X
from tessera.operators import features, literals, match, meaning
from tessera.sources import packs, writers


def test_automaton_finds_all():
    r = random.Random(1)
    for _ in range(60):
        words = ["".join(r.choice("ab語") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 8))]
        text = "".join(r.choice("ab語x") for _ in range(60))
        machine = literals.Automaton([*words, ""])
        for m in (machine, literals.Automaton.restore(machine.store())):
            got = sorted((m.literals[n], s, e) for n, s, e in m.find(text))
            assert got == sorted((w, i, i + len(w)) for w in set(words) for i in range(len(text)) if text.startswith(w, i))


@pytest.mark.parametrize("change", [{"target": [1, 3]}, {"source": [0]}, {"literals": ["ab", "zz"]}, {"literals": []}, {"source": [5, 1]}])
def test_restore_refuses(change):
    stored = literals.Automaton(["ab"]).store()
    with pytest.raises(ValueError):
        literals.Automaton.restore(stored | change)


def test_covers_are_proven():
    r = random.Random(2)

    def pattern(depth=0):
        kind = r.random()
        if depth > 2 or kind < 0.45:
            return "".join(r.choice("abc") for _ in range(r.randint(1, 3)))
        if kind < 0.6:
            return f"(?:{pattern(depth + 1)}|{pattern(depth + 1)})"
        if kind < 0.75:
            return f"(?:{pattern(depth + 1)}){r.choice(['?', '*', '+', '{2}'])}"
        if kind < 0.85:
            return r.choice(["[ab]", ".", "[a-c]", "[^a]"])
        return pattern(depth + 1) + pattern(depth + 1)

    for _ in range(300):
        p = pattern() + pattern()
        cover = literals.triggers(p)
        for _ in range(40):
            text = "".join(r.choice("abc") for _ in range(r.randint(0, 12)))
            if cover and re.search(p, text):
                assert any(c in text for c in cover), (p, cover, text)


def test_gate_and_hits_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "xabx"), (2, None), (3, ""), (4, "b"), (1, "xabx")], "k long, t string")
    got = sorted(tuple(x) for x in literals.literal_hits(df, ["k"], "t", literals.Automaton(["ab", "b"])).collect())
    assert got == [(1, "ab", 1, 3), (1, "ab", 1, 3), (1, "b", 2, 3), (1, "b", 2, 3), (4, "b", 0, 1)]
    assert literals.literal_hits(df, ["k"], "t", literals.Automaton([])).count() == 0


def test_normalised_map():
    for text in ("plain", "ﬁ①", "`ﬁ` ﬁ https://x/ﬁ ﬁ", "éx", "ｶﾞｷﾞ", "", "㎏ and ½", "```ﬁ\nﬁ``` ﬁ"):
        out, starts, ends = normal.normalised(text)
        assert len(out) == len(starts) == len(ends)
        assert all(0 <= a < b <= len(text) for a, b in zip(starts, ends, strict=True)) and starts == sorted(starts)
        kept = [m.span() for m in regex.finditer(normal.PROTECTED, text)]
        for c, a, b in zip(out, starts, ends, strict=True):
            inside = any(s <= a and b <= e for s, e in kept)
            assert c in (text[a:b] if inside else unicodedata.normalize("NFKC", text[a:b]))
        if not kept:
            assert out == "".join(unicodedata.normalize("NFKC", m) for m in regex.findall(r"\X", text))


def test_long_arrays_of_spans(spark):
    text = "ab " * 1000
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(X.spans(F.col("t"), "b").alias("s")).collect()
    assert [(x.start, x.end) for x in got[0].s] == [(3 * i + 1, 3 * i + 2) for i in range(1000)]
    assert got[1].s == [] and not got[2].s


def test_covers_meet_words_of_any_case(spark):
    clauses = spark.createDataFrame([(1, 1, 0, "the API call")], "doc_id long, clause_no int, start int, clause string")
    rules = lambda c: spark.createDataFrame([("R", "i", c, "(?i)api ([a-z]+)", 1, True)], "rule_id string, intent string, cover string, pattern string, priority int, enabled boolean")
    assert [match.match_rules(clauses, rules(c), literal=n).count() for c in ("API", "api") for n in (10, 0)] == [1, 1, 1, 1]


def test_windows_and_utterances(spark):
    df = spark.createDataFrame([("One. Two here! Three", 5, 8), ("go!", 0, 2), ("", 0, 0)], "t string, s int, e int")
    got = df.select(features.context_window(F.col("t"), F.col("s"), F.col("e")).alias("w"), features.exact_utterance(F.col("t"), F.col("s"), F.col("e")).alias("x")).collect()
    assert [x.w for x in got] == [" Two here", "go", ""] and [x.x for x in got] == [False, True, True]
    clean = spark.createDataFrame([(" «and, then the red box only, too!? »",), ("and",), ("",)], "t string").select(meaning.clean_fragment(F.col("t")).alias("c")).collect()
    assert [x.c for x in clean] == ["the red box", "and", ""]


def test_index_refuses(spark, tmp_path):
    kind = "record_id string, review_status string, surfaces array<string>, readings array<string>, pos array<string>, domains array<string>"
    with pytest.raises(ValueError):
        writers.approved_index(spark.createDataFrame([("a", "pending", [], [], [], [])], kind), f"{tmp_path}/x")
    writers.approved_index(spark.createDataFrame([("a", "approved", ["s"], [], [], [])], kind), f"{tmp_path}/y")
    assert packs.compiled_index(spark, f"{tmp_path}/y").count() == 1
    manifest = spark.read.parquet(f"{tmp_path}/y/manifest").withColumn("private", F.lit(True))
    manifest.write.parquet(f"{tmp_path}/z/manifest")
    with pytest.raises(ValueError, match="private"):
        packs.compiled_index(spark, f"{tmp_path}/z")
