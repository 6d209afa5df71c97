"""The ten operators against brute force, round trips and held-out accuracy, with nulls, empties, ties, repeats and clashing columns."""

import base64
import gzip
import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, html_extract, jaccard, license_scan, sentencepiece, sharding, topk, toxicity, warc
from tessera.llm.common import fresh_dir, utf8

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def words(r, n, vocabulary=40):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# -- 8 ----------------------------------------------------------------------------------------------------------------


def brute_windows(rows, items, n=10):
    wins = []
    for item, text in set(items):
        w = ALNUM.findall(lower(text or ""))
        k = min(n, len(w))
        wins += [(str(item), w[i : i + k]) for i in range(len(w) - k + 1) if k]
    out = []
    for doc, text in rows:
        w = ALNUM.findall(lower(text or ""))
        hit, found = set(), set()
        for item, k in wins:
            for i in range(len(w) - len(k) + 1):
                if w[i : i + len(k)] == k:
                    hit |= set(range(i, i + len(k)))
                    found.add(item)
        out.append((doc, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block_words", [10**6, 12])
def test_decontaminate(spark, block_words):
    r = random.Random(3)
    items = [(i, " ".join(words(r, r.choice([1, 2, 3, 9, 10, 25])))) for i in range(8)] + [(9, None), (10, " ... "), (11, "same words here"), (12, "same words here"), (11, "same words here")]
    rows = [(i, " ".join(words(r, 30)) + " " + (r.choice(items)[1] or "") + "! SAME, words; here " * (i % 3)) for i in range(30)] + [(30, None), (31, ""), (31, ""), (None, items[0][1])]
    df = docs_of(spark, rows).withColumn("n_hit", F.lit("clash")).withColumn("_x", F.lit(1))
    found = decontaminate.decontaminate(df, spark.createDataFrame(items, "item_id int, text string"), block_words=block_words)
    got = [(x.doc_id, x.n_words, x.n_hit, x["items"]) for x in found.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_windows(rows, items)))
    assert "_x" in found.columns and all(sum(s.end - s.start for s in x.spans) == x.n_hit for x in found.collect())


def test_decontaminate_empty(spark):
    none = spark.createDataFrame([], "item_id int, text string")
    df = docs_of(spark, [(1, "a b")])
    assert decontaminate.decontaminate(df, none).select("n_words", "n_hit").collect() == [(2, 0)]
    assert decontaminate.decontaminate(df.limit(0), none).count() == 0


# -- 3 ----------------------------------------------------------------------------------------------------------------


def brute_components(rows, k=5, percent=75):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(s), None if d is None else least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("seed", range(4))
def test_jaccard(spark, seed):
    r = random.Random(seed)
    rows, ident = [], 0
    for _ in range(25):
        base = words(r, r.choice([1, 3, 4, 5, 8, 30, 120]), 3000)
        for _ in range(r.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = f"x{r.randrange(9999)}"
            rows.append((ident * 7 % 1000, r.choice([" ", "\n", " \t"]).join(copy).upper() if r.random() < 0.2 else " ".join(copy)))
            ident += 1
    rows += [(2000, None), (2001, ""), (2002, "  \n"), (None, rows[0][1]), (2003, rows[0][1]), (2003, rows[0][1])]
    frame = docs_of(spark, rows).withColumn("n", F.lit(1))
    got = [tuple(x)[:3] for x in jaccard.similarity_join(frame).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_components(rows)))
    sets = {}
    for i, text in rows:
        w = [lower(x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        g = frozenset(tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))) if w else None
        if g and i is not None:
            sets[g] = min(i, sets.get(g, i))
    want = [tuple(sorted((sets[a], sets[b]))) for a, b in combinations(sets, 2) if 100 * len(a & b) >= 75 * len(a | b)]
    assert sorted(tuple(x) for x in jaccard.similar_pairs(frame).collect()) == sorted(want)


def test_jaccard_chain_and_shared_passage(spark):
    r = random.Random(5)
    base, rows = words(r, 200, 10**6), []
    for i in range(40):  # each differs from the one before in five words: a chain of links
        base = list(base)
        for _ in range(1):
            base[(i * 5) % 200] = f"c{i}"
        rows.append((i, " ".join(base)))
    passage = " ".join(words(r, 60, 10**6))
    rows += [(100 + i, " ".join(words(r, 200, 10**6)) + " " + passage) for i in range(30)]
    got = [tuple(x)[:3] for x in jaccard.similarity_join(docs_of(spark, rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_components(rows)))


def test_jaccard_split_otherwise_between_scans(spark, tmp_path, monkeypatch):
    r = random.Random(9)
    texts = [" ".join(words(r, 40, 10**6)) for _ in range(60)]
    rows = [(i, texts[i % 60] + (f" tail{i % 7}" if i % 3 else "")) for i in range(600)]
    docs_of(spark, rows).repartition(3).write.option("parquet.block.size", 2048).parquet(str(tmp_path / "d"))
    note = jaccard._note

    def resplit(taken):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        return note(taken)

    monkeypatch.setattr(jaccard, "_note", resplit)
    monkeypatch.setattr(jaccard, "ROWS", 16)
    try:
        got = [tuple(x)[:3] for x in jaccard.similarity_join(spark.read.parquet(str(tmp_path / "d"))).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got) == sorted(brute_components(rows))


def test_jaccard_long_lists_and_one_that_stays(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    r = random.Random(3)
    passages = [" ".join(words(r, 30, 10**6)) for _ in range(4)]
    rows = [(100 + i, " ".join(r.sample(passages, 3)) + f" own{i}") for i in range(60)] + [(7, passages[0]), (7, passages[1]), (61, passages[1]), (None, passages[1]), (62, None)]
    got = jaccard.similarity_join(docs_of(spark, rows)).collect()
    alone = [x for x in rows if x[0] != 7]
    assert sorted((x.doc_id, x.component_id) for x in got if x.doc_id is not None and x.doc_id not in (7, 61)) == sorted((i, c) for i, _, c in brute_components(alone) if i not in (None, 61))
    assert sorted((x.doc_id, x.component_id, x.stays) for x in got if x.doc_id in (7, 61)) == [(7, 7, True), (7, 7, True), (61, 7, False)]
    stay = {x.component_id for x in got if x.stays and x.component_id is not None}
    assert stay == {x.component_id for x in got if x.component_id is not None}
    assert all(x.stays for x in got if x.doc_id is None or x.n_shingles == 0)


def test_jaccard_empty(spark):
    assert jaccard.similarity_join(docs_of(spark, [])).count() == 0
    assert [tuple(x)[:4] for x in jaccard.similarity_join(docs_of(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]


# -- 9 ----------------------------------------------------------------------------------------------------------------


def test_topk(spark):
    r = random.Random(1)
    rows = [(i, [r.choice([-0.5, 0.25, 0.125, 1.0]) for _ in range(4)]) for i in range(230)] + [(i, [1.0, 1.0, 1.0, 1.0]) for i in range(300, 340)]
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0]), (402, [float("nan")] * 4), (403, [float("inf")] * 4), (None, [1.0] * 4), (12, [1.0] * 4)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0)))
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q in sorted({i for i, _ in good if i % 50 == 0}):
        v = min(v for i, v in good if i == q)
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(tuple(x) for x in found.collect()) == sorted(want)


def test_topk_few_and_large(spark):
    rows = [(0, [3e6, 1.0]), (1, [3e6, 2.0]), (2, [-3e6, 0.5])]
    got = [tuple(x) for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, every=50).orderBy("rank").collect()]
    q = [[math.floor(256 * x) for x in v] for _, v in rows]
    assert got == [(0, 1, 1, sum(a * b for a, b in zip(q[0], q[1], strict=True))), (0, 2, 2, sum(a * b for a, b in zip(q[0], q[2], strict=True)))]
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# -- 10 ---------------------------------------------------------------------------------------------------------------


def test_deal_is_the_heap():
    r = random.Random(0)
    for _ in range(100):
        k = r.choice([1, 3, 40])
        sizes = sorted(r.sample(range(500), r.randint(1, 12)), reverse=True)
        counts = [r.choice([1, 2, 50, 700]) for _ in sizes]
        heap, want = [(0, i) for i in range(k)], []
        for s, c in zip(sizes, counts, strict=True):
            took = Counter()
            for _ in range(c):
                load, i = heap[0]
                heapq.heapreplace(heap, (load + s, i))
                took[i] += 1
            want.append(sorted(took.items()))
        assert sharding.deal(sizes, counts, k) == want


def test_sharding(spark):
    r = random.Random(2)
    rows = [(i, "x" * r.choice([0, 1, 5, 50, 200])) for i in range(300)] + [(1000 + i, "hot text") for i in range(200)] + [(2000, None), (2000, None), (5, "x")]
    df = docs_of(spark, rows).withColumn("shard", F.lit("clash"))
    out = sharding.shard_groups(df, F.col("text"), F.coalesce(F.octet_length("text"), F.lit(0)) + 16, ["doc_id"], 7).collect()
    assert sorted(map(repr, [(x.doc_id, x.text) for x in out])) == sorted(map(repr, rows))
    by, group, load = {}, {}, Counter()
    for x in out:
        by.setdefault(x.shard, []).append(x.slot)
        group.setdefault(x.text, set()).add(x.shard)
        load[x.shard] += len(x.text or "") + 16
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and all(len(v) == 1 for v in group.values())
    totals = Counter()
    for _, t in rows:
        totals[t] += len(t or "") + 16
    heap = [0] * 7
    for s in sorted(totals.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + s)
    assert sorted(load.values()) == sorted(heap)
    assert sharding.shard_groups(df.limit(0), F.col("text"), F.lit(1), ["doc_id"]).count() == 0


# -- 2 ----------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b/\r\nX: y", None), (4, "u", ""), (None, "u", "<p>é</p>"), (5, "u", "z" * 100_000), (5, "u", "z" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    archives = warc.write_warc(pages, fresh_dir(spark, "warc"))
    got = warc.read_warc(archives).collect()
    assert all(x.error is None for x in got) and len(got) == len(rows)
    responses = {(x.page_id, bytes(x.payload).decode()) for x in got if x.record_type == "response"}
    assert responses == {(2, "<p>é</p>"), (4, ""), (5, "z" * 100_000)}
    ids = {x.record_id: x for x in got if x.record_type == "response"}
    assert {(x.page_id, ids[x.refers_to_record].page_id) for x in got if x.record_type == "revisit"} == {(1, 2), (None, 2), (3, 4), (5, 5)}
    assert len({x.record_id for x in got}) == len(got) and sum(x.record_type == "response" for x in got) == 3
    assert all(x.payload_digest == base64.b32encode(hashlib.sha1(x.payload).digest()).decode() for x in got if x.payload is not None)
    again = warc.read_warc(warc.write_warc(pages, fresh_dir(spark, "warc"), min_revisit=1000)).collect()
    assert [x.page_id for x in again if x.record_type == "revisit"] == [5]  # the only payload of so many bytes that repeats
    assert warc.read_warc(warc.write_warc(pages.limit(0), fresh_dir(spark, "warc"))).count() == 0


def test_warc_finds_damage():
    import io

    good = b"".join(warc.member(i, "u", b"x" * 3000, warc.digest(b"x" * 3000), None, "response", "2000-01-01T00:00:00Z") for i in range(3))
    assert [e for *_, e in warc.Reader(io.BytesIO(good))] == [None] * 3
    assert [o for o, *_ in warc.Reader(io.BytesIO(good))][1] == len(good) // 3
    first = len(good) // 3
    raw = gzip.decompress(good[:first])
    bad = gzip.compress(raw.replace(b"xxxx", b"xxxy", 1)) + good[first:]
    assert [e for *_, e in warc.Reader(io.BytesIO(bad))] == ["block digest differs", None, None]
    assert "Error" in list(warc.Reader(io.BytesIO(good[:-20])))[-1][3]
    short = gzip.compress(raw[:-10])
    assert "Content-Length" in list(warc.Reader(io.BytesIO(short)))[0][3]


# -- 5 ----------------------------------------------------------------------------------------------------------------


def brute_base(text):
    w = ALNUM.findall(lower(text or ""))
    places, labels = [], set()
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def brute_detections(text):
    """All matches of all rules by scanning, then suppression by pairs."""
    low = " " + " ".join(ALNUM.findall(lower(text or ""))) + " "
    found = []
    for i, label, _, priority, _, pattern in license_scan.rules():
        for m in re.finditer(f"(?<= )(?:{pattern})(?= )", low):
            a = low[: m.start()].count(" ") - 1
            found.append((a, a + m[0].count(" ") + 1, priority, i, label))
    order = sorted(found, key=lambda x: (x[0], -x[1], x[2], x[3]))
    kept = []
    for n, d in enumerate(order):
        if not any(e[0] <= d[0] and e[1] >= d[1] and e[2] <= d[2] for e in order[:n]):
            kept.append(d)
    return kept


def test_license_scan(spark):
    r = random.Random(4)
    bits = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "GNU General Public License, version 3", "SPDX-License-Identifier: BSD-3-Clause", "mit license", "general public", "license", "CC BY-NC 4.0", "Lorem ipsum, dolor", "Copyright (c) 2020 A B. All rights reserved.", "é_x", "public domain", "mit", "in the public-domain"]
    rows = [(i, " ".join(r.choice(bits) for _ in range(r.randint(0, 7)))) for i in range(120)] + [(500, None), (501, ""), (502, "MIT LICENSE " * 300)]
    got = {x.doc_id: x for x in license_scan.scan(docs_of(spark, rows).withColumn("labels", F.lit(0))).collect()}
    for i, text in rows:
        x = got[i]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == brute_base(text), text
        assert [(d.start, d.end, d.priority, d.rule, d.label) for d in x.detections] == brute_detections(text), text
        assert set(filter(None, x.base_labels.split(","))) <= set(x["labels"].split(",")) and 0 <= x.score <= 1
    assert len(license_scan.rules()) > 200


def examples(pattern):
    """A text for every alternative of a rule's pattern, with its optional parts and without them."""

    def walk(tree, full):
        out = [""]
        for op, value in tree:
            kind = str(op)
            if kind == "LITERAL":
                some = [chr(value)]
            elif kind == "NOT_LITERAL":
                some = ["x"]
            elif kind == "IN":
                some = ["x"] if str(value[0][0]) == "NEGATE" else [chr(v if str(k) == "LITERAL" else v[0]) for k, v in value]
            elif kind == "SUBPATTERN":
                some = walk(value[3], full)
            elif kind == "BRANCH":
                some = [x for b in value[1] for x in walk(b, full)]
            elif kind == "MAX_REPEAT":
                times = min(value[1], max(value[0], 1)) if full else value[0]
                some = walk(value[2], full) if times == 1 else ["".join(x) for x in zip(*[walk(value[2], full)] * times, strict=True)] if times else [""]
            else:
                raise AssertionError(kind)
            out = [a + b for a in out for b in some]
        return out

    import re._parser as parser

    return sorted({x.strip() for full in (False, True) for x in walk(parser.parse(pattern), full)})


def test_license_gate_passes_every_match(spark):
    every = [(rule, x) for rule in license_scan.rules() for x in examples(rule[5])]
    assert all(re.search(f"(?<= )(?:{rule[5]})(?= )", f" {x} ") for rule, x in every)
    assert [(rule[1], x) for rule, x in every if not set(rule[2]) <= set(x.split())] == []
    some = [x for _, x in every][::7]
    got = {x.doc_id: x for x in license_scan.scan(docs_of(spark, list(enumerate(some)))).collect()}
    for i, text in enumerate(some):
        assert [(d.start, d.end, d.priority, d.rule, d.label) for d in got[i].detections] == brute_detections(text), text
        assert got[i]["labels"] and got[i].score > 0
    alone = ["Released under the MIT.", "published under CC BY 4.0.", "AVAILABLE\nunder Creative Commons Attribution", "(Distributed only -- under: Apache 2.0)", "covered by zlib", "released by nobody", "FreeBSD license", "PSF License", "do what the fuck you want to public license", "beerware license", "beer ware licence"]
    got = {x.doc_id: x for x in license_scan.scan(docs_of(spark, list(enumerate(alone)))).collect()}
    assert [got[i]["labels"] for i in range(len(alone))] == ["mit", "cc-by-4.0", "cc,cc-by", "apache-2.0", "zlib", "", "bsd-2-clause", "python-2.0", "wtfpl", "beerware", "beerware"] and got[0].score == 0.95
    assert license_scan.scan(docs_of(spark, [])).count() == 0


def test_license_many_matches(spark):
    text = "MIT license, apache license. all rights reserved; " * 400
    x = license_scan.scan(docs_of(spark, [(1, text)])).first()
    assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == brute_base(text)
    assert [(d.start, d.end, d.priority, d.rule, d.label) for d in x.detections] == brute_detections(text)


def test_html_drops_nothing_of_the_article(spark):
    inner = "<h1>Title of it</h1><p>One sentence with <math><mi>x</mi><mo>+</mo><mn>1</mn></math> inside it, and more words.<p>Second <svg><text>label</text></svg> part of the text goes on here.<noscript><p>Shown without scripts, a sentence.</p></noscript><object data=x>An object that has a text instead of it.<p>Third paragraph after an object that never ends."
    page = f"<html><body><nav><a href=/>Home</a></nav><article>{inner}</article><footer>&copy; x</footer></body></html>"
    got = html_extract.extract(spark.createDataFrame([(1, page)], "page_id long, html string")).first().text
    assert got == "Title of it\nOne sentence with x+1 inside it, and more words.\nSecond label part of the text goes on here.\nShown without scripts, a sentence.\nAn object that has a text instead of it.\nThird paragraph after an object that never ends."


def test_html_query(spark, tmp_path):
    spark.createDataFrame([(1, "u", "<article><p>A first sentence, long enough.</p></article>"), (2, None, None), (2, None, None), (None, "v", "")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = html_extract.op4_html(spark, str(tmp_path))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((x.page_id or 0, x.text, x.n_chars) for x in got.collect()) == [(0, "", 0), (1, "A first sentence, long enough.", 30), (2, "", 0), (2, "", 0)]


# -- 6 ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return sentencepiece.load_model()


def test_sentencepiece_equals_the_library(model):
    import public_tokenizers
    import sentencepiece as library

    sp = library.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(9)
    texts = ["", None, "a", "  b  ", "▁▁ x▁y", "日本語🎉", "a" * 5000, " " * 40, "<s> <0x0A>", "\x00\x01\n\t", "don't stop"]
    texts += ["".join(r.choice("abcdetionsrh   \n.,éñ日ÀЖ1") for _ in range(r.randint(0, 200))) for _ in range(400)]
    encoder = sentencepiece.Encoder(model)
    for part in (texts, texts[::-1]):
        ids, counts = encoder(*utf8(pa.array(part, pa.string())))
        edge = np.concatenate([[0], np.cumsum(counts)])
        assert [ids[a:b].tolist() for a, b in zip(edge, edge[1:], strict=False)] == [sp.encode(x) if x else [] for x in part]


def test_sentencepiece_frames(spark, model):
    rows = [(1, "Hello world"), (2, None), (3, ""), (3, ""), (4, "meta ▁ here")]
    out = sentencepiece.encode(docs_of(spark, rows).withColumn("ids", F.lit(1)), model=model)
    got = {x.doc_id: x for x in out.collect()}
    assert got[1].round_trip and got[2].n_tokens == 0 and got[2].round_trip and not got[4].round_trip
    back = sentencepiece.decode(out.drop("text"), model=model).collect()
    assert sorted((x.doc_id, x.text) for x in back) == [(1, "Hello world"), (2, ""), (3, ""), (3, ""), (4, "meta   here")]
    assert sentencepiece.encode(docs_of(spark, []), model=model).count() == 0


# -- 7 ----------------------------------------------------------------------------------------------------------------


def test_toxicity_learns(spark):
    r = random.Random(6)
    rows = [(i, " ".join(words(r, 40, 500) + (["you", "utter", "blockhead"] if i % 4 == 0 else []))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    docs = docs_of(spark, rows + [(1000, None), (1001, ""), (1001, "")])
    learn = toxicity.train(docs, labels, toxicity.LEARN)
    got = {x.doc_id: x for x in toxicity.score(docs.withColumn("score", F.lit("clash")), *learn).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == int(i % 4 == 0) for i in held]) > 0.97
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got.values()) and got[1000].score == got[1001].score


def test_toxicity_leaves_out_only_what_does_not_fit(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_LABELLED_BYTES", 1000)
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: (sorted(texts), 0.0))
    docs = docs_of(spark, [(i, "x" * 2000 if i < 20 else f"text {i}") for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels)[0] == sorted(f"text {i}" for i in range(20, 40))
    # nothing learnt: the stage keeps every document
    import corpus_pipeline

    monkeypatch.setattr(toxicity, "train", lambda *_: (np.zeros(1 << toxicity.BITS), 0.0))
    monkeypatch.setattr(spark.read.__class__, "parquet", lambda *_: labels)
    assert corpus_pipeline.drop_toxic(spark, docs, "").count() == 40


def test_toxicity_character_ngrams():
    r = random.Random(2)
    texts = ["", "a", "Ab  \t\ncd", "éàß — ñandú ñandú", "日本語のテキスト", " x ", "x" * 50, *["".join(r.choice("ab éß日\n ") for _ in range(r.randrange(40))) for _ in range(60)]]
    data, offsets = utf8(pa.array(texts))
    every = np.ones(1 << toxicity.BITS, bool)
    ids, counts = toxicity.features(data, offsets, every)
    at = 0
    grams = {}
    for text, n in zip(texts, counts.tolist(), strict=True):
        flat = re.sub("[ \t\n\x0b\f\r]+", " ", lower(text))
        want = {flat[i : i + k] for k in toxicity.LENGTHS for i in range(len(flat) - k + 1)}
        for g in want:  # what a text of the n-gram alone has and its parts do not
            if g not in grams:
                own, _ = toxicity.features(*utf8(pa.array([g])), every)
                less = set().union(*(toxicity.features(*utf8(pa.array([x])), every)[0].tolist() for x in (g[1:], g[:-1])))
                grams[g] = set(own.tolist()) - less
        assert set(ids[at : at + n].tolist()) == set().union(*(grams[g] for g in want)) if want else n == 0
        at += n
    points, edges = toxicity.characters(np.frombuffer(b"a\xff\xfeb" + "é".encode(), np.uint8), np.array([0, 3, 6]))
    assert points[edges[1] :].tolist() == [98, 0xE9]


def test_toxicity_query(spark, tmp_path):
    rows = [(i, f"text {i} " + ("vile scum" if i % 3 == 0 else "kind words")) for i in range(300)] + [(300, None), (301, ""), (None, "vile scum"), (302, "vile scum " * 30000)]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op7_toxicity(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    got = got.collect()
    assert len(got) == 304 and all(x.predicted == int(x.score >= 0.5) and 0 <= x.score <= 1 for x in got)
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    assert all(x.predicted == int(x.doc_id % 3 == 0) for x in got if x.doc_id is not None and x.doc_id < 300)


def test_toxicity_without_labels(spark):
    docs = docs_of(spark, [(1, "a")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(round(x.score, 6), x.predicted) for x in toxicity.score(docs, *toxicity.train(docs, none)).collect()] == [(0.25, 0)]
    assert toxicity.score(docs_of(spark, []), *toxicity.train(docs_of(spark, []), none)).count() == 0
    one = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs, *toxicity.train(docs, one)).first().predicted == 0


def test_warc_query(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.randrange(30), f"http://x/{i}", r.choice([None, "", "a", "bb" * 50, "é"])) for i in range(80)] + [(None, None, "only nulls"), (None, "u", "only nulls")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op2_warc(spark, str(tmp_path)).collect()
    want = []
    for payload in {x[2] or "" for x in rows}:
        same = sorted((x[0] for x in rows if (x[2] or "") == payload), key=lambda i: -1 if i is None else i)
        raw = payload.encode()
        sha = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want += [(i, len(raw), sha, "revisit", same[-1]) for i in same[:-1]] + [(same[-1], len(raw), sha, "response", None)]
    assert sorted(map(repr, want)) == sorted(repr((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to)) for x in got)
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert warc.op2_warc(spark, f"{tmp_path}/none").count() == 0


# -- 4 ----------------------------------------------------------------------------------------------------------------


def test_html_field_on_held_out_pages():
    r = random.Random(123)
    extractor, right, total = html_extract.Extractor(html_extract.default_field()), 0, 0
    for _ in range(300):
        page = html_extract.labelled_page(r)
        truth = [x[0].startswith(html_extract._MARK) for x in html_extract.blocks(page, html_extract.Paths()) if x[0] != html_extract._MARK]
        found = [label for _, label in extractor.labels(page.replace(html_extract._MARK, ""))]
        if len(truth) == len(found):
            right += sum(a == b for a, b in zip(truth, found, strict=True))
            total += len(truth)
    assert right / total > 0.97


def test_viterbi_is_the_best_chain():
    from itertools import product

    r = random.Random(1)
    for _ in range(50):
        n = r.randint(1, 7)
        pairs, ends, scores = np.array([[r.gauss(0, 1) for _ in range(2)] for _ in range(2)]), np.array([[r.gauss(0, 1) for _ in range(2)] for _ in range(2)]), [r.gauss(0, 1) for _ in range(n)]
        value = lambda c: ends[0][c[0]] + ends[1][c[-1]] + sum(s * x for s, x in zip(scores, c, strict=True)) + sum(pairs[a][b] for a, b in zip(c, c[1:], strict=False))  # noqa: B023, E731
        assert html_extract.Field([], np.zeros(0), pairs, ends).viterbi(scores) == [bool(x) for x in max(product((0, 1), repeat=n), key=value)]


def test_html_frames(spark):
    page = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class=ad>Buy this now, it is cheap.</div><article><h1>Big  &amp; small</h1><p>First <b>bold</b>,\n here is a sentence &lt;x&gt;.<p>Second one here is a longer sentence.</article><section id=comments><p>Great post, thanks!</p></section><footer>&copy; x</footer>"
    rows = [(1, page), (2, None), (3, ""), (3, ""), (4, "<<<>><p"), (5, "<p>" * 3000 + "x")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, html string").withColumn("n_chars", F.lit("c"))).collect()
    text = {x.page_id: x.text for x in got}
    assert text[1] == "Big & small\nFirst bold, here is a sentence <x>.\nSecond one here is a longer sentence."
    assert text[2] == text[3] == "" and len(got) == 6 and all(x.n_chars == len(x.text) for x in got)


def test_toxicity_and_other_queries_have_the_contract_columns(spark, tmp_path):
    long_text = " ".join(f"v{i % 3000} MIT License" for i in range(20_000))
    rows = [(i, f"document {i} released under the mit license") for i in range(60)] + [(60, None), (61, ""), (61, ""), (None, "x"), (62, long_text)]
    docs_of(spark, rows).withColumn("labels", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "document 5 released under the mit license")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = str(tmp_path)
    five = license_scan.op5_license_scan(spark, at)
    assert five.dtypes == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_base", "bigint"), ("first_word", "bigint"), ("last_word", "bigint"), ("base_labels", "string"), ("labels", "string"), ("score", "double")]
    got = {x.doc_id: x for x in five.collect()}
    assert (got[62].n_words, got[62].n_base, got[62].first_word, got[62].last_word) == (60_000, 20_000, 1, 59_998)
    six = sentencepiece.op6_sentencepiece(spark, at).collect()
    assert len(six) == len(rows)
    eight = decontaminate.op8_decontaminate(spark, at)
    assert eight.columns[:6] == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert {x.doc_id: (x.n_hit, x.contaminated, x.items_sha256) for x in eight.collect()}[5] == (7, True, hashlib.sha256(b"1").hexdigest())
    ten = sharding.op10_sharding(spark, at)
    assert ten.dtypes[:7] == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    ten = ten.collect()
    assert len(ten) == len(rows) and all(0 <= x.shard < 40 for x in ten)
    for k in {x.shard for x in ten}:
        assert sorted(x.slot for x in ten if x.shard == k) == list(range(sum(x.shard == k for x in ten)))


def test_sharding_of_large_groups(spark):
    r = random.Random(6)
    rows = [(i, int(r.paretovariate(0.8) * 1000)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, size long")
    got = sharding.shard_groups(df, F.col("k"), F.col("size"), ["k"], 7).collect()
    loads = Counter()
    for x in got:
        loads[x.shard] += x["size"]
    total, top = sum(s for _, s in rows), max(s for _, s in rows)
    assert max(loads.values()) <= max(top, total / 7 * 1.01 + 2) and len(got) == 3000
