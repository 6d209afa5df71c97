"""The window network: scores against a plain loop, the gradient by differences, counts, places, and defined results of odd rows."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import lm_score
from tessera.llm.common import ALNUM, Words, utf8

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def corpus(n=300, seed=1):
    r = random.Random(seed)

    def sentence():
        topic = r.choice(["sea", "hill", "moon"])
        return " ".join(f"{topic}{r.randrange(6)} the {topic}{r.randrange(6)} and" for _ in range(15))

    return [(i, sentence()) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "... "), (n + 3, "once"), (n + 4, "twice"), (n + 4, "twice")]


def word_hash(w):
    return int(Words(*utf8(pa.array([w])), ALNUM).hashes[0])


def test_counts_are_of_every_word(spark):
    rows = [(1, "A b a"), (2, None), (3, "b c"), (4, "")]
    assert sorted(x.n for x in lm_score.count_words(docs_of(spark, rows)).collect()) == [1, 2, 2]
    assert lm_score.count_words(docs_of(spark, [])).count() == 0


def test_table_finds_all_and_nothing_else():
    r = np.random.default_rng(0)
    h = np.unique(r.integers(0, 1 << 63, 5000).astype(np.uint64) << np.uint64(1))
    t = lm_score.Table(h)
    assert (t.find(h) == np.arange(len(h))).all()
    assert (t.find(h + np.uint64(1)) == -1).all()


@pytest.mark.parametrize("known", [lm_score.KNOWN, 12])
def test_scores_equal_a_plain_loop(spark, known):
    rows = corpus()
    docs = docs_of(spark, rows)
    model = lm_score.fit(docs, known=known, rounds=2)
    probe = [*rows[::37], rows[-1], (900, "never seen sea1"), (901, None), (902, ""), (903, " ".join(["the", "sea1"] * 3000))]
    frame = docs_of(spark, probe).withColumn("log_prob", F.lit("clash")).withColumn("_row", F.lit(1))
    got = {r.doc_id: r for r in lm_score.score(frame, model).collect()}
    counts = {}
    for _, text in rows:
        for w in WORD.findall((text or "").lower()):
            counts[w] = counts.get(w, 0) + 1
    v = model.vocabulary
    e, b, u, c, w2, d = [x.astype(float) for x in lm_score.views(model.theta)]
    rank = {w: int(v.table.find(np.array([word_hash(w)], np.uint64))[0]) for w in counts}
    net = [w for w in counts if 0 <= rank[w] < len(v.place)]
    assert v.rare_mass == max(1, sum(counts.values()) - sum(counts[w] for w in net))
    for doc, text in probe:
        ws = WORD.findall((text or "").lower())
        if len(ws) > 500:
            assert got[doc].n_tokens == len(ws) and got[doc].log_prob < 0
            continue
        total = 0.0
        for i, w in enumerate(ws):
            z = b.copy()
            for j, o in enumerate([-3, -2, -1, 1, 2, 3]):
                if 0 <= i + o < len(ws):
                    k = rank.get(ws[i + o], -1)
                    k = k if k >= 0 else lm_score.KNOWN + word_hash(ws[i + o]) % lm_score.HASHED
                    row = k if k < lm_score.OWN else lm_score.OWN + k % lm_score.HASHED
                else:
                    row = lm_score.OWN + lm_score.HASHED
                z = z + e[j][row]
            h = np.maximum(z, 0)
            p = h @ u + c
            place = int(v.place[rank[w]]) if w in net else lm_score.NETWORK
            cls, k = divmod(place, lm_score.PER_CLASS)
            total += p[cls] - math.log(np.exp(p).sum())
            if w in net:
                q = w2[cls] @ h + d[cls]
                total += q[k] - math.log(np.exp(q).sum())
            else:
                total += math.log(counts.get(w, 1)) - math.log(v.rare_mass)
        assert got[doc].n_tokens == len(ws) and abs(got[doc].log_prob - total) < 1e-2 * max(1, len(ws)) ** 0.5, doc
        assert got[doc].mean_log_prob is None if not ws else abs(got[doc].mean_log_prob * len(ws) - got[doc].log_prob) < 1e-9
    assert got[901].log_prob == got[902].log_prob == 0.0


def test_both_sides_matter_and_repeats_score_apart(spark):
    rows = corpus(600)
    model = lm_score.fit(docs_of(spark, rows), rounds=4)
    r = random.Random(5)
    text = rows[7][1]
    mixed = " ".join(r.sample(text.split(), len(text.split())))
    got = {x.doc_id: x.mean_log_prob for x in lm_score.score(docs_of(spark, [(1, text), (2, mixed)]), model).collect()}
    assert got[1] > got[2] + 0.3
    # with 12 known words all others are scored by the joined counts
    few = lm_score.fit(docs_of(spark, rows), known=1, rounds=1)
    got = {x.doc_id: x.mean_log_prob for x in lm_score.score(docs_of(spark, [(1, "once"), (2, "twice")]), few).collect()}
    assert abs(got[2] - got[1] - math.log(2)) < 1e-6


def test_empty_corpus(spark):
    none = docs_of(spark, [])
    model = lm_score.fit(none)
    assert lm_score.score(none, model).count() == 0
    assert lm_score.score(docs_of(spark, [(1, "x"), (None, None)]), model).orderBy("n_tokens").first().mean_log_prob is None


def test_rounds_take_every_place_once():
    lens = np.array([50, 0, 1, 16], np.int32)
    v = lm_score.Vocabulary(lm_score.Table(np.zeros(0, np.uint64)), np.zeros(0, np.int64), 1, np.zeros(0, np.int64))
    places = lm_score.Places(np.arange(67, dtype=np.int32), lens, v)
    assert places.number.tolist() == [*range(50), 0, *range(16)]
    dealt = [np.flatnonzero(places.number % 4 == t) for t in range(4)]
    assert sorted(np.concatenate(dealt).tolist()) == list(range(67))


def test_gradient_by_differences():
    r = np.random.default_rng(0)
    n = lm_score.NETWORK
    v = lm_score.Vocabulary(lm_score.Table(np.zeros(0, np.uint64)), np.arange(n, 0, -1), 50, np.arange(n))
    places = lm_score.Places(r.integers(0, n + 500, 60).astype(np.int32), np.array([40, 20]), v)
    theta = lm_score.initial(v).astype(np.float64)
    at = np.arange(0, 60, 2)

    def loss(t):
        return -float(lm_score.log_probabilities(t, places)[at].mean())

    before = theta.copy()
    lm_score.descend(theta, squares := np.full_like(theta, 1e-3), places, at)
    grad = np.sqrt(np.maximum(squares - 1e-3, 0)) * -np.sign(theta - before)
    sizes = np.cumsum([0, *[int(np.prod(s)) for s in lm_score._SHAPES]])
    for a, b in zip(sizes, sizes[1:], strict=False):
        for i in a + np.argsort(-np.abs(grad[a:b]))[:3]:
            t = before.copy()
            t[i] += 1e-5
            assert abs((loss(t) - loss(before)) / 1e-5 - grad[i]) < 1e-3


def test_query_columns(spark, tmp_path):
    docs_of(spark, corpus(40)).write.parquet(f"{tmp_path}/documents.parquet")
    got = lm_score.op1_lm_score(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "log_prob", "mean_log_prob"] and got.count() == 46
