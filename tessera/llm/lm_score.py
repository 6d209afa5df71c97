"""Masked pseudo-likelihood scores from a bidirectional window network.

Words are a-z, 0-9 and all that is not ASCII, lower-cased; every word of every document is counted. The NETWORK most frequent
words are dealt to classes of words that occur beside like neighbours (counted over the whole corpus), all other words are one
class more. A network reads the SIDE words before and after a place, never the word itself: a row for each word and offset,
summed and rectified, then two softmaxes, one over the classes and one over the words of the class, both from the same
context. A word outside the network has its share of the counts of such words, whichever it is: frequent ones from a table
of bounded size that all tasks hold, all others by a join with the counts of the corpus. A document's score is the sum of the
log-probabilities of all its words, each predicted from both sides.

Training is data-parallel: the places of each document are dealt to ROUNDS masks (place modulo ROUNDS), so that all rounds
together train on every place of every document once. In a round every task takes gradient steps on its places from the common
weights and hands back its weights; they are averaged by places trained, FAN at a time, so that no task holds more
than FAN of them and the driver one. What is gathered (counts, neighbours, weights) follows the corpus. Averages depend on how
rows are dealt to tasks, so that scores of runs over another partitioning differ a little.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Words, batch_rows, slices, stage

#: Classes, and words of each, that the network predicts.
CLASSES, PER_CLASS = 80, 80
NETWORK = CLASSES * PER_CLASS
#: Words whose counts every task holds; those of all others are joined.
KNOWN = 262_144
SIDE = 3
#: Context words with rows of their own; the others share HASHED rows.
OWN, HASHED = 2048, 1024
HIDDEN = 16
ROUNDS = 4
#: Places of a gradient step at most; so many steps for a slice of texts at least, if it has 256 places for each.
BATCH, STEPS = 16384, 16
RATE = 0.6
HIGH = 60.0
#: Weights that are averaged by one task.
FAN = 16
#: Words of one row of numbers, and of the places that a task holds at once; floats of one row of weights.
WORDS, HELD_PLACES, FLOATS = 1 << 16, 1 << 20, 1 << 16
#: Distinct words that a task counts at once.
HELD_WORDS = 1_000_000
#: Buckets of neighbours on each side by which words are dealt to classes: so many most frequent words, and hashes of the others.
NEAR, FAR = 32, 16
_PAD = OWN + HASHED
_OFFSETS = (*range(-SIDE, 0), *range(1, SIDE + 1))
_SHAPES = [(2 * SIDE, _PAD + 1, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES + 1), (CLASSES + 1,), (CLASSES, PER_CLASS, HIDDEN), (CLASSES, PER_CLASS)]


class Table:
    """Numbers of 64-bit hashes: open addressing, looked up a whole array at a time."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.bits = max(8, int(len(hashes)).bit_length() + 1)
        self.mask = (1 << self.bits) - 1
        self.keys, self.numbers = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        at, left = self._slot(hashes), np.arange(len(hashes))
        while len(left):
            free = self.numbers[at[left]] < 0
            place, first = np.unique(at[left[free]], return_index=True)
            taken = left[free][first]
            self.keys[place], self.numbers[place] = hashes[taken], taken
            left = np.setdiff1d(left, taken, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it has none."""
        at = self._slot(hashes)
        out = self.numbers[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[at] != hashes))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            out[open_] = self.numbers[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[at[open_]] != hashes[open_])]
        return out


@dataclass
class Vocabulary:
    """Words by rank (most frequent first). place: class * PER_CLASS + number in the class of the first NETWORK ranks."""

    table: Table
    counts: np.ndarray
    rare_mass: int
    place: np.ndarray

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Rank, or KNOWN + hash modulo HASHED for words whose counts must be joined."""
        rank = self.table.find(hashes)
        return np.where(rank >= 0, rank, KNOWN + (hashes % np.uint64(HASHED)).astype(np.int32))


def context_rows(ids: np.ndarray) -> np.ndarray:
    return np.where(ids < OWN, ids, OWN + ids % HASHED).astype(np.int32)


def count_words(docs: DataFrame) -> DataFrame:
    """word (64-bit hash as long), n: of all words of all texts. Null and empty texts have none; no rows give no rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])

        for batch in batches:
            for _, data, offsets in slices(batch):
                w, c = np.unique(Words(data, offsets, ALNUM).hashes, return_counts=True)
                both = np.concatenate([words, w])
                words, at = np.unique(both, return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate([counts, c]), minlength=len(words)).astype(np.int64)
                if len(words) > HELD_WORDS:
                    yield out()
                    words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield out()

    return docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _bin(n: Column) -> Column:
    """Bins of counts: their own up to 4096, then 64 for each doubling."""
    return F.when(n < 4096, n).otherwise(4096 + F.floor(F.log2(n / 4096) * 64)).cast("long")


def known_words(counts: DataFrame, size: int = KNOWN) -> tuple[Vocabulary, int]:
    """Words of the highest bins of counts that have at most `size` together, and the lowest of these bins. Their classes are not dealt yet.

    counts: word, n. Words of a bin are all in or all out. An empty table gives an empty vocabulary.
    """
    bins = counts.groupBy(_bin(F.col("n")).alias("bin")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).orderBy(F.desc("bin")).collect()  # some thousands, whatever the corpus
    least, held = (bins[0]["bin"] + 1 if bins else 1), 0
    for row in bins:
        held += row["words"]
        if held > size:
            break
        least = row["bin"]
    top = counts.where(_bin(F.col("n")) >= least).toArrow()  # at most `size` rows
    hashes, n = top.column("word").to_numpy().astype(np.int64).view(np.uint64), top.column("n").to_numpy().astype(np.int64)
    by = np.lexsort((hashes, -n))
    hashes, n = hashes[by], n[by]
    return Vocabulary(Table(hashes), n, max(1, sum(r["n"] for r in bins) - int(n[:NETWORK].sum())), np.arange(min(NETWORK, len(n)))), least


def encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """lens, ids: 32-bit numbers of some texts' words and how many each text has."""
    known = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lens: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in (lens, ids)], ["lens", "ids"])

        for batch in batches:
            for _, data, offsets in slices(batch):
                w = Words(data, offsets, ALNUM)
                lens.append(w.counts.astype("<i4"))
                ids.append(known.value.ids(w.hashes).astype("<i4"))
                if sum(map(len, ids)) >= WORDS:
                    yield out()
                    lens, ids = [], []
        if lens:
            yield out()

    return docs.select("text").mapInArrow(run, "lens binary, ids binary")


def _rows(n: int, values: np.ndarray) -> pa.RecordBatch:
    """What a task hands to summed()."""
    values = values.astype(np.float32, copy=False)
    pieces = [values[a : a + FLOATS].tobytes() for a in range(0, len(values), FLOATS)]
    part, many = TaskContext.get().partitionId(), len(pieces)
    return pa.RecordBatch.from_arrays([pa.array([part] * many, pa.int64()), pa.array(range(many), pa.int64()), pa.array([n] * many, pa.int64()), pa.array(pieces, pa.binary())], ["part", "piece", "n", "piece_values"])


_ROWS = "part long, piece long, n long, piece_values binary"


def summed(tasks: DataFrame, parts: int) -> tuple[int, np.ndarray] | None:
    """Of what tasks gave by _rows: the sum of n and of n * values / sum of n, FAN parts at a time. None without any n."""

    def mean(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("part", "n", "piece_values")), strict=True))
        n = sum(k for _, k, _ in rows)
        total = sum(np.frombuffer(raw, np.float32) * np.float64(k / max(1, n)) for _, k, raw in rows)
        return pa.table({"part": [rows[0][0] // FAN], "piece": [table.column("piece")[0].as_py()], "n": [n], "piece_values": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    while True:
        tasks = tasks.groupBy(F.floor(F.col("part") / FAN).alias("parts"), "piece").applyInArrow(mean, _ROWS)
        parts = -(-parts // FAN)
        if parts <= 1:
            break
    found = sorted(tasks.collect(), key=lambda r: r["piece"])  # one array in all
    if not found or not found[0]["n"]:
        return None
    return found[0]["n"], np.concatenate([np.frombuffer(r["piece_values"], np.float32) for r in found])


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, lens) of encoded texts, some rows together."""
    lens: list[np.ndarray] = []
    ids: list[np.ndarray] = []
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            lens.append(np.frombuffer(a, "<i4"))
            ids.append(np.frombuffer(b, "<i4"))
            if sum(map(len, ids)) >= HELD_PLACES:
                yield np.concatenate(ids), np.concatenate(lens)
                lens, ids = [], []
    if lens:
        yield np.concatenate(ids), np.concatenate(lens)


def deal_classes(v: Vocabulary, encoded: DataFrame, parts: int) -> Vocabulary:
    """Deals the network's words to classes of PER_CLASS by the words beside them: halves along the first principal direction, again and again."""
    size, wide = len(v.place), 2 * (NEAR + FAR)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * wide)
        for ids, lens in _numbers(batches):
            bucket = np.where(ids < NEAR, ids, NEAR + ids % FAR)
            of = np.repeat(np.arange(len(lens)), lens)
            beside = of[1:] == of[:-1]
            for target, other, side in ((ids[:-1], bucket[1:], 0), (ids[1:], bucket[:-1], NEAR + FAR)):
                keep = beside & (target < size)
                total += np.bincount(target[keep].astype(np.int64) * wide + other[keep] + side, minlength=size * wide)
        yield _rows(1, total)

    found = summed(encoded.mapInArrow(near, _ROWS), parts) if size else None
    place = np.arange(size)
    if found is not None:
        x = np.sqrt(found[1].reshape(size, wide).astype(np.float64))
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        todo = [(np.arange(size), 0, -(-size // PER_CLASS))]
        while todo:
            words, first, classes = todo.pop()
            if classes == 1:
                place[words] = first * PER_CLASS + np.arange(len(words))
                continue
            y = x[words] - x[words].mean(0)
            direction = np.linalg.svd(y.T @ y)[0][:, 0]
            direction *= 1 if direction[np.abs(direction).argmax()] > 0 else -1
            half = classes // 2
            ordered = words[np.lexsort((words, np.round(y @ direction, 6)))]
            todo += [(ordered[: half * PER_CLASS], first, half), (ordered[half * PER_CLASS :], first + half, classes - half)]
    return Vocabulary(v.table, v.counts, v.rare_mass, place)


def initial(v: Vocabulary, seed: int = 11) -> np.ndarray:
    """Small random rows; the two softmaxes start at the counts."""
    r = np.random.default_rng(seed)
    n = np.zeros(NETWORK)
    n[v.place] = v.counts[: len(v.place)]
    in_class = n.reshape(CLASSES, PER_CLASS)
    mass = np.append(in_class.sum(1), v.rare_mass)
    parts = [r.normal(0, 0.1, _SHAPES[0]), np.full(_SHAPES[1], 0.1), r.normal(0, 0.1, _SHAPES[2]), np.log((mass + 1e-6) / mass.sum()), r.normal(0, 0.1, _SHAPES[4]), np.log((in_class + 1e-6) / np.maximum(in_class.sum(1, keepdims=True), 1))]
    return np.concatenate([x.reshape(-1) for x in parts]).astype(np.float32)


def views(theta: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for shape in _SHAPES:
        n = int(np.prod(shape))
        out.append(theta[at : at + n].reshape(shape))
        at += n
    return out


class Places:
    """The words of some texts, with the context rows around each, and their class and number in it (class CLASSES: not of the network)."""

    def __init__(self, ids: np.ndarray, lens: np.ndarray, v: Vocabulary) -> None:
        every = np.arange(len(ids), dtype=np.int32)
        self.padded = np.full(len(ids) + SIDE * (len(lens) + 1), _PAD, np.int32)
        self.at = every + SIDE * (np.repeat(np.arange(len(lens), dtype=np.int32), lens) + 1)
        self.padded[self.at] = context_rows(ids)
        self.number = every - np.repeat((np.cumsum(lens) - lens).astype(np.int32), lens)  # in its document
        place = np.append(v.place, NETWORK).astype(np.int32)[np.minimum(ids, len(v.place))]
        self.word_class, self.word = (place // PER_CLASS).astype(np.uint8), (place % PER_CLASS).astype(np.uint8)


def hidden(theta: list[np.ndarray], places: Places, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rectified layer, context rows at each offset) of places."""
    e, b, *_ = theta
    at = places.at[at]
    around = [places.padded[at + d] for d in _OFFSETS]
    h = np.take(e[0], around[0], axis=0)
    for j in range(1, 2 * SIDE):
        h += np.take(e[j], around[j], axis=0)
    h += b
    return np.maximum(h, 0, out=h), around


def softmax(z: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Of each row, in place. Logits end at HIGH, so that no sum overflows."""
    z += bias
    np.minimum(z, HIGH, out=z)
    np.exp(z, out=z)
    z *= (1 / z.sum(1))[:, None]
    return z


def log_softmax(z: np.ndarray, bias: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Of one place in each row; z is overwritten."""
    z += bias
    np.minimum(z, HIGH, out=z)
    hit = z[np.arange(len(z)), of]
    return hit - np.log(np.exp(z, out=z).sum(1))


def descend(theta: np.ndarray, squares: np.ndarray, places: Places, at: np.ndarray, rate: float = RATE) -> None:
    """One Adagrad step on masked places, in place."""
    at = at[np.argsort(places.word_class[at], kind="stable")]
    parts, sums = views(theta), views(squares)
    e, b, u, c, w, d = parts
    n = len(at)
    of, word = places.word_class[at], places.word[at]
    h, around = hidden(parts, places, at)
    z = softmax(h @ u, c)
    z[np.arange(n), of] -= 1
    gh = z @ u.T

    def step(x: np.ndarray, s: np.ndarray, g: np.ndarray, rows=...) -> None:
        g = g / n
        new = s[rows] + g * g
        s[rows] = new
        x[rows] -= rate * g / (np.sqrt(new) + 1e-6)

    gu, gc = h.T @ z, z.sum(0)
    edge = np.searchsorted(of, np.arange(CLASSES + 1))
    for k in np.unique(of).tolist():
        if k == CLASSES:
            continue
        some = slice(edge[k], edge[k + 1])
        p = softmax(h[some] @ w[k].T, d[k])
        p[np.arange(len(p)), word[some]] -= 1
        gh[some] += p @ w[k]
        step(w[k], sums[4][k], p.T @ h[some])
        step(d[k], sums[5][k], p.sum(0))
    gh *= h > 0
    for j in range(2 * SIDE):
        order = np.argsort(around[j].astype(np.uint16), kind="stable")
        rows = around[j][order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        step(e[j], sums[0][j], np.add.reduceat(gh[order], first), rows[first])
    step(b, sums[1], gh.sum(0))
    step(u, sums[2], gu)
    step(c, sums[3], gc)


def log_probabilities(theta: np.ndarray, places: Places) -> np.ndarray:
    """Of every word from both sides; for one outside the network, of that class as a whole."""
    parts = views(theta)
    _, _, u, c, w, d = parts
    out = np.empty(len(places.at))
    for begin in range(0, len(out), BATCH):
        at = np.arange(begin, min(begin + BATCH, len(out)))
        at = at[np.argsort(places.word_class[at], kind="stable")]
        of, word = places.word_class[at], places.word[at]
        h, _ = hidden(parts, places, at)
        found = log_softmax(h @ u, c, of)
        edge = np.searchsorted(of, np.arange(CLASSES + 1))
        for k in np.unique(of).tolist():
            if k < CLASSES:
                some = slice(edge[k], edge[k + 1])
                found[some] += log_softmax(h[some] @ w[k].T, d[k], word[some])
        out[at] = found
    return out


def train(encoded: DataFrame, v: Vocabulary, parts: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights averaged over all tasks, round by round; all rounds together take every place once. Without places they are the initial ones."""
    spark = encoded.sparkSession
    theta = initial(v)
    known = spark.sparkContext.broadcast(v)
    for turn in range(rounds):
        start = spark.sparkContext.broadcast(theta)
        rate = RATE / (1 + turn) ** 0.5

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights = start.value.copy()
            squares, done = np.full_like(weights, 1e-4), 0
            r = np.random.default_rng(turn)
            for ids, lens in _numbers(batches):
                places = Places(ids, lens, known.value)
                masked = r.permutation(np.flatnonzero(places.number % rounds == turn))
                for some in np.array_split(masked, max(-(-len(masked) // BATCH), min(STEPS, -(-len(masked) // 256)))) if len(masked) else ():
                    descend(weights, squares, places, some, rate)
                done += len(masked)
            yield _rows(done, weights)

        found = summed(encoded.mapInArrow(local, _ROWS), parts)
        if found is not None:
            theta = found[1].copy()
        start.unpersist()
    return theta


@dataclass
class Model:
    """counts: word, n of the corpus; least: the lowest bin of counts whose words the vocabulary holds."""

    vocabulary: Vocabulary
    theta: np.ndarray
    counts: DataFrame
    least: int


def fit(docs: DataFrame, known: int = KNOWN, rounds: int = ROUNDS) -> Model:
    """Counts, classes and weights from the column `text` of docs. Null and empty texts add nothing, repeated rows count each; without rows or words nothing is learnt."""
    batch_rows(docs.sparkSession)
    counts = stage(count_words(docs), "word-counts")
    v, least = known_words(counts, known)
    encoded = stage(encode(docs, v), "word-ids")
    parts = max(1, encoded.rdd.getNumPartitions())
    v = deal_classes(v, encoded, parts)
    return Model(v, train(encoded, v, parts, rounds), counts, least)


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Every row of docs with n_tokens, log_prob (the sum over its words) and mean_log_prob (null without words).

    Null and empty texts have no words: 0, 0.0 and null. A word that the corpus does not have counts as if it stood there once. Equal
    rows get equal scores; no rows give no rows. Columns of docs with the new names are replaced; keep_text: whether the text stays.
    """
    spark: SparkSession = docs.sparkSession
    batch_rows(spark)
    held_model = spark.sparkContext.broadcast((model.vocabulary, model.theta))  # bounded by KNOWN and the network's size
    new = ("n_tokens", "log_prob", "mean_log_prob")
    kept = [c for c in docs.columns if c not in new and (keep_text or c != text)]
    rest = [F.col(f"`{c}`") for c in kept]
    held = docs.select((F.struct(*rest) if rest else F.lit(None).cast("string")).alias("_row"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, theta = held_model.value
        log_n, rare = np.log(v.counts), np.log(v.rare_mass)
        for batch in batches:
            for rows, data, offsets in slices(batch):
                w = Words(data, offsets, ALNUM)
                ids = v.ids(w.hashes)
                p = log_probabilities(theta, Places(ids, w.counts, v))
                table = (ids >= len(v.place)) & (ids < KNOWN)
                p[table] += log_n[ids[table]] - rare
                joined = ids >= KNOWN
                p[joined] -= rare
                sums = np.concatenate([[0.0], np.cumsum(p)])
                total = sums[w.bounds[1:]] - sums[w.bounds[:-1]]
                total[w.counts == 0] = 0.0
                many = np.concatenate([[0], np.cumsum(joined)])[w.bounds]
                words = pa.ListArray.from_arrays(pa.array(many, pa.int32()), pa.array(w.hashes[joined].view(np.int64)))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(w.counts, pa.int64()), pa.array(total), words], ["_row", "n_tokens", "log_prob", "words"])

    scored = held.mapInArrow(run, T.StructType([held.schema.fields[0], T.StructField("n_tokens", T.LongType()), T.StructField("log_prob", T.DoubleType()), T.StructField("words", T.ArrayType(T.LongType()))]))
    scored = stage(scored.withColumn("_at", F.monotonically_increasing_id()), "scored")  # written, so that the numbers stay
    others = model.counts.where(_bin(F.col("n")) < model.least)
    more = scored.select("_at", F.explode("words").alias("word")).join(others, "word").groupBy("_at").agg(F.sum(F.log("n")).alias("more"))
    total = F.col("log_prob") + F.coalesce("more", F.lit(0.0))
    mean = F.when(F.col("n_tokens") > 0, total / F.col("n_tokens"))
    return scored.join(more, "_at", "left").select(*[F.col("_row")[c].alias(c) for c in kept], "n_tokens", total.alias("log_prob"), mean.alias("mean_log_prob"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, log_prob and mean_log_prob of every document, by a network trained on all of them. Null and empty texts: 0, 0.0, null; repeated rows each have a row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, fit(docs), keep_text=False)
