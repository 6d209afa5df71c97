"""Toxicity: a linear classifier over character n-grams, features scaled by naive Bayes log-count ratios.

Texts are lower-cased (ASCII) and runs of white space become one space. Features are the n-grams of 3 to 6
characters (code points), hashed into 2**18, each counted once a text. A feature's value is its log-count ratio between the classes
(add-one smoothed document counts; ratios near 1 and features of fewer than three texts are left out); logistic
regression with L2 is trained on these values by full-batch accelerated gradient steps. Training takes at most MAX_LABELLED labelled rows (by hash
of doc_id, the same share of each class as there is); scoring takes every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_rows, released, slices, utf8

BITS = 18
LENGTHS = (3, 4, 5, 6)
#: Bound of the labelled rows that the classifier is fitted on, and of their bytes (beyond it, rows are left out whole).
MAX_LABELLED = 4000
MAX_LABELLED_BYTES = 8 << 20

#: A feature counts if so many training texts have it and its classes' rates differ by this factor (as a logarithm).
LEAST_TEXTS = 3
LEAST_RATIO = 1.0

_LOWER = np.arange(128, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts, A-Z as a-z and runs of white space as one space, and where each text starts. Bytes that are no UTF-8 become U+FFFD."""
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    raw = data.tobytes()
    points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) != at[-1]:
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:], strict=False)]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        at = np.cumsum([0, *map(len, texts)])
    points = np.where(points < 128, _LOWER[np.minimum(points, 127)], points)
    space = points == 32
    again = np.flatnonzero(space[1:] & space[:-1]) + 1
    if len(again):
        again = again[~np.isin(again, at)]
        at = at - np.searchsorted(again, at)
        points = np.delete(points, again)
    return points, at


def features(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the distinct hashed n-grams that are wanted (flags): ids in the order of texts, and how many each has."""
    n = len(offsets) - 1
    points, offsets = characters(data, offsets)
    codes = ((points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(31)).astype(np.uint32)
    rolling, found = codes, []
    for length in range(2, max(LENGTHS) + 1):
        rolling = rolling[:-1] * np.uint32(0x85EBCA6B) + codes[length - 1 :] if len(rolling) else rolling
        if length in LENGTHS:
            ids = (rolling ^ (rolling >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)
            at = np.flatnonzero(wanted[ids])
            text = np.searchsorted(offsets, at, "right") - 1
            inside = at + length <= offsets[text + 1]
            found.append((text[inside] << BITS) | ids[at[inside]].astype(np.int64))
    keys = np.unique(np.concatenate(found))
    return keys & ((1 << BITS) - 1), np.bincount(keys >> BITS, minlength=n)


def _sums(weights: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(weights[ids])])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def fit(texts: list[str], labels: np.ndarray, steps: int = 60, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weight of each hashed feature (log-count ratio times coefficient), and the intercept. With one class alone all weights are 0 and the score is 0 or 1; with no rows it is a quarter."""
    size = 1 << BITS
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return np.zeros(size), -float(np.log(3)) if not len(y) else (40.0 if y[0] else -40.0)
    every, held, p, seen = np.ones(size, bool), [], np.zeros(size), np.zeros(size)
    for begin in range(0, len(texts), 100):
        i, c = features(*utf8(pa.array(texts[begin : begin + 100])), every)
        p += np.bincount(i, weights=np.repeat(y[begin : begin + 100], c), minlength=size)
        seen += np.bincount(i, minlength=size)
        held.append((i.astype(np.int32), c))
    ratio = np.log(((1 + p) / (1 + y.sum())) / ((1 + seen - p) / (1 + (1 - y).sum())))
    used = (np.abs(ratio) >= LEAST_RATIO) & (seen >= LEAST_TEXTS)
    ratio[~used] = 0
    # only what is used stays, chunk by chunk
    for n, (i, c) in enumerate(held):
        keep = used[i]
        held[n] = (i[keep], np.bincount(np.repeat(np.arange(len(c)), c)[keep], minlength=len(c)))
    ids, counts = (np.concatenate(x) for x in zip(*held, strict=True))
    of = np.repeat(np.arange(len(y)), counts)
    column = np.flatnonzero(used)
    ids = np.searchsorted(column, ids)
    ratio = ratio[column]
    value = ratio[ids]
    w, b = np.zeros(len(column)), float(np.log(y.mean() / (1 - y.mean())))
    # the logistic curvature is at most a quarter of the mean row sum of squares times the rows
    rate = 4.0 / (len(y) + np.bincount(of, weights=value * value, minlength=len(y)).sum())
    at_w, at_b, t = w, b, 1.0
    for _ in range(steps):
        z = np.clip(_sums(ratio * at_w, ids, counts) + at_b, -40, 40)
        g = 1 / (1 + np.exp(-z)) - y
        gw = ratio * np.bincount(ids, weights=np.repeat(g, counts), minlength=len(column)) + l2 * len(y) * at_w
        new_w, new_b, new_t = at_w - rate * gw, at_b - rate * g.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        at_w, at_b = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    out = np.zeros(size)
    out[column] = ratio * w
    return out, b


def train(docs: DataFrame, labels: DataFrame, where=None) -> tuple[np.ndarray, float]:
    """Fits on labelled documents (labels: doc_id, toxic). where: which label rows may be learned from.

    Of those rows, at most MAX_LABELLED by hash of doc_id are taken, in either class in proportion; null ids, labels and texts are left out,
    repeated rows count once, and a text that does not fit in what is left of MAX_LABELLED_BYTES is left out alone. Without any the model is that of no rows.
    """
    spark = docs.sparkSession
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = (known.where(where) if where is not None else known).distinct()
    wanted = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(MAX_LABELLED).toPandas()  # bounded by the parameter
    chosen = spark.createDataFrame(wanted, "doc_id long, toxic int")
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    found = held.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", F.xxhash64("text").alias("h"), F.octet_length("text").alias("size")).distinct()
    takes, room = [], MAX_LABELLED_BYTES
    for row in found.orderBy(F.xxhash64("doc_id", "h"), "doc_id", "h", "toxic").limit(MAX_LABELLED).collect():  # numbers only
        if row["size"] <= room:
            room -= row["size"]
            takes.append((row["doc_id"], row["toxic"], row["h"]))
    taken = spark.createDataFrame(takes, "doc_id long, toxic int, h long")
    # at most MAX_LABELLED_BYTES of text
    rows = sorted({(x["doc_id"], x["toxic"], x["text"]) for x in held.join(F.broadcast(taken), "doc_id").where(F.xxhash64("text") == F.col("h")).dropDuplicates(["doc_id", "toxic", "h"]).collect()})
    rows = [(text, label) for _, label, text in rows]
    return fit([x for x, _ in rows], np.array([y for _, y in rows]))


def score(docs: DataFrame, weights: np.ndarray, intercept: float, text: str = "text") -> DataFrame:
    """Every row of docs with score (double, 0 to 1) and predicted (int, 1 from 0.5 on).

    Null and empty texts have no features, so they score the intercept. Equal texts score alike; no rows give no rows. Columns of docs named
    score or predicted are replaced; other columns stay as they are.
    """
    spark = docs.sparkSession
    batch_rows(spark)
    model = spark.sparkContext.broadcast((weights.astype(np.float64), intercept))
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept if c != text] or [F.lit(1).alias("_")]).alias("_row"), F.col(f"`{text}`").alias("text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        wanted = w != 0
        for batch in batches:
            for rows, data, offsets in slices(batch, size=1 << 20):
                z = np.clip(_sums(w, *features(data, offsets, wanted)) + b, -40, 40)
                s = 1 / (1 + np.exp(-z))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["_row", "text", "score", "predicted"])

    out = held.mapInArrow(released(apply), T.StructType([*held.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
    return out.select(*[F.col("text").alias(c) if c == text else F.col("_row")[c].alias(c) for c in kept], "score", "predicted")


#: Rows that the query may learn from: crc32 of the id as text, modulo 5, is not 0.
LEARN = "crc32(cast(doc_id as string)) % 5 <> 0"


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out (false for a null doc_id), score and predicted of every document, repeated rows each. Null and empty texts score the intercept; without labels all score a quarter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), LEARN)
    held_out = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(False))
    return score(docs, *model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
