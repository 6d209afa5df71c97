"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, in blocks: integer inner products of vectors quantised to
floor(256 * x). The kth score of each query is located by histograms: a pass scores everything and counts, for each
query, the scores of each bin of its range; the bins are summed over all tasks, the one that holds the kth score
becomes the next range, until it is one integer wide. A last pass keeps what lies above, and of ties at the kth score
the smallest ids. A task sends only those bins that its own k best scores reach, as lower ones cannot hold the
global kth; of ties it sends as many as can still be needed. Both leave the result exact.

Queries go out in blocks of a bounded number of vectors and values (QUERIES, QUERY_VALUES), one broadcast each; candidates are never
shuffled or collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_dir, stage

BINS = 2048
#: Most vector components in one block of queries: 4M are 32 MB.
QUERY_VALUES = 4_000_000
#: Most queries in a block: their histograms take 2048 * BINS * 8 bytes, 32 MB a task.
QUERIES = 2048
#: Scores that a task holds at once.
HELD = 1 << 20


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component as long; null where the vector or a component is null or not finite."""
    x = vector.cast("array<double>")
    good = vector.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.when(good, F.transform(x, lambda v: F.floor(v * 256)))


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: by doubles where no partial sum can pass 2**53, else by longs."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2.0**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _scored(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(scores, may count, candidate ids) of blocks of candidates."""
    step = max(1, HELD // max(1, len(q)))
    for batch in batches:
        c, v = batch.column(0).to_numpy(), _vectors(batch.column(1), width)
        for b in range(0, len(c), step):
            yield _scores(q, v[b : b + step]), ids[:, None] != c[None, b : b + step], c[b : b + step]


def _kth(candidates: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the kth largest score, and how many ties at it belong to the result (0 and the least score where there are fewer than k)."""
    spark = candidates.sparkSession
    n, width = q.shape
    lo = np.full(n, -reach, np.int64)
    span = np.full(n, 2 * reach + 1, np.int64)
    need = np.full(n, k, np.int64)
    open_ = np.ones(n, bool)
    while open_.any():
        bin_width = -(-span // BINS)
        held = spark.sparkContext.broadcast((ids[open_], q[open_], lo[open_], span[open_], bin_width[open_], need[open_]))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, lo, span, bin_width, need = held.value
            total = np.zeros((len(ids), BINS), np.int64)
            flat = total.reshape(-1)
            row = (np.arange(len(ids)) * BINS)[:, None]
            for scores, other, _ in _scored(batches, ids, q, width):
                scores = scores - lo[:, None]
                keep = other & (scores >= 0) & (scores < span[:, None])
                at, many = np.unique((scores // bin_width[:, None] + row)[keep], return_counts=True)
                flat[at] += many
            above = np.cumsum(total[:, ::-1], axis=1)[:, ::-1] - total  # in higher bins
            i, b = np.nonzero((total > 0) & (above < need[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(b), pa.array(total[i, b])], ["i", "bin", "n"])

        counts = candidates.mapInArrow(count, "i long, bin long, n long").groupBy("i", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(W.partitionBy("i").orderBy(F.desc("bin"))) - F.col("n")
        where = np.flatnonzero(open_)
        left = F.element_at(F.lit([int(x) for x in need[where]]), (F.col("i") + 1).cast("int")) if len(set(need[where])) > 1 else F.lit(int(need[where][0]))
        row = counts.withColumn("above", above).withColumn("need", left - F.col("above")).where("need > 0 and need <= n").toPandas()  # a row for each query of the block
        short = np.ones(len(where), bool)
        short[row["i"]] = False
        open_[where[short]] = False
        need[where[short]] = np.iinfo(np.int32).max  # fewer than k candidates: all belong to the result
        lo[where[short]] = -reach
        at = where[row["i"].to_numpy()]
        lo[at] += row["bin"].to_numpy() * bin_width[at]
        need[at] = row["need"].to_numpy()
        span[at] = np.minimum(bin_width[at], span[at])
        open_[at] = span[at] > 1
        held.destroy()
    return lo, need


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, query_values: int = QUERY_VALUES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each query, by score and then smaller vec_id.

    vectors: vec_id and embedding. Queries: distinct vec_ids divisible by `every` (of rows with the same id, the one
    with the smallest vector). Candidates: every row with another id. Rows with a null id or a vector that is null or
    holds null, NaN or infinite components take no part. A query is scored against vectors of its own length only.
    Repeated candidate rows each count. Products beyond 64 bits wrap. No rows give no rows.
    """
    spark: SparkSession = vectors.sparkSession
    held = stage(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v")).where("vec_id is not null and v is not null").withColumn("width", F.size("v")), "vectors")
    # |score| is at most the product of the largest lengths
    widths = held.groupBy("width").agg(F.max(F.aggregate("v", F.lit(0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("norm")).orderBy("width").collect()  # a row for each length of a vector
    folder, solved = fresh_dir(spark, "best"), 0
    for width, norm in widths:
        candidates = held.where(F.col("width") == width).select("vec_id", "v")
        queries = candidates.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id")
        reach = min(int(norm) + 1, 2**62 - 1)
        ids, rows = [], []
        block = max(1, min(QUERIES, query_values // max(1, width)))

        def solve(ids: list[int], rows: list[list[int]]) -> None:
            """Writes what a block of queries finds; nothing of it stays with driver or executors."""
            nonlocal solved
            i, q = np.array(ids, np.int64), np.array(rows, np.int64).reshape(len(ids), width)
            least, need = _kth(candidates, i, q, k, reach)
            held = spark.sparkContext.broadcast((i, q, least, need))

            def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                i, q, least, need = held.value
                out, ties = [], []
                for scores, other, c in _scored(batches, i, q, width):
                    a, b = np.nonzero(other & (scores > least[:, None]))
                    out.append((i[a], c[b], scores[a, b]))
                    a, b = np.nonzero(other & (scores == least[:, None]))
                    ties.append((a, c[b]))
                    if sum(len(x) for x, _ in ties) > HELD:
                        ties = [_fewest(ties, need)]
                a, c = _fewest(ties, need)
                out.append((i[a], c, least[a]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

            candidates.mapInArrow(keep, "query_id long, vec_id long, score long").write.mode("append").parquet(folder)
            held.destroy()
            solved += 1

        for row in queries.toLocalIterator():
            ids.append(row["vec_id"])
            rows.append(row["v"])
            if len(ids) == block:
                solve(ids, rows)
                ids, rows = [], []
        if ids:
            solve(ids, rows)
    kind = "query_id long, vec_id long, score long"
    found = spark.read.schema(kind).parquet(folder) if solved else spark.createDataFrame([], kind)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _fewest(ties: list[tuple[np.ndarray, np.ndarray]], need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each query's ties those with the smallest ids, as many as are needed."""
    if not ties:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, c = (np.concatenate(x) for x in zip(*ties, strict=True))
    order = np.lexsort((c, a))
    a, c = a[order], c[order]
    at = np.arange(len(a)) - np.searchsorted(a, a)
    return a[at < need[a]], c[at < need[a]]


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id and score of the five best candidates of each vec_id divisible by 50; nulls, repeats and ties as in top_k."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), k=5, every=50)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
