"""Benchmark decontamination by a prefix-filtered set join.

A window is `n` consecutive words of a benchmark item (the whole item, where it has fewer words). It occurs
in a document only if each of its shingles does: containment 1.0, so the necessary prefix of its shingles in
rare-first order is one, the rarest. Shingle rarity is counted over all documents. Documents are probed with
the prefix shingles alone; a hit at word i that is the window's shingle number j puts the window at i - j,
which must lie inside the document (length and positional bounds); then all words of the window are compared.

Benchmark items go to the executors in blocks of a bounded number of words, one broadcast each: a larger
benchmark makes more blocks, never a larger one, and what one has found is written before the next goes out. Documents are
not shuffled; each keeps its row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Words, batch_rows, drop, list_array, ragged, released, run_hash, slices, stage, utf8

#: Consecutive words that are looked up first; a window shorter than this is its own shingle.
SHINGLE = 3
#: Most words of benchmark items in one broadcast: 1M words are some 80 MB with all tables.
BLOCK_WORDS = 1_000_000


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Items as (ids, word hashes, bounds), streamed to the driver; none has more than block_words, save for a longer single item."""
    ids: list[str] = []
    parts: list[np.ndarray] = []
    held = 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("id"), "text").where("item_id is not null and text is not null").distinct().toLocalIterator():
        data, offsets = utf8(pa.array([row["text"]]))
        words = Words(data, offsets, ALNUM).hashes
        if not len(words):
            continue
        if held and held + len(words) > block_words:
            yield ids, np.concatenate(parts), np.cumsum([0, *map(len, parts)])
            ids, parts, held = [], [], 0
        ids.append(row["id"])
        parts.append(words)
        held += len(words)
    if parts:
        yield ids, np.concatenate(parts), np.cumsum([0, *map(len, parts)])


class Windows:
    """The distinct windows of a block of items, and the shingles of each."""

    def __init__(self, ids: list[str], words: np.ndarray, bounds: np.ndarray, n: int):
        self.ids, self.words = np.array(ids, object), words
        counts = np.diff(bounds)
        size = np.minimum(counts, n)
        per = counts - size + 1
        self.item = np.repeat(np.arange(len(ids)), per)
        self.size = np.repeat(size, per)
        self.start = ragged(bounds[:-1], per)
        # every shingle of every window: (window, offset, hash)
        k = np.minimum(self.size, SHINGLE)
        per = self.size - k + 1
        self.of = np.repeat(np.arange(len(self.start)), per)
        self.offset = ragged(np.zeros(len(per), np.int64), per)
        at = self.start[self.of] + self.offset
        self.hash = np.zeros(len(at), np.uint64)
        for length in np.unique(k):
            whole = run_hash(words, int(length)) if len(words) >= length else np.zeros(0, np.uint64)
            mine = k[self.of] == length
            self.hash[mine] = whole[at[mine]]
        self.lengths = [int(x) for x in np.unique(k)]
        self.keys = np.unique(self.hash)

    def prefix(self, counts: np.ndarray) -> None:
        """Keep each window's rarest shingle (counts: of self.keys in all documents; ties to the smaller hash, then offset)."""
        at = np.searchsorted(self.keys, self.hash)
        order = np.lexsort((self.offset, self.hash, counts[at], self.of))
        first = order[np.concatenate([[True], np.diff(self.of[order]) > 0])] if len(order) else order
        first = first[np.argsort(self.hash[first], kind="stable")]
        self.probe_hash, self.probe_window, self.probe_offset = self.hash[first], self.of[first], self.offset[first]
        del self.hash, self.of, self.offset

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(window, word where it starts) of every occurrence in the texts."""
        found_w, found_s = [], []
        for k in self.lengths:
            at, hashes = words.shingles(k)
            lo = np.searchsorted(self.probe_hash, hashes, "left")
            hit = np.flatnonzero(self.probe_hash[np.minimum(lo, len(self.probe_hash) - 1)] == hashes)
            if not len(hit):
                continue
            lo = lo[hit]
            many = np.searchsorted(self.probe_hash, hashes[hit], "right") - lo
            probe = ragged(lo, many)
            w, s = self.probe_window[probe], np.repeat(at[hit], many) - self.probe_offset[probe]
            text = words.of[np.repeat(at[hit], many)]
            fits = (np.minimum(self.size[w], SHINGLE) == k) & (s >= words.bounds[text]) & (s + self.size[w] <= words.bounds[text + 1])
            w, s = w[fits], s[fits]
            for j in range(int(self.size[w].max(initial=0))):
                inside = j < self.size[w]
                same = ~inside
                same[inside] = words.hashes[s[inside] + j] == self.words[self.start[w[inside]] + j]
                w, s = w[same], s[same]
            found_w.append(w)
            found_s.append(s)
        return (np.concatenate(found_w), np.concatenate(found_s)) if found_w else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _counts(docs: DataFrame, windows, keys: np.ndarray) -> np.ndarray:
    """Occurrences in all documents of each key."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = windows.value
        total = np.zeros(len(block.keys), np.int64)
        for batch in batches:
            for _, data, offsets in slices(batch):
                words = Words(data, offsets, ALNUM)
                for k in block.lengths:
                    _, hashes = words.shingles(k)
                    at = np.minimum(np.searchsorted(block.keys, hashes), len(block.keys) - 1)
                    total += np.bincount(at[block.keys[at] == hashes], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["key", "n"])

    out = np.zeros(len(keys), np.int64)
    for key, n in docs.select("text").mapInArrow(released(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():  # at most a row for each key of the block
        out[key] = n
    return out


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_NEW = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", _SPAN)])


def _merged(start: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges, as ranges; those of neighbouring texts (bounds: where texts begin) stay apart though they touch."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    text = np.searchsorted(bounds, start, "right")
    first = np.concatenate([[True], (start[1:] > end[:-1]) | (text[1:] != text[:-1])])
    last = np.concatenate([first[1:], [True]])
    return start[first], end[last]


def _probe(rows_in: DataFrame, windows) -> DataFrame:
    """Adds the block's occurrences to those that each row carries from the blocks before (columns n_words to spans)."""
    fresh = "spans" not in rows_in.columns
    base = rows_in.schema.fields[:2]
    schema = T.StructType([*base, *_NEW.fields])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = windows.value if windows is not None else None
        for batch in batches:
            for rows, data, offsets in slices(batch):
                words = Words(data, offsets, ALNUM)
                n, none = rows.num_rows, np.zeros(0, np.int64)
                w, s = block.find(words) if block is not None else (none, none)
                start, end = s, s + (block.size[w] if block is not None else 0)
                doc = words.of[s] if len(s) else none
                pairs = np.unique(np.stack([doc, block.item[w] if block is not None else none], 1), axis=0)
                items = list_array(np.bincount(pairs[:, 0], minlength=n), pa.array(block.ids[pairs[:, 1]] if len(pairs) else [], pa.string()))
                if not fresh:
                    old = rows.column(5)
                    base_at = np.repeat(words.bounds[:-1], np.diff(old.offsets.to_numpy()))
                    start = np.concatenate([start, old.flatten().field(0).to_numpy() + base_at])
                    end = np.concatenate([end, old.flatten().field(1).to_numpy() + base_at])
                    items = pa.array([[*a, *b] for a, b in zip(rows.column(4).to_pylist(), items.to_pylist(), strict=True)], items.type)
                start, end = _merged(start, end, words.bounds)
                doc = words.of[start] if len(start) else none
                many, at = np.bincount(doc, minlength=n), words.bounds[doc]
                spans = list_array(many, pa.StructArray.from_arrays([pa.array(start - at, pa.int32()), pa.array(end - at, pa.int32())], ["start", "end"]))
                hits = np.bincount(doc, weights=end - start, minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(words.counts, pa.int64()), pa.array(hits), items, spans], [f.name for f in schema])

    return rows_in.mapInArrow(released(find), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every row of docs with n_words, n_hit, items (sorted ids) and spans (merged [start, end) word ranges that are hit).

    docs: any columns, the text in column `text`; benchmark: item_id and text. Null or empty texts have no
    words and no hits. Items that are null or without words match nothing. Repeated items or windows count once
    for an id; ids compare as strings. Columns of docs that bear the new names are replaced. An empty benchmark
    leaves all rows with no hits; no rows give no rows.
    """
    spark: SparkSession = docs.sparkSession
    batch_rows(spark)
    new = _NEW.names
    kept = [c for c in docs.columns if c not in new and c != text]
    rest = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.lit(None).cast("string")
    held = docs.select(rest.alias("_row"), F.col(f"`{text}`").cast("string").alias("text"))
    out, sent, before = held, None, None
    for ids, words, bounds in _blocks(benchmark, block_words):
        if sent is not None:  # what the block before has found is written, so that one block is held at a time
            out, old = stage(out, "found"), before
            before = out
            sent.destroy()
            if old is not None:
                drop(old)
        block = Windows(ids, words, bounds, n)
        keys = spark.sparkContext.broadcast(block)
        counts = _counts(held, keys, block.keys)
        keys.destroy()
        block.prefix(counts)
        sent = spark.sparkContext.broadcast(block)
        out = _probe(out, sent)
    if sent is None:
        out = _probe(held, None)
    back = [F.col("text").alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns if c not in new]
    return out.select(*back, "n_words", "n_hit", F.array_sort(F.array_distinct("items")).alias("items"), "spans")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document, repeated rows each; null and empty texts have no words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
i AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (
  SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS k
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r, p, n, item FROM runs JOIN win USING (n, k)),
words AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
