"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, verified once per pair.

Documents with equal shingle sets are one class and take part once. Shingle counts over all classes give the global
order: rarer shingles first, ties by hash. Two sets whose Jaccard similarity is at least t share a shingle among the first
|x| - ceil(t |x|) + 1 of each. Shingles of one class alone come first in that order and join nothing, so only the shared
shingles of the prefix are posted, and a class whose prefix has none is done.

1. sign        a scan gives each row its set's size and 128-bit digest; equal digests are one class, for which one row stands
2. count       a scan sends the distinct shingles of each run of rows, as sorted 64-bit hashes with their number in the run,
               to the hash bucket that sums them; those of two classes or more go back to their runs, with their counts
3. post        a scan orders the shared shingles of each row and posts those of its prefix, each with the length of what
               follows and a sketch of it: how many of the shingles after it fall into each of eight ranges of hashes
4. star round  every class is compared with one pivot, of the lists it is in the one that meets it most; links give components
5. join        lists that still hold two components are joined with themselves; pairs inside a component need no test.
               Pairs that pass the length, positional and suffix filters are verified once each
6. components  smallest reachable id by label propagation with pointer jumping

Rows are known by file and number in the file, so that the scans may be split in any way; each checks the digests of the first.
A shingle that very many rows have is counted once a run before it is sent, and its lists are joined in blocks. The star round
keeps a large group of near copies from being expanded into all its pairs; what it leaves is joined exactly,
so that no link between components is lost; similar_pairs() gives all links between classes. Hashes of 64 bits stand for shingles throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NON_SPACE, Words, batch_rows, cleanup, drop, fresh_dir, mix, released, run_hash, slices, stage

#: Shingles that a bucket should hold, and buckets at least; their number follows the corpus, and is above that of tasks, so that these get like shares.
BUCKET, BUCKETS = 1_000_000, 512
#: Shingles that a task packs at once.
PACK = 500_000
#: Neighbouring rows of a file that are a run, and rows whose places one file of the shared folder holds.
ROWS, PLACES = 4096, 1 << 20
#: Postings of a list in one block of a join; longer lists are joined block by block.
BLOCK = 4096
#: Bytes of text that a task hashes at once.
SLICE = 1 << 20
_U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the texts, and how many each has. A text of fewer than k words has its whole sequence as one, one without words none."""
    w = Words(data, offsets, NON_SPACE)
    per = np.where(w.counts >= k, w.counts - k + 1, np.minimum(w.counts, 1))
    edge = np.concatenate([[0], np.cumsum(per)])
    out = np.empty(edge[-1], _U)
    at, hashes = w.shingles(k)
    if len(at):
        of = w.of[at]
        out[edge[of] + at - w.bounds[of]] = hashes
    for short in range(1, k):
        mine = np.flatnonzero(w.counts == short)
        if len(mine):
            out[edge[mine]] = run_hash(w.hashes, short)[w.bounds[mine]]
    first = np.zeros(len(out), bool)
    first[edge[:-1][per > 0]] = True
    for a, b in zip(edge[:-1][per > 1].tolist(), edge[1:][per > 1].tolist(), strict=True):
        out[a:b].sort()
    if len(out):
        first[1:] |= out[1:] != out[:-1]
    kept = np.concatenate([[0], np.cumsum(first)])[edge]
    return out[first], np.diff(kept)


def _digests(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set."""
    out = []
    full = counts > 0
    starts = (np.cumsum(counts) - counts)[full]
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        d = np.zeros(len(counts), _U)
        if len(hashes):
            d[full] = np.add.reduceat(mix(hashes ^ _U(salt)), starts)
        out.append(mix(d + counts.astype(_U)).view(np.int64))
    return out[0], out[1]


def _planes(x: np.ndarray) -> bytes:
    """Bytes of the numbers, all first bytes first: runs that shuffles compress."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b""


def _from_planes(raw: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).reshape(-1) if raw else np.zeros(0, kind)


def _sorted_in(x: np.ndarray) -> bytes:
    return _planes(np.diff(x, prepend=_U(0)))


def _sorted_out(raw: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(raw, _U), dtype=_U)


def _plain_scan(df: DataFrame) -> bool:
    """Whether each row of df is one of a file: files, projections and filters only."""
    plan = df._jdf.queryExecution().optimizedPlan()
    names, open_ = set(), [plan]
    while open_:
        node = open_.pop()
        names.add(node.nodeName().split("(")[0].split(" ")[0])
        children = node.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return plan.deterministic() and "_metadata" not in df.columns and names <= {"Project", "Filter", "LogicalRelation", "Relation", "RelationV2"}


def row_keys(docs: DataFrame) -> DataFrame:
    """docs with _src (hash of the file's path) and _row (number in the file), the same however a scan is split. What is no plain scan of Parquet files is written first."""
    keys = [F.xxhash64("_metadata.file_path").alias("_src"), F.col("_metadata.row_index").alias("_row")]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("_src", "_row")]
    if _plain_scan(docs):
        try:
            return docs.select(*kept, *keys)
        except AnalysisException:  # files without row numbers
            pass
    return stage(docs.select(*kept), "rows").select(*kept, *keys)


def _signed(base: DataFrame, k: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, size=SLICE):
                hashes, counts = shingle_sets(data, offsets, k)
                a, b = _digests(hashes, counts)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), rows.column(3), pa.array(counts, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "src", "row", "n", "d1", "d2"])

    return base.mapInArrow(released(sign), "doc_id long, src long, row long, n long, d1 long, d2 long")


def _write(folder: str, src: int, block: int, arrays: list[np.ndarray]) -> None:
    """Arrays of 8-byte numbers, all of one length, as a file that appears when whole."""
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(f"{root}/{src}", recursive=True)
    own = f"{root}/{src}/.{block}-{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(own) as sink:
        for x in arrays:
            sink.write(np.ascontiguousarray(x).astype("<i8").tobytes())
    fs.move(own, f"{root}/{src}/{block}")


class _Files:
    """The last file read of a folder that _write filled."""

    def __init__(self, folder: str, columns: int) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.columns, self.at, self.held = columns, None, None

    def get(self, src: int, block: int) -> np.ndarray:
        if self.at != (src, block):
            path = f"{self.root}/{src}/{block}"
            raw = b""
            if self.fs.get_file_info(path).type == pafs.FileType.File:
                with self.fs.open_input_stream(path) as stream:
                    raw = stream.read()
            self.at, self.held = (src, block), np.frombuffer(raw, "<i8").reshape(self.columns, -1)
        return self.held


def _runs(src: np.ndarray, row: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(file, run, begin, end) of neighbouring rows."""
    run = row // ROWS
    cut = np.concatenate([[0], np.flatnonzero((np.diff(src) != 0) | (np.diff(run) != 0)) + 1, [len(row)]])
    return [(int(src[a]), int(run[a]), int(a), int(b)) for a, b in zip(cut, cut[1:], strict=False)] if len(row) else []


def _standing(batches: Iterator[pa.RecordBatch], places: _Files, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(file, run, ids of classes, their shingle hashes, how many each has) of the rows that stand for a class."""
    for batch in batches:
        for rows, data, offsets in slices(batch, size=SLICE):
            src, row = rows.column(2).to_numpy(), rows.column(3).to_numpy()
            hashes, counts = shingle_sets(data, offsets, k)
            first = None
            ends = np.cumsum(counts)
            for file, run, a, b in _runs(src, row):
                taken, digest, ids = places.get(file, run * ROWS // PLACES)
                if not len(taken):
                    continue
                at = np.minimum(np.searchsorted(taken, row[a:b]), len(taken) - 1)
                mine = taken[at] == row[a:b]
                if not mine.any():
                    continue
                first = _digests(hashes, counts)[0] if first is None else first
                if (first[a:b][mine] != digest[at[mine]]).any():
                    raise ValueError("the rows of a file have changed between two scans")
                begin = ends[a] - counts[a]
                keep = np.repeat(mine, counts[a:b])
                yield file, run, ids[at[mine]], hashes[begin : ends[b - 1]][keep], counts[a:b][mine]


def _note(taken: DataFrame) -> str:
    """Folder with the rows that stand for a class (src, row, d1, cid), a file for PLACES rows of an input file."""
    folder = fresh_dir(taken.sparkSession, "places")

    def note(table: pa.Table) -> pa.Table:
        src, row = table.column("src")[0].as_py(), table.column("row").to_numpy()
        by = np.argsort(row)
        _write(folder, src, int(row[0]) // PLACES, [table.column(c).to_numpy()[by] for c in ("row", "d1", "cid")])
        return pa.table({"src": [src]})

    taken.groupBy("src", F.floor(F.col("row") / PLACES).alias("block")).applyInArrow(note, "src long").agg(F.count("*")).collect()
    return folder


def _shared(base: DataFrame, places: str, k: int, buckets: int) -> str:
    """Folder with the shingles that two classes or more have, a file for each run of rows: their hashes in order, and in how many classes they are."""
    folder = fresh_dir(base.sparkSession, "shared")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        where, size = None, 0

        def flush() -> pa.RecordBatch:
            h, many = np.unique(np.concatenate(held), return_counts=True)
            number = ((h >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(h)]])
            spans = list(zip(cut, cut[1:], strict=False))
            file, run = (pa.array(np.full(len(spans), x, np.int64)) for x in where)
            return pa.RecordBatch.from_arrays([pa.array(number[cut[:-1]]), file, run, pa.array([_sorted_in(h[a:b]) for a, b in spans], pa.binary()), pa.array([_planes(many[a:b].astype(np.uint32)) for a, b in spans], pa.binary())], ["bucket", "src", "run", "hashes", "many"])

        for file, run, _, hashes, _ in _standing(batches, _Files(places, 3), k):
            if held and (where != (file, run) or size >= PACK):
                yield flush()
                held, size = [], 0
            where = (file, run)
            held.append(hashes)
            size += len(hashes)
        if size:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        h = [_sorted_out(x) for x in table.column("hashes").to_pylist()]
        of = np.repeat(np.arange(len(h), dtype=np.uint32), [len(x) for x in h])
        h = np.concatenate(h)
        by = np.argsort(h)
        h, of = h[by], of[by]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        total = np.add.reduceat(np.concatenate([_from_planes(x, np.uint32) for x in table.column("many").to_pylist()])[by].astype(np.int64), first)
        total = np.repeat(total, np.diff(np.append(first, len(h))))
        keep = total > 1
        h, of, total = h[keep], of[keep], np.minimum(total[keep], 2**32 - 1).astype(np.uint32)
        by = np.argsort(of, kind="stable")
        h, of, total = h[by], of[by], total[by]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(h)]]) if len(h) else np.zeros(1, np.int64)
        spans = list(zip(cut, cut[1:], strict=False))
        src, run = (table.column(c).to_numpy()[of[cut[:-1]]] if len(h) else np.zeros(0, np.int64) for c in ("src", "run"))
        return pa.table({"src": pa.array(src, pa.int64()), "run": pa.array(run, pa.int64()), "hashes": pa.array([_sorted_in(h[a:b]) for a, b in spans], pa.binary()), "totals": pa.array([_planes(total[a:b]) for a, b in spans], pa.binary())})

    def keep(table: pa.Table) -> pa.Table:
        h = np.concatenate([_sorted_out(x) for x in table.column("hashes").to_pylist()])
        h, first = np.unique(h, return_index=True)  # a run that two tasks share has a shingle twice
        total = np.concatenate([_from_planes(x, np.uint32) for x in table.column("totals").to_pylist()])[first]
        src, run = (table.column(c)[0].as_py() for c in ("src", "run"))
        _write(folder, src, run, [h.view(np.int64), total])
        return pa.table({"src": [src]})

    packed = base.mapInArrow(released(pack), "bucket long, src long, run long, hashes binary, many binary")
    shared = packed.groupBy("bucket").applyInArrow(count, "src long, run long, hashes binary, totals binary")
    shared.groupBy("src", "run").applyInArrow(keep, "src long").agg(F.count("*")).collect()
    return folder


def _ordered(base: DataFrame, places: str, shared: str, k: int, percent: int) -> DataFrame:
    """Of each class with a shared shingle in its prefix: id, n, u (shingles it has alone), prefix (shared shingles of the prefix, in global order), sketch (of what follows each), shingles (shared, by hash)."""
    schema = "id long, n long, u long, prefix binary, sketch binary, shingles binary"
    names = [x.split()[0] for x in schema.split(", ")]
    shifts = (_U(8) * np.arange(8, dtype=_U))[None, :]

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(shared, 2)
        for file, run, ids, hashes, counts in _standing(batches, _Files(places, 3), k):
            known, totals = files.get(file, run)
            if not len(known):
                continue
            known = known.view(_U)
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            found = np.flatnonzero(known[at] == hashes)
            of = np.repeat(np.arange(len(counts)), counts)[found]
            hashes, total = hashes[found], totals[at[found]]
            ends = np.searchsorted(of, np.arange(len(counts)), "right")
            out: dict[str, list] = {c: [] for c in names}
            a = 0
            for i, n, b in zip(ids.tolist(), counts.tolist(), ends.tolist(), strict=True):
                u = n - (b - a)
                first = n + percent * -n // 100 + 1 - u  # n - ceil(t n) + 1, without those it has alone
                if b > a and first > 0:
                    h = hashes[a:b]
                    ranked = h[np.lexsort((h, total[a:b]))]
                    part = (ranked >> _U(61)).astype(np.int64)
                    one = np.zeros((min(first, b - a), 8), np.int64)
                    one[np.arange(len(one)), part[: len(one)]] = 1
                    after = np.bincount(part, minlength=8) - np.cumsum(one, axis=0)
                    out["id"].append(i)
                    out["n"].append(n)
                    out["u"].append(u)
                    out["prefix"].append(ranked[: len(one)].tobytes())
                    out["sketch"].append((np.minimum(after, 255).astype(_U) << shifts).sum(1, dtype=_U).tobytes())
                    out["shingles"].append(_sorted_in(h))
                a = b
            yield pa.RecordBatch.from_arrays([pa.array(out[c], pa.int64() if c in ("id", "n", "u") else pa.binary()) for c in names], names)

    return base.mapInArrow(released(order), schema)


def _postings(sets: DataFrame) -> DataFrame:
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes, sketches = ([np.frombuffer(x, np.int64) for x in batch.column(c).to_pylist()] for c in (3, 4))
            many = np.array([len(x) for x in prefixes], np.int64)
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            ids, n, u = (np.repeat(batch.column(c).to_numpy(), many) for c in (0, 1, 2))
            one = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (prefixes, sketches)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one[0], ids, n, u, u + at, one[1])], ["shingle", "id", "n", "u", "pos", "sketch"])

    return sets.select("id", "n", "u", "prefix", "sketch").mapInArrow(released(post), "shingle long, id long, n long, u long, pos long, sketch long")


def _may_link(a: str, b: str, percent: int) -> Column:
    """The length, positional and suffix filters.

    What two sets still share from this shingle on is at most the shorter rest, and, if it is the first that they share, one and the smaller
    number of each range of what follows. A pair that is similar enough passes at the first shingle that it shares.
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos"))
    after = F.lit(1)
    for i in range(8):
        x, y = (F.shiftrightunsigned(F.col(f"{c}.sketch"), 8 * i).bitwiseAND(F.lit(255)) for c in (a, b))
        after = after + F.when((x == 255) & (y == 255), left).otherwise(F.least(x, y))  # 255: so many or more
    needed = percent * (n + m)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * left >= needed) & ((100 + percent) * after >= needed)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough."""
    one = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    two = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            known: tuple[bytes, np.ndarray] = (b"", np.zeros(0, _U))
            for i, (na, ra, nb, rb) in enumerate(zip(*[batch.column(j).to_pylist() for j in (2, 3, 4, 5)], strict=True)):
                if ra != known[0]:
                    known = (ra, _sorted_out(ra))
                x, y = known[1], _sorted_out(rb)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                same = int((x[at] == y).sum())
                keep[i] = 100 * same >= percent * (na + nb - same)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    return pairs.select("a", "b").join(one, "b").join(two, "a").select("a", "b", "na", "sa", "nb", "sb").mapInArrow(released(verify), "a long, b long")


def _met(postings: DataFrame, percent: int, apart: Column | None = None) -> DataFrame:
    """Distinct pairs (a, b) of postings that meet in a list and pass the filters; apart: which pairs at all (of x and y, a < b else).

    A list of more than BLOCK postings is cut into blocks by a hash of the id, and one of each two postings goes to all of them.
    """
    blocks = postings.groupBy("shingle").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = postings.join(blocks, "shingle")
    left = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    right = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = left.alias("x").join(right.alias("y"), ["shingle", "block"]).where(F.col("x.id") < F.col("y.id") if apart is None else apart).where(_may_link("x", "y", percent))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that links reach, for the nodes of links (a, b). Links may repeat and point either way."""
    edges = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stage(edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        near = near.join(labels, "node").select("node", "label", F.least("low", "label").alias("next"))
        near = stage(near, "labels")
        # pointer jumping: the label of the label
        jump = near.select(F.col("node").alias("next"), F.col("next").alias("far"))
        new = stage(near.join(jump, "next").select("node", "label", F.least("next", "far").alias("new")), "labels")
        changed = new.where("new <> label").limit(1).count()
        labels = new.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def _classes(base: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(signed rows, classes of equal sets with the row that stands for each and a number, cid)."""
    signed = stage(_signed(base, k), "signed")
    found = signed.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "src", "row", "n")).alias("s"), F.count("*").alias("copies"))
    # written, so that the numbers stay
    return signed, stage(found.select("d1", "d2", F.col("s.doc_id").alias("id"), "s.src", "s.row", "s.n", "copies").withColumn("cid", F.monotonically_increasing_id()), "classes")


def _sets(base: DataFrame, classes: DataFrame, k: int, percent: int, bucket: int) -> DataFrame:
    total = classes.agg(F.sum("n")).first()[0] or 0
    places = _note(classes.select("src", "row", "d1", "cid"))
    shared = _shared(base, places, k, max(BUCKETS, total // bucket))
    sets = stage(_ordered(base, places, shared, k, percent), "sets")
    cleanup(places, shared)
    return sets


def _prepared(docs: DataFrame) -> DataFrame:
    batch_rows(docs.sparkSession)
    plain = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return docs.select(*plain, "_src", "_row") if {"_src", "_row"} <= set(docs.columns) else row_keys(docs.select(*plain))


def similar_pairs(docs: DataFrame, k: int = 5, percent: int = 75, bucket: int = BUCKET) -> DataFrame:
    """a, b (a <= b): the smallest doc_ids of any two classes of equal sets that link. Sets, links and odd rows as in similarity_join.

    All links are tested, also those inside a group of near copies, whose number is the square of its different texts.
    """
    base = _prepared(docs)
    _, classes = _classes(base, k)
    sets = _sets(base, classes, k, percent, bucket)
    links = _verified(_met(stage(_postings(sets), "postings"), percent), sets, percent)
    one, two = (classes.select(F.col("cid").alias(c), F.col("id").alias(f"id_{c}")) for c in ("a", "b"))
    return links.join(one, "a").join(two, "b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))


def similarity_join(docs: DataFrame, k: int = 5, percent: int = 75, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_shingles, component_id, stays, _src and _row, one row for each row of docs (doc_id, text; other columns are left out).

    A set has the distinct runs of k words of the whole text (words: non-white-space runs, A-Z as a-z); a text of fewer words has its whole
    sequence as one; null, empty or blank texts have none and link with nothing. Two rows link where 100 * |x and y| >= percent * |x or y|.
    component_id: the smallest doc_id that links reach, the own included. Repeated rows are copies of each other; rows of one doc_id with other texts are rows of their own. Rows with a null doc_id take no part
    and have a null component_id. stays: of each component the row with the smallest doc_id (of several, one), and all rows
    that take no part. _src and _row are the keys of row_keys(docs). No rows give no rows.
    """
    base = _prepared(docs)
    signed, classes = _classes(base, k)
    sets = _sets(base, classes, k, percent, bucket)
    postings = stage(_postings(sets), "postings")

    # star round
    pivots = postings.groupBy("shingle").agg(F.min(F.struct("u", "id", "n", "pos", "sketch")).alias("p"), F.count("*").alias("many")).where("many > 1")
    pivots = stage(pivots.select("shingle", "p.id", "p.n", "p.pos", "p.sketch"), "pivots")
    met = postings.alias("x").join(pivots.alias("p"), "shingle").where(F.col("x.id") != F.col("p.id")).where(_may_link("x", "p", percent))
    met = met.groupBy(F.col("x.id").alias("b"), F.col("p.id").alias("a")).agg(F.count("*").alias("times"))
    stars = met.groupBy("b").agg(F.max(F.struct("times", (-F.col("a")).alias("a"))).alias("m")).select("b", (-F.col("m.a")).alias("a"))
    labels = components(stage(_verified(stars, sets, percent), "links"))

    # what the star round left: pairs of different components
    known = postings.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    known = stage(known, "labelled")
    mixed = stage(known.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("shingle"), "mixed")
    live = stage(known.join(mixed, "shingle", "left_semi"), "live")
    more = stage(_verified(_met(live, percent, F.col("x.label") < F.col("y.label")), sets, percent), "links")
    if not more.isEmpty():
        labels = components(more.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))

    # classes that have copies, or are linked, have a row that stands for the component
    moved = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").where("copies > 1 or label is not null").withColumn("label", F.coalesce("label", "cid"))
    moved = stage(moved.select("d1", "d2", "label", "id", "src", "row"), "moved")
    heads = moved.groupBy("label").agg(F.min(F.struct("id", "src", "row")).alias("head"))
    heads = stage(moved.join(heads, "label").select("d1", "d2", "head"), "heads")
    drop(classes, sets, postings, pivots, known, mixed, live, more, moved)
    found = signed.join(heads, ["d1", "d2"], "left")
    part = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    component = F.when(part, F.coalesce("head.id", "doc_id")).when(F.col("n") == 0, F.col("doc_id"))
    stays = ~part | F.col("head").isNull() | ((F.col("head.src") == F.col("src")) & (F.col("head.row") == F.col("row")))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), stays.alias("stays"), F.col("src").alias("_src"), F.col("row").alias("_row"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; nulls, empty texts and repeated rows as in similarity_join."""
    return similarity_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y)
SELECT r.x AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.y) AS component_id
FROM reach r LEFT JOIN n ON n.doc_id = r.x GROUP BY r.x
"""
