"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut into segments that no piece crosses; the distinct new segments are concatenated and indexed by a
suffix array (prefix doubling, 16 bytes deep). Every piece of the vocabulary is looked up by binary
search, which gives the range of its occurrences; the occurrences are edges from their start to their end. The edges,
sorted by where they end within their segment, are relaxed in that order.

For a BPE model the relaxation keeps, for each end, the one edge whose piece is what merging by rank would have left there:
a sequence of pieces is the BPE result if and only if no two neighbours would have merged across their boundary before
they were whole. That is decided for a pair from the pieces' own merge trees. Characters without a piece become the byte
pieces of their UTF-8 form. Results equal those of the sentencepiece library.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_rows, list_array, mix, ragged, released, slices, utf8

_META = b"\xe2\x96\x81"
_FAR = np.int64(1 << 40)
#: Segments whose pieces a worker remembers; beyond it the memory is emptied (which changes the time only).
REMEMBERED = 600_000
#: Bytes that suffixes are ordered by; of longer pieces the rest is compared within the range of their first bytes.
DEPTH = 16
#: Slots of the memory of decided pairs.
PAIRS = 1 << 20


@dataclass
class Model:
    """A vocabulary as arrays. Piece bytes have a space for the meta symbol."""

    blob: np.ndarray
    start: np.ndarray
    size: np.ndarray
    order: np.ndarray  # of merges: -1 for single characters, else the rank of the merge that makes the piece
    left: np.ndarray
    right: np.ndarray
    usable: np.ndarray  # ids that matching may give
    byte_ids: np.ndarray
    pair_keys: np.ndarray  # sorted: left id * n + right id, of neighbours that can merge
    pair_rank: np.ndarray
    breaks: np.ndarray  # 256 flags: bytes that no piece has, which stand alone

    @property
    def n(self) -> int:
        return len(self.size)


def _merged(parts: list[bytes], rank: dict[bytes, int]) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
    """BPE by rank, leftmost first among equals; and the last merge."""
    last = None
    while len(parts) > 1:
        best, at = min(((rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
        if best == 1 << 60:
            break
        last = (parts[at], parts[at + 1])
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts, last


def load_model(path: str | None = None) -> Model:
    """Read a BPE model with byte fallback; the path is a parameter, by default the installed public vocabulary."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    pieces, normal = [], []
    byte_ids = np.zeros(256, np.int32)
    for i in range(n):
        text = sp.id_to_piece(i)
        special = sp.is_control(i) or sp.is_unknown(i)
        if sp.is_byte(i):
            value = int(text[3:5], 16)
            byte_ids[value] = i
            pieces.append(bytes([value]))
        else:
            pieces.append(b"" if special else text.encode().replace(_META, b" "))
        normal.append(not (special or sp.is_byte(i) or sp.is_unused(i)))
    ids = {p: i for i, p in enumerate(pieces) if normal[i]}
    by_score = sorted((i for i in range(n) if normal[i]), key=lambda i: (-sp.get_score(i), i))
    rank = {pieces[i]: r for r, i in enumerate(by_score)}
    order, left, right = np.full(n + 1, -1, np.int64), np.arange(n + 1), np.arange(n + 1)
    usable, keys, ranks = [], [], []
    for p, i in ids.items():
        chars = [c.encode() for c in p.decode()]
        if len(chars) == 1:
            usable.append(i)
            continue
        whole, last = _merged(list(chars), rank)
        if len(whole) == 1:
            usable.append(i)
            order[i], left[i], right[i] = rank[p], ids.get(last[0], n), ids.get(last[1], n)
        cut = 0
        for c in chars[:-1]:
            cut += len(c)
            a, b = ids.get(p[:cut]), ids.get(p[cut:])
            if a is not None and b is not None:
                keys.append(a * (n + 1) + b)
                ranks.append(rank[p])
    by_key = np.argsort(np.array(keys))
    size = np.array([len(p) for p in pieces] + [0], np.int64)
    blob = np.frombuffer(b"".join(pieces), np.uint8)
    breaks = np.ones(256, bool)
    breaks[np.frombuffer(b"".join(ids), np.uint8)] = False
    breaks[128:] = False
    return Model(blob, np.concatenate([[0], np.cumsum(size)[:-1]]), size, order, left, right, np.array(sorted(usable)), byte_ids, np.array(keys)[by_key], np.array(ranks, np.int64)[by_key], breaks)


def suffix_array(data: np.ndarray, places: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """places in the order of what follows them, up to `depth` bytes; and 8 bytes from each position of data, as a number."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    eight = np.zeros(n, np.uint64)
    for j in range(8):
        eight |= padded[j : j + n] << np.uint64(56 - 8 * j)
    order = np.argsort(eight)
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], eight[order][1:] != eight[order][:-1]]))
    rank[n] = -1
    held = 8
    while held < depth:
        key = (rank[:n] + 1) << 32
        key[: max(n - held, 0)] |= rank[held:n] + 1
        order = np.argsort(key)
        rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
        held *= 2
    if len(places) < n:
        wanted = np.zeros(n, bool)
        wanted[places] = True
        order = order[wanted[order]]
    return order, eight


def _eights(blob: bytes, low: int) -> int:
    return int.from_bytes(blob[:8].ljust(8, bytes([low])), "big")


class Encoder:
    """Encodes batches; what it has learnt of segments and pairs stays for the next batch."""

    def __init__(self, model: Model) -> None:
        self.m = model
        pieces = [model.blob[model.start[i] : model.start[i] + model.size[i]].tobytes() for i in model.usable]
        self.low = np.array([_eights(p, 0) for p in pieces], np.uint64)
        self.high = np.array([_eights(p, 255) for p in pieces], np.uint64)
        self.long = [(j, p) for j, p in enumerate(pieces) if len(p) > 8]
        self.pair_key, self.pair_ok = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes of segments, sorted
        self.slot = np.zeros(0, np.int64)  # the segment's number, in the order of learning
        self.first, self.count, self.tokens = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    # -- pairs ------------------------------------------------------------------------------------------------------

    def _decide(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a and b stay apart: undo the younger merge on either side of the boundary, step by step; an older merge across it forbids the pair."""
        m, ok = self.m, np.ones(len(a), bool)
        at, limit = np.arange(len(a)), np.full(len(a), _FAR)
        while len(at):
            key = a * (m.n) + b
            found = np.minimum(np.searchsorted(m.pair_keys, key), len(m.pair_keys) - 1)
            across = np.where(m.pair_keys[found] == key, m.pair_rank[found], _FAR)
            bad = across < limit
            ok[at[bad]] = False
            x, y = m.order[a], m.order[b]
            on = ~bad & ((x >= 0) | (y >= 0))
            at, a, b, x, y = at[on], a[on], b[on], x[on], y[on]
            first = x > y
            limit = np.where(first, x, y + 1)
            a, b = np.where(first, m.right[a], a), np.where(first, b, m.left[b])
        return ok

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.m.n + b
        slot = (mix(key.astype(np.uint64)) & np.uint64(PAIRS - 1)).astype(np.int64)
        ok = self.pair_ok[slot]
        new = np.flatnonzero(self.pair_key[slot] != key)
        if len(new):
            _, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            took = new[first]
            decided = self._decide(a[took], b[took])
            ok[new] = decided[back]
            self.pair_key[slot[took]] = key[took]
            self.pair_ok[slot[took]] = decided
            # two keys may want one slot: the last writer of both arrays is the same, as they are written in the same order
        return ok

    # -- segments ---------------------------------------------------------------------------------------------------

    def _edges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id, segment) of every piece's occurrences and of the characters without a piece."""
        m = self.m
        lead = (data & 0xC0) != 0x80
        lead[starts] = True
        places = np.flatnonzero(lead)
        order, eight = suffix_array(data, places, DEPTH)
        ordered = eight[order]
        lo, hi = np.searchsorted(ordered, self.low, "left"), np.searchsorted(ordered, self.high, "right")
        deep = []
        for j, p in self.long:
            a, b, cut = lo[j], hi[j], 8
            while a < b and cut < min(len(p), DEPTH):
                at = order[a:b] + cut
                rest = np.where(at < len(data), eight[np.minimum(at, len(data) - 1)], np.uint64(0))
                a, b = a + np.searchsorted(rest, np.uint64(_eights(p[cut:], 0)), "left"), a + np.searchsorted(rest, np.uint64(_eights(p[cut:], 255)), "right")
                cut += 8
            lo[j], hi[j] = a, b
            if len(p) > DEPTH and a < b:
                hi[j] = a
                at = order[a:b]
                deep += [(x, self.m.usable[j]) for x in at[at + len(p) <= len(data)].tolist() if data[x : x + len(p)].tobytes() == p]
        many = np.maximum(hi - lo, 0)
        s = order[ragged(lo, many)]
        t = np.repeat(m.usable, many)
        if deep:
            s, t = np.concatenate([s, [x for x, _ in deep]]), np.concatenate([t, [x for _, x in deep]])
        e = s + m.size[t]
        segment = np.repeat(np.arange(len(starts)), ends - starts)
        inside = e <= ends[segment[s]] if len(s) else np.zeros(0, bool)
        s, e, t = s[inside], e[inside], t[inside]
        # characters
        after = np.append(places[1:], len(data))
        alone = np.zeros(len(data), bool)
        width = np.zeros(len(data), np.int64)
        width[places] = after - places
        alone[places] = True
        alone[s[e - s == width[s]]] = False
        lone = np.flatnonzero(alone)
        s, e, t = np.concatenate([s, lone]), np.concatenate([e, lone + width[lone]]), np.concatenate([t, np.full(len(lone), m.n - 1)])
        return s, e, t, segment[s]

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count of each segment) of segments that lie in data one after the other."""
        m = self.m
        s, e, t, segment = self._edges(data, starts, ends)
        distance = e - starts[segment]
        by = np.argsort(distance.astype(np.uint16) if len(distance) and distance.max() < 1 << 16 else distance, kind="stable")
        s, e, t, distance, begin = s[by], e[by], t[by], distance[by], starts[segment[by]]
        steps = np.concatenate([np.flatnonzero(np.diff(distance, prepend=-1)), [len(s)]])
        last = np.full(len(data), -1, np.int64)  # by the byte that the piece ends with
        for a, b in zip(steps, steps[1:], strict=False):
            x, y, z = s[a:b], e[a:b], t[a:b]
            ok = x == begin[a:b]
            check = np.flatnonzero(~ok)
            before = last[x[check] - 1]
            check, before = check[before >= 0], before[before >= 0]
            ok[check] = self._apart(before, z[check])
            last[y[ok] - 1] = z[ok]
        at, at_segment = ends.copy(), np.arange(len(starts))
        found_s, found_t = [], []
        width = np.zeros(len(data), np.int64)
        lone = t == m.n - 1
        width[e[lone] - 1] = e[lone] - s[lone]
        while len(at):
            token = last[at - 1]
            at = at - np.where(token == m.n - 1, width[at - 1], m.size[token])
            found_s.append(at)
            found_t.append(token)
            on = at > starts[at_segment]
            at, at_segment = at[on], at_segment[on]
        s, t = (np.concatenate(found_s), np.concatenate(found_t)) if found_s else (np.zeros(0, np.int64),) * 2
        by = np.argsort(s)
        s, t = s[by], t[by]
        # characters without a piece become bytes
        after = np.append(s[1:], len(data))
        many = np.where(t == m.n - 1, after - s, 1)
        ids = np.repeat(t, many)
        raw = ids == m.n - 1
        ids[raw] = m.byte_ids[data[(np.repeat(s, many) + ragged(np.zeros(len(s), np.int64), many))[raw]]]
        return ids.astype(np.int32), np.diff(np.concatenate([[0], np.cumsum(many)])[np.searchsorted(s, np.append(starts, len(data)))])

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        data, offsets = normalised(data, offsets)
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        space, stop = data == 32, self.m.breaks[data]
        cut = np.zeros(n, bool)
        cut[1:] = (space[1:] & ~space[:-1]) | stop[1:] | stop[:-1]
        cut[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        hashes = _segment_hashes(data, starts, ends)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._forget()
        at = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[at] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(new):
            a, size = starts[first[new]], (ends - starts)[first[new]]
            edge = np.concatenate([[0], np.cumsum(size)])
            ids, count = self._learn(data[ragged(a, size)], edge[:-1], edge[1:])
            begin = len(self.tokens) + np.concatenate([[0], np.cumsum(count)[:-1]])
            numbers = len(self.first) + np.arange(len(new))
            self.first, self.count, self.tokens = np.concatenate([self.first, begin]), np.concatenate([self.count, count]), np.concatenate([self.tokens, ids])
            known, slot = np.concatenate([self.known, distinct[new]]), np.concatenate([self.slot, numbers])
            by = np.argsort(known)
            self.known, self.slot = known[by], slot[by]
        word = self.slot[np.searchsorted(self.known, distinct)][back]
        count = self.count[word]
        ids = self.tokens[ragged(self.first[word], count)]
        total = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(total[np.searchsorted(starts, offsets)])


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_M = 0xA0761D6478BD642F


def _segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    power = np.full(int(size.max()), _M, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    place = np.arange(len(data)) - np.repeat(starts, size)
    return mix(np.add.reduceat(_CODES[data] * power[place], starts) ^ size.astype(np.uint64))


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A space before every text that isn't empty; the meta symbol is a space."""
    meta = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else np.zeros(0, np.int64)
    if len(meta):
        data = data.copy()
        data[meta] = 32
        gone = np.sort(np.concatenate([meta + 1, meta + 2]))
        data = np.delete(data, gone)
        offsets = offsets - np.searchsorted(gone, offsets)
    full = offsets[1:] > offsets[:-1]
    return np.insert(data, offsets[:-1][full], 32), offsets + np.concatenate([[0], np.cumsum(full)])


def decode_ids(model: Model, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts and their offsets: pieces joined, without the space before a text."""
    size = model.size[ids]
    data = model.blob[ragged(model.start[ids], size)]
    offsets = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
    first = offsets[:-1][offsets[1:] > offsets[:-1]]
    first = first[data[first] == 32]
    return np.delete(data, first), offsets - np.searchsorted(first, offsets)


def encode(docs: DataFrame, text: str = "text", model_path: str | None = None, model: Model | None = None, ids: bool = True, check: bool = True) -> DataFrame:
    """Every row of docs with n_tokens (long), ids_sha256 (of the ids as little-endian 32-bit numbers), and as asked ids (array of int),
    decoded_sha256 and round_trip (whether decoding gives the text back: false where it has the meta symbol itself).

    Null and empty texts have no tokens; a null's round_trip is true. Columns of docs with the new names are replaced.
    """
    spark: SparkSession = docs.sparkSession
    batch_rows(spark)
    held_model = spark.sparkContext.broadcast(model or load_model(model_path))  # fixed by the vocabulary, a few MB
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else []), *([T.StructField("decoded_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())] if check else [])]
    names = {f.name for f in new}
    kept = [c for c in docs.columns if c not in names]
    rest = [F.col(f"`{c}`") for c in kept if c != text]
    held = docs.select((F.struct(*rest) if rest else F.lit(None).cast("string")).alias("_row"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held_model.value
        encoder = Encoder(m)
        for batch in batches:
            for rows, data, offsets in slices(batch):
                found, counts = encoder(data, offsets)
                edge = np.concatenate([[0], np.cumsum(counts)])
                raw = found.astype("<i4")
                columns = [rows.column(0), rows.column(1), pa.array(counts, pa.int64()), pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(edge, edge[1:], strict=False)])]
                if ids:
                    columns.append(list_array(counts, pa.array(found, pa.int32())))
                if check:
                    back, at = decode_ids(m, found, counts)
                    texts = [back[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
                    columns += [pa.array([hashlib.sha256(x).hexdigest() for x in texts]), pa.array([x == data[a:b].tobytes() for x, a, b in zip(texts, offsets, offsets[1:], strict=False)], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["_row", "text", *[f.name for f in new]])

    out = held.mapInArrow(released(run), T.StructType([*held.schema.fields, *new]))
    return out.select(*[F.col("text").alias(c) if c == text else F.col("_row")[c].alias(c) for c in kept], *[f.name for f in new])


def decode(rows: DataFrame, ids: str = "ids", model_path: str | None = None, model: Model | None = None) -> DataFrame:
    """Every row with text, decoded from the array column `ids` (null: null). Bytes that are not UTF-8 become U+FFFD; null ids inside an array are left out; ids outside the vocabulary raise an error."""
    spark = rows.sparkSession
    batch_rows(spark)
    held_model = spark.sparkContext.broadcast(model or load_model(model_path))
    kept = [c for c in rows.columns if c != "text"]
    held = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.filter(F.col(f"`{ids}`").cast("array<int>"), lambda x: x.isNotNull()).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held_model.value
        for batch in batches:
            lists = batch.column(1)
            counts = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(values) and (values.min() < 0 or values.max() >= m.n - 1):
                raise ValueError("an id outside the vocabulary")
            back, at = decode_ids(m, values, counts)
            texts = [None if not good else back[a:b].tobytes().decode("utf-8", "replace") for good, a, b in zip(lists.is_valid().to_pylist(), at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_row", "text"])

    out = held.mapInArrow(released(run), T.StructType([held.schema.fields[0], T.StructField("text", T.StringType())]))
    return out.select(*[F.col("_row")[c].alias(c) for c in kept], "text")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip")
