"""WARC writing and sequential reading.

Every record is one gzip member. The reader goes through an archive once, front to back: it inflates a member
incrementally, takes the header up to the blank line, frames the block by Content-Length, checks the block and
payload digests, and goes on where the member ended. Archives are written by the tasks through pyarrow's file
systems into a folder that all share; a task writes under a name of its own and renames when whole, so that a lost or
repeated task leaves no half file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_rows, fresh_dir, stage

CHUNK = 1 << 16
#: An archive that has grown so large is closed and the next one begun.
ARCHIVE_BYTES = 1 << 30
_SPACE = uuid.UUID("6f0a2a52-6a0c-5d0c-9d5d-0d6d2f6e7a11")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str, copy: int = 0) -> str:
    """The same for the same id and payload, whoever writes it; further copies have numbers."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{payload_digest}' + f'/{copy}' * (copy > 0))}>"


def _line(text: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def member(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, kind: str, date: str, copy: int = 0) -> bytes:
    """One record as a gzip member; a revisit has the HTTP header alone as its block."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, payload_digest, copy)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Block-Digest: sha1:{digest(block)}", f"WARC-Payload-Digest: sha1:{payload_digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, payload_digest)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


class Reader:
    """Records of an open binary stream, in order: (offset, headers, block, error). After a broken member nothing more is read."""

    def __init__(self, stream) -> None:
        self.stream, self.left, self.at = stream, b"", 0

    def _more(self, inflate, held: bytearray) -> bool:
        """Inflate some more of the member into held; False at its end."""
        if inflate.eof:
            return False
        data = self.left or self.stream.read(CHUNK)
        out = inflate.decompress(data, CHUNK)
        if not (data or out or inflate.eof):
            raise ValueError("the archive ends inside a record")
        rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
        self.at += len(data) - len(rest)
        self.left = rest
        held += out
        return True

    def __iter__(self) -> Iterator[tuple[int, dict[str, str], bytes, str | None]]:
        while True:
            if not self.left:
                self.left = self.stream.read(CHUNK)
            if not self.left:
                return
            offset, held, headers = self.at, bytearray(), {}
            try:
                inflate = zlib.decompressobj(31)
                while (end := held.find(b"\r\n\r\n")) < 0:
                    if not self._more(inflate, held):
                        raise ValueError("no end of header")
                lines = held[:end].decode("utf-8", "replace").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError("not a WARC record")
                headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                length = int(headers["content-length"])
                del held[: end + 4]
                while len(held) < length + 4 and self._more(inflate, held):
                    pass
                while self._more(inflate, held):  # the member's trailer
                    if len(held) > length + 4:
                        break
                if len(held) != length + 4 or held[length:] != b"\r\n\r\n":
                    raise ValueError("the block is not as long as Content-Length says")
            except (ValueError, KeyError, zlib.error) as e:
                yield offset, headers, b"", f"{type(e).__name__}: {e}"
                return
            block = bytes(held[:length])
            said = headers.get("warc-block-digest")
            yield offset, headers, block, None if said in (None, f"sha1:{digest(block)}") else "block digest differs"


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """What follows the HTTP header of a response; the whole block of other records."""
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def write_warc(pages: DataFrame, folder: str, min_revisit: int = 0, date: str = "2000-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html; more columns are not written) as archives in folder; returns path, records, bytes of each.

    A null html is an empty payload, a null url has no Target-URI. Of equal payloads of at least min_revisit bytes the
    largest page_id is the response (a null id is smaller than all; of rows that tie at the largest id one is),
    the others are revisits of it; smaller payloads are all responses. Record ids differ between records. No rows make no archives.
    """
    spark: SparkSession = pages.sparkSession
    batch_rows(spark, 1000)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("sha1", F.unhex(F.sha1("payload")))
    # only payloads that repeat need the join's other side: the row with the largest id answers for the others
    known = rows.where(F.length("payload") >= min_revisit).groupBy("sha1", "page_id").agg(F.count("*").alias("n"))
    first = known.groupBy("sha1").agg(F.max_by(F.struct("page_id", "n"), F.struct(F.col("page_id").isNotNull(), "page_id")).alias("m"), F.sum("n").alias("n")).where("n > 1")
    first = stage(first.select("sha1", F.col("m.page_id").alias("first"), (F.col("m.n") > 1).alias("tied")), "warc-repeats")  # so that both sides of the join are shuffled for it, and hot digests can be split
    joined = rows.join(first, "sha1", "left").withColumn("revisit", F.col("tied").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    joined = joined.select("page_id", "url", "payload", "sha1", "first", "revisit", F.coalesce(F.col("tied") & ~F.col("revisit"), F.lit(False)).alias("tied"), F.lit(0).cast("long").alias("copy"))
    repeats = known.where("n > 1").limit(1).count()
    if repeats:
        # rows of one id and payload are numbered once written; number 0 is the response, if it is one at all
        again = known.where("n > 1").select("sha1", "page_id")
        same = [joined["sha1"] == again["sha1"], joined["page_id"].eqNullSafe(again["page_id"])]
        twice = stage(joined.join(again, same, "left_semi").withColumn("copy", F.monotonically_increasing_id()), "warc-twice")
        least = twice.groupBy("sha1", "page_id").agg(F.min("copy").alias("least")).select(F.col("sha1").alias("s"), F.col("page_id").alias("p"), "least")
        twice = twice.join(least, (F.col("sha1") == F.col("s")) & F.col("page_id").eqNullSafe(F.col("p")))
        other = F.col("copy") != F.col("least")
        twice = twice.withColumn("revisit", F.col("revisit") | F.col("tied") & other).withColumn("copy", F.when(other, F.col("copy") + 1).otherwise(0)).select(*joined.columns)
        joined = joined.join(again, same, "left_anti").unionByName(twice)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        done: list[tuple[str, int, int]] = []
        sink = None

        def close() -> None:
            sink.close()
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(done):03d}.warc.gz"  # attempts of a task write apart; the index has those of the one that counts
            fs.move(own, f"{root}/{name}")
            done.append((f"{folder}/{name}", records, size))

        for batch in batches:
            for page_id, url, payload, first, revisit, copy in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                if sink is None:
                    own, records, size = f"{root}/.{uuid.uuid4().hex}", 0, 0
                    sink = fs.open_output_stream(own)
                data = member(page_id, url, payload, digest(payload), first, "revisit" if revisit else "response", date, copy)
                sink.write(data)
                records, size = records + 1, size + len(data)
                if size >= archive_bytes:
                    close()
                    sink = None
        if sink is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    written = joined.select("page_id", "url", "payload", "first", "revisit", "copy").mapInArrow(write, "path string, records long, bytes long")
    return stage(written, "warc-index")


def read_warc(archives: DataFrame, tasks: int | None = None, payloads: bool = True) -> DataFrame:
    """Records of archives (a column path of URIs): path, offset, record_id, record_type, page_id, target_uri, refers_to_record, payload_bytes,
    payload_digest, error (null: framing and digests hold) and, unless payloads is False, payload.

    payload_bytes and payload_digest are of what was read; of a revisit they are null and what its header says. A record that can't be read has
    its error and is the last of its archive.
    """
    schema = "path string, offset long, record_id string, record_type string, page_id long, target_uri string, refers_to_record string, payload_bytes long, payload_digest string, error string" + ", payload binary" * payloads
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * payloads
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(at, compression=None) as stream:
                    for offset, headers, block, error in Reader(stream):
                        kind, payload, said = headers.get("warc-type"), payload_of(headers, block), headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        if kind == "revisit":
                            size, found, payload = None, said, None
                        else:
                            size, found = len(payload), digest(payload)
                            if error is None and said not in (None, found):
                                error = "payload digest differs"
                        page = headers.get("x-page-id")
                        out.append((path, offset, headers.get("warc-record-id"), kind, int(page) if page else None, headers.get("warc-target-uri"), headers.get("warc-refers-to"), size, found, error, payload)[: len(types)])
                        held += len(block) + 500
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names)
                            out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names)

    paths = archives.select("path")
    tasks = tasks or archives.sparkSession.sparkContext.defaultParallelism
    return paths.repartition(max(tasks, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path").mapInArrow(read, schema)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, read back from the archives. Repeated rows each get a record and a row; a null html is empty, a null page_id stays null."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    archives = write_warc(pages, fresh_dir(spark, "warc"))
    records = stage(read_warc(archives, payloads=False), "warc-records")
    broken = records.where("error is not null").select("path", "offset", "error").limit(3).collect()
    if broken:
        raise ValueError(f"archives do not read back: {broken}")
    responses = records.where("record_type = 'response'").groupBy("record_id", "payload_digest").agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("full_bytes"))
    responses = stage(responses, "warc-responses")
    revisits = records.where("record_type = 'revisit'").withColumnRenamed("record_id", "own").join(responses.withColumnRenamed("record_id", "refers_to_record"), ["refers_to_record", "payload_digest"], "left")
    return records.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.select("page_id", F.col("full_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    )


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, upper(sha1(b)) AS h FROM p),
e AS (
  SELECT page_id, n, h,
         list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(1 + 5 * i AS INTEGER), 5) AS BIGINT) >> s) & 31 AS INTEGER) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS x,
         max(page_id) OVER (PARTITION BY h) AS m, row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST) AS k FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, x AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k = 1 THEN NULL ELSE m END AS refers_to
FROM e
"""
