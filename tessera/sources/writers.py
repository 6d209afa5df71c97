"""Sinks of the dictionary lane."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import license_bucket, mask_sensitive


def shards(records: DataFrame, path: str, per_file: int = 10_000) -> None:
    """Records by license bucket, so many a file at most; an existing path is refused."""
    records.withColumn("license_bucket", license_bucket(F.col("license"))).write.mode("errorifexists").partitionBy("license_bucket").option("maxRecordsPerFile", per_file).parquet(path)


def json_lines(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Columns in order of their names, so that equal rows are equal lines."""
    rows.select(*sorted(rows.columns)).write.mode(mode).json(path)


def masked_log(rows: DataFrame, path: str, text: str = "text") -> None:
    """Append to a log, secrets masked before anything is written."""
    rows.withColumn(text, mask_sensitive(F.col(text))).write.mode("append").json(path)


def content_digest(rows: DataFrame, key: str) -> DataFrame:
    """One row: a digest of the content in order of the key, whatever the files are. Digests are taken by row first, then of their sorted list in two levels."""
    line = F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(c) for c in sorted(rows.columns)])), 256)
    part = F.pmod(F.xxhash64(key), F.lit(1024))
    level = rows.select(part.alias("p"), line.alias("d")).groupBy("p").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"))
    return level.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]), ""), 256).alias("digest"), F.count("*").alias("parts"))


def promote(rows: DataFrame, staging: str, target: str, dry_run: bool = True) -> int:
    """Write beside the target and swap by rename when whole; the old files come back if the rename fails. Returns the rows; a dry run writes nothing."""
    n = rows.count()
    if dry_run:
        return n
    rows.write.mode("errorifexists").parquet(staging)
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    old, new, aside = (jvm.org.apache.hadoop.fs.Path(x) for x in (target, staging, target.rstrip("/") + ".old"))
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(old)
    if had and not fs.rename(old, aside):
        raise OSError(f"cannot move {target} aside")
    if not fs.rename(new, old):
        if had:
            fs.rename(aside, old)
        raise OSError(f"cannot move {staging} to {target}")
    if had:
        fs.delete(aside, True)
    return n


def review_assets(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Each table as JSON lines below path, and a manifest (name, rows, digest of the content)."""
    manifest = None
    for name, rows in sorted(tables.items()):
        json_lines(rows, f"{path}/{name}")
        line = content_digest(rows, rows.columns[0]).select("digest").crossJoin(F.broadcast(rows.agg(F.count("*").alias("rows")))).select(F.lit(name).alias("name"), "rows", "digest")  # one row by one row
        manifest = line if manifest is None else manifest.unionByName(line)
    json_lines(manifest, f"{path}/manifest")
    return manifest


def approved_index(records: DataFrame, path: str, shards: int = 16, lists: tuple[str, ...] = ("surfaces", "readings", "pos", "domains")) -> None:
    """Refuses records that are not approved; else writes records by shard, an inverted index for each list, a locator (record_id, shard) and the manifest with its flags."""
    from .packs import FLAGS

    bad = records.where(F.coalesce("review_status", F.lit("")) != "approved").limit(3).collect()
    if bad:
        raise ValueError(f"records that are not approved: {[r['record_id'] for r in bad]}")
    placed = records.withColumn("shard", F.pmod(F.xxhash64("record_id"), F.lit(shards)).cast("int"))
    placed.write.mode("errorifexists").partitionBy("shard").parquet(f"{path}/records")
    placed.select("record_id", "shard").write.parquet(f"{path}/locator")
    for name in lists:
        records.select("record_id", F.explode(name).alias("key")).groupBy("key").agg(F.array_sort(F.collect_set("record_id")).alias("ids")).write.parquet(f"{path}/{name}")
    records.agg(F.count("*").alias("records")).select("records", *[F.lit(v).alias(k) for k, v in FLAGS.items()]).write.parquet(f"{path}/manifest")


def promotion_set(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """A folder for each kind, partitioned by license bucket, and the manifest of sources: kind, license_bucket, dataset, n."""
    manifest = None
    for kind, rows in sorted(tables.items()):
        bucketed = rows.withColumn("license_bucket", license_bucket(F.col("license")))
        bucketed.write.mode("errorifexists").partitionBy("license_bucket").json(f"{path}/{kind}")
        line = bucketed.groupBy("license_bucket", "dataset").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "license_bucket", "dataset", "n")
        manifest = line if manifest is None else manifest.unionByName(line)
    return manifest
