"""The ledger dealt to buckets: an upsert reads and writes the buckets that it touches, and a manifest swaps them at once.

    <folder>/data/version=<v>/bucket=<b>/     rows whose key's hash is b, as of write v
    <folder>/filters/version=<v>/             a Bloom filter of each bucket that write v wrote
    <folder>/manifest/version=<v>/            one file: for every bucket the write that holds it, and how many keys it has

Rows are keyed by job_url_hash, or by another column that is named. A write makes new bucket folders beside the old ones and then its manifest, a single
file that appears by one rename; readers take the newest manifest, so they see all of a write or nothing. A write that is
run again with the same number replaces its own folders and gives the same snapshot; `journal` numbers come from outside
(a stream's batch) and are kept in the manifest, so that a batch that was written is not written again. There is one
writer at a time. Versions behind the current one stay for their readers until expired() drops them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import cut

KEY = "job_url_hash"
BUCKETS = 64
#: A Bloom filter's bits for each key and its probes: about one wrong "perhaps" in a hundred.
BITS, PROBES = 10, 7
MANIFEST = "bucket int, held int, keys long, buckets int, journal long, version int"


def bucket_of(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def filter_hash(key: Column | str) -> Column:
    """Another hash than the buckets', so that a bucket's keys spread over its filter."""
    return F.xxhash64(key, F.lit("filter"))


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def removed(spark: SparkSession, path: str) -> None:
    """A folder that is not needed any more, wherever it is stored."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the manifests that are whole."""
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(there):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(there)]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("version=") and _exists(spark, f"{folder}/manifest/{n}/_SUCCESS"))


def manifest(spark: SparkSession, folder: str) -> list:
    """The rows of the newest manifest; none if nothing has been written. There is a row for each bucket."""
    found = _versions(spark, folder)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/version={found[-1]}").collect() if found else []


def snapshot(spark: SparkSession, folder: str, only: set[int] | None = None, columns: list[str] | None = None) -> DataFrame | None:
    """The current rows, of some buckets only if they are named; columns that older writes lack are null. None without any row."""
    paths = [f"{folder}/data/version={r.held}/bucket={r.bucket}" for r in manifest(spark, folder) if r["keys"] and (only is None or r.bucket in only)]
    if not paths:
        return None
    rows = spark.read.option("basePath", f"{folder}/data").option("mergeSchema", True).parquet(*paths)
    return rows.select(*columns) if columns else rows.drop("bucket", "version")


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A Bloom filter of each bucket's keys; a task has whole buckets, sorted, so one filter at a time."""
    bucket, keys = None, []

    def out() -> pa.RecordBatch:
        h = np.concatenate(keys)
        size = max(64, BITS * len(h)) // 8 * 8 + 8
        bits = np.zeros(size, np.uint8)
        for at in _probes(h, size):
            bits[at] = 1
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bucket", "bits"])

    for batch in batches:
        own = batch.column(0).to_numpy(zero_copy_only=False)
        for b in np.unique(own):
            if b != bucket and keys:
                yield out()
                keys = []
            bucket = int(b)
            keys.append(batch.column(1).to_numpy(zero_copy_only=False)[own == b].astype(np.int64).view(np.uint64))
    if keys:
        yield out()


def _probes(h: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The places of 64-bit hashes in a filter: two halves, combined."""
    one, two = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    for k in range(PROBES):
        yield ((one + np.uint64(k) * two) % np.uint64(size)).astype(np.int64)


def _tested(keys: pa.Table, bits: pa.Table) -> pa.Table:
    """The keys of one bucket that its filter has; a bucket without a filter has none."""
    if not len(keys) or not len(bits):
        return keys.slice(0, 0).select(["key"])
    on = np.unpackbits(np.frombuffer(bits["bits"][0].as_py(), np.uint8))
    h, good = keys["h"].to_numpy().view(np.uint64), np.ones(len(keys), bool)
    for at in _probes(h, len(on)):
        good &= on[at] == 1
    return keys.filter(pa.array(good)).select(["key"])


def _write(rows: DataFrame, folder: str, version: int, touched: set[int], before: list, buckets: int, journal: int | None, key: str) -> None:
    spark = rows.sparkSession
    rows.withColumn("bucket", bucket_of(key, buckets)).repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/version={version}")
    held = {r.bucket: (r.held, r["keys"]) for r in before}
    paths = [p for b in sorted(touched) if _exists(spark, p := f"{folder}/data/version={version}/bucket={b}")]
    held |= {b: (version, 0) for b in touched}
    if paths:
        written = spark.read.option("basePath", f"{folder}/data").parquet(*paths).select("bucket", filter_hash(key).alias("h"))
        by_bucket = written.repartition(F.col("bucket")).sortWithinPartitions("bucket")
        by_bucket.mapInArrow(_filters, "bucket int, bits binary").write.mode("overwrite").parquet(f"{folder}/filters/version={version}")
        held |= {r.bucket: (version, r.n) for r in written.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # a row for each touched bucket
    told = max([journal if journal is not None else -1, *(r.journal for r in before)])
    now = [(b, *held.get(b, (version, 0)), buckets, told, version) for b in range(buckets)]
    spark.createDataFrame(now, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/version={version}")


def created(ledger: DataFrame, folder: str, buckets: int = BUCKETS, key: str = KEY) -> None:
    """A ledger as write 0, every bucket of it."""
    _write(ledger, folder, 0, set(range(buckets)), [], buckets, None, key)


def rewritten(spark: SparkSession, folder: str, keyed: DataFrame, change: Callable[[DataFrame], DataFrame], empty: DataFrame, journal: int | None = None, key: str = KEY) -> set[int]:
    """One write: change() gets the rows of the buckets that `keyed` (a column named as the key) has keys in, and returns what they become.

    Returns the touched buckets. Nothing happens if the journal's number was written before. empty: no rows, of the ledger's columns.
    """
    before = manifest(spark, folder)
    buckets = before[0].buckets if before else BUCKETS
    if journal is not None and before and before[0].journal >= journal:
        return set()
    touched = {r.b for r in keyed.select(bucket_of(key, buckets).alias("b")).distinct().collect()}  # at most one for each bucket
    if touched:
        rows = snapshot(spark, folder, touched)
        rows = empty if rows is None else empty.unionByName(rows, allowMissingColumns=True)
        _write(change(rows), folder, (before[0].version if before else -1) + 1, touched, before, buckets, journal, key)
    return touched


def perhaps_known(keyed: DataFrame, folder: str) -> DataFrame:
    """The distinct keys (job_url_hash) of `keyed` that the ledger's filters do not rule out: all known ones, and one in a hundred of the others.

    Keys and filters meet by bucket, so a task holds one filter and one bucket's keys at a time.
    """
    spark = keyed.sparkSession
    rows = manifest(spark, folder)
    held = [(r.bucket, r.held) for r in rows if r["keys"]]
    keys = keyed.select(F.col(KEY).alias("_k")).where("_k is not null").distinct()
    if not held:
        return keys.where("false").withColumnRenamed("_k", KEY)
    now = spark.createDataFrame(held, "bucket int, version int")
    paths = [f"{folder}/filters/version={v}" for v in sorted({v for _, v in held})]
    bits = spark.read.option("basePath", f"{folder}/filters").parquet(*paths).join(F.broadcast(now), ["bucket", "version"]).select(F.col("bucket").alias("_b"), "bits")
    dealt = keys.select(bucket_of("_k", rows[0].buckets).alias("b"), filter_hash("_k").alias("h"), F.col("_k").alias("key"))
    return dealt.groupBy("b").cogroup(bits.groupBy("_b")).applyInArrow(_tested, "key string").withColumnRenamed("key", KEY)


def known(keyed: DataFrame, folder: str) -> DataFrame:
    """The distinct keys of `keyed` that are in the ledger: of the buckets that have a likely key, only the key column is read."""
    spark = keyed.sparkSession
    likely = perhaps_known(keyed, folder).persist()
    try:
        rows = manifest(spark, folder)
        touched = {r.b for r in likely.select(bucket_of(KEY, rows[0].buckets if rows else 1).alias("b")).distinct().collect()}
        there = snapshot(spark, folder, touched, [KEY]) if touched else None
        return cut(likely.where("false") if there is None else likely.join(there, KEY, "left_semi"))
    finally:
        likely.unpersist()


def expired(spark: SparkSession, folder: str) -> int:
    """Drops what no bucket of the newest manifest is held by; returns how many folders went."""
    held = {(r.bucket, r.held) for r in manifest(spark, folder)}
    used, gone = {v for _, v in held}, 0
    newest = _versions(spark, folder)[-1]
    for v in _versions(spark, folder)[:-1]:
        for b in {b for b, _ in held}:
            if (b, v) not in held and _exists(spark, path := f"{folder}/data/version={v}/bucket={b}"):
                removed(spark, path)
                gone += 1
        removed(spark, f"{folder}/manifest/version={v}")
        if v not in used and v != newest and _exists(spark, f"{folder}/filters/version={v}"):
            removed(spark, f"{folder}/filters/version={v}")
    return gone
