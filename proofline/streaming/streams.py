"""Streams over append logs and blobs, with their state in RocksDB and their tables in folders that batches add to."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start here keep their state in RocksDB, and write its changes for each batch."""
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders right below path, by name; none if it is not there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(place) if s.isDirectory()) if fs.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at path, None if it has no files yet."""
    return spark.read.parquet(path) if folders(spark, path) else None


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order; of rows equal in it the one with the greatest other columns."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_r")).select(*keys, "_r.*")


def checkpoint_stream(spark: SparkSession, source: str, schema: str, keys: list[str], order: list[str], target: str, checkpoint: str, buckets: int = 16, most: int = 8, files: int | None = None):
    """Keeps the latest record of each key while a JSON-lines log grows.

    The latest records are the stream's state; a batch gives the keys that it changed, and these alone are written, to
    target/_bucket=<key's bucket>/_batch=<batch>. A bucket with more than most such folders is written as one, and what it
    was made of is removed then. current reads the last record of each key, so that it does not matter whether a record
    stands in two folders: a batch that runs again, or a compaction that was broken off, leaves the same table.
    """
    log = spark.readStream.schema(schema).options(**({"maxFilesPerTrigger": files} if files else {})).json(source)

    def put(batch: DataFrame, number: int) -> None:
        own = batch.withColumn("_bucket", F.expr(f"pmod(xxhash64({', '.join(keys)}), {buckets})")).withColumn("_batch", F.lit(f"{number:09d}"))
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket", "_batch").parquet(target)
        compact(batch.sparkSession, target, keys, order, most)

    with state_store(spark):
        return newest(log, keys, order).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark: SparkSession, target: str, keys: list[str], order: list[str], most: int) -> None:
    """Writes the buckets of target that have more than most folders as one folder each, under a name that is never used again."""
    due = [f for bucket in folders(spark, target) if len(found := folders(spark, bucket)) > most for f in found]
    if due:
        rows = spark.read.option("basePath", target).parquet(*due).drop("_batch")
        newest(rows, ["_bucket", *keys], order).withColumn("_batch", F.lit(f"base-{uuid.uuid4().hex}")).write.mode("append").partitionBy("_bucket", "_batch").parquet(target)
        for folder in due:
            remove(spark, folder)


def current(spark: SparkSession, target: str, keys: list[str], order: list[str]) -> DataFrame:
    """The latest record of each key in target; FileNotFoundError if no batch has written yet."""
    rows = stored(spark, target)
    if rows is None:
        raise FileNotFoundError(target)
    return newest(rows.drop("_bucket", "_batch"), keys, order)


#: A sketch has 2 ** BITS places, of which each key takes PROBES: 1 key in 100 is taken for a known one at 10 places a key.
BITS, PROBES = 27, 7


def _probes(key: Column, bits: int, probes: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(1 << bits)) for i in range(probes)])


def bloom(df: DataFrame, key: str, bits: int = BITS, probes: int = PROBES) -> DataFrame:
    """(block, bits): a Bloom sketch of the keys in blocks of 32,768 places; sketches are merged by merged_bloom."""
    places = df.filter(F.col(key).isNotNull()).select(F.explode(_probes(F.col(key), bits, probes)).alias("_at"))
    return places.groupBy(F.bitmap_bucket_number("_at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("bits"))


def merged_bloom(sketches: DataFrame) -> DataFrame:
    """(block, bits) of several sketches together."""
    return sketches.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))


def perhaps_in(df: DataFrame, key: str, sketch: DataFrame, bits: int = BITS, probes: int = PROBES) -> DataFrame:
    """(key) of df that may be in the sketch: all keys that are, and few others."""
    asked = df.filter(F.col(key).isNotNull()).select(key).distinct().withColumn("_at", F.explode(_probes(F.col(key), bits, probes)))
    asked = asked.withColumns({"block": F.bitmap_bucket_number("_at"), "_bit": F.bitmap_bit_position("_at")})
    met = asked.join(sketch, "block")
    byte = F.conv(F.hex(F.substring("bits", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    found = met.filter(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1)
    return found.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") == probes).select(key)


def content_dedup_stream(blobs: DataFrame, checksum: str, at: str, delay: str, store: str, sketch: str, checkpoint: str, bits: int = BITS):
    """Adds the first blob of each checksum to the store while blobs come; late, a column of it, counts what the store held.

    Copies within the delay are caught by the stream's own state, which is forgotten behind the watermark. Copies that come
    later are caught against the store: of a batch's keys, those that may be in the sketch of all stored keys are looked
    up in it, by one column. The batch's new keys go to the store and their sketch beside it, in folders of the batch, and a
    batch that runs again sees what earlier batches left. store/late tells how many copies the store caught in each batch.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark, name = batch.sparkSession, f"{number:09d}"
        batch.persist()
        known, sketches = stored(spark, f"{store}/blobs"), stored(spark, sketch)
        fresh, late = batch, batch.filter("false").select(checksum)
        if known is not None and sketches is not None:
            earlier = lambda df: df.filter(F.col("_batch").cast("long") < number)
            perhaps = perhaps_in(batch, checksum, merged_bloom(earlier(sketches)), bits)
            late = earlier(known).select(checksum).join(perhaps, checksum, "left_semi").distinct()
            fresh = batch.join(late, checksum, "left_anti")
        for rows, path in ((fresh, f"{store}/blobs"), (batch.join(late, checksum, "left_semi").agg(F.count("*").alias("caught")), f"{store}/late"), (bloom(fresh, checksum, bits), sketch)):
            rows.withColumn("_batch", F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(path)
        batch.unpersist()

    firsts = blobs.withWatermark(at, delay).dropDuplicatesWithinWatermark([checksum])
    with state_store(blobs.sparkSession):
        return firsts.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
