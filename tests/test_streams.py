"""Streams against their batch forms: restarts, compaction, watermarks and late copies."""

import datetime
import glob
import os
import random

from pyspark.sql import functions as F

from proofline.operators import sequences as S
from proofline.sources import files
from proofline.streaming import leases, streams

START = datetime.datetime(2024, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def write(spark, folder, schema, data):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)


def test_checkpoint_stream_writes_what_a_batch_changes(spark, tmp_path):
    log, target, offsets = (str(tmp_path / x) for x in ("log", "state", "offsets"))
    schema, rng, told = "k string, n int, v double", random.Random(1), []

    def run(records, most=100):
        told.extend(records)
        files.append_log(spark.createDataFrame(records, schema).coalesce(1), log)
        streams.checkpoint_stream(spark, log, schema, ["k"], ["n"], target, offsets, buckets=2, most=most).awaitTermination()
        assert rows(streams.current(spark, target, ["k"], ["n"]).select("k", "n", "v")) == rows(S.latest(spark.createDataFrame(told, schema), ["k"], ["n"]).select("k", "n", "v"))
        return {os.path.basename(f).split("=")[1] for f in glob.glob(f"{target}/_bucket=*/_batch=*")}

    run([(f"k{i}", rng.randint(0, 9) * 100 + i, float(i)) for i in range(200)])
    run([("k3", 5000, 1.0), ("k4", -1, 2.0)])  # k4's record is older than what is known, and the state is read again after a restart
    second = spark.read.parquet(target).filter("_batch = '000000001'")
    assert second.count() <= 2 and not second.filter("n = -1").count()
    assert run([("new", 1, 1.0)], most=1) >= set()
    left = glob.glob(f"{target}/_bucket=*/_batch=*")
    assert len(left) <= 2 * 2 and any("base-" in f for f in left)
    spark.read.parquet(target).filter("_bucket = 0").drop("_batch").withColumn("_batch", F.lit("base-broken-off")).write.mode("append").partitionBy("_bucket", "_batch").parquet(target)
    assert rows(streams.current(spark, target, ["k"], ["n"]).select("k", "n", "v")) == rows(S.latest(spark.createDataFrame(told, schema), ["k"], ["n"]).select("k", "n", "v"))
    run([(f"k{i}", 9000, 0.0) for i in range(50)], most=1)


def lease_stream(spark, folder, out, hours):
    stream = spark.readStream.schema("job long, at timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    with streams.state_store(spark):
        leases.lease_stream(stream, "job", "at", hours * 3_600_000_000, "2 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("job long, last_beat long, due long, attempt long").parquet(out)


def test_leases_expire_as_in_the_batch(spark, tmp_path):
    folder, out, rng = str(tmp_path / "beats"), str(tmp_path / "lost"), random.Random(3)
    beats = sorted(((j, START + datetime.timedelta(minutes=rng.randint(0, 6000))) for j in range(5) for _ in range(60)), key=lambda b: b[1])
    late = [i for i in range(0, 299, 3)]
    for i in late:  # neighbours come in the other order, and so in another batch now and then
        beats[i], beats[i + 1] = beats[i + 1], beats[i]
    beats += [(None, START), (7, None), (1, beats[-1][1]), (1, beats[-1][1])]
    done = 0
    for end in (110, 111, 220, len(beats)):  # each stop is a restart from the checkpoint
        write(spark, folder, "job long, at timestamp", beats[done:end])
        done = end
        got = lease_stream(spark, folder, out, 3)
    told = spark.createDataFrame(beats, "job long, at timestamp").withColumn("us", F.unix_micros("at"))
    now = told.agg((F.floor((F.max("us") - 7_200_000_000) / 1000) * 1000).alias("now"))
    want = rows(leases.lease_expiries(told, "job", "us", 3 * 3_600_000_000, now))
    assert rows(got) == want and len(want) > 20
    attempts = {}
    for job, _, _, attempt in sorted(want, key=lambda r: (r[0], r[1])):
        assert attempt == attempts.get(job, 0) + 1
        attempts[job] = attempt


def test_a_lease_that_holds_is_not_lost(spark, tmp_path):
    folder, at = str(tmp_path / "beats"), lambda h: START + datetime.timedelta(hours=h)
    write(spark, folder, "job long, at timestamp", [(1, at(0)), (2, at(0))])
    write(spark, folder, "job long, at timestamp", [(1, at(3)), (9, at(6))])  # exactly at the end of its lease
    write(spark, folder, "job long, at timestamp", [(9, at(8))])
    us = lambda h: int((at(h) - datetime.datetime(1970, 1, 1)).total_seconds() * 1e6)
    assert rows(lease_stream(spark, folder, str(tmp_path / "lost"), 3)) == [(2, us(0), us(3), 1)]


def test_expired_jobs(spark):
    jobs = spark.createDataFrame([(1, 1, 0), (2, 3, 900)], "job int, attempt long, beat long")
    now = spark.createDataFrame([(1000,)], "now long")
    assert rows(leases.expired(jobs, now, 500).select("job", "attempt", "status")) == [(1, 2, "REQUEUED")]


def test_late_copies_are_caught_against_the_store(spark, tmp_path):
    folder, store = str(tmp_path / "blobs"), str(tmp_path / "store")
    at = lambda h: START + datetime.timedelta(hours=h)
    slices = [[("x", at(0)), ("x", at(0)), ("y", at(1))], [("z", at(30))], [("x", at(60)), ("w", at(60))], [("y", at(90)), ("w", at(60)), ("v", at(90)), (None, at(90))]]

    def run():
        stream = spark.readStream.schema("h string, at timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
        streams.content_dedup_stream(stream, "h", "at", "1 hour", store, f"{store}-sketch", f"{store}-offsets", bits=20).awaitTermination()

    for k, part in enumerate(slices):
        write(spark, folder, "h string, at timestamp", part)
        if k % 2:
            run()
    run()
    assert sorted(str(r.h) for r in spark.read.parquet(f"{store}/blobs").collect()) == ["None", "v", "w", "x", "y", "z"]
    assert spark.read.parquet(f"{store}/late").agg(F.sum("caught")).first()[0] == 2  # x and y, long behind the watermark


def test_sketch_finds_all_keys_and_few_others(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"))
    parts = [streams.bloom(keys.filter(f"id % 2 = {i}"), "k", 17) for i in range(2)]
    sketch = streams.merged_bloom(parts[0].union(parts[1]))
    assert rows(sketch) == rows(streams.bloom(keys, "k", 17))
    assert streams.perhaps_in(keys, "k", sketch, 17).count() == 3000
    others = spark.range(3000).select(F.concat(F.lit("other"), "id").alias("k"))
    assert streams.perhaps_in(others, "k", sketch, 17).count() < 60
