"""Queries through Structured Streaming: the tables are written to files, a slice of time after the other, and read as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from proofline.plans.files import _LATEST, place
from proofline.plans.registry import query
from proofline.sources.files import scratch_table
from proofline.streaming import leases, streams

#: Slices that a table is written in; each is a batch, so that the watermark moves between them.
SLICES = 4


def by_slices(df: DataFrame, at: str, path: str, run: Callable[[], StreamingQuery], slices: int = SLICES) -> None:
    """Writes df to path by slices of at, in its order, and after each one runs a stream on path up to its end.

    The files of a slice are one batch, however many tasks write and read them.
    """
    rows = scratch_table(df, "slices")
    ends = rows.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    for i in range(slices):
        low, high = (ends.low + (ends.high - ends.low) * k / slices for k in (i, i + 1))
        rows.filter((F.col(at) >= low) & ((F.col(at) < high) | F.lit(i == slices - 1))).write.mode("append").parquet(path)
        run().awaitTermination()


@query(_LATEST.format(""))
def str1_checkpoint_stream(t):
    path, target = place(t, "log"), place(t, "latest")
    keys, order = ["user_id", "event_type"], ["at", "value"]
    rows = t.events.select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value")
    for late in (False, True):  # the log grows between two runs of the stream
        rows.filter(F.expr(f"(user_id % 2 = 0 or value > 100) = {str(late).lower()}")).write.mode("append").json(path)
        streams.checkpoint_stream(t.spark, path, "user_id long, event_type string, at long, value double", keys, order, target, f"{target}-offsets", most=1).awaitTermination()
    return streams.current(t.spark, target, keys, order).select("user_id", "event_type", "value")


_LEASE = 12 * 3_600_000_000


@query(f"""WITH b AS (SELECT user_id, epoch_us(ts) AS last_beat FROM events), n AS (SELECT *, lead(last_beat) OVER (PARTITION BY user_id ORDER BY last_beat) AS next FROM b)
SELECT user_id, last_beat, last_beat + {_LEASE} AS due, row_number() OVER (PARTITION BY user_id ORDER BY last_beat) AS attempt FROM n WHERE (next IS NULL OR next > last_beat + {_LEASE}) AND last_beat + {_LEASE} < (SELECT (max(last_beat) - 3600000000) // 1000 * 1000 FROM b)""")
def str2_lease_expiry_stream(t):
    path, out = place(t, "beats"), place(t, "expiries")
    beats = t.events.select("user_id", F.col("ts").cast("timestamp").alias("at"))

    def found():
        return leases.lease_stream(t.spark.readStream.schema(beats.schema).parquet(path), "user_id", "at", _LEASE, "1 hour")

    def run():
        with streams.state_store(t.spark):
            return found().writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-offsets").trigger(availableNow=True).start()

    by_slices(beats, "at", path, run)
    return t.spark.read.schema(found().schema).parquet(out)


def _stored(t, blobs: DataFrame) -> DataFrame:
    """What content_dedup_stream leaves in its store after blobs (checksum, size, at) have come in slices of time."""
    path, store = place(t, "blobs"), place(t, "store")

    def run():
        stream = t.spark.readStream.schema(blobs.schema).parquet(path)
        return streams.content_dedup_stream(stream, "checksum", "at", "1 hour", store, f"{store}-sketch", f"{store}-offsets")

    by_slices(blobs, "at", path, run)
    return t.spark.read.parquet(f"{store}/blobs").select("checksum", "size")


@query("SELECT sha256(text) AS checksum, octet_length(encode(any_value(text))) AS size FROM documents GROUP BY text")
def str3_content_dedup_stream(t):
    at = F.expr("timestamp_micros(1704067200000000 + doc_id * 60000000)").alias("at")
    return _stored(t, t.documents.select(F.sha2(F.col("text").cast("binary"), 256).alias("checksum"), F.octet_length("text").alias("size"), at))


@query("SELECT DISTINCT sha256(props || event_type) AS checksum, octet_length(encode(props || event_type)) AS size FROM events")
def str3_late_duplicates(t):
    """Most contents come again days later, long after the stream has forgotten them."""
    content = F.concat("props", "event_type")
    return _stored(t, t.events.select(F.sha2(content.cast("binary"), 256).alias("checksum"), F.octet_length(content).alias("size"), F.col("ts").cast("timestamp").alias("at")))
