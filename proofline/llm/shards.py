"""Sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.shared import written

ROUNDS, SEED, SHARDS = 6, 29, 8


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(rows: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Where the permutation of 0..n-1 sends rows.

    A number is a pair of digits to base side, with side * side just above n; every round adds a hash of one digit to
    the other and swaps them. What lands at n or above walks on along its cycle until it is below n.
    """
    side = np.int64(isqrt(max(n - 1, 0)) + 1)
    out = np.asarray(rows, dtype=np.int64).copy()
    left = np.arange(len(out))
    while len(left):
        high, low = out[left] // side, out[left] % side
        for k in range(ROUNDS):
            high, low = low, (high + (_mixed(low, seed * 1_000_003 + k * 7_919) % np.uint64(side)).astype(np.int64)) % side
        out[left] = high * side + low
        left = left[out[left] >= n]
    return out


def placed(n: int, shards: int, seed: int = SEED):
    """Row numbers to shard and slot: neighbours in the permuted order go to the shards in turn."""

    def place(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = permuted(rows, n, seed)
        return (at % shards).astype(np.int32), at // shards

    return place


def numbered(rows: DataFrame, by: list[str]) -> tuple[DataFrame, int]:
    """rows with row_number from 0 in the order of by, and their number.

    Ranges of the order are sorted side by side and written once; the rows before each range are summed from one small
    row a range. The numbers hang on the values of by alone: rows equal in all of them may swap.
    """
    sorted_rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    kept = written(sorted_rows, "numbered").withColumn("_range", F.shiftright("_id", 33))
    sizes = sorted((r["_range"], r["n"]) for r in kept.groupBy("_range").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for k, size in sizes:
        starts.append((k, total))
        total += size
    offsets = rows.sparkSession.createDataFrame(starts or [(0, 0)], "_r long, _start long")
    joined = kept.join(F.broadcast(offsets), F.col("_range") == F.col("_r"))
    return joined.withColumn("row_number", F.col("_start") + F.col("_id").bitwiseAND(2**33 - 1)).drop("_id", "_range", "_r", "_start"), total


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, row_number, shard, slot) of every row of docs, and the columns carry of docs.

    Rows are numbered by doc_id (null first), then size and checksum; shard and slot follow from the number, the number
    of rows and the seed alone. Shards differ by one row at most, and their slots run from 0 without a gap. Null text:
    size 1 and a null checksum. Repeated rows get places of their own; empty docs give no rows. Carried columns with
    one of the names above are left out.
    """
    text = F.col("text")
    ours = ["doc_id", "size", "text_crc32", "row_number", "shard", "slot"]
    more = [c for c in carry if c not in ours]
    rows = docs.select(F.col("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *more)
    rows, n = numbered(rows, ["doc_id", "size", "text_crc32"])
    place = placed(n, shards, seed)

    @F.pandas_udf("shard int, slot long")
    def dealt(rows: pd.Series) -> pd.DataFrame:
        shard, slot = place(rows.to_numpy())
        return pd.DataFrame({"shard": shard, "slot": slot})

    return rows.withColumn("_place", dealt("row_number")).select("doc_id", "size", "text_crc32", "row_number", "_place.shard", "_place.slot", *more)
