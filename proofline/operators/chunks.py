"""User functions over ordered chunks, with quarantine, and greedy packing."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.operators.sequences import PLACED, overlapping_chunks, placed
from proofline.sources.files import scratch_table


#: Rows of a block, and blocks (or groups of them) that are put together in one go.
BLOCK, FAN = 4096, 256


def next_starts(sizes: np.ndarray, whole: bool, most: int, most_bytes: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(end, next): of a chunk that begins at each row its end, and where the next one begins, -1 behind the last.

    whole tells that the rows end with their project; otherwise the last most rows are only looked at.
    """
    n, at = len(sizes), np.arange(len(sizes))
    sums = np.concatenate([[0], np.cumsum(sizes)])
    end = np.minimum(np.searchsorted(sums, sums[:-1] + most_bytes, "right") - 1, np.minimum(at + most, n))
    end = np.maximum(end, at + 1)
    return end, np.where(whole & (end == n), -1, np.maximum(end - overlap, at + 1))


def _block_way(rows: pd.DataFrame, length: int, most: int, most_bytes: int, overlap: int) -> tuple[int, np.ndarray, np.ndarray, int]:
    """The first place of a block, end and next of its rows with those behind it that they reach, and its own rows."""
    rows = rows.sort_values("_r")
    start = int(rows["_block"].iloc[0]) * length
    whole = int(rows["_r"].iloc[-1]) == int(rows["_n"].iloc[0]) - 1
    end, after = next_starts(rows["_s"].to_numpy(np.int64), whole, most, most_bytes, overlap)
    return start, end, after, min(len(rows), length)


def byte_bounded_chunks(df: DataFrame, project: str, order: str, size: str, most: int, most_bytes: int, overlap: int = 0) -> DataFrame:
    """df with chunk: rows packed in order while a chunk has at most most rows and most_bytes; a larger row stands alone.

    The next chunk begins overlap rows before the end of the last, but a row later than it at least, so that rows in two
    chunks occur twice. All rows are kept: a null project is one of its own, a null or negative size counts as 0, rows of one
    order stand as in placed. Where a chunk that begins at a row ends hangs on the next most rows alone, so a project is cut
    to blocks: each tells where one that is entered at any of its first most rows is left, and how many chunks begin
    meanwhile. Blocks are put together FAN at a time, level by level, then entries are told from the top down: a project with
    a third of all rows is many tasks' work, and there are as many rounds as the logarithm of its blocks to FAN.
    """
    if most <= 0 or most_bytes <= 0 or not 0 <= overlap < most:
        raise ValueError("most and most_bytes must be positive, and overlap under most")
    # the rows keep their columns; the packing sees places and sizes only
    rows = placed(df.withColumn("_s", F.greatest(F.lit(0).cast("long"), F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")))), project, order)
    length, fan = max(BLOCK, most), FAN
    mine = (F.col("_r") / length).cast("long")
    halo = F.when((F.col("_r") % length < most) & (F.col("_r") >= length), F.array(mine - 1, mine)).otherwise(F.array(mine))
    thin = scratch_table(rows.select("_g", "_id", "_r", "_n", "_s", F.explode(halo).alias("_block")), "packed")
    options = (length, most, most_bytes, overlap)

    def leave(part: pd.DataFrame) -> pd.DataFrame:
        start, _, after, own = _block_way(part, *options)
        out, count = after.copy(), np.ones(len(after), np.int64)
        for i in range(own - 1, -1, -1):
            if 0 <= after[i] < own:
                out[i], count[i] = out[after[i]], 1 + count[after[i]]
        first = min(most, own)
        return pd.DataFrame({"_g": [part["_g"].iloc[0]], "_b": [start // length], "leave": [np.where(out[:first] < 0, -1, out[:first] + start)], "count": [count[:first]]})

    def climbed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_b")
        entry, total = np.arange(len(part["leave"].iloc[0])) + part["first"].iloc[0], np.zeros(len(part["leave"].iloc[0]), np.int64)
        for first, leave, count in zip(part["first"], part["leave"], part["count"]):
            here = (entry >= first) & (entry - first < len(leave))  # an entry may lie behind a short last block, or be over
            total[here] += count[entry[here] - first]
            entry[here] = leave[entry[here] - first]
        return pd.DataFrame({"_g": [part["_g"].iloc[0]], "_b": [part["_b"].iloc[0] // fan], "first": [part["first"].iloc[0]], "leave": [entry], "count": [total]})

    def told(key: tuple, part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        out, entry, before = [], int(above["entry"].iloc[0]), int(above["before"].iloc[0])
        for b, first, leave, count in part.sort_values("_b")[["_b", "first", "leave", "count"]].itertuples(index=False):
            if first <= entry < first + len(leave):
                out.append((key[0], b, entry, before))
                before, entry = before + int(count[entry - first]), int(leave[entry - first])
        return pd.DataFrame(out, columns=["_g", "_b", "entry", "before"])

    way = "_g long, _b long, first long, leave array<long>, count array<long>"
    levels = [scratch_table(thin.groupBy("_g", "_block").applyInPandas(leave, "_g long, _b long, leave array<long>, count array<long>").selectExpr("_g", "_b", f"_b * {length} as first", "leave", "count"), "ways")]
    while not levels[-1].filter(f"_b >= {fan}").isEmpty():
        levels.append(scratch_table(levels[-1].groupBy("_g", F.floor(F.col("_b") / fan).alias("_up")).applyInPandas(climbed, way), "ways"))
    entries = levels[-1].select("_g").distinct().selectExpr("_g", "0L as _b", "0L as entry", "0L as before")
    for level in reversed(levels):
        above = entries.withColumnRenamed("_b", "_up").groupBy("_g", "_up")
        entries = scratch_table(level.withColumn("_up", F.floor(F.col("_b") / fan)).groupBy("_g", "_up").cogroup(above).applyInPandas(_if_both(told), "_g long, _b long, entry long, before long"), "entries")

    def chunks(key: tuple, part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        start, end, after, own = _block_way(part, *options)
        ids, at, chunk, out = part.sort_values("_r")["_id"].to_numpy(), int(above["entry"].iloc[0]) - start, int(above["before"].iloc[0]), []
        while 0 <= at < own:
            out.append((ids[at : end[at]], np.full(end[at] - at, chunk)))
            at, chunk = int(after[at]), chunk + 1
        return pd.DataFrame({"_id": np.concatenate([i for i, _ in out]), "chunk": np.concatenate([c for _, c in out])})

    packed = thin.groupBy("_g", F.col("_block").alias("_b")).cogroup(entries.groupBy("_g", "_b")).applyInPandas(_if_both(chunks), "_id long, chunk int")
    return rows.join(packed, "_id").drop(*PLACED, "_s")


def _if_both(f: Callable) -> Callable:
    """f(key, left, right) where both sides have rows, else no rows."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return f(key, left, right) if len(left) and len(right) else pd.DataFrame()

    return run


def map_chunks(df: DataFrame, project: str, order: str, key: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, size: int, salt: int = 0) -> tuple[DataFrame, DataFrame]:
    """Applies fn to ordered chunks of size rows: its rows (key, schema) and the quarantined ones (key, error).

    fn gives one row for each key. A chunk for which it fails, or gives other keys, is halved until the rows at fault
    stand alone, so that good and quarantined rows are the input.
    """
    chunked = overlapping_chunks(df, size, 0, project, order)
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    kind = df.schema[key].dataType.simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out, todo = [], [part]
        while todo:
            rows = todo.pop()
            try:
                told = fn(rows)
                if sorted(told[key]) != sorted(rows[key]):
                    raise ValueError("other ids")
                out.append(told[[key, *names]].assign(error=None))
            except Exception as fault:  # whatever a user function raises
                if len(rows) == 1:
                    out.append(pd.DataFrame({key: rows[key], **dict.fromkeys(names), "error": [f"{type(fault).__name__}: {fault}"[:200]]}))
                else:
                    half = len(rows) // 2
                    todo += [rows.iloc[half:], rows.iloc[:half]]
        return pd.concat(out)[[key, *names, "error"]]

    told = chunked.groupBy(project, "chunk").applyInPandas(run, f"{key} {kind}, {schema}, error string")
    return told.filter("error is null").drop("error"), told.filter("error is not null").select(key, "error")


def map_reduce_text(df: DataFrame, project: str, order: str, key: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, size: int, reduce: list) -> DataFrame:
    """map_chunks, then aggregates of the good rows by project, with the number of rows that are missing."""
    good, bad = map_chunks(df, project, order, key, fn, schema, size)
    told = df.select(project, key).join(good, key, "left").join(bad.select(key, F.lit(1).alias("_bad")), key, "left")
    return told.groupBy(project).agg(*reduce, F.count("_bad").alias("missing"))
