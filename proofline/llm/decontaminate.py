"""Benchmark decontamination: SimHash of item-sized windows, a multi-index of Hamming blocks, then exact weighted shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.shared import lower_ascii, words, written


#: Fingerprints of 64 bits in BLOCKS blocks; two within RADIUS differ in at most RADIUS // BLOCKS bits of some block.
SHINGLE, SIMILARITY, BLOCKS, RADIUS = 5, 0.8, 8, 23
ROW = ["_d", "_t"]


def _shingled(ws: str, n: int) -> Column:
    """Hashes of the n-word shingles of an array column, in order; of all its words if it has fewer, none without words."""
    several = ", ".join(f"{ws}[i + {k}]" for k in range(n))
    return F.expr(
        f"case when size({ws}) >= {n} then transform(sequence(0, size({ws}) - {n}), i -> xxhash64({several})) "
        f"when size({ws}) > 0 then array(xxhash64(array_join({ws}, ' '))) else cast(array() as array<bigint>) end"
    )


def fingerprint(shingles: str) -> Column:
    """64-bit SimHash of an array of shingle hashes, each as often as it stands there; a bit is set if more than half set it.

    Bits b and b + 32 are counted in the two halves of one long.
    """
    counts = f"transform(sequence(0, 31), b -> aggregate({shingles}, 0L, (n, h) -> n + (shiftright(h, b) & 4294967297L)))"
    low = f"if(2 * (x & 4294967295L) > size({shingles}), shiftleft(1L, i), 0L)"
    high = f"if(2 * shiftright(x, 32) > size({shingles}), shiftleft(1L, i + 32), 0L)"
    return F.expr(f"aggregate(transform({counts}, (x, i) -> {low} | {high}), 0L, (a, x) -> a | x)")


def near_values(value: str, bits: int, errors: int) -> Column:
    """All values of a block of bits that differ from value in errors bits at most."""
    masks = [m for m in range(2**bits) if m.bit_count() <= errors]
    return F.expr(f"transform(array({', '.join(map(str, masks))}), m -> m ^ {value})")


def _blocks(fingerprints: str) -> Column:
    """The blocks of a fingerprint, lowest first."""
    width = 64 // BLOCKS
    return F.expr(f"transform(sequence(0, {BLOCKS - 1}), b -> cast(shiftright({fingerprints}, b * {width}) & {2**width - 1} as int))")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _d and _t, hashes of doc_id and text that name a row; equal rows share them."""
    return docs.withColumns({"_d": F.xxhash64("doc_id"), "_t": F.xxhash64("text")})


def candidate_starts(read: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """(_d, _t, _wanted): for every row the items, each with all starts of windows that can reach the similarity.

    A window of m shingles that does has _need of an item's shingles, repeats counted. So a row and an item are paired
    by any m - _need + 1 of the item's shingles, those that the fewest items hold, and a start stays if _need of the m
    places behind it have a shingle of the item. Both only leave out windows that cannot reach it.
    """
    each = items.select("item_id", "_m", "_need", F.explode("_item").alias("_h"))
    held = each.groupBy("_h").agg(F.count_distinct("item_id").alias("_in"))
    ranked = each.join(held, "_h").groupBy("item_id", "_m", "_need").agg(F.array_sort(F.collect_list(F.struct("_in", "_h"))).alias("_rare"))
    prefix = ranked.select("item_id", F.explode(F.expr("array_distinct(transform(slice(_rare, 1, _m - _need + 1), x -> x._h))")).alias("_h"))
    shared = written(held.select("_h"), "shingles")
    spread = read.select(*ROW, F.size("_ws").alias("_n"), F.posexplode(_shingled("_ws", n)).alias("_pos", "_h"))
    hits = spread.join(shared, "_h").groupBy(*ROW).agg(F.first("_n").alias("_n"), F.array_sort(F.collect_set(F.struct("_pos", "_h"))).alias("_hits"))
    hits = written(hits, "hits")
    pairs = hits.select(*ROW, F.explode(F.expr("array_distinct(transform(_hits, x -> x._h))")).alias("_h")).join(written(prefix, "prefix"), "_h")
    pairs = pairs.select(*ROW, "item_id").distinct().join(hits, ROW).join(items.select("item_id", "_len", "_m", "_need", "_item"), "item_id")
    places = pairs.withColumn("_p", F.expr("transform(filter(_hits, x -> array_contains(_item, x._h)), x -> x._pos)")).filter("size(_p) >= _need")
    first, last = "greatest(_p[j + _need - 1] - _m + 1, 0)", "least(_p[j], _n - _len)"
    ranges = f"filter(transform(sequence(0, size(_p) - _need), j -> named_struct('b', {first}, 'e', {last})), r -> r.b <= r.e)"
    starts = places.select(*ROW, "item_id", "_m", F.expr(f"array_distinct(flatten(transform({ranges}, r -> sequence(r.b, r.e))))").alias("_starts"))
    return starts.filter("size(_starts) > 0").groupBy(*ROW).agg(F.collect_list(F.struct("item_id", "_m", "_starts")).alias("_wanted"))


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(_d, _t, item_id, start, n_words, weight_similarity): the windows of docs that hold a benchmark item.

    _d and _t name a row as keyed() does. A window has as many words as the item, in lower case (A-Z), and starts at any
    word. The similarity is the weight of common shingles over the weight of all, each weighing its occurrences. Every
    window that can reach it with some item gets a fingerprint, and the index of all items of its size tells which items
    are near: each of BLOCKS blocks stands there under all values with the errors that RADIUS allows, so that every
    fingerprint within RADIUS is met. Shingle arrays are compared for those alone. An item shorter than a shingle must
    occur whole. Texts and items without words match nothing.
    """
    items = benchmark.select("item_id", words(lower_ascii(F.col("text"))).alias("_ws")).filter("size(_ws) > 0")
    items = items.select("item_id", F.size("_ws").alias("_len"), _shingled("_ws", n).alias("_item")).withColumns({"_f": fingerprint("_item"), "_m": F.size("_item")})
    items = written(items.withColumn("_need", F.expr(f"cast(ceil({2 * similarity / (1 + similarity)}D * _m - 1e-9D) as int)")), "items")
    long = items.filter(F.col("_len") >= n)
    read = keyed(docs).select(*ROW, words(lower_ascii(F.col("text"))).alias("_ws"))
    wanted = written(candidate_starts(read, long, n), "starts")
    texts = read.join(wanted, ROW).dropDuplicates(ROW).select(*ROW, "_wanted", _shingled("_ws", n).alias("_all"))
    sizes = F.expr("array_distinct(flatten(transform(_wanted, w -> transform(w._starts, s -> named_struct('_m', w._m, 'start', s)))))")
    each = texts.select(*ROW, "_all", F.explode(sizes).alias("_w")).select(*ROW, "_w._m", "_w.start", F.expr("slice(_all, _w.start + 1, _w._m)").alias("_win"))
    windows = written(each.withColumn("_wf", fingerprint("_win")), "windows")
    index = long.select("item_id", "_m", "_f", F.posexplode(_blocks("_f")).alias("_block", "_own"))
    index = index.select("item_id", "_m", "_f", "_block", F.explode(near_values("_own", 64 // BLOCKS, RADIUS // BLOCKS)).alias("_value"))
    probes = windows.select(*ROW, "_m", "start", "_wf", F.posexplode(_blocks("_wf")).alias("_block", "_value"))
    met = probes.join(written(index, "index"), ["_m", "_block", "_value"]).filter(F.bit_count(F.col("_wf").bitwiseXOR(F.col("_f"))) <= RADIUS)
    met = met.select(*ROW, "_m", "start", "item_id").distinct()
    met = windows.drop("_wf").join(met, [*ROW, "_m", "start"]).join(long.select("item_id", "_len", "_item"), "item_id")
    count = "size(filter({0}, y -> y = x))"
    both = (
        "case when size(array_distinct(_win)) = size(_win) or size(array_distinct(_item)) = size(_item) then size(array_intersect(_win, _item)) "
        f"else aggregate(array_distinct(_win), 0, (s, x) -> s + least({count.format('_win')}, {count.format('_item')})) end"
    )
    met = met.withColumn("_both", F.expr(both))
    alike = met.withColumn("weight_similarity", F.col("_both") / (F.size("_win") + F.size("_item") - F.col("_both"))).filter(F.col("weight_similarity") >= similarity)
    found = alike.select(*ROW, "item_id", F.col("start").cast("long").alias("start"), F.col("_len").cast("long").alias("n_words"), "weight_similarity")
    short = items.filter(F.col("_len") < n).select("item_id", "_len", F.col("_item")[0].alias("_h"))
    for row in short.select("_len").distinct().collect():  # lengths under n, so n - 1 at most
        m = row["_len"]
        runs = F.expr(f"case when size(_ws) >= {m} then transform(sequence(1, size(_ws) - {m - 1}), i -> xxhash64(array_join(slice(_ws, i, {m}), ' '))) end")
        hits = read.select(*ROW, F.posexplode(runs).alias("_pos", "_hash")).join(short.filter(F.col("_len") == m), F.col("_hash") == F.col("_h"))
        found = found.union(hits.select(*ROW, "item_id", F.col("_pos").cast("long"), F.lit(m).cast("long"), F.lit(1.0)).distinct())
    return found


def judged(docs: DataFrame, benchmark: DataFrame, n: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with leaks (array of start, item_id, n_words, weight_similarity by place) and clean (no leaks).

    leaks has every window that reaches the similarity, neighbours of the best one too. Rows are judged by their text
    alone, so repeated rows alike. Null and empty texts are clean; with an empty benchmark all are. A null doc_id is a
    name like another. Columns of the added names in docs are replaced.
    """
    docs = docs.drop("leaks", "clean")
    found = contaminated(docs, benchmark, n, similarity).groupBy(*ROW).agg(F.array_sort(F.collect_list(F.struct("start", "item_id", "n_words", "weight_similarity"))).alias("leaks"))
    return keyed(docs).join(found, ROW, "left").drop(*ROW).withColumn("clean", F.col("leaks").isNull())
