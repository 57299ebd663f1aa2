"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.shared import written

TEMPERATURE, EPOCHS, SEED = 0.5, 1.0, 17


def rates(docs: DataFrame, weights: DataFrame | None = None, source: str = "source", temperature: float = TEMPERATURE, epochs: float = EPOCHS) -> DataFrame:
    """One row for each source: _source, mix_rate (mean copies of its documents) and _cdf (Poisson sums for 0, 1, ...).

    A document's size is its characters plus 1 (null text: 1). The copies of a source have, in the mean, its share of
    epochs times the size of all documents. weights: (source, weight), where a source without a row gets none; by
    default the weight is the source's size to the power temperature.
    """
    sizes = docs.groupBy(F.col(source).alias("_source")).agg(F.sum(F.length(F.coalesce("text", F.lit(""))) + 1).alias("_size"))
    if weights is None:
        sizes = sizes.withColumn("_weight", F.pow(F.col("_size").cast("double"), F.lit(temperature)))
    else:
        given = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("_weight"))
        sizes = sizes.join(given, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0.0, ["_weight"])
    total = sizes.agg(F.sum("_size").alias("_all"), F.sum("_weight").alias("_weights"))
    rated = sizes.crossJoin(F.broadcast(total)).withColumn("mix_rate", F.when(F.col("_weights") > 0, epochs * F.col("_all") * F.col("_weight") / F.col("_weights") / F.col("_size")).otherwise(0.0))
    step = "named_struct('c', array_append(a.c, a.s + exp(a.p + ln(mix_rate / k))), 'p', a.p + ln(mix_rate / k), 's', a.s + exp(a.p + ln(mix_rate / k)))"
    start = "named_struct('c', array(exp(-mix_rate)), 'p', -mix_rate, 's', exp(-mix_rate))"
    cdf = f"case when mix_rate > 0 then aggregate(sequence(1, cast(ceil(mix_rate + 12 * sqrt(mix_rate) + 40) as int)), {start}, (a, k) -> {step}, a -> a.c) else array(1.0D) end"
    return rated.select("_source", "mix_rate", F.expr(cdf).alias("_cdf"))


def mix(docs: DataFrame, weights: DataFrame | None = None, source: str = "source", temperature: float = TEMPERATURE, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """docs, each row as often as its Poisson count says, in one global random order; adds mix_rate, mix_copies, mix_copy, mix_key.

    The count inverts the Poisson sums at a number in [0, 1) hashed from seed and doc_id (null doc_id: from the text),
    so it is the same in every run and on every cluster; repeated rows share their count. Copies are numbered from 1.
    Rows are dealt to partitions by mix_key, a hash of document and copy, and sorted by it within each: neither a hot
    source nor a document with many copies gathers in a task. Columns of the added names in docs are replaced.
    """
    docs = docs.drop("mix_rate", "mix_copies", "mix_copy", "mix_key")
    rated = written(rates(docs, weights, source, temperature, epochs), "rates")
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary")), F.lit(""))
    drawn = docs.withColumn("_u", F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), 1, 13), 16, 10).cast("double") / float(2**52))
    drawn = drawn.join(rated, F.col(source).eqNullSafe(F.col("_source"))).withColumn("mix_copies", F.size(F.filter("_cdf", lambda c: c <= F.col("_u"))).cast("long"))
    copies = drawn.filter("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).withColumn("mix_copy", F.col("mix_copy").cast("long"))
    key = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), name, F.col("mix_copy").cast("string")).cast("binary")), 1, 16)
    keyed = copies.withColumn("mix_key", key).drop("_u", "_source", "_cdf")
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key", "doc_id")
