"""How the filters of a chain share their work, for every order in which they can stand."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm.shared import BLANKS, BREAK, written

FILTERS = "ABCDE"


def orders(filters: str) -> list[str]:
    """All orders of the filters; an order's place in the list is its Lehmer rank."""
    return ["".join(p) for p in permutations(sorted(filters))]


def removal_intervals(n: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, begin, end): in the orders of ranks begin to end - 1, what fails the filters of mask goes at step.

    A step is fixed by the filters that stand up to it: none of mask's, and then one of them. Orders with the same first
    filters are neighbours, from the rank of their Lehmer digits on, and (n - step)! of them. Touching intervals are one.
    """
    ends: dict[tuple[int, int, int], int] = {}
    for step in range(1, n + 1):
        for prefix in permutations(range(n), step):
            digits = [sum(later < f for later in range(n) if later not in prefix[:i]) for i, f in enumerate(prefix)]
            begin = sum(d * factorial(n - 1 - i) for i, d in enumerate(digits))
            before, last = sum(1 << f for f in prefix[:-1]), 1 << prefix[-1]
            for mask in range(1, 1 << n):
                if mask & last and not mask & before:
                    ends[mask, step, begin] = begin + factorial(n - step)
    for mask, step, begin in sorted(ends, reverse=True):
        if (then := ends[mask, step, begin]) and (mask, step, then) in ends:
            ends[mask, step, begin] = ends.pop((mask, step, then))
    return [(*key, end) for key, end in sorted(ends.items())]


def interaction_audit(marked: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order and step of marked (part, mask, rows, good, toxic), mask having a bit for each failing filter.

    The rows of a mask that go at a step do so in intervals of ranks: their number is added where an interval begins and
    taken off where it ends, so that a running sum over the ranks gives each order's removals. Only sums by part and mask
    are shuffled, so that a part may hold any share of the rows; what follows has 120 ranks by 5 steps for each part, and the
    table of intervals depends on the number of filters alone (587 rows for five). Null parts count as the empty string,
    repeated rows of marked are added up; an empty table gives no rows.
    """
    spark, n, ranks = marked.sparkSession, len(filters), factorial(len(filters))
    sums = [F.sum(c).alias(c) for c in ("rows", "good", "toxic")]
    counts = marked.groupBy(F.coalesce("part", F.lit("")).alias("part"), "mask").agg(*sums)
    bit = lambda i: F.shiftleft(F.lit(1), i)
    totals = counts.groupBy("part").agg(
        F.sum("rows").alias("total"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(bit(i)) != 0, F.col("rows"))), F.lit(0)) for i in range(n)]).alias("fails"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == bit(i), F.col("rows"))), F.lit(0)) for i in range(n)]).alias("alone"),
    )
    intervals = spark.createDataFrame(removal_intervals(n), "mask int, step int, begin int, end int")
    edge = F.explode(F.array(F.struct(F.col("begin").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("end").alias("rank"), F.lit(-1).alias("sign")))).alias("_e")
    edges = counts.join(F.broadcast(intervals), "mask").select("part", "step", "rows", "good", "toxic", edge)
    changes = edges.groupBy("part", "step", F.col("_e.rank").alias("rank")).agg(*[F.sum(F.col(c) * F.col("_e.sign")).alias(c) for c in ("rows", "good", "toxic")])
    grid = totals.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    upto = Window.partitionBy("part", "step").orderBy("rank")
    running = [F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(name) for c, name in (("rows", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))]
    names = F.array(*[F.lit(o) for o in orders(filters)])
    steps = grid.join(changes, ["part", "step", "rank"], "left").select("part", "rank", "step", "total", "fails", "alone", *running)
    named = steps.withColumn("filter_order", F.element_at(names, F.col("rank") + 1)).withColumn("_f", F.substring("filter_order", F.col("step"), F.lit(1)))
    place = F.instr(F.lit("".join(sorted(filters))), F.col("_f"))
    return named.select(
        "part", "filter_order", "step",
        (F.col("total") - F.sum("removed").over(Window.partitionBy("part", "rank").orderBy("step"))).alias("kept"),
        "removed",
        (F.element_at("fails", place) - F.col("removed")).alias("redundant"),
        F.element_at("alone", place).alias("unique_fails"),
        "good_lost", "toxic_lost",
        F.sum("removed").over(Window.partitionBy("part", "_f")).alias("shapley"),
    )


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text: few words, repeated words, capitals, symbols. Null text: empty."""
    text = F.coalesce(text, F.lit(""))
    bare = F.btrim(text, F.lit(BLANKS))
    words = F.when(bare != "", F.split(bare, BREAK))
    n, different = F.coalesce(F.size(words), F.lit(0)), F.coalesce(F.size(F.array_distinct(words)), F.lit(0))
    n, different = F.greatest(n, F.lit(0)), F.greatest(different, F.lit(0))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {"A": n < 100, "B": 100 * different < 80 * n, "C": 100 * capitals > 10 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def marked_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, rows, good, toxic): documents by language, failing filters and labels.

    A text is told by its SHA-256. The first holder of a text is found among rows that are counted by document, language
    and text before any of them is shuffled, and met again by document and text, so that a text with a third of all rows
    stays spread. A document without a doc_id is neither a copy nor the original of one; rows of one doc_id are no copies of
    each other. A document with several labels is good or toxic if any of them says so.
    """
    fails = text_failures(F.col("text"))
    mask = sum((F.when(fails[f], 1 << i).otherwise(0) for i, f in enumerate("ABCD")), F.lit(0)).cast("int").alias("mask")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest")
    told = written(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), digest, mask).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("rows")), "marked")
    firsts = told.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    rows = told.join(firsts, ["digest", "doc_id"], "left").join(known, "doc_id", "left")
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << 4).otherwise(0)
    return rows.select("part", (F.col("mask") + copy).cast("int").alias("mask"), "rows", *[(F.col("rows") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])


def document_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """interaction_audit of the five filters over whole documents; see marked_documents for nulls, ties and repeats."""
    return interaction_audit(marked_documents(docs, labels))

