"""Secrets in whole texts: fixed patterns, and weak parts that count only beside a complementary part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from proofline.llm.shared import written

# The base patterns; a match of assign counts if its value, group 2, has 8 characters or more.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
# Weak parts.
ACCOUNT = r"""(?i:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
BEARER = r"[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"""https?://[^\x20\x09-\x0D"'<>]+"""

#: kind, rank in the order of spans, pattern, group whose length counts, least length, part it plays, strong.
KINDS = [
    ("assign", 0, ASSIGN, 2, 8, "secret", True),
    ("access", 1, ACCESS, 0, 16, "identifier", True),
    ("hex", 2, HEX, 0, 32, "secret", True),
    ("account", 3, ACCOUNT, 0, 1, "identifier", False),
    ("bearer", 4, BEARER, 0, 20, "secret", False),
    ("endpoint", 5, ENDPOINT, 0, 1, "endpoint", False),
]
SCOPE = 160


def parts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, rank, part, strong, start, end) of every match in code points, end exclusive.

    A text splits at its matches, so running lengths of gaps and matches are the places of the matches.
    """
    read = []
    for kind, rank, pattern, group, least, part, strong in KINDS:
        matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        zipped = F.arrays_zip(F.split(text, pattern).alias("gap"), matches.alias("all"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
        none = F.filter(zipped, lambda m: F.lit(False))
        read.append(F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), F.lit(part).alias("part"), F.lit(strong).alias("strong"), F.lit(least).alias("least"), F.when(F.col(text).rlike(pattern), zipped).otherwise(none).alias("m")))
    kinds = texts.select(key, F.explode(F.array(*read)).alias("k")).select(key, "k.*")
    hits = kinds.select(key, "kind", "rank", "part", "strong", "least", F.posexplode("m").alias("at", "m")).filter("m.all is not null")
    over = Window.partitionBy(key, "kind").orderBy("at")
    hits = hits.withColumn("end", F.sum(F.length("m.gap") + F.length("m.all")).over(over).cast("long"))
    bearer = F.col("m.all").rlike("[0-9]") & F.col("m.all").rlike("[A-Za-z]")
    hits = hits.filter((F.length("m.value") >= F.col("least")) & ((F.col("kind") != "bearer") | bearer))
    return hits.select(key, "kind", "rank", "part", "strong", (F.col("end") - F.length("m.all")).alias("start"), "end")


def linked(found: DataFrame, key: str, scope: int = SCOPE) -> DataFrame:
    """The weak parts of found that are reported.

    Two parts meet if at most scope characters lie between them. A weak part is reported if it meets a strong part of
    another role, or parts of both other roles; accounts and bearers that overlap a strong part are not. The interval
    join goes by blocks of scope characters: the earlier part goes to each block that its end can reach, the later one
    to the block of its start, so that a block joins the few parts that fit in it.
    """
    early = found.withColumn("_block", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope) + 1)))
    late = found.withColumn("_block", F.floor(F.col("start") / scope))
    cols = ["kind", "rank", "part", "strong", "start", "end"]
    early = early.select(key, "_block", F.struct(*cols).alias("p"))
    late = late.select(key, "_block", F.struct(*cols).alias("q"))
    first = (F.col("p.start") < F.col("q.start")) | ((F.col("p.start") == F.col("q.start")) & (F.col("p.rank") < F.col("q.rank")))
    met = early.join(late, [key, "_block"]).filter(first & (F.col("q.start") - F.col("p.end") <= scope))
    both = met.select(key, F.col("p").alias("a"), F.col("q").alias("b"), (F.col("q.start") < F.col("p.end")).alias("over"))
    both = both.union(both.select(key, "b", "a", "over")).filter("not a.strong")
    others = {"identifier": ("secret", "endpoint"), "secret": ("identifier", "endpoint"), "endpoint": ("identifier", "secret")}
    one, two = (_pick("a.part", {k: v[i] for k, v in others.items()}) for i in (0, 1))
    near = both.groupBy(key, F.col("a").alias("a")).agg(
        F.bool_or(F.col("b.strong") & F.col("over") & (F.col("a.part") != "endpoint")).alias("_taken"),
        F.bool_or(F.col("b.strong") & (F.col("a.part") != F.col("b.part"))).alias("_strong"),
        F.bool_or(F.col("b.part") == one).alias("_one"),
        F.bool_or(F.col("b.part") == two).alias("_two"),
    )
    return near.filter("not _taken and (_strong or (_one and _two))").select(key, *[F.col(f"a.{c}").alias(c) for c in cols])


def _pick(column: str, of: dict) -> Column:
    out = F.lit(None).cast("string")
    for k, v in of.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """docs with secret_spans: array of (start, rank, kind, end, strong), sorted by start and rank; empty without any.

    Null and empty texts have none. Spans depend on the text alone, so equal texts are searched once and repeated rows
    get equal spans. A column secret_spans in docs is replaced, and one named _secret_key dropped. Rows without a text are
    dealt by doc_id, so that they do not meet in one task.
    """
    key = F.coalesce(F.md5(F.col("text").cast("binary")), F.concat(F.lit("-"), F.xxhash64("doc_id").cast("string")))
    docs = docs.drop("secret_spans").withColumn("_secret_key", key)
    any_kind = F.lit(False)
    for _, _, pattern, *_ in KINDS:
        any_kind = any_kind | F.col("text").rlike(pattern)
    texts = docs.filter(any_kind).groupBy(F.col("_secret_key").alias("_key")).agg(F.first("text").alias("_text"))
    found = written(parts(texts, "_key", "_text"), "parts")
    spans = found.filter("strong").unionByName(linked(found, "_key", scope))
    spans = spans.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end", "strong"))).alias("secret_spans"))
    empty = F.expr("cast(array() as array<struct<start: bigint, rank: int, kind: string, end: bigint, strong: boolean>>)")
    joined = docs.join(spans.withColumnRenamed("_key", "_secret_key"), "_secret_key", "left")
    return joined.withColumn("secret_spans", F.coalesce("secret_spans", empty)).drop("_secret_key")


def span_text(spans: Column) -> Column:
    """Spans as kind:start:end, in their order, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
