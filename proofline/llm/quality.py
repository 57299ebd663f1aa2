"""Quality rules over whole documents, with line frequencies across the documents of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.shared import BLANKS, words, written

#: A line of more than LINE_DOCS distinct texts of a host is common: people do not write one line so often, however many
#: texts a host has. A text keeps LEFT_SHARE of its words at least, and LEAST_WORDS of them.
LINE_DOCS, LEFT_SHARE, LEAST_WORDS = 10, 0.5, 50
#: Bits that the place of a window takes at least beside its hash.
PLACE_BITS = 1
#: Tasks that the rows with one text are dealt to.
SALTS = 16


def line_key(line: Column) -> Column:
    """Hash of a line in lower case, blanks squeezed and digits made equal."""
    squeezed = F.regexp_replace(F.btrim(line, F.lit(BLANKS)), r"[\x20\x09-\x0D]+", " ")
    return F.xxhash64(F.regexp_replace(F.lower(squeezed), "[0-9]", "0"))


def text_rules(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Null text counts as no text. Three-word windows are compared within a document only: each is one long that holds
    hash bits above and its place below, so that one primitive sort of an array brings equal windows together. The words
    of windows whose hash bits are equal are compared; in a text where they differ anywhere, the words are sorted instead.
    """
    text = F.coalesce("text", F.lit(""))
    filled = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    read = docs.withColumns({"_ws": words(F.col("text")), "_lines": filled})
    read = read.withColumns({
        "n_words": F.size("_ws").cast("long"),
        "word_chars": F.length(F.array_join("_ws", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_bits": F.expr(f"cast(greatest(ceil(log2(size(_ws) + 1)), {PLACE_BITS}) as int)"),
    })
    packed = "transform(sequence(0, size(_ws) - 3), i -> shiftleft(xxhash64(_ws[i], _ws[i + 1], _ws[i + 2]), _bits) | i)"
    read = read.withColumn("_packed", F.expr(f"case when size(_ws) > 2 then sort_array({packed}) else array() end"))
    hit = "shiftright(x, _bits) = shiftright(get(_packed, i {}), _bits)"
    place = "cast({} & (shiftleft(1L, _bits) - 1) as int)"
    p, q = place.format("x"), place.format("get(_packed, i - 1)")
    differ = " or ".join(f"_ws[{p} + {k}] <> _ws[{q} + {k}]" for k in range(3))
    clash = f"exists(transform(_packed, (x, i) -> coalesce({hit.format('- 1')}, false) and ({differ})), x -> x)"
    twice = f"filter(_packed, (x, i) -> coalesce({hit.format('- 1')}, false) or coalesce({hit.format('+ 1')}, false))"
    by_hash = f"sort_array(transform({twice}, x -> {place.format('x')}))"
    # Only where hashes meet by chance: windows as text, sorted with their places.
    grams = "sort_array(transform(sequence(0, size(_ws) - 3), i -> named_struct('g', concat_ws(' ', _ws[i], _ws[i + 1], _ws[i + 2]), 'i', i)))"
    alike = "filter(g, (x, i) -> coalesce(x.g = get(g, i - 1).g, false) or coalesce(x.g = get(g, i + 1).g, false))"
    by_words = f"sort_array(get(transform(array({grams}), g -> transform({alike}, x -> x.i)), 0))"
    read = read.withColumn("_at", F.expr(f"case when {clash} then {by_words} else {by_hash} end"))
    covered = "aggregate(_at, struct(0L as n, 0L as till), (a, p) -> struct(a.n + p + 3 - greatest(p, a.till) as n, p + 3L as till), a -> a.n)"
    read = read.withColumn("n_repeat_words", F.expr(covered))
    return read.withColumn("base_failed", F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > 50 * n_words")).drop("_ws", "_lines", "_bits", "_packed", "_at")


def _lines(docs: DataFrame, host: str) -> DataFrame:
    """(_host, _text, _line, _words, _first): host, hash of the text, normalised line, its words and whether a text begins with it, for every line with a word."""
    filled = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    split = docs.select(F.col(host).alias("_host"), F.xxhash64("text").alias("_text"), F.posexplode(filled).alias("_pos", "_raw"))
    return split.select("_host", "_text", line_key(F.col("_raw")).alias("_line"), F.size(words(F.col("_raw"))).alias("_words"), (F.col("_pos") == 0).alias("_first"))


def common_lines(lines: DataFrame, least: int = LINE_DOCS, share: float = 0.0) -> DataFrame:
    """(_host, _line): lines of more than least of a host's distinct texts, and of more than share of those with a word.

    Exact copies of a text count once: they are for deduplication to remove. A null host is a host of its own.
    """
    found = lines.groupBy("_host", "_line").agg(F.countDistinct("_text").alias("_in")).filter(F.col("_in") > least)
    if share > 0:
        sizes = lines.filter("_first").groupBy(F.col("_host").alias("_h")).agg(F.countDistinct("_text").alias("_of"))
        found = found.join(sizes, F.col("_host").eqNullSafe(F.col("_h"))).filter(F.col("_in") > share * F.col("_of"))
    return found.select("_host", "_line")


def quality(docs: DataFrame, host: str = "source", least: int = LINE_DOCS, share: float = 0.0, left: float = LEFT_SHARE) -> DataFrame:
    """docs with the columns of text_rules, n_left (words outside common lines), kept, and clean_text.

    clean_text is the text without its common lines (null text: null). A document is kept if it passes the base rules
    and at least the share left of its words, and LEAST_WORDS of them, are outside common lines. Lines are read once and
    written as hashes; what a text loses is summed up there, so that texts stay out of the joins. Rows are never merged:
    repeated rows are each judged; an empty table gives an empty one. Columns of these names in docs are replaced.
    """
    ours = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left", "kept", "clean_text"]
    docs = docs.drop(*ours)
    lines = written(_lines(docs, host), "lines")
    common = written(common_lines(lines, least, share), "common").select(F.col("_host").alias("_h"), F.col("_line").alias("_l"))
    marked = lines.join(common, F.col("_host").eqNullSafe(F.col("_h")) & (F.col("_line") == F.col("_l")), "left")
    hit = F.col("_l").isNotNull()
    bad = marked.groupBy(F.col("_host").alias("_bad_host"), F.col("_text").alias("_bad_text")).agg(
        F.collect_set("_l").alias("_bad"), F.sum(F.when(hit, F.col("_words"))).alias("_lost"), F.count_if(F.col("_first")).alias("_copies")
    )
    bad = written(bad.filter("_lost > 0"), "bad").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Rows without a text have nothing to lose; equal texts of a host are dealt to SALTS tasks.
    ruled = text_rules(docs).withColumn("_key", F.xxhash64("text")).withColumn("_salt0", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    ruled = ruled.withColumn("_host0", F.when(F.col("text").isNotNull(), F.col(host)))
    same = F.col("_host0").eqNullSafe(F.col("_bad_host")) & (F.col("_key") == F.col("_bad_text")) & (F.col("_salt0") == F.col("_salt"))
    joined = ruled.join(bad, same, "left")
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("_bad", line_key(x))), "\n")
    joined = joined.withColumn("clean_text", F.when(F.col("_bad").isNull(), F.col("text")).otherwise(rest))
    joined = joined.withColumn("n_left", F.col("n_words") - F.coalesce((F.col("_lost") / F.col("_copies")).cast("long"), F.lit(0)))
    kept = ~F.col("base_failed") & (F.col("n_left") >= LEAST_WORDS) & (F.col("n_left") >= left * F.col("n_words"))
    return joined.withColumn("kept", kept).drop("_key", "_salt0", "_host0", "_bad_host", "_bad_text", "_bad", "_lost", "_copies", "_salt")
