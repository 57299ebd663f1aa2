"""Operators over texts: sentence tables, token tables, lexicon joins, style reports, copy detection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions import lexicons as L
from proofline.functions import text as T
from proofline.sources.files import scratch_table


def split_sentences(df: DataFrame, key: str, text: str = "text", least: int = 12) -> DataFrame:
    """(key, pos, sentence), pos from 0 among the sentences that stay."""
    return df.select(key, F.posexplode(T.sentences(F.col(text), least)).alias("pos", "sentence"))


def estimate_duration(df: DataFrame, styles: DataFrame, text: str = "text", style: str = "style") -> DataFrame:
    """df with words (runs without blanks) and seconds, at the rate (style, per_second) of its style; an unknown style gives null."""
    counted = df.withColumn("words", T.word_count(F.col(text)))
    return counted.join(styles, style, "left").withColumn("seconds", F.when(F.col("per_second").isNotNull(), T.spoken_seconds(F.col("words"), F.col("per_second")))).drop("per_second")


def spoken_tokens(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, pos, word, display): blank-separated tokens that show something, pos as in the text from 0."""
    split = df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"\S+"), F.lit(0))).alias("pos", "word"))
    return split.withColumn("display", T.display_text(F.col("word"))).filter("display <> ''")


def beat_kind(df: DataFrame, lexicon: DataFrame, attributes: DataFrame, keys: list[str], text: str = "text", section: str = "section") -> DataFrame:
    """(keys, kind, ...) by the most urgent lexicon word (word, kind, priority), else the section's default kind.

    attributes: (kind, default_section, ...); the other columns, such as intent, emotion and offset, are told of the kind.
    """
    words = df.select(*keys, F.explode_outer(F.array_distinct(T.tokens(F.col(text)))).alias("word"))
    found = words.join(lexicon, "word").groupBy(*keys).agg(F.min_by("kind", F.struct("priority", "kind")).alias("found"))
    defaults = attributes.filter("default_section is not null").select(F.col("default_section").alias(section), F.col("kind").alias("fallback"))
    joined = df.select(*keys, section).join(found, keys, "left").join(defaults, section, "left")
    more = [c for c in attributes.columns if c not in ("kind", "default_section")]
    return joined.withColumn("kind", F.coalesce("found", "fallback", F.lit("event"))).join(attributes.select("kind", *more), "kind", "left").select(*keys, "kind", *more)


def timed_event_words(words: DataFrame, lexicon: DataFrame, keys: list[str]) -> DataFrame:
    """Words (keys, pos, word, start_s, end_s) with the tag of the first lexicon (word, tag, rank) that has them, and impact."""
    tagged = words.withColumn("_w", F.lower(F.regexp_replace("word", r"[^\p{L}\p{N}]", "")))
    joined = tagged.join(lexicon.withColumnRenamed("word", "_w"), "_w")
    first = Window.partitionBy(*keys, "pos").orderBy("rank", "tag")
    return joined.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*keys, "pos", "word", "tag", "impact", "start_s", "end_s")


def mixed_language(df: DataFrame, key: str, own: dict[str, list[str]], foreign: dict[str, list[str]], text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, own_hits, foreign_hits, passed): fails if a text has stop words of its language and of another."""
    pick = lambda lists: F.coalesce(*[F.when(F.col(lang) == k, T.hits(F.col(text), words)) for k, words in lists.items()], F.lit(0))
    out = df.select(key, pick(own).alias("own_hits"), pick(foreign).alias("foreign_hits"))
    return out.withColumn("passed", ~((F.col("own_hits") > 0) & (F.col("foreign_hits") > 0)))


def distinct_lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, line): the first of each set of equal lines of a text, blanks squeezed, in order; empty lines go."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "_l")).withColumn("line", F.trim(F.regexp_replace("_l", r"\s+", " "))).filter("line <> ''")
    return lines.groupBy(key, "line").agg(F.min("pos").alias("pos")).select(key, "pos", "line")


def trim_to_budget(df: DataFrame, key: str, seconds: float, per_second: float, text: str = "text") -> DataFrame:
    """(key, n_kept, seconds, text): the leading sentences that fit into seconds, always one."""
    spoken = split_sentences(df, key, text).withColumn("_w", T.narration_word_count(F.col("sentence")))
    so_far = F.sum("_w").over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    kept = spoken.withColumn("_t", so_far / per_second).filter((F.col("_t") <= seconds) | (F.col("pos") == 0))
    return kept.groupBy(key).agg(F.count("*").alias("n_kept"), F.round(F.max("_t"), 6).alias("seconds"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda s: s["sentence"]), " ").alias("text"))


def entity_mentions(df: DataFrame, project: str, source: str, stop: list[str], roles: list[str], text: str = "text", top: int = 8, other: str = "extra") -> DataFrame:
    """(project, name, mentions, first_source, place, role): capitalised words of 3 letters or more in a project's sentences.

    Names that occur twice at least, the top by count then name; stop words count whatever their case. first_source is
    the smallest source with the name; places behind the roles have the role other.
    """
    spoken = df.select(project, source, F.explode(T.sentences(F.col(text))).alias("_s"))
    words = spoken.select(project, source, F.explode(F.regexp_extract_all("_s", F.lit(r"[\p{L}\p{N}_']+"), F.lit(0))).alias("_w")).withColumn("name", F.btrim("_w", F.lit("'")))
    names = words.filter(F.col("name").rlike("^[A-Z][a-zà-ÿA-Z']{2,}$") & ~F.lower("name").isin(*[s.lower() for s in stop]))
    counted = names.groupBy(project, "name").agg(F.count("*").alias("mentions"), F.min(source).alias("first_source")).filter("mentions >= 2")
    ranked = counted.withColumn("place", F.row_number().over(Window.partitionBy(project).orderBy(F.desc("mentions"), "name"))).filter(F.col("place") <= top)
    return ranked.withColumn("role", F.coalesce(F.get(F.array(*map(F.lit, roles)), F.col("place") - 1), F.lit(other)))


def locations(df: DataFrame, key: str, prepositions: list[str], text: str = "text", top: int = 6) -> DataFrame:
    """(key, place, phrase): distinct capitalised phrases behind a preposition, by first sight, the first top."""
    pattern = rf"\b(?:{'|'.join(prepositions)}) ([A-Z][a-z]+(?: [A-Z][a-z]+)*)"
    seen = df.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("pos", "phrase")).groupBy(key, "phrase").agg(F.min("pos").alias("pos"))
    return seen.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).filter(F.col("place") <= top).select(key, "place", "phrase")


def best_sentence(df: DataFrame, key: str, cues: list[str], text: str = "text", late: bool = False) -> DataFrame:
    """(key, pos, sentence, score): most cues, the earliest of equals; late: only the second half. Without a cue the middle one (late: the last)."""
    scored = split_sentences(df, key, text).withColumn("score", T.cue_score(F.col("sentence"), cues))
    scored = scored.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    half = F.col("pos") >= F.floor(F.col("_n") / 2) if late else F.lit(True)
    fallback = F.col("pos") == (F.col("_n") - 1 if late else F.floor(F.col("_n") / 2))
    rank = F.struct(F.when(half, F.col("score")).otherwise(0).alias("s"), F.when((F.col("score") > 0) & half, 0).when(fallback, 1).otherwise(0).alias("f"), (-F.col("pos")).alias("p"))
    return scored.groupBy(key).agg(F.max_by(F.struct("pos", "sentence", "score"), rank).alias("b")).select(key, "b.*")


def style_report(df: DataFrame, key: str, connectors: list[str], text: str = "text") -> DataFrame:
    """One row for each text with a sentence: words, sentence-length percentiles (nearest rank), variance, repetition and connectors.

    A text's sentences are arrays in its row, so that nothing is shuffled.
    """
    n = F.size("_s")
    told = lambda x: F.struct(x.alias("text"), F.lower(x).alias("low"), T.narration_word_count(x).alias("words"))
    rows = df.select(key, F.filter(F.transform(T.pieces(F.col(text)), told), lambda x: x["words"] > 0).alias("_s")).filter(n > 0)
    of = lambda f: F.transform("_s", f)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    repeated = lambda a: F.round(1 - F.size(F.array_distinct(a)) / n, 6)
    opening = lambda x: F.array_join(F.slice(F.split(x["low"], r"\s+"), 1, 2), " ")
    rows = rows.select(key, "_s", F.array_sort(of(lambda x: x["words"])).alias("_sorted"), total(of(lambda x: x["words"])).alias("n_words"))
    rank = lambda f: F.element_at("_sorted", (F.bround(F.lit(f) * (n - 1), 0) + 1).cast("int"))
    spread = F.aggregate("_sorted", F.lit(0.0), lambda s, w: s + (w - F.col("n_words") / n) * (w - F.col("n_words") / n)) / n
    holds = lambda connector: lambda x: F.contains(x["low"], F.lit(f" {connector} "))
    linked = [F.exists("_s", holds(c)) for c in connectors]
    joined = F.size(F.filter("_s", lambda x: reduce(lambda a, b: a | b, [holds(c)(x) for c in connectors], F.lit(False))))
    return rows.select(
        key, n.cast("long").alias("n_sentences"), "n_words", rank(0.1).alias("p10"), rank(0.5).alias("p50"), rank(0.9).alias("p90"), F.round(spread, 6).alias("length_variance"),
        repeated(of(lambda x: x["low"])).alias("repeated_sentences"), repeated(of(opening)).alias("repeated_openings"),
        sum((x.cast("int") for x in linked), F.lit(0)).alias("n_connectors"), F.round(joined / n, 6).alias("connected_share"),
        total(of(lambda x: F.regexp_count(x["text"], F.lit("[A-Za-z]'[A-Za-z]")))).alias("n_contractions"),
    )


def style_warnings(report: DataFrame, key: str, flagged: dict[str, DataFrame] | None = None) -> DataFrame:
    """(key, codes): sorted codes of what a style report has against a text.

    RHYTHM if its sentences are all of one length, TEMPLATE_RISK if a sentence or an opening repeats. flagged adds codes of
    other checks, each with the keys it holds for; keys may repeat there, and those without a report are left out.
    """
    out, codes = report, [F.when((F.col("n_sentences") > 0) & (F.col("length_variance") == 0), F.lit("RHYTHM")), F.when((F.col("repeated_sentences") > 0) | (F.col("repeated_openings") > 0), F.lit("TEMPLATE_RISK"))]
    if flagged:
        told = reduce(lambda a, b: a.unionByName(b), [df.select(key, F.lit(code).alias("_code")) for code, df in flagged.items()])
        out = report.join(told.groupBy(key).agg(F.collect_set("_code").alias("_told")), key, "left")
    more = F.coalesce("_told", F.array().cast("array<string>")) if flagged else F.array().cast("array<string>")
    return out.select(key, F.array_join(F.array_sort(F.concat(F.array_compact(F.array(*codes)), more)), ",").alias("codes"))


#: A sketch of protected runs has 16 places for each of them, between 2 ** 16 and 2 ** 26 (8 MB), two of which a run takes.
SKETCH = (16, 26)


def _sketch(runs: DataFrame, bits: int) -> DataFrame:
    """One row with _bits: places 0 to 2 ** bits - 1 as numbers of 64, those of the hashes _h of runs being set."""
    at = runs.select(F.explode(F.array(*_places(F.col("_h"), bits))).alias("_at"))
    words = at.groupBy(F.shiftright("_at", 6).alias("_w")).agg(F.expr("bit_or(shiftleft(1L, cast(_at & 63 as int)))").alias("_v"))
    every = runs.sparkSession.range(1 << (bits - 6)).withColumnRenamed("id", "_w").join(words, "_w", "left").select(F.struct("_w", F.coalesce("_v", F.lit(0)).alias("_v")).alias("_x"))
    return every.agg(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["_v"]).alias("_bits"))


def _places(h: Column, bits: int) -> list[Column]:
    """Two places of a hash, from its lower and its upper bits."""
    return [h.bitwiseAND((1 << bits) - 1), F.shiftrightunsigned(h, 64 - bits)]


def runs_within(a: DataFrame, b: DataFrame, key: str, n: int, words: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """(key, n_shingles, n_shared): a text's distinct runs of n words, and how many of them stand in a text of b.

    Runs of a are hashes in the row of their text, of 64 bits, which also tell how many there are; then each is a row of its
    own. A sketch of b's runs, of 8 MB at most whatever b's size, goes to all tasks, and only runs that it may hold are
    compared by their words with b's. A text without n words has no runs; null is empty.
    """
    hashes = F.when(F.size("_ws") >= n, F.transform(F.sequence(F.lit(0), F.size("_ws") - n), lambda i: F.xxhash64(F.slice("_ws", i + 1, n))))
    run = lambda i: F.array_join(F.slice("_ws", i + 1, n), " ")
    split = lambda df, *keep: df.select(*keep, words(F.coalesce(F.col(text), F.lit(""))).alias("_ws")).withColumn("_hs", F.coalesce(hashes, F.array().cast("array<bigint>")))
    theirs = scratch_table(split(b).select(F.explode(F.transform("_hs", lambda h, i: F.struct(h.alias("_h"), run(i).alias("_run")))).alias("_x")).select("_x.*").distinct(), "runs")
    bits = min(max((16 * theirs.count()).bit_length(), SKETCH[0]), SKETCH[1])
    known = reduce(lambda x, y: x & y, [F.getbit(F.get("_bits", F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1 for p in _places(F.col("_h"), bits)])
    each = split(a, key).select(key, "_ws", "_hs", F.posexplode(F.array_append("_hs", F.lit(None))).alias("_i", "_h"))  # the null counts
    met = each.join(F.broadcast(_sketch(theirs, bits))).filter(F.col("_h").isNull() | known)
    rows = scratch_table(met.select(key, "_h", F.when(F.col("_h").isNull(), F.size(F.array_distinct("_hs")).cast("long")).alias("n_shingles"), F.when(F.col("_h").isNotNull(), run(F.col("_i"))).alias("_run")), "hits")
    hits = rows.filter("_h is not null").select(key, "_h", "_run").distinct()
    shared = hits.join(theirs, ["_h", "_run"], "left_semi").groupBy(key).agg(F.count("*").alias("n_shared"))
    rows = rows.filter("_h is null")
    return rows.select(key, "n_shingles").join(shared, key, "left").select(key, "n_shingles", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))


def shingle_overlap(a: DataFrame, b: DataFrame, key: str, n: int = 5, low: float = 0.25, high: float = 0.5, text: str = "text") -> DataFrame:
    """(key, n_shingles, n_shared, overlap, band): the share of a text's distinct n-word runs that occur in b; 0 without any."""
    out = runs_within(a, b, key, n, T.tokens, text)
    out = out.withColumn("overlap", F.round(F.when(F.col("n_shingles") > 0, F.col("n_shared") / F.col("n_shingles")).otherwise(0.0), 6))
    return out.withColumn("band", F.when(F.col("overlap") >= high, "block").when(F.col("overlap") >= low, "warn").otherwise("clear"))


def copied_ngram_exists(a: DataFrame, b: DataFrame, key: str, n: int = 4, text: str = "text") -> DataFrame:
    """(key, copied): whether a text shares a run of n words with protected text b; words are runs of letters and digits, folded."""
    return runs_within(a, b, key, n, T.lexical_words, text).select(key, (F.col("n_shared") > 0).alias("copied"))


def narration_contract(df: DataFrame, protected: DataFrame, key: str, words: str, seconds: str, per_second: float, window: tuple[int, int] = (115, 125), spoken: tuple[float, float] = (50.0, 60.0), text: str = "text") -> DataFrame:
    """(key, codes): sorted codes of a narration whose words or seconds are outside their window or not as stated, or that copies four words in a row."""
    n = T.narration_word_count(F.col(text))
    told = df.select(key, n.alias("_n"), T.spoken_seconds(n, F.lit(per_second)).alias("_s"), F.col(words).alias("_words"), F.col(seconds).alias("_seconds"))
    told = told.join(copied_ngram_exists(df, protected, key, 4, text), key)
    rules = {
        "COPIED": F.col("copied"), "DURATION": ~F.col("_s").between(*spoken) | ~F.coalesce(F.abs(F.col("_seconds") - F.col("_s")) <= 0.001, F.lit(False)),
        "WORDS": ~F.col("_n").between(*window) | ~F.col("_words").eqNullSafe(F.col("_n")),
    }
    return told.select(key, F.array_join(F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules.items()])), ",").alias("codes"))


SECTIONS = ("hook", "setup", "conflict", "twist", "cta")
SPOKEN_WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"


def script_checks(df: DataFrame, project: str, pos: str, section: str, evidence: str, insight: list[str], per_second: float, target: float, text: str = "text") -> DataFrame:
    """(project, code, n): what is against the script whose sections (pos, section, text, evidence array) a project has.

    TOO_LONG and TOO_SHORT: spoken seconds, rounded, over 1.1 or under 0.4 times target. EMPTY_SECTION, MISSING_SECTION:
    blank rows, and names of SECTIONS without a text. REPETITION: sentences of 15 letters or more in two sections.
    SENTENCE_FRAGMENT, REPEATED_SENTENCE, REPEATED_PHRASE: sentences under three words, sentences and, in scripts of
    12 words or more, runs of three words that stand twice; runs go over the borders of sections, sentences do not.
    INSIGHT_MISSING: no marker in the twist. HOOK_REPEATS_SETUP, CTA_CONTEXT_MISSING: equal texts; no word shared with
    another section. EVIDENCE_MISSING: none in setup, conflict or twist. Of a section that a project has twice, the last
    counts for the rules of names. A null text is empty; a project without a fault has no row; an empty table gives none.
    """
    words = F.regexp_extract_all(F.lower("_text"), F.lit(SPOKEN_WORD), F.lit(0))
    rows = df.select(F.col(project).alias("_p"), F.col(pos).alias("_pos"), F.col(section).alias("_section"), F.coalesce(F.col(evidence), F.array()).alias("_cites"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_words", words)
    flag = lambda code, test: F.when(test, F.struct(F.lit(code).alias("code"), F.lit(1).cast("long").alias("n")))
    tally = lambda code, n: F.when(n > 0, F.struct(F.lit(code).alias("code"), n.cast("long").alias("n")))
    last = lambda name, what: F.max_by(what, F.when(F.col("_section") == name, F.col("_pos")))
    of = rows.groupBy("_p").agg(
        F.sum(T.word_count(F.col("_text"))).alias("spoken"), F.count_if(~F.col("_text").rlike(r"\S")).alias("empty"), F.sum(F.size("_words")).alias("said"),
        F.max((F.size("_cites") > 0) & F.col("_section").isin("setup", "conflict", "twist")).alias("proved"),
        *[last(name, F.lower("_text")).alias(name) for name in SECTIONS],
    )
    seconds = T.spoken_seconds(F.col("spoken"), F.lit(per_second))
    missing = sum((~F.coalesce(F.col(name), F.lit("")).rlike(r"\S")).cast("int") for name in SECTIONS)
    faults = F.array_compact(F.array(
        flag("TOO_LONG", seconds > target * 1.1), flag("TOO_SHORT", seconds < target * 0.4), tally("EMPTY_SECTION", F.col("empty")), tally("MISSING_SECTION", missing),
        flag("INSIGHT_MISSING", T.cue_score(F.coalesce("twist", F.lit("")), insight) == 0), flag("HOOK_REPEATS_SETUP", F.coalesce("hook", F.lit("")) == F.col("setup")),
        flag("EVIDENCE_MISSING", ~F.coalesce("proved", F.lit(False))),
    ))
    told = of.select("_p", F.inline(faults))

    sentence = rows.select("_p", "_section", F.explode(T.pieces(F.col("_text"))).alias("_s"))
    sentence = sentence.select("_p", "_section", F.regexp_count(F.lower("_s"), F.lit(SPOKEN_WORD)).alias("_n"), F.trim(F.regexp_replace(F.lower("_s"), "[^a-z0-9]+", " ")).alias("_key"), F.regexp_replace(F.lower("_s"), r"[^\p{L}\p{N}_]+", "").alias("_letters"))
    count = lambda found, code: found.groupBy("_p").agg(F.lit(code).alias("code"), F.count("*").alias("n"))
    short = count(sentence.filter("_n < 3"), "SENTENCE_FRAGMENT")
    twice = count(sentence.groupBy("_p", "_key").count().filter("count > 1"), "REPEATED_SENTENCE")
    shared = count(sentence.filter("length(_letters) >= 15").groupBy("_p", "_letters").agg(F.min("_section").alias("a"), F.max("_section").alias("b")).filter("a <> b"), "REPETITION")

    spoken, order = rows.filter(F.size("_words") > 0), Window.partitionBy("_p").orderBy("_pos")
    ahead = [F.coalesce(F.lead(F.slice("_words", 1, 2), k).over(order), F.array().cast("array<string>")) for k in (1, 2)]
    run = spoken.select("_p", F.concat("_words", F.slice(F.concat(*ahead), 1, 2)).alias("_w"))
    run = run.select("_p", F.explode(F.expr("transform(sequence(1, greatest(size(_w) - 2, 1)), i -> if(size(_w) < 3, null, array_join(slice(_w, i, 3), ' ')))")).alias("_run"))
    again = run.filter("_run is not null").groupBy("_p", "_run").count().filter("count > 1").join(of.filter("said >= 12").select("_p"), "_p", "left_semi")
    closing = rows.filter("_section = 'cta'").groupBy("_p").agg(F.max_by("_words", "_pos").alias("_w")).select("_p", F.explode("_w").alias("_word")).distinct()
    others = rows.filter("_section is distinct from 'cta'").select("_p", F.explode("_words").alias("_word")).distinct()
    tied = closing.join(others, ["_p", "_word"], "left_semi").select("_p").distinct()
    loose = of.select("_p").join(tied, "_p", "left_anti").select("_p", F.lit("CTA_CONTEXT_MISSING").alias("code"), F.lit(1).cast("long").alias("n"))
    parts = [told, short, twice, shared, count(again, "REPEATED_PHRASE"), loose]
    return reduce(lambda a, b: a.unionByName(b), parts).select(F.col("_p").alias(project), "code", "n")


def publishable(df: DataFrame, status: str = "rights_status") -> DataFrame:
    """df with passed: its rights are declared or verified; a null status does not pass."""
    return df.withColumn("passed", F.coalesce(F.col(status).isin("declared", "verified"), F.lit(False)))


def marker_hits(df: DataFrame, project: str, key: str, markers: list[str], test: str, text: str = "text") -> DataFrame:
    """(project, key, severity) of texts with a marker; an info if all of a project's hits also say test, else an error."""
    low = F.lower(text)
    any_marker = F.exists(F.array(*[F.lit(m.lower()) for m in markers]), lambda m: F.contains(low, m))
    hit = df.filter(any_marker).select(project, key, F.contains(low, F.lit(test)).alias("_test"))
    return hit.select(project, key, F.when(F.min(F.col("_test").cast("int")).over(Window.partitionBy(project)) == 1, "info").otherwise("error").alias("severity"))


#: Terms, and characters of all of them, that go to every task.
TERMS, LETTERS = 100_000, 4_000_000


def banned_terms(df: DataFrame, terms: DataFrame, key: str, text: str = "text", few: int = TERMS) -> DataFrame:
    """(key, terms): the trimmed, non-empty terms that a text contains, sorted and comma-joined; texts without any do not occur.

    Terms are counted first. Up to few of them, with LETTERS characters, go to all tasks, where an automaton of all terms
    reads each text once. More terms meet the texts by their first three characters, which a text that holds a term has as
    well; shorter ones of them by all they have.
    """
    wanted = terms.select(F.lower(F.trim("term")).alias("term")).filter("term <> ''").distinct()
    shown = df.select(key, F.lower(text).alias("_t"))
    measured = wanted.agg(F.count("*"), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    if measured[0] <= few and measured[1] <= LETTERS:
        listed = df.sparkSession.sparkContext.broadcast([r.term for r in wanted.collect()])

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for term in listed.value:
                automaton.add_word(term, term)
            automaton.make_automaton()
            for batch in batches:
                found = [",".join(sorted({t for _, t in automaton.iter(x)})) if x and len(automaton) else "" for x in batch["_t"].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch[key], pa.array(found, pa.string())], [key, "terms"])

        return shown.mapInArrow(read, f"{key} {df.schema[key].dataType.simpleString()}, terms string").filter("terms <> ''")
    heads = [F.expr(f"if(char_length(_t) >= {n}, transform(sequence(1, char_length(_t) - {n - 1}), i -> substr(_t, i, {n})), array())") for n in (1, 2, 3)]
    grams = shown.select(key, "_t", F.explode(F.array_distinct(F.concat(*heads))).alias("_g"))
    met = grams.join(wanted.withColumn("_g", F.substring("term", 1, 3)), "_g").filter(F.contains(F.col("_t"), F.col("term")))
    return met.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("term")), ",").alias("terms"))


def uncited(df: DataFrame, exempt: list[str], section: str = "section", cites: str = "evidence_ids") -> DataFrame:
    """Rows outside exempt sections without a citation."""
    return df.filter(~F.col(section).isin(*exempt) & (F.size(F.coalesce(cites, F.array().cast("array<string>"))) == 0))


def promo_or_hype(df: DataFrame, key: str, calls: str, hype: list[str], text: str = "text") -> DataFrame:
    """(key, promo, hype): a call to action matches, and how many hype markers occur."""
    return df.select(key, F.col(text).rlike(calls).alias("promo"), T.cue_score(F.col(text), hype).alias("hype"))


def viewer_calls(df: DataFrame, key: str, project: str, text: str = "text") -> DataFrame:
    """(key, project, calls, markers, hype, project_hype, project_markers): calls of a passage by the fixed patterns, phrases of
    calls and of hype that it holds, and how many different ones its project's passages hold together."""
    low = F.lower(F.coalesce(text, F.lit("")))
    holds = lambda words: F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    rows = df.select(key, project, T.has_call(F.coalesce(text, F.lit(""))).alias("calls"), holds(L.CALL_MARKERS).alias("_m"), holds(L.HYPE_MARKERS).alias("_h"))
    together = rows.select(project, F.explode(F.concat(F.transform("_m", lambda w: F.struct(F.lit("m").alias("k"), w.alias("w"))), F.transform("_h", lambda w: F.struct(F.lit("h").alias("k"), w.alias("w"))))).alias("_x")).distinct()
    counted = together.groupBy(F.col(project).alias("_p")).agg(F.count_if(F.col("_x.k") == "h").alias("project_hype"), F.count_if(F.col("_x.k") == "m").alias("project_markers"))
    told = rows.join(counted, F.col(project).eqNullSafe(F.col("_p")), "left")
    return told.select(key, project, "calls", F.size("_m").alias("markers"), F.size("_h").alias("hype"), F.coalesce("project_hype", F.lit(0)).alias("project_hype"), F.coalesce("project_markers", F.lit(0)).alias("project_markers"))


def draft_metadata(df: DataFrame, project: str, order: str, text: str, credit: str, title: int = 60, lead: int = 280, most: int = 15) -> DataFrame:
    """One row for each project: capped title and lead of its first text, sorted distinct credits, the first distinct tags."""
    first = F.min_by(text, order)
    words = F.slice(F.array_distinct(F.regexp_extract_all(F.lower(first), F.lit("[a-z]{4,}"), F.lit(0))), 1, most)
    return df.groupBy(project).agg(F.substring(F.trim(F.regexp_replace(first, r"\s+", " ")), 1, title).alias("title"), F.substring(first, 1, lead).alias("lead"), F.array_join(F.array_sort(F.collect_set(credit)), "; ").alias("credits"), F.array_join(words, ",").alias("tags"))


def weak_alignment(df: DataFrame, project: str, score: str, signature: str, least: float = 0.15) -> DataFrame:
    """(project, audited, weak, unsigned): rows with a score under least, and rows without a signature."""
    return df.groupBy(project).agg(F.count("*").alias("audited"), F.count_if(F.col(score) < least).alias("weak"), F.count_if(F.coalesce(F.col(signature), F.lit("")) == "").alias("unsigned"))
