"""Words of copy checks, and runs of words shared with protected text, by hand and against sets."""

import random
import re

from pyspark.sql import functions as F

from proofline.functions import text as T
from proofline.operators import texts as O


def test_words_of_copies_end_at_underscores_and_fold(spark):
    df = spark.createDataFrame([(1, "dark_river_ran_home"), (2, "DARK river, ran home!"), (3, "dark river ran"), (4, "Straße ΣΊΣΥΦΟΣ ıĲ K9"), (5, None), (6, "")], "k int, text string")
    words = {r.k: r.w for r in df.select("k", T.lexical_words(F.col("text")).alias("w")).collect()}
    assert words[1] == words[2] == ["dark", "river", "ran", "home"] and words[6] == [] and words[5] is None
    assert words[4] == re.findall(r"[^\W_]+", "Straße ΣΊΣΥΦΟΣ ıĲ K9".casefold())
    protected = spark.createDataFrame([("dark river ran home",), (None,)], "text string")
    assert {r.k: r.copied for r in O.copied_ngram_exists(df, protected, "k").collect()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False}
    assert {r.k for r in O.copied_ngram_exists(df, spark.createDataFrame([("STRASSE σίσυφοσ ıĳ k9",)], "text string"), "k").collect() if r.copied} == {4}


def test_shared_runs_are_those_of_sets(spark, monkeypatch):
    rng = random.Random(2)
    words = ["w%d" % i for i in range(12)]
    a = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(60)] + [(98, None), (99, "")]
    b = [(" ".join(rng.choices(words, k=30)),) for _ in range(8)] + [(None,), ("w1",)]
    runs = lambda t, n: {tuple((t or "").split()[i : i + n]) for i in range(len((t or "").split()) - n + 1)}
    mine, theirs = spark.createDataFrame(a, "k int, text string"), spark.createDataFrame(b, "text string")
    for n, sketch in ((2, (16, 26)), (3, (6, 6))):  # a full sketch lets all runs through, and words decide
        monkeypatch.setattr(O, "SKETCH", sketch)
        protected = set().union(*[runs(t, n) for (t,) in b])
        got = {r.k: (r.n_shingles, r.n_shared) for r in O.runs_within(mine, theirs, "k", n, T.tokens).collect()}
        assert got == {k: (len(runs(t, n)), len(runs(t, n) & protected)) for k, t in a}
    assert O.runs_within(mine, theirs.filter("false"), "k", 2, T.tokens).agg(F.sum("n_shared")).first()[0] == 0


def test_style_report_of_a_text(spark):
    text = "The dog ran home. The dog ran home! But it didn't stay, and then it left."
    row = O.style_report(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "?!")], "k int, text string"), "k", ["then", "dog"]).collect()
    assert len(row) == 1
    r = row[0].asDict()
    # sentences of 4, 4 and 8 words; "the dog ran home." and "the dog ran home!" differ, their openings do not
    assert (r["n_sentences"], r["n_words"], r["p10"], r["p50"], r["p90"]) == (3, 16, 4, 4, 8)
    assert r["length_variance"] == round(((4 - 16 / 3) ** 2 * 2 + (8 - 16 / 3) ** 2) / 3, 6)
    assert (r["repeated_openings"], r["n_connectors"], r["connected_share"], r["n_contractions"]) == (round(1 / 3, 6), 2, 1.0, 1)
