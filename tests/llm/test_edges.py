"""Every operator on empty tables, null ids and texts, repeated rows, very long texts and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from proofline.llm import automata, decontaminate, minhash, mixing, quality, recurrent, secrets, shards, suffixes, tokens

OPERATORS = {
    "mixing": mixing.mix, "tokens": tokens.token_counts, "suffixes": suffixes.without_repeated_passages, "automata": automata.without_copied_spans,
    "decontaminate": lambda d: decontaminate.judged(d, d.select(F.col("doc_id").alias("item_id"), "text").filter("doc_id = 5")), "secrets": secrets.secrets, "shards": shards.shard,
    "recurrent": recurrent.score, "minhash": minhash.near_duplicates, "quality": quality.quality,
}
CLASHES = "row g id bucket keys _t _s _k _n _h words hash n_words removed kept span shard slot size score copies rate component_id first".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark):
    passage = " ".join(f"word{i}" for i in range(70))
    rows = [(None, None), (None, None), (None, ""), (None, passage), (None, passage), (1, passage), (1, passage), (1, "another text " * 30), (2, None), (3, ""), (4, " \n "), (5, passage + " and the end"), (6, f"{passage} password = abcdefgh1 \n")]
    rows.append((7, " ".join(f"w{i % 9973}x{i % 7}" for i in range(150_000))))
    rows.append((8, "x" * 300_000))
    return spark.createDataFrame([(k, t, "en" if k else None, None if k == 3 else "s", None) for k, t in rows], SCHEMA)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    found = OPERATORS[name](spark.createDataFrame([], SCHEMA))
    assert found.count() == 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_clashing_columns(spark, name):
    docs = frame(spark)
    plain = OPERATORS[name](docs)
    clashing = OPERATORS[name](docs.withColumns({c: F.lit("clash") for c in CLASHES}))
    same = [c for c in plain.columns if c in ("doc_id", "n_words", "n_removed", "n_tokens", "n_known", "n_left", "n_shingles")]
    a, b = (sorted((tuple(r) for r in df.select(same).collect()), key=repr) for df in (plain, clashing))
    assert a == b
    if name != "mixing":
        assert sorted({r[same.index("doc_id")] for r in a}, key=repr) == sorted({r.doc_id for r in docs.collect()}, key=repr)
    if name in ("suffixes", "automata"):
        told = {(r.doc_id, r.n_words): r.n_removed for r in plain.collect()}
        assert told[(1, 70)] == 0 and told[(None, 70)] == 70 and told[(5, 73)] == 70 and told[(7, 150_000)] == 0 and told[(8, 1)] == 0
