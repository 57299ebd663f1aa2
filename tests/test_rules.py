"""Rules of texts, sequences and grids on rows worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from proofline.functions import text as T
from proofline.operators import chunks as C
from proofline.operators import framing as M
from proofline.operators import geometry as G
from proofline.operators import integrity as I
from proofline.operators import records as R
from proofline.operators import sequences as S
from proofline.operators import texts as O


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


def test_sentences_join_wrapped_lines(spark):
    wrapped = "The hunter walked into\nthe old gate. He saw\r\n nothing there!\n\n \nShort one.\n\nA second paragraph"
    assert one(spark, T.sentences, wrapped, "", None) == [["The hunter walked into the old gate.", "He saw nothing there!", "A second paragraph"], [], None]


def test_words(spark):
    assert one(spark, T.narration_word_count, "don’t stop", "don't 'quoted' x", "a--b", "") == [2, 3, 2, 0]
    rows = spark.createDataFrame([(1, "slow", "one - two"), (2, "slow", ""), (3, "odd", "one")], "k int, style string, text string")
    styles = spark.createDataFrame([("slow", 2.0)], "style string, per_second double")
    assert sorted((r.k, r.words, r.seconds) for r in O.estimate_duration(rows, styles).collect()) == [(1, 3, 1.5), (2, 0, 0.0), (3, 1, None)]


def test_source_family(spark):
    paths = {
        "a/chapter12.png": "a/chapter12", "a/ch_p12.png": "a/ch", "ch-07.jpg": "ch", "x/001__002.jpg": "x/001__002", "x/001__002_p03.jpg": "x/001__002", "_12.png": "_12",
        "\\b\\c_1.png": "b/c", "": "unknown", "./a//page_P9": "a/page", "a_b_.png": "a_b",
    }
    assert one(spark, T.source_family, *paths, None) == [*paths.values(), "unknown"]


def test_compress_clause(spark):
    clause = lambda c: T.compress_clause(c, ["ketika", "namun"], ["padahal", "meski"], ["yang", "itu", "di"], (["the", "and", "was"], ["yang", "dan", "itu"]), 4)
    said = {
        "Namun, pemburu yang lemah itu bangkit, meski terluka.": "Pemburu lemah bangkit", "The hunter was very weak and slow.": "The hunter was very....".replace("....", "."),
        "Itu dia!": "Itu dia", "": "", "yang": "Yang", "satu dua tiga empat lima": "Satu dua tiga empat",
    }
    assert one(spark, clause, *said) == list(said.values())


def test_entities(spark):
    rows = [(1, 2, "Then Sung saw the Gate again. Everyone knew Sung by name."), (1, 1, "Sung and O'Neil went to the gate. Later O'Neil left."), (2, 1, "THE end of it all here. The end of it all there.")]
    got = O.entity_mentions(spark.createDataFrame(rows, "p int, s int, text string"), "p", "s", ["The"], ["lead"]).collect()
    assert sorted((r.p, r.name, r.mentions, r.first_source, r.place, r.role) for r in got) == [(1, "O'Neil", 2, 1, 2, "extra"), (1, "Sung", 3, 1, 1, "lead")]


def test_weighted_word_times(spark):
    rows = [(1, 0, i, w, 10.0) for i, w in enumerate(["ab,", "cde.", "f"])] + [(1, 1, 0, "none", 0.0)]
    df = spark.createDataFrame(rows, "project_id int, seg int, pos int, word string, seconds double")
    got = [(r.start_s, r.end_s) for r in S.weighted_word_times(df, offset=1.0).orderBy("pos").collect()]
    total = 4.5 + 6.5 + 2.0
    assert got == [(1.0, round(1 + 45 / total, 3)), (round(1 + 45 / total, 3), round(1 + 110 / total, 3)), (round(1 + 110 / total, 3), 11.0)]


def test_repetition_audit(spark):
    rows = [("a", 0.5, 0.5, "static"), ("a", 0.55, 0.5, "static"), ("a", 0.5, 0.7, "reveal"), ("b", 0.5, 0.5, "reveal"), ("b", 0.1, 0.5, "static"), ("c", 0.5, 0.5, "reveal")]
    df = spark.createDataFrame([(1, k, *r, 3.0 if k == 4 else 1.0) for k, r in enumerate(rows)], "project_id int, pos int, a string, x double, y double, c string, dur double")
    r = S.repetition_audit(df, "a", "x", "y", "c").collect()[0]
    assert (r.same_frames, r.still_frames, r.same_curves, r.same_assets, r.long_holds, r.moving_share) == (1, 1, 1, 1, 1, 0.5)
    assert r.codes == "ASSET_COOLDOWN,LONG_HOLD,REPEATED_CURVE,REPEATED_FRAME,REPEATED_STILL"


def dealt(weights, caps, target):
    """Shares of target, one unit after the other."""
    if sum(caps) < target or len(weights) > target:
        return [None] * len(weights)
    exact = [(target - len(weights)) * w / sum(weights) for w in weights]
    shares = [min(c, 1 + math.floor(e)) for c, e in zip(caps, exact)]
    order = sorted(range(len(weights)), key=lambda i: (-round(exact[i] - math.floor(exact[i]), 9), i))
    while sum(shares) < target:
        for i in order:
            if sum(shares) < target and shares[i] < caps[i]:
                shares[i] += 1
    return shares


def test_apportion_with_caps(spark):
    cases = {1: ([5.0, 3.0, 2.0], [9, 9, 9], 12), 2: ([50.0, 1.0, 1.0], [4, 9, 9], 12), 3: ([1.0, 1.0], [2, 3], 12), 4: ([1.0] * 13, [9] * 13, 12), 5: ([7.0, 7.0, 7.0, 1.0], [3, 3, 3, 12], 12)}
    rows = [(p, k, w, c) for p, (ws, cs, _) in cases.items() for k, (w, c) in enumerate(zip(ws, cs))]
    got = S.apportion(spark.createDataFrame(rows, "project_id int, k int, w double, cap int"), 12, "w", "k", cap="cap").orderBy("project_id", "k").collect()
    for p, case in cases.items():
        assert [r.share for r in got if r.project_id == p] == dealt(*case), p


def test_removable_keeps_the_last(spark):
    rows = [(1, k, c) for k, c in enumerate([3, 1, 2, 1, 4, 0])] + [(2, k, 0) for k in range(4)]
    got = S.removable(spark.createDataFrame(rows, "p int, k int, c int"), "p", 4, ["k"], ["c", "k"]).collect()
    assert sorted((r.p, r.k) for r in got) == [(1, 1), (1, 3)]


def test_sample_curve(spark):
    rows = [(1, 0, "slow_push_in"), (1, 1, "static"), (1, 2, "orbit"), (1, 3, "unheard"), (1, 4, "reveal"), (1, 5, "pan_diagonal"), (1, 6, "slow_pull_out"), (1, 7, None)]
    df = spark.createDataFrame([(*r, -1.0, 0.5, 0.65, 2.0) for r in rows], "project_id int, pos int, curve string, x0 double, y0 double, x1 double, y1 double")
    got = {(r.pos, r.frame): (r.x, r.y, r.scale) for r in S.sample_curve(df, 3).collect()}
    assert got[0, 1] == (0.35, 0.725, 1.03) and got[0, 2] == (0.65, 0.95, 1.06)
    assert got[1, 2] == (0.05, 0.5, 1.0) == got[3, 2] == got[7, 1] and got[2, 1] == (0.05, 0.5, 1.02)
    assert got[4, 2][2] == 1.08 and got[5, 2] == (0.65, 0.95, 1.04) and [got[6, k][2] for k in range(3)] == [1.06, 1.03, 1.0]
    with pytest.raises(ValueError):
        S.sample_curve(df, 1)


def test_stable_choice_avoids_history(spark):
    import hashlib

    options = ["a", "b", "c"]
    rows = [(1, k, f"t{k}", past) for k, past in enumerate([[], ["a"], ["a", "b"], ["a", "b", "c"], None])]
    got = [r.choice for r in S.stable_choice(spark.createDataFrame(rows, "project_id int, pos int, t string, past array<string>"), "42", "t", options, "past").orderBy("pos").collect()]
    for (_, k, t, past), choice in zip(rows, got):
        first = int.from_bytes(hashlib.sha256(f"42:{k}:{t}".encode()).digest()[:4], "big")
        turned = [options[(first + i) % 3] for i in range(3)]
        assert choice == next((o for o in turned if o not in (past or [])), turned[0])


def test_gutters_and_cuts(spark):
    stats = [(1, 0, 240.0, 0.0), (1, 1, 10.0, 40.0), (1, 2, 220.0, 0.0), (1, 3, 128.0, 0.0), (1, 4, 40.0, 120.0)]
    rows = G.gutter_score(spark.createDataFrame(stats, "asset_id int, y int, mean double, variance double"))
    assert [r.score for r in rows.orderBy("y").collect()] == [1.0, 0.5, 0.55, 0.15, 0.1375]
    got = {r.ideal: (r.y, r.score, r.hit) for r in G.best_cut(rows, [1, 3, 9], 2, 1, 5).collect()}
    assert got == {1: (2, 0.55, True), 3: (2, 0.55, True), 9: (9, None, False)}


def test_low_information_and_border(spark):
    flat = [128] * 64
    noisy = [(37 * i * i) % 256 for i in range(64)]
    ringed = [255 if 2 <= i % 8 <= 5 and 2 <= i // 8 <= 5 and (i + i // 8) % 2 else 128 for i in range(64)]
    df = spark.createDataFrame([(1, flat), (2, noisy), (3, ringed)], "asset_id int, px array<int>")
    low = {r.asset_id: r.low for r in G.low_information(df, "px", 8, 8).collect()}

    def cell(px, x, y):
        at = lambda dx, dy: px[max(0, min(7, y + dy)) * 8 + max(0, min(7, x + dx))]
        near = [at(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        mean, sides = sum(near) / 9, [(-1, 0), (1, 0), (0, -1), (0, 1)]
        shares = [sum(min(7, v // 32) == b for v in near) / 9 for b in range(8)]
        measures = (sum((v - mean) ** 2 for v in near) / (255**2 / 4), -sum(p * math.log2(p) for p in shares if p) / 3, sum(abs(at(*s) - at(0, 0)) >= 12 for s in sides) / 4, sum(abs(at(4 * a, 4 * b) - at(a, b)) for a, b in sides) / 1020)
        return sum(m <= limit for m, limit in zip(measures, G.LOW_LIMITS)) >= 3

    for i, px in ((1, flat), (2, noisy), (3, ringed)):
        assert low[i] == [cell(px, k % 8, k // 8) for k in range(64)]
    assert all(low[1]) and not all(low[2]) and True in low[3] and False in low[3]
    island = [(0 < k % 8 < 7 and 0 < k // 8 < 7) and k in (27, 28) or k < 8 or k == 9 for k in range(64)]
    got = M.border_reach(spark.createDataFrame([(1, island), (2, [False] * 64), (3, [True] * 64)], "asset_id int, low array<boolean>"), 8, 8).collect()
    assert sorted((r.asset_id, r.reached, r.share) for r in got) == [(1, 9, round(9 / 64, 6)), (2, 0, 0.0), (3, 64, 1.0)]


@pytest.mark.parametrize("block,fan", [(4096, 256), (7, 2)])
def test_chunks_by_bytes_overlap(spark, block, fan, monkeypatch):
    """Against a loop over each project's rows, with rows larger than a chunk, a null project, and rows of one order."""
    import random

    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "FAN", fan)
    rng = random.Random(4)
    rows = [(p, o, rng.choice([0, 1, 5, 9, 30, None])) for p in (None, 1, 2, 3) for o in range(rng.randint(1, 60))] + [(5, o, 1) for o in range(150)] + [(6, 0, 0)]
    df = spark.createDataFrame(rows, "p int, o int, s int").repartition(5)
    for most, most_bytes, overlap in ((5, 20, 2), (3, 10, 0), (4, 100, 3), (1, 5, 0)):
        expected = []
        for p in sorted({r[0] for r in rows}, key=str):
            sizes, start, chunk = [s or 0 for q, _, s in rows if q == p], 0, 0
            while start < len(sizes):
                end = start + 1
                while end < len(sizes) and end - start < most and sum(sizes[start : end + 1]) <= most_bytes:
                    end += 1
                expected += [(p, o, chunk) for o in range(start, end)]
                start, chunk = (len(sizes), chunk) if end == len(sizes) else (max(end - overlap, start + 1), chunk + 1)
        got = C.byte_bounded_chunks(df, "p", "o", "s", most, most_bytes, overlap)
        assert sorted(((r.p, r.o, r.chunk) for r in got.collect()), key=str) == sorted(expected, key=str)
    with pytest.raises(ValueError):
        C.byte_bounded_chunks(df, "p", "o", "s", 2, 5, 2)


def test_rows_of_one_order_and_of_no_project_stay(spark):
    rows = [(None, 1, 3, "a"), (None, 2, 3, "b"), (1, 1, 3, "c"), (1, 1, 3, "d"), (1, 1, 3, "d"), (1, None, 3, "e")]
    df = spark.createDataFrame(rows, "p int, o int, s int, name string")
    got = sorted(((r.p, r.name, r.chunk) for r in C.byte_bounded_chunks(df, "p", "o", "s", 2, 100).collect()), key=str)
    assert sorted(((p, n) for p, n, _ in got), key=str) == sorted(((p, n) for p, _, _, n in rows), key=str)
    assert {(p, c): sum((q, d) == (p, c) for q, _, d in got) for p, _, c in got} == {(None, 0): 2, (1, 0): 2, (1, 1): 2}
    assert (1, "e", 0) in got and C.byte_bounded_chunks(df.filter("p = 99"), "p", "o", "s", 2, 100).count() == 0
    nulls = S.overlapping_chunks(df.filter("p is null"), 1, 0, "p", "o")
    assert sorted((r.name, r.chunk) for r in nulls.collect()) == [("a", 0), ("b", 1)]
    names = spark.createDataFrame([("p", x, float(i)) for i, x in enumerate(["b", "a", "c", "d"])], "p string, o string, score double")
    assert sorted((r.o, r.bucket) for r in S.bucket_best(names, 2, "score", "o", "p", "o").collect()) == [("a", 0), ("d", 1)]


def test_a_hot_project_is_packed_by_many_tasks(spark):
    df = spark.range(20_000).selectExpr("if(id % 3 > 0, 0, id % 12) as p", "id as o", "id % 17 as s")
    assert C.byte_bounded_chunks(df, "p", "o", "s", 10, 60).count() == 20_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    placed = S.placed(df, "p", "o").withColumn("task", F.shiftright("_id", 33))
    spread = placed.filter("p = 0").agg(F.count_distinct("task"), F.max("_r"), F.count_distinct("_r"), F.max("_n")).first()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spread[0] > 1 and spread[1] == spread[2] - 1 == spread[3] - 1


def test_claims_and_contracts(spark):
    claims = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", "z")], "claim string, e string")
    passages = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z"), ("d", "z")], "claim string, e string")
    got = {r.claim: (r.required, r.covered, r.ratio, r.code) for r in I.claim_coverage(claims, passages, "claim", "e").collect()}
    assert got == {"a": (2, 1, 0.5, "INCOMPLETE"), "b": (1, 0, 0.0, "NO_OVERLAP"), "c": (1, 1, 1.0, "OK"), "d": (0, 0, None, "UNKNOWN_CLAIM")}
    text = " ".join(f"w{k}" for k in range(120))
    rows = [(1, text, 120, 54.55), (2, text, 119, 54.55), (3, text, 120, 54.0), (4, text + " said the old man", 124, 56.36), (5, "", 0, 0.0), (6, text, None, None)]
    protected = spark.createDataFrame([("and so said the old man",)], "text string")
    got = {r.k: r.codes for r in O.narration_contract(spark.createDataFrame(rows, "k int, text string, n int, s double"), protected, "k", "n", "s", 2.2).collect()}
    assert got == {1: "", 2: "WORDS", 3: "DURATION", 4: "COPIED", 5: "DURATION,WORDS", 6: "DURATION,WORDS"}


def test_boxes_and_manifests(spark):
    df = spark.createDataFrame([(1, [0.1, 0.1, 0.5, 0.5], [0.1, 0.1, 0.5, 0.1, 0.5, 0.5]), (2, None, [0.2, 0.9, 0.4, 0.3]), (3, [0.0, 0.0, 1.0, 1.0], [0.1, 0.2, 0.3, 0.4]), (4, None, [])], "k int, b array<double>, p array<double>")
    got = sorted((r.k, r.x0, r.y0, r.x1, r.y1) for r in G.region_envelope(df, "k", "p", "b").collect())
    assert got == [(1, 0.1, 0.1, 0.5, 0.5), (2, 0.2, 0.3, 0.4, 0.9), (3, 0.0, 0.0, 1.0, 1.0), (3, 0.1, 0.2, 0.3, 0.4)]
    assert sorted((r.k, r.code) for r in G.validate_geometry(df, "k", "b", "p").collect()) == [(2, "POLYGON"), (3, "POLYGON"), (4, "POLYGON")]
    files = [("f", "a", b"1"), ("f", "b", b"2"), ("g", "a", b"1")]
    first = {(r.d, r.n): r.manifest for r in I.file_manifest(spark.createDataFrame(files, "d string, n string, c binary"), "d", "n", "c").collect()}
    again = {(r.d, r.n): r.manifest for r in I.file_manifest(spark.createDataFrame([*files[::-1], ("g", "b", b"2")], "d string, n string, c binary"), "d", "n", "c").collect()}
    assert first["f", "a"] == first["f", "b"] == again["f", "a"] == again["g", "a"] != first["g", "a"]
    expected = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (3, 0, "c")], "p int, o int, i string")
    actual = spark.createDataFrame([(1, 0, "a"), (1, 2, "b"), (2, 0, "b"), (2, 1, "a"), (9, 0, "z")], "p int, o int, i string")
    from proofline.operators import records as R

    told = {r.p: (r.count_equal, r.order_equal, r.ratio, r.unresolved) for r in R.validate_manifest(actual, expected, "p", "o", "i").collect()}
    assert told == {1: (True, True, 1.0, 0), 2: (False, False, 0.0, 1), 3: (False, False, 0.0, 1)}


def test_dark_cells_are_blank(spark):
    df = spark.createDataFrame([(1, [5] * 64), (2, [128 if k % 8 == 0 else 250 for k in range(64)])], "asset_id int, px array<int>")
    assert sorted((r.asset_id, r.blank, r.rejected) for r in M.blank_reject(df, "px", 8, 8).collect()) == [(1, 1.0, True), (2, 0.875, False)]


def script(spark, *sections):
    rows = [("p", i, *row) for i, row in enumerate(sections)]
    df = spark.createDataFrame(rows, "p string, i int, section string, text string, cites array<string>")
    return {r.code: r.n for r in O.script_checks(df, "p", "i", "section", "cites", ["because"], 2.0, 20.0).collect()}


GOOD = [
    ("hook", "Nobody expected the quiet gate to open.", []), ("setup", "An old hunter guards it every night.", ["a1"]), ("conflict", "Strange lights gather beyond those walls.", None),
    ("twist", "He stays because his brother went inside.", []), ("cta", "Would you guard this gate too?", None),
]


def test_script_without_a_fault(spark):
    assert script(spark, *GOOD) == {}
    assert script(spark) == {}


@pytest.mark.parametrize(
    "at, row, expected",
    [
        (0, ("hook", "an old hunter guards it every NIGHT.", []), {"HOOK_REPEATS_SETUP": 1, "REPEATED_SENTENCE": 1, "REPETITION": 1, "REPEATED_PHRASE": 5, "CTA_CONTEXT_MISSING": 1}),
        (1, ("setup", None, ["a1"]), {"EMPTY_SECTION": 1, "MISSING_SECTION": 1}),
        (1, ("setup", "An old hunter guards it. Every night.", None), {"SENTENCE_FRAGMENT": 1, "EVIDENCE_MISSING": 1}),
        (3, ("twist", "He stays there for his own brother.", []), {"INSIGHT_MISSING": 1}),
        (3, ("twist", "Would you because", []), {"REPEATED_PHRASE": None}),
        (4, ("cta", "Subscribe now, friends!", None), {"CTA_CONTEXT_MISSING": 1}),
        (4, ("cta", "Keep watch over that gate with all " + " ".join(f"friend{i}" for i in range(20)), None), {"TOO_LONG": 1}),
        (4, ("outro", "Would you guard this gate too?", None), {"MISSING_SECTION": 1, "CTA_CONTEXT_MISSING": 1}),
    ],
)
def test_script_faults(spark, at, row, expected):
    got = script(spark, *(row if i == at else s for i, s in enumerate(GOOD)))
    assert got == {k: v for k, v in expected.items() if v}


def test_script_runs_cross_sections_and_short_scripts_do_not_count(spark):
    assert script(spark, ("hook", "one two", []), ("hook", "three", []), ("hook", "", []), ("hook", "one two three", []))["TOO_SHORT"] == 1
    assert "REPEATED_PHRASE" not in script(spark, ("hook", "one two three one two three", []))
    again = script(spark, ("hook", "one two", []), ("hook", "three", []), ("hook", "", []), ("hook", "one two three four five six seven eight nine", []))
    assert again["REPEATED_PHRASE"] == 1 and again["EMPTY_SECTION"] == 1


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_source_order_and_evidence(spark):
    rows = spark.createDataFrame([(1, 1, 5), (1, 2, 3), (1, 3, 3), (1, 4, None), (2, 1, 1), (2, 2, 2)], "p int, seq int, ord int")
    assert got(I.source_order_findings("PANEL", rows, "p", "seq", "ord"), "project_id", "code", "subject_id") == [
        (1, "DUPLICATE_ORDER_PANEL", "3"), (1, "MISSING_ORDER_PANEL", "4"), (1, "OUT_OF_ORDER_PANEL", "2"),
    ]
    claims = spark.createDataFrame([(1, "a", ["x", "y"]), (1, "b", []), (1, "c", None), (1, "d", ["x"])], "p int, k string, refs array<string>")
    panels = spark.createDataFrame([("x",)], "id string")
    assert got(I.evidence_findings("CLAIM", claims, "p", "k", "refs", panels, "id"), "code", "subject_id", "detail") == [
        ("NO_EVIDENCE_CLAIM", "b", ""), ("NO_EVIDENCE_CLAIM", "c", ""), ("UNKNOWN_EVIDENCE_CLAIM", "a", "y"),
    ]


@pytest.mark.parametrize(
    ("old", "new", "path"),
    [
        ('{"b": 1, "a": {"x": [1, 2]}}', '{"a": {"x": [1, 3]}, "b": 2}', "a.x.1"), ('{"a": [1]}', '{"a": [1, 2]}', "a"), ('{"a": null}', "{}", "a"), ('{"a": 1}', '{"a": {"b": 1}}', "a"),
        ('{"a": 1, "b": 2}', '{"b": 2, "a": 1}', None), ("no json", "{}", ""), (None, "{}", ""), (None, None, None),
    ],
)
def test_record_diff(spark, old, new, path):
    frame = lambda v: spark.createDataFrame([(1, v)], "k int, v string")
    assert got(I.record_diff(frame(old), frame(new), "k", "v"), "path") == ([] if path is None else [(path,)])


def test_snapshots_and_measured_limits(spark):
    snap = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, None)], "k int, f string")
    now = spark.createDataFrame([(1, "a"), (2, "x"), (3, "c"), (5, None)], "k int, f string")
    attempts = spark.createDataFrame([(1, True), (1, False), (2, True), (5, True), (5, True)], "k int, accepted boolean")
    assert got(I.snapshot_parity(snap, now, "k", ["f"], attempts), "k", "code") == [(1, "OK"), (2, "F"), (3, "NO_ACCEPTED"), (4, "MISSING"), (5, "MANY_ACCEPTED")]
    shares = spark.createDataFrame([("a", 1, 0.01), ("a", 2, 0.03), ("b", 1, 0.04), ("c", 1, None), ("c", 2, 0.5), ("d", 1, -0.1)], "p string, o int, v double")
    assert got(I.measured_limits(shares, "p", "o", "v", 0.03), "p", "o", "v", "largest", "n", "code") == [
        ("a", 1, 0.01, 0.03, 2, "OK"), ("a", 2, 0.03, 0.03, 2, "OK"), ("b", 1, 0.04, 0.04, 1, "OUT_OF_RANGE"), ("c", 1, None, 0.5, 1, "MISSING"), ("c", 2, 0.5, 0.5, 1, "MISSING"), ("d", 1, -0.1, -0.1, 1, "OUT_OF_RANGE"),
    ]


def test_score_candidates(spark):
    spans = spark.createDataFrame([(1, 0, ["weapon"], None), (1, 1, ["weapon"], 4), (1, 2, None, 4)], "p int, s int, tags array<string>, previous int")
    candidates = spark.createDataFrame([(1, 10, 1.0, 2, 0.4), (1, 11, 1.0, 6, 0.0)], "p int, c int, quality double, position int, arms double")
    found = got(R.score_candidates(spans, candidates, "p", "s", "c", {"weapon": "2.5 * arms"}, 2), "s", "c", "score", "place")
    # 1 + 2.5 * 0.4 + 0.35; from 4 back to 2: 0.35 * (1 - 2 / 6) - 2 * 0.25; from 4 on to 6: 0.35 * 4 / 6 + 2 * 0.03
    assert found == [(0, 10, 2.35, 1), (0, 11, 1.35, 2), (1, 10, 1.733333, 1), (1, 11, 1.293333, 2), (2, 10, 0.733333, 2), (2, 11, 1.293333, 1)]


def test_validate_continuity(spark):
    chunks = spark.createDataFrame([(1, 0, "a", [1, 2]), (1, 1, "b", [2, 3, 3]), (1, 2, "b", [9])], "p int, pos int, c string, ids array<int>")
    expected = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4)], "p int, id int")
    links = spark.createDataFrame([(1, 1, 7)], "p int, x int, y int")
    assert got(R.validate_continuity(chunks, "p", "pos", "c", "ids", expected, "id", links, ("x", "y")), "subject", "code") == [
        ("4", "UNCOVERED"), ("7", "UNKNOWN_LINK"), ("9", "UNKNOWN_ID"), ("b", "DUPLICATE_CHUNK"), ("b", "NO_OVERLAP"), ("b", "REPEATED_ID"),
    ]


def test_validate_passages(spark):
    roles = [("hook", 2, 4), ("end", 2, 4)]
    rows = [(1, 0, "hook", "He ran away."), (1, 1, "end", "Who was it?"), (2, 0, "end", "One two three. Go!"), (2, 1, "end", "One, two three"), (2, 2, "end", "Go. no"), (3, 0, "hook", None)]
    frame = spark.createDataFrame(rows, "p int, o int, role string, text string")
    assert got(R.validate_passages(frame, "p", "o", "role", "text", roles, (5, 8)), "p", "o", "code") == [
        (2, 0, "ROLE"), (2, 1, "OPENING"), (2, 1, "SENTENCE"), (2, 2, "COUNT"), (2, 2, "ENDING"), (2, 2, "ROLE"), (2, 2, "SENTENCE"), (2, 2, "TOTAL"), (2, 2, "WORDS"),
        (3, 0, "COUNT"), (3, 0, "ENDING"), (3, 0, "TOTAL"), (3, 0, "WORDS"),
    ]


def test_validate_groups(spark):
    groups = spark.createDataFrame([(1, 0, 0.0, 1.0, True), (1, 1, 0.9, 2.0, True), (1, 2, 2.0, 9.0, False), (1, 3, 9.0, 9.0, True)], "project_id int, sentence int, start_s double, end_s double, closed boolean")
    words = [(1, 0, "HE", 0.0, 0.5), (1, 0, "RAN", 0.5, 1.0), (1, 1, "NO", 0.8, 1.5), (1, 1, "NO", 1.5, 2.0), (1, 2, "A-B", 2.0, 3.0), (1, 2, "C", 3.0, 9.0)]
    shown = spark.createDataFrame(words, "project_id int, sentence int, display string, start_s double, end_s double")
    assert got(S.validate_groups(groups, shown, 8.0, "[A-Z0-9]+", 2), "sentence", "code") == [
        (1, "OVERLAP"), (1, "WORD_OUTSIDE"), (2, "CHARSET"), (2, "OUT_OF_BOUNDS"), (2, "UNCLOSED"), (3, "FEW_WORDS"), (3, "OUT_OF_BOUNDS"), (3, "OVERLAP"),
    ]


def test_cadence_bands(spark):
    shots = spark.createDataFrame([("a", 1, 1.0, "none"), ("a", 2, 1.2, "cut"), ("a", 3, 2.0, "cut"), ("b", 1, 1.0, "cut"), ("b", 2, 9.0, "fade")], "project_id string, pos int, dur double, transition string")
    names = "duration_min duration_max shot_min shot_max normal_min normal_max normal_ratio_min normal_ratio_max emphasis_min emphasis_max emphasis_ratio_min emphasis_ratio_max mean_min mean_max hard_cut_min".split()
    profile = spark.createDataFrame([("p", 4.0, 5.0, 3, 3, 0.5, 1.5, 0.6, 0.7, 1.6, 2.5, 0.3, 0.4, 1.3, 1.5, 0.85)], "profile_id string, " + ", ".join(f"{n} {'int' if n[:4] == 'shot' else 'double'}" for n in names))
    found = got(S.cadence_bands(shots, profile), "project_id", "normal_share", "emphasis_share", "hard_cut_share", "codes")
    assert found == [("a", 0.666667, 0.333333, 1.0, ""), ("b", 0.5, 0.0, 0.0, "FEW_EMPHASIS,FEW_HARD_CUTS,FEW_NORMAL,FEW_SHOTS,LONG,MEAN,OUT_OF_BAND")]


@pytest.mark.parametrize("n", [0, 1, 700])
def test_placed_matches_a_window(spark, n):
    rows = spark.range(n).selectExpr("if(id % 3 > 0, 'hot', concat('p', id % 5)) as p", "if(id % 50 = 7, null, id * 7 % 1009) as o")
    found = S.placed(rows, "p", "o", 8)
    assert got(found, "p", "o", "_r", "_n") == got(rows.selectExpr("*", "row_number() over (partition by p order by o) - 1 as _r", "count(*) over (partition by p) as _n"), "p", "o", "_r", "_n")


def test_chunks_tell_repeated_ids(spark):
    rows = spark.createDataFrame([("s", 0, "a"), ("s", 1, "b"), ("s", 2, "a"), ("t", 0, "b"), ("t", 1, None)], "p string, o int, id string")
    assert got(S.overlapping_chunks(rows, 2, 1, "p", "o", "id"), "p", "o", "chunk", "repeated") == [("s", 0, 0, True), ("s", 1, 0, False), ("s", 1, 1, False), ("s", 2, 1, True), ("t", 0, 0, False), ("t", 1, 0, False)]


def test_separator_candidates(spark):
    means = [10.0] * 4 + [250.0] * 3 + [10.0] * 4
    busy = lambda y: not 4 <= y < 7
    rows = [("a", y, m, 500.0 if busy(y) else 0.0, 35.0 if busy(y) else 0.0) for y, m in enumerate(means)]
    found = G.separator_candidates(spark.createDataFrame(rows, "asset_id string, y int, mean double, variance double, texture double"), 3)
    # edge 480 / 180, cut to 1; context 0.55 + 35 / 35, cut to 1; band 3 / 6
    assert got(found, "position", "confidence", "edge_score", "context_score", "y0", "y1") == [(5, 0.95, 1.0, 1.0, 4, 7)]


def test_crop_shares_and_overrides(spark):
    box = "asset_id int, {} string, x0 int, y0 int, x1 int, y1 int"
    crops = spark.createDataFrame([(1, "c", 0, 0, 10, 10), (2, "c", 0, 0, 10, 10)], box.format("crop"))
    regions = spark.createDataFrame([(1, "face", 5, 0, 15, 10), (1, "text", 0, 0, 5, 4), (1, "sign", 3, 3, 3, 3)], box.format("kind"))
    blocked = spark.createDataFrame([(1, "b", 0, 0, 5, 10), (1, "b", 0, 0, 5, 20)], box.format("kind"))
    found = got(G.crop_coverage(crops, regions, ["face", "text", "sign", "none"], blocked), "asset_id", "face", "text", "sign", "none", "retained", "blocked")
    assert found == [(1, 0.5, 1.0, 0.0, 1.0, 0.583333, 1.0), (2, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0)]
    assets = spark.createDataFrame([(1, 10, [3, 6], "me", "seam", "h"), (2, 10, [6, 3], "me", "seam", "h"), (3, 10, [10], "me", "seam", "h"), (4, 10, [5], " ", "seam", "h"), (5, 10, None, "me", "seam", None)], "asset_id int, height int, cuts array<bigint>, actor string, reason string, prior_hash string")
    assert got(G.override_cuts(assets, "height"), "asset_id", "y0", "y1", "code") == [(1, 0, 3, "OK"), (1, 3, 6, "OK"), (1, 6, 10, "OK"), (2, None, None, "COORDINATE_INVALID"), (3, None, None, "COORDINATE_INVALID"), (4, None, None, "AUDIT_INVALID"), (5, 0, 10, "OK")]


def test_style_warnings(spark):
    report = spark.createDataFrame([(1, 3, 0.0, 0, 0.0), (2, 3, 2.0, 1, 0.0), (3, 0, 0.0, 0, 0.0)], "k int, n_sentences int, length_variance double, repeated_sentences int, repeated_openings double")
    flagged = {"CTA": spark.createDataFrame([(2,), (2,), (9,)], "k int"), "HYPE": spark.createDataFrame([(1,)], "k int")}
    assert got(O.style_warnings(report, "k", flagged), "k", "codes") == [(1, "HYPE,RHYTHM"), (2, "CTA,TEMPLATE_RISK"), (3, "")]
    assert got(O.style_warnings(report, "k"), "k", "codes") == [(1, "RHYTHM"), (2, "TEMPLATE_RISK"), (3, "")]


def test_banned_terms_by_either_join(spark):
    docs = spark.createDataFrame([(1, "A Token of é"), (2, "to"), (3, ""), (4, None), (5, "tok tokens")], "k int, text string")
    terms = spark.createDataFrame([(" TOKEN ",), ("é",), ("to",), ("",), (None,), ("absent",)], "term string")
    few, many = (got(O.banned_terms(docs, terms, "k", few=n), "k", "terms") for n in (10, 1))
    assert few == many == [(1, "to,token,é"), (2, "to"), (5, "to,token")]
