"""Sets by digests, posting lists in blocks, areas of tiles, terms by an automaton, and output checks, by hand and by brute force."""

import random

from pyspark.sql import functions as F

from proofline.operators import geometry as G
from proofline.operators import integrity as I
from proofline.operators import records as R
from proofline.operators import texts as O


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_equal_sets_are_found_by_sums(spark):
    members = spark.createDataFrame([("a", x, 3) for x in "xyx"] + [("b", x, 1) for x in "yx"] + [("c", x, 0) for x in "xyz"] + [("d", "x", 0), ("e", None, 0), ("f", "yx", 0)], "p string, m string, o int")
    found = I.same_set_match(members, members.filter("p in ('a', 'c')"), "p", "m", "o")
    assert sorted(r.p for r in found.collect()) == ["b", "c"]  # a and b hold the same set; b comes earlier
    assert I.same_set_match(members, members.filter("p = 'e'"), "p", "m", "o").count() == 0


def test_sets_with_one_digest_are_compared(spark, monkeypatch):
    same = lambda members, parent, member: members.filter(F.col(member).isNotNull()).select(parent, member).distinct().groupBy(parent).agg(F.count("*").alias("_n")).withColumn("set_hash", F.lit("h"))
    monkeypatch.setattr(I, "_set_digests", same)
    members = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("b", "x", 0), ("b", "z", 0), ("c", "y", 2), ("c", "x", 2)], "p string, m string, o int")
    assert got(I.same_set_match(members, members.filter("p = 'a'"), "p", "m", "o"), "p") == [("a",)]


def test_posting_lists_in_blocks(spark):
    rng = random.Random(3)
    pairs = [(rng.choice(["hot", "hot", "cold", None]), rng.choice([rng.randint(0, 90), rng.randint(0, 90), None])) for _ in range(400)]
    lists = I.inverted_index(spark.createDataFrame(pairs, "t string, k int").repartition(5), "t", "k", 16).collect()
    for token in ("hot", "cold"):
        ids = sorted({k for t, k in pairs if t == token and k is not None})
        blocks = [ids[i : i + 16] for i in range(0, len(ids), 16)]
        told = sorted((r.block, r.n, r["first"], r["last"], r.ids) for r in lists if r.t == token)
        assert told == [(i, len(b), b[0], b[-1], ",".join(map(str, b))) for i, b in enumerate(blocks)]
    assert {r.t for r in lists} == {"hot", "cold"}


def test_area_of_tiles_is_that_of_pixels(spark):
    rng = random.Random(7)
    rows = []
    for asset in (1, 2):
        for _ in range(60):
            x, y = rng.randint(-20, 90), rng.randint(-20, 90)
            rows.append((asset, x, y, x + rng.randint(-1, 40), y + rng.randint(0, 40)))
    rows += [(3, 0, 0, 5, 0), (4, 0, 0, 3000, 2)] + [(5, 1, 1, 4, 4)] * 500
    pixels = {}
    for asset, x0, y0, x1, y1 in rows:
        pixels.setdefault(asset, set()).update((x, y) for x in range(x0, x1) for y in range(y0, y1))
    df = spark.createDataFrame(rows, "asset_id int, x0 int, y0 int, x1 int, y1 int").repartition(4)
    for tile in (8, 512):
        assert got(G.union_area(df, tile), "asset_id", "area") == sorted((a, len(p)) for a, p in pixels.items() if p)


def test_an_automaton_finds_the_terms_of_each_text(spark):
    rng = random.Random(9)
    letters = "abcé "
    texts = [(i, "".join(rng.choices(letters, k=rng.randint(0, 60)))) for i in range(80)] + [(90, None), (91, "ABC")]
    terms = {"".join(rng.choices("abcé", k=rng.randint(1, 4))) for _ in range(60)}
    docs, listed = spark.createDataFrame(texts, "k int, text string").repartition(3), spark.createDataFrame([(t.upper(),) for t in terms] + [(" ",), (None,)], "term string")
    want = sorted(((k, ",".join(sorted(t for t in terms if t in x.lower()))) for k, x in texts if x and any(t in x.lower() for t in terms)), key=repr)
    assert got(O.banned_terms(docs, listed, "k"), "k", "terms") == want
    assert got(O.banned_terms(docs, listed, "k", few=1), "k", "terms") == want
    assert O.banned_terms(docs, listed.filter("false"), "k").count() == 0


def test_output_checks(spark):
    rows = [
        (1, None, True, 1080, 1920, 70.0), (2, "f", False, 1080, 1920, 95.0), (3, "f", True, 1080, 1920, 70.0), (4, "f", True, 1080, 1270, 59.9), (5, "f", True, 1110, 1920, 81.0),
        (6, "f", True, 0, 1000, 0.0), (7, "f", True, None, None, None), (8, "", True, 1, 1, 90.0), (9, "f", True, 1118, 1920, 60.0), (10, "f", None, 1080, 1920, -1.0),
    ]
    jobs = spark.createDataFrame([(*r, 70.0) for r in rows], "k int, out string, there boolean, w int, h int, s double, goal double")
    found = {}
    for r in R.output_checks(jobs, "k", "out", "there", "w", "h", "s", "goal").collect():
        found.setdefault(r.k, set()).add(r.code)
        assert r.passed == r.code.endswith(".ok") and (r.severity == "info") == r.passed
    assert found == {
        1: {"render.missing", "duration.ok"}, 2: {"render.file_missing", "duration.too_long"}, 3: {"render.ok", "duration.ok"}, 4: {"render.wrong_aspect", "render.low_resolution", "duration.too_short"},
        5: {"render.ok", "duration.over_target"}, 6: {"render.ok", "duration.unknown"}, 7: {"render.ok", "duration.unknown"}, 8: {"render.missing", "duration.over_target"}, 9: {"render.ok", "duration.ok"}, 10: {"render.file_missing", "duration.unknown"},
    }
    assert R.OUTPUT_SIZE[0] / R.OUTPUT_SIZE[1] == 0.5625 and abs(1118 / 1920 - 0.5625) < 0.02 < abs(1119 / 1920 - 0.5625)  # 0.58229 and 0.58281


def test_the_best_replacement_of_a_beat(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b"]), p % 25, rng.choice([0.1, 0.2, 0.2, 0.5, None]), rng.randint(0, 4)) for p in range(60)]
    df = spark.createDataFrame(rows, "beat string, panel int, blank double, place int").repartition(3)
    for order in (["blank", "place", "panel"], ["place", "panel"]):
        key = lambda r: tuple(dict(blank=r[2], place=r[3], panel=r[1])[c] for c in order) + (r[1],)
        top = {}
        for beat, panel, blank, _ in rows:
            if blank is not None:
                top[beat, panel] = max(top.get((beat, panel), 0.0), blank)
        best = {(b, p): min((key(r) for r in rows if r[0] == b and r[2] is not None and r[2] < t and r[1] != p), default=None) for (b, p), t in top.items()}
        assert got(I.remap_best(df, df, "beat", "panel", "blank", order), "beat", "panel", "replacement") == sorted(((b, p, k[-1]) for (b, p), k in best.items() if k), key=repr)


def test_a_project_of_many_captions_has_parts(spark):
    from proofline.operators import sequences as S

    cues = spark.createDataFrame([("p", i, f"L{i}" if i % 5 else " ", i * 1.0, i + 0.5) for i in range(12)], "project_id string, pos int, display string, start_s double, end_s double")
    parts = sorted(tuple(r) for r in S.export_srt(cues, 4).collect())
    assert [p for _, p, _ in parts] == [0, 1, 2]
    whole = "\n\n".join(s for _, _, s in parts)
    assert whole.startswith("1\n00:00:01,000 --> 00:00:01,500\nL1\n\n2\n") and whole.count(" --> ") == 9 and whole.endswith("9\n00:00:11,000 --> 00:00:11,500\nL11")


def test_documents_in_either_encoding(spark, tmp_path):
    from proofline.sources import files

    (tmp_path / "a.txt").write_bytes("é\r\n  x".encode())
    (tmp_path / "b.txt").write_bytes("é\r\n  x".encode("latin-1"))
    found = sorted((r.latin, r.text) for r in files.read_text_documents(spark, str(tmp_path)).collect())
    assert found == [(False, "é\nx"), (True, "é\nx")]


def test_best_candidates_are_those_of_all_pairs(spark):
    """Positions from few to thousands, so that spans look up blocks of all sizes; ties, nulls and a project without spans."""
    rng = random.Random(6)
    candidates, spans = [], []
    for project, reach in ((1, 3), (2, 60), (3, 5000), (4, 1), (5, 40)):
        n = 6 if reach < 5 else 150
        candidates += [(project, 1000 * project + i, rng.choice([0.5, 1.0, 1.5, 2.0, 2.5, None]), rng.choice([rng.randint(0, reach), rng.randint(0, reach), None]) if i % 9 == 0 else rng.randint(0, reach), rng.choice([0.0, 0.2])) for i in range(n)]
        if project != 5:
            spans += [(project, i, rng.choice([["w"], [], None, ["w", "x"]]), rng.choice([None, rng.randint(-20, reach + 20), rng.randint(0, reach)])) for i in range(25)]
    want = []
    for project, span, tags, prev in spans:
        scored = []
        for p, c, quality, at, arms in candidates:
            if p == project:
                base = round((quality or 0.0) + round(2.5 * arms if "w" in (tags or []) else 0.0, 3), 6)
                step = None if prev is None or at is None else at - prev
                near = max(0.0, 1.0 - abs(step or 0) / 6.0) * 0.35
                scored.append((-round(base + near + (0.0 if step is None else -min(2.0, -step * 0.25) if step < 0 else min(0.18, step * 0.03)), 6), c))
        want += [(project, span, c, round(-s, 6), k) for k, (s, c) in enumerate(sorted(scored)[:3], 1)]
    frame = spark.createDataFrame(spans, "p int, s int, tags array<string>, previous int"), spark.createDataFrame(candidates, "p int, c int, quality double, position int, arms double")
    found = R.score_candidates(*frame, "p", "s", "c", {"w": "2.5 * arms"}).collect()
    assert sorted((r.p, r.s, r.c, round(r.score, 5), r.place) for r in found) == sorted((p, s, c, round(v, 5), k) for p, s, c, v, k in want)


def test_entities_of_a_ledger(spark):
    entities = spark.createDataFrame([(1, "a", "Ann", [1]), (1, "a", "Al", [2]), (1, "b", " ", [9]), (1, None, "x", []), (3, "c", "Cy", None)], "p int, entity_id string, name string, ids array<int>")
    mentions = spark.createDataFrame([(1, "a", ["w", "x"], [1]), (1, "z", ["w"], [1]), (1, "b", ["", "x"], [2]), (2, "a", ["w"], [5]), (1, "a", None, [])], "p int, entity_id string, texts array<string>, ids array<int>")
    expected = spark.createDataFrame([(1, 1), (1, 2), (2, 5), (3, 6)], "p int, k int")
    found = got(R.validate_entities(entities, mentions, expected, "p", "k"), "p", "subject", "code")
    assert found == sorted([
        (2, "", "NO_ENTITIES"), (1, "b", "BLANK_ENTITY"), (1, None, "BLANK_ENTITY"), (1, "a", "REPEATED_ENTITY"), (1, "z", "UNKNOWN_ENTITY"), (2, "a", "UNKNOWN_ENTITY"),
        (1, "b", "BLANK_TEXT"), (1, "a", "BLANK_TEXT"), (1, None, "NO_EVIDENCE"), (3, "c", "NO_EVIDENCE"), (1, "a", "NO_EVIDENCE"), (1, "9", "UNKNOWN_PANEL"),
    ], key=repr)


def test_captions_that_overflow(spark):
    from proofline.operators import sequences as S

    texts = {0: "ONE TWO", 1: "ABCDEFGHIJ KLMNOPQRST UV", 2: "ABCDEFGHIJK LMNOPQRSTUVWXYZ", 3: " ".join(["ABCDEFGHI"] * 5), 4: "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    words = spark.createDataFrame([("p", s, w, i * 1.0, i + 0.5) for s, t in texts.items() for i, w in enumerate(t.split())], "project_id string, sentence int, display string, start_s double, end_s double")
    groups = spark.createDataFrame([("p", s, s * 0.0, 90.0, True) for s in texts], "project_id string, sentence int, start_s double, end_s double, closed boolean")
    # 22 characters fit two words of 10 and 10; the third stands alone on its line; words of 11 and 15 are alone both; five words need three lines
    found = {r.sentence for r in S.validate_groups(groups, words, 100.0, "[A-Z]+").collect() if r.code == "OVERFLOW"}
    assert found == {1, 2, 3}
