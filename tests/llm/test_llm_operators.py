"""Operators of the llm subpackage against brute force, on small fixtures with nulls, empties, ties and repeats."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from proofline.llm import automata, decontaminate, minhash, mixing, quality, recurrent, secrets, shards, suffixes, tokens
from proofline.llm.arrays import runs, split, windows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus(n=60, seed=3):
    """Texts that share passages, copies with edits, and odd rows."""
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    passages = [" ".join(rng.choices(vocabulary, k=rng.choice([14, 60, 80]))) for _ in range(6)]
    texts = []
    for i in range(n):
        own = [" ".join(rng.choices(vocabulary, k=rng.randint(5, 60))) for _ in range(3)]
        if i % 3 == 0:
            own.insert(rng.randint(0, 3), rng.choice(passages))
        texts.append("\n".join(own))
    for i in (1, 4, 7):
        edited = texts[i].split()
        edited[len(edited) // 2] = "edited"
        texts += [texts[i], " ".join(edited)]
    texts += [None, "", "  \n ", "one", "One two", "one two", "é ü ß " * 30, "same " * 40]
    return [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def copied(rows, length):
    """Per document the words covered by windows that start in a document with a smaller id."""
    first = {}
    for i, t, *_ in rows:
        ws = words_of(t)
        for k in range(len(ws) - length + 1):
            first.setdefault(tuple(ws[k : k + length]), i)
    out = {}
    for i, t, *_ in rows:
        ws, gone = words_of(t), set()
        for k in range(len(ws) - length + 1):
            if first[tuple(ws[k : k + length])] < i:
                gone |= set(range(k, k + length))
        out[i] = (len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone))
    return out


@pytest.mark.parametrize("dedup, length", [(automata.without_copied_spans, 13), (suffixes.without_repeated_passages, 50)])
def test_copied_spans(docs, rows, dedup, length):
    expected = copied(rows, length)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in dedup(docs).collect()}
    assert got == expected
    assert any(n for _, n, _ in expected.values())


def test_copied_spans_null_ids_and_repeats(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (None, text), (2, "x " + text)]
    got = sorted((r.doc_id or 99, r.n_removed) for r in automata.without_copied_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0), (1, 0), (2, 30), (99, 30)]


def test_automaton_statistics():
    rng = random.Random(1)
    for _ in range(30):
        refs = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(3, 12))] for _ in range(4)]
        automaton = automata.SuffixAutomaton()
        for doc, ref in enumerate(refs):
            automaton.add(ref, doc)
        automaton.finish()
        text = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(20)]
        for end, (matched, least) in enumerate(automaton.statistics(text, 3)):
            holds = lambda n: [d for d, r in enumerate(refs) if any(r[k : k + n] == text[end + 1 - n : end + 1] for k in range(len(r) - n + 1))]  # noqa: E731, B023
            longest = max([n for n in range(1, end + 2) if holds(n)], default=0)
            assert matched == longest
            assert least == (min(holds(3)) if longest >= 3 else automata.LAST)


def near(rows):
    sets = {}
    for i, t, *_ in rows:
        ws = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(ws[k : k + 4]) for k in range(len(ws) - 3)} if len(ws) >= 4 else {tuple(ws)} if ws else set()
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if {label[a], label[b]} != {low}:
                label[a] = label[b] = low
                changed = True
    return {i: (len(s), label[i], label[i] == i) for i, s in sets.items()}


def test_near_duplicates(docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == near(rows)


def test_near_duplicates_chain(spark):
    """Links from one text to the next, where the ends are not linked."""
    base = [f"t{i}" for i in range(200)]
    rows = [(9 - k, " ".join(base[3 * k : 3 * k + 120])) for k in range(9)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c, _) in near(rows).items()}
    odd = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (7, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(odd).collect())
    assert got == [(0, 5, False), (5, 5, True), (5, 5, True), (7, 7, True)]


def test_near_duplicates_by_doc_id_and_text(spark, monkeypatch):
    """One doc_id on unlike texts, near texts without a doc_id, and a centre with more pairs than a task takes."""
    monkeypatch.setattr(minhash, "DEGREE", 3)
    rng = random.Random(12)
    text = lambda: " ".join("".join(rng.choices("bcdfgaeiou", k=6)) for _ in range(60))
    a, b, c, d = (text() for _ in range(4))
    rows = [(3, a), (3, b), (7, b + " more"), (None, c), (None, c + " end"), (None, d), (9, None), (None, None)] + [(20 + k, a.replace(a.split()[k], "edited")) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": decontaminate.F.lit(1), "label": decontaminate.F.lit("x")})
    got = {(r.doc_id, r.first, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    named = {x for x in got if x[0] is not None}
    assert named == {(3, True, 3, True), (7, False, 3, False), (9, True, 9, True)} | {(20 + k, False, 3, False) for k in range(8)}
    none = [r for r in minhash.near_duplicates(docs).collect() if r.doc_id is None]
    assert sorted(r.kept for r in none) == [False, True, True, True] and all(r.component_id is None for r in none)


def test_hot_keys_in_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 2)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: c for i, (_, c, _) in near(rows).items()}


def test_quality_rules(spark):
    good = lambda k: "\n".join([" ".join("abcdefgh"[k] + "uvwxyz"[i % 6] + "klmnopqrst"[i // 6] for i in range(60)), "All rights reserved 12"])
    rows = [(i, good(i), "h", "x") for i in range(6)] + [(10, None, "h", "x"), (11, "", None, "x"), (12, "a b c " * 40, "h", "x"), (13, "#x $y\n#x $y\n\n", "h", "x"), (0, good(0), "h", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, kept string")
    got = {r.doc_id: r for r in quality.quality(df, share=0.5, least=2).collect()}
    assert df.count() == quality.quality(df).count()
    assert all(got[i].kept and got[i].clean_text == good(i).split("\n")[0] and got[i].n_left == 60 for i in range(6))
    assert (got[12].n_repeat_words, got[12].base_failed, got[12].n_words) == (120, True, 120)
    assert (got[13].n_symbols, got[13].n_dup_lines, got[13].word_chars, got[13].n_repeat_words) == (4, 1, 8, 0)
    assert (got[10].n_words, got[10].kept, got[11].n_words) == (0, False, 0)


def test_quality_by_brute_force(spark, monkeypatch):
    """Random texts with shared lines, repeats, nulls and copies; once more with a hash that says nothing."""
    rng = random.Random(21)
    vocabulary = ["w%d" % i for i in range(12)] + ["x #1", "$y", "\t", ""]
    shared = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 20))) for _ in range(12)]
    rows = []
    for i in range(150):
        lines = [rng.choice(shared) if rng.random() < 0.4 else " ".join(rng.choices(vocabulary, k=rng.randint(0, 25))) for _ in range(rng.randint(0, 8))]
        rows.append((i, "\n".join(lines), rng.choice(["a", "b", None])))
    rows += [(200 + k, rows[k][1], rows[k][2]) for k in range(20)] + [(300, None, "a"), (None, None, None), (None, rows[3][1], "b"), (rows[5][0], *rows[5][1:])]
    key = lambda line: re.sub("[0-9]", "0", " ".join(words_of(line)).lower())
    lines_of = lambda t: [x for x in (t or "").split("\n") if words_of(x)]
    held = {}
    for _, t, h in rows:
        for x in lines_of(t):
            held.setdefault((h, key(x)), set()).add(t)
    expected = Counter()
    for i, t, h in rows:
        ws = words_of(t)
        grams = Counter(tuple(ws[k : k + 3]) for k in range(len(ws) - 2))
        repeated = len({k + d for k in range(len(ws) - 2) if grams[tuple(ws[k : k + 3])] > 1 for d in range(3)})
        left = len(ws) - sum(len(words_of(x)) for x in lines_of(t) if len(held[h, key(x)]) > 10)
        failed = len(ws) < 50 or 100 * repeated > 50 * len(ws)
        text = None if t is None else "\n".join(x for x in t.split("\n") if len(held.get((h, key(x)), ())) <= 10)
        expected[i, h, len(ws), len(lines_of(t)) - len(set(lines_of(t))), repeated, left, failed, not failed and left >= 50 and 2 * left >= len(ws), text] += 1
    assert {r[4] > 0 for r in expected} == {r[5] < r[2] for r in expected} == {r[7] for r in expected} == {True, False}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"_l": mixing.F.lit(1), "kept": mixing.F.lit("x")})
    for blind in (False, True):
        if blind:
            monkeypatch.setattr(quality, "PLACE_BITS", 62)
        got = Counter((r.doc_id, r.source, r.n_words, r.n_dup_lines, r.n_repeat_words, r.n_left, r.base_failed, r.kept, r.clean_text) for r in quality.quality(docs.drop("_l")).collect())
        assert got == expected


def test_secrets(spark):
    access, token = "AKIA" + "ABCDEFGH1234", "Zx9" * 8
    rows = [
        (1, f"é {access} then {token} end"), (2, f"{token} alone"), (3, f"{access}" + " " * 400 + token), (4, 'PassWord = "abcdefgh" token=short'), (5, None), (6, ""),
        (7, "user: bob99 at https://x.example/a with " + token), (8, "token: pass token=secret: abcdefghij"), (1, f"é {access} then {token} end"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    told = secrets.secrets(df).select("doc_id", secrets.span_text(secrets.F.col("secret_spans")).alias("s")).collect()
    got = {r.doc_id: r.s for r in told}
    assert len(told) == len(rows)
    assert got[1] == "access:2:18,bearer:24:48" and got[2] == "" and got[3] == "access:0:16"
    assert got[4] == "assign:0:20" and got[5] == got[6] == ""
    assert got[7] == "account:0:11,endpoint:15:34,bearer:40:64"
    for i, text in rows:
        if text:
            base = [f"assign:{m.start()}:{m.end()}" for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text, re.I) if len(m[2]) >= 8]
            assert [s for s in got[i].split(",") if s.startswith("assign")] == base


def test_mixing(docs, rows, spark):
    mixed = mixing.mix(docs).collect()
    counts = Counter(r.doc_id for r in mixed)
    rate = {r.doc_id: r.mix_rate for r in mixed}
    for i in counts:
        u, k, p = int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-rate[i])
        total = p
        while total <= u:
            k += 1
            p *= rate[i] / k
            total += p
        assert counts[i] == k
    many = spark.createDataFrame([(i, "x" * 9, "a" if i % 3 else "b") for i in range(3000)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, weight double")
    share = Counter(r.source for r in mixing.mix(many, weights).collect())
    assert abs(share["b"] / 3000 - 0.75) < 0.05 and abs(share["a"] / 3000 - 0.25) < 0.05
    large = mixing.mix(many.filter("doc_id = 1"), epochs=900.0).count()
    assert 700 < large < 1100
    empty = docs.filter("false")
    assert mixing.mix(empty).count() == 0 and mixing.mix(docs.withColumn("mix_key", mixing.F.lit(1))).columns.count("mix_key") == 1


def test_sharding(docs, rows, spark):
    placed = shards.shard(docs).collect()
    by = Counter(r.shard for r in placed)
    assert max(by.values()) - min(by.values()) <= 1 and len(placed) == len(rows)
    for s in by:
        assert sorted(r.slot for r in placed if r.shard == s) == list(range(by[s]))
    text = {i: t for i, t, *_ in rows}
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 1 and r.text_crc32 == (None if text[r.doc_id] is None else zlib.crc32(text[r.doc_id].encode())) for r in placed)
    again = {(r.doc_id, r.shard, r.slot) for r in shards.shard(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in placed}
    odd = spark.createDataFrame([(None, "a", 1), (None, None, 2), (3, "b", 3), (3, "b", 3)], "doc_id long, text string, shard int")
    assert sorted((r.shard, r.slot) for r in shards.shard(odd, 3, carry=("shard",)).collect()) == [(0, 0), (0, 1), (1, 0), (2, 0)]
    assert shards.shard(odd.filter("false")).count() == 0
    for n in (1, 2, 7, 100, 1000):
        assert sorted(shards.permuted(range(n), n)) == list(range(n))


def test_token_counts(docs, rows):
    encoding = tokens.encoder(tokens.vocabulary_path())
    expected = {i: len(encoding.encode_ordinary(t or "")) for i, t, *_ in rows}
    for block in (7, 100_000):
        got = tokens.token_counts(docs, block=block, documents=tokens.DOCUMENTS if block > 100 else 3).collect()
        assert {r.doc_id: r.n_tokens for r in got} == expected and len(got) == len(rows)
    assert tokens.token_counts(docs.filter("false")).count() == 0


def test_separator_scan_without_last_separator(spark):
    import numpy as np

    content = np.array([5, 6, 0, 0, 7, 0, 8, 9, 1], "<u2").tobytes()
    files = spark.createDataFrame([(0, bytearray(content)), (1, bytearray(b"")), (2, bytearray(content[:12]))], "file int, content binary")
    for block in (1, 2, 4, 100):
        got = sorted((r.file, r.doc_no, r.first_token, r.n_tokens) for r in tokens.scan(files, block).collect())
        assert got == [(0, 0, 0, 2), (0, 1, 3, 0), (0, 2, 4, 1), (0, 3, 6, 3), (2, 0, 0, 2), (2, 1, 3, 0), (2, 2, 4, 1)]


def brute_leaks(text, items):
    """(item_id, start) of every window whose weighted 5-word shingles share 0.8 of all with an item's."""
    out, ws = [], words_of((text or "").lower())
    grams = lambda x: Counter(tuple(x[i : i + 5]) for i in range(len(x) - 4)) if len(x) >= 5 else Counter([tuple(x)] if x else [])
    for k, item in items:
        iw = words_of((item or "").lower())
        for s in range(len(ws) - len(iw) + 1) if iw else []:
            a, b = grams(ws[s : s + len(iw)]), grams(iw)
            if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                out.append((k, s))
    return sorted(out)


def test_decontamination(spark):
    rng = random.Random(5)
    run = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    items = [(k, run(n)) for k, n in enumerate((20, 36, 3, 50, 200))] + [(5, "so it goes " * 12), (9, None)]
    edited, halves = items[3][1].split(), items[4][1].split()
    edited[0] = "other"
    swapped = " ".join(halves[100:] + halves[:100])  # no shingle stands where the item has it
    docs = [
        (1, "x y z " + items[0][1].upper() + " end"), (2, " ".join(edited)), (3, " ".join(items[1][1].split()[:20])), (4, None), (5, ""), (6, "p " + items[2][1]), (7, run(90)),
        (8, swapped), (9, f"{run(30)} {swapped} {items[4][1]}"), (10, f"{run(45)} {items[1][1]} {items[3][1]}"), (11, "so it goes " * 20), (12, "x y z " + items[0][1].upper() + " end"), (None, items[3][1]),
    ]
    df = spark.createDataFrame(docs + docs[:1], "doc_id long, text string").withColumns({"leaks": decontaminate.F.lit(0), "_t": decontaminate.F.lit("t"), "item_id": decontaminate.F.lit(1)})
    bench = spark.createDataFrame(items, "item_id long, text string")
    told = decontaminate.judged(df.drop("_t"), bench).collect()
    got = {r.doc_id: sorted((x.item_id, x.start) for x in r.leaks or []) for r in told}
    assert len(told) == len(docs) + 1
    for i, text in docs:
        assert got[i] == brute_leaks(text, items), i
    assert (0, 3) in got[1] and (3, 0) in got[2] and not got[3] and not got[7]
    assert (4, 0) in got[8] and len(got[9]) > 20 and (1, 45) in got[10] and (3, 81) in got[10]
    assert decontaminate.judged(df.drop("_t"), bench.filter("false")).filter("clean").count() == len(docs) + 1
    assert decontaminate.judged(df.drop("_t").filter("false"), bench).count() == 0


def test_decontamination_of_edited_items(spark):
    """Items with words changed, lost, added and parts moved, so that many windows lie around the similarity."""
    rng = random.Random(8)
    vocabulary = ["v%d" % i for i in range(300)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(6, 90)))) for k in range(40)]
    docs = []
    for i in range(120):
        ws = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(ws))
            kind = rng.randint(0, 3)
            ws = [ws[:at] + ["new"] + ws[at + 1 :], ws[:at] + ws[at + 1 :], ws[:at] + ["more"] + ws[at:], ws[at:] + ws[:at]][kind] or ["x"]
        docs.append((i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)) + ws + rng.choices(vocabulary, k=rng.randint(0, 30)))))
    found = decontaminate.judged(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {r.doc_id: sorted((x.item_id, x.start) for x in r.leaks or []) for r in found}
    expected = {i: brute_leaks(t, items) for i, t in docs}
    assert got == expected and 40 < sum(map(bool, expected.values())) < 115


def test_recurrent_scores(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(w for _ in range(rng.randint(2, 12)) for w in ("The", rng.choice(["cat", "dog", "owl"]), rng.choice(["sat", "ran"]), "."))) for i in range(900)] + [(1000, None), (1001, ""), (None, "the cat")]
    got = recurrent.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    train = Counter()
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    tokens_of = lambda t: [w.lower() for w in words_of(t)] + [None]
    for i, t in rows:
        if not held(i):
            train.update(tokens_of(t))
    n, v = sum(train.values()), len(train)
    text = dict(rows)
    for r in got:
        own = tokens_of(text[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(own), sum(train[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), abs=1e-6)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert recurrent.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_recurrent_scores_for_any_partitions(spark, monkeypatch):
    """Scores and weights do not hang on how the input or the shuffles are dealt, nor on texts that are held out."""
    monkeypatch.setattr(recurrent, "BLOCK", 3_000)
    rng = random.Random(15)
    rows = [(i, " ".join(w for _ in range(rng.randint(2, 12)) for w in ("the", rng.choice(["cat", "dog", "owl"]), rng.choice(["sat", "ran"]), "."))) for i in range(1200)]
    rows += [(2000, None), (2001, "word " * 5_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": mixing.F.lit(1), "classes": mixing.F.lit("x")})
    told = []
    for parts, shuffles in ((2, "3"), (7, "5")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        told.append({r.doc_id: r.score for r in recurrent.score(docs.repartition(parts)).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert told[0].keys() == told[1].keys() and all(told[0][i] == pytest.approx(told[1][i], abs=1e-3, rel=1e-5) for i in told[0])
    held = next(i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0)
    other = spark.createDataFrame([(i, "new words " * 9_000 if i == held else t) for i, t in rows], "doc_id long, text string")
    again = {r.doc_id: r.score for r in recurrent.score(other).collect()}
    assert all(again[i] == pytest.approx(told[0][i], abs=1e-3, rel=1e-5) for i in again if i != held)


def test_recurrent_gradient():
    import numpy as np

    rng, parts = np.random.default_rng(0), 4
    x, y = (rng.integers(0, recurrent.END * parts, (4, 3)) for _ in range(2))
    x[0], x[2, 1], y[1, 1] = recurrent.CLASSES * parts, recurrent.CLASSES * parts, recurrent.END * parts
    live = np.ones(x.shape, bool)
    model = recurrent.Gru.new(np.full((recurrent.CLASSES, parts), 1 / (recurrent.CLASSES * parts)))
    model.within[:, :-1] *= 20  # so that cells weigh in the state's slope
    flat = model.flat().astype(np.float64)

    def loss(flat):
        m, h, total = recurrent.Gru.of(flat, parts), np.zeros((3, recurrent.HIDDEN), np.float32), 0.0
        given = m.embeddings()
        for a, b in zip(x, y):
            h[a == m.start] = 0
            h = m.step(given[a], h)[0]
            kind, cell = np.divmod(b, parts)
            total -= m.log_softmax(h)[np.arange(3), kind].astype(np.float64).sum()
            for k in np.flatnonzero(kind != recurrent.END):
                logits = (h[k] @ m.within[kind[k], :-1] + m.within[kind[k], -1]).astype(np.float64)
                total -= logits[cell[k]] - np.log(np.exp(logits).sum())
        return total

    model.learn(x, y, live, np.zeros((3, recurrent.HIDDEN), np.float32), 1.0)
    slope = (flat - model.flat()) * x.size
    sizes = [a.size for a in (model.inputs, model.hidden, model.output, model.finer, model.within)]
    scale = np.repeat([1, 1, 1, recurrent.FINER, recurrent.FINER], sizes)
    seen = np.flatnonzero(slope)
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    for b, e in zip(firsts[:-1], firsts[1:]):
        for at in [*rng.choice(seen[(seen >= b) & (seen < e)], 20), *rng.integers(b, e, 10)]:
            step = np.zeros(len(flat))
            step[at] = 1e-2
            assert slope[at] / scale[at] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-2, abs=2e-3)


def test_recurrent_state_sees_words(spark):
    """Word order within a class changes the score, and the probabilities of all next words sum to 1."""
    import numpy as np

    rng = random.Random(4)
    pairs = [("red", "fox"), ("blue", "jay"), ("grey", "owl"), ("tan", "hen")]
    rows = [(i, " ".join(w for _ in range(rng.randint(20, 60)) for w in rng.choice(pairs))) for i in range(1500)]
    rows += [(5000, "red fox blue jay " * 10), (5001, "red jay blue fox " * 10)]
    got = {r.doc_id: r for r in recurrent.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[5000].base_score == pytest.approx(got[5001].base_score) and got[5000].score > got[5001].score + 5
    model = recurrent.Gru.new(np.full((recurrent.CLASSES, 4), 1 / (recurrent.CLASSES * 4)))
    every = [np.array([7, code]) for code in range(recurrent.END * 4)] + [np.array([7, recurrent.END * 4])]
    logs = recurrent.scored(model, every).reshape(-1, 2)[:, 1]
    assert (10**logs).sum() == pytest.approx(1, abs=1e-4)


def test_windows_agree_with_words():
    texts = [b"a b c d", b"", b"  x\ty\nz a b c d ", "é b c d".encode()]
    words = split(texts)
    assert [words.joined([(b, e)]) for b, e in zip(words.first[:-1], words.first[1:])] == [b"a b c d", b"", b"x y z a b c d", "é b c d".encode()]
    hashed = windows(words.hash, 4)
    assert hashed[0] == hashed[7] and hashed[0] != hashed[11]
    assert list(map(list, runs(words.hash == words.hash[0]))) == [[0, 7], [1, 8]]


def test_windows_that_share_a_hash_keep_their_first_holders(spark):
    """With 4 bits of the first hash all windows meet; each still finds the document that holds it first."""
    rng = random.Random(12)
    texts = [" ".join(f"t{rng.randrange(10**6)}" for _ in range(40)) for _ in range(4)]
    rows = [(i, t) for i, t in enumerate([*texts, *texts, "own " + texts[3]])]
    groups, spans = automata.removed_spans(spark.createDataFrame(rows, "doc_id long, text string"), bits=4)
    got = {r.doc_id: r.n_removed for r in automata.cut(groups, spans).collect()}
    assert got == {**dict.fromkeys(range(4), 0), **dict.fromkeys(range(4, 9), 40)}


def linked_by_hand(parts, scope):
    """secrets.linked over all pairs of the parts (kind, start, end) of one text."""
    told = {k[0]: (k[1], k[5], k[6]) for k in secrets.KINDS}
    out = []
    for kind, start, end in parts:
        rank, part, strong = told[kind]
        if strong:
            out.append((start, rank, kind, end))
            continue
        beside, over = [], False
        for other, s, e in parts:
            r, p, sure = told[other]
            if (other, s, e) == (kind, start, end):
                continue
            first_end = end if (start, rank) < (s, r) else e
            if max(start, s) - first_end <= scope:
                over |= sure and p != "endpoint" and start < e and s < end
                if p != part:
                    beside.append((p, sure))
        if not over and (any(sure for _, sure in beside) or len({p for p, _ in beside}) == 2):
            out.append((start, rank, kind, end))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_links_of_random_parts(spark):
    """Texts of parts and fillers at random distances: spans are those of all pairs of the parts."""
    rng = random.Random(31)
    made = {
        "assign": lambda: "password = " + "".join(rng.choices("abcdef0123", k=10)), "access": lambda: "AKIA" + "".join(rng.choices("ABCDEF0123", k=16)), "hex": lambda: "".join(rng.choices("abcdef0123456789", k=34)),
    }
    weak = ["user = alice.b", "account: bob_smith", "login=carol99", "Bearer abcDEF123456ghiJKL789", "bearer tok3nTOK3Ntok3nTOK", "https://api.example.com/v1/x", "host = db.example.org", "https://example.org"]
    texts = []
    for _ in range(300):
        text = []
        for _ in range(rng.randint(1, 6)):
            text.append(rng.choice([rng.choice(weak), rng.choice(weak), made[rng.choice(list(made))]()]))
            text.append("lorem ipsum " * rng.choice([0, 1, 3, 8, 13, 14, 20]))
        texts.append(" ".join(text))
    texts += ["", None, texts[0], texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.s for r in secrets.secrets(docs).select("doc_id", secrets.span_text(F.col("secret_spans")).alias("s")).collect()}
    parts = {}
    for i, text in enumerate(texts):
        for kind, _, pattern, group, least, _, _ in secrets.KINDS:
            for m in re.finditer(pattern.replace("(?i:", "(?i:"), text or ""):
                if len(m.group(group)) >= least and (kind != "bearer" or re.search("[0-9]", m.group(0)) and re.search("[A-Za-z]", m.group(0))):
                    parts.setdefault(i, []).append((kind, m.start(), m.end()))
    want = {i: linked_by_hand(parts.get(i, []), secrets.SCOPE) for i in range(len(texts))}
    assert got == want
    kinds = Counter(s.split(":")[0] for t in want.values() if t for s in t.split(","))
    assert len(kinds) >= 5 and min(kinds.values()) >= 3
