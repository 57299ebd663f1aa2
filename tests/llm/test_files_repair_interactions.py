"""Plane files, conversation repair and filter interactions against brute force."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofline.llm import interactions, planes, repair

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "rows good toxic part mask digest first rank step value at _kind copies_ _hash _row start n_tokens ids place summary edit total".split()


def texts(n=80, seed=5):
    rng = random.Random(seed)
    syllables = ["an", "Ko", "ré", "ß", "don't", "it's", "x.'s", "ü", "3", "42nd", "<b>", "#", "É", "é", "…", " ", "日本", "’tis", "≠", "A.B", "\x1c"]
    out = []
    for _ in range(n):
        out.append("".join(rng.choice(syllables) + rng.choice(["", "", " ", "\n", ", ", ".", "! ", "\t"]) for _ in range(rng.randint(0, 60))))
    return [*out, None, "", " \n ", "one", "ab <|endoftext|> c", "# # !", out[0], out[0]]


# -- op11


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(planes.vocabulary_path())


def told_by_hand(tokenizer, rows):
    at, out = 0, []
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("block,most", [(7, 50), (64, 1000), (planes.BLOCK, planes.FILE)])
def test_plane_files_give_back_all_ids(spark, tokenizer, bits, block, most):
    rows = list(enumerate(texts()))
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    docs = spark.createDataFrame(shuffled, "doc_id long, text string").repartition(4)
    got = planes.through_files(docs, bits=bits, block=block, most=most).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == told_by_hand(tokenizer, rows)


def test_plane_files_hold_the_ids(spark, tokenizer, tmp_path):
    rows = list(enumerate(texts(20)))
    planes.write_plane_files(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "f"), block=16, most=100)
    got = {r.doc_id: r.ids for r in planes.read_plane_files(spark, str(tmp_path / "f"), ids=True).collect()}
    assert got == {k: tokenizer.encode(t or "", add_special_tokens=False).ids for k, t in rows}
    sizes = [len(p.read_bytes()) for p in (tmp_path / "f").glob("part-*")]
    assert len(sizes) > 3


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("width", [2, 4])
def test_reader_opens_any_range(bits, width):
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 1 << (8 * width), 1000, dtype=np.uint32)
    file = planes.Writer(width, bits, 64, 3)
    for k in range(0, 1000, 37):
        file.add(k if k % 2 else None, [ids[k : k + 37]])
    reader = planes.Reader(file.content())
    assert reader.place == 3 and reader.n_ids == 1000 and list(reader.counts) == [37] * 27 + [1]
    for begin, end in [(0, 1000), (0, 0), (63, 65), (64, 128), (999, 1000), (130, 131), (1000, 1000)]:
        assert (reader.ids(begin, end) == ids[begin:end]).all()


def test_encoder_is_the_tokenizer(tokenizer, monkeypatch):
    every = [(t or "").encode() for t in texts(300, 9)]
    want = [tokenizer.encode(t.decode(), add_special_tokens=False).ids for t in every]
    coder = planes.Encoder(planes.vocabulary_path())
    for at in range(0, len(every), 7):  # the memory of pieces is used again
        assert [list(x) for x in coder.encode(every[at : at + 7])] == want[at : at + 7]
    monkeypatch.setattr(planes, "REMEMBERED", 5)
    assert [list(x) for t in every[:40] for x in coder.encode([t])] == want[:40]
    whole = planes.piece_keys
    monkeypatch.setattr(planes, "piece_keys", lambda *a: [whole(*a)[0] & np.uint64(7), whole(*a)[1]])  # the first hash meets all the time
    coder = planes.Encoder(planes.vocabulary_path())
    assert [list(x) for t in every[:40] for x in coder.encode([t])] == want[:40]


def test_long_texts_are_cut_before_blanks(tokenizer, monkeypatch):
    monkeypatch.setattr(planes, "SLICE", 50)
    text = "word's, " * 30 + "x" * 200 + "\n" + "é…'s " * 20
    parts = list(planes.slices(text.encode(), 50))
    assert b"".join(parts) == text.encode() and len(parts) > 4
    coder = planes.Encoder(planes.vocabulary_path())
    assert [int(i) for p in parts for i in coder.encode([p])[0]] == tokenizer.encode(text, add_special_tokens=False).ids


def test_plane_files_of_odd_tables(spark, tokenizer):
    assert planes.through_files(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a b"), (None, "c"), (1, "x"), (1, "x"), (2, None), (3, "long " * 100_000)]
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], DOCS)
    plain = planes.through_files(docs).collect()
    assert sorted(map(str, planes.through_files(docs.withColumns({c: F.lit("clash") for c in CLASHES})).collect())) == sorted(map(str, plain))
    assert Counter(r.doc_id for r in plain) == Counter(k for k, _ in rows)
    ordered = sorted(plain, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == [None, None, 1, 1, 2, 3]
    assert [r.start for r in ordered] == [0, *itertools.accumulate(r.n_tokens for r in ordered[:-1])]
    assert ordered[-1].n_tokens == 100_001 and ordered[4].n_tokens == 1 and ordered[2].ids_crc32 == ordered[3].ids_crc32


# -- op12

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(seq):
    """(cost, audit, roles) by a search over whole audits; seq has (initial, fault)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(seq) and state in ("", "a"):
            return cost, audit, out
        if (cost, audit, i, state) in seen:
            continue
        seen.add((cost, audit, i, state))
        for role in "ua":
            if (state, role) in NEXT:
                heapq.heappush(heap, (cost + 2, audit + "I", i, NEXT[state, role], (*out, (role, None))))
        if i < len(seq):
            initial, fault = seq[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if fault != "bad":
                extra = fault == "cut"
                if (state, initial) in NEXT:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, NEXT[state, initial], (*out, (None, i))))
                for role in "ua":
                    if (state, role) in NEXT:
                        heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, NEXT[state, role], (*out, (role, i))))


def by_hand(rows):
    """What op12 returns for conversations (conv_id, turn, role, text), by plain loops."""
    convs = {}
    for conv, turn, role, text in rows:
        told = [" " if x is None else str(x) for x in (conv, turn)]
        kind = zlib.crc32(":".join(told).encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    out = {}
    for conv, left in convs.items():
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, seq, counts = set(), [], Counter()
        for _, role, text in left:
            bare = text.strip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            seq.append((role[:1] if role[:1] in "sua" else "", {"blank": "bad", "duplicate": "bad", "truncated": "cut", "": ""}[fault]))
        turns = {t for t, _, _ in left if t is not None}
        cost, audit, edits = cheapest(seq)
        names = {"u": "user", "a": "assistant"}
        lines = [f"{names[role] if role else left[i][1]}:{'' if i is None else left[i][2]}" for role, i in edits]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        wrong = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(seq, seq[1:]))
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], wrong, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


CONV = "conv_id long, turn long, role string, text string"


def conversations(n=250, seed=4):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for k in range(rng.randint(1, 7)):
            turn = rng.choice([k, k, k, 2 * k, None, 0])
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", ""]), rng.choice(["Yes.", "No", "Why?", "  ", "", None, "Fine!\n", f"turn {k}.", f"cut {k}", "..."])))
    return rows


def test_repair_is_the_cheapest(spark):
    rows = conversations()
    got = repair.digests(repair.damaged(spark.createDataFrame(rows, CONV).repartition(5))).collect()
    want = by_hand(rows)
    assert {r.conv_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_blocks_put_together_are_the_whole():
    """Cut anywhere, blocks parsed from every stack give the cost and audit of the whole row."""
    parse, rng = repair.Parser(), random.Random(8)
    for _ in range(1500):
        seq = [(rng.choice(["u", "a", "s", "", "u", "a"]), rng.choice(["sound", "sound", "sound", "cut", "bad"])) for _ in range(rng.randint(0, 7))]
        row = "".join(repair.letter_of[x] for x in seq)
        cuts = [0, *sorted(rng.choices(range(len(row) + 1), k=2)), len(row)]
        tops = {0: (0, 0, None)}
        for begin, end in zip(cuts, cuts[1:]):
            tops = parse.joined(tops, {e: list(parse.block(row[begin:end], e)) for e in range(len(parse.stacks))})
        assert parse.ended(tops) == cheapest(seq)[:2]


def test_long_conversation_is_split(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Yes, number %d." % t, "cut %d" % t, "", "Same."])) for t in range(9000)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Hi.")]
    docs = spark.createDataFrame(rows, CONV)
    blocks = repair._blocks(repair._rows(docs)).filter("conv_id = 1").collect()
    assert len(blocks) >= 3 and max(len(w.audit) for b in blocks for w in b["value"].ways) <= 2 * repair.BLOCK
    got = {r.conv_id: r for r in repair.digests(docs).collect()}
    parse = repair.Parser()
    seen, seq = set(), []
    for _, _, role, text in rows[:9000]:
        seq.append((role[0], "bad" if not text or (role, text) in seen else "cut" if text[-1] != "." else "sound"))
        seen.add((role, text))
    tops = {0: (0, 0, None)}
    for x in seq:
        tops = parse.step(tops, repair.letter_of[x])
    assert (got[1].cost, got[1].audit) == parse.ended(tops)
    left = repair.repaired_rows(docs).filter("conv_id = 1").orderBy("place").collect()
    assert [r.role for r in left] == ["user", "assistant"] * (len(left) // 2) and [r.place for r in left] == list(range(1, len(left) + 1))
    assert got[1].repaired_sha256 == hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in left).encode()).hexdigest()
    assert (got[2].cost, got[2].audit) == (0, "KK")


def test_repair_of_odd_tables(spark):
    assert repair.digests(repair.damaged(spark.createDataFrame([], CONV))).count() == 0
    rows = [(7, None, None, None), (7, 1, "user", "x" * 300_000 + "."), (None, 5, "user", "A."), (None, 5, "user", "A."), (8, 3, "assistant", "B."), (8, 3, "assistant", "B.")]
    docs = spark.createDataFrame(rows, CONV)
    plain = repair.digests(repair.damaged(docs)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in plain} == by_hand(rows)
    clash = docs.withColumns({c: F.lit("clash") for c in CLASHES})
    assert sorted(map(str, repair.digests(repair.damaged(clash)).collect())) == sorted(map(str, plain))
    gone = docs.withColumn("copies", F.lit(0))
    assert {tuple(r)[1:] for r in repair.digests(gone).collect()} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


# -- op13


def audited(rows, labels):
    first, good, toxic = {}, {}, {}
    for key, text, _ in rows:
        if key is not None:
            first[text or ""] = min(first.get(text or "", key), key)
    for key, quality, bad in labels:
        good[key], toxic[key] = good.get(key, 0) or quality == 1, toxic.get(key, 0) or bad == 1
    parts = {}
    for key, text, lang in rows:
        text = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": key is not None and first[text] < key}
        label = key if key is not None else "none"
        parts.setdefault(lang or "", []).append(({f for f in fails if fails[f]}, bool(good.get(label)), bool(toxic.get(label))))
    out = {}
    for part, docs in parts.items():
        gone = Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                removed = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                gone[f] += len(removed)
                failing = sum(f in d[0] for d in docs)
                out[part, "".join(order), step] = [len(left), len(removed), failing - len(removed), sum(d[0] == {f} for d in docs), sum(d[1] for d in removed), sum(d[2] for d in removed)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(gone[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_interactions_are_those_of_every_order(spark):
    rng = random.Random(6)
    words = ["w%d" % i for i in range(300)]
    pool = [" ".join(rng.choices(words, k=rng.choice([20, 120, 150]))) + rng.choice(["", "", " #", " UPPER" * 40]) for _ in range(25)] + ["same " * 200, "", None]
    rows = [(i, rng.choice(pool), rng.choice(["en", "de", None, ""])) for i in range(120)] + [(None, pool[0], "en"), (None, pool[0], "en"), (5, pool[1], "en"), (5, pool[1], "en"), (500, "alone", "fr")]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(60)] + [(3, 1, None), (None, 1, 1), (9999, 1, 1), (5, 1, 1), (5, 0, 0)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = interactions.document_filters(docs, known).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == audited(rows, labels)
    assert len(got) == 600 * len({r[2] or "" for r in rows})
    clash = interactions.document_filters(docs.withColumns({c: F.lit("clash") for c in CLASHES}), known.withColumns({c: F.lit("clash") for c in CLASHES if c != "toxic"}))
    assert sorted(map(tuple, clash.collect())) == sorted(map(tuple, got))


def test_intervals_cover_each_order_once():
    for n in (1, 3, 5):
        names = interactions.orders("ABCDE"[:n])
        found = Counter()
        for mask, step, begin, end in interactions.removal_intervals(n):
            for rank in range(begin, end):
                assert next(i for i, f in enumerate(names[rank], 1) if mask >> "ABCDE".index(f) & 1) == step
                found[mask, rank] += 1
        assert set(found.values()) == {1} and len(found) == (2**n - 1) * len(names)


def test_interactions_of_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert interactions.document_filters(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    one = interactions.document_filters(spark.createDataFrame([(1, "x" * 300_000, None, None, None)], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and {r.removed for r in one if r.filter_order[r.step - 1] == "A"} == {1}
