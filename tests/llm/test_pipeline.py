"""The stages of the pipeline, each against brute force on what the one before it kept."""

import hashlib
import math
import random
from collections import Counter

import corpus_pipeline
from test_llm_operators import SCHEMA, near, words_of


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("bcdfgaeiou", k=6))
    texts = ["\n".join(" ".join(word() for _ in range(20)) for _ in range(4)) for _ in range(40)]
    item = " ".join(word() for _ in range(25))
    texts += [texts[0], texts[1] + " more", texts[2] + "\n" + item, "short text", None, "", "same words here " * 40]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.columns[:5] == docs.columns[:5]
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept.append(docs.collect())
    ids = [sorted(r.doc_id for r in rows) for rows in kept]
    assert ids[0] == [r[0] for r in rows if len(words_of(r[1])) >= 50 and not (r[1] or "").startswith("same")]
    survivors = near([(r.doc_id, r.text) for r in kept[0]])
    assert ids[1] == sorted(i for i, (_, _, stays) in survivors.items() if stays)
    assert ids[2] == [i for i in ids[1] if item not in texts[i]] and len(ids[2]) < len(ids[1])
    size = Counter()
    for r in kept[2]:
        size[r.source] += len(r.text) + 1
    rate = {s: sum(size.values()) * math.sqrt(n) / sum(math.sqrt(m) for m in size.values()) / n for s, n in size.items()}
    expected = Counter()
    for r in kept[2]:
        u, k, p = int(hashlib.md5(f"17:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-rate[r.source])
        total = p
        while total <= u:
            k += 1
            p *= rate[r.source] / k
            total += p
        expected[r.doc_id] = k
    assert Counter(ids[3]) == +expected
    assert ids[4] == ids[3]
    places = Counter(r.shard for r in kept[4])
    assert max(places.values()) - min(places.values()) <= 1
    assert all(sorted(r.slot for r in kept[4] if r.shard == s) == list(range(n)) for s, n in places.items())
    assert sorted((r.doc_id, r.shard, r.slot) for r in corpus_pipeline.run(spark, folder).collect()) == sorted((r.doc_id, r.shard, r.slot) for r in kept[4])


def test_empty_documents(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_boilerplate_at_production_limits(spark):
    """A line of 11 of a host's 120 texts goes, one of 10 stays, and so does one of 11 texts on two hosts; who has little else is left out."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("bcdfgaeiou", k=6))
    own = lambda n: " ".join(word() for _ in range(n))
    often, seldom, apart, long = own(9), own(9), own(9), own(70)
    texts = [own(60) for _ in range(120)]
    for k in range(11):
        texts[k] += "\n" + often
    for k in range(30, 40):
        texts[k] += "\n" + seldom
    for k in range(60, 71):
        texts[k] = own(60 if k < 70 else 52) + "\n" + long
    rows = [(i, t, "en", "hot", len(t)) for i, t in enumerate(texts)]
    rows += [(200 + k, own(60) + "\n" + apart, "en", f"h{k % 2}", 0) for k in range(11)]
    out = corpus_pipeline.quality_rules(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    got = {r.doc_id: r.text for r in out}
    gone = {often, long}
    left = {i: "\n".join(x for x in t.split("\n") if x not in gone) for i, t, *_ in rows}
    assert got == {i: t for i, t in left.items() if 2 * len(words_of(t)) >= len(words_of(dict((r[0], r[1]) for r in rows)[i]))}
    assert all(often not in got[k] for k in range(11)) and all(seldom in got[k] for k in range(30, 40)) and all(apart in got[200 + k] for k in range(11))
    assert not set(range(60, 71)) & set(got) and all(r.n_chars == len(r.text) for r in out)


def linked(texts, n):
    """Numbers of the texts that are the smallest of their group, by sets of n words and 80 percent of the union."""
    sets = [{tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} for ws in map(words_of, texts)]
    label = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return [i for i, x in enumerate(label) if x == i]


def test_near_duplicates_by_five_words(spark):
    """Copies with more and more words changed: some are near by four words and not by five."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("bcdfgaeiou", k=6))
    texts = []
    for changed in range(1, 7):
        first = [word() for _ in range(120)]
        second = list(first)
        for k in range(changed):
            second[10 + 18 * k] = word()
        texts += [" ".join(first), " ".join(second)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == linked(texts, 5) and got != linked(texts, 4)


def test_near_duplicates_lose_no_text(spark):
    """Two unlike texts under one doc_id, and texts without a doc_id, stay; of near and equal rows one does."""
    rng = random.Random(13)
    text = lambda: " ".join("".join(rng.choices("bcdfgaeiou", k=6)) for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(1, a), (1, b), (1, b), (2, a), (None, c), (None, c), (None, c + " end"), (None, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id or 0), (r.text or "")[:60]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got[:2] == [(0, ""), (0, c[:60])] and got[2:] == sorted([(1, a[:60]), (1, b[:60]), (4, "")])
