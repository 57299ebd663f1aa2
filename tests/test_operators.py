"""Edge rows, invariants and files of the reference's operators; parity with SQL is in test_parity.py."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from proofline.functions import text as T
from proofline.operators import chunks as C
from proofline.operators import geometry as G
from proofline.operators import integrity as I
from proofline.operators import sequences as S
from proofline.operators import texts as O
from proofline.sources import files


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_text_scalars(spark):
    df = frame(spark, "t string", ("a\r\nb  c \n\n\n\nd",), ("",), (None,))
    assert [r[0] for r in df.select(T.normalise_text(F.col("t"))).collect()] == ["a\nb c\n\nd", "", None]
    df = frame(spark, "t string", ("one\ntwo\n\nthree",), ("aaaa bb cccccccccc d",))
    assert df.select(T.unwrap_paragraphs(F.col("t"))).first()[0] == "one two\n\nthree"
    assert df.select(T.wrap_lines(F.col("t"), 7)).collect()[1][0] == ["aaaa bb", "cccccccccc", "d"]
    df = frame(spark, "t string", ("```json\n{}\n```",), (None,))
    assert [r[0] for r in df.select(T.strip_code_fence(F.col("t"))).collect()] == ["{}", None]
    df = frame(spark, "t string", ("secret",), ("abc",), ("",), (None,))
    assert [r[0] for r in df.select(T.mask_tail(F.col("t"), 4)).collect()] == ["**cret", "***", "<unset>", "<unset>"]


def test_overlap_bands_and_short_texts(spark):
    protected = frame(spark, "item_id long, text string", (1, "a b c d e f g h"), (2, None))
    texts = frame(spark, "doc_id long, text string", (1, "a b c d e f"), (2, "a b"), (3, None), (4, "a b c d e x y z"), (5, ""))
    got = {r.doc_id: (r.overlap, r.band) for r in O.shingle_overlap(texts, protected, "doc_id").collect()}
    assert got == {1: (1.0, "block"), 2: (0.0, "clear"), 3: (0.0, "clear"), 4: (0.25, "warn"), 5: (0.0, "clear")}
    assert {r.doc_id: r.copied for r in O.copied_ngram_exists(texts, protected, "doc_id").collect()} == {1: True, 2: False, 3: False, 4: True, 5: False}


def test_sequence_edges(spark):
    s = frame(spark, "project_id long, pos int, mode string, dur double", *[(1, i, m, 1.0) for i, m in enumerate("xABAB")], (2, 0, "A", 3.0), *[(3, i, m, 2.0) for i, m in enumerate("AABBB")])
    assert rows(S.alternating_pattern(s, "mode")) == [(1, 1)]
    assert rows(S.longest_same_run(s, "mode")) == [(1, 1.0), (2, 3.0), (3, 6.0)]
    gaps = frame(spark, "project_id long, pos int, start_s double, end_s double", (1, 0, 0.0, 1.0), (1, 1, 1.011, 2.0), (1, 2, 1.989, 3.0), (2, 0, 0.0, 1.0), (2, 1, 1.4, 2.0))
    assert rows(S.boundary_gap(gaps)) == [(1, 1, -0.011)]


@pytest.mark.parametrize("n, size, overlap", [(0, 3, 1), (1, 3, 1), (3, 3, 1), (4, 3, 1), (10, 4, 2), (11, 4, 0)])
def test_chunks_cover_in_order(spark, n, size, overlap):
    df = frame(spark, "project_id long, pos int", *[(1, i) for i in range(n)])
    got = {}
    for _, pos, chunk in rows(S.overlapping_chunks(df, size, overlap)):
        got.setdefault(chunk, []).append(pos)
    expected, start = {}, 0
    while n and start == 0 or start < n - overlap:
        expected[len(expected)] = list(range(start, min(start + size, n)))
        if start + size >= n:
            break
        start += size - overlap
    assert {k: sorted(v) for k, v in got.items()} == expected


def test_rescale_is_exact(spark):
    df = frame(spark, "project_id long, pos int, dur double", *[(1, i, 0.1 + i * 0.37) for i in range(9)], (2, 0, 5.0))
    got = [r for r in S.rescale(df, 7.0).orderBy("pos").collect() if r.project_id == 1]
    assert got[0].start_s == 0 and got[-1].end_s == 7.0
    assert all(a.end_s == b.start_s and round(a.end_s, 3) == a.end_s for a, b in zip(got, got[1:]))


def test_partitions_do_not_matter(spark):
    df = frame(spark, "project_id long, pos int, mode string, dur double", *[(i % 3, i, "ab"[i % 2 if i % 5 else 0], float(i)) for i in range(60)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(rows(S.longest_same_run(df.repartition(int(n)), "mode")))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def test_lineage_codes(spark):
    orders = frame(spark, "p long, id long, up long", (1, 10, 1), (1, 10, 1), (1, 11, None), (1, 12, 9))
    parents = frame(spark, "p2 long, k long", (1, 1), (1, 2))
    got = {(r.code, r.subject_id) for r in I.lineage_chain_audit([("ORDER", orders, "id", "up", parents, "k")], "p").collect()}
    assert got == {("DUPLICATE_ORDER", "10"), ("ORPHAN_ORDER", "11"), ("ORPHAN_ORDER", "12"), ("WITHOUT_ORDER", "2")}


def test_boxes(spark):
    b = frame(spark, "asset_id long, id long, class int, x0 int, y0 int, x1 int, y1 int", (1, 1, 0, 0, 0, 10, 10), (1, 2, 1, 5, 5, 15, 200), (1, 3, 0, 10, 0, 20, 5), (1, 4, 1, 3, 3, 3, 9), (2, 5, 0, 0, 0, 2, 2), (2, 6, 1, 2, 0, 4, 2))
    assert rows(G.rect_overlap_pairs(b, "id", "class", 8)) == [(1, 1, 2)]
    cells = {(x, y) for x0, y0, x1, y1 in [(0, 0, 10, 10), (5, 5, 15, 200), (10, 0, 20, 5)] for x in range(x0, x1) for y in range(y0, y1)}
    assert rows(G.union_area(b)) == [(1, len(cells)), (2, 8)]


def test_map_chunks_quarantines(spark):
    import pandas as pd

    df = frame(spark, "p long, o int, id long, v int", *[(i % 2, i, i, i % 7) for i in range(40)])

    def invert(part):
        if (part["v"] == 0).any():
            raise ValueError("zero")
        return pd.DataFrame({"id": part["id"], "w": 1.0 / part["v"]})

    good, bad = C.map_chunks(df, "p", "o", "id", invert, "w double", 8)
    assert {r.id for r in bad.collect()} == {i for i in range(40) if i % 7 == 0}
    assert {r.id for r in good.collect()} == {i for i in range(40) if i % 7}


def test_byte_bounded_chunks(spark):
    sizes = [5, 5, 5, 50, 1, 1, 1, 1, 1, 9]
    df = frame(spark, "p long, o int, s int", *[(1, i, s) for i, s in enumerate(sizes)])
    got = [r.chunk for r in C.byte_bounded_chunks(df, "p", "o", "s", 4, 12).orderBy("o").collect()]
    assert got == [0, 0, 1, 2, 3, 3, 3, 3, 4, 4]


def test_files(spark, tmp_path):
    (tmp_path / "in/a").mkdir(parents=True)
    (tmp_path / "in/a/B.PNG").write_bytes(b"x")
    (tmp_path / "in/a/c.exe").write_bytes(b"y")
    (tmp_path / "in/a/n.json").write_bytes(b"{}")
    assert [(r.suffix, r.accepted) for r in files.scan_media_folder(spark, str(tmp_path / "in")).collect()] == [("png", True), ("exe", False)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t/u.txt").write_bytes("é".encode())
    (tmp_path / "t/l.txt").write_bytes("é".encode("latin-1"))
    assert {r.text for r in files.read_text_documents(spark, str(tmp_path / "t")).collect()} == {"é"}
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.png", b"1")
        z.writestr("__MACOSX/b.png", b"2")
        z.writestr("c.txt", b"3")
    df = frame(spark, "path string, content binary", ("good", bytearray(packed.getvalue())), ("bad", bytearray(b"no")))
    assert rows(files.expand_archives(df).select("path", "entry", "error")) == [("bad", None, "BAD_ARCHIVE"), ("good", "a.png", None)]


def test_logs_partitions_blobs(spark, tmp_path):
    log = str(tmp_path / "log")
    files.append_log(frame(spark, "k string, n int, v string", ("a", 1, "x"), ("a", 2, "x"), ("b", 1, "y")), log)
    (tmp_path / "log/part-bad.json").write_text('{"k": "a", "n": \n{"k": "c", "n": 1, "v": "x"}\n')
    assert rows(files.read_checkpoint_log(spark, log, "k string, n int, v string", {"v": "x"}, ["k"], "n")) == [("a", 2, "x"), ("c", 1, "x")]
    table = str(tmp_path / "table")
    files.replace_partition(frame(spark, "k int, v int", (1, 1), (2, 2)), table, "k")
    files.replace_partition(frame(spark, "k int, v int", (2, 3)), table, "k")
    assert rows(spark.read.parquet(table).select("k", "v")) == [(1, 1), (2, 3)]
    store = str(tmp_path / "blobs")
    for _ in range(2):
        files.put_content_addressed(frame(spark, "id int, text string", (1, "a"), (2, "a"), (3, "b")), store, "text", ".txt")
    assert spark.read.parquet(store).count() == 2
    audit = str(tmp_path / "audit")
    files.append_audit(frame(spark, "who string, id int, pw string", ("me", 1, "s")), audit, "who", "SAVE", "id", ["id", "pw"], ["pw"])
    assert json.loads(spark.read.json(audit).first().detail) == {"id": 1}
