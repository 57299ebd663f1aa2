"""Queries of the geometry and grid families, over boxes and 8 x 8 grids made from embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.operators import framing as M
from proofline.operators import geometry as G
from proofline.plans.registry import query

BOXES = "bx AS (SELECT vec_id // 10 AS asset_id, vec_id, label % 2 AS class, CAST(floor(256 * abs(embedding[1]::DOUBLE)) AS INT) AS x0, CAST(floor(256 * abs(embedding[2]::DOUBLE)) AS INT) AS y0, CAST(floor(256 * abs(embedding[1]::DOUBLE)) + 1 + floor(256 * abs(embedding[3]::DOUBLE)) AS INT) AS x1, CAST(floor(256 * abs(embedding[2]::DOUBLE)) + 1 + floor(256 * abs(embedding[4]::DOUBLE)) AS INT) AS y1, abs(embedding[5]::DOUBLE) AS conf FROM embeddings)"
GRID = "gr AS (SELECT asset_id, i // 8 AS y, i % 8 AS x, CAST(greatest(0, least(255, floor(128.5 + 256 * e::DOUBLE))) AS INT) AS value FROM (SELECT vec_id AS asset_id, unnest(embedding) AS e, unnest(range(64)) AS i FROM embeddings))"
HEIGHTS = "h AS (SELECT doc_id AS asset_id, n_chars FROM documents)"


def boxes(t):
    e = lambda i: f"abs(cast(embedding[{i}] as double))"
    return t.embeddings.selectExpr("vec_id div 10 as asset_id", "vec_id", "label % 2 as class", f"cast(floor(256 * {e(0)}) as int) as x0", f"cast(floor(256 * {e(1)}) as int) as y0", f"cast(floor(256 * {e(0)}) + 1 + floor(256 * {e(2)}) as int) as x1", f"cast(floor(256 * {e(1)}) + 1 + floor(256 * {e(3)}) as int) as y1", f"{e(4)} as conf")


def pixels(t):
    return t.embeddings.selectExpr("vec_id as asset_id", "transform(embedding, v -> cast(greatest(0, least(255, floor(128.5D + 256 * cast(v as double)))) as int)) as px")


def grid(t):
    return G.cells(pixels(t), "px")


@query(f"WITH {BOXES} SELECT p.asset_id, p.vec_id AS a, q.vec_id AS b FROM bx p JOIN bx q ON p.asset_id = q.asset_id AND p.vec_id < q.vec_id AND p.class <> q.class AND p.x0 < q.x1 AND q.x0 < p.x1 AND p.y0 < q.y1 AND q.y0 < p.y1")
def joi8_rect_overlap_pairs(t):
    return G.rect_overlap_pairs(boxes(t), "vec_id", "class")


AREA = """ys AS (SELECT asset_id, y, lead(y) OVER (PARTITION BY asset_id ORDER BY y) AS ny FROM (SELECT DISTINCT asset_id, unnest([y0, y1]) AS y FROM bx)), xs AS (SELECT asset_id, x, lead(x) OVER (PARTITION BY asset_id ORDER BY x) AS nx FROM (SELECT DISTINCT asset_id, unnest([x0, x1]) AS x FROM bx)),
area AS (SELECT asset_id, CAST(sum((ny - y) * (nx - x)) AS BIGINT) AS area FROM (SELECT DISTINCT ys.asset_id, y, ny, x, nx FROM ys JOIN xs USING (asset_id) JOIN bx ON bx.asset_id = ys.asset_id AND y0 <= y AND y1 >= ny AND x0 <= x AND x1 >= nx) GROUP BY asset_id)"""


@query(f"WITH {BOXES}, {AREA} SELECT * FROM area")
def agg14_union_area(t):
    return G.union_area(boxes(t))


@query(f"WITH {BOXES}, s AS (SELECT *, (x1 - x0) * (y1 - y0) AS size, CASE WHEN conf < 0.3 THEN class END AS known FROM bx) SELECT asset_id, CAST(coalesce(sum(size) FILTER (known IS NOT NULL), 0) AS BIGINT) AS accounted, round(coalesce(sum(size) FILTER (known IS NOT NULL), 0) / 8000, 6) AS ratio, count_if(known IS NULL) AS unresolved, coalesce(string_agg(vec_id, ',' ORDER BY vec_id) FILTER (conf < 0.05), '') AS low_confidence, coalesce(sum(size) FILTER (known IS NOT NULL), 0) >= 8000 AND count_if(known IS NULL) = 0 AS complete FROM s GROUP BY asset_id")
def agg13_coverage_manifest(t):
    known = boxes(t).withColumn("known", F.expr("if(conf < 0.3, class, null)"))
    return G.coverage_manifest(known, 8000, "vec_id", "known", "conf", 0.05)


@query(f"""WITH {BOXES}, {AREA}, f AS (SELECT asset_id, count(DISTINCT asset_id % 3) AS c, bool_or(x1 > 120 OR y1 > 120) AS o FROM bx GROUP BY asset_id), p AS (SELECT DISTINCT p.asset_id FROM bx p JOIN bx q ON p.asset_id = q.asset_id AND p.vec_id < q.vec_id AND p.x0 < q.x1 AND q.x0 < p.x1 AND p.y0 < q.y1 AND q.y0 < p.y1)
SELECT f.asset_id, array_to_string(list_sort(list_filter([CASE WHEN o THEN 'OUT_OF_BOUNDS' END, CASE WHEN p.asset_id IS NOT NULL THEN 'OVERLAP' END, CASE WHEN coalesce(area, 0) < 14400 THEN 'UNCOVERED' END], lambda x: x IS NOT NULL)), ',') AS codes FROM f LEFT JOIN p ON f.asset_id = p.asset_id LEFT JOIN area ON area.asset_id = f.asset_id""")
def agg23_partition_audit(t):
    return G.partition_audit(boxes(t).withColumn("sum", F.expr("asset_id % 3")), "vec_id", "sum", 120, 120)


_CROPS = "c AS (SELECT DISTINCT asset_id, s AS crop, s * 20 AS x0, s * 10 AS y0, s * 20 + 60 AS x1, s * 10 + 60 AS y1 FROM bx, (SELECT unnest([0, 1, 2]) AS s))"


def crops(t):
    return boxes(t).select("asset_id").distinct().selectExpr("asset_id", "explode(array(0, 1, 2)) as crop").selectExpr("asset_id", "crop", "crop * 20 as x0", "crop * 10 as y0", "crop * 20 + 60 as x1", "crop * 10 + 60 as y1")


_SHARE = "greatest(0, least(c.x1, b.x1) - greatest(c.x0, b.x0)) * greatest(0, least(c.y1, b.y1) - greatest(c.y0, b.y0)) / ((b.x1 - b.x0) * (b.y1 - b.y0))"


_IN = _SHARE.split(" / ((")[0]


@query(f"""WITH {BOXES}, {_CROPS} SELECT c.asset_id, crop, coalesce(round(min({_SHARE}) FILTER (class = 0 AND vec_id % 3 > 0), 6), 1) AS face, coalesce(round(min({_SHARE}) FILTER (class = 1 AND vec_id % 3 > 0), 6), 1) AS text,
coalesce(round(sum({_IN}) FILTER (vec_id % 3 > 0) / sum((b.x1 - b.x0) * (b.y1 - b.y0)) FILTER (vec_id % 3 > 0), 6), 1) AS retained, least(1, round(coalesce(sum({_IN}) FILTER (vec_id % 3 = 0), 0) / 3600, 6)) AS blocked FROM c LEFT JOIN bx b ON c.asset_id = b.asset_id GROUP BY ALL""")
def jsn8_crop_coverage(t):
    b = boxes(t).withColumn("kind", F.expr("if(class = 0, 'face', 'text')"))
    return G.crop_coverage(crops(t), b.filter("vec_id % 3 > 0"), ["face", "text"], b.filter("vec_id % 3 = 0"))


FOCUS = "fo AS (SELECT vec_id AS asset_id, least(abs(embedding[1]::DOUBLE), 1.0) AS fx, least(abs(embedding[2]::DOUBLE), 1.0) AS fy FROM embeddings)"


@query(f"WITH {FOCUS}, s AS (SELECT *, CAST(floor(900 / s) AS INT) AS w, CAST(floor(1200 / s) AS INT) AS h FROM fo, (VALUES (1.0::DOUBLE), (1.25), (2.0)) v(s)), p AS (SELECT asset_id, w, h, least(greatest(CAST(floor(fx * 900) AS INT) - w // 2, 0), 900 - w) AS x0, least(greatest(CAST(floor(fy * 1200) AS INT) - h // 2, 0), 1200 - h) AS y0 FROM s) SELECT DISTINCT asset_id, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM p")
def jsn10_enumerate_crops(t):
    focus = t.embeddings.selectExpr("vec_id as asset_id", "least(abs(cast(embedding[0] as double)), 1.0D) as fx", "least(abs(cast(embedding[1] as double)), 1.0D) as fy")
    return G.enumerate_crops(focus, t.spark.createDataFrame([(1.0,), (1.25,), (2.0,)], "scale double"), 900, 1200)


@query(f"WITH {HEIGHTS}, c AS (SELECT asset_id, n_chars, 0 AS at0 FROM h WHERE n_chars > 0 UNION SELECT asset_id, n_chars, n_chars FROM h WHERE n_chars > 0 UNION SELECT asset_id, n_chars, k * 700 FROM h, (SELECT unnest([1, 2, 4]) AS k) WHERE k * 700 < n_chars) SELECT asset_id, y0, y1 FROM (SELECT asset_id, at0 AS y0, lead(at0) OVER (PARTITION BY asset_id ORDER BY at0) AS y1 FROM c) WHERE y1 IS NOT NULL")
def jsn21_apply_cuts(t):
    assets = t.documents.selectExpr("doc_id as asset_id", "n_chars")
    return G.apply_cuts(assets, assets.selectExpr("asset_id", "explode(array(0, 700, 1400, 2800, 700)) as at"), "n_chars")


@query("""WITH a AS (SELECT doc_id AS asset_id, n_chars, CASE WHEN doc_id % 6 = 1 THEN [700, 400] ELSE [n_chars // 3, n_chars // 2, 900] END AS cuts, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE source END AS actor, sha256(text) AS h FROM documents),
e AS (SELECT *, [0] || cuts || [n_chars] AS e FROM a), k AS (SELECT *, CASE WHEN trim(actor) = '' THEN 'AUDIT_INVALID' WHEN NOT (e[2] > e[1] AND e[3] > e[2] AND e[4] > e[3] AND (len(e) < 5 OR e[5] > e[4])) THEN 'COORDINATE_INVALID' ELSE 'OK' END AS code FROM e)
SELECT asset_id, y0, y1, actor, 'seam' AS reason, 'manual_override' AS provenance, h AS prior_hash, code FROM (SELECT *, e[i] AS y0, e[i + 1] AS y1 FROM (SELECT *, unnest(range(1, len(e))) AS i FROM k WHERE code = 'OK') UNION ALL SELECT *, 0, NULL, NULL FROM k WHERE code <> 'OK')""")
def jsn21_override_cuts(t):
    cuts = "if(doc_id % 6 = 1, array(700L, 400L), array(n_chars div 3, n_chars div 2, 900L)) as cuts"
    made = t.documents.selectExpr("doc_id as asset_id", "n_chars", cuts, "if(doc_id % 5 = 0, ' ', source) as actor", "'seam' as reason", "sha2(cast(text as binary), 256) as prior_hash")
    return G.override_cuts(made, "n_chars")


@query(f"""WITH {HEIGHTS}, e AS (SELECT asset_id, CAST(700 AS BIGINT) AS at0, 'detected' AS source, 0.9 AS c FROM h WHERE n_chars > 700 UNION ALL SELECT asset_id, least(greatest(n_chars * i // 3 + o, 1), n_chars - 1), 'ideal', round(0.5 - abs(o) / 1000, 6) FROM h, (SELECT unnest([1, 2]) AS i), (SELECT unnest([-20, -10, 0, 10, 20]) AS o) WHERE n_chars > 3)
SELECT asset_id, at0 AS "at", source, c AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, at0 ORDER BY source = 'detected' DESC, c DESC) AS k FROM e) WHERE k = 1""")
def jsn22_candidate_positions(t):
    assets = t.documents.selectExpr("doc_id as asset_id", "n_chars")
    detected = assets.filter("n_chars > 700").selectExpr("asset_id", "700 as at", "0.9D as confidence")
    return G.candidate_positions(assets, detected, "n_chars", 3, [-20, -10, 0, 10, 20])


@query("SELECT doc_id, CAST(CASE WHEN least(n_chars / c, 900) / greatest(n_chars / c, 900) > least(n_chars / f, 900) / greatest(n_chars / f, 900) + 1e-12 THEN c ELSE f END AS INT) AS parts FROM (SELECT *, least(6, f + 1) AS c FROM (SELECT doc_id, n_chars, greatest(1, least(6, n_chars // 900)) AS f FROM documents))")
def jsn19_split_count(t):
    return G.split_count(t.documents, "doc_id", "n_chars", 900, 6)


@query("""SELECT vec_id, code FROM (SELECT vec_id, unnest([CASE WHEN len(list_filter(b, lambda v: v < 0 OR v > 1)) > 0 THEN 'RANGE' END, CASE WHEN b[3] <= b[1] OR b[4] <= b[2] THEN 'DEGENERATE' END,
CASE WHEN len(p) < 6 OR len(p) % 2 = 1 THEN 'POLYGON' END, CASE WHEN len(list_filter(p, lambda v: v < 0 OR v > 1)) > 0 THEN 'POLYGON_RANGE' END]) AS code FROM (SELECT vec_id, embedding[1:4] AS b, embedding[5:4 + vec_id % 9] AS p FROM embeddings)) WHERE code IS NOT NULL""")
def jsn20_validate_geometry(t):
    return G.validate_geometry(t.embeddings.withColumns({"b": F.slice("embedding", 1, 4), "p": F.expr("slice(embedding, 5, cast(vec_id % 9 as int))")}), "vec_id", "b", "p")


_ODD, _EVEN = ("[" + ", ".join(f"embedding[{i}]" for i in range(k, 65, 2)) + "]" for k in (1, 2))


@query(f"""WITH p AS (SELECT vec_id, list_min({_ODD}) AS x0, list_min({_EVEN}) AS y0, list_max({_ODD}) AS x1, list_max({_EVEN}) AS y1, embedding[1:4] AS b FROM embeddings)
SELECT vec_id, x0, y0, x1, y1 FROM p UNION SELECT vec_id, b[1], b[2], b[3], b[4] FROM p""")
def jsn7_region_envelope(t):
    return G.region_envelope(t.embeddings.withColumn("b", F.slice("embedding", 1, 4)), "vec_id", "embedding", "b")


STATS = f"{GRID}, st AS (SELECT asset_id, y, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance FROM gr GROUP BY ALL)"


@query(f"WITH {STATS} SELECT * FROM st")
def jsn13_grid_row_stats(t):
    return G.grid_row_stats(grid(t))


GUTTER = f"{STATS}, gu AS (SELECT *, round(1 / (1 + variance / 40) * CASE WHEN mean >= 150 OR mean <= 105 THEN 1 WHEN mean >= 140 OR mean <= 115 THEN 0.55 ELSE 0.15 END, 9) AS score FROM st)"
BRIGHT, DARK = (150, 140), (105, 115)


@query(f"WITH {GUTTER} SELECT * FROM gu")
def jsn14_gutter_score(t):
    return G.gutter_score(G.grid_row_stats(grid(t)), bright=BRIGHT, dark=DARK)


@query(f"""WITH {GUTTER}, i AS (SELECT DISTINCT asset_id, ideal FROM gu, (SELECT unnest([0, 2, 5]) AS ideal)),
b AS (SELECT asset_id, ideal, y, score, row_number() OVER (PARTITION BY asset_id, ideal ORDER BY round(score - abs(y - ideal) / 2 * 0.08, 9) DESC, y) AS k FROM gu, (SELECT unnest([0, 2, 5]) AS ideal) WHERE abs(y - ideal) <= 2 AND y >= 3 AND y < 7)
SELECT asset_id, ideal, coalesce(y, ideal) AS y, score, coalesce(score >= 0.02, false) AS hit FROM i LEFT JOIN (SELECT * FROM b WHERE k = 1) USING (asset_id, ideal)""")
def win31_best_cut(t):
    return G.best_cut(G.gutter_score(G.grid_row_stats(grid(t)), bright=BRIGHT, dark=DARK), [0, 2, 5], 2, 3, 7, 0.02)


@query(f"WITH {STATS}, l AS (SELECT *, CASE WHEN mean >= 128 THEN 'light' ELSE 'dark' END AS label FROM st), i AS (SELECT *, sum(c) OVER (PARTITION BY asset_id ORDER BY y) AS band FROM (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY asset_id ORDER BY y) THEN 0 ELSE 1 END AS c FROM l)) SELECT asset_id, CAST(band AS BIGINT) AS band, any_value(label) AS label, min(y) AS y0, max(y) + 1 AS y1 FROM i GROUP BY asset_id, band")
def win30_runs_of_rows(t):
    return G.runs_of_rows(G.grid_row_stats(grid(t)).withColumn("label", F.expr("if(mean >= 128, 'light', 'dark')")), "label")


_QUIET = {"variance": 1100.0, "texture": 40.0, "jump": 20.0, "confidence": 0.2, "edge": 0.02}


@query(f"""WITH {STATS}, tx AS (SELECT asset_id, y, round(avg(d), 6) AS texture FROM (SELECT *, abs(value - lag(value) OVER (PARTITION BY asset_id, y ORDER BY x)) AS d FROM gr) GROUP BY ALL),
m AS (SELECT *, variance <= 1100 AND texture <= 40 AS low, abs(mean - lag(mean) OVER w) AS up, abs(mean - lead(mean) OVER w) AS down, max(texture) OVER (PARTITION BY asset_id ORDER BY y ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS above, max(texture) OVER (PARTITION BY asset_id ORDER BY y ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS below FROM st JOIN tx USING (asset_id, y) WINDOW w AS (PARTITION BY asset_id ORDER BY y)),
n AS (SELECT *, CASE WHEN low AND (NOT coalesce(lag(low) OVER (PARTITION BY asset_id ORDER BY y), false) OR up > 20) THEN 1 ELSE 0 END AS new FROM m), r AS (SELECT *, sum(new) OVER (PARTITION BY asset_id ORDER BY y) AS run FROM n),
g AS (SELECT asset_id, run, min(y) AS y0, max(y) + 1 AS y1, count(*) AS k, avg(variance) AS v, arg_min_null(up, y) AS l, arg_max_null(down, y) AS rr, greatest(coalesce(arg_min_null(above, y), 0), coalesce(arg_max_null(below, y), 0)) AS t FROM r WHERE low GROUP BY asset_id, run),
s AS (SELECT *, least(1.0, (l + rr) / 180) AS edge FROM g WHERE k >= 2 AND l IS NOT NULL AND rr IS NOT NULL), c AS (SELECT *, least(1.0, edge * 0.55::DOUBLE + t / 35) AS context FROM s),
f AS (SELECT *, round(0.45::DOUBLE * least(1, greatest(0, 1 - v / 1100)) + 0.25::DOUBLE * edge + 0.2::DOUBLE * context + 0.1::DOUBLE * least(1, k / 4), 6) AS confidence FROM c)
SELECT asset_id, CAST((y0 + y1) // 2 AS INT) AS position, confidence, round(edge, 3) AS edge_score, round(context, 3) AS context_score, y0, y1 FROM f WHERE confidence >= 0.2 AND edge >= 0.02 AND context >= 0.2""")
def win30_separator_candidates(t):
    return G.separator_candidates(G.grid_row_stats(grid(t)).join(G.row_texture(grid(t)), ["asset_id", "y"]), 2, _QUIET)


@query(f"""WITH {GRID}, o AS (SELECT *, value // 64 AS owner FROM gr), f AS (SELECT asset_id, owner, y, min(x) AS x0, max(x) + 1 AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY asset_id, owner, y ORDER BY x) AS k FROM o) GROUP BY asset_id, owner, y, k)
SELECT asset_id, owner, x0, x1, min(y) AS y0, max(y) + 1 AS y1 FROM (SELECT *, y - row_number() OVER (PARTITION BY asset_id, owner, x0, x1 ORDER BY y) AS g FROM f) GROUP BY asset_id, owner, x0, x1, g""")
def win32_merge_cells(t):
    return G.merge_cells(grid(t).withColumn("o", F.expr("value div 64")), "o")


def _near(dy: str, dx: str, name: str) -> str:
    return f"JOIN gr {name} ON {name}.asset_id = a.asset_id AND {name}.y = greatest(0, least(7, a.y + {dy})) AND {name}.x = greatest(0, least(7, a.x + {dx}))"


LOW_LIMITS = (0.35, 0.5, 0.5, 0.12)
LOW = f"""{GRID}, d9 AS (SELECT dy, dx FROM (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)), d4(dy, dx) AS (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)),
w9 AS (SELECT a.asset_id, a.y, a.x, b.value AS v FROM gr a CROSS JOIN d9 {_near('d9.dy', 'd9.dx', 'b')}),
va AS (SELECT asset_id, y, x, least(1, var_pop(v) * 9 / 16256.25) AS variance FROM w9 GROUP BY ALL),
en AS (SELECT asset_id, y, x, least(1, -sum(n / 9 * log2(n / 9)) / 3) AS entropy FROM (SELECT asset_id, y, x, least(7, v // 32) AS bin, count(*) AS n FROM w9 GROUP BY ALL) GROUP BY ALL),
ed AS (SELECT a.asset_id, a.y, a.x, avg(CAST(abs(b.value - a.value) >= 12 AS INT)) AS edges, least(1, sum(abs(c.value - b.value)) / 1020) AS texture FROM gr a CROSS JOIN d4 {_near('d4.dy', 'd4.dx', 'b')} {_near('4 * d4.dy', '4 * d4.dx', 'c')} GROUP BY ALL),
lo AS (SELECT asset_id, y, x, CAST(variance <= {LOW_LIMITS[0]} AS INT) + CAST(entropy <= {LOW_LIMITS[1]} AS INT) + CAST(edges <= {LOW_LIMITS[2]} AS INT) + CAST(texture <= {LOW_LIMITS[3]} AS INT) >= 3 AS low FROM va JOIN en USING (asset_id, y, x) JOIN ed USING (asset_id, y, x))"""


@query(f"WITH {LOW} SELECT * FROM lo")
def jsn15_low_information_cells(t):
    low = G.low_information(pixels(t), "px", 8, 8, LOW_LIMITS)
    return low.select("asset_id", F.posexplode("low").alias("i", "low")).selectExpr("asset_id", "i div 8 as y", "i % 8 as x", "low")


_SIZE, _GRID = 512, 8
_TARGET, _BLANK = (108, 192), 0.2
_KINDS = list(M.MINIMA)


def framed(t):
    """Crops with their blank share, assets, protected regions and balloons, from the boxes and pixel grids."""
    assets = boxes(t).select("asset_id").distinct().selectExpr("asset_id", f"{_SIZE} as width", f"{_SIZE} as height")
    tried = assets.selectExpr("asset_id", "explode(sequence(0, 7)) as crop").selectExpr("asset_id", "crop", "crop % 4 * 15 as x0", "crop % 3 * 10 as y0", "crop % 4 * 15 + (170 + crop * 48) * 9 div 16 as x1", "crop % 3 * 10 + 170 + crop * 48 as y1")
    share = [f"{c} / {_SIZE}D as {c}" for c in ("x0", "y0", "x1", "y1")]
    kind = f"get(array({', '.join(repr(k) for k in _KINDS)}), cast(vec_id div 10 % {len(_KINDS)} as int)) as kind"
    regions = boxes(t).filter("vec_id % 10 = 0 or vec_id % 30 = 5").selectExpr("asset_id", kind, *share, "if(vec_id % 3 = 0, 0.99D, null) as minimum")
    balloons = boxes(t).filter("vec_id % 10 = 3 and y0 > 40").selectExpr("asset_id", *share)
    low = G.low_information(pixels(t), "px", _GRID, _GRID, LOW_LIMITS).join(M.protected_cells(assets, regions, _GRID, _GRID), "asset_id")
    masks = M.border_reach(low, _GRID, _GRID, "low", "protected", "width", "height").join(assets, "asset_id")
    return M.crop_blank(tried, masks, _GRID, _GRID), assets, regions, balloons, masks


def judged(t):
    return M.crop_contract(*framed(t)[:4], _TARGET, _BLANK)


_MASKS = f"""{LOW}, asset AS (SELECT DISTINCT asset_id FROM bx),
region AS (SELECT asset_id, {_KINDS!r}[vec_id // 10 % {len(_KINDS)} + 1] AS kind, x0 / {_SIZE} AS x0, y0 / {_SIZE} AS y0, x1 / {_SIZE} AS x1, y1 / {_SIZE} AS y1, CASE WHEN vec_id % 3 = 0 THEN 0.99::DOUBLE ELSE 0 END AS minimum FROM bx WHERE vec_id % 10 = 0 OR vec_id % 30 = 5),
balloon AS (SELECT asset_id, x0 / {_SIZE} AS x0, y0 / {_SIZE} AS y0, x1 / {_SIZE} AS x1, y1 / {_SIZE} AS y1 FROM bx WHERE vec_id % 10 = 3 AND y0 > 40),
cell AS (SELECT lo.*, EXISTS (SELECT 1 FROM region r WHERE r.asset_id = lo.asset_id AND (x + 1) * 64 > r.x0 * {_SIZE} AND x * 64 < r.x1 * {_SIZE} AND (y + 1) * 64 > r.y0 * {_SIZE} AND y * 64 < r.y1 * {_SIZE}) AS safe FROM lo JOIN asset USING (asset_id)),
free AS (SELECT asset_id, y, x FROM cell WHERE low AND NOT safe),
reach AS (SELECT asset_id, y, x FROM free WHERE y IN (0, 7) OR x IN (0, 7) UNION SELECT l.asset_id, l.y, l.x FROM reach JOIN free l ON l.asset_id = reach.asset_id AND abs(l.y - reach.y) <= 1 AND abs(l.x - reach.x) <= 1)"""

_RATIO, _W, _H = f"({_TARGET[0]} / {_TARGET[1]}::DOUBLE)", f"({_TARGET[0]} / {M.UPSCALE}::DOUBLE)", f"({_TARGET[1]} / {M.UPSCALE}::DOUBLE)"
_CROSS = "greatest(0, least(r.x1, c.n2) - greatest(r.x0, c.n0)) * greatest(0, least(r.y1, c.n3) - greatest(r.y0, c.n1))"


def _duck_needed(centre: str, low: str, high: str) -> str:
    kept = f"({high} - {low}) * least(1, asked)"
    return f"CASE WHEN {high} <= {low} THEN 1.0::DOUBLE ELSE least(1, greatest(0, 2 * greatest({centre} - ({high} - {kept}), {low} + {kept} - {centre}))) END"


JUDGED = f"""WITH RECURSIVE {BOXES}, {_MASKS},
tried AS (SELECT asset_id, crop, crop % 4 * 15 AS x0, crop % 3 * 10 AS y0, crop % 4 * 15 + (170 + crop * 48) * 9 // 16 AS x1, crop % 3 * 10 + 170 + crop * 48 AS y1 FROM asset, (SELECT unnest(range(8)) AS crop)),
c AS (SELECT *, x0 / {_SIZE} AS n0, y0 / {_SIZE} AS n1, x1 / {_SIZE} AS n2, y1 / {_SIZE} AS n3, round_even({_SIZE} * {_RATIO}, 0) AS bw, {_SIZE} AS bh FROM tried),
bl AS (SELECT asset_id, crop, sum(greatest(0, least(x1, (x + 1) * 64) - greatest(x0, x * 64)) * greatest(0, least(y1, (y + 1) * 64) - greatest(y0, y * 64))) AS n FROM c JOIN reach USING (asset_id) GROUP BY ALL),
rg AS (SELECT *, greatest(minimum, CASE kind {" ".join(f"WHEN '{k}' THEN {v}" for k, v in M.MINIMA.items())} ELSE 0 END)::DOUBLE AS asked FROM region),
p AS (SELECT c.asset_id, c.crop, c.bw, c.bh, kind, asked, {_CROSS} AS inside, (r.x1 - r.x0) * (r.y1 - r.y0) AS area, {_duck_needed("(n0 + n2) / 2", "r.x0", "r.x1")} AS fx, {_duck_needed("(n1 + n3) / 2", "r.y0", "r.y1")} AS fy FROM c JOIN rg r ON r.asset_id = c.asset_id),
m AS (SELECT asset_id, crop, {", ".join(f"min(inside / area) FILTER (kind = '{k}') AS {k}" for k in M.MINIMA)}, sum(inside) / sum(area) AS retained, least(min(CASE WHEN fx > 0 THEN bw / ({_SIZE} * fx) END), min(CASE WHEN fy > 0 THEN bh / ({_SIZE} * fy) END)) AS allowed FROM p GROUP BY ALL),
bn AS (SELECT c.asset_id, c.crop, least(1, sum({_CROSS}) / any_value((n2 - n0) * (n3 - n1))) AS balloon FROM c JOIN balloon r ON r.asset_id = c.asset_id GROUP BY ALL),
f AS (SELECT c.*, round(coalesce(n, 0) / ((x1 - x0) * (y1 - y0)), 6) AS blank, {", ".join(f"coalesce({k}, 1) AS {k}" for k in M.MINIMA)}, coalesce(retained, 1) AS retained, coalesce(balloon, 0) AS balloon, greatest(bw / (x1 - x0), bh / (y1 - y0)) AS zoom, least({_SIZE} / {_W}, {_SIZE} / {_H}) AS cap, round(least({_SIZE} / {_W}, {_SIZE} / {_H}, coalesce(allowed, 1e9)), 6) AS protected_cap
  FROM c LEFT JOIN bl USING (asset_id, crop) LEFT JOIN m USING (asset_id, crop) LEFT JOIN bn USING (asset_id, crop)),
ju AS (SELECT *, CASE WHEN x1 > {_SIZE} OR y1 > {_SIZE} THEN 'visual.panel_lineage_unavailable' WHEN balloon > 0 THEN 'visual.balloon_mask_overlap' WHEN zoom > cap + 1e-9 OR x1 - x0 < {_W} OR y1 - y0 < {_H} THEN 'visual.source_resolution_insufficient' WHEN blank > {_BLANK} + 1e-9 THEN 'visual.blank_infeasible'
  {" ".join(f"WHEN {k} < {v} THEN 'visual.protected_{k}_coverage'" for k, v in M.MINIMA.items())} WHEN zoom > protected_cap + 1e-9 THEN 'visual.protected_zoom_insufficient' END AS reject FROM f)"""


@query(f"{JUDGED} SELECT asset_id, crop, blank, round(zoom, 6) AS base_zoom, protected_cap, round(retained, 6) AS retained, round(balloon, 6) AS balloon, {', '.join(f'round({k}, 6) AS {k}' for k in M.MINIMA)}, reject FROM ju")
def jsn9_crop_feasible(t):
    return judged(t).select("asset_id", "crop", "blank", "base_zoom", "protected_cap", "retained", "balloon", *M.MINIMA, "reject")


@query(f"{JUDGED} SELECT asset_id, count(*) AS feasible, min(crop) AS first_crop, {', '.join(f'round(arg_min({k}, crop), 6) AS {k}' for k in ('retained', 'subject', 'face', 'action', 'effect', 'continuity_context', 'blank'))}, round(arg_min(zoom, crop), 6) AS base_zoom FROM ju WHERE reject IS NULL GROUP BY asset_id")
def gat6_feasible_ledger(t):
    return M.feasible_ledger(judged(t), "crop")


@query(f"""WITH RECURSIVE {BOXES}, {_MASKS}, n AS (SELECT asset_id, count(*) AS n FROM reach GROUP BY asset_id)
SELECT asset_id, coalesce(n, 0) AS reached, round(coalesce(n, 0) / 64, 6) AS share, round((count_if(low) - coalesce(n, 0)) / 64, 6) AS held_share, CAST(1 AS DOUBLE) AS retained FROM cell LEFT JOIN n USING (asset_id) GROUP BY asset_id, n""")
def jsn16_border_reach(t):
    return framed(t)[4].select("asset_id", "reached", "share", "held_share", "retained")


@query(f"""WITH RECURSIVE {LOW}, r AS (SELECT asset_id, y, x FROM lo WHERE low AND (y IN (0, 7) OR x IN (0, 7)) UNION SELECT l.asset_id, l.y, l.x FROM r JOIN lo l ON l.asset_id = r.asset_id AND l.low AND abs(l.y - r.y) <= 1 AND abs(l.x - r.x) <= 1), n AS (SELECT asset_id, count(*) AS n FROM r GROUP BY asset_id)
SELECT a.asset_id, coalesce(n, 0) AS reached, round(coalesce(n, 0) / 64, 6) AS share FROM (SELECT DISTINCT asset_id FROM lo) a LEFT JOIN n ON a.asset_id = n.asset_id""")
def jsn16_border_reach_unprotected(t):
    return M.border_reach(G.low_information(pixels(t), "px", 8, 8, LOW_LIMITS), 8, 8).select("asset_id", "reached", "share")


@query("SELECT vec_id, round(greatest(0.0, 0.5 * embedding[1] + 0.3 * embedding[2] + 0.2 * embedding[3] - 0.4 * embedding[4] - 0.1 * embedding[5]), 6) AS score FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS embedding FROM embeddings)")
def jsn11_visual_score(t):
    return G.visual_score(t.embeddings.withColumn("f", F.expr("transform(embedding, x -> cast(x as double))")), "vec_id", "f", [0.5, 0.3, 0.2], [0.4, 0.1])


@query(f"WITH {GRID}, m AS (SELECT asset_id, avg(value) AS m FROM gr GROUP BY asset_id) SELECT asset_id, string_agg(CASE WHEN value >= m THEN '1' ELSE '0' END, '' ORDER BY y, x) AS signature FROM gr JOIN m USING (asset_id) GROUP BY asset_id")
def jsn12_mean_bit_signature(t):
    return G.mean_bit_signature(pixels(t), "asset_id", "px")


@query(f"WITH {GRID}, e AS (SELECT asset_id, least(y // 3, 2) * 3 + least(x // 3, 2) AS cell, round(avg(value), 6) AS energy FROM gr GROUP BY ALL) SELECT asset_id, cell, energy, place FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY energy DESC, cell) AS place FROM e) WHERE place <= 3")
def top3_focal_cells(t):
    return G.focal_cells(grid(t))


@query(f"""WITH {BOXES}, k AS (SELECT *, CASE class WHEN 0 THEN 'face' ELSE CASE WHEN vec_id % 3 = 0 THEN 'text' ELSE 'hand' END END AS kind FROM bx), f AS (SELECT asset_id, kind, vec_id AS region FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, kind ORDER BY conf DESC, vec_id) AS n FROM k) WHERE n = 1)
SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY CASE kind WHEN 'face' THEN 1 WHEN 'text' THEN 2 ELSE 99 END, kind) AS place FROM f""")
def top2_rank_regions(t):
    r = boxes(t).selectExpr("asset_id", "case when class = 0 then 'face' when vec_id % 3 = 0 then 'text' else 'hand' end as kind", "vec_id as region", "conf as confidence")
    return G.rank_regions(r, {"face": 1, "text": 2})


@query(f"""WITH {GRID}, k AS (SELECT a.asset_id, a.y, a.x, any_value(a.value) AS v, 9 * any_value(a.value) - sum(b.value) AS l, count(*) AS n FROM gr a JOIN gr b ON a.asset_id = b.asset_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.asset_id, a.y, a.x),
s AS (SELECT asset_id, round(avg(CAST(CAST(v >= 150 OR v <= 110 AS INT) AS DOUBLE)), 6) AS blank, round(avg(CAST(CAST(CASE WHEN n = 9 THEN greatest(0, least(255, l)) ELSE v END > 150 AS INT) AS DOUBLE)), 6) AS edges FROM k GROUP BY asset_id)
SELECT asset_id, blank, edges, round(1 - blank, 6) AS content, blank >= 0.94 OR (edges < 0.008 AND blank >= 0.82) AS rejected FROM s""")
def flt7_blank_reject(t):
    return M.blank_reject(pixels(t), "px", 8, 8, 150, 110, 150)
