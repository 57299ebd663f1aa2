"""Rectangles, crops, cuts and pixel grids. Boxes are half-open integers (x0, y0, x1, y1) of an asset."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.operators.sequences import if_small, islands

A = "asset_id"


def rect_overlap_pairs(boxes: DataFrame, key: str, label: str, step: int = 64) -> DataFrame:
    """(asset_id, a, b): boxes of one asset that intersect but differ in label.

    Rows of pixels go to bands of step; a pair is kept in the band where the later box begins, so each comes once.
    """
    banded = boxes.filter("x1 > x0 and y1 > y0").withColumn("_band", F.expr(f"explode(sequence(cast(floor(y0 / {step}) as int), cast(floor((y1 - 1) / {step}) as int)))"))
    side = lambda s: banded.select(A, "_band", F.struct(F.col(key).alias("k"), F.col(label).alias("l"), "x0", "y0", "x1", "y1").alias(s))
    hit = side("p").join(side("q"), [A, "_band"]).filter(f"p.k < q.k and p.l <> q.l and p.x0 < q.x1 and q.x0 < p.x1 and p.y0 < q.y1 and q.y0 < p.y1 and _band = cast(floor(greatest(p.y0, q.y0) / {step}) as int)")
    return hit.select(A, F.col("p.k").alias("a"), F.col("q.k").alias("b"))


def union_area(boxes: DataFrame, tile: int = 512) -> DataFrame:
    """(asset_id, area) covered by at least one box, each place once.

    Boxes are cut at the borders of tiles of so many pixels a side. In a tile a box is four changes: where it begins and ends,
    across and down. Changes of one place are added up before they are shuffled, so that a tile has as many as it has places
    at most, however many boxes meet in it; their running sums across and down say how many boxes lie on each pixel.
    """
    spans = lambda a, b: F.sequence(F.floor(F.col(a) / tile), F.floor((F.col(b) - 1) / tile))
    cut = boxes.filter("x1 > x0 and y1 > y0").select(A, "x0", "y0", "x1", "y1").distinct().withColumn("_tx", F.explode(spans("x0", "x1"))).withColumn("_ty", F.explode(spans("y0", "y1")))
    low = lambda c, t: F.greatest(F.lit(0), F.col(c) - F.col(t) * tile).cast("int")
    high = lambda c, t: F.least(F.lit(tile), F.col(c) - F.col(t) * tile).cast("int")
    xs, ys = (low("x0", "_tx"), high("x1", "_tx")), (low("y0", "_ty"), high("y1", "_ty"))
    corners = F.array(*[F.struct(xs[i].alias("x"), ys[j].alias("y"), F.lit(1 - 2 * ((i + j) % 2)).alias("n")) for i in (0, 1) for j in (0, 1)])
    changes = cut.select(A, "_tx", "_ty", F.explode(corners).alias("_c")).groupBy(A, "_tx", "_ty", "_c.x", "_c.y").agg(F.sum("_c.n").alias("n"))
    kind = boxes.schema[A].dataType.simpleString()

    def covered(part: pd.DataFrame) -> pd.DataFrame:
        depth = np.zeros((tile + 1, tile + 1), np.int64)
        depth[part["y"], part["x"]] = part["n"]
        return pd.DataFrame({A: part[A].iloc[:1], "area": [int((depth.cumsum(0).cumsum(1) > 0).sum())]})

    return changes.groupBy(A, "_tx", "_ty").applyInPandas(covered, f"{A} {kind}, area long").groupBy(A).agg(F.sum("area").alias("area"))


def coverage_manifest(boxes: DataFrame, total: int, key: str, label: str, sure: str, least: float) -> DataFrame:
    """Areas by class, accounted share of total, boxes without a class and with low confidence, and whether all is accounted for."""
    size = F.expr("cast(greatest(0, x1 - x0) as bigint) * greatest(0, y1 - y0)")
    known = F.col(label).isNotNull()
    out = boxes.groupBy(A).agg(F.sum(F.when(known, size).otherwise(0)).alias("accounted"), F.sum(size).alias("all"), F.count_if(~known).alias("unresolved"), F.array_join(F.array_sort(F.collect_list(F.when(F.col(sure) < least, F.col(key)))), ",").alias("low_confidence"))
    return out.select(A, "accounted", F.round(F.col("accounted") / total, 6).alias("ratio"), "unresolved", "low_confidence", ((F.col("accounted") >= total) & (F.col("unresolved") == 0)).alias("complete"))


def partition_audit(boxes: DataFrame, key: str, checksum: str, width: int, height: int) -> DataFrame:
    """(asset_id, codes): broken rules of boxes that should tile an asset."""
    facts = boxes.groupBy(A).agg(F.count_distinct(checksum).alias("_c"), F.count("*").alias("_n"), F.count_distinct(key).alias("_k"), F.bool_or(F.expr(f"x0 < 0 or y0 < 0 or x1 > {width} or y1 > {height} or x0 >= x1 or y0 >= y1")).alias("_out"))
    pairs = rect_overlap_pairs(boxes.withColumn("_l", F.col(key)), key, "_l").select(A).distinct().withColumn("_over", F.lit(True))
    joined = facts.join(pairs, A, "left").join(union_area(boxes), A, "left")
    codes = f"if(_c <> 1, 'CHECKSUM', null), if(_k < _n, 'DUPLICATE_ID', null), if(_out, 'OUT_OF_BOUNDS', null), if(_over, 'OVERLAP', null), if(coalesce(area, 0) < {width * height}, 'UNCOVERED', null)"
    return joined.select(A, F.expr(f"array_join(array_sort(array_compact(array({codes}))), ',')").alias("codes"))


def crop_coverage(crops: DataFrame, regions: DataFrame, kinds: list[str], forbidden: DataFrame | None = None) -> DataFrame:
    """(asset_id, crop, <kind>..., retained, blocked) of crops over protected regions (asset_id, kind, box) and forbidden boxes.

    A kind's value is the least share of a region of it inside the crop, 1 without a region, 0 if one has no area. retained is
    the share of all protected area inside, 1 without any; blocked the share of the crop that forbidden boxes take, each
    counted, 1 at most, and 1 for a crop without area.
    """
    box = [F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")]
    r = regions.select(A, "kind", *box, F.lit(False).alias("_bad"))
    if forbidden is not None:
        r = r.unionByName(forbidden.select(A, F.lit(None).cast("string").alias("kind"), *box, F.lit(True).alias("_bad")))
    joined = crops.join(r, A, "left").withColumns({
        "_in": F.expr("greatest(0, least(x1, _x1) - greatest(x0, _x0)) * greatest(0, least(y1, _y1) - greatest(y0, _y0))"),
        "_area": F.expr("greatest(0, _x1 - _x0) * greatest(0, _y1 - _y0)"), "_crop": F.expr("greatest(0, x1 - x0) * greatest(0, y1 - y0)"),
    })
    share = F.expr("if(_area > 0, _in / _area, 0.0D)")
    own, bad = F.expr("_bad = false"), F.expr("_bad")
    return joined.groupBy(A, "crop").agg(
        *[F.coalesce(F.round(F.min(F.when(own & (F.col("kind") == k), share)), 6), F.lit(1.0)).alias(k) for k in kinds],
        F.coalesce(F.round(F.try_divide(F.sum(F.when(own, F.col("_in"))), F.sum(F.when(own, F.col("_area")))), 6), F.lit(1.0)).alias("retained"),
        F.least(F.lit(1.0), F.coalesce(F.round(F.try_divide(F.coalesce(F.sum(F.when(bad, F.col("_in"))), F.lit(0)), F.max("_crop")), 6), F.lit(1.0))).alias("blocked"),
    )


def crop_feasible(crops: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """crops with reject: the code of the first rule (code, condition) that applies, null if none."""
    return crops.withColumn("reject", F.coalesce(*[F.when(F.expr(rule), F.lit(code)) for code, rule in rules]))


def enumerate_crops(panels: DataFrame, scales: DataFrame, width: int, height: int) -> DataFrame:
    """(asset_id, x0, y0, x1, y1): the distinct crops around the focus (fx, fy) at each scale, kept inside the panel."""
    c = panels.crossJoin(if_small(scales)).withColumns({"_w": F.expr(f"cast(floor({width} / scale) as int)"), "_h": F.expr(f"cast(floor({height} / scale) as int)")})
    c = c.withColumns({"x0": F.expr(f"least(greatest(cast(floor(fx * {width}) as int) - _w div 2, 0), {width} - _w)"), "y0": F.expr(f"least(greatest(cast(floor(fy * {height}) as int) - _h div 2, 0), {height} - _h)")})
    return c.selectExpr(A, "cast(x0 as int) as x0", "cast(y0 as int) as y0", "cast(x0 + _w as int) as x1", "cast(y0 + _h as int) as y1").distinct()


def apply_cuts(assets: DataFrame, cuts: DataFrame, height: str) -> DataFrame:
    """(asset_id, y0, y1): contiguous spans between the distinct inner cuts (asset_id, at) and the edges."""
    ends = assets.filter(F.col(height) > 0).select(A, F.explode(F.array(F.lit(0).cast("long"), F.col(height).cast("long"))).alias("at"))
    inner = cuts.join(assets.select(A, F.col(height).alias("_h")), A).filter("at > 0 and at < _h").select(A, F.col("at").cast("long"))
    return ends.union(inner).distinct().withColumn("y1", F.expr(f"lead(at) over (partition by {A} order by at)")).filter("y1 is not null").select(A, F.col("at").alias("y0"), "y1")


def candidate_positions(assets: DataFrame, detected: DataFrame, height: str, parts: int, offsets: list[int]) -> DataFrame:
    """(asset_id, at, source, confidence): detected positions, and ideal ones with offsets, clamped; detected wins a place."""
    ideal = assets.filter(F.col(height) > parts).withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(parts - 1)))).withColumn("_o", F.explode(F.array(*map(F.lit, offsets))))
    ideal = ideal.selectExpr(A, f"cast(least(greatest({height} * _i div {parts} + _o, 1), {height} - 1) as bigint) as at", "'ideal' as source", "round(0.5D - abs(_o) / 1000D, 6) as confidence")
    every = detected.selectExpr(A, "cast(at as bigint) as at", "'detected' as source", "confidence").unionByName(ideal)
    return every.groupBy(A, "at").agg(F.max_by(F.struct("source", "confidence"), F.struct((F.col("source") == "detected").cast("int"), "confidence")).alias("b")).select(A, "at", "b.*")



def override_cuts(assets: DataFrame, height: str, cuts: str = "cuts", actor: str = "actor", reason: str = "reason", prior: str = "prior_hash") -> DataFrame:
    """(asset_id, y0, y1, actor, reason, provenance, prior_hash, code): the spans of a person's cuts, an array in each asset's row.

    Cuts must lie inside the height and rise, and actor and reason must not be blank; otherwise the asset has one row with
    null spans and the code COORDINATE_INVALID or AUDIT_INVALID, which goes first. No cut gives one span.
    """
    c = F.coalesce(F.col(cuts), F.array().cast("array<bigint>"))
    blank = F.coalesce(F.trim(actor) == "", F.lit(True)) | F.coalesce(F.trim(reason) == "", F.lit(True))
    ends = F.concat(F.array(F.lit(0).cast("bigint")), c, F.array(F.col(height).cast("bigint")))
    rising = F.coalesce(F.forall(F.sequence(F.lit(1), F.size("_e") - 1), lambda i: F.get("_e", i) > F.get("_e", i - 1)), F.lit(False))
    told = assets.withColumn("_e", ends).withColumn("code", F.when(blank, "AUDIT_INVALID").when(~rising, "COORDINATE_INVALID").otherwise("OK"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("_e") - 1), lambda i: F.struct(F.get("_e", i - 1).alias("y0"), F.get("_e", i).alias("y1")))
    spans = told.withColumn("_s", F.explode_outer(F.when(F.col("code") == "OK", pairs)))
    return spans.select(A, "_s.y0", "_s.y1", F.col(actor).alias("actor"), F.col(reason).alias("reason"), F.lit("manual_override").alias("provenance"), F.col(prior).alias("prior_hash"), "code")


def split_count(df: DataFrame, key: str, height: str, ideal: int, most: int) -> DataFrame:
    """(key, parts): floor or floor + 1 of height / ideal, capped, whichever part is nearer to ideal; the smaller on ties."""
    n = df.withColumn("_f", F.expr(f"greatest(1, least({most}, {height} div {ideal}))")).withColumn("_c", F.expr(f"least({most}, _f + 1)"))
    share = lambda p: f"least({height} / {p}, {ideal}) / greatest({height} / {p}, {ideal})"
    return n.select(key, F.expr(f"cast(if({share('_c')} > {share('_f')} + 1e-12, _c, _f) as int)").alias("parts"))


def validate_geometry(df: DataFrame, key: str, box: str, polygon: str | None = None) -> DataFrame:
    """(key, code): a box array that is no four numbers in 0..1 or is degenerate, and a polygon that is no three pairs or more in 0..1."""
    rules = {"SHAPE": f"size({box}) <> 4", "RANGE": f"exists({box}, v -> v < 0 or v > 1)", "DEGENERATE": f"size({box}) = 4 and (get({box}, 2) <= get({box}, 0) or get({box}, 3) <= get({box}, 1))"}
    if polygon:
        rules |= {"POLYGON": f"size({polygon}) < 6 or size({polygon}) % 2 = 1", "POLYGON_RANGE": f"exists({polygon}, v -> v < 0 or v > 1)"}
    codes = ", ".join(f"if({rule}, '{code}', null)" for code, rule in rules.items())
    return df.withColumn("_c", F.expr(f"array_compact(array({codes}))")).select(key, F.explode("_c").alias("code"))


def region_envelope(df: DataFrame, key: str, points: str, box: str | None = None) -> DataFrame:
    """(key, x0, y0, x1, y1) around an array of (x, y) pairs in a row, and the row's own box where it says otherwise; none without either."""
    side = lambda f, k: f"array_{f}(filter({points}, (v, i) -> i % 2 = {k}))"
    around = f"if(size({points}) >= 2, array({side('min', 0)}, {side('min', 1)}, {side('max', 0)}, {side('max', 1)}), null)"
    own = [f"if(size({box}) = 4, {box}, null)"] if box else []
    found = df.select(key, F.explode(F.expr(f"array_distinct(array_compact(array({', '.join([*own, around])})))")).alias("_b"))
    return found.selectExpr(key, *[f"get(_b, {i}) as {c}" for i, c in enumerate(("x0", "y0", "x1", "y1"))])


def cells(df: DataFrame, pixels: str, side: int = 8) -> DataFrame:
    """(asset_id, y, x, value) of a pixel array."""
    return df.select(A, F.posexplode(pixels).alias("_i", "value")).selectExpr(A, f"_i div {side} as y", f"_i % {side} as x", "value")


def grid_row_stats(grid: DataFrame) -> DataFrame:
    """(asset_id, y, mean, variance) of each grid row, with population variance."""
    return grid.groupBy(A, "y").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.var_pop("value"), 6).alias("variance"))


def gutter_score(rows: DataFrame, flat: float = 40.0, bright: tuple[float, float] = (236, 215), dark: tuple[float, float] = (22, 45)) -> DataFrame:
    """rows with score: evenness of a grid row times 1 if it is bright or dark, 0.55 if it is nearly so, else 0.15."""
    extreme = f"case when mean >= {bright[0]} or mean <= {dark[0]} then 1.0D when mean >= {bright[1]} or mean <= {dark[1]} then 0.55D else 0.15D end"
    return rows.withColumn("score", F.expr(f"round(1.0D / (1.0D + variance / {flat}D) * {extreme}, 9)"))


def row_texture(grid: DataFrame) -> DataFrame:
    """(asset_id, y, texture): the mean step between neighbours of a grid row; 0 for a row of one cell."""
    steps = grid.withColumn("_d", F.expr(f"abs(value - lag(value) over (partition by {A}, y order by x))"))
    return steps.groupBy(A, "y").agg(F.coalesce(F.round(F.avg("_d"), 6), F.lit(0.0)).alias("texture"))


def runs_of_rows(rows: DataFrame, label: str) -> DataFrame:
    """(asset_id, band, label, y0, y1): consecutive rows of equal label."""
    return islands(rows, label, "y", A).groupBy(A, F.col("island").alias("band")).agg(F.first(label).alias("label"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"))


# Fixed values of separators: limits of variance and texture, the step of colour that ends a run, the scales of the scores,
# their weights, and the least confidence, edge and context score.
SEPARATOR = {"variance": 90.0, "texture": 10.0, "jump": 8.0, "edge_scale": 180.0, "texture_scale": 35.0, "confidence": 0.7, "edge": 0.22, "context": 0.2}


def separator_candidates(rows: DataFrame, least: int, limits: dict[str, float] | None = None) -> DataFrame:
    """(asset_id, position, confidence, edge_score, context_score, y0, y1): runs of quiet rows (y, mean, variance, texture) that part an asset.

    A row is quiet if variance and texture are low; a run also ends where the mean jumps. Runs shorter than least, at an
    edge of the asset, or below the least scores are none. limits replaces values of SEPARATOR.
    """
    v = SEPARATOR | (limits or {})
    w = f"over (partition by {A} order by y"
    marked = rows.withColumn("_low", F.expr(f"coalesce(variance <= {v['variance']} and texture <= {v['texture']}, false)")).withColumns({
        "_up": F.expr(f"abs(mean - lag(mean) {w}))"), "_down": F.expr(f"abs(mean - lead(mean) {w}))"), "_above": F.expr(f"max(texture) {w} rows between 4 preceding and 1 preceding)"), "_below": F.expr(f"max(texture) {w} rows between 1 following and 4 following)"),
    })
    starts = marked.withColumn("_new", F.expr(f"cast(_low and not coalesce(lag(_low) {w}), false) or _low and _up > {v['jump']} as int)"))
    runs = starts.withColumn("_run", F.expr(f"sum(_new) {w})")).filter("_low").groupBy(A, "_run").agg(
        F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.count("*").alias("_n"), F.avg("variance").alias("_v"), F.min_by("_up", "y").alias("_l"), F.max_by("_down", "y").alias("_r"),
        F.greatest(F.coalesce(F.min_by("_above", "y"), F.lit(0.0)), F.coalesce(F.max_by("_below", "y"), F.lit(0.0))).alias("_t"),
    )
    inner = runs.filter((F.col("_n") >= least) & F.col("_l").isNotNull() & F.col("_r").isNotNull())
    scored = inner.withColumn("_edge", F.expr(f"least(1.0D, (_l + _r) / {v['edge_scale']}D)")).withColumn("_context", F.expr(f"least(1.0D, _edge * 0.55D + _t / {v['texture_scale']}D)"))
    sure = f"round(0.45D * least(1.0D, greatest(0.0D, 1.0D - _v / {v['variance']}D)) + 0.25D * _edge + 0.20D * _context + 0.10D * least(1.0D, _n / {max(1.0, least * 2.0)}D), 6)"
    kept = scored.withColumn("confidence", F.expr(sure)).filter(f"confidence >= {v['confidence']} and _edge >= {v['edge']} and _context >= {v['context']}")
    return kept.selectExpr(A, "cast((y0 + y1) div 2 as int) as position", "confidence", "round(_edge, 3) as edge_score", "round(_context, 3) as context_score", "y0", "y1")


def best_cut(rows: DataFrame, ideals: list[int], radius: int, low: int, high: int, hit: float = 0.35) -> DataFrame:
    """(asset_id, ideal, y, score, hit): near each ideal the row in [low, high) of most score less a penalty of 0.08 at radius.

    The earliest of equals; hit goes by the score alone. Without a row in reach the ideal itself, with no score and no hit.
    """
    wanted = rows.select(A).distinct().withColumn("ideal", F.explode(F.array(*map(F.lit, ideals))))
    near = rows.select(A, "y", "score", F.explode(F.array(*map(F.lit, ideals))).alias("ideal")).filter((F.abs(F.col("y") - F.col("ideal")) <= radius) & (F.col("y") >= low) & (F.col("y") < high))
    near = near.withColumn("_v", F.round(F.col("score") - F.abs(F.col("y") - F.col("ideal")) / max(1, radius) * 0.08, 9))
    best = near.groupBy(A, "ideal").agg(F.max_by(F.struct("y", "score"), F.struct("_v", -F.col("y"))).alias("b"))
    found = wanted.join(best, [A, "ideal"], "left")
    return found.select(A, "ideal", F.coalesce("b.y", "ideal").alias("y"), F.col("b.score").alias("score"), F.coalesce(F.col("b.score") >= hit, F.lit(False)).alias("hit"))


def merge_cells(grid: DataFrame, owner: str) -> DataFrame:
    """(asset_id, owner, x0, x1, y0, y1): cells of one owner merged along rows, then equal spans down columns."""
    flat = grid.withColumn("_k", F.expr(f"x - row_number() over (partition by {A}, {owner}, y order by x)")).groupBy(A, F.col(owner).alias("owner"), "y", "_k").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))
    tall = flat.withColumn("_g", F.expr(f"y - row_number() over (partition by {A}, owner, x0, x1 order by y)"))
    return tall.groupBy(A, "owner", "x0", "x1", "_g").agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1")).drop("_g")


#: Limits of variance, entropy, edge density and texture under which a cell tells little.
LOW_LIMITS = (0.08, 0.20, 0.08, 0.08)


def low_information(df: DataFrame, pixels: str, width: int, height: int, limits: tuple[float, ...] = LOW_LIMITS, need: int = 3) -> DataFrame:
    """(asset_id, low): a flag for each value of a pixel array, true if need of four measures are within limits.

    Of the 3 x 3 values around a cell: squared deviation and entropy over 8 levels; of its four neighbours: the share of
    steps of 12 or more, and the change from one step to four steps away. Beyond the border the border's value counts.
    All are worked out in the row of the asset.
    """
    at = lambda dx, dy: f"get(p, greatest(0, least({height - 1}, i div {width} + ({dy}))) * {width} + greatest(0, least({width - 1}, i % {width} + ({dx}))))"
    sides = [(-1, 0), (1, 0), (0, -1), (0, 1)]
    around = "array(" + ", ".join(f"cast({at(dx, dy)} as double)" for dy in (-1, 0, 1) for dx in (-1, 0, 1)) + ")"
    edges = " + ".join(f"cast(abs({at(dx, dy)} - get(p, i)) >= 12 as int)" for dx, dy in sides)
    texture = " + ".join(f"abs({at(4 * dx, 4 * dy)} - {at(dx, dy)})" for dx, dy in sides)
    cells = f"transform(sequence(0, {width * height - 1}), i -> named_struct('w', {around}, 'e', ({edges}) / 4.0D, 't', least(1.0D, ({texture}) / 1020.0D)))"
    total, squares = "aggregate(c.w, 0.0D, (s, v) -> s + v)", "aggregate(c.w, 0.0D, (s, v) -> s + v * v)"
    spread = f"least(1.0D, ({squares} - {total} * {total} / 9.0D) / 16256.25D)"
    counts = "transform(sequence(0, 7), b -> size(filter(c.w, v -> least(7, cast(floor(v / 32) as int)) = b)) / 9.0D)"
    entropy = f"least(1.0D, aggregate({counts}, 0.0D, (s, p) -> s - if(p > 0, p * log2(p), 0.0D)) / 3.0D)"
    passed = " + ".join(f"cast({m} <= {limit}D as int)" for m, limit in zip((spread, entropy, "c.e", "c.t"), limits))
    measured = f"transform(_c, c -> {passed} >= {need})"
    return df.select(A, F.expr(f"get(transform(array({pixels}), p -> {measured.replace('_c,', cells + ',', 1)}), 0)").alias("low"))


def visual_score(df: DataFrame, key: str, features: str, gains: list[float], penalties: list[float]) -> DataFrame:
    """(key, score): weighted features less weighted penalties, 0 at least."""
    weights = ", ".join(f"{w}D" for w in [*gains, *(-p for p in penalties)])
    return df.select(key, F.expr(f"round(greatest(0.0D, aggregate(zip_with(slice({features}, 1, {len(gains) + len(penalties)}), array({weights}), (x, w) -> x * w), 0.0D, (s, x) -> s + x)), 6)").alias("score"))


def mean_bit_signature(df: DataFrame, key: str, pixels: str) -> DataFrame:
    """(key, signature): a bit for each value, 1 from the mean on."""
    mean = F.expr(f"aggregate({pixels}, 0.0D, (s, x) -> s + x) / size({pixels})")
    return df.withColumn("_m", mean).select(key, F.expr(f"array_join(transform({pixels}, x -> if(x >= _m, '1', '0')), '')").alias("signature"))


def focal_cells(grid: DataFrame, top: int = 3) -> DataFrame:
    """(asset_id, cell, energy, place): the top cells of a 3 x 3 grid by mean value; the first on ties."""
    e = grid.selectExpr(A, "least(y div 3, 2) * 3 + least(x div 3, 2) as cell", "value").groupBy(A, "cell").agg(F.round(F.avg("value"), 6).alias("energy"))
    return e.withColumn("place", F.expr(f"row_number() over (partition by {A} order by energy desc, cell)")).filter(F.col("place") <= top)


def rank_regions(regions: DataFrame, priority: dict[str, int]) -> DataFrame:
    """(asset_id, kind, region, place): the surest region of each kind, in the order of priority."""
    first = regions.groupBy(A, "kind").agg(F.max_by("region", F.struct("confidence", -F.col("region"))).alias("region"))
    ranks = F.coalesce(*[F.when(F.col("kind") == k, p) for k, p in priority.items()], F.lit(99))
    return first.withColumn("_p", ranks).withColumn("place", F.expr(f"row_number() over (partition by {A} order by _p, kind)")).drop("_p")
