"""Where a panel is blank, and which crops of it the framing contract allows.

Pixel grids are arrays of rows one after the other; boxes of crops are half-open integers in source pixels, boxes of regions
are shares of the source from 0 to 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.operators.geometry import A

#: The least share of each kind of protected region that a crop keeps, in the order in which they are judged,
#: and the ones of a lenient review.
MINIMA = {"subject": 0.98, "face": 0.98, "action": 0.95, "continuity_context": 0.95, "effect": 0.90}
REVIEW_MINIMA = {"subject": 0.40, "face": 0.60, "action": 0.45, "continuity_context": 0.35, "effect": 0.40}
#: Fixed value: how far the target may be larger than the crop.
UPSCALE = 1.15
TINY = 1e-9


def blank_reject(df: DataFrame, pixels: str, width: int, height: int, light: int = 245, dark: int = 10, step: int = 35) -> DataFrame:
    """(asset_id, blank, edges, content, rejected) of pixel arrays of 0 to 255.

    blank is the share of light or dark pixels. edges is the share of pixels over step after a 3 x 3 filter: 8 times the
    pixel less its 8 neighbours, cut to 0..255; pixels of the border stay as they are. An array is rejected if it is nearly all
    blank, or blank and almost without edges; null or short arrays have null shares and are not judged.
    """
    px, n = F.col(pixels), width * height
    at = lambda i: F.get(px, i)
    row, column = lambda i: F.floor(i / width), lambda i: i % width

    def edge(i: Column) -> Column:
        around = sum((at((i + (dy * width + dx)).cast("int")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)), F.lit(0))
        border = (row(i) == 0) | (row(i) == height - 1) | (column(i) == 0) | (column(i) == width - 1)
        return F.when(border, at(i)).otherwise(F.greatest(F.lit(0), F.least(F.lit(255), 9 * at(i) - around)))

    share = lambda a: F.round(F.size(a) / F.lit(n), 6)
    whole = F.size(px) == n
    strong = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: edge(i) > step)
    told = df.select(A, F.when(whole, share(F.filter(px, lambda v: (v >= light) | (v <= dark)))).alias("blank"), F.when(whole, share(strong)).alias("edges"))
    return told.select(A, "blank", "edges", F.round(1 - F.col("blank"), 6).alias("content"), F.expr("blank >= 0.94 or (edges < 0.008 and blank >= 0.82)").alias("rejected"))


def _bounds(cells: int, source: int) -> np.ndarray:
    """Where the cells of a side begin in source pixels, and where the last one ends."""
    return np.arange(cells + 1, dtype=np.int64) * source // cells


def protected_cells(assets: DataFrame, regions: DataFrame, across: int, down: int, width: str = "width", height: str = "height") -> DataFrame:
    """assets with protected, a flag for each cell: whether it meets the box (x0, y0, x1, y1) of a region of the asset.

    Sides that only touch do not meet. Regions without a box protect nothing. Each box is turned to the cells that it meets,
    and the cells of an asset, across * down at most, are gathered.
    """
    span = lambda i, side, cells: (F.floor(i * F.col(side) / cells), F.floor((i + 1) * F.col(side) / cells))

    def met(cells: int, side: str, low: str, high: str) -> Column:
        inside = lambda i: (span(i, side, cells)[1] > F.col(low) * F.col(side)) & (span(i, side, cells)[0] < F.col(high) * F.col(side))
        return F.filter(F.sequence(F.lit(0), F.lit(cells - 1)), inside)

    boxes = regions.filter("x0 is not null").select(A, "x0", "y0", "x1", "y1").join(assets.select(A, width, height), A)
    hit = boxes.select(A, met(across, width, "x0", "x1").alias("_x"), F.explode(met(down, height, "y0", "y1")).alias("_y"))
    found = hit.select(A, F.explode(F.transform("_x", lambda x: F.col("_y") * across + x)).alias("_i")).groupBy(A).agg(F.collect_set("_i").alias("_hit"))
    flags = F.transform(F.sequence(F.lit(0), F.lit(across * down - 1)), lambda i: F.coalesce(F.array_contains("_hit", i), F.lit(False)))
    return assets.join(found, A, "left").withColumn("protected", flags).drop("_hit")


def reached_cells(free: np.ndarray) -> np.ndarray:
    """Of flags (assets, rows, columns) those that hang together with the border of their asset, by steps to 8 neighbours.

    Labels of joined cells: each pair of free neighbours takes the smaller root, roots are followed to their end, until no
    pair differs; the border is one more cell, the smallest. Rounds grow with the logarithm of a region's size.
    """
    n, down, across = free.shape
    cell = np.arange(1, free.size + 1).reshape(free.shape)
    edge = np.ones((down, across), bool)
    edge[1:-1, 1:-1] = False
    pairs = [(np.zeros((free & edge).sum(), np.int64), cell[free & edge])]
    for here, then in (((slice(None), slice(None, -1)), (slice(None), slice(1, None))), ((slice(None, -1), slice(None)), (slice(1, None), slice(None))), ((slice(None, -1), slice(None, -1)), (slice(1, None), slice(1, None))), ((slice(None, -1), slice(1, None)), (slice(1, None), slice(None, -1)))):
        both = free[:, *here] & free[:, *then]
        pairs.append((cell[:, *here][both], cell[:, *then][both]))
    a, b = (np.concatenate(side) for side in zip(*pairs))
    root = np.arange(free.size + 1)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return (root[cell] == 0) & free
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (further := root[root])).any():
            root = further


def border_reach(df: DataFrame, across: int, down: int, low: str = "low", protected: str | None = None, width: str | None = None, height: str | None = None) -> DataFrame:
    """(asset_id, reached, share, held_share, retained, mask) of grids of flags.

    Low cells that are not protected and hang together with the border are reached; mask has a flag for each cell. share is
    theirs of the source's area, held_share that of low cells that are not reached, retained that of protected area which is
    not reached, 1 without any. A cell's area follows the source's width and height (columns; the grid's own if not given), as
    its sides are cut to whole pixels. Null flags are false; an asset without flags has no cell that is low.
    """
    columns = {"_low": F.col(low), "_safe": F.col(protected) if protected else F.lit(None).cast("array<boolean>"), "_w": F.col(width).cast("long") if width else F.lit(across).cast("long"), "_h": F.col(height).cast("long") if height else F.lit(down).cast("long")}

    def flags(values: pd.Series) -> np.ndarray:
        out = np.zeros((len(values), down, across), bool)
        for i, v in enumerate(values):
            if v is not None and len(v) == down * across:
                out[i] = np.array([bool(x) for x in v]).reshape(down, across)
        return out

    def flood(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            low, safe = flags(batch["_low"]), flags(batch["_safe"])
            reached = reached_cells(low & ~safe)
            areas = np.stack([np.outer(np.diff(_bounds(down, h)), np.diff(_bounds(across, w))) for w, h in zip(batch["_w"], batch["_h"])])
            of = lambda mask: (mask * areas).sum(axis=(1, 2))
            whole, all_safe = of(np.ones_like(low)), of(safe)
            yield pd.DataFrame({
                A: batch[A], "reached": reached.sum(axis=(1, 2)), "share": np.round(of(reached) / whole, 6), "held_share": np.round(of(low & ~reached) / whole, 6),
                "retained": np.round(np.where(all_safe, of(safe & ~reached) / np.maximum(all_safe, 1), 1.0), 6), "mask": list(reached.reshape(len(low), -1)),
            })

    kind = df.schema[A].dataType.simpleString()
    return df.select(A, *[c.alias(n) for n, c in columns.items()]).mapInPandas(flood, f"{A} {kind}, reached long, share double, held_share double, retained double, mask array<boolean>")


def mask_share(mask: np.ndarray, width: int, height: int, boxes: np.ndarray) -> np.ndarray:
    """The share of each box (x0, y0, x1, y1) in source pixels that lies in cells of the mask.

    A summed-area table over the cells, read at the four corners of a box; inside a cell the table rises evenly, so that a
    corner's value is found between those of its cell, exactly and in whole numbers.
    """
    down, across = mask.shape
    xs, ys = _bounds(across, width), _bounds(down, height)
    table = np.zeros((down + 1, across + 1), np.int64)
    table[1:, 1:] = (mask * np.outer(np.diff(ys), np.diff(xs))).cumsum(0).cumsum(1)

    def upto(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x, y = np.clip(x, 0, width), np.clip(y, 0, height)
        i, j = (np.clip(np.searchsorted(s, v, "right") - 1, 0, len(s) - 2) for s, v in ((xs, x), (ys, y)))
        right, lower, both = table[j, i + 1] - table[j, i], table[j + 1, i] - table[j, i], table[j + 1, i + 1] - table[j, i + 1] - table[j + 1, i] + table[j, i]
        fx, wide, fy, tall = x - xs[i], xs[i + 1] - xs[i], y - ys[j], ys[j + 1] - ys[j]
        return table[j, i] + right * fx // wide + lower * fy // tall + both * fx * fy // (wide * tall)

    x0, y0, x1, y1 = boxes.T
    inside = upto(x1, y1) - upto(x0, y1) - upto(x1, y0) + upto(x0, y0)
    return np.round(inside / np.maximum(1, (x1 - x0) * (y1 - y0)), 6)


def crop_blank(crops: DataFrame, masks: DataFrame, across: int, down: int, width: str = "width", height: str = "height") -> DataFrame:
    """crops (asset_id, crop, x0, y0, x1, y1) with blank, the share of the crop in cells of its asset's mask; null without one.

    masks has asset_id, mask, and the source's width and height. An asset's crops, of which there are as many as positions
    and scales are tried, are gathered, so that its table is built once.
    """
    box = ["x0", "y0", "x1", "y1"]
    together = crops.groupBy(A).agg(F.collect_list(F.struct("crop", *box)).alias("_crops"))
    joined = together.join(masks.select(A, "mask", F.col(width).cast("long").alias("_w"), F.col(height).cast("long").alias("_h")), A, "left")

    def looked_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for asset, mask, w, h, own in zip(batch[A], batch["mask"], batch["_w"], batch["_h"], batch["_crops"]):
                boxes = np.array([[c[k] for k in box] for c in own], np.int64)
                shares = [None] * len(own) if mask is None else mask_share(np.array(mask, bool).reshape(down, across), int(w), int(h), boxes)
                out += [(asset, c["crop"], s) for c, s in zip(own, shares)]
            yield pd.DataFrame(out, columns=[A, "crop", "blank"])

    kinds = {c: crops.schema[c].dataType.simpleString() for c in (A, "crop")}
    return crops.join(joined.mapInPandas(looked_up, f"{A} {kinds[A]}, crop {kinds['crop']}, blank double"), [A, "crop"])


def _overlap(box: tuple[str, ...], crop: tuple[str, ...]) -> str:
    (a0, b0, a1, b1), (c0, d0, c1, d1) = box, crop
    return f"greatest(0.0D, least({a1}, {c1}) - greatest({a0}, {c0})) * greatest(0.0D, least({b1}, {d1}) - greatest({b0}, {d0}))"


def _needed(centre: str, low: str, high: str, required: str) -> str:
    """The least side of a crop around centre that keeps a required share of a span."""
    kept = f"({high} - {low}) * least(1.0D, greatest(0.0D, {required}))"
    return f"if({high} <= {low}, 1.0D, least(1.0D, greatest(0.0D, 2.0D * greatest({centre} - ({high} - {kept}), {low} + {kept} - {centre}))))"


def crop_contract(crops: DataFrame, assets: DataFrame, regions: DataFrame, balloons: DataFrame, target: tuple[int, int], blank: float | None = None, low_resolution: bool = False, review: bool = False) -> DataFrame:
    """crops with what the framing contract measures, and reject, the code of its first broken rule, null for a feasible crop.

    crops: asset_id, crop, box in source pixels, blank (its share of border blank, see crop_blank). assets: asset_id, width,
    height. regions: asset_id, kind, box in shares (null: it is nowhere, and counts as lost), minimum, the least share to be
    kept (or null). balloons: asset_id and box, all of whose geometry counts. In this order: the crop lies in its source and has
    its blank share; no balloon in it; it is large enough for the target (with low_resolution or review a note instead); its
    blank share is within blank (if given); each kind of region is kept; it is not zoomed beyond what the regions allow
    (not judged under review, nor with low_resolution where no region asks for anything). Coverage is the least share of
    a region of the kind, 1 without any. Only regions of the crop's own asset meet it.
    """
    if blank is not None and not 0 <= blank <= 1:
        raise ValueError("visual.framing_contract_incompatible")
    tw, th = target
    sized = crops.join(assets.select(A, F.col("width").alias("_sw"), F.col("height").alias("_sh")), A, "left").withColumns({"_cw": F.expr("x1 - x0"), "_ch": F.expr("y1 - y0")})
    wide = f"_sw / _sh > {tw / th!r}D"
    sized = sized.withColumns({"_bw": F.expr(f"if({wide}, greatest(2, bround(_sh * {tw / th!r}D)), _sw)"), "_bh": F.expr(f"if({wide}, _sh, greatest(2, bround(_sw / {tw / th!r}D)))")})
    sized = sized.withColumns({
        "_inside": F.expr("coalesce(x0 >= 0 and y0 >= 0 and x1 <= _sw and y1 <= _sh and _cw > 0 and _ch > 0, false)"),
        "_cap": F.expr(f"least(_sw / {max(1.0, tw / UPSCALE)!r}D, _sh / {max(1.0, th / UPSCALE)!r}D)"), "_zoom": F.expr("greatest(try_divide(_bw, _cw), try_divide(_bh, _ch))"),
        "_n0": F.expr("x0 / _sw"), "_n1": F.expr("y0 / _sh"), "_n2": F.expr("x1 / _sw"), "_n3": F.expr("y1 / _sh"),
    })
    own, crop = ("_r0", "_r1", "_r2", "_r3"), ("_n0", "_n1", "_n2", "_n3")
    box = [F.col(c).cast("double").alias(n) for c, n in zip(("x0", "y0", "x1", "y1"), own)]
    minimum = F.col("minimum").cast("double") if "minimum" in regions.columns else F.lit(0.0)
    least_of = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in MINIMA.items()], F.lit(0.0))
    protected = regions.select(A, F.col("kind").alias("_kind"), *box, F.greatest(F.coalesce(minimum, F.lit(0.0)), least_of).alias("_asked"))
    met = sized.select(A, "crop", "_sw", "_sh", "_bw", "_bh", *crop).join(protected, A).withColumns({
        "_in": F.expr(_overlap(own, crop)), "_area": F.expr("greatest(0.0D, _r2 - _r0) * greatest(0.0D, _r3 - _r1)"),
        "_fx": F.expr(_needed("(_n0 + _n2) / 2", "_r0", "_r2", "_asked")), "_fy": F.expr(_needed("(_n1 + _n3) / 2", "_r1", "_r3", "_asked")),
    })
    kept = "if(_r0 is null or _area = 0, 0.0D, _in / _area)"
    asks = "_asked > 0 and _r0 is not null"
    told = met.groupBy(A, "crop").agg(
        *[F.min(F.expr(f"if(_kind = '{k}', {kept}, null)")).alias(k) for k in MINIMA],
        F.expr("try_divide(sum(_in), sum(_area))").alias("retained"),
        F.least(F.min(F.expr(f"if({asks} and _fx > 0, _bw / (_sw * _fx), null)")), F.min(F.expr(f"if({asks} and _fy > 0, _bh / (_sh * _fy), null)"))).alias("_allowed"),
        F.bool_or(F.expr("_asked > 0")).alias("_any"),
    )
    spoken = sized.select(A, "crop", *crop).join(balloons.select(A, *box), A).groupBy(A, "crop").agg(F.least(F.lit(1.0), F.sum(F.expr(_overlap(own, crop))) / F.max(F.expr("(_n2 - _n0) * (_n3 - _n1)"))).alias("balloon"))
    judged = sized.join(told, [A, "crop"], "left").join(spoken, [A, "crop"], "left").fillna(1.0, [*MINIMA, "retained"]).fillna(0.0, ["balloon"])
    judged = judged.withColumns({"_allowed": F.expr("round(greatest(0.0D, least(_cap, coalesce(_allowed, _cap))), 6)"), "_any": F.coalesce("_any", F.lit(False))})
    judged = judged.withColumn("_small", F.expr(f"_zoom > _cap + {TINY!r}D or _cw < {tw / UPSCALE!r}D or _ch < {th / UPSCALE!r}D"))
    rules = [
        (~F.col("_inside") | F.col("blank").isNull(), "visual.panel_lineage_unavailable"),
        (F.col("balloon") > 0, "visual.balloon_mask_overlap"),
        (F.col("_small") if not (low_resolution or review) else F.lit(False), "visual.source_resolution_insufficient"),
        (F.col("blank") > blank + TINY if blank is not None else F.lit(False), "visual.blank_infeasible"),
        *[(F.col(k) < v, f"visual.protected_{k}_coverage") for k, v in (REVIEW_MINIMA if review else MINIMA).items()],
        ((F.col("_zoom") > F.col("_allowed") + TINY) & (F.col("_any") if low_resolution else F.lit(True)) if not review else F.lit(False), "visual.protected_zoom_insufficient"),
    ]
    reject = F.coalesce(*[F.when(rule, code) for rule, code in rules])
    note = F.when(F.col("_inside") & (F.col("balloon") <= 0) & F.col("_small") & F.lit(low_resolution or review), "review.low_source_resolution")
    six = lambda c, name: F.round(c, 6).alias(name)
    return judged.select(
        *crops.columns, six("_zoom", "base_zoom"), six("_cap", "source_cap"), F.col("_allowed").alias("protected_cap"), six("retained", "retained"), six("balloon", "balloon"),
        *[six(k, k) for k in MINIMA], F.when(reject == "visual.blank_infeasible", "visual.blank_infeasible").otherwise(note).alias("note"), reject.alias("reject"),
    )


def feasible_ledger(judged: DataFrame, order: str) -> DataFrame:
    """(asset_id, feasible, first_crop, and its strengths) of the assets with a crop that crop_contract does not reject.

    judged is crop_contract's result; the first crop is the one of the least order, then of the least name.
    """
    strengths = ["retained", "subject", "face", "action", "effect", "continuity_context", "blank", "base_zoom"]
    ok = judged.filter("reject is null")
    first = F.min_by(F.struct(F.col("crop").alias("first_crop"), *strengths), F.struct(order, "crop")).alias("_f")
    return ok.groupBy(A).agg(F.count("*").alias("feasible"), first).select(A, "feasible", "_f.*")
