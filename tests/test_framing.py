"""Blank panels, border masks and the crop contract, by hand and against plain loops."""

import random

import numpy as np
import pytest

from proofline.operators import framing as M


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_edges_of_the_filter(spark):
    """A 4 x 4 picture, dark but for one pixel inside: its filter is 8 * 20 = 160 there, 0 (cut) around; the border stays."""
    one = [0, 0, 0, 0, 0, 20, 0, 0, 0, 0, 0, 0, 0, 0, 0, 40]
    # inside (1,1) 160 > 35; (2,1), (1,2) below 0; (2,2) = 9 * 0 - 60 below 0; the border's 40 stays and is over 35
    light = [250] * 16
    flat = [128] * 16
    df = spark.createDataFrame([(1, one), (2, light), (3, flat), (4, None), (5, [1, 2])], "asset_id int, px array<int>")
    assert got(M.blank_reject(df, "px", 4, 4), "asset_id", "blank", "edges", "rejected") == [(1, 0.875, 0.125, False), (2, 1.0, 0.75, True), (3, 0.0, 0.75, False), (4, None, None, None), (5, None, None, None)]
    blank = [5] * 85 + [11] * 15  # 0.85 blank and steps of 6, of which 5 come together at most: the second rule
    assert got(M.blank_reject(spark.createDataFrame([(1, blank)], "asset_id int, px array<int>"), "px", 10, 10), "blank", "edges", "rejected") == [(0.85, 0.0, True)]


def flood(free):
    down, across = len(free), len(free[0])
    todo = [(y, x) for y in range(down) for x in range(across) if free[y][x] and (y in (0, down - 1) or x in (0, across - 1))]
    seen = set(todo)
    while todo:
        y, x = todo.pop()
        for b in range(max(0, y - 1), min(down, y + 2)):
            for a in range(max(0, x - 1), min(across, x + 2)):
                if free[b][a] and (b, a) not in seen:
                    seen.add((b, a))
                    todo.append((b, a))
    return seen


def test_reached_cells_are_those_of_a_flood():
    rng = random.Random(5)
    for down, across in ((1, 1), (1, 6), (7, 5), (12, 12), (30, 40)):
        for share in (0.2, 0.45, 0.7):
            free = np.array([[[rng.random() < share for _ in range(across)] for _ in range(down)] for _ in range(3)])
            for i, found in enumerate(M.reached_cells(free)):
                assert {tuple(map(int, p)) for p in np.argwhere(found)} == flood(free[i].tolist())
    snake = np.zeros((1, 41, 41), bool)
    snake[0, 1::2, 1:40] = True
    snake[0, 2::4, 39] = snake[0, 4::4, 1] = snake[0, 0, 1] = True
    snake[0, 40] = False
    assert M.reached_cells(snake).sum() == snake.sum()


def test_protected_cells_stop_the_border(spark):
    """3 x 3 cells over 7 x 4 pixels: columns 2, 2 and 3 pixels wide (0, 2, 4, 7), rows 1, 1 and 2 high (0, 1, 2, 4)."""
    regions = spark.createDataFrame([(1, 0.0, 0.25, 0.30, 0.5), (1, None, None, None, None), (9, 0.0, 0.0, 1.0, 1.0)], "asset_id int, x0 double, y0 double, x1 double, y1 double")
    assets = spark.createDataFrame([(1, 7, 4, [True] * 3 + [True, True, False] + [False] * 3), (2, 7, 4, [False] * 4 + [True] + [False] * 4), (3, 7, 4, None)], "asset_id int, width int, height int, low array<boolean>")
    safe = M.protected_cells(assets, regions, 3, 3)
    # the box takes pixels 0 to 2.1 across and the second row, and so meets two of its cells
    assert got(safe, "asset_id", "protected") == [(1, [False] * 3 + [True, True, False] + [False] * 3), (2, [False] * 9), (3, [False] * 9)]
    found = M.border_reach(safe, 3, 3, "low", "protected", "width", "height")
    assert got(found, "asset_id", "reached", "share", "held_share", "retained") == [(1, 3, 0.25, round(4 / 28, 6), 1.0), (2, 0, 0.0, round(2 / 28, 6), 1.0), (3, 0, 0.0, 0.0, 1.0)]
    plain = M.border_reach(safe, 3, 3)
    assert got(plain, "asset_id", "reached", "share") == [(1, 5, round(5 / 9, 6)), (2, 0, 0.0), (3, 0, 0.0)]


def test_blank_share_by_the_table():
    rng = random.Random(1)
    for down, across, height, width in ((3, 3, 4, 7), (8, 8, 512, 512), (5, 9, 23, 31)):
        mask = np.array([[rng.random() < 0.5 for _ in range(across)] for _ in range(down)])
        pixels = np.zeros((height, width), int)
        for y in range(down):
            for x in range(across):
                pixels[y * height // down : (y + 1) * height // down, x * width // across : (x + 1) * width // across] = mask[y, x]
        boxes = np.array([(a, b, rng.randint(a + 1, width), rng.randint(b + 1, height)) for a, b in ((rng.randint(0, width - 1), rng.randint(0, height - 1)) for _ in range(40))])
        want = [round(float(pixels[b:d, a:c].sum() / ((c - a) * (d - b))), 6) for a, b, c, d in boxes]
        assert list(M.mask_share(mask, width, height, boxes)) == want


CROPS = "asset_id int, crop string, x0 int, y0 int, x1 int, y1 int, blank double"
REGIONS = "asset_id int, kind string, x0 double, y0 double, x1 double, y1 double, minimum double"


def contract(spark, crops, regions=(), balloons=(), **options):
    assets = spark.createDataFrame([(1, 1000, 2000)], "asset_id int, width int, height int")
    found = M.crop_contract(
        spark.createDataFrame([(1, str(i), *c) for i, c in enumerate(crops)], CROPS), assets, spark.createDataFrame(list(regions), REGIONS),
        spark.createDataFrame(list(balloons), "asset_id int, x0 double, y0 double, x1 double, y1 double"), (540, 960), **options,
    )
    return sorted(found.collect(), key=lambda r: r.crop)


def test_rules_in_their_order(spark):
    """A source of 1000 x 2000 for 540 x 960: base 1000 x 1778, cap min(1000 / 469.57, 2000 / 834.78) = 2.129630."""
    whole, half, small, outside = (0, 0, 1000, 1778, 0.1), (250, 400, 750, 1289, 0.1), (0, 0, 460, 818, 0.1), (600, 0, 1100, 889, 0.1)
    rows = contract(spark, [whole, half, small, outside, (0, 0, 1000, 1778, 0.5)], blank=0.3)
    assert [r.reject for r in rows] == [None, None, "visual.source_resolution_insufficient", "visual.panel_lineage_unavailable", "visual.blank_infeasible"]
    assert [(r.base_zoom, r.source_cap) for r in rows[:3]] == [(1.0, 2.12963), (2.0, 2.12963), (2.173913, 2.12963)]
    assert rows[4].note == "visual.blank_infeasible" and rows[0].note is None
    noted = contract(spark, [small], low_resolution=True)[0]
    assert (noted.reject, noted.note) == (None, "review.low_source_resolution")
    spoken = contract(spark, [half, small], balloons=[(1, 0.0, 0.0, 0.3, 0.3)], blank=0.3)  # both meet it, the crop of half by 50 x 200 pixels
    assert [r.reject for r in spoken] == ["visual.balloon_mask_overlap"] * 2 and spoken[0].balloon == round(50 * 200 / (500 * 889), 6)
    with pytest.raises(ValueError):
        contract(spark, [whole], blank=1.5)


def test_coverage_and_zoom_of_protected_regions(spark):
    half = (250, 400, 750, 1289, 0.0)
    face = (1, "face", 0.30, 0.25, 0.50, 0.50, None)
    # all of it inside; around the centre (0.5, 0.42225) 98 % of 0.3..0.5 needs a side of 2 * 0.196, of 0.25..0.5 one of 2 * 0.16725
    row = contract(spark, [half], [face])[0]
    assert (row.reject, row.face, row.retained, row.protected_cap) == (None, 1.0, 1.0, 2.12963)
    # a region at the crop's left side: 0.25 + 0.2 * 0.02 = 0.254 must be in, 2 * 0.246 = 0.492 wide: a cap of 1 / 0.492
    row = contract(spark, [half], [(1, "face", 0.25, 0.4, 0.45, 0.5, None)])[0]
    assert (row.protected_cap, row.reject) == (round(1 / 0.492, 6), None)
    row = contract(spark, [half], [(1, "effect", 0.25, 0.4, 0.45, 0.5, 1.0)])[0]
    assert (row.protected_cap, row.reject) == (2.0, None)
    row = contract(spark, [(251, 400, 751, 1289, 0.0)], [(1, "effect", 0.251, 0.4, 0.9, 0.5, 0.9)])[0]
    assert row.effect == round(500 / 649, 6) and row.reject == "visual.protected_effect_coverage"
    # an unknown kind with a minimum has no coverage rule, but holds the zoom: half of 0..0.4 asks for 0.2..0.4, 2 * 0.3 wide
    other = (1, "sign", 0.0, 0.4, 0.4, 0.5, 0.5)
    assert [(r.reject, r.protected_cap) for r in contract(spark, [half], [other])] == [("visual.protected_zoom_insufficient", round(1 / 0.6, 6))]
    assert [r.reject for r in contract(spark, [half], [other], low_resolution=True)] == ["visual.protected_zoom_insufficient"]
    assert [r.reject for r in contract(spark, [half], [other], review=True)] == [None]
    # kinds are judged in a fixed order, and a region without a box is lost
    lost = [(1, "effect", None, None, None, None, None), (1, "action", 0.0, 0.0, 0.1, 0.1, None), (1, "subject", 0.2, 0.3, 0.7, 0.5, None)]
    assert contract(spark, [half], lost)[0].reject == "visual.protected_subject_coverage"
    assert contract(spark, [half], lost[:2])[0].reject == "visual.protected_action_coverage"
    assert contract(spark, [half], lost[:1])[0].reject == "visual.protected_effect_coverage"
    seen = contract(spark, [half], [(1, "subject", 0.2, 0.3, 0.6, 0.5, None)], review=True)[0]
    assert (seen.subject, seen.reject) == (0.875, None)
    assert contract(spark, [half], [(2, "face", 0.0, 0.0, 0.1, 0.1, None)])[0].reject is None  # of another asset


def test_ledger_of_feasible_crops(spark):
    judged = spark.createDataFrame([(1, "b", 2, None), (1, "a", 2, None), (1, "c", 1, "x"), (2, "a", 1, "x")], "asset_id int, crop string, place int, reject string")
    for name in ("retained", "subject", "face", "action", "effect", "continuity_context", "blank", "base_zoom"):
        judged = judged.selectExpr("*", f"if(crop = 'a', 0.5D, 0.1D) as {name}")
    assert got(M.feasible_ledger(judged, "place"), "asset_id", "feasible", "first_crop", "face") == [(1, 2, "a", 0.5)]
