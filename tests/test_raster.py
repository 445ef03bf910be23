"""Pixel functions on drawn images."""

import numpy as np
import pytest

from leafmill.functions import raster as R


def canvas(w=400, h=300):
    return np.full((h, w, 3), 255, np.uint8)


def line(image, x1, y1, x2, y2, color=(0, 0, 0), width=2):
    n = int(max(abs(x2 - x1), abs(y2 - y1))) * 2 + 1
    for x, y in zip(np.linspace(x1, x2, n), np.linspace(y1, y2, n), strict=True):
        xi, yi = int(round(x)), int(round(y))
        image[max(0, yi) : yi + width, max(0, xi) : xi + width] = color
    return image


def depth(y):
    return y / 300 * 30


def boundaries(diagonals=(), horizontals=(), verticals=()):
    image = canvas()
    for d in diagonals:
        line(image, *d)
    for y in horizontals:
        line(image, 0, y, 399, y, width=1)
    for x in verticals:
        line(image, x, 0, x, 299, width=1)
    return R.zone_boundaries(image, depth)


def test_zone_boundaries():
    assert len(boundaries([(50, 250, 350, 50), (60, 270, 320, 230)])) >= 2
    assert len(boundaries([(30, 260, 370, 60)], horizontals=[50, 100, 150, 200, 250])) == 1
    assert len(boundaries([(40, 250, 340, 80)], verticals=[80, 160, 240, 320])) == 1
    assert boundaries() == []
    assert len(boundaries([(20, 280, 380, 40), (150, 155, 180, 145), (200, 130, 215, 120)])) == 1
    two = boundaries([(50, 250, 350, 200), (50, 80, 350, 30)])
    assert [i["class"] for i in two] == [1, 2] and two[0]["start_depth"] <= two[1]["start_depth"]


def test_regions_and_runs():
    mask = np.zeros((10, 12), bool)
    mask[1:4, 1:4] = mask[4, 4] = mask[7, 2:11] = True
    found = sorted(R.regions(mask), key=lambda r: r["area"])
    assert [(r["box"], r["area"]) for r in found] == [((2, 7, 11, 8), 9), ((1, 1, 5, 5), 10)]
    assert R.long_runs(mask, 5, 1).sum() == 9 and R.long_runs(mask, 3, 0).sum() == 9
    assert R.grow(mask[:, :6], 1).shape == (10, 6)


def test_skew():
    image = canvas(500, 300)
    for y in range(40, 260, 20):
        line(image, 30, y, 470, y + 440 * np.tan(np.radians(2.0)))
    assert R.skew(image) == pytest.approx(2.0, abs=0.5) and R.skew(canvas()) == 0.0


def test_panels_and_structures():
    image = canvas(600, 300)
    for x0 in (20, 320):
        for a in ((x0, 40, x0 + 250, 40), (x0, 260, x0 + 250, 260), (x0, 40, x0, 260), (x0 + 250, 40, x0 + 250, 260)):
            line(image, *a)
    found = R.panels(image)
    assert [(p["panel_id"], p["y_max"]) for p in found] == [("a", 28.0), ("b", 30.0)]
    assert len(R.structures(image)) == 2 and R.structures(canvas()) == []
    image[100:106, 100:106] = image[150:156, 200:206] = 0
    assert len(R.marks(image[40:260, 20:270])) == 2


def test_colors_and_intervals():
    image = canvas(300, 300)
    for x in (90, 150, 210):
        line(image, x, 70 + x // 10, x, 220, (220, 20, 20), 4)
    image[60:240, 100:140] = (30, 60, 220)
    assert {"red", "blue"} <= set(R.colors(image, [(0, 0, 300, 300)]))
    bars = R.vertical_intervals(R.color_mask(image, "red"), depth)
    assert [b["class"] for b in bars] == [0, 1, 2] and bars[0]["end_depth"] == pytest.approx(22.4, abs=0.3)
    assert R.colors(canvas(), [(0, 0, 5, 5)]) == ["red"]
    assert [R.color_name(h, 100, 100) for h in (0, 12.5, 30, 90, 164, 175)] == ["red", "red", "yellow", "cyan", "magenta", "red"]


def test_ruled_tables():
    image = canvas(400, 200)
    for y in (20, 80, 140):
        line(image, 20, y, 380, y)
    for x, top in ((20, 20), (140, 80), (260, 20), (380, 20)):
        line(image, x, top, x, 140)
    (table,) = R.ruled_tables(image)
    assert len(table["rows"]) == 3 and len(table["cols"]) == 4
    assert table["merged"] == [{"row": 0, "col": 0, "rowspan": 1, "colspan": 2}]


def test_zone_digits():
    read = [(3, 10.0, 10.0, 60.0), (8, 20.0, 12.0, 90.0), (5, 100.0, 50.0, 40.0), (4, 100.0, 80.0, 70.0), (4, 200.0, 150.0, 55.0)]
    assert R.zone_digits(read) == {8: (20.0, 12.0), 4: (200.0, 150.0)}


def test_gaps():
    profile = np.array([0, 0, 5, 5, 0, 5, 0, 0, 0])
    assert R.gaps(profile, 0, 2) == [(0, 2), (4, 9)] or R.gaps(profile, 0, 2) == [(0, 2), (6, 9)]
    assert R.between([(0, 2), (6, 9)], 9) == [(2, 6)]
