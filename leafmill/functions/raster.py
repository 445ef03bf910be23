"""Pixel work on one page at a time, in numpy alone.

Images are uint8 arrays (height, width, 3) or grey (height, width). Where
other tools use contours and probabilistic transforms with random starts,
these functions use run lengths, labelled runs and a plain Hough transform, so
equal images give equal results.
"""

from __future__ import annotations

import math

import numpy as np

Box = tuple[int, int, int, int]


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    return (image[..., :3] @ np.array([0.299, 0.587, 0.114])).round().astype(np.uint8)


def otsu(values: np.ndarray) -> int:
    """The level that best parts dark from light."""
    count = np.bincount(values.ravel(), minlength=256).astype(float)
    below, total = np.cumsum(count), count.sum()
    mass = np.cumsum(count * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mass[-1] * below - mass * total) ** 2 / (below * (total - below))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def ink(image: np.ndarray) -> np.ndarray:
    """Dark pixels; none on a page of one shade."""
    g = grey(image)
    return g <= otsu(g) if g.size and g.min() < g.max() else np.zeros(g.shape, bool)


def long_runs(mask: np.ndarray, least: int, axis: int) -> np.ndarray:
    """Pixels in runs of at least ``least`` along an axis (1: rows)."""
    m = mask if axis == 1 else mask.T
    wide = np.zeros((m.shape[0], m.shape[1] + 2), np.int8)
    wide[:, 1:-1] = m
    step = np.diff(wide, axis=1)
    row, start = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    keep = end - start >= least
    change = np.zeros((m.shape[0], m.shape[1] + 1), np.int32)
    np.add.at(change, (row[keep], start[keep]), 1)
    np.add.at(change, (row[keep], end[keep]), -1)
    out = np.cumsum(change, axis=1)[:, :-1] > 0
    return out if axis == 1 else out.T


def grow(mask: np.ndarray, reach: int) -> np.ndarray:
    """Dilation by a square of 2 * reach + 1."""
    out = mask
    for axis in (0, 1):
        sums = np.cumsum(np.pad(out.astype(np.int32), [(reach + 1, reach) if a == axis else (0, 0) for a in (0, 1)]), axis=axis)
        n = 2 * reach + 1
        out = (np.take(sums, range(n, sums.shape[axis]), axis) - np.take(sums, range(sums.shape[axis] - n), axis)) > 0
    return out


def regions(mask: np.ndarray) -> list[dict]:
    """Connected regions (8 neighbours): box, area, centre. Runs of rows joined by union-find."""
    wide = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    wide[:, 1:-1] = mask
    step = np.diff(wide, axis=1)
    row, start = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    parent = list(range(len(row)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(row, np.arange(mask.shape[0] + 1)).tolist()
    s, e = start.tolist(), end.tolist()
    for y in range(1, mask.shape[0]):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if s[i] <= e[j] and s[j] <= e[i]:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
            if e[i] < e[j]:
                i += 1
            else:
                j += 1
    root = np.array([find(i) for i in range(len(row))], dtype=int)
    out = []
    for r in np.unique(root):
        own = root == r
        size = end[own] - start[own]
        area = int(size.sum())
        out.append({"box": (int(start[own].min()), int(row[own].min()), int(end[own].max()), int(row[own].max()) + 1), "area": area, "x": float(((start[own] + end[own] - 1) / 2 * size).sum() / area), "y": float((row[own] * size).sum() / area)})
    return out


def gaps(profile: np.ndarray, threshold: float, least: int) -> list[tuple[int, int]]:
    """Stretches at or under a threshold; a stretch too short goes on into the next."""
    out, start = [], None
    for i, v in enumerate(profile.tolist()):
        if v <= threshold:
            start = i if start is None else start
        elif start is not None and i - start >= least:
            out.append((start, i))
            start = None
    if start is not None and len(profile) - start >= least:
        out.append((start, len(profile)))
    return out


def between(found: list[tuple[int, int]], end: int) -> list[tuple[int, int]]:
    """What lies between gaps."""
    edges = [0, *[x for g in found for x in g], end]
    return [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if b > a]


def skew(image: np.ndarray, most: float = 5.0, step: float = 0.5, least: float = 0.3) -> float:
    """The angle, in degrees, at which rows of ink are sharpest; 0 if it is under ``least``."""
    y, x = np.nonzero(ink(image))
    best, angle = -1.0, 0.0
    for a in sorted(np.arange(-most, most + step / 2, step), key=abs):
        t = math.radians(a)
        rows = np.round(y * math.cos(t) - x * math.sin(t)).astype(int)
        score = float(np.var(np.bincount(rows - rows.min()))) if len(rows) else 0.0
        if score > best + 1e-9:
            best, angle = score, float(a)
    return angle if abs(angle) >= least else 0.0


def name_panels(boxes: list[Box]) -> list[dict]:
    """Panels by letter, left to right, with their default data ranges."""
    out = []
    for i, (x0, y0, x1, y1) in enumerate(sorted(boxes)):
        out.append({"panel_id": chr(97 + i) if i < 26 else f"p{i}", "px0": x0, "py0": y0, "px1": x1, "py1": y1, "x_min": 0.0, "x_max": 5.0, "y_min": 0.0, "y_max": 28.0 if len(boxes) == 2 and i == 0 else 30.0})
    return out


def panels(image: np.ndarray) -> list[dict]:
    """Framed regions of 5 to 60 % of the page, of aspect 0.15 to 3; failing those, regions between empty bands."""
    h, w = image.shape[:2]
    found = [r["box"] for r in regions(grow(ink(image), 2))]
    sized = [b for b in found if 0.05 * w * h <= (b[2] - b[0]) * (b[3] - b[1]) <= 0.60 * w * h and 0.15 <= (b[2] - b[0]) / (b[3] - b[1]) <= 3.0]
    return name_panels(sized) if sized else panels_by_bands(image)


def panels_by_bands(image: np.ndarray) -> list[dict]:
    g = grey(image).astype(int)
    h, w = g.shape
    edge = np.zeros_like(g)
    edge[:, 1:] += np.abs(np.diff(g, axis=1))
    edge[1:] += np.abs(np.diff(g, axis=0))
    rows, cols = edge.sum(axis=1), edge.sum(axis=0)
    down, across = gaps(rows, rows.max() * 0.1, int(h * 0.02)), gaps(cols, cols.max() * 0.1, int(w * 0.02))
    if not edge.any() or not down and not across:
        return []
    boxes = [(x0, y0, x1, y1) for y0, y1 in between(down, h) for x0, x1 in between(across, w) if (x1 - x0) * (y1 - y0) >= 0.05 * w * h]
    return [{**p, "y_max": 30.0} for p in name_panels(boxes)]


def structures(image: np.ndarray, share: float = 0.20) -> list[dict]:
    """Axis frames: regions of long horizontal and vertical lines that touch; box, counts of lines, confidence."""
    dark = ink(image)
    h, w = dark.shape
    flat = [r["box"] for r in regions(long_runs(dark, max(15, w // 24), 1)) if r["box"][2] - r["box"][0] >= w * share]
    tall = [r["box"] for r in regions(long_runs(dark, max(15, h // 24), 0)) if r["box"][3] - r["box"][1] >= h * share]
    if not flat or not tall:
        return []
    mask = np.zeros_like(dark)
    for x0, y0, x1, y1 in flat + tall:
        mask[y0:y1, x0:x1] = True
    out = []
    for r in regions(grow(mask, 3)):
        x0, y0, x1, y1 = r["box"]
        meets = lambda b: b[0] < x1 and b[2] > x0 and b[1] < y1 and b[3] > y0  # noqa: B023, E731
        n = sum(map(meets, flat)), sum(map(meets, tall))
        if r["area"] >= 50 and x1 - x0 >= w * share and y1 - y0 >= h * share and all(n):
            out.append({"box": r["box"], "h_lines": n[0], "v_lines": n[1]})
    return out


def marks(image: np.ndarray, inset: int = 6, least: int = 5, most: int = 400, edge: int = 8) -> list[dict]:
    """Scatter marks in a plot: small dark regions once long lines are gone, away from the frame."""
    dark = ink(image)[inset : image.shape[0] - inset, inset : image.shape[1] - inset]
    h, w = dark.shape
    lines = long_runs(dark, max(30, w // 10), 1) | long_runs(dark, max(30, h // 10), 0)
    out = []
    for r in regions(dark & ~grow(lines, 1)):
        x0, y0, x1, y1 = r["box"]
        if least <= r["area"] <= most and x1 - x0 >= 3 and y1 - y0 >= 3 and x0 >= edge and y0 >= edge and x1 <= w - edge and y1 <= h - edge:
            out.append({"x": r["x"] + inset, "y": r["y"] + inset, "area": r["area"]})
    return out


def hsv(image: np.ndarray) -> np.ndarray:
    """Hue to 180, saturation and value to 255."""
    c = image[..., :3].astype(float)
    top, low = c.max(axis=-1), c.min(axis=-1)
    d = np.where(top > low, top - low, 1)
    r, g, b = c[..., 0], c[..., 1], c[..., 2]
    h = np.select([top == low, top == r, top == g], [0.0, (g - b) / d % 6, (b - r) / d + 2], (r - g) / d + 4) * 30
    return np.stack([h % 180, np.where(top > 0, (top - low) / np.maximum(top, 1) * 255, 0), top], axis=-1)


_HUES = ((12.5, "red"), (24.5, "orange"), (37.5, "yellow"), (79.5, "green"), (99.5, "cyan"), (139.5, "blue"), (159.5, "purple"), (168.5, "magenta"), (190.0, "red"))
ORDER = ("red", "blue", "green", "cyan", "yellow", "orange", "magenta", "purple")


def color_name(h: float, s: float, v: float) -> str | None:
    if s < 20:
        return "black" if v < 80 else None
    return next((n for top, n in _HUES if -10 <= h <= top), None)


def kmeans(x: np.ndarray, k: int, seed: int = 0, rounds: int = 20) -> tuple[np.ndarray, np.ndarray, float]:
    """Centres, labels and squared error; starts are spread by distance with a fixed seed."""
    draw = np.random.default_rng(seed)
    centres = x[[int(draw.integers(len(x)))]]
    for _ in range(k - 1):
        d = ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
        centres = np.vstack([centres, x[int(d.argmax())]])
    for _ in range(rounds):
        label = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.stack([x[label == i].mean(axis=0) if (label == i).any() else centres[i] for i in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    return centres, label, float(((x - centres[label]) ** 2).sum())


def silhouette(x: np.ndarray, label: np.ndarray, centres: np.ndarray, sample: int = 800) -> float:
    """How much nearer points are to their own centre than to the next, on at most ``sample`` points."""
    pick = np.arange(len(x)) if len(x) <= sample else np.random.default_rng(42).choice(len(x), sample, replace=False)
    used = np.unique(label)
    if len(used) < 2:
        return 0.0
    d = np.sqrt(((x[pick][:, None] - centres[used][None]) ** 2).sum(axis=2))
    own = np.searchsorted(used, label[pick])
    a = d[np.arange(len(pick)), own]
    d[np.arange(len(pick)), own] = np.inf
    b = d.min(axis=1)
    top = np.maximum(a, b)
    return float(np.mean(((b - a) / np.where(top > 0, top, 1))[top > 0])) if (top > 0).any() else 0.0


def colors(image: np.ndarray, boxes: list[Box]) -> list[str]:
    """Names of the data colours in the middles of panels; red where none is found."""
    parts = []
    for x0, y0, x1, y1 in boxes:
        w, h = x1 - x0, y1 - y0
        parts.append(hsv(image[int(y0 + 0.2 * h) : int(y0 + 0.8 * h), int(x0 + 0.2 * w) : int(x0 + 0.8 * w)]).reshape(-1, 3)[::4])
    x = np.concatenate(parts) if parts else np.zeros((0, 3))
    if len(x) < 100:
        return ["red"]
    tried = {k: kmeans(x, k) for k in range(3, 9)}
    error = np.array([t[2] for t in tried.values()])
    error = error / error.max() if error.max() > 0 else error
    bend = np.zeros(len(error))
    bend[1:-1] = error[:-2] + error[2:] - 2 * error[1:-1]
    bend = bend / bend.max() if bend.max() > 1e-9 else bend
    fit = np.array([silhouette(x, label, centres) for centres, label, _ in tried.values()])
    fit = (fit - fit.min()) / np.ptp(fit) if np.ptp(fit) > 1e-9 else np.zeros_like(fit)
    centres, label, _ = tried[3 + int(np.argmax(0.4 * fit + 0.6 * bend))]
    share = np.bincount(label, minlength=len(centres)) / len(label)
    vivid = float((x[:, 1] >= 20).mean())
    least = 35 if vivid > 0.65 else 30 if vivid > 0.45 else 25 if vivid > 0.30 else 20
    found: dict[str, tuple[float, float]] = {}
    for (h, s, v), part in zip(centres, share, strict=True):
        name = color_name(h, s, v)
        if 0.03 <= part <= 0.70 and s >= least and v >= 20 and name and part > found.get(name, (0, 0))[1]:
            found[name] = h, part
    if not found or set(found) == {"red"}:
        return hue_peaks(x) or sorted(found) or ["red"]
    for a in list(found):
        for b in list(found):
            if a in found and b in found and a != b:
                apart = abs(found[a][0] - found[b][0])
                if min(apart, 180 - apart) < 15:
                    del found[a if found[a][1] < found[b][1] else b]
    return [c for c in ORDER if c in found] or sorted(found)


def hue_peaks(x: np.ndarray) -> list[str]:
    """Colours at the peaks of the smoothed histogram of hues."""
    h = x[(x[:, 1] >= 20) & (x[:, 2] >= 20), 0]
    if len(h) < 20:
        return []
    smooth = np.convolve(np.bincount(np.minimum(h.astype(int), 179), minlength=180).astype(float), np.ones(5) / 5, mode="same")
    inner = np.arange(1, 179)
    top = (smooth[inner] > smooth[inner - 1]) & (smooth[inner] > smooth[inner + 1])
    for k in (0.5, 0.2):
        names = {color_name(float(i), 100, 100) for i in inner[top & (smooth[inner] > smooth.mean() + k * smooth.std())]}
        if names:
            return [c for c in ORDER if c in names]
    return []


def color_mask(image: np.ndarray, name: str) -> np.ndarray:
    c = hsv(image)
    if name in ("black", "grey", "gray"):
        return (c[..., 1] < 60) & (c[..., 2] < 80)
    edges = [-10.0] + [top for top, _ in _HUES]
    hue = np.zeros(c.shape[:2], bool)
    for (top, n), low in zip(_HUES, edges, strict=False):
        hue |= (n == name) & (c[..., 0] > low) & (c[..., 0] <= top)
    return hue & (c[..., 1] >= 50) & (c[..., 2] >= 50)


def vertical_intervals(mask: np.ndarray, to_data, most: int = 6) -> list[dict]:
    """Classes as vertical strokes of one colour: strokes chained within 8 pixels, at least two, the first six."""
    h = mask.shape[0]
    least = max(45, int(h * 0.035))
    strokes = sorted((r["x"], r["box"][1], r["box"][3]) for r in regions(long_runs(mask, min(35, least), 0)) if r["box"][3] - r["box"][1] >= least and r["box"][2] - r["box"][0] <= 0.45 * (r["box"][3] - r["box"][1]))
    chains: list[list[tuple]] = []
    for s in strokes:
        if chains and s[0] - chains[-1][-1][0] <= 8:
            chains[-1].append(s)
        else:
            chains.append([s])
    if len(chains) < 2:
        return []
    out = []
    for i, c in enumerate(chains[:most]):
        ends = to_data(min(s[1] for s in c)), to_data(max(s[2] for s in c))
        out.append({"class": i, "start_depth": round(min(ends), 1), "end_depth": round(max(ends), 1), "pixel_x": round(sum(s[0] for s in c) / len(c), 1)})
    return out


def dots(mask: np.ndarray, least: int = 4, most: int = 250) -> list[dict]:
    """Small regions of one colour once its upright strokes are gone."""
    free = mask & ~grow(long_runs(mask, 35, 0), 3)
    return [r for r in regions(free) if least <= r["area"] <= most and min(r["box"][2] - r["box"][0], r["box"][3] - r["box"][1]) >= 3]


def panel_items(crop: np.ndarray, panel: dict, name: str) -> list[dict]:
    """Intervals of a panel's strokes of one colour, and its dots by the class of the nearest stroke.

    The second nearest is a candidate too within three quarters of the median
    step between strokes; without strokes there are no classes and no points.
    """
    h = max(crop.shape[0], 1)
    span = panel["y_max"] - panel["y_min"]
    to_data = lambda y: panel["y_min"] + y / h * span
    mask = color_mask(crop, name)
    bars = vertical_intervals(mask, to_data)
    if not bars:
        return []
    about = {"panel_id": panel["panel_id"], "color": name, "source": "color"}
    slack = round(min(max(abs(span) * 0.025, 0.3), 0.75), 2), round(min(max(abs(span) * 0.02, 0.35), 0.65), 2)
    out = [{**about, "item_type": "interval", **{k: b[k] for k in ("class", "start_depth", "end_depth")}, "depth_tolerance": slack[0]} for b in bars]
    xs = sorted(b["pixel_x"] for b in bars)
    steps = [b - a for a, b in zip(xs, xs[1:], strict=False) if b > a]
    step = float(np.median(steps)) if steps else 0.0
    for d in dots(mask):
        near = sorted(bars, key=lambda b, x=d["x"]: abs(b["pixel_x"] - x))
        also = [b["class"] for b in near[1:2] if step and abs(b["pixel_x"] - d["x"]) <= step * 0.75]
        out.append({**about, "item_type": "point", "class": near[0]["class"], "class_candidates": [near[0]["class"], *also], "depth": round(to_data(d["y"]), 1), "depth_tolerance": slack[1]})
    return out


def chart_items(image: np.ndarray, names: list[str] | None = None) -> list[dict]:
    """All chart items of a page: by colour in its panels; failing those, its axis frames; and zones in panels in any case."""
    found = panels(image)
    boxes = [(p["px0"], p["py0"], p["px1"], p["py1"]) for p in found]
    crops = [image[y0:y1, x0:x1] for x0, y0, x1, y1 in boxes]
    places = lambda b: dict(zip(("px0", "py0", "px1", "py1"), map(float, b), strict=True))
    out = [{**i, **places(b)} for p, c, b in zip(found, crops, boxes, strict=True) for name in (names or colors(image, boxes)) for i in panel_items(c, p, name)]
    if not out:
        out = [{"item_type": "chart_detected", "panel_id": "chart", "source": "structure", **places(f["box"])} for f in structures(image)]
    for p, c, b in zip(found, crops, boxes, strict=True):
        to_data = lambda y, p=p, h=max(c.shape[0], 1): p["y_min"] + y / h * (p["y_max"] - p["y_min"])
        slack = round(min(max(abs(p["y_max"] - p["y_min"]) * 0.025, 0.3), 0.75), 2)
        for z in zone_boundaries(c, to_data):
            out.append({"item_type": "interval", "panel_id": p["panel_id"], "color": "black", "source": "zones", "depth_tolerance": slack, **{k: z[k] for k in ("class", "start_depth", "end_depth")}, **places(b)})
    return out


def zone_boundaries(image: np.ndarray, to_data, threshold: int = 40) -> list[dict]:
    """Diagonal lines (slope 0.15 to 5) as intervals of depth, classes by rising mean depth.

    A Hough transform of the ink without level and upright runs; lines are
    taken by votes, their pixels are removed, and gaps over 8 pixels part them.
    """
    dark = ink(image)
    h, w = dark.shape
    least = max(70, int(w * 0.08))
    dark = dark & ~grow(long_runs(dark, max(40, w // 6), 1), 1) & ~grow(long_runs(dark, max(40, h // 6), 0), 1)
    y, x = np.nonzero(dark)
    angles = np.radians(np.arange(-90.0, 90.0, 0.5))
    # The normal's angle; a line of slope m has the direction at a right angle to it.
    slope = np.abs(np.tan(angles + np.pi / 2))
    angles = angles[(slope >= 0.12) & (slope <= 5.5)]
    found = []
    for _ in range(64):
        if len(x) < threshold:
            break
        rho = np.round(x[:, None] * np.cos(angles) + y[:, None] * np.sin(angles)).astype(int)
        low = rho.min()
        flat = (rho - low) + np.arange(len(angles)) * (rho.max() - low + 1)
        votes = np.bincount(flat.ravel())
        cell = int(votes.argmax())
        if votes[cell] < threshold:
            break
        a, r = angles[cell // (rho.max() - low + 1)], cell % (rho.max() - low + 1) + low
        near = np.abs(x * np.cos(a) + y * np.sin(a) - r) <= 2.5
        along = -x[near] * np.sin(a) + y[near] * np.cos(a)
        order = np.argsort(along)
        parts = np.split(order, np.flatnonzero(np.diff(along[order]) > 8) + 1)
        px, py = x[near], y[near]
        spans = [(px[p].min(), py[p].min(), px[p].max(), py[p].max()) for p in parts if along[p].max() - along[p].min() >= 0.8 * least]
        steep = [(d - b) / max(c - a_, 1) for a_, b, c, d in spans]
        spans = [s for s, m in zip(spans, steep, strict=True) if 0.15 <= m <= 5.0]
        if spans and (len(spans) >= 2 or spans[0][2] - spans[0][0] >= 0.3 * w):
            found.append((min(s[0] for s in spans), min(s[1] for s in spans), max(s[2] for s in spans), max(s[3] for s in spans)))
        gone = np.abs(x * np.cos(a) + y * np.sin(a) - r) <= 5
        x, y = x[~gone], y[~gone]
    out = []
    for x0, y0, x1, y1 in found:
        ends = to_data(float(y0)), to_data(float(y1))
        out.append({"start_depth": round(min(ends), 1), "end_depth": round(max(ends), 1), "pixel_x0": float(x0), "pixel_y0": float(y0), "pixel_x1": float(x1), "pixel_y1": float(y1)})
    out.sort(key=lambda i: i["start_depth"] + i["end_depth"])
    return [{"class": k, **i} for k, i in enumerate(out, 1)]


def zone_digits(read: list[tuple[int, float, float, float]], reach: float = 22) -> dict[int, tuple[float, float]]:
    """Zone numbers from readings (digit, x, y, confidence): by y and x, those near a cluster's first are one; the surest counts."""
    clusters: list[list[tuple]] = []
    for r in sorted((r for r in read if 1 <= r[0] <= 9 and r[3] >= 50), key=lambda r: (r[2], r[1])):
        if clusters and abs(r[1] - clusters[-1][0][1]) <= reach and abs(r[2] - clusters[-1][0][2]) <= reach:
            clusters[-1].append(r)
        else:
            clusters.append([r])
    return {best[0]: (best[1], best[2]) for best in (max(c, key=lambda r: r[3]) for c in clusters)}


def line_places(mask: np.ndarray, axis: int) -> list[int]:
    """Means of the stretches where a projection passes a quarter of its top; 5 pixels chain."""
    profile = mask.sum(axis=axis)
    at = np.flatnonzero(profile > profile.max() * 0.25) if profile.size and profile.max() else np.zeros(0, int)
    return [int(p.mean()) for p in np.split(at, np.flatnonzero(np.diff(at) > 5) + 1)] if len(at) else []


def ruled_tables(image: np.ndarray) -> list[dict]:
    """Grids of ruled lines: box, row and column lines, and cells that span because a line between is missing."""
    dark = ink(image)
    flat, tall = long_runs(dark, 50, 1), long_runs(dark, 50, 0)
    out = []
    for r in regions(grow(flat | tall, 2)):
        x0, y0, x1, y1 = r["box"]
        if x1 - x0 < 60 or y1 - y0 < 30:
            continue
        h, v = flat[y0:y1, x0:x1], tall[y0:y1, x0:x1]
        rows, cols = line_places(h, 1), line_places(v, 0)
        if len(rows) >= 2 and len(cols) >= 2:
            out.append({"box": r["box"], "rows": [y0 + a for a in rows], "cols": [x0 + a for a in cols], "merged": merged_cells(h, v, rows, cols)})
    return out


def merged_cells(flat: np.ndarray, tall: np.ndarray, rows: list[int], cols: list[int]) -> list[dict]:
    """Cells that reach over a border without a line: downwards where the level line under them is missing, rightwards where the upright one is."""
    under = [[bool(flat[max(0, r - 1) : r + 2, a + 1 : b - 1].any()) for a, b in zip(cols, cols[1:], strict=False)] for r in rows]
    beside = [[bool(tall[a + 1 : b - 1, max(0, c - 1) : c + 2].any()) for a, b in zip(rows, rows[1:], strict=False)] for c in cols]
    out, covered = [], set()
    for r in range(len(rows) - 1):
        for c in range(len(cols) - 1):
            if (r, c) in covered:
                continue
            down = across = 1
            while c + across < len(cols) - 1 and not beside[c + across][r]:
                across += 1
            while r + down < len(rows) - 1 and not any(under[r + down][c : c + across]):
                down += 1
            if down > 1 or across > 1:
                out.append({"row": r, "col": c, "rowspan": down, "colspan": across})
                covered |= {(r + i, c + j) for i in range(down) for j in range(across)}
    return out
