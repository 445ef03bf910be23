"""Folds and sequential matchings against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leafmill.functions import formula
from leafmill.functions import text as T
from leafmill.operators import charts, evals, lines, order, render, runtime, tables

BLOCK = "doc_id bigint, page_no int, block_seq int, type string, text string, x0 double, y0 double, x1 double, y1 double, confidence double"
CJK = re.compile("[一-鿿㐀-䶿豈-﫿぀-ヿ가-힯]")


def cjk(t):
    t = t.strip()
    return bool(t) and len(CJK.findall(t)) / len(t) > 0.3


def random_blocks(seed, pages=4, n=14):
    draw = random.Random(seed)
    rows = []
    for p in range(pages):
        y = 0.0
        for i in range(n):
            y += draw.choice([2, 6, 9, 14, 20])
            x = draw.choice([10.0, 18.0, 30.0, 200.0])
            text = draw.choice(["plain words", "文字文字。", "混合 text", "1. Title", "漢字"])
            rows.append((seed, p, i, draw.choice(["paragraph", "paragraph", "heading", "list"]), text, x, y, x + draw.choice([40.0, 120.0]), y + draw.choice([8.0, 12.0]), draw.choice([90.0, 80.0, 40.0, None])))
            y += 10
    return rows


def merged_in_python(rows, ocr):
    out = []
    for page in sorted({r[:2] for r in rows}):
        own = [r for r in rows if r[:2] == page]
        own.sort(key=(lambda r: (r[6], r[5], r[2])) if ocr else (lambda r: r[2]))
        held = []
        for _, _, _, kind, text, x0, y0, x1, y1, c in own:
            b = [kind, text, x0, y0, x1, y1, c]
            if held:
                a = held[-1]
                gap = b[3] - a[5]
                if ocr:
                    high = ((a[5] - a[3]) + (b[5] - b[3])) / 2
                    joins = 0 <= gap <= max(10, high * 1.6) and min(a[4], b[4]) - max(a[2], b[2]) > 0
                else:
                    joins = a[0] == b[0] == "paragraph" and 0 <= gap <= 12 and abs(a[2] - b[2]) <= 16 and not (cjk(a[1]) and re.search("[。！？]$", a[1].strip()) and gap > 8)
                if joins:
                    rank = ["title", "heading", "list", "paragraph", "uncertain"].index
                    gap_text = "" if cjk(a[1]) and cjk(b[1]) else " "
                    held[-1] = [min(a[0], b[0], key=rank), a[1] + gap_text + b[1], min(a[2], b[2]), min(a[3], b[3]), max(a[4], b[4]), max(a[5], b[5]), ((a[6] or 0) + (b[6] or 0)) / 2]
                    continue
            held.append(b)
        out += [(*page, i, *b) for i, b in enumerate(held)]
    return sorted(out)


@pytest.mark.parametrize("ocr", [True, False])
def test_paragraphs(spark, ocr):
    rows = [r for s in range(5) for r in random_blocks(s)]
    got = lines.merge_paragraphs(spark.createDataFrame(rows, BLOCK).repartition(3), ocr)
    assert sorted(tuple(r) for r in got.select("doc_id", "page_no", "block_seq", "type", "text", "x0", "y0", "x1", "y1", "confidence").collect()) == merged_in_python(rows, ocr)


def test_confidence_is_a_running_mean(spark):
    rows = [(1, 0, i, "paragraph", "w", 0.0, 20.0 * i, 9.0, 20.0 * i + 12, c) for i, c in enumerate([90.0, 80.0, 40.0])]
    assert lines.merge_paragraphs(spark.createDataFrame(rows, BLOCK)).first().confidence == 62.5


def test_reading_order(spark):
    rows = [(1, 0, i, "paragraph", "t", x, y, x + 5, y + 5, 1.0) for i, (x, y) in enumerate([(1.0, 6.0), (20.0, 18.0), (10.0, 30.0)])] + [(1, 0, 9, "figure", "f", None, None, None, None, None)]
    got = order.default_order(spark.createDataFrame(rows, BLOCK)).orderBy("pos").collect()
    assert [r.block_seq for r in got] == [9, 0, 2, 1]


def test_projection_columns(spark):
    rows = [(1, 0, i, "paragraph", "t", 10.0 if i % 2 else 300.0, 10.0 * i, (10.0 if i % 2 else 300.0) + 200, 10.0 * i + 8, 1.0) for i in range(8)]
    got = order.projection_columns(spark.createDataFrame(rows, BLOCK).withColumn("width", F.lit(600.0))).orderBy("pos").collect()
    assert [r.block_seq for r in got] == [1, 3, 5, 7, 0, 2, 4, 6]


def levels_and_chunks(blocks, size):
    """blocks: (page, type, text) in order; the retrieval text of one document."""
    like = {"paragraph", "title", "heading", "list", "uncertain", "placeholder"}
    out, count, stack, page = [], 0, [], None
    for i, (p, kind, text) in enumerate(blocks):
        if p != page:
            out += ["", f"<!-- src_page={p + 1} -->", f"[page {p + 1}]"]
            page, before = p, None
        flat = " ".join(text.split())
        near = lambda js: next((" ".join(blocks[j][2].split())[:200] for j in js if blocks[j][0] == p and blocks[j][1] in {"paragraph", "list", "heading", "title"} and blocks[j][2].split()), "")
        if kind in ("title", "heading"):
            level = 1 if kind == "title" else min(len(stack) + 2, 3)
            stack = [x for x in stack if x < level] + [level]
            shown = "#" * level + " " + flat
        elif kind == "table":
            shown = f"[TABLE]\n{text.strip()}\n[/TABLE]"
        elif kind == "figure":
            shown = f"[FIG] {flat}" if flat else ""
        else:
            shown = flat
        if not shown:
            continue
        if kind in ("title", "heading") and count:
            out.append("<!-- CHUNK -->")
            count = 0
        if count and count + len(shown) > size:
            out.append("<!-- CHUNK -->")
            count = 0
        if kind in ("table", "figure"):
            for c, js in ((0, range(i - 1, -1, -1)), (1, range(i + 1, len(blocks)))):
                if c:
                    out.append(shown)
                    count += len(shown)
                if told := near(js):
                    out.append(f"[CONTEXT] {told}")
                    count += len(out[-1])
        else:
            if before in like and kind in like:
                out.append("¶")
                count += 1
            out.append(shown)
            count += len(shown)
        before = kind
    return "\n".join(out)


@pytest.mark.parametrize("size", [10, 60, 2000])
def test_chunks(spark, size):
    draw = random.Random(size)
    docs = {d: [(i // 6, draw.choice(["paragraph", "paragraph", "heading", "title", "table", "figure", "list", "footer"] if i else ["paragraph"]), " ".join(["ab", "cde", "f"][: draw.randrange(4)] * draw.randrange(1, 5))) for i in range(20)] for d in range(6)}
    rows = [(d, p, i, kind, text, i) for d, bs in docs.items() for i, (p, kind, text) in enumerate(bs)]
    frame = spark.createDataFrame(rows, "doc_id bigint, page_no int, block_seq int, type string, text string, pos int").repartition(3)
    for r in render.chunks(frame, size).collect():
        head = f"---\nsrc: {r.doc_id}\npgs: 4\nlang: en\n---\n"
        body = levels_and_chunks([b if b[1] != "footer" else (b[0], "footer", b[2]) for b in docs[r.doc_id]], size)
        body = re.sub(r"(?m)^(?!\[|<|#|¶|\|)(.*)$", r"\1", body)
        want = (head + body).strip() + "\n"
        got = re.sub(r"\[footer\] ?", "", r.text)
        assert got.count("<!-- CHUNK -->") == r.n_chunks - 1
        if not any(b[1] == "footer" for b in docs[r.doc_id]):
            assert r.text == want


def test_heading_levels(spark):
    rows = [(1, 0, i, k, "t", i) for i, k in enumerate(["heading", "heading", "title", "heading"])]
    got = render.heading_levels(spark.createDataFrame(rows, "doc_id bigint, page_no int, block_seq int, type string, text string, pos int")).orderBy("pos").collect()
    assert [r.level for r in got] == [2, 3, 1, 3]


def test_pairing(spark):
    draw = random.Random(4)
    ticks = [(k, float(draw.randrange(300))) for k in range(5) for _ in range(12)]
    labels = [(k, s, float(draw.randrange(300)), float(s)) for k in range(5) for s in range(9)]
    want = []
    for k in range(5):
        free = [x for x in labels if x[0] == k]
        for t in sorted(t for kk, t in ticks if kk == k):
            best = min(free, key=lambda x: (abs(x[2] - t), x[1]), default=None)
            if best and abs(best[2] - t) < 25:
                free.remove(best)
                want.append((k, t, best[3]))
    got = charts.pair_ticks(spark.createDataFrame(ticks, "k int, pixel double"), spark.createDataFrame(labels, "k int, seq bigint, place double, value double"), ["k"])
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_zone_candidates(spark):
    anchors = [(0, z, 10.0 * z, 100.0 - 7 * z) for z in range(1, 8)]
    points = [(0, i, float(i * 9 % 80), float(i * 17 % 100)) for i in range(20)]
    got = charts.anchor_candidates(spark.createDataFrame(points, "k int, point_id int, px double, py double"), spark.createDataFrame(anchors, "k int, zone int, x double, y double"), ["k"])
    for r in got.collect():
        _, _, x, y = points[r.point_id]
        assert r.class_candidates == [z for _, z, *_ in sorted(anchors, key=lambda a: (((a[2] - x) ** 2 + (a[3] - y) ** 2) ** 0.5, a[1]))[:3]]


def test_engines(spark):
    draw = random.Random(9)
    box = lambda: (lambda x, y: (x, y, x + 20.0, y + 10.0))(float(draw.randrange(60)), float(draw.randrange(40)))
    left = [(1, p, i, f"a{p}{i}", *box(), float(draw.randrange(100)), "a") for p in range(4) for i in range(6)]
    right = [(1, p, i, f"b{p}{i}", *box(), float(draw.randrange(100)), "b") for p in range(5) for i in range(6)]
    want = []
    for p in range(5):
        held = [r[3:] for r in left if r[1] == p]
        for b in (r[3:] for r in right if r[1] == p):
            best, at = 0.0, -1
            for i, a in enumerate(held):
                w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
                if p < 4 and w > 0 and h > 0 and w * h / 200 > best:
                    best, at = w * h / 200, i
            if best <= 0.5:
                held.append(b)
            elif b[5] > held[at][5]:
                held[at] = b
        want += [(1, p, i, *b) for i, b in enumerate(held)]
    schema = "doc_id bigint, page_no int, block_seq int, text string, x0 double, y0 double, x1 double, y1 double, confidence double, engine string"
    got = runtime.merge_engines(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_type_accuracy(spark):
    a = [(1, 0, "heading", "abc"), (1, 1, "paragraph", "xyz"), (1, 2, "list", "q"), (2, 0, "list", "z"), (4, 0, "list", "")]
    e = [(1, 0, "paragraph", "xy"), (1, 1, "heading", "ab"), (3, 0, "list", "k"), (4, 0, "list", "")]
    got = {r.doc_id: r.score for r in evals.type_accuracy(*[spark.createDataFrame(x, "doc_id bigint, seq int, type string, text string") for x in (a, e)]).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: 1.0}


def test_row_grouping_follows_the_median(spark):
    rows = [(1, 0, i, "paragraph", f"c{i}", x, y, x + 10, y + 10, 1.0) for i, (x, y) in enumerate([(0.0, 0.0), (50.0, 4.0), (100.0, 8.0), (0.0, 30.0), (50.0, 31.0), (0.0, 60.0), (50.0, 60.0)])]
    got = {r.block_seq: r.row for r in tables.group_rows(spark.createDataFrame(rows, BLOCK)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 2}


LATEX = {
    "qt = qc + (1 - a) u2": ["q_t", "q_c", "u_2"],
    "By = Au / (qt - ovo)": ["B_q", r"\frac", r"\Delta u", r"\sigma_{v0}"],
    "sigma = 5%": [r"\sigma", r"\%"],
    "3 /4 + a/b": ["3/4", r"\frac{a}{b}"],
    "σ' x 100": [r"\times 100"],
    "[formula] fs/(qt-sv0)": [r"\frac{fs}{(q_t-\sigma_{v0})}"],
}


def test_latex(spark):
    frame = spark.createDataFrame([(k,) for k in [*LATEX, "plain prose", ""]], "t string").select("t", formula.rebuild(F.col("t")).alias("l"))
    got = {r.t: r.l for r in frame.collect()}
    for k, parts in LATEX.items():
        for p in parts:
            assert p in got[k] or p.replace("fs", "f_s") in got[k], (k, got[k])
    assert got["plain prose"] == "plain prose" and got[""] == ""


def test_normalize_is_idempotent_without_swaps(spark):
    texts = ["深度 /m", "ＡＢ１ 文 字", "文a字", "  a   b "]
    one = spark.createDataFrame([(t,) for t in texts], "t string").select(T.normalize(F.col("t"), swap=False).alias("n"))
    two = one.select("n", T.normalize(F.col("n"), swap=False).alias("m")).collect()
    assert all(r.n == r.m for r in two) and [r.n for r in two] == ["深度/m", "AB1 文字", "文 a 字", "a b"]
