"""Documents as strings: Markdown, plain text, compact texts for language models, retrieval chunks, JSON.

Blocks are (doc_id, page_no, block_seq, pos, type, text, ...) with pos from
operators.order. Optional columns are a box (x0..y1), confidence, width and
height of the page, src, and chart, an array of chart items as in CHART.
A block's string is one column; strings are put together in one grouping by
page and document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.formula import rebuild
from leafmill.functions.text import bbox_text, has_tag_cjk, is_latex, lang_tag, squeeze, strip

CHART = "array<struct<item_type:string,panel_id:string,class:int,class_candidates:array<int>,start_depth:double,end_depth:double,depth:double,depth_tolerance:double>>"
TEXT_LIKE = ("paragraph", "title", "heading", "list", "uncertain", "placeholder")
_S = F.lit


def _optional(blocks: DataFrame, **defaults: str) -> DataFrame:
    have = {n for n, t in blocks.dtypes if t != "void"}
    return blocks.withColumns({n: F.lit(None).cast(t) for n, t in defaults.items() if n not in have})


def _full(blocks: DataFrame) -> DataFrame:
    return _optional(blocks, x0="double", y0="double", x1="double", y1="double", confidence="double", width="double", height="double", chart=CHART, src="string")


def _box() -> Column:
    return F.when(F.col("x0").isNotNull(), F.struct("x0", "y0", "x1", "y1"))


def _placeholder(label: str, t: Column) -> Column:
    return F.concat(_S(f"[{label}: page="), F.col("page_no") + 1, _S(", bbox="), bbox_text(_box()), _S(", caption="), F.when(t == "", "not detected").otherwise(t), _S("]"))


def _formula(t: Column) -> Column:
    return F.concat(_S("$$"), F.when(is_latex(t), t).otherwise(rebuild(t)), _S("$$"))


def _bracket(t: Column) -> Column:
    return F.concat(_S("["), F.col("type"), _S(": "), t, _S("]"))


def _has_chart() -> Column:
    return F.coalesce(F.size("chart") > 0, _S(False))


def _class_of(x: Column) -> Column:
    several = x["class_candidates"].isNotNull() & (F.size(x["class_candidates"]) > 0) & (x["class_candidates"] != F.array(x["class"]))
    return F.when(several, F.array_join(x["class_candidates"].cast("array<string>"), "/")).otherwise(x["class"].cast("string"))


def _tolerance(x: Column, sign: str) -> Column:
    t = x["depth_tolerance"]
    return F.when(t.isNotNull() & (t != 0), F.concat(_S(f" {sign}"), t.cast("string"))).otherwise("")


def _panels() -> Column:
    return F.array_sort(F.array_distinct(F.transform("chart", lambda x: F.coalesce(x["panel_id"], _S("?")))))


def _items(panel: Column, kind: str, *by: str) -> Column:
    own = F.filter("chart", lambda x: (x["item_type"] == kind) & (F.coalesce(x["panel_id"], _S("?")) == panel))
    keyed = F.transform(own, lambda x: F.struct(*[x[k].alias(f"k{i}") for i, k in enumerate(by)], x.alias("x")))
    return F.transform(F.array_sort(keyed, lambda a, b: _by_keys(a, b, len(by))), lambda s: s["x"])


def _by_keys(a: Column, b: Column, n: int) -> Column:
    out = _S(0)
    for i in reversed(range(n)):
        out = F.when(a[f"k{i}"] < b[f"k{i}"], -1).when(a[f"k{i}"] > b[f"k{i}"], 1).otherwise(out)
    return out


def _lines(rows: Column) -> Column:
    return F.array_join(F.filter(rows, lambda r: r.isNotNull()), "\n")


def chart_markdown(t: Column) -> Column:
    """Tables of a chart's panels, intervals and points in numerical order of class."""

    def panel(p: Column) -> Column:
        bars, points = _items(p, "interval", "class", "start_depth"), _items(p, "point", "class", "depth")
        bar = F.transform(bars, lambda x: F.concat(_S("| "), x["class"], _S(" | "), x["start_depth"], _tolerance(x, "+/- "), _S(" | "), x["end_depth"], _tolerance(x, "+/- "), _S(" |")))
        dot = F.transform(points, lambda x: F.concat(_S("| "), _class_of(x), _S(" | "), x["depth"], _tolerance(x, "+/- "), _S(" |")))
        some = lambda rows, head: F.when(F.size(rows) > 0, F.concat(_S(head), F.array_join(rows, "\n")))
        return _lines(F.array(F.concat(_S("\n### Panel "), p), some(bar, "\n| Class | Start Depth | End Depth |\n| --- | ---: | ---: |\n"), some(dot, "\n| Class | Depth |\n| --- | ---: |\n")))

    head = F.concat(_S("[Figure: page="), F.col("page_no") + 1, _S(", bbox="), bbox_text(_box()), _S("]"))
    body = F.array_join(F.transform(_panels(), panel), "\n")
    return F.concat(_lines(F.array(head, body, F.when(t != "", F.concat(_S("\n*"), t, _S("*"))))), _S("\n"))


def chart_listing() -> Column:
    """A chart by panels, one line of intervals and one of points."""

    def panel(p: Column) -> Column:
        bars = F.transform(_items(p, "interval", "class", "start_depth"), lambda x: F.concat(_S("class "), x["class"], _S(" depth "), x["start_depth"], _S("-"), x["end_depth"], _tolerance(x, "+/- ")))
        dots = F.transform(_items(p, "point", "class", "depth"), lambda x: F.concat(_S("class "), _class_of(x), _S(" depth "), x["depth"], _tolerance(x, "+/- ")))
        some = lambda rows, head: F.when(F.size(rows) > 0, F.concat(_S(head), F.array_join(rows, "; ")))
        return _lines(F.array(F.concat(_S("  panel "), p, _S(":")), some(bars, "    intervals: "), some(dots, "    points: ")))

    return F.concat(_S("chart_data:\n"), F.array_join(F.transform(_panels(), panel), "\n"))


def chart_compact() -> Column:
    """A chart in one line a panel; classes sort as strings."""

    def panel(p: Column) -> Column:
        bars = _items(p, "interval", "start_depth")
        classes = F.array_sort(F.array_distinct(F.transform(bars, lambda x: x["class"].cast("string"))))
        span = lambda x: F.concat(x["start_depth"].cast("string"), _S("-"), x["end_depth"].cast("string"), _tolerance(x, "±"))
        by_class = F.transform(classes, lambda c: F.concat(c, _S(": "), F.array_join(F.transform(F.filter(bars, lambda x: x["class"].cast("string") == c), span), ", ")))
        dots = F.transform(_items(p, "point", "depth"), lambda x: F.concat(_class_of(x), _S(":"), x["depth"].cast("string"), _tolerance(x, "±")))
        points = F.when(F.size(dots) > 0, F.array(F.concat(_S("pts("), F.array_join(dots, ", "), _S(")")))).otherwise(F.array().cast("array<string>"))
        return F.concat(_S("[CHART "), p, _S("] "), F.array_join(F.concat(by_class, points), "; "))

    return F.array_join(F.transform(_panels(), panel), "\n")


def table_to_tsv(text: Column) -> Column:
    """A Markdown table with tabs between cells and its size; escaped pipes part cells as well."""
    lines = F.filter(F.transform(F.split(strip(text), "\n"), strip), lambda x: x.rlike(r"(?s)^\|(?:.*\|)?$"))
    parts = F.transform(lines, lambda x: F.split(x, r"\|"))
    rows = F.transform(parts, lambda p: F.transform(F.slice(p, _S(2), F.greatest(F.size(p) - 2, _S(0))), strip))
    rows = F.filter(rows, lambda r: ~F.forall(r, lambda c: c.rlike("^[-: ]*$")))
    size = F.concat(_S("[TABLE rows="), F.size(rows), _S(" cols="), F.array_max(F.transform(rows, F.size)), _S("]\n"))
    found = F.concat(size, F.array_join(F.transform(rows, lambda r: F.array_join(r, "\t")), "\n"), _S("\n[/TABLE]"))
    return F.when(F.size(rows) > 0, found).otherwise(F.concat(_S("[TABLE]\n"), strip(text), _S("\n[/TABLE]")))


def _lang(blocks: DataFrame) -> Column:
    return lang_tag(F.coalesce(F.bool_or(has_tag_cjk(F.col("text"))), _S(False)), F.coalesce(F.bool_or(F.col("text").rlike("[A-Za-z]")), _S(False)))


def _joined(blocks: DataFrame, rendered: Column, between: str, *, head: Column, page: Column, tail: str, name: str, extra=(), before: Column | None = None) -> DataFrame:
    """Strings of blocks by page, and pages by document; ``before`` goes in front of a block that has one before it."""
    base = _full(blocks).withColumn("_s", rendered)
    if before is not None:
        kept = Window.partitionBy("doc_id", "page_no").orderBy("pos")
        shown = F.when(F.coalesce(F.col("_s") != "", _S(False)), F.col("type"))
        base = base.withColumn("_p", F.last(shown, ignorenulls=True).over(kept.rowsBetween(Window.unboundedPreceding, -1)))
        base = base.withColumn("_s", F.when(F.col("_s") != "", F.concat(before, F.col("_s"))))
    strings = F.transform(F.filter(F.sort_array(F.collect_list(F.struct("pos", "_s"))), lambda x: F.coalesce(x["_s"] != "", _S(False))), lambda x: x["_s"])
    pages = base.groupBy("doc_id", "page_no").agg(F.concat(F.array(F.first("width").cast("string")), strings).alias("_all"), F.first("width").alias("width"), F.first("height").alias("height"), _lang(base).alias("_l"), F.first("src").alias("src"))
    body = F.array_join(F.concat(F.array(page), F.slice("_all", _S(2), F.size("_all") - 1)), between)
    pages = pages.withColumn("_body", F.concat(body, _S(tail)))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "_body"))), lambda x: x["_body"]), between)
    cjk, latin = F.bool_or(F.col("_l").isin("zh", "zh+en")), F.bool_or(F.col("_latin"))
    pages = pages.withColumn("_latin", F.col("_l") != "zh")
    docs = pages.groupBy("doc_id").agg(whole.alias("_w"), F.count("*").alias("_n"), cjk.alias("_c"), latin.alias("_e"), F.first("src").alias("src"))
    docs = docs.withColumn("_lang", F.when(F.col("_c") & F.col("_e"), "zh+en").when(F.col("_c"), "zh").otherwise("en"))
    out = docs.select("doc_id", F.concat(strip(F.concat(head, F.col("_w"))), _S("\n")).alias(name))
    return out if not extra else out.join(blocks.groupBy("doc_id").agg(*extra), "doc_id")


def markdown_block() -> Column:
    t, kind = strip(F.col("text")), F.col("type")
    return (
        F.when(kind == "title", F.concat(_S("# "), t)).when(kind == "heading", F.concat(_S("## "), t))
        .when(kind == "table", F.when(t == "", _placeholder("Table", t)).otherwise(t))
        .when(kind == "figure", F.when(_has_chart(), chart_markdown(t)).otherwise(_placeholder("Figure", t)))
        .when(kind == "formula", _formula(t)).when(kind.isin("uncertain", "placeholder", "header", "footer"), _bracket(t)).otherwise(t)
    )


def markdown(blocks: DataFrame, extra=()) -> DataFrame:
    return _joined(blocks, markdown_block(), "\n\n", head=_S(""), page=F.concat(_S("# Page "), F.col("page_no") + 1), tail="", name="markdown", extra=extra)


def text_block() -> Column:
    t, kind = strip(F.col("text")), F.col("type")
    drawn = F.concat(_S("[Formula: page="), F.col("page_no") + 1, _S(", bbox="), bbox_text(_box()), _S(", text="), F.when(t == "", "not detected").otherwise(t), _S("]"))
    return (
        F.when(kind == "figure", F.when(_has_chart(), chart_listing()).otherwise(_placeholder("Figure", t)))
        .when(kind == "formula", drawn).when(kind.isin("uncertain", "placeholder", "header", "footer"), _bracket(t)).otherwise(t)
    )


def plain_text(blocks: DataFrame) -> DataFrame:
    title = F.concat(_S("Page "), F.col("page_no") + 1)
    return _joined(blocks, text_block(), "\n\n", head=_S(""), page=F.concat(title, _S("\n\n"), F.repeat(_S("="), F.length(title))), tail="\n\n", name="text")


def _size() -> Column:
    has = F.coalesce((F.col("width") > 0) & (F.col("height") > 0), _S(False))
    return F.when(has, F.concat(_S(" size="), F.bround("width").cast("bigint"), _S("x"), F.bround("height").cast("bigint"))).otherwise("")


def _confidence() -> Column:
    return F.when(F.col("confidence").isNotNull(), F.concat(_S(" conf="), F.bround("confidence", 1).cast("string"))).otherwise("")


def _pilcrow(*kinds: str) -> Column:
    return F.when(F.col("_p").isin(*kinds) & F.col("type").isin(*kinds), "¶\n").otherwise("")


def _source() -> Column:
    return F.coalesce(F.col("src"), F.col("doc_id").cast("string"))


def compact(blocks: DataFrame) -> DataFrame:
    """Text protocol v2: a head, then type, confidence and text of each block."""
    s, kind = squeeze(F.col("text")), F.col("type")
    figure = F.concat(chart_compact(), F.when(s != "", F.concat(_S("\nfig_note→ "), s)).otherwise(""))
    plain = F.concat(kind, _confidence(), _S("→ "), s)
    block = (
        F.when((kind == "table") & (s != ""), table_to_tsv(F.col("text"))).when((kind == "figure") & _has_chart(), figure).when(kind == "formula", _formula(s))
        .when((s != "") | kind.isin("figure", "table"), plain)
    )
    head = F.concat(_S("LEAFMILL_TEXT v2\n---\nsrc: "), _source(), _S("\npgs: "), F.col("_n"), _S("\nlang: "), F.col("_lang"), _S("\n---\n"))
    return _joined(blocks, block, "\n", head=head, page=F.concat(_S("\n[page "), F.col("page_no") + 1, _size(), _S("]")), tail="", name="text", before=_pilcrow(*TEXT_LIKE, "header", "footer"))


def legacy(blocks: DataFrame) -> DataFrame:
    """Text protocol v1."""
    blocks = blocks.withColumn("_q", squeeze(F.col("text")))
    s, kind = F.col("_q"), F.col("type")
    figure = F.concat(chart_listing(), F.when(s != "", F.concat(_S("\nfigure_note: "), s)).otherwise(""))
    block = F.when((kind == "figure") & _has_chart(), figure).when((s != "") | kind.isin("figure", "table", "formula"), F.concat(kind, _confidence(), _S(": "), s))
    head = F.concat(_S("LEAFMILL_TEXT v1\nsource: "), _source(), _S("\npages: "), F.col("_n"), _S("\n"))
    return _joined(blocks, block, "\n", head=head, page=F.concat(_S("\n[page "), F.col("page_no") + 1, _size(), _S("]")), tail="", name="text")


def lean_block() -> Column:
    s, kind = squeeze(F.col("text")), F.col("type")
    figure = F.concat(chart_compact(), F.when(s != "", F.concat(_S("\nfig_note→ "), s)).otherwise(""))
    return (
        F.when(kind == "title", F.concat(_S("# "), s)).when(kind == "heading", F.concat(_S("## "), s)).when(kind == "table", table_to_tsv(F.col("text")))
        .when((kind == "figure") & _has_chart(), figure).when((kind == "figure") & (s != ""), F.concat(_S("[FIG] "), s)).when(kind == "figure", "")
        .when(kind == "formula", _formula(s)).when(kind.isin("header", "footer"), F.concat(_S("["), kind, _S("] "), s)).otherwise(s)
    )


def lean(blocks: DataFrame) -> DataFrame:
    """The shortest form: no confidences, paragraphs parted by a pilcrow."""
    head = F.concat(_S("---\nsrc: "), _source(), _S("\npgs: "), F.col("_n"), _S("\nlang: "), F.col("_lang"), _S("\n---\n"))
    return _joined(blocks, lean_block(), "\n", head=head, page=F.concat(_S("\n[page "), F.col("page_no") + 1, _S("]")), tail="", name="text", before=_pilcrow(*TEXT_LIKE))


def heading_levels(blocks: DataFrame) -> DataFrame:
    """Adds level: 1 for titles, 2 for a heading that comes first of all in its document, 3 for other headings."""
    mark = F.col("type").isin("title", "heading")
    order = F.struct("page_no", "pos")
    first = F.min(F.when(mark, order)).over(Window.partitionBy("doc_id"))
    return blocks.withColumn("level", F.when(F.col("type") == "title", 1).when((F.col("type") == "heading") & (order == first), 2).when(F.col("type") == "heading", 3))


def context(blocks: DataFrame) -> DataFrame:
    """Adds before and after: the first 200 characters of the nearest text blocks with text on the page."""
    told = F.when(F.col("type").isin("paragraph", "list", "heading", "title"), F.nullif(F.substring(squeeze(F.col("text")), 1, 200), _S("")))
    page = Window.partitionBy("doc_id", "page_no").orderBy("pos")
    past, future = page.rowsBetween(Window.unboundedPreceding, -1), page.rowsBetween(1, Window.unboundedFollowing)
    held = blocks.withColumn("_t", told)
    return held.withColumns({"before": F.coalesce(F.last("_t", True).over(past), _S("")), "after": F.coalesce(F.first("_t", True).over(future), _S(""))}).drop("_t")


_STEP = "struct<count:int,breaks:array<boolean>>"


def chunks(blocks: DataFrame, size: int = 2000) -> DataFrame:
    """(doc_id, text, n_chunks): retrieval text with chunk marks and context around tables and figures.

    A chunk ends before a title or heading, and before a block that would take
    it over ``size`` characters; the count goes on over pages.
    """
    page = Window.partitionBy("doc_id", "page_no").orderBy("pos")
    made = context(heading_levels(_full(blocks))).withColumn("_s", F.when(F.col("level").isNotNull(), F.concat(F.repeat(_S("#"), F.col("level")), _S(" "), squeeze(F.col("text")))).otherwise(lean_block()))
    made = made.withColumn("_shown", F.coalesce(F.col("_s") != "", _S(False)))
    made = made.withColumn("_p", F.last(F.when(F.col("_shown"), F.col("type")), True).over(page.rowsBetween(Window.unboundedPreceding, -1)))
    data = F.col("type").isin("table", "figure")
    told = lambda c: F.when(F.col("_shown") & data & (F.col(c) != ""), F.concat(_S("[CONTEXT] "), F.col(c))).otherwise("")
    made = made.withColumns({"_b": told("before"), "_a": told("after"), "_mark": F.when(F.col("_p").isin(*TEXT_LIKE) & F.col("type").isin(*TEXT_LIKE), 1).otherwise(0), "_head": F.col("level").isNotNull()})
    row = F.struct("page_no", "pos", "_shown", "_s", "_b", "_a", "_mark", "_head")
    docs = made.groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("own"), F.count_distinct("page_no").alias("_n"), _lang(made).alias("_lang"), F.first("src").alias("src"))

    def step(acc: Column, b: Column) -> Column:
        length = F.length(b["_s"])
        cut = b["_shown"] & (acc["count"] > 0) & (b["_head"] | (acc["count"] + length > size))
        count = F.when(cut, 0).otherwise(acc["count"])
        more = F.length(b["_b"]) + F.length(b["_a"]) + b["_mark"] + length
        return F.struct(F.when(b["_shown"], count + more).otherwise(acc["count"]).cast("int").alias("count"), F.concat(acc["breaks"], F.array(cut)).alias("breaks")).cast(_STEP)

    start = F.struct(_S(0).alias("count"), F.array().cast("array<boolean>").alias("breaks")).cast(_STEP)
    docs = docs.withColumn("cuts", F.aggregate("own", start, step)["breaks"])

    def string(b: Column, i: Column) -> Column:
        turn = (i == 0) | (F.get("own", i - 1)["page_no"] != b["page_no"])
        head = F.when(turn, F.concat(_S("\n<!-- src_page="), b["page_no"] + 1, _S(" -->\n[page "), b["page_no"] + 1, _S("]")))
        some = lambda c: F.when(c != "", c)
        body = F.array(F.when(F.get("cuts", i), "<!-- CHUNK -->"), some(b["_b"]), F.when(b["_mark"] == 1, "¶"), b["_s"], some(b["_a"]))
        return _lines(F.concat(F.array(head), F.when(b["_shown"], body).otherwise(F.array().cast("array<string>"))))

    strings = F.filter(F.transform("own", string), lambda x: x != "")
    head = F.concat(_S("---\nsrc: "), _source(), _S("\npgs: "), F.col("_n"), _S("\nlang: "), F.col("_lang"), _S("\n---\n"))
    return docs.select("doc_id", F.concat(strip(F.concat(head, F.array_join(strings, "\n"))), _S("\n")).alias("text"), (F.size(F.filter("cuts", lambda c: c)) + 1).alias("n_chunks"))


def json_documents(blocks: DataFrame) -> DataFrame:
    """(doc_id, json): pages and blocks in reading order, nulls kept."""
    fields = ["type", "text", *[c for c in ("confidence",) if c in blocks.columns]]
    box = F.when(F.col("x0").isNotNull(), F.array("x0", "y0", "x1", "y1")).alias("bbox")
    own = _full(blocks).withColumn("_b", F.struct(*fields, box))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "_b"))), lambda x: x["_b"])
    pages = own.groupBy("doc_id", "page_no").agg(F.first("width").alias("width"), F.first("height").alias("height"), listed.alias("blocks"))
    page = F.struct((F.col("page_no") + 1).alias("number"), "width", "height", "blocks")
    whole = F.transform(F.sort_array(F.collect_list(F.struct("page_no", page.alias("p")))), lambda x: x["p"])
    docs = pages.groupBy("doc_id").agg(whole.alias("pages"))
    return docs.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("source"), "pages"), {"ignoreNullFields": "false"}).alias("json"))
