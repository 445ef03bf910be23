"""Queries on page layout and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import layout, order, render, tables
from leafmill.plans import relations as R
from leafmill.plans.relations import LINES, ORDERED, TYPED, WS, lines, matches, squeeze_sql, strip_sql, table
from leafmill.plans.text_queries import typed

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_BARE = "replace(replace(t, '-', ''), '—', '')"
_ZONED = f""", zoned AS (SELECT * REPLACE (CASE WHEN num OR (low AND type NOT IN ('figure', 'table', 'formula', 'placeholder')) THEN 'footer'
        WHEN NOT low AND y0 / 792 < 0.06 AND type NOT IN ('figure', 'table', 'title', 'formula', 'placeholder', 'heading') AND length(t) < 60 THEN 'header' ELSE type END AS type), CASE WHEN num THEN 'page_number' END AS role
    FROM (SELECT *, y1 / 792 > 0.94 AS low, y1 / 792 > 0.94 AND (x1 - x0) / 792 < 0.08 AND {matches(_BARE, '[0-9]')} AND 2 * (length({_BARE}) - length(regexp_replace({_BARE}, '[0-9]', '', 'g'))) >= length({_BARE}) AS num FROM typed))"""
_TITLED = """, titled AS (SELECT * REPLACE (CASE WHEN abs((x0 + x1) / 2 - 306) / 612 < 0.15 AND y0 < 122.4 AND (type = 'heading' OR (type = 'paragraph' AND length(t) <= 80)) THEN 'title' ELSE type END AS type) FROM {src})"""
_KEYS = "doc_id, page_no, block_seq"


@query(f"WITH {LINES} {TYPED} {_ZONED} SELECT {_KEYS}, type, role FROM zoned")
def layout_zones(spark, sf_dir):
    return layout.zones(typed(spark, sf_dir), R.HEIGHT).select("doc_id", "page_no", "block_seq", "type", "role")


@query(f"WITH {LINES} {TYPED} {_TITLED.format(src='typed')} SELECT {_KEYS}, type FROM titled")
def title_promotion(spark, sf_dir):
    return layout.titles(typed(spark, sf_dir), R.WIDTH).select("doc_id", "page_no", "block_seq", "type")


@query(f"""
    WITH {LINES} {TYPED}
    SELECT {_KEYS}, CASE WHEN type IN ('paragraph', 'heading') AND {matches('t', f'^([0-9]+[.、)]|[-*+•·]|[[]{WS}*x?{WS}*[]]|[(（][0-9]+[)）]|[A-Z][.、)]){WS}+')} THEN 'list' WHEN type = 'uncertain' AND confidence >= 60 THEN 'paragraph' ELSE type END AS type FROM typed""")
def type_consistency(spark, sf_dir):
    return layout.consistent(typed(spark, sf_dir)).select("doc_id", "page_no", "block_seq", "type")


@query(f"""
    WITH {LINES}, v AS (SELECT {_KEYS}, {strip_sql('text')} AS t, 10.0 + block_seq % 3 * 6 AS w, 14.0 + block_seq % 4 * 9 AS h FROM lines)
    SELECT {_KEYS}, CASE WHEN h > w * 1.5 AND length(t) >= 2 AND 10 * (length(t) - length(regexp_replace(t, '[{R.CJK}]', '', 'g'))) > 4 * length(t) THEN 'vertical' END AS direction FROM v""")
def vertical_text(spark, sf_dir):
    tall = lines(spark, sf_dir).withColumns({"x1": F.col("x0") + 10.0 + F.col("block_seq") % 3 * 6, "y1": F.col("y0") + 14.0 + F.col("block_seq") % 4 * 9})
    return layout.vertical(tall).select("doc_id", "page_no", "block_seq", "direction")


_SPLIT = f"""{_ZONED}, centres AS (SELECT doc_id, page_no, block_seq, (x0 + x1) / 2 AS c FROM zoned WHERE x1 - x0 < 306 AND type NOT IN ('header', 'footer') AND coalesce(role, '') <> 'page_number'),
    gaps AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY doc_id, page_no) AS n, lead(c) OVER w - c AS gap, (c + lead(c) OVER w) / 2 AS mid FROM centres WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY c, block_seq)),
    best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY gap DESC NULLS LAST, k) AS r FROM gaps),
    split AS (SELECT doc_id, page_no, mid AS split_x FROM best WHERE r = 1 AND n >= 6 AND gap > 91.8 AND k >= 3 AND n - k >= 3)"""


@query(f"WITH {LINES} {TYPED} {_SPLIT} SELECT doc_id, page_no, split_x FROM split")
def column_split(spark, sf_dir):
    return order.column_split(layout.zones(typed(spark, sf_dir), R.HEIGHT), R.WIDTH)


@query(f"""
    WITH {LINES} {TYPED} {_SPLIT},
    o AS (SELECT z.*, split_x, row_number() OVER (PARTITION BY z.doc_id, z.page_no ORDER BY round_even(y0 / 12, 0) * 12, x0, {R.PRIORITY_SQL.format(t='type')}, block_seq) AS plain FROM zoned z LEFT JOIN split s ON z.doc_id = s.doc_id AND z.page_no = s.page_no)
    SELECT {_KEYS}, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY CASE WHEN split_x IS NULL THEN plain WHEN (x0 + x1) / 2 < split_x THEN 0 ELSE 1 END, y0, x0, block_seq) AS INTEGER) AS pos FROM o""")
def reading_order_2col(spark, sf_dir):
    return order.two_column_order(layout.zones(typed(spark, sf_dir), R.HEIGHT), R.WIDTH).select("doc_id", "page_no", "block_seq", "pos")


@query()
def projection_columns(spark, sf_dir):
    """Columns from the x projection: a fold over pixels, held against a plain version in the tests."""
    return order.projection_columns(typed(spark, sf_dir).withColumn("width", F.lit(R.WIDTH))).select("doc_id", "page_no", "block_seq", "pos")


@query(f"""
    WITH {LINES}, g AS (SELECT *, y0 - lag(y1) OVER (PARTITION BY doc_id, page_no ORDER BY y0, block_seq) AS gap FROM lines),
    m AS (SELECT doc_id, page_no, avg(CASE WHEN gap > 0 THEN gap END) AS mean FROM g GROUP BY 1, 2),
    a AS (SELECT l.doc_id, l.page_no, l.block_seq, l.y0, l.y1, mean, arg_max(b.y1, b.y0 * 1000 + b.block_seq % 1000) FILTER (b.y1 < l.y0) AS above, arg_min(b.y0, b.y0 * 1000 + b.block_seq % 1000) FILTER (b.y0 > l.y1) AS below
          FROM lines l JOIN m USING (doc_id, page_no) JOIN lines b USING (doc_id, page_no) GROUP BY ALL)
    SELECT {_KEYS}, CAST(floor(1000000 * CASE WHEN mean IS NULL THEN 0 ELSE (least((CASE WHEN above > 0 THEN y0 - above ELSE y0 END) / mean, 3) + least((CASE WHEN below < 792 THEN below - y1 ELSE 792 - y1 END) / mean, 3)) / 6 END + 0.5) AS BIGINT) AS isolation_ppm FROM a""")
def isolation_score(spark, sf_dir):
    found = layout.isolation(lines(spark, sf_dir), R.HEIGHT)
    return found.select("doc_id", "page_no", "block_seq", F.floor(F.col("isolation") * 1000000 + 0.5).alias("isolation_ppm"))


@query()
def layout_pipeline(spark, sf_dir):
    """All layout steps in order; each of them has a query of its own with SQL."""
    return layout.enhance(typed(spark, sf_dir), R.WIDTH, R.HEIGHT).select("doc_id", "page_no", "block_seq", "type", "role", "direction", "pos")


@query(f"""
    WITH {LINES} {TYPED} {_ZONED}
    SELECT doc_id, page_no, count(*) AS block_count, bool_or(type = 'table') AS has_tables, bool_or(type = 'figure') AS has_figures, bool_or(type = 'header') AS has_headers, bool_or(type = 'footer') AS has_footers, CAST(sum(length(text)) AS BIGINT) AS text_length FROM zoned GROUP BY 1, 2""")
def page_summary(spark, sf_dir):
    return layout.page_summary(layout.zones(typed(spark, sf_dir), R.HEIGHT))


_DATA = "CASE WHEN contains(text, ' | ') THEN 'table' ELSE type END"


def _with_tables(spark, sf_dir):
    blocks = typed(spark, sf_dir)
    return order.default_order(blocks.withColumn("type", F.when(F.col("text").contains(" | "), "table").otherwise(F.col("type"))))


_TABLED = f""", tabled AS (SELECT * REPLACE ({_DATA} AS type) FROM typed), placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY round_even(y0 / 12, 0) * 12, x0, {R.PRIORITY_SQL.format(t='type')}, block_seq) AS pos FROM tabled)"""


@query(f"""
    WITH {LINES} {TYPED} {_TABLED}, k AS (SELECT *, CASE WHEN type IN ('paragraph', 'list', 'heading', 'title') AND {squeeze_sql('text')} <> '' THEN substr({squeeze_sql('text')}, 1, 200) END AS s FROM placed),
    c AS (SELECT doc_id, page_no, block_seq, type, last_value(s IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(s IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM k WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY pos))
    SELECT {_KEYS}, coalesce(b, '') AS before, coalesce(a, '') AS after FROM c WHERE type = 'table'""")
def context_window(spark, sf_dir):
    return render.context(_with_tables(spark, sf_dir)).where("type = 'table'").select("doc_id", "page_no", "block_seq", "before", "after")


@query(f"""
    WITH {LINES} {TYPED} {_TITLED.format(src='typed')}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY round_even(y0 / 12, 0) * 12, x0, {R.PRIORITY_SQL.format(t='type')}, block_seq) AS pos FROM titled),
    h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, pos) AS k FROM o WHERE type IN ('title', 'heading'))
    SELECT {_KEYS}, CAST(CASE WHEN type = 'title' THEN 1 WHEN k = 1 THEN 2 ELSE 3 END AS INTEGER) AS level FROM h""")
def heading_levels(spark, sf_dir):
    return render.heading_levels(order.default_order(layout.titles(typed(spark, sf_dir), R.WIDTH))).where("level IS NOT NULL").select("doc_id", "page_no", "block_seq", "level")


@query()
def rag_chunks(spark, sf_dir):
    """A fold that starts anew when a chunk is full; held against a Python version in the tests."""
    return render.chunks(_with_tables(spark, sf_dir))


@query(f"""
    WITH {LINES} {TYPED} {_TABLED}, k AS (SELECT doc_id, page_no, pos, type, {squeeze_sql('text')} AS s, confidence FROM placed),
    p AS (SELECT doc_id, page_no, string_agg(chr(10) || type || ' conf=' || confidence || ': ' || s, '' ORDER BY pos) AS s FROM k WHERE s <> '' OR type = 'table' GROUP BY 1, 2),
    a AS (SELECT DISTINCT doc_id, page_no FROM typed)
    SELECT doc_id, {strip_sql("'LEAFMILL_TEXT v1' || chr(10) || 'source: ' || doc_id || chr(10) || 'pages: ' || count(*) || string_agg(chr(10) || chr(10) || '[page ' || (page_no + 1) || ']' || coalesce(s, ''), '' ORDER BY page_no)")} || chr(10) AS text
    FROM a LEFT JOIN p USING (doc_id, page_no) GROUP BY 1""")
def render_legacy(spark, sf_dir):
    return render.legacy(_with_tables(spark, sf_dir))


@query(f"""
    WITH {LINES} {TYPED} {_TABLED},
    k AS (SELECT doc_id, page_no, pos, type, CASE type WHEN 'heading' THEN '## ' || {squeeze_sql('text')} WHEN 'table' THEN '[TABLE]' || chr(10) || {strip_sql('text')} || chr(10) || '[/TABLE]' ELSE {squeeze_sql('text')} END AS s FROM placed),
    f AS (SELECT *, type <> 'table' AND coalesce(lag(type) OVER (PARTITION BY doc_id, page_no ORDER BY pos) <> 'table', false) AS parted FROM k WHERE s <> ''),
    p AS (SELECT doc_id, page_no, string_agg(CASE WHEN parted THEN chr(10) || '¶' ELSE '' END || chr(10) || s, '' ORDER BY pos) AS s FROM f GROUP BY 1, 2),
    a AS (SELECT DISTINCT doc_id, page_no FROM typed),
    l AS (SELECT doc_id, bool_or(regexp_matches(text, '[一-鿿\\x{{3040}}-\\x{{30ff}}가-\\x{{d7af}}]')) AS c, bool_or(regexp_matches(text, '[A-Za-z]')) AS e FROM lines GROUP BY doc_id)
    SELECT doc_id, {strip_sql("'---' || chr(10) || 'src: ' || doc_id || chr(10) || 'pgs: ' || count(*) || chr(10) || 'lang: ' || CASE WHEN any_value(c) AND any_value(e) THEN 'zh+en' WHEN any_value(c) THEN 'zh' ELSE 'en' END || chr(10) || '---' || string_agg(chr(10) || chr(10) || '[page ' || (page_no + 1) || ']' || coalesce(s, ''), '' ORDER BY page_no)")} || chr(10) AS text
    FROM a LEFT JOIN p USING (doc_id, page_no) JOIN l USING (doc_id) GROUP BY 1""")
def render_lean(spark, sf_dir):
    return render.lean(_with_tables(spark, sf_dir))


@query(f"""
    WITH {LINES} {TYPED} {ORDERED},
    p AS (SELECT doc_id, page_no, CAST(struct_pack(number := page_no + 1, width := 612.0::DOUBLE, height := 792.0::DOUBLE, blocks := list(struct_pack(type := type, text := text, confidence := confidence, bbox := [x0, y0, x1, y1]) ORDER BY pos)) AS JSON) AS page FROM ordered GROUP BY 1, 2)
    SELECT doc_id, CAST(count(*) AS BIGINT) AS n_pages, '{{"source":' || doc_id || ',"pages":[' || string_agg(CAST(page AS VARCHAR), ',' ORDER BY page_no) || ']}}' AS json FROM p GROUP BY 1""")
def doc_json_summary(spark, sf_dir):
    blocks = order.default_order(typed(spark, sf_dir)).withColumns({"width": F.lit(R.WIDTH), "height": F.lit(R.HEIGHT)})
    return render.json_documents(blocks).join(blocks.groupBy("doc_id").agg(F.count_distinct("page_no").alias("n_pages")), "doc_id").select("doc_id", "n_pages", "json")


# Tables


def _tabbed(spark, sf_dir):
    """Documents as lists of lines, ' | ' read as a tab."""
    return lines(spark, sf_dir).withColumn("text", F.replace("text", F.lit(" | "), F.lit("\t")))


@query(f"""
    WITH {LINES}, c AS (SELECT doc_id, block_seq, CASE WHEN contains(x, chr(9)) THEN list_filter(list_transform(string_split(x, chr(9)), lambda y: {strip_sql('y')}), lambda y: y <> '') ELSE list_filter(list_transform(string_split_regex(x, '{WS}{{2,}}'), lambda y: {strip_sql('y')}), lambda y: y <> '') END AS cs
         FROM (SELECT doc_id, block_seq, {strip_sql("replace(text, ' | ', chr(9))")} AS x FROM lines) WHERE x <> ''),
    d AS (SELECT doc_id, list(cs ORDER BY block_seq) AS rs FROM c GROUP BY 1),
    s AS (SELECT *, list_filter(list_transform(rs, lambda r: len(r)), lambda n: n >= 2) AS sizes, list_max(list_transform(rs, lambda r: len(r))) AS wide FROM d)
    SELECT doc_id, CAST(len(rs) AS INTEGER) AS n_rows, CAST(wide AS INTEGER) AS n_cols, len(rs) >= 2 AND len(sizes) >= 2 AND len(list_distinct(sizes)) <= 2 AS is_table FROM s""")
def line_tables(spark, sf_dir):
    return tables.line_tables(_tabbed(spark, sf_dir)).select("doc_id", "n_rows", "n_cols", "is_table")


_GRID = """, grid AS (SELECT * REPLACE (CAST(40 + 18 * (block_seq % 40 // 2) AS DOUBLE) AS y0, CAST(52 + 18 * (block_seq % 40 // 2) AS DOUBLE) AS y1) FROM lines)"""


def _grid(spark, sf_dir):
    y0 = (40 + 18 * F.floor(F.col("block_seq") % 40 / 2)).cast("double")
    return lines(spark, sf_dir).withColumns({"y0": y0, "y1": y0 + 12})


@query("""
    WITH e AS (SELECT user_id, value, event_id, CASE WHEN value - lag(value) OVER w > 5 THEN 1 ELSE 0 END AS jump FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id)),
    c AS (SELECT *, sum(jump) OVER (PARTITION BY user_id ORDER BY value, event_id) AS cluster FROM e)
    SELECT user_id, CAST(cluster AS INTEGER) AS cluster, count(*) AS n, min(value) AS low, max(value) AS high FROM c GROUP BY 1, 2""")
def cluster_1d(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return tables.chain(events, ["user_id"], "value", F.lit(5.0), tie="event_id").groupBy("user_id", "cluster").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


_CELLS = ", ".join(f"({r}, {c}, {x0}, {y0}, {x1}, {y1})" for r, (y0, y1) in enumerate(((0, 150), (150, 300), (300, 520), (520, 700))) for c, (x0, x1) in enumerate(((0, 130), (130, 380), (380, 500), (500, 612))))


@query(f"""
    WITH {LINES}, cells(r, c, cx0, cy0, cx1, cy1) AS (VALUES {_CELLS}),
    o AS (SELECT {_KEYS}, r, c, greatest(least(x1, cx1) - greatest(x0, cx0), 0) * greatest(least(y1, cy1) - greatest(y0, cy0), 0) AS area, (x1 - x0) * (y1 - y0) AS own FROM lines, cells WHERE (x1 - x0) * (y1 - y0) > 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY area DESC, r, c) AS n FROM o)
    SELECT {_KEYS}, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c FROM k WHERE n = 1 AND area * 10 >= own""")
def cell_assignment(spark, sf_dir):
    cells = spark.sql(f"SELECT r, c, CAST(x0 AS DOUBLE) x0, CAST(y0 AS DOUBLE) y0, CAST(x1 AS DOUBLE) x1, CAST(y1 AS DOUBLE) y1 FROM VALUES {_CELLS} AS v(r, c, x0, y0, x1, y1)")
    pages = lines(spark, sf_dir).select("doc_id", "page_no").distinct()
    return tables.assign_cells(lines(spark, sf_dir), pages.join(F.broadcast(cells))).select("doc_id", "page_no", "block_seq", "r", "c")


_GAPS = f"""{_GRID}, size AS (SELECT doc_id, page_no, count(*) AS n, list_sort(list(y1 - y0))[CAST(count(*) // 2 AS INTEGER) + 1] AS high FROM grid GROUP BY 1, 2),
    xs AS (SELECT DISTINCT doc_id, page_no, x0 FROM grid), xj AS (SELECT xs.*, CASE WHEN x0 - lag(x0) OVER (PARTITION BY doc_id, page_no ORDER BY x0) > greatest(6, high * 0.5) THEN 1 ELSE 0 END AS jump FROM xs JOIN size USING (doc_id, page_no)),
    xc AS (SELECT *, sum(jump) OVER (PARTITION BY doc_id, page_no ORDER BY x0) AS c FROM xj), anchors AS (SELECT doc_id, page_no, c, CAST(trunc(avg(x0)) AS DOUBLE) AS ax FROM xc GROUP BY 1, 2, 3),
    ys AS (SELECT g.*, dense_rank() OVER (PARTITION BY g.doc_id, g.page_no ORDER BY y0) AS yr, count(*) OVER (PARTITION BY g.doc_id, g.page_no, y0) AS together FROM grid g),
    rows_ AS (SELECT doc_id, page_no, y0, yr, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y0) - 1 AS r FROM (SELECT DISTINCT doc_id, page_no, y0, yr FROM ys WHERE together >= 2)),
    fit AS (SELECT doc_id, page_no FROM size JOIN (SELECT doc_id, page_no, count(*) AS nr FROM rows_ GROUP BY 1, 2) USING (doc_id, page_no) JOIN (SELECT doc_id, page_no, count(*) AS na FROM anchors GROUP BY 1, 2) USING (doc_id, page_no) WHERE n >= 4 AND nr >= 3 AND na >= 2),
    near AS (SELECT y.doc_id, y.page_no, r, c, block_seq, x0, {strip_sql('text')} AS t, row_number() OVER (PARTITION BY y.doc_id, y.page_no, block_seq ORDER BY abs((x0 + x1) / 2 - ax), ax) AS k FROM ys y JOIN rows_ USING (doc_id, page_no, y0) JOIN anchors a ON a.doc_id = y.doc_id AND a.page_no = y.page_no JOIN fit ON fit.doc_id = y.doc_id AND fit.page_no = y.page_no),
    full_ AS (SELECT doc_id, page_no, r, c FROM rows_ JOIN fit USING (doc_id, page_no) JOIN anchors USING (doc_id, page_no)),
    cell AS (SELECT f.doc_id, f.page_no, CAST(f.r AS INTEGER) AS r, CAST(f.c AS INTEGER) AS c, coalesce(string_agg(t, ' ' ORDER BY x0, block_seq), '') AS text FROM full_ f LEFT JOIN near ON near.doc_id = f.doc_id AND near.page_no = f.page_no AND near.r = f.r AND near.c = f.c AND k = 1 GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {LINES} {_GAPS} SELECT doc_id, page_no, r, c, text FROM cell")
def gap_table_cells(spark, sf_dir):
    return tables.gap_tables(_grid(spark, sf_dir)).select("doc_id", "page_no", "r", "c", "text")


@query(f"""
    WITH {LINES} {_GAPS}, u AS (SELECT doc_id, page_no, r, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS a, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS k FROM cell),
    m AS (SELECT doc_id, page_no, avg(CASE WHEN r = 0 THEN CASE WHEN a = '' THEN 0 ELSE CAST(k AS DOUBLE) / length(a) END END) AS head, avg(CASE WHEN r > 0 THEN CASE WHEN a = '' THEN 0 ELSE CAST(k AS DOUBLE) / length(a) END END) AS rest FROM u GROUP BY 1, 2)
    SELECT doc_id, page_no, head > 0.5 AND head > rest * 1.5 AS is_header FROM m""")
def header_row(spark, sf_dir):
    ascii_only = tables.gap_tables(_grid(spark, sf_dir)).withColumn("text", F.regexp_replace("text", "[^\\x00-\\x7f]", ""))
    return tables.header_rows(ascii_only)


@query(f"""
    WITH {LINES}, t AS (SELECT doc_id, block_seq, list_transform(string_split(x, '|')[2:-2], lambda y: {strip_sql('y')}) AS cs FROM (SELECT doc_id, block_seq, '| ' || text || ' |' AS x FROM lines WHERE contains(text, ' | '))),
    k AS (SELECT * FROM t WHERE NOT list_bool_and(list_transform(cs, lambda y: regexp_matches(y, '^[-: ]*$'))))
    SELECT doc_id, '[TABLE rows=' || count(*) || ' cols=' || max(len(cs)) || ']' || chr(10) || string_agg(array_to_string(cs, chr(9)), chr(10) ORDER BY block_seq) || chr(10) || '[/TABLE]' AS tsv FROM k GROUP BY 1""")
def table_to_tsv(spark, sf_dir):
    rows = lines(spark, sf_dir).where(F.col("text").contains(" | ")).withColumn("row", F.concat(F.lit("| "), F.col("text"), F.lit(" |")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_seq", "row"))), lambda x: x["row"]), "\n")
    return rows.groupBy("doc_id").agg(text.alias("t")).select("doc_id", render.table_to_tsv(F.col("t")).alias("tsv"))
