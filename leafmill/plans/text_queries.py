"""Queries on texts, lines and words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import formula
from leafmill.functions import text as T
from leafmill.operators import lines as L
from leafmill.operators import render
from leafmill.operators.order import default_order
from leafmill.plans import relations as R
from leafmill.plans.relations import HAN, LINES, ORDERED, TYPED, WS, lines, matches, squeeze_sql, strip_sql, table
from leafmill.sources.text import text_to_blocks

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).withColumn("type", T.classify_ocr(F.col("text")))


_BLOCK_TEXTS = ((-1, "Main Title\n\nFirst line\nsecond line"), (-2, "Name  Amount\nAlice  42\nBob  7"), (-3, "a\tb\r\nc\td\te\rf\tg\n \t \n1. Numbered head\n\n\n- item one"), (-4, " \n "), (-5, "A thing|x  y|z\np|q  r"))
_BLOCK_VALUES = ", ".join("(%d, %s)" % (d, " || ".join(f"'{p}'" if p not in "\n\r\t" else f"chr({ord(p)})" for p in __import__("re").split("([\n\r\t])", t) if p)) for d, t in _BLOCK_TEXTS)


@query(f"""
    WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {_BLOCK_VALUES}) AS v(doc_id, text)),
    c AS (SELECT doc_id, {strip_sql("regexp_replace(coalesce(text, ''), chr(13) || chr(10) || '?', chr(10), 'g')")} AS t FROM d),
    p AS (SELECT doc_id, string_split_regex(t, '\\n{WS}*\\n+') AS parts FROM c),
    e AS (SELECT doc_id, unnest(range(len(parts))) AS block_seq, unnest(parts) AS raw FROM p),
    l AS (SELECT doc_id, block_seq, list_filter(list_transform(string_split_regex(raw, '[\\n\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {strip_sql('x')}), lambda x: x <> '') AS ls FROM e),
    r AS (SELECT *, list_transform(ls, lambda x: list_filter(list_transform(CASE WHEN contains(x, chr(9)) THEN string_split(x, chr(9)) ELSE string_split_regex(x, '{WS}{{2,}}') END, lambda y: {strip_sql('y')}), lambda y: y <> '')) AS rs FROM l WHERE len(ls) > 0),
    s AS (SELECT *, list_filter(list_transform(rs, lambda x: len(x)), lambda n: n >= 2) AS sizes, list_max(list_transform(rs, lambda x: len(x))) AS wide, array_to_string(ls, ' ') AS flat FROM r),
    q AS (SELECT *, len(ls) >= 2 AND len(sizes) >= 2 AND len(list_distinct(sizes)) <= 2 AS tab FROM s)
    SELECT doc_id, CAST(block_seq AS INTEGER) AS block_seq, CAST(len(ls) AS INTEGER) AS n_lines,
           CASE WHEN tab THEN 'table'
                WHEN len(ls) = 1 AND length(flat) BETWEEN 4 AND 65 AND NOT {matches('flat', '[.。?？!！:：]$')} AND ({matches('flat', f'^[0-9]+[.、)）]{WS}+[^ ]')} OR {matches(squeeze_sql('flat'), ' ')}) THEN 'heading'
                WHEN {matches('flat', f'^([0-9]+[.、)]|.){WS}+')} THEN 'list' ELSE 'paragraph' END AS type,
           CASE WHEN tab THEN array_to_string(list_concat(
                    ['| ' || array_to_string(list_concat(list_transform(rs[1], lambda c: replace(c, '|', '\\|')), list_transform(range(wide - len(rs[1])), lambda i: '')), ' | ') || ' |'],
                    ['| ' || array_to_string(list_transform(range(wide), lambda i: '---'), ' | ') || ' |'],
                    list_transform(rs[2:], lambda x: '| ' || array_to_string(list_concat(list_transform(x, lambda c: replace(c, '|', '\\|')), list_transform(range(wide - len(x)), lambda i: '')), ' | ') || ' |')), chr(10))
                ELSE flat END AS text
    FROM q""")
def text_to_blocks_(spark, sf_dir):
    extra = spark.createDataFrame(list(_BLOCK_TEXTS), "doc_id bigint, text string")
    return text_to_blocks(table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(extra)).select("doc_id", "block_seq", "n_lines", "type", "text")


@query(f"WITH {LINES} {TYPED} SELECT doc_id, block_seq, type FROM typed")
def classify_lines(spark, sf_dir):
    return typed(spark, sf_dir).select("doc_id", "block_seq", "type")


_SWAPPED = "translate({c}, '０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ', '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz')"
_close = lambda c: f"regexp_replace({c}, '([{HAN}]){WS}+([{HAN}])', '\\1\\2', 'g')"


@query(f"""
    WITH {LINES},
    a AS (SELECT doc_id, block_seq, {_SWAPPED.format(c=squeeze_sql('text'))} AS t FROM lines),
    b AS (SELECT doc_id, block_seq, translate({_close(_close('t'))}, '已未日人土干天王午右刀几凤帅币', '己末曰入士千夫玉牛石力九风师巾') AS t FROM a),
    c AS (SELECT doc_id, block_seq, replace(replace(replace(replace(replace(replace(t, '钼孔', '钻孔'), '钼 孔', '钻孔'), '/m 深度', '深度/m'), '深度 /m', '深度/m'), '真实 类别', '真实类别'), '预测 类别', '预测类别') AS t FROM b)
    SELECT doc_id, block_seq, regexp_replace(regexp_replace(t, '([a-zA-Z0-9])([{HAN}])', '\\1 \\2', 'g'), '([{HAN}])([a-zA-Z0-9])', '\\1 \\2', 'g') AS text FROM c""")
def normalize_text(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "block_seq", T.normalize(F.col("text")).alias("text"))


@query(f"""
    WITH {LINES}, s AS (SELECT doc_id, text, {strip_sql('text')} AS t FROM lines),
    c AS (SELECT doc_id, text, length(t) AS n, length(t) - length(regexp_replace(t, '[{R.CJK}]', '', 'g')) AS k FROM s)
    SELECT doc_id, count(*) AS n_lines, CAST(sum(k) AS BIGINT) AS n_cjk, CAST(count_if(k * 10 > n * 3) AS BIGINT) AS cjk_lines, CAST(count_if(regexp_matches(text, '[□�]')) AS BIGINT) AS tofu_lines FROM c GROUP BY doc_id""")
def script_profile(spark, sf_dir):
    t = F.col("text")
    return lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(T.cjk_count(t)).cast("bigint").alias("n_cjk"), F.count_if(T.is_cjk(t)).alias("cjk_lines"), F.count_if(T.has_tofu(t)).alias("tofu_lines"))


@query(f"""
    WITH {LINES}, k AS (SELECT doc_id, bool_or(regexp_matches(text, '[一-鿿\\x{{3040}}-\\x{{30ff}}가-\\x{{d7af}}]')) AS c, bool_or(regexp_matches(text, '[A-Za-z]')) AS l FROM lines GROUP BY doc_id)
    SELECT doc_id, CASE WHEN c AND l THEN 'zh+en' WHEN c THEN 'zh' ELSE 'en' END AS lang FROM k""")
def doc_lang(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("doc_id").agg(T.lang_tag(F.bool_or(T.has_tag_cjk(F.col("text"))), F.bool_or(F.col("text").rlike("[A-Za-z]"))).alias("lang"))


@query(f"WITH {LINES} {TYPED} {ORDERED} SELECT doc_id, page_no, block_seq, CAST(pos AS INTEGER) AS pos FROM ordered")
def reading_order(spark, sf_dir):
    return default_order(typed(spark, sf_dir)).select("doc_id", "page_no", "block_seq", "pos")


_SPAN_SQL = f"""
    words AS (SELECT doc_id, page_no, block_seq AS ln, unnest(range(len(w))) AS k, unnest(w) AS text FROM (SELECT *, string_split(text, ' ') AS w FROM lines))"""


@query(f"""
    WITH {LINES}, {_SPAN_SQL},
    s AS (SELECT doc_id, page_no, ln * 100000 + k AS span_seq, CAST(72 + 30 * k AS DOUBLE) AS x, CAST(40 + 18 * (ln % 40) + k % 3 AS DOUBLE) AS y, CAST(8 + length(text) % 9 AS DOUBLE) AS fs, text FROM words WHERE text <> ''),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY round_even(y / 4, 0) * 4, x, span_seq) AS k FROM s),
    j AS (SELECT *, CASE WHEN abs(y - lag(y) OVER (PARTITION BY doc_id, page_no ORDER BY k)) > 4 THEN 1 ELSE 0 END AS jump FROM o),
    g AS (SELECT *, sum(jump) OVER (PARTITION BY doc_id, page_no ORDER BY k) AS line FROM j),
    a AS (SELECT doc_id, page_no, line, {strip_sql("string_agg(text, ' ' ORDER BY x, span_seq)")} AS text, max(fs) AS fs, min(x) AS x0, min(y) AS y0 FROM g GROUP BY 1, 2, 3)
    SELECT doc_id, page_no, CAST(line AS INTEGER) AS block_seq, text, x0, y0, y0 + greatest(fs, 8) AS y1,
           CASE WHEN fs >= 14 AND length(text) <= 120 THEN 'heading'
                WHEN length(text) BETWEEN 4 AND 65 AND NOT {matches('text', '[.。?？!！:：]$')} AND ({matches('text', f'^[0-9]+[.、)）]{WS}+[^ ]')} OR {matches(squeeze_sql('text'), ' ')}) THEN 'heading'
                WHEN {matches('text', f'^([0-9]+[.、)]|.){WS}+')} THEN 'list' ELSE 'paragraph' END AS type
    FROM a WHERE text <> ''""")
def line_assembly(spark, sf_dir):
    words = lines(spark, sf_dir).select("doc_id", "page_no", F.col("block_seq").alias("ln"), F.posexplode(F.split("text", " ")).alias("k", "text")).where("text <> ''")
    spans = words.selectExpr("doc_id", "page_no", "ln * 100000L + k AS span_seq", "CAST(72 + 30 * k AS DOUBLE) AS x", "CAST(40 + 18 * (ln % 40) + k % 3 AS DOUBLE) AS y", "CAST(8 + length(text) % 9 AS DOUBLE) AS font_size", "text")
    return L.assemble_spans(spans).select("doc_id", "page_no", "block_seq", "text", "x0", "y0", "y1", "type")


def _ocr_words(spark, sf_dir):
    words = lines(spark, sf_dir).select("doc_id", "page_no", F.col("block_seq").alias("ln"), F.posexplode(F.split("text", " ")).alias("k", "text"))
    return words.selectExpr(
        "doc_id", "page_no", "k AS word_seq", "1 AS block_num", "1 AS par_num", "ln AS line_num", "CAST(72 + 40 * k + 90 * (k div 7) AS DOUBLE) AS left", "CAST(40 + 18 * (ln % 40) + k % 2 AS DOUBLE) AS top",
        "CAST(6 * length(text) AS DOUBLE) AS width", "12D AS height", "CAST(30 + (length(text) * 13 + k) % 70 AS DOUBLE) AS conf", "text",
    )


_OCR_SQL = f"""
    w AS (SELECT doc_id, page_no, ln, k, text, CAST(72 + 40 * k + 90 * (k // 7) AS DOUBLE) AS l, CAST(72 + 40 * k + 90 * (k // 7) + 6 * length(text) AS DOUBLE) AS r, CAST(40 + 18 * (ln % 40) + k % 2 AS DOUBLE) AS top,
                 30 + (length(text) * 13 + k) % 70 AS conf FROM words),
    f AS (SELECT *, last(r) OVER (PARTITION BY doc_id, ln ORDER BY l, k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - min(l) OVER (PARTITION BY doc_id, ln) AS wide,
                 lag(r) OVER (PARTITION BY doc_id, ln ORDER BY l, k) AS before FROM w WHERE conf >= 45 AND {strip_sql('text')} <> ''),
    g AS (SELECT *, sum(CASE WHEN l - before > greatest(wide * 0.10, 15) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, ln ORDER BY l, k) AS seg FROM f)"""


@query(f"""
    WITH {LINES}, {_SPAN_SQL}, {_OCR_SQL}
    SELECT doc_id, page_no, CAST(ln AS INTEGER) AS line_num, CAST(seg AS INTEGER) AS seg, min(l) AS x0, min(top) AS y0, max(r) AS x1, max(top) + 12 AS y1, CAST(sum(conf) AS BIGINT) AS conf_sum, count(*) AS n_words FROM g GROUP BY 1, 2, 3, 4""")
def ocr_lines(spark, sf_dir):
    found = L.ocr_lines(_ocr_words(spark, sf_dir))
    return found.select("doc_id", "page_no", "line_num", "seg", "x0", "y0", "x1", "y1", F.round(F.col("confidence") * F.col("n_words")).cast("bigint").alias("conf_sum"), "n_words")


@query(f"""
    WITH {LINES}, p AS (SELECT doc_id, psm, CAST((CAST(confidence AS BIGINT) * psm + block_seq) % 100 AS DOUBLE) AS conf FROM lines, (VALUES (7), (8), (13)) AS v(psm)),
    m AS (SELECT doc_id, psm, CAST(sum(conf) AS DOUBLE) / count(*) AS mean FROM p WHERE conf >= 45 GROUP BY 1, 2)
    SELECT doc_id, psm FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY mean DESC, psm) AS k FROM m) WHERE k = 1""")
def best_ocr_pass(spark, sf_dir):
    made = lines(spark, sf_dir).select("doc_id", "block_seq", "confidence", F.explode(F.array(F.lit(7), F.lit(8), F.lit(13))).alias("psm"))
    made = made.select("doc_id", "psm", ((F.col("confidence").cast("bigint") * F.col("psm") + F.col("block_seq")) % 100).cast("double").alias("confidence")).where("confidence >= 45")
    return L.best_pass(made, [7, 8, 13]).select("doc_id", "psm")


def _one_column(spark, sf_dir):
    down = 10.0 * F.floor(F.col("block_seq") % R.PAGE_LINES / 5)
    return typed(spark, sf_dir).withColumns({"x0": F.lit(72.0), "x1": F.lit(72.0) + F.col("x1") - F.col("x0"), "y0": F.col("y0") + down, "y1": F.col("y1") + down})


@query()
def paragraph_merge(spark, sf_dir):
    """A fold against what was merged so far; held against a Python version in the tests."""
    return L.merge_paragraphs(_one_column(spark, sf_dir), ocr=True)


@query()
def paragraph_merge_native(spark, sf_dir):
    return L.merge_paragraphs(_one_column(spark, sf_dir))


_FUN = "acos|arg|argmax|argmin|asin|atan|cos|cot|csc|det|dim|exp|gcd|inf|lg|lim|ln|log|max|min|mod|Pr|sec|sgn|sin|sup|tan"
_MATH = "[Α-Ωα-ω∂∇∈∉∋∌∏∑√∝∞∟∠∥∫∶∷∼≅≈≠≡≤≥≪≫≺≻≼≽⊂⊃⊆⊇⊕⊖⊗⊘±×÷→⇒⇐⇔↔↦↩↪↶↷⇀⇁⇉⇊⇋⇌⇍⇎⇏⇑⇓⇕⇖⇗⇘⇙⇚⇛₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₒₓₔₕₖₗₘₙₚₛₜ⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ]"


@query(f"""
    WITH {LINES}, s AS (SELECT doc_id, block_seq, {strip_sql('text')} AS t FROM lines)
    SELECT doc_id, block_seq, CAST(length(t) AS INTEGER) AS n, CAST(length(t) - length(regexp_replace(t, '{_MATH}', '', 'g')) AS INTEGER) AS n_math,
           CAST(length(t) - length(regexp_replace(t, '[_^±×÷∞∂∇∫∑√∏¬∧∨⊕⊗]', '', 'g')) AS INTEGER) AS n_operators, CAST(length(t) - length(regexp_replace(t, '[=+*/<>|~-]', '', 'g')) AS INTEGER) AS n_signs,
           {matches('t', f'(^|[^0-9A-Za-z_À-ɏͰ-Ͽ])({_FUN})([^0-9A-Za-z_À-ɏͰ-Ͽ]|$)', 'i')} AS has_function, {matches('t', f'.{{2,}}{WS}*={WS}*.+')} AS has_equation, {matches('t', f'[a-zA-Z]{WS}*[(][^)]+[)]')} AS has_call
    FROM s""")
def math_score(spark, sf_dir):
    parts = formula.math_score_parts(F.col("text"))
    return lines(spark, sf_dir).select("doc_id", "block_seq", *[parts[k].alias(k) for k in ("n", "n_math", "n_operators", "n_signs", "has_function", "has_equation", "has_call")])


_B, _E = "(^|[^0-9A-Za-z_À-ɏͰ-Ͽ])", "([^0-9A-Za-z_À-ɏͰ-Ͽ]|$)"


@query(f"""
    WITH {LINES}, s AS (SELECT doc_id, block_seq, {strip_sql('text')} AS t FROM lines),
    w AS (SELECT *, len(list_filter(regexp_extract_all(t, '[A-Za-z]+'), lambda x: regexp_matches(x, '^[a-z]{{3,}}$') AND NOT regexp_matches(x, '^({_FUN})$', 'i'))) AS plain FROM s),
    g AS (SELECT *, CAST({matches('t', '[=≈]')} AS INTEGER) + 2 * CAST({matches('t', '^[A-Za-z][,.;]?$')} AS INTEGER) + 2 * CAST({matches('t', '[×÷±−]')} AS INTEGER)
             + CAST({matches('t', '[=/%~]')} AND {matches('t', '[A-Za-z0-9]')} AS INTEGER) + CAST({matches('t', _B + '[A-Za-z]{1,3}[0-9]' + _E)} AS INTEGER) + CAST({matches('t', _B + '[A-Z]{1,2}[a-z]{1,2}' + _E)} AS INTEGER)
             + CAST({matches('t', _B + '[A-Z]{2,3}' + _E)} AS INTEGER) + CAST({matches('t', f'[0-9]+{WS}*/{WS}*[0-9]+')} AS INTEGER) + CAST({matches('t', r'(^|[\s(])[0-9]*[a-zA-Z]?[\])][\s,;]?$')} AS INTEGER) AS n FROM w)
    SELECT doc_id, block_seq, CASE WHEN t = '' OR length(t) >= 40 OR {R.measure_sql('t')} OR plain >= 2 THEN 0 WHEN {matches('t', '[=≈]')} THEN least(6 + n, 10) WHEN n >= 2 THEN least(5 + n, 10) ELSE 0 END AS tenths FROM g""")
def fragment_score(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "block_seq", F.round(formula.fragment_score(F.col("text")) * 10).cast("int").alias("tenths"))


@query()
def latex_rebuild(spark, sf_dir):
    """Needs lookaround, which the oracle lacks; held against a Python version in the tests."""
    return lines(spark, sf_dir).select("doc_id", "block_seq", formula.rebuild(F.col("text")).alias("latex"))


_MD = "CASE type WHEN 'heading' THEN '## ' || t WHEN 'uncertain' THEN '[uncertain: ' || t || ']' ELSE t END"


@query(f"""
    WITH {LINES} {TYPED} {ORDERED},
    r AS (SELECT doc_id, page_no, pos, {_MD} AS s FROM ordered),
    p AS (SELECT doc_id, page_no, '# Page ' || (page_no + 1) || coalesce(string_agg(CASE WHEN s <> '' THEN chr(10) || chr(10) || s END, '' ORDER BY pos), '') AS s FROM r GROUP BY 1, 2),
    d AS (SELECT doc_id, {strip_sql("string_agg(s, chr(10) || chr(10) ORDER BY page_no)")} || chr(10) AS markdown FROM p GROUP BY 1),
    c AS (SELECT doc_id, count(*) AS n_blocks, CAST(count_if(type = 'heading') AS BIGINT) AS n_headings FROM typed GROUP BY 1)
    SELECT doc_id, n_blocks, n_headings, markdown FROM c JOIN d USING (doc_id)""")
def render_markdown(spark, sf_dir):
    blocks = default_order(typed(spark, sf_dir))
    counts = F.count("*").alias("n_blocks"), F.count_if(F.col("type") == "heading").alias("n_headings")
    return render.markdown(blocks, extra=counts).select("doc_id", "n_blocks", "n_headings", "markdown")


_TXT = "CASE type WHEN 'uncertain' THEN '[uncertain: ' || t || ']' ELSE t END"


@query(f"""
    WITH {LINES} {TYPED} {ORDERED},
    r AS (SELECT doc_id, page_no, pos, {_TXT} AS s FROM ordered),
    p AS (SELECT doc_id, page_no, 'Page ' || (page_no + 1) || chr(10) || chr(10) || repeat('=', 5 + length(CAST(page_no + 1 AS VARCHAR))) || coalesce(string_agg(CASE WHEN s <> '' THEN chr(10) || chr(10) || s END, '' ORDER BY pos), '') || chr(10) || chr(10) AS s FROM r GROUP BY 1, 2)
    SELECT doc_id, {strip_sql("string_agg(s, chr(10) || chr(10) ORDER BY page_no)")} || chr(10) AS text FROM p GROUP BY 1""")
def render_text(spark, sf_dir):
    return render.plain_text(default_order(typed(spark, sf_dir)))


@query(f"""
    WITH {LINES} {TYPED} {ORDERED},
    k AS (SELECT doc_id, page_no, pos, type, {squeeze_sql('text')} AS s, confidence FROM ordered),
    f AS (SELECT *, lag(type) OVER (PARTITION BY doc_id, page_no ORDER BY pos) AS before FROM k WHERE s <> ''),
    p AS (SELECT doc_id, page_no, string_agg(CASE WHEN before IS NOT NULL THEN chr(10) || '¶' ELSE '' END || chr(10) || type || ' conf=' || confidence || '→ ' || s, '' ORDER BY pos) AS s FROM f GROUP BY 1, 2),
    a AS (SELECT DISTINCT doc_id, page_no FROM typed),
    l AS (SELECT doc_id, bool_or(regexp_matches(text, '[一-鿿\\x{{3040}}-\\x{{30ff}}가-\\x{{d7af}}]')) AS c, bool_or(regexp_matches(text, '[A-Za-z]')) AS e FROM lines GROUP BY doc_id)
    SELECT doc_id, {strip_sql("'LEAFMILL_TEXT v2' || chr(10) || '---' || chr(10) || 'src: ' || doc_id || chr(10) || 'pgs: ' || count(*) || chr(10) || 'lang: ' || CASE WHEN any_value(c) AND any_value(e) THEN 'zh+en' WHEN any_value(c) THEN 'zh' ELSE 'en' END || chr(10) || '---' || string_agg(chr(10) || chr(10) || '[page ' || (page_no + 1) || ' size=612x792]' || coalesce(s, ''), '' ORDER BY page_no)")} || chr(10) AS text
    FROM a LEFT JOIN p USING (doc_id, page_no) JOIN l USING (doc_id) GROUP BY 1""")
def render_llm(spark, sf_dir):
    return render.compact(default_order(typed(spark, sf_dir)).withColumns({"width": F.lit(R.WIDTH), "height": F.lit(R.HEIGHT)}))


QUERIES["text_to_blocks"] = QUERIES.pop("text_to_blocks_")
ORACLE["text_to_blocks"] = ORACLE.pop("text_to_blocks_")
