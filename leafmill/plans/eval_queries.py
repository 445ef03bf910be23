"""Queries on evaluation, roll-ups and the run itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import evals, runtime
from leafmill.plans.relations import LINES, TYPED, lines, table
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


def _turns(spark, sf_dir):
    """Each turn with the next one of its conversation; other than ASCII characters are read as '?', for engines that count bytes."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace("text", "[^\\x00-\\x7f]", "?").alias("a"))
    return t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b")), ["conv_id", "turn"])


_TURNS = "t AS (SELECT conv_id, turn, regexp_replace(text, '[^\\x00-\\x7f]', '?', 'g') AS a FROM conversations), p AS (SELECT t.conv_id, t.turn, t.a, u.a AS b FROM t JOIN t u ON t.conv_id = u.conv_id AND t.turn + 1 = u.turn)"


@query(f"WITH {_TURNS} SELECT conv_id, turn, CAST(floor(1000000 * CASE WHEN a = '' AND b = '' THEN 1 WHEN a = '' OR b = '' THEN 0 ELSE 1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE) END + 0.5) AS BIGINT) AS ratio_ppm FROM p")
def levenshtein_ratio(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.floor(T.levenshtein_ratio(F.col("a"), F.col("b")) * 1000000 + 0.5).alias("ratio_ppm"))


@query(f"""
    WITH {_TURNS}, s AS (SELECT conv_id, turn, a, b, list_distinct(string_split(lower(a), '')) AS x, list_distinct(string_split(lower(b), '')) AS y FROM p)
    SELECT conv_id, turn, CAST(floor(1000000 * CASE WHEN a = '' AND b = '' THEN 1 WHEN a = '' OR b = '' THEN 0 ELSE len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE) END + 0.5) AS BIGINT) AS jaccard_ppm FROM s""")
def char_jaccard(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.floor(T.char_jaccard(F.col("a"), F.col("b")) * 1000000 + 0.5).alias("jaccard_ppm"))


@query("""
    WITH n AS (SELECT count(*) AS k FROM benchmark), i AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS r, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')), lambda w: length(w) >= 3) AS terms FROM benchmark),
    t AS (SELECT doc_id, text, unnest(terms) AS term FROM documents, n JOIN i ON true WHERE r = doc_id % k)
    SELECT doc_id, count(*) AS n_terms, CAST(count_if(contains(lower(text), term)) AS BIGINT) AS n_found FROM t GROUP BY 1""")
def required_terms_score(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    k = items.count()
    ranked = items.selectExpr("row_number() OVER (ORDER BY item_id) - 1 AS r", "array_distinct(regexp_extract_all(lower(text), '[a-z]{3,}', 0)) AS terms").select("r", F.explode("terms").alias("term"))
    terms = docs.select("doc_id", (F.col("doc_id") % k).alias("r")).join(ranked, "r").select("doc_id", "term")
    return evals.required_terms(docs, terms).select("doc_id", "n_terms", "n_found")


_METRICS = """m AS (SELECT doc_id, unnest([struct_pack(s := quality * 1.0, w := 0.4), struct_pack(s := 1.0 - toxic, w := 0.1), struct_pack(s := CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0.5 END, w := 0.5)], recursive := true) FROM documents JOIN labels USING (doc_id))"""


def _scores(spark, sf_dir):
    met = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    row = lambda name, s, w: F.struct(F.lit(name).alias("name"), s.cast("double").alias("score"), F.lit(w).alias("weight"))
    parts = (row("quality", F.col("quality"), 0.4), row("clean", 1 - F.col("toxic"), 0.1), row("length", F.when(F.col("n_chars") > 1000, 1.0).otherwise(0.5), 0.5))
    return met.select("doc_id", F.explode(F.array(*parts)).alias("m")).select("doc_id", "m.*")


@query(f"WITH {_METRICS} SELECT doc_id, CAST(floor(sum(s * w) / sum(w) * 10000 + 0.5) AS BIGINT) AS overall_e4 FROM m GROUP BY 1")
def weighted_score(spark, sf_dir):
    return evals.weighted(_scores(spark, sf_dir)).select("doc_id", F.floor(F.col("overall") * 10000 + 0.5).alias("overall_e4"))


@query(f"WITH {_METRICS}, o AS (SELECT doc_id, CAST(sum(s * w) / sum(w) AS DOUBLE) - 0.00001 AS x FROM m GROUP BY 1) SELECT doc_id, CASE WHEN x >= 0.7 THEN 'OK' WHEN x >= 0.4 THEN 'WARN' ELSE 'FAIL' END AS status FROM o")
def bench_status(spark, sf_dir):
    return evals.weighted(_scores(spark, sf_dir)).select("doc_id", evals.status(F.col("overall") - 0.00001).alias("status"))


@query("""
    WITH e AS (SELECT event_id, user_id, event_type, value AS s, value + event_id % 7 / 4.0 AS t, event_id % 3 / 4.0 AS tol, event_id % 2 AS side, event_type || '!' AS other FROM events),
    w AS (SELECT * FROM e WHERE side = 0), h AS (SELECT * FROM e WHERE side = 1)
    SELECT w.event_id, bool_or(coalesce(abs(h.s - w.s) <= greatest(0.15, h.tol) AND abs(h.t - w.t) <= greatest(0.15, h.tol), false)) AS found FROM w LEFT JOIN h ON w.user_id = h.user_id AND w.event_type = h.event_type GROUP BY 1""")
def interval_match(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id", "user_id AS doc_id", "'p' AS panel_id", "event_type AS class", "value AS start_depth", "value + event_id % 7 / 4.0D AS end_depth", "event_id % 3 / 4.0D AS depth_tolerance")
    expected = e.where("event_id % 2 = 0").withColumnRenamed("event_id", "exp_id")
    actual = e.where("event_id % 2 = 1").withColumns({"item_type": F.lit("interval"), "class_candidates": F.lit(None).cast("array<string>")})
    return evals.matched(expected, actual, "interval").select(F.col("exp_id").alias("event_id"), "found")


_GAPS = """d AS (SELECT doc_id, CAST((quality * 8 + (1 - toxic) * 2 + doc_id % 5) AS DOUBLE) / 16 AS x, lang, source AS type, CASE WHEN n_chars > 4000 THEN 'hard' WHEN n_chars > 1000 THEN 'medium' ELSE 'easy' END AS difficulty,
        CASE WHEN doc_id % 3 = 0 THEN [lang || '_text', 'scanned'] ELSE ['native'] END AS features FROM documents JOIN labels USING (doc_id)),
    g AS (SELECT 'type' AS family, 0 AS f, type AS category, avg(x) AS mean, count(*) AS n, min(doc_id) AS seen FROM d GROUP BY type UNION ALL SELECT 'lang', 1, lang, avg(x), count(*), min(doc_id) FROM d GROUP BY lang
          UNION ALL SELECT 'difficulty', 2, difficulty, avg(x), count(*), min(doc_id) FROM d GROUP BY difficulty
          UNION ALL SELECT 'feature', 3, k, avg(x), count(*), min(doc_id * 1000 + p) FROM (SELECT doc_id, x, unnest(features) AS k, unnest(range(len(features))) AS p FROM d) GROUP BY k)"""


def _gaps(spark, sf_dir):
    met = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    scores = met.select("doc_id", F.col("doc_id").alias("seq"), ((F.col("quality") * 8 + (1 - F.col("toxic")) * 2 + F.col("doc_id") % 5).cast("double") / 16).alias("overall"))
    manifest = met.select(
        "doc_id", F.col("source").alias("type"), F.col("lang").alias("language"), F.expr("CASE WHEN n_chars > 4000 THEN 'hard' WHEN n_chars > 1000 THEN 'medium' ELSE 'easy' END").alias("difficulty"),
        F.expr("CASE WHEN doc_id % 3 = 0 THEN array(lang || '_text', 'scanned') ELSE array('native') END").alias("features"),
    )
    return evals.gaps(scores, manifest)


@query(f"WITH {_GAPS} SELECT family, category, CAST(floor(mean * 10000 + 0.5) AS BIGINT) AS mean_e4, n FROM g")
def gap_analysis(spark, sf_dir):
    return _gaps(spark, sf_dir).select("family", "category", F.floor(F.col("mean") * 10000 + 0.5).alias("mean_e4"), "n")


@query(f"WITH {_GAPS} SELECT CAST(row_number() OVER (ORDER BY 1.0 - mean DESC, f, seen, category) AS INTEGER) AS rank, family, category, CAST(floor((1.0 - mean) * 10000 + 0.5) AS BIGINT) AS gap_e4 FROM g ORDER BY 1 LIMIT 10")
def weakest_areas(spark, sf_dir):
    return evals.weakest(_gaps(spark, sf_dir)).select("rank", "family", "category", F.floor(F.col("gap") * 10000 + 0.5).alias("gap_e4"))


@query("SELECT count(*) AS total, CAST(count_if(toxic = 0) AS BIGINT) AS completed, CAST(count_if(toxic <> 0) AS BIGINT) AS failed, CAST(floor(avg(CASE WHEN toxic = 0 THEN quality END) * 10000 + 0.5) AS BIGINT) AS overall_e4 FROM labels")
def bench_summary(spark, sf_dir):
    scores = table(spark, sf_dir, "labels").select(F.col("quality").cast("double").alias("overall"), F.when(F.col("toxic") != 0, "toxic").alias("error"))
    return evals.summary(scores).select("total", "completed", "failed", F.floor(F.col("overall") * 10000 + 0.5).alias("overall_e4"))


@query("SELECT d.doc_id, 'in/doc_' || d.doc_id || '.pdf' AS path, 'doc_' || d.doc_id || '_v2' AS stem FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL")
def resume_pending(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("in/doc_"), F.col("doc_id"), F.lit(".pdf")).alias("path"))
    done = table(spark, sf_dir, "labels").select(F.concat(F.lit("doc_"), F.col("doc_id"), F.lit("_v2")).alias("stem"))
    return runtime.pending(files, done, "_v2").select("doc_id", "path", "stem")


@query("""
    WITH f AS (SELECT doc_id, 'in/' || source || CASE doc_id % 4 WHEN 0 THEN '/a.PDF' WHEN 1 THEN '/b.jpeg' WHEN 2 THEN '/c.txt' ELSE '/d.v1.tiff' END AS path FROM documents)
    SELECT path, min(doc_id) AS seq, CASE WHEN ends_with(lower(path), '.pdf') THEN 'pdf' ELSE 'image' END AS kind FROM f WHERE regexp_matches(lower(path), '[.](pdf|png|jpg|jpeg|bmp|tif|tiff|webp)$') GROUP BY path""")
def file_discovery(spark, sf_dir):
    files = table(spark, sf_dir, "documents").selectExpr("doc_id AS seq", "'in/' || source || CASE doc_id % 4 WHEN 0 THEN '/a.PDF' WHEN 1 THEN '/b.jpeg' WHEN 2 THEN '/c.txt' ELSE '/d.v1.tiff' END AS path")
    return runtime.supported(files)


@query()
def ocr_engine_merge(spark, sf_dir):
    """Sequential within a page; held against a Python version in the tests."""
    first = lines(spark, sf_dir).withColumn("engine", F.lit("a"))
    shift = first.withColumns({"x0": F.col("x0") + 9 * (F.col("block_seq") % 5), "y0": F.col("y0") + F.col("block_seq") % 7, "y1": F.col("y1") + F.col("block_seq") % 7, "confidence": (F.col("confidence") * 7) % 100, "engine": F.lit("b")})
    return runtime.merge_engines(first, shift)


def _golden(spark, sf_dir):
    own = typed(spark, sf_dir).withColumnRenamed("block_seq", "seq").withColumns({"n_rows": F.lit(0), "n_cols": F.lit(0)})
    return own, own.where("seq % 5 <> 4").withColumn("type", F.when(F.col("seq") % 3 == 0, "heading").otherwise(F.col("type")))


@query()
def block_type_accuracy(spark, sf_dir):
    """A greedy pairing; held against a Python version in the tests."""
    return evals.type_accuracy(*_golden(spark, sf_dir))


@query(f"""
    WITH {LINES} {TYPED}, a AS (SELECT doc_id, count(*) AS n, bool_or(type = 'uncertain' OR contains(lower(text), 'unavailable')) AS spent FROM typed GROUP BY 1), e AS (SELECT doc_id, count(*) AS n FROM typed WHERE block_seq % 5 <> 4 GROUP BY 1)
    SELECT doc_id, CAST(floor(1000000 * e.n / a.n + 0.5) AS BIGINT) AS block_count_ppm, CASE WHEN spent THEN 3 ELSE 10 END AS completeness_tenths FROM a JOIN e USING (doc_id)""")
def document_scores(spark, sf_dir):
    actual, expected = _golden(spark, sf_dir)
    docs = actual.select("doc_id").distinct().withColumns({"actual_text": F.lit("a"), "expected_text": F.lit("a"), "n_warnings": F.lit(0)})
    m = evals.document_metrics(actual, expected, docs).groupBy("doc_id").pivot("name", ["block_count", "content_completeness"]).agg(F.first("score"))
    return m.select("doc_id", F.floor(F.col("block_count") * 1000000 + 0.5).alias("block_count_ppm"), F.round(F.col("content_completeness") * 10).cast("int").alias("completeness_tenths"))
