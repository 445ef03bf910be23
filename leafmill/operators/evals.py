"""Scores of outputs against goldens, and their roll-ups.

Metrics are a long table (doc_id, name, score, weight). Actual and expected
blocks are (doc_id, seq, type, text, n_rows, n_cols); chart items are as in
operators.charts, expected ones with class as a string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import char_jaccard, levenshtein_ratio

_SPENT = ("placeholder", "not performed", "unavailable")


def weighted(metrics: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, overall): the weighted mean of scores, 0 without weight."""
    total = F.sum("weight")
    return metrics.groupBy(*keys).agg(F.when(total > 0, F.sum(F.col("score") * F.col("weight")) / total).otherwise(0.0).alias("overall"))


def status(score: Column, error: Column | None = None) -> Column:
    plain = F.when(score >= 0.7, "OK").when(score >= 0.4, "WARN").otherwise("FAIL")
    return plain if error is None else F.when(error.isNotNull(), "ERR").otherwise(plain)


def required_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, n_terms, n_found, score): the share of a document's terms (doc_id, term) that its lower-cased text holds."""
    met = terms.join(texts.select("doc_id", F.lower("text").alias("t")), "doc_id", "left")
    out = met.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.count_if(F.coalesce(F.col("t").contains(F.lower("term")), F.lit(False))).alias("n_found"))
    return out.withColumn("score", F.col("n_found") / F.col("n_terms"))


def tolerance(item: Column) -> Column:
    return F.greatest(F.lit(0.15), F.coalesce(item.cast("double"), F.lit(0.15)))


def _class_fits(klass: Column) -> Column:
    return (F.col("class").cast("string") == klass) | F.coalesce(F.array_contains(F.col("class_candidates").cast("array<string>"), klass), F.lit(False))


def number_pattern(v: Column) -> Column:
    """A pattern for a number in a text; its decimal point stands for any character."""
    whole = F.concat(F.lit(r"\b"), v.cast("bigint").cast("string"), F.lit(r"(?:\.0+)?\b"))
    return F.when(v == F.floor(v), whole).otherwise(F.concat(F.lit(r"\b"), v.cast("string"), F.lit(r"\b")))


def matched(expected: DataFrame, actual: DataFrame, kind: str, texts: DataFrame | None = None) -> DataFrame:
    """Expected intervals or points (doc_id, exp_id, panel_id, class, start_depth, end_depth or depth) with found.

    An actual item of the panel fits if its class or a candidate is the one
    expected and depths agree within its tolerance; failing that the text may
    name class and depths.
    """
    fields = ["start_depth", "end_depth"] if kind == "interval" else ["depth"]
    want = expected.select("doc_id", "exp_id", F.coalesce("panel_id", F.lit("")).alias("want_panel"), F.col("class").alias("want_class"), *[F.col(f).alias(f"want_{f}") for f in fields])
    have = actual.where(F.col("item_type") == kind)
    near = lambda f: F.abs(F.col(f) - F.col(f"want_{f}")) <= tolerance(F.col("depth_tolerance"))
    cond = (F.col("panel_id") == F.col("want_panel")) & _class_fits(F.col("want_class"))
    for f in fields:
        cond = cond & near(f)
    # Without a panel any panel's items count; those few rows are joined apart so that the others keep their key.
    keyed = want.where("want_panel <> ''").alias("w").join(have.alias("h"), (F.col("w.doc_id") == F.col("h.doc_id")) & cond, "left_semi")
    loose = _class_fits(F.col("want_class"))
    for f in fields:
        loose = loose & near(f)
    free = want.where("want_panel = ''").alias("w").join(have.alias("h"), (F.col("w.doc_id") == F.col("h.doc_id")) & loose, "left_semi")
    hits = keyed.select("doc_id", "exp_id").unionByName(free.select("doc_id", "exp_id")).withColumn("hit", F.lit(True))
    out = want.join(hits, ["doc_id", "exp_id"], "left")
    if texts is not None:
        out = out.join(texts.select("doc_id", F.lower("text").alias("_t")), "doc_id", "left")
        prefixes = ("class ", "类别 ", "标签 ") if kind == "interval" else ("class ",)
        named = F.lit(False)
        for p in prefixes:
            named = named | F.col("_t").contains(F.concat(F.lit(p), F.col("want_class")))
        for f in fields:
            named = named & F.coalesce(F.regexp_count("_t", number_pattern(F.col(f"want_{f}"))) > 0, F.lit(False))
        out = out.withColumn("hit", F.coalesce("hit", named))
    return out.select("doc_id", "exp_id", F.col("want_panel").alias("panel_id"), F.coalesce("hit", F.lit(False)).alias("found"))


def label_words(c: Column) -> Column:
    return F.filter(F.split(F.translate(F.lower(F.coalesce(c, F.lit(""))), "-_", "  "), " +"), lambda w: F.length(w) >= 3)


def charts_found(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected charts (doc_id, panel_id, x_label, y_label) with found: a detected chart whose labels share a word with each label given."""
    want = expected.select("doc_id", F.col("panel_id").alias("want_panel"), label_words(F.col("x_label")).alias("wx"), label_words(F.col("y_label")).alias("wy"))
    have = actual.where("item_type = 'chart_detected'").select("doc_id", "panel_id", label_words(F.col("x_label")).alias("hx"), label_words(F.col("y_label")).alias("hy"))
    side = lambda w, h: (F.size(w) == 0) | F.arrays_overlap(w, h)
    fits = (F.size("wx") + F.size("wy") > 0) & side("wx", "hx") & side("wy", "hy") & ((F.coalesce("want_panel", F.lit("")) == "") | F.col("panel_id").isin("chart", "") | (F.col("panel_id") == F.col("want_panel")))
    met = want.join(have, "doc_id", "left").withColumn("fits", F.coalesce(fits, F.lit(False)))
    return met.groupBy("doc_id", F.col("want_panel").alias("panel_id")).agg(F.bool_or("fits").alias("found"))


def chart_score(data_hits: Column, data_total: Column, chart_hits: Column, chart_total: Column, has_structure: Column) -> Column:
    """0.6 data and 0.4 charts where charts are expected and any was detected, else data alone; 1 if nothing is expected."""
    ratio = F.when(data_total > 0, data_hits / data_total)
    blend = 0.6 * F.coalesce(ratio, F.lit(0.0)) + 0.4 * chart_hits / chart_total
    return F.when((chart_total > 0) & has_structure, blend).otherwise(F.coalesce(ratio, F.lit(1.0)))


def chart_eval(pages: DataFrame, texts: DataFrame, terms: DataFrame, labels: DataFrame, intervals: DataFrame, points: DataFrame, charts: DataFrame, actual: DataFrame) -> DataFrame:
    """The five metrics of documents with chart goldens.

    pages: (doc_id, has_size, n_blocks, n_warnings); texts: (doc_id, text with
    metadata); terms: (doc_id, term); labels: (doc_id, label) of panels.
    """
    docs = pages.groupBy("doc_id").agg(F.bool_or("has_size").alias("sized"), F.sum("n_blocks").alias("n"), F.sum("n_warnings").alias("warned"))
    share = lambda d, name: d.select("doc_id", F.col("score").alias(name))
    data = matched(intervals, actual, "interval", texts).unionByName(matched(points, actual, "point", texts)).groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if("found").alias("hits"))
    drawn = charts_found(charts, actual).groupBy("doc_id").agg(F.count("*").alias("c_total"), F.count_if("found").alias("c_hits"))
    has = actual.where("item_type = 'chart_detected'").select("doc_id").distinct().withColumn("structure", F.lit(True))
    out = docs.join(share(required_terms(texts, terms), "terms"), "doc_id", "left").join(share(required_terms(texts, labels.withColumnRenamed("label", "term")), "panels"), "doc_id", "left")
    for part in (data, drawn, has, texts.select("doc_id", F.lower("text").alias("t"))):
        out = out.join(part, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    spent = F.lit(False)
    for w in _SPENT:
        spent = spent | F.coalesce(F.col("t").contains(w), F.lit(False))
    scores = {
        "image_presence": (F.when(F.col("sized") & (F.col("n") > 0), 1.0).otherwise(0.0), 0.10),
        "required_terms": (F.coalesce("terms", F.lit(1.0)), 0.20),
        "panel_layout": (F.coalesce("panels", F.lit(1.0)), 0.20),
        "chart_data": (chart_score(zero("hits"), zero("total"), zero("c_hits"), zero("c_total"), F.coalesce("structure", F.lit(False))), 0.40),
        "usable_confidence": (F.when((F.col("warned") > 0) | spent, 0.0).otherwise(1.0), 0.10),
    }
    return out.select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), s.cast("double").alias("score"), F.lit(w).alias("weight")) for n, (s, w) in scores.items()])).alias("m")).select("doc_id", "m.*")


def pair_hits(kinds: list[str], texts: list[str], goal_kinds: list[str], goals: list[str], at_once: int = 256) -> float:
    """Share of equal types among blocks that take, in order, the free golden block most alike by its set of characters.

    The similarities of ``at_once`` blocks with all golden ones come from one
    product of two tables of characters.
    """
    if not kinds or not goals:
        return 0.0
    sides = [_chars(side) for side in (texts, goals)]
    held = np.flatnonzero(np.bincount(np.concatenate([chars for _, chars in sides])))
    place = np.zeros(int(held[-1]) + 1 if len(held) else 1, np.intp)
    place[held] = np.arange(len(held))
    free, hits, pairs = np.ones(len(goals), bool), 0, 0
    table = lambda side, lo, hi: _marks(*sides[side], place, len(held), lo, hi)
    other = table(1, 0, len(goals))
    size = other.sum(axis=1)
    for lo in range(0, len(kinds), at_once):
        own = table(0, lo, min(lo + at_once, len(kinds)))
        both = own @ other.T
        union = own.sum(axis=1)[:, None] + size[None, :] - both
        same = np.where(union > 0, both / np.maximum(union, 1), 1.0)
        for i, row in enumerate(same):
            left = np.where(free, row, 0.0)
            j = int(left.argmax())
            if left[j] > 0:
                free[j] = False
                pairs += 1
                hits += kinds[lo + i] == goal_kinds[j]
    return hits / max(pairs, len(goals)) if pairs else 0.0


def _chars(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Where each lower-cased text begins, and where the last ends, among the characters of all."""
    low = [(t or "").lower() for t in texts]
    return np.concatenate([[0], np.cumsum([len(t) for t in low])]), np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.intp)


def _marks(starts: np.ndarray, chars: np.ndarray, place: np.ndarray, width: int, lo: int, hi: int) -> np.ndarray:
    """A row a text from ``lo`` to ``hi``, with 1 for each character it has."""
    out = np.zeros((hi - lo, width))
    own = np.repeat(np.arange(hi - lo), np.diff(starts[lo : hi + 1]))
    out[own, place[chars[starts[lo] : starts[hi]]]] = 1
    return out


def _paired() -> Column:
    """pair_hits of a document's gathered blocks; documents go to Python many at a time."""

    @F.pandas_udf("double")
    def score(kinds: pd.Series, texts: pd.Series, goal_kinds: pd.Series, goals: pd.Series) -> pd.Series:
        own = lambda x: [] if x is None else list(x)
        return pd.Series([pair_hits(*map(own, row)) for row in zip(kinds, texts, goal_kinds, goals, strict=True)])

    return score("a_type", "a_text", "e_type", "e_text")


def _gathered(rows: DataFrame, name: str, *more: Column) -> DataFrame:
    """Types and texts of a document's blocks in order, with more aggregates, so that blocks are made once."""
    own = F.sort_array(F.collect_list(F.struct("seq", "type", "text")))
    field = lambda k: F.transform("own", lambda b: b[k]).alias(f"{name}_{k}")
    return rows.groupBy("doc_id").agg(own.alias("own"), *more).select("*", field("type"), field("text")).drop("own")


def type_accuracy(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc_id, score): blocks paired greedily by their sets of characters, then compared by type.

    A pairing takes a golden block from those after it, so each document is
    one fold; documents are gathered by the JVM and handed over many at a time.
    """
    return _gathered(actual, "a").join(_gathered(expected, "e"), "doc_id", "full").select("doc_id", _paired().alias("score"))


def document_metrics(actual: DataFrame, expected: DataFrame, docs: DataFrame) -> DataFrame:
    """The six metrics of documents with document goldens; docs: (doc_id, actual_text, expected_text, n_warnings)."""
    spent = F.col("type").isin("placeholder", "uncertain")
    for w in _SPENT:
        spent = spent | F.lower("text").contains(w)

    def side(rows: DataFrame, p: str, *more: Column) -> DataFrame:
        kind = lambda k: F.col("type") == k
        size = [F.coalesce(k, F.lit(0)).alias(k) for k in ("n_rows", "n_cols")]
        listed = lambda k: F.collect_list(F.when(kind(k), F.struct(*size, F.coalesce("text", F.lit("")).alias("text"))))
        return _gathered(rows, p, F.count("*").alias(f"{p}_n"), F.count_if(kind("table")).alias(f"{p}_tables"), F.count_if(kind("figure")).alias(f"{p}_figures"), listed("table").alias(f"{p}_tabled"), listed("figure").alias(f"{p}_drawn"), *more)

    met = docs.join(side(actual, "a", F.bool_or(F.coalesce(spent, F.lit(False))).alias("spent")), "doc_id", "left").join(side(expected, "e"), "doc_id", "left")
    ratio = lambda a, b: F.least(a, b) / F.greatest(a, b)

    def fit(e: Column, a: Column) -> Column:
        sized = F.least(e["n_rows"], e["n_cols"], a["n_rows"], a["n_cols"]) > 0
        return F.when(sized, (ratio(e["n_rows"], a["n_rows"]) + ratio(e["n_cols"], a["n_cols"])) / 2).otherwise(char_jaccard(a["text"], e["text"]))

    fits = F.transform("e_tabled", lambda e: F.array_max(F.transform("a_tabled", lambda a: fit(e, a))))
    mean = F.aggregate(fits, F.lit(0.0), lambda x, y: x + y) / F.size("e_tabled")
    seen = F.size(F.filter("e_drawn", lambda e: F.exists("a_drawn", lambda a: char_jaccard(e["text"], a["text"]) > 0.2)))
    out = met.withColumns({"table_fit": F.when((F.size("e_tabled") > 0) & (F.size("a_tabled") > 0), mean), "figures_met": seen, "types": F.when(F.coalesce("a_n", "e_n").isNotNull(), _paired())})
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    a, e = zero("a_n"), zero("e_n")
    presence = lambda kind, extra, fit: F.when(zero(f"e_{kind}") == 0, F.when(zero(f"a_{kind}") == 0, 1.0).otherwise(extra)).when(zero(f"a_{kind}") == 0, 0.0).otherwise(fit)
    scores = {
        "text_similarity": (levenshtein_ratio(F.col("actual_text"), F.col("expected_text")), 0.25),
        "block_count": (F.when(e == 0, F.when(a == 0, 1.0).otherwise(0.0)).otherwise(F.least(a, e) / F.greatest(a, e)), 0.15),
        "block_type_accuracy": (F.coalesce("types", F.when(e == 0, 1.0).otherwise(0.0)), 0.10),
        "table_detection": (presence("tables", 0.5, zero("table_fit")), 0.20),
        "chart_presence": (presence("figures", 0.7, zero("figures_met") / F.greatest(zero("e_figures"), F.lit(1))), 0.15),
        "content_completeness": (F.when(F.col("n_warnings") > 0, 0.0).when(F.coalesce("spent", F.lit(False)), 0.3).otherwise(1.0), 0.15),
    }
    return out.select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), s.cast("double").alias("score"), F.lit(w).alias("weight")) for n, (s, w) in scores.items()])).alias("m")).select("doc_id", "m.*")


DIMENSIONS = (("type", "type"), ("language", "lang"), ("difficulty", "difficulty"))


def gaps(scores: DataFrame, manifest: DataFrame) -> DataFrame:
    """(family, category, mean, gap, n, first_seen): scores (doc_id, seq, overall) by the manifest's dimensions and features.

    One grouping-sets pass for the dimensions; documents the manifest lacks
    count as unknown.
    """
    met = scores.join(manifest, "doc_id", "left").withColumns({d: F.coalesce(d, F.lit("unknown")) for d, _ in DIMENSIONS})
    by = met.groupingSets([[d] for d, _ in DIMENSIONS], *[d for d, _ in DIMENSIONS]).agg(F.grouping_id().alias("g"), F.avg("overall").alias("mean"), F.count("*").alias("n"), F.min("seq").alias("first_seen"))
    family = F.coalesce(*[F.when(F.col("g") == 7 - (4 >> i), n) for i, (_, n) in enumerate(DIMENSIONS)])
    dims = by.select(family.alias("family"), F.coalesce(*[d for d, _ in DIMENSIONS]).alias("category"), "mean", "n", "first_seen")
    feats = met.select("overall", "seq", F.posexplode("features").alias("p", "category")).groupBy("category").agg(F.avg("overall").alias("mean"), F.count("*").alias("n"), F.min(F.col("seq") * 1000 + F.col("p")).alias("first_seen"))
    out = dims.unionByName(feats.select(F.lit("feature").alias("family"), "category", "mean", "n", "first_seen"))
    return out.withColumn("gap", 1.0 - F.col("mean"))


def weakest(found: DataFrame, n: int = 10) -> DataFrame:
    """The categories of largest gap, ranked; ties by family, then by the order documents came in."""
    order = F.create_map(*[F.lit(x) for i, f in enumerate(("type", "lang", "difficulty", "feature")) for x in (f, i)])
    top = found.withColumn("_f", order[F.col("family")]).orderBy(F.desc("gap"), "_f", "first_seen", "category").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("gap"), "_f", "first_seen", "category"))).drop("_f")


def summary(scores: DataFrame) -> DataFrame:
    """One row: documents, completed, failed and the mean of those without error."""
    good = F.col("error").isNull()
    return scores.agg(F.count("*").alias("total"), F.count_if(good).alias("completed"), F.count_if(~good).alias("failed"), F.coalesce(F.avg(F.when(good, F.col("overall"))), F.lit(0.0)).alias("overall"))


def pair_files(actual: DataFrame, golden: DataFrame) -> DataFrame:
    """Each golden (doc_id, stem) with an actual file (stem, path): the same stem, else the first that begins with it."""
    exact = golden.join(actual.select("stem", F.col("path").alias("exact")), "stem", "left")
    open_ = exact.where("exact IS NULL").select("doc_id", F.col("stem").alias("g"))
    begun = open_.join(actual, F.col("stem").startswith(F.col("g"))).groupBy("doc_id").agg(F.min(F.struct("stem", "path")).alias("f"))
    return exact.join(begun, "doc_id", "left").select("doc_id", "stem", F.coalesce("exact", F.col("f.path")).alias("path"))


def report(overall: dict, scores: Iterator[dict], areas: Iterator[dict]) -> str:
    """A Markdown report of a run's summary row, its documents' rows and its weakest areas."""
    lines = ["# Evaluation", "", "| Metric | Value |", "| --- | --- |", *[f"| {k} | {overall[k]} |" for k in ("total", "completed", "failed")], f"| overall | {overall['overall']:.2%} |", "", "| Document | Score | Status |", "| --- | ---: | --- |"]
    lines += [f"| {s['doc_id']} | {'' if s.get('error') else format(s['overall'], '.2%')} | {s['status']} {s.get('error') or ''} |" for s in scores]
    lines += ["", "| # | Category | Gap | Documents |", "| --- | --- | ---: | ---: |"]
    lines += [f"| {i} | {a['family']}:{a['category']} | {a['gap']:.1%} | {a['n']} |" for i, a in enumerate(areas, 1)]
    return "\n".join(lines) + "\n"
