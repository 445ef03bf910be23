"""A run's outputs against goldens: one job from a manifest to scores, roll-ups and a report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import levenshtein_ratio
from leafmill.operators import evals, runtime
from leafmill.sources import jsondoc


def route(golden: Column) -> Column:
    """How a golden's JSON is compared: as a chart's, as a document's, or by text alone; null if it is no JSON."""
    fields = F.json_object_keys(golden)
    has = lambda name: F.array_contains(fields, name)
    return F.when(has("required_terms") | has("panels"), "chart").when(has("pages"), "document").when(fields.isNotNull(), "text")


def warnings_of(document: Column) -> Column:
    """A document's warnings and its pages', in order."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(document["warnings"], none), F.coalesce(F.flatten(F.transform(document["pages"], lambda p: F.coalesce(p["warnings"], none))), none))


def detail(document: Column) -> Column:
    """The first three warnings, or that there are none."""
    found = warnings_of(document)
    return F.when(F.size(found) > 0, F.concat(F.lit("warnings: "), F.array_join(F.slice(found, 1, 3), "; "))).otherwise("no warnings")


def block_text(document: Column) -> Column:
    """Warnings, and type, text, metadata and confidence of all blocks, lower-cased, a line each."""
    none = F.array().cast("array<string>")
    block = lambda b: F.filter(F.array(F.coalesce(b["type"], F.lit("")), F.coalesce(b["text"], F.lit("")), F.to_json(b["metadata"]), b["confidence"].cast("string")), lambda x: x.isNotNull())
    page = lambda p: F.concat(F.coalesce(p["warnings"], none), F.coalesce(F.flatten(F.transform(p["blocks"], block)), none))
    whole = F.concat(F.coalesce(document["warnings"], none), F.coalesce(F.flatten(F.transform(document["pages"], page)), none))
    return F.lower(F.array_join(whole, "\n"))


def compare(pairs: DataFrame) -> DataFrame:
    """Metrics (doc_id, name, score, weight, detail) of pairs (doc_id, actual, golden) of JSON texts, each by its golden's form."""
    pairs = pairs.withColumns({"form": route(F.col("golden")), "a": F.from_json("actual", jsondoc.DOCUMENT)})
    out = []
    text = pairs.where("form = 'text'")
    same = levenshtein_ratio(F.to_json(F.try_parse_json("actual")), F.to_json(F.try_parse_json("golden")))  # keys in order
    out.append(text.select("doc_id", F.lit("text_similarity").alias("name"), same.alias("score"), F.lit(1.0).alias("weight")))

    docs = pairs.where("form = 'document'").withColumn("e", F.from_json("golden", jsondoc.DOCUMENT))
    side = lambda c: jsondoc.blocks(docs.select("doc_id", f"{c}.*"), "doc_id").select("doc_id", (F.col("page_no") * 100_000 + F.col("block_seq")).alias("seq"), "type", "text", "n_rows", "n_cols")
    both = docs.select("doc_id", block_text(F.col("a")).alias("actual_text"), block_text(F.col("e")).alias("expected_text"), F.size(warnings_of(F.col("a"))).alias("n_warnings"))
    out.append(evals.document_metrics(side("a"), side("e"), both))

    drawn = pairs.where("form = 'chart'").withColumn("g", F.from_json("golden", jsondoc.CHART_GOLDEN))
    actual, golden = drawn.select("doc_id", "a.*"), drawn.select("doc_id", "g.*")
    sized = lambda p: (p["width"] > 0) & (p["height"] > 0)
    pages = actual.select("doc_id", F.coalesce(F.size("warnings"), F.lit(0)).alias("w"), F.explode_outer("pages").alias("p")).select(
        "doc_id", F.coalesce(sized(F.col("p")), F.lit(False)).alias("has_size"), F.greatest(F.size("p.blocks"), F.lit(0)).alias("n_blocks"), (F.greatest("w", F.lit(0)) + F.greatest(F.size("p.warnings"), F.lit(0))).alias("n_warnings")
    )
    panels = golden.select("doc_id", F.explode("panels").alias("p"))
    labels = panels.select("doc_id", F.explode(F.array("p.caption", "p.x_axis.label", "p.y_axis.label")).alias("label")).where("label <> ''")
    charts = panels.select("doc_id", F.col("p.id").alias("panel_id"), F.col("p.x_axis.label").alias("x_label"), F.col("p.y_axis.label").alias("y_label")).where("coalesce(x_label, y_label, '') <> ''")
    out.append(
        evals.chart_eval(
            pages, jsondoc.texts(actual, "doc_id"), golden.select("doc_id", F.explode("required_terms").alias("term")), labels,
            jsondoc.expected_intervals(golden, "doc_id"), jsondoc.expected_points(golden, "doc_id"), charts, jsondoc.chart_items(actual, "doc_id"),
        )
    )
    told = pairs.select("doc_id", detail(F.col("a")).alias("detail"))
    return reduce(DataFrame.unionByName, out).join(told, "doc_id")


@dataclass
class Run:
    """Tables of a benchmark: metrics, scores (doc_id, seq, overall, error, status), summary, gaps, weakest areas."""

    metrics: DataFrame
    scores: DataFrame
    summary: DataFrame
    gaps: DataFrame
    weakest: DataFrame

    def report(self) -> str:
        rows = self.scores.orderBy("seq").toLocalIterator()
        return evals.report(self.summary.first().asDict(), (r.asDict() for r in rows), (r.asDict() for r in self.weakest.orderBy("rank").collect()))


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(stem, path, json) of the JSON files of a folder; none where it is empty or missing."""
    try:
        files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    except Exception as error:  # noqa: BLE001 - no output yet is a finding, not a failure
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "stem string, path string, json string")
    return files.select(runtime.stem(F.input_file_name()).alias("stem"), F.input_file_name().alias("path"), F.col("value").alias("json"))


def benchmark(spark: SparkSession, manifest: str, outputs: str) -> Run:
    """All documents of a manifest against the goldens in the folder ``expected`` beside it, in one plan."""
    listed = jsondoc.read_json(spark, manifest, jsondoc.MANIFEST).select(F.posexplode("documents").alias("seq", "d"))
    rows = listed.select("seq", F.col("d.id").alias("doc_id"), "d.path", "d.language", "d.type", "d.features", "d.difficulty")
    actual, golden = _files(spark, outputs), _files(spark, f"{manifest.rsplit('/', 1)[0]}/expected")
    # A golden is called by its document, or begins so; it is the same for outputs.
    golden = golden.withColumn("stem", F.regexp_replace("stem", r"[.]expected$", ""))
    ids = rows.select("doc_id", F.col("doc_id").alias("stem"))
    found = lambda files, name: evals.pair_files(files, ids).select("doc_id", F.col("path").alias(f"{name}_path")).join(files.select(F.col("path").alias(f"{name}_path"), F.col("json").alias(name)), f"{name}_path", "left")
    pairs = ids.select("doc_id").join(found(actual, "actual"), "doc_id", "left").join(found(golden, "golden"), "doc_id", "left")
    error = F.when(F.col("actual").isNull(), "no output").when(F.col("golden").isNull(), "no golden").when(route(F.col("golden")).isNull() | F.json_object_keys("actual").isNull(), "not JSON")
    pairs = pairs.withColumn("error", error)
    # A few rows a document, read by every roll-up.
    metrics = compare(pairs.where("error IS NULL").select("doc_id", "actual", "golden")).persist()
    overall = evals.weighted(metrics).select("doc_id", F.round("overall", 4).alias("overall"))
    scores = rows.select("doc_id", "seq").join(pairs.select("doc_id", "error"), "doc_id").join(overall, "doc_id", "left").withColumn("overall", F.coalesce("overall", F.lit(0.0)))
    scores = scores.withColumn("status", evals.status(F.col("overall"), F.col("error"))).persist()
    gaps = evals.gaps(scores.where("error IS NULL"), rows.drop("seq", "path"))
    return Run(metrics, scores, evals.summary(scores), gaps, evals.weakest(gaps))
