"""Documents, goldens and manifests in JSON, with explicit schemas, and their long forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ITEM = "type:string,panel_id:string,class:int,class_candidates:array<int>,start_depth:double,end_depth:double,depth:double,depth_tolerance:double,axis_labels:struct<x:string,y:string>"
_META = f"rows:int,cols:int,role:string,chart_data:array<struct<{_ITEM}>>"
DOCUMENT = f"source string, metadata map<string,string>, warnings array<string>, pages array<struct<number:int,width:double,height:double,warnings:array<string>,blocks:array<struct<type:string,text:string,bbox:array<double>,confidence:double,engine:string,metadata:struct<{_META}>>>>>"
_AXIS = "struct<label:string,min:double,max:double>"
CHART_GOLDEN = f"sample_id string, description string, required_terms array<string>, panels array<struct<id:string,caption:string,x_axis:{_AXIS},y_axis:{_AXIS},predicted_intervals:array<struct<class:int,start_depth:double,end_depth:double>>,predicted_points:array<struct<class:int,depth:double>>>>"
MANIFEST = "name string, version string, description string, documents array<struct<id:string,path:string,language:string,type:string,features:array<string>,difficulty:string,ocr_required:boolean,ocr_lang:string,notes:string>>"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole files of one JSON value each, with the file's name as ``file``."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def blocks(documents: DataFrame, key: str = "file") -> DataFrame:
    """All blocks in long form: key, page_no, block_seq, width, height, type, text, x0..y1, confidence, engine, n_rows, n_cols, chart."""
    pages = documents.select(key, F.explode("pages").alias("p"))
    rows = pages.select(key, (F.col("p.number") - 1).alias("page_no"), F.col("p.width").alias("width"), F.col("p.height").alias("height"), F.posexplode("p.blocks").alias("block_seq", "b"))
    box = [F.get("b.bbox", i).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    return rows.select(key, "page_no", "block_seq", "width", "height", "b.type", "b.text", *box, "b.confidence", "b.engine", F.col("b.metadata.rows").alias("n_rows"), F.col("b.metadata.cols").alias("n_cols"), F.col("b.metadata.chart_data").alias("chart"))


def chart_items(documents: DataFrame, key: str = "file") -> DataFrame:
    """Chart items of all blocks: key, page_no, seq, item_type, panel_id, class and so on."""
    own = blocks(documents, key).select(key, "page_no", "block_seq", F.posexplode("chart").alias("i", "c"))
    return own.select(key, "page_no", (F.col("block_seq") * 1000 + F.col("i")).alias("seq"), F.col("c.type").alias("item_type"), "c.panel_id", "c.class", "c.class_candidates", "c.start_depth", "c.end_depth", "c.depth", "c.depth_tolerance", F.col("c.axis_labels.x").alias("x_label"), F.col("c.axis_labels.y").alias("y_label"))


def texts(documents: DataFrame, key: str = "file") -> DataFrame:
    """(key, text): warnings, types, texts and metadata of a document, lower-cased, as searched by the scores."""
    page = lambda p: F.concat(F.coalesce(p["warnings"], F.array().cast("array<string>")), F.flatten(F.transform(p["blocks"], lambda b: F.array(F.coalesce(b["type"], F.lit("")), F.coalesce(b["text"], F.lit("")), F.coalesce(F.to_json(b["metadata"]), F.lit("{}"))))))
    whole = F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.flatten(F.transform("pages", page)))
    return documents.select(key, F.lower(F.array_join(whole, "\n")).alias("text"))


def expected_intervals(goldens: DataFrame, key: str = "file") -> DataFrame:
    own = goldens.select(key, F.posexplode("panels").alias("i", "p")).select(key, "i", F.col("p.id").alias("panel_id"), F.posexplode("p.predicted_intervals").alias("j", "x"))
    return own.select(key, (F.col("i") * 10000 + F.col("j")).alias("exp_id"), "panel_id", F.col("x.class").cast("string").alias("class"), "x.start_depth", "x.end_depth")


def expected_points(goldens: DataFrame, key: str = "file") -> DataFrame:
    own = goldens.select(key, F.posexplode("panels").alias("i", "p")).select(key, "i", F.col("p.id").alias("panel_id"), F.posexplode("p.predicted_points").alias("j", "x"))
    return own.select(key, (F.col("i") * 10000 + F.col("j")).alias("exp_id"), "panel_id", F.col("x.class").cast("string").alias("class"), "x.depth")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, language, type, features, difficulty, ...) of a manifest's documents."""
    return read_json(spark, path, MANIFEST).select(F.explode("documents").alias("d")).select(F.col("d.id").alias("doc_id"), "d.path", "d.language", "d.type", "d.features", "d.difficulty", "d.ocr_required", "d.ocr_lang", "d.notes")
