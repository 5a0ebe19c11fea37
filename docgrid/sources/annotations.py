"""Annotation documents (XML) as relations, and their pairing with images."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.functions.coords import points
from docgrid.operators.training import ranked
from docgrid.schemas import ANNOTATION
from docgrid.sources.files import base_name, stem


def read_annotations(spark: SparkSession, folder: str) -> DataFrame:
    """(path, stem, filename, table): a row per document; the schema is fixed, so nothing is inferred."""
    raw = spark.read.format("xml").option("rowTag", "document").schema(ANNOTATION).load(folder)
    path = F.col("_metadata.file_path")
    return raw.select(path.alias("path"), stem(path).alias("stem"), F.col("_filename").alias("filename"), F.col("table"))


def packed_annotations(files: DataFrame) -> DataFrame:
    """The same of files (name, content) that are rows; path is the file's name. A text that isn't XML is an error."""
    table = F.from_xml(F.col("content").cast("string"), ANNOTATION, {"mode": "FAILFAST"}).alias("document")
    return files.select(F.col("name").alias("path"), stem(F.col("name")).alias("stem"), table).select("path", "stem", F.col("document._filename").alias("filename"), F.col("document.table").alias("table"))


def annotated_cells(documents: DataFrame, *kept: str) -> DataFrame:
    """(stem, kept, table_id, cell_id, quad, top, bottom, left, right, rows and columns): a row per cell; flags: any number but zero. kept: columns of the document that each cell carries."""
    tables = documents.select("stem", *kept, F.posexplode("table").alias("table_id", "t"))
    cells = tables.select("stem", *kept, "table_id", F.posexplode("t.cell").alias("cell_id", "c"))
    flags = [(F.coalesce(F.col(f"c.Lines._{side}"), F.lit(0)) != 0).alias(side) for side in ("top", "bottom", "left", "right")]
    spans = [F.col(f"c.`_{a}-{b}`").alias(f"{a}_{b}") for b in ("row", "col") for a in ("start", "end")]
    return cells.select("stem", *kept, "table_id", "cell_id", points(F.col("c.Coords._points")).alias("quad"), *flags, *spans)


def annotated_images(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Images (path) that an annotation with the same stem exists for."""
    return images.withColumn("stem", stem(F.col("path"))).join(annotations.select("stem").distinct(), "stem", "left_semi").drop("stem")


def paired(annotations: DataFrame, images: DataFrame, strict: bool = True) -> DataFrame:
    """Annotations (path, filename) with the one image (path) that has their file name: (path, filename, image, matches).

    strict: no image or several raise an error when the row is read; else image is null and matches tells.
    """
    named = images.select(base_name(F.col("path")).alias("filename"), F.col("path").alias("image"))
    counted = named.groupBy("filename").agg(F.count("*").alias("matches"), F.first("image").alias("image"))
    joined = annotations.select("path", "filename").join(counted, "filename", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    one = F.when(F.col("matches") == 1, F.col("image"))
    if strict:
        one = one.when(F.col("matches") == 0, F.raise_error(F.concat(F.lit("no image for "), "filename")).cast("string")).otherwise(F.raise_error(F.concat(F.lit("several images for "), "filename")).cast("string"))
    return joined.select("path", "filename", one.alias("image"), "matches")


def copy_manifest(pairs: DataFrame) -> DataFrame:
    """(source, target): each paired image goes beside its annotation; copying is left to the caller."""
    return pairs.where("matches = 1").select(F.col("image").alias("source"), F.concat(F.regexp_extract("path", r"^(.*/)[^/]*$", 1), base_name(F.col("image"))).alias("target"))


def any_record(records: DataFrame, seed: int | None = None) -> DataFrame:
    """One record, drawn at random: the least of random numbers, found in one pass; none of an empty table."""
    row = F.struct(*[F.col(f"`{c}`") for c in records.columns])
    drawn = records.select(row.alias("row"), F.rand(seed).alias("at"))
    return drawn.agg(F.min_by("row", "at").alias("row")).where("row IS NOT NULL").select("row.*")


def record_at(records: DataFrame, index: int, order: Sequence[Column], seed: int | None = None) -> DataFrame:
    """The record at a position, from 0 in the given order (-1: any record); none beyond the end. No task sorts all records."""
    if index == -1:
        return any_record(records, seed)
    return ranked(records, [], order).where(F.col("rank") == index + 1).drop("rank")
