"""Listings of input files, and images as pixels."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The endings that count as images, as written.
IMAGES = ("jpg", "jpeg", "png", "JPG", "tiff", "TIFF")


def listing(spark: SparkSession, folder: str, *endings: str) -> DataFrame:
    """(path, length) of the files below a folder, at any depth, that have one of the endings as written; none: all. Files without a byte aren't listed, as Spark's readers pass over them."""
    pattern = f"*.{{{','.join(endings)}}}" if endings else "*"
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "length")


def image_listing(spark: SparkSession, folder: str) -> DataFrame:
    return listing(spark, folder, *IMAGES)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def ending(path: Column) -> Column:
    """The ending in small letters, without the dot."""
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def kind(path: Column) -> Column:
    """image, annotation, pdf or null, by the ending in any case."""
    e = ending(path)
    return F.when(e.isin("jpg", "jpeg", "png", "gif", "bmp", "pgm", "tif", "tiff"), "image").when(e.isin("xml", "gt", "txt", "json"), "annotation").when(e == "pdf", "pdf")


def input_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, kind) of what a run reads: of a folder its images, else its PDFs, else its XML; a file stands for itself."""
    kinds = listing(spark, path).withColumn("kind", F.when(F.regexp_extract("path", r"\.([^./]*)$", 1).isin(*IMAGES), "image").when(ending(F.col("path")) == "pdf", "pdf").when(ending(F.col("path")) == "xml", "xml"))
    rank = F.when(F.col("kind") == "image", 1).when(F.col("kind") == "pdf", 2).otherwise(3)
    ranked = kinds.where("kind IS NOT NULL").withColumn("rank", rank)
    first = ranked.agg(F.min("rank").alias("rank"))  # one row
    return ranked.join(F.broadcast(first), "rank").drop("rank")


def with_sibling(files: DataFrame, others: DataFrame) -> DataFrame:
    """Files (path, ...) that have one of others with the same stem in the same folder."""
    key = lambda d: d.select("*", folder_of(F.col("path")).alias("_dir"), stem(F.col("path")).alias("_stem"))
    return key(files).join(key(others).select("_dir", "_stem"), ["_dir", "_stem"], "left_semi").drop("_dir", "_stem")


def without_sibling(files: DataFrame, others: DataFrame) -> DataFrame:
    """The report of with_sibling: files that have none."""
    key = lambda d: d.select("*", folder_of(F.col("path")).alias("_dir"), stem(F.col("path")).alias("_stem"))
    return key(files).join(key(others).select("_dir", "_stem"), ["_dir", "_stem"], "left_anti").drop("_dir", "_stem")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, height, width, rgb): decoded images, rows of red, green, blue bytes; grey becomes three channels, alpha goes."""
    images = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, data in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                pixels = np.frombuffer(data, np.uint8).reshape(-1, n)
                out.append(np.ascontiguousarray(np.repeat(pixels, 3, axis=1) if n == 1 else pixels[:, 2::-1]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["path", "height", "width", "rgb"])

    return images.mapInArrow(swap, "path string, height int, width int, rgb binary")
