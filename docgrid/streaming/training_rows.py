"""Endless training rows: a dataset drawn by weight, a record of it, the transform of its boxes, and its score map, in one plan.

A row has a number; all draws are hashes of that number, so a number gives the same row wherever and whenever it is
made. The stream counts with Spark's rate-micro-batch source, whose batches are the same numbers after a restart.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docgrid.functions import augment
from docgrid.functions.coords import to_absolute
from docgrid.operators import training


def numbered_records(records: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Records (dataset, ...) with nth, from 0 in the given order within each dataset, however large it is."""
    found = training.ranked(records, ["dataset"], order)
    return found.select(*records.columns, (F.col("rank") - 1).alias("nth"))


def training_rows(numbers: DataFrame, weights: DataFrame, records: DataFrame, size: int = 1024, scale_down: int = 2) -> DataFrame:
    """(number, dataset, nth, channel, y, x, score): the score maps of the rows with these numbers.

    weights: (dataset, weight) of at most MOST_DATASETS, repeats of none; records: (dataset, nth, width, height, cells)
    as `numbered_records` gives them, cells an array of (quad in places of the image, top, bottom, left, right). A
    dataset without records is never drawn. The map is a square of size / scale_down, boxes outside of it are cut.
    """
    sizes = records.groupBy("dataset").agg(F.count("*").alias("n"))
    held = weights.join(sizes, "dataset").where("weight > 0")
    drawn = training.alias_mixture(numbers.withColumn("draw", augment.draw(F.col("number"), "dataset")), held).drop("draw")
    placed = drawn.join(F.broadcast(held.select("dataset", "n")), "dataset")  # at most MOST_DATASETS rows
    placed = placed.select("number", "dataset", F.floor(augment.draw(F.col("number"), "record") * F.col("n")).alias("nth"))
    cells = placed.join(records, ["dataset", "nth"]).select("number", "dataset", "nth", "width", "height", F.explode("cells").alias("c"))
    shares = F.transform("c.quad", lambda v, i: v / F.when(i % 2 == 0, F.col("width")).otherwise(F.col("height")))
    boxes = cells.select("number", "dataset", "nth", "width", "height", shares.alias("quad"), "c.top", "c.bottom", "c.left", "c.right")
    side = size // scale_down
    moved = augment.augmented_boxes(boxes, "number", size)
    moved = moved.withColumn("quad", to_absolute(F.col("quad"), F.lit(float(side)), F.lit(float(side))))
    drawn_maps = training.rasterised(moved, ["number", "dataset", "nth"])
    return drawn_maps.where((F.col("x") < side) & (F.col("y") < side))


def stream_training_rows(spark: SparkSession, weights: DataFrame, records: DataFrame, outbox: str, checkpoint: str, rows: int = 64, seconds: int = 1, size: int = 1024) -> StreamingQuery:
    """Writes `rows` training rows a batch below outbox, a folder per batch, without end; a batch that is done again replaces its folder."""
    numbers = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows).option("startTimestamp", 0).option("advanceMillisPerBatch", 1000).load().select(F.col("value").alias("number"))

    def step(batch: DataFrame, number: int) -> None:
        training_rows(batch, weights, records, size).write.mode("overwrite").parquet(f"{outbox}/batch={number}")

    return numbers.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
