"""Results drawn over images, and score maps in false colours, as pixels; no image codec.

Quads are filled by scan lines: each edge gives its place on each row that it crosses, and the least and the largest
of a row are a span. Spans of a row are swept in order and merged before they are spread to pixels, so a pixel that
many quads cover is one row. Colours are blue, green, red from 0 to 255.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.operators.raster import to_byte
from docgrid.schemas import CORNER, HORIZONTAL, IMPLICIT_HORIZONTAL, IMPLICIT_VERTICAL, VERTICAL

#: Colours of cells' areas and outlines, the share of the areas; the shares of the image and of the scores, and what is added.
AREA, OUTLINE, AREA_SHARE = (0, 128, 0), (0, 0, 255), 0.2
IMAGE_SHARE, HEAT_SHARE, HEAT_OFFSET = 0.4, 0.6, 1.0


def _edges(quads: DataFrame, by: Sequence[str]) -> DataFrame:
    q = lambda k: F.col("quad")[k % 8].cast("int")
    edge = F.array(*[F.struct(q(2 * k).alias("x1"), q(2 * k + 1).alias("y1"), q(2 * k + 2).alias("x2"), q(2 * k + 3).alias("y2")) for k in range(4)])
    return quads.select(*by, "quad", F.explode(edge).alias("e")).select(*by, "quad", "e.*")


def spans(quads: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, y, a, b): the places [a, b] of each row that convex quads cover, corners and edges included; a row for each quad and row.

    quads: (by, quad), the corners x, y, ... in order.
    """
    rows = F.explode(F.sequence(F.least("y1", "y2"), F.greatest("y1", "y2")))
    met = _edges(quads, by).withColumn("y", rows)
    at = F.col("x1") + (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1"))
    flat = F.col("y1") == F.col("y2")
    ends = [F.when(flat, f("x1", "x2")).otherwise(F.round(at)).cast("int") for f in (F.least, F.greatest)]
    return met.groupBy(*by, "quad", "y").agg(F.min(ends[0]).alias("a"), F.max(ends[1]).alias("b")).drop("quad")


def merged_spans(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """Spans (by, y, a, b) of a row joined where they overlap or touch."""
    order = Window.partitionBy(*by, "y").orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = found.withColumn("new", F.coalesce((F.col("a") > before + 1).cast("int"), F.lit(1)))
    islands = begun.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "y", "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("island")


def covered(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, y, x): each pixel of spans once."""
    return merged_spans(found, by).select(*by, "y", F.explode(F.sequence("a", "b")).alias("x"))


def outlines(quads: DataFrame, by: Sequence[str], thickness: int = 2) -> DataFrame:
    """(by, y, x): the quads' edges, so many pixels thick, across their longer direction, from the line on to the right or below."""
    n = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    steps = _edges(quads, by).withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n")))).withColumn("off", F.explode(F.sequence(F.lit(0), F.lit(thickness - 1))))
    at = lambda a, b: F.round(F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / F.greatest("n", F.lit(1))).cast("int")
    flat = F.abs(F.col("x2") - F.col("x1")) >= F.abs(F.col("y2") - F.col("y1"))
    return steps.select(*by, (at("y1", "y2") + F.when(flat, F.col("off")).otherwise(0)).alias("y"), (at("x1", "x2") + F.when(flat, 0).otherwise(F.col("off"))).alias("x")).distinct()


def blended(one: Column, share: float, other: Column, other_share: float, offset: float = 0.0) -> Column:
    """The weighted sum of two bytes, rounded half to even and cut."""
    return F.least(F.greatest(F.bround(one * share + other * other_share + offset), F.lit(0.0)), F.lit(255.0)).cast("int")


def overlay(image: DataFrame, quads: DataFrame, by: Sequence[str], colours: Sequence[str] = ("b", "g", "r")) -> DataFrame:
    """(by, y, x, colours as bytes): an image with its cells' outlines, and their areas at AREA_SHARE."""
    keys = [*by, "y", "x"]
    areas = covered(spans(quads, by), by).withColumn("in_area", F.lit(True))
    drawn = outlines(quads, by).withColumn("in_outline", F.lit(True))
    marks = areas.join(drawn, keys, "full")
    out = image.select(*keys, *colours).join(marks, keys, "left")
    mixed = [blended(F.when(F.col("in_area"), area).otherwise(F.col(c)), AREA_SHARE, F.when(F.col("in_outline"), line).otherwise(F.col(c)), 1 - AREA_SHARE).alias(c) for c, area, line in zip(colours, AREA, OUTLINE, strict=True)]
    return out.select(*keys, *mixed)


def false_colours(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, y, x, corner, b, g, r): scores (by, channel, y, x, score) as bytes: corners alone, and lines in colours.

    Explicit horizontals are blue, verticals green; implicit horizontals yellow, verticals magenta. Sums beyond a byte wrap.
    """
    byte = {c: F.coalesce(F.max(F.when(F.col("channel") == c, to_byte(F.col("score")))), F.lit(0)) for c in range(5)}
    held = pixels.groupBy(*by, "y", "x").agg(*[byte[c].alias(f"_{c}") for c in range(5)])
    total = lambda *channels: (sum((F.col(f"_{c}") for c in channels), F.lit(0)) % 256).cast("int")
    return held.select(*by, "y", "x", F.col(f"_{CORNER}").alias("corner"), total(HORIZONTAL, IMPLICIT_VERTICAL).alias("b"), total(VERTICAL, IMPLICIT_HORIZONTAL).alias("g"), total(IMPLICIT_HORIZONTAL, IMPLICIT_VERTICAL).alias("r"))


def heat_over_image(image: DataFrame, heat: DataFrame, by: Sequence[str], colours: Sequence[str] = ("b", "g", "r")) -> DataFrame:
    """(by, y, x, colours): an image (colours as bytes) under a map in false colours; places without scores are black in the map."""
    shown = heat.select(*by, "y", "x", *[F.col(c).alias(f"_{c}") for c in colours])
    out = image.join(shown, [*by, "y", "x"], "left")
    return out.select(*by, "y", "x", *[blended(F.col(c), IMAGE_SHARE, F.coalesce(f"_{c}", F.lit(0)), HEAT_SHARE, HEAT_OFFSET).alias(c) for c in colours])
