"""Images resized: separable resampling by tables of weights, along rows and then along columns.

An image is rows (by, y, x, values); sizes come a row per image. A table of weights has, for each pair of sizes that
occurs, the places that an output place reads and how much of each, places beyond an edge counted for the edge; a
border that repeats the edge is part of the table. A pass is an equi-join on the place and a sum, so an image may be
larger than a task, and only pixels, not images, are shuffled.
"""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ways to resample, as named in `mode` columns.
MODES = ("nearest", "linear", "cubic", "area", "lanczos")
#: Fixed value: the parameter of the cubic kernel.
CUBIC = -0.75


def _cubic(d: Column) -> Column:
    near = ((CUBIC + 2) * d - (CUBIC + 3)) * d * d + 1
    far = ((CUBIC * d - 5 * CUBIC) * d + 8 * CUBIC) * d - 4 * CUBIC
    return F.when(d <= 1, near).when(d < 2, far).otherwise(0.0)


def _lanczos(d: Column) -> Column:
    """Before the eight weights are brought to a sum of one."""
    turn = d * math.pi
    return F.when(d < 1e-9, 1.0).when(d >= 4, 0.0).otherwise(4 * F.sin(turn) * F.sin(turn / 4) / (turn * turn))


def weights(sizes: DataFrame) -> DataFrame:
    """(n_in, n_out, before, n_all, mode, at, to, weight) for distinct (n_in, n_out, before, n_all, mode).

    n_in places become n_out, which stand in n_all places after `before` places of border. Areas that grow are
    resampled linearly with the fraction of the place beyond an input's end.
    """
    keys = ["n_in", "n_out", "before", "n_all", "mode"]
    out = sizes.select(*keys).distinct().withColumn("to", F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)))
    i = F.least(F.greatest(F.col("to") - F.col("before"), F.lit(0)), F.col("n_out") - 1)
    out = out.withColumn("i", i).withColumn("scale", F.col("n_in") / F.col("n_out"))
    out = out.withColumn("pos", (F.col("i") + 0.5) * F.col("scale") - 0.5)
    mode, pos, scale, i = F.col("mode"), F.col("pos"), F.col("scale"), F.col("i")
    shrinks = (mode == "area") & (scale > 1)
    base = F.floor(pos)
    first = F.when(mode == "nearest", F.floor(i * scale)).when(mode == "cubic", base - 1).when(mode == "lanczos", base - 3).when(mode == "area", F.floor(i * scale + 1e-9)).otherwise(base)
    last = F.when(mode == "nearest", F.floor(i * scale)).when(mode == "cubic", base + 2).when(mode == "lanczos", base + 4).when(shrinks, F.ceil((i + 1) * scale - 1e-9) - 1).when(mode == "area", F.floor(i * scale + 1e-9) + 1).otherwise(base + 1)
    out = out.withColumn("first", first).withColumn("tap", F.explode(F.sequence(first, last)))
    tap, away = F.col("tap"), F.abs(F.col("pos") - F.col("tap"))
    beyond = (i + 1) - (F.col("first") + 1) / scale
    beyond = F.when(beyond <= 0, 0.0).otherwise(beyond - F.floor(beyond))
    grown = F.when(tap == F.col("first"), 1 - beyond).otherwise(beyond)
    covered = (F.least((i + 1) * scale, tap + 1) - F.greatest(i * scale, tap)) / scale
    weight = F.when(mode == "nearest", 1.0).when(mode == "cubic", _cubic(away)).when(mode == "lanczos", _lanczos(away)).when(shrinks, covered).when(mode == "area", grown).otherwise(1 - away)
    at = F.least(F.greatest(tap, F.lit(0)), F.col("n_in") - 1).cast("int").alias("at")
    summed = out.select(*keys, "to", at, weight.alias("weight")).groupBy(*keys, "to", "at").agg(F.sum("weight").alias("weight"))
    total = summed.groupBy(*keys, "to").agg(F.sum("weight").alias("total"))
    return summed.join(total, [*keys, "to"]).select(*keys, "at", "to", (F.col("weight") / F.col("total")).alias("weight")).where("weight <> 0")


def resampled(pixels: DataFrame, sizes: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(by, y, x, values as doubles) of resized images.

    pixels: (by, y, x, values), every place of an image once; sizes: (by, height, width, out_h, out_w, mode), and, for
    a border, left, top, all_w, all_h: the image's place in it and its size. Images without sizes are left out.
    """
    if "all_w" not in sizes.columns:
        sizes = sizes.withColumns({"left": F.lit(0), "top": F.lit(0), "all_w": F.col("out_w"), "all_h": F.col("out_h")})
    keys = ["n_in", "n_out", "before", "n_all", "mode"]
    named = {"x": ("width", "out_w", "left", "all_w"), "y": ("height", "out_h", "top", "all_h")}
    out = pixels.select(*by, "y", "x", *values)
    for axis, other in (("x", "y"), ("y", "x")):
        own = sizes.select(*by, *[F.col(c).cast("int").alias(k) for k, c in zip(keys, named[axis], strict=False)], "mode")
        table = weights(own)
        met = out.join(own, list(by)).join(table, [*[table[k] == own[k] for k in keys], table["at"] == out[axis]])
        sums = [F.sum(F.col(v) * F.col("weight")).alias(v) for v in values]
        out = met.groupBy(*[out[c] for c in by], out[other], table["to"].alias(axis)).agg(*sums)
    return out.select(*by, "y", "x", *values)


def as_bytes(value: Column) -> Column:
    """Rounded and cut to 0 to 255."""
    return F.least(F.greatest(F.round(value), F.lit(0.0)), F.lit(255.0)).cast("int")
