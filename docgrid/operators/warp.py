"""Images through projective maps, bilinear, by tiles: a tile of the target meets the tiles of the source that it reads.

An image is rows (by, y, x, values), absent places are zero. Which source tiles a target tile reads follows from where
its corners come from, as a projective map takes straight lines to straight lines; where the tile crosses the map's
horizon, from all. A pair of tiles gives each target place its part of the sum, so a task holds two tiles, however
large an image is and however far it is drawn out, and only narrow sums are grouped.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE = 64


def inverse(h: Sequence[Column]) -> list[Column]:
    """The nine numbers of the inverse of a projective map, up to a factor."""
    a, b, c, d, e, f, g, i, j = h
    return [e * j - f * i, c * i - b * j, b * f - c * e, f * g - d * j, a * j - c * g, c * d - a * f, d * i - e * g, b * g - a * i, a * e - b * d]


def _pairs(maps: DataFrame, by: Sequence[str], side: int) -> DataFrame:
    """(by, height, width, g, ty, tx, sy, sx): the source tiles that each target tile reads."""
    tiles = lambda size: F.explode(F.sequence(F.lit(0), F.floor((F.col(size) - 1) / side).cast("int")))
    out = maps.withColumn("ty", tiles("height")).withColumn("tx", tiles("width"))
    g = [F.col("g")[k] for k in range(9)]
    right, low = F.least((F.col("tx") + 1) * side, F.col("width")) - 1, F.least((F.col("ty") + 1) * side, F.col("height")) - 1
    corners = [(x, y) for y in (F.col("ty") * side, low) for x in (F.col("tx") * side, right)]
    depth = [g[6] * x + g[7] * y + g[8] for x, y in corners]
    out = out.withColumn("crosses", (F.least(*depth) <= 0) & (F.greatest(*depth) >= 0))
    places = [((g[0] * x + g[1] * y + g[2]) / w, (g[3] * x + g[4] * y + g[5]) / w) for (x, y), w in zip(corners, depth, strict=True)]

    def reach(k: int, size: str) -> Column:
        """Tiles of an axis from the least place that is read to the largest; none outside of the image."""
        last = F.floor((F.col(size) - 1) / side)
        first, end = F.floor(F.least(*[p[k] for p in places]) / side - 1e-9), F.floor((F.greatest(*[p[k] for p in places]) + 1) / side + 1e-9)
        first = F.when(F.col("crosses"), 0).otherwise(F.greatest(first, F.lit(0))).cast("int")
        end = F.when(F.col("crosses"), last).otherwise(F.least(end, last)).cast("int")
        return F.explode(F.when(first <= end, F.sequence(first, end)))

    return out.withColumn("sy", reach(1, "height")).withColumn("sx", reach(0, "width")).drop("crosses")


def warped_pixels(pixels: DataFrame, maps: DataFrame, by: Sequence[str], values: Sequence[str], side: int = SIDE) -> DataFrame:
    """(by, y, x, values as doubles) of images through their maps; places that nothing falls to are absent.

    maps: (by, height, width, h), h an array of the nine numbers of the map from source to target, which has the same
    size. Images without a map are left out.
    """
    keys, n = list(by), len(values)
    place = F.struct(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *[F.col(v).cast("double").alias(f"v{k}") for k, v in enumerate(values)])
    source = pixels.groupBy(*keys, F.floor(F.col("y") / side).cast("int").alias("sy"), F.floor(F.col("x") / side).cast("int").alias("sx")).agg(F.collect_list(place).alias("held"))
    g = F.array(*inverse([F.col("h")[k].cast("double") for k in range(9)]))
    pairs = _pairs(maps.select(*keys, F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), g.alias("g")), keys, side)
    met = pairs.join(source, [*keys, "sy", "sx"]).select(*keys, "height", "width", "g", "ty", "tx", "sy", "sx", "held")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in ("height", "width", "ty", "tx", "sy", "sx")}
                held = batch.column("held").slice(r, 1).flatten()
                sy, sx, *of = (held.field(k).to_numpy(zero_copy_only=False) for k in range(n + 2))
                tile = np.zeros((n, side, side))
                tile[:, sy - row["sy"] * side, sx - row["sx"] * side] = of
                y, x, found = _sums(tile, np.array(batch.column("g")[r].as_py()), side=side, **row)
                if len(y):
                    same = [pa.repeat(batch.column(c)[r], len(y)) for c in keys]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(y, pa.int32()), pa.array(x, pa.int32()), *map(pa.array, found)], [*keys, "y", "x", *[f"v{k}" for k in range(n)]])

    kinds = ", ".join([*(f"`{k}` {pixels.schema[k].dataType.simpleString()}" for k in keys), "y int, x int", *(f"v{k} double" for k in range(n))])
    sums = met.mapInArrow(run, kinds)
    return sums.groupBy(*keys, "y", "x").agg(*[F.sum(f"v{k}").alias(v) for k, v in enumerate(values)])


def _sums(tile: np.ndarray, g: np.ndarray, height: int, width: int, ty: int, tx: int, sy: int, sx: int, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, x, sums) of the target tile's places that read this source tile."""
    y, x = np.mgrid[ty * side : min((ty + 1) * side, height), tx * side : min((tx + 1) * side, width)].reshape(2, -1)
    depth = g[6] * x + g[7] * y + g[8]
    with np.errstate(divide="ignore", invalid="ignore"):
        u, v = ((g[k] * x + g[k + 1] * y + g[k + 2]) / depth for k in (0, 3))
    seen = np.flatnonzero(np.isfinite(u) & np.isfinite(v) & (np.abs(u) < 2**30) & (np.abs(v) < 2**30))
    y, x, u, v = y[seen], x[seen], u[seen], v[seen]
    left, top = np.floor(u).astype(np.int64), np.floor(v).astype(np.int64)
    total, read = np.zeros((len(tile), len(y))), np.zeros(len(y), bool)
    for dy in (0, 1):
        for dx in (0, 1):
            a, b = top + dy - sy * side, left + dx - sx * side
            weight = (1 - np.abs(v - top - dy)) * (1 - np.abs(u - left - dx))
            inside = np.flatnonzero((a >= 0) & (a < side) & (b >= 0) & (b < side) & (weight > 0))
            total[:, inside] += tile[:, a[inside], b[inside]] * weight[inside]
            read[inside] = True
    read = np.flatnonzero(read & (total != 0).any(axis=0))
    return y[read], x[read], total[:, read]
