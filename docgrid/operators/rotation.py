"""Rotation of a table: Hough votes on edges, the median angle, and the maps turned upright.

A map's votes are counted in one task, some angles at a time; only cells with enough come out. vote_levels has the votes
as a relation: edge pixels are exploded to (rho, theta) cells, coarse ones first.
"""

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.functions.lineage import pinned
from docgrid.operators.groups import map_groups, met
from docgrid.operators.raster import channel, sobel
from docgrid.schemas import HORIZONTAL, IMPLICIT_HORIZONTAL, IMPLICIT_VERTICAL, VERTICAL

#: Step of the angle in degrees, votes that make a line, least angle worth turning.
STEP, VOTES, LEAST_ANGLE = 0.1, 400, 0.1
#: Votes that a task counts at a time.
VOTES_AT_ONCE = 1 << 16
#: Vote cells of the level before the last, in degrees and rhos; those of the levels before it are so many times as large each way.
COARSE, COARSER = (1.6, 16), (8, 1)


def _bound(x: Column, y: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """The least and the largest x cos + y sin over angles from low to high (radians): at the ends, or where the normal points at the place or away from it."""
    at = lambda t: x * F.cos(t) + y * F.sin(t)
    top, far = F.atan2(y, x), F.hypot(x, y)
    inside = lambda t: (low < t) & (t < high)
    least = F.when(inside(top + math.pi) | inside(top - math.pi), -far).otherwise(F.least(at(low), at(high)))
    most = F.when(inside(top), far).otherwise(F.greatest(at(low), at(high)))
    return least - 1e-6, most + 1e-6


def vote_levels(edges: DataFrame, by: Sequence[str], step: float = STEP, votes: int = VOTES) -> list[DataFrame]:
    """The vote cells (by, x, y, k, rho) of each level, coarse ones first: at each, one row for a pixel and a cell that it may vote in.

    A coarse cell holds a range of angles and of rho. A pixel stands in it if it votes for any fine cell within, so no
    fine cell has more votes than its coarse cell has pixels, and only cells with more than `votes` are refined. The
    last level has single angles and rhos; it lacks only cells that can't pass. Pixels are dealt out by place and
    written, as each becomes many rows; the cells to refine are written, too, so that Spark knows how few they are.
    """
    n, coarse = round(180 / step), max(1, round(COARSE[0] / step))
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = edges.select(*by, "x", "y").repartition(parts, *by, "x", "y")
    dealt = pinned(dealt) if coarse >= 4 else dealt
    x, y, levels, parent = F.col("x"), F.col("y"), [], None
    # of a few hundred angles or less, coarse levels would cost more than they save
    for size, wide in (*((coarse * c, COARSE[1] * c) for c in COARSER if coarse >= 4), (1, 1)):
        if parent is None:
            held, first, last = dealt, F.lit(0), F.lit((n - 1) // size)
        else:
            cells, parent_size, parent_wide = parent
            full = pinned(cells.groupBy(*by, "k", "rho").agg(F.count("*").alias("n")).where(F.col("n") > votes).select(*by, "k", "rho"))
            held = cells.join(full, [*by, "k", "rho"]).select(*by, "x", "y", F.col("k").alias("_k"), F.col("rho").alias("_rho"))
            first, last = F.col("_k") * parent_size, F.least((F.col("_k") + 1) * parent_size, F.lit(n)) - 1
            first, last = F.floor(first / size), F.floor(last / size)
        spread = held.withColumn("k", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
        if size == 1 and wide == 1:
            theta = F.radians(F.col("k") * step)
            spread = spread.withColumn("rho", F.round(x * F.cos(theta) + y * F.sin(theta)).cast("int"))
        else:
            low, high = F.radians(F.col("k") * size * step), F.radians((F.least((F.col("k") + 1) * size, F.lit(n)) - 1) * step)
            ends = [F.floor(F.round(v) / wide).cast("int") for v in _bound(x, y, low, high)]
            spread = spread.withColumn("rho", F.explode(F.sequence(*ends)))
        if parent is not None:
            spread = spread.where(F.floor(F.col("rho") * wide / parent_wide) == F.col("_rho")).drop("_k", "_rho")
        levels.append(spread)
        parent = spread, size, wide
    return levels


def hough_lines(edges: DataFrame, by: Sequence[str], step: float = STEP, votes: int = VOTES) -> DataFrame:
    """(by, rho, k, votes): lines x cos + y sin = rho at theta = k * step with enough votes, local peaks among the four neighbours.

    Of equal neighbours the one with the smaller rho or theta stays. A map's edge pixels are one group, whose votes are
    counted in the task, some angles at a time; a cell without enough of them is no peak and outvotes none, so only
    those with enough come out, and peaks are sought among them.
    """
    turns = [math.radians(k * step) for k in range(round(180 / step))]
    cos, sin = np.array([math.cos(t) for t in turns]), np.array([math.sin(t) for t in turns])

    def counts(group: pa.Table) -> dict:
        x, y = (group.column(c).to_numpy().astype(float) for c in ("x", "y"))
        out = []
        width = max(1, VOTES_AT_ONCE // len(x))
        reach = int(np.hypot(x, y).max()) + 2
        for low in range(0, len(turns), width):
            c, s = cos[low : low + width, None], sin[low : low + width, None]
            value = c * x
            value += s * y
            rho = np.trunc(value)
            value -= rho
            value *= 2
            rho += np.trunc(value, out=value)  # halves away from zero
            rho += reach + (2 * reach + 1) * np.arange(len(c))[:, None]
            n = np.bincount(rho.ravel().astype(np.int64))
            full = np.flatnonzero(n > votes)
            out.append((full % (2 * reach + 1) - reach, full // (2 * reach + 1) + low, n[full]))
        return {name: np.concatenate(v).tolist() for name, v in zip(("rho", "k", "votes"), zip(*out, strict=True), strict=True)}

    counted = map_groups(edges.select(*by, "x", "y"), by, [], counts, "rho int, k int, votes long")
    along = lambda fixed, moving: Window.partitionBy(*by, fixed).orderBy(moving)
    near = lambda fixed, moving, way: F.when((F.lag if way < 0 else F.lead)(moving).over(along(fixed, moving)) == F.col(moving) + way, (F.lag if way < 0 else F.lead)("votes").over(along(fixed, moving)))
    peaks = counted
    for name, fixed, moving, way in (("left", "k", "rho", -1), ("right", "k", "rho", 1), ("up", "rho", "k", -1), ("down", "rho", "k", 1)):
        peaks = peaks.withColumn(name, F.coalesce(near(fixed, moving, way), F.lit(0)))
    return peaks.where((F.col("votes") > F.col("left")) & (F.col("votes") >= F.col("right")) & (F.col("votes") > F.col("up")) & (F.col("votes") >= F.col("down"))).select(*by, "rho", "k", "votes")


def line_angle(theta_degrees: Column, horizontal: bool) -> Column:
    """The tilt in degrees that a line's normal angle says: horizontals stand at 90; what passes 90 turns back by 180."""
    tilt = theta_degrees - 90 if horizontal else theta_degrees
    return F.when(tilt > 90, tilt - 180).otherwise(tilt)


def table_angles(pixels: DataFrame, tables: DataFrame, by: Sequence[str], step: float = STEP, votes: int = VOTES) -> DataFrame:
    """(by, angle): the median tilt of the lines of both directions; 0 without any. tables: (by) of all tables."""
    sides = [(True, "y", (HORIZONTAL, IMPLICIT_HORIZONTAL)), (False, "x", (VERTICAL, IMPLICIT_VERTICAL))]
    edges = [sobel(channel(pixels, *parts), axis, by).withColumn("across", F.lit(across)) for across, axis, parts in sides]
    tilt = F.when(F.col("across"), line_angle(F.col("k") * step, True)).otherwise(line_angle(F.col("k") * step, False))
    found = hough_lines(edges[0].unionByName(edges[1]), [*by, "across"], step, votes)
    median = found.groupBy(*by).agg(F.median(tilt).alias("angle"))
    return met(tables.select(*by).distinct(), median, by, "left").select(*by, F.coalesce("angle", F.lit(0.0)).alias("angle"))


def turned(x: Column, y: Column, angle: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    """A place turned about a centre by an angle in degrees (counter-clockwise on screen); the inverse turns by -angle."""
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    return c * (x - cx) + s * (y - cy) + cx, c * (y - cy) - s * (x - cx) + cy


def rotate(pixels: DataFrame, by: Sequence[str], width: int | Column, height: int | Column) -> DataFrame:
    """Binary maps (by, channel, y, x, angle) turned about their centre, bilinear, halves up; angle must be a column.

    Each pixel sends to the places near its image the weight with which they read it; sums of a half or more are set.
    """
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    w, h = as_column(width), as_column(height)
    flat = pixels.where(F.abs("angle") <= LEAST_ANGLE)
    px, py = turned(F.col("x"), F.col("y"), F.col("angle"), w / 2, h / 2)
    reach = range(-2, 3)
    near = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in reach for dx in reach]))
    sent = pixels.where(F.abs("angle") > LEAST_ANGLE).withColumn("px", F.round(px).cast("int")).withColumn("py", F.round(py).cast("int")).withColumn("k", near)
    sent = sent.withColumn("tx", F.col("px") + F.col("k.dx")).withColumn("ty", F.col("py") + F.col("k.dy"))
    bx, by_ = turned(F.col("tx"), F.col("ty"), -F.col("angle"), w / 2, h / 2)
    weight = F.greatest(F.lit(0.0), 1 - F.abs(bx - F.col("x"))) * F.greatest(F.lit(0.0), 1 - F.abs(by_ - F.col("y")))
    sent = sent.withColumn("weight", weight).where((F.col("weight") > 0) & (F.col("tx") >= 0) & (F.col("tx") < w) & (F.col("ty") >= 0) & (F.col("ty") < h))
    keys = [*by, "channel", "angle"]
    image = sent.groupBy(*keys, "ty", "tx").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= 0.5 - 1e-9).select(*keys, F.col("ty").alias("y"), F.col("tx").alias("x"))
    return flat.select(*keys, "y", "x").unionByName(image)


def matrix(angle: float, cx: float, cy: float) -> list[list[float]]:
    """The 3x3 matrix of `turned`."""
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    return [[c, s, (1 - c) * cx - s * cy], [-s, c, s * cx + (1 - c) * cy], [0.0, 0.0, 1.0]]
