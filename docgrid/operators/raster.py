"""Score maps as sparse relations: thresholds, masks, unions, projections, neighbourhoods.

A relation holds a row per pixel, (doc_id, channel, y, x, score); a pixel that is absent is zero. `by` names the
columns of one map (a document, or a table of a document); every shuffle is on them first.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.operators.groups import met
from docgrid.schemas import HORIZONTAL, IMPLICIT_HORIZONTAL, IMPLICIT_VERTICAL, VERTICAL

EDGES = (HORIZONTAL, VERTICAL, IMPLICIT_HORIZONTAL, IMPLICIT_VERTICAL)


def above_threshold(pixels: DataFrame, explicit: float = 0.3, low: float = 0.2) -> DataFrame:
    """Pixels above their channel's threshold, compared as single floats: explicit lines have one, corners and implicit lines another."""
    limit = F.when(F.col("channel").isin(HORIZONTAL, VERTICAL), F.lit(explicit)).otherwise(F.lit(low)).cast("float")
    return pixels.where(F.col("score") > limit)


def inside(pixels: DataFrame, x1: Column | int, y1: Column | int, x2: Column | int, y2: Column | int) -> DataFrame:
    """Pixels of the region of interest [y1, y2) x [x1, x2); bounds are numbers, which reach the scan, or columns."""
    bound = lambda v: v if isinstance(v, Column) else F.lit(v)
    return pixels.where((F.col("x") >= bound(x1)) & (F.col("x") < bound(x2)) & (F.col("y") >= bound(y1)) & (F.col("y") < bound(y2)))


def channel(pixels: DataFrame, *channels: int) -> DataFrame:
    return pixels.where(F.col("channel").isin(*channels))


def edge_union(pixels: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The set of pixels of the four edge channels; corners don't count."""
    return channel(pixels, *EDGES).select(*by, "y", "x").distinct()


def projection(pixels: DataFrame, axis: str, by: Sequence[str]) -> DataFrame:
    """(by, pos, v): pixels at each place of an axis ("x" or "y"); places without any are absent."""
    return pixels.groupBy(*by, F.col(axis).alias("pos")).agg(F.count("*").alias("v"))


def runs(pixels: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(by, channel, at, a, b): pixels as runs [a, b) along the lines of their channel: of x in row `at`, for verticals of y in column `at`. A pixel counts once."""
    down = F.col("channel").isin(VERTICAL, IMPLICIT_VERTICAL)
    laid = pixels.select(*by, "channel", F.when(down, F.col("x")).otherwise(F.col("y")).alias("at"), F.when(down, F.col("y")).otherwise(F.col("x")).alias("p"))
    keys = [*by, "channel", "at"]
    # 64 places of a line are the bits of one number: pixels are summed up, not sorted
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(63).cast("int"))
    words = laid.groupBy(*keys, F.shiftright("p", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    order = Window.partitionBy(*keys).orderBy("word")
    near = lambda f, step: F.coalesce(F.when(f("word").over(order) == F.col("word") + step, f("bits").over(order)), F.lit(0).cast("long"))
    begins = F.col("bits").bitwiseAND(F.bitwise_not(F.shiftleft("bits", 1).bitwiseOR(F.shiftrightunsigned("_before", 63))))
    ends = F.col("bits").bitwiseAND(F.bitwise_not(F.shiftrightunsigned("bits", 1).bitwiseOR(F.shiftleft("_after", 63))))
    marked = words.withColumn("_before", near(F.lag, -1)).withColumn("_after", near(F.lead, 1)).select(*keys, "word", begins.alias("_begins"), ends.alias("_ends"))
    at = lambda bits: F.call_function("shiftright", bits, F.col("_k")).bitwiseAND(1) == 1
    both = marked.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(63)))).where(at(F.col("_begins").bitwiseOR(F.col("_ends"))))
    # a run of one place is both its ends
    places = both.select(*keys, (F.col("word") * 64 + F.col("_k")).alias("p"), at(F.col("_begins")).alias("_first"), at(F.col("_ends")).alias("_last"))
    end = F.when(F.col("_last"), F.col("p")).otherwise(F.lead("p").over(Window.partitionBy(*keys).orderBy("p")))
    return places.withColumn("_end", end).where("_first").select(*keys, F.col("p").cast("int").alias("a"), (F.col("_end") + 1).cast("int").alias("b"))


def runs_inside(found: DataFrame, areas: DataFrame) -> DataFrame:
    """What of runs lies in their document's region of interest (doc_id, x1, y1, x2, y2), as `inside` has it of pixels."""
    down = F.col("channel").isin(VERTICAL, IMPLICIT_VERTICAL)
    bounds = [F.ceil(c).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")]
    held = met(found, areas.dropna(subset=["x1", "y1", "x2", "y2"]).select("doc_id", *bounds), ["doc_id"])
    way = lambda across, along: F.when(down, F.col(across)).otherwise(F.col(along))
    new = {"a": F.greatest(F.col("a"), way("_y1", "_x1")), "b": F.least(F.col("b"), way("_y2", "_x2"))}
    kept = held.where((F.col("at") >= way("_x1", "_y1")) & (F.col("at") < way("_x2", "_y2")))
    return kept.select(*[new[c].cast("int").alias(c) if c in new else c for c in found.columns]).where("a < b")


def pixels_of(found: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(by, channel, y, x) of runs."""
    down = F.col("channel").isin(VERTICAL, IMPLICIT_VERTICAL)
    each = found.select(*by, "channel", "at", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("p"))
    return each.select(*by, "channel", F.when(down, F.col("p")).otherwise(F.col("at")).alias("y"), F.when(down, F.col("at")).otherwise(F.col("p")).alias("x"))


def joined(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, a, b): the union of intervals [a, b), those that overlap or touch in one."""
    order = Window.partitionBy(*by).orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = found.select(*by, "a", "b", F.coalesce((F.col("a") > before).cast("int"), F.lit(1)).alias("new"))
    numbered = starts.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("run")


def run_profile(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, pos, v): pixels of runs that don't overlap, at each place across them."""
    return found.groupBy(*by, F.col("at").alias("pos")).agg(F.sum((F.col("b") - F.col("a")).cast("long")).alias("v"))


def dilate_x(pixels: DataFrame, by: Sequence[str], radius: int = 2, width: int | None = None) -> DataFrame:
    """Pixels within `radius` to the left or right of one, inside [0, width)."""
    spread = pixels.select(*by, "y", F.explode(F.sequence(F.col("x") - radius, F.col("x") + radius)).alias("x"))
    limits = F.col("x") >= 0 if width is None else (F.col("x") >= 0) & (F.col("x") < width)
    return spread.where(limits).distinct()


def maximum(heat: DataFrame, by: Sequence[str]) -> DataFrame:
    """The largest of overlapping heat values at each pixel."""
    return heat.groupBy(*by, "y", "x").agg(F.max("score").alias("score"))


def clipped(pixels: DataFrame, least: float = 0.05) -> DataFrame:
    """Scores under `least` are zero, that is absent."""
    return pixels.where(F.col("score") >= F.lit(least).cast("float"))


def to_byte(score: Column) -> Column:
    """A score as a byte from 0 to 255, cut, not rounded."""
    return F.least(F.greatest(score * 255, F.lit(0)), F.lit(255)).cast("int")


def table_rect(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, l, r, t, b): the extent in x from the horizontal channels and in y from the vertical ones; null without any."""
    across = F.col("channel").isin(HORIZONTAL, IMPLICIT_HORIZONTAL)
    down = F.col("channel").isin(VERTICAL, IMPLICIT_VERTICAL)
    return pixels.groupBy(*by).agg(F.min(F.when(across, F.col("x"))).alias("l"), F.max(F.when(across, F.col("x"))).alias("r"), F.min(F.when(down, F.col("y"))).alias("t"), F.max(F.when(down, F.col("y"))).alias("b"))


def run_rect(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same of runs."""
    across = F.col("channel").isin(HORIZONTAL, IMPLICIT_HORIZONTAL)
    down = F.col("channel").isin(VERTICAL, IMPLICIT_VERTICAL)
    a, last = F.col("a"), F.col("b") - 1
    return found.groupBy(*by).agg(F.min(F.when(across, a)).alias("l"), F.max(F.when(across, last)).alias("r"), F.min(F.when(down, a)).alias("t"), F.max(F.when(down, last)).alias("b"))


def sobel(pixels: DataFrame, axis: str, by: Sequence[str], height: int | Column | None = None, width: int | Column | None = None) -> DataFrame:
    """(by, y, x, v): the 3x3 first derivative along an axis of summed binary maps, cut to 0..255.

    Each pixel adds to its eight neighbours what they would read from it, so one explode and one sum do. Negative
    answers are absent. Places outside a map count as zero.
    """
    smooth = {-1: 1, 0: 2, 1: 1}
    steps = [(dy, dx, -d * smooth[o]) for d in (-1, 1) for o in (-1, 0, 1) for dy, dx in [(o, d) if axis == "x" else (d, o)]]
    shifts = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(w).alias("w")) for dy, dx, w in steps])
    spread = pixels.select(*by, "y", "x", F.explode(shifts).alias("k")).select(*by, (F.col("y") + F.col("k.dy")).alias("y"), (F.col("x") + F.col("k.dx")).alias("x"), F.col("k.w").alias("w"))
    spread = spread.where((F.col("x") >= 0) & (F.col("y") >= 0))
    if height is not None:
        spread = spread.where((F.col("y") < height) & (F.col("x") < width))
    return spread.groupBy(*by, "y", "x").agg(F.least(F.sum("w"), F.lit(255)).alias("v")).where("v > 0")
