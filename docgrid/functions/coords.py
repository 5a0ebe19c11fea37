"""Coordinates: resizing geometry, ratios, padding, projective maps, percentages, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sides are padded to a multiple of STEP and to MIN at least.
STEP, MIN = 320, 960


def _f(c: Column) -> Column:
    return c.cast("float")


def adjusted(values: Column, ratio_w: Column, ratio_h: Column, pad_x: Column, pad_y: Column, padded: int = -1) -> Column:
    """Places x, y, x, y, ... in source pixels: times the ratio, less the padding, cut to integers.

    Every step is kept as a single float, as computed in double. padded: how many leading numbers have the
    padding taken off (of a rectangle x, y, w, h the first two); -1 for all.
    """

    def one(v: Column, i: Column) -> Column:
        even = i % 2 == 0
        scaled = _f(_f(v).cast("double") * F.when(even, ratio_w).otherwise(ratio_h))
        moved = _f(scaled.cast("double") - F.when(even, pad_x).otherwise(pad_y))
        return (moved if padded < 0 else F.when(i < padded, moved).otherwise(scaled)).cast("int")

    return F.transform(values, one)


def projected(h: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """x, y through a 3x3 map (nine columns, by rows)."""
    w = h[6] * x + h[7] * y + h[8]
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def resize(height: Column, width: Column, square: int, magnify: float = 1.0, scale_down: int = 2) -> dict[str, Column]:
    """Geometry of the resized, padded image: ratio, target and padded sizes, paddings, region of interest, heat map size."""
    longest = F.greatest(height, width)
    target = F.least(longest * F.lit(magnify), F.lit(square)).cast("double")
    ratio = target / longest
    th, tw = (height * ratio).cast("int"), (width * ratio).cast("int")
    padded = lambda t: F.greatest(F.lit(MIN), F.ceil(t / STEP).cast("int") * STEP)
    ph, pw = padded(th), padded(tw)
    pad_x, pad_y = ((pw - tw) / 2).cast("int"), ((ph - th) / 2).cast("int")
    half = lambda v: (v / scale_down).cast("int")
    return {
        "target_h": th, "target_w": tw, "padded_h": ph, "padded_w": pw, "ratio_w": ratio / scale_down, "ratio_h": ratio / scale_down,
        "pad_x": pad_x / ratio, "pad_y": pad_y / ratio, "x1": half(pad_x), "y1": half(pad_y), "x2": half(pw - pad_x), "y2": half(ph - pad_y),
        "heat_w": half(pw), "heat_h": half(ph),
    }


def to_percent(values: Column, width: Column, height: Column) -> Column:
    """Places x, y, ... as shares of a size."""
    return F.transform(values, lambda v, i: v / F.when(i % 2 == 0, width).otherwise(height))


def to_absolute(values: Column, width: Column, height: Column) -> Column:
    return F.transform(values, lambda v, i: v * F.when(i % 2 == 0, width).otherwise(height))


def cropped(values: Column, ratio: Column, left: Column, top: Column) -> Column:
    """Places after scaling and a crop; not cut to the crop."""
    return F.transform(values, lambda v, i: v * ratio - F.when(i % 2 == 0, left).otherwise(top))


def normalised(value: Column, mean: float, deviation: float) -> Column:
    return (value / 255.0 - mean) / deviation


def denormalised(value: Column, mean: float, deviation: float) -> Column:
    return F.least(F.greatest((value * deviation + mean) * 255.0, F.lit(0.0)), F.lit(255.0)).cast("int")


def angle_text(angle: Column) -> Column:
    return F.format_string("%.1f", angle)


def flag(text: Column) -> Column:
    """Any number but zero is true; words as a command line takes them."""
    return F.coalesce(F.lower(text).isin("yes", "y", "true", "t"), F.lit(False)) | F.coalesce(text.try_cast("int") != 0, F.lit(False))


def points(text: Column) -> Column:
    """"x,y x,y ..." as a flat array of floats."""
    return F.transform(F.split(F.trim(text), r"[,\s]+"), lambda v: v.cast("float"))


def column_name(n: Column) -> Column:
    """Letters of a spreadsheet's column, counted from 0, up to three letters."""
    letter = lambda v: F.chr((v % 26 + 65).cast("long"))
    two, three = F.floor(n / 26) - 1, F.floor((F.floor(n / 26) - 1) / 26) - 1
    return F.when(n < 26, letter(n)).when(n < 702, F.concat(letter(two), letter(n))).otherwise(F.concat(letter(three), letter(two), letter(n)))


def column_name_legacy(n: Column) -> Column:
    """The letters as earlier files have them, which are wrong beyond Z where n + 1 is a multiple of 26."""
    return F.when(n > 25, F.concat(F.chr((F.floor((n + 1) / 26) + 64).cast("long")), F.chr((n % 26 + 65).cast("long")))).otherwise(F.chr((n + 65).cast("long")))


def a1_range(col_range: Column, row_range: Column) -> Column:
    side = lambda k: F.concat(column_name(col_range[k]), (row_range[k] + 1).cast("string"))
    return F.concat(side(0), F.lit(":"), side(1))


def huber(difference: Column) -> Column:
    size = F.abs(difference)
    return F.when(size <= 1, 0.5 * difference * difference).otherwise(size - 0.5)


def learning_rate(iteration: Column, base: float, gamma: float = 0.8, every: int = 10_000) -> Column:
    """The step schedule: the base times gamma for each `every` iterations that have passed."""
    return F.lit(base) * F.pow(F.lit(gamma), F.floor(iteration / every))


def score_in(text: Column, name: str = "hmean") -> Column:
    """The number that follows "name": in an evaluation's output; null without one."""
    return F.regexp_extract(text, rf'"{name}":\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)', 1).try_cast("double")
