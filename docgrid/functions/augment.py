"""Augmentation of images and boxes as column expressions; the draws are columns, too, so a run can be repeated.

A draw is a number in [0, 1) (see `draw`). Colours are blue, green, red from 0 to 255 as doubles.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.functions.coords import cropped, projected, to_absolute, to_percent

#: The ranges of the draws.
CONTRAST, BRIGHTNESS, HUE, SHIFT, RATIOS, CHANCE = (0.5, 1.5), 16.0, 36.0, 0.1, (0.5, 2.0), 0.5
STEP, STEPS, LEAST_SIZE = 32, 20, 640


def draw(key: Column, name: str = "") -> Column:
    """A number in [0, 1) of a key and, if given, a name, from an MD5: the same wherever the row lies."""
    text = F.concat_ws(":", key.cast("string"), F.lit(name)) if name else key.cast("string")
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def uniform(d: Column, low: float, high: float) -> Column:
    return low + d * (high - low)


def whole(d: Column, low: Column, high: Column) -> Column:
    """A whole number from low to high, both included."""
    return (low + F.floor(d * (high - low + 1))).cast("int")


def _cut(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0))


def contrast(v: Column, factor: Column) -> Column:
    return _cut(v * factor)


def brightness(v: Column, delta: Column) -> Column:
    return _cut(v + delta)


def to_hsv(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation from 0 to 1, value as the colours are."""
    high, low = F.greatest(b, g, r), F.least(b, g, r)
    span = high - low
    turn = F.when(span == 0, 0.0).when(high == r, 60 * (g - b) / span).when(high == g, 120 + 60 * (b - r) / span).otherwise(240 + 60 * (r - g) / span)
    return F.when(turn < 0, turn + 360).otherwise(turn), F.when(high == 0, 0.0).otherwise(span / high), high


def from_hsv(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """Blue, green, red."""

    def part(n: int) -> Column:
        k = (n + h / 60) % 6
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return part(1), part(3), part(5)


def hue(h: Column, delta: Column) -> Column:
    """Turned, and brought back once where it passes 0 or 360."""
    t = h + delta
    return F.when(t > 360, t - 360).when(t < 0, t + 360).otherwise(t)


def distorted(pixels: DataFrame, colours: tuple[str, str, str], key: str) -> DataFrame:
    """Pixels whose blue, green and red columns have brightness, then contrast before or after a turn of the hue, changed
    as the key's draws say; each of the three happens for half of the keys. Each step is a projection of its own, so
    that no expression is computed twice.
    """
    k = F.col(key)
    names = ("brightness?", "brightness", "contrast?", "contrast", "hue?", "hue", "order")
    out = pixels.withColumns({f"_{n}": draw(k, n) for n in names})
    happens = lambda name: F.col(f"_{name}?") < CHANCE
    first = F.col("_order") < CHANCE
    delta, factor, angle = uniform(F.col("_brightness"), -BRIGHTNESS, BRIGHTNESS), uniform(F.col("_contrast"), *CONTRAST), uniform(F.col("_hue"), -HUE, HUE)
    out = out.withColumns({c: F.when(happens("brightness"), brightness(F.col(c), delta)).otherwise(F.col(c)) for c in colours})
    out = out.withColumns({c: F.when(first & happens("contrast"), contrast(F.col(c), factor)).otherwise(F.col(c)) for c in colours})
    out = out.withColumns(dict(zip(("_h", "_s", "_v"), to_hsv(*map(F.col, colours)), strict=True)))
    out = out.withColumn("_h", F.when(happens("hue"), hue(F.col("_h"), angle)).otherwise(F.col("_h")))
    out = out.withColumns(dict(zip(colours, from_hsv(F.col("_h"), F.col("_s"), F.col("_v")), strict=True)))
    out = out.withColumns({c: F.when(~first & happens("contrast"), contrast(F.col(c), factor)).otherwise(F.col(c)) for c in colours})
    return out.withColumns({c: _cut(F.col(c)) for c in colours}).select(pixels.columns)


def corners_map(width: Column, height: Column, to: list[Column]) -> list[Column]:
    """The nine numbers of the projective map that takes the corners of an image (its last places are width - 1 and
    height - 1) to four places x, y, ... from the top left clockwise."""
    x0, y0, x1, y1, x2, y2, x3, y3 = [c.cast("double") for c in to]
    dx1, dx2, sx = x1 - x2, x3 - x2, x0 - x1 + x2 - x3
    dy1, dy2, sy = y1 - y2, y3 - y2, y0 - y1 + y2 - y3
    bottom = dx1 * dy2 - dx2 * dy1
    g, h = (sx * dy2 - dx2 * sy) / bottom, (dx1 * sy - sx * dy1) / bottom
    w1, h1 = (width - 1).cast("double"), (height - 1).cast("double")
    return [(x1 - x0 + g * x1) / w1, (x3 - x0 + h * x3) / h1, x0, (y1 - y0 + g * y1) / w1, (y3 - y0 + h * y3) / h1, y0, g / w1, h / h1, F.lit(1.0)]


def drawn_corners(width: Column, height: Column, key: Column) -> list[Column]:
    """Where a random perspective takes the corners: each moves by up to SHIFT of half a side."""
    dw, dh = ((F.floor(s / 2)) * SHIFT for s in (width, height))
    dw, dh = F.floor(dw), F.floor(dh)
    near = lambda name, d: whole(draw(key, name), -d, d)
    far = lambda name, d, side: whole(draw(key, name), side - d, side + d - 1)
    return [near("x0", dw), near("y0", dh), far("x1", dw, width), near("y1", dh), far("x2", dw, width), far("y2", dh, height), near("x3", dw), far("y3", dh, height)]


def warped(values: Column, h: list[Column]) -> Column:
    """Places x, y, ... of a quad through a projective map."""
    pairs = [projected(h, values[2 * k], values[2 * k + 1]) for k in range(4)]
    return F.array(*[v for p in pairs for v in p])


def crop_geometry(width: Column, height: Column, size: Column, largest: int, key: Column) -> tuple[Column, Column, Column]:
    """(ratio, left, top) of a resize to `size` at the longer side, the ratio kept within RATIOS, and a crop to `largest`."""
    longer = F.greatest(width, height)
    wanted = F.least(F.greatest(size / longer, F.lit(RATIOS[0])), F.lit(RATIOS[1]))
    ow, oh = F.bround(width * wanted).cast("int"), F.bround(height * wanted).cast("int")
    place = lambda name, o: F.when(o >= largest, whole(draw(key, name), F.lit(0), o - largest)).otherwise(0)
    return F.greatest(ow, oh) / longer, place("left", ow), place("top", oh)


def augmented_boxes(boxes: DataFrame, key: str, size: int = 512) -> DataFrame:
    """Boxes (key, width, height, quad in shares of the image) after the chain: perspective for half of the images, resize and crop.

    The result is in shares of the crop, which is as wide and high as the largest size drawn; boxes are not cut to it.
    """
    k = F.col(key)
    sizes = list(range(max(size - STEP * STEPS, LEAST_SIZE), size + 1, STEP)) or [size]
    # a projection for each step, so that no expression is computed twice
    out = boxes.withColumn("_absolute", to_absolute(F.col("quad"), F.col("width"), F.col("height")))
    out = out.withColumns({f"_to{n}": c for n, c in enumerate(drawn_corners(F.col("width"), F.col("height"), k))})
    h = corners_map(F.col("width"), F.col("height"), [F.col(f"_to{n}") for n in range(8)])
    out = out.withColumns({f"_h{n}": c for n, c in enumerate(h)})
    moved = warped(F.col("_absolute"), [F.col(f"_h{n}") for n in range(9)])
    out = out.withColumn("_moved", F.when(draw(k, "perspective?") < CHANCE, moved).otherwise(F.col("_absolute")))
    chosen = F.element_at(F.array(*map(F.lit, sizes)), whole(draw(k, "size"), F.lit(1), F.lit(len(sizes))))
    out = out.withColumn("_size", chosen)
    ratio, left, top = crop_geometry(F.col("width"), F.col("height"), F.col("_size"), max(sizes), k)
    side = F.lit(float(max(sizes)))
    out = out.withColumns({"_ratio": ratio, "_left": left, "_top": top})
    return out.withColumn("quad", to_percent(cropped(F.col("_moved"), F.col("_ratio"), F.col("_left"), F.col("_top")), side, side)).select(boxes.columns)
