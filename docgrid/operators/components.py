"""Connected components (8 neighbours) of the pixels of each document, and their statistics."""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgrid.functions.lineage import pinned
from docgrid.operators.groups import map_groups, met
from docgrid.operators.stars import connected_components
from docgrid.schemas import IMPLICIT_VERTICAL, VERTICAL


#: Side of the tiles that boxes and pixels meet in, and of those that large maps are labelled by.
SIDE, TILE = 32, 1024


def _labels(group: pa.Table) -> dict:
    """Component numbers of one map's pixels, sorted by row and place."""
    y, x, comp = _components(group.column("y").to_numpy(), group.column("x").to_numpy())
    return {"y": y.tolist(), "x": x.tolist(), "comp": comp.tolist()}


def _components(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places without repeats, and their components' numbers."""
    new = np.concatenate(([True], (np.diff(y) != 0) | (np.diff(x) != 0)))
    y, x = y[new], x[new]
    run = np.cumsum(np.concatenate(([0], (np.diff(y) != 0) | (np.diff(x) != 1))))
    first = np.concatenate(([0], np.flatnonzero(np.diff(run)) + 1))
    last = np.concatenate((first[1:] - 1, [len(y) - 1]))
    row, left, right = y[first].tolist(), x[first].tolist(), x[last].tolist()
    root = list(range(len(first)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    above = 0
    for i in range(len(first)):
        while above < i and (row[above] < row[i] - 1 or (row[above] == row[i] - 1 and right[above] < left[i] - 1)):
            above += 1
        j = above
        while j < i and row[j] == row[i] - 1 and left[j] <= right[i] + 1:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
            j += 1
    _, comp = np.unique([find(i) for i in range(len(first))], return_inverse=True)
    return y, x, (comp + 1)[run]


def _boxes(group: pa.Table) -> dict:
    """Statistics of one map's components, from its runs; their pixels live within the task alone."""
    at, a, b, down = (group.column(c).to_numpy(zero_copy_only=False) for c in ("at", "a", "b", "down"))
    n = b - a
    along = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
    across, turned = np.repeat(at, n), np.repeat(down, n)
    y, x = np.where(turned, along, across).astype(np.int64), np.where(turned, across, along).astype(np.int64)
    order = np.lexsort((x, y))
    y, x, comp = _components(y[order], x[order])
    order = np.argsort(comp, kind="stable")
    y, x, comp = y[order], x[order], comp[order]
    first = np.flatnonzero(np.concatenate(([True], np.diff(comp) != 0)))
    l, t, r, u = (f.reduceat(v, first) for f, v in ((np.minimum, x), (np.minimum, y), (np.maximum, x), (np.maximum, y)))
    area = np.diff(np.concatenate((first, [len(comp)])))
    return {c: v.tolist() for c, v in {"comp": comp[first], "l": l, "t": t, "w": r - l + 1, "h": u - t + 1, "area": area}.items()}


def run_components(runs: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(by, comp, l, t, w, h, area) of the components of a map's runs (by, channel, at, a, b), numbered as by `label_pixels`.

    Runs are shuffled, not pixels; a map is one group, as there.
    """
    down = F.col("channel").isin(VERTICAL, IMPLICIT_VERTICAL).alias("down")
    return map_groups(runs.select(*by, down, "at", "a", "b"), by, [], _boxes, "comp int, l int, t int, w int, h int, area long")


def runs_in_boxes(runs: DataFrame, boxes: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Runs cut to the boxes (comp) that they lie in, once for each of overlapping boxes; boxes meet the rows or columns that they cover in bands of SIDE."""
    down = F.col("channel").isin(VERTICAL, IMPLICIT_VERTICAL)
    ways = F.explode(F.array(*[F.struct(F.lit(d).alias("_down"), F.col(p).alias("low"), F.col(n).alias("size"), F.col(q).alias("_a"), (F.col(q) + F.col(m)).alias("_b")) for d, p, n, q, m in ((False, "t", "h", "l", "w"), (True, "l", "w", "t", "h"))]))
    b = boxes.select(*by, "comp", "w", "h", ways.alias("k")).select(*by, "comp", "w", "h", "k.*")
    b = b.withColumn("_band", F.explode(F.sequence(F.floor(F.col("low") / SIDE), F.floor((F.col("low") + F.greatest("size", F.lit(1)) - 1) / SIDE))))
    dealt = runs.withColumn("_down", down).withColumn("_band", F.floor(F.col("at") / SIDE))
    cut = met(dealt, b, [*by, "_down", "_band"]).where((F.col("at") >= F.col("low")) & (F.col("at") < F.col("low") + F.col("size")))
    new = {"a": F.greatest("a", "_a"), "b": F.least("b", "_b")}
    return cut.select(*[new[c].cast("int").alias(c) if c in new else c for c in runs.columns], "comp", "w", "h").where("a < b")


def _first_pixels(group: pa.Table) -> dict:
    """Each pixel with the first one of its component, in the order of rows."""
    found = _labels(group)
    _, first, back = np.unique(found.pop("comp"), return_index=True, return_inverse=True)
    return found | {f"f{c}": np.array(found[c])[first][back].tolist() for c in "yx"}


def label_pixels(pixels: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(by, y, x, comp): comp numbers the components of a map in raster order of their first pixel, from 1.

    A map's pixels are one group (a page fits in a task); within it, runs of a row are joined to overlapping runs
    of the row above.
    """
    return map_groups(pixels.select(*by, "y", "x"), by, ["y", "x"], _labels, "y int, x int, comp int")


def label_tiled(pixels: DataFrame, by: Sequence[str] = ("doc_id",), side: int = TILE) -> DataFrame:
    """(by, y, x, comp): the same numbers for maps of any size; a task holds a tile of `side` x `side` pixels, not a map.

    Each tile is labelled by itself; a tile's component is named by its first pixel. Only pixels at a tile's border
    can touch those of another tile, so the equivalences of components are few rows (a border is a small share of a
    tile); their classes are found by stars in a logarithmic number of rounds. The least first pixel of a class is the
    first of the whole component.
    """
    keys = list(by)
    tile = [F.floor(F.col(c) / side).cast("int").alias(f"_t{c}") for c in "yx"]
    cut = [*keys, "_ty", "_tx"]
    parts = map_groups(pixels.select(*keys, *tile, "y", "x"), cut, ["y", "x"], _first_pixels, "y int, x int, fy int, fx int")
    named = pinned(parts.select(*keys, "y", "x", F.struct(*keys, F.struct("fy", "fx").alias("first")).alias("node")))
    edge = lambda c: F.pmod(F.col(c), F.lit(side)).isin(0, side - 1)
    border = named.where(edge("y") | edge("x"))
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    sent = border.select(*keys, (F.col("y")).alias("_y"), F.col("x").alias("_x"), F.col("node").alias("a"), steps.alias("k"))
    sent = sent.select(*keys, (F.col("_y") + F.col("k.dy")).alias("y"), (F.col("_x") + F.col("k.dx")).alias("x"), "a")
    touching = sent.join(border.select(*keys, "y", "x", F.col("node").alias("b")), [*keys, "y", "x"]).where("a <> b").select("a", "b").distinct()
    roots = connected_components(touching)
    nodes = named.select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    # a map's components, not its pixels, are ordered
    order = Window.partitionBy(*[F.col(f"root.{k}") for k in keys]).orderBy("root.first")
    numbered = pinned(nodes.withColumn("comp", F.dense_rank().over(order)).select("node", "comp"))
    return named.join(numbered, "node").select(*keys, "y", "x", "comp")


def component_stats(labelled: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(by, comp, l, t, w, h, area) of each component."""
    x, y = F.col("x"), F.col("y")
    return labelled.groupBy(*by, "comp").agg(F.min(x).alias("l"), F.min(y).alias("t"), (F.max(x) - F.min(x) + 1).alias("w"), (F.max(y) - F.min(y) + 1).alias("h"), F.count("*").alias("area"))


def table_candidates(stats: DataFrame, by: Sequence[str] = ("doc_id",), least: int = 20) -> DataFrame:
    """Components by falling area (ties by number), up to but without the first whose smaller side is under `least`."""
    order = Window.partitionBy(*by).orderBy(F.desc("area"), "comp")
    small = F.max((F.least("w", "h") < least).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return stats.withColumn("stopped", small).withColumn("rank", F.row_number().over(order)).where("stopped = 0").drop("stopped")


def pixels_in_boxes(pixels: DataFrame, boxes: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Pixels with the box (comp) that they lie in, once for each of overlapping boxes.

    A range join within a document, by an equi-join on tiles of SIDE pixels that boxes are dealt out to. Which side is
    broadcast or whether both are shuffled is left to Spark's sizes.
    """
    tiles = lambda low, size: F.explode(F.sequence(F.floor(F.col(low) / SIDE), F.floor((F.col(low) + F.greatest(F.col(size), F.lit(1)) - 1) / SIDE)))
    b = boxes.select(*by, "comp", "l", "t", "w", "h").withColumn("_tx", tiles("l", "w")).withColumn("_ty", tiles("t", "h"))
    held = (F.col("x") >= F.col("l")) & (F.col("x") < F.col("l") + F.col("w")) & (F.col("y") >= F.col("t")) & (F.col("y") < F.col("t") + F.col("h"))
    dealt = pixels.select("*", F.floor(F.col("x") / SIDE).alias("_tx"), F.floor(F.col("y") / SIDE).alias("_ty"))
    return dealt.join(b, [*by, "_tx", "_ty"]).where(held).select(*pixels.columns, "comp", "w", "h")
