"""From score maps to tables and cells: the whole recovery as one plan over all documents."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgrid.functions.coords import adjusted, angle_text
from docgrid.functions.lineage import pinned
from docgrid.operators import cells as C
from docgrid.operators import components, lines, raster, rotation
from docgrid.operators.groups import met
from docgrid.schemas import CORNER, HORIZONTAL, IMPLICIT_HORIZONTAL, IMPLICIT_VERTICAL, SIDES, VERTICAL

BY = ["doc_id", "comp"]


@dataclass(frozen=True)
class Limits:
    """Fixed values of the recovery, in pixels of the score map; tests and small maps pass others."""

    explicit: float = 0.3
    low: float = 0.2
    least_side: int = 20
    least_line: int = 10
    least_implicit: int = 30
    implicit_share: float = 0.25
    corner: int = 5
    votes: int = 400
    turn: bool = True


#: Columns that name the lines of one direction of a table; x and y stand for the places across and along them.
WAY = [*BY, "down"]


def _lines(boxed: DataFrame, rects: DataFrame, corners: DataFrame, limits: Limits) -> DataFrame:
    """(by, down, nth, line): the lines of all tables, of both directions (down: vertical ones), explicit and implicit, merged in order.

    boxed: the tables' runs. Both directions and both kinds are one relation, so each step is one pass, not four.
    """
    wide = raster.channel(boxed, IMPLICIT_VERTICAL).withColumn("at", F.explode(F.sequence(F.col("at") - 2, F.col("at") + 2))).where("at >= 0")
    wide = raster.joined(wide, [*BY, "w", "h", "channel", "at"])
    drawn = raster.channel(boxed, HORIZONTAL, VERTICAL, IMPLICIT_HORIZONTAL).select(wide.columns).unionByName(wide)
    down = F.col("channel").isin(VERTICAL, IMPLICIT_VERTICAL)
    laid = drawn.select(*BY, down.alias("down"), F.col("channel").isin(IMPLICIT_HORIZONTAL, IMPLICIT_VERTICAL).alias("implicit"), F.when(down, F.col("h")).otherwise(F.col("w")).alias("side"), "at", "a", "b")
    kind = [*WAY, "implicit"]
    need = F.when(F.col("implicit"), F.greatest(F.col("side") * limits.implicit_share, F.lit(limits.least_implicit))).otherwise(F.lit(limits.least_line))
    found = lines.run_lines(laid, [*kind, "side"], need).drop("side")
    weak = found.where("implicit")
    weak = lines.split_at_corners(weak, corners.withColumn("down", F.lit(False)), WAY)
    weak = lines.aligned(weak, WAY)
    both = lines.merged(found.where("NOT implicit").unionByName(weak.select(found.columns)), WAY)
    ends = rects.select(*BY, F.explode(F.array(*[F.struct(F.lit(d).alias("down"), F.col(i).alias("start"), F.col(j).alias("end")) for d, i, j in ((True, "l", "r"), (False, "t", "b"))])).alias("e")).select(*BY, "e.*")
    return lines.with_edges(C.viable(both, WAY), ends.where("start IS NOT NULL AND end IS NOT NULL"), WAY)


def recover_tables(pixels: DataFrame, transforms: DataFrame | None = None, limits: Limits | None = None, sides: bool = False) -> DataFrame:
    """(doc_id, id, angle, angle_degrees, rect, quad, cells): a row per table found in score maps (doc_id, channel, y, x, score).

    transforms: (doc_id, ratio_w, ratio_h, pad_x, pad_y, x1, y1, x2, y2), a row per document, to mask the region of
    interest and to give source coordinates; without it those of the map come out. With heat_w and heat_h (the map's
    size) a table is turned about the map's centre; without, as a sparse map has no size, about that of the region of
    the document's tables. With sides each cell tells which of its sides have an explicit line. Documents are independent: all shuffles are on doc_id, then on the table. Relations that
    several branches read are written to the application's folder while the plan is built.
    """
    limits = limits or Limits()
    runs = raster.runs(raster.above_threshold(pixels, limits.explicit, limits.low))
    runs = pinned(runs if transforms is None else raster.runs_inside(runs, transforms.select("doc_id", "x1", "y1", "x2", "y2")))
    stats = components.run_components(raster.channel(runs, *raster.EDGES))
    candidates = pinned(components.table_candidates(stats, least=limits.least_side))
    boxed = pinned(components.runs_in_boxes(runs, candidates))
    if transforms is not None and {"heat_w", "heat_h"} <= set(transforms.columns):
        sizes = transforms.select("doc_id", F.col("heat_w").alias("across"), F.col("heat_h").alias("down"))
        extents = met(candidates.select(*BY, "rank"), sizes, ["doc_id"])
    else:
        extent = F.max(F.greatest(F.col("l") + F.col("w"), F.col("t") + F.col("h"))).over(Window.partitionBy("doc_id"))
        extents = candidates.select(*BY, "rank", extent.alias("across"), extent.alias("down"))
    angle = F.lit(0.0)
    if limits.turn:
        pixels = raster.pixels_of(boxed, [*BY, "w", "h"])
        angles = rotation.table_angles(pixels, candidates, BY, votes=limits.votes)
        extents, angle = pinned(met(extents, angles, BY)), F.col("angle")
        spun = met(pixels, extents.drop("rank"), BY)
        turned = rotation.rotate(spun, [*BY, "w", "h", "across", "down"], F.col("across"), F.col("down"))
        boxed = pinned(raster.runs(turned, [*BY, "w", "h"]))
    corners = lines.corner_peaks(raster.run_profile(raster.channel(boxed, CORNER), BY), BY, limits.corner)
    ruled = _lines(boxed, raster.run_rect(boxed, BY), corners, limits)
    out = met(_tables(ruled, sides), extents, BY).withColumn("id", F.row_number().over(Window.partitionBy("doc_id").orderBy("rank"))).withColumn("angle", angle)
    back = lambda quad: _unturned(quad, F.col("angle"), F.col("across") / 2, F.col("down") / 2)
    out = out.withColumn("quad", back(F.col("quad"))).withColumn("cells", F.transform("cells", lambda c: c.withField("quad", back(c["quad"]))))
    if transforms is not None:
        ratio = transforms.select("doc_id", (1 / F.col("ratio_w")).alias("rw"), (1 / F.col("ratio_h")).alias("rh"), "pad_x", "pad_y")
        move = lambda v, n=-1: adjusted(v, F.col("rw"), F.col("rh"), F.col("pad_x"), F.col("pad_y"), n)
        out = met(out, ratio, ["doc_id"]).withColumn("rect", move(F.col("rect"), 2)).withColumn("quad", move(F.col("quad")))
        out = out.withColumn("cells", F.transform("cells", lambda c: c.withField("quad", move(c["quad"]))))
    return out.select("doc_id", "id", angle_text(F.col("angle")).alias("angle"), F.col("angle").alias("angle_degrees"), "rect", "quad", "cells")


def _tables(ruled: DataFrame, sides: bool) -> DataFrame:
    """(by, rect, quad, cells): the record of each table from its lines, as arrays of one row; tables of a single cell are none."""
    of = lambda down: F.sort_array(F.collect_list(F.when(F.col("down") == down, F.struct("nth", "center", "region_list", "implicit"))))
    ruling = ruled.groupBy(*BY).agg(of(True).alias("v"), of(False).alias("h"))
    grids = ruling.where("size(v) > 1 AND size(h) > 1 AND size(v) + size(h) > 4")
    flags = [F.transform(lines, lambda line: ~line["implicit"]).alias(name) for lines, name in (("v", "_across"), ("h", "_down"))] if sides else []
    names, held = ["_across", "_down"][: len(flags)], grids.select(*BY, C.grid_of(F.col("v"), F.col("h")).alias("cells"), *flags)
    merged = C.merged_of(held, *BY, *names)
    if not sides:
        return C.tables_of(merged, "doc_id", keys=["comp"])
    at = {"top": ("_down", "sj", 0), "bottom": ("_down", "ej", 1), "left": ("_across", "si", 0), "right": ("_across", "ei", 1)}
    flagged = F.transform("merged", lambda c: F.struct(*[c[m].alias(m) for m in C.MERGED], *[F.get(F.col(name), c[m] + more).alias(side) for side, (name, m, more) in at.items()]))
    return C.tables_of(merged.withColumn("merged", flagged), "doc_id", keys=["comp"], flags=SIDES)


def _unturned(quad, angle, cx, cy):
    """A quad's corners turned back, cut to integers; as they are where the table wasn't turned."""
    pairs = [rotation.turned(quad[2 * k], quad[2 * k + 1], -angle, cx, cy) for k in range(4)]
    return F.when(F.abs(angle) > rotation.LEAST_ANGLE, F.array(*[v.cast("int") for p in pairs for v in p])).otherwise(quad)
