"""Ruling lines from profiles: islands, bands, corner peaks, splitting, alignment, merging, table edges.

`by` names the columns of one table. Tables are independent, so every window and group starts with them.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.operators.groups import met

#: Columns of a line besides its table's.
COLUMNS = ["s", "e", "center", "rs", "re", "region_list", "implicit"]
#: Limits in pixels of the table recovery.
CORNER_MIN, CORNER_GAP = 5, 5
EDGE, FAR = 10, 9999


def islands(profile: DataFrame, by: Sequence[str], least: Column | float = 10) -> DataFrame:
    """(by, s, e, center, peak): maximal runs [s, e) of a sparse profile (by, pos, v) whose peak is above `least`.

    center is the weighted mean of the places counted from 1, rounded half to even.
    """
    run = F.col("pos") - F.row_number().over(Window.partitionBy(*by).orderBy("pos"))
    grouped = profile.where("v > 0").withColumn("run", run).groupBy(*by, "run")
    out = grouped.agg(
        F.min("pos").cast("int").alias("s"), (F.max("pos") + 1).cast("int").alias("e"), F.bround(F.sum(F.col("v") * (F.col("pos") + 1)) / F.sum("v")).cast("int").alias("center"), F.max("v").alias("peak")
    )
    return out.where(F.col("peak") > (least if isinstance(least, Column) else F.lit(least))).drop("run")


def regions(found: DataFrame, pixels: DataFrame, axis: str, by: Sequence[str]) -> DataFrame:
    """Islands with their extent on the other axis: rs, re (the first and last place) and region_list.

    region_list has [a, b] for each run of the band's other profile: b is the place after the run, for the last
    run the last place; a last run of one place is lost.
    """
    other = "y" if axis == "x" else "x"
    p = pixels.select(*by, F.col(axis).alias("_a"), F.col(other).alias("_o"))
    # islands don't overlap, so each place of a band names its island: an equi-join on the place
    places = found.select(*by, "s", F.explode(F.sequence(F.col("s"), F.col("e") - 1)).alias("_a"))
    band = p.join(places, [*by, "_a"]).select(*by, "s", F.col("_o").alias("pos")).distinct()
    keys = [*by, "s"]
    run = F.col("pos") - F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    runs = band.withColumn("run", run).groupBy(*keys, "run").agg(F.min("pos").cast("int").alias("a"), (F.max("pos") + 1).cast("int").alias("z"))
    return _extents(found, runs, keys)


#: Intervals [a, b) in order, those that overlap or touch as one.
_UNION = """
    aggregate(spans, cast(array() as array<struct<a: int, b: int>>), (u, x) -> CASE WHEN size(u) > 0 AND x.a <= get(u, size(u) - 1).b
      THEN concat(slice(u, 1, size(u) - 1), array(named_struct('a', get(u, size(u) - 1).a, 'b', greatest(get(u, size(u) - 1).b, x.b)))) ELSE concat(u, array(x)) END)
"""


def run_lines(runs: DataFrame, by: Sequence[str], least: Column | float = 10) -> DataFrame:
    """(by, s, e, center, rs, re, region_list): the islands of the profile across runs (by, at, a, b), with their regions.

    As `islands` of the runs' profile and `regions` of their pixels; runs of a place don't overlap. A run's island follows
    from its place among the places of its table, so nothing is joined: one shuffle on the table.
    """
    size = (F.col("b") - F.col("a")).cast("long")
    placed = runs.withColumn("v", F.sum(size).over(Window.partitionBy(*by, "at"))).withColumn("island", F.col("at") - F.dense_rank().over(Window.partitionBy(*by).orderBy("at")))
    grouped = placed.groupBy(*by, "island").agg(
        F.min("at").cast("int").alias("s"), (F.max("at") + 1).cast("int").alias("e"), F.bround(F.sum(size * (F.col("at") + 1)) / F.sum(size)).cast("int").alias("center"), F.max("v").alias("peak"),
        F.sort_array(F.collect_list(F.struct(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b")))).alias("spans"),
    )
    found = grouped.where(F.col("peak") > (least if isinstance(least, Column) else F.lit(least))).withColumn("whole", F.expr(_UNION))
    last = F.element_at("whole", -1)["b"] - 1
    inner = F.filter(F.transform("whole", lambda r: F.struct(r["a"].alias("a"), F.least(r["b"], last).alias("b"))), lambda r: r["a"] < r["b"])
    return found.select(*by, "s", "e", "center", F.get("whole", F.lit(0))["a"].alias("rs"), last.alias("re"), inner.alias("region_list"))


def _extents(found: DataFrame, runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    runs = runs.withColumn("re", (F.max("z").over(Window.partitionBy(*keys)) - 1).cast("int")).withColumn("b", F.least("z", "re"))
    extent = runs.groupBy(*keys).agg(
        F.min("a").alias("rs"), F.first("re").alias("re"), F.sort_array(F.collect_list(F.when(F.col("a") < F.col("b"), F.struct("a", "b")))).alias("region_list")
    )
    return met(found, extent, keys)


def corner_peaks(profile: DataFrame, by: Sequence[str], least: int = CORNER_MIN) -> DataFrame:
    """(by, corner): peaks of a corner profile (by, pos, v), by a fold over its places in order.

    Places above `least` rise and then fall; where they rise again, the peak ends and that place is dropped. A
    peak is the weighted mean of its places, counted from 0, rounded half up.
    """
    bins = profile.where(F.col("v") > least).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), F.col("v").cast("long").alias("v")))).alias("bins"))
    fold = """
        aggregate(bins,
          named_struct('state', 0, 'prev', 0L, 'total', 0L, 'mass', 0L, 'last', -2L, 'peaks', cast(array() as array<int>)),
          (a, b) -> CASE
            WHEN a.state = 0 THEN named_struct('state', 1, 'prev', b.v, 'total', b.pos * b.v, 'mass', b.v, 'last', b.pos, 'peaks', a.peaks)
            WHEN b.pos > a.last + 1 THEN named_struct('state', 1, 'prev', b.v, 'total', b.pos * b.v, 'mass', b.v, 'last', b.pos,
                 'peaks', concat(a.peaks, array(cast(floor(a.total / a.mass + 0.5D) as int))))
            WHEN a.state = 2 AND b.v > a.prev THEN named_struct('state', 0, 'prev', 0L, 'total', 0L, 'mass', 0L, 'last', b.pos,
                 'peaks', concat(a.peaks, array(cast(floor(a.total / a.mass + 0.5D) as int))))
            ELSE named_struct('state', CASE WHEN a.state = 1 AND b.v < a.prev THEN 2 ELSE a.state END, 'prev', b.v,
                 'total', a.total + b.pos * b.v, 'mass', a.mass + b.v, 'last', b.pos, 'peaks', a.peaks) END,
          a -> CASE WHEN a.state > 0 THEN concat(a.peaks, array(cast(floor(a.total / a.mass + 0.5D) as int))) ELSE a.peaks END)
    """
    return bins.select(*by, F.explode(F.expr(fold)).alias("corner"))


def split_at_corners(lines: DataFrame, corners: DataFrame, by: Sequence[str], gap: int = CORNER_GAP) -> DataFrame:
    """Lines (with s, e, center) that hold more than one corner strictly inside become one line for each corner.

    A corner counts if it is `gap` or more after the corner before it, kept or not. Others stay as they are.
    """
    key = [*by, "s", "e"]
    inner = met(lines.select(*key), corners, by).where("s < corner AND corner < e")
    order = Window.partitionBy(*key).orderBy("corner")
    ranked = inner.withColumn("before", F.lag("corner").over(order)).withColumn("n", F.count("*").over(Window.partitionBy(*key))).where("n > 1")
    kept = ranked.where(F.col("before").isNull() | (F.col("corner") - F.col("before") >= gap)).select(*key, "corner")
    out = met(lines, kept, key, "left")
    one = F.col("corner").isNotNull()
    changed = {"s": F.when(one, F.col("corner") - 1).otherwise(F.col("s")), "e": F.when(one, F.col("corner") + 1).otherwise(F.col("e")), "center": F.coalesce("corner", "center")}
    return out.select(*[changed[c].cast("int").alias(c) if c in changed else c for c in lines.columns])


def aligned(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """Implicit lines of one direction all get the table's common extent."""
    whole = Window.partitionBy(*by)
    out = lines.withColumn("_rs", F.min("rs").over(whole)).withColumn("_re", F.max("re").over(whole))
    new = {"rs": F.col("_rs"), "re": F.col("_re"), "region_list": F.array(F.struct(F.col("_rs").alias("a"), F.col("_re").alias("b")))}
    return out.select(*[new[c].alias(c) if c in new else c for c in lines.columns])


#: One step of the walk over lists a (explicit) and b (implicit); both flags: the lines at the front overlap.
_WALK = """
    transform(filter(aggregate(
      sequence(0, size(a) + size(b)),
      named_struct('i', 0, 'j', 0, 'out', array(named_struct('from_a', -1, 'from_b', -1))),
      (w, step) -> CASE WHEN w.i >= size(a) AND w.j >= size(b) THEN w ELSE aggregate(
        array(named_struct('left', get(a, w.i), 'right', get(b, w.j))), w,
        (v, front) -> aggregate(
          array(named_struct(
            'ahead', front.left IS NOT NULL AND (front.right IS NULL OR front.left.center < front.right.center),
            'both', front.left IS NOT NULL AND front.right IS NOT NULL
                    AND CASE WHEN front.left.center < front.right.center THEN front.left.e > front.right.s ELSE front.left.s < front.right.e END)), v,
          (u, on) -> named_struct(
            'i', u.i + CAST(on.both OR on.ahead AS int), 'j', u.j + CAST(on.both OR NOT on.ahead AS int),
            'out', concat(u.out, array(named_struct('from_a', IF(on.both OR on.ahead, u.i, -1), 'from_b', IF(on.both OR NOT on.ahead, u.j, -1))))))) END,
      w -> w.out), o -> o.from_a >= 0 OR o.from_b >= 0),
      o -> named_struct('left', get(a, o.from_a), 'right', get(b, o.from_b)))
"""


def merged(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """Explicit and implicit lines (column implicit) of a table and direction in one order: (by, line columns, nth).

    Two lists, each in order of place, are walked together, by a fold: if the lines at the front overlap on their
    axis the implicit one stays, with the regions of both, and both move on; else the one with the smaller centre goes out.
    """
    line = F.struct(*COLUMNS[:6])
    of = lambda wanted: F.sort_array(F.collect_list(F.when(F.col("implicit") == wanted, line)))
    lists = lines.groupBy(*by).agg(of(False).alias("a"), of(True).alias("b"))
    out = lists.select(*by, F.posexplode(F.expr(_WALK)).alias("nth", "o"))
    a, b = F.col("o.left"), F.col("o.right")
    one = F.coalesce(b, a)
    # least and greatest pass over nulls
    columns = [one["s"].alias("s"), one["e"].alias("e"), one["center"].alias("center"), F.least(a["rs"], b["rs"]).alias("rs"), F.greatest(a["re"], b["re"]).alias("re")]
    both = F.concat(F.coalesce(b["region_list"], F.array()), F.coalesce(a["region_list"], F.array()))
    return out.select(*by, *columns, both.alias("region_list"), b.isNotNull().alias("implicit"), "nth")


def with_edges(lines: DataFrame, ends: DataFrame, by: Sequence[str]) -> DataFrame:
    """Lines (by, nth, ...) with a line at either end of the table (by, start, end) where the outermost is too far inside.

    Too far is more than EDGE pixels, twice that if the outermost line is implicit.
    """
    whole = Window.partitionBy(*by)
    held = met(lines.withColumn("lo", F.min("nth").over(whole)).withColumn("hi", F.max("nth").over(whole)), ends, by, "left")
    room = F.when(F.col("implicit"), 2 * EDGE).otherwise(EDGE)
    names = [c for c in lines.columns if c not in by]

    def edge(place: Column, nth: Column) -> Column:
        region = F.array(F.struct(F.lit(0).alias("a"), F.lit(FAR).alias("b")))
        new = {"s": place, "e": place, "center": place, "rs": F.lit(0), "re": F.lit(FAR), "region_list": region, "implicit": F.lit(True), "nth": nth}
        return F.struct(*[new[c].cast(lines.schema[c].dataType).alias(c) for c in names])

    # a line at the end of its table makes two rows: itself and the edge
    first = F.when((F.col("nth") == F.col("lo")) & (F.col("s") > F.col("start") + room), edge(F.col("start").cast("int"), F.col("lo") - 1))
    last = F.when((F.col("nth") == F.col("hi")) & (F.col("e") < F.col("end") - room), edge(F.col("end").cast("int"), F.col("hi") + 1))
    rows = F.filter(F.array(F.struct(*names), first, last), lambda line: line.isNotNull())
    return held.select(*by, F.explode(rows).alias("line")).select(*by, "line.*").select(*lines.columns)
