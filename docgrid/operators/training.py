"""Training data: score maps from annotations, hard-negative selection and loss, dataset mixtures, box transforms."""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.functions.coords import huber
from docgrid.functions.lineage import pinned
from docgrid.operators.raster import joined, pixels_of
from docgrid.schemas import CORNER, HORIZONTAL, IMPLICIT_HORIZONTAL, IMPLICIT_VERTICAL, VERTICAL

#: Reach of a corner's heat in pixels, its width, the least heat that counts, negatives for each positive, negatives without any.
REACH, SPREAD, LEAST_HEAT, NEGATIVES, NONE_POSITIVE = 5, 2.0, 0.05, 3, 10_000
#: Side of the tiles that corners are dealt out to.
HEAT_TILE = 64
#: Buckets of losses that tell where the k-th lies, for each power of e.
FINENESS = 4096
#: A mixture has at most so many datasets: the bound of what is broadcast.
MOST_DATASETS = 100_000


def corner_heat(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, channel, y, x, score): a Gaussian at each corner of each quad (absolute places), the largest where they overlap."""
    corners = cells.select(*by, F.explode(F.array(*[F.struct(F.col("quad")[2 * k].cast("double").alias("cx"), F.col("quad")[2 * k + 1].cast("double").alias("cy")) for k in range(4)])).alias("c")).select(*by, "c.cx", "c.cy").where("cx IS NOT NULL AND cy IS NOT NULL")
    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - REACH) / HEAT_TILE), F.floor((F.col(c) + REACH) / HEAT_TILE)))
    # a tile's few corners are one row, in which each place is heated by the nearest alone: corners are shuffled, not places
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiled = corners.repartition(parts, *by).withColumn("_tx", tiles("cx")).withColumn("_ty", tiles("cy")).groupBy(*by, "_ty", "_tx").agg(F.collect_set(F.struct("cx", "cy")).alias("all"))
    near = lambda c, o: (F.abs(c["cx"] - o["cx"]) <= 2 * REACH) & (F.abs(c["cy"] - o["cy"]) <= 2 * REACH) & (c != o)
    each = tiled.select(*by, "_ty", "_tx", "all", F.explode("all").alias("c")).select(*by, "_ty", "_tx", "c", F.filter("all", lambda o: near(F.col("c"), o)).alias("others"))
    # places along y are those of the disc that is warm enough, a little wider; a score is made once for each, so it is a row's value, not an expression that filters repeat
    reach = F.lit(float(REACH))
    half = F.least(reach, F.sqrt(F.greatest(F.lit(1e-3 - 2 * SPREAD * SPREAD * math.log(LEAST_HEAT)) - (F.col("x") - F.col("c.cx")) * (F.col("x") - F.col("c.cx")), F.lit(0.0))))
    low = lambda c, tile, r: F.greatest(F.ceil(F.col(c) - r), F.col(tile) * HEAT_TILE, F.lit(0)).cast("int")
    high = lambda c, tile, r: F.least(F.floor(F.col(c) + r), (F.col(tile) + 1) * HEAT_TILE - 1).cast("int")
    places = lambda *of: F.explode(F.when(low(*of) <= high(*of), F.sequence(low(*of), high(*of))))
    spread = each.withColumn("x", places("c.cx", "_tx", reach)).withColumn("y", places("c.cy", "_ty", half))
    squared = lambda c: (F.col("x") - c["cx"]) * (F.col("x") - c["cx"]) + (F.col("y") - c["cy"]) * (F.col("y") - c["cy"])
    heat = F.exp(-squared(F.col("c")) / (2 * SPREAD * SPREAD)).cast("float")
    warm = spread.withColumn("score", F.explode(F.array(heat))).where(F.col("score") >= F.lit(LEAST_HEAT).cast("float"))
    first = lambda o: (squared(o) < squared(F.col("c"))) | ((squared(o) == squared(F.col("c"))) & (o < F.col("c")))
    return warm.where(~F.exists("others", first)).select(*by, F.lit(CORNER).alias("channel"), "y", "x", "score")


def edge_lines(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, channel, y, x, score): the quads' edges, three pixels thick, in the explicit or implicit channel as the flags say.

    An edge is spans along the lines of its channel, an upright one three whole spans; the spans of a line are united
    before they become pixels, so a pixel that several edges share comes out once without being sought.
    """
    q = lambda k: (F.col("quad")[2 * k].cast("int"), F.col("quad")[2 * k + 1].cast("int"))
    sides = [("top", 0, 1, HORIZONTAL, IMPLICIT_HORIZONTAL, False), ("bottom", 2, 3, HORIZONTAL, IMPLICIT_HORIZONTAL, False), ("right", 1, 2, VERTICAL, IMPLICIT_VERTICAL, True), ("left", 3, 0, VERTICAL, IMPLICIT_VERTICAL, True)]
    # p is the place along the channel's lines, q the one across them
    edge = F.array(*[
        F.struct(F.when(F.col(side), seen).otherwise(unseen).alias("channel"), *[q(c)[down ^ o].alias(f"{n}{k}") for k, c in ((1, a), (2, b)) for o, n in enumerate("pq")], F.lit(down).alias("down"))
        for side, a, b, seen, unseen, down in sides
    ])
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = cells.repartition(parts, *by).select(*by, F.explode(edge).alias("e")).select(*by, "e.*").dropna(subset=["p1", "q1", "p2", "q2"])
    dp, dq = F.abs(F.col("p2") - F.col("p1")), F.abs(F.col("q2") - F.col("q1"))
    # thick across its longer way, which for equal ones is x
    along = F.when(F.col("down"), dp > dq).otherwise(dp >= dq)
    level, n = along & (dq == 0), F.greatest(dp, dq)
    steps = edges.withColumn("along", along).withColumn("level", level).withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.when(level, 0).otherwise(n))))
    at = lambda a, b: F.round(F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / F.greatest("n", F.lit(1))).cast("int")
    laid = steps.withColumn("off", F.explode(F.when(F.col("along"), F.array(*map(F.lit, (-1, 0, 1)))).otherwise(F.array(F.lit(0)))))
    wide = F.when(F.col("along"), 0).otherwise(1)
    a, b = F.when(F.col("level"), F.least("p1", "p2")).otherwise(at("p1", "p2") - wide), F.when(F.col("level"), F.greatest("p1", "p2")).otherwise(at("p1", "p2") + wide) + 1
    spans = laid.select(*by, "channel", (at("q1", "q2") + F.col("off")).alias("at"), F.greatest(a, F.lit(0)).alias("a"), b.alias("b")).where("at >= 0 AND b > 0")
    return pixels_of(joined(spans, [*by, "channel", "at"]), by).withColumn("score", F.lit(1.0).cast("float"))


def rasterised(cells: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The score map of annotated cells (by, quad, top, bottom, left, right)."""
    return corner_heat(cells, by).unionByName(edge_lines(cells, by))


def ranked(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """rows with their rank (from 1) in the order within each key, however many a key has.

    Rows are sorted over range partitions, written, and numbered in each partition; what earlier partitions have of
    the key is added. No task gets a whole key. Any column names will do, but for `rank`.
    """
    keys = [F.col(c) for c in by]
    held = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    sorted_ = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = pinned(sorted_.select(held, F.monotonically_increasing_id().alias("at"))).withColumn("part", F.shiftright("at", 33))
    key = F.struct(F.lit(0).alias("0"), *[F.col(f"row.`{c}`").alias(c) for c in by])
    parts = placed.groupBy(key.alias("key"), "part").agg(F.min("at").alias("from"), F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("key").alias("of"), F.col("part").alias("in"), "from", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    met = placed.join(parts, (F.col("part") == F.col("in")) & key.eqNullSafe(F.col("of")))
    return met.select("row.*", (F.col("at") - F.col("from") + F.col("earlier") + 1).alias("rank"))


def _bucket(hard: Column) -> Column:
    """A long that rises with a loss, a few thousand of them for each power of e; nulls are least, NaN is most, as in a sort."""
    fine = F.floor(FINENESS * F.signum(hard) * F.log1p(F.abs(hard)))
    return F.when(F.isnan(hard), F.lit((1 << 62))).otherwise(F.coalesce(fine, F.lit(-(1 << 62))))


def selected_losses(pixels: DataFrame, order: Sequence[str], ratio: int = NEGATIVES, by: Sequence[str] = ("channel",)) -> DataFrame:
    """Losses (channel, target, pred, weight) with n_positive, k and selected.

    Of each group (a channel, or a channel of a batch) all positives count, and of all places, ranked by their loss as
    negatives (positives: 0), the k largest: `ratio` for each positive, but less than all, or NONE_POSITIVE without
    any. `order` breaks ties. Counts of losses by bucket (partial aggregates) tell the bucket that holds the k-th
    loss; those above it are in, those below it out, and its own rows alone are ranked, over range partitions.
    """
    loss = huber(F.col("pred") - F.col("target")) * F.col("weight")
    positive = F.col("target") > 0
    out = pixels.withColumn("loss", loss).withColumn("_hard", F.when(positive, F.lit(0.0)).otherwise(F.col("loss"))).withColumn("_bucket", _bucket(F.col("_hard")))
    sizes = pinned(out.groupBy(*by, "_bucket").agg(F.sum(positive.cast("long")).alias("p"), F.count("*").alias("n")))
    k = F.when(F.col("n_positive") > 0, F.least(F.col("n_positive") * ratio, F.col("n_all") - 1)).otherwise(F.lit(NONE_POSITIVE).cast("long"))
    whole, falling = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(F.desc("_bucket"))
    counted = sizes.withColumn("n_positive", F.sum("p").over(whole)).withColumn("n_all", F.sum("n").over(whole)).withColumn("k", k)
    counted = counted.withColumn("above", F.sum("n").over(falling) - F.col("n"))
    # the bucket of the k-th: the last one whose rows don't all come after k; none if k is 0
    last = counted.groupBy(*by, "n_positive", "k").agg(F.max_by(F.struct("_bucket", "above"), F.when(F.col("above") < F.col("k"), F.col("above"))).alias("edge"))
    named = last.select(*[F.col(c).alias(f"_{c}") for c in by], "n_positive", "k", F.col("edge._bucket").alias("_edge"), F.col("edge.above").alias("_above"))
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    placed = out.join(named, same)
    at_edge = F.col("_edge").eqNullSafe(F.col("_bucket"))
    clear = placed.where(~at_edge).withColumn("selected", positive | F.coalesce(F.col("_bucket") > F.col("_edge"), F.lit(False)))
    close = ranked(placed.where(at_edge), by, [F.desc("_hard"), *map(F.asc, order)])
    close = close.withColumn("selected", positive | (F.col("rank") + F.col("_above") <= F.col("k"))).drop("rank")
    return clear.unionByName(close).drop("_hard", "_bucket", "_edge", "_above", *[f"_{c}" for c in by])


def channel_losses(selected: DataFrame, by: Sequence[str] = ("channel",)) -> DataFrame:
    """(by, n_positive, k, n_selected, loss): the selected losses' sum over positives plus k."""
    chosen = F.when(F.col("selected"), F.col("loss"))
    return selected.groupBy(*by).agg(F.max("n_positive").alias("n_positive"), F.max("k").alias("k"), F.count(chosen).alias("n_selected"), (F.sum(chosen) / F.max(F.col("n_positive") + F.col("k"))).alias("loss"))


def dataset_sizes(records: DataFrame, dataset: str = "dataset") -> DataFrame:
    """(dataset, n, total): how many records each dataset has, and all together."""
    counted = records.groupBy(dataset).agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(records.agg(F.count("*").alias("total"))), how="cross")  # one row


def mixture(draws: DataFrame, weights: DataFrame) -> DataFrame:
    """Draws (draw in [0, 1), ...) with the dataset that they fall to; weights (dataset, weight): a row for each of at most MOST_DATASETS."""
    order = Window.orderBy("dataset").rowsBetween(Window.unboundedPreceding, 0)
    total = weights.agg(F.sum("weight").alias("total"), F.count("*").alias("n")).where(F.assert_true(F.col("n") <= MOST_DATASETS).isNull()).drop("n")
    shares = weights.join(F.broadcast(total)).withColumn("hi", F.sum("weight").over(order) / F.col("total")).withColumn("lo", F.col("hi") - F.col("weight") / F.col("total"))
    return draws.join(F.broadcast(shares.select("dataset", "lo", "hi")), (F.col("draw") >= F.col("lo")) & (F.col("draw") < F.col("hi"))).drop("lo", "hi")


def alias_table(weights: Sequence[float]) -> list[tuple[int, float, int]]:
    """(place, share, other): a draw falls to a place with equal chances, and there to its own item below `share`, else to the other."""
    n, total = len(weights), sum(weights)
    left = [w * n / total for w in weights]
    small, large = [k for k in range(n) if left[k] < 1], [k for k in range(n) if left[k] >= 1]
    out = [(k, 1.0, k) for k in range(n)]
    while small and large:
        a, b = small.pop(), large[-1]
        out[a] = (a, left[a], b)
        left[b] -= 1 - left[a]
        if left[b] < 1:
            small.append(large.pop())
    return out


def alias_mixture(draws: DataFrame, weights: DataFrame) -> DataFrame:
    """As `mixture`, by an equi-join: one number in [0, 1) names a place of the alias table, and its fraction chooses there.

    weights: (dataset, weight), a row for each of at most MOST_DATASETS, which come to the driver; in order of dataset.
    """
    found = weights.select("dataset", "weight").orderBy("dataset").limit(MOST_DATASETS + 1).collect()
    if len(found) > MOST_DATASETS:
        raise ValueError(f"over {MOST_DATASETS} datasets")
    kind = weights.schema["dataset"].dataType.simpleString()
    rows = [(k, share, found[k].dataset, found[other].dataset) for k, share, other in alias_table([float(r.weight) for r in found])] if found else []
    table = draws.sparkSession.createDataFrame(rows, f"_place long, _share double, _own {kind}, _other {kind}")
    at = F.col("draw") * len(rows)
    placed = draws.withColumn("_place", F.floor(at)).withColumn("_rest", at - F.floor(at))
    return placed.join(F.broadcast(table), "_place").withColumn("dataset", F.when(F.col("_rest") < F.col("_share"), F.col("_own")).otherwise(F.col("_other"))).drop("_place", "_rest", "_share", "_own", "_other")
