"""Hand-worked cases of the geometry, and sequential operators against plain walks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgrid.functions import augment, coords
from docgrid.operators import cells, components, lines, raster, rotation, training
from docgrid.plans.recovery import Limits, recover_tables
from docgrid.schemas import HORIZONTAL, IMPLICIT_VERTICAL, PIXEL, VERTICAL

BY = ["t"]


def profile(spark, values):
    return spark.createDataFrame([(1, k, v) for k, v in enumerate(values) if v], "t long, pos int, v long")


# ---- profiles and lines


def test_centre_counts_from_one_and_rounds_half_to_even(spark):
    row = lines.islands(profile(spark, [0, 3, 4, 0]), BY, 2).first()
    assert (row.s, row.e, row.center, row.peak) == (1, 3, 3, 4)
    assert lines.islands(profile(spark, [1, 1]), BY, 0).first().center == 2  # 1.5
    assert lines.islands(profile(spark, [0, 1, 1]), BY, 0).first().center == 2  # 2.5


def test_peak_must_pass_the_limit(spark):
    assert lines.islands(profile(spark, [10, 0, 11]), BY, 10).collect()[0].s == 2


def peaks_by_walk(values, least=5):
    """The three states, bin by bin."""
    out, total, mass, before, state = [], 0, 0, 0, 0
    for i, v in enumerate(values):
        ends = state > 0 and v <= least
        if v > least:
            if state == 0:
                state = 1
            elif state == 1 and v < before:
                state = 2
            elif state == 2 and v > before:
                ends = True
            if not ends:
                total, mass, before = total + i * v, mass + v, v
        if ends:
            out.append(int(total / mass + 0.5))
            total = mass = before = state = 0
    return out + ([int(total / mass + 0.5)] if state else [])


@pytest.mark.parametrize("seed", range(6))
def test_corner_peaks(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([0, 4, 6, 7, 8, 9, 12]) for _ in range(60)]
    found = sorted(r.corner for r in lines.corner_peaks(profile(spark, values), BY).collect())
    assert found == sorted(peaks_by_walk(values))


def test_valley_between_touching_peaks_is_dropped(spark):
    assert [r.corner for r in lines.corner_peaks(profile(spark, [6, 9, 7, 8, 9, 6]), BY).collect()] == peaks_by_walk([6, 9, 7, 8, 9, 6])


def test_gap_is_to_the_corner_before_kept_or_not(spark):
    line = spark.createDataFrame([(1, 0, 30, 15)], "t long, s int, e int, center int")
    corners = spark.createDataFrame([(1, 10), (1, 13), (1, 16)], "t long, corner int")
    assert [(r.s, r.e, r.center) for r in lines.split_at_corners(line, corners, BY).collect()] == [(9, 11, 10)]
    one = corners.limit(1)
    assert [(r.s, r.e, r.center) for r in lines.split_at_corners(line, one, BY).collect()] == [(0, 30, 15)]


def test_regions_lose_a_last_run_of_one(spark):
    pixels = spark.createDataFrame([(1, 5, y) for y in (2, 3, 4, 7, 8, 10)] + [(1, 9, 3)], "t long, x int, y int")
    found = lines.islands(raster.projection(pixels, "x", BY), BY, 0)
    got = {r.s: (r.rs, r.re, [(p.a, p.b) for p in r.region_list]) for r in lines.regions(found, pixels, "x", BY).collect()}
    assert got == {5: (2, 10, [(2, 5), (7, 9)]), 9: (3, 3, [])}


def line_table(spark, rows):
    made = [(1, s, e, c, rs, re, [(rs, re)], im) for s, e, c, rs, re, im in rows]
    return spark.createDataFrame(made, "t long, s int, e int, center int, rs int, re int, region_list array<struct<a: int, b: int>>, implicit boolean")


def test_overlapping_lines_merge_and_both_move_on(spark):
    (row,) = lines.merged(line_table(spark, [(5, 10, 7, 0, 4, False), (8, 14, 11, 2, 9, True)]), BY).collect()
    assert (row.center, row.implicit, row.rs, row.re) == (11, True, 0, 9)
    assert [(p.a, p.b) for p in row.region_list] == [(2, 9), (0, 4)]


def test_lines_apart_keep_their_order(spark):
    rows = [(5, 6, 5, 0, 1, False), (50, 52, 51, 0, 1, False), (20, 22, 21, 0, 1, True), (80, 81, 80, 0, 1, True)]
    found = sorted(lines.merged(line_table(spark, rows), BY).collect(), key=lambda r: r.nth)
    assert [r.center for r in found] == [5, 21, 51, 80] and [r.nth for r in found] == [0, 1, 2, 3]


def test_edges_are_added_beyond_their_room(spark):
    found = lines.merged(line_table(spark, [(15, 16, 15, 0, 1, False), (80, 81, 80, 0, 1, True)]), BY)
    ends = spark.createDataFrame([(1, 0, 100)], "t long, start int, end int")
    assert sorted(r.center for r in lines.with_edges(found, ends, BY).collect()) == [0, 15, 80]  # 19 short of 100, but the line is implicit


# ---- components


def test_first_small_component_stops(spark):
    stats = spark.createDataFrame([(1, 1, 0, 0, 30, 30, 900), (1, 2, 0, 0, 10, 50, 500), (1, 3, 0, 0, 20, 20, 400)], "doc_id long, comp int, l int, t int, w int, h int, area long")
    assert [r.comp for r in components.table_candidates(stats).collect()] == [1]


@pytest.mark.parametrize(("height", "width", "side"), [(24, 30, 7), (6, 9, 2), (40, 3, 1000)])
def test_components_by_group_and_by_tiles_agree_with_a_flood(spark, height, width, side):
    grid = np.random.default_rng(height).random((height, width)) < 0.4
    place = [(int(y), int(x)) for y, x in np.argwhere(grid)]
    pixels = spark.createDataFrame([(7, y, x) for y, x in place] + [(8, 0, 0)], "doc_id long, y int, x int")
    label, n = {}, 0
    for start in place:
        if start not in label:
            n += 1
            todo = [start]
            while todo:
                y, x = todo.pop()
                if (y, x) not in label and (y, x) in set(place):
                    label[y, x] = n
                    todo += [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    for labelled in (components.label_pixels(pixels), components.label_tiled(pixels, side=side)):
        rows = labelled.collect()
        assert {(r.y, r.x): r.comp for r in rows if r.doc_id == 7} == label
        assert [r.comp for r in rows if r.doc_id == 8] == [1]


def test_a_component_that_winds_through_many_tiles(spark):
    """A spiral of one pixel's width over 81 tiles, in two maps told apart by two columns."""
    n, at, way, seen = 27, (0, 0), (0, 1), {(0, 0)}
    while True:
        ahead = [(at[0] + k * way[0], at[1] + k * way[1]) for k in (1, 2)]
        if not (0 <= ahead[0][0] < n and 0 <= ahead[0][1] < n) or ahead[1] in seen:
            way = (way[1], -way[0])
            nxt = (at[0] + way[0], at[1] + way[1])
            if nxt in seen or (nxt[0] + way[0], nxt[1] + way[1]) in seen:
                break
            ahead = [nxt]
        at = ahead[0]
        seen.add(at)
    rows = [(1, k, y, x) for k in (1, 2) for y, x in seen] + [(1, 2, 100, 100)]
    pixels = spark.createDataFrame(rows, "doc_id long, part int, y int, x int")
    found = components.label_tiled(pixels, ["doc_id", "part"], 3).groupBy("part", "comp").count().collect()
    assert sorted(map(tuple, found)) == [(1, 1, len(seen)), (2, 1, len(seen)), (2, 2, 1)]


def test_windows_are_boxes_not_labels(spark):
    pixels = spark.createDataFrame([(1, 5, 5)], "doc_id long, y int, x int")
    boxes = spark.createDataFrame([(1, 1, 0, 0, 9, 9), (1, 2, 5, 5, 3, 3), (1, 3, 6, 0, 3, 9)], "doc_id long, comp int, l int, t int, w int, h int")
    assert sorted(r.comp for r in components.pixels_in_boxes(pixels, boxes).collect()) == [1, 2]


# ---- cells


@pytest.mark.parametrize("seed", range(4))
def test_merged_cells_cover_the_grid_once(spark, seed):
    rng = random.Random(seed)
    n, m = rng.randrange(1, 6), rng.randrange(2, 6)
    rows = [(1, i, j, i, j, i + 1, j + 1, rng.random() < 0.4, rng.random() < 0.4) for i in range(n) for j in range(m)]
    grid = spark.createDataFrame(rows, "t long, i int, j int, sx int, sy int, ex int, ey int, merge_col boolean, merge_row boolean")
    found = cells.merge_cells(grid, BY).collect()
    covered = sorted((i, j) for r in found for i in range(r.si, r.ei + 1) for j in range(r.sj, r.ej + 1))
    assert covered == sorted((i, j) for _, i, j, *_ in rows)
    flags = {(i, j): (c, r) for _, i, j, _, _, _, _, c, r in rows}
    assert all(flags[i, r.sj][0] for r in found for i in range(r.si, r.ei))
    assert all(flags[i, j][1] for r in found for i in range(r.si, r.ei + 1) for j in range(r.sj, r.ej))


def test_merge_needs_all_three_probes_free(spark):
    made = lambda centers, regions: spark.createDataFrame([(1, k, c, [regions]) for k, c in enumerate(centers)], "t long, nth int, center int, region_list array<struct<a: int, b: int>>")
    grid = cells.grid(made([0, 50, 100], (0, 30)), made([0, 20, 40], (0, 99)), BY)
    flags = {(r.i, r.j): (r.merge_col, r.merge_row) for r in grid.collect()}
    assert flags == {(0, 0): (False, False), (0, 1): (False, False), (1, 0): (False, False), (1, 1): (False, False)}
    apart = {(r.i, r.j): r.merge_col for r in cells.grid(made([0, 50, 100], (0, 20)), made([0, 20, 40], (0, 99)), BY).collect()}
    assert apart == {(0, 0): False, (0, 1): True, (1, 0): False, (1, 1): True}


# ---- coordinates


def test_letters_of_columns(spark):
    row = spark.range(1).select(*[coords.column_name(F.lit(k)).alias(f"c{k}") for k in (0, 25, 26, 51, 52, 701, 702)], coords.column_name_legacy(F.lit(51)).alias("old")).first()
    assert tuple(row) == ("A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "BZ")


def test_rectangles_lose_padding_at_their_corner_only(spark):
    move = lambda n: coords.adjusted(F.array(*[F.lit(v) for v in (10, 20, 30, 40)]), F.lit(2.0), F.lit(2.0), F.lit(3.0), F.lit(5.0), n)
    assert spark.range(1).select(move(2)).first()[0] == [17, 35, 60, 80]
    assert spark.range(1).select(move(-1)).first()[0] == [17, 35, 57, 75]


def test_resize(spark):
    g = coords.resize(F.lit(1000), F.lit(701), 1600, 10.0)
    row = spark.range(1).select(*[v.alias(k) for k, v in g.items()]).first()
    assert (row.target_h, row.target_w, row.padded_h, row.padded_w, row.x1, row.x2, row.heat_w) == (1600, 1121, 1600, 1280, 39, 600, 640)


def test_flags_and_points(spark):
    row = spark.range(1).select(*[coords.flag(F.lit(v)).alias(v) for v in ("0", "2", "yes", "No", "t")], coords.points(F.lit(" 1,2  3,4.5 ")).alias("p")).first()
    assert tuple(row)[:5] == (False, True, True, False, True) and row.p == [1.0, 2.0, 3.0, 4.5]


# ---- rotation


def test_turning_matches_a_dense_bilinear_rotation(spark):
    size, angle = 40, 7.0
    image = np.zeros((size, size))
    image[10:30, 20:23] = 1
    pixels = spark.createDataFrame([(1, 1, int(y), int(x), angle) for y, x in np.argwhere(image)], "t long, channel int, y int, x int, angle double")
    found = {(r.y, r.x) for r in rotation.rotate(pixels, BY, size, size).collect()}
    c, s, mid = np.cos(np.radians(angle)), np.sin(np.radians(angle)), size / 2
    expected = set()
    for y in range(size):
        for x in range(size):
            bx, by = c * (x - mid) - s * (y - mid) + mid, s * (x - mid) + c * (y - mid) + mid
            x0, y0 = int(np.floor(bx)), int(np.floor(by))
            value = sum(image[yy, xx] * (1 - abs(bx - xx)) * (1 - abs(by - yy)) for xx in (x0, x0 + 1) for yy in (y0, y0 + 1) if 0 <= xx < size and 0 <= yy < size)
            if value >= 0.5 - 1e-9:
                expected.add((y, x))
    assert found == expected


def test_turning_back(spark):
    x, y = rotation.turned(*rotation.turned(F.lit(3.0), F.lit(8.0), F.lit(12.0), F.lit(20.0), F.lit(20.0)), F.lit(-12.0), F.lit(20.0), F.lit(20.0))
    assert np.allclose(tuple(spark.range(1).select(x, y).first()), (3.0, 8.0))
    m = np.array(rotation.matrix(12.0, 20.0, 20.0)) @ [3.0, 8.0, 1.0]
    a, b = rotation.turned(F.lit(3.0), F.lit(8.0), F.lit(12.0), F.lit(20.0), F.lit(20.0))
    assert np.allclose(tuple(spark.range(1).select(a, b).first()), m[:2])


def test_sobel_of_an_edge(spark):
    pixels = spark.createDataFrame([(1, y, x) for y in range(5) for x in (4, 5)], "t long, y int, x int")
    found = {(r.y, r.x): r.v for r in raster.sobel(pixels, "x", BY, 5, 9).collect()}
    assert found[2, 3] == found[2, 4] == 4 and found[0, 3] == 3 and (2, 5) not in found


def test_tilt(spark):
    angles = [coords.F.round(rotation.line_angle(F.lit(v), h), 6) for v, h in ((91.0, True), (1.0, False), (179.0, False))]
    assert tuple(spark.range(1).select(*angles).first()) == (1.0, 1.0, -1.0)


# ---- losses


def test_hard_negatives(spark):
    rows = [(0, 1.0, 0.0, 1.0, 0), (0, 0.0, 3.0, 1.0, 1), (0, 0.0, 0.5, 1.0, 2), (0, 0.0, 0.2, 1.0, 3), (0, 0.0, 0.1, 1.0, 4), (1, 0.0, 0.4, 1.0, 5)]
    table = spark.createDataFrame(rows, "channel int, target double, pred double, weight double, n int")
    found = {r.channel: r for r in training.channel_losses(training.selected_losses(table, ["n"])).collect()}
    assert (found[0].n_positive, found[0].k, found[0].n_selected) == (1, 3, 4)
    assert found[0].loss == pytest.approx((0.5 + 2.5 + 0.125 + 0.02) / 4)
    assert (found[1].k, found[1].n_selected) == (10_000, 1)


def test_ranks_over_range_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), rng.randrange(50), n) for n in range(600)]
    table = spark.createDataFrame(rows, "k string, v int, n int").repartition(5)
    found = {r.n: r["rank"] for r in training.ranked(table, ["k"], [F.desc("v"), F.asc("n")]).collect()}
    for key in ("hot", "a", None):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        assert [found[n] for _, _, n in own] == [*range(1, len(own) + 1)]


def test_hard_negatives_of_a_batch_are_its_own(spark):
    rows = [(b, 0, float(k == 0), k / 10, 1.0, k) for b in (1, 2) for k in range(8)]
    table = spark.createDataFrame(rows, "batch int, channel int, target double, pred double, weight double, n int")
    by = ("batch", "channel")
    assert [(r.n_positive, r.k, r.n_selected) for r in training.channel_losses(training.selected_losses(table, ["n"], by=by), by).collect()] == [(1, 3, 4)] * 2


def test_scores_are_read_from_text(spark):
    texts = ['b\'{"recall": 0.5, "hmean": 0.9690, "n": 3}\\n\'', '{"hmean":1e-3}', "nothing", None]
    assert [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(coords.score_in(F.col("t")).alias("s")).collect()] == [0.969, 0.001, None, None]


# ---- round trip


def annotated(spark, docs):
    rows = []
    for doc, (n_cols, n_rows, spans) in docs.items():
        covered = {(i, j): span for span in spans for i in range(span[0], span[2] + 1) for j in range(span[1], span[3] + 1)}
        for i in range(n_cols):
            for j in range(n_rows):
                i0, j0, i1, j1 = covered.get((i, j), (i, j, i, j))
                if (i, j) == (i0, j0):
                    rows.append((doc, [20 + 50 * i0, 20 + 40 * j0, 20 + 50 * (i1 + 1), 20 + 40 * j0, 20 + 50 * (i1 + 1), 20 + 40 * (j1 + 1), 20 + 50 * i0, 20 + 40 * (j1 + 1)], True, True, True, True))
    return spark.createDataFrame(rows, "doc_id long, quad array<int>, top boolean, bottom boolean, left boolean, right boolean")


def test_grids_with_spans_come_back(spark):
    docs = {1: (3, 3, []), 2: (4, 3, [(0, 0, 1, 0)]), 3: (3, 4, [(1, 1, 1, 2)]), 4: (4, 4, [(1, 1, 2, 2)])}
    found = recover_tables(training.rasterised(annotated(spark, docs)), limits=Limits(turn=False)).collect()
    assert len(found) == len(docs)
    for table in found:
        n_cols, n_rows, spans = docs[table.doc_id]
        got = {(c.col_range[0], c.row_range[0], c.col_range[1], c.row_range[1]) for c in table.cells}
        inside = {(i, j) for s in spans for i in range(s[0], s[2] + 1) for j in range(s[1], s[3] + 1)}
        assert got == set(spans) | {(i, j, i, j) for i in range(n_cols) for j in range(n_rows) if (i, j) not in inside}
        assert all(abs(a - b) <= 2 for a, b in zip(table.rect, [20, 20, 50 * n_cols, 40 * n_rows], strict=True)) and table.angle == "0.0"


def test_transforms_mask_and_move(spark):
    pixels = training.rasterised(annotated(spark, {1: (3, 3, [])})).unionByName(spark.createDataFrame([(1, HORIZONTAL, 5, 5, 1.0)], PIXEL))
    moves = spark.createDataFrame([(1, 0.5, 0.5, 10.0, 4.0, 10, 10, 400, 400)], "doc_id long, ratio_w double, ratio_h double, pad_x double, pad_y double, x1 int, y1 int, x2 int, y2 int")
    (table,) = recover_tables(pixels, moves, Limits(turn=False)).collect()
    assert all(abs(a - b) <= 4 for a, b in zip(table.quad, [30, 36, 330, 36, 330, 276, 30, 276], strict=True))


def test_a_turned_table_is_set_upright(spark):
    """A grid drawn at two degrees comes back with its angle, and with corners where they were drawn."""
    angle, size = 2.0, 700
    upright = training.edge_lines(annotated(spark, {1: (12, 14, [])}), ["doc_id"]).select("doc_id", "channel", "y", "x", F.lit(-angle).alias("angle"))
    drawn = rotation.rotate(upright, ["doc_id"], size, size).withColumn("score", F.lit(1.0).cast("float"))
    (table,) = recover_tables(drawn, limits=Limits(votes=300)).collect()
    assert abs(abs(table.angle_degrees) - angle) <= 0.2 and len(table.cells) == 12 * 14


def test_channels_and_implicit_dilation(spark):
    pixels = spark.createDataFrame([(1, IMPLICIT_VERTICAL, 3, 0, 0.25), (1, VERTICAL, 3, 9, 0.25), (1, HORIZONTAL, 3, 9, 0.3)], PIXEL)
    kept = raster.above_threshold(pixels)
    assert [(r.channel, r.x) for r in kept.collect()] == [(IMPLICIT_VERTICAL, 0)]  # 0.3 as a float isn't above 0.3 as a float
    assert sorted(r.x for r in raster.dilate_x(kept, ["doc_id"], 2).collect()) == [0, 1, 2]


# ---- augmentation


def test_colours_go_to_hue_and_back(spark):
    import colorsys

    rng = random.Random(4)
    rows = [tuple(float(rng.choice([0, 40, 128, 255])) for _ in range(3)) for _ in range(40)]
    table = spark.createDataFrame(rows, "b double, g double, r double")
    h, s, v = augment.to_hsv(F.col("b"), F.col("g"), F.col("r"))
    for row in table.select("b", "g", "r", h.alias("h"), s.alias("s"), v.alias("v"), *[c.alias(n) for n, c in zip(("b2", "g2", "r2"), augment.from_hsv(h, s, v), strict=True)]).collect():
        expected = colorsys.rgb_to_hsv(row.r / 255, row.g / 255, row.b / 255)
        assert np.allclose((row.h / 360, row.s, row.v / 255), expected) and np.allclose((row.b2, row.g2, row.r2), (row.b, row.g, row.r))


def test_perspective_takes_the_corners_where_it_should(spark):
    to = [5, -3, 790, 8, 810, 590, -4, 603]
    h = augment.corners_map(F.lit(800), F.lit(600), [F.lit(v) for v in to])
    corners = F.array(*[F.lit(float(v)) for v in (0, 0, 799, 0, 799, 599, 0, 599)])
    assert np.allclose(spark.range(1).select(augment.warped(corners, h)).first()[0], to)


def test_boxes_follow_the_image(spark):
    boxes = spark.createDataFrame([(k, 800, 600, [0.1, 0.1, 0.6, 0.1, 0.6, 0.5, 0.1, 0.5]) for k in range(60)], "doc_id long, width int, height int, quad array<double>")
    out = augment.augmented_boxes(boxes, "doc_id", 1024)
    rows = out.withColumn("moved", augment.draw(F.col("doc_id"), "perspective?") < 0.5).collect()
    assert 10 < sum(r.moved for r in rows) < 50
    for r in (r for r in rows if not r.moved):  # an upright box stays one, in the image's proportions
        q = np.array(r.quad).reshape(4, 2)
        assert np.isclose((q[1, 0] - q[0, 0]) / (q[3, 1] - q[0, 1]), 400 / 240)
        assert 0.5 * 400 / 1024 - 1e-3 <= q[1, 0] - q[0, 0] <= 2 * 400 / 1024


# ---- votes from coarse to fine


def brute_lines(places, step, votes):
    counts = {}
    for k in range(round(180 / step)):
        t = np.radians(k * step)
        for x, y in places:
            rho = int(np.floor(x * np.cos(t) + y * np.sin(t) + 0.5)) if x * np.cos(t) + y * np.sin(t) >= 0 else -int(np.floor(-(x * np.cos(t) + y * np.sin(t)) + 0.5))
            counts[rho, k] = counts.get((rho, k), 0) + 1
    at = lambda rho, k: counts.get((rho, k), 0)
    return sorted((r, k, v) for (r, k), v in counts.items() if v > votes and v > at(r - 1, k) and v >= at(r + 1, k) and v > at(r, k - 1) and v >= at(r, k + 1))


@pytest.mark.parametrize(("step", "votes"), [(0.1, 60), (0.25, 25), (1.0, 30), (7.0, 20)])
def test_coarse_to_fine_votes_lose_no_line(spark, step, votes):
    rng = np.random.default_rng(3)
    places = {(int(x), int(y)) for x, y in rng.integers(0, 150, (150, 2))} | {(20 + t, int(40 + 0.21 * t)) for t in range(90)} | {(int(120 - 0.4 * t), 10 + t) for t in range(90)} | {(t, 0) for t in range(0, 80)} | {(0, t) for t in range(50)}
    edges = spark.createDataFrame([(1, x, y) for x, y in places], "doc_id long, x int, y int")
    found = sorted((r.rho, r.k, r.votes) for r in rotation.hough_lines(edges, ["doc_id"], step, votes).collect())
    assert found and found == brute_lines(places, step, votes)


def test_far_fewer_vote_rows_than_angles(spark):
    """Three long lines among noise at a tenth of a degree and 400 votes: a small share of 1800 rows a pixel."""
    rng = np.random.default_rng(4)
    places = {(int(x), int(y)) for x, y in rng.integers(0, 700, (800, 2))} | {(50 + t, 100 * k + int(0.03 * t)) for t in range(600) for k in (1, 3, 5)}
    edges = spark.createDataFrame([(1, x, y) for x, y in places], "doc_id long, x int, y int")
    rows = [level.count() for level in rotation.vote_levels(edges, ["doc_id"])]
    assert sum(rows) < 0.15 * 1800 * len(places), [r / len(places) for r in rows]
    assert {r.k for r in rotation.hough_lines(edges, ["doc_id"]).collect()} >= {917}


def test_kth_loss_by_buckets_matches_a_sort(spark):
    rng = np.random.default_rng(5)
    rows = [(int(c), int(t), float(p), k) for k, (c, t, p) in enumerate(zip(rng.integers(0, 4, 3000), rng.random(3000) < 0.05, rng.choice([0.1, 0.2, 0.7, 3.5], 3000) * rng.choice([1.0, 1.0 + 1e-9], 3000), strict=True))]
    rows += [(9, 0, 0.5, -1), (None, 1, 0.5, -2), (None, 0, 0.5, -3), (8, 1, 0.1, -4)]
    table = spark.createDataFrame(rows, "channel int, target int, pred double, k_ long").withColumn("weight", F.lit(1.0)).withColumn("at", F.lit(1)).withColumn("part", F.lit(2))
    found = {r.k_: r.selected for r in training.selected_losses(table, ["k_"]).collect()}
    for channel in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == channel]
        n_positive = sum(r[1] for r in own)
        k = min(3 * n_positive, len(own) - 1) if n_positive else 10_000
        huber = lambda d: 0.5 * d * d if abs(d) <= 1 else abs(d) - 0.5
        order = sorted(own, key=lambda r: (-(0.0 if r[1] else huber(r[2] - r[1])), r[3]))
        assert {r[3] for r in own if found[r[3]]} == {r[3] for r in order[:k]} | {r[3] for r in own if r[1]}
