"""Drawing against plain loops; records by position; settings and results as JSON."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgrid.operators import render
from docgrid.sources import annotations, config, sinks
from tests.test_files_and_streams import made_tables


def inside(quad, x, y):
    """Whether a place is in a convex polygon, its border included."""
    turns = [(quad[(2 * k + 2) % 8] - quad[2 * k]) * (y - quad[2 * k + 1]) - (quad[(2 * k + 3) % 8] - quad[2 * k + 1]) * (x - quad[2 * k]) for k in range(4)]
    boxed = min(quad[::2]) <= x <= max(quad[::2]) and min(quad[1::2]) <= y <= max(quad[1::2])
    return boxed and (all(t >= 0 for t in turns) or all(t <= 0 for t in turns))


QUADS = [[5, 4, 40, 6, 44, 38, 8, 44], [0, 0, 9, 0, 9, 9, 0, 9], [20, 3, 37, 20, 20, 37, 3, 20], [7, 7, 7, 7, 7, 7, 7, 7], [1, 5, 30, 5, 30, 5, 1, 5]]


def test_filled_quads_are_those_of_a_plain_test(spark):
    quads = spark.createDataFrame([(k, q) for k, q in enumerate(QUADS)], "d long, quad array<int>")
    found = {(r.d, r.y, r.x) for r in render.covered(render.spans(quads, ["d"]), ["d"]).collect()}
    for k, q in enumerate(QUADS):
        exact = {(k, y, x) for y in range(50) for x in range(50) if inside(q, x, y)}
        own = {x for x in found if x[0] == k}
        assert exact <= own
        # rounded ends reach half a pixel beyond the line
        assert all(any((k, y + e, x + d) in exact for e in (-1, 0, 1) for d in (-1, 0, 1)) for _, y, x in own - exact)


def test_spans_merge_in_order(spark):
    rows = [(1, 0, 3, 5), (1, 0, 1, 2), (1, 0, 4, 9), (1, 0, 12, 12), (1, 0, 11, 11), (1, 1, 1, 1), (1, 1, 3, 3), (1, 0, 3, 5)]
    found = render.merged_spans(spark.createDataFrame(rows, "d long, y int, a int, b int"), ["d"]).collect()
    assert {(r.y, r.a, r.b) for r in found} == {(0, 1, 9), (0, 11, 12), (1, 1, 1), (1, 3, 3)}


def test_overlay_blends_areas_under_outlines(spark):
    image = spark.createDataFrame([(1, y, x, 100, 100, 100) for y in range(12) for x in range(12)] + [(2, 0, 0, 7, 7, 7)], "d long, y int, x int, b int, g int, r int")
    quads = spark.createDataFrame([(1, [2, 2, 8, 2, 8, 8, 2, 8])], "d long, quad array<int>")
    found = {(r.d, r.y, r.x): (r.b, r.g, r.r) for r in render.overlay(image, quads, ["d"]).collect()}
    assert len(found) == 145 and found[2, 0, 0] == (7, 7, 7) and found[1, 0, 0] == (100, 100, 100)
    assert found[1, 5, 5] == (80, 106, 80)  # in the area
    assert found[1, 2, 5] == (0, 26, 204)  # on the outline, in the area
    assert found[1, 9, 5] == (20, 20, 224)  # on the outline, beyond the area


def test_false_colours_wrap(spark):
    rows = [(1, 0, 0, 0, 0.5), (1, 1, 0, 0, 0.9), (1, 4, 0, 0, 0.8), (1, 2, 3, 1, 1.5), (1, 3, 3, 1, -2.0)]
    found = {(r.y, r.x): (r.corner, r.b, r.g, r.r) for r in render.false_colours(spark.createDataFrame(rows, "d long, channel int, y int, x int, score double"), ["d"]).collect()}
    assert found == {(0, 0): (127, (229 + 204) % 256, 0, 204), (3, 1): (0, 0, 255, 0)}


def test_records_by_position_and_at_random(spark):
    records = spark.createDataFrame([(k, f"r{k}") for k in range(200)], "n long, `a.b` string").repartition(7)
    order = [F.col("n").desc()]
    assert tuple(annotations.record_at(records, 3, order).first()) == (196, "r196")
    assert annotations.record_at(records, 200, order).count() == 0
    drawn = {annotations.record_at(records, -1, order, seed).first().n for seed in range(12)}
    assert len(drawn) > 6 and drawn <= set(range(200))
    assert annotations.any_record(records.limit(0)).count() == 0


def test_settings_of_texts_are_those_of_a_file(spark):
    texts = ['{"canvas_size": 7, "thresholds": [0.5]}', '{"thresholds": [0.1, 0.3, 0.4], "threshold1": 0.9, "more": [1]}', "{}", '{"mag_ratio": 2}']
    for text in texts:
        row = spark.createDataFrame([(text,)], "t string").select(config.settings_of(F.col("t")).alias("s")).first().s
        assert config.Settings(**row.asDict()) == config.Settings().overlaid(json.loads(text))
    assert spark.createDataFrame([(None,), ("[1",)], "t string").select(config.settings_of(F.col("t")).alias("s")).distinct().count() == 1


def test_results_as_json(spark):
    found = {r.stem: json.loads(r.json) for r in sinks.result_json(made_tables(spark)).collect()}
    assert sorted(found) == ["d0", "d1", "d2"] and [t["id"] for t in found["d2"]] == [1, 2]
    assert found["d0"][0]["rect"] == [0, 0, 20, 15] and {tuple(c["row_range"]) for c in found["d0"][0]["cells"]} == {(0, 0), (1, 2)}
    assert np.array(found["d0"][0]["quad"]).tolist() == [0, 0, 20, 0, 20, 15, 0, 15] == pytest.approx([0, 0, 20, 0, 20, 15, 0, 15])
