"""Files, annotations, settings, sinks, the inbox."""

import json

import pytest
from pyspark.sql import functions as F

from docgrid.operators import training
from docgrid.plans.recovery import Limits
from docgrid.sources import annotations, config, files, sinks
from docgrid.streaming.inbox import recover_stream
from tests.test_operators import annotated

XML = """<document filename="a.jpg"><table><Coords points="10,10 110,10 110,60 10,60"/>
<cell start-row="0" end-row="0" start-col="0" end-col="0"><Coords points="10,10 60,10 60,60 10,60"/><Lines top="1" bottom="1" left="2" right="0"/></cell>
<cell start-row="0" end-row="0" start-col="1" end-col="1"><Coords points="60,10  110,10 110,60 60,60"/><Lines top="0" bottom="1" left="0" right="1"/></cell></table></document>"""


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    for name in ("a.jpg", "b.PNG", "c.png", "deep/d.TIFF", "deep/e.pdf", "a.json", "deep/d.xml"):
        (tmp_path / "in" / name).write_bytes(b"x")
    (tmp_path / "xml").mkdir()
    (tmp_path / "xml/a.xml").write_text(XML)
    return tmp_path


def png(pixels, colour):
    """An image file of rows of bytes; colour: 0 grey, 2 RGB, 6 with alpha."""
    import struct
    import zlib

    width, depth = len(pixels[0]) // {0: 1, 2: 3, 6: 4}[colour], 8
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(pixels), depth, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(r) for r in pixels))) + chunk(b"IEND", b"")


def test_images_are_read_as_rgb(spark, tmp_path):
    given = {"rgb.png": ([[1, 2, 3, 4, 5, 6]], 2), "alpha.png": ([[1, 2, 3, 255], [4, 5, 6, 255]], 6), "grey.png": ([[7, 8]], 0)}
    for name, (pixels, colour) in given.items():
        (tmp_path / name).write_bytes(png(pixels, colour))
    (tmp_path / "broken.png").write_bytes(b"no image")
    found = {r.path.rsplit("/", 1)[1]: (r.height, r.width, [*r.rgb]) for r in files.read_images(spark, str(tmp_path)).collect()}
    assert found == {"rgb.png": (1, 2, [1, 2, 3, 4, 5, 6]), "alpha.png": (2, 1, [1, 2, 3, 4, 5, 6]), "grey.png": (1, 2, [7, 7, 7, 8, 8, 8])}


def test_listings(spark, folder):
    names = lambda df: sorted(r.path.rsplit("/in/", 1)[1] for r in df.collect())
    top = f"{folder}/in"
    assert names(files.image_listing(spark, top)) == ["a.jpg", "c.png", "deep/d.TIFF"]
    assert names(files.input_files(spark, top)) == ["a.jpg", "c.png", "deep/d.TIFF"]
    images, found = files.image_listing(spark, top), files.listing(spark, top, "json", "xml")
    assert names(files.with_sibling(images, found)) == ["a.jpg", "deep/d.TIFF"] and names(files.without_sibling(images, found)) == ["c.png"]
    kinds = {r.path.rsplit("/", 1)[1]: r.k for r in files.listing(spark, top).select("path", files.kind(F.col("path")).alias("k")).collect()}
    assert (kinds["b.PNG"], kinds["e.pdf"], kinds["d.xml"]) == ("image", "pdf", "annotation")


def test_annotations(spark, folder):
    docs = annotations.read_annotations(spark, f"{folder}/xml")
    rows = annotations.annotated_cells(docs).orderBy("cell_id").collect()
    assert [r.stem for r in rows] == ["a", "a"] and rows[0].quad == [10, 10, 60, 10, 60, 60, 10, 60]
    assert [(r.top, r.bottom, r.left, r.right) for r in rows] == [(True, True, True, False), (False, True, False, True)]
    images = files.image_listing(spark, f"{folder}/in")
    assert annotations.annotated_images(images, docs).count() == 1
    pairs = annotations.paired(docs, images)
    assert pairs.first().image.endswith("/in/a.jpg")
    assert annotations.copy_manifest(pairs).first().target.endswith("/xml/a.jpg")
    with pytest.raises(Exception, match="several images"):
        annotations.paired(docs, images.unionByName(images)).collect()
    with pytest.raises(Exception, match="no image"):
        annotations.paired(docs, images.where("length > 99")).collect()
    assert annotations.any_record(docs, 3).count() == 1


def test_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"canvas_size": 1600, "thresholds": [0.3, 0.2, 0.9], "other": 1}))
    found = config.read_settings(spark, f"{tmp_path}/c.json")
    assert (found.canvas_size, found.threshold1, found.threshold2, found.mag_ratio) == (1600, 0.3, 0.2, 10.0)
    assert config.read_settings(spark, f"{tmp_path}/c.json", known_only=False)["other"] == 1


def a_table(spark):
    cell = "row_range array<int>, col_range array<int>, quad array<int>, text string, confidence double"
    rows = [("p/a.jpg", 1, [0, 0, 20, 10], [([0, 1], [0, 0], [0, 0, 10, 0, 10, 10, 0, 10], "", 0.0), ([0, 0], [27, 27], [10, 0, 20, 0, 20, 10, 10, 10], "", 0.0)])]
    return spark.createDataFrame(rows, f"file_name string, id int, rect array<int>, cells array<struct<{cell.replace(' ', ': ').replace(',:', ',')}>>")


def test_result_xml_can_be_read_again(spark, tmp_path):
    sinks.write_result_xml(a_table(spark), f"{tmp_path}/out")
    rows = annotations.annotated_cells(annotations.read_annotations(spark, f"{tmp_path}/out")).orderBy("cell_id").collect()
    assert rows[0].quad == [0, 0, 0, 10, 10, 10, 10, 0] and rows[1].start_col == 27
    row = sinks.result_xml(a_table(spark)).first()
    assert row.stem == "a" and row.xml.startswith("<document") and 'points="0,0 0,10 20,10 20,0"' in row.xml


def test_flagged_results_are_training_input(spark, tmp_path):
    """Written with flags and read back, cells give the score map that they gave before; null flags count as not drawn."""
    quads = [[10, 10, 60, 10, 60, 40, 10, 40], [60, 10, 110, 10, 110, 40, 60, 40]]
    flags = [(True, False, True, None), (False, True, False, True)]
    cell = "row_range: array<int>, col_range: array<int>, quad: array<int>, text: string, confidence: double, top: boolean, bottom: boolean, left: boolean, right: boolean"
    rows = [("p/a.jpg", 1, [10, 10, 100, 30], [([0, 0], [k, k], q, "", 0.0, *f) for k, (q, f) in enumerate(zip(quads, flags, strict=True))])]
    made = spark.createDataFrame(rows, f"file_name string, id int, rect array<int>, cells array<struct<{cell}>>")
    sinks.write_result_xml(made, f"{tmp_path}/out", flagged=True)
    read = annotations.annotated_cells(annotations.read_annotations(spark, f"{tmp_path}/out"))
    assert [(r.top, r.bottom, r.left, r.right) for r in read.orderBy("cell_id").collect()] == [(True, False, True, False), (False, True, False, True)]
    given = spark.createDataFrame([(q, *[bool(x) for x in f]) for q, f in zip(quads, flags, strict=True)], "quad array<int>, top boolean, bottom boolean, left boolean, right boolean")
    drawn = lambda df: {tuple(r) for r in training.rasterised(df.select(F.lit(1).alias("doc_id"), "quad", "top", "bottom", "left", "right")).collect()}
    assert drawn(read) == drawn(given)
    assert "<Lines" not in sinks.result_xml(made).first().xml


def test_sheet_ranges(spark):
    found = [(r.sheet, r.a1_range, r.is_merged) for r in sinks.sheet_ranges(a_table(spark), ("file_name",)).collect()]
    assert found == [("table_1", "A1:A2", True), ("table_1", "AB1:AB1", False)]


def test_inbox(spark, tmp_path):
    training.rasterised(annotated(spark, {1: (3, 3, []), 2: (2, 3, [])})).coalesce(1).write.parquet(f"{tmp_path}/in")
    recover_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", Limits(turn=False)).awaitTermination()
    assert {(r.doc_id, len(r.cells)) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(1, 9), (2, 6)}
