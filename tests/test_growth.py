"""What queries move between tasks: plans whose shuffles, joins and files don't grow beyond the input's narrow rows."""

import re

import pytest

import __spark_entry__
from tests.conftest import SMALL

QUERIES = __spark_entry__.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def steps(df, name: str) -> int:
    return len(re.findall(rf"\b{name}\b", plan(df)))


def test_scanned_annotations_join_nothing(spark):
    found = plan(QUERIES["scanned_annotations"](spark, SMALL))
    assert "Join" not in found and "BroadcastExchange" not in found


@pytest.mark.parametrize("name", ["table_records", "table_sheets", "result_texts", "result_documents", "merged_cells"])
def test_a_grid_is_shuffled_once_as_narrow_rows(spark, name):
    found = QUERIES[name](spark, SMALL)
    assert steps(found, "Exchange") == 1 and "Join" not in plan(found)


def test_packed_files_are_few(spark):
    from pathlib import Path

    from docgrid.functions.lineage import scratch

    for name, kind in (("result_files", "results-*"), ("workbook_files", "workbooks-*")):
        found = QUERIES[name](spark, SMALL)
        documents = found.select("stem").distinct().count()
        folder = max(Path(scratch(spark).removeprefix("file:")).glob(kind), key=lambda p: p.stat().st_mtime)
        assert documents > 100 and len(list(folder.glob("*.parquet"))) < 20


def test_corner_heat_shuffles_corners_once(spark):
    assert steps(QUERIES["corner_heat"](spark, SMALL), "Exchange") == 1


def test_votes_of_an_angle_are_not_rows(spark):
    found = plan(QUERIES["hough_lines"](spark, SMALL))
    assert "MapInArrow" in found and "sequence" not in found


def test_runs_and_their_pixels(spark):
    from docgrid.operators import components, raster

    places = {(c, y, x) for c in (1, 2, 3) for y in range(12) for x in range(15) if (y * x + c) % 3 or y == x}
    pixels = spark.createDataFrame([(7, *p) for p in places] * 2, "doc_id long, channel int, y int, x int")
    runs = raster.runs(pixels)
    assert sorted((r.channel, r.y, r.x) for r in raster.pixels_of(runs).collect()) == sorted(places)
    slow = components.component_stats(components.label_pixels(pixels.select("doc_id", "y", "x").distinct()))
    assert sorted(map(tuple, components.run_components(runs).select(slow.columns).collect())) == sorted(map(tuple, slow.collect()))
    boxes = spark.createDataFrame([(7, 1, 2, 3, 6, 5), (7, 2, 5, 0, 9, 12)], "doc_id long, comp int, l int, t int, w int, h int")
    cut = raster.pixels_of(components.runs_in_boxes(runs, boxes), ["doc_id", "comp"])
    whole = components.pixels_in_boxes(pixels.distinct(), boxes).select(cut.columns)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize("turn", [False, True])
def test_a_recovery_broadcasts_nothing(spark, monkeypatch, turn):
    """What grows with the documents isn't broadcast, however few bytes it has in files: neither in the result's plan nor in what is written on its way."""
    from docgrid.plans import recovery

    plans, pinned = [], recovery.pinned
    monkeypatch.setattr(recovery, "pinned", lambda df: plans.append(plan(df)) or pinned(df))
    lines = [(doc, c, 10 + 25 * k + o, 10 + p) if c == 1 else (doc, c, 10 + p, 10 + 25 * k + o) for doc in (1, 2) for c in (1, 2) for k in range(3) for o in (-1, 0, 1) for p in range(51)]
    pixels = spark.createDataFrame([(*p, 1.0) for p in lines], "doc_id long, channel int, y int, x int, score double")
    moves = spark.createDataFrame([(k, 1.0, 1.0, 0.0, 0.0, 0, 0, 90, 90, 90, 90) for k in (1, 2)], "doc_id long, ratio_w double, ratio_h double, pad_x double, pad_y double, x1 int, y1 int, x2 int, y2 int, heat_w int, heat_h int")
    found = recovery.recover_tables(pixels, moves, recovery.Limits(turn=turn), sides=True)
    assert sorted((r.doc_id, len(r.cells)) for r in found.collect()) == [(1, 4), (2, 4)]
    assert len(plans) >= 3 and not [p for p in [*plans, plan(found)] if "Broadcast" in p]


def test_edges_are_drawn_once(spark):
    """Pixels of edges that share places, lie askew, reach out of the map or lack a corner, held against plain loops."""
    import random

    from docgrid.operators import training
    from docgrid.schemas import HORIZONTAL, IMPLICIT_HORIZONTAL, IMPLICIT_VERTICAL, VERTICAL

    draw = random.Random(4)
    rows = [(1, [0, 0, 9, 0, 9, 6, 0, 6], True, None, True, False), (1, [9, 0, 18, 0, 18, 6, 9, 6], True, True, False, False), (1, [4, 4, 4, 4, 4, 4, 4, 4], True, True, True, True), (2, [None, 2, 9, 2, 9, 8, 3, 8], True, True, True, True), (2, [0, 0, 0, 7, 5, 7, 5, 0], True, False, True, False), (2, None, True, True, True, True)]
    rows += [(3 + k % 2, [draw.randrange(-3, 14) for _ in range(8)], *[draw.random() < 0.5 for _ in range(4)]) for k in range(40)]
    away = lambda v: int(abs(v) + 0.5) * (1 if v >= 0 else -1)
    places = set()
    for doc, quad, top, bottom, left, right in rows:
        for seen, a, b, channels in ((top, 0, 1, (HORIZONTAL, IMPLICIT_HORIZONTAL)), (bottom, 2, 3, (HORIZONTAL, IMPLICIT_HORIZONTAL)), (right, 1, 2, (VERTICAL, IMPLICIT_VERTICAL)), (left, 3, 0, (VERTICAL, IMPLICIT_VERTICAL))):
            x1, y1, x2, y2 = (*quad[2 * a : 2 * a + 2], *quad[2 * b : 2 * b + 2]) if quad else [None] * 4
            if None in (x1, y1, x2, y2):
                continue
            n = max(abs(x2 - x1), abs(y2 - y1))
            flat = abs(x2 - x1) >= abs(y2 - y1)
            for k in range(n + 1):
                x, y = away(x1 + (x2 - x1) * k / max(n, 1)), away(y1 + (y2 - y1) * k / max(n, 1))
                places |= {(doc, channels[not seen], y + o * flat, x + o * (not flat)) for o in (-1, 0, 1)}
    cells = spark.createDataFrame(rows, "doc_id long, quad array<int>, top boolean, bottom boolean, left boolean, right boolean")
    drawn = training.edge_lines(cells, ["doc_id"])
    assert sorted((r.doc_id, r.channel, r.y, r.x) for r in drawn.collect()) == sorted(p for p in places if p[2] >= 0 and p[3] >= 0)
    assert steps(drawn, "Exchange") == 1


def test_books_are_made_and_read_many_at_a_time(monkeypatch):
    """A task's work for a book is that of its ranges: no archive is opened by zipfile, no batch handed on for each."""
    import pyarrow as pa

    from docgrid.sources import document_files

    class Books:
        columns, schema = ["path", "content"], None

        def __getattr__(self, name):
            return lambda *a, **b: self

    monkeypatch.setattr(document_files, "read_documents", lambda *a: Books())
    monkeypatch.setattr(Books, "mapInArrow", lambda self, work, schema: work, raising=False)
    opened = document_files.read_workbooks(None, "", packed=True)
    books = [document_files.workbook([(f"table_{s}", [(f"A{k % 5 + 1}:B{k % 5 + 1}", True), ("AA7:AA7", False)]) for s in range(1, k % 3 + 1)]) for k in range(300)]
    monkeypatch.setattr(document_files.zipfile, "ZipFile", None)
    found = list(opened(iter([pa.RecordBatch.from_pydict({"path": [str(k) for k in range(300)], "content": pa.array(books, pa.binary())})])))
    assert len(found) == 1
    expected = [(str(k), f"table_{s}", *r) for k in range(300) for s in range(1, k % 3 + 1) for r in sorted([(f"A{k % 5 + 1}:B{k % 5 + 1}", True), ("AA7:AA7", False)])]
    assert sorted(tuple(r.values()) for r in found[0].to_pylist()) == sorted(expected)


def test_archives_are_those_of_zipfile():
    import io
    import zipfile

    from docgrid.sources import document_files

    sheets = [("a & b", [("C2:C2", False), ("A1:B1", True), ("AB12:AB12", False)]), ("é", []), ("third", [("A1:A3", True)])]
    made = document_files.workbook(sheets)
    ranges = [(n, *r) for n, ranges in sheets for r in ranges]

    def again(kind, comment=b"", stream=io.BytesIO):
        out = stream()
        with zipfile.ZipFile(io.BytesIO(made)) as book, zipfile.ZipFile(out, "w", kind) as copy:
            copy.comment = comment
            for name in book.namelist():
                copy.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), book.read(name), kind)
        return out.getvalue()

    class Pipe(io.BytesIO):  # sizes follow the parts
        def seekable(self):
            return False

        def seek(self, *a):
            raise OSError

        def tell(self):
            raise OSError

    assert again(zipfile.ZIP_DEFLATED) == made
    for other in (made, again(zipfile.ZIP_STORED), again(zipfile.ZIP_BZIP2), again(zipfile.ZIP_DEFLATED, b"a comment"), again(zipfile.ZIP_DEFLATED, stream=Pipe)):
        assert sorted(document_files.ranges_of(other)) == sorted(ranges)
    stored = again(zipfile.ZIP_STORED)
    with pytest.raises(zipfile.BadZipFile):
        list(document_files.ranges_of(stored.replace(b"AB12:AB12", b"AB13:AB12")))
    for broken in (b"", made[:-1], made[:200]):
        with pytest.raises(zipfile.BadZipFile):
            list(document_files.ranges_of(broken))


def test_runs_are_those_of_plain_loops(spark):
    """Runs over, up to and beside the ends of 64 places, repeated and single pixels, and places before 0; pixels aren't sorted."""
    import random

    from docgrid.operators import raster

    draw = random.Random(7)
    lines = {(d, c, at): {p for a in [draw.randrange(-70, 260) for _ in range(4)] for p in range(a, a + draw.choice([1, 2, 40, 64, 65, 130]))} for d in (1, 2) for c in range(5) for at in range(-1, 3)}
    lines |= {(3, 1, 0): set(range(0, 64)), (3, 1, 1): {63, 64}, (3, 1, 2): {0, 127, 128, 191}, (3, 2, 0): set(range(-64, 128)), (3, 2, 1): {62, 63, 65}}
    down = lambda c: c in (2, 4)
    pixels = spark.createDataFrame([(d, c, p, at) if down(c) else (d, c, at, p) for (d, c, at), places in lines.items() for p in places for _ in range(1 + p % 2)], "doc_id long, channel int, y int, x int")
    expected = [(d, c, at, a, min(b for b in range(a + 1, a + 999) if b not in places)) for (d, c, at), places in lines.items() for a in places if a - 1 not in places]
    found = raster.runs(pixels)
    assert sorted(map(tuple, found.select("doc_id", "channel", "at", "a", "b").collect())) == sorted(expected)
    assert "bit_or" in plan(found).split("Scan")[0]
