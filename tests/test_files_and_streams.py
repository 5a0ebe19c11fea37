"""Files of single documents, PDF pages, drawn training rows and live best scores, with repeated tasks and restarts."""

import json
import random
import time
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from docgrid.operators import cells, training
from docgrid.sources import annotations, document_files, pdf_pages
from docgrid.streaming import best, training_rows


def names(folder):
    return sorted(p.name for p in Path(folder).rglob("*") if p.is_file())


def test_an_attempt_that_is_repeated_does_no_harm(tmp_path):
    writer = document_files.DocumentWriter(str(tmp_path / "out"), False)
    rows = [Row(name="a.xml", content=b"1"), Row(name="b.xml", content=b"")]

    def dies():
        yield rows[0]
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    assert "a.xml" not in [p.name for p in (tmp_path / "out").iterdir()]  # not under its name
    done = [writer.write(iter(rows)), writer.write(iter(rows))]
    writer.commit([done[1]])
    assert done[1].n_files == 2 and names(tmp_path / "out") == ["_SUCCESS", "a.xml", "b.xml"]
    assert (tmp_path / "out/a.xml").read_bytes() == b"1"


def test_an_aborted_job_leaves_nothing(tmp_path):
    writer = document_files.DocumentWriter(str(tmp_path / "out"), False)
    writer.write(iter([Row(name="a.xml", content=b"1")]))
    with pytest.raises(ValueError):
        writer.write(iter([Row(name="../b.xml", content=b"1")]))
    writer.abort([None])
    assert names(tmp_path / "out") == []


def made_tables(spark, n=3):
    """A table of two by two cells, the upper two merged, for each document; the last one has two tables."""
    rows = [(d, t, i, i, 0, 0, 10 * i, 0, 10 * i + 10, 5) for d in range(n) for t in (1, 2) if t == 1 or d == n - 1 for i in (0, 1)]
    single = spark.createDataFrame(rows, "doc_id long, comp int, si int, ei int, sj int, ej int, sx int, sy int, ex int, ey int")
    wide = single.groupBy("doc_id", "comp").agg(F.lit(0).alias("si"), F.lit(1).alias("ei"), F.lit(1).alias("sj"), F.lit(2).alias("ej"), F.lit(0).alias("sx"), F.lit(5).alias("sy"), F.lit(20).alias("ex"), F.lit(15).alias("ey"))
    found = cells.tables(single.unionByName(wide), single.select("doc_id", "comp", F.col("comp").alias("rank")).distinct())
    return found.withColumn("file_name", F.format_string("d%d.png", "doc_id"))


def test_a_file_for_each_document(spark, tmp_path):
    tables, folder = made_tables(spark), str(tmp_path / "xml")
    document_files.write_result_files(tables, folder)
    assert names(folder) == ["_SUCCESS", "d0.xml", "d1.xml", "d2.xml"]
    scanned = annotations.read_annotations(spark, folder)
    assert {(r.stem, r.filename, len(r.table)) for r in scanned.collect()} == {("d0", "d0.png", 1), ("d1", "d1.png", 1), ("d2", "d2.png", 2)}
    assert {(r.start_row, r.end_row, r.start_col, r.end_col) for r in annotations.annotated_cells(scanned).collect()} == {(0, 0, 0, 0), (0, 0, 1, 1), (1, 2, 0, 1)}
    with pytest.raises(FileExistsError):
        document_files.write_result_files(tables, folder)
    document_files.write_result_files(tables.where("doc_id = 1"), folder, mode="overwrite")
    assert names(folder) == ["_SUCCESS", "d1.xml"]
    document_files.write_result_files(tables.where("doc_id = 0"), folder, mode="append")
    assert names(folder) == ["_SUCCESS", "d0.xml", "d1.xml"]


def test_two_documents_of_one_stem_are_an_error(spark, tmp_path):
    tables = made_tables(spark).withColumn("file_name", F.concat(F.lit("same."), F.col("doc_id").cast("string")))
    with pytest.raises(Exception, match="several documents have the stem same"):
        document_files.write_result_files(tables, str(tmp_path / "xml"))
    assert names(tmp_path) == []


def test_workbooks_open_and_read_back(spark, tmp_path):
    document_files.write_workbooks(made_tables(spark), str(tmp_path / "books"))
    assert names(tmp_path / "books") == ["_SUCCESS", "d0.xlsx", "d1.xlsx", "d2.xlsx"]
    with zipfile.ZipFile(tmp_path / "books/d2.xlsx") as book:
        assert book.testzip() is None and {"[Content_Types].xml", "xl/workbook.xml", "xl/worksheets/sheet2.xml"} <= set(book.namelist())
    found = {(Path(r.path).stem, r.sheet, r.a1_range, r.is_merged) for r in document_files.read_workbooks(spark, str(tmp_path / "books")).collect()}
    ranges = [("A1:A1", False), ("B1:B1", False), ("A2:B3", True)]
    assert found == {(f"d{d}", f"table_{t}", *r) for d in range(3) for t in (1, 2) if t == 1 or d == 2 for r in ranges}
    assert document_files.workbook([("a & b", [("AB12:AB12", False)])]) == document_files.workbook([("a & b", [("AB12:AB12", False)])])
    assert list(document_files.ranges_of(document_files.workbook([("a & b", [("AB12:AC14", True)])]))) == [("a & b", "AB12:AC14", True)]


def test_pages_of_files(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.pdf").write_bytes(pdf_pages.blank_pdf([(612, 792), (612, 792), (300.5, 400)]))
    (tmp_path / "in/deep/b.PDF").write_bytes(pdf_pages.blank_pdf([(100, 200)], packed=True))
    (tmp_path / "in/c.pdf").write_bytes(b"not a page")
    (tmp_path / "in/d.pdf").write_bytes(b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Kids [2 0 R] >> endobj trailer << /Root 1 0 R >>")
    # an updated file: a page turned and its box replaced, a tree of two levels, a box the other way round
    old = b"%PDF-1.4\n1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n2 0 obj\n<</Type/Pages/Kids[3 0 R]/MediaBox[0 0 10 10]/Rotate 90>>\nendobj\n3 0 obj\n<</Type/Pages/Parent 2 0 R/Kids[4 0 R]>>\nendobj\n4 0 obj\n<</Type/Page/Parent 3 0 R/Note(a \\) b)>>\nendobj\ntrailer <</Root 1 0 R>>\n"
    (tmp_path / "in/e.pdf").write_bytes(old + b"4 0 obj\n<</Type/Page/Parent 3 0 R/MediaBox[50 60 10 20]>>\nendobj\n")
    (tmp_path / "in/note.txt").write_text("x")
    rows = pdf_pages.read_pages(spark, str(tmp_path / "in")).collect()
    found = {(Path(r.path).name, r.page, r.width, r.height, r.rotation) for r in rows if r.error is None}
    assert found == {("a.pdf", 0, 612.0, 792.0, 0), ("a.pdf", 1, 612.0, 792.0, 0), ("a.pdf", 2, 300.5, 400.0, 0), ("b.PDF", 0, 100.0, 200.0, 0), ("e.pdf", 0, 40.0, 40.0, 90)}
    assert {Path(r.path).name: r.page for r in rows if r.error is not None} == {"c.pdf": None, "d.pdf": None}
    narrow = pdf_pages.read_pages(spark, str(tmp_path / "in"), "page int, path string")
    assert narrow.columns == ["page", "path"] and narrow.count() == 7
    # without media boxes asked for none is looked at
    bare = pdf_pages.blank_pdf([(1, 1)]).replace(b"/MediaBox [0 0 1 1]", b"")
    assert list(pdf_pages.page_rows("p", bare, ["page"])) == [(0,)]
    assert [r[0] for r in pdf_pages.page_rows("p", bare, ["error", "width"])] == ["KeyError: 'MediaBox'"]


def test_pages_that_annotations_name(spark, tmp_path):
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf/x.pdf").write_bytes(pdf_pages.blank_pdf([(612, 792), (1, 1)]))
    xml = spark.createDataFrame([(f"file://{tmp_path}/a/b/c/x.xml", "x.pdf"), (f"{tmp_path}/a/b/c/y.xml", "none.pdf")], "path string, filename string")
    found = pdf_pages.referenced_pages(xml, pdf_pages.read_pages(spark, f"{tmp_path}/pdf")).collect()
    assert [(r.width, r.height) for r in found] == [(612.0, 792.0)]
    named = spark.createDataFrame([("/p/x.y.pdf", 3)], "path string, page int").select(pdf_pages.result_name(F.col("path"), F.col("page")), pdf_pages.raster_size(F.lit(612.0)))
    assert tuple(named.first()) == ("x.y_3.pdf", 1275)


def test_alias_table_keeps_the_chances():
    for weights in ([1], [1, 2, 3, 4, 5], [0.0, 1.0, 7.0], [5, 1, 1, 1], [random.Random(1).random() for _ in range(97)]):
        chance = [0.0] * len(weights)
        for place, share, other in training.alias_table(weights):
            chance[place] += share / len(weights)
            chance[other] += (1 - share) / len(weights)
        assert chance == pytest.approx([w / sum(weights) for w in weights])


@pytest.fixture(scope="module")
def drawn(spark):
    cell = "array<struct<quad: array<double>, top: boolean, bottom: boolean, left: boolean, right: boolean>>"
    rows = [(d, k, 800, 600, [([100.0 + k, 100.0, 500.0, 100.0, 500.0, 400.0, 100.0 + k, 400.0], True, True, False, True)]) for d in ("a", "b") for k in range(5 if d == "a" else 3)]
    records = spark.createDataFrame(rows, f"dataset string, record long, width int, height int, cells {cell}")
    weights = spark.createDataFrame([("a", 1), ("b", 2), ("none", 5)], "dataset string, weight int")
    return weights, training_rows.numbered_records(records, [F.col("record")]).drop("record").cache()


def picked(rows):
    return {(r.number, r.dataset, r.nth) for r in rows.select("number", "dataset", "nth").distinct().collect()}


def test_training_rows_are_functions_of_their_numbers(spark, drawn):
    weights, records = drawn
    made = training_rows.training_rows(spark.range(60).withColumnRenamed("id", "number"), weights, records)
    found = picked(made)
    assert {d for _, d, _ in found} == {"a", "b"} and len(found) > 40
    some = training_rows.training_rows(spark.range(20, 25).withColumnRenamed("id", "number"), weights, records)
    assert picked(some) == {x for x in found if 20 <= x[0] < 25}


def test_an_endless_stream_goes_on_with_the_same_rows(spark, drawn, tmp_path):
    weights, records = drawn
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run(until):
        stream = training_rows.stream_training_rows(spark, weights, records, out, state, rows=8)
        began = time.time()
        while len(list(Path(out).glob(f"batch={until}/_SUCCESS"))) < 1 and time.time() - began < 90:
            time.sleep(0.3)
        stream.stop()

    run(0)
    run(2)
    rows = spark.read.parquet(out)
    seen = {b: picked(rows.where(F.col("batch") == b)) for b in (0, 1, 2)}
    for b, found in seen.items():
        numbers = {n for n, _, _ in found}
        assert numbers and numbers <= set(range(8 * b, 8 * b + 8))
        assert found == picked(training_rows.training_rows(spark.range(8 * b, 8 * b + 8).withColumnRenamed("id", "number"), weights, records))


def test_live_best_scores_match_the_batch_after_a_restart(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    rng = random.Random(3)
    rows = [(f"run{rng.randrange(3)}", k, None if k % 7 == 0 else rng.choice([0.1, 0.5, 0.5, 0.9, rng.random()])) for k in range(60)]

    def arrive(part, name):
        (folder / name).write_text("\n".join(json.dumps({"run": r, "iteration": k, "output": f'x "hmean": {s}, y' if s is not None else "no score"}) for r, k, s in part))

    def go():
        stream = spark.readStream.schema("run string, iteration long, output string").option("maxFilesPerTrigger", 1).json(str(folder))
        started = best.best_so_far(stream).writeStream.outputMode("update").foreachBatch(lambda batch, n: seen.extend(batch.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        started.awaitTermination()

    arrive(rows[:20], "a.json")
    arrive(rows[20:40], "b.json")
    go()
    arrive(rows[40:], "c.json")
    go()  # a new query on the state of the one before
    last = {r.run: (r.iteration, r.score) for r in seen}
    scored = [(r, k, s) for r, k, s in rows if s is not None]
    assert last == {run: max(((k, s) for r, k, s in scored if r == run), key=lambda x: (x[1], -x[0])) for run in {r for r, _, _ in scored}}
    assert all(a.score <= b.score for run in last for a, b in zip([r for r in seen if r.run == run], [r for r in seen if r.run == run][1:], strict=False))
