"""Results as XML documents and spreadsheet ranges."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.functions.coords import a1_range
from docgrid.schemas import SIDES
from docgrid.sources.files import stem


def _points(quad: Column, clockwise: bool = False) -> Column:
    """Corners as text in the order top left, bottom left, bottom right, top right; or clockwise."""
    corner = lambda k: F.concat_ws(",", quad[2 * k].cast("string"), quad[2 * k + 1].cast("string"))
    return F.concat_ws(" ", *[corner(k) for k in ((0, 1, 2, 3) if clockwise else (0, 3, 2, 1))])


def _rect_points(rect: Column) -> Column:
    x1, y1, x2, y2 = rect[0], rect[1], rect[0] + rect[2], rect[1] + rect[3]
    return F.concat_ws(" ", *[F.concat_ws(",", a.cast("string"), b.cast("string")) for a, b in ((x1, y1), (x1, y2), (x2, y2), (x2, y1))])


def result_documents(tables: DataFrame, name: str = "file_name", flagged: bool = False, whole: bool = False) -> DataFrame:
    """(stem, _filename, table): a nested row per document, in the shape of the result XML; tables in the order of id.

    flagged: the documents are training input, too: cells have a flag for each of SIDES (null: not drawn), written as
    a Lines element, and their corners go clockwise, as annotations have them.
    whole: each row is the one table of its document, so nothing is grouped, and no row leaves its place.
    """
    flags = lambda c: [F.struct(*[F.coalesce(c[side], F.lit(False)).cast("int").alias(f"_{side}") for side in SIDES]).alias("Lines")] if flagged else []
    cell = lambda c: F.struct(
        c["row_range"][0].alias("_start-row"), c["row_range"][1].alias("_end-row"), c["col_range"][0].alias("_start-col"), c["col_range"][1].alias("_end-col"),
        F.struct(_points(c["quad"], flagged).alias("_points")).alias("Coords"), *flags(c)
    )
    table = F.struct(F.struct(_rect_points(F.col("rect")).alias("_points")).alias("Coords"), F.transform("cells", cell).alias("cell"))
    if whole:
        return tables.select(stem(F.col(name)).alias("stem"), F.col(name).alias("_filename"), F.array(table).alias("table"))
    entry = F.collect_list(F.struct("id", table.alias("t")))
    grouped = tables.groupBy(name).agg(F.transform(F.array_sort(entry), lambda e: e["t"]).alias("table"))
    return grouped.select(stem(F.col(name)).alias("stem"), F.col(name).alias("_filename"), "table")


def result_xml(tables: DataFrame, name: str = "file_name", flagged: bool = False, whole: bool = False) -> DataFrame:
    """(stem, xml): the text of each document's result."""
    documents = result_documents(tables, name, flagged, whole)
    return documents.select("stem", F.to_xml(F.struct("_filename", "table"), {"rowTag": "document"}).alias("xml"))


def result_json(tables: DataFrame, name: str = "file_name", whole: bool = False) -> DataFrame:
    """(stem, json): each document's result as a JSON array of its tables, in the order of id; whole as in result_documents."""
    table = F.struct("id", "angle", "rect", "quad", "cells") if "angle" in tables.columns else F.struct("id", "rect", "quad", "cells")
    grouped = tables.select(name, F.array(table).alias("tables")) if whole else tables.groupBy(name).agg(F.array_sort(F.collect_list(table)).alias("tables"))
    return grouped.select(stem(F.col(name)).alias("stem"), F.to_json("tables").alias("json"))


def write_result_xml(tables: DataFrame, path: str, name: str = "file_name", flagged: bool = False, whole: bool = False) -> None:
    """Results as XML files of many documents each, below path; readable by the annotation scan."""
    result_documents(tables, name, flagged, whole).drop("stem").write.format("xml").option("rootTag", "documents").option("rowTag", "document").save(path)


def sheet_name(number: Column) -> Column:
    return F.concat(F.lit("table_"), number.cast("string"))


def sheet_range(c: Column) -> Column:
    """(a1_range, is_merged) of a table's cell."""
    merged = (c["col_range"][0] != c["col_range"][1]) | (c["row_range"][0] != c["row_range"][1])
    return F.struct(a1_range(c["col_range"], c["row_range"]).alias("a1_range"), merged.alias("is_merged"))


def sheet_ranges(tables: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, sheet, a1_range, is_merged): what a spreadsheet of the tables holds; a sheet per table, a range per cell."""
    cells = tables.select(*keys, sheet_name(F.col("id")).alias("sheet"), F.explode("cells").alias("c"))
    return cells.select(*keys, "sheet", sheet_range(F.col("c")).alias("r")).select(*keys, "sheet", "r.*")
