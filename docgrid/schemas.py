"""Schemas of the relations: score pixels, lines, cells, tables, annotations."""

#: Channels of a score map.
CORNER, HORIZONTAL, VERTICAL, IMPLICIT_HORIZONTAL, IMPLICIT_VERTICAL = range(5)

PIXEL = "doc_id long, channel int, y int, x int, score float"
#: A line lies at `center` on its axis within the band [s, e); region is its extent on the other axis.
LINE = "s int, e int, center int, rs int, re int, region_list array<struct<a: int, b: int>>, implicit boolean"
CELL = "row_range array<int>, col_range array<int>, quad array<int>, text string, confidence double"
#: Sides of a cell; a flag tells whether the line there is drawn.
SIDES = ("top", "bottom", "left", "right")
ANNOTATION = (
    "_filename string, table array<struct<Coords: struct<_points: string>, cell: array<struct<"
    "`_start-row`: int, `_end-row`: int, `_start-col`: int, `_end-col`: int, "
    "Coords: struct<_points: string>, Lines: struct<_top: int, _bottom: int, _left: int, _right: int>>>>>"
)
