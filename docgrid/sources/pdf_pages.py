"""The pages of PDF files as a relation, without rasterising: a Spark data source that reads page trees and media boxes.

A row is a page: (path, page from 0, width and height of its media box in points, rotation in degrees, error). A file
that can't be read gives one row with the error and no page. Partitions are runs of files of about PARTITION_BYTES;
the driver lists files, tasks read them. With a schema of fewer columns the others aren't computed: paths and page
numbers alone need no media boxes. Objects in compressed object streams are read; encrypted files are errors.
"""

import re
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "pdf_pages"
SCHEMA = "path string, page int, width double, height double, rotation int, error string"
PARTITION_BYTES = 64 << 20
#: Dots an inch of rasterised pages, points an inch.
DPI, POINTS = 150, 72
OBJECT = re.compile(rb"(?<![0-9])([0-9]+)\s+[0-9]+\s+obj\b")
TOKEN = re.compile(rb"\s*(?:%[^\r\n]*[\r\n]+\s*)*(<<|>>|\[|\]|/[^\s<>\[\]()/%]*|[0-9]+\s+[0-9]+\s+R\b|[+-]?[0-9]*\.?[0-9]+|\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>|[a-z]+)", re.DOTALL)


class Reference(int):
    """The number of an object that stands elsewhere."""


def parsed(data: bytes, at: int = 0) -> tuple[Any, int]:
    """The value that begins at a place, and the place after it. Dictionaries have names as keys, without the slash."""
    stack: list[list] = [[]]
    while True:
        m = TOKEN.match(data, at)
        if not m:
            raise ValueError("not an object")
        token, at = m[1], m.end()
        if token in (b"<<", b"["):
            stack.append([])
            continue
        if token in (b">>", b"]"):
            items = stack.pop()
            value: Any = dict(zip(items[::2], items[1::2], strict=False)) if token == b">>" else items
        elif token.startswith(b"/"):
            value = token[1:].decode("latin-1")
        elif token.endswith(b"R") and token[:1].isdigit():
            value = Reference(token.split()[0])
        elif token[:1] in b"(<" or token.isalpha():
            value = {b"true": True, b"false": False}.get(token)
        else:
            value = float(token)
        if not stack:
            raise ValueError("not an object")
        stack[-1].append(value)
        if len(stack) == 1:
            return value, at


class Document:
    """The objects of a file by number; of several with one number the last counts, as in updated files."""

    def __init__(self, data: bytes) -> None:
        self.data, self.known = data, {}
        self.places = {int(m[1]): m.end() for m in OBJECT.finditer(data)}
        if not data.lstrip()[:5] == b"%PDF-":
            raise ValueError("not a PDF file")
        if re.search(rb"/Encrypt\s+[0-9]+\s+[0-9]+\s+R", data):
            raise ValueError("encrypted")
        self.packed: dict[int, tuple[bytes, int]] = {}
        for m in re.finditer(rb"/Type\s*/ObjStm\b", data):
            start = max((p for p in self.places.values() if p <= m.start()), default=None)
            if start is not None:
                self._unpack(start)

    def _unpack(self, start: int) -> None:
        head, after = parsed(self.data, start)
        begin = re.compile(rb"\s*stream\r?\n").match(self.data, after)
        if not begin or not isinstance(head, dict):
            return
        length = self.value(head.get("Length"))
        body = self.data[begin.end() : begin.end() + int(length)] if length else self.data[begin.end() : self.data.find(b"endstream", begin.end())]
        if self.value(head.get("Filter")) in ("FlateDecode", ["FlateDecode"]):
            body = zlib.decompressobj().decompress(body)
        numbers = [int(x) for x in body[: int(head["First"])].split()]
        for number, at in zip(numbers[::2], numbers[1::2], strict=True):
            self.packed[number] = (body, int(head["First"]) + at)

    def value(self, x: Any) -> Any:
        if not isinstance(x, Reference):
            return x
        if x not in self.known:
            data, at = self.packed[x] if x in self.packed else (self.data, self.places[x])
            self.known[x] = parsed(data, at)[0]
        return self.known[x]

    def root(self) -> dict:
        for m in reversed(list(re.finditer(rb"/Root\s+([0-9]+)\s+[0-9]+\s+R", self.data))):
            found = self.value(Reference(m[1]))
            if isinstance(found, dict) and "Pages" in found:
                return found
        raise ValueError("no catalog")

    def pages(self) -> Iterator[dict]:
        """Pages in order, with the media box and the rotation that they inherit."""
        todo, seen = [(self.root()["Pages"], {})], set()
        while todo:
            at, above = todo.pop()
            if isinstance(at, Reference):
                if at in seen:
                    raise ValueError("page tree with a circle")
                seen.add(at)
            node = self.value(at)
            own = above | {k: self.value(node[k]) for k in ("MediaBox", "Rotate") if k in node}
            if "Kids" in node:
                todo += [(kid, own) for kid in reversed(self.value(node["Kids"]))]
            else:
                yield own


def page_rows(path: str, data: bytes, columns: list[str]) -> Iterator[tuple]:
    try:
        sized = bool({"width", "height", "rotation"} & set(columns))
        found = []
        document = Document(data)
        for k, page in enumerate(document.pages()):
            row = {"path": path, "page": k, "error": None}
            if sized:
                x1, y1, x2, y2 = (float(document.value(v)) for v in page["MediaBox"])
                row |= {"width": abs(x2 - x1), "height": abs(y2 - y1), "rotation": int(page.get("Rotate", 0)) % 360}
            found.append(tuple(row[c] for c in columns))
        yield from found
    except Exception as fault:  # a broken file is a row, not the end of the job
        yield tuple({"path": path, "error": f"{type(fault).__name__}: {fault}"}.get(c) for c in columns)


@dataclass
class Files(InputPartition):
    paths: list[str]


class PageReader(DataSourceReader):
    def __init__(self, folder: str, columns: list[str]) -> None:
        self.folder, self.columns = folder, columns

    def _located(self) -> tuple[fs.FileSystem, str]:
        local = re.sub(r"^file:/+", "/", self.folder)
        return (fs.LocalFileSystem(), local.rstrip("/")) if local.startswith("/") else fs.FileSystem.from_uri(self.folder)

    def partitions(self) -> list[Files]:
        system, root = self._located()
        runs, size = [[]], 0
        for found in sorted(system.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda f: f.path):
            if found.type == fs.FileType.File and found.path.lower().endswith(".pdf"):
                if runs[-1] and size + found.size > PARTITION_BYTES:
                    runs.append([])
                    size = 0
                runs[-1].append(found.path)
                size += found.size
        return [Files(r) for r in runs]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = self._located()
        for path in partition.paths:
            with system.open_input_stream(path) as data:
                yield from page_rows(path, data.read(), self.columns)


class PdfPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(self.options["path"], schema.fieldNames())


def read_pages(spark: SparkSession, folder: str, columns: str = SCHEMA) -> DataFrame:
    """The pages of the PDF files below a folder; columns: those of SCHEMA that are wanted."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(PdfPages)
    return spark.read.format(FORMAT).schema(columns).load(folder)


def raster_size(points: Column) -> Column:
    """Pixels of a length of a page that is rasterised at DPI."""
    return F.ceil(points * DPI / POINTS).cast("int")


def result_name(path: Column, page: Column) -> Column:
    """The name that a page's result has: the file's stem, the page's number, the file's ending."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("_"), page.cast("string"), F.regexp_extract(name, r"(\.[^.]*)$", 1))


def referenced_pages(annotations: DataFrame, pages: DataFrame) -> DataFrame:
    """(path, pdf, width, height): for annotations (path, filename) the first page of the PDF that they name, which lies in the
    folder pdf three levels above theirs; nothing where that can't be read."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    up = F.regexp_replace(F.regexp_replace(folder, r"^file:/+", "/"), r"(/[^/]+){3}$", "")
    wanted = annotations.select("path", F.concat(up, F.lit("/pdf/"), "filename").alias("pdf"))
    first = pages.where("page = 0").select(F.col("path").alias("pdf"), "width", "height")
    return wanted.join(first, "pdf").select("path", "pdf", "width", "height")


def blank_pdf(boxes: list[tuple[float, float]], packed: bool = False) -> bytes:
    """A file of blank pages of given widths and heights; the first box is the tree's, others are their pages' own. packed: its objects in a compressed stream."""
    of = lambda w, h: f"/MediaBox [0 0 {w:g} {h:g}]"
    kids = " ".join(f"{3 + k} 0 R" for k in range(len(boxes)))
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(boxes)} /Kids [{kids}] {of(*boxes[0])} >>"]
    objects += [f"<< /Type /Page /Parent 2 0 R {of(*box) if box != boxes[0] else ''} >>" for box in boxes]
    if not packed:
        body = "".join(f"{k} 0 obj\n{x}\nendobj\n" for k, x in enumerate(objects, 1)).encode()
    else:
        places = [sum(len(x) + 1 for x in objects[:k]) for k in range(len(objects))]
        head = " ".join(f"{k} {p}" for k, p in enumerate(places, 1)) + " "
        stream = zlib.compress((head + "\n".join(objects)).encode())
        number = len(objects) + 1
        body = f"{number} 0 obj\n<< /Type /ObjStm /N {len(objects)} /First {len(head)} /Filter /FlateDecode /Length {len(stream)} >>\nstream\n".encode() + stream + b"\nendstream\nendobj\n"
    return b"%PDF-1.5\n" + body + b"trailer << /Root 1 0 R >>\n%%EOF\n"
