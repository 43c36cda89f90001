"""Text of word-processor files (Office Open XML) as rows of paragraphs, table cells and headers, and a writer.

A Python data source: a partition is some files (more of them where they are many), each opened once; the XML of a member is read as a stream, so memory
holds a paragraph, not a document. A file that does not parse is a row with an error.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cohortlens.sources.recordings import _target, bundled, open_file

SCHEMA = "path string, kind string, position bigint, style string, text string, error string"
#: The namespace and the elements that text is made of.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PARAGRAPH, CELL, TEXT, TAB, BREAKS, STYLE = (f"{WORD}p", f"{WORD}tc", f"{WORD}t", f"{WORD}tab", (f"{WORD}br", f"{WORD}cr"), f"{WORD}pStyle")
PARTS = (("body", re.compile(r"word/document\.xml\Z")), ("header", re.compile(r"word/header\d*\.xml\Z")), ("footer", re.compile(r"word/footer\d*\.xml\Z")))


def paragraphs(stream) -> Iterator[tuple[bool, str, str]]:
    """(it is in a table, style, text) of each paragraph of a part, as it is read."""
    depth, held, style, stack = 0, [], "", []
    for event, node in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            stack.append(node)
            depth += node.tag == CELL
            if node.tag == PARAGRAPH:
                held, style = [], ""
            continue
        stack.pop()
        if node.tag == TEXT:
            held.append(node.text or "")
        elif node.tag == TAB and stack and stack[-1].tag != f"{WORD}tabs":
            held.append("\t")
        elif node.tag in BREAKS:
            held.append("\n")
        elif node.tag == STYLE:
            style = node.get(f"{WORD}val") or ""
        elif node.tag == CELL:
            depth -= 1
        elif node.tag == PARAGRAPH:
            yield depth > 0, style, "".join(held)
            if stack:
                stack[-1].remove(node)  # what has been read is let go
            held = []


def file_rows(path: str) -> Iterator[tuple]:
    with open_file(path) as f, zipfile.ZipFile(f) as z:
        names = z.namelist()
        if "word/document.xml" not in names:
            raise ValueError("no document part")
        for kind, pattern in PARTS:
            at = {"paragraph": 0, "cell": 0, "header": 0, "footer": 0}
            for name in sorted(n for n in names if pattern.match(n)):
                with z.open(name) as stream:
                    for table, style, text in paragraphs(stream):
                        own = kind if kind != "body" else "cell" if table else "paragraph"
                        yield path, own, at[own], style, text, None
                        at[own] += 1


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.files = options["path"], int(options.get("files", 64))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        about = store.get_file_info(name)
        if about.type == fs.FileType.File:
            return [_Files([self.path])]
        if about.type != fs.FileType.Directory:
            raise FileNotFoundError(self.path)
        found = store.get_file_info(fs.FileSelector(name, recursive=True))
        sizes = {self.path.rstrip("/") + f.path[len(name.rstrip("/")) :]: f.size or 0 for f in found if f.is_file and f.path.lower().endswith(".docx")}
        paths = sorted(sizes)
        groups = [paths[a : a + self.files] for a in range(0, len(paths), self.files)]
        return [_Files([p for group in run for p in group]) for run in bundled(groups, sum(sizes.values()))]

    def read(self, partition) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                yield from file_rows(path)
            except (ValueError, OSError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                yield path, None, None, None, None, f"{type(e).__name__}: {e}"


class WordSource(DataSource):
    """spark.read.format("word_files").load(path): option files, how many a partition has."""

    @classmethod
    def name(cls) -> str:
        return "word_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_documents(spark: SparkSession, path: str, files: int = 64) -> DataFrame:
    """SCHEMA: position counts paragraphs, cells' paragraphs, headers and footers of a file, each from 0."""
    spark.dataSource.register(WordSource)
    return spark.read.format("word_files").option("files", str(files)).load(path)


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_TYPES = _HEAD + (
    '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/header1.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.header+xml"/></Types>'
)
_LINKS = _HEAD + '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{0}" Target="{1}"/></Relationships>'
_SPACE = f'xmlns:w="{WORD[1:-1]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _paragraph(text: str) -> str:
    return "".join(["<w:p><w:r>", *(f'<w:t xml:space="preserve">{escape(part)}</w:t>' if k % 2 == 0 else "<w:tab/>" for k, part in enumerate(re.split("(\t)", text))), "</w:r></w:p>"])


def write_documents(df: DataFrame, folder: str) -> DataFrame:
    """Write a .docx for each row (name, headers, cells, paragraphs: arrays of texts) and return (name, path).

    Cells stand in a table of one column before the paragraphs. A file gets its name when it is whole.
    """

    def write(name: str, headers: list, cells: list, body: list) -> str:
        path = f"{folder}/{name}.docx"
        files, target = _target(path)
        rows = "".join(f"<w:tr><w:tc>{_paragraph(c)}</w:tc></w:tr>" for c in cells)
        table = f"<w:tbl>{rows}</w:tbl>" if cells else ""
        mark = '<w:sectPr><w:headerReference w:type="default" r:id="r1"/></w:sectPr>' if headers else ""
        with files.open_output_stream(target + ".part") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("[Content_Types].xml", _TYPES)
            z.writestr("_rels/.rels", _LINKS.format("officeDocument", "word/document.xml"))
            z.writestr("word/_rels/document.xml.rels", _LINKS.format("header", "header1.xml"))
            z.writestr("word/header1.xml", f"{_HEAD}<w:hdr {_SPACE}>{''.join(map(_paragraph, headers))}</w:hdr>")
            z.writestr("word/document.xml", f"{_HEAD}<w:document {_SPACE}><w:body>{table}{''.join(map(_paragraph, body))}{mark}</w:body></w:document>")
        files.move(target + ".part", target)
        return path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(r["name"], write(r["name"], r["headers"] or [], r["cells"] or [], r["paragraphs"] or [])) for i in range(len(batch)) for r in batch.slice(i, 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string())], names=["name", "path"])

    return df.select("name", "headers", "cells", "paragraphs").mapInArrow(run, "name string, path string")
