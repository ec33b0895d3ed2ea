"""PAGE XML bodies to nested records, and from there to flat tables of lines, outline points and readings.

Odd input: bodies that are null, blank or not well formed give nothing; one leading
byte order mark is dropped; an encoding named in the declaration is ignored, since
the body is text already; any namespace, and none, is taken. An xml_id that comes
with several rows is taken once, with the body whose hash is least; a null xml_id is
one more xml_id. Lines outside any TextRegion have a null region_no.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.operators.flatten import children, field, flatten

NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
IS_NUMBER = re.compile(rf"\s*{NUMBER}\s*").fullmatch
IS_POINTS = re.compile(rf"\s*{NUMBER},{NUMBER}(?:\s+{NUMBER},{NUMBER})*\s*").fullmatch
RECORD = "lines array<struct<region_no:int,line_no:int,line_id:string,region_id:string,coords:array<struct<x:double,y:double>>,textequiv:array<struct<idx:string,conf:string,text:string>>>>"
POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
READING = pa.struct([("idx", pa.string()), ("conf", pa.string()), ("text", pa.string())])
LINE = pa.struct([("region_no", pa.int32()), ("line_no", pa.int32()), ("line_id", pa.string()), ("region_id", pa.string()), ("coords", pa.list_(POINT)), ("textequiv", pa.list_(READING))])


class Columns:
    """Growing buffers of the nested record: offsets and leaf values, filled body after body."""

    def __init__(self) -> None:
        self.offset, self.point_offset, self.reading_offset = [0], [0], [0]
        self.line: list[list] = [[], [], [], []]  # region_no, line_no, line_id, region_id
        self.x: list[float] = []
        self.y: list[float] = []
        self.reading: list[list] = [[], [], []]  # index, conf, text

    def points(self, coords: ET.Element) -> None:
        """Adds the points of one Coords, in the notation of an attribute or of Point elements."""
        given = coords.get("points")
        if given and not given.isspace():
            if IS_POINTS(given):
                xy = given.replace(",", " ").split()
                self.x += map(float, xy[::2])
                self.y += map(float, xy[1::2])
            return
        xs, ys = [], []
        for p in coords:
            if p.tag.endswith("Point") and p.tag.rpartition("}")[2] == "Point":
                x, y = p.get("x"), p.get("y")
                if x is None or y is None or not IS_NUMBER(x) or not IS_NUMBER(y):
                    return
                xs.append(float(x))
                ys.append(float(y))
        self.x += xs
        self.y += ys

    def add(self, root: ET.Element) -> None:
        regions = lines = 0
        # Document order by a stack of (element, number of its region, id of its region).
        stack: list[tuple[ET.Element, int | None, str | None]] = [(root, None, None)]
        while stack:
            e, region, region_id = stack.pop()
            tag = e.tag
            if tag.endswith("TextRegion") and tag.rpartition("}")[2] == "TextRegion":
                region, region_id = regions, e.get("id")
                regions += 1
            elif tag.endswith("TextLine") and tag.rpartition("}")[2] == "TextLine":
                for column, value in zip(self.line, (region, lines, e.get("id"), region_id), strict=True):
                    column.append(value)
                lines += 1
                for c in e:
                    name = c.tag.rpartition("}")[2]
                    if name == "Coords":
                        self.points(c)
                    elif name == "TextEquiv":
                        text = {u.tag.rpartition("}")[2]: u.text or "" for u in reversed(c)}
                        for column, value in zip(self.reading, (c.get("index"), c.get("conf"), text.get("Unicode", text.get("PlainText"))), strict=True):
                            column.append(value)
                self.point_offset.append(len(self.x))
                self.reading_offset.append(len(self.reading[0]))
            if len(e):
                stack += [(c, region, region_id) for c in reversed(e)]

    def body(self, text: str | None) -> None:
        if text and not text.isspace():
            try:
                # A body counts as a whole or not at all: it is parsed before any buffer grows.
                self.add(ET.fromstring(text.removeprefix("﻿")))
            except ET.ParseError:
                pass
        self.offset.append(len(self.line[0]))

    def array(self) -> pa.Array:
        i32 = lambda v: pa.array(v, pa.int32())
        string = lambda v: pa.array(v, pa.string())
        points = pa.ListArray.from_arrays(i32(self.point_offset), pa.StructArray.from_arrays([pa.array(self.x, pa.float64()), pa.array(self.y, pa.float64())], fields=list(POINT)))
        readings = pa.ListArray.from_arrays(i32(self.reading_offset), pa.StructArray.from_arrays([string(c) for c in self.reading], fields=list(READING)))
        line = pa.StructArray.from_arrays([i32(self.line[0]), i32(self.line[1]), string(self.line[2]), string(self.line[3]), points, readings], fields=list(LINE))
        return pa.ListArray.from_arrays(i32(self.offset), line)


def records(pages: DataFrame, id_column: str = "xml_id", body_column: str = "body") -> DataFrame:
    """``(xml_id, lines ARRAY<STRUCT<...>>)``: the nested record of each xml_id, once.

    Bodies are parsed where they are read; only the far smaller records are shuffled
    to drop the repeated ones.
    """
    kind = pages.schema[id_column].dataType

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):  # bodies may be long; few at a time
                part = b.slice(at, 64)
                c = Columns()
                for text in part.column(2).to_pylist():
                    c.body(text)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), c.array()], names=["xml_id", "h", "lines"])

    nested = pages.select(F.col(id_column).alias("xml_id"), F.xxhash64(body_column).alias("h"), F.col(body_column)).where(F.col(body_column).isNotNull()).mapInArrow(parse, f"xml_id {kind.simpleString()}, h bigint, {RECORD}")
    return nested.where("size(lines) > 0").groupBy("xml_id").agg(F.min_by("lines", "h").alias("lines"))


def keys(nested: DataFrame) -> DataFrame:
    """``(xml_id, region_no, line_no, child, child_no)``: the keys of the rows of all three tables, in one pass over the records."""
    kind = nested.schema["xml_id"].dataType

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            top, line = children({"xml_id": b.column("xml_id")}, b.column("lines"), "at")
            top |= {"region_no": field(line, "region_no"), "line_no": field(line, "line_no")}
            del top["at"]
            parts = [("line", top | {"child_no": pa.array(np.zeros(len(line)), pa.int32())})]
            parts += [(name, children(top, field(line, name), "child_no")[0]) for name in ("coords", "textequiv")]
            for name, t in parts:
                yield pa.RecordBatch.from_pydict({"xml_id": t["xml_id"], "region_no": t["region_no"], "line_no": t["line_no"], "child": pa.array(np.full(len(t["xml_id"]), name), pa.string()), "child_no": t["child_no"]})

    return nested.mapInArrow(go, f"xml_id {kind.simpleString()}, region_no int, line_no int, child string, child_no int")


def lines(nested: DataFrame) -> DataFrame:
    """One row a TextLine: ``(xml_id, at, region_no, line_no, line_id, region_id)``."""
    return flatten(nested, ["xml_id"], [("lines", "at")], {x: x for x in ("region_no", "line_no", "line_id", "region_id")}).drop("at")


def points(nested: DataFrame) -> DataFrame:
    """One row an outline point: ``(xml_id, line_no, point_no, x, y)``."""
    return flatten(nested, ["xml_id"], [("lines", "line_no"), ("coords", "point_no")], {"x": "x", "y": "y"})


def readings(nested: DataFrame) -> DataFrame:
    """One row a reading: ``(xml_id, line_no, reading_no, idx, conf, text)``."""
    return flatten(nested, ["xml_id"], [("lines", "line_no"), ("textequiv", "reading_no")], {"idx": "idx", "conf": "conf", "text": "text"})
