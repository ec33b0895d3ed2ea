"""Sources: lines, catalogues, capped multi-source scans, XML exports, image headers, logs.

A source that can't be read is skipped and named; caps take rows in a seeded order, not
as they come. Nothing here reads a file on the driver but lists of a few names.
"""

from __future__ import annotations

import io
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def seeded(seed: int, key: Column) -> Column:
    """A random but repeatable order of a key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def number(seed: int, key: Column) -> Column:
    """A random but repeatable number of 60 bits for a key."""
    return F.conv(F.substring(seeded(seed, key), 1, 15), 16, 10).cast("bigint")


#: The same in SQL, of a seed and an expression.
SQL_NUMBER = "('0x' || substr(md5('{0}:' || {1}), 1, 15))::bigint"


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in seeded order, without replacement: the sampling operator's own limit."""
    return df.orderBy(seeded(seed, F.col(key)), key).limit(n)


def resample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n draws with replacement: draw d takes the row whose number is hash(seed, d) modulo the rows. Numbers are given by
    the seeded order within 256 parts, so no task orders all rows."""
    parts = df.withColumn("part", (number(0, F.col(key)) % 256).cast("int"))
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = sizes.agg(F.sum("n").alias("total"))
    rows = parts.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(seeded(seed, F.col(key)), key)) - 1).join(F.broadcast(sizes.select("part", "first")), "part").withColumn("no", F.col("first") + F.col("r")).drop("part", "first", "r")
    draws = df.sparkSession.range(n).crossJoin(F.broadcast(total)).select(F.col("id").alias("draw"), F.pmod(number(seed, F.col("id")), F.col("total")).alias("no"))
    return draws.join(rows, "no").drop("no")


def capped(sources: DataFrame, source: str, key: str, caps: dict[str, int], default: int, seed: int = 0) -> DataFrame:
    """At most so many rows of each source, in seeded order."""
    cap = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in caps.items() for x in kv)), F.col(source)), F.lit(default)) if caps else F.lit(default)
    rank = F.row_number().over(Window.partitionBy(source).orderBy(seeded(seed, F.col(key)), key))
    # The largest cap is a literal, by which every task drops most rows of a large source before the shuffle.
    return sources.withColumn("rank", rank).where(F.col("rank") <= max([default, *caps.values()])).where(F.col("rank") <= cap)


def readable(spark: SparkSession, paths: dict[str, str], read: Callable[[SparkSession, str], DataFrame]) -> tuple[dict[str, DataFrame], list[str]]:
    """The tables that can be read, and the names of those that can't."""
    good, bad = {}, []
    for name, path in paths.items():
        try:
            good[name] = read(spark, path)
        except AnalysisException:
            bad.append(name)
    return good, bad


def union(tables: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """All tables under one another, with their name and their place among the sources."""
    parts = [df.select(*columns, F.lit(name).alias("source_name"), F.lit(i).alias("source_no")) for i, (name, df) in enumerate(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def catalogue(spark: SparkSession, path: str, column: str = "test/train") -> DataFrame:
    """``(page, split)`` of a tab-separated catalogue with a header row."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    return df.select(F.col(f"`{df.columns[0]}`").alias("page"), F.lower(F.col(f"`{column}`")).alias("split"))


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """The non-blank lines of a list file."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''").distinct()


def text_lines(spark: SparkSession, path: str, budget: int | None = None) -> DataFrame:
    """``(file, line_no, text)`` of the non-blank lines of text files, numbered within their file; with a budget of characters the lines up to the one that crosses it.

    Spark reads a file's lines in order within a split, so they are numbered by their place in the file.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), F.trim("value").alias("text")).where("text <> ''")
    out = lines.withColumn("line_no", (F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1).cast("bigint")).drop("at")
    if budget is None:
        return out
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    sized = out.withColumn("n", F.length("text").cast("bigint"))
    files = sized.groupBy("file").agg(F.sum("n").alias("s"))
    before = files.withColumn("first", F.coalesce(F.sum("s").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("first") < budget)
    inside = sized.join(before.select("file", "first"), "file").withColumn("so_far", F.col("first") + F.coalesce(F.sum("n").over(w), F.lit(0)))
    return inside.where(F.col("so_far") < budget).select("file", "line_no", "text")


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content)`` of the files of a folder that image names end in, as they are; nothing is decoded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(F.lower(F.col("path")).rlike(r"[.](png|jpe?g|gif|bmp|tiff?)$")).select("path", "content")


def archive_entries(archives: DataFrame, key: str, content: str, suffix: str = "") -> DataFrame:
    """``(key, entry, content)`` of the files in zip archives, in the order of their names; entries of other suffixes aren't unpacked.

    An archive is one value, so a task holds one archive and one entry at a time. What is no archive, and entries that can't
    be unpacked, give no rows; folders are no entries.
    """
    kind = archives.schema[key].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data in enumerate(b.column(1)):
                try:
                    z = zipfile.ZipFile(io.BytesIO(data.as_py() or b""))
                except zipfile.BadZipFile:
                    continue
                for name in sorted(n for n in z.namelist() if n.endswith(suffix) and not n.endswith("/")):
                    try:
                        yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([name], pa.string()), pa.array([z.read(name)], pa.binary())], names=["key", "entry", "content"])
                    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, zlib.error):
                        continue

    return archives.select(key, content).where(F.col(content).isNotNull()).mapInArrow(go, f"key {kind}, entry string, content binary").withColumnRenamed("key", key)


def archived(files: DataFrame, archive: str, name: str, content: str) -> DataFrame:
    """``(archive, content)``: the files of each archive as a zip, in the order of their names; an archive fits into one task."""
    kind = files.schema[archive].dataType.simpleString()

    def go(table: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n, c in sorted(zip(table.column("name").to_pylist(), table.column("content").to_pylist(), strict=True)):
                z.writestr(zipfile.ZipInfo(n), c)
        return pa.table({"archive": table.column("archive").slice(0, 1), "content": pa.array([out.getvalue()], pa.binary())})

    rows = files.select(F.col(archive).alias("archive"), F.col(name).alias("name"), F.col(content).cast("binary").alias("content")).dropna()
    return rows.groupBy("archive").applyInArrow(go, f"archive {kind}, content binary").withColumnRenamed("archive", archive)


@dataclass(frozen=True)
class Registered:
    """A source of a registry: where it is read from, the most rows taken of it, and whether "all" means it too."""

    read: Callable[[], DataFrame]
    cap: int | None = None
    in_all: bool = True


def chosen_sources(registry: dict[str, Registered], wanted: str | list[str] | None) -> list[str]:
    """The names asked for, in the registry's order: none for null, "" and "none", those meant by "all", else a list or names between commas; an unknown one is an error."""
    if wanted is None or wanted in ("", "none"):
        return []
    if wanted == "all":
        return [n for n, r in registry.items() if r.in_all]
    names = [n.strip() for n in wanted.split(",")] if isinstance(wanted, str) else list(wanted)
    if unknown := sorted(set(names) - set(registry)):
        raise ValueError(f"unknown sources: {', '.join(unknown)}; there are {', '.join(registry)}")
    return [n for n in registry if n in names]


def composite(registry: dict[str, Registered], wanted: str | list[str] | None, columns: list[str], key: str, seed: int = 0, limit: int | None = None) -> DataFrame | None:
    """The rows of the chosen sources under one another, each capped in seeded order, with ``source_name``, ``source_no`` and ``rank``; sources that can't be read are left out.

    ``limit`` keeps the first rows over all sources, in the order of sources and ranks. None if there is nothing to read.
    """
    parts: dict[str, DataFrame] = {}
    for name in chosen_sources(registry, wanted):
        try:
            rows = registry[name].read().select(*columns)
        except AnalysisException:
            continue
        cap = registry[name].cap
        order = Window.orderBy(seeded(seed, F.col(key)), key)
        # a cap is a top-k, which tasks do before one of them merges; without one, ranks are numbers in seeded order
        rows = rows.orderBy(seeded(seed, F.col(key)), key).limit(cap) if cap is not None else rows
        parts[name] = rows.withColumn("rank", F.row_number().over(order)) if cap is not None else rows.withColumn("rank", F.lit(None).cast("int"))
    if not parts:
        return None
    out = union(parts, [*columns, "rank"])
    return out if limit is None else out.orderBy("source_no", F.col("rank").asc_nulls_last(), seeded(seed, F.col(key)), key).limit(limit)


def quality_gate(df: DataFrame, column: str, most: float | None) -> DataFrame:
    """The rows whose measure is at most a bound (null measures aren't); all rows without a bound or without the column."""
    return df if most is None or column not in df.columns else df.where(F.col(column) <= most)


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)$", 1)


def stem(c: Column) -> Column:
    return F.regexp_replace(base_name(c), r"\.[^.]*$", "")


def json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of one JSON object a line; no rows for a missing file."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def corpus_lines(texts: DataFrame, order: str, column: str, budget: int) -> DataFrame:
    """The rows in order until the characters reach the budget; the row that crosses it is the last.

    Lengths are first summed by ranges of rows, so only the range where the budget ends is gone through row by row.
    """
    sized = texts.withColumn("len", F.length(column).cast("bigint")).where("len is not null")
    parts = sized.withColumn("part", F.floor(F.col(order) / 1024))
    sums = parts.groupBy("part").agg(F.sum("len").alias("s")).withColumn("block", F.floor(F.col("part") / 1024))
    before = lambda w: F.coalesce(F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One task sums blocks of about a million rows each; ranges are summed within their block.
    blocks = sums.groupBy("block").agg(F.sum("s").alias("s")).select("block", before(Window.orderBy("block")).alias("first")).where(F.col("first") < budget)
    sums = sums.join(blocks, "block").select("part", (F.col("first") + before(Window.partitionBy("block").orderBy("part"))).alias("before"))
    inside = parts.join(sums.where(F.col("before") < budget), "part")
    so_far = F.coalesce(F.sum("len").over(Window.partitionBy("part").orderBy(order, column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return inside.withColumn("so_far", F.col("before") + so_far).where(F.col("so_far") < budget).drop("part", "before")


ALTO = "struct<line_no:int,points:array<struct<x:double,y:double>>,text:string>"


def alto_lines(files: DataFrame, key: str, body: str) -> DataFrame:
    """``(key, line_no, points, text)`` of ALTO exports: the polygon of a line, else its rectangle; bodies that aren't well formed give nothing."""
    kind = files.schema[key].dataType.simpleString()
    number = lambda v: float(v) if v not in (None, "") else None

    def one(text: str | None) -> list[dict]:
        if not text or text.isspace():
            return []
        try:
            root = ET.fromstring(text.removeprefix("﻿"))
        except ET.ParseError:
            return []
        out = []
        for e in root.iter():
            if e.tag.rpartition("}")[2] != "TextLine":
                continue
            words = [s.get("CONTENT") or "" for s in e.iter() if s.tag.rpartition("}")[2] == "String"]
            shape = next((p.get("POINTS") for p in e.iter() if p.tag.rpartition("}")[2] == "Polygon"), None)
            try:
                if shape:
                    v = list(map(float, shape.replace(",", " ").split()))
                    points = [{"x": a, "y": b} for a, b in zip(v[::2], v[1::2], strict=True)]
                else:
                    x, y, w, h = (number(e.get(k)) for k in ("HPOS", "VPOS", "WIDTH", "HEIGHT"))
                    points = [{"x": x, "y": y}, {"x": x + w, "y": y}, {"x": x + w, "y": y + h}, {"x": x, "y": y + h}]
            except (TypeError, ValueError):
                points = []
            out.append({"line_no": len(out), "points": points, "text": " ".join(w for w in words if w)})
        return out

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("line_no", pa.int32()), ("points", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), ("text", pa.string())]))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(t) for t in b.column(1).to_pylist()], shape)], names=["key", "lines"])

    parsed = files.select(key, body).mapInArrow(go, f"key {kind}, lines array<{ALTO}>")
    return parsed.select(F.col("key").alias(key), F.explode("lines").alias("l")).select(key, "l.*")


def image_size(content: bytes | None) -> tuple[int, int] | None:
    """(width, height) from the header of a PNG, GIF, BMP or JPEG; pixels aren't decoded."""
    if not content or len(content) < 10:
        return None
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return struct.unpack(">II", content[16:24])
    if content[:6] in (b"GIF87a", b"GIF89a"):
        return struct.unpack("<HH", content[6:10])
    if content[:2] == b"BM" and len(content) >= 26:
        w, h = struct.unpack("<ii", content[18:26])
        return w, abs(h)
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(content) and content[at] == 0xFF:
            marker = content[at + 1]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", content[at + 5 : at + 9])
                return w, h
            at += 2 + int.from_bytes(content[at + 2 : at + 4], "big")
    return None


def image_sizes(images: DataFrame, key: str, content: str) -> DataFrame:
    """``(key, width, height)``; null for what isn't an image."""
    kind = images.schema[key].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [image_size(c.as_py()) for c in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([None if s is None else s[i] for s in sizes], pa.int32()) for i in (0, 1))], names=["key", "width", "height"])

    return images.select(key, content).mapInArrow(go, f"key {kind}, width int, height int").withColumnRenamed("key", key)


def not_for_training(split: str) -> None:
    """Guards held-out data: always raises."""
    raise ValueError(f"{split} is held out for scoring and can't be trained on")
