"""Boxes of lines on pages: overlap recall, filters, merging, reading order, transcripts.

Boxes are columns ``x, y, w, h``. Rules that depend on the order in which boxes were
joined run page by page in Arrow batches; a page's boxes fit into one task by far.
Null coordinates make a box useless and it is left out; pages without boxes give no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corners(c: Column) -> Column:
    """``(x0, y0, x1, y1)`` of a struct ``x, y, w, h``."""
    return F.struct(c["x"].alias("x0"), c["y"].alias("y0"), (c["x"] + c["w"]).alias("x1"), (c["y"] + c["h"]).alias("y1"))


def overlap(g: str, d: str) -> Column:
    """The part of box g's area that box d covers (names of struct columns)."""
    c = F.col
    wide = F.least(c(f"{g}.x") + c(f"{g}.w"), c(f"{d}.x") + c(f"{d}.w")) - F.greatest(c(f"{g}.x"), c(f"{d}.x"))
    high = F.least(c(f"{g}.y") + c(f"{g}.h"), c(f"{d}.y") + c(f"{d}.h")) - F.greatest(c(f"{g}.y"), c(f"{d}.y"))
    area = c(f"{g}.w") * c(f"{g}.h")
    # least and greatest skip nulls, so a missing box is asked for
    return F.when(c(d).isNotNull() & (wide > 0) & (high > 0) & (area > 0), wide * high / area).otherwise(0.0)


def cells(box: str, size: int) -> Column:
    """The cells of a grid that a box touches, one row each; a box without extent touches that of its corner."""
    along = lambda c, n: F.sequence(F.floor(F.col(f"{box}.{c}") / size), F.floor((F.col(f"{box}.{c}") + F.greatest(F.col(f"{box}.{n}"), F.lit(1)) - 1) / size))
    return F.explode_outer(F.flatten(F.transform(along("x", "w"), lambda i: F.transform(along("y", "h"), lambda j: F.struct(i.alias("i"), j.alias("j"))))))


def recall(gold: DataFrame, found: DataFrame, page: str, key: str, least: float = 0.5, cell: int = 512) -> DataFrame:
    """``(page, n_gold, n_hit)`` of each page and of all (page null): gold boxes of which one found box covers at least a part.

    Boxes are joined by the cells of a grid that they touch, so that a page of any number of boxes is spread over tasks; of
    each gold box its best cover is kept, in one aggregate, for which it doesn't matter that a pair may meet in several cells.
    """
    box = F.struct("x", "y", "w", "h")
    g = gold.select(page, key, box.alias("_g")).withColumn("_c", cells("_g", cell))
    d = found.dropna(subset=["x", "y", "w", "h"]).select(F.col(page).alias("_page"), box.alias("_d")).withColumn("_e", cells("_d", cell))
    meet = [F.col(f"{a}.{c}") < F.col(f"{b}.{c}") + F.col(f"{b}.{n}") for c, n in (("x", "w"), ("y", "h")) for a, b in (("_g", "_d"), ("_d", "_g"))]
    pairs = g.join(d, [F.col(page) == F.col("_page"), F.col("_c.i") == F.col("_e.i"), F.col("_c.j") == F.col("_e.j"), *meet], "left")
    best = pairs.groupBy(page, key).agg(F.max(F.coalesce(overlap("_g", "_d"), F.lit(0.0))).alias("part"))
    return best.rollup(page).agg(F.count(F.lit(1)).alias("n_gold"), F.count_if(F.col("part") >= least).alias("n_hit"))


def plausible(pitch: Column) -> Column:
    """Whether a box can be a line of text at a line pitch."""
    w, h = F.col("w"), F.col("h")
    return (w >= 0.8 * pitch) & (h >= 0.25 * pitch) & (h <= 12 * pitch) & (w * h >= 0.12 * pitch * pitch)


def join_boxes(boxes: list[tuple[int, int, int, int]], pitch: float) -> list[tuple[int, int, int, int]]:
    """Boxes in order of y and x; each is joined to the first earlier one that shares more than half of the lower height
    and is less than 1.2 pitches away."""
    out: list[list[int]] = []
    for x, y, w, h in sorted(boxes, key=lambda b: (b[1], b[0], b[2], b[3])):
        for o in out:
            common = min(y + h, o[1] + o[3]) - max(y, o[1])
            gap = max(x, o[0]) - min(x + w, o[0] + o[2])
            if common > 0.5 * min(h, o[3]) and gap < 1.2 * pitch:
                right, low = max(x + w, o[0] + o[2]), max(y + h, o[1] + o[3])
                o[0], o[1] = min(x, o[0]), min(y, o[1])
                o[2], o[3] = right - o[0], low - o[1]
                break
        else:
            out.append([x, y, w, h])
    return [tuple(o) for o in out]


def order_boxes(boxes: list[tuple[int, int, int, int]], pitch: float) -> list[tuple[int, tuple[int, int, int, int]]]:
    """(row, box) in reading order: a row holds the boxes whose centres are within 0.45 pitches of the row's mean so far;
    rows run down the page, boxes from right to left."""
    rows: list[list[tuple[int, int, int, int]]] = []
    total = 0.0
    for b in sorted(boxes, key=lambda b: (b[1] + b[3] / 2, b)):
        centre = b[1] + b[3] / 2
        if rows and abs(centre - total / len(rows[-1])) < 0.45 * pitch:
            rows[-1].append(b)
            total += centre
        else:
            rows.append([b])
            total = centre
    return [(r, b) for r, row in enumerate(rows) for b in sorted(row, key=lambda b: -(b[0] + b[2]))]


def _by_page(boxes: DataFrame, page: str, schema: str, go) -> DataFrame:
    kind = boxes.schema[page].dataType.simpleString()
    good = boxes.select(page, "x", "y", "w", "h").dropna()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = go([tuple(map(int, b)) for b in zip(pdf.x, pdf.y, pdf.w, pdf.h, strict=True)])
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
        out.insert(0, page, pdf[page].iloc[0])
        return out

    return good.groupBy(page).applyInPandas(run, f"{page} {kind}, {schema}")


def merged(boxes: DataFrame, page: str, pitch: float) -> DataFrame:
    """The joined boxes of each page."""
    return _by_page(boxes, page, "box_no int, x int, y int, w int, h int", lambda b: [(i, *o) for i, o in enumerate(join_boxes(b, pitch))])


def reading_order(boxes: DataFrame, page: str, pitch: float) -> DataFrame:
    """The boxes of each page with their row and place in reading order."""
    return _by_page(boxes, page, "place int, row_no int, x int, y int, w int, h int", lambda b: [(i, r, *o) for i, (r, o) in enumerate(order_boxes(b, pitch))])


def rescaled(c: str, factor: float) -> Column:
    return (F.col(c) * factor).cast("int")


def transcript(lines: DataFrame, page: str, order: str, text: str, keep: Column | None = None) -> DataFrame:
    """The non-blank lines of each page, one under the other."""
    good = F.trim(F.coalesce(F.col(text), F.lit(""))) != ""
    kept = lines.where(good if keep is None else good & keep)
    pieces = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return kept.groupBy(page).agg(F.array_join(F.transform(pieces, lambda p: p["t"]), "\n").alias("transcript"), F.count(F.lit(1)).cast("bigint").alias("n_lines"))


def polygon(points: Column) -> Column:
    """The points of "x,y x,y" or "x y x y"; null for fewer than three points or anything that is no number."""
    n = F.transform(F.filter(F.split(F.trim(points), r"[\s,]+"), lambda p: p != ""), lambda p: p.try_cast("double"))
    xy = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / 2).cast("int") - 1), lambda i: F.struct(F.get(n, i * 2).alias("x"), F.get(n, i * 2 + 1).alias("y")))
    return F.when((F.size(n) >= 6) & (F.size(n) % 2 == 0) & ~F.exists(n, lambda v: v.isNull()), xy)
