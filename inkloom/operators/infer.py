"""The boundary to a recognizer: any function from a batch of inputs to texts, run in Arrow batches next to the data.

Rows are sorted by width, or by width at one height, within partitions first, so that a batch holds inputs of about
one size; a batch that fails gives empty texts, as a failed reading does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.operators.combine import vote
from inkloom.operators.geometry import transcript
from inkloom.operators.image import page_lines


def read(df: DataFrame, key: str, content: str, reader: Callable[[list], list[str]], width: str | None = None, batch: int = 64, height: str | None = None) -> DataFrame:
    """``(key, text)`` from a reader that is sent to the workers once; with a height, inputs are sorted by their width at one height."""
    kind = df.schema[key].dataType.simpleString()

    def go(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                try:
                    texts = list(reader(part[content].tolist()))
                except Exception:  # noqa: BLE001 - a reading that fails is an empty one
                    texts = [""] * len(part)
                yield pd.DataFrame({key: part[key], "text": texts})

    by = F.col(width) / F.greatest(F.col(height), F.lit(1)) if width and height else F.col(width) if width else None
    ordered = df if by is None else df.sortWithinPartitions(by)
    return ordered.select(key, content).mapInPandas(go, f"{key} {kind}, text string")


Read = Callable[[list[np.ndarray]], list[tuple[str, float]]]


def read_pages(pages: DataFrame, key: str, content: str, members: list[Read], weights: list[float] | None = None, batch: int = 64) -> DataFrame:
    """``(key, line_no, x, y, w, h, skew, text, confidence)``: the lines of pages in reading order, each with its text and confidence.

    Pages are cut into lines once; with several members each line's text is their vote and the confidence the first one's.
    A member that fails on a batch gives empty texts of confidence 0 there.
    """
    lines = page_lines(pages, key, content)
    kind = lines.schema[key].dataType.simpleString()

    def said(member: Read, crops: list[np.ndarray]) -> list[tuple[str, float]]:
        try:
            return list(member(crops))
        except Exception:  # noqa: BLE001 - a reading that fails is an empty one
            return [("", 0.0)] * len(crops)

    def go(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                crops = [np.frombuffer(p, np.uint8).reshape(h, w) for p, h, w in zip(part.pixels, part.height, part.width, strict=True)]
                each = [said(m, crops) for m in members]
                texts = [vote([e[i][0] for e in each], weights) for i in range(len(crops))]
                yield part[[key, "line_no", "x", "y", "w", "h", "skew"]].assign(text=texts, confidence=[float(c) for _, c in each[0]])

    return lines.mapInPandas(go, f"{key} {kind}, line_no int, x int, y int, w int, h int, skew double, text string, confidence double")


def page_texts(records: DataFrame, key: str, least: float = 0.0) -> DataFrame:
    """``(key, transcript, n_lines)`` of the non-blank lines read with at least a confidence."""
    return transcript(records, key, "line_no", "text", F.col("confidence") >= least)
