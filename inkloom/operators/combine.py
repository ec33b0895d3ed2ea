"""Combining several readings of a line: alignment to a pivot and weighted votes, choice among views, boards.

Votes: the first hypothesis is the pivot; each of the others is aligned to it. At the
pivot's places the string with most weight stands, the pivot's on a tie; what is inserted
between them stands only if more than half of all weight asks for it. Of equally short
alignments the one that keeps or replaces is taken before one that deletes, and that
before one that inserts. Null hypotheses count as empty; no hypotheses give the empty text.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band(a: str, b: str, head: int) -> tuple[list[list[int]], int]:
    """The edit distances of the beginnings of two texts next to the diagonal, from the row ``head`` on, and how far from it they reach.

    The first ``head`` characters are equal, so up to there a distance is the difference of lengths. Cells further away than
    the distance are on no shortest path; the band is doubled until it is as wide as the distance.
    """
    n, m = len(a), len(b)
    d = max(1, abs(n - m))
    while True:
        far = n + m + 1
        rows = [[abs(head - j) for j in range(max(0, head - d), min(m, head + d) + 1)]]
        for i in range(head + 1, n + 1):
            lo, hi = max(0, i - d), min(m, i + d)
            last, shift, x = rows[-1], max(0, i - 1 - d), a[i - 1]
            row = []
            for j in range(lo, hi + 1):
                k = j - shift
                up = last[k] + 1 if k < len(last) else far
                left = row[-1] + 1 if row else far
                over = last[k - 1] + (x != b[j - 1]) if j and k else far
                row.append(min(up, left, over))
            rows.append(row)
        if rows[-1][m - max(0, n - d)] <= d:
            return rows, d
        d *= 2


def align(pivot: str, other: str) -> tuple[list[str], list[str]]:
    """What the other has at each character of the pivot ('' if nothing), and what it inserts before each and at the end.

    The way back through the distances begins at the ends, so what may stand in several places stands in the foremost,
    whatever else differs; equal ends belong together in any case and are left out first.
    """
    tail = 0
    while tail < min(len(pivot), len(other)) and pivot[-1 - tail] == other[-1 - tail]:
        tail += 1
    n, m = len(pivot) - tail, len(other) - tail
    if abs(n - m) < 2 and pivot[: min(n, m, max(n, m) - 1)] == other[: min(n, m, max(n, m) - 1)]:  # one character at most
        at, inserts = list(pivot), [""] * (len(pivot) + 1)
        if m > n:
            inserts[n] = other[n]
        elif n:
            at[n - 1] = other[n - 1] if n == m else ""
        return at, inserts
    at, inserts, i, j = [""] * n + list(pivot[n:]), [""] * (len(pivot) + 1), n, m
    head = next((k for k in range(min(n, m)) if pivot[k] != other[k]), min(n, m))
    rows, d = band(pivot[:n], other[:m], head) if n and m else ([], 0)

    def cost(i: int, j: int) -> int:
        if i <= head:
            return abs(i - j)
        return rows[i - head][j - max(0, i - d)] if abs(i - j) <= d else n + m + 1

    while i and j:
        here = cost(i, j)
        if here == cost(i - 1, j - 1) + (pivot[i - 1] != other[j - 1]):
            i, j = i - 1, j - 1
            at[i] = other[j]
        elif here == cost(i - 1, j) + 1:
            i -= 1
        else:
            j -= 1
            inserts[i] = other[j] + inserts[i]
    inserts[i] = other[:j] + inserts[i]
    return at, inserts


def vote(texts: list[str], weights: list[float] | None = None) -> str:
    """One text from several by weighted votes on an alignment to the first."""
    texts = [t or "" for t in texts]
    weights = [1.0] * len(texts) if weights is None else list(weights)
    if len(weights) != len(texts):
        raise ValueError("as many weights as texts are needed")
    if not texts or all(t == texts[0] for t in texts):
        return texts[0] if texts else ""
    pivot, half = texts[0], math.fsum(weights) / 2
    # Only what differs from the pivot is kept of each text: by place, in the order of the texts.
    other: dict[int, list[tuple[str, int]]] = {}
    added: dict[int, list[tuple[str, int]]] = {}
    for no, t in enumerate(texts):
        if t != pivot:
            at, inserts = align(pivot, t)
            for k, (x, y) in enumerate(zip(at, pivot, strict=True)):
                if x != y:
                    other.setdefault(k, []).append((x, no))
            for k, x in enumerate(inserts):
                if x:
                    added.setdefault(k, []).append((x, no))

    def heaviest(options: list[tuple[str, int]]) -> tuple[float, str]:
        weight: dict[str, float] = {}
        for o, no in options:
            weight[o] = weight.get(o, 0.0) + weights[no]
        best = max(weight, key=weight.__getitem__)  # the first of equals
        return weight[best], best

    out = [*pivot, ""]
    for k, options in other.items():
        weight, said = heaviest(options)
        unlike = {no for _, no in options}
        if weight > sum(w for no, w in enumerate(weights) if no not in unlike):  # the pivot's character wins a tie
            out[k] = said
    for k, options in added.items():
        weight, said = heaviest(options)
        if weight > half:
            out[k] = said + out[k]
    return "".join(out)


def voted(texts: Column, weights: list[float] | None = None) -> Column:
    """The vote over an array of hypotheses; weights beyond the array's length are not used."""

    @F.pandas_udf("string")
    def go(s: pd.Series) -> pd.Series:
        return pd.Series([vote(list(t), weights[: len(t)] if weights else None) if t is not None else "" for t in s], dtype=object)

    return go(texts)


def choose_view(views: DataFrame, key: list[str], score: str, order: str, text: str) -> DataFrame:
    """The text of the best-scored view of each key, the earliest on a tie; blank texts never win, and only blank ones give ''."""
    said = F.coalesce(F.trim(F.col(text)), F.lit("")) != ""
    best = F.max_by(F.when(said, F.struct(F.col(text).alias("text"), F.col(order).alias("view"))), F.when(said, F.struct(F.col(score), -F.col(order))))
    return views.groupBy(*key).agg(best.alias("b")).select(*key, F.coalesce("b.text", F.lit("")).alias("text"), F.col("b.view").alias("view"))


#: Entries that a board may have; it goes into the plan as a literal.
MOST_ENTRIES = 10_000


def entries(board: DataFrame, *columns: str) -> list:
    """The rows of a board, a short published list; more of them than ``MOST_ENTRIES`` are an error."""
    rows = board.select(*columns).limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"a board has at most {MOST_ENTRIES} entries")
    return rows


def rank_in(reports: DataFrame, value: str, board: DataFrame, board_value: str) -> DataFrame:
    """The reports with ``rank``: one more than the board's entries with a smaller value. Null values of a board count for nothing."""
    values = F.array(*(F.lit(float(r[0])) for r in entries(board, board_value) if r[0] is not None)).cast("array<double>")
    return reports.withColumn("rank", F.size(F.filter(values, lambda x: x < F.col(value))) + 1)


def nearest_in(reports: DataFrame, value: str, board: DataFrame, name: str, board_value: str, order: str) -> DataFrame:
    """The reports with ``nearest``: the board's entry of least difference, the first of equals."""
    rows = sorted((r for r in entries(board, board_value, order, name) if r[0] is not None), key=lambda r: r[1])
    each = [F.struct(F.abs(F.lit(float(v)) - F.col(value)).alias("d"), F.lit(i).alias("o"), F.lit(m).alias("m")) for i, (v, _, m) in enumerate(rows)]
    return reports.withColumn("nearest", F.array_min(F.array(*each))["m"] if each else F.lit(None).cast("string"))
