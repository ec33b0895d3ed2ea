"""Batches under a budget, joined lines, and widths.

Packing is a fold over rows sorted by width, run pool by pool: a pool holds so many
rows, so no task sees more. Null widths are left out; a row wider than the budget is a
batch of its own.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.sources.readers import number

POOL = 4096


def pack(widths: list[int], budget: int, most: int) -> list[int]:
    """The batch number of each of the ascending widths: rows times the widest stay within the budget, and ``most`` rows at most."""
    out, batch, n = [], 0, 0
    for w in widths:
        if n and ((n + 1) * w > budget or n >= most):
            batch, n = batch + 1, 0
        out.append(batch)
        n += 1
    return out


def budget_batches(rows: DataFrame, key: str, width: str, budget: int, most: int = 64, pool: int = POOL, seed: int = 0) -> DataFrame:
    """``(key, width, pool_no, batch_no)``: rows fall into pools by a seeded hash, of ``pool`` rows on average."""
    good = rows.select(F.col(key).alias("k"), F.col(width).cast("bigint").alias("w")).where("w is not null")
    pools = max(1, -(-good.count() // pool))
    kind = good.schema["k"].dataType.simpleString()

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["w", "k"], kind="stable")
        return pdf.assign(batch_no=pack(pdf.w.tolist(), budget, most))[["k", "w", "pool_no", "batch_no"]]

    salted = good.withColumn("pool_no", (number(seed, F.col("k")) % pools).cast("int"))
    return salted.groupBy("pool_no").applyInPandas(go, f"k {kind}, w bigint, pool_no int, batch_no int").withColumnsRenamed({"k": key, "w": width})


def scaled_width(w: Column, h: Column, height: int = 64, least: int = 16, most: int = 2560) -> Column:
    """The width at a height, rounded half to even and kept within limits."""
    return F.least(F.greatest(F.bround(w * height / F.greatest(h, F.lit(1)), 0), F.lit(least)), F.lit(most)).cast("int")


def steps(width: Column, stride: int = 4) -> Column:
    """Frames that a width gives."""
    return F.greatest(F.lit(1), F.floor(width / stride)).cast("int")


def joined_lines(lines: DataFrame, group: str, order: str, text: str, width: str, gap: int = 24, most: int = 1792) -> DataFrame:
    """``(group, text, width, n_lines)``: lines joined while the running width with gaps stays within the limit; the first always stays."""
    w = Window.partitionBy(group).orderBy(order)
    so_far = lines.withColumn("total", F.sum(F.col(width) + F.lit(gap)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - gap).withColumn("no", F.row_number().over(w))
    # Once a line doesn't fit the row ends, so lines after it don't count although they might fit.
    kept = so_far.where((F.col("no") == 1) | (F.col("total") <= most))
    pieces = F.sort_array(F.collect_list(F.struct("no", F.col(text).alias("t"))))
    return kept.groupBy(group).agg(F.array_join(F.transform(pieces, lambda p: p["t"]), " ").alias("text"), F.max("total").cast("bigint").alias("width"), F.count(F.lit(1)).alias("n_lines"))


def joined_rows(lines: DataFrame, group: str, order: str, text: str, width: str, gap: int = 24, most: int = 1792) -> DataFrame:
    """``(group, row_no, text, width, n_lines)``: every line of a group in one row; a new row starts where the width would pass the limit.

    A line wider than the limit is a row of its own. Lines of equal order go by text; null texts count as empty, null widths as 0.
    """

    @F.pandas_udf("array<struct<row_no: int, text: string, width: bigint, n_lines: bigint>>")
    def go(texts: pd.Series, widths: pd.Series) -> pd.Series:
        out = []
        for ts, ws in zip(texts, widths, strict=True):
            rows: list[dict] = []
            for t, w in zip(ts, ws, strict=True):
                if rows and rows[-1]["width"] + gap + w <= most:
                    r = rows[-1]
                    r["text"].append(t)
                    r["width"] += gap + int(w)
                else:
                    rows.append({"row_no": len(rows), "text": [t], "width": int(w)})
            out.append([{**r, "text": " ".join(r["text"]), "n_lines": len(r["text"])} for r in rows])
        return pd.Series(out, dtype=object)

    piece = F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t"), F.coalesce(width, F.lit(0)).cast("bigint").alias("w"))
    pages = lines.groupBy(group).agg(F.sort_array(F.collect_list(piece)).alias("p"))
    return pages.select(group, F.explode(go(F.col("p.t"), F.col("p.w"))).alias("r")).select(group, "r.*")


def estimated_batches(rows: DataFrame, width: str, budget: int, most: int = 64) -> DataFrame:
    """One row: how many batches about the mean width leads to."""
    mean = F.greatest(F.avg(width), F.lit(1.0))
    per = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(budget / mean)))
    return rows.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / per)).cast("bigint").alias("n_batches"), F.round(F.avg(width), 6).alias("mean_width"))


def padded(values: Column, length: Column | int) -> Column:
    """The array filled up with zeros on the right; nothing is cut off a longer one."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(values, F.array_repeat(F.lit(0).cast("int"), F.greatest(F.lit(0), length - F.size(values))))


def density_factor(width: Column, text: Column, target: float, jitter: Column | float = 1.0) -> Column:
    """The factor that brings a line to ``target`` pixels a character: kept within 0.4 and 8, and 1 where it is within 2 % of that; 1 for empty text."""
    now = width / F.nullif(F.length(F.coalesce(text, F.lit(""))), F.lit(0))
    factor = F.least(F.greatest(F.lit(target) / now * jitter, F.lit(0.4)), F.lit(8.0))
    return F.when(now.isNull() | (F.abs(factor - 1) < 0.02), 1.0).otherwise(factor)


def ramp(epoch: Column, epochs: int) -> Column:
    """The strength of distortions by epoch: from about a third to all of it."""
    return 0.33 + 0.67 * F.least(F.lit(1.0), (epoch + 1) / (epochs + 1))


def joined_groups(rows: DataFrame, key: str, width: str, may_join: Column, chance: float, most: int = 3, gap: int = 24, widest: int = 2400, pool: int = POOL, seed: int = 0) -> DataFrame:
    """``(key, group_no, place, group_width)``: rows in seeded order, now and then two or more neighbours as one group.

    Only rows that may be joined start or enter a group; a row that may not ends it. Every
    row is in one group once; a group too wide is its first row alone. Pools run apart.
    """
    good = rows.select(F.col(key).alias("k"), F.col(width).cast("bigint").alias("w"), may_join.alias("ok"), F.xxhash64(F.lit(seed), key).alias("h")).where("w is not null")
    pools = max(1, -(-good.count() // pool))
    kind = good.schema["k"].dataType.simpleString()

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "k"], kind="stable")
        w, ok, h = pdf.w.tolist(), pdf.ok.fillna(False).astype(bool).tolist(), pdf.h.tolist()
        group, place, total, i, g = [], [], [], 0, 0
        while i < len(w):
            n = 1
            if ok[i] and (h[i] & 0xFFFF) / 0x10000 < chance:
                want = 2 + (h[i] >> 16 & 0xFF) % max(1, most - 1)
                while n < want and i + n < len(w) and ok[i + n]:
                    n += 1
                if sum(w[i : i + n]) + gap * (n - 1) > widest:
                    n = 1
            group += [g] * n
            place += range(n)
            total += [sum(w[i : i + n]) + gap * (n - 1)] * n
            i, g = i + n, g + 1
        return pdf.assign(group_no=group, place=place, group_width=total)[["k", "pool_no", "group_no", "place", "group_width"]]

    salted = good.withColumn("pool_no", F.pmod("h", F.lit(pools)).cast("int"))
    return salted.groupBy("pool_no").applyInPandas(go, f"k {kind}, pool_no int, group_no int, place int, group_width bigint").withColumnRenamed("k", key)


def draw(widths: list[int], count: int, budget: int) -> list[int]:
    """Places of up to ``count`` rows, in order, whose number times the widest stays within the budget; rows that don't fit are passed over, but the first row is always taken."""
    out, widest = [], 0
    for i, w in enumerate(widths):
        if len(out) == count:
            break
        if not out or (len(out) + 1) * max(widest, w) <= budget:
            out.append(i)
            widest = max(widest, w)
    return out


def weights(df: DataFrame, group: str, weight: str) -> DataFrame:
    """With each weight as its part of its group's sum."""
    return df.withColumn(weight, F.col(weight) / F.sum(weight).over(Window.partitionBy(group)))
