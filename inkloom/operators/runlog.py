"""Logs of runs: best rows, running hours, verdicts between two arms, stalls, learning rates.

Windows run within one arm or source; nulls in a measure never are the best.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, arm: str, order: str, value: str, into: str) -> DataFrame:
    """With the running sum of a value within each arm."""
    return df.withColumn(into, F.sum(value).over(Window.partitionBy(arm).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def best_so_far(df: DataFrame, arm: str, order: str, value: str) -> DataFrame:
    """The rows that beat all rows of their arm before them."""
    before = F.min(value).over(Window.partitionBy(arm).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("before", before).where(F.col("before").isNull() & F.col(value).isNotNull() | (F.col(value) < F.col("before"))).drop("before")


def verdict(df: DataFrame, arm: str, value: str, cost: str, a: str, b: str) -> DataFrame:
    """One row: each arm's best value, its cost, and b's change against a in per cent."""
    per = lambda x, name: df.where(F.col(arm) == x).agg(F.min(value).alias(f"best_{name}"), F.sum(cost).alias(f"cost_{name}"))
    both = per(a, "a").crossJoin(per(b, "b"))
    change = F.when(F.col("best_a") != 0, 100 * (F.col("best_b") - F.col("best_a")) / F.col("best_a"))
    return both.withColumn("change_pct", change).withColumn("better", F.when(F.col("best_b") < F.col("best_a"), b).otherwise(a))


def stalls(df: DataFrame, key: str, ts: str, gap_s: int) -> DataFrame:
    """``(key, from_ts, to_ts, idle_s)``: gaps of so many seconds or more between rows that follow each other."""
    w = Window.partitionBy(key).orderBy(ts)
    prev = df.select(key, F.col(ts).alias("to_ts"), F.lag(ts).over(w).alias("from_ts"))
    idle = F.unix_micros(F.col("to_ts").cast("timestamp")) - F.unix_micros(F.col("from_ts").cast("timestamp"))
    return prev.withColumn("idle_s", (idle / 1_000_000).cast("bigint")).where(F.col("idle_s") >= gap_s).select(key, "from_ts", "to_ts", "idle_s")


def learning_rate(step: Column, total: int, warm: int, top: float, least: float) -> Column:
    """Linear warm-up, then half a cosine down to the least."""
    done = (step - warm) / max(1, total - warm)
    return F.when(step < warm, top * (step + 1) / warm).otherwise(least + 0.5 * (top - least) * (1 + F.cos(math.pi * F.least(done, F.lit(1.0)))))


def moving_average(df: DataFrame, arm: str, order: str, value: str, decay: float) -> DataFrame:
    """``(arm, ema)``: the average that forgets by min(decay, (1 + s) / (10 + s)) at step s, over the ordered series of each arm."""
    series = df.groupBy(arm).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))).alias("s"))
    step = lambda acc, x: F.struct((acc["n"] + 1).alias("n"), (acc["e"] + (1 - F.least(F.lit(decay), (1 + acc["n"]) / (10 + acc["n"]))) * (x["v"] - acc["e"])).alias("e"))
    first = F.struct(F.lit(1.0).alias("n"), F.element_at("s", 1)["v"].alias("e"))
    return series.select(arm, F.aggregate(F.slice("s", 2, F.size("s")), first, step)["e"].alias("ema"))
