"""Sinks: reports as JSON, logs that are appended to, tab-separated transcripts, ordered Markdown tables, keyed caches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").csv(path)


def write_page_blocks(df: DataFrame, name: str, text: str, path: str) -> None:
    """Writes each page as a block: ``###`` and its name, its text, an empty line."""
    block = F.concat(F.lit("### "), F.col(name).cast("string"), F.lit("\n"), F.coalesce(F.col(text), F.lit("")), F.lit("\n"))
    df.select(block.alias("value")).write.mode("overwrite").text(path)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], **depends: object) -> DataFrame:
    """The table at the path, made and written there if it isn't yet; what it depends on (name, split, seed, ...) becomes part of the path."""
    path = "/".join([path, *(f"{k}={v}" for k, v in sorted(depends.items()))])
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.mode("ignore").parquet(path)
        return spark.read.parquet(path)


def markdown(df: DataFrame, order: list[str], most: int = 1000) -> str:
    """A table of a report (a few rows) in Markdown, in the given order; more rows than ``most`` are an error."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    cell = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *([cell(v) for v in row] for row in rows)])


def joined_markdown(df: DataFrame, order: str, line: str) -> DataFrame:
    """One row: the lines of a report in order, one under the other."""
    return df.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l")))), lambda x: x["l"]), "\n").alias("text"))
