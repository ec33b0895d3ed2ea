"""Queries of the general training-data problem (2): nested page exports to flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkloom.plans.pagexml_sql import SQL  # noqa: F401
from inkloom.sources import pagexml


def nested(spark: SparkSession, d: str) -> DataFrame:
    return pagexml.records(spark.read.parquet(f"{d}/page_xml.parquet"))


QUERIES = {
    "p2_found": lambda s, d: pagexml.keys(nested(s, d)),
    "p2_lines": lambda s, d: pagexml.lines(nested(s, d)),
    "p2_points": lambda s, d: pagexml.points(nested(s, d)),
    "p2_readings": lambda s, d: pagexml.readings(nested(s, d)),
}
