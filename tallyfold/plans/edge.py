"""Reports as JSON: one document a row, as many rows as the report has, so that no report has to fit one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The reports, by the name under which they are written.
NAMES = ("summary", "daily", "delivery", "health")


def documents(report: DataFrame, name: str) -> DataFrame:
    """report, json: each row as one JSON object that keeps its nulls."""
    if name not in NAMES:
        raise ValueError(f"no report {name!r}")
    return report.select(F.lit(name).alias("report"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write(report: DataFrame, name: str, folder: str) -> None:
    """JSON lines in folder/name, replaced whole."""
    documents(report, name).select("json").write.mode("overwrite").text(f"{folder}/{name}")
