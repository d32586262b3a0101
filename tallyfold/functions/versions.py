"""Release versions: parsing, comparison, the newest one to move to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col

_PART = r"(0|[1-9][0-9]*|[0-9]+)"
_RELEASE = rf"^v?{_PART}\.{_PART}\.{_PART}$"
LARGEST = (1 << 31) - 1


def parse(version: Column | str) -> Column:
    """struct<major, minor, patch> of `v?MAJOR.MINOR.PATCH` with parts of 31 bits; null for anything else: unreleased."""
    v = F.trim(col(version))
    parts = [F.regexp_extract(v, _RELEASE, k).try_cast("long") for k in (1, 2, 3)]
    ok = v.rlike(_RELEASE)
    for p in parts:
        ok = ok & F.coalesce(p <= LARGEST, F.lit(False))
    return F.when(ok, F.struct(*[p.alias(n) for p, n in zip(parts, ("major", "minor", "patch"))]))


def compare(a: Column | str, b: Column | str) -> Column:
    """`older`, `same`, `newer` (of a against b), or `unknown` between two unreleased ones; a release is newer than none."""
    x, y = parse(a), parse(b)
    return (
        F.when(x.isNull() & y.isNull(), "unknown").when(x.isNull(), "older").when(y.isNull(), "newer")
        .when(x < y, "older").when(x > y, "newer").otherwise("same")
    )


def newest(reported: DataFrame, current: str, version_col: str = "version") -> DataFrame:
    """One row, target: the newest reported release if it is strictly newer than current, else null. An unreleased current never moves."""
    now = parse(F.lit(current))
    rows = reported.select(F.trim(F.col(version_col)).alias("raw")).select("raw", parse("raw").alias("v")).filter(F.col("v").isNotNull())
    best = rows.agg(F.max(F.struct("v", "raw")).alias("best"))
    return best.select(F.when(now.isNotNull() & (F.col("best.v") > now), F.col("best.raw")).alias("target"))
