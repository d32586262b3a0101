"""Extracting columns again from stored bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .identify import identify, parse
from .replication import by_origin

#: The only columns that a pass may rewrite: none of them is part of a key or of usage.
REWRITTEN = ["cwd", "git_branch", "pr_repo", "pr_number"]


def pending(records: DataFrame, marks: DataFrame, version: int) -> DataFrame:
    """One row, pending: records above their origin's mark for this version, 0 at least."""
    high = records.groupBy("origin_id").agg(F.max("seq").alias("high"))
    mark = marks.filter(F.col("version") == version).groupBy("origin_id").agg(F.max("seq").alias("mark"))
    return high.join(mark, "origin_id", "left").agg(F.greatest(F.coalesce(F.sum(F.col("high") - F.coalesce("mark", F.lit(0))), F.lit(0)), F.lit(0)).alias("pending"))


def unfinished(records: DataFrame, marks: DataFrame, version: int) -> DataFrame:
    """Records above their origin's mark. Marks have a row for each origin and version."""
    mark = marks.filter(F.col("version") == version).groupBy("origin_id").agg(F.max("seq").alias("__mark"))
    return by_origin(records, mark).filter(F.col("seq") > F.coalesce("__mark", F.lit(0))).drop("__mark")


def changed(records: DataFrame) -> DataFrame:
    """origin_id, seq and REWRITTEN as extracted now, where one differs from what is stored. Unreadable bodies are skipped."""
    old = records.select("origin_id", "seq", "sealed", F.struct(*REWRITTEN).alias("__old")).filter(F.col("sealed").isNotNull())
    now = identify(old, "sealed", readable=True)
    differs = F.lit(False)
    for c in REWRITTEN:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__old.{c}"))
    return now.filter(differs).select("origin_id", "seq", *REWRITTEN)


def readable(records: DataFrame) -> DataFrame:
    """Records whose body is one JSON object of the known types."""
    return parse(records.select("origin_id", "seq", "sealed").filter(F.col("sealed").isNotNull()), "sealed").filter(F.col("__j").isNotNull()).drop("__j")


def apply(records: DataFrame, changes: DataFrame) -> DataFrame:
    """records with the changes; keys, usage and bodies are untouched."""
    return merge(records, changes.select("origin_id", "seq", F.struct(*REWRITTEN).alias("__new")))


def merge(records: DataFrame, new: DataFrame) -> DataFrame:
    """records with the columns of new (origin_id, seq, __new) where it has a row."""
    out = records.join(new.select("origin_id", "seq", "__new"), ["origin_id", "seq"], "left")
    return out.withColumns({c: F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)) for c in REWRITTEN}).select(*records.columns)


def advance(marks: DataFrame, done: DataFrame, version: int) -> DataFrame:
    """marks raised to the highest sequence of each origin in done; a mark never falls."""
    new = done.groupBy("origin_id").agg(F.max("seq").alias("seq")).select("origin_id", F.lit(version).alias("version"), "seq")
    return marks.select("origin_id", "version", "seq").unionByName(new).groupBy("origin_id", "version").agg(F.max("seq").alias("seq"))


def run_pass(records: DataFrame, marks: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """Records after a pass over what is above the marks, and the marks after it."""
    todo = unfinished(records, marks, version)
    return apply(records, changed(todo)), advance(marks, todo.select("origin_id", "seq"), version)
