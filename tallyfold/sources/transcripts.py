"""Transcript files in batch: discovery, exclusion, whole lines."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..streaming.tail import TranscriptTail

EXTENSION = ".jsonl"


def normalize(path: str) -> str:
    """Forward slashes, no trailing or doubled ones."""
    out = path.replace("\\", "/")
    while "//" in out:
        out = out.replace("//", "/")
    return out.rstrip("/") or "/"


def outermost(roots: list[str]) -> list[str]:
    """Roots that no other root contains, so that no file is read twice."""
    out: list[str] = []
    for r in sorted(set(map(normalize, roots))):
        if not any(within(r, o) for o in out):
            out.append(r)
    return out


def within(path: str, root: str) -> bool:
    """Equality or containment on a segment boundary: /work does not contain /workspace."""
    return root == "/" or path == root or path.startswith(root + "/")


def excluded(path: Column, exclusions: list[str]) -> Column:
    out = F.lit(False)
    for x in map(normalize, exclusions):
        out = out | (path == x) | path.startswith(x if x == "/" else x + "/")
    return out


def present(spark: SparkSession, roots: list[str]) -> list[str]:
    """Roots that exist, asked of the file system that holds them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for r in roots:
        at = jvm.org.apache.hadoop.fs.Path(r)
        if at.getFileSystem(conf).exists(at):
            found.append(r)
    return found


def read_lines(spark: SparkSession, roots: list[str], exclusions: list[str] | None = None) -> DataFrame:
    """path, byte_offset, value: every terminated line of the transcripts under roots, which have one path on all machines.

    Missing roots are skipped, files that vanish meanwhile too. A last line without a newline is withheld. Large files
    are read in several ranges of bytes.
    """
    spark.dataSource.register(TranscriptTail)
    out = spark.createDataFrame([], "path string, byte_offset long, value string")
    for root in present(spark, outermost(roots)):
        lines = spark.read.format("transcript_tail").option("exclude", os.pathsep.join(map(normalize, exclusions or []))).load(root)
        out = out.unionByName(lines.select("path", "byte_offset", "value"))
    return out


def with_hash(lines: DataFrame) -> DataFrame:
    return lines.withColumn("content_hash", content_hash("value"))
