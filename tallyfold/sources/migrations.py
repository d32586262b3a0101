"""Bringing older archives forward: named steps, each applied once, in order, and published whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import reprocess
from ..schema import RECORDS
from .ledger import Ledger

#: Records to records: the same keys and sequences, other columns changed or filled.
Step = Callable[[DataFrame], DataFrame]


def is_flat(book: Ledger) -> bool:
    """Whether the folder has files of records but no batches: an archive from before batches."""
    return book.newest().generation < 0 and any(n.endswith(".parquet") for n in book.folders(book.root))


def flat(spark: SparkSession, path: str) -> DataFrame:
    """The records of such files; columns that they lack read as null."""
    return spark.read.schema(RECORDS).parquet(path)


def workspace(records: DataFrame) -> DataFrame:
    """Directory, branch and pull request of records stored before these were extracted, from their bodies."""
    return reprocess.apply(records, reprocess.changed(records))


#: In order; names are for good.
STEPS: dict[str, Step] = {"0001-workspace": workspace}


def migrate(book: Ledger, now: str, steps: dict[str, Step] | None = None) -> list[str]:
    """Apply the steps that the archive has not had; their names. Flat files become the first batch, under their own sequences. A step is published by
    one rename together with its name: one that fails leaves the archive as it was after the step before. A second run does nothing."""
    if is_flat(book):
        book.append_remote(flat(book.spark, book.root), now)
    done = []
    for name, step in (STEPS if steps is None else steps).items():
        if name not in book.newest().steps:
            book.rewrite(step, name)
            done.append(name)
    return done
