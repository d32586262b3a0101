"""The daily grid kept up to date with a stored archive: each batch retracts and adds what it changes.

The least line of each request is kept as a pick. A batch with a lower line for a request, however late it comes, takes the old pick's numbers out of
its cell and puts the new one's in; cells are stored as such signed sums, published together with the batch's records. All numbers are integers, so
the grid equals the one computed anew, whatever the order of batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import day_of, pick_key
from ..operators.fold import FOLDED
from ..schema import USAGE
from ..shared import keep
from ..sources.ledger import Batch, Ledger

TOKENS = [c for c in USAGE if c != "think_tokens"]
CELL = ["day", "model", "origin_id", "session_id", "cwd", "git_branch"]
_CELLS = ", ".join([*(f"{c} string" for c in CELL), "requests long", *(f"{c} long" for c in TOKENS)])
_LINE = [*CELL, *TOKENS]
_PICKS = ", ".join(["request_id string", "pick string", "made long", *(f"{c} string" for c in CELL), *(f"{c} long" for c in TOKENS), "bucket int"])


class KeptGrid:
    """A derivation of a Ledger: Ledger(..., derivations=[KeptGrid()])."""

    tables = ("picks", "cells")

    def derive(self, book: Ledger, state: Batch, rows: DataFrame, at: str) -> None:
        """Write what rows change: picks of the requests that have a new least line, and sums by the cells they leave and enter. Of what is kept, only the buckets of the rows' requests are read."""
        cell = {"day": day_of("captured_at"), **{c: F.coalesce(c, F.lit("unknown" if c == "model" else "")) for c in CELL[1:]}}
        own = rows.filter(F.col("request_id").isNotNull()).select("request_id", "seq", *FOLDED).withColumn("pick", pick_key()).withColumns(cell)
        least = own.groupBy("request_id").agg(F.min_by(F.struct("pick", *_LINE), "pick").alias("new")).withColumn("bucket", F.pmod(F.xxhash64("request_id"), F.lit(state.buckets)).cast("int"))
        least = keep(least, "least")
        held = self._held(book, state, {r[0] for r in least.select("bucket").distinct().collect()})  # as many as the archive has at most
        met = least.join(held, "request_id", "left").filter(F.col("old").isNull() | (F.col("new.pick") < F.col("old.pick")) | (F.col("new.pick") == F.col("old.pick")) & (F.col("new") != F.col("old")))
        met = keep(met, "changed-picks")
        picks = met.select("request_id", "new.pick", F.lit(state.generation + 1).cast("long").alias("made"), *[f"new.{c}" for c in _LINE], "bucket")
        picks.repartition("bucket").sortWithinPartitions("bucket", "request_id").write.partitionBy("bucket").parquet(f"{at}/table=picks")
        signed = lambda side, sign: met.filter(F.col(side).isNotNull()).select(*[f"{side}.{c}" for c in CELL], F.lit(sign).cast("long").alias("requests"), *[(F.col(f"{side}.{c}") * sign).alias(c) for c in TOKENS])
        self._sums(signed("new", 1).unionByName(signed("old", -1)).filter("day <> ''")).write.parquet(f"{at}/table=cells")

    def _held(self, book: Ledger, state: Batch, buckets: set[int] | None) -> DataFrame:
        found = book.bucketed("picks", _PICKS, buckets, state) if buckets is not None else book.table("picks", _PICKS, state=state)
        order = F.struct("pick", (-F.col("made")).alias("made"))  # of one line, what was extracted last
        return found.groupBy("request_id").agg(F.min_by(F.struct("pick", *_LINE), order).alias("old"))

    @staticmethod
    def _sums(cells: DataFrame) -> DataFrame:
        """Cells that nothing is left in, or that nothing changes, are left out."""
        changes = " or ".join(f"{c} <> 0" for c in ["requests", *TOKENS])
        return cells.groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in ["requests", *TOKENS]]).filter(changes)

    def merge(self, book: Ledger, part: Batch, at: str) -> None:
        """The same content in one batch."""
        held = self._held(book, part, None).select("request_id", F.col("old.pick").alias("pick"), F.lit(part.generation).cast("long").alias("made"), *[f"old.{c}" for c in _LINE], F.pmod(F.xxhash64("request_id"), F.lit(part.buckets)).cast("int").alias("bucket"))
        held.repartition("bucket").sortWithinPartitions("bucket", "request_id").write.partitionBy("bucket").parquet(f"{at}/table=picks")
        self._sums(book.table("cells", _CELLS, state=part)).write.parquet(f"{at}/table=cells")

    def grid(self, book: Ledger) -> DataFrame:
        """What fold.daily_grid says of the archive, without reading a record."""
        return self._sums(book.table("cells", _CELLS))
