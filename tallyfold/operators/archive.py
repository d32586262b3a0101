"""Grow-only archive: appending with deduplication, dense sequences, forks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import keep

#: The two partial keys: of lines with an id, and of lines without.
_BY_UUID = ["origin_id", "session_id", "line_uuid"]
_BY_PLACE = ["origin_id", "source", "path", "byte_offset", "content_hash"]
#: The order in which equal lines count as first.
ARRIVAL = ["source", "path", "byte_offset", "content_hash"]


def conflict_key(null_session_conflicts: bool = False):
    """One column that equals for two lines that conflict, and is null for a line that never does.

    A line with an id but without a session never conflicts (nulls are distinct), unless the option says otherwise.
    """
    uuid = F.when(F.col("session_id").isNotNull() | F.lit(null_session_conflicts), F.struct(F.lit("u").alias("kind"), F.to_json(F.array("origin_id", F.coalesce("session_id", F.lit("")), "line_uuid")).alias("key")))
    place = F.struct(F.lit("p").alias("kind"), F.to_json(F.array("origin_id", "source", "path", F.col("byte_offset").cast("string"), "content_hash")).alias("key"))
    return F.when(F.col("line_uuid").isNotNull(), uuid).otherwise(place)


def with_key(rows: DataFrame, null_session_conflicts: bool) -> DataFrame:
    """rows with __key, their conflict key as text; a row that conflicts with nothing has one of its own, so that no window or join gathers them."""
    key = conflict_key(null_session_conflicts)
    own = F.concat(F.lit("n"), F.monotonically_increasing_id().cast("string"))
    return rows.withColumn("__key", F.coalesce(F.concat(key["kind"], key["key"]), own))


def _keys(existing: DataFrame, null_session_conflicts: bool) -> DataFrame:
    """__key, __held: the conflict keys of an archive, each once."""
    key = conflict_key(null_session_conflicts)
    return existing.select(F.concat(key["kind"], key["key"]).alias("__key")).filter(F.col("__key").isNotNull()).distinct().withColumn("__held", F.lit(True))


def mark_new(rows: DataFrame, held: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """rows (from with_key) with __new: whether a row is the first of its key, in order, and held (the columns `on`, and __held) lacks that key."""
    first = F.row_number().over(Window.partitionBy("__key").orderBy(*order))
    return rows.withColumn("__n", first).join(held, on, "left").withColumn("__new", (F.col("__n") == 1) & F.col("__held").isNull()).drop("__n", "__held", "__key")


def number(marked: DataFrame, order: list[str], top: DataFrame | int, received_at: str) -> DataFrame:
    """marked rows with status, and on new ones received_at and seq: dense from top on, in order.

    The rows are dealt to ranges of the order, each counts its rows, and the sums of the counts before it are added. top: a number, or one row of __top.
    """
    # new rows first, each range numbered by itself; stored, since ranges are dealt anew whenever they are computed
    ranged = marked.withColumn("__old", ~F.col("__new")).repartitionByRange("__old", *order).sortWithinPartitions("__old", *order).withColumn("__at", F.monotonically_increasing_id()).drop("__old")
    ranged = keep(ranged.withColumn("__range", F.shiftright("__at", 33)).withColumn("__i", F.col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__at"), "numbered")
    sizes = ranged.filter("__new").groupBy("__range").agg(F.max("__i").alias("__n"))
    before = sizes.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row for each range
    numbered = ranged.join(F.broadcast(before), "__range", "left")
    numbered = numbered.withColumn("__top", F.lit(top)) if isinstance(top, int) else numbered.crossJoin(F.broadcast(top))  # one row
    new = lambda x: F.when(F.col("__new"), x)
    out = numbered.withColumns({"seq": new(F.col("__top") + F.col("__before") + F.col("__i")).cast("long"), "received_at": new(F.lit(received_at)), "status": F.when(F.col("__new"), "stored").otherwise("duplicate")})
    return out.drop("__new", "__range", "__i", "__before", "__top")


def append_local(existing: DataFrame, batch: DataFrame, origin: str, received_at: str, arrival: list[str] | None = None, null_session_conflicts: bool = False) -> DataFrame:
    """batch with status (`stored` or `duplicate`), and for stored rows origin_id, dense seq and received_at.

    The first of equal lines in order of `arrival` (ARRIVAL by default) is stored, unless existing has one. Sequences continue the origin's without a gap, in
    that order. One writer appends at a time; existing is read whole, see sources.ledger for an archive whose keys are stored by range.
    """
    order = arrival or ARRIVAL
    own = existing.filter(F.col("origin_id") == origin)
    rows = with_key(batch.withColumn("origin_id", F.lit(origin)), null_session_conflicts)
    top = own.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("__top"))
    return number(mark_new(rows, _keys(own, null_session_conflicts), ["__key"], order), order, top, received_at)


def append_remote(existing: DataFrame, batch: DataFrame, null_session_conflicts: bool = False) -> DataFrame:
    """batch (with its own origin_id and seq) with status: `stored`, `duplicate`, `forked`.

    The same origin and seq with the same content is a duplicate, with other content a fork, whose row is evidence for
    quarantine. A new place whose conflict key the archive holds is a duplicate and leaves a hole, which a later row of the batch with
    another key may fill. Of the rest, the first row of a place stands for it, and the first place of a key; what such a
    row displaces is compared with it even where the key's first place lies elsewhere.
    """
    place = existing.select("origin_id", "seq", F.col("content_hash").alias("__held_hash"))
    return mark_remote(with_key(batch, null_session_conflicts), _keys(existing, null_session_conflicts), ["__key"], place)


def mark_remote(rows: DataFrame, keys: DataFrame, on: list[str], place: DataFrame) -> DataFrame:
    """append_remote of rows from with_key, against keys (the columns `on`, and __held) and places (origin_id, seq, __held_hash)."""
    rows = rows.join(keys, on, "left").join(place, ["origin_id", "seq"], "left")
    rows = rows.withColumn("__open", F.col("__held_hash").isNull() & F.col("__held").isNull())
    here = Window.partitionBy("origin_id", "seq").orderBy(F.desc("__open"), "content_hash", "source", "path", "byte_offset")
    rows = rows.withColumn("__nth", F.row_number().over(here)).withColumn("__first", F.first("content_hash").over(here))
    held = F.coalesce("__held_hash", F.when(F.col("__open") & (F.col("__nth") > 1), F.col("__first")))
    status = F.when(held.isNotNull(), F.when(held == F.col("content_hash"), "duplicate").otherwise("forked")).when(F.col("__open"), "new").otherwise("duplicate")
    rows = rows.withColumn("status", status)
    turn = F.row_number().over(Window.partitionBy("__key").orderBy(F.col("status") != "new", "origin_id", "seq"))
    rows = rows.withColumn("__turn", turn).withColumn("status", F.when(F.col("status") != "new", F.col("status")).when(F.col("__turn") == 1, "stored").otherwise("duplicate"))
    return rows.drop("__key", "__held", "__held_hash", "__open", "__nth", "__first", "__turn")


def quarantine(marked: DataFrame, noticed_at: str) -> DataFrame:
    """Evidence rows of forked records; sent again, they are noted again."""
    return marked.filter("status = 'forked'").select("origin_id", "seq", "content_hash", "sealed", F.lit(noticed_at).alias("noticed_at"))


def accounting(marked: DataFrame) -> DataFrame:
    """stored, duplicates, forked, last_seq of an append."""
    return marked.agg(F.count_if(F.col("status") == "stored").alias("stored"), F.count_if(F.col("status") == "duplicate").alias("duplicates"), F.count_if(F.col("status") == "forked").alias("forked"), F.max(F.when(F.col("status") == "stored", F.col("seq"))).alias("last_seq"))


def counts(records: DataFrame, quarantined: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("records")).crossJoin(quarantined.agg(F.count(F.lit(1)).alias("quarantined")))  # one row each


def since(records: DataFrame, origin: str, after: int, limit: int) -> DataFrame:
    """The next records of an origin, in order: a filter on both columns of the clustered key, then a top-k."""
    return records.filter((F.col("origin_id") == origin) & (F.col("seq") > after)).orderBy("seq").limit(limit)
