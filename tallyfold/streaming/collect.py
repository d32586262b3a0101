"""Collection: new lines into the archive, at least once and without repeats."""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.identify import to_records
from ..sources import migrations
from ..sources.ledger import Ledger
from ..shared import keep
from .tail import TranscriptTail, load_cursors, stored_cursors


@dataclass
class Stats:
    """What passes did: files seen, lines read, records stored and found held, files restarted (truncated or replaced) and gone."""

    streams: int = 0
    lines: int = 0
    stored: int = 0
    duplicates: int = 0
    restarted: int = 0
    gone: int = 0


def archive(spark: SparkSession, path: str) -> DataFrame:
    """The stored records, none if nothing is stored yet. Columns that older files lack read as null."""
    book = Ledger(spark, path)
    return migrations.flat(spark, path) if migrations.is_flat(book) else book.records()


def append_batch(lines: DataFrame, path: str, origin: str, source: str, received_at: str, compact_every: int = 32) -> dict[str, int]:
    """Store a batch's new records; how many were stored and how many held. Run again with the same lines, it stores nothing: the sink is idempotent, and
    a batch is published whole or not at all. After so many batches they are merged into one. A folder of plain files becomes an archive of batches first."""
    book = Ledger(lines.sparkSession, path)
    if migrations.is_flat(book):
        migrations.migrate(book, received_at)
    done = book.append(to_records(lines, source), origin, received_at)
    if len(live := book.newest().live) > compact_every:
        book.compact(after=live[0])  # the first is the large one
    return {"stored": done.stored, "duplicate": done.duplicates}


def _start(spark: SparkSession, root: str, path: str, checkpoint: str, origin: str, source: str, received_at: str, stats: Stats, exclude: str, counts_gone: bool = False, **trigger) -> StreamingQuery:
    spark.dataSource.register(TranscriptTail)
    stream, folder = spark.readStream.format("transcript_tail").option("exclude", exclude), _cursor_folder(checkpoint)
    stream = (stream.option("cursors", folder) if folder else stream).load(root)
    last: set[str] = set()

    def store(df: DataFrame, _: int) -> None:
        if folder and (found := stored_cursors(folder)):  # what this batch has looked at
            now = set(load_cursors({"stored": found[-1]}))
            stats.streams = len(now)
            stats.gone += len(last - now) if counts_gone else 0
            last.clear()
            last.update(now)
        own = keep(df, "batch")
        done = append_batch(own.select("path", "byte_offset", "value"), path, origin, source, received_at)
        stats.stored += done.get("stored", 0)
        stats.duplicates += done.get("duplicate", 0)
        stats.lines += own.count()
        stats.restarted += own.filter("continuity <> 'appended'").select("path").distinct().count()

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _progress(query: StreamingQuery, stats: Stats) -> Stats:
    """Streams and vanished files, from the cursors that the query's batches began and ended with."""
    seen: Counter = Counter()
    for p in query.recentProgress:
        for own in json.loads(p.json)["sources"] if hasattr(p, "json") else p["sources"]:
            end = _cursors(own["endOffset"])
            stats.streams = len(end)
            seen.update(set(_cursors(own.get("startOffset"))) - set(end))
    stats.gone += len(seen)
    return stats


def _cursors(offset) -> dict:
    return load_cursors(json.loads(offset) if isinstance(offset, str) else offset)


def _cursor_folder(checkpoint: str) -> str | None:
    """Beside the checkpoint, where that is a folder that the driver's Python can open; else cursors are in the offsets."""
    return f"{checkpoint.removeprefix('file://').rstrip('/')}/tail-cursors" if "://" not in checkpoint.removeprefix("file://") else None


def collect_once(spark: SparkSession, root: str, path: str, checkpoint: str, origin: str, source: str, received_at: str, exclude: str = "") -> Stats:
    """Read all that is new under root when the pass begins, append it, then let the checkpoint keep the cursors."""
    stats = Stats()
    query = _start(spark, root, path, checkpoint, origin, source, received_at, stats, exclude, availableNow=True)
    query.awaitTermination()
    return _progress(query, stats)


def collect_polling(spark: SparkSession, root: str, path: str, checkpoint: str, origin: str, source: str, received_at: str, every: str = "30 seconds", exclude: str = "", stats: Stats | None = None) -> StreamingQuery:
    """The same on an interval, until the query that is returned is stopped. stats, if given, counts what its passes do."""
    return _start(spark, root, path, checkpoint, origin, source, received_at, stats if stats is not None else Stats(), exclude, counts_gone=True, processingTime=every)
