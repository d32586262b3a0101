"""Rounds between two stored archives, and from a shared folder into one, until nothing moves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import replication
from ..sources import bundles
from ..sources.ledger import Ledger

#: Sequences in a batch.
MOST = 1_000_000


@dataclass
class Moved:
    """What a peer was sent, and what became of it."""

    sent: int = 0
    stored: int = 0
    duplicates: int = 0
    forked: int = 0

    def __add__(self, other: Moved) -> Moved:
        return Moved(self.sent + other.sent, self.stored + other.stored, self.duplicates + other.duplicates, self.forked + other.forked)


def differing(source: Ledger, to: Ledger, upto: dict[str, int]) -> DataFrame:
    """Records of source, not above upto, that `to` neither holds nor has in quarantine, in buckets whose digests differ. Digests say which buckets these are; of the
    archives, only the spans of those buckets are read. A bucket that upto cuts differs by what lies above, which is not sent here."""
    ours, theirs = source.newest(), to.newest()
    mine, other = source.digests(ours).withColumnRenamed("digest", "mine"), to.digests(theirs)
    unlike = mine.join(other, ["origin_id", "bucket"], "left").filter(~F.col("mine").eqNullSafe(F.col("digest"))).select("origin_id", "bucket")
    spans = {s: {(r[0], r[1]) for r in unlike.select("origin_id", F.expr(f"bucket div {s // replication.BUCKET}")).distinct().collect()} for s in {ours.span, theirs.span}}  # folders that differ
    wanted = {(o, s) for o, s in spans[ours.span] if s * ours.span < upto.get(o, 0)}
    rows = source.spans_read(ours, wanted).withColumn("bucket", F.expr(f"(seq - 1) div {replication.BUCKET}")).join(unlike, ["origin_id", "bucket"], "left_semi").drop("bucket")
    top = rows.sparkSession.createDataFrame([*upto.items()], "origin_id string, __top long")
    rows = rows.join(F.broadcast(top), "origin_id").filter("seq <= __top").drop("__top")  # a row for each origin
    known = to.spans_read(theirs, spans[theirs.span]).select("origin_id", "seq", "content_hash").unionByName(to.quarantined().select("origin_id", "seq", "content_hash"))
    return rows.join(known, ["origin_id", "seq", "content_hash"], "left_anti")


def _append(to: Ledger, rows: DataFrame, now: str) -> Moved:
    done = to.append_remote(rows, now)
    return Moved(done.stored + done.duplicates + done.forked, done.stored, done.duplicates, done.forked)


def push(source: Ledger, to: Ledger, now: str, most: int = MOST) -> Moved:
    """Send a peer what it lacks: below its sequences where digests differ, then all above them, in batches of at most `most` sequences. What is stored
    stays stored if a later batch fails, and the next push goes on from there."""
    have, vector, out = to.vector(), source.vector(), Moved()
    common = {o: min(n, vector[o]) for o, n in have.items() if o in vector}
    if common:
        out += _append(to, differing(source, to, common), now)
    for origin, top in sorted(vector.items()):
        for low in range(have.get(origin, 0), top, most):
            out += _append(to, source.between({origin: low}, {origin: min(low + most, top)}), now)
    return out


def exchange(a: Ledger, b: Ledger, now: str, most: int = MOST, rounds: int = 10) -> list[Moved]:
    """Push both ways until a round stores nothing and finds no new fork; what each round moved, the quiet one last. Two archives that differ in forks
    alone end with each other's records in quarantine."""
    out = []
    for _ in range(rounds):
        out.append(push(a, b, now, most) + push(b, a, now, most))
        if not out[-1].stored and not out[-1].forked:
            return out
    raise RuntimeError(f"no rest after {rounds} rounds")


@dataclass
class Fetched:
    fetched: int = 0
    stored: int = 0
    duplicates: int = 0
    forked: int = 0
    unreadable: int = 0


def fetch_into(ledger: Ledger, folder: str, self_origin: str, now: str) -> Fetched:
    """Append what a shared folder has of other origins above what the archive holds. Bundles at or below its sequences are not opened; one that cannot be read is counted and left."""
    paths = bundles.wanted(ledger.spark, folder, ledger.vector(), self_origin)
    if not paths:
        return Fetched()
    unreadable = bundles.unreadable(ledger.spark, paths)
    rows = bundles.fetch_listed(ledger.spark, folder, ledger.vector(), self_origin)
    moved = _append(ledger, rows, now)
    return Fetched(moved.sent, moved.stored, moved.duplicates, moved.forked, unreadable)
