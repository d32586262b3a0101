"""A stored archive that grows by whole batches: each is staged, then published by one rename.

    root/batches/generation=12/_batch.json                                what the archive is as of this batch: its live batches, the top sequence of each origin
                              /table=records/origin_id=a/span=3/*.parquet  records, by origin and range of sequences
                              /table=keys/bucket=17/*.parquet              128 bits of hash of each conflict key, by session or file
                              /table=digests/*.parquet                     digests of the buckets of sequences that the batch touched
                              /table=quarantine/*.parquet                  evidence of forks
                              /table=patches/*.parquet                     columns that were extracted anew, merged when records are read
    root/staging/                                                          batches that are not published, of writers at work or lost

A batch's number is one more than that of the newest one its writer has seen. The rename to it fails if another writer came first: then nothing of it
shows, and the writer numbers its records anew after the other's. So sequences have no hole and none is given twice, whenever a writer dies.
The file system has to refuse a rename to a folder that exists, as HDFS and POSIX do.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import archive, replication, reprocess
from ..schema import QUARANTINE, RECORD_COLUMNS, RECORDS
from ..shared import keep

#: Sequences of an origin in a folder; a multiple of replication.BUCKET.
SPAN = 50 * replication.BUCKET
BUCKETS = 256

_PATCHES = "origin_id string, seq long, version int, cwd string, git_branch string, pr_repo string, pr_number long"


class Refused(Exception):
    """Another writer has published in between."""


@dataclass
class Batch:
    """What the newest batch says of the archive."""

    generation: int = -1
    live: list[int] = field(default_factory=list)
    top: dict[str, int] = field(default_factory=dict)
    buckets: int = BUCKETS
    span: int = SPAN
    steps: list[str] = field(default_factory=list)  # migrations that it has had
    marks: dict[str, dict[str, int]] = field(default_factory=dict)  # of each extraction version, each origin's sequence that it has come to


@dataclass
class Reprocessed:
    examined: int = 0
    updated: int = 0
    unreadable: int = 0


@dataclass
class Appended:
    stored: int = 0
    duplicates: int = 0
    forked: int = 0
    generation: int | None = None


class Ledger:
    """The archive in the folder root."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, span: int = SPAN, derivations: tuple | list = ()):
        """derivations: objects that keep tables of their own with the records (see plans.kept); an archive is always opened with the same ones."""
        if span % replication.BUCKET:
            raise ValueError(f"span must be a multiple of {replication.BUCKET}")
        self.spark, self.root, self._new, self.derivations = spark, root.rstrip("/"), Batch(buckets=buckets, span=span), derivations
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(self._conf())

    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, at: str):
        return self._jvm.org.apache.hadoop.fs.Path(at)

    def _at(self, generation: int) -> str:
        return f"{self.root}/batches/generation={generation}"

    def folders(self, at: str) -> list[str]:
        """The names in a folder; none where there is no folder."""
        path = self._path(at)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def newest(self) -> Batch:
        """The state as the newest batch tells it: one listing and one small file."""
        found = max((int(n.split("=")[1]) for n in self.folders(f"{self.root}/batches") if n.startswith("generation=")), default=None)
        if found is None:
            return Batch(buckets=self._new.buckets, span=self._new.span)
        source = self._fs.open(self._path(f"{self._at(found)}/_batch.json"))
        try:
            return Batch(**json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")))
        finally:
            source.close()

    # reading

    def table(self, name: str, schema: str, parts: dict[str, list[str]] | None = None, state: Batch | None = None) -> DataFrame:
        """A table of the live batches; with parts, only these folders (such as `origin_id=a/span=3`) of these generations are listed and read."""
        state = state or self.newest()
        if parts is None:
            paths = [f"{self._at(g)}/table={name}" for g in state.live if f"table={name}" in self.folders(self._at(g))]
        else:
            paths = [f"{self._at(int(g))}/table={name}/{p}" for g, own in parts.items() for p in own]
        if not paths:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(f"{schema}, generation long, table string").option("basePath", f"{self.root}/batches")
        return reader.parquet(*paths).select(*[c.split()[0] for c in schema.split(", ")])

    def records(self, state: Batch | None = None) -> DataFrame:
        """All records; columns that older batches lack read as null."""
        state = state or self.newest()
        return self._patched(self.table("records", f"{RECORDS}, span long", state=state).select(*RECORD_COLUMNS), state)

    def _patches(self, state: Batch) -> DataFrame | None:
        """origin_id, seq and the columns of the latest extraction; None where nothing was extracted anew."""
        if not any("table=patches" in self.folders(self._at(g)) for g in state.live):
            return None
        found = self.table("patches", _PATCHES, state=state)
        return found.groupBy("origin_id", "seq").agg(F.max_by(F.struct(*reprocess.REWRITTEN), "version").alias("__new"), F.max("version").alias("version"))

    def _patched(self, rows: DataFrame, state: Batch) -> DataFrame:
        new = self._patches(state)
        return rows if new is None else reprocess.merge(rows, new)

    def quarantined(self) -> DataFrame:
        return self.table("quarantine", QUARANTINE)

    def vector(self, state: Batch | None = None) -> dict[str, int]:
        """The top sequence of each origin, without reading a record."""
        return dict((state or self.newest()).top)

    def spans(self, state: Batch, origins: list[str] | None = None) -> dict[tuple[str, int], list[int]]:
        """(origin, span) to the live generations that hold some of it, by listing folders."""
        out: dict[tuple[str, int], list[int]] = {}
        for g in state.live:
            for o in self.folders(f"{self._at(g)}/table=records"):
                if not o.startswith("origin_id="):
                    continue
                name = self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(o.split("=", 1)[1])
                if origins is None or name in origins:
                    for s in self.folders(f"{self._at(g)}/table=records/{o}"):
                        if s.startswith("span="):
                            out.setdefault((name, int(s.split("=")[1])), []).append(g)
        return out

    def spans_read(self, state: Batch, wanted: set[tuple[str, int]], held: dict[tuple[str, int], list[int]] | None = None) -> DataFrame:
        """The records of these spans: folders of others are neither listed by Spark nor read."""
        parts: dict[str, list[str]] = {}
        for (origin, span), generations in (self.spans(state, [o for o, _ in wanted]) if held is None else held).items():
            if (origin, span) in wanted:
                for g in generations:
                    parts.setdefault(str(g), []).append(f"origin_id={self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(origin)}/span={span}")
        return self._patched(self.table("records", f"{RECORDS}, span long", parts, state).select(*RECORD_COLUMNS), state)

    def between(self, after: dict[str, int], upto: dict[str, int], state: Batch | None = None) -> DataFrame:
        """Records of each origin in upto that lie above after and not above upto; only the spans between are read."""
        state = state or self.newest()
        wanted = {(o, s) for o, hi in upto.items() if hi > after.get(o, 0) for s in range(after.get(o, 0) // state.span, (hi - 1) // state.span + 1)}
        if not wanted:
            return self.table("records", f"{RECORDS}, span long", {}, state).select(*RECORD_COLUMNS)
        inside = reduce(lambda a, b: a | b, [(F.col("origin_id") == o) & (F.col("seq") > after.get(o, 0)) & (F.col("seq") <= upto[o]) for o in {o for o, _ in wanted}])
        return self.spans_read(state, wanted).filter(inside)

    def since(self, origin: str, after: int, limit: int) -> DataFrame:
        """The next records of an origin, in order. Spans are read from the one of `after` on until they hold enough: one of them, or two, where sequences are dense."""
        state = self.newest()
        held = self.spans(state, [origin])
        ahead = sorted(s for _, s in held if s >= after // state.span)
        n = -(-(after % state.span + limit) // state.span) if ahead and ahead[0] == after // state.span else -(-limit // state.span)
        while True:
            found = archive.since(self.spans_read(state, {(origin, s) for s in ahead[:n]}, held), origin, after, limit)
            if n >= len(ahead) or found.count() >= limit:
                return found
            n *= 2

    # writing

    def bucketed(self, name: str, schema: str, buckets: set[int], state: Batch) -> DataFrame:
        """Some buckets of a table that is stored by bucket."""
        parts = {str(g): [p for p in self.folders(f"{self._at(g)}/table={name}") if p.startswith("bucket=") and int(p.split("=")[1]) in buckets] for g in state.live}
        return self.table(name, schema, parts, state)

    def _keys(self, state: Batch, buckets: set[int]) -> DataFrame:
        return self.bucketed("keys", "k1 long, k2 long, bucket int", buckets, state).select("k1", "k2").withColumn("__held", F.lit(True))

    def _keyed(self, rows: DataFrame, state: Batch, null_session_conflicts: bool) -> DataFrame:
        """rows with __key, k1 and k2 (its hashes, null for a row that conflicts with nothing) and bucket: rows of one session, or of one file, share it."""
        kind = archive.conflict_key(null_session_conflicts)
        text = F.concat(kind["kind"], kind["key"])
        place = F.when(F.col("line_uuid").isNotNull(), F.struct("origin_id", F.coalesce("session_id", F.lit("")))).otherwise(F.struct("origin_id", F.concat("source", F.lit("\n"), "path")))
        return archive.with_key(rows, null_session_conflicts).withColumns({"k1": F.when(text.isNotNull(), F.xxhash64(F.lit("k1"), text)), "k2": F.when(text.isNotNull(), F.xxhash64(F.lit("k2"), text)), "bucket": F.pmod(F.xxhash64(place), F.lit(state.buckets)).cast("int")})

    def _buckets(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.filter("k1 is not null").select("bucket").distinct().collect()}  # as many as the archive has at most

    def append(self, batch: DataFrame, origin: str, received_at: str, arrival: list[str] | None = None, null_session_conflicts: bool = False, attempts: int = 5) -> Appended:
        """Store a batch's new records under the origin's next sequences (see archive.append_local). Only the key buckets that the batch's sessions and files
        fall in are read. A batch that comes again stores nothing. If other writers publish first, `attempts` times in all, Refused is raised."""

        def mark(state: Batch) -> DataFrame:
            rows = keep(self._keyed(batch.withColumn("origin_id", F.lit(origin)), state, null_session_conflicts), "keyed")
            order = arrival or archive.ARRIVAL
            marked = archive.mark_new(rows, self._keys(state, self._buckets(rows)), ["k1", "k2"], order)
            return archive.number(marked, order, state.top.get(origin, 0), received_at)

        return self._append(mark, attempts)

    def append_remote(self, batch: DataFrame, noticed_at: str, null_session_conflicts: bool = False, attempts: int = 5) -> Appended:
        """Store a peer's records under their own origins and sequences (see archive.append_remote); forks go to quarantine. Only the spans and key buckets of the batch are read."""

        def mark(state: Batch) -> DataFrame:
            columns = [F.col(c) if c in batch.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in RECORDS.split(", "))]
            rows = keep(self._keyed(batch.select(*columns), state, null_session_conflicts), "keyed")
            wanted = {(r[0], r[1]) for r in rows.select("origin_id", F.expr(f"(seq - 1) div {state.span}")).distinct().collect()}  # a batch's spans
            place = self.spans_read(state, wanted).select("origin_id", "seq", F.col("content_hash").alias("__held_hash"))
            return archive.mark_remote(rows, self._keys(state, self._buckets(rows)), ["k1", "k2"], place)

        return self._append(mark, attempts, noticed_at)

    def _append(self, mark, attempts: int, noticed_at: str | None = None) -> Appended:
        for left in range(attempts - 1, -1, -1):
            state = self.newest()
            marked = keep(mark(state), "marked")
            counts = {r["status"]: r["count"] for r in marked.groupBy("status").count().collect()}  # three rows at most
            done = Appended(counts.get("stored", 0), counts.get("duplicate", 0), counts.get("forked", 0))
            if not done.stored and not done.forked:
                return done
            try:
                done.generation = self.publish(self.stage(marked, state, noticed_at))
                return done
            except Refused:
                if not left:
                    raise

    def stage(self, marked: DataFrame, state: Batch, noticed_at: str | None = None) -> tuple[str, Batch]:
        """Write what a batch adds to a folder of its own; returns it, and the archive's state once it is published."""
        at = f"{self.root}/staging/{uuid.uuid4().hex}"
        new = marked.filter("status = 'stored'")
        rows = new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in RECORDS.split(", "))], F.expr(f"(seq - 1) div {state.span}").alias("span"))
        self._write_records(rows, at)
        new.filter("k1 is not null").select("k1", "k2", "bucket").repartition("bucket").sortWithinPartitions("bucket", "k1", "k2").write.partitionBy("bucket").parquet(f"{at}/table=keys")
        if noticed_at is not None:
            archive.quarantine(marked, noticed_at).write.parquet(f"{at}/table=quarantine")
        self._digests_of(rows, state).write.parquet(f"{at}/table=digests")
        for d in self.derivations:
            d.derive(self, state, rows, at)
        tops = {r["origin_id"]: r["seq"] for r in replication.version_vector(rows).collect()}  # a row for each origin
        top = state.top | {o: max(n, state.top.get(o, 0)) for o, n in tops.items()}
        return at, self._state(at, state, top=top)

    def _state(self, at: str, state: Batch, **new) -> Batch:
        """Note in a staged folder what the archive is once it is published."""
        after = replace(state, generation=state.generation + 1, **{"live": [*state.live, state.generation + 1]} | new)
        self._put(f"{at}/_batch.json", json.dumps(asdict(after)))
        return after

    @staticmethod
    def _write_records(rows: DataFrame, at: str) -> None:
        """In order of sequence, so that row groups' statistics bound a page; a span is written by one task, which its size allows."""
        rows.repartition("origin_id", "span").sortWithinPartitions("origin_id", "span", "seq").write.partitionBy("origin_id", "span").parquet(f"{at}/table=records")

    def _staged(self, at: str) -> DataFrame:
        return self.spark.read.schema(f"{RECORDS}, span long").parquet(f"{at}/table=records")

    def _put(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), True)
        try:
            out.write(text.encode())
        finally:
            out.close()

    def publish(self, staged: tuple[str, Batch]) -> int:
        """Make a staged batch part of the archive, or raise Refused, with nothing changed but the staged folder gone."""
        at, after = staged
        self._fs.mkdirs(self._path(f"{self.root}/batches"))
        try:
            none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri() if "://" in self.root else self._fs.getUri(), self._conf()).rename(self._path(at), self._path(self._at(after.generation)), none)
        except Py4JJavaError as e:
            if not self._fs.exists(self._path(self._at(after.generation))):
                raise
            self._fs.delete(self._path(at), True)
            raise Refused(f"batch {after.generation} was published by another writer") from e
        return after.generation

    # digests

    def _digests_of(self, rows: DataFrame, state: Batch) -> DataFrame:
        """Digests of the buckets that rows touch: of the rows, and of what the archive has in those buckets. No other span is read."""
        rows = rows.select("origin_id", "seq", "content_hash")
        bucket = F.expr(f"(seq - 1) div {replication.BUCKET}")
        touched = rows.select("origin_id", bucket.alias("bucket")).distinct()
        spans = {(r[0], r[1]) for r in touched.select("origin_id", F.expr(f"bucket div {state.span // replication.BUCKET}")).distinct().collect()}  # a batch's spans
        held = self.spans_read(state, spans).select("origin_id", "seq", "content_hash").withColumn("bucket", bucket).join(touched, ["origin_id", "bucket"], "left_semi").drop("bucket")
        return replication.bucket_digests(held.unionByName(rows)).withColumn("made", F.lit(state.generation + 1).cast("long"))

    def digests(self, state: Batch | None = None) -> DataFrame:
        """origin_id, bucket, digest: of each bucket, the one that the last batch to touch it has made. No record is read."""
        kept = self.table("digests", "origin_id string, bucket long, digest string, made long", state=state)
        return kept.groupBy("origin_id", "bucket").agg(F.max_by("digest", "made").alias("digest"))

    # extraction

    def reprocess(self, version: int, most: int = 1_000_000) -> Reprocessed:
        """Extract the columns of records above the version's marks again (see operators.reprocess), at most `most` sequences at a time. Each part's changes and its mark are
        published together, so a pass that ends early goes on from there; files of records stay as they are. An unreadable body keeps its columns."""
        out, version = Reprocessed(), int(version)
        while True:
            state = self.newest()
            marks = state.marks.get(str(version), {})
            todo = next(((o, marks.get(o, 0), top) for o, top in sorted(state.top.items()) if marks.get(o, 0) < top), None)
            if todo is None:
                return out
            origin, low, high = todo[0], todo[1], min(todo[1] + most, todo[2])
            rows = self.between({origin: low}, {origin: high}, state)
            changes = keep(reprocess.changed(rows), "changes")
            seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count("sealed").alias("bodies")).first()
            readable = reprocess.readable(rows).count()
            at = f"{self.root}/staging/{uuid.uuid4().hex}"
            changes.select("origin_id", "seq", F.lit(version).alias("version"), *reprocess.REWRITTEN).write.parquet(f"{at}/table=patches")
            for d in self.derivations:
                d.derive(self, state, reprocess.apply(rows.join(changes.select("origin_id", "seq"), ["origin_id", "seq"], "left_semi"), changes), at)
            try:
                self.publish((at, self._state(at, state, marks=state.marks | {str(version): marks | {origin: high}})))
            except Refused:  # the part is done anew, after what the other writer has published
                continue
            out = Reprocessed(out.examined + seen["n"], out.updated + changes.count(), out.unreadable + seen["bodies"] - readable)

    def pending(self, version: int) -> int:
        """How many sequences lie above a version's marks, without reading a record."""
        state = self.newest()
        return sum(max(0, top - state.marks.get(str(version), {}).get(o, 0)) for o, top in state.top.items())

    # care

    def compact(self, after: int = -1) -> int:
        """Replace the live batches above `after` by one batch of the same content: a file for each span and each key bucket. Readers of the state before go on until vacuum()."""
        return self._merge(self.newest(), after)

    def rewrite(self, step, name: str) -> int:
        """Replace all records by step(records), which keeps keys and sequences, and note its name, in one published batch."""
        state = self.newest()
        return self._merge(state, -1, step, steps=[*state.steps, name])

    def _merge(self, state: Batch, after: int, step=None, **new_state) -> int:
        merged = [g for g in state.live if g > after]
        part = replace(state, live=merged)
        at = f"{self.root}/staging/{uuid.uuid4().hex}"
        rows = self.table("records", f"{RECORDS}, span long", state=part)
        whole = merged == state.live
        rows = self._patched(rows, part).select(*rows.columns) if whole else rows
        if step is not None:
            rows = step(rows.drop("span")).withColumn("span", F.expr(f"(seq - 1) div {state.span}"))
        self._write_records(rows, at)
        if not whole and (new := self._patches(part)) is not None:  # what they patch may lie in batches that stay
            new.select("origin_id", "seq", "version", "__new.*").write.parquet(f"{at}/table=patches")
        self.table("keys", "k1 long, k2 long, bucket int", state=part).repartition("bucket").sortWithinPartitions("bucket", "k1", "k2").write.partitionBy("bucket").parquet(f"{at}/table=keys")
        self.table("quarantine", QUARANTINE, state=part).write.parquet(f"{at}/table=quarantine")
        kept = self.table("digests", "origin_id string, bucket long, digest string, made long", state=part)
        kept.groupBy("origin_id", "bucket").agg(F.max_by("digest", "made").alias("digest"), F.max("made").alias("made")).write.parquet(f"{at}/table=digests")
        for d in self.derivations:
            if step is None:
                d.merge(self, part, at)
            else:
                d.derive(self, replace(state, live=[]), self._staged(at), at)
        return self.publish((at, self._state(at, state, live=[*[g for g in state.live if g <= after], state.generation + 1], **new_state)))

    def vacuum(self) -> list[int]:
        """Delete batches that the newest one no longer counts as live; call it once nothing reads an older state. Staged folders of lost writers go too, so no writer may be at work."""
        live = self.newest().live
        gone = [int(n.split("=")[1]) for n in self.folders(f"{self.root}/batches") if n.startswith("generation=") and int(n.split("=")[1]) not in live]
        for g in gone:
            self._fs.delete(self._path(self._at(g)), True)
        self._fs.delete(self._path(f"{self.root}/staging"), True)
        return gone
