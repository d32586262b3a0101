"""The stored archive: whole batches, races, lost writers, bounded reads, exchange and re-extraction."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import replication
from tallyfold.sources import bundles, ledger
from tallyfold.sources.ledger import Ledger, Refused
from tallyfold.streaming import exchange


def lines(spark, lo, hi, origin=None, body=None):
    """One line for each number, 100 to a session and 500 to a file; each fiftieth has no id."""
    rows = [("t", f"/f{i // 500}", i, f"h{i}", f"s{i // 100}", None if i % 50 == 0 else f"u{i}", body(i) if body else "{}") for i in range(lo, hi)]
    df = spark.createDataFrame(rows, "source string, path string, byte_offset long, content_hash string, session_id string, line_uuid string, sealed string")
    return df if origin is None else df.withColumns({"origin_id": F.lit(origin), "seq": F.col("byte_offset") + 1})


@pytest.fixture
def book(spark, tmp_path):
    return Ledger(spark, str(tmp_path / "book"), buckets=64, span=1000)


def dense(book):
    return {r["origin_id"]: (r["n"], r["d"], r["top"]) for r in book.records().groupBy("origin_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("seq").alias("d"), F.max("seq").alias("top")).collect()}


def test_batches_are_stored_once_and_numbered_densely(spark, book):
    assert book.records().count() == 0 and book.vector() == {} and book.digests().count() == 0
    one = book.append(lines(spark, 0, 600), "me", "now")
    assert (one.stored, one.duplicates, one.generation) == (600, 0, 0)
    two = book.append(lines(spark, 500, 700), "me", "now")
    assert (two.stored, two.duplicates, two.generation) == (100, 100, 1)
    again = book.append(lines(spark, 0, 700), "me", "now")
    assert (again.stored, again.duplicates, again.generation) == (0, 700, None)
    assert dense(book) == {"me": (700, 700, 700)} and book.vector() == {"me": 700}
    assert [r["seq"] for r in book.records().orderBy("byte_offset").collect()][:600] == sorted(range(1, 601), key=lambda i: next(k for k, x in enumerate(sorted(range(600), key=lambda b: (f"/f{b // 500}", b))) if x == i - 1))


def test_a_line_with_an_id_but_no_session_is_never_held(spark, book):
    batch = lines(spark, 1, 3).withColumn("session_id", F.lit(None).cast("string"))
    assert [book.append(batch, "me", "now").stored for _ in range(2)] == [2, 2]
    assert book.append(batch, "me", "now", null_session_conflicts=True).stored == 2 and book.append(batch, "me", "now", null_session_conflicts=True).stored == 0


def test_an_append_reads_the_key_buckets_and_spans_of_its_lines_alone(spark, book, monkeypatch):
    book.append(lines(spark, 0, 6000), "me", "now")
    read, table = [], Ledger.table

    def counted(self, name, schema, parts=None, state=None):
        found = table(self, name, schema, parts, state)
        read.extend(f"{name}:{f}" for f in found.inputFiles())
        return found

    monkeypatch.setattr(Ledger, "table", counted)
    done = book.append(lines(spark, 5950, 6050), "me", "now")
    assert (done.stored, done.duplicates) == (50, 50)
    keys, records = [f for f in read if f.startswith("keys:")], [f for f in read if f.startswith("records:")]
    assert len(keys) <= 4 and len(records) <= 1  # two sessions and two files; the span whose digest changes
    assert len(os.listdir(f"{book.root}/batches/generation=0/table=keys")) > 30
    read.clear()
    book.append_remote(lines(spark, 5980, 6010, "you"), "now")
    assert len([f for f in read if f.startswith("keys:")]) <= 4 and not [f for f in read if f.startswith("records:")]


def test_a_writer_that_dies_before_publishing_leaves_nothing(spark, book, monkeypatch):
    book.append(lines(spark, 0, 100), "me", "now")
    with monkeypatch.context() as m:
        m.setattr(Ledger, "publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            book.append(lines(spark, 100, 200), "me", "now")
    assert dense(book) == {"me": (100, 100, 100)} and os.listdir(f"{book.root}/staging")
    assert book.append(lines(spark, 50, 200), "me", "now").stored == 100
    assert dense(book) == {"me": (200, 200, 200)}
    book.vacuum()
    assert not os.path.exists(f"{book.root}/staging") and dense(book) == {"me": (200, 200, 200)}


def test_a_second_writer_is_refused_and_numbers_anew(spark, book, monkeypatch):
    other, raced = Ledger(spark, book.root, buckets=64, span=1000), []
    stage = Ledger.stage

    def late(self, *args):
        staged = stage(self, *args)
        if not raced:  # between staging and publishing another writer comes first
            raced.append(1)
            assert other.append(lines(spark, 60, 120), "me", "now").stored == 60
        return staged

    monkeypatch.setattr(Ledger, "stage", late)
    with pytest.raises(Refused):
        book.append(lines(spark, 0, 100), "me", "now", attempts=1)
    assert dense(book) == {"me": (60, 60, 60)}
    raced.clear()
    monkeypatch.setattr(other, "append", lambda *a: Ledger.append(other, lines(spark, 200, 260), "me", "now"))
    done = book.append(lines(spark, 0, 100), "me", "now")
    assert (done.stored, done.duplicates) == (60, 40) and dense(book) == {"me": (180, 180, 180)}


def test_writers_at_once_give_no_sequence_twice(spark, book):
    failed = []

    def write(k):
        try:
            Ledger(spark, book.root, buckets=64, span=1000).append(lines(spark, k * 40, k * 40 + 60), "me", "now", attempts=20)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    own = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    [t.start() for t in own]
    [t.join() for t in own]
    assert not failed and dense(book) == {"me": (140, 140, 140)}


def test_pages_read_one_or_two_files(spark, book):
    book.append(lines(spark, 0, 4000), "me", "now")
    after, seen, files = 0, [], []
    while page := (found := book.since("me", after, 400)).collect():
        assert len(found.inputFiles()) <= 2
        files += found.inputFiles()
        seen += [r["seq"] for r in page]
        after = seen[-1]
    assert seen == list(range(1, 4001)) and len(set(files)) == 4
    assert book.since("nobody", 0, 5).count() == 0


def test_compaction_keeps_content_and_old_readers(spark, book):
    for k in range(3):
        book.append(lines(spark, 300 * k, 300 * k + 300), "me", "now")
    book.append_remote(lines(spark, 0, 10, "you").union(lines(spark, 0, 1, "you").withColumn("content_hash", F.lit("other"))), "now")
    before, want = book.records(), sorted(map(str, book.records().collect()))
    digests = sorted(map(tuple, book.digests().collect()))
    assert book.compact(after=0) == 4 and book.newest().live == [0, 4]
    assert sorted(map(str, before.collect())) == want == sorted(map(str, book.records().collect()))
    book.compact()
    assert book.vacuum() == [0, 1, 2, 3, 4] or len(book.newest().live) == 1
    assert sorted(map(str, book.records().collect())) == want and sorted(map(tuple, book.digests().collect())) == digests and book.quarantined().count() == 1
    assert book.append(lines(spark, 0, 950), "me", "now").stored == 50 and dense(book)["me"] == (950, 950, 950)


def test_kept_digests_equal_those_of_the_records(spark, book):
    book.append(lines(spark, 0, 2500), "me", "now")
    book.append(lines(spark, 2500, 2600), "me", "now")
    key = lambda df: sorted(map(tuple, df.select("origin_id", "bucket", "digest").collect()))
    assert key(book.digests()) == key(replication.bucket_digests(book.records()))
    made = book.table("digests", "origin_id string, bucket long, digest string, made long").filter("made = 1").collect()
    assert [r["bucket"] for r in made] == [2]


def body(cwd):
    return lambda i: "not json" if i % 40 == 7 else json.dumps({"type": "user", "sessionId": f"s{i // 100}", "uuid": f"u{i}", "cwd": f"/new{i % 3}" if i % 2 else cwd})


def test_reprocessing_goes_on_from_its_mark(spark, book, monkeypatch):
    book.append(lines(spark, 0, 900, body=body("/old")).withColumn("cwd", F.lit("/old")), "me", "now")
    files = sorted(os.listdir(f"{book.root}/batches/generation=0/table=records/origin_id=me/span=0"))
    assert book.pending(2) == 900
    publish, n = Ledger.publish, []

    def dies(self, staged):
        n.append(1)
        if len(n) == 2:
            raise OSError("lost")
        return publish(self, staged)

    with monkeypatch.context() as m:
        m.setattr(Ledger, "publish", dies)
        with pytest.raises(OSError):
            book.reprocess(2, most=300)
    assert book.pending(2) == 600
    done = book.reprocess(2, most=300)
    assert done.examined == 600 and book.pending(2) == 0
    odd = {f"h{i}": f"/new{i % 3}" if i % 2 and i % 40 != 7 else "/old" for i in range(900)}
    assert {r["content_hash"]: r["cwd"] for r in book.records().collect()} == odd
    assert done.unreadable == sum(1 for r in book.records().filter("seq > 300").collect() if r["sealed"] == "not json") and done.updated == sum(1 for r in book.records().filter("seq > 300").collect() if r["cwd"] != "/old")
    assert sorted(os.listdir(f"{book.root}/batches/generation=0/table=records/origin_id=me/span=0")) == files
    again = book.reprocess(2)
    assert (again.examined, again.updated) == (0, 0)
    book.compact()
    assert book._patches(book.newest()) is None and {r["content_hash"]: r["cwd"] for r in book.records().collect()} == odd and book.pending(2) == 0


def test_archives_that_differ_become_equal_and_rest(spark, tmp_path):
    a, b = (Ledger(spark, str(tmp_path / n), buckets=16, span=1000) for n in "ab")
    a.append(lines(spark, 0, 1500), "a", "now")
    b.append(lines(spark, 3000, 3400), "b", "now")
    moved = exchange.exchange(a, b, "now", most=400)
    assert [m.stored for m in moved] == [1900, 0] and moved[-1].sent == 0
    key = lambda x: sorted(map(tuple, x.records().select("origin_id", "seq", "content_hash", "line_uuid").collect()))
    assert key(a) == key(b) and a.vector() == b.vector() == {"a": 1500, "b": 400}


def test_a_fork_ends_in_quarantine_on_both_sides(spark, tmp_path):
    a, b = (Ledger(spark, str(tmp_path / n), buckets=16, span=1000) for n in "ab")
    a.append_remote(lines(spark, 0, 1200, "x"), "now")
    b.append_remote(lines(spark, 0, 700, "x").withColumn("content_hash", F.when(F.col("seq") == 5, "forged").otherwise(F.col("content_hash"))).filter("seq <> 9"), "now")
    moved = exchange.exchange(a, b, "now")
    assert (moved[0].stored, moved[0].forked) == (501, 2) and (moved[-1].stored, moved[-1].forked) == (0, 0)
    assert [(r["seq"], r["content_hash"]) for r in a.quarantined().collect()] == [(5, "forged")] and [(r["seq"], r["content_hash"]) for r in b.quarantined().collect()] == [(5, "h4")]
    assert a.records().count() == b.records().count() == 1200


def test_a_push_that_fails_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    a, b = (Ledger(spark, str(tmp_path / n), buckets=16, span=1000) for n in "ab")
    a.append(lines(spark, 0, 900), "a", "now")
    append, n = Ledger.append_remote, []

    def dies(self, *args):
        n.append(1)
        if len(n) == 3:
            raise OSError("lost")
        return append(self, *args)

    with monkeypatch.context() as m:
        m.setattr(Ledger, "append_remote", dies)
        with pytest.raises(OSError):
            exchange.push(a, b, "now", most=300)
    assert b.vector() == {"a": 600}
    assert exchange.push(a, b, "now", most=300).stored == 300 and dense(b) == {"a": (900, 900, 900)}


def test_a_fetch_opens_the_bundles_above_the_vector_alone(spark, book, tmp_path):
    folder = str(tmp_path / "bundles")
    for origin, n in (("a", 12_000), ("b", 6000), ("me", 5001)):
        df = spark.range(1, n + 1).select(F.lit(origin).alias("origin_id"), F.col("id").alias("seq"), F.concat(F.lit(origin), F.col("id")).alias("content_hash"), F.lit("t").alias("source"), F.lit("/f").alias("path"), F.col("id").alias("byte_offset"), F.lit("s").alias("session_id"), F.concat(F.lit(origin), F.col("id")).alias("line_uuid"))
        bundles.publish(df, folder, origin)
    found = bundles.fetch_listed(spark, folder, {"a": 9000, "b": 10_000}, "me")
    assert found.count() == 3000 and len(found.inputFiles()) == 2
    assert bundles.fetch_listed(spark, folder, {"a": 15_000, "b": 10_000}, "me").count() == 0
    bad = next(p for p in (tmp_path / "bundles" / "origin_id=b" / "bundle=1").iterdir() if p.name.endswith(".parquet"))
    bad.write_bytes(b"PAR1 torn")
    done = exchange.fetch_into(book, folder, "me", "now")
    assert (done.fetched, done.stored, done.forked, done.unreadable) == (17_000, 17_000, 0, 1) and book.vector() == {"a": 12_000, "b": 5000}
    again = exchange.fetch_into(book, folder, "me", "now")
    assert (again.fetched, again.stored, again.unreadable) == (0, 0, 1)


def test_a_span_holds_whole_buckets(spark, tmp_path):
    with pytest.raises(ValueError):
        Ledger(spark, str(tmp_path), span=1500)
    assert ledger.SPAN % replication.BUCKET == 0


def test_archives_of_two_ages_are_brought_forward(spark, tmp_path):
    from tallyfold.sources import migrations
    from tallyfold.streaming.collect import append_batch, archive

    old = [("me", 1, "s", "u1", json.dumps({"type": "user", "sessionId": "s", "uuid": "u1", "cwd": "/p", "gitBranch": "main"})), ("me", 2, "s", "u2", "torn")]
    spark.createDataFrame(old, "origin_id string, seq long, session_id string, line_uuid string, sealed string").write.parquet(str(tmp_path / "old"))
    spark.createDataFrame([(*r, "/kept") for r in old], "origin_id string, seq long, session_id string, line_uuid string, sealed string, cwd string").write.parquet(str(tmp_path / "newer"))
    for name, cwd in (("old", [("/p"), None]), ("newer", ["/p", "/kept"])):
        book = Ledger(spark, str(tmp_path / name))
        assert migrations.is_flat(book) and archive(spark, book.root).count() == 2

        def fails(records):
            raise ValueError("step")

        with pytest.raises(ValueError):
            migrations.migrate(book, "now", {**migrations.STEPS, "0002-fails": fails})
        assert book.newest().steps == ["0001-workspace"] and [r["cwd"] for r in book.records().orderBy("seq").collect()] == cwd
        assert migrations.migrate(book, "now") == [] and book.newest().generation == 1
        assert [(r["seq"], r["git_branch"]) for r in book.records().orderBy("seq").collect()] == [(1, "main"), (2, None)]
        lines = spark.createDataFrame([("/f", 0, '{"type":"user","sessionId":"s","uuid":"u1"}'), ("/f", 9, '{"type":"user","sessionId":"s","uuid":"u3"}')], "path string, byte_offset long, value string")
        assert append_batch(lines, book.root, "me", "t", "now") == {"stored": 1, "duplicate": 1} and book.vector() == {"me": 3}


def test_batches_are_merged_as_they_add_up(spark, tmp_path):
    from tallyfold.streaming.collect import append_batch, archive

    for k in range(5):
        lines = spark.createDataFrame([("/f", k, f'{{"type":"user","sessionId":"s","uuid":"u{k}"}}')], "path string, byte_offset long, value string")
        append_batch(lines, str(tmp_path / "a"), "me", "t", "now", compact_every=2)
    assert len(Ledger(spark, str(tmp_path / "a")).newest().live) <= 3 and sorted(r["seq"] for r in archive(spark, str(tmp_path / "a")).collect()) == [1, 2, 3, 4, 5]


def test_the_kept_grid_equals_the_one_made_anew(spark, tmp_path):
    """Lower lines of a request come late, twice, from other origins and sessions; columns are extracted anew; batches are merged."""
    import random

    from tallyfold.operators import fold
    from tallyfold.plans.kept import KeptGrid

    rng, kept = random.Random(3), KeptGrid()
    book = Ledger(spark, str(tmp_path / "kept"), buckets=8, span=1000, derivations=[kept])
    rows = [(o, i + 1, f"{o}{i}", f"s{rng.randrange(4)}", f"{o}u{i}", f"2026-01-0{rng.randrange(1, 4)}T00:00:00" if i % 11 else None, rng.choice([None, *[f"r{k}" for k in range(25)]]), rng.choice(["m", None]), rng.randrange(9), rng.choice(["/a", None]), "{}") for o in "ab" for i in range(90)]
    df = spark.createDataFrame(rows, "origin_id string, seq long, content_hash string, session_id string, line_uuid string, captured_at string, request_id string, model string, input_tokens long, cwd string, sealed string").withColumns({c: F.lit(1).cast("long") for c in ("output_tokens", "think_tokens", "cache_read", "cache_write5m", "cache_write1h")})
    df = df.withColumns({"source": F.lit("t"), "path": F.lit("/f"), "byte_offset": F.col("seq")})
    same = lambda: sorted(map(str, kept.grid(book).collect())) == sorted(map(str, fold.daily_grid(fold.fold(book.records())).collect()))
    for part in ("seq > 60", "seq % 5 = 0", "origin_id = 'b' and seq < 50", "seq <= 60 or seq = 70"):
        book.append_remote(df.filter(part), "now")
        assert same(), part
    assert dense(book) == {"a": (90, 90, 90), "b": (90, 90, 90)}
    last = book.table("cells", "day string, requests long", {str(book.newest().generation): [""]}).count()
    assert 0 < last < kept.grid(book).count() * 2
    book.reprocess(2, most=50)  # bodies say nothing of a directory, so it goes
    assert same() and {r["cwd"] for r in kept.grid(book).collect()} == {""}
    book.compact(after=1)
    assert same()
    book.compact()
    assert same() and len(book.newest().live) == 1
    book.rewrite(lambda r: r.withColumn("cwd", F.lit("/new")), "x")
    assert same() and {r["cwd"] for r in kept.grid(book).collect()} == {"/new"}
