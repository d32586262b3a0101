import json
import os

import pytest
from pyspark.sql import functions as F

from tallyfold.sources import bundles, transcripts
from tallyfold.streaming.collect import archive, collect_once, collect_polling
from tallyfold.streaming import tail
from tallyfold.streaming.tail import begin_at, fingerprint, look, ranges, read_range, resume, whole_lines


def test_roots_and_exclusions(spark):
    assert transcripts.outermost(["/work/", "/work/a", "/workspace", "\\work\\b"]) == ["/work", "/workspace"]
    df = spark.createDataFrame([("/work/a",), ("/work",), ("/workspace/a",)], "p string")
    assert [r[0] for r in df.filter(~transcripts.excluded(F.col("p"), ["/work/"])).collect()] == ["/workspace/a"]


def test_batch_reading(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "one.jsonl").write_text('{"x":1}\r\nä\n\npartial')
    (tmp_path / "a" / "b" / "two.jsonl").write_text("l1\nl2\n")
    (tmp_path / "a" / "b" / "skip.txt").write_text("no\n")
    (tmp_path / "ax").mkdir()
    (tmp_path / "ax" / "x.jsonl").write_text("no\n")
    rows = transcripts.read_lines(spark, [str(tmp_path), str(tmp_path / "a"), str(tmp_path / "missing")], [str(tmp_path / "ax")]).collect()
    got = sorted((os.path.basename(r["path"]), r["byte_offset"], r["value"]) for r in rows)
    assert got == [("one.jsonl", 0, '{"x":1}'), ("one.jsonl", 9, "ä"), ("two.jsonl", 0, "l1"), ("two.jsonl", 3, "l2")]
    assert transcripts.read_lines(spark, [str(tmp_path / "missing")]).count() == 0


@pytest.mark.parametrize(
    "size, head, identity, cursor, want",
    [
        (5, b"a", "1", None, (0, "appended")), (9, b"a", "1", {"offset": 5, "identity": "1"}, (5, "appended")), (3, b"a", "1", {"offset": 5, "identity": "1"}, (0, "truncated")),
        (9, b"a", "2", {"offset": 5, "identity": "1"}, (0, "replaced")), (9, b"abcdefghi", None, {"offset": 5, "fingerprint": fingerprint(b"abcde"), "head": 5}, (5, "appended")),
        (9, b"Xbcdefghi", None, {"offset": 5, "fingerprint": fingerprint(b"abcde"), "head": 5}, (0, "replaced")), (5, b"abcde", "1", {"offset": 5, "identity": "1"}, (5, "appended")), (0, b"", "1", {"offset": 0, "identity": "1"}, (0, "appended")),
    ],
)
def test_where_to_resume(size, head, identity, cursor, want):
    assert resume(size, head, identity, cursor) == want


def new_lines(path, cursor):
    """(lines, cursor, continuity) of what a file has beyond a cursor."""
    now = look(str(path))
    if now is None:
        return [], None, "gone"
    parts = ranges({str(path): cursor} if cursor else {}, {str(path): now})
    return [x for p in parts for x in read_range(p.path, p.start, p.stop, p.first)], now, begin_at(str(path), cursor, now)[1]


def test_tail_withholds_and_continues(tmp_path):
    p = tmp_path / "t.jsonl"
    p.write_bytes(b"one\ntw")
    lines, cursor, _ = new_lines(p, None)
    assert (lines, cursor["offset"]) == ([(0, "one")], 4)
    assert new_lines(p, cursor)[0] == []
    with p.open("ab") as f:
        f.write(b"o\nthree\n")
    lines, after, how = new_lines(p, cursor)
    assert (lines, how, after["offset"]) == ([(4, "two"), (8, "three")], "appended", 14)
    p.write_bytes(b"new\n")
    assert new_lines(p, after)[::2] == ([(0, "new")], "truncated")
    assert new_lines(p, {**after, "offset": 2, "identity": "other"})[2] == "replaced"
    assert new_lines(p, {**after, "offset": 2, "identity": None, "fingerprint": fingerprint(b"old"), "head": 3})[2] == "replaced"
    p.unlink()
    assert new_lines(p, after) == ([], None, "gone") and list(read_range(str(p), 0, 9)) == []
    assert whole_lines(b"", 7) == ([], 7) and fingerprint(b"") == 0xCBF29CE484222325


@pytest.mark.parametrize("split, window", [(7, 3), (16, 8), (1000, 5)])
def test_ranges_split_lines_among_them_once(tmp_path, monkeypatch, split, window):
    monkeypatch.setattr(tail, "SPLIT", split)
    monkeypatch.setattr(tail, "WINDOW", window)
    p = tmp_path / "t.jsonl"
    want = [b"x" * 100, b"next", b"", b"a\r", b"\xc3\xa4", b"y" * 7]
    p.write_bytes(b"\n".join(want) + b"\nopen end")
    lines, cursor, _ = new_lines(p, None)
    starts = [sum(len(w) + 1 for w in want[:i]) for i in range(len(want))]
    assert lines == [(o, w.decode().rstrip("\r")) for o, w in zip(starts, want) if w] and cursor["offset"] == sum(len(w) + 1 for w in want)


def test_one_pass_drains_a_large_backlog(spark, tmp_path):
    root, out = tmp_path / "logs", str(tmp_path / "archive")
    root.mkdir()
    with (root / "a.jsonl").open("w") as f:
        for i in range(60_000):
            f.write(json.dumps({"type": "user", "sessionId": "s", "uuid": f"u{i}", "cwd": "/p" * 90}) + "\n")
    assert (root / "a.jsonl").stat().st_size > 12 << 20
    (root / "b.jsonl").write_text("{}\n")
    stats = collect_once(spark, str(root), out, str(tmp_path / "check"), "me", "test", "now")
    assert (stats.streams, stats.lines, stats.stored, stats.duplicates, stats.restarted, stats.gone) == (2, 60_001, 60_001, 0, 0, 0)
    rows = archive(spark, out)
    assert rows.agg(F.min("seq"), F.max("seq"), F.countDistinct("seq")).first()[:] == (1, 60_001, 60_001)
    (root / "b.jsonl").unlink()
    (root / "a.jsonl").write_text('{"type":"user","sessionId":"s","uuid":"u1"}\n')
    stats = collect_once(spark, str(root), out, str(tmp_path / "check"), "me", "test", "now")
    assert (stats.streams, stats.lines, stats.stored, stats.duplicates, stats.restarted, stats.gone) == (1, 1, 0, 1, 1, 1)


def test_polling_collects_until_stopped(spark, tmp_path):
    root, out = tmp_path / "logs", str(tmp_path / "archive")
    root.mkdir()
    (root / "a.jsonl").write_text('{"type":"user","sessionId":"s","uuid":"u1"}\n')
    query = collect_polling(spark, str(root), out, str(tmp_path / "check"), "me", "test", "now", "1 second")
    try:
        query.processAllAvailable()
        with (root / "a.jsonl").open("a") as f:
            f.write('{"type":"user","sessionId":"s","uuid":"u2"}\n')
        query.processAllAvailable()
        assert archive(spark, out).count() == 2
    finally:
        query.stop()


def test_only_changed_files_are_opened_and_offsets_stay_short(tmp_path, monkeypatch):
    root, folder = tmp_path / "logs", str(tmp_path / "cursors")
    root.mkdir()
    for i in range(2000):
        (root / f"{i}.jsonl").write_text('{"x":1}\n')
    reader = tail.TailReader({"path": str(root), "cursors": folder})
    first = reader.latestOffset()
    assert len(reader.partitions(reader.initialOffset(), first)) == 2000
    opened, plain = [], tail.look
    monkeypatch.setattr(tail, "look", lambda p: opened.append(p) or plain(p))
    for i in range(10):
        with (root / f"{i}.jsonl").open("a") as f:
            f.write('{"x":2}\n')
    again = tail.TailReader({"path": str(root), "cursors": folder})  # a driver that starts anew
    for r in (reader, again):
        opened.clear()
        second = r.latestOffset()
        parts = r.partitions(first, second)
        assert len(opened) <= 10 and len(parts) == 10 and all((p.start, p.stop) == (8, 16) for p in parts)
    assert len(json.dumps(second)) < 300 and again.latestOffset() == second
    for i in range(40):
        (root / "0.jsonl").write_text("{}\n" * (i + 5))
        last = again.latestOffset()
    assert len(os.listdir(folder)) <= tail.KEPT_CURSORS + 1 and tail.load_cursors(last)[str(root / "0.jsonl")]["offset"] == 44 * 3


def test_polling_counts_files_that_came_and_went(spark, tmp_path):
    from tallyfold.streaming.collect import Stats

    root, stats = tmp_path / "logs", Stats()
    root.mkdir()
    for n in "ab":
        (root / f"{n}.jsonl").write_text(f'{{"type":"user","sessionId":"s","uuid":"{n}"}}\n')
    query = collect_polling(spark, str(root), str(tmp_path / "archive"), str(tmp_path / "check"), "me", "test", "now", "1 second", stats=stats)
    try:
        query.processAllAvailable()
        (root / "a.jsonl").unlink()
        (root / "c.jsonl").write_text('{"type":"user","sessionId":"s","uuid":"c"}\n')
        query.processAllAvailable()
    finally:
        query.stop()
    assert (stats.streams, stats.gone, stats.stored) == (2, 1, 3)


def test_an_archive_of_older_columns_reads_with_nulls(spark, tmp_path):
    old = spark.createDataFrame([("me", 1, "s")], "origin_id string, seq long, session_id string")
    old.write.parquet(str(tmp_path / "old"))
    row = archive(spark, str(tmp_path / "old")).first()
    assert (row["origin_id"], row["seq"], row["session_id"], row["cwd"], row["git_branch"], row["sealed"]) == ("me", 1, "s", None, None, None)


def test_collection_is_idempotent_and_continues(spark, tmp_path):
    root, out, check = tmp_path / "logs", str(tmp_path / "archive"), str(tmp_path / "check")
    root.mkdir()
    line = lambda i: json.dumps({"type": "user", "sessionId": "s", "uuid": f"u{i}", "cwd": "/p"})
    (root / "a.jsonl").write_text(line(1) + "\n" + line(2) + "\n" + line(3))
    collect = lambda c: collect_once(spark, str(root), out, c, "me", "test", "now")
    seen = lambda: sorted((r["seq"], r["line_uuid"]) for r in archive(spark, out).collect())
    collect(check)
    assert seen() == [(1, "u1"), (2, "u2")]
    with (root / "a.jsonl").open("a") as f:
        f.write("\n" + line(4) + "\n")
    collect(check)
    assert seen() == [(1, "u1"), (2, "u2"), (3, "u3"), (4, "u4")]
    collect(check)
    collect(str(tmp_path / "another"))  # cursors lost: everything is read again, nothing stored twice
    assert len(seen()) == 4


def test_bundles(spark, tmp_path):
    df = spark.range(1, 12001).select(F.lit("me").alias("origin_id"), F.col("id").alias("seq"), F.lit("h").alias("content_hash"))
    folder = str(tmp_path / "b")
    assert bundles.publish(df.filter("seq <= 6000"), folder, "me").count() == 2
    stored = bundles.ranges(bundles.read_folder(spark, folder).drop("bundle"))
    assert sorted(r["bundle"] for r in bundles.unpublished(df, stored, "me").collect()) == [1, 2]
    bundles.publish(df, folder, "me", stored)
    assert bundles.read_folder(spark, folder).count() == 12000
    have = spark.createDataFrame([("me", 11990)], "origin_id string, seq long")
    assert bundles.fetch(bundles.read_folder(spark, folder), have, "you").count() == 10
    assert bundles.fetch(bundles.read_folder(spark, folder), have, "me").count() == 0


def test_batch_codec(spark, tmp_path):
    df = spark.createDataFrame([("s", "/p", 0, "h", "line")], "source string, path string, byte_offset long, content_hash string, value string")
    bundles.write_batch(df, str(tmp_path / "j"))
    assert bundles.read_batch(spark, str(tmp_path / "j")).collect() == df.collect()


def test_blobs(spark, tmp_path):
    from tallyfold.sources.blobs import Blobs

    b = Blobs(spark, f"file://{tmp_path}/blobs")
    assert b.list() == [] and b.get("a/one") is None
    b.put("a/one", b"1\x00")
    b.put("a/two", b"")
    b.put("b", b"x")
    b.put("a/one", b"again")
    assert b.list() == ["a/one", "a/two", "b"] and b.list("a/") == ["a/one", "a/two"] and (b.get("a/one"), b.get("a/two")) == (b"again", b"")
    b.delete("b")
    b.delete("b")
    assert sorted(r["key"] for r in b.read().collect()) == ["a/one"]
    for key in ("", "../x", "a//b", "/a"):
        with pytest.raises(ValueError):
            b.put(key, b"")


def test_a_reader_always_finds_a_blob_that_is_replaced(spark, tmp_path):
    import threading

    from tallyfold.sources.blobs import Blobs

    b = Blobs(spark, f"file://{tmp_path}/blobs")
    b.put("k", b"0" * 1000)
    seen, done = [], threading.Event()

    def read():
        while not done.is_set():
            try:
                seen.append((tmp_path / "blobs" / "k").read_bytes())
            except FileNotFoundError:
                seen.append(None)

    reader = threading.Thread(target=read)
    reader.start()
    for i in range(30):
        b.put("k", str(i % 10).encode() * 1000)
    done.set()
    reader.join()
    assert seen and all(x is not None and len(x) == 1000 and len(set(x)) == 1 for x in seen) and b.list() == ["k"]


def test_reports_as_json_lines(spark, tmp_path):
    from tallyfold.plans import edge

    df = spark.createDataFrame([("2026-01-01", 1, None), ("2026-01-02", 2, 0.5)], "day string, requests long, cost_usd double")
    edge.write(df, "daily", str(tmp_path))
    edge.write(df, "daily", str(tmp_path))
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/daily").collect()) == ['{"day":"2026-01-01","requests":1,"cost_usd":null}', '{"day":"2026-01-02","requests":2,"cost_usd":0.5}']
    with pytest.raises(ValueError):
        edge.documents(df, "weekly")
