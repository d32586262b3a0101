"""Appending, replication and reprocessing as algebra."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import archive, replication, reprocess
from tallyfold.schema import RECORDS


def rec(spark, rows):
    """(origin, seq, session, uuid, offset, hash)"""
    df = spark.createDataFrame(rows, "origin_id string, seq long, session_id string, line_uuid string, byte_offset long, content_hash string")
    return df.withColumns({"source": F.lit("t"), "path": F.lit("/f"), "sealed": F.lit("{}"), "received_at": F.lit("now")})


def status(df):
    return sorted((r["line_uuid"] or "", r["byte_offset"], r["status"], r["seq"]) for r in df.collect())


def test_local_append_is_idempotent_and_dense(spark):
    none = rec(spark, []).limit(0)
    batch = rec(spark, [("x", 0, "s", "u1", 10, "h1"), ("x", 0, "s", "u1", 20, "h1"), ("x", 0, "s", "u2", 30, "h2"), ("x", 0, None, None, 40, "h3"), ("x", 0, None, None, 40, "h3")]).drop("seq")
    one = archive.append_local(none, batch, "me", "now")
    assert status(one) == [("", 40, "duplicate", None), ("", 40, "stored", 3), ("u1", 10, "stored", 1), ("u1", 20, "duplicate", None), ("u2", 30, "stored", 2)]
    held = one.filter("status = 'stored'").drop("status")
    again = archive.append_local(held, batch, "me", "now")
    assert {r["status"] for r in again.collect()} == {"duplicate"}
    more = archive.append_local(held, rec(spark, [("x", 0, "s", "u9", 1, "h9")]).drop("seq"), "me", "now")
    assert status(more) == [("u9", 1, "stored", 4)]


def test_a_line_with_an_id_but_no_session_never_conflicts_unless_asked(spark):
    batch = rec(spark, [("x", 0, None, "u1", 10, "h1"), ("x", 0, None, "u1", 20, "h1")]).drop("seq")
    none = rec(spark, []).limit(0)
    assert [r[3] for r in status(archive.append_local(none, batch, "me", "now"))] == [1, 2]
    assert [r[2] for r in status(archive.append_local(none, batch, "me", "now", null_session_conflicts=True))] == ["stored", "duplicate"]


def test_remote_append_tells_duplicates_forks_and_holes(spark):
    held = rec(spark, [("a", 1, "s", "u1", 0, "h1"), ("a", 2, "s", "u2", 0, "h2"), ("a", 9, "s", "u3", 0, "h3")])
    sent = rec(spark, [("a", 1, "s", "u1", 0, "h1"), ("a", 2, "s", "u2", 0, "other"), ("a", 3, "s", "u3", 0, "h3"), ("a", 4, "s", "u4", 0, "h4"), ("a", 4, "s", "u4", 0, "h4"), ("a", 5, "s", "u4", 0, "h5")])
    marked = archive.append_remote(held, sent)
    assert sorted((r["seq"], r["status"]) for r in marked.collect()) == [(1, "duplicate"), (2, "forked"), (3, "duplicate"), (4, "duplicate"), (4, "stored"), (5, "duplicate")]
    assert [r["content_hash"] for r in archive.quarantine(marked, "now").collect()] == ["other"]
    assert tuple(archive.accounting(marked).first()) == (1, 4, 1, 4)


def test_a_hole_is_filled_by_another_row_of_its_place(spark):
    held = rec(spark, [("a", 9, "s", "u1", 0, "h9")])
    sent = rec(spark, [("a", 1, "s", "u1", 0, "h1"), ("a", 1, "s", "u2", 0, "h2"), ("a", 1, "s", "u3", 0, "h3"), ("a", 2, None, "u4", 0, "h4"), ("a", 3, None, "u4", 0, "h4")])
    marked = archive.append_remote(held, sent)
    assert sorted((r["seq"], r["line_uuid"], r["status"]) for r in marked.collect()) == [(1, "u1", "duplicate"), (1, "u2", "stored"), (1, "u3", "forked"), (2, "u4", "stored"), (3, "u4", "stored")]


def test_appends_read_the_archive_twice(spark, tmp_path):
    rec(spark, [("a", 1, "s", "u1", 0, "h1")]).write.parquet(str(tmp_path / "e"))
    held = spark.read.parquet(str(tmp_path / "e"))
    plan = archive.append_remote(held, rec(spark, [("a", 2, "s", "u2", 0, "h2")]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2


def test_vectors_and_digests(spark):
    df = rec(spark, [("a", i, "s", f"u{i}", 0, f"h{i}") for i in range(1, 1003)])
    assert {r["origin_id"]: r["seq"] for r in replication.version_vector(df, "me").collect()} == {"a": 1002, "me": 0}
    assert {r["origin_id"]: r["seq"] for r in replication.version_vector(df, "a").collect()} == {"a": 1002}
    want = {b: f"{len(s)}:" + hashlib.sha256("".join(f"{i}:h{i}\n" for i in s).encode()).hexdigest() for b, s in ((0, range(1, 1001)), (1, range(1001, 1003)))}
    assert {r["bucket"]: r["digest"] for r in replication.bucket_digests(df).collect()} == want


@pytest.mark.parametrize("mine, theirs, want", [({}, {}, (0, 0)), ({"a": 5}, {"a": 5}, (0, 0)), ({"a": 5}, {"a": 9}, (4, 0)), ({"a": 9}, {"a": 5}, (0, 4)), ({"a": 5, "b": 2}, {"a": 7, "c": 3}, (5, 2)), ({"a": 1}, {}, (0, 1))])
def test_lag(spark, mine, theirs, want):
    v = lambda d: spark.createDataFrame(list(d.items()), "origin_id string, seq long")
    assert tuple(replication.lag(v(mine), v(theirs)).first()) == want


def test_exchange_converges_through_a_third_node(spark):
    """a -> b -> c by vectors alone; the same records everywhere, none twice."""
    nodes = {n: rec(spark, [(n, i, "s", f"{n}{i}", 0, f"{n}{i}") for i in range(1, k + 1)]) for n, k in (("a", 3), ("b", 2), ("c", 0))}
    nodes["c"] = nodes["a"].limit(0)
    empty = spark.createDataFrame([], "origin_id string, from_seq long")
    for to, frm in (("b", "a"), ("c", "b"), ("a", "c"), ("b", "c")):
        plan = replication.resend_plan(replication.version_vector(nodes[frm]), replication.version_vector(nodes[to]), empty)
        got = archive.append_remote(nodes[to], replication.to_resend(nodes[frm], plan))
        nodes[to] = spark.createDataFrame(nodes[to].unionByName(got.filter("status = 'stored'").drop("status")).collect(), nodes[to].schema)
    want = sorted(("a", i) for i in range(1, 4)) + sorted(("b", i) for i in range(1, 3))
    assert all(sorted((r["origin_id"], r["seq"]) for r in df.collect()) == want for df in nodes.values())


def test_reprocess_recovers_and_repeats_nothing(spark):
    body = '{"type":"user","sessionId":"s","uuid":"u","cwd":"/p","gitBranch":"main"}'
    base = spark.createDataFrame([], RECORDS)
    rows = [{"origin_id": "a", "seq": i, "cwd": c, "git_branch": b, "sealed": s, "session_id": "kept", "input_tokens": 7} for i, (c, b, s) in enumerate([(None, None, body), ("/p", "main", body), ("/old", None, "broken"), ("/x", "HEAD", body)], 1)]
    df = spark.createDataFrame([{c: r.get(c) for c in base.columns} for r in rows], RECORDS)
    marks = spark.createDataFrame([("a", 1, 1)], "origin_id string, version int, seq long")
    assert reprocess.pending(df, marks, 1).first()[0] == 3 and reprocess.pending(df, marks, 2).first()[0] == 4
    after, now = reprocess.run_pass(df, marks, 2)
    got = {r["seq"]: (r["cwd"], r["git_branch"], r["session_id"], r["input_tokens"]) for r in after.collect()}
    assert got == {1: ("/p", "main", "kept", 7), 2: ("/p", "main", "kept", 7), 3: ("/old", None, "kept", 7), 4: ("/p", "main", "kept", 7)}
    assert reprocess.changed(after).count() == 0
    assert sorted((r["version"], r["seq"]) for r in now.collect()) == [(1, 1), (2, 4)] and reprocess.pending(after, now, 2).first()[0] == 0
    assert {r["seq"] for r in reprocess.advance(now, df.filter("seq = 1"), 2).filter("version = 2").collect()} == {4}


def test_since_pages_in_order(spark):
    df = rec(spark, [("a", i, "s", f"u{i}", 0, "h") for i in (5, 3, 1, 4, 2)])
    assert [r["seq"] for r in archive.since(df, "a", 1, 3).collect()] == [2, 3, 4]
