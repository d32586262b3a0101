import pytest
from pyspark.sql import functions as F

from tallyfold.functions.text import branch_name, digest_count, host_of, shorten
from tallyfold.functions.versions import compare, newest, parse
from tallyfold.operators import peers

NOW = "TIMESTAMP '2026-01-01 12:00:00'"


@pytest.mark.parametrize(
    "converged, error, want",
    [(None, "", "never"), (None, "refused", "never"), ("2026-01-01 11:59:00", "", "current"), ("2026-01-01 10:59:59", "", "stale"), ("2026-01-01 09:00:00", "refused", "failing"), ("2026-01-01 13:00:00", "", "current"), ("2026-01-01 11:00:00", None, "current")],
)
def test_reach(spark, converged, error, want):
    df = spark.createDataFrame([(converged, error)], "c string, last_error string").withColumn("last_converged", F.to_timestamp("c"))
    assert df.select(peers.reach(F.expr(NOW))).first()[0] == want


def test_hosts(spark):
    cases = {"10.0.0.1:7": "10.0.0.1", "[fe80::1]:7": "fe80::1", "host": "host", "fe80::1": "fe80::1", "": ""}
    got = spark.createDataFrame([(k,) for k in cases], "a string").select("a", host_of("a").alias("h")).collect()
    assert dict(map(tuple, got)) == cases


def test_versions(spark):
    cases = {"v1.2.3": (1, 2, 3), "1.2.3": (1, 2, 3), "0.0.0": (0, 0, 0), "1.2": None, "v1.2.3-rc1": None, "": None, "dev": None, "1.2.99999999999": None, "2147483647.0.0": (2147483647, 0, 0), "2147483648.0.0": None}
    got = spark.createDataFrame([(k,) for k in cases], "v string").select("v", parse("v").alias("p")).collect()
    assert {r["v"]: tuple(r["p"]) if r["p"] else None for r in got} == cases


@pytest.mark.parametrize("a, b, want", [("1.2.3", "1.2.3", "same"), ("1.2.3", "1.10.0", "older"), ("2.0.0", "1.9.9", "newer"), ("dev", "1.0.0", "older"), ("1.0.0", "dev", "newer"), ("dev", "x", "unknown")])
def test_comparison(spark, a, b, want):
    assert spark.range(1).select(compare(F.lit(a), F.lit(b))).first()[0] == want


@pytest.mark.parametrize("current, told, want", [("v1.0.0", ["v1.0.1", "v1.0.0"], "v1.0.1"), ("v1.0.1", ["v1.0.1", "v0.9.0"], None), ("dev", ["v9.0.0"], None), ("v1.0.0", ["dev", ""], None), ("v1.0.0", [], None), ("v1.9.0", ["v1.10.0", "v1.9.9"], "v1.10.0")])
def test_target(spark, current, told, want):
    assert newest(spark.createDataFrame([(v,) for v in told], "version string"), current).first()["target"] == want


def test_small_functions(spark):
    row = spark.range(1).select(branch_name(F.lit(" HEAD\t")), branch_name(F.lit("\nmain ")), shorten(F.lit("0123456789")), digest_count(F.lit("12:ab")), peers.version_gap(F.lit("v1.0.0"), F.lit("v1.0.1")), peers.version_gap(F.lit("v1.0.0"), F.lit("dev")), peers.version_gap(F.lit("dev"), F.lit("x"))).first()
    assert tuple(row) == (None, "main", "01234567", 12, "  (newer than this node)", "  (older than this node)", "")


def test_empty_never_erases_an_attribute_but_is_a_lookups_answer(spark):
    df = spark.createDataFrame([("p", "host", "v1")], "peer_id string, hostname string, version string")
    told = spark.createDataFrame([("p", "", "v2")], "peer_id string, hostname string, version string")
    assert tuple(peers.merge_attributes(df, told).first()) == ("p", "host", "v2")
    names = spark.createDataFrame([("1.1.1.1", "a", "2026-01-01 00:00:00")], "ip string, hostname string, t string").select("ip", "hostname", F.to_timestamp("t").alias("resolved_at"))
    later = names.withColumn("hostname", F.lit("")).withColumn("resolved_at", F.expr("resolved_at + interval 1 hour"))
    assert peers.merge_hostnames(names, later).first()["hostname"] == ""


def test_status(spark):
    health = lambda *x: spark.createDataFrame([(r,) for r in x], "reach string")
    none = spark.createDataFrame([], "seq long")
    got = [peers.node_status(h, q).first()[0] for h, q in ((health("current", "never"), none), (health("stale"), none), (health("failing"), none), (health(), none), (health("current"), spark.range(1)))]
    assert got == ["ok", "degraded", "degraded", "ok", "degraded"]


def test_reports_say_how_long_ago_and_who(spark):
    df = spark.createDataFrame([(0, "p" * 12, "box"), (59, "q", ""), (60, "q", None), (3661, "q", ""), (90_000, "q", ""), (None, "q", "")], "s long, peer_id string, hostname string")
    got = [tuple(r) for r in df.select(peers.converged_ago("s"), peers.peer_label()).collect()]
    assert [a for a, _ in got] == [f", last converged {x} ago" for x in ("0s", "59s", "1m0s", "1h1m1s", "25h0m0s")] + [""]
    assert [b for _, b in got] == ["box (pppppppp)"] + ["q"] * 5


def test_a_first_outcome_makes_a_peer(spark):
    known = spark.createDataFrame([("a", ["h:1"], True, None, "old", None)], "peer_id string, addrs array<string>, static boolean, last_converged timestamp, last_error string, last_vector map<string,long>").withColumn("last_seen", F.expr(NOW))
    told = spark.createDataFrame([("b", "2026-01-01 11:00:00", None, "refused"), ("c", "2026-01-01 11:00:00", {"c": 3}, None), ("c", "2026-01-01 10:00:00", None, "earlier"), ("", "2026-01-01 11:00:00", None, "no id")], "peer_id string, t string, vector map<string,long>, error string").withColumn("at", F.to_timestamp("t"))
    got = {r["peer_id"]: r for r in peers.record_convergence(known, told).collect()}
    assert sorted(got) == ["a", "b", "c"] and (got["a"]["addrs"], got["a"]["static"], got["a"]["last_error"]) == (["h:1"], True, "old")
    assert (got["b"]["addrs"], got["b"]["static"], got["b"]["last_converged"], got["b"]["last_error"], got["b"]["last_vector"]) == ([], False, None, "refused", None)
    assert got["c"]["last_converged"] is not None and (got["c"]["last_error"], got["c"]["last_vector"]) == ("", {"c": 3})
    assert {r["peer_id"]: r["x"] for r in peers.record_convergence(known, told).select("peer_id", peers.reach(F.expr(NOW)).alias("x")).collect()} == {"a": "never", "b": "never", "c": "current"}


def test_a_node_without_peers_says_so(spark):
    none = spark.createDataFrame([], "origin_id string")
    assert peers.node_status(None, none).first()["status"] == "no-peering"
