"""Properties of the reports over the surrogate records."""

import pytest
from pyspark.sql import functions as F

from tallyfold import queries
from tallyfold.plans import daily, delivery, summary
from tallyfold.sources import prices, surrogate


@pytest.fixture(scope="module")
def records(spark, small):
    return surrogate.records(spark, small).cache()


@pytest.fixture(scope="module")
def made(spark, records):
    return daily.report(records, prices.load(spark))


@pytest.fixture(scope="module")
def cost(made):
    return made.cost


def test_every_stack_sums_to_the_day(made):
    want = {r["day"]: r["cost_usd"] for r in daily.days(made.grid).collect()}
    for df in (made.cost, daily.shares(made.cost, made.segments)):
        sums = df.groupBy("stack", "day").agg(F.sum(F.col("cost_usd").cast("double")).alias("c")).collect()
        assert len({r["stack"] for r in sums}) == 6
        for r in sums:
            assert r["c"] == pytest.approx(want[r["day"]], abs=1e-9)


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_reports_read_stored_tables_a_few_times_and_the_archive_twice(spark, small, made, tmp_path):
    surrogate.records(spark, small).write.parquet(str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    assert scans(daily.shares(made.cost, made.segments)) <= 3 and scans(daily.activity(made)) <= 3 and scans(made.segments) == 1
    assert scans(daily.labelled(made.segments, made.links.select("session_id", F.lit("p").alias("project")), made.links.select(F.col("session_id").alias("peer_id"), F.lit("n").alias("name")), "node0")) <= 4
    assert scans(delivery.pull_requests(stored, prices.load(spark))) == 2


def test_a_legend_has_six_names_and_the_rest_last(cost):
    rows = daily.legend(cost).collect()
    for stack in {r["stack"] for r in rows}:
        own = sorted((r for r in rows if r["stack"] == stack), key=lambda r: r["rank"])
        named = [r for r in own if r["key"] != daily.OTHER]
        assert len(named) <= 6 and [r["total_usd"] for r in named] == sorted((r["total_usd"] for r in named), reverse=True)
        assert all(r["key"] != daily.OTHER for r in own[:-1])


def test_split_never_exceeds_spend(spark, records):
    whole = summary.summary_totals(records, prices.load(spark)).first()["total_cost_usd"]
    assert 0 < delivery.pull_requests(records, prices.load(spark)).agg(F.sum("cost_usd")).first()[0] <= whole


def test_a_session_of_three_pull_requests_splits_in_thirds(spark):
    rows = [("a", 1, "s", "r", None, None, 9), *[("a", 2 + i, "s", None, "o/x", i + 1, 0) for i in range(3)]]
    df = spark.createDataFrame(rows, "origin_id string, seq long, session_id string, request_id string, pr_repo string, pr_number long, input_tokens long")
    df = df.withColumns({c: F.lit(0).cast("long") for c in ("output_tokens", "think_tokens", "cache_read", "cache_write5m", "cache_write1h")}).withColumn("model", F.when(F.col("request_id").isNotNull(), "claude-opus-5"))
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("captured_at", "cwd", "git_branch")})
    got = delivery.delivery_totals(df).collect()
    assert sorted((r["pr_number"], r["input_tokens_share"], r["shared_requests"]) for r in got) == [(1, 3.0, 1), (2, 3.0, 1), (3, 3.0, 1)]
    assert delivery.attribution(df).first()["share"] == 1.0


def test_replicas_in_any_order_agree_to_the_last_bit(spark, records):
    p = prices.load(spark)
    reports = [lambda r: daily.days(daily.priced_grid(r, p)), lambda r: delivery.delivery_totals(r), lambda r: delivery.pull_requests(r, p), lambda r: summary.summary_totals(r, p)]
    for report in reports:
        a, b, c = (sorted(map(str, report(df).collect())) for df in (records, records.orderBy(F.rand(3)), records.repartition(7, "seq")))
        assert a == b == c


def test_thirds_of_a_token_add_up_to_whole_ones(spark):
    """A pull request that shares sessions with two, five and six others: 1/3 + 2/3 + 1/6 + 5/6 is 2, whatever the order."""
    from fractions import Fraction

    rows, links = [], []
    for s, (n, tokens) in enumerate([(3, 1), (3, 2), (6, 1), (6, 5), (7, 3), (41, 1)]):
        rows.append(("a", len(rows) + 1, f"s{s}", f"r{s}", "claude-opus-5", tokens))
        links += [(f"s{s}", "o/x", k) for k in range(1, n + 1)]
    base = spark.createDataFrame(rows, "origin_id string, seq long, session_id string, request_id string, model string, input_tokens long").withColumns({"pr_repo": F.lit(None).cast("string"), "pr_number": F.lit(None).cast("long")})
    more = spark.createDataFrame([("b", i + 1, *x) for i, x in enumerate(links)], "origin_id string, seq long, session_id string, pr_repo string, pr_number long").withColumns({"request_id": F.lit(None).cast("string"), "model": F.lit(None).cast("string"), "input_tokens": F.lit(0).cast("long")})
    df = base.unionByName(more).withColumns({c: F.lit(0).cast("long") for c in ("output_tokens", "think_tokens", "cache_read", "cache_write5m", "cache_write1h")}).withColumns({c: F.lit(None).cast("string") for c in ("captured_at", "cwd", "git_branch")})
    got = {r["pr_number"]: r["input_tokens_share"] for r in delivery.delivery_totals(df).collect()}
    want = {1: Fraction(1) + Fraction(1) + Fraction(3, 7) + Fraction(1, 41), 5: Fraction(1) + Fraction(3, 7) + Fraction(1, 41), 41: Fraction(1, 41)}
    assert all(got[k] == pytest.approx(float(v), abs=1e-12) for k, v in want.items())
    whole = {r["pr_number"]: r["sessions"] for r in delivery.pull_requests(df, prices.load(spark)).collect()}
    assert (whole[1], whole[5], whole[7], whole[41]) == (6, 4, 2, 1)


def test_an_empty_archive_has_empty_reports(spark, records):
    none, p = records.limit(0), prices.load(spark)
    assert summary.summary_totals(none, p).first()["requests"] == 0
    assert daily.activity(daily.report(none, p)).count() == 0 and delivery.pull_requests(none, p).count() == 0
    assert delivery.attribution(none).first()["share"] == 0.0


def test_activity_nests_what_shares_have(made):
    flat = {(r["day"], r["stack"], r["key"]): r["cost_usd"] for r in daily.shares(made.cost, made.segments).collect()}
    assert flat == {(r["day"], s, p["key"]): p["cost_usd"] for r in daily.activity(made).collect() for s, parts in r["shares"].items() for p in parts}


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


def test_usage_is_aggregated_before_it_meets_links(records):
    plan = delivery.delivery_totals(records)._jdf.queryExecution().optimizedPlan().toString()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in plan.split("\n") if "Join" in x]
    assert depth and "Aggregate [session_id" in plan


@pytest.mark.parametrize("name", ["model_totals", "pull_requests", "bucket_digests", "append_local", "append_remote", "reprocess_pass", "peer_health", "status_report", "convergence_record", "bundle_exchange", "bundle_fetch", "ledger_append", "ledger_digests", "exchange_round", "ledger_reprocess", "kept_grid", "labelled_segments", "activity"])
def test_queries_equal_their_sql(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "documents"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    got = con.execute(queries.SQL[name])
    names = [d[0] for d in got.description]
    rows = got.fetchall()
    df = queries.QUERIES[name](spark, small)
    assert sorted(df.columns) == sorted(names)
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted([show(r[c]) for c in names] for r in df.collect()) == sorted([show(v) for v in r] for r in rows)


def test_a_fold_of_the_stored_copy_moves_and_sorts_nothing(spark, records, tmp_path):
    from tallyfold.operators import fold

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        copy = fold.store_copy(records, str(tmp_path / "copy"), 4)
        plan = fold.fold(copy)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort [" not in plan and "sealed" not in plan and "SelectedBucketsCount: 4 out of 4" in plan
        key = lambda df: sorted(map(str, df.collect()))
        want = key(fold.fold(records))
        assert key(fold.fold(copy)) == want
        spark.sql(f"DROP TABLE {fold._table(str(tmp_path / 'copy'))}")
        again = fold.open_copy(spark, str(tmp_path / "copy"), 4)
        assert key(fold.fold(again)) == want and "Exchange" not in fold.fold(again)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    p = prices.load(spark)
    assert key(delivery.pull_requests(records, p, copy)) == key(delivery.pull_requests(records, p)) and key(summary.summary_totals(records, p, copy)) == key(summary.summary_totals(records, p))


@pytest.fixture
def long_archive(spark, small, monkeypatch):
    """The small archive with its later sequences beyond a million, as a large one has; answers an SQL text of the library's over it."""
    import duckdb

    rows = surrogate.archive(spark, small).withColumn("seq", F.when(F.col("seq") > 120, F.col("seq") + 999_880).otherwise(F.col("seq")))
    monkeypatch.setattr(queries, "R", lambda *_: rows)
    con = duckdb.connect()
    held = rows.toArrow()  # noqa: F841
    con.execute("CREATE TABLE archive AS SELECT * FROM held")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{small}/events.parquet'")
    yield lambda name: con.execute(queries.SQL[name].replace(surrogate.sql(surrogate.DUCKDB), "SELECT * FROM archive"))
    con.close()


@pytest.mark.parametrize("name", ["append_accounting", "append_remote", "archive_counts", "quarantine", "status_report"])
def test_records_held_elsewhere_displace_none_of_a_long_archive(name, spark, small, long_archive):
    said = long_archive(name)
    columns = [c[0] for c in said.description]
    assert sorted(map(tuple, queries.QUERIES[name](spark, small).select(*columns).collect())) == sorted(said.fetchall())
