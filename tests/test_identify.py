"""Extraction: what each kind of transcript line yields."""

import json

import pytest
from pyspark.sql import functions as F

from tallyfold.operators.fold import fold
from tallyfold.operators.identify import identify
from tallyfold.plans.summary import summary_totals
from tallyfold.sources import prices

NUMBERS = dict(zip(["input_tokens", "output_tokens", "think_tokens", "cache_read", "cache_write5m", "cache_write1h"], [901, 17, 5, 40_000, 300, 2]))
NO_NUMBERS = dict.fromkeys(NUMBERS, 0)
COLUMNS = ["session_id", "line_uuid", "request_id", "model", *NUMBERS, "cwd", "git_branch", "pr_repo", "pr_number"]


def line(kind, session="S", uuid=None, **more):
    return {"type": kind, "sessionId": session, **({"uuid": uuid, "timestamp": "2031-05-06T07:08:09Z"} if uuid else {}), **more}


def usage(n):
    return {
        "input_tokens": n["input_tokens"], "output_tokens": n["output_tokens"], "cache_read_input_tokens": n["cache_read"], "output_tokens_details": {"thinking_tokens": n["think_tokens"]},
        "cache_creation": {"ephemeral_5m_input_tokens": n["cache_write5m"], "ephemeral_1h_input_tokens": n["cache_write1h"]},
    }


def answer(uuid, request="Q1", model="claude-haiku-4-5", use=usage(NUMBERS), **more):
    return line("assistant", uuid=uuid, requestId=request, message={"model": model, **({"usage": use} if use is not None else {})}, **more)


#: (rule, line, the columns that are neither null nor 0).
CASES = [
    ("an answer is billed", answer("a", cwd="/w/loom", gitBranch="main"), {"line_uuid": "a", "request_id": "Q1", "model": "claude-haiku-4-5", **NUMBERS, "cwd": "/w/loom", "git_branch": "main"}),
    ("its next line says the same again", answer("b"), {"line_uuid": "b", "request_id": "Q1", "model": "claude-haiku-4-5", **NUMBERS}),
    ("counts that are left out are 0", answer("c", "Q2", use={"output_tokens": 3}), {"line_uuid": "c", "request_id": "Q2", "model": "claude-haiku-4-5", "output_tokens": 3}),
    ("a synthetic answer is not billed", answer("d", "Q3", "<synthetic>"), {"line_uuid": "d"}),
    ("nor one without usage", answer("e", "Q3", use=None), {"line_uuid": "e"}),
    ("nor one without a request", answer("f", None), {"line_uuid": "f"}),
    ("nor a prompt", {**answer("g", "Q3"), "type": "user"}, {"line_uuid": "g"}),
    ("a model's name is trimmed", answer("h", "Q4", " claude-opus-5\n"), {"line_uuid": "h", "request_id": "Q4", "model": "claude-opus-5", **NUMBERS}),
    ("a detached head is no branch", line("user", uuid="i", cwd=" E:\\loom ", gitBranch="HEAD"), {"line_uuid": "i", "cwd": "E:\\loom"}),
    ("a link names a pull request", line("pr-link", uuid="j", prRepository="x/loom", prNumber=31), {"line_uuid": "j", "pr_repo": "x/loom", "pr_number": 31}),
    ("a link without number does not", line("pr-link", uuid="k", prRepository="x/loom"), {"line_uuid": "k"}),
    ("nor does another line", line("user", uuid="l", prRepository="x/loom", prNumber=31), {"line_uuid": "l"}),
    ("a sidecar has a session only", line("mode"), {}),
    ("an empty session is none", line("mode", ""), {"session_id": None}),
]


def test_what_lines_yield(spark):
    df = spark.createDataFrame([(i, json.dumps(v)) for i, (_, v, _) in enumerate(CASES)], "i int, value string")
    got = {r["i"]: {c: r[c] for c in COLUMNS} for r in identify(df).collect()}
    for i, (rule, _, some) in enumerate(CASES):
        assert got[i] == {**dict.fromkeys(COLUMNS), **NO_NUMBERS, "session_id": "S", **some}, rule


def test_a_line_is_parsed_once(spark):
    plan = identify(spark.createDataFrame([("{}",)], "value string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


@pytest.mark.parametrize("value", ["", "not json", "[1]", '{"type": "pr-link", "sessionId": "s", "prRepository": "a/b", "prNumber": "3"}', None])
def test_unreadable_lines_yield_nothing(spark, value):
    row = identify(spark.createDataFrame([(value,)], "value string")).first()
    assert all(row[c] in (None, 0) for c in COLUMNS)


def test_an_empty_usage_object_is_billable_and_a_missing_one_is_not(spark):
    rows = [json.dumps(line("assistant", uuid=f"u{i}", requestId="r", message=m)) for i, m in enumerate([{"model": "m", "usage": {}}, {"model": "m"}, {"model": "", "usage": {}}])]
    got = identify(spark.createDataFrame([(r,) for r in rows], "value string")).select("line_uuid", "request_id").collect()
    assert dict(map(tuple, got)) == {"u0": "r", "u1": None, "u2": None}


def test_requests_are_counted_once(spark):
    df = spark.createDataFrame([("a", i + 1, json.dumps(v)) for i, (_, v, _) in enumerate(CASES)], "origin_id string, seq long, value string")
    row = summary_totals(identify(df), prices.load(spark)).first()
    assert (row["requests"], row["assistant_lines"], row["lines"]) == (3, 4, len(CASES))
    assert row["inflation"] == pytest.approx(4 / 3)


def test_fold_takes_the_least_origin_and_sequence_whatever_the_order(spark):
    rows = [("ab", 1, "r", 10), ("ab0", 1, "r", 20), ("b", 10, "q", 5), ("b", 9, "q", 6)]
    base = spark.createDataFrame(rows, "origin_id string, seq long, request_id string, input_tokens long")
    for c in ("model", "session_id", "captured_at", "cwd", "git_branch"):
        base = base.withColumn(c, F.lit(None).cast("string"))
    for c in ("output_tokens", "think_tokens", "cache_read", "cache_write5m", "cache_write1h"):
        base = base.withColumn(c, F.col("input_tokens"))
    want = {"r": 20, "q": 6}  # 'ab0:' sorts before 'ab:'
    for df in (base, base.orderBy(F.desc("input_tokens")), base.repartition(3, "seq")):
        got = fold(df).collect()
        assert {r["request_id"]: r["input_tokens"] for r in got} == want
        assert all(r["output_tokens"] == r["input_tokens"] and r["day"] == "" for r in got)


def test_reports_never_read_bodies(spark, tmp_path):
    from tallyfold.operators.fold import daily_grid
    from tallyfold.operators.pricing import price
    from tallyfold.schema import RECORDS

    spark.createDataFrame([], RECORDS).write.parquet(str(tmp_path / "r"))
    df = spark.read.parquet(str(tmp_path / "r"))
    plan = price(daily_grid(fold(df)), prices.load(spark))._jdf.queryExecution().toString()
    scans = [x for x in plan.split("\n") if "ReadSchema" in x]
    assert scans and all("sealed" not in x.split("ReadSchema")[1] for x in scans) and any("IsNotNull(request_id)" in x for x in scans)
