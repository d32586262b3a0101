"""Extraction of columns from transcript lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import branch_name, content_hash, empty_to_null, strip
from ..schema import EXTRACTED, LINE

SYNTHETIC = "<synthetic>"


def parse(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """lines with __j: the parsed line, null for one that is not one JSON object of the known types.

    The object passes through a one-element explode: Spark moves no expression across it, so each line is parsed once and not
    once for each column that is taken from it.
    """
    parsed = lines.select("*", F.explode(F.array(F.from_json(F.col(value_col), LINE, {"columnNameOfCorruptRecord": "_corrupt"}))).alias("__j"))
    return parsed.withColumn("__j", F.when(F.col("__j._corrupt").isNull(), F.col("__j")))


def identify(lines: DataFrame, value_col: str = "value", readable: bool = False) -> DataFrame:
    """lines with the columns of schema.EXTRACTED: null for what a line lacks, 0 for token counts.

    A line that is not one JSON object of the known types yields no columns at all. Request, model and tokens are filled
    on billable lines only: assistant lines with a model other than the synthetic one, a usage object and a request id.
    With readable, a line without an object is left out instead.
    """
    j = F.col("__j")
    parsed = parse(lines.drop(*EXTRACTED), value_col)
    if readable:
        parsed = parsed.filter(j.isNotNull())
    usage = j["message"]["usage"]
    model = strip(j["message"]["model"])
    billable = F.coalesce((j["type"] == "assistant") & (model != "") & (model != SYNTHETIC) & usage.isNotNull() & (j["requestId"] != ""), F.lit(False))
    link = F.coalesce((j["type"] == "pr-link") & (j["prRepository"] != "") & (j["prNumber"] > 0), F.lit(False))
    parsed = parsed.withColumn("__b", billable).withColumn("__l", link)
    tokens = {
        "input_tokens": usage["input_tokens"], "output_tokens": usage["output_tokens"], "think_tokens": usage["output_tokens_details"]["thinking_tokens"],
        "cache_read": usage["cache_read_input_tokens"], "cache_write5m": usage["cache_creation"]["ephemeral_5m_input_tokens"], "cache_write1h": usage["cache_creation"]["ephemeral_1h_input_tokens"],
    }
    out = {
        "session_id": empty_to_null(j["sessionId"]), "line_uuid": empty_to_null(j["uuid"]), "captured_at": empty_to_null(j["timestamp"]),
        "request_id": F.when(F.col("__b"), j["requestId"]), "model": F.when(F.col("__b"), model),
        **{k: F.when(F.col("__b"), F.coalesce(v, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")) for k, v in tokens.items()},
        "pr_repo": F.when(F.col("__l"), j["prRepository"]), "pr_number": F.when(F.col("__l"), j["prNumber"]),
        "cwd": empty_to_null(strip(j["cwd"])), "git_branch": branch_name(j["gitBranch"]),
    }
    return parsed.withColumns(out).drop("__j", "__b", "__l")


def to_records(lines: DataFrame, source: str, value_col: str = "value") -> DataFrame:
    """Lines (path, byte_offset, value) as fact rows without origin and sequence, the body kept in `sealed`."""
    out = identify(lines, value_col)
    return out.select(F.lit(source).alias("source"), "path", "byte_offset", content_hash(value_col).alias("content_hash"), *EXTRACTED, F.col(value_col).alias("sealed"))
