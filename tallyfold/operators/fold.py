"""One row for each API request."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import day_of, pick_key
from ..schema import USAGE

#: A fold reads these, and the sequence.
FOLDED = ["model", "session_id", "origin_id", "captured_at", "cwd", "git_branch", *USAGE]


def fold(records: DataFrame) -> DataFrame:
    """request_id, day and FOLDED of the line with the least pick key of each request; lines without request are left out. records: an archive, or its stored copy.

    Every column comes from that one line, so two replicas agree. Lines combine by request before the shuffle, and only
    the folded columns are read: never the body.
    """
    line = F.struct(*[F.col(c) for c in FOLDED])
    picked = records.filter(F.col("request_id").isNotNull()).groupBy("request_id").agg(F.min_by(line, pick_key()).alias("r"))
    return picked.select("request_id", day_of("r.captured_at").alias("day"), *[F.col(f"r.{c}").alias(c) for c in FOLDED if c != "captured_at"])


def narrow(records: DataFrame) -> DataFrame:
    """What a fold needs of records: those with a request, without bodies."""
    return records.filter(F.col("request_id").isNotNull()).select("request_id", "seq", *FOLDED)


def store_copy(records: DataFrame, path: str, buckets: int) -> DataFrame:
    """Write narrow(records) to path in buckets of request_id, each one file in its order, and open it: fold() of it moves and sorts nothing."""
    rows = narrow(records)
    _ordered(rows.sparkSession)
    rows.repartition(buckets, "request_id").sortWithinPartitions("request_id").write.bucketBy(buckets, "request_id").sortBy("request_id").option("path", path).saveAsTable(name := _table(path))
    return rows.sparkSession.table(name)


def open_copy(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """A copy that another session has stored."""
    _ordered(spark)
    columns = ", ".join(f"{c} {'BIGINT' if c in (*USAGE, 'seq') else 'STRING'}" for c in ("request_id", "seq", *FOLDED))
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_table(path)} ({columns}) USING parquet CLUSTERED BY (request_id) SORTED BY (request_id) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(_table(path))


def _table(path: str) -> str:
    return f"tallyfold_copy_{crc32(path.encode()):08x}"


def _ordered(spark: SparkSession) -> None:
    """Spark uses a bucket's order where the bucket is one file and this is set."""
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")


def model_totals(folded: DataFrame) -> DataFrame:
    """requests and token sums by raw model; a null model reads `unknown`."""
    sums = [F.sum(c).alias(c) for c in USAGE]
    return folded.groupBy(F.coalesce("model", F.lit("unknown")).alias("model")).agg(F.count(F.lit(1)).alias("requests"), *sums)


def daily_grid(folded: DataFrame) -> DataFrame:
    """Requests and tokens by day, model, origin, session, directory and branch; undated requests are left out."""
    keys = [F.coalesce(c, F.lit("unknown" if c == "model" else "")).alias(c) for c in ("model", "origin_id", "session_id", "cwd", "git_branch")]
    sums = [F.sum(c).alias(c) for c in USAGE if c != "think_tokens"]
    return folded.filter(F.col("day") != "").groupBy("day", *keys).agg(F.count(F.lit(1)).alias("requests"), *sums)
