"""Set algebra between replicas: version vectors, bucket digests, lag, what to resend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import keep

BUCKET = 1000
#: Origins that are sent to where the records lie, at most: a machine each.
BROADCAST_ORIGINS = 100_000


def by_origin(records: DataFrame, facts: DataFrame, how: str = "left") -> DataFrame:
    """records joined with a row for each origin. That side is stored and counted, and sent to the records unless it is large: origins are few and their records many, so a shuffle by origin would gather them."""
    facts = keep(facts, "by-origin")
    return records.join(F.broadcast(facts) if facts.count() <= BROADCAST_ORIGINS else facts, "origin_id", how)


def version_vector(records: DataFrame, self_origin: str | None = None) -> DataFrame:
    """origin_id, seq: the highest of each origin; our own origin is there even without records, at 0."""
    vector = records.groupBy("origin_id").agg(F.max("seq").alias("seq"))
    if self_origin is None:
        return vector
    own = records.sparkSession.range(1).select(F.lit(self_origin).alias("origin_id"), F.lit(0).cast("long").alias("seq"))
    return vector.unionByName(own).groupBy("origin_id").agg(F.max("seq").alias("seq"))


def bucket_digests(records: DataFrame) -> DataFrame:
    """origin_id, bucket, digest `count:sha256` over `seq:hash\\n` in order. A bucket holds 1000 sequences at most."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("seq", "content_hash"))), lambda x: F.concat(x.seq.cast("string"), F.lit(":"), x.content_hash, F.lit("\n")))
    return records.groupBy("origin_id", F.expr(f"(seq - 1) div {BUCKET}").alias("bucket")).agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(":"), F.sha2(F.array_join(line, ""), 256)).alias("digest"))


def lag(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """behind, ahead: sums of what a peer's vector has beyond mine, and mine beyond its."""
    both = mine.select("origin_id", F.col("seq").alias("m")).join(theirs.select("origin_id", F.col("seq").alias("t")), "origin_id", "full")
    over = lambda a, b: F.coalesce(F.sum(F.greatest(F.coalesce(F.col(a), F.lit(0)) - F.coalesce(F.col(b), F.lit(0)), F.lit(0))), F.lit(0))
    return both.agg(over("t", "m").alias("behind"), over("m", "t").alias("ahead"))


def mismatches(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """origin_id, from_seq: 1000 times the lowest bucket of equal count and other content."""
    a, b = mine.select("origin_id", "bucket", F.col("digest").alias("d1")), theirs.select("origin_id", "bucket", F.col("digest").alias("d2"))
    same = F.substring_index("d1", ":", 1) == F.substring_index("d2", ":", 1)
    return a.join(b, ["origin_id", "bucket"]).filter(same & (F.col("d1") != F.col("d2"))).groupBy("origin_id").agg((F.min("bucket") * BUCKET).alias("from_seq"))


def resend_plan(vector: DataFrame, peer_vector: DataFrame, differing: DataFrame) -> DataFrame:
    """origin_id, after, upto: what to send a peer: all after its sequence, or from a differing bucket if that is lower."""
    have = vector.select("origin_id", F.col("seq").alias("upto"))
    plan = have.join(peer_vector.select("origin_id", F.col("seq").alias("p")), "origin_id", "left").join(differing, "origin_id", "left")
    after = F.least(F.coalesce("p", F.lit(0)), F.coalesce("from_seq", F.coalesce("p", F.lit(0))))
    return plan.select("origin_id", after.cast("long").alias("after"), "upto").filter("after < upto")


def to_resend(records: DataFrame, plan: DataFrame) -> DataFrame:
    """The records of a plan, which has a row for each origin."""
    return by_origin(records, plan, "inner").filter("seq > after").drop("after", "upto")
