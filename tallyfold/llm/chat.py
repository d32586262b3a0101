"""Operator 6: chat formatting after cumulative-snapshot collapse. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

START, END = "<|im_start|>", "<|im_end|>"


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n_turns, n_copies, rendered: the maximal conversations, rendered with role markers.

    A conversation is its rows in order of turn, role, text (nulls first). One that equals the first turns of a
    longer one is dropped; of equal ones the smallest conv_id stays and n_copies counts them. Null roles and texts
    render as empty but differ from empty ones in the comparison. Turn numbers only order: gaps and ties do not
    matter, repeated rows are turns of their own. Rows without conv_id belong to no conversation and are left
    out. An empty table gives no rows.

    Prefixes are compared by 128-bit hashes: a running exclusive-or over the turns' hashes, each with the turn's place. They
    are stored once, without texts. All conversations' last hashes meet in an aggregation; the hashes of proper prefixes are
    distinct before they meet, so common first turns combine before the shuffle. Only maximal conversations are rendered.
    """
    turns = df.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("t"), F.col(role_col).cast("string").alias("r"), F.col(text_col).cast("string").alias("x"))
    order = Window.partitionBy("conv_id").orderBy("t", "r", "x")
    piece = F.concat(F.coalesce(F.concat(F.lit("+"), F.length("r").cast("string"), F.lit(":"), F.col("r")), F.lit("-")), F.coalesce(F.concat(F.lit("+"), F.col("x")), F.lit("-")))
    placed = turns.select("conv_id", "t", "r", "x", *[F.xxhash64(F.lit(seed), piece).alias(seed) for seed in ("p1", "p2")]).withColumn("k", F.row_number().over(order).cast("long"))
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = placed.withColumns({h: F.bit_xor(F.xxhash64("k", p)).over(up_to) for h, p in (("h1", "p1"), ("h2", "p2"))}).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    hashes = common.keep(rolled.select("conv_id", "k", "n", "h1", "h2"), "turn-hashes")
    prefixes = hashes.filter("k < n").select(F.col("k").alias("n"), "h1", "h2").distinct()
    whole = hashes.filter("k = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    kept = whole.join(prefixes, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")
    said = turns.join(kept, "conv_id").groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("t", "r", "x"))).alias("turns"))
    rendered = F.concat_ws("", F.transform("turns", lambda x: F.concat(F.lit(START), F.coalesce(x.r, F.lit("")), F.lit("\n"), F.coalesce(x.x, F.lit("")), F.lit(END + "\n"))))
    return said.select("conv_id", "n_turns", "n_copies", rendered.alias("rendered"))
