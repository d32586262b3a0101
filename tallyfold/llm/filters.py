"""Operator 12: audit of how text filters interact, over all orders in which they can run. DataFrame functions only."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bit of each filter in a document's mask.
BITS = {"A": 1, "B": 2, "C": 4, "D": 8, "E": 16}
ORDERS = ["".join(p) for p in permutations(BITS)]
METRICS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

_BLANKS = " \t\n\x0b\x0c\r"


def failures(text: F.Column) -> F.Column:
    """The bits of A to D that a text fails: under 50 words; distinct words below 65 %; capitals above 5 % of code points; any of `#$%&*|`. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(F.translate(text, _BLANKS, " " * len(_BLANKS)), " "), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = {"A": F.size(words) < 50, "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words), "C": 100 * capitals > 5 * F.length(text), "D": F.translate(text, "#$%&*|", "") != text}
    bits = F.lit(0)
    for name, failed in fails.items():
        bits = bits + F.when(failed, BITS[name]).otherwise(0)
    return bits


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, n, n_good, n_toxic: how many documents of a part fail exactly the filters of mask, and how many of those are labelled good and toxic.

    Filter E: a smaller id has the same text (by 128 bits of hash), anywhere in the table. Texts are read once and stay where they are: what is
    stored and moves is an id, a part, four bits and a hash. Equal rows combine before they move, so neither a text nor a part that many documents share is gathered.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = common.keep(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), failures(F.col(text_col).cast("string")).alias("bits"), F.xxhash64(F.lit("t1"), text).alias("h1"), F.xxhash64(F.lit("t2"), text).alias("h2")), "masks")
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = narrow.join(marks, "id", "left").fillna(0, ["good", "toxic"]).groupBy("id", "part", "bits", "h1", "h2", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    first = rows.filter(F.col("id").isNotNull()).groupBy("h1", "h2").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    rows = rows.join(first, ["id", "h1", "h2"], "left").withColumn("mask", F.col("bits") + F.when(F.col("first").isNull() & F.col("id").isNotNull(), BITS["E"]).otherwise(0))
    return rows.groupBy("part", "mask").agg(*[F.sum(x).alias(c) for c, x in (("n", F.col("n")), ("n_good", F.col("n") * F.col("good")), ("n_toxic", F.col("n") * F.col("toxic")))])


def audit_cells(cells: DataFrame) -> DataFrame:
    """part, filter_order, step and METRICS of mask cells, a row for each part, order and step.

    Cells are unpivoted against the steps of all orders (at most 32 x 600 rows for each part, however many documents it has). A running bit-or over the
    steps before tells what an order has removed already; conditional sums over a step's masks give its counts, and a window over a part's filter adds
    what that filter removes in all orders.
    """
    steps = F.explode(F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(BITS[o[i]]).alias("bit")) for o in ORDERS for i in range(5)]))
    long = cells.select("part", "mask", "n", "n_good", "n_toxic", steps.alias("s")).select("part", "mask", "n", "n_good", "n_toxic", "s.*").withColumn("hit", F.col("mask").bitwiseAND(F.col("bit")))
    # dealt by part and order: that serves both the window over a cell's steps and the sums over a step's cells
    before = F.coalesce(F.bit_or("hit").over(Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    long = long.repartition("part", "filter_order").withColumn("before", before)
    gone, here = F.col("before") > 0, F.col("hit") > 0
    count = lambda when, x: F.sum(F.when(when, F.col(x)).otherwise(0)).cast("long")
    out = long.groupBy("part", "filter_order", "step", "bit").agg(
        count(~gone & ~here, "n").alias("kept"), count(~gone & here, "n").alias("removed"), count(gone & here, "n").alias("redundant"), count(F.col("mask") == F.col("bit"), "n").alias("unique_fails"),
        count(~gone & here, "n_good").alias("good_lost"), count(~gone & here, "n_toxic").alias("toxic_lost"),
    )
    out = out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit")))
    return out.select("part", "filter_order", "step", *METRICS)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order (the 120 permutations of ABCDE), step (1 to 5) and METRICS of every part: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null and empty texts have no words and fail A; null and empty parts are the part ''. Rows of a null id are documents, but of no label, and neither
    fail E nor make others fail it. Repeated rows count each; of rows that share an id and a text none is smaller than another. A document
    with several labels counts once, as good or toxic if any of them says so. Whole texts count, however long. An empty table gives no rows.
    """
    return audit_cells(mask_cells(docs, labels, id_col, text_col, part_col))
