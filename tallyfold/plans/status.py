"""The status report: one table of lines for people, made of the archive's counts, vector and peers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.peers import converged_ago, peer_label, version_gap

_WIDTH = 34


def status(records: DataFrame, vector: DataFrame, health: DataFrame, quarantined: DataFrame, pending: DataFrame, self_origin: str, version: str) -> DataFrame:
    """section, item, line: the report in order of section, item and line number n.

    Sections: counts, origins, peers, warnings. pending is reprocess.pending's row, health peers.peer_health's table. Only
    the counts read the archive; all else is a row for each machine.
    """
    pad = lambda name, x: F.concat(F.lit("  "), F.rpad(name, F.greatest(F.length(name), F.lit(_WIDTH)), F.lit(" ")), F.lit(" "), x)
    row = lambda section, item, n, text: F.struct(F.lit(section).alias("section"), (F.lit(item) if isinstance(item, (str, int)) else item).cast("string").alias("item"), F.lit(n).alias("n"), text.alias("line"))
    says = lambda name, value: F.concat(F.rpad(F.lit(name), 9, " "), value)

    counted = records.agg(F.count(F.lit(1)).alias("count")).crossJoin(pending.agg(F.first("pending").alias("pending")))  # one row each
    machines = vector.agg(F.count(F.lit(1)).alias("origins")).crossJoin(health.agg(F.count(F.lit(1)).alias("peers")))
    head = counted.crossJoin(machines).select(F.explode(F.array(
        row("1 counts", "", 0, says("origin", F.lit(self_origin))), row("1 counts", "", 1, says("version", F.lit(version))), row("1 counts", "", 2, says("records", F.col("count").cast("string"))),
        row("1 counts", "", 3, says("pending", F.concat(F.col("pending").cast("string"), F.lit(" records to re-read for newly extracted columns")))),
        row("2 origins", "", 0, says("origins", F.col("origins").cast("string"))), row("3 peers", "", 0, says("peers", F.col("peers").cast("string"))),
    )).alias("r"))

    mark = F.when(F.col("origin_id") == self_origin, "  (this node)").otherwise("")
    origins = vector.select(row("2 origins", F.col("origin_id"), 1, F.concat(F.lit("  "), F.col("origin_id"), F.lit("  up to "), F.col("seq").cast("string"), mark)).alias("r"))

    blank = F.lit("")
    told = lambda a: F.when(a.host == "", a.addr).otherwise(F.concat(a.host, F.lit(" ("), a.addr, F.lit(")")))
    where = F.when(F.size("addrs") > 0, F.array_join(F.transform("addrs", told), ", ")).otherwise("(no address)")
    lag = (F.coalesce("behind", F.lit(0)) > 0) | (F.coalesce("ahead", F.lit(0)) > 0)
    lines = F.array(
        row("3 peers", F.col("peer_id"), 1, pad(peer_label(), where)), row("3 peers", F.col("peer_id"), 2, pad(blank, F.concat("reach", converged_ago()))),
        F.when(F.coalesce("version", blank) != "", row("3 peers", F.col("peer_id"), 3, pad(blank, F.concat(F.lit("running "), F.col("version"), version_gap(F.lit(version), "version"))))),
        F.when(lag, row("3 peers", F.col("peer_id"), 4, pad(blank, F.concat(F.lit("behind "), F.coalesce("behind", F.lit(0)).cast("string"), F.lit(", ahead "), F.coalesce("ahead", F.lit(0)).cast("string"), F.lit(" as of that exchange"))))),
        F.when(F.coalesce("last_error", blank) != "", row("3 peers", F.col("peer_id"), 5, pad(blank, F.concat(F.lit("last error: "), F.col("last_error"))))),
    )
    peers = health.select(F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("r"))

    stalled = health.filter(F.col("reach").isin("failing", "stale")).agg(F.array_sort(F.collect_list("peer_id")).alias("ids")).filter(F.size("ids") > 0)
    warned = stalled.select(row("4 warnings", "converging", 0, F.concat(F.lit("WARNING: "), F.size("ids").cast("string"), F.lit(" peer(s) are not converging: "), F.array_join("ids", ", "))).alias("r"))
    held = quarantined.agg(F.count(F.lit(1)).alias("q")).filter("q > 0").select(row("4 warnings", "quarantine", 1, F.concat(F.lit("WARNING: "), F.col("q").cast("string"), F.lit(" quarantined records: two machines issue records under one origin id"))).alias("r"))

    out = head.unionByName(origins).unionByName(peers).unionByName(warned).unionByName(held).select("r.*")
    return out.orderBy("section", "item", "n")
