"""Peers: merges, names, reach, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, empty_to_null, host_of, shorten
from ..functions.versions import compare

# Seconds without convergence after which a peer is stale; how long a named and an empty reverse lookup stay fresh.
STALE_S, NAMED_TTL_S, EMPTY_TTL_S = 3600, 12 * 3600, 3600
STATIC = "static:"


def merge_peers(peers: DataFrame, seen: DataFrame) -> DataFrame:
    """Upsert of (peer_id, addrs, last_seen, static): the latest addresses and time, static if it ever was; the rest stays."""
    new = seen.groupBy("peer_id").agg(F.max_by("addrs", "last_seen").alias("a"), F.max("last_seen").alias("s"), F.bool_or("static").alias("t"))
    out = peers.join(new, "peer_id", "full")
    either = F.coalesce("static", F.lit(False)) | F.coalesce("t", F.lit(False))
    return out.select("peer_id", F.coalesce("a", "addrs").alias("addrs"), F.coalesce("s", "last_seen").alias("last_seen"), either.alias("static"), *[c for c in peers.columns if c not in ("peer_id", "addrs", "last_seen", "static")])


def record_convergence(peers: DataFrame, outcomes: DataFrame) -> DataFrame:
    """outcomes: peer_id, at, vector (null on failure), error (null on success), the latest of each peer.

    Success clears the error and stores time and vector; failure stores the error and keeps both. Either refreshes last_seen.
    A peer first heard of here becomes a row without addresses that is not static. Outcomes without a peer id are left out.
    """
    o = outcomes.filter(empty_to_null("peer_id").isNotNull()).groupBy("peer_id").agg(F.max_by(F.struct("at", "vector", "error"), F.struct("at", "error")).alias("o"))
    j = peers.join(o, "peer_id", "full")
    won = F.col("o").isNotNull() & empty_to_null("o.error").isNull()
    new = {
        "addrs": F.coalesce("addrs", F.array().cast("array<string>")), "static": F.coalesce("static", F.lit(False)),
        "last_seen": F.coalesce("o.at", "last_seen"), "last_converged": F.when(won, F.col("o.at")).otherwise(F.col("last_converged")),
        "last_error": F.when(won, F.lit("")).otherwise(F.coalesce("o.error", "last_error")), "last_vector": F.when(won, F.coalesce("o.vector", "last_vector")).otherwise(F.col("last_vector")),
    }
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in peers.columns])


def merge_attributes(peers: DataFrame, told: DataFrame) -> DataFrame:
    """told: peer_id, hostname, version; an empty value never erases."""
    t = told.groupBy("peer_id").agg(F.max(empty_to_null("hostname")).alias("__h"), F.max(empty_to_null("version")).alias("__v"))
    j = peers.join(t, "peer_id", "left")
    new = {"hostname": F.coalesce("__h", "hostname"), "version": F.coalesce("__v", "version")}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in peers.columns])


def merge_hostnames(hostnames: DataFrame, answers: DataFrame) -> DataFrame:
    """The latest answer for each address; '' is an answer."""
    cols = ["ip", "hostname", "resolved_at"]
    return hostnames.select(*cols).unionByName(answers.select(*cols)).groupBy("ip").agg(F.max_by("hostname", F.struct("resolved_at", "hostname")).alias("hostname"), F.max("resolved_at").alias("resolved_at"))


def peer_names(peers: DataFrame, hostnames: DataFrame) -> DataFrame:
    """peer_id, name: the name a peer reports of itself, else that of its first address with one; null for none."""
    named = hostnames.filter("hostname <> ''").groupBy("ip").agg(F.max("hostname").alias("hostname")).withColumnRenamed("hostname", "found")
    at = peers.select("peer_id", F.posexplode("addrs").alias("pos", "addr")).withColumn("ip", host_of("addr"))
    first = at.join(named, "ip").groupBy("peer_id").agg(F.min_by("found", "pos").alias("found"))
    return peers.join(first, "peer_id", "left").select("peer_id", F.coalesce(empty_to_null("hostname"), "found").alias("name"))


def visible_peers(peers: DataFrame, self_id: str) -> DataFrame:
    """Peers other than ourselves, without placeholders of a configured address whose host answers under its own id; by id."""
    others = peers.filter(F.col("peer_id") != self_id)
    real = others.filter(~F.col("peer_id").startswith(STATIC)).select(F.explode("addrs").alias("addr")).select(host_of("addr").alias("__host")).distinct()
    held = others.filter(F.col("peer_id").startswith(STATIC)).withColumn("__host", host_of(F.substring("peer_id", len(STATIC) + 1, 1 << 20))).join(real, "__host", "left_anti").drop("__host")
    return others.filter(~F.col("peer_id").startswith(STATIC)).unionByName(held).orderBy("peer_id")


def reach(now: Column, converged: Column | str = "last_converged", error: Column | str = "last_error") -> Column:
    """never, failing, stale or current; a time ahead of ours counts as now.

    A peer that never converged reads `never` whatever its error says: a configured machine that is off is no failure. One that
    did and has an error reads `failing`, however long ago it did.
    """
    failing = F.coalesce(col(error), F.lit("")) != ""
    return F.when(col(converged).isNull(), "never").when(failing, "failing").when(age(now, converged) > STALE_S, "stale").otherwise("current")


def age(now: Column, converged: Column | str = "last_converged") -> Column:
    """Whole seconds since the last convergence, 0 at least; null if there was none."""
    return F.when(col(converged).isNotNull(), F.greatest(F.lit(0).cast("long"), F.unix_timestamp(now) - F.unix_timestamp(col(converged))))


def fresh_hostname(now: Column) -> Column:
    """Whether a reverse lookup needs no repeat yet."""
    age = F.unix_timestamp(now) - F.unix_timestamp("resolved_at")
    return age < F.when(F.coalesce("hostname", F.lit("")) != "", NAMED_TTL_S).otherwise(EMPTY_TTL_S)


def named_addresses(addrs: Column | str, names: Column) -> Column:
    """Each address with the name on record for its host: array<struct<addr, host>>. names: map<ip, hostname>."""
    return F.transform(col(addrs), lambda a: F.struct(a.alias("addr"), F.coalesce(F.try_element_at(names, host_of(a)), F.lit("")).alias("host")))


def peer_health(peers: DataFrame, vector: DataFrame, self_id: str, now: Column, hostnames: DataFrame | None = None) -> DataFrame:
    """A row for every visible peer, by id: its own attributes, reach, since_converged (seconds), behind, ahead.

    A peer that sent no vector has null lag. With hostnames, addrs holds the name on record beside each address.
    """
    seen = visible_peers(peers, self_id)
    theirs = seen.filter(F.col("last_vector").isNotNull()).select("peer_id", F.explode_outer("last_vector").alias("origin_id", "t"))
    ids = seen.filter(F.col("last_vector").isNotNull()).select("peer_id")
    mine = vector.select("origin_id", F.col("seq").alias("m"))
    # origins and peers are machines: their product is a table of some thousand rows at most
    pairs = ids.crossJoin(F.broadcast(mine)).join(theirs, ["peer_id", "origin_id"], "full")
    over = lambda a, b: F.sum(F.greatest(F.coalesce(F.col(a), F.lit(0)) - F.coalesce(F.col(b), F.lit(0)), F.lit(0)))
    gaps = pairs.groupBy("peer_id").agg(over("t", "m").alias("behind"), over("m", "t").alias("ahead"))
    if hostnames is None:
        names = seen.withColumn("addrs", named_addresses("addrs", F.create_map().cast("map<string,string>")))
    else:
        table = hostnames.groupBy("ip").agg(F.max("hostname").alias("hostname")).agg(F.map_from_entries(F.collect_list(F.struct("ip", "hostname"))).alias("__names"))  # addresses of machines: one row
        names = seen.crossJoin(F.broadcast(table)).withColumn("addrs", named_addresses("addrs", F.col("__names")))
    out = names.select("peer_id", "hostname", "version", "addrs", "static", "last_seen", "last_converged", "last_error", reach(now).alias("reach"), age(now).alias("since_converged"))
    return out.join(gaps, "peer_id", "left").orderBy("peer_id")


def node_status(health: DataFrame | None, quarantined: DataFrame) -> DataFrame:
    """One row, status: `degraded` with any quarantine, failing or stale peer, else `ok`; `no-peering` for a node that has no peers set up (None)."""
    if health is None:
        return quarantined.sparkSession.range(1).select(F.lit("no-peering").alias("status"))
    q = quarantined.agg((F.count(F.lit(1)) > 0).alias("q"))
    bad = health.agg(F.coalesce(F.bool_or(F.col("reach").isin("failing", "stale")), F.lit(False)).alias("bad"))
    return q.crossJoin(bad).select(F.when(F.col("q") | F.col("bad"), "degraded").otherwise("ok").alias("status"))  # one row each


def peer_label(peer_id: Column | str = "peer_id", hostname: Column | str = "hostname") -> Column:
    """What a report calls a peer: its name with the start of its id, or its id."""
    name = F.coalesce(col(hostname), F.lit(""))
    return F.when(name == "", col(peer_id)).otherwise(F.concat(name, F.lit(" ("), shorten(peer_id), F.lit(")")))


def span(seconds: Column | str) -> Column:
    """Seconds as 2h3m4s, without leading parts of 0."""
    s = col(seconds).cast("long")
    part = lambda x, unit: F.concat(x.cast("long").cast("string"), F.lit(unit))
    h, m = part(F.floor(s / 3600), "h"), part(F.floor(s % 3600 / 60), "m")
    return F.when(s >= 3600, F.concat(h, m, part(s % 60, "s"))).when(s >= 60, F.concat(m, part(s % 60, "s"))).otherwise(part(s, "s"))


def converged_ago(seconds: Column | str = "since_converged") -> Column:
    """A remark that follows a peer's reach; '' for one that never converged."""
    return F.coalesce(F.concat(F.lit(", last converged "), span(seconds), F.lit(" ago")), F.lit(""))


def version_gap(mine: Column | str, theirs: Column | str) -> Column:
    """A remark beside a peer's version: whether it is newer or older than ours; '' where neither can be said."""
    order = compare(mine, theirs)
    return F.when(order == "older", "  (newer than this node)").when(order == "newer", "  (older than this node)").otherwise("")
