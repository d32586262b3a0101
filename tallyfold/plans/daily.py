"""The daily report: cost by day, divided six ways whose parts always sum to the day."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import empty_to_null, pull_request_key, repo_name, shorten
from ..operators.fold import daily_grid, fold
from ..operators.pricing import MONEY, dollars, less, price
from ..operators.projects import resolve
from ..shared import keep

# The two keys that are no category, and how many named segments a dimension has.
NONE, OTHER, MAX_SEGMENTS = "__none__", "__other__", 6


@dataclass(frozen=True)
class Dimension:
    """One way of dividing a day: keys (null or empty: none) are an array of equal weights."""

    stack: str
    label: str
    keys: Callable[[], Column]
    none_label: str


def _one(name: str) -> Callable[[], Column]:
    return lambda: F.filter(F.array(empty_to_null(name)), lambda x: x.isNotNull())


#: In order of legends. One more dimension is one more row.
DIMENSIONS = [
    Dimension("model", "Model", _one("model"), "Unattributed"),
    Dimension("project", "Project", _one("project"), "No project"),
    Dimension("branch", "Branch", _one("git_branch"), "No branch"),
    Dimension("pull_request", "Pull request", lambda: F.coalesce("pull_requests", F.array().cast("array<string>")), "No pull request"),
    Dimension("session", "Session", _one("session_id"), "No session"),
    Dimension("peer", "Machine", _one("origin_id"), "Unattributed"),
]


@dataclass(frozen=True)
class Report:
    """The stored tables that every part of the daily report is made of; the archive is read for the first two only."""

    grid: DataFrame  # fold.daily_grid with priced, cost_usd (MONEY)
    links: DataFrame  # session_links()
    cost: DataFrame  # costs()
    segments: DataFrame  # legend()


def priced_grid(records: DataFrame, prices: DataFrame, folding: DataFrame | None = None) -> DataFrame:
    """The daily grid with costs: the one fold of a report, over the archive or its stored copy. Stored, as every part is made of it."""
    return keep(price(daily_grid(fold(records if folding is None else folding)), prices), "grid")


def report(records: DataFrame, prices: DataFrame, suffixes: list[str] | None = None, dimensions: list[Dimension] | None = None, folding: DataFrame | None = None) -> Report:
    """Fold once, then derive costs and legend from the grid; each is stored before the next needs it several times."""
    grid, links = priced_grid(records, prices, folding), keep(session_links(records), "links")
    cost = keep(costs(grid, links, suffixes, dimensions), "costs")
    return Report(grid, links, cost, keep(legend(cost), "legend"))


def days(grid: DataFrame) -> DataFrame:
    """day, requests, output_tokens, cost_usd of a priced grid, by day. Unpriced models count but cost nothing."""
    return grid.groupBy("day").agg(F.sum("requests").alias("requests"), F.sum("output_tokens").alias("output_tokens"), dollars(F.sum("cost_usd")).alias("cost_usd")).orderBy("day")


def session_links(records: DataFrame) -> DataFrame:
    """session_id, pull_requests, repos: sorted sets. A session's pull requests are the few that it opened."""
    links = records.filter(F.col("pr_repo").isNotNull() & F.col("session_id").isNotNull())
    return links.groupBy("session_id").agg(F.array_sort(F.collect_set(pull_request_key())).alias("pull_requests"), F.array_sort(F.collect_set("pr_repo")).alias("repos"))


def directory_repos(grid: DataFrame, links: DataFrame) -> DataFrame:
    """cwd, repos: what the sessions that ran in a directory shipped to."""
    ran = grid.select("cwd", "session_id").filter("session_id <> ''").distinct()
    return ran.join(links, "session_id").select("cwd", F.explode("repos").alias("repo")).groupBy("cwd").agg(F.array_sort(F.collect_set("repo")).alias("repos"))


def projects(grid: DataFrame, links: DataFrame, suffixes: list[str] | None = None) -> DataFrame:
    """cwd, project of every directory in the daily grid."""
    return resolve(grid.select("cwd").distinct(), directory_repos(grid, links), suffixes)


def session_projects(grid: DataFrame, links: DataFrame, suffixes: list[str] | None = None) -> DataFrame:
    """session_id, project: the only project of a session's directories, else its only repository's name; else no row."""
    seen = grid.filter("session_id <> ''").select("session_id", "cwd").distinct()
    ran = seen.join(projects(grid, links, suffixes), "cwd").filter("project <> ''").groupBy("session_id").agg(F.countDistinct("project").alias("n"), F.min("project").alias("p"))
    shipped = links.filter(F.size("repos") == 1).select("session_id", repo_name(F.element_at("repos", 1)).alias("r"))
    out = ran.join(shipped, "session_id", "full")
    return out.select("session_id", F.coalesce(F.when(F.col("n") == 1, F.col("p")), F.col("r")).alias("project")).filter(F.col("project").isNotNull())


def costs(grid: DataFrame, links: DataFrame, suffixes: list[str] | None = None, dimensions: list[Dimension] | None = None) -> DataFrame:
    """stack, day, key, cost_usd (MONEY): every priced cell of the grid divided by each dimension at once.

    One grid serves all dimensions. Directories and links are small against records and joined as Spark measures them.
    """
    wide = grid.filter("priced").join(projects(grid, links, suffixes), "cwd", "left").join(links.select("session_id", "pull_requests"), "session_id", "left")
    each = F.array(*[F.struct(F.lit(d.stack).alias("stack"), d.keys().alias("keys")) for d in dimensions or DIMENSIONS])
    long = wide.select("day", "cost_usd", F.explode(each).alias("d")).select("day", "cost_usd", F.col("d.stack").alias("stack"), F.when(F.size("d.keys") > 0, F.col("d.keys")).otherwise(F.array(F.lit(NONE))).alias("keys"))
    part = (F.col("cost_usd") / F.size("keys").cast("decimal(10,0)")).cast(MONEY)
    return long.select("stack", "day", F.explode("keys").alias("key"), part.alias("c")).groupBy("stack", "day", "key").agg(F.sum("c").cast(MONEY).alias("cost_usd"))


def ranked(cost: DataFrame) -> DataFrame:
    """stack, key, total_usd, rank over the whole range: cost first, then key. Totals are exact, so equal costs tie by key everywhere."""
    totals = cost.groupBy("stack", "key").agg(F.sum("cost_usd").cast(MONEY).alias("total_usd"))
    # six partitions at most, but Spark keeps only the first rows of each before the shuffle (rank limit below)
    return totals.withColumn("rank", F.row_number().over(Window.partitionBy("stack").orderBy(F.desc("total_usd"), F.asc("key"))))


def legend(cost: DataFrame) -> DataFrame:
    """stack, rank, key, total_usd: six segments of each dimension at most, and the rest as one, last, if it cost anything."""
    top = ranked(cost).filter((F.col("rank") <= MAX_SEGMENTS) & (F.col("key") != OTHER))
    totals = cost.groupBy("stack").agg(F.sum("cost_usd").cast(MONEY).alias("all"))
    rest = totals.join(top.groupBy("stack").agg(F.sum("total_usd").cast(MONEY).alias("named")), "stack", "left").select("stack", F.lit(MAX_SEGMENTS + 1).alias("rank"), F.lit(OTHER).alias("key"), less("all", F.coalesce("named", F.lit(0).cast(MONEY))).alias("total_usd")).filter("total_usd > 0")
    return top.select("stack", "rank", "key", "total_usd").unionByName(rest).withColumn("total_usd", dollars("total_usd"))


def shares(cost: DataFrame, segments: DataFrame) -> DataFrame:
    """stack, day, rank, key, cost_usd: each day's parts in order of the legend; parts of 0 are left out."""
    named = F.broadcast(segments.filter(F.col("key") != OTHER).select("stack", "key", "rank"))  # seven rows for each of six dimensions at most
    part = cost.join(named, ["stack", "key"], "left")
    part = part.select("stack", "day", F.coalesce("rank", F.lit(MAX_SEGMENTS + 1)).alias("rank"), F.when(F.col("rank").isNull(), OTHER).otherwise(F.col("key")).alias("key"), "cost_usd")
    return part.groupBy("stack", "day", "rank", "key").agg(dollars(F.sum("cost_usd")).alias("cost_usd")).filter("cost_usd <> 0")


def labelled(segments: DataFrame, sessions: DataFrame, peers: DataFrame, self_origin: str, dimensions: list[Dimension] | None = None) -> DataFrame:
    """segments with a label for people. sessions: session_id, project. peers: peer_id, name.

    Of sessions and peers only those in the legend are joined: a semi-join keeps them few before they are sent.
    """
    key = F.col("key")
    s = segments.join(sessions.join(F.broadcast(segments.filter("stack = 'session'").select(F.col("key").alias("session_id"))), "session_id", "left_semi").select(F.lit("session").alias("stack"), F.col("session_id").alias("key"), "project"), ["stack", "key"], "left")
    s = s.join(peers.select(F.lit("peer").alias("stack"), F.col("peer_id").alias("key"), F.col("name").alias("peer_name")), ["stack", "key"], "left")
    none = F.lit("Unattributed")
    for d in dimensions or DIMENSIONS:
        none = F.when(F.col("stack") == d.stack, d.none_label).otherwise(none)
    session = F.when(F.coalesce("project", F.lit("")) != "", F.concat(shorten(key), F.lit(" · "), F.col("project"))).otherwise(shorten(key))
    peer = F.when(key == self_origin, "this machine").when(F.coalesce("peer_name", F.lit("")) != "", F.col("peer_name")).otherwise(shorten(key))
    label = F.when(key == NONE, none).when(key == OTHER, "Other").when(F.col("stack") == "session", session).when(F.col("stack") == "peer", peer).otherwise(key)
    return s.select("stack", "rank", "key", label.alias("label"), "total_usd")


def activity(made: Report) -> DataFrame:
    """One row for each day with its shares nested: day, requests, output_tokens, cost_usd, shares map<stack, array<struct<key, cost_usd>>>."""
    parts = shares(made.cost, made.segments).groupBy("day", "stack").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key", "cost_usd"))), lambda x: F.struct(x.key.alias("key"), x.cost_usd.alias("cost_usd"))).alias("parts"))
    nested = parts.groupBy("day").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stack", "parts")))).alias("shares"))
    return days(made.grid).join(nested, "day", "left").orderBy("day")
