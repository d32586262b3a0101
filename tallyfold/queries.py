"""One query for each operator of the library over the surrogate records, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import versions
from .operators import archive, fold, identify, peers, projects, replication, reprocess
from .plans import daily, delivery, status, summary
from .plans.kept import KeptGrid
from .operators.pricing import dollars
from .shared import keep, new_path
from .sources import bundles, prices, surrogate
from .sources.ledger import Ledger
from .streaming import exchange

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_SELF = "node0"
_NOW = "TIMESTAMP '2026-01-01 12:00:00'"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def R(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of sf_dir: surrogate records, stored once for each session, as an archive is."""
    return surrogate.archive(spark, sf_dir)


def N(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive's copy for folds."""
    return surrogate.folding(spark, sf_dir)


def _prices_sql() -> str:
    """Rates in millionths of a dollar per million tokens: 1e-12 dollars a token."""
    d = prices.DEFAULT_RATES
    unit = lambda x: round(x * 1e6)
    rows = ", ".join(f"('{i}', {unit(a)}, {unit(b)}, {unit(c if c is not None else a * d['cache_read'])}, {unit(a * d['cache_write_5m'])}, {unit(a * d['cache_write_1h'])})" for i, a, b, c in prices.RATES)
    return f"SELECT id, input::HUGEINT AS input, output::HUGEINT AS output, p_read::HUGEINT AS p_read, p_5m::HUGEINT AS p_5m, p_1h::HUGEINT AS p_1h FROM (VALUES {rows}) t(id, input, output, p_read, p_5m, p_1h)"


_SUMS = "CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write5m) AS BIGINT) AS cache_write5m, CAST(sum(cache_write1h) AS BIGINT) AS cache_write1h"
_NORM = "regexp_replace(split_part(trim(model), '[', 1), '-[0-9]{8}$', '')"
_COST = "coalesce(input_tokens * p.input + output_tokens * p.output + cache_read * p.p_read + cache_write5m * p.p_5m + cache_write1h * p.p_1h, 0)"
_UNCACHED = "coalesce((input_tokens + cache_read + cache_write5m + cache_write1h) * p.input + output_tokens * p.output, 0)"
_USD = "CAST({} AS DOUBLE) / 1e12".format
_PARTS = delivery.PARTS
_BASE = f"""
WITH records AS ({surrogate.sql(surrogate.DUCKDB)}),
folded AS (SELECT request_id, unnest(arg_min(struct_pack(model := model, session_id := session_id, origin_id := origin_id, day := substr(coalesce(captured_at, ''), 1, 10), cwd := cwd, git_branch := git_branch,
             input_tokens := input_tokens, output_tokens := output_tokens, think_tokens := think_tokens, cache_read := cache_read, cache_write5m := cache_write5m, cache_write1h := cache_write1h),
             origin_id || ':' || lpad(CAST(seq AS VARCHAR), 20, '0'))) FROM records WHERE request_id IS NOT NULL GROUP BY request_id),
prices AS ({_prices_sql()}),
models AS (SELECT coalesce(model, 'unknown') AS model, count(*) AS requests, {_SUMS}, CAST(sum(think_tokens) AS BIGINT) AS think_tokens FROM folded GROUP BY ALL),
priced AS (SELECT m.*, p.id IS NOT NULL AS priced, {_COST} AS units, {_UNCACHED} AS uncached FROM models m LEFT JOIN prices p ON {_NORM} = p.id),
grid AS (SELECT day, coalesce(model, 'unknown') AS model, coalesce(origin_id, '') AS origin_id, coalesce(session_id, '') AS session_id, coalesce(cwd, '') AS cwd, coalesce(git_branch, '') AS git_branch, count(*) AS requests, {_SUMS}
         FROM folded WHERE day <> '' GROUP BY ALL),
cells AS (SELECT g.*, p.id IS NOT NULL AS priced, {_COST} AS units FROM grid g LEFT JOIN prices p ON {_NORM} = p.id),
links AS (SELECT DISTINCT session_id, pr_repo, pr_number FROM records WHERE pr_repo IS NOT NULL AND session_id IS NOT NULL),
weights AS (SELECT session_id, count(*) AS pr_count FROM links GROUP BY session_id),
per_session AS (SELECT session_id, model, count(*) AS requests, {_SUMS} FROM folded WHERE session_id IS NOT NULL GROUP BY session_id, model),
split AS (SELECT pr_repo, pr_number, coalesce(model, 'unknown') AS model, CAST(sum(requests) AS BIGINT) AS requests, count(*) AS sessions, CAST(sum(CASE WHEN pr_count > 1 THEN requests ELSE 0 END) AS BIGINT) AS shared_requests,
            CAST(sum(output_tokens) AS BIGINT) AS output_total, {", ".join(f"sum({c} // pr_count) AS {c}_whole, sum(CAST({c} % pr_count * ({_PARTS} // pr_count) AS HUGEINT)) AS {c}_parts" for c in delivery.SPLIT)}
          FROM per_session JOIN links USING (session_id) JOIN weights USING (session_id) GROUP BY ALL),
named(cwd, project) AS (VALUES ('/srv/repo0', 'repo0'), ('/srv/repo0/out/build/rel', 'repo0'), (replace('D:/repo1/.claude/worktrees/issue-12', '/', chr(92)), 'repo1'), ('/srv/repo2-issue-15', 'repo2'), ('/', ''), ('/srv/widget-shop', 'widget-shop'), ('', '')),
prs AS (SELECT session_id, list_sort(list(DISTINCT pr_repo || '#' || CAST(pr_number AS VARCHAR))) AS pull_requests, list_sort(list(DISTINCT pr_repo)) AS repos FROM links GROUP BY session_id),
wide AS (SELECT c.*, project, coalesce(pull_requests, []) AS pull_requests FROM cells c LEFT JOIN named USING (cwd) LEFT JOIN prs USING (session_id) WHERE priced),
parts AS (SELECT day, units, unnest([{{'stack': 'model', 'keys': [model]}}, {{'stack': 'project', 'keys': [coalesce(nullif(project, ''), '__none__')]}}, {{'stack': 'branch', 'keys': [coalesce(nullif(git_branch, ''), '__none__')]}},
            {{'stack': 'pull_request', 'keys': CASE WHEN len(pull_requests) = 0 THEN ['__none__'] ELSE pull_requests END}}, {{'stack': 'session', 'keys': [coalesce(nullif(session_id, ''), '__none__')]}}, {{'stack': 'peer', 'keys': [origin_id]}}]) AS d FROM wide),
costs AS (SELECT stack, day, key, sum(c) AS units FROM (SELECT d.stack AS stack, day, unnest(d.keys) AS key, (2 * units + len(d.keys)) // (2 * len(d.keys)) AS c FROM parts) GROUP BY ALL),
ranks AS (SELECT *, row_number() OVER (PARTITION BY stack ORDER BY total DESC, key) AS rank FROM (SELECT stack, key, sum(units) AS total FROM costs GROUP BY ALL)),
segments AS (SELECT stack, rank, key, total FROM ranks WHERE rank <= 6
             UNION ALL SELECT stack, 7, '__other__', sum(total) FROM ranks WHERE rank > 6 GROUP BY stack HAVING sum(total) > 0),
vector AS (SELECT origin_id, max(seq) AS seq FROM records GROUP BY origin_id),
peer_records AS (SELECT origin_id, records.seq AS seq, CASE WHEN records.seq % 997 = 0 THEN sha256(content_hash) ELSE content_hash END AS content_hash FROM records JOIN vector v USING (origin_id) WHERE records.seq * 10 <= v.seq * 9 OR origin_id = 'node1'),
peer_vector AS (SELECT origin_id, max(seq) AS seq FROM peer_records WHERE origin_id <> 'node3' GROUP BY origin_id)
"""


def _digest_sql(table: str) -> str:
    return f"SELECT origin_id, bucket, CAST(count(*) AS VARCHAR) || ':' || sha256(string_agg(CAST(seq AS VARCHAR) || ':' || content_hash || chr(10), '' ORDER BY seq)) AS digest FROM (SELECT *, (seq - 1) // 1000 AS bucket FROM {table}) GROUP BY origin_id, bucket"


def _peer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replica that lags behind by a tenth of each origin but one, and differs in some records."""
    r = R(spark, sf_dir).select("origin_id", "seq", F.when(F.col("seq") % 997 == 0, F.sha2("content_hash", 256)).otherwise(F.col("content_hash")).alias("content_hash"))
    top = replication.version_vector(r).withColumnRenamed("seq", "__top")
    return r.join(F.broadcast(top), "origin_id").filter("seq * 10 <= __top * 9 or origin_id = 'node1'").drop("__top")  # a row for each origin


def _peer_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replication.version_vector(_peer_records(spark, sf_dir).filter("origin_id <> 'node3'"))


@query(f"{_BASE} SELECT * FROM records")
def records_view(spark, sf_dir):
    return R(spark, sf_dir)


@query(f"{_BASE} SELECT * FROM records")
def identify_lines(spark, sf_dir):
    """P1-P5: bodies made of the records, and the same columns extracted from them again."""
    rows = surrogate.bodies(R(spark, sf_dir)).select("origin_id", "seq", "source", "path", "byte_offset", "content_hash", F.col("sealed").alias("value"))
    return identify.identify(rows).drop("value")


@query(f"{_BASE} SELECT * FROM folded")
def request_fold(spark, sf_dir):
    return fold.fold(N(spark, sf_dir))


@query(f"{_BASE} SELECT * EXCLUDE (units, uncached), {_USD('units')} AS cost_usd, {_USD('uncached')} AS uncached_cost_usd FROM priced")
def model_totals(spark, sf_dir):
    return summary.summary_models(R(spark, sf_dir), prices.load(spark), N(spark, sf_dir))


@query(
    f"""{_BASE} SELECT CAST(sum(requests) AS BIGINT) AS requests, {_USD('sum(units)')} AS total_cost_usd, {_USD('sum(uncached)')} AS total_uncached_cost_usd, sum(cache_read)::DOUBLE / sum(cache_read + input_tokens + cache_write5m + cache_write1h) AS cache_hit_rate,
    list(model ORDER BY output_tokens DESC, model) FILTER (WHERE NOT priced) AS unpriced_models, (SELECT count(*) FROM records) AS lines, (SELECT count(request_id) FROM records) AS assistant_lines,
    {_USD('(sum(uncached) - sum(units))')} AS cache_savings_usd, (SELECT count(request_id) FROM records)::DOUBLE / sum(requests) AS inflation FROM priced"""
)
def summary_totals(spark, sf_dir):
    return summary.summary_totals(R(spark, sf_dir), prices.load(spark), N(spark, sf_dir))


@query(f"{_BASE} SELECT count(*) AS lines, count(request_id) AS assistant_lines FROM records")
def line_counts(spark, sf_dir):
    return summary.line_counts(R(spark, sf_dir))


@query(f"{_BASE} SELECT * FROM grid")
def daily_grid(spark, sf_dir):
    return fold.daily_grid(fold.fold(N(spark, sf_dir)))


@query(f"{_BASE} SELECT day, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, {_USD('sum(units)')} AS cost_usd FROM cells GROUP BY day")
def days(spark, sf_dir):
    return daily.days(daily.priced_grid(R(spark, sf_dir), prices.load(spark), N(spark, sf_dir)))


@query(f"{_BASE} SELECT * FROM per_session")
def session_model_totals(spark, sf_dir):
    return delivery.session_model_totals(fold.fold(N(spark, sf_dir)))


@query(f"{_BASE} SELECT * FROM weights")
def link_weights(spark, sf_dir):
    return delivery.link_weights(R(spark, sf_dir))


@query(f"{_BASE} SELECT pr_repo, pr_number, model, requests, sessions, shared_requests, output_total, {', '.join(f'{c}_whole::DOUBLE + {c}_parts::DOUBLE / {_PARTS}::DOUBLE AS {c}_share' for c in delivery.SPLIT)} FROM split")
def delivery_totals(spark, sf_dir):
    return delivery.delivery_totals(R(spark, sf_dir), N(spark, sf_dir))


@query(
    f"""{_BASE}, whole AS (SELECT pr_repo, pr_number, model, requests, shared_requests, output_total, {', '.join(f'{c}_whole + {c}_parts // {_PARTS} AS {c}' for c in delivery.SPLIT)} FROM split),
    c AS (SELECT pr_repo, pr_number, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(shared_requests) AS BIGINT) AS shared_requests, CAST(sum(output_total) AS BIGINT) AS output_tokens, {_USD(f'sum({_COST})')} AS cost_usd, bool_and(p.id IS NOT NULL) AS all_priced
          FROM whole LEFT JOIN prices p ON {_NORM} = p.id GROUP BY ALL),
    s AS (SELECT pr_repo, pr_number, count(*) AS sessions, count(*) FILTER (WHERE pr_count > 1) AS shared_sessions FROM links JOIN weights USING (session_id) WHERE session_id IN (SELECT session_id FROM per_session) GROUP BY ALL)
    SELECT * FROM c JOIN s USING (pr_repo, pr_number)"""
)
def pull_requests(spark, sf_dir):
    return delivery.pull_requests(R(spark, sf_dir), prices.load(spark), N(spark, sf_dir))


@query(f"{_BASE} SELECT count(*) FILTER (WHERE session_id IN (SELECT session_id FROM links)) AS attributed, count(*) AS total, count(*) FILTER (WHERE session_id IN (SELECT session_id FROM links))::DOUBLE / count(*) AS share FROM folded")
def attributed_share(spark, sf_dir):
    return delivery.attribution(R(spark, sf_dir), N(spark, sf_dir))


@query(f"{_BASE} SELECT cwd, project FROM named")
def project_resolution(spark, sf_dir):
    r = R(spark, sf_dir)
    return daily.projects(keep(fold.daily_grid(fold.fold(N(spark, sf_dir))), "grid"), daily.session_links(r))


@query(f"{_BASE} SELECT * FROM prs")
def session_links(spark, sf_dir):
    return daily.session_links(R(spark, sf_dir))


@query(
    f"""{_BASE}, ran AS (SELECT session_id, count(DISTINCT project) AS n, min(project) AS p FROM grid JOIN named USING (cwd) WHERE session_id <> '' AND project <> '' GROUP BY 1)
    SELECT session_id, coalesce(CASE WHEN n = 1 THEN p END, CASE WHEN len(repos) = 1 THEN split_part(repos[1], '/', 2) END) AS project FROM ran FULL JOIN prs USING (session_id)
    WHERE coalesce(CASE WHEN n = 1 THEN p END, CASE WHEN len(repos) = 1 THEN split_part(repos[1], '/', 2) END) IS NOT NULL"""
)
def session_projects(spark, sf_dir):
    r = R(spark, sf_dir)
    return daily.session_projects(keep(fold.daily_grid(fold.fold(N(spark, sf_dir))), "grid"), keep(daily.session_links(r), "links"))


def _report(spark, sf_dir) -> daily.Report:
    return daily.report(R(spark, sf_dir), prices.load(spark), folding=N(spark, sf_dir))


@query(f"{_BASE} SELECT stack, day, key, {_USD('units')} AS cost_usd FROM costs")
def stack_costs(spark, sf_dir):
    return _report(spark, sf_dir).cost.withColumn("cost_usd", dollars("cost_usd"))


@query(f"{_BASE} SELECT stack, CAST(rank AS INTEGER) AS rank, key, {_USD('total')} AS total_usd FROM segments")
def legend_segments(spark, sf_dir):
    return _report(spark, sf_dir).segments


_SHARES = f"""SELECT stack, day, CAST(rank AS INTEGER) AS rank, key, {_USD('sum(units)')} AS cost_usd
    FROM (SELECT c.stack, day, coalesce(s.rank, 7) AS rank, CASE WHEN s.key IS NULL THEN '__other__' ELSE c.key END AS key, units FROM costs c LEFT JOIN (SELECT * FROM segments WHERE key <> '__other__') s ON c.stack = s.stack AND c.key = s.key) GROUP BY ALL HAVING sum(units) <> 0"""


@query(f"{_BASE} {_SHARES}")
def day_shares(spark, sf_dir):
    made = _report(spark, sf_dir)
    return daily.shares(made.cost, made.segments)


@query(
    f"""{_BASE}, sp AS (SELECT session_id, coalesce(CASE WHEN n = 1 THEN p END, CASE WHEN len(repos) = 1 THEN split_part(repos[1], '/', 2) END) AS project
      FROM (SELECT session_id, count(DISTINCT project) AS n, min(project) AS p FROM grid JOIN named USING (cwd) WHERE session_id <> '' AND project <> '' GROUP BY 1) FULL JOIN prs USING (session_id))
    SELECT stack, CAST(rank AS INTEGER) AS rank, key, {_USD('total')} AS total_usd, CASE WHEN key = '__none__' THEN CASE stack WHEN 'project' THEN 'No project' WHEN 'branch' THEN 'No branch' WHEN 'pull_request' THEN 'No pull request' WHEN 'session' THEN 'No session' ELSE 'Unattributed' END
      WHEN key = '__other__' THEN 'Other' WHEN stack = 'session' THEN substr(key, 1, 8) || coalesce(' · ' || project, '') WHEN stack = 'peer' THEN CASE WHEN key = 'node0' THEN 'this machine' WHEN key = 'node1' THEN 'alpha' WHEN key = 'node2' THEN 'beta.lan' ELSE substr(key, 1, 8) END ELSE key END AS label
    FROM segments s LEFT JOIN sp ON s.stack = 'session' AND s.key = sp.session_id"""
)
def labelled_segments(spark, sf_dir):
    made = _report(spark, sf_dir)
    names = peers.peer_names(_peers(spark), _hostnames(spark))
    return daily.labelled(made.segments, keep(daily.session_projects(made.grid, made.links), "session-projects"), names, _SELF)


@query(
    f"""{_BASE}, shares AS ({_SHARES}), nested AS (SELECT day, list(stack || ':' || key ORDER BY stack, rank, key) AS share_keys, list(cost_usd ORDER BY stack, rank, key) AS share_costs FROM shares GROUP BY day)
    SELECT d.*, share_keys, share_costs FROM (SELECT day, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, {_USD('sum(units)')} AS cost_usd FROM cells GROUP BY day) d LEFT JOIN nested USING (day)"""
)
def activity(spark, sf_dir):
    """The nested shares of each day as two lists, so that SQL can say the same."""
    each = lambda f: F.flatten(F.transform(F.map_entries("shares"), lambda e: F.transform(e.value, lambda p: f(e, p))))
    return daily.activity(_report(spark, sf_dir)).withColumns({"share_keys": each(lambda e, p: F.concat(e.key, F.lit(":"), p.key)), "share_costs": each(lambda e, p: p.cost_usd)}).drop("shares")


@query(f"{_BASE} SELECT origin_id, seq FROM vector UNION ALL SELECT 'node9', 0")
def version_vector(spark, sf_dir):
    return replication.version_vector(R(spark, sf_dir), "node9")


@query(f"{_BASE} {_digest_sql('records')}")
def bucket_digests(spark, sf_dir):
    return replication.bucket_digests(R(spark, sf_dir))


@query(f"{_BASE} SELECT CAST(coalesce(sum(greatest(coalesce(p.seq, 0) - coalesce(v.seq, 0), 0)), 0) AS BIGINT) AS behind, CAST(coalesce(sum(greatest(coalesce(v.seq, 0) - coalesce(p.seq, 0), 0)), 0) AS BIGINT) AS ahead FROM vector v FULL JOIN peer_vector p USING (origin_id)")
def vector_lag(spark, sf_dir):
    return replication.lag(replication.version_vector(R(spark, sf_dir)), _peer_vector(spark, sf_dir))


_DIFFER = f"differing AS (SELECT a.origin_id, min(bucket) * 1000 AS from_seq FROM ({_digest_sql('records')}) a JOIN ({_digest_sql('peer_records')}) b USING (origin_id, bucket) WHERE split_part(a.digest, ':', 1) = split_part(b.digest, ':', 1) AND a.digest <> b.digest GROUP BY 1)"


@query(f"{_BASE}, {_DIFFER} SELECT * FROM differing")
def digest_mismatch(spark, sf_dir):
    return replication.mismatches(replication.bucket_digests(R(spark, sf_dir)), replication.bucket_digests(_peer_records(spark, sf_dir)))


_PLAN = "plan AS (SELECT v.origin_id, least(coalesce(p.seq, 0), coalesce(from_seq, coalesce(p.seq, 0))) AS after, v.seq AS upto FROM vector v LEFT JOIN peer_vector p USING (origin_id) LEFT JOIN differing USING (origin_id))"


@query(f"{_BASE}, {_DIFFER}, {_PLAN} SELECT * FROM plan WHERE after < upto")
def resend_plan(spark, sf_dir):
    return replication.resend_plan(replication.version_vector(R(spark, sf_dir)), _peer_vector(spark, sf_dir), digest_mismatch(spark, sf_dir))


@query(f"{_BASE}, {_DIFFER}, {_PLAN} SELECT r.origin_id, r.seq, content_hash FROM records r JOIN plan USING (origin_id) WHERE r.seq > after")
def resend_records(spark, sf_dir):
    return replication.to_resend(R(spark, sf_dir).select("origin_id", "seq", "content_hash"), resend_plan(spark, sf_dir))


def _local_batch(spark, sf_dir):
    """node0's lines as if collected again from half of its archive on, each third line twice."""
    own = R(spark, sf_dir).filter("origin_id = 'node0'")
    held = own.filter("byte_offset % 200 = 0")
    twice = own.filter("byte_offset % 300 = 0").withColumn("path", F.concat("path", F.lit(".copy")))
    return held, own.unionByName(twice).drop("origin_id", "seq").withColumn("sealed", F.lit("{}"))


@query(
    f"""{_BASE}, own AS (SELECT * FROM records WHERE origin_id = 'node0'), batch AS (SELECT path, byte_offset, line_uuid FROM own UNION ALL SELECT path || '.copy', byte_offset, line_uuid FROM own WHERE byte_offset % 300 = 0),
    m AS (SELECT *, row_number() OVER (PARTITION BY line_uuid ORDER BY path) = 1 AND byte_offset % 200 <> 0 AS isnew FROM batch)
    SELECT path, byte_offset, line_uuid, CASE WHEN isnew THEN 'stored' ELSE 'duplicate' END AS status, CASE WHEN isnew THEN (SELECT max(seq) FROM own WHERE byte_offset % 200 = 0) + row_number() OVER (PARTITION BY isnew ORDER BY path, byte_offset) END AS seq FROM m"""
)
def append_local(spark, sf_dir):
    held, batch = _local_batch(spark, sf_dir)
    return archive.append_local(held, batch, "node0", "2026-01-01T00:00:00Z").select("path", "byte_offset", "line_uuid", "status", "seq")


def _remote(spark, sf_dir):
    """A peer's records against an archive that holds part of them, some at other places (beyond the origin's last, so that they displace nothing), some with other content."""
    r = R(spark, sf_dir).withColumn("sealed", F.lit("{}"))
    top = replication.version_vector(r).withColumnRenamed("seq", "__top")
    held = r.filter("seq % 2 = 0").join(F.broadcast(top), "origin_id")  # a row for each origin
    held = held.withColumn("seq", F.when(F.col("seq") % 10 == 4, F.col("seq") + F.col("__top")).otherwise(F.col("seq"))).drop("__top")
    batch = r.withColumn("content_hash", F.when(F.col("seq") % 14 == 6, F.sha2("content_hash", 256)).otherwise(F.col("content_hash")))
    return held, batch


_REMOTE_SQL = "SELECT origin_id, seq, CASE WHEN seq % 2 = 1 THEN 'stored' WHEN seq % 10 = 4 THEN 'duplicate' WHEN seq % 14 = 6 THEN 'forked' ELSE 'duplicate' END AS status FROM records"


@query(f"{_BASE} {_REMOTE_SQL}")
def append_remote(spark, sf_dir):
    return archive.append_remote(*_remote(spark, sf_dir)).select("origin_id", "seq", "status")


@query(f"{_BASE} SELECT origin_id, seq, sha256(content_hash) AS content_hash, '{{}}' AS sealed, '2026-01-01T00:00:00Z' AS noticed_at FROM records WHERE seq % 2 = 0 AND seq % 10 <> 4 AND seq % 14 = 6")
def quarantine(spark, sf_dir):
    return archive.quarantine(archive.append_remote(*_remote(spark, sf_dir)), "2026-01-01T00:00:00Z")


@query(f"{_BASE} SELECT count(*) FILTER (WHERE status = 'stored') AS stored, count(*) FILTER (WHERE status = 'duplicate') AS duplicates, count(*) FILTER (WHERE status = 'forked') AS forked, max(seq) FILTER (WHERE status = 'stored') AS last_seq FROM ({_REMOTE_SQL})")
def append_accounting(spark, sf_dir):
    return archive.accounting(archive.append_remote(*_remote(spark, sf_dir)))


@query(f"{_BASE} SELECT (SELECT count(*) FROM records) AS records, (SELECT count(*) FROM records WHERE seq % 2 = 0 AND seq % 10 <> 4 AND seq % 14 = 6) AS quarantined")
def archive_counts(spark, sf_dir):
    return archive.counts(R(spark, sf_dir), quarantine(spark, sf_dir))


@query(f"{_BASE} SELECT * FROM records WHERE origin_id = 'node1' AND seq > 50 ORDER BY seq LIMIT 100")
def records_since(spark, sf_dir):
    return archive.since(R(spark, sf_dir), "node1", 50, 100)


def _marks(spark):
    return spark.createDataFrame([("node0", 2, 100), ("node1", 2, 10), ("node1", 1, 900), ("node7", 2, 5)], "origin_id string, version int, seq long")


@query(f"{_BASE} SELECT CAST(sum(seq - CASE origin_id WHEN 'node0' THEN 100 WHEN 'node1' THEN 10 ELSE 0 END) AS BIGINT) AS pending FROM vector")
def extraction_pending(spark, sf_dir):
    return reprocess.pending(R(spark, sf_dir), _marks(spark), 2)


def _stale(spark, sf_dir):
    """Records whose columns an older extraction left empty, or whose body cannot be read."""
    r = surrogate.bodies(R(spark, sf_dir)).withColumn("received_at", F.lit("2026-01-01T00:00:00Z"))
    r = r.withColumn("cwd", F.when(F.col("seq") % 3 == 0, F.lit(None)).otherwise(F.col("cwd"))).withColumn("git_branch", F.when(F.col("seq") % 5 == 0, F.lit("HEAD")).otherwise(F.col("git_branch")))
    return r.withColumn("sealed", F.when(F.col("seq") % 30 == 0, F.lit("{broken")).otherwise(F.col("sealed")))


@query(
    f"""{_BASE} SELECT origin_id, seq, cwd, git_branch, pr_repo, pr_number FROM records WHERE seq % 30 <> 0 AND (seq % 3 = 0 AND cwd IS NOT NULL OR seq % 5 = 0) AND seq > CASE origin_id WHEN 'node0' THEN 100 WHEN 'node1' THEN 10 ELSE 0 END"""
)
def reprocess_changes(spark, sf_dir):
    return reprocess.changed(reprocess.unfinished(_stale(spark, sf_dir), _marks(spark), 2))


@query(
    f"""{_BASE}, todo AS (SELECT *, seq % 30 <> 0 AND seq > CASE origin_id WHEN 'node0' THEN 100 WHEN 'node1' THEN 10 ELSE 0 END AS again FROM records)
    SELECT origin_id, seq, CASE WHEN again OR seq % 3 <> 0 THEN cwd END AS cwd, CASE WHEN again OR seq % 5 <> 0 THEN git_branch ELSE 'HEAD' END AS git_branch, pr_repo, pr_number FROM todo"""
)
def reprocess_pass(spark, sf_dir):
    return reprocess.run_pass(_stale(spark, sf_dir), _marks(spark), 2)[0].select("origin_id", "seq", "cwd", "git_branch", "pr_repo", "pr_number")


@query(f"{_BASE} SELECT origin_id, 2 AS version, greatest(seq, CASE origin_id WHEN 'node0' THEN 100 WHEN 'node1' THEN 10 ELSE 0 END) AS seq FROM vector UNION ALL VALUES ('node1', 1, 900), ('node7', 2, 5)")
def extraction_marks(spark, sf_dir):
    return reprocess.run_pass(_stale(spark, sf_dir), _marks(spark), 2)[1]


def _peers(spark):
    rows = [
        ("node0", ["10.0.0.9:7000"], "2026-01-01 11:59:00", False, None, "", None, "", "v1.0.0"),
        ("node1", ["10.0.0.1:7000"], "2026-01-01 11:00:00", False, "2026-01-01 11:30:00", "", {"node0": 10, "node1": 5000}, "alpha", "v1.2.0"),
        ("node2", ["10.0.0.4:7000", "[fe80::2]:7000", "10.0.0.2:7000"], "2026-01-01 10:00:00", False, "2026-01-01 09:00:00", "", {"node2": 7}, "", "v1.10.0"),
        ("node3", ["10.0.0.3:7000"], "2026-01-01 10:00:00", True, "2026-01-01 11:59:59", "dial: refused", {}, "", "dev"),
        ("static:10.0.0.3:7000", ["10.0.0.3:7000"], "2026-01-01 10:00:00", True, None, "", None, "", ""),
        ("static:10.0.0.8:7000", ["10.0.0.8:7000"], "2026-01-01 10:00:00", True, None, "dial: no route", None, "", ""),
        ("node5", [], "2026-01-01 10:00:00", False, None, "", None, "", "v0.9.0"),
    ]
    df = spark.createDataFrame(rows, "peer_id string, addrs array<string>, last_seen string, static boolean, last_converged string, last_error string, last_vector map<string,long>, hostname string, version string")
    return df.withColumns({c: F.to_timestamp(c) for c in ("last_seen", "last_converged")})


def _hostnames(spark):
    return spark.createDataFrame([("10.0.0.2", "gamma.lan", "2026-01-01 11:00:00"), ("fe80::2", "beta.lan", "2025-12-31 11:00:00"), ("10.0.0.4", "", "2026-01-01 10:30:00")], "ip string, hostname string, resolved_at string").withColumn("resolved_at", F.to_timestamp("resolved_at"))


def _machines(spark, sf_dir) -> DataFrame:
    """What a network of machines, one for each user of events, says of itself: e (number and order of what is said), peer_id, addr, k, kind, at."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.expr(surrogate.SPARK["K"]))
    return rows.select(
        F.col("event_id").alias("e"), F.col("user_id").alias("u"), F.concat(F.lit("m"), "user_id").alias("peer_id"), F.concat(F.lit("10.0."), F.col("user_id") % 200, F.lit("."), F.col("k") % 200, F.lit(":7000")).alias("addr"),
        "k", F.col("event_type").alias("kind"), F.timestamp_seconds(F.lit(1_767_000_000) + F.col("event_id")).alias("at"),
    )


_MACHINES = f"m AS (SELECT event_id AS e, user_id AS u, 'm' || user_id AS peer_id, '10.0.' || (user_id % 200) || '.' || ({surrogate.DUCKDB['K']} % 200) || ':7000' AS addr, {surrogate.DUCKDB['K']} AS k, event_type AS kind FROM events)"
_PEER = "peer_id string, addrs array<string>, last_seen timestamp, static boolean, last_converged timestamp, last_error string, last_vector map<string,long>, hostname string, version string"


def _known(spark, said: DataFrame) -> DataFrame:
    """The peers that these sightings make known."""
    return peers.merge_peers(spark.createDataFrame([], _PEER), _sightings(said)).withColumn("last_error", F.coalesce("last_error", F.lit("")))


def _sightings(said: DataFrame) -> DataFrame:
    return said.select("peer_id", F.array("addr").alias("addrs"), F.col("at").alias("last_seen"), (F.col("kind") == "signup").alias("static"))


@query(
    f"""WITH {_MACHINES}, named AS (SELECT * FROM (SELECT '10.0.0.' || (k % 200) AS ip, arg_max(CASE WHEN e % 3 = 0 THEN '' ELSE 'h' || e END, e) AS name FROM m GROUP BY ALL) WHERE name <> ''),
    p AS (SELECT DISTINCT u, peer_id FROM m)
    SELECT peer_id, coalesce(CASE WHEN u % 4 = 0 THEN 'own' || u END, a.name, b.name) AS name FROM p LEFT JOIN named a ON a.ip = '10.0.0.' || (u % 200) LEFT JOIN named b ON b.ip = '10.0.0.' || ((u + 1) % 200)"""
)
def peer_names(spark, sf_dir):
    m = _machines(spark, sf_dir)
    answers = m.select(F.concat(F.lit("10.0.0."), F.col("k") % 200).alias("ip"), F.when(F.col("e") % 3 == 0, "").otherwise(F.concat(F.lit("h"), "e")).alias("hostname"), F.col("at").alias("resolved_at"))
    at = lambda n: F.concat(F.lit("10.0.0."), (F.col("u") + n) % 200, F.lit(":7000"))
    known = m.select("u", "peer_id").distinct().select("peer_id", F.array(at(0), at(1)).alias("addrs"), F.when(F.col("u") % 4 == 0, F.concat(F.lit("own"), "u")).otherwise("").alias("hostname"))
    return peers.peer_names(known, peers.merge_hostnames(answers.limit(0), answers))


_HEALTH = f"""p(peer_id, label, reach, since, n0, n1, n2, known) AS (VALUES ('node1', 'alpha (node1)', 'current', 1800, 10, 5000, 0, true), ('node2', 'node2', 'stale', 10800, 0, 0, 7, true), ('node3', 'node3', 'failing', 1, 0, 0, 0, true),
      ('static:10.0.0.8:7000', 'static:10.0.0.8:7000', 'never', NULL, 0, 0, 0, false), ('node5', 'node5', 'never', NULL, 0, 0, 0, false)),
    l AS (SELECT p.*, v.seq AS m, CASE v.origin_id WHEN 'node0' THEN n0 WHEN 'node1' THEN n1 WHEN 'node2' THEN n2 ELSE 0 END AS t FROM p, vector v),
    health AS (SELECT peer_id, label, reach, CAST(since AS BIGINT) AS since_converged, CAST(CASE WHEN known THEN sum(greatest(t - m, 0)) END AS BIGINT) AS behind, CAST(CASE WHEN known THEN sum(greatest(m - t, 0)) END AS BIGINT) AS ahead FROM l GROUP BY peer_id, label, reach, since, known)"""


def _health(spark, sf_dir):
    return peers.peer_health(_peers(spark), replication.version_vector(R(spark, sf_dir)), _SELF, F.expr(_NOW), _hostnames(spark))


@query(
    f"""{_BASE}, {_HEALTH}
    SELECT h.*, a.addrs FROM health h JOIN (VALUES ('node1', ['10.0.0.1:7000=']), ('node2', ['10.0.0.4:7000=', '[fe80::2]:7000=beta.lan', '10.0.0.2:7000=gamma.lan']), ('node3', ['10.0.0.3:7000=']), ('static:10.0.0.8:7000', ['10.0.0.8:7000=']), ('node5', CAST([] AS VARCHAR[]))) a(peer_id, addrs) USING (peer_id)"""
)
def peer_health(spark, sf_dir):
    addrs = F.transform("addrs", lambda a: F.concat(a.addr, F.lit("="), a.host))
    return _health(spark, sf_dir).select("peer_id", peers.peer_label().alias("label"), "reach", "since_converged", "behind", "ahead", addrs.alias("addrs"))


@query("SELECT 'degraded' AS status")
def node_status(spark, sf_dir):
    return peers.node_status(_health(spark, sf_dir), quarantine(spark, sf_dir))


@query(f"WITH {_MACHINES} SELECT e, e * 7 % 90000 < CASE WHEN k % 3 = 0 THEN 3600 ELSE 43200 END AS fresh FROM m")
def hostname_freshness(spark, sf_dir):
    now = F.expr(_NOW)
    asked = _machines(spark, sf_dir).select("e", F.when(F.col("k") % 3 == 0, "").otherwise("name").alias("hostname"), F.timestamp_seconds(F.unix_timestamp(now) - F.col("e") * 7 % 90000).alias("resolved_at"))
    return asked.select("e", peers.fresh_hostname(now).alias("fresh"))


@query(f"WITH {_MACHINES} SELECT 'v' || e % 5 || '.' || k % 30 || '.' || u % 7 AS target FROM m WHERE e % 10 <> 0 ORDER BY e % 5 DESC, k % 30 DESC, u % 7 DESC LIMIT 1")
def newest_release(spark, sf_dir):
    release = F.concat(F.lit(" v"), F.col("e") % 5, F.lit("."), F.col("k") % 30, F.lit("."), F.col("u") % 7)
    return versions.newest(_machines(spark, sf_dir).select(F.when(F.col("e") % 10 == 0, "dev").otherwise(release).alias("version")), "v0.0.1")


@query(f"WITH {_MACHINES} SELECT peer_id, [coalesce(arg_max(addr, e) FILTER (e % 2 = 1), arg_max(addr, e))] AS addrs, bool_or(kind = 'signup') AS static FROM m GROUP BY peer_id")
def upsert_peers(spark, sf_dir):
    m = _machines(spark, sf_dir)
    return peers.merge_peers(_known(spark, m.filter("e % 2 = 0")), _sightings(m.filter("e % 2 = 1"))).select("peer_id", "addrs", "static")


@query(
    f"""WITH {_MACHINES}, p AS (SELECT peer_id, arg_max(addr, e) FILTER (e % 3 = 0) AS addr, arg_max(kind = 'error', e) FILTER (e % 3 = 1) AS failed, arg_max(k, e) FILTER (e % 3 = 1) AS k FROM m WHERE e % 3 < 2 GROUP BY peer_id)
    SELECT peer_id, CASE WHEN failed THEN 'timeout after ' || k ELSE '' END AS last_error, CAST(CASE WHEN NOT failed THEN 1 + k % 2 END AS INTEGER) AS origins, CASE WHEN addr IS NULL THEN [] ELSE [addr] END AS addrs FROM p"""
)
def convergence_record(spark, sf_dir):
    """Outcomes of peers that are known by then, and of some that are first heard of through theirs."""
    m = _machines(spark, sf_dir)
    failed = F.col("kind") == "error"
    vector = F.when(F.col("k") % 2 == 0, F.create_map("peer_id", "k")).otherwise(F.create_map("peer_id", "k", F.lit("self"), F.lit(1).cast("long")))
    told = m.filter("e % 3 = 1").select("peer_id", "at", F.when(~failed, vector).alias("vector"), F.when(failed, F.concat(F.lit("timeout after "), "k")).alias("error"))
    return peers.record_convergence(_known(spark, m.filter("e % 3 = 0")), told).select("peer_id", "last_error", F.when(F.col("last_vector").isNotNull(), F.size("last_vector")).alias("origins"), "addrs")


@query(
    f"""{_BASE}, {_HEALTH}, q AS (SELECT count(*) AS n FROM records WHERE seq % 2 = 0 AND seq % 10 <> 4 AND seq % 14 = 6),
    pend AS (SELECT CAST(sum(seq - CASE origin_id WHEN 'node0' THEN 100 WHEN 'node1' THEN 10 ELSE 0 END) AS BIGINT) AS n FROM vector), pads(s) AS (VALUES (repeat(' ', 37)))
    SELECT '1 counts' AS section, '' AS item, 0 AS n, 'origin   node0' AS line UNION ALL SELECT '1 counts', '', 1, 'version  v1.1.0' UNION ALL SELECT '1 counts', '', 2, 'records  ' || count(*) FROM records
    UNION ALL SELECT '1 counts', '', 3, 'pending  ' || n || ' records to re-read for newly extracted columns' FROM pend
    UNION ALL SELECT '2 origins', '', 0, 'origins  ' || count(*) FROM vector UNION ALL SELECT '3 peers', '', 0, 'peers    5'
    UNION ALL SELECT '2 origins', origin_id, 1, '  ' || origin_id || '  up to ' || seq || CASE WHEN origin_id = 'node0' THEN '  (this node)' ELSE '' END FROM vector
    UNION ALL SELECT '3 peers', peer_id, 1, '  ' || rpad(label, 34, ' ') || ' ' || a FROM health JOIN (VALUES ('node1', '10.0.0.1:7000'), ('node2', '10.0.0.4:7000, beta.lan ([fe80::2]:7000), gamma.lan (10.0.0.2:7000)'), ('node3', '10.0.0.3:7000'), ('static:10.0.0.8:7000', '10.0.0.8:7000'), ('node5', '(no address)')) t(peer_id, a) USING (peer_id)
    UNION ALL SELECT '3 peers', peer_id, 2, s || reach || coalesce(a, '') FROM pads, health JOIN (VALUES ('node1', ', last converged 30m0s ago'), ('node2', ', last converged 3h0m0s ago'), ('node3', ', last converged 1s ago'), ('static:10.0.0.8:7000', NULL), ('node5', NULL)) t(peer_id, a) USING (peer_id)
    UNION ALL SELECT '3 peers', peer_id, 3, s || 'running ' || v FROM pads, (VALUES ('node1', 'v1.2.0  (newer than this node)'), ('node2', 'v1.10.0  (newer than this node)'), ('node3', 'dev  (older than this node)'), ('node5', 'v0.9.0  (older than this node)')) t(peer_id, v)
    UNION ALL SELECT '3 peers', peer_id, 4, s || 'behind ' || coalesce(behind, 0) || ', ahead ' || coalesce(ahead, 0) || ' as of that exchange' FROM pads, health WHERE behind > 0 OR ahead > 0
    UNION ALL SELECT '3 peers', peer_id, 5, s || 'last error: ' || v FROM pads, (VALUES ('node3', 'dial: refused'), ('static:10.0.0.8:7000', 'dial: no route')) t(peer_id, v)
    UNION ALL SELECT '4 warnings', 'converging', 0, 'WARNING: 2 peer(s) are not converging: node2, node3' UNION ALL SELECT '4 warnings', 'quarantine', 1, 'WARNING: ' || n || ' quarantined records: two machines issue records under one origin id' FROM q"""
)
def status_report(spark, sf_dir):
    r = R(spark, sf_dir)
    vector = keep(replication.version_vector(r), "vector")
    health = keep(peers.peer_health(_peers(spark), vector, _SELF, F.expr(_NOW), _hostnames(spark)), "health")
    return status.status(r, vector, health, quarantine(spark, sf_dir), reprocess.pending(r, _marks(spark), 2), _SELF, "v1.1.0")


@query(f"{_BASE} SELECT origin_id, (seq - 1) // 5000 AS bundle, (seq - 1) // 5000 * 5000 + 1 AS first, max(seq) AS last FROM records GROUP BY ALL")
def bundle_ranges(spark, sf_dir):
    return bundles.ranges(R(spark, sf_dir))


@query(f"{_BASE} SELECT r.origin_id, r.seq, content_hash FROM records r LEFT JOIN peer_vector p USING (origin_id) WHERE r.origin_id <> 'node2' AND r.seq > coalesce(p.seq, 0)")
def bundle_exchange(spark, sf_dir):
    """S13-S15: every node publishes its ranges to a folder, and node2 fetches what it lacks."""
    folder, rows = new_path(spark, "bundles"), R(spark, sf_dir).select("origin_id", "seq", "content_hash")
    for node in ("node0", "node1", "node2", "node3"):
        bundles.publish(rows, folder, node)
    vector = {r["origin_id"]: r["seq"] for r in _peer_vector(spark, sf_dir).collect()}  # a row for each origin
    return bundles.fetch_listed(spark, folder, vector, "node2").select("origin_id", "seq", "content_hash")


def _ledger(spark) -> Ledger:
    return Ledger(spark, new_path(spark, "ledger"), buckets=32, span=10_000)


@query(f"{_BASE} SELECT r.origin_id, r.seq, content_hash FROM records r JOIN vector v USING (origin_id) WHERE origin_id <> 'node2' OR r.seq * 10 <= v.seq * 9")
def bundle_fetch(spark, sf_dir):
    """S14, J15: a node's archive takes from the folder what it lacks of others; bundles that it holds are not opened."""
    folder, rows, book = new_path(spark, "bundles"), R(spark, sf_dir), _ledger(spark)
    for node in ("node0", "node1", "node2", "node3"):
        bundles.publish(rows, folder, node)
    top = replication.version_vector(rows).withColumnRenamed("seq", "__top")
    book.append_remote(rows.join(F.broadcast(top), "origin_id").filter("origin_id <> 'node3' and seq * 10 <= __top * 9").drop("__top"), "2026-01-01T00:00:00Z")  # a row for each origin
    exchange.fetch_into(book, folder, "node2", "2026-01-01T00:00:00Z")
    return book.records().select("origin_id", "seq", "content_hash")


@query(
    f"""{_BASE}, own AS (SELECT * FROM records WHERE origin_id = 'node0'), batch AS (SELECT path, byte_offset, line_uuid FROM own UNION ALL SELECT path || '.copy', byte_offset, line_uuid FROM own WHERE byte_offset % 300 = 0),
    m AS (SELECT *, row_number() OVER (PARTITION BY line_uuid ORDER BY path) = 1 AND byte_offset % 200 <> 0 AS isnew FROM batch)
    SELECT 'node0' AS origin_id, seq, path, byte_offset, line_uuid FROM own WHERE byte_offset % 200 = 0
    UNION ALL SELECT 'node0', (SELECT max(seq) FROM own WHERE byte_offset % 200 = 0) + row_number() OVER (ORDER BY path, byte_offset), path, byte_offset, line_uuid FROM m WHERE isnew"""
)
def ledger_append(spark, sf_dir):
    """D1, J13: a stored archive after a batch that holds half of it again; only the batch's key buckets are read."""
    held, batch = _local_batch(spark, sf_dir)
    book = _ledger(spark)
    book.append_remote(held, "2026-01-01T00:00:00Z")
    book.append(batch, "node0", "2026-01-01T00:00:00Z")
    return book.records().select("origin_id", "seq", "path", "byte_offset", "line_uuid")


@query(f"{_BASE} {_digest_sql('records')}")
def ledger_digests(spark, sf_dir):
    """A13: the digests kept with an archive of several batches, of which the later ones touch buckets of the earlier."""
    book, rows = _ledger(spark), R(spark, sf_dir)
    for part in ("seq % 1700 < 900", "seq % 1700 >= 900"):
        book.append_remote(rows.filter(part), "2026-01-01T00:00:00Z")
    return book.digests()


@query(
    f"""{_BASE}, halves AS (SELECT r.*, r.seq * 2 <= v.seq AS low FROM records r JOIN vector v USING (origin_id)), forged AS (SELECT origin_id, seq, content_hash, sha256(content_hash) AS other FROM halves WHERE origin_id = 'node1' AND low AND seq % 97 = 0)
    SELECT 'a' AS side, 'record' AS kind, origin_id, seq, content_hash FROM records
    UNION ALL SELECT 'b', 'record', origin_id, seq, coalesce(other, r.content_hash) FROM records r LEFT JOIN forged f USING (origin_id, seq)
    UNION ALL SELECT 'a', 'fork', origin_id, seq, other FROM forged UNION ALL SELECT 'b', 'fork', origin_id, seq, content_hash FROM forged"""
)
def exchange_round(spark, sf_dir):
    """Two archives with other halves of the records, some of them forged, exchange until nothing moves: all records on both sides, each other's forks in quarantine."""
    rows, now = R(spark, sf_dir), "2026-01-01T00:00:00Z"
    top = replication.version_vector(rows).withColumnRenamed("seq", "__top")
    low = keep(rows.join(F.broadcast(top), "origin_id").withColumn("__low", F.col("seq") * 2 <= F.col("__top")).drop("__top"), "halves")  # a row for each origin
    a, b = _ledger(spark), _ledger(spark)
    a.append_remote(low.filter("origin_id in ('node0', 'node1') or origin_id = 'node2' and __low").drop("__low"), now)
    forged = F.when((F.col("origin_id") == "node1") & (F.col("seq") % 97 == 0), F.sha2("content_hash", 256)).otherwise(F.col("content_hash"))
    b.append_remote(low.filter("origin_id in ('node2', 'node3') or origin_id = 'node1' and __low").drop("__low").withColumn("content_hash", forged), now)
    exchange.exchange(a, b, now)
    parts = [x.select(F.lit(side).alias("side"), F.lit(kind).alias("kind"), "origin_id", "seq", "content_hash") for side, book in (("a", a), ("b", b)) for kind, x in (("record", book.records()), ("fork", book.quarantined()))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"{_BASE} SELECT * FROM grid")
def kept_grid(spark, sf_dir):
    """Late data: the grid kept with an archive whose later batches hold the earlier lines of the same requests."""
    kept, rows = KeptGrid(), R(spark, sf_dir)
    book = Ledger(spark, new_path(spark, "ledger"), buckets=32, span=10_000, derivations=[kept])
    for part in ("seq % 3 = 2", "seq % 3 = 0", "seq % 3 = 1"):
        book.append_remote(rows.filter(part), "2026-01-01T00:00:00Z")
    return kept.grid(book)


@query(f"{_BASE} SELECT origin_id, seq, CASE WHEN seq % 30 <> 0 THEN cwd END AS cwd, CASE WHEN seq % 30 <> 0 THEN git_branch ELSE 'HEAD' END AS git_branch, pr_repo, pr_number FROM records")
def ledger_reprocess(spark, sf_dir):
    """D7, T7: a stored archive after its columns were extracted again, a few parts at a time; its files of records are as they were."""
    book = _ledger(spark)
    book.append_remote(_stale(spark, sf_dir), "2026-01-01T00:00:00Z")
    book.reprocess(2, most=1_000_000)
    return book.records().select("origin_id", "seq", "cwd", "git_branch", "pr_repo", "pr_number")


@query(f"WITH {_MACHINES} SELECT e, CASE e % 5 WHEN 4 THEN '' ELSE 'unit' || u % 50 END AS project FROM m")
def project_names(spark, sf_dir):
    """F7-F15 over a column of paths: a checkout, a worktree in it, issues and worktrees beside it, a root."""
    unit = F.concat(F.lit("unit"), F.col("u") % 50)
    tree = [F.concat(F.lit("/work/"), unit), F.concat(F.lit("/work/"), unit, F.lit("/.claude/worktrees/w"), "e"), F.concat(F.lit("D:\\"), unit, F.lit("-issue-"), "k"), F.concat(F.lit("/work/"), unit, F.lit("_wt-"), "k"), F.lit("/")]
    paths = F.element_at(F.array(*tree), (F.col("e") % 5 + 1).cast("int"))
    return _machines(spark, sf_dir).select("e", projects.project_of(paths, F.array().cast("array<string>")).alias("project"))
