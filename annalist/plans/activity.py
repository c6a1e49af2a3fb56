"""Queries on commit activity, logs and times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import history as H
from ..operators import log, stats
from ..operators.graph import shared_root
from ..sources import tables as T
from ..streaming import feeds

_KEYS = {
    "y": "strftime(t, '%Y')",
    "q": "strftime(t, '%Y') || '-Q' || quarter(t)",
    "m": "strftime(t, '%Y-%m')",
    "w": "strftime(t, '%Y') || '-W' || lpad(CAST(CAST(ceil((epoch(t) - epoch(date_trunc('year', t)) + 86400) / 86400.0 / 7) AS BIGINT) AS VARCHAR), 2, '0')",
}
_ORDERS = "(SELECT o_custkey AS repo, o_orderkey AS oid, o_orderpriority AS author, CAST(o_orderdate AS TIMESTAMP) AS t FROM orders)"
#: Commits of events with the place of each in its history, the newest at 0.
_CHAIN = """(SELECT user_id AS repo, event_id AS oid, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent,
  'user ' || user_id AS author, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS time, event_type AS subject, concat_ws(' ', event_type, props) AS message,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS position, ts, value FROM events)"""
#: Five days after the newest order, so that all units occur.
NOW = 902_534_400
#: Micro-batches in which stored pushes are replayed, at most.
BATCHES = 4


def _by_period(period: str):
    sql = f"SELECT author, {_KEYS[period]} AS period, count(*) AS commits FROM {_ORDERS} GROUP BY ALL"
    return lambda spark, d: stats.author_by_period(T.order_commits(spark, d), period), sql


def _pivot(spark, d) -> DataFrame:
    """The pivot in long form, as its columns are named after the data."""
    commits = T.order_commits(spark, d)
    columns = stats.newest_periods(commits, "q")
    wide = stats.pivoted(commits, "q")
    cells = F.array(*(F.struct(F.lit(c).alias("period"), F.col(f"`{c}`").alias("commits")) for c in columns))
    return wide.select("author", "total", F.inline(cells))


def _log_page(spark, d) -> DataFrame:
    return log.page(log.chain_order(T.event_commits(spark, d)), 5, 10).select("repo", "oid", "position", "more")


def _search(query: str, kind: str = "grep"):
    def run(spark, d):
        commits = T.event_commits(spark, d).withColumn("committer", F.struct(F.col("author").alias("name"), F.lit(None).cast("string").alias("email"))).withColumn("author", F.col("committer"))
        return commits.where(log.matches(query, kind)).select("repo", "oid", F.col("author.name").alias("author"), "time")

    field = "message" if kind == "grep" else "author || ' '"
    return run, f"SELECT repo, oid, author, time FROM {_CHAIN} WHERE contains(lower({field}), '{query.lower()}')"


def _path_filter(spark, d) -> DataFrame:
    commits = T.event_commits(spark, d)
    return log.touches(commits.select("oid", F.col("subject").alias("path_oid")), commits).select("repo", "oid", "parent", "mine")


def _first_parents(spark, d) -> DataFrame:
    commits = log.chain_order(T.event_commits(spark, d))
    at = commits.select("repo", F.col("position").alias("ordinal"), "oid", F.when(F.col("subject") != "purchase", F.col("subject")).alias("path_oid"))
    return log.path_history(at).select("repo", "oid", "ordinal", "path_oid")


def skewed_commits(spark, d) -> DataFrame:
    """Histories with merges: each third commit of a user also has the commit three before it as a parent; rank 1 is the tip."""
    chain = Window.partitionBy("repo").orderBy("ts", "event_id")
    e = T.table(spark, d, "events").withColumnRenamed("user_id", "repo")
    older = lambda n: F.lag(F.col("event_id").cast("string"), n).over(chain)
    parents = F.array_compact(F.array(older(1), F.when(F.col("event_id") % 3 == 0, older(3))))
    # Times off by up to two days, so that some parents are newer than their children.
    return e.select("repo", F.col("event_id").cast("string").alias("oid"), parents.alias("parents"), (F.unix_timestamp(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(172800))).alias("time"), F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("ts"), F.desc("event_id"))).alias("rank"))


def _best_first(spark, d) -> DataFrame:
    skewed = skewed_commits(spark, d)
    return log.best_first(skewed.select("repo", "oid", "parents", "time"), skewed.where("rank = 1").select("repo", "oid"))


def _times(spark, d) -> DataFrame:
    commits = T.order_commits(spark, d)
    t, zone = F.col("time"), F.lit("+0530")
    return commits.select(
        "oid", H.age(t, NOW).alias("age"), H.format_date(t, zone).alias("date"), H.format_rfc2822(t, zone).alias("rfc2822"), H.format_iso(t).alias("iso")
    )


_UNIT = lambda div, name: f"CAST(CAST(floor(d / {div}) AS BIGINT) AS VARCHAR) || ' {name}' || CASE WHEN floor(d / {div}) = 1 THEN '' ELSE 's' END"
_TIMES_SQL = f"""SELECT oid, CASE WHEN d < 3600 THEN greatest(1, CAST(floor(d / 60) AS BIGINT)) || ' min.' WHEN d < 86400 THEN {_UNIT('3600', 'hour')}
  WHEN d < 604800 THEN {_UNIT('86400', 'day')} WHEN d < 2678400 THEN {_UNIT('604800', 'week')} WHEN d < 31536000 THEN {_UNIT('2592000', 'month')}
  ELSE {_UNIT('31536000', 'year')} END AS age, strftime(t, '%Y-%m-%d %H:%M:%S') || ' +0530' AS date,
  strftime(t + INTERVAL 330 MINUTE, '%a, %-d %b %Y %H:%M:%S') || ' +0530' AS rfc2822, strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS iso
  FROM (SELECT *, {NOW} - epoch(t) AS d FROM {_ORDERS})"""


def _push_stream(spark, d) -> DataFrame:
    """Each event pushes its own id to its user's branch of its type, from the last id that was accepted there; every tenth
    names a wrong old target. The pushes are written as files, and these are read as a stream."""
    of = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    wrong = F.col("event_id") % 10 == 0
    last = F.last(F.when(~wrong, F.col("event_id")), ignorenulls=True).over(of.rowsBetween(Window.unboundedPreceding, -1))
    old = F.when(wrong, "x").otherwise(F.coalesce(last.cast("string"), F.lit(H.ZERO_OID)))
    commands = T.table(spark, d, "events").select(
        F.col("user_id").alias("repo"), F.concat(F.lit("refs/heads/"), "event_type").alias("ref"), F.row_number().over(of).cast("long").alias("seq"), old.alias("old"), F.col("event_id").cast("string").alias("new")
    )
    # A branch's pushes are in one file, in their order, as they come from one host.
    folder = f"{shared_root(spark)}/pushes-{uuid.uuid4().hex}"
    commands.repartition("repo", "ref").sortWithinPartitions("repo", "ref", "seq").write.parquet(folder)
    # Each micro-batch commits the state of all partitions, so their number stays the same, however many files there are.
    files = len(spark.read.schema(commands.schema).parquet(folder).inputFiles())
    stream = spark.readStream.schema(commands.schema).option("maxFilesPerTrigger", max(1, -(-files // BATCHES))).parquet(folder)
    return feeds.replay(feeds.compare_and_set(stream))


_PERIODS = {"y": "year", "q": "quarter", "m": "month", "w": "week"}
QUERIES = {
    **{f"stats_author_{name}": _by_period(p) for p, name in _PERIODS.items()},
    "stats_totals_grouping_sets": (
        lambda spark, d: stats.with_totals(T.order_commits(spark, d), "q"),
        f"SELECT author, period, count(*) AS commits, CAST(grouping(author) * 2 + grouping(period) AS INT) AS level FROM (SELECT author, {_KEYS['q']} AS period FROM {_ORDERS}) GROUP BY GROUPING SETS ((author, period), (period), ())",
    ),
    "stats_pivot_top_authors": (
        _pivot,
        f"""WITH k AS (SELECT author, {_KEYS['q']} AS period, epoch(t) AS time FROM {_ORDERS}),
        c AS (SELECT period FROM k GROUP BY period ORDER BY max(time) DESC LIMIT 8),
        a AS (SELECT author, count(*) AS total FROM k GROUP BY author ORDER BY total DESC, author LIMIT 20),
        n AS (SELECT author, period, count(*) AS commits FROM k GROUP BY ALL)
        SELECT a.author, a.total, c.period, n.commits FROM a CROSS JOIN c LEFT JOIN n ON n.author = a.author AND n.period = c.period""",
    ),
    "stats_top_authors_per_repo": (
        lambda spark, d: stats.top_authors(T.event_commits(spark, d).withColumn("author", F.col("subject")), 2),
        f"SELECT * FROM (SELECT repo, subject AS author, count(*) AS commits, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, subject) AS rank FROM {_CHAIN} GROUP BY repo, subject) WHERE rank <= 2",
    ),
    "log_page": (
        _log_page,
        f"SELECT repo, oid, position, (max(position) OVER (PARTITION BY repo)) > 14 AS more FROM {_CHAIN} QUALIFY position BETWEEN 5 AND 14",
    ),
    "log_search_message": _search("Click"),
    "log_search_author": _search("USER 1", "author"),
    "log_path_filter": (
        _path_filter,
        f"SELECT c.repo, c.oid, c.parent, c.subject AS mine FROM {_CHAIN} c LEFT JOIN events p ON p.event_id = c.parent WHERE c.subject IS DISTINCT FROM p.event_type",
    ),
    "first_parent_history": (
        _first_parents,
        f"""WITH a AS (SELECT repo, oid, position AS ordinal, CASE WHEN subject <> 'purchase' THEN subject END AS path_oid FROM {_CHAIN}),
        b AS (SELECT *, lead(path_oid) OVER (PARTITION BY repo ORDER BY ordinal) AS older FROM a),
        c AS (SELECT *, sum(CASE WHEN older IS NULL AND path_oid IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY repo ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS made FROM b)
        SELECT repo, oid, ordinal, path_oid FROM c WHERE path_oid IS DISTINCT FROM older AND coalesce(made, 0) = 0""",
    ),
    "log_best_first": (_best_first, None),
    "format_times": (_times, _TIMES_SQL),
    "stream_push_counts": (
        lambda spark, d: feeds.replay_latest(feeds.push_counts(feeds.read_events(spark, d), "1 day", None), ["window_start", "event_type"]),
        "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS pushes FROM events GROUP BY ALL",
    ),
    "stream_compare_and_set": (
        _push_stream,
        """SELECT user_id AS repo, 'refs/heads/' || event_type AS ref, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS seq,
        event_id % 10 <> 0 AS ok, CASE WHEN event_id % 10 = 0 THEN 'fetch first' END AS message FROM events""",
    ),
}
