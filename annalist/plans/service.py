"""Queries that answer a client or a page: what is offered, feeds, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import history as H
from ..operators import refs
from ..sources import tables as T
from .references import _REFS, _decided, _DECIDED, _peeled, event_refs

_CHAIN = "(SELECT user_id AS repo, event_id AS oid, event_type AS subject, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS time, ts FROM events)"


def _wants(spark, d) -> DataFrame:
    """Users of even number want all tips, others a third of their commits."""
    tips = event_refs(spark, d).where("repo % 2 = 0").select("repo", F.col("target").alias("oid"))
    return tips.unionByName(T.table(spark, d, "events").where("user_id % 2 = 1 AND event_id % 3 = 0").select(F.col("user_id").alias("repo"), F.col("event_id").alias("oid")))


_WANTS = f"(SELECT repo, target AS oid FROM {_REFS} r WHERE repo % 2 = 0 UNION ALL SELECT user_id, event_id FROM events WHERE user_id % 2 = 1 AND event_id % 3 = 0)"
_OFFERED = f"(SELECT repo, target AS oid FROM {_REFS} r UNION SELECT repo, abs(target) FROM {_REFS} r)"


def _events_json(spark, d) -> DataFrame:
    return refs.push_events(_decided(spark, d)).select("repo", "batch", F.to_json(F.transform("updates", lambda u: F.struct(u["ref"].alias("ref"), u["old"].alias("old"), u["new"].alias("new")))).alias("updates"))


def _commit_json(spark, d) -> DataFrame:
    c = T.event_commits(spark, d)
    return c.select("oid", F.to_json(F.struct("oid", F.array_compact(F.array("parent")).alias("parents"), F.struct(F.col("author").alias("name"), "time").alias("author"), "subject")).alias("json"))


def _atom(spark, d) -> DataFrame:
    """The 20 newest commits of each repository as feed entries."""
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("time"), F.desc("oid")))
    top = T.event_commits(spark, d).withColumn("rank", rank).where("rank <= 20")
    entry = F.format_string("<entry><title>%s</title><updated>%s</updated><id>%s</id></entry>", H.escape_html(F.col("subject")), H.format_iso(F.col("time")), F.col("oid"))
    return top.select("repo", "rank", entry.alias("entry"))


QUERIES = {
    "advertised_oids": (lambda spark, d: refs.advertised(event_refs(spark, d), _peeled(spark, d)), f"SELECT repo, oid FROM {_OFFERED} o"),
    "illegal_wants": (
        lambda spark, d: refs.illegal_wants(_wants(spark, d), refs.advertised(event_refs(spark, d), _peeled(spark, d))),
        f"SELECT repo, oid FROM {_WANTS} w WHERE NOT EXISTS (SELECT 1 FROM {_OFFERED} o WHERE o.repo = w.repo AND o.oid = w.oid)",
    ),
    "wants_all_tips": (
        lambda spark, d: refs.wants_all_tips(_wants(spark, d), event_refs(spark, d)),
        f"""SELECT repo, bool_and(w IS NOT NULL AND t IS NOT NULL) AS all_tips FROM (SELECT coalesce(a.repo, b.repo) AS repo, a.oid AS w, b.oid AS t
        FROM (SELECT DISTINCT repo, oid FROM {_WANTS} w) a FULL JOIN (SELECT DISTINCT repo, target AS oid FROM {_REFS} r) b ON a.repo = b.repo AND a.oid = b.oid) GROUP BY repo""",
    ),
    "push_events": (
        _events_json,
        f"""SELECT repo, batch, '[' || string_agg('{{"ref":"' || ref || '","old":"' || old || '","new":"' || new || '"}}', ',' ORDER BY seq) || ']' AS updates FROM {_DECIDED} d WHERE message IS NULL GROUP BY repo, batch""",
    ),
    "commit_json": (
        _commit_json,
        """SELECT event_id AS oid, '{"oid":' || event_id || ',"parents":[' || coalesce(CAST(lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS VARCHAR), '') || '],"author":{"name":"user ' || user_id
        || '","time":' || CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) || '},"subject":"' || event_type || '"}' AS json FROM events""",
    ),
    "atom_feed": (
        _atom,
        f"SELECT repo, rank, '<entry><title>' || subject || '</title><updated>' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '</updated><id>' || oid || '</id></entry>' AS entry FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY time DESC, oid DESC) AS rank FROM {_CHAIN}) WHERE rank <= 20",
    ),
    "newest_branches": (
        lambda spark, d: refs.newest_branches(event_refs(spark, d), T.event_commits(spark, d), 3),
        f"SELECT * FROM (SELECT r.repo, substr(name, 12) AS name, target AS oid, c.time, row_number() OVER (PARTITION BY r.repo ORDER BY c.time DESC, name) AS rank FROM {_REFS} r JOIN {_CHAIN} c ON c.oid = r.target AND c.repo = r.repo WHERE starts_with(name, 'refs/heads/')) WHERE rank <= 3",
    ),
}
