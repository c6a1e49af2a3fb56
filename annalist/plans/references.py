"""Queries on references, pushes and the catalog of repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import history as H
from ..operators import graph, refs
from ..operators.graph import checkpointed
from ..sources import tables as T
from ..streaming import feeds

# Each user's repository has a branch for each event type, at its newest commit of that type, and a tag at the newest
# commit of all, whose tag object has the commit's negative number.
_REFS = """(SELECT user_id AS repo, 'refs/heads/' || event_type AS name, max_by(event_id, struct_pack(a := ts, b := event_id)) AS target FROM events GROUP BY ALL
  UNION ALL SELECT user_id, 'refs/tags/v1', -max_by(event_id, struct_pack(a := ts, b := event_id)) FROM events GROUP BY user_id)"""


def _newest(events: DataFrame) -> DataFrame:
    return events.agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("target"))


def event_refs(spark, d) -> DataFrame:
    """repo, name, target."""
    e = T.table(spark, d, "events")
    heads = _newest(e.groupBy(F.col("user_id").alias("repo"), F.concat(F.lit("refs/heads/"), "event_type").alias("name")))
    tags = _newest(e.groupBy(F.col("user_id").alias("repo"))).select("repo", F.lit("refs/tags/v1").alias("name"), (-F.col("target")).alias("target"))
    return heads.unionByName(tags)


def _peeled(spark, d) -> DataFrame:
    e = T.table(spark, d, "events")
    tags = e.select((-F.col("event_id")).alias("oid"), F.col("event_id").alias("target"))
    return graph.peel(tags, event_refs(spark, d).select(F.col("target").alias("oid")).distinct())


def _heads(spark, d) -> DataFrame:
    """HEAD is the branch of purchases, whether there is one or not."""
    return T.table(spark, d, "events").select(F.col("user_id").alias("repo"), F.lit("refs/heads/purchase").alias("ref_name")).distinct()


def _text_refs(spark, d) -> DataFrame:
    return event_refs(spark, d).withColumn("target", F.col("target").cast("string"))


def _resolve(spark, d) -> DataFrame:
    e = T.table(spark, d, "events")
    names = F.array(F.lit("click"), F.lit("v1"), F.lit("refs/heads/view"), F.lit("nothing"), F.lit(None).cast("string"))
    asked = e.select(F.col("user_id").alias("repo")).distinct().select("repo", F.explode(names).alias("asked"))
    own = e.select(F.col("user_id").alias("repo"), F.col("event_id").cast("string").alias("oid"))
    first = e.groupBy(F.col("user_id").alias("repo")).agg(F.min("event_id").cast("string").alias("asked"))
    return refs.resolve(asked.unionByName(first), _text_refs(spark, d), _heads(spark, d), own)


def commands(spark, d) -> DataFrame:
    """Each purchase pushes to one of four branches, from what the push before it named, or the one before that. Some go to
    bad names, name an object that there isn't, delete the branch, or set it back to the user's first commit."""
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = T.table(spark, d, "events").withColumn("first", F.first("event_id").over(by_user)).where("event_type = 'purchase'")
    i = F.col("event_id")
    name = F.when(i % 11 == 0, "refs/heads/a..b").when(i % 13 == 0, "tip.lock").otherwise(F.concat(F.lit("refs/heads/b"), (i % 4).cast("string")))
    new = F.when(i % 7 == 0, "none").when(i % 19 == 0, H.ZERO_OID).when(i % 6 == 0, F.col("first").cast("string")).otherwise(i.cast("string"))
    named = e.withColumn("ref", name).withColumn("new", new)
    of = Window.partitionBy("user_id", "ref").orderBy("ts", "event_id")
    old = F.coalesce(F.when(i % 3 == 0, F.lag("new", 2).over(of)).otherwise(F.lag("new").over(of)), F.lit(H.ZERO_OID))
    return named.select(F.col("user_id").alias("repo"), F.to_date("ts").cast("string").alias("batch"), i.alias("seq"), "ref", old.alias("old"), "new")


def _decided(spark, d) -> DataFrame:
    pushed = checkpointed(commands(spark, d))
    stored = T.table(spark, d, "events").select(F.col("event_id").cast("string").alias("oid"))
    moves = pushed.where((F.col("old") != H.ZERO_OID) & (F.col("new") != H.ZERO_OID)).select(F.expr("try_cast(old AS BIGINT)").alias("anc"), F.expr("try_cast(new AS BIGINT)").alias("desc"))
    ancestry = graph.is_ancestor(checkpointed(T.event_parents(spark, d)), moves.dropna().distinct())
    return refs.decide(pushed, _text_refs(spark, d), stored, ancestry.select(F.col("anc").cast("string").alias("anc"), F.col("desc").cast("string").alias("desc"), "is_ancestor"))


_ZERO = f"'{H.ZERO_OID}'"
#: The pushes one after the other: what each branch is after each batch.
_DECIDED = f"""(WITH RECURSIVE e AS (SELECT *, first_value(event_id) OVER w AS first, row_number() OVER w AS place FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  n AS (SELECT user_id AS repo, CAST(CAST(ts AS DATE) AS VARCHAR) AS batch, event_id AS seq, ts,
    CASE WHEN event_id % 11 = 0 THEN 'refs/heads/a..b' WHEN event_id % 13 = 0 THEN 'tip.lock' ELSE 'refs/heads/b' || event_id % 4 END AS ref,
    CASE WHEN event_id % 7 = 0 THEN 'none' WHEN event_id % 19 = 0 THEN {_ZERO} WHEN event_id % 6 = 0 THEN CAST(first AS VARCHAR) ELSE CAST(event_id AS VARCHAR) END AS new
    FROM e WHERE event_type = 'purchase'),
  c AS (SELECT *, coalesce(CASE WHEN seq % 3 = 0 THEN lag(new, 2) OVER w ELSE lag(new) OVER w END, {_ZERO}) AS old, dense_rank() OVER (PARTITION BY repo ORDER BY batch) AS b,
    starts_with(ref, 'refs/heads/b') AS named FROM n WINDOW w AS (PARTITION BY repo, ref ORDER BY ts, seq)),
  f AS (SELECT repo, ref, b, old, min(seq) AS seq, min_by(new, seq) AS new FROM c WHERE named AND new <> 'none' GROUP BY ALL),
  s AS (SELECT DISTINCT repo, ref, CAST(0 AS BIGINT) AS b, {_ZERO} AS cur FROM c
    UNION ALL SELECT s.repo, s.ref, s.b + 1, coalesce(f.new, s.cur) FROM s LEFT JOIN f ON f.repo = s.repo AND f.ref = s.ref AND f.b = s.b + 1 AND f.old = s.cur
      WHERE s.b < (SELECT max(b) FROM c)),
  j AS (SELECT c.*, CASE WHEN NOT named THEN 'funny refname' WHEN cur <> c.old THEN 'fetch first' WHEN c.new = 'none' THEN 'missing necessary objects' WHEN f.seq <> c.seq THEN 'fetch first' END AS message
    FROM c JOIN s ON s.repo = c.repo AND s.ref = c.ref AND s.b = c.b - 1 LEFT JOIN f ON f.repo = c.repo AND f.ref = c.ref AND f.b = c.b AND f.old = c.old)
  SELECT j.repo, j.batch, j.seq, j.ref, j.old, j.new, message,
    message IS NULL AND j.old <> {_ZERO} AND j.new <> {_ZERO} AND NOT coalesce(a.place <= z.place, false) AS forced
  FROM j LEFT JOIN e a ON CAST(a.event_id AS VARCHAR) = j.old LEFT JOIN e z ON CAST(z.event_id AS VARCHAR) = j.new)"""


def _applied(spark, d) -> DataFrame:
    return refs.apply_updates(_text_refs(spark, d), _decided(spark, d))


def _upserted(spark, d) -> DataFrame:
    users = T.table(spark, d, "customer").select(F.col("c_custkey").alias("name"), F.round(F.col("c_acctbal") * 100).cast("long").alias("idle"), F.lit(1).cast("long").alias("ver"))
    pushes = T.table(spark, d, "events").select(F.col("user_id").alias("name"), F.unix_millis(F.col("ts").cast("timestamp")).alias("idle"), F.struct("ts", "event_id").alias("seq"))
    return refs.upsert_catalog(users, pushes)


def _patched(spark, d) -> DataFrame:
    base = T.table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit("none").alias("description"), F.lit("me").alias("owner"), F.lit(None).cast("string").alias("section"), (F.col("s_acctbal") < 0).alias("private"), "s_suppkey")
    patches = base.where("s_suppkey % 2 = 0").select("name", F.repeat("name", 20).alias("description"), F.lit(None).cast("string").alias("owner"), F.lit("tools").alias("section"), F.when(F.col("s_suppkey") % 4 == 0, F.lit(True)).alias("private"))
    return refs.patch_config(base.drop("s_suppkey"), patches)


def _due(spark, d) -> DataFrame:
    e = T.event_commits(spark, d)
    return feeds.collection_due(e.select("repo", (F.col("subject") == "error").alias("forced"), "time"))


#: What stands before and after a part's name to make names of each kind.
_AROUND = (
    ("refs/heads/", ""), ("refs/heads/", ".lock"), ("refs/", "/"), ("refs/.", ""), ("x/", ""), ("refs/a@{", ""), ("refs/a//", ""),
    ("refs/heads/`", ""), ("refs/heads/\u2003", ""), ("info/", ""), ("_x/", ""), ("assets/", ""),
)


def _names(spark, d) -> DataFrame:
    plain = F.replace("p_name", F.lit(" "), F.lit("-"))
    names = F.array(*(F.concat(F.lit(before), plain, F.lit(after)) for before, after in _AROUND))
    rows = T.table(spark, d, "part").select("p_partkey", F.posexplode(names).alias("i", "name"))
    return rows.select("p_partkey", "i", H.is_ref_name(F.col("name")).alias("is_ref"), H.is_repo_name(F.col("name"), True).alias("is_repo"), H.short_ref(F.col("name")).alias("short"))


_LISTED = "SELECT r.repo, r.name, r.target, CASE WHEN r.target < 0 THEN -r.target END AS peeled"
QUERIES = {
    "list_refs": (
        lambda spark, d: refs.list_refs(event_refs(spark, d), _peeled(spark, d)),
        f"{_LISTED}, regexp_replace(name, '^refs/(heads|tags)/', '') AS short, starts_with(name, 'refs/heads/') AS is_branch FROM {_REFS} r",
    ),
    "decorations": (
        lambda spark, d: refs.decorations(event_refs(spark, d), _peeled(spark, d)).select("repo", "oid", F.array_join("labels", " ").alias("labels")),
        f"SELECT repo, abs(target) AS oid, string_agg(regexp_replace(name, '^refs/(heads|tags)/', ''), ' ' ORDER BY regexp_replace(name, '^refs/(heads|tags)/', '')) AS labels FROM {_REFS} r GROUP BY ALL",
    ),
    "resolve_ref_priority": (
        _resolve,
        f"""WITH a AS (SELECT DISTINCT user_id AS repo, unnest(['click', 'v1', 'refs/heads/view', 'nothing', NULL]) AS asked FROM events
          UNION ALL SELECT user_id, CAST(min(event_id) AS VARCHAR) FROM events GROUP BY user_id),
        n AS (SELECT *, coalesce(asked, 'refs/heads/purchase') AS name FROM a),
        c AS (SELECT n.repo, asked, 0 AS k, CAST(target AS VARCHAR) AS oid FROM n JOIN {_REFS} r ON r.repo = n.repo AND r.name = 'refs/heads/' || n.name
          UNION ALL SELECT n.repo, asked, 1, CAST(target AS VARCHAR) FROM n JOIN {_REFS} r ON r.repo = n.repo AND r.name = 'refs/tags/' || n.name
          UNION ALL SELECT n.repo, asked, 2, CAST(target AS VARCHAR) FROM n JOIN {_REFS} r ON r.repo = n.repo AND r.name = n.name
          UNION ALL SELECT n.repo, asked, 3, n.name FROM n JOIN events e ON e.user_id = n.repo AND CAST(e.event_id AS VARCHAR) = n.name)
        SELECT a.repo, a.asked, (SELECT min_by(oid, k) FROM c WHERE c.repo = a.repo AND c.asked IS NOT DISTINCT FROM a.asked) AS oid FROM a""",
    ),
    "latest_commit_time": (
        lambda spark, d: refs.latest_commit_time(event_refs(spark, d), _peeled(spark, d), T.event_commits(spark, d)),
        "SELECT user_id AS repo, CAST(floor(epoch_us(max(ts)) / 1000000) AS BIGINT) * 1000 AS latest_ms FROM events GROUP BY user_id",
    ),
    "ref_fingerprint": (
        lambda spark, d: refs.fingerprint(_text_refs(spark, d), _heads(spark, d)),
        f"SELECT repo, sha1(string_agg(name || chr(0) || target, chr(10) ORDER BY name || chr(0) || target) || chr(10) || 'HEAD' || chr(0) || 'refs/heads/purchase') AS version FROM {_REFS} r GROUP BY repo",
    ),
    "push_decisions": (_decided, f"SELECT repo, batch, seq, ref, old, new, message IS NULL AS ok, message, forced FROM {_DECIDED} d"),
    "apply_ref_updates": (
        _applied,
        f"""SELECT repo, name, CAST(target AS VARCHAR) AS target FROM {_REFS} r UNION ALL
        SELECT repo, ref, new FROM (SELECT * FROM {_DECIDED} d WHERE message IS NULL QUALIFY row_number() OVER (PARTITION BY repo, ref ORDER BY batch DESC, seq DESC) = 1) WHERE new <> {_ZERO}""",
    ),
    "repair_head": (
        lambda spark, d: refs.repair_head(_heads(spark, d), event_refs(spark, d)),
        f"SELECT repo, coalesce(max(CASE WHEN name = 'refs/heads/purchase' THEN name END), min(CASE WHEN starts_with(name, 'refs/heads/') THEN name END)) AS ref_name FROM {_REFS} r GROUP BY repo",
    ),
    "registry_top_public": (
        lambda spark, d: refs.list_public(T.catalog(spark, d), 20).select("name", "idle"),
        "SELECT s_name AS name, CAST(round(s_acctbal * 100) AS BIGINT) AS idle FROM supplier WHERE s_acctbal >= 0 ORDER BY idle DESC, name LIMIT 20",
    ),
    "registry_namespace_range": (
        lambda spark, d: refs.list_public(T.table(spark, d, "documents").select(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("name"), (F.col("n_chars") > 3000).alias("private"), F.col("n_chars").alias("idle")), 100, "de").select("name", "idle"),
        "SELECT lang || '/' || source || '/' || doc_id AS name, n_chars AS idle FROM documents WHERE n_chars <= 3000 AND lang = 'de' ORDER BY idle DESC, name LIMIT 100",
    ),
    "registry_upsert": (
        _upserted,
        """WITH p AS (SELECT user_id AS name, max_by(epoch_us(ts) // 1000, struct_pack(a := ts, b := event_id)) AS idle, count(*) AS n FROM events GROUP BY user_id)
        SELECT coalesce(c_custkey, p.name) AS name, coalesce(p.idle, CAST(round(c_acctbal * 100) AS BIGINT)) AS idle, CAST(CASE WHEN c_custkey IS NULL THEN 0 ELSE 1 END + coalesce(n, 0) AS BIGINT) AS ver FROM customer FULL JOIN p ON p.name = c_custkey""",
    ),
    "registry_config": (
        _patched,
        "SELECT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN substr(repeat(s_name, 20), 1, 200) ELSE 'none' END AS description, 'me' AS owner, CASE WHEN s_suppkey % 2 = 0 THEN 'tools' END AS section, s_suppkey % 4 = 0 OR s_acctbal < 0 AS private FROM supplier",
    ),
    "collection_due": (_due, "SELECT user_id AS repo, max(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)) + 300 AS due FROM events WHERE event_type = 'error' GROUP BY user_id"),
    "name_validity": (
        _names,
        """SELECT p_partkey, CAST(i AS INT) AS i, i = 0 AS is_ref, i IN (4, 11) AS is_repo, CASE WHEN i IN (0, 1) THEN n || CASE WHEN i = 1 THEN '.lock' ELSE '' END
          ELSE ['refs/' || n || '/', 'refs/.' || n, 'x/' || n, 'refs/a@{' || n, 'refs/a//' || n, '`' || n, chr(8195) || n, 'info/' || n, '_x/' || n, 'assets/' || n][i - 1] END AS short
        FROM (SELECT p_partkey, replace(p_name, ' ', '-') AS n, unnest(range(12)) AS i FROM part)""",
    ),
}
