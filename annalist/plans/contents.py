"""Queries on trees, files, diffs and blame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import history as H
from ..operators import diff, files, refs, snapshot, store
from ..sources import tables as T
from .references import _REFS, _heads, _peeled, event_refs

_OLD, _NEW = "1995-01-01", "1997-01-01"


def _as_of(spark, d, day: str) -> DataFrame:
    """The tree at a day: a file for each customer, whose blob is the last order before it."""
    o = T.table(spark, d, "orders").where(F.col("o_orderdate") < day)
    return o.groupBy(F.col("o_custkey").alias("path")).agg(
        F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("oid"), F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("mode")
    )


_TREE = "(SELECT o_custkey AS path, max_by(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS oid, max_by(o_orderpriority, struct_pack(a := o_orderdate, b := o_orderkey)) AS mode FROM orders WHERE o_orderdate < '{}' GROUP BY o_custkey)"


def _pairs(spark, d) -> DataFrame:
    """repo, ordinal, old, new: each turn of a conversation against the one before, a word a line."""
    turn = Window.partitionBy("conv_id").orderBy("turn")
    lines = F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit("\n"))
    c = T.table(spark, d, "conversations").select("conv_id", "turn", lines.alias("new"))
    return c.select(F.col("conv_id").alias("repo"), F.col("turn").alias("ordinal"), F.lag("new").over(turn).alias("old"), "new")


def _diffstat(spark, d) -> DataFrame:
    return diff.diff_counts(_pairs(spark, d)).select("repo", "ordinal", "kind", "added", "deleted")


def _hunks(spark, d) -> DataFrame:
    return diff.diff_hunks(_pairs(spark, d)).select("repo", "ordinal", F.inline("hunks"))


def _event_hunks(spark, d) -> DataFrame:
    """Hunks over rows whose tags come from the events themselves, which SQL can follow."""
    e = T.table(spark, d, "events")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    tag = F.when(F.col("event_id") % 23 == 0, "add").when(F.col("event_id") % 29 == 0, "del").otherwise("eq")
    ops = e.select(F.col("user_id").alias("repo"), i.alias("i"), tag.alias("tag"), F.col("event_type").alias("line"))
    return diff.hunks(ops, "repo").drop("hunk")


_EVENT_HUNKS = """WITH o AS (SELECT user_id AS repo, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, event_type AS line,
    CASE WHEN event_id % 23 = 0 THEN 'add' WHEN event_id % 29 = 0 THEN 'del' ELSE 'eq' END AS tag FROM events),
  n AS (SELECT *, coalesce(sum((tag <> 'add')::INT) OVER w, 0) + 1 AS a, coalesce(sum((tag <> 'del')::INT) OVER w, 0) + 1 AS b FROM o WINDOW w AS (PARTITION BY repo ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  c AS (SELECT repo, i, CASE WHEN i - lag(i) OVER (PARTITION BY repo ORDER BY i) <= 6 THEN 0 ELSE 1 END AS new FROM o WHERE tag <> 'eq'),
  g AS (SELECT repo, h, min(i) - 3 AS lo, max(i) + 3 AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY repo ORDER BY i) AS h FROM c) GROUP BY repo, h),
  m AS (SELECT n.*, g.h FROM n JOIN g ON g.repo = n.repo AND n.i BETWEEN g.lo AND g.hi)
  SELECT repo, CAST(CASE WHEN sum((tag <> 'add')::INT) = 0 THEN min(a) - 1 ELSE min(a) END AS BIGINT) AS a_start, CAST(sum((tag <> 'add')::INT) AS BIGINT) AS a_len,
    CAST(CASE WHEN sum((tag <> 'del')::INT) = 0 THEN min(b) - 1 ELSE min(b) END AS BIGINT) AS b_start, CAST(sum((tag <> 'del')::INT) AS BIGINT) AS b_len,
    string_agg(CASE tag WHEN 'add' THEN '+' WHEN 'del' THEN '-' ELSE ' ' END || line, chr(10) ORDER BY i) AS body FROM m GROUP BY repo, h"""


def _patches(spark, d) -> DataFrame:
    changed = diff.diff_hunks(_pairs(spark, d)).select(
        F.concat_ws("/", F.col("repo").cast("string"), F.col("ordinal").cast("string")).alias("path"),
        F.when(F.col("old").isNotNull(), H.object_id("blob", F.col("old"))).alias("old_oid"),
        H.object_id("blob", F.col("new")).alias("new_oid"),
        F.when(F.col("old").isNotNull(), "100644").alias("old_mode"),
        F.lit("100644").alias("new_mode"),
        "kind",
        "hunks",
    )
    return diff.patch_whole(changed)


def _blame_runs(spark, d) -> DataFrame:
    """Runs of events of one type as if they were lines."""
    e = T.table(spark, d, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return diff.runs(e.select(F.col("user_id").alias("repo"), n.alias("line_no"), F.col("event_type").alias("oid")))


def _trees(spark, d) -> DataFrame:
    """tree_oid, name, mode, oid: documents as files of a repository for each source, in a directory for each language;
    every tenth is a link to another repository."""
    rows = T.table(spark, d, "documents").select("source", "lang", F.col("doc_id").cast("string").alias("name"), "doc_id")
    folder = F.concat_ws("/", "source", "lang")
    top = rows.select(F.col("source").alias("tree_oid"), F.col("lang").alias("name"), F.lit("40000").alias("mode"), folder.alias("oid")).distinct()
    return top.unionByName(rows.select(folder.alias("tree_oid"), "name", F.when(F.col("doc_id") % 10 == 0, "160000").otherwise("100644").alias("mode"), F.col("name").alias("oid")))


def _stored(spark, d) -> DataFrame:
    return T.blobs(spark, d).where("doc_id % 10 <> 0").select(F.col("doc_id").cast("string").alias("oid"), "data")


def _requests(spark, d, path) -> DataFrame:
    return T.table(spark, d, "documents").select(F.col("source").alias("repo"), path.alias("path"), F.col("source").alias("tree_oid"))


def _list_tree(spark, d) -> DataFrame:
    """Each repository's root, and each of its directories."""
    asked = _requests(spark, d, F.lit("")).unionByName(_requests(spark, d, F.col("lang"))).distinct()
    return files.list_trees(_trees(spark, d), asked, _stored(spark, d)).select("repo", "path", "name", "mode", "type", "oid", "size")


def _read_blob(spark, d) -> DataFrame:
    """Each document by its path, and paths that lead nowhere: behind a file, and to no file."""
    whole = F.concat_ws("/", "lang", F.col("doc_id").cast("string"))
    asked = _requests(spark, d, whole).unionByName(_requests(spark, d, F.concat(whole, F.lit("/x")))).unionByName(_requests(spark, d, F.concat("lang", F.lit("/none"))))
    return files.read_blobs(_trees(spark, d), asked, _stored(spark, d)).select("repo", "path", "oid", "mode", F.octet_length("data").cast("long").alias("size"))


def _read_commit(spark, d) -> DataFrame:
    names = F.array(F.lit("click"), F.lit("v1"), F.lit("refs/heads/view"), F.lit("nothing"))
    asked = T.table(spark, d, "events").select(F.col("user_id").alias("repo")).distinct().select("repo", F.explode(names).alias("asked"))
    own = T.event_commits(spark, d).select("repo", "oid", "author", "time", "subject")
    found = refs.resolve(asked, event_refs(spark, d), _heads(spark, d), own.select("repo", F.col("oid").cast("string").alias("oid")).limit(0))
    return files.read_commits(found.where("oid IS NOT NULL").select("repo", "asked", F.col("oid").cast("long").alias("oid")), _peeled(spark, d), own)


def _modes(spark, d) -> DataFrame:
    modes = F.element_at(F.array(*(F.lit(m) for m in ("100644", "100755", "120000", "40000", "160000"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return T.table(spark, d, "part").select("p_partkey", modes.alias("mode")).select("p_partkey", H.mode_kind(F.col("mode")).alias("kind"), H.mode_string(F.col("mode")).alias("shown"))


_FIVE = "[{}][p_partkey % 5 + 1]"


def _flags(spark, d) -> DataFrame:
    p = T.table(spark, d, "pages")
    nul = F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("\0"))).otherwise(F.col("html"))
    path = F.concat(F.lit("a/"), "page_id", F.element_at(F.array(*(F.lit(x) for x in (".PNG", ".json", "/../x", "", ".svg", ".html"))), (F.col("page_id") % 6 + 1).cast("int")))
    return p.select("page_id", H.is_binary(nul).alias("is_binary"), H.content_type(path, nul).alias("content_type"), H.is_safe_path(path).alias("is_safe"), F.array_join(H.path_segments(path), "/").alias("clean"), F.length(H.escape_html(F.col("html"))).cast("long").alias("escaped"))


def _readme(spark, d) -> DataFrame:
    names = F.element_at(F.array(F.lit("README"), F.when(F.col("lang") != "fr", "Readme.md").otherwise("main.h"), F.lit("main.c"), F.lit("readme.txt"), F.when(F.col("lang") == "de", "About").otherwise("about.txt")), (F.col("doc_id") % 5 + 1).cast("int"))
    return refs.readme(T.table(spark, d, "documents").select(F.concat_ws("/", "source", "lang").alias("repo"), F.concat(names, F.lit("")).alias("name"), F.col("doc_id").alias("oid"), F.lit("100644").alias("mode")).groupBy("repo", "name", "mode").agg(F.min("oid").alias("oid")))


def _budget(spark, d) -> DataFrame:
    sized = T.blobs(spark, d).withColumn("source", F.split("path", "/")[0])
    return store.within_budget(sized, F.octet_length("data").cast("long"), 100_000, "source").select("path", "running", "kept")


_FIRST = "SELECT {} FROM (SELECT source || '/' || lang || '/' || doc_id AS path, source, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size FROM documents)"
QUERIES = {
    "tree_diff_full_outer": (
        lambda spark, d: diff.tree_diff(_as_of(spark, d, _OLD), _as_of(spark, d, _NEW)),
        f"SELECT coalesce(a.path, b.path) AS path, a.oid AS old_oid, a.mode AS old_mode, b.oid AS new_oid, b.mode AS new_mode FROM {_TREE.format(_OLD)} a FULL JOIN {_TREE.format(_NEW)} b ON a.path = b.path WHERE a.oid IS DISTINCT FROM b.oid OR a.mode IS DISTINCT FROM b.mode",
    ),
    "tree_diff_page": (
        lambda spark, d: diff.tree_diff(_as_of(spark, d, _OLD), _as_of(spark, d, _NEW), 101),
        f"SELECT coalesce(a.path, b.path) AS path, a.oid AS old_oid, a.mode AS old_mode, b.oid AS new_oid, b.mode AS new_mode FROM {_TREE.format(_OLD)} a FULL JOIN {_TREE.format(_NEW)} b ON a.path = b.path WHERE a.oid IS DISTINCT FROM b.oid OR a.mode IS DISTINCT FROM b.mode ORDER BY 1 LIMIT 101",
    ),
    "diffstat": (_diffstat, None),
    "myers_hunks": (_hunks, None),
    "hunk_islands": (_event_hunks, _EVENT_HUNKS),
    "unified_patch": (_patches, None),
    "blame_lines": (lambda spark, d: diff.blame(T.revisions(spark, d)), None),
    "blame_runs": (
        _blame_runs,
        """SELECT repo, min(n) AS first_line, max(n) AS last_line, oid FROM (SELECT *, n - row_number() OVER (PARTITION BY repo, oid ORDER BY n) AS g FROM
        (SELECT user_id AS repo, event_type AS oid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)) GROUP BY repo, oid, g""",
    ),
    "line_explode": (
        lambda spark, d: T.blobs(spark, d).select("doc_id", F.posexplode(H.text_lines(F.col("data"))).alias("line_no", "line")),
        """WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        c AS (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM s)
        SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS line_no, unnest(l) AS line FROM c""",
    ),
    "list_tree": (
        _list_tree,
        """SELECT DISTINCT source AS repo, '' AS path, lang AS name, '40000' AS mode, 'tree' AS type, source || '/' || lang AS oid, CAST(NULL AS BIGINT) AS size FROM documents
        UNION ALL SELECT source, lang, CAST(doc_id AS VARCHAR), CASE WHEN doc_id % 10 = 0 THEN '160000' ELSE '100644' END, CASE WHEN doc_id % 10 = 0 THEN 'commit' ELSE 'blob' END,
        CAST(doc_id AS VARCHAR), CASE WHEN doc_id % 10 <> 0 THEN CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) END FROM documents""",
    ),
    "read_blob": (
        _read_blob,
        """SELECT source AS repo, lang || '/' || doc_id AS path, CAST(doc_id AS VARCHAR) AS oid, '100644' AS mode, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size
        FROM documents WHERE doc_id % 10 <> 0""",
    ),
    "read_commit": (
        _read_commit,
        f"""SELECT r.repo, a.asked, e.event_id AS oid, 'user ' || e.user_id AS author, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS time, event_type AS subject
        FROM (SELECT unnest(['click', 'v1', 'refs/heads/view']) AS asked, unnest(['refs/heads/click', 'refs/tags/v1', 'refs/heads/view']) AS name) a
        JOIN {_REFS} r ON r.name = a.name JOIN events e ON e.event_id = abs(r.target) AND e.user_id = r.repo""",
    ),
    "mode_flags": (
        _modes,
        f"""SELECT p_partkey, {_FIVE.format("'blob', 'blob', 'symlink', 'tree', 'commit'")} AS kind, {_FIVE.format("'-rw-r--r--', '-rwxr-xr-x', 'lrwxrwxrwx', 'd---------', 'm---------'")} AS shown FROM part""",
    ),
    "file_flags": (
        _flags,
        """SELECT page_id, page_id % 3 = 0 AND octet_length(encode(html)) < 8000 AS is_binary,
        CASE page_id % 6 WHEN 0 THEN 'image/png' WHEN 4 THEN 'text/plain; charset=utf-8' WHEN 5 THEN 'text/plain' ELSE CASE WHEN page_id % 3 = 0 AND octet_length(encode(html)) < 8000 THEN 'application/octet-stream' ELSE 'text/plain; charset=utf-8' END END AS content_type,
        page_id % 6 <> 2 AS is_safe, 'a/' || page_id || ['.PNG', '.json', '/x', '', '.svg', '.html'][page_id % 6 + 1] AS clean,
        CAST(length(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS BIGINT) AS escaped FROM pages""",
    ),
    "readme_choice": (
        _readme,
        """WITH e AS (SELECT source || '/' || lang AS repo, ['README', CASE WHEN lang <> 'fr' THEN 'Readme.md' ELSE 'main.h' END, 'main.c', 'readme.txt', CASE WHEN lang = 'de' THEN 'About' ELSE 'about.txt' END][doc_id % 5 + 1] AS name, min(doc_id) AS oid FROM documents GROUP BY ALL)
        SELECT repo, name, oid FROM e WHERE name IN ('About', 'Readme.md', 'README', 'readme.txt') QUALIFY row_number() OVER (PARTITION BY repo ORDER BY list_position(['About', 'Readme.md', 'README', 'readme.txt'], name)) = 1""",
    ),
    "snapshot_budget": (
        _budget,
        _FIRST.format("path, CAST(sum(size) OVER (PARTITION BY source ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running, sum(size) OVER (PARTITION BY source ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 100000 AS kept"),
    ),
    "archive_parts": (
        lambda spark, d: snapshot.parts(T.blobs(spark, d).withColumn("repo", F.concat_ws("/", F.split("path", "/")[0], F.split("path", "/")[1])).withColumn("mode", F.lit("100644")), budget=20_000),
        """WITH f AS (SELECT source || '/' || lang AS repo, source || '/' || lang || '/' || doc_id AS path, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size FROM documents),
        p AS (SELECT *, CAST(floor(coalesce(sum(size) OVER (PARTITION BY repo ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 20000) AS BIGINT) AS part FROM f)
        SELECT repo, part, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes, min(path) AS first_path, max(path) AS last_path FROM p GROUP BY repo, part""",
    ),
}
