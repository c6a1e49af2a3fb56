"""Queries on object graphs and the object store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import history as H
from ..operators import graph, store
from ..operators.graph import checkpointed
from ..sources import tables as T

_EDGES = """(SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'nation' AS kind FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'customer' FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'order' FROM orders)"""
_REACH = f"WITH RECURSIVE reach AS (SELECT 'r' || r_regionkey AS id, 0 AS depth FROM region WHERE r_regionkey < 2 UNION SELECT e.dst, depth + 1 FROM reach JOIN {_EDGES} e ON e.src = reach.id)"
_PARENTS = "(SELECT event_id AS oid, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent FROM events)"
_ENTRIES = '(SELECT l_suppkey AS pack_id, l_orderkey AS "offset", l_linenumber AS line, l_partkey AS oid, CAST(l_quantity AS BIGINT) AS size FROM lineitem)'


def _roots(spark, d, where: str) -> DataFrame:
    return T.table(spark, d, "region").where(where).select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))


def _closure(spark, d, **limits) -> DataFrame:
    return graph.closure(T.object_edges(spark, d), _roots(spark, d, "r_regionkey < 2"), **limits)


def _garbage(spark, d) -> DataFrame:
    objects = T.table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderstatus"))
    bases = objects.where("o_orderstatus = 'P'").select("id")
    return graph.unreachable(objects.select("id").distinct(), _closure(spark, d), bases)


def _difference(spark, d) -> DataFrame:
    edges = T.object_edges(spark, d)
    haves = graph.closure(edges, T.table(spark, d, "nation").where("n_regionkey = 0 AND n_nationkey % 2 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id")))
    return graph.closure(edges, _roots(spark, d, "r_regionkey < 2"), haves).select("id")


def _ancestry(spark, d) -> DataFrame:
    parents = T.event_commits(spark, d).select("oid", "parent", "repo", "time")
    newest = parents.withColumn("r", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("time"), F.desc("oid")))).where("r = 1")
    return graph.ancestor_pairs(parents.select("oid", "parent"), newest.select("oid"))


def _is_ancestor(spark, d) -> DataFrame:
    e = T.table(spark, d, "events")
    pairs = e.select(F.col("event_id").alias("anc"), (F.col("event_id") + 7).alias("desc"))
    return graph.is_ancestor(checkpointed(T.event_parents(spark, d)), pairs)


def _merges(spark, d) -> DataFrame:
    """repo, oid, nth, parent, order: histories in two strands, as a commit's first parent is the one two before it; every fourth
    also merges the one right before it."""
    chain = Window.partitionBy("user_id").orderBy("ts", "event_id")
    side = F.when(F.col("event_id") % 4 == 0, F.lag("event_id").over(chain))
    both = F.array(F.struct(F.lit(0).alias("nth"), F.lag("event_id", 2).over(chain).alias("parent")), F.struct(F.lit(1).alias("nth"), side.alias("parent")))
    rows = T.table(spark, d, "events").select(F.col("user_id").alias("repo"), F.col("event_id").alias("oid"), F.row_number().over(chain).alias("order"), both.alias("both")).select("repo", "oid", "order", F.inline("both"))
    return checkpointed(rows.where("nth = 0 OR parent IS NOT NULL"))


def _history(spark, d) -> DataFrame:
    newest = T.table(spark, d, "events").groupBy(F.col("user_id").alias("repo")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("oid"))
    return graph.history(_merges(spark, d), newest, ("repo",))


def _ancestor_over_merges(spark, d) -> DataFrame:
    later = F.lead("event_id", 9).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = T.table(spark, d, "events").select(F.col("event_id").alias("anc"), later.alias("desc")).where("desc IS NOT NULL")
    return graph.is_ancestor(_merges(spark, d).drop("repo"), pairs)


_MERGES = """e AS (SELECT user_id AS repo, event_id AS oid, lag(event_id, 2) OVER w AS p0, CASE WHEN event_id % 4 = 0 THEN lag(event_id) OVER w END AS p1, lead(event_id, 9) OVER w AS later,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  p AS (SELECT repo, oid, p0 AS parent FROM e WHERE p0 IS NOT NULL UNION ALL SELECT repo, oid, p1 FROM e WHERE p1 IS NOT NULL)"""


def _flatten(spark, d) -> DataFrame:
    """Documents lie at source/lang/doc_id; the entries of these trees are built from the paths, and flattened again."""
    rows = T.table(spark, d, "documents").select("source", "lang", F.col("doc_id").cast("string").alias("name"))
    top = rows.select(F.lit("root").alias("tree_oid"), F.col("source").alias("name"), F.lit("40000").alias("mode"), F.col("source").alias("oid")).distinct()
    middle = rows.select(F.col("source").alias("tree_oid"), F.col("lang").alias("name"), F.lit("40000").alias("mode"), F.concat_ws("/", "source", "lang").alias("oid")).distinct()
    leaf = rows.select(F.concat_ws("/", "source", "lang").alias("tree_oid"), "name", F.when(F.col("name").cast("long") % 10 == 0, "160000").otherwise("100644").alias("mode"), F.col("name").alias("oid"))
    entries = top.unionByName(middle).unionByName(leaf)
    return graph.flatten_tree(entries, spark.createDataFrame([("root",)], "tree_oid string")).select("path", "mode", "oid")


def _emission(spark, d) -> DataFrame:
    entries = store.first_locations(T.pack_entries(spark, d)).withColumn("base_oid", F.when(F.col("oid") % 3 == 0, F.col("oid") - 1))
    wanted = T.table(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("oid"))
    return store.emission(entries, wanted).select("oid", "emit", "pack_id", "offset")


def _blob_first(spark, d) -> DataFrame:
    blobs = T.blobs(spark, d).select(H.object_id("blob", F.col("data")).alias("oid"), "doc_id")
    return blobs.groupBy("oid").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


_SHA = "sha1(CAST('blob ' || octet_length(encode(coalesce(text, ''))) AS BLOB) || '\\x00'::BLOB || encode(coalesce(text, '')))"


def _prefixes(spark, d) -> DataFrame:
    oids = T.blobs(spark, d).select(H.object_id("blob", F.col("data")).alias("oid"), "doc_id")
    prefixes = oids.select(F.substring(F.col("oid"), F.lit(1), F.when(F.col("doc_id") % 2 == 0, 4).otherwise(8)).alias("prefix")).distinct()
    return store.resolve_prefix(oids.select("oid"), prefixes)


def _counts(spark, d) -> DataFrame:
    parts = T.table(spark, d, "part").select(F.col("p_partkey").alias("oid"))
    packs = T.pack_entries(spark, d).groupBy("pack_id").agg(F.sum("size").alias("size"))
    return store.storage_counts(parts, T.pack_entries(spark, d), packs)


QUERIES = {
    "edges_all": (T.object_edges, f"SELECT src, dst, kind FROM {_EDGES}"),
    "reachable_closure": (_closure, f"{_REACH} SELECT id, CAST(min(depth) AS INT) AS depth FROM reach GROUP BY id"),
    "depth_limited": (
        lambda spark, d: _closure(spark, d, max_depth=2),
        f"{_REACH} SELECT id, CAST(min(depth) AS INT) AS depth FROM reach GROUP BY id HAVING min(depth) <= 2",
    ),
    "shallow_boundary": (
        lambda spark, d: graph.boundary(_closure(spark, d, max_depth=2), 2),
        f"{_REACH} SELECT id, CAST(min(depth) AS INT) AS depth FROM reach GROUP BY id HAVING min(depth) = 2",
    ),
    "gc_unreachable": (_garbage, f"{_REACH} SELECT DISTINCT 'o' || o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P' AND 'o' || o_orderkey NOT IN (SELECT id FROM reach)"),
    "closure_difference": (
        _difference,
        f"""WITH RECURSIVE have AS (SELECT 'n' || n_nationkey AS id FROM nation WHERE n_regionkey = 0 AND n_nationkey % 2 = 0 UNION SELECT e.dst FROM have JOIN {_EDGES} e ON e.src = have.id),
        want AS (SELECT 'r' || r_regionkey AS id FROM region WHERE r_regionkey < 2 UNION SELECT e.dst FROM want JOIN {_EDGES} e ON e.src = want.id)
        SELECT id FROM want EXCEPT SELECT id FROM have""",
    ),
    "ancestor_chain": (
        _ancestry,
        """WITH c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
        SELECT a.event_id AS oid, b.event_id AS ancestor, CAST(b.r - a.r AS INT) AS distance FROM c a JOIN c b ON a.user_id = b.user_id AND a.r = 1""",
    ),
    "is_ancestor": (
        _is_ancestor,
        """WITH c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
        SELECT a.event_id AS anc, a.event_id + 7 AS desc, coalesce(b.user_id = a.user_id AND a.r <= b.r, false) AS is_ancestor FROM c a LEFT JOIN c b ON b.event_id = a.event_id + 7""",
    ),
    "history_over_merges": (
        _history,
        f"WITH RECURSIVE {_MERGES}, h AS (SELECT repo, oid FROM e WHERE r = 1 UNION SELECT p.repo, p.parent FROM h JOIN p ON p.repo = h.repo AND p.oid = h.oid) SELECT repo, oid FROM h",
    ),
    "is_ancestor_over_merges": (
        _ancestor_over_merges,
        f"""WITH RECURSIVE {_MERGES}, h AS (SELECT oid AS anc, later AS late, later AS node FROM e WHERE later IS NOT NULL UNION SELECT h.anc, h.late, p.parent FROM h JOIN p ON p.oid = h.node WHERE h.node <> h.anc)
        SELECT anc, late AS desc, bool_or(node = anc) AS is_ancestor FROM h GROUP BY anc, late""",
    ),
    "missing_children": (
        lambda spark, d: graph.missing(T.object_edges(spark, d).where("kind = 'order'"), T.table(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("id"))),
        "SELECT DISTINCT 'o' || o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    ),
    "missing_edges_double_anti": (
        lambda spark, d: graph.missing(
            T.table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_orderkey").alias("dst")),
            T.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")),
            T.table(spark, d, "orders").where("o_orderpriority LIKE '1%'").select(F.col("o_orderkey").alias("id")),
        ),
        """SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')
        AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority LIKE '1%')""",
    ),
    "orphan_packs": (
        lambda spark, d: store.orphan_packs(
            T.table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("pack_id")), T.pack_entries(spark, d), T.table(spark, d, "part").select((F.col("p_partkey") % 50).alias("pack_id"))
        ),
        "SELECT pack_id FROM (SELECT l_suppkey AS pack_id FROM lineitem UNION SELECT p_partkey % 50 FROM part) WHERE pack_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)",
    ),
    "first_locations": (
        lambda spark, d: store.first_locations(T.pack_entries(spark, d)).groupBy("oid", "pack_id", "offset", "line").agg(F.count(F.lit(1)).alias("n")),
        f'SELECT oid, pack_id, "offset", line, 1 AS n FROM {_ENTRIES} QUALIFY row_number() OVER (PARTITION BY oid ORDER BY pack_id, "offset", line) = 1',
    ),
    "keyset_single": (
        lambda spark, d: store.keyset_page(T.table(spark, d, "documents").select("doc_id", "lang"), ["doc_id"], [100], 50),
        "SELECT doc_id, lang FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 50",
    ),
    "keyset_composite": (
        lambda spark, d: store.keyset_page(T.pack_entries(spark, d).select("pack_id", "offset", "oid").distinct(), ["pack_id", "offset", "oid"], [3, 500, 0], 1000),
        f'SELECT DISTINCT pack_id, "offset", oid FROM {_ENTRIES} WHERE pack_id > 3 OR (pack_id = 3 AND ("offset" > 500 OR ("offset" = 500 AND oid > 0))) ORDER BY pack_id, "offset", oid LIMIT 1000',
    ),
    "emit_classes": (
        _emission,
        f"""WITH e AS (SELECT *, CASE WHEN oid % 3 = 0 THEN oid - 1 END AS base FROM {_ENTRIES} QUALIFY row_number() OVER (PARTITION BY oid ORDER BY pack_id, "offset", line) = 1),
        w AS (SELECT p_partkey AS oid FROM part WHERE p_size < 25)
        SELECT w.oid, CASE WHEN pack_id IS NULL THEN 'inflate' WHEN base IS NULL THEN 'copy' WHEN base IN (SELECT oid FROM w) THEN 'delta' ELSE 'inflate' END AS emit, pack_id, "offset" FROM w LEFT JOIN e USING (oid)""",
    ),
    "storage_counts": (
        _counts,
        "SELECT CAST((SELECT count(*) FROM part) + (SELECT count(*) FROM lineitem) AS BIGINT) AS n_objects, CAST((SELECT sum(CAST(l_quantity AS BIGINT)) FROM lineitem) AS BIGINT) AS pack_bytes, (SELECT max(l_suppkey) + 1 FROM lineitem) AS next_pack",
    ),
    "blob_oid": (lambda spark, d: T.blobs(spark, d).select("doc_id", H.object_id("blob", F.col("data")).alias("oid")), f"SELECT doc_id, {_SHA} AS oid FROM documents"),
    "blob_dedup_first": (_blob_first, f"SELECT {_SHA} AS oid, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1"),
    "resolve_prefix": (
        _prefixes,
        f"""WITH o AS (SELECT DISTINCT {_SHA} AS oid FROM documents), p AS (SELECT DISTINCT substr({_SHA}, 1, CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 8 END) AS prefix FROM documents),
        h AS (SELECT prefix, count(*) AS n, min(oid) AS oid FROM p JOIN o ON starts_with(oid, prefix) GROUP BY prefix)
        SELECT p.prefix, CASE WHEN n = 1 THEN oid END AS oid FROM p LEFT JOIN h USING (prefix)""",
    ),
    "tree_flatten": (
        _flatten,
        "SELECT source || '/' || lang || '/' || doc_id AS path, '100644' AS mode, CAST(doc_id AS VARCHAR) AS oid FROM documents WHERE doc_id % 10 <> 0",
    ),
}
