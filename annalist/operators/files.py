"""Files by path: lookups in trees, listings, blobs and commits as a client asks for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.history import mode_kind, path_segments
from .graph import checkpointed


def lookup(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """`requests` (tree_oid, path, and other columns) that lead somewhere, with `kind` (tree or blob), `oid` and `mode`.

    `entries` is (tree_oid, name, mode, oid). A round follows one segment of all paths at once; what isn't there, or goes
    on behind a file, is left out. An empty path is the tree itself.
    """
    asked = F.struct(*(F.col(c) for c in requests.columns)).alias("asked")
    at = requests.select(asked, path_segments(F.col("path")).alias("segments"), F.col("tree_oid").alias("oid"), F.lit("40000").alias("mode"))
    names = entries.select(F.col("tree_oid").alias("oid"), F.col("name"), F.col("mode").alias("mode_"), F.col("oid").alias("oid_"))
    found, at = None, checkpointed(at)
    while found is None or not at.isEmpty():
        here = at.where(F.size("segments") == 0).select("asked", "oid", "mode")
        found = here if found is None else found.unionAll(here)
        onward = at.where((F.size("segments") > 0) & F.col("mode").isin("40000", "040000")).withColumn("name", F.get("segments", F.lit(0)))
        at = checkpointed(onward.join(names, ["oid", "name"]).select("asked", F.slice("segments", F.lit(2), F.size("segments")).alias("segments"), F.col("oid_").alias("oid"), F.col("mode_").alias("mode")))
    kind = F.when(F.col("mode").isin("40000", "040000"), "tree").otherwise("blob")
    return found.select(*(F.col("asked")[c].alias(c) for c in requests.columns if c != "tree_oid"), kind.alias("kind"), "oid", "mode")


def read_blobs(entries: DataFrame, requests: DataFrame, blobs: DataFrame) -> DataFrame:
    """The requests that lead to a blob in `blobs` (oid, data), with oid, mode and data."""
    files = lookup(entries, requests).where("kind = 'blob'").drop("kind")
    return files.join(blobs.select("oid", "data"), "oid")


def list_trees(entries: DataFrame, requests: DataFrame, blobs: DataFrame) -> DataFrame:
    """The entries of the trees that the requests lead to: name, mode, type, oid, and size of blobs."""
    trees = lookup(entries, requests).where("kind = 'tree'").drop("kind", "mode").withColumnRenamed("oid", "tree_oid")
    sizes = blobs.select("oid", F.octet_length("data").cast("long").alias("size_"))
    kind = F.when(mode_kind(F.col("mode")).isin("tree", "commit"), mode_kind(F.col("mode"))).otherwise("blob")
    listed = trees.join(entries, "tree_oid").drop("tree_oid").withColumn("type", kind).join(sizes, "oid", "left")
    return listed.withColumn("size", F.when(F.col("type") == "blob", F.col("size_"))).drop("size_")


def read_commits(resolved: DataFrame, peeled: DataFrame, commits: DataFrame) -> DataFrame:
    """The commits (repo, oid, ...) that resolved requests (repo, asked, oid) name, tags peeled; none where there is none."""
    at = resolved.join(peeled.select("oid", "peeled"), "oid", "left").select("repo", "asked", F.coalesce("peeled", "oid").alias("oid"))
    return at.join(commits, ["repo", "oid"])
