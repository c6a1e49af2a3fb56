"""Snapshots: which files of a tree go into which part of a bounded archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.history import is_safe_path, is_safe_target, mode_kind


def parts(files: DataFrame, budget: int = 16 << 20) -> DataFrame:
    """repo, part, n_files, bytes, first_path, last_path of `files` (repo, path, mode, data): unsafe entries are left out.

    Files are dealt to parts of about `budget` bytes in path order; no bytes leave the scan.
    """
    link = mode_kind(F.col("mode")) == "symlink"
    safe = files.where(is_safe_path(F.col("path")) & (~link | is_safe_target(F.col("data").cast("string"))))
    sized = safe.select("repo", "path", F.octet_length(F.col("data").cast("binary")).cast("long").alias("size"))
    before = F.sum("size").over(Window.partitionBy("repo").orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    dealt = sized.withColumn("part", F.floor(F.coalesce(before, F.lit(0)) / budget))
    return dealt.groupBy("repo", "part").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))
