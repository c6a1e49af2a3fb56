"""Commit activity: authors by period."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.history import period_key


def _keyed(commits: DataFrame, period: str) -> DataFrame:
    author = F.when(F.coalesce("author", F.lit("")) == "", "(unknown)").otherwise(F.col("author"))
    return commits.select(author.alias("author"), period_key(F.col("time"), period).alias("period"), "time", "oid")


def author_by_period(commits: DataFrame, period: str = "m") -> DataFrame:
    """author, period, commits: one row for each pair that occurs."""
    return _keyed(commits, period).groupBy("author", "period").agg(F.count(F.lit(1)).alias("commits"))


def with_totals(commits: DataFrame, period: str = "m") -> DataFrame:
    """author, period, commits, level: also the totals of each period and of all (author or both null), in one pass."""
    keyed = _keyed(commits, period)
    sets = keyed.groupingSets([[F.col("author"), F.col("period")], [F.col("period")], []], F.col("author"), F.col("period"))
    return sets.agg(F.count(F.lit(1)).alias("commits"), F.grouping_id().alias("level")).select("author", "period", "commits", F.col("level").cast("int").alias("level"))


def newest_periods(commits: DataFrame, period: str, n: int = 8) -> list[str]:
    """The last `n` periods that hold commits, newest first: a top-k of the pivot's columns."""
    keys = _keyed(commits, period).groupBy("period").agg(F.max("time").alias("time"))
    return [r.period for r in keys.orderBy(F.desc("time")).limit(n).select("period").collect()]


def pivoted(commits: DataFrame, period: str = "m", n_periods: int = 8, n_authors: int = 20) -> DataFrame:
    """author, a column for each of the newest periods (null where none), total over all periods; the top authors."""
    columns = newest_periods(commits, period, n_periods)
    counts = author_by_period(commits, period)
    totals = counts.groupBy("author").agg(
        *(F.sum(F.when(F.col("period") == c, F.col("commits"))).alias(c) for c in columns), F.sum("commits").alias("total")
    )
    return totals.orderBy(F.desc("total"), "author").limit(n_authors)


def top_authors(commits: DataFrame, n: int = 20) -> DataFrame:
    """repo, author, commits, rank: the most active authors of each repository."""
    counts = commits.groupBy("repo", "author").agg(F.count(F.lit(1)).alias("commits"))
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("commits"), "author"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)
