"""History logs: date order, filters, pages, and the histories of single paths."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.history import mentions


def best_first(commits: DataFrame, tips: DataFrame) -> DataFrame:
    """repo, oid, position: the order in which a walk from the tip meets commits, the newest known one first.

    `commits` is (repo, oid, parents, time), `tips` (repo, oid), ids as strings. Where a parent is newer than its child
    this isn't the order of the times, so each repository is walked; only ids and times are grouped for it, and of equal
    times the one met first comes first.
    """

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        known = {r.oid: (r.time, r.parents) for r in rows.itertuples()}
        tip = rows.tip.iloc[0]
        heap, met, order = [], {tip}, []
        if tip in known:
            heap.append((-known[tip][0], 0, tip))
        while heap:
            oid = heapq.heappop(heap)[2]
            order.append(oid)
            for parent in known[oid][1]:
                if parent not in met:
                    met.add(parent)
                    if parent in known:
                        heapq.heappush(heap, (-known[parent][0], len(met), parent))
        return pd.DataFrame({"repo": key[0], "oid": order, "position": range(len(order))})

    joined = commits.select("repo", "oid", "parents", "time").join(tips.select("repo", F.col("oid").alias("tip")), "repo")
    return joined.groupBy("repo").applyInPandas(walk, f"repo {commits.schema['repo'].dataType.simpleString()}, oid string, position long")


def chain_order(commits: DataFrame) -> DataFrame:
    """`commits` of single-parent histories (repo, oid, parent, time) with `position`, the newest at 0; a window only."""
    return commits.withColumn("position", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("time"), F.desc("oid"))) - 1)


def matches(query: str | None, kind: str = "grep") -> Column:
    """The log filter: in the message, or in the name and address of the author or the committer."""
    if not query:
        return F.lit(True)
    if kind in ("author", "committer"):
        return mentions(F.concat_ws(" ", F.coalesce(f"{kind}.name", F.lit("")), F.coalesce(f"{kind}.email", F.lit(""))), query)
    return mentions(F.col("message"), query)


def touches(path_oids: DataFrame, commits: DataFrame) -> DataFrame:
    """The commits whose path has another blob than at the first parent (`path_oids`: oid, path_oid; absent is null)."""
    mine = path_oids.select("oid", F.col("path_oid").alias("mine"))
    theirs = path_oids.select(F.col("oid").alias("parent"), F.col("path_oid").alias("theirs"))
    return commits.join(mine, "oid", "left").join(theirs, "parent", "left").where(~F.col("mine").eqNullSafe(F.col("theirs"))).select(*commits.columns, "mine")


def page(log: DataFrame, offset: int = 0, n: int = 50, order: tuple[str, ...] = ("position",)) -> DataFrame:
    """One page per repository, with `more` where the next page isn't empty; n is held between 1 and 100."""
    n, offset = max(1, min(n, 100)), max(0, offset)
    place = F.row_number().over(Window.partitionBy("repo").orderBy(*order))
    kept = log.withColumn("place_", place).where(F.col("place_").between(offset + 1, offset + n + 1))
    more = F.max("place_").over(Window.partitionBy("repo")) > offset + n
    return kept.withColumn("more", more).where(F.col("place_") <= offset + n).drop("place_")


def path_history(revisions: DataFrame) -> DataFrame:
    """The revisions of a path along first parents that changed it, newest first, down to where it was created.

    `revisions` is (repo, ordinal, path_oid), null where the path is absent.
    """
    newest = Window.partitionBy("repo").orderBy("ordinal")
    older = F.lead("path_oid").over(newest)
    # Whether a newer revision was the one that created the path.
    changed = revisions.withColumn("older", older).withColumn("changed", ~F.col("path_oid").eqNullSafe(F.col("older")))
    created = F.sum(F.when(F.col("changed") & F.col("older").isNull(), 1).otherwise(0)).over(newest.rowsBetween(Window.unboundedPreceding, -1))
    return changed.withColumn("created", F.coalesce(created, F.lit(0))).where("changed AND created = 0").drop("older", "changed", "created")
