"""Graph operators over `edges` (src, dst): closures, depths, ancestors, connectivity, garbage.

Only ids travel: no operator here carries object data. Loops extend a frontier by one join a round and cut the lineage
with a reliable checkpoint in the shared folder, so that a lost executor costs a round at most.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, one on this machine, which only a local session can use."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="annalist-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def closure(edges: DataFrame, roots: DataFrame, excluded: DataFrame | None = None, max_depth: int | None = None, key: str = "id", within: tuple[str, ...] = ()) -> DataFrame:
    """key, depth (rounds from a root, the least) of all that the roots reach, without what is excluded.

    The walk doesn't pass through excluded ids, so closure(wants, closure(haves)) is the difference of the closures of
    a history whose excluded set is closed. `within` names columns that all tables have, such as the repository: walks
    stay inside one value of these. A round is a level; commit histories, which are long, take `history` instead.
    """
    at = [*within, key]
    steps = edges.select(*within, F.col("src").alias(key), F.col("dst"))
    start = roots.select(*at).distinct()
    if excluded is not None:
        start = start.join(excluded.select(*at).distinct(), at, "left_anti")
    frontier = checkpointed(start.withColumn("depth", F.lit(0)))
    seen, depth = frontier, 0
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        reached = frontier.join(steps, at).select(*within, F.col("dst").alias(key)).distinct().join(seen, at, "left_anti")
        if excluded is not None:
            reached = reached.join(excluded.select(*at).distinct(), at, "left_anti")
        frontier = checkpointed(reached.withColumn("depth", F.lit(depth)))
        seen = seen.unionAll(frontier)
        if depth % 8 == 0:  # else each round reads as many tables as there were rounds
            seen = checkpointed(seen)
    return seen


def jumps(parents: DataFrame, within: tuple[str, ...] = ()) -> list[DataFrame]:
    """within, oid, far: of each commit its first-parent ancestor 1, 2, 4, ... steps away, until no chain is so long."""
    first = parents.where("nth = 0 AND parent IS NOT NULL").select(*within, "oid", F.col("parent").alias("far"))
    found = [checkpointed(first)]
    while not found[-1].isEmpty():
        onward = found[-1].select(*within, F.col("oid").alias("far"), F.col("far").alias("next"))
        found.append(checkpointed(found[-1].join(onward, [*within, "far"]).select(*within, "oid", F.col("next").alias("far"))))
    return found[:-1]


def history(parents: DataFrame, tips: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """within, oid of the commits that `tips` reach, themselves included; `parents` is (within, oid, nth, parent).

    First parents are followed by pointer doubling, all commits of a chain of n in log2(n) joins; what else merges bring in
    are the tips of the next round, so that rounds grow with how deep merges are nested, not with the history's length.
    """
    at = [*within, "oid"]
    far = jumps(parents, within)
    sides = parents.where("nth > 0").select(*at, "parent")
    frontier = checkpointed(tips.select(*at).distinct())
    seen = None
    while not frontier.isEmpty():
        reached = frontier
        for jump in far:
            reached = reached.unionAll(reached.join(jump, at).select(*within, F.col("far").alias("oid"))).distinct()
        fresh = checkpointed(reached if seen is None else reached.join(seen, at, "left_anti"))
        seen = fresh if seen is None else checkpointed(seen.unionAll(fresh))
        frontier = checkpointed(fresh.join(sides, at).select(*within, F.col("parent").alias("oid")).distinct().join(seen, at, "left_anti"))
    return tips.select(*at).where(F.lit(False)) if seen is None else seen


def boundary(reached: DataFrame, depth: int) -> DataFrame:
    """The shallow points of a depth-limited closure: those at the limit, roots of the history included."""
    return reached.where(F.col("depth") == depth)


def unreachable(objects: DataFrame, reachable: DataFrame, bases: DataFrame | None = None, key: str = "id") -> DataFrame:
    """What a garbage collection removes: objects outside the closure that are no delta base either."""
    kept = reachable.select(key) if bases is None else reachable.select(key).unionAll(bases.select(key))
    return objects.join(kept.distinct(), key, "left_anti")


def missing(edges: DataFrame, *stores: DataFrame, key: str = "id") -> DataFrame:
    """Children that no store holds; a pack is connected if none are missing."""
    wanted = edges.where(F.col("dst").isNotNull()).select(F.col("dst").alias(key)).distinct()
    for store in stores:
        wanted = wanted.join(store.select(key), key, "left_anti")
    return wanted


def ancestor_pairs(parents: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """oid, ancestor, distance over single-parent histories `parents` (oid, parent), by pointer doubling.

    Round r knows all ancestors up to distance 2^r - 1, so a chain of n commits takes log2(n) rounds. `of` (oid) limits
    the descendants whose ancestors are wanted.
    """
    jump = checkpointed(parents.where(F.col("parent").isNotNull()).select("oid", F.col("parent").alias("far")))
    known = parents.select("oid", F.col("oid").alias("ancestor"), F.lit(0).alias("distance"))
    if of is not None:
        known = known.join(of.select("oid").distinct(), "oid", "left_semi")
    known, reach = checkpointed(known), 1
    while not jump.isEmpty():
        next_ = known.join(jump.select(F.col("oid").alias("ancestor"), "far"), "ancestor").select("oid", F.col("far").alias("ancestor"), (F.col("distance") + reach).alias("distance"))
        known = checkpointed(known.unionAll(next_))
        jump = checkpointed(jump.alias("a").join(jump.alias("b"), F.col("a.far") == F.col("b.oid")).select("a.oid", F.col("b.far").alias("far")))
        reach *= 2
    return known


def is_ancestor(parents: DataFrame, pairs: DataFrame) -> DataFrame:
    """anc, desc, is_ancestor for each of `pairs`; an id is its own ancestor. A pair without it is a forced update.

    `parents` is (oid, parent) of single-parent histories, or (oid, nth, parent). Only the asked pairs travel: each is
    lifted along first parents to the depth of `anc`, by binary lifting. Pairs that miss it go on from the side parents of
    the merges that they passed, one merge a round.

    Where `parents` has `order` too, a number that rises from each parent to its child (a generation, or the place in a
    log), nothing is walked or built beyond what lies between the two commits of a pair; each commit then has a row, whose
    nth is 0 and whose parent is null at a root.
    """
    if "nth" not in parents.columns:
        parents = parents.withColumn("nth", F.lit(0))
    if "order" in parents.columns:
        return _is_ancestor_by_order(parents, pairs)
    far = jumps(parents)
    depth = checkpointed(_depths(parents, far))
    sides = parents.where("nth > 0").select("oid", "parent")
    merges = checkpointed(_next_merges(parents, far))
    target = pairs.select("anc", "desc").distinct().join(depth.select(F.col("oid").alias("anc"), F.col("depth").alias("goal")), "anc", "left")
    frontier = checkpointed(target.select("anc", "desc", "goal", F.col("desc").alias("at")))
    hits = frontier.where("anc = desc").select("anc", "desc")
    frontier = frontier.where("anc <> desc AND goal IS NOT NULL")
    tried = None
    while not frontier.isEmpty():
        # A commit as deep as the goal or deeper is lifted by the binary digits of the difference.
        lifted = frontier.join(depth.withColumnRenamed("oid", "at"), "at").select("anc", "desc", F.col("at").alias("here"), (F.col("depth") - F.col("goal")).alias("steps")).where("steps >= 0")
        for k, jump in enumerate(far):
            moved = lifted.join(jump.select(F.col("oid").alias("here"), "far"), "here", "left")
            lifted = moved.select("anc", "desc", F.when(F.col("steps").bitwiseAND(F.lit(1 << k)) != 0, F.col("far")).otherwise(F.col("here")).alias("here"), "steps")
        found = checkpointed(lifted.where("here = anc").select("anc", "desc").distinct())
        hits = checkpointed(hits.unionAll(found).distinct())
        # Below the next merge on the way: its side parents, and its first parent's own way on.
        passed = frontier.join(hits, ["anc", "desc"], "left_anti").join(merges.withColumnRenamed("oid", "at"), "at").select("anc", "desc", "goal", "merge")
        onward = passed.join(parents.select(F.col("oid").alias("merge"), "parent"), "merge").where("parent IS NOT NULL").select("anc", "desc", "goal", F.col("parent").alias("at")).distinct()
        tried = checkpointed(frontier.select("anc", "desc", "at") if tried is None else tried.unionAll(frontier.select("anc", "desc", "at")))
        frontier = checkpointed(onward.join(tried, ["anc", "desc", "at"], "left_anti"))
    known = hits.distinct().withColumn("hit", F.lit(True))
    return pairs.join(known, ["anc", "desc"], "left").select("anc", "desc", F.coalesce("hit", F.lit(False)).alias("is_ancestor"))


def _is_ancestor_by_order(parents: DataFrame, pairs: DataFrame) -> DataFrame:
    """is_ancestor() by spans, the differences of order: `left` is the span from where a pair is to its `anc`."""
    orders = parents.where("nth = 0").select("oid", "order")
    place = lambda c, name: orders.select(F.col("oid").alias(c), F.col("order").alias(name))
    # The pairs get attributes of their own, else the last join renews those of the checkpoints and loses their constraints.
    own = pairs.select(F.col("anc").alias("a"), F.col("desc").alias("d")).where("a <> d").distinct().select(F.col("a").alias("anc"), F.col("d").alias("desc"))
    asked = own.join(place("anc", "goal"), "anc").join(place("desc", "at_order"), "desc")
    frontier = checkpointed(asked.select("anc", "desc", F.col("desc").alias("at"), (F.col("at_order") - F.col("goal")).cast("long").alias("left"), F.lit(True).alias("fresh")).where("left > 0"))
    hits = frontier.select("anc", "desc").limit(0)
    bound = frontier.agg(F.max("left")).first()[0] or 0
    edges = parents.where("parent IS NOT NULL").join(place("parent", "parent_order"), "parent")
    edges = checkpointed(edges.select("oid", "nth", "parent", (F.col("order") - F.col("parent_order")).cast("long").alias("span")).where(F.col("span") <= bound))
    far = [edges.where("nth = 0").select("oid", F.col("parent").alias("far"), "span")]
    while 2 << len(far) - 1 <= bound:  # a first parent is a span of 1 away at least
        onward = far[-1].select(F.col("oid").alias("far"), F.col("far").alias("next"), F.col("span").alias("more"))
        doubled = far[-1].join(onward, "far").select("oid", F.col("next").alias("far"), (F.col("span") + F.col("more")).alias("span")).where(F.col("span") <= bound)
        far.append(checkpointed(doubled))
        if far[-1].isEmpty():
            far.pop()
            break
    # The nearest merge on the first-parent way of each commit, as _next_merges has it.
    merges = checkpointed(edges.where("nth > 0").select("oid", F.col("oid").alias("merge"), F.lit(0).cast("long").alias("span")).distinct())
    if not merges.isEmpty():
        for jump in far:
            ahead = jump.join(merges.select(F.col("oid").alias("far"), "merge", F.col("span").alias("more")), "far").select("oid", "merge", (F.col("span") + F.col("more")).alias("span"))
            nearest = merges.unionAll(ahead.where(F.col("span") <= bound)).groupBy("oid").agg(F.min(F.struct("span", "merge")).alias("m"))
            merges = checkpointed(nearest.select("oid", "m.merge", "m.span"))
    tried = frontier
    while not frontier.isEmpty():
        lifted = frontier.where("fresh").select("anc", "desc", F.col("at").alias("here"), "left")
        for jump in reversed(far):
            moved = lifted.alias("l").join(jump.alias("j"), (F.col("l.here") == F.col("j.oid")) & (F.col("j.span") <= F.col("l.left")), "left")
            lifted = moved.select("anc", "desc", F.coalesce("far", "here").alias("here"), (F.col("left") - F.coalesce("span", F.lit(0))).alias("left"))
        found = checkpointed(lifted.where("here = anc").select("anc", "desc").distinct())
        hits = hits.unionAll(found)
        # Below the next merge on the way: its side parents, and its first parent's own way on, which was lifted already.
        passed = frontier.join(found, ["anc", "desc"], "left_anti").join(merges.withColumnRenamed("oid", "at"), "at").where(F.col("span") < F.col("left")).select("anc", "desc", "merge", (F.col("left") - F.col("span")).alias("left"))
        onward = passed.join(edges.withColumnRenamed("oid", "merge"), "merge").where(F.col("span") <= F.col("left")).select("anc", "desc", F.col("parent").alias("at"), (F.col("left") - F.col("span")).alias("left"), (F.col("nth") > 0).alias("fresh")).where("fresh OR left > 0")
        fresh = onward.groupBy("anc", "desc", "at", "left").agg(F.min("fresh").alias("fresh"))
        frontier = checkpointed(fresh.join(tried.select("anc", "desc", "at"), ["anc", "desc", "at"], "left_anti"))
        tried = tried.unionAll(frontier)
    known = hits.withColumn("hit", F.lit(True))  # once each: a pair that is found goes on no more
    return pairs.join(known, ["anc", "desc"], "left").select("anc", "desc", F.coalesce("hit", F.col("anc") == F.col("desc"), F.lit(False)).alias("is_ancestor"))


def _depths(parents: DataFrame, far: list[DataFrame]) -> DataFrame:
    """oid, depth: how many first parents a commit has above it, the sum of the jumps that lead to its root."""
    at = parents.select("oid", F.col("oid").alias("here"), F.lit(0).cast("long").alias("depth")).distinct()
    for k, jump in reversed(list(enumerate(far))):
        moved = at.join(jump.select(F.col("oid").alias("here"), "far"), "here", "left")
        at = moved.select("oid", F.coalesce("far", "here").alias("here"), (F.col("depth") + F.when(F.col("far").isNotNull(), 1 << k).otherwise(0)).alias("depth"))
    return at.select("oid", "depth")


def _next_merges(parents: DataFrame, far: list[DataFrame]) -> DataFrame:
    """oid, merge: the nearest merge on the first-parent way from each commit, itself included; none where there is none."""
    merge = parents.where("nth > 0").select(F.col("oid").alias("merge")).distinct()
    ids = parents.select("oid").distinct()
    known = checkpointed(ids.join(merge, ids["oid"] == merge["merge"], "left").select("oid", "merge"))
    for jump in far:  # after k rounds, the nearest within 2^k - 1 steps
        ahead = jump.join(known.select(F.col("oid").alias("far"), F.col("merge").alias("other")), "far").select("oid", "other")
        known = checkpointed(known.join(ahead, "oid", "left").select("oid", F.coalesce("merge", "other").alias("merge")))
    return known.where("merge IS NOT NULL")


def peel(tags: DataFrame, targets: DataFrame) -> DataFrame:
    """oid, peeled: follow tags (oid, target) from each of `targets` (oid) to what isn't a tag, however many there are on
    the way: pointers double until no tag points at a tag."""
    hops = checkpointed(tags.where("oid <> target").select("oid", "target"))
    while True:
        onward = hops.select(F.col("oid").alias("target"), F.col("target").alias("far"))
        longer = checkpointed(hops.join(onward, "target", "left").select("oid", F.coalesce("far", "target").alias("target"), F.col("far").isNotNull().alias("moved")))
        hops = longer.select("oid", "target")
        if longer.where("moved").isEmpty():
            break
    return targets.select("oid").join(hops, "oid", "left").select("oid", F.coalesce("target", "oid").alias("peeled"))


def flatten_tree(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """root, path, mode, oid of all files below the root trees; links to other repositories are left out.

    `entries` is (tree_oid, name, mode, oid); a round descends one directory level in all trees at once.
    """
    level = roots.select(F.col("tree_oid").alias("root"), "tree_oid", F.lit("").alias("prefix"))
    files = None
    while files is None or not level.isEmpty():
        inside = checkpointed(
            level.join(entries.where("mode <> '160000'"), "tree_oid").select("root", F.concat("prefix", "name").alias("path"), "mode", "oid")
        )
        leaf = inside.where(~F.col("mode").isin("40000", "040000"))
        files = leaf if files is None else files.unionAll(leaf)
        level = inside.where(F.col("mode").isin("40000", "040000")).select("root", F.col("oid").alias("tree_oid"), F.concat("path", F.lit("/")).alias("prefix"))
    return files
