"""References and the catalog of repositories: listing, resolution, compare-and-set updates, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.history import ZERO_OID, in_namespace, is_ref_name, short_ref
from .graph import checkpointed


def latest(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The row of each key that comes first in `order`: the upsert and first-location rule, one window."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place_", place).where("place_ = 1").drop("place_")


def list_refs(refs: DataFrame, peeled: DataFrame) -> DataFrame:
    """repo, name, target, peeled (only where the target is a tag), short, is_branch."""
    tagged = peeled.where("oid <> peeled").select(F.col("oid").alias("target"), "peeled")
    return refs.join(tagged, "target", "left").select("repo", "name", "target", "peeled", short_ref(F.col("name")).alias("short"), F.col("name").startswith("refs/heads/").alias("is_branch"))


def decorations(refs: DataFrame, peeled: DataFrame) -> DataFrame:
    """repo, oid, labels: the sorted short names of the references at each commit, tags peeled."""
    at = refs.join(peeled.select(F.col("oid").alias("target"), "peeled"), "target", "left").select("repo", F.coalesce("peeled", "target").alias("oid"), short_ref(F.col("name")).alias("label"))
    return at.groupBy("repo", "oid").agg(F.array_sort(F.collect_list("label")).alias("labels"))


def resolve(requests: DataFrame, refs: DataFrame, heads: DataFrame, reachable: DataFrame) -> DataFrame:
    """repo, asked, oid: a branch, else a tag, else a full name, else a reachable object id; no name means HEAD."""
    head = heads.select("repo", F.col("ref_name").alias("head"))
    wanted = requests.join(head, "repo", "left").select("repo", "asked", F.coalesce("asked", "head").alias("name"))
    candidates = wanted.select(
        "repo", "asked", F.posexplode(F.array(F.concat(F.lit("refs/heads/"), "name"), F.concat(F.lit("refs/tags/"), "name"), F.col("name"))).alias("rank", "candidate")
    )
    named = candidates.join(refs.select("repo", F.col("name").alias("candidate"), "target"), ["repo", "candidate"]).select("repo", "asked", "rank", F.col("target").alias("oid"))
    direct = wanted.join(reachable.select("repo", F.col("oid").alias("name")), ["repo", "name"]).select("repo", "asked", F.lit(3).alias("rank"), F.col("name").alias("oid"))
    found = latest(named.unionByName(direct), ["repo", "asked"], "rank").select("repo", "asked", "oid")
    return requests.alias("q").join(found.alias("f"), (F.col("q.repo") == F.col("f.repo")) & F.col("q.asked").eqNullSafe(F.col("f.asked")), "left").select("q.repo", "q.asked", "f.oid")


def latest_commit_time(refs: DataFrame, peeled: DataFrame, commits: DataFrame) -> DataFrame:
    """repo, latest_ms: the newest committer time among the tips, in milliseconds."""
    tips = refs.join(peeled.select(F.col("oid").alias("target"), "peeled"), "target", "left").select("repo", F.coalesce("peeled", "target").alias("oid"))
    return tips.join(commits.select("oid", "time"), "oid").groupBy("repo").agg((F.max("time") * 1000).alias("latest_ms"))


def fingerprint(refs: DataFrame, heads: DataFrame) -> DataFrame:
    """repo, version: SHA-1 over the sorted references and HEAD; it changes when any of them does."""
    lines = refs.groupBy("repo").agg(F.sort_array(F.collect_list(F.concat("name", F.lit("\0"), "target"))).alias("lines"))
    return lines.join(heads, "repo", "left").select("repo", F.sha1(F.array_join(F.concat("lines", F.array(F.concat(F.lit("HEAD\0"), F.coalesce("ref_name", F.lit(""))))), "\n")).alias("version"))


def _accepted(valid: DataFrame, refs: DataFrame) -> DataFrame:
    """repo, ref, batch, seq of the commands that apply, of `valid` (repo, ref, batch, seq, old, new).

    A command applies if it is the first one of a later batch that names as old what another set, so that the ones that
    apply are a chain of such pointers from the stored target on; the chain is found by pointer doubling, in a number of
    rounds that is the logarithm of the longest one.
    """
    at = F.struct("batch", "seq")
    start = refs.select("repo", F.col("name").alias("ref"), F.col("target").alias("value"))
    fresh = valid.select("repo", "ref").distinct().join(start, ["repo", "ref"], "left").withColumn("value", F.coalesce("value", F.lit(ZERO_OID)))
    none = F.lit(None).cast("struct<batch:long,seq:long>")
    # Rows that set a value, and rows that expect it: the next one is the first that expects it in a later batch.
    rows = (
        fresh.select("repo", "ref", "value", F.lit(-1).cast("long").alias("batch"), F.struct(F.lit(-1).cast("long").alias("batch"), F.lit(-1).cast("long").alias("seq")).alias("sets"), none.alias("wants"))
        .unionByName(valid.select("repo", "ref", F.col("new").alias("value"), "batch", at.alias("sets"), none.alias("wants")))
        .unionByName(valid.select("repo", "ref", F.col("old").alias("value"), "batch", none.alias("sets"), at.alias("wants")))
    )
    later = Window.partitionBy("repo", "ref", "value").orderBy("batch").rangeBetween(1, Window.unboundedFollowing)
    jump = checkpointed(rows.withColumn("next", F.min("wants").over(later)).where("sets IS NOT NULL AND next IS NOT NULL").select("repo", "ref", "sets", "next"))
    reached = jump.where(F.col("sets.batch") == -1).select("repo", "ref", F.col("next").alias("sets"))
    while not jump.isEmpty():
        reached = checkpointed(reached.unionAll(reached.join(jump, ["repo", "ref", "sets"]).select("repo", "ref", "next")))
        onward = jump.select("repo", "ref", F.col("sets").alias("next"), F.col("next").alias("far"))
        jump = checkpointed(jump.join(onward, ["repo", "ref", "next"]).select("repo", "ref", "sets", F.col("far").alias("next")))
    return reached.select("repo", "ref", "sets.batch", "sets.seq")


def decide(commands: DataFrame, refs: DataFrame, stored: DataFrame, ancestry: DataFrame | None = None, unpacked: Column | None = None) -> DataFrame:
    """`commands` (repo, batch, seq, ref, old, new) with `ok`, `message`, `forced`; the rules in their fixed order.

    Batches are pushes, one after the other in their order: each command is compared with the references as the batches before left them,
    and of several of one batch for one reference the first that fits applies. `stored` is (oid); `ancestry` (anc, desc,
    is_ancestor) tells fast-forwards, without it no update counts as forced. A deletion is none.
    """
    number = F.dense_rank().over(Window.partitionBy("repo").orderBy("batch")).cast("long")
    rows = commands.withColumn("number_", number).withColumn("seq_", F.col("seq").cast("long"))
    rows = rows.join(stored.select(F.col("oid").alias("new")).distinct().withColumn("stored", F.lit(True)), "new", "left")
    if ancestry is not None:
        rows = rows.join(ancestry.select(F.col("anc").alias("old"), F.col("desc").alias("new"), "is_ancestor"), ["old", "new"], "left")
    else:
        rows = rows.withColumn("is_ancestor", F.lit(True))
    whole = F.lit(True) if unpacked is None else unpacked
    named, known = is_ref_name(F.col("ref")), (F.col("new") == ZERO_OID) | F.col("stored").isNotNull()
    rows = checkpointed(rows.withColumn("whole", whole).withColumn("named", named).withColumn("known", known))
    valid = rows.where("whole AND named AND known").select("repo", "ref", F.col("number_").alias("batch"), F.col("seq_").alias("seq"), "old", "new")
    accepted = _accepted(valid, refs).select("repo", "ref", F.col("batch").alias("number_"), F.col("seq").alias("seq_"), F.lit(True).alias("accepted"))
    rows = rows.join(accepted, ["repo", "ref", "number_", "seq_"], "left")
    before = Window.partitionBy("repo", "ref").orderBy("number_").rangeBetween(Window.unboundedPreceding, -1)
    moved = F.max(F.when(F.col("accepted"), F.struct("number_", "new"))).over(before)["new"]
    target = refs.select("repo", F.col("name").alias("ref"), "target")
    rows = rows.withColumn("moved", moved).join(target, ["repo", "ref"], "left").withColumn("current", F.coalesce("moved", "target", F.lit(ZERO_OID)))
    message = (
        F.when(~F.col("whole"), "unpacker error")
        .when(~F.col("named"), "funny refname")
        .when(F.col("current") != F.col("old"), "fetch first")
        .when(~F.col("known"), "missing necessary objects")
        .when(F.col("accepted").isNull(), "fetch first")
    )
    forced = (F.col("old") != ZERO_OID) & (F.col("new") != ZERO_OID) & ~F.coalesce("is_ancestor", F.lit(False))
    judged = rows.withColumn("message", message)
    return judged.select(*commands.columns, F.col("message").isNull().alias("ok"), "message", (F.col("message").isNull() & forced).alias("forced"))


def apply_updates(refs: DataFrame, decided: DataFrame) -> DataFrame:
    """The references after the accepted commands; the last accepted one of a batch and reference counts."""
    accepted = latest(decided.where("ok"), ["repo", "ref"], F.desc("batch"), F.desc("seq")).select("repo", F.col("ref").alias("name"), F.col("new"))
    both = refs.join(accepted, ["repo", "name"], "full_outer")
    return both.select("repo", "name", F.coalesce("new", "target").alias("target")).where(F.col("target") != ZERO_OID)


def repair_head(heads: DataFrame, refs: DataFrame) -> DataFrame:
    """repo, ref_name: HEAD where its branch exists, else main, else master, else the first branch."""
    branches = refs.where(F.col("name").startswith("refs/heads/"))
    wish = F.when(F.col("name") == "refs/heads/main", 0).when(F.col("name") == "refs/heads/master", 1).otherwise(2)
    best = latest(branches, ["repo"], wish, "name").select("repo", F.col("name").alias("best"))
    alive = branches.select("repo", F.col("name").alias("ref_name"), F.lit(True).alias("alive"))
    return heads.join(alive, ["repo", "ref_name"], "left").join(best, "repo", "left").select("repo", F.when(F.col("alive"), F.col("ref_name")).otherwise(F.coalesce("best", "ref_name")).alias("ref_name"))


def upsert_catalog(repos: DataFrame, pushes: DataFrame) -> DataFrame:
    """name, idle, ver after pushes (name, idle, seq): the newest push sets idle, each raises the version."""
    newest = pushes.groupBy("name").agg(F.max_by("idle", "seq").alias("idle_"), F.count(F.lit(1)).alias("n_"))
    return repos.join(newest, "name", "full_outer").select("name", F.coalesce("idle_", "idle").alias("idle"), (F.coalesce("ver", F.lit(0)) + F.coalesce("n_", F.lit(0))).alias("ver"))


def list_public(repos: DataFrame, limit: int = 1000, namespace: str | None = None) -> DataFrame:
    """The newest public repositories, of one namespace or all."""
    shown = repos.where(~F.col("private"))
    if namespace is not None:
        shown = shown.where(in_namespace(F.col("name"), namespace))
    return shown.orderBy(F.desc("idle"), "name").limit(limit)


def patch_config(repos: DataFrame, patches: DataFrame) -> DataFrame:
    """name, description, owner, section, private: fields that a patch holds are replaced, cut to their lengths."""
    fields = {"description": 200, "owner": 100, "section": 100}
    p = patches.select("name", *(F.substring(f, 1, n).alias(f"new_{f}") for f, n in fields.items()), F.col("private").alias("new_private"))
    return repos.join(p, "name", "left").select("name", *(F.coalesce(f"new_{f}", f).alias(f) for f in (*fields, "private")))


#: Files that describe a repository, the first that there is.
ABOUT = ("about.md", "about.markdown", "about", "readme.md", "readme.markdown", "readme", "readme.txt", "readme.rst")


def readme(entries: DataFrame, names: tuple[str, ...] = ABOUT) -> DataFrame:
    """repo, name, oid: the entry of the first listed name at the root, case aside, that isn't a tree."""
    rank = F.array_position(F.array(*(F.lit(n) for n in names)), F.lower("name"))
    ranked = entries.where("mode NOT IN ('40000', '040000')").withColumn("rank", rank).where("rank > 0")
    return latest(ranked, ["repo"], "rank", "name").select("repo", "name", "oid")


def advertised(refs: DataFrame, peeled: DataFrame) -> DataFrame:
    """repo, oid: what a client may ask for by id: the tips, and what their tags point at."""
    targets = refs.select("repo", F.col("target").alias("oid"))
    behind = targets.join(peeled, "oid").select("repo", F.col("peeled").alias("oid"))
    return targets.unionAll(behind).distinct()


def illegal_wants(wants: DataFrame, offered: DataFrame) -> DataFrame:
    return wants.join(offered.select("repo", "oid"), ["repo", "oid"], "left_anti")


def wants_all_tips(wants: DataFrame, refs: DataFrame) -> DataFrame:
    """repo, all_tips: whether the wanted ids are exactly the tips, as for a full clone."""
    w = wants.select("repo", "oid").distinct().withColumn("wanted", F.lit(1))
    t = refs.select("repo", F.col("target").alias("oid")).distinct().withColumn("tip", F.lit(1))
    return w.join(t, ["repo", "oid"], "full_outer").groupBy("repo").agg((F.count(F.lit(1)) == F.sum(F.coalesce(F.col("wanted") * F.col("tip"), F.lit(0)))).alias("all_tips"))


def push_events(decided: DataFrame) -> DataFrame:
    """repo, batch, updates: the accepted updates of each push, in order; pushes without any make no event."""
    update = F.struct("seq", "ref", "old", "new")
    return decided.where("ok").groupBy("repo", "batch").agg(F.sort_array(F.collect_list(update)).alias("updates"))


def newest_branches(refs: DataFrame, commits: DataFrame, n: int = 10) -> DataFrame:
    """repo, name, oid, time, rank: the branches whose tips are newest."""
    tips = refs.where(F.col("name").startswith("refs/heads/")).join(commits.select("repo", F.col("oid").alias("target"), "time"), ["repo", "target"])
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("time"), "name"))
    return tips.withColumn("rank", rank).where(F.col("rank") <= n).select("repo", short_ref(F.col("name")).alias("name"), F.col("target").alias("oid"), "time", "rank")
