"""The object store as tables: pages, presence, locations, emission, storage gauges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .refs import latest


def keyset_page(rows: DataFrame, keys: list[str], after: list | None = None, limit: int = 1000) -> DataFrame:
    """The next `limit` rows in the order of `keys` behind the values `after`; the comparison is one of structs."""
    if after is not None:
        rows = rows.where(F.struct(*keys) > F.struct(*(F.lit(v).cast(rows.schema[k].dataType) for k, v in zip(keys, after))))
    return rows.orderBy(*keys).limit(limit)


def first_locations(entries: DataFrame, key: str = "oid") -> DataFrame:
    """One location of each object: the first that was stored (by pack, then offset)."""
    return latest(entries, [key], "pack_id", "offset", "line")


def stored(loose: DataFrame, packed: DataFrame, key: str = "oid") -> DataFrame:
    """key, type, size, data of all objects; a loose copy comes before a packed one."""
    both = loose.withColumn("rank_", F.lit(0)).unionByName(packed.withColumn("rank_", F.lit(1)))
    return latest(both, [key], "rank_").drop("rank_")


def orphan_packs(catalog: DataFrame, *tables: DataFrame) -> DataFrame:
    """Pack ids that some table mentions but the catalog, which is written last, doesn't."""
    ids = tables[0].select("pack_id")
    for t in tables[1:]:
        ids = ids.unionAll(t.select("pack_id"))
    return ids.distinct().join(catalog.select("pack_id"), "pack_id", "left_anti")


def storage_counts(loose: DataFrame, packed: DataFrame, packs: DataFrame) -> DataFrame:
    """n_objects (an object in both stores counts twice), pack_bytes, next_pack: one row."""
    none = F.lit(None).cast("long")
    one = lambda df: df.select(F.lit(1).alias("x"), none.alias("pack_id"), none.alias("size"))
    rows = one(loose).unionAll(one(packed)).unionAll(packs.select(F.lit(None).cast("int"), F.col("pack_id").cast("long"), F.col("size").cast("long")))
    return rows.agg(F.count("x").alias("n_objects"), F.coalesce(F.sum("size"), F.lit(0)).alias("pack_bytes"), (F.coalesce(F.max("pack_id"), F.lit(0)) + 1).alias("next_pack"))


def emission(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """oid, emit, pack_id, offset of the wanted objects: how each leaves the store, ordered by its place there.

    A delta leaves as it is if its base is wanted too, a full packed object is copied, all others are written anew.
    """
    ids = wanted.select("oid").distinct()
    bases = ids.select(F.col("oid").alias("base_oid")).withColumn("base_wanted", F.lit(True))
    rows = ids.join(entries, "oid", "left").join(bases, "base_oid", "left")
    kind = (
        F.when(F.col("pack_id").isNull(), "inflate")
        .when(F.col("base_oid").isNull(), "copy")
        .when(F.col("base_wanted"), "delta")
        .otherwise("inflate")
    )
    return rows.select("oid", kind.alias("emit"), "pack_id", "offset")


def resolve_prefix(objects: DataFrame, prefixes: DataFrame) -> DataFrame:
    """prefix, oid: the object that alone starts with the prefix; null where none or several do.

    Prefixes are cut to their first four characters for an equality join, so that no pair is tried that can't match.
    """
    wanted = prefixes.where(F.col("prefix").rlike("^[0-9a-f]{4,40}$")).select("prefix", F.substring("prefix", 1, 4).alias("head"))
    heads = objects.select("oid", F.substring("oid", 1, 4).alias("head")).distinct()
    hits = wanted.join(heads, "head").where(F.col("oid").startswith(F.col("prefix"))).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.min("oid").alias("oid"))
    return prefixes.join(hits, "prefix", "left").select("prefix", F.when(F.col("n") == 1, F.col("oid")).alias("oid"))


def within_budget(files: DataFrame, size: Column, budget: int, *keys: str) -> DataFrame:
    """Files with `kept`: whether the running size in path order stays within the budget."""
    running = F.sum(size).over(Window.partitionBy(*keys).orderBy("path").rowsBetween(Window.unboundedPreceding, 0))
    return files.withColumn("running", running).withColumn("kept", F.col("running") <= budget)
