"""Readers that give the history model's tables from the given Parquet tables.

Events are single-parent commits of one repository per user; orders are commits of several years; regions, nations,
customers and orders form a typed object graph; documents are blobs at source/lang/doc_id; lineitems are the entries of
packs; conversations are files, whose turns are revisions; suppliers are the catalog of repositories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, oid, parent (null at the root), author, time (unix seconds), subject, message."""
    chain = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("repo"),
        F.col("event_id").alias("oid"),
        F.lag("event_id").over(chain).alias("parent"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("author"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("time"),
        F.col("event_type").alias("subject"),
        F.concat_ws(" ", "event_type", "props").alias("message"),
    )


def event_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """oid, parent (null at the root), order (place in its history, from the root on)."""
    chain = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("oid"), F.lag("event_id").over(chain).alias("parent"), F.row_number().over(chain).alias("order"))


def order_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, oid, author, time, of several years."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("oid"), F.col("o_orderpriority").alias("author"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("time")
    )


def object_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, kind of the typed object graph; ids carry their type as a prefix letter."""

    def edge(name: str, src: str, parent: str, dst: str, child: str, kind: str) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(src), F.col(parent).cast("string")).alias("src"), F.concat(F.lit(dst), F.col(child).cast("string")).alias("dst"), F.lit(kind).alias("kind")
        )

    return (
        edge("nation", "r", "n_regionkey", "n", "n_nationkey", "nation")
        .unionAll(edge("customer", "n", "c_nationkey", "c", "c_custkey", "customer"))
        .unionAll(edge("orders", "c", "o_custkey", "o", "o_orderkey", "order"))
    )


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, data (text), doc_id."""
    return table(spark, sf_dir, "documents").select(
        F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("data"), "doc_id"
    )


def pack_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_id, offset, oid, size of pack entries."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("pack_id"), F.col("l_orderkey").alias("offset"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("oid"), F.col("l_quantity").cast("long").alias("size")
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, private, idle of repositories."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), (F.col("s_acctbal") < 0).alias("private"), F.round(F.col("s_acctbal") * 100).cast("long").alias("idle"), "s_nationkey"
    )


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, ordinal (0 is the newest), oid, author, text: each turn is the file after it, older turns included."""
    whole = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("repo"),
        (F.row_number().over(newest) - 1).alias("ordinal"),
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("oid"),
        F.col("role").alias("author"),
        F.col("turn").alias("time"),
        F.concat_ws("\n", F.collect_list(F.col("text")).over(whole)).alias("text"),
    )
