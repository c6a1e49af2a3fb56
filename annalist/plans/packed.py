"""Queries on objects as packs hold them: raw commits and trees that are parsed, and chains of deltas that are resolved.

The bytes are made from the given tables by columns: commits from events, trees from documents, and packs from
conversations, each turn a delta that appends its text to the file as the turn before left it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import history as H
from ..sources import packs
from ..sources import tables as T


def _raw_commits(spark, d) -> DataFrame:
    """oid, kind, data: a commit object for each event."""
    c = T.event_commits(spark, d)
    named = lambda i: F.sha1(F.col(i).cast("string"))
    person = F.format_string("user %d <u%d@example.com> %d +0130", "repo", "repo", "time")
    parent = F.coalesce(F.concat(F.lit("parent "), named("parent"), F.lit("\n")), F.lit(""))
    raw = F.concat(F.lit("tree "), named("oid"), F.lit("\n"), parent, F.lit("author "), person, F.lit("\ncommitter "), person, F.lit("\n\n"), "subject", F.lit("\n\n"), F.coalesce("message", F.lit("")))
    return c.select(H.object_id("commit", raw).alias("oid"), F.lit("commit").alias("kind"), raw.cast("binary").alias("data"))


def _commits(spark, d) -> DataFrame:
    c = packs.commits(_raw_commits(spark, d))
    return c.select("oid", "tree", F.array_join("parents", " ").alias("parents"), F.col("author.name").alias("name"), F.col("author.email").alias("email"), F.col("committer.time").alias("time"), F.col("author.tz").alias("tz"), "subject", F.length("message").alias("n_message"))


def _raw_trees(spark, d) -> DataFrame:
    """oid (the directory's path), kind, data: a tree object for each source and language."""
    name = F.col("doc_id").cast("string")
    piece = F.concat(F.encode(F.concat(F.lit("100644 "), name), "UTF-8"), F.unhex(F.lit("00")), F.unhex(F.sha1(name)))
    rows = T.table(spark, d, "documents").select(F.concat_ws("/", "source", "lang").alias("oid"), F.struct(name.alias("name"), piece.alias("piece")).alias("entry"))
    # A directory's entries are one object.
    joined = rows.groupBy("oid").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    return joined.select("oid", F.lit("tree").alias("kind"), F.aggregate("entries", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["piece"])).alias("data"))


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _appending(size: int, addition: bytes) -> bytes:
    """The delta that copies a base of this size and appends these bytes."""
    out = bytearray(_number(size) + _number(size + len(addition)))
    for at in range(0, size, 0xFFFF):
        out += bytes([0b10111111]) + at.to_bytes(4, "little") + min(0xFFFF, size - at).to_bytes(2, "little")
    for at in range(0, len(addition), 127):
        part = addition[at : at + 127]
        out += bytes([len(part)]) + part
    return bytes(out)


def _entries(spark, d) -> DataFrame:
    """pack, offset, kind, base_offset, base_oid, data of a pack for each conversation."""

    @F.pandas_udf("binary")
    def delta(sizes: pd.Series, additions: pd.Series) -> pd.Series:
        return pd.Series([_appending(int(n), bytes(a)) for n, a in zip(sizes, additions)], dtype=object)

    turn = Window.partitionBy("conv_id").orderBy("turn")
    before = turn.rowsBetween(Window.unboundedPreceding, -1)
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    c = T.table(spark, d, "conversations").select("conv_id", "turn", text.alias("body"))
    sized = c.select("*", (F.sum(F.octet_length("body") + 1).over(before) - 1).alias("size"), F.lag("turn").over(turn).alias("base"))
    first = F.col("base").isNull()
    changed = delta(F.coalesce("size", F.lit(0)), F.concat(F.encode(F.lit("\n"), "UTF-8"), "body"))
    return sized.select(
        F.col("conv_id").cast("string").alias("pack"), F.col("turn").cast("long").alias("offset"), F.when(first, "blob").otherwise("offset delta").alias("kind"),
        F.col("base").cast("long").alias("base_offset"), F.lit(None).cast("string").alias("base_oid"), F.when(first, F.col("body")).otherwise(changed).alias("data"),
    )


def _resolved(spark, d) -> DataFrame:
    objects, _ = packs.resolve(_entries(spark, d))
    return objects.select("pack", "offset", "oid", F.octet_length("data").cast("long").alias("size"))


_ID = "sha1(CAST('{0} ' || octet_length(encode({1})) AS BLOB) || '\\x00'::BLOB || encode({1}))"
QUERIES = {
    "parse_commits": (
        _commits,
        f"""WITH c AS (SELECT *, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS time, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent FROM events),
        p AS (SELECT *, 'user ' || user_id || ' <u' || user_id || '@example.com> ' || time || ' +0130' AS person, event_type || chr(10) || chr(10) || concat_ws(' ', event_type, props) AS message FROM c),
        r AS (SELECT *, 'tree ' || sha1(CAST(event_id AS VARCHAR)) || chr(10) || coalesce('parent ' || sha1(CAST(parent AS VARCHAR)) || chr(10), '') || 'author ' || person || chr(10) || 'committer ' || person || chr(10) || chr(10) || message AS raw FROM p)
        SELECT {_ID.format("commit", "raw")} AS oid, sha1(CAST(event_id AS VARCHAR)) AS tree, coalesce(sha1(CAST(parent AS VARCHAR)), '') AS parents, 'user ' || user_id AS name,
          'u' || user_id || '@example.com' AS email, time, '+0130' AS tz, event_type AS subject, CAST(length(message) AS INT) AS n_message FROM r""",
    ),
    "parse_trees": (
        lambda spark, d: packs.tree_entries(_raw_trees(spark, d)),
        """SELECT source || '/' || lang AS tree_oid, CAST(row_number() OVER (PARTITION BY source, lang ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS INT) AS pos, '100644' AS mode,
        CAST(doc_id AS VARCHAR) AS name, sha1(CAST(doc_id AS VARCHAR)) AS oid FROM documents""",
    ),
    "resolve_deltas": (
        _resolved,
        f"""WITH f AS (SELECT conv_id, turn, string_agg(coalesce(text, ''), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn) AS body FROM conversations)
        SELECT CAST(conv_id AS VARCHAR) AS pack, CAST(turn AS BIGINT) AS "offset", {_ID.format("blob", "body")} AS oid, CAST(octet_length(encode(body)) AS BIGINT) AS size FROM f""",
    ),
}
