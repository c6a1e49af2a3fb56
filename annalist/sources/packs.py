"""Packed object files as a source: decode entries, resolve deltas by joins, parse commits, tags and trees.

A pack is one row with its bytes (`spark.read.format("binaryFile")` reads them); decoding is a flat map over packs.
Deltas are resolved level by level: a round joins all pending deltas with the objects resolved in the round before, by
the place or the id of their base, so that chains in any number of packs are resolved together.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.history import object_id
from ..operators.graph import checkpointed

KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag", 6: "offset delta", 7: "reference delta"}
MAX_TARGET = 512 << 20
ENTRIES = "pack string, offset long, kind string, base_offset long, base_oid string, data binary"
PERSON = "struct<name:string,email:string,time:long,tz:string>"
COMMIT = f"tree string, parents array<string>, author {PERSON}, committer {PERSON}, subject string, message string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """pack, content of the pack files under a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pack").load(path).select(F.col("path").alias("pack"), "content")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    """A little-endian number of seven-bit groups, and where it ends."""
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _inflate(view: memoryview, at: int, end: int, size: int, step: int = 1 << 16) -> tuple[bytes, int]:
    """The data of a deflated stream of this size, and where it ends; it is fed in steps, so that what follows it is
    never copied but for a step."""
    body, parts = zlib.decompressobj(), []
    while not body.eof and at < end:
        piece = view[at : min(at + step, end)]
        parts.append(body.decompress(piece))
        at += len(piece)
    data = b"".join(parts)
    if not body.eof or len(data) != size:
        raise ValueError("entry size mismatch")
    return data, at - len(body.unused_data)


def decode(content: bytes) -> Iterator[tuple[int, str, int | None, str | None, bytes]]:
    """(offset, kind, base_offset, base_oid, inflated data) of each entry; a damaged pack raises ValueError."""
    if len(content) < 32 or content[:4] != b"PACK":
        raise ValueError("not a pack")
    version, count = struct.unpack(">II", content[4:12])
    if version not in (2, 3):
        raise ValueError(f"pack version {version}")
    end = len(content) - 20
    if hashlib.sha1(content[:end]).digest() != content[end:]:
        raise ValueError("checksum mismatch")
    at, view = 12, memoryview(content)
    for _ in range(count):
        offset, head = at, content[at]
        high, after = _varint(content, at + 1) if head & 128 else (0, at + 1)
        size, at = (head & 15) | high << 4, after
        kind, base_offset, base_oid = KINDS.get(head >> 4 & 7), None, None
        if kind is None:
            raise ValueError("unknown entry type")
        if kind == "offset delta":
            back = content[at] & 127
            while content[at] & 128:
                at += 1
                back = (back + 1) << 7 | content[at] & 127
            at, base_offset = at + 1, offset - back
        elif kind == "reference delta":
            at, base_oid = at + 20, content[at : at + 20].hex()
        data, at = _inflate(view, at, end, size)
        yield offset, kind, base_offset, base_oid, data
    if at != end:
        raise ValueError("trailing data")


def entries(packs: DataFrame) -> DataFrame:
    """pack, offset, kind, base_offset, base_oid, data of all entries."""

    def run(batches):
        for batch in batches:
            for pack, content in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                rows = list(decode(content))
                columns = [pa.array([pack] * len(rows), pa.string())]
                columns += [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()))]
                yield pa.record_batch(columns, names=["pack", "offset", "kind", "base_offset", "base_oid", "data"])

    return packs.select("pack", "content").mapInArrow(run, ENTRIES)


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """The target of a delta: copies out of the base and literal bytes, all within their bounds."""
    expected, at = _varint(delta, 0)
    size, at = _varint(delta, at)
    if expected != len(base) or size > MAX_TARGET:
        raise ValueError("delta doesn't fit its base")
    out = bytearray()
    while at < len(delta):
        op, at = delta[at], at + 1
        if op & 128:
            fields = []
            for bit in range(7):
                present = op >> bit & 1
                fields.append(delta[at] if present else 0)
                at += present
            start, length = int.from_bytes(bytes(fields[:4]), "little"), int.from_bytes(bytes(fields[4:]), "little") or 0x10000
            if start + length > len(base):
                raise ValueError("copy outside of the base")
            out += base[start : start + length]
        elif op:
            if at + op > len(delta):
                raise ValueError("literal outside of the delta")
            out += delta[at : at + op]
            at += op
        else:
            raise ValueError("reserved delta instruction")
    if len(out) != size:
        raise ValueError("delta result has another size")
    return bytes(out)


def resolve(found: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(objects, pending): oid, kind, pack, offset, data of all that resolves, and the deltas whose base is missing.

    `known` (oid, kind, data) holds bases outside of the packs.
    """

    @F.pandas_udf("binary")
    def patched(bases: pd.Series, deltas: pd.Series) -> pd.Series:
        return pd.Series([apply_delta(bytes(b), bytes(d)) for b, d in zip(bases, deltas)], dtype=object)

    is_delta = F.col("kind").endswith("delta")
    whole = found.where(~is_delta).select(object_id(F.col("kind"), F.col("data")).alias("oid"), "kind", "pack", "offset", "data")
    fresh = objects = checkpointed(whole)
    if known is not None:
        fresh = fresh.unionByName(known.select("oid", "kind", F.lit(None).cast("string").alias("pack"), F.lit(None).cast("long").alias("offset"), "data"))
    pending = checkpointed(found.where(is_delta))
    while not pending.isEmpty():
        base = fresh.select(F.col("oid").alias("b_oid"), F.col("kind").alias("b_kind"), F.col("pack").alias("b_pack"), F.col("offset").alias("b_offset"), F.col("data").alias("b_data"))
        by_place = pending.where("base_offset IS NOT NULL").join(base, (F.col("pack") == F.col("b_pack")) & (F.col("base_offset") == F.col("b_offset")))
        by_id = pending.where("base_oid IS NOT NULL").join(base.dropDuplicates(["b_oid"]), F.col("base_oid") == F.col("b_oid"))
        made = by_place.unionByName(by_id).select("pack", "offset", F.col("b_kind").alias("kind"), patched("b_data", "data").alias("data"))
        fresh = checkpointed(made.select(object_id(F.col("kind"), F.col("data")).alias("oid"), "kind", "pack", "offset", "data"))
        if fresh.isEmpty():
            break
        objects = objects.unionByName(fresh)
        pending = checkpointed(pending.join(fresh.select("pack", "offset"), ["pack", "offset"], "left_anti"))
    return objects, pending


def _person(line: str) -> dict:
    name, mark, rest = line.partition(" <")
    email, close, tail = rest.partition(">")
    if not mark or not close:
        return {"name": line, "email": "", "time": 0, "tz": "+0000"}
    words = tail.split()
    digits = "".join(c for c in (words[0] if words else "") if c.isascii() and c.isdigit())
    zone = words[1] if len(words) > 1 else ""
    valid = len(zone) == 5 and zone[0] in "+-" and zone[1:].isascii() and zone[1:].isdigit()
    return {"name": name, "email": email, "time": int(digits or 0), "tz": zone if valid else "+0000"}


def _headers(data: bytes) -> tuple[dict[str, list[str]], str]:
    head, _, message = data.decode("utf-8", "replace").removeprefix("﻿").partition("\n\n")
    fields: dict[str, list[str]] = {}
    last = None
    for line in head.split("\n"):
        if line.startswith(" ") and last is not None:
            fields[last][-1] += "\n" + line[1:]
        else:
            last, _, value = line.partition(" ")
            fields.setdefault(last, []).append(value)
    return fields, message


def parse_commit(data: bytes) -> dict:
    fields, message = _headers(data)
    if len(fields.get("tree", ())) != 1:
        raise ValueError("a commit needs exactly one tree")
    author, committer = (_person((fields.get(f) or [""])[0]) for f in ("author", "committer"))
    return {"tree": fields["tree"][0], "parents": fields.get("parent", []), "author": author, "committer": committer, "subject": message.partition("\n")[0], "message": message}


def parse_tag(data: bytes) -> dict:
    fields, message = _headers(data)
    if len(fields.get("object", ())) != 1:
        raise ValueError("a tag needs exactly one object")
    tagger = fields.get("tagger")
    return {"object": fields["object"][0], "type": (fields.get("type") or [""])[0], "tag": (fields.get("tag") or [""])[0], "tagger": _person(tagger[0]) if tagger else None, "message": message}


def parse_tree(data: bytes) -> list[dict]:
    out, at = [], 0
    while at < len(data):
        space = data.index(b" ", at)
        end = data.index(b"\0", space)
        if end + 21 > len(data):
            raise ValueError("cut tree entry")
        out.append({"pos": len(out), "mode": data[at:space].decode(), "name": data[space + 1 : end].decode("utf-8", "replace"), "oid": data[end + 1 : end + 21].hex()})
        at = end + 21
    return out


def _parsed(objects: DataFrame, kind: str, schema: str, parse) -> DataFrame:
    @F.pandas_udf(schema)
    def run(data: pd.Series) -> pd.Series:
        return pd.Series([parse(bytes(d)) for d in data], dtype=object)

    return objects.where(F.col("kind") == kind).select("oid", run("data").alias("parsed"))


def commits(objects: DataFrame) -> DataFrame:
    """oid, tree, parents, author, committer, subject, message."""

    def run(batches):
        fields = [f.split(":")[0] for f in ("tree", "parents", "author", "committer", "subject", "message")]
        person = pa.struct([("name", pa.string()), ("email", pa.string()), ("time", pa.int64()), ("tz", pa.string())])
        kinds = [pa.string(), pa.list_(pa.string()), person, person, pa.string(), pa.string()]
        for batch in batches:
            rows = [parse_commit(d) for d in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), *(pa.array([r[f] for r in rows], k) for f, k in zip(fields, kinds))], names=["oid", *fields])

    return objects.where("kind = 'commit'").select("oid", "data").mapInArrow(run, f"oid string, {COMMIT}")


def tree_entries(objects: DataFrame) -> DataFrame:
    """tree_oid, pos, mode, name, oid."""
    parsed = _parsed(objects, "tree", "array<struct<pos:int,mode:string,name:string,oid:string>>", parse_tree)
    return parsed.select(F.col("oid").alias("tree_oid"), F.inline("parsed"))


def edges(objects: DataFrame) -> DataFrame:
    """src, dst, kind of commits to trees and parents and of trees to entries, links to other repositories left out."""
    c, t = commits(objects), tree_entries(objects).where("mode <> '160000'")
    return (
        c.select(F.col("oid").alias("src"), F.col("tree").alias("dst"), F.lit("tree").alias("kind"))
        .unionAll(c.select("oid", F.explode("parents"), F.lit("parent")))
        .unionAll(t.select("tree_oid", "oid", F.lit("entry")))
    )
