import hashlib
import struct
import zlib

import pandas as pd
import pytest

from annalist.sources import packs


def encode(kind, data):
    """A whole entry: type and size, then the deflated body."""
    number, size = next(n for n, k in packs.KINDS.items() if k == kind), len(data)
    head, size = bytearray([number << 4 | size & 15]), size >> 4
    while size:
        head[-1] |= 128
        head.append(size & 127)
        size >>= 7
    return bytes(head) + zlib.compress(data)


def pack(objects):
    """pack, content: the objects (pack, kind, data) of each pack as a file."""

    def write(key, rows):
        body = b"PACK" + struct.pack(">II", 2, len(rows)) + b"".join(encode(k, bytes(d)) for k, d in zip(rows.kind, rows.data))
        return pd.DataFrame({"pack": [key[0]], "content": [body + hashlib.sha1(body).digest()]})

    return objects.select("pack", "kind", "data").groupBy("pack").applyInPandas(write, "pack string, content binary")


def oid(kind, data):
    return hashlib.sha1(f"{kind} {len(data)}\0".encode() + data).hexdigest()


def number(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def delta(base, target, copied):
    """Copy the first `copied` bytes, then the rest as literals."""
    body = bytes([0x80 | 0x01 | 0x10 | 0x20, 0, copied & 255, copied >> 8])
    rest = target[copied:]
    for i in range(0, len(rest), 127):
        body += bytes([len(rest[i : i + 127])]) + rest[i : i + 127]
    return number(len(base)) + number(len(target)) + body


def head(kind, size):
    out, size = bytearray([kind << 4 | size & 15]), size >> 4
    while size:
        out[-1] |= 128
        out.append(size & 127)
        size >>= 7
    return bytes(out)


def seal(entries):
    body = b"PACK" + struct.pack(">II", 2, len(entries)) + b"".join(entries)
    return body + hashlib.sha1(body).digest()


@pytest.fixture
def history():
    blob = b"line\n" * 300
    blob2 = blob + b"more\n"
    blob3 = blob2 + b"again" * 40
    tree = b"100644 a.txt\0" + bytes.fromhex(oid("blob", blob)) + b"40000 sub\0" + b"\1" * 20 + b"160000 mod\0" + b"\2" * 20
    commit = f"tree {oid('tree', tree)}\nparent {'a' * 40}\nauthor A B <a@b.c> 12 +0530\ncommitter nobody\n\nsubject\n\nbody\n".encode()
    return blob, blob2, blob3, tree, commit


def test_decode_and_resolve(spark, history):
    blob, blob2, blob3, tree, commit = history
    d2, d3 = delta(blob, blob2, len(blob)), delta(blob2, blob3, len(blob2))
    # The base of the first delta follows it; the second names its base by its distance.
    first = head(7, len(d2)) + bytes.fromhex(oid("blob", blob)) + zlib.compress(d2)
    second = head(6, len(d3)) + bytes([len(first)]) + zlib.compress(d3)
    entries = [first, second, encode("blob", blob), encode("tree", tree), encode("commit", commit)]
    lost = head(7, len(d2)) + b"\7" * 20 + zlib.compress(d2)
    rows = [("p", seal(entries)), ("q", seal([lost]))]
    objects, pending = packs.resolve(packs.entries(spark.createDataFrame(rows, "pack string, content binary")))
    assert {r.oid for r in objects.collect()} == {oid("blob", b) for b in history[:3]} | {oid("tree", tree), oid("commit", commit)}
    assert [r.base_oid for r in pending.collect()] == ["07" * 20]
    c = packs.commits(objects).first()
    assert (c.author.name, c.author.email, c.author.time, c.author.tz) == ("A B", "a@b.c", 12, "+0530")
    assert (c.committer.name, c.committer.time, c.committer.tz, c.subject, c.parents) == ("nobody", 0, "+0000", "subject", ["a" * 40])
    assert [(r.mode, r.name) for r in packs.tree_entries(objects).orderBy("pos").collect()] == [("100644", "a.txt"), ("40000", "sub"), ("160000", "mod")]
    assert {r.kind for r in packs.edges(objects).collect()} == {"tree", "parent", "entry"} and packs.edges(objects).count() == 4


def test_damaged_packs():
    good = seal([encode("blob", b"x")])
    for bad in (b"", b"JUNK" + good[4:], good[:-1] + b"\0", seal([encode("blob", b"x") + b"tail"]), seal([head(3, 5) + zlib.compress(b"x")])):
        with pytest.raises(ValueError):
            list(packs.decode(bad))
    for bad in (b"\5\5\x90\1", b"\1\1\0", b"\1\2\1", b"\1\1\x91\1\1"):
        with pytest.raises(ValueError):
            packs.apply_delta(b"x", bad)


def test_round_trip_over_documents(spark):
    from pyspark.sql import functions as F

    from annalist.functions.history import object_id
    from annalist.sources.tables import blobs

    b = blobs(spark, "/root/testdata/sf0.001").select(F.pmod("doc_id", F.lit(5)).cast("string").alias("pack"), F.lit("blob").alias("kind"), F.col("data").cast("binary").alias("data"))
    objects, pending = packs.resolve(packs.entries(pack(b)))
    assert pending.isEmpty()
    assert sorted(r.oid for r in objects.collect()) == sorted(r.oid for r in b.select(object_id("blob", F.col("data")).alias("oid")).collect())
