"""Removal of repeated byte strings by distributed prefix doubling.

A position's rank names the bytes that follow it; the rank of a longer string names the pair of the ranks of its parts at
a growing offset. In each round Spark sorts (rank, ...) rows, and positions whose rank is unique leave; those left at the
threshold are repeats. Inside a text, pairs lie side by side and ranks double without an exchange. What is exchanged:

1. Ranks of ANCHOR bytes, of one position in each window of the threshold's length: the one whose rank has the smallest
   hash. Equal windows choose alike, so a window whose anchor's rank is unique is itself unique. Neighbouring windows
   with one anchor are a run.
2. For the anchors left, the rank of the whole run, sorted below that of its anchor. A run that also stands in a document
   of smaller key goes as a whole, so that long copies take one row for each run. Of the others, the first occurrence of
   each run goes on if its anchor stands in several runs.
3. For these, two longer ranks: of the bytes that all windows share in which the anchor lies in the first half, and those
   in which it lies in the second half.
4. For the halves left, the ranks of their whole windows; a window goes if it stands in a document of smaller key.

Before these, texts that a smaller key has as a whole leave: all of their windows are repeats.
Documents are dealt, compressed, to chunks of about CHUNK_BYTES by a hash of the key. A chunk sends each distinct rank once, with its
smallest key, so that no rank has more rows than there are chunks, however many documents share it; anchors of very many
different runs are dealt by the ranks of these. Ranks of rounds 1 and 3, which only rule out, have as many bits as keep
chance agreements below one in a hundred; those of rounds 2 and 4, which decide, are 64-bit hashes.

Defined results: a null or empty text, or one shorter than the threshold, loses nothing; rows of one key don't remove each
other's bytes, as only smaller keys count; rows with a null key lose nothing and remove nothing; an empty table gives an
empty result; columns beside key and text are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, text_column

ANCHOR = 20
#: Bytes of text in a chunk, about, and bytes that numpy handles at a time.
CHUNK_BYTES = 4 << 20
BLOCK_BYTES = 1 << 17
#: Runs of one anchor rank, about, beyond which they are dealt by their own ranks.
HOT_RUNS = 1 << 15
#: Tasks over which the copies of one text are spread.
SALTS = 16
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_LOW = np.uint64((1 << 20) - 1)
#: Kinds of messages to a chunk.
COPIES, ANCHORS, RUNS, HALVES, WINDOWS = range(5)
_MESSAGE = "chunk int, kind int, value long"
_RESULT = [("key", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


def _pair(rank: np.ndarray, gap: int) -> np.ndarray:
    """Ranks of the pairs (rank[i], rank[i + gap])."""
    x = rank[: len(rank) - gap] * _A
    x ^= x >> np.uint64(32)
    x *= _C
    x += rank[gap:]
    x *= _B
    x ^= x >> np.uint64(29)
    return x


def prefix_ranks(data: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """Ranks of the strings of these lengths at each position, by doubling; lengths ascend. Eight bytes at a time (or
    four, two, one, if a length is smaller) are their own first rank."""
    have = next(n for n in (8, 4, 2, 1) if n <= lengths[0])
    n = max(0, len(data) - have + 1)
    rank = _mix((np.ndarray((n,), f"<u{have}", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64) + np.uint64(have)) * _A)
    out = []
    for length in lengths:
        while 2 * have <= length:
            rank, have = _pair(rank, have) if len(rank) > have else rank[:0], 2 * have
        out.append(rank if have == length else _pair(rank, length - have) if len(rank) > length - have else rank[:0])
    return out


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where each distinct value of a sorted array starts."""
    return np.flatnonzero(np.concatenate([np.ones(min(len(ordered), 1), bool), ordered[1:] != ordered[:-1]]))


def _least(rank: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ranks, ascending, the least key of each, and for each rank given its place among them."""
    order = np.argsort(rank, kind="stable")
    starts = _starts(rank[order])
    if not len(order):
        return rank, key, order
    at = np.empty(len(order), np.int64)
    at[order] = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(order)))
    return rank[order[starts]], np.minimum.reduceat(key[order], starts), at


def _several(rank: np.ndarray, what: np.ndarray) -> np.ndarray:
    """For each row, whether its rank also occurs with another `what` among the rows."""
    _, low, at = _least(rank, what)
    _, high, _ = _least(rank, ~what)
    return (low < ~high)[at] if len(at) else np.zeros(0, bool)


class _Shape:
    """Threshold, anchor length, and bits of the ranks that only rule out."""

    def __init__(self, span: int, anchor: int, bits: int):
        self.span, self.anchor, self.bits = span, anchor, bits
        self.windows = span - anchor + 1  # at most, in a run
        # Windows with the anchor at distance d < half all hold the bytes from the anchor on, others those before it.
        self.half = self.windows // 2

    def short(self, rank: np.ndarray) -> np.ndarray:
        return (rank >> np.uint64(64 - self.bits)).astype(np.int64)


class _Chunk:
    """The texts of a chunk one after the other, in the order of their keys."""

    def __init__(self, table: pa.Table, shape: _Shape, told: pa.Table):
        self.shape = shape
        table = table.sort_by([("key", "ascending"), ("mark", "ascending")]).combine_chunks()
        keys = table.column("key")
        self.keys, self.known = keys.fill_null(0).to_numpy(), np.asarray(keys.is_valid())
        self.copies = np.isin(table.column("mark").to_numpy(), _told(told, COPIES)) & self.known
        unpack = zstandard.ZstdDecompressor().decompress
        texts = [unpack(body) for body in table.column("body").to_pylist()]
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)

    def runs(self) -> None:
        """first, count (of windows), before (the anchor's distance from the first), rank (of the anchor), block (of the
        whole run) and key of each run, in order.

        The chunk is handled in blocks of windows; a run that a block's end cuts is two runs, which changes no answer.
        """
        span, n = self.shape.span, len(self.data)
        inside = np.ones(n, bool)  # windows that lie within one document that counts
        ends = self.bounds[1:]
        tails = (ends[:, None] - np.arange(1, span)[None, :]).ravel() if len(ends) else ends
        inside[tails[tails >= 0]] = False
        out = ~self.known | self.copies
        for a, b in zip(self.bounds[:-1][out].tolist(), ends[out].tolist()):
            inside[a:b] = False
        none = np.zeros(0, np.int64)
        found: list[list[np.ndarray]] = [[none], [none], [none], [none.astype(np.uint64)], [none.astype(np.uint64)]]
        for at in range(0, n - span + 1, BLOCK_BYTES):
            near, whole = prefix_ranks(self.data[at : at + BLOCK_BYTES + span - 1], self.shape.anchor, span)
            m = len(whole)
            # The smallest hash in its upper bits, the leftmost position in its lower ones.
            least = (_mix(near * _C) & ~_LOW) | np.arange(len(near), dtype=np.uint64)
            have, width = 1, self.shape.windows
            while 2 * have <= width:
                least, have = np.minimum(least[:-have], least[have:]), 2 * have
            if have < width:
                least = np.minimum(least[: have - width], least[width - have :])
            chosen = (least[:m] & _LOW).astype(np.int64)
            here = inside[at : at + m]
            new, old = here.copy(), here.copy()
            same = here[1:] & here[:-1] & (chosen[1:] == chosen[:-1])
            new[1:] &= ~same
            old[:-1] &= ~same
            first, last = np.flatnonzero(new), np.flatnonzero(old)
            count, anchor = last - first + 1, chosen[first]
            found[0].append(first + at)
            found[1].append(count)
            found[2].append(anchor - first)
            found[3].append(near[anchor])
            # The first and the last window overlap, so that together they name all bytes of the run.
            found[4].append(_mix(whole[first] * _A + whole[last] * _C + count.astype(np.uint64)))
        self.first, self.count, self.before, self.rank, self.block = map(np.concatenate, found)
        self.key = self.keys[np.searchsorted(self.bounds, self.first, "right") - 1]

    def place(self, runs: np.ndarray) -> np.ndarray:
        """One number for where a run is, how many windows it has, and where its anchor is."""
        w = self.shape.windows
        return (self.first[runs] * w + self.count[runs] - 1) * w + self.before[runs]

    def placed(self, places: np.ndarray) -> "_Owned":
        w, places = self.shape.windows, np.sort(places)
        return _Owned(self, places // (w * w), places // w % w + 1, places % w)


class _Owned:
    """Runs of a chunk that no document of smaller key has, though the anchor stands in other runs too."""

    def __init__(self, chunk: _Chunk, first: np.ndarray, count: np.ndarray, before: np.ndarray):
        self.chunk, self.first, self.count, self.before = chunk, first, count, before
        self.key = chunk.keys[np.searchsorted(chunk.bounds, first, "right") - 1]

    def _of(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Ranks of the strings of this length at these places."""
        bytes_ = self.chunk.data[(starts[:, None] + np.arange(length)[None, :]).ravel()]
        (ranks,) = prefix_ranks(bytes_, length)
        return ranks[::length]

    def halves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """rank, run and side (0: the anchor is in the first half of the window) of the halves that have windows."""
        shape = self.chunk.shape
        at = self.first + self.before
        near = np.flatnonzero(self.before - self.count + 1 < shape.half)
        far = np.flatnonzero(self.before >= shape.half)
        ranks = [self._of(at[near], shape.span - shape.half + 1), ~self._of(at[far] - shape.half, shape.half + shape.anchor)]
        return shape.short(np.concatenate(ranks)), np.concatenate([near, far]), np.repeat([0, 1], [len(near), len(far)])

    def windows(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """rank and run of each window, those left out whose half is neither among `shared` nor in several runs here;
        and the place of each."""
        shape = self.chunk.shape
        rank, run, side = self.halves()
        left = np.isin(rank, shared) | _several(rank, run)
        alive = np.zeros((2, len(self.first)), bool)
        alive[side[left], run[left]] = True
        size = self.count + shape.span - 1
        inner = lambda n: np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        bytes_ = self.chunk.data[np.repeat(self.first, size) + inner(size)]
        (whole,) = prefix_ranks(bytes_, shape.span) if len(bytes_) else (np.zeros(0, np.uint64),)
        owner, j = np.repeat(np.arange(len(self.count)), self.count), inner(self.count)
        ranks = whole[np.repeat(np.cumsum(size) - size, self.count) + j] if len(owner) else whole
        kept = alive[(np.repeat(self.before, self.count) - j >= shape.half).astype(np.int64), owner]
        return ranks[kept].view(np.int64), owner[kept], (np.repeat(self.first, self.count) + j)[kept]


def _rows(**columns: np.ndarray | int) -> pa.Table:
    n = max((len(c) for c in columns.values() if isinstance(c, np.ndarray)), default=0)
    return pa.table({k: pa.array(v if isinstance(v, np.ndarray) else np.full(n, v, np.int32)) for k, v in columns.items()})


def _packed(batches):
    """The texts of batches (key, text, chunk, mark), compressed one by one."""
    pack = zstandard.ZstdCompressor().compress
    for batch in batches:
        bodies = pa.array([pack(text) for text in batch.column(1).cast(pa.binary()).to_pylist()], pa.binary())
        yield pa.record_batch([batch.column(0), bodies, batch.column(2), batch.column(3)], names=["key", "body", "chunk", "mark"])


def _told(messages: pa.Table, kind: int) -> np.ndarray:
    value = messages.column("value").to_numpy()
    return value[messages.column("kind").to_numpy() == kind]


def rounds(docs: DataFrame, span: int = 50, anchor: int = ANCHOR, text: str = "text", key: str = "doc_id", hot_runs: int = HOT_RUNS) -> dict[str, DataFrame]:
    """The rows that are sorted in each round (`anchors`, `runs`, `halves`, `windows`), and `kept`, what `remove_repeats` returns."""
    spark = docs.sparkSession
    source = docs.select(F.col(key).cast("long").alias("key"), text_column(text).alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(partitions(spark), total // CHUNK_BYTES + 1)
    shape = _Shape(span, anchor, min(60, math.ceil(math.log2(total + 2)) + 4))
    number = F.pmod(F.xxhash64("key", F.when(F.col("key").isNull(), F.xxhash64("text"))), F.lit(chunks)).cast("int")
    mark = F.xxhash64("key", "text")
    dealt = source.select("key", "text", number.alias("chunk"), mark.alias("mark")).mapInArrow(_packed, "key long, body binary, chunk int, mark long").repartition("chunk")
    # Of each text that has several keys, all but the smallest.
    names = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]
    named = source.where("key IS NOT NULL").select("key", number.alias("chunk"), mark.alias("mark"), *names)
    several = named.groupBy("h1", "h2").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most")
    salted = several.select("h1", "h2", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    twins = named.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["h1", "h2", "salt"]).where("key > least")
    copies = twins.select("chunk", F.lit(COPIES).alias("kind"), F.col("mark").alias("value"))

    def visit(messages: DataFrame, body: Callable[[_Chunk, int, pa.Table], pa.Table], schema: str) -> DataFrame:
        """Each chunk, with or without messages, through `body`, which gets the chunk, its number and what it is told."""

        def run(table: pa.Table, told: pa.Table) -> pa.Table:
            return body(_Chunk(table, shape, told), table.column("chunk")[0].as_py(), told)

        return dealt.groupBy("chunk").cogroup(copies.unionAll(messages).groupBy("chunk")).applyInArrow(run, schema)

    def elsewhere(rows: DataFrame, kind: int) -> DataFrame:
        """Sorts (rank, chunk, size), and tells chunks which of their ranks another chunk has too, and which of these
        very many runs have."""
        of = Window.partitionBy("rank")
        met = rows.withColumn("met", F.min("chunk").over(of) < F.max("chunk").over(of)).withColumn("hot", F.sum(F.expr("shiftleft(1L, size)")).over(of) > hot_runs)
        return met.where("met").select("chunk", F.lit(kind).alias("kind"), (2 * F.col("rank") + F.col("hot").cast("long")).alias("value"))

    def anchors(chunk: _Chunk, number: int, told: pa.Table) -> pa.Table:
        chunk.runs()
        ranks = np.sort(shape.short(chunk.rank))
        starts = _starts(ranks)
        size = np.ceil(np.log2(np.diff(starts, append=len(ranks)))).astype(np.int32) if len(ranks) else ranks.astype(np.int32)
        return _rows(rank=ranks[starts], chunk=number, size=size)

    def runs(chunk: _Chunk, number: int, told: pa.Table) -> pa.Table:
        chunk.runs()
        value, rank = _told(told, ANCHORS), shape.short(chunk.rank)
        left = np.flatnonzero(np.isin(rank, value >> 1) | _several(rank, chunk.key))
        block = chunk.block[left].view(np.int64)
        order = np.lexsort((chunk.first[left], block))  # places ascend with keys
        one = order[_starts(block[order])]
        mine = left[one]
        hot = np.isin(rank[mine], value[value & 1 == 1] >> 1)
        group = np.where(hot, (block[one] >> 2) & ((1 << 62) - 1) | (1 << 61), rank[mine])
        return _rows(group=group, block=block[one], key=chunk.key[mine], chunk=number, place=2 * chunk.place(mine) + hot)

    def halves(chunk: _Chunk, number: int, told: pa.Table) -> pa.Table:
        value = _told(told, RUNS)
        ranks = np.unique(chunk.placed(value[value & 1 == 0] >> 1).halves()[0])
        return _rows(rank=ranks, chunk=number, size=np.zeros(len(ranks), np.int32))

    def windows(chunk: _Chunk, number: int, told: pa.Table) -> pa.Table:
        value = _told(told, RUNS)
        owned = chunk.placed(value[value & 1 == 0] >> 1)
        rank, run, _ = owned.windows(_told(told, HALVES) >> 1)
        ranks, keys, _ = _least(rank, owned.key[run])
        return _rows(rank=ranks, key=keys, chunk=number)

    def remove(chunk: _Chunk, number: int, told: pa.Table) -> pa.Table:
        chunk.runs()
        value = _told(told, RUNS)
        owned = chunk.placed(value[value & 1 == 0] >> 1)
        rank, run, at = owned.windows(_told(told, HALVES) >> 1)
        _, least, where = _least(rank, owned.key[run])
        # A window is sent under its smallest key here, and stays for that one if no other chunk has a smaller one.
        gone = ~np.isin(rank, _told(told, WINDOWS)) | ((owned.key[run] > least[where]) if len(run) else np.zeros(0, bool))
        # Runs by what they hold: a copy under a larger key goes, and all go where a smaller key elsewhere has it.
        block = chunk.block.view(np.int64)
        order = np.lexsort((chunk.first, block))
        starts = _starts(block[order])
        owner = np.repeat(order[starts], np.diff(starts, append=len(order)))
        first = np.empty(len(order), np.int64)
        first[order] = owner
        later = (chunk.key > chunk.key[first]) | np.isin(chunk.place(first), value[value & 1 == 1] >> 1)
        step = np.zeros(len(chunk.data) + 1, np.int64)
        np.add.at(step, chunk.first[later], 1)
        np.add.at(step, chunk.first[later] + chunk.count[later] + span - 1, -1)
        # The first key may hold a run more than once: what is gone of the first is gone of all.
        twins = np.flatnonzero(~later)
        source = np.searchsorted(owned.first, chunk.first[first[twins]])
        held = np.isin(chunk.first[first[twins]], owned.first)
        twins, source = twins[held], source[held]
        hits = np.flatnonzero(gone)
        by_run = np.searchsorted(run[hits], np.arange(len(owned.first) + 1))
        size = by_run[source + 1] - by_run[source]
        pick = hits[np.repeat(by_run[source], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        places = at[pick] - owned.first[run[pick]] + np.repeat(chunk.first[twins], size)
        np.add.at(step, places, 1)
        np.add.at(step, places + span, -1)
        whole = chunk.copies & (np.diff(chunk.bounds) >= span)
        np.add.at(step, chunk.bounds[:-1][whole], 1)
        np.add.at(step, chunk.bounds[1:][whole], -1)
        lost = np.cumsum(step[:-1]) > 0
        begins = lost.copy()
        begins[1:] &= ~lost[:-1]
        starts = chunk.bounds[:-1][np.diff(chunk.bounds) > 0]
        begins[starts] = lost[starts]
        upto = lambda x: np.concatenate([[0], np.cumsum(x)])[chunk.bounds]
        kept, ends = chunk.data[~lost], upto(~lost)
        texts = pa.Array.from_buffers(pa.large_binary(), len(chunk.keys), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(kept)])
        columns = [pa.array(chunk.keys, mask=~chunk.known), np.diff(chunk.bounds), np.diff(upto(lost)), np.diff(upto(begins)), texts.cast(pa.binary())]
        return pa.table({c: pa.array(x, t) if isinstance(x, np.ndarray) else x for (c, t), x in zip(_RESULT, columns)})

    ranks = visit(copies.where(F.lit(False)), anchors, "rank long, chunk int, size int")
    of_group = Window.partitionBy("group")
    sent = visit(elsewhere(ranks, ANCHORS), runs, "group long, block long, key long, chunk int, place long")
    judged = sent.withColumn("least", F.min("key").over(Window.partitionBy("group", "block"))).withColumn("mixed", (F.min("block").over(of_group) < F.max("block").over(of_group)) | (F.col("place").bitwiseAND(F.lit(1)) == 1))
    later = F.col("key") > F.col("least")
    run_messages = judged.where(later | F.col("mixed")).select("chunk", F.lit(RUNS).alias("kind"), (F.col("place") - F.col("place").bitwiseAND(F.lit(1)) + later.cast("long")).alias("value"))
    halved = visit(run_messages, halves, "rank long, chunk int, size int")
    half_messages = elsewhere(halved, HALVES)
    both = run_messages.unionAll(half_messages)
    whole = visit(both, windows, "rank long, key long, chunk int").withColumn("least", F.min("key").over(Window.partitionBy("rank")))
    # Told are the windows that stay, which are fewer: a window of a shared half is mostly shared.
    window_messages = whole.where(~later).select("chunk", F.lit(WINDOWS).alias("kind"), F.col("rank").alias("value"))
    kept = visit(both.unionAll(window_messages), remove, "key long, n_bytes long, n_removed long, n_spans long, kept binary")
    return {"anchors": ranks, "runs": sent, "halves": halved, "windows": whole, "kept": kept.withColumnRenamed("key", key)}


def remove_repeats(docs: DataFrame, span: int = 50, anchor: int = ANCHOR, text: str = "text", key: str = "doc_id", hot_runs: int = HOT_RUNS) -> DataFrame:
    """`key` (long), `n_bytes`, `n_removed`, `n_spans` and `kept` (binary): each text without the bytes that lie in a string of
    `span` bytes that also starts in a document of smaller key."""
    return rounds(docs, span, anchor, text, key, hot_runs)["kept"]


def brute_force(texts: dict[int, str], span: int = 50) -> dict[int, tuple[int, int, int, str]]:
    """The contract of op9 read literally, for tests."""
    seen: dict[bytes, int] = {}
    out = {}
    for k in sorted(texts):
        data = (texts[k] or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - span + 1):
            if seen.setdefault(data[i : i + span], k) < k:
                gone[i : i + span] = b"\1" * span
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[k] = (len(data), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest())
    return out


def op9(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The same in SQL, over hexadecimal texts.
SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 100)) AS g FROM (SELECT doc_id, x, unnest(range(len(x) // 2 - 49)) AS i FROM d WHERE len(x) >= 100)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM w) WHERE least < doc_id),
n AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM r),
s AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n) GROUP BY doc_id, run),
p AS (SELECT s.doc_id, a, b, substr(x, 2 * coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0))) AS piece FROM s JOIN d ON d.doc_id = s.doc_id),
k AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(piece, '' ORDER BY a) AS head FROM p GROUP BY doc_id)
SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
