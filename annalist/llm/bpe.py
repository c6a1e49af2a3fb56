"""Byte-level BPE: encode texts by a file of merge ranks, and decode the ids again.

Each match of the split pattern is merged on its own. A binary segment tree over the byte positions of the match holds, at
its root, the leftmost position of the lowest pair rank; a merge updates the leaves of the merged pair and of its live
left neighbour, and the nodes above them, so that a match of any length takes a number of steps that is its length
times a logarithm. The trees of many matches are the rows of one array: a step merges one pair in each of them.

The pattern is matched on the classes of the characters (letter, number, white space, other) by Unicode 16.0, as the
library has them, with the letters of the contractions as themselves.

Defined results: a null or empty text has no tokens and decodes to no bytes; repeated rows, rows with a null key among
them, are encoded one by one; an empty table gives an empty result; other columns are not read. Texts are only ever
handled row by row.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .characters import LETTER, NUMBER, SPACE, classes, code_points
from .common import text_column

#: Matches that one Python worker remembers before it starts anew, and leaves of the trees that it merges at a time;
#: bounds on memory only.
MEMO, LEAVES = 300_000, 1 << 17
#: Bytes of text that are handled at a time, about.
SLICE = 1 << 20
_NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Pairs:
    """The rank of each pair of tokens that may merge; the merged token has it as its id."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {
            (left << 32) | right: rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None
        }
        self.key = np.array(sorted(pairs) or [-1], np.int64)
        self.rank = np.array([pairs.get(int(k), _NONE) for k in self.key], np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, or _NONE."""
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], _NONE)


def merge_all(ids: np.ndarray, sizes: np.ndarray, pairs: Pairs, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of matches of up to `leaves` (a power of two) symbols: `ids` has a row for each match, of which the
    first sizes[row] are symbols. All tokens, row by row, and how many each row has."""
    rows, place = len(ids), np.arange(leaves)
    live = place[None, :] < sizes[:, None]
    after, before = np.tile(place + 1, (rows, 1)), np.tile(place - 1, (rows, 1))
    tree = np.full((rows, 2 * leaves), _NONE, np.int64)
    rank = pairs.of(ids[:, :-1], ids[:, 1:])
    tree[:, leaves:-1] = np.where(live[:, 1:] & (rank < _NONE), rank * leaves + place[:-1], _NONE)
    width = leaves
    while width > 1:
        tree[:, width // 2 : width] = np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2])
        width //= 2
    row = np.flatnonzero(tree[:, 1] < _NONE)
    while len(row):
        least = tree[row, 1]
        i = least % leaves
        j = after[row, i]
        k, h = after[row, j], before[row, i]
        ids[row, i] = least // leaves
        live[row, j] = False
        after[row, i] = k
        has_k, has_h = k < sizes[row], h >= 0
        before[row[has_k], k[has_k]] = i[has_k]
        # The merged pair's left place pairs with what follows, and what stands before it with the merged token.
        left = np.concatenate([i[has_k], h[has_h]])
        right = np.concatenate([k[has_k], i[has_h]])
        who = np.concatenate([row[has_k], row[has_h]])
        new = pairs.of(ids[who, left], ids[who, right])
        tree[row, leaves + j] = _NONE
        tree[row, leaves + i] = _NONE
        tree[who, leaves + left] = np.where(new < _NONE, new * leaves + left, _NONE)
        who, node = np.concatenate([row, row, row[has_h]]), np.concatenate([i, j, h[has_h]]) + leaves
        while node[0] > 1:
            node >>= 1
            tree[who, node] = np.minimum(tree[who, 2 * node], tree[who, 2 * node + 1])
        row = row[tree[row, 1] < _NONE]
    return ids[live], live.sum(1)


#: The characters that stand for the classes: any letter but those of contractions, a number, and other white space.
_SHOWN = np.full(4, ord("."), np.uint8)
_SHOWN[[LETTER, NUMBER, SPACE]] = [ord("a"), ord("0"), ord("\t")]
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[a-z]+| ?0+| ?[.']+|\s+(?!\S)|\s+")


def _shown() -> np.ndarray:
    """What the pattern sees of each code point."""
    shown = _SHOWN[classes()]
    for c in "strevmld' ":
        shown[ord(c)] = ord(c)
    return shown


class Codec:
    """Encoder and decoder for one file of ranks, under public_tokenizers.PATTERN."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pairs = Pairs(ranks)
        self.shown = _shown()
        self.memo: dict[str, tuple[int, ...]] = {}
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def split(self, text: str) -> list[str]:
        """The matches of the pattern."""
        shown = self.shown[code_points(text)].tobytes().decode("latin-1")
        ends = np.cumsum([len(x) for x in _SPLIT.findall(shown)]).tolist()
        return [text[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, pieces: Iterable[str]) -> None:
        """Merge the matches that aren't remembered, those of similar length together."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        by_leaves: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            if piece not in self.memo:
                data = piece.encode("utf-8", "surrogatepass")
                if (whole := self.ranks.get(data)) is not None:
                    self.memo[piece] = (whole,)
                else:
                    by_leaves.setdefault(max(2, 1 << (len(data) - 1).bit_length()), []).append((piece, data))
        for leaves, group in by_leaves.items():
            at_once = max(1, LEAVES // leaves)
            for at in range(0, len(group), at_once):
                part = group[at : at + at_once]
                symbols = np.frombuffer(b"".join(data.ljust(leaves, b"\0") for _, data in part), np.uint8).reshape(len(part), leaves)
                tokens, count = merge_all(self.byte[symbols], np.array([len(data) for _, data in part]), self.pairs, leaves)
                ends = np.cumsum(count).tolist()
                tokens = tokens.tolist()
                for (piece, _), a, b in zip(part, [0, *ends], ends):
                    self.memo[piece] = tuple(tokens[a:b])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        pieces = [self.split(t) for t in texts]
        self.learn(set(chain.from_iterable(pieces)))
        memo = self.memo
        return [np.fromiter(chain.from_iterable(map(memo.__getitem__, p)), np.int32) for p in pieces]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids; one gather over the table of token bytes."""
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - (ends - size), size)
        return self.bytes[at].tobytes()


#: The codec that this Python worker used last, which outlives its tasks.
_codecs: dict[str, Codec] = {}


def _codec(path: str, shared) -> Codec:
    if path not in _codecs:
        _codecs.clear()
        _codecs[path] = Codec(shared.value)
    return _codecs[path]


def _slices(batch: pa.RecordBatch, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, by the sizes of its rows."""
    i = 0
    while i < batch.num_rows:
        j, size = i + 1, sizes[i]
        while j < batch.num_rows and size + sizes[j] <= SLICE:
            size += sizes[j]
            j += 1
        yield batch.slice(i, j - i)
        i = j


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays or [np.zeros(0, np.int32)]).astype(np.int32)))


def _ranks(spark: SparkSession, path: str):
    """The ranks file, read once on the driver; a vocabulary is some hundred thousand entries at most."""
    return spark.sparkContext.broadcast(load_ranks(path))


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key` and `ids`, the token ids of each text."""
    return _run(docs.select(F.col(key), text_column(text).alias("text")), path, key, decoded=False)


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """`key` and `decoded`, the bytes of each row's `ids`; null ids count as none."""
    shared = _ranks(encoded.sparkSession, path)

    def run(batches):
        codec = _codec(path, shared)
        for batch in batches:
            for part in _slices(batch, [16 * len(x or ()) for x in batch.column(1).to_pylist()]):
                out = [codec.decode(np.asarray(x or (), np.int32)) for x in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(out, pa.binary())], names=[key, "decoded"])

    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {encoded.schema[key].dataType.simpleString()}, decoded binary")


def round_trip(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key`, `ids` and `decoded`: the ids of each text, and the bytes that these ids decode to, in one pass."""
    return _run(docs.select(F.col(key), text_column(text).alias("text")), path, key, decoded=True)


def _run(rows: DataFrame, path: str, key: str, decoded: bool) -> DataFrame:
    shared = _ranks(rows.sparkSession, path)
    names = [key, "ids"] + ["decoded"] * decoded

    def run(batches):
        codec = _codec(path, shared)
        for batch in batches:
            for part in _slices(batch, pc.binary_length(batch.column(1)).to_pylist()):
                encoded = codec.encode(part.column(1).to_pylist())
                out = [part.column(0), _lists(encoded)]
                if decoded:
                    out.append(pa.array([codec.decode(x) for x in encoded], pa.binary()))
                yield pa.record_batch(out, names=names)

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"`{key}` {kind}", "ids array<int>"] + ["decoded binary"] * decoded))


def op4(docs: DataFrame, path: str | None = None) -> DataFrame:
    both = round_trip(docs, path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
