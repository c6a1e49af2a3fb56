"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over neighbouring words; it hashes the words at its places and ignores those between, so that a
substituted word there doesn't lose the hit. The seeds of the test items are joined with those of all documents; hits of
one document, item and distance are one candidate, whose aligned words are compared: a leak is a stretch of `span`
words (or of the whole item, if it is shorter) of which at least `percent` % are equal.

SEEDS are all masks of four among five neighbouring words, and four in a row. Together they find every stretch of 80 %:
its equal words lie in runs between the others, and either some run has four words, or some run of one to three and
the next one, one word apart, fill a mask (by cases of 4 to 20 words). Items of under four words are matched whole.

Document seeds are first looked up in a bitmap of the item seeds, of MOST_BITS bits at most, so that only those that
can match are shuffled; the join then decides. Nothing else of the items or documents goes through the driver.

Defined results: a null or empty text, of a document or an item, leaks nothing; words are cut at ASCII white space with
A-Z in lower case; repeated rows of one key share their result; rows with a null key are clean; an empty table gives an
empty result, and documents against no items are all clean; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, text_column
from .shingles import spans_hashes, word_hashes

SEEDS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))
SHORT = tuple(tuple(range(n)) for n in (1, 2, 3))
#: The bitmap has about 256 bits for each item seed, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 24, 1 << 27
SPAN, PERCENT = 20, 80
#: Tasks over which the hits of one seed are spread, and alignments of a document that are compared at a time.
SALTS, WANTED = 8, 512


def item_seeds(items: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """item, n (words), words (hashes), seeds: (h, pos) of each seed of the item."""
    pair = pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32())]))

    def run(batches):
        for batch in batches:
            words = [word_hashes(t) for t in batch.column(1).to_pylist()]
            seeds = []
            for w in words:
                masks = SEEDS if len(w) >= 4 else SHORT[len(w) - 1 : len(w)] if len(w) else ()
                seeds.append([{"h": h, "pos": i} for x in spans_hashes(w, masks) for i, h in enumerate(x.view(np.int64).tolist())])
            columns = [batch.column(0), pa.array([len(w) for w in words], pa.int32()), pa.array([w.view(np.int64) for w in words], pa.list_(pa.int64())), pa.array(seeds, pair)]
            yield pa.record_batch(columns, names=["item", "n", "words", "seeds"])

    kind = items.schema[key].dataType.simpleString()
    return items.where(F.col(key).isNotNull()).select(F.col(key).alias("item"), text_column(text).alias("text")).mapInArrow(
        run, f"item {kind}, n int, words array<long>, seeds array<struct<h:long,pos:int>>"
    )


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """The bits of all hashes; each partition sends its bitmap, and these are ORed one after the other."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (256 * hashes.count()).bit_length()))

    def run(batches):
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(size - 1)
            np.bitwise_or.at(bits, (h >> np.uint64(3)).astype(np.int64), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8))
        if bits.any():
            yield pa.record_batch([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(size // 8, np.uint8)
    for row in hashes.mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(row.bits, np.uint8)
    return out


def leaks(docs: DataFrame, items: DataFrame, span: int = SPAN, percent: int = PERCENT, text: str = "text", key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """key, item, first_word, last_word, n_equal of each leak; one row for each document, item and alignment."""
    known = checkpointed(item_seeds(items, text, item_key))
    seeds = known.select("item", "n", F.inline("seeds"))
    masks = SEEDS + tuple(SHORT[r.n - 1] for r in known.where("n between 1 and 3").select("n").distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(seeds.select("h")))
    source = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), text_column(text).alias("text"))
    kind, item_kind = source.schema["key"].dataType.simpleString(), known.schema["item"].dataType.simpleString()

    def hits(batches):
        bits = shared.value
        last = np.uint64(8 * len(bits) - 1)
        for batch in batches:
            keys, found, places = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                words = word_hashes(t)
                for x in spans_hashes(words, masks):
                    low = x & last
                    at = np.flatnonzero((bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1)
                    if len(at):
                        keys.append(np.full(len(at), i))
                        found.append(x[at])
                        places.append(at)
            if keys:
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(np.concatenate(keys))), pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(places).astype(np.int32))],
                    names=["key", "h", "at"],
                )

    hit = source.mapInArrow(hits, f"key {kind}, h long, at int")
    # Seeds and items are copied, and hits and alignments dealt, to SALTS tasks: a common phrase or a short item is met often.
    copied = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = lambda df, *by: df.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    aligned = dealt(hit, "key", "at").join(copied(seeds), ["h", "salt"]).select("key", "item", "n", (F.col("at") - F.col("pos")).alias("shift")).distinct()
    # A text goes along once for each WANTED alignments.
    part = F.floor((F.row_number().over(Window.partitionBy("key").orderBy("item", "shift")) - 1) / WANTED).alias("part")
    wanted = aligned.select("*", part).groupBy("key", "part").agg(F.collect_list(F.struct("item", "n", "shift")).alias("wanted"))

    def align(batches):
        for batch in batches:
            rows = []
            for k, t, ws in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = word_hashes(t).view(np.int64)
                for w in ws:
                    lo, hi = max(0, w["shift"]), min(len(words), w["shift"] + w["n"])
                    rows.append((k, w["item"], w["shift"], lo, words[lo:hi]))
            kinds = [batch.schema.field(0).type, batch.schema.field(2).type.value_type.field(0).type, pa.int32(), pa.int32(), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["key", "item", "shift", "lo", "part"])

    parts = source.join(wanted, "key").select("key", "text", "wanted")
    pieces = parts.mapInArrow(align, f"key {kind}, item {item_kind}, shift int, lo int, part array<long>")
    sliced = dealt(pieces, "key", "shift").join(copied(known.select("item", "n", "words")), ["item", "salt"])
    # Places of the item that the document doesn't reach count as unequal, so a stretch may lie anywhere in the item.
    compared = sliced.select("key", "item", "shift", "lo", "n", F.zip_with("part", F.slice("words", F.col("lo") - F.col("shift") + 1, F.size("part")), lambda a, b: a == b).alias("equal"))

    def verify(batches):
        for batch in batches:
            rows = []
            for k, item, lo, n, equal in zip(*(batch.column(i).to_pylist() for i in range(5))):
                width = min(n, span)
                if len(equal) < width:
                    continue
                e = np.array(equal, np.int64)
                sums = np.concatenate([[0], np.cumsum(e)])
                good = np.flatnonzero(100 * (sums[width:] - sums[:-width]) >= percent * width)
                if len(good):
                    a, b = int(good[0]), int(good[-1]) + width
                    rows.append((k, item, lo + a, lo + b - 1, int(sums[b] - sums[a])))
            kinds = [batch.schema.field(0).type, batch.schema.field(1).type, pa.int32(), pa.int32(), pa.int32()]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["key", "item", "first_word", "last_word", "n_equal"])

    checked = compared.select("key", "item", "lo", "n", "equal").mapInArrow(verify, f"key {kind}, item {item_kind}, first_word int, last_word int, n_equal int")
    return checked.select(F.col("key").alias(key), F.col("item").alias(item_key), "first_word", "last_word", "n_equal")


def drop_leaking(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """The rows of `docs` in which no item leaks."""
    return docs.join(leaks(docs, items, text=text, key=key, item_key=item_key).select(key).distinct(), key, "left_anti").select(docs.columns)


def op5(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = leaks(docs, items).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max(F.col("last_word") - F.col("first_word") + 1).alias("longest"))
    return docs.select("doc_id").join(found, "doc_id", "left").select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join(F.col("items").cast("array<string>"), ","), F.lit("")).alias("items"),
        F.coalesce("longest", F.lit(0)).cast("long").alias("longest_leak"),
    )


#: The same in SQL: every alignment that enough equal words share is tried at every place.
SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
dw AS (SELECT doc_id, len(w) AS nd, unnest(range(len(w))) AS place, unnest(w) AS word FROM d),
bw AS (SELECT item_id, len(w) AS n, least(len(w), 20) AS width, unnest(range(len(w))) AS pos, unnest(w) AS word FROM b),
hit AS (SELECT doc_id, item_id, nd, n, width, place - pos AS shift, pos FROM dw JOIN bw USING (word)),
good AS (SELECT doc_id, item_id, shift, min(width) AS width, greatest(0, -shift) AS lo, least(min(n), min(nd) - shift) AS hi, list(pos) AS places FROM hit GROUP BY doc_id, item_id, shift HAVING 100 * count(*) >= 80 * min(width)),
start AS (SELECT *, unnest(range(lo, hi - width + 1)) AS j FROM good),
leak AS (SELECT doc_id, item_id, max(j) + min(width) - min(j) AS size FROM start WHERE 100 * len(list_filter(places, lambda p: p >= j AND p < j + width)) >= 80 * width GROUP BY doc_id, item_id, shift),
per AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_transform(list_sort(list(DISTINCT item_id)), lambda x: CAST(x AS VARCHAR)), ',') AS items, max(size) AS longest FROM leak GROUP BY doc_id)
SELECT doc_id, n_items IS NOT NULL AS contaminated, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items, '') AS items, CAST(coalesce(longest, 0) AS BIGINT) AS longest_leak FROM documents LEFT JOIN per USING (doc_id)
"""


def brute_force(text: str | None, items: dict[int, str | None], span: int = SPAN, percent: int = PERCENT) -> list[int]:
    """The items that leak into the text, by trying all alignments; for tests."""
    words, found = word_hashes(text or ""), []
    for item, t in items.items():
        test = word_hashes(t or "")
        width = min(len(test), span)
        if not width or len(words) < width:
            continue
        at, pos = np.nonzero(words[:, None] == test[None, :])
        for shift in np.unique(at - pos):
            equal = np.zeros(len(test), np.int64)
            equal[pos[at - pos == shift]] = 1
            sums = np.concatenate([[0], np.cumsum(equal)])
            # Windows that lie within both.
            lo, hi = max(0, -int(shift)), min(len(test), len(words) - int(shift))
            if any(100 * (sums[j + width] - sums[j]) >= percent * width for j in range(lo, hi - width + 1)):
                found.append(item)
                break
    return sorted(found)
