"""Near-duplicate documents by min-max hashing.

A sketch evaluates PERMUTATIONS random permutations of the shingle hashes and keeps both the smallest and the largest
value under each, so that 2 * PERMUTATIONS signature values cost half as many hash evaluations. Bands of ROWS values
are the bucket keys. At the threshold of 0.85 a pair shares none of the 40 bands of 7 values with probability 2e-7, and
every pair that is linked is confirmed on the full shingle sets.

Equal sets are one class, so copies never meet in pairs. Within a bucket each class is first compared with the smallest
one only. Components of these links then leave the buckets that hold several components; their members are paired by
the rarest of their shingles (see `_rest`). No group is collected, and all pairs of a group are never made: a pair within
one component needs no comparison, since it changes no component.

Defined results: a null or empty text, or one without words, has no shingles and is linked with nothing; a null key is
linked with nothing and has a null component; rows of one key keep their own sets, are linked by each of their texts, and
share a component; an empty table gives an empty result; columns beside key and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, text_column
from .shingles import mix, shingle_set

ROWS, BANDS = 7, 40
PERMUTATIONS = ROWS * BANDS // 2
#: Shingles that are hashed at a time.
BLOCK = 1 << 15
#: Tasks over which the members that have one shingle are spread, at least, and members of one shingle in a task, about.
SALTS, MEMBERS = 8, 512


def _multipliers() -> np.ndarray:
    """Odd multipliers: each is a permutation of the 64-bit integers."""
    return mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Row i: the minima and then the maxima of the non-empty set i."""
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint64)
    multipliers = _multipliers()
    i = 0
    while i < len(sets):
        j, size = i + 1, len(sets[i])
        while j < len(sets) and size + len(sets[j]) <= BLOCK:
            size += len(sets[j])
            j += 1
        x = np.concatenate(sets[i:j])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[i : j - 1]])]).astype(np.int64)
        y = np.empty_like(x)
        for k, m in enumerate(multipliers):
            np.multiply(x, m, out=y)
            out[i:j, k] = np.minimum.reduceat(y, starts)
            out[i:j, PERMUTATIONS + k] = np.maximum.reduceat(y, starts)
        i = j
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; a band's values are spread over the signature, minima and maxima alike."""
    values = signature.reshape(len(signature), ROWS, BANDS)
    keys = np.repeat(np.arange(BANDS, dtype=np.uint64)[None, :], len(signature), 0)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, r, :])
    return keys.view(np.int64)


def set_name(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits, less two, that stand for a set."""
    h = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return h >> 65, h & (1 << 63) - 1


def sketch(docs: DataFrame, size: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles, set_a and set_b (128 bits that stand for the set, null without shingles), bands."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t, size) for t in part.column(1).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                names: list = [(None, None)] * len(sets)
                if full:
                    for i, row in zip(full, band_keys(signatures([sets[i] for i in full]))):
                        bands[i], names[i] = row, set_name(sets[i])
                columns = [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([n[0] for n in names], pa.int64()),
                    pa.array([n[1] for n in names], pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())),
                ]
                yield pa.record_batch(columns, names=["id", "n_shingles", "set_a", "set_b", "bands"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), text_column(text).alias("text")).mapInArrow(
        run, f"id {kind}, n_shingles long, set_a long, set_b long, bands array<long>"
    )


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The (a, b) of `pairs` whose full sets have 100 * intersection >= percent * union; `texts` is id, text. Where an id has
    several texts, any of them counts."""
    at_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = at_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches):
        last_text, last = None, None
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if ta != last_text:
                    last_text, last = ta, shingle_set(ta, size)
                other = shingle_set(tb, size)
                common = len(np.intersect1d(last, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(last) + len(other) - common) > 0)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for each node of `edges` (a, b); roots are included.

    Large stars and small stars in turn: each round hangs every node under the smallest neighbour known to it, so that
    the number of rounds grows with the logarithm of the longest chain. Only minima are grouped, never neighbourhoods.
    """
    stars = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        if (now := _fingerprint(stars)) == state or now[0] == 0:
            break
        state = now
        both = stars.select("u", "v").unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        stars = checkpointed(small.select("e.u", "e.v").where("u <> v").distinct())
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(stars.select(F.col("v"), F.col("v")).distinct())


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _fits(percent: int) -> Column:
    """Sets of these sizes can reach the similarity at all."""
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def _ordered(x: str, y: str) -> Column:
    first = F.col(x) < F.col(y)
    return F.struct(F.when(first, F.col(x)).otherwise(F.col(y)).alias("a"), F.when(first, F.col(y)).otherwise(F.col(x)).alias("b"))


def classes(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """id, n_shingles, component_id of each row of `docs`: components of the links of at least percent % similarity."""
    sketches = checkpointed(sketch(docs, size, text, key))
    linked = sketches.where(F.col("set_a").isNotNull() & F.col("id").isNotNull())
    sets = linked.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.min(F.struct("id", "bands"))["bands"].alias("bands"), F.min("n_shingles").alias("n"))
    members = sets.select("rep", F.col("set_a").alias("set"), "n", F.explode("bands").alias("band"))
    leaders = members.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1").select("band", "lead")
    shared = checkpointed(members.join(leaders, "band"))
    stars = shared.select(F.col("lead.rep").alias("a"), F.col("lead.n").alias("n_a"), F.col("rep").alias("b"), F.col("n").alias("n_b")).where("a <> b").where(_fits(percent)).select("a", "b").distinct()
    stars = checkpointed(stars)
    if stars.isEmpty():
        roots = None
    else:
        wanted = shared.select(F.col("rep").alias("id")).distinct()
        texts = checkpointed(docs.select(F.col(key).alias("id"), text_column(text).alias("text")).join(wanted, "id", "left_semi").withColumn("version", F.xxhash64("text")).dropDuplicates(["id", "version"]).drop("version"))
        links = checkpointed(confirm(stars, texts, size, percent))
        roots = components(links)
        rest = checkpointed(_rest(shared, roots, stars, texts, size, percent))
        if not rest.isEmpty():
            more = confirm(rest, texts, size, percent)
            roots = components(links.unionAll(more))
    whole = sketches.select("id", "n_shingles", "set_a", "set_b").join(sets.select("set_a", "set_b", "rep"), ["set_a", "set_b"], "left")
    if roots is None:
        named = whole.withColumn("root", F.lit(None).cast(whole.schema["id"].dataType))
    else:
        named = whole.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    return named.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("root", "rep", "id")).alias("component_id"))


def _tokens(texts: DataFrame, size: int) -> DataFrame:
    """rep, set, h: a row for each shingle of `texts` (id, text)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t, size) for t in part.column(1).to_pylist()]
                owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                if len(owner):
                    names = np.array([set_name(s)[0] for s in sets], np.int64)
                    yield pa.record_batch([part.column(0).take(pa.array(owner)), pa.array(names[owner]), pa.array(np.concatenate(sets).view(np.int64))], names=["rep", "set", "h"])

    return texts.mapInArrow(run, f"rep {texts.schema['id'].dataType.simpleString()}, set long, h long")


def _rest(shared: DataFrame, roots: DataFrame, tried: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs still to be compared: of different components, and able to reach the similarity.

    Only members of buckets that hold several components are left. Shingles are ordered by rarity, here the number of
    members left that have one. Of two sets that reach the similarity t, the smaller one's first n - ceil(2 t n / (1 + t))
    + 1 shingles and the larger one's first n - ceil(t n) + 1 have one in common, and from the first such on both have
    enough left for the overlap. So members that differ from all others in too many shingles of their own, as those
    that share but a common passage, make no pairs. Of the members that meet in a shingle, those outside the largest
    component are paired with the others.
    """
    at = shared.select("band", "rep", "set", "n").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", "set", "n", F.coalesce("root", "rep").alias("root"))
    mixed = at.groupBy("band").agg((F.min("root") < F.max("root")).alias("mixed")).where("mixed").select("band")
    left = checkpointed(at.join(mixed, "band").select("rep", "set", "n", "root").distinct())
    tokens = _tokens(texts.join(left.select(F.col("rep").alias("id")).distinct(), "id").select("id", "text"), size)
    counts = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    known = tokens.join(counts, "h").join(left, ["rep", "set"])
    of = Window.partitionBy("rep", "set")
    single = F.col("n") - F.count(F.lit(1)).over(of)  # shingles that no other member has are the rarest
    placed = known.withColumn("single", single).withColumn("place", F.col("single") + F.row_number().over(of.orderBy("df", "h")))
    n, both = F.col("n"), 100 + percent
    probe = n - F.floor((percent * n + 99) / 100) + 1
    index = n - F.floor((2 * percent * n + both - 1) / both) + 1
    rare = checkpointed(placed.where(F.col("place") <= probe).select("h", "rep", "set", "n", "root", "place", (F.col("place") <= index).alias("index")))
    sizes = rare.groupBy("h", "root").agg(F.count(F.lit(1)).alias("size"))
    # Members of one shingle are dealt to as many tasks as they need; what they are joined with is copied to each.
    split = sizes.groupBy("h").agg(F.max(F.struct("size", "root"))["root"].alias("most"), F.count(F.lit(1)).alias("roots"), (F.sum("size") / MEMBERS + 1).cast("int").alias("parts")).where("roots > 1")
    copies = split.select("h", "most", "parts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rare.withColumn("salt", F.pmod(F.xxhash64("rep", "set"), F.lit(SALTS)).cast("int"))
    here = salted.join(copies, ["h", "salt"]).withColumn("few", F.col("root") != F.col("most"))
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    smaller = here.where("index").select("h", part, F.col("rep").alias("x"), F.col("n").alias("n_a"), F.col("root").alias("root_x"), F.col("place").alias("place_x"), F.col("few").alias("few_x"))
    larger = here.select("h", F.pmod(F.xxhash64("set", "rep"), F.col("parts")).cast("int").alias("part"), F.col("rep").alias("y"), F.col("n").alias("n_b"), F.col("root").alias("root_y"), F.col("place").alias("place_y"), F.col("few").alias("few_y"))
    able = (
        (F.col("root_x") != F.col("root_y"))
        & (F.struct("n_a", F.col("x").alias("id")) < F.struct(F.col("n_b").alias("n_a"), F.col("y").alias("id")))
        & (100 * F.col("n_a") >= percent * F.col("n_b"))
        & (both * (1 + F.least(F.col("n_a") - F.col("place_x"), F.col("n_b") - F.col("place_y"))) >= percent * (F.col("n_a") + F.col("n_b")))
    )
    met = smaller.where("few_x").join(larger, ["h", "part"]).where(able).unionByName(smaller.where("NOT few_x").join(larger.where("few_y"), ["h", "part"]).where(able))
    pairs = met.select(_ordered("x", "y").alias("p")).select("p.a", "p.b").distinct()
    return pairs.join(tried.select(_ordered("a", "b").alias("p")).select("p.a", "p.b"), ["a", "b"], "left_anti")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of `docs` without those that a document of smaller key of their component stands for."""
    dropped = classes(docs, size, percent, text, key).where("id <> component_id").select(F.col("id").alias(key)).distinct()
    return docs.join(dropped, key, "left_anti").select(docs.columns)


def op3(docs: DataFrame) -> DataFrame:
    found = classes(docs, size=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


#: The same by brute force in SQL: every pair that shares a shingle is counted.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(g) AS g FROM (
    SELECT doc_id, unnest(list_transform(list_zip(w[:len(w) - 2], w[2:len(w) - 1], w[3:]), lambda z: z[1] || ' ' || z[2] || ' ' || z[3])) AS g FROM w WHERE len(w) >= 3
    UNION ALL SELECT doc_id, array_to_string(w, ' ') AS g FROM w WHERE len(w) BETWEEN 1 AND 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT a AS node, b AS other FROM link UNION SELECT r.node, link.b FROM reach r JOIN link ON link.a = r.other),
low AS (SELECT node, min(other) AS other FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(low.other, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(low.other, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.node = d.doc_id
"""
