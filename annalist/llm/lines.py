"""Line dedup by a suffix array over sequences of line ids (DataFrame functions only).

The lines that hold a word are numbered through each document, and a suffix is what starts at such a line. Distributed
prefix doubling ranks the suffixes: first by their line, then by the pair of the ranks at the suffix and a growing offset
further on. A rank names the interval of suffixes that share so long a prefix by its first position (smallest document,
then line), so ranks need no global sort; a suffix that is alone in its interval leaves, and doubling goes on until none
is left. Every suffix but an interval's first is a later copy of the first; that of the deepest such interval is its
source. The longest common prefix of suffix and source is then found by descending through the ranks of all levels.
A copy that continues that of the suffix before it, from the same source, is part of it; the others are the maximal
repeated runs. Those of `min_lines` lines or more are deleted, with the blank lines inside of them. With `alone_words`, a
line of at least so many words is a run by itself: its later copies are deleted too, whatever stands around them.

Defined results: a null text counts as empty and stays as it is; a document with fewer lines than `min_lines` keeps all
but its later copies of long lines; words are cut at ASCII white space; overlapping copies count; rows of one key and one
text are one document; other texts under that key are documents of their own, in the order of a hash of the text; rows
with a null key are kept unchanged and are nobody's source; an empty table gives an empty result; other columns are kept,
but for `n_runs`, `n_cut`, `n_maximal` and `longest`, of which the result has its own.
Each rank is found by an aggregation that combines before the shuffle and is joined back as one row for each distinct
run and salt, so that a line that a third of all documents share is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, has_word, text_column

SALTS = 8
_SPACE, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: What tells a document from others, and a suffix from others.
DOC = ("key", "part")
POSITION = (*DOC, "seq")


def _part(text: str) -> Column:
    return F.xxhash64(F.lit(7), text_column(text)).alias("part")


def line_ids(docs: DataFrame, text: str = "text", key: str = "doc_id", alone_words: int | None = None) -> DataFrame:
    """key, part, seq (place among the lines that hold a word), two 64-bit hashes of the line, and whether it has
    `alone_words` words."""
    lines = F.filter(F.split(text_column(text), "\n"), has_word)
    many = F.lit(False) if alone_words is None else F.col("x").rlike(rf"^{_SPACE}*+(?:{_WORD}++{_SPACE}++){{{alone_words - 1}}}{_WORD}")
    return (
        docs.where(F.col(key).isNotNull())
        .select(F.col(key).alias("key"), _part(text), F.posexplode(lines).alias("seq", "x"))
        .select(*POSITION, F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(1), "x").alias("h2"), many.alias("alone"))
    )


def _ranked(rows: DataFrame, names: list[str], *others: str) -> DataFrame:
    """`rank` (the first position that has these names) for the rows whose names occur at several positions."""
    at = F.struct(*POSITION)
    interval = rows.groupBy(*names).agg(F.min(at).alias("rank"), F.max(at).alias("end"))
    # The positions of one very common run are dealt to SALTS tasks; each finds a copy of the run's one row there.
    copies = interval.where("rank <> end").select(*names, "rank", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*POSITION), F.lit(SALTS)).cast("int"))
    return salted.join(copies, [*names, "salt"]).select(*POSITION, "rank", *others)


def _later() -> Column:
    """Whether a suffix isn't the first of its interval."""
    return F.col("rank") != F.struct(*POSITION)


def suffix_levels(ids: DataFrame, min_lines: int) -> list[tuple[int, DataFrame]]:
    """(length, ranks) of each level: the suffixes whose first `length` lines occur elsewhere too. Lengths double, but for
    a step to `min_lines` itself, until every suffix is alone in its interval; one checkpoint a level."""
    length, levels = 1, [(1, checkpointed(_ranked(ids, ["h1", "h2"], "alone")))]
    while length < min_lines or not levels[-1][1].isEmpty():
        gap = min(length, min_lines - length) if length < min_lines else length
        ahead = Window.partitionBy(*DOC).orderBy("seq").rangeBetween(gap, gap)
        pairs = levels[-1][1].select(*POSITION, F.col("rank").alias("here"), F.first("rank").over(ahead).alias("ahead")).where(F.col("ahead").isNotNull())
        length += gap
        levels.append((length, checkpointed(_ranked(pairs, ["here", "ahead"]))))
    return levels


def repeated_runs(ids: DataFrame, min_lines: int = 2) -> DataFrame:
    """key, part, seq, n (lines), source: the maximal runs of `min_lines` lines or more that are later copies, and whether
    each is but a single long line."""
    levels = suffix_levels(ids, min_lines)
    deep = [(n, ranks) for n, ranks in levels if n >= min_lines]
    copies = deep[0][1].where(_later()).select(*POSITION, F.struct(F.lit(deep[0][0]).alias("n"), "rank").alias("top"))
    for n, ranks in deep[1:-1]:
        copies = copies.unionAll(ranks.where(_later()).select(*POSITION, F.struct(F.lit(n).alias("n"), "rank")))
    deepest = copies.groupBy(*POSITION).agg(F.max("top").alias("top")).select(*POSITION, "top.n", F.col("top.rank").alias("source"))
    before = Window.partitionBy(*DOC).orderBy("seq").rangeBetween(-1, -1)
    s = F.col("source")
    continued = F.first("source").over(before) == F.struct(s["key"].alias("key"), s["part"].alias("part"), (s["seq"] - 1).alias("seq"))
    runs = deepest.withColumn("continued", F.coalesce(continued, F.lit(False))).where("NOT continued").drop("continued")
    # The common prefix is shorter than twice the length of the deepest interval, so each level adds its length at most once.
    for length, ranks in reversed(levels[:-2]):
        mine = ranks.select(*DOC, F.col("seq").alias("end"), F.col("rank").alias("mine"))
        theirs = ranks.select(F.struct(*POSITION).alias("source_end"), F.col("rank").alias("theirs"))
        s, n = F.col("source"), F.col("n")
        ends = runs.withColumn("end", F.col("seq") + n).withColumn("source_end", F.struct(s["key"].alias("key"), s["part"].alias("part"), (s["seq"] + n).alias("seq")))
        both = ends.join(mine, [*DOC, "end"], "left").join(theirs, "source_end", "left")
        runs = checkpointed(both.select(*POSITION, "source", F.when((n > length) & (F.col("mine") == F.col("theirs")), n + length).otherwise(n).alias("n")))
    found = runs.select(*POSITION, "n", "source", F.lit(False).alias("alone"))
    return found.unionByName(levels[0][1].where(F.col("alone") & _later()).select(*POSITION, F.lit(1).alias("n"), F.col("rank").alias("source"), "alone"))


def dedup_lines(docs: DataFrame, min_lines: int = 2, text: str = "text", key: str = "doc_id", alone_words: int | None = None) -> DataFrame:
    """The rows of `docs` with later copies of repeated runs cut from the text, and `n_runs` (pieces cut), `n_cut` (lines
    cut), `n_maximal` (maximal repeated runs, which may overlap) and `longest` (lines of the longest of these)."""
    runs = repeated_runs(checkpointed(line_ids(docs, text, key, alone_words)), min_lines)
    # A piece ends where no run so far reaches the next one.
    order = Window.partitionBy(*DOC).orderBy("seq", "n")
    reach = F.max(F.col("seq") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    piece = F.sum(F.when(F.col("seq") <= F.col("reach"), 0).otherwise(1)).over(order)
    pieces = (
        runs.withColumn("reach", reach)
        .withColumn("piece", piece)
        .groupBy(*DOC, "piece")
        .agg(F.min("seq").alias("first"), F.max(F.col("seq") + F.col("n") - 1).alias("last"), F.count_if(~F.col("alone")).alias("maximal"), F.max(F.when(F.col("alone"), 0).otherwise(F.col("n"))).alias("longest"))
    )
    # At most as many pieces as the document has lines.
    by_doc = pieces.groupBy(*DOC).agg(
        F.sort_array(F.collect_list(F.struct("first", "last"))).alias("pieces"),
        F.count(F.lit(1)).alias("n_runs"),
        F.sum(F.col("last") - F.col("first") + 1).alias("n_cut"),
        F.sum("maximal").alias("n_maximal"),
        F.max("longest").alias("longest"),
    )
    # The row goes along as one column, so that its columns may have any names.
    row = docs.select(F.col(key).alias("key"), _part(text), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    both = row.join(by_doc, list(DOC), "left").withColumn("lines", F.when(F.col("pieces").isNotNull(), F.split(F.col("row")[text], "\n")))
    lines = F.col("lines")
    # Places among the lines that hold a word become places among all.
    worded = F.filter(F.transform(lines, lambda x, i: F.when(has_word(x), i)), lambda i: i.isNotNull())
    placed = both.withColumn("worded", worded).withColumn("runs", F.transform("pieces", lambda p: F.struct(F.get("worded", p["first"]).alias("first"), F.get("worded", p["last"]).alias("last"))))
    runs_ = F.col("runs")
    start = lambda i: F.when(i > 0, F.get(runs_, i - 1)["last"] + 1).otherwise(0)
    gaps = F.transform(runs_, lambda r, i: F.slice(lines, start(i) + 1, r["first"] - start(i)))
    end = F.element_at(runs_, -1)["last"] + 1
    kept = F.array_join(F.concat(F.flatten(gaps), F.slice(lines, end + 1, F.size(lines) - end)), "\n")
    numbers = ("n_runs", "n_cut", "n_maximal", "longest")
    return placed.withColumn("kept", F.when(runs_.isNotNull(), kept).otherwise(F.col("row")[text])).select(
        *(F.col("kept").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c not in numbers),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers),
    )


def op1(docs: DataFrame) -> DataFrame:
    narrow = docs.select("doc_id", "text", F.size(F.filter(F.split(text_column(), "\n"), has_word)).cast("long").alias("n_lines"))
    return dedup_lines(narrow).select("doc_id", "n_lines", "n_runs", "n_cut", "n_maximal", "longest", F.sha2(text_column(), 256).alias("kept_sha256"))


#: The same in SQL.
SQL = r"""
WITH a AS (
  SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS x FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
s AS (
  SELECT doc_id, line, x, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS seq FROM a WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
p AS (SELECT *, lead(x) OVER (PARTITION BY doc_id ORDER BY seq) AS y FROM s),
q AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY doc_id, seq) AS k FROM p WHERE y IS NOT NULL),
c AS (SELECT doc_id, seq FROM q WHERE k > 1 UNION SELECT doc_id, seq + 1 FROM q WHERE k > 1),
i AS (SELECT c.doc_id, c.seq, s.line, c.seq - row_number() OVER (PARTITION BY c.doc_id ORDER BY c.seq) AS island
      FROM c JOIN s ON s.doc_id = c.doc_id AND s.seq = c.seq),
r AS (SELECT doc_id, island, min(line) AS first, max(line) AS last, count(*) AS n FROM i GROUP BY doc_id, island),
kept AS (
  SELECT a.doc_id, string_agg(a.x, chr(10) ORDER BY a.line) AS t FROM a
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = a.doc_id AND a.line BETWEEN r.first AND r.last) GROUP BY a.doc_id),
-- Of each line, the deepest of 2, 4, 8 ... lines that also start at an earlier line, and the first line where they do.
l AS (SELECT doc_id, list(x ORDER BY seq) AS xs FROM s GROUP BY doc_id),
t AS (SELECT doc_id, seq, w, first_value({'d': doc_id, 's': seq}) OVER (PARTITION BY w, h ORDER BY doc_id, seq) AS source
      FROM (SELECT s.doc_id, s.seq, w, md5(array_to_string(xs[s.seq + 1:s.seq + w], chr(10))) AS h
            FROM s JOIN l USING (doc_id), (SELECT 2 ** CAST(unnest(range(1, 16)) AS INT) AS w) WHERE s.seq + w <= len(xs))),
u AS (SELECT doc_id, seq, max_by(source, w) AS source FROM t WHERE source.d <> doc_id OR source.s <> seq GROUP BY doc_id, seq),
v AS (SELECT *, lag(source) OVER (PARTITION BY doc_id ORDER BY seq) AS other, lag(seq) OVER (PARTITION BY doc_id ORDER BY seq) AS before FROM u),
m AS (SELECT v.doc_id, a.xs[v.seq + 1:] AS mine, b.xs[v.source.s + 1:] AS theirs FROM v JOIN l a ON a.doc_id = v.doc_id JOIN l b ON b.doc_id = v.source.d
      WHERE coalesce(before <> v.seq - 1 OR other.d <> v.source.d OR other.s <> v.source.s - 1, true)),
o AS (SELECT doc_id, count(*) AS n_maximal, max(coalesce(list_position(list_transform(range(1, greatest(len(mine), len(theirs)) + 2), lambda i: coalesce(mine[i] = theirs[i], false)), false), 1) - 1) AS longest FROM m GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM s GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_runs, sum(n) AS n_cut FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs,
       CAST(coalesce(n_cut, 0) AS BIGINT) AS n_cut, CAST(coalesce(n_maximal, 0) AS BIGINT) AS n_maximal, CAST(coalesce(longest, 0) AS BIGINT) AS longest, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN o USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
