"""Tree diffs, line diffs, hunks, patches and line attribution.

Only the shortest edit script of one pair of texts is Python, in an Arrow function over batches of pairs, with its hunks
and counts where whole scripts aren't wanted; everything around it (which files changed, hunks of given scripts, patch
texts) is columns, joins and windows.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.history import is_binary

#: The host's bounds, beyond which it reports a pair of files as too large.
MAX_LINES, MAX_PRODUCT, MAX_EDITS, TRACE = 40_000, 4_000_000, 2000, 8_000_000
OPS = "array<struct<tag:string,line:string>>"
HUNKS = "array<struct<hunk:long,a_start:long,a_len:long,b_start:long,b_len:long,body:string>>"
SIGNS = {"eq": " ", "add": "+", "del": "-"}
#: Lines of scripts that a worker holds before it hands them on.
HELD = 20_000
#: Of a pair's table: bits that are held at once, lines of a block at least, parts in which a stretch of blocks is made again.
HELD_BITS, BLOCK, PARTS = 1 << 25, 256, 32


def lines(text: str) -> list[str]:
    parts = text.split("\n")
    return parts[:-1] if parts[-1] == "" else parts


def edit_script(old: list[str], new: list[str]) -> list[tuple[str, str]] | None:
    """shortest_script() as the host answers: None beyond its bounds. The operators here have no bounds."""
    n, m = len(old), len(new)
    if not n or not m:
        return shortest_script(old, new)
    if n + m > MAX_LINES or n * m > MAX_PRODUCT:
        return None
    script = shortest_script(old, new)
    return None if sum(tag != "eq" for tag, _ in script) > min(MAX_EDITS, max(1, TRACE // (n + m))) else script


def shortest_script(old: list[str], new: list[str]) -> list[tuple[str, str]]:
    """The greedy shortest edit script as (eq | del | add, line), of files of any length.

    Among scripts of equal length it deletes before it adds, as the furthest reaching paths do: seen from the end, an edit
    comes before an equal line and an addition before a deletion. So between two equal lines all deletions come first.
    """
    script: list[tuple[str, str]] = []
    x = y = 0
    for i, j in chain(_kept(old, new), [(len(old), len(new))]):
        script += [("del", line) for line in old[x:i]]
        script += [("add", line) for line in new[y:j]]
        script += [("eq", line) for line in old[i : i + 1]]
        x, y = i + 1, j + 1
    return script


def _kept(old: list[str], new: list[str]) -> Iterator[tuple[int, int]]:
    """Places, in both files, of the lines that the greedy shortest edit script keeps.

    Lines that one file alone has are left out, as they are edits in any script and move no other choice.
    """
    both = set(old).intersection(new)
    at_old, at_new = ([i for i, line in enumerate(side) if line in both] for side in (old, new))
    a, b = [old[i] for i in at_old], [new[j] for j in at_new]
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    places: dict[str, array] = {}
    for j, line in enumerate(b[head:]):
        places.setdefault(line, array("q")).append(j)
    xs, ys = _common(a[head:], len(b) - head, places)
    yield from zip(at_old[:head], at_new[:head])
    for x, y in zip(reversed(xs), reversed(ys)):
        yield at_old[head + x], at_new[head + y]


def _common(a: list[str], m: int, places: dict[str, array]) -> tuple[array, array]:
    """The places in both of the common subsequence, last first.

    No script of d edits leaves the d diagonals on either side, so that where the shortest one within a band of diagonals has
    no more edits than the band is wide, it is the shortest of all; else the band grows, to the whole table if need be.
    """
    n, found = len(a), (array("q"), array("q"))
    if not n or not m:
        return found
    bound = max(n, m) if n * m <= HELD_BITS else abs(n - m) + BLOCK
    while bound < max(n, m):
        edits = n + m - 2 * _Band(a, m, places, bound).length()
        if edits <= bound:
            break
        bound = min(edits, 4 * bound)
    band = _Band(a, m, places, min(bound, max(n, m)))
    band.back(0, band.blocks, band.first(), m, *found)
    return found


class _Band:
    """Rows of the table of longest common subsequences, for each count of old lines, within `bound` diagonals.

    A row has a bit for each new line, 0 where the subsequence grows with that line. It is one integer and takes a few
    operations on whole integers. Old lines go by blocks, whose rows hold the same stretch of new lines. Of a long table
    only the first rows of some blocks are held, and those between are made again on the way back.
    """

    def __init__(self, a: list[str], m: int, places: dict[str, array], bound: int):
        self.a, self.m, self.places, self.bound = a, m, places, bound
        self.step = max(BLOCK, min(2 * bound, HELD_BITS // min(m, 4 * bound)))
        self.blocks = -(-len(a) // self.step)

    def stretch(self, k: int) -> tuple[int, int]:
        return max(0, k * self.step - self.bound), min(self.m, (k + 1) * self.step + self.bound)

    def first(self) -> int:
        return (1 << self.stretch(0)[1]) - 1

    def rows(self, k: int, row: int) -> Iterator[int]:
        """The rows of block `k` after its first."""
        lo, hi = self.stretch(k)
        block, full = self.a[k * self.step : (k + 1) * self.step], (1 << hi - lo) - 1
        at = {line: _bits(self.places.get(line, ()), lo, hi) for line in set(block)}
        for line in block:
            if met := row & at[line]:
                row = (row + met | row - met) & full
            yield row

    def next(self, k: int, row: int) -> tuple[int, int]:
        """The first row of block `k` + 1 from that of `k`, and how often the subsequence grew in what it leaves out."""
        for row in self.rows(k, row):  # noqa: B020
            pass
        (lo, hi), (low, high) = self.stretch(k), self.stretch(k + 1)
        left = row & (1 << low - lo) - 1
        return row >> low - lo | (1 << high - low) - (1 << hi - low), low - lo - left.bit_count()

    def length(self) -> int:
        row, grown = self.first(), 0
        for k in range(self.blocks - 1):
            row, more = self.next(k, row)
            grown += more
        lo, hi = self.stretch(self.blocks - 1)
        for row in self.rows(self.blocks - 1, row):  # noqa: B020
            pass
        return grown + hi - lo - row.bit_count()

    def back(self, k: int, end: int, row: int, y: int, xs: array, ys: array) -> int:
        """Follows the script from new line `y` at the end of block `end` - 1 to the first row of block `k`, which is `row`."""
        if end - k > 1:
            size = -(-(end - k) // PARTS)
            parts = [(k, row)]
            while parts[-1][0] + size < end:
                at, row = parts[-1]
                for i in range(at, at + size):
                    row, _ = self.next(i, row)
                parts.append((at + size, row))
            while parts and y:
                at, row = parts.pop()
                y = self.back(at, min(at + size, end), row, y, xs, ys)
            return y
        lo, _ = self.stretch(k)
        rows = [row, *self.rows(k, row)]
        x = len(rows) - 1
        while x and y:
            below = (1 << y - lo) - 1
            y = lo + (below ^ rows[x] & below).bit_length()
            while x and y and not rows[x - 1] >> y - lo - 1 & 1:
                x -= 1
            if x and y:
                x, y = x - 1, y - 1
                xs.append(k * self.step + x)
                ys.append(y)
        return y


def _bits(places: array, lo: int, hi: int) -> int:
    """A bit for each of the places from `lo` to before `hi`."""
    here = places[bisect_left(places, lo) : bisect_left(places, hi)]
    if len(here) > 16:
        flags = np.zeros(hi - lo, np.uint8)
        flags[np.frombuffer(here, np.int64) - lo] = 1
        return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
    found = 0
    for j in here:
        found |= 1 << j - lo
    return found


def script_hunks(script: list[tuple[str, str]], context: int = 3) -> list[tuple[int, int, int, int, int, str]]:
    """(hunk, a_start, a_len, b_start, b_len, body) of each hunk of one script, as hunks() has them."""
    islands: list[list[int]] = []
    for i, (tag, _) in enumerate(script):
        if tag != "eq":
            if islands and i - islands[-1][1] <= 2 * context:
                islands[-1][1] = i
            else:
                islands.append([i, i])
    found, at, a, b = [], 0, 1, 1
    for k, (first, last) in enumerate(islands, 1):
        start, end = max(0, first - context), min(len(script), last + 1 + context)
        a, b = a + start - at, b + start - at  # only equal lines are between two hunks
        body = script[start:end]
        n, m = sum(tag != "add" for tag, _ in body), sum(tag != "del" for tag, _ in body)
        found.append((k, a - (not n), n, b - (not m), m, "\n".join(SIGNS[tag] + line for tag, line in body)))
        at, a, b = end, a + n, b + m
    return found


def tree_diff(old: DataFrame, new: DataFrame, limit: int | None = None) -> DataFrame:
    """path, old_oid, old_mode, new_oid, new_mode of what differs between two flattened trees (path, oid, mode)."""
    a = old.select("path", F.col("oid").alias("old_oid"), F.col("mode").alias("old_mode"))
    b = new.select("path", F.col("oid").alias("new_oid"), F.col("mode").alias("new_mode"))
    same = F.col("old_oid").eqNullSafe(F.col("new_oid")) & F.col("old_mode").eqNullSafe(F.col("new_mode"))
    changed = a.join(b, "path", "full_outer").where(~same)
    return changed if limit is None else changed.orderBy("path").limit(limit)


def _per_pair(pairs: DataFrame, old: str, new: str, name: str, kind: str, of: Callable[[list], pa.Array]) -> DataFrame:
    """`pairs` with `kind` (text, binary) and a column `name`, which `of` makes of some scripts at a time; null where binary."""

    @F.arrow_udf(kind)
    def scripted(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in columns:
            some, held = [], 0
            for x, y in zip(a, b):
                some.append(shortest_script(lines(x.as_py() or ""), lines(y.as_py() or "")))
                held += len(some[-1])
                if held >= HELD:
                    yield of(some)
                    some, held = [], 0
            yield of(some)

    once = scripted.asNondeterministic()  # a filter on the result, as inline() has one, would be pushed down with a second run
    binary = F.coalesce(is_binary(F.col(old)), F.lit(False)) | F.coalesce(is_binary(F.col(new)), F.lit(False))
    scripts = pairs.withColumn("binary_", binary).withColumn(name, once(F.when(~F.col("binary_"), F.col(old)), F.when(~F.col("binary_"), F.col(new))))
    labels = F.when(F.col("binary_"), "binary").otherwise("text")
    return scripts.withColumn("kind", labels).withColumn(name, F.when(F.col("kind") == "text", F.col(name))).drop("binary_")


def _nested(values: list[list[tuple]], fields: dict[str, pa.DataType]) -> pa.Array:
    """A list of structs for each of `values`, built by column."""
    flat = [row for rows in values for row in rows]
    columns = list(zip(*flat)) or [()] * len(fields)
    offsets = list(accumulate((len(rows) for rows in values), initial=0))
    structs = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.values())], list(fields))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)


def diff_lines(pairs: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """`pairs` with `kind` (text, binary) and `ops`; a null side counts as an empty file."""
    return _per_pair(pairs, old, new, "ops", OPS, lambda scripts: _nested(scripts, {"tag": pa.string(), "line": pa.string()}))


def diff_counts(pairs: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """`pairs` with `kind`, `added`, `deleted`: what diffstat() tells of diff_lines(), without the lines leaving Python."""

    def of(scripts: list) -> pa.Array:
        counts = [{f: sum(tag == t for tag, _ in s) for f, t in (("added", "add"), ("deleted", "del"))} for s in scripts]
        return pa.array(counts, pa.struct([("added", pa.int64()), ("deleted", pa.int64())]))

    counted = _per_pair(pairs, old, new, "counts_", "struct<added:long,deleted:long>", of)
    return counted.select(*pairs.columns, "kind", *(F.coalesce(F.col("counts_")[c], F.lit(0).cast("long")).alias(c) for c in ("added", "deleted")))


def diff_hunks(pairs: DataFrame, old: str = "old", new: str = "new", context: int = 3) -> DataFrame:
    """`pairs` with `kind` and `hunks`, an array of what hunks() has as rows: a file's lines are neither sorted nor exchanged."""
    fields = {f: pa.int64() for f in ("hunk", "a_start", "a_len", "b_start", "b_len")} | {"body": pa.string()}
    return _per_pair(pairs, old, new, "hunks", HUNKS, lambda scripts: _nested([script_hunks(s, context) for s in scripts], fields))


def diffstat(diffs: DataFrame, *keys: str) -> DataFrame:
    """keys, added, deleted lines of each diff."""
    count = lambda tag: F.size(F.filter("ops", lambda op: op["tag"] == tag)).cast("long")
    return diffs.select(*keys, "kind", F.coalesce(count("add"), F.lit(0)).alias("added"), F.coalesce(count("del"), F.lit(0)).alias("deleted"))


def op_rows(diffs: DataFrame, *keys: str) -> DataFrame:
    """keys, i, tag, line: a row for each line of each edit script."""
    return diffs.select(*keys, F.posexplode("ops").alias("i", "op")).select(*keys, "i", F.col("op.tag").alias("tag"), F.col("op.line").alias("line"))


def hunks(ops: DataFrame, *keys: str, context: int = 3) -> DataFrame:
    """keys, hunk, a_start, a_len, b_start, b_len, body of each hunk, from rows of keys, i, tag, line.

    Changes at most 2 * context apart are islands of one hunk; a line belongs to the first island that it is close to.
    """
    by = Window.partitionBy(*keys)
    ordered = by.orderBy("i")
    changed = F.col("tag") != "eq"
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    up_to = ordered.rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(changed, F.col("i"))).over(up_to)
    earlier = F.max(F.when(changed, F.col("i"))).over(before)
    next_ = F.min(F.when(changed, F.col("i"))).over(ordered.rowsBetween(0, Window.unboundedFollowing))
    starts = changed & (earlier.isNull() | (F.col("i") - earlier > 2 * context))
    placed = (
        ops.withColumn("a_line", F.coalesce(F.sum(F.when(F.col("tag") != "add", 1).otherwise(0)).over(before), F.lit(0)) + 1)
        .withColumn("b_line", F.coalesce(F.sum(F.when(F.col("tag") != "del", 1).otherwise(0)).over(before), F.lit(0)) + 1)
        .withColumn("last", last)
        .withColumn("next", next_)
        .withColumn("starts", starts.cast("int"))
        .withColumn("island", F.sum("starts").over(up_to))
    )
    # A line close after a change, or between two of one island, stays with it; one close ahead of the next island's first
    # change goes with that one.
    inside = F.col("next") - F.col("last") <= 2 * context
    after = F.col("last").isNotNull() & (F.col("i") - F.col("last") <= context)
    ahead = F.col("next").isNotNull() & (F.col("next") - F.col("i") <= context)
    member = placed.withColumn("hunk", F.when(after | F.coalesce(inside, F.lit(False)), F.col("island")).when(ahead, F.col("island") + 1)).where(F.col("hunk").isNotNull())
    sign = F.when(F.col("tag") == "add", "+").when(F.col("tag") == "del", "-").otherwise(" ")
    grouped = member.groupBy(*keys, "hunk").agg(
        F.min("a_line").alias("a_line"),
        F.sum(F.when(F.col("tag") != "add", 1).otherwise(0)).alias("a_len"),
        F.min("b_line").alias("b_line"),
        F.sum(F.when(F.col("tag") != "del", 1).otherwise(0)).alias("b_len"),
        F.sort_array(F.collect_list(F.struct("i", F.concat(sign, "line").alias("s")))).alias("rows"),
    )
    start = lambda side: F.when(F.col(f"{side}_len") == 0, F.col(f"{side}_line") - 1).otherwise(F.col(f"{side}_line")).alias(f"{side}_start")
    return grouped.select(*keys, "hunk", start("a"), "a_len", start("b"), "b_len", F.array_join(F.transform("rows", lambda r: r["s"]), "\n").alias("body"))


def _hunk_text(h: Column | None = None) -> Column:
    return F.format_string("@@ -%d,%d +%d,%d @@\n%s\n", *(F.col(c) if h is None else h[c] for c in ("a_start", "a_len", "b_start", "b_len", "body")))


def patch(files: DataFrame, hunk_rows: DataFrame, key: str = "path") -> DataFrame:
    """key, patch: unified text; `files` is tree_diff's columns with `kind`, `hunk_rows` is of hunks() by key."""
    bodies = hunk_rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("hunk", _hunk_text().alias("s")))), lambda h: h["s"]), "").alias("hunks"))
    return files.join(bodies, key, "left").select(key, _patch_text(key).alias("patch"))


def patch_whole(files: DataFrame, key: str = "path") -> DataFrame:
    """key, patch: the same from tree_diff's columns with those of diff_hunks(); each file stays within its row."""
    return files.withColumn("hunks", F.array_join(F.transform("hunks", lambda h: _hunk_text(h)), "")).select(key, _patch_text(key).alias("patch"))


def _patch_text(key: str) -> Column:
    mode = lambda c: F.lpad(c, 6, "0")
    short = lambda c: F.coalesce(F.substring(F.col(c).cast("string"), 1, 7), F.lit("0000000"))
    added, deleted = F.col("old_oid").isNull(), F.col("new_oid").isNull()
    same_mode = F.col("old_mode") == F.col("new_mode")
    head = F.concat(
        F.format_string("diff --git a/%s b/%s\n", F.col(key), F.col(key)),
        F.when(added, F.concat(F.lit("new file mode "), mode("new_mode"), F.lit("\n")))
        .when(deleted, F.concat(F.lit("deleted file mode "), mode("old_mode"), F.lit("\n")))
        .when(~same_mode, F.concat(F.lit("old mode "), mode("old_mode"), F.lit("\nnew mode "), mode("new_mode"), F.lit("\n")))
        .otherwise(""),
        F.concat(F.lit("index "), short("old_oid"), F.lit(".."), short("new_oid"), F.when(same_mode, F.concat(F.lit(" "), mode("new_mode"))).otherwise(""), F.lit("\n")),
    )
    names = F.concat(F.when(added, "--- /dev/null\n").otherwise(F.format_string("--- a/%s\n", F.col(key))), F.when(deleted, "+++ /dev/null\n").otherwise(F.format_string("+++ b/%s\n", F.col(key))))
    body = F.when(F.col("kind") == "binary", F.format_string("Binary files a/%s and b/%s differ\n", F.col(key), F.col(key))).otherwise(F.concat(names, F.coalesce("hunks", F.lit(""))))
    return F.concat(head, body)


def attribute(texts: list[str | None]) -> list[int] | None:
    """For each line of texts[0], the newest text, the place of the oldest text in whose step it appeared."""
    tip = lines(texts[0] or "")
    if texts[0] is None:
        return None
    owner = [len(texts) - 1] * len(tip)
    alive = {i: i for i in range(len(tip))}  # line of the tip: line of the version at hand
    for step, text in enumerate(texts):
        older = texts[step + 1] if step + 1 < len(texts) else None
        if older is None:
            for i in alive:
                owner[i] = step
            break
        kept, here, there = {}, 0, 0
        for tag, _ in shortest_script(lines(older), lines(text or "")):
            if tag == "eq":
                kept[here] = there
            here += tag != "del"
            there += tag != "add"
        for i, at in list(alive.items()):
            if at in kept:
                alive[i] = kept[at]
            else:
                owner[i] = step
                del alive[i]
    return owner


def blame(history: DataFrame) -> DataFrame:
    """repo, line_no, line, oid, author, time: who last touched each line of the newest text of each path.

    `history` is (repo, ordinal, oid, author, time, text), the changes of one path, newest first. A path's changes are
    kept within one task, all of them: its memory grows with the texts of the longest history.
    """

    def per_path(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ordinal").reset_index(drop=True)
        owner = attribute(rows.text.tolist())
        if owner is None:
            return pd.DataFrame({"repo": [], "line_no": [], "line": [], "oid": [], "author": [], "time": []})
        picked = rows.loc[owner].reset_index(drop=True)
        return pd.DataFrame({"repo": key[0], "line_no": range(1, len(owner) + 1), "line": lines(rows.text[0]), "oid": picked.oid, "author": picked.author, "time": picked.time})

    kind = {c: history.schema[c].dataType.simpleString() for c in ("repo", "oid", "author", "time")}
    narrow = history.select("repo", "ordinal", "oid", "author", "time", "text")
    return narrow.groupBy("repo").applyInPandas(per_path, f"repo {kind['repo']}, line_no long, line string, oid {kind['oid']}, author {kind['author']}, time {kind['time']}")


def runs(blamed: DataFrame) -> DataFrame:
    """repo, first_line, last_line, oid: neighbouring lines of one commit as one row."""
    by = Window.partitionBy("repo").orderBy("line_no")
    new = F.coalesce(F.lag("oid").over(by) != F.col("oid"), F.lit(True)).cast("int")
    return (
        blamed.withColumn("new", new)
        .withColumn("run", F.sum("new").over(by))
        .groupBy("repo", "run", "oid")
        .agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))
        .select("repo", "first_line", "last_line", "oid")
    )
