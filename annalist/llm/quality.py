"""Quality rules as a bitmask ledger (DataFrame functions only).

`ledger` evaluates every rule once per document and gives the measurements and one failure bit per rule; it is written
as a table, and what follows reads that table and no text. Policies are versioned sets of rules, so that a verdict is one
bitwise AND, and `ablations` counts from the stored bits what each rule alone decides.

Defined results: a null text counts as empty (no words, so the minimum-words rule fails); an empty table gives an
empty ledger; repeated rows, and rows with a null key, are judged one by one; other columns stay out of the ledger. Arrays
never leave their row, so a document of any length stays in one task and no rows are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import has_word, shared_folder, text_column, words

SYMBOLS = "[#*$%&|<>]"
#: Words with a letter, and lines that start with a bullet, end with an ellipsis, or end with a closing mark.
LETTERED = r"[^\x20\x09-\x0D\p{L}]*\p{L}[^\x20\x09-\x0D]*"
BULLET = r"^[\x20\x09]*[-*•]"
ELLIPSIS = r"(?:\.\.\.|…)[\x20\x09\x0D]*$"
CLOSED = r"""[.!?"”»)][\x20\x09\x0D]*$"""
#: Rule names in the order of their bits.
RULES = (
    "few_words", "repeated_words", "many_symbols", "repeated_lines", "odd_word_length",
    "few_letters", "bullets", "ellipses", "open_lines", "common_window",
)
BASE = ("few_words", "repeated_words")
#: Versioned policies; a document is kept if it fails no rule of the policy.
POLICIES = {"base-1": BASE, "full-1": RULES[:5], "full-2": RULES}
POLICY = "full-2"


def mask(policy: str | tuple[str, ...]) -> int:
    return sum(1 << RULES.index(rule) for rule in (POLICIES[policy] if isinstance(policy, str) else policy))


def measure(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of `docs` with its key and the counts that the rules look at."""
    # Each step is a column of its own: the optimizer keeps a projection apart that the next names more than once.
    t = F.col("t")
    split = docs.select(F.col(key), text_column(text).alias("t")).select(
        key,
        words(t).alias("w"),
        F.filter(F.split(t, "\n"), has_word).alias("lines"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit(LETTERED)).cast("long").alias("n_lettered"),
        # Lines end at \n alone.
        *(F.regexp_count(t, F.lit("(?md)" + p)).cast("long").alias(n) for n, p in (("n_bullets", BULLET), ("n_ellipses", ELLIPSIS), ("n_closed", CLOSED))),
    )
    counts = ("n_symbols", "n_lettered", "n_bullets", "n_ellipses", "n_closed")
    w, windows, ordered, found = (F.col(c) for c in ("w", "windows", "ordered", "found"))
    hashed = split.select(
        key,
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        *counts,
        F.size(w).cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size(w) > 3,
            F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
        ).alias("windows"),
    )
    # Equal windows stand side by side in the sorted array; only texts that have some are sorted.
    sort = hashed.withColumn(
        "ordered",
        F.when(
            F.size(F.array_distinct(windows)) < F.size(windows),
            F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("windows")
    same = lambda x, j: F.get(ordered, j)["h"] == x["h"]
    # The longest row of equal windows.
    run = lambda a, x: F.when(a["h"] == x["h"], a["n"] + 1).otherwise(1)
    most = F.aggregate(
        ordered,
        F.struct(F.lit(None).cast("long").alias("h"), F.lit(0).alias("n"), F.lit(0).alias("most")),
        lambda a, x: F.struct(x["h"].alias("h"), run(a, x).alias("n"), F.greatest(a["most"], run(a, x)).alias("most")),
        lambda a: a["most"],
    )
    repeated = sort.withColumn("most", F.coalesce(most, (F.col("n_words") > 2).cast("int")).cast("long")).withColumn(
        "found",
        F.sort_array(
            F.filter(
                F.transform(ordered, lambda x, j: F.when(F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)), x["i"])),
                lambda p: p.isNotNull(),
            )
        ),
    ).drop("ordered")
    covered = F.aggregate(F.transform(found, lambda p, j: F.least(F.lit(3), F.get(found, j + 1) - p)), F.lit(0), lambda a, x: a + x)
    return repeated.select(
        key, "n_words", "word_chars", *counts, "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines", F.col("most").alias("n_top_window")
    )


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Measurements and `failed` (int), the OR of the bits of the rules that the document fails."""
    c = F.col
    rules = {
        "few_words": c("n_words") < 50,
        "repeated_words": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "many_symbols": 10 * c("n_symbols") > 3 * c("n_words"),
        "repeated_lines": 10 * c("n_dup_lines") > 7 * c("n_lines"),
        "odd_word_length": (c("word_chars") > 20 * c("n_words")) | (2 * c("word_chars") < 3 * c("n_words")),
        "few_letters": 10 * c("n_lettered") < 8 * c("n_words"),
        "bullets": 10 * c("n_bullets") > 9 * c("n_lines"),
        "ellipses": 10 * c("n_ellipses") > 3 * c("n_lines"),
        "open_lines": 10 * c("n_closed") < c("n_lines"),
        "common_window": (c("n_top_window") > 1) & (300 * c("n_top_window") > 18 * c("n_words")),
    }
    bits = sum((F.when(rules[rule], F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES)), F.lit(0))
    return measure(docs, text, key).withColumn("failed", bits)


def passes(policy: str | tuple[str, ...] = POLICY) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(entries: DataFrame, policy: str | tuple[str, ...] = POLICY) -> DataFrame:
    """Per rule of the policy: documents that fail it, and those that it alone rejects; one pass, one small row out."""
    m = mask(policy)
    rules = [r for r in RULES if mask((r,)) & m]
    hit = F.col("failed").bitwiseAND(F.lit(m))
    counts = entries.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bit_or(hit), F.lit(0)).alias("seen"),
        *(F.count_if(hit.bitwiseAND(F.lit(mask((r,)))) != 0).alias(f"fails_{r}") for r in rules),
        *(F.count_if(hit == mask((r,))).alias(f"alone_{r}") for r in rules),
    )
    rows = F.array(
        *(
            F.struct(F.lit(r).alias("rule"), F.col("n").alias("n_docs"), F.col(f"fails_{r}").alias("n_failed"), F.col(f"alone_{r}").alias("n_alone"), (F.col("seen").bitwiseAND(F.lit(mask((r,)))) != 0).alias("seen"))
            for r in rules
        )
    )
    return counts.select(F.inline(rows))


def _stored(entries: DataFrame) -> DataFrame:
    """The ledger as a table in the shared folder; verdicts are read from its bits, and no rule is evaluated again."""
    folder = shared_folder(entries.sparkSession, "quality")
    entries.write.parquet(folder)
    return entries.sparkSession.read.parquet(folder)


def keep_documents(docs: DataFrame, policy: str = POLICY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose text passes the policy, all columns unchanged, without a join: each row of this ledger
    carries its document."""
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    judged = _stored(ledger(row.withColumn("t_", F.col("row")[text]), "t_", "row").select("row", "failed"))
    return judged.where(passes(policy)).select("row.*")


def op10(docs: DataFrame) -> DataFrame:
    entries = _stored(ledger(docs))
    failed = F.col("failed")
    alone = F.array(*(F.lit(r) for r in RULES))[F.round(F.log2(failed)).cast("int")]
    judged = entries.withColumn("alone", F.when(F.bit_count(failed) == 1, alone))
    # A row for each rule.
    decided = F.broadcast(ablations(entries).select(F.col("rule").alias("alone"), "n_alone"))
    return judged.join(decided, "alone", "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~passes("base-1")).alias("base_failed"),
        passes().alias("kept"),
        passes("full-1").alias("kept_full_1"),
        failed.alias("failed_bits"),
        "alone",
        F.coalesce("n_alone", F.lit(0)).cast("long").alias("n_alone"),
    )


#: The same in SQL for the correctness gate.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
p AS (
  SELECT doc_id, unnest(range(len(w) - 2)) AS i, unnest(list_zip(w[:len(w) - 2], w[2:len(w) - 1], w[3:])) AS g
  FROM w WHERE len(w) >= 3),
q AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM p) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM q, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
c AS (SELECT doc_id, max(n) AS n_top_window FROM (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id, g) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS n_lettered,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS n_bullets,
         len(list_filter(lines, lambda x: regexp_matches(x, '(?:\.\.\.|…)[\x20\x09\x0D]*$'))) AS n_ellipses,
         len(list_filter(lines, lambda x: regexp_matches(x, '[.!?"”»)][\x20\x09\x0D]*$'))) AS n_closed,
         coalesce(n_top_window, 0) AS n_top_window
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN c USING (doc_id)),
f AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT
         + 4 * (10 * n_symbols > 3 * n_words)::INT + 8 * (10 * n_dup_lines > 7 * n_lines)::INT
         + 16 * (word_chars > 20 * n_words OR 2 * word_chars < 3 * n_words)::INT
         + 32 * (10 * n_lettered < 8 * n_words)::INT + 64 * (10 * n_bullets > 9 * n_lines)::INT
         + 128 * (10 * n_ellipses > 3 * n_lines)::INT + 256 * (10 * n_closed < n_lines)::INT
         + 512 * (n_top_window > 1 AND 300 * n_top_window > 18 * n_words)::INT AS INT) AS failed_bits
  FROM m),
a AS (
  SELECT *, CASE WHEN bit_count(failed_bits) = 1 THEN ['few_words', 'repeated_words', 'many_symbols', 'repeated_lines', 'odd_word_length',
         'few_letters', 'bullets', 'ellipses', 'open_lines', 'common_window'][1 + CAST(log2(failed_bits) AS INT)] END AS alone
  FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits & 31 = 0 AS kept_full_1, failed_bits, alone,
       CASE WHEN alone IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY alone) END AS n_alone FROM a
"""
