"""Secret scans through an incremental blob ledger (DataFrame functions only).

Every historical version is addressed by the SHA-256 of its text. The ledger, a table beside that of the findings, holds
for each blob the pairs of rule and rule version that were evaluated on it; a run reads one owner of each blob that has
an unseen pair, evaluates only the unseen pairs on it, appends to both tables, and findings are joined back to all paths
that hold the blob. A second run over the same versions evaluates nothing.

Rules: assign, access and hex as the contract of `op2` states them, `pem` (the first line of a private key block) and
`url` (a user and a password before the host of a URL). Spans are in code points, end exclusive.

Defined results: a null text counts as empty and holds no secret; a table without rows gives no findings; repeated rows
share a blob and get the same findings; rows of one key with other texts have blobs of their own; rows with a null key
are scanned and get their findings like others; other columns are not read. Blobs are owned by the smallest key, so that
the join that fetches their texts is spread evenly, and paths are dealt to salts before findings are joined to them (which
are few, so each is copied for every salt), so that a blob with very many paths does not meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, shared_folder, text_column

#: name: (version, pattern, group whose length counts, least length, cheap test that any match implies).
RULES: dict[str, tuple[int, str, int, int, str | None]] = {
    "assign": (1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, None),
    "access": (1, r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    "hex": (1, r"[0-9a-f]{24,}", 0, 24, None),
    "pem": (1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1, "PRIVATE KEY-----"),
    "url": (1, r"\b[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@", 0, 1, "://"),
}
BASE = ("assign", "access", "hex")
#: Tasks over which the paths of one blob are spread.
SALTS = 16
_SPANS = "array<struct<start:int,end:int,rule:string>>"
_PAIRS = "array<struct<rule:string,version:int>>"


def _matches(text: Column, rule: str) -> Column:
    """Spans of one rule: match lengths and the gaps between them, added up. A text is searched once, and cut once more
    only where it has a match."""
    _, pattern, group, least, hint = RULES[rule]
    pattern_ = F.lit(pattern)
    empty = F.array().cast(_SPANS)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["whole"])
        # A match found again in itself has the same groups, as no pattern looks beyond its match.
        counted = x["whole"] if group == 0 else F.regexp_extract(x["whole"], pattern, group)
        span = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(rule).alias("rule")))
        return F.struct(end.alias("at"), F.when(F.length(counted) >= least, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def spans(whole: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
        parts = F.arrays_zip(whole.alias("whole"), gaps.alias("gap"))
        return F.when(F.size(whole) > 0, F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])).otherwise(empty)

    found = let(F.regexp_extract_all(text, pattern_, F.lit(0)), spans)
    return F.when(F.contains(text, F.lit(hint)), found).otherwise(empty) if hint else found


def address(versions: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and `blob`, the content address of each version."""
    return versions.select(F.col(key), F.sha2(text_column(text), 256).alias("blob"))


def pairs(rules: Iterable[str]) -> Column:
    """The (rule, version) pairs of these rules."""
    return F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(RULES[r][0]).alias("version")) for r in rules))


def scan(
    versions: DataFrame, ledger: DataFrame | None = None, key: str = "doc_id", text: str = "text", rules: Iterable[str] = tuple(RULES)
) -> tuple[DataFrame, DataFrame]:
    """(findings, additions): `blob, spans` of each newly scanned blob that has a finding, and the (blob, rule, version)
    rows to append to the ledger. `ledger` holds such rows of earlier runs, or is None."""
    rules = tuple(rules)
    todo = pairs(rules)
    unseen = address(versions, key, text).groupBy("blob").agg(F.min(key).alias(key)).withColumn("todo", todo)
    if ledger is not None:
        # At most one entry for each rule version, so the sets are as small as the rule table's history.
        seen = ledger.groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("seen"))
        left = F.array_except(todo, F.coalesce("seen", F.array().cast(_PAIRS)))
        unseen = unseen.join(seen, "blob", "left").select("blob", key, left.alias("todo")).where(F.size("todo") > 0)
    # One row of the version that owns the blob, wherever a key occurs more than once: the address must agree too.
    texts = versions.select(F.col(key), text_column(text).alias("t"))
    wanted = unseen.join(texts, key).select("blob", "todo", "t")
    # Where no row of a blob has a key, the blob itself fetches one of its texts.
    nameless = texts.where(F.col(key).isNull()).select(F.sha2("t", 256).alias("blob"), "t").dropDuplicates(["blob"])
    wanted = wanted.unionByName(unseen.where(F.col(key).isNull()).join(nameless, "blob").select("blob", "todo", "t"))
    # What is searched for depends on the ledger's side of the join, so that no search can move below it: texts whose
    # blob another row owns, or whose pairs are all seen, are never searched.
    each = [F.when(F.exists("todo", lambda x: x["rule"] == r), _matches(F.col("t"), r)).otherwise(F.array().cast(_SPANS)) for r in rules]
    scanned = wanted.where(F.sha2("t", 256) == F.col("blob")).select("blob", F.concat(*each).alias("spans"))
    return scanned.where(F.size("spans") > 0).dropDuplicates(["blob"]), unseen.select("blob", F.inline("todo"))


def run(versions: DataFrame, folder: str, key: str = "doc_id", text: str = "text", rules: Iterable[str] = tuple(RULES)) -> None:
    """Scan what the ledger in `folder` doesn't hold, and append the findings and the ledger's new rows to it."""
    known = stored(versions.sparkSession, folder)
    findings, additions = scan(versions, known[1] if known else None, key, text, rules)
    # The findings go first: a run that is lost between the two is simply scanned again.
    findings.write.mode("append").parquet(f"{folder}/findings")
    additions.write.mode("append").parquet(f"{folder}/ledger")


def stored(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | None:
    """The findings and the ledger of all runs so far, or None before the first."""
    try:
        ledger = spark.read.parquet(f"{folder}/ledger")
    except AnalysisException:
        return None
    each = spark.read.parquet(f"{folder}/findings").withColumn("span", F.explode("spans"))
    return each.groupBy("blob").agg(F.array_sort(F.collect_set("span")).alias("spans")), ledger


def by_path(versions: DataFrame, findings: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key, blob, spans` of every version; `spans` is empty where its blob has no finding."""
    paths = address(versions, key, text).withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    copies = findings.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return paths.join(copies, ["blob", "salt"], "left").select(key, "blob", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined, by start and then in the order of RULES."""
    order = F.create_map(*(F.lit(x) for i, r in enumerate(RULES) for x in (r, i)))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order[s["rule"]].alias("k"), s["end"].alias("end"), s["rule"].alias("rule"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2(docs: DataFrame) -> DataFrame:
    """Two runs over one ledger: the base rules, and then all, of which the second evaluates only those still unseen."""
    folder = shared_folder(docs.sparkSession, "secrets")
    run(docs, folder, rules=BASE)
    run(docs, folder)
    findings, _ = stored(docs.sparkSession, folder)
    spans = F.col("spans")
    count = lambda rule: F.size(F.filter(spans, lambda s: s["rule"] == rule)).cast("long").alias(f"n_{rule}")
    base = F.filter(spans, lambda s: s["rule"].isin(*BASE))
    return by_path(docs, findings).select(
        "doc_id", *(count(r) for r in BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"), "blob"
    )


def _rule_sql(k: int, rule: str) -> str:
    """Spans of one rule in SQL: lengths of matches and of the gaps between them, added up."""
    _, pattern, group, least, _ = RULES[rule]
    quoted = "'" + pattern.replace("'", "''") + "'"
    size = "list_sum(list_transform({}[:{}], lambda y: length(y)))"
    start = f"CAST(coalesce({size.format('gaps', 'i')}, 0) + coalesce({size.format('hits', 'i - 1')}, 0) AS BIGINT)"
    return f"""SELECT doc_id, {start} AS start, {k} AS k, {start} + length(hits[i]) AS stop, '{rule}' AS rule FROM (
      SELECT doc_id, hits, gaps, counted, unnest(range(1, len(hits) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(t, {quoted}) AS hits, regexp_split_to_array(t, {quoted}) AS gaps, regexp_extract_all(t, {quoted}, {group}) AS counted FROM d))
      WHERE length(counted[i]) >= {least}"""


_NAMED = "string_agg(rule || ':' || start || ':' || stop, ',' ORDER BY start, k)"
#: The same in SQL.
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_rule_sql(k, r) for k, r in enumerate(RULES))}),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (rule = '{r}') AS n_{r}" for r in BASE)}, {_NAMED} FILTER (k < {len(BASE)}) AS base, {_NAMED} AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"CAST(coalesce(n_{r}, 0) AS BIGINT) AS n_{r}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
