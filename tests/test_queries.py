import random
import re

import pytest

from annalist.operators import diff, graph
from annalist.plans import activity, catalog
from tests.compare import DATA, same

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert same(spark, QUERIES[name], SQL[name]) > 0


def pairs(spark):
    """(repo, ordinal): old and new lines of each turn of a conversation, a word a line."""
    out, before = {}, {}
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").orderBy("conv_id", "turn").collect():
        new = diff.lines((r.text or "").replace(" ", "\n"))
        out[r.conv_id, r.turn] = (before.get(r.conv_id), new)
        before[r.conv_id] = new
    return out


def common(old, new):
    """Lines of the longest common subsequence."""
    row = [0] * (len(new) + 1)
    for a in old:
        above, row = row, [0]
        for j, b in enumerate(new):
            row.append(above[j] + 1 if a == b else max(above[j + 1], row[j]))
    return row[-1]


def apply(old, changes):
    """The new lines, from (a_start, a_len, body lines with signs) in order; what they say of the old lines must hold."""
    new, at = [], 0
    for start, size, body in changes:
        begin = start - 1 if size else start
        new += old[at:begin]
        assert [x[1:] for x in body if x[0] != "+"] == old[begin : begin + size]
        new += [x[1:] for x in body if x[0] != "-"]
        at = begin + size
    return new + old[at:]


def test_diffstat_is_shortest(spark):
    expected = {}
    for key, (old, new) in pairs(spark).items():
        kept = common(old or [], new)
        expected[key] = ("text", len(new) - kept, len(old or []) - kept)
    got = {(r.repo, r.ordinal): (r.kind, r.added, r.deleted) for r in QUERIES["diffstat"](spark, DATA).collect()}
    assert got == expected


def test_hunks_and_patches_make_the_new_text(spark):
    hunks = {}
    for r in QUERIES["myers_hunks"](spark, DATA).orderBy("repo", "ordinal", "hunk").collect():
        hunks.setdefault((r.repo, r.ordinal), []).append((r.a_start, r.a_len, r.body.split("\n")))
    patches = {tuple(map(int, r.path.split("/"))): r.patch for r in QUERIES["unified_patch"](spark, DATA).collect()}
    both = pairs(spark)
    assert set(patches) == set(both)
    for key, (old, new) in both.items():
        assert apply(old or [], hunks.get(key, [])) == new
        parsed = []
        for x in patches[key].split("\n")[:-1]:
            if m := re.match(r"@@ -(\d+),(\d+) \+\d+,\d+ @@", x):
                parsed.append((int(m[1]), int(m[2]), []))
            elif parsed:
                parsed[-1][2].append(x)
        assert apply(old or [], parsed) == new


def test_blame_of_histories_that_only_grow(spark):
    expected, texts = {}, {}
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").orderBy("conv_id", "turn").collect():
        texts.setdefault(r.conv_id, []).append((r.turn, r.text))
    for conv, turns in texts.items():
        known = []
        for turn, text in turns:
            if text is not None:
                known += [(x, f"{conv}:{turn}") for x in text.split("\n")]
        while known and known[-1][0] == "":
            known.pop()
        expected |= {(conv, i + 1): x for i, x in enumerate(known)}
    got = {(r.repo, r.line_no): (r.line, r.oid) for r in QUERIES["blame_lines"](spark, DATA).collect()}
    assert got == expected


def test_log_walks_the_newest_known(spark):
    got = {}
    for r in QUERIES["log_best_first"](spark, DATA).orderBy("repo", "position").collect():
        got.setdefault(r.repo, []).append(r.oid)
    rows = activity.skewed_commits(spark, DATA).collect()
    assert set(got) == {r.repo for r in rows}
    for repo, order in got.items():
        known = {r.oid: r for r in rows if r.repo == repo}
        front = [next(r.oid for r in known.values() if r.rank == 1)]
        met, expected = set(front), []
        while front:
            at = max(front, key=lambda o: known[o].time)  # the one met first, of equal times
            front.remove(at)
            expected.append(at)
            for p in known[at].parents:
                if p not in met:
                    met.add(p)
                    front.append(p)
        assert order == expected


def test_all_other_queries_have_sql():
    assert set(QUERIES) - set(SQL) == {"diffstat", "myers_hunks", "unified_patch", "blame_lines", "log_best_first"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["push_decisions", "apply_ref_updates", "push_events", "is_ancestor", "is_ancestor_over_merges"])
def test_ancestry_of_pushes_is_not_walked_to_the_roots(spark, monkeypatch, name):
    monkeypatch.setattr(graph, "_depths", None)
    QUERIES[name](spark, DATA)


def long_turns(spark, folder):
    """A folder with a conversation whose turns are far longer than the host's line diffs; old and new words by turn."""
    rng = random.Random(4)
    first = [f"w{i}" for i in range(30_000)]
    second = [w for w in first if rng.random() > 0.0005]
    third = rng.choices([f"v{i}" for i in range(50)], k=3000)
    turns = {1: first, 2: second, 3: third, 4: rng.sample(third, 3000)}
    rows = [(1, t, "user", " ".join(words)) for t, words in turns.items()]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return {t: (turns.get(t - 1, []), words) for t, words in turns.items()}


def test_hunks_of_long_turns_are_whole(spark, tmp_path):
    both = long_turns(spark, tmp_path)
    hunks = {}
    for r in QUERIES["myers_hunks"](spark, str(tmp_path)).orderBy("ordinal", "hunk").collect():
        hunks.setdefault(r.ordinal, []).append((r.a_start, r.a_len, r.body.split("\n")))
    assert set(hunks) == set(both)
    for turn, (old, new) in both.items():
        assert apply(old, hunks[turn]) == new
    signs = [line[0] for *_, body in hunks[4] for line in body]
    assert signs.count("-") == signs.count("+") == 3000 - common(*both[4])


def test_patches_of_long_turns_are_whole(spark, tmp_path):
    both = long_turns(spark, tmp_path)
    patches = {r.path: r.patch.split("\n") for r in QUERIES["unified_patch"](spark, str(tmp_path)).collect()}
    assert set(patches) == {f"1/{turn}" for turn in both}
    for turn, (old, new) in both.items():
        changes = []
        assert patches[f"1/{turn}"][-1] == "" and f"+++ b/1/{turn}" in patches[f"1/{turn}"]
        for x in patches[f"1/{turn}"][:-1]:
            if m := re.match(r"@@ -(\d+),(\d+) \+\d+,\d+ @@", x):
                changes.append((int(m[1]), int(m[2]), []))
            elif changes:
                changes[-1][2].append(x)
        assert apply(old, changes) == new
