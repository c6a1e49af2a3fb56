import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from annalist.functions import history as H
from annalist.operators import diff, graph, log, refs, snapshot, store
from annalist.plans import activity
from annalist.streaming import feeds
from tests.compare import DATA

FILE = st.lists(st.sampled_from(["a", "b", "c", "d", ""]), max_size=12)


@given(FILE, FILE)
@settings(max_examples=300, deadline=None)
def test_edit_script_is_exact_and_shortest(old, new):
    script = diff.edit_script(old, new)
    assert [x for t, x in script if t != "add"] == old
    assert [x for t, x in script if t != "del"] == new
    common = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
    for i, a in enumerate(old):
        for j, b in enumerate(new):
            common[i + 1][j + 1] = common[i][j] + 1 if a == b else max(common[i][j + 1], common[i + 1][j])
    assert sum(t == "eq" for t, _ in script) == common[len(old)][len(new)]


def test_edit_script_bounds_and_tie_break():
    assert diff.edit_script(["x"] * 3000, ["y"] * 3000) is None
    assert diff.edit_script(["a", "b"], ["b", "a"]) == [("del", "a"), ("eq", "b"), ("add", "a")]
    assert diff.lines("a\n\n") == ["a", ""] and diff.lines("") == []


def naive_hunks(ops, context=3):
    changes = [i for i, (t, _) in enumerate(ops) if t != "eq"]
    groups = []
    for i in changes:
        if groups and i - groups[-1][-1] <= 2 * context:
            groups[-1].append(i)
        else:
            groups.append([i])
    out = []
    for g in groups:
        lo, hi = max(0, g[0] - context), min(len(ops) - 1, g[-1] + context)
        before, inside = ops[:lo], ops[lo : hi + 1]
        a, b = sum(t != "add" for t, _ in before) + 1, sum(t != "del" for t, _ in before) + 1
        na, nb = sum(t != "add" for t, _ in inside), sum(t != "del" for t, _ in inside)
        out.append((a - (na == 0), na, b - (nb == 0), nb, "\n".join({"eq": " ", "add": "+", "del": "-"}[t] + s for t, s in inside)))
    return out


def test_hunks(spark):
    rng = random.Random(5)
    files = {k: [(rng.choices(["eq", "add", "del"], [9, 1, 1])[0], str(i)) for i in range(rng.randrange(60))] for k in range(40)}
    rows = [(k, i, t, s) for k, ops in files.items() for i, (t, s) in enumerate(ops)]
    got = diff.hunks(spark.createDataFrame(rows, "repo long, i int, tag string, line string"), "repo").orderBy("repo", "hunk").collect()
    for k, ops in files.items():
        assert [(h.a_start, h.a_len, h.b_start, h.b_len, h.body) for h in got if h.repo == k] == naive_hunks(ops)


def test_diff_kinds_and_patch(spark):
    rows = [("a", "1\n2\n", "1\n3\n"), ("b", "x\0", "y"), ("c", "same", "same\n"), ("d", None, "new\n")]
    pairs = spark.createDataFrame(rows, "path string, old string, new string")
    diffs = diff.diff_lines(pairs)
    stats = {r.path: (r.kind, r.added, r.deleted) for r in diff.diffstat(diffs, "path").collect()}
    assert stats == {"a": ("text", 1, 1), "b": ("binary", 0, 0), "c": ("text", 0, 0), "d": ("text", 1, 0)}
    files = diffs.select("path", "kind", F.when(F.col("old").isNotNull(), "0123456789").alias("old_oid"), F.lit("9876543210").alias("new_oid"), F.when(F.col("old").isNotNull(), "100644").alias("old_mode"), F.lit("100644").alias("new_mode"))
    patches = {r.path: r.patch for r in diff.patch(files, diff.hunks(diff.op_rows(diffs, "path"), "path")).collect()}
    assert patches["a"] == "diff --git a/a b/a\nindex 0123456..9876543 100644\n--- a/a\n+++ b/a\n@@ -1,2 +1,2 @@\n 1\n-2\n+3\n"
    assert patches["d"].startswith("diff --git a/d b/d\nnew file mode 100644\nindex 0000000..9876543\n--- /dev/null\n+++ b/d\n@@ -0,0 +1,1 @@\n")
    assert patches["b"].endswith("Binary files a/b and b/b differ\n")


def test_blame(spark):
    rows = [(1, 0, "c3", "x", 3, "a\nB\nc\nd"), (1, 1, "c2", "y", 2, "a\nB\nc"), (1, 2, "c1", "z", 1, "a\nb\nc")]
    got = diff.blame(spark.createDataFrame(rows, "repo long, ordinal int, oid string, author string, time long, text string")).orderBy("line_no")
    assert [(r.line, r.oid, r.author) for r in got.collect()] == [("a", "c1", "z"), ("B", "c2", "y"), ("c", "c1", "z"), ("d", "c3", "x")]
    assert [(r.first_line, r.last_line) for r in diff.runs(got).orderBy("first_line").collect()] == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_best_first_walks_the_newest_known(spark):
    rng = random.Random(2)
    rows, expected = [], {}
    for repo in range(6):
        parents = {f"{i}": sorted({str(rng.randrange(i + 1, 31)) for _ in range(rng.randrange(3))} - {"30"}) for i in range(30)}
        times = {i: rng.randrange(20) for i in parents}
        front, met, order = ["0"], {"0"}, []
        while front:
            front.sort(key=lambda i: -times[i])
            at = front.pop(0)
            order.append(at)
            for p in parents[at]:
                if p not in met:
                    met.add(p)
                    front.append(p)
        expected[repo] = order
        rows += [(repo, i, parents[i], times[i]) for i in parents]
    commits = spark.createDataFrame(rows, "repo long, oid string, parents array<string>, time long")
    got = log.best_first(commits, spark.createDataFrame([(r, "0") for r in expected], "repo long, oid string")).orderBy("repo", "position").collect()
    for repo, order in expected.items():
        assert [r.oid for r in got if r.repo == repo] == order


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y"), ("d", "a")], "src string, dst string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    reached = graph.closure(edges, ids("a"))
    assert {(r.id, r.depth) for r in reached.collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert {r.id for r in graph.closure(edges, ids("a"), ids("c")).collect()} == {"a", "b"}
    assert {r.id for r in graph.boundary(graph.closure(edges, ids("a"), max_depth=1), 1).collect()} == {"b", "c"}
    assert {r.id for r in graph.unreachable(ids("a", "x", "y", "z"), reached, ids("z")).collect()} == {"x", "y"}
    assert {r.id for r in graph.missing(edges, ids("a", "b"), ids("c", "y")).collect()} == {"d"}
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(20)], "oid long, parent long")
    pairs = spark.createDataFrame([(0, 19), (5, 5), (7, 3)], "anc long, desc long")
    assert {(r.anc, r.is_ancestor) for r in graph.is_ancestor(chain, pairs).collect()} == {(0, True), (5, True), (7, False)}
    tags = spark.createDataFrame([("t1", "t2"), ("t2", "c")], "oid string, target string")
    assert {(r.oid, r.peeled) for r in graph.peel(tags, spark.createDataFrame([("t1",), ("c",)], "oid string")).collect()} == {("t1", "c"), ("c", "c")}


def test_pushes(spark):
    a, b, c = "a" * 40, "b" * 40, "c" * 40
    refs_ = spark.createDataFrame([(1, "refs/heads/main", a)], "repo long, name string, target string")
    commands = [
        (1, "p", 0, "refs/heads/main", a, b),
        (1, "p", 1, "refs/heads/new", H.ZERO_OID, c),
        (1, "p", 2, "refs/heads/..", H.ZERO_OID, b),
        (1, "p", 3, "refs/heads/old", a, b),
        (1, "q", 0, "refs/heads/main", a, H.ZERO_OID),
    ]
    rows = spark.createDataFrame(commands, "repo long, batch string, seq int, ref string, old string, new string")
    ancestry = spark.createDataFrame([(a, b, False)], "anc string, desc string, is_ancestor boolean")
    decided = refs.decide(rows, refs_, spark.createDataFrame([(b,)], "oid string"), ancestry)
    got = {(r.batch, r.seq): (r.message, r.forced) for r in decided.collect()}
    assert got == {("p", 0): (None, True), ("p", 1): ("missing necessary objects", False), ("p", 2): ("funny refname", False), ("p", 3): ("fetch first", False), ("q", 0): ("fetch first", False)}
    assert refs.apply_updates(refs_, decided).first().target == b


def test_pushes_follow_each_other(spark):
    """Each batch sees what the batches before it left; against a plain walk."""
    rng = random.Random(6)
    values = [H.ZERO_OID, *"abcd"]
    commands = [(r, b, i, f"refs/heads/{rng.choice('xy')}", rng.choice(values), rng.choice([*values, "lost"])) for r in range(3) for b in range(25) for i in range(rng.randrange(4))]
    stored = spark.createDataFrame([(v,) for v in "abcd"], "oid string")
    start = spark.createDataFrame([(0, "refs/heads/x", "a")], "repo long, name string, target string")
    decided = refs.decide(spark.createDataFrame(commands, "repo long, batch long, seq int, ref string, old string, new string"), start, stored)
    got = {(r.repo, r.batch, r.seq): r.message for r in decided.collect()}
    now, expected = {(0, "refs/heads/x"): "a"}, {}
    for repo, batch in sorted({c[:2] for c in commands}):
        before = dict(now)
        for r, b, i, ref, old, new in sorted(commands):
            if (r, b) == (repo, batch):
                ok = before.get((r, ref), H.ZERO_OID) == old
                message = "fetch first" if not ok else "missing necessary objects" if new == "lost" else None if now.get((r, ref), H.ZERO_OID) == old else "fetch first"
                # A command that sets what is there already leaves the next of its batch its chance; the walk takes the first.
                if message is None and any(expected.get((r, b, j)) is None and k == ref and (r, b, j) in expected for _, bb, j, k, *_ in commands if bb == b and _ == r):
                    message = "fetch first"
                expected[r, b, i] = message
                if message is None:
                    now[r, ref] = new
    assert got == expected and sum(m is None for m in got.values()) > 10


def test_history_and_ancestors_over_merges(spark):
    rng = random.Random(11)
    rows, up = [], {}
    for repo in range(2):
        for i in range(300):
            parents = [] if i == 0 else [i - 1] if i % 7 else sorted({i - 1, rng.randrange(i)}, reverse=True)
            if i in (50, 120):  # roots of their own
                parents = []
            up[repo, i] = parents
            rows += [(repo, repo * 1000 + i, n, repo * 1000 + p) for n, p in enumerate(parents)] or [(repo, repo * 1000 + i, 0, None)]
    parents = spark.createDataFrame(rows, "repo long, oid long, nth int, parent long")

    def above(repo, i):
        seen, todo = {i}, [i]
        while todo:
            for p in up[repo, todo.pop()]:
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return seen

    tips = spark.createDataFrame([(0, 299), (1, 1080)], "repo long, oid long")
    got = {(r.repo, r.oid) for r in graph.history(parents, tips, ("repo",)).collect()}
    assert got == {(0, i) for i in above(0, 299)} | {(1, 1000 + i) for i in above(1, 80)}
    asked = [(rng.randrange(300), rng.randrange(300)) for _ in range(60)] + [(3, 3), (0, 299), (299, 0)]
    pairs = spark.createDataFrame(asked, "anc long, desc long")
    found = {(r.anc, r.desc): r.is_ancestor for r in graph.is_ancestor(parents.drop("repo"), pairs).collect()}
    assert found == {(a, d): a in above(0, d) for a, d in asked}


def test_closure_within_repositories(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (2, "b", "c")], "repo long, src string, dst string")
    roots = spark.createDataFrame([(1, "a"), (2, "c")], "repo long, id string")
    assert {(r.repo, r.id) for r in graph.closure(edges, roots, within=("repo",)).collect()} == {(1, "a"), (1, "b"), (2, "c")}


def test_store(spark):
    rows = spark.createDataFrame([(p, o) for p in range(4) for o in range(5)], "pack_id long, offset long")
    got, after = [], None
    while page := [tuple(r) for r in store.keyset_page(rows, ["pack_id", "offset"], after, 3).collect()]:
        got += page
        after = list(page[-1])
    assert got == [(p, o) for p in range(4) for o in range(5)]


def test_functions(spark):
    row = spark.range(1).select(
        H.object_id("blob", F.lit("hello\n")).alias("oid"),
        H.mode_string(F.lit("100755")).alias("mode"),
        H.mode_kind(F.lit("120000")).alias("kind"),
        H.period_key(F.lit(1704067200), "w").alias("week"),
        H.period_key(F.lit(1704067201 + 6 * 86400), "w").alias("week2"),
        H.age(F.lit(100), 130).alias("age"),
        H.format_rfc2822(F.lit(0), F.lit("-0130")).alias("date"),
        H.text_lines(F.lit("a\nb\n")).alias("lines"),
        F.array_join(H.path_segments(F.lit("/a//./b%20c/../d+e")), "|").alias("path"),
        H.is_binary(F.lit("x" * 7999 + "\0")).alias("binary"),
        H.is_binary(F.lit("x" * 8000 + "\0")).alias("text"),
    ).first()
    assert row.oid == "ce013625030ba8dba906f756967f9e9ca394464a"
    assert (row.mode, row.kind, row.week, row.week2) == ("-rwxr-xr-x", "symlink", "2024-W01", "2024-W02")
    assert (row.age, row.date, row.lines, row.path) == ("1 min.", "Wed, 31 Dec 1969 22:30:00 -0130", ["a", "b"], "a|b c|d+e")
    assert row.binary and not row.text


def test_archive_parts(spark):
    files = spark.createDataFrame([("r", "a/b.txt", "100644", b"x" * 100), ("r", "../c", "100644", b"bad"), ("r", "l", "120000", b"a/b.txt"), ("r", "m", "120000", b"/etc")], "repo string, path string, mode string, data binary")
    row = snapshot.parts(files).first()
    assert (row.n_files, row.bytes, row.first_path, row.last_path) == (2, 107, "a/b.txt", "l")
    assert snapshot.parts(files, budget=50).count() == 2


def test_streams_over_shuffled_files_lose_nothing(spark, tmp_path):
    from annalist.plans import catalog

    # Files that are read newest first, so that older events and smaller numbers come in later batches.
    events = spark.read.parquet(f"{DATA}/events.parquet")
    cuts = [r.e for r in events.selectExpr("explode(approx_percentile(event_id, array(0.33, 0.66))) AS e").collect()]
    parts = [events.where(F.col("event_id") > cuts[1]), events.where(F.col("event_id").between(cuts[0] + 1, cuts[1])), events.where(F.col("event_id") <= cuts[0])]
    for part in parts:
        part.orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
        time.sleep(0.05)
    for d in (str(tmp_path), DATA):
        counts = {(r.window_start, r.event_type): r.pushes for r in catalog.queries()["stream_push_counts"](spark, d).collect()}
        expected = events.groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").count().collect()
        assert counts == {(r.day, r.event_type): r["count"] for r in expected}
        pushed = catalog.queries()["stream_compare_and_set"](spark, d)
        place = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
        rows = events.select("user_id", F.concat(F.lit("refs/heads/"), "event_type"), place, F.col("event_id") % 10 != 0)
        assert sorted((r.repo, r.ref, r.seq, r.ok) for r in pushed.collect()) == sorted(tuple(r) for r in rows.collect())


def test_compare_and_set_drops_only_replays(spark, tmp_path):
    from annalist.streaming import feeds

    schema = "repo long, ref string, batch string, seq long, old string, new string"
    zero = feeds.ZERO_OID
    steps = [[("b", 5, zero, "x"), ("b", 6, "x", "y")], [("b", 5, zero, "x")], [("a", 1, "y", "z"), ("a", 2, "y", "q")]]
    for step in steps:
        spark.createDataFrame([(1, "r", *row) for row in step], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = feeds.replay(feeds.compare_and_set(stream)).collect()
    assert sorted((r.seq, r.ok) for r in got) == [(1, True), (2, False), (5, True), (6, True)]


def test_blame_of_long_histories_and_files(spark):
    n = 230
    steps = [(1, i, f"c{i}", "a", i, "".join(f"l{k}\n" for k in range(n - i))) for i in range(n)]
    long = [(2, 0, "d", "a", 0, "".join(f"l{k}\n" for k in range(5001)))]
    history = spark.createDataFrame(steps + long, "repo long, ordinal long, oid string, author string, time long, text string")
    got = diff.blame(history).collect()
    assert {r.line_no: r.oid for r in got if r.repo == 1} == {k + 1: f"c{n - 1 - k}" for k in range(n)}
    assert sum(r.repo == 2 for r in got) == 5001


def test_edit_script_of_unlike_files_takes_milliseconds():
    old, new = [f"a{i}" for i in range(990)], [f"b{i}" for i in range(990)]
    began = time.process_time()
    scripts = [diff.edit_script(old, new) for _ in range(20)]
    assert time.process_time() - began < 1
    assert scripts[0] == [("del", x) for x in old] + [("add", x) for x in new]


def furthest_reaching(old, new):
    """The script of the greedy furthest reaching paths, path by path."""
    n, m, far, trace = len(old), len(new), {1: 0}, []
    while far.get(n - m) != n:
        d = len(trace)
        trace.append(dict(far))
        for k in range(-d, d + 1, 2):
            x = far[k + 1] if k == -d or (k != d and far[k - 1] < far[k + 1]) else far[k - 1] + 1
            while x < n and x - k < m and old[x] == new[x - k]:
                x += 1
            far[k] = x
    script, x, y = [], n, m
    for d in range(len(trace) - 1, 0, -1):
        k, before = x - y, trace[d]
        down = k == -d or (k != d and before[k - 1] < before[k + 1])
        at = before[k + 1] if down else before[k - 1]
        while x > at + (not down):
            x, y = x - 1, y - 1
            script.append(("eq", old[x]))
        x, y = (x, y - 1) if down else (x - 1, y)
        script.append(("add", new[y]) if down else ("del", old[x]))
    return (script + [("eq", line) for line in reversed(old[:x])])[::-1]


def test_scripts_by_bands_and_blocks_are_those_of_furthest_reaching_paths(monkeypatch):
    rng = random.Random(21)
    for _ in range(1500):
        words = [str(i) for i in range(rng.choice([1, 2, 3, 8, 60]))]
        old = rng.choices(words, k=rng.randrange(1, 70))
        new = rng.choices(words, k=rng.randrange(1, 70)) if rng.random() < 0.5 else [x for x in old if rng.random() < 0.9] + rng.choices([*words, "z"], k=3)
        for name, value in (("HELD_BITS", rng.choice([1, 64, 1000, 1 << 25])), ("BLOCK", rng.choice([1, 2, 7, 256])), ("PARTS", rng.choice([2, 3, 32]))):
            monkeypatch.setattr(diff, name, value)
        assert diff.shortest_script(old, new) == furthest_reaching(old, new)


def test_pairs_beyond_the_hosts_bounds_get_whole_scripts(spark):
    numbers = [str(i) for i in range(30_000)]
    long = numbers[:10] + ["in"] + numbers[10:29_000] + numbers[29_001:]  # over 40,000 lines together
    rows = [("lines", numbers, long), ("product", numbers[:3000], numbers[1:3000]), ("edits", ["x"] * 1500, ["y"] * 1500)]
    pairs = spark.createDataFrame([(p, "\n".join(a), "\n".join(b)) for p, a, b in rows], "path string, old string, new string")
    assert sorted(diff.diff_counts(pairs).select("path", "kind", "added", "deleted").collect()) == [("edits", "text", 1500, 1500), ("lines", "text", 1, 1), ("product", "text", 0, 1)]
    hunks = diff.diff_hunks(pairs).select("path", F.inline("hunks")).orderBy("path", "hunk").collect()
    assert [tuple(h)[:6] for h in hunks] == [("edits", 1, 1, 1500, 1, 1500), ("lines", 1, 8, 6, 8, 7), ("lines", 2, 28998, 7, 28999, 6), ("product", 1, 1, 4, 1, 3)]
    assert hunks[2].body == " 28997\n 28998\n 28999\n-29000\n 29001\n 29002\n 29003" and hunks[0].body == "\n".join(["-x"] * 1500 + ["+y"] * 1500)
    assert {r.path for r in diff.diff_lines(pairs).where("ops IS NOT NULL").collect()} == {"lines", "product", "edits"}


def test_blame_follows_lines_over_steps_beyond_the_hosts_bounds():
    older = [str(i) for i in range(3000)]
    assert diff.attribute(["\n".join([*older, "new"]), "\n".join(older)]) == [1] * 3000 + [0]


def test_counts_hunks_and_patches_of_rows_equal_those_of_scripts(spark):
    rng = random.Random(8)
    text = lambda: None if rng.random() < 0.1 else "\n".join(rng.choices("abcdefgh", k=rng.randrange(60)))
    some = [(f"p{i}", text(), text()) for i in range(60)]
    some += [(f"q{i}", "\n".join(map(str, range(90))), "\n".join(str(n) for n in range(90) if n % (11 + i))) for i in range(9)]
    some += [("bin", "a\0b", "a"), ("large", "\n".join(["x"] * 3000), "\n".join(["y"] * 3000))]
    pairs = spark.createDataFrame(some, "path string, old string, new string")
    scripts, whole = diff.diff_lines(pairs), diff.diff_hunks(pairs)
    assert sorted(diff.diffstat(scripts, "path").collect()) == sorted(diff.diff_counts(pairs).select("path", "kind", "added", "deleted").collect())
    rows = diff.hunks(diff.op_rows(scripts, "path"), "path")
    assert sorted(rows.collect()) == sorted(whole.select("path", F.inline("hunks")).collect())
    about = [F.lit(x).alias(c) for c, x in (("old_oid", "1" * 40), ("new_oid", "2" * 40), ("old_mode", "100644"), ("new_mode", "100644"))]
    expected = diff.patch(scripts.select("path", "kind", *about), rows)
    assert sorted(expected.collect()) == sorted(diff.patch_whole(whole.select("path", "kind", "hunks", *about)).collect())


def test_is_ancestor_by_order_equals_closures(spark, monkeypatch):
    rng = random.Random(12)
    rows, above = [], {}
    for repo in range(3):
        for i in range(45):
            oid = repo * 100 + i
            older = [repo * 100 + j for j in rng.sample(range(i), min(i, rng.choice([0, 1, 1, 1, 2, 3])))]
            above[oid] = {oid}.union(*(above[p] for p in older))
            rows += [(oid, n, p, i * 3) for n, p in enumerate(older or [None])]
    parents = spark.createDataFrame(rows, "oid long, nth int, parent long, order long")
    asked = [(a, d) for a in above for d in above if rng.random() < 0.15] + [(7, 7), (999, 1), (1, 999), (999, 999), (None, 1)]
    monkeypatch.setattr(graph, "_depths", None)  # no walk down to the roots
    got = {(r.anc, r.desc): r.is_ancestor for r in graph.is_ancestor(parents, spark.createDataFrame(asked, "anc long, desc long")).collect()}
    assert got == {(a, d): a is not None and a in above.get(d, {d}) for a, d in asked}


def test_stored_pushes_are_replayed_in_few_batches(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(feeds, "_folder", lambda _: f"file://{tmp_path}")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert activity.QUERIES["stream_compare_and_set"][0](spark, DATA).count() > 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([f for f in (tmp_path / "state" / "commits").iterdir() if f.name.isdigit()]) <= activity.BATCHES
