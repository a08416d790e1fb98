"""Operators against plain python on small inputs."""

import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators import assemble, graph, history, lookup, resolve, rows, similarity
from marlstone.plans import audit, judge, scope, solve
from marlstone.sources import code, documents, scan


def test_components_equal_union_find(spark):
    rnd = random.Random(3)
    for n, m in ((12, 6), (40, 45), (30, 0)):
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
        root = list(range(n))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        df = spark.createDataFrame(edges or [(0, 0)], "src long, dst long")
        got = {r.node: r.component for r in graph.components(df, spark.range(n).withColumnRenamed("id", "node")).collect()}
        assert got == {k: find(k) for k in range(n)}


def test_component_of_a_long_path(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(60)], "src long, dst long")
    assert {r.component for r in graph.components(df).collect()} == {0}


def test_expand_depth_zero_and_cycle(spark):
    e = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 1), (4, 5, 5)], "id long, src long, dst long")
    seed = spark.createDataFrame([(1,)], "node long")
    assert {(r.node, r.hops) for r in graph.expand(e, seed, 0).collect()} == {(1, 0)}
    assert {(r.node, r.hops) for r in graph.expand(e, seed, 5).collect()} == {(1, 0), (2, 1), (3, 1)}
    assert graph.edges_within(e, seed, 0).count() == 0
    assert {r.id for r in graph.edges_within(e, seed, 1).collect()} == {1, 3}


def test_levels_and_cycle(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("x",), ("y",)], "node string")
    needs = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "gone"), ("x", "y"), ("y", "x")], "node string, needs string")
    done, left = graph.levels(nodes, needs)
    assert {(r.node, r.level) for r in done.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {r.node for r in left.collect()} == {"x", "y"}
    assert {(r.kind, r.node) for r in graph.plan_warnings(nodes, needs).collect()} == {("dangling", "gone"), ("cycle", "x"), ("cycle", "y")}


def test_merge_touching_intervals(spark):
    df = spark.createDataFrame([(1, 0, 3), (1, 3, 5), (1, 7, 9), (2, 1, 1)], "k long, s long, e long")
    assert {tuple(r) for r in graph.merge_intervals(df, "k", "s", "e").select("k", "s", "e").collect()} == {(1, 0, 5), (1, 7, 9), (2, 1, 1)}


def test_first_fit_tries_later_items(spark):
    df = spark.createDataFrame([("g", 1, "a", 60), ("g", 2, "b", 50), ("g", 3, "c", 40), ("h", 1, "d", 200)], "g string, o int, item string, size long")
    kept = {r.item for r in assemble.first_fit(df, "g", ["o"], "item", "size", F.lit(100)).where("kept").collect()}
    assert kept == {"a", "c"}


def test_drop_levels_drops_whole_levels(spark):
    df = spark.createDataFrame([(1, "primary", 50), (1, "supporting", 40), (1, "type_context", 5), (1, "type_context", 30)], "g long, level string, n long")
    assert {r.level for r in assemble.drop_levels(df, "g", "level", "n", 100).collect()} == {"primary", "supporting"}


def test_lcs():
    def slow(a, b):
        t = [0] * (len(b) + 1)
        for x in a:
            d = 0
            for j, y in enumerate(b, 1):
                d, t[j] = t[j], d + 1 if x == y else max(t[j], t[j - 1])
        return t[-1]

    rnd = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc_é") for _ in range(rnd.randrange(9))) for _ in range(2))
        assert similarity.lcs(a, b) == slow(a, b)


def test_similar_pairs(spark):
    cols = "id long, file_id long, kind string, name string, lines long, callees array<string>, parent long"
    df = spark.createDataFrame([(1, 1, "function", "process_users", 20, ["validate"], None), (2, 1, "function", "process_items", 20, ["validate"], None), (3, 1, "function", "validate", 6, [], None), (4, 1, "class", "X", 9, [], None)], cols)
    got = similarity.similar_pairs(df, ["file_id", "kind"], 0.3).collect()
    assert (1, 2) in {(r.a, r.b) for r in got} and all(r.same_parent == 0 for r in got)
    assert similarity.similar_pairs(df, ["file_id", "kind"], 0.99).count() == 0


@pytest.mark.parametrize("size,ok", [(50, True), (51, False), (1, False)])
def test_co_changes_limits(spark, size, ok):
    df = spark.createDataFrame([(c, f) for c in (1, 2) for f in range(size)], "c long, f long")
    assert (history.co_changes(df, "c", "f").count() == len(list(combinations(range(size), 2)))) is (ok or size == 1)


def test_parse_log(spark):
    text = "abc\nAnn\nsubject\n2024-01-01T00:00:00Z\n\n3\t1\tsrc/a.py\n-\t-\tdocs\\b.md"
    r = spark.createDataFrame([(text,), ("abc\nAnn",)], "t string").select(history.parse_log(F.col("t")).alias("r")).collect()
    assert (r[0].r.insertions, r[0].r.deletions, r[0].r.files_changed, r[0].r.paths) == (3, 1, 2, ["src/a.py", "docs/b.md"]) and r[1].r is None


def test_sum_or_null_and_ratio(spark):
    df = spark.createDataFrame([(1, 2), (1, None), (2, 3)], "k int, v int")
    assert {r.k: r.s for r in df.groupBy("k").agg(rows.sum_or_null(F.col("v")).alias("s")).collect()} == {1: None, 2: 3}
    assert df.where("k = 9").agg(rows.sum_or_null(F.col("v")).alias("s"), rows.ratio_or(F.col("v"), F.col("v") > 0, 1.0).alias("r")).first() == (0, 1.0)


def test_mutations(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, k string, v string")
    new = spark.createDataFrame([("b", None), ("c", "z"), ("d", "w")], "k string, v string")
    assert {tuple(r) for r in rows.upsert(old, new, ["k"]).collect()} == {(1, "a", "x"), (2, "b", "y"), (3, "c", "z"), (4, "d", "w")}
    assert {tuple(r) for r in rows.replace_rows(old.drop("id"), new, ["k"]).collect()} == {("a", "x"), ("b", None), ("c", "z"), ("d", "w")}
    assert {r.k for r in rows.insert_ignore(old.select("k"), new.select("k"), ["k"]).collect()} == set("abcd")
    d = {r.k: r.status for r in lookup.diff(old, new, ["k"], "v").collect()}
    assert d == {"a": "removed", "b": "changed", "c": "new", "d": "new"}


def test_coverage_and_groups(spark):
    picks = spark.createDataFrame([(0,), (2,), (2,), (7,)], "i long")
    assert {tuple(r) for r in rows.coverage(3, picks, "i").collect()} == {(1, 0), (2, 2), (7, 1)}
    m = spark.createDataFrame([("g", 1), ("g", 2), ("h", 3), ("k", 9)], "g string, f long")
    assert {r.g for r in rows.incomplete_groups(m, spark.createDataFrame([(1,), (3,)], "f long"), "g", "f").collect()} == {"g"}


def test_coverage_across_blocks(spark):
    n, held = 300_000, [0, 65534, 65535, 65537, 65537, 131072, 199_999, 299_999, -1, -70_000, -70_000, 300_000, 900_000, 2**63 - 1, None]
    df = rows.coverage(n, spark.createDataFrame([(x,) for x in held], "i long"), "i")
    want = {(x, held.count(x)) for x in range(n) if held.count(x) != 1} | {(x, held.count(x)) for x in held if x is None or not 0 <= x < n}
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(want) and set(got) == want
    assert [str(f.dataType) for f in df.schema] == ["LongType()", "LongType()"]


def test_coverage_shuffles_no_range(spark):
    # What is generated before the shuffle is a mark a block, not every index.
    far = rows.coverage(10**9, spark.createDataFrame([(5,), (10**9 - 1,)], "i long"), "i")
    ranges = [int(x) for x in re.findall(r"Range \(0, (\d+)", far._jdf.queryExecution().optimizedPlan().toString())]
    assert sum(ranges) < 10**5


@pytest.mark.parametrize("ids", [[], [None], [2, None, 4, 4, -3], [-2, -2, -1]])
def test_coverage_query_equals_sql(spark, tmp_path, ids):
    from oracle import connect, same

    from marlstone import registry

    registry.load()
    spark.createDataFrame([(x,) for x in ids], "id long").coalesce(1).write.parquet(str(tmp_path / "t"))
    (tmp_path / "sf").mkdir()
    next((tmp_path / "t").glob("*.parquet")).rename(tmp_path / "sf" / "files.parquet")
    same(spark, connect(tmp_path / "sf"), str(tmp_path / "sf"), registry.QUERIES["a19_coverage"], registry.ORACLE["a19_coverage"])


def test_search_needs_a_filter(spark):
    f = spark.createDataFrame([(1, "p")], "file_id long, path string")
    m = spark.createDataFrame([(1, "d", "m", "50%_Off")], "file_id long, domain string, module string, concepts string")
    with pytest.raises(ValueError):
        lookup.search_metadata(f, m)
    assert lookup.search_metadata(f, m, domain="", concepts="0%_o").count() == 1
    assert lookup.search_metadata(f, m, concepts="0__o").count() == 0


def test_scope_tiers(spark):
    ids = "file_id long"
    edges = spark.createDataFrame([(1, 1, 2, "import"), (2, 3, 4, "import"), (3, 5, 1, "import")], "id long, src long, dst long, kind string")
    co = spark.createDataFrame([(1, 5, 5), (1, 4, 3), (1, 6, 1)], "a long, b long, n long")
    meta = spark.createDataFrame([(k, f"file{k} cache") for k in (1, 4, 6)], "file_id long, concepts string")
    words = spark.createDataFrame([("cache", 0)], "word string, pos int")
    none = spark.createDataFrame([], ids)
    got = {r.file_id: r.tier for r in scope.expand_scope(none, spark.createDataFrame([(1,)], ids), edges, co, meta, words).collect()}
    assert got == {1: 1, 2: 2, 5: 2, 4: 3, 6: 4}
    assert scope.expand_scope(none, none, edges, co, meta, words.limit(0)).count() == 0


def test_audit(spark):
    t = spark.createDataFrame([("a",), ("b",)], "task string")
    p = spark.createDataFrame([("a", "must", "src/x.py"), ("a", "must", "lib/*"), ("a", "must_not", "docs/*")], "task string, role string, pattern string")
    paths = spark.createDataFrame([("a", "lib/deep/y.py"), ("a", "docs/z.md")], "task string, path string")
    got = {r.task: (r.must_recall, r.should_recall, r.exclusion, r.task_score) for r in audit.scores(t, p, paths).collect()}
    assert got == {"a": (0.5, 1.0, 0.0, 0.0), "b": (1.0, 1.0, 1.0, 1.0)}


def test_judges_deny_by_default(spark):
    df = spark.createDataFrame([(1, "yes"), (2, "No."), (3, '{"verdict": "relevant"}'), (4, "maybe")], "id long, t string")
    got = {r.id: (r.verdict, r.omitted) for r in judge.by_answers(df, "t").collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (True, False), 4: (False, True)}

    def broken(b):
        raise ValueError

    assert {(r.verdict, r.omitted, r.failure) for r in judge.by_function(df, broken).collect()} == {(False, True, "ValueError: ")}


def test_keywords_are_worth_their_length_and_rank(spark):
    meta = spark.createDataFrame([(1, "registry"), (2, "a cache of tasks"), (3, "x"), (4, None)], "file_id long, concepts string")
    words = spark.createDataFrame([(w, k) for k, w in enumerate(["view", "cache", "task", "registry", "parser", "ledger", "go"])], "word string, pos int")
    # kept are registry, parser, ledger, cache, view: task and go have no place
    assert {(r.file_id, r.score) for r in scope.keyword_matches(meta, words).collect()} == {(1, 85), (2, 52)}
    few = spark.createDataFrame([("go", 0)], "word string, pos int")
    assert scope.keyword_matches(meta, few).count() == 0


def test_text_functions(spark):
    one = lambda c, **v: spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} string" for k in v)).select(c).first()[0]
    t = F.col("t")
    assert one(X.file_paths(t), t="see src/a.py, `b/c.ts` and (d.h)") == ["src/a.py", "b/c.ts", "d.h"]
    assert one(X.comment_kind(t), t="reason: x") == "general" and one(X.comment_kind(t), t="reason:x") == "rationale" and one(X.comment_kind(t), t="NOTE because") == "note"
    assert one(X.strip_thinking(t), t="a<think>x</think>b</think>c") == "ac" and one(X.strip_thinking(t), t="<think>open") == ""
    assert one(X.slug(t), t="  The C++ Way -- of  Life! ") == "the_c_way_of_life"
    assert one(X.include_line(t, F.lit("<a.h>")), t="#include <b.h>\nint x;") == "#include <b.h>\n#include <a.h>\nint x;"
    assert one(X.undeclared_symbols(t), t="error: 'malloc' undeclared; unknown type name 'size_t'") == ["malloc", "size_t"]
    assert one(X.undeclared_symbols(t), t="use of undeclared identifier 'x', 'y' undeclared") == []
    assert one(X.error_lines(t), t="a\nValueError: b\nfailed c\nTraceback\nd") == ["ValueError: b", "Traceback\nd"]
    assert one(X.keywords(t), t="Fix the FooBar crash in src/a.py with über_x and café quickly") == ["fix", "crash", "src", "café", "quickly"]
    assert one(X.task_type(t), t="add a test") == "feature" and one(X.task_type(t), t="Fix the new feature") == "bug_fix" and one(X.task_type(t), t="write unittest") == "test" and one(X.task_type(t), t="hello") == "unknown"
    assert one(X.failure_category(t), t="x.c:1: error: 'a' expected") == "compile_error" and one(X.failure_category(t), t="1 failed, FAIL") == "test_failure" and one(X.failure_category(t), t="search text not found") == "patch_failure" and one(X.failure_category(t), t="fine") == "unknown"
    assert one(X.failing_tests(t), t="FAIL a.test\nFAILED t.py::b - x\nFAILED t.py::c") == ["t.py::b", "t.py::c"] and one(X.failing_tests(t), t="FAIL a.test") == ["a.test"]
    assert one(X.fence_for(t), t="a ```` b") == "`````"


def test_edits_must_match_once(spark):
    texts = spark.createDataFrame([("a", "x y x"), ("b", "p q")], "path string, content string")
    edits = spark.createDataFrame([("a", 1, "x", "z"), ("b", 1, "p", "pp"), ("b", 2, "pp q", "done")], "path string, pos int, search string, replace string")
    got = {r.path: (r.content, r.ok) for r in solve.simulate_edits(texts, edits).collect()}
    assert got == {"a": ("x y x", False), "b": ("done", True)}


def test_import_candidates(spark):
    df = spark.createDataFrame([("a.b", ["c"], "../x", "src/d/e.ts", "@app/q")], "m string, n array<string>, j string, p string, al string")
    r = df.select(resolve.python_candidates(F.col("m"), F.col("n")).alias("py"), resolve.js_candidates(F.col("j"), F.col("p")).alias("js"), resolve.alias_candidates(F.col("al"), {"@app/*": ["src/*"]}, "base").alias("al"), resolve.python_relative_base(F.lit("a/b/c.py"), F.lit(2)).alias("base")).first()
    assert r.py == ["a/b.py", "a/b/__init__.py", "a/b/c.py", "a/b/c/__init__.py"] and "src/x.ts" in r.js and r.al == ["src/q"] and r.base == "a"


def test_python_rows():
    text = 'import os\nfrom .a import b\nX = 1\n\n@dec\ndef f(a,\n      b=2) -> int:\n    """Doc."""\n    def inner(): pass\n    return g(a).h  # note\n\nclass C(Base):\n    def m(self): return os.x\n'
    rows_ = code.rows_of(text)
    syms = {(r[1], r[2], r[3], r[5]) for r in rows_ if r[0] == "symbol"}
    assert syms == {("f", "function", 5, None), ("C", "class", 12, None), ("m", "method", 13, "C"), ("X", "variable", 3, None)}
    assert {r[6] for r in rows_ if r[0] == "symbol" and r[1] == "f"} == {"def f(a, b=2) -> int:"}
    assert {(r[1], r[2]) for r in rows_ if r[0] == "reference" and r[5] == "f"} >= {("g", "call"), ("h", "attribute")}
    assert code.rows_of("def broken(") == []


def test_docs_only(spark):
    df = spark.createDataFrame([("x = 1  # a\n", "x = 1\n"), ("x = 1", "x = 2"), ('def f():\n    """A."""\n    return 1\n', "def f():\n    # b\n    return 1\n")], "a string, b string")
    assert [r.docs_only for r in code.docs_only(df, "a", "b").collect()] == [True, False, True]


def test_sections(spark):
    text = "intro\n# A b\none\n## C\ntwo\n### D\n\n## E\nthree\n# F\nfour"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "i long, t string")
    got = [(r.level, r.title, r.path, r.parent, r.content) for r in documents.headed_sections(df, "i", "t").orderBy("no").collect()]
    assert got == [(1, "A b", "a_b", None, "one"), (2, "C", "a_b/c", 1, "two"), (2, "E", "a_b/e", 1, "three"), (1, "F", "f", None, "four")]
    rules = spark.createDataFrame([(1, "## Rule 01\n- ABC01-C: Do it\n- no rule\n## Rule 02\n- DEF02-C. Don't")], "i long, t string")
    assert [(r.category, r.rule, r.title) for r in documents.rule_list(rules, "i", "t").orderBy("line").collect()] == [("Rule 01", "ABC01-C", "Do it"), ("Rule 02", "DEF02-C", "Don't")]


def test_html(spark):
    df = spark.createDataFrame([(1, "<nav>menu</nav><h1>T &amp; U</h1><p>a b</p><pre>x = 1</pre><ul><li>i</li></ul>")], "i long, h string")
    r = documents.html_sections(df, "i", "h").collect()
    assert (r[0].title, r[0].level) == ("T & U", 1) and "menu" not in r[0].content and "```\nx = 1\n```" in r[0].content and "- i" in r[0].content


def test_scan(spark, tmp_path):
    for name, body in {"src/a.py": "x", "src/b.min.js": "y", "node_modules/c.js": "z", "d.txt": "t", "gen/e.ts": "e", "keep/f.h": "f"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    got = {(r.path, r.language, r.size_bytes) for r in scan.scan_repo(spark, str(tmp_path), gitignore="gen/\n").collect()}
    assert got == {("src/a.py", "python", 1), ("keep/f.h", "c", 1)}
    lib = {(r.path, r.skip_reason) for r in scan.scan_library(spark, str(tmp_path), "pkg").collect()}
    assert lib == {("pkg/src/a.py", None)}


def test_reference_tasks(spark, tmp_path):
    body = '[task]\nid = "t1"\ndescription = "d"\ntask_type = "bug_fix"\n[context_requirements]\nmust_contain_files = ["a"]\n[routing_notes]\nreasoning = ""\n'
    (tmp_path / "a.toml").write_text(body)
    assert scan.reference_tasks(spark, str(tmp_path)).first().must == ["a"]
    (tmp_path / "b.toml").write_text(body)
    with pytest.raises(ValueError, match="again"):
        scan.reference_tasks(spark, str(tmp_path))


def test_catalog_swap(spark, tmp_path):
    from marlstone.catalog import Catalog

    c = Catalog(spark, str(tmp_path))
    c.replace("t", spark.range(3))
    c.replace("t", spark.range(5))
    c.append("t", spark.range(2))
    assert c.table("t").count() == 7
