"""Operators that no registered query calls, with literals."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators import rows
from marlstone.plans import audit, judge, scope, solve
from marlstone.sources import scan


def test_edits(spark):
    answer = 'a\n<edit file="x.py">\n<search>\nold\n</search>\n<replacement>\nnew\n</replacement>\n</edit>\n<edit file="y.py"><search>p</search><replacement></replacement></edit>'
    df = spark.createDataFrame([(answer,), ("none",), (None,)], "t string")
    got = [r[0] for r in df.select(X.edit_blocks(F.col("t"))).collect()]
    assert [[(e.path, e.search, e.replace) for e in g or []] for g in got] == [[("x.py", "old", "new"), ("y.py", "p", "")], [], []]
    edits = spark.createDataFrame([("x", 1, "a\nb", "c"), ("x", 0, "d", "")], "path string, pos int, search string, replace string")
    assert solve.unified_text(edits).collect()[0].text == "--- a/x\n+++ b/x\n-d\n+\n--- a/x\n+++ b/x\n-a\n-b\n+c"


def test_decisions_and_routes(spark):
    log = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 3, "c")], "file_id long, stage int, said string")
    assert {(r.file_id, r.said) for r in scope.merge_decisions(log).collect()} == {(1, "a"), (2, "c")}
    stages = spark.createDataFrame([("scope", "reason"), ("plan", "reason")], "stage string, role string")
    config = spark.createDataFrame([("scope", "m1"), ("reason", "m2")], "name string, model string")
    assert {(r.stage, r.model) for r in judge.route(stages, config).collect()} == {("scope", "m1"), ("plan", "m2")}
    with pytest.raises(PySparkException):
        judge.route(stages, config.limit(0)).collect()
    judged = spark.createDataFrame([(1, False), (2, True)], "id long, omitted boolean")
    assert judge.assert_none_omitted(judged.where("id = 1"), "x").count() == 1
    with pytest.raises(PySparkException):
        judge.assert_none_omitted(judged, "x").collect()


def test_small_columns(spark):
    grouped = spark.createDataFrame([(1, 1, None), (1, 2, 5), (1, 3, None)], "g int, k int, v int")
    assert [r.x for r in grouped.select("k", rows.last_not_null("v", "k", by=["g"]).alias("x")).orderBy("k").collect()] == [None, 5, 5]
    one = spark.createDataFrame([("50%_a\\b", 3.0, 0, 4)], "s string, total double, none int, budget int")
    got = one.select(X.like_escape(F.col("s")), audit.utilisation(F.col("total"), F.col("none")), audit.utilisation(F.col("total"), F.col("budget"))).first()
    assert tuple(got) == ("50\\%\\_a\\\\b", 0.0, 0.75)


def test_files_on_the_driver(spark, tmp_path):
    (tmp_path / "plan.json").write_text(json.dumps({"affected_files": ["a.py", {"path": "b.py"}]}))
    assert scan.plan_files(spark, str(tmp_path / "plan.json")) == ["a.py", "b.py"]
    (tmp_path / "c.toml").write_text("[testing]\ntimeout = 3\n")
    assert scan.load_config(str(tmp_path / "c.toml")) == {"testing": {"timeout": 3}} and scan.load_config(str(tmp_path / "none.toml")) == {}
    (tmp_path / "log.txt").write_text("h1\nann\nfix\n2024-01-01\n3\t1\ta\\b.py\n-\t-\tc.bin\n---commit---\nh2\nbob\nadd\n2024-01-02\n---commit---\nbroken\n")
    got = {r.hash: (r.author, r.insertions, r.deletions, r.files_changed, r.paths) for r in scan.read_log(spark, str(tmp_path / "log.txt")).collect()}
    assert got == {"h1": ("ann", 3, 1, 2, ["a/b.py", "c.bin"]), "h2": ("bob", 0, 0, 0, [])}
