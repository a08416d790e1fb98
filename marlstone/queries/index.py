"""Queries over the index tables: lookups, neighbours, aggregates, top-k, set operations, mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.catalog import table
from marlstone.operators import lookup, rows
from marlstone.registry import query


def files(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "files").select(F.col("id").alias("file_id"), "repo_id", "path", "language", "content_hash", "size_bytes", "file_source").distinct()


def symbols(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "symbols").withColumn("kind", F.lower(F.trim("kind"))).distinct()


def commits(s: SparkSession, d: str, *only: str) -> DataFrame:
    """One row per (repo_id, hash): the least id; of the other columns those named, else all."""
    c = table(s, d, "commits")
    # The fold keeps a row as one struct, out of which no optimizer takes columns that aren't needed.
    kept = [x for x in c.columns if x not in ("repo_id", "hash") and (not only or x in only)]
    return c.groupBy("repo_id", "hash").agg(F.min_by(F.struct(*kept), "id").alias("r")).select("repo_id", "hash", "r.*")


def commit_files(s: SparkSession, d: str) -> DataFrame:
    """Distinct (commit_id, repo_id, path) with normalised paths."""
    path = F.regexp_replace(F.translate("p", "\\", "/"), r"^(\./)+", "")
    return commits(s, d, "id", "authored_at", "changed_files").select(F.col("id").alias("commit_id"), "repo_id", "authored_at", F.explode("changed_files").alias("p")).select("commit_id", "repo_id", "authored_at", path.alias("path")).where("path <> ''").distinct()


def edges(s: SparkSession, d: str) -> DataFrame:
    """A directed graph of files: the first path of a commit depends on the second; parallel edges stay."""
    c = commits(s, d, "id", "changed_files").select("id", "repo_id", F.transform("changed_files", lambda p: F.regexp_replace(F.translate(p, "\\", "/"), r"^(\./)+", "")).alias("p")).where("size(p) >= 2")
    f = files(s, d).select("repo_id", "path", "file_id").groupBy("repo_id", "path").agg(F.min("file_id").alias("fid"))
    e = c.select("id", "repo_id", F.element_at("p", 1).alias("pa"), F.element_at("p", 2).alias("pb"))
    return e.join(f.select("repo_id", F.col("path").alias("pa"), F.col("fid").alias("src")), ["repo_id", "pa"]).join(f.select("repo_id", F.col("path").alias("pb"), F.col("fid").alias("dst")), ["repo_id", "pb"]).select("id", "src", "dst", F.when(F.col("id") % 3 == 0, "type_ref").otherwise("import").alias("kind"))


FILES = "f AS (SELECT DISTINCT id AS file_id, repo_id, path, language, content_hash, size_bytes, file_source FROM files)"
SYMBOLS = "s AS (SELECT DISTINCT id, file_id, name, lower(trim(kind)) AS kind, start_line, end_line, signature, parent_symbol_id FROM symbols)"
COMMITS = "c AS (SELECT * FROM commits QUALIFY row_number() OVER (PARTITION BY repo_id, hash ORDER BY id) = 1)"
CF = COMMITS + r", cf AS (SELECT DISTINCT commit_id, repo_id, authored_at, path FROM (SELECT id AS commit_id, repo_id, authored_at, regexp_replace(replace(p, '\', '/'), '^(\./)+', '') AS path FROM (SELECT id, repo_id, authored_at, unnest(changed_files) AS p FROM c)) WHERE path <> '')"
EDGES = FILES + ", " + COMMITS + r""", fm AS (SELECT repo_id, path, min(file_id) AS fid FROM f GROUP BY 1, 2),
 e0 AS (SELECT id, repo_id, regexp_replace(replace(changed_files[1], '\', '/'), '^(\./)+', '') AS pa, regexp_replace(replace(changed_files[2], '\', '/'), '^(\./)+', '') AS pb FROM c WHERE len(changed_files) >= 2),
 e AS (SELECT id, a.fid AS src, b.fid AS dst, CASE WHEN id % 3 = 0 THEN 'type_ref' ELSE 'import' END AS kind FROM e0 JOIN fm a ON a.repo_id = e0.repo_id AND a.path = pa JOIN fm b ON b.repo_id = e0.repo_id AND b.path = pb)"""


@query("q1_files_by_language", f"WITH {FILES} SELECT file_id, path FROM f WHERE repo_id = 3 AND language = 'python'")
def q1(s, d):
    return lookup.files_of(files(s, d), 3, "python").select("file_id", "path")


@query("q2_lookup_batch", f"WITH {FILES} SELECT f.* FROM f WHERE file_id IN (SELECT DISTINCT file_id FROM inline_comments WHERE is_rationale)")
def q2(s, d):
    return lookup.by_keys(files(s, d), table(s, d, "inline_comments").where("is_rationale").select("file_id"), ["file_id"])


@query("q3_search_metadata", f"WITH {FILES} SELECT file_id, path FROM f WHERE split_part(path, '/', 1) = 'src' AND contains(lower(path), 'cache')")
def q3(s, d):
    f = files(s, d)
    meta = f.select("file_id", F.split_part("path", F.lit("/"), F.lit(1)).alias("domain"), F.split_part("path", F.lit("/"), F.lit(2)).alias("module"), F.col("path").alias("concepts"))
    return lookup.search_metadata(f.select("file_id", "path"), meta, domain="src", module="", concepts="Cache").select("file_id", "path")


@query("q4_library_files", f"WITH {FILES} SELECT repo_id, file_id FROM f WHERE file_source = 'library'")
def q4(s, d):
    return files(s, d).where("file_source = 'library'").select("repo_id", "file_id")


@query("q6_symbols_of_kind", f"WITH {SYMBOLS} SELECT id, file_id, name FROM s WHERE kind = 'method'")
def q6(s, d):
    return symbols(s, d).where("kind = 'method'").select("id", "file_id", "name")


@query("q7_symbols_by_name", f"WITH {SYMBOLS}, {FILES} SELECT id, name, path FROM s JOIN f USING (file_id) WHERE name ILIKE '%audit!_%' ESCAPE '!'")
def q7(s, d):
    return lookup.symbols_by_name(symbols(s, d), files(s, d).select("file_id", "path"), "Audit_").select("id", "name", "path")


@query("q8_neighbours", f"WITH {EDGES} SELECT src AS key, dst AS neighbour FROM e WHERE kind = 'import' AND src IN (SELECT file_id FROM f WHERE language = 'python')")
def q8(s, d):
    keys = files(s, d).where("language = 'python'").select(F.col("file_id").alias("key"))
    return lookup.neighbours(edges(s, d), keys, "out", kinds=["import"])


@query("q9_imported_by", f"WITH {EDGES} SELECT dst AS key, src AS neighbour FROM e")
def q9(s, d):
    e = edges(s, d)
    return lookup.neighbours(e, e.select(F.col("dst").alias("key")), "in")


@query("q12_rationale_comments", "SELECT DISTINCT id, file_id, line FROM inline_comments WHERE is_rationale")
def q12(s, d):
    return table(s, d, "inline_comments").where("is_rationale").select("id", "file_id", "line").distinct()


@query("q13_recent_commits", f"WITH {CF} SELECT repo_id, path, commit_id, CAST(rn AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY authored_at::TIMESTAMPTZ DESC, commit_id DESC) AS rn FROM cf) WHERE rn <= 10")
def q13(s, d):
    cf = commit_files(s, d).withColumn("at", F.to_timestamp("authored_at"))
    return lookup.top_per_key(cf, ["repo_id", "path"], [F.desc("at"), F.desc("commit_id")], 10).select("repo_id", "path", "commit_id", F.col("rank").cast("long").alias("rank"))


@query("q13_recent_commits_as_text", f"WITH {CF} SELECT repo_id, path, commit_id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY authored_at DESC, commit_id DESC) AS rn FROM cf) WHERE rn <= 10")
def q13_text(s, d):
    return lookup.top_per_key(commit_files(s, d), ["repo_id", "path"], [F.desc("authored_at"), F.desc("commit_id")], 10).select("repo_id", "path", "commit_id")


@query(
    "q14_file_context",
    f"""WITH {EDGES}, {SYMBOLS}, cf AS (SELECT DISTINCT fm.fid AS file_id, c.id AS commit_id FROM c JOIN fm ON c.repo_id = fm.repo_id AND list_contains(c.changed_files, fm.path)),
    x1 AS (SELECT file_id, list_sort(list(DISTINCT name)) AS v FROM s GROUP BY 1), x2 AS (SELECT file_id, list_sort(list(DISTINCT id)) AS v FROM docstrings GROUP BY 1),
    x3 AS (SELECT file_id, list_sort(list(DISTINCT id)) AS v FROM inline_comments WHERE is_rationale GROUP BY 1), x4 AS (SELECT src AS file_id, list_sort(list(DISTINCT dst)) AS v FROM e GROUP BY 1),
    x5 AS (SELECT file_id, list_sort(list(DISTINCT commit_id)) AS v FROM cf GROUP BY 1)
    SELECT f.file_id, path, coalesce(x1.v, []) AS symbols, coalesce(x2.v, []) AS docstrings, coalesce(x3.v, []) AS rationale, coalesce(x4.v, []) AS imports, coalesce(x5.v, []) AS commits
    FROM f LEFT JOIN x1 USING (file_id) LEFT JOIN x2 USING (file_id) LEFT JOIN x3 USING (file_id) LEFT JOIN x4 USING (file_id) LEFT JOIN x5 USING (file_id)""",
)
def q14(s, d):
    f = files(s, d)
    fm = f.groupBy("repo_id", "path").agg(F.min("file_id").alias("file_id"))
    c = commits(s, d).select(F.col("id").alias("commit_id"), "repo_id", F.explode("changed_files").alias("path")).join(fm, ["repo_id", "path"]).select("file_id", "commit_id")
    e = edges(s, d).select(F.col("src").alias("file_id"), "dst")
    return lookup.file_context(f, symbols(s, d), table(s, d, "docstrings"), table(s, d, "inline_comments"), e, c)


@query("q15_repo_overview", f"WITH {FILES} SELECT repo_id, count(*) AS files, count(*) FILTER (language = 'python') AS python, count(*) FILTER (language = 'c') AS c, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM f GROUP BY 1")
def q15(s, d):
    return files(s, d).groupBy("repo_id").agg(F.count("*").alias("files"), F.count_if(F.col("language") == "python").alias("python"), F.count_if(F.col("language") == "c").alias("c"), F.sum("size_bytes").alias("bytes"))


@query("q16_latest_per_stage", "SELECT stage_name, max_by(model, (logged_at, id)) AS model FROM retrieval_llm_calls WHERE stage_name IS NOT NULL GROUP BY 1")
def q16(s, d):
    return lookup.latest(table(s, d, "retrieval_llm_calls").where("stage_name is not null").select("stage_name", "model", "logged_at", "id"), ["stage_name"], ["logged_at", "id"]).select("stage_name", "model")


@query("q17_section_of_file", r"SELECT DISTINCT id AS file_id, regexp_extract(path, '^kb/([^/]+)/(.+)$', 1) AS source, regexp_extract(path, '^kb/([^/]+)/(.+)$', 2) AS section FROM files WHERE path LIKE 'kb/%/%'")
def q17(s, d):
    part = lambda k: F.regexp_extract("path", r"^kb/([^/]+)/(.+)$", k)
    return files(s, d).where("path like 'kb/%/%'").select("file_id", part(1).alias("source"), part(2).alias("section"))


@query("q19_preflight", "SELECT (SELECT count(*) > 0 FROM files) AS has_files, (SELECT count(*) > 0 FROM symbols) AS has_symbols, (SELECT count(*) > 0 FROM commits WHERE files_changed > 1000000) AS has_giant_commits")
def q19(s, d):
    some = lambda df: not df.isEmpty()
    row = (some(table(s, d, "files")), some(table(s, d, "symbols")), some(table(s, d, "commits").where("files_changed > 1000000")))
    return s.range(1).select(*[F.lit(v).alias(n) for v, n in zip(row, ("has_files", "has_symbols", "has_giant_commits"))])


@query("a2_language_counts", f"WITH {FILES} SELECT language, count(*) AS n FROM f GROUP BY 1")
def a2(s, d):
    return files(s, d).groupBy("language").agg(F.count("*").alias("n"))


@query("a3_domain_counts", f"WITH {FILES} SELECT split_part(path, '/', 1) AS domain, count(*) AS n FROM f WHERE contains(path, '/') GROUP BY 1")
def a3(s, d):
    return files(s, d).where(F.contains("path", F.lit("/"))).groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("domain")).agg(F.count("*").alias("n"))


@query("a4_degree_top10", f"WITH {EDGES}, g AS (SELECT unnest([src, dst]) AS node FROM e) SELECT f.file_id AS node, count(g.node) AS degree FROM f LEFT JOIN g ON g.node = f.file_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def a4(s, d):
    return lookup.degree(files(s, d).select(F.col("file_id").alias("node")), edges(s, d), 10)


@query(
    "a5_co_changes",
    f"""WITH {CF}, {FILES}, t AS (SELECT DISTINCT cf.commit_id, f.file_id FROM cf JOIN f ON f.repo_id = cf.repo_id AND f.path = cf.path),
    w AS (SELECT commit_id FROM t GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50)
    SELECT x.file_id AS a, y.file_id AS b, count(*) AS n FROM t x JOIN t y ON x.commit_id = y.commit_id AND x.file_id < y.file_id WHERE x.commit_id IN (SELECT commit_id FROM w) GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def a5(s, d):
    from marlstone.operators.history import co_changes

    tracked = commit_files(s, d).join(files(s, d).select("repo_id", "path", "file_id"), ["repo_id", "path"]).select("commit_id", "file_id").distinct()
    return co_changes(tracked, "commit_id", "file_id")


@query("a6_commits_of_file", f"WITH {CF} SELECT repo_id, path, list_sort(list(commit_id)) AS commits FROM cf GROUP BY 1, 2")
def a6(s, d):
    return commit_files(s, d).groupBy("repo_id", "path").agg(F.sort_array(F.collect_list("commit_id")).alias("commits"))


@query("a7_commit_sums", f"WITH {COMMITS} SELECT repo_id, CAST(sum(insertions) AS BIGINT) AS ins, CAST(sum(deletions) AS BIGINT) AS del, CAST(coalesce(sum(files_changed), 0) AS BIGINT) AS changed FROM c GROUP BY 1")
def a7(s, d):
    return commits(s, d).groupBy("repo_id").agg(F.sum("insertions").alias("ins"), F.sum("deletions").alias("del"), F.coalesce(F.sum("files_changed"), F.lit(0)).cast("long").alias("changed"))


@query("a8_sum_or_null", "SELECT task_id, CASE WHEN count(*) = count(prompt_tokens) THEN CAST(sum(prompt_tokens) AS BIGINT) END AS prompt_tokens, CAST(sum(latency_ms) AS BIGINT) AS latency_ms FROM (SELECT DISTINCT id, task_id, prompt_tokens, latency_ms FROM retrieval_llm_calls) GROUP BY 1")
def a8(s, d):
    calls = table(s, d, "retrieval_llm_calls").select("id", "task_id", "prompt_tokens", "latency_ms").distinct()
    return calls.groupBy("task_id").agg(rows.sum_or_null(F.col("prompt_tokens")).cast("long").alias("prompt_tokens"), F.sum("latency_ms").alias("latency_ms"))


@query("a9_answered_share", "SELECT model, round(coalesce(avg(CASE WHEN response <> '' THEN 1.0 ELSE 0.0 END), 1.0), 6) AS answered FROM retrieval_llm_calls GROUP BY 1")
def a9(s, d):
    return table(s, d, "retrieval_llm_calls").groupBy("model").agg(F.round(rows.ratio_or(F.col("response"), F.col("response") != "", 1.0), 6).alias("answered"))


@query("a13_run_counters", "SELECT repo_id, CAST(sum(files_new) AS BIGINT) AS files_new, CAST(sum(files_changed) AS BIGINT) AS changed, count(*) FILTER (status = 'success') AS good FROM index_runs GROUP BY 1")
def a13(s, d):
    return table(s, d, "index_runs").groupBy("repo_id").agg(F.sum("files_new").alias("files_new"), F.sum("files_changed").alias("changed"), F.count_if(F.col("status") == "success").alias("good"))


@query("a15_best_score", f"WITH {EDGES} SELECT dst AS file_id, max_by(id, (-abs(id % 7), -id)) AS edge FROM e GROUP BY 1")
def a15(s, d):
    e = edges(s, d).select(F.col("dst").alias("file_id"), F.col("id").alias("edge"), (-(F.col("id") % 7)).alias("score"))
    return rows.best_per_key(e, ["file_id"], "score", "edge").select("file_id", "edge")


@query("a16_name_sets", f"WITH {SYMBOLS} SELECT parent_symbol_id AS symbol_id, list_sort(list(DISTINCT name)) AS names FROM s WHERE parent_symbol_id IS NOT NULL GROUP BY 1")
def a16(s, d):
    return symbols(s, d).where("parent_symbol_id is not null").groupBy(F.col("parent_symbol_id").alias("symbol_id")).agg(F.sort_array(F.collect_set("name")).alias("names"))


@query(
    "a17_incomplete_groups",
    f"WITH {CF}, {FILES} SELECT commit_id FROM (SELECT cf.commit_id, cf.path, max(CASE WHEN f.file_id IS NULL THEN 0 ELSE 1 END) AS k FROM cf LEFT JOIN f ON f.path = cf.path GROUP BY 1, 2) GROUP BY 1 HAVING sum(k) > 0 AND sum(k) < count(*)",
)
def a17(s, d):
    return rows.incomplete_groups(commit_files(s, d).select("commit_id", "path"), files(s, d).select("path"), "commit_id", "path")


@query("a18_duplicate_keys", "SELECT repo_id, hash, count(*) AS n FROM commits GROUP BY 1, 2 HAVING count(*) > 1")
def a18(s, d):
    return table(s, d, "commits").groupBy("repo_id", "hash").agg(F.count("*").alias("n")).where("n > 1")


@query("a19_coverage", "WITH p AS (SELECT id, count(*) AS times FROM files GROUP BY 1), r AS (SELECT CAST(range AS BIGINT) AS idx FROM range((SELECT CAST(max(id) AS BIGINT) + 1 FROM files))) SELECT coalesce(idx, id) AS idx, coalesce(times, 0) AS times FROM r FULL JOIN p ON idx = id WHERE coalesce(times, 0) <> 1 OR idx IS NULL")
def a19(s, d):
    f = table(s, d, "files")
    return rows.coverage(f.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0] + 1, f, "id")


@query("a20_fan_in", f"WITH {EDGES}, seed AS (SELECT file_id FROM f WHERE file_source = 'project' AND language = 'c') SELECT dst AS file_id, count(DISTINCT src) AS score FROM e WHERE src IN (SELECT file_id FROM seed) AND dst NOT IN (SELECT file_id FROM seed) GROUP BY 1")
def a20(s, d):
    seed = files(s, d).where("file_source = 'project' and language = 'c'").select("file_id")
    e = edges(s, d).join(seed.withColumnRenamed("file_id", "src"), "src", "left_semi").join(seed.withColumnRenamed("file_id", "dst"), "dst", "left_anti")
    return e.groupBy(F.col("dst").alias("file_id")).agg(F.countDistinct("src").alias("score"))


@query("a21_run_status", "SELECT repo_id, CASE WHEN bool_and(status = 'success') THEN 'complete' WHEN bool_or(status = 'success') THEN 'partial' ELSE 'failed' END AS status FROM index_runs GROUP BY 1")
def a21(s, d):
    return table(s, d, "index_runs").groupBy("repo_id").agg(rows.run_status(F.col("status") == "success").alias("status"))


@query("a22_call_totals", "SELECT call_type, CASE WHEN count(*) = count(completion_tokens) THEN CAST(sum(completion_tokens) AS BIGINT) END AS tokens, count(*) AS n FROM retrieval_llm_calls GROUP BY 1")
def a22(s, d):
    return table(s, d, "retrieval_llm_calls").groupBy("call_type").agg(rows.sum_or_null(F.col("completion_tokens")).cast("long").alias("tokens"), F.count("*").alias("n"))


@query("a23_last_outcome", "SELECT repo_id, arg_max(status, (run_at, id)) AS status FROM index_runs GROUP BY 1")
def a23(s, d):
    return lookup.latest(table(s, d, "index_runs").select("repo_id", "status", "run_at", "id"), ["repo_id"], ["run_at", "id"]).select("repo_id", "status")


@query("t1_top_files_by_size", f"WITH {FILES} SELECT file_id, size_bytes FROM f ORDER BY size_bytes DESC, file_id LIMIT 25")
def t1(s, d):
    return files(s, d).select("file_id", "size_bytes").orderBy(F.desc("size_bytes"), "file_id").limit(25)


@query("t4_top_neighbours", f"WITH {EDGES} SELECT src, dst FROM (SELECT DISTINCT src, dst, path, language FROM e JOIN f ON f.file_id = dst) QUALIFY row_number() OVER (PARTITION BY src ORDER BY (language <> 'python'), path, dst) <= 5")
def t4(s, d):
    e = edges(s, d).select("src", "dst").distinct().join(files(s, d).select(F.col("file_id").alias("dst"), "path", "language"), "dst")
    return lookup.top_per_key(e, ["src"], [(F.col("language") != "python"), F.col("path"), F.col("dst")], 5).select("src", "dst")


@query(
    "t5_symbol_matches",
    f"WITH {SYMBOLS}, q AS (SELECT DISTINCT left(name, 9) AS term FROM s WHERE length(name) > 9 AND kind = 'class'), m AS (SELECT term, id, name, file_id, start_line, (lower(name) = lower(term)) AS exact FROM q JOIN s ON starts_with(lower(name), lower(term))), x AS (SELECT *, bool_or(exact) OVER (PARTITION BY term) AS hit FROM m) SELECT term, id FROM x WHERE exact OR NOT hit QUALIFY row_number() OVER (PARTITION BY term ORDER BY CASE WHEN hit THEN file_id ELSE length(name) END, CASE WHEN hit THEN start_line ELSE id END, id) <= 10",
)
def t5(s, d):
    sym = symbols(s, d)
    terms = sym.where("length(name) > 9 and kind = 'class'").select(F.substring("name", 1, 9).alias("term")).distinct()
    # The prefix itself is the join key: an equi-join, no comparison of all names with all terms.
    m = terms.join(sym, F.lower("term") == F.lower(F.substring("name", 1, 9)))
    exact = F.lower("name") == F.lower("term")
    m = m.withColumn("exact", exact).withColumn("some", F.max("exact").over(Window.partitionBy("term"))).where("exact or not some")
    order = [F.when(F.col("some"), F.col("file_id")).otherwise(F.length("name")), F.when(F.col("some"), F.col("start_line")).otherwise(F.col("id")), F.col("id")]
    return lookup.top_per_key(m, ["term"], order, 10).select("term", "id")


@query("j1_inner", f"WITH {SYMBOLS}, {FILES} SELECT kind, language, count(*) AS n FROM s JOIN f USING (file_id) GROUP BY 1, 2")
def j1(s, d):
    return symbols(s, d).join(files(s, d).select("file_id", "language"), "file_id").groupBy("kind", "language").agg(F.count("*").alias("n"))


@query("j4_orphan_docstrings", "SELECT DISTINCT id FROM docstrings WHERE symbol_id IS NOT NULL AND symbol_id NOT IN (SELECT id FROM symbols)")
def j4(s, d):
    docs = table(s, d, "docstrings").where("symbol_id is not null").select("id", F.col("symbol_id").cast("long").alias("sid")).distinct()
    return docs.join(table(s, d, "symbols").select(F.col("id").alias("sid")), "sid", "left_anti").select("id")


@query("j5_enclosing_symbol", f"WITH {SYMBOLS}, k AS (SELECT DISTINCT id AS comment_id, file_id, line FROM inline_comments) SELECT comment_id, s.id AS symbol_id FROM k JOIN s ON s.file_id = k.file_id AND line BETWEEN start_line AND end_line QUALIFY row_number() OVER (PARTITION BY comment_id ORDER BY end_line - start_line, s.id) = 1")
def j5(s, d):
    from marlstone.operators.resolve import enclosing

    k = table(s, d, "inline_comments").select(F.col("id").alias("comment_id"), "file_id", "line").distinct()
    return enclosing(k, "comment_id", symbols(s, d))


@query("j7_unambiguous_names", f"WITH {SYMBOLS} SELECT file_id, name, min(id) AS id FROM s GROUP BY 1, 2 HAVING count(*) = 1")
def j7(s, d):
    return symbols(s, d).groupBy("file_id", "name").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1").drop("n")


@query("j8_parent_by_name", f"WITH {SYMBOLS}, p AS (SELECT file_id, name, max(id) AS pid FROM s WHERE parent_symbol_id IS NULL GROUP BY 1, 2) SELECT c.id, q.pid AS parent FROM s c JOIN s o ON o.id = c.parent_symbol_id LEFT JOIN p q ON q.file_id = c.file_id AND q.name = o.name")
def j8(s, d):
    from marlstone.operators.resolve import parents_by_name

    return parents_by_name(symbols(s, d))


@query("j13_default_deny", "SELECT c.id, coalesce(v.ok, false) AS included FROM (SELECT DISTINCT id, task_id FROM retrieval_llm_calls) c LEFT JOIN (SELECT task_id, bool_or(lower(trim(response)) IN ('yes', 'yes.')) AS ok FROM retrieval_llm_calls WHERE call_type = 'scope_judgment' GROUP BY 1) v USING (task_id)")
def j13(s, d):
    calls = table(s, d, "retrieval_llm_calls")
    verdicts = calls.where("call_type = 'scope_judgment'").groupBy("task_id").agg(F.bool_or(F.lower(F.trim("response")).isin("yes", "yes.")).alias("ok"))
    return calls.select("id", "task_id").distinct().join(verdicts, "task_id", "left").select("id", F.coalesce("ok", F.lit(False)).alias("included"))


@query("j20_docstring_summary", "SELECT CAST(symbol_id AS BIGINT) AS symbol_id, max_by(split_part(content, chr(10), 1), id) AS summary FROM docstrings WHERE symbol_id IS NOT NULL GROUP BY 1")
def j20(s, d):
    return table(s, d, "docstrings").where("symbol_id is not null").groupBy(F.col("symbol_id").cast("long").alias("symbol_id")).agg(F.max_by(F.split_part("content", F.lit("\n"), F.lit(1)), "id").alias("summary"))


@query("u1_path_sets", f"WITH {CF}, {FILES}, x AS (SELECT DISTINCT repo_id, path FROM cf), y AS (SELECT DISTINCT repo_id, path FROM f) SELECT coalesce(x.repo_id, y.repo_id) AS repo_id, count(*) FILTER (x.path IS NOT NULL AND y.path IS NOT NULL) AS both, count(*) FILTER (y.path IS NULL) AS only_history, count(*) FILTER (x.path IS NULL) AS only_index FROM x FULL JOIN y ON x.repo_id = y.repo_id AND x.path = y.path GROUP BY 1")
def u1(s, d):
    x = commit_files(s, d).select("repo_id", "path").distinct().withColumn("h", F.lit(1))
    y = files(s, d).select("repo_id", "path").distinct().withColumn("i", F.lit(1))
    j = x.join(y, ["repo_id", "path"], "full_outer")
    return j.groupBy("repo_id").agg(F.count_if(F.col("h").isNotNull() & F.col("i").isNotNull()).alias("both"), F.count_if(F.col("i").isNull()).alias("only_history"), F.count_if(F.col("h").isNull()).alias("only_index"))


@query("u6_first_seen_paths", f"WITH {COMMITS} SELECT repo_id, count(DISTINCT p) AS paths FROM (SELECT repo_id, unnest(changed_files) AS p FROM c) GROUP BY 1")
def u6(s, d):
    return commits(s, d).select("repo_id", F.explode("changed_files").alias("p")).groupBy("repo_id").agg(F.countDistinct("p").alias("paths"))


@query("sk2_upsert", f"WITH {FILES}, o AS (SELECT file_id AS id, repo_id, path, max(content_hash) AS h FROM f WHERE file_source = 'library' GROUP BY 1, 2, 3), o1 AS (SELECT min(id) AS id, repo_id, path, max(h) AS h FROM o GROUP BY 2, 3), n AS (SELECT repo_id, path, max(content_hash) AS h FROM f WHERE language = 'c' GROUP BY 1, 2), b AS (SELECT coalesce(o1.repo_id, n.repo_id) AS repo_id, coalesce(o1.path, n.path) AS path, o1.id, coalesce(n.h, o1.h) AS h FROM o1 FULL JOIN n ON o1.repo_id = n.repo_id AND o1.path = n.path) SELECT CASE WHEN id IS NULL THEN (SELECT max(id) FROM o1) + row_number() OVER (PARTITION BY id IS NULL ORDER BY repo_id, path) ELSE id END AS id, repo_id, path, h FROM b")
def sk2(s, d):
    f = files(s, d)
    old = f.where("file_source = 'library'").groupBy("repo_id", "path").agg(F.min("file_id").alias("id"), F.max("content_hash").alias("h")).select("id", "repo_id", "path", "h")
    new = f.where("language = 'c'").groupBy("repo_id", "path").agg(F.max("content_hash").alias("h"))
    return rows.upsert(old, new, ["repo_id", "path"])


@query("sk4_increment_counts", "SELECT repo_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT repo_id, count(*) AS n FROM commits GROUP BY 1 UNION ALL SELECT repo_id, count(*) AS n FROM index_runs GROUP BY 1) GROUP BY 1")
def sk4(s, d):
    n = lambda t: table(s, d, t).groupBy("repo_id").agg(F.count("*").alias("n"))
    return rows.add_counts(n("commits"), n("index_runs"), ["repo_id"], "n")


@query("sk5_insert_ignore", "SELECT repo_id, hash FROM (SELECT DISTINCT repo_id, hash FROM commits)")
def sk5(s, d):
    c = table(s, d, "commits").select("repo_id", "hash")
    return rows.insert_ignore(c.where("id % 2 = 0").dropDuplicates(), c, ["repo_id", "hash"])


@query("sk7_cascade_delete", f"WITH {FILES}, g AS (SELECT file_id FROM f WHERE file_source = 'library') SELECT count(*) AS n FROM (SELECT DISTINCT id, file_id FROM symbols) WHERE file_id NOT IN (SELECT file_id FROM g)")
def sk7(s, d):
    gone = files(s, d).where("file_source = 'library'").select("file_id")
    left = rows.delete_children(gone, {"symbols": (table(s, d, "symbols").select("id", "file_id").distinct(), ["file_id"])})
    return left["symbols"].agg(F.count("*").alias("n"))


@query("sk10_update_where_given", f"WITH {FILES} SELECT r.id, coalesce(x.remote, r.remote_url) AS remote_url FROM repos r LEFT JOIN (SELECT repo_id, max(path) FILTER (language = 'c') AS remote FROM f GROUP BY 1) x ON x.repo_id = r.id")
def sk10(s, d):
    new = files(s, d).groupBy(F.col("repo_id").alias("id")).agg(F.max(F.when(F.col("language") == "c", F.col("path"))).alias("remote_url"))
    return rows.update_where_given(table(s, d, "repos").select("id", "remote_url"), new, "id")


@query("sk14_index_diff", f"WITH {FILES}, o AS (SELECT repo_id, path, max(content_hash) AS h FROM f WHERE file_id % 5 <> 0 GROUP BY 1, 2), n AS (SELECT repo_id, path, max(content_hash) || CASE WHEN max(file_id) % 7 = 0 THEN 'x' ELSE '' END AS h FROM f WHERE file_id % 6 <> 0 GROUP BY 1, 2) SELECT coalesce(o.repo_id, n.repo_id) AS repo_id, coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'removed' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS status FROM o FULL JOIN n ON o.repo_id = n.repo_id AND o.path = n.path")
def sk14(s, d):
    # The old and the new state of a checkout: two overlapping states made from the whole table.
    f = files(s, d)
    old = f.where("file_id % 5 <> 0").groupBy("repo_id", "path").agg(F.max("content_hash").alias("h"))
    new = f.where("file_id % 6 <> 0").groupBy("repo_id", "path").agg(F.concat(F.max("content_hash"), F.when(F.max("file_id") % 7 == 0, "x").otherwise("")).alias("h"))
    return lookup.diff(old, new, ["repo_id", "path"], "h")


@query("c1_constraint_report", f"""WITH {SYMBOLS} SELECT 'files.path twice' AS what, count(*) AS n FROM (SELECT repo_id, path FROM (SELECT DISTINCT id, repo_id, path FROM files) GROUP BY 1, 2 HAVING count(*) > 1)
    UNION ALL SELECT 'symbols without file', count(*) FROM s WHERE file_id NOT IN (SELECT id FROM files) UNION ALL SELECT 'symbols with end before start', count(*) FROM s WHERE end_line < start_line
    UNION ALL SELECT 'parents missing', count(*) FROM s WHERE parent_symbol_id IS NOT NULL AND parent_symbol_id NOT IN (SELECT id FROM s)""")
def c1(s, d):
    f, sym = files(s, d), symbols(s, d)
    n = lambda df, what: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    ids = sym.select(F.col("id").alias("pid"))
    return (
        n(f.select("file_id", "repo_id", "path").distinct().groupBy("repo_id", "path").count().where("count > 1"), "files.path twice")
        .unionByName(n(sym.join(f.select("file_id"), "file_id", "left_anti"), "symbols without file"))
        .unionByName(n(sym.where("end_line < start_line"), "symbols with end before start"))
        .unionByName(n(sym.where("parent_symbol_id is not null").join(ids, F.col("parent_symbol_id").cast("long") == F.col("pid"), "left_anti"), "parents missing"))
    )
