"""Further queries: remaining lookups, joins, ranks, sets, mutations and text operators over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.catalog import table
from marlstone.functions import text as X
from marlstone.operators import assemble, lookup, rows, similarity
from marlstone.operators.history import co_changes
from marlstone.plans import audit, judge, scope, solve
from marlstone.queries.graph import _CF_ONLY, _CO
from marlstone.queries.index import COMMITS, EDGES, FILES, SYMBOLS, commit_files, commits, edges, files, symbols
from marlstone.registry import query
from marlstone.sources import documents


def _co(s, d):
    f = files(s, d)
    tracked = commit_files(s, d).join(f.select("repo_id", "path", "file_id"), ["repo_id", "path"]).select("commit_id", "file_id")
    return co_changes(tracked, "commit_id", "file_id")


_CALLS = "SELECT DISTINCT id, task_id, call_type, prompt, response, system_prompt, prompt_tokens, completion_tokens FROM retrieval_llm_calls"


@query("q11_co_change_neighbours", f"WITH {EDGES}, {_CF_ONLY}, {_CO} SELECT a AS src, b AS dst, n FROM co WHERE n >= 3 UNION ALL SELECT b, a, n FROM co WHERE n >= 3")
def q11(s, d):
    return lookup.symmetric(_co(s, d).where("n >= 3"), "a", "b", "n")


@query("q18_session_prefix", "SELECT task_id AS key, max_by(response, id) AS value FROM retrieval_llm_calls WHERE starts_with(task_id, 't-9') GROUP BY 1")
def q18(s, d):
    kv = table(s, d, "retrieval_llm_calls").select(F.col("task_id").alias("key"), "response", "id").where(F.startswith("key", F.lit("t-9")))
    return kv.groupBy("key").agg(F.max_by("response", "id").alias("value"))


@query("q20_stage_diff", "WITH a AS (SELECT task_id, count(*) AS n FROM retrieval_llm_calls WHERE call_type = 'enrichment' GROUP BY 1), b AS (SELECT task_id, count(*) AS n FROM retrieval_llm_calls WHERE call_type = 'implement' GROUP BY 1) SELECT coalesce(a.task_id, b.task_id) AS task_id, CASE WHEN a.n IS NULL THEN 'new' WHEN b.n IS NULL THEN 'removed' WHEN a.n = b.n THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.task_id = b.task_id")
def q20(s, d):
    per = lambda t: table(s, d, "retrieval_llm_calls").where(F.col("call_type") == t).groupBy("task_id").agg(F.count("*").alias("n"))
    return lookup.diff(per("enrichment"), per("implement"), ["task_id"], "n")


@query("sk8_delete_files", f"WITH {EDGES}, g AS (SELECT file_id FROM f WHERE language = 'c') SELECT id, src, dst FROM e WHERE src NOT IN (SELECT file_id FROM g) AND dst NOT IN (SELECT file_id FROM g)")
def sk8(s, d):
    gone = files(s, d).where("language = 'c'").select("file_id")
    return rows.delete_children(gone, {"e": (edges(s, d), ["src", "dst"])})["e"].select("id", "src", "dst")


@query("sk9_delete_source", f"WITH {FILES} SELECT file_id FROM f WHERE NOT starts_with(path, 'kb/') ")
def sk9(s, d):
    return files(s, d).where(~F.startswith("path", F.lit("kb/"))).select("file_id")


@query("sk12_flag_by_prefix", "SELECT DISTINCT id, task_id IN (SELECT task_id FROM retrieval_llm_calls WHERE response = '') AS flagged FROM retrieval_llm_calls")
def sk12(s, d):
    c = table(s, d, "retrieval_llm_calls").select("id", F.concat(F.col("task_id"), F.lit(":impl:1:x")).alias("task")).distinct()
    p = table(s, d, "retrieval_llm_calls").where("response = ''").select(F.concat(F.col("task_id"), F.lit(":impl:1")).alias("prefix"))
    return rows.prefix_flag(c, p, "task", "flagged").select("id", "flagged")


@query("sk15_stale_sweep", f"WITH {FILES}, {COMMITS} SELECT DISTINCT repo_id, path FROM f WHERE file_source = 'library' AND (repo_id, path) NOT IN (SELECT repo_id, unnest(changed_files) FROM c WHERE changed_files IS NOT NULL)")
def sk15(s, d):
    scanned = commits(s, d).select("repo_id", F.explode("changed_files").alias("path"))
    return files(s, d).where("file_source = 'library'").select("repo_id", "path").distinct().join(scanned, ["repo_id", "path"], "left_anti")


@query("sk16_bridge_files", "SELECT CAST(0 AS BIGINT) AS repo_id, 'kb/docs/' || doc_id AS path, 'text' AS language, sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS size_bytes, 'knowledge_base' AS file_source FROM documents WHERE doc_type = 'section'")
def sk16(s, d):
    sections = table(s, d, "documents").where("doc_type = 'section'").select(F.col("doc_id").cast("string").alias("path"), F.lit("t").alias("title"), F.col("text").alias("content"))
    return documents.bridge(sections, "docs", 0)["files"]


@query("sk19_findings", "SELECT CAST(id AS VARCHAR) AS id, '[[finding]]' || chr(10) || 'id = \"' || id || '\"' || chr(10) || 'task = \"' || status || '\"' || chr(10) || 'must_recall = ' || printf('%.2f', files_new / 7) || chr(10) || 'score = ' || printf('%.2f', files_changed / 7) || chr(10) || 'note = \"' || replace(repo_path, chr(92), chr(92) || chr(92)) || '\"' AS line FROM index_runs")
def sk19(s, d):
    r = table(s, d, "index_runs").select(F.col("id").cast("string").alias("id"), F.col("status").alias("task"), (F.col("files_new") / 7).alias("must_recall"), (F.col("files_changed") / 7).alias("score"), F.col("repo_path").alias("note"))
    return solve.findings_toml(r)


@query("j9_pairs_within_parent", f"WITH {SYMBOLS} SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.parent_symbol_id = b.parent_symbol_id AND a.kind = b.kind AND a.id < b.id")
def j9(s, d):
    m = symbols(s, d).where("parent_symbol_id is not null").select("id", "kind", "parent_symbol_id").distinct()
    x, y = m.alias("x"), m.alias("y")
    return x.join(y, (F.col("x.parent_symbol_id") == F.col("y.parent_symbol_id")) & (F.col("x.kind") == F.col("y.kind")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


@query("j10_ordered_pairs", f"WITH {SYMBOLS} SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.file_id = b.file_id AND a.name = b.name AND a.id <> b.id")
def j10(s, d):
    m = symbols(s, d).select("id", "file_id", "name").distinct()
    x, y = m.alias("x"), m.alias("y")
    return x.join(y, (F.col("x.file_id") == F.col("y.file_id")) & (F.col("x.name") == F.col("y.name")) & (F.col("x.id") != F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


_HEADERS = ", ".join(f"('{n}', '<{h}>')" for h, names in solve.HEADERS.items() for n in names.split())


@query("j14_header_of_name", f"""WITH h(symbol, header) AS (VALUES {_HEADERS}), t AS (SELECT DISTINCT file_id, content FROM source_texts WHERE file_id IN (SELECT id FROM files WHERE language = 'c')),
    w AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*')) AS symbol FROM t) SELECT file_id, symbol, header FROM w JOIN h USING (symbol) JOIN t USING (file_id) WHERE NOT contains(content, '#include ' || header)""")
def j14(s, d):
    """Each name in a C source as a compiler would report it were it not declared."""
    c = files(s, d).where("language = 'c'").select("file_id").distinct()
    t = table(s, d, "source_texts").join(c, "file_id", "left_semi").select(F.col("file_id").alias("path"), "content").distinct()
    names = t.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("name"))
    errors = names.select("path", F.concat(F.lit("a.c:3: warning: implicit declaration of function '"), "name", F.lit("' [-W]")).alias("message"))
    return solve.missing_headers(errors, t).withColumnRenamed("path", "file_id")


@query("j16_not_yet_done", f"WITH {FILES} SELECT file_id FROM f WHERE path NOT IN (SELECT regexp_extract(prompt, 'File: (\\S+)', 1) FROM retrieval_llm_calls WHERE prompt IS NOT NULL)")
def j16(s, d):
    done = table(s, d, "retrieval_llm_calls").where("prompt is not null").select(F.regexp_extract("prompt", r"File: (\S+)", 1).alias("path"))
    return files(s, d).join(done, "path", "left_anti").select("file_id")


_TERMS = ["cache", "mergeSplitter", "Registry", "auditLedgerView"]


@query("j17_containment", f"WITH {SYMBOLS}, t AS (SELECT unnest({_TERMS!r}) AS term) SELECT DISTINCT id, term FROM s JOIN f0 ON f0.id0 = s.file_id JOIN t ON contains(lower(name), lower(term)) OR contains(lower(term), lower(name))".replace("WITH ", "WITH f0 AS (SELECT DISTINCT id AS id0 FROM files WHERE language IN ('javascript', 'typescript')), ", 1))
def j17(s, d):
    f = files(s, d).where("language in ('javascript', 'typescript')").select("file_id").distinct()
    terms = s.createDataFrame([(t,) for t in _TERMS], "term string")  # the terms of one task
    sym = symbols(s, d).join(f, "file_id", "left_semi")
    return sym.join(F.broadcast(terms), F.contains(F.lower("name"), F.lower("term")) | F.contains(F.lower("term"), F.lower("name"))).select("id", "term").distinct()


@query("j18_seed_paths", f"WITH {FILES}, p AS (SELECT DISTINCT regexp_extract(prompt, 'File: (\\S+)', 1) AS path FROM retrieval_llm_calls) SELECT f.file_id FROM f JOIN p USING (path) WHERE p.path <> ''")
def j18(s, d):
    p = table(s, d, "retrieval_llm_calls").select(F.regexp_extract("prompt", r"File: (\S+)", 1).alias("path")).where("path <> ''").distinct()
    return files(s, d).join(p, "path").select("file_id")


@query("j19_symbols_of_scope", f"WITH {SYMBOLS}, {FILES} SELECT s.id, f.path, f.language, f.file_source FROM s JOIN f USING (file_id) WHERE f.size_bytes BETWEEN 500 AND 2000")
def j19(s, d):
    return files(s, d).where("size_bytes between 500 and 2000").join(symbols(s, d).select("id", "file_id"), "file_id").select("id", "path", "language", "file_source")


@query("a12_suite", "WITH t AS (SELECT id, files_new / (files_new + files_changed + 1) AS m, least(files_new / (files_new + files_changed + 1), files_unchanged / (files_scanned + 1)) AS k, status FROM index_runs) SELECT round(avg(m) FILTER (status = 'success'), 6) AS must_recall, round(avg(k) FILTER (status = 'success'), 6) AS task_score, arg_min(id, (k, id)) AS worst, count(*) FILTER (status <> 'success') AS failed, count(*) FILTER (k < 0.5) AS blocking FROM t")
def a12(s, d):
    r = table(s, d, "index_runs")
    m = F.col("files_new") / (F.col("files_new") + F.col("files_changed") + 1)
    t = r.select(F.col("id").alias("task"), m.alias("must_recall"), F.least(m, F.col("files_unchanged") / (F.col("files_scanned") + 1)).alias("task_score"), F.when(F.col("status") != "success", F.col("status")).alias("error"))
    out = audit.suite(t)
    return out.select(F.round("must_recall", 6).alias("must_recall"), F.round("task_score", 6).alias("task_score"), "worst", "failed", "blocking")


@query("a14_detail_level", f"WITH {SYMBOLS}, x AS (SELECT file_id, name, CASE kind WHEN 'class' THEN 0 WHEN 'method' THEN 1 WHEN 'function' THEN 2 END AS r FROM s) SELECT file_id, ['primary', 'supporting', 'type_context'][min(r) + 1] AS level, list_sort(list(DISTINCT name)) AS names FROM x WHERE r IS NOT NULL GROUP BY 1")
def a14(s, d):
    level = F.when(F.col("kind") == "class", "primary").when(F.col("kind") == "method", "supporting").when(F.col("kind") == "function", "type_context")
    return assemble.detail_level(symbols(s, d).select("file_id", "name", level.alias("level")))


@query("t6_top_pairs", f"WITH {EDGES}, {_CF_ONLY}, {_CO} SELECT a, b, n FROM co ORDER BY n DESC, a, b LIMIT 50")
def t6(s, d):
    return _co(s, d).orderBy(F.desc("n"), "a", "b").limit(50)


@query("t7_group_members", f"WITH {SYMBOLS} SELECT file_id, id FROM s QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY id) <= 8")
def t7(s, d):
    return lookup.top_per_key(symbols(s, d).select("file_id", "id").distinct(), ["file_id"], [F.col("id")], 8).select("file_id", "id")


@query("t9_paths_in_order", f"WITH {FILES} SELECT file_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY path, file_id) AS BIGINT) AS place FROM f")
def t9(s, d):
    w = Window.partitionBy("repo_id").orderBy("path", "file_id")
    return files(s, d).select("file_id", F.row_number().over(w).cast("long").alias("place"))


@query("u2_jaccard", f"WITH {COMMITS}, p AS (SELECT repo_id, id, list_distinct(changed_files) AS x, lag(list_distinct(changed_files)) OVER (PARTITION BY repo_id ORDER BY id) AS y FROM c WHERE changed_files IS NOT NULL) SELECT id, round(CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS jaccard FROM p WHERE y IS NOT NULL")
def u2(s, d):
    c = commits(s, d).where("changed_files is not null").select("repo_id", "id", F.array_distinct("changed_files").alias("x"))
    p = c.withColumn("y", F.lag("x").over(Window.partitionBy("repo_id").orderBy("id"))).where("y is not null")
    return p.select("id", F.round(similarity.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


@query("u4_order_keeping_distinct", f"WITH {COMMITS} SELECT id, list_filter(changed_files, lambda x, i: list_position(changed_files, x) = i) AS paths FROM c WHERE changed_files IS NOT NULL")
def u4(s, d):
    return commits(s, d).where("changed_files is not null").select("id", F.array_distinct("changed_files").alias("paths"))


@query("u7_merged_requests", f"SELECT task_id, list_sort(list(id)) AS ids FROM (SELECT task_id, id FROM ({_CALLS})) GROUP BY 1")
def u7(s, d):
    return table(s, d, "retrieval_llm_calls").select("task_id", "id").distinct().groupBy("task_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))


_FAILED = "CASE " + " ".join(f"WHEN regexp_matches(t, '(?i){'|'.join(ps)}') THEN '{k}'" for k, ps in X.FAILURES.items()) + " ELSE 'unknown' END"
_REPORTS = "SELECT DISTINCT doc_id AS id, text AS t FROM documents WHERE text IS NOT NULL"


def _reports(s, d):
    """The texts that may report failures: logs and discussions among the documents."""
    return table(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.col("text").alias("t")).distinct()


@query("st10_failure_category", f"SELECT id, {_FAILED} AS category FROM ({_REPORTS})")
def st10(s, d):
    return _reports(s, d).select("id", X.failure_category(F.col("t")).alias("category"))


@query("st11_undeclared", f"SELECT id, list_filter([{', '.join(f"nullif(regexp_extract(t, '(?i){p.replace(chr(39), chr(39) * 2)}', 1), '')" for p in X.UNDECLARED)}], lambda x: x IS NOT NULL) AS names FROM ({_REPORTS})")
def st11(s, d):
    return _reports(s, d).select("id", X.undeclared_symbols(F.col("t")).alias("names"))


@query("st12_failing_tests", rf"SELECT id, CASE WHEN regexp_matches(t, 'FAILED\s+\S') THEN regexp_extract_all(t, 'FAILED\s+(\S+)', 1) ELSE regexp_extract_all(t, 'FAIL\s+(\S+)', 1) END AS names FROM ({_REPORTS})")
def st12(s, d):
    return _reports(s, d).select("id", X.failing_tests(F.col("t")).alias("names"))


@query("st19_normal_paths", rf"WITH {COMMITS} SELECT DISTINCT replace(p, '\', '/') AS path FROM (SELECT unnest(changed_files) AS p FROM c)")
def st19(s, d):
    return commits(s, d).select(F.explode("changed_files").alias("p")).select(F.translate("p", "\\", "/").alias("path")).distinct()


@query("st22_toml", "SELECT DISTINCT id, replace(replace(replace(content, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n') AS text FROM docstrings WHERE content IS NOT NULL")
def st22(s, d):
    return table(s, d, "docstrings").where("content is not null").select("id", X.toml_escape(F.col("content")).alias("text")).distinct()


_TERM_LIST = ["registry", "cache", "ledger", "audit", "parser", "task", "view"]
_BEST = f"SELECT word, length(word) * 10 + row_number() OVER (ORDER BY length(word), pos DESC) AS worth FROM (SELECT word, pos FROM (SELECT unnest({_TERM_LIST!r}) AS word, unnest(range({len(_TERM_LIST)})) AS pos) ORDER BY length(word) DESC, pos LIMIT 5)"


@query("nu5_specificity", f"WITH {FILES}, kw AS ({_BEST}) SELECT file_id, max(worth) AS score FROM f JOIN kw ON contains(lower(path), word) GROUP BY 1")
def nu5(s, d):
    words = s.createDataFrame([(w, k) for k, w in enumerate(_TERM_LIST)], "word string, pos int")
    return scope.keyword_matches(files(s, d).select("file_id", F.col("path").alias("concepts")), words)


@query("nu6_num_predict", f"SELECT id, greatest(1, 8192 - length(prompt) // 3 - 256) AS num_predict, (length(prompt) + coalesce(length(system_prompt), 0)) // 3 <= 8192 - 512 AS fits FROM ({_CALLS})")
def nu6(s, d):
    c = table(s, d, "retrieval_llm_calls").select("id", "task_id", "call_type", "prompt", "response", "system_prompt", "prompt_tokens", "completion_tokens").distinct()
    return c.select("id", F.greatest(F.lit(1), 8192 - assemble.conservative_tokens(F.col("prompt")) - 256).alias("num_predict"), judge.fits(F.col("prompt"), F.col("system_prompt"), 8192, 512).alias("fits"))


@query("aj2_required_keys", f"SELECT DISTINCT id, CASE WHEN json_valid(response) THEN CASE WHEN json_type(response) = 'OBJECT' THEN response->>'$.purpose' IS NOT NULL AND response->>'$.module' IS NOT NULL ELSE false END ELSE false END AS complete FROM ({_CALLS}) WHERE call_type = 'enrichment' AND response IS NOT NULL")
def aj2(s, d):
    j = F.from_json("response", "purpose string, module string")
    c = table(s, d, "retrieval_llm_calls").where("call_type = 'enrichment' and response is not null")
    return c.select("id", F.coalesce(j["purpose"].isNotNull() & j["module"].isNotNull() & F.try_parse_json("response").isNotNull(), F.lit(False)).alias("complete")).distinct()


@query("tx8_rule_list")
def tx8(s, d):
    return documents.rule_list(table(s, d, "documents"), "doc_id", "text")


@query("tx7_book_sections")
def tx7(s, d):
    return documents.book_sections(table(s, d, "documents"), "doc_id", "text")


_PAGE_MARKS = r"^\s*\d{1,4}\s*$|^\s*\d+\s+[A-Z][A-Z ]+(?:CHAPTER|SECTION)\b|^\s*(?:CHAPTER|SECTION)\b.*\d+\s*$"


@query("tx13_clean_sections", rf"SELECT doc_id, trim(regexp_replace(array_to_string(list_filter(string_split_regex(text, '\r?\n'), lambda x: NOT regexp_matches(x, '{_PAGE_MARKS}')), chr(10)), '\n(?:[ \t]*\n){{2,}}', chr(10) || chr(10), 'g'), chr(10)) AS text FROM documents")
def tx13(s, d):
    return table(s, d, "documents").select("doc_id", documents.clean_section(F.col("text")).alias("text"))


@query("tx16_language_brief", f"WITH {FILES}, n AS (SELECT repo_id, language, count(*) AS n FROM f GROUP BY 1, 2) SELECT repo_id, string_agg(language || ' (' || n || ')', ', ' ORDER BY n DESC, language) AS brief FROM n GROUP BY 1")
def tx16(s, d):
    n = files(s, d).groupBy("repo_id", "language").agg(F.count("*").alias("n"))
    text = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "language"))), lambda x: F.concat(x["language"], F.lit(" ("), (-x["k"]).cast("string"), F.lit(")")))
    return n.groupBy("repo_id").agg(F.array_join(text, ", ").alias("brief"))


_HEADED = r"(?m)^(#{1,6}) ([^\n\r&<]+?)[ \t\r]*$"


@query("tx10_html_sections", rf"""WITH h AS (SELECT DISTINCT doc_id, regexp_extract_all(text, '{_HEADED}', 1) AS marks, regexp_extract_all(text, '{_HEADED}', 2) AS titles FROM documents WHERE regexp_matches(text, '{_HEADED}'))
    SELECT * FROM (SELECT doc_id AS id, length(unnest(marks)) AS level, trim(regexp_replace(unnest(titles), '\s+', ' ', 'g')) AS title FROM h) WHERE level <= 3""")
def tx10(s, d):
    """The headed documents as HTML pages, as they would be published: each heading a tag, the rest in preformatted text."""
    rows = table(s, d, "documents").where(F.col("text").rlike("(?d)" + _HEADED)).select("doc_id", F.regexp_replace("text", "[&<>]", " ").alias("text")).distinct()
    for k in range(1, 7):
        rows = rows.withColumn("text", F.regexp_replace("text", rf"(?dm)^#{{{k}}} ([^\n\r&<]+?)[ \t\r]*$", f"</pre><h{k}>$1</h{k}><pre>"))
    pages = documents.html_sections(rows.withColumn("text", F.concat(F.lit("<html><body><pre>"), "text", F.lit("</pre></body></html>"))), "doc_id", "text")
    return pages.where("title <> ''").select("id", "level", "title")


@query("ud7_error_class", f"SELECT id, CASE WHEN regexp_matches(response, '(?i)undeclared') THEN 'missing_include' WHEN starts_with(lower(response), 'yes') THEN 'signature' ELSE 'logic_error' END AS class FROM ({_CALLS}) WHERE response IS NOT NULL")
def ud7(s, d):
    c = table(s, d, "retrieval_llm_calls").select("id", "task_id", "call_type", "prompt", "response", "system_prompt", "prompt_tokens", "completion_tokens").distinct().where("response is not null")
    fixed = F.when(F.col("response").rlike("(?i)undeclared"), "missing_include")
    return c.select("id", solve.error_class(fixed, ("signature", F.startswith(F.lower("response"), F.lit("yes")))).alias("class"))


@query("g11_adjusted_steps", "SELECT DISTINCT task_id AS step FROM retrieval_llm_calls WHERE task_id IN (SELECT task_id FROM retrieval_llm_calls WHERE lower(response) = 'yes')")
def g11(s, d):
    c = table(s, d, "retrieval_llm_calls")
    steps = c.select(F.col("task_id").alias("step")).distinct()
    verdicts = c.select(F.col("task_id").alias("step"), F.lit(None).cast("string").alias("failure"), (F.lower("response") == "yes").alias("yes"))
    failures = c.where("response = ''").select(F.col("task_id").alias("failure")).distinct()
    return solve.adjust(steps, failures.unionByName(s.createDataFrame([("none",)], "failure string")), verdicts)["steps"]


_LEVEL = "CASE WHEN s.size_bytes > 3000 THEN 'primary' WHEN s.size_bytes > 1000 THEN 'supporting' WHEN s.size_bytes > 0 THEN 'type_context' ELSE 'excluded' END"


@query("nu2_framing_tokens", f"WITH {FILES} SELECT file_id, (length('## ' || path || ' [' || language || '] (supporting)' || chr(10)) + length('<code lang=\"' || language || '\">' || chr(10) || '</code>' || chr(10)) + CASE WHEN file_source = 'library' THEN 29 ELSE 0 END) // 4 AS tokens FROM f")
def nu2(s, d):
    f = files(s, d)
    return f.select("file_id", assemble.framing_tokens(F.col("path"), F.col("language"), F.lit("supporting"), F.col("file_source") == "library").alias("tokens"))


@query("t8_final_order", f"""WITH {FILES}, x AS (SELECT file_id, repo_id % 5 AS tier, {_LEVEL} AS level FROM f AS s) SELECT file_id, level, tier, row_number() OVER (ORDER BY CASE level WHEN 'primary' THEN 0 WHEN 'supporting' THEN 1 ELSE 2 END, tier, file_id) - 1 AS place
    FROM x WHERE level <> 'excluded'""")
def t8(s, d):
    """All files, with a level by their size and a tier by their repository."""
    level = F.expr(_LEVEL.replace("s.", ""))
    return assemble.final_order(files(s, d).select("file_id", level.alias("level"), (F.col("repo_id") % 5).alias("tier")))
