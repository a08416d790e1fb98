"""Queries of graphs, scope, similarity, assembly, audit, judgement, documents and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.catalog import table
from marlstone.operators import assemble, graph, similarity
from marlstone.operators.history import co_changes, parse_log
from marlstone.plans import audit, judge, scope
from marlstone.queries.index import CF, EDGES, FILES, SYMBOLS, commit_files, edges, files, symbols
from marlstone.registry import query
from marlstone.sources import documents
from marlstone.streaming import log

_SEEDS = "file_id % 100 = 0"  # the stated query set, against all rows


@query("g1_expand", f"""WITH RECURSIVE {EDGES}, b AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e), r AS (SELECT file_id AS node, 0 AS hops FROM f WHERE {_SEEDS} UNION SELECT b.y, r.hops + 1 FROM r JOIN b ON b.x = r.node WHERE r.hops < 2)
    SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY 1""")
def g1(s, d):
    return graph.expand(edges(s, d), files(s, d).where(_SEEDS).select(F.col("file_id").alias("node")), 2)


@query("g1_edges_within", f"""WITH {EDGES}, n0 AS (SELECT file_id AS node FROM f WHERE {_SEEDS}), n1 AS (SELECT node FROM n0 UNION SELECT dst FROM e WHERE src IN (SELECT node FROM n0) UNION SELECT src FROM e WHERE dst IN (SELECT node FROM n0))
    SELECT DISTINCT id, src, dst FROM e WHERE src IN (SELECT node FROM n1) OR dst IN (SELECT node FROM n1)""")
def g1e(s, d):
    return graph.edges_within(edges(s, d), files(s, d).where(_SEEDS).select(F.col("file_id").alias("node")), 2).select("id", "src", "dst")


@query("g2_components", f"""WITH RECURSIVE {EDGES}, b AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e), r AS (SELECT x AS node, x AS root FROM b UNION SELECT b.y, r.root FROM r JOIN b ON b.x = r.node)
    SELECT node, min(root) AS component FROM r GROUP BY 1""")
def g2(s, d):
    return graph.components(edges(s, d).where("src <> dst"), edges(s, d).select(F.explode(F.array("src", "dst")).alias("node")))


@query("g3_levels", f"""WITH RECURSIVE {SYMBOLS}, r AS (SELECT id AS node, 0 AS level FROM s WHERE parent_symbol_id IS NULL OR parent_symbol_id NOT IN (SELECT id FROM s) UNION ALL SELECT s.id, r.level + 1 FROM r JOIN s ON s.parent_symbol_id = r.node)
    SELECT node, CAST(max(level) AS INTEGER) AS level FROM r GROUP BY 1""")
def g3(s, d):
    sym = symbols(s, d)
    done, _ = graph.levels(sym.select(F.col("id").alias("node")), sym.where("parent_symbol_id is not null").select(F.col("id").alias("node"), F.col("parent_symbol_id").cast("long").alias("needs")))
    return done


@query("g4_plan_warnings", f"WITH {EDGES}, dd AS (SELECT DISTINCT CAST(symbol_id AS BIGINT) AS node FROM docstrings WHERE symbol_id IS NOT NULL AND symbol_id NOT IN (SELECT id FROM symbols)) SELECT 'duplicate' AS kind, id AS node FROM symbols GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'dangling', node FROM dd")
def g4(s, d):
    nodes = table(s, d, "symbols").select(F.col("id").alias("node"))
    needs = table(s, d, "docstrings").where("symbol_id is not null").select(F.col("id").alias("node"), F.col("symbol_id").cast("long").alias("needs"))
    return graph.plan_warnings(nodes, needs.withColumn("node", -F.col("node")))


_CO = f"""t AS (SELECT DISTINCT cf.commit_id, f.file_id FROM cf JOIN f ON f.repo_id = cf.repo_id AND f.path = cf.path), w AS (SELECT commit_id FROM t GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50),
    co AS (SELECT x.file_id AS a, y.file_id AS b, count(*) AS n FROM t x JOIN t y ON x.commit_id = y.commit_id AND x.file_id < y.file_id WHERE x.commit_id IN (SELECT commit_id FROM w) GROUP BY 1, 2 HAVING count(*) >= 2)"""
_CF_ONLY = CF[CF.index("cf AS"):]
_WORDS = ["registry", "cache", "ledger", "audit", "parser", "task", "view"]


@query(
    "g5_scope_tiers",
    f"""WITH {EDGES}, {_CF_ONLY}, {_CO}, base AS (SELECT file_id, min(tier) AS tier FROM (SELECT file_id, 0 AS tier FROM f WHERE file_id % 100 = 0 UNION ALL SELECT DISTINCT file_id, 1 FROM symbols WHERE name ILIKE '%merge%' AND file_id IN (SELECT file_id FROM f)) GROUP BY 1),
    fan AS (SELECT dst AS file_id, count(DISTINCT src) AS score FROM e WHERE src IN (SELECT file_id FROM base) GROUP BY 1 UNION ALL SELECT src, count(DISTINCT dst) FROM e WHERE dst IN (SELECT file_id FROM base) GROUP BY 1),
    t2 AS (SELECT file_id, max(score) AS score FROM fan WHERE file_id NOT IN (SELECT file_id FROM base) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30), h2 AS (SELECT file_id FROM base UNION ALL SELECT file_id FROM t2),
    near AS (SELECT a AS src, b AS dst, n FROM co UNION ALL SELECT b, a, n FROM co),
    t3 AS (SELECT dst AS file_id, max(n) AS score FROM near WHERE src IN (SELECT file_id FROM base) AND dst NOT IN (SELECT file_id FROM h2) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20), h3 AS (SELECT file_id FROM h2 UNION ALL SELECT file_id FROM t3),
    kw AS (SELECT word, length(word) * 10 + row_number() OVER (ORDER BY length(word), pos DESC) AS worth FROM (SELECT w.word, w.pos FROM (SELECT unnest({_WORDS!r}) AS word, unnest(range({len(_WORDS)})) AS pos) w ORDER BY length(word) DESC, pos LIMIT 5)),
    t4 AS (SELECT file_id, max(worth) AS score FROM f JOIN kw ON contains(lower(path), word) WHERE file_id NOT IN (SELECT file_id FROM h3) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)
    SELECT file_id, tier, CAST(NULL AS BIGINT) AS score FROM base UNION ALL SELECT file_id, 2, CAST(score AS BIGINT) FROM t2 UNION ALL SELECT file_id, 3, CAST(score AS BIGINT) FROM t3 UNION ALL SELECT file_id, 4, CAST(score AS BIGINT) FROM t4""",
)
def g5(s, d):
    # A plan names some files and a task mentions a symbol name; both are the query's inputs, every table is read whole.
    f = files(s, d)
    tracked = commit_files(s, d).join(f.select("repo_id", "path", "file_id"), ["repo_id", "path"]).select("commit_id", "file_id")
    plan = f.where("file_id % 100 = 0").select("file_id")
    seeds = symbols(s, d).where(F.lower("name").contains("merge")).select("file_id").distinct().join(f.select("file_id"), "file_id", "left_semi")
    words = s.createDataFrame([(w, k) for k, w in enumerate(_WORDS)], "word string, pos int")
    # Only commits that hold a file of the base can hold a pair with one: no other commit's pairs are made.
    near = tracked.join(plan.unionByName(seeds), "file_id", "left_semi").select("commit_id").distinct()
    tracked = tracked.join(near, "commit_id", "left_semi")
    return scope.expand_scope(plan, seeds, edges(s, d), co_changes(tracked, "commit_id", "file_id"), f.select("file_id", F.col("path").alias("concepts")), words)


@query("g6_first_fit")
def g6(s, d):
    docs = table(s, d, "documents").where("repo_id is not null").select("repo_id", "doc_id", "created_at", assemble.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))
    return assemble.first_fit(docs, "repo_id", ["created_at", "doc_id"], "doc_id", "tokens", F.lit(4096))


@query(
    "g7_drop_levels",
    """WITH x AS (SELECT repo_id, doc_id, CASE doc_type WHEN 'section' THEN 'primary' WHEN 'note' THEN 'supporting' ELSE 'type_context' END AS level, greatest(1, length(text) // 4) AS tokens FROM documents WHERE repo_id IS NOT NULL AND text IS NOT NULL),
    p AS (SELECT repo_id, sum(tokens) AS t, coalesce(sum(tokens) FILTER (level = 'type_context'), 0) AS a, coalesce(sum(tokens) FILTER (level = 'supporting'), 0) AS b, coalesce(sum(tokens) FILTER (level = 'primary'), 0) AS c FROM x GROUP BY 1),
    k AS (SELECT repo_id, CASE WHEN t - a - b > 6000 THEN 3 WHEN t - a > 6000 THEN 2 WHEN t > 6000 THEN 1 ELSE 0 END AS cut FROM p)
    SELECT CAST(repo_id AS BIGINT) AS repo_id, doc_id FROM x JOIN k USING (repo_id) WHERE CASE level WHEN 'type_context' THEN 1 WHEN 'supporting' THEN 2 ELSE 3 END > cut""",
)
def g7(s, d):
    level = F.when(F.col("doc_type") == "section", "primary").when(F.col("doc_type") == "note", "supporting").otherwise("type_context")
    x = table(s, d, "documents").where("repo_id is not null and text is not null").select(F.col("repo_id").cast("long").alias("repo_id"), "doc_id", level.alias("level"), assemble.token_estimate(F.col("text")).alias("tokens"))
    return assemble.drop_levels(x, "repo_id", "level", "tokens", 6000).select("repo_id", "doc_id")


@query(
    "g8_similar_signals",
    f"""WITH {SYMBOLS}, k AS (SELECT parent_symbol_id AS pid, list_sort(list(DISTINCT name)) AS callees FROM s WHERE parent_symbol_id IS NOT NULL GROUP BY 1), x AS (SELECT s.id, s.file_id, s.kind, s.end_line - s.start_line + 1 AS lines, coalesce(callees, []) AS callees, parent_symbol_id AS parent FROM s LEFT JOIN k ON k.pid = s.id WHERE kind IN ('function', 'method'))
    SELECT a.id AS a, b.id AS b, round(least(a.lines, b.lines) / greatest(a.lines, b.lines), 6) AS line_ratio, CAST(CASE WHEN a.parent = b.parent THEN 1 ELSE 0 END AS DOUBLE) AS same_parent FROM x a JOIN x b ON a.file_id = b.file_id AND a.kind = b.kind AND a.id < b.id
    WHERE 0.3 * least(a.lines, b.lines) / greatest(a.lines, b.lines) + 0.15 * CASE WHEN a.parent = b.parent THEN 1.0 ELSE 0.0 END + 0.35 * CASE WHEN len(list_distinct(list_concat(a.callees, b.callees))) = 0 THEN 0.0 ELSE len(list_intersect(a.callees, b.callees)) / len(list_distinct(list_concat(a.callees, b.callees))) END >= 0.4""",
)
def g8s(s, d):
    pairs = similarity.pair_signals(_comparable(s, d), ["file_id", "kind"])
    return pairs.where("0.3D * line_ratio + 0.35D * callees + 0.15D * same_parent >= 0.4D").select("a", "b", F.round("line_ratio", 6).alias("line_ratio"), "same_parent")


def _comparable(s, d):
    sym = symbols(s, d)
    callees = sym.where("parent_symbol_id is not null").groupBy(F.col("parent_symbol_id").cast("long").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("callees"))
    none = F.array().cast("array<string>")
    return sym.where("kind in ('function', 'method')").join(callees, "id", "left").select("id", "file_id", "kind", "name", (F.col("end_line") - F.col("start_line") + 1).alias("lines"), F.coalesce("callees", none).alias("callees"), F.col("parent_symbol_id").alias("parent"))


@query("g8_similar_pairs")
def g8(s, d):
    return similarity.similar_pairs(_comparable(s, d), ["file_id", "kind"], 0.3)


@query("g10_merged_spans", f"""WITH {SYMBOLS}, x AS (SELECT file_id, start_line, end_line, max(end_line) OVER (PARTITION BY file_id ORDER BY start_line, end_line, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, id FROM s WHERE end_line >= start_line),
    y AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_line > reach THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY start_line, end_line, id) AS island FROM x) SELECT file_id, min(start_line) AS start_line, max(end_line) AS end_line FROM y GROUP BY file_id, island""")
def g10(s, d):
    return graph.merge_intervals(symbols(s, d).where("end_line >= start_line").select("file_id", "start_line", "end_line"), "file_id", "start_line", "end_line")


@query("a10_audit_scores", """WITH must AS (SELECT DISTINCT repo_id AS task, 'must' AS role, path AS pattern FROM files WHERE language = 'c' UNION SELECT DISTINCT repo_id, 'must_not', path FROM files WHERE file_source = 'library' UNION SELECT id, 'should', 'src/*' FROM repos),
    got AS (SELECT DISTINCT repo_id AS task, path FROM files WHERE size_bytes > 1500), m AS (SELECT task, role, pattern, EXISTS (SELECT 1 FROM got g WHERE g.task = must.task AND (g.path = pattern OR (role = 'should' AND g.path LIKE 'src/%'))) AS hit FROM must),
    p AS (SELECT task, coalesce(avg(CASE WHEN role = 'must' THEN CAST(hit AS INT) END), 1.0) AS a, coalesce(avg(CASE WHEN role = 'should' THEN CAST(hit AS INT) END), 1.0) AS b, coalesce(1 - avg(CASE WHEN role = 'must_not' THEN CAST(hit AS INT) END), 1.0) AS c FROM m GROUP BY 1)
    SELECT task, round(a, 6) AS must_recall, round(b, 6) AS should_recall, round(c, 6) AS exclusion, round(least(a, c), 6) AS task_score FROM p""")
def a10(s, d):
    f = files(s, d)
    role = lambda df, r: df.select(F.col("repo_id").alias("task"), F.lit(r).alias("role"), F.col("path").alias("pattern")).distinct()
    tasks = table(s, d, "repos").select(F.col("id").alias("task"))
    patterns = role(f.where("language = 'c'"), "must").unionByName(role(f.where("file_source = 'library'"), "must_not")).unionByName(tasks.select("task", F.lit("should").alias("role"), F.lit("src/*").alias("pattern")))
    paths = f.where("size_bytes > 1500").select(F.col("repo_id").alias("task"), "path").distinct()
    out = audit.scores(tasks, patterns, paths)
    return out.select("task", *[F.round(c, 6).alias(c) for c in ("must_recall", "should_recall", "exclusion", "task_score")])


@query("ud2_precision", "WITH v AS (SELECT file_id, bool_or(is_rationale) AS relevant, bool_or(kind = 'todo') AS p, bool_or(kind = 'fixme') AS q FROM inline_comments GROUP BY 1) SELECT DISTINCT f.id AS file_id, CASE WHEN file_source = 'library' THEN 'type_context' WHEN NOT coalesce(relevant, false) THEN 'excluded' WHEN coalesce(p, false) THEN 'primary' WHEN coalesce(q, false) THEN 'supporting' ELSE 'type_context' END AS level FROM files f LEFT JOIN v ON v.file_id = f.id")
def ud2(s, d):
    v = table(s, d, "inline_comments").groupBy("file_id").agg(F.bool_or("is_rationale").alias("relevant"), F.bool_or(F.col("kind") == "todo").alias("primary"), F.bool_or(F.col("kind") == "fixme").alias("supporting"))
    return scope.precision(files(s, d).select("file_id", (F.col("file_source") == "library").alias("library")), v)


@query("ud0_table_judge", "SELECT DISTINCT f.id AS file_id, coalesce(v.ok, false) AS verdict, v.ok IS NULL AS omitted FROM files f LEFT JOIN (SELECT file_id, bool_or(is_rationale) AS ok FROM inline_comments GROUP BY 1) v ON v.file_id = f.id")
def ud0(s, d):
    v = table(s, d, "inline_comments").select("file_id", F.col("is_rationale").alias("verdict"))
    return judge.by_table(files(s, d).select("file_id"), v, "file_id").select("file_id", "verdict", "omitted")


@query("sc8_parse_log", r"WITH c AS (SELECT id, hash, insertions, deletions, list_transform(list_filter(coalesce(changed_files, []), lambda x: trim(x) <> ''), lambda x: replace(x, '\', '/')) AS paths FROM commits WHERE author IS NOT NULL AND message IS NOT NULL AND length(trim(message)) > 0) SELECT DISTINCT hash, len(paths) AS files_changed, CAST(len(paths) * 2 AS BIGINT) AS insertions, paths FROM c")
def sc8(s, d):
    # The log text is built from the table, as the version tool prints it, and parsed back.
    c = table(s, d, "commits").where("author is not null and message is not null and length(trim(message)) > 0")
    stats = F.transform(F.filter(F.coalesce("changed_files", F.array().cast("array<string>")), lambda x: F.trim(x) != ""), lambda p: F.concat(F.lit("2\t-\t"), p))
    text = F.concat_ws("\n", "hash", "author", F.regexp_replace("message", r"\s+", " "), "authored_at", F.array_join(stats, "\n"))
    r = parse_log(text)
    return c.select(r.alias("r")).select("r.hash", F.col("r.files_changed").cast("long").alias("files_changed"), "r.insertions", "r.paths").distinct()


@query("tx9_headed_sections", r"SELECT doc_id AS id, len(regexp_extract_all(text, '(?m)^#{1,6}[ \t]+\S.*$')) AS headings FROM documents WHERE regexp_matches(text, '(?m)^#{1,6}[ \t]+\S')")
def tx9(s, d):
    rows = documents.lines(table(s, d, "documents"), "doc_id", "text").where(F.col("line").rlike(r"^#{1,6}[ \t]+\S"))
    return rows.groupBy("id").agg(F.count("*").alias("headings"))


@query("tx9_section_tree")
def tx9t(s, d):
    return documents.headed_sections(table(s, d, "documents"), "doc_id", "text").drop("content")


def _metadata_sql() -> str:
    """Counts of each domain's words in a section's head; the first of the greatest counts is the domain."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    hits = {k: " + ".join(f"contains(h, {quote(w)})::INT" for w in ws) for k, ws in documents.DOMAINS.items()}
    best = f"greatest({', '.join(hits.values())})"
    domain = "CASE WHEN " + best + " = 0 THEN NULL " + " ".join(f"WHEN {n} = {best} THEN '{k}'" for k, n in hits.items()) + " END"
    words = ", ".join(quote(w) for ws in documents.DOMAINS.values() for w in ws)
    return rf"""WITH t AS (SELECT doc_id, text, lower(concat_ws(' ', split_part(text, chr(10), 1), left(text, 500))) AS h FROM documents)
        SELECT doc_id AS id, {domain} AS domain, list_sort(list_distinct(list_filter([{words}], lambda w: contains(h, w)))) AS concepts, list_sort(list_distinct(regexp_extract_all(text, '<\w+\.h>'))) AS headers,
        nullif(upper(regexp_extract(left(text, 2000), '(?i)\b(c(?:89|90|99|11|17|23))\b', 1)), '') AS c_standard FROM t"""


@query("tx12_section_metadata", _metadata_sql())
def tx12(s, d):
    return documents.section_metadata(table(s, d, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "text"), "doc_id", "title", "text")


@query("sx1_tumbling", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def sx1(s, d):
    out = log.drain(log.tumbling(log.read(s, f"{d}/events.parquet"), "ts", ["event_type"], "1 hour", "40 days"))
    return out.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("sx2_running_max", "SELECT event_type AS key, max(value) AS most, count(*) AS n FROM events GROUP BY 1")
def sx2(s, d):
    return log.drain(log.running_max(log.read(s, f"{d}/events.parquet").where("value is not null"), "event_type", "value"), "update")


@query("sx3_sessions", """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM x)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM y GROUP BY user_id, k""")
def sx3(s, d):
    w = table(s, d, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("x1_grouping_sets", f"WITH {FILES} SELECT language, file_source, count(*) AS n FROM f GROUP BY CUBE (language, file_source)")
def x1(s, d):
    return files(s, d).cube("language", "file_source").agg(F.count("*").alias("n"))
