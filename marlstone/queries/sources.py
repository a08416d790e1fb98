"""Queries of source parsing and import resolution over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.catalog import table
from marlstone.operators.resolve import js_candidates, normal_path, python_candidates, python_relative_base, resolve_imports
from marlstone.plans import solve
from marlstone.queries.index import FILES, files
from marlstone.registry import query
from marlstone.sources.code import parse, parse_python


def python_rows(s, d):
    py = files(s, d).where("language = 'python'").select("file_id")
    return parse_python(table(s, d, "source_texts").join(py, "file_id", "left_semi"), "file_id", "content")


@query("tx1_python_symbols")
def tx1(s, d):
    return python_rows(s, d).where("what = 'symbol'").select(F.col("id").alias("file_id"), "name", "kind", "start_line", "end_line", "parent", F.col("text").alias("signature"))


@query("tx1_python_references")
def tx1r(s, d):
    r = python_rows(s, d)
    once = r.where("what = 'symbol'").groupBy("id", "name").agg(F.count("*").alias("n")).where("n = 1").select("id", "name")
    return r.where("what = 'reference'").select("id", "name", F.col("parent").alias("caller"), F.col("kind").alias("reference_kind")).distinct().join(once, ["id", "name"], "left_semi")


def script_rows(s, d):
    """Rows of all JavaScript and TypeScript sources."""
    out = None
    for language in ("javascript", "typescript"):
        own = files(s, d).where(F.col("language") == language).select("file_id").distinct()
        rows = parse(table(s, d, "source_texts").join(own, "file_id", "left_semi").distinct(), language, "file_id", "content")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("tx2_script_symbols")
def tx2(s, d):
    return script_rows(s, d).where("what = 'symbol'").select(F.col("id").alias("file_id"), "name", "kind", "start_line", "end_line", "parent", F.col("text").alias("signature"))


@query("tx2_script_documentation")
def tx2d(s, d):
    return script_rows(s, d).where("what = 'docstring'").select(F.col("id").alias("file_id"), "name", "kind", "parent", F.col("text").alias("content"))


_IMPORTED = r"""SELECT DISTINCT file_id, unnest(regexp_extract_all(content, '(?m)^import [^;\n]*from ["\x27]([^"\x27\n]+)["\x27]', 1)) AS module FROM source_texts WHERE file_id IN (SELECT id FROM files WHERE language IN ('javascript', 'typescript'))"""


@query("tx3_script_imports", _IMPORTED)
def tx3(s, d):
    return script_rows(s, d).where("what = 'import'").select(F.col("id").alias("file_id"), F.col("name").alias("module")).distinct()


def import_edges(s, d):
    """(src, dst, kind): the files that imports of python, JavaScript and TypeScript mean."""
    f = files(s, d).select("file_id", "repo_id", "path").distinct()
    of = f.select(F.col("file_id").alias("id"), "repo_id", "path")
    rows = python_rows(s, d).where("what = 'import'").join(of, "id")
    base = python_relative_base(F.col("path"), F.col("level"))
    absolute = python_candidates(F.col("name"), F.col("names"))
    relative = F.transform(absolute, lambda c: normal_path(F.concat_ws("/", base, c)))
    python = rows.select(F.col("id").alias("src"), "repo_id", F.lit(False).alias("type_only"), F.when(F.col("kind") == "relative", relative).otherwise(absolute).alias("candidates"))
    own = script_rows(s, d).where("what = 'import' and kind like 'relative%'").join(of, "id")
    script = own.select(F.col("id").alias("src"), "repo_id", F.endswith("kind", F.lit(" type")).alias("type_only"), js_candidates(F.col("name"), F.col("path")).alias("candidates"))
    return resolve_imports(python.unionByName(script), f)


_SCRIPT_ENDINGS = "['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '/index.mjs', '/index.cjs']"


@query(
    "j6_script_edges",
    rf"""WITH f AS (SELECT DISTINCT id AS file_id, repo_id, path FROM files), m AS ({_IMPORTED}), b AS (SELECT f.file_id AS src, repo_id, regexp_replace(path, '[^/]*$', '') || regexp_replace(module, '^\./', '') AS base FROM m JOIN f USING (file_id) WHERE starts_with(module, './')
    UNION ALL SELECT f.file_id, repo_id, regexp_replace(path, '[^/]*/[^/]*$', '') || regexp_replace(module, '^\.\./', '') FROM m JOIN f USING (file_id) WHERE starts_with(module, '../') AND NOT starts_with(module, '../../')),
    c AS (SELECT src, repo_id, unnest({_SCRIPT_ENDINGS}) AS e, base FROM b) SELECT src, f.file_id AS dst, 'import' AS kind FROM c JOIN f ON f.repo_id = c.repo_id AND f.path = c.base || c.e""",
)
def j6s(s, d):
    return import_edges(s, d).join(files(s, d).where("language in ('javascript', 'typescript')").select(F.col("file_id").alias("src")).distinct(), "src", "left_semi")


@query("j6_import_edges")
def j6(s, d):
    return import_edges(s, d)


@query("sc5_imported_packages", r"SELECT DISTINCT unnest(regexp_extract_all(content, '(?m)^(?:import|from) ([A-Za-z_]\w*)[\w.]*(?: import .*|[ \t]*,.*|[ \t]+as .*|[ \t]*\r?)$', 1)) AS package FROM source_texts WHERE file_id IN (SELECT id FROM files WHERE language = 'python')")
def sc5(s, d):
    from marlstone.sources.scan import imported_packages

    return imported_packages(python_rows(s, d).where("what = 'import'").select(F.col("name").alias("module"), (F.col("kind") == "relative").alias("is_relative")))


@query("g9_parts", f"""WITH RECURSIVE {FILES}, ed AS (SELECT DISTINCT least(a.file_id, b.file_id) AS x, greatest(a.file_id, b.file_id) AS y FROM f a JOIN f b ON a.content_hash = b.content_hash AND a.file_id <> b.file_id), b2 AS (SELECT x, y FROM ed UNION SELECT y, x FROM ed),
    r AS (SELECT file_id AS node, file_id AS root FROM f UNION SELECT b2.y, r.root FROM r JOIN b2 ON b2.x = r.node), c AS (SELECT node, min(root) AS comp FROM r GROUP BY 1)
    SELECT 'p' || dense_rank() OVER (ORDER BY comp) AS part, list_sort(list(DISTINCT node)) AS files, min_by(path, node) AS description FROM c JOIN f ON f.file_id = node GROUP BY comp""")
def g9(s, d):
    f = files(s, d)
    # Equal contents are tied to their least file: a star per content, not all pairs.
    low = f.groupBy("content_hash").agg(F.min("file_id").alias("dst"), F.count("*").alias("n")).where("n > 1")
    edges = f.join(low, "content_hash").where("file_id <> dst").select(F.col("file_id").alias("src"), "dst")
    return solve.parts(edges, f.select(F.col("file_id").alias("node"), F.col("path").alias("description")))


@query("tx6_stub_returns", r"SELECT DISTINCT id, CASE WHEN t = 'void' THEN '' WHEN t LIKE '%*' THEN 'return NULL;' WHEN t IN ('float', 'double') THEN 'return 0.0;' WHEN t IN ('bool', '_Bool') THEN 'return false;' ELSE 'return 0;' END AS body FROM (SELECT id, regexp_replace(trim(regexp_extract(signature, '^(.*?)\w+\s*\(', 1)), '\b(?:static|inline|extern|const)\b\s*', '', 'g') AS t FROM symbols WHERE signature IS NOT NULL AND file_id IN (SELECT id FROM files WHERE language = 'c'))")
def tx6(s, d):
    c = files(s, d).where("language = 'c'").select("file_id")
    sym = table(s, d, "symbols").where("signature is not null").join(c, "file_id", "left_semi")
    return sym.select("id", solve.stub_return(F.regexp_extract("signature", r"^(.*?)\w+\s*\(", 1)).alias("body")).distinct()


@query("tx14_rendered_slices")
def tx14(s, d):
    from marlstone.operators.assemble import slices

    return slices(table(s, d, "symbols").where("parent_symbol_id is null").select("file_id", "start_line", "end_line").distinct(), table(s, d, "source_texts"))


@query("sk17_session_roundtrip", "SELECT status AS key, max_by(repo_path, (run_at, id)) AS value FROM index_runs WHERE status IS NOT NULL GROUP BY 1")
def sk17(s, d):
    kv = table(s, d, "index_runs").where("status is not null").select(F.col("status").alias("key"), F.col("repo_path").alias("value"), F.struct("run_at", "id").alias("updated_at"))
    return solve.restore_session(solve.session_blob(kv, "t").withColumn("id", F.lit(1))).select("key", "value")
