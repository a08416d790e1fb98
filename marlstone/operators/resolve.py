"""Attaching rows to symbols and imports to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def enclosing(rows: DataFrame, key: str, symbols: DataFrame) -> DataFrame:
    """(key, symbol_id): the narrowest symbol of the file around each line, the least id wins ties.

    The file is the join key and the interval a residual filter; the minimum is a hash aggregate.
    """
    s = symbols.select("file_id", F.col("id").alias("symbol_id"), "start_line", "end_line")
    hit = rows.select(key, "file_id", "line").join(s, "file_id").where("line between start_line and end_line")
    return hit.groupBy(key).agg(F.min_by("symbol_id", F.struct(F.col("end_line") - F.col("start_line"), F.col("symbol_id"))).alias("symbol_id"))


def parents_by_name(symbols: DataFrame) -> DataFrame:
    """(id, parent): the last top-level symbol of the file with the parent's name; none gives NULL."""
    s = symbols.select("id", "file_id", "name", F.col("parent_symbol_id").cast("long").alias("pid"))
    top = s.where("pid is null").groupBy("file_id", "name").agg(F.max("id").alias("parent"))
    names = s.select(F.col("id").alias("pid"), F.col("name").alias("pname"))
    return s.join(names, "pid").join(top.withColumnsRenamed({"name": "pname"}), ["file_id", "pname"], "left").select("id", "parent")


def python_candidates(module: Column, names: Column) -> Column:
    """Paths that an absolute import may mean: the module, its package, and each name below it."""
    base = F.translate(module, ".", "/")
    own = F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))
    below = F.flatten(F.transform(names, lambda n: F.array(F.concat(base, F.lit("/"), n, F.lit(".py")), F.concat(base, F.lit("/"), n, F.lit("/__init__.py")))))
    return F.array_distinct(F.concat(own, below))


def python_relative_base(path: Column, level: Column) -> Column:
    """The folder that `level` dots mean in a file: its own for one dot, one parent more for each further dot."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - level)), "/")


def normal_path(path: Column) -> Column:
    """`.` and `..` folded away."""
    return F.array_join(
        F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda acc, x: F.when(x.isin("", "."), acc).when((x == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))),
        "/",
    )


# The endings tried for a relative import, in order.
JS_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")


def js_candidates(module: Column, path: Column) -> Column:
    """Paths that a relative import may mean: as written, with each ending, as a folder's index."""
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    base = normal_path(F.concat_ws("/", folder, module))
    return F.concat(F.array(base), F.array(*[F.concat(base, F.lit(e)) for e in JS_ENDINGS]), F.array(*[F.concat(base, F.lit("/index" + e)) for e in JS_ENDINGS]))


def alias_candidates(module: Column, aliases: dict[str, list[str]], base_url: str | None = None) -> Column:
    """tsconfig `paths` (with one `*`): candidates of the first pattern that matches, else those below `baseUrl`."""
    out = F.array(F.concat(F.lit(base_url + "/"), module)) if base_url else F.array().cast("array<string>")
    for pattern, targets in reversed(list(aliases.items())):
        head, star, tail = pattern.partition("*")
        match = F.startswith(module, F.lit(head)) & F.endswith(module, F.lit(tail)) & (F.length(module) >= len(head) + len(tail)) if star else module == pattern
        middle = F.substring(module, F.lit(len(head) + 1), F.length(module) - len(head) - len(tail))
        out = F.when(match, F.array(*[F.concat(F.lit(t.partition("*")[0]), middle, F.lit(t.partition("*")[2])) if "*" in t else F.lit(t) for t in targets])).otherwise(out)
    return out


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, kind) for imports with src, repo_id, candidates (array) and type_only: every candidate that exists."""
    targets = files.select("repo_id", F.col("path").alias("candidate"), F.col("file_id").alias("dst"))
    rows = imports.select("src", "repo_id", F.when(F.col("type_only"), "type_ref").otherwise("import").alias("kind"), F.explode("candidates").alias("candidate"))
    return rows.join(targets, ["repo_id", "candidate"]).select("src", "dst", "kind")
