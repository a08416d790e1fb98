"""Source trees, libraries and version logs as DataFrames."""

from __future__ import annotations

import json
import re
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import LANGUAGE_OF, language
from marlstone.operators.history import parse_log

# Folders and endings that are never scanned.
SKIP_DIRS = (".git", "node_modules", "__pycache__", ".venv", "venv", ".marlstone", "dist", "build", ".eggs")
SKIP_ENDINGS = (".pyc", ".min.js", ".min.css", ".map")
LIBRARY_SKIP_DIRS = ("tests", "test", "_vendor", "examples", "docs", "testing", "benchmarks")
MAX_BYTES, MAX_LIBRARY_BYTES = 1 << 20, 512 << 10


def ignore_regexes(text: str) -> list[tuple[str, bool]]:
    """(regex, ignored) rules of a gitignore text, in order; the last match decides."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        p = line[keep:].lstrip("\\")
        anchored, folder = "/" in p.rstrip("/"), p.endswith("/")
        p = p.strip("/")
        rx = re.sub(r"\\\*\\\*/", "(?:.*/)?", re.escape(p))
        rx = re.sub(r"\\\*\\\*", ".*", rx)
        rx = re.sub(r"\\\*", "[^/]*", rx).replace(r"\?", "[^/]")
        out.append((("^" if anchored else "(?:^|/)") + rx + ("/" if folder else "(?:/|$)"), not keep))
    return out


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    out = F.lit(False)
    for rx, yes in rules:
        out = F.when(path.rlike(rx), F.lit(yes)).otherwise(out)
    return out


def _tree(spark: SparkSession, root: str) -> DataFrame:
    """Path and length of all files; the content column is read only where it is asked for."""
    uri = root if "://" in root else Path(root).resolve().as_uri()
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    prefix = uri.replace("file:///", "file:/") if uri.startswith("file:") else uri
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "file:/"), "^" + re.escape(prefix.rstrip("/")) + "/", "")
    return df.withColumn("path", rel)


def scan_repo(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, gitignore: str = "") -> DataFrame:
    """(path, language, size_bytes, content_hash) of a tree, ordered by path; cheap filters run before any content is read."""
    folders = r"(?:^|/)(?:" + "|".join(map(re.escape, SKIP_DIRS)) + r"|[^/]*\.egg-info)/"
    df = _tree(spark, root).where(~F.col("path").rlike(folders))
    for e in SKIP_ENDINGS:
        df = df.where(~F.endswith("path", F.lit(e)))
    df = df.where(language(F.col("path")).isNotNull() & (F.col("length") <= max_bytes) & ~ignored(F.col("path"), ignore_regexes(gitignore)))
    return df.select("path", language(F.col("path")).alias("language"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("content_hash")).orderBy("path")


def scan_library(spark: SparkSession, root: str, package: str, max_bytes: int = MAX_LIBRARY_BYTES) -> DataFrame:
    """(path, size_bytes, skip_reason): python files of a package; skip_reason is null for those kept."""
    folder = F.regexp_extract("path", r"(?:^|/)(" + "|".join(LIBRARY_SKIP_DIRS) + ")/", 1)
    reason = F.when(folder != "", F.concat(F.lit("folder "), folder)).when(F.col("length") > max_bytes, "too large")
    return _tree(spark, root).where(F.endswith("path", F.lit(".py"))).select(F.concat(F.lit(package + "/"), "path").alias("path"), F.col("length").alias("size_bytes"), reason.alias("skip_reason"))


def imported_packages(imports: DataFrame) -> DataFrame:
    """Distinct top packages of absolute imports."""
    return imports.where(~F.col("is_relative")).select(F.split_part("module", F.lit("."), F.lit(1)).alias("package")).where("package <> ''").distinct()


def read_log(spark: SparkSession, path: str, mark: str = "---commit---") -> DataFrame:
    """Commits of a log dumped to a text file, records divided by a mark line: the reader splits, no task sees the whole file."""
    rows = spark.read.option("lineSep", mark + "\n").text(path)
    return rows.select(parse_log(F.col("value")).alias("r")).where("r is not null").select("r.*")


def plan_files(spark: SparkSession, path: str) -> list[str]:
    """Affected files of a plan (strings or objects with a path), on the driver: a plan is small."""
    plan = json.loads(Path(path).read_text())
    return [x if isinstance(x, str) else x["path"] for x in plan.get("affected_files", [])]


def load_config(path: str) -> dict:
    p = Path(path)
    return tomllib.loads(p.read_text()) if p.exists() else {}


def reference_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """(id, description, task_type, must, should, must_not, low, high) of TOML tasks by id; missing sections and repeated ids are errors."""
    out, seen = [], set()
    for p in sorted(Path(folder).glob("*.toml")):
        t = tomllib.loads(p.read_text())
        for need in ("task", "context_requirements", "routing_notes"):
            if need not in t:
                raise ValueError(f"{p.name}: no [{need}]")
        task, c = t["task"], t["context_requirements"]
        if task["id"] in seen:
            raise ValueError(f"{p.name}: id {task['id']} again")
        seen.add(task["id"])
        low, high = c.get("budget_range", [0, 100])
        out.append((task["id"], task["description"], task["task_type"], c.get("must_contain_files", []), c.get("should_contain_files", []), c.get("must_not_contain", []), float(low), float(high)))
    return spark.createDataFrame(sorted(out), "id string, description string, task_type string, must array<string>, should array<string>, must_not array<string>, low double, high double")


ENDINGS = tuple(LANGUAGE_OF)
