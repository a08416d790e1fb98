"""Queries of the text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.catalog import table
from marlstone.functions import text as X
from marlstone.operators import assemble
from marlstone.registry import query


def calls(s, d):
    return table(s, d, "retrieval_llm_calls").select("id", "prompt", "response", "system_prompt").distinct()


# The SQL of RE2: names and lines that the task functions take out of a prompt.
_P_PATHS = r"""regexp_extract_all(prompt, '(?m)(?:^|[\s''"`(\x7b,])([a-zA-Z0-9_./-]+\.(?:tsx|ts|jsx|js|mjs|cjs|py|c|h))(?:[\s''"`)\x7d,:;]|$)', 1)"""
_P_NAMES = r"""list_concat(list_concat(regexp_extract_all(prompt, '\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b', 1), regexp_extract_all(prompt, '\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b', 1)), regexp_extract_all(prompt, '\b([A-Za-z]\w+\.[a-z_]\w+)\b', 1))"""
_P_ERRORS = r"""regexp_extract_all(prompt, '(?im)^.*(?:Error:|Exception:|Traceback|at line)\s*.*$')"""
_P_WORDS = r"""regexp_extract_all(lower(prompt), '(?:^|[^\p{L}\p{N}_])([a-zA-Z_][\p{L}\p{N}_]*)', 1)"""


@query("st2_file_paths", f"SELECT id, p AS path FROM (SELECT DISTINCT id, unnest({_P_PATHS}) AS p FROM retrieval_llm_calls)")
def st2(s, d):
    return calls(s, d).select("id", F.explode(X.file_paths(F.col("prompt"))).alias("path")).distinct()


@query("st3_symbol_names", f"SELECT DISTINCT id, list_sort(list_distinct({_P_NAMES})) AS names FROM retrieval_llm_calls")
def st3(s, d):
    return calls(s, d).select("id", X.symbol_names(F.col("prompt")).alias("names"))


@query("st4_error_lines", f"SELECT DISTINCT id, {_P_ERRORS} AS lines FROM retrieval_llm_calls")
def st4(s, d):
    return calls(s, d).select("id", X.error_lines(F.col("prompt")).alias("lines")).distinct()


@query("st5_keywords", f"""SELECT DISTINCT id, list_sort(list_filter(list_distinct({_P_WORDS}), lambda w: length(w) > 2 AND NOT list_contains({X.STOP!r}, w)
    AND NOT list_contains(list_transform(list_concat(list_concat({_P_PATHS}, {_P_NAMES}), {_P_ERRORS}), lambda x: lower(x)), w))) AS words FROM retrieval_llm_calls""")
def st5(s, d):
    return calls(s, d).select("id", F.array_sort(X.keywords(F.col("prompt"))).alias("words"))


_RULES = "CASE " + " ".join(f"WHEN list_has_any(w, {ws!r}) THEN '{k}'" for k, ws in X.TASK_RULES.items()) + " ELSE 'unknown' END"


@query("st6_task_type", f"SELECT id, {_RULES} AS task_type FROM (SELECT DISTINCT id, {_P_WORDS} AS w FROM retrieval_llm_calls)")
def st6(s, d):
    return calls(s, d).select("id", X.task_type(F.col("prompt")).alias("task_type"))


@query(
    "st7_comment_kind",
    r"""SELECT DISTINCT id, CASE WHEN regexp_matches(lower(content), '\btodo\b') THEN 'todo' WHEN regexp_matches(lower(content), '\bfixme\b') THEN 'fixme' WHEN regexp_matches(lower(content), '\bhack\b') THEN 'hack'
    WHEN regexp_matches(lower(content), '\bnote\b') THEN 'note' WHEN regexp_matches(lower(content), '\b(?:bug|issue|ticket)[-\s]?#?\d+|#\d+\b') THEN 'bug_ref'
    WHEN regexp_matches(lower(content), '\bbecause\b|\bsince\b|\bin order to\b|\bso that\b|\b(?:reason|why|rationale):\b') THEN 'rationale' ELSE 'general' END AS kind FROM inline_comments""",
)
def st7(s, d):
    return table(s, d, "inline_comments").select("id", X.comment_kind(F.col("content")).alias("kind")).distinct()


@query(
    "st8_docstring_format",
    r"""SELECT DISTINCT id, CASE WHEN regexp_matches(content, '(?m)^\s*(?:Args|Arguments|Returns|Raises|Yields|Attributes|Example|Examples|Note):\s*$') THEN 'google'
    WHEN regexp_matches(content, '(?m)^\s*(?:Parameters|Returns|Raises|Yields|Attributes)[ \t]*\r?\n\s*-{3,}') THEN 'numpy'
    WHEN regexp_matches(content, '(?m)^\s*:(?:param|type|returns?|rtype|raises)\b') THEN 'sphinx' ELSE 'plain' END AS format FROM docstrings""",
)
def st8(s, d):
    return table(s, d, "docstrings").select("id", X.docstring_format(F.col("content")).alias("format")).distinct()


@query("st13_strip_thinking", r"SELECT DISTINCT id, CASE WHEN contains(response, '<think>') THEN trim(regexp_extract(response, '(?s)^(.*?)<think>', 1) || CASE WHEN contains(response, '</think>') THEN regexp_extract(response, '(?s)^.*</think>(.*)$', 1) ELSE '' END) ELSE response END AS response FROM retrieval_llm_calls")
def st13(s, d):
    return calls(s, d).select("id", X.strip_thinking(F.col("response")).alias("response"))


@query("st14_strip_fence", r"SELECT DISTINCT id, CASE WHEN regexp_matches(trim(response), '(?s)^```[a-zA-Z]*\s*\n.*?\n?```\s*$') THEN regexp_extract(trim(response), '(?s)^```[a-zA-Z]*\s*\n(.*?)\n?```\s*$', 1) ELSE response END AS response FROM retrieval_llm_calls")
def st14(s, d):
    return calls(s, d).select("id", X.strip_fence(F.col("response")).alias("response"))


@query("st15_slug", r"SELECT doc_id, left(trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', '_', 'g'), '_'), 60) AS slug FROM documents")
def st15(s, d):
    return table(s, d, "documents").select("doc_id", X.slug(F.split_part("text", F.lit("\n"), F.lit(1))).alias("slug"))


@query("st16_tail", "SELECT DISTINCT id, right(response, 80) AS tail, left(prompt, 40) AS head FROM retrieval_llm_calls")
def st16(s, d):
    return calls(s, d).select("id", X.keep_tail(F.col("response"), 80).alias("tail"), X.keep_head(F.col("prompt"), 40).alias("head")).distinct()


@query("st18_tree_line", "SELECT DISTINCT id, repeat('  ', len(string_split(path, '/')) - 1) || string_split(path, '/')[-1] AS line FROM files")
def st18(s, d):
    return table(s, d, "files").select("id", X.tree_line(F.col("path")).alias("line")).distinct()


@query("sc4_language_of_path", "SELECT DISTINCT id, CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.mjs' THEN 'javascript' WHEN '.cjs' THEN 'javascript' WHEN '.c' THEN 'c' WHEN '.h' THEN 'c' END AS language FROM files")
def sc4(s, d):
    return table(s, d, "files").select("id", X.language(F.col("path")).alias("language")).distinct()


@query("st23_answers", """SELECT DISTINCT id, CASE WHEN a = 'yes' THEN true WHEN a = 'no' THEN false ELSE coalesce(j IN ('relevant', 'yes', 'true'), false) END AS verdict, a NOT IN ('yes', 'no') AND j IS NULL AS omitted
    FROM (SELECT id, lower(trim(trim(response), '.!')) AS a, CASE WHEN json_valid(response) AND json_type(response) = 'OBJECT' THEN lower(coalesce(response->>'$.verdict', response->>'$.keep')) END AS j FROM retrieval_llm_calls WHERE call_type = 'scope_judgment' AND response IS NOT NULL)""")
def st23(s, d):
    judged = table(s, d, "retrieval_llm_calls").where("call_type = 'scope_judgment' and response is not null").select("id", X.answer(F.col("response")).alias("a")).distinct()
    return judged.select("id", "a.verdict", "a.omitted")


@query("nu1_token_estimates", "SELECT doc_id, greatest(1, length(text) // 4) AS tokens, length(text) // 3 AS careful FROM documents")
def nu1(s, d):
    return table(s, d, "documents").select("doc_id", assemble.token_estimate(F.col("text")).alias("tokens"), assemble.conservative_tokens(F.col("text")).alias("careful"))


@query("nu3_budget", "SELECT DISTINCT id, CAST(floor((coalesce(prompt_tokens, 0) * 10 - coalesce(completion_tokens, 0)) * CAST(0.9 AS DOUBLE)) AS BIGINT) AS budget FROM retrieval_llm_calls")
def nu3(s, d):
    t = table(s, d, "retrieval_llm_calls")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return t.select("id", assemble.effective_budget(zero("prompt_tokens") * 10, zero("completion_tokens")).alias("budget")).distinct()


@query("aj1_parsed_fields", "SELECT DISTINCT id, len(CAST(json_extract(parsed_fields, '$.params') AS VARCHAR[])) AS params, CAST(json_extract(parsed_fields, '$.n') AS BIGINT) AS n FROM docstrings WHERE parsed_fields IS NOT NULL AND json_valid(parsed_fields)")
def aj1(s, d):
    j = F.from_json("parsed_fields", "params array<string>, n long")
    return table(s, d, "docstrings").where(F.col("parsed_fields").isNotNull() & F.try_parse_json("parsed_fields").isNotNull()).select("id", F.when(j["params"].isNotNull(), F.size(j["params"])).cast("long").alias("params"), j["n"].alias("n")).distinct()


@query("aj1_reported_co_changes", "SELECT id, x->>'$[0]' AS path_a, x->>'$[1]' AS path_b, CAST(x->>'$[2]' AS BIGINT) AS n FROM (SELECT id, unnest(CAST(co_change_counts AS JSON[])) AS x FROM index_runs WHERE co_change_counts IS NOT NULL AND json_valid(co_change_counts))")
def aj1b(s, d):
    rows = table(s, d, "index_runs").select("id", F.explode(F.from_json("co_change_counts", "array<array<string>>")).alias("x"))
    return rows.select("id", F.col("x")[0].alias("path_a"), F.col("x")[1].alias("path_b"), F.col("x")[2].cast("long").alias("n"))


@query("aj3_jsdoc_tags", r"SELECT DISTINCT id, len(list_distinct(regexp_extract_all(content, '(?m)^\s*@(\w+)', 1))) AS tags, len(list_filter(regexp_extract_all(content, '(?m)^\s*@(\w+)', 1), lambda x: x = 'param')) AS params FROM docstrings WHERE format = 'jsdoc'")
def aj3(s, d):
    t = X.jsdoc_tags(F.col("content"))
    return table(s, d, "docstrings").where("format = 'jsdoc'").select("id", F.size(F.map_keys(t)).cast("long").alias("tags"), F.size(F.coalesce(F.try_element_at(t, F.lit("param")), F.array().cast("array<string>"))).cast("long").alias("params")).distinct()


@query("sk18_fence", "SELECT DISTINCT id, repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(response, '`+'), lambda x: length(x))), 0) + 1)) AS fence FROM retrieval_llm_calls WHERE response IS NOT NULL")
def sk18(s, d):
    return calls(s, d).where("response is not null").select("id", X.fence_for(F.col("response")).alias("fence")).distinct()


@query("tx17_include", r"SELECT file_id, CASE WHEN contains(content, '#include <stdio.h>') THEN content ELSE array_to_string(list_concat(list_concat(l[1:k], ['#include <stdio.h>']), l[k + 1:]), chr(10)) END AS content FROM (SELECT file_id, content, l, coalesce(list_max(list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '^\s*#\s*include\b'))), 0) AS k FROM (SELECT file_id, content, string_split(content, chr(10)) AS l FROM source_texts WHERE file_id IN (SELECT id FROM files WHERE language = 'c')))")
def tx17(s, d):
    c = table(s, d, "files").where("language = 'c'").select(F.col("id").alias("file_id"))
    return table(s, d, "source_texts").join(c, "file_id", "left_semi").select("file_id", X.include_line(F.col("content"), F.lit("<stdio.h>")).alias("content"))


@query("st20_unescape", "SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&nbsp;', ' '), '&#39;', ''''), '&mdash;', '—'), '&ndash;', '–'), '&hellip;', '…'), '&copy;', '©'), '&amp;', '&') AS text FROM documents")
def st21(s, d):
    return table(s, d, "documents").select("doc_id", X.unescape(F.col("text")).alias("text"))
