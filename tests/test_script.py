"""JavaScript and TypeScript sources: literals, and the given index as a measure."""

import duckdb
import pytest

from marlstone.sources import code, script

TS = """import type { Config } from "./config";
import Store, { load as read, type Kind } from '../store';
import * as all from "pkg";

/** Greets.
 * @param name - whom
 */
export interface Greeter<T> { greet(name: string): T; }
export type Style = "a" | { b: number };
export enum Level { Low, High }
export const LIMIT: number = 3, other = { a: 1 };

/** A greeter. */
@sealed("x")
export default class Hello<T extends { a: 1 }> extends Base implements Greeter<string> {
  private count = 0;
  #secret() { return 1; }
  handler = (x) => { return x; };
  constructor(private readonly name: string) { super(); }
  /** Says it. */
  async greet(name: string): Promise<{ a: number }> {
    function inner() { return `${name ? `}` : "{"}`; }
    return inner() / 2 / 1;
  }
  get size(): number { return /[/}]/.test("}") ? 1 : 0; }
  abstract later(): void;
}
// TODO: because of x
export async function make(a: { b: number } = { b: 1 }): Promise<void> {
  /* block */
}
function over(a: string): void;
function over(a: any): void { }
const all2 = async <T,>(xs: T[]): Promise<T[]> => {
  return xs;
};
const one = x => x + 1
let plain
"""


def of(text, language, what):
    return [r[1:] for r in script.rows_of(text, language) if r[0] == what]


def test_symbols():
    got = [(n, k, a, b, p) for n, k, a, b, p, *_ in of(TS, "typescript", "symbol")]
    assert got == [
        ("Greeter", "interface", 8, 8, None), ("Style", "type_alias", 9, 9, None), ("Level", "enum", 10, 10, None), ("LIMIT", "variable", 11, 11, None), ("other", "variable", 11, 11, None), ("Hello", "class", 15, 27, None),
        ("constructor", "method", 19, 19, "Hello"), ("greet", "method", 21, 24, "Hello"), ("size", "method", 25, 25, "Hello"), ("make", "function", 29, 31, None), ("over", "function", 33, 33, None), ("all2", "function", 34, 36, None), ("one", "function", 37, 37, None), ("plain", "variable", 38, 38, None),
    ]
    heads = {n: t for n, _, _, _, _, t, *_ in of(TS, "typescript", "symbol")}
    assert heads["greet"] == "async greet(name: string): Promise<{ a: number }>" and heads["all2"] == "all2 = async <T,>(xs: T[]): Promise<T[]> =>" and heads["LIMIT"] == "LIMIT: number = 3"


def test_documentation_comments_and_imports():
    assert [(n, p, t) for n, _, _, _, p, t, *_ in of(TS, "typescript", "docstring")] == [("Greeter", None, "Greets.\n@param name - whom"), (None, None, "A greeter."), ("greet", "Hello", "Says it.")]
    assert [t for _, _, _, _, _, t, *_ in of(TS, "typescript", "comment")] == ["TODO: because of x", "block"]
    assert [(n, k, ns) for n, k, *_, ns in of(TS, "typescript", "import")] == [("./config", "relative type", ["Config"]), ("../store", "relative", ["Store", "load", "Kind"]), ("pkg", "absolute", ["* as all"])]
    js = "const fs = require('fs');\nconst { a, b: c } = require(\"./x\");\nvar z = 1;\n"
    assert [(n, k, ns) for n, k, *_, ns in of(js, "javascript", "import")] == [("fs", "absolute", ["fs"]), ("./x", "relative", ["a", "c"])] and of(js, "typescript", "import") == []


@pytest.mark.parametrize("text", ["", "}", "class", "class A {", "function f(", "`${", "const", "import", "/** x", "export default", "const {a", "x = '", "(]})", "enum E", "interface I", "type T =", "@"])
def test_damaged_texts_give_what_can_be_read(text):
    script.rows_of(text, "typescript")
    script.rows_of(text, "javascript")


@pytest.mark.parametrize("language", ["python", "javascript", "typescript"])
def test_the_index_has_the_same_symbols(language):
    """At least 97 % of the functions, methods and classes that the index holds are found at their lines; the rest lies in damaged files."""
    at = "/root/testdata/sf0.01"
    texts = duckdb.sql(f"select distinct f.id, content from '{at}/source_texts.parquet' join '{at}/files.parquet' f on f.id = file_id where language = '{language}'").fetchall()
    ids = {i for i, _ in texts}
    rows_of = code.rows_of if language == "python" else lambda t: script.rows_of(t, language)
    want = {r for r in duckdb.sql(f"select distinct file_id, name, start_line from '{at}/symbols.parquet'").fetchall() if r[0] in ids}
    got = {(i, r[1], r[3]) for i, text in texts for r in rows_of(text or "") if r[0] == "symbol"}
    assert len(want) > 100 and len(want & got) >= (0.9 if language == "python" else 0.97) * len(want)
