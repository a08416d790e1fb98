"""Operators for training data: against brute force, exact round trips, and edge cases."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import cooccur, docwords, functions, grammar_c, grammar_js, langid, leaks, lexing, natural, packing, pairs, parsing, provenance, splitting
from marlstone.llm.common import TOKEN, token_count

FILES = "id long, repo_id long, path string, language string, content_hash string, size_bytes long, file_source string"
TEXTS = "file_id long, content string, path string, id long"  # with clashing names


def sources(spark, rows):
    """rows: (id, repo, path, language, source, text)."""
    f = spark.createDataFrame([(i, r, p, l, "h", len(t or ""), s) for i, r, p, l, s, t in rows] or [], FILES)
    t = spark.createDataFrame([(i, t, "x", -1) for i, _, _, _, _, t in rows] or [], TEXTS)
    return f.unionByName(f.limit(1)), t.unionByName(t.limit(1))


# --- 1

GOOD = {
    "python": ["", "x = 1\n", "def f(a):\n    '''d'''\n    return {'a': [1,\n 2]}\n\nclass C:\n    x = '''\n) not code'''\n", "match x:\n    case 1:\n        pass\n"],
    "javascript": ["", "import a from 'b';\nexport const f = async (x) => { await x; return `a${x ? `b` : '}'}`; };\n", "class A { #p = 1; get q() { return /[/]}/.test(1) / 2 } }\n"],
    "typescript": ["let x: Map<string, Array<number>> = new Map<string, Array<number>>();\n", "interface I<T> { a?: T; (x: number): void }\nabstract class C<T> implements I<T> { constructor(private a: string) {} foo(): void; foo(x?: any) {} }\nconst f = <T,>(x: T): x is T => x as any;\n"],
    "c": ["int f(int a) { return (char) a; }\n", "#define OPEN(x) if (x) {\nvoid f(int x) { OPEN(x) g(); } }\n", "typedef struct n { int a : 3; } n_t;\nstatic n_t t[] = { [0] = { .a = 1 } };\n", "#if 0\nnot c at all '\n#else\nint x;\n#endif\n"],
}
BAD = {
    "python": ["def f(:\n  pass", "x = (1,", "print 'a'", "if x:\npass", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "s = '''open", "x = 0777", "return 1"],
    "javascript": ["const x;", "let x: number = 1", "f(", "`open ${x}", "/* open", "return 1", "a b", "'x\ny'", "<<<<<<< a\nx\n", "for (;;", "x = 0777", "def f(x):\n  pass"],
    "typescript": ["let x: = 1", "interface A { a: }", "enum E { A B }", "function f(a: number b) {}", "int main(void) { return 0; }"],
    "c": ["int f( {", "int x", "int f() { return 1 }", "#if A\nint x;", "#endif", "class A { public: int x; };", "int f() { 5 = x; }", 'char *s = "open;', "int f() { if x { } }", "def f(x):\n  return 1"],
}


@pytest.mark.parametrize("language", parsing.LANGUAGES)
def test_grammars(language):
    assert [t for t in GOOD[language] if not parsing.is_valid(language, t)] == []
    assert [t for t in BAD[language] if parsing.is_valid(language, t)] == []


def test_state_maps_compose_associatively_and_equal_the_whole():
    rnd = random.Random(1)
    for language in parsing.LANGUAGES:
        for text in GOOD[language]:
            lines = text.splitlines(keepends=True)
            whole = parsing.state_map(language, text)
            for _ in range(5):
                cuts = sorted(rnd.sample(range(len(lines) + 1), min(2, len(lines) + 1)))
                parts = ["".join(lines[a:b]) for a, b in zip([0, *cuts], [*cuts, len(lines)])]
                maps = [parsing.state_map(language, p) for p in parts]
                if len(maps) == 3:
                    left = parsing.compose(parsing.compose(maps[0], maps[1]), maps[2])
                    right = parsing.compose(maps[0], parsing.compose(maps[1], maps[2]))
                    assert left["N"] == right["N"]
                    if "!" not in left["N"][1]:
                        assert left["N"][:3] == whole["N"][:3] and sorted(left["N"][3].split("\n")) == sorted(whole["N"][3].split("\n"))


@pytest.mark.parametrize("chunk", [8, 60, 8192])
def test_broken_at_any_chunk_size(spark, chunk):
    rows, want, i = [], set(), 0
    for language in parsing.LANGUAGES:
        for ok, texts in ((True, GOOD), (False, BAD)):
            for t in texts[language]:
                for reps in (1, 4):
                    i += 1
                    text = (t + "\n") * reps if ok and language in ("python", "c") else t
                    rows.append((i, 1, f"a{i}", language, "project", text))
                    if not parsing.is_valid(language, text):
                        want.add(i)
    rows += [(900, 1, "kb/x", "text", "knowledge_base", "def f(:"), (901, 1, None, None, None, "("), (902, 1, "n", "python", "project", None)]
    got = {r.file_id for r in parsing.broken(*sources(spark, rows), chunk=chunk).collect()}
    assert got == want
    assert parsing.broken(*sources(spark, []), chunk=chunk).count() == 0


def test_no_verdict_depends_on_the_chunk_size(spark, sf):
    """All texts of the smallest tables, in which damaged ones are planted, and the same as the exact check of whole texts."""
    files, texts = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("files", "source_texts"))
    language = {r.id: r.language for r in files.where("file_source <> 'knowledge_base'").collect()}
    want = {r.file_id for r in texts.collect() if language.get(r.file_id) in parsing.LANGUAGES and not parsing.is_valid(language[r.file_id], r.content or "")}
    assert want
    for chunk, group in ((64, 3), (500, 64), (8192, 64), (1 << 20, 64)):
        assert {r.file_id for r in parsing.broken(files, texts, chunk, group).collect()} == want


def test_late_facts_beyond_one_chunk(spark):
    filler = {"python": "def f{0}(a):\n    return a\n\n\n", "javascript": "export function f{0}(a) {{ return a; }}\n", "typescript": "export function f{0}(a: any): any {{ return a; }}\n", "c": "int f{0}(int a) {{ return a; }}\n"}
    long_ = {k: "".join(v.format(i) for i in range(400)) for k, v in filler.items()}
    bad = [
        ("python", long_["python"] + "from __future__ import annotations\n"), ("python", long_["python"] + "global f3\n"), ("javascript", long_["javascript"] + "export { f3 };\n"),
        ("javascript", "export default 1;\n" + long_["javascript"] + "export default class {}\n"), ("c", "#define END 5\n" + long_["c"] + "int END;\n"), ("c", "#if 1\n" + long_["c"]), ("c", long_["c"] + "#endif\n"),
    ]
    good = [
        ("python", "'d'\nfrom __future__ import annotations\n" + long_["python"]), ("typescript", long_["typescript"] + "export function f3(a: string): string;\n"), ("javascript", "export default 1;\n" + long_["javascript"]),
        ("c", "#ifndef A\n#define A\n#define BEGIN {\n" + long_["c"] + "int g(void) BEGIN return 1; }\n#endif\n"), ("c", "typedef struct { int a; } node;\n" + long_["c"] + "int h(node *n) { return (node) *n, sizeof(node); }\n"),
        ("c", "#if 0\n" + long_["c"] + "not c ( at all\n#endif\n"), ("javascript", "const t = `${[\n" + "  1,\n" * 4000 + "]}`;\n"), ("python", 'x = f"{"(" }"\n' + long_["python"]),
    ]
    rows = [(k, 1, "a", l, "project", t) for k, (l, t) in enumerate(bad + good)]
    assert [parsing.is_valid(l, t) for l, t in bad + good] == [False] * len(bad) + [True] * len(good)
    for chunk, group in ((100, 4), (4096, 2), (8192, 64)):
        assert {r.file_id for r in parsing.broken(*sources(spark, rows), chunk=chunk, group=group).collect()} == set(range(len(bad)))


def test_broken_looks_across_stretches(spark):
    lines = "x = 1\ny = 2\n" * 4
    bad = {
        "python": [lines + "from __future__ import annotations\n", lines + "if y:\n    global x\n", lines + "\ufeffz = 1\n"],
        "c": ["#define V 5\nint a;\nint b;\nint V;\n"],
    }
    good = {"python": ["'d'\nfrom __future__ import annotations\n" + lines, lines + "def f():\n    global x\n    x = 3\n"], "c": ["#ifndef A\n#define A\nint a;\nint f(void) { return 1; }\n#endif\n"]}
    rows = [(k, 1, "a", l, "project", t) for k, (l, t) in enumerate((l, t) for texts in (bad, good) for l, ts in texts.items() for t in ts)]
    want = {i for i, _, _, l, _, t in rows if not parsing.is_valid(l, t)}
    assert want == set(range(4)) and {r.file_id for r in parsing.broken(*sources(spark, rows), chunk=8).collect()} == want


def test_doubtful_giants_are_parsed(spark):
    text = 'x = f"{"(" }"\n' + ("# " + "y" * 8000 + "\n") * 1100
    rows = [(1, 1, "a.py", "python", "project", text), (2, 1, "b.py", "python", "project", text + "x = )\n")]
    assert len(text) > 8 << 20 and {r.file_id for r in parsing.broken(*sources(spark, rows)).collect()} == {2}


def test_rates(spark):
    f, t = sources(spark, [(1, 7, "a", "python", "project", "x = ("), (2, 7, "b", "python", "project", "x = 1"), (3, 7, "c", "c", "project", "int x;")])
    runs = spark.createDataFrame([(1, 7, 5, "2024-01-01"), (2, 7, 9, "2024-02-01"), (3, 7, None, "2024-03-01")], "id long, repo_id long, parse_errors long, run_at string")
    assert {(r.language, r.files, r.broken, r.rate, r.reported) for r in parsing.rates(f, t, runs).collect()} == {("python", 2, 1, 0.5, 9), ("c", 1, 0, 0.0, 9)}


# --- 2

@pytest.mark.parametrize("content,ok", [
    (None, False), ("", False), ("  \n\t", False), ("TODO", False), ("_summary_", False), ("parse_file()", False), ("Parses the file.", False), ("This function parses the file.", False), ("{@inheritDoc}", False), ("待补充", False), ("N/A", False),
    ("Parse file.\n\nArgs:\n    path: path", False), (":param path:\n:return:", False), ("@param {string} path - the path\n@returns {Object}", False), ("Parse file.\n\nArgs:\n    path: relative to the checkout root", True),
    ("Returns None once the cache has been emptied.", True), ("必须等缓存删除之后才能读取日志。", True), ("Каждый файл должен быть закрыт.", True), ("@param path where the ledger lies", True), ("TODO: shorten. Readers hold the lock while we wait.", True),
])
def test_trivial_documentation(content, ok):
    assert docwords.says_something(content, "parse_file", "def parse_file(path: str) -> Node:") is ok


def test_functions_of_sources(spark):
    py = 'def f(a):\n    """Why it is so."""\n    if a:\n        return 1\n\n    return 2\n\nclass C:\n    def m(self,\n          x): return x\n'
    js = "/** Tells when to stop. */\nexport async function go(a, { b = 1 }) {\n  if (a) { return b; }\n}\nclass K {\n  /**\n   * Waits for the lock.\n   */\n  run(x) {\n    return x;\n  }\n}\n"
    c = "/** Says why. */\nstatic int add(int a) {\n  return a;\n}\nint decl(int a);\n"
    rows = [(1, 1, "a.py", "python", "project", py), (2, 1, "b.js", "javascript", "project", js), (3, 1, "c.c", "c", "project", c), (4, 1, "d", "c", "project", None), (5, 1, "e", "text", "project", "x")]
    got = {(r.file_id, r.name, r.start_line, r.end_line, (r.doc or "").strip()) for r in functions.extract(*sources(spark, rows)).collect()}
    assert got == {(1, "f", 1, 6, "Why it is so."), (1, "m", 9, 10, ""), (2, "go", 2, 4, "Tells when to stop."), (2, "run", 9, 11, "Waits for the lock."), (3, "add", 2, 4, "Says why.")}


def test_pairs_with_documentation(spark):
    f, t = sources(spark, [(1, 1, "a.py", "python", "project", "def load_view(path):\n    return 1\n")])
    sym = spark.createDataFrame([(1, 1, "load_view", " Function", 1, 2, None, None), (1, 1, "load_view", " Function", 1, 2, None, None), (2, 1, "C", "class", 5, 9, "class C", None), (3, 1, "m", "METHOD", 6, 7, "def m(self)", 2)], "id long, file_id long, name string, kind string, start_line long, end_line long, signature string, parent_symbol_id long")
    docs = spark.createDataFrame([(1, 1, "Loads the view.\n\nArgs:\n  path: the path", 1, "plain"), (2, 1, "Only safe under the lock.", 1, None), (2, 1, "Only safe under the lock.", 1, None), (3, 2, "A class of its own.", 1, None), (4, None, "Module text.", 1, None), (5, 99, "Nobody's text.", 1, None), (6, 3, None, 1, None), (7, 3, "Method m.", 1, None)], "id long, symbol_id long, content string, file_id long, name string")
    assert {(r.symbol_id, r.docstring_id) for r in functions.pairs(sym, docs, f, t).collect()} == {(1, 2)}
    assert functions.pairs(sym.limit(0), docs.limit(0), f.limit(0), t.limit(0)).count() == 0


# --- 3

@pytest.mark.parametrize("text,lang", [
    ("never slice a duplicate tree twice", "en"), ("TODO(dev-3): Der Knoten wird vor dem Lauf gesperrt.", "de"), ("Sans lot, il est impossible de vérifier le lot.", "fr"), ("Si falta el nodo, se conserva el anterior.", "es"), ("Este lote só deve ser apagado uma vez.", "pt"),
    ("Każdy plik może być usunięty tylko raz.", "pl"), ("Здесь узел уже проверен, потому что памяти мало.", "ru"), ("请不要在这里修改指针，否则顺序无法保证。", "zh"), ("章を集計してから結果を読みます。", "ja"), ("the cache is full, see `load_view()`", "en"),
    ("return artifact;", None), ("noqa: E501", None), ("-----------", None), ("SELECT id, path FROM files WHERE id = ?", None), ("https://x.invalid/a b c", None), ("x = load(y, 3)", None), ("if (a) { b(); }", None), ("watcher prompt", None), ("%Y-%m-%dT%H:%M:%S", None), ("a.node > li:nth-child(4)", None), (None, None), ("", None),
])
def test_prose(text, lang):
    assert natural.prose_language(text) == lang


def test_segments_of_two_languages():
    text = "We keep the cache because callers hold a reference. Der Knoten wird vor dem nächsten Lauf gesperrt, weil der Speicher knapp ist."
    assert [x for x, _, _ in langid.segments(text)] == ["en", "de"]


def test_best_segmentation_equals_brute_force():
    words = ["the", "der", "cache", "que", "und"]
    scores = [langid.word_scores(w) for w in words]
    best = max(sum(s[k] for s, k in zip(scores, p)) - 4.0 * sum(a != b for a, b in zip(p, p[1:])) for p in __import__("itertools").product(range(6), repeat=5))
    path = [langid.LANGS.index(x) for x, s, e in langid.segments(" ".join(words)) for _ in " ".join(words)[s:e].split()]
    assert sum(s[k] for s, k in zip(scores, path)) - 4.0 * sum(a != b for a, b in zip(path, path[1:])) == pytest.approx(best)


def test_lines_of_prose(spark):
    py = '"""Module text that is long enough."""\n# We keep this because it is needed.\nx = "could not open the file in time"\n\ndef f():\n    """Doc that says why it is so."""\n    y = """\n    it is the answer of the day\n    """\n'
    js = "/** Doc that says why it is so. */\nconst a = `we only read the ${x} when it is asked for`; // eslint-disable-next-line no-x\n/* Wir haben den Stapel bewusst gelesen, damit nichts verloren geht. */\n"
    f, t = sources(spark, [(1, 1, "a.py", "python", "project", py), (2, 1, "b.js", "javascript", "library", js), (3, 1, "e", "c", "project", ""), (4, 1, "n", None, None, "// we do not know what it is")])
    com = spark.createDataFrame([(1, 1, None, 2, "We keep this because it is needed.", "note", False), (2, 9, None, 4, "это нужно, потому что так быстрее", None, None), (3, None, None, 4, "it is not here at all", None, None), (4, 1, None, None, "it is not here at all", None, None), (5, 1, None, 7, None, None, None)], "id long, file_id long, symbol_id long, line long, content string, kind string, is_rationale boolean")
    assert {tuple(r) for r in natural.lines(f, t, com).collect()} == {(1, 2, "en"), (1, 3, "en"), (1, 7, "en"), (2, 2, "en"), (2, 3, "de"), (9, 4, "ru")}
    assert all(0 < r.share < 1 for r in natural.shares(f, t, com).collect())
    assert natural.lines(f.limit(0), t.limit(0), com.limit(0)).count() == 0


def test_prose_of_several_scripts_and_beside_code(spark):
    mixed = "This checks whether the connection is still open 检查连接是否仍然打开"
    assert [x for x, _ in natural.prose_segments(mixed)] == ["en", "zh"]
    assert [x for x, _ in natural.prose_segments("请在关闭连接之前 then write the rest of the buffer to the disk and return to the caller")] == ["zh", "en"]
    assert natural.prose_language("Remember to call flush() before the stream is closed") == "en"
    assert [natural.prose_language(x) for x in ("return flush()", "x = compute(a);\ny = x + 1;", "if ready() and done():", "for (x of list()) {\n  push(x);\n}")] == [None] * 4
    prose = "The first line of the note\nis followed by the second one\nand by the third one"
    size = lambda text: sum(n for _, n in natural.prose_segments(text))
    assert size(prose) == size(prose + "\nvalue = compute(other);\nreturn value;") == size("value = compute(other);\n" + prose)
    f, t = sources(spark, [(1, 1, "a.py", "python", "project", f"x = 1  # {mixed}\n# {mixed[:48]}, 检查连接是否仍然打开 and {mixed[:1].lower()}{mixed[1:48]}\n")])
    com = spark.createDataFrame([], "file_id long, line long, content string")
    assert {tuple(r) for r in natural.lines(f, t, com).collect()} == {(1, 1, "en"), (1, 2, "en")}
    got = {r.lang: r.bytes for r in natural.shares(f, t, com).collect()}
    assert set(got) == {"en", "zh"} and got["zh"] == 60


def test_equally_long_segments_of_one_span_add_up(spark):
    one = "检查连接是否仍然打开了吗"
    f, t = sources(spark, [(1, 1, "a.py", "python", "project", f"# {one} then the rest of the buffer is written to the disk and {one}\n")])
    got = {r.lang: r.bytes for r in natural.shares(f, t, spark.createDataFrame([], "file_id long, line long, content string")).collect()}
    assert got["zh"] == 2 * len(one.encode())


# --- 4

def test_attribute_precedence():
    root = [("", *x) for x in provenance.parse_attributes("# c\n*.py linguist-generated\nsrc/** linguist-vendored\nkeep.py -linguist-generated\n\"a b.js\" linguist-generated=false")]
    deep = [("src/x", *x) for x in provenance.parse_attributes("*.py !linguist-generated\n/gen/*.py linguist-generated=true")]
    r = lambda p: {k for k, v in provenance.resolve(p, root + deep).items() if v}
    assert r("a.py") == {"linguist-generated"} and r("keep.py") == set() and r("d/keep.py") == set() and r("src/y.js") == {"linguist-vendored"}
    assert r("src/x/b.py") == {"linguist-vendored"} and r("src/x/gen/b.py") == {"linguist-vendored", "linguist-generated"}


def test_not_hand_written(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    code = lambda seed: "\n".join(f"{a} = {b}({c})" for a, b, c in (random.Random(seed * 1000 + k).sample(words, 3) for k in range(60)))
    copy = code(1)
    rows = [
        (1, 1, "pkgone/a.py", "python", "library", copy), (2, 2, "src/b.py", "python", "project", "# local note here\n" + copy.replace(copy.split("\n")[5], "changed = 1")), (3, 2, "src/own.py", "python", "project", code(2)),
        (4, 3, "src/g.py", "python", "project", "# @generated by the tool step, see x.idl for the input.\n" + code(3)), (5, 3, "src/talk.py", "python", "project", 'B = "@generated with the help of the x tool"\n' + code(4)),
        (6, 3, "m.js", "javascript", "project", "(()=>{" + "var a=b.c(1);if(x>2){y(z)}" * 40 + "})();"), (7, 3, "d.py", "python", "project", "T = [\n" + "".join(f"    {rnd.random()}, {rnd.randrange(99)},\n" for _ in range(40)) + "]\n"),
        (8, 3, "n.py", "python", "project", "".join(f"FIELD_{k} = Field(index={k})\n" for k in range(30))), (9, 4, "kb/x", "text", "knowledge_base", "DO NOT EDIT"), (10, 4, "vendor/pkgone/z.py", "python", "project", None), (11, 4, "vendor/other/z.py", "python", "project", code(5)),
        (12, 5, ".gitattributes", "text", "project", "gen/* linguist-generated"), (13, 5, "gen/q.py", "python", "project", code(6)), (14, 5, None, None, None, ""),
    ]
    got = {r.file_id: r.reasons for r in provenance.not_hand_written(*sources(spark, rows)).collect()}
    assert set(got) == {1, 2, 4, 6, 7, 8, 10, 13} and "copy" in got[2] and got[13] == ["declared"]
    assert provenance.not_hand_written(*sources(spark, [])).count() == 0


def test_near_copies_find_all_close_pairs(spark):
    rnd = np.random.default_rng(5)
    base = [rnd.integers(0, 1 << 60, 120) for _ in range(4)]
    sets = []
    for b in base:
        for n in (0, 3, 6, 9):
            x = b.copy()
            x[: n] = rnd.integers(0, 1 << 60, n)
            sets.append(np.unique(x.astype(np.uint64)))
    df = spark.createDataFrame([(k, [int(v) for v in s.view(np.int64)]) for k, s in enumerate(sets)], "cls long, shingles array<long>")
    links = {(r.one, r.two) for r in provenance.near_copies(df).collect()}
    root = list(range(len(sets)))
    for a, b in links:
        lo, hi = sorted((root[a], root[b]))
        root = [lo if x == hi else x for x in root]
    assert all((root[a] == root[b]) == (a // 4 == b // 4) for a, b in combinations(range(len(sets)), 2))


def exact_links(sets):
    return {tuple(sorted((a, b), key=lambda k: (len(sets[k]), k))) for a, b in combinations(range(len(sets)), 2) if (lo := min(len(sets[a]), len(sets[b]))) >= 0.6 * max(len(sets[a]), len(sets[b])) and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * lo}


def near_links(spark, sets, **args):
    df = spark.createDataFrame([(k, [int(v) for v in s.view(np.int64)]) for k, s in enumerate(sets)], "cls long, shingles array<long>")
    rows = [(r.one, r.two) for r in provenance.near_copies(df, **args).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_near_copies_of_drifting_versions_equal_brute_force(spark):
    rnd = np.random.default_rng(11)
    sets = [rnd.integers(0, 1 << 60, 100).astype(np.uint64)]
    for _ in range(79):  # a tree of versions, each some steps away from an earlier one
        x = sets[rnd.integers(max(0, len(sets) - 12), len(sets))].copy()
        x[rnd.choice(100, 9, False)] = rnd.integers(0, 1 << 60, 9).astype(np.uint64)
        sets.append(x)
    sets = [np.unique(x) for x in sets]
    want = exact_links(sets)
    undirected = lambda links: {tuple(sorted(x)) for x in links}
    assert len(want) > 79 and undirected(near_links(spark, sets)) == undirected(want) == undirected(near_links(spark, sets, block=7))


def test_near_copies_with_much_added_equal_brute_force(spark):
    rnd = np.random.default_rng(12)
    fresh = lambda n: rnd.integers(0, 1 << 60, n).astype(np.uint64)
    sets = []
    for _ in range(40):  # 80 of the smaller one's 100 shingles in a larger one of up to 166: a Jaccard similarity of 0.43
        x = fresh(100)
        sets += [np.unique(x), np.unique(np.concatenate([x[:80], fresh(rnd.choice([20, 45, 86]))]))]
    assert near_links(spark, sets) == exact_links(sets) == {(2 * k, 2 * k + 1) if len(sets[2 * k]) <= len(sets[2 * k + 1]) else (2 * k + 1, 2 * k) for k in range(40)}


def test_small_files_equal_to_a_library_text_are_copies(spark):
    rows = [(1, 1, "pkgone/a.py", "python", "library", "def add(a, b):\n    return a + b\n"), (2, 2, "x.py", "python", "project", "def add(a, b):\n    return (a + b)\n"), (3, 2, "y.py", "python", "project", "def sub(a, b):\n    return a - b\n"),
            (4, 1, "pkgone/b.py", "python", "library", "()\n"), (5, 2, "z.py", "python", "project", "[]\n"), (6, 3, "y.py", "python", "project", "def sub(a, b):\n    return a - b\n")]
    assert {r.file_id: r.reasons for r in provenance.not_hand_written(*sources(spark, rows)).collect()} == {1: ["copy", "library"], 2: ["copy"], 4: ["library"]}


# --- 5

def calls(spark, rows):
    return spark.createDataFrame([(i, p, r, n, "x", None) for i, p, r, n in rows], "id long, prompt string, response string, completion_tokens long, model string, defect string")


def test_defects(spark):
    q = "Why is the cache flushed before the ledger? Please explain it in one or two sentences."
    full = "The cache is flushed first because readers would otherwise see the values of the last run. The ledger follows."
    rows = [
        (1, q, None, 5), (2, q, " \n", 5), (3, q, "<think>because</think>\n", 5), (4, q, "```json\n\n```", 5), (5, q, '""', 5), (6, q, "I'm sorry, but I can't help with this request.", 5), (7, q, "Es tut mir leid, aber dabei kann ich nicht helfen.", 5),
        (8, q, q, 5), (9, q, "You asked: " + q, 5), (10, q, "Der Puffer wird vor dem nächsten Lauf geleert, weil der Speicher knapp ist.", 5), (11, q + " Answer in German.", "Der Puffer wird vor dem nächsten Lauf geleert, weil der Speicher knapp ist.", 5),
        (12, q, full, 5), (13, q, full[:70], 5), (14, "Is it? Answer yes or no.", "no", 1), (15, q, '{"a": "x", "b": ', 5), (16, q, '{"a": "x"}', 5), (17, q, "```python\nx = 1\n```", 5), (18, q, "```python\nx = 1", 5),
        (19, q, 'The tool prints "I cannot help with this request" when the cache is full.', 5), (20, q, "I'm sorry for the confusion earlier. " + full, 5), (21, None, full, None), (22, q, "1. read the file\n2. close the ledger\n3. write the cache", 9), (22, q, "1. read the file\n2. close the ledger\n3. write the cache", 9),
    ]
    got = {r.id: r.defect for r in pairs.defects(calls(spark, rows)).collect()}
    assert got == {1: "empty", 2: "empty", 3: "empty", 4: "empty", 5: "empty", 6: "refusal", 7: "refusal", 8: "copy", 9: "copy", 10: "wrong_language", 13: "truncated", 15: "truncated", 18: "truncated"}
    assert pairs.defects(calls(spark, rows).limit(0)).count() == 0


def test_late_refusals_are_found():
    polite = "I'm sorry. " * 4
    assert pairs.is_refusal(polite + "I can't help with this request.") and not pairs.is_refusal(polite + "The cache is flushed first.")


def test_shortened_across_partitions(spark):
    rnd = random.Random(4)
    texts = {"".join(rnd.choice("abc ") for _ in range(rnd.randrange(24, 60))) for _ in range(300)}
    texts |= {t[: rnd.randrange(24, len(t) + 1)] for t in texts}
    want = {t for t in texts if any(o != t and o.startswith(t) for o in texts)}
    df = spark.createDataFrame([(t,) for t in texts], "response string")
    assert {r.response for r in pairs.shortened(df).collect()} == want


def test_length_limits(spark):
    rows = [(k, "p", "r", n) for k, n in enumerate([512] * 40 + list(range(20, 200)) * 2)]
    assert [r.completion_tokens for r in pairs.length_limits(calls(spark, rows)).collect()] == [512]


def test_copies_behind_an_introduction():
    prompt = "File: a.py\nWhat happens to the cache when it is full?"
    assert pairs.is_copy(prompt, "You asked: What happens to the cache when it is full?") and pairs.is_copy("x\n为什么这里要清空结果?", "You asked: 为什么这里要清空结果?")
    assert not pairs.is_copy(prompt, "Answer: it drops the oldest entry") and not pairs.is_copy(prompt, "What happens to the cache when it is full?\n\nOur chunk used to drop every old stage, which made the reader slow.")


@pytest.mark.parametrize("longer,n,ok", [("We keep the lock. Then we go on.", 17, False), ("We keep the lock. Then we go on.", 11, True), ("a list\nof lines", 6, False), ("version 3.5 of it", 10, True), ("先に読みます。次に書きます。", 7, False), ("same", 4, False)])
def test_a_shortened_text_ends_inside_a_sentence(longer, n, ok):
    assert pairs._goes_on(longer, n) is ok


# --- 6

def test_pairs_equal_brute_force(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice([1, 1, 1, 2]), f"h{rnd.randrange(120)}", [rnd.choice(["a", "./b", "c\\d", "c/d", "e", "f", None, ""]) for _ in range(rnd.randrange(5))], 1) for _ in range(300)]
    rows += [(1, "big", [f"x{k}" for k in range(60)], 2), (1, "none", None, 3), (None, "z", ["a"], 4), (1, None, ["a"], 5), (1, "h1", ["a"], 9)]
    df = spark.createDataFrame([(r, h, p, i) for r, h, p, i in rows], "repo_id long, hash string, changed_files array<string>, k long")
    base = {}
    for r, h, p, _ in rows:
        if r is not None and h is not None:
            base.setdefault((r, h), set()).update({re.sub(r"^(\./+)+", "", x.replace("\\", "/")) for x in p or [] if x})
    base = {k: v for k, v in base.items() if 1 <= len(v) <= 50}
    n = Counter(r for r, _ in base)
    single = Counter((r, x) for (r, _), v in base.items() for x in v)
    both = Counter((r, a, b) for (r, _), v in base.items() for a, b in combinations(sorted(v, key=str.encode), 2))
    want = {(r, a, b, k, single[r, a], single[r, b], n[r]) for (r, a, b), k in both.items() if k >= 2 and k * n[r] >= single[r, a] * single[r, b]}
    got = cooccur.pair_counts(df, "repo_id", "hash", F.transform("changed_files", cooccur.clean_path), min_together=2, min_lift=1).collect()
    assert {tuple(r)[:7] for r in got} == want and want
    assert cooccur.commit_pairs(df.limit(0)).count() == 0


# --- 7

def _best_fit(counts, capacity):
    rooms = []
    for x in sorted(counts.elements(), reverse=True):
        fit = [r for r in rooms if r >= x]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else capacity) - x)
    return len(rooms)


def test_solver_covers_and_fills():
    """No more containers than best-fit decreasing, and never fewer than the bound."""
    rnd = random.Random(7)
    for n in (0, 1, 7, 500, 3000):
        counts = Counter(rnd.randrange(1, 101) for _ in range(n))
        used, bound = packing.solve(dict(counts), 100)
        got = Counter()
        for pattern, k in used:
            assert sum(x * a for x, a in pattern) <= 100
            for x, a in pattern:
                got[x] += a * k
        assert got == counts
        boxes = sum(k for _, k in used)
        assert bound <= boxes + 1e-9 and boxes <= _best_fit(counts, 100)


def test_pack(spark):
    rnd = random.Random(8)
    texts = [" ".join(["w"] * rnd.choice([0, 1, 5, 9, 30, 200])) for _ in range(200)]
    rows = [(k, t, 5) for k, t in enumerate(texts)] + [(None, "a b", 1), (900, None, 1), (900, None, 1)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, tokens long"), capacity=50).collect()
    room, whole = Counter(), Counter()
    for r in got:
        room[r.container] += r.tokens
        whole[r.id] += r.tokens
    assert max(room.values()) <= 50
    assert all(whole[k] == len(t.split()) for k, t in enumerate(texts)) and whole[None] == 2
    assert len(room) <= sum(room.values()) / 50 * 1.05 + 2
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_token_count_equals_python(spark):
    texts = ["", "a_b1 ,.; x", "naïve—é 日本語、です", "a\u00a0b\u2003c\x1cd", "²½Ⅷ٣", "e\u0301x", "🙂🙂 a", "\u200b", None]
    got = [r.n for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").select("k", token_count(F.col("t")).alias("n")).orderBy("k").collect()]
    assert got == [len(TOKEN.findall(t or "")) for t in texts]


# --- 8

def _mems(items, doc):
    """(item, place in it, place in the text, words) of the matches that can't be made longer, by comparing all places."""
    out = set()
    for k, ws in items:
        least = min(leaks.SEED, len(ws))
        for j in range(len(ws)):
            for p in range(len(doc)):
                if j and p and doc[p - 1] == ws[j - 1]:
                    continue
                n = 0
                while j + n < len(ws) and p + n < len(doc) and doc[p + n] == ws[j + n]:
                    n += 1
                if n >= least and least:
                    out.add((k, j, p, n))
    return out


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_longest_matches_equal_brute_force(block, monkeypatch):
    monkeypatch.setattr(leaks, "PAIR_BLOCK", block)
    rnd = random.Random(9)
    items = [(k, [rnd.choice("abcdefgh") for _ in range(n)]) for k, n in enumerate((30, 30, 30, 90, 4, 3, 1, 0))]
    items += [(8, items[0][1]), (9, ["same"] * 40)]
    doc = [rnd.choice("abcdefghij") for _ in range(1500)] + items[3][1] + ["x"] + items[3][1][:50] + ["same"] * 25 + ["x", "same"]
    test = leaks.TestSet(items)
    w = np.array([test.vocabulary.get(x, 0) for x in doc], np.int64)
    got = [(int(test.ids[test.item[q]]), int(test.place[q]), int(p), int(n)) for qs, ps, ns in leaks.matches(test, w) for q, p, n in zip(qs, ps, ns)]
    assert len(set(got)) == len(got) and set(got) == _mems(items, doc)


def test_suffix_array_is_in_order():
    rnd = random.Random(3)
    for longest in (8, 16, 100):
        words_ = [rnd.randrange(0, 3) for _ in range(300)] + [1, 2] * 60
        w = np.array(words_ + [0] * (longest + leaks._STEP), np.int64)
        suffix = lambda p: [*words_[p : p + longest], 0][: ([*words_[p : p + longest], 0].index(0))]
        sa = leaks.suffix_array(w, np.arange(len(words_)), longest)
        assert sorted(sa) == list(range(len(words_))) and all(suffix(a) <= suffix(b) for a, b in zip(sa, sa[1:]))


def test_leaks(spark):
    rnd = random.Random(10)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(5))
    opening = "Study the text and give the result."
    frame = lambda: f"Each {word()} line holds a {word()}, and the number of {word()} units that were {word()} since {rnd.randrange(99)} o'clock."
    items = [(k, "s", (opening + " " if k % 2 else "") + " ".join(frame() for _ in range(4))) for k in range(12)]
    body = lambda k: items[k][2].removeprefix(opening).split()
    altered = lambda ws: [word() if j % 7 == 3 else x for j, x in enumerate(ws)]
    filler = " ".join(word() for _ in range(50))
    docs = [
        (1, filler + " " + items[0][2].upper() + " " + filler), (2, filler + "\n> " + " ".join(altered(body(1))) + "\n" + filler), (3, " ".join(body(2)[: len(body(2)) // 2]) + " " + filler), (4, " ".join(body(3)[:9]) + " " + filler), (5, opening + " " + filler),
        (6, " ".join(frame() for _ in range(6))), (7, None), (8, ""), (9, " ".join(body(4)[:30]) + filler + " ".join(body(4)[40:])), (10, " ".join("**" + x + "**" for x in body(5))),
    ]
    d = spark.createDataFrame([(i, t, 3) for i, t in docs], "doc_id long, text string, item_id long")
    e = spark.createDataFrame(items + [(99, "s", None), (None, "s", "x y z")], "item_id long, suite string, text string")
    want = {(1, 0), (2, 1), (3, 2), (9, 4), (10, 5)}
    assert {(r.doc_id, r.item_id) for r in leaks.find(d, e).collect()} == want
    assert {(r.doc_id, r.item_id) for r in leaks.find(d, e, block_words=200).collect()} == want
    assert {r.doc_id for r in leaks.clean(d, e).collect()} == {4, 5, 6, 7, 8}
    assert leaks.find(d.limit(0), e).count() == 0 and leaks.find(d, e.limit(0)).count() == 0
    long_ = leaks.longest_matches(d, e)
    assert (0, 50, len(leaks.words(items[0][2]))) in {(r.item_word, r.doc_word, r.matched) for r in long_.where("doc_id = 1 and item_id = 0").collect()}
    # short items leak as a whole, a document far longer than its passages too
    short = spark.createDataFrame([(1, "s", "one two"), (2, "s", "alpha beta gamma delta epsilon"), (3, "s", "solo")], "item_id long, suite string, text string")
    texts = spark.createDataFrame([(1, "x one two y"), (2, "one x two"), (3, "ALPHA beta, gamma delta Epsilon!"), (4, "alpha beta gamma delta"), (5, "Solo")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks.find(texts, short).collect()} == {(1, 1), (3, 2), (5, 3)}


# --- 9

def _paragraphs(text, limit):
    parts = [p for p in splitting.PARAGRAPH.split(text) if p and not p.isspace()]
    return {(k, n) for k, p in enumerate(parts, 1) if (n := len(TOKEN.findall(p))) > limit}


def test_paragraphs_at_any_range_size(spark):
    rnd = random.Random(11)
    texts = ["", "a", "\n\n", "a\r\n \t\r\nb b b b", "x\r\r\n\ny y y y"] + ["".join(rnd.choice(["a", "bb ", ",", ".", "\n", "\r\n", " ", "\t", "é", "　"]) for _ in range(rnd.randrange(80))) for _ in range(150)]
    rows = [(k, t, "p") for k, t in enumerate(texts)] + [(500, None, "p"), (1, "a", "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, para_no string")
    want = {(k, *x) for k, t in enumerate(texts) for x in _paragraphs(t, 3)}
    for size in (1 << 20, 7, 3):
        assert {tuple(r) for r in splitting.paragraphs(df, limit=3, range_chars=size).collect()} == want


@pytest.mark.parametrize("size", [1 << 20, 400])
def test_pieces_hold_every_token_once(spark, size):
    rnd = random.Random(12)
    texts = ["".join(rnd.choice(["word ", "other ", "end. ", "x,", "\n", "\n\n"]) for _ in range(n)) for n in (0, 3, 60, 700)] + ["z" * 900 + " tail", "," * 50]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(77, None)], "doc_id long, text string")
    rows = splitting.split(df, limit=20, overlap=4, range_chars=size).collect()
    assert max(r.tokens for r in rows) <= 20 and max(r.shared for r in rows) <= 4
    for k, t in enumerate(texts):
        own = sorted((r for r in rows if r.id == k), key=lambda r: r.piece_no)
        assert [r.piece_no for r in own] == list(range(len(own)))
        assert all(len(TOKEN.findall(t[r.start : r.end])) == r.tokens for r in own)
        assert sum(r.tokens - r.shared for r in own) == len(TOKEN.findall(t))


def test_pieces_are_the_same_at_any_range_size(spark):
    rnd = random.Random(21)
    parts = ["word", "a_b1", "end. ", 'so." ', ") ", "\n", "\r\n\r\n", "\n \t\n", " ", "  ", "x;", "结束。", "...", "(y)", "né "]
    texts = ["".join(rnd.choice(parts) + (" " if rnd.random() < 0.4 else "") for _ in range(900)) for _ in range(4)] + ["w" * 500 + " v" * 60, "a b " * 40 + " " * 300]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1])], "doc_id long, text string")
    get = lambda size: {tuple(r) for r in splitting.split(df, limit=20, overlap=6, range_chars=size).collect()}
    want = get(1 << 20)
    assert max(r[5] for r in want) == 6 and sum(r[6] == "end" for r in want) == 7
    assert get(7) == want and get(64) == want and get(501) == want


def test_file_ranges_read_each_line_once(spark, tmp_path):
    text = "".join(f"line {k} {'é' * (k % 17)}\n" for k in range(500)) + "no end"
    (tmp_path / "a.txt").write_text(text)
    rows = splitting.file_ranges(spark, [str(tmp_path / "a.txt")], 700).orderBy("rng").collect()
    assert len(rows) > 5 and "".join(r.text for r in rows) == text


# --- lexing

def test_lexing():
    kinds = lambda lang, text: [(s.kind, s.body) for s in lexing.spans(lang, text)]
    assert kinds("python", '"""m"""\nx = f"a" # c\nclass C:\n    """d"""\n') == [("docstring", "m"), ("string", "a"), ("line", "c"), ("docstring", "d")]
    assert kinds("javascript", "/** d */ a = `x${`y`}z`; // c\nb = /\"/.test('s')") == [("doc", "d"), ("string", "x … z"), ("line", "c"), ("string", "s")]
    assert kinds("c", '#include "a.h"\n/* b */ char c = \'"\'; s = "t";') == [("block", "b"), ("string", "t")]
    assert kinds("text", '"x"') == [] and kinds(None, "x") == []
    assert grammar_js.Invalid is grammar_c.Invalid
