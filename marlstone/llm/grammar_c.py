"""Grammar of C after a small preprocessor: whether a text is syntactically valid C."""

from __future__ import annotations

import re

from marlstone.llm.grammar_js import Invalid

# Words of the language.
_TYPE_WORDS = frozenset("void char short int long float double signed unsigned _Bool bool _Complex _Imaginary __int128 __signed__ _Float16 _Float32 _Float64 _Float128 _Decimal32 _Decimal64 _Decimal128".split())
_QUALIFIERS = frozenset("const volatile restrict _Atomic __restrict __restrict__ __const __volatile__ __volatile".split())
_STORAGE = frozenset("typedef extern static auto register _Thread_local thread_local inline _Noreturn noreturn __inline __inline__ __extension__ constexpr".split())
_STATEMENT_WORDS = frozenset("if else while do for switch case default break continue return goto sizeof _Alignof alignof _Generic".split())
_TAGS = frozenset(("struct", "union", "enum"))
_KEYWORDS = _TYPE_WORDS - {"bool"} | _QUALIFIERS | (_STORAGE - {"noreturn", "constexpr", "thread_local"}) | _STATEMENT_WORDS | _TAGS | {"_Static_assert", "_Alignas"}
_BINARY = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
_ASSIGN = frozenset("= += -= *= /= %= <<= >>= &= ^= |=".split())

_SKIP = re.compile(r"(?:[ \t\v\f\r\n]+|//(?:\\\r?\n|[^\n])*|/\*.*?\*/)+", re.S)
_LEX = re.compile(
    r"""(?P<num>(?:0[xX](?:[\da-fA-F](?:'?[\da-fA-F])*\.?[\da-fA-F]*|\.[\da-fA-F]+)(?:[pP][+-]?\d+)?|0[bB][01](?:'?[01])*|(?:\d(?:'?\d)*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)[uUlLfFzZ]*)
    |(?P<str>(?:u8|[uUL])?"(?:[^"\\\n]|\\(?:\r\n|.))*")
    |(?P<chr>(?:u8|[uUL])?'(?:[^'\\\n]|\\(?:\r\n|.))+')
    |(?P<id>[^\W\d]\w*)
    |(?P<p>\.\.\.|<<=|>>=|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||\*=|/=|%=|\+=|-=|&=|\^=|\|=|\[\[|\]\]|[{}()\[\];,<>+\-*/%&|^!~?:=.\#@$\\`])""",
    re.X | re.S,
)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}

Tok = tuple[str, str, int]  # kind, value, place


def lex(text: str, base: int = 0) -> list[Tok]:
    out: list[Tok] = []
    at, n, match, skip = 0, len(text), _LEX.match, _SKIP.match
    while at < n:
        c = text[at]
        if (c <= " " or c == "/") and (m := skip(text, at)):
            at = m.end()
            continue
        m = match(text, at)
        if m is None:
            raise Invalid(f"character {text[at]!r} at {base + at}")
        kind, v, end = m.lastgroup, m.group(), m.end()
        if kind == "num" and (end < n and (text[end].isalnum() or text[end] == "_") or re.match(r"0\d*[89]", v) and not re.search(r"[.eEfF]", v)):
            raise Invalid(f"number at {base + at}")
        if v in ("[[", "]]"):
            out += [("p", v[0], base + at), ("p", v[0], base + at + 1)]
        else:
            out.append((kind, v, base + at))
        at = end
    return out


def _logical_lines(text: str) -> list[tuple[int, str, bool]]:
    """(place, text, directive): stretches of code between directives, and directives with their continuations."""
    # Comments and literals are skipped so that a # in them is no directive.
    skip = re.compile(r"//(?:\\\r?\n|[^\n])*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\(?:\r\n|.))*\"?|'(?:[^'\\\n]|\\(?:\r\n|.))*'?|^[ \t]*\#(?:/\*.*?\*/|//[^\n]*|\\\r?\n|[^\n\\]|\\(?!\r?\n))*", re.S | re.M)
    out, last = [], 0
    for m in skip.finditer(text):
        if m.group().lstrip(" \t").startswith("#"):
            if m.start() > last:
                out.append((last, text[last : m.start()], False))
            out.append((m.start(), re.sub(r"\\\r?\n", " ", re.sub(r"/\*.*?\*/|//[^\n]*", " ", m.group(), flags=re.S)).strip(), True))
            last = m.end()
    if last < len(text):
        out.append((last, text[last:], False))
    return out


def _truth(expr: str, macros: dict) -> bool:
    """The value of an #if; unknown names are 0, what can't be computed counts as true."""
    expr = re.sub(r"\bdefined\s*\(\s*(\w+)\s*\)|\bdefined\s+(\w+)", lambda m: "1" if (m[1] or m[2]) in macros else "0", expr)
    expr = re.sub(r"\b__has_\w+\s*\([^)]*\)", "0", expr)
    for _ in range(5):
        expr = re.sub(r"\b[A-Za-z_]\w*\b", lambda m: " ".join(t[1] for t in macros[m[0]][1]) or "0" if m[0] in macros and macros[m[0]][0] is None else "0", expr)
    expr = re.sub(r"(?<=\d)[uUlL]+\b", "", expr)
    if not expr.strip():
        raise Invalid("#if without a condition")
    if not re.fullmatch(r"[\d\sxXa-fA-F()+\-*/%<>=!&|~^?:]+", expr) or len(expr) > 500:
        return True
    try:
        return bool(eval(re.sub(r"\b0(\d+)", r"0o\1", expr.replace("&&", " and ").replace("||", " or ").replace("!=", "≠").replace("!", " not ").replace("≠", "!=").replace("/", "//")), {"__builtins__": {}}, {}))  # noqa: S307 - digits and operators only
    except Exception:
        return True


class Env:
    """What earlier stretches of a file give to later ones: macros, open conditionals, names of types."""

    def __init__(self) -> None:
        self.macros: dict[str, tuple[list[str] | None, list[Tok]]] = {}
        self.stack: list[list[bool]] = []  # of each open #if: taken now, taken before, else seen
        self.types: set[str] = set()

    def skim(self, facts: str) -> None:
        """Take in directives and typedefs without the code between them, as `facts` writes them."""
        preprocess(facts, self)
        self.types.update(_TYPE_FACT.findall(facts))


_TYPE_FACT = re.compile(r"^typedef int (\w+);$", re.M)
_TYPEDEF = re.compile(r"\btypedef\b[^;{}()]*?(\w+)[ \t]*;|\btypedef\b[^;{}]*\([ \t]*\*[ \t]*(\w+)[ \t]*\)[^;{}]*;|^\}[ \t]*\*?[ \t]*(\w+)[ \t]*;", re.M)


def type_names(code: str) -> list[str]:
    """Names that the typedefs in a stretch of code give, where they can be told by their ends."""
    return [a or b or c for a, b, c in _TYPEDEF.findall(code)]


def preprocess(text: str, env: Env | None = None) -> list[Tok]:
    """Tokens of the branches that are taken, macros expanded. An environment goes on; without one conditionals must close."""
    whole, env = env is None, env or Env()
    macros, stack = env.macros, env.stack
    out: list[Tok] = []
    pending: list[Tok] = []
    live = all(x[0] for x in stack)
    for at, line, directive in _logical_lines(text):
        if not directive:
            if live:
                pending += lex(line, at)
            elif re.search(r"(?m)^(?:<{7}|>{7}|\|{7}|={7})(?:\s|$)", line):
                raise Invalid(f"conflict marks at {at}")
            continue
        m = re.match(r"#\s*([A-Za-z]\w*)?\s*(.*)", line, re.S)
        word, rest = m[1], m[2].strip()
        if word in ("if", "ifdef", "ifndef"):
            if word != "if" and not re.match(r"[A-Za-z_]\w*\s*$", rest):
                raise Invalid(f"#{word} at {at}")
            yes = live and (_truth(rest, macros) if word == "if" else (rest in macros) == (word == "ifdef"))
            stack.append([yes, yes or not live, False])
            live = yes
        elif word in ("elif", "else", "elifdef", "elifndef"):
            if not stack or stack[-1][2]:
                raise Invalid(f"#{word} at {at}")
            top = stack[-1]
            yes = not top[1] and (word == "else" or (_truth(rest, macros) if word == "elif" else (rest in macros) == (word == "elifdef")))
            top[0], top[1], top[2] = yes, top[1] or yes, word == "else"
            live = yes
        elif word == "endif":
            if not stack:
                raise Invalid(f"#endif at {at}")
            top = stack.pop()
            live = all(x[0] for x in stack)
        elif live:
            if word in ("define", "undef"):
                out += expand(pending, macros)
                pending = []
                d = re.match(r"([A-Za-z_]\w*)(\(([^)]*)\))?(.*)", rest, re.S)
                if not d:
                    raise Invalid(f"#{word} at {at}")
                if word == "undef":
                    macros.pop(d[1], None)
                else:
                    params = None if d[2] is None else [p.strip() for p in d[3].split(",")] if d[3].strip() else []
                    try:
                        macros[d[1]] = (params, lex(d[4], at))
                    except Invalid:
                        macros[d[1]] = (params, [])
            elif word == "include":
                if not re.match(r"<[^>\n]+>|\"[^\"\n]+\"|[A-Za-z_]", rest):
                    raise Invalid(f"#include at {at}")
            elif word == "error":
                pass
            elif word not in ("pragma", "line", "warning", "ident", "embed", "include_next", None):
                raise Invalid(f"#{word} at {at}")
            elif word is None and rest:
                raise Invalid(f"# at {at}")
    if stack and whole:
        raise Invalid("#if without #endif")
    return out + expand(pending, macros)


def expand(toks: list[Tok], macros: dict, hidden: frozenset = frozenset(), depth: int = 0) -> list[Tok]:
    if not macros or depth > 40:
        return toks
    out: list[Tok] = []
    i, n = 0, len(toks)
    while i < n:
        kind, v, at = toks[i]
        if kind != "id" or v not in macros or v in hidden:
            out.append(toks[i])
            i += 1
            continue
        params, body = macros[v]
        if params is None:
            out += expand([(k, x, at) for k, x, _ in body], macros, hidden | {v}, depth + 1)
            i += 1
            continue
        if i + 1 >= n or toks[i + 1][1] != "(":
            out.append(toks[i])
            i += 1
            continue
        args: list[list[Tok]] = [[]]
        level, j = 0, i + 1
        while j < n:
            x = toks[j]
            if x[1] in _OPEN and x[0] == "p":
                level += 1
                level > 1 and args[-1].append(x)
            elif x[1] in _CLOSE and x[0] == "p":
                level -= 1
                if not level:
                    break
                args[-1].append(x)
            elif x[1] == "," and level == 1:
                args.append([])
            else:
                args[-1].append(x)
            j += 1
        if level:
            raise Invalid(f"open macro at {at}")
        names = {p: args[k] if k < len(args) else [] for k, p in enumerate(params)}
        if params and params[-1] == "...":
            rest = args[len(params) - 1 :]
            names["__VA_ARGS__"] = [t for k, a in enumerate(rest) for t in ([("p", ",", at)] if k else []) + a]
        filled: list[Tok] = []
        k = 0
        while k < len(body):
            b = body[k]
            if b[1] == "#" and k + 1 < len(body) and body[k + 1][1] == "#":
                nxt = body[k + 2 : k + 3]
                value = (names.get(nxt[0][1], nxt) if nxt else []) or []
                if filled and value:
                    filled[-1] = (filled[-1][0], filled[-1][1] + value[0][1], at)
                    filled += value[1:]
                k += 3
                continue
            if b[1] == "#" and k + 1 < len(body) and body[k + 1][1] in names:
                filled.append(("str", '""', at))
                k += 2
                continue
            filled += names[b[1]] if b[0] == "id" and b[1] in names else [(b[0], b[1], at)]
            k += 1
        out += expand(filled, macros, hidden | {v}, depth + 1)
        i = j + 1
    return out


class Parser:
    def __init__(self, toks: list[Tok], types: set[str] | None = None):
        self.t = [*toks, ("eof", "", -1)]
        self.i = 0
        self.types: set[str] = set() if types is None else types
        self.loop = self.switch = 0
        stack = []
        for kind, v, at in toks:
            if kind == "p":
                if v in _OPEN:
                    stack.append(v)
                elif v in _CLOSE and (not stack or stack.pop() != _CLOSE[v]):
                    raise Invalid(f"{v} at {at}")
        if stack:
            raise Invalid("open at the end")

    @property
    def kind(self) -> str:
        return self.t[self.i][0]

    @property
    def v(self) -> str:
        k = self.t[self.i]
        return k[1] if k[0] in ("p", "id") else "\0" + k[0]

    def pv(self, k: int = 1) -> str:
        x = self.t[min(self.i + k, len(self.t) - 1)]
        return x[1] if x[0] in ("p", "id") else "\0" + x[0]

    def pk(self, k: int = 1) -> str:
        return self.t[min(self.i + k, len(self.t) - 1)][0]

    def fail(self, what: str = "unexpected") -> None:
        raise Invalid(f"{what} {self.t[self.i][1]!r} at {self.t[self.i][2]}")

    def eat(self, v: str) -> bool:
        if self.v == v:
            self.i += 1
            return True
        return False

    def need(self, v: str) -> None:
        if not self.eat(v):
            self.fail(f"need {v}, found")

    def name_at(self, k: int = 0) -> bool:
        x = self.t[min(self.i + k, len(self.t) - 1)]
        return x[0] == "id" and x[1] not in _KEYWORDS

    def name(self) -> str:
        if not self.name_at():
            self.fail("need a name, found")
        self.i += 1
        return self.t[self.i - 1][1]

    # -- declarations
    def program(self) -> None:
        while self.kind != "eof":
            if self.eat(";"):
                continue
            if self.v == "extern" and self.pk() == "str":
                self.i += 2
                if self.eat("{"):
                    while not self.eat("}"):
                        if self.kind == "eof":
                            self.fail()
                        self.external()
                    continue
            self.external()

    def external(self) -> None:
        if self.eat(";"):
            return
        if self.v in ("asm", "__asm__", "__asm"):
            self.skip_asm()
            return
        if self.name_at() and self.pv() == "(" and self.t[self.i][1].isupper() and self.t[self.i][1] not in self.types:
            self.i += 1  # a macro of some header, like MODULE_LICENSE("x")
            self.balanced()
            self.eat(";")
            return
        self.declaration(True)

    def skip_asm(self) -> None:
        self.i += 1
        while self.v in ("volatile", "__volatile__", "goto", "inline"):
            self.i += 1
        self.balanced()
        self.eat(";")

    def balanced(self) -> None:
        """Skip one bracketed stretch."""
        if self.v not in _OPEN:
            self.fail()
        depth = 0
        while True:
            if self.v in _OPEN:
                depth += 1
            elif self.v in _CLOSE:
                depth -= 1
            self.i += 1
            if not depth:
                return

    def attributes(self) -> None:
        while True:
            if self.v in ("__attribute__", "__attribute", "__declspec", "_Alignas", "alignas", "__asm__", "__asm", "asm"):
                self.i += 1
                self.balanced()
            elif self.v == "[" and self.pv() == "[" and self.pk(2) == "id":
                self.balanced()
            else:
                return

    def starts_type(self, k: int = 0) -> bool:
        x = self.t[min(self.i + k, len(self.t) - 1)]
        return x[0] == "id" and (x[1] in _TYPE_WORDS or x[1] in _QUALIFIERS or x[1] in _TAGS or x[1] in self.types or x[1] in ("typeof", "__typeof__", "typeof_unqual"))

    def starts_declaration(self) -> bool:
        if self.kind != "id":
            return self.v == "[" and self.pv() == "["
        v = self.v
        if v in _STORAGE or v in ("__attribute__", "_Static_assert", "static_assert", "_Alignas", "alignas"):
            return not (v in ("auto", "noreturn", "constexpr") and self.pv() in ("=", ".", "->", ";", "("))
        if self.starts_type():
            return v not in self.types or self.pv() not in ("=", ".", "->", "(", "[", "++", "--", ":", ";") and self.pk() != "num"
        if v in _KEYWORDS:
            return False
        if self.name_at(1):
            return True
        if self.pv() == "*":  # x * y; reads as a declaration where a declarator ends as declarators do
            k = 1
            while self.pv(k) == "*" or self.pv(k) in _QUALIFIERS:
                k += 1
            return self.name_at(k) and self.pv(k + 1) in ("=", ";", ",", "[")
        return False

    def specifiers(self) -> tuple[bool, bool]:
        """(found a type, is a typedef)."""
        found = typedef = False
        while True:
            self.attributes()
            v = self.v
            if self.kind != "id":
                break
            if v in _STORAGE and not (v in ("noreturn", "constexpr", "thread_local") and found):
                typedef |= v == "typedef"
                self.i += 1
            elif v in _QUALIFIERS:
                self.i += 1
                if v == "_Atomic" and self.v == "(":
                    self.balanced()
                    found = True
            elif v in _TYPE_WORDS:
                self.i += 1
                found = True
            elif v in ("typeof", "__typeof__", "typeof_unqual"):
                self.i += 1
                self.balanced()
                found = True
            elif v in ("struct", "union"):
                self.i += 1
                self.attributes()
                named = self.name_at()
                if named:
                    self.i += 1
                if self.eat("{"):
                    self.members()
                elif not named:
                    self.fail("need a name, found")
                found = True
            elif v == "enum":
                self.i += 1
                self.attributes()
                named = self.name_at()
                if named:
                    self.i += 1
                if self.v == ":" and self.starts_type(1):
                    self.i += 1
                    self.specifiers()
                if self.eat("{"):
                    while not self.eat("}"):
                        self.name()
                        self.attributes()
                        if self.eat("="):
                            self.conditional()
                        if self.v != "}":
                            self.need(",")
                elif not named:
                    self.fail("need a name, found")
                found = True
            elif not found and v not in _KEYWORDS and (v in self.types or self.name_at(1) or self.pv() in ("*", "(", ",", ")", "[", ";", "=", ":") or self.pv() in _QUALIFIERS or self.pv() in _TYPE_WORDS or self.pv() in _STORAGE):
                # An unknown name is a type where another name or a declarator follows.
                if self.pv() in ("(", ",", ")", "[", ";", "=", ":") and v not in self.types and not getattr(self, "abstract", False):
                    break
                self.i += 1
                found = True
            else:
                break
        return found, typedef

    def members(self) -> None:
        while not self.eat("}"):
            if self.eat(";"):
                continue
            if self.v in ("_Static_assert", "static_assert"):
                self.i += 1
                self.balanced()
                self.need(";")
                continue
            found, _ = self.specifiers()
            if not found:
                self.fail("need a type, found")
            while self.v != ";":
                if self.v != ":":
                    self.declarator(False)
                if self.eat(":"):
                    self.conditional()
                self.attributes()
                if not self.eat(","):
                    break
            self.need(";")

    def pointer(self) -> None:
        while self.v == "*" or self.v == "^" and self.pv() in ("*", ")"):
            self.i += 1
            while self.v in _QUALIFIERS or self.v in ("__attribute__",):
                if self.v == "__attribute__":
                    self.attributes()
                else:
                    self.i += 1

    def declarator(self, abstract: bool) -> tuple[str | None, bool]:
        """(name, is a function)."""
        self.pointer()
        self.attributes()
        name, function = None, False
        if self.name_at() and not (abstract and self.v in self.types):
            name = self.name()
        elif self.v == "(" and (self.pv() in ("*", "^", "(") or self.pv() in ("__attribute__", "__cdecl", "__stdcall") or self.name_at(1) and not self.starts_type(1) and not abstract):
            self.i += 1
            self.attributes()
            name, _ = self.declarator(abstract)
            self.need(")")
        elif not abstract:
            self.fail("need a name, found")
        first = True
        while True:
            if self.v == "(":
                self.parameters()
                function = function or first
            elif self.v == "[" and not (self.pv() == "[" and self.pk(2) == "id" and self.pv(3) in ("]", "(", ":")):
                self.i += 1
                while self.v in _QUALIFIERS or self.v == "static":
                    self.i += 1
                if self.v == "*" and self.pv() == "]":
                    self.i += 1
                if self.v != "]":
                    self.assignment()
                self.need("]")
            else:
                break
            first = False
        self.attributes()
        return name, function

    def parameters(self) -> None:
        self.need("(")
        if self.eat(")"):
            return
        while True:
            if self.eat("..."):
                break
            self.abstract, old = True, getattr(self, "abstract", False)
            found, _ = self.specifiers()
            self.abstract = old
            if not found:
                if self.name_at():
                    self.i += 1  # names of an old-style definition
                else:
                    self.fail("need a type, found")
            else:
                self.declarator(True)
            if not self.eat(","):
                break
        self.need(")")

    def declaration(self, top: bool = False) -> None:
        if self.v in ("_Static_assert", "static_assert"):
            self.i += 1
            self.balanced()
            self.need(";")
            return
        begin = self.i
        found, typedef = self.specifiers()
        if not found and (self.i == begin or not self.name_at()) and not (top and self.name_at() and self.pv() == "(" and self.old_style()):
            self.fail("need a type, found")
        if self.eat(";"):
            return
        first = True
        while True:
            name, function = self.declarator(False)
            if typedef and name:
                self.types.add(name)
            if first and function and top and not typedef:
                while self.v != "{" and self.starts_declaration() and self.v != "=":
                    self.declaration()
                if self.v == "{":
                    old, self.loop, self.switch = (self.loop, self.switch), 0, 0
                    self.block()
                    self.loop, self.switch = old
                    return
            first = False
            if self.eat("="):
                self.initializer()
            if not self.eat(","):
                break
        self.need(";")

    def old_style(self) -> bool:
        """name(...) { or name(...) declarations {: a function without a type."""
        k, depth = self.i + 1, 0
        while k < len(self.t):
            v = self.t[k][1] if self.t[k][0] == "p" else ""
            depth += (v == "(") - (v == ")")
            k += 1
            if not depth:
                break
        return self.t[min(k, len(self.t) - 1)][1] == "{"

    def initializer(self) -> None:
        if not self.eat("{"):
            self.assignment()
            return
        while not self.eat("}"):
            designated = False
            while self.v in (".", "["):
                designated = True
                if self.eat("."):
                    self.name()
                else:
                    self.i += 1
                    self.conditional()
                    if self.eat("..."):
                        self.conditional()
                    self.need("]")
            if designated:
                self.need("=")
            elif self.name_at() and self.pv() == ":":
                self.i += 2
            self.initializer()
            if self.v != "}":
                self.need(",")

    # -- statements
    def block(self) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.kind == "eof":
                self.fail()
            if self.starts_declaration():
                self.declaration()
            else:
                self.statement()

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def statement(self) -> None:
        v = self.v
        if v == "{":
            self.block()
        elif self.eat(";"):
            pass
        elif self.kind == "id" and v in ("if", "while", "for", "do", "switch", "return", "break", "continue", "goto", "case", "default", "else", "asm", "__asm__"):
            self.i += 1
            if v == "if":
                self.paren()
                self.statement()
                if self.eat("else"):
                    self.statement()
            elif v == "while":
                self.paren()
                self.inner()
            elif v == "do":
                self.inner()
                self.need("while")
                self.paren()
                self.need(";")
            elif v == "for":
                self.need("(")
                if self.starts_declaration():
                    self.declaration()
                else:
                    if self.v != ";":
                        self.expression()
                    self.need(";")
                if self.v != ";":
                    self.expression()
                self.need(";")
                if self.v != ")":
                    self.expression()
                self.need(")")
                self.inner()
            elif v == "switch":
                self.paren()
                self.switch += 1
                self.statement()
                self.switch -= 1
            elif v == "return":
                if self.v != ";":
                    self.initializer() if self.v == "{" else self.expression()
                self.need(";")
            elif v in ("break", "continue"):
                if not (self.loop or v == "break" and self.switch):
                    self.fail("outside of a loop, before")
                self.need(";")
            elif v == "goto":
                self.name() if self.v != "*" else self.expression()
                self.need(";")
            elif v in ("case", "default"):
                if not self.switch:
                    self.fail("outside of a switch, before")
                if v == "case":
                    self.conditional()
                    if self.eat("..."):
                        self.conditional()
                self.need(":")
                self.labelled()
            elif v == "else":
                self.fail("else without if before")
            else:
                self.i -= 1
                self.skip_asm()
        elif self.name_at() and self.pv() == ":":
            self.i += 2
            self.attributes()
            self.labelled()
        else:
            macro = self.name_at() and v.isupper() and self.pv() == "("
            self.expression()
            if not self.eat(";") and not (macro and self.t[self.i - 1][1] == ")"):
                self.fail("need ;, found")

    def labelled(self) -> None:
        if self.v == "}":
            return
        if self.starts_declaration():
            self.declaration()
        else:
            self.statement()

    def inner(self) -> None:
        self.loop += 1
        self.statement()
        self.loop -= 1

    # -- expressions; True where the result can be assigned to
    def expression(self) -> None:
        self.assignment()
        while self.eat(","):
            self.assignment()

    def assignment(self) -> None:
        place = self.conditional()
        if self.v in _ASSIGN:
            if not place:
                self.fail("can't assign before")
            self.i += 1
            self.assignment()

    def conditional(self) -> bool:
        place = self.binary(0)
        if self.eat("?"):
            if self.v != ":":
                self.expression()
            self.need(":")
            self.conditional()
            return False
        return place

    def binary(self, least: int) -> bool:
        place = self.unary()
        while (p := _BINARY.get(self.v, 0)) > least and self.kind == "p":
            self.i += 1
            self.binary(p)
            place = False
        return place

    def cast_ahead(self) -> bool:
        """At '(': whether a type name is inside, and an operand follows where the name is unknown."""
        if self.starts_type(1) and self.pv(1) not in self.types or self.pv(1) in self.types:
            return True
        if not self.name_at(1):
            return False
        k = 2
        stars = 0
        while self.pv(k) == "*" or self.pv(k) in _QUALIFIERS:
            stars += 1
            k += 1
        if self.pv(k) != ")":
            return False
        after, kind = self.pv(k + 1), self.pk(k + 1)
        return stars > 0 or kind in ("num", "str", "chr") or kind == "id" and after not in ("sizeof",) and after not in _KEYWORDS or after in ("{", "~", "!") or after == "sizeof"

    def type_name(self) -> None:
        self.abstract, old = True, getattr(self, "abstract", False)
        found, _ = self.specifiers()
        self.abstract = old
        if not found:
            self.fail("need a type, found")
        self.declarator(True)

    def unary(self) -> bool:
        v, kind = self.v, self.kind
        if kind == "p":
            if v in ("+", "-", "!", "~", "&", "*", "&&"):
                self.i += 1
                self.unary()
                return v == "*"
            if v in ("++", "--"):
                self.i += 1
                if not self.unary():
                    self.fail("can't step before")
                return False
            if v == "(" and self.cast_ahead():
                self.i += 1
                self.type_name()
                self.need(")")
                if self.v == "{":
                    self.initializer()
                    return self.postfix(True)
                self.unary()
                return False
        elif kind == "id":
            if v in ("sizeof", "_Alignof", "alignof", "__alignof__"):
                self.i += 1
                if self.v == "(" and self.cast_ahead():
                    self.i += 1
                    self.type_name()
                    self.need(")")
                    if self.v == "{":
                        self.initializer()
                else:
                    self.unary()
                return False
            if v in ("__extension__", "__real__", "__imag__"):
                self.i += 1
                return self.unary()
        return self.postfix(self.primary())

    def primary(self) -> bool:
        kind, v = self.kind, self.v
        if kind in ("num", "chr"):
            self.i += 1
            return False
        if kind == "str":
            while self.kind == "str" or self.kind == "id" and self.t[self.i][1].isupper() and self.pk() == "str":
                self.i += 1
                while self.kind == "id" and self.t[self.i - 1][0] == "str" and re.match(r"PRI\w+$", self.t[self.i][1]):
                    self.i += 1
            return True
        if v == "(":
            self.i += 1
            if self.v == "{":
                self.block()
                self.need(")")
                return False
            self.expression()
            self.need(")")
            return True
        if v == "_Generic":
            self.i += 1
            self.balanced()
            return False
        if v in ("va_arg", "__builtin_va_arg", "offsetof", "__builtin_offsetof") and self.pv() == "(":
            self.i += 1
            self.balanced()
            return False
        self.name()
        return True

    def postfix(self, place: bool) -> bool:
        while True:
            v = self.v
            if v == "[":
                self.i += 1
                self.expression()
                self.need("]")
                place = True
            elif v == "(":
                self.i += 1
                while not self.eat(")"):
                    if self.starts_type() and self.pv() not in (".", "->", "(", "[") and self.v not in self.types:
                        self.type_name()  # an argument of some header's macro
                    else:
                        self.assignment()
                    if self.v != ")":
                        self.need(",")
                        if self.v == ")":
                            self.fail()
                place = False
            elif v in (".", "->"):
                self.i += 1
                self.name()
                place = True
            elif v in ("++", "--"):
                if not place:
                    self.fail("can't step before")
                self.i += 1
                place = False
            else:
                return place


def parse(text: str, env: Env | None = None) -> None:
    """Raises Invalid where the text is no C; with an environment, where stretches between statements of a file aren't."""
    try:
        Parser(preprocess(text.lstrip("\ufeff"), env), env and env.types).program()
    except RecursionError as e:
        raise Invalid("nested too deeply") from e
