"""Grammar of JavaScript modules and of TypeScript without JSX: whether a text is syntactically valid."""

from __future__ import annotations

import re


class Invalid(Exception):
    """The text breaks the grammar."""


# Words of the language.
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with "
    "let static implements interface package private protected public yield await".split()
)
_TS_OK = frozenset("static implements interface package private protected public yield await let".split())
_BEFORE_REGEX = frozenset("return typeof instanceof in of new delete void throw case do else yield await".split())
_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())

_SKIP = re.compile(r"(?:[ \t\v\f\r\n\u00a0\ufeff\u2028\u2029\u1680\u2000-\u200a\u202f\u205f\u3000]+|//[^\n\r\u2028\u2029]*|/\*.*?\*/)+", re.S)
_LEX = re.compile(
    r"""(?P<num>(?:0[xX][\da-fA-F](?:_?[\da-fA-F])*|0[oO][0-7](?:_?[0-7])*|0[bB][01](?:_?[01])*)n?|(?:0|[1-9](?:_?\d)*)n|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)
    |(?P<id>\#?(?:[^\W\d]|[$_\u200c\u200d]|\\u[\da-fA-F]{4}|\\u\{[\da-fA-F]+\})(?:[\w$\u200c\u200d]|\\u[\da-fA-F]{4}|\\u\{[\da-fA-F]+\})*)
    |(?P<str>"(?:[^"\\\n\r]|\\(?:\r\n|.))*"|'(?:[^'\\\n\r]|\\(?:\r\n|.))*')
    |(?P<tick>`)
    |(?P<p>\.\.\.|=>|>>>=|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|===|!==|>>>|\*\*|<<|>>|<=|>=|==|!=|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[{}()\[\];,<>+\-*/%&|^!~?:=.@])""",
    re.X | re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:\\[^\n\r]|\[(?:\\[^\n\r]|[^\]\\\n\r])*\]|[^/\\\[\n\r])+/([A-Za-z]*)")
_BAD_ESCAPE = re.compile(r"\\(?:x(?![\da-fA-F]{2})|u(?![\da-fA-F]{4}|\{[\da-fA-F]+\})|[1-9]|0\d)")
_TEMPLATE_PART = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


class Tok:
    __slots__ = ("end", "kind", "nl", "parts", "pos", "v")

    def __init__(self, kind: str, v: str, nl: bool, pos: int, end: int, parts: list | None = None):
        self.kind, self.v, self.nl, self.pos, self.end, self.parts = kind, v, nl, pos, end, parts


def tokenize(text: str, at: int = 0, inner: bool = False) -> tuple[list[Tok], int]:
    """Tokens up to the end, or up to the brace that closes a template's hole."""
    out: list[Tok] = []
    nl, n, stack = False, len(text), []
    if not at and text.startswith("#!"):
        at = (text + "\n").index("\n")
    match, match_regex, skip = _LEX.match, _REGEX.match, _SKIP.match
    while at < n:
        c = text[at]
        if (c <= " " or c == "/" or c > "\x7f") and (m := skip(text, at)):
            v, at = m.group(), m.end()
            nl = nl or "\n" in v or "\r" in v or "\u2028" in v
            continue
        m = match(text, at)
        if m is None:
            raise Invalid(f"character {c!r} at {at}")
        kind, v, end = m.lastgroup, m.group(), m.end()
        parts = None
        if kind == "num":
            if end < n and (text[end].isalnum() or text[end] in "_$"):
                raise Invalid(f"number at {at}")
        elif kind == "str":
            if "\\" in v and _BAD_ESCAPE.search(v.replace("\\\\", "")):
                raise Invalid(f"escape at {at}")
        elif kind == "tick":
            parts, end = _template(text, at)
            kind = "tmpl"
        elif v in "/" or v == "/=":
            last = out[-1] if out else None
            if last is None or (last.kind == "p" and last.v not in (")", "]", "}", "++", "--")) or (last.kind == "id" and last.v in _BEFORE_REGEX) or (last.v == "}" and nl):
                r = match_regex(text, at)
                if r:
                    if re.search(r"[^dgimsuvy]|(.).*\1", r[1]):
                        raise Invalid(f"flags at {at}")
                    kind, v, end = "re", r.group(), r.end()
        if kind == "p":
            if v in _OPEN:
                stack.append(v)
            elif v in _CLOSE:
                if not stack:
                    if inner and v == "}":
                        out.append(Tok("eof", "", nl, at, at))
                        return out, end
                    raise Invalid(f"{v} at {at}")
                if stack.pop() != _CLOSE[v]:
                    raise Invalid(f"{v} at {at}")
        out.append(Tok(kind, v, nl, at, end, parts))
        nl = False
        at = end
    if stack or inner:
        raise Invalid("open at the end")
    out.append(Tok("eof", "", nl, n, n))
    return out, n


def _template(text: str, at: int) -> tuple[list[list[Tok]], int]:
    holes, at = [], at + 1
    while True:
        at = _TEMPLATE_PART.match(text, at).end()
        if at >= len(text) or text[at] == "\\":
            raise Invalid("open template")
        if text[at] == "`":
            return holes, at + 1
        toks, at = tokenize(text, at + 2, True)
        holes.append(toks)


class Parser:
    def __init__(self, toks: list[Tok], ts: bool):
        self.t, self.i, self.ts = toks, 0, ts
        self.cur = toks[0]
        self.fn = self.loop = self.breakable = 0
        self.is_async, self.gen, self.labels = True, False, []
        self.no_in = self.ambient = self.exporting = False
        self.exports: list[str] = []  # names that the module gives out, in order

    # -- tokens
    def next(self) -> Tok:
        t = self.cur
        self.i += 1
        self.cur = self.t[self.i] if self.i < len(self.t) else self.t[-1]
        return t

    def back(self, i: int) -> None:
        self.i = i
        self.cur = self.t[i]

    def peek(self, k: int = 1) -> Tok:
        return self.t[min(self.i + k, len(self.t) - 1)]

    def fail(self, what: str = "") -> None:
        raise Invalid(f"{what or 'unexpected'} {self.cur.v!r} at {self.cur.pos}")

    def at(self, v: str) -> bool:
        return self.cur.v == v and self.cur.kind in ("p", "id")

    def eat(self, v: str) -> bool:
        if self.cur.v == v and self.cur.kind in ("p", "id"):
            self.next()
            return True
        return False

    def need(self, v: str) -> None:
        if not self.eat(v):
            self.fail(f"need {v}, found")

    def semi(self) -> None:
        if self.eat(";") or self.cur.nl or self.cur.kind == "eof" or self.at("}"):
            return
        self.fail("need ;, found")

    def ident(self, any_word: bool = False) -> str:
        t = self.cur
        if t.kind != "id" or t.v[0] == "#":
            self.fail("need a name, found")
        if not any_word and t.v in RESERVED and not (self.ts and t.v in _TS_OK - {"await", "yield"}) and not (t.v == "yield" and self.ts and not self.gen):
            self.fail("reserved")
        return self.next().v

    # -- statements
    def program(self) -> None:
        while self.cur.kind != "eof":
            self.statement(top=True)

    def statement(self, top: bool = False, decl: bool = True) -> None:
        t = self.cur
        if t.kind == "p":
            if t.v == "{":
                self.block()
                return
            if t.v == ";":
                self.next()
                return
            if t.v == "@":
                self.decorators()
                self.eat("export") and self.eat("default")
                self.eat("abstract")
                if not self.at("class"):
                    self.fail("decorator before")
                self.class_(True)
                return
        elif t.kind == "id":
            f = getattr(self, "s_" + t.v, None) if t.v in _STATEMENTS else None
            if f is not None:
                if f(top, decl) is not False:
                    return
            elif self.ts and t.v in _TS_STATEMENTS and self.ts_statement(top):
                return
            if self.peek().v == ":" and self.peek().kind == "p" and t.v not in RESERVED:
                self.next(), self.next()
                self.labels.append(t.v)
                self.statement()
                self.labels.pop()
                return
        self.expression()
        self.semi()

    def block(self) -> None:
        self.need("{")
        while not self.at("}"):
            if self.cur.kind == "eof":
                self.fail()
            self.statement()
        self.next()

    def s_var(self, top: bool, decl: bool) -> None:
        self.next()
        self.declarators(False)
        self.semi()

    def s_const(self, top: bool, decl: bool) -> None:
        if not decl:
            self.fail()
        self.next()
        if self.ts and self.at("enum"):
            self.enum()
            return
        self.declarators(True)
        self.semi()

    def s_let(self, top: bool, decl: bool) -> None:
        if not decl:
            self.fail()
        self.next()
        self.declarators(False)
        self.semi()

    def declarators(self, const: bool, loop: bool = False) -> int:
        n = 0
        exporting, self.exporting = self.exporting, False
        while True:
            pattern = self.cur.v in ("[", "{")
            begin = self.i
            self.binding()
            if exporting:
                own = self.t[begin : self.i]
                # A name of a pattern has no colon behind it; patterns with defaults aren't looked into.
                if not any(t.v == "=" for t in own):
                    self.exports += [t.v for t, u in zip(own, [*own[1:], self.t[-1]]) if t.kind == "id" and u.v != ":"]
            if self.ts and self.eat("!"):
                pass
            if self.ts and self.eat(":"):
                self.type()
            if self.eat("="):
                self.assignment()
            elif loop and n == 0 and (self.at("of") or self.at("in")):
                return 1
            elif (const or pattern) and not self.ambient:
                self.fail("no value before")
            n += 1
            if not self.eat(","):
                return n if not loop else 2

    def s_function(self, top: bool, decl: bool) -> None:
        self.function(True)

    def s_async(self, top: bool, decl: bool):
        if self.peek().v == "function" and not self.peek().nl:
            self.function(True)
            return None
        return False

    def s_class(self, top: bool, decl: bool) -> None:
        if not decl:
            self.fail()
        self.class_(True)

    def s_if(self, top: bool, decl: bool) -> None:
        self.next()
        self.paren()
        self.statement(decl=False)
        if self.eat("else"):
            self.statement(decl=False)

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def body(self) -> None:
        self.loop += 1
        self.breakable += 1
        self.statement(decl=False)
        self.loop -= 1
        self.breakable -= 1

    def s_while(self, top: bool, decl: bool) -> None:
        self.next()
        self.paren()
        self.body()

    def s_do(self, top: bool, decl: bool) -> None:
        self.next()
        self.body()
        self.need("while")
        self.paren()
        self.eat(";")

    def s_for(self, top: bool, decl: bool) -> None:
        self.next()
        self.eat("await")
        self.need("(")
        if self.cur.v in ("var", "let", "const") and self.cur.kind == "id":
            const = self.next().v == "const"
            old, self.no_in = self.no_in, True
            kind = self.declarators(const, True)
            self.no_in = old
            if kind == 1:
                self.next()
                self.expression()
                self.need(")")
                self.body()
                return
        elif not self.at(";"):
            old, self.no_in = self.no_in, True
            kind = self.expression()
            self.no_in = old
            if self.at("of") or self.at("in"):
                if kind not in ("id", "member", "arr", "obj", "paren"):
                    self.fail()
                self.next()
                self.expression()
                self.need(")")
                self.body()
                return
        self.need(";")
        if not self.at(";"):
            self.expression()
        self.need(";")
        if not self.at(")"):
            self.expression()
        self.need(")")
        self.body()

    def s_return(self, top: bool, decl: bool) -> None:
        if not self.fn:
            self.fail("outside of a function:")
        self.next()
        if not (self.at(";") or self.at("}") or self.cur.nl or self.cur.kind == "eof"):
            self.expression()
        self.semi()

    def jump(self, ok: int) -> None:
        self.next()
        if self.cur.kind == "id" and not self.cur.nl and self.cur.v not in RESERVED:
            if self.next().v not in self.labels:
                self.fail("no such label before")
        elif not ok:
            self.fail("outside of a loop:")
        self.semi()

    def s_break(self, top: bool, decl: bool) -> None:
        self.jump(self.breakable)

    def s_continue(self, top: bool, decl: bool) -> None:
        self.jump(self.loop)

    def s_throw(self, top: bool, decl: bool) -> None:
        self.next()
        if self.cur.nl:
            self.fail("line break before")
        self.expression()
        self.semi()

    def s_try(self, top: bool, decl: bool) -> None:
        self.next()
        self.block()
        ok = False
        if self.eat("catch"):
            ok = True
            if self.eat("("):
                self.binding()
                if self.ts and self.eat(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.eat("finally"):
            ok = True
            self.block()
        if not ok:
            self.fail("need catch, found")

    def s_switch(self, top: bool, decl: bool) -> None:
        self.next()
        self.paren()
        self.need("{")
        self.breakable += 1
        default = False
        while not self.eat("}"):
            if self.eat("case"):
                self.expression()
            else:
                self.need("default")
                if default:
                    self.fail("second default before")
                default = True
            self.need(":")
            while not (self.at("case") or self.at("default") or self.at("}")):
                self.statement()
        self.breakable -= 1

    def s_with(self, top: bool, decl: bool) -> None:
        self.fail()

    def s_debugger(self, top: bool, decl: bool) -> None:
        self.next()
        self.semi()

    def s_import(self, top: bool, decl: bool):
        if self.peek().v in ("(", "."):
            return False
        if not top:
            self.fail()
        self.next()
        if self.cur.kind != "str":
            if self.ts and self.at("type") and not (self.peek().v == "from" and self.peek(2).kind == "str") and self.peek().v not in (",", "="):
                self.next()
            named = False
            if self.cur.kind == "id":
                self.ident()
                named = True
                if self.ts and self.eat("="):
                    self.expression()
                    self.semi()
                    return None
            if not named or self.eat(","):
                if self.eat("*"):
                    self.need("as")
                    self.ident()
                else:
                    self.specifiers(True)
            self.need("from")
        self.source()
        return None

    def source(self) -> None:
        if self.cur.kind != "str":
            self.fail("need a source, found")
        self.next()
        if (self.at("with") or self.at("assert")) and not self.cur.nl and self.peek().v == "{":
            self.next()
            self.object()
        self.semi()

    def specifiers(self, importing: bool) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.ts and self.at("type") and self.peek().v not in (",", "}", "as"):
                self.next()
            first = self.cur
            if first.kind == "str":
                self.next()
            else:
                self.ident(True)
            if self.eat("as"):
                if importing:
                    self.ident()
                elif self.cur.kind == "str":
                    first = self.next()
                else:
                    first = self.cur
                    self.ident(True)
            elif importing and (first.kind == "str" or first.v in RESERVED and not self.ts):
                self.fail("reserved name before")
            if not importing:
                self.exports.append(first.v.strip("\"'"))
            if not self.eat(","):
                self.need("}")
                return

    def s_export(self, top: bool, decl: bool) -> None:
        if not top:
            self.fail()
        self.next()
        if self.eat("default"):
            self.exports.append("default")
            if self.at("function") or self.at("async") and self.peek().v == "function" and not self.peek().nl:
                self.function(True, optional_name=True)
            elif self.at("class") or self.at("@") or self.ts and self.at("abstract") and self.peek().v == "class":
                self.at("@") and self.decorators()
                self.eat("abstract")
                self.class_(False)
            elif self.ts and self.at("interface"):
                self.ts_statement(True)
            else:
                self.assignment()
                self.semi()
        elif self.eat("*"):
            if self.eat("as"):
                self.exports.append(self.cur.v.strip("\"'"))
                self.cur.kind == "str" and self.next() or self.ident(True)
            self.need("from")
            self.source()
        elif self.at("{") or self.ts and self.at("type") and self.peek().v in ("{", "*"):
            if self.eat("type") and self.eat("*"):
                self.eat("as") and self.ident(True)
                self.need("from")
                self.source()
                return
            self.specifiers(False)
            if self.eat("from"):
                self.source()
            else:
                self.semi()
        elif self.cur.v in ("var", "let", "const", "function", "class", "async") or self.at("@"):
            if self.at("async") and self.peek().v != "function":
                self.fail()
            k = 1 + self.at("async")
            if self.at("class") or self.peek(k - 1).v == "function":
                name = self.peek(k + (self.peek(k).v == "*"))
                self.exports += [name.v] if name.kind == "id" else []
            self.exporting = self.cur.v in ("var", "let", "const")
            self.statement(True)
        elif self.ts and self.eat("="):
            self.expression()
            self.semi()
        elif self.ts and self.eat("as"):
            self.need("namespace")
            self.ident()
            self.semi()
        elif self.ts and self.at("import"):
            self.s_import(True, True)
        elif not (self.ts and self.cur.v in _TS_STATEMENTS and self.ts_statement(True)):
            self.fail()

    # -- bindings, functions, classes
    def binding(self) -> None:
        if self.eat("["):
            while not self.eat("]"):
                if self.eat(","):
                    continue
                rest = self.eat("...")
                self.binding()
                if self.eat("=") and not rest:
                    self.assignment()
                if not self.at("]"):
                    if rest:
                        self.fail()
                    self.need(",")
        elif self.eat("{"):
            while not self.eat("}"):
                if self.eat("..."):
                    self.ident()
                else:
                    t = self.cur
                    if self.eat("["):
                        self.assignment()
                        self.need("]")
                        self.need(":")
                        self.binding()
                    else:
                        if t.kind not in ("id", "str", "num"):
                            self.fail()
                        self.next()
                        if self.eat(":"):
                            self.binding()
                        elif t.kind != "id" or t.v in RESERVED and not (self.ts and t.v in _TS_OK):
                            self.fail("reserved name before")
                    if self.eat("="):
                        self.assignment()
                if not self.at("}"):
                    self.need(",")
        else:
            self.ident()

    def params(self) -> None:
        self.need("(")
        old, self.no_in = self.no_in, False
        while not self.eat(")"):
            if self.ts:
                self.at("@") and self.decorators()
                while self.cur.v in ("public", "private", "protected", "readonly", "override") and self.cur.kind == "id" and (self.peek().kind == "id" or self.peek().v in ("{", "[")):
                    self.next()
            rest = self.eat("...")
            if self.ts and self.at("this"):
                self.next()
            else:
                self.binding()
            if self.ts:
                self.eat("?")
                if self.eat(":"):
                    self.type()
            if self.eat("="):
                if rest:
                    self.fail()
                self.assignment()
            if not self.at(")"):
                if rest:
                    self.fail("after the rest:")
                self.need(",")
        self.no_in = old

    def inside(self, is_async: bool, gen: bool, run) -> None:
        old = (self.is_async, self.gen, self.loop, self.breakable, self.labels, self.no_in)
        self.is_async, self.gen, self.loop, self.breakable, self.labels, self.no_in = is_async, gen, 0, 0, [], False
        self.fn += 1
        run()
        self.fn -= 1
        self.is_async, self.gen, self.loop, self.breakable, self.labels, self.no_in = old

    def function(self, declaration: bool, optional_name: bool = False) -> None:
        is_async = self.eat("async")
        self.need("function")
        gen = self.eat("*")
        if not self.at("(") and not (self.ts and self.at("<")):
            self.ident()
        elif declaration and not optional_name:
            self.fail("need a name, found")

        def run() -> None:
            self.signature()
            if self.ts and not self.at("{") and declaration:
                self.semi()
            else:
                self.block()

        self.inside(is_async, gen, run)

    def signature(self) -> None:
        if self.ts and self.at("<"):
            self.type_params()
        self.params()
        if self.ts and self.eat(":"):
            self.type(True)

    def decorators(self) -> None:
        while self.eat("@"):
            if self.at("("):
                self.paren()
            else:
                self.ident(True)
                while self.eat("."):
                    self.ident(True)
                if self.at("("):
                    self.arguments()

    def class_(self, named: bool) -> None:
        self.need("class")
        if self.cur.kind == "id" and self.cur.v not in ("extends", "implements") or named and not self.at("{"):
            self.ident()
        elif named:
            self.fail("need a name, found")
        if self.ts and self.at("<"):
            self.type_params()
        if self.eat("extends"):
            self.call(self.primary(), True)
            if self.ts and self.at("<"):
                self.type_args()
        if self.ts and self.eat("implements"):
            self.type()
            while self.eat(","):
                self.type()
        self.need("{")
        while not self.eat("}"):
            if not self.eat(";"):
                self.member()

    def member(self) -> None:
        self.at("@") and self.decorators()
        is_async = gen = False
        accessor = abstract = False
        words = ("static", "async", "get", "set", "accessor") + (("public", "private", "protected", "abstract", "override", "readonly", "declare") if self.ts else ())
        while self.cur.kind == "id" and self.cur.v in words:
            after = self.peek()
            if after.kind == "p" and after.v in ("(", "=", ";", "}", ",") or after.kind == "eof" or self.ts and after.kind == "p" and after.v in (":", "?", "!", "<") or after.nl and self.cur.v not in ("static", "public", "private", "protected") and after.v != "*" and self.cur.v in ("async", "get", "set"):
                break
            w = self.next().v
            if w == "static" and self.at("{"):
                self.inside(False, False, self.block)
                return
            is_async |= w == "async"
            accessor |= w in ("get", "set")
            abstract |= w in ("abstract", "declare")
        gen = self.eat("*")
        if self.ts and self.at("[") and self.peek().kind == "id" and self.peek(2).v == ":":
            self.next(), self.next(), self.next()
            self.type()
            self.need("]")
            if self.eat(":"):
                self.type()
            self.semi()
            return
        self.key(True)
        if self.ts:
            self.eat("?") or self.eat("!")
        if self.at("(") or self.ts and self.at("<"):

            def run() -> None:
                self.signature()
                if self.ts and not self.at("{"):
                    self.semi()
                else:
                    self.block()

            self.inside(is_async, gen, run)
            return
        if is_async or gen or accessor:
            self.fail()
        if self.ts and self.eat(":"):
            self.type()
        if self.eat("="):
            self.inside(False, False, self.assignment)
        self.semi()

    def key(self, private: bool = False) -> Tok:
        t = self.cur
        if t.kind == "p" and t.v == "[":
            self.next()
            old, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = old
            self.need("]")
        elif t.kind in ("id", "str", "num"):
            if t.kind == "id" and t.v[0] == "#" and not private:
                self.fail()
            self.next()
        else:
            self.fail("need a key, found")
        return t

    # -- expressions; each gives the kind of what was read
    def expression(self) -> str:
        kind = self.assignment()
        while self.eat(","):
            self.assignment()
            kind = "other"
        return kind

    def arrow_ahead(self) -> bool:
        """At '(': whether an arrow follows the closing bracket."""
        depth, k = 0, self.i
        while True:
            v, kind = self.t[k].v, self.t[k].kind
            if kind == "p":
                if v in "([{":
                    depth += 1
                elif v in ")]}":
                    depth -= 1
                    if not depth:
                        break
            elif kind == "eof":
                return False
            k += 1
        after = self.t[k + 1]
        if after.v == "=>" and after.kind == "p":
            return not after.nl
        if self.ts and after.v == ":" and after.kind == "p":
            i = self.i
            try:
                self.params()
                self.need(":")
                self.type(True)
                return self.at("=>")
            except Invalid:
                return False
            finally:
                self.back(i)
        return False

    def arrow_body(self, is_async: bool) -> str:
        if self.cur.nl:
            self.fail("line break before")
        self.need("=>")
        no_in = self.no_in

        def run() -> None:
            if self.at("{"):
                self.block()
            else:
                self.no_in = no_in
                self.assignment()

        self.inside(is_async, False, run)
        return "arrow"

    def assignment(self) -> str:
        t = self.cur
        if t.kind == "id":
            if t.v == "async" and not self.peek().nl and (self.peek().kind == "id" and self.peek(2).v == "=>" or self.peek().v == "(" or self.ts and self.peek().v == "<"):
                i = self.i
                self.next()
                if self.cur.kind == "id":
                    self.ident()
                    return self.arrow_body(True)
                if self.at("<"):
                    try:
                        self.type_params()
                    except Invalid:
                        self.back(i)
                if self.at("(") and self.arrow_ahead():
                    self.inside(True, False, self.signature)
                    return self.arrow_body(True)
                self.back(i)
            elif t.v == "yield" and self.gen:
                self.next()
                if not self.cur.nl and self.cur.v not in (")", "]", "}", ",", ";", ":", "in", "of") and self.cur.kind != "eof":
                    self.eat("*")
                    self.assignment()
                return "other"
            elif self.peek().v == "=>" and self.peek().kind == "p" and t.v != "this":
                self.ident()
                return self.arrow_body(False)
        elif t.kind == "p":
            if t.v == "(" and self.arrow_ahead():
                self.inside(False, False, self.signature)
                return self.arrow_body(False)
            if t.v == "<" and self.ts:
                i = self.i
                try:
                    self.type_params()
                    if self.at("(") and self.arrow_ahead():
                        self.inside(False, False, self.signature)
                        return self.arrow_body(False)
                except Invalid:
                    pass
                self.back(i)
        kind = self.conditional()
        if self.cur.kind == "p" and self.cur.v in _ASSIGN:
            if kind not in ("id", "member", "paren") and not (self.cur.v == "=" and kind in ("arr", "obj")):
                self.fail("can't assign before")
            self.next()
            self.assignment()
            return "other"
        return kind

    def conditional(self) -> str:
        kind = self.binary(0)
        if self.at("?"):
            self.next()
            old, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = old
            self.need(":")
            self.assignment()
            return "other"
        return kind

    def binary(self, least: int) -> str:
        kind = self.unary()
        while True:
            t = self.cur
            if t.kind not in ("p", "id"):
                return kind
            if self.ts and t.v in ("as", "satisfies") and not t.nl and least < 8:
                self.next()
                self.eat("const") or self.type()
                kind = "paren"
                continue
            p = _BINARY.get(t.v)
            if p is None or p <= least or t.v == "in" and self.no_in:
                return kind
            if t.v == "**" and kind == "unary":
                self.fail()
            self.next()
            self.binary(p - 1 if t.v == "**" else p)
            kind = "other"

    def unary(self) -> str:
        t = self.cur
        if t.kind == "p":
            if t.v in ("!", "~", "+", "-"):
                self.next()
                self.unary()
                return "unary"
            if t.v in ("++", "--"):
                self.next()
                if self.unary() not in ("id", "member", "paren"):
                    self.fail("can't step before")
                return "other"
            if t.v == "<" and self.ts:
                self.next()
                self.eat("const") or self.type()
                self.close_angle()
                self.unary()
                return "paren"
        elif t.kind == "id":
            if t.v in ("typeof", "void", "delete"):
                self.next()
                kind = self.unary()
                if t.v == "delete" and kind == "id":
                    self.fail("can't delete before")
                return "unary"
            if t.v == "await":
                if not self.is_async:
                    self.fail()
                self.next()
                self.unary()
                return "unary"
            if t.v[0] == "#":
                self.next()
                if not self.at("in"):
                    self.fail()
                return "other"
        kind = self.call(self.primary())
        if self.cur.kind == "p" and self.cur.v in ("++", "--") and not self.cur.nl:
            if kind not in ("id", "member", "paren"):
                self.fail("can't step before")
            self.next()
            return "other"
        return kind

    def call(self, kind: str, heritage: bool = False) -> str:
        if kind == "arrow":
            return kind
        optional = False
        while True:
            t = self.cur
            if t.kind == "tmpl":
                if optional:
                    self.fail()
                self.holes(self.next())
                kind = "call"
            elif t.kind != "p":
                return "other" if optional else kind
            elif t.v == ".":
                self.next()
                if self.cur.kind != "id":
                    self.fail("need a name, found")
                self.next()
                kind = "member"
            elif t.v == "?.":
                self.next()
                optional = True
                if self.at("("):
                    self.arguments()
                elif self.at("["):
                    self.index()
                elif self.cur.kind == "id":
                    self.next()
                else:
                    self.fail()
            elif t.v == "[":
                self.index()
                kind = "member"
            elif t.v == "(":
                self.arguments()
                kind = "call"
            elif t.v == "!" and self.ts and not t.nl:
                self.next()
            elif self.ts and t.v in ("<", "<<") and not heritage:
                i = self.i
                try:
                    self.type_args()
                    if not (self.at("(") or self.cur.kind in ("tmpl", "eof") or self.cur.kind == "p" and self.cur.v in (")", "]", ":", ";", ",", ".", "?.", "==", "===", "!=", "!==", "&&", "||", "??", "}", "|", "^", "&")):
                        raise Invalid("no type arguments")
                except Invalid:
                    self.back(i)
                    return kind
                kind = "call"
            else:
                return "other" if optional else kind

    def index(self) -> None:
        self.need("[")
        old, self.no_in = self.no_in, False
        self.expression()
        self.no_in = old
        self.need("]")

    def arguments(self) -> None:
        self.need("(")
        old, self.no_in = self.no_in, False
        while not self.eat(")"):
            self.eat("...")
            self.assignment()
            if not self.at(")"):
                self.need(",")
        self.no_in = old

    def holes(self, t: Tok) -> None:
        for toks in t.parts:
            old, i = self.t, self.i
            self.t = toks
            self.back(0)
            no_in, self.no_in = self.no_in, False
            self.expression()
            if self.cur.kind != "eof":
                self.fail()
            self.no_in = no_in
            self.t = old
            self.back(i)

    def primary(self) -> str:
        t = self.cur
        if t.kind in ("num", "str", "re"):
            self.next()
            return "other"
        if t.kind == "tmpl":
            self.holes(self.next())
            return "other"
        if t.kind == "p":
            if t.v == "(":
                self.next()
                old, self.no_in = self.no_in, False
                self.expression()
                self.no_in = old
                self.need(")")
                return "paren"
            if t.v == "[":
                self.next()
                old, self.no_in = self.no_in, False
                while not self.eat("]"):
                    if self.eat(","):
                        continue
                    self.eat("...")
                    self.assignment()
                    if not self.at("]"):
                        self.need(",")
                self.no_in = old
                return "arr"
            if t.v == "{":
                self.object()
                return "obj"
            if t.v == "@":
                self.decorators()
                self.class_(False)
                return "other"
            self.fail()
        if t.kind != "id":
            self.fail()
        if t.v in ("this", "null", "true", "false"):
            self.next()
            return "other"
        if t.v == "super":
            self.next()
            if not (self.at("(") or self.at(".") or self.at("[")):
                self.fail()
            return "other"
        if t.v == "function" or t.v == "async" and self.peek().v == "function" and not self.peek().nl:
            self.function(False)
            return "other"
        if t.v == "class":
            self.class_(False)
            return "other"
        if t.v == "new":
            self.next()
            if self.eat("."):
                self.need("target")
                return "other"
            self.new_target()
            return "other"
        if t.v == "import":
            self.next()
            if self.eat("."):
                self.need("meta")
            elif not self.at("("):
                self.fail()
            return "other"
        self.ident()
        return "id"

    def new_target(self) -> None:
        if self.at("new"):
            self.next()
            self.new_target()
        elif self.at("import"):
            self.fail()
        else:
            self.primary()
        while True:
            if self.eat("."):
                if self.cur.kind != "id":
                    self.fail()
                self.next()
            elif self.at("["):
                self.index()
            elif self.ts and self.at("<"):
                i = self.i
                try:
                    self.type_args()
                except Invalid:
                    self.back(i)
                    return
            else:
                break
        if self.at("("):
            self.arguments()

    def object(self) -> None:
        self.need("{")
        old, self.no_in = self.no_in, False
        while not self.eat("}"):
            if self.eat("..."):
                self.assignment()
            else:
                is_async = gen = accessor = False
                while self.cur.kind == "id" and self.cur.v in ("async", "get", "set") and not (self.peek().kind == "p" and self.peek().v in ("(", ",", ":", "}", "=")) and not (self.ts and self.peek().v == "<"):
                    w = self.next().v
                    is_async, accessor = is_async or w == "async", accessor or w != "async"
                gen = self.eat("*")
                t = self.key()
                if self.at("(") or self.ts and self.at("<"):

                    def run() -> None:
                        self.signature()
                        self.block()

                    self.inside(is_async, gen, run)
                elif is_async or gen or accessor:
                    self.fail()
                elif self.eat(":"):
                    self.assignment()
                else:
                    if t.kind != "id" or t.v in RESERVED and not (self.ts and t.v in _TS_OK) and not (t.v == "await"):
                        self.fail("reserved name before")
                    if self.eat("="):
                        self.assignment()
            if not self.at("}"):
                self.need(",")
        self.no_in = old

    # -- types
    def close_angle(self) -> None:
        v = self.cur.v
        if self.cur.kind != "p" or v[0] != ">":
            self.fail("need >, found")
        if v == ">":
            self.next()
            return
        t = self.cur
        self.t = list(self.t)
        self.t[self.i] = self.cur = Tok("p", v[1:], False, t.pos + 1, t.end)

    def type_args(self) -> None:
        if self.cur.v == "<<":
            t = self.cur
            self.t = list(self.t)
            self.t[self.i : self.i + 1] = [Tok("p", "<", t.nl, t.pos, t.pos + 1), Tok("p", "<", False, t.pos + 1, t.end)]
            self.cur = self.t[self.i]
        self.need("<")
        self.type()
        while self.eat(","):
            self.type()
        self.close_angle()

    def type_params(self) -> None:
        self.need("<")
        while True:
            while self.cur.v in ("const", "in", "out") and self.peek().kind == "id":
                self.next()
            self.ident()
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()
            if not self.eat(",") or self.at(">"):
                break
        self.close_angle()

    def type(self, result: bool = False) -> None:
        if result and self.at("asserts") and self.peek().kind == "id" and not self.peek().nl and self.peek().v != "is":
            self.next()
            self.next()
            if self.eat("is"):
                self.type()
            return
        if self.cur.kind == "id" and self.peek().v == "is" and self.peek().kind == "id" and not self.peek().nl:
            self.next(), self.next()
            self.type()
            return
        if self.function_type():
            return
        self.union()
        if self.at("extends") and not self.cur.nl and not getattr(self, "no_cond", False):
            self.next()
            self.no_cond = True
            self.type()
            self.no_cond = False
            self.need("?")
            self.type()
            self.need(":")
            self.type()

    def function_type(self) -> bool:
        if self.at("new") or self.at("abstract") and self.peek().v == "new":
            self.eat("abstract")
            self.next()
        elif self.at("<"):
            pass
        elif self.at("("):
            depth, k = 0, self.i
            while True:
                v, kind = self.t[k].v, self.t[k].kind
                if kind == "p" and v in "([{":
                    depth += 1
                elif kind == "p" and v in ")]}":
                    depth -= 1
                    if not depth:
                        break
                elif kind == "eof":
                    return False
                k += 1
            if self.t[k + 1].v != "=>":
                return False
        else:
            return False
        if self.at("<"):
            self.type_params()
        self.params()
        self.need("=>")
        self.type(True)
        return True

    def union(self) -> None:
        self.eat("|") or self.eat("&")
        while True:
            if not self.function_type():
                self.prefix_type()
            if not (self.eat("|") or self.eat("&")):
                return

    def prefix_type(self) -> None:
        if self.cur.kind == "id" and self.cur.v in ("keyof", "unique", "readonly") and (self.peek().kind in ("id", "str", "tmpl") or self.peek().v in ("[", "{", "(")) and not self.peek().nl:
            self.next()
            self.prefix_type()
            return
        if self.at("infer") and self.peek().kind == "id":
            self.next()
            self.ident()
            i = self.i
            if self.at("extends"):
                self.next()
                try:
                    self.prefix_type()
                    if self.at("?"):
                        raise Invalid("a conditional")
                except Invalid:
                    self.back(i)
            return
        self.simple_type()
        while self.at("[") and not self.cur.nl:
            self.next()
            if not self.at("]"):
                self.type()
            self.need("]")

    def simple_type(self) -> None:
        t = self.cur
        if t.kind in ("str", "num"):
            self.next()
        elif t.kind == "tmpl":
            self.next()
            for toks in t.parts:
                Parser(toks, True).type()
        elif t.v == "-" and t.kind == "p":
            self.next()
            if self.next().kind != "num":
                self.fail()
        elif self.eat("("):
            self.type()
            self.need(")")
        elif self.eat("["):
            while not self.eat("]"):
                self.eat("...")
                if self.cur.kind == "id" and (self.peek().v == ":" or self.peek().v == "?" and self.peek(2).v == ":"):
                    self.next()
                    self.eat("?")
                    self.need(":")
                self.type()
                self.eat("?")
                if not self.at("]"):
                    self.need(",")
        elif self.at("{"):
            self.object_type()
        elif t.kind == "id":
            if t.v == "typeof":
                self.next()
                if self.at("import"):
                    self.simple_type()
                    return
                self.ident(True)
                while self.eat("."):
                    self.next()
                if self.at("<") and not self.cur.nl:
                    self.type_args()
                return
            if t.v == "import":
                self.next()
                self.arguments()
                while self.eat("."):
                    self.ident(True)
                if self.at("<"):
                    self.type_args()
                return
            if t.v in RESERVED and t.v not in ("this", "null", "true", "false", "void") and t.v not in _TS_OK:
                self.fail("no type:")
            self.next()
            while self.eat("."):
                self.ident(True)
            if self.at("<") and not self.cur.nl or self.cur.v == "<<" and self.cur.kind == "p":
                self.type_args()
        else:
            self.fail("no type:")

    def object_type(self) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.cur.v in ("+", "-"):
                self.next()
                if not self.at("readonly"):
                    self.fail()
            while self.cur.kind == "id" and self.cur.v in ("readonly", "get", "set", "public", "private", "static") and (self.peek().kind in ("id", "str", "num") or self.peek().v == "["):
                self.next()
            if self.at("(") or self.at("<"):
                self.signature()
            elif self.at("new") and self.peek().v in ("(", "<"):
                self.next()
                self.signature()
            else:
                if self.at("[") and self.peek().kind == "id" and self.peek(2).v in (":", "in"):
                    self.next(), self.next(), self.next()
                    self.type()
                    if self.eat("as"):
                        self.type()
                    self.need("]")
                    if self.cur.v in ("+", "-"):
                        self.next()
                else:
                    self.key()
                self.eat("?")
                if self.at("(") or self.at("<"):
                    self.signature()
                elif self.eat(":"):
                    self.type()
            if not (self.eat(";") or self.eat(",")) and not self.at("}") and not self.cur.nl:
                self.fail("need ;, found")

    def enum(self) -> None:
        self.need("enum")
        self.ident()
        self.need("{")
        while not self.eat("}"):
            self.key()
            if self.eat("="):
                self.assignment()
            if not self.at("}"):
                self.need(",")

    def ts_statement(self, top: bool) -> bool:
        v, after = self.cur.v, self.peek()
        if v == "enum":
            self.enum()
            return True
        if after.nl and v in ("type", "declare", "abstract", "namespace", "module") or after.kind not in ("id", "str", "p"):
            return False
        if v == "interface" and after.kind == "id":
            self.next()
            self.ident()
            if self.at("<"):
                self.type_params()
            if self.eat("extends"):
                self.type()
                while self.eat(","):
                    self.type()
            self.object_type()
            return True
        if v == "type" and after.kind == "id":
            self.next()
            self.ident()
            if self.at("<"):
                self.type_params()
            self.need("=")
            self.type()
            self.semi()
            return True
        if v == "abstract" and after.v == "class":
            self.next()
            self.class_(True)
            return True
        if v in ("namespace", "module") and after.kind in ("id", "str"):
            self.next()
            if self.next().kind == "id":
                while self.eat("."):
                    self.ident()
            if self.at("{"):
                self.next()
                while not self.eat("}"):
                    if self.cur.kind == "eof":
                        self.fail()
                    self.statement(True)
            else:
                self.semi()
            return True
        if v == "global" and after.v == "{":
            self.next()
            self.next()
            while not self.eat("}"):
                self.statement(True)
            return True
        if v == "declare" and after.kind == "id":
            self.next()
            old, self.ambient = self.ambient, True
            self.statement(True)
            self.ambient = old
            return True
        return False


_STATEMENTS = frozenset("var const let function async class if while do for return break continue throw try switch with debugger import export".split())
_TS_STATEMENTS = frozenset("enum interface type abstract namespace module global declare".split())


def parse(text: str, typescript: bool, first: bool = True) -> list[str]:
    """The names that a module, or statements of its top level, export. Raises Invalid where the text is none.

    A mark of the byte order and a line for the shell may stand at the head of the `first` statements only. A module that
    exports a name twice is invalid; in TypeScript that is no matter of syntax, and nothing is returned.
    """
    if not first and text.startswith(("\ufeff", "#!")):
        raise Invalid("not at the head of the file")
    toks, _ = tokenize(text.lstrip("\ufeff"))
    parser = Parser(toks, typescript)
    try:
        parser.program()
    except RecursionError as e:
        raise Invalid("nested too deeply") from e
    if typescript:
        return []
    if len(set(parser.exports)) < len(parser.exports):
        raise Invalid("exported twice")
    return parser.exports
