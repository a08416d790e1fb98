"""Whether documentation says anything beyond a function's name, parameters and types."""

from __future__ import annotations

import re

from marlstone.llm import langid

# Words that documentation may have without saying anything.
FILLER = set(
    "the a an this that these those it its and or of for to in on with from by as at is are be was will given using used use uses "
    "function functions method methods class constructor procedure routine helper util utility stub module object instance self cls "
    "get gets getter set sets setter return returns returned returning yield yields value values result results output input "
    "param params parameter parameters arg args argument arguments type types kind name names new some any specified respective "
    "int integer float double str string bool boolean list dict array tuple map number void none null undefined char const size_t long promise any object optional default "
    "does do performs perform executes execute runs run calls call handles handle implements implementation simple simply basic "
    "raises raise raised throws throw thrown exception error errors initialize initialise initializes initialises init creates create "
    "here there needed etc see also note please we".split()
)
# Words of placeholders, in several languages.
PLACEHOLDER = set(
    "todo fixme tbd tba xxx wip hack n/a na none undocumented docs doc docstring documentation document documented documenting description describe summary comment comments "
    "inheritdoc inherit inherited inherits above below n available unavailable something anything provided parent base super same overridden override missing placeholder insert add write fill fixme later auto autogenerated generated auto-generated automatically not yet yes no stub method function text goes lorem ipsum coming soon work progress "
    "beschreibung dokumentation dokumentieren fehlt folgt noch keine ergänzen hier einfügen offen später kommentar "
    "documenter compléter completer à décrire aucune à faire documentation manquante ici plus tard "
    "documentar descripción descripcion pendiente completar falta sin documentación descrição descricao documentação pendente preencher "
    "opis brak dokumentacji uzupełnić do uzupełnienia później udokumentować "
    "описание документация документировать добавить нет описания заполнить позже дописать "
    .split()
)
_CJK_PLACEHOLDER = re.compile(r"^(?:待(?:补充|完善|办|写|定|填写)?|暂无(?:说明|描述|文档|注释)?|无(?:说明|描述)?|说明|描述|文档|注释|补充|待补充说明|文档待补充|説明|概要|未(?:記入|記載|定|作成|完成)|ドキュメント|なし|後で(?:書く|記述)?|あとで(?:書く)?|説明(?:なし|を追加|文)|要(?:記入|説明)|TODO|[\s.。:：,，、!！\-_*]+)+$", re.I)
_TAGS = re.compile(r"^\s*[@\\:](?P<tag>param|parameter|arg|argument|key|keyword|type|returns?|rtype|throws?|raises?|exception|yields?|var|ivar|property|prop|template|example|see|since|deprecated|brief|fn|details|note)\b\s*(?P<rest>.*)$", re.I)
_SECTION = re.compile(r"^\s*(?P<s>args?|arguments?|parameters?|params?|returns?|return value|yields?|raises?|throws|exceptions?|attributes|keyword args|other parameters)\s*:?\s*$", re.I)
_RULE = re.compile(r"^\s*[-=~*_#.]{2,}\s*$")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def stem(w: str) -> str:
    """A word without the ending of a number or tense, then without that of an agent."""
    w = w.lower()
    for a, b in (("ies", "y"), ("ied", "y"), ("ying", "y"), ("ing", ""), ("ed", ""), ("es", ""), ("s", "")):
        if w.endswith(a) and len(w) - len(a) >= 3:
            w = w[: -len(a)] + b
            break
    while a := next((a for a in ("er", "or", "e", "y") if w.endswith(a) and len(w) - len(a) >= 3), None):
        w = w[: -len(a)]
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] else w


def name_words(*names: str | None) -> set[str]:
    return {stem(p) for n in names if n for p in _CAMEL.findall(re.sub(r"[^\w]", " ", n))} | {n.lower() for n in names if n}


def phrases(content: str) -> list[tuple[str, str, str]]:
    """(what, text, of): the free text of a documentation comment, and the descriptions of its tags and sections with the
    parameter each is about."""
    out: list[tuple[str, str, str]] = []
    section, lines = "", re.sub(r"\r\n?", "\n", content).split("\n")
    about = ""
    for k, raw in enumerate(lines):
        line = re.sub(r"^\s*(?:/\*\*?|\*/|\*(?!\*))\s?", "", raw).rstrip()
        line = re.sub(r"\*/\s*$", "", line)
        if not line.strip() or _RULE.match(line):
            continue
        if m := _TAGS.match(line):
            section, about = "", ""
            rest = re.sub(r"^\{[^}]*\}+\s*", "", m["rest"])
            tag = m["tag"].lower()
            if line.lstrip()[0] == ":":
                head, _, rest = rest.partition(":") if not rest.startswith(":") else ("", "", rest[1:])
                about = head.split()[-1] if head.split() else ""
                if tag in ("type", "rtype"):
                    continue
            elif tag in ("param", "parameter", "arg", "argument", "key", "keyword", "throws", "throw", "raises", "raise", "exception", "property", "prop", "var", "template", "type"):
                named = re.match(r"^\[?([\w$.]+)(?:=[^\]]*)?\]?\s*[-–:]?\s*", rest)
                if named:
                    about, rest = named[1], rest[named.end() :]
            out.append((tag, rest, about))
            continue
        if (m := _SECTION.match(line)) and (line.rstrip().endswith(":") or k + 1 < len(lines) and _RULE.match(lines[k + 1])):
            section, about = m["s"].lower(), ""
            continue
        if section:
            if not re.match(r"^\s", line) and k and not re.match(r"^[\w*]+\s*:\s*\S*", line) and not re.match(r"^[\w\[\], .]{1,40}$", line):
                section = ""
                out.append(("text", line, ""))
                continue
            m = re.match(r"^\s*\*{0,2}([\w$.]+)\s*(?:\([^)]*\))?\s*:\s*(.*)$", line)
            if m:
                about = m[1]
            out.append((section, m[2] if m else line, about))
            continue
        out.append(("text", line, about))
    return out


def says_something(content: str | None, name: str | None, signature: str | None) -> bool:
    """False for blank text, placeholders, restated names, and parameter lists without descriptions or with restated ones."""
    if content is None or not re.search(r"\w", content):
        return False
    known = name_words(name) | name_words(*re.findall(r"[A-Za-z_$][\w$]*", signature or ""))
    if name and re.fullmatch(r"\W*" + re.escape(name) + r"\W*(?:\([^)]*\))?\W*", content):
        return False
    for _, text, of in phrases(content):
        here = known | name_words(of) if of else known
        text = re.sub(r"`([^`]*)`", r"\1", text)
        cjk = re.sub(r"[\x00-⹿\s]", "", text)
        if len(cjk) >= 2 and (langid._HAN.search(cjk) or langid._KANA.search(cjk)):
            if not _CJK_PLACEHOLDER.match(re.sub(r"(?i)\b(?:todo|fixme|tbd)\b", "", text).strip()):
                return True
            continue
        words = re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", text)
        if re.fullmatch(r"\W*[_\[<{(]?_?(?:summary|description|type|desc)_?\W*", text, re.I):
            continue
        left = []
        for w in words:
            lw = w.lower()
            parts = [stem(p) for p in _CAMEL.findall(w)] or [stem(w)]
            if lw in FILLER or all(p in here for p in parts) or stem(w) in here or lw in here:
                continue
            left.append(lw)
        if left and not all(w in PLACEHOLDER or langid.fold(w) in PLACEHOLDER for w in left):
            return True
    return False
