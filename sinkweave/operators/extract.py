"""Extraction of symbols, calls and imports from source files (IDX-3 to IDX-5).

One pass per file, in Python workers; files are independent, so nothing is shuffled. The lexer gives
tokens with matched brackets; definitions are told by the shape of each language around them, their
spans by those brackets (in Python by indentation), and a call is a name before an opening bracket
whose text reaches back over its chain. Work is linear in the file. It reads shapes, not grammars:
macros that look like definitions and types that look like calls can be taken for them. Any function
with the same output can take its place.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinkweave.operators.lexing import JS, Tokens, read, without

SYMBOL = "name string, kind string, container string, start_line int, end_line int, signature string"
CALL = "callee string, line int, from_symbol string, text string"
SCHEMA = f"symbols array<struct<{SYMBOL.replace(' ', ':').replace(',:', ',')}>>, calls array<struct<{CALL.replace(' ', ':').replace(',:', ',')}>>, imports array<string>"
SIGNATURE_CHARS, TEXT_CHARS = 80, 120

#: Names that open a bracket without being called.
_KEYWORDS = {
    "python": "if elif else for while return yield await lambda not and or in is def class del raise except with assert import from as async",
    **dict.fromkeys(JS, "if for while switch catch return do else try throw new in typeof delete void instanceof await yield function class var let const import export with super case default extends"),
    "java": "if for while switch catch return do else try throw new instanceof super this synchronized assert case",
    "csharp": "if for foreach while switch catch return do else try throw new in is as typeof sizeof default using lock fixed base this when await out ref case not and or",
    "go": "if for switch return func go defer range select case map chan struct interface var const type else",
    "php": "if elseif else for foreach while switch catch return throw new function fn isset empty array list unset echo print include include_once require require_once exit die match use and or xor as instanceof case",
    "cpp": "if for while switch catch return do else try throw new delete sizeof alignof decltype static_assert noexcept typename template operator case void int char short long float double signed unsigned bool auto",
    "c": "if for while switch return do else sizeof case void int char short long float double signed unsigned",
}
_KEYWORDS = {language: frozenset(words.split()) for language, words in _KEYWORDS.items()}
_TYPED = ("java", "csharp", "c", "cpp")
#: Names whose brackets hold a condition; what follows them is a statement.
_CONTROL = frozenset("if for while switch catch with foreach elseif function".split())
#: Names that may stand before a call; any other name before a name is its type.
_NO_TYPES = frozenset("return else do throw case await in new delete yield and or not is as if while when goto".split())
_CLASS_WORDS = {
    "javascript": ("class",), "typescript": ("class", "interface"), "tsx": ("class", "interface"), "java": ("class", "interface", "enum"), "csharp": ("class", "interface", "struct"),
    "php": ("class", "interface", "trait"), "cpp": ("class", "struct"), "c": (), "go": (),
}
#: Bodies that hold members but are no symbols of their own.
_HOLDERS = {"java": ("record",), "csharp": ("record", "enum", "namespace"), "php": ("enum",), "cpp": ("namespace", "union", "enum", "extern"), "c": ("struct", "union", "enum", "extern"), "go": ("struct", "interface")}
_DOTS = (".", "?.", "->", "?->", "::")
_IMPORTS = {
    "python": re.compile(r"^[ \t]*(?:from[ \t]+([.\w]+)[ \t]+import\b|import[ \t]+([^\n#;]+))", re.M),
    "java": re.compile(r"^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.*]+)", re.M),
    "csharp": re.compile(r"^[ \t]*using[ \t]+(?:static[ \t]+)?(?:\w+[ \t]*=[ \t]*)?([\w.]+)[ \t]*;", re.M),
    "php": re.compile(r"^[ \t]*use[ \t]+([\w\\]+)|\b(?:include|require)(?:_once)?[ \t]*\(?[ \t]*['\"]([^'\"\n]+)['\"]", re.M),
    "c": re.compile(r"^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]", re.M),
}
_IMPORTS["cpp"] = _IMPORTS["c"]
_IMPORTS_JS = re.compile(r"\b(?:import|export)\b[^;'\"()]*?\bfrom\s*['\"]([^'\"\n]+)['\"]|^[ \t]*import\s*['\"]([^'\"\n]+)['\"]|\b(?:require|import)\s*\(\s*['\"]([^'\"\n]+)['\"]", re.M)
_CONTINUED = re.compile(r"[ \t]*\\\r?\n")
_GO_IMPORT = re.compile(r"^import\s*(?:\(([\s\S]*?)\)|(?:[\w.]+\s+)?\"([^\"\n]+)\")", re.M)


def _flat(text: str, first: int, end: int, most: int) -> str:
    """text[first:end] with white space collapsed, cut after ``most`` characters; no more is read than that takes."""
    taken = 4 * most
    while True:
        flat = re.sub(r"\s+", " ", text[first : min(end, first + taken)])
        if len(flat) > most:
            return flat[:most] + "…"
        if first + taken >= end:
            return flat
        taken *= 2


def imports_of(language: str, text: str, tokens: Tokens | None = None) -> list[str]:
    text = without(text, (tokens or read(language, text)).blank)
    if language == "go":
        found = [x for block, one in _GO_IMPORT.findall(text) for x in ([one] if one else re.findall(r'"([^"\n]+)"', block))]
    elif language == "python":
        found = []
        for source, names in _IMPORTS["python"].findall(text):
            found += [source] if source else [n.split(" as ")[0].strip() for n in names.split(",")]
    else:
        pattern = _IMPORTS_JS if language in JS else _IMPORTS[language]
        found = [next(x for x in m if x) if isinstance(m, tuple) else m for m in pattern.findall(text)]
    return [x for x in dict.fromkeys(f.strip() for f in found) if x]


class _Shapes:
    """What the passes over one file's tokens share."""

    def __init__(self, language: str, t: Tokens):
        self.language, self.t, self.n, self.keywords = language, t, len(t), _KEYWORDS[language]
        self.found: list[dict] = []
        #: Names and brackets that belong to definitions and so are no calls.
        self.taken: set[int] = set()
        #: Opening braces of bodies that hold members.
        self.members: set[int] = set()
        self.angle = self._angles()
        self.first = self._firsts()

    def _angles(self) -> dict[int, int]:
        """Pairs of < and > that hold nothing but types."""
        out, held = {}, []
        for i, w in enumerate(self.t.word):
            if w == "<":
                held.append(i)
            elif w == ">":
                if held:
                    o = held.pop()
                    out[o], out[i] = i, o
            elif held and not (self.t.kind[i] == "name" or w in (",", ".", "?", "[", "]", "&", "|", "::", "*")):
                held.clear()
        return out

    def _firsts(self) -> list[int]:
        """For each token the first of its statement or member at its level."""
        out, at = [], {}
        for i, w in enumerate(self.t.word):
            level = self.t.up[i]
            if w == "}" or w == ";" or (w == ":" and self.t.at(i - 1) in ("public", "private", "protected", "default")):
                out.append(at.pop(level, i))
            else:
                out.append(at.setdefault(level, i))
        return out

    def past(self, i: int) -> int:
        """The place after type arguments that start at ``i``."""
        return self.angle[i] + 1 if self.t.at(i) == "<" and i in self.angle else i

    def begins(self, i: int) -> bool:
        """Whether a declaration of JavaScript may start here; elsewhere the same words make an expression."""
        before = self.t.at(i - 1)
        if before in ("", ";", "{", "}", ")", "export", "default", "declare", "else"):
            return True
        return self.t.row[i] != self.t.row[i - 1] and (self.t.kind[i - 1] != "operator" or before == "]") and before not in ("return", "abstract", "new")

    def last_row(self, i: int) -> int:
        return self.t.row[i] + self.t.text.count("\n", self.t.start[i], self.t.end[i])

    def add(self, name: str, kind: str, start: int, end: int, args: int | None = None, nested: bool = True) -> None:
        t = self.t
        signature = _flat(t.text, t.start[args], t.end[t.match[args]], SIGNATURE_CHARS) if args is not None else None
        self.found.append({"name": name, "kind": kind, "start": start, "end": max(start, end), "signature": signature, "nested": nested})

    def body(self, i: int, ends: tuple[str, ...] = (";", "}", ")", "=", "class", "function", "interface")) -> int:
        """The brace that opens a body from ``i`` on, or -1 where the statement ends before."""
        t = self.t
        while i < self.n and t.word[i] not in ends:
            if t.word[i] == "{":
                return i
            i = t.match[i] + 1 if t.word[i] in ("(", "[") and t.match[i] > i else i + 1
        return -1

    def typed_body(self, i: int) -> int:
        """The body after a parameter list, past a type after a colon; -1 if there is none."""
        t = self.t
        if t.at(i) == "{":
            return i
        if t.at(i) != ":":
            return -1
        i += 1
        while i < self.n:
            w = t.word[i]
            if w == "{" and t.at(i - 1) not in (":", "|", "&", "<", ",", "=>", "is", "extends", "?"):
                return i
            if w in (";", "}", ")", "=", "]") or (w == ":" and t.at(i - 1) != "?"):
                return -1
            i = t.match[i] + 1 if w in ("(", "[", "{") and t.match[i] > i else i + 1
        return -1


def _js(s: _Shapes) -> None:
    t = s.t
    stop = _expression_ends(t)
    declared: set[int] = set()
    named: dict[int, int] = {}  # the = of a declaration -> its name
    for i, w in enumerate(t.word):
        before = t.at(i - 1)
        if t.kind[i] == "operator":
            if w == ";":
                declared.discard(t.up[i])
            if w != "=" or not (t.is_name(i - 1) or i in named):
                continue
            v = i + 2 if t.at(i + 1) == "async" and t.at(i + 2) != "=>" else i + 1
            v = s.past(v)
            if t.at(v) == "function":
                p = s.past(next(k for k in range(v + 1, v + 4) if not t.is_name(k) and t.at(k) != "*"))
                end = s.typed_body(t.match[p] + 1) if t.at(p) == "(" and t.match[p] > p else -1
                end = t.match[end] if end >= 0 else -1
            else:
                arrow = v + 1 if t.is_name(v) else -1
                if t.at(v) == "(" and t.match[v] > v:
                    arrow = t.match[v] + 1
                    if t.at(arrow) == ":":
                        while arrow < s.n and t.word[arrow] not in ("=>", ";", "="):
                            arrow = t.match[arrow] + 1 if t.word[arrow] in ("(", "[", "{") and t.match[arrow] > arrow else arrow + 1
                if t.at(arrow) != "=>" or arrow + 1 >= s.n:
                    continue
                end = t.match[arrow + 1] if t.word[arrow + 1] == "{" else stop[arrow + 1]
            if end < 0:
                continue
            name = named.get(i, i - 1)
            start = name
            while start >= 2 and t.word[start - 1] in (".", "?.") and t.is_name(start - 2):
                start -= 2
            level = t.up[i]
            if i not in named and (level in s.members or (t.at(level) == "(" and t.at(t.match[level] + 1) in ("=>", "{", ":"))):
                continue  # a field, or a parameter with a default
            if i in named or t.at(start - 1) != "," or level in declared or t.at(level) == "(":
                s.add(t.word[name], "function", start, end, nested=False)
        elif t.kind[i] != "name" or before in (".", "?."):
            continue
        elif w in ("const", "let", "var"):
            declared.add(t.up[i])
            if t.is_name(i + 1) and t.at(i + 2) == ":":
                k = i + 3
                while k < s.n and t.word[k] not in ("=", ";", "const", "let", "var"):
                    k = t.match[k] + 1 if t.word[k] in ("(", "[", "{") and t.match[k] > k else k + 1
                named[k] = i + 1
        elif w in ("class", "interface") and (w in _CLASS_WORDS[s.language]):
            name = i + 1 if t.is_name(i + 1) and t.word[i + 1] not in ("extends", "implements") else -1
            o = s.body(i + 1 if name < 0 else i + 2)
            if o >= 0:
                s.members.add(o)
                if name >= 0 and s.begins(i):
                    s.add(t.word[name], "class", i, t.match[o])
        elif w == "function":
            j = i + 2 if t.at(i + 1) == "*" else i + 1
            p = s.past(j + 1)
            if t.is_name(j) and t.at(p) == "(" and t.match[p] > p:
                s.taken.update((j, p))
                o = s.typed_body(t.match[p] + 1)
                start = i - 1 if before == "async" else i
                if o >= 0 and s.begins(start):
                    s.add(t.word[j], "function", start, t.match[o], p)
            elif t.at(s.past(j)) == "(":
                s.taken.add(s.past(j))
        elif w not in s.keywords or t.up[i] in s.members:
            p = s.past(i + 1)
            if t.at(p) != "(" or t.match[p] <= p or before in ("new", "function") or (before == "*" and t.at(i - 2) == "function"):
                continue
            o = s.typed_body(t.match[p] + 1)
            if o >= 0:
                start = i
                while start and t.word[start - 1] in ("async", "static", "get", "set", "*", "public", "private", "protected", "readonly", "override") and t.up[start - 1] == t.up[i]:
                    start -= 1
                s.taken.update((i, p))
                s.add(w, "method", start, t.match[o], p)
            elif t.up[i] in s.members and before in ("", ";", "{", "}", ",", "async", "static", "get", "set", "abstract", "public", "private", "protected", "override"):
                s.taken.update((i, p))  # a signature without a body


def _expression_ends(t: Tokens) -> list[int]:
    """For each token the last one of the expression that it starts or continues."""
    n = len(t)
    out = [n - 1] * (n + 1)
    for i in range(n - 1, -1, -1):
        w = t.word[i]
        if w in (",", ";", ")", "]", "}"):
            out[i] = i - 1
            continue
        last = t.match[i] if w in ("(", "[", "{") and t.match[i] >= i else i
        after = last + 1
        # a new line ends it, unless an operator stands before or after the break
        ended = after >= n or (t.row[after] != t.row[last] and t.kind[after] != "operator" and (t.kind[last] != "operator" or t.word[last] in (")", "]", "}")))
        out[i] = last if ended else max(last, out[after])
    return out


def _members(s: _Shapes) -> None:
    """Java, C#, PHP, Go, C and C++: definitions stand where members may, or behind a word of their own."""
    t, language = s.t, s.language
    classes: dict[int, str] = {}
    for i, w in enumerate(t.word):
        if t.kind[i] != "name":
            if w == "{" and t.at(i - 1) == ")" and language in ("java", "php"):  # new Name(...) { members }
                o = t.match[i - 1]
                k = o - 1
                while k >= 1 and (t.word[k] in (".", ">") or t.kind[k] == "name") and t.word[k] != "new":
                    k = s.angle.get(k, k) - 1
                if k >= 0 and t.word[k] == "new":
                    s.members.add(i)
            continue
        before, level = t.at(i - 1), t.up[i]
        if w in _CLASS_WORDS[language] and before not in (".", "::", "->", "enum") and (t.is_name(i + 1) or before == "new"):
            o = s.body(i + 1 if before == "new" else i + 2, (";", "}", ")", "=", *_CLASS_WORDS[language]))
            if o >= 0:
                s.members.add(o)
                if before != "new":
                    classes[o] = t.word[i + 1]
                    s.add(t.word[i + 1], "class", s.first[i] if language != "cpp" else i, t.match[o])
        elif w in _HOLDERS.get(language, ()) and before not in (".", "::", "->"):
            o = s.body(i + 1, (";", "}", ")", "=", "("))
            if o >= 0:
                s.members.add(o)
        elif language in ("go", "php") and w == ("func" if language == "go" else "function"):
            _with_word(s, i)
        elif language in _TYPED and t.at(s.past(i + 1)) == "(" and t.match[s.past(i + 1)] > i and w not in s.keywords:
            _with_type(s, i, classes.get(level))


def _with_word(s: _Shapes, i: int) -> None:
    """``func`` and ``function``."""
    t, go = s.t, s.language == "go"
    j = i + 1
    receiver = go and t.at(j) == "(" and t.match[j] > j
    if receiver:
        s.taken.add(j)
        j = t.match[j] + 1
    elif t.at(j) == "&":
        j += 1
    p = j + 1
    if go and t.at(p) == "[":
        p = t.match[p] + 1
    if not (t.is_name(j) and t.at(p) == "(" and t.match[p] > p):
        s.taken.add(j)
        if go and t.at(t.match[j] + 1) == "(":  # results of a type or literal
            s.taken.add(t.match[j] + 1)
        return
    s.taken.update((j, p))
    o, after = -1, t.match[p] + 1
    if go:
        s.taken.add(after)
        while after < s.n and t.row[after] == t.row[after - 1]:
            if t.word[after] == "{" and t.at(after - 1) not in ("interface", "struct"):
                o = after
                break
            if t.word[after] == "func" and t.is_name(after + 1):
                break
            after = t.match[after] + 1 if t.word[after] in ("(", "[", "{") and t.match[after] > after else after + 1
        end = t.match[o] if o >= 0 else after - 1
    else:
        o = s.body(after, (";", "}", "function"))
        if o < 0 and t.up[i] not in s.members:
            return
        end = t.match[o] if o >= 0 else after
        while o < 0 and end < s.n - 1 and t.word[end] not in (";", "}"):
            end += 1
    s.add(t.word[j], "method" if receiver else "function", s.first[i] if t.up[i] in s.members else i, end, p)


def _with_type(s: _Shapes, i: int, owner: str | None) -> None:
    """A definition that starts with a type: Java, C#, C and C++."""
    t, language = s.t, s.language
    level, before, p = t.up[i], t.at(i - 1), s.past(i + 1)
    c_like = language in ("c", "cpp")
    member = level in s.members or (c_like and level < 0)
    built = t.word[i] == owner
    typed = t.is_name(i - 1) and before not in _NO_TYPES or before in ("]", "?", "*", "&", "::", "~") or (before == ">" and i - 1 in s.angle)
    if not (typed or (built and before not in ("new", ".", "=")) or (c_like and member and before in ("", ";", "}", "{", ":"))):
        return
    if not member and not (language == "csharp" and typed):
        return
    name, start = t.word[i], s.first[i]
    k = t.match[p] + 1
    if c_like:
        head = i
        while t.at(head - 1) == "::" and t.is_name(head - 2) or (t.at(head - 1) == "~"):
            head -= 2 if t.at(head - 1) == "::" else 1
        name = t.text[t.start[head] : t.end[i]]
        while t.at(k) in ("const", "noexcept", "override", "final", "volatile", "&", "&&", "try"):
            k += 1
        if t.at(k) == "->":
            k = max(k, s.body(k + 1, (";", "}", ")", "=")))
        built_with = []
        if t.at(k) == ":":  # initialisers of members
            k += 1
            while t.is_name(k) or t.at(k) in (",", "::", "<"):
                k = s.past(k) if t.at(k) == "<" and k in s.angle else k + 1
                if t.at(k) in ("(", "{") and (t.at(k) == "(" or t.at(t.match[k] + 1) in (",", "{")) and t.match[k] > k:
                    built_with.append(k)
                    k = t.match[k] + 1
        if t.at(k) != "{":
            return
        s.taken.update((i, p, *built_with))
        if name.startswith("~"):
            return
        while t.at(start) == "template" and start + 1 in s.angle:
            start = s.angle[start + 1] + 1
        s.add(name, "function", start, t.match[k])
        return
    if not (t.is_name(k) or t.at(k) in ("{", ";", "=>", ":", "[")):
        return
    end = k
    while end < s.n and t.word[end] not in ("{", ";", "=>", "}", "=") and (t.word[end] != "(" or t.at(end - 1) in ("new", "base", "this")):
        end = t.match[end] + 1 if t.word[end] in ("(", "[") and t.match[end] > end else end + 1
    if t.at(end) not in ("{", ";", "=>") or (not member and t.at(end) == ";"):
        return
    if t.at(k) == ":" and t.at(k + 1) in ("base", "this"):
        s.taken.add(k + 2)
    s.taken.update((i, p))
    if t.word[end] == "=>":
        while end < s.n - 1 and t.word[end] != ";":
            end = t.match[end] + 1 if t.word[end] in ("(", "[", "{") and t.match[end] > end else end + 1
    s.add(name, "method" if member else "function", start, t.match[end] if t.word[end] == "{" else end, p)


def _python(s: _Shapes) -> None:
    """A block ends before the first line outside brackets that is not indented deeper than its head."""
    t, open_ = s.t, []
    for i in range(s.n):
        if t.up[i] >= 0 or (i and t.row[i] == t.row[i - 1]) or (t.kind[i] == "operator" and t.word[i] in (")", "]", "}")):
            continue
        if i and _CONTINUED.match(t.text, t.end[i - 1]):
            continue
        column = t.start[i] - t.text.rfind("\n", 0, t.start[i]) - 1
        while open_ and open_[-1][0] >= column:
            open_.pop()[1]["end"] = i - 1
        k = i + 1 if t.word[i] == "async" else i
        if t.at(k) in ("def", "class") and t.is_name(k + 1):
            p = k + 2
            if t.at(p) == "[":
                p = t.match[p] + 1
            args = p if t.at(p) == "(" and t.word[k] == "def" else None
            s.taken.update((k + 1, p))
            s.add(t.word[k + 1], "class" if t.word[k] == "class" else "function", i, s.n - 1, args)
            open_.append((column, s.found[-1]))


def _chains(s: _Shapes) -> list[int]:
    """For each token the first one of the chain of members, calls and indexes that it continues."""
    t, out = s.t, []
    for i, w in enumerate(t.word):
        before, start = t.at(i - 1), i
        if w in (")", "]") and 0 <= t.match[i] < i:
            o = t.match[i]
            prior = s.angle[o - 1] - 1 if t.at(o - 1) == ">" and o - 1 in s.angle else o - 1
            o_prior = t.match[prior] if t.at(prior) == ")" else -1
            control = 0 < o_prior < prior and out[prior] == o_prior and t.word[o_prior - 1] in _CONTROL  # if (...) (...)
            operand = prior >= 0 and not control and ((t.kind[prior] == "name" and t.word[prior] not in s.keywords) or t.word[prior] in (")", "]") or (t.kind[prior] == "string" and w == ")"))
            start = out[prior] if operand else o
        elif w == "}" and 0 <= t.match[i] < i:
            o = t.match[i]
            start = out[o - 1] if o in s.members and t.at(o - 1) == ")" else o  # new Name(...) { members }
        elif t.kind[i] in ("name", "string"):
            if before in _DOTS and i >= 2:
                k = i - 3 if t.at(i - 2) == "!" else i - 2
                start = out[k] if k >= 0 and (t.kind[k] != "operator" or t.word[k] in (")", "]", "}")) else i - 1
            elif before == "new":
                start = i - 1
        out.append(start)
    return out


def _calls(s: _Shapes) -> list[tuple[int, int, int]]:
    """(first token, last token, callee) of every call, outer ones before those inside."""
    t, language, js = s.t, s.language, s.language in JS
    chain, out = _chains(s), []
    name_before, last = [], -1  # the nearest name up to each token
    for i in range(s.n):
        if t.kind[i] == "name" and t.word[i] not in s.keywords:
            last = i
        name_before.append(last)
    assigned: dict[int, int] = {}  # level -> first token of the statement that has an = there
    for i, w in enumerate(t.word):
        if w in ("=", "=>", ":=") or (w == "return" and t.kind[i] == "name"):
            assigned[t.up[i]] = s.first[i]
        q = i - 1
        if js and t.kind[i] == "string" and t.text[t.start[i] : t.start[i] + 1] == "`" and t.is_name(q) and t.word[q] not in s.keywords and t.end[q] == t.start[i]:
            out.append((chain[q], i, q))
            continue
        if w == "new" and t.kind[i] == "name" and (js or language in ("php", "csharp")) and t.at(i - 1) not in _DOTS:
            k = i + 1
            while t.is_name(k) and t.at(k + 1) in (".", "::", "\\"):
                k += 2
            after = s.past(k + 1)
            if t.is_name(k) and t.word[k] not in ("class", "function") and t.at(after) != "(":
                last = t.match[after] if language == "csharp" and t.at(after) == "{" else k
                out.append((i, last, k))
            continue
        if w != "(" or i in s.taken or q < 0 or t.match[i] <= q:
            continue
        close = t.match[i] if t.match[i] > i else s.n - 1
        callee = s.angle[q] - 1 if t.word[q] == ">" and q in s.angle else q
        if t.is_name(callee):
            if callee in s.taken or (t.word[callee] in s.keywords and t.at(callee - 1) not in _DOTS):
                continue
            start = chain[callee]
            before = t.at(start - 1)
            if js and t.word[callee] == "async" and t.at(close + 1) in ("=>", ":"):
                continue
            if language in ("java", "php") and t.at(start) == "new" and t.at(close + 1) == "{" and close + 1 in s.members:
                close = t.match[close + 1]
            if language in _TYPED and (t.is_name(start - 1) and before not in _NO_TYPES or (t.up[start] < 0 and before in ("*", "&"))) and start == callee:
                continue  # a declaration
            if language == "java" and before == "@" or (language == "go" and before == "]" and start == callee and t.end[start - 1] == t.start[start]):
                continue
            if language == "csharp" and before == "[" and (t.up[start] in s.members or t.up[t.up[start]] in s.members):
                continue
            level = t.up[start]
            if level in s.members and assigned.get(level) != s.first[start]:
                continue  # among members only what is assigned is a call
        elif t.word[q] in (")", "]", "}") and language in (*JS, "python", "go", "php"):
            start, callee = chain[q], name_before[q]
            opener = t.match[q]
            control = t.word[q] == ")" and start == opener and opener > 0 and t.word[opener - 1] in _CONTROL
            if callee < start or control or (t.word[q] == "}" and language != "go") or opener in s.taken or (js and t.row[q] != t.row[i]):
                continue
        else:
            continue
        out.append((start, close, callee))
    return sorted(out, key=lambda c: (t.start[c[0]], -c[1]))


def _innermost(spans: list[tuple[int, int]], rows: list[int]) -> list[int]:
    """For each of the ascending rows the shortest span that holds it, the first of equals, or -1."""
    order, open_, at, out = sorted(range(len(spans)), key=lambda k: spans[k][0]), [], 0, []
    for row in rows:
        while at < len(order) and spans[order[at]][0] <= row:
            first, last = spans[order[at]]
            heapq.heappush(open_, (last - first, order[at], last))
            at += 1
        while open_ and open_[0][2] < row:
            heapq.heappop(open_)
        out.append(open_[0][1] if open_ else -1)
    return out


def extract(language: str, text: str) -> tuple[list[dict], list[dict], list[str]]:
    """Symbols, calls and imports of one file; lines count from 0."""
    t = read(language, text)
    s = _Shapes(language, t)
    (_python if language == "python" else _js if language in JS else _members)(s)
    symbols, ids, around = [], set(), []
    for d in sorted(s.found, key=lambda d: (d["start"], -d["end"])):
        while around and around[-1]["end"] < d["start"]:
            around.pop()
        container = next((c["name"] for c in reversed(around) if c["end"] >= d["end"]), None) if d["nested"] and d["kind"] != "class" else None
        if d["kind"] == "class":
            around.append(d)
        start, end = t.row[d["start"]], s.last_row(d["end"])
        if (d["name"], start) not in ids:
            ids.add((d["name"], start))
            kind = "method" if container and d["kind"] == "function" else d["kind"]
            symbols.append({"name": d["name"], "kind": kind, "container": container, "start_line": start, "end_line": end, "signature": d["signature"]})
    found = _calls(s)
    rows = [t.row[a] for a, _, _ in found]
    owner = _innermost([(x["start_line"], x["end_line"]) for x in symbols], rows)
    calls = []
    for (a, b, callee), row, k in zip(found, rows, owner, strict=True):
        own = symbols[k] if k >= 0 else None
        name = t.word[callee].lstrip("$") if language == "php" else t.word[callee]
        calls.append({"callee": name, "line": row, "from_symbol": own and f"{own['name']}@{own['start_line']}", "text": _flat(t.text, t.start[a], t.end[b], TEXT_CHARS)})
    return symbols, calls, imports_of(language, text, t)


def extract_index(files: DataFrame) -> DataFrame:
    """``files(file, language_id, content)`` with arrays symbols, calls and imports."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for languages, texts in batches:
            yield pd.DataFrame([extract(lang, text or "") for lang, text in zip(languages, texts)], columns=["symbols", "calls", "imports"], dtype=object)

    return files.withColumn("_x", F.pandas_udf(run, SCHEMA)("language_id", "content")).select("*", "_x.symbols", "_x.calls", "_x.imports").drop("_x")


def extract_symbols(indexed: DataFrame) -> DataFrame:
    """IDX-3. One row per symbol, with its id and its place in the file."""
    rows = indexed.select("file", F.posexplode("symbols").alias("sym_seq", "s")).select("file", "sym_seq", "s.*")
    return rows.withColumn("id", F.concat("file", F.lit("#"), "name", F.lit("@"), "start_line"))


def extract_calls(indexed: DataFrame) -> DataFrame:
    """IDX-4. One row per call, with the id of the symbol around it (null at top level)."""
    rows = indexed.select("file", F.posexplode("calls").alias("call_seq", "c")).select("file", "call_seq", "c.*")
    return rows.withColumn("from_symbol", F.concat("file", F.lit("#"), "from_symbol"))


def extract_imports(indexed: DataFrame) -> DataFrame:
    """IDX-5. One row per distinct raw target of a file."""
    return indexed.select("file", F.posexplode("imports").alias("imp_seq", "target"))
