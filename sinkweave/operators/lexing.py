"""One pass over a source file: tokens, matching brackets, and the places of comments and long strings.

The lexer has modes. In code it reads names, numbers, strings and operators; a template (JavaScript's
back-ticks, Python's and C#'s interpolated strings, PHP's double quotes and heredocs) is a mode of its
own, whose holes are code again, to any depth. Each character is read once, brackets are matched by one
stack as they come, and what never closes ends with the file, so a file of any shape takes linear time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

JS = ("javascript", "typescript", "tsx")
_LINE, _BLOCK = r"//[^\n]*", r"/\*[\s\S]*?(?:\*/|\Z)"
_PLAIN = r'"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?'
_OPERATORS = r"=>|===|!==|==|!=|<=|>=|\?\?=|\|\|=|&&=|[-+*/%&|^]=|:=|\?->|->|\?\.(?!\d)|::|\.\.\.|&&|\|\||\?\?|\+\+|--|[^\s\w]"
#: Per language: comments, strings without holes, strings with holes, lines that are no code.
_COMMENTS = {"python": r"#[^\n]*", "php": rf"{_LINE}|#(?!\[)[^\n]*|{_BLOCK}"}
_STRINGS = {
    "python": r'(?<!\w)[rRbBuU]{0,2}(?:"""(?:\\[\s\S]|[^\\])*?(?:"""|\Z)|\'\'\'(?:\\[\s\S]|[^\\])*?(?:\'\'\'|\Z))|(?<!\w)[rRbBuU]{0,2}(?:' + _PLAIN + ")",
    "php": r"'(?:\\[\s\S]|[^'\\])*'?", "go": r"`[^`]*`?|" + _PLAIN, "java": r'"""(?:\\[\s\S]|[^\\])*?(?:"""|\Z)|' + _PLAIN,
    "cpp": r'\bu?8?[LUR]*R"(?P<raw>[^()\s\\]{0,16})\([\s\S]*?\)(?P=raw)"|' + _PLAIN, "csharp": r'@"(?:""|[^"])*"?|"""[\s\S]*?(?:"""|\Z)|' + _PLAIN,
}
_HOLED = {
    "python": r"(?<!\w)[rR]?[fF][rR]?(?:\"\"\"|'''|\"|')", "php": r'"|<<<[ \t]*(?:"?)(?P<label>[A-Za-z_]\w*)(?:"?)(?=\r?\n)', "csharp": r'\$+"""|\$@"|@\$"|\$"',
    **dict.fromkeys(JS, "`"),
}
_PREPROCESSOR = r"(?m:^)[ \t]*#(?:\\\r?\n|[^\n])*"
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
_CLOSER = {"(": ")", "[": "]", "{": "}"}
#: Names after which a slash starts a regular expression and a bracket is no call.
OPERATOR_NAMES = frozenset("return typeof case in of delete void instanceof do else throw new await yield not and or if elif while lambda is assert".split())


def _master(language: str) -> re.Pattern:
    parts = [
        ("skipped", _PREPROCESSOR if language in ("c", "cpp", "csharp") else ""), ("space", r"\n|[^\S\n]+|\\\r?\n"), ("comment", _COMMENTS.get(language, rf"{_LINE}|{_BLOCK}")),
        ("outside", r"\?>[\s\S]*?(?:<\?(?:php\b|=)?|\Z)" if language == "php" else ""), ("nowdoc", r"<<<[ \t]*'(?P<now>[A-Za-z_]\w*)'[\s\S]*?\n[ \t]*(?P=now)\b" if language == "php" else ""),
        ("holed", _HOLED.get(language, "")), ("string", _STRINGS.get(language, _PLAIN)), ("name", r"[$#]?[^\W\d](?:\w|\$)*|\$+" if language in JS else r"\$*[^\W\d]\w*"), ("number", r"\d[\w.]*"), ("operator", _OPERATORS),
    ]
    return re.compile("|".join(f"(?P<{name}>{p})" for name, p in parts if p))


_MASTER: dict[str, re.Pattern] = {}


def _template(language: str, opener: str, label: str | None) -> re.Pattern:
    """What can follow inside a template: an escape, its end, or a hole."""
    if language in JS:
        return re.compile(r"(?P<esc>\\[\s\S])|(?P<end>`)|(?P<hole>\$\{)")
    if language == "php":
        end = rf"\n[ \t]*{label}\b" if label else '"'
        return re.compile(rf"(?P<esc>\\[\s\S])|(?P<end>{end})|(?P<hole>\{{(?=\$))")
    quote = re.search(r"\"\"\"|'''|\"|'", opener)[0]
    escape = '""' if "@" in opener else "(?!)" if language == "csharp" and len(quote) == 3 else r"\\[\s\S]"
    end = quote if len(quote) == 3 or "@" in opener else rf"{quote}|(?=\n)"
    return re.compile(rf"(?P<esc>{escape}|\{{\{{|\}}\}})|(?P<end>{end})|(?P<hole>\{{)")


_FORMAT = re.compile(r"(?P<esc>(?!))|(?P<end>\}|(?=\n))|(?P<hole>\{)")


@dataclass
class Tokens:
    """``word`` is the text of names and operators ('' for others), ``kind`` one of name, number, string,
    operator; ``match`` leads from a bracket to its partner, ``up`` to the bracket around."""

    text: str
    kind: list[str] = field(default_factory=list)
    word: list[str] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    match: list[int] = field(default_factory=list)
    up: list[int] = field(default_factory=list)
    blank: list[tuple[int, int]] = field(default_factory=list)
    row: list[int] = field(default_factory=list)
    n_rows: int = 1

    def __len__(self) -> int:
        return len(self.word)

    def at(self, i: int) -> str:
        return self.word[i] if 0 <= i < len(self.word) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.word) and self.kind[i] == "name"


def read(language: str, text: str) -> Tokens:
    """The tokens of one file."""
    t = Tokens(text)
    master = _MASTER.get(language) or _MASTER.setdefault(language, _master(language))
    opened: list[int] = []
    waiting = dict.fromkeys("([{", 0)
    # code: [None, open brackets, None]; template: [pattern, its token, None]
    modes: list[list] = [[None, 0, -1]]
    at, n = 0, len(text)

    def put(kind: str, word: str, start: int, end: int) -> int:
        t.kind.append(kind)
        t.word.append(word)
        t.start.append(start)
        t.end.append(end)
        t.match.append(-1)
        t.up.append(opened[-1] if opened else -1)
        return len(t.word) - 1

    def bracket(word: str, start: int, end: int) -> None:
        if word in _CLOSER:
            opened.append(put("operator", word, start, end))
            waiting[word] += 1
            return
        pair = {")": "(", "]": "[", "}": "{"}[word]
        if waiting[pair]:
            while True:  # what is still open inside ends here
                o = opened.pop()
                waiting[t.word[o]] -= 1
                if t.word[o] == pair:
                    break
                t.match[o] = len(t.word) - 1
            i = put("operator", word, start, end)
            t.match[i], t.match[o] = o, i
        else:
            put("operator", word, start, end)

    if language == "php":
        m = re.compile(r"<\?(?:php\b|=)?").search(text)
        at = m.end() if m else 0  # a fragment without any tag is code
    while at < n:
        mode = modes[-1]
        if mode[0] is not None:  # inside a template
            m = mode[0].search(text, at)
            if not m:
                t.end[mode[1]] = at = n
            elif m.lastgroup == "esc":
                at = m.end()
            elif m.lastgroup == "hole":
                bracket("{", m.end() - 1, m.end())
                modes.append([None, 0, len(modes)])
                at = m.end()
            else:
                modes.pop()
                at = m.end()
                if mode[0] is _FORMAT:
                    bracket("}", m.start(), m.end())
                    modes.pop()  # the hole whose format it was
                else:
                    t.end[mode[1]] = at
                    t.blank.append((t.start[mode[1]], at))
            continue
        m = master.match(text, at)
        if not m:
            at += 1
            continue
        group, start, at = m.lastgroup, at, m.end()
        group = {"label": "holed", "now": "nowdoc", "raw": "string"}.get(group, group)
        if group == "comment" or group == "nowdoc":
            t.blank.append((start, at))
        elif group == "holed":
            modes.append([_template(language, m[0], m.groupdict().get("label")), put("string", "", start, at), None])
        elif group == "string":
            put("string", "", start, at)
            if "\n" in m[0]:
                t.blank.append((start, at))
        elif group in ("name", "number"):
            put(group, m[0] if group == "name" else "", start, at)
        elif group == "operator":
            word, last = m[0], len(t.word) - 1
            if word[0] == "/" and language in JS and (last < 0 or not (t.kind[last] in ("number", "string") or t.word[last] in (")", "]", "}") or (t.kind[last] == "name" and t.word[last] not in OPERATOR_NAMES))):
                literal = _REGEX.match(text, start)
                if literal:
                    at = literal.end()
                    put("string", "", start, at)
                    continue
            in_hole = mode[2] > 0 and not mode[1]
            if word in _CLOSER:
                mode[1] += 1
                bracket(word, start, at)
            elif word in (")", "]", "}"):
                bracket(word, start, at)
                if in_hole and word == "}":
                    modes.pop()
                else:
                    mode[1] = max(0, mode[1] - 1)
            elif in_hole and word in (":", "!", ":=") and language in ("python", "csharp"):
                modes.append([_FORMAT, len(t.word) - 1, None])
            else:
                put("operator", word, start, at)
    for o in opened:
        t.match[o] = len(t.word) - 1
    breaks = np.array([m.start() for m in re.finditer("\n", text)])
    t.row = np.searchsorted(breaks, np.array(t.start, dtype=np.int64)).tolist()
    t.n_rows = len(breaks) + 1
    return t


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with the spans blanked, lines kept."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], re.sub(r"[^\n]", " ", text[a:b])]
            at = b
    return "".join([*out, text[at:]])
