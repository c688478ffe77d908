"""Tokens of curly-brace languages, with matched brackets and byte positions."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

_COMMON = r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"
_TAIL = r"|(?P<num>\d[\w.]*)|(?P<id>[^\W\d][\w$]*|[$@#][\w$]+)|(?P<op>::|->|=>|\.\.\.|[^\s\w])"
_STRING = r'(?P<text>"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"?'
LEXERS = {
    "java": re.compile(_COMMON + "|" + _STRING + r"|'(?:\\.|[^'\\\n])*'?)" + _TAIL, re.S),
    "rust": re.compile(_COMMON + r'|(?P<text>b?r(?P<h>\#*)".*?"(?P=h)|b?"(?:\\.|[^"\\])*"?|b?\'(?:\\[^\n\']*|[^\\\'\n])\'|\'[^\W\d]\w*)' + _TAIL, re.S),
    "javascript": re.compile(_COMMON + "|" + _STRING + r"|'(?:\\.|[^'\\\n])*'?)" + _TAIL, re.S),
}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
_BEFORE_REGEX = {"(", ",", "=", ":", "[", "!", "&", "|", "?", "{", "}", ";", "=>", "return", "typeof", "case", "in", "of", "+", "-", "*", "<", ">"}
CLOSE = {")": "(", "]": "[", "}": "{"}


@dataclass
class Source:
    """A text as tokens: t (their text), kind, begin, end (offsets), mate (index of the other bracket, or of the last token)."""

    text: str
    language: str
    t: list[str] = field(default_factory=list)
    kind: list[str] = field(default_factory=list)
    begin: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    mate: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._lex()
        self._match()
        self.lines = [0] + [i + 1 for i, c in enumerate(self.text) if c == "\n"]

    def _add(self, kind: str, begin: int, end: int) -> None:
        self.t.append(self.text[begin:end])
        self.kind.append(kind)
        self.begin.append(begin)
        self.end.append(end)

    def _template(self, at: int) -> int:
        """The end of a template literal; ${...} may nest."""
        i = at + 1
        while i < len(self.text):
            c = self.text[i]
            if c == "\\":
                i += 2
            elif c == "`":
                return i + 1
            elif self.text.startswith("${", i):
                depth, i = 1, i + 2
                while i < len(self.text) and depth:
                    if self.text[i] == "`":
                        i = self._template(i)
                        continue
                    depth += (self.text[i] == "{") - (self.text[i] == "}")
                    i += 1
            else:
                i += 1
        return len(self.text)

    def _lex(self) -> None:
        lexer, at, js = LEXERS[self.language], 0, self.language == "javascript"
        while at < len(self.text):
            if js and self.text[at] == "`":
                end = self._template(at)
                self._add("text", at, end)
                at = end
                continue
            if js and self.text[at] == "/" and (not self.t or self.t[-1] in _BEFORE_REGEX) and (m := _REGEX.match(self.text, at)):
                self._add("text", at, m.end())
                at = m.end()
                continue
            m = lexer.match(self.text, at)
            if m is None:
                at += 1
                continue
            kind = "text" if m.lastgroup == "h" else m.lastgroup
            if m.group("text") is not None:
                kind = "text"
            if kind not in ("space", "comment"):
                self._add(kind, at, m.end())
            at = m.end()

    def _match(self) -> None:
        n = len(self.t)
        self.mate = [n - 1] * n
        open_: list[int] = []
        for i, x in enumerate(self.t):
            if self.kind[i] != "op":
                continue
            if x in "([{":
                open_.append(i)
            elif x in CLOSE:
                while open_ and self.t[open_[-1]] != CLOSE[x]:
                    open_.pop()
                if open_:
                    j = open_.pop()
                    self.mate[i], self.mate[j] = j, i
                else:
                    self.mate[i] = i

    def at(self, i: int) -> str:
        return self.t[i] if 0 <= i < len(self.t) else ""

    def is_id(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.kind[i] == "id"

    def slice(self, i: int, j: int) -> str:
        """The text from token i to token j, both included."""
        return self.text[self.begin[i] : self.end[j]] if i <= j and j < len(self.t) else ""

    def place(self, i: int, j: int) -> tuple[int, int, int, int]:
        """Start and end line and column, all from 1; columns count bytes."""
        out = []
        for offset in (self.begin[i], self.end[min(j, len(self.t) - 1)]):
            row = bisect_right(self.lines, offset) - 1
            out += [row + 1, len(self.text[self.lines[row] : offset].encode("utf-8", "replace")) + 1]
        return tuple(out)

    def row(self, i: int) -> int:
        return bisect_right(self.lines, self.begin[i]) - 1

    def generic_end(self, i: int) -> int:
        """The token after <...> that opens at i; i itself where nothing opens."""
        if self.at(i) != "<":
            return i
        depth = 0
        while i < len(self.t):
            x = self.t[i]
            if x == "<":
                depth += 1
            elif x == ">":
                depth -= 1
                if depth == 0:
                    return i + 1
            elif x in ("(", "["):
                i = self.mate[i]
            elif x in (";", "{", "}") or (x in (")", "]")):
                return i
            i += 1
        return i

    def expression_start(self, i: int) -> int:
        """The first token of the member chain that ends at token i."""
        while True:
            x = self.at(i)
            if x in (")", "]"):
                j = self.mate[i]
                if self.is_id(j - 1) and self.at(j - 1) not in ("return", "if", "while", "for", "switch", "case", "await", "throw", "in"):
                    i = j - 1
                elif self.at(j - 1) in (")", "]"):
                    i = j - 1
                    continue
                else:
                    i = j
            before = self.at(i - 1)
            if before in (".", "::") or (before == "?" and self.at(i) == "."):
                i -= 2
                if self.at(i) == "?":
                    i -= 1
            elif before == "new":
                return i - 1
            else:
                return i


@dataclass
class Scope:
    """What surrounds a declaration. Entering a scope gives a changed copy."""

    module: str | None = None
    module_id: str | None = None
    package: str | None = None
    package_id: str | None = None
    cls: str | None = None
    class_id: str | None = None
    function: str | None = None

    def but(self, **changes) -> Scope:
        return Scope(**(self.__dict__ | changes))

    def id(self, file: str, kind: str, name: str) -> str:
        return "::".join([file, *(x for x in (self.package, self.cls) if x), f"{kind}:{name}"])


ROOT = (1, 1, 1, 1)


class Records:
    """Extraction records of one file, in order."""

    def __init__(self, file: str) -> None:
        self.file, self.rows, self.ids = file, [], set()

    def node(self, id_: str, kind: str, name: str, place, metadata: dict, file_path: str | None = None) -> None:
        self.ids.add(id_)
        self.rows.append({"rec": "node", "id": id_, "kind": kind, "name": name, "file_path": self.file if file_path is None else file_path, "location": place, "metadata": metadata})

    def edge(self, src: str, dst: str, relation: str, metadata: dict | None = None) -> None:
        self.rows.append({"rec": "edge", "src": src, "dst": dst, "relation": relation, "metadata": metadata or {}})

    def call(self, caller: str, method: str, metadata: dict) -> None:
        self.rows.append({"rec": "call", "src": caller, "dst": f"temp_call:{method}", "relation": "Calls", "metadata": {"method_name": method} | metadata})


def common(language: str, **more) -> dict:
    return {"language": language, "extractor": "hierarchical"} | {k.rstrip("_"): v for k, v in more.items() if v is not None}
