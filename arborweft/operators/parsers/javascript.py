"""JavaScript (and what TypeScript and JSX share with it): functions, classes, object literals and calls."""

from __future__ import annotations

from arborweft.operators.parsers.lexer import ROOT, Records, Scope, Source, common

NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "super", "new", "with", "import", "of", "in", "do", "else", "void", "delete", "yield", "case", "throw", "async", "constructor"}
ACCESS = {"static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "declare", "abstract"}


class JavaScript:
    def __init__(self, path: str, text: str) -> None:
        self.s, self.path, self.out = Source(text, "javascript"), path, Records(path)
        self.symbols: dict[str, str] = {}

    def read(self) -> list[dict]:
        scope = Scope(self.path, f"{self.path}::module")
        self.out.node(scope.module_id, "Js", self.path, ROOT, common("javascript"))
        self.fields()
        self.code(0, len(self.s.t), scope)
        return self.out.rows

    def fields(self) -> None:
        """Types of class fields that are set to ``new T(...)``."""
        s = self.s
        for i, x in enumerate(s.t):
            if x == "class":
                j = i
                while j < len(s.t) and s.t[j] != "{":
                    j += 1
                k, end = j + 1, s.mate[j] if j < len(s.t) else 0
                while k < end:
                    if s.is_id(k) and s.at(k + 1) == "=" and s.at(k + 2) == "new":
                        m = k + 3
                        while m < end and s.t[m] not in ("(", ";"):
                            m += 1
                        self.symbols[s.t[k].lstrip("#")] = self.symbols[s.t[k]] = s.slice(k + 3, m - 1)
                    k = s.mate[k] + 1 if s.t[k] in "({[" else k + 1

    def function(self, name: str, first: int, last: int, scope: Scope, **more) -> Scope:
        fid = scope.id(self.path, "function", name)
        self.out.node(fid, "Function", name, self.s.place(first, last), common("javascript", module=scope.module, class_=scope.cls, **more))
        return scope.but(function=fid)

    def arrow_at(self, i: int) -> int:
        """The place of => of an arrow function that begins at i, or -1."""
        s = self.s
        if s.at(i) == "async" and s.at(i + 1) != "=>":
            i += 1
        if s.is_id(i) and s.at(i + 1) == "=>":
            return i + 1
        if s.at(i) == "(":
            j = s.mate[i] + 1
            if s.at(j) == ":":
                while j < len(s.t) and s.t[j] not in ("=>", "{", ";", ",", ")"):
                    j += 1
            if s.at(j) == "=>":
                return j
        return -1

    def body_end(self, i: int, end: int) -> int:
        """The last token of an arrow's body that begins at i."""
        s = self.s
        if s.at(i) == "{":
            return s.mate[i]
        k = i
        while k < end and s.t[k] not in (",", ";", ")", "]", "}"):
            k = s.mate[k] + 1 if s.t[k] in "([{" else k + 1
        return max(i, k - 1)

    def arrow(self, i: int, mark: int, end: int, scope: Scope) -> int:
        s, last = self.s, self.body_end(mark + 1, end)
        inner = self.function(f"anonymous_{s.row(i)}", i, last, scope)
        if scope.function:
            self.out.edge(scope.function, inner.function, "Contains")
        elif scope.module_id:
            self.out.edge(scope.module_id, inner.function, "Contains")
        if s.at(mark + 1) == "{":
            self.code(mark + 2, last, inner)
        else:
            self.code(mark + 1, last + 1, inner)
        return last + 1

    def callable_end(self, i: int) -> tuple[int, int]:
        """For a function whose parameters begin at or after i: its opening brace and its last token."""
        s = self.s
        while i < len(s.t) and s.t[i] not in ("(", "{", ";"):
            i += 1
        if s.at(i) == "(":
            i = s.mate[i] + 1
        while i < len(s.t) and s.t[i] not in ("{", ";", "}"):
            i += 1
        return (i, s.mate[i]) if s.at(i) == "{" else (-1, i)

    def code(self, i: int, end: int, scope: Scope, in_object: bool = False) -> None:
        s = self.s
        while i < end:
            x, before = s.t[i], s.at(i - 1)
            starts = before in ("", ";", "{", "}", ")", "export", "default", "async", "abstract") or s.row(i) > s.row(i - 1)
            if x == "class" and s.is_id(i + 1) and before not in ("=", "(", "return", ":", ",", "."):
                i = self.klass(i, scope)
            elif x == "function" and before != ".":
                i = self.declared(i, scope) if starts and (s.is_id(i + 1) or s.at(i + 2) == "(" and s.at(i + 1) == "*") or s.is_id(i + 2) and s.at(i + 1) == "*" else self.expression(i, scope)
            elif in_object and before in ("{", ",") and (j := self.member(i, end, scope)):
                i = j
            elif s.is_id(i) and s.at(i + 1) == "=" and s.at(i + 2) == "{" and before in ("const", "let", "var", ","):
                i = self.object(i, scope)
            elif (x == "(" or s.is_id(i)) and before != "." and (mark := self.arrow_at(i)) > 0:
                i = self.arrow(i, mark, end, scope)
            else:
                if s.at(i + 1) == "(" and s.is_id(i) and x not in NOT_CALLS and before != "new" and before != "function":
                    self.call(i, scope)
                if x == "{" and (before in ("=", "(", ",", ":", "return", "[", "?") and s.at(i + 1) != "}"):
                    self.code(i + 1, s.mate[i], scope, in_object=True)
                    i = s.mate[i]
                i += 1

    def declared(self, i: int, scope: Scope) -> int:
        s = self.s
        k = i + 1 + (s.at(i + 1) == "*")
        brace, last = self.callable_end(k + 1)
        inner = self.function(s.t[k], i, last, scope)
        self.out.edge(scope.function or scope.module_id, inner.function, "Contains")
        if brace > 0:
            self.code(brace + 1, last, inner)
        return last + 1

    def expression(self, i: int, scope: Scope) -> int:
        brace, last = self.callable_end(i + 1)
        if brace > 0:
            self.code(brace + 1, last, scope)
        return last + 1

    def object(self, i: int, scope: Scope) -> int:
        s, name = self.s, self.s.t[i]
        oid = scope.id(self.path, "object", name)
        self.out.node(oid, "Module", name, s.place(i, s.mate[i + 2]), common("javascript", object_literal="true", module=scope.module))
        self.out.edge(scope.module_id, oid, "Contains")
        self.code(i + 3, s.mate[i + 2], scope.but(cls=name, class_id=oid), in_object=True)
        return s.mate[i + 2] + 1

    def member(self, i: int, end: int, scope: Scope) -> int:
        """A function-valued pair or a shorthand method of an object literal; 0 for anything else."""
        s, k = self.s, i
        if (s.is_id(k) or s.kind[k] == "text") and s.at(k + 1) == ":":
            v = k + 2
            mark = self.arrow_at(v)
            f = v + (s.at(v) == "async")
            if mark < 0 and s.at(f) != "function":
                return 0
            last = self.body_end(mark + 1, end) if mark > 0 else self.callable_end(f + 1)[1]
            inner = self.function(s.t[k], k, last, scope, object_method="true", object=scope.cls)
            if scope.class_id:
                self.out.edge(scope.class_id, inner.function, "Defines")
            else:
                self.out.edge(scope.module_id, inner.function, "Contains")
            return self.arrow(v, mark, end, inner) if mark > 0 else self.expression(f, inner)
        while s.at(k) in ACCESS | {"*"} and s.at(k + 1) not in ("(", ":", ","):
            k += 1
        if s.is_id(k) and s.at(k + 1) == "(" and s.at(s.mate[k + 1] + 1) == "{":
            return self.method(i, k, scope)
        return 0

    def method(self, i: int, k: int, scope: Scope) -> int:
        s = self.s
        brace, last = self.callable_end(k + 1)
        inner = self.function(s.t[k], i, last, scope)
        self.out.edge(scope.class_id or scope.module_id, inner.function, "Contains")
        if brace > 0:
            self.code(brace + 1, last, inner)
        return last + 1

    def klass(self, i: int, scope: Scope) -> int:
        s, name = self.s, self.s.t[i + 1]
        cid = scope.id(self.path, "class", name)
        metadata, k, word, interfaces = common("javascript"), s.generic_end(i + 2), None, []
        while k < len(s.t) and s.t[k] != "{":
            if s.t[k] in ("extends", "implements"):
                word = s.t[k]
            elif word == "extends" and s.is_id(k) and "superclass" not in metadata and s.at(k + 1) not in (".", "("):
                metadata["superclass"] = s.t[k]
            elif word == "implements" and s.is_id(k):
                interfaces.append(s.t[k])
            k = max(s.generic_end(k), k + 1)
        if interfaces:
            metadata["interfaces"] = ",".join(interfaces)
        last = s.mate[k] if k < len(s.t) else len(s.t) - 1
        self.out.node(cid, "Class", name, s.place(i, last), metadata)
        self.out.edge(scope.module_id, cid, "Contains")
        inner, k = scope.but(cls=name, class_id=cid), k + 1
        while k < last:
            start = k
            while s.at(k)[:1] == "@":
                k += 1
                if s.at(k) == "(":
                    k = s.mate[k] + 1
            while s.at(k) in ACCESS | {"*"} and s.at(k + 1) not in ("(", "=", ";", ":"):
                k += 1
            p = s.generic_end(k + 1)
            if (s.is_id(k) or s.kind[k] == "text") and s.at(p) == "(":
                k = self.method(start, k, inner)
            else:
                stop = k
                while stop < last and s.t[stop] != ";" and not (stop > k and s.row(stop) > s.row(stop - 1) and s.is_id(stop) and s.t[stop - 1] not in ("=", ",", ".", "=>", "&", "|", "+", "?", ":")):
                    stop = s.mate[stop] + 1 if s.t[stop] in "({[" else stop + 1
                self.code(k + 1, stop, inner)
                k = max(stop + (s.at(stop) == ";"), start + 1)
        return last + 1

    def call(self, i: int, scope: Scope) -> None:
        s = self.s
        if not scope.function:
            return
        whole = s.slice(s.expression_start(i), i)
        parts = whole.split(".")
        metadata: dict[str, str] = {}
        if len(parts) > 1 and parts[-2] != "this":
            metadata["object"] = parts[-2]
            if parts[-2] in self.symbols:
                metadata["object_type"] = self.symbols[parts[-2]]
        self.out.call(scope.function, parts[-1], metadata)


def read_javascript(path: str, text: str) -> list[dict]:
    return JavaScript(path, text).read()
