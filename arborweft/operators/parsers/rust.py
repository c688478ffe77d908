"""Rust: modules, functions, structs, enums, traits, implementations, imports and calls."""

from __future__ import annotations

from arborweft.operators.parsers.lexer import ROOT, Records, Scope, Source, common

NOT_CALLS = {"if", "while", "for", "match", "return", "fn", "let", "mut", "in", "as", "where", "move", "loop", "impl", "else", "pub", "ref", "unsafe", "dyn", "break"}


class Rust:
    def __init__(self, path: str, text: str) -> None:
        self.s, self.path, self.out = Source(text, "rust"), path, Records(path)
        s = self.s
        self.local = {s.t[i + 1] for i, x in enumerate(s.t) if x in ("struct", "enum", "trait") and s.is_id(i + 1)}

    def read(self) -> list[dict]:
        scope = Scope(self.path, f"{self.path}::module")
        self.out.node(scope.module_id, "Module", self.path, ROOT, common("rust"))
        self.items(0, len(self.s.t), scope)
        return self.out.rows

    def stop(self, i: int) -> int:
        """The brace or semicolon that ends an item's head."""
        s = self.s
        while i < len(s.t) and s.t[i] not in ("{", ";"):
            i = s.mate[i] + 1 if s.t[i] in "([" else i + 1
        return i

    def begin(self, i: int) -> int:
        """The first token of an item with its visibility and qualifiers."""
        s = self.s
        while True:
            if s.at(i - 1) in ("pub", "async", "const", "unsafe", "default", "extern"):
                i -= 1
            elif s.at(i - 1) == ")" and s.at(s.mate[i - 1] - 1) == "pub":
                i = s.mate[i - 1] - 1
            else:
                return i

    def items(self, i: int, end: int, scope: Scope) -> None:
        s = self.s
        while i < end:
            x = s.t[i]
            if x == "#" and s.at(i + 1) in ("[", "!"):
                i = s.mate[i + 1 + (s.t[i + 1] == "!")] + 1
            elif s.kind[i] == "id" and s.at(i + 1) == "!" and s.at(i + 2) in ("(", "[", "{"):
                i = s.mate[i + 2] + 1  # what a macro gets is no code yet
            elif x == "macro_rules":
                i = s.mate[self.stop(i)] + 1
            elif x == "fn" and s.is_id(i + 1):
                i = self.function(i, scope)
            elif x in ("struct", "enum", "union") and s.is_id(i + 1) and s.at(i + 2) in ("{", ";", "(", "<", "where"):
                i = self.type(i, scope)
            elif x == "trait" and s.is_id(i + 1):
                i = self.block(i, s.t[i + 1], "trait", scope)
            elif x == "impl" and s.at(i - 1) not in (":", "->", "(", ",", "&", "<", "="):
                i = self.implementation(i, scope)
            elif x == "mod" and s.is_id(i + 1):
                i = self.block(i, s.t[i + 1], "module", scope)
            elif x == "use":
                i = self.use(i, scope)
            else:
                if s.at(i + 1) == "(" and s.is_id(i) and x not in NOT_CALLS and s.at(i - 1) != "fn":
                    self.call(i, i, scope)
                elif x == "<" and s.at(i - 1) == "::" and s.at(s.generic_end(i)) == "(":
                    self.call(i - 2, s.generic_end(i) - 1, scope)
                i += 1

    def metadata(self, **more) -> dict:
        return common("rust", **more)

    def function(self, i: int, scope: Scope) -> int:
        s, name, k = self.s, self.s.t[i + 1], self.stop(i)
        if s.at(k) != "{":
            return k + 1  # a signature alone is no function
        fid = scope.id(self.path, "function", name)
        self.out.node(fid, "Function", name, s.place(self.begin(i), s.mate[k]), self.metadata(struct=scope.cls))
        self.out.edge(scope.class_id or scope.module_id, fid, "Contains")
        self.items(k + 1, s.mate[k], scope.but(function=fid))
        return s.mate[k] + 1

    def type(self, i: int, scope: Scope) -> int:
        s, name, k = self.s, self.s.t[i + 1], self.stop(i)
        struct = s.t[i] != "enum"
        tid = scope.id(self.path, "class" if struct else "type", name)
        last = s.mate[k] if s.at(k) == "{" else min(k, len(s.t) - 1)
        self.out.node(tid, "Class" if struct else "Type", name, s.place(self.begin(i), last), self.metadata(kind="struct" if struct else "enum"))
        self.out.edge(scope.module_id, tid, "Contains")
        return last + 1

    def block(self, i: int, name: str, kind: str, scope: Scope) -> int:
        s, k = self.s, self.stop(i)
        bid = scope.id(self.path, kind, name)
        last = s.mate[k] if s.at(k) == "{" else min(k, len(s.t) - 1)
        self.out.node(bid, "Trait" if kind == "trait" else "Module", name, s.place(self.begin(i), last), self.metadata(kind="trait" if kind == "trait" else None))
        self.out.edge(scope.module_id, bid, "Contains")
        if s.at(k) == "{":
            self.items(k + 1, last, scope.but(cls=name, class_id=bid))
        return last + 1

    def implementation(self, i: int, scope: Scope) -> int:
        s, k = self.s, self.stop(i)
        if s.at(k) != "{":
            return k + 1
        head = s.generic_end(i + 1)
        last, depth = k, 0
        for j in range(head, k):
            depth += (s.t[j] == "<") - (s.t[j] == ">")
            if depth == 0 and s.t[j] == "for":
                head = j + 1
            elif depth == 0 and s.t[j] == "where":
                last = j
                break
        name = s.slice(head, last - 1)
        self.items(k + 1, s.mate[k], scope.but(cls=name, class_id=scope.id(self.path, "class", name)))
        return s.mate[k] + 1

    def use(self, i: int, scope: Scope) -> int:
        s, k = self.s, i
        while k < len(s.t) and s.t[k] != ";":
            k += 1
        first = self.begin(i)
        path = s.slice(first, min(k, len(s.t) - 1)).removeprefix("use ").rstrip(";").strip()
        if path:
            iid = f"{self.path}::import:{path.replace('::', '.')}"
            self.out.node(iid, "Import", path, s.place(first, min(k, len(s.t) - 1)), self.metadata(import_path=path, module_id=scope.module_id))
        return k + 1

    def call(self, i: int, last: int, scope: Scope) -> None:
        s = self.s
        if not scope.function:
            return
        whole = s.slice(s.expression_start(i), last)
        name = whole.split("::")[-1]
        qualifier = whole.rsplit("::", 1)[0] if "::" in whole else None
        simple = qualifier.split("::")[-1] if qualifier else ""
        if name and not (simple[:1].isupper() and simple not in self.local):
            self.out.call(scope.function, name, {"full_call": whole} | ({"qualifier": qualifier} if qualifier is not None else {}))


def read_rust(path: str, text: str) -> list[dict]:
    return Rust(path, text).read()
