"""Java: packages, imports, types, methods, fields, locals, parameters and calls."""

from __future__ import annotations

from arborweft.operators.parsers.lexer import ROOT, Records, Scope, Source, common

MODIFIERS = {
    "public", "private", "protected", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed", "non",
}
NOT_CALLS = {"if", "for", "while", "switch", "catch", "synchronized", "return", "try", "super", "this", "new", "assert", "throw", "do", "else"}
NOT_TYPES = NOT_CALLS | {"package", "import", "case", "instanceof", "break", "continue", "yield", "finally"}


class Java:
    def __init__(self, path: str, text: str) -> None:
        self.s, self.path, self.out = Source(text, "java"), path, Records(path)
        self.symbols: dict[str, str] = {}
        self.imports: list[str] = []
        self.classes: list[str] = []
        self.superclass: dict[str, str] = {}
        self.learning = True  # the first walk fills the symbol table, the second emits

    def read(self) -> list[dict]:
        scope = Scope(self.path, f"{self.path}::module")
        self.out.node(scope.module_id, "Module", self.path, ROOT, common("java"))
        body = self.head(scope)
        start, scope = body
        self.members(start, len(self.s.t), scope)
        self.learning, self.classes = False, []
        self.members(start, len(self.s.t), scope)
        self.class_imports()
        return self.out.rows

    def head(self, scope: Scope) -> tuple[int, Scope]:
        s, i = self.s, 0
        while i < len(s.t):
            k = self.modifiers(i)
            if s.at(k) == "package":
                j = self.find(k, ";")
                name = "".join(s.t[k + 1 : j])
                pid = f"{self.path}::package:{name}"
                self.out.node(pid, "Package", name, s.place(k, j), common("java", module=self.path))
                self.out.edge(scope.module_id, pid, "Contains")
                scope, i = scope.but(package=name, package_id=pid), j + 1
            elif s.at(i) == "import":
                j = self.find(i, ";")
                static = s.at(i + 1) == "static"
                path = "".join(s.t[i + 1 + static : j])
                metadata = common("java", import_path=path, module_id=scope.module_id, is_static="true" if static else None)
                iid = f"{self.path}::import:{path}"
                self.out.node(iid, "Import", path, s.place(i, j), metadata)
                self.out.edge(scope.module_id, iid, "Contains")
                self.imports.append(path)
                i = j + 1
            elif s.at(i) == ";":
                i += 1
            else:
                break
        return i, scope

    def find(self, i: int, mark: str) -> int:
        while i < len(self.s.t) and self.s.t[i] != mark:
            i += 1
        return i

    def modifiers(self, i: int) -> int:
        s = self.s
        while i < len(s.t):
            x = s.t[i]
            if x[0] == "@" and x != "@interface":
                i += 1
                while s.at(i) == "." and s.is_id(i + 1):
                    i += 2
                if s.at(i) == "(":
                    i = s.mate[i] + 1
            elif x in MODIFIERS:
                i += 3 if x == "non" and s.at(i + 1) == "-" else 1
            else:
                break
        return i

    def type_end(self, i: int) -> int:
        """The token after a type that begins at i; i where none does."""
        s = self.s
        if not s.is_id(i) or s.t[i] in NOT_TYPES:
            return i
        i = s.generic_end(i + 1)
        while s.at(i) == "." and s.is_id(i + 1):
            i = s.generic_end(i + 2)
        while s.at(i) == "[" and s.at(i + 1) == "]":
            i += 2
        return i

    def qualified(self, name: str, package: str | None) -> str:
        if "." in name:
            return name
        fits = [p for p in self.imports if p.endswith(f".{name}")]
        return min(fits) if fits else f"{package}.{name}" if package else name

    def members(self, i: int, end: int, scope: Scope) -> None:
        s = self.s
        while i < end:
            start, k = i, self.modifiers(i)
            x = s.at(k)
            if x in ("class", "interface") and s.is_id(k + 1):
                i = self.type(start, k, scope)
            elif (x in ("enum", "record", "@interface")) and s.is_id(k + 1):
                i = self.transparent(k, scope)
            elif x == "{":
                self.statements(k + 1, s.mate[k], scope)
                i = s.mate[k] + 1
            elif k >= end:
                break
            else:
                i = max(self.member(start, k, end, scope), start + 1)

    def transparent(self, k: int, scope: Scope) -> int:
        """Enums, records and annotation types: no node, their members belong to what is around."""
        s, i = self.s, k + 2
        i = s.generic_end(i)
        if s.at(i) == "(":
            i = s.mate[i] + 1
        while i < len(s.t) and s.t[i] not in ("{", ";"):
            i += 1
        if s.at(i) != "{":
            return i + 1
        body, end = i + 1, s.mate[i]
        if s.t[k] == "enum":
            while body < end and s.t[body] != ";":
                body = s.mate[body] + 1 if s.t[body] in "({[" else body + 1
        self.members(body, end, scope)
        return end + 1

    def type(self, start: int, k: int, scope: Scope) -> int:
        s, name = self.s, self.s.t[k + 1]
        i = s.generic_end(k + 2)
        heads: dict[str, list[str]] = {}
        word = None
        while i < len(s.t) and s.t[i] not in ("{", ";"):
            if s.t[i] in ("extends", "implements", "permits"):
                word = s.t[i]
                heads[word] = []
                i += 1
                continue
            j = self.type_end(i)
            if j > i and word:
                heads[word].append(s.slice(i, j - 1))
            i = max(j, i + 1)
        if s.at(i) != "{":
            return i + 1
        end = s.mate[i]
        tid = f"{scope.package}.{name}" if scope.package else name
        metadata = common("java", module=scope.module, package=scope.package, qualified_name=tid if scope.package else None)
        plain = s.t[k] == "class"
        if plain and heads.get("extends"):
            simple = heads["extends"][0]
            metadata |= {"superclass": self.qualified(simple, scope.package), "superclass_simple": simple}
            self.superclass[tid] = metadata["superclass"]
        names = [x for x in heads.get("implements", []) if "<" not in x and "." not in x]
        if plain and names:
            metadata |= {"interfaces": ",".join(names), "interfaces_fqn": ",".join(self.qualified(x, scope.package) for x in names)}
        if not self.learning:
            self.out.node(tid, "Class" if plain else "Interface", name, s.place(start, end), metadata)
            self.out.edge(scope.package_id or scope.module_id, tid, "Contains")
            if plain:
                self.classes.append(tid)
        self.members(i + 1, end, scope.but(cls=name, class_id=tid))
        return end + 1

    def member(self, start: int, k: int, end: int, scope: Scope) -> int:
        """A method, constructor or field."""
        s = self.s
        k = self.modifiers(s.generic_end(k))
        if s.is_id(k) and s.at(k + 1) == "(":  # a constructor: no function, so its inside leaves no calls or variables
            self.parameters(k + 1, scope.but(function=None))
            i = s.mate[k + 1] + 1
            while i < end and s.t[i] not in ("{", ";"):
                i += 1
            if s.at(i) == "{":
                self.statements(i + 1, s.mate[i], scope)
                return s.mate[i] + 1
            return i + 1
        j = self.type_end(k)
        if j == k or not s.is_id(j):
            return self.skip(k, end, scope)
        if s.at(j + 1) == "(":
            return self.method(start, k, j, end, scope)
        stop = j
        while stop < end and s.t[stop] != ";":
            stop = s.mate[stop] + 1 if s.t[stop] in "({[" else stop + 1
        self.variable(start, k, j, min(stop, len(s.t) - 1), scope, field=True)
        self.statements(j + 1, stop, scope)
        return stop + 1

    def skip(self, k: int, end: int, scope: Scope) -> int:
        s = self.s
        if s.at(k) == "{":
            self.statements(k + 1, s.mate[k], scope)
            return s.mate[k] + 1
        return s.mate[k] + 1 if s.at(k) in ("(", "[") else k + 1

    def method(self, start: int, k: int, j: int, end: int, scope: Scope) -> int:
        s, name = self.s, self.s.t[j]
        i = s.mate[j + 1] + 1
        while i < end and s.t[i] not in ("{", ";"):
            i += 1
        stop = s.mate[i] if s.at(i) == "{" else min(i, len(s.t) - 1)
        fid = scope.id(self.path, "function", name)
        if not self.learning:
            qualified = f"{scope.cls}.{name}" if scope.cls else None
            self.out.node(fid, "Function", name, s.place(start, stop), common("java", module=scope.module, package=scope.package, class_=scope.cls, qualified_name=qualified))
            self.out.edge(scope.class_id or scope.package_id or scope.module_id, fid, "Contains")
        inner = scope.but(function=fid)
        self.parameters(j + 1, inner)
        if s.at(i) == "{":
            self.statements(i + 1, stop, inner)
        return stop + 1

    def parameters(self, i: int, scope: Scope) -> None:
        s, end = self.s, self.s.mate[i]
        i += 1
        while i < end:
            start, k = i, self.modifiers(i)
            j = self.type_end(k)
            plain = s.at(j) != "..."
            if j > k and s.is_id(j) and plain:
                name = s.t[j]
                self.symbols[name] = s.slice(k, j - 1)
                if scope.function and not self.learning:
                    pid = scope.id(self.path, "param", name)
                    self.out.node(pid, "Parameter", name, s.place(start, j), common("java", module=scope.module, package=scope.package, class_=scope.cls))
                    self.out.edge(scope.function, pid, "Defines")
            while i < end and s.t[i] != ",":
                i = s.mate[i] + 1 if s.t[i] in "({[" else s.generic_end(i) if s.t[i] == "<" and s.generic_end(i) > i else i + 1
            i += 1

    def variable(self, start: int, k: int, j: int, stop: int, scope: Scope, field: bool) -> None:
        s, name, kind = self.s, self.s.t[j], self.s.slice(k, j - 1)
        self.symbols[name] = kind
        if self.learning or not (field or scope.function):
            return
        vid = scope.id(self.path, "variable", name)
        metadata = common("java", module=scope.module, package=scope.package, class_=scope.cls, object_type=kind if field else None)
        self.out.node(vid, "Variable", name, s.place(start, stop), metadata)
        if not field:
            self.out.edge(scope.function, vid, "Defines")
        elif scope.class_id:
            self.out.edge(scope.class_id, vid, "Contains")

    def statements(self, i: int, end: int, scope: Scope) -> None:
        s = self.s
        fresh = True  # whether a statement may begin here
        while i < end:
            x = s.t[i]
            if fresh:
                k = self.modifiers(i)
                if s.at(k) in ("class", "interface") and s.is_id(k + 1):
                    i = self.type(i, k, scope)
                    continue
                if s.at(k) in ("enum", "record") and s.is_id(k + 1) and s.at(k + 2) in ("{", "(", "implements", "<"):
                    i = self.transparent(k, scope)
                    continue
                j = self.type_end(k)
                if j > k and s.is_id(j) and s.t[j] not in ("instanceof",) and s.at(j + 1) in ("=", ";", ",", "["):
                    stop = j
                    while stop < end and s.t[stop] != ";":
                        stop = s.mate[stop] + 1 if s.t[stop] in "({[" else stop + 1
                    self.variable(i, k, j, min(stop, len(s.t) - 1), scope, field=False)
                    i, fresh = j + 1, False
                    continue
            fresh = x in (";", "{", "}", "->", ":") or (x == "(" and s.at(i - 1) == "for") or (x == ")" and s.at(s.mate[i] - 1) in ("if", "for", "while")) or x in ("else", "do")
            if x == "new":
                j = self.type_end(i + 1)
                if s.at(j) == "(" and s.at(s.mate[j] + 1) == "{":
                    self.statements(j + 1, s.mate[j], scope)
                    body = s.mate[j] + 1
                    self.members(body + 1, s.mate[body], scope)
                    i = s.mate[body] + 1
                    continue
                i = max(j, i + 1)
                continue
            if s.kind[i] == "id" and s.at(i + 1) == "(" and x not in NOT_CALLS and x[0] != "@":
                self.invocation(i, scope)
            i += 1

    def invocation(self, i: int, scope: Scope) -> None:
        s = self.s
        if self.learning or not scope.function:
            return
        metadata: dict[str, str] = {}
        if s.at(i - 1) == "." or (s.at(i - 1) == ">" and "." in s.t[max(0, i - 12) : i]):
            dot = i - 1
            while s.at(dot) != ".":
                dot -= 1
            first = s.expression_start(dot - 1)
            target = s.slice(first, dot - 1)
            metadata["object"] = target
            if target == "super":
                if scope.class_id in self.superclass:
                    metadata["object_type"] = self.superclass[scope.class_id]
            elif target == "this":
                if scope.class_id:
                    metadata["object_type"] = scope.class_id
            elif target in self.symbols:
                metadata["object_type"] = self.symbols[target]
            elif target[:1].isupper():
                metadata["object_type"] = target if "." in target or not scope.package else f"{scope.package}.{target}"
        self.out.call(scope.function, s.t[i], metadata)

    def class_imports(self) -> None:
        for tid in self.classes:
            for path in self.imports:
                if path.endswith(".*"):
                    target = f"{path[:-2]}::import_package"
                    if target not in self.out.ids:
                        self.out.node(target, "Package", path[:-2], ROOT, common("java", is_external="true"), "")
                else:
                    target = path
                    if target not in self.out.ids:
                        package = path.rsplit(".", 1)[0] if "." in path else None
                        self.out.node(target, "Class", path.rsplit(".", 1)[-1], ROOT, common("java", is_external="true", package=package), "")
                self.out.edge(tid, target, "Imports")


def read_java(path: str, text: str) -> list[dict]:
    return Java(path, text).read()


class Renders(Java):
    """What a portlet's methods dispatch to: not part of the graph by default, as the exported vocabulary lacks it."""

    def __init__(self, path: str, text: str) -> None:
        super().__init__(path, text)
        self.found: list[dict] = []

    def invocation(self, i: int, scope: Scope) -> None:
        s = self.s
        page = s.at(i + 2).strip('"')
        if self.learning or s.t[i] != "dispatch" or not scope.function or s.at(i + 2)[:1] != '"' or not page.endswith(".jsp"):
            return
        method = scope.function.rsplit(":", 1)[-1].lower()
        mode = "edit" if "edit" in method else "help" if "help" in method else "view"
        self.found.append({"rec": "edge", "src": self.classes[0] if self.classes else scope.class_id, "dst": f"jsp::{page}", "relation": "Renders", "metadata": {"mode": mode, "method": scope.function.rsplit(":", 1)[-1]}})


def read_renders(path: str, text: str) -> list[dict]:
    """Renders edges from the first class of a text to the pages its methods dispatch to."""
    reader = Renders(path, text)
    reader.read()
    return reader.found
