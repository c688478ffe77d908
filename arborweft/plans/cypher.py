"""Cypher-subset queries as DataFrame plans.

A node variable is a struct column of the properties the query mentions, a relationship one of (edge_id, src, dst, type), a
path one of its nodes and edges. Patterns start at what is bound or most selective and grow outwards by equi-joins; relations and
labels are filtered before anything meets. Variable-length steps expand trails; where only distinct ends are asked for, they
become breadth-first reachability. Existence becomes semi- and anti-joins on bound ids, OPTIONAL MATCH a left join on them.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborweft.operators import paths
from arborweft.plans.parser import CypherError, Expand, Match, NodeP, Pattern, Project, RelP, Sub, Unwind, parse

AGGREGATES = {"count", "collect", "min", "max", "sum", "avg"}
ALIASES = {"Js": "JS"}


@dataclass
class Graph:
    """nodes: id, node_type and properties; edges: edge_id, src, dst, type. Where both have a project_path, a node is known by project and id,
    and an edge joins nodes of its own project."""

    nodes: DataFrame
    edges: DataFrame

    @property
    def keyed(self) -> bool:
        return "project_path" in self.nodes.columns and "project_path" in self.edges.columns

    def key(self, column: str) -> Column:
        return F.concat_ws("\0", F.coalesce("project_path", F.lit("")), column) if self.keyed else F.col(column)

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession


def _walk(x):
    yield x
    if isinstance(x, (list, tuple)):
        for y in x:
            yield from _walk(y)
    elif isinstance(x, dict):
        for y in x.values():
            yield from _walk(y)
    elif hasattr(x, "__dataclass_fields__"):
        for f in x.__dataclass_fields__:
            yield from _walk(getattr(x, f))


class Planner:
    def __init__(self, graph: Graph, params: dict | None, cap: int | None) -> None:
        self.g, self.params, self.cap = graph, params or {}, cap
        self.kinds: dict[str, str] = {}
        self.df: DataFrame | None = None
        self.fresh = itertools.count()
        self.props: list[str] = []

    # query
    def run(self, clauses: list) -> DataFrame:
        have = self.g.nodes.columns
        used = {x[2] for x in _walk(clauses) if isinstance(x, tuple) and len(x) == 3 and x[0] == "prop"} | {k for x in _walk(clauses) if isinstance(x, NodeP) for k in x.props}
        whole = any(isinstance(x, Project) and (x.star or any(e[0] in ("var", "call") for e, _ in x.items)) for x in clauses if isinstance(x, Project) and x.final)
        self.props = [c for c in have if c in used or c in ("id", "node_type") or (whole and c not in ("metadata", "labels") and len(have) < 40 and c == "name")]
        for k, clause in enumerate(clauses):
            self.step(clause, clauses[k + 1] if k + 1 < len(clauses) else None)
        if self.df is None:
            raise CypherError("nothing to return")
        return self.plain_nodes()

    def plain_nodes(self) -> DataFrame:
        """The result, its nodes without the key."""
        out = self.df
        for name in out.columns:
            kind = self.kinds.get(name, "")
            if kind == "node":
                out = out.withColumn(name, F.col(f"`{name}`").dropFields("_gid"))
            elif kind == "list:node":
                out = out.withColumn(name, F.transform(F.col(f"`{name}`"), lambda x: x.dropFields("_gid")))
        return out

    def step(self, clause, following) -> None:
        if isinstance(clause, Match):
            distinct_ends = isinstance(following, Project) and (following.distinct or self._min_only(following) or self._ends_only(following)) and following.where is None
            if clause.optional:
                self.optional(clause, distinct_ends, following)
            else:
                self.match(clause.patterns, distinct_ends, following, clause.where)
                self.filter(clause.where)
        elif isinstance(clause, Project):
            self.project(clause)
        elif isinstance(clause, Unwind):
            base = self.df if self.df is not None else self.g.spark.range(1).select()
            self.df = base.withColumn(clause.var, F.explode(self.expr(clause.expr)))
            self.kinds[clause.var] = "value"
        elif isinstance(clause, Expand):
            self.expand_config(clause)
        elif isinstance(clause, Sub):
            inner = Planner(self.g, self.params, self.cap)
            inner.run(clause.query)
            rows = inner.df
            self.df = rows if self.df is None else self.df.crossJoin(rows)
            self.kinds |= inner.kinds

    @staticmethod
    def _min_only(p: Project) -> bool:
        calls = [x for e, _ in p.items for x in _walk(e) if isinstance(x, tuple) and x and x[0] == "call" and x[1] in AGGREGATES]
        return bool(calls) and all(c[1] == "min" and c[2] and c[2][0][:2] == ("call", "length") for c in calls)

    @staticmethod
    def _ends_only(p: Project) -> bool:
        """Whether aggregates are all that p does with rows, and repeated rows change none of them."""
        calls = [x for e, _ in p.items for x in _walk(e) if isinstance(x, tuple) and x and x[0] == "call" and x[1] in AGGREGATES]
        return bool(calls) and all(c[1] in ("min", "max") or (c[1] in ("count", "collect") and c[3]) for c in calls)

    # patterns
    def scan(self, node: NodeP, where: tuple | None = None) -> DataFrame:
        out = self.g.nodes
        labels = [ALIASES.get(x, x) for x in node.labels if x != "Node"]
        if labels:
            out = out.where(F.col("node_type").isin(*labels))
        for k, e in node.props.items():
            out = out.where((F.col(k) == self.expr(e)) if k in out.columns else F.lit(False))
        key = self.g.key("id")
        return out.select(F.struct(*self.props, key.alias("_gid")).alias("_node"), key.alias("_nid"))

    def edges(self, rel: RelP) -> DataFrame:
        e = self.g.edges
        if rel.types:
            e = e.where(F.col("type").isin(*rel.types))
        if rel.props:
            e = e.where(F.lit(False))  # edges have no properties
        ends = F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")).alias("ends")
        return e.select("edge_id", self.g.key("src").alias("src"), self.g.key("dst").alias("dst"), "type", ends)

    @staticmethod
    def oriented(e: DataFrame, direction: str) -> DataFrame:
        if direction == ">":
            return e
        back = paths.reverse(e).select(*e.columns)
        return back if direction == "<" else e.unionByName(back.where("src <> dst"))

    def constrain(self, node: NodeP, ids: Column) -> None:
        """Labels and properties of a node that is already bound."""
        labels = [ALIASES.get(x, x) for x in node.labels if x != "Node"]
        if labels:
            self.df = self.df.where(F.col(node.var)["node_type"].isin(*labels))
        for k, e in node.props.items():
            self.df = self.df.where(self.prop(F.col(node.var), "node", k) == self.expr(e))

    def bind(self, node: NodeP, column: str) -> None:
        """Bind a pattern node to the ids in a column: join its scan, or compare with what is bound."""
        if node.var and node.var in self.kinds:
            self.df = self.df.where(F.col(column) == F.col(node.var)["_gid"])
            self.constrain(node, F.col(column))
            return
        if not node.var and not node.labels and not node.props:
            return
        scan = self.scan(node)
        if node.var:
            self.df = self.df.join(scan.select(F.col("_nid").alias(column), F.col("_node").alias(node.var)), column)
            self.kinds[node.var] = "node"
        else:
            self.df = self.df.join(scan.select(F.col("_nid").alias(column)), column, "left_semi")

    def match(self, patterns: list[Pattern], distinct_ends: bool, following, where: tuple | None = None) -> None:
        singles: list[tuple[str, list[str]]] = []
        lists: list[tuple[str, list[str]]] = []
        for pattern in patterns:
            self.chain(pattern, distinct_ends, following, singles, lists, where)
        clash = lambda a, b: not a or not b or set(a) & set(b)
        for (a, at), (b, bt) in itertools.combinations(singles, 2):
            if clash(at, bt):
                self.df = self.df.where(F.col(a) != F.col(b))
        for a, at in lists:
            for b, bt in singles:
                if clash(at, bt):
                    self.df = self.df.where(~F.array_contains(a, F.col(b)))
        for (a, at), (b, bt) in itertools.combinations(lists, 2):
            if clash(at, bt):
                self.df = self.df.where(~F.arrays_overlap(a, b))
        inner = [c for c in self.df.columns if c.startswith("_") and c not in self.kinds and not c.startswith("_key")]
        self.df = self.df.drop(*inner)

    def start_of(self, parts: list, where: tuple | None) -> int:
        nodes = range(0, len(parts), 2)
        for k in nodes:
            if parts[k].var and parts[k].var in self.kinds:
                return k
        fixed = {x[1][1][1] for x in _walk(where) if isinstance(x, tuple) and len(x) == 3 and x[0] == "=" and x[1][0] == "prop" and x[1][1][0] == "var"}
        return max(nodes, key=lambda k: (4 * bool(parts[k].props) + 2 * (parts[k].var in fixed) + bool(parts[k].labels), -k))

    def chain(self, pattern: Pattern, distinct_ends: bool, following, singles: list, lists: list, where: tuple | None) -> None:
        parts, at = pattern.parts, {}
        k = self.start_of(parts, where)
        first = parts[k]
        at[k] = f"_n{next(self.fresh)}"
        if first.var and first.var in self.kinds:
            self.constrain(first, None)
            self.df = self.df.withColumn(at[k], F.col(first.var)["_gid"])
        else:
            rows = self.scan(first).select(F.col("_nid").alias(at[k]), *([F.col("_node").alias(first.var)] if first.var else []))
            self.df = rows if self.df is None else self.df.crossJoin(rows)
            if first.var:
                self.kinds[first.var] = "node"
        steps = [*((j, j + 2) for j in range(k, len(parts) - 1, 2)), *((j, j - 2) for j in range(k, 0, -2))]
        hops: dict[int, tuple] = {}
        for here, there in steps:
            rel = parts[(here + there) // 2]
            onward = there > here
            direction = rel.direction if onward else {">": "<", "<": ">", "-": "-"}[rel.direction]
            at[there] = f"_n{next(self.fresh)}"
            e = self.oriented(self.edges(rel), direction)
            name = f"_e{next(self.fresh)}"
            if rel.least is None:
                self.df = self.df.join(e.select(F.col("src").alias(at[here]), F.col("dst").alias(at[there]), F.col("edge_id").alias(name), F.struct("edge_id", "ends.src", "ends.dst", "type").alias(f"{name}r")), at[here])
                singles.append((name, rel.types))
                hops[(here + there) // 2] = ("one", name)
                if rel.var:
                    self.df = self.df.withColumn(rel.var, F.col(f"{name}r"))
                    self.kinds[rel.var] = "rel"
            else:
                seeds = self.df.select(F.col(at[here]).alias("id")).distinct()
                named = pattern.path or rel.var
                # undirected trails may not turn back over an edge, which breadth-first search would
                nearest = distinct_ends and len(parts) == 3 and not rel.var and (not pattern.path or self._min_only(following))
                if nearest and rel.least in (0, 1) and direction != "-":
                    found = paths.reachable(e, seeds, rel.most)
                    if rel.least == 0:
                        found = found.unionByName(seeds.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth")))
                    self.df = self.df.join(found.select(F.col("start").alias(at[here]), F.col("id").alias(at[there]), F.col("depth").alias(f"{name}d")), at[here])
                    hops[(here + there) // 2] = ("depth", f"{name}d")
                else:
                    found = paths.expand(e, seeds, rel.least, rel.most, nodes=bool(named), cap=self.cap)
                    columns = [F.col("start").alias(at[here]), F.col("end").alias(at[there]), F.col("edge_ids").alias(name)]
                    if named:
                        columns.append(F.col("node_ids").alias(f"{name}n"))
                    self.df = self.df.join(found.select(*columns), at[here])
                    lists.append((name, rel.types))
                    hops[(here + there) // 2] = ("many", name, onward)
                    if rel.var:
                        self.df = self.df.withColumn(rel.var, F.col(name))
                        self.kinds[rel.var] = "value"
            self.bind(parts[there], at[there])
        if pattern.path:
            self.path(pattern, at, hops)

    def path(self, pattern: Pattern, at: dict, hops: dict) -> None:
        if any(h[0] == "depth" for h in hops.values()):
            (h,) = hops.values()
            self.df = self.df.withColumn(pattern.path, F.struct(F.col(h[1]).alias("depth")))
            self.kinds[pattern.path] = "path"
            return
        ids, nodes = [F.array().cast("array<bigint>")], [F.array(F.col(at[0]))]
        for k in range(1, len(pattern.parts), 2):
            h = hops[k]
            if h[0] == "one":
                ids.append(F.array(F.col(h[1])))
                nodes.append(F.array(F.col(at[k + 1])))
            else:
                turn = (lambda c: c) if h[2] else F.reverse
                ids.append(turn(F.col(h[1])))
                walk = turn(F.col(f"{h[1]}n"))
                nodes.append(F.slice(walk, F.lit(2), F.size(walk)))
        edge_ids, node_ids = F.concat(*ids), F.concat(*nodes)
        self.df = self.df.withColumn(pattern.path, F.struct(F.size(edge_ids).alias("depth"), edge_ids.alias("edge_ids"), node_ids.alias("node_ids")))
        self.kinds[pattern.path] = "path"

    def bound_in(self, patterns: list[Pattern]) -> list[str]:
        return sorted({p.var for x in patterns for p in x.parts if p.var and p.var in self.kinds and isinstance(p, NodeP)})

    def apart(self, patterns: list[Pattern]) -> tuple[Planner, list[str]]:
        """A planner over the distinct bound nodes of some patterns, and the key columns that lead back."""
        inner = Planner(self.g, self.params, self.cap)
        inner.props, inner.fresh = self.props, self.fresh
        known = self.bound_in(patterns)
        keys = [f"_key_{v}" for v in known]
        if known:
            inner.df = self.df.select(*known, *(F.col(v)["_gid"].alias(f"_key_{v}") for v in known)).dropDuplicates(keys)
            inner.kinds = {v: "node" for v in known}
        return inner, keys

    def optional(self, clause: Match, distinct_ends: bool, following) -> None:
        inner, keys = self.apart(clause.patterns)
        inner.match(clause.patterns, distinct_ends, following, clause.where)
        inner.filter(clause.where)
        new = [v for v in inner.kinds if v not in self.kinds]
        found = inner.df.select(*keys, *new)
        with_keys = self.df.withColumns({k: F.col(k.removeprefix("_key_"))["_gid"] for k in keys})
        self.df = (with_keys.join(found, keys, "left") if keys else with_keys.join(found, F.lit(True), "left")).drop(*keys)
        self.kinds |= {v: inner.kinds[v] for v in new}

    def exists(self, pattern: Pattern) -> tuple[DataFrame, list[str]]:
        inner, keys = self.apart([pattern])
        inner.match([pattern], True, None)
        return inner.df.select(*keys).distinct(), keys

    def filter(self, where: tuple | None) -> None:
        if where is None:
            return
        if where[0] == "and":
            self.filter(where[1])
            self.filter(where[2])
            return
        negative, core = (True, where[1]) if where[0] == "not" else (False, where)
        if core[0] == "pattern":
            found, keys = self.exists(core[1])
            if not keys:
                raise CypherError("a pattern in WHERE needs a bound node")
            with_keys = self.df.withColumns({k: F.col(k.removeprefix("_key_"))["_gid"] for k in keys})
            self.df = with_keys.join(found, keys, "left_anti" if negative else "left_semi").drop(*keys)
            return
        for x in [x for x in _walk(where) if isinstance(x, tuple) and x and x[0] == "pattern"]:
            found, keys = self.exists(x[1])
            flag = f"_has{id(x)}"
            with_keys = self.df.withColumns({k: F.col(k.removeprefix("_key_"))["_gid"] for k in keys})
            self.df = with_keys.join(found.withColumn(flag, F.lit(True)), keys, "left").drop(*keys)
        self.df = self.df.where(self.expr(where))
        self.df = self.df.drop(*(c for c in self.df.columns if c.startswith("_has")))

    def expand_config(self, c: Expand) -> None:
        """Outgoing (or incoming) trails of the named relations, the start alone included; relationships are unique on a path."""
        value = lambda k, default: self.plain(c.config[k]) if k in c.config else default
        types, direction = [], ">"
        for part in filter(None, value("relationshipFilter", "").split("|")):
            direction = "<" if part.startswith("<") else ">" if part.endswith(">") else "-"
            types.append(part.strip("<>"))
        var = c.start[1]
        most = value("maxLevel", None)
        e = self.oriented(self.edges(RelP(None, types, {}, direction)), direction)
        seeds = self.df.select(F.col(var)["_gid"].alias("id")).distinct()
        found = paths.expand(e, seeds, value("minLevel", 0), most, cap=self.cap)
        path = F.struct("depth", "edge_ids", "node_ids").alias(c.var)
        self.df = self.df.withColumn("_key", F.col(var)["_gid"]).join(found.select(F.col("start").alias("_key"), path), "_key").drop("_key")
        self.kinds[c.var] = "path"

    def plain(self, e: tuple):
        return e[1] if e[0] == "lit" else self.params[e[1]]

    # projections
    def aggregated(self, e) -> bool:
        return any(isinstance(x, tuple) and x and x[0] == "call" and x[1] in AGGREGATES for x in _walk(e))

    def kind_of(self, e: tuple) -> str:
        if e[0] == "var":
            return self.kinds.get(e[1], "value")
        if e[0] == "call" and e[1] == "collect":
            inner = self.kind_of(e[2][0])
            return f"list:{inner}" if inner != "value" else "value"
        return "value"

    def project(self, p: Project) -> None:
        if self.df is None:
            self.df = self.g.spark.range(1).select(F.lit(0).alias("_none"))
        self.resolve_paths([e for e, _ in p.items])
        items = list(p.items)
        if p.star:
            items = [(("var", v), v) for v in self.kinds] + items
        taken: dict[str, str] = {}
        columns, kinds = [], {}
        for e, name in items:
            kinds[name] = self.kind_of(e)
            columns.append((e, self.expr(e).alias(name)))
            taken[repr(e)] = name
        keys = [c for e, c in columns if not self.aggregated(e)]
        extra = []
        if any(self.aggregated(e) for e, _ in columns):
            marked = [c for e, c in columns if self.aggregated(e)]
            out = self.group(items, marked)
        else:
            order_only = [(f"_o{k}", e) for k, (e, _) in enumerate(p.order) if repr(e) not in taken and not (e[0] == "var" and e[1] in kinds)] if not p.distinct else []
            extra = [self.expr(e).alias(n) for n, e in order_only]
            taken |= {repr(e): n for n, e in order_only}
            out = self.df.select(*keys, *extra)
            if p.distinct:
                ids = [n for n in kinds if kinds[n] == "node"]
                out = out.withColumns({f"_d{i}": F.col(f"`{n}`")["_gid"] for i, n in enumerate(ids)})
                out = out.dropDuplicates([*(f"_d{i}" for i in range(len(ids))), *(n for n in kinds if kinds[n] != "node")]).drop(*(f"_d{i}" for i in range(len(ids))))
        old_kinds, self.kinds, self.df = self.kinds, kinds, out
        if p.order:
            by = []
            for e, down in p.order:
                c = F.col(f"`{taken[repr(e)]}`") if repr(e) in taken else self.expr(e)
                by.append(c.desc_nulls_first() if down else c.asc_nulls_last())
            self.df = self.df.orderBy(*by)
        if p.skip is not None:
            self.df = self.df.offset(int(self.plain(p.skip)))
        if p.limit is not None:
            self.df = self.df.limit(int(self.plain(p.limit)))
        if extra:
            self.df = self.df.select(*(F.col(f"`{n}`") for n in kinds))
        del old_kinds
        self.filter(p.where)

    def group(self, items: list, marked: list[Column]) -> DataFrame:
        """Implicit grouping: what is not aggregated is the key; nodes group by their id."""
        plain = [(e, n) for e, n in items if not self.aggregated(e)]
        nodes = [n for e, n in plain if self.kind_of(e) == "node"]
        base = self.df.withColumns({f"_g{i}": self.expr(e) for i, (e, _) in enumerate(plain)}) if plain else self.df
        keys, first = [], []
        for i, (_, n) in enumerate(plain):
            if n in nodes:
                keys.append(F.col(f"_g{i}")["_gid"].alias(f"_k{i}"))
                first.append(F.first(f"_g{i}").alias(n))
            else:
                keys.append(F.col(f"_g{i}").alias(n))
        out = base.groupBy(*keys).agg(*first, *marked)
        return out.select(*(F.col(f"`{n}`") for _, n in items))

    def resolve_paths(self, exprs: list) -> None:
        """Give paths the nodes themselves where nodes(p) is used for more than its size: one join for all paths."""
        for v in {x[2][0][1] for x in _walk(exprs) if isinstance(x, tuple) and x and x[0] == "call" and x[1] == "nodes" and x[2][0][0] == "var"}:
            if self.kinds.get(v) != "path" or "nodes" in self.df.select(f"{v}.*").columns:
                continue
            each = self.df.select(F.col(f"{v}.edge_ids").alias("_p"), F.col(f"{v}.node_ids").alias("_q")).distinct()
            steps = each.select("_p", "_q", F.posexplode("_q").alias("_i", "_nid"))
            named = steps.join(self.scan(NodeP(None, [], {})), "_nid").groupBy("_p", "_q").agg(F.sort_array(F.collect_list(F.struct("_i", "_node"))).alias("_l"))
            named = named.select("_p", "_q", F.transform("_l", lambda x: x["_node"]).alias("_l"))
            self.df = self.df.withColumns({"_p": F.col(f"{v}.edge_ids"), "_q": F.col(f"{v}.node_ids")}).join(named, ["_p", "_q"])
            self.df = self.df.withColumn(v, F.struct(f"{v}.depth", f"{v}.edge_ids", f"{v}.node_ids", F.col("_l").alias("nodes"))).drop("_p", "_q", "_l")

    # expressions
    def prop(self, value: Column, kind: str, name: str) -> Column:
        if kind == "node":
            return value[name] if name in self.props else F.lit(None)
        if kind == "rel":
            return value[name] if name in ("src", "dst", "type") else F.lit(None)
        return value[name]

    def expr(self, e: tuple, env: dict | None = None) -> Column:
        env = env or {}
        go = lambda x: self.expr(x, env)
        op = e[0]
        if op == "lit":
            return F.lit(e[1])
        if op == "param":
            v = self.params[e[1]]
            return F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v)
        if op == "var":
            if e[1] in env:
                return env[e[1]][0]
            if e[1] not in self.kinds:
                raise CypherError(f"no variable {e[1]}")
            return F.col(f"`{e[1]}`")
        if op == "prop":
            base = e[1]
            if base[0] == "prop" and base[2] == "metadata":
                return F.try_element_at(go(base), F.lit(e[2])) if "metadata" in self.props else F.lit(None)
            kind = env[base[1]][1] if base[0] == "var" and base[1] in env else self.kind_of(base)
            if base[0] in ("call", "index"):
                kind = "node"
            return self.prop(go(base), kind, e[2])
        if op == "pattern":
            return F.coalesce(F.col(f"_has{id(e)}"), F.lit(False))
        binary = {
            "and": lambda a, b: a & b, "or": lambda a, b: a | b, "xor": lambda a, b: a != b, "=": lambda a, b: a == b, "<>": lambda a, b: a != b,
            "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "contains": F.contains, "starts": F.startswith,
            "ends": F.endswith, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "%": lambda a, b: a % b,
            "in": lambda a, b: F.array_contains(b, a), "=~": lambda a, b: F.regexp_like(a, F.concat(F.lit("^(?:"), b, F.lit(")$"))),
        }
        if op in ("=", "<>") and self.kind_of(e[1]) == "node" and self.kind_of(e[2]) == "node":
            return binary[op](go(e[1])["_gid"], go(e[2])["_gid"])
        if op in binary:
            return binary[op](go(e[1]), go(e[2]))
        if op == "+":
            text = any(isinstance(x, tuple) and x and x[0] == "lit" and isinstance(x[1], str) for x in _walk(e)) or any(x[0] == "list" for x in e[1:])
            return F.concat(go(e[1]), go(e[2])) if text else go(e[1]) + go(e[2])
        if op == "not":
            return ~go(e[1])
        if op == "neg":
            return -go(e[1])
        if op in ("null?", "notnull"):
            return go(e[1]).isNull() if op == "null?" else go(e[1]).isNotNull()
        if op == "index":
            return F.get(go(e[1]), go(e[2]).cast("int"))
        if op == "list":
            return F.array(*map(go, e[1]))
        if op == "case":
            out = None
            for c, v in e[2]:
                cond = go(c) if e[1] is None else go(e[1]) == go(c)
                out = F.when(cond, go(v)) if out is None else out.when(cond, go(v))
            return out.otherwise(go(e[3]))
        if op == "comp":
            _, var, source, where, made = e
            kind = "node" if source[0] == "call" and source[1] == "nodes" else self.kind_of(source).removeprefix("list:")
            items = go(source)
            if where:
                items = F.filter(items, lambda x: self.expr(where, env | {var: (x, kind)}))
            return F.transform(items, lambda x: self.expr(made, env | {var: (x, kind)})) if made else items
        if op == "call":
            return self.call(e, env)
        raise CypherError(f"cannot plan {op}")

    def call(self, e: tuple, env: dict) -> Column:
        _, name, args, distinct = e
        if name == "count":
            if args == ["*"]:
                return F.count(F.lit(1))
            kind, c = self.kind_of(args[0]), self.expr(args[0], env)
            c = c["_gid"] if kind == "node" else c["edge_id"] if kind == "rel" else c["edge_ids"] if kind == "path" else c
            return F.count_distinct(c) if distinct else F.count(c)
        a = [self.expr(x, env) for x in args]
        simple = {
            "min": F.min, "max": F.max, "sum": F.sum, "avg": F.avg, "length": lambda p: p["depth"].cast("long"), "relationships": lambda p: p["edge_ids"], "tolower": F.lower, "toupper": F.upper,
            "trim": F.trim, "size": lambda x: F.size(x).cast("long") if args[0][0] != "prop" else F.length(x).cast("long"), "head": lambda x: F.get(x, F.lit(0)),
            "last": lambda x: F.try_element_at(x, F.lit(-1)), "type": lambda r: r["type"], "id": lambda n: n["id"], "tostring": lambda x: x.cast("string"), "tointeger": lambda x: x.try_cast("bigint"),
            "range": lambda x, y, *s: F.sequence(x, y, *s), "coalesce": F.coalesce, "split": lambda x, y: F.split(x, F.concat(F.lit(r"\Q"), y, F.lit(r"\E"))), "replace": F.replace, "reverse": F.reverse,
            "labels": lambda n: F.array(F.lit("Node"), n["node_type"]), "datetime": F.current_timestamp, "substring": lambda x, y, *n: F.substring(x, y + 1, n[0] if n else F.length(x)),
            "exists": lambda x: x.isNotNull(), "abs": F.abs, "startnode": lambda r: r["src"], "endnode": lambda r: r["dst"],
        }
        if name == "collect":
            return F.array_sort(F.collect_set(a[0]) if distinct else F.collect_list(a[0]))
        if name == "nodes":
            kind = self.kinds.get(args[0][1]) if args[0][0] == "var" else None
            return a[0]["nodes"] if kind == "path" else a[0]
        if name not in simple:
            raise CypherError(f"no function {name}")
        return simple[name](*a)


def cypher(graph: Graph, text: str, params: dict | None = None, cap: int | None = None) -> DataFrame:
    """The rows of a query of the subset. Unbounded trails go on until none does; with a cap, longer ones are an error."""
    return Planner(graph, params, cap).run(parse(text))
