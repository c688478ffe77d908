"""Server pages and deployment descriptors to graph rows, in expressions only: no Python touches a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborweft.functions.names import ancestors, file_name, normal_path, parent, strip_suffixes

#: Endings of files that a script tag may name.
SCRIPTS = ("js", "jsp", "jspx", "jspf")


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 1)


def _tags(text: Column) -> Column:
    """What stands after each '<' of a page: its name (directives as %@name), its text up to '>' and, for values that hold a tag of
    their own, the piece that follows."""
    pieces = F.split(text, "<")
    name = lambda x: F.regexp_replace(F.regexp_extract(x, r"^(%@?\s*\w+|[A-Za-z][\w:]*)", 1), r"\s|@", "")
    return F.transform(pieces, lambda x, k: F.struct(name(x).alias("name"), F.substring_index(x, ">", 1).alias("body"), F.coalesce(F.get(pieces, k + 1), F.lit("")).alias("after")))


def _attribute(body: Column, name: str) -> Column:
    """The quoted value of an attribute, wherever it stands in a tag; '' without one."""
    return F.regexp_extract(body, rf"""(?s)(?:^|[\s"'])(?:{name})\s*=\s*(["'])(.*?)\1""", 2)


def _values(tags: Column, of, value) -> Column:
    return F.filter(F.transform(F.filter(tags, of), value), lambda v: v != "")


def _nested(tag: Column, name: str) -> Column:
    """The value of a self-closed c:url that an attribute's value begins with; '' without one."""
    opens = tag["body"].rlike(rf"""(?:^|[\s"']){name}\s*=\s*["']\s*$""")
    url = F.startswith(tag["after"], F.lit("c:url")) & F.contains(tag["after"], F.lit("/>"))
    return F.when(opens & url, _attribute(F.substring_index(tag["after"], "/>", 1), "value")).otherwise("")


def jsp_references(text: Column) -> dict[str, Column]:
    """Arrays of what a page refers to, by kind of reference, in order of appearance. Attributes may stand in any order."""
    tags = _tags(text)
    named = lambda *names: lambda t: t["name"].isin(*names)
    script = lambda v: F.when(F.substring_index(v, ".", -1).isin(*SCRIPTS) & F.contains(v, F.lit(".")), v).otherwise("")
    sheet = lambda v: F.regexp_extract(v, r"^(.+?\.css)", 1)
    styled = lambda t: (t["name"] == "link") & (_attribute(t["body"], "rel") == "stylesheet")
    return {
        "script": _values(tags, named("script"), lambda t: script(_attribute(t["body"], "src"))),
        "script_url": _values(tags, named("script"), lambda t: script(_nested(t, "src"))),
        "css": _values(tags, styled, lambda t: sheet(_attribute(t["body"], "href"))),
        "css_url": _values(tags, named("link"), lambda t: sheet(_nested(t, "href"))),
        "static": _values(tags, named("%include"), lambda t: _attribute(t["body"], "file")),
        "dynamic": _values(tags, named("jsp:include"), lambda t: _attribute(t["body"], "page")),
        "import": _values(tags, named("%page"), lambda t: _attribute(t["body"], "import")),
    }


def _place() -> Column:
    return F.struct(*(F.lit(0).alias(x) for x in ("start_line", "start_col", "end_line", "end_col")))


def _map(**values) -> Column:
    made = F.create_map(*(x for k, v in values.items() for x in (F.lit(k.replace("__", "-")), v if isinstance(v, Column) else F.lit(v))))
    return F.map_filter(made, lambda _, v: v.isNotNull())


def _nodes(rows: DataFrame, id_: Column, kind, name: Column, file_path: Column, metadata: Column, part: int = 0, at: Column | None = None) -> DataFrame:
    """Node rows; ord is their place among the nodes of a file: by part, then by the place inside it."""
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    order = F.lit(part << 32).cast("long") + (F.lit(0) if at is None else at)
    return rows.select(F.col("seq"), order.alias("ord"), id_.alias("id"), kind.alias("kind"), name.alias("name"), file_path.alias("file_path"), _place().alias("location"), metadata.alias("metadata"))


def _edges(rows: DataFrame, src: Column, dst: Column, relation, metadata: Column) -> DataFrame:
    relation = relation if isinstance(relation, Column) else F.lit(relation)
    return rows.select(F.col("seq"), src.alias("src"), dst.alias("dst"), relation.alias("relation"), metadata.alias("metadata"))


def webapp_roots(files: DataFrame, inventory: DataFrame) -> DataFrame:
    """path, root: the nearest folder above that is called webapp, else the nearest that holds a WEB-INF."""
    up = files.select("path", F.posexplode(ancestors(F.col("path"))).alias("far", "dir"))
    holders = inventory.select(F.regexp_extract("path", "^(.*?)/WEB-INF/", 1).alias("dir")).where("dir <> ''").distinct().withColumn("_holds", F.lit(True))
    seen = up.join(holders, "dir", "left")
    rank = F.when(file_name(F.col("dir")) == "webapp", 0).when(F.col("_holds"), 1)
    return seen.where(rank.isNotNull()).groupBy("path").agg(F.min_by("dir", F.struct(rank, "far")).alias("root"))


def _resolve(refs: DataFrame, inventory: DataFrame, root_first: Column) -> DataFrame:
    """refs (path, root, web) with found: the file that a web path means, or null. root_first: whether the webapp's root is asked."""
    inside = F.regexp_replace("web", "^/+", "")
    a = F.when(root_first & F.col("root").isNotNull(), normal_path(F.concat("root", F.lit("/"), inside)))
    b = normal_path(F.concat(parent(F.col("path")), F.lit("/"), inside))
    known = inventory.select("path").distinct()
    out = refs.withColumn("_a", a).withColumn("_b", F.when(F.startswith("web", F.lit("/")) & ~root_first, F.lit(None)).otherwise(b))
    out = out.join(known.select(F.col("path").alias("_a"), F.lit(True).alias("_in_a")), "_a", "left").join(known.select(F.col("path").alias("_b"), F.lit(True).alias("_in_b")), "_b", "left")
    return out.withColumn("found", F.when(F.col("_in_a"), F.col("_a")).when(F.col("_in_b"), F.col("_b"))).drop("_a", "_b", "_in_a", "_in_b")


def jsp_name(path: Column) -> Column:
    return strip_suffixes(file_name(path), ".jsp", ".jspf")


def extract_jsp(files: DataFrame, inventory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of pages (path, text, seq); inventory (path) has every file of the tree, whatever its kind."""
    pages = files.select("path", "seq", *(a.alias(k) for k, a in jsp_references(F.col("text")).items()))
    roots = webapp_roots(files, inventory)
    me = F.concat(F.lit("jsp::"), "path")
    fragment = F.when(F.endswith("path", F.lit(".jspf")), "true")
    nodes = _nodes(pages, me, "Jsp", jsp_name(F.col("path")), F.col("path"), _map(type=F.lit("jsp"), path=F.col("path"), fragment=fragment))

    def refs(*kinds: str) -> DataFrame:
        named = lambda k: F.transform(k, lambda w: F.struct(w.alias("web"), F.lit(k).alias("how")))
        whole = F.concat(*map(named, kinds))
        rows = pages.select("path", "seq", F.posexplode(whole).alias("position", "r")).select("path", "seq", "position", "r.web", "r.how")
        return rows.join(roots, "path", "left")

    scripts = _resolve(refs("script", "script_url"), inventory, F.lit(True))
    target = F.coalesce("found", "web")
    page = target.rlike(r"\.jsp[xf]?$")
    js = F.when(page, F.concat(F.lit("jsp::"), target)).otherwise(F.concat(target, F.lit("::module")))
    outside = F.when(F.col("found").isNull(), "true")
    web = F.when(F.col("found").isNull(), F.col("web"))
    js_name = F.when(page, jsp_name(target)).otherwise(strip_suffixes(file_name(target), ".js"))
    nodes = nodes.unionByName(_nodes(scripts, js, F.when(page, "Jsp").otherwise("Js"), js_name, target, _map(path=target, external=outside, web_path=web), 1, F.col("position")))
    edges = _edges(scripts, me, js, "IncludesJs", _map(position=F.col("position").cast("string")))

    styles = _resolve(refs("css", "css_url"), inventory, F.lit(True))
    css = F.concat(F.lit("css::"), target)
    nodes = nodes.unionByName(_nodes(styles, css, "Module", strip_suffixes(file_name(target), ".css"), target, _map(type=F.lit("css"), path=target, external=outside, web_path=web), 2, F.col("position")))
    edges = edges.unionByName(_edges(styles, me, css, "IncludesCss", _map(position=F.col("position").cast("string"))))

    includes = _resolve(refs("static", "dynamic"), inventory, F.startswith("web", F.lit("/")))
    to = F.concat(F.lit("jsp::"), target)
    nodes = nodes.unionByName(_nodes(includes, to, "Jsp", jsp_name(target), target, _map(type=F.lit("jsp"), path=target), 3, F.col("position")))
    edges = edges.unionByName(_edges(includes, me, to, "IncludesJsp", _map(type=F.col("how"))))

    imports = refs("import")
    cls = F.col("web")
    package = F.when(F.contains(cls, F.lit(".")), F.regexp_extract(cls, r"^(.*)\.[^.]*$", 1))
    made = _map(external=F.lit("true"), qualified_name=cls, package=package, imported_by_jsp=F.col("path"))
    nodes = nodes.unionByName(_nodes(imports, cls, "Class", F.substring_index(cls, ".", -1), F.lit(""), made, 4, F.col("position")))
    edges = edges.unionByName(_edges(imports, me, cls, "Imports", _map(import_type=F.lit("jsp_page_import"), qualified_name=cls)))
    return nodes, edges


def _leaf(block: Column, tag: str) -> Column:
    """The trimmed text of the first <tag> of a block; null without one."""
    return F.get(F.transform(_all(block, rf"<{tag}>([^<]*)</{tag}>"), lambda x: F.trim(x)), F.lit(0))


def _leaves(block: Column, tag: str) -> Column:
    return F.transform(_all(block, rf"<{tag}>([^<]*)</{tag}>"), lambda x: F.trim(x))


def _blocks(files: DataFrame, tag: str) -> DataFrame:
    """path, seq, pos, block: what stands inside each attribute-free <tag>."""
    return files.select("path", "seq", F.posexplode(_all(F.col("text"), rf"(?s)<{tag}>(.*?)</{tag}>")).alias("pos", "block"))


def extract_web_xml(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Servlets, filters and their classes and mappings of web.xml texts (path, text, seq). What names no class is passed over; of blocks
    with one name the last counts."""
    top = F.lit("config::web.xml")
    nodes = _nodes(files, top, "WebXml", F.lit("web.xml"), F.col("path"), _map(type=F.lit("deployment-descriptor")))
    own = lambda tag: _blocks(files, tag).select("path", "seq", "pos", _leaf(F.col("block"), f"{tag}-name").alias("name"), _leaf(F.col("block"), f"{tag}-class").alias("class")).where("name IS NOT NULL AND class <> ''")
    servlets = own("servlet")
    maps = _blocks(files, "servlet-mapping").select("path", "pos", _leaf(F.col("block"), "servlet-name").alias("name"), F.array_join(_leaves(F.col("block"), "url-pattern"), ",").alias("url"))
    last = maps.where("name IS NOT NULL AND url <> ''").groupBy("path", "name").agg(F.max_by("url", "pos").alias("url"))
    servlets = servlets.join(last, ["path", "name"], "left")
    sid, fid = F.concat(F.lit("servlet::"), "name"), F.concat(F.lit("filter::"), "name")
    nodes = nodes.unionByName(
        _nodes(servlets, sid, "Servlet", F.col("name"), F.concat(F.lit("/servlets/"), "name", F.lit(".java")), _map(type=F.lit("servlet"), **{"class": F.col("class"), "url__pattern": F.col("url")}), 1, F.col("pos"))
    )
    edges = _edges(servlets, top, sid, "Configures", _map(**{"class": F.col("class")}))
    edges = edges.unionByName(_edges(servlets, sid, F.col("class"), "ImplementedBy", _map(implements_class=F.col("class"))))
    filters = own("filter")
    nodes = nodes.unionByName(_nodes(filters, fid, "Filter", F.col("name"), F.concat(F.lit("/filters/"), "name", F.lit(".java")), _map(type=F.lit("filter"), **{"class": F.col("class")}), 2, F.col("pos")))
    edges = edges.unionByName(_edges(filters, top, fid, "Configures", _map(**{"class": F.col("class")})))
    edges = edges.unionByName(_edges(filters, fid, F.col("class"), "ImplementedBy", _map(implements_class=F.col("class"))))
    chain = _blocks(files, "filter-mapping").select("path", "seq", "pos", _leaf(F.col("block"), "filter-name").alias("name"), F.posexplode_outer(_leaves(F.col("block"), "url-pattern")).alias("k", "url"))
    chain = chain.join(filters.select("path", "name").distinct(), ["path", "name"], "left_semi").where("url IS NOT NULL")
    chain = chain.withColumn("order", (F.row_number().over(W.partitionBy("path").orderBy("pos", "k")) - 1).cast("string"))
    edges = edges.unionByName(_edges(chain, fid, F.lit("servlet::FilterChain"), "Filters", _map(order=F.col("order"), urlPattern=F.col("url"))))
    return nodes, edges


def extract_portlet_xml(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Portlets of portlet.xml texts (path, text, seq)."""
    top = F.lit("config::portlet.xml")
    nodes = _nodes(files, top, "PortletXml", F.lit("portlet.xml"), F.col("path"), _map(type=F.lit("portlet-descriptor")))
    b = F.col("block")
    given = F.transform(_all(b, "(?s)<init-param>(.*?)</init-param>"), lambda x: F.struct(F.concat(F.lit("param_"), _leaf(x, "name")).alias("k"), _leaf(x, "value").alias("v")))
    params = F.filter(given, lambda x: F.startswith(x["k"], F.lit("param_template")) & x["v"].isNotNull())
    portlets = _blocks(files, "portlet").select(
        "path", "seq", "pos", _leaf(b, "portlet-name").alias("name"), _leaf(b, "portlet-class").alias("class"),
        F.array_join(_leaves(b, "portlet-mode"), ",").alias("modes"), F.array_join(_leaves(b, "window-state"), ",").alias("states"),
        _leaf(b, "expiration-cache").try_cast("int").cast("string").alias("cache"), params.alias("params"),
    ).where("name IS NOT NULL")
    pid = F.concat(F.lit("portlet::"), "name")
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    nodes = nodes.unionByName(_nodes(portlets, pid, "Portlet", F.col("name"), F.concat(F.lit("/portlets/"), "name", F.lit(".java")), _map(type=F.lit("portlet"), **{"class": F.col("class")}), 1, F.col("pos")))
    later = lambda x, k: F.exists(F.slice("params", k + 2, F.size("params") + 1), lambda y: y["k"] == x["k"])
    extra = F.map_from_entries(F.filter("params", lambda x, k: ~later(x, k)))  # of one name the last counts
    edges = _edges(portlets, top, pid, "Configures", F.map_concat(_map(modes=text("modes"), states=text("states"), cacheSeconds=F.col("cache")), extra))
    return nodes, edges.unionByName(_edges(portlets.where("class IS NOT NULL"), pid, F.col("class"), "ImplementedBy", _map(fqn=F.col("class"))))
