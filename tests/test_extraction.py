"""Readers and resolution on texts in memory."""

import pytest
from pyspark.sql import functions as F

from arborweft.functions.filters import PackageFilter
from arborweft.operators.analysis import analyze_texts
from arborweft.operators.extract import extract_source
from arborweft.operators.store import edge_view
from arborweft.sources import registry
from arborweft.sources.files import from_texts


def graph(spark, sources, **options):
    g = analyze_texts(from_texts(spark, sources), **options)
    nodes = {r["id"]: r for r in g.nodes.collect()}
    edges = [(r["src"], r["relation"], r["dst"]) for r in g.edges.collect()]
    assert len(nodes) == g.nodes.count()
    assert not any(d.startswith("temp_call:") for _, _, d in edges)
    return nodes, edges, g


BASE = "package b.j;\npublic class Base {\n  protected String name;\n  public String getName() { return name; }\n}\n"
FACE = "package b.j;\npublic interface Face { String getName(); }\n"
DERIVED = "package b.j;\nimport java.util.List;\npublic class Derived extends Base implements Face {\n  private Base other;\n  public void run(int n) { String s = other.getName(); super.getName(); helper(s); }\n  void helper(String t) {}\n}\n"


def test_inheritance_over_files(spark):
    nodes, edges, _ = graph(spark, {"a/Derived.java": DERIVED, "a/Base.java": BASE, "a/Face.java": FACE})
    assert ("b.j.Derived", "Extends", "b.j.Base") in edges
    assert ("b.j.Derived", "Implements", "b.j.Face") in edges
    assert nodes["b.j.Base"]["file_path"] == "a/Base.java"
    assert nodes["b.j.Face"]["kind"] == "Interface"
    assert tuple(nodes["b.j.Base"]["location"]) == (2, 1, 5, 2)
    run = "a/Derived.java::b.j::Derived::function:run"
    assert (run, "Calls", "a/Base.java::b.j::Base::function:getName") in edges  # by the field's type
    assert (run, "Calls", "b.j.Base::function:getName") in edges  # super: a phantom in reference mode
    assert (run, "Calls", "a/Derived.java::b.j::Derived::function:helper") in edges
    assert (run, "Defines", "a/Derived.java::b.j::Derived::param:n") in edges
    assert (run, "Defines", "a/Derived.java::b.j::Derived::variable:s") in edges
    assert nodes["b.j.Base::function:getName"]["metadata"]["is_phantom"] == "true"


def test_fixed_mode_finds_local_methods(spark):
    _, edges, _ = graph(spark, {"a/Derived.java": DERIVED, "a/Base.java": BASE, "a/Face.java": FACE}, mode="fixed")
    assert not any(d == "b.j.Base::function:getName" for _, _, d in edges)


def test_import_stubs(spark):
    text = "package p;\nimport javax.portlet.GenericPortlet;\nimport java.util.*;\nclass G extends GenericPortlet { void go() { super.processEvent(); } }\n"
    nodes, edges, g = graph(spark, {"G.java": text, "H.java": "package p;\nimport java.util.List;\nclass H {}\n", "I.java": "package p;\nimport java.util.List;\nclass I {}\n"})
    stub = nodes["javax.portlet.GenericPortlet"]
    assert stub["file_path"] == ""
    assert stub["metadata"]["is_external"] == "true"
    assert stub["metadata"]["package"] == "javax.portlet"
    assert nodes["java.util::import_package"]["kind"] == "Package"
    assert ("p.G", "Imports", "java.util::import_package") in edges
    assert sum(n == "java.util.List" for n in nodes) == 1
    assert ("G.java::p::G::function:go", "Calls", "javax.portlet.GenericPortlet::function:processEvent") in edges
    ends = edge_view(g.edges.withColumn("edge_id", F.lit(0)), g.nodes)
    assert ends.join(g.nodes.select(F.col("id").alias("dst")), "dst", "left_anti").count() == 0


def test_import_resolution_needs_includes(spark):
    sources = {"A.java": "package com.a;\nimport com.b.B;\nclass A {}\n", "B.java": "package com.b;\nclass B {}\n"}
    _, plain, _ = graph(spark, sources)
    _, wide, _ = graph(spark, sources, accept=PackageFilter(["com.*"]))
    assert not any(r == "References" for _, r, _ in plain)
    assert ("A.java::import:com.b.B", "References", "com.b.B") in wide
    assert ("A.java::module", "Imports", "com.b.B") in wide


def test_java_odds():
    text = """package p; /* c */ @interface N { int v() default 1; }
    enum E { X { void q() {} }, Y(2); int z; E(int... a) { init(); } void m() { go("a)b"); } }
    public class O<T extends Comparable<T>> {
      static final Map<String, List<int[]>> M = new HashMap<>(), K = null;
      O(String s) { int hidden = 1; call(); }
      class Inner { void in() { Runnable r = () -> { O.this.hashCode(); }; r.run(); } }
      <R> R gen(final List<? super T> l, T[] arr) throws Exception { for (int i = 0; i < 3; i++) l.add(arr[i]); System.out.println('"'); return new Thread() { public void run() { foo(); } }.start(); }
    }"""
    rows = extract_source("java", "O.java", text)
    ids = {r["id"] for r in rows if r["rec"] == "node"}
    assert {"p.O", "p.Inner", "O.java::p::O::variable:M", "O.java::p::O::function:gen", "O.java::p::Inner::function:in", "O.java::p::O::param:arr"} <= ids
    assert "O.java::p::O::variable:hidden" not in ids  # constructors give no locals
    calls = {(r["metadata"]["method_name"], r["metadata"].get("object"), r["metadata"].get("object_type")) for r in rows if r["rec"] == "call"}
    assert ("println", "System.out", "System.out") in calls
    assert ("add", "l", "List<? super T>") in calls
    assert not any(m == "call" for m, _, _ in calls)


def test_javascript(spark):
    base = "export class Base { constructor() { this.x = 1; } init() { helper(); } }\nfunction helper() { return /a(b/.test('x'); }\n"
    text = """import { Base } from './base';
class Derived extends Base { api = new Api('u'); async load(id) { const t = `x ${ fmt(id) } y`; await this.api.get(id); this.done(); } done() {} }
var panel = { show: function (m) { draw(m); }, hide: (m) => { draw(m); }, size() { return 1; } };
const f = a => a.map(b => b * 2);
"""
    nodes, edges, _ = graph(spark, {"base.js": base, "derived.js": text})
    assert nodes["derived.js::module"]["kind"] == "Js"
    assert ("derived.js::class:Derived", "Extends", "base.js::class:Base") in edges
    assert ("derived.js::object:panel", "Defines", "derived.js::panel::function:show") in edges
    assert ("derived.js::object:panel", "Defines", "derived.js::panel::function:hide") in edges
    assert nodes["derived.js::panel::function:show"]["metadata"]["object"] == "panel"
    assert ("derived.js::Derived::function:load", "Calls", "derived.js::Derived::function:done") in edges
    assert ("derived.js::Derived::function:load", "Calls", "Api::function:get") in edges
    assert ("base.js::Base::function:init", "Calls", "base.js::function:helper") in edges
    assert "derived.js::function:anonymous_3" in nodes


def test_jsx_does_not_break():
    assert extract_source("javascript", "c.tsx", "export const C: FC<P> = ({ a }: P) => { return <div onClick={() => go(a)}>it's {a < 3 ? 'x' : \"y\"}</div>; };\n")


def test_rust(spark):
    text = """use std::collections::HashMap;
pub struct Counter { n: u32 }
enum Kind { A(u8), B }
pub trait Show { fn sig(&self) -> u32; fn shown(&self) -> u32 { helper() } }
impl Counter { pub fn new() -> Self { Counter { n: 0 } } fn get<'a>(&'a self) -> u32 { let c = 'x'; Counter::new(); String::from("a"); self.n.max(1); println!("{}", skipped(1)); helper() } }
mod inner { pub fn deep() -> u32 { crate::helper() } }
fn helper() -> u32 { 1 }
"""
    nodes, edges, _ = graph(spark, {"m.rs": text})
    kinds = {i: n["kind"] for i, n in nodes.items()}
    assert kinds["m.rs::class:Counter"] == "Class"
    assert kinds["m.rs::type:Kind"] == "Type"
    assert kinds["m.rs::trait:Show"] == "Trait"
    assert kinds["m.rs::module:inner"] == "Module"
    assert kinds["m.rs::import:std.collections.HashMap"] == "Import"
    assert "m.rs::Show::function:sig" not in kinds
    for f in ("new", "get"):
        assert ("m.rs::class:Counter", "Contains", f"m.rs::Counter::function:{f}") in edges
    get = "m.rs::Counter::function:get"
    called = {d for s, r, d in edges if s == get and r == "Calls"}
    assert called == {"m.rs::Counter::function:new", "m.rs::function:helper"}
    assert nodes["m.rs::inner::function:deep"]["metadata"]["struct"] == "inner"


PAGES = {
    "shop/WEB-INF/web.xml": """<web-app><servlet><servlet-name>S</servlet-name><servlet-class>com.x.Old</servlet-class></servlet>
      <servlet><servlet-name>S</servlet-name><servlet-class>com.x.S</servlet-class></servlet><servlet><servlet-name>bare</servlet-name></servlet>
      <servlet-mapping><servlet-name>S</servlet-name><url-pattern>/a</url-pattern></servlet-mapping>
      <servlet-mapping><servlet-name>S</servlet-name><url-pattern>/b</url-pattern><url-pattern>/c</url-pattern></servlet-mapping>
      <filter><filter-name>F</filter-name><filter-class>com.x.F</filter-class></filter><filter><filter-name>bare</filter-name></filter>
      <filter-mapping><filter-name>F</filter-name><url-pattern>/*</url-pattern></filter-mapping>
      <filter-mapping><filter-name>F</filter-name><url-pattern>/d</url-pattern></filter-mapping></web-app>""",
    "shop/portlet.xml": """<portlet><portlet-name>P</portlet-name><portlet-class>com.x.P</portlet-class><expiration-cache>60</expiration-cache>
      <portlet-mode>view</portlet-mode><portlet-mode>edit</portlet-mode><window-state>normal</window-state>
      <init-param><name>template-view</name><value>v.jsp</value></init-param><init-param><name>other</name><value>o</value></init-param></portlet>""",
    "shop/order.jsp": """<%@ page import="com.x.Basket" %><jsp:include page="/shared/banner.jspf" flush="true"/><script async src='code/cart.js'></script>
      <jsp:include page="lines/list.jspx"></jsp:include><link href="look/shop.css?v=1" rel="stylesheet"><a href="x">y</a>""",
    "shop/shared/banner.jspf": '<script src="<c:url value="/code/cart.js"/>"></script><script src="/gone.js"></script>',
    "shop/lines/list.jspx": '<%@ include file="line.jspf" %>',
    "shop/lines/line.jspf": "<b>1 < 2</b><jsp:include page='/lines/price/euro.jspf'/>",
    "shop/lines/price/euro.jspf": "<%@include file='/shared/banner.jspf'%>",
    "shop/code/cart.js": "function add() {}",
    "shop/look/shop.css": "b{}",
}


@pytest.fixture(scope="module")
def pages(spark):
    return graph(spark, PAGES)


def test_page_includes(pages):
    nodes, edges, _ = pages
    name = lambda i: i.removeprefix("jsp::shop/")
    assert {(name(s), name(d)) for s, r, d in edges if r == "IncludesJsp"} == {
        ("order.jsp", "shared/banner.jspf"), ("order.jsp", "lines/list.jspx"), ("lines/list.jspx", "lines/line.jspf"),
        ("lines/line.jspf", "lines/price/euro.jspf"), ("lines/price/euro.jspf", "shared/banner.jspf"),
    }
    cart = "shop/code/cart.js::module"
    assert ("jsp::shop/order.jsp", "IncludesJs", cart) in edges
    assert ("jsp::shop/shared/banner.jspf", "IncludesJs", cart) in edges
    assert nodes[cart]["metadata"]["language"] == "javascript"  # the parsed file outlives the page's stub
    assert nodes["/gone.js::module"]["metadata"]["external"] == "true"
    assert ("jsp::shop/order.jsp", "IncludesCss", "css::shop/look/shop.css") in edges
    assert ("jsp::shop/order.jsp", "Imports", "com.x.Basket") in edges
    assert nodes["jsp::shop/order.jsp"]["name"] == "order"
    assert nodes["jsp::shop/lines/list.jspx"]["name"] == "list.jspx"


def test_references_in_odd_markup(spark):
    from arborweft.operators.markup import jsp_references

    texts = {
        "script": ["<script src = 'a.js' >", '<script type="x" src="b.jspx"', "<script\nsrc='c.js'\n></script>"],
        "css": ["<link href='a.css' rel='stylesheet'>", '<link rel="stylesheet" media="p" href="d/b.css?x=1"/>'],
        "css_url": ["<link rel='x' href='<c:url value=\"/c.css\" />'/>"],
        "script_url": ["<script src=\"<c:url value='/u.js'/>\"></script>"],
        "static": ["<%@ include file='a.jspf' %>", '<%@include file="b.jspf"%>'],
        "dynamic": ["<jsp:include page='p.jsp'>", '<jsp:include flush="true" page="q.jsp" />'],
        "import": ["<%@ page import='a.B' %>", "<% page import='c.*,d.E' %>"],
    }
    none = ["<script>src='a.js'</script>", "<scripts src='a.js'>", "<link href='a.css'>", "<script src='a.js?v=1'>", "<jsp:param page='x'/>", "<%= page %>", "<script data-src='a.js'>", "", "<", "<<<"]
    rows = [(k, t) for k, own in texts.items() for t in own] + [("none", t) for t in none] + [("none", None)]
    refs = jsp_references(F.col("text"))
    got = spark.createDataFrame(rows, "kind string, text string").select("kind", "text", *(c.alias(f"_{k}") for k, c in refs.items())).collect()
    for r in got:
        found = {k: r[f"_{k}"] for k in refs if r[f"_{k}"]}
        assert list(found) == ([] if r["kind"] == "none" else [r["kind"]]), r
        assert r["kind"] == "none" or len(found[r["kind"]]) == 1


def test_descriptors(pages):
    nodes, edges, g = pages
    assert nodes["servlet::S"]["metadata"]["url-pattern"] == "/b,/c"
    assert nodes["servlet::S"]["metadata"]["class"] == "com.x.S"  # the last block
    assert not {"servlet::bare", "filter::bare"} & set(nodes)
    assert nodes["config::web.xml"]["metadata"]["type"] == "deployment-descriptor"
    assert nodes["config::portlet.xml"]["metadata"]["type"] == "portlet-descriptor"
    assert ("servlet::S", "ImplementedBy", "com.x.S") in edges
    orders = sorted(r["metadata"]["order"] for r in g.edges.where("relation = 'Filters'").collect())
    assert orders == ["0", "1"]
    (row,) = g.edges.where("dst = 'portlet::P'").collect()
    assert {"modes": "view,edit", "states": "normal", "cacheSeconds": "60", "param_template-view": "v.jsp"}.items() <= row["metadata"].items()
    assert "param_other" not in row["metadata"]


def test_transitive_includes(pages):
    from arborweft.operators.store import node_view
    from arborweft.plans.catalogue import ask
    from arborweft.plans.cypher import Graph

    _, _, g = pages
    nodes = g.nodes.withColumn("project_path", F.lit("p")).withColumn("project_name", F.lit("p"))
    edges = edge_view(g.edges.withColumn("edge_id", F.monotonically_increasing_id()), g.nodes).select("edge_id", "src", "dst", "type")
    got = {r["id"].rsplit("/", 1)[-1]: r["depth"] for r in ask(Graph(node_view(nodes), edges), "jsp_transitive", name="order").collect()}
    assert got == {"banner.jspf": 1, "list.jspx": 1, "line.jspf": 2, "euro.jspf": 3}


def test_errors_are_rows(spark):
    registry.register_extractor("broken", ["brk"], [], lambda path, text: 1 / 0)
    try:
        g = analyze_texts(from_texts(spark, {"a.brk": "x", "B.java": "class B {}"}))
        assert [r["file"] for r in g.errors.collect()] == ["a.brk"]
        assert g.nodes.where("id = 'B'").count() == 1
        assert len(g.report("d")["parse_errors"]) == 1
    finally:
        registry._EXTRA.clear()
        registry.EXTRACTORS.clear()
    with pytest.raises(ValueError, match="unsupported"):
        extract_source("cobol", "x", "y")


def test_empty_tree(spark):
    g = analyze_texts(from_texts(spark, {"a.txt": "x"}))
    assert g.nodes.count() == 0
    assert g.edges.count() == 0


def test_renders_is_an_extra():
    from arborweft.operators.parsers.java import read_renders

    text = 'package p; class V extends G { void doView() { dispatch("/a.jsp"); other("/b.jsp"); } void doEdit(R r) { if (r.ok()) dispatch("e.jsp", r); } }'
    assert [(r["src"], r["dst"], r["metadata"]["mode"]) for r in read_renders("V.java", text)] == [("p.V", "jsp::/a.jsp", "view"), ("p.V", "jsp::e.jsp", "edit")]
