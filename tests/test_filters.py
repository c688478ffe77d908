"""Package filters, names and language detection."""

import pytest
from pyspark.sql import functions as F

from arborweft.functions import names as N
from arborweft.functions.filters import PackageFilter, parse_include, wildcard_to_regex
from arborweft.sources import datasource, files, registry


@pytest.mark.parametrize(
    ("include", "exclude", "package", "ok"),
    [
        ([], [], "com.example", False),
        (["com.example.*"], [], "com.example.a", True),
        (["com.example"], [], "com.example.a", False),
        (["com.*"], ["com.example.test*"], "com.example.tests", False),
        (["*"], [], "anything", True),
        (["com.("], [], "com.x", False),
    ],
)
def test_package_filter(spark, include, exclude, package, ok):
    row = spark.range(1).select(F.lit(package).alias("p")).select(PackageFilter(include, exclude).should_process(F.col("p")).alias("ok"))
    assert row.first()["ok"] is ok


def test_patterns_and_lists():
    assert wildcard_to_regex("a.b*") == r"^a\.b.*$"
    assert wildcard_to_regex("(") == "^$"
    assert parse_include("a, ,b") == ["a", "", "b"]
    assert parse_include("a, ,b", service=True) == ["a", "b"]


def test_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(N.package_of(F.lit("a.b.C"))) == "a.b"
    assert one(N.package_of(F.lit("C"))) is None
    assert one(N.class_name_of(F.lit("a.b.C"))) == "C"
    assert one(N.qualifier_of(F.lit("a::b::c"))) == "a::b"
    assert one(N.strip_suffixes(F.lit("x.jsp.jsp"), ".jsp")) == "x"
    assert one(N.normal_path(F.lit("/a/./b/../c//d.jsp"))) == "/a/c/d.jsp"
    assert one(N.ancestors(F.lit("a/b/c.x"))) == ["a/b", "a"]
    assert one(N.portlet_mode(F.lit("doEdit"))) == "edit"
    assert one(N.relation_priority(F.lit("UNHEARD"))) == 4


@pytest.mark.parametrize(
    ("path", "language"),
    [("a.py", "python"), ("a.TSX", "javascript"), ("x/WEB-INF/Portlet.xml", "xml"), ("a.unknown", None), ("Main.java", "java"), (".rs", None), ("m.rs", "rust"), ("p.jspf", "jspf")],
)
def test_detection(spark, path, language):
    assert registry.detect_path(path) == language
    assert registry.detect_language(spark.createDataFrame([(path,)], "path string")).first()["language"] == language


def test_listing_skips_dot_names(spark, tmp_path):
    for name in ("a/B.java", "_c/d.js", ".git/x.java", "a/.hidden.java", "z.txt", "page.jsp"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes("é".encode("latin-1") if name == "a/B.java" else b"x")
    found = files.list_files(spark, str(tmp_path))
    assert {r["rel_path"]: r["supported"] for r in found.collect()} == {"a/B.java": True, "_c/d.js": True, "z.txt": False, "page.jsp": True}
    text = {r["name"]: (r["text"], r["read_error"]) for r in files.read_texts(found.where("supported")).collect()}
    assert text["d.js"] == ("x", None)
    assert text["B.java"][0] is not None
    assert [r["rel_path"] for r in registry.in_source_order(found).orderBy("seq").collect()][-1] == "page.jsp"


def test_listing_of_a_uri(spark, tmp_path):
    """Names with blanks, signs and marks; hidden folders; a file that has gone; a link to nowhere."""
    for name in ("in/a b%1#é.java", "_c/d.js", ".git/x.java"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("class A { }")
    (tmp_path / "gone.rs").symlink_to(tmp_path / "nowhere")
    found = files.list_files(spark, f"file://{tmp_path}").where("supported AND name != 'gone.rs'")
    assert {r["rel_path"]: (r["text"], r["read_error"]) for r in files.read_texts(found).collect()} == {n: ("class A { }", None) for n in ("in/a b%1#é.java", "_c/d.js")}
    (tmp_path / "_c/d.js").unlink()
    lost = {r["rel_path"]: r["read_error"] for r in files.read_texts(found).collect()}
    assert lost["_c/d.js"]
    assert lost["in/a b%1#é.java"] is None
    local = files.read_texts(files.list_files(spark, str(tmp_path)).where("supported")).collect()
    assert {r["name"]: r["read_error"] is None for r in local} == {"a b%1#é.java": True, "gone.rs": False}
    assert files.list_files(spark, f"file://{tmp_path}/none").count() == 0
    spark.dataSource.register(datasource.SourceTree)
    tree = spark.read.format("source_tree").load(f"file://{tmp_path}/in").collect()
    assert [(r["rel_path"], r["language"], r["text"]) for r in tree] == [("a b%1#é.java", "java", "class A { }")]


def test_registry():
    assert registry.has_specialized_extractor("java")
    assert not registry.has_specialized_extractor("python")
    assert registry.get_language("nope") is None


def test_data_source(spark, tmp_path):
    from arborweft.sources import datasource

    for name, body in (("a/B.java", b"class B {}"), (".x/C.java", b""), ("n.txt", b"t"), ("é.js", "é".encode("latin-1"))):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    datasource.register(spark)
    found = spark.read.format("source_tree").option("targetBytes", 1).load(str(tmp_path))
    assert {(r["rel_path"], r["language"]) for r in found.collect()} == {("a/B.java", "java"), ("é.js", "javascript")}
    assert found.where("rel_path = 'a/B.java'").first()["text"] == "class B {}"
    assert spark.read.format("source_tree").option("knownOnly", "false").load(str(tmp_path)).count() == 3
