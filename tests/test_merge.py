"""The keyed merge against a plain loop, and the other set operators."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from arborweft.operators import merge, resolve
from arborweft.schema import METADATA

PATHS = ["", "a/B.java", "x/src/app.js", "/resources/js/app.js", "/srv/p/app.js", "/p/src/A.java", "/q/B.java", "/workspaces/a.js"]


def loop(versions):
    best = {}
    for _, key, path, line in sorted(versions):
        old = best.get(key)
        if old:
            p, n = old
            absolute = "/" in p and ("examples/" in p or "workspaces/" in p or "src/" in p or not p.startswith("/"))
            web = path.startswith("/") and "workspaces/" not in path and "examples/" not in path
            if (p and not path) or (absolute and web) or (n > 0 and line == 0):
                continue
        best[key] = (path, line)
    return best


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from(PATHS), st.sampled_from([0, 1, 7])), min_size=1, max_size=40))
def test_merge_is_the_ordered_fold(spark, rows):
    versions = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame([(i, k, p, (n,)) for i, k, p, n in versions], "ord int, id string, file_path string, location struct<start_line:int>")
    got = {r["id"]: (r["file_path"], r["location"]["start_line"]) for r in merge.merge_nodes(df, ["ord"]).collect()}
    assert got == loop(versions)


def test_insert_if_absent_and_metadata(spark):
    kind = "id string, metadata map<string,string>"
    nodes = spark.createDataFrame([("a", {"k": "1"}), ("b", None)], kind)
    stubs = spark.createDataFrame([("b", {}), ("c", {}), ("c", {"x": "y"})], kind)
    assert sorted(r["id"] for r in merge.insert_if_absent(nodes, stubs).collect()) == ["a", "b", "c"]
    put = merge.put_metadata(nodes, spark.createDataFrame([("a", "2"), ("b", "3")], "id string, value string"), "k")
    assert {r["id"]: r["metadata"]["k"] for r in put.collect()} == {"a": "2", "b": "3"}


def test_reference_outcomes(spark):
    classes = spark.createDataFrame([("com.b.X", "b"), ("com.a.X", "a"), ("p.Y", "y")], "fqn string, id string")
    refs = spark.createDataFrame([("com.b.X",), ("X",), ("java.util.List",), ("Nope",)], "ref string")
    got = {r["ref"]: (r["target_status"], r["target_id"]) for r in resolve.resolve_reference(refs, classes).collect()}
    assert got == {"com.b.X": ("Local", "b"), "X": ("Local", "a"), "java.util.List": ("External", None), "Nope": ("Unresolved", None)}


def test_superclass_fallbacks(spark):
    from arborweft.functions.filters import PackageFilter

    nodes = spark.createDataFrame(
        [("p.A", "Class", "A", {"superclass": "p.B", "superclass_simple": "B"}), ("p.B", "Class", "B", {}), ("q.C", "Class", "C", {"superclass": "x.D", "superclass_simple": "x.D"})],
        "id string, kind string, name string, metadata map<string,string>",
    ).withColumn("metadata", __import__("pyspark").sql.functions.col("metadata").cast(METADATA))
    classes = resolve.class_index(nodes)
    assert [(r["src"], r["dst"]) for r in resolve.resolve_extends(nodes, classes, PackageFilter()).collect()] == [("p.A", "p.B")]
    assert sorted(r["dst"] for r in resolve.resolve_extends(nodes, classes, PackageFilter(), phantoms=True).collect()) == ["p.B", "x.D"]
