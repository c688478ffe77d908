"""The store, the service and streaming ingest."""

import json

import pytest

from arborweft.operators.store import GraphStore
from arborweft.service import Service
from arborweft.streaming.ingest import ingest, watch


@pytest.fixture
def service(spark, tmp_path):
    code = tmp_path / "code"
    for project, name in (("one", "A"), ("two", "B")):
        (code / project).mkdir(parents=True)
        (code / project / f"{name}.java").write_text(f"package p;\nclass {name} {{ void m() {{ n(); }} void n() {{}} }}\n")
    return Service(spark, GraphStore(spark, str(tmp_path / "graph")), str(code))


def rpc(service, method, **params):
    return service.handle({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})["result"]


def test_protocol(service):
    assert rpc(service, "initialize")["protocolVersion"] == "2024-11-05"
    assert [t["name"] for t in rpc(service, "tools/list")["tools"]] == ["list_projects", "add_project", "remove_project"]
    assert "error" in rpc(service, "nope")
    assert service.handle({"method": "initialize"}) is None
    assert rpc(service, "tools/call", name="list_projects")["content"][0]["text"] == "one\ntwo"
    assert rpc(service, "tools/call", name="add_project", arguments={"project_path": "../x"})["isError"]


def test_projects(service):
    add = lambda p, **more: rpc(service, "tools/call", name="add_project", arguments={"project_path": p, **more})
    assert "isError" not in add("one")
    add("two", project_name="Two")
    count = lambda: {r["project_path"]: r["count"] for r in service.store.nodes().groupBy("project_path").count().collect()}
    first = count()
    assert set(first) == {"one", "two"}
    add("one", clear_project=True)
    assert count() == first
    add("one")
    assert count()["one"] == 2 * first["one"]  # without clear, nodes are added again
    assert service.store.edge_view().where("type = 'CALLS' AND project_path = 'two'").count() == 1
    assert service.store.edge_view(strict=True).count() >= service.store.edge_view().count()
    assert str(first["two"]) in rpc(service, "tools/call", name="remove_project", arguments={"project_path": "two"})["content"][0]["text"]
    assert set(count()) == {"one"}
    assert service.store.test_connection()
    service.store.clear()
    assert service.store.nodes().count() == 0


def test_label_modes(service):
    service.add_project("one")
    assert "node_type" not in service.store.node_view("typed-only").columns
    assert service.store.node_view("off").first()["labels"] == ["Node"]


def test_stream(spark, tmp_path, monkeypatch):
    from arborweft.streaming import ingest as module

    parsed, read = [], module.read_records
    monkeypatch.setattr(module, "read_records", lambda files: parsed.append(sorted(r["path"] for r in files.collect())) or read(files))
    (tmp_path / "in").mkdir()
    put = lambda n, path, text, at: (tmp_path / "in" / f"{n}.json").write_text(json.dumps({"path": path, "text": text, "at": at}))
    store = GraphStore(spark, str(tmp_path / "graph"))
    go = lambda: ingest(watch(spark, str(tmp_path / "in")), str(tmp_path / "src"), store, str(tmp_path / "ck")).awaitTermination()
    put(1, "A.java", "class A { void m() { gone(); } }", "2024-01-01T00:00:00Z")
    put(2, "B.java", "class B { void late() {} }", "2024-01-01T00:00:00Z")
    go()
    assert store.nodes().where("id = 'A'").count() == 1
    put(3, "A.java", "class A { void m() { late(); } }", "2024-01-02T00:00:00Z")
    go()
    calls = [(r["src"], r["dst"]) for r in store.edge_view().where("type = 'CALLS'").collect()]
    assert calls == [("A.java::A::function:m", "B.java::B::function:late")]
    put(4, "C.java", "class C { }", "2024-01-03T00:00:00Z")
    go()
    # only what a batch brings is parsed, and the version before it stays
    assert parsed == [["A.java", "B.java"], ["A.java"], ["C.java"]]
    assert sorted(x.name for x in (tmp_path / "src").iterdir()) == ["v1", "v2"]
    rows = spark.read.parquet(str(tmp_path / "src" / "v2" / "sources"))
    assert {(r["path"], r["fresh"]) for r in rows.collect()} == {("A.java", False), ("B.java", False), ("C.java", True)}
    assert {r["id"] for r in store.nodes().where("kind = 'Class'").collect()} == {"A", "B", "C"}
    assert [(r["src"], r["dst"]) for r in store.edge_view().where("type = 'CALLS'").collect()] == calls
