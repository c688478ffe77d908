"""Projects as a service: a JSON-RPC handler, an HTTP front and a command line."""

from __future__ import annotations

import json
import os
import sys
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from arborweft.functions.filters import PackageFilter, parse_include
from arborweft.operators.analysis import CodeGraph, analyze
from arborweft.operators.store import GraphStore, summary, write_report
from arborweft.sources.files import list_projects

PROTOCOL = "2024-11-05"


def _tool(name: str, description: str, required: list[str], **properties) -> dict:
    return {"name": name, "description": description, "inputSchema": {"type": "object", "properties": properties, "required": required}}


_TEXT, _FLAG, _LIST = {"type": "string"}, {"type": "boolean"}, {"type": "string", "description": "comma-separated package patterns"}
TOOLS = [
    _tool("list_projects", "Projects that can be analysed", []),
    _tool("add_project", "Analyse a project and store its graph", ["project_path"], project_path=_TEXT, project_name=_TEXT, include_packages=_LIST, clear_project=_FLAG),
    _tool("remove_project", "Remove a project's graph", ["project_path"], project_path=_TEXT),
]


class Service:
    def __init__(self, spark: SparkSession, store: GraphStore, code_path: str | None = None) -> None:
        self.spark, self.store = spark, store
        self.code_path = code_path or os.environ.get("CODE_PATH", "/app/data")

    def list_projects(self) -> list[str]:
        return [r["name"] for r in list_projects(self.spark, self.code_path).collect()]

    def _inside(self, project_path: str) -> str:
        if os.path.isabs(project_path) or ".." in project_path.replace("\\", "/").split("/"):
            raise ValueError(f"not a path inside the code folder: {project_path}")
        full = os.path.join(self.code_path, project_path)
        if not os.path.isdir(full):
            raise ValueError(f"no such project: {project_path}")
        return full

    def add_project(self, project_path: str, project_name: str | None = None, include_packages: str | None = None, clear_project: bool = False) -> str:
        full = self._inside(project_path)
        name = project_name or project_path.rstrip("/").rsplit("/", 1)[-1]
        graph: CodeGraph = analyze(self.spark, full, PackageFilter(parse_include(include_packages or "", service=True)))
        self.store.export(graph.nodes, graph.edges, project_path, name, clear=clear_project)
        mine = F.col("project_path") == project_path
        return f"Project {name}: {self.store.nodes().where(mine).count()} nodes, {self.store.edges().where(mine).count()} edges"

    def remove_project(self, project_path: str) -> str:
        return f"Removed {self.store.delete_project(project_path)} nodes of {project_path}"

    def call(self, name: str, arguments: dict) -> dict:
        try:
            if name == "list_projects":
                text = "\n".join(self.list_projects())
            elif name == "add_project":
                text = self.add_project(**arguments)
            elif name == "remove_project":
                text = self.remove_project(**arguments)
            else:
                return {"error": {"code": -32601, "message": f"Unknown tool: {name}"}}
        except (ValueError, TypeError) as e:
            return {"content": [{"type": "text", "text": f"Error: {e}"}], "isError": True}
        return {"content": [{"type": "text", "text": text}]}

    def handle(self, request: dict) -> dict | None:
        """The answer to a request; none to a notification. An unknown method is an error inside the result."""
        if request.get("id") is None:
            return None
        method, params = request.get("method"), request.get("params") or {}
        if method == "initialize":
            result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "arborweft", "version": "0.1.0"}}
        elif method == "tools/list":
            result = {"tools": TOOLS}
        elif method == "tools/call":
            result = self.call(params.get("name", ""), params.get("arguments") or {})
        else:
            result = {"error": {"code": -32601, "message": f"Method not found: {method}"}}
        return {"jsonrpc": "2.0", "id": request["id"], "result": result}

    def serve(self, port: int | None = None) -> None:
        service = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self) -> None:  # noqa: N802
                body = self.rfile.read(int(self.headers.get("Content-Length", 0)))
                answer = json.dumps(service.handle(json.loads(body or b"{}"))).encode()
                self.send_response(200 if self.path.rstrip("/") == "/api/mcp" else 404)
                self.send_header("Content-Type", "application/json")
                self.end_headers()
                self.wfile.write(answer)

        HTTPServer(("127.0.0.1", port or int(os.environ.get("MCP_PORT", "8001"))), Handler).serve_forever()


def main(argv: list[str]) -> int:
    spark = SparkSession.builder.appName("arborweft").getOrCreate()
    store = GraphStore(spark, os.environ.get("GRAPH_PATH", ".output/graph"))
    if "--mcp" in argv:
        Service(spark, store).serve()
        return 0
    if len(argv) != 1 or not os.path.isdir(argv[0]):
        print("usage: python -m arborweft.service DIRECTORY | --mcp", file=sys.stderr)
        return 1
    graph = analyze(spark, argv[0], PackageFilter(parse_include(os.environ.get("INCLUDE_PACKAGES", "")) if os.environ.get("INCLUDE_PACKAGES") else []))
    summary(graph.nodes, graph.edges).orderBy("what", F.desc("n")).show(100, truncate=False)
    write_report(graph.report(argv[0]))
    store.export(graph.nodes, graph.edges, full=True)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
