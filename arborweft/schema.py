"""The labelled property graph: kinds, relations and table schemas."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, IntegerType, LongType, MapType, StringType, StructField, StructType

#: Node kinds, edge relations and the names that relations have in the export.
NODE_KINDS = [
    "Function", "Class", "Interface", "Module", "Type", "Trait", "Parameter", "Variable", "Import", "Package",
    "Expression", "Operator", "PortletXml", "WebXml", "Portlet", "Servlet", "Filter", "Jsp", "Js",
]
RELATIONS = [
    "Contains", "Defines", "Calls", "Uses", "Extends", "Implements", "Imports", "References", "HasParam", "Returns", "AssignedBy",
    "Triggers", "HasType", "DeclareType", "Exports", "Declares", "Notifies", "DependsOn", "BindsData", "TargetsElement",
    "IncludesJs", "IncludesCss", "IncludesJsp", "Configures", "ImplementedBy", "Filters", "Renders",
]
EXPORTED = {
    "Calls": "CALLS", "Defines": "DEFINES", "Imports": "IMPORTS", "Extends": "EXTENDS", "Implements": "IMPLEMENTS", "Uses": "USES",
    "Contains": "CONTAINS", "Configures": "CONFIGURES", "ImplementedBy": "IMPLEMENTED_BY", "IncludesJs": "INCLUDES_JS",
    "IncludesCss": "INCLUDES_CSS", "IncludesJsp": "INCLUDES_JSP",
}
#: The one kind whose label differs from its name.
LABELS = {"Js": "JS"}
#: Metadata that the export view has as columns; the default is '' except where given.
EXPORTED_METADATA = {
    "language": "language", "module": "module", "package": "package", "class": "class", "caller_id": "caller_id", "object_type": "object_type", "url_pattern": "url-pattern",
}
DEFAULTS = {"language": "unknown"}

LOCATION = StructType([StructField(x, IntegerType()) for x in ("start_line", "start_col", "end_line", "end_col")])
METADATA = MapType(StringType(), StringType())
_TYPES = {"long": LongType(), "int": IntegerType(), "boolean": BooleanType(), "location": LOCATION, "metadata": METADATA}


def _schema(names: str, **types: str) -> StructType:
    """Columns of these names; strings unless given, location and metadata by their names."""
    return StructType([StructField(n, _TYPES.get(types.get(n, n), StringType())) for n in names.split()])


NODES = _schema("project_path project_name id kind name file_path location metadata")
EDGES = _schema("project_path project_name edge_id src dst relation metadata", edge_id="long")
FILES = _schema("project_path path rel_path name ext language extractor supported is_jsp size", supported="boolean", is_jsp="boolean", size="long")
#: What an extractor gives for a file: nodes, edges, calls to resolve and errors in one stream, in order of appearance.
RECORDS = _schema("file seq ord rec id kind name file_path location metadata src dst relation error", ord="int")
