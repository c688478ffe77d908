"""Dotted and ``::`` names, paths and classifiers as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_segment(name: Column, mark: str = "::") -> Column:
    return F.split_part(name, F.lit(mark), F.lit(-1))


def first_segment(name: Column, mark: str = "::") -> Column:
    return F.split_part(name, F.lit(mark), F.lit(1))


def package_of(name: Column) -> Column:
    """What stands before the last dot; null where there is none."""
    return F.when(F.contains(name, F.lit(".")), F.regexp_extract(name, r"(?s)^(.*)\.[^.]*$", 1))


def class_name_of(name: Column) -> Column:
    """What stands after the last dot."""
    return F.substring_index(name, ".", -1)


def qualifier_of(name: Column) -> Column:
    """What stands before the last ``::``; null where there is none."""
    return F.when(F.contains(name, F.lit("::")), F.regexp_extract(name, r"(?s)^(.*)::", 1))


def qualified_id(file: Column, kind: Column, name: Column, package: Column | None = None, namespace: Column | None = None, class_: Column | None = None) -> Column:
    """file::[package::][namespace::][class::]kind:name, without the parts that are null."""
    parts = [p for p in (file, package, namespace, class_) if p is not None]
    return F.concat_ws("::", *parts, F.concat(kind, F.lit(":"), name))


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def callee_name(language: Column, call: Column) -> Column:
    """What a call's text calls: the expression before the first bracket; in Java the method's name alone. Null where nothing is called."""
    head = F.trim(F.regexp_extract(call, r"^\s*([\w$.:]+?)\s*\(", 1))
    return F.when(head != "", F.when(language == "java", F.substring_index(head, ".", -1)).otherwise(head))


def split_list(text: Column) -> Column:
    """A comma-separated list, its parts trimmed."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x))


def looks_like_class(name: Column) -> Column:
    return name.rlike(r"^\p{Lu}")


def strip_suffixes(text: Column, *suffixes: str) -> Column:
    """Each suffix taken off as often as it stands at the end, one kind after the other."""
    for s in suffixes:
        text = F.regexp_replace(text, f"({re.escape(s)})+$", "")
    return text


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; null without one, or where it is the first character."""
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.substring_index(name, ".", -1))


def parent(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)).otherwise("")


def normal_path(path: Column) -> Column:
    """A path with '.', '..' and doubled slashes folded away."""
    folded = F.aggregate(
        F.filter(F.split(path, "/"), lambda s: ~s.isin("", ".")),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(folded, "/"))


def ancestors(path: Column) -> Column:
    """The folders above a path, the nearest first."""
    parts = F.split(path, "/")
    return F.transform(F.reverse(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def dao_operation(method: Column) -> Column:
    """The kind of data access that a method's name tells."""
    m = F.lower(method)
    begins = lambda *words: F.lit(False) if not words else m.rlike("^(" + "|".join(words) + ")")
    return (
        F.when(begins("save", "insert", "create"), "SAVE")
        .when(begins("update", "modify"), "UPDATE")
        .when(begins("delete", "remove"), "DELETE")
        .when(begins("get", "find", "query", "select", "load"), "QUERY")
        .otherwise("UNKNOWN")
    )


def portlet_mode(method: Column) -> Column:
    """view, edit or help, by a method's name."""
    m = F.lower(method)
    return F.when(F.contains(m, F.lit("edit")), "edit").when(F.contains(m, F.lit("help")), "help").otherwise("view")


#: Relation names of the portal vocabulary and their priority, 1 the highest.
RELATION_PRIORITY = {"CALLS": 1, "RENDERS": 1, "CONFIGURES": 2, "IMPLEMENTED_BY": 2, "INCLUDES_JSP": 3, "INCLUDES_JS": 3, "FILTERS": 3, "INCLUDES_CSS": 4}


def relation_priority(relation: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in RELATION_PRIORITY.items() for x in kv))
    return F.coalesce(F.try_element_at(table, relation), F.lit(4))
