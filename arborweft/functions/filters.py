"""Package filters: wildcard patterns that decide which packages are resolved."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborweft.functions.names import package_of


def wildcard_to_regex(pattern: str) -> str:
    """'.' literal, '*' anything, anchored; a pattern that makes no valid expression matches only the empty string."""
    made = "^" + pattern.replace(".", "\\.").replace("*", ".*") + "$"
    try:
        re.compile(made)
    except re.error:
        return "^$"
    return made


@dataclass(frozen=True)
class PackageFilter:
    """Without include patterns nothing is processed; otherwise what some include and no exclude pattern matches."""

    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    create_phantoms: bool = True

    def should_process(self, package: Column) -> Column:
        if not self.include:
            return F.lit(False)
        some = lambda patterns: F.lit(False) if not patterns else package.rlike("|".join(f"(?:{wildcard_to_regex(p)})" for p in patterns))
        return some(self.include) & ~some(self.exclude)

    def should_create_phantom(self, package: Column) -> Column:
        return F.lit(self.create_phantoms)

    def accepts_reference(self, name: Column) -> Column:
        """References without a package always pass."""
        package = package_of(name)
        return package.isNull() | self.should_process(package)


def parse_include(text: str, service: bool = False) -> list[str]:
    """A comma-separated list; the service drops empty parts, the command line keeps them."""
    parts = [x.strip() for x in text.split(",")]
    return [x for x in parts if x] if service else parts
