"""The query language's syntax tree. ``str`` gives text that parses to the same tree."""

from __future__ import annotations

from dataclasses import dataclass


class Query:
    """A node of a query."""


@dataclass(frozen=True)
class Free(Query):
    tokens: tuple[str, ...]

    def __str__(self) -> str:
        return " ".join(self.tokens)


@dataclass(frozen=True)
class Phrase(Query):
    tokens: tuple[str, ...]

    def __str__(self) -> str:
        return '"' + " ".join(self.tokens) + '"'


@dataclass(frozen=True)
class Distance(Query):
    distance: int
    left: str
    right: str

    def __str__(self) -> str:
        return f"#DIST,{self.distance},{self.left},{self.right}"


@dataclass(frozen=True)
class Wildcard(Query):
    prefix: str
    suffix: str

    def __str__(self) -> str:
        return f"{self.prefix}*{self.suffix}"


@dataclass(frozen=True)
class Zone(Query):
    elem: str
    sub: Query

    def __str__(self) -> str:
        return f"#{self.elem.upper() if self.elem in ('Title', 'Category', 'Citation') else self.elem}, {self.sub}"


@dataclass(frozen=True)
class Relation(Query):
    root: int
    hops: int
    sub: Query | None = None

    def __str__(self) -> str:
        return f"#LINKSTO {self.root},{self.hops},{'' if self.sub is None else self.sub}"


@dataclass(frozen=True)
class Not(Query):
    sub: Query

    def __str__(self) -> str:
        return f"NOT {self.sub}"


@dataclass(frozen=True)
class Binary(Query):
    op: str  # AND or OR
    left: Query
    right: Query

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"


def zone_name(tag: str) -> str:
    """Title, Category and Citation in any case; all else is an infobox type in lower case."""
    low = tag.lower()
    return low.capitalize() if low in ("title", "category", "citation") else low
