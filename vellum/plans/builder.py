"""Fluent queries: ``(Q.field("price").lt(5) & Q.field("name").contains("bolt")).sort("-price").limit(10).build()``."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any


@dataclass(frozen=True)
class Q:
    """A filter with order and page. ``&`` and ``|`` combine filters; order and page are those of the outermost query."""

    filter: dict[str, Any] = field(default_factory=dict)
    order: str | None = None
    page_size: int | None = None
    skipped: int | None = None

    @staticmethod
    def field(name: str) -> FieldQuery:
        return FieldQuery(name)

    @staticmethod
    def where(name: str, op: str, value: Any) -> Q:
        return Q({name: {op: value}})

    @staticmethod
    def all_of(*queries: Q) -> Q:
        return Q({"$and": [q.filter for q in queries]})

    @staticmethod
    def any_of(*queries: Q) -> Q:
        return Q({"$or": [q.filter for q in queries]})

    def __and__(self, other: Q) -> Q:
        return Q.all_of(self, other)

    def __or__(self, other: Q) -> Q:
        return Q.any_of(self, other)

    def sort(self, by: str) -> Q:
        """``name`` or ``+name`` for ascending order, ``-name`` for descending order."""
        return replace(self, order=by)

    def limit(self, rows: int) -> Q:
        return replace(self, page_size=rows)

    def offset(self, rows: int) -> Q:
        return replace(self, skipped=rows)

    def build(self) -> dict[str, Any]:
        """The query as JSON-ready data; a limit of 0 stays one."""
        extra = {"sort": self.order, "limit": self.page_size, "offset": self.skipped}
        return {"filter": self.filter} | {name: value for name, value in extra.items() if value is not None}


class FieldQuery:
    """One field of a query; each method gives the query of one test on it."""

    def __init__(self, name: str) -> None:
        self.name = name

    def _test(self, op: str, value: Any) -> Q:
        return Q.where(self.name, op, value)

    def eq(self, value: Any) -> Q:
        return self._test("eq", value)

    def neq(self, value: Any) -> Q:
        return self._test("neq", value)

    def gt(self, value: Any) -> Q:
        return self._test("gt", value)

    def gte(self, value: Any) -> Q:
        return self._test("gte", value)

    def lt(self, value: Any) -> Q:
        return self._test("lt", value)

    def lte(self, value: Any) -> Q:
        return self._test("lte", value)

    def contains(self, text: str) -> Q:
        return self._test("contains", text)

    def is_included(self, values: list) -> Q:
        return self._test("in", values)

    def not_included(self, values: list) -> Q:
        return self._test("nin", values)

    def exists(self, there: bool = True) -> Q:
        return self._test("exists", there)

    def keywords(self, *words: str) -> Q:
        """Token search on a field in ``text`` mode."""
        return Q({self.name: list(words)})
