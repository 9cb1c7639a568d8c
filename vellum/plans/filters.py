"""Declarative filters as DataFrame predicates.

A filter is a dict of clauses that all must hold, or a list of filters that all must hold. A clause is ``$or`` (a list of
filters), ``$and`` (a filter), or a field with a value: a number or text to equal, a list to be in (token search on fields
in ``text`` mode), or a dict of operators. The result is one boolean column, so that Catalyst fuses, prunes and pushes it.

It is meant for ``where``: it may be null where it is not true. Each negation (neq, nin, exists: false) says itself what
it means for nulls, and no other negation stands above it, so that loses nothing and lets simple tests reach the scan.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.errors import QueryError
from vellum.functions.operands import ARRAY, NUMBER, TEXT, MissingField, TypedField, VariantField, any_of, family_of, number
from vellum.functions.text import holds_all, holds_any, tokens_of
from vellum.model import StoreSpec
from vellum.operators.index import RECORD, TOKEN

#: Other names of operators.
ALIASES = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "is_included": "in", "not_included": "nin"}


def record_id(spec: StoreSpec, df: DataFrame, outer: bool = False) -> Column:
    """``_id`` of each row, as text; ``outer`` for use in a subquery on the row."""
    column = lambda name: F.col(f"`{name}`").outer() if outer else F.col(f"`{name}`")
    if "_id" in df.columns:
        return column("_id")
    if spec.key:
        parts = [column(name).cast("string") for name in spec.key]
        return parts[0] if len(parts) == 1 else F.concat_ws("|", *parts)
    return F.sha2(F.to_json(F.struct(*(column(name).alias(name) for name in df.columns))), 256)


class FilterCompiler:
    """Turns filters of one store into columns."""

    def __init__(self, spec: StoreSpec, df: DataFrame) -> None:
        self.spec, self.df = spec, df
        self.types = {f.name: f.dataType for f in df.schema.fields}

    def column(self, filter_: Any) -> Column:
        """The predicate of a whole filter; without clauses, every record."""
        return F.lit(True) if not filter_ else self._all(filter_, 0)

    def _deeper(self, depth: int) -> None:
        if depth > self.spec.depth_limit:
            raise QueryError(f"the filter is more than {self.spec.depth_limit} levels deep")

    def _all(self, filter_: Any, depth: int) -> Column:
        self._deeper(depth)
        if isinstance(filter_, list):
            parts = [self._all(x, depth + 1) for x in filter_]
        elif isinstance(filter_, dict):
            parts = [self._clause(name, value, depth + 1) for name, value in filter_.items()]
        else:
            return F.lit(False)
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)

    def _clause(self, name: str, value: Any, depth: int) -> Column:
        self._deeper(depth)
        if name == "$and":
            return self._all(value, depth)
        if name == "$or":
            if not isinstance(value, list):
                raise QueryError("$or takes a list of filters")
            return any_of([self._all(x, depth + 1) for x in value])
        if name == "_id" or (name == "id" and "id" not in self.types and not self.spec.doc):
            return self._by_id(value)
        mode = self.spec.fields.get(name)
        if mode == "text" and name in self.spec.indexes and (found := self._indexed(self.spec.indexes[name], value)) is not None:
            return found
        return self._field_clause(self._field(name), mode, value)

    def _indexed(self, table: str, value: Any) -> Column | None:
        """Keywords, or ``contains`` alone, as lookups in token postings: each is a semi-join with the rows of some tokens, which the scan of the sorted table skips to."""
        if isinstance(value, list) and all(isinstance(x, str) for x in value):
            wanted = [tokens_of(x) for x in value]
        elif isinstance(value, dict) and list(value) == ["contains"] and isinstance(value["contains"], str):
            wanted = [[x] for x in sorted(set(tokens_of(value["contains"])))]
        else:
            return None
        if not wanted or not all(wanted):
            return F.lit(False)
        posted = self.df.sparkSession.read.parquet(table)
        own = record_id(self.spec, self.df, outer=True)
        return reduce(lambda a, b: a & b, [posted.where(F.col(TOKEN).isin(sorted(set(x))) & (F.col(RECORD) == own)).exists() for x in wanted])

    def text_of(self, name: str) -> Column:
        """A field as text, null where it is something else; what an index of the field is made from."""
        text = self._field(name).text()
        return F.lit(None).cast("string") if text is None else text

    def _field(self, name: str) -> TypedField | VariantField:
        path = self.spec.nested and "." in name
        if self.spec.doc:
            if "'" in name or '"' in name:
                raise QueryError(f"field names cannot hold quotes: {name}")
            body = F.col(f"`{self.spec.doc}`")
            if isinstance(self.types[self.spec.doc], T.StringType):
                body = F.try_parse_json(body)
            return VariantField(body, "$" + "".join(f"['{part}']" for part in (name.split(".") if path else [name])))
        parts = name.split(".") if path else [name]
        kind = self.types.get(parts[0])
        if kind is None:
            return MissingField()
        column = F.col(f"`{parts[0]}`")
        for part in parts[1:]:
            if not isinstance(kind, T.StructType) or part not in kind.names:
                return MissingField()
            column, kind = column.getField(part), kind[part].dataType
        return VariantField(column, "$") if isinstance(kind, T.VariantType) else TypedField(column, kind)

    def _by_id(self, value: Any) -> Column:
        """Clauses on the id. Texts that spell a value of a single key column compare with that column, which reaches the scan."""
        kind = self.types.get(self.spec.key[0]) if len(self.spec.key) == 1 and "_id" not in self.types else None
        if isinstance(kind, T.IntegralType):
            column = F.col(f"`{self.spec.key[0]}`")
            spelled = lambda x: int(x) if isinstance(x, str) and x.lstrip("-").isdecimal() and str(int(x)) == x else None
            if isinstance(value, str):
                return F.lit(False) if spelled(value) is None else column == spelled(value)
            wanted = value if isinstance(value, list) else value["in"] if isinstance(value, dict) and list(value) == ["in"] and isinstance(value["in"], list) else None
            if wanted is not None and all(isinstance(x, str) for x in wanted):
                known = [spelled(x) for x in wanted if spelled(x) is not None]
                return column.isin(known) if known else F.lit(False)
        return self._field_clause(TypedField(record_id(self.spec, self.df), T.StringType()), None, value)

    def _field_clause(self, field: TypedField | VariantField, mode: str | None, value: Any) -> Column:
        if isinstance(value, dict):
            parts = [part for op, operand in value.items() if (part := self._operator(field, mode, ALIASES.get(op, op), operand)) is not None]
            return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)
        if isinstance(value, list):
            return self._keywords(field, value) if mode == "text" else self._in(field, value)
        if family_of(value) == NUMBER and mode == "numeric":
            return field.as_number() == F.lit(number(value))
        if family_of(value) in (NUMBER, TEXT):
            return field.equals(value)
        return F.lit(False)

    def _operator(self, field: TypedField | VariantField, mode: str | None, op: str, operand: Any) -> Column | None:
        """One operator; None for an unknown one, which constrains nothing."""
        if op in (">", ">=", "<", "<="):
            if mode != "numeric":
                return field.compare(op, operand)
            try:
                bound = number(operand if isinstance(operand, int | float) else float(operand))
            except (TypeError, ValueError):
                raise QueryError(f"{operand!r} is no number") from None
            left = field.as_number()
            return {">": left > bound, ">=": left >= bound, "<": left < bound, "<=": left <= bound}[op]
        if op == "eq":
            return field.is_null() if operand is None else field.equals(operand)
        if op == "neq":
            return ~field.is_null() if operand is None else field.is_null() | ~F.coalesce(field.equals(operand), F.lit(False)) if isinstance(field, VariantField) else _differs(field, operand)
        if op == "in":
            return self._in(field, operand)
        if op == "nin":
            return self._not_in(field, operand)
        if op == "exists":
            return field.exists() if operand else ~field.exists()
        if op == "contains":
            return self._contains(field, mode, operand)
        return None

    def _in(self, field: TypedField | VariantField, values: Any) -> Column:
        if not isinstance(values, list | tuple):
            raise QueryError("in and nin take a list")
        found = field.is_in([x for x in values if x is not None])
        return found | field.is_null() if any(x is None for x in values) else found

    def _not_in(self, field: TypedField | VariantField, values: Any) -> Column:
        if not isinstance(values, list | tuple):
            raise QueryError("in and nin take a list")
        known = [x for x in values if x is not None]
        if isinstance(field, VariantField):
            absent = ~F.coalesce(field.is_in(known), F.lit(False))
        elif field.family in (NUMBER, TEXT):
            absent = ~field.is_in(known)
        else:
            absent = ~any_of([field.same(x) for x in known])
        return absent & ~field.is_null() if len(known) < len(values) else absent | field.is_null()

    def _contains(self, field: TypedField | VariantField, mode: str | None, operand: Any) -> Column:
        if not isinstance(operand, str):
            raise QueryError("contains takes a text")
        text = field.text()
        if text is None:
            return F.lit(False)
        return holds_all(text, tokens_of(operand)) if mode == "text" else F.contains(F.lower(text), F.lit(operand.lower()))

    def _keywords(self, field: TypedField | VariantField, values: list) -> Column:
        """Each keyword must be met by one of its tokens."""
        if not all(isinstance(x, str) for x in values):
            raise QueryError("keywords are texts")
        text = field.text()
        if text is None or not values:
            return F.lit(False)
        return reduce(lambda a, b: a & b, [holds_any(text, tokens_of(x)) for x in values])


def _differs(field: TypedField, operand: Any) -> Column:
    """``neq`` on a column: null differs from any value."""
    if field.family == ARRAY or family_of(operand) == ARRAY or field._pair(operand) is None:
        return field.is_null() | ~F.coalesce(field.equals(operand), F.lit(False))
    return ~field.same(operand)
