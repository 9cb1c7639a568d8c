"""Fields of a store as typed operands of predicates.

Documents have no schema, so a comparison first asks of which family (number, text, array, ...) field and literal are.
Families that differ are unequal and have no order. Predicates may be null where the field is null: a filter takes null
for false, and only the negations below must say what they mean for nulls.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.errors import QueryError

NUMBER, TEXT, TIME, ARRAY, OTHER = "number", "text", "time", "array", "other"
_INT64 = range(-(2**63), 2**63)


def family_of(value: Any) -> str:
    """Of a literal. A boolean is a number, as true equals 1."""
    if isinstance(value, int | float):
        return NUMBER
    if isinstance(value, str):
        return TEXT
    return ARRAY if isinstance(value, list | tuple) else OTHER


def number(value: float) -> int | float:
    """A number as the literal that compares with integer columns without a cast, if there is one."""
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**53:
        return int(value)
    return value if isinstance(value, float) or value in _INT64 else float(value)


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


class TypedField:
    """A column with a type."""

    def __init__(self, column: Column, kind: T.DataType) -> None:
        self.column, self.kind = column, kind
        if isinstance(kind, T.BooleanType):
            self.family = NUMBER
        elif isinstance(kind, T.NumericType):
            self.family = NUMBER
        elif isinstance(kind, T.StringType):
            self.family = TEXT
        elif isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
            self.family = TIME
        else:
            self.family = ARRAY if isinstance(kind, T.ArrayType) else OTHER

    def is_null(self) -> Column:
        return self.column.isNull()

    def exists(self) -> Column:
        """Neither null nor an empty string or array."""
        if self.family == TEXT:
            return self.column.isNotNull() & (self.column != "")
        if self.family == ARRAY:
            return self.column.isNotNull() & (F.size(self.column) > 0)
        return self.column.isNotNull()

    def text(self) -> Column | None:
        """The field where it is text, else None."""
        return self.column if self.family == TEXT else None

    def as_number(self) -> Column:
        """The field as a number, whatever it is: text is read, what is no number is null."""
        if isinstance(self.kind, T.BooleanType):
            return self.column.cast("int")
        return self.column if self.family == NUMBER else self.column.try_cast("double")

    def _pair(self, value: Any) -> tuple[Column, Column] | None:
        """Field and literal as comparable columns; None if their families differ."""
        family = family_of(value)
        if family == NUMBER == self.family:
            return self.as_number(), F.lit(number(value))
        if family == TEXT and self.family == TEXT:
            return self.column, F.lit(value)
        if family == TEXT and self.family == TIME:
            return self.column, F.lit(value).try_cast(self.kind)
        return None

    def equals(self, value: Any) -> Column:
        """Equality with a value that is not null."""
        if pair := self._pair(value):
            return pair[0] == pair[1]
        if family_of(value) == ARRAY == self.family:
            inner = TypedField(F.lit(None), self.kind.elementType)
            if any(x is not None and inner._pair(x) is None for x in value):
                return F.lit(False)
            wanted = F.array(*(F.lit(None if x is None else number(x) if family_of(x) == NUMBER else x).cast(self.kind.elementType) for x in value)).cast(self.kind)
            return self.column == wanted
        return F.lit(False)

    def same(self, value: Any) -> Column:
        """Equality that is never null, for negations. A text that is no time equals nothing, whatever the field holds."""
        if not (pair := self._pair(value)):
            return F.coalesce(self.equals(value), F.lit(False))
        left, right = pair
        return left.eqNullSafe(right) & right.isNotNull()  # a literal on the right, so the second half folds away

    def is_in(self, values: list) -> Column:
        """Equality with one of some values that are not null."""
        if self.family in (NUMBER, TEXT) and (same := [x for x in values if family_of(x) == self.family]):
            return self.as_number().isin([number(x) for x in same]) if self.family == NUMBER else self.column.isin(same)
        return any_of([self.equals(x) for x in values if self.family not in (NUMBER, TEXT)])

    def compare(self, sign: str, value: Any) -> Column:
        if not (pair := self._pair(value)):
            raise QueryError(f"{value!r} has no order with a field of type {self.kind.simpleString()}")
        return ordered(sign, *pair)


class VariantField:
    """A path in a VARIANT body; every row may hold another family, so each test checks the family of its row."""

    def __init__(self, body: Column, path: str) -> None:
        self.body, self.path = body, path
        self.family = OTHER

    def _kind(self) -> Column:
        return F.schema_of_variant(F.try_variant_get(self.body, self.path, "variant"))

    def _is(self, family: str) -> Column:
        pattern = {NUMBER: "^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)", TEXT: "^STRING", ARRAY: "^ARRAY"}[family]
        return self._kind().rlike(pattern)

    def _get(self, kind: str) -> Column:
        return F.try_variant_get(self.body, self.path, kind)

    def is_null(self) -> Column:
        kind = self._kind()
        return kind.isNull() | (kind == "VOID")

    def exists(self) -> Column:
        kind = self._kind()
        filled = F.when(kind == "STRING", self._get("string") != "").when(kind.startswith("ARRAY"), kind != "ARRAY<VOID>").otherwise(kind != "VOID")
        nothing_but_nulls = (kind == "ARRAY<VOID>") & (F.size(self._get("array<string>")) > 0)
        return F.coalesce(filled | nothing_but_nulls, F.lit(False))

    def text(self) -> Column:
        return F.when(self._is(TEXT), self._get("string"))

    def as_number(self) -> Column:
        return self._get("double")

    def _pair(self, value: Any) -> tuple[Column, Column] | None:
        family = family_of(value)
        if family == NUMBER:
            return F.when(self._is(NUMBER), self._get("double")), F.lit(float(value))
        return (self.text(), F.lit(value)) if family == TEXT else None

    def equals(self, value: Any) -> Column:
        if pair := self._pair(value):
            return pair[0] == pair[1]
        if family_of(value) == ARRAY:
            families = {family_of(x) for x in value if x is not None}
            if families <= {NUMBER} and families:
                return F.when(self._is(ARRAY), self._get("array<double>")) == F.array(*(F.lit(None if x is None else float(x)).cast("double") for x in value))
            if families <= {TEXT}:
                return F.when(self._is(ARRAY), self._get("array<string>")) == F.array(*(F.lit(x).cast("string") for x in value)).cast("array<string>")
        return F.lit(False)

    def is_in(self, values: list) -> Column:
        parts = []
        if numbers := [float(x) for x in values if family_of(x) == NUMBER]:
            parts.append(F.when(self._is(NUMBER), self._get("double")).isin(numbers))
        if texts := [x for x in values if family_of(x) == TEXT]:
            parts.append(self.text().isin(texts))
        return any_of(parts + [self.equals(x) for x in values if family_of(x) == ARRAY])

    def compare(self, sign: str, value: Any) -> Column:
        if not (pair := self._pair(value)):
            raise QueryError(f"{value!r} has no order")
        return ordered(sign, *pair)


class MissingField(TypedField):
    """A field that no record has: null everywhere."""

    def __init__(self) -> None:
        super().__init__(F.lit(None).cast("string"), T.NullType())

    def compare(self, sign: str, value: Any) -> Column:
        return F.lit(False)


def ordered(sign: str, left: Column, right: Column) -> Column:
    return {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[sign]
