"""Field names to Columns, with exact rules for absence and for fields of several values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EngineConfig
from ..functions import dates


@dataclass
class Field:
    """A resolved field; ``dtype`` is that of one value, ``array`` whether there can be several."""

    name: str
    column: Column
    dtype: T.DataType
    array: bool = False
    text: bool = False
    empty_as_missing: bool = False

    @property
    def kind(self) -> str:
        d = self.dtype
        if isinstance(d, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return "date"
        if isinstance(d, T.BooleanType):
            return "bool"
        if isinstance(d, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return "int"
        if isinstance(d, (T.FloatType, T.DoubleType, T.DecimalType)):
            return "float"
        return "string" if isinstance(d, (T.StringType, T.VarcharType, T.CharType)) else "other"

    def any_value(self, test: Callable[[Column], Column]) -> Column:
        """Whether any value passes; an absent field passes nothing."""
        return F.exists(self.column, test) if self.array else test(self.column)

    def missing(self) -> Column:
        if self.array:
            return self.column.isNull() | (F.size(F.filter(self.column, lambda v: v.isNotNull())) == 0)
        if self.empty_as_missing and self.kind == "string":
            return self.column.isNull() | (self.column == "")
        return self.column.isNull()

    def present(self) -> Column:
        return ~self.missing()

    def literal(self, value, up: bool = False, now: datetime | None = None, tz: str | None = None, fmt: str | None = None) -> Column:
        """A request's value in this field's type."""
        if value is None:
            return F.lit(None)
        if self.kind == "date":
            return moment_literal(dates.moment(value, now or datetime.now(UTC), up, tz, fmt), self.dtype)
        if self.kind == "bool":
            return F.lit(value if isinstance(value, bool) else str(value).lower() == "true")
        if self.kind in ("int", "float"):
            if isinstance(value, bool):
                return F.lit(int(value))
            number = float(value) if not isinstance(value, int) else value
            return F.lit(int(number) if self.kind == "int" and float(number).is_integer() else number)
        return F.lit(str(value).lower() if isinstance(value, bool) else str(value))


def moment_literal(at: datetime, dtype: T.DataType) -> Column:
    text = at.astimezone(UTC).strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(dtype, T.TimestampNTZType):
        return F.expr(f"TIMESTAMP_NTZ'{text}'")
    stamp = F.expr(f"TIMESTAMP'{text}Z'")
    return stamp.cast("date") if isinstance(dtype, T.DateType) else stamp


class Resolver:
    """Finds fields of a DataFrame: aliases, .keyword, dotted columns, struct paths, attribute columns."""

    def __init__(self, df: DataFrame, config: EngineConfig):
        self.df, self.config = df, config
        self.schema = {f.name: f.dataType for f in df.schema.fields}
        self.bound: dict[str, tuple[Column, T.DataType]] = {}  # elements inside a nested query

    def get(self, name: str) -> Field:
        name = self.config.field_mapping.get(name, name)
        for candidate in dict.fromkeys((name, name.removesuffix(".keyword"))):
            found = self._lookup(candidate)
            if found:
                column, dtype = found
                array = isinstance(dtype, T.ArrayType)
                return Field(candidate, column, dtype.elementType if array else dtype, array, candidate in self.config.text_fields and not name.endswith(".keyword"), self.config.empty_as_missing)
        raise KeyError(name)

    def find(self, name: str) -> Field:
        """A field, or one without any value where the name is unknown."""
        try:
            return self.get(name)
        except KeyError:
            return Field(name, F.lit(None).cast("string"), T.StringType())

    def _lookup(self, name: str) -> tuple[Column, T.DataType] | None:
        for prefix, (column, dtype) in self.bound.items():
            if name == prefix or name.startswith(prefix + "."):
                return self._path(column, dtype, name[len(prefix) + 1 :])
        if name in self.schema:
            return F.col(f"`{name}`"), self.schema[name]
        best = max((g for g in self.config.attributes if fnmatchcase(name, g)), key=lambda g: len(g.replace("*", "")), default=None)
        if best is not None:
            holder = self.config.attributes[best]
            fixed = best.split("*")[0]
            key = name[len(fixed) :] if fixed.endswith(".") else name
            if holder in self.schema:
                if isinstance(self.schema[holder], T.MapType):
                    return F.try_element_at(F.col(f"`{holder}`"), F.lit(key)), self.schema[holder].valueType
                return F.get_json_object(F.col(f"`{holder}`").cast("string"), "$['" + key + "']"), T.StringType()
        head, _, rest = name.partition(".")
        while rest:
            if head in self.schema:
                return self._path(F.col(f"`{head}`"), self.schema[head], rest)
            more, _, rest = rest.partition(".")
            head = f"{head}.{more}"
        return None

    def _path(self, column: Column, dtype: T.DataType, rest: str) -> tuple[Column, T.DataType] | None:
        if not rest:
            return column, dtype
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                if rest == f.name or rest.startswith(f.name + "."):
                    return self._path(column.getField(f.name), f.dataType, rest[len(f.name) + 1 :])
            return None
        if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
            inner = self._path(F.lit(None), dtype.elementType, rest)
            if inner is None:
                return None
            return F.transform(column, lambda e: self._path(e, dtype.elementType, rest)[0]), T.ArrayType(inner[1])
        if isinstance(dtype, T.MapType):
            return F.try_element_at(column, F.lit(rest)), dtype.valueType
        return None
