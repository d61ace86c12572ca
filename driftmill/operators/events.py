"""Events as rows: every field is a column, nested fields have dotted names, absent fields are null.

A change under a condition keeps the old value where the condition fails; where the two have
different types, both become text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRUE = None  # a guard that always holds


def field_name(reference: str) -> str:
    """[a][b] or a as a dotted name."""
    parts = re.findall(r"\[([^\[\]]+)\]", reference)
    return ".".join(parts) if parts and reference.startswith("[") else reference


class Events:
    """A DataFrame of events and the changes that steps make to it."""

    def __init__(self, df: DataFrame):
        self.df = flatten(df)
        self.path: tuple = ()  # the branches that are open, each as (its if, its arm)
        self.born: dict[str, list[tuple]] = {}  # the branches in which a field got values

    @property
    def names(self) -> list[str]:
        return self.df.columns

    def has(self, name: str) -> bool:
        return name in self.df.columns

    def under(self, name: str) -> list[str]:
        return [c for c in self.names if c == name or c.startswith(name + ".")]

    def dtype(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType if self.has(name) else T.NullType()

    def is_array(self, name: str) -> bool:
        return isinstance(self.dtype(name), T.ArrayType)

    def is_string(self, name: str) -> bool:
        return isinstance(self.dtype(name), T.StringType)

    def get(self, name: str) -> Column:
        return F.col(f"`{name}`") if self.has(name) else F.lit(None).cast("string")

    def text(self, name: str) -> Column:
        """A field as text, list values joined by commas."""
        c = self.get(name)
        if self.is_array(name):
            return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
        return c.cast("string")

    def present(self, name: str) -> Column:
        """Whether a field, or any field below it, has a value."""
        below = self.under(name)
        if not below:
            return F.lit(False)
        out = self.get(below[0]).isNotNull()
        for n in below[1:]:
            out = out | self.get(n).isNotNull()
        return out

    def exclusive(self, name: str) -> bool:
        """Whether all that set a field did so in other arms of an open branch, so that it has no value here."""
        here = dict(self.path)
        paths = self.born.get(name, [()])
        return all(any(here.get(branch, arm) != arm for branch, arm in path) for path in paths)

    def set(self, name: str, value: Column, guard: Column | None = TRUE) -> Events:
        return self.set_all({name: value}, guard)

    def set_all(self, values: dict[str, Column], guard: Column | None = TRUE) -> Events:
        """Give fields new values where the guard holds; all are read before any is written."""
        if not values:
            return self
        kinds = self.df.select(*(v.alias(f"c{i}") for i, v in enumerate(values.values()))).schema
        made = {}
        for (name, value), kind in zip(values.items(), kinds):
            if not self.has(name) or name in self.born:
                self.born.setdefault(name, []).append(self.path)
            if guard is not None:
                old = self.get(name)
                if self.has(name) and self.dtype(name) != kind.dataType and not isinstance(kind.dataType, T.NullType):
                    if isinstance(self.dtype(name), T.ArrayType) and not isinstance(kind.dataType, T.ArrayType):
                        old, value = F.to_json(old), value.cast("string")
                    elif isinstance(self.dtype(name), T.ArrayType) != isinstance(kind.dataType, T.ArrayType):
                        old, value = self._as_list(old, self.dtype(name)), self._as_list(value, kind.dataType)
                    else:
                        old, value = old.cast("string"), value.cast("string")
                elif not self.has(name):
                    old = F.lit(None).cast(kind.dataType)
                value = F.when(F.coalesce(guard, F.lit(False)), value).otherwise(old)
            made[name] = value
        known = {c.lower(): c for c in self.df.columns}
        columns = [made.pop(c).alias(c) if c in made else F.col(f"`{c}`") for c in self.df.columns]
        if any(n.lower() in known for n in made):
            raise ValueError(f"field names that differ in case only: {sorted(made)}")
        self.df = self.df.select(*columns, *(v.alias(n) for n, v in made.items()))
        return self

    def _as_list(self, c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda v: v.cast("string"))
        return F.when(c.isNotNull(), F.array(c.cast("string")))

    def remove(self, name: str, guard: Column | None = TRUE) -> Events:
        below = self.under(name)
        if guard is None:
            self.df = self.df.drop(*(f"{c}" for c in below)) if below else self.df
            return self
        return self.set_all({c: F.lit(None).cast(self.dtype(c)) for c in below}, guard)

    def where(self, keep: Column) -> Events:
        self.df = self.df.where(keep)
        return self

    def add_tags(self, tags: list[str], guard: Column | None = TRUE) -> Events:
        """Append tags that an event doesn't have."""
        if not tags:
            return self
        old = F.coalesce(self.get("tags") if self.is_array("tags") else F.when(self.get("tags").isNotNull(), F.array(self.get("tags").cast("string"))), F.array().cast("array<string>"))
        return self.set("tags", F.concat(old, F.array_except(F.array(*(F.lit(t) for t in tags)), old)), guard)

    def append(self, name: str, value: Column, guard: Column | None = TRUE) -> Events:
        """A field that has a value becomes a list that ends with the new one."""
        if not self.has(name):
            return self.set(name, value, guard)
        old = self._as_list(self.get(name), self.dtype(name))
        if self.is_array(name):
            return self.set(name, F.concat(F.coalesce(old, F.array().cast("array<string>")), F.array(value.cast("string"))), guard)
        self.df = self.df.withColumn(name, F.when(F.coalesce(guard, F.lit(False)) if guard is not None else F.lit(True), F.concat(F.coalesce(old, F.array().cast("array<string>")), F.array(value.cast("string")))).otherwise(old))
        return self


def flatten(df: DataFrame) -> DataFrame:
    """Struct columns as dotted columns, at any depth."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        out = []
        for f in df.schema.fields:
            c = F.col(f"`{f.name}`")
            out += [c.getField(g.name).alias(f"{f.name}.{g.name}") for g in f.dataType.fields] if isinstance(f.dataType, T.StructType) else [c]
        df = df.select(*out)
    return df


def nest(df: DataFrame) -> DataFrame:
    """Dotted columns as structs again."""

    def build(names: list[tuple[list[str], str]]) -> list[Column]:
        heads: dict[str, list[tuple[list[str], str]]] = {}
        for parts, full in names:
            heads.setdefault(parts[0], []).append((parts[1:], full))
        return [(F.col(f"`{rest[0][1]}`") if len(rest) == 1 and not rest[0][0] else F.struct(*build([r for r in rest if r[0]]))).alias(head) for head, rest in heads.items()]

    return df.select(*build([(c.split("."), c) for c in df.columns]))


def json_text(events: Events) -> Column:
    """The whole event as JSON, without @metadata and null fields."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in events.names if not c.startswith("@metadata"))))


def number(c: Column) -> Column:
    return c.cast("string").try_cast("double")


def interpolate(events: Events, template: str, time_field: str = "@timestamp") -> Column:
    """%{field} and %{+format} in a text; an absent field leaves its reference as it stands."""
    parts, at = [], 0
    for m in re.finditer(r"%\{([^}]+)\}", template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        ref = m[1]
        if ref.startswith("+"):
            at_time = events.get(time_field).cast("timestamp")
            parts.append(F.unix_seconds(at_time).cast("string") if ref == "+%s" else F.coalesce(F.date_format(at_time, ref[1:].replace("Y", "y")), F.lit(m[0])))
        else:
            parts.append(F.coalesce(events.text(field_name(ref)), F.lit(m[0])))
        at = m.end()
    if at < len(template) or not parts:
        parts.append(F.lit(template[at:]))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def parse_json(c: Column) -> Column:
    """A text's JSON as a map of field to JSON text; null unless it is an object."""
    return F.when(F.try_parse_json(c).isNotNull() & c.rlike(r"(?s)^\s*\{.*\}\s*$"), F.from_json(c, "map<string,string>"))
