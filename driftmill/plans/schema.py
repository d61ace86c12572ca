"""Index mappings, templates and life-cycle policies to Spark schemas."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from ..config import Refused

#: Mapping types and the Spark types that hold them.
TYPES = {
    "long": T.LongType(), "integer": T.IntegerType(), "short": T.ShortType(), "byte": T.ByteType(), "unsigned_long": T.DecimalType(20, 0),
    "double": T.DoubleType(), "float": T.FloatType(), "half_float": T.FloatType(), "rank_feature": T.FloatType(), "boolean": T.BooleanType(),
    "binary": T.BinaryType(), "version": T.StringType(), "ip": T.StringType(), "token_count": T.LongType(), "murmur3": T.LongType(),
    "text": T.StringType(), "match_only_text": T.StringType(), "search_as_you_type": T.StringType(), "completion": T.StringType(),
    "keyword": T.StringType(), "constant_keyword": T.StringType(), "wildcard": T.StringType(), "date": T.TimestampType(), "date_nanos": T.TimestampType(),
    "flattened": T.MapType(T.StringType(), T.StringType()), "geo_point": T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]),
    "dense_vector": T.ArrayType(T.FloatType()),
}
_RANGES = {"integer_range": T.IntegerType(), "long_range": T.LongType(), "float_range": T.FloatType(), "double_range": T.DoubleType(), "date_range": T.TimestampType(), "ip_range": T.StringType()}
_TEXT = {"text", "match_only_text", "search_as_you_type"}


@dataclass
class TableSchema:
    schema: T.StructType
    text_fields: set[str] = field(default_factory=set)
    aliases: dict[str, str] = field(default_factory=dict)
    copies: dict[str, list[str]] = field(default_factory=dict)
    retention_days: int | None = None
    notes: list[str] = field(default_factory=list)


def spark_type(name: str, o: dict, notes: list[str]) -> T.DataType:
    kind = o.get("type", "object")
    if kind == "scaled_float":
        factor = float(o.get("scaling_factor", 1))
        digits = len(str(int(factor))) - 1
        return T.DecimalType(18, digits) if factor == 10**digits else T.DoubleType()
    if kind in _RANGES:
        return T.StructType([T.StructField("gte", _RANGES[kind]), T.StructField("lte", _RANGES[kind])])
    if kind == "date_nanos":
        notes.append(f"{name}: nanoseconds are cut to microseconds")
    if kind not in TYPES:
        raise Refused(f"{name}: type {kind!r} isn't supported")
    return TYPES[kind]


def from_mapping(mapping: dict) -> TableSchema:
    """A table of a mapping's properties; sub-fields under ``fields`` are the same column."""
    root = mapping.get("mappings", mapping)
    out = TableSchema(T.StructType())

    def fields(props: dict, path: str) -> list[T.StructField]:
        made = []
        for name, o in props.items():
            full = f"{path}{name}"
            kind = o.get("type", "object")
            if kind == "alias":
                out.aliases[full] = o["path"]
                continue
            for target in o.get("copy_to", []) if isinstance(o.get("copy_to"), list) else [o["copy_to"]] if "copy_to" in o else []:
                out.copies.setdefault(target, []).append(full)
            if kind in ("object", "nested"):
                if not o.get("properties") or o.get("dynamic") == "true" and not o["properties"]:
                    inner: T.DataType = T.MapType(T.StringType(), T.StringType())
                else:
                    inner = T.StructType(fields(o["properties"], full + "."))
                made.append(T.StructField(name, T.ArrayType(inner) if kind == "nested" else inner))
                continue
            if kind in _TEXT:
                out.text_fields.add(full)
            made.append(T.StructField(name, spark_type(full, o, out.notes)))
        return made

    out.schema = T.StructType(fields(root.get("properties", {}), ""))
    return out


def merge(a: dict, b: dict) -> dict:
    """b over a, objects merged at every depth."""
    return {k: merge(a[k], b[k]) if k in a and k in b and isinstance(a[k], dict) and isinstance(b[k], dict) else b.get(k, a.get(k)) for k in {**a, **b}}


def retention(policy: dict) -> int | None:
    """Days after which a policy deletes."""
    age = (policy.get("policy", policy).get("phases", {}).get("delete") or {}).get("min_age")
    m = re.fullmatch(r"(\d+)(d|h|m|s)", age or "")
    return None if not m else int(m[1]) if m[2] == "d" else int(m[1]) // {"h": 24, "m": 1440, "s": 86400}[m[2]]


def read_console(text: str) -> dict[str, TableSchema]:
    """Tables of console requests: PUT _ilm/policy, _component_template, _index_template and indices."""
    parts = re.split(r"(?m)^(?:PUT|POST)\s+/?(\S+)\s*$", text)[1:]
    policies, components, out = {}, {}, {}
    for path, body in zip(parts[::2], parts[1::2]):
        o = json.loads(re.sub(r'"""(.*?)"""', lambda m: json.dumps(m[1]), body, flags=re.S))
        *head, name = path.split("/")
        if head[:2] == ["_ilm", "policy"]:
            policies[name] = o
        elif head == ["_component_template"]:
            components[name] = o["template"]
        else:
            whole: dict = {}
            for c in o.get("composed_of", []):
                whole = merge(whole, components.get(c, {}))
            whole = merge(whole, o.get("template", o))
            table = from_mapping(whole.get("mappings", {}))
            settings = whole.get("settings", {})
            flat = settings.get("index.lifecycle.name") or (settings.get("index", settings).get("lifecycle") or {}).get("name")
            table.retention_days = retention(policies[flat]) if flat in policies else None
            out[",".join(o.get("index_patterns", [name]))] = table
    return out
