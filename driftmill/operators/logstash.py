"""Logstash pipelines: the configuration language, and its filters as column changes."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Refused
from ..functions import grok
from .events import Events, field_name, interpolate, number

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')
    |(?P<ref>\[[^\[\]\s"',]+\](?:\[[^\[\]\s"',]+\])*)
    |(?P<op>=>|==|!=|<=|>=|=~|!~|[{}()\[\],<>!])
    |(?P<rx>/(?:\\.|[^/\\])+/)
    |(?P<num>-?\d+(?:\.\d+)?(?![\w.]))
    |(?P<word>[A-Za-z_@][\w\-.@]*)""",
    re.X,
)


@dataclass
class Plugin:
    name: str
    options: list[tuple[str, object]] = field(default_factory=list)

    def get(self, key: str, default=None):
        values = [v for k, v in self.options if k == key]
        if not values:
            return default
        if len(values) > 1 and all(isinstance(v, list) for v in values):
            return [x for v in values for x in v]
        if len(values) > 1 and all(isinstance(v, dict) for v in values):
            return {k: x for v in values for k, x in v.items()}
        return values[-1]


@dataclass
class Branches:
    """if / else if / else: (condition or None, body) in order."""

    arms: list[tuple[tuple | None, list]]


class Parser:
    def __init__(self, source: str):
        self.items, at = [], 0
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise Refused(f"configuration can't be read at {source[at:at + 30]!r}")
            if m.lastgroup:
                self.items.append((m.lastgroup, m[0]))
            at = m.end()
        self.items.append(("end", ""))
        self.at = 0

    def peek(self, *texts: str) -> bool:
        return self.items[self.at][0] in ("op", "word") and self.items[self.at][1] in texts

    def take(self, text: str) -> bool:
        if self.peek(text):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise Refused(f"configuration needs {text!r} before {self.items[self.at][1]!r}")

    def config(self) -> dict[str, list]:
        out: dict[str, list] = {"input": [], "filter": [], "output": []}
        while self.items[self.at][0] != "end":
            section = self.items[self.at][1]
            if section not in out:
                raise Refused(f"unknown section {section!r}")
            self.at += 1
            out[section] += self.block()
        return out

    def block(self) -> list:
        self.need("{")
        out = []
        while not self.take("}"):
            if self.take("if"):
                arms = [(self.condition(), self.block())]
                while self.take("else"):
                    if self.take("if"):
                        arms.append((self.condition(), self.block()))
                    else:
                        arms.append((None, self.block()))
                        break
                out.append(Branches(arms))
                continue
            kind, name = self.items[self.at]
            if kind != "word":
                raise Refused(f"configuration has {name!r} where a plugin is expected")
            self.at += 1
            plugin = Plugin(name)
            self.need("{")
            while not self.take("}"):
                key = self.value()
                self.need("=>")
                plugin.options.append((str(key), self.value()))
                self.take(",")
            out.append(plugin)
        return out

    def value(self):
        kind, text = self.items[self.at]
        self.at += 1
        if kind == "str":
            return re.sub(r'\\(["\'\\])', r"\1", text[1:-1])
        if kind == "num":
            return float(text) if "." in text else int(text)
        if kind == "word":
            if self.items[self.at] == ("op", "{"):
                self.at -= 1
                return self.plugin_value()
            return {"true": True, "false": False}.get(text, text)
        if kind == "ref":  # a list of one bare word, or a field reference
            return [text[1:-1]] if text.count("[") == 1 and not text.startswith("[@") else text
        if text == "[":
            out = []
            while not self.take("]"):
                out.append(self.value())
                self.take(",")
            return out
        if text == "{":
            pairs = {}
            while not self.take("}"):
                key = self.value()
                self.need("=>")
                value = self.value()
                key = "".join(f"[{k}]" for k in key) if isinstance(key, list) else str(key)
                pairs[key] = value
                self.take(",")
            return pairs
        raise Refused(f"configuration has {text!r} where a value is expected")

    def plugin_value(self):
        name = self.items[self.at][1]
        self.at += 1
        self.need("{")
        plugin = Plugin(name)
        while not self.take("}"):
            key = self.value()
            self.need("=>")
            plugin.options.append((str(key), self.value()))
        return plugin

    def condition(self) -> tuple:
        left = self.conjunction()
        while self.peek("or", "xor", "nand"):
            op = self.items[self.at][1]
            self.at += 1
            left = (op, left, self.conjunction())
        return left

    def conjunction(self) -> tuple:
        left = self.test()
        while self.take("and"):
            left = ("and", left, self.test())
        return left

    def test(self) -> tuple:
        if self.take("!"):
            return ("not", self.test())
        if self.take("("):
            inner = self.condition()
            self.need(")")
            return inner
        left = self.operand()
        for op in ("==", "!=", "<=", ">=", "<", ">", "=~", "!~"):
            if self.take(op):
                return (op, left, self.operand())
        if self.take("in"):
            return ("in", left, self.operand())
        if self.peek("not") and self.items[self.at + 1] == ("word", "in"):
            self.at += 2
            return ("not", ("in", left, self.operand()))
        return ("truthy", left)

    def operand(self) -> tuple:
        kind, text = self.items[self.at]
        if kind == "ref":
            self.at += 1
            return ("field", field_name(text))
        if kind == "rx":
            self.at += 1
            return ("value", text[1:-1].replace("\\/", "/"))
        if (kind, text) == ("op", "["):
            return ("list", self.value())
        return ("value", self.value())


def parse(source: str) -> dict[str, list]:
    return Parser(source).config()


# ---------------------------------------------------------------- conditions


def condition(e: Events, c: tuple) -> Column:
    """A condition as a Column that is never null."""
    match c[0]:
        case "and":
            return condition(e, c[1]) & condition(e, c[2])
        case "or":
            return condition(e, c[1]) | condition(e, c[2])
        case "xor":
            return condition(e, c[1]) != condition(e, c[2])
        case "nand":
            return ~(condition(e, c[1]) & condition(e, c[2]))
        case "not":
            return ~condition(e, c[1])
        case "truthy":
            kind, name = c[1]
            if kind != "field":
                return F.lit(bool(name))
            if not e.has(name):
                return e.present(name)
            v = e.get(name)
            return F.coalesce(~F.lower(e.text(name)).isin("false", "") if not e.is_array(name) else v.isNotNull(), F.lit(False))
    op, left, right = c
    if op == "in":
        if right[0] == "field":
            name = right[1]
            value = operand_text(e, left)
            if e.is_array(name):
                return F.coalesce(F.array_contains(F.transform(e.get(name), lambda v: v.cast("string")), value), F.lit(False))
            return F.coalesce(F.contains(e.text(name), value), F.lit(False))
        values = right[1] if isinstance(right[1], list) else [right[1]]
        text = operand_text(e, left)
        return F.coalesce(text.isin([str(v) for v in values]) if right[0] == "list" or isinstance(right[1], list) else F.contains(F.lit(str(right[1])), text), F.lit(False))
    if op in ("=~", "!~"):
        found = F.coalesce(operand_text(e, left).rlike(str(right[1])), F.lit(False))
        return found if op == "=~" else ~found
    a, b = operand_text(e, left), operand_text(e, right)
    if op in ("==", "!="):
        plain = any(k == "value" and not isinstance(v, (int, float)) for k, v in (left, right))
        same = a.eqNullSafe(b) if plain else (a.eqNullSafe(b) | F.coalesce(number(a) == number(b), F.lit(False)))
        return same if op == "==" else ~same
    numeric = any(k == "value" and isinstance(v, (int, float)) for k, v in (left, right)) or all(k == "field" and isinstance(e.dtype(v), T.NumericType) for k, v in (left, right))
    x, y = (number(a), number(b)) if numeric else (a, b)
    return F.coalesce({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], F.lit(False))


def operand_text(e: Events, o: tuple) -> Column:
    kind, v = o
    if kind == "field":
        return e.text(v)
    return F.lit(("true" if v else "false") if isinstance(v, bool) else str(v))


# ---------------------------------------------------------------- filters


def both(a: Column | None, b: Column | None) -> Column | None:
    return b if a is None else a if b is None else a & b


def run_filters(e: Events, body: list, guard: Column | None = None) -> Events:
    """Filters in order; a branch's condition is fixed in a column of its own before the branch runs."""
    for k, step in enumerate(body):
        if isinstance(step, Plugin):
            made = FILTERS.get(step.name)
            if made is None:
                raise Refused(f"filter {step.name!r} isn't supported")
            e = made(e, step, guard) or e
            continue
        open_, names = guard, []
        for i, (test, arm) in enumerate(step.arms):
            holds = condition(e, test) if test is not None else F.lit(True)
            for n in names:
                holds = ~F.col(f"`{n}`") & holds
            name = f"@metadata._arm{id(step) % 100000}_{i}"
            holds = both(open_, holds)
            e.df = e.df.withColumn(name, F.coalesce(holds, F.lit(False)))
            names.append(name)
        outer = e.path
        for i, (name, (_, arm)) in enumerate(zip(names, step.arms)):
            e.path = (*outer, (id(step), i))
            e = run_filters(e, arm, F.col(f"`{name}`"))
        e.path = outer
        e.df = e.df.drop(*names)
    return e


def common(e: Events, p: Plugin, guard: Column | None) -> Events:
    """What every filter does on success: add_field, remove_field, add_tag, remove_tag."""
    for name, value in (p.get("add_field") or {}).items():
        for v in value if isinstance(value, list) else [value]:
            target, made = field_name(name), interpolate(e, str(v))
            if e.has(target) and not e.exclusive(target):
                e = e.append(target, made, guard)
            else:
                e = e.set(target, made, guard)
    for name in _list(p.get("remove_field")):
        e = e.remove(field_name(name), guard)
    tags = [t for t in _list(p.get("add_tag"))]
    if tags:
        e = e.add_tags(tags, guard)
    if gone := _list(p.get("remove_tag")):
        if e.is_array("tags"):
            e = e.set("tags", F.array_except(e.get("tags"), F.array(*(F.lit(t) for t in gone))), guard)
    return e


def _list(v) -> list:
    return [] if v is None else v if isinstance(v, list) else [v]


def _pairs(v) -> list[tuple[str, object]]:
    if isinstance(v, dict):
        return list(v.items())
    v = _list(v)
    return list(zip(v[::2], v[1::2]))


def f_mutate(e: Events, p: Plugin, guard):
    """Operations in their fixed order: coerce rename update replace convert gsub uppercase capitalize lowercase strip remove split join merge copy."""
    for name, v in _pairs(p.get("coerce")):
        n = field_name(name)
        if e.has(n):
            e = e.set(n, F.coalesce(e.get(n), F.lit(v).cast(e.dtype(n))), guard)
    for old, new in _pairs(p.get("rename")):
        o, n = field_name(old), field_name(str(new))
        for c in e.under(o):
            to = n + c[len(o) :]
            e = e.set(to, e.get(c), both(guard, e.get(c).isNotNull())).remove(c, guard)
    for name, v in _pairs(p.get("update")):
        n = field_name(name)
        if e.has(n):
            e = e.set(n, interpolate(e, str(v)), both(guard, e.get(n).isNotNull()))
    for name, v in _pairs(p.get("replace")):
        e = e.set(field_name(name), interpolate(e, str(v)), guard)
    for name, kind in _pairs(p.get("convert")):
        n = field_name(name)
        if e.has(n):
            e = e.set(n, converted(e, n, str(kind)), guard)
    triples = _list(p.get("gsub"))
    for name, rx, to in zip(triples[::3], triples[1::3], triples[2::3]):
        e = on_text(e, field_name(name), lambda c, rx=rx, to=to: F.regexp_replace(c, rx, re.sub(r"\\(\d)", r"$\1", to.replace("$", "\\$"))), guard)
    for op, made in (("uppercase", F.upper), ("capitalize", lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))), ("lowercase", F.lower), ("strip", lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""))):
        for name in _list(p.get(op)):
            e = on_text(e, field_name(name), made, guard)
    for name in _list(p.get("remove")):
        e = e.remove(field_name(name), guard)
    for name, sep in _pairs(p.get("split")):
        n = field_name(name)
        if e.is_string(n):
            parts = F.split(e.get(n), re.escape(str(sep)) if sep != " " else r"\s+")
            e = e.set(n, without_empty_tail(F.filter(parts, lambda x: x != "") if sep == " " else parts), guard)
    for name, sep in _pairs(p.get("join")):
        n = field_name(name)
        if e.is_array(n):
            e = e.set(n, F.array_join(F.transform(e.get(n), lambda v: v.cast("string")), str(sep)), guard)
    for into, source in _pairs(p.get("merge")):
        n = field_name(into)
        for s in _list(source):
            s = field_name(s)
            if e.has(n) and e.has(s):
                a, b = (e._as_list(e.get(x), e.dtype(x)) for x in (n, s))
                empty = F.array().cast("array<string>")
                merged = F.concat(F.coalesce(a, empty), F.coalesce(b, empty))
                e.df = e.df.withColumn(n, F.when(F.coalesce(guard, F.lit(False)) if guard is not None else F.lit(True), merged).otherwise(a))
            elif e.has(s):
                e = e.set(n, e._as_list(e.get(s), e.dtype(s)), guard)
    for old, new in _pairs(p.get("copy")):
        o = field_name(old)
        for c in e.under(o):
            e = e.set(field_name(str(new)) + c[len(o) :], e.get(c), both(guard, e.get(c).isNotNull()))
    return common(e, p, guard)


def on_text(e: Events, name: str, made, guard) -> Events:
    """A change of a text, or of each text of a list; other types are left alone."""
    if e.is_string(name):
        return e.set(name, made(e.get(name)), guard)
    if e.is_array(name) and isinstance(e.dtype(name).elementType, T.StringType):
        return e.set(name, F.transform(e.get(name), made), guard)
    return e


def without_empty_tail(parts: Column) -> Column:
    """A split's parts up to the last one that isn't empty."""
    last = F.aggregate(F.transform(parts, lambda v, i: F.when(v != "", i + 1).otherwise(0)), F.lit(0), lambda a, v: F.greatest(a, v))
    return F.slice(parts, F.lit(1), last)


def converted(e: Events, name: str, kind: str) -> Column:
    """A value in another type; a text that can't be read becomes null, since a column has one type."""
    eu = kind.endswith("_eu")
    plain = lambda c: F.regexp_replace(F.replace(F.replace(c.cast("string"), F.lit("."), F.lit("")), F.lit(","), F.lit(".")) if eu else c.cast("string"), "[,_]" if not eu else "_", "")

    def one(c: Column) -> Column:
        match kind.removesuffix("_eu"):
            case "integer":
                low = F.lower(c.cast("string"))
                return F.when(low == "true", 1).when(low == "false", 0).otherwise(plain(c).try_cast("double").try_cast("bigint"))
            case "float":
                low = F.lower(c.cast("string"))
                return F.when(low == "true", 1.0).when(low == "false", 0.0).otherwise(plain(c).try_cast("double"))
            case "boolean":
                low = F.lower(c.cast("string"))
                return F.when(low.isin("true", "t", "yes", "y", "1", "1.0"), True).when(low.isin("false", "f", "no", "n", "0", "0.0"), False)
            case "string":
                return c.cast("string")
        raise Refused(f"can't convert to {kind!r}")

    return F.transform(e.get(name), one) if e.is_array(name) else one(e.get(name))


def f_grok(e: Events, p: Plugin, guard):
    """The first pattern that matches gives its fields; texts that none matches get a tag."""
    listed = p.get("match") or {}
    extra = p.get("pattern_definitions") or {}
    overwrite = {field_name(n) for n in _list(p.get("overwrite"))}
    target = f"{field_name(p.get('target'))}." if p.get("target") else ""
    matched = F.lit(False)
    values: dict[str, Column] = {}
    for name, patterns in _pairs(listed):
        source = e.text(field_name(name))
        for pattern in _list(patterns):
            regex, fields = grok.compile_grok(str(pattern), extra)
            hit = F.coalesce(source.rlike(regex), F.lit(False)) & ~matched
            for n, v in grok.captures(source, regex, fields).items():
                n = target + field_name(n)
                values[n] = F.when(hit, v).otherwise(values[n]) if n in values else F.when(hit, v)
            matched = matched | hit
    e.df = e.df.withColumn("@metadata._hit", matched)
    if values:
        e.df = e.df.withColumns({f"@metadata._g.{i}": v for i, v in enumerate(values.values())})
        for i, n in enumerate(values):
            got = F.col(f"`@metadata._g.{i}`")
            there = both(guard, got.isNotNull())
            if e.has(n) and n not in overwrite:
                e = e.append(n, got, both(there, e.get(n).isNotNull()) if not e.is_array(n) else there)
                if not e.is_array(n):
                    e = e.set(n, got, both(there, e.get(n).isNull()))
            else:
                e = e.set(n, got, there)
        e.df = e.df.drop(*(f"@metadata._g.{i}" for i in range(len(values))))
    hit = F.col("`@metadata._hit`")
    e = e.add_tags(_list(p.get("tag_on_failure", "_grokparsefailure")), both(guard, ~hit))
    e = common(e, p, both(guard, hit))
    e.df = e.df.drop("@metadata._hit")
    return e


def read_date(text: Column, formats: list[str], zone: str | None) -> Column:
    """The first format that reads a text gives its moment."""
    zone = zone or "UTC"
    tries = []
    for f in formats:
        match f:
            case "ISO8601" | "strict_date_optional_time" | "date_optional_time":
                local = text.try_cast("timestamp_ntz")
                zoned = text.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$")
                tries.append(F.when(text.rlike(r"^\d{4}-\d{2}"), F.when(zoned, text.try_cast("timestamp")).otherwise(F.to_utc_timestamp(local.cast("timestamp"), zone))))
            case "UNIX" | "UNIX_MS":
                n = text.try_cast("double")
                tries.append(F.timestamp_micros((n * (1e6 if f == "UNIX" else 1e3)).cast("bigint")))
            case "TAI64N":
                tries.append(F.timestamp_seconds(F.conv(F.regexp_extract(text, "^@?([0-9a-fA-F]{16})", 1), 16, 10).try_cast("bigint") - (1 << 62) - 10))
            case _:
                java = re.sub(r"Y", "y", f).replace("ZZZ", "VV")
                has_zone = bool(re.search(r"[ZXxV]", re.sub(r"'[^']*'", "", java)))
                if "y" in java or "u" in java:
                    read = F.try_to_timestamp(text, F.lit(java))
                else:
                    read = F.try_to_timestamp(F.concat(F.date_format(F.current_timestamp(), "yyyy"), F.lit(" "), text), F.lit("yyyy " + java))
                tries.append(read if has_zone else F.to_utc_timestamp(read, zone))
    return F.coalesce(*tries)


def f_date(e: Events, p: Plugin, guard):
    name, *formats = _list(p.get("match"))
    source = e.text(field_name(str(name)))
    found = read_date(source, [str(f) for f in formats], p.get("timezone"))
    e.df = e.df.withColumn("@metadata._date", found)
    got, there = F.col("`@metadata._date`"), e.present(field_name(str(name)))
    e = e.set(field_name(p.get("target", "@timestamp")), got, both(guard, got.isNotNull()))
    e = e.add_tags(_list(p.get("tag_on_failure", "_dateparsefailure")), both(guard, got.isNull() & there))
    e = common(e, p, both(guard, F.col("`@metadata._date`").isNotNull()))
    e.df = e.df.drop("@metadata._date")
    return e


def f_json(e: Events, p: Plugin, guard):
    """JSON objects into a map of field to text; known fields of a declared schema become fields.

    ``schema`` (a DDL text, an option of this engine) types the fields; without it the target holds a
    map, since the names aren't known before the data are read.
    """
    source = e.text(field_name(p.get("source")))
    ok = F.try_parse_json(source).isNotNull()
    target = field_name(p.get("target")) if p.get("target") else None
    there = e.present(field_name(p.get("source")))
    e.df = e.df.withColumn("@metadata._ok", F.coalesce(ok, F.lit(False)))
    good = both(guard, F.col("`@metadata._ok`"))
    if schema := p.get("schema"):
        e.df = e.df.withColumn("@metadata._json", F.from_json(source, str(schema)))
        fields = e.df.schema["@metadata._json"].dataType.names
        e = e.set_all({f"{target}.{n}" if target else n: F.col("`@metadata._json`").getField(n) for n in fields}, good)
        e.df = e.df.drop("@metadata._json")
    else:
        e = e.set(target or "_extra", F.from_json(source, "map<string,string>"), good)
    if not p.get("skip_on_invalid_json"):
        e = e.add_tags(_list(p.get("tag_on_failure", "_jsonparsefailure")), both(guard, ~F.col("`@metadata._ok`") & there))
    e = common(e, p, good)
    e.df = e.df.drop("@metadata._ok")
    return e


def f_kv(e: Events, p: Plugin, guard):
    """Pairs of a text as a map; keys named in include_keys become fields."""
    source = e.text(field_name(p.get("source", "message")))
    cls = lambda s: "[" + re.sub(r"([\\\]\[^-])", r"\\\1", s) + "]"
    fs, vs = cls(str(p.get("field_split", " "))), cls(str(p.get("value_split", "=")))
    inner = cls(str(p.get("field_split", " ")) + str(p.get("value_split", "=")))[1:-1]
    rx = f"([^{inner}]+){vs}(\"[^\"]*\"|'[^']*'|[^{cls(str(p.get('field_split', ' ')))[1:-1]}]*)"
    pairs = F.regexp_extract_all(source, F.lit(f"({rx})"), F.lit(1))
    trim = lambda c: F.regexp_replace(c, "^[\"']|[\"']$", "")
    entries = F.transform(pairs, lambda x: F.struct(F.concat(F.lit(str(p.get("prefix", ""))), F.regexp_extract(x, f"^{rx}$", 1)).alias("key"), trim(F.regexp_extract(x, f"^{rx}$", 2)).alias("value")))
    first = F.filter(entries, lambda x: x.getField("value") != "")
    made = F.aggregate(first, F.create_map().cast("map<string,string>"), lambda m, x: F.when(F.map_contains_key(m, x.getField("key")), m).otherwise(F.map_concat(m, F.create_map(x.getField("key"), x.getField("value")))))
    if gone := _list(p.get("exclude_keys")):
        made = F.map_filter(made, lambda k, v: ~k.isin(gone))
    target, keys = p.get("target"), _list(p.get("include_keys"))
    e.df = e.df.withColumn("@metadata._kv", made)
    got = F.col("`@metadata._kv`")
    if keys:
        head = f"{field_name(target)}." if target else ""
        e = e.set_all({head + k: F.try_element_at(got, F.lit(str(p.get("prefix", "")) + k)) for k in keys}, guard)
    else:
        e = e.set(field_name(target) if target else "_extra", got, guard)
    e.df = e.df.drop("@metadata._kv")
    return common(e, p, guard)


def f_dissect(e: Events, p: Plugin, guard):
    for name, pattern in _pairs(p.get("mapping")):
        source = e.text(field_name(name))
        regex, fields = grok.dissect_regex(str(pattern))
        e.df = e.df.withColumn("@metadata._ok", F.coalesce(source.rlike(regex), F.lit(False)))
        ok, there = F.col("`@metadata._ok`"), e.present(field_name(name))
        e = e.set_all({field_name(n): F.regexp_extract(source, regex, g) for g, n, _ in fields}, both(guard, ok))
        e = e.add_tags(_list(p.get("tag_on_failure", "_dissectfailure")), both(guard, ~ok & there))
        e.df = e.df.drop("@metadata._ok")
    for name, kind in _pairs(p.get("convert_datatype")):
        n = field_name(name)
        if e.has(n):
            e = e.set(n, e.get(n).try_cast({"int": "bigint", "float": "double"}[kind]), guard)
    return common(e, p, guard)


def f_drop(e: Events, p: Plugin, guard):
    share = p.get("percentage", 100)
    gone = guard if guard is not None else F.lit(True)
    if share < 100:
        gone = gone & (F.rand() * 100 < share)
    return e.where(~F.coalesce(gone, F.lit(False)))


def f_translate(e: Events, p: Plugin, guard):
    """Exact keys of a dictionary, given in place or as a CSV file; larger ones are joined."""
    source = field_name(p.get("source") or p.get("field"))
    target = field_name(p.get("target") or p.get("destination") or p.get("source") or "translation")
    pairs = p.get("dictionary")
    pairs = dict(_pairs(pairs)) if pairs is not None else None
    key = e.text(source)
    if pairs is not None:
        found = F.try_element_at(F.create_map(*(x for k, v in pairs.items() for x in (F.lit(str(k)), F.lit(str(v))))), key) if pairs else F.lit(None).cast("string")
        e.df = e.df.withColumn("@metadata._t", found)
    else:
        spark = e.df.sparkSession
        table = spark.read.csv(p.get("dictionary_path"), schema="`@metadata._k` string, `@metadata._t` string").dropDuplicates(["@metadata._k"])
        e.df = e.df.join(table, key == F.col("`@metadata._k`"), "left").drop("@metadata._k")
    got = F.col("`@metadata._t`")
    if p.get("fallback") is not None:
        got = F.coalesce(got, F.when(e.present(source), interpolate(e, str(p.get("fallback")))))
    free = e.get(target).isNull() if target != source and not p.get("override", target == source) else None
    e = e.set(target, got, both(both(guard, got.isNotNull()), free))
    e.df = e.df.drop("@metadata._t")
    return common(e, p, guard)


def f_fingerprint(e: Events, p: Plugin, guard):
    """A hash of the last source, or of all joined as |name|value|... in the order of their names."""
    sources = [field_name(s) for s in _list(p.get("source", "message"))]
    method, target = str(p.get("method", "SHA1")).upper(), field_name(p.get("target", "fingerprint"))
    if method == "UUID":
        return common(e.set(target, F.expr("uuid()"), guard), p, guard)
    if p.get("concatenate_all_fields"):
        sources = sorted(n for n in e.names if not n.startswith("@metadata"))
    if p.get("concatenate_sources") or p.get("concatenate_all_fields"):
        text = F.concat(*(F.coalesce(F.concat(F.lit(f"|{s}|"), e.text(s)), F.lit("")) for s in sorted(sources)), F.lit("|"))
    else:
        text = e.text(sources[-1])
    if p.get("key"):
        raise Refused("keyed fingerprints aren't supported")
    b = text.cast("binary")
    made = {"SHA1": F.sha1(b), "SHA256": F.sha2(b, 256), "SHA384": F.sha2(b, 384), "SHA512": F.sha2(b, 512), "MD5": F.md5(b)}.get(method)
    if made is None:
        raise Refused(f"fingerprint method {method!r} isn't supported")
    if p.get("base64encode"):
        made = F.base64(F.unhex(made))
    return common(e.set(target, made, guard), p, guard)


def f_uuid(e: Events, p: Plugin, guard):
    target = field_name(p.get("target"))
    free = None if p.get("overwrite") else e.get(target).isNull()
    return common(e.set(target, F.expr("uuid()"), both(guard, free)), p, guard)


def f_urldecode(e: Events, p: Plugin, guard):
    names = [n for n in e.names if e.is_string(n)] if p.get("all_fields") else [field_name(p.get("field", "message"))]
    for n in names:
        e = on_text(e, n, lambda c: F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c), guard)
    return common(e, p, guard)


def f_split(e: Events, p: Plugin, guard):
    """One event for each element; fields that are neither text nor list get a tag.

    A list that only some events split would be a text in those and a list in the others, which one
    column can't be: that is refused unless a target takes the elements.
    """
    name = field_name(p.get("field", "message"))
    target = field_name(p.get("target", name))
    c = e.get(name)
    if guard is not None and target == name and e.is_array(name):
        raise Refused(f"split of the list {name!r} in a branch needs a target")
    if not (e.is_string(name) or e.is_array(name)):
        return e.add_tags(["_split_type_failure"], guard)
    parts = e._as_list(c, e.dtype(name)) if e.is_array(name) else F.filter(F.split(c, re.escape(str(p.get("terminator", "\n")))), lambda v: v != "")
    whole = F.array(c.cast("string")) if not e.is_array(name) else F.slice(parts, 1, 0)  # none: one event, as it is
    listed = parts if guard is None else F.when(F.coalesce(guard, F.lit(False)), parts).otherwise(whole)
    e.df = e.df.withColumn("@metadata._part", F.explode_outer(listed))
    e = e.remove(name) if target == name and e.is_array(name) else e
    e = e.set(target, F.col("`@metadata._part`"), None if target == name else guard)
    e.df = e.df.drop("@metadata._part")
    return common(e, p, guard)


def f_truncate(e: Events, p: Plugin, guard):
    """At most so many bytes of UTF-8, cut between characters."""
    n = int(p.get("length_bytes"))
    names = [field_name(f) for f in _list(p.get("fields"))] or [x for x in e.names if e.is_string(x)]

    def cut(c: Column) -> Column:
        head = F.substring(c.cast("binary"), 1, n)
        # bytes that continue a character end a cut that splits it
        tail = F.hex(head)
        whole = F.regexp_replace(tail, "(?:[C-D][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-7](?:[89AB][0-9A-F]){0,2})$", "")
        return F.when(F.octet_length(c) <= n, c).otherwise(F.unhex(whole).cast("string"))

    for name in names:
        e = on_text(e, name, cut, guard)
    return common(e, p, guard)


def f_csv(e: Events, p: Plugin, guard):
    source = e.text(field_name(p.get("source", "message")))
    columns = [str(c) for c in _list(p.get("columns"))]
    if not columns:
        raise Refused("csv needs its columns")
    schema = ", ".join(f"`c{i}` string" for i in range(len(columns)))
    parsed = F.from_csv(source, schema, {"sep": str(p.get("separator", ",")), "quote": str(p.get("quote_char", '"'))})
    head = f"{field_name(p.get('target'))}." if p.get("target") else ""
    e.df = e.df.withColumn("@metadata._csv", parsed)
    e = e.set_all({head + field_name(n): F.col("`@metadata._csv`").getField(f"c{i}") for i, n in enumerate(columns)}, guard)
    e.df = e.df.drop("@metadata._csv")
    for n, kind in _pairs(p.get("convert")):
        e = e.set(head + field_name(n), converted(e, head + field_name(n), kind), guard)
    return common(e, p, guard)


def in_network(address: Column, network: str) -> Column:
    from ..plans.aggs import ip_number, ip_value

    base, _, bits = network.partition("/")
    size = 32 - int(bits or 32)
    n = ip_number(address)
    lo = ip_value(base) >> size << size
    return F.coalesce((n >= lo) & (n < lo + (1 << size)), F.lit(False))


def f_cidr(e: Events, p: Plugin, guard):
    inside = F.lit(False)
    for a in _list(p.get("address")):
        for n in _list(p.get("network")):
            inside = inside | in_network(interpolate(e, str(a)), str(n))
    return common(e, p, both(guard, inside))


def f_prune(e: Events, p: Plugin, guard):
    tops = lambda n: n.split(".")[0]
    white, black = _list(p.get("whitelist_names")), _list(p.get("blacklist_names", [r"%\{[^}]+\}"]))
    for n in list(e.names):
        if n.startswith("@metadata"):
            continue
        if white and not any(re.search(str(w), tops(n)) for w in white) or any(re.search(str(b), tops(n)) for b in black):
            e = e.remove(n, guard)
    for option, keep in (("whitelist_values", True), ("blacklist_values", False)):
        for name, rx in _pairs(p.get(option)):
            n = field_name(name)
            if e.has(n):
                hit = F.coalesce(e.text(n).rlike(str(rx)), F.lit(False))
                e = e.remove(n, both(guard, ~hit if keep else hit))
    return common(e, p, guard)


def f_de_dot(e: Events, p: Plugin, guard):
    """Dots in names: replaced, or with ``nested`` read as nesting, which is how this engine holds them."""
    if not p.get("nested"):
        sep, chosen = str(p.get("separator", "_")), _list(p.get("fields"))
        for n in list(e.names):
            if "." in n and not n.startswith("@") and (not chosen or n in chosen):
                e.df = e.df.withColumnRenamed(n, n.replace(".", sep))
    return common(e, p, guard)


#: Labels of syslog facilities and severities.
FACILITIES = "kernel,user-level,mail,daemon,security/authorization,syslogd,line printer,network news,uucp,clock,security/authorization,ftp,ntp,log audit,log alert,clock,local0,local1,local2,local3,local4,local5,local6,local7".split(",")
SEVERITIES = "emergency,alert,critical,error,warning,notice,informational,debug".split(",")


def f_syslog_pri(e: Events, p: Plugin, guard):
    pri = F.coalesce(e.text(field_name(p.get("syslog_pri_field_name", "syslog_pri"))).try_cast("int"), F.lit(13))
    fac, sev = F.floor(pri / 8).cast("int"), (pri % 8).cast("int")
    label = lambda names, i: F.get(F.array(*(F.lit(n) for n in names)), i)
    values = {"syslog_severity_code": sev, "syslog_facility_code": fac}
    if p.get("use_labels", True):
        values |= {"syslog_facility": label(FACILITIES, fac), "syslog_severity": label(SEVERITIES, sev)}
    return common(e.set_all(values, guard), p, guard)


def f_clone(e: Events, p: Plugin, guard):
    """The event and a copy for each name, which goes into the copy's type (or with ECS its tags)."""
    names = [F.lit(None).cast("string"), *(F.lit(str(c)) for c in _list(p.get("clones")))]
    copies = F.array(*names)
    copies = copies if guard is None else F.when(F.coalesce(guard, F.lit(False)), copies).otherwise(F.array(names[0]))
    e.df = e.df.withColumn("@metadata._copy", F.explode(copies))
    c = F.col("`@metadata._copy`")
    if str(p.get("ecs_compatibility", "v8")) == "disabled":
        e = e.set("type", c, c.isNotNull())
    else:
        old = F.coalesce(e.get("tags") if e.is_array("tags") else F.lit(None), F.array()).cast("array<string>")
        e = e.set("tags", F.concat(old, F.array(c)), c.isNotNull())
    e = common(e, p, c.isNotNull())
    e.df = e.df.drop("@metadata._copy")
    return e


def f_environment(e: Events, p: Plugin, guard):
    for name, var in _pairs(p.get("add_metadata_from_env")):
        e = e.set(f"@metadata.{name}", F.lit(os.environ.get(str(var))).cast("string"), guard)
    return common(e, p, guard)


def size_in_bytes(c: Column, binary: bool = True) -> Column:
    """A text such as 10 MB or 1.5k as a number of bytes, null if it is none."""
    rx = r"(?i)^\s*([+-]?\d+(?:[.,]\d+)?)\s*([kmgtpe]?)i?b?\s*$"
    unit = F.lower(F.regexp_extract(c, rx, 2))
    power = F.when(unit == "", 0)
    for i, u in enumerate("kmgtpe"):
        power = power.when(unit == u, i + 1)
    n = F.replace(F.regexp_extract(c, rx, 1), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(c.rlike(rx), (n * F.pow(F.lit(1024.0 if binary else 1000.0), power)).cast("bigint"))


def f_bytes(e: Events, p: Plugin, guard):
    source = field_name(p.get("source", "message"))
    e.df = e.df.withColumn("@metadata._b", size_in_bytes(e.text(source), str(p.get("conversion_method", "binary")) == "binary"))
    got = F.col("`@metadata._b`")
    e = e.set(field_name(p.get("target", source)), got, both(guard, got.isNotNull()))
    e = e.add_tags(_list(p.get("tag_on_failure", "_bytesparsefailure")), both(guard, got.isNull()))
    e.df = e.df.drop("@metadata._b")
    return common(e, p, guard)


def f_throttle(e: Events, p: Plugin, guard):
    """In a batch: tags events beyond ``after_count`` of their key and period, in the order of time."""
    if int(p.get("before_count", -1)) >= 0:
        raise Refused("throttle before_count isn't supported")
    key, period = interpolate(e, str(p.get("key"))), int(float(p.get("period", 60)))
    at = e.get("@timestamp").cast("timestamp") if e.has("@timestamp") else F.timestamp_seconds(F.lit(0))
    chosen = F.coalesce(guard, F.lit(False)) if guard is not None else F.lit(True)
    e.df = e.df.withColumns({"@metadata._key": F.when(chosen, key), "@metadata._slot": F.floor(F.unix_seconds(at) / period), "@metadata._order": at})
    w = Window.partitionBy("`@metadata._key`", "`@metadata._slot`").orderBy("`@metadata._order`", F.monotonically_increasing_id())
    e.df = e.df.withColumn("@metadata._n", F.row_number().over(w))
    over = F.col("`@metadata._key`").isNotNull() & (F.col("`@metadata._n`") > int(p.get("after_count")))
    e = common(e, p, over)
    e.df = e.df.drop("@metadata._key", "@metadata._slot", "@metadata._order", "@metadata._n")
    return e


def f_xml(e: Events, p: Plugin, guard):
    source = e.text(field_name(p.get("source", "message")))
    ok = F.coalesce(source.rlike(r"(?s)^\s*<.+>\s*$"), F.lit(False))
    for path, target in _pairs(p.get("xpath")):
        e = e.set(field_name(str(target)), F.xpath(source, F.lit(str(path))), both(guard, ok))
    if p.get("store_xml", True) and p.get("schema"):
        e = e.set(field_name(p.get("target")), F.from_xml(source, str(p.get("schema"))), both(guard, ok))
    e = e.add_tags(["_xmlparsefailure"], both(guard, ~ok & e.present(field_name(p.get("source", "message")))))
    return common(e, p, both(guard, ok))


def agent_fields(c: Column) -> dict[str, Column]:
    """Name, version, system and device of common browsers' user agents."""
    rules = [("Edge", r"Edge?/(\d+(?:\.\d+)*)"), ("Opera", r"OPR/(\d+(?:\.\d+)*)"), ("Firefox", r"Firefox/(\d+(?:\.\d+)*)"), ("Chrome", r"Chrome/(\d+(?:\.\d+)*)"), ("Safari", r"Version/(\d+(?:\.\d+)*).*Safari"), ("curl", r"curl/(\d+(?:\.\d+)*)"), ("IE", r"MSIE (\d+(?:\.\d+)*)")]
    name, version = F.lit("Other"), F.lit(None).cast("string")
    for n, rx in reversed(rules):
        name, version = F.when(c.rlike(rx), n).otherwise(name), F.when(c.rlike(rx), F.regexp_extract(c, rx, 1)).otherwise(version)
    systems = [("Windows", "Windows NT"), ("Android", "Android"), ("iOS", "iPhone OS|iPad"), ("Mac OS X", "Mac OS X"), ("Linux", "Linux")]
    system = F.lit("Other")
    for n, rx in reversed(systems):
        system = F.when(c.rlike(rx), n).otherwise(system)
    return {"name": name, "version": version, "os.name": system, "device.name": F.when(c.rlike("iPhone"), "iPhone").when(c.rlike("iPad"), "iPad").when(c.rlike("Macintosh"), "Mac").otherwise("Other"), "original": c}


def f_useragent(e: Events, p: Plugin, guard):
    source = e.text(field_name(p.get("source")))
    head = field_name(p.get("target", "user_agent"))
    e = e.set_all({f"{head}.{n}": v for n, v in agent_fields(source).items()}, both(guard, source.isNotNull()))
    return common(e, p, guard)


def f_geoip(e: Events, p: Plugin, guard):
    """A join with a table of IPv4 ranges (``database``: Parquet with start and stop numbers and columns of places).

    Ranges are cut at /8 borders, so that the join is by equal first octets and then by range.
    """
    from ..plans.aggs import ip_number

    spark, head = e.df.sparkSession, field_name(p.get("target", "geoip"))
    places = spark.read.parquet(p.get("database"))
    fields = [c for c in places.columns if c not in ("start", "stop")]
    octets = F.sequence(F.shiftright("start", 24), F.shiftright("stop", 24))
    places = places.select(F.explode(octets).alias("@o"), F.col("start").alias("@a"), F.col("stop").alias("@z"), F.struct(*fields).alias("@geo"))
    e.df = e.df.withColumn("@metadata._ip", ip_number(e.text(field_name(p.get("source")))))
    ip = F.col("`@metadata._ip`")
    e.df = e.df.join(places, (F.shiftright(ip, 24) == F.col("`@o`")) & ip.between(F.col("`@a`"), F.col("`@z`")), "left").drop("@o", "@a", "@z", "@metadata._ip")
    got = F.col("`@geo`")
    e = e.set_all({f"{head}.{n}": got.getField(n) for n in fields}, both(guard, got.isNotNull()))
    e = e.add_tags(_list(p.get("tag_on_failure", "_geoip_lookup_failure")), both(guard, F.col("`@geo`").isNull()))
    e.df = e.df.drop("@geo")
    return common(e, p, guard)


FILTERS = {n[2:]: f for n, f in list(globals().items()) if n.startswith("f_")}


def run(df: DataFrame, source: str | dict) -> DataFrame:
    """A configuration's filter section over events; works on batches and, but for throttle, on streams."""
    config = parse(source) if isinstance(source, str) else source
    e = run_filters(Events(df), config["filter"])
    return e.df.drop(*(c for c in e.names if c.startswith("@metadata")))


def route(df: DataFrame, source: str | dict) -> list[tuple[Plugin, DataFrame]]:
    """(output, its events) of a configuration's output section."""
    config = parse(source) if isinstance(source, str) else source
    e = Events(df)
    out: list[tuple[Plugin, DataFrame]] = []

    def walk(body: list, guard: Column | None) -> None:
        for step in body:
            if isinstance(step, Plugin):
                out.append((step, e.df if guard is None else e.df.where(guard)))
                continue
            before = guard
            for test, arm in step.arms:
                holds = condition(e, test) if test is not None else F.lit(True)
                walk(arm, both(before, holds))
                before = both(before, ~holds)

    walk(config["output"], None)
    return out
