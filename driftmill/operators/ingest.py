"""Ingest pipelines: processors as column changes, with failures carried in a column.

A column has one type, so a text that ``convert`` can't read becomes null in the converted column.
A failed processor sets the event's failure message; the processor's ``on_failure`` handlers, else the
pipeline's, run on such events alone, and the event goes on only where a handler took it.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Refused
from ..functions import grok, painless, painless_run
from .events import Events
from .logstash import agent_fields, both, f_geoip, in_network, read_date, size_in_bytes, without_empty_tail, Plugin

FAIL, STOP = "@metadata._fail", "@metadata._stop"
COMMON = {"if", "ignore_failure", "on_failure", "tag", "description", "ignore_missing"}


def template(e: Events, text) -> Column:
    """A value with {{field}} and {{{field}}} replaced; absent fields count as empty."""
    if not isinstance(text, str):
        return F.array(*(template(e, t) for t in text)) if isinstance(text, list) else F.lit(text)
    parts = re.split(r"\{\{\{?\s*([\w.@\-]+)\s*\}?\}\}", text)
    made = [F.lit(p) if i % 2 == 0 else F.coalesce(e.text(p.removeprefix("_source.")), F.lit("")) for i, p in enumerate(parts) if i % 2 or p or len(parts) == 1]
    return made[0] if len(made) == 1 else F.concat(*made)


class ContextScript(painless._Compiler):
    """Scripts over ctx as Columns: reads, assignments, if, remove and add; loops are interpreted instead."""

    def __init__(self, events: Events, params: dict, guard):
        super().__init__(None, params)
        self.events, self.guard = events, guard

    def path(self, n) -> str | None:
        if n.kind == "id" and n.value == "ctx":
            return ""
        if n.kind in ("dot", "index"):
            base = self.path(n.parts[0])
            if base is None:
                return None
            name = n.value if n.kind == "dot" else str(self.constant(n.parts[1]))
            return f"{base}.{name}" if base else name
        return None

    def read(self, name: str) -> painless.Value:
        t = self.events.dtype(name)
        kind = "list" if isinstance(t, T.ArrayType) else "int" if isinstance(t, T.IntegralType) else "float" if isinstance(t, T.NumericType) else "bool" if isinstance(t, T.BooleanType) else "date" if isinstance(t, (T.TimestampType, T.DateType)) else "string" if isinstance(t, T.StringType) else "other"
        return painless.Value(self.events.get(name), kind)

    def e_dot(self, n, env):
        name = self.path(n)
        return self.read(name) if name else super().e_dot(n, env)

    def e_index(self, n, env):
        name = self.path(n)
        return self.read(name) if name else super().e_index(n, env)

    def e_call(self, n, env):
        name = self.path(n.parts[0])
        if n.value == "containsKey" and name is not None:
            key = str(self.constant(n.parts[1]))
            return painless.Value(self.events.present(f"{name}.{key}" if name else key), "bool")
        return super().e_call(n, env)

    def apply(self, body: list, env: dict, guard) -> None:
        for s in body:
            match s.kind:
                case "let":
                    env[s.value] = self.value(s.parts[0], env)
                case "assign":
                    target, made = s.parts[0], self.value(s.parts[1], env)
                    if target.kind == "id":
                        old = env.get(target.value)
                        env[target.value] = painless.Value(F.when(F.coalesce(guard, F.lit(False)), made.column).otherwise(old.column), made.kind) if guard is not None and old else made
                    elif name := self.path(target):
                        self.events.set(name, made.column, guard)
                    else:
                        raise Refused("only ctx fields and variables can be assigned")
                case "if":
                    test = F.coalesce(self.value(s.parts[0], env).column, F.lit(False))
                    hold = f"@metadata._if{id(s) % 100000}"
                    self.events.df = self.events.df.withColumn(hold, test)
                    self.apply(s.parts[1], env, both(guard, F.col(f"`{hold}`")))
                    self.apply(s.parts[2], env, both(guard, ~F.col(f"`{hold}`")))
                    self.events.df = self.events.df.drop(hold)
                case "do" if s.parts[0].kind == "call":
                    call = s.parts[0]
                    name = self.path(call.parts[0])
                    if call.value == "remove" and name is not None:
                        key = str(self.constant(call.parts[1]))
                        self.events.remove(f"{name}.{key}" if name else key, guard)
                    elif call.value == "put" and name is not None:
                        key = str(self.constant(call.parts[1]))
                        self.events.set(f"{name}.{key}" if name else key, self.value(call.parts[2], env).column, guard)
                    elif call.value == "add" and name:
                        self.events.append(name, self.value(call.parts[1], env).column, guard)
                    else:
                        raise Refused(f"{call.value} isn't supported in ingest scripts")
                case "do":
                    self.value(s.parts[0], env)
                case _:
                    raise Refused(f"{s.kind} isn't supported in ingest scripts")


class Pipelines:
    """Named pipelines over events."""

    def __init__(self, named: dict[str, dict] | None = None):
        self.named = named or {}

    def run(self, df: DataFrame, pipeline: dict | str, keep_failed: bool = True) -> DataFrame:
        """Events after a pipeline; with ``keep_failed`` those that failed keep their message in ``_ingest_error``."""
        body = self.named[pipeline] if isinstance(pipeline, str) else pipeline
        e = Events(df)
        e.df = e.df.withColumns({FAIL: F.lit(None).cast("string"), STOP: F.lit(False)})
        self.processors(e, body.get("processors", []), None, body.get("on_failure"), 0)
        out = e.df
        out = out.withColumn("_ingest_error", F.col(f"`{FAIL}`")) if keep_failed else out.where(F.col(f"`{FAIL}`").isNull())
        return out.drop(*(c for c in out.columns if c.startswith("@metadata")))

    def processors(self, e: Events, steps: list[dict], guard, on_failure, depth: int) -> None:
        if depth > 16:
            raise Refused("pipelines call each other too deeply")
        for step in steps:
            (kind, o), = step.items()
            made = getattr(self, f"p_{kind}", None)
            if made is None:
                raise Refused(f"processor {kind!r} isn't supported")
            alive = F.col(f"`{FAIL}`").isNull() & ~F.col(f"`{STOP}`")
            hold = both(guard, alive)
            if o.get("if"):
                source, params = painless.script_of(o["if"])
                test = ContextScript(e, params, None).run(painless.parse(source), {}).column
                hold = hold & F.coalesce(test, F.lit(False))
            name = f"@metadata._p{depth}_{id(step) % 1000000}"
            e.df = e.df.withColumn(name, F.coalesce(hold, F.lit(False)))
            made(e, o, F.col(f"`{name}`"), depth)
            failed = F.col(f"`{name}`") & F.col(f"`{FAIL}`").isNotNull()
            handlers = o.get("on_failure") or (None if o.get("ignore_failure") else on_failure)
            if o.get("ignore_failure") and not o.get("on_failure"):
                e.df = e.df.withColumn(FAIL, F.when(failed, None).otherwise(F.col(f"`{FAIL}`")))
            elif handlers:
                bad = name + "f"
                e.df = e.df.withColumn(bad, F.coalesce(failed, F.lit(False)))
                e.set("_ingest.on_failure_message", F.col(f"`{FAIL}`"), F.col(f"`{bad}`"))
                e.set("_ingest.on_failure_processor_type", F.lit(kind), F.col(f"`{bad}`"))
                e.df = e.df.withColumn(FAIL, F.when(F.col(f"`{bad}`"), None).otherwise(F.col(f"`{FAIL}`")))
                self.processors(e, handlers, F.col(f"`{bad}`"), None, depth + 1)
                if not o.get("on_failure"):  # the pipeline's own handlers end it
                    e.df = e.df.withColumn(STOP, F.col(f"`{STOP}`") | F.col(f"`{bad}`"))
                e.df = e.df.drop(bad, "_ingest.on_failure_message", "_ingest.on_failure_processor_type")
            e.df = e.df.drop(name)

    def fail(self, e: Events, message: Column, when: Column) -> None:
        e.df = e.df.withColumn(FAIL, F.when(F.coalesce(when, F.lit(False)) & F.col(f"`{FAIL}`").isNull(), message).otherwise(F.col(f"`{FAIL}`")))

    def need(self, e: Events, o: dict, g: Column, name: str) -> Column:
        """Fail events without the field unless that is to be ignored; gives the guard of the others."""
        there = e.present(name)
        if not o.get("ignore_missing"):
            self.fail(e, F.lit(f"field [{name}] not present as part of path [{name}]"), g & ~there)
        return g & there

    # ------------------------------------------------------------ fields

    def p_set(self, e, o, g, depth):
        name = template_name(o["field"])
        free = g if o.get("override", True) else g & ~e.present(name)
        if "copy_from" in o:
            for c in e.under(o["copy_from"]):
                e.set(name + c[len(o["copy_from"]) :], e.get(c), free & e.get(c).isNotNull() if o.get("ignore_empty_value") else free)
            return
        value = template(e, o["value"])
        if o.get("ignore_empty_value") and isinstance(o["value"], str):
            free = free & F.coalesce(value != "", F.lit(False))
        e.set(name, value, free)

    def p_remove(self, e, o, g, depth):
        if "keep" in o:
            keep = o["keep"] if isinstance(o["keep"], list) else [o["keep"]]
            for n in [n for n in e.names if not n.startswith(("@metadata", "_")) and not any(n == k or n.startswith(k + ".") for k in keep)]:
                e.remove(n, g)
            return
        for n in o["field"] if isinstance(o["field"], list) else [o["field"]]:
            e.remove(n, self.need(e, o, g, n))

    def p_rename(self, e, o, g, depth):
        old, new = o["field"], o["target_field"]
        ok = self.need(e, o, g, old)
        if not o.get("override"):
            taken = e.present(new)
            self.fail(e, F.lit(f"field [{new}] already exists"), ok & taken)
            ok = ok & ~taken
        names = e.under(old)
        e.df = e.df.withColumn("@metadata._ok", F.coalesce(ok, F.lit(False)))
        ok = F.col("`@metadata._ok`")
        for c in names:
            e.set(new + c[len(old) :], e.get(c), ok).remove(c, ok)
        e.df = e.df.drop("@metadata._ok")

    def p_append(self, e, o, g, depth):
        values = o["value"] if isinstance(o["value"], list) else [o["value"]]
        name = o["field"]
        old = F.coalesce(e._as_list(e.get(name), e.dtype(name)), F.array().cast("array<string>")) if e.has(name) else F.array().cast("array<string>")
        new = F.array(*(template(e, v).cast("string") for v in values))
        made = F.concat(old, new) if o.get("allow_duplicates", True) else F.concat(old, F.array_except(new, old))
        e.set(name, made, g)

    def each_text(self, e, o, g, made):
        name, to = o["field"], o.get("target_field", o["field"])
        ok = self.need(e, o, g, name)
        if e.is_array(name):
            e.set(to, F.transform(e.get(name), lambda v: made(v.cast("string"))), ok)
        elif e.is_string(name) or not e.has(name):
            e.set(to, made(e.get(name)), ok)
        else:
            self.fail(e, F.lit(f"field [{name}] of type [{e.dtype(name).simpleString()}] cannot be cast to [java.lang.String]"), ok)

    def p_lowercase(self, e, o, g, depth):
        self.each_text(e, o, g, F.lower)

    def p_uppercase(self, e, o, g, depth):
        self.each_text(e, o, g, F.upper)

    def p_trim(self, e, o, g, depth):
        self.each_text(e, o, g, lambda c: F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))

    def p_urldecode(self, e, o, g, depth):
        name = o["field"]
        bad = e.get(name).isNotNull() & F.try_url_decode(e.text(name)).isNull()
        self.fail(e, F.lit(f"URLDecoder: Illegal hex characters in [{name}]"), g & bad)
        self.each_text(e, o, g & ~bad, F.try_url_decode)

    def p_html_strip(self, e, o, g, depth):
        self.each_text(e, o, g, lambda c: F.regexp_replace(c, "<[^>]*>", ""))

    def p_gsub(self, e, o, g, depth):
        self.each_text(e, o, g, lambda c: F.regexp_replace(c, o["pattern"], o["replacement"]))

    def p_bytes(self, e, o, g, depth):
        name = o["field"]
        ok = self.need(e, o, g, name)
        made = size_in_bytes(e.text(name))
        self.fail(e, F.concat(F.lit("failed to parse setting [Ingest Field] with value ["), e.text(name), F.lit("]")), ok & made.isNull())
        e.set(o.get("target_field", name), made, ok & made.isNotNull())

    def p_convert(self, e, o, g, depth):
        name, to, kind = o["field"], o.get("target_field", o["field"]), o["type"]
        ok = self.need(e, o, g, name)

        def one(c: Column) -> Column:
            s = F.trim(c.cast("string"))
            match kind:
                case "integer" | "long":
                    return F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("int" if kind == "integer" else "bigint")).when(s.rlike(r"^[+-]?0[xX][0-9a-fA-F]+$"), F.conv(F.regexp_replace(s, "0[xX]", ""), 16, 10).try_cast("bigint"))
                case "float" | "double":
                    return s.try_cast(kind)
                case "boolean":
                    return F.when(F.lower(s) == "true", True).when(F.lower(s) == "false", False)
                case "string":
                    return c.cast("string")
                case "ip":
                    return F.when(s.rlike(r"^\d{1,3}(\.\d{1,3}){3}$|^[0-9a-fA-F:]*:[0-9a-fA-F:.]*$"), s)
                case "auto":
                    return s
            raise Refused(f"type {kind!r} isn't supported, cannot convert field")

        made = F.transform(e.get(name), one) if e.is_array(name) else one(e.get(name))
        bad = F.exists(made, lambda v: v.isNull()) if e.is_array(name) else made.isNull()
        self.fail(e, F.concat(F.lit("unable to convert ["), F.coalesce(e.text(name), F.lit("null")), F.lit(f"] to {kind}")), ok & bad)
        e.df = e.df.withColumns({"@metadata._c": made, "@metadata._ok": F.coalesce(ok & ~bad, F.lit(False))})
        e.set(to, F.col("`@metadata._c`"), F.col("`@metadata._ok`") if to != name else None)
        e.df = e.df.drop("@metadata._c", "@metadata._ok")

    def p_split(self, e, o, g, depth):
        ok = self.need(e, o, g, o["field"])
        parts = F.split(e.text(o["field"]), o["separator"])
        e.set(o.get("target_field", o["field"]), parts if o.get("preserve_trailing") else without_empty_tail(parts), ok)

    def p_join(self, e, o, g, depth):
        name = o["field"]
        ok = self.need(e, o, g, name)
        if not e.is_array(name):
            self.fail(e, F.lit(f"field [{name}] of type [java.lang.String] cannot be cast to [java.util.List]"), ok)
            return
        e.set(o.get("target_field", name), F.array_join(F.transform(e.get(name), lambda v: v.cast("string")), o["separator"]), ok)

    def p_sort(self, e, o, g, depth):
        name = o["field"]
        ok = self.need(e, o, g, name)
        e.set(o.get("target_field", name), F.sort_array(e.get(name), o.get("order", "asc") == "asc"), ok)

    def p_json(self, e, o, g, depth):
        name, to = o["field"], o.get("target_field", o["field"])
        ok = self.need(e, o, g, name)
        valid = F.coalesce(F.try_parse_json(e.text(name)).isNotNull(), F.lit(False))
        self.fail(e, F.lit(f"field [{name}] holds no valid JSON"), ok & ~valid)
        if schema := o.get("schema"):
            e.df = e.df.withColumn("@metadata._json", F.from_json(e.text(name), schema))
            head = "" if o.get("add_to_root") else f"{to}."
            names = e.df.schema["@metadata._json"].dataType.names
            e.set_all({head + n: F.col("`@metadata._json`").getField(n) for n in names}, ok & valid)
            e.df = e.df.drop("@metadata._json")
        else:
            e.set("_extra" if o.get("add_to_root") else f"{to}_json" if to == name else to, F.from_json(e.text(name), "map<string,string>"), ok & valid)

    def p_date(self, e, o, g, depth):
        name = o["field"]
        found = read_date(e.text(name), [str(f) for f in o["formats"]], o.get("timezone"))
        self.fail(e, F.concat(F.lit("unable to parse date ["), F.coalesce(e.text(name), F.lit("null")), F.lit("]")), g & found.isNull())
        made = F.date_format(found, o["output_format"]) if "output_format" in o else found
        e.set(o.get("target_field", "@timestamp"), made, g & found.isNotNull())

    def p_grok(self, e, o, g, depth):
        name = o["field"]
        ok = self.need(e, o, g, name)
        source, matched, values = e.text(name), F.lit(False), {}
        for pattern in o["patterns"]:
            regex, fields = grok.compile_grok(pattern, o.get("pattern_definitions"))
            hit = F.coalesce(source.rlike(regex), F.lit(False)) & ~matched
            for n, v in grok.captures(source, regex, fields).items():
                values[n] = F.when(hit, v).otherwise(values[n]) if n in values else F.when(hit, v)
            matched = matched | hit
        self.fail(e, F.concat(F.lit("Provided Grok expressions do not match field value: ["), F.coalesce(source, F.lit("null")), F.lit("]")), ok & ~matched)
        e.df = e.df.withColumns({f"@metadata._g{i}": v for i, v in enumerate(values.values())} | {"@metadata._ok": ok})
        for i, n in enumerate(values):
            e.set(n, F.col(f"`@metadata._g{i}`"), F.col("`@metadata._ok`") & F.col(f"`@metadata._g{i}`").isNotNull())
        e.df = e.df.drop("@metadata._ok", *(f"@metadata._g{i}" for i in range(len(values))))

    def p_dissect(self, e, o, g, depth):
        ok = self.need(e, o, g, o["field"])
        source = e.text(o["field"])
        regex, fields = grok.dissect_regex(o["pattern"])
        hit = F.coalesce(source.rlike(regex), F.lit(False))
        self.fail(e, F.concat(F.lit("Unable to find match for dissect pattern: "), F.lit(o["pattern"])), ok & ~hit)
        e.set_all({n: F.regexp_extract(source, regex, i) for i, n, _ in fields}, ok & hit)

    def p_kv(self, e, o, g, depth):
        """Pairs as a map under target_field; keys in include_keys become fields."""
        ok = self.need(e, o, g, o["field"])
        pairs = F.split(e.text(o["field"]), o["field_split"])
        strip = (lambda c: F.regexp_replace(c, r"^[\[({<\"']+|[\])}>\"']+$", "")) if o.get("strip_brackets") else (lambda c: c)
        chars = lambda key, c: F.regexp_replace(c, f"^[{re.escape(o[key])}]+|[{re.escape(o[key])}]+$", "") if key in o else c
        cut = F.transform(pairs, lambda x: F.split(x, o["value_split"], 2))
        self.fail(e, F.lit(f"field [{o['field']}] does not contain value_split [{o['value_split']}]"), ok & F.exists(cut, lambda x: F.size(x) < 2))
        entries = F.transform(F.filter(cut, lambda x: F.size(x) == 2), lambda x: F.struct(F.concat(F.lit(o.get("prefix", "")), chars("trim_key", F.get(x, F.lit(0)))).alias("key"), strip(chars("trim_value", F.get(x, F.lit(1)))).alias("value")))
        made = F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x.getField("key")), F.create_map(x.getField("key"), x.getField("value"))))
        if "exclude_keys" in o:
            made = F.map_filter(made, lambda k, v: ~k.isin(o["exclude_keys"]))
        e.df = e.df.withColumn("@metadata._kv", made)
        got, head = F.col("`@metadata._kv`"), f"{o['target_field']}." if "target_field" in o else ""
        if "include_keys" in o:
            e.set_all({head + k: F.try_element_at(got, F.lit(o.get("prefix", "") + k)) for k in o["include_keys"]}, ok)
        else:
            e.set(o.get("target_field", "_extra"), got, ok)
        e.df = e.df.drop("@metadata._kv")

    def p_dot_expander(self, e, o, g, depth):
        """Dotted names are how this engine holds nesting, so there is nothing to move but a path."""
        if o.get("path"):
            for c in e.under(o["path"]):
                e.get(c)

    # ------------------------------------------------------------ control

    def p_drop(self, e, o, g, depth):
        e.where(~g)

    def p_fail(self, e, o, g, depth):
        self.fail(e, template(e, o["message"]), g)

    def p_terminate(self, e, o, g, depth):
        e.df = e.df.withColumn(STOP, F.col(f"`{STOP}`") | g)

    def p_pipeline(self, e, o, g, depth):
        if o["name"] not in self.named:
            if not o.get("ignore_missing_pipeline"):
                self.fail(e, F.lit(f"Pipeline processor configured for non-existent pipeline [{o['name']}]"), g)
            return
        inner = self.named[o["name"]]
        self.processors(e, inner.get("processors", []), g, inner.get("on_failure"), depth + 1)

    def p_foreach(self, e, o, g, depth):
        """A text processor on each element of a list."""
        (kind, inner), = o["processor"].items()
        ok = self.need(e, o, g, o["field"])
        if inner.get("field") != "_ingest._value" or kind not in ("lowercase", "uppercase", "trim", "html_strip", "gsub", "urldecode"):
            raise Refused(f"foreach with {kind!r} isn't supported")
        getattr(self, f"p_{kind}")(e, {**inner, "field": o["field"], "ignore_missing": True}, ok, depth)

    def p_script(self, e, o, g, depth):
        source, params = painless.script_of({k: v for k, v in o.items() if k in ("source", "lang", "params", "id")})
        before = e.df
        try:
            ContextScript(e, params, g).apply(painless.parse(source), {}, g)
        except Refused:
            if "outputs" not in o:
                raise
            e.df = before
            self.interpreted(e, source, params, o["outputs"], g)

    def interpreted(self, e: Events, source: str, params: dict, outputs: str, g: Column) -> None:
        """A script with loops or lambdas, run on each event; ``outputs`` (a DDL text, an option of this engine) types what it sets."""
        fields = [n for n in e.names if not n.startswith("@metadata")]
        wanted = T.StructType.fromDDL(outputs).names

        @F.arrow_udf("out string, removed array<string>, error string")
        def run(events: pa.Array) -> pa.Array:
            script, rows = painless_run.Interpreter(source, params), []
            for text in events:
                if text.as_py() is None:
                    rows.append({"out": None, "removed": [], "error": None})
                    continue
                ctx: dict = {}
                for name, v in json.loads(text.as_py()).items():
                    *path, last = name.split(".")
                    holder = ctx
                    for p in path:
                        holder = holder.setdefault(p, {})
                    holder[last] = v
                try:
                    script.run(ctx)
                except (painless_run.ScriptError, TypeError, ValueError, KeyError, IndexError, ZeroDivisionError, AttributeError, RecursionError) as x:
                    rows.append({"out": None, "removed": [], "error": str(x) or type(x).__name__})
                    continue

                def at(name: str):
                    v = ctx
                    for p in name.split("."):
                        v = v.get(p) if isinstance(v, dict) else None
                    return v

                rows.append({"out": json.dumps({n: at(n) for n in wanted}), "removed": [n for n in fields if at(n) is None], "error": None})
            return pa.array(rows, pa.struct([("out", pa.string()), ("removed", pa.list_(pa.string())), ("error", pa.string())]))

        whole = F.to_json(F.struct(*(F.col(f"`{n}`") for n in fields)))
        e.df = e.df.withColumn("@metadata._s", run(F.when(F.coalesce(g, F.lit(False)), whole)))
        s = F.col("`@metadata._s`")
        ok = g & s.getField("error").isNull()
        self.fail(e, F.concat(F.lit("runtime error: "), s.getField("error")), g & s.getField("error").isNotNull())
        made = F.from_json(s.getField("out"), outputs)
        gone = {n: F.lit(None).cast(e.dtype(n)) for n in fields if n not in wanted}
        for n, nothing in gone.items():
            e.set(n, F.when(F.array_contains(s.getField("removed"), n), nothing).otherwise(e.get(n)), ok)
        e.set_all({n: made.getField(n) for n in wanted}, ok)
        e.df = e.df.drop("@metadata._s")

    def p_reroute(self, e, o, g, depth):
        kind, data, space = (o.get(k) or d for k, d in (("type", "logs"), ("dataset", "generic"), ("namespace", "default")))
        if "destination" in o:
            target = F.lit(o["destination"])
        else:
            one = lambda v: template(e, v if isinstance(v, str) else v[0])
            target = F.concat_ws("-", one(kind), one(data), one(space))
        e.set("_index", target, g)
        e.df = e.df.withColumn(STOP, F.col(f"`{STOP}`") | g)

    # ------------------------------------------------------------ enrichment

    def p_uri_parts(self, e, o, g, depth):
        name, head = o["field"], o.get("target_field", "url")
        ok = self.need(e, o, g, name)
        u = e.text(name)
        part = lambda rx, i=1: F.nullif(F.regexp_extract(u, rx, i), F.lit(""))
        rx = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^@/?#]*)@)?([^:/?#]*)(?::(\d+))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
        good = F.coalesce(u.rlike(rx), F.lit(False))
        self.fail(e, F.concat(F.lit("unable to parse URI ["), F.coalesce(u, F.lit("null")), F.lit("]")), ok & ~good)
        values = {"scheme": part(rx, 1), "user_info": part(rx, 2), "domain": part(rx, 3), "port": part(rx, 4).try_cast("int"), "path": F.regexp_extract(u, rx, 5), "query": part(rx, 6), "fragment": part(rx, 7), "extension": part(r"^[^?#]*/[^/?#]*\.([^./?#]+)(?:[?#]|$)")}
        values |= {"username": F.nullif(F.regexp_extract(values["user_info"], "^([^:]*)", 1), F.lit("")), "password": F.nullif(F.regexp_extract(values["user_info"], "^[^:]*:(.*)$", 1), F.lit(""))}
        if o.get("keep_original", True):
            values["original"] = u
        e.set_all({f"{head}.{k}": v for k, v in values.items()}, ok & good)
        if o.get("remove_if_successful") and name != head:
            e.remove(name, ok & good)

    def p_registered_domain(self, e, o, g, depth):
        """The part of a host below its public suffix; ``suffixes`` lists those of more than one label."""
        ok = self.need(e, o, g, o["field"])
        host = F.lower(e.text(o["field"]))
        longer = "|".join(re.escape(s) for s in sorted(o.get("suffixes", ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "co.za"]), key=len, reverse=True))
        rx = rf"^(?:(.+?)\.)??([^.]+)\.((?:{longer})|[^.]+)$"
        head = o.get("target_field", "")
        head = f"{head}." if head else ""
        value = lambda i: F.nullif(F.regexp_extract(host, rx, i), F.lit(""))
        e.set_all({f"{head}domain": host, f"{head}registered_domain": F.concat_ws(".", value(2), value(3)), f"{head}top_level_domain": value(3), f"{head}subdomain": value(1)}, ok & host.rlike(rx))

    def p_community_id(self, e, o, g, depth):
        """The flow hash (version 1) of addresses, ports and protocol; IPv4, TCP and UDP."""
        from ..plans.aggs import ip_number

        src, dst = (ip_number(e.text(o.get(k, d))) for k, d in (("source_ip", "source.ip"), ("destination_ip", "destination.ip")))
        sp, dp = (e.text(o.get(k, d)).try_cast("int") for k, d in (("source_port", "source.port"), ("destination_port", "destination.port")))
        proto = F.lower(e.text(o.get("transport", "network.transport")))
        number = F.when(proto.isin("tcp", "6"), 6).when(proto.isin("udp", "17"), 17)
        swap = (src > dst) | (src == dst) & (sp > dp)
        hexes = lambda v, n: F.lpad(F.hex(v), n, "0")
        a, b, p, q = (F.when(swap, y).otherwise(x) for x, y in ((src, dst), (dst, src), (sp, dp), (dp, sp)))
        raw = F.concat(hexes(F.lit(int(o.get("seed", 0))), 4), hexes(a, 8), hexes(b, 8), hexes(number, 2), F.lit("00"), hexes(p, 4), hexes(q, 4))
        made = F.concat(F.lit("1:"), F.base64(F.unhex(F.sha1(F.unhex(raw)))))
        if not o.get("ignore_missing", True):
            self.fail(e, F.lit("flow fields are missing"), g & made.isNull())
        e.set(o.get("target_field", "network.community_id"), made, g & made.isNotNull())

    def p_user_agent(self, e, o, g, depth):
        ok = self.need(e, o, g, o["field"])
        head = o.get("target_field", "user_agent")
        e.set_all({f"{head}.{n}": v for n, v in agent_fields(e.text(o["field"])).items()}, ok)

    def p_geoip(self, e, o, g, depth):
        self.need(e, o, g, o["field"])
        f_geoip(e, Plugin("geoip", [("source", o["field"]), ("target", o.get("target_field", "geoip")), ("database", o["database_file"]), ("tag_on_failure", [])]), g)

    def p_csv(self, e, o, g, depth):
        ok = self.need(e, o, g, o["field"])
        names = o["target_fields"]
        schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
        options = {"sep": o.get("separator", ","), "quote": o.get("quote", '"'), "ignoreLeadingWhiteSpace": str(bool(o.get("trim"))).lower(), "ignoreTrailingWhiteSpace": str(bool(o.get("trim"))).lower()}
        e.df = e.df.withColumn("@metadata._csv", F.from_csv(e.text(o["field"]), schema, options))
        e.set_all({n: F.coalesce(F.col("`@metadata._csv`").getField(f"c{i}"), F.lit(o["empty_value"])) if "empty_value" in o else F.col("`@metadata._csv`").getField(f"c{i}") for i, n in enumerate(names)}, ok)
        e.df = e.df.drop("@metadata._csv")

    def p_fingerprint(self, e, o, g, depth):
        """A digest of the fields' names and texts, in the order of names, with an optional salt."""
        names = sorted(o["fields"])
        parts = [F.coalesce(F.concat(F.lit(f"|{n}|"), e.text(n)), F.lit("")) for n in names]
        text = F.concat(F.lit(str(o.get("salt", ""))), *parts).cast("binary")
        method = o.get("method", "SHA-1")
        made = {"MD5": F.md5(text), "SHA-1": F.sha1(text), "SHA-256": F.sha2(text, 256), "SHA-512": F.sha2(text, 512)}.get(method)
        if made is None:
            raise Refused(f"fingerprint method {method!r} isn't supported")
        e.set(o.get("target_field", "fingerprint"), F.base64(F.unhex(made)), g)

    def p_network_direction(self, e, o, g, depth):
        inside = {}
        for side, key, default in (("source", "source_ip", "source.ip"), ("destination", "destination_ip", "destination.ip")):
            a = e.text(o.get(key, default))
            inside[side] = F.lit(False)
            for n in o["internal_networks"]:
                for cidr in {"private": ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"], "loopback": ["127.0.0.0/8"]}.get(n, [n]):
                    inside[side] = inside[side] | in_network(a, cidr)
        s, d = inside["source"], inside["destination"]
        e.set(o.get("target_field", "network.direction"), F.when(s & d, "internal").when(s, "outbound").when(d, "inbound").otherwise("external"), g)


def template_name(name: str) -> str:
    if "{{" in name:
        raise Refused("field names made from fields aren't supported")
    return name


def run(df: DataFrame, pipeline: dict, named: dict[str, dict] | None = None, keep_failed: bool = True) -> DataFrame:
    return Pipelines(named).run(df, pipeline, keep_failed)
