"""Watches and alert rules: a search, a condition on its result, and a decision row."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..config import Refused
from ..functions import painless
from ..plans.fields import Resolver
from ..plans.search import SearchResult, fill

#: Hits that a total counts to, unless the request asks for all.
TOTAL_CAP = 10_000


@dataclass
class Watch:
    name: str
    body: dict

    @property
    def request(self) -> dict:
        source = self.body.get("input", {})
        if "search" not in source:
            raise Refused("a watch needs a search input")
        return source["search"]["request"]


def read_watches(text: str) -> list[Watch]:
    """Watches of a JSON object or list, of JSON lines, or of console requests PUT _watcher/watch/<name>."""
    text = text.strip()
    if re.match(r"(PUT|POST)\s", text):
        parts = re.split(r"(?m)^(?:PUT|POST)\s+/?_watcher/watch/(\S+)\s*$", text)[1:]
        return [Watch(n, json.loads(b)) for n, b in zip(parts[::2], parts[1::2])]
    try:
        loaded = json.loads(text)
    except json.JSONDecodeError:
        loaded = [json.loads(line) for line in text.splitlines() if line.strip()]
    listed = loaded if isinstance(loaded, list) else [loaded] if "trigger" in loaded or "watch" in loaded else [{"_id": k, "watch": v} for k, v in loaded.items()]
    return [Watch(w.get("_id", w.get("id", f"watch-{i}")), w.get("watch", w.get("_source", w))) for i, w in enumerate(listed)]


# ---------------------------------------------------------------- schedules

_DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def _times(spec) -> list[tuple[int, int]]:
    out = []
    for at in spec if isinstance(spec, list) else [spec]:
        if isinstance(at, dict):
            hours, minutes = (v if isinstance(v, list) else [v] for v in (at.get("hour", 0), at.get("minute", 0)))
            out += [(int(h), int(m)) for h in hours for m in minutes]
        else:
            h, _, m = {"noon": "12:00", "midnight": "00:00"}.get(at, at).partition(":")
            out.append((int(h), int(m or 0)))
    return out


def cron_of(schedule: dict) -> list[str]:
    """Five-field cron expressions of a schedule."""
    (kind, o), = schedule.items()
    listed = o if isinstance(o, list) else [o]
    match kind:
        case "interval":
            m = re.fullmatch(r"(\d+)([smhdw]?)", str(o))
            if not m:
                raise Refused(f"unknown interval {o!r}")
            n, unit = int(m[1]), m[2] or "s"
            if unit == "s":
                if n % 60:
                    raise Refused("cron has no seconds")
                n, unit = n // 60, "m"
            return {"m": [f"*/{n} * * * *"], "h": [f"0 */{n} * * *"], "d": [f"0 0 */{n} * *"], "w": ["0 0 * * 0"]}[unit]
        case "hourly":
            return [f"{','.join(str(m) for h in listed for m in (h.get('minute', 0) if isinstance(h.get('minute', 0), list) else [h.get('minute', 0)]))} * * * *"]
        case "daily":
            return [f"{m} {h} * * *" for d in listed for h, m in _times(d.get("at", "00:00"))]
        case "weekly":
            days = lambda d: d if isinstance(d, list) else [d]
            number = lambda d: (next(i for i, n in enumerate(_DAYS) if n.startswith(str(d).lower()[:3])) + 1) % 7
            return [f"{m} {h} * * {number(day)}" for w in listed for day in days(w.get("on", w.get("day"))) for h, m in _times(w.get("at", w.get("time", "00:00")))]
        case "monthly":
            return [f"{m} {h} {day} * *" for w in listed for day in (w["on"] if isinstance(w["on"], list) else [w["on"]]) for h, m in _times(w.get("at", "00:00"))]
        case "yearly":
            return [f"{m} {h} {w.get('on', 1)} {w['in']} *" for w in listed for h, m in _times(w.get("at", "00:00"))]
        case "cron":
            out = []
            for c in listed:
                parts = c.split()
                if len(parts) not in (6, 7) or parts[0] not in ("0", "*"):
                    raise Refused(f"cron {c!r} needs seconds")
                week = re.sub(r"\d", lambda m: str((int(m[0]) - 1) % 7), parts[5]) if parts[5] != "?" else "*"
                out.append(" ".join([*parts[1:3], parts[3].replace("?", "*"), parts[4], week]))
            return out
    raise Refused(f"schedule {kind!r} isn't known")


# ---------------------------------------------------------------- conditions


def compared(value: Column, op: str, threshold) -> Column:
    """A comparison; a missing value satisfies not_eq alone, a text threshold compares texts."""
    if threshold is None:
        return value.isNotNull() if op == "not_eq" else value.isNull() if op == "eq" else F.lit(False)
    text = isinstance(threshold, str) and not re.fullmatch(r"-?\d+(\.\d+)?", threshold)
    v = value.cast("string") if text else value.try_cast("double") if isinstance(threshold, str) else value
    t = F.lit(float(threshold) if isinstance(threshold, str) and not text else threshold)
    made = {"eq": v == t, "not_eq": v != t, "gt": v > t, "gte": v >= t, "lt": v < t, "lte": v <= t}.get(op)
    if made is None:
        raise Refused(f"unknown comparison {op!r}")
    return F.coalesce(made, F.lit(op == "not_eq"))


class Payload:
    """Paths of ctx.payload as Columns over a one-row DataFrame, or over a level's buckets."""

    def __init__(self, request: dict, result: SearchResult):
        self.request, self.result = request, result
        self.tree = request["body"].get("aggs") or request["body"].get("aggregations") or {}

    def total(self) -> DataFrame:
        counted = self.result.total.select(F.col("total"))
        return counted if self.request["body"].get("track_total_hits") is True and not self.request.get("_capped", True) else counted.select(F.least("total", F.lit(TOTAL_CAP)).alias("total"))

    def scalar(self, path: str) -> tuple[DataFrame, Column]:
        parts = path.removeprefix("ctx.payload.").split(".")
        if parts[:2] == ["hits", "total"]:
            if len(parts) > 2:
                return self.total(), F.lit(None).cast("bigint")
            return self.total(), F.col("total")
        if parts[0] in ("aggregations", "aggs"):
            df = self.result.aggs["_metrics"]
            name = parts[1] if parts[-1] == "value" or len(parts) == 2 else f"{parts[1]}_{parts[2]}"
            if name not in df.columns and parts[1] in self.result.aggs:
                df = self.result.aggs[parts[1]]
                name = parts[2] if len(parts) > 2 else "doc_count"
            return df, F.col(f"`{name}`")
        raise Refused(f"payload path {path!r} isn't supported")

    def rows(self, path: str) -> DataFrame:
        parts = path.removeprefix("ctx.payload.").split(".")
        if parts[0] in ("aggregations", "aggs") and parts[-1] == "buckets":
            return self.result.aggs[" > ".join(parts[1:-1])]
        if parts == ["hits", "hits"]:
            return self.result.hits
        raise Refused(f"payload path {path!r} isn't supported")


def decision(watch: Watch, catalog: Catalog, at: datetime, index: str | None = None) -> DataFrame:
    """One row: ``fired``, whether the watch's condition holds at a scheduled time, and ``value``, what it looked at."""
    request = json.loads(json.dumps(watch.request))
    values = {"ctx.trigger.scheduled_time": at.isoformat() + "Z", "ctx.execution_time": at.isoformat() + "Z", "ctx.trigger.triggered_time": at.isoformat() + "Z"}
    values |= {f"ctx.metadata.{k}": v for k, v in watch.body.get("metadata", {}).items()}
    body = fill(request["body"], values)
    capped = body.get("track_total_hits") is not True
    table = index or ",".join(request["indices"]) if isinstance(request.get("indices"), list) else index or request.get("indices", "")
    result = catalog.search({**body, "track_total_hits": True}, table, now=at)
    payload = Payload({"body": body, "_capped": capped}, result)
    condition = fill(watch.body.get("condition", {"always": {}}), values)
    (kind, o), = condition.items()
    yes = lambda fired: payload.total().select(F.lit(fired).alias("fired"), F.lit(None).cast("string").alias("value"))
    match kind:
        case "always":
            return yes(True)
        case "never":
            return yes(False)
        case "compare":
            (path, test), = o.items()
            (op, threshold), = test.items()
            df, c = payload.scalar(path)
            return df.select(compared(c, op, threshold).alias("fired"), c.cast("string").alias("value"))
        case "array_compare":
            (path, spec), = o.items()
            op = next(k for k in spec if k != "path")
            threshold, quantifier = spec[op]["value"], spec[op].get("quantifier", "some")
            rows = payload.rows(path)
            name = (spec.get("path") or "doc_count").removesuffix(".value").replace(".", "_")
            test = compared(F.col(f"`{name}`"), op, threshold)
            n = F.count(F.when(test if quantifier == "some" else ~test, 1))
            return rows.agg((n > 0 if quantifier == "some" else n == 0).alias("fired"), n.cast("string").alias("value"))
        case "script":
            source, params = painless.script_of(o if isinstance(o, str) else o)
            df, made = payload.total(), None
            found = re.findall(r"ctx\.payload(?:\.\w+)+", source)
            holder = df
            for i, p in enumerate(dict.fromkeys(found)):
                d, c = payload.scalar(p)
                holder = holder.join(d.select(c.alias(f"_v{i}")))  # one row each
                source = source.replace(p, f"doc['_v{i}'].value")
            made = painless.compile_expression({"source": source, "params": params}, Resolver(holder, catalog.tables[next(iter(catalog.tables))][1]))
            return holder.select(F.coalesce(made, F.lit(False)).alias("fired"), F.lit(None).cast("string").alias("value"))
    raise Refused(f"condition {kind!r} isn't supported")


def rule_request(rule: dict, at: datetime) -> tuple[str, dict, tuple[str, list]]:
    """(index, search body, (comparator, thresholds)) of a query, index-threshold, log-count or custom-threshold rule."""
    p = rule["params"]
    unit = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}
    size, u = (p.get("timeWindowSize") or p.get("timeSize") or 5), (p.get("timeWindowUnit") or p.get("timeUnit") or "m")
    since = at - timedelta(**{unit[u]: int(size)})
    time = p.get("timeField", "@timestamp")
    window = {"range": {time: {"gte": since.isoformat() + "Z", "lt": at.isoformat() + "Z"}}}
    kind = rule["rule_type_id"].lstrip(".")
    comparators = {">": "gt", ">=": "gte", "<": "lt", "<=": "lte", "between": "between", "notBetween": "not_between", "more than": "gt", "less than": "lt", "equals": "eq"}
    op = comparators[p.get("thresholdComparator") or p.get("comparator") or (p.get("count") or {}).get("comparator") or ">"]
    threshold = p.get("threshold") or [(p.get("count") or {}).get("value", 0)]
    if kind == "es-query":
        q = json.loads(p["esQuery"])["query"] if "esQuery" in p else {"kql": {"query": p["searchConfiguration"]["query"]["query"]}}
        index = ",".join(p["index"]) if isinstance(p.get("index"), list) else p.get("index", "")
        return index, {"size": 0, "query": {"bool": {"filter": [q, window]}}}, (op, threshold)
    if kind == "index-threshold":
        index = ",".join(p["index"]) if isinstance(p["index"], list) else p["index"]
        body = {"size": 0, "query": {"bool": {"filter": [window]}}}
        metric = None if p.get("aggType", "count") == "count" else {"m": {p["aggType"]: {"field": p["aggField"]}}}
        if p.get("groupBy") == "top":
            body["aggs"] = {"groups": {"terms": {"field": p["termField"], "size": int(p["termSize"])}, **({"aggs": metric} if metric else {})}}
        elif metric:
            body["aggs"] = metric
        return index, body, (op, threshold)
    if kind == "logs.alert.document.count":
        tests = {"equals": "term", "matches": "match", "matches phrase": "match_phrase"}
        made, negated = [], []
        for c in p.get("criteria", []):
            name = c["comparator"]
            if name in tests:
                made.append({tests[name]: {c["field"]: c["value"]}})
            elif name.removeprefix("does not ").removeprefix("not ") != name:
                base = {"does not equal": "term", "does not match": "match", "does not match phrase": "match_phrase"}[name]
                negated.append({base: {c["field"]: c["value"]}})
            else:
                made.append({"range": {c["field"]: {comparators[name]: c["value"]}}})
        return p.get("index", ""), {"size": 0, "query": {"bool": {"filter": [window, *made], "must_not": negated}}}, (op, threshold)
    raise Refused(f"rule type {kind!r} isn't supported")


def rule_decision(rule: dict, catalog: Catalog, at: datetime, index: str | None = None) -> DataFrame:
    """Whether a rule fires: one row, or with groups a row for each group."""
    named, body, (op, threshold) = rule_request(rule, at)
    result = catalog.search({**body, "track_total_hits": True}, index or named, now=at)
    if "groups" in result.aggs:
        df = result.aggs["groups"]
        value, keys = F.col("m") if "m" in df.columns else F.col("doc_count"), [F.col("groups").cast("string").alias("group")]
    elif "_metrics" in result.aggs:
        df, value, keys = result.aggs["_metrics"], F.col("m"), []
    else:
        df, value, keys = result.total, F.col("total"), []
    if op in ("between", "not_between"):
        inside = (value > threshold[0]) & (value < threshold[1])
        fired = F.coalesce(inside if op == "between" else ~inside, F.lit(False))
    else:
        fired = compared(value, op, threshold[0])
    return df.select(*keys, fired.alias("fired"), value.cast("double").alias("value"))
