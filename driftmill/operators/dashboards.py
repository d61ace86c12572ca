"""Saved visualizations and dashboard panels, read into search requests."""

from __future__ import annotations

import json
import math

from ..config import Refused

METRICS = {"count": None, "avg": "avg", "sum": "sum", "min": "min", "max": "max", "median": "percentiles", "cardinality": "cardinality", "percentiles": "percentiles", "percentile_ranks": "percentile_ranks", "std_dev": "extended_stats", "value_count": "value_count", "average": "avg", "unique_count": "cardinality", "last_value": "top_metrics", "standard_deviation": "extended_stats"}
PARENTS = {"derivative": "derivative", "cumulative_sum": "cumulative_sum", "moving_avg": "moving_fn", "serial_diff": "serial_diff", "moving_average": "moving_fn", "differences": "derivative"}
#: Interval steps in milliseconds.
LADDER = [(1, "1ms"), (10, "10ms"), (100, "100ms"), (1000, "1s"), (5000, "5s"), (10_000, "10s"), (30_000, "30s"), (60_000, "1m"), (300_000, "5m"), (600_000, "10m"), (1_800_000, "30m"), (3_600_000, "1h"), (10_800_000, "3h"), (43_200_000, "12h"), (86_400_000, "1d"), (604_800_000, "7d"), (2_592_000_000, "30d"), (31_536_000_000, "365d")]


def auto_interval(range_ms: float, buckets: int = 50) -> str:
    """The ladder's step that is nearest, on a log scale, to the range over the number of buckets."""
    wanted = max(range_ms / buckets, 1)
    return min(LADDER, key=lambda s: abs(math.log(s[0]) - math.log(wanted)))[1]


def query_of(source: dict) -> dict:
    """The clause of a saved query and its filters."""
    q, parts, nots = source.get("query") or {}, [], []
    text = q.get("query", "")
    if isinstance(text, dict):
        parts.append(text)
    elif text:
        parts.append({"kql": {"query": text}} if q.get("language") == "kuery" else {"query_string": {"query": text}})
    for f in source.get("filter", []):
        meta = f.get("meta", {})
        if meta.get("disabled"):
            continue
        clause = f.get("query") or {k: v for k, v in f.items() if k not in ("meta", "$state")}
        if "match_phrase" in clause or "match" in clause:
            pass
        (nots if meta.get("negate") else parts).append(clause)
    body = {k: v for k, v in (("filter", parts), ("must_not", nots)) if v}
    return {"bool": body} if body else {"match_all": {}}


def metric_agg(kind: str, params: dict) -> dict | None:
    if kind not in METRICS:
        raise Refused(f"metric {kind!r} isn't supported")
    name = METRICS[kind]
    if name is None:
        return None
    o = {"field": params["field"]}
    if kind == "median":
        o["percents"] = [50]
    elif kind == "percentiles" and params.get("percents"):
        o["percents"] = [float(p) for p in params["percents"]]
    elif kind == "percentile_ranks":
        o["values"] = [float(v) for v in params["values"]]
    elif kind == "last_value":
        o = {"metrics": {"field": params["field"]}, "sort": {params["sortField"]: "desc"}}
    return {name: o}


def bucket_agg(kind: str, params: dict, span_ms: float) -> dict:
    match kind:
        case "terms":
            order = {"_key": params.get("order", "desc")} if params.get("orderBy") == "_key" else {params["orderBy"]: params.get("order", "desc")} if params.get("orderBy") not in (None, "custom", "_count") else {"_count": params.get("order", "desc")}
            return {"terms": {"field": params["field"], "size": int(params.get("size", 5)), "order": order}}
        case "date_histogram":
            i = params.get("interval", "auto")
            names = {"s": "1s", "m": "1m", "h": "1h", "d": "1d", "w": "1w", "M": "1M", "y": "1y"}
            if i == "auto":
                return {"date_histogram": {"field": params["field"], "fixed_interval": auto_interval(span_ms), "min_doc_count": 1}}
            step = names.get(i, i)
            calendar = step in ("1w", "1M", "1y", "1d", "1h", "1m")
            return {"date_histogram": {"field": params["field"], "calendar_interval" if calendar else "fixed_interval": step, "min_doc_count": int(params.get("min_doc_count", 1))}}
        case "histogram":
            return {"histogram": {"field": params["field"], "interval": float(params["interval"]), "min_doc_count": 1}}
        case "range" | "date_range" | "ip_range":
            return {kind: {"field": params["field"], "ranges": params["ranges"]}}
        case "filters":
            return {"filters": {"filters": {f.get("label") or str(f["input"]["query"]): query_of({"query": f["input"]}) for f in params["filters"]}}}
        case "significant_terms":
            return {"significant_terms": {"field": params["field"], "size": int(params.get("size", 10))}}
    raise Refused(f"bucket {kind!r} isn't supported")


def nested_aggs(buckets: list[tuple[str, dict]], metrics: dict[str, dict]) -> dict:
    """Buckets, outermost first, with the metrics in the innermost."""
    out = metrics
    for name, body in reversed(buckets):
        out = {name: {**body, "aggs": out} if out else body}
    return out


def visualization(saved: dict, span_ms: float = 86_400_000) -> dict:
    """The request of a saved visualization (visState with aggs)."""
    a = saved.get("attributes", saved)
    state = json.loads(a["visState"]) if isinstance(a.get("visState"), str) else a["visState"]
    source = json.loads((a.get("kibanaSavedObjectMeta") or {}).get("searchSourceJSON", "{}"))
    metrics, buckets, parents = {}, [], []
    for g in state["aggs"]:
        if g.get("enabled") is False:
            continue
        kind, params, name = g["type"], g.get("params", {}), g["id"]
        if kind in PARENTS:
            parents.append((name, kind, params))
        elif g["schema"] in ("metric", "secondaryMetric", "tooltip") or kind in METRICS:
            if made := metric_agg(kind, params):
                metrics[name] = made
        else:
            buckets.append((name, bucket_agg(kind, params, span_ms)))
    for name, kind, params in parents:
        path = params.get("metricAgg", "_count")
        path = "_count" if path == "count" else path
        o = {"buckets_path": path}
        if PARENTS[kind] == "moving_fn":
            o |= {"window": int(params.get("window", 5)), "script": "MovingFunctions.unweightedAvg(values)"}
        metrics[name] = {PARENTS[kind]: o}
    return {"size": 0, "query": query_of(source), "aggs": nested_aggs(buckets, metrics)}


def lens_layer(layer: dict, query: dict | None = None, span_ms: float = 86_400_000) -> dict:
    """The request of a form-based layer: columns of buckets and metrics in their order."""
    columns, order = layer["columns"], layer.get("columnOrder") or [*layer["columns"]]
    buckets, metrics = [], {}
    for cid in order:
        c = columns[cid]
        kind, params = c["operationType"], c.get("params", {})
        if kind == "terms":
            by = params.get("orderBy", {})
            spec = {"_key": params.get("orderDirection", "asc")} if by.get("type") == "alphabetical" else {by["columnId"]: params.get("orderDirection", "desc")} if by.get("type") == "column" and columns[by["columnId"]]["operationType"] != "count" else {"_count": params.get("orderDirection", "desc")}
            buckets.append((cid, {"terms": {"field": c["sourceField"], "size": int(params.get("size", 5)), "order": spec}}))
        elif kind in ("date_histogram", "range", "filters", "histogram"):
            buckets.append((cid, bucket_agg("histogram" if kind == "range" and params.get("type") == "histogram" else kind, {**params, "field": c.get("sourceField")}, span_ms)))
        elif kind in PARENTS:
            ref = c["references"][0]
            path = "_count" if columns[ref]["operationType"] == "count" else ref
            o = {"buckets_path": path} | ({"window": int(params.get("window", 5)), "script": "MovingFunctions.unweightedAvg(values)"} if PARENTS[kind] == "moving_fn" else {})
            metrics[cid] = {PARENTS[kind]: o}
        elif kind == "counter_rate" or kind == "formula" or kind == "math":
            raise Refused(f"column {kind!r} isn't supported")
        elif made := metric_agg(kind, {**params, "field": c.get("sourceField")}):
            metrics[cid] = made
    return {"size": 0, "query": query_of({"query": query}) if query else {"match_all": {}}, "aggs": nested_aggs(buckets, metrics)}


def tsvb(series: dict, panel: dict, span_ms: float = 86_400_000) -> dict:
    """The request of one time-series panel series."""
    metrics = {}
    for m in series["metrics"]:
        kind, mid = m["type"], m["id"]
        if kind in ("derivative", "cumulative_sum", "serial_diff", "moving_average"):
            ref = m["field"]
            path = "_count" if any(x["id"] == ref and x["type"] == "count" for x in series["metrics"]) else ref
            metrics[mid] = {PARENTS[kind]: {"buckets_path": path} | ({"window": int(m.get("window", 5)), "script": "MovingFunctions.unweightedAvg(values)"} if kind == "moving_average" else {"lag": int(m.get("lag", 1))} if kind == "serial_diff" else {})}
        elif kind == "filter_ratio":
            for side in ("numerator", "denominator"):
                metrics[f"{mid}_{side}"] = {"filter": query_of({"query": m.get(side) or {"query": "*", "language": "lucene"}}), "aggs": {}}
            metrics[mid] = {"bucket_script": {"buckets_path": {s: f"{mid}_{s}>_count" for s in ("numerator", "denominator")}, "script": "params.denominator == 0 ? 0 : params.numerator / params.denominator"}}
        elif made := metric_agg(kind, m):
            metrics[mid] = made
    interval = panel.get("interval") or ">=1m"
    step = auto_interval(span_ms) if interval.startswith(">=") or interval == "auto" else interval
    buckets = [("time", {"date_histogram": {"field": panel["time_field"], "fixed_interval": step, "min_doc_count": 0}})]
    if series.get("split_mode") == "terms":
        buckets.insert(0, ("split", {"terms": {"field": series["terms_field"], "size": int(series.get("terms_size", 10))}}))
    elif series.get("split_mode") == "filters":
        buckets.insert(0, ("split", {"filters": {"filters": {f.get("label") or f["filter"]["query"]: query_of({"query": f["filter"]}) for f in series["split_filters"]}}}))
    return {"size": 0, "query": query_of({"query": panel.get("filter")}) if panel.get("filter") else {"match_all": {}}, "aggs": nested_aggs(buckets, metrics)}


def grafana_target(target: dict, span_ms: float = 86_400_000) -> dict:
    """The request of a dashboard target: its query, bucketAggs and metrics."""
    metrics, buckets = {}, []
    for m in target.get("metrics", []):
        kind, mid = m["type"], str(m["id"])
        if kind in ("raw_data", "raw_document", "logs"):
            return {"size": int((m.get("settings") or {}).get("size", 500)), "query": query_of({"query": {"query": target.get("query", ""), "language": "lucene"}}), "sort": [{target.get("timeField", "@timestamp"): "desc"}]}
        if kind in ("derivative", "cumulative_sum", "serial_diff", "moving_avg", "moving_fn"):
            ref = str(m.get("pipelineAgg") or m.get("field"))
            path = "_count" if any(str(x["id"]) == ref and x["type"] == "count" for x in target["metrics"]) else ref
            made = {"moving_avg": "moving_fn"}.get(kind, kind)
            metrics[mid] = {made: {"buckets_path": path} | ({"window": int((m.get("settings") or {}).get("window", 5)), "script": "MovingFunctions.unweightedAvg(values)"} if made == "moving_fn" else {})}
        elif kind == "bucket_script":
            metrics[mid] = {"bucket_script": {"buckets_path": {v["name"]: str(v["pipelineAgg"]) for v in m["pipelineVariables"]}, "script": m["settings"]["script"]}}
        elif made := metric_agg({"extended_stats": "std_dev"}.get(kind, kind), {**(m.get("settings") or {}), "field": m.get("field")}):
            metrics[mid] = made
    for b in target.get("bucketAggs", []):
        s = b.get("settings") or {}
        if b["type"] == "date_histogram":
            step = s.get("interval", "auto")
            step = auto_interval(span_ms) if step == "auto" or step.startswith("$") else step
            body = {"date_histogram": {"field": b.get("field") or target.get("timeField", "@timestamp"), "fixed_interval": step, "min_doc_count": int(s.get("min_doc_count", 0))}}
        elif b["type"] == "terms":
            by = s.get("orderBy", "_term")
            body = {"terms": {"field": b["field"], "size": int(s.get("size") or 10) or 2**31 - 1, "order": {{"_term": "_key"}.get(by, by): s.get("order", "desc")}, "min_doc_count": int(s.get("min_doc_count", 1))}}
        elif b["type"] == "filters":
            body = {"filters": {"filters": {f.get("label") or f["query"]: {"query_string": {"query": f["query"]}} for f in s["filters"]}}}
        else:
            body = bucket_agg(b["type"], {**s, "field": b.get("field")}, span_ms)
        buckets.append((f"b{b['id']}", body))
    text = target.get("query", "")
    return {"size": 0, "query": {"query_string": {"query": text}} if text and text != "*" else {"match_all": {}}, "aggs": nested_aggs(buckets, metrics)}


def grafana_variable(definition: dict | str) -> dict:
    """The request of a dashboard variable {find: terms, field, query, size}."""
    o = json.loads(definition) if isinstance(definition, str) else definition
    if o.get("find") != "terms":
        raise Refused("a variable must find terms")
    return {"size": 0, "query": {"query_string": {"query": o["query"]}} if o.get("query") else {"match_all": {}}, "aggs": {"values": {"terms": {"field": o["field"], "size": int(o.get("size", 500)), "order": {"_key": "asc"}}}}}
