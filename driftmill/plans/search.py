"""Search requests to DataFrames: aggregations, hits and the total."""

from __future__ import annotations

import json
import re
from dataclasses import replace, dataclass, field
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig, Refused
from ..functions.painless import compile_expression
from .aggs import Aggregator, beyond
from .fields import Field, Resolver
from .query import DEPTH, QueryCompiler, point

#: Keys of a request that are answered, that change no row, and that are refused.
ANSWERED = {"query", "aggs", "aggregations", "size", "from", "sort", "_source", "fields", "docvalue_fields", "stored_fields", "script_fields", "runtime_mappings", "post_filter", "search_after", "collapse", "track_total_hits", "knn"}
WITHOUT_EFFECT = {"highlight", "explain", "version", "seq_no_primary_term", "profile", "rescore", "pit", "track_scores", "indices_boost", "stats", "timeout", "preference", "allow_partial_search_results", "batched_reduce_size", "_name"}
REFUSED = {"retriever", "rank", "min_score", "suggest", "slice", "ext", "terminate_after"}


@dataclass
class SearchResult:
    """``aggs`` by path ('a > b', top-level metrics under '_metrics'), ``hits``, ``total`` and notes."""

    aggs: dict[str, DataFrame]
    hits: DataFrame | None
    total: DataFrame | None
    notes: list[str] = field(default_factory=list)

    def agg(self, path: str) -> DataFrame:
        return self.aggs[path]


def fill(template, params: dict):
    """A request with {{name}} and {{#toJson}}name{{/toJson}} replaced; a text that is one placeholder keeps the value's type."""
    if isinstance(template, dict):
        return {k: fill(v, params) for k, v in template.items()}
    if isinstance(template, list):
        return [fill(v, params) for v in template]
    if not isinstance(template, str):
        return template
    if m := re.fullmatch(r"\{\{(?:#toJson\}\})?\s*([\w.]+)\s*\}?\}?(?:\{\{/toJson\}\}|\}\})?", template):
        if m[1] in params:
            return params[m[1]]

    def one(m: re.Match) -> str:
        if m[1] not in params:
            raise Refused(f"no value for the parameter {m[1]!r}")
        v = params[m[1]]
        return v if isinstance(v, str) else json.dumps(v)

    return re.sub(r"\{\{\s*([\w.]+)\s*\}\}", one, template)


def read_request(source: str | dict) -> tuple[str, dict]:
    """(index pattern, body) of a body, a console request (GET x/_search) or a stored {params: {body}} form."""
    if isinstance(source, str):
        text = re.sub(r'"""(.*?)"""', lambda m: json.dumps(m[1]), source.strip(), flags=re.S)
        index = ""
        if m := re.match(r"(?:GET|POST)\s+/?(?:([^/\s]+)/)?_(search|count)\S*\s*", text):
            index, text = m[1] or "", text[m.end() :]
            body = json.loads(text or "{}")
            return index, {**body, "size": 0, "track_total_hits": True} if m[2] == "count" else body
        source = json.loads(text or "{}")
    if isinstance(source.get("params"), dict) and "body" in source["params"]:
        return source["params"].get("index", ""), source["params"]["body"]
    return source.get("index", "") if "body" in source else "", source.get("body", source)


def check_depth(value, depth: int = 0) -> None:
    if depth > DEPTH:
        raise Refused("request is nested too deeply")
    for v in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        check_depth(v, depth + 1)


def runtime_fields(df: DataFrame, mappings: dict, config: EngineConfig, now) -> DataFrame:
    """The DataFrame with computed fields, each open to the later ones."""
    kinds = {"long": "bigint", "double": "double", "keyword": "string", "boolean": "boolean", "date": "timestamp", "ip": "string"}
    for name, m in mappings.items():
        if m.get("type") not in kinds:
            raise Refused(f"runtime type {m.get('type')!r} isn't supported")
        value = compile_expression(m["script"], Resolver(df, config), now) if "script" in m else Resolver(df, config).find(name).column
        from_millis = m["type"] == "date" and "script" in m
        df = df.withColumn(name, F.timestamp_millis(value) if from_millis else value.cast(kinds[m["type"]]))
    return df


def sort_columns(spec, q: QueryCompiler) -> list[Column]:
    """Sort columns of a request's sort; without one, the time field from late to early."""
    return [c for c, *_ in sort_keys(spec, q)]


def sort_keys(spec, q: QueryCompiler) -> list[tuple[Column, Column, bool, bool, Field | None]]:
    """(sort column, key, descending, nulls last, field) of each part of a sort."""
    spec = [] if spec is None else spec if isinstance(spec, list) else [spec]
    if not spec and q.config.time_field:
        spec = [{q.config.time_field: "desc"}]
    out = []
    for s in spec:
        ((name, o),) = s.items() if isinstance(s, dict) else [(s, "desc" if s == "_score" else "asc")]
        o = o if isinstance(o, dict) else {"order": o}
        if name in ("_score", "_doc"):
            continue
        order = o.get("order", "asc")
        if order not in ("asc", "desc"):
            raise Refused(f"unknown sort direction {order!r}")
        down, f = order == "desc", None
        if name == "_script":
            key = compile_expression(o["script"], q.fields, q.now)
        elif name == "_geo_distance":
            target = next(k for k in o if k not in ("order", "unit", "mode", "distance_type", "ignore_unmapped"))
            key = q.distance(q.fields.get(target), point(o[target] if not isinstance(o[target], list) or not isinstance(o[target][0], (list, dict)) else o[target][0]))
        else:
            f = q.fields.find(name)
            key = f.column
            if f.array:
                mode = o.get("mode", "max" if down else "min")
                total = F.aggregate(f.column, F.lit(0.0), lambda a, v: a + v.cast("double"))
                made = {"min": lambda: F.array_min(key), "max": lambda: F.array_max(key), "sum": lambda: total, "avg": lambda: F.try_divide(total, F.size(f.column))}
                if mode not in made:
                    raise Refused(f"sort mode {mode!r} isn't supported")
                key = made[mode]()
            elif f.empty_as_missing and f.kind == "string":
                key = F.when(f.present(), key)
        missing = o.get("missing", "_last")
        if missing not in ("_last", "_first"):
            key, missing = F.coalesce(key, f.literal(missing)), "_last"
        last = missing == "_last"
        column = (key.desc_nulls_last() if last else key.desc_nulls_first()) if down else (key.asc_nulls_last() if last else key.asc_nulls_first())
        out.append((column, key, down, last, f))
    return out


def project(df: DataFrame, source, keep: list[str] = (), extra: list[str] = ()) -> DataFrame:
    """Columns that _source includes or leaves out, by name or glob; sub-fields go with their field."""
    if source is None or source is True:
        return df
    names = df.columns
    if source is False:
        return df.select(*(f"`{n}`" for n in dict.fromkeys([*keep, *extra])))
    o = source if isinstance(source, dict) else {"includes": source if isinstance(source, list) else [source]}
    wide = lambda pats, n: any(fnmatchcase(n, p) or n.startswith(p.rstrip("*").rstrip(".") + ".") or p.startswith(n + ".") for p in pats)
    strict = lambda pats, n: any(fnmatchcase(n, p) or n.startswith(p + ".") for p in pats)
    as_list = lambda v: v if isinstance(v, list) else [v] if v else []
    includes, excludes = as_list(o.get("includes", o.get("include"))), as_list(o.get("excludes", o.get("exclude")))
    chosen = [n for n in names if (not includes or wide(includes, n)) and not strict(excludes, n)]
    return df.select(*(f"`{n}`" for n in dict.fromkeys([*(k for k in keep if k in names), *chosen, *(e for e in extra if e in names)])))


def search(df: DataFrame, request: str | dict, config: EngineConfig | None = None, params: dict | None = None) -> SearchResult:
    """Answer a request over one DataFrame; what can't be answered exactly is refused."""
    config = config or EngineConfig()
    _, body = read_request(request)
    check_depth(body)
    body = fill(body, params) if params else body
    notes = []
    for k in body:
        if k in REFUSED:
            raise Refused(f"{k} isn't supported")
        if k not in ANSWERED | WITHOUT_EFFECT:
            raise Refused(f"a request doesn't know {k!r}")
        if k in WITHOUT_EFFECT:
            notes.append(f"{k} has no effect on the rows")
    if body.get("runtime_mappings"):
        df = runtime_fields(df, body["runtime_mappings"], config, config.moment())
    config = replace(config, now=config.moment())  # one clock for all parts of a request
    q = QueryCompiler(df, config)
    found = df.where(q.compile(body["query"])) if body.get("query") else df
    aggs = body.get("aggs") or body.get("aggregations") or {}
    made = Aggregator(df, found, q).run(aggs) if aggs else {}
    hits, total = None, None
    rows = found.where(q.compile(body["post_filter"])) if body.get("post_filter") else found
    size = int(body.get("size", 10))
    if "knn" in body:
        rows = nearest(rows, body["knn"], q)
    if size > 0:
        hits = hits_of(rows, body, q, size)
    if body.get("track_total_hits") is True or size == 0 and not aggs:
        total = rows.agg(F.count(F.lit(1)).alias("total"))
    return SearchResult(made, hits, total, notes)


def matching(df: DataFrame, query: dict, config: EngineConfig | None = None, runtime: dict | None = None) -> DataFrame:
    """All rows that a query matches, without order or limit."""
    config = config or EngineConfig()
    df = runtime_fields(df, runtime, config, config.moment()) if runtime else df
    return df.where(QueryCompiler(df, config).compile(query))


def hits_of(rows: DataFrame, body: dict, q: QueryCompiler, size: int) -> DataFrame:
    keys = sort_keys(body.get("sort"), q)
    order = [c for c, *_ in keys]
    start = int(body.get("from", 0))
    if size < 0 or start < 0:
        raise Refused("from and size can't be negative")
    scripts = body.get("script_fields") or {}
    for name, s in scripts.items():
        rows = rows.withColumn(name, compile_expression(s["script"], q.fields, q.now))
    if after := body.get("search_after"):
        if len(after) != len(keys):
            raise Refused("search_after needs a value for each sort key")
        cursor = [(key, None if v is None else (f.literal(v, now=q.now) if f is not None else F.lit(v)), down, last) for (_, key, down, last, f), v in zip(keys, after)]
        rows = rows.where(beyond(cursor))
    if c := body.get("collapse"):
        by = q.fields.find(c["field"]).column
        ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(*(order or [F.lit(1)]))))
        rows = ranked.where(F.col("_rank") == 1).drop("_rank")
    rows = rows.orderBy(*order) if order else rows
    rows = rows.offset(start) if start else rows
    rows = rows.limit(size)
    wanted = body.get("_source")
    listed = [f if isinstance(f, str) else f["field"] for k in ("fields", "docvalue_fields", "stored_fields") for f in ([body[k]] if isinstance(body.get(k), str) else body.get(k) or [])]
    if listed and wanted is None:
        wanted = listed
    return project(rows, wanted, extra=[*scripts, *(n for p in listed for n in rows.columns if fnmatchcase(n, p))])


def nearest(rows: DataFrame, o: dict, q: QueryCompiler) -> DataFrame:
    """Exact k nearest rows by a vector field, which a plain scan with a bounded top-k gives."""
    f = q.fields.get(o["field"])
    target = F.array(*(F.lit(float(x)) for x in o["query_vector"]))
    pairs = F.zip_with(f.column, target, lambda a, b: a.cast("double") * b)
    dot = F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    kind = o.get("similarity", "cosine")
    far = F.sqrt(F.aggregate(F.zip_with(f.column, target, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda a, v: a + v))
    score = {"dot_product": lambda: dot, "max_inner_product": lambda: dot, "cosine": lambda: F.try_divide(dot, norm(f.column) * norm(target)), "l2_norm": lambda: -far}
    if kind not in score:
        raise Refused(f"similarity {kind!r} isn't known")
    if "filter" in o:
        rows = rows.where(q.compile(o["filter"]))
    tie = [c for c, t in rows.dtypes if t in ("bigint", "int", "string") and c != o["field"]][:1]  # the id, where there is one
    return rows.withColumn("_score", score[kind]()).where(F.col("_score").isNotNull()).orderBy(F.desc("_score"), *(F.col(f"`{c}`") for c in tie)).limit(int(o.get("k", 10)))


def pages(df: DataFrame, request: dict, name: str, config: EngineConfig | None = None):
    """All pages of a composite aggregation, one DataFrame at a time, each from where the last one ended."""
    body = json.loads(json.dumps(request))
    aggs = body.get("aggs") or body["aggregations"]
    spec = aggs[name]["composite"]
    while True:
        page = search(df, body, config).agg(name)
        rows = page.collect()  # one page: composite's size at most
        if not rows:
            return
        yield page
        if len(rows) < int(spec.get("size", 10)):
            return
        last = rows[-1]
        names = [next(iter(s)) for s in spec["sources"]]
        spec["after"] = {n: (int(v.timestamp() * 1000) if hasattr(v, "timestamp") else v) for n, v in ((n, last[n]) for n in names)}
