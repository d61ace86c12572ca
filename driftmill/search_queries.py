"""Registered search queries, one for each operator, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from .catalog import driver_catalog
from .plans.search import matching

NOW = datetime(2024, 1, 31)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rows(name: str, table: str, query: dict, columns: str, where: str, runtime: dict | None = None, relation: str | None = None) -> None:
    """A query whose result is every matching row's columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, config = driver_catalog(spark, sf_dir).resolve(table)
        return matching(df, query, replace(config, now=NOW), runtime).selectExpr(*columns.split(", "))

    QUERIES[name] = run
    SQL[name] = f"SELECT {columns} FROM {relation or table} WHERE {where}"


def agg(name: str, table: str, body: dict, path: str, columns: list[str], sql: str, **config) -> None:
    """A query whose result is one of a request's aggregations."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = driver_catalog(spark, sf_dir).search({"size": 0, **body}, table, now=NOW, **config)
        return result.agg(path).selectExpr(*columns)

    QUERIES[name] = run
    SQL[name] = sql


def hits(name: str, table: str, body: dict, columns: list[str] | None, sql: str, total: bool = False) -> None:
    """A query whose result is a request's hits, or their total."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = driver_catalog(spark, sf_dir).search(body, table, now=NOW)
        found = result.total if total else result.hits
        return found.selectExpr(*columns) if columns else found

    QUERIES[name] = run
    SQL[name] = sql


# ---------------------------------------------------------------- clauses

EV = "events"
MAYBE = {"kind": {"type": "keyword", "script": "if (doc['event_type'].value == 'error') return null; return doc['event_type'].value"}}
WITH_KIND = "(SELECT *, nullif(event_type, 'error') AS kind FROM events)"
rows("match_all", EV, {"match_all": {}}, "event_id", "true")
rows("match_none", EV, {"match_none": {}}, "event_id", "false")
rows("term", EV, {"term": {"event_type": "click"}}, "event_id", "event_type = 'click'")
rows("term_case_insensitive", EV, {"term": {"event_type.keyword": {"value": "CLICK", "case_insensitive": True}}}, "event_id", "lower(event_type) = 'click'")
rows("terms_in", EV, {"terms": {"user_id": [1, 2, 3, "5"]}}, "event_id, user_id", "user_id IN (1, 2, 3, 5)")
rows("range_num", EV, {"range": {"value": {"gte": 10, "lt": 20.5}}}, "event_id, value", "value >= 10 AND value < 20.5")
rows("range_date_math", EV, {"range": {"ts": {"gte": "now-7d/d", "lt": "now/d"}}}, "event_id", "ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31'")
rows("range_date_rounds_up", EV, {"range": {"ts": {"gt": "2024-01-05", "lte": "2024-01-10||/d"}}}, "event_id", "ts > TIMESTAMP '2024-01-05 23:59:59.999' AND ts <= TIMESTAMP '2024-01-10 23:59:59.999'")
rows("range_date_zone", EV, {"range": {"ts": {"gte": "2024-01-10", "lt": "2024-01-11", "time_zone": "Europe/Paris"}}}, "event_id", "ts >= TIMESTAMP '2024-01-09 23:00:00' AND ts < TIMESTAMP '2024-01-10 23:00:00'")
rows("range_date_format", EV, {"range": {"ts": {"gte": "05/01/2024", "lte": "06/01/2024", "format": "dd/MM/yyyy||yyyy"}}}, "event_id", "ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-06 23:59:59.999'")
rows("range_from_to", EV, {"range": {"value": {"from": 5, "to": 6, "include_lower": False}}}, "event_id", "value > 5 AND value <= 6")
rows("exists", EV, {"exists": {"field": "kind"}}, "event_id", "kind IS NOT NULL", MAYBE, WITH_KIND)
rows("exists_attribute", EV, {"exists": {"field": "props.k"}}, "event_id", "json_extract_string(props, '$.k') IS NOT NULL")
rows("must_not_null", EV, {"bool": {"must_not": [{"term": {"kind": "click"}}]}}, "event_id", "kind IS DISTINCT FROM 'click'", MAYBE, WITH_KIND)
rows("prefix", EV, {"prefix": {"event_type": {"value": "SI", "case_insensitive": True}}}, "event_id", "starts_with(event_type, 'si')")
rows("wildcard", EV, {"wildcard": {"event_type": "?i*n*"}}, "event_id", "regexp_full_match(event_type, '.i.*n.*')")
rows("regexp", EV, {"regexp": {"event_type": "(cl|pur).*[ke]"}}, "event_id", "regexp_full_match(event_type, '(cl|pur).*[ke]')")
rows("fuzzy", EV, {"fuzzy": {"event_type": {"value": "clcik", "fuzziness": "AUTO"}}}, "event_id", "damerau_levenshtein(event_type, 'clcik') <= 1")
rows("fuzzy_prefix_length", EV, {"fuzzy": {"event_type": {"value": "singupp", "fuzziness": 2, "prefix_length": 1}}}, "event_id", "event_type = 'signup'")
rows("ids", EV, {"ids": {"values": ["1", "7", "11"]}}, "event_id, event_type", "event_id IN (1, 7, 11)")
rows("bool_mixed", EV, {"bool": {"filter": [{"range": {"value": {"gt": 30}}}], "must": {"terms": {"event_type": ["click", "view"]}}, "must_not": {"term": {"user_id": 8}}, "should": [{"term": {"user_id": 46}}]}}, "event_id", "value > 30 AND event_type IN ('click', 'view') AND user_id <> 8")
rows("bool_minimum_should_match", EV, {"bool": {"should": [{"term": {"event_type": "click"}}, {"range": {"value": {"gt": 50}}}, {"range": {"user_id": {"lt": 20}}}], "minimum_should_match": 2}}, "event_id", "(event_type = 'click')::INT + (value > 50)::INT + (user_id < 20)::INT >= 2")
rows("bool_msm_percent", EV, {"bool": {"should": [{"term": {"event_type": "click"}}, {"range": {"value": {"gt": 50}}}, {"range": {"user_id": {"lt": 20}}}], "minimum_should_match": "-34%"}}, "event_id", "(event_type = 'click')::INT + (value > 50)::INT + (user_id < 20)::INT >= 2")
rows("dis_max", EV, {"dis_max": {"queries": [{"term": {"event_type": "view"}}, {"range": {"value": {"lt": 1}}}]}}, "event_id", "event_type = 'view' OR value < 1")
rows("constant_score", EV, {"constant_score": {"filter": {"term": {"event_type": "view"}}, "boost": 2}}, "event_id", "event_type = 'view'")
rows("boosting", EV, {"boosting": {"positive": {"term": {"event_type": "view"}}, "negative": {"match_all": {}}, "negative_boost": 0.5}}, "event_id", "event_type = 'view'")
rows("function_score", EV, {"function_score": {"query": {"range": {"value": {"gte": 99}}}, "functions": []}}, "event_id", "value >= 99")
rows("attribute_term", EV, {"term": {"props.k": "42"}}, "event_id", "json_extract_string(props, '$.k') = '42'")
rows("script_query", EV, {"script": {"script": {"source": "doc['value'].value / 2 > params.least && doc['event_type'].value.startsWith('c')", "params": {"least": 25}}}}, "event_id", "value / 2 > 25 AND starts_with(event_type, 'c')")
rows("runtime_field", EV, {"term": {"size_class": "large"}}, "event_id, size_class", "value > 40", {"size_class": {"type": "keyword", "script": {"source": "def v = doc['value'].value; if (v > 40) { emit('large') } else if (v > 10) { emit('middle') } else { emit('small') }"}}}, "(SELECT *, CASE WHEN value > 40 THEN 'large' WHEN value > 10 THEN 'middle' ELSE 'small' END AS size_class FROM events)")
rows("runtime_date_script", EV, {"range": {"hour": {"gte": 8, "lt": 18}}}, "event_id, hour", "hour >= 8 AND hour < 18", {"hour": {"type": "long", "script": "emit(doc['ts'].value.getHour())"}}, "(SELECT *, hour(ts) AS hour FROM events)")
rows("geo_distance", EV, {"bool": {"must_not": [{"geo_distance": {"distance": "12km", "spot": "48.85,2.35"}}]}}, "event_id", "2 * 6371008.7714 * asin(sqrt(pow(sin(radians(48.85 - (48 + value / 100)) / 2), 2) + cos(radians(48 + value / 100)) * cos(radians(48.85)) * pow(sin(radians(2.35 - (2 + user_id / 100)) / 2), 2))) > 12000")


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, config = driver_catalog(spark, sf_dir).resolve(EV)
    placed = df.selectExpr("event_id", "named_struct('lat', 48 + value / 100, 'lon', 2 + user_id / 100) as spot")
    return matching(placed, {"bool": {"must_not": [{"geo_distance": {"distance": "12km", "spot": "48.85,2.35"}}]}}, config).select("event_id")


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, config = driver_catalog(spark, sf_dir).resolve("orders")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey", "struct(l_quantity as quantity, l_returnflag as flag) as item").groupBy("l_orderkey").agg({"item": "collect_list"}).toDF("l_orderkey", "items")
    query = {"nested": {"path": "items", "query": {"bool": {"filter": [{"range": {"items.quantity": {"gt": 48}}}, {"term": {"items.flag": "R"}}]}}}}
    return matching(items, query, config).select("l_orderkey")


QUERIES["geo_distance"], QUERIES["nested"] = _geo, _nested
SQL["nested"] = "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 48 AND l_returnflag = 'R'"

# ---------------------------------------------------------------- full text

DOC = "documents"


def word(w: str) -> str:
    return f"regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_]){w}($|[^\\p{{L}}\\p{{N}}_])', 'i')"


rows("match_or", DOC, {"match": {"text": "idiot moron"}}, "doc_id", f"{word('idiot')} OR {word('moron')}")
rows("match_and", DOC, {"match": {"text": {"query": "idiot the", "operator": "and"}}}, "doc_id", f"{word('idiot')} AND {word('the')}")
rows("match_msm", DOC, {"match": {"text": {"query": "idiot moron scum trash", "minimum_should_match": 2}}}, "doc_id", " + ".join(f"({word(w)})::INT" for w in ("idiot", "moron", "scum", "trash")) + " >= 2")
rows("match_phrase", DOC, {"match_phrase": {"text": "of the"}}, "doc_id", word("of[^\\p{L}\\p{N}_]+the"))
rows("match_phrase_slop", DOC, {"match_phrase": {"text": {"query": "to the", "slop": 1}}}, "doc_id", word("to([^\\p{L}\\p{N}_]+[\\p{L}\\p{N}_]+)?[^\\p{L}\\p{N}_]+the"))
rows("match_phrase_prefix", DOC, {"match_phrase_prefix": {"text": "released und"}}, "doc_id", "regexp_matches(text, '(^|[^\\p{L}\\p{N}_])released[^\\p{L}\\p{N}_]+und', 'i')")
rows("match_bool_prefix", DOC, {"match_bool_prefix": {"text": "worthless idio"}}, "doc_id", f"{word('worthless')} OR regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_])idio', 'i')")
rows("multi_match", DOC, {"multi_match": {"query": "license de", "fields": ["text", "lang"], "type": "best_fields"}}, "doc_id", f"{word('license')} OR {word('de')} OR lang = 'license de'")
rows("multi_match_cross", DOC, {"multi_match": {"query": "license fr", "fields": ["text", "lang"], "type": "cross_fields", "operator": "and"}}, "doc_id", f"({word('license')} OR regexp_matches(lang, '^license$')) AND ({word('fr')} OR lang = 'fr')")
rows("combined_fields", DOC, {"combined_fields": {"query": "mit license", "fields": ["text"], "operator": "and"}}, "doc_id", f"{word('mit')} AND {word('license')}")
rows("query_string", DOC, {"query_string": {"query": 'text:(idiot OR "mit license") AND NOT lang:de AND n_chars:[100 TO 5000}', "default_field": "text"}}, "doc_id", f"({word('idiot')} OR {word('mit[^\\p{L}\\p{N}_]+license')}) AND lang <> 'de' AND n_chars >= 100 AND n_chars < 5000")
rows("query_string_forms", DOC, {"query_string": {"query": "+lang:/e[ns]/ -source:src1* n_chars:>=1000", "default_field": "text"}}, "doc_id", "lang IN ('en', 'es') AND NOT starts_with(source, 'src1')")
rows("simple_query_string", DOC, {"simple_query_string": {"query": '"mit license" | idiot + -moron', "fields": ["text"]}}, "doc_id", f"({word('mit[^\\p{L}\\p{N}_]+license')} OR {word('idiot')}) AND NOT {word('moron')}")
rows("kql", DOC, {"kql": {"query": 'lang: (en or fr) and not source: src0 and n_chars > 500 and text: "of the"'}}, "doc_id", f"lang IN ('en', 'fr') AND source <> 'src0' AND n_chars > 500 AND {word('of[^\\p{L}\\p{N}_]+the')}")
rows("kql_wildcard", DOC, {"kql": {"query": "source: src1* or lang: *"}}, "doc_id", "true")

# ---------------------------------------------------------------- metrics

R = "round({}, 4) AS {}"


def rounded(*names: str) -> list[str]:
    return [f"round({n}, 4) AS {n}" for n in names]


agg("agg_avg_sum_min_max", EV, {"aggs": {"a": {"avg": {"field": "value"}}, "s": {"sum": {"field": "value"}}, "lo": {"min": {"field": "value"}}, "hi": {"max": {"field": "value"}}, "n": {"value_count": {"field": "value"}}}}, "_metrics", [*rounded("a", "s"), "lo", "hi", "n"], "SELECT round(avg(value), 4) AS a, round(sum(value), 4) AS s, min(value) AS lo, max(value) AS hi, count(value) AS n FROM events")
agg("agg_sum_of_nothing", EV, {"query": {"term": {"event_type": "none"}}, "aggs": {"s": {"sum": {"field": "value"}}, "a": {"avg": {"field": "value"}}}}, "_metrics", ["s", "a"], "SELECT coalesce(sum(value), 0)::DOUBLE AS s, avg(value) AS a FROM events WHERE event_type = 'none'")
agg("agg_missing_value", EV, {"runtime_mappings": {"v": {"type": "double", "script": "if (doc['event_type'].value == 'error') { return null; } return doc['value'].value"}}, "aggs": {"a": {"avg": {"field": "v", "missing": 100}}}}, "_metrics", rounded("a"), "SELECT round(avg(CASE WHEN event_type = 'error' THEN 100 ELSE value END), 4) AS a FROM events")
agg("agg_stats", EV, {"aggs": {"st": {"stats": {"field": "value"}}}}, "_metrics", ["st_count", "st_min", "st_max", *rounded("st_avg", "st_sum")], "SELECT count(value) AS st_count, min(value) AS st_min, max(value) AS st_max, round(avg(value), 4) AS st_avg, round(sum(value), 4) AS st_sum FROM events")
agg("agg_extended_stats", EV, {"aggs": {"st": {"extended_stats": {"field": "value"}}}}, "_metrics", ["st_count", *rounded("st_variance", "st_std_deviation"), "round(st_sum_of_squares, 2) AS st_sum_of_squares"], "SELECT count(value) AS st_count, round(var_pop(value), 4) AS st_variance, round(stddev_pop(value), 4) AS st_std_deviation, round(sum(value * value), 2) AS st_sum_of_squares FROM events")
agg("agg_percentiles", EV, {"aggs": {"p": {"percentiles": {"field": "value", "percents": [5, 50, 99.9]}}}}, "_metrics", ["round(p[0], 6) AS p5", "round(p[1], 6) AS p50", "round(p[2], 6) AS p999"], "SELECT round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.999), 6) AS p999 FROM events")
agg("agg_percentile_ranks", EV, {"aggs": {"p": {"percentile_ranks": {"field": "value", "values": [10, 50]}}}}, "_metrics", ["p__d10 AS p10", "p__d50 AS p50"], "SELECT round(100.0 * count(*) FILTER (value <= 10) / count(value), 3) AS p10, round(100.0 * count(*) FILTER (value <= 50) / count(value), 3) AS p50 FROM events")
agg("agg_boxplot", EV, {"aggs": {"b": {"boxplot": {"field": "value"}}}}, "_metrics", ["round(b[0], 6) AS lo", "round(b[1], 6) AS q1", "round(b[2], 6) AS q2", "round(b[3], 6) AS q3", "round(b[4], 6) AS hi"], "SELECT round(min(value), 6) AS lo, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS hi FROM events")
agg("agg_cardinality", EV, {"aggs": {"u": {"cardinality": {"field": "user_id"}}}}, "_metrics", ["u"], "SELECT count(DISTINCT user_id) AS u FROM events")
agg("agg_weighted_avg", "lineitem", {"aggs": {"w": {"weighted_avg": {"value": {"field": "l_discount"}, "weight": {"field": "l_quantity"}}}}}, "_metrics", ["round(w, 6) AS w"], "SELECT round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS w FROM lineitem")
agg("agg_top_metrics", EV, {"aggs": {"by": {"terms": {"field": "event_type"}, "aggs": {"t": {"top_metrics": {"metrics": {"field": "value"}, "sort": {"ts": "desc"}}}}}}}, "by", ["by", "doc_count", "t_value"], "SELECT event_type AS by, count(*) AS doc_count, arg_max(value, ts) AS t_value FROM events GROUP BY 1")
agg("agg_script_metric", EV, {"aggs": {"m": {"avg": {"script": {"source": "Math.floor(doc['value'].value) * params.k", "params": {"k": 2}}}}}}, "_metrics", rounded("m"), "SELECT round(avg(floor(value) * 2), 4) AS m FROM events")
agg("agg_string_stats", EV, {"aggs": {"x": {"string_stats": {"field": "event_type"}}}}, "_metrics", ["x_count", "x_min_length", "x_max_length", *rounded("x_avg_length")], "SELECT count(event_type) AS x_count, min(length(event_type))::INT AS x_min_length, max(length(event_type))::INT AS x_max_length, round(avg(length(event_type)), 4) AS x_avg_length FROM events")
agg("agg_rate", EV, {"aggs": {"d": {"date_histogram": {"field": "ts", "calendar_interval": "day"}, "aggs": {"r": {"rate": {"unit": "hour", "field": "value"}}}}}}, "d", ["cast(d as timestamp_ntz) AS d", "round(r, 4) AS r"], "SELECT date_trunc('day', ts) AS d, round(sum(value) / 24, 4) AS r FROM events GROUP BY 1")

# ---------------------------------------------------------------- buckets

TOP = "SELECT {k} AS by, count(*) AS doc_count FROM {t} GROUP BY 1 ORDER BY {o} LIMIT {n}"
agg("agg_terms_topn", EV, {"aggs": {"by": {"terms": {"field": "user_id", "size": 7}}}}, "by", ["by", "doc_count"], TOP.format(k="user_id", t="events", o="2 DESC, 1", n=7))
agg("agg_terms_order_metric", EV, {"aggs": {"by": {"terms": {"field": "user_id", "size": 5, "order": {"m": "desc"}}, "aggs": {"m": {"max": {"field": "value"}}}}}}, "by", ["by", "doc_count", "m"], "SELECT user_id AS by, count(*) AS doc_count, max(value) AS m FROM events GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 5")
agg("agg_terms_include", EV, {"aggs": {"by": {"terms": {"field": "event_type", "include": ".*i.*", "exclude": ["view"], "min_doc_count": 2}}}}, "by", ["by", "doc_count"], "SELECT event_type AS by, count(*) AS doc_count FROM events WHERE event_type LIKE '%i%' AND event_type <> 'view' GROUP BY 1")
agg("agg_terms_missing", EV, {"runtime_mappings": MAYBE, "aggs": {"by": {"terms": {"field": "kind", "missing": "n/a"}}}}, "by", ["by", "doc_count"], "SELECT coalesce(nullif(event_type, 'error'), 'n/a') AS by, count(*) AS doc_count FROM events GROUP BY 1")
NEST = """WITH t AS (SELECT event_type AS a, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)
SELECT a, b, doc_count, v FROM (SELECT event_type AS a, user_id AS b, count(*) AS doc_count, round(avg(value), 4) AS v,
row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS r FROM events WHERE event_type IN (SELECT a FROM t) GROUP BY 1, 2) WHERE r <= 4"""
agg("agg_terms_nested", EV, {"aggs": {"a": {"terms": {"field": "event_type", "size": 3}, "aggs": {"b": {"terms": {"field": "user_id", "size": 4}, "aggs": {"v": {"avg": {"field": "value"}}}}}}}}, "a > b", ["a", "b", "doc_count", *rounded("v")], NEST)
agg("agg_multi_terms", "lineitem", {"aggs": {"m": {"multi_terms": {"terms": [{"field": "l_returnflag"}, {"field": "l_linestatus"}], "size": 3}}}}, "m", ["m_l_returnflag AS f", "m_l_linestatus AS s", "doc_count"], "SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS doc_count FROM lineitem GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 3")
agg("agg_rare_terms", "orders", {"aggs": {"by": {"rare_terms": {"field": "o_custkey", "max_doc_count": 3}}}}, "by", ["by", "doc_count"], "SELECT o_custkey AS by, count(*) AS doc_count FROM orders GROUP BY 1 HAVING count(*) <= 3")
agg("agg_date_histogram_cal", EV, {"aggs": {"d": {"date_histogram": {"field": "ts", "calendar_interval": "week"}, "aggs": {"s": {"sum": {"field": "value"}}}}}}, "d", ["cast(d as timestamp_ntz) AS d", "doc_count", *rounded("s")], "SELECT date_trunc('week', ts) AS d, count(*) AS doc_count, round(sum(value), 4) AS s FROM events GROUP BY 1")
agg("agg_date_histogram_fixed", EV, {"aggs": {"d": {"date_histogram": {"field": "ts", "fixed_interval": "7h", "offset": "+2h", "min_doc_count": 1}}}}, "d", ["cast(d as timestamp_ntz) AS d", "doc_count"], "SELECT time_bucket(INTERVAL '7 hours', ts - INTERVAL '2 hours', TIMESTAMP '1970-01-01') + INTERVAL '2 hours' AS d, count(*) AS doc_count FROM events GROUP BY 1")
agg("agg_date_histogram_zone", EV, {"aggs": {"d": {"date_histogram": {"field": "ts", "calendar_interval": "day", "time_zone": "America/New_York", "min_doc_count": 1}}}}, "d", ["cast(d as timestamp_ntz) AS d", "doc_count"], "SELECT date_trunc('day', ts - INTERVAL '5 hours') + INTERVAL '5 hours' AS d, count(*) AS doc_count FROM events GROUP BY 1")
agg("agg_date_histogram_fill", EV, {"query": {"term": {"user_id": 8}}, "aggs": {"d": {"date_histogram": {"field": "ts", "fixed_interval": "1h", "extended_bounds": {"min": "2023-12-31", "max": "2024-02-01"}}, "aggs": {"s": {"sum": {"field": "value"}}, "a": {"avg": {"field": "value"}}}}}}, "d", ["cast(d as timestamp_ntz) AS d", "doc_count", *rounded("s", "a")], "SELECT g.d, coalesce(e.n, 0) AS doc_count, round(coalesce(e.s, 0), 4) AS s, round(e.a, 4) AS a FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-31', TIMESTAMP '2024-02-01', INTERVAL '1 hour')) AS d) g LEFT JOIN (SELECT date_trunc('hour', ts) AS d, count(*) AS n, sum(value) AS s, avg(value) AS a FROM events WHERE user_id = 8 GROUP BY 1) e USING (d)")
agg("agg_auto_date_histogram", EV, {"aggs": {"d": {"auto_date_histogram": {"field": "ts", "buckets": 10}}}}, "d", ["cast(d as timestamp_ntz) AS d", "doc_count"], "SELECT time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS d, count(*) AS doc_count FROM events GROUP BY 1")
agg("agg_histogram_fill", "orders", {"query": {"range": {"o_totalprice": {"gt": 480000}}}, "aggs": {"h": {"histogram": {"field": "o_totalprice", "interval": 250, "offset": 10}}}}, "h", ["h", "doc_count"], "WITH b AS (SELECT floor((o_totalprice - 10) / 250)::BIGINT AS i, count(*) AS n FROM orders WHERE o_totalprice > 480000 GROUP BY 1) SELECT (g.i * 250 + 10)::DOUBLE AS h, coalesce(n, 0) AS doc_count FROM (SELECT unnest(generate_series((SELECT min(i) FROM b), (SELECT max(i) FROM b))) AS i) g LEFT JOIN b USING (i)")
agg("agg_range_overlap", EV, {"aggs": {"r": {"range": {"field": "value", "ranges": [{"to": 10}, {"from": 5, "to": 60}, {"key": "high", "from": 50}]}, "aggs": {"a": {"avg": {"field": "value"}}}}}}, "r", ["r", "doc_count", *rounded("a")], "SELECT '*-10.0' AS r, count(*) AS doc_count, round(avg(value), 4) AS a FROM events WHERE value < 10 UNION ALL SELECT '5.0-60.0', count(*), round(avg(value), 4) FROM events WHERE value >= 5 AND value < 60 UNION ALL SELECT 'high', count(*), round(avg(value), 4) FROM events WHERE value >= 50")
agg("agg_range_sub_terms", EV, {"aggs": {"r": {"range": {"field": "value", "ranges": [{"key": "low", "to": 20}, {"key": "wide", "from": 10}]}, "aggs": {"t": {"terms": {"field": "event_type", "size": 2}}}}}}, "r > t", ["r", "t", "doc_count"], "WITH x AS (SELECT 'low' AS r, event_type AS t FROM events WHERE value < 20 UNION ALL SELECT 'wide', event_type FROM events WHERE value >= 10) SELECT r, t, doc_count FROM (SELECT r, t, count(*) AS doc_count, row_number() OVER (PARTITION BY r ORDER BY count(*) DESC, t) AS k FROM x GROUP BY 1, 2) WHERE k <= 2")
agg("agg_date_range", EV, {"aggs": {"r": {"date_range": {"field": "ts", "ranges": [{"key": "old", "to": "now-10d/d"}, {"key": "new", "from": "now-10d/d"}]}}}}, "r", ["r", "doc_count"], "SELECT CASE WHEN ts < TIMESTAMP '2024-01-21' THEN 'old' ELSE 'new' END AS r, count(*) AS doc_count FROM events GROUP BY 1")
agg("agg_ip_range", EV, {"runtime_mappings": {"ip": {"type": "ip", "script": "return '10.0.' + (doc['user_id'].value % 256) + '.7'"}}, "aggs": {"r": {"ip_range": {"field": "ip", "ranges": [{"mask": "10.0.0.0/20"}, {"from": "10.0.16.0", "to": "10.0.40.0"}]}}}}, "r", ["r", "doc_count"], "SELECT '10.0.0.0/20' AS r, count(*) AS doc_count FROM events WHERE user_id % 256 < 16 UNION ALL SELECT '10.0.16.0-10.0.40.0', count(*) FROM events WHERE user_id % 256 >= 16 AND user_id % 256 < 40")
agg("agg_filters_other", EV, {"aggs": {"f": {"filters": {"filters": {"cheap": {"range": {"value": {"lt": 5}}}, "errors": {"term": {"event_type": "error"}}}, "other_bucket": True}}}}, "f", ["f", "doc_count"], "SELECT 'cheap' AS f, count(*) AS doc_count FROM events WHERE value < 5 UNION ALL SELECT 'errors', count(*) FROM events WHERE event_type = 'error' UNION ALL SELECT '_other_', count(*) FROM events WHERE NOT (value < 5 OR event_type = 'error')")
agg("agg_filter_fused", EV, {"aggs": {"by": {"terms": {"field": "event_type"}, "aggs": {"big": {"filter": {"range": {"value": {"gt": 40}}}, "aggs": {"m": {"avg": {"field": "value"}}}}}}}}, "by", ["by", "doc_count", "big_doc_count", *rounded("big_m")], "SELECT event_type AS by, count(*) AS doc_count, count(*) FILTER (value > 40) AS big_doc_count, round(avg(value) FILTER (value > 40), 4) AS big_m FROM events GROUP BY 1")
agg("agg_missing", EV, {"runtime_mappings": MAYBE, "aggs": {"none": {"missing": {"field": "kind"}, "aggs": {"a": {"avg": {"field": "value"}}}}}}, "none", ["doc_count", *rounded("a")], "SELECT count(*) AS doc_count, round(avg(value), 4) AS a FROM events WHERE event_type = 'error'")
agg("agg_global", EV, {"query": {"term": {"event_type": "click"}}, "aggs": {"all": {"global": {}, "aggs": {"a": {"avg": {"field": "value"}}}}}}, "all", ["doc_count", *rounded("a")], "SELECT count(*) AS doc_count, round(avg(value), 4) AS a FROM events")
agg("agg_adjacency_matrix", EV, {"aggs": {"m": {"adjacency_matrix": {"filters": {"a": {"range": {"value": {"gt": 40}}}, "b": {"term": {"event_type": "view"}}}}}}}, "m", ["m", "doc_count"], "SELECT 'a' AS m, count(*) AS doc_count FROM events WHERE value > 40 UNION ALL SELECT 'b', count(*) FROM events WHERE event_type = 'view' UNION ALL SELECT 'a&b', count(*) FROM events WHERE value > 40 AND event_type = 'view'")
COMPOSITE = {"sources": [{"type": {"terms": {"field": "event_type"}}}, {"day": {"date_histogram": {"field": "ts", "calendar_interval": "day"}}}], "size": 12}
agg("agg_composite", EV, {"aggs": {"c": {"composite": COMPOSITE}}}, "c", ["type", "cast(day as timestamp_ntz) AS day", "doc_count"], "SELECT event_type AS type, date_trunc('day', ts) AS day, count(*) AS doc_count FROM events GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 12")
agg("agg_composite_page2", EV, {"aggs": {"c": {"composite": {**COMPOSITE, "after": {"type": "click", "day": "2024-01-12T00:00:00Z"}}}}}, "c", ["type", "cast(day as timestamp_ntz) AS day", "doc_count"], "SELECT event_type AS type, date_trunc('day', ts) AS day, count(*) AS doc_count FROM events GROUP BY 1, 2 HAVING event_type > 'click' OR event_type = 'click' AND date_trunc('day', ts) > TIMESTAMP '2024-01-12' ORDER BY 1, 2 LIMIT 12")
agg("agg_composite_missing_desc", EV, {"runtime_mappings": MAYBE, "aggs": {"c": {"composite": {"sources": [{"k": {"terms": {"field": "kind", "missing_bucket": True, "order": "desc"}}}, {"h": {"histogram": {"field": "value", "interval": 50}}}], "size": 8}}}}, "c", ["k", "h", "doc_count"], "SELECT nullif(event_type, 'error') AS k, floor(value / 50) * 50 AS h, count(*) AS doc_count FROM events GROUP BY 1, 2 ORDER BY 1 DESC NULLS LAST, 2 LIMIT 8")
agg("agg_top_hits", EV, {"aggs": {"by": {"terms": {"field": "event_type"}, "aggs": {"last": {"top_hits": {"size": 2, "sort": [{"ts": "desc"}], "_source": ["event_id", "value"]}}}}}}, "by > last", ["by", "event_id", "value"], "SELECT event_type AS by, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS r FROM events) WHERE r <= 2")
agg("agg_nested_rate", EV, {"aggs": {"d": {"date_histogram": {"field": "ts", "calendar_interval": "month"}, "aggs": {"by": {"terms": {"field": "event_type", "size": 3, "order": {"_key": "desc"}}}}}}}, "d > by", ["cast(d as timestamp_ntz) AS d", "`by` AS kind", "doc_count"], "SELECT d, kind, doc_count FROM (SELECT date_trunc('month', ts) AS d, event_type AS kind, count(*) AS doc_count, row_number() OVER (PARTITION BY date_trunc('month', ts) ORDER BY event_type DESC) AS r FROM events GROUP BY 1, 2) WHERE r <= 3")

# ---------------------------------------------------------------- pipelines

DAYS = {"date_histogram": {"field": "ts", "calendar_interval": "day"}}
DAY_SQL = "SELECT date_trunc('day', ts) AS d, count(*) AS n, sum(value) AS s FROM events GROUP BY 1"


def pipe(name: str, spec: dict, column: str, sql: str) -> None:
    agg(name, EV, {"aggs": {"d": {**DAYS, "aggs": {"s": {"sum": {"field": "value"}}, "x": spec}}}}, "d", ["cast(d as timestamp_ntz) AS d", column], f"SELECT d, {sql} FROM ({DAY_SQL})")


pipe("pipe_cumulative_sum", {"cumulative_sum": {"buckets_path": "s"}}, "round(x, 2) AS x", "round(sum(s) OVER (ORDER BY d), 2) AS x")
pipe("pipe_derivative", {"derivative": {"buckets_path": "_count"}}, "x", "n - lag(n) OVER (ORDER BY d) AS x")
pipe("pipe_serial_diff", {"serial_diff": {"buckets_path": "s", "lag": 7}}, "round(x, 4) AS x", "round(s - lag(s, 7) OVER (ORDER BY d), 4) AS x")
pipe("pipe_moving_fn", {"moving_fn": {"buckets_path": "s", "window": 4, "script": "MovingFunctions.unweightedAvg(values)"}}, "round(x, 4) AS x", "round(avg(s) OVER (ORDER BY d ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 4) AS x")
pipe("pipe_moving_fn_shift", {"moving_fn": {"buckets_path": "_count", "window": 3, "shift": 1, "script": "MovingFunctions.sum(values)"}}, "x", "(sum(n) OVER (ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))::BIGINT AS x")
pipe("pipe_moving_avg", {"moving_avg": {"buckets_path": "s", "window": 3}}, "round(x, 4) AS x", "round(avg(s) OVER (ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS x")
pipe("pipe_bucket_script", {"bucket_script": {"buckets_path": {"t": "s", "n": "_count"}, "script": "params.t / params.n"}}, "round(x, 4) AS x", "round(s / n, 4) AS x")
pipe("pipe_normalize", {"normalize": {"buckets_path": "s", "method": "percent_of_sum"}}, "round(x, 6) AS x", "round(s / sum(s) OVER (), 6) AS x")
agg("pipe_bucket_selector", EV, {"aggs": {"by": {"terms": {"field": "user_id", "size": 1000}, "aggs": {"a": {"avg": {"field": "value"}}, "keep": {"bucket_selector": {"buckets_path": {"a": "a", "n": "_count"}, "script": "params.a > 20 && params.n > 5"}}}}}}, "by", ["by", "doc_count"], "SELECT user_id AS by, count(*) AS doc_count FROM (SELECT * FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1000)) GROUP BY 1 HAVING avg(value) > 20 AND count(*) > 5")
agg("pipe_bucket_sort", EV, {"aggs": {"d": {**DAYS, "aggs": {"s": {"sum": {"field": "value"}}, "top": {"bucket_sort": {"sort": [{"s": {"order": "desc"}}], "from": 1, "size": 5}}}}}}, "d", ["cast(d as timestamp_ntz) AS d", "doc_count", *rounded("s")], f"SELECT d, n AS doc_count, round(s, 4) AS s FROM ({DAY_SQL}) ORDER BY s DESC, d LIMIT 5 OFFSET 1")
for _kind, _columns, _sql in (
    ("avg_bucket", ["round(x, 4) AS x"], "round(avg(s), 4) AS x"),
    ("sum_bucket", ["round(x, 2) AS x"], "round(sum(s), 2) AS x"),
    ("max_bucket", ["round(x, 4) AS x", "x_key"], "round(max(s), 4) AS x, strftime(arg_max(d, s), '%Y-%m-%d %H:%M:%S') AS x_key"),
    ("min_bucket", ["round(x, 4) AS x", "x_key"], "round(min(s), 4) AS x, strftime(arg_min(d, s), '%Y-%m-%d %H:%M:%S') AS x_key"),
    ("stats_bucket", ["x_count", *rounded("x_min", "x_max", "x_avg")], "count(s) AS x_count, round(min(s), 4) AS x_min, round(max(s), 4) AS x_max, round(avg(s), 4) AS x_avg"),
    ("extended_stats_bucket", rounded("x_avg", "x_std_deviation"), "round(avg(s), 4) AS x_avg, round(stddev_pop(s), 4) AS x_std_deviation"),
    ("percentiles_bucket", ["round(x[3], 4) AS median"], "round(quantile_cont(s, 0.5), 4) AS median"),
):
    agg(f"pipe_{_kind}", EV, {"aggs": {"d": {**DAYS, "aggs": {"s": {"sum": {"field": "value"}}}}, "x": {_kind: {"buckets_path": "d>s"}}}}, "x", _columns, f"SELECT {_sql} FROM ({DAY_SQL})")

# ---------------------------------------------------------------- significant terms, missing keys, lists, samples

agg("agg_composite_missing_sub", EV, {"runtime_mappings": MAYBE, "aggs": {"c": {"composite": {"sources": [{"k": {"terms": {"field": "kind", "missing_bucket": True}}}], "size": 10}, "aggs": {"u": {"terms": {"field": "user_id", "size": 2}}}}}}, "c > u", ["k", "u", "doc_count"], "SELECT k, u, n AS doc_count FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, u) AS r FROM (SELECT nullif(event_type, 'error') AS k, user_id AS u, count(*) AS n FROM events GROUP BY 1, 2)) WHERE r <= 2")
JLH = "SELECT f.k AS s, f.n AS doc_count, b.n AS bg_count, round((f.n / ft - b.n / bt) * ((f.n / ft) / (b.n / bt)), 9) AS score FROM (SELECT user_id AS k, count(*) AS n, sum(count(*)) OVER () AS ft FROM events WHERE event_type = 'error' GROUP BY 1) f JOIN (SELECT user_id AS k, count(*) AS n, sum(count(*)) OVER () AS bt FROM {} GROUP BY 1) b USING (k) WHERE f.n >= 3 AND f.n / ft > b.n / bt ORDER BY score DESC, s LIMIT 5"
for _name, _more, _behind in (("agg_significant_terms", {}, "events"), ("agg_significant_background", {"background_filter": {"range": {"value": {"gt": 5}}}}, "(SELECT * FROM events WHERE value > 5)")):
    agg(_name, EV, {"query": {"term": {"event_type": "error"}}, "aggs": {"s": {"significant_terms": {"field": "user_id", "size": 5, **_more}}}}, "s", ["s", "doc_count", "bg_count", "round(score, 9) AS score"], JLH.format(_behind))
agg("agg_sampler_all", EV, {"aggs": {"x": {"sampler": {}, "aggs": {"by": {"terms": {"field": "event_type"}}}}}}, "x > by", ["by", "doc_count"], "SELECT event_type AS by, count(*) AS doc_count FROM events GROUP BY 1")
agg("agg_sampler_size", EV, {"aggs": {"x": {"sampler": {"shard_size": 50}, "aggs": {"n": {"value_count": {"field": "value"}}}}}}, "x", ["doc_count", "n"], "SELECT 50 AS doc_count, 50 AS n")
agg("agg_diversified_sampler", EV, {"aggs": {"x": {"diversified_sampler": {"field": "user_id", "max_docs_per_value": 1}, "aggs": {"u": {"cardinality": {"field": "user_id"}}}}}}, "x", ["doc_count", "u"], "SELECT count(DISTINCT user_id) AS doc_count, count(DISTINCT user_id) AS u FROM events")


def on_rows(name: str, made: str, table: str, body: dict, path: str, columns: list[str], sql: str) -> None:
    """As ``agg``, over a table with columns that the test tables lack."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .plans.search import search

        _, config = driver_catalog(spark, sf_dir).resolve(table)
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr("*", *made.split("; "))
        return search(df, {"size": 0, **body}, replace(config, now=NOW)).agg(path).selectExpr(*columns)

    QUERIES[name], SQL[name] = run, sql


SPOT = "named_struct('lat', 48 + value / 100, 'lon', 2 + user_id / 100) as spot"
on_rows("agg_date_histogram_list", "array(ts, ts, ts + interval 1 day) as days", EV, {"aggs": {"d": {"date_histogram": {"field": "days", "calendar_interval": "day", "min_doc_count": 1}}}}, "d", ["cast(d as timestamp_ntz) AS d", "doc_count"], "SELECT date_trunc('day', t) AS d, count(*) AS doc_count FROM (SELECT ts AS t FROM events UNION ALL SELECT ts + INTERVAL 1 DAY FROM events) GROUP BY 1")
on_rows("agg_nested_lists", "array(named_struct('k', event_type, 'v', value), named_struct('k', 'x', 'v', 1D)) as items", EV, {"aggs": {"n": {"nested": {"path": "items"}, "aggs": {"by": {"terms": {"field": "items.k"}}}}}}, "n > by", ["by", "doc_count"], "SELECT k AS by, count(*) AS doc_count FROM (SELECT event_type AS k FROM events UNION ALL SELECT 'x' FROM events) GROUP BY 1")
on_rows("agg_reverse_nested", "array(named_struct('k', event_type), named_struct('k', 'x'), named_struct('k', 'x')) as items", EV, {"aggs": {"n": {"nested": {"path": "items"}, "aggs": {"by": {"terms": {"field": "items.k"}, "aggs": {"r": {"reverse_nested": {}, "aggs": {"s": {"sum": {"field": "user_id"}}}}}}}}}}, "n > by > r", ["by", "doc_count", "s"], "SELECT k AS by, count(*) AS doc_count, sum(user_id)::BIGINT AS s FROM (SELECT event_type AS k, user_id FROM events UNION ALL SELECT 'x', user_id FROM events) GROUP BY 1")
on_rows("agg_geotile_grid", SPOT, EV, {"aggs": {"g": {"geotile_grid": {"field": "spot", "precision": 6}}}}, "g", ["g", "doc_count"], "SELECT '6/' || floor((2 + user_id / 100 + 180) / 360 * 64)::INT || '/' || floor((1 - ln(tan(radians(48 + value / 100)) + 1 / cos(radians(48 + value / 100))) / pi()) / 2 * 64)::INT AS g, count(*) AS doc_count FROM events GROUP BY 1")
rows("script_score", EV, {"script_score": {"query": {"term": {"event_type": "view"}}, "script": {"source": "doc['value'].value"}}}, "event_id", "event_type = 'view'")
for _type in ("most_fields", "phrase", "phrase_prefix", "bool_prefix"):
    rows(f"multi_match_{_type}", DOC, {"multi_match": {"query": "mit license", "fields": ["text"], "type": _type}}, "doc_id", f"{word('mit')} OR {word('license')}" if _type == "most_fields" else word("mit[^\\p{L}\\p{N}_]+license") if _type == "phrase" else "regexp_matches(text, '(^|[^\\p{L}\\p{N}_])mit[^\\p{L}\\p{N}_]+license', 'i')" if _type == "phrase_prefix" else f"{word('mit')} OR regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_])license', 'i')")
for _name, _script, _sql in (
    ("math", "Math.floor(doc['value'].value) + Math.abs(doc['user_id'].value - 50) + Math.max(1, 2)", "floor(value) + abs(user_id - 50) + 2"),
    ("strings", "doc['event_type'].value.toUpperCase().substring(1, 3).length() + doc['event_type'].value.indexOf('i')", "length(substr(upper(event_type), 2, 2)) + instr(event_type, 'i') - 1"),
    ("parse", "Integer.parseInt(String.valueOf(doc['user_id'].value)) * 2", "user_id * 2"),
    ("dates", "doc['ts'].value.plusDays(1).getDayOfMonth() + doc['ts'].value.getMonthValue()", "day(ts + INTERVAL 1 DAY) + month(ts)"),
    ("trunc", "ChronoUnit.HOURS.between(doc['ts'].value.truncatedTo(ChronoUnit.DAYS), doc['ts'].value)", "hour(ts)"),
):
    hits(f"script_{_name}", EV, {"script_fields": {"x": {"script": _script}}, "sort": ["event_id"], "size": 200, "_source": ["event_id"]}, ["event_id", "cast(x as double) AS x"], f"SELECT event_id, ({_sql})::DOUBLE AS x FROM events ORDER BY event_id LIMIT 200")

# ---------------------------------------------------------------- hits

hits("hits_sort_page", EV, {"query": {"term": {"event_type": "view"}}, "sort": [{"value": "desc"}, {"event_id": "asc"}], "from": 5, "size": 10, "_source": ["event_id", "val*"]}, ["event_id", "value"], "SELECT event_id, value FROM events WHERE event_type = 'view' ORDER BY value DESC, event_id LIMIT 10 OFFSET 5")
hits("hits_default_sort", EV, {"size": 5, "_source": {"excludes": ["props", "ts"]}}, ["event_id", "user_id", "event_type", "value"], "SELECT event_id, user_id, event_type, value FROM events ORDER BY ts DESC LIMIT 5")
hits("hits_search_after", EV, {"sort": [{"value": "desc"}, {"event_id": "asc"}], "search_after": [100.0, 50], "size": 10, "_source": ["event_id", "value"]}, ["event_id", "value"], "SELECT event_id, value FROM events WHERE value < 100 OR value = 100 AND event_id > 50 ORDER BY value DESC, event_id LIMIT 10")
hits("hits_sort_missing", EV, {"runtime_mappings": MAYBE, "sort": [{"kind": {"order": "desc", "missing": "_first"}}, {"event_id": "asc"}], "size": 10, "_source": ["event_id", "kind"]}, ["event_id", "kind"], "SELECT event_id, nullif(event_type, 'error') AS kind FROM events ORDER BY kind DESC NULLS FIRST, event_id LIMIT 10")
hits("hits_collapse", EV, {"collapse": {"field": "event_type"}, "sort": [{"value": "desc"}, {"event_id": "asc"}], "_source": ["event_id", "event_type", "value"]}, ["event_id", "event_type", "value"], "SELECT event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1 LIMIT 10")
hits("hits_script_fields", EV, {"script_fields": {"twice": {"script": "doc['value'].value * 2"}}, "sort": ["event_id"], "size": 8, "_source": ["event_id"]}, ["event_id", "round(twice, 6) AS twice"], "SELECT event_id, round(value * 2, 6) AS twice FROM events ORDER BY event_id LIMIT 8")
hits("hits_script_sort", EV, {"sort": [{"_script": {"type": "number", "script": "doc['user_id'].value % 7", "order": "desc"}}, {"event_id": "asc"}], "size": 8, "_source": ["event_id"]}, ["event_id"], "SELECT event_id FROM events ORDER BY user_id % 7 DESC, event_id LIMIT 8")
hits("hits_total", EV, {"query": {"term": {"event_type": "view"}}, "post_filter": {"range": {"value": {"gt": 30}}}, "size": 0, "track_total_hits": True, "aggs": {"n": {"value_count": {"field": "value"}}}}, ["total"], "SELECT count(*) AS total FROM events WHERE event_type = 'view' AND value > 30", total=True)
hits("hits_post_filter", EV, {"post_filter": {"range": {"value": {"gt": 90}}}, "sort": ["event_id"], "size": 6, "_source": ["event_id"]}, ["event_id"], "SELECT event_id FROM events WHERE value > 90 ORDER BY event_id LIMIT 6")
hits("hits_knn", "embeddings", {"knn": {"field": "embedding", "query_vector": [1.0] + [0.0] * 63, "k": 5, "similarity": "dot_product"}, "size": 5, "_source": ["vec_id"]}, ["vec_id"], "SELECT vec_id FROM embeddings ORDER BY embedding[1] DESC LIMIT 5")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
