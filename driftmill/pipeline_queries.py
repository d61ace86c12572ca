"""Registered queries of pipelines, processors, analyzers, alerts, dashboards and streams, with SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import driver_catalog
from .functions import analysis
from .operators import alerts, dashboards, equivalence, ingest, logstash
from .streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = datetime(2024, 1, 31)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filters(name: str, source: str, body: str, columns: list[str], sql: str, given: list[str] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        df = df.selectExpr(*given) if given else df
        return logstash.run(df, f"filter {{ {body} }}").selectExpr(*columns)

    QUERIES[f"ls_{name}"], SQL[f"ls_{name}"] = run, sql


def process(name: str, source: str, processors: list[dict], columns: list[str], sql: str, given: list[str] | None = None, named: dict | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        df = df.selectExpr(*given) if given else df
        return ingest.run(df, {"processors": processors}, named).selectExpr(*columns)

    QUERIES[f"ingest_{name}"], SQL[f"ingest_{name}"] = run, sql


# ---------------------------------------------------------------- filters

filters("grok", "pages", r'grok { match => { "url" => "^(?<proto>https?)://(?<host>[^/]+)(?<path>/[^?#]*)" } } mutate { remove_field => ["html"] }', ["page_id", "proto", "host", "path", "tags"], "SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS proto, regexp_extract(url, '://([^/]+)', 1) AS host, regexp_extract(url, '://[^/]+(/[^?#]*)', 1) AS path, NULL::VARCHAR[] AS tags FROM pages")
filters("grok_failure", "events", r'grok { match => { "event_type" => "^(?<kind>[a-z]+)k$" } }', ["event_id", "array_join(tags, ',') AS tags"], "SELECT event_id, CASE WHEN event_type NOT LIKE '%k' THEN '_grokparsefailure' END AS tags FROM events")
filters("mutate", "events", 'mutate { convert => { "value" => "integer" "user_id" => "string" } uppercase => ["event_type"] gsub => ["props", "[{}]", ""] replace => { "label" => "%{event_type}/%{user_id}" } }', ["event_id", "value", "event_type", "props", "label"], "SELECT event_id, trunc(value)::BIGINT AS value, upper(event_type) AS event_type, regexp_replace(props, '[{}]', '', 'g') AS props, event_type || '/' || user_id AS label FROM events")
filters("mutate_split_join", "pages", r'mutate { split => { "url" => "/" } } mutate { join => { "url" => "|" } copy => { "url" => "again" } lowercase => ["again"] }', ["page_id", "again"], "SELECT page_id, lower(array_to_string(string_split(CASE WHEN url LIKE '%/' THEN left(url, length(url) - 1) ELSE url END, '/'), '|')) AS again FROM pages", ["page_id", "url"])
filters("json", "events", 'json { source => "props" schema => "k bigint" target => "p" }', ["event_id", "`p.k` AS k"], "SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k FROM events")
filters("json_failure", "events", 'json { source => "event_type" target => "p" }', ["event_id", "array_join(tags, ',') AS tags"], "SELECT event_id, '_jsonparsefailure' AS tags FROM events")
filters("kv", "pages", 'kv { source => "url" field_split => "?&" value_split => "=" include_keys => ["page", "ref"] target => "q" }', ["page_id", "`q.page` AS page", "`q.ref` AS ref"], "SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]ref=([^&]*)', 1), '') AS ref FROM pages", ["page_id", "url"])
filters("dissect", "pages", 'dissect { mapping => { "url" => "%{proto}://%{host}/%{lang}/%{rest}" } }', ["page_id", "proto", "host", "lang", "rest"], "SELECT page_id, regexp_extract(url, '^(.*?)://', 1) AS proto, regexp_extract(url, '://(.*?)/', 1) AS host, regexp_extract(url, '://.*?/(.*?)/', 1) AS lang, regexp_extract(url, '://.*?/.*?/(.*)$', 1) AS rest FROM pages", ["page_id", "url"])
filters("date", "orders", 'date { match => ["d", "dd/MM/yyyy HH:mm:ss", "ISO8601"] timezone => "Europe/Paris" target => "at" }', ["o_orderkey", "cast(at as timestamp_ntz) AS at"], "SELECT o_orderkey, (timezone('Europe/Paris', o_orderdate) AT TIME ZONE 'UTC')::TIMESTAMP AS at FROM orders", ["o_orderkey", "date_format(o_orderdate, 'dd/MM/yyyy HH:mm:ss') AS d"])
filters("conditions", "events", 'if [event_type] == "click" and [value] > 20 { mutate { add_field => { "c" => "hot" } } } else if [event_type] in ["view", "signup"] or [user_id] < 10 { mutate { add_field => { "c" => "mid" } } } else { mutate { add_field => { "c" => "rest" } } }', ["event_id", "c"], "SELECT event_id, CASE WHEN event_type = 'click' AND value > 20 THEN 'hot' WHEN event_type IN ('view', 'signup') OR user_id < 10 THEN 'mid' ELSE 'rest' END AS c FROM events")
filters("condition_regex", "pages", 'if [url] =~ "example\\.(net|org)" and !([url] =~ "^https") { mutate { add_tag => ["plain"] } }', ["page_id", "array_join(tags, ',') AS tags"], "SELECT page_id, CASE WHEN regexp_matches(url, 'example\\.(net|org)') AND NOT regexp_matches(url, '^https') THEN 'plain' END AS tags FROM pages", ["page_id", "url"])
filters("drop", "events", 'if [value] < 10 { drop { } }', ["event_id"], "SELECT event_id FROM events WHERE value >= 10")
filters("translate", "events", 'translate { source => "event_type" target => "t" dictionary => { "click" => "c" "view" => "v" } fallback => "other %{user_id}" }', ["event_id", "t"], "SELECT event_id, CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'v' ELSE 'other ' || user_id END AS t FROM events")
filters("fingerprint", "events", 'fingerprint { source => ["user_id", "event_type"] concatenate_sources => true method => "SHA256" target => "fp" }', ["event_id", "fp"], "SELECT event_id, sha256('|event_type|' || event_type || '|user_id|' || user_id || '|') AS fp FROM events")
filters("urldecode", "pages", 'urldecode { field => "u" }', ["page_id", "u"], "SELECT page_id, url || ' é' AS u FROM pages", ["page_id", "concat(url, '%20%C3%A9') AS u"])
filters("split", "pages", 'split { field => "u" terminator => "/" }', ["page_id", "u"], "SELECT page_id, u FROM (SELECT page_id, unnest(string_split(url, '/')) AS u FROM pages) WHERE u <> ''", ["page_id", "url AS u"])
filters("truncate", "documents", 'truncate { fields => ["text"] length_bytes => 20 }', ["doc_id", "octet_length(text) <= 20 AND startswith(whole, text) AND (octet_length(text) > 16 OR text = whole) AS ok"], "SELECT doc_id, true AS ok FROM documents", ["doc_id", "text", "text AS whole"])
filters("csv", "events", 'csv { source => "line" columns => ["a", "b", "c"] convert => { "c" => "float" } }', ["event_id", "a", "b", "c"], "SELECT event_id, event_type AS a, user_id::VARCHAR AS b, value AS c FROM events", ["event_id", "concat_ws(',', event_type, user_id, value) AS line"])
filters("cidr", "events", 'cidr { address => ["%{ip}"] network => ["10.0.0.0/20", "10.0.40.0/24"] add_tag => ["near"] }', ["event_id", "array_join(tags, ',') AS tags"], "SELECT event_id, CASE WHEN user_id % 256 < 16 OR user_id % 256 = 40 THEN 'near' END AS tags FROM events", ["event_id", "concat('10.0.', user_id % 256, '.9') AS ip"])
filters("prune", "events", 'prune { whitelist_names => ["^event", "^val"] }', ["*"], "SELECT event_id, event_type, value FROM events")
filters("de_dot", "events", 'de_dot { }', ["a_b", "event_id"], "SELECT user_id AS a_b, event_id FROM events", ["event_id", "user_id AS `a.b`"])
filters("syslog_pri", "events", 'syslog_pri { }', ["event_id", "syslog_facility_code", "syslog_severity"], "SELECT event_id, ((user_id % 192) // 8)::INT AS syslog_facility_code, ['emergency','alert','critical','error','warning','notice','informational','debug'][(user_id % 192) % 8 + 1] AS syslog_severity FROM events", ["event_id", "cast(user_id % 192 as string) AS syslog_pri"])
filters("clone", "events", 'clone { clones => ["copy"] } if "copy" in [tags] { mutate { add_field => { "n" => "2" } } }', ["event_id", "n"], "SELECT event_id, NULL AS n FROM events UNION ALL SELECT event_id, '2' FROM events", ["event_id"])
filters("bytes", "events", 'bytes { source => "size" target => "b" }', ["event_id", "b"], "SELECT event_id, user_id * 1024 AS b FROM events", ["event_id", "concat(user_id, ' kB') AS size"])
filters("throttle", "events", 'throttle { key => "%{user_id}" after_count => 2 period => 86400 add_tag => ["throttled"] }', ["event_id", "array_join(tags, ',') AS tags"], "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts) > 2 THEN 'throttled' END AS tags FROM events", ["event_id", "user_id", "ts AS `@timestamp`"])
filters("useragent", "events", 'useragent { source => "ua" target => "b" }', ["event_id", "`b.name` AS name", "`b.version` AS version"], "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'Firefox' ELSE 'Chrome' END AS name, user_id || '.0' AS version FROM events", ["event_id", "concat('Mozilla/5.0 (X11; Linux x86_64) ', if(user_id % 2 = 0, 'Firefox', 'Chrome'), '/', user_id, '.0') AS ua"])
filters("xml", "events", 'xml { source => "x" xpath => { "/a/b/text()" => "b" } store_xml => false }', ["event_id", "b[0] AS b"], "SELECT event_id, event_type AS b FROM events", ["event_id", "concat('<a><b>', event_type, '</b></a>') AS x"])
filters("sprintf_date", "events", 'mutate { add_field => { "idx" => "logs-%{+yyyy.MM.dd}-%{none}" } }', ["event_id", "idx"], "SELECT event_id, 'logs-' || strftime(ts, '%Y.%m.%d') || '-%{none}' AS idx FROM events", ["event_id", "ts AS `@timestamp`"])


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = 'output { if [value] > 50 { file { path => "high" } } else if [event_type] == "view" { stdout { } } else { null { } } }'
    parts = logstash.route(table(spark, sf_dir, "events"), config)
    out = None
    for p, df in parts:
        df = df.select("event_id", F.lit(p.name).alias("sink"))
        out = df if out is None else out.union(df)
    return out


QUERIES["ls_route"] = _routes
SQL["ls_route"] = "SELECT event_id, CASE WHEN value > 50 THEN 'file' WHEN event_type = 'view' THEN 'stdout' ELSE 'null' END AS sink FROM events"

filters("mutate_names", "events", 'mutate { rename => { "event_type" => "kind" } update => { "kind" => "%{kind}!" "none" => "x" } capitalize => ["kind"] strip => ["label"] merge => { "list" => "more" } coerce => { "empty" => "given" } remove_field => ["more"] }', ["event_id", "kind", "label", "array_join(list, ',') AS list", "empty"], "SELECT event_id, upper(left(event_type, 1)) || substr(event_type, 2) || '!' AS kind, 'a b' AS label, 'p,q' AS list, 'given' AS empty FROM events", ["event_id", "event_type", "'  a b ' AS label", "array('p') AS list", "array('q') AS more", "cast(null as string) AS empty"])
filters("split_branch", "events", 'if [event_id] == 2 { split { field => "l" target => "one" } }', ["event_id", "array_join(l, '+') AS l", "one"], "SELECT event_id, 'a+b' AS l, NULL AS one FROM events WHERE event_id <> 2 UNION ALL SELECT event_id, 'a+b', unnest(['a', 'b']) FROM events WHERE event_id = 2", ["event_id", "array('a', 'b') AS l"])
filters("grok_ip", "events", 'grok { match => { "line" => "^%{IP:ip} %{EMAILADDRESS:mail} %{LOGLEVEL:level}$" } }', ["event_id", "ip", "mail", "level"], "SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'fe80::1' WHEN 1 THEN '10.0.0.1' END AS ip, CASE WHEN user_id % 3 < 2 THEN 'a.b@c.example' END AS mail, CASE WHEN user_id % 3 < 2 THEN 'WARN' END AS level FROM events", ["event_id", "concat(case user_id % 3 when 0 then 'fe80::1' when 1 then '10.0.0.1' else '12:34:56' end, ' a.b@c.example WARN') AS line"])

# ---------------------------------------------------------------- processors

process("lower_decode", "events", [{"lowercase": {"field": "a"}}, {"urldecode": {"field": "b"}}], ["event_id", "a", "b"], "SELECT event_id, event_type AS a, 'x y&' || user_id AS b FROM events", ["event_id", "upper(event_type) AS a", "concat('x%20y%26', user_id) AS b"])
process("dot_expander", "events", [{"dot_expander": {"field": "a.b"}}, {"set": {"field": "c", "copy_from": "a.b"}}], ["event_id", "c"], "SELECT event_id, event_type AS c FROM events", ["event_id", "event_type AS `a.b`"])
process("set_rename_remove", "events", [{"set": {"field": "label", "value": "{{event_type}}-{{user_id}}"}}, {"set": {"field": "event_type", "value": "x", "override": False}}, {"rename": {"field": "value", "target_field": "v"}}, {"remove": {"field": ["props", "none"], "ignore_missing": True}}], ["event_id", "label", "event_type", "v"], "SELECT event_id, event_type || '-' || user_id AS label, event_type, value AS v FROM events")
process("append", "events", [{"append": {"field": "tags", "value": ["a", "{{event_type}}", "a"], "allow_duplicates": True}}, {"append": {"field": "tags", "value": ["a", "z"], "allow_duplicates": False}}], ["event_id", "array_join(tags, ',') AS tags"], "SELECT event_id, 'a,' || event_type || ',a,z' AS tags FROM events")
process("text", "documents", [{"set": {"field": "t", "copy_from": "source"}}, {"uppercase": {"field": "t"}}, {"gsub": {"field": "t", "pattern": "[0-9]", "replacement": "#"}}, {"trim": {"field": "lang"}}], ["doc_id", "t", "lang"], "SELECT doc_id, regexp_replace(upper(source), '[0-9]', '#', 'g') AS t, lang FROM documents", ["doc_id", "source", "concat('  ', lang, ' ') AS lang"])
process("html_strip", "pages", [{"html_strip": {"field": "html"}}], ["page_id", "length(html) AS n"], "SELECT page_id, length(regexp_replace(html, '<[^>]*>', '', 'g'))::INT AS n FROM pages")
process("convert", "events", [{"convert": {"field": "n", "type": "integer", "on_failure": [{"set": {"field": "bad", "value": "not a number"}}]}}], ["event_id", "n", "bad"], "SELECT event_id, CASE WHEN user_id % 3 > 0 THEN user_id::INT END AS n, CASE WHEN user_id % 3 = 0 THEN 'not a number' END AS bad FROM events", ["event_id", "if(user_id % 3 = 0, 'x', cast(user_id as string)) AS n"])
process("bytes", "events", [{"bytes": {"field": "size"}}], ["event_id", "cast(size as bigint) AS size"], "SELECT event_id, user_id * 1048576 AS size FROM events", ["event_id", "concat(user_id, 'mb') AS size"])
process("split_sort_join", "pages", [{"split": {"field": "url", "separator": "/"}}, {"sort": {"field": "url", "order": "desc"}}, {"join": {"field": "url", "separator": " "}}], ["page_id", "url"], "SELECT page_id, array_to_string(list_reverse_sort(string_split(rtrim(url, '/'), '/')), ' ') AS url FROM pages", ["page_id", "url"])
process("date", "events", [{"date": {"field": "d", "formats": ["yyyy/MM/dd HH:mm", "UNIX"], "target_field": "at", "output_format": "yyyy-MM-dd"}}], ["event_id", "at"], "SELECT event_id, strftime(ts, '%Y-%m-%d') AS at FROM events", ["event_id", "if(event_id % 2 = 0, date_format(ts, 'yyyy/MM/dd HH:mm'), cast(unix_seconds(cast(ts as timestamp)) as string)) AS d"])
process("grok", "pages", [{"grok": {"field": "url", "patterns": ["%{URIPROTO:proto}://(?<host>[^/]+)/%{WORD:lang}/%{INT:n:int}"]}}], ["page_id", "proto", "lang", "n"], "SELECT page_id, regexp_extract(url, '^(\\w+)://', 1) AS proto, regexp_extract(url, '://[^/]+/(\\w+)/', 1) AS lang, regexp_extract(url, '/(\\d+)', 1)::BIGINT AS n FROM pages", ["page_id", "url"])
process("dissect", "events", [{"dissect": {"field": "line", "pattern": "[%{kind}] %{?skip} <%{user}>"}}], ["event_id", "kind", "user"], "SELECT event_id, event_type AS kind, user_id::VARCHAR AS \"user\" FROM events", ["event_id", "concat('[', event_type, '] by <', user_id, '>') AS line"])
process("kv", "events", [{"kv": {"field": "line", "field_split": " ", "value_split": "=", "prefix": "p_", "include_keys": ["a", "b"], "trim_value": "'"}}], ["event_id", "a", "b"], "SELECT event_id, event_type AS a, user_id::VARCHAR AS b FROM events", ["event_id", "concat(\"a='\", event_type, \"' b=\", user_id) AS line"])
process("json", "events", [{"json": {"field": "props", "target_field": "p", "schema": "k int"}}], ["event_id", "`p.k` AS k"], "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
process("uri_parts", "pages", [{"uri_parts": {"field": "url", "keep_original": False}}], ["page_id", "`url.scheme` AS scheme", "`url.domain` AS domain", "`url.path` AS path", "`url.query` AS query", "`url.fragment` AS fragment"], "SELECT page_id, regexp_extract(url, '^(\\w+)://', 1) AS scheme, regexp_extract(url, '://([^/]+)', 1) AS domain, regexp_extract(url, '://[^/]+([^?#]*)', 1) AS path, nullif(regexp_extract(url, '\\?([^#]*)', 1), '') AS query, nullif(regexp_extract(url, '#(.*)$', 1), '') AS fragment FROM pages", ["page_id", "url"])
process("registered_domain", "pages", [{"registered_domain": {"field": "host", "target_field": "d"}}], ["page_id", "`d.registered_domain` AS r", "`d.subdomain` AS s"], "SELECT page_id, array_to_string(list_slice(string_split(h, '.'), -2, -1), '.') AS r, nullif(array_to_string(list_slice(string_split(h, '.'), 1, -3), '.'), '') AS s FROM (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS h FROM pages)", ["page_id", "regexp_extract(url, '://([^/]+)', 1) AS host"])
process("fingerprint", "events", [{"fingerprint": {"fields": ["user_id", "event_type"], "method": "MD5", "target_field": "fp"}}], ["event_id", "lower(hex(unbase64(fp))) AS fp"], "SELECT event_id, md5('|event_type|' || event_type || '|user_id|' || user_id) AS fp FROM events")
process("script", "events", [{"script": {"source": "def v = ctx.value; if (v > 40) { ctx.size_class = 'large' } else if (v > params.low) { ctx.size_class = 'middle' } else { ctx.size_class = 'small'; ctx.remove('props') } ctx.twice = v * 2", "params": {"low": 10}}}], ["event_id", "size_class", "props", "round(twice, 4) AS twice"], "SELECT event_id, CASE WHEN value > 40 THEN 'large' WHEN value > 10 THEN 'middle' ELSE 'small' END AS size_class, CASE WHEN value > 10 THEN props END AS props, round(value * 2, 4) AS twice FROM events")
process("script_loop", "events", [{"script": {"source": "int k = 0; for (def c : ctx.event_type.toCharArray()) { if (c == 'i') { k++ } } ctx.k = k", "outputs": "k int"}}], ["event_id", "k"], "SELECT event_id, (length(event_type) - length(replace(event_type, 'i', '')))::INT AS k FROM events")
process("failure", "events", [{"fail": {"if": "ctx.value < 5", "message": "low {{user_id}}"}}, {"set": {"field": "ok", "value": True}}], ["event_id", "ok", "_ingest_error AS error"], "SELECT event_id, CASE WHEN value >= 5 THEN true END AS ok, CASE WHEN value < 5 THEN 'low ' || user_id END AS error FROM events")
process("pipeline", "events", [{"pipeline": {"name": "inner", "if": "ctx.event_type == 'view'"}}, {"drop": {"if": "ctx.value > 100"}}, {"terminate": {"if": "ctx.user_id < 50"}}, {"set": {"field": "last", "value": "end"}}], ["event_id", "seen", "last"], "SELECT event_id, CASE WHEN event_type = 'view' THEN 'inner' END AS seen, CASE WHEN user_id >= 50 THEN 'end' END AS last FROM events WHERE value <= 100", named={"inner": {"processors": [{"set": {"field": "seen", "value": "inner"}}]}})
process("foreach", "pages", [{"split": {"field": "url", "separator": "/"}}, {"foreach": {"field": "url", "processor": {"uppercase": {"field": "_ingest._value"}}}}, {"join": {"field": "url", "separator": "/"}}], ["page_id", "url"], "SELECT page_id, upper(rtrim(url, '/')) AS url FROM pages", ["page_id", "url"])
process("reroute", "events", [{"reroute": {"if": "ctx.event_type == 'error'", "dataset": "errors"}}, {"set": {"field": "kept", "value": "y"}}], ["event_id", "_index", "kept"], "SELECT event_id, CASE WHEN event_type = 'error' THEN 'logs-errors-default' END AS _index, CASE WHEN event_type <> 'error' THEN 'y' END AS kept FROM events")
process("csv", "events", [{"csv": {"field": "line", "target_fields": ["a", "b"], "separator": ";"}}], ["event_id", "a", "b"], "SELECT event_id, event_type AS a, user_id::VARCHAR AS b FROM events", ["event_id", "concat_ws(';', event_type, user_id) AS line"])
process("network_direction", "events", [{"network_direction": {"internal_networks": ["private"], "source_ip": "a", "destination_ip": "b", "target_field": "d"}}], ["event_id", "d"], "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'outbound' ELSE 'external' END AS d FROM events", ["event_id", "if(user_id % 2 = 0, '10.1.2.3', '8.8.4.4') AS a", "'8.8.8.8' AS b"])

# ---------------------------------------------------------------- analyzers


def analyzed(name: str, source: str, column: str, key: str, analyzer, sql: str, settings: dict | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).select(key, F.array_join(analysis.analyze(F.col(column), analyzer, settings), "|").alias("tokens"))

    QUERIES[f"analyze_{name}"], SQL[f"analyze_{name}"] = run, f"SELECT {key}, array_to_string({sql}, '|') AS tokens FROM {source}"


analyzed("whitespace", "part", "p_name", "p_partkey", "whitespace", "string_split(p_name, ' ')")
WORDS = "string_split(p_name, ' ')"
for _n, _spec, _sql in (
    ("standard", "standard", f"list_transform({WORDS}, lambda t: lower(t))"),
    ("simple", "simple", f"list_transform({WORDS}, lambda t: lower(t))"),
    ("stop", "stop", f"list_transform({WORDS}, lambda t: lower(t))"),
    ("pattern", "pattern", f"list_transform({WORDS}, lambda t: lower(t))"),
    ("keyword", "keyword", "[p_name]"),
    ("letter", {"tokenizer": "letter"}, WORDS),
    ("lowercase", {"tokenizer": "lowercase"}, f"list_transform({WORDS}, lambda t: lower(t))"),
    ("standard_tokens", {"tokenizer": "standard"}, WORDS),
    ("keyword_tokens", {"tokenizer": "keyword", "filter": ["trim"]}, "[p_name]"),
    ("pattern_tokens", {"tokenizer": {"type": "pattern", "pattern": " "}}, WORDS),
    ("char_group", {"tokenizer": {"type": "char_group", "tokenize_on_chars": ["whitespace"]}}, WORDS),
    ("length", {"tokenizer": "whitespace", "filter": [{"type": "length", "min": 5, "max": 6}]}, f"list_filter({WORDS}, lambda t: length(t) BETWEEN 5 AND 6)"),
    ("pattern_replace", {"tokenizer": "whitespace", "filter": [{"type": "pattern_replace", "pattern": "[aeiou]", "replacement": "_"}]}, f"list_transform({WORDS}, lambda t: regexp_replace(t, '[aeiou]', '_', 'g'))"),
    ("filter_edge_ngram", {"tokenizer": "whitespace", "filter": [{"type": "edge_ngram", "min_gram": 2, "max_gram": 2}]}, f"list_transform(list_filter({WORDS}, lambda t: length(t) >= 2), lambda t: left(t, 2))"),
    ("filter_ngram", {"tokenizer": "keyword", "filter": [{"type": "ngram", "min_gram": 3, "max_gram": 3}]}, "list_transform(range(1, length(p_name) - 1), lambda k: substr(p_name, k, 3))"),
    ("asciifolding", {"tokenizer": "whitespace", "filter": ["asciifolding", "lowercase"]}, f"list_transform({WORDS}, lambda t: lower(t))"),
):
    analyzed(_n, "part", "p_name", "p_partkey", _spec, _sql)
analyzed("custom", "part", "p_name", "p_partkey", {"tokenizer": "whitespace", "filter": ["uppercase", "reverse", {"type": "truncate", "length": 3}]}, "list_transform(string_split(p_name, ' '), lambda t: left(reverse(upper(t)), 3))")
analyzed("edge_ngram", "part", "p_name", "p_partkey", {"tokenizer": {"type": "edge_ngram", "min_gram": 2, "max_gram": 4}}, "list_transform(range(2, least(length(p_name), 4) + 1), lambda k: left(p_name, k))")
analyzed("path", "pages", "url", "page_id", {"tokenizer": "path_hierarchy", "char_filter": [{"type": "pattern_replace", "pattern": "^https?://|[?#].*$", "replacement": ""}]}, "list_transform(range(1, len(string_split(regexp_replace(url, '^https?://|[?#].*$', '', 'g'), '/')) + 1), lambda k: array_to_string(list_slice(string_split(regexp_replace(url, '^https?://|[?#].*$', '', 'g'), '/'), 1, k), '/'))")
analyzed("stop_synonym", "part", "p_name", "p_partkey", {"tokenizer": "whitespace", "filter": [{"type": "stop", "stopwords": ["red"]}, {"type": "synonym", "synonyms": ["ring => band, hoop"]}, "unique"]}, "flatten(list_transform(list_filter(string_split(p_name, ' '), lambda t: t <> 'red'), lambda t: CASE WHEN t = 'ring' THEN ['band', 'hoop'] ELSE [t] END))")

# ---------------------------------------------------------------- alerts, dashboards, comparison

WATCH = {"trigger": {"schedule": {"interval": "10m"}}, "metadata": {"least": 100}, "input": {"search": {"request": {"indices": ["events"], "body": {"size": 0, "query": {"bool": {"filter": [{"term": {"event_type": "error"}}, {"range": {"ts": {"gte": "{{ctx.trigger.scheduled_time}}||-7d", "lt": "{{ctx.trigger.scheduled_time}}"}}}]}}, "aggs": {"by": {"terms": {"field": "user_id", "size": 5}}, "m": {"max": {"field": "value"}}}}}}}}
WEEK = "FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31'"


def watch(name: str, condition: dict, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return alerts.decision(alerts.Watch(name, {**WATCH, "condition": condition}), driver_catalog(spark, sf_dir), NOW).select("fired")

    QUERIES[f"watch_{name}"], SQL[f"watch_{name}"] = run, sql


watch("compare", {"compare": {"ctx.payload.hits.total": {"gte": "{{ctx.metadata.least}}"}}}, f"SELECT least(count(*), 10000) >= 100 AS fired {WEEK}")
watch("compare_metric", {"compare": {"ctx.payload.aggregations.m.value": {"gt": 1000}}}, f"SELECT coalesce(max(value) > 1000, false) AS fired {WEEK}")
watch("array_compare", {"array_compare": {"ctx.payload.aggregations.by.buckets": {"path": "doc_count", "gte": {"value": 2, "quantifier": "all"}}}}, f"SELECT coalesce(bool_and(n >= 2), true) AS fired FROM (SELECT count(*) AS n {WEEK} GROUP BY user_id ORDER BY 1 DESC, user_id LIMIT 5)")
watch("script", {"script": "return ctx.payload.hits.total > 10 && ctx.payload.aggregations.m.value > 5"}, f"SELECT count(*) > 10 AND max(value) > 5 AS fired {WEEK}")


def _rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = {"rule_type_id": ".index-threshold", "params": {"index": ["events"], "timeField": "ts", "aggType": "avg", "aggField": "value", "groupBy": "top", "termField": "event_type", "termSize": 3, "timeWindowSize": 10, "timeWindowUnit": "d", "thresholdComparator": ">", "threshold": [50]}}
    return alerts.rule_decision(rule, driver_catalog(spark, sf_dir), NOW).select("group", "fired")


QUERIES["rule_index_threshold"] = _rule
SQL["rule_index_threshold"] = "SELECT event_type AS group, avg(value) > 50 AS fired FROM events WHERE ts >= TIMESTAMP '2024-01-21' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3"
VIS = {"attributes": {"visState": json.dumps({"aggs": [{"id": "1", "type": "avg", "schema": "metric", "params": {"field": "value"}}, {"id": "2", "type": "terms", "schema": "segment", "params": {"field": "event_type", "size": 3, "order": "desc", "orderBy": "1"}}]}), "kibanaSavedObjectMeta": {"searchSourceJSON": json.dumps({"query": {"query": "value > 5", "language": "kuery"}, "filter": [{"meta": {"negate": True}, "query": {"term": {"event_type": "view"}}}]})}}}
GRAFANA = {"query": "event_type:click", "timeField": "ts", "metrics": [{"id": "1", "type": "sum", "field": "value"}], "bucketAggs": [{"id": "2", "type": "date_histogram", "settings": {"interval": "1d"}}]}


def dashboard(name: str, request: dict, path: str, columns: list[str], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return driver_catalog(spark, sf_dir).search(request, "events", now=NOW).agg(path).selectExpr(*columns)

    QUERIES[f"dashboard_{name}"], SQL[f"dashboard_{name}"] = run, sql


dashboard("visualization", dashboards.visualization(VIS), "2", ["_d2 AS kind", "round(_d1, 4) AS m"], "SELECT event_type AS kind, round(avg(value), 4) AS m FROM events WHERE value > 5 AND event_type <> 'view' GROUP BY 1 ORDER BY avg(value) DESC, 1 LIMIT 3")
dashboard("grafana", dashboards.grafana_target(GRAFANA), "b2", ["cast(b2 as timestamp_ntz) AS d", "round(_d1, 4) AS s"], "SELECT g.d, round(coalesce(s, 0), 4) AS s FROM (SELECT unnest(generate_series((SELECT date_trunc('day', min(ts)) FROM events WHERE event_type = 'click'), (SELECT date_trunc('day', max(ts)) FROM events WHERE event_type = 'click'), INTERVAL '1 day')) AS d) g LEFT JOIN (SELECT date_trunc('day', ts) AS d, sum(value) AS s FROM events WHERE event_type = 'click' GROUP BY 1) USING (d)")
dashboard("variable", dashboards.grafana_variable('{"find": "terms", "field": "event_type"}'), "values", ["`values` AS v"], "SELECT DISTINCT event_type AS v FROM events")


def _differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    b = a.where("o_orderkey % 10 <> 3").withColumn("o_totalprice", F.expr("if(o_orderkey % 10 = 7, o_totalprice + 1, o_totalprice * (1 + 1e-12))"))
    return equivalence.differences(a, b, ["o_orderkey"]).select("o_orderkey", "column")


QUERIES["equivalence"] = _differences
SQL["equivalence"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN '_row' ELSE 'o_totalprice' END AS column FROM orders WHERE o_orderkey % 10 IN (3, 7)"

# ---------------------------------------------------------------- streams


def streamed(name: str, made: Callable[[DataFrame], DataFrame], columns: list[str], sql: str, mode: str = "complete") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        known = table(spark, sf_dir, "events")
        # The test tables are single files, so the stream reads the folder and picks them by name.
        events = spark.readStream.schema(known.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        if mode == "append":
            return streams.collected(made(events).selectExpr(*columns))
        out = f"stream_{uuid.uuid4().hex}"
        q = made(events).writeStream.format("memory").queryName(out).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(out).selectExpr(*columns)

    QUERIES[f"stream_{name}"], SQL[f"stream_{name}"] = run, sql


streamed("histogram", lambda e: streams.histogram(e, "ts", "1 day", ["event_type"], "2 hours"), ["cast(start as timestamp_ntz) AS start", "event_type", "doc_count"], "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS doc_count FROM events GROUP BY 1, 2")
streamed("filters", lambda e: logstash.run(e, 'filter { if [event_type] == "error" { mutate { add_tag => ["bad"] } } else { drop { } } }'), ["event_id", "array_join(tags, ',') AS tags"], "SELECT event_id, 'bad' AS tags FROM events WHERE event_type = 'error'", "append")
streamed("throttle", lambda e: streams.throttle(e.select("event_id", "user_id", F.col("ts").cast("timestamp")), F.col("user_id"), 3, 10**9, "ts"), ["event_id", "throttled"], "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) > 3 AS throttled FROM events", "append")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
