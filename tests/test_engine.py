"""Rules of the engine that no SQL states: refusals, parsing, schedules, schemas, comparison."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from driftmill import pipeline_queries
from driftmill.config import EngineConfig, Refused
from driftmill.functions import dates, grok, kql, lucene, painless_run, text
from driftmill.operators import alerts, dashboards, equivalence, ingest, logstash
from driftmill.plans.query import matches_needed
from driftmill.plans.schema import from_mapping, read_console
from driftmill.plans.search import fill, matching, pages, read_request, search
from driftmill.sources import connectors
from driftmill.streaming import streams

NOW = datetime(2026, 3, 12, 14, 35, 10, tzinfo=UTC)


@pytest.fixture(scope="module")
def logs(spark):
    rows = [
        (0, "api", "GET /a done", 200, ["x", "y"], datetime(2026, 3, 8, 10), None),
        (1, "cart", "Élan: can't open file", 500, [], datetime(2026, 3, 8, 11), "u1"),
        (2, None, "timeout, retry 3.5 times", 503, None, datetime(2026, 3, 9, 1), ""),
        (3, "api", None, None, ["y"], None, "u2"),
    ]
    return spark.createDataFrame(rows, "id long, service string, message string, status int, tags array<string>, at timestamp_ntz, user string")


CONFIG = EngineConfig(text_fields={"message"}, time_field="at", id_field="id", now=NOW)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize(
    "query, expected",
    [
        ({"bool": {"must_not": [{"term": {"service": "api"}}]}}, [1, 2]),
        ({"term": {"tags": "y"}}, [0, 3]),
        ({"terms": {"tags": ["x", "z"]}}, [0]),
        ({"exists": {"field": "tags"}}, [0, 3]),
        ({"exists": {"field": "unknown"}}, []),
        ({"match": {"message": "can't"}}, [1]),
        ({"match": {"message": "élan"}}, [1]),
        ({"match": {"message": "3.5"}}, [2]),
        ({"match": {"message": "5"}}, []),
        ({"match_phrase": {"message": {"query": "open times"}}}, []),
        ({"fuzzy": {"message": {"value": "flie", "fuzziness": 1}}}, [1]),
        ({"wildcard": {"message": "retr?"}}, [2]),
        ({"range": {"status": {"gte": 500}}}, [1, 2]),
        ({"range": {"at": {"lt": "2026-03-09"}}}, [0, 1]),
        ({"range": {"at": {"lte": "2026-03-08||/d"}}}, [0, 1]),
        ({"bool": {"should": [{"term": {"service": "api"}}, {"term": {"status": 200}}], "minimum_should_match": 2}}, [0]),
        ({"query_string": {"query": "status:>=500 AND NOT message:timeout"}}, [1]),
        ({"simple_query_string": {"query": "file + -timeout", "fields": ["message"]}}, [1]),
        ({"kql": {"query": "service: api and not tags: x"}}, [3]),
        ({"script": {"script": "doc['status'].size() != 0 && doc['status'].value % 2 == 0"}}, [0, 1]),
    ],
)
def test_clauses(logs, query, expected):
    assert ids(matching(logs, query, CONFIG)) == expected


def test_empty_as_missing(logs):
    c = EngineConfig(empty_as_missing=True)
    assert ids(matching(logs, {"exists": {"field": "user"}}, c)) == [1, 3]
    assert ids(matching(logs, {"exists": {"field": "user"}}, EngineConfig())) == [1, 2, 3]


@pytest.mark.parametrize(
    "request_",
    [
        {"query": {"unknown": {}}},
        {"query": {"term": {"a": 1, "b": 2}}},
        {"query": {"match": {"message": {"query": "x", "nope": 1}}}},
        {"query": {"regexp": {"service": "a&b"}}},
        {"query": {"geo_distance": {"distance": "3 parsec", "p": "1,2"}}},
        {"query": {"range": {"at": {"gte": "yesterday"}}}},
        {"nope": 1},
        {"suggest": {}},
        {"aggs": {"a": {"terms": {"field": "service", "nope": 1}}}},
        {"aggs": {"a": {"rate": {"unit": "day"}}}},
        {"aggs": {"a": {"date_histogram": {"field": "at", "calendar_interval": "2d"}}}},
        {"aggs": {"a": {"terms": {"field": "service", "order": {"x": "up"}}}}},
        {"aggs": {"a": {"terms": {"field": "service"}, "aggs": {"g": {"global": {}}}}}},
        {"aggs": {"a": {"top_metrics": {"metrics": {"field": "status"}, "sort": {"service": "asc"}}}}},
        {"aggs": {"a": {"scripted_metric": {}}}},
        {"sort": [{"status": "sideways"}]},
        {"query": {"query_string": {"query": "(a OR"}}},
    ],
)
def test_refused(logs, request_):
    with pytest.raises(Refused):
        search(logs, request_, CONFIG)


def test_deep_requests_are_refused(logs):
    q = {"match_all": {}}
    for _ in range(200):
        q = {"bool": {"must": [q]}}
    with pytest.raises(Refused):
        search(logs, {"query": q}, CONFIG)


def test_array_metrics_and_nested_buckets(logs):
    r = search(logs, {"size": 0, "aggs": {"t": {"terms": {"field": "tags"}, "aggs": {"s": {"terms": {"field": "service"}}}}, "n": {"value_count": {"field": "tags"}}}}, CONFIG)
    assert [tuple(x) for x in r.agg("t").collect()] == [("y", 2), ("x", 1)]
    assert r.agg("_metrics").first()["n"] == 3
    assert {(x["t"], x["s"], x["doc_count"]) for x in r.agg("t > s").collect()} == {("y", "api", 2), ("x", "api", 1)}


def test_nested_aggregation_is_exact(spark):
    df = spark.createDataFrame([(1, [(1, "a"), (2, "b")]), (2, [(3, "a")])], "id long, items array<struct<n:int,k:string>>")
    r = search(df, {"size": 0, "aggs": {"i": {"nested": {"path": "items"}, "aggs": {"k": {"terms": {"field": "items.k"}, "aggs": {"back": {"reverse_nested": {}}}}}}}})
    assert r.agg("i").first()["doc_count"] == 3
    assert {(x["k"], x["doc_count"]) for x in r.agg("i > k").collect()} == {("a", 2), ("b", 1)}
    assert {(x["k"], x["doc_count"]) for x in r.agg("i > k > back").collect()} == {("a", 2), ("b", 1)}


def test_composite_pages_cover_all(logs):
    request = {"size": 0, "aggs": {"c": {"composite": {"size": 1, "sources": [{"s": {"terms": {"field": "service", "missing_bucket": True}}}]}}}}
    assert [[tuple(r) for r in p.collect()] for p in pages(logs, request, "c", CONFIG)] == [[(None, 1)], [("api", 2)], [("cart", 1)]]


def test_dst_days(spark):
    df = spark.createDataFrame([(datetime(2026, 3, 28, 12),), (datetime(2026, 3, 30, 12),)], "at timestamp_ntz")
    r = search(df, {"size": 0, "aggs": {"d": {"date_histogram": {"field": "at", "calendar_interval": "day", "time_zone": "Europe/Paris"}}}})
    got = [(x["d"], x["doc_count"]) for x in r.agg("d").select(F.col("d").cast("string"), "doc_count").collect()]
    assert got == [("2026-03-27 23:00:00", 1), ("2026-03-28 23:00:00", 0), ("2026-03-29 22:00:00", 1)]


def test_geo_grids(spark):
    df = spark.sql("select named_struct('lon', 2.3522D, 'lat', 48.8566D) as p")
    r = search(df, {"size": 0, "aggs": {"h": {"geohash_grid": {"field": "p"}}, "t": {"geotile_grid": {"field": "p", "precision": 8}}}})
    assert r.agg("h").first()["h"] == "u09tv"
    assert r.agg("t").first()["t"] == "8/129/88"


def test_geotiles_past_the_180th_meridian(spark):
    """As the registered query's SQL: columns go on, none gathers the rest; no tile without a place."""
    df = spark.createDataFrame([(x, 48.0) for x in (2.0, 180.0, 182.0, 902.0, -182.0)] + [(None, 48.0), (2.0, None)], "lon double, lat double").select(F.struct("lon", "lat").alias("p"))
    df = df.union(spark.sql("select cast(null as struct<lon: double, lat: double>)"))
    r = search(df, {"size": 0, "aggs": {"t": {"geotile_grid": {"field": "p", "precision": 6}}}})
    assert {x["t"]: x["doc_count"] for x in r.agg("t").collect()} == {f"6/{x}/22": 1 for x in (32, 64, 192, -1)} | {"6/64/22": 2}


@pytest.mark.parametrize(
    "value, up, expected",
    [("now-1d/d", False, "2026-03-11T00:00:00"), ("now/d", True, "2026-03-12T23:59:59.999000"), ("2026-01-31||+1M", False, "2026-02-28T00:00:00"), ("2026-03-10", True, "2026-03-10T23:59:59.999000"), ("2026-03-10T12", True, "2026-03-10T12:00:00"), (1000, False, "1970-01-01T00:00:01"), ("now/w", False, "2026-03-09T00:00:00")],
)
def test_date_math(value, up, expected):
    assert dates.moment(value, NOW, up).isoformat() == expected + "+00:00"


def test_minimum_should_match():
    assert [matches_needed(s, n) for s, n in ((2, 3), (-1, 3), ("75%", 4), ("-25%", 4), ("2<75%", 4), ("2<75%", 2))] == [2, 2, 3, 3, 3, 2]


def test_tokens_and_fuzziness():
    assert text.tokens_of("It's 3.5, a.b x_y -- élan!") == ["it's", "3.5", "a.b", "x_y", "élan"]
    assert [text.auto_fuzziness(v, w) for v, w in (("AUTO", "ab"), ("AUTO", "abcd"), ("AUTO", "abcdef"), ("AUTO:1,2", "ab"), (1, "x"))] == [0, 1, 2, 2, 1]


def test_query_languages():
    assert lucene.parse("a AND b OR c")["bool"]["should"]
    with pytest.raises(Refused):
        lucene.parse("a)")
    with pytest.raises(Refused):
        kql.parse("a: (b")


def test_request_forms():
    assert read_request('GET logs-*/_search\n{"query": {"match": {"m": """a "b" c"""}}}') == ("logs-*", {"query": {"match": {"m": 'a "b" c'}}})
    assert fill({"a": "{{x}}", "b": "p-{{x}}"}, {"x": 3}) == {"a": 3, "b": "p-3"}


def test_grok_groups():
    regex, fields = grok.compile_grok(r"%{IP:ip} (?<verb>\w+) %{NUMBER:n:int}")
    assert [f[1:] for f in fields] == [("ip", "string"), ("verb", "string"), ("n", "int")]
    with pytest.raises(Refused):
        grok.compile_grok("%{NOPE:x}")


@pytest.mark.parametrize(
    "schedule, expected",
    [({"interval": "10m"}, ["*/10 * * * *"]), ({"daily": {"at": ["noon", "17:30"]}}, ["0 12 * * *", "30 17 * * *"]), ({"weekly": {"on": "friday", "at": "9:00"}}, ["0 9 * * 5"]), ({"hourly": {"minute": [0, 30]}}, ["0,30 * * * *"]), ({"cron": "0 0/5 * * * ?"}, ["0/5 * * * *"])],
)
def test_schedules(schedule, expected):
    assert alerts.cron_of(schedule) == expected


def test_missing_values_satisfy_not_eq_alone(spark):
    df = spark.sql("select cast(null as double) as v")
    assert [df.select(alerts.compared(F.col("v"), op, 3)).first()[0] for op in ("eq", "not_eq", "gt", "lt")] == [False, True, False, False]


def test_mapping_to_schema():
    t = from_mapping({"properties": {"a": {"type": "scaled_float", "scaling_factor": 100}, "o": {"properties": {"t": {"type": "text", "copy_to": "all"}}}, "r": {"type": "long_range"}, "n": {"type": "nested", "properties": {"x": {"type": "ip"}}}, "al": {"type": "alias", "path": "a"}}})
    assert t.schema.simpleString() == "struct<a:decimal(18,2),o:struct<t:string>,r:struct<gte:bigint,lte:bigint>,n:array<struct<x:string>>>"
    assert t.text_fields == {"o.t"} and t.aliases == {"al": "a"} and t.copies == {"all": ["o.t"]}


def test_console_templates():
    text_ = 'PUT _ilm/policy/p\n{"policy": {"phases": {"delete": {"min_age": "30d"}}}}\nPUT _component_template/c\n{"template": {"mappings": {"properties": {"a": {"type": "long"}}}}}\nPUT _index_template/t\n{"index_patterns": ["logs-*"], "composed_of": ["c"], "template": {"settings": {"index.lifecycle.name": "p"}, "mappings": {"properties": {"b": {"type": "keyword"}}}}}'
    t = read_console(text_)["logs-*"]
    assert t.retention_days == 30 and t.schema.names == ["a", "b"]


def test_auto_interval():
    assert [dashboards.auto_interval(ms) for ms in (3_600_000, 86_400_000, 7 * 86_400_000)] == ["1m", "30m", "3h"]


def test_equivalence(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None)], "k long, v double")
    assert equivalence.equal(a, a.withColumn("v", F.col("v") * (1 + 1e-12)), ["k"])
    assert not equivalence.equal(a, a.withColumn("v", F.col("v") + 1), ["k"])


def test_filter_branches_and_lists(spark):
    df = spark.createDataFrame([("a", "1"), ("b", None)], "k string, n string")
    rows = logstash.run(df, 'filter { if [k] == "a" { mutate { add_field => { "x" => "1" } } } else { mutate { add_field => { "x" => "2" } } } mutate { add_field => { "x" => "3" } convert => { "n" => "integer" } } }').orderBy("k").collect()
    assert [r["x"] for r in rows] == [["1", "3"], ["2", "3"]] and [r["n"] for r in rows] == [1, None]


def test_ingest_failure_handlers(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "n string")
    out = ingest.run(df, {"processors": [{"convert": {"field": "n", "type": "long", "on_failure": [{"set": {"field": "e", "value": "{{_ingest.on_failure_message}}"}}]}}]})
    assert sorted(str(r["e"]) for r in out.collect()) == ["None", "field [n] not present as part of path [n]", "unable to convert [x] to long"]


def test_community_id(spark):
    df = spark.createDataFrame([("128.232.110.120", "66.35.250.204", 34855, 80, "tcp")], "`source.ip` string, `destination.ip` string, `source.port` int, `destination.port` int, `network.transport` string")
    out = ingest.run(df, {"processors": [{"community_id": {}}]}).first()
    assert out["network.community_id"] == "1:LQU9qZlK+B5F3KDmev6m5PMibrg="


def test_pipeline_graph(spark):
    out = connectors.run_graph(
        spark,
        {
            "b": 'input { pipeline { address => "mid" } } filter { mutate { add_tag => ["b"] } } output { stdout { } }',
            "a": 'input { generator { lines => ["x", "y"] count => 1 } } output { if [message] == "x" { pipeline { send_to => ["mid"] } } }',
        },
    )
    assert [(r["message"], r["tags"]) for r in out["b"].collect()] == [("x", ["b"])]


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "in.txt").write_text("k=1\nk=2\n")
    connectors.run_batch(spark, f'input {{ file {{ path => "{tmp_path}/in.txt" }} }} filter {{ kv {{ include_keys => ["k"] }} }} output {{ file {{ path => "{tmp_path}/out" }} }}')
    assert sorted(r["k"] for r in spark.read.json(f"{tmp_path}/out").collect()) == ["1", "2"]


def test_interpreted_scripts():
    ctx = {"words": ["b", "a", "b", "ccc"], "n": 7, "o": {"x": 1}}
    source = """
      def seen = new HashMap(); int total = 0;
      for (def w : ctx.words) { if (w == 'a') { continue; } seen.put(w, seen.getOrDefault(w, 0) + 1); total += w.length(); }
      for (int i = 0; i < 10; i++) { if (i > 3) { break; } total += i; }
      ctx.counts = seen; ctx.total = total; ctx.half = ctx.n / 2;
      ctx.long_words = ctx.words.stream().filter(w -> w.length() > 1).map(w -> w.toUpperCase()).collect(Collectors.toList());
      ctx.joined = String.join('-', ctx.words.stream().distinct().sorted().toList());
      try { ctx.bad = Integer.parseInt('x'); } catch (Exception e) { ctx.bad = -1; }
      ctx.remove('n'); ctx.o.x = ctx.o.x + params.k;
    """
    painless_run.Interpreter(source, {"k": 4}).run(ctx)
    assert ctx == {"words": ["b", "a", "b", "ccc"], "o": {"x": 5}, "counts": {"b": 2, "ccc": 1}, "total": 11, "half": 3, "long_words": ["CCC"], "joined": "a-b-ccc", "bad": -1}
    with pytest.raises(painless_run.ScriptError):
        painless_run.Interpreter("while (true) { ctx.x = 1; }").run({})


def test_ingest_script_with_loop(spark):
    df = spark.createDataFrame([("a b a", 1), (None, 2)], "s string, n int")
    step = {"script": {"source": "int k = 0; for (def w : ctx.s.splitOnToken(' ')) { if (w == 'a') { k++; } } ctx.k = k; ctx.remove('n');", "outputs": "k int"}}
    rows = ingest.run(df, {"processors": [step]}).collect()
    assert [(r["s"], r["k"], r["n"]) for r in rows if r["s"]] == [("a b a", 2, None)]
    assert [(r["k"], r["n"], r["_ingest_error"][:13]) for r in rows if not r["s"]] == [(None, 2, "runtime error")]


def test_stream_throttle_cut_frames_and_batches(spark, tmp_path):
    """In the order of time within a micro-batch, also where Spark cuts a key's events into frames; counts go on in the next one."""
    start, n = datetime(2026, 3, 8), 40
    for part, hours in enumerate((0, 100)):
        rows = [(part * n + i, start + timedelta(hours=hours, minutes=i), None if i % 4 == 3 else f"k{i % 4}") for i in range(n)]
        spark.createDataFrame(rows[::-1], "id int, at timestamp, k string").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        events = spark.readStream.schema("id int, at timestamp, k string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        out = streams.collected(streams.throttle(events, F.col("k"), 3, 10**9, "at"))
        hourly = streams.collected(streams.throttle(events, F.col("k"), 3, 3600, "at"))
        got, each = ({r["id"]: r["throttled"] for r in x.collect()} for x in (out, hourly))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: i >= 12 for i in range(2 * n)}
    assert each == {i: i % n >= 12 for i in range(2 * n)}


def test_stream_rows_stay_out_of_the_driver(spark):
    """Rows of appending streams are read from files, not from a table in the driver's memory."""
    for name in ("stream_throttle", "stream_filters"):
        assert pipeline_queries.queries()[name](spark, "/root/testdata/sf0.001").inputFiles()
