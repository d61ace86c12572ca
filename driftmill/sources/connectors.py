"""Inputs and outputs of pipeline configurations as Spark sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Refused
from ..operators.events import nest
from ..operators.logstash import Plugin, parse, route, run, _list


def read(spark: SparkSession, p: Plugin, streaming: bool = False) -> DataFrame:
    """Events of one input; texts without a codec are in ``message``."""
    codec = p.get("codec", "plain")
    codec = codec.name if isinstance(codec, Plugin) else codec
    schema = p.get("schema")
    match p.name:
        case "kafka":
            options = {"kafka.bootstrap.servers": str(p.get("bootstrap_servers", "localhost:9092")), "startingOffsets": str(p.get("auto_offset_reset", "latest"))}
            options |= {"subscribePattern": p.get("topics_pattern")} if p.get("topics_pattern") else {"subscribe": ",".join(_list(p.get("topics")))}
            for ours, theirs in (("group_id", "kafka.group.id"), ("security_protocol", "kafka.security.protocol"), ("sasl_mechanism", "kafka.sasl.mechanism"), ("sasl_jaas_config", "kafka.sasl.jaas.config")):
                if p.get(ours):
                    options[theirs] = str(p.get(ours))
            df = (spark.readStream if streaming else spark.read).format("kafka").options(**options).load()
            meta = [F.col(c).alias(f"@metadata.kafka.{c}") for c in ("topic", "partition", "offset", "key")]
            rows = df.select(F.col("value").cast("string").alias("message"), F.col("timestamp").alias("@timestamp"), *meta)
        case "file" | "stdin":
            path = p.get("path")
            reader = spark.readStream if streaming else spark.read
            if codec in ("json", "json_lines") and schema:
                return reader.schema(str(schema)).json(path)
            rows = reader.text(path).withColumnRenamed("value", "message")
        case "generator":
            lines = [str(x) for x in _list(p.get("lines", p.get("message", "Hello world!")))]
            count = int(p.get("count", 1))
            base = spark.range(count * len(lines))
            rows = base.select(F.get(F.array(*(F.lit(x) for x in lines)), (F.col("id") % len(lines)).cast("int")).alias("message"), F.floor(F.col("id") / len(lines)).alias("sequence"))
        case "tcp":
            if not streaming:
                raise Refused("a socket is read as a stream")
            rows = spark.readStream.format("socket").option("host", p.get("host", "localhost")).option("port", int(p.get("port"))).load().withColumnRenamed("value", "message")
        case _:
            raise Refused(f"input {p.name!r} isn't supported")
    if codec in ("json", "json_lines") and schema:
        rows = rows.select(F.from_json("message", str(schema)).alias("_j"), *(c for c in rows.columns if c != "message")).select("_j.*", *(f"`{c}`" for c in rows.columns if c != "message"))
    return rows


def read_all(spark: SparkSession, source: str, streaming: bool = False) -> DataFrame:
    """All inputs of a configuration as one DataFrame."""
    out = None
    for p in parse(source)["input"]:
        df = read(spark, p, streaming)
        if p.get("type"):
            df = df.withColumn("type", F.lit(p.get("type")))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise Refused("the configuration has no input")
    return out


def shaped(df: DataFrame, schema) -> DataFrame:
    """Events in a table's columns; fields that the table lacks go into its ``attributes`` map, if it has one."""
    names = {f.name: f.dataType for f in schema.fields}
    flat = df.columns
    out = [F.col(f"`{n}`").try_cast(t).alias(n) if n in flat else F.lit(None).cast(t).alias(n) for n, t in names.items() if n != "attributes"]
    if "attributes" in names:
        rest = [c for c in flat if c not in names]
        pairs = F.filter(F.array(*(F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in rest)), lambda e: e.getField("value").isNotNull()) if rest else F.array().cast("array<struct<key:string,value:string>>")
        out.append(F.map_from_entries(pairs).alias("attributes"))
    return df.select(*out)


def write(p: Plugin, df: DataFrame, tables: dict | None = None) -> None:
    """Write a batch to one output."""
    match p.name:
        case "stdout":
            df.write.format("noop").mode("append").save() if p.get("quiet") else df.show(truncate=False)
        case "null":
            df.write.format("noop").mode("append").save()
        case "file":
            fmt = p.get("codec", "json")
            nest(df).write.mode("append").format(fmt if fmt in ("json", "parquet", "orc", "text") else "json").save(p.get("path"))
        case "elasticsearch":
            index = str(p.get("index", "events"))
            target = (tables or {}).get(index, index)
            if isinstance(target, tuple):
                path, schema = target
                shaped(df, schema).write.mode("append").parquet(path)
            else:
                df.write.mode("append").saveAsTable(target.replace("-", "_"))
        case "kafka":
            key = [F.col(f"`{p.get('message_key')}`").cast("string").alias("key")] if p.get("message_key") else []
            body = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))
            df.select(*key, F.lit(p.get("topic_id")).alias("topic"), body.alias("value")).write.format("kafka").option("kafka.bootstrap.servers", p.get("bootstrap_servers")).save()
        case _:
            raise Refused(f"output {p.name!r} isn't supported")


def run_batch(spark: SparkSession, source: str, tables: dict | None = None) -> None:
    """A whole configuration over its inputs, once."""
    config = parse(source)
    events = run(read_all(spark, source), config)
    for p, df in route(events, config):
        write(p, df, tables)


def run_graph(spark: SparkSession, pipelines: dict[str, str]) -> dict[str, DataFrame]:
    """Pipelines joined by pipeline inputs and outputs: the events that leave each, in an order that feeds them."""
    parsed = {n: parse(s) for n, s in pipelines.items()}
    sends: dict[str, list[tuple[str, DataFrame]]] = {}
    out: dict[str, DataFrame] = {}
    waits = {n: {str(i.get("address")) for i in c["input"] if i.name == "pipeline"} for n, c in parsed.items()}
    offers = {n: set() for n in parsed}

    def addresses(body, to):
        for s in body:
            if isinstance(s, Plugin):
                if s.name == "pipeline":
                    to.update(map(str, _list(s.get("send_to"))))
            else:
                for _, arm in s.arms:
                    addresses(arm, to)

    for n, c in parsed.items():
        addresses(c["output"], offers[n])
    left = dict(parsed)
    while left:
        ready = [n for n in left if not any(waits[n] & offers[m] for m in left if m != n)]
        if not ready:
            raise Refused(f"pipelines feed each other in a circle: {sorted(left)}")
        for n in ready:
            c = left.pop(n)
            parts = [df for i in c["input"] if i.name == "pipeline" for a, df in sends.get(str(i.get("address")), [])] + [read(spark, i) for i in c["input"] if i.name != "pipeline"]
            events = parts[0]
            for p in parts[1:]:
                events = events.unionByName(p, allowMissingColumns=True)
            out[n] = run(events, c)
            for p, df in route(out[n], c):
                if p.name == "pipeline":
                    for a in _list(p.get("send_to")):
                        sends.setdefault(str(a), []).append((n, df))
    return out
