"""Index patterns to DataFrames, each with what the engine must know of it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession

from .config import EngineConfig, Refused
from .plans.search import SearchResult, read_request, search


@dataclass
class Catalog:
    """Tables by index glob; the most specific glob that fits a name wins."""

    tables: dict[str, tuple[Callable[[], DataFrame], EngineConfig]] = field(default_factory=dict)

    def add(self, glob: str, load: Callable[[], DataFrame], config: EngineConfig | None = None) -> Catalog:
        self.tables[glob] = (load, config or EngineConfig())
        return self

    def resolve(self, index: str) -> tuple[DataFrame, EngineConfig]:
        names = [i for i in index.split(",") if i] or [""]
        found = []
        for name in names:
            fits = [g for g in self.tables if fnmatchcase(name, g) or fnmatchcase(g, name)]
            if not fits:
                raise Refused(f"no table for the index {name!r}")
            found.append(max(fits, key=lambda g: (len(g.replace("*", "")), g)))
        (load, config), *more = [self.tables[g] for g in dict.fromkeys(found)]
        df = load()
        for other, _ in more:
            df = df.unionByName(other(), allowMissingColumns=True)
        return df, config

    def search(self, request: str | dict, index: str = "", params: dict | None = None, **overrides) -> SearchResult:
        named, body = read_request(request)
        df, config = self.resolve(index or named)
        return search(df, body, replace(config, **overrides) if overrides else config, params)


def driver_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The tables of a test folder."""
    read = lambda name: lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    out = Catalog()
    settings = {
        "events": EngineConfig(time_field="ts", id_field="event_id", attributes={"props.*": "props"}),
        "orders": EngineConfig(time_field="o_orderdate", id_field="o_orderkey"),
        "lineitem": EngineConfig(time_field="l_shipdate"),
        "documents": EngineConfig(text_fields={"text"}, id_field="doc_id"),
        "pages": EngineConfig(text_fields={"html"}, id_field="page_id"),
        "conversations": EngineConfig(text_fields={"text"}),
        "part": EngineConfig(text_fields={"p_name"}, id_field="p_partkey"),
        "embeddings": EngineConfig(id_field="vec_id"),
    }
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        out.add(name, read(name), settings.get(name))
    return out
