"""Operator 8: exact top-k by inner product with best-first search of M-trees.

Inner products become distances: all vectors get one more component that gives them the length R of
the longest, queries get zero there, and then d(q, x)^2 = |q|^2 + R^2 - 2 q.x. Vectors are dealt to
cells by their nearest pivot, large cells further by a hash, and each cell holds an M-tree: pages of
entries with covering radii and distances to the page's routing vector. A search visits pages in
the order of their least possible distance and skips, by the triangle inequality on stored
distances, what cannot beat the k-th best so far. Distances only prune, with room for rounding;
results are ranked by exact integer products. The integers are kept as doubles, which hold
floor(scale * x) of every double x exactly if the scale is a power of two.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import open_folder, written

#: Vectors of a cell, entries of a page, and pivots at most; queries that a task holds at once; vectors that give first bounds.
CELL_ROWS, PAGE_ENTRIES, MOST_PIVOTS, QUERY_BLOCK, KNOWN = 4096, 256, 4096, 8192, 1024

PAGE_SCHEMA = "cell string, page int, leaf boolean, dim int, to_parent binary, radius binary, child binary, vec_id binary, vector binary"


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """(vec_id, dim, v): floor(scale * x) of each component, for vectors without null or non-finite components."""
    x = F.col(vector_col)
    usable = F.forall(x, lambda e: F.coalesce(F.abs(e.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(e.cast("double")))
    rows = vectors.where(x.isNotNull() & F.col(id_col).isNotNull()).where(usable)
    times = F.transform(x, lambda e: F.lit(float(scale)) * e.cast("double"))
    # From 2**52 on a double is an integer; floor() itself would turn it into a long.
    whole = F.transform(times, lambda e: F.when(F.abs(e) < float(1 << 52), F.floor(e).cast("double")).otherwise(e))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.size(x).alias("dim"), whole.alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def lifted(v: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that makes them all of squared length ``longest``."""
    f = v.astype(np.float64)
    return np.concatenate((f, np.sqrt(np.maximum(longest - (f * f).sum(1), 0))[:, None]), axis=1)


def products(v: np.ndarray, q: np.ndarray, most: float | None = None) -> np.ndarray:
    """Exact integer products of the rows of v with q; ``most`` is the largest size of a component of v.

    Through floating point where every sum stays below 2**53, else by integers of any length.
    """
    most = float(np.abs(v).max(initial=0)) if most is None else most
    if most * float(np.abs(q).max(initial=0)) * max(v.shape[1], 1) < 2**52:
        return np.rint(v @ q).astype(np.int64)
    w = [int(e) for e in q.tolist()]
    return np.array([sum(int(e) * f for e, f in zip(row, w)) for row in v.tolist()], object)


# ---------------------------------------------------------------- the index


def build_pages(ids: np.ndarray, v: np.ndarray, longest: float) -> list[dict]:
    """The pages of an M-tree over a cell, root first; bulk loaded from the top."""
    x = lifted(v, longest)
    pages: list[dict] = []

    def routing(rows: np.ndarray) -> int:
        mean = x[rows].mean(axis=0)
        return int(rows[((x[rows] - mean) ** 2).sum(1).argmin()])

    def add(rows: np.ndarray, center: int) -> int:
        """A page for ``rows`` whose entries know their distance to row ``center``; returns its number."""
        number = len(pages)
        pages.append({})
        if len(rows) <= PAGE_ENTRIES:
            to_parent = np.sqrt(((x[rows] - x[center]) ** 2).sum(1))
            pages[number] = {"leaf": True, "to_parent": to_parent, "radius": np.zeros(0), "child": np.zeros(0, np.int32), "rows": rows}
            return number
        seeds = [int(rows[((x[rows] - x[center]) ** 2).sum(1).argmax()])]
        near = ((x[rows] - x[seeds[0]]) ** 2).sum(1)
        group = np.zeros(len(rows), np.int64)
        while len(seeds) < min(PAGE_ENTRIES, -(-len(rows) // PAGE_ENTRIES) + 1) and near.max() > 0:
            seeds.append(int(rows[near.argmax()]))
            d = ((x[rows] - x[seeds[-1]]) ** 2).sum(1)
            group[d < near] = len(seeds) - 1
            near = np.minimum(near, d)
        parts = [p for p in (rows[group == g] for g in range(len(seeds))) if len(p)]
        if len(parts) == 1:  # equal vectors
            parts = np.array_split(rows, min(PAGE_ENTRIES, -(-len(rows) // PAGE_ENTRIES)))
        heads = [routing(p) for p in parts]
        radius = np.array([np.sqrt(((x[p] - x[h]) ** 2).sum(1).max()) for p, h in zip(parts, heads)])
        to_parent = np.array([np.sqrt(((x[h] - x[center]) ** 2).sum()) for h in heads])
        child = np.array([add(p, h) for p, h in zip(parts, heads)], np.int32)
        pages[number] = {"leaf": False, "to_parent": to_parent, "radius": radius, "child": child, "rows": np.array(heads)}
        return number

    every = np.arange(len(ids))
    head = routing(every)
    add(every, head)
    root = {"leaf": False, "to_parent": np.zeros(1), "radius": np.array([np.sqrt(((x - x[head]) ** 2).sum(1).max())]), "child": np.array([1], np.int32), "rows": np.array([head])}
    for p in pages:
        p["child"] = p["child"] + 1 if len(p["child"]) else p["child"]
    pages.insert(0, root)
    for p in pages:
        p["vec_id"], p["vector"] = ids[p["rows"]], v[p["rows"]]
    return pages


class Tree:
    """A cell's pages, ready to be searched."""

    def __init__(self, pages: list[dict], longest: float):
        self.pages, self.longest = pages, longest
        for p in pages:
            if p["leaf"]:
                p["most"] = float(np.abs(p["vector"]).max(initial=0))
            else:
                p["lifted"] = lifted(p["vector"], longest)

    def search(self, q: np.ndarray, own: int, k: int, floor: int | None) -> tuple[list[tuple[int, int]], int]:
        """The best (score, vec_id) that may be among the k best, and how many distances were computed.

        ``floor``: a score that k other vectors are known to reach; lower ones are not needed.
        """
        x, length = np.append(q, 0.0), float((q**2).sum())
        slack = 1e-7 * (np.sqrt(self.longest) + np.sqrt(length) + 1)

        def reach(score: int | None) -> float:
            return np.inf if score is None else float(np.sqrt(max(length + self.longest - 2.0 * float(score), 0))) + slack

        best: list[tuple[int, int]] = []
        limit, done = reach(floor), 0
        heap: list[tuple[float, int, float]] = [(0.0, 0, 0.0)]
        root = True
        while heap:
            least, number, from_parent = heapq.heappop(heap)
            if least > limit:
                break
            page = self.pages[number]
            may = np.ones(1, bool) if root else np.abs(from_parent - page["to_parent"]) - (0 if page["leaf"] else page["radius"]) <= limit
            rows = np.flatnonzero(may)
            done += len(rows)
            if page["leaf"]:
                scores = products(page["vector"] if len(rows) == len(may) else page["vector"][rows], q, page["most"])
                worst = best[-1][0] if len(best) == k else floor
                keep = np.flatnonzero((page["vec_id"][rows] != own) & (scores >= worst if worst is not None else True))
                if len(keep):
                    best = sorted([*best, *zip(scores[keep].tolist(), page["vec_id"][rows[keep]].tolist())], key=lambda e: (-e[0], e[1]))[:k]
                    if len(best) == k:
                        limit = min(limit, reach(best[-1][0]))
            else:
                d = np.sqrt(((page["lifted"][rows] - x) ** 2).sum(1))
                bound = np.maximum(d - page["radius"][rows], 0)
                for i in np.flatnonzero(bound <= limit):
                    heapq.heappush(heap, (float(bound[i]), int(page["child"][rows[i]]), float(d[i])))
            root = False
        return best, done


def index(rows: DataFrame, longest: dict[int, float]) -> DataFrame:
    """The pages of all cells of (vec_id, dim, v), written to the shared folder.

    Pivots are the first rows in the order of a hash, MOST_PIVOTS at most; every row is indexed.
    """
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    wanted = min(MOST_PIVOTS, max(1, total // (2 * CELL_ROWS)))
    pivots: dict[int, list] = {}
    for r in rows.select("dim", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).collect():
        pivots.setdefault(r["dim"], []).append(r["v"])
    arrays = {d: np.array(v, np.float64).reshape(len(v), d) for d, v in pivots.items()}

    @F.arrow_udf("int")
    def nearest(v: pa.Array) -> pa.Array:
        sizes, flat = np.array([len(e) for e in v], np.int64), v.flatten().to_numpy(zero_copy_only=False)
        ends, out = np.cumsum(sizes), np.zeros(len(v), np.int32)
        for dim in np.unique(sizes).tolist():
            if dim in arrays and dim:
                rows, p = np.flatnonzero(sizes == dim), arrays[dim]
                x = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
                out[rows] = ((p**2).sum(1) - 2 * (x @ p.T)).argmin(1)
        return pa.array(out)

    dealt = written(rows.withColumn("pivot", nearest("v")), "dealt")
    cells = dealt.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("cuts"))
    named = dealt.join(cells, ["dim", "pivot"])
    named = named.select(F.concat_ws("/", "dim", "pivot", F.expr("pmod(xxhash64(vec_id), cuts)")).alias("cell"), "dim", "vec_id", "v")

    def build(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        pages = build_pages(table["vec_id"].to_numpy(), _matrix(table["v"], dim), longest[dim])
        return pa.table(
            {
                "cell": [table["cell"][0].as_py()] * len(pages),
                "page": pa.array(range(len(pages)), pa.int32()),
                "leaf": [p["leaf"] for p in pages],
                "dim": pa.array([dim] * len(pages), pa.int32()),
                "to_parent": [p["to_parent"].astype("<f8").tobytes() for p in pages],
                "radius": [p["radius"].astype("<f8").tobytes() for p in pages],
                "child": [p["child"].astype("<i4").tobytes() for p in pages],
                "vec_id": [p["vec_id"].astype("<i8").tobytes() for p in pages],
                "vector": [p["vector"].astype("<f8").tobytes() for p in pages],
            }
        )

    return written(named.groupBy("cell").applyInArrow(build, PAGE_SCHEMA), "mtree")


def _page(row: dict) -> dict:
    ids = np.frombuffer(row["vec_id"], "<i8")
    return {"leaf": row["leaf"], "to_parent": np.frombuffer(row["to_parent"], "<f8"), "radius": np.frombuffer(row["radius"], "<f8"), "child": np.frombuffer(row["child"], "<i4"), "vec_id": ids, "vector": np.frombuffer(row["vector"], "<f8").reshape(len(ids), row["dim"])}


# ---------------------------------------------------------------- the search


def _with_floor(known: list[tuple[int, list[float]]], k: int):
    """A mapInArrow function that adds to queries a score which k other vectors are known to reach, as text, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d in {len(v) for _, v in known}:
            same = {i: v for i, v in known if len(v) == d}
            by_dim[d] = np.array(list(same), np.int64), np.array(list(same.values()), np.float64).reshape(len(same), d)
        for batch in batches:
            floors = []
            for query, v in zip(batch.column(0).to_pylist(), batch.column(2)):
                q = np.array(v.as_py(), np.float64)
                ids, sample = by_dim.get(len(q), (np.zeros(0), None))
                scores = np.sort(products(sample, q)[ids != query]) if len(ids) else ids
                floors.append(str(int(scores[-k])) if len(scores) >= k else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.string())], ["query_id", "dim", "v", "floor"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best other rows, ties to the smaller vec_id.

    Vectors or ids that are null, and vectors that hold null or non-finite components, take no part;
    every other vector does, whatever the size of its components (``scale`` is a power of two). A
    score among the best that no long can hold is an error. A query meets only vectors of its own
    length; with fewer others than k all are returned; rows that repeat a query's own id are its own.
    An empty table gives no rows.

    Queries are written in files of some QUERY_BLOCK rows. The task of a cell reads one after the
    other, so the index is dealt once, and what a task holds has a fixed bound.
    """
    spark = vectors.sparkSession
    rows = written(scaled(vectors.select(F.col(id_col), F.col(vector_col)), id_col, vector_col, scale), "vectors")
    length = F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)
    longest = {r["dim"]: float(r["r"]) for r in rows.groupBy("dim").agg(F.max(length).alias("r")).collect()}
    pages = index(rows, longest)
    asked = rows.withColumnRenamed("vec_id", id_col).where(is_query).select(F.col(id_col).alias("query_id"), "dim", "v").dropDuplicates(["query_id"])
    known = [(r["vec_id"], r["v"]) for r in rows.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(KNOWN).collect()]
    asked = written(asked.mapInArrow(_with_floor(known, k), "query_id long, dim int, v array<double>, floor string"), "asked")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    files = written(asked.repartition(blocks, "query_id"), "queries").inputFiles()

    def search(table: pa.Table) -> pa.Table:
        from pyarrow import parquet

        rows = sorted(table.to_pylist(), key=lambda r: r["page"])
        dim, out = rows[0]["dim"], ([], [], [])
        tree = Tree([_page(r) for r in rows], longest[dim])
        for file in files:
            store, place = open_folder(file)
            with store.open_input_file(place) as f:
                block = parquet.read_table(f, filters=[("dim", "=", dim)])
            for q, v, floor in zip(block["query_id"].to_pylist(), _matrix(block["v"], dim), block["floor"].to_pylist()):
                for score, i in tree.search(v, q, k, None if floor is None else int(floor))[0]:
                    for c, e in zip(out, (q, i, score)):
                        c.append(e)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(map(str, out[2]), pa.string())})

    out = pages.groupBy("cell").applyInArrow(search, "query_id long, vec_id long, score string")
    # A cell's scores may be beyond a long where the best of all aren't, so they come as decimals, and only the best as longs.
    out = out.withColumn("score", F.col("score").cast("decimal(38,0)"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))
