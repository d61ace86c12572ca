"""Connected components of a graph too large for one machine, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Rows of a key beyond which they are dealt to several tasks, where the table is small, and such keys at most.
HOT_ROWS, MOST_HOT = 256, 250_000


def hot_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, tie: str, how: str = "inner") -> DataFrame:
    """``left`` joined on ``key`` with ``right``, which has a row a key, so that no key's rows all meet in one task.

    ``counts`` (key, n) tells how many rows of ``left`` a key has. A key of more than HOT_ROWS, or than
    a MOST_HOTth of all rows if that is more, is cut by a hash of ``tie``; so at most MOST_HOT keys
    are cut, and their list, some 4 MB, is broadcast. Null keys find nothing.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = max(HOT_ROWS, total // MOST_HOT)
    cuts = F.broadcast(counts.where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("_cuts")))
    cut = F.coalesce("_cuts", F.lit(1))
    dealt = left.join(cuts, key, "left").withColumn("_cut", F.pmod(F.xxhash64(tie), cut).cast("int")).drop("_cuts")
    copies = right.join(cuts, key, "left").withColumn("_cut", F.explode(F.sequence(F.lit(0), cut - 1))).drop("_cuts")
    return dealt.join(copies, [key, "_cut"], how).drop("_cut")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node that an edge (a, b) joins to another; root is the component's least node.

    Each round hangs a node's larger neighbours on its least one, then its smaller neighbours; the
    graph ends as stars around the least nodes. Minima are combined before the shuffle, joins are
    such that Spark can split a hub's rows, and each round's edges are written to the shared folder.
    Edges with a null end and loops count for nothing; repeated edges count once; no edges, no rows.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) as hi", "least(a, b) as lo")
    now = written(pairs.distinct(), "edges")
    sign = _sign(now)
    for _ in range(rounds):
        if sign[0] == 0:
            break
        now = written(_small_star(_large_star(now)).distinct(), "edges")
        before, sign = sign, _sign(now)
        if before == sign:
            break
    else:
        raise RuntimeError(f"the components aren't stars after {rounds} rounds")
    members = now.selectExpr("hi as node", "lo as root")
    return members.union(now.selectExpr("lo as node", "lo as root").distinct())


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.selectExpr("hi as u", "lo as v").union(edges.selectExpr("lo as u", "hi as v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
    return both.where("v > u").join(least, "u").selectExpr("v as hi", "m as lo")


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where("lo <> m").selectExpr("lo as hi", "m as lo")
    return moved.union(least.selectExpr("hi", "m as lo"))
