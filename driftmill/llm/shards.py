"""Operator 7: sharding by a permutation-filled lookup table.

Shards take turns to claim, each by its own order of preference, the free slots of a table of prime
size. A key's slot is its hash modulo that size. Shards so own nearly equal numbers of slots, and
few slots change hands when a shard comes or goes. The table is small and of known size, so it is
broadcast, and placing a row is one hash and one lookup.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hexadecimal digits of an MD5 that make a hash: 60 bits, so that it is a positive long.
DIGITS = 15
#: Slots that a table may have; bounds what is broadcast to some 32 MB.
MOST_SLOTS = 2_000_003


def text_hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: list[str], slots: int) -> list[int]:
    """The owner (a place in ``shards``) of every slot.

    A shard's order of preference starts at hash(name + ':offset') mod slots and steps by
    hash(name + ':skip') mod (slots - 1) + 1, which visits all slots since their number is prime.
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must have distinct names")
    if not is_prime(slots) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    at = [text_hash(s + ":offset") % slots for s in shards]
    skip = [text_hash(s + ":skip") % (slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while free:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            owner[at[k]] = k
            free -= 1
            if not free:
                break
    return owner


def slot(key: Column, slots: int) -> Column:
    """A key's slot; null counts as the empty key."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, DIGITS)
    return F.conv(digits, 16, 10).cast("long") % slots


def lookup_table(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    owner = fill(shards, slots)
    return spark.createDataFrame([(i, shards[k], k) for i, k in enumerate(owner)], "slot long, shard string, shard_no int")


def place(rows: DataFrame, key: str, shards: list[str], slots: int) -> DataFrame:
    """``rows`` in a struct ``row`` with slot, shard and shard_no.

    Rows of equal keys, repeated ones included, go to one shard; a null key counts as the empty
    text; an empty table gives no rows; columns of any name are kept apart in ``row``.
    """
    own = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), slot(F.col(f"`{key}`"), slots).alias("slot"))
    return own.join(F.broadcast(lookup_table(rows.sparkSession, shards, slots)), "slot")  # a row a slot, MOST_SLOTS at most


def write_shards(rows: DataFrame, key: str, shards: list[str], slots: int, path: str) -> None:
    """A folder of Parquet files for each shard; tasks write what they hold, so no shard's rows meet in one task."""
    placed = place(rows, key, shards, slots)
    placed.select("row.*", F.col("shard").alias("_shard")).write.partitionBy("_shard").parquet(path)


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def oracle(table: str, key: str, n: int, slots: int) -> str:
    """SQL that fills the table turn by turn and places every row."""
    number = "('0x' || substr(md5({}), 1, 15))::BIGINT"
    return f"""
WITH RECURSIVE shard AS (
  SELECT k, {number.format("name || ':offset'")} % {slots} AS o, {number.format("name || ':skip'")} % {slots - 1} + 1 AS s
  FROM (SELECT k, 'shard-' || lpad(k::VARCHAR, 5, '0') AS name FROM range({n}) t(k))
), lists AS (SELECT list(o ORDER BY k) AS os, list(s ORDER BY k) AS ss FROM shard),
fill(turn, owner, nxt) AS (
  SELECT 0, list_transform(range({slots}), lambda x: -1), list_transform(range({n}), lambda x: 0) FROM lists
  UNION ALL
  SELECT turn + 1,
    list_transform(owner, lambda x, i: CASE WHEN i - 1 = (os[turn % {n} + 1] + j * ss[turn % {n} + 1]) % {slots} THEN turn % {n} ELSE x END),
    list_transform(nxt, lambda x, i: CASE WHEN i - 1 = turn % {n} THEN j + 1 ELSE x END)
  FROM (
    SELECT turn, owner, nxt, os, ss,
      list_filter(range(nxt[turn % {n} + 1], {slots}), lambda j: owner[(os[turn % {n} + 1] + j * ss[turn % {n} + 1]) % {slots} + 1] = -1)[1] AS j
    FROM fill, lists WHERE turn < {slots})
), slots AS (SELECT unnest(range({slots})) AS slot, unnest(owner) AS k FROM fill WHERE turn = {slots})
SELECT d.{key}, s.slot::BIGINT AS slot, 'shard-' || lpad(s.k::VARCHAR, 5, '0') AS shard
FROM {table} d JOIN slots s ON {number.format(f"coalesce(d.{key}::VARCHAR, '')")} % {slots} = s.slot
"""
