"""Operator 5: packing by power-of-two decomposition.

A document of n ids becomes n // 2048 pieces of 2048 ids and one piece for each set bit of the
rest, longest first. Each piece is a sequence of its own, so no sequence crosses documents, none
holds padding, and sequences of one bucket (equal length) batch together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

#: Sequences a partition may number; with it a sequence id tells its partition and place.
SEQUENCES_A_PARTITION = 1 << 38
_FLUSH_BYTES = 4 << 20


def decompose(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; ``longest`` is a power of two."""
    pieces = [(s, longest) for s in range(0, n - n % longest, longest)]
    at = n - n % longest
    for bit in range(longest.bit_length() - 2, -1, -1):
        if n >> bit & 1:
            pieces.append((at, 1 << bit))
            at += 1 << bit
    return pieces


def pack(docs: DataFrame, tokenizer: str, end_id: int, longest: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``ids`` holds unsigned 32-bit little-endian integers. A null text counts as empty and so gives
    its end id alone; a null id stays null; repeated rows are packed each; an empty table gives no
    rows; further columns play no part. There is no shuffle: a sequence id is made of the
    partition's number and a count within it, both the same when a task runs again.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sequence = encoder(tokenizer), TaskContext.get().partitionId() * SEQUENCES_A_PARTITION
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        rows: list[list] = [[] for _ in names]
        held = 0

        def flush():
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows[:6]), pa.array(rows[6], pa.binary())], names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                n = len(ids) // 4
                for start, length in decompose(n, longest):
                    for c, v in zip(rows, (doc, start, length, n, sequence, 0, ids[4 * start : 4 * (start + length)])):
                        c.append(v)
                    sequence += 1
                    held += 4 * length
                    if held >= _FLUSH_BYTES:
                        yield flush()
                        rows, held = [[] for _ in names], 0
        if rows[0]:
            yield flush()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def write_buckets(pieces: DataFrame, path: str) -> DataFrame:
    """Sequences as Parquet, a folder for each bucket of equal length, read back.

    Repeated rows are written each; null ids stay null; no rows give an empty table.
    """
    pieces.write.partitionBy("length").parquet(path)
    return pieces.sparkSession.read.schema(pieces.schema).parquet(path).select(*pieces.columns)
