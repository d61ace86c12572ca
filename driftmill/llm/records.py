"""Operator 1: token ids as length-delimited binary records with a separate offset index.

A record is: payload length (8 bytes), masked CRC-32C of these 8 bytes (4), payload, masked CRC-32C
of the payload (4); all numbers are little-endian. The payload is: document id (8, signed), 1 if
that id is null (1), bytes an id (1: 2 or 4), two zero bytes, then the token ids.

Each task writes one file under a name of its own attempt; the index, a Parquet table that Spark
commits, names the files of the attempts that count. A retried or speculative task so leaves at
most a file to which nothing refers, and readers never see it.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import crc32c
from .storage import fresh_path, open_folder
from .tokens import encoder, vocabulary_size

#: Layout and size of what stands before the ids.
HEAD, HEAD_SIZE = "<qBBxx", 12
#: Bytes of texts or payloads handled at once by a task.
BATCH_BYTES = 4 << 20
#: Units that a worker remembers: 100 to 150 MB more than the default of packing, whose workers do more besides.
MEMO_ENTRIES = 1_000_000


def frame(payloads: list[bytes]) -> list[bytes]:
    """The records of payloads."""
    sizes = [struct.pack("<Q", len(p)) for p in payloads]
    of_size, of_data = crc32c.masked(sizes).tolist(), crc32c.masked(payloads).tolist()
    return [s + struct.pack("<I", a) + p + struct.pack("<I", b) for s, a, p, b in zip(sizes, of_size, payloads, of_data)]


def unframe(stream, name: str = "") -> Iterator[list[bytes]]:
    """Batches of a file's payloads; raises ValueError where a length or checksum is wrong."""
    sizes, payloads, sums, held = [], [], [], 0

    def checked():
        if crc32c.masked(sizes).tolist() != [a for a, _ in sums] or crc32c.masked(payloads).tolist() != [b for _, b in sums]:
            raise ValueError(f"{name}: a checksum doesn't match")
        return payloads

    while head := stream.read(12):
        if len(head) < 12:
            raise ValueError(f"{name}: cut off")
        sizes.append(head[:8])
        n = struct.unpack("<Q", head[:8])[0]
        body = stream.read(n + 4)
        if len(body) != n + 4:
            raise ValueError(f"{name}: cut off")
        payloads.append(body[:n])
        sums.append((struct.unpack("<I", head[8:])[0], struct.unpack("<I", body[n:])[0]))
        held += n
        if held >= BATCH_BYTES:
            yield checked()
            sizes, payloads, sums, held = [], [], [], 0
    if payloads:
        yield checked()


def write_records(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every text's ids, with ``end_id`` after them, in ascending id order; return the index.

    The index has a row a document: part, place (within the part), file, offset (of the record),
    doc_id, n_tokens. A null text counts as empty; null ids come first; rows that share an id, even
    a third of all rows, keep a fixed order and may be dealt to several parts; an empty table gives
    an empty index. Further columns of ``docs`` play no part.
    """
    spark = docs.sparkSession
    folder = path or fresh_path(spark, "records")
    width = 2 if max(vocabulary_size(tokenizer), end_id + 1) <= 65536 else 4
    end = int(end_id).to_bytes(width, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, out, at, place = encoder(tokenizer, f"<u{width}", MEMO_ENTRIES), TaskContext.get().partitionId(), None, 0, 0
        name = f"part-{part:06d}-{uuid.uuid4().hex}.rec"
        store, top = open_folder(folder)
        try:
            for batch in batches:
                ids, payloads = batch.column(0).to_pylist(), []
                for k, (doc, text) in enumerate(zip(ids, batch.column(1))):
                    payloads.append(struct.pack(HEAD, doc or 0, doc is None, width) + encode(text.as_py()) + end)
                    if k + 1 < len(ids) and sum(map(len, payloads[-64:])) < BATCH_BYTES and len(payloads) < 512:
                        continue
                    if out is None:
                        store.create_dir(top, recursive=True)
                        out = store.open_output_stream(f"{top}/{name}")
                    records = frame(payloads)
                    out.write(b"".join(records))
                    sizes = np.array([len(r) for r in records], np.int64)
                    n = len(records)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * n, pa.int32()), pa.array(np.arange(place, place + n)), pa.array([name] * n), pa.array(at + np.cumsum(sizes) - sizes), pa.array(ids[k + 1 - n : k + 1], pa.int64()), pa.array([(len(p) - HEAD_SIZE) // width for p in payloads], pa.int64())],
                        ["part", "place", "file", "offset", "doc_id", "n_tokens"],
                    )
                    at, place, payloads = at + int(sizes.sum()), place + n, []
        finally:
            if out is not None:
                out.close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("tie"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    index = dealt.mapInArrow(write, "part int, place long, file string, offset long, doc_id long, n_tokens long")
    index.write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index").withColumn("folder", F.lit(folder))


def read_records(index: DataFrame) -> DataFrame:
    """Read the files back, every checksum tested: doc_id, start, n_tokens, ids (binary, unsigned 32-bit, little-endian).

    ``start`` counts the ids of all documents before. An empty index gives no rows.
    """
    files = index.groupBy("folder", "part", "file").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    files = files.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, top = open_folder(row["folder"])
                start = row["base"]
                with store.open_input_stream(f"{top}/{row['file']}", buffer_size=1 << 20) as stream:
                    for payloads in unframe(stream, row["file"]):
                        docs, counts, ids = [], [], []
                        for p in payloads:
                            doc, null, width = struct.unpack_from(HEAD, p)
                            docs.append(None if null else doc)
                            v = np.frombuffer(p, f"<u{width}", offset=HEAD_SIZE)
                            counts.append(len(v))
                            ids.append(v.astype("<u4").tobytes())
                        n = np.array(counts, np.int64)
                        starts = start + np.cumsum(n) - n
                        start += int(n.sum())
                        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    # A task a file: without a number, the few bytes of file names would be gathered into one task.
    dealt = files.select("folder", "file", "base", "part").repartitionByRange(max(1, files.count()), "part")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def read_record(folder: str, file: str, offset: int) -> tuple[int | None, np.ndarray]:
    """One record by its place in the index, as a shuffled reader fetches it."""
    store, top = open_folder(folder)
    with store.open_input_file(f"{top}/{file}") as f:
        f.seek(offset)
        head = f.read(12)
        f.seek(offset)
        data = f.read(16 + struct.unpack("<Q", head[:8])[0])
    (payload,) = next(unframe(io.BytesIO(data), file))
    doc, null, width = struct.unpack_from(HEAD, payload)
    return (None if null else doc), np.frombuffer(payload, f"<u{width}", offset=HEAD_SIZE)
