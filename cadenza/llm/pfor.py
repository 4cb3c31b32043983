"""Token ids in a binary format: patched frame-of-reference blocks in pages.

The ids of all documents, each closed by an end id, form one stream in ascending
order of doc_id (nulls first, equal doc_ids by text). The stream is cut into shards
(one per range partition), these into pages of whole documents, these into blocks of
BLOCK ids. A block stores its minimum, the differences to it packed at the width
that COVERED of them need, and an exception list of (place, whole difference) for
the others. A page begins with the documents' lengths and the index of block starts.

Pages are rows of a Parquet table in a folder: shard, page, first (ids before the
page in its shard), n_ids, doc_ids, payload. Where a shard starts follows from the
sizes of the shards before it.

One shuffle brings the texts into order. A page is bounded by PAGE ids, or one
document. Nulls and empty texts are an end id alone. Repeated doc_ids, also null
ones, each keep their row. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import release_memory, text_chunks
from .tokenized import broadcast_spec, library_encoder

BLOCK, PAGE, COVERED = 1024, 1 << 18, 0.95
MAGIC = b"PFR1"
#: Shards whose starts may be broadcast: 16 bytes each.
MOST_SHARDS = 100_000


def pack_block(ids: np.ndarray) -> bytes:
    """base u32, width u8, exceptions u16, packed differences, places u16, differences u32."""
    base = int(ids.min())
    over = (ids - np.uint32(base)).astype(np.uint32)
    width = int(np.partition(over, k := min(len(over) - 1, int(COVERED * len(over))))[k]).bit_length()
    late = np.flatnonzero(over >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    bits = np.unpackbits(over.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little")
    head = base.to_bytes(4, "little") + bytes([width]) + len(late).to_bytes(2, "little")
    return head + np.packbits(bits, bitorder="little").tobytes() + late.astype("<u2").tobytes() + over[late].astype("<u4").tobytes()


def unpack_block(raw: memoryview, n: int) -> np.ndarray:
    base, width, late = int.from_bytes(raw[:4], "little"), raw[4], int.from_bytes(raw[5:7], "little")
    size = (n * width + 7) // 8
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(raw, np.uint8, size, 7), count=n * width, bitorder="little").reshape(n, width)
    over = np.packbits(bits, bitorder="little").view("<u4").astype(np.uint32)
    places = np.frombuffer(raw, "<u2", late, 7 + size)
    over[places] = np.frombuffer(raw, "<u4", late, 7 + size + 2 * late)
    return over + np.uint32(base)


def pack_page(ids: np.ndarray, sizes: np.ndarray) -> bytes:
    blocks = [pack_block(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    at = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    counts = np.array([len(ids), len(sizes), BLOCK], "<u4")
    return MAGIC + counts.tobytes() + sizes.astype("<u4").tobytes() + at.tobytes() + b"".join(blocks)


def unpack_page(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a page and the lengths of its documents."""
    if payload[:4] != MAGIC:
        raise ValueError("not a page of this format")
    n, docs, block = np.frombuffer(payload, "<u4", 3, 4).tolist()
    sizes = np.frombuffer(payload, "<u4", docs, 16).astype(np.int64)
    blocks = -(-n // block)
    at = np.frombuffer(payload, "<u8", blocks + 1, 16 + 4 * docs).astype(np.int64)
    body = memoryview(payload)[16 + 4 * docs + 8 * (blocks + 1) :]
    out = [unpack_block(body[at[i] : at[i + 1]], min(block, n - i * block)) for i in range(blocks)]
    return (np.concatenate(out) if out else np.zeros(0, np.uint32)), sizes


def read_ids(payload: bytes, start: int, count: int) -> np.ndarray:
    """Ids start .. start + count - 1 of a page, from the blocks that hold them alone."""
    n, docs, block = np.frombuffer(payload, "<u4", 3, 4).tolist()
    blocks = -(-n // block)
    at = np.frombuffer(payload, "<u8", blocks + 1, 16 + 4 * docs).astype(np.int64)
    body = memoryview(payload)[16 + 4 * docs + 8 * (blocks + 1) :]
    first, last = start // block, -(-(start + count) // block)
    out = [unpack_block(body[at[i] : at[i + 1]], min(block, n - i * block)) for i in range(first, last)]
    return np.concatenate(out)[start - first * block :][:count] if out else np.zeros(0, np.uint32)


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int = 0) -> None:
    """Encode all texts and write the pages to `folder`."""
    spark = docs.sparkSession
    spec = broadcast_spec(spark, path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard = library_encoder(spec.value), TaskContext.get().partitionId()
        pending: list[tuple[list, np.ndarray, np.ndarray]] = []
        held = page = first = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, page, first
            names = [x for ids, _, _ in pending for x in ids]
            ids, sizes = np.concatenate([x for _, x, _ in pending]), np.concatenate([x for _, _, x in pending])
            row = {"shard": [shard], "page": [page], "first": [first], "n_ids": [len(ids)], "doc_ids": [names], "payload": [pack_page(ids, sizes)]}
            held, page, first = 0, page + 1, first + len(ids)
            pending.clear()
            return pa.RecordBatch.from_pydict(row, schema=schema)

        schema = None
        for piece in text_chunks(batches):
            schema = schema or pa.schema([("shard", pa.int32()), ("page", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(piece.schema.field("doc_id").type)), ("payload", pa.binary())])
            ids, at = encoder(piece.column("text"))
            with_end = np.insert(ids, at[1:], np.uint32(end_id))
            sizes, names = np.diff(at) + 1, piece.column("doc_id").to_pylist()
            at = np.concatenate([[0], np.cumsum(sizes)])
            i = 0
            while i < len(sizes):
                j = max(i + 1, int(np.searchsorted(at, at[i] + PAGE - held, side="right")) - 1)
                pending.append((names[i:j], with_end[at[i] : at[j]], sizes[i:j]))
                held += int(at[j] - at[i])
                i = j
                if held >= PAGE or i < len(sizes):
                    yield flush()
        if pending:
            yield flush()
        release_memory()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text").asc_nulls_first()]
    rows = docs.select("doc_id", "text")
    rows = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    rows.mapInArrow(run, f"shard int, page int, first long, n_ids long, doc_ids array<{kind}>, payload binary").write.mode("overwrite").parquet(folder)


def read_documents(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of each document in `folder`."""
    pages = spark.read.parquet(folder)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = pages.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
    if shards.count() <= MOST_SHARDS:
        shards = F.broadcast(shards)
    rows = pages.join(shards, "shard").select("doc_ids", (F.col("first") + F.col("base")).alias("start"), "payload")
    kind = pages.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, start, payload in zip(batch.column("doc_ids"), batch.column("start").to_pylist(), batch.column("payload"), strict=True):
                ids, sizes = unpack_page(payload.as_py())
                at = np.concatenate([[0], np.cumsum(sizes)])
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                columns = [names.values, pa.array(start + at[:-1], pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())]
                out = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, out = [*columns, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int64)))], [*out, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=out)

    return rows.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
