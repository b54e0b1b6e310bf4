"""Exchange of packed values between blocks of texts and buckets of values.

A block is a run of rows of one task, with a bounded number of text bytes, compressed to one row
(a longer text is a block of its own). A block sends its values (words, hashes) to buckets chosen
by the values, one compressed row per block and bucket; a bucket sees every block's share of its
values and answers each block by one row. Values are made distinct per block first, so a value
that is frequent everywhere reaches its bucket once per block. Sizes are bounded by a block on
one side and by the number of buckets, which grows with the cluster's shuffle partitions, on the
other.

Tasks read both sides as sorted streams and hold one block, or one bucket, at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvseries.llm.common import map_arrow, raw, rows

ROW = "block long, bucket int, blob binary"


def bucket_count(df: DataFrame) -> int:
    return max(16, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def packed(df: DataFrame, size: int) -> DataFrame:
    """(block, bucket = -1, blob): rows (doc_id, text) in compressed blocks of about ``size`` text bytes.

    Blocks are numbered by task and place, so the same stored input always gives the same blocks.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        bytes_held = 0
        for batch in batches:
            start, texts = 0, raw(batch)
            for i, t in enumerate(texts):
                bytes_held += len(t)
                if bytes_held >= size:
                    held.append(batch.slice(start, i + 1 - start))
                    yield _block(number, held)
                    held, bytes_held, start, number = [], 0, i + 1, number + 1
            if start < len(texts):
                held.append(batch.slice(start))
        if held:
            yield _block(number, held)

    return map_arrow(df.select("doc_id", "text"), pack, ROW)


def _block(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).combine_chunks()
    # A fixed schema: field attributes of the source don't matter here.
    table = pa.table({"doc_id": table["doc_id"], "text": table["text"].cast(pa.large_binary())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_table(table)
    return send(number, {-1: sink.getvalue().to_pybytes()})


def unpack(blob: bytes) -> tuple[list, list[bytes | None]]:
    """(keys, texts) of a block."""
    with pa.ipc.open_stream(blob) as stream:
        table = stream.read_all()
    return table["doc_id"].to_pylist(), table["text"].to_pylist()


def send(block: int, blobs: dict[int, bytes]) -> pa.RecordBatch:
    return rows({"block": [block] * len(blobs), "bucket": list(blobs), "blob": list(blobs.values())},
                block=pa.int64(), bucket=pa.int32(), blob=pa.binary())


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        yield from zip(batch.column("block").to_pylist(), batch.column("bucket").to_pylist(), batch.column("blob").to_pylist())


def from_blocks(packs: DataFrame, values: Callable[[bytes], dict[int, bytes]]) -> DataFrame:
    """Each block's rows for the buckets."""
    def run(batches):
        for block, _, blob in _items(batches):
            yield send(block, values(blob))
    return map_arrow(packs, run, ROW)


def in_buckets(sent: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """The buckets' rows for the blocks: ``answer`` maps the blobs of a bucket to one blob each."""
    def run(batches):
        bucket, blocks, blobs = None, [], []

        def flush():
            return rows({"block": blocks, "bucket": [bucket] * len(blocks), "blob": answer(blobs)},
                        block=pa.int64(), bucket=pa.int32(), blob=pa.binary())

        for block, b, blob in _items(batches):
            if b != bucket:
                if blocks:
                    yield flush()
                bucket, blocks, blobs = b, [], []
            blocks.append(block)
            blobs.append(blob)
        if blocks:
            yield flush()

    return map_arrow(sent.repartition("bucket").sortWithinPartitions("bucket", "block"), run, ROW)


def to_blocks(packs: DataFrame, answers: list[DataFrame], use: Callable[[int, bytes, list[dict[int, bytes]]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """Bring the answers of one or more exchanges to their blocks: ``use(block, blob, answers by bucket)``."""
    kinds = len(answers)
    both = packs.withColumn("kind", F.lit(kinds))
    for k, a in enumerate(answers):
        both = both.union(a.select("block", "bucket", "blob", F.lit(k).alias("kind")))

    def run(batches):
        current, got = None, []
        for batch in batches:
            for (block, bucket, blob), kind in zip(_items([batch]), batch.column("kind").to_pylist()):
                if block != current:
                    current, got = block, [{} for _ in range(kinds)]
                if kind < kinds:
                    got[kind][bucket] = blob
                else:
                    yield from use(block, blob, got)

    return map_arrow(both.repartition("block").sortWithinPartitions("block", "kind", "bucket"), run, schema)
