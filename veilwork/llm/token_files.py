"""Token-id files: documents in ascending doc_id order as grammar-compressed blocks.

The files are Parquet tables of blocks (columns part, block, tokens, payload), written by Spark's
committing writer, so a lost executor's blocks are written again and any shared store will do. A block
holds whole documents, about BLOCK_TOKENS ids. The order (part, block) is the ascending order of ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encode import encoder
from .repair import Block, pack
from .store import new_path
from .textkernel import sub_batches

BLOCK_TOKENS = 1 << 19
BLOCKS = "part int, block int, tokens long, payload binary"
DECODED = "part int, first long, doc_id long, n_tokens long, ids_crc32 long"


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Encodes docs (doc_id, text) and appends end_id to each document.

    A null text is empty; null ids come first; rows that share an id stay, in an order by their texts' hashes, so
    that their range too can be cut; a text of any length is one document; an empty table gives files without blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        first = max(tool.library.get_vocab_size(), end_id + 1)
        part, block = TaskContext.get().partitionId(), 0
        ids, counts, names, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, counts, names, held, block
            payload = pack(names, np.concatenate(counts), np.concatenate(ids), first)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([held]), pa.array([payload], pa.binary())], ["part", "block", "tokens", "payload"])
            ids, counts, names, held, block = [], [], [], 0, block + 1
            return out

        for batch in sub_batches(batches, "text", 1 << 20):
            found, n = tool.column(batch.column(1))
            stops = np.cumsum(n)
            ids.append(np.insert(found.astype(np.uint32), stops, end_id))
            counts.append(n + 1)
            names += batch.column(0).to_pylist()
            held += int(n.sum()) + len(n)
            if held >= BLOCK_TOKENS:
                yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    rows.mapInArrow(run, BLOCKS).write.parquet(path)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(len(batch)):
            block = Block(batch.column(2)[k].as_py())
            ids = block.all().astype("<u4")
            stops = np.cumsum(block.counts)
            view = memoryview(ids).cast("B")
            sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip((stops - block.counts).tolist(), stops.tolist(), strict=True)]
            n = len(sums)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * n)), pa.array(batch.column(1)[k].as_py() + stops - block.counts), pa.array(block.doc_ids, pa.int64()), pa.array(block.counts), pa.array(sums, pa.int64())], ["part", "first", "doc_id", "n_tokens", "ids_crc32"])


def block_index(spark: SparkSession, path: str) -> DataFrame:
    """part, block, start (ids of all blocks before it). Blocks are few: their sizes alone are summed, first within parts."""
    sizes = spark.read.schema(BLOCKS).parquet(path).select("part", "block", "tokens")
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("ahead", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    return sizes.join(parts, F.col("part") == F.col("of")).select("part", "block", (F.col("base") + F.col("ahead")).alias("start"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    index = block_index(spark, path).select(F.col("part").alias("p"), F.col("block").alias("b"), "start")
    placed = blocks.join(index, (F.col("part") == F.col("p")) & (F.col("block") == F.col("b"))).select("part", "start", "payload")
    rows = placed.mapInArrow(_decoded, DECODED)
    return rows.select("doc_id", F.col("first").alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Writes the files into the shared folder and returns what reading them back gives."""
    path = new_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, vocabulary, end_id)
    return read_token_files(docs.sparkSession, path)
