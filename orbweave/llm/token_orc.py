"""Token ids as ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are encoded, range-partitioned by id at quantiles of all ids (an id-only scan), sorted by id, number of
ids and checksum, and written as one ORC file a range, in ascending order of id and file name. An id with more rows
than a range holds is several quantiles; its rows are dealt to all of their ranges, by checksum and count, so that
a rerun deals alike. The number of files follows the bytes of the input (FILE_BYTES of it a file, MAX_FILES at
most), and is twice that of the cores where that is less. Stripes can be read in parallel; a lookup of an id prunes files by their statistics, row groups by the row
index and, within these, by Bloom filters. Only ids move in the shuffle. A lost task is rerun from its input; the
write commits by file.

Defined results: a null text is an empty document, which has the end id alone; null ids come first; rows of
one id stand side by side (in one file but for the most frequent), and their starts follow the files' order; an
empty table gives an empty result; other columns of the input, whatever their names, are left out.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.llm.common import input_bytes, small_batches, trim
from orbweave.llm.encoder import encoder, sliced

ORC = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20)}
FILE_SCHEMA = "part int, doc_id long, n_tokens int, ids_crc32 long, ids array<int>"
FILE_BYTES, MAX_FILES = 64 << 20, 100_000
ORDER = ("doc_id", "n_tokens", "ids_crc32")


def _checksums(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    data = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
    return pa.array([zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(offsets.tolist(), offsets[1:].tolist())], pa.int64())


def write_orc(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text_col: str = "text", files: int | None = None) -> None:
    """Writes (part, doc_id, n_tokens, ids_crc32, ids) to path; files: how many ranges of ids."""
    spark = small_batches(docs.sparkSession)
    given = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    n = files or min(MAX_FILES, max(2 * spark.sparkContext.defaultParallelism, math.ceil(input_bytes(docs) / FILE_BYTES)))
    least = int(np.iinfo(np.int64).min)  # null ids come first
    quantiles = F.percentile_approx(F.coalesce("doc_id", F.lit(least)), F.lit([i / n for i in range(1, n)]), F.lit(max(10_000, 20 * n))) if n > 1 else F.lit(None).cast("array<long>")
    bounds = np.array(given.select(quantiles.alias("q")).first()["q"] or [], dtype=np.int64)

    def encode(batches):
        enc = encoder(tokenizer)
        turns: dict[tuple[int, int], int] = {}  # how many rows of a frequent id and a checksum the task has dealt
        for whole in batches:
            for batch in sliced(whole, "text", 4 << 20):
                ids, counts = enc.encode(batch.column("text"))
                upto = np.cumsum(counts)
                ids = np.insert(ids, upto, end_id).astype(np.int32)
                offsets = np.concatenate([[0], upto + np.arange(1, len(upto) + 1)]).astype(np.int32)
                key = batch.column("doc_id")
                number = np.asarray(key.fill_null(least))
                part, upper = (np.searchsorted(bounds, number, side=x) for x in ("left", "right"))
                crc = _checksums(ids, offsets)
                for i in np.flatnonzero(upper - part > 1).tolist():
                    row = (int(number[i]), crc[i].as_py())
                    turns[row] = turn = turns.get(row, -1) + 1
                    part[i] += (row[1] + turn) % (upper[i] - part[i])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), key, pa.array((counts + 1).astype(np.int32)), crc, lists], names=["part", "doc_id", "n_tokens", "ids_crc32", "ids"])
        trim()

    given.mapInArrow(encode, FILE_SCHEMA).repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions(*ORDER).write.options(**ORC).orc(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids before the document in the whole corpus), n_tokens, ids_crc32 (of its ids as little-endian 32-bit integers). Both figures are taken from the ids that are read back."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)

    def digest(batches):
        for b in batches:
            lists = b.column("ids")
            off = np.asarray(lists.offsets).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("doc_id"), pa.array(np.diff(off)), _checksums(np.asarray(lists.values), off)], names=["part", "doc_id", "n_tokens", "ids_crc32"])

    totals, base = [], 0
    for part, count in sorted(rows.groupBy("part").agg(F.sum("n_tokens")).collect()):  # one row a file
        totals.append((part, base))
        base += count
    first = spark.createDataFrame(totals, "part int, base long")
    # rows that are equal in all of ORDER have the same ids, so their order doesn't matter
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = small_batches(spark) and rows.select("part", "doc_id", "ids").mapInArrow(digest, "part int, doc_id long, n_tokens long, ids_crc32 long")
    return found.withColumn("before", before).join(F.broadcast(first), "part").select("doc_id", (F.col("base") + F.col("before")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The rows of some documents; the filter reaches the files' statistics, row indexes and Bloom filters."""
    return spark.read.schema(FILE_SCHEMA).orc(path).filter(F.col("doc_id").isin(ids))
