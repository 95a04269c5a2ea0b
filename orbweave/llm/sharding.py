"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

1. Rows fall into cells by a seeded hash of their id, size and checksum, so that rows of one id, or without one,
   spread; more than HOT rows that are equal in all three also spread, by their place in a stored table.
2. For each cell in turn, how many of its rows each shard gets is drawn from the multivariate
   hypergeometric distribution of the places left, so shard sizes come out exactly (at most one apart).
   The matrix has cells x shards entries: MAX_CELLS bounds it, whatever the number of rows.
3. Within a cell rows are permuted by a seeded hash; the matrix row tells which go where.
4. Rows are exchanged and permuted again within their shard: a second seeded hash deals them to
   blocks and orders them; block sizes, again a bounded table, give each block its first slot.

The draw depends on ids, texts, counts and the seed alone, not on partitions or task order (but for those equal
rows, whose places are fixed when they are stored), so a rerun task makes the same rows.

Defined results: null ids and null texts (size 1, crc32 of nothing: 0) are rows like others; ids may be of any type;
equal rows are dealt apart as they come; an empty table gives an empty table; columns named as an output, in any
case, are replaced.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm.common import col, free_names, others, stored

ROWS_A_CELL, MIN_CELLS, MAX_CELLS = 100_000, 256, 65_536
HOT = 10_000
OUTPUTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of drawn rows are good. numpy's sampler below its limit of 1e9; beyond, the inverse of the distribution, whose weights follow from one another outwards from the mode (to the rounding of doubles; what is left out has less than 1e-30 of the mode's weight)."""
    if not drawn or not good or not bad or good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, drawn)) if drawn and good and bad else min(drawn, good)
    low, high = max(0, drawn - bad), min(drawn, good)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))

    def outwards(ratio, most: int) -> np.ndarray:
        """Logarithms of the weights beside the mode, step by step, until they don't matter."""
        parts, last, done = [], 0.0, 0
        while done < most and last > -70:
            k = np.arange(done, min(most, done + 4096), dtype=np.float64)
            parts.append(last + np.cumsum(np.log(ratio(k))))
            last, done = parts[-1][-1], done + len(k)
        return np.concatenate(parts) if parts else np.zeros(0)

    up = outwards(lambda k: (good - mode - k) / (mode + k + 1) * ((drawn - mode - k) / (bad - drawn + mode + k + 1)), high - mode)
    down = outwards(lambda k: (mode - k) / (good - mode + k + 1) * ((bad - drawn + mode - k) / (drawn - mode + k + 1)), mode - low)
    weight = np.exp(np.concatenate([down[::-1], [0.0], up]))
    return mode - len(down) + int(np.searchsorted(np.cumsum(weight), rng.random() * weight.sum(), side="right"))


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """cells x shards: how many rows go from each cell to each shard."""
    rng = np.random.default_rng(seed)
    total = sum(counts)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    rows = np.zeros((len(counts), shards), dtype=np.int64)
    for c, n in enumerate(counts):
        rest = sum(left)
        for s in range(shards):
            rest -= left[s]
            k = hypergeometric(rng, left[s], rest, n) if s < shards - 1 else n
            rows[c, s], n, left[s] = k, n - k, left[s] - k
    return rows


def shard(docs: DataFrame, shards: int = 16, seed: int = 1, doc_id: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with size, text_crc32, law ('rows'), shard, slot and grown_shard (null: the law isn't 'key')."""
    spark = docs.sparkSession
    kept = [c for c in others(docs, *OUTPUTS) if keep_text or c != text_col]
    key, own_cell, salt, first_key, second_key, at, upto, block, base, place = free_names([*docs.columns, *OUTPUTS], "key", "cell", "salt", "a", "b", "at", "upto", "block", "first", "place")
    size = F.coalesce(F.octet_length(col(text_col)), F.lit(0)).cast("long") + 1
    crc = F.coalesce(F.crc32(col(text_col).cast("binary")), F.lit(0)).cast("long")
    rows = docs.select(*map(col, kept), F.xxhash64(col(doc_id)).alias(key), size.alias("size"), crc.alias("text_crc32"))
    counted = rows.groupBy(key, "size", "text_crc32").count().agg(F.sum("count"), F.max("count")).first()
    total, most = counted[0] or 0, counted[1] or 0
    if most > HOT:  # rows that nothing tells apart are dealt by their place; a stored table fixes it
        rows = stored(rows.withColumn(salt, F.monotonically_increasing_id()), "salted")
    else:
        rows = rows.withColumn(salt, F.lit(0).cast("long"))
    n_cells = min(MAX_CELLS, max(MIN_CELLS, math.ceil(total / ROWS_A_CELL)))
    named = [key, "text_crc32", "size", salt]
    cell = F.pmod(F.xxhash64(F.lit(seed), *named), F.lit(n_cells)).cast("int")
    counts = sorted(map(tuple, rows.select(cell.alias("c")).groupBy("c").count().collect()))
    matrix = communication_matrix([n for _, n in counts], shards, seed)
    bounds = spark.createDataFrame([(c, [int(x) for x in row]) for (c, _), row in zip(counts, np.cumsum(matrix, axis=1), strict=True)], f"{own_cell} int, {upto} array<bigint>")
    rows = rows.withColumns({own_cell: cell, first_key: F.xxhash64(F.lit(seed + 1), *named), second_key: F.xxhash64(F.lit(seed + 2), *named)})
    dealt = rows.withColumn(at, F.row_number().over(Window.partitionBy(own_cell).orderBy(first_key, *named)) - 1).join(F.broadcast(bounds), own_cell)
    dealt = dealt.withColumn("shard", F.expr(f"size(filter({upto}, x -> x <= {at}))")).drop(upto, at, own_cell, first_key)
    blocks = min(MAX_CELLS // shards, max(16, math.ceil(total / shards / ROWS_A_CELL)))
    dealt = dealt.withColumn(block, (F.shiftrightunsigned(second_key, 40) * blocks / F.lit(2**24)).cast("int"))
    per_block = dealt.groupBy("shard", block).count()
    first = per_block.withColumn(base, F.sum("count").over(Window.partitionBy("shard").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)))
    order = F.row_number().over(Window.partitionBy("shard", block).orderBy(second_key, *named)) - 1
    placed = dealt.withColumn(place, order).join(F.broadcast(first.drop("count")), ["shard", block])
    slot = (F.coalesce(base, F.lit(0)) + F.col(place)).cast("long")
    return placed.select(*map(col, kept), "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
