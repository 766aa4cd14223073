"""Prefix doubling in its plain form: every position of every text is sorted in each round.

Positions start with their first 8 bytes as rank. In each round a position is paired with the one `size` bytes further on, the
pairs of ranks are sorted and numbered anew, so a position's rank stands for the order of twice as many bytes (at the end of 50);
positions whose string no second document has are unique and drop out. The result is that of `suffixes.repeated`, which is what
`op1_suffix_dedup` uses: this form shuffles each byte of the corpus as a row of 40 bytes and more (figures in the README), that
one only a sample of them. Tests hold the two against each other.

Null and empty texts, null doc_ids, copies and empty tables are treated as `suffixes` says.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Block, map_blocks
from .components import cut, drop
from .suffixes import LENGTH, PLACE, _keyed, column

FIRST = 8


def _positions(block: Block) -> pa.RecordBatch | None:
    """doc_id, row, at (byte, and the tag below it) and the first 8 bytes, in their order, of each position that has them."""
    n = np.maximum(block.sizes - FIRST + 1, 0)
    if not n.sum():
        return None
    text = np.repeat(np.arange(block.n), n)
    first = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    place = block.off[text] + first
    rank = np.zeros(len(text), np.uint64)
    for k in range(FIRST):
        rank = rank << np.uint64(8) | block.buf[place + k]
    take = pa.array(text)
    at = (first << 32) | column(block, "tag").to_numpy()[text]
    return pa.RecordBatch.from_arrays([column(block, "doc_id").take(take), column(block, "row").take(take), pa.array(at), pa.array((rank ^ np.uint64(1 << 63)).view(np.int64))], names=["doc_id", "row", "at", "a"])


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, row, tag, starts: set of (first string, 1) to remove, of the texts that have some."""
    ranked = map_blocks(_keyed(docs), _positions, f"{PLACE}, a long").withColumn("b", F.lit(0).cast("long"))
    size, tables = FIRST, []
    while True:
        pairs = cut(ranked)
        # the order of the pairs is the order of the strings; what one document alone has is unique
        groups = pairs.groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").orderBy("a", "b")
        ranks = cut(groups.select("a", "b", "least", F.monotonically_increasing_id().alias("rank")))
        tables += [pairs, ranks]
        now = pairs.join(ranks, ["a", "b"]).select("doc_id", "row", "at", F.col("rank").alias("a"), "least")
        if size == LENGTH:
            break
        step = min(size, LENGTH - size)
        behind = now.select("doc_id", "row", (F.col("at") - (step << 32)).alias("at"), F.col("a").alias("b"))
        ranked = now.drop("least").join(behind, ["doc_id", "row", "at"])
        size += step
    gone = now.filter("doc_id > least").groupBy("doc_id", "row", F.col("at").bitwiseAND(0xFFFFFFFF).alias("tag"))
    out = cut(gone.agg(F.collect_set(F.struct(F.shiftright("at", 32).alias("start"), F.lit(1).alias("size"))).alias("starts")))
    drop(*tables)
    return out
