"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Texts are lower-cased (A-Z) and cut into words at white space; the 3-word shingles, repeats included, vote with their
XXH64 (seed 42). Fingerprints link at `RADIUS` = 3 or fewer differing bits.

The 64 bits are cut into three blocks. Two fingerprints at distance 3 or less differ, for some block, in at most one bit
inside it and two outside; or all three differing bits are in one block. So for each block a fingerprint emits the variants
of the other bits within half the radius (itself and each single flip), 132 rows in all, and rows meet on a variant. Inside
such a bucket everything is within one flip of the middle, so members that also agree on the block but for one given bit are
linked whatever their number: a star to the smallest, never all pairs. Members that share all bits outside the block meet
in the same way through flips inside it. Every link is verified by its distance before it counts.

Equal fingerprints are one class before any of this, so copies never meet in a bucket.

Results: one row per row of the input. A null text is empty; a text without words has fingerprint zero and links like any
other. Repeated rows stay repeated and share a class. Rows with a null doc_id have a null component and link nothing.
No rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, SOLID, Block, map_blocks, trimmed, words
from .components import components, cut

RADIUS = 3
SEED = 42
SHINGLE = 3
#: First bit and width of each block.
PARTS = ((0, 22), (22, 21), (43, 21))
U64 = np.uint64



def joined(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The block's words, lower-cased and with one space between; starts and ends there, and text numbers."""
    starts, ends, doc = words(block, SOLID)
    keep = SOLID[block.buf]
    keep[ends[ends < len(keep)]] = True  # the byte behind a word stands for the space, if there is one
    if not len(starts):
        return block.buf[:0], starts, ends, doc
    low = LOWER[block.buf]
    low[~SOLID[block.buf]] = 32
    # texts that meet without white space keep their places: the offsets below count what is kept
    at = np.concatenate(([0], np.cumsum(keep)))
    return low[keep], at[starts], at[ends], doc


def fingerprints(block: Block) -> np.ndarray:
    buf, starts, ends, doc = joined(block)
    n = np.bincount(doc, minlength=block.n)
    # a shingle begins at each word that has two more of its text behind it, or at the first of a shorter text
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    place = np.arange(len(starts)) - first[doc]
    short = np.minimum(n, SHINGLE)
    ok = place + short[doc] <= n[doc]
    ok &= (n[doc] >= SHINGLE) | (place == 0)
    a = starts[ok]
    b = ends[np.flatnonzero(ok) + short[doc[ok]] - 1]
    view, digest = memoryview(buf.tobytes()), xxhash.xxh64_intdigest
    h = np.fromiter((digest(view[x:y], SEED) for x, y in zip(a.tolist(), b.tolist(), strict=True)), np.uint64, len(a))
    out = np.zeros(block.n, np.uint64)
    d = doc[ok]
    if len(h):
        cuts = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        size = np.diff(np.append(cuts, len(d)))
        votes = np.zeros((len(cuts), 64), np.int64)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for i, (x, k) in enumerate(zip(cuts.tolist(), size.tolist(), strict=True)):
            votes[i] = bits[x : x + k].sum(0, dtype=np.int32)
        on = (votes * 2 > size[:, None]).astype(np.uint8)
        out[d[cuts]] = np.packbits(on, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def kernel(block: Block) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([block.rows.column(0), pa.array(fingerprints(block).view(np.int64))], names=["doc_id", "fp"])

    return map_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, "doc_id long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """key, fp: the key holds the block's number and the other bits, as they are or with one flipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for z in range(0, batch.num_rows, 20_000):
                fp = batch.column(0).slice(z, 20_000).to_numpy().view(np.uint64)
                for k, (at, width) in enumerate(PARTS):
                    low = fp & U64((1 << at) - 1)
                    rest = low | ((fp >> U64(at + width)) << U64(at))  # the other bits, closed up
                    flips = np.concatenate((np.zeros(1, np.uint64), U64(1) << np.arange(64 - width, dtype=np.uint64)))
                    key = (rest[:, None] ^ flips[None, :]) | (U64(k + 1) << U64(62))
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(fp, len(flips)).view(np.int64))], names=["key", "fp"])

    return fps.select("fp").mapInArrow(trimmed(run), "key long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def stars(group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint with the smallest of its group."""
    at = np.lexsort((fp, *group.T[::-1])) if group.ndim > 1 else np.lexsort((fp, group))
    g, f = group[at], fp[at]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]).any(1) if g.ndim > 1 else g[1:] != g[:-1]
    head = f[np.flatnonzero(new)[np.cumsum(new) - 1]]
    ok = ~new & (f != head)
    return f[ok], head[ok]


def bucket_links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside whole buckets, given together."""
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]

    def add(x: np.ndarray, y: np.ndarray) -> None:
        ok = distance(x, y) <= RADIUS
        a.append(x[ok])
        b.append(y[ok])

    for k, (at, width) in enumerate(PARTS):
        on = np.flatnonzero(key >> U64(62) == k + 1)
        if not len(on):
            continue
        ks, fs = key[on], fp[on]
        block = (fs >> U64(at)) & U64((1 << width) - 1)
        for j in range(width):  # agreeing on the block but for bit j
            add(*stars(np.stack((ks, block & ~(U64(1) << U64(j))), 1), fs))
        # three bits inside the block: the bucket that is theirs unflipped, met at one flip from one and two from the other
        rest = (fs & U64((1 << at) - 1)) | ((fs >> U64(at + width)) << U64(at))
        own = np.flatnonzero((ks & U64((1 << 62) - 1)) == rest)
        own = own[np.argsort(ks[own], kind="stable")]
        kk = ks[own]
        edge = np.flatnonzero(np.concatenate(([True], kk[1:] != kk[:-1], [True])) if len(kk) else np.zeros(0, bool))
        for x, y in zip(edge[:-1], edge[1:], strict=True):
            if y - x > 1:
                add(*inside(fs[own[x:y]], at, width))
    return np.concatenate(a), np.concatenate(b)


def inside(fs: np.ndarray, at: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Links at distance 3 between fingerprints that differ in one block only: x with one bit flipped is y with two flipped."""
    one = U64(1) << np.arange(at, at + width, dtype=np.uint64)
    i, j = np.triu_indices(width, 1)
    two = one[i] | one[j]
    x = (fs[:, None] ^ one).ravel()
    at_x = np.argsort(x)
    found_a, found_b = [], []
    for z in range(0, len(fs), 2000):
        part = fs[z : z + 2000]
        y = (part[:, None] ^ two).ravel()
        lo = np.searchsorted(x[at_x], y)
        hit = np.flatnonzero((lo < len(x)) & (x[at_x[np.minimum(lo, len(x) - 1)]] == y))
        # any two x of one middle are within two bits of each other and already linked, so one of them is enough
        found_a.append(part[hit // len(two)])
        found_b.append(fs[at_x[lo[hit]] // width])
    return np.concatenate(found_a), np.concatenate(found_b)


def links(fps: DataFrame) -> DataFrame:
    """a, b: verified links that connect what the distinct fingerprints fp within the radius connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_k, hold_f = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

        def out(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            same = np.zeros(len(key) + 1, bool)
            same[1:-1] = key[1:] == key[:-1]
            ok = same[1:] | same[:-1]  # not alone in the bucket
            a, b = bucket_links(key[ok], fp[ok])
            pair = np.unique(np.stack((a, b), 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, i]).view(np.int64)) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            key = np.concatenate((hold_k, batch.column(0).to_numpy().view(np.uint64)))
            fp = np.concatenate((hold_f, batch.column(1).to_numpy().view(np.uint64)))
            n = int(np.searchsorted(key.view(np.int64), key.view(np.int64)[-1])) if len(key) else 0  # the last bucket may go on
            if n:
                yield out(key[:n], fp[:n])
            hold_k, hold_f = key[n:], fp[n:]
        if len(hold_k):
            yield out(hold_k, hold_f)

    v = variants(fps)
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return v.repartition(n, "key").sortWithinPartitions("key").mapInArrow(trimmed(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links reach."""
    fp = cut(fingerprint(docs))
    groups = cut(fp.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")))
    reached = components(links(groups)).withColumnRenamed("node", "fp")
    named = groups.join(reached, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = named.join(least, "component").select("fp", "component_id")
    return fp.join(ids, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is not the smallest of its class. Repeated rows of a kept doc_id stay, and so do
    rows without a doc_id."""
    gone = near_duplicates(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
