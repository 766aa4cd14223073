"""Embedding near-duplicates with a pivot-permutation index.

Each vector is described by its `NEAREST` = 8 nearest reference vectors (pivots), in order. Inverted lists of the pivots bring
together the vectors that share one; pairs that share `SHARED` = 3 or more pivots are verified by their cosine, in double
precision, and link at `COSINE` or more. Against brute force the recall of pairs right at the threshold is about 0.99, and
higher above it (a test measures it).

Pivots are a sample drawn by hash, one for each 32 vectors, `MIN_PIVOTS` to `MAX_PIVOTS` of them: that bounds what is
broadcast (4 MB for 64 dimensions). All vectors are indexed. A list longer than `LIST` is split by the second shared pivot,
which loses nothing as SHARED is more than one, and what is still longer is cut into shards of which each two meet, so no
task holds an unbounded list and no pair is dropped. A pair counts in the list of its smallest shared pivots only.

Equal vectors are one class and are never paired. Links between classes leave a list as counts and as the edges of a
spanning forest, so what is written is in proportion to the vectors.

Results: one row per input row. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing:
n_links 0, component_id = vec_id. Shorter vectors are filled up with zeros. A row with a null vec_id links with nothing and
has a null component_id and kept. Repeated rows are vectors of their own. Columns other than vec_id and embedding are
ignored. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import trimmed
from .components import components, cut, union

COSINE = 0.95
NEAREST = 8
SHARED = 3
MIN_PIVOTS, MAX_PIVOTS = 16, 8192
LIST = 4096
STEP = 1024
PIVOT_BYTES = 32 << 20


def nearest_of(pivots: int) -> int:
    """How many nearest pivots describe a vector. The more pivots, the smaller the regions in which the nearest ones are the
    same for two vectors of cosine 0.95."""
    return NEAREST + max(0, (max(1, pivots) // 512).bit_length() - 1)


def matrix(col: pa.Array, width: int, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows of one width, and which rows are valid."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().cast(pa.from_numpy_dtype(kind))
    bad = np.asarray(flat.is_null())
    values = flat.fill_null(0).to_numpy(zero_copy_only=False)
    bad = bad | ~np.isfinite(values)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
    x = np.zeros((len(n), width), kind)
    x[row[~bad], place[~bad]] = values[~bad]
    ok = np.bincount(row, weights=bad, minlength=len(n)) == 0
    return x, ok & (np.abs(x).max(1, initial=0) > 0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    x = x.astype(np.float64)
    top = np.abs(x).max(1, initial=0)
    x /= np.where(top > 0, top, 1)[:, None]  # large components do not overflow when squared
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]


def nearest(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """Numbers of each row's k nearest pivots, the nearest first; the smaller number wins ties."""
    out = np.empty((len(x), k), np.int32)
    for a in range(0, len(x), 2048):
        s = x[a : a + 2048] @ pivots.T
        out[a : a + 2048] = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return out


def pairs_of(node: np.ndarray, perm: np.ndarray, vec: np.ndarray, first: slice, second: slice, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs, from the members in first and second, that belong to the list (p, q)."""
    low = vec.astype(np.float32)
    left, right = [], []
    for a in range(first.start, first.stop, STEP):
        ai = np.arange(a, min(first.stop, a + STEP))
        for b in range(second.start if second.start >= first.stop else a, second.stop, STEP):
            bi = np.arange(b, min(second.stop, b + STEP))
            i, j = np.nonzero(low[ai] @ low[bi].T >= COSINE - 1e-4)
            i, j = ai[i], bi[j]
            on = i < j
            i, j = i[on], j[on]
            for z in range(0, len(i), 1 << 16):
                x, y = i[z : z + (1 << 16)], j[z : z + (1 << 16)]
                same = (perm[x][:, :, None] == perm[y][:, None, :]).any(2)
                on = same.sum(1) >= min(SHARED, perm.shape[1])
                held = np.sort(np.where(same, perm[x], np.iinfo(np.int32).max), axis=1)
                on &= held[:, 0] == p
                if q >= 0:
                    on &= held[:, 1] == q
                x, y = x[on], y[on]
                on = np.einsum("ij,ij->i", vec[x], vec[y]) >= COSINE
                left.append(x[on])
                right.append(y[on])
    return np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])


def index(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (node, embedding, size, least) and what the lists give: (kind, a, b), kind 0 counts links, 1 is an edge."""
    spark = vectors.sparkSession
    known = vectors.filter(valid()).groupBy("embedding").agg(F.count("*").alias("size"), F.min("vec_id").alias("least"))
    classes = cut(known.withColumn("node", F.monotonically_increasing_id()))
    n, width = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    width = max(1, width or 1)
    kind = np.float32 if dict(vectors.dtypes)["embedding"] == "array<float>" else np.float64
    want = min(MAX_PIVOTS, PIVOT_BYTES // (8 * width), max(MIN_PIVOTS, 1 << (max(1, n // 32)).bit_length() - 1))
    rows = classes.select("embedding", F.xxhash64("embedding").alias("draw")).orderBy("draw").limit(want).select("embedding").toArrow().column(0)
    pivots = unit(matrix(rows, width, kind)[0]) if len(rows) else np.zeros((0, width))
    k = min(nearest_of(len(pivots)), len(pivots))
    shared = spark.sparkContext.broadcast(pivots)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for z in range(0, batch.num_rows, 2048):
                b = batch.slice(z, 2048)
                x, ok = matrix(b.column(2), width, kind)
                on = np.flatnonzero(ok)
                if len(on) and k:
                    perm = nearest(unit(x[on]), shared.value, k)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(on)), b.column(1).take(pa.array(on)), pa.array([r.tobytes() for r in perm], pa.binary()), pa.array([r.tobytes() for r in x[on]], pa.binary())],
                        names=["node", "size", "perm", "vec"],
                    )

    described = cut(classes.select("node", "size", "embedding").mapInArrow(trimmed(describe), "node long, size long, perm binary, vec binary"))

    def post(long: frozenset[int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                perm = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int32).reshape(-1, k)
                at, p, q = [], [], []
                for i, row in enumerate(perm.tolist()):
                    for x in row:
                        if x not in long:
                            at.append(i), p.append(x), q.append(-1)
                        else:
                            for y in row:
                                if y > x:  # x and y are a pair's two smallest shared pivots, in this order
                                    at.append(i), p.append(x), q.append(y)
                take = pa.array(at, pa.int64())
                key = (np.array(p, np.int64) << 32) | (np.array(q, np.int64) + 1)
                yield pa.RecordBatch.from_arrays([pa.array(key), *(b.column(c).take(take) for c in range(4))], names=["key", "node", "size", "perm", "vec"])

        return run

    counted = described.select("perm").mapInArrow(trimmed(_pivots_of(k)), "p int").groupBy("p").agg(F.count("*").alias("n")).filter(F.col("n") > LIST)
    long = frozenset(r["p"] for r in counted.collect())  # MAX_PIVOTS rows at most
    posted = described.mapInArrow(trimmed(post(long)), "key long, node long, size long, perm binary, vec binary")
    if long:
        # what the second pivot leaves too long is cut into shards; each two shards meet once
        over = posted.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > LIST).select("key", F.ceil(F.col("n") / LIST).cast("int").alias("shards"))
        own = F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")
        to = F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
        posted = posted.join(over, "key", "left").withColumn("shards", F.coalesce("shards", F.lit(1))).withColumn("own", own).withColumn("to", F.explode(to)).select("key", F.col("to.i").alias("i"), F.col("to.j").alias("j"), "own", "node", "size", "perm", "vec")
    else:
        posted = posted.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own"), "node", "size", "perm", "vec")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def out() -> pa.RecordBatch | None:
            t = pa.Table.from_batches(held).combine_chunks()
            if t.num_rows < 2:
                return None
            key, i, j, own, node, size = (t.column(c).to_numpy() for c in range(6))
            perm = np.frombuffer(b"".join(t.column(6).to_pylist()), np.int32).reshape(len(node), -1)
            vec = unit(np.frombuffer(b"".join(t.column(7).to_pylist()), kind).reshape(len(node), -1))
            at = np.argsort(own, kind="stable")
            node, size, perm, vec, own = node[at], size[at], perm[at], vec[at], own[at]
            p, q = int(key[0] >> 32), int(key[0] & 0xFFFFFFFF) - 1
            if i[0] == j[0]:
                a, b = pairs_of(node, perm, vec, slice(0, len(node)), slice(0, len(node)), p, q)
            else:
                m = int(np.searchsorted(own, j[0]))
                a, b = pairs_of(node, perm, vec, slice(0, m), slice(m, len(node)), p, q)
            if not len(a):
                return None
            links = np.bincount(a, weights=size[b], minlength=len(node)) + np.bincount(b, weights=size[a], minlength=len(node))
            on = np.flatnonzero(links)
            x, root = union(node[a], node[b])
            tree = x != root
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([0, 1], np.int32), [len(on), tree.sum()])), pa.array(np.concatenate((node[on], x[tree]))), pa.array(np.concatenate((links[on].astype(np.int64), root[tree])))], names=["kind", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            run = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)], 1)
            edges = [0, *(np.flatnonzero((run[1:] != run[:-1]).any(1)) + 1).tolist(), len(run)]
            for x, y in zip(edges, edges[1:], strict=False):
                if now is not None and now != tuple(run[x]) and held:
                    if (got := out()) is not None:
                        yield got
                    held.clear()
                now = tuple(run[x])
                held.append(batch.slice(x, y - x))
        if held and (got := out()) is not None:
            yield got

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = posted.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(trimmed(verify), "kind int, a long, b long")
    return classes, cut(found)


def _pivots_of(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32))], names=["p"])

    return run


def valid() -> Column:
    """Of rows that may link: with a vec_id, and a vector of finite components that are not all zero."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists("embedding", odd) & F.exists("embedding", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    classes, found = index(v)
    links = found.filter("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    named = classes.select("node", "embedding", "size", "least").join(links, "node", "left").join(components(found.filter("kind = 1").select("a", "b")), "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("first"))
    named = cut(named.join(least, "component").select("embedding", "size", F.coalesce("links", F.lit(0)).alias("links"), "first"))
    # only valid vectors look for their class, so rows without one do not meet on a null key
    told = v.withColumn("valid", valid())
    out = told.filter("valid").join(named, "embedding").select("vec_id", (F.col("size") - 1 + F.col("links")).alias("n_links"), F.col("first").alias("component_id"))
    rest = told.filter("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
