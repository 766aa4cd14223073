"""Connected components of a graph given as an edge table, without collecting it anywhere.

Alternating stars: in each round every node's larger neighbours, then all of its smaller ones, are tied to the smallest
node that it knows. A union-find inside each partition first turns dense edges into stars, so hubs arrive pre-aggregated.
Each round is a table in the shared checkpoint folder, so lineage stays short and lost executors cost one round.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import trimmed

PART_EDGES = 1 << 20
#: A node of more edges than HUB_ROWS, and than one in HUBS of all, is a hub.
HUB_ROWS = 256
HUBS = 4096


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only a session whose executors are this very process may do without
    that setting, and gets a temporary folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Spark removes the shuffle files of a query when it ends, if this is set; what is written to a table needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def _path(spark: SparkSession, name: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: computed once, as a table in the shared folder, which goes when the application ends."""
    spark = df.sparkSession
    name = f"{checkpoint_dir(spark)}/graphloom-{uuid.uuid4().hex}"
    with released(spark):
        df.select("*").write.parquet(name)
    remove_at_end(spark, name)
    out = spark.read.schema(df.schema).parquet(name)
    out._graphloom_table = name
    return out


def remove_at_end(spark: SparkSession, name: str) -> None:
    path, fs = _path(spark, name)
    fs.deleteOnExit(path)


def remove(spark: SparkSession, name: str) -> None:
    path, fs = _path(spark, name)
    fs.delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Removes tables of cut() that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t._graphloom_table)


def union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges and each one's smallest connected node."""
    nodes, both = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(nxt := new[new], new):
            new = nxt
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def contracted(edges: DataFrame) -> DataFrame:
    """The same components in fewer edges (a, b), a > b: a star for each component of a chunk of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        n = 0

        def out() -> pa.RecordBatch:
            node, root = union(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            ok = node != root
            return pa.RecordBatch.from_arrays([pa.array(node[ok]), pa.array(root[ok])], names=["a", "b"])

        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)])
            n += batch.num_rows
            if n >= PART_EDGES:
                got = out()
                yield got
                # the stars stay for the next chunk while they are few
                held, n = ([[got.column(0).to_numpy(), got.column(1).to_numpy()]], got.num_rows) if got.num_rows < PART_EDGES // 2 else ([], 0)
        if n:
            yield out()

    return edges.select("a", "b").mapInArrow(trimmed(run), "a long, b long")


def with_least(rows: DataFrame, n: int) -> DataFrame:
    """a, b, m: rows with the smallest b of their a. n: about the number of rows. An a of very many rows gets its m by
    broadcast, where its rows are: there are at most 2 * `HUBS` such."""
    least = rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(least.filter(F.col("n") > max(HUB_ROWS, n // HUBS)).select("a", F.col("m").alias("hub")))
    marked = rows.join(hubs, "a", "left")
    rest = marked.filter("hub is null").select("a", "b").join(least.filter(F.col("n") <= max(HUB_ROWS, n // HUBS)).select("a", "m"), "a")
    return rest.union(marked.filter("hub is not null").select("a", "b", F.col("hub").alias("m")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component: the smallest node reachable, for each node of an edge (a, b) with a != b. Loops and null ends are
    left out, and so are nodes without an edge. Repeated edges count once."""
    e = cut(contracted(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")).distinct())
    last, n = None, e.count()
    for _ in range(max_rounds):
        # large star: the larger neighbours of u go to the smallest of u and its neighbours
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, n).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).filter("a <> b").distinct()
        # small star: u and its smaller neighbours, which are few, as stars come from whole partitions, go to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
        new = cut(small)
        told = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        n = told[0]
        drop(e)
        e = new
        if told == last:
            break
        last = told
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
