"""Substring deduplication by distributed prefix doubling over a sample of positions.

Every byte covered by a string of `LENGTH` = 50 bytes that also starts in a document with a smaller doc_id is removed. Ranks are
names here (only the equality of strings counts, not their order): the name of 40 bytes at i is made of the 20-byte names at i
and i + 20, the name of 50 bytes of the 40-byte names at i and i + 10. The plain form of the method, with a sort of every
position in each round, is in `doubling`; this one sorts (name, position) rows in two rounds, drops what is unique between them,
and takes the steps from 20 to 50 bytes inside the kernel:

1. Round of 20 bytes, at the positions that matter: every 50-byte string is represented by the smallest 20-byte name in it
   (about one position in sixteen is one). A string that repeats has a representative that repeats, so documents keep only
   the representatives that occur in two documents.
2. Neighbouring strings with one representative form a segment (16 strings on average). Equal segments meet, and all
   but those of the smallest document are settled at once, as one row for all their strings. Where all segments of a
   representative are equal, nothing is left.
3. Round of 50 bytes: the strings of the other segments meet by their 50-byte names, inside the rows of their representative
   where those have `STRINGS` strings or fewer, and else one by one through a shuffle of their own.

Names are 64 bits in round 1, where a false meeting only costs work, and 128 (segments) and 80 (strings) bits after that.

Skew: rows of a name that a worker sees in several documents are settled where they are, and only one of them travels with
the name; the others go their own ways. So a passage in a third of all documents gives one row for each block of texts.
Rows stream through sorted runs, with one row of state; no group is held but those of at most `STRINGS` strings. Texts travel
compressed, and each step ends in a table, after which its shuffle files go.

Results: one row per input row. Null and empty texts have no bytes. A null doc_id is larger than all others. Rows with the same
doc_id are the same document, so they do not remove each other's strings, whether their texts are equal or not; they are told
apart by 96 bits of their texts. Copies of a smaller document lose all bytes if they have 50 or more. Other columns, also those
of clashing names, are ignored (`remove_repeats` keeps them). No rows give no rows. Texts of any length are treated whole.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import Block, blocks, map_blocks, mix, rolling, trimmed, unmix
from .components import cut, drop

LENGTH = 50
FIRST = 20
SEED = 1
U64 = np.uint64
LAST_ID = 2**63 - 1
#: Strings that one group may have to be settled in memory; strings of a segment (longer ones are cut, in equal places).
STRINGS = 1 << 16
SEGMENT = 4096
#: Names of FIRST bytes in a string; a segment of more strings is periodic.
WIDTH = LENGTH - FIRST + 1
HELD = 1 << 18
#: Bits of a row's tag that travel with the names of round 1.
LOW = (1 << 28) - 1


def join_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of two strings, one behind the other (or overlapping by a fixed length)."""
    return mix(a * U64(0x9E3779B97F4A7C15) + mix(b + U64(0xD6E8FEB86659FD93)))


def doubled(names: np.ndarray) -> np.ndarray:
    """Names of LENGTH bytes from names of FIRST bytes."""
    size = FIRST
    while size < LENGTH:
        step = min(size, LENGTH - size)
        names = join_names(names[:-step], names[step:]) if len(names) > step else names[:0]
        size += step
    return names


def representatives(names: np.ndarray) -> np.ndarray:
    """For each LENGTH bytes, the smallest of the names inside."""
    size = 1
    while size < WIDTH:
        step = min(size, WIDTH - size)
        names = np.minimum(names[:-step], names[step:]) if len(names) > step else names[:0]
        size += step
    return names


def segments(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Representative, text number, first string and number of strings of each segment; and the names of FIRST bytes."""
    r = rolling(SEED)
    names = r.every(r.prefix(block.buf), FIRST)
    rep = representatives(names)
    none = np.zeros(0, np.int64)
    if not len(rep):
        return names[:0], none, none, none, names
    ok = np.zeros(len(block.buf) + 1, np.int8)
    long = block.sizes >= LENGTH
    np.add.at(ok, block.off[:-1][long], 1)
    np.add.at(ok, block.off[1:][long] - LENGTH + 1, -1)
    inside = np.cumsum(ok[: len(rep)]) > 0
    new = np.ones(len(rep), bool)
    new[1:] = rep[1:] != rep[:-1]
    new[block.off[:-1][long]] = True
    new[1:] |= inside[1:] != inside[:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(rep)))
    on = inside[start]
    start, size = start[on], size[on]
    n = -(-size // SEGMENT)
    if (n > 1).any():  # long periods
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start, size = np.repeat(start, n) + k * SEGMENT, np.minimum(np.repeat(size, n) - k * SEGMENT, SEGMENT)
    return rep[start], np.searchsorted(block.off, start, "right") - 1, start, size, names


def _ids(block: Block) -> np.ndarray:
    return block.rows.column(block.rows.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)


def local_shares(key: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of one worker: which keys have several owners, and which rows stand for their key (the others need not travel)."""
    at = np.argsort(key, kind="stable")
    k, w = key[at], who[at]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    group = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    many = np.zeros(len(heads), bool)
    many[group[w != w[heads][group]]] = True
    shared, head = np.zeros(len(key), bool), np.zeros(len(key), bool)
    shared[at], head[at] = many[group], new
    return shared, head | ~shared


#: Flags of a row that looks for owners of its key: it is known to be shared; it only passes through.
SHARED, PASS = 1, 2


class Held:
    """Rows that wait for a second owner of their key: up to limit in memory, the others in a file."""

    def __init__(self, limit: int):
        self.limit = limit
        self.rows, self.n, self.file, self.sink = [], 0, None, None

    def add(self, rows: pa.RecordBatch) -> None:
        if not rows.num_rows:
            return
        self.rows.append(rows)
        self.n += rows.num_rows
        if self.n >= self.limit:
            if self.sink is None:
                self.file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
                self.sink = pa.ipc.new_stream(self.file, rows.schema)
            for r in self.rows:
                self.sink.write_batch(r)
            self.rows, self.n = [], 0

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.sink is not None:
            self.sink.close()
            self.file.seek(0)
            yield from pa.ipc.open_stream(self.file)
        yield from self.rows
        self.drop()

    def drop(self) -> None:
        if self.sink is not None:
            self.sink.close()
            self.file.close()
        self.rows, self.n, self.file, self.sink = [], 0, None, None


def shared_rows(df: DataFrame, key: str, who: str, flag: str) -> DataFrame:
    """The rows whose key has two or more owners (who), or that pass; key may have several columns, comma-separated."""
    keys = key.split(",")
    cols = df.columns
    kinds = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    limit = HELD
    at_key, at_who, at_flag = [cols.index(k) for k in keys], cols.index(who), cols.index(flag)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, shared, held = None, 0, False, Held(limit)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            k = np.stack([batch.column(i).to_numpy() for i in at_key], 1)
            w, f = batch.column(at_who).to_numpy(), batch.column(at_flag).to_numpy()
            new = np.ones(n, bool)
            new[1:] = (k[1:] != k[:-1]).any(1)
            goes_on = now is not None and tuple(k[0].tolist()) == now
            group = np.cumsum(new) - 1
            heads = np.flatnonzero(new)
            owner = w[heads]
            if goes_on:
                owner[0] = first
            many = np.zeros(len(heads), bool)
            many[group[(w != owner[group]) | (f & SHARED > 0)]] = True
            if goes_on:
                many[0] |= shared
                if many[0] and not shared:
                    yield from held.take()
            yield batch.filter(pa.array(many[group] | (f & PASS > 0)))
            now, first, shared = tuple(k[-1].tolist()), owner[-1], bool(many[-1])
            if shared or not goes_on or len(heads) > 1:
                held.drop()
            if not shared:
                held.add(batch.slice(int(heads[-1])).filter(pa.array(f[heads[-1] :] & PASS == 0)))

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(trimmed(run), kinds)


KEYS = ["doc_id", "row", "tag"]
OWN = ["__id", "__row", "__tag"]


def key_columns(names: list[str]) -> list[Column]:
    """doc_id, the last one for null; row and tag: 96 bits of the text, which tell the rows of one doc_id apart. Rows that agree
    in all are copies, and fare alike."""
    text = F.coalesce("text", F.lit(""))
    made = [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), F.xxhash64(text), F.hash(text).cast("long").bitwiseAND(0xFFFFFFFF)]
    return [c.alias(n) for c, n in zip(made, names, strict=True)]


def _keyed(docs: DataFrame, names: list[str] = KEYS) -> DataFrame:
    """The key columns and text; a null text is empty."""
    return docs.select(*key_columns(names), F.coalesce("text", F.lit("")).alias("text"))


def column(block: Block, name: str) -> pa.Array:
    return block.rows.column(block.rows.schema.get_field_index(name))


def packed(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """keys and text, with the text compressed for the way through a shuffle."""

    def run(block: Block) -> pa.RecordBatch:
        z = zstandard.ZstdCompressor(level=1)
        return pa.RecordBatch.from_arrays([*(block.rows.column(i) for i in range(len(keys))), pa.array([None if block.null[i] else z.compress(block.text(i)) for i in range(block.n)], pa.binary())], names=[*keys, "text"])

    kinds = dict(keyed.dtypes)
    return map_blocks(keyed.select(*keys, "text"), run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "text binary"]))


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with their texts as they were."""
    z = zstandard.ZstdDecompressor()
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            b = batch.slice(a, 1000)
            at = b.schema.get_field_index("text")
            texts = pa.array([None if t is None else z.decompress(t) for t in b.column(at).to_pylist()], pa.large_binary())
            yield pa.RecordBatch.from_arrays([texts if i == at else b.column(i) for i in range(b.num_columns)], names=b.schema.names)


#: A string's text and place: at is the byte, and the tag below it.
PLACE = "doc_id long, row long, at long"


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, row, tag, starts: set of (first string, number of strings) to remove, of the texts that have some."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = _keyed(docs)

    def anchors(block: Block) -> pa.RecordBatch:
        rep, doc, _, _, _ = segments(block)
        ids = _ids(block)
        low = column(block, "tag").to_numpy() & LOW
        # one row for each text and representative
        at = np.argsort(rep, kind="stable")
        rep, doc = rep[at], doc[at]
        new = np.ones(len(rep), bool)
        new[1:] = (rep[1:] != rep[:-1]) | (doc[1:] != doc[:-1])
        rep, doc = rep[new], doc[new]
        who = ids[doc]
        shared, head = local_shares(rep, who)
        key = np.where(head, rep, mix(rep ^ mix(who.view(np.uint64))))
        flag = np.where(head, np.where(shared, SHARED, 0), PASS)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(who), pa.array((low[doc] << 2 | flag).astype(np.int32))], names=["key", "doc_id", "flag"])

    def own_reps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, who, flag = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), b.column(2).to_numpy()
            rep = np.where(flag & PASS > 0, unmix(key) ^ mix(who.view(np.uint64)), key)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array((flag >> 2).astype(np.int64)), pa.array(rep.view(np.int64))], names=["doc_id", "low", "rep"])

    long = keyed.filter(F.octet_length("text") >= LENGTH)
    sent = map_blocks(long.select("doc_id", "tag", "text"), anchors, "key long, doc_id long, flag int")
    found = shared_rows(sent, "key", "doc_id", "flag").mapInArrow(trimmed(own_reps), "doc_id long, low long, rep long")
    # texts of one doc_id whose low bits agree share a list, which only has more than they need
    mine = cut(found.groupBy("doc_id", "low").agg(F.collect_set("rep").alias("reps")))

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches):
            for block in blocks(batch):
                rep, doc, start, size, _ = segments(block)
                reps = column(block, "reps")
                n = reps.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                want = np.stack((np.repeat(np.arange(block.n), n).astype(np.uint64), reps.flatten().to_numpy().view(np.uint64)), 1)
                on = np.isin(_two(doc.astype(np.uint64), rep), _two(want[:, 0], want[:, 1]))
                rep, doc, start, size = rep[on], doc[on], start[on], size[on]
                end = start + size + LENGTH - 1
                a, b = rolling(SEED + 100), rolling(SEED + 200)
                s1, s2 = a.of(a.prefix(block.buf), start, end), b.of(b.prefix(block.buf), start, end)
                place = ((start - block.off[doc]) << 32) | column(block, "tag").to_numpy()[doc]
                who = _ids(block)[doc]
                # segments that a smaller document of this block has are settled here (a negative size), and go their own ways
                done = later(join_names(s1, s2), who)
                s1 = np.where(done, mix(s1 ^ mix(who.view(np.uint64) + mix(place.view(np.uint64)))), s1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(who), column(block, "row").take(pa.array(doc)), pa.array(place), pa.array(np.where(done, -size, size).astype(np.int32)), pa.array(rep.view(np.int64))],
                    names=["s1", "s2", "doc_id", "row", "at", "size", "rep"],
                )

    texts = packed(long, KEYS)
    with_reps = texts.withColumn("low", F.col("tag").bitwiseAND(LOW)).join(mine, ["doc_id", "low"])
    cuts = with_reps.select(*KEYS, "text", "reps").mapInArrow(trimmed(cutting), f"s1 long, s2 long, {PLACE}, size int, rep long")

    # equal segments: those of larger documents are settled, the first goes on
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, least = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack((b.column(0).to_numpy(), b.column(1).to_numpy()), 1)
            who, size = b.column(2).to_numpy(), b.column(5).to_numpy()
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]).any(1)
            new[0] = now is None or tuple(k[0].tolist()) != now
            heads = np.flatnonzero(new)
            smallest = np.concatenate(([least], who[heads]))[np.cumsum(new)]
            done = (who > smallest) | (size < 0)
            now, least = tuple(k[-1].tolist()), int(smallest[-1])
            # the first row of each class goes on; others of its document say nothing new, and are settled with it later
            yield pa.RecordBatch.from_arrays([pa.array(np.where(done, 0, 1).astype(np.int8)), b.column(0), *(b.column(i) for i in range(2, 5)), pa.array(np.abs(size)), b.column(6)], names=["open", "s1", "doc_id", "row", "at", "size", "rep"])

    met = cut(cuts.repartition(parts, "s1", "s2").sortWithinPartitions("s1", "s2", "doc_id").mapInArrow(trimmed(settle), f"open byte, s1 long, {PLACE}, size int, rep long"))
    drop(mine)
    whole = met.filter("open = 0").select("doc_id", "row", "at", "size")
    # representatives with several classes of segments: their strings meet one by one. Aggregates are combined before they
    # travel, and the join with them splits a representative of very many rows.
    open_ = met.filter("open = 1").select("rep", "s1", "doc_id", "row", "at", "size")
    several = cut(open_.groupBy("rep").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi"), F.sum(F.least("size", F.lit(WIDTH))).alias("strings")).filter("lo < hi").select("rep", "strings"))
    salt = F.when(F.col("strings") > STRINGS, F.xxhash64("doc_id", "at").bitwiseAND(0x7FFF) + 1).otherwise(0).cast("int")
    left = open_.join(several, "rep").select("rep", salt.alias("salt"), "doc_id", "row", "at", "size")
    seg = F.struct(F.shiftright("at", 32).alias("start"), "size", "rep", "salt")
    wanted = cut(left.groupBy("doc_id", "row", F.col("at").bitwiseAND(0xFFFFFFFF).alias("tag")).agg(F.collect_set(seg).alias("segs")))
    drop_later = [met, wanted, several]

    def copying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The wanted segments with their bytes."""
        for batch in unpacked(batches):
            for block in blocks(batch):
                segs = column(block, "segs")
                n = segs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                flat = segs.flatten()
                doc = np.repeat(np.arange(block.n), n)
                first, size = flat.field(0).to_numpy(), flat.field(1).to_numpy().astype(np.int64)
                at = (first << 32) | column(block, "tag").to_numpy()[doc]
                for z in slices(size, 8 * STRINGS):
                    a = first[z] + block.off[doc[z]]
                    yield pa.RecordBatch.from_arrays(
                        [flat.field(2)[z], flat.field(3)[z], pa.array(_ids(block)[doc[z]]), column(block, "row").take(pa.array(doc[z])), pa.array(at[z]), flat.field(1)[z], pieces(block.buf, a, a + size[z] + LENGTH - 1)], names=["rep", "salt", "doc_id", "row", "at", "size", "bytes"]
                    )

    copied = texts.join(wanted, KEYS).select(*KEYS, "text", "segs").mapInArrow(trimmed(copying), f"rep long, salt int, {PLACE}, size int, bytes binary")

    def settled(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The strings of whole groups, some groups at a time."""
        rep = rows.column(0).to_numpy().view(np.uint64)
        edges = np.flatnonzero(np.concatenate(([True], rep[1:] != rep[:-1]))) if len(rep) else np.zeros(0, np.int64)
        size = np.minimum(rows.column(5).to_numpy().astype(np.int64), WIDTH)
        for groups in slices(np.add.reduceat(size, edges) if len(edges) else size, STRINGS):
            a, b = int(edges[groups][0]), int(edges[groups.stop]) if groups.stop < len(edges) else len(rep)
            part = rows.slice(a, b - a)
            name, check, of, at, n = string_names(part)
            who = part.column(2).to_numpy()[of]
            key = join_names(join_names(name, check), part.column(0).to_numpy().view(np.uint64)[of])
            done = np.flatnonzero(later(key, who))
            yield pa.RecordBatch.from_arrays([pa.array(who[done]), part.column(3).take(pa.array(of[done])), pa.array(at[done]), pa.array(n[done]), pa.nulls(len(done), pa.binary())], names=["doc_id", "row", "at", "size", "bytes"])

    def in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Settles the strings of small groups (salt 0), which lie side by side; the rows of larger ones go on as they are."""
        held: pa.RecordBatch | None = None
        for batch in batches:
            small = batch.column(1).to_numpy() == 0
            if not small.all():
                yield batch.filter(pa.array(~small)).select([2, 3, 4, 5, 6])
            rows = batch.filter(pa.array(small))
            if not rows.num_rows:
                continue
            if held is not None:
                rows = pa.Table.from_batches([held, rows]).combine_chunks().to_batches()[0]
            rep = rows.column(0).to_numpy()
            last = len(rep) - int(np.argmax(rep[::-1] != rep[-1])) if (rep != rep[-1]).any() else 0
            yield from settled(rows.slice(0, last))
            held = rows.slice(last)
        if held is not None:
            yield from settled(held)

    grouped = cut(copied.repartition(parts, "rep", "salt").sortWithinPartitions("salt", "rep").mapInArrow(trimmed(in_groups), f"{PLACE}, size int, bytes binary"))
    drop_later.append(grouped)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for z in slices(batch.column(3).to_numpy().astype(np.int64), STRINGS):
                part = batch.slice(z.start, z.stop - z.start)
                name, check, of, at, n = string_names(pa.RecordBatch.from_arrays([part.column(0), part.column(0), *(part.column(i) for i in range(5))], names=["rep", "salt", "doc_id", "row", "at", "size", "bytes"]))
                who = part.column(0).to_numpy()[of]
                # strings that several documents of this block hold are settled for all but the smallest
                done = later(join_names(name, check), who)
                name = np.where(done, mix(name ^ mix(who.view(np.uint64))), name)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(check.astype(np.int32)), pa.array(who), part.column(1).take(pa.array(of)), pa.array(at), pa.array(n), pa.array(done.astype(np.int8))], names=["name", "mark", "doc_id", "row", "at", "size", "settled"])

    named = grouped.filter("bytes is not null").mapInArrow(trimmed(strings), f"name long, mark int, {PLACE}, size int, settled byte")

    def settle_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, least = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack((b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)), 1)
            who, sure = b.column(2).to_numpy(), b.column(6).to_numpy() > 0
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]).any(1)
            new[0] = now is None or tuple(k[0].tolist()) != now
            heads = np.flatnonzero(new)
            smallest = np.concatenate(([least], who[heads]))[np.cumsum(new)]
            done = pa.array(np.flatnonzero((who > smallest) | sure))
            now, least = tuple(k[-1].tolist()), int(smallest[-1])
            yield pa.RecordBatch.from_arrays([b.column(i).take(done) for i in range(2, 6)], names=["doc_id", "row", "at", "size"])

    single = named.repartition(parts, "name", "mark").sortWithinPartitions("name", "mark", "doc_id").mapInArrow(trimmed(settle_strings), f"{PLACE}, size int")
    marks = whole.union(grouped.filter("bytes is null").select("doc_id", "row", "at", "size")).union(single)
    out = cut(marks.groupBy("doc_id", "row", F.col("at").bitwiseAND(0xFFFFFFFF).alias("tag")).agg(F.collect_set(F.struct(F.shiftright("at", 32).alias("start"), "size")).alias("starts")))
    drop(*drop_later)
    return out


def slices(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Ranges of rows whose sizes add up to most, or one larger row each."""
    stop = np.cumsum(sizes)
    a = 0
    while a < len(stop):
        b = max(a + 1, int(np.searchsorted(stop, (stop[a - 1] if a else 0) + most, "right")))
        yield slice(a, b)
        a = b


def string_names(rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Name, check, row number, place and size of each different string of the segments (rep, salt, doc_id, row, at, size,
    bytes). In a periodic segment a string comes again and again: where its places are at most LENGTH apart, they are one of a
    larger size, as their bytes go together."""
    size = rows.column(5).to_numpy().astype(np.int64)
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
    for z in slices(size, STRINGS):
        block = next(blocks(rows.slice(z.start, z.stop - z.start), "bytes", 1 << 62))
        n = size[z]
        r, c = rolling(SEED), rolling(SEED + 300)
        name, check = doubled(r.every(r.prefix(block.buf), FIRST)), c.every(c.prefix(block.buf), LENGTH) & U64(0xFFFF)
        of = np.repeat(np.arange(block.n), n)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        place = block.off[of] + inner
        name, check = name[place], check[place]
        stop = inner.copy()
        periodic = np.flatnonzero(n[of] > WIDTH)
        if len(periodic):
            order = periodic[np.lexsort((inner[periodic], name[periodic], of[periodic]))]
            new = np.ones(len(order), bool)
            new[1:] = (of[order][1:] != of[order][:-1]) | (name[order][1:] != name[order][:-1]) | (np.diff(inner[order]) > LENGTH)
            heads = np.flatnonzero(new)
            stop[order[heads]] = inner[order][np.append(heads[1:], len(order)) - 1]
            keep = np.ones(len(of), bool)
            keep[periodic] = False
            keep[order[heads]] = True
            name, check, of, inner, stop = name[keep], check[keep], of[keep], inner[keep], stop[keep]
        out.append((name, check, of + z.start, rows.column(4).to_numpy()[z][of] + (inner << 32), (stop - inner + 1).astype(np.int32)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def later(key: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Which rows have a smaller owner of their key among these rows."""
    out = np.zeros(len(key), bool)
    if len(key):
        order = np.argsort(key)
        k, w = key[order], who[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        out[order] = w > np.minimum.reduceat(w, np.flatnonzero(new))[np.cumsum(new) - 1]
    return out


def pieces(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    n = end - start
    stop = np.cumsum(n)
    data = buf[np.repeat(start - (stop - n), n) + np.arange(int(stop[-1]) if len(stop) else 0)]
    off = np.concatenate(([0], stop)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def _two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return join_names(a, b)


def removed(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of the block go, and which texts lose some. Its rows have starts: lists of (start, size)."""
    col = block.rows.column(block.rows.schema.get_field_index("starts"))
    n = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten()
    doc = np.repeat(np.arange(block.n), n)
    a = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64) + block.off[doc]
    b = np.minimum(a + flat.field(1).to_numpy(zero_copy_only=False) + LENGTH - 1, block.off[doc + 1])
    d = np.bincount(a, minlength=len(block.buf) + 1)[: len(block.buf) + 1] - np.bincount(b, minlength=len(block.buf) + 1)[: len(block.buf) + 1]
    return np.cumsum(d[:-1]) > 0, n > 0


def kept_digest(block: Block, mask: np.ndarray, some: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Bytes removed (mask, in the texts that lose some), maximal runs of them, and the SHA-256 of what is left."""
    gone, runs, sha = np.zeros(block.n, np.int64), np.zeros(block.n, np.int64), []
    for i in range(block.n):
        text = block.buf[block.off[i] : block.off[i + 1]]
        if some[i]:
            m = mask[block.off[i] : block.off[i + 1]]
            gone[i], runs[i] = m.sum(), (m[0] if len(m) else 0) + np.count_nonzero(m[1:] & ~m[:-1])
            text = text[~m]
        sha.append(hashlib.sha256(np.ascontiguousarray(text)).hexdigest())
    return pa.array(gone), pa.array(runs), pa.array(sha, pa.string())


def _with_starts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs (key columns __id, __row and __tag) with starts."""
    f = found.select(F.col("doc_id").alias("__d"), F.col("row").alias("__r"), F.col("tag").alias("__t"), "starts")
    return docs.join(f, (F.col("__id") == F.col("__d")) & (F.col("__row") == F.col("__r")) & (F.col("__tag") == F.col("__t")), "left")


def find_repeats(docs: DataFrame, search: Callable[[DataFrame], DataFrame] = repeated) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256. search: repeated, or that of doubling."""
    keyed = _keyed(docs, OWN)

    def digest(block: Block) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([block.rows.column(0), pa.array(block.sizes), *kept_digest(block, *removed(block))], names=["__id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches):
            yield from map(digest, blocks(batch))

    joined = _with_starts(packed(keyed, OWN), search(docs)).select("__id", "text", "starts")
    out = joined.mapInArrow(trimmed(run), "__id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(F.when(F.col("__id") != LAST_ID, F.col("__id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs, each text without its repeated strings. Where a cut would split a character, the character's other bytes go too,
    so texts stay valid; a text of which nothing is left is empty. Null texts stay null."""
    cols = docs.columns
    names = ["text" if c == "text" else f"c{i}" for i, c in enumerate(cols)]
    d = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(cols, names, strict=True)), *key_columns(OWN))
    kinds = ", ".join(f"{n} {k}" for n, (_, k) in zip(names, docs.dtypes, strict=True))
    at = cols.index("text")

    def clean(block: Block) -> pa.RecordBatch:
        arrays = [block.rows.column(i) for i in range(len(names))]
        mask, some = removed(block)
        if some.any():
            texts = []
            for i in range(block.n):
                text = block.buf[block.off[i] : block.off[i + 1]]
                if some[i]:
                    text = text[~mask[block.off[i] : block.off[i + 1]]]
                texts.append(None if block.null[i] else text.tobytes().decode("utf-8", "ignore"))
            arrays[at] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(arrays, names=names)

    out = map_blocks(_with_starts(d, repeated(docs)).select(*names, "starts"), clean, kinds)
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, cols, strict=True)))
