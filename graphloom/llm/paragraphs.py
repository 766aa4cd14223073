"""Substring deduplication by paragraph MinHash banding.

A paragraph is a line of `MIN_WORDS` = 20 words or more, or a run of consecutive shorter lines, as the set of its 5-word
shingles (words: lower-cased letters and digits). Runs end at blank lines, long lines and the text's ends; one of fewer words
than a shingle joins the run before it, else the one behind it. A whole text of fewer words is one paragraph. MinHash
signatures of `BANDS` x `ROWS` = 12 x 4 make paragraphs of Jaccard similarity 0.8 collide with probability 0.998. Colliding
paragraphs are verified by their exact Jaccard similarity (`SIMILARITY` = 0.8 or more), and components of verified links
decide: each paragraph that has a member of its component in a document with a smaller doc_id is removed.

Equal paragraphs are one class before banding. Inside a bucket, links are searched from member to member (each new member of a
component is compared with those not yet reached), so near-equal groups take one sweep and no pair of different texts is
lost; buckets of more than `BUCKET` classes or `BUCKET_WORDS` words are cut into shards of which each two meet, so no task
holds an unbounded group. One paragraph must fit a worker.

A passage may also stand inside a paragraph or across several, where sets of shingles do not see it. So texts are cut a second
time, at words that are smallest among their neighbours by hash, whatever their lines. Two such pieces together (10 words or
more) are a small paragraph of which only equal ones are linked: as classes, without banding. Each is extended word by word, up
to `CONTEXT` words to both sides, as far as it agrees with its representative (the one in the smallest document), and removed.
The end of a passage is further than that from its last cut in about one case of a hundred.

Results: one row per input row. Null and empty texts have no paragraphs. A null doc_id is larger than all others and its
component_id is null. Rows with one doc_id are one document: they do not remove each other's paragraphs, and repeated paragraphs
of a document stay. Other columns, also those of clashing names, are ignored. No rows give no rows. Texts of any length are
compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ALNUM, LOWER, Block, blocks, map_blocks, mix, rolling, trimmed, unmix, words
from .components import components, cut, drop
from .suffixes import KEYS, LAST_ID, OWN, PLACE, _keyed, _with_starts, column, join_names, kept_digest, packed, shared_rows, unpacked

MIN_WORDS = 20
SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
NEIGHBOURS = 4
MIN_PIECE = 10
CONTEXT = 14
BUCKET = 4096
BUCKET_WORDS = 1 << 20
SEED = 4
#: Flags of a piece: a block has a smaller document's for it; it is that one.
GONE, HEAD = 1, 2
U64 = np.uint64


class Lines:
    """The paragraphs of a block: text number, first word and number of words of each; hashes of all words, and each text's
    first word (head)."""

    def __init__(self, block: Block, short: bool = True):
        """short: with the runs of short lines."""
        self.starts, self.ends, self.doc = words(block, ALNUM)
        self.head = np.searchsorted(self.doc, np.arange(block.n + 1))
        r = rolling(SEED)
        self.h = r.of(r.prefix(LOWER[block.buf]), self.starts, self.ends)
        # each line end, and each text's first byte, begins another line
        bounds = np.union1d(np.flatnonzero(block.buf == 10) + 1, block.off)
        line = np.searchsorted(bounds, self.starts, "right")
        first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(line)))
        on = size >= MIN_WORDS
        if short and len(first):
            first, size, on = self._runs(line, first, size, on)
        self.first, self.size = first[on], size[on]
        self.text = self.doc[self.first]

    def _runs(self, line: np.ndarray, first: np.ndarray, size: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word and number of words of the long lines and of the runs of others; and which of them are paragraphs."""
        text = self.doc[first]
        # a stretch: short lines of one text with no long one between
        edge = np.concatenate(([True], (text[1:] != text[:-1]) | long[1:] | long[:-1]))
        new = edge.copy()
        new[1:] |= line[first[1:]] > line[first[:-1]] + 1
        for behind in (False, True):
            heads = np.flatnonzero(new)
            n = np.add.reduceat(size, heads)
            few = n < SHINGLE
            if behind:  # only the first run of a stretch is still short
                new[heads[1:][few[:-1]]] = edge[heads[1:][few[:-1]]]
            else:
                new[heads[few]] = edge[heads[few]]
        heads = np.flatnonzero(new)
        n = np.add.reduceat(size, heads)
        alone = n == np.bincount(self.doc)[text[heads]]
        return first[heads], n, (n >= SHINGLE) | alone

    def shingles(self, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All shingle hashes of the paragraphs, and how many each has."""
        first, size = (self.first, self.size) if which is None else (self.first[which], self.size[which])
        n = np.maximum(size - SHINGLE + 1, 1)
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        h, few = self.h[at], np.repeat(np.minimum(size, SHINGLE), n)
        for k in range(1, SHINGLE):
            h = mix(h * U64(0x9E3779B97F4A7C15) + np.where(k < few, self.h[np.minimum(at + k, len(self.h) - 1)], U64(0)))
        return h, n

    def names(self, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit names of runs of words."""
        out = []
        for seed in (SEED + 100, SEED + 200):
            r = rolling(seed)
            r._grow(len(self.h))
            s = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(self.h + U64(seed)) * r.up[: len(self.h)])))
            out.append(mix((s[first + size] - s[first]) * r.down[first] + size.astype(np.uint64)))
        return out[0], out[1]

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and number of words of each two neighbouring pieces of a text."""
        none = np.zeros(0, np.int64)
        n = len(self.h)
        if n < 2 * NEIGHBOURS + 2:
            return none, none
        pair = np.full(n, U64(2**64 - 1))
        pair[:-1] = mix(self.h[:-1] * U64(31) + self.h[1:])
        least = pair.copy()
        for k in range(1, NEIGHBOURS + 1):
            least[k:] = np.minimum(least[k:], pair[:-k])
            least[:-k] = np.minimum(least[:-k], pair[k:])
        at = np.arange(n)
        edge = np.minimum(at - np.searchsorted(self.doc, self.doc), np.searchsorted(self.doc, self.doc, "right") - 1 - at)
        cuts = np.flatnonzero((pair == least) & (edge > NEIGHBOURS))  # the neighbours are all in the text
        text = self.doc[cuts]
        if len(cuts) < 3:
            return none, none
        two = (text[2:] == text[:-2]) & (cuts[2:] - cuts[:-2] >= MIN_PIECE)
        return cuts[:-2][two], (cuts[2:] - cuts[:-2])[two]

    def around(self, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """16 bits of the words before (the nearest first) and behind each run of words, 0 where the text ends."""
        text = self.doc[first]
        k = np.arange(CONTEXT)
        before, behind = first[:, None] - 1 - k, (first + size)[:, None] + k
        at = np.concatenate((before, behind), 1)
        inside = np.concatenate((before >= self.head[text][:, None], behind < self.head[text + 1][:, None]), 1)
        mark = (self.h >> U64(48)).astype(np.uint16) | np.uint16(1)
        return np.where(inside, mark[np.clip(at, 0, len(mark) - 1)], np.uint16(0))


def bands(shingles: np.ndarray, n: np.ndarray) -> np.ndarray:
    """BANDS keys of each paragraph."""
    rng = np.random.default_rng(SEED)
    mult = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * U64(2) + U64(1)
    add = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
    start = np.cumsum(n) - n
    out = np.empty((len(n), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(n), U64(b + 1))
        for k in range(b * ROWS, (b + 1) * ROWS):
            key = mix(key * U64(0x9E3779B97F4A7C15) + np.minimum.reduceat(shingles * mult[k] + add[k], start))
        out[:, b] = key
    return out


def bucket_edges(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the members with Jaccard similarity SIMILARITY or more."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    every, number = np.unique(np.concatenate(sets), return_inverse=True)
    off = np.concatenate(([0], np.cumsum(size)))
    left, a, b = np.arange(n), [], []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            mark = np.zeros(len(every), np.int64)
            mark[number[off[x] : off[x + 1]]] = 1
            # sizes alone rule out most others
            near = left[(size[left] >= SIMILARITY * size[x]) & (size[left] * SIMILARITY <= size[x])]
            if not len(near):
                continue
            flat = np.repeat(off[near] - (np.cumsum(size[near]) - size[near]), size[near]) + np.arange(size[near].sum())
            shared = np.add.reduceat(mark[number[flat]], np.cumsum(size[near]) - size[near])
            hit = near[shared >= SIMILARITY * (size[near] + size[x] - shared) - 1e-9]
            if len(hit):
                a += [x] * len(hit)
                b += hit.tolist()
                queue += hit.tolist()
                left = np.setdiff1d(left, hit, assume_unique=True)
    return a, b


def agreeing(mine: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words before and behind agree, by rows of around()."""
    same = (mine == other) & (mine != 0)
    return np.cumprod(same[:, :CONTEXT], axis=1).sum(1), np.cumprod(same[:, CONTEXT:], axis=1).sum(1)


def _links(keyed: DataFrame, classes: DataFrame, parts: int, short: bool) -> DataFrame:
    """Verified links (a, b) between classes (node, bands, words, doc_id, row, at)."""
    posted = classes.select("node", F.explode("bands").alias("key"), F.lit(0).cast("byte").alias("flag"))
    met = cut(shared_rows(posted.select("key", "node", "flag"), "key", "node", "flag").select("key", "node"))
    tag, at = F.col("at").bitwiseAND(0xFFFFFFFF).alias("tag"), F.shiftright("at", 32).alias("first")
    need = met.select("node").distinct().join(classes.select("node", "doc_id", "row", "at"), "node").groupBy("doc_id", "row", tag).agg(F.collect_list(F.struct(at, "node")).alias("need"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches):
            for block in blocks(batch):
                lines = Lines(block, short)
                need = column(block, "need")
                flat = need.flatten()
                text = np.repeat(np.arange(block.n), need.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
                want = lines.head[text] + flat.field(0).to_numpy()
                on = np.searchsorted(lines.first, want)
                h, n = lines.shingles(on)
                stop = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([flat.field(1), pa.array([np.unique(h[z - k : z]).tobytes() for z, k in zip(stop, n, strict=True)], pa.binary())], names=["node", "shingles"])

    shingled = packed(keyed, KEYS).join(need, KEYS).select(*KEYS, "text", "need").mapInArrow(trimmed(sets), "node long, shingles binary").dropDuplicates(["node"])
    # shards by number and by words; most buckets are one
    shards = F.greatest(F.ceil(F.count("*") / BUCKET), F.ceil(F.sum("words") / BUCKET_WORDS)).cast("int")
    over = cut(met.join(classes.select("node", "words"), "node").groupBy("key").agg(shards.alias("shards")).filter("shards > 1"))
    own = F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")
    to = F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    spread = met.join(over, "key", "left").withColumn("shards", F.coalesce("shards", F.lit(1))).withColumn("to", F.explode(to)).select("key", "to.i", "to.j", "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, held = None, [], []

        def out() -> pa.RecordBatch | None:
            if len(nodes) < 2:
                return None
            a, b = bucket_edges(held)
            if not a:
                return None
            node = np.array(nodes, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(node[a], node[b])), pa.array(np.minimum(node[a], node[b]))], names=["a", "b"])

        for batch in batches:
            k = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            for key, node, raw in zip(k, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if key != now:
                    if (got := out()) is not None:
                        yield got
                    now, nodes, held = key, [], []
                nodes.append(node)
                held.append(np.frombuffer(raw, np.uint64))
        if (got := out()) is not None:
            yield got

    return spread.join(shingled, "node").select("key", "i", "j", "node", "shingles").repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(trimmed(verify), "a long, b long").distinct()


def repeated(docs: DataFrame, inner_passages: bool = True) -> tuple[DataFrame, DataFrame]:
    """Words to remove: doc_id, row, tag, starts: set of (first word, number of words); and links of documents: a, b (b
    smaller). Without inner_passages, only lines of MIN_WORDS are compared."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = _keyed(docs)

    def place(block: Block, lines: Lines, first: np.ndarray) -> list[pa.Array]:
        text = lines.doc[first]
        take = pa.array(text)
        return [column(block, "doc_id").take(take), column(block, "row").take(take), pa.array(((first - lines.head[text]) << 32) | column(block, "tag").to_numpy()[text])]

    def paragraphs(block: Block) -> pa.RecordBatch:
        lines = Lines(block, inner_passages)
        if not len(lines.first):
            return None
        h, n = lines.shingles()
        one, two = lines.names(lines.first, lines.size)
        band = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(bands(h, n).ravel().view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), *place(block, lines, lines.first), pa.array(lines.size.astype(np.int32)), band], names=["c1", "c2", "doc_id", "row", "at", "words", "bands"])

    found = cut(map_blocks(keyed, paragraphs, f"c1 long, c2 long, {PLACE}, words int, bands array<long>"))
    # the class's smallest row stands for it; equal paragraphs add up before they travel
    groups = found.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "row", "at")).alias("at"), F.first("bands").alias("bands"), F.first("words").alias("words"))
    classes = cut(groups.select(F.monotonically_increasing_id().alias("node"), "c1", "c2", "bands", "words", "at.*"))
    reached = components(_links(keyed, classes, parts, inner_passages))
    named = cut(classes.join(reached, "node", "left").select("c1", "c2", F.coalesce("component", "node").alias("component"), "doc_id"))
    drop(classes)
    least = cut(named.groupBy("component").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    told = named.join(least, "component", "left").select("c1", "c2", F.coalesce("least", "doc_id").alias("least"))
    gone = found.select("c1", "c2", "doc_id", "row", "at", "words").join(told, ["c1", "c2"]).filter("doc_id > least").select("doc_id", "row", "at", "words", "least")

    def inner(block: Block) -> pa.RecordBatch:
        lines = Lines(block)
        first, size = lines.pieces()
        if not len(first):
            return None
        one, two = lines.names(first, size)
        ids = place(block, lines, first)
        who, row, at = (i.to_numpy() for i in ids)
        key = join_names(one, two)
        near = lines.around(first, size)
        # what this block settles: pieces of larger documents go their own way, only the smallest one's looks for others
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        again = again[np.lexsort((at[again], row[again], who[again], key[again]))]
        new = np.ones(len(again), bool)
        new[1:] = key[again][1:] != key[again][:-1]
        head = np.arange(len(key))
        head[again] = again[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(again) else again
        done = who > who[head]
        flag = done.astype(np.int8)
        flag[head[done]] = HEAD
        own = np.where(done, mix(one ^ mix(who.view(np.uint64))), one)
        return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(two.view(np.int64)), *ids, pa.array(size.astype(np.int32)), pa.array(flag), pa.array([r.tobytes() for r in near], pa.binary())], names=["p1", "p2", "doc_id", "row", "at", "words", "flag", "near"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the pieces of several documents: the first one of each, and those of larger documents (GONE)."""
        now, low, last = None, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack((b.column(0).to_numpy(), b.column(1).to_numpy()), 1)
            who, flag = b.column(2).to_numpy(), b.column(6).to_numpy()
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]).any(1)
            new[0] = now is None or tuple(k[0].tolist()) != now
            heads = np.flatnonzero(new)
            group = np.cumsum(new)
            small = np.concatenate(([low], who[heads]))[group]
            gone = (who > small) | (flag == GONE)
            # a first one is told once: with its group's first row that goes, or at once where a block knew of others
            told = np.zeros(len(k), bool)
            told[heads[np.isin(np.arange(1, len(heads) + 1), group[gone & (flag != GONE)])]] = True
            told[heads[flag[heads] == HEAD]] = True
            if last is not None and (gone & (flag != GONE) & (group == 0)).any():
                yield _told(last, 0)
                last = None
            if told.any():
                yield _told(b.filter(pa.array(told)), 0)
            if gone.any():
                yield _told(b.filter(pa.array(gone)), GONE)
            now, low = tuple(k[-1].tolist()), int(small[-1])
            if len(heads):
                z = int(heads[-1])
                last = None if told[z] or flag[z] == GONE else b.slice(z, 1)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = agreeing(marks_of(b.column(4)), marks_of(b.column(6)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(b.column(2).to_numpy() - (x << 32)), pa.array((b.column(3).to_numpy() + x + y).astype(np.int32)), b.column(5)], names=["doc_id", "row", "at", "words", "least"])

    every = gone
    if inner_passages:
        sent = map_blocks(keyed, inner, f"p1 long, p2 long, {PLACE}, words int, flag byte, near binary")
        pairs = cut(sent.repartition(parts, "p1", "p2").sortWithinPartitions("p1", "p2", "doc_id", "row", "at").mapInArrow(trimmed(settle), f"p1 long, p2 long, {PLACE}, words int, flag byte, near binary"))
        firsts = pairs.filter(f"flag <> {GONE}").select("p1", "p2", F.col("doc_id").alias("least"), F.col("near").alias("head"))
        held = pairs.filter(f"flag = {GONE}").join(firsts, ["p1", "p2"]).select("doc_id", "row", "at", "words", "near", "least", "head")
        every = gone.union(held.mapInArrow(trimmed(extend), f"{PLACE}, words int, least long"))
    every = cut(every)
    drop(found, named, least)
    spans = every.groupBy("doc_id", "row", F.col("at").bitwiseAND(0xFFFFFFFF).alias("tag")).agg(F.collect_set(F.struct(F.shiftright("at", 32).alias("start"), F.col("words").alias("size"))).alias("starts"))
    return spans, every.select(F.col("doc_id").alias("a"), F.col("least").alias("b")).filter(F.col("a") != LAST_ID).distinct()


def marks_of(col: pa.Array) -> np.ndarray:
    """around() of some rows, as it travels."""
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, 2 * CONTEXT)


def _told(rows: pa.RecordBatch, flag: int) -> pa.RecordBatch:
    """Rows with their own names again, where they went another way."""
    p1, who, was = rows.column(0).to_numpy().view(np.uint64), rows.column(2).to_numpy().view(np.uint64), rows.column(6).to_numpy()
    p1 = np.where(was == GONE, unmix(p1) ^ mix(who), p1)
    return pa.RecordBatch.from_arrays([pa.array(p1.view(np.int64)), *(rows.column(i) for i in range(1, 6)), pa.array(np.full(rows.num_rows, flag, np.int8)), rows.column(7)], names=["p1", "p2", "doc_id", "row", "at", "words", "flag", "near"])


def removed(block: Block, lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes go, and which texts lose some: from the first to the last word of each span."""
    col = column(block, "starts")
    n = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten()
    first = lines.head[np.repeat(np.arange(block.n), n)] + flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
    d = np.zeros(len(block.buf) + 1, np.int64)
    np.add.at(d, lines.starts[first], 1)
    np.add.at(d, lines.ends[first + flat.field(1).to_numpy(zero_copy_only=False) - 1], -1)
    return np.cumsum(d[:-1]) > 0, n > 0


def find_repeats(docs: DataFrame, inner_passages: bool = True) -> DataFrame:
    """doc_id, n_paragraphs, n_bytes, n_removed, n_spans, kept_sha256, component_id (of documents that share paragraphs)."""
    keyed = _keyed(docs, OWN)
    spans, links = repeated(docs, inner_passages)

    def digest(block: Block) -> pa.RecordBatch:
        lines = Lines(block, inner_passages)
        n = np.bincount(lines.text, minlength=block.n)
        return pa.RecordBatch.from_arrays([block.rows.column(0), pa.array(n), pa.array(block.sizes), *kept_digest(block, *removed(block, lines))], names=["__id", "n_paragraphs", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches):
            yield from map(digest, blocks(batch))

    out = _with_starts(packed(keyed, OWN), spans).select("__id", "text", "starts").mapInArrow(trimmed(run), "__id long, n_paragraphs long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    reached = components(links)
    out = out.join(reached, F.col("__id") == F.col("node"), "left")
    ids = F.when(F.col("__id") != LAST_ID, F.col("__id"))
    return out.select(ids.alias("doc_id"), "n_paragraphs", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.when(ids.isNotNull(), F.coalesce("component", "__id")).alias("component_id"))
