"""Benchmark decontamination with a generalised suffix automaton over words.

Items and documents are lower-cased (A-Z) and cut into words. A window is `window` consecutive words of an item, or all
words of a shorter item. The automaton of the items follows each document's words and keeps the length of the longest
match; a match of `window` words or more is covered by windows, and the automaton's states know the items.

Before the automaton walks, vector filters leave only runs of words whose neighbours are neighbours in some item.

Nulls and empties: a null or empty text has no words; a null item or one without words has no window; a null item_id is
never listed (its words still hit). Repeated item_ids count once, repeated documents give repeated rows. An empty
benchmark leaves all documents clean. Other columns pass through `keep` or are ignored.

Items go into automata of `GROUP_WORDS` words at most, which are built from small dictionaries (100 MB) and kept as flat
arrays; `PASS_WORDS` words of automata (about 70 MB) are broadcast at a time and looked through in one map over the documents,
without a shuffle. Larger benchmarks take further maps. Texts of any length are matched whole; they follow the automata side
by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ALNUM, LOWER, Block, blocks, rolling, trimmed, words

WINDOW = 10
GROUP_WORDS = 200_000
PASS_WORDS = 1_000_000
SEED = 8


class Automaton:
    """Suffix automaton of several sequences of word numbers below `words`, in arrays: sorted keys (state * words + word) of the
    moves and where they lead; link and length of each state; for the states, the items that end there."""

    def __init__(self, seqs: list[tuple[str | None, list[int]]], words: int, window: int):
        self.words, self.window = words, window
        self._next: list[dict[int, int]] = [{}]
        self._link, self._len = [-1], [0]
        for _, seq in seqs:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        n = [len(d) for d in self._next]
        keys = np.fromiter((c for d in self._next for c in d), np.int64, sum(n)) + np.repeat(np.arange(len(n)), n) * words
        to = np.fromiter((v for d in self._next for v in d.values()), np.int32, sum(n))
        at = np.argsort(keys)
        self.keys, self.to = keys[at], to[at]
        self.link, self.len = np.array(self._link, np.int32), np.array(self._len, np.int32)
        self._tell(seqs)
        del self._next, self._link, self._len

    def _tell(self, seqs: list[tuple[str | None, list[int]]]) -> None:
        """Items by state, as sorted (state, item) rows: of whole windows at the window's state, and of shorter items at each
        state that ends in them."""
        size, link = self._len, self._link
        order = np.argsort(self.len, kind="stable").tolist()
        top = list(range(len(size)))  # the state of the last `window` words
        for v in order:
            if v and size[link[v]] >= self.window:
                top[v] = top[link[v]]
        ends, own = set(), {}
        self.names = sorted({item for item, _ in seqs if item is not None})
        number = {item: k for k, item in enumerate(self.names)} | {None: -1}
        for item, seq in seqs:
            v = 0
            for i, c in enumerate(seq):
                v = self._next[v][c]
                if i + 1 >= self.window:
                    ends.add((top[v], number[item]))
            if len(seq) < self.window:
                while size[link[v]] >= len(seq):
                    v = link[v]
                own.setdefault(v, set()).add((len(seq), number[item]))
        short: dict[int, set] = {}
        if own:
            for v in order:
                if got := own.get(v, set()) | short.get(link[v], set()):
                    short[v] = got
        self.top = np.array(top, np.int32)
        self.ends = np.array(sorted(ends), np.int64).reshape(-1, 2)
        self.short = np.array(sorted((v, n, item) for v, got in short.items() for n, item in got), np.int64).reshape(-1, 3)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, size = self._next, self._link, self._len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if size[q] == size[last] + 1 else self._clone(last, c, q)
        cur = len(size)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if size[q] == size[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, size = self._next, self._link, self._len
        new = len(size)
        nxt.append(dict(nxt[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def moves(self, v: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Where c leads from v; -1 for nowhere."""
        key = v.astype(np.int64) * self.words + c
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[k] == key, self.to[k], -1)

    def walk(self, number: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of runs of words (first to last): place, state and length of the longest match at each word where it tells
        something, and the run's number. All runs go one word further in each step."""
        at_short = np.zeros(len(self.len), bool)
        at_short[self.short[:, 0]] = True
        order = np.argsort(first - last, kind="stable")  # the longest first
        place, stop = first[order].copy(), last[order]
        v, n = np.zeros(len(order), np.int32), np.zeros(len(order), np.int32)
        out: list = []
        while len(place):
            c = number[place]
            go = self.moves(v, c)
            while len(lost := np.flatnonzero((go < 0) & (v > 0))):
                v[lost] = self.link[v[lost]]
                n[lost] = self.len[v[lost]]
                go[lost] = self.moves(v[lost], c[lost])
            v, n = np.where(go < 0, 0, go).astype(np.int32), np.where(go < 0, 0, n + 1)
            tells = np.flatnonzero((n >= self.window) | at_short[v])
            if len(tells):
                out.append((place[tells], v[tells], n[tells], order[tells]))
            place = place + 1
            left = int(np.count_nonzero(place < stop))
            place, stop, v, n, order = place[:left], stop[:left], v[:left], n[:left], order[:left]
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *(o[k] for o in out)]).astype(np.int64) for k in range(4))

    def told(self, place: np.ndarray, state: np.ndarray, length: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adds the covered words to edges (+1 where a cover begins, -1 behind its end); gives (row, item) of what is found,
        rows of place."""
        long = length >= self.window
        np.add.at(edges, (place - length + 1)[long], 1)
        np.add.at(edges, (place + 1)[long], -1)
        row, at = _rows_of(self.ends[:, 0], np.where(long, self.top[state], -1))
        rows, items = [row], [self.ends[at, 1]]
        row, at = _rows_of(self.short[:, 0], state)
        fits = self.short[at, 1] <= length[row]
        row, at = row[fits], at[fits]
        np.add.at(edges, place[row] - self.short[at, 1] + 1, 1)
        np.add.at(edges, place[row] + 1, -1)
        return np.concatenate([*rows, row]), np.concatenate([*items, self.short[at, 2]])


def _rows_of(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) for each j with sorted_keys[j] == wanted[i]."""
    lo, hi = np.searchsorted(sorted_keys, wanted, "left"), np.searchsorted(sorted_keys, wanted, "right")
    n = hi - lo
    return np.repeat(np.arange(len(wanted)), n), np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Benchmark:
    """Automata over one numbering of words, and the filters that keep most words away from them."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int, group_words: int = GROUP_WORDS):
        ids: dict[bytes, int] = {}
        seqs = [(item, [ids.setdefault(w, len(ids)) for w in ws]) for item, ws in items if ws]
        self.words = max(1, len(ids))
        self.least = min([window, *(len(seq) for _, seq in seqs)])
        self.hashes, self.numbers = self._hashes(list(ids))
        ends = [np.array(seq, np.int64) for _, seq in seqs]
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *(e[:-1] * self.words + e[1:] for e in ends)]))
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.hashes >> np.uint64(42)] = True
        self.automata: list[Automaton] = []
        group, n = [], 0
        for seq in [*seqs, None]:
            if n and (seq is None or n + len(seq[1]) > group_words):
                self.automata.append(Automaton(group, self.words, window))
                group, n = [], 0
            if seq is not None:
                group.append(seq)
                n += len(seq[1])

    @staticmethod
    def _hashes(text: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        r = rolling(SEED)
        h = np.array([r.of(r.prefix(np.frombuffer(w, np.uint8)), np.array([0]), np.array([len(w)]))[0] for w in text], np.uint64)
        at = np.argsort(h)
        return h[at], at.astype(np.int64)

    def number(self, h: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 for words of no item."""
        out = np.full(len(h), -1, np.int64)
        at = np.flatnonzero(self.seen[h >> np.uint64(42)])
        if len(at) and len(self.hashes):
            k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            ok = self.hashes[k] == h[at]
            out[at[ok]] = self.numbers[k[ok]]
        return out


def item_words(text: str | None) -> list[bytes]:
    b = np.frombuffer((text or "").encode(), np.uint8)
    block = Block(b, np.array([0, len(b)], np.int64), np.zeros(1, bool), None)
    low = LOWER[b].tobytes()
    starts, ends, _ = words(block, ALNUM)
    return [low[a:z] for a, z in zip(starts, ends, strict=True)]


def match(block: Block, bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, set]]:
    """Starts, ends, text numbers and hits of the block's words; the items of each text that has some."""
    starts, ends, doc = words(block, ALNUM)
    hit, found = np.zeros(len(starts), bool), {}
    if len(starts) and len(bench.hashes):
        r = rolling(SEED)
        number = bench.number(r.of(r.prefix(LOWER[block.buf]), starts, ends))
        on = number >= 0
        joined = on[:-1] & on[1:] & (doc[:-1] == doc[1:])
        at = np.flatnonzero(joined)
        if not len(bench.pairs):
            joined[:] = False
        elif len(at):
            key = number[at] * bench.words + number[at + 1]
            k = np.minimum(np.searchsorted(bench.pairs, key), len(bench.pairs) - 1)
            joined[at[bench.pairs[k] != key]] = False
        # runs of words: each joined to the next
        cut = np.flatnonzero(np.concatenate(([True], ~joined, [True])))
        a, b = cut[:-1], cut[1:]
        ok = (b - a >= bench.least) & on[a]
        a, b = a[ok], b[ok]
        edges = np.zeros(len(starts) + 1, np.int64)
        for auto in bench.automata if len(a) else ():
            place, state, length, run = auto.walk(number, a, b)
            row, item = auto.told(place, state, length, edges)
            if len(row):
                text = doc[a[run[row]]]
                for d, i in np.unique(np.stack((text, item), 1), axis=0).tolist():
                    found.setdefault(d, set()).add(auto.names[i] if i >= 0 else None)
        hit = np.cumsum(edges[:-1]) > 0
    return starts, ends, doc, hit, found


HITS = "n_words long, hits array<struct<start:int,end:int,first:int,last:int>>, items array<string>"


def _group(df: DataFrame, auto, keep: list[str], kinds: str) -> DataFrame:
    fields = [("start", pa.int32()), ("end", pa.int32()), ("first", pa.int32()), ("last", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = auto.value
        for batch in batches:
            for block in blocks(batch):
                starts, ends, doc, hit, found = match(block, a)
                n = np.bincount(doc, minlength=block.n)
                first = np.concatenate(([0], np.cumsum(n)))
                # runs of hit words, cut between documents
                same = np.concatenate(([False], hit[1:] & hit[:-1] & (doc[1:] == doc[:-1]))) if len(hit) else hit
                x = np.flatnonzero(hit & ~same)
                y = np.flatnonzero(hit & ~np.concatenate((same[1:], [False])) if len(hit) else hit)
                d = doc[x]
                values = (starts[x] - block.off[d], ends[y] - block.off[d], x - first[d], y + 1 - first[d])
                at = np.concatenate(([0], np.cumsum(np.bincount(d, minlength=block.n)))).astype(np.int32)
                spans = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in values], [f for f, _ in fields]))
                items = pa.array([sorted(i for i in found.get(k, ()) if i is not None) for k in range(block.n)], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*(block.rows.column(block.rows.schema.get_field_index(c)) for c in keep), pa.array(n.astype(np.int64)), spans, items], names=[*keep, "n_words", "hits", "items"])

    return df.mapInArrow(trimmed(run), f"{kinds}, {HITS}")


def passes(benchmark: DataFrame, window: int = WINDOW, group_words: int = GROUP_WORDS, pass_words: int = PASS_WORDS) -> Iterator[Benchmark]:
    """The items, pass_words at a time; the driver holds one pass."""
    group, n = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct().toLocalIterator():
        if ws := item_words(row["text"]):
            if n and n + len(ws) > pass_words:
                yield Benchmark(group, window, group_words)
                group, n = [], 0
            group.append((row["item_id"], ws))
            n += len(ws)
    if group:
        yield Benchmark(group, window, group_words)


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, group_words: int = GROUP_WORDS, pass_words: int = PASS_WORDS) -> DataFrame:
    """keep, n_words, hits (runs of hit words: byte start and end, first and last word + 1) and items of each document."""
    keep = keep or ["doc_id"]
    kinds = lambda cols: ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in cols)
    sc = docs.sparkSession.sparkContext
    # other columns take a prefix, so that none clashes with the results
    out = None
    src = docs.select(*dict.fromkeys([*keep, "text"]))
    for auto in passes(benchmark, window, group_words, pass_words):
        b = sc.broadcast(auto)
        if out is None:
            out = _group(src, b, list(dict.fromkeys([*keep, "text"])), kinds(dict.fromkeys([*keep, "text"])))
        else:
            kept = list(dict.fromkeys([*keep, "text"]))
            before = out.select(*kept, F.struct("hits", "items").alias("__before"))
            out = _group(before, b, [*kept, "__before"], kinds(kept) + ", __before " + dict(before.dtypes)["__before"])
            out = out.select(*kept, "n_words", F.concat("__before.hits", "hits").alias("hits"), F.array_union("__before.items", "items").alias("items"))
    if out is None:
        out = _group(src, sc.broadcast(Benchmark([], window)), list(dict.fromkeys([*keep, "text"])), kinds(dict.fromkeys([*keep, "text"])))
    return out.withColumn("hits", merged(F.col("hits")))


def merged(hits):
    """Spans of several groups, sorted and joined where they overlap or touch in words."""
    empty = F.array().cast("array<struct<start:int,end:int,first:int,last:int>>")
    make = lambda a, b, c, d: F.struct(a.alias("start"), b.alias("end"), c.alias("first"), d.alias("last"))

    def step(acc, x):
        top = F.element_at(acc, -1)
        joined = make(top["start"], F.greatest(top["end"], x["end"]), top["first"], F.greatest(top["last"], x["last"]))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["last"] >= x["first"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return F.when(F.size(hits) < 2, hits).otherwise(F.aggregate(F.array_sort(hits), empty, step))


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def remove_leaks(docs: DataFrame, benchmark: DataFrame, max_coverage: float = 0.8) -> DataFrame:
    """docs without the leaked spans, and without the documents of whose words more than max_coverage are hit. Other
    documents keep their text byte for byte; a null text stays null."""
    cols = docs.columns
    names = ["text" if c == "text" else f"c{i}" for i, c in enumerate(cols)]
    found = find_leaks(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(cols, names, strict=True))), benchmark, names)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    found = found.filter((n_hit == 0) | (n_hit <= max_coverage * F.col("n_words")))
    kinds = ", ".join(f"{n} {k}" for n, (_, k) in zip(names, docs.dtypes, strict=True))
    at = cols.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrays = [b.column(i) for i in range(len(names))]
            hits = b.column(len(names)).to_pylist()
            if any(hits):
                text = arrays[at].to_pylist()
                for i, spans in enumerate(hits):
                    if spans:
                        raw, out, z = text[i].encode(), [], 0
                        for s in spans:
                            out.append(raw[z : s["start"]])
                            z = s["end"]
                        text[i] = b"".join([*out, raw[z:]]).decode()
                arrays[at] = pa.array(text, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    clean = found.select(*names, "hits").mapInArrow(trimmed(cut), kinds)
    return clean.select(*(F.col(n).alias(c) for n, c in zip(names, cols, strict=True)))
