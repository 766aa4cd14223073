"""SentencePiece encoding and decoding with seeded merge-dropout.

The vocabulary is a merge-type model file, read with the sentencepiece library and never trained. An agenda merges, in each
word, the adjacent pair whose joint piece scores best, the leftmost among equals. With dropout p, a candidate merge is skipped
if the keyed hash of (seed, doc_id, the word's place in the text, start, middle, end) falls below p; a skipped pair stays skipped until one of its
sides changes, as in an agenda that drops what it skips. A seed thus gives one segmentation of each text, another seed
another, the same on every executor and in every retry; p = 0 gives the model's own encoding.

Words of a block are segmented together, as matrices of words with equally many characters; longer words use a heap.

Encoding is lossless whatever the dropout: characters without a piece become byte pieces, and so does a literal U+2581,
because decoding reads that mark as a space. Results: one row per input row; null and empty texts have no tokens and decode
to the empty text. A null doc_id keys like 0. Repeated rows get equal tokens. No rows give no rows. Other columns are ignored.
Texts and words of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Block, lists, map_blocks, mix, trimmed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 5
LONG = 48
U64 = np.uint64
NEVER = np.int32(2**31 - 1)
SPACE = "▁"
NORMAL, USER = 1, 4


class Vocabulary:
    """Pieces, merges and byte pieces of a model."""

    def __init__(self, data: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = sp.get_piece_size()
        self.size = n
        skip = [sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        pieces = [sp.id_to_piece(i) for i in range(n)]
        if inner := [p for p, s in zip(pieces, skip, strict=True) if not s and SPACE in p.lstrip(SPACE)]:
            raise ValueError(f"pieces that cross words: {inner[:3]}")
        ids = {p: i for i, (p, s) in enumerate(zip(pieces, skip, strict=True)) if not s}
        self.bytes = np.full(256, -1, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.bytes[int(pieces[i][1:-1], 16)] = i
        if (self.bytes < 0).any():
            raise ValueError("the model has no byte pieces, so it cannot be lossless")
        self.chars = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        self.chars[0x20], self.chars[0x2581] = ids[SPACE], -1
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in ids.values()}, reverse=True))}
        merges = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    merges[a * n + b] = (order[sp.get_score(i)], i)
        self._table(merges)
        text = [b"" if s else p.replace(SPACE, " ").encode() for p, s in zip(pieces, skip, strict=True)]
        for b, i in enumerate(self.bytes):
            text[i] = bytes([b])
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.at = np.concatenate(([0], np.cumsum([len(t) for t in text]))).astype(np.int64)

    def _table(self, merges: dict[int, tuple[int, int]]) -> None:
        """Two-choice hashing: each key stands at one of two places."""
        bits = max(4, (4 * len(merges)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mults = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))
        keys = np.array(list(merges), np.int64)
        places = [((keys.astype(np.uint64) * m) >> self.shift).astype(np.int64).tolist() for m in self.mults]
        slot: list[int] = [-1] * (1 << bits)
        for k in range(len(keys)):
            cur, side = k, 0
            for _ in range(500):
                at = places[side][cur]
                cur, slot[at] = slot[at], cur
                if cur < 0:
                    break
                side = 1 if places[0][cur] == at else 0
            else:
                raise ValueError("the merge table is too full")
        slot_ = np.array(slot)
        on = slot_ >= 0
        self.keys = np.full(len(slot_), -1, np.int64)
        self.keys[on] = keys[slot_[on]]
        values = np.array(list(merges.values()), np.int32).reshape(-1, 2)
        self.ranks, self.made = np.full(len(slot_), NEVER, np.int32), np.full(len(slot_), -1, np.int32)
        self.ranks[on], self.made[on] = values[slot_[on], 0], values[slot_[on], 1]

    def merge(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NEVER: no such piece) and piece of each pair."""
        key = a.astype(np.int64) * self.size + b
        u = key.astype(np.uint64)
        one = ((u * self.mults[0]) >> self.shift).astype(np.int64)
        two = ((u * self.mults[1]) >> self.shift).astype(np.int64)
        at = np.where(self.keys[one] == key, one, two)
        ok = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(ok, self.ranks[at], NEVER), self.made[at]


@lru_cache(2)
def vocabulary(data: bytes) -> Vocabulary:
    return Vocabulary(data)


def skipped(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, below: int) -> np.ndarray:
    span = (start.astype(np.uint64) << U64(42)) | (middle.astype(np.uint64) << U64(21)) | end.astype(np.uint64)
    return mix(key ^ mix(span + U64(1))) < U64(below)


def segment_long(v: Vocabulary, syms: np.ndarray, key: np.uint64, below: int) -> list[int]:
    """One word by an agenda on a heap."""
    n = len(syms)
    sym, start = syms.tolist(), list(range(n))
    prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
    end = list(range(1, n + 1))
    rank, made = v.merge(syms[:-1], syms[1:])
    heap = [(int(r), i, int(m), i + 1, i + 2) for i, (r, m) in enumerate(zip(rank, made, strict=True)) if r != NEVER]
    heapq.heapify(heap)
    k = np.array([key], np.uint64)

    def offer(a: int, b: int) -> None:
        r, m = v.merge(np.array([sym[a]]), np.array([sym[b]]))
        if r[0] != NEVER:
            heapq.heappush(heap, (int(r[0]), start[a], int(m[0]), start[b], end[b]))

    dead = [False] * n
    while heap:
        _, a, m, mid, stop = heapq.heappop(heap)
        b = mid
        if dead[a] or dead[b] or nxt[a] != b or end[a] != mid or end[b] != stop:
            continue
        if below and skipped(k, np.array([a]), np.array([mid]), np.array([stop]), below)[0]:
            continue
        sym[a], end[a], dead[b] = m, stop, True
        nxt[a] = nxt[b]
        if nxt[a] < n:
            prev[nxt[a]] = a
            offer(a, nxt[a])
        if prev[a] >= 0:
            offer(prev[a], a)
    return [s for s, d in zip(sym, dead, strict=True) if not d]


def segment_equal(v: Vocabulary, sym: np.ndarray, key: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Words with equally many characters, as rows; gives rows of symbols and how many of each row hold."""
    n, width = sym.shape
    sym, size = sym.copy(), np.full(n, width)
    start = np.broadcast_to(np.arange(width + 1, dtype=np.int32), (n, width + 1)).copy()
    if width == 1:
        return sym, size
    rank, made = v.merge(sym[:, :-1], sym[:, 1:])
    if below:
        rank = np.where(skipped(key[:, None], start[:, :-2], start[:, 1:-1], start[:, 2:], below), NEVER, rank)
    out = np.full((n, width), -1, np.int32)
    live = np.arange(n)
    while True:
        best = rank.argmin(1)
        rows = np.arange(len(live))
        on = rank[rows, best] != NEVER
        if not on.all():
            done = ~on
            out[live[done], : sym.shape[1]] = sym[done]
            size[live[done]] = sym.shape[1]
            if not on.any():
                return out, size
            live, sym, start, rank, made, key, best = live[on], sym[on], start[on], rank[on], made[on], key[on], best[on]
            rows = rows[: len(live)]
        sym[rows, best] = made[rows, best]
        # all live rows have lost equally many symbols: one each round
        w = sym.shape[1]
        drop = np.ones((len(live), w), bool)
        drop[rows, best + 1] = False
        sym = sym[drop].reshape(len(live), w - 1)
        if w == 2:
            out[live, :1] = sym
            size[live] = 1
            return out, size
        hold = np.ones((len(live), w + 1), bool)
        hold[rows, best + 1] = False
        start = start[hold].reshape(len(live), w)
        keep = np.ones((len(live), w - 1), bool)
        keep[rows, best] = False
        rank, made = rank[keep].reshape(len(live), w - 2), made[keep].reshape(len(live), w - 2)
        for side in (-1, 0):  # the pairs on both sides of the new symbol
            p = best + side
            ok = np.flatnonzero((p >= 0) & (p < w - 2))
            pk = p[ok]
            r, m = v.merge(sym[ok, pk], sym[ok, pk + 1])
            if below:
                r = np.where(skipped(key[ok], start[ok, pk], start[ok, pk + 1], start[ok, pk + 2], below), NEVER, r)
            rank[ok, pk], made[ok, pk] = r, m


def codepoints(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The block's characters, and each text's first one."""
    cps = np.frombuffer(block.buf.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    try:
        block.buf.tobytes().decode()
        lead = np.concatenate(([0], np.cumsum((block.buf & 0xC0) != 0x80)))
        return cps, lead[block.off]
    except UnicodeDecodeError:
        parts = [np.frombuffer(block.text(i).decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32) for i in range(block.n)]
        return np.concatenate([*parts, np.zeros(0, np.uint32)]), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


def utf8(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of characters one after the other, and how many each has; an escaped byte is itself."""
    made = [bytes([c - 0xDC00]) if 0xDC80 <= c <= 0xDCFF else chr(c).encode() for c in cps.tolist()]
    return np.frombuffer(b"".join(made), np.uint8), np.array([len(b) for b in made], np.int64)


def encode(block: Block, v: Vocabulary, doc_keys: np.ndarray, dropout: float = DROPOUT) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of the block's texts, in order, and how many each text has."""
    raw, off = codepoints(block)
    sizes = np.diff(off)
    full = np.flatnonzero(sizes)
    if not len(full):
        return np.zeros(0, np.int32), np.zeros(block.n, np.int64)
    # a space before each text
    first = off[full] + np.arange(len(full))
    cps = np.empty(len(raw) + len(full), np.uint32)
    own = np.ones(len(cps), bool)
    own[first] = False
    cps[own], cps[first] = raw, 0x20
    doc = np.repeat(full, sizes[full] + 1)
    # words: a run of spaces with what follows; a line end is a word of its own
    sp, nl = cps == 0x20, cps == 0x0A
    begin = np.zeros(len(cps), bool)
    begin[first] = True
    begin[1:] |= (sp[1:] & ~sp[:-1]) | nl[1:] | nl[:-1]
    start = np.flatnonzero(begin)
    size = np.diff(np.append(start, len(cps)))
    below = min((1 << 64) - 1, int(dropout * (1 << 64)))
    if below:
        # each occurrence of a word is drawn for itself, by its text's key and its place
        base = np.zeros(block.n, np.int64)
        base[full] = first
        key = mix(doc_keys[doc[start]] + mix((start - base[doc[start]]).astype(np.uint64)))
        pick = inverse = np.arange(len(start))
    else:
        # equal words have equal pieces
        rng = np.random.default_rng(77)
        p, t = int(rng.integers(0, 1 << 60)) * 8 + 5, rng.integers(1, 1 << 63, 1 << 11, dtype=np.uint64)
        power = _powers(p, int(size.max()) + 1)
        inside = np.arange(len(cps)) - np.repeat(start, size)
        term = (t[cps & 2047] + cps.astype(np.uint64) * U64(0x9E3779B97F4A7C15)) * power[inside]
        key = mix(np.add.reduceat(term, start) + size.astype(np.uint64))
        _, pick, inverse = np.unique(key, return_index=True, return_inverse=True)
    syms = v.chars[cps]
    count = np.zeros(len(pick), np.int64)
    made: list = []
    for width in np.unique(size[pick]):
        at = np.flatnonzero(size[pick] == width)
        where = start[pick[at]]
        if width > LONG:
            for i, w in zip(at, where, strict=True):
                got = _long(v, syms[w : w + width], cps[w : w + width], key[pick[i]], below)
                count[i] = len(got)
                made.append((np.array([i]), got[None, :], np.array([len(got)])))
            continue
        for z in range(0, len(at), 1 << 15):
            part, wp = at[z : z + (1 << 15)], where[z : z + (1 << 15)]
            window = wp[:, None] + np.arange(width)
            s = syms[window]
            coded = np.where(s < 0, -1 - cps[window].astype(np.int64), s).astype(np.int32)  # what has no piece goes by its character
            out, n = segment_equal(v, coded, key[pick[part]], below)
            count[part] = n
            made.append((part, out, n))
    at = np.concatenate(([0], np.cumsum(count)))
    flat = np.empty(at[-1], np.int32)
    for part, out, n in made:
        cols = np.arange(out.shape[1])
        ok = cols[None, :] < n[:, None]
        flat[(at[part][:, None] + cols)[ok]] = out[ok]
    # each occurrence of a word
    n = count[inverse]
    stop = np.cumsum(n)
    tokens = flat[np.repeat(at[inverse] - (stop - n), n) + np.arange(stop[-1])]
    per_text = np.bincount(doc[start], weights=n, minlength=block.n).astype(np.int64)
    odd = tokens < 0
    if odd.any():
        data, k = utf8(-1 - tokens[odd].astype(np.int64))
        times = np.ones(len(tokens), np.int64)
        times[odd] = k
        text = np.repeat(np.arange(block.n), per_text)
        per_text = np.bincount(text, weights=times, minlength=block.n).astype(np.int64)
        wide = np.repeat(tokens, times)
        wide[wide < 0] = v.bytes[data]
        tokens = wide
    return tokens, per_text


def _long(v: Vocabulary, s: np.ndarray, cps: np.ndarray, key: np.uint64, below: int) -> np.ndarray:
    return np.array(segment_long(v, np.where(s < 0, -1 - cps.astype(np.int64), s), key, below), np.int32)


@lru_cache(8)
def _grown(p: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(p))
    out[0] = 1
    return np.multiply.accumulate(out)


def _powers(p: int, n: int) -> np.ndarray:
    return _grown(p, 1 << max(8, (n - 1).bit_length()))


def decode(tokens: np.ndarray, per_text: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, one after the other, and how many each has."""
    n = v.at[tokens + 1] - v.at[tokens]
    stop = np.cumsum(n)
    total = int(stop[-1]) if len(stop) else 0
    data = v.text[np.repeat(v.at[tokens] - (stop - n), n) + np.arange(total)]
    at = np.concatenate(([0], np.cumsum(per_text)))
    edges = np.concatenate(([0], stop))[at]
    full = np.flatnonzero(per_text)
    keep = np.ones(total, bool)
    keep[edges[:-1][full]] = False  # the space before the text
    return data[keep], np.diff(edges) - (per_text > 0)


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _mapped(docs: DataFrame, path: str, seed: int, dropout: float, give, schema: str) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(_model_bytes(path))

    def kernel(block: Block) -> pa.RecordBatch:
        v = vocabulary(shared.value)
        ids = block.rows.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        return give(block, v, *encode(block, v, mix(ids + mix(np.full(len(ids), np.uint64(seed)))), dropout))

    return map_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, schema)


def encode_documents(docs: DataFrame, path: str = MODEL, seed: int = SEED, dropout: float = DROPOUT) -> DataFrame:
    """doc_id, tokens, n_tokens."""

    def give(block: Block, v: Vocabulary, tokens: np.ndarray, per_text: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([block.rows.column(0), lists(tokens, per_text, pa.int32()), pa.array(per_text)], names=["doc_id", "tokens", "n_tokens"])

    return _mapped(docs, path, seed, dropout, give, "doc_id long, tokens array<int>, n_tokens long")


def decode_documents(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, text, from doc_id and tokens; null tokens give the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(_model_bytes(path))

    def run(batches):
        v = vocabulary(shared.value)
        for b in batches:
            for z in range(0, b.num_rows, 500):
                part = b.slice(z, 500)
                got = part.column(1).combine_chunks() if isinstance(part.column(1), pa.ChunkedArray) else part.column(1)
                per = got.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                data, n = decode(got.flatten().to_numpy(zero_copy_only=False), per, v)
                at = np.concatenate(([0], np.cumsum(n)))
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([raw[x:y].decode("utf-8", "replace") for x, y in zip(at, at[1:], strict=False)], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "tokens").mapInArrow(trimmed(run), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str = MODEL, seed: int = SEED, dropout: float = DROPOUT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_byte_tokens, tokens_sha256 (of 4 bytes each, lowest first), decoded_sha256, lossless."""

    def give(block: Block, v: Vocabulary, tokens: np.ndarray, per_text: np.ndarray) -> pa.RecordBatch:
        data, n = decode(tokens, per_text, v)
        a, b = np.concatenate(([0], np.cumsum(per_text))), np.concatenate(([0], np.cumsum(n)))
        raw, out = tokens.astype("<i4").tobytes(), data.tobytes()
        is_byte = np.zeros(v.size, np.int64)
        is_byte[v.bytes] = 1
        odd = np.concatenate(([0], np.cumsum(is_byte[tokens])))
        sha = [hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(a, a[1:], strict=False)]
        texts = [out[x:y] for x, y in zip(b, b[1:], strict=False)]
        return pa.RecordBatch.from_arrays(
            [block.rows.column(0), pa.array(block.sizes), pa.array(per_text), pa.array(odd[a[1:]] - odd[a[:-1]]), pa.array(sha, pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array([t == block.text(i) for i, t in enumerate(texts)], pa.bool_())],
            names=["doc_id", "n_bytes", "n_tokens", "n_byte_tokens", "tokens_sha256", "decoded_sha256", "lossless"],
        )

    return _mapped(docs, path, seed, dropout, give, "doc_id long, n_bytes long, n_tokens long, n_byte_tokens long, tokens_sha256 string, decoded_sha256 string, lossless boolean")
