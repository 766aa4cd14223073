"""Language identification with a string kernel.

A text is the set of its byte n-grams of length 1 to `GRAMS` (a blended spectrum), hashed to `DIM` places; the kernel of two
texts is the number of shared places over the root of the product of their numbers. Nyström landmarks stand for the training
texts, kernel ridge regression separates each language from the rest, and texts are scored by batched matrix products.

Training sees a sample of labelled texts, drawn by a hash of doc_id: `TRAIN_PER_LANG` of each language and `TRAIN` in all,
shared out evenly; of these, `LANDMARKS_PER_LANG` of each and `LANDMARKS` in all are landmarks (32 MB, which is what is
broadcast). Of more than `LANGS` languages the ones with most texts are learned. Everything else covers all rows. lang, source
and doc_id are no inputs of a prediction.

Results: one row per input row. A text that is null or has no letter is `und` with score 0, and so is every text where
nothing can be learned (no labelled text, an empty table). Texts without letters and null langs are not learned from. A null
doc_id counts as the text "". Ties of scores go to the language that sorts first. Repeated rows get equal predictions. Texts of
any length are read whole. Columns of clashing names (lang_pred, score, x, draw) are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import Block, blocks, map_blocks, trimmed

GRAMS = 3
DIM = 8192
TRAIN, TRAIN_PER_LANG = 8000, 500
LANDMARKS, LANDMARKS_PER_LANG = 1024, 64
LANGS = 1000
RIDGE = 1e-2
ROWS = 256
UND = "und"
#: The score below which keep_languages() rejects a text.
LEAST = 0.3


def fold_of(doc_id: str, folds: int) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def has_letter(block: Block) -> np.ndarray:
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    count = np.concatenate(([0], np.cumsum(ascii_letter[block.buf])))
    out = count[block.off[1:]] > count[block.off[:-1]]
    far = np.concatenate(([0], np.cumsum(block.buf >= 128)))
    for i in np.flatnonzero(~out & (far[block.off[1:]] > far[block.off[:-1]])):
        out[i] = any(c.isalpha() for c in block.text(i).decode())
    return out


def presence(block: Block, a: int, b: int) -> np.ndarray:
    """Which places the texts a to b of the block have."""
    lo, hi = block.off[a], block.off[b]
    buf = block.buf[lo:hi].astype(np.uint32)
    off = block.off[a : b + 1] - lo
    out = np.zeros((b - a, DIM), np.uint8)
    row = np.repeat(np.arange(b - a, dtype=np.int64) * DIM, np.diff(off))
    end = np.repeat(off[1:], np.diff(off))
    gram = np.zeros(len(buf), np.uint32)
    flat, shift = out.ravel(), np.uint32(32 - DIM.bit_length() + 1)
    for n in range(GRAMS):
        m = len(buf) - n
        if m <= 0:
            break
        gram = gram[:m] * np.uint32(257) * np.uint32(31) + buf[n:] + np.uint32(1)
        h = (gram * np.uint32(2654435761)) ^ np.uint32(n * 0x9E3779B9 & 0xFFFFFFFF)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519) >> shift
        ok = end[:m] - np.arange(m) > n
        flat[(row[:m] + h)[ok]] = 1
    return out


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # (places, landmarks), over the root of their sizes
    weights: np.ndarray  # (landmarks, languages)

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float32)
        size = np.maximum(x.sum(1, keepdims=True), 1)
        return (x @ self.landmarks) / np.sqrt(size) @ self.weights


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def fit(langs: list[str], x: np.ndarray, per_lang: int = LANDMARKS_PER_LANG) -> Model | None:
    """From the presence rows of labelled texts, in a fixed order. The texts go through in blocks."""
    if not langs:
        return None
    names = sorted(set(langs))
    y = np.searchsorted(names, langs)
    share = max(1, min(per_lang, LANDMARKS // len(names)))
    picks = np.concatenate([np.flatnonzero(y == k)[:share] for k in range(len(names))])[:LANDMARKS]
    land = unit(x[picks])
    value, vector = np.linalg.eigh((land @ land.T).astype(np.float64))
    root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
    # each language counts the same, whatever its number of texts
    w = (1.0 / np.bincount(y, minlength=len(names)))[y][:, None]
    gram, right = np.zeros((len(land), len(land))), np.zeros((len(land), len(names)))
    for a in range(0, len(y), ROWS):
        b = slice(a, a + ROWS)
        phi = (unit(x[b]) @ land.T).astype(np.float64) @ root
        gram += phi.T @ (w[b] * phi)
        right += phi.T @ (w[b] * np.where(y[b][:, None] == np.arange(len(names)), 1.0, -1.0))
    beta = np.linalg.solve(gram + RIDGE * w.mean() * np.eye(len(land)), right)
    return Model(names, np.ascontiguousarray(land.T), (root @ beta).astype(np.float32))


def train(docs: DataFrame) -> Model | None:
    """Learns from the rows with lang and text whose crc32(doc_id) mod 3 is not 1."""
    known = docs.filter((fold_of("doc_id", 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("draw")
    )
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()}
    if not counts:
        return None
    share = max(1, min(TRAIN_PER_LANG, TRAIN // len(counts)))
    # about a fifth more than are needed, then exactly as many
    below = F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, min(1 << 30, int((1 << 30) * (1.2 * share + 50) / n)))))

    def kernel(block: Block) -> pa.RecordBatch:
        ok = has_letter(block)
        packed = [np.packbits(presence(block, i, i + 1)[0]).tobytes() if ok[i] else None for i in range(block.n)]
        return pa.RecordBatch.from_arrays([*(block.rows.column(i) for i in range(3)), pa.array(packed, pa.binary())], names=["doc_id", "lang", "draw", "x"])

    drawn = map_blocks(known.filter(F.col("draw") < below[F.col("lang")]).select("doc_id", "lang", "draw", "text"), kernel, "doc_id string, lang string, draw long, x binary").filter("x is not null")
    rows = sorted(((r["draw"], r["doc_id"] or "", r["lang"], bytes(r["x"])) for r in drawn.collect()))
    taken: dict[str, int] = {}
    keep = [r for r in rows if (taken.update({r[2]: taken.get(r[2], 0) + 1}) or taken[r[2]] <= share)]
    if not keep:
        return None
    return fit([r[2] for r in keep], np.unpackbits(np.frombuffer(b"".join(r[3] for r in keep), np.uint8).reshape(len(keep), -1), axis=1)[:, :DIM])


def predict(docs: DataFrame, model: Model | None, keep: list[str], letters: bool = False) -> DataFrame:
    """keep, lang_pred and score, in one pass over the whole texts. keep may hold text. letters: without a model, texts that have
    a letter get score 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)
    cols = list(dict.fromkeys([*keep, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for block in blocks(batch):
                best, score = np.full(block.n, -1), np.zeros(block.n)
                if m is not None:
                    ok = has_letter(block)
                    for a in range(0, block.n, ROWS):
                        b = min(block.n, a + ROWS)
                        s = m.scores(presence(block, a, b)).astype(np.float64)
                        p = np.exp(4 * (s - s.max(1, keepdims=True)))
                        best[a:b] = np.where(ok[a:b], s.argmax(1), -1)
                        score[a:b] = np.where(ok[a:b], 1 / p.sum(1), 0)
                elif letters:
                    score = has_letter(block).astype(float)
                names = pa.array([m.langs[k] if k >= 0 else UND for k in best] if m else [UND] * block.n, pa.string())
                yield pa.RecordBatch.from_arrays([*(block.rows.column(cols.index(c)) for c in keep), names, pa.array(np.clip(score, 0, 1))], names=[*keep, "lang_pred", "score"])

    return docs.select(*cols).mapInArrow(trimmed(run), ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string", "score double"]))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    found = predict(docs.select("doc_id", "text"), train(docs), ["doc_id"])
    return found.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def keep_languages(docs: DataFrame, least: float = LEAST, wanted: list[str] | None = None) -> DataFrame:
    """docs without the rows that have no language: null texts, texts without a letter, and those whose best language has a
    score below `least`; with wanted, also those of other languages. Where nothing can be learned, all texts with a letter
    stay. Columns stay as they are."""
    model = train(docs)
    names = {c: "text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)}
    found = predict(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), model, list(names.values()), letters=model is None)
    ok = F.col("score") >= (least if model is not None else 1)
    if wanted is not None and model is not None:
        ok &= F.col("lang_pred").isin(wanted)
    return found.filter(ok).select(*(F.col(n).alias(c) for n, c in zip(names.values(), names, strict=True)))
