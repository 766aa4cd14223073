"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a written lexicon and of a learned one (words and word beginnings that labelled toxic
texts use far more than others), how near second-person words stand to lexicon words, capitals, punctuation, and
obfuscation (letters mixed with digits or signs). All are counts over the text, so its length never cuts anything.

Learning sees only rows of `labels` whose crc32(doc_id) mod 5 is not 0: at most `SAMPLE` texts of each class, drawn by a
hash of doc_id. Two fifths of them give the learned lexicon, two fifths the trees, so that the trees see terms as new texts
do, and one fifth calibrates the scores, weighted to the classes' true shares. The scoring pass covers all rows. labels, lang, source and doc_id are no inputs of a score.

Results: one row per input row. Null and empty texts have all features zero and get the score that follows. Where nothing
can be learned (no labelled rows, or one class only), scores are 0 or 1 as that class says, 0 without any. A null doc_id
counts as the text "". Several labels of one doc_id: the largest counts. Null labels are not learned from. Repeated rows get
equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ALNUM, LOWER, Block, map_blocks, rolling, words
from .langid import fold_of

SAMPLE = 10_000
TERMS = 2000
BEGINNINGS = (4, 5, 6)
NEAR = 5
SEED = 9
TREES, DEPTH, BINS, RATE, LEAF = 80, 3, 64, 0.15, 8

#: Insults and slurs, and second-person words, in four languages.
LEXICON = """
idiot idiots idiotic moron morons moronic stupid dumb dumbass fool fools foolish loser losers scum trash garbage pathetic worthless
disgusting clown clowns jerk bastard bitch crap shit bullshit fuck fucking asshole hate kill die ugly filthy vermin parasite imbecile
idiota idiotas estúpido estúpida imbécil basura asqueroso inútil payaso mierda puta cabrón tonto odio
idiote stupide imbécile crétin connard salaud merde ordure clown dégoûtant minable nul haine pourriture
dumm dummkopf blöd blödmann trottel versager abschaum müll ekelhaft erbärmlich wertlos arschloch scheiße hass depp
""".split()
SECOND = "you your yours yourself yourselves u ur tú tu tus usted ustedes vosotros te ti vous votre vos toi ton ta tes du dich dir dein deine deiner deinen ihr euch euer sie ihnen".split()

FEATURES = ["log_words", "lexicon", "lexicon_rate", "learned", "learned_rate", "learned_weight", "near", "near_rate", "second_rate", "capital_rate", "shouted_rate", "exclaim_rate", "question_rate", "sign_rate", "mixed", "mixed_rate"]


class Terms:
    """Hashes with weights, looked up for many words at once."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray):
        at = np.argsort(hashes)
        self.hashes, self.weights = hashes[at], weights[at]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hashes >> np.uint64(44)] = True

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h))
        at = np.flatnonzero(self.seen[h >> np.uint64(44)]) if len(self.hashes) else []
        if len(at):
            k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            out[at] = np.where(self.hashes[k] == h[at], self.weights[k], 0)
        return out


def word_terms(names: list[str]) -> Terms:
    r = rolling(SEED)
    bufs = [np.frombuffer(w.encode(), np.uint8) for w in dict.fromkeys(names)]
    return Terms(np.array([r.of(r.prefix(b), np.array([0]), np.array([len(b)]))[0] for b in bufs], np.uint64), np.ones(len(bufs)))


def word_hashes(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Starts, ends and text numbers of the words; their hashes, and those of their beginnings (0: not longer than that)."""
    starts, ends, doc = words(block, ALNUM)
    r = rolling(SEED)
    s = r.prefix(LOWER[block.buf])
    out = [r.of(s, starts, ends)]
    for k in BEGINNINGS:
        long = ends - starts > k
        h = r.of(s, starts, np.where(long, starts + k, ends)) ^ np.uint64(k)
        out.append(np.where(long, h, np.uint64(0)))
    return starts, ends, doc, out


def features(block: Block, learned: Terms | None, lexicon: Terms, second: Terms) -> np.ndarray:
    starts, ends, doc, hashes = word_hashes(block)
    n, rows = block.n, lambda w: np.bincount(doc, weights=w, minlength=block.n)
    n_words = np.bincount(doc, minlength=n).astype(float)
    per = np.maximum(n_words, 1)
    lex = lexicon.of(hashes[0]) > 0
    weight = np.zeros(len(doc))
    if learned is not None:
        for h in hashes:
            weight = np.maximum(weight, learned.of(h))
    bad = lex | (weight > 0)
    you = second.of(hashes[0]) > 0
    # words of the lexicon with a second-person word of the same text within NEAR words
    near = np.zeros(len(doc), bool)
    at = np.flatnonzero(you)
    if len(at):
        k = np.searchsorted(at, np.arange(len(doc)))
        for side in (np.minimum(k, len(at) - 1), np.maximum(k - 1, 0)):
            o = at[side]
            near |= (np.abs(o - np.arange(len(doc))) <= NEAR) & (doc[o] == doc)
    near &= bad
    count = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[block.off])
    buf = block.buf
    upper = (buf >= 65) & (buf <= 90)
    lower = (buf >= 97) & (buf <= 122)
    letters = np.maximum(count(upper | lower), 1)
    size = np.maximum(block.sizes, 1)
    ups = np.concatenate(([0], np.cumsum(upper)))
    shouted = (ends - starts >= 3) & (ups[ends] - ups[starts] == ends - starts)
    sign = ((buf >= 33) & (buf <= 47)) | ((buf >= 58) & (buf <= 64)) | ((buf >= 91) & (buf <= 96)) | ((buf >= 123) & (buf <= 126))
    # a digit or one of !$*@# between two letters of the same text
    digit = ((buf >= 48) & (buf <= 57)) | np.isin(buf, np.frombuffer(b"!$*@#", np.uint8))
    letter = upper | lower | (buf >= 128)
    mixed = np.zeros(len(buf), bool)
    if len(buf) > 2:
        mixed[1:-1] = digit[1:-1] & letter[:-2] & letter[2:]
    edges = block.off[(block.off > 0) & (block.off < len(buf))]
    mixed[edges] = mixed[edges - 1] = False
    m = count(mixed)
    cols = [np.log1p(n_words), rows(lex), rows(lex) / per, rows(weight > 0), rows(weight > 0) / per, rows(weight), rows(near), rows(near) / per, rows(you) / per, count(upper) / letters, rows(shouted) / per, count(buf == 33) / size, count(buf == 63) / size, count(sign) / size, m.astype(float), m / per]
    return np.stack(cols, 1)


# --- gradient-boosted trees ---------------------------------------------------------------------


@dataclass
class Boosted:
    """Trees in arrays: feature, threshold (go left if not above) for inner nodes, and leaf values, level by level."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    grid_x: np.ndarray | None = None
    grid_y: np.ndarray | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**DEPTH - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        p = 1 / (1 + np.exp(-raw))
        if self.grid_x is not None:
            p = 0.999 * np.interp(raw, self.grid_x, self.grid_y) + 0.001 * p  # the steps keep the trees' order
        return np.clip(p, 0, 1)


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Boosted:
    """Logistic loss, histogram splits, Newton leaves."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T, strict=True)], 1)
    mean = np.clip((w * y).sum() / w.sum(), 1e-6, 1 - 1e-6)
    raw = np.full(len(y), np.log(mean / (1 - mean)))
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    out = Boosted(float(raw[0]), np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves)))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = w * (y - p), w * np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            base = 2**depth - 1
            for k in range(base, 2 * base + 1):
                at = np.flatnonzero(node == k)
                best = (1e-9, 0, np.inf, None)
                if len(at) >= 2 * LEAF:
                    gs, hs, total, weight = g[at], h[at], g[at].sum(), h[at].sum()
                    for f in range(x.shape[1]):
                        if not len(cuts[f]):
                            continue
                        b = binned[at, f]
                        size = len(cuts[f]) + 1
                        gl, hl, nl = (np.cumsum(np.bincount(b, weights=v, minlength=size))[:-1] for v in (gs, hs, np.ones(len(at))))
                        gain = gl**2 / (hl + 1) + (total - gl) ** 2 / (weight - hl + 1) - total**2 / (weight + 1)
                        gain[(nl < LEAF) | (len(at) - nl < LEAF)] = -1
                        j = int(gain.argmax())
                        if gain[j] > best[0]:
                            best = (gain[j], f, cuts[f][j], b > j)
                out.feature[t, k], out.threshold[t, k] = best[1], best[2]
                node[at] = 2 * k + 1 + (best[3] if best[3] is not None else 0)
        leaf = node - inner
        value = RATE * np.bincount(leaf, weights=g, minlength=leaves) / (np.bincount(leaf, weights=h, minlength=leaves) + 1)
        out.leaf[t] = value
        raw += value[leaf]
    return out


def isotonic(raw: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points of a rising curve from raw scores to probabilities."""
    at = np.argsort(raw, kind="stable")
    blocks_: list[list[float]] = []
    for x, v, c in zip(raw[at], y[at], w[at], strict=True):
        blocks_.append([x, x, v * c, c])
        while len(blocks_) > 1 and (blocks_[-2][2] * blocks_[-1][3] >= blocks_[-1][2] * blocks_[-2][3] or blocks_[-2][1] == blocks_[-1][0]):
            b = blocks_.pop()
            blocks_[-1] = [blocks_[-1][0], b[1], blocks_[-1][2] + b[2], blocks_[-1][3] + b[3]]
    xs = np.array([v for b in blocks_ for v in (b[0], b[1])])
    return xs, np.array([b[2] / b[3] for b in blocks_ for _ in (0, 1)])


@dataclass
class Model:
    learned: Terms | None
    trees: Boosted | None
    constant: float = 0.0


def train(docs: DataFrame, labels: DataFrame) -> Model:
    spark = docs.sparkSession
    known = labels.filter((fold_of("doc_id", 5) != 0) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.when(F.col("toxic") > 0, 1).otherwise(0).alias("y"), F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 30)).alias("draw"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model(None, None, float(max(counts, default=0)))
    rate = {y: min(1.0, 1.1 * SAMPLE / n) for y, n in counts.items()}
    drawn = known.filter(F.col("draw") < F.when(F.col("y") == 1, int(rate[1] * (1 << 30))).otherwise(int(rate[0] * (1 << 30)))).groupBy("id").agg(F.max("y").alias("y"), F.first("draw").alias("draw")).collect()
    sample = {y: sorted((r["draw"], r["id"]) for r in drawn if r["y"] == y)[:SAMPLE] for y in (0, 1)}
    weight = {y: counts[y] / max(1, len(sample[y])) for y in (0, 1)}
    # the sample has 2 * SAMPLE ids at most, so it may be broadcast
    ids = spark.createDataFrame([(i, y, draw % 5) for y in (0, 1) for draw, i in sample[y]], "id long, y int, part long")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(ids), "id")

    def count_terms(block: Block) -> pa.RecordBatch | None:
        _, _, doc, hashes = word_hashes(block)
        y = block.rows.column(block.rows.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
        h = np.concatenate(hashes)
        d = np.tile(doc, len(hashes))
        ok = h != 0
        pair = np.unique(np.stack((h[ok], d[ok].astype(np.uint64)), 1), axis=0)
        if not len(pair):
            return None
        term, inv = np.unique(pair[:, 0], return_inverse=True)
        pos = np.bincount(inv, weights=y[pair[:, 1].astype(np.int64)], minlength=len(term)).astype(np.int64)
        both = np.bincount(inv, minlength=len(term)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(pos), pa.array(both)], names=["term", "pos", "both"])

    grown = map_blocks(texts.filter("part in (1, 2)").select("y", "text"), count_terms, "term long, pos long, both long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("both").alias("n"))
    n1 = max(1, sum(draw % 5 in (1, 2) for draw, _ in sample[1]))
    n0 = max(1, sum(draw % 5 in (1, 2) for draw, _ in sample[0]))
    odds = F.log((F.col("pos") + 0.5) / n1) - F.log((F.col("n") - F.col("pos") + 0.5) / n0)
    least = max(4, n1 // 100)
    told = grown.withColumn("odds", odds).filter((F.col("pos") >= least) & (F.col("odds") > 2.5)).orderBy(F.desc(F.col("odds") * F.col("pos")), "term").limit(TERMS).collect()
    learned = Terms(np.array([r["term"] for r in told], np.int64).view(np.uint64), np.array([r["odds"] for r in told], float))
    lexicon, second = word_terms(LEXICON), word_terms(SECOND)
    shared = spark.sparkContext.broadcast(learned)

    def measure(block: Block) -> pa.RecordBatch:
        x = features(block, shared.value, lexicon, second)
        cols = [block.rows.column(block.rows.schema.get_field_index(c)) for c in ("id", "y", "part")]
        return pa.RecordBatch.from_arrays([*cols, pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "part", "x"])

    rows = map_blocks(texts.filter("part not in (1, 2)").select("id", "y", "part", "text"), measure, "id long, y int, part long, x array<double>").collect()
    if not rows:
        return Model(None, None, 0.0)
    rows.sort(key=lambda r: (r["id"], r["x"]))
    x, y, tuning = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float), np.array([r["part"] == 0 for r in rows])
    w = np.where(y > 0, weight[1], weight[0])
    if len(set(y[~tuning])) < 2:
        return Model(None, None, float(y.max()))
    trees = boost(x[~tuning], y[~tuning], np.sqrt(w[~tuning]))
    if len(set(y[tuning])) == 2:
        trees.grid_x, trees.grid_y = isotonic(trees.raw(x[tuning]), y[tuning], w[tuning])
    return Model(learned, trees)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the features' names with their values, for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(block: Block) -> pa.RecordBatch:
        m = shared.value
        x = features(block, m.learned, lexicon, second)
        s = m.trees.score(x) if m.trees else np.full(block.n, m.constant)
        return pa.RecordBatch.from_arrays([block.rows.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    lexicon, second = word_terms(LEXICON), word_terms(SECOND)
    return map_blocks(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int")


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return score(docs, train(docs, labels)).select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", "predicted")

