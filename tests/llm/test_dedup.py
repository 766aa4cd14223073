"""Deduplication operators against brute force, with nulls, empties, ties, repeats and clashing columns."""

import random

import brute
import numpy as np
import pytest

from graphloom.llm import components, doubling, paragraphs, pivots, simhash, suffixes

DOCS = "doc_id long, text string"


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = ["alpha", "beta", "gamma", "é", "delta", "ab", "zz", "漢字", "the", "of", "X"] + [f"w{k}" for k in range(200)]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passages = [text(rng.randint(22, 60)) for _ in range(8)]

    def edited(p):
        w = p.split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        return " ".join(w)

    rows = [(None, passages[0]), (None, None), (5, None), (6, ""), (7, "x" * 200), (8, "x" * 49), (9, "x" * 50), (10, "ab" * 100), (3, "ab" * 90)]
    rows += [(d, rng.choice(["\n", " "]).join(edited(rng.choice(passages)) if rng.random() < 0.5 else text(rng.randint(1, 30)) for _ in range(rng.randint(0, 5)))) for d in range(11, 11 + n)]
    return [*rows, rows[15], (11, "other " + passages[3]), (200, rows[20][1]), (201, rows[20][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_suffixes(spark, seed):
    rows = corpus(seed)
    got = suffixes.find_repeats(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute.repeats(rows), key=str)


def test_suffixes_large_groups(spark, monkeypatch):
    """Groups beyond the limit take the other way; the limit travels with the kernel's code."""
    monkeypatch.setattr(suffixes, "STRINGS", 50)
    rows = corpus(3, 30)
    df = spark.createDataFrame(rows, DOCS).repartition(2)
    want = sorted(map(tuple, suffixes.find_repeats(df).collect()), key=str)
    assert want == sorted(brute.repeats(rows), key=str)


@pytest.fixture
def batches_of_two(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("held", [1 << 18, 3])
def test_shared_rows_across_batches(spark, batches_of_two, monkeypatch, held):
    """All rows of a key whose second owner comes batches later; beyond HELD they wait in a file."""
    monkeypatch.setattr(suffixes, "HELD", held, raising=False)
    rows = [(1, 7, 0, k) for k in range(9)] + [(1, 8, 0, 9)] + [(2, 7, 0, k) for k in range(10, 15)] + [(3, 9, suffixes.PASS, 15), (4, 5, suffixes.SHARED, 16)]
    df = spark.createDataFrame(rows, "key long, who long, flag int, n long")
    got = suffixes.shared_rows(df, "key", "who", "flag").collect()
    assert sorted(r.n for r in got) == [*range(10), 15, 16]


def test_suffixes_small_batches(spark, batches_of_two):
    """A document that repeats one segment, next to a partly equal one of a smaller document."""
    rng = random.Random(7)
    line = "".join(rng.choice("abcdefghij") for _ in range(90))
    rows = [*corpus(1, 20), (1000, line[:70] + "#" * 20), *((1001 + d, "|".join(line + "!" * 20 for _ in range(30))) for d in range(2))]
    got = suffixes.find_repeats(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute.repeats(rows), key=str)


def test_suffixes_keep_columns(spark):
    rows = [(1, "y" * 60, "a", 9), (2, "z" + "y" * 60 + "é" * 3, "b", 8), (3, None, "c", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, starts string, tag int")
    assert sorted(map(tuple, suffixes.remove_repeats(df).collect())) == sorted([(1, "y" * 60, "a", 9), (2, "z" + "é" * 3, "b", 8), (3, None, "c", 7)], key=lambda r: r[0])


@pytest.mark.parametrize("seed", [1, 2])
def test_simhash(spark, seed):
    rows = corpus(seed)
    got = simhash.digest(simhash.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute.near_copies(rows), key=str)


def test_simhash_links_are_complete():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    every = [base]
    for k in range(1, 6):
        f = base.copy()
        for i in range(len(f)):
            for b in rng.choice(64 if i % 2 else 20, k, replace=False):
                f[i] ^= np.uint64(1 << int(b))
        every.append(f)
    fp = np.unique(np.concatenate(every))
    keys, owners = [], []
    for k, (at, width) in enumerate(simhash.PARTS):
        rest = (fp & np.uint64((1 << at) - 1)) | ((fp >> np.uint64(at + width)) << np.uint64(at))
        flips = np.concatenate((np.zeros(1, np.uint64), np.uint64(1) << np.arange(64 - width, dtype=np.uint64)))
        keys.append(((rest[:, None] ^ flips) | (np.uint64(k + 1) << np.uint64(62))).ravel())
        owners.append(np.repeat(fp, len(flips)))
    a, b = simhash.bucket_links(np.concatenate(keys), np.concatenate(owners))
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3, 1))
    want = components.union(fp[i].view(np.int64), fp[j].view(np.int64))
    got = components.union(a.view(np.int64), b.view(np.int64))
    assert np.array_equal(want[0], got[0]) and np.array_equal(want[1], got[1])


def test_simhash_drop(spark):
    df = spark.createDataFrame([(1, "a b c d", "x"), (2, "a b c d", "y"), (3, "other words are here", "z"), (None, "a b c d", "n")], "doc_id long, text string, component_id string")
    assert sorted(r["component_id"] for r in simhash.drop_near_duplicates(df).collect()) == ["n", "x", "z"]


@pytest.mark.parametrize(("seed", "inner"), [(1, True), (2, True), (3, True), (1, False)])
def test_paragraphs(spark, seed, inner):
    """All columns, as registered and without inner passages."""
    rows = passages(seed)
    got = paragraphs.find_repeats(spark.createDataFrame(rows, DOCS).repartition(3), inner).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute.paragraph_cuts(rows, inner), key=str)
    assert sum(r.n_removed for r in got) > 500


def passages(seed):
    """The corpus, and passages inside longer lines and across them."""
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(900)}"
    shared = [[word() for _ in range(rng.randint(30, 80))] for _ in range(4)]
    more = []
    for d in range(300, 330):
        w = [word() for _ in range(rng.randint(5, 60))] + rng.choice(shared) + [word() for _ in range(rng.randint(0, 60))]
        n = rng.choice([7, 25, 400])
        more.append((d, "\n".join(" ".join(w[k : k + n]) for k in range(0, len(w), n))))
    return [*corpus(seed, 40), *more]


def shared_ids(n):
    """Many rows without a doc_id, and many of one, that differ; and documents that hold parts of some."""
    rng = random.Random(9)
    body = lambda: " ".join(f"t{rng.randrange(4000)}" for _ in range(24))
    rows = [(None, body()) for _ in range(n)] + [(77, body()) for _ in range(n)]
    rows += [(k, f"{body()}\n{rng.choice(rows)[1]}\n{body()}") for k in range(20)] + [(500 + k, f"{body()}\n{rng.choice(rows)[1]}") for k in range(20)]
    return rows


def test_suffixes_shared_ids(spark):
    """Texts of one doc_id, or of none, do not exchange their cuts."""
    rows = shared_ids(1500)
    got = suffixes.find_repeats(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute.repeats(rows), key=str)


def test_paragraphs_shared_ids(spark):
    rows = shared_ids(400)
    got = paragraphs.find_repeats(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute.paragraph_cuts(rows), key=str)


@pytest.mark.parametrize("seed", [1, 4])
def test_plain_doubling(spark, seed):
    """The method's plain form gives the same rows as the sampled one and as brute force."""
    rows = corpus(seed, 40)
    got = suffixes.find_repeats(spark.createDataFrame(rows, DOCS).repartition(3), doubling.repeated).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute.repeats(rows), key=str)
    assert suffixes.find_repeats(spark.createDataFrame([], DOCS), doubling.repeated).count() == 0


def test_suffixes_periodic(spark, monkeypatch):
    """Texts with periods, cut into segments, by both ways of settling strings."""
    rng = random.Random(4)
    unit = ["ab", "abc ", "etre ", "q" * 31 + "x", "w" * 3 + "e" * 45]
    rows = [(k, rng.choice(["", "x", "lead "]) + u * rng.randint(3, 400 // len(u) + 3) + rng.choice(["", "tail", u[:1]])) for k in range(30) for u in [rng.choice(unit)]]
    monkeypatch.setattr(suffixes, "SEGMENT", 64)
    for most in (1 << 16, 40):
        monkeypatch.setattr(suffixes, "STRINGS", most)
        got = suffixes.find_repeats(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
        assert sorted(map(tuple, got), key=str) == sorted(brute.repeats(rows), key=str)


def test_long_texts(spark):
    """Texts of many blocks' size, one of them periodic, a third with a very long line."""
    rng = random.Random(3)
    long = " ".join(f"u{rng.randrange(10**6)}" for _ in range(30_000))
    rows = [(1, long), (2, "head " + long + " tail"), (3, "ab" * 200_000), (4, "x" + "ab" * 100_000), (5, long[1000:3000])]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in suffixes.find_repeats(df).collect()}
    assert [got[k].n_removed for k in (1, 3, 5)] == [0, 0, 2000] and got[2].n_removed == len(long) and got[4].n_removed == 200_000
    got = {r.doc_id: r for r in paragraphs.find_repeats(df).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == len("head " + long + " tail") and got[5].n_removed > 1900


def test_extra_columns(spark):
    """Columns named like those of the operators' own tables are ignored, or kept as they are."""
    clash = "row long, tag string, starts int, __id int, __row string, at int, node int"
    rows = [(1, "y z " * 30, 5, "a", 1, 2, "b", 3, 4), (2, "q " + "y z " * 30, 6, "c", 2, 3, "d", 4, 5)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, {clash}")
    plain = df.select("doc_id", "text")
    for find in (suffixes.find_repeats, paragraphs.find_repeats):
        assert sorted(map(tuple, find(df).collect())) == sorted(map(tuple, find(plain).collect()))
    kept = {r.doc_id: tuple(r)[2:] for r in suffixes.remove_repeats(df.drop("__id", "__row")).collect()}
    assert kept == {1: (5, "a", 1, 3, 4), 2: (6, "c", 2, 4, 5)}


def test_paragraph_inside_a_line(spark):
    rng = random.Random(4)
    text = lambda k: " ".join(f"v{rng.randrange(5000)}" for _ in range(k))
    p = text(60)
    rows = [(1, p), (2, text(40) + " " + p + " " + text(40)), (3, text(80)), (4, "short line here\n" + text(30)), (5, "short line here\n" + text(30))]
    got = {r.doc_id: r for r in paragraphs.find_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[2].n_removed == len(p) and got[2].component_id == 1
    assert [got[k].n_removed for k in (1, 3, 4, 5)] == [0, 0, 0, 0] and got[5].component_id == 5


def test_paragraphs_of_short_lines(spark):
    """Copies, wrapped passages, lists and short texts; runs end at blank lines, and short ones join others."""
    rng = random.Random(8)
    text = lambda k: [f"v{rng.randrange(5000)}" for _ in range(k)]
    wrap = lambda w, n: "\n".join(" ".join(w[k : k + n]) for k in range(0, len(w), n))
    p, q, tale = text(40), text(70), wrap(text(90), 9)
    rows = [(1, tale), (2, tale), (3, wrap(p, 10)), (4, wrap(text(12), 6) + "\n\n" + wrap(p, 10) + "\n\n" + wrap(text(12), 6))]
    rows += [(5, wrap(q, 11)), (6, wrap([*text(30), *q, *text(30)], 7)), (7, "two words"), (8, "Two  words!"), (9, "a\n\nb\n\nc d\n\ne f"), (10, "a\n\nb\n\nc d\n\ne f"), (11, wrap(text(60), 8))]
    got = {r.doc_id: r for r in paragraphs.find_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[k].n_removed for k in (1, 3, 5, 7, 9, 11)] == [0] * 6
    assert got[2].n_removed == len(tale) and got[4].n_removed == len(wrap(p, 10)) and got[8].n_removed == len("Two  words") and got[10].n_removed == len(rows[9][1])
    assert got[6].n_removed >= len(" ".join(q)) and [got[k].component_id for k in (2, 4, 6, 8, 10)] == [1, 3, 5, 7, 9]


def vectors(seed=0, n=400, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    near = base[: n // 4] + 0.05 * rng.normal(size=(n // 4, dim))
    x = np.concatenate((base, near, base[:20], base[:20])).astype(np.float32).tolist()
    odd = [None, [], [0.0] * dim, [float("nan")] * dim, [1.0, None], [float("inf")] + [0.0] * (dim - 1)]
    return [(i, v) for i, v in enumerate([*x, *odd])] + [(None, x[0]), (3, x[3])]


def brute_links(rows):
    ok = [v is not None and len(v) > 0 and all(y is not None and np.isfinite(y) for y in v) and any(y != 0 for y in v) and i is not None for i, v in rows]
    width = max(len(v) for v, k in zip((v for _, v in rows), ok, strict=True) if k)
    x = np.array([(list(v) + [0.0] * (width - len(v))) if k else [0.0] * width for (_, v), k in zip(rows, ok, strict=True)])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return (x @ x.T >= 0.95) & np.array(ok)[:, None] & np.array(ok)[None, :]


def test_pivots(spark):
    rows = vectors()
    got = pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect()
    assert len(got) == len(rows)
    link = brute_links(rows)
    np.fill_diagonal(link, False)
    true = sum(link[k].sum() for k in range(len(rows)))
    found = sum(r.n_links for r in got)
    assert 0.9 * true <= found <= true  # recall, and nothing below the threshold
    by = {}
    for (i, _), n in zip(rows, link.sum(1), strict=True):
        by.setdefault(i, []).append(int(n))
    assert all(r.n_links <= max(by[r.vec_id]) for r in got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, None)]


@pytest.mark.parametrize(("dim", "count"), [(64, pivots.MAX_PIVOTS), (64, 1024), (384, pivots.MAX_PIVOTS)])
def test_pivots_recall_at_the_threshold(dim, count):
    """Pairs of cosine just above 0.95 that share enough pivots, with as many pivots as production has."""
    rng = np.random.default_rng(1)
    x = pivots.unit(rng.normal(size=(count + 400, dim)))
    pivot, x = x[:count], x[count:]
    away = rng.normal(size=x.shape)
    away = pivots.unit(away - (away * x).sum(1, keepdims=True) * x)
    y = 0.9501 * x + np.sqrt(1 - 0.9501**2) * away
    k = pivots.nearest_of(count)
    a, b = pivots.nearest(x, pivot, k), pivots.nearest(y, pivot, k)
    assert ((a[:, :, None] == b[:, None, :]).any(2).sum(1) >= pivots.SHARED).mean() > 0.985


def test_pivots_planted_links(spark, tmp_path):
    """On the driver's vectors with planted copies and neighbours of cosine 0.95 to 0.96: held against the query's SQL."""
    import duckdb
    from helpers import SF, same

    from graphloom.llm import queries

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    rng = np.random.default_rng(2)
    for k, (_, v) in enumerate(rows[:120]):
        x = np.array(v, np.float64)
        x /= np.linalg.norm(x)
        d = rng.normal(size=len(x))
        d -= (d @ x) * x
        c = 0.951 + 0.009 * rng.random()
        rows.append((100_000 + k, (c * x + np.sqrt(1 - c * c) * d / np.linalg.norm(d)).astype(np.float32).tolist() if k % 3 else list(v)))
    rows += [(200_000, None), (200_001, [0.0] * len(rows[0][1])), (200_002, [float("inf")] + [0.0] * (len(rows[0][1]) - 1))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    df = queries.op10_embedding_dedup(spark, str(tmp_path))
    assert df.agg({"n_links": "sum"}).first()[0] >= 240
    same(df, con, queries.OP10_SQL)


def test_pivots_columns_and_kinds(spark):
    """Clashing columns are ignored; float and double vectors, of very many dimensions too."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 3000))
    rows = [(i, v.tolist(), 1, "x") for i, v in enumerate(np.concatenate((base, base[:10] * 2.0, base[10:20] + 0.1 * rng.normal(size=(10, 3000)))))]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, node int, size string")
        got = {r.vec_id: r for r in pivots.near_duplicates(df).collect()}
        assert [got[k].n_links for k in range(60)] == [1] * 20 + [0] * 20 + [1] * 20 and [got[k].component_id for k in range(40, 60)] == list(range(20))


def test_pivots_long_lists(spark, monkeypatch):
    """Lists beyond the limit are split and sharded; the links are the same."""
    rng = np.random.default_rng(5)
    c = rng.normal(size=16)
    rows = [(i, (c + 0.1 * rng.normal(size=16)).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted(map(tuple, pivots.near_duplicates(df).collect()))
    monkeypatch.setattr(pivots, "LIST", 10)
    assert sorted(map(tuple, pivots.near_duplicates(df).collect())) == want
    link = brute_links(rows)
    np.fill_diagonal(link, False)
    assert sum(r[1] for r in want) >= 0.9 * link.sum()


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)]
    g = brute.Groups(3000)
    for a, b in edges:
        g.join(a, b)
    nodes = {v for a, b in edges if a != b for v in (a, b)}
    least = {}
    for v in nodes:
        least[g.find(v)] = min(least.get(g.find(v), v), v)
    got = components.components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()
    assert {(r["node"], r["component"]) for r in got} == {(v, least[g.find(v)]) for v in nodes} and len(got) == len(nodes)


def test_empty(spark):
    e = spark.createDataFrame([], DOCS)
    assert suffixes.find_repeats(e).count() == simhash.near_duplicates(e).count() == paragraphs.find_repeats(e).count() == 0
    assert pivots.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
