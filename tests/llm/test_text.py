"""Formatting, scanning, classifying, decontaminating and encoding."""

import hashlib
import random
import re

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import SF, same
from graphloom.llm import chat, decontaminate, langid, licenses, pieces, queries, toxicity
from graphloom.llm.arrays import blocks, mix

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("name", ["op3_chat_format", "op8_decontaminate", "op10_embedding_dedup", "op1_suffix_dedup"])
def test_oracles(spark, duck, name):
    same(queries.queries()[name](spark, SF), duck, queries.oracle_sql()[name])


def test_chat_events(spark):
    rows = [
        (1, 1, 0, "message", "user", "hi <|im_end|>\\b \\n"),
        (1, 2, 1, "message", "assistant", ""),
        (1, 3, 1, "delta", None, "he"),
        (1, 4, 1, "delta", None, "llo"),
        (1, 5, 1, "regenerate", None, None),
        (1, 6, 1, "delta", None, "bye <|x\\p"),
        (1, 7, 0, "edit", None, "edited"),
        (2, 1, 0, "delta", "assistant", None),
        (None, 1, 0, None, "sys\ntem", "n"),
        (3, 1, 5, "message", "user", "b"),
        (3, 1, 5, "message", "user", "a"),
        (3, 1, 5, "message", "user", "a"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, seq long, turn long, op string, role string, text string").withColumn("messages", F.lit(1))
    got = {r["conv_id"]: [tuple(m) for m in r["messages"]] for r in chat.fold(df).collect()}
    assert got == {1: [("user", "edited"), ("assistant", "bye <|x\\p")], 2: [("assistant", "")], None: [("sys\ntem", "n")], 3: [("user", "a"), ("user", "a"), ("user", "b")]}
    told = {r["conv_id"]: ([tuple(m) for m in r["ms"]], r["told"]) for r in chat.format_chats(df).select("conv_id", chat.parse(F.col("formatted")).alias("ms"), chat.masked(F.col("formatted"), F.col("loss")).alias("told")).collect()}
    assert told == {k: (v, "".join(t for r, t in v if r == "assistant")) for k, v in got.items()}
    assert chat.digest(chat.format_chats(df.filter("false"))).count() == 0


def test_chat_streams(spark):
    """A log of drafts, edits, regenerations and deltas folds into the messages that it was made of; ties, nulls and long texts too."""
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, None]), rng.choice([0, 1, 2, 7, None]), rng.choice(["user", "assistant", "", None]), rng.choice(["", "a", "é🙂", "<|im_end|>", None, "many words " * 3])) for _ in range(80)]
    rows += [rows[0], rows[0], (5, 0, "assistant", "x" * 300_000), (5, 1, "user", "漢" * 99_999)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.streamed(df)
    assert log.count() == 4 * len(rows) and {r["op"] for r in log.select("op").distinct().collect()} == {"message", "edit", "regenerate", "delta"}
    told = lambda d: {r["conv_id"]: [tuple(m) for m in r["messages"]] for r in chat.fold(d.repartition(5)).collect()}
    assert told(log) == told(chat.events_of(df))
    assert chat.streamed(df.filter("false")).count() == 0


def test_chat_escapes(spark):
    rng = random.Random(1)
    bits = ["\\", "b", "p", "n", "<|", "|>", "<", "|", "\n", "im_end", "<|im_end|>\n", "é"]
    rows = [(k, 0, "".join(rng.choice(bits) for _ in range(3)), "".join(rng.choice(bits) for _ in range(12))) for k in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_chats(chat.events_of(df)).select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("ms")).collect()
    assert {r["conv_id"]: tuple(r["ms"][0]) for r in got} == {k: (role, t) for k, _, role, t in rows}
    assert all(r["formatted"].count("<|") == 2 for r in got)


def test_decontaminate(spark):
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(25)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([2, 3, 9, 10, 14, 30])))) for k in range(12)] + [(50, None), (51, ""), (52, "!"), (None, "null item of words"), (0, "w1 w2 W3")]
    docs = []
    for k in range(150):
        parts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 12))) for _ in range(3)]
        w = brute.words(rng.choice(items)[1])
        a = rng.randrange(len(w) + 1)
        docs.append((k, " ".join([parts[0], *w[a : a + rng.randint(0, 14)], parts[1], "É, null ITEM of words" if k % 9 == 0 else ""])))
    docs += [(None, None), (500, ""), docs[3]]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("hits", F.lit(1))
    want = sorted(((i, len(w), sum(h), len(f), hashlib.sha256(",".join(sorted(f)).encode()).hexdigest(), any(h)) for (i, _), (w, h, f) in zip(docs, brute.leaks(docs, items), strict=True)), key=str)
    df = spark.createDataFrame(docs, DOCS).withColumn("items", F.lit("clash")).repartition(2)
    assert sorted(map(tuple, decontaminate.digest(decontaminate.find_leaks(df, bench)).collect()), key=str) == want
    for group, most in ((40, 10**6), (40, 90), (1, 1)):  # several automata in a pass, and several passes
        assert sorted(map(tuple, decontaminate.digest(decontaminate.find_leaks(df, bench, group_words=group, pass_words=most)).collect()), key=str) == want
    none = decontaminate.digest(decontaminate.find_leaks(df, bench.filter("false"))).collect()
    assert len(none) == len(docs) and not any(r["contaminated"] for r in none)
    kept = {r["doc_id"]: r for r in decontaminate.remove_leaks(df, bench).collect()}
    for (i, t), (w, h, _) in zip(docs, brute.leaks(docs, items), strict=True):
        if i is not None and i != 3:
            assert (i in kept) == (not any(h) or sum(h) <= 0.8 * len(w))
            if i in kept:
                assert kept[i]["items"] == "clash" and (kept[i]["text"] == t if not any(h) else brute.words(kept[i]["text"]) is not None)


def test_languages(spark):
    rng = random.Random(3)
    syll = {"aa": ["ba", "da", "ga"], "ii": ["ti", "ki", "si"]}
    rows = [(k, " ".join("".join(rng.choice(syll[lang]) for _ in range(3)) for _ in range(rng.randint(1, 30))), lang) for k in range(300) for lang in [rng.choice(["aa", "ii"])]]
    rows += [(1000, None, "aa"), (1001, "123 !!", "ii"), (1002, "", None), (1003, "дом", None), (None, "tikisi", None), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [by[k]["lang_pred"] for k in (1000, 1001, 1002)] == ["und"] * 3 and by[1003]["lang_pred"] in ("aa", "ii") and by[None]["lang_pred"] == "ii"
    held = [(by[i]["lang_pred"], lang) for i, _, lang in rows[:300] if by[i]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.97 and len(held) > 50
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(df.filter("false")).count() == 0
    assert {r["doc_id"] for r in langid.keep_languages(df).collect()} == set(by) - {1000, 1001, 1002}


def test_language_kernel():
    """With all texts as landmarks, scores equal exact kernel ridge regression on the blended spectrum kernel."""
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcdeé ñ") for _ in range(rng.randint(1, 60))) for _ in range(40)]
    langs = [rng.choice(["l1", "l2", "l3"]) for _ in texts]
    (block,) = blocks(batch(texts), "text", 1 << 30)
    x = langid.presence(block, 0, len(texts))
    grams = [{b[k : k + n] for n in (1, 2, 3) for k in range(len(b) - n + 1)} for b in (t.encode() for t in texts)]
    assert all(abs(int(r.sum()) - len(g)) <= 2 for r, g in zip(x, grams, strict=True))  # two grams rarely share a place
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in grams] for a in grams])
    names = sorted(set(langs))
    w = np.array([1 / langs.count(v) for v in langs])
    y = np.array([[1.0 if v == n else -1.0 for n in names] for v in langs])
    want = kernel @ np.linalg.solve(kernel + langid.RIDGE * w.mean() * np.diag(1 / w), y)
    got = langid.fit(langs, x, per_lang=40).scores(x)
    assert np.abs(got - want).max() < 0.05 and (got.argmax(1) == want.argmax(1)).mean() > 0.97


def test_language_bounds():
    """More languages than landmarks are still learned, one landmark each at most."""
    rng = np.random.default_rng(1)
    x = (rng.random((60, langid.DIM)) < 0.01).astype(np.uint8)
    before = langid.LANDMARKS
    langid.LANDMARKS = 16
    try:
        m = langid.fit([f"l{k % 30}" for k in range(60)], x)
    finally:
        langid.LANDMARKS = before
    assert m.landmarks.shape[1] == 16 and len(m.langs) == 30 and np.isfinite(m.scores(x)).all()


def test_languages_kept(spark):
    """Without anything to learn from, all texts with a letter stay; columns of clashing names too."""
    rows = [(1, "some words", None, 3, "a"), (2, "12", None, 4, "b"), (3, None, None, 5, "c"), (4, "é", None, 6, "d"), (4, "é", None, 6, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, lang_pred string")
    assert sorted(map(tuple, langid.keep_languages(df).collect())) == sorted(rows[:1] + rows[3:])
    assert langid.keep_languages(df.filter("false")).count() == 0


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_toxicity(spark):
    rng = random.Random(4)
    plain = ["tree", "river", "stone", "walks", "house", "you", "and"]
    rows, labels = [], []
    for k in range(1500):
        bad = rng.random() < 0.2
        w = [rng.choice(plain) for _ in range(rng.randint(5, 40))]
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "grubliX" + rng.choice("abc"), "scum"]))
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    docs = spark.createDataFrame([*rows, (9000, None), (9001, ""), (None, "idiot")], DOCS).withColumn("score", F.lit(0))
    lab = spark.createDataFrame([*labels, (None, 1), (9000, None)], "doc_id long, toxic int")
    got = toxicity.detect(docs, lab).collect()
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(got) == len(rows) + 3 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert {r["predicted"] for r in toxicity.detect(docs, lab.filter("false")).collect()} == {0}
    assert {r["predicted"] for r in toxicity.detect(docs, lab.filter("toxic = 1")).collect()} == {1}
    assert toxicity.detect(docs.filter("false"), lab).count() == 0


def test_boosting():
    """The first tree's splits and leaves equal a search over all features and thresholds; more trees lower the loss."""
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 3)), 1)
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.3 * rng.normal(size=300) > 0.3).astype(float)
    w = rng.uniform(0.5, 2, 300)
    model = toxicity.boost(x, y, w)
    mean = (w * y).sum() / w.sum()
    assert abs(model.start - np.log(mean / (1 - mean))) < 1e-9
    g, h = w * (y - mean), w * mean * (1 - mean)

    def best(at):
        top = (1e-9, 0, np.inf)
        for f in range(x.shape[1]):
            for t in np.unique(np.quantile(x[:, f], np.linspace(0, 1, toxicity.BINS + 1)[1:-1])):
                left = at[x[at, f] <= t]
                right = np.setdiff1d(at, left)
                if len(left) >= toxicity.LEAF and len(right) >= toxicity.LEAF and len(at) >= 2 * toxicity.LEAF:
                    gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[right].sum() ** 2 / (h[right].sum() + 1) - g[at].sum() ** 2 / (h[at].sum() + 1)
                    if gain > top[0] + 1e-9:
                        top = (gain, f, t)
        return top

    node = {0: np.arange(300)}
    for k in range(7):
        gain, f, t = best(node[k])
        assert (model.feature[0, k], model.threshold[0, k]) == (f, t)
        node[2 * k + 1], node[2 * k + 2] = node[k][x[node[k], f] <= t], node[k][x[node[k], f] > t]
    for leaf in range(8):
        at = node[7 + leaf]
        assert abs(model.leaf[0, leaf] - toxicity.RATE * g[at].sum() / (h[at].sum() + 1)) < 1e-9
    p = 1 / (1 + np.exp(-model.raw(x)))
    assert -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() < -(w * (y * np.log(mean) + (1 - y) * np.log(1 - mean))).sum() / 3


def test_isotonic_against_brute_force():
    """The least-squares rising fit: the largest of all averages that begin at or before a point, over the smallest that end at
    or behind it."""
    rng = np.random.default_rng(3)
    x, y, w = np.sort(rng.normal(size=60)), rng.random(60).round(), rng.uniform(0.2, 3, 60)
    xs, ys = toxicity.isotonic(x, y, w)
    mean = lambda a, b: (w[a:b] * y[a:b]).sum() / w[a:b].sum()
    want = [max(min(mean(a, b) for b in range(i + 1, 61)) for a in range(i + 1)) for i in range(60)]
    assert np.abs(np.interp(x, xs, ys) - want).max() < 1e-9


def test_toxicity_rows(spark):
    """Repeated rows, very long texts, clashing columns."""
    rows = [(k, ("fine words here " if k % 2 else "you idiot scum ") * (k % 5 + 1)) for k in range(300)]
    rows += [rows[0], rows[0], (999, "calm " * 200_000)]
    df = spark.createDataFrame(rows, DOCS).withColumn("predicted", F.lit("x")).withColumn("y", F.lit(7)).withColumn("held_out", F.lit(True))
    lab = spark.createDataFrame([(k, 1 - k % 2) for k in range(300)], "doc_id long, toxic int").withColumn("score", F.lit(1))
    got = toxicity.detect(df, lab).collect()
    assert len(got) == len(rows) and len({r["score"] for r in got if r["doc_id"] == 0}) == 1
    assert {r["predicted"] for r in got if r["doc_id"] == 999} == {0}


def test_isotonic():
    x = np.array([0.0, 1, 2, 3, 4, 4])
    xs, ys = toxicity.isotonic(x, np.array([0.0, 1, 0, 1, 1, 0]), np.ones(6))
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all()


BASE = [(p.split(), label) for p, label in licenses.BASE.items()]


def test_licenses(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0.", "This is GNU General  Public\nLicense v3 and the MIT license; mit LICENSE", "cc by-nc 4.0", "Creative Commons Attribution-ShareAlike 4.0",
        "SPDX-License-Identifier: BSD-3-Clause", "GNU Lesser General Public License version 2.1", "mit Lizenz und cc", "Permission is hereby granted, free of charge, to any person obtaining a copy", "x" * 100_000 + " apache license", None, "", "no words here",
    ]
    df = spark.createDataFrame([*enumerate(texts), (0, texts[0])], DOCS).withColumn("labels", F.lit("c"))
    got = licenses.scan(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        w = brute.words(texts[r["doc_id"]])
        at = [(k, label) for p, label in BASE for k in range(len(w)) if w[k : k + len(p)] == p]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert [labels[k] for k in range(8)] == ["apache", "gpl,mit", "cc-by,cc-by-nc", "cc-by-sa", "bsd", "lgpl", "", "mit"]
    assert len(licenses.rules()) > 200
    assert licenses.scan(df.filter("false")).count() == 0


@pytest.mark.parametrize(
    ("header", "want"),
    [
        ("/*\n * Licensed under the Apache\n * License, Version 2.0\n */", "apache"),
        ("# Permission is hereby granted, free of\n# charge, to any person obtaining a\n# copy of this", "mit"),
        ("// This program is free software: you can\n// redistribute it and/or modify it", "gpl"),
        ("<!-- SPDX-License-Identifier:\n  MPL-2.0 -->", "mpl"),
        ("dnl You may not use this file except\ndnl in compliance with the License", "apache"),
        ("dual-licensed under the MIT License and the Eclipse Public License 2.0", "dual,epl,mit"),
        ("GNU General Public License version 2.0 with Classpath exception", "classpath-exception,gpl"),
    ],
)
def test_license_headers(header, want):
    text = licenses.plain(header.lower())
    found = licenses.detect(text, set(brute.words(header)))
    assert ",".join(sorted({f[3] for f in found})) == want, found


def test_license_rules_can_match():
    """Each rule's keywords are words of what it matches: every text rule is held against its own pattern, read as words."""
    for label, text, keys in licenses.TEXTS + licenses.EXCEPTIONS:
        assert all(re.search(rf"(?<![a-z]){k}", text.replace("\\", "")) for k in keys.split()), (label, keys)


def test_license_gate_and_suppression():
    rng = random.Random(7)
    bits = ["licensed under the", "gnu general public license", "version 3.0", "apache license", "bsd-3-clause", "spdx-license-identifier:", "mit license", "eclipse public license", "and", "cc by-sa 4.0", "all rights reserved", "http://www.apache.org/licenses/x"]
    for _ in range(200):
        t = " ".join(rng.choice(bits) for _ in range(6))
        have = set(brute.words(t))
        every = [(m.start(), m.end(), r.priority, r.label, r.confidence) for r in licenses.rules() for m in r.pattern.finditer(t)]
        kept = [d for d in set(every) if not any(o is not d and o[:4] != d[:4] and o[2] >= d[2] and o[0] <= d[0] and d[1] <= o[1] and (o[:2] != d[:2] or o[2] > d[2] or (o[2] == d[2] and (-len(o[3]), o[3]) < (-len(d[3]), d[3]))) for o in set(every))]
        assert {d[3] for d in licenses.detect(t, have)} == {d[3] for d in kept}


MODEL = pieces.MODEL


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.6, 1.0])
def test_pieces(dropout):
    import sentencepiece

    sp, v = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.vocabulary(pieces._model_bytes(MODEL))
    rng = random.Random(8)
    bits = ["a", "e", "th", "ing", " ", "  ", "\n", "é", "ñ", "漢", "🙂", "▁", "\t", "The", " and", "x" * 60, "\x00", "q"]
    texts = [None, "", " ", "a", " a", "\n", "▁"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    for limit in (200, 1 << 20):
        at = 0
        for b in blocks(batch(texts), "text", limit):
            tokens, n = pieces.encode(b, v, mix(np.arange(at, at + b.n).astype(np.uint64)), dropout)
            data, k = pieces.decode(tokens, n, v)
            ends, stops = np.concatenate(([0], np.cumsum(k))), np.concatenate(([0], np.cumsum(n)))
            for i in range(b.n):
                t = texts[at + i] or ""
                assert data[ends[i] : ends[i + 1]].tobytes().decode() == t
                if dropout == 0 and "▁" not in t:
                    assert tokens[stops[i] : stops[i + 1]].tolist() == sp.encode(t)
            at += b.n


def agenda(v, syms, key, below):
    """One word, plainly: offers of adjacent symbols wait in a list, the best is merged or skipped."""
    parts = [(int(s), k, k + 1) for k, s in enumerate(syms)]
    offers = set(zip(parts, parts[1:]))
    while True:
        good = []
        for a, b in offers:
            rank, made = v.merge(np.array([a[0]]), np.array([b[0]]))
            if rank[0] != pieces.NEVER:
                good.append((int(rank[0]), a[1], int(made[0]), a, b))
        if not good:
            return [p[0] for p in parts]
        _, _, made, a, b = min(good)
        span = (a[1] << 42) | (a[2] << 21) | b[2]
        if int(mix(np.array([key ^ mix(np.array([span + 1], np.uint64))[0]]))[0]) < below:
            offers.discard((a, b))
            continue
        k = parts.index(a)
        new = (made, a[1], b[2])
        parts[k : k + 2] = [new]
        offers = {(x, y) for x, y in offers if not {x, y} & {a, b}}
        if k:
            offers.add((parts[k - 1], new))
        if k + 1 < len(parts):
            offers.add((new, parts[k + 1]))


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5])
def test_pieces_against_a_plain_agenda(dropout):
    v = pieces.vocabulary(pieces._model_bytes(MODEL))
    rng = random.Random(11)
    below = int(dropout * (1 << 64))
    for _ in range(150):
        s = v.chars[np.array([ord(rng.choice("aethingouéx")) for _ in range(rng.randint(2, 60))])]
        key = np.uint64(rng.getrandbits(64))
        want = agenda(v, s, key, below)
        assert pieces.segment_long(v, s, key, below) == want
        out, n = pieces.segment_equal(v, s[None, :], np.array([key], np.uint64), below)
        assert out[0, : n[0]].tolist() == want


def test_pieces_long_words_equal_short_ones(monkeypatch):
    v = pieces.vocabulary(pieces._model_bytes(MODEL))
    rng = random.Random(9)
    for _ in range(100):
        s = v.chars[np.array([ord(rng.choice("aethingéx qz")) for _ in range(rng.randint(2, 30))])]
        key = np.uint64(rng.getrandbits(64))
        for below in (0, 1 << 62):
            out, n = pieces.segment_equal(v, s[None, :], np.array([key], np.uint64), below)
            assert out[0, : n[0]].tolist() == pieces.segment_long(v, s, key, below)


def test_pieces_vary_inside_a_text():
    """Occurrences of one word are drawn one by one."""
    v = pieces.vocabulary(pieces._model_bytes(MODEL))
    (b,) = blocks(batch([" ".join(["information"] * 200)]), "text", 1 << 20)
    tokens, _ = pieces.encode(b, v, mix(np.arange(1).astype(np.uint64)), 0.3)
    words, at = set(), [k for k, t in enumerate(tokens) if v.text[v.at[t] : v.at[t] + 1].tobytes() == b" "]
    for x, y in zip(at, [*at[1:], len(tokens)]):
        words.add(tuple(tokens[x:y].tolist()))
    assert len(at) == 200 and len(words) > 10


def test_pieces_on_spark(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit(1).alias("tokens"))
    one, two = (pieces.encode_documents(docs, seed=s).collect() for s in (1, 2))
    assert sum(a["tokens"] != b["tokens"] for a, b in zip(one, two, strict=True)) > 0.9 * len(one)
    assert [r["tokens"] for r in one] == [r["tokens"] for r in pieces.encode_documents(docs, seed=1).collect()]
    back = {r["doc_id"]: r["text"] for r in pieces.decode_documents(pieces.encode_documents(docs)).collect()}
    assert back == {r["doc_id"]: r["text"] for r in docs.collect()}
    assert pieces.round_trip(docs).filter("not lossless").count() == 0
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "")], DOCS)
    assert sorted((r["n_tokens"], r["lossless"]) for r in pieces.round_trip(odd).collect()) == [(0, True)] * 3
    assert pieces.round_trip(odd.filter("false")).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(10)
    vocab = [f"{a}{b}{c}" for a in "bdgt" for b in "aeiou" for c in "mnrs"]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    shared, item = text(20), text(14)
    rows = [(0, text(60)), (1, None), (2, "12 34"), (3, shared + " " + text(30)), (4, text(25) + " " + shared + " " + text(9)), (5, text(20) + " " + item + " " + text(20)), (6, item)]
    rows += [(10 + k, rows[0][1]) for k in range(3)] + [(20 + k, text(40)) for k in range(10)]
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    bench = [(0, item), (1, text(12))]
    spark.createDataFrame(bench, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r["tokens"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    kept = [(i, t) for i, t in rows if t and re.search("[a-z]", t)]
    kept = [(i, t) for (i, t), (_, _, c) in zip(kept, brute.near_copies(kept), strict=True) if i == c]
    kept = [(i, bytes(x for x, gone in zip(t.encode(), m, strict=True) if not gone).decode()) for (i, t), m in zip(kept, brute.cut_repeats(kept), strict=True)]
    want = {}
    for (i, t), (w, h, _) in zip(kept, brute.leaks(kept, bench), strict=True):
        if sum(h) <= 0.8 * len(w):
            at = [m.span() for m in brute.ALNUM.finditer(t)]
            for k in range(len(w) - 1, -1, -1):
                if h[k] and (k + 1 == len(w) or not h[k + 1]):
                    a = k
                    while a and h[a - 1]:
                        a -= 1
                    t = t[: at[a][0]] + t[at[k][1] :]
            want[i] = t
    assert set(got) == set(want)
    v = pieces.vocabulary(pieces._model_bytes(MODEL))
    for i, tokens in got.items():
        data, _ = pieces.decode(np.array(tokens, np.int32), np.array([len(tokens)]), v)
        assert data.tobytes().decode() == want[i]


def test_pipeline_edges(spark, tmp_path):
    """No language to learn from, nulls, ties, repeated rows, a very long text, clashing columns; and an empty table."""
    import corpus_pipeline

    rng = random.Random(13)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(100_000))
    rows = [(1, "one short text", None), (1, "one short text", None), (2, "another text here", None), (None, "no number at all", None), (None, "no number at all", None), (3, long, None), (4, None, None), (5, "", None), (6, "42", None)]
    cols = "doc_id long, text string, lang string, source string, n_chars long, tag int, starts string, score double, component_id int"
    docs = spark.createDataFrame([(*r, "s", len(r[1] or ""), 1, "x", 0.5, 9) for r in rows], cols)
    (tmp_path / "a").mkdir()
    docs.write.parquet(str(tmp_path / "a/documents.parquet"))
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(str(tmp_path / "a/benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    assert sorted((r["doc_id"] or 0 for r in got)) == [0, 0, 1, 1, 2, 3]  # rows of a kept doc_id, and without one, stay
    v = pieces.vocabulary(pieces._model_bytes(MODEL))
    (whole,) = (r["tokens"] for r in got if r["doc_id"] == 3)
    assert pieces.decode(np.array(whole, np.int32), np.array([len(whole)]), v)[0].tobytes().decode() == long
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path / "a")).schema == docs.schema
    docs.filter("false").write.parquet(str(tmp_path / "b/documents.parquet"))
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(str(tmp_path / "b/benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
