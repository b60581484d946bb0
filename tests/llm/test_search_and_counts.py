"""Whitening, ranked search and token counts against plain versions, on tables with nulls, ties, repeats and clashing columns."""

import math
import random
import re
import uuid
from collections import Counter

import numpy as np
import pytest
from locusweave.llm import lexical, tokens, whitening
from locusweave.llm.common import shared_dir
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<double>, x long, component int, n string"
DOCS = "doc_id long, text string, term int, block string, n_tokens long"


def plain_whitening(vectors, k):
    x = [np.floor(256 * np.asarray(v)).astype(np.int64) for v in vectors]
    fit = np.unique(np.stack(x), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    d = (n * fit - sums) / n
    value, vector = np.linalg.eigh(d.T @ d / n)
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    return n, sums, value, vector, np.trace(d.T @ d / n)


def test_whitening(spark):
    r = np.random.default_rng(1)
    spread = r.standard_normal((6, 6)) * [5, 3, 2, 1, 0.5, 0.1]
    rows = [(i, (r.standard_normal(6) @ spread.T).tolist()) for i in range(300)]
    rows += [(400, rows[0][1]), (0, rows[0][1]), (None, rows[3][1]), (401, rows[5][1][:4]), (402, [-0.001] * 6)]
    odd = [(403, None), (404, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (405, [float("nan")] * 6), (406, [float("inf")] * 6)]
    df = spark.createDataFrame([(*x, 1, 2, "clash") for x in rows + odd], VECTORS).repartition(3)
    got = whitening.whiten(df, 4).toPandas()
    full = [(i, (v + [0.0] * 6)[:6]) for i, v in rows]
    n, sums, value, vector, trace = plain_whitening([v for _, v in full], 4)
    assert len(got) == 4 * len(rows) and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10
    want = Counter()
    for i, v in full:
        x = np.floor(256 * np.asarray(v)).astype(np.int64)
        for c in range(4):
            want[i, c + 1, int(((n * x - sums) ** 2).sum()), round(abs((x - sums / n) @ vector[:, c]) / math.sqrt(value[c]), 7)] += 1
    assert want == Counter((None if math.isnan(a.vec_id) else int(a.vec_id), a.component, a.deviation, round(abs(a.whitened), 7)) for a in got.itertuples())
    for c, own in got.groupby("component"):
        assert own.explained.nunique() == 1 and own.explained.iloc[0] == pytest.approx(value[c - 1] / trace, rel=1e-12)


def test_whitening_of_few_or_equal_vectors(spark):
    make = lambda rows: spark.createDataFrame([(i, v, 0, 0, "") for i, v in enumerate(rows)], VECTORS)
    for rows in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 3, [[]], [None, [float("nan")]]):
        assert whitening.whiten(make(rows)).count() == 0
    two = whitening.whiten(make([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 0.0, 0.0]])).toPandas()
    assert set(two.component) == {1} and len(two) == 3 and set(two.n) == {2} and np.allclose(two.whitened.abs(), 1) and np.allclose(two.explained, 1)
    with pytest.raises(ValueError, match="63 bits"):
        whitening.whiten(make([[1e30], [2.0]]))
    with pytest.raises(ValueError, match="63 bits"):
        whitening.whiten(make([[1e10], [2.0], [-1e10]]))


@pytest.mark.parametrize("kind", ["spread", "equal", "low", "zero"])
def test_block_lanczos(kind):
    """Pairs at rounding level; restarts on breakdown (low rank, equal eigenvalues) and at the basis bound."""
    r = np.random.default_rng(3)
    d = 120
    q, _ = np.linalg.qr(r.standard_normal((d, d)))
    value = {"spread": 1 / np.arange(1, d + 1.0), "equal": np.r_[[5.0] * 20, [1.0] * (d - 20)], "low": np.r_[[3.0, 2.0, 1.0], [0.0] * (d - 3)], "zero": np.zeros(d)}[kind]
    a = (q * value) @ q.T
    a, seen = (a + a.T) / 2, []

    def product(b):
        seen.append(b)
        return a @ b

    for most in (256, 40):
        seen.clear()
        got, vector = whitening.block_lanczos(product, d, 4, most=most)
        assert np.allclose(got, value[:4], atol=1e-13) and np.allclose(vector.T @ vector, np.eye(4), atol=1e-13)
        assert np.linalg.norm(a @ vector - vector * got, axis=0).max() < 1e-12
        assert all(np.allclose(b.T @ b, np.eye(b.shape[1]), atol=1e-13) for b in seen)


def plain_search(docs, items, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(i, Counter(split(t)), len(split(t))) for i, t in docs]
    own = [x for x in own if x[2]]
    n, total = len(own), sum(x[2] for x in own)
    df = Counter(t for _, c, _ in own for t in c)
    found = Counter()
    for item, text in {x for x in items if x[0] is not None}:
        scores = []
        for i, c, size in own:
            m = 25 + 75 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in split(text))
            if s > 0 and i is not None:
                scores.append((-s, i))
        found.update((item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k]))
    return found


@pytest.mark.parametrize(("documents", "seeds", "at_once", "cells"), [(4, 4, 2048, 1 << 18), (1, 1, 3, 64), (16, 2, 5, 512)])
def test_search(spark, documents, seeds, at_once, cells, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "ROUND", 2)
    r = random.Random(4)
    names = ["".join(r.choice("abÉéß9zQ") for _ in range(r.randint(1, 4))) for _ in range(120)]
    prose = lambda n: "".join(r.choice(names) + r.choice([" ", ", ", "_", "\n", "\x00"]) for _ in range(n))
    docs = [(i, prose(r.choice([0, 3, 30, 200]))) for i in range(150)] + [(200, None), (201, ""), (202, " ._-\x7f"), (203, prose(20_000)), (None, prose(50))]
    docs += [docs[7], docs[7], (204, docs[9][1]), (205, "same words here")] + [(300 + i, "same words here") for i in range(15)]
    items = [(i, prose(r.randint(1, 25))) for i in range(12)] + [(20, None), (21, ""), (None, prose(5)), (22, "same same words"), (23, "absent—words"), (24, docs[11][1])]
    items += [items[0], (1, prose(4))]
    r.shuffle(docs)
    d = spark.createDataFrame([(*x, 1, "clash", 2) for x in docs], DOCS).repartition(3)
    q = spark.createDataFrame([(*x, 1, 2, 3) for x in items], "item_id long, text string, rank int, q int, score long")
    got = Counter(tuple(x) for x in lexical.search(d, q, 10, documents, seeds, at_once).select("item_id", "rank", "doc_id", "score").collect())
    assert got == plain_search(docs, items, 10)
    if seeds == 4:
        assert lexical.search(d.limit(0), q).count() == lexical.search(d, q.limit(0)).count() == lexical.search(d.where("doc_id in (200, 201, 202)"), q).count() == 0


def test_search_scores_few_blocks(spark):
    """One item's best documents stand out: after the seeds hardly a block is scored."""
    r = random.Random(6)
    docs = [(i, " ".join(r.choice("abcdefghij") for _ in range(30)) + (" rare words stand here" if i % 100 == 0 else "")) for i in range(2000)]
    lot = lexical.Lot([(1, "rare words stand here a")])
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    index = lexical.forward(df, lot, lexical.statistics(df), f"{shared_dir(spark)}/few-blocks-{uuid.uuid4().hex}")
    lot.weigh(lexical.document_counts(index, lot), 2000)
    batch = index.toArrow().combine_chunks().to_batches()[0]
    part = lexical.Part(batch, 0, batch.num_rows)
    bound = part.bounds(lot)
    scores, ids = part.scores(lot, np.ones(bound.shape, bool))
    block = np.repeat(np.arange(part.size), np.diff(batch.column("docs").offsets.to_numpy()))
    assert (scores <= bound[block]).all() and len(ids) == sum(bool({"a", "rare"} & set(t.split())) for _, t in docs)
    floor = np.sort(scores[:, 0])[-10]
    assert (bound[:, 0] >= floor).sum() <= 20 < 400 < part.size


def test_tokens(spark):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokens.TOKENIZER))
    r = random.Random(8)
    word = lambda: "".join(r.choice("abetn stioÉ漢字\n\t😀▁<s>/ ①") for _ in range(r.randint(1, 9)))
    texts = [" ".join(word() for _ in range(r.randint(0, 60))) for _ in range(300)]
    texts += [None, "", " ", "  ", "▁", "▁▁a", "a ", " a", "a  b   c    ", "\n", "<s>", "</s> <unk>", "<0x0A>", "a\x00b", "ab" * 30_000, "w " * 50_000, "hello " + " " * 40 + "x", "é", "é", "﻿a"]
    rows = [(i, t, 0, "clash", 7) for i, t in enumerate(texts)] + [(0, texts[0], 0, "", 0), (None, "no id", 0, "", 0)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    want = Counter((x[0], len((x[1] or "").encode()), n := len(model.encode(x[1] or "")), n > 4096) for x in rows)
    for most, sample in ((1 << 16, 4000), (5, 20), (0, 10)):
        assert Counter(tuple(x) for x in tokens.count_tokens(df, most=most, sample=sample).collect()) == want
    assert tokens.count_tokens(df.limit(0)).count() == 0
    assert tokens.count_tokens(df.where("doc_id < 5"), limit=3).agg(F.max("doc_id")).first()[0] == 4


def test_token_tiers(monkeypatch):
    """Names known to the first tier are not encoded; the worker's cache is bounded and a name's length never wrong."""
    monkeypatch.setattr(tokens, "CACHED", 3)
    tokens.model_at(None)
    counts = tokens.Counts(None, {"the": 1})
    counts.cache.clear()
    asked = []
    lengths = counts.model.lengths_of
    monkeypatch.setattr(counts.model, "lengths_of", lambda keys: asked.extend(keys) or lengths(keys))
    text = "the quick brown the quick " + "x" * 70
    assert counts.of([text, text]) == [len(counts.model.pieces.encode(text))] * 2
    assert sorted(asked) == sorted(["quick", "brown", "x" * 70]) and set(counts.cache) == {"quick", "brown"}
    assert counts.of(["one two three four"]) == [len(counts.model.pieces.encode("one two three four"))] and not counts.cache


def test_models_that_cannot_be_cut_get_whole_texts(monkeypatch):
    monkeypatch.setattr(tokens.model_at(None), "cuts", False)
    counts = tokens.Counts(None, {"a": 99})
    assert counts.of(["a b", ""]) == [2, 0]


def test_registered(spark):
    """Whole tables: token counts against the library."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokens.TOKENIZER))
    got = {x["doc_id"]: (x["n_bytes"], x["n_tokens"], x["over_limit"]) for x in tokens.op13_token_counts(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert got == {x["doc_id"]: (len(x["text"].encode()), n := len(model.encode(x["text"])), n > 4096) for x in docs}
