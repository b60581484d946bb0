"""Toxicity by a linear-chain conditional random field over words.

Labelled documents give labelled tokens: a token counts as toxic if its document is and one of the token's features (its word,
its beginnings) is far more frequent among toxic documents than among others. A two-state CRF is fitted to those by its exact
gradient; only features that are more frequent in toxic documents than chance explains can get a weight, all others leave a word to
the bias and its neighbours. Forward-backward gives every word's marginal probability in any text, over the whole document as one
chain; a logistic unit over the document's marginals, fitted on labelled documents that the CRF has not seen, gives the score. Words
of a marginal over a half are the offending spans.

Null and empty texts get the score of a document without offending words. Rows without a doc_id are scored, and are not held
out. Repeated rows each get the same score. Extra columns are ignored, whatever their names. An empty table gives an empty result.
With labels of one kind only, fewer than three of a kind, or none, every score is the (smoothed) share of toxic labels.

The sample that is fitted: at most SAMPLE labelled documents of at most BYTES in all, in the order of a hash of doc_id. Their whole
texts are used. Of sampled documents without any such feature a tenth is kept, with ten times the weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, Words, slices, table, texts_of, to_batch

SAMPLE, BYTES, FOLDS, EVIDENCE = 6000, 64 << 20, 5, 8.0
#: Words of a row of the grid in which chains are laid out; a longer document goes on in the next row.
ROW = 64
_MASK = np.uint64((1 << 20) - 1)
_BEGINNINGS = (3, 4, 5, 6, 8)
_PUNCTUATION = np.zeros(256, bool)
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _PUNCTUATION[_c] = True


class Tokens:
    """Words of texts with hashed features: the bare lower-case word, and its first bytes."""

    def __init__(self, texts: list[bytes], rolling: Rolling):
        self.words = w = Words(texts, lower=True)
        mark = _PUNCTUATION[w.array]
        start, end = w.start.copy(), w.end.copy()
        for _ in range(8):
            more = (end > start) & mark[np.maximum(end - 1, 0)]
            if not more.any():
                break
            end -= more
        for _ in range(8):
            more = (end > start) & mark[np.minimum(start, len(mark) - 1)]
            if not more.any():
                break
            start += more
        whole = rolling.many(w.array, [(start, end), *[(start, np.minimum(end, start + k)) for k in _BEGINNINGS]])
        self.features = [(h + np.uint64(k)) & _MASK for k, h in enumerate(whole)]
        size = end - start
        for k, length in enumerate(_BEGINNINGS, 1):  # too short: no feature of this kind
            self.features[k] = np.where(size > length, self.features[k], 0)

    def chains(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row and place of each word in a grid, a document on as many rows as it takes; and each row's number in its document."""
        counts = np.diff(self.words.first)
        rows = -(-counts // ROW)
        first = np.cumsum(rows) - rows
        place = np.arange(len(self.words)) - np.repeat(self.words.first[:-1], counts)
        turn = np.arange(rows.sum()) - np.repeat(first, rows)
        return np.repeat(first, counts) + place // ROW, place % ROW, turn


@dataclass
class Model:
    """Feature weights (index 0: none), bias, transitions (logarithms), and the logistic unit over marginals."""

    weights: np.ndarray
    bias: float = 0.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    unit: np.ndarray | None = None
    share: float = 0.5

    def emissions(self, tokens: Tokens) -> np.ndarray:
        x = np.full(len(tokens.words), self.bias, np.float32)
        for f in tokens.features:
            x += self.weights[f]
        return x


def _enter(products: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """What each row starts from, if the row before it maps what it starts from by ``(p x + q) / (u x + v)``."""
    into = np.zeros(len(turn))
    order = np.argsort(turn, kind="stable")
    cuts = np.searchsorted(turn[order], np.arange(1, turn.max() + 2)) if len(turn) else [0]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        own = order[low:high]
        p, q, u, v = products[:, own - 1]
        into[own] = (p * into[own - 1] + q) / (u * into[own - 1] + v)
    return into


def forward_backward(x: np.ndarray, live: np.ndarray, moves: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: the odds of state 1 by what comes before (with its own emission) and by what comes after.

    x: log odds of state 1 by the word itself; live: places that hold words; turn: each row's number in its document. A document
    of several rows is one chain: a step maps odds x to (p x + q) / (u x + v), so a row is the product of its steps' matrices, and
    what a row starts from is known before its words are gone through. Third: the emissions' odds.
    """
    a = np.exp(moves)
    e = np.exp(np.clip(x, -30, 30)).astype(np.float64)
    n, t = x.shape
    before, after = np.ones((n, t)), np.ones((n, t))
    head = turn == 0
    tail = np.r_[head[1:], True][:n]

    def products(own: np.ndarray, places: range, c: np.ndarray) -> np.ndarray:
        """Of rows that are full: the product of [[c11 e, c01 e], [c10, c00]] over their places, in that order."""
        out = np.zeros((4, n))
        p, q, u, v = np.ones(len(own)), np.zeros(len(own)), np.zeros(len(own)), np.ones(len(own))
        for i in places:
            w = e[own, i]
            p, q, u, v = w * (c[1, 1] * p + c[0, 1] * u), w * (c[1, 1] * q + c[0, 1] * v), c[1, 0] * p + c[0, 0] * u, c[1, 0] * q + c[0, 0] * v
            if i == 0 and places.step == 1:  # a document's first word has no step into it
                first = head[own]
                p, q, u, v = np.where(first, 0, p), np.where(first, w, q), np.where(first, 0, u), np.where(first, 1, v)
            scale = p + q + u + v
            p, q, u, v = p / scale, q / scale, u / scale, v / scale
        out[:, own] = p, q, u, v
        return out

    into = _enter(products(np.flatnonzero(~tail), range(t), a), turn) if turn.any() else np.zeros(n)
    before[:, 0] = np.where(head, e[:, 0], e[:, 0] * (a[0, 1] + a[1, 1] * into) / (a[0, 0] + a[1, 0] * into))
    for i in range(1, t):
        r = before[:, i - 1]
        before[:, i] = e[:, i] * (a[0, 1] + a[1, 1] * r) / (a[0, 0] + a[1, 0] * r)

    def back(own: np.ndarray, last: np.ndarray) -> None:
        after[own, t - 1] = last
        for i in range(t - 2, -1, -1):
            y = e[own, i + 1] * after[own, i + 1]
            after[own, i] = np.where(live[own, i + 1], (a[1, 0] + a[1, 1] * y) / (a[0, 0] + a[0, 1] * y), 1.0)

    ends = np.flatnonzero(tail)
    back(ends, np.ones(len(ends)))
    if turn.any():
        # from the last row to the first; an end's result doesn't depend on what comes into it
        others = np.flatnonzero(~tail)
        step = products(others, range(t - 1, -1, -1), a.T)
        step[:, ends] = np.stack([np.zeros(len(ends)), e[ends, 0] * after[ends, 0], np.zeros(len(ends)), np.ones(len(ends))])
        length = np.maximum.reduceat(turn, np.flatnonzero(head))
        backwards = (np.repeat(length, length + 1) - turn)[::-1]
        y = _enter(step[:, ::-1], backwards)[::-1][others]
        back(others, (a[1, 0] + a[1, 1] * y) / (a[0, 0] + a[0, 1] * y))
    return before, after, e


def marginals(model: Model, tokens: Tokens) -> np.ndarray:
    """Each word's probability of state 1."""
    if not len(tokens.words):
        return np.zeros(0)
    row, place, turn = tokens.chains()
    x = np.zeros((len(turn), ROW), np.float32)
    live = np.zeros(x.shape, bool)
    x[row, place] = model.emissions(tokens)
    live[row, place] = True
    before, after, _ = forward_backward(x, live, model.moves, turn)
    odds = (before * after)[row, place]
    return odds / (1 + odds)


def summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each document: largest marginal, expected toxic words (logarithm), their share, their logarithmic rate, one."""
    n = np.diff(first)
    sums, most = np.zeros(len(n)), np.zeros(len(n))
    if len(p):
        full = np.flatnonzero(n)
        most[full] = np.maximum.reduceat(p, first[:-1][full])
        sums[full] = np.add.reduceat(p, first[:-1][full])  # of equal texts equal, wherever they stand
    share = sums / np.maximum(1, n)
    return np.stack([most, np.log1p(sums), share * 20, np.log(share + 1e-4) + 4, np.ones(len(n))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (q - y) + ridge * w)
    return w


class _Lot:
    """Whole documents of the sample, laid out in a grid, that a step of the fit goes through at a time."""

    def __init__(self, sizes: np.ndarray, weight: np.ndarray, label: np.ndarray, features: list[np.ndarray]):
        rows = -(-sizes // ROW)
        place = np.arange(len(label)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        first = np.cumsum(rows) - rows
        self.cell = (np.repeat(first, sizes) + place // ROW) * ROW + place % ROW
        self.turn = np.arange(rows.sum()) - np.repeat(first, rows)
        heavy = np.repeat(weight, rows)
        self.own_weight, self.label = heavy[self.cell // ROW], label
        self.at = np.concatenate([np.flatnonzero(f >= 0) for f in features])
        self.feature = np.concatenate([f[f >= 0] for f in features])
        self.live = np.zeros((len(self.turn), ROW), bool)
        self.live.ravel()[self.cell] = True
        # neighbours: within a row, and from a row's last word to the first of the document's next row
        self.over = np.flatnonzero(self.turn > 0)
        pairs = np.concatenate([((self.live[:, :-1] & self.live[:, 1:]) * heavy[:, None]).ravel(), heavy[self.over]])
        self.used = np.flatnonzero(pairs)
        self.pairs = pairs[self.used]
        truth = np.zeros(self.live.shape, bool)
        truth.ravel()[self.cell] = label
        y0, y1 = self.before(truth), self.behind(truth)
        self.real = np.array([[self.pairs[(y0 == i) & (y1 == j)].sum() for j in (False, True)] for i in (False, True)])

    def before(self, z: np.ndarray) -> np.ndarray:
        return np.concatenate([z[:, :-1].ravel(), z[self.over - 1, -1]])[self.used]

    def behind(self, z: np.ndarray) -> np.ndarray:
        return np.concatenate([z[:, 1:].ravel(), z[self.over, 0]])[self.used]

    def gradient(self, weights: np.ndarray, bias: float, moves: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """Sums over the lot: by feature, for the bias, and the transitions that the model expects."""
        x = np.zeros(self.live.shape, np.float32)
        x.ravel()[self.cell] = bias + np.bincount(self.at, weights=weights[self.feature], minlength=len(self.label))
        before, after, own = forward_backward(x, self.live, moves, self.turn)
        odds = (before * after).ravel()[self.cell]
        error = (self.label - odds / (1 + odds)) * self.own_weight
        a = np.exp(moves)
        r, later = self.before(before), self.behind(own * after)
        joint = np.stack([np.full(len(r), a[0, 0]), a[0, 1] * later, a[1, 0] * r, a[1, 1] * r * later])
        joint *= self.pairs / joint.sum(0)
        return np.bincount(self.feature, weights=error[self.at], minlength=len(weights)), float(error.sum()), joint.sum(axis=1).reshape(2, 2)


def fit(texts: list[bytes], toxic: np.ndarray, rounds: int = 25) -> Model:
    """Lexicon, CRF and logistic unit; every third document is kept from the CRF for the unit."""
    model = Model(np.zeros(1 << 20, np.float32), share=float((toxic.sum() + 0.5) / (len(toxic) + 1)))
    if not len(toxic) or toxic.min() == toxic.max():
        return model
    # copies of a text would make its every word look like evidence
    first = np.unique(np.asarray([hash(t) for t in texts]), return_index=True)[1]
    texts, toxic = [texts[i] for i in np.sort(first)], toxic[np.sort(first)]
    rolling = Rolling(31)
    part = np.zeros(len(toxic), int)
    for kind in (0, 1):
        own = np.flatnonzero(toxic == kind)
        part[own] = np.arange(len(own)) % 3 == 2
    learn = np.flatnonzero(part == 0)
    if toxic[part == 1].sum() in (0, (part == 1).sum()):  # too few labels to fit the unit
        return model
    # of each slice only what is used again: narrow integers, no texts
    tokens = []
    for low, high in slices([texts[i] for i in learn]):
        t, y = Tokens([texts[i] for i in learn[low:high]], rolling), toxic[learn[low:high]]
        tokens.append(([f.astype(np.int32) for f in t.features], t.words.doc.astype(np.int32), t.words.first, y))
    seen = [np.zeros(1 << 20), np.zeros(1 << 20)]
    for features, doc, _, y in tokens:
        for f in features:
            pair = np.unique(doc.astype(np.int64) << 20 | f)
            for kind in (0, 1):
                seen[kind] += np.bincount(pair[y[pair >> 20] == kind] & int(_MASK), minlength=1 << 20)
    count = [max(1, int((toxic[learn] == k).sum())) for k in (0, 1)]
    odds = np.log((seen[1] + 0.1) / (count[1] + 0.2)) - np.log((seen[0] + 0.3) / (count[0] + 0.6))
    # a feature counts if chance explains its documents badly: a likelihood ratio of EVIDENCE nats or more
    share = count[1] / (count[0] + count[1])
    every = np.maximum(1, seen[0] + seen[1])
    rate = np.clip(seen[1] / every, 1e-9, 1 - 1e-9)
    ratio = seen[1] * np.log(rate / share) + seen[0] * np.log((1 - rate) / (1 - share))
    odds[(ratio < EVIDENCE) | (odds < 0)] = 0
    odds[0] = 0
    # labelled tokens; documents without a known feature only teach the bias and the transitions, so a tenth of them, weighted, does
    rng = np.random.default_rng(3)
    known = np.flatnonzero(odds)
    number = np.full(1 << 20, -1, np.int32)
    number[known] = np.arange(len(known))
    lots = []
    while tokens:
        features, doc, first, y = tokens.pop(0)
        if len(doc):
            strength = np.max([odds[f].astype(np.float32) for f in features], axis=0)
            busy = np.bincount(doc, weights=strength > 0.7, minlength=len(y)) > 0
            kept = (busy | (rng.random(len(y)) < 0.1)) & (np.diff(first) > 0)
            mine = np.flatnonzero(kept[doc])
            if len(mine):
                label = (strength >= 1.5)[mine] & (y[doc[mine]] == 1)
                lots.append(_Lot(np.diff(first)[kept], np.where(busy, 1.0, 10.0)[kept], label, [number[f[mine]] for f in features]))
    if not lots:
        return model
    total, toxic_words = sum(x.own_weight.sum() for x in lots), sum(x.own_weight[x.label].sum() for x in lots)
    real, steps = sum(x.real for x in lots), sum(x.pairs.sum() for x in lots)
    model.bias = float(np.log((toxic_words + 1) / (total - toxic_words + 1)))
    weights = np.zeros(len(known))
    slow = [np.zeros(len(known)), 0.0, np.zeros((2, 2))]
    for _ in range(rounds):
        sums = [x.gradient(weights, model.bias, model.moves) for x in lots]
        g = sum(x[0] for x in sums) - 0.02 * weights
        bias = sum(x[1] for x in sums) / total
        move = (real - sum(x[2] for x in sums)) / max(1.0, steps) - 0.001 * model.moves
        for k, (step, rate) in enumerate(((g, 0.5), (bias, 0.2), (move, 0.2))):
            slow[k] = slow[k] + step**2
            step = rate * step / (np.sqrt(slow[k]) + 1e-8)
            if k == 0:
                weights = weights + step
            elif k == 1:
                model.bias += float(step)
            else:
                model.moves = model.moves + step
    model.weights[known] = weights
    lots.clear()
    rest = np.flatnonzero(part == 1)
    inputs = []
    for low, high in slices([texts[i] for i in rest]):
        t = Tokens([texts[i] for i in rest[low:high]], rolling)
        inputs.append(summary(marginals(model, t), t.words.first))
    model.unit = _logistic(np.concatenate(inputs), toxic[rest].astype(float))
    return model


def held_out() -> Column:
    """Whether crc32 of doc_id's text has no remainder by FOLDS."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = BYTES) -> Model:
    """Fit on labelled documents that are not held out: at most ``sample`` of them, of ``most`` bytes in all, by a hash of doc_id.

    Ids and sizes are chosen first, from about three times as many as needed; only the chosen documents' texts are gathered.
    """
    marked = labels.where("toxic is not null and doc_id is not null").where(~held_out())
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit(7), "id")
    share = min(1.0, 3 * sample / max(1, marked.count()))
    # some labels may lack a document
    marked = marked.where(F.pmod(order, F.lit(1 << 32)) < int(share * (1 << 32))).orderBy(order, "id").limit(4 * sample)
    source = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = source.join(F.broadcast(marked), "id").select("id", "toxic", F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).distinct()
    chosen, held = [], 0
    for r in texts.orderBy(order, "id", "h").limit(sample).collect():
        if held + r["size"] <= most:
            held += r["size"]
            chosen.append((r["id"], r["h"], r["toxic"]))
    wanted = documents.sparkSession.createDataFrame(chosen, "id long, h long, toxic int")
    found = source.withColumn("h", F.xxhash64("text")).join(F.broadcast(wanted), ["id", "h"]).dropDuplicates(["id", "h"]).orderBy(order, "id", "h").select("text", "toxic").toArrow()
    raw, toxic = texts_of(found.column("text").combine_chunks()) if found.num_rows else [], found.column("toxic").to_pylist()
    del found
    return fit(raw, np.asarray(toxic, np.int64).clip(0, 1))


_SPAN = pa.struct([("begin", pa.int64()), ("stop", pa.int64()), ("probability", pa.float64())])


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, spans): the spans are code points of the text's offending words, neighbours joined."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(31)
        for b in batches:
            texts = texts_of(b.column(1))
            for low, high in slices(texts):
                scores, spans = score_texts(texts[low:high], model, rolling)
                yield to_batch({"doc_id": b.column(0).slice(low, high - low), "score": scores, "spans": spans}, schema)

    source = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id long, score double, spans array<struct<begin long, stop long, probability double>>")


def score_texts(texts: list[bytes], model: Model, rolling: Rolling) -> tuple[np.ndarray, list[list[dict]]]:
    if model.unit is None:
        return np.full(len(texts), model.share), [[] for _ in texts]
    t = Tokens(texts, rolling)
    w = t.words
    p = marginals(model, t)
    score = 1 / (1 + np.exp(-np.clip((summary(p, w.first) * model.unit).sum(axis=1), -30, 30)))
    spans: list[list[dict]] = [[] for _ in texts]
    hits = np.flatnonzero(p > 0.5)
    for d in np.unique(w.doc[hits]).tolist():
        begins, ends = w.places(texts[d])
        own = hits[w.doc[hits] == d] - w.first[d]
        cut = np.flatnonzero(np.diff(own) > 1) + 1
        for group in np.split(own, cut):
            spans[d].append({"begin": int(begins[group[0]]), "stop": int(ends[group[-1]]), "probability": round(float(p[w.first[d] + group].max()), 6)})
    return score, spans


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents, table(spark, sf_dir, "labels"))
    scored = score_documents(documents, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.to_json("spans").alias("spans"))


def clean_documents(documents: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, whose score is below a half."""
    names = documents.columns

    @F.pandas_udf("double")
    def score(text):  # noqa: ANN001, ANN202
        import pandas as pd

        raw = texts_of(pa.array(text, pa.string(), from_pandas=True))
        rolling = Rolling(31)
        return pd.Series(np.concatenate([score_texts(raw[low:high], model, rolling)[0] for low, high in slices(raw)]) if raw else np.zeros(0))

    whole = documents.select(F.struct(*[documents[f"`{c}`"] for c in names]).alias("doc"))
    kept = whole.where(score(F.col("doc.text").cast("string")) < 0.5)
    return kept.select(*[F.col("doc")[c].alias(c) for c in names])
