"""Token counts of whole texts by two lookups inside the tasks that read them; no pre-token is ever shuffled.

A pre-token is a run of spaces with the characters behind it. No piece of the vocabulary goes on past such a place, so a text's
tokens are those of its pre-tokens (a model for which that can't be shown gets its texts whole). First tier: the lengths of the most
frequent pre-tokens, broadcast as one table of at most ``most`` entries, found in a sample of about ``sample`` rows. Second
tier: a worker's cache of what it has encoded before; only what neither knows is encoded. The sample and both tables decide the
time that counting takes, never a count.

Null and empty texts have no tokens and no bytes. Texts of any length are counted whole; a document's pre-tokens are what a task
holds. Every row gives one row, repeated rows and rows without a doc_id too. Extra columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table, to_batch

TOKENIZER = "piece_bpe_32k.model"
#: Entries of the broadcast table, their longest characters, and rows of the sample that finds them.
FREQUENT, SHORT, SAMPLE = 1 << 16, 24, 4_000
#: Entries that a worker keeps, their longest characters, and tasks that count the sample.
CACHED, LONGEST, TASKS = 300_000, 64, 16
LIMIT = 4096

_MARK = "▁"


class Model:
    """A sentencepiece model, and whether texts may be cut where spaces begin."""

    def __init__(self, path: str | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as file:
            spec = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        plain = spec.normalizer_spec
        kept = plain.add_dummy_prefix and not plain.remove_extra_whitespaces and plain.escape_whitespaces and not plain.precompiled_charsmap
        ends = spec.trainer_spec.treat_whitespace_as_suffix or any(p.type == p.USER_DEFINED or re.search(f"[^{_MARK}]{_MARK}", p.piece) for p in spec.pieces)
        self.cuts = bool(kept) and not ends
        self.space = self.lengths(["a "])[0] - self.lengths(["a"])[0]

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.pieces.encode(texts, num_threads=1)]

    def lengths_of(self, keys: list[str]) -> list[int]:
        """Tokens of pre-tokens named by ``pre_tokens``; the empty name is one space alone."""
        return [n if key else self.space for key, n in zip(keys, self.lengths(keys), strict=True)]


def pre_tokens(text: str) -> list[str]:
    """A text's pre-tokens, each without its first space; the tokenizer puts one before the text and before each name."""
    if _MARK in text:
        text = text.replace(_MARK, " ")
    if "  " in text or text[:1] in ("", " ") or text[-1] == " ":
        return [x[1:] for x in re.findall(" +[^ ]*", " " + text)] if text else []
    return text.split(" ")


_model: dict[str | None, Model] = {}
_cache: dict[str | None, dict[str, int]] = {}


def model_at(path: str | None) -> Model:
    """The worker's model, loaded once."""
    if path not in _model:
        _model[path] = Model(path)
        _cache[path] = {}
    return _model[path]


class Counts:
    """Counts texts with the first tier's ``frequent`` lengths and the worker's cache of this model."""

    def __init__(self, path: str | None, frequent: dict[str, int]):
        self.model, self.frequent = model_at(path), frequent
        self.cache = _cache[path]

    def of(self, texts: list[str]) -> list[int]:
        if not self.model.cuts:
            return self.model.lengths(texts)
        frequent, cache, totals, left = self.frequent.get, self.cache, [], []
        for text in texts:
            names = pre_tokens(text)
            found = list(map(frequent, names, repeat(0)))
            totals.append(sum(found))
            left.append([x for x, n in zip(names, found, strict=True) if not n])
        new = list({x for names in left for x in names if x not in cache})
        cache.update(zip(new, self.model.lengths_of(new), strict=True))
        totals = [n + sum(map(cache.__getitem__, names)) for n, names in zip(totals, left, strict=True)]
        if len(cache) > CACHED:
            cache.clear()
        for x in new:
            if len(x) > LONGEST:
                cache.pop(x, None)
        return totals


def frequent_lengths(docs: DataFrame, path: str | None = None, most: int = FREQUENT, sample: int = SAMPLE) -> dict[str, int]:
    """Lengths of at most ``most`` pre-tokens of at most SHORT characters, the most frequent ones of a random sample.

    The sampled rows are dealt to TASKS tasks; each sends its own ``most`` most frequent to the driver, which adds them up.
    """
    model = model_at(path)
    rows = docs.count()
    if not rows or not model.cuts:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(x for x in pre_tokens(text) if len(x) <= SHORT)
                if len(seen) > 16 * most:
                    seen = Counter(dict(seen.most_common(8 * most)))
        best = seen.most_common(most)
        yield pa.RecordBatch.from_pydict({"name": pa.array([x for x, _ in best], pa.string()), "n": pa.array([n for _, n in best], pa.int64())})

    drawn = docs.select("text").where("text is not null").sample(min(1.0, sample / rows), 11).repartition(TASKS)
    counts = drawn.mapInArrow(run, "name string, n long").toArrow()
    total: Counter[str] = Counter()
    for name, n in zip(counts["name"].to_pylist(), counts["n"].to_pylist(), strict=True):
        total[name] += n
    best = sorted(total, key=lambda x: (-total[x], x))[:most]
    return dict(zip(best, model.lengths_of(best), strict=True))


def count_tokens(docs: DataFrame, limit: int = LIMIT, path: str | None = None, most: int = FREQUENT, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; ``path``: a sentencepiece model that all executors have."""
    frequent = frequent_lengths(docs, path, most, sample)
    sent = docs.sparkSession.sparkContext.broadcast(frequent)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(path, sent.value)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0)
            texts = [x or "" for x in batch.column(1).to_pylist()]
            totals = [n for low, high in slices(texts) for n in counts.of(texts[low:high])]
            yield to_batch({"doc_id": batch.column(0), "n_bytes": sizes.cast(pa.int64()), "n_tokens": totals, "over_limit": [n > limit for n in totals]}, schema)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
