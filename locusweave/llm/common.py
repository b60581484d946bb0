"""Helpers shared by the corpus operators: tables, shared storage, word arrays."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each Spark application, so that Python workers can import it anywhere."""
    context = spark.sparkContext
    if getattr(context, "_locusweave_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="locusweave-")) / "locusweave_package.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(target))
    context._locusweave_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a temporary one only where all run on one machine.

    What operators write there is read by their results, so it stays until the folder's owner deletes it.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="locusweave-")
        atexit.register(shutil.rmtree, where.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, on files that every executor sees."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(*columns: str):
    """A 64-bit key for one row's identity, so that repeated ids with different texts stay apart."""
    return F.xxhash64(*columns)


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], n: str, total: int, most: int = 10_000) -> DataFrame:
    """Inner join where ``right``, one row a key, knows how many of ``left``'s ``total`` rows a key has (column ``n``).

    Keys of more than a ``most``-th of the rows are fewer than ``most``, whatever the tables' sizes: they are sent to where the rows
    are. The others are joined by key, with no key beyond that share in a task. ``left`` and ``right`` are read more than once, so they should be written tables.
    """
    bound = total / most
    large = right.where(F.col(n) > bound)
    there = left.join(F.broadcast(large), keys)
    rest = left.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(right.where(F.col(n) <= bound), keys)
    return there.unionByName(rest)


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = [c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else pa.array(c, type=f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, nulls as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of text that are handled at a time; arrays of eight bytes a byte stay within a processor's cache sizes.
SLICE = 1 << 20


def slices(texts: list[bytes], limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; a longer document is a range of its own."""
    low = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield low, i
            low, size = i, 0
        size += len(text) + 1
    if low < len(texts):
        yield low, len(texts)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts, laid out one after the other with one space behind each.

    ``text``: those bytes; ``start``/``end``: a word's bytes; ``doc``: its text; ``first``: number of each text's first
    word (one more entry than texts).
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.concatenate(([0], np.cumsum(sizes + 1)))
        white = _WHITE[raw]
        before = np.concatenate(([True], white[:-1]))
        opens = np.flatnonzero(before & ~white)
        kept = ~(before & white)
        body = np.where(white, np.uint8(32), raw)[kept]
        self.array = _LOWER[body] if lower else body
        self.text = self.array.tobytes()
        closes = np.flatnonzero(white & ~before)
        lengths = closes - opens
        self.end = np.cumsum(lengths + 1) - 1
        self.start = self.end - lengths
        self.first = np.searchsorted(opens, begins)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    @staticmethod
    def places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each word of a text, in code points."""
        raw = np.frombuffer(text, np.uint8)
        begin, end = runs(~_WHITE[raw])
        point = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        return point[begin], point[end]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (three rounds of shift, xor and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes modulo 2**64 of any stretches of an array, by prefix sums."""

    def __init__(self, seed: int):
        random = np.random.default_rng(seed)
        self.table = random.integers(0, 2**64, 256, dtype=np.uint64)
        self.base = int(random.integers(0, 2**63)) * 2 + 1
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                powers = np.full(n, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))

    def of(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of ``values[start:end]``; values: bytes (looked up in a table) or 64-bit hashes."""
        return self.many(values, [(start, end)])[0]

    def many(self, values: np.ndarray, stretches: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        self._powers(len(values) + 1)
        x = self.table[values] if values.dtype == np.uint8 else values
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * self.up[: len(x)], dtype=np.uint64)))
        return [mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64)) for start, end in stretches]


def release() -> None:
    """Give memory that Arrow and the C library hold unused back to the system: idle Python workers stay beside an executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of a task's batches, which leaves no unused memory in its worker."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from run(batches)
        release()

    return whole


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end (exclusive) of each stretch of true values."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], target: int = 1) -> Iterator[pa.Table]:
    """Whole groups of rows of a stream sorted by ``keys``; small groups come together, ``target`` rows or more at a time."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < target:
            continue
        merged = pa.Table.from_batches(held).combine_chunks()
        last = [merged[k][merged.num_rows - 1].as_py() for k in keys]
        cut = merged.num_rows
        same = np.ones(cut, bool)
        for k, v in zip(keys, last, strict=True):
            same &= np.asarray(merged[k].to_numpy(zero_copy_only=False) == v)
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield merged.slice(0, cut)
        rest = merged.slice(cut)
        held, count = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links reach, of every node with a link.

    Rounds of neighbours' least labels and pointer jumping; every round's labels are written, none come to the driver.
    """
    both = materialize(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), "links")
    labels = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("l")), "labels")
    while True:
        seen = both.join(labels.select(F.col("u").alias("v"), "l"), "v").select("u", "l")
        step = materialize(seen.unionByName(labels).groupBy("u").agg(F.min("l").alias("l")), "labels")
        jumped = step.join(step.select(F.col("u").alias("l"), F.col("l").alias("l2")), "l").select("u", F.col("l2").alias("l"))
        jumped = materialize(jumped, "labels")
        moved = jumped.join(labels.withColumnRenamed("l", "old"), "u").where("l <> old").limit(1).count()
        labels = jumped
        if not moved:
            return labels.select(F.col("u").alias("node"), F.col("l").alias("component"))
