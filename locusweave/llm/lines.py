"""Line dedup by content-defined chunks of lines.

A text is cut at line feeds. A rolling hash over the hashes of the last ``reach`` lines decides whether a chunk ends behind a
line (``1 / every`` of lines), so the same passage is cut alike wherever it stands. Chunks of two or more lines with anything
but white space are compared across all documents: candidates by a 128-bit hash, then byte for byte. The first occurrence, by
doc_id and place, stays; others are removed with their line feeds.

``dedup_lines`` is that alone: it keeps what a passage has before its first and behind its last boundary. ``dedup_passages``
goes on from the chunks: of the lines that no repeated chunk covers, every two adjacent ones are compared in the same way, so a
passage of two lines or more that stood earlier goes whole, wherever it begins and ends. White lines between removed lines go
with them; a chunk's white lines at its edges stay otherwise.

A null text stays null, an empty one empty. Rows without a doc_id pass through unchanged and remove nothing elsewhere.
Texts of any length are read whole, and a text's bytes are in memory once for each task. Repeated rows (same doc_id and text) are
one document: nothing is removed from one for the other's sake. Of documents with one doc_id and different texts the one with the
smaller hash counts as the earlier. Every other column is kept, whatever its name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, row_key, table, texts_of, to_batch

REACH, EVERY = 2, 4


def chunk_bounds(lines: list[bytes], reach: int = REACH, every: int = EVERY) -> list[int]:
    """Line numbers behind which chunks end, by the lines there alone, so the same passage is cut alike wherever it stands."""
    hashes = [xxhash.xxh3_64_intdigest(x) for x in lines]
    ends, low, mask = [], 0, (1 << 64) - 1
    for i in range(len(lines)):
        rolled = 0
        for h in hashes[max(0, i - reach + 1) : i + 1]:
            rolled = (rolled * 0x9E3779B97F4A7C15 + h) & mask
        if (rolled >> 32) % every == 0 and i - low >= 1:
            ends.append(i + 1)
            low = i + 1
    if low < len(lines):
        ends.append(len(lines))
    return ends


def lines_of(text: bytes) -> list[bytes]:
    """The text's lines without line feeds; none after the last line feed."""
    lines = text.split(b"\n")
    if not lines[-1]:
        lines.pop()
    return lines


def chunks_of(text: bytes) -> list[bytes]:
    """The text's chunks, each with its line feeds; joined they are the text."""
    lines, out, low = lines_of(text), [], 0
    for end in chunk_bounds(lines):
        out.append(b"\n".join(lines[low:end]) + (b"\n" if end < len(lines) or text.endswith(b"\n") else b""))
        low = end
    return out


def _body(chunk: bytes) -> bytes | None:
    """What is compared: a chunk without its last line feed, if it has two lines or more and is not blank."""
    body = chunk[:-1] if chunk.endswith(b"\n") else chunk
    return body if b"\n" in body and not body.isspace() else None


def pair_bodies(text: bytes) -> list[bytes | None]:
    """Every two adjacent lines, without the second's line feed; nothing for two white ones."""
    lines = lines_of(text)
    return [None if not (a.strip() or b.strip()) else a + b"\n" + b for a, b in zip(lines, lines[1:])]


def pieces_of(text: bytes, pairs: bool) -> Iterator[tuple[int, int, int, bool, bytes]]:
    """(first line, lines, chunk, whether it is a pair, bytes) of each chunk and, with ``pairs``, pair of lines that is compared.

    A pair's chunk is the first line of the one that holds both lines; for a pair across chunks a negative number of its own.
    """
    lines, low = lines_of(text), 0
    for end in chunk_bounds(lines):
        body = b"\n".join(lines[low:end])
        if end - low > 1 and not body.isspace():
            yield low, end - low, low, False, body
        if pairs:
            for i, (a, b) in enumerate(zip(lines[low:end], lines[low + 1 : end + 1]), low):
                if a.strip() or b.strip():
                    yield i, 2, low if i + 1 < end else -1 - i, True, a + b"\n" + b
        low = end


def _kept(text: bytes, gone: set[int]) -> bytes:
    lines = lines_of(text)
    ends = [b"\n"] * (len(lines) - (not text.endswith(b"\n"))) + [b""]
    return b"".join(x + end for i, (x, end) in enumerate(zip(lines, ends)) if i not in gone)


def without_chunks(text: bytes, gone: set[int]) -> bytes:
    """The text without the chunks whose every adjacent lines are in ``gone``."""
    return _kept(text, {i + k for i in gone for k in (0, 1)})


def without_pairs(text: bytes, gone: set[int]) -> bytes:
    """The text without both lines of each pair in ``gone`` but two white ones, and without white lines that lie between removed ones."""
    lines = lines_of(text)
    out = {i + k for i in gone if lines[i].strip() or lines[i + 1].strip() for k in (0, 1)}
    at = sorted(out)
    for a, b in zip(at, at[1:]):
        if b - a > 1 and not any(x.strip() for x in lines[a + 1 : b]):
            out.update(range(a + 1, b))
    return _kept(text, out)


_HASHES = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("i", pa.int32()), ("n", pa.int32()), ("chunk", pa.int32()), ("pair", pa.bool_()), ("h1", pa.int64()), ("h2", pa.int64())])
_CANDIDATES = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("i", pa.int32()), ("n", pa.int32()), ("pair", pa.bool_()), ("key", pa.int64()), ("first", pa.bool_()), ("body", pa.binary())])


def _digest(body: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(body)
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def repeated_lines(documents: DataFrame, pairs: bool) -> DataFrame:
    """(doc_id, row, gone): numbers of adjacent lines that each document loses to repeated chunks and, with ``pairs``, to repeated pairs.

    Pairs within a repeated chunk are settled by it: they all stand earlier too, so none of them is anything's first occurrence.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("row"), F.col("text").cast("string").alias("text"))
    docs = docs.where("doc_id is not null and contains(text, '\n')")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for n, text in enumerate(texts_of(b.column(2))):
                for *piece, body in pieces_of(text, pairs):
                    at.append(n)
                    found.append((*piece, *_digest(body)))
            take = pa.array(at, pa.int64())
            columns = list(zip(*found)) or [[]] * 6
            yield to_batch({"doc_id": b.column(0).take(take), "row": b.column(1).take(take), **dict(zip(_HASHES.names[2:], map(list, columns)))}, _HASHES)

    hashed = materialize(docs.mapInArrow(hashes, "doc_id long, row long, i int, n int, chunk int, pair boolean, h1 long, h2 long").distinct(), "line-pieces")
    place = F.struct("doc_id", "row", "i")

    def repeats(pieces: DataFrame) -> DataFrame:
        known = pieces.groupBy("h1", "h2").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least <> most")
        known = known.select(F.xxhash64("h1", "h2").alias("key"), F.col("h1").alias("k1"), F.col("h2").alias("k2"), "least")
        # joined on a derived key, whose exchange is plain on both sides: a skewed one is split
        again = pieces.withColumn("key", F.xxhash64("h1", "h2")).join(known, "key").where("h1 = k1 and h2 = k2")
        return again.select("doc_id", "row", "i", "n", "pair", "key", (place == F.col("least")).alias("first"))

    again = repeats(hashed.where("not pair"))
    if pairs:
        again = materialize(again, "line-chunks")
        covered = again.where("not first").select("doc_id", "row", F.col("i").alias("chunk"))
        again = again.union(repeats(hashed.where("pair").join(covered, ["doc_id", "row", "chunk"], "left_anti")))
    wanted = again.groupBy("doc_id", "row").agg(F.collect_list(F.struct("i", "n", "pair", "key", "first")).alias("wanted"))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in _CANDIDATES}
            ids, rows, wants = b.column(0), b.column(1), b.column(3).to_pylist()
            for n, text in enumerate(texts_of(b.column(2))):
                own = lines_of(text)
                for w in wants[n]:
                    body = b"\n".join(own[w["i"] : w["i"] + w["n"]])
                    for name, value in zip(out, (ids[n].as_py(), rows[n].as_py(), *w.values(), body), strict=True):
                        out[name].append(value)
            yield to_batch(out, _CANDIDATES)

    found = docs.join(wanted, ["doc_id", "row"]).select("doc_id", "row", "text", "wanted")
    found = materialize(found.mapInArrow(candidates, "doc_id long, row long, i int, n int, pair boolean, key long, first boolean, body binary").distinct(), "line-candidates")
    firsts = found.where("first").select("key", F.col("pair").alias("paired"), F.col("body").alias("kept"), F.col("doc_id").alias("of"), F.col("row").alias("at"), F.col("i").alias("from"))
    # a piece that overlaps its first occurrence in the same text stays
    same = found.where("not first").join(firsts, "key").where("pair = paired and body = kept and (doc_id <> of or row <> at or i - from >= 2)")
    return same.select("doc_id", "row", F.explode(F.sequence("i", F.col("i") + F.col("n") - 2)).alias("i")).groupBy("doc_id", "row").agg(F.collect_set("i").alias("gone"))


def dedup_lines(documents: DataFrame) -> DataFrame:
    """``documents`` with repeated chunks of lines cut out of ``text``; n_chars, if there, follows."""
    return _cut(documents, repeated_lines(documents, pairs=False), without_chunks)


def dedup_passages(documents: DataFrame) -> DataFrame:
    """``documents`` with every run of two or more lines that stood earlier cut out of ``text``; n_chars, if there, follows."""
    return _cut(documents, repeated_lines(documents, pairs=True), without_pairs)


def _cut(documents: DataFrame, repeated: DataFrame, rest: Callable[[bytes, set[int]], bytes]) -> DataFrame:
    gone = repeated.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col("gone").alias("__gone"))
    names = documents.columns
    whole = documents.select(F.struct(*[documents[f"`{c}`"] for c in names]).alias("__doc"))
    whole = whole.withColumns({"__id": F.col("__doc.doc_id").cast("long"), "__row": F.when(F.col("__doc.doc_id").isNotNull(), row_key("__doc.doc_id", "__doc.text"))})
    schema = documents.schema

    def cut(texts: pa.Array, gone_: pa.Array) -> list:
        out = texts.cast(pa.string()).to_pylist()
        for n, g in enumerate(gone_.to_pylist()):
            if g:
                out[n] = rest(out[n].encode(), set(g)).decode()
        return out

    @F.pandas_udf("string")
    def without(text, gone_):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(cut(pa.array(text, pa.string()), pa.array(gone_, pa.list_(pa.int32()), from_pandas=True)), dtype=object)

    joined = whole.join(gone, ["__id", "__row"], "left")
    text = F.when(F.col("__gone").isNull(), F.col("__doc.text")).otherwise(without(F.when(F.col("__gone").isNotNull(), F.col("__doc.text")), F.col("__gone")))  # untouched texts stay in the JVM
    joined = joined.select("__doc", text.alias("__text"))
    columns = []
    for c in names:
        if c == "text":
            columns.append(F.col("__text").alias(c))
        elif c == "n_chars":
            columns.append(F.length("__text").cast(schema[c].dataType).alias(c))
        else:
            columns.append(F.col("__doc")[c].alias(c))
    return joined.select(*columns)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    kept = dedup_passages(documents.select("doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).alias("before")))
    return kept.select("doc_id", F.col("before").cast("long").alias("n_chars"), (F.col("before") - F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: A line goes if it and a neighbour, not both white, stood as neighbours earlier (in the same text: two lines earlier or more); white lines between go along.
ORACLE = r"""
with docs as (select distinct doc_id, text from documents where doc_id is not null and contains(text, chr(10))),
cut as (select doc_id, string_split(case when text like '%' || chr(10) then left(text, length(text) - 1) else text end, chr(10)) as lines, text like '%' || chr(10) as closed from docs),
numbered as (select doc_id, lines[i] as line, i, i < len(lines) or closed as feed, lines[i + 1] as behind, i < len(lines) as paired from (select *, unnest(range(1, len(lines) + 1)) as i from cut)),
lined as (select *, regexp_full_match(line, '[ 	

]*') as white, paired and not (regexp_full_match(line || coalesce(behind, ''), '[ 	

]*')) as compared from numbered),
pairs as (select doc_id, i, min((doc_id, i)) over (partition by line || chr(10) || behind) as least from lined where compared),
gone as (select doc_id, i from pairs where least[1] <> doc_id or i - least[2] >= 2),
out as (select doc_id, i from gone union select doc_id, i + 1 from gone),
marked as (select l.*, o.i is not null as dropped from lined l left join out o on l.doc_id = o.doc_id and l.i = o.i),
between_ as (select *, last_value(case when dropped then 1 when not white then 0 end ignore nulls) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as before,
  first_value(case when dropped then 1 when not white then 0 end ignore nulls) over (partition by doc_id order by i rows between 1 following and unbounded following) as after from marked),
kept as (select doc_id, string_agg(line || case when feed then chr(10) else '' end, '' order by i) filter (where not dropped and not (white and coalesce(before = 1 and after = 1, false))) as text from between_ group by doc_id),
final as (select d.doc_id, d.text, case when k.doc_id is null then coalesce(d.text, '') else coalesce(k.text, '') end as rest from documents d left join kept k on d.doc_id = k.doc_id)
select doc_id, cast(coalesce(length(text), 0) as bigint) as n_chars, cast(coalesce(length(text), 0) - length(rest) as bigint) as n_removed, sha256(rest) as kept_sha256 from final
"""
