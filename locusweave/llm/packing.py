"""Best-fit packing of tokenized documents, improved by a swap-based local search.

A document is its tokens and an end token; what is longer than a sequence is cut into full pieces behind a shorter first
one. Full pieces are sequences. The others are dealt into groups of bounded size, packed best-fit in order of falling
length, then improved: single documents move, or are exchanged one for one or two for one, between underfull bins whenever
that increases the sum of squared fills, from the emptiest bin on, until it is empty. What is left in underfull bins is
dealt into fewer groups and packed again, so that little is lost at the groups' edges.

Null and empty texts are the end token alone; a null doc_id is kept; repeated rows are packed each for itself. Extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import groups, materialize, released, table, to_batch

LENGTH, END, GROUP = 1024, 2, 8192
TOKENIZER = "byte_bpe_50k.json"


class Encoder:
    """Token ids as bytes (little-endian, 32 bits each), with a bounded memory of pieces between single spaces.

    Where a single space stands between two characters that are not white space, the tokenizer's own splitting starts a new
    piece at the space, so that a text's ids are those of its pieces. Pieces that are not in memory get their ids from the
    tokenizer's vocabulary, read as merge ranks: the library that reads its file takes about eight times as long for pieces
    that it sees for the first time, and gives the same ids (held by the tests). Texts for which the rule at spaces doesn't
    hold, or with a special token's string, go to that library whole.
    """

    def __init__(self, path: str | None = None, most: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.model = Tokenizer.from_file(path)
        # byte-level vocabularies write a byte that doesn't print as the next free code point above 255
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(x for x in range(256) if x not in plain)}
        special = {str(t.content) for t in self.model.get_added_tokens_decoder().values()}
        ranks = {bytes(byte[c] for c in token): i for token, i in self.model.get_vocab().items() if token not in special}
        split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.ids_of = tiktoken.Encoding("byte-level", pat_str=split, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.most, self.known, self.special = most, {}, special

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [array("I", self.model.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]

    def _odd(self, piece: str) -> bool:
        return not piece or piece[0].isspace() or piece[-1].isspace() or any(x in piece for x in self.special)

    def _one(self, text: str) -> bytes:
        known, ids_of = self.known, self.ids_of
        head, *rest = text.split(" ")
        if rest and self._odd(head) or any(x in head for x in self.special):
            return self._raw([text])[0]
        found = [known.get(x) for x in rest]
        if None in found:
            if len(known) > self.most:
                known.clear()
            for n, x in enumerate(rest):
                if found[n] is None:
                    if (ids := known.get(x)) is None:
                        if self._odd(x):
                            return self._raw([text])[0]
                        ids = known[x] = array("I", ids_of(" " + x)).tobytes()
                    found[n] = ids
        return array("I", ids_of(head)).tobytes() + b"".join(found)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._one(text) for text in texts]


_PIECE = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"


def pieces(documents: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """The pieces of every document; ``copy`` tells repeated rows of a task apart."""
    source = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    end = np.asarray([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = Encoder(path), 0
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in _PIECE}
            names = b.column(0).to_pylist()
            for low in range(0, len(names), 64):
                texts = [t or "" for t in b.column(1).slice(low, 64).to_pylist()]
                for name, ids in zip(names[low : low + 64], encoder.encode(texts), strict=True):
                    ids += end
                    n = len(ids) // 4
                    at = [0, *range(n % length or min(n, length), n + 1, length)]
                    for i, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)):
                        for key, value in zip(out, (name, number, i, x, y - x, zlib.crc32(ids[4 * x : 4 * y])), strict=True):
                            out[key].append(value)
                    number += 1
            if out["piece"]:
                yield to_batch(out, _PIECE)

    return source.mapInArrow(released(run), _PIECES)


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Bins of item numbers: in order of falling size, each into the fullest bin that holds it."""
    bins: list[list[int]] = []
    open_: dict[int, list[int]] = {}
    spaces: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(spaces, sizes[i])
        if at < len(spaces):
            space = spaces[at]
            b = open_[space].pop()
            if not open_[space]:
                del open_[space], spaces[at]
        else:
            space, b = length, len(bins)
            bins.append([])
        bins[b].append(i)
        if left := space - sizes[i]:
            if left not in open_:
                open_[left] = []
                insort(spaces, left)
            open_[left].append(b)
    return bins


def _bits(x: int) -> list[int]:
    out = []
    while x:
        out.append((x & -x).bit_length() - 1)
        x &= x - 1
    return out


class Bin:
    """Documents by size, with the sums that one and two of them make, as bits of an integer."""

    def __init__(self, items: list[int], sizes: list[int]):
        self.sizes, self.of, self.fill, self.changed = sizes, {}, 0, 0
        for i in items:
            self.of.setdefault(sizes[i], []).append(i)
            self.fill += sizes[i]
        self.count()

    def count(self) -> None:
        self.one = sum(1 << s for s in self.of)
        self.two = 0
        for s, own in self.of.items():
            self.two |= (self.one if len(own) > 1 else self.one & ~(1 << s)) << s
        self.sums = [(s, s in self.of) for s in [0, *_bits(self.one | self.two)]]  # and whether one document alone makes it

    def pair(self, total: int) -> tuple[int, int]:
        return next((s, total - s) for s in self.of if total - s in self.of and (2 * s != total or len(self.of[s]) > 1))

    def out(self, size: int) -> int:
        own = self.of[size]
        i = own.pop()
        if not own:
            del self.of[size]
        return i

    def put(self, items: list[int]) -> None:
        for i in items:
            self.of.setdefault(self.sizes[i], []).append(i)

    def items(self) -> list[int]:
        return [i for own in self.of.values() for i in own]


def exchange(a: Bin, b: Bin, length: int) -> bool:
    """Let ``a`` give ``b`` as many tokens as fit by one exchange that raises the sum of squared fills, if there is one.

    One document, or two for one, or one for one or two: d tokens more in b than in a raise the sum if b then holds more than a did.
    Exchanges exist for d where the sums of a, shifted by d, and those of b have a bit in common.
    """
    space, least = length - b.fill, max(0, a.fill - b.fill)
    if space <= least:
        return False
    best = least
    if space - least <= len(b.sums):
        sums = 1 | b.one | b.two
        for d in range(space, least, -1):
            if found := (a.one >> d) & sums:
                best, back, two = d, (found & -found).bit_length() - 1, False
                break
            if found := (a.two >> d) & b.one:
                best, back, two = d, (found & -found).bit_length() - 1, True
                break
    else:
        for t, single in b.sums:  # the largest sum of a that fits in exchange for t
            mask = (1 << (t + space + 1)) - 1
            d = (a.one & mask).bit_length() - 1 - t
            if d > best:
                best, back, two = d, t, False
            if single and (d := (a.two & mask).bit_length() - 1 - t) > best:
                best, back, two = d, t, True
    if best == least:
        return False
    give = a.pair(back + best) if two else (back + best,)
    take = () if back == 0 else (back,) if b.one >> back & 1 else b.pair(back)
    given, taken = [a.out(s) for s in give], [b.out(s) for s in take]
    a.put(taken)
    b.put(given)
    a.fill, b.fill = a.fill - best, b.fill + best
    a.count()
    b.count()
    return True


class Index:
    """What bins could take in exchange, as intervals of sizes: all at once tells which bins a giver has something for."""

    def __init__(self, bins: list[Bin], length: int):
        self.bins = bins
        self.any = self._entries([[t for t, _ in b.sums] for b in bins], length)
        self.one = self._entries([[t for t, single in b.sums if single] for b in bins], length)

    def _entries(self, sums: list[list[int]], length: int) -> tuple[np.ndarray, ...]:
        sizes = np.fromiter(map(len, sums), np.int64, len(sums))
        fill = np.repeat(np.fromiter((b.fill for b in self.bins), np.int64, len(self.bins)), sizes)
        t = np.fromiter((x for own in sums for x in own), np.int64, int(sizes.sum()))
        return np.repeat(np.arange(len(sums)), sizes), t, t + length - fill, fill

    def near(self, a: Bin) -> list[Bin]:
        """Bins with which an exchange exists, the fullest (last) first."""
        found = np.zeros(len(self.bins), bool)
        for (owner, t, high, fill), gives in ((self.any, _bits(a.one)), (self.one, _bits(a.two))):
            low = t + np.maximum(0, a.fill - fill)
            for g in gives:
                found[owner[(low < g) & (g <= high)]] = True
        return [self.bins[i] for i in np.flatnonzero(found)[::-1]]


def improve(bins: list[list[int]], sizes: list[int], length: int) -> list[list[int]]:
    """Bins after exchanges between every two underfull ones, the emptiest giving first, until none raises the sum of squares.

    The sum is bounded and grows by integers, so the search ends. Two bins that haven't changed since they last met have nothing to
    exchange; an index of a turn's bins finds partners, but for those that changed since, which are tried each.
    """
    every = [Bin(b, sizes) for b in bins]
    full = [b for b in every if b.fill == length]
    under = [b for b in every if b.fill < length]
    turn, moved = 0, True
    while moved:
        moved, turn = False, turn + 1
        under.sort(key=lambda b: b.fill)
        indexes: list[Index] = []
        changed: dict[int, Bin] = {}
        for a in under:
            if not indexes or len(changed) > 32:
                indexes = [Index(under, length), Index([b for b in under if b.changed >= turn - 1], length)]
                changed = {}
            for b in [*changed.values(), *indexes[a.changed < turn - 1].near(a)] if a.fill else ():
                while a is not b and a.fill and 0 < b.fill < length and exchange(a, b, length):
                    moved, a.changed, b.changed = True, turn, turn
                    changed[id(a)], changed[id(b)] = a, b
        full += [b for b in under if b.fill == length]
        under = [b for b in under if 0 < b.fill < length]
    return [b.items() for b in full + under]


_PLACED = pa.schema([*_PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64()), ("full", pa.bool_())])
_PLACES = _PIECES + ", sequence_id long, offset long, full boolean"


def _pack_groups(items: DataFrame, count: int, length: int, size: int, salt: int) -> DataFrame:
    """One round: items dealt by hash into groups of about ``size``, each packed on its own."""
    number = max(1, -(-count // size))
    dealt = items.withColumn("g", F.pmod(F.xxhash64(F.lit(salt), "doc_id", "copy", "piece", "ids_crc32"), F.lit(number)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["g"], 1):
            g = t["g"].to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(g)) + 1, len(g)]
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = t.slice(low, high - low)
                sizes = part["length"].to_pylist()
                bins = improve(best_fit(sizes, length), sizes, length)
                order = [i for b in bins for i in b]
                offset, full = [], []
                for b in bins:
                    at = 0
                    for i in b:
                        offset.append(at)
                        at += sizes[i]
                    full += [at == length] * len(b)
                name = [((salt << 56) | (int(g[low]) << 16) | k) for k, b in enumerate(bins) for _ in b]
                taken = part.take(pa.array(order, pa.int64())).combine_chunks()
                columns = {f.name: taken[f.name].combine_chunks() for f in _PIECE}
                yield to_batch(columns | {"sequence_id": name, "offset": offset, "full": full}, _PLACED)

    return dealt.repartitionById(number, "g").sortWithinPartitions("g", "doc_id", "copy", "piece").mapInArrow(released(run), _PLACES)


def pack(documents: DataFrame, length: int = LENGTH, size: int = GROUP, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    every = materialize(pieces(documents, length, path), "pieces")
    full = every.where(F.col("length") == length)
    # full pieces are sequences of their own: numbered by task and row, below zero
    done = [full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))]
    rest = every.where(F.col("length") < length)
    count, salt = rest.count(), 1
    while count:
        number = -(-count // size)
        placed = materialize(_pack_groups(rest, count, length, size, salt), "packed")
        open_ = placed.where("not full").drop("sequence_id", "offset", "full")
        left = 0 if number == 1 else open_.count()
        if -(-left // size) in (0, number):  # as many groups again would have no fewer edges
            done.append(placed.drop("full"))
            break
        done.append(placed.where("full").drop("full"))
        rest, count, salt = open_, left, salt + 1
    out = done[0].select(*_PIECE.names, "sequence_id", "offset")
    for more in done[1:]:
        out = out.unionByName(more.select(*_PIECE.names, "sequence_id", "offset"))
    return out.drop("copy")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
