"""Operators against brute force, on tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from locusweave.llm import audio, jaccard, lines, mixing, packing, pages, secrets, simhash, substrings, topk, toxicity
from locusweave.llm.common import Rolling, Words
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, __doc string, copies int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeéñß") for _ in range(r.randint(1, 6))) for _ in range(400)]

    def prose(n):
        return " ".join(r.choice(vocabulary) + r.choice(["", ".", "\n", ""]) for _ in range(n))

    shared, base = prose(70), prose(300)
    texts = [prose(r.randint(0, 120)) for _ in range(40)] + [None, "", "  \n\t ", "one", "two words", prose(5000), shared, prose(20) + "\n" + shared + "\n" + prose(30)]
    texts += [base, base, base.upper()] + [base + f"\n{prose(5)}" for _ in range(3)] + ["x " * 200, "x " * 90, prose(10) + "\nalpha beta\ngamma\n\ndelta\n" * 9]
    rows = [(i, t, "en", ["s0", "s1", None][i % 3], len(t or ""), i, "clash", 7) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return rows + [rows[0], (None, base, "en", "s0", 1, 1, "clash", 7), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def documents(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("limit", [substrings.LIMIT, 2000, 1])
def test_substrings(spark, corpus, documents, limit):
    """Against all windows; with small limits groups are halved, down to single windows."""
    rows = list(corpus)
    if limit < substrings.LIMIT:
        r = random.Random(3)
        shared = [str(r.random()) for _ in range(30)]  # a passage shorter than a window in many surroundings, some of them shared
        other = [[str(r.random()) for _ in range(40)] for _ in range(6)]
        for i in range(60):
            rows.append((1000 + i, " ".join(r.choice(other)[r.randint(0, 9) :] + shared + r.choice(other)[: r.randint(5, 40)]), "en", "s", 1, i, "clash", 7))
        documents = spark.createDataFrame(rows, SCHEMA)
    first = {}
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - 49):
            if d is not None:
                first[tuple(w[i : i + 50])] = min(d, first.get(tuple(w[i : i + 50]), d))
    want = []
    for d, t, *_ in rows:
        w, gone = words(t), set()
        for i in range(len(w) - 49):
            if d is not None and first[tuple(w[i : i + 50])] < d:
                gone |= set(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((-1 if d is None else d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = [(-1 if r[0] is None else r[0], *r[1:]) for r in substrings.dedup_substrings(documents, limit=limit).collect()]
    assert sorted(got) == sorted(want) and any(x[2] for x in want)


def test_substrings_of_one_passage_many_times(spark, empty):
    """A document that repeats a passage 10^5 times is one small group; what it shares with an earlier document goes."""
    passage = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, passage), (2, (passage + " ") * 100_000), (3, "x " + passage)], "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_removed) for r in substrings.dedup_substrings(df).collect()} == {1: (60, 0), 2: (6_000_000, 6_000_000), 3: (61, 60)}
    assert substrings.dedup_substrings(empty).count() == 0


def test_suffix_tree():
    """Order, common prefixes and nodes against sorted suffixes."""
    r = random.Random(1)
    for window, letters in ((3, "ab"), (5, "abc"), (2, "a")):
        texts = [" ".join(r.choice(letters) for _ in range(r.randint(0, 25))) for _ in range(12)]
        w = Words([t.encode() for t in texts])
        tree = substrings.Tree(w, Rolling(1).of(w.array, w.start, w.end), window)
        parts = [t.split() for t in texts]
        suffix = {w.first[d] + i: p[i:] for d, p in enumerate(parts) for i in range(len(p) - window + 1)}
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905, E731
        assert sorted(tree.leaves.tolist()) == sorted(suffix)
        assert tree.lcp.tolist() == [common(suffix[a], suffix[b]) for a, b in zip(tree.leaves[:-1], tree.leaves[1:], strict=True)]
        groups = {}
        for i, s in suffix.items():
            groups.setdefault(tuple(s[:window]), set()).add(i)
        begin, end, depth = tree.nodes(window)
        assert {frozenset(tree.leaves[x:y].tolist()) for x, y in zip(begin, end, strict=True)} == {frozenset(g) for g in groups.values() if len(g) > 1}
        for x, y, d in zip(begin, end, depth, strict=True):
            leaves = [suffix[i] for i in tree.leaves[x:y]]
            assert d == min(common(leaves[0], s) for s in leaves[1:]) >= window


def test_groups_beyond_the_limit_pass_unheld():
    r = np.random.default_rng(4)
    key = np.sort(np.r_[r.integers(0, 50, 400), np.full(3000, 25)])
    batches = [pa.record_batch({"key": key[i : i + 70], "content": pa.array([b"x" * 50] * len(key[i : i + 70]), pa.binary())}) for i in range(0, len(key), 70)]
    seen = [(t["key"].to_numpy(), over) for t, over in substrings.sized(iter(batches), 20_000)]
    assert np.array_equal(np.concatenate([k for k, _ in seen]), key)
    assert {int(x) for k, over in seen if over for x in k} == {25} and all(len(k) * 58 < 40_000 for k, _ in seen)
    whole = [set(k.tolist()) for k, over in seen if not over]
    assert sum(map(len, whole)) == len(set().union(*whole)) and 25 not in set().union(*whole)


@pytest.mark.parametrize("few", [64, 0])
def test_top_k(spark, few, monkeypatch):
    """Against all scores, in one block and in many; with FEW at 0 every range is refined to one value."""
    monkeypatch.setattr(topk, "FEW", few)
    r = np.random.default_rng(2)
    vectors = [r.integers(-3, 3, 4) / 4 for _ in range(300)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(300, None), (350, [1.0, None, 0.0, 0.0]), (351, [float("nan")] * 4), (352, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (7, rows[7][1]), (50, rows[50][1]), (250, [2000.0, -3.25]), (360, [])]
    df = spark.createDataFrame([(*x, "clash", 1, 2) for x in rows], "vec_id long, embedding array<double>, q string, rank int, block int")
    ok = [(i, np.floor(256 * np.array((v + [0.0] * 4)[:4])).astype(int)) for i, v in rows if i is not None and i not in (300, 350, 351, 352)]
    for block in (4, 100) if few else (100,):
        got = Counter(tuple(x) for x in topk.top_k(df, df.where("vec_id % 50 = 0"), 5, block).collect())
        want = Counter()
        for q, v in {(q, tuple(v)) for q, v in ok if q % 50 == 0}:
            for n, (s, i) in enumerate(sorted((-int(np.array(v) @ u), i) for i, u in ok if i != q)[:5]):
                want[q, n + 1, i, -s] += 1
        assert got == want
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id < 3"), df.where("vec_id = 0")).count() == 2
    with pytest.raises(ValueError, match="62 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e30])], "vec_id long, embedding array<double>"), spark.createDataFrame([(50, [1e30])], "vec_id long, embedding array<double>"))


def test_top_k_of_crowded_scores(spark):
    """Over FEW scores in a bin of fewer than BINS values: the next pass's bins reach beyond it, and no score counts twice."""
    r = np.random.default_rng(0)
    centre = r.normal(size=16)
    data = (centre / np.linalg.norm(centre) + r.normal(size=(2000, 16)) * 0.002).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    v = np.floor(256 * data.astype(np.float64)).astype(np.int64)
    best = {q: sorted((-int(s), i) for i, s in enumerate(v @ v[q]) if i != q)[:5] for q in range(0, 2000, 50)}
    want = sorted((q, n + 1, i, -s) for q, found in best.items() for n, (s, i) in enumerate(found))
    assert sorted(tuple(x) for x in topk.top_k(df, df.where("vec_id % 50 = 0")).collect()) == want


def test_histograms_count_every_score(spark):
    """Not only the best: the counts of all bins are those of all rows."""
    r = np.random.default_rng(3)
    data = r.integers(-400, 400, (500, 3))
    df = spark.createDataFrame([(i, [float(x) / 256 for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<double>").repartition(4)
    queries = topk.Queries(np.array([0, 1000]), data[[0, 1]].astype(float), True)
    scores = data @ data[[0, 1]].T
    base, shift = np.array([-600_000, -600_000]), np.array([11, 11])
    want = Counter((q, int((scores[i, q] + 600_000) >> 11)) for q in (0, 1) for i in range(500) if not (q == 0 and i == 0))
    assert Counter({(x.q, x.bin): x.n for x in topk.histograms(df, queries, base, shift).collect()}) == want


def test_lines(documents, corpus, empty):
    place, want = {}, {}
    for d, t in sorted({(d, t) for d, t, *_ in corpus if d is not None and t}):
        for i, c in enumerate(lines.chunks_of(t.encode())):
            body = lines._body(c)
            if body is not None:
                place[body] = min(place.get(body, (d, i)), (d, i))
    for d, t in {(d, t) for d, t, *_ in corpus if d is not None and t}:
        want[d] = b"".join(c for i, c in enumerate(lines.chunks_of(t.encode())) if lines._body(c) is None or place[lines._body(c)] == (d, i)).decode()
    kept = lines.dedup_lines(documents)
    assert kept.columns == documents.columns
    for r in kept.collect():
        if r["doc_id"] is not None and r["text"] is not None and r["doc_id"] in want:
            assert r["text"] == want[r["doc_id"]] and r["n_chars"] == len(r["text"])
    assert kept.count() == len(corpus) and any(want[d] != t for d, t, *_ in corpus if d in want)
    assert lines.dedup_lines(empty).count() == 0
    assert all(b"".join(lines.chunks_of(t)) == t for t in (b"", b"\n", b"a\n\nb", b"\n\n\n", b"x" * 9 + b"\n"))


def test_packing(documents, corpus, empty):
    encoder = packing.Encoder()
    want = Counter()
    for d, t, *_ in corpus:
        ids = encoder.model.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or min(1024, len(ids))
        at = [0, *range(first, len(ids) + 1, 1024)]
        for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            want[d, i, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes())] += 1
    rows = packing.pack(documents).collect()
    assert Counter(tuple(r[:5]) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-sum(r.length for r in rows) // 1024) + 2
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("largest", [12, 40, 60])
def test_exchanges_reach_a_local_optimum(largest):
    """Every exchange raises the sum of squared fills; in the end no move or exchange of up to two for one would."""
    from itertools import combinations

    squares = lambda bins, sizes: sum(sum(sizes[i] for i in b) ** 2 for b in bins)
    r, fewer = random.Random(largest), 0
    for _ in range(30):
        sizes = [r.randint(1, largest) for _ in range(40)]
        start = [[i] for i in range(40)] if r.random() < 0.5 else packing.best_fit(sizes, 100)
        a, b = packing.Bin(start[0], sizes), packing.Bin(start[1], sizes)
        before = a.fill**2 + b.fill**2
        if packing.exchange(a, b, 100):
            assert a.fill**2 + b.fill**2 > before and b.fill <= 100 and sorted(a.items() + b.items()) == sorted(start[0] + start[1])
            assert a.fill == sum(sizes[i] for i in a.items()) and b.fill == sum(sizes[i] for i in b.items())
        end = packing.improve(start, sizes, 100)
        assert sorted(i for b in end for i in b) == list(range(40)) and squares(end, sizes) >= squares(start, sizes)
        fewer += len(end) < len(start)
        for a in end:
            for b in end:
                fa, fb = (sum(sizes[i] for i in y) for y in (a, b))
                if a is b or max(fa, fb) == 100:
                    continue
                gives, takes = [[c for n in (0, 1, 2) for c in combinations(y, n)] for y in (a, b)]
                for g in gives:
                    for k in takes:
                        d = sum(sizes[i] for i in g) - sum(sizes[i] for i in k)
                        allowed = len(g) == 1 or (len(g), len(k)) == (2, 1)
                        assert not allowed or d <= 0 or fb + d > 100 or fb + d <= fa
    assert fewer


def test_packing_of_many_groups(spark):
    """Repeated rows over many small groups: every piece placed once, gapless, close to the bound."""
    r = random.Random(9)
    rows = [(i % 90, "word " * r.randint(0, 300), 1) for i in range(600)]
    rows += [rows[0]] * 40 + [(None, None, 1)] * 3
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, copy int"), size=64).collect()
    sequences = {}
    for x in found:
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for own in sequences.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 1024
    assert len(found) == len(rows) and len(sequences) <= 1.03 * sum(x.length for x in found) / 1024 + 1


def test_encoder_on_a_whole_table():
    """Ids are those of the tokenizers library on every document of a test table."""
    pq = pytest.importorskip("pyarrow.parquet")
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test table")
    texts = [t or "" for t in pq.read_table(path, columns=["text"])["text"].to_pylist()]
    encoder = packing.Encoder()
    assert encoder.encode(texts) == encoder._raw(texts)


def test_encoder_on_odd_texts():
    encoder, r = packing.Encoder(), random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "é", "12", "!", " ", "　", "<|endoftext|>", " x", "\r\n", "日本", "\x00", "\x85"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert encoder.encode([text]) == encoder._raw([text])


def test_mixing(documents, corpus, empty):
    def draw(rate, u):
        k, p = 0, np.exp(-rate)
        c = p
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        return k

    sizes = Counter()
    for _, t, _, s, *_ in corpus:
        sizes[s] += len(t or "")
    raw = {s: v**0.5 for s, v in sizes.items()}
    want = Counter()
    for d, t, _, s, *_ in corpus:
        rate = raw[s] / sum(raw.values()) * sum(sizes.values()) / sizes[s] if sizes[s] else 1.0
        key = f"17:{'' if d is None else d}:{hashlib.md5((t or '').encode()).hexdigest()}:1"
        want[d, t] += draw(rate, int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52)
    got = Counter((r["doc"]["doc_id"], r["doc"]["text"]) for r in mixing.mix_sources(documents).collect())
    assert got == +want and mixing.mix_sources(empty).count() == 0


def test_inversion_takes_the_least_number(spark):
    """At and beside the distribution function's values, and where rounding leaves its end below u."""
    table = [0.25, 0.5, 0.75, 0.9]
    rows = [(u, min(3, sum(c <= u for c in table))) for u in (0.0, 0.2499, 0.25, 0.5, 0.74, 0.75, 0.9, 0.99)]
    got = spark.createDataFrame(rows, "u double, want int").select("want", mixing.invert(F.array(*[F.lit(c) for c in table]), F.col("u")).alias("k")).collect()
    assert all(x.k == x.want for x in got)


def test_large_poisson_rates(spark):
    rows = spark.range(4000).select(mixing.invert(mixing.distribution(F.lit(200.0)), mixing.uniform(F.col("id"))).alias("k"))
    r = rows.agg(F.avg("k").alias("m"), F.variance("k").alias("v")).first()
    assert abs(r.m - 200) < 1.5 and abs(r.v - 200) < 25


@pytest.mark.parametrize("tile", [4, 2048])
def test_simhash(documents, corpus, empty, tile, monkeypatch):
    monkeypatch.setattr(simhash.near_links, "__defaults__", (tile,))
    prints = {}
    for d, t, *_ in corpus:
        if d is None:
            continue
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[d] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    rows = simhash.near_duplicates(documents).collect()
    got = {r.doc_id: (bytes(r.fp).hex(), r.component_id) for r in rows if r.doc_id is not None}
    assert got == {d: (f"{prints[d]:016x}", find(d)) for d in prints}
    assert Counter(r.doc_id for r in rows) == Counter(d for d, *_ in corpus) and {r.component_id for r in rows if r.doc_id is None} == {None}
    assert simhash.near_duplicates(empty).count() == 0


def test_nodes_are_the_fingerprints_own_bits(spark):
    prints = [bytes(8), b"\x7f" + b"\xff" * 7, b"\x80" + bytes(7), b"\xff" * 8, bytes(range(8))]
    df = spark.createDataFrame([(p,) for p in prints], "fp binary")
    assert [r.n for r in df.select(simhash.node_of(1).alias("n")).collect()] == [int.from_bytes(p, "big", signed=True) for p in prints]


def test_pigeonhole_masks_meet():
    masks, r = [int.from_bytes(m, "big") for m in simhash.block_masks(64, 5, 2)], random.Random(1)
    for _ in range(500):
        flips = sum(1 << b for b in r.sample(range(64), 3))
        assert any(not flips & m for m in masks)


def test_near_documents_keep_one(documents, corpus):
    kept = simhash.drop_near_duplicates(documents)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    base = min(d for d, t, *_ in corpus if d is not None and t and len(words(t)) == 300)
    group = {d for d, t, *_ in corpus if d is not None and t and len(words(t)) in (300, 305, 306) and t != t.upper()}
    assert base in ids and len(group & set(ids)) == 1 and kept.columns == documents.columns


def test_pipeline_drops_what_fingerprints_link(spark, documents, empty):
    """The stage keeps the rows that are their group's smallest doc_id, by op6's groups; another text under a dropped id stays."""
    import corpus_pipeline

    again = documents.unionByName(spark.createDataFrame([(900, "alpha beta gamma delta", "en", "s0", 22, 1, "clash", 7), (901, "alpha beta gamma delta", "en", "s0", 22, 1, "clash", 7), (901, "quite another text", "en", "s0", 18, 1, "clash", 7)], SCHEMA))
    found = simhash.near_duplicates(again).collect()
    want = Counter((r.doc_id, bytes(r.fp)) for r in found if r.doc_id is None or r.doc_id == r.component_id)
    kept = corpus_pipeline.dedup_near(spark, again, "")
    rows = kept.collect()
    assert Counter((r.doc_id, simhash.fingerprints_of([(r.text or "").encode()], 3)[0]) for r in rows) == want
    assert [r.text for r in rows if r.doc_id in (900, 901)].count("alpha beta gamma delta") == 1 and "quite another text" in {r.text for r in rows}
    assert kept.columns == again.columns and corpus_pipeline.dedup_near(spark, empty, "").count() == 0


def test_marginals_are_those_of_whole_documents(monkeypatch):
    """Documents over several rows of the grid against the sum over all labellings."""
    from itertools import product

    monkeypatch.setattr(toxicity, "ROW", 3)
    r = np.random.default_rng(7)
    texts = [b"a b c d e f g h", b"", b"a b c", b"a b c d", b"x", b"q r s t u v w x y"]
    tokens, moves = toxicity.Tokens(texts, Rolling(31)), np.array([[0.2, -0.5], [0.1, 0.7]])
    x = r.normal(size=len(tokens.words)).astype(np.float32)
    monkeypatch.setattr(toxicity.Model, "emissions", lambda self, t: x)
    got = toxicity.marginals(toxicity.Model(np.zeros(1), moves=moves), tokens)
    for d in range(len(texts)):
        own = x[tokens.words.first[d] : tokens.words.first[d + 1]].astype(float)
        p, total = np.zeros(len(own)), 0.0
        for y in product((0, 1), repeat=len(own)):
            v = np.exp(own @ np.array(y, float) + sum(moves[y[i], y[i + 1]] for i in range(len(own) - 1)))
            total += v
            p += v * np.array(y)
        assert np.allclose(got[tokens.words.first[d] : tokens.words.first[d + 1]], p / total)


def test_long_chains_keep_odds_finite():
    text = b"word " * 50_000
    p = toxicity.marginals(toxicity.Model(np.zeros(1 << 20, np.float32), bias=-9.0, moves=np.array([[1.0, -1.0], [-1.0, 1.0]])), toxicity.Tokens([text], Rolling(31)))
    assert np.isfinite(p).all() and p.max() < 0.5 and np.allclose(p[100:200], p[30_000:30_100])


def test_toxicity_on_tables(spark, tmp_path, empty):
    """The registered query and the stage's operator on nulls, empties, repeats, clashing columns and an empty table."""
    r = random.Random(14)
    plain = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(300)]
    rows, labels, toxic = [], [], {}
    for i in range(500):
        w = [r.choice(plain) for _ in range(r.randint(20, 150))]
        toxic[i] = i % 4 == 0
        if toxic[i]:
            for _ in range(5):
                w[r.randrange(len(w))] = "zug" + r.choice(["hal", "mor", "tik"])
        rows.append((i, " ".join(w), "clash", 1.5, 7))
        labels.append((i, None if i % 50 == 1 else int(toxic[i]), 3))
    rows += [(1000, None, "c", 0.0, 1), (1001, "", "c", 0.0, 1), (None, rows[0][1], "c", 0.0, 1), rows[4], rows[4]]
    labels += [(9999, 1, 3), (None, 1, 3), labels[8]]
    spark.createDataFrame(rows, "doc_id long, text string, spans string, score double, id int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int, id int").write.parquet(str(tmp_path / "labels.parquet"))
    got = toxicity.op7_toxicity(spark, str(tmp_path))
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(rows)
    scores = {}
    for x in got.collect():
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and x.predicted == (x.score >= 0.5) and 0 <= x.score <= 1
        scores.setdefault(x.doc_id, set()).add(x.score)
    assert all(len(s) == 1 for s in scores.values()) and scores[1000] == scores[1001] and scores[None] == scores[0]
    held = [d for d in toxic if zlib.crc32(str(d).encode()) % 5 == 0]
    assert np.mean([(min(scores[d]) >= 0.5) == toxic[d] for d in held]) > 0.95
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = toxicity.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    kept = toxicity.clean_documents(docs, model)
    bad = {d for d, s in scores.items() if min(s) >= 0.5}
    assert kept.columns == docs.columns and Counter(x.doc_id for x in kept.collect()) == Counter(x[0] for x in rows if x[0] not in bad) and len(bad) > 90
    assert toxicity.score_documents(empty, model).count() == 0 and toxicity.clean_documents(empty, model).count() == 0
    none = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {x.score for x in toxicity.score_documents(docs, none).collect()} == {0.5}
    # the sample is bounded in documents and in bytes
    assert toxicity.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")), sample=50, most=3000) is not None


def test_toxicity_held_out_accuracy(spark):
    """On labelled rows that the model never saw."""
    path = "/root/testdata/sf0.01"
    if not os.path.exists(path):
        pytest.skip("no test table")
    scored = toxicity.op7_toxicity(spark, path).where("held_out").join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").collect()
    assert len(scored) > 40 and np.mean([x.predicted == x.toxic for x in scored]) > 0.95


def test_toxicity_learns_and_marks_spans():
    r = random.Random(4)
    plain = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(300)]
    bad = ["zug" + r.choice(["hal", "mor", "tik", "lop"]) for _ in range(8)]
    texts, label = [], []
    for i in range(600):
        w = [r.choice(plain) for _ in range(r.randint(20, 80))]
        if i % 4 == 0:
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(bad)
        texts.append(" ".join(w))
        label.append(int(i % 4 == 0))
    model = toxicity.fit([t.encode() for t in texts[:400]], np.array(label[:400]))
    score, spans = toxicity.score_texts([t.encode() for t in texts[400:]] + [b"", b" "], model, Rolling(31))
    y = np.array(label[400:] + [0, 0])
    assert ((score >= 0.5) == y).mean() > 0.97
    found = [texts[400 + i][s["begin"] : s["stop"]] for i, own in enumerate(spans) for s in own]
    assert found and sum("zug" in f for f in found) / len(found) > 0.9
    assert (toxicity.score_texts([b"x"], toxicity.fit([], np.zeros(0, int)), Rolling(31))[0] == 0.5).all()


def test_held_out_matches_crc(spark):
    got = spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", toxicity.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_audio_round_trip(documents, corpus):
    rows = audio.audio_column(documents).collect()
    want = Counter(((t or "").encode()).ljust(max(192, -(-len((t or "").encode()) // 192) * 192)) for _, t, *_ in corpus)
    assert Counter(audio.from_wav(bytes(r.media))[1] for r in rows) == want
    for r in rows:
        assert all(len(s.mel) == audio.SLOTS * audio.BANDS and 0 <= s.begin_ms < s.end_ms for s in r.segments)


@pytest.mark.parametrize("rate", [(1, 2), (3, 4), (2, 3), (5, 4)])
def test_polyphase_equals_filtering(rate):
    up, down = rate
    h, x = audio.low_pass(up, down), np.random.default_rng(0).normal(size=301).astype(np.float32)
    full = np.zeros(len(x) * up)
    full[::up] = x
    assert np.allclose(np.convolve(full, h)[len(h) // 2 :][: len(x) * up : down], audio.resample(x, up, down, h), atol=1e-4)


def test_tensors():
    kind = audio.as_tensors(pa.array([[float(i) for i in range(128)]] * 2, pa.list_(pa.float32())))
    assert kind.to_numpy_ndarray().shape == (2, audio.SLOTS, audio.BANDS)


def test_pages(spark):
    side = "<div class='x'><p>Same on every page</p><ul><li>One</li></ul></div>"
    rows = [(i, f"http://h.example/{i}", f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a>Menu</a></nav>{side}<div><p>Text {chr(97 + i)} &amp; &eacute;<br>more<p>Second <b>bold</b> part {chr(97 + i)}</div><form>Send</form><div class='comments'><p>Nice</p></div><script>var x='<p>'</script></body></html>") for i in range(8)]
    rows += [(8, None, None), (9, "http://o.example/", ""), (10, "http://o.example/a", "<nav>M</nav><article><header><h1>Head</h1></header><p>A\n  b<p>C</article><footer>F"), (10, "http://o.example/a", "plain &lt; text")]
    # adverts of any words inside an article go where their shape recurs; the same class on one page alone deletes nothing
    rows += [(20 + i, f"https://ads.example/{i}", f"<article><p>Story {'x' * i}</p><div class='promo box'><b>Buy {'y' * i}</b></div><p>End</p></article>") for i in range(6)]
    rows += [(30, "http://one.example/", "<article><h1>T</h1><div class='related-work'><p>Body one</p></div><p class='social'>Body two</p><p>Body three</p></article>"), (31, "http://one.example/", "<main><div id='alert-system'><p>Kept</p></div></main>")]
    rows += [(32, "http://one.example/", "<article><p>Body</p></article><article class='comment'><p>Nice post!</p></article>"), (33, "http://one.example/", "<article><p>Body</p><p style='display: none'>no</p><aside>no</aside></article>")]
    schema = "page_id long, url string, html string, host string, part int, pages long"
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], schema)
    got = Counter((r.page_id, r.text) for r in pages.extract_pages(df).collect())
    want = Counter({(i, f"Text {chr(97 + i)} & é more\nSecond bold part {chr(97 + i)}"): 1 for i in range(8)})
    want += Counter({(8, ""): 1, (9, ""): 1, (10, "Head\nA b\nC"): 1, (10, "plain < text"): 1})
    want += Counter({(20 + i, f"Story {'x' * i}".strip() + "\nEnd"): 1 for i in range(6)})
    want += Counter({(30, "T\nBody one\nBody two\nBody three"): 1, (31, "Kept"): 1, (32, "Body"): 1, (33, "Body"): 1})
    assert got == want
    assert pages.extract_pages(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "http://l.example/", "<p>" + "word " * 400_000 + "</p>" + "<div>" * 3000 + "deep")], "page_id long, url string, html string")
    assert len(pages.extract_pages(long).first()["text"]) == 5 * 400_000 + 4


@pytest.mark.parametrize("size", [4, 5, 40])
def test_template_decides(spark, size):
    """Texts that are known without any parser, on hosts of pages enough and of one page less; without its template a host's texts are others."""
    r = random.Random(size)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows, want = [], {}
    for i in range(size):
        body = [" ".join(word() for _ in range(40)) for _ in range(3)]
        wrap = ["<article><h2>{}</h2><p>{}</p><p>{}</p></article>", "<main><p>{}</p><div>{}<p>{}</div></main>", "<div class=text><p>{}</p><p>{}</p>{}</div>"][i % 3]
        menu = "<div class='top'><ul>" + "".join(f"<li><a href='{word()}'>{x}</a></li>" for x in ("Home", "News", "About us")) + "</ul></div>"
        advert = f"<div class='advert wide'><b>{word()} {word()}</b></div>"
        below = f"<section>All rights of texts are with {7 * i} people<p>Write to us</p></section>"
        rows.append((i, f"http://site.example/{i}", f"<body>{menu}{advert}{wrap.format(*body)}{below}</body>"))
        want[i] = "\n".join(body)
    got = {x.page_id: (x.text, x.n_template) for x in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    parsed = {i: pages.Page(h) for i, _, h in rows}
    if size >= pages.CONTENT_PAGES:
        assert {i: t for i, (t, _) in got.items()} == want and all(n == 3 for _, n in got.values())
        assert all(p.main_text(set(), set(), True)[0] != want[i] for i, p in parsed.items())
    else:  # too few pages to count contents: articles are chosen, and elsewhere what no class names stays
        for i in got:
            menu_and_below = "" if i % 3 < 2 else "Home"
            assert want[i] in got[i][0] and (menu_and_below in got[i][0]) and (got[i][0] == want[i]) == (i % 3 < 2)


def test_guesses_take_less_than_they_leave():
    text = lambda h: pages.Page(h).main_text(set(), set(), False)[0]
    assert text("<body><article><h2>Teaser</h2></article><div><p>The long main story here.</p></div></body>") == "Teaser\nThe long main story here."
    assert text('<div id="main-banner-story"><p>Only text of page</p></div>') == "Only text of page"
    assert text("<article>The long main story here.</article><div>Teaser</div>") == "The long main story here."
    assert text("<div class=promo>Buy</div><p>A story of some words</p>") == "A story of some words"
    assert text("<nav>Menu</nav><p>x</p><footer>of the site</footer>") == "x"


@pytest.mark.parametrize("lot", [5_000, 3])
def test_templates_against_plain_counts(spark, tmp_path, lot, monkeypatch):
    """The registered query against counts of every subtree in plain Python; small parts deal a host over several."""
    monkeypatch.setattr(pages, "LOT", lot)
    r = random.Random(12)
    rows = []
    for i in range(120):
        host = r.choice(["a.example", "a.example", "B.example", "c.example", f"few{i}.example"])
        menu = "".join(f"<li><a href='/{r.random()}'>{r.choice('pqrs')}</a></li>" for _ in range(r.randint(2, 5)))
        body = "".join(f"<p>{r.random()} {' '.join(r.choice('abcdefgh') * 3 for _ in range(9))}</p>" for _ in range(3))
        notice = f"<div class='cookie-{i}'>We use {host} {r.randint(0, 9)}</div>" if r.random() < 0.5 else ""
        wrap = r.choice(["<article>{}</article>", "<div>{}</div>"]).format(body + notice)
        rows.append((i, f"http://{host}/{i}", f"<body><div class=menu><ul>{menu}</ul></div><div>Visit {host} today</div>{wrap}<div>Unique {r.choice('ab') * 9}</div></body>"))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    parsed = [(url.split("/")[2].lower(), pages.Page(h)) for _, url, h in rows]
    sizes, content, shape, common = Counter(h for h, _ in parsed), Counter(), Counter(), Counter()
    for h, p in parsed:
        content.update({(h, c) for _, c, _ in p.subtrees()} - {(h, 0)})
        shape.update({(h, s) for _, _, s in p.subtrees()} - {(h, 0)})
        common.update({s for _, _, s in p.subtrees()} - {0})
    want = {}
    for (h, p), (i, url, _) in zip(parsed, rows, strict=True):
        contents = {c for (x, c), n in content.items() if x == h and n >= max(5, 0.2 * sizes[h])}
        shapes = {s for (x, s), n in shape.items() if x == h and n >= max(3, 0.01 * sizes[h])} | {s for s, n in common.items() if n >= 5 and sizes[h] < 5}
        text, took = p.main_text(contents, shapes, sizes[h] >= 5)
        want[i] = (i, url, text, len(text), took)
    got = pages.op9_html_extraction(spark, str(tmp_path))
    assert got.columns == ["page_id", "url", "text", "n_chars", "n_template"]
    assert {x.page_id: tuple(x) for x in got.collect()} == want and sum(x[4] > 0 for x in want.values()) == 120


def test_secrets(documents, corpus):
    net = secrets.trained()
    texts = ['é token = "abcdef"', "password: abc", "API_KEY=" + "x" * 6, "AKIA" + "A1" * 8, "AKIA" + "A" * 15, "f" * 24, "f" * 23 + " " + "0a" * 12, "", "ſecret=abcdefgh", "passwd = 'tok.en-1' token:12345"]
    base = [re.compile(r"((?a:(?i:password|passwd|secret|token|api_?key)))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]
    for text, found in zip(texts, secrets.scan([t.encode() for t in texts], net), strict=True):
        want = [(m.start(), 0, m.end()) for m in base[0].finditer(text) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in base[1].finditer(text) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in base[2].finditer(text) if len(m[0]) >= 24]
        assert sorted(want) == [f for f in found if f[1] != 3]
    sample, label = secrets.labelled_findings(1000, 77)
    p = net.scores(*secrets.encode(*[[x[i] for x in sample] for i in range(3)]))
    assert (p[label == 1] >= net.threshold).mean() > 0.97 and (p[label == 0] >= net.threshold).mean() < 0.01
    assert secrets.find_secrets(documents).count() == len(corpus)


def test_every_character_of_a_candidate_is_seen():
    for n in (1, 44, 45, 66, 67, 500):
        spans = secrets.windows(7, 7 + n)
        assert spans[0][0] == 7 and spans[-1][1] == 7 + n and all(y - x <= secrets.INNER for x, y in spans)
        assert all(b[0] < a[1] for a, b in zip(spans[:-1], spans[1:], strict=True))
    net = secrets.trained()
    key = "q8Zr2LmX0vT7bNcY5kHs9WdF3gJp6RtA"
    for text, low in (("see " + "folder/" * 30 + key + "/name" * 30, 214), ("tok.en é " + key, 9), ("token=abcdef." + "path/" * 12 + " x", None), ("VERSCHIEDENHEITEN und Überzeugungskraft 2024-01-15 http-error-codes", None)):
        found = [f for f in secrets.scan([text.encode()], net)[0] if f[1] == 3]
        assert all(f[0] <= low and f[2] >= low + len(key) for f in found) if low else not found
        assert len(found) == (low is not None)
    # what a base finding leaves of a run is a candidate of its own
    both = "AKIA" + "A1" * 8 + "/x/" + key
    assert [f[1] for f in secrets.scan([both.encode()], net)[0]] == [1, 3]


def test_every_run_is_a_candidate(monkeypatch):
    """Held parts and early decisions change nothing: each run of any length is decided as by the whole network."""
    net = secrets.trained()
    r = random.Random(4)
    chars = "abcXYZ0189+/_=-"
    texts = ["".join(r.choice(chars + " .é\n") if r.random() < 0.9 else "".join(r.choice(chars) for _ in range(r.randint(1, 40))) for _ in range(400)) for _ in range(20)] + ["a", "hunter2ab", "x" * 15, ""]
    monkeypatch.setattr(secrets, "KNOWN", 50)
    for text, found in zip(texts, secrets.scan([t.encode() for t in texts], net), strict=True):
        free = list(text)
        for s, kind, e in found:
            if kind < 3:
                free[s:e] = " " * (e - s)
        want = set()
        for m in re.finditer(r"[A-Za-z0-9+/_=-]+", "".join(free)):
            for b, e in secrets.windows(m.start(), m.end()):
                before, after = text[:b].encode(), text[e:].encode()
                if net.logits(*secrets.encode([before], [text[b:e].encode()], [after]))[0] >= net.cut:
                    want |= set(range(b, e))
        assert want == {i for s, kind, e in found if kind == 3 for i in range(s, e)}
    assert any(f[1] == 3 for f in secrets.scan([("see " + "q8Zr2LmX0vT7bNcY5kHs9WdF").encode()], net)[0])


def test_network_gradient():
    """Against differences of the loss."""
    net = secrets.Network(3)
    found, label = secrets.labelled_findings(40, 2)
    x, around = secrets.encode(*[[f[i] for f in found] for i in range(3)])
    for t in (net.own, net.around):
        t.p = {k: v.astype(np.float64) for k, v in t.p.items()}

    def loss():
        z = net.logits(x, around)
        return float(np.mean(np.logaddexp(0, z) - label * z))

    for t, g in zip((net.own, net.around), net._gradients(x, around, label), strict=True):
        for k in ("embed", "conv", "cb", "w1", "b1", "w2", "b2"):
            at = int(np.abs(g[k]).argmax())
            p = t.p[k].reshape(-1)
            held, step = p[at], 1e-3
            p[at] = held + step
            up = loss()
            p[at] = held - step
            down = loss()
            p[at] = held
            assert abs((up - down) / (2 * step) - g[k].ravel()[at]) < 0.02 * abs(g[k].ravel()[at]) + 1e-5, k


def test_secret_query_columns(spark, tmp_path):
    """Every column of the registered query, base findings by plain regular expressions."""
    texts = ['é token = "abcdef" ' + "f" * 24, "password: abc AKIA" + "Z9" * 10, None, "", "x " * 50_000 + "secret=" + "Ab1" * 9, "API_KEY=abcdef" * 3, "API_KEY=abcdef" * 3]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "passwd=hidden1", "c", 2), (5, texts[5], "clash", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, findings string, kind int").write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter()
    for d, t, *_ in rows:
        t = t or ""
        found = [(m.start(), 0, m.end()) for m in re.finditer(r"((?a:(?i:password|passwd|secret|token|api_?key)))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        line = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))
        want[(d, *[sum(f[1] == k for f in found) for k in range(3)], hashlib.sha256(line.encode()).hexdigest(), line)] += 1
    got = secrets.op10_secret_scan(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    base = lambda spans: ",".join(s for s in spans.split(",") if not s.startswith("network"))
    assert Counter((*r[:5], base(r.spans)) for r in got.collect()) == want
    assert secrets.find_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_and_hashes():
    w = Words([b" a\x0bbb ", b"", b"\xc2\xa0x  bb"])
    assert w.text == b"a bb \xc2\xa0x bb " and w.first.tolist() == [0, 2, 2, 4]
    h = Rolling(1).of(w.array, w.start, w.end)
    assert h[1] == h[3] and len(set(h.tolist())) == 3


def test_pipeline_returns_documents(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, "alpha beta gamma " * (i % 7 + 1) + str(i), "en", f"s{i % 2}", 10) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()


def test_similar_documents_are_exact(spark, monkeypatch):
    """Every pair at a Jaccard similarity of 0.8 or more is linked, no pair below; with small tiles and in larger groups too."""
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    texts, passage = [], [r.choice(vocabulary) for _ in range(80)]
    for _ in range(60):  # pairs around the threshold: one stretch of words differs
        base = [r.choice(vocabulary) for _ in range(r.choice([30, 105, 300]))]
        cut = r.randint(0, len(base) // 6)
        texts += [" ".join(base), " ".join(base[: len(base) - cut] + [r.choice(vocabulary) for _ in range(cut)])]
    texts += [" ".join(passage + [r.choice(vocabulary) for _ in range(r.randint(0, 40))]) for _ in range(60)] + ["", None, "one", "One", "one two"]
    sets = []
    for t in texts:
        w = words((t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3]), (None, texts[0])], "doc_id long, text string")
    for tile, sampled in ((2048, 5000), (8, 20)):
        monkeypatch.setattr(jaccard.across_components, "__defaults__", (tile,))
        monkeypatch.setattr(jaccard, "SAMPLED", sampled)
        got = {x.doc_id: x.component_id for x in jaccard.similar_documents(docs).collect()}
        assert got == {d: find(d) for d in range(len(texts))}
    kept = Counter(x.doc_id for x in simhash.drop_near_duplicates(docs).collect())
    assert set(kept) == {None} | {d for d in range(len(texts)) if find(d) == d}


def test_repeated_passages_go_whole(spark, documents, corpus, empty):
    """Passages of two to twelve lines go whole, wherever they stand; and all documents against a plain version."""
    r, rows, passages = random.Random(6), [], []
    for n in (2, 3, 5, 8, 12):
        for _ in range(10):
            new = lambda k: [" ".join(str(r.random()) for _ in range(6)) for _ in range(k)]
            passage = new(n)
            passages.append(passage)
            rows += [(len(rows), "\n".join(new(r.randint(1, 9)) + passage + new(r.randint(1, 9)))), (len(rows) + 1, "\n".join(new(r.randint(1, 9)) + passage + new(r.randint(1, 9))))]
    kept = {x.doc_id: x.text for x in lines.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for n, passage in enumerate(passages):
        assert kept[2 * n] == rows[2 * n][1] and kept[2 * n + 1].split("\n") == [x for x in rows[2 * n + 1][1].split("\n") if x not in passage]

    rows = [(0, "a\na\na"), (1, "x\ny\n\n\n\nz\nw"), (2, "v\nx\ny\n\n\n\nz\nw"), (3, "a\nq"), (4, "x\nu\ny"), (5, "k\nl\nk\nl\nk\nl\n"), (6, "m\n \n\t\nn"), (7, "o\n \n\t\np"), (8, None), (8, ""), (None, "x\ny")]
    kept = Counter((x.doc_id, x.text) for x in lines.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == Counter(rows) - Counter([rows[2], rows[5]]) + Counter([(2, "v\n"), (5, "k\nl\n")])

    place, texts = {}, sorted({(d, t) for d, t, *_ in corpus if d is not None and t})
    for d, t in texts:
        for i, body in enumerate(lines.pair_bodies(t.encode())):
            if body is not None:
                place.setdefault(body, (d, i))
    want = {}
    for d, t in texts:
        gone = {i for i, x in enumerate(lines.pair_bodies(t.encode())) if x is not None and (place[x][0] < d or place[x][1] < i - 1)}
        want[d] = lines.without_pairs(t.encode(), gone).decode()
    got = lines.dedup_passages(documents)
    assert got.columns == documents.columns and got.count() == len(corpus) and lines.dedup_passages(empty).count() == 0
    assert all(x["text"] == want[x["doc_id"]] and x["n_chars"] == len(x["text"]) for x in got.collect() if x["doc_id"] in want)


def test_repeated_lines_against_sql(spark, tmp_path):
    """Short texts of few lines, white ones among them: chunks, pairs and white lines meet in every order; repeated rows and other doc_ids' nulls."""
    r = random.Random(1)
    line = lambda: r.choice(["a", "b", "c", "", " ", "\t\x0b", "é", "d", "e f"])
    rows = [(i, None if r.random() < 0.05 else "\n".join(line() for _ in range(r.randint(0, 14))) + r.choice(["", "\n", "\n\n"])) for i in range(1200)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = Counter(tuple(x) for x in lines.op3_line_dedup(spark, str(tmp_path)).collect())
    assert got == Counter(con.execute(lines.ORACLE).fetchall())
    texts = {d: t.encode() for d, t in rows if t}
    for t in texts.values():
        pieces = list(lines.pieces_of(t, True))
        assert [b for *_, pair, b in pieces if pair] == [b for b in lines.pair_bodies(t) if b is not None]
        assert [b for *_, pair, b in pieces if not pair] == [b for c in lines.chunks_of(t) if (b := lines._body(c)) is not None]


def test_chunks_settle_long_passages(spark):
    """Of a passage of many lines only the pairs at its edges are left to be compared."""
    r = random.Random(3)
    new = lambda k: [str(r.random()) for _ in range(k)]
    passage = new(400)
    rows = [(d, "\n".join(new(5) + passage + new(5))) for d in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by_chunks = {x.doc_id: len(x.text.split("\n")) for x in lines.dedup_lines(df).collect()}
    assert by_chunks[0] == 410 and all(10 <= by_chunks[d] <= 40 for d in range(1, 20))
    assert all(len(x.text.split("\n")) == (410 if x.doc_id == 0 else 10) for x in lines.dedup_passages(df).collect())


def test_pivots_leave_few_pairs(spark, monkeypatch):
    """A group of near copies that its least node leaves in many parts: pivots link them, without all pairs, and the result is the same."""
    r = random.Random(11)
    base = [f"w{i}" for i in range(160)]
    rows = []
    for i in range(300):  # each copy changes a few words, so that two of them are mostly just above or below 0.8
        own = list(base)
        for at in r.sample(range(160), 4):
            own[at] = f"x{i}-{at}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen, across = [], jaccard.across_components
    monkeypatch.setattr(jaccard, "across_components", lambda *a: seen.append(across(*a)) or seen[-1])
    out = []
    for pivots in (3, 0):
        monkeypatch.setattr(jaccard, "PIVOTS", pivots)
        out.append({x.doc_id: x.component_id for x in jaccard.similar_documents(docs).collect()})
    sets = [set(s.tolist()) for s in jaccard.shingle_sets([t.encode() for _, t in rows])]
    least = list(range(300))
    find = lambda i: i if least[i] == i else find(least[i])
    for i in range(300):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                least[max(a, b)] = min(a, b)
    assert out[0] == out[1] == {i: find(i) for i in range(300)}
    assert seen[0].count() <= seen[1].count()


def test_bitmaps_never_exceed_the_difference():
    r = np.random.default_rng(9)
    for n in (5, 900, 1100, 2000, 2100, 9000):
        for share in (0.1, 0.8, 1.0):
            both, one, two = (np.unique(r.integers(0, 2**64, int(k), dtype=np.uint64)) for k in (n * share, n * (1 - share), 1.2 * n * (1 - share)))
            a, b = np.union1d(both, one), np.union1d(both, two)
            assert jaccard.differing(jaccard.wide(a), jaccard.wide(b)) <= len(np.setxor1d(a, b))
            if share < 0.5 and min(len(a), len(b)) > jaccard.BITS:
                assert jaccard.differing(jaccard.wide(a), jaccard.wide(b)) * 9 > len(a) + len(b)


def test_registered_queries(spark, corpus, tmp_path):
    """Each opN query on tables with nulls, empties, repeats and clashing columns: rows, columns, and SQL where there is some."""
    from locusweave import llm

    # an oracle of one row a doc_id needs distinct ids
    rows = {d: (d, t, lang, s, n, 1, "clash", 7) for d, t, lang, s, n, *_ in corpus if d is not None}
    spark.createDataFrame(list(rows.values()), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    r = np.random.default_rng(1)
    vectors = [(i, [float(v) for v in r.normal(size=6)], "clash") for i in range(120)] + [(150, None, "clash"), (151, [float("nan")] * 6, "clash")]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, score string").write.parquet(str(tmp_path / "embeddings.parquet"))
    items = [(i, t, "clash") for i, (_, t, *_) in enumerate(list(rows.values())[::6])] + [(90, None, "clash"), (91, "", "clash"), (92, "no such term zzzz", "clash")]
    spark.createDataFrame(items, "item_id long, text string, score string").write.parquet(str(tmp_path / "benchmark.parquet"))
    db = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for name, sql in llm.oracle_sql().items():
        got = llm.queries()[name](spark, str(tmp_path))
        cursor = db.execute(sql)
        order = [c[0] for c in cursor.description]
        assert sorted(order) == sorted(got.columns)
        assert Counter(tuple(x) for x in got.select(*order).collect()) == Counter(cursor.fetchall())
    kept = lines.dedup_passages(spark.read.parquet(str(tmp_path / "documents.parquet")))
    kept = {x.doc_id: x.text or "" for x in kept.collect()}
    got = {x.doc_id: tuple(x) for x in lines.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {d: (d, len(t or ""), len(t or "") - len(kept[d]), hashlib.sha256(kept[d].encode()).hexdigest()) for d, (_, t, *_) in rows.items()}


def test_media_digests(spark, corpus, tmp_path, empty):
    """Every column of the registered query but the features, which equal texts share."""
    spark.createDataFrame(corpus, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got, want, seen = audio.op8_media_columns(spark, str(tmp_path)), Counter(), {}
    assert got.columns == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for d, t, *_ in corpus:
        raw = (t or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        media = audio.to_wav(payload)
        want[d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest()] += 1
    rows = got.collect()
    assert Counter(tuple(x)[:7] for x in rows) == want
    for x in rows:
        assert seen.setdefault(x.payload_sha256, x.feature) == x.feature and x.feature.startswith("frames=")
    assert len(set(seen.values())) > 10 and audio.audio_column(empty).count() == 0


def test_stages_on_odd_rows(spark, corpus, tmp_path):
    """Nulls, empties, long texts, ties and repeats through every stage; toxic documents go, clean ones stay; an empty table."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(21)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    plain = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(400)]
    rows, labels = [], []
    for i in range(200):
        w = [r.choice(plain) for _ in range(60)]
        if i % 4 == 0:
            w[::9] = ["zug" + r.choice(["hal", "mor"]) for _ in w[::9]]
        rows.append((1000 + i, " ".join(w), "en", f"s{i % 3}", 1))
        labels.append((1000 + i, 1, int(i % 4 == 0)))
    odd = [x[:5] for x in corpus]
    spark.createDataFrame(rows + odd, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    clean = stages["toxicity"](spark, docs, str(tmp_path))
    assert Counter(x.doc_id for x in clean.collect()) == Counter(d for d, *_ in rows + odd if d is None or d < 1000 or (d - 1000) % 4)
    assert clean.columns == docs.columns
    seen = stages["line_dedup"](spark, clean, str(tmp_path))
    assert seen.count() == clean.count() and seen.columns == docs.columns
    near = stages["near_dedup"](spark, seen, str(tmp_path))
    texts = Counter(x.text for x in near.where("doc_id is not null").collect() if x.text and len(x.text.split()) > 20)
    assert near.columns == docs.columns and {d for d, *_ in rows if (d - 1000) % 4} <= {x.doc_id for x in near.collect()} and len(texts) > 150
    mixed = stages["mixing"](spark, near, str(tmp_path))
    assert mixed.columns == docs.columns
    assert {tuple(x) for x in mixed.collect()} <= {tuple(x) for x in near.collect()}
    found = corpus_pipeline.run(spark, str(tmp_path))
    placed = stages["packing"](spark, mixed, str(tmp_path))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(tuple(x) for x in found.select(*key).collect()) == Counter(tuple(x) for x in placed.select(*key).collect())
    none = spark.createDataFrame([], schema)
    for name in stages:
        assert stages[name](spark, none, str(tmp_path)).count() == 0
