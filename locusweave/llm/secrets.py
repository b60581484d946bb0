"""Secret scans: rules for well-known forms, and a character convolutional network over every other candidate.

Base findings are regular expressions. Of what they leave, every maximal run of ``[A-Za-z0-9+/_=-]``, of any length, is a candidate.
The network has two parts: one reads a candidate, in overlapping windows of INNER characters where it is longer, so all of it is
seen, the other the AROUND characters on both sides. The second can move the sum by SWAY at most, so a window whose own part stays
more than that below the threshold is decided without its surroundings, and the own part of a frequent word is held by the task;
both only save work. Windows whose sum passes the threshold are findings, neighbours as one. The threshold is the highest that
keeps a recall of RECALL on held-out findings.

The network is trained in numpy on labelled findings: credentials of common shapes, alone and inside paths, assignments and
addresses, and what resembles them (words of several languages in any case and of any length, numbers, identifiers, paths, dates
...), drawn from a seed, so training needs no corpus and is the same everywhere.

Null texts are empty. Null ids and repeated rows are kept, each as it is. Texts of any length are read whole, in lots of bounded
size; one of more than a lot is a lot of its own. Findings of one start come in order of kind; those of different kinds may overlap, but
for the network's. Extra columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import runs, slices, table, texts_of, to_batch

_WORD = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"({_WORD})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)".encode())
ACCESS, HEX = re.compile(rb"AKIA[A-Z0-9]+"), re.compile(rb"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "network")

AROUND, INNER, SWAY, RECALL = 12, 44, 4.0, 0.99
#: Windows whose own part a task holds.
KNOWN = 1 << 18

_CHARS = np.zeros(256, bool)
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-":
    _CHARS[_c] = True

#: Symbols of the network: each printable ASCII character, one for line feeds, one for other control characters, one for bytes
#: of other scripts, and nothing (0).
_SYMBOL = np.full(256, 98, np.int64)
_SYMBOL[:32] = 97
_SYMBOL[32:127] = np.arange(1, 96)
_SYMBOL[10] = 96


def symbols_of(pieces: list[bytes], size: int) -> np.ndarray:
    """Symbols (pieces, size), 0 behind a piece's end."""
    grid = np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8).reshape(-1, size)
    return np.where(grid == 0, 0, _SYMBOL[grid])


def surroundings(before: list[bytes], after: list[bytes]) -> np.ndarray:
    """Symbols of AROUND characters on each side, those behind with numbers of their own and a gap that no filter spans."""
    left = symbols_of([b[-AROUND:].rjust(AROUND, b"\0") for b in before], AROUND)
    right = symbols_of([a[:AROUND] for a in after], AROUND)
    return np.concatenate((left, np.zeros((len(left), Tower.WIDTH - 1), np.int64), np.where(right > 0, right + 98, 0)), axis=1)


def encode(before: list[bytes], inner: list[bytes], after: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of windows and of their surroundings; no window is longer than INNER."""
    return symbols_of(inner, INNER), surroundings(before, after)


def windows(begin: int, end: int) -> list[tuple[int, int]]:
    """Stretches of at most INNER characters that cover a candidate, each by half over the next."""
    if end - begin <= INNER:
        return [(begin, end)]
    return [(i, i + INNER) for i in [*range(begin, end - INNER, INNER // 2), end - INNER]]


class Tower:
    """Embedding, one convolution, maxima and means over places with a symbol, one hidden layer, one number."""

    WIDTH, EMBED, FILTERS, HIDDEN = 5, 8, 24, 24

    def __init__(self, symbols: int, r: np.random.Generator):
        f, e, w, h = self.FILTERS, self.EMBED, self.WIDTH, self.HIDDEN
        self.p = {
            "embed": r.normal(0, 0.5, (symbols, e)), "conv": r.normal(0, (w * e) ** -0.5, (w * e, f)), "cb": np.zeros(f),
            "w1": r.normal(0, (2 * f) ** -0.5, (2 * f, h)), "b1": np.zeros(h), "w2": r.normal(0, h**-0.5, h), "b2": np.zeros(1),
        }
        # characters of a kind begin alike: lower case, upper case, digits, all else
        kind = np.array([0 if chr(c).islower() else 1 if chr(c).isupper() else 2 if chr(c).isdigit() else 3 for c in range(32, 127)])
        for low in range(1, symbols - 97, 98):
            self.p["embed"][low : low + 95, :4] = np.eye(4)[kind] + 0.1 * self.p["embed"][low : low + 95, :4]
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def forward(self, symbols: np.ndarray):
        p, w = self.p, self.WIDTH
        n, size = symbols.shape
        live = (symbols > 0)[:, :, None]
        x = np.zeros((n, size + w - 1, self.EMBED), np.float32)
        x[:, w // 2 : w // 2 + size] = p["embed"][symbols] * live
        cols = np.lib.stride_tricks.sliding_window_view(x, w, axis=1).transpose(0, 1, 3, 2).reshape(n * size, w * self.EMBED)
        a = np.maximum((cols @ p["conv"] + p["cb"]).reshape(n, size, -1), 0) * live
        count = np.maximum(1, live.sum(1))
        top = a.argmax(1)
        pooled = np.concatenate((np.take_along_axis(a, top[:, None], 1)[:, 0], a.sum(1) / count), 1)
        hid = np.maximum(pooled @ p["w1"] + p["b1"], 0)
        return hid @ p["w2"] + p["b2"][0], (symbols, cols, a, count, top, pooled, hid)

    def gradient(self, held, d: np.ndarray) -> dict[str, np.ndarray]:
        """Of a loss that changes by ``d`` with each row's number; ``held`` is what forward gave besides."""
        symbols, cols, a, count, top, pooled, hid = held
        p, w, e, f = self.p, self.WIDTH, self.EMBED, self.FILTERS
        n, size = symbols.shape
        g = {"w2": hid.T @ d, "b2": d.sum(keepdims=True)}
        dh = d[:, None] * p["w2"] * (hid > 0)
        g["w1"], g["b1"] = pooled.T @ dh, dh.sum(0)
        dp = dh @ p["w1"].T
        da = np.repeat((dp[:, f:] / count)[:, None], size, axis=1)
        np.put_along_axis(da, top[:, None], np.take_along_axis(da, top[:, None], 1) + dp[:, None, :f], 1)
        dz = (da * (a > 0)).reshape(n * size, f)
        g["conv"], g["cb"] = cols.T @ dz, dz.sum(0)
        dx = (dz @ p["conv"].T).reshape(n, size, w, e)
        padded = np.zeros((n, size + w - 1, e), np.float32)
        for k in range(w):
            padded[:, k : k + size] += dx[:, :, k]
        live = (padded[:, w // 2 : w // 2 + size] * (symbols > 0)[:, :, None]).reshape(-1, e)
        g["embed"] = np.stack([np.bincount(symbols.ravel(), weights=live[:, k], minlength=len(p["embed"])) for k in range(e)], axis=1).astype(np.float32)
        return g


class Network:
    """A tower over the window, and one over its surroundings that moves the sum by SWAY at most."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.own, self.around = Tower(99, r), Tower(197, r)
        self.scale, self.shift, self.threshold, self.cut = 1.0, 0.0, 0.5, 0.0
        self.known: dict[bytes, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def sway(self, around: np.ndarray) -> np.ndarray:
        return SWAY * np.concatenate([np.tanh(self.around.forward(around[i : i + 512])[0]) for i in range(0, len(around), 512)]) if len(around) else np.zeros(0)

    def logits(self, symbols: np.ndarray, around: np.ndarray) -> np.ndarray:
        own = [self.own.forward(symbols[i : i + 512])[0] for i in range(0, len(symbols), 512)]
        return np.concatenate(own) + self.sway(around) if own else np.zeros(0)

    def scores(self, symbols: np.ndarray, around: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return 1 / (1 + np.exp(-np.clip(self.logits(symbols, around) * self.scale + self.shift, -30, 30)))

    def alone(self, pieces: list[bytes]) -> np.ndarray:
        """The windows' own part of the sum."""
        rest = sorted(set(pieces).difference(self.known), key=lambda p: (len(p), p))
        if len(self.known) + len(rest) > KNOWN:
            self.known.clear()
            rest = sorted(set(pieces), key=lambda p: (len(p), p))
        for low in range(0, len(rest), 512):
            lot = rest[low : low + 512]
            self.known.update(zip(lot, self.own.forward(symbols_of(lot, len(lot[-1])))[0].tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, pieces), float, len(pieces))

    def train(self, symbols: np.ndarray, around: np.ndarray, label: np.ndarray, epochs: int = 8, batch: int = 192, seed: int = 6) -> None:
        r = np.random.default_rng(seed)
        towers = (self.own, self.around)
        m, v = ([{k: np.zeros_like(x) for k, x in t.p.items()} for t in towers] for _ in range(2))
        t = 0
        for epoch in range(epochs):
            order = r.permutation(len(label))
            rate = 0.005 * (1 - epoch / epochs)
            for low in range(0, len(order), batch):
                at = order[low : low + batch]
                t += 1
                for i, g in enumerate(self._gradients(symbols[at], around[at], label[at])):
                    for k in g:
                        m[i][k] = 0.9 * m[i][k] + 0.1 * g[k]
                        v[i][k] = 0.99 * v[i][k] + 0.01 * g[k] ** 2
                        towers[i].p[k] = (towers[i].p[k] - rate * (m[i][k] / (1 - 0.9**t)) / (np.sqrt(v[i][k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)

    def _gradients(self, symbols: np.ndarray, around: np.ndarray, label: np.ndarray) -> list[dict[str, np.ndarray]]:
        one, held1 = self.own.forward(symbols)
        two, held2 = self.around.forward(around)
        moved = np.tanh(two)
        d = ((1 / (1 + np.exp(-np.clip(one + SWAY * moved, -30, 30))) - label) / len(label)).astype(np.float32)
        return [self.own.gradient(held1, d), self.around.gradient(held2, d * SWAY * (1 - moved**2))]


def labelled_findings(count: int, seed: int) -> tuple[list[tuple[bytes, bytes, bytes]], np.ndarray]:
    """(before, window, after) and whether it holds a credential: random ones of common shapes, and look-alikes."""
    r = np.random.default_rng(seed)
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    parts = "an the ing tion re ent ou is men ver ich de la que on ti er st ra lo ka mi su to be ge sch ein heit keit ung eau oi ai os ar ción do pre com str".replace("ó", "o").split()
    accents = "äöüßéèêçñóíáà"

    def pick(chars: str, n: int) -> str:
        return "".join(chars[i] for i in r.integers(0, len(chars), n))

    def word(least: int = 2, most: int = 5) -> str:
        return "".join(parts[i] for i in r.integers(0, len(parts), r.integers(least, most)))

    def letters(n: int) -> str:
        return "".join("etaoinshrdlucmfgypwbvkxjzq"[i] for i in np.minimum(25, r.exponential(7, n).astype(int)))

    def prose(n: int) -> str:
        return " ".join(word() + (pick(accents, 1) + word(1, 3) if r.random() < 0.2 else "") for _ in range(n))

    def secret() -> str:
        return [
            lambda: pick("0123456789abcdef", int(r.choice([32, 40, 48, 64]))), lambda: pick("0123456789ABCDEF", int(r.choice([32, 40, 64]))), lambda: "AKIA" + pick(up + num, 16),
            lambda: pick(low + up + num + "+/", int(r.integers(24, 64))) + "=" * int(r.integers(0, 3)), lambda: "gh" + pick("pousr", 1) + "_" + pick(low + up + num, 36),
            lambda: "sk-" + pick(low + up + num, int(r.integers(24, 48))), lambda: "xox" + pick("bp", 1) + "-" + pick(num, 11) + "-" + pick(low + up + num, 24),
            lambda: "eyJ" + pick(low + up + num + "-_", int(r.integers(30, 60))), lambda: pick(low + up + num, int(r.integers(12, 44))), lambda: "AIza" + pick(low + up + num + "-_", 35),
        ][r.integers(0, 10)]()

    def inside() -> tuple[str, str]:
        """What a path, an assignment or an identifier puts before and behind a credential; mostly nothing."""
        k = r.integers(0, 8)
        return ("", "") if k < 5 else [(word() + "/" + word() + "/", ""), (word() + "=", ""), ("/".join(word() for _ in range(3)) + "/", "/" + word())][k - 5]

    def other() -> str:
        return [
            lambda: word(5, 10), lambda: word(4, 8).capitalize(), lambda: word(3, 9).upper(), lambda: pick(num, int(r.integers(10, 20))), lambda: "_".join(word() for _ in range(r.integers(2, 6))),
            lambda: "-".join(word() for _ in range(r.integers(2, 6))), lambda: "/".join(word() for _ in range(r.integers(2, 14))), lambda: "".join(word().capitalize() for _ in range(r.integers(2, 5))),
            lambda: pick("=-_", 1) * int(r.integers(10, 60)), lambda: f"20{pick(num, 2)}-{pick(num, 2)}-{pick(num, 2)}_{pick(num, 6)}", lambda: word(3, 7) + pick(num, int(r.integers(1, 5))),
            lambda: pick(low + up, 1) * int(r.integers(12, 40)), lambda: "-".join(pick(num, int(r.integers(2, 5))) for _ in range(r.integers(3, 5))), lambda: "/".join([word(), pick(num, 4), pick(num, 2), word(3, 6)]),
            lambda: (word(2, 3) * 9)[: int(r.integers(12, 40))], lambda: word(3, 5) + "=" + word(3, 5), lambda: "-".join(word().upper() for _ in range(r.integers(2, 4))),
            lambda: "+" + pick(num, 2) + "-" + pick(num, int(r.integers(7, 11))), lambda: word().upper() + "-" + pick(num, int(r.integers(4, 7))), lambda: "/".join([pick(num, 2), pick(num, 2), pick(num, 4)]),
            lambda: word(1, 3).upper() + "_" + word().upper() + "_" + word().upper(), lambda: "-".join([word(), pick(num, 1), pick(num, 1), pick(num, 1)]), lambda: word(2, 4).capitalize() + word(2, 4).upper(),
            lambda: letters(int(r.integers(10, 20))).upper(), lambda: letters(int(r.integers(10, 20))).upper(), lambda: letters(int(r.integers(16, 24))), lambda: letters(int(r.integers(15, 20))).capitalize(),
            lambda: (word() + letters(int(r.integers(2, 8))) + word()).upper(), lambda: (letters(int(r.integers(2, 5))) + word(3, 5)).upper(), lambda: pick(num, int(r.integers(13, 20))),
            lambda: word(1, 4), lambda: letters(int(r.integers(1, 10))), lambda: pick(num, int(r.integers(1, 10))), lambda: word(1, 4).capitalize(), lambda: letters(int(r.integers(1, 7))).upper(),
            lambda: word(1, 3) + pick(num, int(r.integers(1, 4))), lambda: pick("=-_/+", 1) * int(r.integers(1, 10)), lambda: pick(low + up + num, int(r.integers(1, 6))),
        ][r.integers(0, 38)]()

    found, label = [], []
    lead = ["token = \"", "password: ", "secret=", "api_key=", "key ", "Authorization: Bearer ", "export KEY=", "\n", " ", " (", "\"", "id: ", "see ", "http://x/", "= ", ": "]
    i = 0
    while len(found) < count:
        good = i % 2 == 0
        i += 1
        lead_in, lead_out = inside() if good else ("", "")
        body = secret() if good else other()
        text = lead_in + body + lead_out
        # words go on in letters beyond ASCII, which end a run
        close = not good and r.random() < 0.3
        before = prose(3) + (pick(accents + accents.upper(), 1) if close else " " + lead[r.integers(0, len(lead))])
        after = (pick(accents + accents.upper(), 1) + word(1, 3) + " " if close and r.random() < 0.5 else ["\" ", " ", "\n", ". ", ", ", "\"\n"][r.integers(0, 6)]) + prose(3)
        spans = windows(0, len(text))
        # of a long one, the window that holds most of the credential
        own = (len(lead_in), len(lead_in) + len(body))
        low_, high = max(spans, key=lambda s: min(s[1], own[1]) - max(s[0], own[0])) if good else spans[r.integers(0, len(spans))]
        found.append(((before + text[:low_]).encode(), text[low_:high].encode(), (text[high:] + after).encode()))
        label.append(good)
    return found, np.asarray(label, np.float32)


@lru_cache(maxsize=2)
def trained(count: int = 8000, seed: int = 29) -> Network:
    """The network, fitted on 4 of 6 parts, calibrated (by a logistic scale) on one, its threshold set on the last."""
    found, label = labelled_findings(count, seed)
    symbols, around = encode([x[0] for x in found], [x[1] for x in found], [x[2] for x in found])
    part = np.arange(count) // 2 % 6
    net = Network()
    net.train(symbols[part < 4], around[part < 4], label[part < 4])
    raw, y = net.logits(symbols, around), label
    scale, shift = 1.0, 0.0
    x = raw[part == 4]
    for _ in range(50):  # Newton's steps, a little ridge on the scale
        q = 1 / (1 + np.exp(-np.clip(scale * x + shift, -30, 30)))
        d, h = q - y[part == 4], q * (1 - q) + 1e-3
        g = np.array([d @ x + 0.1 * (scale - 1), d.sum()])
        step = np.linalg.solve(np.array([[h @ (x * x) + 0.1, h @ x], [h @ x, h.sum()]]), g)
        scale, shift = scale - step[0], shift - step[1]
    net.scale, net.shift = float(scale), float(shift)
    if net.scale <= 0:
        raise ValueError("the network's scores fall with its sums")
    good = np.sort(raw[(part == 5) & (y == 1)])
    net.cut = float(good[int((1 - RECALL) * len(good))])  # the highest at which the recall holds
    net.threshold = float(1 / (1 + np.exp(-np.clip(net.cut * net.scale + net.shift, -30, 30))))
    return net


def scan(texts: list[bytes], net: Network) -> list[list[tuple[int, int, int]]]:
    """Of each text its findings (start, kind, end), in code points, by start and kind."""
    out: list[list[tuple[int, int, int]]] = []
    for low, high in slices(texts):
        lot = texts[low:high]
        joined = b"\n".join(lot) + b"\n"
        raw = np.frombuffer(joined, np.uint8)
        begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in lot])))
        free = _CHARS[raw]
        begin, end = runs(free)
        long = end - begin >= 20
        base = [(b + m.start(), 1, b + m.end()) for b, e in zip(begin[long].tolist(), end[long].tolist(), strict=True) for m in ACCESS.finditer(joined[b:e]) if m.end() - m.start() >= 20]
        base += [(b + m.start(), 2, b + m.end()) for b, e in zip(begin[long].tolist(), end[long].tolist(), strict=True) for m in HEX.finditer(joined[b:e]) if m.end() - m.start() >= 24]
        for at, t in zip(begins.tolist(), lot, strict=False):
            if b"=" in t or b":" in t:
                base += [(at + m.start(), 0, at + m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        for s, _, e in base:
            free[s:e] = False
        begin, end = runs(free) if base else (begin, end)
        short = end - begin <= INNER
        cut = [w for b, e in zip(begin[~short].tolist(), end[~short].tolist(), strict=True) for w in windows(b, e)]
        begin, end = (np.concatenate((x[short], np.array([c[i] for c in cut], np.int64))) for i, x in enumerate((begin, end)))
        own = net.alone([joined[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True)])
        begin, end, own = (x[own + SWAY >= net.cut] for x in (begin, end, own))
        owner = np.searchsorted(begins, begin, "right") - 1
        first, last = begins[owner].tolist(), (begins[owner + 1] - 1).tolist()
        spans = list(zip(begin.tolist(), end.tolist(), strict=True))
        around = surroundings([joined[max(f, b - AROUND) : b] for f, (b, _) in zip(first, spans, strict=True)], [joined[e : min(z, e + AROUND)] for z, (_, e) in zip(last, spans, strict=True)])
        for b, e in sorted(spans[i] for i in np.flatnonzero(own + net.sway(around) >= net.cut).tolist()):
            if base and base[-1][1] == 3 and base[-1][2] >= b:  # windows of one candidate that overlap
                base[-1] = (base[-1][0], 3, e)
            else:
                base.append((b, 3, e))
        found: list[list[tuple[int, int, int]]] = [[] for _ in lot]
        if base:
            points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
            for s, kind, e in sorted(base):
                d = int(np.searchsorted(begins, s, "right")) - 1
                found[d].append((int(points[s] - points[begins[d]]), kind, int(points[e] - points[begins[d]])))
        out += found
    return out


_SPAN = pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("stop", pa.int64())])


def find_secrets(documents: DataFrame) -> DataFrame:
    """(doc_id, findings array<struct<kind, begin, stop>>) of every document, by place."""
    net = trained()
    schema = pa.schema([("doc_id", pa.int64()), ("findings", pa.list_(_SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = scan(texts_of(b.column(1)), net)
            yield to_batch({"doc_id": b.column(0), "findings": [[{"kind": KINDS[k], "begin": s, "stop": e} for s, k, e in f] for f in found]}, schema)

    source = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id long, findings array<struct<kind string, begin long, stop long>>")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    line = "transform({}, x -> concat_ws(':', x.kind, x.begin, x.stop))"
    count = "cast(size(filter(findings, x -> x.kind = '{}')) as long)"
    base = F.array_join(F.expr(line.format("filter(findings, x -> x.kind <> 'network')")), ",")
    return found.select(
        "doc_id",
        *[F.expr(count.format(k)).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.expr(line.format("findings")), ",").alias("spans"),
    )
