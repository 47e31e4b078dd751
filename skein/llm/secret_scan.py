"""Secret scans: base patterns, plus a character convolutional network over every further candidate.

The network (numpy, trained here) reads a candidate with its surrounding context, a long one in overlapping windows of which the highest
score counts. It learns from findings of the corpus (base spans as secrets, other long strings as none) and from generated ones of forms
that the base patterns miss. Documents are dealt by a hash of their text into folds: two train, one calibrates (Platt scaling, then the
highest threshold that still reaches the wanted recall), one only tests; ``report`` holds recall and precision there. All distinct findings
of the corpus take part in each of these: training goes in rounds over shards of them, each with the generated ones, whose weights are
averaged; sums and counts for calibration, threshold and test are taken where the findings lie. ``training_findings`` is the number of
generated ones. ``corpus_findings`` and ``trained`` fit a bounded number of findings in one process, for a caller with few.

Defined results: null and empty texts have no spans; equal rows give equal results; very long texts are read whole; spans are counted
in code points with an exclusive end, and of equal starts the kind listed first comes first; base spans always stay, the network only
adds spans (kind ``net``); an empty table trains on generated findings alone; all columns stay, ``out`` is replaced if it is there.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, table, text_or_empty

#: The base patterns, their kinds in listed order.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "net")
LEAST = {"assign": 6, "access": 20, "hex": 24}

_assign = re.compile(ASSIGN, re.I | re.A)
# A greedy run that is too short fails as a whole, so the least length can stand in the pattern.
_access = re.compile(r"AKIA[A-Z0-9]{16,}")
_hex = re.compile(r"[0-9a-f]{24,}")
# Further candidates: long unbroken strings that hold a digit, and key blocks.
_loose = re.compile(r"[A-Za-z0-9+/_=-]{16,}|-----BEGIN [A-Z ]*PRIVATE KEY-----", re.A)
_digit = re.compile(r"[0-9]", re.A)

WIDTH, CONTEXT, STEP = 64, 24, 16
_ALPHABET = 100
#: Training over all findings: rounds, and about how many findings a shard holds. Sums of weights are exact in units of 2^-_UNIT; the
#: threshold lies on a grid of 2^-_GRID of the logit, of which a bucket holds 2^_WIDE steps.
ROUNDS, SHARD, _UNIT = 4, 4096, 40
_GRID, _WIDE, _MOST = 20, 12, 1 << 27


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Codes of CONTEXT characters before, the candidate's first WIDTH, and CONTEXT after it."""
    parts = (text[max(0, start - CONTEXT) : start].rjust(CONTEXT), text[start : min(end, start + WIDTH)].ljust(WIDTH), text[end : end + CONTEXT].ljust(CONTEXT))
    codes = np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32)
    return np.where((codes >= 32) & (codes < 127), codes - 31, 0).astype(np.int64)


def windows(text: str, start: int, end: int) -> Iterator[np.ndarray]:
    """The candidate as ``encode`` gives it, then windows of WIDTH at every STEP up to its end, each in its own surroundings."""
    yield encode(text, start, end)
    if end - start > WIDTH:
        for a in range(start + STEP, end - WIDTH, STEP):
            yield encode(text, a, a + WIDTH)
        yield encode(text, end - WIDTH, end)


def labelled_texts(n: int, seed: int, joined: bool = False) -> Iterator[tuple[str, int, int, float]]:
    """Generated findings (text, start, end, secret): keys of several forms in assignments and headers against words, numbers, paths,
    urls, digests of commits and files, ids and embedded data; ``joined`` ones stand at the end of a path of over WIDTH characters, which is part of the candidate."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, size: "".join(rng.choice(list(chars), size))
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: pick(low, int(rng.integers(2, 9)))
    for i in range(n):
        secret = i % 2 == 0
        form = int(rng.integers(0, 6))
        if secret:
            value = [pick(low + up + digits, int(rng.integers(20, 50))), pick("abcdef" + digits, int(rng.integers(24, 64))), "ghp_" + pick(low + up + digits, 36), "sk-" + pick(low + up + digits, 40), pick(low + up + digits + "+/", 40) + "==", "-----BEGIN RSA PRIVATE KEY-----"][form]
            before = [f"{word()} key: ", f'{word()}_key = "', "Authorization: Bearer ", f" {word()} ", f"export {word().upper()}_KEY=", f"{word()}: '"][int(rng.integers(0, 6))]
        else:
            value = ["-".join(word() for _ in range(4)) + "-" + pick(digits, 2), pick(digits, int(rng.integers(16, 24))), "/".join(word() for _ in range(4)) + pick(digits, 1), "_".join(word() for _ in range(4)) + pick(digits, 1), "=" * int(rng.integers(16, 40)) + "1", "".join(word() for _ in range(4)) + pick(digits, 1)][form]
            before = [f" {word()} ", f"see {word()}/", f"https://{word()}.example/", f"{word()} no. ", f"({word()} ", f"\n{word()} "][int(rng.integers(0, 6))]
            if rng.random() < 0.35 and not joined:
                kind = int(rng.integers(0, 3))
                value = [pick("ABCDEF" + digits, 40), "iVBORw0KGgo" + pick(low + up + digits + "+/", int(rng.integers(20, 60))), "-".join(pick("ABCDEF" + digits, k) for k in (8, 4, 4, 4, 12))][kind]
                before = [["commit ", "revision ", "sha1 of file: "], ["data:image/png;base64,", "src=data:image/png;base64,", "url(data:image/png;base64,"], ["uuid ", "request id ", "urn:uuid:"]][kind][int(rng.integers(0, 3))]
        if joined:
            value = "/".join(word() for _ in range(int(rng.integers(24, 48)))) + "/" + value
        text = f"{word()} {word()} {before}{value}{rng.choice([' ', chr(34), chr(10), '. ', ''])}{word()} {word()}"
        at = text.index(value, len(text) - len(text.lstrip()))
        yield text, at, at + len(value), float(secret)


def labelled_findings(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and labels of ``labelled_texts``."""
    found = list(labelled_texts(n, seed))
    return np.array([encode(*f[:3]) for f in found]), np.array([f[3] for f in found])


_WEIGHTS = ("e", "w", "b", "v", "c")


class CharNet:
    """Embedding, one convolution, max pooling and a logistic output; Adam with a fixed seed, plain numpy."""

    def __init__(self, filters: int = 32, kernel: int = 5, dim: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.k = kernel
        self.e = rng.normal(0, 0.3, (_ALPHABET, dim))
        self.w = rng.normal(0, 1 / np.sqrt(kernel * dim), (kernel * dim, filters))
        self.b = np.zeros(filters)
        self.v = rng.normal(0, 1 / np.sqrt(3 * filters), 3 * filters)
        self.c = np.zeros(1)
        self.scale, self.shift, self.threshold, self.long_threshold = 1.0, 0.0, 0.5, 0.5

    def _forward(self, x: np.ndarray):
        """Three pools: before, inside and after the candidate."""
        emb = self.e[x]
        win = np.lib.stride_tricks.sliding_window_view(emb, self.k, axis=1).transpose(0, 1, 3, 2).reshape(len(x), x.shape[1] - self.k + 1, -1)
        conv = win @ self.w + self.b
        cuts = (0, CONTEXT, CONTEXT + WIDTH - self.k + 1, conv.shape[1])
        pooled, where = [], []
        for a, z in zip(cuts, cuts[1:]):
            arg = conv[:, a:z].argmax(1) + a
            where.append(arg)
            pooled.append(np.take_along_axis(conv, arg[:, None], 1)[:, 0])
        h = np.concatenate(pooled, 1)
        r = np.maximum(h, 0)
        return win, where, h, r, r @ self.v + self.c

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[4] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def of_logits(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.of_logits(self.logits(x))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, rate: float = 0.01, seed: int = 7) -> "CharNet":
        rng = np.random.default_rng(seed)
        names = _WEIGHTS
        m = {n: np.zeros_like(getattr(self, n)) for n in names}
        s = {n: np.zeros_like(getattr(self, n)) for n in names}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 64):
                xb, yb = x[order[i : i + 64]], y[order[i : i + 64]]
                win, where, h, r, z = self._forward(xb)
                dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - yb) / len(xb)
                g = {"v": r.T @ dz, "c": np.array([dz.sum()])}
                dh = dz[:, None] * self.v * (h > 0)
                f = self.w.shape[1]
                g["w"], g["b"], g["e"] = np.zeros_like(self.w), dh.reshape(len(xb), 3, f).sum((0, 1)), np.zeros_like(self.e)
                rows = np.arange(len(xb))[:, None]
                for p, arg in enumerate(where):
                    d = dh[:, p * f : (p + 1) * f]
                    taken = win[rows, arg]
                    g["w"] += np.einsum("nfi,nf->if", taken, d)
                    back = (d[:, :, None] * self.w.T[None]).reshape(len(xb), f, self.k, -1)
                    at = arg[:, :, None] + np.arange(self.k)
                    np.add.at(g["e"], xb[rows[:, :, None], at], back)
                step += 1
                for n in names:
                    m[n] = 0.9 * m[n] + 0.1 * g[n]
                    s[n] = 0.999 * s[n] + 0.001 * g[n] ** 2
                    setattr(self, n, getattr(self, n) - rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(s[n] / (1 - 0.999**step)) + 1e-8))
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> "CharNet":
        """Platt scaling by Newton steps, then the highest threshold with the wanted recall."""
        z = self.logits(x)
        self.scale, self.shift = platt(lambda a: logistic_sums(a, z, y))
        positive = np.sort(self.probability(x)[y == 1])
        self.threshold = float(positive[int(np.floor((1 - recall) * len(positive)))]) if len(positive) else 0.5
        return self

    def weights(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in _WEIGHTS])

    def load(self, flat: np.ndarray) -> "CharNet":
        at = 0
        for n in _WEIGHTS:
            now = getattr(self, n)
            setattr(self, n, np.array(flat[at : at + now.size], dtype=float).reshape(now.shape))
            at += now.size
        return self


def logistic_sums(a: np.ndarray, z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums over the findings for one Newton step at (scale, shift): those of the second derivatives (zz, z, 1), of the first (z, 1), and
    the loss."""
    u = a[0] * z + a[1]
    p = 1 / (1 + np.exp(-np.clip(u, -30, 30)))
    w = p * (1 - p)
    return np.array([(w * z * z).sum(), (w * z).sum(), w.sum(), ((p - y) * z).sum(), (p - y).sum(), (np.maximum(u, 0) - u * y + np.log1p(np.exp(-np.abs(u)))).sum()])


def platt(sums: Callable[[np.ndarray], np.ndarray]) -> tuple[float, float]:
    """Scale and shift by Newton steps on ``sums``, halved where the loss would grow, until they stand still. The scale stays above 0, so
    that scores keep the order of the logits."""
    prior = np.array([1.0, 0.0])
    loss = lambda a, s: s[5] + 5e-4 * ((a - prior) ** 2).sum()
    a, now = prior, sums(prior)
    for _ in range(25):
        step = np.linalg.solve(np.array([[now[0], now[1]], [now[1], now[2]]]) + 1e-3 * np.eye(2), now[3:5] + 1e-3 * (a - prior))
        then = sums(a - step)
        while loss(a - step, then) > loss(a, now) and np.abs(step).max() >= 1e-9:
            step = step / 2
            then = sums(a - step)
        if np.abs(step).max() < 1e-9:
            break
        a, now = a - step, then
    return max(float(a[0]), 1e-3), float(a[1])


Finding = tuple[str, int, int, float]


@functools.lru_cache(maxsize=2)
def _generated(n: int, seed: int) -> tuple[Finding, ...]:
    return tuple(labelled_texts(n, seed))


def trained(n: int = 3000, seed: int = 7, recall: float = 0.95, found: tuple[tuple[Finding, ...], ...] = ((), (), ())) -> CharNet:
    """The network fitted on two thirds of the generated findings and the first part of the found ones, calibrated on the rest and
    the second part, tested on the third and on further generated ones. Candidates over WIDTH characters have a threshold of their
    own, which reaches the recall on generated findings that are joined to a path, scored by windows. A few seconds, bounded by n and
    the number found."""
    fit, held, test = (a + b for a, b in zip(_parts(n, seed), map(list, found)))
    net = CharNet(seed=seed).fit(*_coded(fit), seed=seed).calibrate(*_coded(held), recall)
    _threshold_of_long(net, n, seed, recall)
    x, y = _coded(test)
    p, y = net.probability(x) >= net.threshold, y == 1
    return _report(net, int((p & y).sum()), int(y.sum()), int(p.sum()), len(test), len(found[2]))


def _parts(n: int, seed: int) -> tuple[list[Finding], list[Finding], list[Finding]]:
    """Generated findings to train, to calibrate and to test."""
    every, part = _generated(n, seed), n * 2 // 3
    return [*every[:part]], [*every[part:]], [*_generated(max(n // 4, 1), seed + 2)]


def _coded(found: list[Finding]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([encode(*f[:3]) for f in found]), np.array([f[3] for f in found])


def _threshold_of_long(net: CharNet, n: int, seed: int, recall: float) -> None:
    long = [f[:3] for f in labelled_texts(n - n * 2 // 3, seed + 1, joined=True) if f[3] and _loose.fullmatch(*f[:3])]
    if long:
        net.long_threshold = float(np.sort(best_scores(net, long))[int(np.floor((1 - recall) * len(long)))])


def _report(net: CharNet, hit: int, positive: int, kept: int, tested: int, of_corpus: int) -> CharNet:
    net.report = {"tested": tested, "of_corpus": of_corpus, "recall": hit / positive if positive else None, "precision": hit / kept if kept else None}
    return net


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end), sorted."""
    found = [(m.start(), 0, m.end()) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    found += [(m.start(), 1, m.end()) for m in _access.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Long strings with a digit, less those that base spans cover as a whole."""
    starts, ends, out = [], [], []
    for s, _, e in base:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for m in _loose.finditer(text):
        s, e = m.span()
        if _digit.search(text, s, e) or text[s] == "-":
            i = bisect_right(starts, s) - 1
            if i < 0 or ends[i] < e:
                out.append((s, e))
    return out


def best_scores(model: CharNet, spans: Iterable[tuple[str, int, int]], most: int = 4096) -> list[float]:
    """The highest probability over the windows of each span; at most so many windows are held at once."""
    best, of, codes = [], [], []

    def score():
        np.maximum.at(held := np.array(best), of, model.probability(np.array(codes)))
        best[:] = held.tolist()
        of.clear()
        codes.clear()

    for text, s, e in spans:
        best.append(0.0)
        for w in windows(text, s, e):
            of.append(len(best) - 1)
            codes.append(w)
            if len(codes) == most:
                score()
    if codes:
        score()
    return best


def findings(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(fold, text, start, end, label, h): all distinct findings of the corpus, each with its surroundings, labelled by whether it is a base
    span; written out, as they are read more than once."""

    @F.pandas_udf("array<struct<text:string,start:int,end:int,label:double>>")
    def find(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            base = base_spans(text)
            spans = [(s, e, 1.0) for s, _, e in base] + [(s, e, 0.0) for s, e in candidates(text, base)]
            out.append([{"text": text[max(0, s - CONTEXT) : min(e, s + WIDTH) + CONTEXT], "start": min(s, CONTEXT), "end": min(s, CONTEXT) + min(e - s, WIDTH), "label": y} for s, e, y in spans])
        return pd.Series(out)

    t = text_or_empty(text_col)
    rows = docs.select(F.pmod(F.xxhash64(t), F.lit(4)).alias("fold"), F.explode(find(t)).alias("f")).select("fold", "f.*").distinct()
    return cut(rows.withColumn("h", F.xxhash64("text", "start")))


def corpus_findings(docs: DataFrame, text_col: str = "text", most: int = 2000) -> tuple[tuple[Finding, ...], ...]:
    """A bounded number of findings for training, calibration and test in one process (``trained``): of each label at most ``most``, those
    of the least hash. ``find_secrets`` takes all of them (``trained_on``)."""
    rows = findings(docs, text_col)
    parts: tuple[list[Finding], ...] = ([], [], [])
    for label in (0.0, 1.0):
        own = rows.where(F.col("label") == label)
        total = own.count()
        # About twice as many as wanted by the value of the hash, so that the order is taken over few rows however many there are.
        bar = min(1.0, 2.0 * most / max(total, 1)) * 2.0**64 - 2.0**63
        for r in own.where(F.col("h").cast("double") <= bar).orderBy("h", "text").limit(most).collect():
            parts[(0, 0, 1, 2)[r["fold"]]].append((r["text"], r["start"], r["end"], label))
    return tuple(map(tuple, parts))


def _round(net: CharNet, rows: DataFrame, generated: list[Finding], seed: int) -> np.ndarray:
    """The mean of the weights that each shard of ``rows`` comes to from those of ``net``, in one epoch over its findings and the
    generated ones. Weights are summed as whole numbers, so that the order in which shards end makes no difference."""
    flat, x, y = net.weights(), *_coded(generated)

    def shard(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["h", "text", "start", "end", "fold", "label"])
        own, label = _coded(list(found[["text", "start", "end", "label"]].itertuples(index=False, name=None)))
        after = CharNet().load(flat).fit(np.concatenate([x, own]), np.concatenate([y, label]), epochs=1, rate=0.003, seed=seed).weights()
        return pd.DataFrame({"at": np.arange(len(after)), "w": np.rint(after * 2.0**_UNIT).astype(np.int64)})

    sums = rows.groupBy("shard").applyInPandas(shard, "at long, w long").groupBy("at").agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect()  # a row a weight
    for r in sums:
        flat[r["at"]] = r["w"] / r["n"] / 2.0**_UNIT
    return flat


def _nth(positive: DataFrame, more: np.ndarray, n: int) -> int:
    """The n-th least (from 0) of the grid values ``q`` of the rows and ``more``, counted first by buckets, then inside one of them."""

    def reach(values: Counter, n: int) -> tuple[int, int]:
        for v in sorted(values):
            if n < values[v]:
                return v, n
            n -= values[v]
        raise ValueError("fewer values than n")

    def counted(rows: DataFrame, by, values) -> Counter:
        return Counter({r["v"]: r["count"] for r in rows.groupBy(by.alias("v")).count().collect()}) + Counter(values)  # bounded by _MOST and _WIDE

    bucket, n = reach(counted(positive, F.shiftright("q", _WIDE), (more >> _WIDE).tolist()), n)
    return reach(counted(positive.where(F.shiftright("q", _WIDE) == bucket), F.col("q"), more[more >> _WIDE == bucket].tolist()), n)[0]


def trained_on(docs: DataFrame, text_col: str = "text", n: int = 3000, seed: int = 7, recall: float = 0.95, rounds: int = ROUNDS, shard: int = SHARD) -> CharNet:
    """As ``trained``, over all findings of the corpus. The network starts from the generated findings and goes over the training folds
    in ``rounds``, in shards of about ``shard`` findings; the driver holds its weights, counts and the generated findings only."""
    found = findings(docs, text_col)
    fit, held, test = _parts(n, seed)
    net = CharNet(seed=seed).fit(*_coded(fit), seed=seed)
    total = found.where("fold < 2").count()
    if total:
        shards = -(-total // shard)
        rows = found.where("fold < 2").withColumn("shard", F.pmod(F.xxhash64("h", "text", "end"), F.lit(shards))).repartition(shards, "shard")
        for k in range(rounds):
            net.load(_round(net, rows, fit, seed + k))
    flat = net.weights()

    @F.pandas_udf("double")
    def logit(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
        return pd.Series(CharNet().load(flat).logits(np.array([encode(*f) for f in zip(text, start, end)])))

    scored = cut(found.where("fold >= 2").select("fold", "label", logit("text", "start", "end").alias("z")))
    mine, z = scored.where("fold = 2"), F.col("z")
    (x, y), (x3, y3) = _coded(held), _coded(test)
    own = net.logits(x)

    def sums(a: np.ndarray) -> np.ndarray:
        u = float(a[0]) * z + float(a[1])
        p = 1 / (1 + F.exp(-F.greatest(F.least(u, F.lit(30.0)), F.lit(-30.0))))
        w, d = p * (1 - p), p - F.col("label")
        off = F.greatest(u, F.lit(0.0)) - u * F.col("label") + F.log1p(F.exp(-F.abs(u)))
        row = mine.select(*[F.coalesce(F.sum(e), F.lit(0.0)) for e in (w * z * z, w * z, w, d * z, d, off)]).first()
        return logistic_sums(a, own, y) + np.array(row)

    net.scale, net.shift = platt(sums)
    grid = F.greatest(F.least(F.floor(z * 2.0**_GRID), F.lit(_MOST - 1)), F.lit(-_MOST)).cast("long")
    positive = mine.where("label = 1").select(grid.alias("q"))
    more = np.clip(np.floor(own[y == 1] * 2.0**_GRID), -_MOST, _MOST - 1).astype(np.int64)
    many = positive.count() + len(more)
    bar = _nth(positive, more, int(np.floor((1 - recall) * many))) / 2.0**_GRID if many else None
    net.threshold = net.of_logits(np.array([bar]))[0] if many else 0.5
    _threshold_of_long(net, n, seed, recall)
    p3 = net.probability(x3) >= net.threshold
    # Probabilities are the same from a logit of 30 on, as the scan sees them.
    kept, secret = (z >= min(bar, (30 - net.shift) / net.scale) if many else net.scale * z + net.shift >= 0), F.col("label") == 1
    t = scored.where("fold = 3").agg(F.count("*"), F.count_if(secret), F.count_if(kept), F.count_if(kept & secret)).first()
    return _report(net, t[3] + int((p3 & (y3 == 1)).sum()), t[1] + int((y3 == 1).sum()), t[2] + int(p3.sum()), t[0] + len(y3), t[0])


def find_secrets(docs: DataFrame, text_col: str = "text", out: str = "secrets", training_findings: int = 3000, recall: float = 0.95, model: CharNet | None = None) -> DataFrame:
    """Adds ``out``: array of (kind, start, end, value, score), by start, then kind. Base findings have the
    network's calibrated score as information only; added ones reach the recall-constrained threshold. Without a ``model`` one is
    trained on all findings of the table itself."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    if model is None:
        model = trained_on(docs, text_col, training_findings, recall=recall)
    net = spark.sparkContext.broadcast(model)  # a few thousand weights

    @F.pandas_udf("array<struct<kind:string,start:long,end:long,value:string,score:double>>")
    def scan(texts: pd.Series) -> pd.Series:
        model, rows = net.value, []
        for text in texts:
            base = base_spans(text)
            spans = [(s, k, e) for s, k, e in base] + [(s, 3, e) for s, e in candidates(text, base)]
            rows.append(spans)
        scores = iter(best_scores(model, ((text, s, e) for text, spans in zip(texts, rows) for s, _, e in spans)))
        result = []
        for text, spans in zip(texts, rows):
            kept = [(s, k, e, float(p)) for (s, k, e), p in zip(spans, [next(scores) for _ in spans]) if k < 3 or p >= (model.long_threshold if e - s > WIDTH else model.threshold)]
            result.append([{"kind": KINDS[k], "start": s, "end": e, "value": text[s:e], "score": p} for s, k, e, p in sorted(kept)])
        return pd.Series(result)

    return docs.withColumn(out, scan(text_or_empty(text_col)))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] != "net")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(joined(base), 256).alias("base_sha256"), joined("secrets").alias("spans"))
