"""Best-fit packing: pattern packing by non-negative least squares over the histogram of piece lengths.

Patterns of two or three lengths that fill a sequence exactly are enumerated, their repeat counts are fitted to
the histogram, rounded and made feasible; the residual is packed best-fit-decreasing, also on the histogram.
The driver sees one histogram (at most ``capacity`` rows); pieces find their place by their rank among pieces of
equal length, which is taken per (length, partition) so that no length lands in one task.

Defined results: null text counts as empty (one piece, the end id alone); an empty table gives no rows; equal
rows are packed each for itself; documents longer than the capacity are cut so that the first piece is the short one, and
very long ones are encoded whole; pieces of equal length are placed in the order of their rows; columns but id and text
are not read, so no name clashes.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, table, text_or_empty

CAPACITY, END_ID = 2048, 0
#: Runs of white space from this length on are encoded apart, so that the pre-tokenizer need not look back over them.
_LONG_SPACE = re.compile(r"[^\S\x1c-\x1f]{1000,}")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of a byte-level BPE file. Texts are encoded whole, but for special tokens and long runs of white space: such a run
    but its last character (all of it at the end) is one piece of the pre-tokenizer, and what follows begins with that character."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = _byte_alphabet()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in byte_of for c in token)}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", ()) if t.get("special")}
        ranks = {k: v for k, v in ranks.items() if v not in special.values()}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = special
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def ids(self, text: str) -> np.ndarray:
        if self.marks and self.marks.search(text):
            return np.concatenate([np.array([self.special[p]], np.uint32) if i % 2 else self._plain(p) for i, p in enumerate(self.marks.split(text))])
        return self._plain(text)

    def _plain(self, text: str) -> np.ndarray:
        if len(text) < 1000 or not (run := _LONG_SPACE.search(text)):
            return self._encoded(text)
        parts, at = [], 0
        while run:
            parts.append(self._encoded(text[at : run.start()]))
            at = run.end() - (run.end() < len(text))
            parts.append(np.array(self.bpe._encode_single_piece(text[run.start() : at]), np.uint32))
            run = _LONG_SPACE.search(text, run.end())
        return np.concatenate([*parts, self._encoded(text[at:])])

    def _encoded(self, text: str) -> np.ndarray:
        return self.bpe.encode_to_numpy(text, disallowed_special=())


def _byte_alphabet() -> dict[str, int]:
    """The public byte-to-character rule of byte-level BPE files: printable bytes stand for themselves, the others for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces_of(ids: np.ndarray, capacity: int) -> list[dict]:
    n, raw = len(ids), memoryview(ids.astype("<u4", copy=False)).cast("B")
    first = (n - 1) % capacity + 1
    cuts = [0, *range(first, n + 1, capacity)]
    return [{"piece": i, "start": a, "length": b - a, "ids_crc32": zlib.crc32(raw[4 * a : 4 * b])} for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def tokenized(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text_col: str = "text") -> DataFrame:
    """The rows of docs times their pieces: piece, start, length, ids_crc32 in column ``_p``."""

    bounded_batches(docs.sparkSession)
    @F.pandas_udf("array<struct<piece:int,start:long,length:long,ids_crc32:long>>")
    def split(texts: pd.Series) -> pd.Series:
        enc = encoder(tokenizer)
        return pd.Series([pieces_of(np.append(enc.ids(t), np.uint32(END_ID)), capacity) for t in texts])

    return docs.withColumn("_p", F.explode(split(text_or_empty(text_col))))


# The plan: on the histogram only.


def patterns(present: np.ndarray, capacity: int, step: int = 32) -> np.ndarray:
    """Pairs and triples (zero-padded) of present lengths that sum to the capacity; the second of a triple on a grid of ``step``
    and on the ``step`` shortest lengths. Their number is bounded by the capacity, not by the data."""
    have = np.zeros(capacity + 1, bool)
    have[present] = True
    found = [(a, capacity - a, 0) for a in range((capacity + 1) // 2, capacity) if have[a] and have[capacity - a]]
    seconds = np.unique(np.concatenate([np.arange(step, capacity, step), np.arange(1, step)]))
    for a in np.nonzero(have)[0]:
        b = seconds[(seconds <= a) & have[seconds]]
        c = capacity - a - b
        ok = (c >= 1) & (c <= b)
        ok[ok] = have[c[ok]]
        found += [(int(a), int(x), int(y)) for x, y in zip(b[ok], c[ok])]
    return np.array(sorted(set(found)), dtype=np.int64).reshape(-1, 3)


def fit_repeats(pats: np.ndarray, hist: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares |A x - h| by multiplicative updates, A being the counts of lengths in patterns."""
    m = len(hist)

    def forward(x):
        out = np.bincount(pats[:, 0], x, m) + np.bincount(pats[:, 1], x, m) + np.bincount(pats[:, 2], x, m)
        out[0] = 0
        return out

    back = lambda r: r[pats[:, 0]] + r[pats[:, 1]] + np.where(pats[:, 2] > 0, r[pats[:, 2]], 0)
    h = hist.astype(float)
    h[0] = 0
    x = np.full(len(pats), max(h.sum(), 1) / (2.5 * max(1, len(pats))))
    top = back(h)
    for _ in range(rounds):
        x *= top / np.maximum(back(forward(x)), 1e-12)
    return x


def plan(hist: np.ndarray, capacity: int) -> np.ndarray:
    """Segments (length, first rank, count, per sequence, first sequence, offset): pieces of that length whose rank is in
    first rank + [0, count) stand in first sequence + (rank - first rank) // per, at offset + ((rank - first rank) % per) * length."""
    pats = patterns(np.nonzero(hist[:capacity])[0], capacity)
    fitted = fit_repeats(pats, np.append(hist[:capacity], 0)) if len(pats) else np.zeros(0)
    best = None
    for share in (1.0, 0.9, 0.7, 0.4):
        groups = _groups(hist, pats, fitted * share, capacity)
        if best is None or sum(n for n, _ in groups) < sum(n for n, _ in best):
            best = groups
    rank, out, seq = np.zeros(capacity + 1, np.int64), [], 0
    for n, lengths in best or ():
        offset = 0
        for length, per in lengths:
            out.append((length, rank[length], n * per, per, seq, offset))
            rank[length] += n * per
            offset += length * per
        seq += n
    return np.array(out, np.int64).reshape(-1, 6)


def _groups(hist: np.ndarray, pats: np.ndarray, fitted: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    left = hist.astype(np.int64).copy()
    done: list[tuple[int, list[tuple[int, int]]]] = [(int(left[capacity]), [(capacity, 1)])] if left[capacity] else []
    left[capacity] = 0
    repeats = np.diff(np.floor(np.cumsum(fitted) + 0.5), prepend=0).astype(np.int64)  # rounds so that sums stay
    for i in np.argsort(-repeats, kind="stable"):
        if repeats[i] <= 0:
            break
        need: dict[int, int] = {}
        for length in pats[i]:
            if length:
                need[int(length)] = need.get(int(length), 0) + 1
        n = min(int(repeats[i]), *(int(left[k]) // v for k, v in need.items()))
        if n > 0:
            for k, v in need.items():
                left[k] -= n * v
            done.append((n, sorted(need.items(), reverse=True)))
    # The residual: best fit, longest first; groups of sequences with the same content are handled as one.
    room: list[list[tuple[int, list[tuple[int, int]]]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity - 1, 0, -1):
        c, free = int(left[length]), length
        while c and free < capacity:
            if not room[free]:
                free += 1
                continue
            n, have = room[free].pop()
            per = min(free // length, c)
            use = min(n, c // per)
            if use < n:
                room[free].append((n - use, have))
            room[free - per * length].append((use, [*have, (length, per)]))
            c -= use * per
        if c:
            per = capacity // length
            if c >= per:
                room[capacity - per * length].append((c // per, [(length, per)]))
            if c % per:
                room[capacity - c % per * length].append((1, [(length, c % per)]))
    return done + [g for gs in room for g in gs]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to capacity. The rows are materialised once."""
    spark = pieces.sparkSession
    rows = cut(pieces).withColumn("_pid", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    counts = cut(rows.groupBy("length", "_pid").count())
    hist = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most `capacity` rows
        hist[r["length"]] = r["n"]
    segments = plan(hist, capacity)
    order = np.lexsort((segments[:, 1], segments[:, 0]))
    sent = spark.sparkContext.broadcast(segments[order])  # bounded by the capacity

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s = sent.value
        size, r = length.to_numpy(), rank.to_numpy()
        i = np.searchsorted(s[:, 0] * (1 << 44) + s[:, 1], size * (1 << 44) + r, side="right") - 1
        d = r - s[i, 1]
        return pd.DataFrame({"sequence_id": s[i, 4] + d // s[i, 3], "offset": s[i, 5] + d % s[i, 3] * size})

    before = counts.select("length", "_pid", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("length", "_pid").orderBy("_at")) - 1
    ranked = rows.withColumn("_local", local).join(before, ["length", "_pid"]).withColumn("_place", place("length", F.col("_local") + F.col("_before")))
    return ranked.withColumn("sequence_id", F.col("_place.sequence_id")).withColumn("offset", F.col("_place.offset")).drop("_pid", "_at", "_local", "_before", "_place")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    p = tokenized(docs.select(id_col, text_col), tokenizer or default_tokenizer(), capacity, text_col)
    slim = p.select(F.col(id_col).alias("doc_id"), *[F.col(f"_p.{c}").alias(c) for c in ("piece", "start", "length", "ids_crc32")])
    return pack(slim, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
