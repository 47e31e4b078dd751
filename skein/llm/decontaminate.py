"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

Training words stream through the automaton; at each word the length of the longest match that ends there is
known, and with it whether a window of ``window`` item words (or a whole shorter item) ends there.

Defined results: null, empty or wordless texts have no words and no hits; an empty benchmark hits nothing, an empty table gives no
rows; items that are null or wordless never occur, and items of equal words occur together; equal rows give equal results; very
long texts are streamed word by word; helper columns take names that the table does not have, and all its columns stay.
"""

from __future__ import annotations

import re
from array import array

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, fresh, table, text_or_empty

#: Words: runs of digits, letters and anything beyond ASCII, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_word = re.compile(WORD)
#: Bytes that are no part of a word become spaces, A-Z become a-z. The bytes of other characters are all >= 0x80.
_FOLD = bytes(32 if (b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F) else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the marks that windows and short items need.

    It is built with a dict a state and then kept flat: nearly all states have one way on, which two arrays hold; only states with
    several have a dict. That is some 16 bytes a state, besides the vocabulary."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        ways: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = _extend(ways, link, length, last, self.vocab.setdefault(w, len(self.vocab)))
        marks: dict[int, set[str]] = {}
        short: dict[int, int] = {}
        for name, words in items:
            if words and len(words) < window:
                s = 0
                for w in words:
                    s = ways[s][self.vocab[w]]
                short[s] = len(words)
                marks.setdefault(s, set()).add(name)
            s = n = 0
            for w in words if len(words) >= window else ():
                s, n = ways[s][self.vocab[w]], n + 1
                if n >= window:
                    while length[link[s]] >= window:
                        s = link[s]
                    n = min(n, length[s])
                    marks.setdefault(s, set()).add(name)
        self.items = {s: tuple(sorted(names)) for s, names in marks.items()}
        # For each state that has any: its nearest ancestors (itself included) that are a whole short item, longest first.
        self.shorts: dict[int, tuple[int, ...]] = {}
        if short:
            for s in sorted(range(1, len(link)), key=length.__getitem__):
                up = self.shorts.get(link[s], ())
                if s in short or up:
                    self.shorts[s] = (s, *up) if s in short else up
        self.link, self.len = array("i", link), array("i", length)
        one = [next(iter(d.items())) if len(d) == 1 else (-1, -1) for d in ways]
        self.word, self.to = array("i", [w for w, _ in one]), array("i", [t for _, t in one])
        self.several = {s: d for s, d in enumerate(ways) if len(d) > 1}

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint, sorted spans of hit words (end exclusive), and the items of which a window occurs."""
        get, only, to_of, several, link, length, shorts, window = self.vocab.get, self.word, self.to, self.several, self.link, self.len, self.shorts, self.window
        state = n = 0
        spans: list[tuple[int, int]] = []
        seen: set[str] = set()
        none: dict[int, int] = {}
        for i, word in enumerate(words):
            c = get(word)
            if c is None:
                state = n = 0
                continue
            while True:
                to = to_of[state] if only[state] == c else several.get(state, none).get(c)
                if to is not None:
                    state, n = to, n + 1
                    break
                state = link[state]
                if state == -1:
                    state = n = 0
                    break
                n = length[state]
            long = 0
            if n >= window:
                s = state
                while length[link[s]] >= window:
                    s = link[s]
                long = window
                seen.update(self.items.get(s, ()))
            for s in shorts.get(state, ()):
                if length[s] <= n:
                    long = max(long, length[s])
                    seen.update(self.items.get(s, ()))
            if long:
                start = i + 1 - long
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, seen


def _extend(ways: list[dict[int, int]], link: list[int], length: list[int], last: int, c: int) -> int:
    """The state of the item so far after one more word."""
    if c in ways[last]:
        q = ways[last][c]
        return q if length[q] == length[last] + 1 else _split(ways, link, length, last, c, q)
    new = len(link)
    ways.append({}), link.append(0), length.append(length[last] + 1)
    p = last
    while p != -1 and c not in ways[p]:
        ways[p][c] = new
        p = link[p]
    if p != -1:
        q = ways[p][c]
        link[new] = q if length[q] == length[p] + 1 else _split(ways, link, length, p, c, q)
    return new


def _split(ways: list[dict[int, int]], link: list[int], length: list[int], p: int, c: int, q: int) -> int:
    """A state for the shorter strings of q that end where p goes on with c."""
    new = len(link)
    ways.append(dict(ways[q])), link.append(link[q]), length.append(length[p] + 1)
    link[q] = new
    while p != -1 and ways[p].get(c) == q:
        ways[p][c] = new
        p = link[p]
    return new


def automata(benchmark: DataFrame, window: int, id_col: str, text_col: str, block_words: int):
    """Automata of blocks of items with at most block_words words each (one larger item makes a block of its own);
    items stream to the driver one partition at a time."""
    block, size = [], 0
    for item in benchmark.select(F.col(id_col).cast("string").alias("i"), text_or_empty(text_col).alias("t")).toLocalIterator():
        words = words_of(item["t"])
        if block and size + len(words) > block_words:
            yield Automaton(block, window)
            block, size = [], 0
        if words and item["i"] is not None:
            block.append((item["i"], words))
            size += len(words)
    yield Automaton(block, window)


_CHARS = "struct<n_words:long,n_hit:long,items:array<string>,spans:array<struct<start:long,end:long>>>"


def _scan(texts: pd.Series, model, char_spans: bool) -> pd.DataFrame:
    out = []
    for text in texts:
        words = words_of(text)
        spans, items = model.hits(words)
        hit = sum(e - s for s, e in spans)
        if spans and char_spans:
            at = [m.span() for m in _word.finditer(text.translate(_LOWER))]
            spans = [(at[s][0], at[e - 1][1]) for s, e in spans]
        out.append((len(words), hit, sorted(items), [{"start": s, "end": e} for s, e in spans]))
    return pd.DataFrame(out, columns=["n_words", "n_hit", "items", "spans"])


_LOWER = {b: b + 32 for b in range(0x41, 0x5B)}


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", char_spans: bool = True, block_words: int = 400_000, out: str = "hits") -> DataFrame:
    """Adds ``out``: n_words, n_hit, items (with an occurring window) and the hit spans, in code points (or words).

    One automaton of at most ``block_words`` item words is broadcast, which is at most some 50 MB a worker (and, while it is built, 200 MB
    on the driver); a larger benchmark is streamed in several passes over the documents, whose hits are united per document."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    blocks = iter(automata(benchmark, window, item_id, item_text, block_words))

    def passed(model: Automaton, df: DataFrame) -> DataFrame:
        sent = spark.sparkContext.broadcast(model)

        @F.pandas_udf(_CHARS)
        def scan(texts: pd.Series) -> pd.DataFrame:
            return _scan(texts, sent.value, char_spans)

        return df.withColumn(out, scan.asNondeterministic()(text_or_empty(text_col)))  # so that it is run once, wherever it is used

    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return passed(first, docs)
    t = text_or_empty(text_col)
    digests = F.xxhash64(t), F.xxhash64(F.lit("k"), t)
    slim = docs.select(digests[0].alias("_a"), digests[1].alias("_b"), F.col(text_col))

    def one(model):
        return cut(passed(model, slim).select("_a", "_b", F.col(out).alias("_h")).where("_h.n_hit > 0").dropDuplicates(["_a", "_b"]))

    every = one(first).unionByName(one(second))
    for m in blocks:
        every = every.unionByName(one(m))
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")

    def merge(acc, s):
        """Spans come sorted: one that starts inside the one before it, or where it ends, prolongs it."""
        last = F.element_at(acc, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (last["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(s)))

    a, b, items, spans = fresh(docs, "_a", "_b", "_items", "_spans")
    merged = F.aggregate(F.array_sort(F.flatten(F.collect_list("_h.spans"))), none, merge)
    union = every.groupBy(F.col("_a").alias(a), F.col("_b").alias(b)).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_h.items")))).alias(items), merged.alias(spans))
    keyed = docs.join(union, (digests[0] == F.col(a)) & (digests[1] == F.col(b)), "left")
    words_in = lambda c: F.size(F.filter(F.split(c, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")).cast("long")
    one_span = lambda s: words_in(t.substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))) if char_spans else s["end"] - s["start"]
    inside = F.aggregate(F.coalesce(spans, none), F.lit(0).cast("long"), lambda x, s: x + one_span(s))
    found = F.struct(words_in(t).alias("n_words"), inside.alias("n_hit"), F.coalesce(items, F.expr("cast(array() as array<string>)")).alias("items"), F.coalesce(spans, none).alias("spans"))
    return keyed.withColumn(out, found).drop(a, b, items, spans)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, text_col: str = "text", **options) -> DataFrame:
    """Removes hit spans from ``text_col``; documents of which more than ``max_coverage`` of the words are hit go.
    Untouched documents keep their text as it is (a null text stays null)."""
    (hits,) = fresh(docs, "_hits")
    found = find_hits(docs, benchmark, window, text_col, out=hits, **options)
    h = F.col(hits)

    kept = F.aggregate(
        h["spans"],
        F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(F.concat(a["text"], F.col(text_col).substr((a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))).alias("text"), s["end"].alias("at")),
        lambda a: F.concat(a["text"], F.col(text_col).substr((a["at"] + 1).cast("int"), F.length(text_col))),
    )
    few = (h["n_hit"] == 0) | (h["n_hit"] <= F.lit(max_coverage) * h["n_words"])
    return found.where(few).withColumn(text_col, F.when(h["n_hit"] == 0, F.col(text_col)).otherwise(kept)).drop(hits)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), char_spans=False)
    h = F.col("hits")
    return found.select("doc_id", h["n_words"].alias("n_words"), h["n_hit"].alias("n_hit"), F.size(h["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(h["items"], ","), 256).alias("items_sha256"), (h["n_hit"] > 0).alias("contaminated"))


OP4_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
grams AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS g
          FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM grams),
places AS (SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS g
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, sizes WHERE len(w) >= n)),
occ AS (SELECT doc_id, p, n, item_id FROM places JOIN grams USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM occ)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
