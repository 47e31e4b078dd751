"""N-gram Jaccard join by chosen paths.

Texts become sets of word 5-grams, equal sets one class. Each class is embedded by ``COORDINATES`` min-wise tokens; the children of
the root follow from whole tokens, everything below from their low bytes, the sketch. A node of the recursion samples some positions
by a hash of its own; records with the same token at a sampled position share a child. Small buckets are compared all against all by sketch; larger ones split again, after a pass against one leader. What is still large
at the last level is compared in blocks of pairs, unless all of it is connected already. How many positions the root and the
nodes below it sample follows from the target recall, so that it holds for a pair at the threshold of which every shared
bucket is large down to the last level (see ``miss``).

Candidate connections only decide which classes meet; within each connected group all pairs are then counted exactly
from the sets (in blocks where a group is large), and links of the wanted similarity alone make the final groups.

Defined results: null text counts as empty; texts of fewer than five words are one shingle; texts without words are equal only to the same
text; rows equal in id and text count each for themselves; very long texts are shingled whole; a tie for the least id of a group
goes to either row, as only the id is shown; an empty table gives no rows; only id and text are read, so no name clashes, and
``keep_one_each`` returns all columns as they are.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, broadcast_if_small, cut, fresh, table, text_or_empty
from .decontaminate import words_of

WORDS, SIMILARITY, COORDINATES = 5, 0.8, 128
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = x + _M1
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
        return x ^ (x >> np.uint64(31))


_FACTORS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = mix(np.arange(1001, 1001 + COORDINATES, dtype=np.uint64))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        got = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return got


_hash = _WordHash()


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; of all words together where they are fewer."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_hash.__getitem__, words), np.uint64, len(words))
    k = min(n, len(w))
    with np.errstate(over="ignore"):
        h = np.zeros(len(w) - k + 1, np.uint64)
        for j in range(k):
            h = mix(h * _M2 + w[j : len(w) - k + 1 + j])
        return np.unique(h + np.uint64(k))


def sketch(s: np.ndarray) -> np.ndarray:
    """COORDINATES min-wise tokens (32 bits each)."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 4096):
            low = np.minimum(low, (s[i : i + 4096, None] * _FACTORS + _SHIFTS).min(0))
    return (low >> np.uint64(32)).astype(np.uint32)


def profile(texts: pd.Series, count: int) -> pd.DataFrame:
    """Class id, size of the set, the low bytes of its tokens, and the children of the root."""
    out, root = [], np.zeros(1, np.uint64)
    for text in texts:
        s = shingles(text)
        name = hashlib.md5(s.tobytes() if len(s) else b"\0" + text.encode("utf-8", "surrogatepass")).digest()
        tokens = sketch(s) if len(s) else None
        out.append((name, len(s), None if tokens is None else tokens.astype(np.uint8).tobytes(), None if tokens is None else children(root, tokens[None], count)[0].view(np.int64)))
    return pd.DataFrame(out, columns=["cid", "n", "small", "nodes"])


def children(nodes: np.ndarray, tokens: np.ndarray, count: int) -> np.ndarray:
    """(record, child): the children of records in nodes at ``count`` positions, those of the least hash of node and position."""
    place = np.arange(COORDINATES, dtype=np.uint64)
    with np.errstate(over="ignore"):
        order = mix(mix(nodes)[:, None] + place * _M2)
        at = np.argpartition(order, count - 1, axis=1)[:, :count] if count < COORDINATES else np.broadcast_to(place.astype(int), order.shape)
        got = np.take_along_axis(tokens, at, 1).astype(np.uint64)
        return mix(mix(nodes[:, None] + (at.astype(np.uint64) + np.uint64(1)) * _M1) + got)


def _branches(nodes: pd.Series, sketches: pd.Series, count: int) -> pd.Series:
    tokens = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, COORDINATES)
    own = nodes.to_numpy(np.int64).view(np.uint64)
    return pd.Series([c for a in range(0, len(tokens), 1024) for c in children(own[a : a + 1024], tokens[a : a + 1024], count).view(np.int64)])


def groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal keys in rows sorted by them, across batches."""
    rest = None
    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        change = np.zeros(len(pdf), bool)
        for c in by:
            v = pdf[c].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.nonzero(change)[0], len(pdf)]
        for a, b in zip(cuts[:-2], cuts[1:-1]):
            yield pdf.iloc[a:b]
        rest = pdf.iloc[cuts[-2] :].reset_index(drop=True)
    if rest is not None:
        yield rest


def first_of_each(linked: np.ndarray) -> np.ndarray:
    """Least index of each index's connected component of a symmetric boolean matrix."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(1))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _alike(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: int, similarity: float) -> np.ndarray:
    """Whether sketches agree in enough places and the sizes allow the similarity."""
    out = np.zeros((len(a), len(b)), bool)
    for i in range(0, len(a), 64):
        out[i : i + 64] = (a[i : i + 64, None, :] == b[None, :, :]).sum(2, dtype=np.uint8 if COORDINATES < 256 else np.uint16) >= least
        own = na[i : i + 64, None]
        out[i : i + 64] &= np.minimum(own, nb) >= similarity * np.maximum(own, nb) - 1e-9
    return out


def _stars(sketches: np.ndarray, n: np.ndarray, least: int, similarity: float) -> np.ndarray:
    """Least index of each record's candidate component; one comparison with the first record settles a bucket of copies of it."""
    if len(n) > 2 and _alike(sketches[:1], sketches[1:], n[:1], n[1:], least, similarity).all():
        return np.zeros(len(n), int)
    return first_of_each(_alike(sketches, sketches, n, n, least, similarity))


def _compare(batches: Iterator[pd.DataFrame], least: int, similarity: float) -> Iterator[pd.DataFrame]:
    """Star edges of the candidate components inside each bucket."""
    us, vs = [], []
    for g in groups(batches, ["node", "x", "y"]):
        if len(g) < 2:
            continue
        s = np.frombuffer(b"".join(g["small"]), np.uint8).reshape(len(g), -1)
        cid = g["cid"].to_numpy()
        label = _stars(s, g["n"].to_numpy(np.int32), least, similarity)
        for i in np.nonzero(label != np.arange(len(g)))[0]:
            us.append(cid[label[i]]), vs.append(cid[i])
        if len(us) > 5000:
            yield pd.DataFrame({"u": us, "v": vs})
            us, vs = [], []
    yield pd.DataFrame({"u": us, "v": vs})


#: Up to so many edges the minima of their ends are broadcast; beyond that both sides of a join are plain shuffles, which AQE splits
#: where one end has very many edges.
FEW_EDGES = 50_000


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for all nodes of the edges (u, v), by alternating large and small stars; minima are partial aggregates."""
    e = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    n, seen = e.count(), None

    def with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(least) if n <= FEW_EDGES else cut(least), "u")

    while n:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = with_least(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        if n > FEW_EDGES:
            e = cut(e)
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = with_least(e, low).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u != v").distinct()
        e = cut(e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        n, seen = now[0], now
    return e.select(F.col("u").alias("v"), F.col("v").alias("label")).unionByName(e.select("v", F.col("v").alias("label")).distinct())


def exact_links(sets: list[np.ndarray], similarity: float, split: int | None = None) -> np.ndarray:
    """Boolean matrix of links; with ``split`` only between rows before and after it."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    if m == 2:
        both = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]] * 2)
        both = np.maximum(both, both.T)
    else:
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(m), size)
        order = np.argsort(flat, kind="stable")
        flat, row = flat[order], row[order]
        start = np.nonzero(np.r_[True, flat[1:] != flat[:-1]])[0]
        count = np.diff(np.r_[start, len(flat)])
        token = np.repeat(np.arange(len(start)), count)
        both = np.zeros((m, m), np.float32)
        common = count > 8
        # frequent tokens by matrix product, some thousand at a time
        ids = np.nonzero(common)[0]
        slot = np.full(len(start), -1)
        for a in range(0, len(ids), 2048):
            part = ids[a : a + 2048]
            slot[:] = -1
            slot[part] = np.arange(len(part))
            at = slot[token]
            x = np.zeros((m, len(part)), np.float32)
            x[row[at >= 0], at[at >= 0]] = 1
            both += x @ x.T
        # rare ones by their pairs of rows, grouped by how many rows have them
        for c in np.unique(count[~common & (count > 1)]):
            at = start[(count == c) & ~common]
            for a in range(0, len(at), max(1, 4_000_000 // int(c * c))):
                r = row[at[a : a + max(1, 4_000_000 // int(c * c))][:, None] + np.arange(c)]
                i, j = np.triu_indices(int(c), 1)
                both += np.bincount((r[:, i] * m + r[:, j]).ravel(), minlength=m * m).reshape(m, m)
        both = np.maximum(both, both.T)
    union = size[:, None] + size[None, :] - both
    linked = both >= similarity * union - 1e-6
    np.fill_diagonal(linked, False)
    if split is not None:
        linked[:split, :split] = False
        linked[split:, split:] = False
    return linked


def _count_links(batches: Iterator[pd.DataFrame], similarity: float) -> Iterator[pd.DataFrame]:
    out = []
    for g in groups(batches, ["comp", "x", "y"]):
        g = g.drop_duplicates("cid").sort_values(["blk", "cid"], kind="stable")  # equal rows bring their set twice
        sets = [np.frombuffer(b, np.uint64) for b in g["items"]]
        x, y = g["x"].iloc[0], g["y"].iloc[0]
        split = int((g["blk"] == x).sum()) if x != y else None
        linked = exact_links(sets, similarity, split)
        label = first_of_each(linked)
        cid = g["cid"].to_numpy()
        out.append(pd.DataFrame({"cid": cid, "texts": linked.sum(1), "docs": linked @ g["size"].to_numpy(), "star": cid[label], "blocks": g["blocks"].to_numpy()}))
        if sum(map(len, out)) > 5000:
            yield pd.concat(out)
            out = []
    if out:
        yield pd.concat(out)


def _sorted_by(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys)


def _pairs_of_blocks(n: Column, name: Column) -> Column:
    """(own block, x, y) for a record: with each block once, x <= y."""
    own = F.pmod(F.xxhash64(name), n)
    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda j: F.struct(own.alias("blk"), F.least(own, j).alias("x"), F.greatest(own, j).alias("y")))


def miss(root: int, below: int, splits: int, similarity: float) -> float:
    """Probability that a pair at the threshold shares no bucket after so many splits of every bucket that it shares: the mean
    over the number k of positions at which its sketches agree, as sampled positions are drawn without replacement."""
    n, log = COORDINATES, lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    out = 0.0
    for k in range(n + 1):
        drawn = lambda c: [(j, math.exp(log(k, j) + log(n - k, c - j) - log(n, c))) for j in range(max(0, c - n + k), min(c, k) + 1)]
        lost, every = 0.0, drawn(below)
        for _ in range(splits):
            lost = sum(p * lost**j for j, p in every)
        share = math.exp(log(n, k) + k * math.log(similarity) + (n - k) * math.log1p(-similarity))
        out += share * sum(p * lost**j for j, p in drawn(root))
    return out


@functools.lru_cache(maxsize=8)
def effort(recall: float, splits: int, similarity: float) -> tuple[int, int]:
    """(root, below): how many positions the root and a node below it sample; the least root, then the least below (at most 6),
    that keep the recall over all splits."""
    for root in range(1, COORDINATES + 1):
        for below in range(2, 7):
            if miss(root, below, splits, similarity) <= 1 - recall:
                return root, below
    return COORDINATES, 6


def candidates(classes: DataFrame, similarity: float, recall: float, bucket: int, depth: int, block: int) -> DataFrame:
    """Connected groups (v, label) of classes that share leaves of the chosen-path recursion and have like sketches."""
    _, below = effort(recall, max(0, depth - 1), similarity)
    slack = similarity - 4.3 * math.sqrt(similarity * (1 - similarity) / COORDINATES)
    least = math.floor(slack * COORDINATES)
    branch = F.pandas_udf(lambda nodes, sketches: _branches(nodes, sketches, below), "array<long>")
    star = lambda df: df.repartition("node", "x", "y").sortWithinPartitions("node", "x", "y").mapInPandas(lambda b: _compare(b, least, similarity), "u binary, v binary")
    zero = F.lit(0).cast("long")
    own = classes.where(F.col("small").isNotNull())
    level = own.select("cid", F.explode("nodes").alias("node"))
    edges = []
    for d in range(depth):
        # At the root each record is its own star; below it, a bucket of which all have matched one leader is connected already.
        stars = [F.min("star").alias("lo"), F.max("star").alias("hi")] if d else []
        sizes = level.groupBy("node").agg(F.count("*").alias("count"), *stars).where("count > 1 AND lo != hi" if d else "count > 1").select("node", "count")
        held = level.join(sizes, "node")
        held = cut(held if d else held.join(own.select("cid", "n", "small"), "cid")).select("node", "count", "cid", "n", "small")
        edges.append(cut(star(held.where(F.col("count") <= bucket).select("node", zero.alias("x"), zero.alias("y"), "cid", "n", "small"))))
        heavy = held.where(F.col("count") > bucket)
        if heavy.isEmpty():
            break
        lead = broadcast_if_small(cut(heavy.groupBy("node").agg(F.min(F.struct("cid", "n", "small")).alias("lead"))))
        met = _near(least, similarity)(F.col("small"), F.col("lead.small"), F.col("n"), F.col("lead.n"))
        heavy = cut(heavy.join(lead, "node").select("node", "count", "cid", "n", "small", F.col("lead.cid").alias("lead"), met.alias("met")))
        edges.append(heavy.where("met").select(F.col("lead").alias("u"), F.col("cid").alias("v")))
        open_ = cut(heavy.groupBy("node").agg(F.min("met").alias("all")).where("NOT all").select("node"))
        heavy = heavy.join(broadcast_if_small(open_), "node").withColumn("star", F.when(F.col("met"), F.col("lead")).otherwise(F.col("cid")))
        if d + 1 < depth:
            level = cut(heavy.select("cid", "star", "n", "small", F.explode(branch(F.col("node"), F.col("small"))).alias("node")))
            continue
        # The last level: buckets that are not connected yet, in pairs of blocks.
        known = components(_union(edges))
        marked = cut(heavy.join(known.withColumnRenamed("v", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid")))
        mixed = marked.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("node")
        n = F.ceil(F.col("count") / block).cast("long")
        rest = marked.join(mixed, "node").withColumn("p", F.explode(_pairs_of_blocks(n, F.col("cid")))).select("node", "p.x", "p.y", "cid", "n", "small")
        edges.append(cut(star(rest)))
    return components(_union(edges))


def _near(least: int, similarity: float):
    def near(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
        return pd.Series(((x == y).sum(1) >= least) & (np.minimum(na, nb) >= similarity * np.maximum(na, nb) - 1e-9))

    return F.pandas_udf(near, "boolean")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = 0.99999, bucket: int = 2048, depth: int = 4, block: int = 800, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id, a, b (digests of its text), class_id (least id of its group), n_links (other rows of the
    wanted similarity, copies included), n_text_links (other distinct sets of that similarity), n_copies (rows of the same set)."""
    bounded_batches(docs.sparkSession)
    t = text_or_empty(text_col)
    digest = [F.xxhash64(t).alias("a"), F.xxhash64(F.lit("k"), t).alias("b")]
    root, _ = effort(recall, max(0, depth - 1), similarity)
    profiled = F.pandas_udf(lambda s: profile(s, root), "cid binary, n int, small binary, nodes array<long>")
    seen = docs.select(F.col(id_col).alias("id"), *digest, profiled(t).alias("p"))
    seen = cut(seen.select("id", "a", "b", "p.cid", "p.n", "p.small", "p.nodes"))
    rows = seen.select("id", "a", "b", "cid")
    classes = seen.groupBy("cid").agg(F.count("*").alias("size"), F.min("id").alias("least"), F.min(F.struct("id", "a", "b")).alias("rep"), F.first("n").alias("n"), F.first("small").alias("small"), F.first("nodes").alias("nodes"))
    classes = cut(classes)
    found = cut(candidates(classes, similarity, recall, bucket, depth, block))
    # All pairs within each candidate group, from the sets.
    members = found.groupBy("label").agg(F.count("*").alias("m"))
    members = found.join(members, "label").select(F.col("label").alias("comp"), F.col("v").alias("cid"), F.ceil(F.col("m") / block).cast("long").alias("blocks"))
    members = cut(members.join(classes.select("cid", "size", "rep"), "cid").select("comp", "cid", "blocks", "size", "rep.id", "rep.a", "rep.b"))
    items = F.pandas_udf(lambda s: s.map(lambda x: shingles(x).tobytes()), "binary")
    source = docs.select(F.col(id_col).alias("_id"), *digest, t.alias("_t"))
    small = broadcast_if_small(members)
    same = (source["a"] == members["a"]) & (source["b"] == members["b"]) & source["_id"].eqNullSafe(members["id"])
    sets = source.join(small, same).select("comp", "cid", "blocks", "size", "_t")
    sets = sets.withColumn("items", items("_t")).drop("_t").withColumn("p", F.explode(_pairs_of_blocks(F.col("blocks"), F.col("cid"))))
    sets = sets.select("comp", "p.x", "p.y", "p.blk", "cid", "size", "blocks", "items")
    counted = cut(_sorted_by(sets, ["comp", "x", "y"]).mapInPandas(lambda b: _count_links(b, similarity), "cid binary, texts long, docs long, star binary, blocks long"))
    links = counted.groupBy("cid").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"), F.min("star").alias("star"), F.max("blocks").alias("blocks"))
    joined = components(counted.where("blocks > 1").select(F.col("star").alias("u"), F.col("cid").alias("v"))).withColumnRenamed("v", "cid")
    links = links.join(joined, "cid", "left").withColumn("star", F.coalesce("label", F.when(F.col("blocks") > 1, F.col("cid")).otherwise(F.col("star")))).drop("label", "blocks")
    out = classes.select("cid", "size", "least").join(links, "cid", "left").withColumn("star", F.coalesce("star", "cid"))
    least = out.groupBy("star").agg(F.min("least").alias("class_id"))
    out = out.join(least, "star").select("cid", "class_id", (F.coalesce("docs", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_text_links"), F.col("size").alias("n_copies"))
    return rows.join(out, "cid").drop("cid")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents less those whose group has a row with a smaller (id, digests); of rows equal in both one stays. What goes is
    looked up in the documents, not what stays, as it is the smaller side."""
    found = cut(near_duplicates(docs, id_col=id_col, text_col=text_col, **options)).select("id", "a", "b", "class_id", "n_links")
    rows = found.groupBy("id", "a", "b", "class_id").agg(F.count("*").alias("n"), F.max("n_links").alias("n_links"))
    linked = cut(rows.where("n_links > 0"))
    first = linked.groupBy("class_id").agg(F.min(F.struct("id", "a", "b")).alias("k")).select("class_id", "k")
    marked = linked.join(first, "class_id").select("id", "a", "b", "n", F.struct("id", "a", "b").eqNullSafe(F.col("k")).alias("stays"))
    i, a, b = fresh(docs, "_i", "_a", "_b")
    named = lambda df: df.select(F.col("id").alias(i), F.col("a").alias(a), F.col("b").alias(b))
    t = text_or_empty(text_col)
    same = lambda: (F.xxhash64(t) == F.col(a)) & (F.xxhash64(F.lit("k"), t) == F.col(b)) & F.col(id_col).eqNullSafe(F.col(i))
    kept = docs.join(broadcast_if_small(cut(named(marked.where("NOT stays")))), same(), "left_anti")
    twins = cut(named(marked.where("stays AND n > 1")))
    if twins.isEmpty():
        return kept
    twins = broadcast_if_small(twins)
    return kept.join(twins, same(), "left_anti").unionByName(kept.join(twins, same()).dropDuplicates([id_col, a, b]).drop(i, a, b))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_text_links", "n_copies")
