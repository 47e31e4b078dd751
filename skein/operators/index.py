"""The stored index: postings and corpus figures are written once, searches read only what their terms need, and hash
differences keep it up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.store import folder_of

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Query terms up to this number are filtered by value in the scan of the postings; more of them are joined.
PUSHED_TERMS = 200
#: Query terms (with their weights) are broadcast up to this number.
SMALL = 100_000


class Index:
    """Tables of a stored index: postings (term, id, grp, tf, dl) sorted by term, terms (grp, term, df), sizes (grp, n, avgdl,
    mean), docs (grp, id), and vectors (id, v, grp) where they were given. Rows of terms and sizes whose grp is null hold for the whole corpus."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("postings", "terms", "sizes", "docs", "vectors"):
            return self.spark.read.parquet(f"{self.folder}/{name}")
        raise AttributeError(name)


def build(docs: DataFrame, folder: str, id_col: str = "id", text_col: str = "content", group_col: str | None = "project_id") -> Index:
    """Full rebuild in one shuffle: term counts are combined before it, as a document is in one task; it deals postings by term and id, so
    hot terms are split, and every file is sorted by term, so that a search skips what its terms do not need."""
    index = Index(docs.sparkSession, folder)
    grp = F.coalesce(F.col(group_col).cast("long"), F.lit(-1)) if group_col else F.lit(0).cast("long")  # documents of no group are one of their own
    t = docs.select(F.col(id_col).alias("id"), grp.alias("grp"), tokens(F.coalesce(text_col, F.lit(""))).alias("t"))
    t.select("grp", "id", F.size("t").alias("dl")).write.mode("overwrite").parquet(f"{folder}/docs")
    post = t.select("id", "grp", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("id", "grp", "dl", "term").agg(F.count("*").alias("tf"))
    post.sortWithinPartitions("term", "id").select("term", "id", "grp", "tf", "dl").write.mode("overwrite").parquet(f"{folder}/postings")
    df = index.postings.groupBy("grp", "term").agg(F.count("*").alias("df"))
    df.groupingSets([["grp", "term"], ["term"]], "grp", "term").agg(F.sum("df").alias("df")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/terms")
    sizes = index.docs.groupingSets([["grp"], []], "grp").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    raw = index.terms.join(F.broadcast(sizes.withColumnRenamed("grp", "g")), F.col("grp").eqNullSafe(F.col("g")))  # a row a group
    mean = raw.groupBy("g").agg(F.avg(raw_idf(F.col("n"), F.col("df"))).alias("mean")).withColumnRenamed("g", "m")
    sizes.join(F.broadcast(mean), F.col("grp").eqNullSafe(F.col("m")), "left").drop("m").coalesce(1).write.mode("overwrite").parquet(f"{folder}/sizes")
    return index


def raw_idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def build_vectors(vectors: DataFrame, folder: str) -> Index:
    """The vector side (id, v, grp), as the embedder gave it; a search scans it whole, so it is only written."""
    vectors.select("id", "v", "grp").write.mode("overwrite").parquet(f"{folder}/vectors")
    return Index(vectors.sparkSession, folder)


_BUILT: set[str] = set()


def index_of(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Index:
    """The index of a corpus, built at the first use in an application and read from storage afterwards."""
    return _kept(spark, "index", sf_dir, lambda folder: build(docs, folder))


def vectors_of(spark: SparkSession, sf_dir: str, vectors: DataFrame) -> DataFrame:
    """The vectors of a corpus (id, v, grp), embedded and stored at the first use."""
    return _kept(spark, "vectors", sf_dir, lambda folder: build_vectors(vectors, folder)).vectors


def _kept(spark: SparkSession, name: str, sf_dir: str, make) -> Index:
    folder = folder_of(spark, name, sf_dir)
    if folder not in _BUILT:
        make(folder)
        _BUILT.add(folder)
    return Index(spark, folder)


def lexical(index: Index, queries: DataFrame, k: int = 5, grouped: bool = False) -> DataFrame:
    """BM25: (query_id, id, score, rank) for queries (query_id, q), with ``grouped`` (query_id, q, grp), which search their own
    group with its own figures. Documents without a query term score 0 and fill up short lists by id."""
    by = ["grp"] if grouped else []
    own = lambda df: df.where("grp IS NOT NULL") if grouped else df.where("grp IS NULL").drop("grp")
    words = queries.select("query_id", *by, F.explode(tokens(F.col("q"))).alias("term")).groupBy("query_id", *by, "term").agg(F.count("*").alias("qtf"))
    named = words.select("term").distinct()
    few = [r["term"] for r in named.limit(PUSHED_TERMS + 1).collect()]
    wanted = lambda df: df.where(F.col("term").isin(few)) if len(few) <= PUSHED_TERMS else df
    idf = F.when(raw_idf(F.col("n"), F.col("df")) < 0, EPSILON * F.col("mean")).otherwise(raw_idf(F.col("n"), F.col("df")))
    sizes = own(index.sizes)
    known = own(wanted(index.terms))
    known = known.join(F.broadcast(sizes), "grp") if grouped else known.crossJoin(F.broadcast(sizes))  # a row a group
    known = words.join(known.select(*by, "term", "avgdl", idf.alias("idf")), [*by, "term"])
    known = F.broadcast(known) if known.limit(SMALL + 1).count() <= SMALL else known
    one = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hits = wanted(index.postings)
    parts = (hits if grouped else hits.drop("grp")).join(known, [*by, "term"]).select("query_id", "id", one.alias("s"))
    if grouped:
        first = index.docs.withColumn("n", F.row_number().over(Window.partitionBy("grp").orderBy("id"))).where(F.col("n") <= 2 * k).select("grp", "id")
        fill = queries.select("query_id", "grp").join(F.broadcast(first), "grp").select("query_id", "id")  # 2k rows a group
    else:
        fill = queries.select("query_id").crossJoin(F.broadcast(index.docs.select("id").orderBy("id").limit(2 * k)))
    scored = parts.unionByName(fill.withColumn("s", F.lit(0.0))).groupBy("query_id", "id").agg(F.round(F.sum("s"), 6).alias("score"))
    return top_k(scored, k)


def top_k(scored: DataFrame, k: int, ascending: bool = False) -> DataFrame:
    order = F.asc("score") if ascending else F.desc("score")
    w = Window.partitionBy("query_id").orderBy(order, "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def reranked(rows: DataFrame, keep: Column, out: str = "rank") -> DataFrame:
    """The rows that stay, with their ranks (query_id, rank) closed up."""
    return rows.where(keep).withColumn(out, F.row_number().over(Window.partitionBy("query_id").orderBy(out)))


def fuse(semantic: DataFrame, lex: DataFrame, k: int, semantic_weight: float = 0.6, smooth: int = 60) -> DataFrame:
    """Weighted reciprocal ranks of two lists (query_id, id, key, rank): rows of one key add up, and the key stands for its first row,
    the semantic list before the lexical one. Rows of the lexical list whose text the semantic list lacks are marked so."""
    a = semantic.select("query_id", "id", "key", "rank", F.lit(0).alias("list"), F.lit(semantic_weight).alias("w"))
    b = lex.select("query_id", "id", "key", "rank", F.lit(1).alias("list"), F.lit(1 - semantic_weight).alias("w"))
    g = a.unionByName(b).groupBy("query_id", "key").agg(F.round(F.sum(F.col("w") / (smooth + F.col("rank"))), 8).alias("rrf"), F.min(F.struct("list", "rank", "id")).alias("first"))
    g = g.withColumn("rrf_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), "first"))).where(F.col("rrf_rank") <= k)
    return g.select("query_id", F.col("first.id").alias("id"), F.when(F.col("first.list") == 0, "semantic").otherwise("Lexical Search (BM25)").alias("origin"), "rrf", "rrf_rank")


def hybrid(semantic: DataFrame, lex: DataFrame, docs: DataFrame, k: int, inactive: DataFrame, only: DataFrame | None = None, semantic_weight: float = 0.6) -> DataFrame:
    """One hybrid search over candidate lists (query_id, id, rank) of 2 * max(5k, 20): inactive documents go, then those that
    ``only`` (query_id, id) does not name, lists close up and are fused by the first 500 characters of the text."""
    text = docs.select("id", F.md5(F.substring("content", 1, 500).cast("binary")).alias("key"))

    def kept(rows: DataFrame) -> DataFrame:
        rows = rows.select("query_id", "id", "rank").join(inactive.select("id"), "id", "left_anti")
        if only is not None:
            rows = rows.join(only.select("query_id", "id"), ["query_id", "id"], "left_semi")
        return reranked(rows.join(text, "id"), F.lit(True))

    return fuse(kept(semantic), kept(lex), k, semantic_weight)


def candidate_k(k: int) -> int:
    return 2 * max(5 * k, 20)


def apply_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """The chunk table after a difference (document_id, idx, content_hash, chunk_version): deleted chunks go, updated ones count
    their version up, added ones begin at 1, unchanged ones stay."""
    j = old.select("document_id", "idx", F.col("content_hash").alias("was"), "chunk_version").join(new.select("document_id", "idx", F.col("content_hash").alias("now")), ["document_id", "idx"], "full_outer")
    version = F.when(F.col("was").isNull(), 1).when(F.col("was") == F.col("now"), F.col("chunk_version")).otherwise(F.col("chunk_version") + 1)
    return j.where("now IS NOT NULL").select("document_id", "idx", F.col("now").alias("content_hash"), version.cast("int").alias("chunk_version"))


def rerank(rows: DataFrame, scorer=None, k: int = 5, q: str = "q", text: str = "text") -> DataFrame:
    """The first k rows of each query by ``scorer`` (a column function of question and text, such as a Pandas function around a
    model); without one, by the rank that they have. A null score sorts last."""
    order = [F.desc_nulls_last("_score"), F.asc("rank")] if scorer else [F.asc("rank")]
    scored = rows.withColumn("_score", scorer(F.col(q), F.col(text)) if scorer else F.lit(None))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "id"))
    return scored.withColumn("new_rank", n).where(F.col("new_rank") <= k).drop("_score")
