"""Retrieval: lexical and vector top-k, reciprocal-rank fusion, filters and joins around them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import english_stop_words, long_tokens
from ..plans import query
from ..sources.store import cut
from ..sources.tables import document, table
from .index import Index, apply_delta, build, candidate_k, hybrid, index_of, lexical, top_k, vectors_of

def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 2048, by: str | None = None) -> DataFrame:
    """(query_id, id, score = squared L2 distance, rank). Exact. Queries (query_id, v) go out in blocks of bounded size, one scan of
    the vectors a block; every task keeps k candidates a query over all its batches, so only those are shuffled. With ``by``, a
    long column of both sides, a query sees vectors of its own group only, in the same scan."""
    spark = vectors.sparkSession
    kinds = dict(queries.dtypes)

    def scan(rows):
        names, groups = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
        sent = spark.sparkContext.broadcast((names, np.array([r[1] for r in rows], float), groups))

        def run(batches):
            names, q, groups = sent.value
            dist, best = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
            for pdf in batches:
                if not len(pdf):
                    continue
                x, own, of = np.array(pdf["v"].tolist(), float), pdf["id"].to_numpy(), pdf["of"].to_numpy()
                for i in range(0, len(q), 256):
                    p = q[i : i + 256]
                    d = np.round(np.maximum((p**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * p @ x.T, 0), 6)
                    d[groups[i : i + 256, None] != of[None, :]] = np.inf
                    every = np.concatenate([dist[i : i + 256], d], 1)
                    ids = np.concatenate([best[i : i + 256], np.broadcast_to(own, d.shape)], 1)
                    keep = np.lexsort((ids, every), axis=1)[:, :k]
                    dist[i : i + 256], best[i : i + 256] = np.take_along_axis(every, keep, 1), np.take_along_axis(ids, keep, 1)
            row, col = np.nonzero(np.isfinite(dist))
            yield pd.DataFrame({"query_id": names[row], "id": best[row, col], "score": dist[row, col]})

        slim = vectors.select("id", "v", (F.col(by) if by else F.lit(0)).cast("long").alias("of"))
        return slim.mapInPandas(run, f"query_id {kinds['query_id']}, id long, score double")

    out, rows = None, []
    for r in queries.select("query_id", "v", (F.col(by) if by else F.lit(0)).cast("long").alias("of")).toLocalIterator():
        rows.append(tuple(r))
        if len(rows) == block:
            out, rows = scan(rows) if out is None else out.unionByName(scan(rows)), []
    if rows:
        out = scan(rows) if out is None else out.unionByName(scan(rows))
    if out is None:
        out = queries.select("query_id", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("score")).where("false")
    return top_k(out, k, ascending=True)


def rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """Weighted fusion of (query_id, list, key, rank, weight): weights are normalised over the lists of a query (null ones make all
    its lists equal); ties by key."""
    own = F.when(F.count_if(F.col("weight").isNull()).over(Window.partitionBy("query_id")) > 0, 1.0).otherwise(F.col("weight"))
    lists = lists.withColumn("weight", own)
    weights = lists.groupBy("query_id", "list").agg(F.max("weight").alias("w"))
    total = weights.groupBy("query_id").agg(F.sum("w").alias("total"))
    part = lists.join(total, "query_id").groupBy("query_id", "key").agg(F.round(F.sum(F.col("weight") / F.col("total") / (k + F.col("rank"))), 8).alias("rrf"))
    return part.withColumn("rrf_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), "key")))


def tfidf_cosine(pairs: DataFrame, a: str, b: str, keys: list[str], stop_words: tuple[str, ...] | None = None, digits: int = 4) -> DataFrame:
    """Cosine of each pair (keys, a, b) with TF-IDF fitted on those two texts: idf = ln(3 / (1 + df)) + 1. No join: the
    pair is in one row, so sums over its own terms suffice. Rounded once."""
    ta, tb = (long_tokens(F.coalesce(c, F.lit("")), stop_words) for c in (a, b))
    rows = pairs.select(*keys, F.explode_outer(F.concat(F.transform(ta, lambda t: F.struct(t.alias("t"), F.lit(1).alias("x"), F.lit(0).alias("y"))), F.transform(tb, lambda t: F.struct(t.alias("t"), F.lit(0).alias("x"), F.lit(1).alias("y"))))).alias("p"))
    tf = rows.groupBy(*keys, "p.t").agg(F.sum("p.x").alias("x"), F.sum("p.y").alias("y"))
    idf = F.log(F.lit(3.0) / (1 + (F.col("x") > 0).cast("int") + (F.col("y") > 0).cast("int"))) + 1
    s = tf.withColumn("i", idf * idf).groupBy(*keys).agg(F.sum(F.col("i") * F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("i") * F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("i") * F.col("y") * F.col("y")).alias("yy"))
    return s.select(*keys, F.round(F.coalesce(F.try_divide("xy", F.sqrt("xx") * F.sqrt("yy")), F.lit(0.0)), digits).alias("sim"))


def tfidf_against(texts: DataFrame, by: list[str], member: str, text: str, base: int = 0, stop_words: tuple[str, ...] | None = None, digits: int = 4, most: int | None = None) -> DataFrame:
    """(by, member, sim) of each text with the base text (member = base) of its list, TF-IDF fitted on the whole list, the base
    included: idf = ln((1 + n) / (1 + df)) + 1. With ``most``, only the most frequent terms of a list count (ties by term)."""
    t = texts.select(*by, member, long_tokens(F.coalesce(text, F.lit("")), stop_words).alias("t"))
    size = texts.groupBy(*by).agg(F.count("*").alias("n"))
    tf = t.select(*by, member, F.explode("t").alias("term")).groupBy(*by, member, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy(*by, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("all"), F.max(F.when(F.col(member) == base, F.col("tf"))).alias("base_tf"))
    if most:
        n = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("all"), "term"))
        df = df.withColumn("place", n).where(F.col("place") <= most).drop("place")
    idf = df.join(size, by).select(*by, "term", "base_tf", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("i"))
    w = tf.join(idf, [*by, "term"]).withColumn("w", F.col("tf") * F.col("i"))
    s = w.groupBy(*by, member).agg(F.sum(F.col("w") * F.col("base_tf") * F.col("i")).alias("xy"), F.sum(F.col("w") * F.col("w")).alias("xx"))
    own = s.where(F.col(member) == base).select(*by, F.col("xx").alias("yy"))
    sims = s.join(own, by).select(*by, member, F.try_divide("xy", F.sqrt("xx") * F.sqrt("yy")).alias("sim"))
    return texts.where(F.col(member) != base).select(*by, member).join(sims, [*by, member], "left").withColumn("sim", F.round(F.coalesce("sim", F.lit(0.0)), digits))


def with_back_off(rows: DataFrame, match: Column, by: str = "query_id") -> DataFrame:
    """Keeps matching rows of each query; a query that none of its rows match keeps all."""
    m = F.coalesce(match, F.lit(False))
    return rows.withColumn("_m", m).withColumn("_any", F.max("_m").over(Window.partitionBy(by))).where("_m OR NOT _any").drop("_m", "_any")


def apply_constraints(rows: DataFrame, excluded: Column, sources: Column, kinds: Column, text: str = "text", source: str = "source") -> DataFrame:
    """Hard constraints of each query on its rows, from array columns of lower-case terms. Rows that hold an excluded term go; each
    source term (in source or text), then each kind (in the source), in order, keeps what it matches unless that is nothing. A query whose rows would
    all go keeps them as they were. The list of a query is folded as one array of bit masks, so no term costs a shuffle."""
    low, src = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(source, F.lit("")))
    flags = F.struct(
        (~F.exists(excluded, lambda e: low.contains(e))).alias("ok"), F.transform(sources, lambda e: src.contains(e) | low.contains(e)).alias("s"), F.transform(kinds, lambda e: src.contains(e)).alias("k"),
    )
    rows = rows.withColumn("_f", flags).withColumn("_f", F.struct(F.col("_f.ok").alias("ok"), F.concat("_f.s", "_f.k").alias("terms")))
    every = rows.groupBy("query_id").agg(F.collect_list("_f").alias("_all"))  # a retrieved list is as short as top-k makes it

    def keep(kept, i):
        some = F.exists(kept, lambda x: F.get(x["terms"], i))
        return F.when(some, F.filter(kept, lambda x: F.get(x["terms"], i))).otherwise(kept)

    left = F.filter("_all", lambda x: x["ok"])
    n = F.size(F.get("_all", F.lit(0))["terms"])
    left = F.aggregate(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)")), left, keep)
    every = every.select("query_id", left.alias("_left"))
    rows = rows.join(every, "query_id").where((F.size("_left") == 0) | F.array_contains("_left", F.col("_f")))
    return rows.drop("_f", "_left")


_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')"


def bm25_sql(asked: str = "(SELECT item_id AS query_id, text FROM benchmark)", k: int = 5) -> str:
    """CTEs that end in ``lex`` (query_id, id, score, rank) for a relation (query_id, text)."""
    return rf"""
t AS (SELECT doc_id, {_TOK} AS w FROM documents),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t) GROUP BY ALL),
s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
i AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, s GROUP BY term),
m AS (SELECT avg(raw) AS mean FROM i),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TOK}) AS term FROM {asked}) GROUP BY ALL),
h AS (SELECT query_id, doc_id AS id, round(sum(qtf * (CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM p JOIN q USING (term) JOIN i USING (term), m, s GROUP BY ALL),
z AS (SELECT * FROM h UNION ALL SELECT query_id, d.doc_id, 0.0 FROM {asked} a, (SELECT doc_id FROM documents ORDER BY doc_id LIMIT {2 * k}) d WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = a.query_id AND h.id = d.doc_id)),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM z QUALIFY rank <= {k})"""


_BM25 = bm25_sql()


def _items(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))


def _index(spark, d) -> Index:
    return index_of(spark, d, document(spark, d))


@query(f"WITH {_BM25} SELECT query_id, id, score, rank FROM lex")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical(_index(spark, sf_dir), _items(spark, sf_dir))


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY term")
def bm25_term_stats(spark, sf_dir):
    return _index(spark, sf_dir).terms.where("grp IS NULL").select("term", "df")


_VEC = """
q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE vec_id % 100 = 0),
dist AS (SELECT query_id, vec_id AS id, round(list_sum(list_transform(range(1, len(a) + 1), lambda j: (a[j] - CAST(embedding[j] AS DOUBLE)) * (a[j] - CAST(embedding[j] AS DOUBLE)))), 6) AS score FROM q, embeddings),
vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM dist QUALIFY rank <= 5)"""


def _vectors(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return v, v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "v")


@query(f"WITH {_VEC} SELECT query_id, id, round(score, 4) AS score, rank FROM vec")
def vector_topk_l2(spark, sf_dir):
    return vector_top_k(*_vectors(spark, sf_dir)).withColumn("score", F.round("score", 4))


def unit(v: Column) -> Column:
    """The vector over its length; the zero vector as it is."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)))


@query("""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE vec_id % 100 = 0),
dist AS (SELECT query_id, vec_id AS id, round(2 - 2 * list_cosine_similarity(a, CAST(embedding AS DOUBLE[])), 6) AS score FROM q, embeddings),
vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM dist QUALIFY rank <= 5) SELECT query_id, id, round(1 - score / 2, 4) AS cosine, rank FROM vec""")
def vector_topk_cosine(spark, sf_dir):
    """By cosine: squared distance of unit vectors is 2 - 2 cos, so the same scan serves."""
    v, q = _vectors(spark, sf_dir)
    got = vector_top_k(v.withColumn("v", unit(F.col("v"))), q.withColumn("v", unit(F.col("v"))))
    return got.select("query_id", "id", F.round(1 - F.col("score") / 2, 4).alias("cosine"), "rank")


@query(f"""WITH {_VEC} SELECT query_id, CAST(id AS BIGINT) AS id, rank FROM (SELECT query_id, vec_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM (SELECT query_id, dist.id AS vec_id, score FROM dist WHERE dist.id % 4 = query_id % 4)) WHERE rank <= 5""")
def project_isolation(spark, sf_dir):
    """Only rows of the query's own project are searched, for all projects in one scan."""
    v, q = _vectors(spark, sf_dir)
    return vector_top_k(v.withColumn("p", F.col("id") % 4), q.withColumn("p", F.col("query_id") % 4), by="p").select("query_id", "id", "rank")


_DOC_VEC = """dv AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS a, project_id AS grp FROM embeddings JOIN {document} d ON d.id = vec_id),
qv AS (SELECT item_id AS query_id, CAST(embedding AS DOUBLE[]) AS b, item_id % 4 AS grp FROM benchmark JOIN embeddings ON vec_id = item_id),
sd AS (SELECT query_id, dv.id, round(list_sum(list_transform(range(1, len(a) + 1), lambda j: (a[j] - b[j]) * (a[j] - b[j]))), 6) AS score FROM qv JOIN dv USING (grp)),
sem AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM sd QUALIFY rank <= 50)"""


def embedded(spark, d) -> tuple[DataFrame, DataFrame]:
    """Vectors of documents (id, v, grp) and of items (query_id, v, grp): the given embeddings stand for a model's. An embedder is
    any column function, such as a Pandas function around a model, that makes ``v`` from a text."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    docs = document(spark, d).select("id", F.col("project_id").cast("long").alias("grp"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 4).alias("grp"))
    return docs.join(e, F.col("id") == F.col("vec_id")).drop("vec_id"), items.join(e, F.col("query_id") == F.col("vec_id")).drop("vec_id")


def _semantic(spark, d, k: int) -> DataFrame:
    docs, items = embedded(spark, d)
    return vector_top_k(vectors_of(spark, d, docs), items, k, by="grp")


def _grouped_items(spark, d):
    return _items(spark, d).withColumn("grp", F.col("query_id") % 4)


_TOKC = "regexp_extract_all(lower(coalesce(content, '')), '[\\p{L}\\p{N}_]+')"
_LEXG = rf"""
gt AS (SELECT id, project_id AS grp, {_TOKC} AS w FROM {{document}}),
gp AS (SELECT id, grp, dl, term, count(*) AS tf FROM (SELECT id, grp, len(w) AS dl, unnest(w) AS term FROM gt) GROUP BY ALL),
gs AS (SELECT grp, count(*) AS n, avg(len(w)) AS avgdl FROM gt GROUP BY grp),
gi AS (SELECT grp, term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM gp JOIN gs USING (grp) GROUP BY grp, term),
gm AS (SELECT grp, avg(raw) AS mean FROM gi GROUP BY grp),
gq AS (SELECT query_id, grp, term, count(*) AS qtf FROM (SELECT item_id AS query_id, item_id % 4 AS grp, unnest({_TOK}) AS term FROM benchmark) GROUP BY ALL),
gh AS (SELECT query_id, id, round(sum(qtf * (CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM gp JOIN gq USING (grp, term) JOIN gi USING (grp, term) JOIN gm USING (grp) JOIN gs USING (grp) GROUP BY ALL),
gf AS (SELECT id, project_id AS grp FROM {{document}} QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY id) <= 100),
gz AS (SELECT * FROM gh UNION ALL SELECT item_id, gf.id, 0.0 FROM benchmark JOIN gf ON grp = item_id % 4 WHERE NOT EXISTS (SELECT 1 FROM gh WHERE gh.query_id = item_id AND gh.id = gf.id)),
lexg AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM gz QUALIFY rank <= 50)"""
_HYBRID = f"""WITH {_DOC_VEC}, {_LEXG},
act AS (SELECT id, md5(substr(content, 1, 500)) AS key FROM {{document}} WHERE is_active),
sl AS (SELECT query_id, id, key, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, 0 AS list, 0.6 AS w FROM sem JOIN act USING (id)),
ll AS (SELECT query_id, id, key, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, 1 AS list, 0.4 AS w FROM lexg JOIN act USING (id)),
fu AS (SELECT query_id, key, round(sum(w / (60 + rank)), 8) AS rrf, min((list, rank, id)) AS first FROM (SELECT * FROM sl UNION ALL SELECT * FROM ll) GROUP BY ALL),
hy AS (SELECT query_id, first[3] AS id, CASE WHEN first[1] = 0 THEN 'semantic' ELSE 'Lexical Search (BM25)' END AS origin, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first) AS rrf_rank FROM fu QUALIFY rrf_rank <= 5)"""


def hybrid_lists(spark, d, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Candidate lists of every item in its own project: by vector and by words."""
    return cut(_semantic(spark, d, candidate_k(k))), cut(lexical(_index(spark, d), _grouped_items(spark, d), candidate_k(k), grouped=True))


@query(f"{_HYBRID} SELECT query_id, CAST(id AS BIGINT) AS id, origin, rrf, rrf_rank FROM hy")
def hybrid_search(spark, sf_dir):
    """The whole search: vectors and words of the item's project, inactive documents out, lists fused, the first five."""
    d = document(spark, sf_dir)
    return hybrid(*hybrid_lists(spark, sf_dir), d, 5, d.where("NOT is_active").select("id"))


@query(f"""{_HYBRID.replace("FROM sem JOIN act USING (id)", "FROM sem JOIN act USING (id) JOIN {document} dd USING (id) WHERE filename LIKE '%.md' OR filename LIKE '%.txt'").replace("FROM lexg JOIN act USING (id)", "FROM lexg JOIN act USING (id) JOIN {document} dd USING (id) WHERE filename LIKE '%.md' OR filename LIKE '%.txt'")} SELECT query_id, CAST(id AS BIGINT) AS id, rrf_rank FROM hy""")
def hybrid_search_filtered(spark, sf_dir):
    """The search within a set of sources: candidates of other sources go before the fusion."""
    d = document(spark, sf_dir)
    sem, lex = hybrid_lists(spark, sf_dir)
    wanted = d.where("filename LIKE '%.md' OR filename LIKE '%.txt'").select("id")
    only = sem.select("query_id", "id").unionByName(lex.select("query_id", "id")).join(wanted, "id", "left_semi")
    return hybrid(sem, lex, d, 5, d.where("NOT is_active").select("id"), only).select("query_id", "id", "rrf_rank")


_RRF = """
l AS (SELECT query_id, 'lex' AS list, id AS key, rank, 0.4 AS weight FROM lexg UNION ALL SELECT query_id, 'sem', id, rank, 0.6 FROM sem),
tot AS (SELECT query_id, sum(w) AS total FROM (SELECT query_id, list, max(weight) AS w FROM l GROUP BY ALL) GROUP BY query_id),
f AS (SELECT query_id, key, round(sum(weight / total / (60 + rank)), 8) AS rrf FROM l JOIN tot USING (query_id) GROUP BY ALL)"""


@query(f"WITH {_DOC_VEC}, {_LEXG}, {_RRF} SELECT query_id, key, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, key) AS rrf_rank FROM f")
def rrf_weighted(spark, sf_dir):
    sem, lex = hybrid_lists(spark, sf_dir)
    one = lambda df, name, w: df.select("query_id", F.lit(name).alias("list"), F.col("id").alias("key"), "rank", F.lit(w).alias("weight"))
    return rrf(one(lex, "lex", 0.4).unionByName(one(sem, "sem", 0.6)))


@query(f"WITH {_BM25}, d AS (SELECT id FROM {{document}} WHERE is_active) SELECT query_id, lex.id, score FROM lex JOIN d ON lex.id = d.id")
def inactive_anti_join(spark, sf_dir):
    gone = document(spark, sf_dir).where("NOT is_active").select("id")
    return bm25_topk(spark, sf_dir).join(gone, "id", "left_anti").select("query_id", "id", "score")


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM documents a WHERE a.doc_id % 10 <> 9 AND a.text = d.text)")
def content_semi_join(spark, sf_dir):
    """Texts that also stand in an active document: by hash first, then by text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2("text", 256).alias("h"))
    active = d.where("doc_id % 10 <> 9").select("h").distinct()  # sha-256 stands for the text
    return d.join(active, "h", "left_semi").select("doc_id")


_PAIRS = f"WITH {_BM25}, c AS (SELECT query_id, id, rank, b.text AS a, d.text AS b FROM lex JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = id)"
_STOP = "(" + ", ".join(f"'{w}'" for w in english_stop_words()) + ")"
_LONG = r"list_filter(regexp_extract_all(lower(coalesce(@, '')), '[\p{L}\p{N}_]+'), lambda w: length(w) >= 2 AND w NOT IN " + _STOP + ")"


def words_sql(column: str) -> str:
    return _LONG.replace("@", column)


_TFIDF = f""", tk AS (SELECT query_id, id, t, sum(x) AS x, sum(y) AS y FROM (
  SELECT query_id, id, unnest({words_sql('a')}) AS t, 1 AS x, 0 AS y FROM c UNION ALL SELECT query_id, id, unnest({words_sql('b')}), 0, 1 FROM c) GROUP BY ALL),
sim AS (SELECT query_id, id, round(coalesce(sum(i * x * y) / nullif(sqrt(sum(i * x * x)) * sqrt(sum(i * y * y)), 0), 0.0), 4) AS sim FROM (SELECT *, pow(ln(3.0 / (1 + CAST(x > 0 AS INT) + CAST(y > 0 AS INT))) + 1, 2) AS i FROM tk) GROUP BY ALL)"""


def against_sql(texts: str, by: str, most: int | None = None) -> str:
    """CTEs that end in ``sims`` (by, member, sim) from a CTE ``texts`` (by, member, text) whose member 0 is the base."""
    cut = f"QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY sum(tf) DESC, term) <= {most}" if most else ""
    return f"""ltf AS (SELECT {by}, member, term, count(*) AS tf FROM (SELECT {by}, member, unnest({words_sql('text')}) AS term FROM {texts}) GROUP BY ALL),
lsz AS (SELECT {by}, count(*) AS n FROM {texts} GROUP BY ALL),
ldf AS (SELECT {by}, term, count(*) AS df, max(CASE WHEN member = 0 THEN tf END) AS btf FROM ltf GROUP BY {by}, term {cut}),
lw AS (SELECT {by}, member, tf * (ln((1.0 + n) / (1 + df)) + 1) AS w, btf * (ln((1.0 + n) / (1 + df)) + 1) AS bw FROM ltf JOIN ldf USING ({by}, term) JOIN lsz USING ({by})),
lsum AS (SELECT {by}, member, sum(w * bw) AS xy, sum(w * w) AS xx FROM lw GROUP BY ALL),
sims AS (SELECT t.{by}, t.member, round(coalesce(s.xy / nullif(sqrt(s.xx) * sqrt(o.xx), 0), 0.0), 4) AS sim FROM {texts} t LEFT JOIN lsum s ON s.{by} = t.{by} AND s.member = t.member LEFT JOIN lsum o ON o.{by} = t.{by} AND o.member = 0 WHERE t.member <> 0)"""


_LIST = "lst AS (SELECT query_id, rank AS member, b AS text FROM c UNION ALL SELECT item_id, 0, text FROM benchmark)"


def _retrieved(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("chunk"))
    return cut(bm25_topk(spark, d).join(docs, "id").join(_items(spark, d), "query_id"))


def with_base(rows: DataFrame, text: str, base: DataFrame) -> DataFrame:
    """Lists (query_id, member, text) of ranked rows, with each query's base text (query_id, text) as member 0."""
    return rows.select("query_id", F.col("rank").cast("int").alias("member"), F.col(text).alias("text")).unionByName(base.select("query_id", F.lit(0).alias("member"), "text"))


@query(_PAIRS + _TFIDF + " SELECT query_id, id, sim FROM sim")
def tfidf_answer_relevance(spark, sf_dir):
    return tfidf_cosine(_retrieved(spark, sf_dir), "q", "chunk", ["query_id", "id"])


@query(_PAIRS + f", {_LIST}, {against_sql('lst', 'query_id')}, r AS (SELECT *, max(sim) OVER (PARTITION BY query_id) AS best, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, member) AS n FROM sims) SELECT r.query_id, c.id, r.sim FROM r JOIN c ON c.query_id = r.query_id AND c.rank = r.member WHERE sim >= 0.1 OR (best < 0.1 AND n = 1)")
def tfidf_prune(spark, sf_dir):
    """Chunks at the threshold or above, TF-IDF fitted on the list and the question; the best one where none is."""
    rows = _retrieved(spark, sf_dir)
    sim = tfidf_against(with_base(rows, "chunk", _items(spark, sf_dir).withColumnRenamed("q", "text")), ["query_id"], "member", "text")
    w = Window.partitionBy("query_id")
    r = sim.withColumn("best", F.max("sim").over(w)).withColumn("n", F.row_number().over(w.orderBy(F.desc("sim"), "member"))).where("sim >= 0.1 OR (best < 0.1 AND n = 1)")
    return r.withColumnRenamed("member", "rank").join(rows.select("query_id", "rank", "id"), ["query_id", "rank"]).select("query_id", "id", "sim")


@query(f"WITH {_BM25}, ff AS (SELECT query_id, lex.id, filename FROM lex JOIN {{document}} d ON d.id = lex.id), mm AS (SELECT *, contains(filename, '.pdf') AS ok, bool_or(contains(filename, '.pdf')) OVER (PARTITION BY query_id) AS anyhit FROM ff) SELECT query_id, id, filename FROM mm WHERE ok OR NOT anyhit")
def constraint_apply_backoff(spark, sf_dir):
    rows = bm25_topk(spark, sf_dir).join(document(spark, sf_dir).select("id", "filename"), "id").select("query_id", "id", "filename")
    return with_back_off(rows, F.col("filename").contains(".pdf"))


@query(f"""WITH {_BM25}, ff AS (SELECT query_id, lex.id, lower(filename) AS src, lower(content) AS txt FROM lex JOIN {{document}} d ON d.id = lex.id),
ct AS (SELECT *, contains(txt, 'the ') AS ex, contains(src, 'src1') OR contains(txt, 'src1') AS s1, contains(src, 'de la') OR contains(txt, 'de la') AS s2, contains(src, 'pdf') AS k1 FROM ff),
c1 AS (SELECT * FROM ct WHERE NOT ex), c2 AS (SELECT * FROM c1 QUALIFY s1 OR NOT bool_or(s1) OVER (PARTITION BY query_id)), c3 AS (SELECT * FROM c2 QUALIFY s2 OR NOT bool_or(s2) OVER (PARTITION BY query_id)), c4 AS (SELECT * FROM c3 QUALIFY k1 OR NOT bool_or(k1) OVER (PARTITION BY query_id))
SELECT query_id, id FROM c4 UNION ALL SELECT query_id, id FROM ct WHERE query_id NOT IN (SELECT query_id FROM c4)""")
def constraints_applied(spark, sf_dir):
    """Exclusion, two source terms and a kind, each with its back-off, and the outer one."""
    rows = bm25_topk(spark, sf_dir).join(document(spark, sf_dir).select("id", F.col("filename").alias("source"), F.col("content").alias("text")), "id")
    names = lambda *x: F.array(*map(F.lit, x))
    return apply_constraints(rows, names("the "), names("src1", "de la"), names("pdf")).select("query_id", "id")


@query(f"WITH {_BM25}, u AS (SELECT query_id % 10 AS query_id, id AS key, rank FROM lex), g AS (SELECT query_id, key, round(sum(1.0 / (60 + rank)), 8) AS rrf FROM u GROUP BY ALL) SELECT query_id, key, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, key) AS rrf_rank FROM g")
def rrf_multi_query(spark, sf_dir):
    """Ranked lists of query variants (here: items with equal last digit) are fused with equal weights."""
    u = bm25_topk(spark, sf_dir).select((F.col("query_id") % 10).alias("query_id"), F.col("id").alias("key"), "rank")
    g = u.groupBy("query_id", "key").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 8).alias("rrf"))
    return g.withColumn("rrf_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), "key")))


@query(f"WITH {_BM25}, u AS (SELECT query_id % 10 AS g, query_id AS sub, rank, id, md5(d.text) AS h FROM lex JOIN documents d ON d.doc_id = id), f AS (SELECT g, h, min((sub, rank, id)) AS x FROM u GROUP BY ALL) SELECT g AS query_id, x[3] AS id, x[1] AS sub, row_number() OVER (PARTITION BY g ORDER BY x) AS place FROM f")
def subquery_union(spark, sf_dir):
    """Order-preserving union of sub-query results: each text at its first place in sub-query, then rank."""
    h = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("h"))
    u = bm25_topk(spark, sf_dir).join(h, "id").groupBy((F.col("query_id") % 10).alias("g"), "h").agg(F.min(F.struct(F.col("query_id").alias("sub"), "rank", "id")).alias("x"))
    place = F.row_number().over(Window.partitionBy("g").orderBy("x"))
    return u.select(F.col("g").alias("query_id"), "x.id", "x.sub", place.alias("place"))


def hybrid_merge(semantic: DataFrame, lexical: DataFrame, semantic_weight: float = 0.6, k: int = 60) -> DataFrame:
    """Semantic (query_id, key, rank, source) and lexical (query_id, key, rank) lists as one: keys of the lexical list alone are marked so."""
    s = semantic.select("query_id", "key", F.col("rank").alias("s_rank"), "source")
    j = s.join(lexical.select("query_id", "key", F.col("rank").alias("l_rank")), ["query_id", "key"], "full_outer")
    score = F.coalesce(semantic_weight / (k + F.col("s_rank")), F.lit(0.0)) + F.coalesce((1 - semantic_weight) / (k + F.col("l_rank")), F.lit(0.0))
    return j.select("query_id", "key", F.coalesce("source", F.lit("Lexical Search (BM25)")).alias("source"), F.round(score, 8).alias("rrf"))


@query(f"WITH {_DOC_VEC}, {_LEXG} SELECT query_id, coalesce(sem.id, lexg.id) AS key, CASE WHEN sem.id IS NULL THEN 'Lexical Search (BM25)' ELSE 'doc' END AS source, round(coalesce(0.6 / (60 + sem.rank), 0) + coalesce(0.4 / (60 + lexg.rank), 0), 8) AS rrf FROM sem FULL JOIN lexg USING (query_id, id)")
def hybrid_identity_join(spark, sf_dir):
    sem, lex = hybrid_lists(spark, sf_dir)
    return hybrid_merge(sem.withColumnRenamed("id", "key").withColumn("source", F.lit("doc")), lex.withColumnRenamed("id", "key"))


@query(f"SELECT project_id AS grp, term, count(*) AS df FROM (SELECT DISTINCT project_id, id, unnest({_TOKC}) AS term FROM {{document}} WHERE is_active) GROUP BY ALL")
def index_rebuild(spark, sf_dir):
    """Full rebuild after a soft delete: the stored index of the active documents, read back."""
    from ..sources.store import folder_of

    active = document(spark, sf_dir).where("is_active")
    return build(active, folder_of(spark, "rebuilt", sf_dir)).terms.where("grp IS NOT NULL").select("grp", "term", "df")


_CHUNKED = """n AS (SELECT id AS document_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS idx, md5(unnest(l)) AS now FROM (SELECT id, string_split(content, chr(10)) AS l FROM {document})),
o AS (SELECT document_id, idx, CASE WHEN document_id % 7 = 3 THEN md5(now) ELSE now END AS was, 1 + document_id % 3 AS v FROM n WHERE document_id % 5 <> 0 UNION ALL SELECT document_id, idx + 100000, now, 1 FROM n WHERE document_id % 11 = 0)"""


@query(f"WITH {_CHUNKED} SELECT document_id, idx, now AS content_hash, CAST(CASE WHEN was IS NULL THEN 1 WHEN was = now THEN v ELSE v + 1 END AS INT) AS chunk_version FROM n LEFT JOIN o USING (document_id, idx)")
def delta_apply(spark, sf_dir):
    """The chunk table after new versions of documents: lines are the chunks, a seventh of the old ones differ, some are gone."""
    new = document(spark, sf_dir).select(F.col("id").alias("document_id"), F.posexplode(F.split("content", "\n", -1)).alias("idx", "l")).select("document_id", F.col("idx").cast("long").alias("idx"), F.md5(F.col("l").cast("binary")).alias("content_hash"))
    was = F.when(F.col("document_id") % 7 == 3, F.md5(F.col("content_hash").cast("binary"))).otherwise(F.col("content_hash"))
    old = new.where("document_id % 5 <> 0").select("document_id", "idx", was.alias("content_hash"), (1 + F.col("document_id") % 3).cast("int").alias("chunk_version"))
    gone = new.where("document_id % 11 = 0").select("document_id", (F.col("idx") + 100000).alias("idx"), "content_hash", F.lit(1).alias("chunk_version"))
    return apply_delta(old.unionByName(gone), new)


@query("SELECT vec_id AS id, round(1 / (1 + list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS relevance, string_split(filename, '/')[-1] AS source FROM embeddings JOIN {document} d ON d.id = vec_id")
def score_normalise(spark, sf_dir):
    """How the inspector shows a hit: 1 / (1 + distance), here from the origin, and the last part of the source."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")).alias("d"))
    return e.join(document(spark, sf_dir), "id").select("id", F.round(1 / (1 + F.col("d")), 6).alias("relevance"), F.element_at(F.split("filename", "/"), -1).alias("source"))
