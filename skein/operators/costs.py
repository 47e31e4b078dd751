"""Cost control: a cache by likeness of questions, its eviction, the spending breaker, and what a call passes before and after."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_words
from ..plans import query
from ..sources.tables import questions, table
from .analytics import _SPEND, _usage, spend
from .classify import model_tier

THRESHOLD, TTL_S, MOST = 0.75, 3600, 500
HOURLY, DAILY, COOLDOWN_S = 5.0, 50.0, 300
#: The model of each tier.
MODELS = {"simple": "gemini-1.5-flash", "standard": "gemini-1.5-pro", "complex": "gemini-ultra"}


def tfidf(texts: DataFrame) -> DataFrame:
    """(id, term, w) of texts (id, text): share of the text's words times ln((N + 1) / (df + 1)) + 1, of unit length."""
    n = texts.agg(F.count("*").alias("n"))
    t = texts.select("id", blank_words(F.lower("text")).alias("ws")).select("id", F.size("ws").alias("len"), F.explode("ws").alias("term"))
    tf = t.groupBy("id", "len", "term").agg(F.count("*").alias("c"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))  # one row
    w = tf.join(df, "term").select("id", "term", (F.col("c") / F.col("len") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)).alias("w"), "df")
    norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("w"), "df")


def alike(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, sim) for pairs a < b of texts (id, text), equal ones not repeated, of cosine at or above the threshold. Exact, and
    without comparing all: with terms in order of rarity, two such texts share one of the terms that come before what is left of
    a text is shorter than the threshold. So only those prefixes are joined, and common words, which stand last, join nothing."""
    v = tfidf(texts)
    left = Window.partitionBy("id").orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = F.sqrt(F.sum(F.col("w") * F.col("w")).over(left))  # length of the text from here on, this term included
    prefix = v.withColumn("rest", rest).where(F.col("rest") >= threshold - 1e-9).select("id", "term")
    pairs = prefix.select(F.col("id").alias("a"), "term").join(prefix.select(F.col("id").alias("b"), "term"), "term").where("a < b").select("a", "b").distinct()
    sim = pairs.join(v.select(F.col("id").alias("a"), "term", F.col("w").alias("x")), "a").join(v.select(F.col("id").alias("b"), "term", F.col("w").alias("y")), ["b", "term"])
    return sim.groupBy("a", "b").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("sim")).where(F.col("sim") >= threshold)


def cache_lookup(asked: DataFrame, entries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, entry, sim): for each question (id, text) the most alike entry (id, text) at or above the threshold; ties to the least id.
    Equal texts are compared once."""
    texts = asked.select("text").unionByName(entries.select("text")).distinct().select(F.xxhash64("text").alias("id"), "text")
    near = alike(texts, threshold)
    near = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")).unionByName(texts.where(F.size(blank_words(F.col("text"))) > 0).select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("sim")))
    held = entries.groupBy(F.xxhash64("text").alias("b")).agg(F.min("id").alias("entry"))
    best = near.join(held, "b").groupBy("a").agg(F.min(F.struct((-F.col("sim")).alias("o"), "entry")).alias("x"))
    return asked.select("id", F.xxhash64("text").alias("a")).join(best, "a").select("id", F.col("x.entry").alias("entry"), (-F.col("x.o")).alias("sim"))


def evict(entries: DataFrame, most: int = MOST) -> DataFrame:
    """The entries (id, hits, ts) that stay: the most used, then the latest."""
    return entries.orderBy(F.desc("hits"), F.desc("ts"), F.desc("id")).limit(most)


def breaker(calls: DataFrame, hourly: float = HOURLY, daily: float = DAILY, cooldown: int = COOLDOWN_S) -> DataFrame:
    """Adds decision to calls (id, user_id, t, h, d), with their spend of the last hour and day, themselves included. A call over a
    limit opens the breaker; while it is open calls are degraded; the first one after the cooldown is a probe, which closes it
    unless it is over a limit itself. As every breach restarts the cooldown, the last breach and the call before decide."""
    w = Window.partitionBy("user_id").orderBy(F.asc_nulls_last("t"), F.asc_nulls_last("id"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    over = (F.round("h", 3) > hourly) | (F.round("d", 3) > daily)
    c = calls.withColumn("over", over).withColumn("open", F.max(F.when(F.col("over"), F.col("t"))).over(before)).withColumn("was_t", F.lag("t").over(w)).withColumn("was_over", F.lag("over").over(w))
    closed = ~F.col("was_over") & (F.col("was_t") - F.col("open") >= cooldown)
    decision = F.when(F.col("open").isNull() | closed, "normal").when(F.col("t") - F.col("open") >= cooldown, "half_open_probe").otherwise("degraded")
    return c.withColumn("decision", decision).drop("over", "open", "was_t", "was_over")


def pre_call(asked: DataFrame, cached: DataFrame) -> DataFrame:
    """(id, source, tier, model) of questions (id, text): a cache hit, or the model that the router picks."""
    m = asked.join(cached.select("id", "entry"), "id", "left").withColumn("m", model_tier(F.col("text")))
    models = F.create_map(*[F.lit(x) for kv in MODELS.items() for x in kv])
    hit = F.col("entry").isNotNull()
    return m.select("id", F.when(hit, "cache").otherwise("llm").alias("source"), F.when(~hit, F.col("m.tier")).alias("tier"), F.when(~hit, F.element_at(models, F.col("m.tier"))).alias("model"))


def _asked(spark, d):
    q = questions(spark, d).select(F.col("qid").alias("id"), F.col("q").alias("text")).where(F.col("text").isNotNull())
    return q.where("id % 2 = 1").withColumn("text", F.concat("text", F.lit(" please"))), q


_TF = r"""aq AS (SELECT qid, q || ' please' AS q FROM {questions} WHERE qid % 2 = 1 AND q IS NOT NULL), x AS (SELECT q AS text FROM {questions} WHERE q IS NOT NULL UNION SELECT q FROM aq), tw AS (SELECT text, list_filter(string_split_regex(lower(text), '[ \t\r\n]+'), lambda w: w <> '') AS ws FROM x),
tc AS (SELECT text, term, count(*) / CAST(any_value(n) AS DOUBLE) AS tf FROM (SELECT text, len(ws) AS n, unnest(ws) AS term FROM tw) GROUP BY text, term),
td AS (SELECT term, ln(((SELECT count(*) FROM x) + 1.0) / (count(*) + 1)) + 1 AS idf FROM tc GROUP BY term),
tv AS (SELECT text, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY text)) AS w FROM tc JOIN td USING (term)),
ts AS (SELECT a, b, CASE WHEN a = b THEN 1.0 ELSE round(dot, 6) END AS sim FROM (SELECT a.text AS a, b.text AS b, sum(a.w * b.w) AS dot FROM tv a JOIN tv b USING (term) GROUP BY a.text, b.text)),
en AS (SELECT q AS text, min(qid) AS entry FROM {questions} WHERE q IS NOT NULL GROUP BY 1),
hit AS (SELECT q.qid AS id, entry, sim FROM aq q JOIN ts ON ts.a = q.q JOIN en ON en.text = ts.b WHERE sim >= 0.75 QUALIFY row_number() OVER (PARTITION BY q.qid ORDER BY sim DESC, entry) = 1)"""


@query(f"WITH {_TF} SELECT id, entry, round(sim, 4) AS sim FROM hit")
def semantic_cache_lookup(spark, sf_dir):
    """Odd questions, asked again with a word more, against all questions as the cache."""
    return cache_lookup(*_asked(spark, sf_dir)).withColumn("sim", F.round("sim", 4))


@query("SELECT user_id AS id, hits, ts FROM (SELECT user_id, count(*) AS hits, max(ts) AS ts FROM events GROUP BY 1) ORDER BY hits DESC, ts DESC, id DESC LIMIT 500")
def cache_eviction(spark, sf_dir):
    return evict(table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("hits"), F.max("ts").alias("ts")))


@query(_SPEND + ", o AS (SELECT *, round(h, 3) > 5 OR round(d, 3) > 12 AS over FROM w), b AS (SELECT *, max(CASE WHEN over THEN t END) OVER (PARTITION BY user_id ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS op, lag(t) OVER (PARTITION BY user_id ORDER BY t, id) AS wt, lag(over) OVER (PARTITION BY user_id ORDER BY t, id) AS wo FROM o) SELECT id, CASE WHEN op IS NULL OR (NOT wo AND wt - op >= 7200) THEN 'normal' WHEN t - op >= 7200 THEN 'half_open_probe' ELSE 'degraded' END AS decision FROM b")
def breaker_decisions(spark, sf_dir):
    """Limits and cooldown that the fixture reaches: 5 an hour, 12 a day, two hours."""
    return breaker(spend(_usage(spark, sf_dir)), 5.0, 12.0, 7200).select("id", "decision")


def _tier_sql() -> str:
    """The router's SQL over the asked texts."""
    from ..plans import ORACLES
    from ..sources.tables import MODEL_SQL

    return ORACLES["model_tiers"].replace(MODEL_SQL["questions"], "aq")


@query(f"WITH {_TF}, mt AS ({_tier_sql()}) SELECT q.qid AS id, CASE WHEN entry IS NULL THEN 'llm' ELSE 'cache' END AS source, CASE WHEN entry IS NULL THEN tier END AS tier, CASE WHEN entry IS NULL THEN CASE tier WHEN 'simple' THEN 'gemini-1.5-flash' WHEN 'standard' THEN 'gemini-1.5-pro' ELSE 'gemini-ultra' END END AS model FROM aq q LEFT JOIN hit ON hit.id = q.qid JOIN mt ON mt.qid = q.qid")
def cost_pre_call(spark, sf_dir):
    asked, entries = _asked(spark, sf_dir)
    return pre_call(asked, cache_lookup(asked, entries))
