"""Telemetry analytics, catalogue operations and stateful windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from ..plans import query
from ..sources.tables import document, query_log, table, token_usage, turns
from .classify import PRICES, cost

#: Analytics never read the clock: the end of the period is a parameter.
AS_OF, DAYS = "2024-01-25", 14


def in_period(df: DataFrame, ts: str, as_of: str = AS_OF, days: int = DAYS) -> DataFrame:
    end = F.lit(as_of).cast("timestamp_ntz")
    return df.where((F.col(ts) >= end - F.expr(f"interval {days} days")) & (F.col(ts) < end))


#: Quality fields in the JSON of a log row.
RAGAS = ("context_relevance", "faithfulness", "answer_relevance", "groundedness", "overall_score")


def _ragas(key: str):
    return F.get_json_object("ragas_scores", f"$.{key}").cast("double")


def _trace(path: str):
    return F.get_json_object("pipeline_trace", f"$.{path}").cast("double")


def kpis(log: DataFrame) -> DataFrame:
    """Totals of a project: nulls are skipped, an empty period gives zeros. One pass; JSON fields are read in the same scan."""
    zero = lambda c, n: F.round(F.coalesce(c, F.lit(0.0)), 4).alias(n)
    shown = F.col("citations_shown") > 0
    return log.groupBy("project_id").agg(
        F.count("*").alias("queries"), zero(F.avg("latency_ms"), "avg_latency"), zero(F.avg("hallucination_score"), "hallucination"), *[zero(F.avg(_ragas(k)), k) for k in RAGAS],
        zero(F.avg(_trace("compression_stats.compression_ratio")), "compression_ratio"), zero(F.avg(_trace("prompt_cache_info.estimated_monthly_savings_usd")), "cache_savings"),
        zero(F.try_divide(F.sum(F.when(shown, F.col("citations_clicked"))), F.sum(F.when(shown, F.col("citations_shown")))), "engagement"), zero(F.avg(F.col("used_hybrid_search").cast("int")) * 100, "hybrid_rate"),
    )


_LOG = f"WITH l AS (SELECT * FROM {{query_log}} WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAY AND created_at < TIMESTAMP '{AS_OF}')"


_RAGAS_SQL = ", ".join(f"round(coalesce(avg({k}), 0), 4) AS {k}" for k in RAGAS)


@query(_LOG + f" SELECT project_id, count(*) AS queries, round(coalesce(avg(latency_ms), 0), 4) AS avg_latency, round(coalesce(avg(hallucination_score), 0), 4) AS hallucination, {_RAGAS_SQL}, round(coalesce(avg(compression_ratio), 0), 4) AS compression_ratio, round(coalesce(avg(cache_savings), 0), 4) AS cache_savings, round(coalesce(sum(CASE WHEN citations_shown > 0 THEN citations_clicked END) / CAST(nullif(sum(CASE WHEN citations_shown > 0 THEN citations_shown END), 0) AS DOUBLE), 0), 4) AS engagement, round(coalesce(avg(CASE WHEN used_hybrid_search THEN 1.0 ELSE 0.0 END) * 100, 0), 4) AS hybrid_rate FROM l GROUP BY project_id")
def analytics_kpis(spark, sf_dir):
    return kpis(in_period(query_log(spark, sf_dir), "created_at"))


@query(_LOG + " SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n, round(avg(latency_ms), 4) AS avg_latency FROM l GROUP BY 1")
def analytics_daily(spark, sf_dir):
    return in_period(query_log(spark, sf_dir), "created_at").groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 4).alias("avg_latency"))


@query(_LOG + " SELECT model_used, count(*) AS n, round(avg(latency_ms), 4) AS avg_latency FROM l GROUP BY 1")
def analytics_models(spark, sf_dir):
    return in_period(query_log(spark, sf_dir), "created_at").groupBy("model_used").agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 4).alias("avg_latency"))


def daily_quality(log: DataFrame) -> DataFrame:
    """Eight averages a day; a day without a value stays null."""
    each = {"hallucination": F.col("hallucination_score"), "faithfulness": F.col("faithfulness_score"), **{f"ragas_{k}": _ragas(k) for k in RAGAS}, "compression_ratio": _trace("compression_stats.compression_ratio")}
    return log.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(*[F.round(F.avg(c), 4).alias(f"avg_{n}") for n, c in each.items()])


@query(_LOG + " SELECT strftime(created_at, '%Y-%m-%d') AS day, round(avg(hallucination_score), 4) AS avg_hallucination, round(avg(faithfulness_score), 4) AS avg_faithfulness, " + ", ".join(f"round(avg({k}), 4) AS avg_ragas_{k}" for k in RAGAS) + ", round(avg(compression_ratio), 4) AS avg_compression_ratio FROM l GROUP BY 1")
def analytics_quality_daily(spark, sf_dir):
    return daily_quality(in_period(query_log(spark, sf_dir), "created_at"))


@query(_LOG + " SELECT project_id, round(avg(CASE WHEN answered THEN 1.0 ELSE 0.0 END) * 100, 4) AS success_rate, round(avg(attempts), 4) AS avg_attempts FROM l WHERE agentic GROUP BY 1")
def analytics_agentic(spark, sf_dir):
    j = lambda key, kind, default: F.coalesce(F.get_json_object("pipeline_trace", f"$.{key}").cast(kind), F.lit(default))
    a = in_period(query_log(spark, sf_dir), "created_at").where("get_json_object(pipeline_trace, '$.agentic') = 'true'")
    return a.groupBy("project_id").agg(F.round(F.avg(j("answered", "boolean", True).cast("int")) * 100, 4).alias("success_rate"), F.round(F.avg(j("attempts", "int", 1)), 4).alias("avg_attempts"))


@query(_LOG + " SELECT strategy, count(*) AS n FROM (SELECT unnest(strategies_tried[2:]) AS strategy FROM l) GROUP BY 1")
def analytics_fallbacks(spark, sf_dir):
    tried = F.from_json(F.get_json_object("pipeline_trace", "$.strategies_tried"), "array<string>")
    return in_period(query_log(spark, sf_dir), "created_at").select(F.explode(F.slice(tried, F.lit(2), F.greatest(F.size(tried), F.lit(0)))).alias("strategy")).groupBy("strategy").agg(F.count("*").alias("n"))


_PRICE_ROWS = ", ".join(f"('{p}', '{m}', {i}, {o})" for (p, m), (i, o) in PRICES.items())


@query(f"WITH u AS (SELECT user_id, strftime(timestamp, '%Y-%m-%d') AS day, t.model, input_tokens + output_tokens AS tok, coalesce(input_tokens / 1e6 * pin + output_tokens / 1e6 * pout, 0) AS cost FROM {{token_usage}} t LEFT JOIN (VALUES {_PRICE_ROWS}) p(provider, model, pin, pout) USING (provider, model)) SELECT user_id, day, model, count(*) AS requests, CAST(sum(tok) AS BIGINT) AS tokens, round(sum(cost), 9) AS cost FROM u GROUP BY GROUPING SETS ((user_id), (user_id, day), (user_id, model))")
def usage_summary_grouping_sets(spark, sf_dir):
    """Each user's totals, by day and by model, in one scan."""
    u = cost(token_usage(spark, sf_dir), None).withColumn("day", F.date_format("timestamp", "yyyy-MM-dd"))
    return u.groupingSets([["user_id"], ["user_id", "day"], ["user_id", "model"]], "user_id", "day", "model").agg(F.count("*").alias("requests"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.round(F.sum("cost"), 9).alias("cost"))


@query("SELECT project_id, id, filename FROM {document} WHERE is_active ORDER BY id DESC")
def list_documents(spark, sf_dir):
    return document(spark, sf_dir).where("is_active").select("project_id", "id", "filename").orderBy(F.desc("id"))


@query("SELECT id, filename, CAST((SELECT count(*) FROM {document}) AS BIGINT) AS total, CAST(greatest(1, ceil((SELECT count(*) FROM {document}) / 20.0)) AS BIGINT) AS pages FROM {document} ORDER BY id LIMIT 20 OFFSET 40")
def page_offset_limit(spark, sf_dir):
    """The third page of twenty, by id."""
    d = document(spark, sf_dir)
    n = d.agg(F.count("*").alias("total"))
    page = d.orderBy("id").offset(40).limit(20)
    return page.crossJoin(F.broadcast(n)).select("id", "filename", "total", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("total") / 20)).alias("pages"))


#: What a project without a configuration gets.
DEFAULTS = {"chunk_size": 1000, "chunk_overlap": 200, "top_k": 4, "use_hybrid_search": True, "semantic_weight": 0.6}


def latest_config(projects: DataFrame, configs: DataFrame) -> DataFrame:
    """The latest active configuration (id, project_id, is_active, top_k) of each project (project_id), or the default one (id -1)."""
    w = Window.partitionBy("project_id").orderBy(F.desc("id"))
    live = configs.where("is_active").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "is_active")
    return projects.join(live, "project_id", "left").withColumn("top_k", F.coalesce("top_k", F.lit(DEFAULTS["top_k"]))).select("project_id", F.coalesce("id", F.lit(-1)).alias("config_id"), "top_k")


@query("SELECT n_nationkey AS project_id, coalesce(config_id, -1) AS config_id, CAST(coalesce(top_k, 4) AS INT) AS top_k FROM nation LEFT JOIN (SELECT c_nationkey AS project_id, max(c_custkey) AS config_id, arg_max(c_custkey % 9 + 1, c_custkey) AS top_k FROM customer WHERE c_acctbal > 9000 GROUP BY 1) ON project_id = n_nationkey")
def config_latest(spark, sf_dir):
    """The latest active configuration of each project, the default one where there is none."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("project_id"), (F.col("c_acctbal") > 9000).alias("is_active"), (F.col("c_custkey") % 9 + 1).cast("int").alias("top_k"))
    return latest_config(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project_id")), c)


@query("SELECT c_custkey AS id, false AS is_active FROM customer UNION ALL SELECT c_custkey + 1000000, true FROM (SELECT max(c_custkey) AS c_custkey FROM customer GROUP BY c_nationkey)")
def config_new_version(spark, sf_dir):
    """Versioned insert: all rows are deactivated, a new active one is added for each project."""
    c = table(spark, sf_dir, "customer")
    new = c.groupBy("c_nationkey").agg(F.max("c_custkey").alias("k")).select((F.col("k") + 1000000).alias("id"), F.lit(True).alias("is_active"))
    return c.select(F.col("c_custkey").alias("id"), F.lit(False).alias("is_active")).unionByName(new)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'PATCHED' ELSE c_mktsegment END AS segment FROM customer")
def config_patch(spark, sf_dir):
    """Only fields that the patch sets change."""
    c = table(spark, sf_dir, "customer")
    patch = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lit("PATCHED").alias("new"))
    return c.select(F.col("c_custkey").alias("id"), "c_mktsegment").join(patch, "id", "left").select("id", F.coalesce("new", "c_mktsegment").alias("segment"))


def delete_projects(gone: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What stays of each table when projects (project_id) go: logs, configurations, chunks of their documents, documents, messages of
    their sessions, sessions, the projects themselves. Token usage stays."""
    own = lambda df: df.join(gone, "project_id", "left_anti")
    lost = lambda name, key: tables[name].join(gone, "project_id", "left_semi").select(F.col("id").alias(key))
    out = {n: own(tables[n]) for n in ("query_log", "config", "document", "session", "project") if n in tables}
    if "chunk" in tables:
        out["chunk"] = tables["chunk"].join(lost("document", "document_id"), "document_id", "left_anti")
    if "message" in tables:
        out["message"] = tables["message"].join(lost("session", "session_id"), "session_id", "left_anti")
    return out | ({"token_usage": tables["token_usage"]} if "token_usage" in tables else {})


def _tables(spark, d) -> dict[str, DataFrame]:
    t, docs = turns(spark, d), document(spark, d)
    return {
        "query_log": query_log(spark, d).select("id", "project_id"), "config": table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 4).alias("project_id")), "document": docs.select("id", "project_id"),
        "chunk": docs.select((F.col("id") * 10).alias("id"), F.col("id").alias("document_id")), "session": t.select(F.col("session_id").alias("id"), "project_id").distinct(), "message": t.select((F.col("session_id") * 1000 + F.col("turn")).alias("id"), "session_id"),
        "project": spark.range(4).select("id", F.col("id").alias("project_id")), "token_usage": token_usage(spark, d).select("id", "project_id"),
    }


_KEEP = "project_id NOT IN (1, 3)"


@query(f"""SELECT 'query_log' AS tab, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM {{query_log}} WHERE {_KEEP} UNION ALL SELECT 'config', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer WHERE c_custkey % 4 NOT IN (1, 3)
UNION ALL SELECT 'document', count(*), CAST(sum(id) AS BIGINT) FROM {{document}} WHERE {_KEEP} UNION ALL SELECT 'chunk', count(*), CAST(sum(id * 10) AS BIGINT) FROM {{document}} WHERE {_KEEP} UNION ALL SELECT 'session', count(*), CAST(sum(id) AS BIGINT) FROM (SELECT DISTINCT session_id AS id FROM {{turns}} WHERE {_KEEP})
UNION ALL SELECT 'message', count(*), CAST(sum(session_id * 1000 + turn) AS BIGINT) FROM {{turns}} WHERE {_KEEP} UNION ALL SELECT 'project', 2, 2 UNION ALL SELECT 'token_usage', count(*), CAST(sum(id) AS BIGINT) FROM {{token_usage}}""")
def cascade_delete(spark, sf_dir):
    """Rows and sum of ids that stay in every table when projects 1 and 3 go."""
    gone = F.broadcast(spark.createDataFrame([(1,), (3,)], "project_id long"))
    out = None
    for name, df in delete_projects(gone, _tables(spark, sf_dir)).items():
        one = df.agg(F.lit(name).alias("tab"), F.count("*").alias("n"), F.sum("id").alias("ids"))
        out = one if out is None else out.unionByName(one)
    return out


def rechunked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents (id, is_active, version, status) after requests (id, chunk_size, chunk_overlap): a valid request for an active document
    counts its version up and sets it pending; the others say why not."""
    fits = F.col("chunk_size").between(128, 8192) & F.col("chunk_overlap").between(0, 2048)
    j = docs.join(wanted, "id", "full_outer")
    answer = F.when(F.col("chunk_size").isNull(), None).when(F.col("is_active").isNull(), "404 document not found").when(~F.col("is_active"), "400 document is inactive").when(~fits, "422 size or overlap out of range").otherwise("reprocessing")
    j = j.withColumn("answer", answer)
    done = F.coalesce(F.col("answer") == "reprocessing", F.lit(False))
    return j.select("id", F.when(done, F.coalesce("version", F.lit(1)) + 1).otherwise(F.coalesce("version", F.lit(0))).alias("version"), F.when(done, "pending").otherwise(F.col("status")).alias("status"), "answer")


@query("""WITH d AS (SELECT id, is_active, CAST(id % 3 + 1 AS INT) AS version, CASE WHEN id % 8 = 0 THEN 'failed' ELSE 'completed' END AS status FROM {document}), w AS (SELECT p_partkey * 3 AS id, CAST(p_partkey % 9000 AS INT) AS s, CAST(p_partkey % 3 * 1024 AS INT) AS o FROM part),
j AS (SELECT *, CASE WHEN s IS NULL THEN NULL WHEN is_active IS NULL THEN '404 document not found' WHEN NOT is_active THEN '400 document is inactive' WHEN NOT (s BETWEEN 128 AND 8192 AND o BETWEEN 0 AND 2048) THEN '422 size or overlap out of range' ELSE 'reprocessing' END AS answer FROM d FULL JOIN w USING (id))
SELECT id, coalesce(CASE WHEN answer = 'reprocessing' THEN version + 1 ELSE version END, 0) AS version, CASE WHEN answer = 'reprocessing' THEN 'pending' ELSE status END AS status, answer FROM j""")
def rechunk_requests(spark, sf_dir):
    d = document(spark, sf_dir).select("id", "is_active", (F.col("id") % 3 + 1).cast("int").alias("version"), F.when(F.col("id") % 8 == 0, "failed").otherwise("completed").alias("status"))
    w = table(spark, sf_dir, "part").select((F.col("p_partkey") * 3).cast("long").alias("id"), (F.col("p_partkey") % 9000).cast("int").alias("chunk_size"), (F.col("p_partkey") % 3 * 1024).cast("int").alias("chunk_overlap"))
    return rechunked(d, w)


@query("SELECT id, filename, CASE WHEN id % 8 = 0 THEN 'failed' ELSE 'completed' END AS status FROM {document} WHERE id = 17")
def document_status(spark, sf_dir):
    """Point lookup: the filter reaches the scan."""
    return document(spark, sf_dir).where("id = 17").select("id", "filename", F.when(F.col("id") % 8 == 0, "failed").otherwise("completed").alias("status"))


@query("SELECT project_id, 'There are ' || count(*) || ' documents in this project.' AS answer FROM {document} GROUP BY 1")
def count_answers(spark, sf_dir):
    """How many documents a project has, as an answer from metadata."""
    return document(spark, sf_dir).groupBy("project_id").agg(F.count("*").alias("n")).select("project_id", F.concat(F.lit("There are "), "n", F.lit(" documents in this project.")).alias("answer"))


def own_sessions(said: DataFrame, user: DataFrame, project: int | None = None) -> DataFrame:
    """Sessions of users (session_id, user_id), newest first, of one project if named."""
    s = said.select("session_id", "project_id").distinct().join(user, "session_id")
    return (s if project is None else s.where(F.col("project_id") == project)).withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("session_id"))))


@query("SELECT user_id, session_id, row_number() OVER (PARTITION BY user_id ORDER BY session_id DESC) AS place FROM (SELECT DISTINCT session_id, session_id % 7 AS user_id FROM {turns} WHERE project_id = 2)")
def sessions_own(spark, sf_dir):
    t = turns(spark, sf_dir)
    return own_sessions(t, t.select("session_id", (F.col("session_id") % 7).alias("user_id")).distinct(), 2).select("user_id", "session_id", "place")


@query("SELECT session_id, count(*) AS n FROM {turns} WHERE NOT (session_id % 7 = 3 AND session_id % 5 = 0) GROUP BY 1")
def session_delete(spark, sf_dir):
    """A user deletes sessions: only own ones of the list go, with their messages."""
    t = turns(spark, sf_dir)
    listed = t.where("session_id % 5 = 0").select("session_id").distinct().where("session_id % 7 = 3")
    return t.join(listed, "session_id", "left_anti").groupBy("session_id").agg(F.count("*").alias("n"))


@query("SELECT u_id, tool FROM (SELECT c_custkey AS u_id, CASE WHEN c_custkey % 10 = 0 THEN 'admin' ELSE 'client' END AS role FROM customer) JOIN (VALUES ('admin', 'search_documents'), ('client', 'search_documents'), ('admin', 'get_active_rag_config'), ('admin', 'get_document_sources')) t(role, tool) USING (role)")
def tool_permissions(spark, sf_dir):
    from .tools import permissions

    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("u_id"), F.when(F.col("c_custkey") % 10 == 0, "admin").otherwise("client").alias("role"))
    return users.join(F.broadcast(permissions(spark)), "role").select("u_id", "tool")


@query("SELECT session_id, turn, content FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS n FROM {turns}) WHERE n <= 3")
def history_last_n(spark, sf_dir):
    w = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    return turns(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n <= 3").select("session_id", "turn", "content").orderBy("session_id", "turn")


def context_sessions(sessions: DataFrame, newest: int = 2, named: DataFrame | None = None) -> DataFrame:
    """(own, session_id): the sessions whose last messages go along with each one (session_id, project_id, user_id): the named ones
    (own, session_id) of the same user, else the newest others of its project. The newest of a project are one short list, one longer
    than asked for, as a session may be in it itself."""
    top = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("session_id")))
    newest_of = sessions.select("project_id", "session_id", top.alias("n")).where(F.col("n") <= newest + 1)
    own = sessions.select(F.col("session_id").alias("own"), "project_id", "user_id")
    if named is not None:
        wanted = named.where("own <> session_id").join(own, "own").join(sessions.select("session_id", F.col("user_id").alias("whose")), "session_id").where("user_id = whose").select("own", "session_id")
        own = own.join(named.select("own").distinct(), "own", "left_anti")
    p = own.join(F.broadcast(newest_of), "project_id").where("own <> session_id")  # a short list a project
    p = p.withColumn("k", F.row_number().over(Window.partitionBy("own").orderBy("n"))).where(F.col("k") <= newest).select("own", "session_id")
    return p if named is None else p.unionByName(wanted)


_SESSIONS = "s AS (SELECT DISTINCT project_id, session_id, session_id % 5 AS user_id FROM {turns}), e AS (SELECT session_id AS own, session_id + k AS other FROM s, (VALUES (0), (5), (7)) v(k) WHERE session_id % 4 = 1)"


@query(f"WITH {_SESSIONS}, p AS (SELECT a.session_id AS own, b.session_id AS other FROM s a JOIN s b ON a.project_id = b.project_id AND a.session_id <> b.session_id WHERE a.session_id % 4 <> 1 QUALIFY row_number() OVER (PARTITION BY a.session_id ORDER BY b.session_id DESC) <= 2 UNION ALL SELECT own, other FROM e JOIN s a ON a.session_id = own JOIN s b ON b.session_id = other WHERE own <> other AND a.user_id = b.user_id), m AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS k FROM {{turns}}) SELECT own, session_id, turn FROM p JOIN m ON m.session_id = other WHERE k <= 3")
def context_last3(spark, sf_dir):
    """The last three messages of the context sessions: a quarter of the sessions name theirs, the others take the two newest."""
    t = turns(spark, sf_dir)
    s = t.select("project_id", "session_id", (F.col("session_id") % 5).alias("user_id")).distinct()
    named = s.where("session_id % 4 = 1").select(F.col("session_id").alias("own"), F.explode(F.array(*[F.col("session_id") + k for k in (0, 5, 7)])).alias("session_id"))
    last = t.withColumn("k", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn")))).where("k <= 3")
    return context_sessions(s, 2, named).join(last, "session_id").select("own", "session_id", "turn")


_EPOCH = "CAST(epoch(timestamp) AS BIGINT)"
_SPEND = f"WITH u AS (SELECT id, user_id, {_EPOCH} AS t, input_tokens / 1000.0 AS c FROM {{token_usage}}), w AS (SELECT id, user_id, t, sum(c) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS h, sum(c) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS d FROM u)"


def spend(usage: DataFrame) -> DataFrame:
    """Sliding sums of an hour and a day for each user (older than the cutoff strictly)."""
    w = Window.partitionBy("user_id").orderBy("t")
    return usage.withColumn("h", F.sum("c").over(w.rangeBetween(-3599, 0))).withColumn("d", F.sum("c").over(w.rangeBetween(-86399, 0)))


def epoch_seconds(ts: Column, instant: bool = False) -> Column:
    """Seconds since 1970 of a wall-clock time in any session time zone, or of an instant: microseconds over a million as a double, to the
    nearest, halves to even. The double tells single microseconds apart until 2255 only; the SQL rounds the same one."""
    since = ts.cast("timestamp_ntz") - F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    part = lambda unit: F.extract(F.lit(unit), since)
    whole = part("DAY").cast("long") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60
    micros = F.unix_micros(ts) if instant else whole * 1000000 + (part("SECOND") * 1000000).cast("long")
    return F.rint(micros / F.lit(1e6)).cast("long")


def _usage(spark, d):
    u = token_usage(spark, d)
    t = epoch_seconds(F.col("timestamp"), u.schema["timestamp"].dataType == TimestampType())
    return u.select("id", "user_id", t.alias("t"), (F.col("input_tokens") / 1000.0).alias("c"))


@query(_SPEND + " SELECT id, CAST(round(h, 3) AS DOUBLE) AS hour, CAST(round(d, 3) AS DOUBLE) AS day FROM w")
def spend_windows(spark, sf_dir):
    return spend(_usage(spark, sf_dir)).select("id", F.round("h", 3).alias("hour"), F.round("d", 3).alias("day"))


@query(_SPEND + " SELECT id, CASE WHEN round(h, 3) >= 5 OR round(d, 3) >= 12 THEN 'degraded' ELSE 'ok' END AS decision FROM w")
def breaker_state(spark, sf_dir):
    """A breach of the hourly or daily limit downgrades the model rather than blocks the call."""
    s = spend(_usage(spark, sf_dir))
    return s.select("id", F.when((F.round("h", 3) >= 5) | (F.round("d", 3) >= 12), "degraded").otherwise("ok").alias("decision"))


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s.s")
def sessionize_30m(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("t", "30 minutes")).agg(F.min("ts").alias("start"), F.count("*").alias("n")).select("user_id", "start", "n")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY ALL")
def event_tumbling_hour(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query("WITH q AS (SELECT event_id, event_type, value, ts FROM events), h AS (SELECT a.event_type, count(*) AS n, CAST(count_if(hit) AS BIGINT) AS hits FROM (SELECT event_type, event_id, CAST(value AS BIGINT) AS k, coalesce(ts - lag(ts) OVER (PARTITION BY event_type, CAST(floor(value) AS BIGINT) ORDER BY ts, event_id) <= INTERVAL 1 HOUR, false) AS hit FROM events) a GROUP BY 1) SELECT event_type, n, hits, round(hits / CAST(n AS DOUBLE), 4) AS rate FROM h")
def cache_stats(spark, sf_dir):
    """Hits of a version-keyed cache (exact key, TTL of an hour since the last use) by kind of query."""
    w = Window.partitionBy("event_type", F.floor("value")).orderBy("ts", "event_id")
    hit = F.coalesce(F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 1 hour"), F.lit(False))
    e = table(spark, sf_dir, "events").select("event_type", hit.alias("hit"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")).withColumn("rate", F.round(F.col("hits") / F.col("n"), 4))


@query("SELECT user_id, CASE WHEN a > b + 0.02 THEN 'a' WHEN b > a + 0.02 THEN 'b' WHEN la < 0.85 * lb THEN 'a' WHEN lb < 0.85 * la THEN 'b' ELSE 'tie' END AS winner FROM (SELECT user_id, round(avg(faithfulness), 6) AS a, round(avg(answer_relevance), 6) AS b, round(avg(latency_ms), 6) AS la, round(max(latency_ms) / 2, 6) AS lb FROM {query_log} GROUP BY user_id)")
def winner_rule(spark, sf_dir):
    """Quality first (by more than 0.02), then latency (below 0.85 times)."""
    r = lambda key: F.round(F.avg(F.get_json_object("ragas_scores", f"$.{key}").cast("double")), 6)
    g = query_log(spark, sf_dir).groupBy("user_id").agg(r("faithfulness").alias("a"), r("answer_relevance").alias("b"), F.round(F.avg("latency_ms"), 6).alias("la"), F.round(F.max("latency_ms") / 2, 6).alias("lb"))
    return g.select("user_id", F.expr("CASE WHEN a > b + 0.02 THEN 'a' WHEN b > a + 0.02 THEN 'b' WHEN la < 0.85 * lb THEN 'a' WHEN lb < 0.85 * la THEN 'b' ELSE 'tie' END").alias("winner"))


@query("SELECT doc_id AS id, coalesce(n, 0) AS clicks FROM documents LEFT JOIN (SELECT user_id AS doc_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) USING (doc_id)")
def citation_clicks(spark, sf_dir):
    """Counter updates as a grouped count of click events; unknown ids do no harm."""
    n = table(spark, sf_dir, "events").where("event_type = 'click'").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("clicks"))


def stage_times(marks: DataFrame) -> DataFrame:
    """(trace, stage, status, us) from marks (trace, stage, kind, ts): microseconds from the first start to the last end, -1 without
    both; failed where an error stands, running without an end."""
    g = marks.groupBy("trace", "stage").agg(F.min(F.when(F.col("kind") == "start", F.col("ts"))).alias("a"), F.max(F.when(F.col("kind") != "start", F.col("ts"))).alias("b"), F.max((F.col("kind") == "error").cast("int")).alias("e"))
    us = F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))
    return g.select("trace", "stage", F.when(F.col("e") == 1, "failed").when(F.col("b").isNull(), "running").otherwise("completed").alias("status"), F.coalesce(us, F.lit(-1)).alias("us"))


_MARK = "(['start', 'end', 'error', 'start'])[event_id % 4 + 1]"


@query(f"WITH k AS (SELECT user_id AS trace, event_type AS stage, {_MARK} AS kind, ts FROM events), g AS (SELECT trace, stage, min(CASE WHEN kind = 'start' THEN ts END) AS a, max(CASE WHEN kind <> 'start' THEN ts END) AS b, max(CAST(kind = 'error' AS INT)) AS e FROM k GROUP BY ALL) SELECT trace, stage, CASE WHEN e = 1 THEN 'failed' WHEN b IS NULL THEN 'running' ELSE 'completed' END AS status, coalesce(epoch_us(b) - epoch_us(a), -1) AS us FROM g")
def pipeline_stages(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("start", "end", "error", "start"))), (F.col("event_id") % 4 + 1).cast("int"))
    return stage_times(table(spark, sf_dir, "events").select(F.col("user_id").alias("trace"), F.col("event_type").alias("stage"), kind.alias("kind"), "ts"))


@query("SELECT document_id, content_hash, row_number() OVER (PARTITION BY document_id ORDER BY pos) - 1 AS idx FROM (SELECT id AS document_id, md5(unnest(l)) AS content_hash, unnest(range(len(l))) * 3 + 7 AS pos FROM (SELECT id, string_split(content, chr(10)) AS l FROM {document}))")
def chunk_index_backfill(spark, sf_dir):
    """Chunks without an index get one by their id within the document."""
    c = document(spark, sf_dir).select(F.col("id").alias("document_id"), F.posexplode(F.split("content", "\n", -1)).alias("p", "l"))
    c = c.select("document_id", F.md5(F.col("l").cast("binary")).alias("content_hash"), (F.col("p") * 3 + 7).alias("pos"))
    return c.withColumn("idx", F.row_number().over(Window.partitionBy("document_id").orderBy("pos")) - 1).select("document_id", "content_hash", F.col("idx").cast("long").alias("idx"))


def context_hits(marks: DataFrame, ttl_s: int = 1800) -> DataFrame:
    """Session context cache: adds hit to lookups (key, id, ts, store): the newest store before is at most the time to live old. Uses do
    not prolong it."""
    w = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    stored = F.max(F.when(F.col("store"), F.col("ts"))).over(w)
    age = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(stored.cast("timestamp"))
    return marks.withColumn("hit", F.coalesce(age <= ttl_s * 1_000_000, F.lit(False))).where("NOT store").drop("store")


_STORES = "SELECT user_id AS key, event_id AS id, ts, event_type IN ('purchase', 'signup') AS store FROM events"


def _stores(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", F.col("event_type").isin("purchase", "signup").alias("store"))


@query(f"WITH e AS ({_STORES}), w AS (SELECT *, max(CASE WHEN store THEN ts END) OVER (PARTITION BY key ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stored FROM e) SELECT id, coalesce(ts - stored <= INTERVAL 30 MINUTE, false) AS hit FROM w WHERE NOT store")
def session_context_hits(spark, sf_dir):
    """Follow-up turns that find their session's chunks: purchases and signups store, the other events look up."""
    return context_hits(_stores(spark, sf_dir)).select("id", "hit")


def session_stats(stores: DataFrame, as_of: str, ttl_s: int = 1800) -> DataFrame:
    """One row: sessions (key, ts, chunks) that still hold context at a time, and their chunks; the newest store of a session counts."""
    t = F.lit(as_of).cast("timestamp_ntz")
    last = stores.where(F.col("ts") <= t).groupBy("key").agg(F.max_by("chunks", F.struct("ts", "id")).alias("chunks"), F.max("ts").alias("ts"))
    live = last.where(F.col("ts") >= t - F.expr(f"interval {ttl_s} seconds"))
    return live.agg(F.count("*").alias("active_sessions"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("total_cached_chunks"))


@query(f"WITH e AS ({_STORES}), l AS (SELECT key, max(ts) AS ts, arg_max(id % 5 + 1, (ts, id)) AS chunks FROM e WHERE store AND ts <= TIMESTAMP '{AS_OF}' GROUP BY 1) SELECT count(*) AS active_sessions, CAST(coalesce(sum(chunks), 0) AS BIGINT) AS total_cached_chunks FROM l WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 43200 SECOND")
def session_cache_stats(spark, sf_dir):
    """With a time to live of half a day, which the fixture reaches."""
    s = _stores(spark, sf_dir).where("store").select("key", "id", "ts", (F.col("id") % 5 + 1).alias("chunks"))
    return session_stats(s, AS_OF, 43200)


@query("SELECT n_nationkey AS id, n_name AS name, CAST(coalesce(n, 0) AS BIGINT) AS documents FROM nation LEFT JOIN (SELECT project_id, count(*) AS n FROM {document} WHERE is_active GROUP BY 1) ON project_id = n_nationkey")
def projects_list(spark, sf_dir):
    """All projects, with their active documents."""
    n = document(spark, sf_dir).where("is_active").groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("n"))
    p = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return p.join(n, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("documents"))
