"""Sources: the reading of tables, and the retrieval model's tables as views of the fixture tables.

Each adapter has its SQL twin in ``MODEL_SQL`` for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXTENSIONS = (".pdf", ".docx", ".md", ".txt", ".html")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores where the scan has fewer parts than there are cores, as a small file in one row group has; a scan
    of more parts stays as it is, without a shuffle. For work that costs more per row than moving the row does."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, for work on their texts."""
    return spread(table(spark, sf_dir, "documents"))


def document(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir)
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select(
        F.col("doc_id").alias("id"), (F.substring("source", 4, 9).cast("int") % 4).alias("project_id"), F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id"), ext).alias("filename"),
        (F.col("doc_id") % 10 != 9).alias("is_active"), (F.col("doc_id") % 365).alias("upload_day"), F.col("text").alias("content"),
    )


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a turn; quality and trace fields sit in JSON, as the telemetry sink writes them."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 4).alias("project_id"), "user_id", F.col("event_type").alias("model_used"), F.col("value").alias("latency_ms"), F.col("ts").alias("created_at"),
        k.alias("k"), (k % 2 == 0).alias("used_hybrid_search"), F.when(k % 3 != 0, F.to_json(F.struct((k % 10 / 10.0).alias("faithfulness"), (k % 7 / 7.0).alias("answer_relevance"), F.when(k % 2 == 0, k % 9 / 8.0).alias("context_relevance"), (k % 4 / 4.0).alias("groundedness"), (k % 5 / 5.0).alias("overall_score")))).alias("ragas_scores"),
        F.when(k % 5 != 0, k % 6 / 6.0).alias("hallucination_score"), F.when(k % 7 != 0, k % 8 / 8.0).alias("faithfulness_score"),
        F.when(k % 4 == 0, F.to_json(F.struct(F.lit(True).alias("agentic"), (k % 8 == 0).alias("answered"), (k % 3 + 1).alias("attempts"), F.slice(F.array(F.lit("semantic"), F.lit("hybrid"), F.lit("decomposed")), 1, k % 3 + 1).alias("strategies_tried"), F.when(k % 8 == 0, F.struct((k % 11 / 11.0).alias("compression_ratio"))).alias("compression_stats"), F.struct((k % 13).alias("estimated_monthly_savings_usd")).alias("prompt_cache_info")))).alias("pipeline_trace"),
        (k % 5).alias("citations_shown"), F.least(k % 3, k % 5).alias("citations_clicked"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"), (F.col("conv_id") % 4).alias("project_id"))


def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    models = F.array(*[F.lit(m) for m in ("gemini-1.5-flash", "gemini-1.5-pro", "llama-3.3-70b-versatile", "llama-3.1-8b-instant", "other")])
    m = F.element_at(models, (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("id"), "user_id", (F.col("user_id") % 4).alias("project_id"), m.alias("model"), F.when(F.col("event_id") % 5 < 2, "google").otherwise("groq").alias("provider"),
        (F.col("event_id") % 4000).alias("input_tokens"), (F.col("event_id") % 900).alias("output_tokens"), F.col("ts").alias("timestamp"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with dates, money and durations, as retrieved lists: the ten newest orders of each customer."""
    o = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.concat(F.lit("Order "), F.col("o_orderkey"), F.lit(" of $"), F.floor("o_totalprice").cast("long"), F.lit(".00 was placed on "), day, F.lit(" and ships in "), F.col("o_orderkey") % 9 + 2, F.lit(" days, see section "), F.col("o_orderkey") % 7 + 1, F.lit(" below."))
    newest = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey")))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("query_id"), text.alias("text"), newest.alias("n")).where("n <= 10").drop("n")


#: Fixed list of questions that reach every branch of the classifiers.
QUESTIONS = (
    "What is the refund policy?", "define churn", "list all vendors", "How many documents are there?", "compare plan A and plan B versus plan C", "why does the cache expire and what is the impact",
    "What led to the outage, what was it caused by and then finally fixed?", "explain that", "thanks!", "ok", "yes", "what about the second one", "can you tell me more", "it", "how to reset a password", "steps to install",
    "describe the architecture of the ingestion service and its failure mode in detail please", "write a script to parse logs", "difference between semantic and lexical retrieval", "total cost by month", "orders greater than 500",
    "find reports in pdf", "documents not about pricing, since 2021", "contracts excluding renewals and before march", "show invoices from the finance report", "anything except for drafts", "who is the owner", "when should we scale",
    "evaluate the design trade-off and the relationship between cost and latency: how should we compare 3 options for 2025/Q1", "top 5 customers", "tell me about onboarding", "is it over budget", "summarize this", "",
    "first collect the signed forms and also review every clause then compute the final price, finally archive the documents", "walk me through the process for approval", "meaning of SLA", "what does RRF mean", "more", "Which is better for speed Spark or pandas?",
)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed questions, the benchmark items and the user turns: (qid, q)."""
    fixed = spark.createDataFrame([(i, q) for i, q in enumerate(QUESTIONS)], "qid long, q string")
    items = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1_000_000).alias("qid"), F.col("text").alias("q"))
    said = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn") + 1_000_000_000).alias("qid"), F.col("text").alias("q"))
    return fixed.unionByName(items).unionByName(said)


_Q = ", ".join(f"({i}, '{q.replace(chr(39), chr(39) * 2)}')" for i, q in enumerate(QUESTIONS))
MODEL_SQL = {
    "document": "(SELECT doc_id AS id, CAST(substr(source, 4) AS INT) % 4 AS project_id, source || '/doc_' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.md' WHEN 3 THEN '.txt' ELSE '.html' END AS filename, doc_id % 10 <> 9 AS is_active, doc_id % 365 AS upload_day, text AS content FROM documents)",
    "query_log": """(SELECT event_id AS id, user_id % 4 AS project_id, user_id, event_type AS model_used, value AS latency_ms, ts AS created_at, k, k % 2 = 0 AS used_hybrid_search,
        CASE WHEN k % 3 <> 0 THEN (k % 10) / 10.0 END AS faithfulness, CASE WHEN k % 3 <> 0 THEN (k % 7) / 7.0 END AS answer_relevance, CASE WHEN k % 3 <> 0 AND k % 2 = 0 THEN (k % 9) / 8.0 END AS context_relevance, CASE WHEN k % 3 <> 0 THEN (k % 4) / 4.0 END AS groundedness, CASE WHEN k % 3 <> 0 THEN (k % 5) / 5.0 END AS overall_score,
        CASE WHEN k % 5 <> 0 THEN (k % 6) / 6.0 END AS hallucination_score, CASE WHEN k % 7 <> 0 THEN (k % 8) / 8.0 END AS faithfulness_score, CASE WHEN k % 8 = 0 THEN (k % 11) / 11.0 END AS compression_ratio, CASE WHEN k % 4 = 0 THEN CAST(k % 13 AS DOUBLE) END AS cache_savings, k % 4 = 0 AS agentic, k % 8 = 0 AS answered, k % 3 + 1 AS attempts,
        CASE WHEN k % 4 = 0 THEN list_slice(['semantic', 'hybrid', 'decomposed'], 1, k % 3 + 1) END AS strategies_tried, k % 5 AS citations_shown, least(k % 3, k % 5) AS citations_clicked
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))""",
    "turns": "(SELECT conv_id AS session_id, turn, role, text AS content, conv_id % 4 AS project_id FROM conversations)",
    "token_usage": "(SELECT event_id AS id, user_id, user_id % 4 AS project_id, (['gemini-1.5-flash', 'gemini-1.5-pro', 'llama-3.3-70b-versatile', 'llama-3.1-8b-instant', 'other'])[event_id % 5 + 1] AS model, CASE WHEN event_id % 5 < 2 THEN 'google' ELSE 'groq' END AS provider, event_id % 4000 AS input_tokens, event_id % 900 AS output_tokens, ts AS timestamp FROM events)",
    "facts": "(SELECT o_orderkey AS id, o_custkey AS query_id, 'Order ' || o_orderkey || ' of $' || CAST(floor(o_totalprice) AS BIGINT) || '.00 was placed on ' || strftime(o_orderdate, '%Y-%m-%d') || ' and ships in ' || (o_orderkey % 9 + 2) || ' days, see section ' || (o_orderkey % 7 + 1) || ' below.' AS text FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 10)",
    "questions": f"(SELECT * FROM (VALUES {_Q}) AS v(qid, q) UNION ALL SELECT item_id + 1000000, text FROM benchmark UNION ALL SELECT conv_id * 1000 + turn + 1000000000, text FROM conversations WHERE role = 'user')",
}
