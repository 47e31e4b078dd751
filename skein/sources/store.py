"""Stored tables: where they live, and the sinks that append to them."""

from __future__ import annotations

import hashlib
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def home(spark: SparkSession) -> str:
    """The folder of stored tables: spark.checkpoint.dir, as all executors share it. Where it is unset, a session in one process
    gets a temporary folder; on a cluster it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.skein.home", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    named = tempfile.mkdtemp(prefix="skein-home-")
    spark.conf.set("spark.skein.home", named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialised in the shared folder, for a short list that several parts of a plan read."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(home(df.sparkSession))
    return df.checkpoint()


def folder_of(spark: SparkSession, name: str, source: str) -> str:
    """A folder for what is derived from a source, of this application."""
    return f"{home(spark)}/{name}-{spark.sparkContext.applicationId}-{hashlib.md5(source.encode()).hexdigest()[:16]}"


#: Tables that sinks and DDL know, with their columns.
SCHEMAS = {
    "query_log": "id long, project_id long, user_id long, session_id long, query string, model_used string, latency_ms double, created_at timestamp_ntz, used_hybrid_search boolean, ragas_scores string, pipeline_trace string, citations_shown int, citations_clicked int",
    "token_usage": "id long, user_id long, project_id long, model string, provider string, input_tokens long, output_tokens long, cost double, timestamp timestamp_ntz",
    "project": "id long, name string, owner_id long, kb_version long",
    "chunk": "id long, document_id long, chunk_index int, content string, content_hash string, doc_id_version string, chunk_version int",
    "message": "id long, session_id long, role string, content string, created_at timestamp_ntz",
    "session": "id long, project_id long, user_id long, title string, created_at timestamp_ntz",
    "config": "id long, project_id long, chunk_size int, chunk_overlap int, top_k int, use_hybrid_search boolean, semantic_weight double, is_active boolean",
}


def create_tables(spark: SparkSession, root: str, names=tuple(SCHEMAS)) -> None:
    """Writes each table as empty Parquet if it is not there yet."""
    for name in names:
        spark.createDataFrame([], SCHEMAS[name]).write.mode("ignore").parquet(f"{root}/{name}")


def append(rows: DataFrame, root: str, name: str) -> None:
    """Sink: rows go to the table with its columns in order; missing ones become null, others are left out."""
    columns = T.StructType.fromDDL(SCHEMAS[name])
    have = set(rows.columns)
    rows.selectExpr(*[f"cast({f.name if f.name in have else 'null'} as {f.dataType.simpleString()}) as {f.name}" for f in columns]).write.mode("append").parquet(f"{root}/{name}")


def stored(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def clear(spark: SparkSession, root: str, name: str) -> None:
    """Deletes all rows; the table stays."""
    spark.createDataFrame([], SCHEMAS[name]).write.mode("overwrite").parquet(f"{root}/{name}")
