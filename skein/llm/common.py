"""Helpers shared by the training-text operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread

#: A side is broadcast only if its counted rows stay below this; beyond it the plain (shuffled) join runs.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; documents that the scan would deal to fewer tasks than there are cores are spread over them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or the one that the session was given by setCheckpointDir. Without either, a session
    in one process gets a temporary one; on a cluster it is an error, as no folder is known that all executors share."""
    context = spark.sparkContext
    named, given = spark.conf.get("spark.checkpoint.dir", None), context._jsc.sc().getCheckpointDir()
    if not given.isDefined():
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = named or tempfile.mkdtemp(prefix="skein-checkpoint-")
        context.setCheckpointDir(named)
    return named or given.get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and forget the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a (cheap to count, materialised) side for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bounded_batches(spark: SparkSession) -> None:
    """Python workers get texts in batches of at most 1000 rows and 16 MB, so that long texts do not add up."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from every column of df (in any case of letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
