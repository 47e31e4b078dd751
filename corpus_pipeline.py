"""Training corpus pipeline: quality, line dedup, near duplicates, benchmark decontamination, packing.

Every stage reads what the one before kept, as Parquet in the shared checkpoint folder. All but the last return the columns of
documents, whatever else a table holds; helper columns cannot clash, as other columns are not carried.

Defined results: null texts count as empty and stay null; a null id is an id of its own that comes first. The quality stage keeps what
scores ``LEAST_QUALITY`` or more, empty and very long texts included; without labels that is everything. Line dedup drops documents of which every line is
a later copy, and keeps those that were empty before. Of near duplicates the row of the least id stays, of ties in id that of the
least digests, of rows equal in both one. Decontamination drops documents of which more than half the words are hit and cuts the hit spans out
of the others. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import shared_dir, table
from skein.llm.decontaminate import decontaminate
from skein.llm.line_dedup import dedup_lines
from skein.llm.ngram_join import keep_one_each
from skein.llm.packing import pack_documents
from skein.llm.quality import fit, score

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents that score below this go.
LEAST_QUALITY = 0.3


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select(*COLUMNS), model, out="_score").where(F.col("_score") >= LEAST_QUALITY).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which every line is a later copy go."""
    rows = dedup_lines(docs.select(*COLUMNS), out="_gone")
    return _sized(rows.where((F.col("_gone") == 0) | (F.col("text") != "")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_each(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: A learned score decides in the first stage, so no SQL gives these rows; test_pipeline_stages_against_brute_force holds every
#: stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, home = table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
    return docs
