"""Tools: a registry of named, role-checked functions that return DataFrames, and the bounded retrieval loop."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import document, table
from .index import index_of, lexical

TOOLS: dict[str, "Tool"] = {}


@dataclass(frozen=True)
class Tool:
    """A named function with the roles that may call it and the kind and bounds of each argument."""

    description: str
    roles: tuple[str, ...]
    inputs: dict[str, tuple]
    run: Callable[..., DataFrame]

    def validate(self, args: dict) -> None:
        for name, value in args.items():
            if name not in self.inputs:
                raise ValueError(f"unknown argument {name}")
            kind, *bounds = self.inputs[name]
            if not isinstance(value, kind) or isinstance(value, bool) and kind is not bool:
                raise ValueError(f"{name} must be {kind.__name__}")
            if bounds and not bounds[0] <= value <= bounds[1]:
                raise ValueError(f"{name} must lie between {bounds[0]} and {bounds[1]}")


def tool(description: str, *roles: str, **inputs: tuple):
    def keep(f):
        TOOLS[f.__name__] = Tool(description, roles, inputs, f)
        return f

    return keep


@tool("Lexical search over active documents", "admin", "client", question=(str,), top_k=(int, 1, 100), least_score=(float, 0.0, 1e9))
def search_documents(spark: SparkSession, sf_dir: str, question: str, top_k: int = 4, least_score: float = 0.0) -> DataFrame:
    """The first ``top_k`` active documents; with ``least_score`` only those of that score or more."""
    docs = document(spark, sf_dir)
    found = lexical(index_of(spark, sf_dir, docs), spark.createDataFrame([(0, question)], "query_id long, q string"), 4 * top_k)
    kept = found.join(docs.where("is_active").select("id"), "id", "left_semi").where(F.col("score") >= least_score)
    return kept.orderBy("rank").limit(top_k)


@tool("The latest active configuration", "admin")
def get_active_rag_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_acctbal > 0").orderBy(F.desc("c_custkey")).limit(1)


@tool("Names of documents", "admin", limit=(int, 1, 10_000))
def get_document_sources(spark: SparkSession, sf_dir: str, limit: int = 100) -> DataFrame:
    return document(spark, sf_dir).select("id", "filename").orderBy("id").limit(limit)


def permissions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, n) for n, t in TOOLS.items() for r in t.roles], "role string, tool string")


def call(spark: SparkSession, sf_dir: str, role: str, name: str, **args) -> DataFrame:
    """Permission, then lookup, then the arguments, then the call; failures raise."""
    if name not in TOOLS:
        raise KeyError(f"no tool named {name}")
    if role not in TOOLS[name].roles:
        raise PermissionError(f"{role} may not call {name}")
    TOOLS[name].validate(args)
    return TOOLS[name].run(spark, sf_dir, **args)


def answer(spark: SparkSession, sf_dir: str, role: str, name: str, most: int = 100, **args) -> dict:
    """A call's result as content: rows as dicts, or the failure in words."""
    try:
        return {"ok": True, "content": [r.asDict(recursive=True) for r in call(spark, sf_dir, role, name, **args).limit(most).collect()]}
    except (KeyError, PermissionError, ValueError) as e:
        return {"ok": False, "content": str(e.args[0])}


def agent(pending: DataFrame, search: Callable[[DataFrame, str], DataFrame], bar: float = 0.75, attempts: int = 3) -> DataFrame:
    """At most ``attempts`` passes over (query_id, q, strategy): queries whose confidence reaches the bar are answered, the others
    change strategy (semantic and hybrid swap, then decomposed) and, at last, are refused. ``search`` gives (query_id, confidence)."""
    done, plan = None, {"semantic": "hybrid", "hybrid": "semantic"}
    swap = F.create_map(*[F.lit(x) for kv in plan.items() for x in kv])
    for n in range(1, attempts + 1):
        got = pending.join(search(pending, "strategy"), "query_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
        last = n == attempts
        out = got if last else got.where(F.col("confidence") >= bar)
        out = out.select("query_id", "strategy", "confidence", F.lit(n).alias("attempts"), F.when(F.col("confidence") >= bar, "generate").otherwise("refuse").alias("action"))
        done = out if done is None else done.unionByName(out)
        if not last:
            nxt = F.coalesce(F.try_element_at(swap, F.col("strategy")), F.lit("decomposed")) if n == 1 else F.lit("decomposed")
            pending = got.where(F.col("confidence") < bar).select("query_id", "q", nxt.alias("strategy"))
    return done
