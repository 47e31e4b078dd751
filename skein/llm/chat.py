"""Chat formatting: multi-party perspective rotation.

For every speaker of a conversation the dialogue is rendered with that speaker as the assistant and all others as named
users; the mask lists the code points that the assistant says. Output grows with turns times speakers, as the method asks.
A rendering is one text over the whole conversation. It is stored in parts of at most ``part_turns`` turns, so that no conversation has
to fit into one row or task: the texts of its parts, by part and subpart, make the rendering; ``start`` is a part's place in it, and
masks count from there. DataFrame functions only.

Defined results: null text counts as empty, a null speaker as ``unknown``; turns are ordered by number (null last), then speaker, then
text, and repeated rows are all said; a speaker who says nothing in a part has an empty mask there; very long texts are rendered whole;
an empty table gives no rows; extra columns are not read, so no name clashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

START, END = "<|start|>", "<|end|>\n"


def rotate(turns: DataFrame, part_turns: int = 1024, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """conv_id, perspective, part, subpart, start, n_turns, n_own, text, mask (array of start, end in code points of the whole rendering)."""
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.coalesce(F.col(turn).cast("long"), F.lit((1 << 63) - 1)).alias("turn"),
        F.coalesce(speaker, F.lit("unknown")).alias("speaker"), F.coalesce(text, F.lit("")).alias("text"),
    )
    rows = rows.withColumn("part", F.floor(F.col("turn") / part_turns))
    order = Window.partitionBy("conv_id", "part").orderBy("turn", "speaker", "text")
    rows = rows.withColumn("_n", F.row_number().over(order) - 1).withColumn("subpart", F.floor(F.col("_n") / part_turns))
    casts = rows.groupBy("conv_id").agg(F.sort_array(F.collect_set("speaker")).alias("_cast")).withColumnRenamed("conv_id", "_c")
    rows = rows.join(casts, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c").withColumn("perspective", F.explode("_cast"))
    own = F.col("speaker") == F.col("perspective")
    head = F.concat(F.lit(START), F.when(own, "assistant").otherwise(F.concat(F.lit("user name="), F.col("speaker"))), F.lit("\n"))
    keys = ["conv_id", "perspective", "part", "subpart"]
    said = rows.select(*keys, F.struct("_n", head.alias("head"), "text", own.alias("own")).alias("t"))
    sizes = said.groupBy(*keys).agg(F.sum(F.length("t.head") + F.length("t.text") + len(END)).alias("size"))
    upto = Window.partitionBy("conv_id", "perspective").orderBy("part", "subpart").rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.select(*keys, F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("start"))  # a row a part
    got = said.groupBy(*keys).agg(F.sort_array(F.collect_list("t")).alias("_t"))
    got = got.join(places.select(*[F.col(k).alias(f"p_{k}") for k in keys], "start"), [F.col(k).eqNullSafe(F.col(f"p_{k}")) for k in keys])

    def step(a, t):
        begin = a["at"] + F.length(t["head"])
        end = begin + F.length(t["text"])
        mask = F.when(t["own"], F.concat(a["mask"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(a["mask"])
        return F.struct((end + len(END)).alias("at"), mask.alias("mask"))

    mask = F.aggregate("_t", F.struct(F.col("start").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("mask")), step, lambda a: a["mask"])
    body = F.array_join(F.transform("_t", lambda t: F.concat(t["head"], t["text"], F.lit(END))), "")
    n_own = F.size(F.filter("_t", lambda t: t["own"])).cast("long")
    return got.select(*keys, "start", F.size("_t").cast("long").alias("n_turns"), n_own.alias("n_own"), body.alias("text"), mask.alias("mask"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rotate(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return rows.select("conv_id", "perspective", "part", "subpart", "start", "n_turns", "n_own", "text", mask.alias("mask"))


OP8_SQL = """
WITH t AS (SELECT conv_id, coalesce(turn, 9223372036854775807) AS turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT *, CAST(floor(turn / 1024) AS BIGINT) AS part FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, part ORDER BY turn, speaker, text) - 1 AS n FROM p),
c AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t),
r AS (SELECT n.conv_id, perspective, part, CAST(floor(n / 1024) AS BIGINT) AS subpart, n, speaker = perspective AS own, text,
        '<|start|>' || CASE WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || speaker END || chr(10) AS head
      FROM n JOIN c ON n.conv_id IS NOT DISTINCT FROM c.conv_id),
o AS (SELECT *, coalesce(sum(length(head) + length(text) + 8) OVER (PARTITION BY conv_id, perspective ORDER BY part, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos0 FROM r)
SELECT conv_id, perspective, part, subpart, CAST(min(pos0) AS BIGINT) AS start, count(*) AS n_turns, CAST(sum(CASE WHEN own THEN 1 ELSE 0 END) AS BIGINT) AS n_own,
  string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY n) AS text,
  coalesce(string_agg(CASE WHEN own THEN CAST(CAST(pos0 + length(head) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(pos0 + length(head) + length(text) AS BIGINT) AS VARCHAR) END, ',' ORDER BY n), '') AS mask
FROM o GROUP BY conv_id, perspective, part, subpart
"""
