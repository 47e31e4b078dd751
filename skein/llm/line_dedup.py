"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling.

Every line start is a suffix of the corpus' sequence of line ids. Round 0 ranks suffixes by their first line; round k + 1
ranks them by (rank at i, rank at i + 2^k), so that ranks order the first 2^(k+1) lines. Only suffixes whose rank is shared
go on. Suffixes with a common prefix of a given depth are an interval of the array, named by the two overlapping ranks of 2^k
lines that cover it. The depths looked at are those of the shortest runs of ``min_words`` words from each line on, and of the
shortest ones up to each line; any repeated run of so many words is a union of such. In each interval the first suffix (by id, then
line) stays; the others, chained where they and their firsts go on together, are the maximal repeated runs with their first
places (``repeated_runs``). Their lines are later copies and are deleted: a line goes if and only if it lies in a run of
``min_words`` or more words that stands somewhere before. DataFrame functions only.

Defined results: null texts stay null and have no lines; empty texts have one empty line, which is never deleted alone; rows equal
in id and text count as one document and keep the same lines; documents that end up without any line have text ''; of equal runs the
one of the least (id, digests, line) stays, a null id first; very long texts take as many rounds of doubling as runs of ``min_words`` words
have lines, which is bounded by that number and by empty lines among them; an empty table gives no rows; helper columns take names
that the table does not have.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, fresh, table, text_or_empty


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, a, b, pos, line id h1 h2, words) for each line of each distinct (id, text)."""
    t = text_or_empty(text_col)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(t).alias("a"), F.xxhash64(F.lit("k"), t).alias("b"), F.posexplode(F.split(t, "\n", -1)).alias("pos", "l"))
    return rows.select("id", "a", "b", "pos", F.xxhash64("l").alias("h1"), F.xxhash64(F.lit("k"), "l").alias("h2"), F.regexp_count("l", F.lit(r"\S+")).alias("words"))


def _upto(rows: DataFrame, by: list[str], order: str, n: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``n`` over the rows before, in the order of ``order`` among rows of equal ``by``."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.coalesce(F.sum(n).over(w), F.lit(0)))


def _first_ranks(shared: DataFrame) -> DataFrame:
    """(h1, h2, rank) from (h1, h2, n): how many lines stand before in the order of (h1, h2). Sums run inside 2^20 blocks of h1, then
    over the blocks inside 2^10 groups of blocks, then over those groups."""
    rows = shared.withColumn("_blk", F.shiftright("h1", 44)).withColumn("_at", F.struct("h1", "h2"))
    rows = _upto(rows, ["_blk"], "_at", "n", "_in")
    blocks = rows.groupBy("_blk").agg(F.sum("n").alias("_n")).withColumn("_top", F.shiftright("_blk", 10))
    tops = _upto(blocks.groupBy("_top").agg(F.sum("_n").alias("_t")), [], "_top", "_t", "_over").select("_top", "_over")
    blocks = _upto(blocks, ["_top"], "_blk", "_n", "_below").join(F.broadcast(tops), "_top")  # at most 2^10 rows
    return rows.join(blocks.select("_blk", (F.col("_over") + F.col("_below")).alias("_before")), "_blk").select("h1", "h2", (F.col("_in") + F.col("_before")).alias("rank"))


def _new_ranks(counts: DataFrame) -> DataFrame:
    """(r1, rank2, new) from (r1, rank2, n): r1 + how many suffixes of the same r1 stand before in the order of rank2. Sums run inside
    blocks of rank2 and then over them, so no window holds a whole hot rank."""
    rows = _upto(counts.withColumn("_blk", F.shiftright("rank2", 16)), ["r1", "_blk"], "rank2", "n", "_in")
    blocks = _upto(rows.groupBy("r1", "_blk").agg(F.sum("n").alias("_n")), ["r1"], "_blk", "_n", "_before")
    return rows.join(blocks.select("r1", "_blk", "_before"), ["r1", "_blk"]).select("r1", "rank2", (F.col("r1") + F.col("_in") + F.col("_before")).alias("new"))


def repeated_runs(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a, b, start, lines, first): the maximal later copies of runs of ``min_words`` words or more, with the place (id, a, b, pos) of
    the first copy of their beginning."""
    key = ["id", "a", "b"]
    lines = lines_of(docs, id_col, text_col)
    # Round 0: lines that occur once cannot be in a repeated run.
    shared = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    first = cut(_first_ranks(shared))
    # Depth: the least number of lines from here on with min_words words; a window over the document's own lines.
    active = lines.join(first, ["h1", "h2"]).select(*key, "pos", "rank", "words")
    doc = Window.partitionBy(*key)
    active = active.withColumn("_run", F.col("pos") - F.row_number().over(doc.orderBy("pos")))
    run = Window.partitionBy(*key, "_run").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    active = active.withColumn("_before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    # The last line that begins before the min_words-th word from here on; it ends the run if there are so many words.
    ahead = Window.partitionBy(*key, "_run").orderBy("_before").rangeBetween(0, min_words - 1)
    active = active.withColumn("_last", F.max("pos").over(ahead)).withColumn("_upto", F.max(F.col("_before") + F.col("words")).over(ahead))
    enough = F.col("_upto") - F.col("_before") >= min_words
    active = active.withColumn("_end", F.when(enough, F.col("_last")))
    # Runs that are shortest up to their last line: those from here on that end before the shortest one from the next line does.
    after = F.lead("_end").over(Window.partitionBy(*key, "_run").orderBy("pos"))
    final = F.max("pos").over(Window.partitionBy(*key, "_run"))
    active = active.withColumn("_more", F.coalesce(after - 1, final))
    ends = F.when(F.col("_end").isNull(), F.expr("cast(array() as array<int>)")).otherwise(F.sequence("_end", F.greatest("_end", "_more")))
    state = cut(active.select(*key, "pos", "rank", F.transform(ends, lambda e: (e - F.col("pos") + 1).cast("int")).alias("depths")))
    found, k = [], 0
    while True:
        size = 1 << k
        done = state.select(*key, "pos", "rank", F.explode(F.filter("depths", lambda d: (d >= size) & (d < 2 * size))).alias("depth"))
        tail = state.select(*key, F.col("pos").alias("_p"), F.col("rank").alias("rank2"))
        here = done.withColumn("_p", F.col("pos") + F.col("depth") - size).join(tail, [*key, "_p"]) if k else done.withColumn("rank2", F.col("rank"))
        # Written out round by round: one plan over all rounds, with the broadcasts of each, takes the driver's memory.
        found.append(cut(_later(here, key)))
        if state.where(F.array_max("depths") >= 2 * size).isEmpty():
            break
        # Doubling: pairs of ranks; those that occur once are settled.
        pair = state.join(tail.withColumn("pos", F.col("_p") - size).drop("_p"), [*key, "pos"])
        counts = pair.groupBy("rank", "rank2").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("rank", "r1")
        state = cut(pair.withColumnRenamed("rank", "r1").join(_new_ranks(counts), ["r1", "rank2"]).select(*key, "pos", F.col("new").alias("rank"), "depths"))
        k += 1
    later = reduce(DataFrame.unionByName, found)
    # Copies that go on together with their firsts overlap; they are chained to the run that they make.
    together = Window.partitionBy(*key, "first.id", "first.a", "first.b", "shift").orderBy("pos")
    later = later.withColumn("shift", F.col("pos") - F.col("first.pos")).withColumn("end", F.col("pos") + F.col("depth"))
    opens = F.coalesce(F.col("pos") > F.max("end").over(together.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    chained = later.withColumn("opens", opens).withColumn("chain", F.sum(F.col("opens").cast("int")).over(together))
    runs = chained.groupBy(*key, F.col("first.id").alias("f_id"), F.col("first.a").alias("f_a"), F.col("first.b").alias("f_b"), "shift", "chain").agg(F.min("pos").alias("start"), F.max("end").alias("end"))
    first = F.struct(F.col("f_id").alias("id"), F.col("f_a").alias("a"), F.col("f_b").alias("b"), (F.col("start") - F.col("shift")).alias("pos"))
    return runs.select(*key, "start", (F.col("end") - F.col("start")).alias("lines"), first.alias("first"))


def repeated_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a, b, positions): the sorted line numbers to delete from each document that loses any."""
    runs = repeated_runs(docs, min_words, id_col, text_col)
    gone = runs.select("id", "a", "b", F.explode(F.sequence("start", F.col("start") + F.col("lines") - 1)).alias("pos")).distinct()
    return gone.groupBy("id", "a", "b").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def _later(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows of each interval (depth, rank, rank2) but the first, with it. The firsts are partial minima, written out: few of them are
    broadcast, of many the join is one of plain shuffles, which AQE splits where an interval is hot."""
    at = F.struct(*key, "pos")
    firsts = broadcast_if_small(cut(rows.groupBy("depth", "rank", "rank2").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")))
    return rows.join(firsts, ["depth", "rank", "rank2"]).where(~at.eqNullSafe(F.col("first"))).select(*key, "pos", "depth", "first")


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", out: str = "lines_removed") -> DataFrame:
    """Deletes later copies from ``text_col`` and adds ``out``, the number of deleted lines."""
    gone = repeated_lines(docs, min_words, id_col, text_col)
    t = text_or_empty(text_col)
    i, a, b, g = fresh(docs, "_i", "_a", "_b", "_gone")
    slim = gone.select(F.col("id").alias(i), F.col("a").alias(a), F.col("b").alias(b), F.col("positions").alias(g))
    rows = docs.join(slim, (F.xxhash64(t) == F.col(a)) & (F.xxhash64(F.lit("k"), t) == F.col(b)) & F.col(id_col).eqNullSafe(F.col(i)), "left").drop(i, a, b)
    kept = F.array_join(F.filter(F.split(t, "\n", -1), lambda l, i: ~F.array_contains(g, i)), "\n")
    rows = rows.withColumn(text_col, F.when(F.col(g).isNull(), F.col(text_col)).otherwise(kept))
    return rows.withColumn(out, F.when(F.col(g).isNull(), 0).otherwise(F.size(g)).cast("long")).drop(g)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text that stays, its number of lines and of removed ones."""
    rows = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "text", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"), "lines_removed", F.sha2(text_or_empty(), 256).alias("text_sha256"))


#: Runs of 50 words or more, the shortest from each line on and the shortest up to each line; later copies of one lose their lines.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM d),
w AS (SELECT doc_id, pos, line, len(list_filter(string_split_regex(line, '\s+'), lambda x: x <> '')) AS words FROM e),
s AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) - words AS before FROM w),
y AS (SELECT a.doc_id, a.pos, z.pos AS last FROM s a JOIN s z ON a.doc_id = z.doc_id AND z.pos >= a.pos AND z.upto >= a.before + 50),
b AS (SELECT doc_id, pos, min(last) AS last FROM y GROUP BY doc_id, pos UNION SELECT doc_id, max(pos), last FROM y GROUP BY doc_id, last),
k AS (SELECT b.doc_id, b.pos, b.last, md5(array_to_string(l[b.pos + 1 : b.last + 1], chr(10))) AS block FROM b JOIN d USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY block, last - pos ORDER BY doc_id, pos) AS n FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(pos, last + 1)) AS pos FROM r WHERE n > 1),
t AS (SELECT e.doc_id, string_agg(CASE WHEN g.pos IS NULL THEN line END, chr(10) ORDER BY e.pos) AS text,
        count(*) - count(g.pos) AS n_lines, count(g.pos) AS gone FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id)
SELECT o.doc_id, CASE WHEN o.text IS NOT NULL THEN coalesce(t.text, '') END AS text,
  CAST(CASE WHEN o.text IS NULL THEN 0 ELSE greatest(n_lines, 1) END AS BIGINT) AS n_lines, CAST(coalesce(gone, 0) AS BIGINT) AS lines_removed, sha256(coalesce(t.text, '')) AS text_sha256
FROM documents o LEFT JOIN t USING (doc_id)
"""
