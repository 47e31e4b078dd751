"""Document fingerprints: a Merkle tree of leaves (word groups), paragraphs (lines), sections (runs of paragraphs) and a root.

A leaf is up to ``LEAF_WORDS`` words of a paragraph; a longer run without a blank counts as a word every ``WORD_CHARS`` characters, so
leaves are bounded in any text. Every parent hashes the digests of its children, the root all sections. The fingerprint is text:
root ``|`` section digests ``|`` paragraphs joined by commas, each its digest and those of its leaves. Equal roots mean equal texts;
``likeness`` and ``edited_paths`` go down only where digests differ. DataFrame functions only.

Defined results: null text counts as empty (one paragraph without leaves); equal texts, repeated rows among them, have equal
fingerprints and likeness 1; very long texts have as many leaves as they need; the next document of the only one is itself; null
ids come last (lowest); rows that share an id follow each other by text digest; an empty table gives no rows; helper columns take
names that the table does not have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, fresh, let, table, text_or_empty

LEAF_WORDS, WORD_CHARS, SECTION_PARAGRAPHS, ROOT, WIDTH = 4, 24, 16, 32, 12
_LEAF = rf"(?:[^ ]{{1,{WORD_CHARS}}}+ ?+| ){{1,{LEAF_WORDS}}}+"


def _hash(kind: str, children: Column) -> Column:
    return F.md5(F.concat(F.lit(kind), F.array_join(children, "")).cast("binary"))


def _short(digests: Column) -> Column:
    return F.array_join(F.transform(digests, lambda d: F.substring(d, 1, WIDTH)), "")


def fingerprint(text: Column) -> Column:
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(_LEAF), F.lit(0)), lambda l: F.md5(l.cast("binary")))
    paragraph = lambda p: let(leaves(p), lambda ls: F.struct(_hash("p", ls).alias("d"), _short(ls).alias("leaves")))

    def joined(paragraphs: Column) -> Column:
        ds = paragraphs["d"]
        sections = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(paragraphs) - 1) / SECTION_PARAGRAPHS).cast("int")),
            lambda i: _hash("s", F.slice(ds, i * SECTION_PARAGRAPHS + 1, F.lit(SECTION_PARAGRAPHS))),
        )
        below = F.array_join(F.transform(paragraphs, lambda p: F.concat(F.substring(p["d"], 1, WIDTH), p["leaves"])), ",")
        return let(sections, lambda s: F.concat_ws("|", _hash("r", s), _short(s), below))

    return let(F.transform(F.split(text, "\n", -1), paragraph), joined)


def _digests(run: Column) -> Column:
    return F.regexp_extract_all(run, F.lit(f".{{{WIDTH}}}"), F.lit(0))


def branches(fp: Column) -> Column:
    """A fingerprint as a struct of root, sections and paragraphs (digest, leaves). Put it in a column of its own before it is
    compared, so that it is read once."""
    paragraph = lambda p: F.struct(F.substring(p, 1, WIDTH).alias("d"), _digests(F.substring(p, WIDTH + 1, 1 << 30)).alias("leaves"))
    return let(F.split(fp, r"\|", -1), lambda x: F.struct(F.get(x, F.lit(0)).alias("root"), _digests(F.get(x, F.lit(1))).alias("sections"), F.transform(F.split(F.get(x, F.lit(2)), ",", -1), paragraph).alias("paragraphs")))


def _section(x: Column, i: Column) -> Column:
    return F.get(x["sections"], F.floor(i / SECTION_PARAGRAPHS).cast("int"))


def _indices(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))


def _same_place(x: Column, y: Column) -> Column:
    """Number of leaves that agree at the same path. Equal sections and paragraphs count without a look below them."""

    def leaves(acc, i):
        a, b = F.get(x["paragraphs"], i), F.get(y["paragraphs"], i)
        equal = lambda: F.size(F.filter(_indices(F.least(F.size(a["leaves"]), F.size(b["leaves"]))), lambda k: F.get(a["leaves"], k) == F.get(b["leaves"], k)))
        return acc + F.when((_section(x, i) == _section(y, i)) | (a["d"] == b["d"]), F.size(a["leaves"])).otherwise(equal())

    return F.aggregate(_indices(F.least(F.size(x["paragraphs"]), F.size(y["paragraphs"]))), F.lit(0), leaves)


def _all_leaves(x: Column) -> Column:
    return F.flatten(x["paragraphs"]["leaves"])


def likeness(x: Column, y: Column) -> Column:
    """Of two ``branches``: 1 for equal roots, else the larger of the shares of leaves that agree at the same path, and of distinct
    leaves that occur in both, wherever they stand."""
    place = lambda a, b: _same_place(x, y) / F.greatest(F.size(a), F.size(b), F.lit(1))
    anywhere = lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b), F.lit(1))
    distinct = lambda a, b: let(F.array_distinct(a), lambda p: let(F.array_distinct(b), lambda q: anywhere(p, q)))
    near = let(_all_leaves(x), lambda a: let(_all_leaves(y), lambda b: F.greatest(place(a, b), distinct(a, b))))
    return F.when(x["root"] == y["root"], F.lit(1.0)).otherwise(F.least(near, F.lit(0.999)))


def edited_paths(x: Column, y: Column) -> Column:
    """Where two ``branches`` differ: array of (section, paragraph, leaf), 0-based, found by going down differing digests only; leaf
    is -1 where a paragraph stands on one side only, or has no leaf that differs."""
    path = lambda i, k: F.struct(F.floor(i / SECTION_PARAGRAPHS).cast("int").alias("section"), i.alias("paragraph"), k.alias("leaf"))

    def below(i):
        a, b = F.get(x["paragraphs"], i), F.get(y["paragraphs"], i)
        differ = F.filter(_indices(F.greatest(F.size(a["leaves"]), F.size(b["leaves"]))), lambda k: ~F.get(a["leaves"], k).eqNullSafe(F.get(b["leaves"], k)))
        one_side = a["d"].isNull() | b["d"].isNull() | (F.size(differ) == 0)
        return F.when(one_side, F.array(path(i, F.lit(-1)))).otherwise(F.transform(differ, lambda k: path(i, k)))

    open_ = F.filter(_indices(F.greatest(F.size(x["paragraphs"]), F.size(y["paragraphs"]))), lambda i: ~_section(x, i).eqNullSafe(_section(y, i)) & ~F.get(x["paragraphs"], i)["d"].eqNullSafe(F.get(y["paragraphs"], i)["d"]))
    none = F.expr("cast(array() as array<struct<section:int,paragraph:int,leaf:int>>)")
    return F.when(x["root"] == y["root"], none).otherwise(F.flatten(F.transform(open_, below)))


_BITS = 12


def next_lower(ids: DataFrame) -> DataFrame:
    """(k, lower) for distinct non-null longs in column k: the next lower value, null for the lowest. Windows hold at most
    2^12 values: all of them where there are no more, else inside blocks of the number range, then between blocks by the same rule."""
    if ids.limit((1 << _BITS) + 1).count() <= 1 << _BITS:
        return ids.select("k", F.lag("k").over(Window.orderBy("k")).alias("lower"))
    block = F.shiftright("k", _BITS)
    inner = ids.select("k", block.alias("b")).withColumn("lower", F.lag("k").over(Window.partitionBy("b").orderBy("k")))
    tops = cut(ids.groupBy(block.alias("k")).agg(F.max("k").alias("most")))
    below = next_lower(tops.select("k")).join(tops.select(F.col("k").alias("lower"), F.col("most")), "lower").select(F.col("k").alias("b"), "most")
    return inner.join(broadcast_if_small(below), "b", "left").select("k", F.coalesce("lower", "most").alias("lower"))


def with_next(docs: DataFrame, carried: list[str], id_col: str = "doc_id", out: str = "next", prepare=lambda df: df) -> DataFrame:
    """Adds ``out``: the struct of the carried columns of the next document in descending id (after the last: the first).

    Rows are dealt out by blocks of 2^12 ids. Each block also gets a copy of the first row of the next block (a guest),
    found by its id, so that the texts are shuffled once; ``prepare`` adds columns after that, which can be carried too."""
    k, b, t, guest, home, n = fresh(docs, "_k", "_b", "_t", "_guest", "_home", "_n")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    ids = cut(docs.select(key.alias("k")).distinct())
    tops = cut(ids.groupBy(F.shiftright("k", _BITS).alias("b")).agg(F.max("k").alias("most")))
    chain = next_lower(tops.select(F.col("b").alias("k"))).withColumnRenamed("k", "b")
    highest = tops.agg(F.max("most").alias("highest"))
    guests = chain.join(tops.select(F.col("b").alias("lower"), "most"), "lower", "left").crossJoin(F.broadcast(highest))  # one row
    guests = broadcast_if_small(cut(guests.select(F.col("b").alias(home), F.coalesce("most", "highest").alias(k))))
    rows = docs.withColumn(k, key).withColumn(t, F.xxhash64(*[c for c in carried if c in docs.columns]))
    one = Window.partitionBy(home).orderBy(F.desc(t))
    visit = rows.join(guests, k).withColumn(n, F.row_number().over(one)).where(F.col(n) == 1).drop(n)
    every = rows.withColumn(b, F.shiftright(k, _BITS)).withColumn(guest, F.lit(False)).unionByName(visit.withColumnRenamed(home, b).withColumn(guest, F.lit(True)))
    order = Window.partitionBy(b).orderBy(F.asc(guest), F.desc(k), F.desc(t))
    every = prepare(every.repartition(b)).withColumn(out, F.lead(F.struct(*carried)).over(order))
    return every.where(~F.col(guest)).drop(k, b, t, guest)


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    rows = with_next(docs, ["text", "fingerprint"], prepare=lambda df: df.withColumn("fingerprint", fingerprint(F.col("text"))))
    n = F.length("text")
    m = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - m), F.substr(F.col("next.text"), F.lit(1), m))
    rows = rows.withColumn("_edited", edited).withColumn("edited_fingerprint", fingerprint(F.col("_edited")))
    rows = rows.withColumns({"_x": branches(F.col("fingerprint")), "_y": branches(F.col("edited_fingerprint")), "_z": branches(F.col("next.fingerprint"))})
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("_x"), F.col("_y")).alias("near_edited"), likeness(F.col("_x"), F.col("_z")).alias("near_next"),
    )


def _sql_tree(t: str) -> str:
    """Paragraphs with full digests, sections, root; one CTE step each."""
    return f"""a AS (SELECT doc_id, list_transform(string_split({t}, chr(10)), lambda p: list_transform(regexp_extract_all(p, '(?:[^ ]{{1,24}} ?| ){{1,4}}'), lambda l: md5(l))) AS ls FROM s),
  b AS (SELECT doc_id, ls, list_transform(ls, lambda l: md5('p' || array_to_string(l, ''))) AS ps FROM a),
  c AS (SELECT *, list_transform(range(0, (len(ps) + 15) // 16), lambda i: md5('s' || array_to_string(ps[i * 16 + 1 : i * 16 + 16], ''))) AS ss FROM b)
  SELECT doc_id, md5('r' || array_to_string(ss, '')) || '|' || array_to_string(list_transform(ss, lambda d: substr(d, 1, 12)), '') || '|'
    || array_to_string(list_transform(range(1, len(ps) + 1), lambda i: substr(ps[i], 1, 12) || array_to_string(list_transform(ls[i], lambda d: substr(d, 1, 12)), '')), ',') AS fp,
    list_transform(ls, lambda l: list_transform(l, lambda d: substr(d, 1, 12))) AS lv FROM c"""


def _sql_near(x: str, y: str) -> str:
    """Leaves at the same path, and distinct leaves anywhere, from nested lists of leaf digests."""
    all_ = lambda v: f"flatten({v})"
    place = f"coalesce(list_sum(list_transform(range(1, least(len({x}), len({y})) + 1), lambda i: len(list_filter(range(1, least(len({x}[i]), len({y}[i])) + 1), lambda k: {x}[i][k] = {y}[i][k])))), 0)"
    return f"""greatest(CAST({place} AS DOUBLE) / greatest(len({all_(x)}), len({all_(y)}), 1),
    CAST(len(list_intersect({all_(x)}, {all_(y)})) AS DOUBLE) / greatest(len(list_distinct({all_(x)})), len(list_distinct({all_(y)})), 1))"""


OP7_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), first_value(doc_id) OVER (ORDER BY doc_id DESC)) AS nid, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS nxt FROM d),
e AS (SELECT *, substr(text, 1, length(text) - length(text) // 3) || substr(nxt, 1, length(text) // 3) AS edited FROM n),
f AS (WITH s AS (SELECT doc_id, text FROM e), {_sql_tree('text')}),
g AS (WITH s AS (SELECT doc_id, edited FROM e), {_sql_tree('edited')})
SELECT e.doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, f.fp AS fingerprint, g.fp AS edited_fingerprint,
  CASE WHEN substr(f.fp, 1, 32) = substr(g.fp, 1, 32) THEN 1.0 ELSE least({_sql_near('f.lv', 'g.lv')}, 0.999) END AS near_edited,
  CASE WHEN substr(f.fp, 1, 32) = substr(h.fp, 1, 32) THEN 1.0 ELSE least({_sql_near('f.lv', 'h.lv')}, 0.999) END AS near_next
FROM e JOIN f USING (doc_id) JOIN g USING (doc_id) JOIN f h ON h.doc_id = e.nid
"""
