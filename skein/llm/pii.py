"""Personal data: base patterns, and information-theoretic sanitisation of the terms that give protected values away.

A protected value is a base finding. Its contexts are the distinct lines at most ``reach`` lines away from it in some document,
its own line included. For a term t and a value e, the corpus gives n(e, t) contexts of e with t, n(t) distinct lines with t
(over all documents) and n(e) contexts of e; P(e | t) = (n(e, t) + w P(e)) / (n(t) + w), smoothed by the weight w of a
``prior``, and t discloses e with log2(P(e | t) / P(e)) bits. A term with P(e | t) of ``share`` or more and ``bits`` or more is a
finding of kind ``term`` wherever it stands; it is generalised or removed. DataFrame functions only.

Defined results: null and empty texts have no spans; equal rows give equal results, and a line that repeats counts once; spans count code
points, end exclusive, and of equal starts the kind listed first comes first; an empty table gives no rows; helper columns take names
that the table does not have. Very long texts are searched whole: base patterns look back to where a run begins and are possessive, so that very long runs cost linear time; they match as the plain ones do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, fresh, table, text_or_empty

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text needs to hold, cheaply seen, before a pattern is tried.
HINTS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: t.contains("+") & t.rlike(r"\+[0-9]"),
}
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
_SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"
#: Characters of a term.
_TERM = r"\p{L}\p{M}\p{N}"
_none = lambda: F.expr(f"cast(array() as {_SPAN})")


def luhn(digits: Column) -> Column:
    """Whether 14 to 19 digits pass: from the right every second one is doubled, digits of the products are summed."""
    n = F.length(digits)

    def add(acc, i):
        d = F.substr(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.least(n, F.lit(19)) - 1), F.lit(0), add) % 10 == 0


def _holds(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def spans_of(text: Column, pattern: Column, kind: int, holds) -> Column:
    """Spans of all matches. What stands between matches gives the places: lengths of it and of the matches add up."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, pattern, -1)

    def step(acc, i):
        m = F.element_at(acc["m"], i)
        start = acc["at"] + F.length(F.element_at(acc["g"], i))
        one = F.struct(start.cast("bigint").alias("start"), F.lit(kind).alias("kind"), (start + F.length(m)).cast("bigint").alias("end"), m.alias("value"))
        return F.struct((start + F.length(m)).alias("at"), acc["m"].alias("m"), acc["g"].alias("g"), F.concat(acc["out"], F.array(one)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), found.alias("m"), between.alias("g"), _none().alias("out"))
    every = F.aggregate(F.sequence(F.lit(1), F.size(found)), start, step, lambda acc: acc["out"])
    return F.filter(F.when(F.size(found) > 0, every).otherwise(_none()), lambda s: holds(s["value"]))


def base_spans(text: Column) -> Column:
    """All base findings, by start, then kind as listed."""
    each = [F.when(HINTS[k](text), spans_of(text, F.lit(PATTERNS[k]), i, lambda m, k=k: _holds(k, m))).otherwise(_none()) for i, k in enumerate(KINDS[:4])]
    return F.array_sort(F.concat(*each))


def terms(text: Column) -> Column:
    """Distinct lower-case runs of letters, marks and digits, of any length."""
    return F.array_distinct(F.filter(F.split(F.lower(text), rf"[^{_TERM}]+"), lambda w: w != ""))


def _held(line: Column) -> Column:
    return F.array_distinct(F.transform(base_spans(line), lambda s: F.lower(s["value"])))


def _clean_terms(line: Column, values: Column) -> Column:
    """Terms of a line without its own values."""
    return terms(F.aggregate(values, F.lower(line), lambda a, v: F.replace(a, v, F.lit(" "))))


def disclosing_terms(found: DataFrame, share: float = 0.8, bits: float = 4.0, reach: int = 3, prior: float = 0.5) -> DataFrame:
    """(term, value, bits) from rows with _text and _base. Pairs are counted over distinct lines, so copies count once. Only terms
    that would pass if they stood nowhere but beside values are counted over the whole corpus, so common words are not."""
    n = found.agg(F.coalesce(F.sum(F.size(F.split("_text", "\n"))), F.lit(0)).alias("n")).first()["n"]
    smooth = lambda both, n_t, n_e: (both + prior * n_e / n) / (n_t + prior)
    lines = found.where(F.size("_base") > 0).select(F.split("_text", "\n").alias("ls"))
    lines = lines.withColumn("vs", F.transform("ls", _held))
    near = lambda i: F.array_distinct(F.flatten(F.slice("vs", F.greatest(i - reach, F.lit(0)) + 1, i - F.greatest(i - reach, F.lit(0)) + reach + 1)))
    each = F.transform("ls", lambda l, i: F.struct(l.alias("l"), F.element_at("vs", i + 1).alias("own"), near(i).alias("values")))
    lines = lines.select(F.explode(F.filter(each, lambda x: F.size(x["values"]) > 0)).alias("x"))
    lines = lines.select(F.xxhash64("x.l").alias("h"), "x.values", _clean_terms(F.col("x.l"), F.col("x.own")).alias("terms"))
    lines = cut(lines.groupBy("h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("values")))).alias("values"), F.first("terms").alias("terms")))
    n_e = cut(lines.select(F.explode("values").alias("value")).groupBy("value").agg(F.count("*").alias("n_e")))
    most = n_e.agg(F.coalesce(F.max("n_e"), F.lit(0))).first()[0]
    # No pair has more contexts than the value or the term has; P(e) is at most 2^-bits where the bits suffice.
    could = lambda both, n_t: (both + prior * 2.0**-bits) / (n_t + prior) >= share
    m_t = lines.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("m_t"))
    m_t = cut(m_t.where(could(F.least("m_t", F.lit(most)), F.col("m_t"))))
    pairs = lines.select(F.explode("values").alias("value"), "terms").join(broadcast_if_small(n_e), "value")
    pairs = pairs.select("value", "n_e", F.explode("terms").alias("term")).join(broadcast_if_small(m_t), "term").where(could(F.least("n_e", "m_t"), F.col("m_t")))
    pairs = pairs.groupBy("value", "term", "n_e", "m_t").agg(F.count("*").alias("both"))
    pairs = cut(pairs.where(could(F.col("both"), F.col("m_t"))).drop("m_t"))
    wanted = cut(pairs.select("term").distinct())
    if wanted.isEmpty():
        return wanted.select("term", F.lit("").alias("value"), F.lit(0.0).alias("bits")).where("false")
    every = found.select(F.explode(F.split("_text", "\n")).alias("l"), (F.size("_base") > 0).alias("has"))
    own = F.when(F.col("has"), _held(F.col("l"))).otherwise(F.expr("cast(array() as array<string>)"))
    every = every.select(F.xxhash64("l").alias("h"), F.explode(_clean_terms(F.col("l"), own)).alias("term"))
    n_t = every.join(broadcast_if_small(wanted), "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    got = pairs.join(n_t, "term").withColumn("p", smooth(F.col("both"), F.col("n_t"), F.col("n_e")))
    return cut(got.withColumn("bits", F.log2(F.col("p") * n / F.col("n_e"))).where((F.col("p") >= share) & (F.col("bits") >= bits)).select("term", "value", "bits"))


def find_personal_data(docs: DataFrame, text_col: str = "text", out: str = "pii", share: float = 0.8, bits: float = 4.0, reach: int = 3, prior: float = 0.5) -> DataFrame:
    """Adds ``out``: array of (start, kind's place in KINDS, end, value), by start, then kind."""
    t = text_or_empty(text_col)
    base, a, b, listed = fresh(docs, "_base", "_a", "_b", "_terms")
    found = docs.select(t.alias("_text")).withColumn("_base", base_spans(F.col("_text")))
    terms_found = disclosing_terms(found, share, bits, reach, prior).select("term").distinct()
    with_base = docs.withColumn(base, base_spans(t))
    if terms_found.isEmpty():
        return with_base.withColumn(out, F.col(base)).drop(base)
    named = broadcast_if_small(cut(terms_found))
    digests = F.xxhash64(t), F.xxhash64(F.lit("k"), t)
    where = docs.select(digests[0].alias(a), digests[1].alias(b), F.explode(terms(t)).alias("term")).join(named, "term", "left_semi").distinct()
    where = cut(where.groupBy(a, b).agg(F.sort_array(F.collect_set("term")).alias(listed)))
    rows = with_base.join(broadcast_if_small(where), (digests[0] == F.col(a)) & (digests[1] == F.col(b)), "left")
    pattern = F.concat(F.lit(rf"(?iu)(?<![{_TERM}])(?:"), F.array_join(listed, "|"), F.lit(rf")(?![{_TERM}])"))
    extra = F.when(F.col(listed).isNotNull(), spans_of(t, pattern, 4, lambda m: F.lit(True))).otherwise(_none())
    free = F.filter(extra, lambda x: ~F.exists(base, lambda y: (y["start"] < x["end"]) & (y["end"] > x["start"])))
    return rows.withColumn(out, F.array_sort(F.concat(F.col(base), free))).drop(a, b, listed, base)


def sanitise(docs: DataFrame, text_col: str = "text", generalise: bool = True, **options) -> DataFrame:
    """Replaces findings in the text: base ones by their kind in brackets, terms by ``[TERM]`` (or removes them)."""
    (pii,) = fresh(docs, "_pii")
    rows = find_personal_data(docs, text_col, pii, **options)
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    word = lambda s: F.when((s["kind"] == 4) & (not generalise), F.lit("")).otherwise(F.element_at(labels, s["kind"] + 1))
    t = F.col(text_col)
    kept = F.aggregate(pii, F.struct(F.lit("").alias("text"), F.lit(0).cast("bigint").alias("at")), lambda a, s: F.when(s["start"] < a["at"], a).otherwise(
        F.struct(F.concat(a["text"], t.substr((a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), word(s)).alias("text"), s["end"].alias("at"))))
    return rows.withColumn(text_col, F.when(F.size(pii) > 0, F.concat(kept["text"], t.substr((kept["at"] + 1).cast("int"), F.length(t)))).otherwise(t)).drop(pii)


def _is(kind: int):
    return lambda s: s["kind"] == kind


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.select(
        "doc_id", *[F.size(F.filter("pii", _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
        F.sha2(joined(F.filter("pii", lambda s: s["kind"] < 4)), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"),
    )
