"""Evidence and answer quality: conflicts, references, absence, confidence, compression, overlap scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import EDGE, END, GROUND_STOPWORDS, KEYWORD_STOPWORDS, blank_words, has_any, jaccard, n_words, overlap, sentences, sentences_sql, spans, strings
from ..plans import query
from ..sources.store import cut
from ..sources.tables import document, facts, turns
from .classify import keyword_list
from .index import candidate_k, hybrid, lexical
from .retrieval import _BM25, _HYBRID, _PAIRS, _index, _items, _retrieved, against_sql, bm25_sql, bm25_topk, hybrid_lists, tfidf_against, tfidf_cosine, with_base, words_sql

#: Families of factual values, with the group that holds the value.
FACTS = (
    ("date", r"\b([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4})\b", 1), ("year", r"\b((?:19|20)[0-9]{2})\b", 1), ("amount", r"\$[0-9,]+(?:\.[0-9]{2})?", 0), ("percentage", r"\b([0-9]+(?:\.[0-9]+)?)\s*(?:percent|%)", 1),
    ("duration", r"\b([0-9]+)\s*(?:days|months|years|hours|weeks)\b", 1), ("month_day", r"\b(january|february|march|april|may|june|july|august|september|october|november|december)\s+[0-9]{1,2},?\s+[0-9]{4}\b", 1),
    ("month_year", r"\b(january|february|march|april|may|june|july|august|september|october|november|december)\s+[0-9]{4}\b", 1),
)
KINDS = {"date": "value_conflict", "year": "value_conflict", "amount": "amount_conflict", "percentage": "percentage_conflict", "duration": "duration_conflict", "month_day": "date_conflict", "month_year": "date_conflict"}
REFERENCES = (
    r"(?:see|refer to|as defined in|as stated in|per|according to)\s+(?:section|sec\.|appendix|clause|article|paragraph|part|chapter)\s*[0-9.]+[a-z]?", r"(?:section|sec\.|appendix|clause|article|paragraph|part|chapter)\s*[0-9.]+[a-z]?\s+(?:above|below|of this|herein)",
    r"as (?:described|outlined|specified|mentioned|noted) (?:above|below|herein)", r"see (?:above|below|attached|appendix)", r"\(see [\w\s.]+\)",
)
FACTUAL = (r"\b[0-9]+(?:\.[0-9]+)?%", r"\$[0-9,]+(?:\.[0-9]{2})?", r"\b[0-9]{4}\b", r"\b[0-9]+\s+(?:days|months|years|hours|weeks)\b", r"\b[a-z][a-z]+(?:\s+[a-z][a-z]+)+\b", r"\b(?:section|clause|article)\s+[0-9.]+")
NOT_FOUND = ["not found", "cannot find", "no information", "do not have information", "does not mention", "not mentioned", "don't have info", "no mention"]
AUTHORITY = {"pdf": 0.8, "docx": 0.75, "md": 0.65, "txt": 0.6, "html": 0.5}


def fact_values(text: Column) -> list[Column]:
    low = lambda p, g: F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"(?i){p}"), F.lit(g)), lambda v: F.trim(F.lower(v)))))
    return [low(p, g).alias(n) for n, p, g in FACTS]


def conflict_pairs(rows: DataFrame, by: str = "query_id", id_col: str = "id") -> DataFrame:
    """Pairs a < b of one retrieved list whose sets of some family differ. Lists are as short as top-k makes them; the values are
    taken once a row, before the pairs are formed."""
    v = rows.select(by, F.col(id_col).alias("id"), *fact_values(F.col("text")))
    a, b = v.select(by, *[F.col(c).alias(f"a_{c}") for c in v.columns if c != by]), v.select(by, *[F.col(c).alias(f"b_{c}") for c in v.columns if c != by])
    p = a.join(b, by).where("a_id < b_id")
    differs = lambda n: (F.size(f"a_{n}") > 0) & (F.size(f"b_{n}") > 0) & (F.col(f"a_{n}") != F.col(f"b_{n}"))
    names = F.array_compact(F.array(*[F.when(differs(n), n) for n, _, _ in FACTS]))
    kinds = F.transform(names, lambda n: F.element_at(F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v))]), n))
    kind = F.coalesce(F.get(F.filter(kinds, lambda k: k != "value_conflict"), F.lit(0)), F.lit("value_conflict"))
    return p.withColumn("families", names).where(F.size("families") > 0).select(by, "a_id", "b_id", F.array_join("families", ",").alias("families"), kind.alias("kind"))


def conflict_summary(pairs: DataFrame, by: str = "query_id") -> DataFrame:
    return pairs.groupBy(by).agg(F.count("*").alias("n"), F.when(F.count("*") > 2, "high").otherwise("low").alias("severity"))


def references(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, family, reference, start, end) of all references, by family, then place."""
    every = F.concat(*[F.transform(spans(F.col(text_col), f"(?i){p}"), _named(i)) for i, p in enumerate(REFERENCES)])
    return df.select(*keys, F.explode(every).alias("r")).select(*keys, "r.family", "r.reference", "r.start", "r.end")


def _named(i: int):
    return lambda m: F.struct(F.lit(i).alias("family"), F.trim(m["value"]).alias("reference"), m["start"].alias("start"), m["end"].alias("end"))


def resolve(found: DataFrame, search, known: DataFrame, by: str = "query_id", most: int = 3, k: int = 3) -> DataFrame:
    """(by, id, ref): what a targeted search within the reference's document finds for the first references of each list, less what the
    list has (``known``: by, id); each chunk at its first reference. ``found``: (by, rank, family, reference, start, document_id);
    ``search`` maps (ref_id, q) to candidates (ref_id, id, rank, document_id). Equal references are searched once."""
    n = F.row_number().over(Window.partitionBy(by).orderBy("rank", "family", "start"))
    first = found.withColumn("ref", n).where(F.col("ref") <= most).select(by, "ref", "reference", "document_id")
    asked = first.select("reference").distinct().withColumn("ref_id", F.xxhash64("reference"))
    hits = search(asked.select("ref_id", F.concat(F.lit("content of "), "reference").alias("q")))
    got = first.withColumn("ref_id", F.xxhash64("reference")).join(hits.select("ref_id", "id", "rank", "document_id"), ["ref_id", "document_id"])
    got = got.withColumn("place", F.row_number().over(Window.partitionBy(by, "ref").orderBy("rank"))).where(F.col("place") <= k)
    return got.groupBy(by, "id").agg(F.min("ref").alias("ref")).join(known.select(by, "id"), [by, "id"], "left_anti")


def factual(sentence: Column) -> Column:
    return sentence.rlike("(?i)" + "|".join(FACTUAL))


def compress(rows: DataFrame, q: str, text: str, least: float = 0.15, budget: int = 2000, least_sentences: int = 1) -> DataFrame:
    """Relevant or factual sentences of each chunk (query_id, id, rank) in order, the best ones where fewer than ``least_sentences``
    are; texts of no more sentences stay whole. Chunks are taken until the budget of words is reached; the one that crosses it
    stays. Adds compressed, words, words_before, kept and dropped."""
    keys = ["query_id", "id", "rank"]
    s = rows.select(*keys, F.col(q).alias("_q"), F.posexplode(sentences(F.col(text))).alias("pos", "s"))
    sim = tfidf_cosine(s, "_q", "s", [*keys, "pos", "s"])
    chunk = Window.partitionBy(*keys)
    sim = sim.withColumn("keep", (F.col("sim") >= least) | factual(F.col("s"))).withColumn("n", F.count("*").over(chunk)).withColumn("n_keep", F.count_if("keep").over(chunk))
    sim = sim.withColumn("place", F.row_number().over(chunk.orderBy(F.desc("sim"), "pos")))
    keep = F.col("keep") | ((F.col("n_keep") < least_sentences) & (F.col("place") <= least_sentences))
    got = sim.groupBy(*keys, "n").agg(F.sort_array(F.collect_list(F.when(keep, F.struct("pos", "s")))).alias("l"))
    got = got.select(*keys, "n", F.array_join(F.transform("l", lambda x: x["s"]), " ").alias("c"), F.size("l").cast("long").alias("kept"))
    out = rows.join(got, keys, "left").withColumn("whole", F.coalesce(F.col("n") <= least_sentences, F.lit(True)))
    out = out.withColumn("compressed", F.when(F.col("whole"), F.col(text)).otherwise(F.col("c"))).withColumn("words", n_words(F.col("compressed")))
    kept = F.when(F.col("whole"), F.coalesce("n", F.lit(0))).otherwise(F.col("kept"))
    out = out.select(*keys, "compressed", "words", n_words(F.col(text)).alias("words_before"), kept.alias("kept"), (F.coalesce("n", F.lit(0)) - kept).alias("dropped"))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("before", F.coalesce(F.sum("words").over(w), F.lit(0))).where(F.col("before") < budget).drop("before")


def compression_totals(compressed: DataFrame) -> DataFrame:
    """Words before and after, ratio 1 - after / before (0 without words), sentences kept and dropped, for each query."""
    g = compressed.groupBy("query_id").agg(F.sum("words_before").alias("words_before"), F.sum("words").alias("words_after"), F.sum("kept").alias("kept"), F.sum("dropped").alias("dropped"))
    return g.withColumn("ratio", F.round(F.coalesce(1 - F.try_divide("words_after", "words_before"), F.lit(0.0)), 4))


def authority(filename: Column) -> Column:
    ext = F.element_at(F.split(F.lower(filename), r"\."), -1)
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in AUTHORITY.items() for x in (F.lit(k), F.lit(v))]), ext), F.lit(0.5))


def freshness(age_days: Column) -> Column:
    return F.when(age_days.isNull(), 0.5).otherwise(F.greatest(F.lit(0.1), 1 - age_days / 365))


def agreement(rows: DataFrame, by: str = "query_id") -> DataFrame:
    """Mean Jaccard of each chunk with the first five others of its list, by rank; 0.5 alone."""
    w = rows.select(by, "id", "rank", F.array_distinct(blank_words(F.lower("text"))).alias("w"))
    first = w.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("rank"))).where("place <= 6").select(by, F.col("id").alias("o_id"), F.col("rank").alias("o_rank"), F.col("w").alias("o_w"))
    p = w.join(first, by).where("id <> o_id")
    p = p.withColumn("n", F.row_number().over(Window.partitionBy(by, "id").orderBy("o_rank"))).where("n <= 5 AND size(o_w) > 0")
    g = p.groupBy(by, "id").agg(F.avg(jaccard(F.col("w"), F.col("o_w"))).alias("agreement"))
    return w.select(by, "id").join(g, [by, "id"], "left").withColumn("agreement", F.coalesce("agreement", F.lit(0.5)))


def confidence(rows: DataFrame, by: str = "query_id", threshold: float = 0.65) -> DataFrame:
    """Gate of each query from rows (by, id, rank, score, text, filename, age_days): best and mean confidence, weak chunks, passed."""
    a = agreement(rows, by)
    retrieval = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("score") + 10) / 20))
    c = rows.join(a, [by, "id"]).withColumn("c", F.round(retrieval * 0.5 + freshness(F.col("age_days")) * 0.2 + authority(F.col("filename")) * 0.2 + F.col("agreement") * 0.1, 6))
    g = c.groupBy(by).agg(F.max("c").alias("best"), F.round(F.avg("c"), 4).alias("mean"), F.count_if(F.col("c") < threshold).alias("weak"))
    return g.select(by, F.round("best", 4).alias("best"), "mean", "weak", (F.col("best") >= threshold).alias("passed"))


def groundedness(answer: Column, context: Column) -> Column:
    words = F.array_except(F.array_distinct(blank_words(F.lower(answer))), strings(GROUND_STOPWORDS))
    return F.when(F.size(blank_words(answer)) == 0, 0.0).when(F.size(words) == 0, 0.5).otherwise(overlap(words, blank_words(F.lower(context))))


def faithfulness(answer: Column, context: Column) -> Column:
    words = lambda t: F.filter(F.array_distinct(blank_words(F.lower(t))), lambda w: w.rlike(r"^[\p{L}\p{N}]+$") | (F.length(w) > 1))
    return F.coalesce(overlap(words(answer), words(context)), F.lit(0.5))


def quality_label(score: Column) -> Column:
    return F.when(score >= 0.8, "excellent").when(score >= 0.65, "good").when(score >= 0.5, "acceptable").when(score >= 0.35, "poor").otherwise("failing")


class Finder:
    """The queries of a group any of whose keywords a text holds as a substring; one pass over the text, whatever their number."""

    def __init__(self, words: dict[str, list[tuple[int, int]]]):
        self.words, self.automaton = words, None

    def __getstate__(self):
        return self.words

    def __setstate__(self, words):
        self.__init__(words)

    def find(self, text: str, group: int) -> list[int]:
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for word, queries in self.words.items():
                self.automaton.add_word(word, queries)
            self.automaton.make_automaton()
        seen = {id(queries): queries for _, queries in self.automaton.iter(text)}
        return sorted({q for queries in seen.values() for g, q in queries if g == group})


def keyword_matches(docs: DataFrame, queries: DataFrame, block: int = 20_000) -> DataFrame:
    """(query_id, id, source) for documents (id, grp, text, source) that hold a keyword of a query (query_id, grp, keywords) of their
    group. Keywords go out in blocks of bounded number, one scan a block; a text is searched once for all of them."""
    spark = docs.sparkSession
    rows = queries.select("grp", "query_id", F.explode(F.array_distinct("keywords")).alias("k")).groupBy("k").agg(F.collect_list(F.struct("grp", "query_id")).alias("q"))
    out, words = None, {}

    def scan(words):
        sent = spark.sparkContext.broadcast(Finder(words))

        @F.pandas_udf("array<long>")
        def find(texts: pd.Series, groups: pd.Series) -> pd.Series:
            finder = sent.value
            return pd.Series([finder.find(t, g) for t, g in zip(texts, groups)])

        return docs.select("id", "source", F.explode(find(F.lower(F.coalesce("text", F.lit(""))), F.col("grp").cast("long"))).alias("query_id"))

    for r in rows.toLocalIterator():
        words[r["k"]] = [(x["grp"], x["query_id"]) for x in r["q"]]
        if len(words) == block:
            out, words = scan(words) if out is None else out.unionByName(scan(words)), {}
    blocks = out is not None
    if words or not blocks:
        out = scan(words) if words and not blocks else out.unionByName(scan(words)) if words else docs.select("id", "source", F.lit(0).cast("long").alias("query_id")).where("false")
    return out.dropDuplicates(["query_id", "id"]) if blocks else out


def absence(docs: DataFrame, queries: DataFrame, sample: int = 5) -> DataFrame:
    """For each query (query_id, grp, keywords): documents of its group scanned, matching ones, sources, first ids. Counts are
    combined before the shuffle, and the sample is the top of a window that Spark limits in every task."""
    total = docs.groupBy("grp").agg(F.count("*").alias("total"))
    hit = keyword_matches(docs, queries)
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("id"))
    first = hit.select("query_id", "id", n.alias("n")).where(F.col("n") <= sample).groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("sample"))
    g = hit.groupBy("query_id").agg(F.count("*").alias("matching"), F.count_distinct("source").alias("sources")).join(first, "query_id")
    out = queries.select("query_id", "grp").join(g, "query_id", "left").join(F.broadcast(total), "grp", "left")  # a row a group
    return out.select("query_id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("matching", F.lit(0)).alias("matching"), F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("sample", F.lit("")).alias("sample"))


def prove_or_retry(keywords: Column, matching: Column, retried: Column) -> Column:
    """Inconclusive without keywords, absent where the scan finds nothing or a retry within its sources does not, else a retry."""
    return F.when(F.size(keywords) == 0, "inconclusive").when(matching == 0, "proven_absent").when(retried > 0, "retry_triggered").otherwise("proven_absent")


def not_found(answer: Column) -> Column:
    """Whether an answer says that nothing was found."""
    return has_any(F.lower(answer), NOT_FOUND)


WEIGHTS = {"context_relevance": 0.25, "faithfulness": 0.35, "answer_relevance": 0.25, "groundedness": 0.15}


def claims(answer: Column) -> Column:
    return F.filter(F.transform(F.split(answer, r"\."), lambda s: F.trim(s)), lambda s: F.length(s) > 10)


def ragas(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Answer quality of each query from its ranked chunks (query_id, rank, q, chunk) and (query_id, answer): the four measures,
    their weighted sum, risk and label."""
    q = rows.select("query_id", F.col("q").alias("text")).dropDuplicates(["query_id"])
    top = rows.where("rank <= 5")
    cr = tfidf_against(with_base(top, "chunk", q), ["query_id"], "member", "text", digits=12).groupBy("query_id").agg(F.avg("sim").alias("context_relevance"))
    joined = lambda df: df.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk"))), lambda x: x["chunk"]), " ").alias("text"))
    parts = answers.select("query_id", F.posexplode(claims(F.col("answer"))).alias("pos", "text")).select("query_id", (F.col("pos") + 1).alias("member"), "text")
    lists = parts.unionByName(joined(top).select("query_id", F.lit(0).alias("member"), "text"))
    f = tfidf_against(lists, ["query_id"], "member", "text", digits=12).groupBy("query_id").agg(F.avg("sim").alias("faithfulness"))
    pair = answers.join(q, "query_id")
    ar = tfidf_cosine(pair, "text", "answer", ["query_id"], digits=12).withColumnRenamed("sim", "answer_relevance")
    g = answers.join(joined(rows), "query_id").select("query_id", groundedness(F.col("answer"), F.col("text")).alias("groundedness"))
    out = answers.select("query_id").join(cr, "query_id", "left").join(f, "query_id", "left").join(ar, "query_id", "left").join(g, "query_id", "left")
    c = {"context_relevance": F.coalesce("context_relevance", F.lit(0.0)), "faithfulness": F.coalesce("faithfulness", F.lit(0.5)), "answer_relevance": F.coalesce("answer_relevance", F.lit(0.0)), "groundedness": F.coalesce("groundedness", F.lit(0.0))}
    overall = sum(v * WEIGHTS[n] for n, v in c.items())
    risk = F.when(c["faithfulness"] >= 0.75, "low").when(c["faithfulness"] >= 0.5, "medium").otherwise("high")
    return out.select("query_id", *[F.round(v, 4).alias(n) for n, v in c.items()], F.round(overall, 4).alias("overall"), risk.alias("risk"), quality_label(F.round(overall, 4)).alias("label"))


DESCRIPTIONS = {
    "context_relevance": "How relevant were retrieved chunks to your query", "faithfulness": "How well the answer is supported by retrieved context",
    "answer_relevance": "How directly the answer addresses your question", "groundedness": "How much the answer relies on retrieved sources vs model knowledge",
}


def display(scores: DataFrame) -> DataFrame:
    """(query_id, shown): the measures with labels and descriptions as JSON, as a frontend shows them."""
    each = [F.struct(F.col(n).alias("score"), quality_label(F.col(n)).alias("label"), F.lit(d).alias("description")).alias(n) for n, d in DESCRIPTIONS.items()]
    whole = F.struct(*each, F.col("overall").alias("overall_score"), F.col("risk").alias("hallucination_risk"), F.lit("tfidf_deterministic").alias("evaluation_method"))
    return scores.select("query_id", F.to_json(F.struct(whole.alias("ragas_metrics"))).alias("shown"))


def grounding(rows: DataFrame, answers: DataFrame, most: int = 500) -> DataFrame:
    """The best cosine of an answer with a chunk (TF-IDF of the ``most`` frequent terms), its complement as risk, faithfulness by
    overlap, their sum .6 / .4 and its label."""
    sims = tfidf_against(with_base(rows, "chunk", answers.select("query_id", F.col("answer").alias("text"))), ["query_id"], "member", "text", digits=12, most=most)
    best = sims.groupBy("query_id").agg(F.max("sim").alias("grounding"))
    context = rows.groupBy("query_id").agg(F.array_join(F.collect_list("chunk"), " ").alias("context"))
    out = answers.join(context, "query_id", "left").join(best, "query_id", "left")
    g = F.when(F.trim("answer") == "", 0.5).otherwise(F.coalesce("grounding", F.lit(0.5)))
    f = F.when(F.trim("answer") == "", 0.5).otherwise(F.coalesce(faithfulness(F.col("answer"), F.col("context")), F.lit(0.5)))
    out = out.select("query_id", g.alias("g"), f.alias("f")).withColumn("overall", F.round(F.col("g") * 0.6 + F.col("f") * 0.4, 4))
    label = F.when(F.col("overall") > 0.8, "EXCELLENT").when(F.col("overall") > 0.6, "GOOD").when(F.col("overall") > 0.4, "FAIR").otherwise("POOR")
    return out.select("query_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("g"))), 4).alias("hallucination"), F.round("f", 4).alias("faithfulness"), "overall", label.alias("label"))


_FV = ", ".join(f"list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i){p}', {g}), lambda v: trim(lower(v))))) AS {n}" for n, p, g in FACTS)
_DIFF = lambda n: f"(len(a.{n}) > 0 AND len(b.{n}) > 0 AND a.{n} <> b.{n})"
_CONF = f"WITH v AS (SELECT query_id, id, {_FV} FROM {{facts}}), p AS (SELECT a.query_id, a.id AS a_id, b.id AS b_id, list_filter([" + ", ".join(f"CASE WHEN {_DIFF(n)} THEN '{n}' END" for n, _, _ in FACTS) + "], lambda x: x IS NOT NULL) AS fam FROM v a JOIN v b ON a.query_id = b.query_id AND a.id < b.id)"


@query(_CONF + " SELECT query_id, a_id, b_id, array_to_string(fam, ',') AS families, CASE WHEN list_contains(fam, 'amount') THEN 'amount_conflict' WHEN list_contains(fam, 'percentage') THEN 'percentage_conflict' WHEN list_contains(fam, 'duration') THEN 'duration_conflict' WHEN list_contains(fam, 'month_day') OR list_contains(fam, 'month_year') THEN 'date_conflict' ELSE 'value_conflict' END AS kind FROM p WHERE len(fam) > 0")
def conflicts(spark, sf_dir):
    return conflict_pairs(facts(spark, sf_dir))


@query(_CONF + " SELECT query_id, count(*) AS n, CASE WHEN count(*) > 2 THEN 'high' ELSE 'low' END AS severity FROM p WHERE len(fam) > 0 GROUP BY query_id")
def conflict_severity(spark, sf_dir):
    return conflict_summary(conflict_pairs(facts(spark, sf_dir)))


@query(_CONF + " SELECT DISTINCT query_id, unnest([a_id, b_id]) AS id FROM p WHERE len(fam) > 0")
def conflict_ids(spark, sf_dir):
    """The chunks of each list that a conflict names."""
    return conflict_pairs(facts(spark, sf_dir)).select("query_id", F.explode(F.array("a_id", "b_id")).alias("id")).distinct()


@query("SELECT id, family, reference, CAST(count(*) AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT id, {i} AS family, trim(unnest(regexp_extract_all(text, '(?i){p}'))) AS reference FROM {{facts}}" for i, p in enumerate(REFERENCES)) + ") GROUP BY ALL")
def xref_detect(spark, sf_dir):
    """References by family; their places are checked against the text."""
    f = facts(spark, sf_dir)
    r = references(f, ["id", "text"]).where(F.trim(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))) == F.col("reference"))
    return r.groupBy("id", "family", "reference").agg(F.count("*").alias("n"))


_XREF = "fl AS (SELECT id, id % 5 AS doc, query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM {facts}), xr AS (" + " UNION ALL ".join(f"SELECT query_id, rank, doc, {i} AS family, trim(unnest(regexp_extract_all(text, '(?i){p}'))) AS reference FROM fl" for i, p in enumerate(REFERENCES)) + ")"


@query(f"""WITH {_XREF}, x3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, family) AS ref FROM xr QUALIFY ref <= 3),
{bm25_sql("(SELECT DISTINCT reference AS query_id, 'content of ' || reference AS text FROM x3)", 40)},
xp AS (SELECT x3.query_id, ref, lex.id, row_number() OVER (PARTITION BY x3.query_id, ref ORDER BY lex.rank) AS place FROM x3 JOIN lex ON lex.query_id = x3.reference AND lex.id % 5 = x3.doc)
SELECT query_id, id, CAST(min(ref) AS INT) AS ref FROM xp WHERE place <= 3 GROUP BY ALL""")
def xref_resolve(spark, sf_dir):
    """The first three references of each list, searched for within the chunk's own document (here a fifth of the corpus by the last
    digit); each hit at the first that finds it."""
    f = facts(spark, sf_dir)
    lists = f.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).withColumn("document_id", F.col("id") % 5)
    found = references(lists, ["query_id", "rank", "document_id"])

    def search(asked):
        hits = lexical(_index(spark, sf_dir), asked.withColumnRenamed("ref_id", "query_id"), candidate_k(3))
        return hits.withColumnRenamed("query_id", "ref_id").withColumn("document_id", F.col("id") % 5)

    return resolve(found, search, lists.select("query_id", (-F.col("id") - 1).alias("id")))


@query("SELECT id, " + " OR ".join(f"regexp_matches(text, '(?i){p}')" for p in FACTUAL) + " AS factual FROM {facts}")
def factual_sentences(spark, sf_dir):
    return facts(spark, sf_dir).select("id", factual(F.col("text")).alias("factual"))


_ROWS = f"WITH {_BM25}, r AS (SELECT query_id, lex.id, rank, score, d.content AS text, d.filename, d.upload_day AS age_days FROM lex JOIN {{document}} d ON d.id = lex.id)"
_AGREE = r""", w AS (SELECT query_id, id, rank, list_distinct(list_filter(string_split_regex(lower(text), '[ \t\r\n]+'), lambda x: x <> '')) AS w FROM r),
pr AS (SELECT a.query_id, a.id, a.w AS aw, b.w AS bw, row_number() OVER (PARTITION BY a.query_id, a.id ORDER BY b.rank) AS k FROM w a JOIN w b ON a.query_id = b.query_id AND a.id <> b.id),
ag AS (SELECT query_id, id, avg(len(list_intersect(aw, bw)) / CAST(len(list_distinct(list_concat(aw, bw))) AS DOUBLE)) AS agreement FROM pr WHERE k <= 5 GROUP BY ALL)"""


def _rows(spark, d):
    docs = document(spark, d).select("id", F.col("content").alias("text"), "filename", F.col("upload_day").alias("age_days"))
    return cut(bm25_topk(spark, d).join(docs, "id"))


@query(_ROWS + _AGREE + " SELECT query_id, id, round(agreement, 4) AS agreement FROM ag")
def agreement_jaccard(spark, sf_dir):
    return agreement(_rows(spark, sf_dir)).withColumn("agreement", F.round("agreement", 4))


@query(_ROWS + _AGREE + """, c AS (SELECT query_id, round(greatest(0.0, least(1.0, (score + 10) / 20)) * 0.5 + greatest(0.1, 1 - age_days / 365.0) * 0.2 + CASE WHEN filename LIKE '%.pdf' THEN 0.8 WHEN filename LIKE '%.docx' THEN 0.75 WHEN filename LIKE '%.md' THEN 0.65 WHEN filename LIKE '%.txt' THEN 0.6 ELSE 0.5 END * 0.2 + agreement * 0.1, 6) AS c FROM r JOIN ag USING (query_id, id))
SELECT query_id, round(max(c), 4) AS best, round(avg(c), 4) AS mean, CAST(count_if(c < 0.65) AS BIGINT) AS weak, max(c) >= 0.65 AS passed FROM c GROUP BY query_id""")
def confidence_gate(spark, sf_dir):
    return confidence(_rows(spark, sf_dir))


_LW = r"list_filter(string_split_regex(lower({}), '[ \t\r\n]+'), lambda x: x <> '')"
_TURN = f"WITH p AS (SELECT session_id, turn, content AS answer, lag(content) OVER (PARTITION BY session_id ORDER BY turn) AS context FROM {{turns}}), w AS (SELECT session_id, turn, list_distinct({_LW.format('answer')}) AS a, {_LW.format('context')} AS c FROM p WHERE context IS NOT NULL)"


def _answered(spark, d):
    t = turns(spark, d)
    return t.withColumn("context", F.lag("content").over(Window.partitionBy("session_id").orderBy("turn"))).where("context IS NOT NULL")


@query(_TURN + f", s AS (SELECT *, list_filter(a, lambda x: NOT list_contains([{', '.join(repr(x) for x in GROUND_STOPWORDS)}], x)) AS g FROM w) SELECT session_id, turn, CAST(round(CASE WHEN len(a) = 0 THEN 0.0 WHEN len(g) = 0 THEN 0.5 ELSE len(list_intersect(g, c)) / CAST(len(g) AS DOUBLE) END, 4) AS DOUBLE) AS groundedness FROM s")
def groundedness_score(spark, sf_dir):
    return _answered(spark, sf_dir).select("session_id", "turn", F.round(groundedness(F.col("content"), F.col("context")), 4).alias("groundedness"))


_FW = lambda c: f"list_filter({c}, lambda w: regexp_matches(w, '^[\\p{{L}}\\p{{N}}]+$') OR length(w) > 1)"


@query(_TURN + f" SELECT session_id, turn, CAST(round(CASE WHEN len({_FW('a')}) > 0 THEN len(list_intersect({_FW('a')}, {_FW('c')})) / CAST(len({_FW('a')}) AS DOUBLE) ELSE 0.5 END, 4) AS DOUBLE) AS faithfulness FROM w")
def faithfulness_overlap(spark, sf_dir):
    return _answered(spark, sf_dir).select("session_id", "turn", F.round(faithfulness(F.col("content"), F.col("context")), 4).alias("faithfulness"))


@query(_TURN + f", s AS (SELECT session_id, turn, round(CASE WHEN len({_FW('a')}) > 0 THEN len(list_intersect({_FW('a')}, {_FW('c')})) / CAST(len({_FW('a')}) AS DOUBLE) ELSE 0.5 END, 6) AS f FROM w) SELECT session_id, turn, CASE WHEN f >= 0.8 THEN 'excellent' WHEN f >= 0.65 THEN 'good' WHEN f >= 0.5 THEN 'acceptable' WHEN f >= 0.35 THEN 'poor' ELSE 'failing' END AS label, CASE WHEN 1 - f >= 0.75 THEN 'high' WHEN 1 - f >= 0.5 THEN 'medium' ELSE 'low' END AS risk FROM s")
def quality_labels(spark, sf_dir):
    f = F.round(faithfulness(F.col("content"), F.col("context")), 6)
    a = _answered(spark, sf_dir).select("session_id", "turn", f.alias("f"))
    return a.select("session_id", "turn", quality_label(F.col("f")).alias("label"), F.when(1 - F.col("f") >= 0.75, "high").when(1 - F.col("f") >= 0.5, "medium").otherwise("low").alias("risk"))


_KEYS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: regexp_matches(w, '^[a-z]{3,}$') AND NOT list_contains([" + ", ".join(f"'{w}'" for w in KEYWORD_STOPWORDS) + "], w))"
_ABSENCE = f"""k AS (SELECT item_id AS query_id, item_id % 4 AS grp, {_KEYS} AS kw FROM benchmark),
ad AS (SELECT id, project_id AS grp, lower(content) AS low, filename FROM {{document}} WHERE is_active),
kh AS (SELECT query_id, id, filename FROM k JOIN ad USING (grp) WHERE len(list_filter(kw, lambda w: contains(low, w))) > 0)"""


def _absence_inputs(spark, d):
    docs = document(spark, d).where("is_active").select("id", F.col("project_id").alias("grp"), F.col("content").alias("text"), F.col("filename").alias("source"))
    return docs, _items(spark, d).select("query_id", (F.col("query_id") % 4).alias("grp"), keyword_list(F.col("q")).alias("keywords"))


@query(f"""WITH {_ABSENCE}, kn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS n FROM kh),
g AS (SELECT query_id, count(*) AS m, count(DISTINCT filename) AS s, string_agg(CASE WHEN n <= 5 THEN CAST(id AS VARCHAR) END, ',' ORDER BY id) AS sample FROM kn GROUP BY query_id)
SELECT query_id, (SELECT count(*) FROM ad WHERE ad.grp = k.grp) AS total, coalesce(m, 0) AS matching, coalesce(s, 0) AS sources, coalesce(sample, '') AS sample FROM k LEFT JOIN g USING (query_id)""")
def absence_scan(spark, sf_dir):
    """All keywords of each item against all active documents of its project."""
    return absence(*_absence_inputs(spark, sf_dir))


_RETRY = _HYBRID.replace("FROM sem JOIN act USING (id)", "FROM sem JOIN act USING (id) JOIN kh USING (query_id, id)").replace("FROM lexg JOIN act USING (id)", "FROM lexg JOIN act USING (id) JOIN kh USING (query_id, id)").replace("WITH ", f"WITH {_ABSENCE}, ", 1)


@query(f"{_RETRY}, r AS (SELECT query_id, count(*) AS n FROM hy GROUP BY 1), m AS (SELECT query_id, count(*) AS m FROM kh GROUP BY 1) SELECT k.query_id, CASE WHEN len(kw) = 0 THEN 'inconclusive' WHEN m IS NULL THEN 'proven_absent' WHEN n > 0 THEN 'retry_triggered' ELSE 'proven_absent' END AS action, CAST(coalesce(n, 0) AS BIGINT) AS retried FROM k LEFT JOIN r USING (query_id) LEFT JOIN m USING (query_id)")
def absence_retry(spark, sf_dir):
    """Prove or retry: the hybrid search once more, within the sources in which the scan found keywords."""
    docs, asked = _absence_inputs(spark, sf_dir)
    hit = keyword_matches(docs, asked)
    sem, lex = hybrid_lists(spark, sf_dir)
    listed = sem.select("query_id", "id").unionByName(lex.select("query_id", "id")).distinct()
    d = document(spark, sf_dir)
    again = hybrid(sem, lex, d, 5, d.where("NOT is_active").select("id"), listed.join(hit, ["query_id", "id"], "left_semi"))
    out = asked.join(hit.groupBy("query_id").agg(F.count("*").alias("m")), "query_id", "left").join(again.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left")
    m, n = F.coalesce("m", F.lit(0)), F.coalesce("n", F.lit(0))
    return out.select("query_id", prove_or_retry(F.col("keywords"), m, n).alias("action"), n.alias("retried"))


# Word boundaries are those of any letters, as in Spark's regular expressions; DuckDB's know ASCII only.
_BOUND = lambda p: (EDGE if p.startswith(r"\b") else "") + p.removeprefix(r"\b").removesuffix(r"\b") + (END if p.endswith(r"\b") else "")
_FACTUAL_SQL = " OR ".join(f"regexp_matches(s, '(?i){_BOUND(p)}')" for p in FACTUAL)
_NW = lambda c: f"len(list_filter(string_split_regex({c}, '[ \\t\\r\\n]+'), lambda x: x <> ''))"
_COMPRESS = _PAIRS + f""", sl AS (SELECT query_id, id, rank, a, b, {sentences_sql('b')} AS ss FROM c),
se AS (SELECT query_id, id, rank, a, unnest(ss) AS s, unnest(range(len(ss))) AS pos FROM sl),
sk AS (SELECT query_id, id, pos, t, sum(x) AS x, sum(y) AS y FROM (SELECT query_id, id, pos, unnest({words_sql('a')}) AS t, 1 AS x, 0 AS y FROM se UNION ALL SELECT query_id, id, pos, unnest({words_sql('s')}), 0, 1 FROM se) GROUP BY ALL),
ssim AS (SELECT query_id, id, pos, round(coalesce(sum(i * x * y) / nullif(sqrt(sum(i * x * x)) * sqrt(sum(i * y * y)), 0), 0.0), 4) AS sim FROM (SELECT *, pow(ln(3.0 / (1 + CAST(x > 0 AS INT) + CAST(y > 0 AS INT))) + 1, 2) AS i FROM sk) GROUP BY ALL),
sq AS (SELECT se.*, coalesce(sim, 0.0) >= 0.15 OR {_FACTUAL_SQL} AS keep, row_number() OVER (PARTITION BY query_id, id ORDER BY coalesce(sim, 0.0) DESC, pos) AS place, count(*) OVER (PARTITION BY query_id, id) AS n FROM se LEFT JOIN ssim USING (query_id, id, pos)),
sm AS (SELECT query_id, id, n, string_agg(s, ' ' ORDER BY pos) FILTER (keep OR (nk = 0 AND place = 1)) AS t, count(*) FILTER (keep OR (nk = 0 AND place = 1)) AS kept FROM (SELECT *, count_if(keep) OVER (PARTITION BY query_id, id) AS nk FROM sq) GROUP BY ALL),
cw AS (SELECT c.query_id, c.id, c.rank, CASE WHEN coalesce(n, 0) <= 1 THEN b ELSE t END AS compressed, {_NW('b')} AS words_before, CASE WHEN coalesce(n, 0) <= 1 THEN coalesce(n, 0) ELSE kept END AS kept, coalesce(n, 0) AS n FROM c LEFT JOIN sm USING (query_id, id)),
cx AS (SELECT *, {_NW('compressed')} AS words FROM cw), cb AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cx)"""


@query(f"{_COMPRESS} SELECT query_id, id, rank, compressed, words, words_before, kept, n - kept AS dropped FROM cb WHERE before < 2000")
def sentence_compression(spark, sf_dir):
    return compress(_retrieved(spark, sf_dir), "q", "chunk")


@query(f"{_COMPRESS} SELECT query_id, CAST(sum(words_before) AS BIGINT) AS words_before, CAST(sum(words) AS BIGINT) AS words_after, CAST(sum(kept) AS BIGINT) AS kept, CAST(sum(n - kept) AS BIGINT) AS dropped, round(coalesce(1 - sum(words) / CAST(nullif(sum(words_before), 0) AS DOUBLE), 0), 4) AS ratio FROM cb WHERE before < 2000 GROUP BY query_id")
def compression_ratio(spark, sf_dir):
    return compression_totals(compress(_retrieved(spark, sf_dir), "q", "chunk"))


def _answers(spark, d):
    """Each item's answer: the beginning of the second chunk found for it."""
    rows = _retrieved(spark, d)
    return rows, rows.where("rank = 2").select("query_id", F.substring("chunk", 1, 400).alias("answer"))


_ANS = _PAIRS + ", an AS (SELECT query_id, substr(b, 1, 400) AS answer FROM c WHERE rank = 2)"
_QUALITY = lambda c: f"CASE WHEN {c} >= 0.8 THEN 'excellent' WHEN {c} >= 0.65 THEN 'good' WHEN {c} >= 0.5 THEN 'acceptable' WHEN {c} >= 0.35 THEN 'poor' ELSE 'failing' END"
_exact = lambda sql, tag: sql.replace("ltf", f"ltf{tag}").replace("lsz", f"lsz{tag}").replace("ldf", f"ldf{tag}").replace("lw AS", f"lw{tag} AS").replace("FROM lw ", f"FROM lw{tag} ").replace("lsum", f"lsum{tag}").replace("sims AS", f"sims{tag} AS").replace(", 4) AS sim", ", 12) AS sim")
_STOPG = "[" + ", ".join(repr(x) for x in GROUND_STOPWORDS) + "]"


_RAGAS = _ANS + f""", l1 AS (SELECT query_id, rank AS member, b AS text FROM c UNION ALL SELECT item_id, 0, text FROM benchmark), {_exact(against_sql('l1', 'query_id'), 1)},
cr AS (SELECT query_id, avg(sim) AS context_relevance FROM sims1 GROUP BY 1),
jn AS (SELECT query_id, string_agg(b, ' ' ORDER BY rank) AS ctx FROM c GROUP BY 1),
cl AS (SELECT query_id, list_filter(list_transform(string_split(answer, '.'), lambda s: trim(s)), lambda s: length(s) > 10) AS ss FROM an),
l2 AS (SELECT query_id, unnest(range(1, len(ss) + 1)) AS member, unnest(ss) AS text FROM cl UNION ALL SELECT query_id, 0, ctx FROM jn), {_exact(against_sql('l2', 'query_id'), 2)},
fa AS (SELECT query_id, avg(sim) AS faithfulness FROM sims2 GROUP BY 1),
l3 AS (SELECT query_id, 1 AS member, answer AS text FROM an UNION ALL SELECT item_id, 0, text FROM benchmark WHERE item_id IN (SELECT query_id FROM an)), {_exact(against_sql('l3', 'query_id'), 3)},
gw AS (SELECT query_id, list_filter(string_split_regex(answer, '[ \\t\\r\\n]+'), lambda x: x <> '') AS aw, list_filter(list_distinct(list_filter(string_split_regex(lower(answer), '[ \\t\\r\\n]+'), lambda x: x <> '')), lambda x: NOT list_contains({_STOPG}, x)) AS g, list_filter(string_split_regex(lower(ctx), '[ \\t\\r\\n]+'), lambda x: x <> '') AS cw FROM an JOIN jn USING (query_id)),
gr AS (SELECT query_id, CASE WHEN len(aw) = 0 THEN 0.0 WHEN len(g) = 0 THEN 0.5 ELSE len(list_intersect(g, cw)) / CAST(len(g) AS DOUBLE) END AS groundedness FROM gw),
rg AS (SELECT an.query_id, coalesce(context_relevance, 0.0) AS cr, coalesce(faithfulness, 0.5) AS fa, coalesce(sims3.sim, 0.0) AS ar, coalesce(groundedness, 0.0) AS gr FROM an LEFT JOIN cr USING (query_id) LEFT JOIN fa USING (query_id) LEFT JOIN sims3 USING (query_id) LEFT JOIN gr USING (query_id)),
ro AS (SELECT *, cr * 0.25 + fa * 0.35 + ar * 0.25 + gr * 0.15 AS ov FROM rg)"""


@query(f"{_RAGAS} SELECT query_id, round(cr, 4) AS context_relevance, round(fa, 4) AS faithfulness, round(ar, 4) AS answer_relevance, CAST(round(gr, 4) AS DOUBLE) AS groundedness, round(ov, 4) AS overall, CASE WHEN fa >= 0.75 THEN 'low' WHEN fa >= 0.5 THEN 'medium' ELSE 'high' END AS risk, {_QUALITY('round(ov, 4)')} AS label FROM ro")
def ragas_overall(spark, sf_dir):
    return ragas(*_answers(spark, sf_dir))


@query(f"{_RAGAS} SELECT query_id, CAST(round(fa, 4) AS DOUBLE) AS faithfulness, {_QUALITY('round(fa, 4)')} AS label, 'tfidf_deterministic' AS method FROM ro")
def ragas_display(spark, sf_dir):
    """The JSON that is shown, read back."""
    shown = display(ragas(*_answers(spark, sf_dir)))
    j = lambda path: F.get_json_object("shown", f"$.ragas_metrics.{path}")
    return shown.select("query_id", j("faithfulness.score").cast("double").alias("faithfulness"), j("faithfulness.label").alias("label"), j("evaluation_method").alias("method"))


@query(_ANS + f""", l1 AS (SELECT query_id, rank AS member, b AS text FROM c UNION ALL SELECT query_id, 0, answer FROM an), {_exact(against_sql('l1', 'query_id', 500), 1)},
gb AS (SELECT query_id, max(sim) AS g FROM sims1 GROUP BY 1), jn AS (SELECT query_id, string_agg(b, ' ' ORDER BY rank) AS ctx FROM c GROUP BY 1),
fw AS (SELECT query_id, answer, list_filter(list_distinct(list_filter(string_split_regex(lower(answer), '[ \\t\\r\\n]+'), lambda x: x <> '')), lambda w: regexp_matches(w, '^[\\p{{L}}\\p{{N}}]+$') OR length(w) > 1) AS aw, list_filter(string_split_regex(lower(ctx), '[ \\t\\r\\n]+'), lambda x: x <> '') AS cw FROM an JOIN jn USING (query_id)),
fg AS (SELECT query_id, CASE WHEN trim(answer) = '' THEN 0.5 ELSE coalesce(g, 0.5) END AS g, CASE WHEN trim(answer) = '' OR len(aw) = 0 THEN 0.5 ELSE len(list_intersect(aw, cw)) / CAST(len(aw) AS DOUBLE) END AS f FROM fw LEFT JOIN gb USING (query_id)),
fo AS (SELECT *, round(g * 0.6 + f * 0.4, 4) AS overall FROM fg)
SELECT query_id, round(greatest(0.0, least(1.0, 1 - g)), 4) AS hallucination, CAST(round(f, 4) AS DOUBLE) AS faithfulness, overall, CASE WHEN overall > 0.8 THEN 'EXCELLENT' WHEN overall > 0.6 THEN 'GOOD' WHEN overall > 0.4 THEN 'FAIR' ELSE 'POOR' END AS label FROM fo""")
def grounding_scores(spark, sf_dir):
    return grounding(*_answers(spark, sf_dir))


@query("SELECT session_id, turn, " + " OR ".join(f"contains(lower(content), '{p.replace(chr(39), chr(39) * 2)}')" for p in NOT_FOUND) + " AS not_found FROM {turns}")
def not_found_answers(spark, sf_dir):
    return turns(spark, sf_dir).select("session_id", "turn", not_found(F.col("content")).alias("not_found"))


@query(f"{_COMPRESS} SELECT query_id, id, rank FROM cb WHERE before < 100")
def token_budget(spark, sf_dir):
    """The chunks that a budget of a hundred compressed words takes, the crossing one included."""
    return compress(_retrieved(spark, sf_dir), "q", "chunk", budget=100).select("query_id", "id", "rank")


@query(r"WITH w AS (SELECT session_id, turn, content, len(list_filter(string_split_regex(content, '[ \t\r\n]+'), lambda x: x <> '')) AS n FROM {turns} WHERE role = 'assistant') SELECT session_id, turn, n * 1.3 <= 180 AS length_ok, len(list_filter(string_split(content, '.'), lambda s: length(trim(s)) > 5)) <= 3 AS sentences_ok, contains(content, '- ') OR contains(content, '* ') AS bullets, contains(lower(content), 'doc_') AS cited FROM w")
def contract_verify(spark, sf_dir):
    """Checks of the concise contract (150 tokens, three sentences), and bullets and citations."""
    c = F.col("content")
    n = F.size(F.filter(F.split(c, r"\."), lambda s: F.length(F.trim(s)) > 5))
    return turns(spark, sf_dir).where("role = 'assistant'").select("session_id", "turn", (n_words(c) * 1.3 <= 180).alias("length_ok"), (n <= 3).alias("sentences_ok"), (c.contains("- ") | c.contains("* ")).alias("bullets"), F.lower(c).contains("doc_").alias("cited"))
