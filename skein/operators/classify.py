"""Classifiers and routers over questions: column functions, one pass, no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import EDGE, END, KEYWORD_STOPWORDS, blank_words, has_any, n_of, n_words, strings
from ..plans import query
from ..sources.tables import questions, token_usage, turns

# The phrase lists and patterns of the classifiers.
ANALYTICAL = ["compare", "contrast", "difference", "versus", "vs", "advantage", "disadvantage", "tradeoff", "trade-off", "why", "explain", "how does", "what happens when", "analyze", "evaluate", "assess", "impact", "effect"]
MULTI_HOP = ["led to", "caused by", "resulted in", "chain", "sequence", "first", "then", "finally", "relationship between", "how does x affect y", "what is the connection"]
FACTOID = rf"^(what is|what are|who is|where is|when did|what does|define|definition of|meaning of|how many|how much){END}"
FACTOID_LIST = rf"^(list|name|give me)(?:$|[^\p{{L}}\p{{N}}_].{{0,39}}$)"
CONNECTORS = rf"(?i){EDGE}(and also|furthermore|additionally|moreover|first|then|finally|as well as|in addition|subsequently){END}"
SIGNALS = {
    "factoid": ["what is", "what was", "when did", "who is", "where is", "how much", "how many", "what date", "what time", "is it", "does it", "which one"],
    "analytical": ["why", "how does", "explain", "what causes", "what impact", "analyze", "what led to", "reason for", "effect of", "what happens when", "how would"],
    "comparative": ["compare", "difference between", "vs", "versus", "better than", "worse than", "similar to", "how does x differ", "contrast", "which is better"],
    "procedural": ["how to", "steps to", "process for", "procedure", "guide to", "instructions for", "how do i", "what are the steps", "walk me through"],
    "definitional": ["what does", "define", "meaning of", "definition", "what is meant by", "describe", "tell me about", "overview of", "introduction to"],
}
STRATEGIES = {"factoid": ("fast", 3, False, 3), "analytical": ("deep", 10, True, 8), "comparative": ("parallel", 5, True, 6), "procedural": ("standard", 6, True, 5), "definitional": ("standard", 6, True, 5)}
TIER1 = rf"{EDGE}(total|sum|count|how many|average|mean|maximum|minimum|highest|lowest|percentage|percent|ratio|most|least|top [0-9]+|bottom [0-9]+){END}"
TIER2 = rf"{EDGE}(greater than|less than|more than|fewer than|above|below|over|under|at least|at most|between .* and){END}"
TIER2B = r"([><]=?[ ]*[0-9]+)"
TIER3 = r"^(find|show|list|fetch|get|display|what is|who is|where is|tell me about|describe|explain)"
CHIT_CHAT = r"^(hi|hello|hey|thanks|thank you|ok|okay|got it|sure|great|perfect|yes|no|maybe|correct|wrong|right|exactly)[ \t\n!.]*$|^(explain|summarize|simplify|rephrase|clarify|elaborate)[ \t]+(that|this|it|more)|^(what do you mean|can you repeat|say that again)"
FOLLOW_UP = rf"{EDGE}(it|its|they|their|them|this|that|these|those|he|she|his|her){END}|^(what about|how about|and the|tell me more about|what else|also)|^(can you|could you|would you).*(more|else|also|another|second|third)"
PRONOUNS = ["it", "its", "they", "them", "their", "this", "that", "these", "those", "he", "she", "his", "her"]
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
STOP = r"(?:[ ]+and|[ ]+or|$|,|\?)"
EXCLUDED = [rf"not (?:about|related to|regarding|concerning) ([a-z ]+?){STOP}", rf"excluding ([a-z ]+?){STOP}", rf"except (?:for )?([a-z ]+?){STOP}", rf"without ([a-z ]+?){STOP}"]
SOURCES = [r"(?:from|in) the ([a-z ]+?) (?:document|policy|contract|file|report)", r"(?:from|in) ([a-z ]+?)(?:[ ]+document|[ ]+file|[ ]+policy|$)"]
REASONING = ["compare", "contrast", "analyze", "why", "trade-off", "tradeoff", "design", "architecture", "failure mode", "evaluate", "relationship between", "when should", "how should", "difference between", "impact of"]
FORMATS = [
    ("code", ["code", "function", "script", "implement", "write a", "program", "snippet", "syntax", "example of"]), ("table", ["compare", "difference between", "vs", "versus", "table", "list all", "what are the", "types of"]),
    ("structured", ["list", "enumerate", "what are", "steps to", "how to", "ways to", "features of", "advantages"]), ("detailed", ["explain", "why", "how does", "describe", "elaborate", "analyze", "what causes", "impact of"]),
]
PRICES = {("google", "gemini-1.5-flash"): (0.075, 0.30), ("google", "gemini-1.5-pro"): (3.50, 10.50), ("groq", "llama-3.3-70b-versatile"): (0.70, 0.90), ("groq", "llama-3.1-8b-instant"): (0.05, 0.08)}

lower = lambda q: F.lower(F.trim(q))


def complexity(q: Column) -> Column:
    """struct(complexity, confidence): factoid patterns, then two multi-hop words, then an analytical one, then the length."""
    low = F.lower(F.trim(q))
    hops, why = n_of(low, MULTI_HOP), n_of(low, ANALYTICAL)
    kind = lambda c, p: F.struct(F.lit(c).alias("complexity"), F.round(p, 4).alias("confidence"))
    return (
        F.when(low.rlike(FACTOID) | low.rlike(FACTOID_LIST), kind("factoid", F.lit(0.95)))
        .when(hops >= 2, kind("multi_hop", F.least(0.7 + hops * 0.1, F.lit(0.95)))).when(why >= 1, kind("analytical", F.least(0.6 + why * 0.15, F.lit(0.95))))
        .when(n_words(q) <= 8, kind("factoid", F.lit(0.6))).otherwise(kind("analytical", F.lit(0.55)))
    )


def decompose(q: Column, kind: Column) -> Column:
    """Sub-queries of a multi-hop question: parts (connectors included) of more than 15 characters, if there are two."""
    cut = F.regexp_replace(q, rf"(?i)({EDGE})(and also|furthermore|additionally|moreover|first|then|finally|as well as|in addition|subsequently)(?=[^\p{{L}}\p{{N}}_]|$)", "$1\u0001$2\u0001")
    parts = F.filter(F.transform(F.split(cut, "\u0001"), lambda p: F.trim(p)), lambda p: F.length(p) > 15)
    return F.when((kind == "multi_hop") & (F.size(parts) > 1), parts).otherwise(F.array(q))


def expansion(q: Column, kind: Column) -> Column:
    return F.when(kind == "factoid", q).when(kind == "analytical", F.concat(q, F.lit(" comparison analysis explanation"))).otherwise(F.concat(q, F.lit(" relationship cause effect sequence")))


def category(q: Column) -> Column:
    """The category with most signals, the first listed on ties, definitional without any."""
    low = lower(q)
    scores = {c: n_of(low, w) for c, w in SIGNALS.items()}
    best = F.greatest(*scores.values())
    return reduce(lambda acc, c: acc.when(scores[c] == best, c), SIGNALS, F.when(best == 0, "definitional"))


def strategy(q: Column, intent: Column | None = None) -> Column:
    cat = category(q)
    if intent is not None:
        cat = F.when(intent == "factoid", "factoid").when(intent.isin("analytical", "multi_hop"), "analytical").otherwise(cat)
    rows = F.create_map(*[x for c, (s, k, m, r) in STRATEGIES.items() for x in (F.lit(c), F.struct(F.lit(s).alias("strategy"), F.lit(k).alias("top_k"), F.lit(m).alias("multi_query"), F.lit(r).alias("rerank_n")))])
    return F.struct(cat.alias("category"), F.element_at(rows, cat).alias("config"))


def first_match(q: Column, pattern: str) -> Column:
    m = F.regexp_extract(q, pattern, 1)
    return F.when(m != "", m)


def computation(q: Column) -> Column:
    low = lower(q)
    one, two, two_b, three = first_match(low, TIER1), first_match(low, TIER2), first_match(low, TIER2B), first_match(low, TIER3)
    out = lambda r, t, m, c: F.struct(F.lit(r).alias("route"), F.lit(t).alias("tier"), m.alias("signal"), F.lit(c).alias("confidence"))
    second = F.coalesce(two, two_b)
    return F.when(one.isNotNull(), out("computation", 1, one, 0.97)).when(second.isNotNull(), out("computation", 2, second, 0.9)).when(three.isNotNull(), out("retrieval", 3, three, 0.85)).otherwise(out("retrieval", 0, F.lit(None).cast("string"), 0.6))


def turn_type(q: Column, has_context: Column) -> Column:
    low = lower(q)
    return F.when(low.rlike(CHIT_CHAT), "chit_chat").when(has_context & (low.rlike(FOLLOW_UP) | (n_words(q) <= 6)), "follow_up").otherwise("fresh_retrieval")


def needs_rewriting(q: Column) -> Column:
    return has_any(F.concat(F.lit(" "), F.lower(q), F.lit(" ")), [f" {p} " for p in PRONOUNS])


def constraints(q: Column) -> Column:
    low = F.lower(q)
    every = lambda pats: F.filter(F.transform(F.flatten(F.array(*[F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in pats])), lambda m: F.trim(m)), lambda m: m != "")
    when = lambda words: first_match(low, rf"(?:{words}) ([0-9]{{4}}|{MONTHS})")
    types = F.when(low.contains("in pdf"), F.array(F.lit("pdf"))).otherwise(F.expr("cast(array() as array<string>)"))
    excluded, after, before, sources = every(EXCLUDED), when("after|since|from"), when("before|until|up to"), every(SOURCES)
    some = (F.size(excluded) > 0) | after.isNotNull() | before.isNotNull() | (F.size(sources) > 0) | (F.size(types) > 0)
    return F.struct(excluded.alias("excluded"), after.alias("date_after"), before.alias("date_before"), sources.alias("sources"), types.alias("doc_types"), F.expr("cast(array() as array<struct<field:string,op:string,value:double>>)").alias("numeric_filters"), some.alias("has_constraints"))


def output_format(q: Column, intent: Column | None = None) -> Column:
    """By phrases, then by the question's intent if given, then by its length."""
    low = F.lower(q)
    out = reduce(lambda acc, f: acc.when(has_any(low, f[1]), f[0]) if acc is not None else F.when(has_any(low, f[1]), f[0]), FORMATS, None)
    if intent is not None:
        out = out.when(intent.isin("analytical", "multi_hop"), "detailed").when(intent == "factoid", "concise")
    return out.when(n_words(q) <= 8, "concise").otherwise("detailed")


def model_tier(q: Column) -> Column:
    low, words = F.lower(q), blank_words(q)
    entity = F.size(F.filter(words, lambda t: (t.rlike("^[A-Z]") & (F.length(t) > 1)) | t.rlike("[0-9]") | t.rlike("[:>/%]")))
    score = F.least(F.size(words) / 80, F.lit(1.0)) * 0.2 + F.coalesce(F.try_divide(entity, F.size(words)), F.lit(0.0)) * 0.3 + F.least(n_of(low, REASONING) / 2, F.lit(1.0)) * 0.5
    score = F.when(low.rlike(rf"^(what is|what are|who is|where is|define|definition of|meaning of){END}") | low.rlike(FACTOID_LIST), 0.1).otherwise(F.round(score, 6))
    return F.struct(score.alias("score"), F.when(score <= 0.25, "simple").when(score >= 0.65, "complex").otherwise("standard").alias("tier"))


def keyword_list(q: Column) -> Column:
    """Words of three or more ASCII letters that are no stop words; repeats stay."""
    words = F.filter(F.split(F.lower(q), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[a-z]{3,}$"))
    return F.filter(words, lambda w: ~F.array_contains(strings(KEYWORD_STOPWORDS), w))


def cost(df: DataFrame, digits: int | None = 6) -> DataFrame:
    """Adds cost by provider and model, rounded to so many digits (at most nine); unknown ones cost nothing. The price list is a literal."""
    price = F.create_map(*[x for (p, m), io in PRICES.items() for x in (F.lit(f"{p}/{m}"), F.array(*map(F.lit, io)))])
    got = F.try_element_at(price, F.concat_ws("/", "provider", "model"))
    if digits is None:
        return df.withColumn("cost", F.coalesce(F.col("input_tokens") / 1e6 * got[0] + F.col("output_tokens") / 1e6 * got[1], F.lit(0.0)))
    # Prices have three digits, so a cost is a whole number of 1e-9: halves round up exactly, whatever the order of the sums.
    nano = F.col("input_tokens") * F.round(got[0] * 1000).cast("long") + F.col("output_tokens") * F.round(got[1] * 1000).cast("long")
    unit = 10 ** (9 - digits)
    return df.withColumn("cost", F.coalesce(F.floor((nano + unit // 2) / unit) / 10.0**digits, F.lit(0.0)))


def _sql_any(words, col="low"):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def _sql_n(words, col="low"):
    return "(" + " + ".join(f"CAST(contains({col}, '{w}') AS INT)" for w in words) + ")"


_W = r"len(list_filter(string_split_regex(q, '[ \t\r\n]+'), lambda x: x <> ''))"
_QS = f"WITH b AS (SELECT qid, q, lower(trim(q)) AS low, {_W} AS n FROM {{questions}})"
_FACT = f"(regexp_matches(low, '{FACTOID}') OR regexp_matches(low, '{FACTOID_LIST}'))"
_CX = f"CASE WHEN {_FACT} THEN 'factoid' WHEN {_sql_n(MULTI_HOP)} >= 2 THEN 'multi_hop' WHEN {_sql_n(ANALYTICAL)} >= 1 THEN 'analytical' WHEN n <= 8 THEN 'factoid' ELSE 'analytical' END"


@query(f"{_QS} SELECT qid, {_CX} AS complexity, CAST(round(CASE WHEN {_FACT} THEN 0.95 WHEN {_sql_n(MULTI_HOP)} >= 2 THEN least(0.7 + {_sql_n(MULTI_HOP)} * 0.1, 0.95) WHEN {_sql_n(ANALYTICAL)} >= 1 THEN least(0.6 + {_sql_n(ANALYTICAL)} * 0.15, 0.95) WHEN n <= 8 THEN 0.6 ELSE 0.55 END, 4) AS DOUBLE) AS confidence FROM b")
def query_complexity(spark, sf_dir):
    return questions(spark, sf_dir).select("qid", complexity(F.col("q")).alias("c")).select("qid", "c.complexity", "c.confidence")


@query(f"{_QS}, k AS (SELECT *, {_CX} AS c FROM b) SELECT qid, CASE c WHEN 'factoid' THEN q WHEN 'analytical' THEN q || ' comparison analysis explanation' ELSE q || ' relationship cause effect sequence' END AS expanded FROM k")
def query_expansion(spark, sf_dir):
    return questions(spark, sf_dir).select("qid", expansion(F.col("q"), complexity(F.col("q"))["complexity"]).alias("expanded"))


@query(rf"""{_QS}, k AS (SELECT *, {_CX} AS c, list_filter(list_transform(string_split(regexp_replace(q, '((?:^|[^\p{{L}}\p{{N}}_]))(?i:(and also|furthermore|additionally|moreover|first|then|finally|as well as|in addition|subsequently))([^\p{{L}}\p{{N}}_]|$)', '\1' || chr(1) || '\2' || chr(1) || '\3', 'g'), chr(1)), lambda p: trim(p)), lambda p: length(p) > 15) AS parts FROM b)
SELECT qid, array_to_string(CASE WHEN c = 'multi_hop' AND len(parts) > 1 THEN parts ELSE [q] END, ' | ') AS sub_queries FROM k""")
def query_decompose(spark, sf_dir):
    q = F.col("q")
    return questions(spark, sf_dir).select("qid", F.array_join(decompose(q, complexity(q)["complexity"]), " | ").alias("sub_queries"))


_CAT = "CASE WHEN greatest(" + ", ".join(f"s_{c}" for c in SIGNALS) + ") = 0 THEN 'definitional' " + " ".join(f"WHEN s_{c} = greatest({', '.join(f's_{x}' for x in SIGNALS)}) THEN '{c}'" for c in SIGNALS) + " END"
_ROUTES = ", ".join(f"('{c}', '{s}', {k}, {str(m).lower()}, {r})" for c, (s, k, m, r) in STRATEGIES.items())


@query(f"{_QS}, s AS (SELECT qid, {', '.join(f'{_sql_n(w)} AS s_{c}' for c, w in SIGNALS.items())} FROM b), c AS (SELECT qid, {_CAT} AS category FROM s) SELECT qid, category, strategy, top_k, multi_query, rerank_n FROM c JOIN (VALUES {_ROUTES}) r(category, strategy, top_k, multi_query, rerank_n) USING (category)")
def semantic_route(spark, sf_dir):
    return questions(spark, sf_dir).select("qid", strategy(F.col("q")).alias("s")).select("qid", "s.category", "s.config.*")


_T = lambda p: f"nullif(regexp_extract(low, '{p}', 1), '')"


@query(f"{_QS}, m AS (SELECT qid, {_T(TIER1)} AS a, coalesce({_T(TIER2)}, {_T(TIER2B)}) AS b, {_T(TIER3)} AS c FROM b) SELECT qid, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN 'computation' ELSE 'retrieval' END AS route, CASE WHEN a IS NOT NULL THEN 1 WHEN b IS NOT NULL THEN 2 WHEN c IS NOT NULL THEN 3 ELSE 0 END AS tier, coalesce(a, b, c) AS signal, CAST(CASE WHEN a IS NOT NULL THEN 0.97 WHEN b IS NOT NULL THEN 0.9 WHEN c IS NOT NULL THEN 0.85 ELSE 0.6 END AS DOUBLE) AS confidence FROM m")
def computation_route(spark, sf_dir):
    return questions(spark, sf_dir).select("qid", computation(F.col("q")).alias("c")).select("qid", "c.*")


@query(f"{_QS} SELECT qid, CASE WHEN regexp_matches(low, '{CHIT_CHAT}') THEN 'chit_chat' WHEN qid % 2 = 0 AND (regexp_matches(low, '{FOLLOW_UP}') OR n <= 6) THEN 'follow_up' ELSE 'fresh_retrieval' END AS turn_type FROM b")
def turn_types(spark, sf_dir):
    """Every second question counts as asked in a session with context."""
    return questions(spark, sf_dir).select("qid", turn_type(F.col("q"), F.col("qid") % 2 == 0).alias("turn_type"))


@query(f"SELECT qid, {_sql_any([f' {p} ' for p in PRONOUNS], chr(39) + ' ' + chr(39) + ' || lower(q) || ' + chr(39) + ' ' + chr(39))} AS needs_rewriting FROM {{questions}}")
def query_needs_rewriting(spark, sf_dir):
    return questions(spark, sf_dir).select("qid", needs_rewriting(F.col("q")).alias("needs_rewriting"))


_ALL = lambda pats: "array_to_string(list_filter(list_transform(flatten([" + ", ".join(f"regexp_extract_all(low, '{p}', 1)" for p in pats) + "]), lambda m: trim(m)), lambda m: m <> ''), ',')"


_CONSTRAINTS = f"{_QS} SELECT qid, {_ALL(EXCLUDED)} AS excluded, {_ALL(SOURCES)} AS sources, nullif(regexp_extract(low, '(?:after|since|from) ([0-9]{{4}}|{MONTHS})', 1), '') AS date_after, nullif(regexp_extract(low, '(?:before|until|up to) ([0-9]{{4}}|{MONTHS})', 1), '') AS date_before, contains(low, 'in pdf') AS pdf FROM (SELECT qid, lower(q) AS low FROM b)"


@query(_CONSTRAINTS)
def constraint_extract(spark, sf_dir):
    c = questions(spark, sf_dir).select("qid", constraints(F.col("q")).alias("c"))
    return c.select("qid", F.array_join("c.excluded", ",").alias("excluded"), F.array_join("c.sources", ",").alias("sources"), "c.date_after", "c.date_before", (F.size("c.doc_types") > 0).alias("pdf"))


@query(f"SELECT qid, excluded <> '' OR sources <> '' OR date_after IS NOT NULL OR date_before IS NOT NULL OR pdf AS has_constraints FROM ({_CONSTRAINTS})")
def constraint_flags(spark, sf_dir):
    return questions(spark, sf_dir).select("qid", constraints(F.col("q")).alias("c")).select("qid", "c.has_constraints")


_FMT = "CASE " + " ".join(f"WHEN {_sql_any(w)} THEN '{f}'" for f, w in FORMATS) + " WHEN n <= 8 THEN 'concise' ELSE 'detailed' END"


@query(f"{_QS} SELECT qid, {_FMT} AS format FROM b")
def output_formats(spark, sf_dir):
    return questions(spark, sf_dir).select("qid", output_format(F.col("q")).alias("format"))


@query(f"""{_QS}, w AS (SELECT *, list_filter(string_split_regex(q, '[ \\t\\r\\n]+'), lambda x: x <> '') AS ws FROM b),
e AS (SELECT *, len(list_filter(ws, lambda t: (regexp_matches(t, '^[A-Z]') AND length(t) > 1) OR regexp_matches(t, '[0-9]') OR regexp_matches(t, '[:>/%]'))) AS ent FROM w),
s AS (SELECT qid, CASE WHEN regexp_matches(low, '^(what is|what are|who is|where is|define|definition of|meaning of){END}') OR regexp_matches(low, '{FACTOID_LIST}') THEN 0.1
  ELSE round(least(n / 80.0, 1.0) * 0.2 + CASE WHEN n > 0 THEN ent / CAST(n AS DOUBLE) ELSE 0 END * 0.3 + least({_sql_n(REASONING)} / 2.0, 1.0) * 0.5, 6) END AS score FROM e)
SELECT qid, CAST(score AS DOUBLE) AS score, CASE WHEN score <= 0.25 THEN 'simple' WHEN score >= 0.65 THEN 'complex' ELSE 'standard' END AS tier FROM s""")
def model_tiers(spark, sf_dir):
    return questions(spark, sf_dir).select("qid", model_tier(F.col("q")).alias("m")).select("qid", "m.score", "m.tier")


_KW = ", ".join(f"'{w}'" for w in KEYWORD_STOPWORDS)


@query(rf"SELECT qid, array_to_string(list_filter(string_split_regex(lower(q), '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z]{{3,}}$') AND NOT list_contains([{_KW}], w)), ' ') AS keywords FROM {{questions}}")
def keyword_set(spark, sf_dir):
    return questions(spark, sf_dir).select("qid", F.array_join(keyword_list(F.col("q")), " ").alias("keywords"))


_PR = ", ".join(f"('{p}', '{m}', {i}, {o})" for (p, m), (i, o) in PRICES.items())


@query(f"SELECT model, count(*) AS n, CAST(round(sum(coalesce((input_tokens * CAST(pin * 1000 AS BIGINT) + output_tokens * CAST(pout * 1000 AS BIGINT) + 500) // 1000, 0) / 1e6), 6) AS DOUBLE) AS cost FROM {{token_usage}} u LEFT JOIN (VALUES {_PR}) p(provider, model, pin, pout) USING (provider, model) GROUP BY model")
def cost_by_model(spark, sf_dir):
    return cost(token_usage(spark, sf_dir)).groupBy("model").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 6).alias("cost"))


@query("SELECT project_id, round(sum(input_tokens) * CASE project_id % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 ELSE 0 END * 0.000003, 6) AS saved_day, round(sum(input_tokens) * CASE project_id % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 ELSE 0 END * 0.000003 * 30, 4) AS saved_month FROM {token_usage} GROUP BY project_id")
def prompt_cache_savings(spark, sf_dir):
    """Cached share by provider class (0.9, 0.5, 0) times an assumed price a token, by day and month."""
    rate = F.when(F.col("project_id") % 3 == 0, 0.9).when(F.col("project_id") % 3 == 1, 0.5).otherwise(0.0)
    s = token_usage(spark, sf_dir).groupBy("project_id").agg(F.sum("input_tokens").alias("t"))
    return s.select("project_id", F.round(F.col("t") * rate * 0.000003, 6).alias("saved_day"), F.round(F.col("t") * rate * 0.000003 * 30, 4).alias("saved_month"))


@query("SELECT session_id, turn, substr(content, 1, 30) AS title, substr(sha256(content), 1, 16) AS prompt_hash, length(content) // 4 AS tokens FROM {turns}")
def titles_and_hashes(spark, sf_dir):
    t = turns(spark, sf_dir)
    return t.select("session_id", "turn", F.substring("content", 1, 30).alias("title"), F.substring(F.sha2("content", 256), 1, 16).alias("prompt_hash"), F.floor(F.length("content") / 4).alias("tokens"))
