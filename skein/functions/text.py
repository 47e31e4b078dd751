"""Text functions on columns: tokens, sentences, overlaps, costs."""

from __future__ import annotations

import glob
import os
import zipfile
from functools import lru_cache, reduce

import pyspark
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word lists.
KEYWORD_STOPWORDS = "what is the a an in of for and or to how when where who which are does do can will has have been be was were that this with by from at".split()
GROUND_STOPWORDS = "the a an is are was were in of to and or for with by at".split()
EDGE, END = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


@lru_cache(maxsize=1)
def english_stop_words() -> tuple[str, ...]:
    """The English stop list that Spark's own library carries; the TF-IDF operators take any other as a parameter."""
    jar = glob.glob(os.path.join(os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    jar = jar or glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    with zipfile.ZipFile(jar[0]) as z:
        words = z.read("org/apache/spark/ml/feature/stopwords/english.txt").decode().split()
    return tuple(w for w in words if "'" not in w)


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def long_tokens(text: Column, stop_words: tuple[str, ...] | None = None) -> Column:
    """Tokens of two characters or more that are no stop words, as the TF-IDF operators use them."""
    stop = english_stop_words() if stop_words is None else stop_words
    return F.filter(tokens(text), lambda w: (F.length(w) >= 2) & ~w.isin(*stop))


def blank_words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\r\n]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(blank_words(text))


def has_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def n_of(text: Column, words) -> Column:
    """How many of the words the text contains, as substrings."""
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words])


_DECIMAL, _SHORT = r"([0-9]+)\.([0-9]+)", rf"({EDGE})(Mr|Mrs|Dr|Prof|Sr|Jr|vs|etc|i\.e|e\.g)\."


def sentences(text: Column, least_words: int = 4) -> Column:
    """Split after sentence marks; decimals and common abbreviations do not end one; fragments below ``least_words`` go."""
    safe = F.regexp_replace(F.regexp_replace(text, _DECIMAL, "$1[DOT]$2"), _SHORT, "$1$2[DOT]")
    parts = marked_split(safe, r"([.!?])[ \t\r\n]+", "$1")
    return F.filter(F.transform(parts, lambda s: F.trim(F.replace(s, F.lit("[DOT]"), F.lit(".")))), lambda s: n_words(s) >= least_words)


def sentences_sql(column: str, least_words: int = 4) -> str:
    safe = f"regexp_replace(regexp_replace(replace({column}, chr(1), ' '), '{_DECIMAL}', '\\1[DOT]\\2', 'g'), '{_SHORT}', '\\1\\2[DOT]', 'g')"
    parts = f"string_split(regexp_replace({safe}, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({parts}, lambda s: trim(replace(s, '[DOT]', '.'))), lambda s: len(list_filter(string_split_regex(s, '[ \\t\\r\\n]+'), lambda x: x <> '')) >= {least_words})"


def marked_split(text: Column, pattern: str, keep: str = "") -> Column:
    """Split at a pattern of which ``keep`` stays with the part before. The mark is U+0001, which a text's own become blanks."""
    return F.split(F.regexp_replace(F.replace(text, F.lit("\u0001"), F.lit(" ")), pattern, keep + "\u0001"), "\u0001", -1)


def spans(text: Column, pattern: str) -> Column:
    """Matches with their places (start, end, value): what stands between matches and the matches add up to the places."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")

    def step(acc, i):
        start = acc["at"] + F.length(F.get(acc["g"], i))
        end = start + F.length(F.get(acc["m"], i))
        one = F.struct(start.alias("start"), end.alias("end"), F.get(acc["m"], i).alias("value"))
        return F.struct(end.alias("at"), acc["m"].alias("m"), acc["g"].alias("g"), F.concat(acc["out"], F.array(one)).alias("out"))

    every = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), F.struct(F.lit(0).alias("at"), found.alias("m"), between.alias("g"), none.alias("out")), step, lambda a: a["out"])
    return F.when(F.size(found) > 0, every).otherwise(none)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    """Share of a's distinct members that b has."""
    d = F.array_distinct(a)
    return F.when(F.size(d) > 0, F.size(F.array_intersect(d, b)) / F.size(d))
