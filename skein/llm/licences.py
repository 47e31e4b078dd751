"""License scans by sentence rules: known licence sentences are recognised over the normalised words of the text and become
identifiers, and runs of identifiers are matched against ordered rules. A known sentence begins and ends where a fragment does
(line ends, and blanks after sentence marks), but may go over any number of fragments, so wrapped lines and marks inside it do not matter.

Rules are tried in order, those of more sentences first. A match needs its sentences next to each other among the known ones, each
at most ``MAX_GAP`` fragments after the one before; it consumes them, so that a shorter rule (two clauses of three) is not found in
them again. The dictionary is a small fixed table held as a literal; only texts that hold one of its trigger words are split.
DataFrame functions only.

Defined results: null and empty texts have no findings; unknown fragments between known sentences are skipped up to the gap; equal
texts, repeated rows among them, give equal results; very long texts are read whole; of rules that tie in length the one listed
first goes first; an empty table gives no rows; the helper column takes a name that the table does not have.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table, text_or_empty

#: Public licence sentences, normalised, with their identifiers.
TEXTS = {
    "mit license": "mit-title",
    "the mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "you may not use this file except in compliance with the license": "apache-use",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-see",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-grant",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "lgpl-warranty",
    "see the gnu lesser general public license for more details": "lgpl-see",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-grant",
    "see the gnu affero general public license for more details": "agpl-see",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertising",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-name",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "zero-bsd-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-title",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-grant",
    "boost software license version 1 0": "bsl-title",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl-grant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-note",
    "if a copy of the mpl was not distributed with this file you can obtain one at": "mpl-copy",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at": "epl-grant",
    "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work": "cc0-waiver",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4-0-note",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4-0-note",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4-0-note",
    "all rights reserved": "reserved",
}
#: Licences by their names in running text, and the phrases that name one.
SPOKEN = {
    "MIT": ["the mit license"], "Apache-2.0": ["the apache license version 2 0", "the apache license version 2 0 the license"], "GPL-2.0-only": ["the gnu general public license version 2"], "GPL-3.0-only": ["the gnu general public license version 3"],
    "LGPL-2.1-only": ["the gnu lesser general public license version 2 1"], "LGPL-3.0-only": ["the gnu lesser general public license version 3"], "AGPL-3.0-only": ["the gnu affero general public license version 3"],
    "BSD-2-Clause": ["the bsd 2 clause license", "the 2 clause bsd license"], "BSD-3-Clause": ["the bsd 3 clause license", "the 3 clause bsd license"], "ISC": ["the isc license"], "0BSD": ["the 0bsd license"], "Zlib": ["the zlib license"], "Unlicense": ["the unlicense"],
    "BSL-1.0": ["the boost software license version 1 0"], "MPL-2.0": ["the mozilla public license version 2 0"], "EPL-2.0": ["the eclipse public license version 2 0"], "CC0-1.0": ["cc0 1 0"], "CC-BY-4.0": ["cc by 4 0"], "CC-BY-SA-4.0": ["cc by sa 4 0"], "CC-BY-NC-4.0": ["cc by nc 4 0"],
}
PHRASES = ["licensed under", "released under", "distributed under", "this project is licensed under", "this work is licensed under", "this software is licensed under"]


def _words(name: str) -> str:
    return re.sub("[^a-z0-9]+", " ", name.lower()).strip()


def _note(name: str) -> str:
    return _words(name).replace(" ", "-") + "-note"


#: All known sentences: the texts, every name after every phrase, and the short form of file headers.
SENTENCES = {f"{p} {n}": _note(name) for name, names in SPOKEN.items() for n in names for p in PHRASES} | {f"spdx license identifier {_words(name)}": _note(name) for name in SPOKEN} | TEXTS
#: Ordered rules as runs of known sentences: more sentences first, else as listed.
RULES = tuple(sorted((
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty")), ("MIT", ("mit-grant", "mit-condition")), ("Apache-2.0", ("apache-2-0-note", "apache-use", "apache-copy", "apache-warranty", "apache-see")), ("Apache-2.0", ("apache-2-0-note", "apache-use", "apache-copy")),
    ("GPL-3.0-or-later", ("gpl3-grant", "gpl-warranty")), ("GPL-2.0-or-later", ("gpl2-grant", "gpl-warranty")), ("LGPL-2.1-or-later", ("lgpl21-grant", "lgpl-warranty")), ("LGPL-3.0-or-later", ("lgpl3-grant", "lgpl-warranty")), ("AGPL-3.0-or-later", ("agpl3-grant", "gpl-warranty")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-name")), ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")), ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant", "isc-warranty")), ("0BSD", ("zero-bsd-grant", "isc-warranty")), ("Zlib", ("zlib-warranty", "zlib-grant")), ("Unlicense", ("unlicense-title", "unlicense-grant")), ("BSL-1.0", ("bsl-title", "bsl-grant")), ("BSL-1.0", ("bsl-grant",)),
    ("MPL-2.0", ("mpl-note", "mpl-copy")), ("MPL-2.0", ("mpl-note",)), ("EPL-2.0", ("epl-grant",)), ("CC0-1.0", ("cc0-waiver",)), *((name, (_note(name),)) for name in SPOKEN),
), key=lambda r: -len(r[1])))
#: Every known sentence holds one of these.
TRIGGERS = ("licen", "permission", "warrant", "redistribut", "reserved", "copyright", "public domain", "cc0", "advertising", "cc by", "cc-by", "0bsd", "mpl", "anyone is free")
#: Fragments that may stand between two sentences of a rule; a paragraph of a wrapped licence has some twenty lines.
MAX_GAP = 40

#: Any known sentence over normalised fragments, one a line; the longest first.
KNOWN = "(?m)^(?:" + "|".join(s.replace(" ", r"(?: |\n+)") for s in sorted(SENTENCES, key=len, reverse=True)) + ")$"


def normalised(sentences: Column) -> Column:
    return F.transform(sentences, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))


def split_sentences(text: Column) -> Column:
    """Line ends, and blanks after sentence marks; so \"2.0\" stays whole."""
    return F.split(F.regexp_replace(text, r"([.!?;:])[ \t\r]+", "$1\n"), "\n")


def _line_ends(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^\n]+", "")).cast("long")


def find_licences(docs: DataFrame, text_col: str = "text", out: str = "licences") -> DataFrame:
    """Adds ``out``: struct of sentences (array of place, id, by place) and names (sorted, distinct) of the rules that match."""
    t = text_or_empty(text_col)
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    words = F.array_join(normalised(split_sentences(t)), "\n")

    def step(acc, i):
        m = F.element_at(acc["m"], i)
        place = acc["place"] + _line_ends(F.element_at(acc["g"], i))
        far = place - acc["place"] > MAX_GAP
        one = F.struct(place.alias("place"), F.element_at(known, F.regexp_replace(m, "\n+", " ")).alias("id"), far.alias("far"))
        return F.struct((place + _line_ends(m)).alias("place"), acc["m"].alias("m"), acc["g"].alias("g"), F.concat(acc["out"], F.array(one)).alias("out"))

    empty = F.expr("cast(array() as array<struct<place:bigint,id:string,far:boolean>>)")
    start = F.struct(F.lit(0).cast("long").alias("place"), F.regexp_extract_all(words, F.lit(KNOWN), F.lit(0)).alias("m"), F.split(words, KNOWN, -1).alias("g"), empty.alias("out"))
    places = F.aggregate(F.sequence(F.lit(1), F.size(F.regexp_extract_all(words, F.lit(KNOWN), F.lit(0)))), start, step, lambda acc: acc["out"])
    found = F.when(F.lower(t).rlike("|".join(TRIGGERS)) & words.rlike(KNOWN), places).otherwise(empty)
    (helper,) = fresh(docs, "_found")
    rows = docs.withColumn(helper, found)
    # The identifiers as one run, broken where the gap is too wide; a rule that it holds is taken out of it.
    run = F.array_join(F.transform(helper, lambda x: F.concat(F.when(x["far"], "|").otherwise(""), F.lit("<"), x["id"], F.lit(">"))), "")
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in ids)).alias("run")) for name, ids in RULES])
    begin = F.struct(run.alias("run"), F.expr("cast(array() as array<string>)").alias("names"))
    take = lambda acc, r: F.when(acc["run"].contains(r["run"]), F.struct(F.replace(acc["run"], r["run"], F.lit("|")).alias("run"), F.concat(acc["names"], F.array(r["name"])).alias("names"))).otherwise(acc)
    names = F.when(F.size(helper) > 0, F.aggregate(rules, begin, take, lambda acc: F.array_sort(F.array_distinct(acc["names"])))).otherwise(F.expr("cast(array() as array<string>)"))
    sentences = F.transform(helper, lambda x: F.struct(x["place"].alias("place"), x["id"].alias("id")))
    return rows.withColumn(out, F.struct(sentences.alias("sentences"), names.alias("names"))).drop(helper)


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    s = F.col("licences.sentences")
    spans = F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["id"], x["place"].cast("string"))), ",")
    return rows.select("doc_id", F.size(s).cast("long").alias("n_known"), spans.alias("sentences"), F.array_join("licences.names", ",").alias("licences"))


def op9_sql() -> str:
    """The matches with their places from the text between them, then the rules one after the other."""
    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    steps, last = [], "r0"
    for k, (name, ids) in enumerate(RULES):
        seq = "".join(f"<{i}>" for i in ids)
        steps.append(f"r{k + 1} AS (SELECT doc_id, replace(run, '{seq}', '|') AS run, CASE WHEN contains(run, '{seq}') THEN list_append(names, '{name}') ELSE names END AS names FROM {last})")
        last = f"r{k + 1}"
    return rf"""
WITH known(s, id) AS (VALUES {known}),
w AS (SELECT doc_id, array_to_string(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?;:])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))), chr(10)) AS w FROM documents),
m AS (SELECT doc_id, regexp_extract_all(w, '{KNOWN}') AS m, string_split_regex(w, '{KNOWN}') AS g FROM w WHERE regexp_matches(w, '{KNOWN}')),
p AS (SELECT doc_id, i, regexp_replace(m[i], '\n+', ' ', 'g') AS s, length(regexp_replace(array_to_string(g[1:i], '') || array_to_string(m[1:i - 1], ''), '[^\n]+', '', 'g')) AS place, length(regexp_replace(g[i], '[^\n]+', '', 'g')) AS gap FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)),
f AS (SELECT doc_id, count(*) AS n, string_agg(id || ':' || place, ',' ORDER BY i) AS spans, string_agg(CASE WHEN gap > {MAX_GAP} THEN '|' ELSE '' END || '<' || id || '>', '' ORDER BY i) AS run FROM p JOIN known USING (s) GROUP BY doc_id),
r0 AS (SELECT doc_id, run, CAST([] AS VARCHAR[]) AS names FROM f),
{", ".join(steps)}
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_known, coalesce(spans, '') AS sentences, coalesce(array_to_string(list_sort(list_distinct(names)), ','), '') AS licences
FROM documents LEFT JOIN f USING (doc_id) LEFT JOIN {last} USING (doc_id)
"""
