"""License scans: a positional rare-token index over licence templates.

The words of all templates form a small fixed vocabulary. Its document frequencies are counted over every document;
the inverse frequencies then rank the words of each template. A template of n words is probed by its rarest words, as many
as cover n - ceil(MIN_SCORE * n) + 1 of its positions: an alignment with a share of MIN_SCORE equal words must hit one of
these, so no such alignment is lost, whatever else the file holds. A hit of a probe at place i on a template position p
votes for the alignment i - p. At each alignment that is voted for, the whole template is compared word by word; the best
share of equal words is the template's score. A label counts only if a mandatory key phrase of its template stands in the
text word by word and the score reaches MIN_SCORE; only such templates are probed.

Base labels come from the same postings: each place of the word `license` is checked for the phrase it ends.

Alignments are packed into one number each, so distinct ones are found by hashing: a text takes time in proportion to
its length.

Defined results: null text is empty: no words, empty labels, score 0, null places; texts of any length are scanned whole;
repeated rows and null ids give a row each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketloom.llm.common import documents, lower_ascii

#: What separates words once A-Z are lower-cased, and the base phrases with their labels.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Template texts (lower case, one space between words): label, text, mandatory phrases of which one must stand.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["www apache org licenses license 2 0"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["general public license"]),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["terms of the gnu general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd", "bsd license", ["bsd license"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["distribute this software for any purpose with or without fee"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by", "creative commons attribution 4 0", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-sa", "creative commons attribution sharealike", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nc", "creative commons attribution noncommercial", ["creative commons attribution noncommercial"]),
    ("cc0", "released under cc0 1 0 universal public domain dedication", ["cc0 1 0 universal"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software released into the public domain"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["this permission notice shall be included in all copies"]),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["agreed to in writing software distributed under the license"]),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ["see the gnu general public license for more details"]),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["may be used to endorse or promote products derived from this software"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable for any damages"]),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["any person or organization obtaining a copy of the software"]),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", ["changing it is allowed as long as the name is changed"]),
]
MIN_SCORE = 0.5

#: Words of the longest template, and how far apart the templates' alignments are when they are packed.
MOST_WORDS, SPAN = max(len(t.split()) for _, t, _ in TEMPLATES), 1 << 40

VOCABULARY = sorted({w for _, t, must in TEMPLATES for x in (t, *must) for w in x.split()})


def strings(values: list[str]) -> Column:
    return F.lit(list(values)).cast("array<string>")


def words_of(lowered: Column) -> Column:
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def idf(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """Inverse document frequency of each licence word over all of docs; the driver gets len(VOCABULARY) counts at most."""
    held = F.array_intersect(F.split(lower_ascii(F.col(text)), SEPARATORS), strings(VOCABULARY))
    rows = docs.select(F.explode(held).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    df = {r["w"]: r["n"] for r in rows}
    n = docs.count()
    return {w: math.log((1 + n) / (1 + df.get(w, 0))) for w in VOCABULARY}


def probes(weights: dict[str, float]) -> list[set[str]]:
    """For each template its rarest words, enough that an alignment with MIN_SCORE of its words has one of them in place."""
    out = []
    for _, text, _ in TEMPLATES:
        words = text.split()
        need, chosen = len(words) - math.ceil(MIN_SCORE * len(words)) + 1, set()
        for w in sorted(set(words), key=lambda w: (-weights[w], w)):
            if need <= 0:
                break
            chosen.add(w)
            need -= words.count(w)
        out.append(chosen)
    return out


def _postings(probed: list[set[str]]) -> Column:
    """word -> array of (template, position), as a map literal."""
    at: dict[str, list[Column]] = {}
    for t, (_, text, _) in enumerate(TEMPLATES):
        for p, w in enumerate(text.split()):
            if w in probed[t]:
                at.setdefault(w, []).append(F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")))
    return F.create_map(*[x for w, ps in at.items() for x in (F.lit(w), F.array(*ps))])


def _phrase_held(joined: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(joined, F.lit(f" {p} ")) for p in phrases])


def _candidate(held: Column) -> Column:
    """Whether a mandatory phrase of some template can stand: all its words are there."""
    phrases = sorted({p for _, _, must in TEMPLATES for p in must} | set(BASE))
    return reduce(lambda a, b: a | b, [F.size(F.array_intersect(held, strings(sorted(set(p.split()))))) == len(set(p.split())) for p in phrases])


def scan(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """docs (doc_id, text) with words counted, base places and scored labels; one pass after the frequencies."""
    weights = weights if weights is not None else idf(docs)
    probed = probes(weights)
    place = "array<struct<label:string,at:bigint>>"

    t = docs.select("doc_id", lower_ascii(F.coalesce("text", F.lit(""))).alias("lc"))
    t = t.select("doc_id", "lc", F.regexp_count("lc", F.lit(WORD)).cast("long").alias("n_words"), F.array_intersect(F.split("lc", SEPARATORS), strings(VOCABULARY)).alias("held"))
    t = t.select("doc_id", "n_words", "held", F.when(_candidate(F.col("held")), words_of(F.col("lc"))).alias("words"))

    def base_at(i: Column) -> Column:
        back = lambda k: F.get(F.col("words"), i - k)
        return (
            F.when(back(1) == "mit", F.struct(F.lit("mit").alias("label"), (i - 1).cast("long").alias("at")))
            .when(back(1) == "apache", F.struct(F.lit("apache").alias("label"), (i - 1).cast("long").alias("at")))
            .when((back(1) == "public") & (back(2) == "general"), F.struct(F.lit("gpl").alias("label"), (i - 2).cast("long").alias("at")))
        )

    indexed = F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    t = t.withColumn("joined", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    held_phrases = [F.when(_phrase_held(F.col("joined"), must), F.lit(k)) for k, (_, _, must) in enumerate(TEMPLATES)]
    t = t.withColumn("verified", F.array_compact(F.array(*held_phrases)))
    wanted = F.array_distinct(F.flatten(F.transform("verified", lambda k: F.get(F.array(*[strings(sorted(p)) for p in probed]), k))))
    t = t.withColumn("probes", wanted)
    t = t.withColumn("hits", F.filter(indexed, lambda x: (x["w"] == "license") | F.array_contains(F.col("probes"), x["w"])))
    t = t.withColumn("base", F.filter(F.transform(F.filter("hits", lambda x: x["w"] == "license"), lambda x: base_at(x["i"])), lambda x: x.isNotNull()).cast(place))

    postings = _postings(probed)
    def alignments(h: Column) -> Column:
        own = F.filter(postings[h["w"]], lambda p: F.array_contains(F.col("verified"), p["t"]))
        return F.transform(own, lambda p: p["t"].cast("bigint") * SPAN + (h["i"] - p["p"] + MOST_WORDS).cast("bigint"))

    votes = F.array_distinct(F.flatten(F.transform(F.filter("hits", lambda x: F.array_contains(F.col("probes"), x["w"])), alignments)))
    t = t.withColumn("votes", votes)
    templates = F.array(*[strings(text.split()) for _, text, _ in TEMPLATES])

    def share(v: Column) -> Column:
        """(template, share of equal words) of an alignment."""
        k = F.floor(v / SPAN).cast("int")
        start = (v % SPAN).cast("int") - MOST_WORDS
        near = F.slice(F.col("words"), F.greatest(start + 1, F.lit(1)), F.lit(MOST_WORDS))
        early = F.greatest(-start, F.lit(0))  # words of the template that would stand before the text
        def compare(x: Column) -> Column:
            same = F.size(F.filter(F.transform(x["own"], lambda w, j: F.when(j >= x["early"], F.get(x["near"], j - x["early"])) == w), lambda e: e))
            return F.struct(x["t"].alias("t"), (same / F.size(x["own"])).alias("s"))
        bound = F.array(F.struct(k.alias("t"), F.get(templates, k).alias("own"), near.alias("near"), early.alias("early")))
        return F.get(F.transform(bound, compare), F.lit(0))

    t = t.withColumn("scored", F.transform("votes", share))

    names = strings([label for label, _, _ in TEMPLATES])
    good = F.filter("scored", lambda x: x["s"] >= MIN_SCORE)
    t = t.withColumn("good", good)
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"])))
    own = F.transform("good", lambda x: F.get(names, x["t"]))
    starts = F.transform("base", lambda x: x["at"])
    none = F.lit("")
    return t.select(
        "doc_id",
        "n_words",
        F.coalesce(F.when(F.col("base").isNotNull(), F.size("base")), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.coalesce(F.array_join(base_labels, ","), none).alias("base_labels"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, own))), ","), none).alias("labels"),
        F.coalesce(F.array_max(F.transform("good", lambda x: x["s"])), F.lit(0.0)).alias("score"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir).select("doc_id", "text"))


def oracle() -> str:
    """All words of all templates, not rare ones, are looked up, so nothing of the index decides the rows."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    templates = ", ".join(f"({k}, {text(label)}, {text(words)})" for k, (label, words, _) in enumerate(TEMPLATES))
    phrases = ", ".join(f"({k}, {text(p)})" for k, (_, _, must) in enumerate(TEMPLATES) for p in must)
    base = ", ".join(f"({text(p)}, {text(label)})" for p, label in BASE.items())
    return f"""WITH t AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
j AS (SELECT d, words, ' ' || array_to_string(words, ' ') || ' ' AS joined FROM t),
templates(k, label, body) AS (VALUES {templates}), must(k, phrase) AS (VALUES {phrases}), phrases(phrase, label) AS (VALUES {base}),
spot AS (SELECT d, i - 1 AS i, words[i] AS w, words FROM (SELECT d, words, unnest(range(1, len(words) + 1)) AS i FROM t)),
base AS (SELECT d, i, label FROM spot, phrases WHERE w = split_part(phrase, ' ', 1) AND array_to_string(words[i + 1 : i + len(string_split(phrase, ' '))], ' ') = phrase),
places AS (SELECT d, count(*) AS n, min(i) AS low, max(i) AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY d),
held AS (SELECT DISTINCT d, k FROM j, must WHERE contains(joined, ' ' || phrase || ' ')),
posting AS (SELECT k, p - 1 AS p, own[p] AS w, len(own) AS n FROM (SELECT k, own, unnest(range(1, len(own) + 1)) AS p FROM (SELECT k, string_split(body, ' ') AS own FROM templates))),
share AS (SELECT d, k, i - p AS start, count(*) / n AS s FROM held JOIN posting USING (k) JOIN spot USING (d, w) GROUP BY d, k, start, n),
good AS (SELECT d, label, s FROM share JOIN templates USING (k) WHERE s >= {MIN_SCORE}),
best AS (SELECT d, max(s) AS score FROM good GROUP BY d),
labels AS (SELECT d, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT d, label FROM good UNION SELECT d, label FROM base) GROUP BY d)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0) AS n_base, low AS first_word, high AS last_word, coalesce(places.labels, '') AS base_labels, coalesce(labels.labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM t LEFT JOIN places USING (d) LEFT JOIN best USING (d) LEFT JOIN labels USING (d)"""


ORACLE_OP2 = oracle()
