"""License scans by diagonal voting, in DataFrame operations only.

Templates are word sequences of two kinds: base phrases, which count where all their words stand one
after another, and notices, which may be cut or altered. Rolling hashes of k words (k = 2 for phrases,
3 for notices) of the texts are joined to the templates' positions. A hit votes for its diagonal, word
position less template position; votes are counted per text, template and diagonal. A phrase stands
where one diagonal has all its votes. For a notice, diagonals at most ``drift`` apart are merged, which
spans words put in or left out, and verified: the share of the notice's k-grams that were hit must
reach ``share``, and its words may not spread over more than twice its length.

All texts are taken apart and all their k-grams meet the templates, so no list of words decides what is looked at.
The table of hits holds each place of a text once, whatever number of rows have that text: hits are keyed by the text's
MD5 and counted as sets of template positions. Templates are a table of (label, notice, text), which callers may give;
it is broadcast only as far as its measured bytes allow.

Null texts count as empty. Words are runs of a-z, digits and characters beyond ASCII, after A-Z are
lower-cased. Rows of equal text have equal results, repeated rows stay. A text without words has no span, an empty
table gives no rows. A long text's k-grams are rows of the task that reads it, of which only hits go on. Other columns of df
are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"

# Phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Wording of public license notices, in short and whole, and their labels.
NOTICES = [
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution", "cc"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "public-domain"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject "
        "to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software",
        "mit-whole",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies",
        "isc",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
        "are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution",
        "bsd-whole",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
        "obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
        "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express "
        "or implied see the license for the specific language governing permissions and limitations under the license",
        "apache-2-whole",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
        "by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the "
        "hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular "
        "purpose see the gnu general public license for more details",
        "gpl-whole",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages "
        "arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial "
        "applications and to alter it and redistribute it freely",
        "zlib",
    ),
]

PHRASE_K, NOTICE_K, SHARE, DRIFT = 2, 3, 0.6, 2


def gram_hash(words: Column, first: Column, k: int) -> Column:
    """The hash of k and of the k words from place first (from 0)."""
    return F.xxhash64(F.lit(k), *(F.get(words, first + i) for i in range(k)))


def template_table(spark: SparkSession, phrases: Sequence = tuple(PHRASES), notices: Sequence = tuple(NOTICES)) -> DataFrame:
    """(label, notice, text) of phrases and notices, which are (text, label)s."""
    rows = [(label, False, text) for text, label in phrases] + [(label, True, text) for text, label in notices]
    return spark.createDataFrame(rows, "label string, notice boolean, text string")


def templates(table: DataFrame) -> DataFrame:
    """(template, label, notice, grams, words, k, place, hash): one row for each k-gram of (label, notice, text).

    A template of fewer words than k has none, and is found nowhere."""
    made = table.select("label", "notice", F.split("text", " ").alias("w"), F.when(F.col("notice"), NOTICE_K).otherwise(PHRASE_K).alias("k"))
    made = made.withColumn("template", F.xxhash64("label", "notice", F.array_join("w", " "))).dropDuplicates(["template"])
    made = made.withColumn("words", F.size("w")).where("words >= k").withColumn("grams", F.col("words") - F.col("k") + 1)
    made = made.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("grams") - 1)))
    return made.withColumn("hash", F.when(F.col("notice"), gram_hash(F.col("w"), F.col("place"), NOTICE_K)).otherwise(gram_hash(F.col("w"), F.col("place"), PHRASE_K))).drop("w")


def votes(words: DataFrame, known: DataFrame) -> DataFrame:
    """(key, template, diagonal, ...): hits of all rolling k-grams of (key, words), counted by diagonal.

    Rows of one key have the same words and are counted once: a diagonal has each of the template's places once."""
    at_each = F.transform("words", lambda _, i: F.array(*(gram_hash(F.col("words"), i, k) for k in (PHRASE_K, NOTICE_K))))
    own = words.select("key", F.posexplode(F.flatten(at_each)).alias("nth", "hash"))
    few = common.few(known)
    rows = own.join(known if few is None else few, "hash").withColumn("at", F.expr("nth div 2").cast("int")).withColumn("diagonal", F.col("at") - F.col("place"))
    fixed = [F.first(c).alias(c) for c in ("label", "notice", "grams", "words", "k")]
    voted = rows.groupBy("key", "template", "diagonal").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.collect_set("place").alias("places"), *fixed)
    return voted.withColumn("votes", F.size("places"))


def spans(words: DataFrame, known: DataFrame, share: float = SHARE, drift: int = DRIFT) -> DataFrame:
    """(key, label, notice, start, end, score): verified spans, in words, ends exclusive."""
    voted = common.cut(votes(words.select("key", "words"), known))
    exact = voted.where(~F.col("notice") & (F.col("votes") == F.col("grams")))
    exact = exact.select("key", "label", "notice", F.col("diagonal").cast("long").alias("start"), (F.col("diagonal") + F.col("words")).cast("long").alias("end"), F.lit(1.0).alias("score"))
    order = W.partitionBy("key", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > drift, F.lit(True))
    near = voted.where("notice").withColumn("group", F.sum(far.cast("int")).over(order))
    merged = near.groupBy("key", "template", "group").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("hit"),
        *(F.first(c).alias(c) for c in ("label", "grams", "words", "k")),
    )
    score = F.col("hit") / F.col("grams")
    merged = merged.where((score >= share) & (F.col("high") - F.col("low") + F.col("k") <= 2 * F.col("words")))
    merged = merged.select("key", "label", F.lit(True).alias("notice"), F.col("low").cast("long").alias("start"), (F.col("high") + F.col("k")).cast("long").alias("end"), score.alias("score"))
    return exact.union(merged)


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", templates_: DataFrame | None = None, share: float = SHARE, drift: int = DRIFT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    templates_: (label, notice, text), else ``template_table``; those that are no notices are base phrases."""
    known = common.cut(templates(template_table(df.sparkSession) if templates_ is None else templates_))
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), value.alias("text"))
    n_words = F.regexp_count("text", F.lit(ANY_CASE)).cast("long").alias("n_words")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = rows.select(F.md5("text").alias("key"), F.regexp_extract_all(lowered, F.lit(f"({WORD})")).alias("words"))
    found = spans(words, known, share, drift)
    base = ~F.col("notice")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = common.cut(found.groupBy("key").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.max("score").alias("score"),
    ))
    out = ["doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score")]
    few = common.few(found)
    return rows.select("doc_id", n_words, F.md5("text").alias("key")).join(found if few is None else few, "key", "left").select(*out)


def _values() -> str:
    rows = [(label, "false", words, PHRASE_K) for words, label in PHRASES] + [(label, "true", words, NOTICE_K) for words, label in NOTICES]
    return ", ".join(f"({i}, '{label}', {notice}, '{words}', {k})" for i, (label, notice, words, k) in enumerate(rows))


#: The same over documents, for DuckDB.
SQL = f"""
WITH t AS (
  SELECT *, string_split(said, ' ') AS tw FROM (VALUES {_values()}) AS v(template, label, notice, said, k)),
tg AS (
  SELECT template, k, place, array_to_string(tw[place + 1 : place + k], ' ') AS gram
  FROM (SELECT *, unnest(range(0, len(tw) - k + 1)) AS place FROM t) AS u),
w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words
  FROM documents),
p AS (SELECT rid, words, unnest(range(0, len(words))) AS pos FROM w),
g AS (
  SELECT rid, pos, v.k AS k, array_to_string(words[pos + 1 : pos + v.k], ' ') AS gram
  FROM p, (VALUES ({PHRASE_K}), ({NOTICE_K})) AS v(k) WHERE pos + v.k <= len(words)),
d AS (
  SELECT g.rid, tg.template, g.pos - tg.place AS diagonal, count(*) AS votes, min(g.pos) AS low, max(g.pos) AS high, list(tg.place) AS places
  FROM g JOIN tg ON g.k = tg.k AND g.gram = tg.gram GROUP BY g.rid, tg.template, g.pos - tg.place),
e AS (
  SELECT d.rid, t.label, false AS notice, d.diagonal AS start, 1.0::DOUBLE AS score
  FROM d JOIN t ON d.template = t.template WHERE NOT t.notice AND d.votes = len(t.tw) - t.k + 1),
s AS (
  SELECT d.*, CASE WHEN d.diagonal - lag(d.diagonal) OVER (PARTITION BY d.rid, d.template ORDER BY d.diagonal) <= {DRIFT} THEN 0 ELSE 1 END AS far
  FROM d JOIN t ON d.template = t.template WHERE t.notice),
m AS (
  SELECT *, sum(far) OVER (PARTITION BY rid, template ORDER BY diagonal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM s),
n AS (
  SELECT rid, template, min(low) AS low, max(high) AS high, len(list_distinct(flatten(list(places)))) AS hit FROM m GROUP BY rid, template, part),
f AS (
  SELECT n.rid, t.label, true AS notice, n.low AS start, n.hit::DOUBLE / (len(t.tw) - t.k + 1) AS score
  FROM n JOIN t ON n.template = t.template
  WHERE n.hit::DOUBLE / (len(t.tw) - t.k + 1) >= {SHARE} AND n.high - n.low + t.k <= 2 * len(t.tw)),
a AS (
  SELECT rid, count(*) FILTER (WHERE NOT notice) AS n_base, min(start) FILTER (WHERE NOT notice) AS first_word, max(start) FILTER (WHERE NOT notice) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE NOT notice) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM (SELECT * FROM e UNION ALL SELECT * FROM f) AS u GROUP BY rid)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(a.n_base, 0)::BIGINT AS n_base, a.first_word::BIGINT AS first_word, a.last_word::BIGINT AS last_word,
       coalesce(a.base_labels, '') AS base_labels, coalesce(a.labels, '') AS labels, coalesce(a.score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN a ON w.rid = a.rid
"""
