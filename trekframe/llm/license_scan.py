"""License scan by diagonal voting: rolling word n-grams joined with template positions, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRAM = 3  # words of a rolling n-gram; the shortest template has as many
SLACK = 3  # diagonals this close belong to one passage with words inserted or left out
COVER = 0.7  # share of a template's n-grams that a passage must show

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases that name a license, and their labels.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# Opening sentences of well-known license notices, and their labels.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]


def _words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def _grams(words: Column) -> Column:
    """Hashes of all runs of ``GRAM`` words, by the place of their first."""
    n = F.size(words)
    places = F.sequence(F.lit(0), n - GRAM)
    hashes = F.transform(places, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(GRAM))))
    return F.when(n >= GRAM, hashes).otherwise(F.array().cast("array<bigint>"))


def _template_positions(spark: SparkSession, base: list[tuple[str, str]], notices: list[tuple[str, str]]) -> DataFrame:
    """A row per template position: fixed by the code, a few hundred at most."""
    rows = [F.struct(F.lit(k).alias("template"), F.lit(text).alias("text"), F.lit(label).alias("label"), F.lit(k < len(base)).alias("base")) for k, (text, label) in enumerate([*base, *notices])]
    texts = spark.range(1).select(F.inline(F.array(*rows))).withColumn("t_words", _words(F.col("text")))
    texts = texts.withColumn("t_grams", F.size("t_words") - GRAM + 1)
    at = texts.select("template", "label", "base", "t_words", "t_grams", F.posexplode(_grams(F.col("t_words"))).alias("t_pos", "gram"))
    return at.select("template", "label", "base", "t_grams", "t_pos", "gram", F.slice("t_words", F.col("t_pos") + 1, GRAM).alias("t_slice"))


def scan_licenses(docs: DataFrame, base: list[tuple[str, str]] = BASE, notices: list[tuple[str, str]] = NOTICES, cover: float = COVER) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` of every row of ``docs``.

    Words are runs of lower-cased letters, digits and non-ASCII characters. All rolling n-grams of all texts are joined
    with the templates' positions, and hits vote for their diagonal (place in the text less place in the template). A
    base phrase stands wherever a diagonal has all its n-grams. For every template, each diagonal is merged with those up to
    ``SLACK`` after it, and such a passage counts from ``cover`` of the n-grams on; it adds its label. Diagonals farther
    apart are passages of their own, however many lie between. ``score`` is the best share shown, so 1 with any base
    phrase, zero below ``cover``. Joined n-grams are compared word by word, so no hash decides.

    Null and empty texts have no words. Repeated rows are rows of their own. Only hits and one row per document are
    shuffled. ``first_word`` and ``last_word`` are null where no base phrase stands.
    """
    templates = F.broadcast(_template_positions(docs.sparkSession, base, notices))  # fixed by the code
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), _words(F.col("text")).alias("words"))
    rows = rows.withColumn("n_words", F.size("words").cast("long")).withColumn("grams", _grams(F.col("words")))
    # the last element of each is no n-gram but stands for the document itself
    spots = rows.select("doc_id", "text_key", "n_words", "words", F.posexplode(F.concat("grams", F.array(F.lit(None).cast("bigint")))).alias("pos", "gram"))
    # the hash alone is the key, so that words are cut out and compared only where it meets a template's
    same = F.slice("words", F.col("pos") + 1, GRAM) == F.col("t_slice")
    hits = spots.join(templates, "gram", "left").where((F.col("template").isNotNull() & same) | F.col("gram").isNull())
    document = ["doc_id", "text_key", "n_words"]
    votes = hits.select(*document, "template", "label", "base", "t_grams", "t_pos", F.col("pos").cast("long").alias("pos"), (F.col("pos") - F.col("t_pos")).cast("long").alias("diagonal"))
    votes = votes.groupBy(*document, "template", "label", "base", "t_grams", "diagonal").agg(
        F.collect_set("t_pos").alias("shown"), F.count("*").alias("n_rows")
    )
    along = Window.partitionBy(*document, "template").orderBy("diagonal")
    # what a diagonal and those next to it show together; a passage starts at each
    beside = F.flatten(F.collect_list("shown").over(along.rangeBetween(0, SLACK)))
    exact = F.col("base") & (F.size("shown") == F.col("t_grams"))
    votes = votes.withColumn("share", F.when(F.col("template").isNotNull(), F.size(F.array_distinct(beside)) / F.col("t_grams")))
    good = F.col("share") >= cover
    found = votes.groupBy(*document).agg(
        F.count(F.when(exact, 1)).alias("n_base"), F.min(F.when(exact, F.col("diagonal"))).alias("first_word"), F.max(F.when(exact, F.col("diagonal"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(exact, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(good, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(good, F.col("share"))), F.lit(0.0)).alias("score"),
        F.max(F.when(F.col("template").isNull(), F.col("n_rows"))).alias("copies"),
    )
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def oracle_sql(base: list[tuple[str, str]] = BASE, notices: list[tuple[str, str]] = NOTICES, cover: float = COVER) -> str:
    """The same scan in DuckDB's SQL, with the n-grams' words as join keys."""
    values = ", ".join(f"({k}, '{text}', '{label}', {str(k < len(base)).lower()})" for k, (text, label) in enumerate([*base, *notices]))
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH t AS (SELECT template, label, base, string_split(text, ' ') AS tw FROM (VALUES {values}) x(template, text, label, base)),
tp AS (SELECT template, label, base, len(tw) - {GRAM - 1} AS t_grams, tw, unnest(range(0, len(tw) - {GRAM - 1})) AS t_pos FROM t),
tg AS (SELECT template, label, base, t_grams, t_pos, array_to_string(tw[t_pos + 1:t_pos + {GRAM}], ' ') AS gram FROM tp),
d AS (SELECT doc_id, regexp_extract_all({lower}, '{WORD}') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(0, len(words) - {GRAM - 1})) AS pos FROM d WHERE len(words) >= {GRAM}),
h AS (SELECT doc_id, template, label, base, t_grams, t_pos, pos, pos - t_pos AS diagonal FROM p JOIN tg ON tg.gram = array_to_string(words[pos + 1:pos + {GRAM}], ' ')),
v AS (SELECT doc_id, template, label, base, t_grams, diagonal, count(DISTINCT t_pos) AS n_hits, list(DISTINCT t_pos) AS shown FROM h GROUP BY ALL),
w AS (SELECT *, len(list_distinct(flatten(list(shown) OVER (PARTITION BY doc_id, template ORDER BY diagonal RANGE BETWEEN CURRENT ROW AND {SLACK} FOLLOWING)))) / t_grams AS share FROM v),
g AS (SELECT *, base AND n_hits = t_grams AS exact, share >= {cover} AS good FROM w),
r AS (SELECT doc_id, count(*) FILTER (WHERE exact) AS n_base, min(diagonal) FILTER (WHERE exact) AS first_word, max(diagonal) FILTER (WHERE exact) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE exact), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE good), '') AS labels,
  coalesce(max(share) FILTER (WHERE good), 0.0) AS score FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0.0) AS DOUBLE) AS score
FROM d LEFT JOIN r USING (doc_id)
"""
